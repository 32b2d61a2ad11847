"""Imports every plan module so that its queries are registered."""

from panelwright.plans import registry


def _load() -> None:
    import importlib
    import pkgutil

    import panelwright.plans as package

    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        if module not in ("registry", "catalogue", "oracle_views"):
            importlib.import_module(f"panelwright.plans.{module}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
