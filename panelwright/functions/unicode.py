"""Unicode folding of texts: compatibility forms, white space and case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every sign that counts as white space.
WHITE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@F.arrow_udf(T.StringType())
def _compatible(texts):
    """NFKC of a whole Arrow array at once; nulls stay null. Arrow's own NFKC does not compose signs, so the standard library's is taken."""
    import unicodedata

    import pyarrow as pa

    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def fold(text: Column) -> Column:
    """Compatibility forms replaced (NFKC), white space of any kind removed, lower case; null stays null.

    Only texts with signs beyond ASCII travel to Python, in Arrow batches; all others, and the rest of the
    work, stay in the JVM.
    """
    wide = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.lower(F.regexp_replace(F.coalesce(_compatible(wide), text), WHITE, ""))
