"""Content identity, keys, revision logs and version comparison."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.alignment import script


def fingerprint(frame: DataFrame, columns: list, keys: list[str], extra: tuple[Column, ...] = ()) -> DataFrame:
    """Order-insensitive content hash per group, with further aggregates of the same pass if asked for.

    Every row is hashed; the five 48-bit pieces of each hash are added up, which combines map-side and
    needs no collected list, and the sums are hashed again. Row order and partitioning cannot matter. A cell is
    written with its length before it and a missing one as ``N``, so no two different rows look alike.
    """
    cells = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("N")) for c in cells]
    hashed = frame.withColumn("_h", F.sha2(F.concat(*parts), 256))
    pieces = [
        F.sum(F.conv(F.substring("_h", 1 + 12 * n, 12), 16, 10).cast("decimal(20,0)")).alias(f"_p{n}") for n in range(5)
    ]
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"_p{n}").cast("string") for n in range(5)])
    grouped = hashed.groupBy(*keys).agg(F.count("*").alias("rows"), *pieces, *extra)
    return grouped.withColumn("fingerprint", F.sha2(text, 256)).drop(*[f"_p{n}" for n in range(5)])


def latest_by(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def differs(left: str, right: str) -> Column:
    return ~F.col(left).eqNullSafe(F.col(right))


def upsert(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Merged table after a batch, with what happened to every key.

    Both sides are reduced to one row per key before the join, so the join is one-to-one.
    """
    old = current.select(*keys, F.col("value").alias("old_value"), F.col("source_url").alias("old_url"),
                         F.lit(True).alias("_old"))
    new = batch.select(*keys, F.col("value").alias("new_value"), F.col("source_url").alias("new_url"),
                       F.lit(True).alias("_new"))
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    change = (
        F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted")
        .when(differs("old_value", "new_value"), "value_revision")
        .when(differs("old_url", "new_url"), "source_update").otherwise("unchanged")
    )
    merged = F.col("_new").isNotNull()
    return old.join(new, keys, "full").select(
        *keys, change.alias("change_type"),
        F.when(both, F.col("old_value")).alias("old_value"), F.when(both, F.col("old_url")).alias("old_url"),
        F.when(merged, F.col("new_value")).otherwise(F.col("old_value")).alias("value"),
        F.when(merged, F.col("new_url")).otherwise(F.col("old_url")).alias("source_url"),
    )


def revision_log(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    changed = upsert(current, batch, keys).filter(F.col("change_type").isin("value_revision", "source_update"))
    return changed.withColumnsRenamed({"value": "new_value", "source_url": "new_url"})


def rekey(rows: DataFrame, key: str, legacy: str, before: int) -> DataFrame:
    """Move rows before a definition break to the legacy key; existing legacy rows win and the mover is dropped."""
    moved = (F.col("key") == key) & (F.col("mid") < before)
    taken = rows.filter(F.col("key") == legacy).select(F.lit(legacy).alias("_to"), "mid")
    target = rows.withColumn("_to", F.when(moved, F.lit(legacy)).otherwise(F.col("key")))
    stay = target.filter(~moved)
    go = target.filter(moved).join(taken, ["_to", "mid"], "left_anti")
    return stay.unionByName(go).drop("key").withColumnRenamed("_to", "key")


def version_outer(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two versions with a membership marker."""
    a = old.select(*keys, F.col("value").alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col("value").alias("new_value"), F.lit(True).alias("_b"))
    side = F.when(F.col("_b").isNull(), "old only").when(F.col("_a").isNull(), "new only").otherwise("both")
    return a.join(b, keys, "full").withColumn("membership", side).drop("_a", "_b")


def change_status(outer: DataFrame) -> DataFrame:
    """Six-way status in fixed precedence; a delta only for genuine revisions."""
    old, new = F.col("old_value"), F.col("new_value")
    status = (
        F.when(F.col("membership") == "old only", "removed").when(F.col("membership") == "new only", "added")
        .when(old.isNull() & new.isNull(), "unchanged").when(old.isNull(), "new value")
        .when(new.isNull(), "became null").when(old == new, "unchanged").otherwise("revised")
    )
    return outer.withColumn("status", status).withColumn("delta", F.when(F.col("status") == "revised", new - old))


def scope_override(changes: DataFrame, old_scope: DataFrame, new_scope: DataFrame, keys: list[str]) -> DataFrame:
    """A changed unit or period is its own status and suppresses the delta, except for membership changes."""
    scopes = old_scope.withColumnRenamed("scope", "old_scope").join(
        new_scope.withColumnRenamed("scope", "new_scope"), keys, "full"
    )
    joined = changes.join(scopes, keys, "left")
    moved = (F.coalesce("old_scope", F.lit("")) != F.coalesce("new_scope", F.lit(""))) & ~F.col("status").isin(
        "added", "removed"
    )
    return joined.withColumns({
        "status": F.when(moved, "scope changed").otherwise(F.col("status")),
        "delta": F.when(~moved, F.col("delta")),
    })


def diff_summary(changes: DataFrame, groups: list[str]) -> DataFrame:
    status = F.col("status")
    return changes.groupBy(*groups).agg(
        F.count("*").alias("rows"), F.count_if(status.isin("added", "removed")).alias("membership_changes"),
        F.count_if(status.isin("revised", "new value", "became null", "scope changed")).alias("value_changes"),
        F.count_if(status == "unchanged").alias("unchanged"),
    )


def line_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Lines whose number of occurrences differs between two versions of a document.

    Occurrences are counted per line and document on both sides in one aggregation, so a document with many
    copies of one line costs a single counter.
    """
    def lines(frame: DataFrame, before: int, after: int) -> DataFrame:
        return frame.select(key, F.explode(F.split("text", "\n")).alias("line")).select(
            key, F.md5("line").alias("line_hash"), F.lit(before).alias("b"), F.lit(after).alias("a")
        )

    counts = lines(old, 1, 0).unionByName(lines(new, 0, 1)).groupBy(key, "line_hash").agg(
        F.sum("b").alias("before"), F.sum("a").alias("after")
    )
    return counts.filter("before <> after").select(
        key, "line_hash", F.greatest(F.lit(0), F.col("before") - F.col("after")).alias("removed"),
        F.greatest(F.lit(0), F.col("after") - F.col("before")).alias("added"),
    )


SCRIPT = "hunk int, op string, old_no int, new_no int, line string"


def line_script(old: DataFrame, new: DataFrame, key: str, context: int | None = 3) -> DataFrame:
    """(``key``, hunk, op, old_no, new_no, line): how the lines of each document (``key``, text) change between two versions.

    ``op`` is ``-`` for a removed line, ``+`` for an added one and a blank for a kept line within ``context`` lines of a change
    (all of them with None). Line numbers begin at 1; a removed line has the number of the new line before it, an added one
    that of the old line before it. Lines that stand once in both versions are aligned first, as their longest rising chain, and the
    stretches between them by a shortest edit script (``functions.alignment``). A document without changes gives no rows; one that
    stands in one version only, or has a null text in the other, is all added or removed. Keys are unique and not null.

    Both versions are joined on the key; every document is aligned in its own row, in memory that grows with its lines.
    """
    before = old.select(key, F.col("text").alias("old_text"))
    after = new.select(key, F.col("text").alias("new_text"))
    changed = before.join(after, key, "full").filter(~F.col("old_text").eqNullSafe(F.col("new_text")))
    schema = f"{key} {changed.schema[key].dataType.simpleString()}, {SCRIPT}"

    def align(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for k in range(len(batch)):
                lines = [t.split("\n") if t is not None else [] for t in (batch.column(1)[k].as_py(), batch.column(2)[k].as_py())]
                rows = script(*lines, context)
                for low in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[low : low + 10_000]))
                    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
                    keys = pa.array([batch.column(0)[k].as_py()] * len(columns[0]), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(columns, kinds))],
                                                     names=[key, "hunk", "op", "old_no", "new_no", "line"])

    return changed.mapInArrow(align, schema)


def apply_script(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(``key``, text) of the later version, rebuilt from the earlier one and the removed and added lines of ``line_script``.

    A document whose lines were all removed has no row.
    """
    lines = old.select(key, F.posexplode(F.split("text", "\n")).alias("old_no", "line")).withColumn("old_no", F.col("old_no") + 1)
    removed = changes.filter("op = '-'").select(key, "old_no")
    stays = lines.join(removed, [key, "old_no"], "left_anti").select(key, F.struct("old_no", F.lit(0).alias("added"), F.lit(0).alias("new_no"), "line").alias("l"))
    added = changes.filter("op = '+'").select(key, F.struct("old_no", F.lit(1).alias("added"), "new_no", "line").alias("l"))
    whole = stays.unionByName(added).groupBy(key).agg(F.array_sort(F.collect_list("l")).alias("lines"))
    return whole.select(key, F.array_join(F.transform("lines", lambda l: l["line"]), "\n").alias("text"))


def typed_cells(frame: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Long form with every cell as text and its type."""
    types = dict(frame.dtypes)
    cells = F.array(*[
        F.struct(F.lit(c).alias("field"), F.lit(types[c]).alias("type"),
                 (F.col(c).cast("decimal(24,6)").cast("string") if types[c] == "double" else F.col(c).cast("string")).alias("text"))
        for c in columns
    ])
    return frame.select(*keys, F.explode(cells).alias("c")).select(
        *keys, "c.field", F.col("c.type").alias(f"{name}_type"), F.col("c.text").alias(f"{name}_text")
    )


def cell_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    joined = typed_cells(old, keys, columns, "old").join(
        typed_cells(new, keys, columns, "new"), [*keys, "field"], "full"
    )
    kind = (
        F.when(F.col("old_type").isNull() | F.col("new_type").isNull(), "missing row")
        .when(differs("old_type", "new_type"), "type").when(differs("old_text", "new_text"), "value")
    )
    delta = F.col("new_text").try_cast("double") - F.col("old_text").try_cast("double")
    return joined.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn(
        "numeric_delta", F.when((F.col("old_type") == "double") & (F.col("new_type") == "double"), delta)
    )


def close(left: Column, right: Column, relative: float = 1e-9, absolute: float = 1e-10) -> Column:
    bound = F.greatest(relative * F.greatest(F.abs(left), F.abs(right)), F.lit(absolute))
    return F.coalesce(F.abs(left - right) <= bound, left.isNull() & right.isNull())


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def value_defects(frame: DataFrame, groups: list[str], column: str = "value") -> DataFrame:
    value = F.col(column)
    infinite = F.abs(value) == float("inf")
    return frame.groupBy(*groups).agg(
        F.count("*").alias("rows"), F.count_if(value.isNull()).alias("nulls"),
        F.count_if(F.isnan(value)).alias("nans"), F.count_if(infinite & ~F.isnan(value)).alias("infinite"),
        F.count_if(value.isNotNull() & ~F.isnan(value) & ~infinite).alias("valid"),
    )


def active_batches(events: DataFrame) -> DataFrame:
    """Active batch of every stem and the one before it.

    Only aggregates: the newest event by ``max`` of an ordered struct, then the newest one older than it, so a
    stem holding a third of all events is still reduced map-side.
    """
    stamped = events.filter(F.col("status").isin("published", "restored")).select(
        "stem", F.struct("ts", "event_id", "batch_id", "status").alias("e")
    )
    newest = stamped.groupBy("stem").agg(F.max("e").alias("active"))
    before = stamped.join(newest, "stem").filter("e < active").groupBy("stem").agg(F.max("e").alias("previous"))
    return newest.join(before, "stem", "left").select(
        "stem", F.col("active.batch_id").alias("active_batch"), F.col("active.status").alias("active_status"),
        F.col("active.event_id").alias("event_id"), F.col("previous.batch_id").alias("previous_batch"),
    )


def rollback_eligibility(events: DataFrame) -> DataFrame:
    """A batch may be rolled back only while it is active for all stems it published."""
    published = events.filter("status = 'published'").select("batch_id", "stem").distinct()
    active = active_batches(events).select("stem", "active_batch")
    return published.join(active, "stem").groupBy("batch_id").agg(
        F.count("*").alias("stems"), F.count_if(F.col("active_batch") == F.col("batch_id")).alias("active_stems"),
        F.every(F.col("active_batch") == F.col("batch_id")).alias("eligible"),
    )


def partition_contract(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys missing from, and unexpected in, the actual table."""
    missing = expected.exceptAll(actual).withColumn("problem", F.lit("missing"))
    extra = actual.exceptAll(expected).withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def guarded_text(name: str) -> Column:
    """Prefix a quote where a spreadsheet would read the cell as a formula."""
    risky = F.col(name).rlike(r"^\s*[=+\-@\t\r]")
    return F.when(risky, F.concat(F.lit("'"), F.col(name))).otherwise(F.col(name))


def guard_frame(frame: DataFrame) -> DataFrame:
    return frame.withColumns({name: guarded_text(name) for name, kind in frame.dtypes if kind == "string"})


def union_by_priority(collectors: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Rows of all collectors; for one key the collector listed last wins.

    The winner is a ``max_by`` aggregate, so repeated keys are reduced before the shuffle.
    """
    combined = None
    for priority, (name, frame) in enumerate(collectors):
        tagged = frame.withColumns({"collector": F.lit(name), "_p": F.lit(priority)})
        combined = tagged if combined is None else combined.unionByName(tagged, allowMissingColumns=True)
    values = [c for c in combined.columns if c not in (*keys, "_p")]
    return combined.groupBy(*keys).agg(F.max_by(F.struct(*values), "_p").alias("w")).select(*keys, "w.*")
