"""Near-equal vectors: Euclidean p-stable hashing, then exact cosines inside the buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import components, mixed, staged

#: Width of a quantised projection of unit vectors.
WIDTH = 1.0
#: Unrelated vectors that a bucket may hold on average; more projections are taken for larger tables.
EXPECTED = 256
#: Share of the pairs exactly at the threshold that all tables may miss.
MISSED = 1e-3
#: Vectors of one bucket block; two blocks are compared at a time.
BLOCK = 1024
LINKS = "vec_id long, other_links long, label long"


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at this distance fall in one cell of a random projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(projections of a table, tables) for ``n`` vectors: buckets of bounded expected size, bounded misses."""
    far = collision(math.sqrt(2))
    depth = max(1, round(math.log(max(1.0, n / EXPECTED)) / -math.log(far)))
    near = collision(math.sqrt(max(2 - 2 * threshold, 1e-12))) ** depth
    return depth, max(1, math.ceil(math.log(MISSED) / math.log1p(-near)))


def _keys(depth: int, tables: int):
    def keys(batches: Iterator):
        import pyarrow as pa

        drawn: dict[int, tuple] = {}
        for batch in batches:
            ids, copies = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            vectors = batch.column(2).to_pylist()
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(k)
            for size, rows in by_size.items():
                if size not in drawn:
                    rng = np.random.default_rng([20240917, size])
                    drawn[size] = (rng.standard_normal((size, depth * tables)), rng.uniform(0, WIDTH, depth * tables),
                                   rng.integers(1, 1 << 62, depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                directions, shifts, factors = drawn[size]
                for low in range(0, len(rows), 1000):
                    part = rows[low : low + 1000]
                    x = np.array([vectors[k] for k in part], np.float64)
                    unit = x / np.sqrt((x * x).sum(1))[:, None]
                    cells = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).astype(np.uint64)
                    hashed = mixed((cells.reshape(len(part), tables, depth) * factors).sum(2, dtype=np.uint64) + np.uint64(size)).view(np.int64)
                    bytes_ = pa.array([v.tobytes() for v in x], pa.binary())
                    all_keys = pa.array([h.tobytes() for h in hashed], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), t), pa.int32()), pa.array(hashed[:, t]), pa.array(ids[part]), pa.array(copies[part]), bytes_, all_keys],
                            names=["t", "bucket", "vec_id", "copies", "vector", "buckets"])

    return keys


def block_links(t: int, ids, copies, vectors: list[bytes], buckets: list[bytes], side: np.ndarray, whole: bool, threshold: float):
    """(vec_id, copies linked in no earlier table, smallest id of the linked part) for the rows of one pair of blocks.

    ``side`` numbers the blocks; unless the two are one (``whole``) only pairs across them are new.
    """
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(ids), -1)
    norms = np.sqrt((x * x).sum(1))
    close = (x @ x.T) / norms[:, None] / norms[None, :] >= threshold
    np.fill_diagonal(close, False)
    if not whole:
        close &= side[:, None] != side[None, :]
    a, b = np.nonzero(close)
    if not len(a):
        return None
    fresh = np.ones(len(a), bool)
    if t:
        keys = np.frombuffer(b"".join(buckets), np.int64).reshape(len(ids), -1)[:, :t]
        for low in range(0, len(a), 1 << 16):
            part = slice(low, low + (1 << 16))
            fresh[part] = ~(keys[a[part]] == keys[b[part]]).any(1)
    counts = np.zeros(len(ids), np.int64)
    np.add.at(counts, a[fresh], copies[b[fresh]])
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        if np.array_equal(label, before):
            break
    touched = np.unique(a)
    return ids[touched], counts[touched], label[touched]


def _compare(threshold: float):
    def compare(batches: Iterator):
        """Rows come sorted by bucket and block pair; one such group is held at a time, at most two blocks."""
        import pyarrow as pa

        held, held_key = [], None

        def flush():
            if not held or sum(len(h[0]) for h in held) < 2:
                return None
            joined = [np.concatenate([h[k] for h in held]) for k in (0, 1, 4)]
            vectors, buckets = ([v for h in held for v in h[k]] for k in (2, 3))
            found = block_links(held_key[0], joined[0], joined[1], vectors, buckets, joined[2], held_key[2] == held_key[3], threshold)
            return found and pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["vec_id", "other_links", "label"])

        for batch in batches:
            if not len(batch):
                continue
            t, bucket, one, two, side, ids, copies = (np.asarray(batch.column(k)) for k in range(7))
            vectors, buckets = batch.column(7).to_pylist(), batch.column(8).to_pylist()
            change = np.flatnonzero((np.diff(t) != 0) | (np.diff(bucket) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1
            for low, high in zip([0, *change], [*change, len(batch)]):
                key = (int(t[low]), int(bucket[low]), int(one[low]), int(two[low]))
                if key != held_key:
                    if out := flush():
                        yield out
                    held, held_key = [], key
                held.append((ids[low:high], copies[low:high], vectors[low:high], buckets[low:high], side[low:high]))
        if out := flush():
            yield out

    return compare


def near_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector with an id.

    The project keeps no vectors of its own, so this operator is general: any table of an id and an array of numbers.
    Two vectors link when their cosine in double precision is at least ``threshold``. Null, empty or zero vectors, and
    those with null or non-finite components, link with nothing; vectors of different length never meet. n_links counts
    the vectors linked directly, component_id is the smallest id reached by links, kept marks that vector. Repeated rows
    count as linked vectors of their own. Other columns are ignored; an empty table gives an empty result.

    Equal vectors are one row with a count. Unit vectors are hashed by ``depth`` quantised Gaussian projections in several
    tables; both numbers follow from the number of vectors (``plan``), so that a bucket holds about 256 unrelated
    vectors and a pair exactly at the threshold is missed with chance 0.001. Each pair in a bucket is compared exactly and counted
    in the first table in which it meets. A bucket of more than ``BLOCK`` vectors is dealt into blocks and pairs of blocks,
    so no task holds more than two blocks, and a block gives a count and a label per vector instead of pairs.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    fine = F.coalesce(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0), F.lit(False))
    usable = rows.where(fine)
    first = staged(usable.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")), "vectors")
    n = first.count()
    depth, tables = plan(n, threshold)
    keyed = first.select("first_id", "copies", "embedding").mapInArrow(
        _keys(depth, tables), "t int, bucket long, vec_id long, copies long, vector binary, buckets binary")
    large = keyed.groupBy("t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    dealt = keyed.join(large, ["t", "bucket"], "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(BLOCK)).cast("int"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("vec_id", "t"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "bucket", F.least("side", "other").cast("int").alias("one"), F.greatest("side", "other").cast("int").alias("two"),
                         "side", "vec_id", "copies", "vector", "buckets")
    order = ["t", "bucket", "one", "two"]
    found = staged(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare(threshold), LINKS), "links")
    counts = found.groupBy("vec_id").agg(F.sum("other_links").alias("other_links"))
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("label").alias("b")))
    per_vector = (first.join(counts.withColumnRenamed("vec_id", "first_id"), "first_id", "left")
                  .join(labels.withColumnRenamed("v", "first_id"), "first_id", "left")
                  .select("embedding", (F.col("copies") - 1 + F.coalesce("other_links", F.lit(0))).alias("n_links"),
                          F.coalesce("label", "first_id").alias("component_id")))
    linked = usable.join(per_vector, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
