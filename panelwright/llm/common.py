"""Helpers of the corpus operators: staged tables, bounded id filters, components, word hashes, tokenizer engines."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import shared_dir

#: Distinct values an id filter can hold, whatever the table: the proven size bound of its broadcast.
FILTER_BUCKETS = 1 << 20
#: Bytes of text that one NumPy step looks at; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def staged(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucket_of(column) -> object:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BUCKETS)).cast("int")


def near_ids(frame: DataFrame, column: str, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose id may be among ``ids`` (``keep``), or surely is not; ids are compared by bucket.

    The broadcast side holds bucket numbers, at most ``FILTER_BUCKETS`` rows at any size. With very many ids every
    bucket is taken and all rows may match: the exact join that follows gives the same result, only later.
    """
    name = max(["_bucket", *(f"_{c}" for c in frame.columns)], key=len)  # longer than any column's name
    buckets = F.broadcast(ids.select(bucket_of(ids.columns[0]).alias(name)).distinct())
    how = "left_semi" if keep else "left_anti"
    return frame.withColumn(name, bucket_of(column)).join(buckets, name, how).drop(name)


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b): label is the smallest vertex that can be reached.

    Alternating large-star and small-star rounds; each is one minimum per vertex (combined before the shuffle) joined
    back to the edges. A round's edges are written to the shared folder, so lost executors cost one round.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small_least.select("a", F.col("m").alias("b"))).where("a <> b")
        now = staged(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    stars = now.groupBy("a").agg(F.min("b").alias("label"))
    return stars.select(F.col("a").alias("v"), "label").unionByName(
        stars.select(F.col("label").alias("v"), "label").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex has one smaller neighbour or none, and then no larger one: rounds change nothing more."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").count() == 0


# ---- words as 64-bit numbers -------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _ODD)
    down = np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 21, 1 << int(n - 1).bit_length()))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per [start, end) of ``values`` (uint64), independent of where the span lies."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and each text's first word (one more at the end)."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    low = _LOWER[raw]
    step = np.diff(_SPACE[low].view(np.int8))
    starts, ends = np.flatnonzero(step == -1) + 1, np.flatnonzero(step == 1) + 1
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return span_hashes(_BYTES[low], starts, ends), np.searchsorted(starts, begins)


def steps(batches: Iterator, ids: int = 1) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and whole UTF-8 texts of record batches (id columns first, then text; null is empty), a few megabytes at a time."""
    import pyarrow as pa

    for batch in batches:
        kinds = [batch.column(k) for k in range(ids)]
        text = batch.column(ids).cast(pa.binary())
        sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32 if text.type == pa.binary() else np.int64)[text.offset : text.offset + len(text) + 1]) if len(text) else []
        first = total = 0
        for k, size in enumerate([*sizes, None]):
            if k > first and (size is None or total + size > STEP_BYTES):
                part = slice(first, k)
                keys = [c[part].to_pylist() for c in kinds]
                yield (keys[0] if ids == 1 else list(zip(*keys))), [t or b"" for t in text[part].to_pylist()]
                first, total = k, 0
            total += size or 0


#: Pieces in which tasks hand over their counters.
CHUNKS = 256


def summed_counts(frame: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' counters, rows (chunk int, counts binary of uint32) per task: ``size`` numbers at any input.

    Sums run in the tasks, one small piece at a time; the driver gets ``CHUNKS`` rows.
    """
    def add(batches: Iterator):
        import pyarrow as pa

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(blob.as_py(), np.uint32)
                totals[chunk] = totals.get(chunk, np.zeros(len(counts), np.int64)) + counts
        blobs = [np.minimum(t, 2**32 - 1).astype(np.uint32).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "counts"])

    out = np.zeros(size, np.uint32)
    for row in frame.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[row.chunk * (size // CHUNKS) : (row.chunk + 1) * (size // CHUNKS)] = np.frombuffer(row.counts, np.uint32)
    return out


# ---- public tokenizers -------------------------------------------------------------------------------------------

#: Texts with other characters go to the tokenizers library itself (newer Unicode tables may class them otherwise).
PLAIN = r"\A[\t\n\r\x20-\x7e\xa0-ͯ΄-҂‐-‧‰-⁞₠-₰←-⇿一-龥、-】！-～]*\Z"
#: The splitting rule of the byte-level vocabulary.
BYTE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_names() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    names |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return names


@lru_cache(maxsize=4)
def reference_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def merges(path: str):
    """(ids by token bytes, added tokens): 0xff, which no UTF-8 text holds, stands for a word's end."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    names, end = byte_names(), whole["model"].get("end_of_word_suffix") or ""
    ids = {}
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    for token, number in whole["model"]["vocab"].items():
        if token in special:
            continue
        last = bool(end) and token.endswith(end) and len(token) > len(end)
        core = token[: -len(end)] if last else token
        ids[bytes(names[c] for c in core) + (b"\xff" if last else b"")] = number
    return ids, special


@lru_cache(maxsize=2)
def byte_engine(path: str):
    import tiktoken

    return tiktoken.Encoding("byte-level", pat_str=BYTE_SPLIT, mergeable_ranks=merges(path)[0], special_tokens={})


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes and byte length of every id."""
    ids, special = merges(path)
    table = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, number in [*ids.items(), *((s.encode(), n) for s, n in special.items())]:
        table[number] = token
    return table, np.array([len(t) for t in table], np.int64)


def is_plain(text: str, path: str) -> bool:
    """Whether the fast engine gives the library's ids for certain."""
    import re

    return re.match(PLAIN, text) is not None and not any(s in text for s in merges(path)[1])


def encode_bytes(text: str, path: str) -> list[int]:
    """Ids as the tokenizers library gives them, without added special tokens, truncation or padding."""
    if is_plain(text, path):
        return byte_engine(path).encode_ordinary(text)
    return reference_tokenizer(path).encode(text, add_special_tokens=False).ids


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package is looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def crc_remainder(column: str, modulus: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))




def without(frame: DataFrame, column: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``frame`` whose id is not in ``dropped`` (one column of ids); rows without an id stay.

    Only rows whose bucket a dropped id shares are shuffled.
    """
    ids = dropped.toDF(column).distinct()
    return near_ids(frame, column, ids, keep=False).unionByName(near_ids(frame, column, ids).join(ids, column, "left_anti").select(frame.columns))
