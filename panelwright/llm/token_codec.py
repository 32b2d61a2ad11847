"""Byte-level BPE of report texts with content-defined chunks: chunks that reports share are encoded once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import (
    _BYTES, byte_engine, byte_table, encode_bytes, is_plain, mixed, near_ids, powers, staged,
)

#: Bytes the rolling hash looks at, and the mean chunk length (a power of two).
WINDOW, MEAN_CHUNK = 48, 512
ENCODED = "report_id long, n_tokens long, ids binary, text_bytes binary"


def cut_points(raw: bytes) -> list[int]:
    """Chunk borders of a text: 0, every place where the hash of the last WINDOW bytes says so, and the end.

    A border depends on the bytes before it alone, so equal passages give equal chunks wherever they stand. No border
    falls inside a character.
    """
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if n <= WINDOW:
        return [0, n] if n else [0]
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    at = np.arange(WINDOW, n)
    rolled = mixed((total[at] - total[at - WINDOW]) * down[at - WINDOW])
    cut = at[((rolled & np.uint64(MEAN_CHUNK - 1)) == 0) & ((data[at] & 0xC0) != 0x80)]
    return [0, *cut.tolist(), n]


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunks(path: str):
    def chunks(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            owners, digests = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not is_plain(text, path):
                    continue  # encoded whole by the library
                raw = text.encode()
                cuts = cut_points(raw)
                found = {chunk_digest(raw[a:b]) for a, b in zip(cuts, cuts[1:])}
                owners += [key] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(digests, pa.binary())], names=["report_id", "digest"])

    return chunks


def _encode_shared(path: str):
    def encode(batches: Iterator):
        """Ids of the wanted chunks of each owner text."""
        import pyarrow as pa

        engine = byte_engine(path)
        for batch in batches:
            digests, ids = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, missing = text.encode(), set(wanted)
                cuts = cut_points(raw)
                for a, b in zip(cuts, cuts[1:]):
                    digest = chunk_digest(raw[a:b])
                    if digest in missing:
                        missing.discard(digest)
                        digests.append(digest)
                        ids.append(np.array(engine.encode_ordinary(raw[a:b].decode()), "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.binary())], names=["digest", "ids"])

    return encode


@lru_cache(maxsize=1)
def _white() -> np.ndarray:
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    return white


def _sync(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places in [low, high) where a new word starts whatever lies further off: ASCII white space after an ASCII sign."""
    if high - low < 2:
        return np.empty(0, np.int64)
    white = _white()[data[low:high]]
    return np.flatnonzero(white[1:] & ~white[:-1] & (data[low : high - 1] < 128)) + low + 1


def join_chunks(raw: bytes, parts: list[tuple[int, int, np.ndarray]], path: str) -> np.ndarray:
    """Ids of a text from the ids of its consecutive parts (start, end, ids).

    The ids near a join are wrong if a word or a run of spaces was cut. Around each join a window between two places
    where a word surely starts is encoded anew, and grows on both sides until its outer ids agree with those of the parts.
    """
    engine, (_, sizes) = byte_engine(path), byte_table(path)
    data = np.frombuffer(raw, np.uint8)
    done, where = parts[0][2], parts[0][0] + np.cumsum(sizes[parts[0][2]])  # ids so far, and where each ends
    for start, end, ids in parts[1:]:
        ends = start + np.cumsum(sizes[ids])
        reach = 64
        while True:
            low, high = max(0, start - reach), min(end, start + reach)
            left, right = _sync(data, low, start), _sync(data, start, high)
            far = left[-2] if len(left) > 1 else 0 if low == 0 else None
            beyond = right[1] if len(right) > 1 else end if high == end else None
            if far is not None and beyond is not None:
                window = np.array(engine.encode_ordinary(raw[far:beyond].decode()), np.int64)
                at = far + np.cumsum(sizes[window])
                head = np.searchsorted(where, far, side="right")
                tail = np.searchsorted(ends, beyond, side="left") + 1 if beyond < end else len(ids)
                inner_left = left[-1] if len(left) > 1 else 0
                inner_right = right[0] if len(right) > 1 else end
                mine = np.searchsorted(at, inner_left, side="right")
                agree_left = np.array_equal(window[:mine], done[head : np.searchsorted(where, inner_left, side="right")])
                theirs = np.searchsorted(ends, inner_right, side="right")
                agree_right = np.array_equal(window[np.searchsorted(at, inner_right, side="right") :], ids[theirs:tail])
                if (agree_left or far == 0) and (agree_right or beyond == end):
                    done = np.concatenate((done[:head], window, ids[tail:]))
                    where = np.concatenate((where[:head], at, ends[tail:]))
                    break
            if low == 0 and high == end:
                whole = np.array(engine.encode_ordinary(raw[:end].decode()), np.int64)
                done, where = whole, np.cumsum(sizes[whole])
                break
            reach *= 4
    return done


def encode_with(raw: bytes, known: dict[bytes, bytes], path: str) -> np.ndarray:
    """Ids of a text, taking those of known chunks and encoding each stretch between them once."""
    engine = byte_engine(path)
    parts: list[tuple[int, int, np.ndarray]] = []
    cuts, since = cut_points(raw), 0
    for a, b in zip(cuts, cuts[1:]):
        ids = known.get(chunk_digest(raw[a:b]))
        if ids is not None:
            if since < a:
                parts.append((since, a, np.array(engine.encode_ordinary(raw[since:a].decode()), np.int64)))
            parts.append((a, b, np.frombuffer(ids, "<u2").astype(np.int64)))
            since = b
    if since < len(raw):
        parts.append((since, len(raw), np.array(engine.encode_ordinary(raw[since:].decode()), np.int64)))
    return join_chunks(raw, parts, path) if parts else np.empty(0, np.int64)


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    table, _ = byte_table(path)
    return b"".join([table[k] for k in ids.tolist()]).decode("utf-8", errors="replace")


def _codec(path: str, shared: bool):
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            lookups = batch.column(2).to_pylist() if shared else [None] * len(texts)
            for low in range(0, len(texts), 200):
                rows: tuple[list, list, list] = ([], [], [])
                for text, known in zip(texts[low : low + 200], lookups[low : low + 200]):
                    if known and is_plain(text, path):
                        ids = encode_with(text.encode(), {d["digest"]: d["ids"] for d in known}, path)
                    else:
                        ids = np.array(encode_bytes(text, path), np.int64)
                    rows[0].append(len(ids))
                    rows[1].append(ids.astype("<u4").tobytes())
                    rows[2].append(decode(ids, path).encode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low : low + 200], pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())],
                    names=["report_id", "n_tokens", "ids", "text_bytes"])

    return run


def round_trip(reports: DataFrame, tokenizer: str, report_id: str = "report_id", text: str = "text") -> DataFrame:
    """(report_id, n_tokens, ids, text_bytes) of every report: its token ids (little-endian uint32) and, decoded from
    them, its text in UTF-8.

    Texts are cut where a rolling hash of 48 bytes says so (512 bytes on average). Chunks that two or more reports hold are
    encoded once, in the report of smallest id, and their ids are joined to all reports that hold them; a report without
    such chunks is encoded where it lies. At every join of chunks the ids are made anew until they agree (``join_chunks``),
    so the result is that of the tokenizers library on the whole text. Texts that hold a special string, or characters whose
    class depends on the Unicode version, are encoded whole by that library. Null text is empty and has no ids; rows
    without an id are left out; repeated rows are repeated; an empty table gives an empty result.

    Shuffles: a digest and an id per chunk; texts only of reports that may hold a shared chunk.
    """
    rows = reports.select(F.col(report_id).cast("long").alias("report_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.where("report_id IS NOT NULL")
    held = staged(rows.mapInArrow(_chunks(tokenizer), "report_id long, digest binary").distinct(), "chunks")
    shared = staged(held.groupBy("digest").agg(F.count("*").alias("n"), F.min("report_id").alias("owner")).where("n > 1").drop("n"), "shared")
    owners = shared.groupBy(F.col("owner").alias("report_id")).agg(F.collect_list("digest").alias("wanted"))
    texts = near_ids(rows, "report_id", shared.select("owner")).join(owners, "report_id").select("text", "wanted")
    encoded = texts.mapInArrow(_encode_shared(tokenizer), "digest binary, ids binary")
    encoded = encoded.groupBy("digest").agg(F.max("ids").alias("ids"))  # an id may stand on two rows
    uses = held.join(encoded, "digest").groupBy("report_id").agg(F.collect_list(F.struct("digest", "ids")).alias("known"))
    users = held.join(shared, "digest", "left_semi").select("report_id")
    with_shared = near_ids(rows, "report_id", users).join(uses, "report_id", "left").select("report_id", "text", "known")
    without = near_ids(rows, "report_id", users, keep=False)
    return with_shared.mapInArrow(_codec(tokenizer, True), ENCODED).unionByName(
        without.mapInArrow(_codec(tokenizer, False), ENCODED))
