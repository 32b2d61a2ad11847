"""Archive of report token ids: shards compressed by Re-Pair grammars, with random access to every report."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.common import PLAIN, byte_engine, merges, reference_tokenizer, steps, text_of

#: Ids of a shard; the report that passes this ends it.
SHARD_IDS = 1 << 19
#: Symbols of a shard's grammar: terminals and rules.
SYMBOLS = 1 << 16
#: Least occurrences that make a pair a rule, and the share of symbols a round must save for another one to follow.
LEAST_USES, LEAST_SAVED = 4, 0.01
#: Cells of the table in which a round counts pairs.
CELL_BITS = 18
_FACTORS = np.random.default_rng(20240911).integers(1, 1 << 31, 64, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ASCII = bytes([9, 10, 13, *range(32, 127)])

SHARDS = ("part int, shard int, part_start long, n_ids long, report_ids array<long>, report_symbols array<int>, terminals binary, "
          "rules binary, rule_lengths binary, rounds array<int>, width int, symbols binary")
REPORTS = "report_id long, start long, n_tokens long, ids binary"


# ---- Re-Pair -------------------------------------------------------------------------------------------------------


def repair(ids: np.ndarray, last: np.ndarray) -> dict:
    """A grammar of ``ids``: (terminals, rules, rule_lengths, rounds, symbols, last).

    In every round all adjacent pairs are counted; each occurrence that is more frequent than the two it overlaps (ties
    by the pair's hash, so that repeated passages are cut alike) is replaced by the pair's own symbol, if at least
    ``LEAST_USES`` occurrences are. Rounds go on while they pay. ``last`` marks the last id of each report: no rule passes a
    report's end. A symbol below the number of terminals stands for an id, the others for rules (pairs of earlier symbols).
    Pairs are counted in ``2**CELL_BITS`` cells; a cell counts one of the pairs that fall into it, the others wait for the next
    round's hash.
    """
    seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
    seen[ids] = True
    terminals = np.flatnonzero(seen).astype(np.uint32)
    place = np.zeros(len(seen), np.uint32)
    place[terminals] = np.arange(len(terminals), dtype=np.uint32)
    sequence, last = place[ids], last.copy()
    rules, rounds = [], []
    known, shift = len(terminals), np.uint32(32 - CELL_BITS)
    numbers = np.arange(1 << CELL_BITS, dtype=np.int64)
    while len(sequence) > 1 and known < SYMBOLS and len(rounds) < len(_FACTORS):
        key = (sequence[:-1] << np.uint32(16)) | sequence[1:]
        cell = ((key * _FACTORS[len(rounds)]) >> shift).astype(np.int64)
        pair = np.zeros(1 << CELL_BITS, np.uint32)
        pair[cell] = key
        own = (pair[cell] == key) & ~last[:-1]
        counts = np.bincount(cell[own], minlength=1 << CELL_BITS)
        rank = np.where(counts >= LEAST_USES, (counts << CELL_BITS) | numbers, 0)[cell]
        rank[~own] = 0
        chosen = rank > 0
        chosen[1:] &= rank[1:] > rank[:-1]
        chosen[:-1] &= rank[:-1] >= rank[1:]
        at = np.flatnonzero(chosen)
        uses = np.bincount(cell[at], minlength=1 << CELL_BITS)
        new = np.flatnonzero(uses >= LEAST_USES)
        if len(new) > SYMBOLS - known:
            new = np.sort(new[np.argsort(-uses[new], kind="stable")[: SYMBOLS - known]])
        symbol = np.zeros(1 << CELL_BITS, np.uint32)
        symbol[new] = np.arange(known, known + len(new), dtype=np.uint32)
        at = at[symbol[cell[at]] > 0]
        if not len(at):
            break
        rules.append(pair[new])
        rounds.append(len(new))
        known += len(new)
        before = len(sequence)
        sequence[at] = symbol[cell[at]]
        last[at] = last[at + 1]
        keep = np.ones(before, bool)
        keep[at + 1] = False
        sequence, last = sequence[keep], last[keep]
        if len(at) < LEAST_SAVED * before:
            break
    pairs = np.concatenate(rules) if rules else np.empty(0, np.uint32)
    grammar = {"terminals": terminals, "rules": np.stack([pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)], 1).reshape(-1),
               "rounds": rounds, "symbols": sequence, "last": last}
    grammar["rule_lengths"] = expansion_lengths(grammar)[len(terminals) :]
    return grammar


def expansion_lengths(grammar: dict) -> np.ndarray:
    """Ids that every symbol stands for."""
    n, (left, right) = len(grammar["terminals"]), grammar["rules"].reshape(-1, 2).T
    lengths = np.ones(n + len(left), np.int64)
    low = 0
    for size in grammar["rounds"]:
        own = slice(low, low + size)
        lengths[n + low : n + low + size] = lengths[left[own]] + lengths[right[own]]
        low += size
    return lengths


class Grammar:
    """Reader of one shard: the ids of any stretch of symbols, or of any stretch of a report's ids."""

    def __init__(self, terminals: np.ndarray, rules: np.ndarray, rule_lengths: np.ndarray, rounds: list[int], symbols: np.ndarray):
        self.symbols = symbols
        self.lengths = np.concatenate((np.ones(len(terminals), np.int64), rule_lengths.astype(np.int64)))
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.empty(int(self.lengths.sum()), np.uint32)
        self.flat[: len(terminals)] = terminals
        low = 0
        for size in rounds:  # a round's rules stand for pairs of symbols of earlier rounds
            own, first = rules[2 * low : 2 * (low + size)], len(terminals) + low
            made = self.expand(own)
            self.flat[self.begins[first] : self.begins[first] + len(made)] = made
            low += size

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.lengths[symbols]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        return self.flat[np.repeat(self.begins[symbols] - (stops - sizes), sizes) + np.arange(total)]

    def stretch(self, first: int, end: int, start: int, length: int) -> np.ndarray:
        """``length`` ids from ``start`` of the report in symbols [first, end); only symbols that overlap it are expanded."""
        stops = np.cumsum(self.lengths[self.symbols[first:end]])
        low, high = np.searchsorted(stops, start, side="right"), np.searchsorted(stops, start + length, side="left") + 1
        ids = self.expand(self.symbols[first + low : min(first + high, end)])
        skipped = start - (int(stops[low - 1]) if low else 0)
        return ids[skipped : skipped + length]


# ---- writing and reading -------------------------------------------------------------------------------------------


def _ids(raw: bytes, path: str) -> np.ndarray:
    """Ids of a text; the library itself encodes texts with special strings or characters of changing class."""
    text = raw.decode()
    plain = not raw.translate(None, _ASCII) or re.match(PLAIN, text) is not None
    if plain and not any(s in text for s in merges(path)[1]):
        return np.array(byte_engine(path).encode_ordinary(text), np.uint32)
    return np.array(reference_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


def _write(path: str, end: int):
    def write(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, written = TaskContext.get().partitionId(), 0, 0
        keys: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def shard():
            nonlocal number, written, size
            lengths = np.array([len(h) for h in held])
            last = np.zeros(size, bool)
            last[np.cumsum(lengths) - 1] = True
            made = repair(np.concatenate(held), last)
            width = 2 if len(made["terminals"]) + len(made["rule_lengths"]) <= SYMBOLS else 4
            ends = np.flatnonzero(made["last"])
            row = {"part": part, "shard": number, "part_start": written, "n_ids": size, "report_ids": list(keys),
                   "report_symbols": np.diff(np.concatenate(([-1], ends))).tolist(), "terminals": made["terminals"].astype("<u4").tobytes(),
                   "rules": made["rules"].astype("<u2").tobytes(), "rule_lengths": made["rule_lengths"].astype("<u4").tobytes(),
                   "rounds": made["rounds"], "width": width, "symbols": made["symbols"].astype(f"<u{width}").tobytes()}
            number, written, size = number + 1, written + size, 0
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()),
                            ("report_ids", pa.list_(pa.int64())), ("report_symbols", pa.list_(pa.int32())), ("terminals", pa.binary()),
                            ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("rounds", pa.list_(pa.int32())), ("width", pa.int32()),
                            ("symbols", pa.binary())])
        for ids, texts in steps(batches):
            for key, raw in zip(ids, texts):
                own = np.append(_ids(raw, path), np.uint32(end))
                keys.append(key)
                held.append(own)
                size += len(own)
                if size >= SHARD_IDS:
                    yield shard()
        if keys:
            yield shard()

    return write


def write_archive(reports: DataFrame, path: str, tokenizer: str, end: int = 0, report_id: str = "report_id", text: str = "text") -> None:
    """Writes the token ids of all reports below ``path``, in ascending order of their ids.

    A report's ids are those of the byte-level vocabulary file ``tokenizer`` for its whole text, then ``end``. Null text is
    empty; rows without an id are left out; rows that repeat an id are written each, in the order of a hash of their text. Other
    columns are not read. An empty table makes an empty archive.

    Format: ``path/shards``, one row per shard of about ``SHARD_IDS`` ids (a longer report is whole in one shard): its place
    (part, shard, part_start: ids before it in its part), the reports' ids and numbers of symbols, the grammar (terminals, rules
    as pairs of symbols, the number of ids each rule stands for, rules per round) and the symbols, little-endian binaries of
    ``width`` bytes a symbol. ``path/parts`` has the ids before each part (one row per range of ids).

    Reports are dealt into ranges of (id, hash of the text, input partition), so an id that many rows repeat is split; each
    task encodes and compresses its range, a shard at a time.
    """
    spark = reports.sparkSession
    rows = reports.select(F.col(report_id).cast("long").alias("report_id"), text_of(text).alias("text")).where("report_id IS NOT NULL")
    rows = rows.select("*", F.xxhash64("text").alias("mark"), F.spark_partition_id().alias("origin"))
    order = ["report_id", "mark", "origin"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("report_id", "text")
    sorted_rows.mapInArrow(_write(tokenizer, end), SHARDS).write.parquet(f"{path}/shards")
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    parts = shards.groupBy("part").agg(F.min(F.element_at("report_ids", 1)).alias("first_id"), F.sum("n_ids").alias("ids"))
    before = Window.orderBy("first_id", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before")).write.parquet(f"{path}/parts")


def _read(batches: Iterator):
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            kind = f"<u{row['width']}"
            grammar = Grammar(np.frombuffer(row["terminals"], "<u4"), np.frombuffer(row["rules"], "<u2"), np.frombuffer(row["rule_lengths"], "<u4"),
                              row["rounds"], np.frombuffer(row["symbols"], kind))
            stops = np.cumsum(row["report_symbols"])
            ids = grammar.expand(grammar.symbols).astype("<u4")
            sizes = np.add.reduceat(grammar.lengths[grammar.symbols], np.concatenate(([0], stops[:-1])))
            ends = np.cumsum(sizes)
            starts = ends - sizes
            whole = memoryview(ids).cast("B")
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["report_ids"], pa.int64()), pa.array(starts + row["ids_before"] + row["part_start"], pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array([bytes(whole[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                names=["report_id", "start", "n_tokens", "ids"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(report_id, start, n_tokens, ids) of every report of an archive: ``start`` is the number of ids of all reports before
    it, ``ids`` little-endian unsigned 32-bit integers, the end id included. Parts are read apart, a shard at a time."""
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    parts = spark.read.schema("part int, ids_before long").parquet(f"{path}/parts")
    return shards.join(parts, "part").select(*shards.columns, "ids_before").mapInArrow(_read, REPORTS)
