"""Packing of report token ids into training sequences: bounded-space best fit, then a merge of what is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import staged, steps
from panelwright.llm.memory import tidy
from panelwright.llm.word_tokens import word_encoder

PIECES = "report_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["report_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: A partition numbers its sequences below this.
SEQUENCES = 1 << 40
#: Left-over windows of so many partitions meet in one merge.
MERGED = 64


class OpenWindows:
    """At most ``windows`` open windows of ``capacity`` ids; pieces go where they fit best."""

    def __init__(self, windows: int, capacity: int):
        self.windows, self.capacity = windows, capacity
        self.open: list[list] = []  # [fill, pieces]

    def put(self, piece: tuple, size: int) -> list | None:
        """Places a piece of ``size`` ids whole; returns a window that is now complete, or None.

        Where none fits and all are open, the caller first cuts a piece that fills the fullest one.
        """
        best = min((w for w in self.open if w[0] + size <= self.capacity), key=lambda w: self.capacity - w[0], default=None)
        if best is None:
            best = [0, []]
            self.open.append(best)
        best[1].append((piece, best[0]))
        best[0] += size
        if best[0] == self.capacity:
            self.open.remove(best)
            return best[1]
        return None

    def room(self, size: int) -> int:
        """Ids that may be placed in one piece: all, or what the fullest window takes before it is emitted."""
        if len(self.open) < self.windows or any(w[0] + size <= self.capacity for w in self.open):
            return size
        return self.capacity - max(w[0] for w in self.open)


def _pack(path: str, end: int, capacity: int, windows: int):
    def pack(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, state, number = word_encoder(path), OpenWindows(windows, capacity), 0
        rows: list[tuple] = []

        def finish(pieces: list) -> None:
            nonlocal number
            rows.extend((*piece, task * SEQUENCES + number, offset, False) for piece, offset in pieces)
            number += 1

        def table():
            columns = list(zip(*rows)) or [[] for _ in range(8)]
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*COLUMNS, "left"])

        for keys, texts in steps(batches):
            for key, ids in zip(keys, encoder.encode([t.decode() for t in texts])):
                ids = np.append(ids, np.uint32(end))
                start = 0
                while start < len(ids):
                    size = min(len(ids) - start, capacity)
                    size = state.room(size)
                    piece = ids[start : start + size]
                    done = state.put((key, start, size, zlib.crc32(piece.astype("<u4").tobytes()), len(ids)), size)
                    if done:
                        finish(done)
                    start += size
            if rows:
                yield table()
                rows = []
        for fill, pieces in state.open:
            rows.extend((*piece, task * SEQUENCES + number, offset, True) for piece, offset in pieces)
            number += 1
        yield table()

    return pack


def _merge(capacity: int):
    def merge(key, rows):
        """Left-over windows, fullest first, each put where it fits best; a window stays whole."""
        rows = rows.sort_values(["sequence_id", "offset"])
        fills = rows.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
        targets: list[list] = []  # [fill, sequence id]
        moved = {}
        for number, fill in fills.items():
            best = min((t for t in targets if t[0] + fill <= capacity), key=lambda t: capacity - t[0], default=None)
            if best is None:
                best = [0, number]
                targets.append(best)
            moved[number] = (best[1], best[0])
            best[0] += fill
        rows["offset"] += rows["sequence_id"].map(lambda n: moved[n][1])
        rows["sequence_id"] = rows["sequence_id"].map(lambda n: moved[n][0])
        return rows[COLUMNS]

    return merge


def packed(reports: DataFrame, tokenizer: str, end: int = 2, capacity: int = 4096, windows: int = 16,
           report_id: str = "report_id", text: str = "text") -> DataFrame:
    """(report_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every report.

    A report's ids are those of the word vocabulary file ``tokenizer`` without special tokens, then ``end``; null text is
    empty, so its one id is ``end``. Every partition reads its reports once and keeps at most ``windows`` sequences open: a
    piece goes into the open sequence that it fits best; where none takes it and no more may be opened, the piece is cut to
    fill the fullest one, which is emitted without padding. What is left open at the end (at most ``windows`` sequences of a
    partition, as rows without ids) is merged over groups of 64 partitions, fullest first by best fit; the merge reads at most
    64 x ``windows`` sequences. Reports longer than ``capacity`` are cut. Rows without an id are left out; a repeated row
    is packed each time; an empty table gives an empty result. The pieces are written once in the shared folder.
    """
    rows = reports.select(F.col(report_id).cast("long").alias("report_id"), F.col(text).alias("text")).where("report_id IS NOT NULL")
    pieces = staged(rows.mapInArrow(tidy(_pack(tokenizer, end, capacity, windows)), PIECES + ", left boolean"), "pieces")
    group = F.floor(F.col("sequence_id") / F.lit(SEQUENCES * MERGED)).alias("merge_group")
    left = pieces.where("left").drop("left").groupBy(group).applyInPandas(_merge(capacity), PIECES)
    return pieces.where("NOT left").drop("left").unionByName(left)
