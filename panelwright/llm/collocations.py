"""Collocations of report texts: padded longest windows are counted once, ROLLUP adds them up to all shorter phrases."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import staged, steps

#: The signs and line ends that end a piece. Words are what spaces and tabs leave of it.
PIECE_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_LOWER = bytes(range(256)).lower()
#: Distinct windows that a task counts before it hands them over.
HELD = 400_000
#: Buckets in which windows are shuffled: so many by the first word, times so many by the second.
BY_FIRST, BY_SECOND = 1024, 16
#: Counted windows that a task hands over at a time, about.
ROWS = 50_000


def _windows(longest: int):
    def count(batches: Iterator):
        """Counted windows, many to a row: lines of (head, last word, count) that share a language and a bucket."""
        import pyarrow as pa

        held: dict[str, Counter] = {}

        def table():
            rows: tuple[list, list, list] = ([], [], [])
            for lang, counted in held.items():
                lines: dict[int, list[bytes]] = {}
                for window, c in counted.items():
                    second = window[1] if longest > 2 else b""  # all windows with one head share a bucket
                    bucket = zlib.crc32(window[0]) % BY_FIRST * BY_SECOND + zlib.crc32(second) % BY_SECOND
                    lines.setdefault(bucket, []).append(b"%b\t%b\t%d" % (b" ".join(window[:-1]).rstrip(b" "), window[-1], c))
                for bucket, own in lines.items():
                    rows[0].append(lang)
                    rows[1].append(bucket)
                    rows[2].append(b"\n".join(sorted(own)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()).cast(pa.string())],
                                              names=["lang", "bucket", "lines"])

        pads = [[b""] * k for k in range(longest)]
        for langs, texts in steps(batches):
            for lang, text in zip(langs, texts):
                counted = held.setdefault(lang, Counter())
                for piece in PIECE_ENDS.split(text.translate(_LOWER)):
                    words = piece.split()
                    counted.update(zip(words, *(words[k:] + pads[k] for k in range(1, longest))))
            if sum(map(len, held.values())) > HELD:
                yield table()
        yield table()

    return count


def _counts(longest: int, min_count: int):
    def add(batches: Iterator):
        """Rows (lang, w1 .., c) of packed windows in order of bucket and language: one bucket of a language is held at a time."""
        import pyarrow as pa

        rows: list[list] = [[] for _ in range(longest + 2)]

        def table():
            columns = [pa.array(rows[0], pa.string()), *(pa.array(r, pa.binary()).cast(pa.string()) for r in rows[1:-1]), pa.array(rows[-1], pa.int64())]
            for r in rows:
                r.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", *(f"w{k}" for k in range(1, longest + 1)), "c"])

        def close(lang, counted: dict[bytes, int]):
            totals: dict[bytes, int] = {}
            split: dict[bytes, list] = {}  # by head: what is left of it, and its frequent last words
            for window, c in counted.items():
                head, _, last = window.partition(b"\t")
                totals[head] = totals.get(head, 0) + c
                if last and c >= min_count:
                    split.setdefault(head, []).append((last, c))
            shorter: dict[tuple, int] = {}
            for head, total in totals.items():
                words = head.split(b" ")
                words += [None] * (longest - 1 - len(words))
                if total < min_count:
                    words[-1] = None
                rest = total
                for last, c in split.get(head, ()):
                    rest -= c
                    for column, value in zip(rows, (lang, *words, last, c)):
                        column.append(value)
                if rest:
                    key = tuple(words)
                    shorter[key] = shorter.get(key, 0) + rest
            for words, c in shorter.items():
                for column, value in zip(rows, (lang, *words, None, c)):
                    column.append(value)

        now, counted = None, {}
        for batch in batches:
            for lang, bucket, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if (lang, bucket) != now:
                    if now:
                        close(now[0], counted)
                    now, counted = (lang, bucket), {}
                    if len(rows[0]) >= ROWS:
                        yield table()
                for line in lines.split(b"\n"):
                    window, _, c = line.rpartition(b"\t")
                    counted[window] = counted.get(window, 0) + int(c)
        if now:
            close(now[0], counted)
        yield table()

    return add


def longest_windows(reports: DataFrame, min_count: int, longest: int = 3, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, w1 .. w``longest``, c): how often each word stands before the words that follow it in its piece.

    Every word occurrence gives one window, itself and its ``longest`` - 1 successors (lead columns: the piece's words moved
    by one, two, ... places); where the piece ends earlier the rest is null. A last word is null too where the
    window occurs less than ``min_count`` times, and the one before it where all windows with that head do: such phrases are no
    candidates, and the sums of shorter prefixes stay what they are.

    A task counts its windows in bounded portions and hands them over many to a row, dealt by the first two words, so that
    whole windows and their heads are counted in one shuffle and repeated windows are combined before it. Sorted by bucket, they are
    added up a bucket at a time and cut before they are rows of their own.
    """
    rows = reports.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    packed = rows.mapInArrow(_windows(longest), "lang string, bucket int, lines string").repartition("bucket", "lang").sortWithinPartitions("bucket", "lang")
    names = [f"w{k}" for k in range(1, longest + 1)]
    named = packed.mapInArrow(_counts(longest, min_count), f"lang string, {', '.join(f'{w} string' for w in names)}, c long")
    return named.groupBy("lang", *names).agg(F.sum("c").alias("c"))


def phrase_counts(windows: DataFrame, min_count: int) -> DataFrame:
    """(lang, size, phrase, c) of all phrases with at least ``min_count`` occurrences, and (lang, 0, '', all words)."""
    names = [c for c in windows.columns if c.startswith("w")]
    listed = ", ".join(names)
    rolled = windows.sparkSession.sql(
        f"""SELECT lang, {listed}, {len(names)} - bit_count(grouping_id()) AS size, sum(c) AS c
        FROM {{windows}} GROUP BY lang, ROLLUP({listed})""", windows=windows)
    whole = F.when(F.col("size") == 0, True).otherwise(F.element_at(F.array(*names), F.greatest(F.col("size"), F.lit(1))).isNotNull())
    frequent = rolled.where(((F.col("size") == 0) | (F.col("c") >= min_count)) & whole)
    return frequent.select("lang", "size", F.concat_ws(" ", *names).alias("phrase"), "c")


def collocations(reports: DataFrame, min_count: int = 10, longest: int = 3, covered: int = 50, top: int = 2000,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` collocations of the report pages of every language.

    A-Z is lower-cased; a text is cut into pieces at ``.,;:!?`` and line ends, a piece into words at spaces and tabs.
    Phrases are 2 to ``longest`` words of one piece that occur ``min_count`` times or more, overlaps included (a). A cut after the
    first k words gives l and r, the occurrences of both parts; its score is floor(1000000 a a / (l r)), in exact decimal
    arithmetic for counts below 10**15. The cut of the lowest score counts, of equal ones that of the smallest k. A phrase
    goes if a longer one that contains it occurs at least ``covered`` per cent as often. Ranks order by score and a,
    highest first, then by the phrase's bytes; n counts all words of the language.

    Null texts are empty and have no words, a null language is 'und'; repeated rows count each time; ids and other columns are not read, so they
    may clash with no name here. An empty table, or a language without a frequent phrase, gives no rows.

    Only windows of the longest order are counted from texts (``longest_windows``); a ROLLUP over their word columns gives every
    shorter phrase as a prefix sum. Counts are combined before each shuffle, so a hot word or phrase is a row per task portion. All
    counts that a candidate needs are at least its own, so only frequent phrases are kept. Joins to the parts are many-to-one (AQE splits
    those of a hot word); the top list is cut per task before a language's rows meet.
    """
    counts = staged(phrase_counts(longest_windows(reports, min_count, longest, text, lang), min_count), "phrases")
    phrases = counts.where("size >= 2").select("lang", "size", "phrase", F.col("c").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    parts = counts.where(f"size BETWEEN 1 AND {longest - 1}")
    scored = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    scored = scored.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
    wide = {c: f"CAST({c} AS DECIMAL(15, 0))" for c in "alr"}
    scored = scored.withColumn("score", F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide['a']} * {wide['a']})) DIV ({wide['l']} * {wide['r']})"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r")
    words = F.split("phrase", " ")
    inner = phrases.where("size > 2").select("lang", "a", "size", words.alias("words"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.expr("array_join(slice(words, at, length), ' ')").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {int(covered)} * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", F.col("c").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
