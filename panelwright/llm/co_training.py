"""Quality of reports by co-training: a text view and a page view teach each other on unlabelled reports."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import staged, steps
from panelwright.llm.features import logistic, ngram_matrix, scores, shape_figures, sigmoid, word_figures
from panelwright.llm.memory import give_back
from panelwright.session import materialized

if TYPE_CHECKING:
    import pyarrow as pa

#: Hashed n-grams of the text view (a power of two), and places for source and language names in the page view.
GRAMS, NAMES = 1024, 32
#: Labelled reports in the training sample, and reports without a label that share in the views' means and deviations.
LABELLED, POOL = 2500, 2500
ROUNDS = 3
#: Pseudo-labels that a view gives the other in a round, as shares of all reports without a label: poor ones and good ones.
POOR, GOOD = 0.02, 0.10
#: Of those at most ``POOR * TAUGHT`` and ``GOOD * TAUGHT`` train the other view.
TAUGHT = 5000
#: Raw scores are counted in steps of 1 / STEP; chances are counted in millionths.
STEP, LUCK = 64, 1_000_000
FEATURE_ROWS = "label int, content binary, page binary"


def _hashed(name: str | None, size: int) -> int:
    import zlib

    return zlib.crc32((name or "").encode()) % size


def views(keys: list[tuple], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text view, page view): what the words say, and what page data and layout say."""
    content = np.column_stack([3 * ngram_matrix(texts, GRAMS, False), word_figures(texts)]).astype(np.float32)
    names = np.zeros((len(texts), NAMES))
    for k, key in enumerate(keys):
        names[k, _hashed(key[1], NAMES - 8)] = 1
        names[k, NAMES - 8 + _hashed(key[2], 8)] = 1
    told = np.log1p(np.array([max(0, key[3] or 0) for key in keys], float)).reshape(-1, 1)
    return content, np.column_stack([0.3 * names, told, shape_figures(texts)]).astype(np.float32)


class View:
    """A standardised logistic model with a Platt calibration."""

    def __init__(self, rows: np.ndarray):
        self.mean, self.scale = rows.mean(0), np.maximum(rows.std(0), 1e-3)
        self.model, self.slope, self.shift = None, 1.0, 0.0

    def ready(self, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        out = np.subtract(rows, self.mean, out=out)
        out /= self.scale
        return np.clip(out, -8, 8, out=out)

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> None:
        """``rows`` are standardised in place."""
        weights = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
        self.model = logistic(self.ready(rows, rows), labels[:, None].astype(np.float32), weights, penalty=3e-3)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return scores(self.ready(rows), self.model)[:, 0]

    def calibrate(self, rows: np.ndarray, labels: np.ndarray) -> None:
        fitted = logistic(self.raw(rows)[:, None] / 4, labels[:, None].astype(np.float32), np.ones(len(labels)), penalty=1e-4, rounds=400)
        if fitted[0, 0] > 0:
            self.slope, self.shift = float(fitted[0, 0]) / 4, float(fitted[1, 0])

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(rows) + self.shift


def places(raw: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(raw, -1e6, 1e6) * STEP).astype(np.int32)


def cut_offs(counts: dict[int, int], poor: float, good: float) -> tuple[int, int, int, int]:
    """(place, luck) below which ``poor`` reports of raw score under -1 lie, and (place, luck) above which ``good`` over 1 lie; of
    the reports at a place itself those with less luck are taken."""
    def cut(found: list[int], wanted: float, last: int) -> tuple[int, int]:
        for place in found:
            if counts[place] >= wanted:
                return place, int(LUCK * wanted / counts[place])
            wanted -= counts[place]
        return last, 0

    return *cut(sorted(k for k in counts if k < -STEP), poor, -STEP), *cut(sorted((k for k in counts if k >= STEP), reverse=True), good, STEP - 1)


def taken(place, luck, cut: tuple[int, int, int, int]) -> tuple:
    """Whether a view takes a report as poor, and as good; of columns or arrays."""
    low, low_luck, high, high_luck = cut
    return (place < low) | ((place == low) & (luck < low_luck)), (place > high) | ((place == high) & (luck < high_luck))


def _free(spread):
    """Places of both views' scores, of the reports that no view took in an earlier round."""
    def free(batches: Iterator):
        import pyarrow as pa

        sides, before = pickle.loads(spread.value)
        for keys, texts in steps(batches, 5):
            both = views(keys, texts)
            luck, free = np.array([k[4] for k in keys]), np.ones(len(texts), bool)
            for old, cuts in before:
                for view, rows, cut in zip(old, both, cuts):
                    poor, good = taken(places(view.raw(rows)), luck, cut)
                    free &= ~(poor | good)
            one, two = (places(view.raw(rows)) for view, rows in zip(sides, both))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([k[0] for k in keys], np.int64)[free]), pa.array(luck[free].astype(np.int32)), pa.array(one[free]), pa.array(two[free])],
                names=["report_id", "luck", "one", "two"])

    return free


def exchange(unlabelled: DataFrame, sides: list[View], before: list, n: int) -> tuple[list, pa.Table | None, int]:
    """(cut-offs of both views, the bounded sample of what they took, reports without a label) of a round over all of ``unlabelled``.

    ``before`` has views and cut-offs of the rounds before; ``n`` is the number of reports, 0 in the first round.
    """
    spark = unlabelled.sparkSession
    spread = spark.sparkContext.broadcast(pickle.dumps((sides, before)))
    left = materialized(unlabelled.select("report_id", "source", "lang", "n_chars", F.pmod(F.xxhash64("report_id"), F.lit(LUCK)).alias("luck"), "text").mapInArrow(
        _free(spread), "report_id long, luck int, one int, two int"))
    cuts, label, rest = [], F.lit(None).cast("int"), left
    for k, name in enumerate(("one", "two")):
        counts = {r[name]: r["count"] for r in rest.groupBy(name).count().collect()}
        n = n or sum(counts.values())
        cuts.append(cut_offs(counts, POOR * n, GOOD * n))
        poor, good = taken(F.col(name), F.col("luck"), cuts[-1])
        label = F.coalesce(label, F.when(poor, 2 * (1 - k)).when(good, 2 * (1 - k) + 1))  # the view that is taught, and what
        rest = left.where(label.isNull())
    most = F.when(F.col("label") % 2 == 0, int(POOR * TAUGHT)).otherwise(int(GOOD * TAUGHT))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("report_id", F.lit("lesson")), "report_id"))
    # a task sends a label's first ones only
    some = left.select("report_id", label.alias("label")).where("label IS NOT NULL").distinct().withColumn("place", place)
    picks = some.where((F.col("place") <= int(max(POOR, GOOD) * TAUGHT)) & (F.col("place") <= most)).select("report_id", "label").collect()
    if not picks:
        return cuts, None, n
    chosen = spark.createDataFrame(picks, "report_id long, label int")
    return cuts, unlabelled.join(F.broadcast(chosen), "report_id").select("label", "source", "lang", "n_chars", "text").mapInArrow(_featured, FEATURE_ROWS).toArrow(), n


def co_train(sides: list[View], content: np.ndarray, page: np.ndarray, labels: np.ndarray, unlabelled: DataFrame) -> tuple[View, View]:
    """Both views, scaled before, after ``ROUNDS`` rounds over ``unlabelled``. A fifth of the labelled rows calibrates and trains nothing."""
    fold = np.arange(len(labels)) % 5 == 0
    if len(set(labels[fold])) < 2 or len(set(labels[~fold])) < 2:
        fold = np.zeros(len(labels), bool)
    rows, names = (content, page), ("content", "page")
    extra: list[tuple[list, list]] = [([], []), ([], [])]  # rows and labels that a view was taught
    before: list[tuple[list, list]] = []
    n = 0
    for turn in range(ROUNDS + 1):
        for view, own, (more, given) in zip(sides, rows, extra):
            view.fit(np.vstack([own[~fold], *more]), np.concatenate([labels[~fold], *given]))
        if turn == ROUNDS:
            break
        cuts, lessons, n = exchange(unlabelled, sides, before, n)
        if lessons is None:
            break
        before.append(([copy.copy(view) for view in sides], cuts))
        order = ordered(lessons, "label", "content", "page")
        given = lessons["label"].to_numpy()[order]
        for k, name in enumerate(names):
            own = given // 2 == k
            if own.any():
                extra[k][0].append(matrix(lessons[name], order[own]))
                extra[k][1].append((given[own] % 2).astype(labels.dtype))
        lessons = None
        give_back()
    check = fold if fold.any() else ~fold
    for view, own in zip(sides, rows):
        view.calibrate(own[check], labels[check])
    return sides[0], sides[1]


def ordered(table: pa.Table, *names: str) -> np.ndarray:
    """Places of the table's rows in the order of these columns; of equal ones the first first."""
    import pyarrow.compute as pc

    return pc.sort_indices(table, sort_keys=[(name, "ascending") for name in names]).to_numpy()


def matrix(column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """The rows at these places, of a column that ``_featured`` gave; they are copied once, straight from Arrow's memory."""
    at = np.full(len(column), -1)
    at[order] = np.arange(len(order))
    out, first = None, 0
    for chunk in column.chunks:
        if len(chunk):
            bounds = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            rows = np.frombuffer(chunk.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.float32).reshape(len(chunk), -1)
            out = np.empty((len(order), rows.shape[1]), np.float32) if out is None else out
            to = at[first : first + len(chunk)]
            out[to[to >= 0]] = rows[to >= 0]
            first += len(chunk)
    return out


def _featured(batches: Iterator):
    import pyarrow as pa

    for keys, texts in steps(batches, 4):
        content, page = views(keys, texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([r.tobytes() for r in content], pa.binary()), pa.array([r.tobytes() for r in page], pa.binary())],
            names=["label", "content", "page"])


def _score(spread, threshold: float):
    def score(batches: Iterator):
        import pyarrow as pa

        sides, share = pickle.loads(spread.value)
        for keys, texts in steps(batches, 4):
            if sides:
                content, page = views(keys, texts)
                one, two = sides[0].log_odds(content), sides[1].log_odds(page)
            else:
                one = two = np.full(len(texts), share)
            both = sigmoid((one + two) / 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array(sigmoid(one)), pa.array(sigmoid(two)), pa.array(both), pa.array(both >= threshold if sides else np.ones(len(texts), bool))],
                names=["report_id", "text_score", "page_score", "score", "kept"])

    return score


def co_trained_quality(reports: DataFrame, labels: DataFrame, threshold: float = 0.5, report_id: str = "report_id", text: str = "text",
                       source: str = "source", lang: str = "lang", n_chars: str = "n_chars", quality: str = "quality") -> DataFrame:
    """(report_id, text_score, page_score, score, kept) of every report with an id; score is the chance of good quality.

    ``labels`` has (report_id, quality 0/1) for some reports; null or other values and ids without a report teach nothing, nor do they
    take places in the sample. Of labels that contradict each other the smaller counts.
    The text view holds hashed n-grams and word repetition; the page view holds source, language, stated length and layout. Both are
    fitted on at most ``LABELLED`` labelled reports; in ``ROUNDS`` rounds each then labels the surest of all reports outside that
    sample for the other view, which is fitted on at most ``TAUGHT`` times the shares of them. A held-back fifth of the labelled reports calibrates both. ``score`` is the mean of the two
    log odds; reports of at least ``threshold`` are kept. With labels of one kind or none, all are kept and have score
    0.5. Null texts and page data are empty or 0. Repeated rows are returned each time; an empty table gives an empty result.

    Only samples (``LABELLED`` + ``POOL`` rows of 5 KB and fewer than ``TAUGHT`` taught ones, chosen by hashes of the ids) and counts of
    scores reach the driver, as Arrow batches; it holds each of them once; every round and the scoring are a pass each.
    """
    spark = reports.sparkSession
    rows = reports.select(F.col(report_id).cast("long").alias("report_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
                          F.col(n_chars).cast("long").alias("n_chars"), F.col(text).alias("text")).where("report_id IS NOT NULL")
    given = labels.select(F.col(report_id).cast("long").alias("report_id"), F.col(quality).cast("int").alias("label")).where("report_id IS NOT NULL AND label IN (0, 1)")
    given = given.groupBy("report_id").agg(F.min("label").alias("label")).join(rows.select("report_id"), "report_id", "left_semi")
    # each class gets half of the sample if it has so many
    some = given.where("label = 0").orderBy(F.xxhash64("report_id")).limit(LABELLED // 2).unionByName(
        given.where("label = 1").orderBy(F.xxhash64("report_id")).limit(LABELLED // 2))
    some = staged(some, "labelled")  # every round passes over it
    n = max(1, rows.count())
    marked = rows.join(F.broadcast(some), "report_id", "left")  # at most LABELLED rows
    lucky = F.pmod(F.xxhash64("report_id", F.lit("pool")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, POOL / n))
    sample = marked.where(F.col("label").isNotNull() | lucky).groupBy("report_id").agg(
        F.min(F.struct("label", "source", "lang", "n_chars", "text")).alias("r")).select("r.*")  # an id may stand on many rows
    sample = sample.mapInArrow(_featured, FEATURE_ROWS).toArrow()
    order = ordered(sample, "content", "page")[np.random.default_rng(5).permutation(len(sample))]
    label = sample["label"].fill_null(-1).to_numpy()[order]
    model = ((), 0.0)
    if {0, 1} <= set(label.tolist()):
        order = order[np.argsort(label < 0, kind="stable")]  # the labelled ones first
        shown, told = label[label >= 0].astype(int), []
        sides = []
        for name in ("content", "page"):
            whole = matrix(sample[name], order)
            sample = sample.drop_columns([name])
            sides.append(View(whole))
            told.append(whole[: len(shown)].copy())
            whole = None
            give_back()
        sample = None
        model = (co_train(sides, *told, shown, rows.join(F.broadcast(some.select("report_id")), "report_id", "left_anti")), 0.0)
    spread = spark.sparkContext.broadcast(pickle.dumps(model))
    sample = sides = told = model = None
    give_back()  # the driver holds on to nothing of the sample
    return rows.select("report_id", "source", "lang", "n_chars", "text").mapInArrow(
        _score(spread, threshold), "report_id long, text_score double, page_score double, score double, kept boolean")
