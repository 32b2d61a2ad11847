"""Hard negatives of feature rows: anchors are clustered, and every member walks its cluster's list of candidates in the
order of their angular upper bounds until no later row can matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import staged

#: Anchors of a group on average: what a task holds beside one batch of candidates.
GROUP_ANCHORS = 65_536
#: Clusters of a group's anchors, and the anchors they are fitted on at most.
CLUSTERS, FITTED = 16, 2048
#: Candidates that a member looks at between two looks at its bound.
STEP = 256
#: Share of a candidate's norm added to its bound: more than the rounding of angles.
MARGIN = 1e-6
NONE = -(1 << 62)
FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, found_score long"


def fit_clusters(units: np.ndarray) -> np.ndarray:
    """Unit centroids of at most ``FITTED`` evenly chosen unit vectors; only the length of walks depends on them."""
    some = units[np.linspace(0, len(units) - 1, min(FITTED, len(units))).astype(int)]
    centroids = some[np.random.default_rng(41).permutation(len(some))[:CLUSTERS]]
    for _ in range(8):
        nearest = (some @ centroids.T).argmax(1)
        sums = np.array([some[nearest == c].sum(0) for c in range(len(centroids))])
        sizes = np.sqrt((sums * sums).sum(1))
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1e-300)[:, None], centroids)
    return centroids


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, unit vectors); a zero vector stays zero."""
    norms = np.sqrt((vectors * vectors).sum(1))
    return norms, vectors / np.where(norms > 0, norms, 1)[:, None]


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors as int64; Python's integers where doubles would round."""
    most = (np.abs(one).max(initial=0) * np.abs(two).max(initial=0)) * one.shape[1]
    if most < 2**53:
        return (one @ two.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in two]
    return np.array([[sum(int(x) * y for x, y in zip(row, other)) for other in whole] for row in one], np.int64).reshape(len(one), len(two))


class Members:
    """The anchors of a group and their questions: of each, the ``k`` best candidates in [low, high] so far."""

    def __init__(self, ids: np.ndarray, outcomes: np.ndarray, vectors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray,
                 k: int, same: bool):
        self.ids, self.outcomes, self.vectors, self.owner, self.same = ids, outcomes, vectors, owner, same
        self.high = high
        self.floor = low.copy()  # a candidate below can no longer be among the k best
        self.low = low
        self.scores = np.full((len(owner), k), NONE, np.int64)
        self.found = np.full((len(owner), k), np.iinfo(np.int64).max, np.int64)
        self.norms, units = scaled(vectors)
        self.centroids = fit_clusters(units)
        cosines = units @ self.centroids.T
        self.cluster = cosines.argmax(1)
        own = np.where(self.norms > 0, np.arccos(np.clip(cosines[np.arange(len(ids)), self.cluster], -1, 1)), 0)
        self.width = np.zeros(len(self.centroids))
        np.maximum.at(self.width, self.cluster, own)

    def walk(self, ids: np.ndarray, outcomes: np.ndarray, vectors: np.ndarray) -> int:
        """Offers candidates to all questions, cluster by cluster in the order of the bound; returns the pairs looked at."""
        norms, units = scaled(vectors)
        angles = np.arccos(np.clip(units @ self.centroids.T, -1, 1))
        cluster_of, looked = self.cluster[self.owner], 0
        for c in np.unique(cluster_of):
            bound = norms * np.cos(np.maximum(angles[:, c] - self.width[c], 0)) + MARGIN * norms
            order = np.argsort(-bound, kind="stable")
            active = np.flatnonzero((cluster_of == c) & (self.floor <= self.high))
            for low in range(0, len(order), STEP):
                # certified: no row from here on can reach what the question has already found
                active = active[self.norms[self.owner[active]] * bound[order[low]] >= self.floor[active]]
                if not len(active):
                    break
                part = order[low : low + STEP]
                self.offer(active, ids[part], outcomes[part], vectors[part])
                looked += len(active) * len(part)
        return looked

    def offer(self, asked: np.ndarray, ids: np.ndarray, outcomes: np.ndarray, vectors: np.ndarray) -> None:
        anchors, at = np.unique(self.owner[asked], return_inverse=True)
        fits = ((self.outcomes[anchors][:, None] == outcomes[None, :]) == self.same) & (self.ids[anchors][:, None] != ids[None, :])
        scores = np.where(fits, products(self.vectors[anchors], vectors), NONE)[at]
        fits = (scores >= self.floor[asked][:, None]) & (scores <= self.high[asked][:, None]) & (scores > NONE)
        k = self.scores.shape[1]
        for row in np.flatnonzero(fits.any(1)):
            q, new = asked[row], np.flatnonzero(fits[row])
            all_scores, all_ids = np.append(self.scores[q], scores[row, new]), np.append(self.found[q], ids[new])
            best = np.lexsort((all_ids, -all_scores))[:k]
            self.scores[q], self.found[q] = all_scores[best], all_ids[best]
            self.floor[q] = max(self.low[q], self.scores[q, -1])


def _walk(k: int, same: bool, percents: tuple[int, int], scale: float):
    def vectors_of(batch, low: int, high: int) -> np.ndarray:
        column = batch.column(6).slice(low, high - low)
        return np.floor(scale * np.asarray(column.flatten(), np.float64)).reshape(high - low, -1)

    def members(parts: list[tuple]) -> Members:
        ids, outcomes = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        positives = [x for p in parts for x in p[3]]
        if same:
            owner, low, high = np.arange(len(ids)), np.full(len(ids), NONE), np.full(len(ids), -NONE)
        else:
            owner = np.repeat(np.arange(len(ids)), [len(p) for p in positives])
            scores = [p["positive_score"] for own in positives for p in own]
            low = np.array([-(-percents[0] * s // 100) for s in scores], np.int64)
            high = np.array([percents[1] * s // 100 for s in scores], np.int64)
        out = Members(ids, outcomes, np.concatenate([p[2] for p in parts]), owner, low, high, k, same)
        out.positives = [(p["positive_id"], p["positive_score"]) for own in positives for p in own] if not same else [(None, None)] * len(owner)
        return out

    def walk(batches: Iterator):
        import pyarrow as pa

        anchors: list[tuple] = []
        now, held = None, None

        def flush():
            if now is None:
                return None
            q, j = np.nonzero(now.scores > NONE)
            owners, positives = now.ids[now.owner[q]], [now.positives[x] for x in q]
            return pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), pa.array([p[0] for p in positives], pa.int64()), pa.array([p[1] for p in positives], pa.int64()),
                 pa.array(now.found[q, j], pa.int64()), pa.array(now.scores[q, j], pa.int64())],
                names=["anchor_id", "positive_id", "positive_score", "found_id", "found_score"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([np.asarray(batch.column(j)) for j in range(4)], 1)
            ids, outcomes = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            change = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for low, high in zip([0, *change], [*change, len(batch)]):
                key, kind = tuple(keys[low, :3].tolist()), int(keys[low, 3])
                if key != held:
                    if (out := flush()) is not None:
                        yield out
                    held, now, anchors = key, None, []
                part = (ids[low:high], outcomes[low:high], vectors_of(batch, low, high))
                if kind == 0:
                    anchors.append((*part, batch.column(7).slice(low, high - low).to_pylist()))
                    continue
                if now is None and anchors:
                    now, anchors = members(anchors), []
                if now is not None:
                    now.walk(*part)
        if (out := flush()) is not None:
            yield out

    return walk


def hard_negatives(rows: DataFrame, anchors: str = "row_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: float = 256.0, row_id: str = "row_id", features: str = "features", outcome: str = "outcome") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the feature rows that ``anchors`` selects.

    ``rows`` are feature rows of the panel, as of sector features: an id, the numeric features as an array, and the outcome to
    predict. ``anchors`` is a condition on row_id and outcome. Every feature x counts as floor(``scale`` x); the score of two
    rows is the inner product of these integers. A higher score comes first, of equal ones the smaller id. An anchor's positives are its
    first ``positives`` other rows of equal outcome; for each of them the first ``negatives`` rows of another outcome are
    returned whose score is between ``low`` and ``high`` per cent of the positive's. A positive without such a row, and an
    anchor without positives, gives no rows.

    Rows with a null id, outcome or array, an empty array, or a null or non-finite feature take no part; rows with arrays of different
    length never meet. Of rows that repeat an id the one of smallest (outcome, features) counts. Scores must fit 64 bits. Other
    columns are not read; an empty table, or one without anchors, gives no rows.

    The anchors of a group are clustered by direction. With the angle t between a candidate x and the centroid, and the
    largest angle w between the centroid and a member, no member m has a score above |m| |x| cos(max(0, t - w)). A cluster's
    list, cut into lanes, is sorted by that bound once in each lane; a member walks it until the bound is below the last
    score it keeps, which certifies that nothing is missed. Both walks are exact, so recall is 1.

    Spark deals candidates by id into lanes (about 8 sqrt(n) rows each) and anchors into groups of about ``GROUP_ANCHORS``: a lane
    holds its group's anchors and one batch of candidates at a time. Anchors are copied to every lane, candidates to every group; a
    lane returns at most the rows that a question may keep.
    """
    fine = (F.size("features") > 0) & F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(outcome).cast("long").alias("outcome"),
                         F.col(features).cast("array<double>").alias("features"))
    usable = usable.where("row_id IS NOT NULL AND outcome IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    one = usable.groupBy("row_id").agg(F.min(F.struct("outcome", "features")).alias("r"))
    one = staged(one.select("row_id", "r.*", F.size("r.features").alias("d")), "feature-rows")
    chosen = one.where(anchors)
    lanes = max(1, int(np.ceil(np.sqrt(one.count()) / 8)))
    groups = max(1, -(-chosen.count() // GROUP_ANCHORS))

    def walked(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """Rows found for ``asked``: anchors with an array of their positives."""
        key = F.pmod(F.xxhash64("row_id"), F.lit(lanes)).cast("int").alias("lane")
        group = F.pmod(F.xxhash64("row_id", F.lit("group")), F.lit(groups)).cast("int").alias("g")
        members = asked.select("d", group, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"),
                               "row_id", "outcome", "features", "positives")
        candidates = one.select("d", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), key, F.lit(1).alias("kind"),
                                "row_id", "outcome", "features", F.lit(None).cast(asked.schema["positives"].dataType).alias("positives"))
        dealt = members.unionByName(candidates).repartition("d", "g", "lane").sortWithinPartitions("d", "g", "lane", "kind")
        return dealt.mapInArrow(_walk(k, same, (low, high), scale), FOUND)

    pair = "array<struct<positive_id: bigint, positive_score: bigint>>"
    first = walked(chosen.withColumn("positives", F.lit(None).cast(pair)), positives, True)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("found_score"), "found_id"))
    nearest = first.select("anchor_id", "found_id", "found_score", place.alias("place")).where(F.col("place") <= positives)
    nearest = nearest.groupBy(F.col("anchor_id").alias("row_id")).agg(
        F.collect_list(F.struct(F.col("found_id").alias("positive_id"), F.col("found_score").alias("positive_score"))).alias("positives"))
    asked = staged(chosen.join(nearest, "row_id"), "anchors")
    second = walked(asked.select("d", "row_id", "outcome", "features", F.col("positives").cast(pair).alias("positives")), negatives, False)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("found_score"), "found_id"))
    ranked = second.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
                         F.col("found_score").alias("negative_score"))
