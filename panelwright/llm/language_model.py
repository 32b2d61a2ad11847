"""Log-likelihood of whole report texts under a gated recurrent language model with class-factored output."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import crc_remainder, mixed, staged, steps, words

#: Words the network knows, in classes of equal size (the first two: all other words, and the end of a text).
KNOWN, CLASS = 1024, 32
HIDDEN = 16
#: Commonest words whose counts every task holds (1 MB); the counts of all others are joined by word.
COMMON = 1 << 16
#: Texts read side by side, and words between two truncations of the gradient.
LANES, WINDOW = 256, 32
#: Training reports of a shard (their number grows with the corpus), and the rounds in which the shards' networks are averaged:
#: every training report is read once, in one of the rounds.
SHARD, AVERAGES = 16_000, 4
#: Texts that a shard reads side by side: an eighth of those it has, within these bounds.
NARROW, WIDE = 16, 128
END = np.uint64(0x5851F42D4C957F2D)
OTHER_ID, END_ID = 0, 1
_COUNT = np.dtype([("word", "<u8"), ("count", "<i8")])
_USE = np.dtype([("word", "<u8"), ("row", "<i8"), ("times", "<i4")])
_SUM = np.dtype([("row", "<i8"), ("logs", "<f8"), ("known", "<i8")])
#: Distinct words a task holds before it hands over its counts.
HELD = 1 << 20


# ---- corpus counts -----------------------------------------------------------------------------------------------

def _blobs(records: np.ndarray, groups: np.ndarray):
    """A record batch (part, records): the records of each group as one binary value."""
    import pyarrow as pa

    order = np.argsort(groups, kind="stable")
    cut = np.flatnonzero(np.diff(groups[order])) + 1
    pieces = np.split(records[order], cut) if len(records) else []
    parts = groups[order][np.concatenate(([0], cut))] if len(records) else []
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["part", "records"])


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(parts)).astype(np.int32)


def merged(records: np.ndarray) -> np.ndarray:
    """One record per word with the sum of its counts."""
    records = records[np.argsort(records["word"], kind="stable")]
    if not len(records):
        return records
    first = np.flatnonzero(np.concatenate(([True], records["word"][1:] != records["word"][:-1])))
    out = records[first].copy()
    out["count"] = np.add.reduceat(records["count"], first)
    return out


def _counts(parts: int):
    def count(batches: Iterator):
        held, size = [], 0
        for _, texts in steps(batches):
            hashes, _ = words(texts)
            distinct, times = np.unique(np.append(hashes, np.full(len(texts), END)), return_counts=True)
            new = np.empty(len(distinct), _COUNT)
            new["word"], new["count"] = distinct, times
            held.append(new)
            size += len(new)
            if size > HELD:
                held = [merged(np.concatenate(held))]
                size = len(held[0])
                if size > HELD:
                    yield _blobs(held[0], _part(held[0]["word"], parts))
                    held, size = [], 0
        if held:
            whole = merged(np.concatenate(held))
            yield _blobs(whole, _part(whole["word"], parts))

    return count


def _joined_counts(batches: Iterator):
    """Rows come sorted by part; the counts of one part are added up as they come."""
    import pyarrow as pa

    part, held = None, []

    def out():
        whole = merged(np.concatenate(held))
        top = whole[np.argsort(-whole["count"], kind="stable")[:COMMON]]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([whole.tobytes()], pa.binary()), pa.array([len(whole)], pa.int64()), pa.array([int(whole["count"].sum())], pa.int64()),
             pa.array([top.tobytes()], pa.binary())], names=["part", "records", "distinct", "total", "top"])

    for batch in batches:
        for now, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if now != part and held:
                yield out()
                held = []
            part = now
            held.append(np.frombuffer(blob.as_py(), _COUNT))
            if len(held) > 64:
                held = [merged(np.concatenate(held))]
    if held:
        yield out()


def _tops(batches: Iterator):
    import pyarrow as pa

    for batch in batches:
        for blob in batch.column(0):
            top = np.frombuffer(blob.as_py(), _COUNT)
            yield pa.RecordBatch.from_arrays([pa.array(top["word"].view(np.int64)), pa.array(top["count"])], names=["word", "n"])


# ---- the network -------------------------------------------------------------------------------------------------

def new_network(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "inputs": (0.05 * rng.standard_normal((KNOWN, 3 * HIDDEN))).astype(np.float32),
        "recur": (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / math.sqrt(HIDDEN)).astype(np.float32),
        "classes": np.zeros((HIDDEN, KNOWN // CLASS), np.float32), "class_bias": np.zeros(KNOWN // CLASS, np.float32),
        "within": np.zeros((KNOWN // CLASS, HIDDEN, CLASS), np.float32), "within_bias": np.zeros((KNOWN // CLASS, CLASS), np.float32),
    }


def class_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, place in it): each class holds words of like frequency; ids follow the frequency."""
    return ids // CLASS, ids % CLASS


def _gates(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def run_window(net: dict, ids: np.ndarray, state: np.ndarray, fresh: np.ndarray):
    """States [time, lane, HIDDEN] of a training window, the state after it, and what the way back needs."""
    sized = lambda width: np.empty((*ids.shape, width), net["recur"].dtype)
    out, before, gates, cand, inner = sized(HIDDEN), sized(HIDDEN), sized(2 * HIDDEN), sized(HIDDEN), sized(HIDDEN)
    x, on, h = net["inputs"][ids], ~fresh[:, :, None], state
    for t in range(len(ids)):
        np.multiply(h, on[t], out=before[t])
        u = before[t] @ net["recur"]
        gates[t] = _gates(x[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        r, z, inner[t] = gates[t, :, :HIDDEN], gates[t, :, HIDDEN:], u[:, 2 * HIDDEN :]
        n = cand[t] = np.tanh(x[t, :, 2 * HIDDEN :] + r * inner[t])
        h = out[t] = n + z * (before[t] - n)
    return out, h, (before, gates[:, :, :HIDDEN], gates[:, :, HIDDEN:], cand, inner)


#: Steps of a rounded state, and of a rounded matrix up to its largest entry. With 16 terms a product's sum has at most 24 bits: single
#: precision holds it exactly, in whatever order it is added.
STEPS_OF_ONE = 1 << 10
_ROUNDS = np.float32(1.5 * 2**23 / STEPS_OF_ONE)  # adding and taking away rounds to these steps


def rounded_matrix(w: np.ndarray) -> np.ndarray:
    """``w`` in steps of a power of two, at most ``STEPS_OF_ONE`` of them on each side of zero."""
    most = float(np.abs(w).max(initial=0))
    step = 2.0 ** math.ceil(math.log2(most)) / STEPS_OF_ONE if most else 1.0
    return (np.rint(w.astype(np.float64) / step) * step).astype(np.float32)


class Reader:
    """Scores windows of a fixed number of lanes in arrays made once.

    Products are taken of rounded states and rounded matrices, which makes them exact: what a text scores depends neither on the
    texts beside it nor on its lane.
    """

    STEPS = 64

    def __init__(self, net: dict, width: int):
        self.net, self.width = net | {k: rounded_matrix(net[k]) for k in ("recur", "classes", "within")}, width
        sized = lambda *shape: np.empty(shape, np.float32)
        self.x, self.u, self.gates = sized(width, 3 * HIDDEN), sized(width, 3 * HIDDEN), sized(width, 2 * HIDDEN)
        self.n, self.out = sized(width, HIDDEN), sized(self.STEPS, width, HIDDEN)
        self.logits, self.rows = sized(self.STEPS * width, KNOWN // CLASS), sized(self.STEPS * width, HIDDEN)
        self.within = sized(self.STEPS * width, CLASS)
        self.state, self.rounded = np.zeros((width, HIDDEN), np.float32), np.zeros((width, HIDDEN), np.float32)

    def hidden(self, ids: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Rounded states of a window; ``self.state`` goes on from the window before."""
        begins, h, x, u, gates, n, near = fresh.any(1), self.state, self.x, self.u, self.gates, self.n, self.rounded
        for t in range(len(ids)):
            if begins[t]:
                h[fresh[t]] = near[fresh[t]] = 0
            np.take(self.net["inputs"], ids[t], 0, out=x, mode="clip")
            np.dot(near, self.net["recur"], out=u)
            np.add(x[:, : 2 * HIDDEN], u[:, : 2 * HIDDEN], out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[:, :HIDDEN], u[:, 2 * HIDDEN :], out=n)
            n += x[:, 2 * HIDDEN :]
            np.tanh(n, out=n)
            h -= n
            h *= gates[:, HIDDEN:]
            h += n
            np.add(h, _ROUNDS, out=near)
            near -= _ROUNDS
            self.out[t] = near
        return self.out[: len(ids)]

    def logs(self, hidden: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of P(class | state) * P(word | class, state) of every place [time, lane]."""
        flat, goal = hidden.reshape(-1, HIDDEN), targets.ravel()
        group, place = class_of(goal)
        rows = np.arange(len(flat))
        logits = np.dot(flat, self.net["classes"], out=self.logits[: len(flat)])
        logits += self.net["class_bias"]
        picked = logits[rows, group].astype(np.float64)
        np.exp(np.minimum(logits, 80, out=logits), out=logits)
        out = picked - np.log(logits.sum(1))
        order = np.argsort(group.astype(np.int8), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(KNOWN // CLASS + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[c] : cuts[c + 1]]
            inner = np.dot(np.take(flat, part, 0, out=self.rows[: len(part)], mode="clip"), self.net["within"][c], out=self.within[: len(part)])
            inner += self.net["within_bias"][c]
            picked = inner[rows[: len(part)], place[part]].astype(np.float64)
            np.exp(np.minimum(inner, 80, out=inner), out=inner)
            out[part] += picked - np.log(inner.sum(1))
        return out


def _surprise(logits: np.ndarray, goal: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of a softmax over all rows, and its slope by the logits, in their array."""
    rows = np.arange(len(goal))
    picked = logits[rows, goal].sum(dtype=np.float64)
    np.exp(np.minimum(logits, 80, out=logits), out=logits)
    total = logits @ np.ones((logits.shape[1], 1), logits.dtype)
    logits /= total
    logits[rows, goal] -= 1
    return float(np.log(total).sum(dtype=np.float64) - picked), logits


def gradients(net: dict, ids: np.ndarray, targets: np.ndarray, live: np.ndarray, state: np.ndarray, fresh: np.ndarray):
    """(loss per word, gradients, state after) of one window, back through this window only."""
    hidden, after, kept = run_window(net, ids, state, fresh)
    slope = np.zeros_like(hidden.reshape(-1, HIDDEN))
    use = np.flatnonzero(live.ravel())
    n = max(1, len(use))
    grads = {k: np.zeros_like(v) for k, v in net.items()}
    # rows in the order of their target's class, so that every class is one slice
    group, place = class_of(targets.ravel()[use])
    order = np.argsort(group.astype(np.int8), kind="stable")
    use, group, place = use[order], group[order], place[order]
    rows = hidden.reshape(-1, HIDDEN)[use]
    loss, d = _surprise(rows @ net["classes"] + net["class_bias"], group)
    grads["classes"], grads["class_bias"] = rows.T @ d / n, d.sum(0) / n
    told = d @ net["classes"].T
    cuts = np.searchsorted(group, np.arange(KNOWN // CLASS + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[c], cuts[c + 1])
        more, d = _surprise(rows[part] @ net["within"][c] + net["within_bias"][c], place[part])
        loss += more
        grads["within"][c], grads["within_bias"][c] = rows[part].T @ d / n, d.sum(0) / n
        told[part] += d @ net["within"][c].T
    slope[use] = told / n
    slope = slope.reshape(hidden.shape)
    before, r, z, cand, inner = kept
    to_cand, to_z, to_r = (1 - z) * (1 - cand * cand), (before - cand) * z * (1 - z), inner * r * (1 - r)
    shape = (*ids.shape, 3 * HIDDEN)
    to_inputs, to_recur, goes_on = np.empty(shape, slope.dtype), np.empty(shape, slope.dtype), ~fresh[:, :, None]
    back, turned = np.zeros_like(state), np.ascontiguousarray(net["recur"].T)
    for t in range(len(ids) - 1, -1, -1):
        g = slope[t] + back
        dn = to_inputs[t, :, 2 * HIDDEN :] = g * to_cand[t]
        to_inputs[t, :, :HIDDEN] = to_recur[t, :, :HIDDEN] = dn * to_r[t]
        to_inputs[t, :, HIDDEN : 2 * HIDDEN] = to_recur[t, :, HIDDEN : 2 * HIDDEN] = g * to_z[t]
        to_recur[t, :, 2 * HIDDEN :] = dn * r[t]
        back = (g * z[t] + to_recur[t] @ turned) * goes_on[t]
    grads["recur"] = before.reshape(-1, HIDDEN).T @ to_recur.reshape(-1, 3 * HIDDEN)
    order = np.argsort(ids.ravel().astype(np.int16), kind="stable")
    read = ids.ravel()[order]
    first = np.flatnonzero(np.concatenate(([True], read[1:] != read[:-1])))
    grads["inputs"][read[first]] = np.add.reduceat(to_inputs.reshape(-1, 3 * HIDDEN)[order], first)
    return loss / n, grads, after


def lanes(texts: list[np.ndarray], width: int):
    """(inputs, targets, text of each place, begins) as [time, lane]: every text lies whole in one lane, longest first."""
    import heapq

    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    width = max(1, min(width, len(texts), 2 * sum(map(len, texts)) // len(texts[order[0]]) + 1))  # a very long text gets few lanes beside it
    heap = [(0, lane) for lane in range(width)]
    place = []
    for k in order:
        at, lane = heapq.heappop(heap)
        place.append((k, at, lane))
        heapq.heappush(heap, (at + len(texts[k]), lane))
    high = max(at for at, _ in heap)
    targets = np.full((high, width), END_ID, np.int32)
    inputs = np.full((high, width), END_ID, np.int32)
    owner = np.full((high, width), -1, np.int32)
    fresh = np.zeros((high, width), bool)
    for k, at, lane in place:
        size = len(texts[k])
        targets[at : at + size, lane] = texts[k]
        inputs[at + 1 : at + size, lane] = texts[k][:-1]
        owner[at : at + size, lane] = k
        fresh[at, lane] = True
    return inputs, targets, owner, fresh


def text_scores(net: dict, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of every text; the state is carried from window to window to its end.

    Products are exact (``Reader``) and a text's logs are added up in its own order, so equal texts score equally, bit by bit.
    """
    if not texts:
        return np.zeros(0)
    inputs, targets, owner, fresh = lanes(texts, LANES)
    reader, logs, owners = Reader(net, inputs.shape[1]), [], []
    for low in range(0, len(inputs), reader.STEPS):
        part = slice(low, low + reader.STEPS)
        own = owner[part].ravel()
        logs.append(reader.logs(reader.hidden(inputs[part], fresh[part]), targets[part])[own >= 0])
        owners.append(own[own >= 0])
    return np.bincount(np.concatenate(owners), weights=np.concatenate(logs), minlength=len(texts))


def fit(net: dict, texts: list[np.ndarray], seed: int) -> dict:
    """The network after truncated backpropagation over the texts, once, by Adam."""
    net = {k: v.copy() for k, v in net.items()}
    if not texts:
        return net
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    order = np.random.default_rng(seed).permutation(len(texts))
    inputs, targets, owner, fresh = lanes([texts[k] for k in order], min(WIDE, max(NARROW, len(texts) // 8)))
    state = np.zeros((inputs.shape[1], HIDDEN), np.float32)
    for step, low in enumerate(range(0, len(inputs), WINDOW), 1):
        part = slice(low, low + WINDOW)
        going = (owner[part] >= 0).any(0)  # a lane that has ended stays so
        _, grads, state[going] = gradients(net, inputs[part][:, going], targets[part][:, going], owner[part][:, going] >= 0, state[going], fresh[part][:, going])
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * scale
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net[k] -= (0.02 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


# ---- Spark steps -------------------------------------------------------------------------------------------------

class Lexicon:
    """The commonest words with their counts, by hash; ids below KNOWN are the network's."""

    def __init__(self, table: list[tuple[int, int]]):
        ranked = [w for w in table if w[0] != int(END.view(np.int64))]
        self.hashes = np.array([w for w, _ in ranked], np.int64).view(np.uint64)
        self.counts = np.array([n for _, n in ranked], np.int64)
        self.end = next((n for w, n in table if w == int(END.view(np.int64))), 0)
        order = np.argsort(self.hashes, kind="stable")
        self.sorted, self.rank = self.hashes[order], order

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Frequency rank of every word, -1 if it is not among the commonest."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.rank[at], -1)

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        """Ids for the network: two are reserved, words beyond KNOWN are OTHER_ID."""
        return np.where((ranks >= 0) & (ranks < KNOWN - 2), ranks + 2, OTHER_ID).astype(np.int32)


def _encoded(spread):
    def encode(batches: Iterator):
        import pyarrow as pa

        lexicon: Lexicon = pickle.loads(spread.value)
        for keys, texts in steps(batches):
            hashes, begins = words(texts)
            ids = lexicon.ids(lexicon.ranks(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([np.append(ids[a:b], END_ID).astype(np.int16).tobytes() for a, b in zip(begins, begins[1:])], pa.binary())],
                names=["report_id", "ids"])

    return encode


def _fit_shard(spread):
    def fit_shard(key, rows):
        import pandas as pd

        texts = sorted((np.frombuffer(b, np.int16).astype(np.int32) for b in rows["ids"]), key=lambda t: (len(t), t.tobytes()))
        net = fit(pickle.loads(spread.value), texts, int(key[0]))
        return pd.DataFrame({"shard": [int(key[0])], "n": [len(texts)], "net": [pickle.dumps({k: len(texts) * v.astype(np.float64) for k, v in net.items()})]})

    return fit_shard


def _net_sums(batches: Iterator):
    """One row (shard, n, net): the sums of the networks of this task, read one after the other."""
    import pyarrow as pa

    shard, n, total = 0, 0, None
    for batch in batches:
        for now, count, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            net = pickle.loads(blob.as_py())
            shard, n, total = now, n + count, net if total is None else {k: total[k] + v for k, v in net.items()}
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["shard", "n", "net"])


def trained(spark, encoded: DataFrame, n: int) -> dict:
    """The network after every training report has been read once.

    Each report belongs to a shard and a round by a hash of its id and words; in a round every shard fits the network on its reports of the round,
    then the networks' mean goes on. Sums run in tasks of two levels, so the driver gets at most 8 networks (0.5 MB each).
    """
    net, kind = new_network(), "shard int, n long, net binary"
    count = max(1, n // SHARD)
    # equal rows are counted and numbered: they spread over the shards, and the file layout does not matter
    copies = encoded.groupBy("report_id", "ids").agg(F.count("*").alias("n")).select("report_id", "ids", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    dealt = F.pmod(F.xxhash64("report_id", "ids", "copy"), F.lit(count * AVERAGES))
    shards = staged(copies.select("ids", F.floor(dealt / AVERAGES).cast("int").alias("shard"), (dealt % AVERAGES).cast("int").alias("turn")), "lm-shards")
    for turn in range(AVERAGES):
        spread = spark.sparkContext.broadcast(pickle.dumps(net))
        sums = shards.where(F.col("turn") == turn).repartition(count, "shard").groupBy("shard").applyInPandas(_fit_shard(spread), kind)
        for parts in (math.isqrt(count), 8):
            sums = sums.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_net_sums, kind)
        fitted = [(r["n"], pickle.loads(r["net"])) for r in sums.collect()]
        if fitted:
            net = {k: (sum(m[k] for _, m in fitted) / sum(w for w, _ in fitted)).astype(np.float32) for k in net}
    return net


def _use_rows(spread, parts: int):
    def use(batches: Iterator):
        """One row per text with what the common words and the network say, and the other words dealt by hash (part >= 0)."""
        import pyarrow as pa

        lexicon, net = pickle.loads(spread.value)
        logs = np.log10(lexicon.counts + 1.0)

        def out(keys, uses, rows):
            empty = pa.nulls(len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), -1), pa.int32()), empty.cast(pa.binary()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([k[2] for k in keys], pa.bool_()), *(pa.array(c) for c in rows)],
                names=["part", "records", "row", "report_id", "held_out", "n_tokens", "n_known", "n_other", "base_logs", "other_logs", "model_logs"])
            if len(uses):
                batch = _blobs(uses, _part(uses["word"], parts))
                n = len(batch)
                nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *nothing],
                    names=["part", "records", "row", "report_id", "held_out", "n_tokens", "n_known", "n_other", "base_logs", "other_logs", "model_logs"])

        keys_held: list = []
        texts_held: list[np.ndarray] = []
        columns: list[list] = [[], [], [], [], []]
        uses_held: list[np.ndarray] = []

        def flush():
            model = text_scores(net, texts_held)
            rows = [np.concatenate(c) for c in columns]
            uses = np.concatenate(uses_held) if uses_held else np.empty(0, _USE)
            yield from out(keys_held, uses, [*rows, model / math.log(10)])

        size = 0
        for keys, texts in steps(batches, 3):
            hashes, begins = words(texts)
            ranks = lexicon.ranks(hashes)
            ids = lexicon.ids(ranks)
            owner = np.repeat(np.arange(len(texts)), np.diff(begins))
            common = ranks >= 0
            value = np.where(common, logs[np.maximum(ranks, 0)] if len(logs) else 0.0, 0.0)
            other = ids == OTHER_ID
            count = lambda on, w=None: np.bincount(owner[on], weights=None if w is None else w[on], minlength=len(texts))
            every = np.ones(len(hashes), bool)
            columns[0].append(np.diff(begins) + 1)
            columns[1].append(count(common) + int(lexicon.end > 0))
            columns[2].append(count(other))
            columns[3].append(count(every, value) + math.log10(lexicon.end + 1))
            columns[4].append(count(other, value).astype(float))  # counts are whole numbers where there are no weights
            texts_held += [np.append(ids[a:b], END_ID).astype(np.int32) for a, b in zip(begins, begins[1:])]
            rare = ~common
            if rare.any():
                pairs = np.empty(int(rare.sum()), [("row", "<i8"), ("word", "<u8")])
                pairs["row"], pairs["word"] = np.array([k[0] for k in keys], np.int64)[owner[rare]], hashes[rare]
                distinct, times = np.unique(pairs, return_counts=True)
                uses = np.empty(len(distinct), _USE)
                uses["word"], uses["row"], uses["times"] = distinct["word"], distinct["row"], times
                uses_held.append(uses)
            keys_held += keys
            size += sum(map(len, texts))
            if size > 6 << 20:
                yield from flush()
                keys_held, texts_held, columns, uses_held, size = [], [], [[], [], [], [], []], [], 0
        if keys_held:
            yield from flush()

    return use


def _rare_sums(parts: int):
    def rare(batches: Iterator):
        """Rows come sorted by part, the counts of the part first: sums per text of the logs of its rare words' counts."""
        part, counts = None, np.empty(0, _COUNT)
        for batch in batches:
            for now, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now != part:
                    part, counts = now, np.empty(0, _COUNT)
                if kind == 0:
                    counts = np.frombuffer(blob.as_py(), _COUNT)
                    continue
                uses = np.frombuffer(blob.as_py(), _USE)
                count = np.zeros(len(uses), np.int64)
                if len(counts):
                    at = np.minimum(np.searchsorted(counts["word"], uses["word"]), len(counts) - 1)
                    count = np.where(counts["word"][at] == uses["word"], counts["count"][at], 0)
                rows, place = np.unique(uses["row"], return_inverse=True)
                sums = np.empty(len(rows), _SUM)
                sums["row"] = rows
                sums["logs"] = np.bincount(place, weights=uses["times"] * np.log10(count + 1.0))
                sums["known"] = np.bincount(place, weights=uses["times"] * (count > 0)).astype(np.int64)
                yield _blobs(sums, _part(rows.view(np.uint64), parts))

    return rare


def _row_sums(batches: Iterator):
    """Adds the sums of each part of the texts; one part is held at a time."""
    import pyarrow as pa

    part, held = None, []

    def out():
        whole = np.concatenate(held)
        rows, place = np.unique(whole["row"], return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(np.bincount(place, weights=whole["logs"])), pa.array(np.bincount(place, weights=whole["known"]).astype(np.int64))],
            names=["row", "rare_logs", "rare_known"])

    for batch in batches:
        for now, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if now != part and held:
                yield out()
                held = []
            part = now
            held.append(np.frombuffer(blob.as_py(), _SUM))
    if held:
        yield out()


def text_likelihood(reports: DataFrame, fold: int = 7, held_out: int = 2, report_id: str = "report_id", text: str = "text") -> DataFrame:
    """(report_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every report with an id.

    A-Z is lower-cased; tokens are runs of bytes other than ASCII white space, then one end. Reports whose crc32 of the id as
    text leaves another remainder by ``fold`` than ``held_out`` are the training corpus. ``base_score`` is the add-one
    unigram log10 likelihood with the exact counts of the whole training corpus; n_known tokens occur in it.

    ``score`` is the model's log10 probability of the whole text: a gated recurrent network over the commonest ``KNOWN`` words,
    output factored into classes, reads the text to its end with its state carried across windows; any other word has the network's
    probability of an unknown word times its add-one unigram share among such words. The network is fitted by truncated
    backpropagation on every training report, once: the corpus is dealt into shards of about ``SHARD`` reports that fit in parallel, and
    the mean of their networks is taken ``AVERAGES`` times (``trained``). Null text is empty and has one token. Repeated rows count and are returned each time.
    With no training report the counts are 0 and the network says what it said before training. An empty table gives an
    empty result.

    Counts are shuffled once per task and distinct word, dealt by word; the ``COMMON`` commonest go to every task, uses of the rest meet
    their counts by word and return as sums per text. A hot word is common, so no part is much larger than another.
    """
    spark = reports.sparkSession
    rows = reports.select(F.col(report_id).cast("long").alias("report_id"), F.col(text).alias("text")).where("report_id IS NOT NULL")
    rows = rows.withColumn("held_out", crc_remainder("report_id", fold) == held_out)
    training = rows.where("NOT held_out")
    n = max(1, training.count())
    parts = max(48, n // 4000)
    counted = training.select(F.lit(0).alias("zero"), "text").mapInArrow(_counts(parts), "part int, records binary")
    table = staged(counted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        _joined_counts, "part int, records binary, distinct long, total long, top binary"), "counts")
    total, distinct = table.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    common = table.select("top").mapInArrow(_tops, "word long, n long").orderBy(F.desc("n"), "word").limit(COMMON).collect()  # 1 MB
    lexicon = Lexicon([(r["word"], r["n"]) for r in common])
    spread = spark.sparkContext.broadcast(pickle.dumps(lexicon))
    net = trained(spark, training.select("report_id", "text").mapInArrow(_encoded(spread), "report_id long, ids binary"), n)
    both = spark.sparkContext.broadcast(pickle.dumps((lexicon, net)))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "report_id", "held_out", "text")
    used = staged(numbered.mapInArrow(_use_rows(both, parts), "part int, records binary, row long, report_id long, held_out boolean, n_tokens long, n_known long, "
                                      "n_other long, base_logs double, other_logs double, model_logs double"), "uses")
    meeting = table.select("part", F.lit(0).alias("kind"), "records").unionByName(used.where("part >= 0").select("part", F.lit(1).alias("kind"), "records"))
    sums = meeting.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_rare_sums(parts), "part int, records binary")
    back = sums.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_row_sums, "row long, rare_logs double, rare_known long")
    known = lexicon.counts[: KNOWN - 2]
    inside, kinds = int(known.sum()) + lexicon.end, len(known) + int(lexicon.end > 0)
    base, tail = math.log10(total + distinct + 1), math.log10(max(0, total - inside) + max(0, distinct - kinds) + 1)
    rare_logs, rare_known = F.coalesce("rare_logs", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return used.where("part < 0").join(back, "row", "left").select(
        "report_id", "held_out", "n_tokens", (F.col("n_known") + rare_known).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_logs") + rare_logs - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("model_logs") + F.col("other_logs") + rare_logs - F.col("n_other") * F.lit(tail)).alias("score"))
