"""Reports that share most of their word shingles: set similarity join over adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import CHUNKS, components, mixed, near_ids, staged, steps, summed_counts, words
from panelwright.llm.memory import tidy

#: Counters of the frequency estimate, whatever the corpus (4 MB).
COUNTERS = 1 << 20
#: Most shared prefix tokens that may be asked for.
LEVELS = 4
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 40.0
#: Tokens of a document, smallest hashes first, at which it meets the most typical document that holds them.
HEADS = 6
#: Postings of one group in the join, on average.
GROUP_POSTINGS = 200_000
_FACTORS = np.random.default_rng(77).integers(1, 1 << 62, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Documents of one token that are compared side by side; a commoner token's are dealt into blocks and pairs of blocks.
BLOCK = 4096
#: 64-bit words of a document's parity bitmap.
PARITY = 4
_SENT = [("token", "<u8"), ("doc", "<i8"), ("label", "<i8"), ("size", "<i4"), ("place", "<i4"), ("asked", "<i2"), ("across", "?"), ("side", "?")]
_POSTING = np.dtype([*_SENT, ("parity", "<u8", (PARITY,))])
_SENT = np.dtype(_SENT)


def shingle_lists(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Hashes of every text's shingles in order, repeats included; fewer words than ``width`` make one shingle."""
    hashes, begins = words(texts)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    factors = _FACTORS if width <= 6 else np.random.default_rng(78).integers(1, 1 << 62, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * factors[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(begins, begins[1:]):
        if b - a >= width:
            out.append(rolled[a : b - width + 1])
        elif b > a:
            out.append(mixed((hashes[a:b] * factors[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _frequencies(width: int):
    def count(batches: Iterator):
        import pyarrow as pa

        total = np.zeros(COUNTERS, np.uint32)
        for _, texts in steps(batches):
            for tokens in shingle_lists(texts, width):
                np.add.at(total, (tokens >> np.uint64(44)).astype(np.intp), np.uint32(1))
        if total.any():
            parts = total.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    return count


def needed(size: int, percent: int) -> int:
    """Smallest overlap that a set of this size must have with any partner."""
    return -(-percent * size // 100)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap of a set: each token turns one of its bits. Two sets differ in at least as many tokens as their bitmaps in bits."""
    bits = np.bincount((tokens & np.uint64(64 * PARITY - 1)).astype(np.intp), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def mapped(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether a bitmap can tell sets of these sizes apart: fewer tokens may differ than bits of unlike sets do, about half of them."""
    return 2 * sizes.astype(np.int64) * (100 - percent) < 28 * PARITY * (100 + percent)


def prefix(tokens: np.ndarray, estimate: np.ndarray, percent: int, seen: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(prefix tokens, rarest first; shared tokens asked for; ``seen`` of the tokens) of a sorted distinct token set.

    With l shared tokens asked for, the prefix is the first ``size - needed + l`` tokens. More tokens cost more postings, but
    fewer documents share l of them; l is the cheapest by the estimated frequencies.
    """
    least = needed(len(tokens), percent)
    order = np.argsort(estimate, kind="stable")
    longest = min(len(tokens), len(tokens) - least + LEVELS)
    reads = np.cumsum(estimate[order[:longest]])
    best = min(range(1, min(LEVELS, least) + 1), key=lambda k: reads[min(longest, len(tokens) - least + k) - 1] * (1 + VERIFY_COST / k**2))
    return tokens[order[:longest]], best, seen[order[:longest]]


def _signatures(width: int, percent: int, spread):
    def sign(batches: Iterator):
        import pyarrow as pa

        counts = np.frombuffer(spread.value, np.uint32)
        noise = counts.mean(dtype=np.float64)
        for keys, texts in steps(batches):
            rows: list[list] = [[], [], [], [], [], [], [], [], []]
            for key, listed in zip(keys, shingle_lists(texts, width)):
                tokens = np.unique(listed)
                chosen, asked, typical, common = np.empty(0, np.uint64), 1, 0.0, np.empty(0, np.uint32)
                if len(tokens):
                    seen = counts[(tokens >> np.uint64(44)).astype(np.intp)]
                    estimate = 1 + np.maximum(0, seen - noise)
                    chosen, asked, common = prefix(tokens, estimate, percent, seen)
                    typical = float(np.log(estimate).mean())
                one = int(tokens.sum(dtype=np.uint64)) if len(tokens) else 0
                two = int(np.bitwise_xor.reduce(mixed(tokens + np.uint64(1)))) if len(tokens) else 0
                for column, value in zip(rows, (key, len(tokens), one.to_bytes(8, "little") + two.to_bytes(8, "little"), chosen.tobytes(), tokens[:HEADS].view(np.int64).tolist(), asked, typical, common.tobytes(), parity(tokens).tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary()),
                 pa.array(rows[4], pa.list_(pa.int64())), pa.array(rows[5], pa.int32()), pa.array(rows[6], pa.float64()), pa.array(rows[7], pa.binary()), pa.array(rows[8], pa.binary())],
                names=["report_id", "size", "content", "tokens", "heads", "asked", "typical", "seen", "parity"])

    return sign


def in_blocks(postings: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Postings as they are compared: those of a token seen more than ``BLOCK`` times are dealt by document into blocks, and a
    document goes to every pair of blocks with its own. Such a pair has a token of its own; ``side`` tells its two blocks apart."""
    blocks = -(-seen.astype(np.int64) // BLOCK)
    rare, out = blocks <= 1, []
    out.append(postings[rare])
    for k in np.flatnonzero(~rare):
        r = int(blocks[k])
        own = int(mixed(postings["doc"][k : k + 1].view(np.uint64) ^ postings["token"][k])[0] % np.uint64(r))
        other = np.arange(r, dtype=np.uint64)
        copies = np.repeat(postings[k : k + 1], r)
        low, high = np.minimum(other, np.uint64(own)), np.maximum(other, np.uint64(own))
        copies["token"] = mixed(postings["token"][k] + mixed(low * np.uint64(r) + high + np.uint64(1)))
        copies["across"], copies["side"] = low != high, own > other
        out.append(copies)
    return np.concatenate(out)


def _postings(groups: int, percent: int):
    def post(batches: Iterator):
        """Prefix tokens of a batch of documents, dealt into groups by token; a group's postings are one binary value, and the bitmaps of
        those that have one, in order, another."""
        import pyarrow as pa

        for whole in batches:
            for low in range(0, len(whole), 2000):
                batch = whole.slice(low, 2000)
                blobs = batch.column(3).to_pylist()
                lengths = np.array([len(b) // 8 for b in blobs])
                out = np.zeros(int(lengths.sum()), _POSTING)
                out["token"] = np.frombuffer(b"".join(blobs), np.uint64)
                for name, column in (("doc", 0), ("label", 1), ("size", 2), ("asked", 4)):
                    out[name] = np.repeat(np.asarray(batch.column(column)), lengths)
                out["place"] = np.arange(len(out)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                out["parity"] = np.repeat(np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u8").reshape(-1, PARITY), lengths, axis=0)
                out = in_blocks(out, np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32))
                group = (mixed(out["token"]) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                group, out = group[order], out[order]
                cut = np.flatnonzero(np.diff(group)) + 1
                small = mapped(out["size"], percent)
                sent = np.empty(len(out), _SENT)
                for name in _SENT.names:
                    sent[name] = out[name]
                blobs = [p.tobytes() for p in np.split(sent, cut)] if len(out) else []
                bitmaps = [p.tobytes() for p in np.split(out["parity"][small], np.cumsum(small)[cut - 1])] if len(out) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[np.concatenate(([0], cut))] if len(out) else [], pa.int64()), pa.array(blobs, pa.binary()), pa.array(bitmaps, pa.binary())],
                    names=["token_group", "postings", "bitmaps"])

    return post


def matches(postings: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings (smaller, larger document) of different label that share a prefix token and may be similar.

    They may be by their sizes and by where the token stands: no more tokens can be shared than stand before it in both, itself,
    and those that stand after it in both.

    The larger document of a pair (at equal size that of greater id) asks for l shared tokens. With the overlap that the pair needs,
    they stand among the first ``size - overlap + l`` tokens of each document; others are passed over. Runs of one
    token and one label are passed over; the others are compared at distance 1, 2, ... so no run is held as a square.
    """
    postings = postings[np.lexsort((postings["doc"], postings["size"], postings["token"]))]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(postings["token"]) != 0))) if len(postings) else np.empty(0, np.int64)
    if not len(starts):
        return
    lengths = np.diff(np.append(starts, len(postings)))
    mixed_run = np.minimum.reduceat(postings["label"], starts) != np.maximum.reduceat(postings["label"], starts)
    postings = postings[np.repeat(mixed_run, lengths)]
    token, size, bits, small = postings["token"], postings["size"].astype(np.int64), postings["parity"], mapped(postings["size"], percent)
    at = np.arange(len(postings))
    far = 0
    while True:
        far += 1
        at = at[at + far < len(postings)]
        at = at[token[at] == token[at + far]]
        at = at[100 * size[at] >= percent * size[at + far]]  # sizes rise within a run: further ones are no nearer
        if not len(at):
            return
        x, y = postings[at], postings[at + far]
        after = np.minimum(x["size"] - x["place"], y["size"] - y["place"]).astype(np.int64)
        most = np.minimum(x["place"], y["place"]) + after
        overlap = -(-percent * (size[at] + size[at + far]) // (100 + percent))
        ok = (x["label"] != y["label"]) & (most >= overlap) & (~x["across"] | (x["side"] != y["side"]))
        apart = np.bitwise_count(bits[at] ^ bits[at + far]).sum(1)
        ok &= ~small[at] | ~small[at + far] | (apart <= size[at] + size[at + far] - 2 * overlap)  # the tokens that only one of them has
        ok &= (x["place"] < x["size"] - overlap + y["asked"]) & (y["place"] < y["size"] - overlap + y["asked"])
        if ok.any():
            yield x[ok], y[ok]


CANDIDATES = "a long, b long, asked int, sizes long, shared long, after_a int, after_b int"


def _candidates(percent: int):
    def find(key, rows):
        """Pairs of one token group: shared tokens seen here, and how many stand after the last of them in each document."""
        import pandas as pd

        sent = np.frombuffer(b"".join(rows["postings"]), _SENT)
        postings = np.zeros(len(sent), _POSTING)
        for name in _SENT.names:
            postings[name] = sent[name]
        postings["parity"][mapped(sent["size"], percent)] = np.frombuffer(b"".join(rows["bitmaps"]), "<u8").reshape(-1, PARITY)
        found = list(matches(postings, percent))
        x, y = (np.concatenate([f[k] for f in found]) if found else np.empty(0, _POSTING) for k in (0, 1))
        frame = pd.DataFrame({
            "a": x["doc"], "b": y["doc"], "asked": y["asked"].astype("int32"), "sizes": x["size"].astype("int64") + y["size"], "shared": np.ones(len(x), "int64"),
            "after_a": (x["size"] - x["place"] - 1).astype("int32"), "after_b": (y["size"] - y["place"] - 1).astype("int32")})
        return frame.groupby(["a", "b", "asked", "sizes"], sort=False, as_index=False).agg({"shared": "sum", "after_a": "min", "after_b": "min"})

    return find


def _verify(width: int, percent: int):
    def verify(batches: Iterator):
        import pyarrow as pa

        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            left, right = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for k in range(len(batch)):
                one, two = left[k].as_py(), right[k].as_py()
                if one != last[0]:
                    last = (one, np.unique(shingle_lists([one], width)[0]))
                x, y = last[1], np.unique(shingle_lists([two], width)[0])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _linked(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity, by their whole texts; only texts of pairs are shuffled."""
    ids = pairs.select(F.col("a").alias("report_id")).unionByName(pairs.select(F.col("b").alias("report_id"))).distinct()
    texts = near_ids(rows, "report_id", ids).join(ids, "report_id").groupBy("report_id").agg(F.max("text").alias("text"))
    texts = staged(texts, "pair-texts")
    both = pairs.join(texts.select(F.col("report_id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("report_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return staged(both.mapInArrow(tidy(_verify(width, percent)), "a long, b long"), "similar")


def shingle_components(reports: DataFrame, percent: int = 75, width: int = 5, report_id: str = "report_id", text: str = "text") -> DataFrame:
    """(report_id, n_shingles, component_id) of every report with an id.

    A-Z is lower-cased; words are runs of bytes other than ASCII white space; a report's set holds its distinct shingles of
    ``width`` words, or, with fewer words, their whole sequence as one. Two reports link when the intersection of their
    sets is at least ``percent`` per cent of the union. Null or wordless texts have no shingles and link with nothing.
    component_id is the smallest id reachable by links, itself included. Repeated rows are returned each time; an id with several
    texts is one report per text with a common component only if they link. An empty table gives an empty result.

    Method: shingles are 64-bit hashes, their frequencies estimated by 2**20 counters over all reports. Reports with
    equal sets are one. Each other report gets a prefix, rarest tokens first, and the number l of shared prefix tokens it asks
    for (``prefix``). First, at each of its ``HEADS`` smallest tokens every report meets the report with the commonest tokens of those
    that hold it; whole texts decide, and the links give first components: a group of copies has a star, not all its pairs. Then all pairs of different components that share l prefix tokens are verified: no pair that reaches the similarity
    can share fewer, so no link between components is lost. A pair whose ``parity`` bitmaps differ too much is not listed, and a
    token that many reports hold is compared in pairs of blocks (``in_blocks``). Pairs inside one component change nothing and are not listed.
    """
    spark = reports.sparkSession
    rows = reports.select(F.col(report_id).cast("long").alias("report_id"), F.col(text).alias("text")).where("report_id IS NOT NULL")
    counts = summed_counts(rows.mapInArrow(tidy(_frequencies(width)), "chunk int, counts binary"), COUNTERS)
    spread = spark.sparkContext.broadcast(counts.tobytes())  # 4 MB at any size
    signed = staged(rows.mapInArrow(tidy(_signatures(width, percent, spread)),
                    "report_id long, size int, content binary, tokens binary, heads array<long>, asked int, typical double, seen binary, parity binary"), "signatures")
    some = signed.where("size > 0")
    first = some.groupBy("content").agg(F.min(F.struct("report_id", "size", "typical", "heads")).alias("r")).select("content", "r.*")
    first = staged(first, "sets")
    heads = first.select("report_id", "typical", F.explode("heads").alias("token"))
    hub = heads.groupBy("token").agg(F.max(F.struct("typical", "report_id"))["report_id"].alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = heads.join(hub, "token").select("a", F.col("report_id").alias("b")).where("a <> b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sizes = first.select("report_id", "size")
    stars = (stars.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
             .where(f"least(size_a, size_b) * 100L >= greatest(size_a, size_b) * {percent}L").select("a", "b"))
    easy = _linked(staged(stars, "stars"), rows, width, percent)
    labels = components(easy).toDF("report_id", "label")
    # one report stands for equal sets: the others' tokens stop here
    representatives = first.join(labels, "report_id", "left").select("report_id", F.coalesce("label", "report_id").alias("label"))
    kept = some.join(representatives, "report_id").dropDuplicates(["report_id", "content"])
    total = some.agg(F.coalesce(F.sum(F.length("tokens") / 8), F.lit(0))).first()[0]
    groups = max(64, int(total // GROUP_POSTINGS))
    posted = kept.select("report_id", "label", "size", "tokens", "asked", "seen", "parity").mapInArrow(tidy(_postings(groups, percent)), "token_group long, postings binary, bitmaps binary")
    found = posted.groupBy("token_group").applyInPandas(_candidates(percent), CANDIDATES)
    pairs = found.groupBy("a", "b", "asked", "sizes").agg(F.sum("shared").alias("shared"), F.min("after_a").alias("after_a"), F.min("after_b").alias("after_b"))
    pairs = pairs.where(f"shared >= asked AND (shared + least(after_a, after_b)) * {100 + percent}L >= sizes * {percent}L").select("a", "b")
    hard = _linked(staged(pairs, "candidates"), rows, width, percent)
    # links between first components, instead of all links between their members
    label = F.coalesce("label", "report_id")
    bridges = hard
    for side in ("a", "b"):
        bridges = bridges.join(labels.toDF(side, "label"), side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    joined = components(bridges.distinct()).toDF("label", "component_id")
    member = (first.select("content", "report_id").join(labels, "report_id", "left").select("content", label.alias("label"))
              .join(joined, "label", "left").select("content", F.coalesce("component_id", "label").alias("component_id")))
    return some.join(member, "content").select("report_id", F.col("size").cast("long").alias("n_shingles"), "component_id").unionByName(
        signed.where("size = 0").select("report_id", F.lit(0).cast("long").alias("n_shingles"), F.col("report_id").alias("component_id")))
