"""Language of report texts by error-correcting output codes over hashed n-grams."""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import crc_remainder, steps
from panelwright.llm.features import logistic, ngram_matrix, scores
from panelwright.llm.memory import give_back

#: Hashed n-gram features of a text (a power of two).
FEATURES = 2048
#: Labelled texts per language that are expected in the training sample.
PER_LANGUAGE = 400
#: A text whose best and second codeword are closer than this is flagged as ambiguous.
MARGIN = 0.1
_LETTER_OR_NUMERAL = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a sign of the text is a letter; numerals such as fractions, powers and Roman numbers are none."""
    found = _LETTER_OR_NUMERAL.search(text)
    return found is not None and any(map(str.isalpha, text[found.start():]))


def codewords(classes: int) -> np.ndarray:
    """A row of -1 and 1 per class. Up to five classes: every split of the classes; more: random words far apart."""
    if classes < 2:
        return np.zeros((classes, 0), int)
    if classes <= 5:
        splits = [s for s in itertools.product((-1, 1), repeat=classes) if s[0] == 1 and -1 in s]
        return np.array(splits).T
    bits = max(15, 6 * int(np.ceil(np.log2(classes))))
    rng = np.random.default_rng(11)
    best = None
    for _ in range(200):
        words = rng.choice((-1, 1), (classes, bits))
        near = min((words[i] != words[i + 1 :]).sum(1).min() for i in range(classes - 1))
        if (np.abs(words.sum(0)) < classes).all() and (best is None or near > best[0]):
            best = (near, words)
    return best[1]


def train(rows: np.ndarray, languages: list[str], known: list[str]):
    """(bit models, codewords, bit weights): every bit's classifier, weighted by the log odds of its held-out hits."""
    codes = codewords(len(known))
    place = np.array([known.index(x) for x in languages])
    targets = (codes[place] + 1) / 2
    weights = 1.0 / np.bincount(place, minlength=len(known))[place]
    fold = np.arange(len(rows)) % 5 == 0
    if codes.shape[1] == 0:
        return np.zeros((rows.shape[1] + 1, 0), np.float32), codes, np.zeros(0)
    if fold.all() or not fold.any() or len(set(place[~fold])) < len(known):
        trust = np.ones(codes.shape[1])
    else:
        part = logistic(rows[~fold], targets[~fold], weights[~fold])
        hit = ((scores(rows[fold], part) > 0) == (targets[fold] > 0.5)).mean(0)
        trust = np.log((hit * fold.sum() + 1) / ((1 - hit) * fold.sum() + 1))
    return logistic(rows, targets, weights), codes, np.maximum(trust, 0.05)


def decode(margins: np.ndarray, codes: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, score, lead) by the smallest weighted logistic loss between a text's margins and the codewords."""
    if len(codes) == 1:
        one = np.ones(len(margins))
        return np.zeros(len(margins), int), one, one
    loss = (np.logaddexp(0, -margins[:, None, :] * codes[None, :, :]) * trust).sum(2) / trust.sum()
    likely = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
    likely /= likely.sum(1, keepdims=True)
    ordered = np.sort(likely, 1)
    return loss.argmin(1), ordered[:, -1], ordered[:, -1] - ordered[:, -2]


def _sample(batches: Iterator):
    import pyarrow as pa

    for keys, texts in steps(batches):
        rows = ngram_matrix(texts, FEATURES, True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], names=["lang", "features"])


def _predict(spread):
    def predict(batches: Iterator):
        import pyarrow as pa

        known, model, codes, trust = pickle.loads(spread.value)
        for keys, texts in steps(batches):
            letters = np.array([has_letter(t.decode()) for t in texts], bool)
            if known:
                place, score, lead = decode(scores(ngram_matrix(texts, FEATURES, True), model), codes, trust)
            else:
                letters[:], place, score, lead = False, np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([known[p] if ok else "und" for p, ok in zip(place, letters)], pa.string()),
                 pa.array(np.where(letters, score, 0.0)), pa.array(letters & (lead < MARGIN))],
                names=["report_id", "lang_pred", "score", "ambiguous"])

    return predict


def languages(reports: DataFrame, training: DataFrame | None = None, held_out: int = 5, report_id: str = "report_id",
              text: str = "text", lang: str = "lang") -> DataFrame:
    """(report_id, held_out, lang_pred, score, ambiguous) of every report with an id.

    Training uses rows of ``training`` (default: ``reports``) with a language and a text whose crc32 of the id as text is not
    divisible by ``held_out``; of these a sample of about ``PER_LANGUAGE`` ids per language, chosen by a hash, one row each, so a
    language that fills a third of the table weighs no more than another. A prediction uses the text alone. Every bit of the codewords has a
    binary classifier over hashed n-grams; the codeword of smallest loss, each bit weighted by its held-out reliability,
    is the answer. ``score`` in 0..1 is its share among all codewords, ``ambiguous`` marks a lead below ``MARGIN``. Null texts and texts
    without a letter are 'und' with score 0, as is everything when nothing is learned. One language gives that language. Repeated
    rows are returned each time; an empty table gives an empty result.

    Only the sample (languages x ``PER_LANGUAGE`` x 4 KB) reaches the driver; scoring is one pass without shuffle.
    """
    spark = reports.sparkSession
    source = reports if training is None else training
    labelled = source.select(F.col(report_id).alias("report_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        "report_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(crc_remainder("report_id", held_out) != 0)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    known = sorted(counts)
    model = (known, np.zeros((FEATURES + 1, 0), np.float32), codewords(len(known)), np.zeros(0))
    if len(known) > 1:
        share = F.create_map(*[F.lit(x) for k in known for x in (k, min(1.0, PER_LANGUAGE / counts[k]))])
        chosen = labelled.where(F.pmod(F.xxhash64("report_id", F.lit("lang")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
        chosen = chosen.groupBy("report_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.*")  # an id may stand on many rows
        sample = chosen.mapInArrow(_sample, "lang string, features binary").toArrow().to_pandas()
        sample = sample.sort_values(["lang", "features"]).reset_index(drop=True)
        sample = sample.iloc[np.random.default_rng(3).permutation(len(sample))]
        known = sorted(set(sample["lang"]))
        if len(known):
            rows = np.frombuffer(b"".join(sample["features"]), np.float16).reshape(-1, FEATURES).astype(np.float32)
            model = (known, *train(rows, sample["lang"].tolist(), known))
    spread = spark.sparkContext.broadcast(pickle.dumps(model))  # bits x 8 KB
    sample = model = None
    give_back()  # the driver holds on to nothing of the sample
    rows = reports.select(F.col(report_id).cast("long").alias("report_id"), F.col(text).alias("text")).where("report_id IS NOT NULL")
    found = rows.mapInArrow(_predict(spread), "report_id long, lang_pred string, score double, ambiguous boolean")
    return found.select("report_id", (crc_remainder("report_id", held_out) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
