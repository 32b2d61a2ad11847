"""The token archive, collocations and hard negatives against brute force; nulls, repeats, ties, empty tables, clashing columns."""

import math
import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import token_archive
from panelwright.llm.collocations import collocations, longest_windows
from panelwright.llm.common import reference_tokenizer, tokenizer_path
from panelwright.llm.hard_negatives import fit_clusters, hard_negatives, products, scaled
from panelwright.llm.queries import BYTE_VOCABULARY
from panelwright.plans.registry import inputs
from panelwright.session import shared_dir

TEXTS = ["Retail sales rose 3.1% in May, it's said.", None, "", " \n\t ", "<|endoftext|> and CPI", "消费价格同比上涨1.2%", "word " * 3000, "é é ½ 🙂 \x1f", "!!!!"]


# ---- token archive -----------------------------------------------------------------------------------------------

def grammar_of(ids, last):
    made = token_archive.repair(np.array(ids, np.uint32), np.array(last))
    return made, token_archive.Grammar(made["terminals"], made["rules"], made["rule_lengths"], made["rounds"], made["symbols"])


@pytest.mark.parametrize("kinds, size", [(1, 50), (2, 400), (7, 3000), (300, 20000), (70000, 90000)])
def test_grammar_round_trip_and_random_access(kinds, size):
    rng = np.random.default_rng(kinds)
    ids = rng.integers(0, kinds, size).astype(np.uint32)
    ids[size // 2 : size // 2 + size // 4] = ids[: size // 4]  # a long repeated passage
    last = rng.random(size) < 0.01
    last[-1] = True
    made, grammar = grammar_of(ids, last)
    assert np.array_equal(grammar.expand(grammar.symbols), ids)
    ends, symbol_ends = np.flatnonzero(last) + 1, np.flatnonzero(made["last"]) + 1
    assert len(ends) == len(symbol_ends)  # no rule passes a report's end
    for k in range(0, len(ends), max(1, len(ends) // 20)):
        start, end = (ends[k - 1] if k else 0), ends[k]
        first, stop = (symbol_ends[k - 1] if k else 0), symbol_ends[k]
        for a, n in ((0, end - start), (0, 1), (end - start - 1, 1), ((end - start) // 2, (end - start) // 3)):
            assert np.array_equal(grammar.stretch(first, stop, a, n), ids[start + a : start + a + n])


def test_rules_pay_and_grow_on_copies():
    passage = np.random.default_rng(0).integers(0, 5000, 800).astype(np.uint32)
    ids = np.tile(passage, 64)
    last = np.zeros(len(ids), bool)
    last[799::800] = True
    made, grammar = grammar_of(ids, last)
    assert len(made["symbols"]) < len(ids) / 20 and grammar.lengths.max() > 20
    n = len(made["terminals"])
    uses = np.bincount(made["symbols"].astype(int), minlength=len(grammar.lengths))
    for k, (left, right) in reversed(list(enumerate(made["rules"].reshape(-1, 2).tolist(), n))):
        uses[left] += uses[k]  # a symbol that stands in a rule occurs wherever the rule does
        uses[right] += uses[k]
    assert (uses[n:] >= token_archive.LEAST_USES).all() and (uses[:n] == np.bincount(ids)[made["terminals"]]).all()


def test_archive_against_the_library(spark):
    rows = [(3 * k, t, "en", k, 1, 2) for k, t in enumerate(TEXTS)] + [(3, "again", "en", 0, 1, 2), (0, TEXTS[0], None, None, 1, 2), (None, "no id", None, None, 1, 2)]
    reports = spark.createDataFrame(rows, "report_id long, text string, lang string, mark long, origin int, part int").repartition(3)
    path = shared_dir(spark, f"archive-{uuid.uuid4().hex}")
    token_archive.write_archive(reports, path, tokenizer_path(BYTE_VOCABULARY))
    got = sorted(token_archive.read_archive(spark, path).collect(), key=lambda r: r.start)
    library = reference_tokenizer(tokenizer_path(BYTE_VOCABULARY))
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in rows if r[0] is not None)
    assert Counter((r.report_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.report_id for r in got] == sorted(r[0] for r in rows if r[0] is not None)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_empty_archive(spark):
    path = shared_dir(spark, f"archive-{uuid.uuid4().hex}")
    token_archive.write_archive(spark.createDataFrame([], "report_id long, text string"), path, tokenizer_path(BYTE_VOCABULARY))
    assert token_archive.read_archive(spark, path).count() == 0


# ---- collocations ------------------------------------------------------------------------------------------------

def brute_collocations(rows, min_count, longest, covered, top):
    counts, words_of = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lowered):
            words = re.findall("[^\\x20\\x09]+", piece)
            words_of[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    own = counts.setdefault(lang, Counter())
                    own[tuple(words[k : k + size])] += 1
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        listed = []
        for p, a in found.items():
            score, _, left, right = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in found.items())
            if not inside:
                listed.append((-score, -a, " ".join(p).encode(), " ".join(p), left, right))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, words_of[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("longest, covered, top", [(3, 50, 2000), (3, 101, 7), (2, 50, 9), (4, 70, 2000)])
def test_collocations_against_brute_force(spark, longest, covered, top):
    r = random.Random(longest * 100 + covered)
    vocabulary = ["the", "of", "é", "中文", "ÀB", "Of", "x-1", "ﬁ", "𝒳"]
    rows = []
    for _ in range(60):
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\xa0"]) for _ in range(r.randint(0, 60)))
        rows.append((text, r.choice(["en", "en", "en", "zh", None, "und"])))
    rows += [(None, "en"), ("", None), ("...", "xx"), rows[0], rows[0], ("a b " * 4000 + "END", "long")]
    frame = spark.createDataFrame([(k, *row, "x", 1) for k, row in enumerate(rows)], "report_id int, text string, lang string, phrase string, c int").repartition(4)
    got = sorted(tuple(x) for x in collocations(frame, 3, longest, covered, top).collect())
    assert got == brute_collocations(rows, 3, longest, covered, top) and got


def test_windows_are_added_up_before_they_are_rows(spark):
    rows = [("a b c. a b d. a", "en")] * 3 + [("a b c", None), ("x y", "en")]
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    found = longest_windows(frame, 3)
    assert Counter(map(tuple, found.collect())) == Counter([
        ("en", "a", "b", "c", 3), ("en", "a", "b", "d", 3), ("en", "a", None, None, 3), ("en", "b", "c", None, 3), ("en", "b", "d", None, 3), ("en", "c", None, None, 3),
        ("en", "d", None, None, 3), ("en", "x", None, None, 1), ("en", "y", None, None, 1), ("und", "a", None, None, 1), ("und", "b", None, None, 1), ("und", "c", None, None, 1)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan  # a line of its own for every window took most of the time


def test_no_collocations(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([("one two three", "en")], "text string, lang string")).count() == 0


# ---- hard negatives ----------------------------------------------------------------------------------------------

def brute_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256.0):
    kept = {}
    for i, o, v in sorted((r for r in rows if None not in r[:3] and len(r[2]) and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], r[2])):
        kept.setdefault(i, (o, [math.floor(scale * x) for x in v]))
    out = []
    for a, (o, v) in kept.items():
        if not anchors(a):
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w)), i, p) for i, (p, w) in kept.items() if i != a and len(w) == len(v))
        for score, i, _ in [t for t in near if t[2] == o][:positives]:
            fit = [(s, j) for s, j, p in near if p != o and low * -score <= 100 * -s <= high * -score][:negatives]
            out += [(a, i, rank, j, -score, -s) for rank, (s, j) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_negatives_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.randint(0, 3), [r.gauss(0.4 * (k % 3), 1) for _ in range(6)]) for k in range(700)]
    rows += [(k, r.randint(0, 3), [0.5, 0.25, 1.0, 0.0, 0.0, 0.5]) for k in range(700, 800)]  # ties
    rows += [(k, 1, [r.gauss(0, 1) for _ in range(4)]) for k in range(800, 830)] + [(830, 2, [0.0] * 6), (840, None, [1.0] * 6), (850, 1, None), (860, 1, []),
             (870, 1, [1.0, None] * 3), (880, 1, [float("nan")] * 6), (890, 2, [float("inf")] * 6), (None, 1, [1.0] * 6)]
    rows += [rows[10], rows[10], (20, 9, [5.0] * 6), (30, rows[30][1], [5.0] * 6)]
    frame = spark.createDataFrame([(*row, 1, 2, 3, 4) for row in rows], "row_id long, outcome int, features array<double>, d int, g int, lane int, kind int").repartition(5)
    got = sorted(tuple(x) for x in hard_negatives(frame, "row_id % 10 = 0").collect())
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_hard_negatives_of_sector_features(spark):
    import __spark_entry__ as entry

    table = entry.queries()["sector_features"](spark, "/root/testdata/sf0.001").dropna()
    columns = ["log_export", "partner_hhi", "top5_share", "partner_gdp"]
    rows = table.select(F.abs(F.xxhash64("year", "country_code", "hs2") % 100000).alias("row_id"), F.col("outcome").cast("int").alias("outcome"),
                        F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
    got = sorted(tuple(x) for x in hard_negatives(rows, "row_id % 50 = 0").collect())
    assert got == brute_negatives([tuple(x) for x in rows.collect()], lambda i: i % 50 == 0)


def test_no_hard_negatives(spark):
    empty = spark.createDataFrame([], "row_id long, outcome int, features array<double>")
    assert hard_negatives(empty).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, 0, [1.0])], empty.schema)).count() == 0


def test_bound_holds_and_products_are_exact():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_normal((500, 8)))
    _, units = scaled(x)
    centroids = fit_clusters(units)
    cosines = np.clip(units @ centroids.T, -1, 1)
    own = cosines.argmax(1)
    for c in np.unique(own):
        members = np.flatnonzero(own == c)
        width = np.arccos(cosines[members, c]).max()
        bound = np.cos(np.maximum(np.arccos(cosines[:, c]) - width, 0))
        assert (units[members] @ units.T <= bound[None, :] + 1e-9).all()
    big = np.array([[2.0**30, 3.0], [1.0, -2.0]])
    assert products(big, big).tolist() == [[2**60 + 9, 2**30 - 6], [2**30 - 6, 5]]
