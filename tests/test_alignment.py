"""Line alignment and interval join against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions.alignment import anchors, matches, script
from panelwright.operators.intervals import interval_join, range_blocks
from panelwright.operators.revisions import apply_script, line_script


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def drawn(seed, signs, n):
    r = random.Random(seed)
    return [r.choice(signs) for _ in range(r.randint(0, n))]


@pytest.mark.parametrize("signs", ["ab", "abcd", "abcdefghijklmnop"])
def test_matches_are_longest_between_anchors(signs):
    for seed in range(400):
        a, b = drawn(seed, signs, 16), drawn(seed + 9000, signs, 16)
        got, fixed = matches(a, b), anchors(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:]))
        edges = [(-1, -1), *fixed, (len(a), len(b))]
        assert len(got) == len(fixed) + sum(common(a[i + 1:k], b[j + 1:m]) for (i, j), (k, m) in zip(edges, edges[1:]))
        once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
        assert len(fixed) == common(once, [x for x in b if x in once])


def test_script_rebuilds_and_lists_hunks():
    for seed in range(400):
        a, b = drawn(seed, "abcdefg", 20), drawn(seed + 7000, "abcdefg", 20)
        rows = script(a, b, None)
        assert [r[4] for r in rows if r[1] != "-"] == b and [r[4] for r in rows if r[1] != "+"] == a
        near = script(a, b, 2)
        assert [r[1:] for r in near if r[1] != " "] == [r[1:] for r in rows if r[1] != " "]
        assert all(r[1:] in {x[1:] for x in rows} for r in near)
    text = list("abcdefghijklm")
    new = ["X" if x == "c" else "Y" if x == "l" else x for x in text]
    assert [(h, op + x) for h, op, _, _, x in script(text, new, 1)] == [
        (1, " b"), (1, "-c"), (1, "+X"), (1, " d"), (2, " k"), (2, "-l"), (2, "+Y"), (2, " m")]
    assert {r[0] for r in script(text, new, 4)} == {1} and script(text, text) == []


def test_documents_are_rebuilt(spark):
    old = [(1, "a\nb\nc\nb"), (2, "same\n"), (3, "gone"), (4, ""), (5, None), (6, "x\n" * 3000 + "end"), (7, "t\n\nt\n\n")]
    new = [(1, "b\nc\nc\nb\nd"), (2, "same\n"), (4, "new\n"), (5, "told"), (6, "x\n" * 2999 + "y\nend\n"), (7, "\nt\n\nt"), (8, "late")]
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in (old, new)]
    changes = line_script(*frames, "doc_id").cache()
    assert {r.doc_id for r in changes.select("doc_id").distinct().collect()} == {1, 3, 4, 5, 6, 7, 8}
    rebuilt = {r.doc_id: r.text for r in apply_script(frames[0], changes, "doc_id").collect()}
    assert rebuilt == dict(new)
    assert sorted((r.op, r.line) for r in changes.filter("doc_id = 6 AND op <> ' '").collect()) == [("+", ""), ("+", "y"), ("-", "x")]
    assert [(r.op, r.line) for r in changes.filter("doc_id = 3").collect()] == [("-", "gone")]
    assert line_script(frames[0].limit(0), frames[1].limit(0), "doc_id").count() == 0


def test_blocks_cover_a_range_once(spark):
    pairs = [(low, low + width) for low in (-70, -9, -1, 0, 1, 6, 4095) for width in (-1, 0, 1, 2, 7, 64, 300)]
    rows = spark.createDataFrame(pairs, "low long, high long").select("low", "high", range_blocks(F.col("low"), F.col("high")).alias("b")).collect()
    for r in rows:
        held = [x for b in r.b for x in range(b.number << b.level, (b.number + 1) << b.level)]
        assert sorted(held) == list(range(r.low, r.high + 1)) and len(r.b) <= 2 * max(1, (r.high - r.low + 2).bit_length())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join(spark, how):
    r = random.Random(3)
    points = [(k % 2, r.randint(-50, 50)) for k in range(60)] + [(0, None), (1, 7), (1, 7)]
    ranges = [(k % 2, k, low, low + r.choice([0, 3, 40, 10**15])) for k, low in enumerate(r.randint(-60, 60) for _ in range(25))]
    ranges += [(0, 90, 5, 4), (1, 91, None, 3), (0, 92, 1, 3), (0, 92, 1, 3)]
    got = interval_join(spark.createDataFrame(points, "g int, x int"), spark.createDataFrame(ranges, "g int, id int, low long, high long"),
                        "x", "low", "high", ("g",), how)
    want = []
    for g, x in points:
        found = [(g, x, k, a, b) for h, k, a, b in ranges if h == g and x is not None and a is not None and a <= x <= b]
        want += found or ([(g, x, None, None, None)] if how == "left" else [])
    assert sorted(map(repr, (tuple(t) for t in got.select("g", "x", "id", "low", "high").collect()))) == sorted(map(repr, want))


def test_interval_join_without_ranges(spark):
    points, none = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], "low int, high int")
    assert interval_join(points, none, "x", "low", "high").count() == 0
    assert interval_join(points, none, "x", "low", "high", how="left").collect() == [(1, None, None)]
