"""Small cases of the corpus operators: brute force, round trips, empty tables, nulls, repeats, clashing columns."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import article_text, co_training, common, exact_copies, language_codes, near_vectors, packing, shingle_join, token_cache, token_codec
from panelwright.llm.common import components, reference_tokenizer, tokenizer_path
from panelwright.llm.language_model import fit, new_network, text_likelihood, text_scores
from panelwright.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from panelwright.session import shared_dir

TEXTS = ["Retail sales rose 3.1% in May, it's said.", "Retail sales rose 3.1% in May, it's said.", None, "", "  \n\t ", "<|endoftext|> and CPI",
         "消费价格同比上涨1.2%", "word " * 900, "A'S 'll don't\n\n x", "é é ½ 🙂", "one two three four", "ONE two three four"]


@pytest.fixture(scope="module")
def reports(spark):
    rows = [(k, t, "en", "src", 5, 1, 2) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "src", 5, 1, 2), (None, "no id", None, None, None, 1, 2)]
    return spark.createDataFrame(rows, "report_id long, text string, lang string, source string, n_chars long, digest int, tokens int")


def rows_of(frame, key="report_id"):
    out = {}
    for r in frame.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_exact_copies(reports):
    got = rows_of(exact_copies.exact_copies(reports))
    assert sum(map(len, got.values())) == len(TEXTS) + 1
    assert got[0][0].keep_id == 1 and got[0][0].group_size == 3 and not got[0][0].kept and got[1][0].kept
    assert got[2][0].keep_id == 3 and got[5][0].group_size == 1
    assert got[0][0].text_sha256 == hashlib.sha256(TEXTS[0].encode()).hexdigest()
    assert exact_copies.exact_copies(reports.limit(0)).count() == 0


def test_token_codec_and_counts_agree_with_the_library(spark, reports):
    path = tokenizer_path(BYTE_VOCABULARY)
    library = reference_tokenizer(path)
    coded = rows_of(token_codec.round_trip(reports, path))
    cache = shared_dir(spark, f"cache-{np.random.default_rng().integers(1 << 60)}")
    counted = rows_of(token_cache.token_counts(reports, cache, path))
    again = rows_of(token_cache.token_counts(reports, cache, path))
    stored = spark.read.parquet(cache).select("digest").distinct().count()
    assert stored == len({t or "" for t in TEXTS})
    for k, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(coded[k][0].ids, "<u4").tolist() == ids
        assert coded[k][0].text_bytes.decode() == library.decode(ids, skip_special_tokens=False)
        assert (counted[k][0].n_tokens, counted[k][0].n_bytes) == (len(ids), len((text or "").encode()))
    assert again == counted and len(counted[0]) == 2


def test_joined_chunks_equal_the_whole_text():
    path = tokenizer_path(BYTE_VOCABULARY)
    library = reference_tokenizer(path)
    rng = np.random.default_rng(0)
    parts = ["the", " the", "  ", "\n", "it's", "ing", ".", "é", "1234", " "]
    for _ in range(20):
        raw = "".join(rng.choice(parts, 3000)).encode()
        cuts = token_codec.cut_points(raw)
        known = {token_codec.chunk_digest(raw[a:b]): np.array(library.encode(raw[a:b].decode()).ids, "<u2").tobytes() for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.7}
        assert token_codec.encode_with(raw, known, path).tolist() == library.encode(raw.decode()).ids


def test_packing_holds_every_id_once(reports):
    path = tokenizer_path(WORD_VOCABULARY)
    pieces = packing.packed(reports.where("report_id > 0"), path, capacity=256, windows=2).collect()
    library = reference_tokenizer(path)
    for k, text in list(enumerate(TEXTS))[1:]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((p for p in pieces if p.report_id == k), key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and sum(p.length for p in own) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids) for p in own)
    for sequence in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == sequence), key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and sum(p.length for p in own) <= 256


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    x = np.vstack([base, base[:10] + 0.05 * rng.standard_normal((10, 16)), base[:3]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [])]
    got = rows_of(near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    close = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1) >= 0.95
    for k in range(len(x)):
        assert got[k][0].n_links == close[k].sum() - 1 and got[k][0].component_id == np.flatnonzero(close[k])[0]
    assert all(got[k][0].n_links == 0 and got[k][0].kept for k in (100, 101, 102, 103))
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_shingle_components_against_brute_force(spark):
    rng = np.random.default_rng(2)
    lexicon = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choice(lexicon, 60).tolist()
        for edits in (0, 0, 1, 1, 2, 3, 6):
            words = base[:]
            for at in rng.choice(60, edits, replace=False):
                words[at] = "new"
            texts.append(" ".join(words))
    texts += [None, "", "a b", "A b", "a b c"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    got = rows_of(shingle_join.shingle_components(spark.createDataFrame(list(enumerate(texts)), "report_id long, text string")))
    assert [got[k][0].component_id for k in range(len(texts))] == label
    assert [got[k][0].n_shingles for k in range(len(texts))] == [len(s) for s in sets]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.v: r.label for r in components(edges).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_components_write_no_round_that_changes_nothing(spark, monkeypatch):
    written, real = [], common.staged
    monkeypatch.setattr(common, "staged", lambda *a: (written.append(a), real(*a))[1])
    stars = [(k, k % 3) for k in range(3, 40)]
    found = components(spark.createDataFrame(stars + [(b, a) for a, b in stars], "a long, b long"))
    assert {r.v: r.label for r in found.collect()} == {k: k % 3 for k in range(40)} and len(written) == 1
    rng = np.random.default_rng(4)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (180, 2))]
    label = {v: v for a, b in edges for v in (a, b) if a != b}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_cut_offs_take_the_stated_shares():
    rng = np.random.default_rng(2)
    raw, luck = rng.normal(0, 2, 50_000), rng.integers(0, co_training.LUCK, 50_000)
    found = co_training.places(raw)
    cut = co_training.cut_offs(Counter(found.tolist()), 1000, 5000)
    poor, good = co_training.taken(found, luck, cut)
    assert abs(poor.sum() - 1000) < 60 and abs(good.sum() - 5000) < 60
    assert raw[poor].max() < np.sort(raw)[1100] and raw[good].min() > np.sort(raw)[-5500]
    assert co_training.cut_offs({0: 9, -70: 1, 90: 2}, 5, 5) == (-co_training.STEP, 0, co_training.STEP - 1, 0)


def test_every_unlabelled_report_enters_the_exchange(spark, monkeypatch):
    """More reports than the pool holds: all are scored in each round, less those taken in earlier ones."""
    good, poor = "the retail sales of the month rose and the index fell in may ", "zz zz 00 || zz zz 00 || "
    rows = [(k, (good if k % 2 else poor) * (1 + k % 5) + str(k), "en", "s", 9) for k in range(400)]
    docs = spark.createDataFrame(rows, "report_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "report_id long, quality int")
    monkeypatch.setattr(co_training, "POOL", 20)
    seen, real = [], co_training.exchange

    def watched(unlabelled, sides, before, n):
        out = real(unlabelled, sides, before, n)
        seen.append((unlabelled.count(), out[2]))
        return out

    monkeypatch.setattr(co_training, "exchange", watched)
    judged = co_training.co_trained_quality(docs, labels).collect()
    assert seen and all(s == (360, 360) for s in seen)
    assert all(r.kept == bool(r.report_id % 2) for r in judged)


def test_the_driver_holds_the_sample_of_the_quality_classifier_once(spark, monkeypatch):
    n = 2000
    docs = spark.createDataFrame([(k, f"report {k * 7919} " + ("rates rose " if k % 2 else "buy now ") * (k % 9), "a", "en", 5) for k in range(n)],
                                 "report_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(n // 2)], "report_id long, quality int")
    held, real = [], co_training.View.fit
    monkeypatch.setattr(co_training.View, "fit", lambda *a: (held.append(tracemalloc.get_traced_memory()[0]), real(*a))[1])
    monkeypatch.setattr(co_training, "exchange", lambda *a: ([], None, n))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    co_training.co_trained_quality(docs, labels)
    tracemalloc.stop()
    # the labelled half, and the rows that are fitted on
    assert held and max(held) - before < 1.5 * n * 4 * (co_training.GRAMS + 4)


def test_the_quality_classifier_runs_few_tasks_and_sends_the_driver_no_rows_of_its_sample(spark, monkeypatch):
    """The driver's memory follows the tasks it tracks: the labelled sample is chosen once, and a round picks all its lessons at once."""
    good, poor = "the retail sales of the month rose and the index fell in may ", "zz zz 00 || zz zz 00 || "
    docs = spark.createDataFrame([(k, (good if k % 2 else poor) * (1 + k % 5) + str(k), "en", "s", 9) for k in range(400)],
                                 "report_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "report_id long, quality int")
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("rows of the sample pass through the driver's heap"))
    collected, real = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: (collected.append(self), real(self))[1])
    lessons, made = [], co_training.exchange
    monkeypatch.setattr(co_training, "exchange", lambda *a: (lessons.append(made(*a)), lessons[-1])[1])
    co_training.co_trained_quality(docs, labels)
    assert len(lessons) == co_training.ROUNDS and len(collected) == 3 * co_training.ROUNDS
    for cuts, told, n in lessons:
        assert n == 360 and set(told["label"].to_pylist()) <= {0, 1, 2, 3}
    assert len(lessons[0][1]) > 0


def test_lessons_are_the_first_of_their_label_by_hash(spark, monkeypatch):
    """Both views' picks of a round against a plain choice, with repeated rows and ids that have two texts."""
    rng = np.random.default_rng(8)
    rows = [(int(k) % 500, int(k) % co_training.LUCK, int(one), int(two)) for k, (one, two) in enumerate(rng.integers(-400, 400, (900, 2)))]
    left = spark.createDataFrame(rows + rows[:50], "report_id long, luck int, one int, two int")
    monkeypatch.setattr(co_training, "materialized", lambda frame: left)
    monkeypatch.setattr(co_training, "TAUGHT", 300)
    told, real = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (told.append([tuple(r) for r in data]), real(self, data, *a, **b))[1])
    docs = real(spark, [(k, f"text {k}", "en", "s", 9) for k in range(500)], "report_id long, text string, lang string, source string, n_chars long")
    cuts, lessons, n = co_training.exchange(docs, [], [], 0)
    hashes = {r[0]: r[1] for r in docs.selectExpr("report_id", "xxhash64(report_id, 'lesson')").collect()}
    want, free = [], rows + rows[:50]
    for k in (0, 1):
        flags = [co_training.taken(r[2 + k], r[1], cuts[k]) for r in free]
        for value, most in ((0, int(co_training.POOR * 300)), (1, int(co_training.GOOD * 300))):
            ids = {r[0] for r, f in zip(free, flags) if f[value]}
            want += [(i, 2 * (1 - k) + value) for i in sorted(ids, key=hashes.get)[:most]]
        free = [r for r, f in zip(free, flags) if not any(f)]
    assert n == 950 and want and sorted(told[-1]) == sorted(want) and len(lessons) == len(want)


def test_rows_of_features_keep_their_order_over_chunks():
    import pyarrow as pa

    rows = np.arange(12, dtype=np.float32).reshape(6, 2)
    blobs = pa.array([r.tobytes() for r in rows])
    column = pa.chunked_array([blobs[:0], blobs[:2], blobs[2:5], blobs[5:]])
    order = np.array([5, 0, 3])
    assert (co_training.matrix(column, order) == rows[order]).all()
    table = pa.table({"a": [2, 1, 2, 1, 0, 1], "b": column})
    assert co_training.ordered(table, "a").tolist() == [4, 1, 3, 5, 0, 2]


def test_quality_and_language(spark, reports):
    labels = spark.createDataFrame([(0, 1), (1, 0), (99, 0)], "report_id long, quality int")
    assert co_training.co_trained_quality(reports, labels).count() == len(TEXTS) + 1
    alone = co_training.co_trained_quality(reports, labels.where("quality = 1")).collect()
    assert all(r.kept and r.score == 0.5 for r in alone)
    words = {"en": "the of and this is from with", "de": "der die und nicht ist von ein"}
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(words[lang].split(), 20)), lang) for k in range(120) for lang in [("en", "de")[k % 2]]]
    made = spark.createDataFrame(rows + [(500, None, "en"), (501, "12 34 !", "en"), (502, "", None)], "report_id long, text string, lang string")
    got = rows_of(language_codes.languages(made))
    assert all(got[k][0].lang_pred == lang and 0 <= got[k][0].score <= 1 for k, _, lang in rows)
    assert all(got[k][0].lang_pred == "und" for k in (500, 501, 502))
    assert language_codes.codewords(7).shape[0] == 7


def test_article_text(spark):
    page = ("<html><body><header><a href=x>Home</a></header><div class='cookie-notice'>We use cookies here.</div><article><h1>GDP &amp; CPI</h1><p>First   para<p>Two</p>"
            "<script>x</script></article><section id=comments><p>A long reader comment with many words in it.</p></section><footer>(c)</footer></body></html>")
    frame = spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, source_url string, html string")
    got = rows_of(article_text.article_text(frame), "page_id")
    assert got[1][0].text == "GDP & CPI\nFirst para\nTwo" and got[1][0].n_chars == 24 and got[2][0].text == ""


def test_network_likelihood_does_not_depend_on_the_batch():
    net = new_network()
    net["classes"] = net["classes"] + np.random.default_rng(3).standard_normal(net["classes"].shape).astype("float32")
    texts = [np.array([5, 9, 700, 1], np.int32), np.array([1], np.int32), np.array([3] * 200 + [1], np.int32)]
    together = text_scores(net, texts)
    assert np.allclose(together, [text_scores(net, [t])[0] for t in texts], atol=1e-3) and (together < 0).all()


def test_likelihood_against_brute_force(spark, reports):
    got = rows_of(text_likelihood(reports))
    rows = [(r.report_id, re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) + ["<end>"])
            for r in reports.collect() if r.report_id is not None]
    learnt = Counter(w for k, own in rows if zlib.crc32(str(k).encode()) % 7 != 2 for w in own)
    total, distinct = sum(learnt.values()), len(learnt)
    assert sum(map(len, got.values())) == len(rows)
    for k, own in rows:
        r = got[k][0]
        assert r.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(learnt[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((learnt[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert got[0][0] == got[0][1] and text_likelihood(reports.limit(0)).count() == 0


def test_likelihood_learns_word_order(spark):
    rng = np.random.default_rng(6)
    follows = {w: rng.choice(60, 2) for w in range(60)}
    texts = []
    for _ in range(400):
        words = [int(rng.integers(60))]
        while len(words) < 40:
            words.append(int(rng.choice(follows[words[-1]])))
        texts.append(" ".join(f"w{w}" for w in words))
    told = text_likelihood(spark.createDataFrame(list(enumerate(texts)), "report_id long, text string")).where("held_out").collect()
    assert len(told) > 30 and sum(r.score for r in told) > 0.95 * sum(r.base_score for r in told)


def test_a_very_long_text_gets_few_lanes():
    long, short = np.full(200_000, 5, np.int32), [np.array([7, 1], np.int32)] * 50
    net = fit(new_network(), [long[:5000], *short], 0)
    assert np.isclose(text_scores(net, [long, *short])[1], text_scores(net, short)[0], atol=1e-3) and np.isfinite(text_scores(net, [long])).all()


def test_numerals_are_no_letters():
    assert not any(map(language_codes.has_letter, ["", "½", "²", "Ⅷ", "12 ½ ①", "_-_", "🙂"]))
    assert all(map(language_codes.has_letter, ["a", "½ é", "Ⅷ x", "中", "ª"]))


def test_clashing_and_repeated_rows_of_the_classifiers(spark):
    from panelwright.llm.common import near_ids, without
    from panelwright.llm.queries import reports as as_reports

    rows = [(k % 40, f"good text number {k}" if k % 2 else "buy now " * 9, "en", "s", 9, 1, 2) for k in range(400)] + [(7, "one text", "en", "s", 9, 1, 2)] * 500
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, report_id int, _bucket int")
    plain = as_reports(frame)
    assert plain.columns.count("report_id") == 1 and plain.schema["report_id"].dataType.simpleString() == "bigint"
    found = language_codes.languages(plain)
    assert found.count() == 900 and {r.held_out for r in found.select("report_id", "held_out").where("report_id = 7").collect()} == {zlib.crc32(b"7") % 5 == 0}
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(k + 10_000, 0) for k in range(5000)], "report_id long, quality int")
    judged = co_training.co_trained_quality(plain, labels).collect()
    assert len(judged) == 900 and {r.kept for r in judged} == {True, False}  # labels without a report do not crowd out the others
    ids = spark.createDataFrame([(7,)], "doc_id long")
    assert without(frame, "doc_id", ids).columns == frame.columns and without(frame, "doc_id", ids).where("doc_id = 7").count() == 0
    assert near_ids(frame, "doc_id", ids).where("doc_id = 7").count() == 510


@pytest.mark.parametrize("name", ["round_trip", "quality", "article", "packed", "counts", "language", "archive"])
def test_empty_tables(spark, name):
    empty = spark.createDataFrame([], "report_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, source_url string, html string")
    labels = spark.createDataFrame([], "report_id long, quality int")
    made = {
        "round_trip": lambda: token_codec.round_trip(empty, tokenizer_path(BYTE_VOCABULARY)), "quality": lambda: co_training.co_trained_quality(empty, labels),
        "article": lambda: article_text.article_text(pages), "packed": lambda: packing.packed(empty, tokenizer_path(WORD_VOCABULARY)),
        "counts": lambda: token_cache.token_counts(empty, shared_dir(spark, f"cache-{np.random.default_rng().integers(1 << 60)}"), tokenizer_path(BYTE_VOCABULARY)),
        "language": lambda: language_codes.languages(empty), "archive": lambda: exact_copies.exact_copies(empty)}
    assert made[name]().count() == 0
