"""The pipeline's stages against brute force on their own input, and held-out accuracy of its two classifiers."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from panelwright.llm import co_training, language_codes
from panelwright.llm.common import reference_tokenizer, tokenizer_path
from panelwright.llm.queries import WORD_VOCABULARY, reports

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) rows of every stage, run one after the other as the pipeline does; each output is a list of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        found[name] = (docs, out, docs.collect(), out.collect())
        docs = out
    return found


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_stages_keep_the_columns_of_documents(stages):
    for name, (docs, out, before, after) in stages.items():
        assert before and after
        if name != "packing":
            assert out.columns == docs.columns and {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_quality_stage_drops_what_the_classifier_rejects(spark, stages):
    docs, _, before, after = stages["quality classifier"]
    judged = co_training.co_trained_quality(reports(docs), reports(spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in after} == {r.report_id for r in judged.collect() if r.kept} and len(after) < len(before)


def test_language_stage_drops_what_has_no_letter(stages):
    _, _, before, after = stages["language ID"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}


def test_exact_stage_keeps_the_largest_id_of_equal_texts(stages):
    _, _, before, after = stages["exact dedup"]
    largest = {}
    for r in before:
        largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(largest.values())


def test_near_stage_keeps_one_document_of_each_group(stages):
    _, _, before, after = stages["n-gram Jaccard join"]
    rows = sorted(before, key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))

    def first(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = first(i), first(j)
                group[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in after) == [r.doc_id for k, r in enumerate(rows) if first(k) == k]


def test_packing_stage_holds_every_id_of_every_document_once(stages):
    _, _, before, after = stages["packing"]
    library = reference_tokenizer(tokenizer_path(WORD_VOCABULARY))
    pieces, sequences = {}, {}
    for p in after:
        pieces.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(pieces) == {r.doc_id for r in before}
    for r in before:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and sum(p.length for p in own) <= 4096


def test_empty_documents_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        assert docs.count() == 0


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs = reports(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = reports(spark.read.parquet(f"{sf}/labels.parquet"))
    truth = {r.report_id: r.quality for r in labels.collect() if r.quality is not None}
    judged = co_training.co_trained_quality(docs, labels.where("crc32(string(report_id)) % 3 <> 0")).collect()
    tests = [(r.kept, truth[r.report_id]) for r in judged if r.report_id in truth and zlib.crc32(str(r.report_id).encode()) % 3 == 0]
    assert len(tests) > 50 and sum(k == bool(q) for k, q in tests) / len(tests) >= 0.9
    lang = {r.report_id: r.lang for r in docs.collect()}
    told = [r for r in language_codes.languages(docs).collect() if zlib.crc32(str(r.report_id).encode()) % 5 == 0 and lang[r.report_id] and r.lang_pred != "und"]
    assert len(told) > 100 and sum(r.lang_pred == lang[r.report_id] for r in told) / len(told) >= 0.95
