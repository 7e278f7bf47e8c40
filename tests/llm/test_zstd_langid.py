import zlib

import pytest

from creditscope.llm import zstd_langid as langid
from creditscope.llm.queries import QUERIES
from tests.conftest import SF01


def test_held_out_accuracy(spark):
    rows = QUERIES["op10_language_id"](spark, SF01).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_matches_direct_compression(spark, awkward):
    learned = langid.learn_dictionaries(awkward)
    assert list(learned) == ["de", "en"]
    encoders = langid._encoders(learned)
    for r in langid.classify(awkward, learned).collect():
        text = {x.doc_id: x.text for x in awkward.collect()}[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cleaned = awkward.where(awkward.doc_id == r.doc_id).select(langid.letters("text").alias("t")).first()
        if r.doc_id is not None:
            sizes = langid.encoded_sizes(encoders, cleaned.t)
            assert r.lang_pred == ["de", "en"][min((0, 1), key=lambda i: sizes[i])]


def test_edges(spark, awkward, no_rows):
    assert langid.learn_dictionaries(no_rows) == {}
    assert {(r.lang_pred, r.score) for r in langid.classify(awkward, {}).collect()} == {("und", 0.0)}
    one = langid.learn_dictionaries(awkward.where("lang = 'en'"))
    assert {r.score for r in langid.classify(awkward, one).where("lang_pred = 'en'").collect()} == {1.0}
    assert langid.classify(no_rows, one).collect() == []
    many = spark.createDataFrame([(i, "text", f"l{i}") for i in range(12)], "doc_id long, text string, lang string")
    old, langid.MAX_LANGUAGES = langid.MAX_LANGUAGES, 10
    try:
        with pytest.raises(ValueError):
            langid.learn_dictionaries(many)
    finally:
        langid.MAX_LANGUAGES = old
