import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from creditscope.llm import queries
from tests.conftest import SF001, SF01
from tests.llm.test_jaccard_join import brute as classes
from tests.llm.test_suffix_dedup import brute as passages
from tools.check_oracle import digest


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        duck.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in res.description]
    theirs = res.fetchall()
    assert sorted(df.columns) == sorted(columns) and len(rows) == len(theirs)
    assert digest(df.columns, rows)[0] == digest(columns, theirs)[0]


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]


def test_jaccard_query(spark, documents):
    rows = queries.QUERIES["op3_jaccard"](spark, SF001).collect()
    assert {r.doc_id: r.component_id for r in rows} == classes(documents)


def test_suffix_query(spark, documents):
    rows = queries.QUERIES["op8_suffix_dedup"](spark, SF001).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == passages(documents)


def test_codec_query(spark, documents):
    rows = queries.QUERIES["op7_sentencepiece"](spark, SF001).collect()
    assert len(rows) == len(documents) and all(r.decoded_equal and r.n_tokens == len(r.ids) for r in rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, kept = docs.columns, []
    from creditscope.llm.tables import stored
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, SF001), "stage")
        if name != "packing":
            assert result.columns == columns
            assert result.schema == docs.schema or result.dtypes == docs.dtypes
            kept.append({r.doc_id for r in result.select("doc_id").collect()})
            if name == "near copies":
                label = classes([(r.doc_id, r.text) for r in docs.collect()])
                assert kept[-1] == {i for i, c in label.items() if i == c}
            if name == "repeated passages":
                assert kept[-1] == kept[-2]
                removed = {i: n for i, _, n, _, _ in passages([(r.doc_id, r.text) for r in docs.collect()])}
                old = {r.doc_id: r.text for r in docs.collect()}
                for r in result.collect():
                    assert r.n_chars == len(r.text)
                    assert (r.text != old[r.doc_id]) == (removed[str(r.doc_id)] > 0)
            docs = result
        else:
            words = sum(len(r.text.split()) for r in docs.collect())
            assert sum(r.length for r in result.collect()) == words
    assert all(b <= a for a, b in zip(kept, kept[1:]))


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    got = {r.doc_id for r in corpus_pipeline.quality_model(spark, docs, SF01).select("doc_id").collect()}
    assert len(clean & got) >= 0.98 * len(clean) and len(bad & got) <= 0.3 * len(bad)
    got = {r.doc_id for r in corpus_pipeline.line_rules(spark, docs, SF01).select("doc_id").collect()}
    assert len(clean & got) >= 0.95 * len(clean) and len(bad & got) <= 0.1 * len(bad)


def test_pipeline_of_awkward_and_no_rows(spark, awkward, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", awkward), ("none", awkward.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        ids = {r.doc_id for r in awkward.collect()} if name == "odd" else set()
        assert {r.doc_id for r in rows} <= ids


def test_near_copies_with_clashing_names(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, 5, 6), (2, text, 7, 8), (3, "other words", 9, 9)], "doc_id long, text string, spare long, `a.b` long")
    kept = corpus_pipeline.near_copies(spark, docs, SF001)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, text, 5, 6), (3, "other words", 9, 9)] and kept.columns == docs.columns
