"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditscope.llm import (
    chat_windows,
    jaccard_join,
    lexical_rank,
    multi_index,
    packing,
    piece_codec,
    quality_lm,
    quality_rules,
    shuffle_shards,
    structure_repair,
    suffix_dedup,
    topk_index,
    zstd_langid,
)

from creditscope.llm.tables import shipped


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk_index.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    model = quality_rules.learn(documents, _read(spark, sf_dir, "labels"))
    judged = quality_rules.label_documents(documents, model, keep=["doc_id"])
    return judged.select("row.doc_id", "out.*")


def op5_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    trusted = quality_lm.trusted_documents(documents, _read(spark, sf_dir, "labels"))
    return quality_lm.classify(documents, trusted, order=quality_lm.ACROSS_ORDER, keep=["doc_id", "lang"],
                               across=True).select("row.*", "out.*")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    two = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")),
                            F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), two.alias("x")).select(
        "conv_id", F.col("x.turn").cast("long").alias("turn"), "x.role", said.alias("text"))
    return chat_windows.digests(chat_windows.windows(conversations.unionByName(extra)))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = piece_codec.Pieces.load(merges=True)
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = piece_codec.encode_documents(documents, pieces).select("row.*", "out.ids")
    decoded = piece_codec.decode_documents(encoded, pieces)
    return decoded.select("row.doc_id", F.size("row.ids").cast("long").alias("n_tokens"), "row.ids",
                          F.col("text").eqNullSafe(F.col("row.text")).alias("decoded_equal"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), keep=["doc_id"]))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_shards.external_shuffle(_read(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return placed.select(
        F.col("record.doc_id").alias("doc_id"), shuffle_shards.record_bytes("record.text").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(4))
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    learned = zstd_langid.learn_dictionaries(documents.where((fold != 2) & F.col("lang").isNotNull()))
    return zstd_langid.classify(documents, learned, "doc_id", "text", held_out)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    return structure_repair.digests(structure_repair.repair(structure_repair.damaged(conversations)), conversations)


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 50)


QUERIES = {name: shipped(fn) for name, fn in {
    "op1_packing": op1_packing,
    "op2_topk": op2_topk,
    "op3_jaccard": op3_jaccard,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_lm": op5_quality_lm,
    "op6_chat": op6_chat,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
    "op11_structure_repair": op11_structure_repair,
    "op12_multi_index": op12_multi_index,
    "op13_lexical_rank": op13_lexical_rank,
}.items()}

ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10""",
    "op13_lexical_rank": r"""
        WITH t AS (
            SELECT d.row, d.doc_id, unnest(regexp_extract_all(
                translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents) d),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE item_id IS NOT NULL),
        lengths AS (SELECT row, count(*) AS n FROM t GROUP BY row),
        totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
        tfs AS (SELECT row, doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
        adds AS (
            SELECT f.row, f.doc_id, f.term,
                CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
                * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS add
            FROM tfs f JOIN dfs USING (term) JOIN lengths l ON l.row = f.row, totals),
        scored AS (
            SELECT item_id, row, doc_id, CAST(sum(add) AS BIGINT) AS score
            FROM adds JOIN asked USING (term) GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
              FROM scored WHERE score > 0)
        WHERE rank <= 50""",
}
