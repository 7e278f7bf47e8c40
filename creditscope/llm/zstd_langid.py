"""Language ID by compression: the language whose dictionary shortens a text most.

For each language a raw-content zstandard dictionary is cut from a bounded sample
of labelled texts: the documents with the smallest seeded hash in each of
``SLOTS`` hash slots, ``SLICE_CHARS`` from the middle of each.  Texts are reduced to
lower-case letters and single spaces and cut into pieces of ``PIECE_BYTES`` (all of
a text is encoded), every piece is compressed with every dictionary, and the
smallest sum wins.  A margin under ``NARROW`` marks the prediction as rejected.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
ties go to the alphabetically first language; with one learned language the score
is 1; with none every text is ``und``; repeated rows are predicted alike; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 256
SLICE_CHARS = 500
PIECE_BYTES = 8192
NARROW = 0.005
LEVEL = 9
#: More languages than this are an input error (dictionaries travel with every task).
MAX_LANGUAGES = 1000
SEED = 7


def letters(text: str) -> Column:
    """Lower-case letters, anything else as one space; null without a letter."""
    value = F.col(text)
    return F.when(value.rlike(r"\p{L}"), F.lower(F.regexp_replace(value, r"\P{L}+", " ")))


def learn_dictionaries(labelled: DataFrame, id_col: str = "doc_id", text: str = "text",
                       lang: str = "lang") -> dict[str, bytes]:
    """At most ``SLOTS * SLICE_CHARS`` characters of each language."""
    rows = labelled.select(
        letters(text).alias("t"), F.col(lang).alias("l"),
        F.xxhash64(F.lit(SEED), F.col(id_col), F.crc32(F.encode(F.col(text), "utf-8"))).alias("h")
    ).where("l is not null and t is not null")
    rows = rows.withColumn("slot", F.pmod(F.shiftrightunsigned("h", 40), F.lit(SLOTS)))
    chosen = rows.groupBy("l", "slot").agg(F.min("h").alias("h"))
    if chosen.select("l").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    middle = F.greatest(F.lit(1), F.floor((F.length("t") - SLICE_CHARS) / 2) + 1).cast("int")
    cut = rows.select("l", "h", F.substring(F.col("t"), middle, F.lit(SLICE_CHARS)).alias("t"))
    sample = cut.join(chosen.select("l", "h"), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t"))
    pieces: dict[str, list[str]] = {}
    for r in sample.orderBy("l", "h").collect():  # bounded: SLOTS rows for each language
        pieces.setdefault(r["l"], []).append(r["t"])
    return {k: "\n".join(v).encode() for k, v in sorted(pieces.items())}


def _encoders(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in dictionaries.values():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False))
    return out


def encoded_sizes(encoders: list[zstandard.ZstdCompressor], text: str) -> list[int]:
    data = text.encode()
    pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
    return [sum(len(e.compress(p)) for p in pieces) for e in encoders]


def classify(documents: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id",
             text: str = "text", *keep: Column) -> DataFrame:
    """Per row: the id, ``keep``, ``lang_pred``, ``score`` (0 to 1: the share by which
    the winner is shorter than the runner-up) and ``rejected``."""
    names = list(dictionaries)
    rows = documents.select(F.col(id_col).alias("doc_id"), *keep,
                            letters(text).alias("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + ["lang_pred string", "score double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(dictionaries)
        for batch in batches:
            langs, scores = [], []
            for value in batch.column("text"):
                value = value.as_py()
                if value is None or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                sizes = encoded_sizes(encoders, value)
                order = sorted(range(len(names)), key=lambda i: (sizes[i], i))
                langs.append(names[order[0]])
                scores.append(1.0 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0)
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([s < NARROW for s in scores], pa.bool_())],
                names=[*[f.name for f in kept], "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)
