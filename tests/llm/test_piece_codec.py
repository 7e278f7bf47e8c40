import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from creditscope.llm import piece_codec as codec
from tests.llm.conftest import TEXTS

sentencepiece = pytest.importorskip("sentencepiece")


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def as_unigram(path, scale):
    """The model file with unigram type and scores of like size."""
    data, at, out = open(path, "rb").read(), 0, b""
    while at < len(data):
        begin = at
        key, at = codec._varint(data, at)
        size, at = codec._varint(data, at)
        value = data[at:at + size]
        at += size
        if key >> 3 == 1:
            own = dict(codec._fields(value))
            score = max(struct.unpack("<f", own[2])[0] if 2 in own else 0.0, -40000.0) / scale
            value = b"\x0a" + varint(len(own[1])) + own[1] + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(own.get(3, 1))
            out += b"\x0a" + varint(len(value)) + value
        else:
            out += data[begin:at]
    return out + bytes([0x12, 2, 0x18, 1])


@pytest.fixture(scope="module")
def pieces():
    return codec.Pieces.load()


def encode(texts, pieces):
    ids, offsets = codec.encode(pa.array(texts, pa.large_string()), pieces)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_same_score_as_the_library(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(as_unigram(codec.MODEL_PATH, 1000))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    pieces = codec.Pieces.load(str(path))
    score = dict(zip(pieces.ids.tolist(), pieces.scores.tolist()))
    texts = ["Hello world", " two  spaces", "a\tb\nc", "Schön, 中文字 und \U0001F600!", "xyzzyqqq", "1234567", ""]
    texts += [t[:300] for t in TEXTS if t and "▁" not in t]
    same = 0
    for text, own in zip(texts, encode(texts, pieces)):
        theirs = library.encode(text)
        same += own == theirs
        # Equal sums may be cut differently; byte pieces cost the unknown score each way.
        assert sum(score.get(i, 0) for i in own) == pytest.approx(sum(score.get(i, 0) for i in theirs), rel=1e-5)
        assert library.decode(own) == text
    assert same >= len(texts) - 3


def test_brute_force_segmentation(pieces):
    score = dict(zip(pieces.keys.tolist(), pieces.scores.tolist()))
    def best(chunk):
        data = b" " + chunk.encode()
        value = [0.0] + [-np.inf] * len(data)
        for e in range(1, len(data) + 1):
            for b in range(max(0, e - pieces.longest), e):
                key = int(codec._keys(np.frombuffer(data[b:e], np.uint8)[None])[0, -1])
                if key in score:
                    value[e] = max(value[e], value[b] + score[key])
        return value[-1]
    by_id = dict(zip(pieces.ids.tolist(), pieces.scores.tolist()))
    for word in ("unbelievable", "thntreor", "keitschaft", "a", "zzzz"):
        assert sum(by_id[i] for i in encode([word], pieces)[0]) == pytest.approx(best(word))


def test_documents_decode_to_themselves(awkward, no_rows, pieces):
    encoded = codec.encode_documents(awkward, pieces).select("row.*", "out.ids")
    back = codec.decode_documents(encoded, pieces).collect()
    assert len(back) == awkward.count()
    for r in back:
        assert r.text == r.row.text
        assert (r.row.ids is None) == (r.row.text is None)
    assert codec.encode_documents(no_rows, pieces).collect() == []


def test_merges_give_the_librarys_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL_PATH)
    merging = codec.Pieces.load(merges=True)
    rng = random.Random(11)
    texts = ["Hello world", " two  spaces", "a\tb\nc", "Schön, 中文字 und \U0001F600!", "xyzzyqqq", "1234567", "", "  ",
             " " * 37 + "x" + " " * 9, "ab" * 4000, "的" * 300 + "\U0001F600" * 70, "é\u0301<0x0A><s></s><unk>"]
    texts += [t for t in TEXTS if t and "▁" not in t]
    texts += ["".join(rng.choices("aeinrst  .,öß中\u0301\x00\n", k=rng.randint(1, 90))) for _ in range(400)]
    assert encode(texts, merging) == [library.encode(t) for t in texts]


def test_query_gives_the_librarys_ids(spark):
    from creditscope.llm import queries

    library = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL_PATH)
    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(text)
    for r in rows:
        if text[r.doc_id] is not None and "▁" not in text[r.doc_id]:
            assert list(r.ids) == library.encode(text[r.doc_id])
        assert r.decoded_equal


def test_merges_need_a_bpe_model(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(as_unigram(codec.MODEL_PATH, 1000))
    with pytest.raises(ValueError, match="BPE"):
        codec.Pieces.load(str(path), merges=True)
