import itertools
import random
import re
from collections import Counter

from creditscope.llm import packing


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        align, k = rng.choice([1, 2, 4]), rng.randint(1, 4)
        lengths = [rng.randint(1, 24) for _ in range(rng.randint(1, 30))]
        bounds = packing.choose_bounds(Counter(lengths), k, 24, align)
        top = -(-max(lengths) // align) * align
        least = min(padding(lengths, [*c, top]) for r in range(k)
                    for c in itertools.combinations(range(align, top, align), min(r, k - 1)))
        assert len(bounds) <= k and padding(lengths, bounds) == least, (lengths, bounds)


def test_no_rows(no_rows):
    assert packing.pack(no_rows).collect() == []
    assert packing.choose_bounds({}) == []


def test_every_token_is_packed_once(awkward):
    rows = packing.pack(awkward, max_len=512, token_budget=2048).collect()
    words = Counter()
    for r in awkward.collect():
        words[r.doc_id] += len((r.text or "").split())
    packed = Counter()
    for r in rows:
        packed[r.doc_id] += r.length
        assert 1 <= r.length <= r.bucket_len <= 512
    assert packed == +words
    batches = Counter((r.bucket_len, r.batch) for r in rows)
    last = {b: max(n for c, n in batches if c == b) for b, _ in batches}
    for (b, n), size in batches.items():
        full = max(1, 2048 // b)
        assert size == full or (n == last[b] and size < full)
    assert len({(r.bucket_len, r.batch, r.place) for r in rows}) == len(rows)


def test_words_are_counted_without_being_held(spark):
    texts = [None, "", " \n ", "\x0b\x0c a\x1cb\x85c", "\xa0 \u2003x\t", "\U0001F600 \U0001F600\U0001F600 \x00", "\r\n$1 \\x\n\nx"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counted = rows.select("doc_id", packing.word_count().alias("n"))
    assert {r.doc_id: r.n for r in counted.collect()} == {
        i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    # No plan node turns a text into an array of its words, whatever its length.
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "extract_all" not in plan and "split" not in plan, plan


def test_texts_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/texts")
    packed = packing.pack(spark.read.parquet(f"{tmp_path}/texts"))
    assert packed.count() == 2
    assert not any(f.endswith(".parquet") and "/texts/" in f for f in packed.inputFiles())
