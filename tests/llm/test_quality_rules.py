import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from creditscope.llm import quality_rules as rules
from creditscope.llm import textscan


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    n, r = len(words), len(cover)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, r, n < 10 or 100 * r > 20 * n)


def test_base_rules_match_brute_force(awkward):
    rows = rules.label_documents(awkward, rules.Model.neutral()).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        o = r.out
        got = (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words, o.base_failed)
        assert got == base(r.row.text)
        assert o.kept == (not o.base_failed)  # the neutral model calls every line content


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(2)
    first = np.array([0, 1, 1, 7, 12])
    emission = rng.normal(size=(12, 2))
    model = rules.Model(np.zeros((2, rules.N_FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
    got = rules.viterbi(emission, first, model)
    for a, b in zip(first[:-1], first[1:]):
        def score(path):
            own = model.start[path[0]] + sum(emission[a + i][y] for i, y in enumerate(path))
            return own + sum(model.step[x][y] for x, y in zip(path, path[1:]))
        if b > a:
            assert tuple(got[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=score)


def lines_of(texts):
    words = textscan.scan(pa.array(texts, pa.large_string()))
    return rules.read_lines(words, textscan.word_hashes(words))


def test_fit_climbs_the_exact_likelihood():
    texts = ["A plain sentence of some words.\nAnother plain sentence of words.", "home | login | cart\n$$$ *** ###",
             "Plain words again in a line.\nmenu | next | top"]
    label = np.array([0, 0, 1, 1, 0, 1])
    lines = lines_of(texts)
    model = rules.fit(lines, label, steps=200, penalty=1e-4)
    assert (rules.viterbi(rules.emissions(lines, model), lines.first, model) == label).all()

    def likelihood(m):
        total = 0.0
        e = rules.emissions(lines, m)
        for a, b in zip(lines.first[:-1], lines.first[1:]):
            every = {p: m.start[p[0]] + sum(e[a + i][y] for i, y in enumerate(p)) + sum(
                m.step[x][y] for x, y in zip(p, p[1:])) for p in itertools.product((0, 1), repeat=b - a)}
            total += every[tuple(label[a:b])] - np.log(sum(np.exp(v) for v in every.values()))
        return total
    assert likelihood(model) > likelihood(rules.Model.neutral()) + 1


def test_learned_rules_on_labels(spark, awkward, labels, no_rows):
    model = rules.learn(awkward, labels)
    assert rules.label_documents(awkward, model).count() == awkward.count()
    assert rules.label_documents(no_rows, model).collect() == []
    assert not rules.learn(no_rows, labels).emit.any()
    assert not rules.learn(awkward, labels.limit(0)).emit.any()
