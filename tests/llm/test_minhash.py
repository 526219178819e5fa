"""Near duplicates against brute force over all pairs, and the edge cases of the docstring."""

import itertools
import random

from contrail.llm.components import components
from contrail.llm.minhash import near_duplicates


def brute(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def corpus(seed=3):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    rows = []
    for g in range(40):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 8, 40, 120]))]
        for _ in range(r.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w) if r.random() < .8 else "\t".join(w).upper())
    r.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = corpus() + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, None), (9005, "one two"), (9006, "ONE  two")]
    df = spark.createDataFrame([(t, d, 7, "x") for d, t in rows], "text string, doc_id long, n int, s string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_long_chain_of_links(spark):
    words = ["a%d" % i for i in range(400)]
    rows = [(100 - k, " ".join(words[5 * k:5 * k + 60])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)
    assert {v[1] for v in got.values()} == {61}


def test_null_id_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("None", None, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50, 0, -1)] + [(90, 91), (90, 92)], "a long, b long")
    got = dict(components(df).collect())
    assert got == {**{i: 1 for i in range(1, 52)}, 90: 90, 91: 90, 92: 90}
