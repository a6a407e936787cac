import random

import numpy as np
import pytest

from strandloom.llm import ngrams as N


def brute(rows, words=3, percent=90):
    """(doc_id, n, component) of rows, every pair compared."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words, 0) + 1)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root)), key=repr)


def corpus(rnd, size):
    words = [f"w{i}" for i in range(400)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    passage = some(80)
    texts = [some(rnd.randint(1, 40)) + (passage if rnd.random() < 0.5 else []) + some(rnd.randint(0, 250)) for _ in range(size // 6)]
    while len(texts) < size:
        new = list(rnd.choice(texts[: size // 3]))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            new[rnd.randrange(len(new))] = "Edit" + str(rnd.randrange(99))
        texts.append(new)
    return [" ".join(t) for t in texts]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in N.near_duplicates(df, **options).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"words": 2, "percent": 75, "block": 8}])
def test_components_equal_brute_force(spark, options):
    texts = corpus(random.Random(3), 240) + [None, "", " \n", "a b", "A  b", "a c", "a", "one two three", "One\ttwo  three"]
    rows = list(enumerate(texts))
    got, want = found(spark, rows, **options), brute(rows, options.get("words", 3), options.get("percent", 90))
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 40


def test_a_family_around_an_original_meets_by_its_hub(spark):
    rnd = random.Random(8)
    base = [f"x{rnd.randrange(10**6)}" for _ in range(200)]
    family = []
    for i in range(150):  # each near the original, most not near each other; some linked to others only
        new = list(base)
        for k in range(rnd.randint(1, 5)):
            new[rnd.randrange(200)] = f"e{i}-{k}"
        family.append(" ".join(new))
    rows = list(enumerate([" ".join(base), *family, " ".join(base)]))
    assert found(spark, rows, block=16) == brute(rows)


def test_no_filter_drops_a_link():
    rnd = np.random.default_rng(0)
    for _ in range(400):
        n = int(rnd.integers(10, 3000))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[rnd.random(len(a)) < 0.96], rnd.integers(0, 2**63, max(1, n // 30)).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        either = len(a) + len(b) - both
        size = [np.frombuffer(N.part_sizes(x), np.uint8) for x in (a, b)]
        assert N.apart(*size) <= either - both
        if 100 * both >= 90 * either:
            assert either - both <= N.allowed(len(a), len(b), 90)
            assert len(np.intersect1d(a[: N.prefix_size(len(a), 90)], b[: N.prefix_size(len(b), 90)]))


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (9, None), (9, ""), (None, None), (None, "only here x y"), (2, "long " * 20000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    wide = spark.createDataFrame([(1, "a b c", 4, "x"), (2, "a b c", 5, "y")], "doc_id long, text string, key int, NODE string")
    assert [tuple(r) for r in N.near_duplicates(wide).orderBy("doc_id").collect()] == [(1, 1, 1), (2, 1, 1)]
