import random

import numpy as np

import corpus_pipeline as C
from strandloom.llm import jaccard as J
from strandloom.llm import simhash as S


def brute_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_groups(texts):
    own, root = [brute_sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] == own[j] or both and 10 * both >= 8 * len(own[i] | own[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def corpus(rnd):
    words = [f"w{i}" for i in range(300)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, texts = some(60), []
    for _ in range(40):
        texts.append(some(rnd.randint(1, 30)) + (passage if rnd.random() < 0.6 else []) + some(rnd.randint(0, 200)))
    for _ in range(160):
        new = list(rnd.choice(texts))
        for _ in range(rnd.randint(0, 4)):
            new[rnd.randrange(len(new))] = "Edit"
        texts.append(new)
    texts = [" ".join(t) for t in texts] + [None, "", " \n", "a b", "A  b", "a c"]
    rnd.shuffle(texts)
    return texts


def test_groups_match_brute_force(spark):
    for seed, sample in ((0, 1 << 20), (1, 20)):
        texts = corpus(random.Random(seed))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        root = brute_groups(texts)
        groups = {}
        for r in J.near_duplicates(docs, sample=sample, **{"split": 4} if seed else {"wave_bytes": 60_000}).collect():
            groups.setdefault(r.root, set()).add(r.doc_id)
        want = {}
        for i, r in enumerate(root):
            want.setdefault(r, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
        assert len(want) < len(texts) - 50


def test_stage_drops_near_copies(spark):
    """Two edits in 120 words: Jaccard above 0.8, but more than 4 bits apart in most fingerprints."""
    rnd = random.Random(3)
    rows = []
    for i in range(30):
        text = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        rows.append((i, " ".join(text)))
        text[40] = text[80] = "edit"
        rows.append((100 + i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in C.near_dedup(spark, docs, "").collect()) == list(range(30))
    assert C.near_dedup(spark, docs.limit(0), "").count() == 0


def test_stage_keeps_one_row_of_each_group(spark):
    """Rows that share a doc_id are rows of their own, and rows without one are searched as well."""
    a, b, c, d = ("a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x")
    rows = [(5, a, 0), (5, b, 1), (1, b, 2), (7, a, 3), (None, b, 4), (None, c, 5), (None, c, 5), (9, d, 6), (None, d, 7), (3, "", 8), (3, "y", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    got = C.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.x for r in got.collect()) == [0, 2, 5, 6, 8, 9]


def test_simhash_keep_one_names_rows(spark):
    rows = [(5, "a b c d e f", 0), (5, "g h i j k l", 1), (1, "g h i j k l", 2)]
    assert sorted(r.x for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, x int")).collect()) == [0, 2]


def test_bitmaps_lose_no_pair():
    r, kept = np.random.default_rng(1), 0
    for _ in range(100):
        k = int(r.integers(2, 12))
        base = r.integers(0, 1 << 64, int(r.integers(1, 700)), np.uint64, endpoint=False)
        own = []
        for share in r.choice([0.4, 0.7, 0.85, 0.93, 1.0], k):
            more = r.integers(0, 1 << 64, int(r.integers(0, len(base) // 5 + 1)), np.uint64, endpoint=False)
            own.append(np.unique(np.concatenate([base[:1], base[r.random(len(base)) < share], more])))
        n, root = np.array([len(x) for x in own]), r.integers(0, 6, k)
        got = J.may_link([np.frombuffer(J.bitmap(x).tobytes(), np.uint64) for x in own], n, root)
        for i in range(k):
            both = [len(np.intersect1d(own[i], x)) for x in own]
            if any(root[j] != root[i] and 10 * both[j] >= 8 * (n[i] + n[j] - both[j]) for j in range(k)):
                assert got[i]
                kept += 1
            elif all(root[j] == root[i] or both[j] < 0.5 * n[i] for j in range(k)):
                assert not got[i] or n[i] < 100
    assert kept > 50
