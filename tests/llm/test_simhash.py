import random

import numpy as np
import pytest
import xxhash

from strandloom.llm import simhash as S
from strandloom.llm.components import components, local_roots


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints, distance=4):
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(rnd, fp, most):
    return fp ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, most)))


@pytest.mark.parametrize("seed,plan", [(0, None), (1, None), (2, S.Plan((tuple(range(32)), tuple(range(32, 64))), (2, 1))), (3, S.Plan((tuple(range(20)), tuple(range(20, 40)), tuple(range(40, 64))), (1, 1, 0)))])
def test_groups_match_brute_force(spark, seed, plan, monkeypatch):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    for i in range(150, 420):
        old = rows[rnd.randrange(20)][1].split()
        if old:
            old[rnd.randrange(len(old))] = "Ed"
        rows.append((i, " ".join(old)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "A B\tc"), (504, "a b c"), (504, "a b c"), (505, "É x"), (506, "long words " * 4000)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "a b c", "x")], "doc_id long, text string, fingerprint string").repartition(4)
    got = S.near_duplicates(docs, plan=plan).collect()
    assert len(got) == len(rows) + 1
    prints = [brute_print(t) for _, t in rows]
    root = brute_groups(prints)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    want = sorted((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [503]


def test_large_buckets_lose_no_link(monkeypatch):
    monkeypatch.setattr(S, "LARGE", 50)
    rnd = random.Random(5)
    for _ in range(5):
        centres = [rnd.getrandbits(64) for _ in range(8)]
        fps = sorted({near(rnd, rnd.choice(centres), 6) for _ in range(300)})
        root = S.linked_roots(np.array(fps, np.uint64), 4)
        want = brute_groups(fps)
        assert local_roots(len(fps), np.arange(len(fps)), root).tolist() == want


def test_allotment_is_the_cheapest():
    rnd = random.Random(1)
    for _ in range(50):
        costs = [[0.0] + sorted(rnd.random() * 10 for _ in range(5)) for _ in range(3)]
        cost, ts = S.allot(costs, 4)
        assert sum(t + 1 for t in ts) == 5
        import itertools

        assert cost == pytest.approx(min(sum(costs[i][t] for i, t in enumerate(x)) for x in itertools.product(range(6), repeat=3) if sum(x) == 5))


def test_components_of_a_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2)]
    random.Random(2).shuffle(rows)
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def test_empty_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(2, "a b c d e", 1), (1, "a b c d e", 2), (3, "other words are here now", 3), (1, "a b c d e", 2), (None, "a b c d e", 4)], "doc_id long, text string, x int")
    assert sorted(map(str, S.keep_one(docs).collect())) == sorted(map(str, docs.where("x IN (3, 4)").collect() + docs.where("x = 2").limit(1).collect()))
