import random

import numpy as np
import pytest

from strandloom.llm import packing as P


def bfd(lengths, capacity):
    """Best fit decreasing by its definition: bins' remaining rooms."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return rooms


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([5, 16, 100])
    lengths = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 300))]
    hist = {n: lengths.count(n) for n in set(lengths)}
    table, bins = P.plan(hist, cap)
    want = bfd(lengths, cap)
    assert bins == len(want)
    used = [[] for _ in range(bins)]
    for n, count in hist.items():
        rows = table[table.length == n].to_numpy()
        for k in range(count):
            r = rows[np.searchsorted(rows[:, 1], k, "right") - 1]
            used[r[3] + (k - r[1]) // r[2]].append((r[4] + (k - r[1]) % r[2] * n, n))
    for own in used:
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= cap
    assert sorted(cap - sum(n for _, n in own) for own in used) == sorted(want)


def test_pack_documents(spark):
    rows = [(i, "word " * (i * 7 % 90), "x") for i in range(200)] + [(7, None, "x"), (None, "", "x"), (900, "long text here " * 3000, "x")] + [(5, "same", "x")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(5)
    pieces = P.cut(docs, capacity=128, with_ids=True)
    got = P.pack(pieces, capacity=128, salt_rows=50).collect()
    assert len(got) == pieces.count()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == r.length
    for own in bins.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 128
    assert len(bins) == len(bfd([r.length for r in got], 128))
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 900)
    assert [x[0] for x in long] == list(range(len(long))) and all(x[2] == 128 for x in long[1:]) and long[0][2] <= 128
    assert P.pack(P.cut(docs.limit(0))).count() == 0
