import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from strandloom.llm import suffixes as S


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256, kept) by counting every string of the length."""
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        mark = [False] * (len(t) + 1)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = [True] * length
        kept = bytes(c for c, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), sum(a and not b for a, b in zip(mark, [False, *mark])), hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(rnd, length):
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(length // 3) for _ in range(4)]
    rows = [None, "", "x", "a" * (3 * length), "ab" * length, text(4000)]
    for _ in range(60):
        t = text(rnd.randint(1, length))
        for s in rnd.sample(shared, rnd.randint(0, 2)):
            a = rnd.randint(0, len(s) // 2)
            b = rnd.choice([a + length - 1, a + length, a + length + 1, len(s)])
            t += s[a:b] + text(rnd.randint(0, 30))
        rows.append(t)
    rows += rows[10:14] + [rows[20][:-3] + "zz"]
    return rows


@pytest.mark.parametrize("seed,length", [(0, 40), (1, 200), (2, 400), (3, 5)])
def test_matches_brute_force(spark, seed, length):
    rnd = random.Random(seed)
    texts = corpus(rnd, length)
    rows = [(i if i != 9 else None, t, 1, b"") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, block binary").repartition(5)
    got = S.repeated_spans(docs, repeats=[S.Repeat(length)], with_text="changed", block_bytes=3000, bucket_keys=500).collect()
    want = [(i if i != 9 else -1, *w) for i, w in enumerate(brute([(t or "").encode() for t in texts], length))]
    have = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]
    assert sorted(have) == sorted(w[:5] for w in want)
    kept = {w[0]: w[5] for w in want}
    for r in got:
        if r.n_removed:
            assert r.text == kept[-1 if r.doc_id is None else r.doc_id].decode(errors="ignore") and r.n_cut == r.n_removed
        else:
            assert r.text is None


def test_several_waves(spark, monkeypatch):
    rnd = random.Random(9)
    texts = corpus(rnd, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    real = S.suffix_pairs
    monkeypatch.setattr(S, "suffix_pairs", lambda *a: seen.append(a[2]) or real(*a))
    got = S.repeated_spans(docs, repeats=[S.Repeat(40)], block_bytes=5000, bucket_keys=300, wave_share=0, least_wave=5_000).collect()
    assert len(seen) > 3
    assert sorted(tuple(r) for r in got) == sorted((i, *w[:4]) for i, w in enumerate(brute([(t or "").encode() for t in texts], 40)))


def test_covers():
    for m, d in S.COVERS.items():
        assert {(a - b) % m for a in d for b in d} == set(range(m))


def test_dedup_texts_and_empty(spark):
    s = "é" * 100
    docs = spark.createDataFrame([(1, "a" + s, "x", 101), (2, "b" + s + "c", "x", 102), (3, None, "y", None), (4, "own", "y", 3)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in S.dedup_texts(docs, [S.Repeat(50)]).collect()}
    assert {k: (r.text, r.n_chars) for k, r in got.items()} == {1: ("a", 1), 2: ("bc", 2), 3: (None, None), 4: ("own", 3)}
    again = S.dedup_texts(docs.unionAll(docs.where("doc_id = 4")), [S.Repeat(50)])
    assert again.columns == docs.columns and again.count() == 5
    assert S.repeated_spans(docs.limit(0)).count() == 0


def brute_words(texts, length):
    """Kept bytes by counting every run of words."""
    count, cut = {}, [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", t)] for t in texts]
    runs = lambda w: [tuple(x[2] for x in w[i : i + length]) for i in range(len(w) - length + 1)]
    for w in cut:
        for r in runs(w):
            count[r] = count.get(r, 0) + 1
    out = []
    for t, w in zip(texts, cut):
        gone = {k for i, r in enumerate(runs(w)) if count[r] > 1 for k in range(i, i + length)}
        mark = bytearray(len(t))
        for k in gone:  # and what lies between two words that go
            end = w[k + 1][0] if k + 1 in gone else w[k][1]
            mark[w[k][0] : end] = b"x" * (end - w[k][0])
        out.append(bytes(c for c, m in zip(t, mark) if not m))
    return out


@pytest.mark.parametrize("seed,length", [(0, 51), (1, 7), (2, 20)])
def test_words_match_brute_force(spark, seed, length):
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice("abé") * rnd.randint(1, 3) + rnd.choice([" ", " ", "\n", "  "]) for _ in range(n))
    shared = [some(2 * length) for _ in range(5)]
    texts = [None, "", " ", "x" * 3000 + " y", some(2000)]
    for _ in range(60):
        t = some(rnd.randint(0, length))
        for x in rnd.sample(shared, rnd.randint(0, 2)):
            t += " ".join(x.split()[: rnd.choice([length - 1, length, length + 1, 2 * length])]) + rnd.choice([" ", ""]) + some(rnd.randint(0, 40))
        texts.append(t)
    texts += texts[8:12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in S.repeated_spans(docs, repeats=[S.Repeat(length, words=True)], with_text="all", block_bytes=2000, bucket_keys=300).collect()}
    for i, (t, want) in enumerate(zip(raw, brute_words(raw, length))):
        assert got[i].text.encode() == want and got[i].n_removed == got[i].n_cut == len(t) - len(want)
    assert sum(r.n_removed > 0 for r in got.values()) > 10


def test_stage_cuts_short_passages_of_many_words(spark):
    rnd = random.Random(1)
    some = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    p, q = some(51), some(50)
    assert len(p) < S.BYTES.length
    texts = [f"{some(40)} {x} {some(40)}" for x in (p, p, q, q)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert [got[i].text for i in range(4)] == [t.replace(p, "") for t in texts] and got[0].n_chars == len(got[0].text)


def test_both_kinds_in_one_pass(spark):
    """The counts and the digest follow the bytes alone; the text loses what either kind marks."""
    rnd = random.Random(4)
    texts = corpus(rnd, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raw = [(t or "").encode() for t in texts]
    both = {r.doc_id: r for r in S.repeated_spans(docs, repeats=[S.Repeat(40), S.Repeat(3, words=True)], with_text="all", block_bytes=3000, bucket_keys=200).collect()}
    for i, (b, w) in enumerate(zip(brute(raw, 40), brute_words(raw, 3))):
        assert (both[i].n_bytes, both[i].n_removed, both[i].n_spans, both[i].kept_sha256) == b[:4]
        assert both[i].n_cut >= max(b[1], len(raw[i]) - len(w)) and len(both[i].text.encode()) <= min(len(b[4]), len(w))


def test_clashing_columns_and_shared_ids(spark):
    s = "x" * 60
    rows = [(1, "a" + s, 7, 8, 9, 3), (1, "b" + s, 7, 8, 9, 3), (None, "c", 1, 2, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, _key int, _kept int, _name int")
    got = S.dedup_texts(docs, [S.Repeat(50)])
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.where("doc_id = 1").collect()) == [(1, "a", 7, 8, 9, 3), (1, "b", 7, 8, 9, 3)]
    assert got.where("doc_id IS NULL").first() == docs.where("doc_id IS NULL").first()


def thue_morse(n):
    return np.array([bin(i).count("1") & 1 for i in range(n)], np.uint8) + np.uint8(97)


@pytest.mark.parametrize("n", [512, 1024, 4096])
@pytest.mark.parametrize("which", [0, 1])
def test_hashes_tell_structured_strings_apart(n, which):
    one = thue_morse(n)
    other = np.uint8(195) - one
    got = [int(S.window_hash(x, np.array([0]), n, which)[0]) for x in (one, other, one.copy())]
    assert got[0] != got[1] and got[0] == got[2]
    words = [S.window_hash(x.astype(np.uint64), np.array([0]), n, which)[0] for x in (one, other)]
    assert words[0] != words[1]


def test_window_hash_depends_on_the_window_alone():
    rnd = np.random.default_rng(3)
    text = rnd.integers(0, 256, S.STEP + 5000).astype(np.uint8)
    text[S.STEP - 300 : S.STEP + 700] = text[100:1100]  # over a step's end
    h = S.window_hash(text, np.array([100, 101, S.STEP - 300]), 1000, 0)
    assert h[0] == h[2] != h[1]


def test_structured_texts_are_no_repeats(spark):
    one = thue_morse(2048).tobytes().decode()
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    want = brute([one.encode(), other.encode()], 1500)
    got = S.repeated_spans(docs, "doc_id", repeats=(S.Repeat(1500),)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [w[:4] for w in want]
    start, stop, value = S.word_symbols(np.frombuffer(f"{one[:1024]} {other[:1024]} {one[:1024]}".encode(), np.uint8), np.array([3074]))
    assert value[0] == value[2] != value[1]
