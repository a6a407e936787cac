import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.llm import _io
from strandloom.llm import rules as R


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for own in at.values() if len(own) > 1 for i in own for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "a", "one two\none two\n\none two", "x " * 30, "é# |b|\u00a0c\x0bd", "word " * 5000]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    texts += [("the quick brown fox jumps over the lazy dog " * 2 + str(i)) for i in range(3)] * 2
    return list(enumerate(texts)) + [(None, "no id"), (3, "a")]


def test_measures_match_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, _w string").repartition(3)
    got = R.apply_policy(R.ledger(docs), "v1").collect()
    key = lambda x: (x[0] is None, x)
    have = sorted(((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key)
    assert have == sorted(((i or -1, *brute(t)) for i, t in rows), key=key)
    for r in got:
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert base == bool(r.failed & R.mask(R.BASE)) and (not base or not r.kept)


def test_policies_and_ablations_use_stored_bits(spark, rows):
    led = _io.stored(R.ledger(spark.createDataFrame(rows, "doc_id long, text string")), "ledger")
    kept = led.where(F.col("failed").bitwiseAND(R.mask(R.POLICIES["v1"])) == 0).count()
    assert R.apply_policy(led, "v1").where("kept").count() == kept
    got = {r.rule: r for r in R.ablations(led, "v1").collect()}
    for name in R.POLICIES["v1"]:
        rest = R.mask(tuple(n for n in R.POLICIES["v1"] if n != name))
        assert got[name].n_kept_without == led.where(F.col("failed").bitwiseAND(rest) == 0).count()
    assert got["few_words"].n_failed == led.where("n_words < 20").count()


def test_empty_table(spark):
    assert R.apply_policy(R.ledger(spark.createDataFrame([], "doc_id long, text string")), "v1").count() == 0
