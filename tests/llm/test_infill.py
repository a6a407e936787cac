import hashlib
import re

import pytest
from pyspark.sql import functions as F

from strandloom.llm import infill as I


def brute(doc_id, text):
    """The contract, token by token."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [None, "", "a", "\n", "one two", "a<P>b", "<S>", "x<M", "<P", "S>", "<", "naïve é x\U0001f600 tail", "x\r\ny\x00z", "a-b " * 5000, "word" * 3000, "<P<S<M>>", "日本語 text 1234"]


def test_every_row_equals_the_contract_and_comes_back(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id here"), (None, None), (2**62 + 1, "a large id"), (-5, "a b c")] + [(7, "twice told")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = I.infill_documents(docs).select("doc_id", "text", "infill.*")
    done = done.withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in done))) == sorted(map(repr, rows))
    assert {r.form for r in done} == {"plain", "psm", "spm"}
    for r in done:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text or "")
        assert r.back == (r.text or "") and r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_borders_that_look_like_marks(form):
    parts = ["<", "<S", "S>", "P>", "M>", ">", "", "<P", "<M"]
    for pre in parts:
        for mid in parts:
            for suf in parts:
                if not any(m in pre + mid + suf for m in ("<P>", "<S>", "<M>")):
                    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
                    assert I.restore(out, form) == pre + mid + suf


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "kept", 3)], "doc_id long, text string, infill string, INFILL_ int")
    out = I.infill_documents(docs)
    assert out.columns == ["doc_id", "text", "infill", "INFILL_", "infill__"] and out.first()["infill"] == "kept"
    assert I.infill_documents(docs.limit(0)).count() == 0
