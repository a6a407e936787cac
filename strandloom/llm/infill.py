"""Fill-in-the-middle: each text is cut at two token borders and its parts are put in another order.

An Arrow-batched pandas UDF: the regex library finds the tokens of a text and their end offsets go into one compact array
(four bytes a token), so a cut is two lookups in it and three slices of the text. The cuts and the form come from a
SHA-256 of the document's id alone, so reruns and retried tasks agree, and no row depends on another.

Defined cases: a null text is empty; an empty text, and one that holds a mark, is left plain; a null doc_id is hashed as
"1:null"; repeated rows give the same result each time; a text has at most 2**32 code points; other columns are kept by
infill, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import _io

TOKEN = regex.compile(r"[A-Za-z]+|[^A-Za-z]", regex.DOTALL)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
END = methodcaller("end")


def seeds(doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """tokens, form, code points of prefix and of middle (None if plain), output."""
    ends = array("I", map(END, TOKEN.finditer(text)))
    n = len(ends)
    h1, h2, h3, h4 = seeds(doc_id)
    if not text or h3 % 100 >= PLAIN_FROM or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text again. Its parts hold no mark, and no mark begins inside another, so the first of each is the right one."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, middle = output[len(first) :].split(MIDDLE, 1)
    one, two = head.split(second, 1)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def infill(doc_id: Column, text: Column) -> Column:
    """struct<n, form, prefix_chars, middle_chars, output, output_sha256> of a document."""

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [(*x, sha256(x[-1])) for x in (transform(None if i is None else int(i), t or "") for i, t in zip(ids, texts))]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # the id as digits: a nullable integer would reach pandas as a float and lose its last ones
    return run(doc_id.cast("long").cast("string"), text.cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text again from an output and its form; null if either is null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([None if o is None or f is None else restore(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return run(output, form)


def infill_documents(docs: DataFrame, name: str = "infill") -> DataFrame:
    """docs with the struct of infill as a further column (name, made longer until it clashes with none)."""
    return docs.withColumn(_io.fresh(docs, name), infill(F.col("doc_id"), F.col("text")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill_documents(_io.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "infill.*")
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
