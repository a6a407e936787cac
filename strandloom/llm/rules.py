"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document: the ledger keeps the measurements and one bit for each rule that
fails. A policy is a version name and a set of rules; applying one is a bitwise test on the stored bits, so a new
policy needs no second look at the texts. Ablations (what would a policy keep without one of its rules?) come from
counts over the distinct bit patterns, of which there are at most two to the number of rules.

All of it is DataFrame code: no UDF. Repeated 8-word windows are found by their 64-bit hashes: XXH64 of each word, combined
two by two to hashes of two, four and eight words. Only documents in which a hash comes twice sort their windows. Two
different windows of one document would have to collide to count wrongly.

Defined cases: null text has no words; empty and very long texts are measured whole; a null doc_id is kept as a row;
repeated rows give repeated rows; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import _io, words

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails` is true; written without division, so that empty documents need no care."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("shouting", "10 * n_upper > 5 * word_chars"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "many_symbols", "duplicate_lines", "short_words", "long_words", "shouting"),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the measurements (long) of every document."""
    out = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    out = out.select(
        key,
        words.word_list(F.col("_t")).alias("_w"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^A-ZÀ-ÖØ-Þ]+", "")).cast("long").alias("n_upper"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    out = out.withColumn("_h", F.when(F.size("_w") >= WINDOW, F.transform("_w", lambda x: F.xxhash64(x))))
    for step in (1, 2, 4):  # hashes of runs of 2 * step words from those of step words
        left = F.slice("_h", F.lit(1), F.size("_h") - step)
        out = out.withColumn("_h", F.zip_with(left, F.slice("_h", F.lit(1 + step), F.size("_h") - step), lambda a, b: F.xxhash64(a, b)))
    out = out.select(
        key,
        "n_symbols",
        "n_upper",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce("_h", F.array().cast("array<bigint>")).alias("_h"),
    )
    kept = [c for c in out.columns if c != "_h"]
    pairs = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.select(*kept, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).alias("_s"))

    def same(j: Column, k: Column) -> Column:
        return F.coalesce(F.get("_s", k)["h"] == F.get("_s", j)["h"], F.lit(False))

    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    out = out.select(*kept, F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(twice, lambda j: F.get("_s", j)["i"]))).alias("_p"))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_p") - 1),
        F.lit(0).cast("long"),
        lambda n, k: n + F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - F.get("_p", k), F.lit(WINDOW))),
    )
    return out.select(*kept, F.when(F.col("_p").isNotNull(), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, the measurements, and failed: a long with bit i set where rules[i] fails."""
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)), F.lit(0).cast("long"))
    return measure(docs, key, text).withColumn("failed", bits)


def apply_policy(ledger_df: DataFrame, version: str, rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> DataFrame:
    """Adds kept: no rule of the policy fails."""
    return ledger_df.withColumn("kept", F.col("failed").bitwiseAND(mask(policies[version], rules)) == 0)


def ablations(ledger_df: DataFrame, version: str, rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    names = policies[version]
    whole = mask(names, rules)
    own = F.col("failed").bitwiseAND(whole)
    patterns = ledger_df.groupBy(own.alias("bits")).agg(F.count("*").alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask((n,), rules)).cast("long").alias("bit")) for n in names]))
    crossed = patterns.select("bits", "n", one.alias("r")).select("bits", "n", "r.rule", "r.bit")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return crossed.groupBy("rule").agg(n(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), n(F.col("bits") == F.col("bit")).alias("n_failed_alone"), n((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is written once; the policy reads the stored bits and measurements."""
    out = apply_policy(_io.stored(ledger(_io.table(spark, sf_dir, "documents")), "ledger"), "v1")
    base = F.col("failed").bitwiseAND(mask(BASE)) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, w, list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' ')) AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS s, unnest(range(1, len(g) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, i, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM r),
p AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g'))::BIGINT AS n_upper, len(l)::BIGINT AS n_lines,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_upper > 5 * word_chars) AS kept FROM b
"""
