"""Mixing sources to target weights by entropy balancing.

Targets. Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3 ... and share the corpus's whole size; no
target exceeds 3 times its source's size, and what a capped source leaves is shared out again by weight. The shares
are min(3 s, level * weight) for one level, so only that scalar is iterated.

Rates. A document of size x has rate base * exp(lambda * x / unit), at most 3, where lambda is its source's: of all rates
from 0 to 3 whose tokens meet every target, those closest to the base rates in relative entropy over documents. The
multipliers maximise a convex dual that falls apart into one for each source, in which unit is the mean size that a token
of the source sees. Newton steps on its gradient, in logarithms and inside a bracket, need for each source the tokens
taken at the present multipliers and their derivative, which is one aggregation over (source, size, base) with counts.
A source that must give three times its words has every rate at 3.

Copies. Rates, in whole 2**-20ths, become whole copies by systematic rounding of their running sum inside small buckets of
a source, longest documents first, then a correction in each bucket: one copy more or less of the longest document that
fits into what is missing, and of the shortest ones for the rest. A bucket misses its share by less than a short document.

All of it is DataFrame code. Defined cases: null text or no word: size 0, taken 0; a source without words has target
0; null source is a source of its own; repeated rows count each; an empty table gives no rows; other columns are
ignored. Reruns agree, as every order is by size and a hash of the document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import _io, words

WEIGHTS = (1, 2, 3)
MOST = 3
BUCKET_ROWS = 10_000
ONE = 1 << 20  # parts of a rate
FEW = 10_000  # sources up to which the dual's state is broadcast


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target; a row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    src = _io.stored(src.withColumn("weight", weight), "sources")
    total, weight_sum = src.agg(F.sum("source_size"), F.sum("weight")).first()
    level, last = (total or 0) / (weight_sum or 1), None
    while level != last:
        capped = F.lit(level) * F.col("weight") > most * F.col("source_size")
        held, free = src.agg(F.sum(F.when(capped, most * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        level, last = (total - (held or 0)) / free if free else level, level
    return src.select("source", "source_size", "n_docs", F.least(F.lit(level) * F.col("weight"), (most * F.col("source_size")).cast("double")).alias("target"))


def newton_rates(sizes: DataFrame, targets: DataFrame, *, most: float = MOST, tolerance: float = 1e-10, steps: int = 100) -> DataFrame:
    """source, lambda, unit: the dual solution. sizes: source, size and base (the rate without constraints); targets: source, target. lambda is null where even rates of `most` give too little, and where the target is 0."""
    held = sizes.where("size > 0").groupBy("source", "size", "base").agg(F.count("*").alias("n"))
    held = _io.stored(held, "moments")
    square = F.sum(F.col("n") * F.col("size").cast("double") * F.col("size"))
    start = held.where("base > 0").groupBy("source").agg((square / F.sum(F.col("n") * F.col("size"))).alias("unit"), F.sum(F.col("n") * F.col("size")).alias("reach"))
    state = targets.alias("t").join(start.alias("u"), F.col("t.source").eqNullSafe(F.col("u.source")))
    state = state.where((F.col("target") > 0) & (F.col("target") < F.col("reach") * most * (1 - 1e-12))).select("t.source", "target", "unit", F.lit(0.0).alias("lambda"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(math.inf).alias("off"))
    state = _io.stored(state, "dual")
    for _ in range(steps):
        x = F.col("size") / F.col("unit")
        free = F.col("base") * F.exp(F.col("lambda") * x)
        tokens = F.col("n") * F.col("size")
        own = held.alias("h").join(F.broadcast(state) if state.count() <= FEW else state, held.source.eqNullSafe(state.source))
        now = own.groupBy(state.source, "target", "unit", "lambda", "low", "high").agg(F.sum(tokens * F.least(F.lit(float(most)), free)).alias("f"), F.sum(F.when(free < most, tokens * free * x)).alias("df"))
        # log f against log target, so that a step is as good from far below as from far above; never out of the bracket
        now = now.withColumn("low", F.when(F.col("f") < F.col("target"), F.col("lambda")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("f") >= F.col("target"), F.col("lambda")).otherwise(F.col("high")))
        newton = F.col("lambda") + F.log(F.col("target") / F.col("f")) * F.col("f") / F.col("df")
        half = F.when(F.col("low") == -math.inf, F.col("high") * 2 - 1).when(F.col("high") == math.inf, F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        inside = (F.col("df") > 0) & (F.col("f") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        off = F.abs(F.col("f") / F.col("target") - 1)
        moved = F.when(off <= tolerance, F.col("lambda")).when(inside, newton).otherwise(half)
        state = _io.stored(now.select("source", "target", "unit", moved.alias("lambda"), "low", "high", off.alias("off")), "dual")
        if (state.agg(F.max("off")).first()[0] or 0) <= tolerance:
            break
    return state.select("source", F.round("lambda", 9).alias("lambda"), "unit")


def round_copies(rated: DataFrame, tie: Column, *, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds copies (0 to most) to rows of source, n_docs, size, rate (a long, in ONE-ths)."""
    salts = F.ceil(F.col("n_docs") / bucket_rows)
    rated = rated.withColumn("_tie", tie).withColumn("_salt", F.pmod(F.col("_tie"), salts))
    bucket = Window.partitionBy("source", "_salt")
    upto = F.sum("rate").over(bucket.orderBy(F.desc("size"), "_tie").rowsBetween(Window.unboundedPreceding, 0))
    rounded = lambda x: F.floor((x + ONE // 2) / F.lit(ONE))
    out = rated.withColumn("_upto", upto).withColumn("_c", F.greatest(F.lit(0), F.least(F.lit(most), rounded(F.col("_upto")) - rounded(F.col("_upto") - F.col("rate")))))
    out = out.withColumn("_gap", F.sum((F.col("rate") - F.col("_c") * ONE) * F.col("size")).over(bucket))
    size = F.col("size") * ONE
    can = F.when(F.col("_gap") > 0, F.col("_c") < most).otherwise(F.col("_c") > 0) & (F.col("size") > 0) & (size <= F.abs("_gap"))
    out = out.withColumn("_can", can).withColumn("_id", F.when(F.col("_can"), F.struct("size", "_tie")))
    out = out.withColumn("_first", F.max("_id").over(bucket))
    is_first = F.coalesce(F.col("_id") == F.col("_first"), F.lit(False))
    rest = F.when(F.col("_can") & ~is_first, size).otherwise(0)
    sums = F.sum(rest).over(bucket.orderBy("size", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    change = is_first | (F.col("_can") & (sums <= F.abs("_gap") - F.col("_first.size") * ONE))
    out = out.withColumn("copies", (F.col("_c") + F.when(change, F.signum("_gap")).otherwise(0)).cast("int"))
    return out.drop("_upto", "_c", "_gap", "_can", "_id", "_first", "_salt", "_tie")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS, base: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source and the columns of keep, for every document."""
    base = F.lit(1.0) if base is None else base.cast("double")
    sizes = docs.select("doc_id", "source", *keep, F.size(words.word_list(F.col("text"))).cast("long").alias("size"), base.alias("base"))
    sizes = _io.stored(sizes, "sizes")
    targets = _io.stored(source_targets(sizes, weights, most), "targets")
    lam = newton_rates(sizes.select("source", "size", "base"), targets.select("source", "target"), most=most)
    lam = targets.alias("t").join(lam.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select("t.*", "l.lambda", "l.unit")
    rated = sizes.alias("d").join(lam.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "n_docs", "target", "lambda", "unit")
    tilted = F.least(F.lit(float(most)), F.col("base") * F.exp(F.col("lambda") * F.col("size") / F.col("unit")))
    at_most = F.when(F.col("base") > 0, F.lit(float(most))).otherwise(0.0)
    rate = F.when(F.col("target") > 0, F.when(F.col("lambda").isNotNull(), tilted).otherwise(at_most)).otherwise(0.0)
    rated = rated.withColumn("rate", F.round(rate * ONE).cast("long"))
    out = round_copies(rated, F.xxhash64("doc_id", "size"), most=most, bucket_rows=bucket_rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", *keep)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it."""
    docs, key = _io.named(docs)
    taken = mix(docs.select(F.col(key).alias("doc_id"), "source", "text"), **options).where("copies > 0")
    name, copies = _io.fresh(docs, "_name"), _io.fresh(docs, "_copies")
    out = docs.join(taken.select(F.col("doc_id").alias(name), F.col("copies").alias(copies)), F.col(key) == F.col(name))
    cols = [F.col(f"`{c}`") for c in docs.columns if c != key or key == "doc_id"]
    return out.select(*cols, F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(name)).select(*cols)


def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_io.table(spark, sf_dir, "documents")).drop("source")
