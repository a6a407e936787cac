"""Quotation linking: who answers whom in conversations that quote each other, as reply-ordered turns without quotes.

Parsing. A line that begins with quote marks (">", with up to three spaces before each) is quoted at as many levels as
it has marks. Consecutive lines of one level form a passage; an empty line ends it. A line of attribution that ends in
"wrote:" right before a quote goes with it. What remains is the message's own text.

Linking. A passage is normalised (white space to one space, case folded) and hashed to 128 bits, and so are the units
that it may have been taken from: each message's own text, its paragraphs, its lines, and the runs of lines of a
paragraph that are as long as some quoted passage. A passage found in its own conversation links to the latest turn
before its own; else to the first message anywhere (by conv_id and turn) that has it. Passages of level 1 name the
message answered; deeper ones are what that one quoted. A message answers the message of its last linked level-1 passage
in its own conversation, or else the turn before it.

Reply order. The answers make a tree of each conversation; `position` is a message's place in it, read depth first, the
earlier answer first. Turns that each answer the one before form a segment, which stays in one piece; the tour over the
segments (one for each jump) is ranked by pointer doubling, in as many joins as the logarithm of its length.

Joins are by hash with one row a hash, or as-of by turn within spans of turns, so a passage that thousands quote, or a
very long conversation, meets nothing in pairs.

Defined cases: null text is empty; a null turn sorts first; null conv_ids are one conversation; repeated (conv_id,
turn) rows are kept, and count as one message for links; a passage nobody wrote stays unlinked; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import _io

MARK = re.compile(r"^(?:[ ]{0,3}>)+[ ]?")
WROTE = re.compile(r"\bwrote:\s*$", re.I)
SPAN = 4096  # turns looked at together


def none() -> Column:
    """Stands for a null conv_id or turn."""
    return F.lit(-(1 << 63))


def key_of(lines: list[str]) -> str | None:
    words = " ".join(lines).split()
    return xxhash.xxh3_128_hexdigest(" ".join(words).casefold().encode("utf-8", "surrogatepass")) if words else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str, int]]]:
    """Own text, and the quoted passages as (level, hash, lines), in order."""
    own: list[str] = []
    passages: list[tuple[int, str, int]] = []
    held: list[str] = []
    level = 0

    def flush() -> None:
        if level and (k := key_of(held)):
            passages.append((level, k, len(held)))
        held.clear()

    for line in (text or "").split("\n"):
        found = MARK.match(line)
        now = found[0].count(">") if found else 0
        bare = line[found.end() :] if found else line
        if now != level:
            flush()
            if now and not level:
                while own and not own[-1].strip():
                    own.pop()
                if own and WROTE.search(own[-1]):
                    own.pop()
            level = now
        if now and not bare.strip():
            flush()
        elif now:
            held.append(bare)
        else:
            own.append(line)
    flush()
    return "\n".join(own).strip(), passages


def units(own: str, runs: list[int]) -> set[str]:
    """Hashes of what a quote of this text may hold: all of it, its paragraphs, its lines, and its runs of so many lines."""
    paragraphs = [p.split("\n") for p in re.split(r"\n[ \t\r]*\n", own)]
    cut = [own.split("\n"), *paragraphs, *(p[i : i + n] for p in paragraphs for n in runs for i in range(len(p) - n + 1))]
    return {k for u in cut if (k := key_of(u))}


def parsed(messages: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _io.slices(frames, 2000):
            got = [parse(t) for t in f.text]
            yield pd.DataFrame({"conv_id": f.conv_id.astype("Int64"), "turn": f.turn.astype("Int64"), "role": f.role, "text": [g[0] for g in got], "passages": [[{"level": a, "key": k, "lines": n} for a, k, n in g[1]] for g in got]})

    own = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(run, "conv_id long, turn long, role string, text string, passages array<struct<level:int,key:string,lines:int>>")


def written(rows: DataFrame) -> DataFrame:
    """conv, turn, key of every unit of every message that may be quoted. The lengths of quoted passages, in lines, come to the driver."""
    lengths = rows.select(F.explode("passages.lines").alias("n")).distinct().orderBy("n").toPandas().n.tolist()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _io.slices(frames, 500):
            own = [sorted(units(t, sorted({1, *lengths}))) for t in f.text]
            yield pd.DataFrame({"conv": f.conv.repeat([len(x) for x in own]).to_numpy(), "turn": f.turn.repeat([len(x) for x in own]).to_numpy(), "key": [k for x in own for k in x]})

    return rows.select(F.coalesce("conv_id", none()).alias("conv"), F.coalesce("turn", none()).alias("turn"), "text").mapInPandas(run, "conv long, turn long, key string")


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, at (place of the passage), level, to_conv, to_turn for every passage that some message wrote."""
    conv, turn = F.coalesce("conv_id", none()), F.coalesce("turn", none())
    quotes = rows.select(conv.alias("conv"), turn.alias("turn"), F.posexplode("passages").alias("at", "p")).select("conv", "turn", "at", "p.level", "p.key").distinct()
    wanted = quotes.select("key").distinct()
    wrote = written(rows).join(wanted, "key", "left_semi").distinct()
    wrote = _io.stored(wrote, "written-passages")
    first = wrote.groupBy("key").agg(F.min(F.struct("conv", "turn")).alias("first"))
    # as-of inside each span of turns, and the last turn of earlier spans
    span = F.floor(F.col("turn") / SPAN)
    both = quotes.select("key", "conv", "turn", "at", "level").unionAll(wrote.select("key", "conv", "turn", F.lit(None).cast("int"), F.lit(None).cast("int")))
    both = both.withColumn("span", span)
    wrote_at = F.when(F.col("at").isNull(), F.col("turn"))
    inside = Window.partitionBy("key", "conv", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    spans = both.groupBy("key", "conv", "span").agg(F.max(wrote_at).alias("last"))
    spans = spans.withColumn("earlier", F.max("last").over(Window.partitionBy("key", "conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    asof = both.withColumn("near", F.max(wrote_at).over(inside)).where("at IS NOT NULL").join(spans, ["key", "conv", "span"])
    found = asof.withColumn("here", F.coalesce("near", "earlier")).join(first, "key", "left")
    out = found.select("conv", "turn", "at", "level", F.when(F.col("here").isNotNull(), F.col("conv")).otherwise(F.col("first.conv")).alias("to_conv"), F.coalesce("here", "first.turn").alias("to_turn"))
    return out.where("to_turn IS NOT NULL AND NOT (to_conv = conv AND to_turn >= turn)")


def following(df: DataFrame, keys: list[str], order: str, down: bool = False) -> DataFrame:
    """df with next: the value of `order` (distinct within keys) that comes after a row's own, in spans, so that no window holds all rows of a key."""
    by, span = (F.desc if down else F.asc)(order), F.floor(F.col(order) / SPAN)
    df = df.withColumn("_span", span).withColumn("_near", F.lead(order).over(Window.partitionBy(*keys, "_span").orderBy(by)))
    ends = df.groupBy(*keys, "_span").agg((F.max if down else F.min)(order).alias("_end"))
    ends = ends.withColumn("_far", F.lead("_end").over(Window.partitionBy(*keys).orderBy((F.desc if down else F.asc)("_span")))).drop("_end")
    return df.join(ends, [*keys, "_span"]).withColumn("next", F.coalesce("_near", "_far")).drop("_span", "_near", "_far")


def tour(segments: DataFrame) -> DataFrame:
    """conv, seg, first (the place of a segment's first turn), for segments (conv, seg, size, attach, into: the turn answered and its segment; null for the first segment)."""
    child = segments.where("into IS NOT NULL")
    same = following(child.select("conv", "into", "attach", "seg"), ["conv", "attach"], "seg").withColumnRenamed("next", "same")
    points = child.groupBy("conv", "into", "attach").agg(F.min("seg").alias("least"))
    lower = following(points, ["conv", "into"], "attach", down=True)  # reading goes back along a segment from its end
    after = lower.alias("p").join(points.alias("n"), (F.col("p.conv") == F.col("n.conv")) & (F.col("p.next") == F.col("n.attach")), "left").select("p.conv", "p.attach", F.col("n.least").alias("later"))
    sibling = same.join(after, ["conv", "attach"]).select("conv", "seg", F.coalesce("same", "later").alias("sibling"))
    first = points.groupBy("conv", F.col("into").alias("seg")).agg(F.max_by("least", "attach").alias("child"))
    all_ = segments.join(sibling, ["conv", "seg"], "left").join(first, ["conv", "seg"], "left")
    step = lambda seg, out: F.struct(F.col(seg).alias("seg"), F.lit(out).alias("out"))
    enter = all_.select("conv", "seg", F.lit(False).alias("out"), F.when(F.col("child").isNotNull(), step("child", False)).otherwise(step("seg", True)).alias("next"), F.col("size").alias("rest"))
    leave = all_.select("conv", "seg", F.lit(True).alias("out"), F.when(F.col("sibling").isNotNull(), step("sibling", False)).when(F.col("into").isNotNull(), step("into", True)).alias("next"), F.lit(0).cast("long").alias("rest"))
    now = _io.stored(enter.unionAll(leave), "tour")
    while not now.where("next IS NOT NULL").isEmpty():  # rest: turns from here to where next points
        ahead = now.select(F.col("conv").alias("c"), F.struct("seg", "out").alias("at"), F.col("next").alias("then"), F.col("rest").alias("more"))
        open_ = now.where("next IS NOT NULL").join(ahead, (F.col("conv") == F.col("c")) & (F.col("next") == F.col("at")))
        moved = open_.select("conv", "seg", "out", F.col("then").alias("next"), (F.col("rest") + F.col("more")).alias("rest"))
        now = _io.stored(now.where("next IS NULL").unionAll(moved), "tour")
    whole = segments.groupBy("conv").agg(F.sum("size").alias("whole"))
    return now.where("NOT out").join(whole, "conv").select("conv", "seg", (F.col("whole") - F.col("rest")).alias("first"))


def turn_places(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """conv, turn, reply_to, position of each message. answers: conv, turn, answered."""
    turns = rows.select(F.coalesce("conv_id", none()).alias("conv"), F.coalesce("turn", none()).alias("turn")).distinct()
    turns = turns.join(answers, ["conv", "turn"], "left").withColumn("span", F.floor(F.col("turn") / SPAN))
    # the turn before, the place by turn, and the turn where the segment begins, from sums by span: no window holds a whole conversation's rows
    own, earlier = Window.partitionBy("conv", "span").orderBy("turn"), Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("conv", "span").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    sums = sums.select("conv", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.max("last").over(earlier).alias("last_before"))
    places = turns.withColumn("i", F.row_number().over(own) - 1).withColumn("prev", F.lag("turn").over(own)).join(sums, ["conv", "span"])
    places = places.select("conv", "turn", "span", "answered", (F.col("before") + F.col("i")).alias("at"), F.coalesce("prev", "last_before").alias("previous"))
    jumps = F.col("previous").isNull() | (F.col("answered") != F.col("previous"))
    places = _io.stored(places.withColumn("begins", F.when(F.coalesce(jumps, F.lit(False)), F.col("turn"))), "turn-places")
    reply = F.coalesce("answered", "previous").alias("reply_to")
    if places.where("begins IS NOT NULL AND previous IS NOT NULL").isEmpty():
        return places.select("conv", "turn", reply, F.col("at").alias("position"))
    sums = places.groupBy("conv", "span").agg(F.max("begins").alias("last")).select("conv", "span", F.max("last").over(earlier).alias("seg_before"))
    inside = F.max("begins").over(own.rowsBetween(Window.unboundedPreceding, 0))
    places = _io.stored(places.withColumn("inside", inside).join(sums, ["conv", "span"]).withColumn("seg", F.coalesce("inside", "seg_before")).select("conv", "turn", "at", "answered", "previous", "begins", "seg"), "segments")
    size = places.groupBy("conv", "seg").agg(F.count("*").alias("size"), F.min("at").alias("start"))
    heads = places.where("begins IS NOT NULL").select("conv", "seg", F.when(F.col("previous").isNotNull(), F.col("answered")).alias("attach"))
    into = places.select("conv", F.col("turn").alias("attach"), F.col("seg").alias("into"))
    segments = _io.stored(heads.join(size, ["conv", "seg"]).join(into, ["conv", "attach"], "left").select("conv", "seg", "size", "start", "attach", "into"), "segment-tree")
    found = tour(segments.select("conv", "seg", "size", "attach", "into")).join(segments.select("conv", "seg", "start"), ["conv", "seg"])
    return places.join(found, ["conv", "seg"]).select("conv", "turn", reply, (F.col("first") + F.col("at") - F.col("start")).alias("position"))


def reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words), n_quotes, n_linked, reply_to (turn answered), quoted (struct array of level, conv_id, turn), position (in reply order, from 0)."""
    rows = _io.stored(parsed(messages), "parsed-messages")
    found = _io.stored(links(rows), "quotation-links")
    by_message = found.groupBy("conv", "turn").agg(
        F.array_sort(F.collect_list(F.struct("at", "level", F.nullif("to_conv", none()).alias("conv_id"), F.nullif("to_turn", none()).alias("turn")))).alias("quoted"),
        F.max(F.when((F.col("level") == 1) & (F.col("to_conv") == F.col("conv")), F.struct("at", "to_turn")))["to_turn"].alias("answered"),
    )
    by_message = _io.stored(by_message, "linked-messages")
    places = turn_places(rows, by_message.select("conv", "turn", "answered"))
    out = rows.withColumn("_conv", F.coalesce("conv_id", none())).withColumn("_turn", F.coalesce("turn", none()))
    out = out.join(places.withColumnsRenamed({"conv": "_conv", "turn": "_turn"}), ["_conv", "_turn"]).join(by_message.withColumnsRenamed({"conv": "_conv", "turn": "_turn"}), ["_conv", "_turn"], "left")
    quoted = F.transform(F.coalesce("quoted", F.array().cast("array<struct<at:int,level:int,conv_id:bigint,turn:bigint>>")), lambda q: F.struct(q["level"].alias("level"), q["conv_id"].alias("conv_id"), q["turn"].alias("turn")))
    return out.select("conv_id", "turn", "role", "text", F.size("passages").cast("long").alias("n_quotes"), F.size(quoted).cast("long").alias("n_linked"), F.nullif("reply_to", none()).alias("reply_to"), quoted.alias("quoted"), "position")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(_io.table(spark, sf_dir, "conversations"))
