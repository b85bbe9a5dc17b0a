"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

1. A text counts as its words.  Sources are ordered by code point, null last, and weigh
   `Params.weights` in turn.  Their targets share all words by weight; a target stops at `epochs` times
   its source, and what is over is shared again.  The level at which the rest stops is the greatest of
   (words - capped words before) / (weight not capped) along the sources in the order of cap / weight.
2. The mix has 2^bits slots.  Slot t takes the van der Corput point rev(t): its bits in reverse.  Every
   source has a range of the 2^bits points, in proportion to its target, so any aligned run of slots
   holds each source in its share, within one slot.  As all points are used once, the schedule is made
   from the ranges: each is cut into its points in levels of LEVEL bits, and rev(point) is the slot.
3. The rank of a slot among those of its source is a count of points below a bound among the first t:
   these fall into aligned runs, one for each bit of t, in which points are evenly spaced.  So ranks need
   neither a window nor a shuffle.
4. The documents of a source in the order of a hash are a stream of words, which starts again for each
   further pass.  It is cut into equal blocks, one for each slot of the source, whose lengths differ by
   one word at most.  Slots and pieces of documents meet on (source, block).

No source is held by one task: streams are summed in buckets of the hash of about BUCKET_ROWS rows; sums
along the buckets and along the sources are made in ranges, each of which adds the totals before it.

Defined results: null texts have no word; null sources are one source, the last; repeated rows are rows of
their own, and equal ones may stand for each other; null ids are ids; an empty table gives no rows; if
there is no word, all targets are 0; a source whose target rounds to 0 words has no slot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import saved, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket, about; bits of a point that one explode makes.
BUCKET_ROWS, LEVEL = 2048, 12
#: Hexadecimal digits of the hash that orders a source, and their bits.
DIGITS, HASH_BITS = 15, 60


@dataclass(frozen=True)
class Params:
    """Weights of the sources in turn, passes over a source at most, and words of a block, about (up to twice as many)."""

    weights: tuple[int, ...] = (1, 2, 3)
    epochs: int = 3
    block_words: int = 1024
    seed: str = "mix"


def sized(docs: DataFrame, p: Params, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, skey (of the source: sorts like it, null last), size and h, by which a source is shuffled."""
    name, text, source = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{source_col}`").cast("string")
    digest = F.md5(F.concat(F.lit(f"{p.seed}:"), F.coalesce(name.cast("string"), F.lit("")), F.lit(":"), text))
    return docs.select(
        name.alias("doc_id"), F.coalesce(F.concat(F.lit("a"), source), F.lit("b")).alias("skey"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long").alias("h"),
    )


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], folder: str, name: str) -> DataFrame:
    """`rows` with sums over all rows up to and with their own, in an order without ties.

    Ranges of the order are tasks; each adds the totals of the ranges before it, one row a range.
    """
    ranged = saved(rows.withColumns(sums).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), folder, name)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("__range").agg(*[F.sum(c).alias(c) for c in sums]).select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    added = {c: F.sum(c).over(own) + F.col(f"__{c}") for c in sums}
    return ranged.join(ranges, "__range").select(*rows.columns, *[v.cast("long").alias(c) for c, v in added.items()])


def targets(rows: DataFrame, p: Params, folder: str) -> DataFrame:
    """skey, position (from 1), source_size and target of each source of the sized rows."""
    sources = running(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), ["skey"], {"position": F.lit(1)}, folder, "sources")
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (F.pmod(F.col("position") - 1, F.lit(len(p.weights))) + 1).cast("int"))
    whole, cap = math.lcm(*p.weights), F.col("source_size") * p.epochs
    weighed = sources.withColumn("weight", weight.cast("long")).withColumn("ratio", F.col("source_size") * (F.lit(whole) / F.col("weight")).cast("long"))
    filled = running(weighed, ["ratio", "position"], {"capped": cap, "weights": F.col("weight")}, folder, "filled")
    all_of = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weights"))
    over = filled.join(F.broadcast(all_of))  # one row
    level = over.agg(F.max((F.col("words") - F.col("capped") + cap).cast("double") / (F.col("all_weights") - F.col("weights") + F.col("weight"))).alias("level"))
    return filled.join(F.broadcast(level)).select("skey", "position", "source_size", F.least(F.col("level") * F.col("weight"), cap.cast("double")).alias("target"))


def ranges(found: DataFrame, p: Params, folder: str) -> tuple[DataFrame, int]:
    """The sources with words (the rounded target), lo and hi (their range of the points), and the bits of a point."""
    rounded = saved(found.withColumn("words", F.floor(F.col("target") + 0.5).cast("long")), folder, "targets")
    total = rounded.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count_if(F.col("words") > 0).alias("n")).first()
    bits = max(2 + (max(total["n"], 1) - 1).bit_length(), (total["words"] // p.block_words).bit_length() - 1)
    free, has = (1 << bits) - total["n"], (F.col("words") > 0).cast("long")
    summed = running(rounded, ["position"], {"so_far": F.col("words"), "rank": has}, folder, "ranges")
    bound = lambda rank, words: rank + F.floor(F.lit(float(free)) * (words.cast("double") / F.lit(float(max(total["words"], 1)))))
    lo, hi = bound(F.col("rank") - has, F.col("so_far") - F.col("words")), bound(F.col("rank"), F.col("so_far"))
    return summed.select("skey", "position", "source_size", "target", "words", lo.cast("long").alias("lo"), F.when(F.col("words") > 0, hi).otherwise(lo).cast("long").alias("hi")), bits


# ------------------------------------------------------------------ the schedule


def points(spans: DataFrame, bits: int) -> DataFrame:
    """A row for each point v of the ranges [lo, hi).  No explode makes more than 2^LEVEL rows of one."""
    rows, width = spans.where("lo < hi").select("position", F.col("lo").alias("first"), F.col("hi").alias("last"), "lo", "hi"), bits
    while width:
        width = max(0, width - LEVEL)
        step = F.lit(1 << width)
        part = F.explode(F.sequence(F.shiftright("lo", width), F.shiftright(F.col("hi") - 1, width))).alias("part")
        rows = rows.select("position", "first", "last", "lo", "hi", part).select("position", "first", "last", F.greatest("lo", F.col("part") * step).alias("lo"), F.least("hi", (F.col("part") + 1) * step).alias("hi"))
        if width:
            rows = rows.repartition("position", "lo")
    return rows.select("position", "first", "last", F.col("lo").alias("v"))


def slot_of(v: str, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(v), bits, "0")), 2, 10).cast("long")


def points_before(v: str, bound: str, bits: int) -> Column:
    """How many slots before that of point v have a point below the bound."""
    return F.expr(f"aggregate(sequence(0, {bits - 1}), 0L, (n, j) -> n + getbit({v}, j) * shiftright({bound} - ({v} & (shiftleft(1L, j) - 1)) + shiftleft(1L, j + 1) - 1, j + 1))")


def slots(spans: DataFrame, bits: int) -> DataFrame:
    """slot, position and block of every slot: its source, and its rank among the slots of the source."""
    return points(spans, bits).select(slot_of("v", bits).alias("slot"), "position", (points_before("v", "last", bits) - points_before("v", "first", bits)).alias("block"))


# ------------------------------------------------------------------ streams and blocks


def streams(rows: DataFrame, spans: DataFrame, folder: str) -> DataFrame:
    """The sized rows with their source's columns, start (words of the source before them) and (position, bucket, row), a key."""
    n = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", F.shiftright("h", HASH_BITS - bits))
    counted = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("held"))
    summed = running(counted, ["skey", "bucket"], {"so_far": F.col("held")}, folder, "buckets").select("skey", "bucket", (F.col("so_far") - F.col("held")).alias("before"))
    first = summed.groupBy("skey").agg(F.min("before").alias("first"))
    buckets = summed.join(first.join(spans, "skey"), "skey").withColumn("offset", F.col("before") - F.col("first"))
    own = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size")
    start = F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ordered = rows.withColumns({"row": F.row_number().over(own), "within": start})
    return ordered.join(buckets, ["skey", "bucket"]).select("doc_id", "size", "position", "bucket", "row", (F.col("offset") + F.col("within")).alias("start"), "source_size", "target", "words", (F.col("hi") - F.col("lo")).alias("n"))


def pieces(streamed: DataFrame, p: Params) -> DataFrame:
    """What each block takes of each document: (position, block), the document's key, pass, from_word and words_taken."""
    key = ["doc_id", "position", "bucket", "row"]
    short, more = F.expr("words div greatest(n, 1)"), F.expr("words % greatest(n, 1)")
    block = lambda x: F.expr(f"CASE WHEN {x} < more * (short + 1) THEN {x} div (short + 1) ELSE more + ({x} - more * (short + 1)) div greatest(short, 1) END")
    passes = streamed.where("size > 0 and start < words").withColumns({"short": short, "more": more, "pass": F.explode(F.sequence(F.lit(0), F.lit(p.epochs - 1)))})
    spans = passes.withColumn("at", F.col("pass") * F.col("source_size") + F.col("start")).where("at < words").withColumn("until", F.least(F.col("at") + F.col("size"), "words"))
    cut = spans.withColumns({"b0": block("at"), "b1": block("(until - 1)")}).select("*", F.explode(F.sequence("b0", "b1")).alias("block"))
    begins = lambda b: F.expr(f"({b}) * short + least(({b}), more)")
    cut = cut.withColumns({"begin": F.greatest("at", begins("block")), "end": F.least("until", begins("block + 1"))})
    return cut.select(*key, "block", "pass", (F.col("begin") - F.col("at")).alias("from_word"), (F.col("end") - F.col("begin")).alias("words_taken"))


def plan(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, mix): the documents with their place in the streams, and the mix as rows of slot,
    (doc_id, position, bucket, row), block, pass, from_word and words_taken.  Read by slot, then pass and
    row within it, it is the training order."""
    folder = shared_dir(docs.sparkSession)
    rows = saved(sized(docs, p, id_col, text_col, source_col), folder, "sized")
    spans, bits = ranges(targets(rows, p, folder), p, folder)
    spans = saved(spans, folder, "spans")
    streamed = saved(streams(rows, spans, folder), folder, "streams")
    # without the hint the planner takes the slots for as small as the ranges that they are made of, and broadcasts them
    return streamed, pieces(streamed, p).join(slots(spans, bits).hint("merge"), ["position", "block"])


def mix(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target (its source's) and taken, the words that the mix takes of it."""
    key = ["position", "bucket", "row"]
    streamed, mixed = plan(docs, p, id_col, text_col, source_col)
    taken = mixed.groupBy(key).agg(F.sum("words_taken").alias("taken"))
    return streamed.join(taken, key, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: slot, block, doc_id, pass, from_word and text, the words that a slot takes of a document, joined by
    blanks.  Ids must be unique, as texts are joined to the plan by them."""
    _, mixed = plan(docs, p, id_col, text_col, source_col)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0)).alias("w"))
    return mixed.join(texts, "doc_id").select("slot", "block", "doc_id", "pass", "from_word", F.array_join(F.slice("w", (F.col("from_word") + 1).cast("int"), F.col("words_taken").cast("int")), " ").alias("text"))
