"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule is a row of slots. Slot i has the golden-ratio point frac(i * phi), which
falls into one source's part of the cumulative weights, so after any number of slots
every source has had nearly its share. The slots of a source are ranked; rank r takes
block r of the source's documents, which are shuffled by hash, laid end to end and cut
into blocks of equally many words, again from the start after each pass. A last slot
for each source takes what is left to its target, to the word.

Sources are a table like any other, so there may be as many as there are web domains:
their order, targets and places in the cumulative weights are computed by aggregates,
and the driver sees a few sums. Running sums go by ranges of the order first and inside
a range then, and slots meet sources by cells of the unit interval, so neither a source
with a third of all rows nor a repeated doc_id is a single task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, utf8, values, with_row_key

WEIGHTS, MOST, BLOCK = (5, 2, 1), 3, 512
#: Rows of one range of a running sum, and slots of one range of ranks, about.
RANGE_ROWS = 20_000
#: Points are whole numbers of 2**-31; this is the golden ratio's fraction in them (odd, so no point comes twice).
POINTS, GOLDEN = 31, 1327217885


def shuffle_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of doc_id: the order of a source's documents."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def word_counts(docs: DataFrame, key: str) -> DataFrame:
    """row_key, doc_id, source, size, tie (hash of the text) of each row; size counts runs of
    non-whitespace, null 0."""

    def run(it):
        for batch in it:
            size = pa.array([len(t.split()) if t else 0 for t in values(utf8(batch.column(4)))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), size, batch.column(3)], names=["row_key", "doc_id", "source", "size", "tie"])

    text = F.col("text").cast("string")
    given = docs.select(
        F.col(key).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(text).alias("tie"), text.alias("text"),
    )
    return given.mapInArrow(run, "row_key long, doc_id long, source string, size long, tie long")


def in_ranges(rows: DataFrame, n: int, order: list) -> DataFrame:
    """`rows` written in n ranges of `order`; column part numbers them."""
    return materialize(rows.repartitionByRange(max(1, n), *order).withColumn("part", F.spark_partition_id()), "ranges")


def running_total(rows: DataFrame, key: str, part: str, order: list, value: str, name: str) -> DataFrame:
    """`rows` with the sum of `value` before each row, in the order of `part` and `order` in
    each key; no task holds more than a part, or one number for each part of a key."""
    per = rows.groupBy(key, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(per, [key, part]).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base")


def source_table(counted: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_no, source_size, source_rows, target, take (the target in whole words),
    before (the takes of sources before it), in the order of code points, null last.

    A target is the total by weight, none over `most` times the source's size; the excess
    is shared again by weight until none is above. Each round is one aggregate: sources
    that are capped stay so, as what is left for each unit of weight only grows.
    """
    sums = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sums = materialize(sums, "sources")
    order = [F.col("source").isNull(), F.col("source")]
    placed = in_ranges(sums.withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), -(-sums.count() // RANGE_ROWS), order)
    placed = running_total(placed, "all", "part", order, "one", "no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    placed = materialize(placed.withColumn("weight", weight), "sources")
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    over = lambda: F.col("weight") * F.lit(float(left)) / F.lit(float(whole)) > F.lit(most) * F.col("source_size")
    first = placed.agg(F.sum("weight")).first()[0] or 1
    left, whole, capped = total, first, -1
    while True:
        now = placed.agg(
            F.count_if(over()), F.coalesce(F.sum(F.when(over(), F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(over(), F.col("weight"))), F.lit(0)),
        ).first()
        if now[0] == capped or now[2] == first:
            break
        capped, left, whole = now[0], total - now[1], first - now[2]
    target = F.when(over(), (F.col("source_size") * most).cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(whole)))
    placed = placed.withColumn("target", target).withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
    placed = running_total(placed, "all", "part", order, "take", "before")
    return materialize(placed.select("source", F.col("no").alias("source_no"), "source_size", "source_rows", "target", "take", "before"), "sources")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source_no, epoch, block, begin, words: what each slot takes. Takes are reached
    to the word; a closing slot (slot null) takes what the others leave."""
    spark = sources.sparkSession
    count, total = sources.agg(F.count("*"), F.coalesce(F.sum("take"), F.lit(0))).first()
    facts = sources.select("source_no", "source_size", "take", F.greatest(F.lit(1), F.expr(f"(source_size + {block - 1}) div {block}")).alias("blocks"))
    # A source has the points from lo up to hi. Both sides meet by cells of the points.
    cut = lambda c: F.expr(f"cast({c} as decimal(20,0)) * cast({1 << POINTS} as decimal(11,0)) div {max(1, total)}BD").cast("long")
    shift = POINTS - max(6, min(24, (4 * count).bit_length()))
    parts = sources.where("take > 0").select("source_no", cut("before").alias("lo"), cut("before + take").alias("hi")).where("hi > lo")
    parts = parts.select("*", F.explode(F.expr(f"sequence(shiftright(lo, {shift}), shiftright(hi - 1, {shift}))")).alias("cell"))
    point = F.expr(f"pmod(pmod(id, {1 << POINTS}) * {GOLDEN}, {1 << POINTS})")
    drawn = spark.range(total // block).select("id", point.alias("point")).withColumn("cell", F.shiftright("point", shift)).join(parts, "cell").where("point >= lo and point < hi")
    drawn = drawn.select("id", "source_no", F.expr(f"id div {RANGE_ROWS}").alias("part"), F.lit(1).alias("one"))
    ranked = running_total(drawn, "source_no", "part", ["id"], "one", "rank").join(facts, "source_no")
    placed = ranked.select(
        "source_no", "source_size", "take", F.col("id").alias("slot"), F.expr("rank div blocks").alias("epoch"),
        F.expr("rank % blocks").alias("block"),
    )
    begin = F.expr(f"epoch * source_size + block * {block}L")
    length = F.expr(f"least({block}L, source_size - block * {block}L, take - begin)")
    slotted = placed.withColumn("begin", begin).withColumn("words", length).where("words > 0").select("slot", "source_no", "epoch", "block", "begin", "words")
    slotted = materialize(slotted, "slots")
    reached = slotted.groupBy("source_no").agg(F.max(F.expr("begin + words")).alias("reached"))
    rest = facts.where("take > 0").join(reached, "source_no", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("reached < take")
    # The closing slot, cut at the ends of passes and blocks like the others.
    closing = rest.select(
        "source_no", "source_size", "take", "reached",
        F.explode(F.expr("sequence(reached div source_size, (take - 1) div source_size)")).alias("epoch"),
    )
    closing = closing.withColumn("lo", F.expr("greatest(reached - epoch * source_size, 0L)")).withColumn("hi", F.expr("least(take - epoch * source_size, source_size)"))
    closing = closing.select("source_no", "epoch", "source_size", "hi", "lo", F.explode(F.expr(f"sequence(lo div {block}L, (hi - 1) div {block}L)")).alias("block"))
    closing = closing.select(
        F.lit(None).cast("long").alias("slot"), "source_no", "epoch", "block", F.expr("epoch * source_size + lo").alias("begin"),
        F.expr(f"least(hi, (block + 1) * {block}L) - greatest(lo, block * {block}L)").alias("words"),
    )
    return slotted.union(closing)


def mix_rows(docs: DataFrame, key: str, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """What `mix` returns, with row_key, the values of column `key`, which tells rows apart."""
    counted = materialize(word_counts(docs, key), "words")
    sources = source_table(counted, weights, most)
    rows = counted.join(sources.drop("take", "before", "source_rows"), counted.source.eqNullSafe(sources.source)).drop("source")
    # Rows that repeat are told apart by their place alone; what they get does not depend on who is first.
    order = ["hash", "tie", "row_key"]
    rows = in_ranges(rows.withColumn("hash", shuffle_hash(F.col("doc_id"))), -(-counted.count() // RANGE_ROWS), ["source_no", *order])
    rows = running_total(rows, "source_no", "part", order, "size", "begin")
    slots = materialize(schedule(sources, block), "slots")
    # Whole takes of a block, and how far the last, partial one goes.
    taken = slots.join(sources.select("source_no", "source_size"), "source_no").withColumn("length", F.expr(f"least({block}L, source_size - block * {block}L)"))
    times = taken.groupBy("source_no", "epoch", "block", "length").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")).groupBy("source_no", "block").agg(
        F.sum(F.expr("if(words = length, 1L, 0L)")).alias("whole"), F.max(F.expr("if(words = length, 0L, words)")).alias("part"), F.min("slot").alias("slot"),
    )
    # A part is always the head of its block: slots of a source take its stream from the start.
    rows = materialize(rows.drop("part", "hash", "tie"), "rows")
    pieces = rows.where("size > 0").select(
        "source_no", "row_key", "begin", "size", F.explode(F.expr(f"sequence(begin div {block}L, (begin + size - 1) div {block}L)")).alias("block"),
    )
    lo, hi = F.expr(f"greatest(begin, block * {block}L) - block * {block}L"), F.expr(f"least(begin + size, (block + 1) * {block}L) - block * {block}L")
    got = pieces.withColumn("lo", lo).withColumn("hi", hi).join(times, ["source_no", "block"]).groupBy("row_key").agg(
        F.sum(F.expr("whole * (hi - lo) + greatest(least(hi, part) - lo, 0L)")).alias("taken"), F.min("slot").alias("first_slot"),
    )
    return rows.join(got, "row_key", "left").select("row_key", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot of each row; first_slot is the slot of
    the schedule that first takes words of the document: the order of the mix (null: none does,
    or its source's closing slot, which takes what the others leave of its target).

    Sources are in the order of code points, null last (an empty name is a source).
    Texts null or without words have size 0 and nothing taken; rows that repeat are
    documents of their own, null ids too. Reruns agree: the shuffle is a hash of doc_id,
    then of the text. Other columns are ignored; an empty table gives an empty result.
    """
    keyed, key = with_row_key(docs)
    return mix_rows(keyed, key, weights, most, block).drop("row_key")
