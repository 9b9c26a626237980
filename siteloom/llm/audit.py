"""What each filter of a corpus removes, in every order in which filters can be applied.

The documents are reduced to counts by part and by the set of filters that they fail.
The states of the lattice are the sets of filters already applied; an edge applies one
more, and what it removes are the documents that fail its filter and none applied before.
How many orders reach a state from the empty set (forward) and leave it to the full set
(backward) is counted along the edges; an edge lies on forward * backward orders, which
is the weight of its removals in the filter's Shapley sum. The steps of an order are a
path of edges, so they are read from the same table: nothing is applied 120 times.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Least number of words; least share of distinct words, most share of capitals (percent); marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that depend on the text alone: A too few words, B too repetitive,
    C too many capitals, D marks of code or markup."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(MARKS),
    }


def lattice(names: str) -> list[tuple[int, int, int, int]]:
    """Edges (state, bit, forward, backward) of the subset lattice of the filters `names`:
    forward orders reach the state, backward ones lead from the edge's end to the full set."""
    full = (1 << len(names)) - 1
    bits = [1 << i for i in range(len(names))]
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):  # a state's subsets have smaller numbers
        for bit in bits:
            if not state & bit:
                forward[state | bit] += forward[state]
    for state in range(full, -1, -1):
        for bit in bits:
            if not state & bit:
                backward[state] += backward[state | bit]
    return [(s, b, forward[s], backward[s | b]) for s in range(full + 1) for b in bits if not s & b]


def orders(names: str) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, state, bit): the edge that each step of each order takes."""
    bit, found = {f: 1 << i for i, f in enumerate(names)}, []
    for order in permutations(names):
        state = 0
        for step, f in enumerate(order, 1):
            found.append(("".join(order), step, state, bit[f]))
            state |= bit[f]
    return found


def interactions(failed: DataFrame, names: str) -> DataFrame:
    """Steps of all orders by part. `failed` has part, mask (a bit for each failed filter, the
    first of `names` lowest), n, good and toxic (numbers of documents); rows may repeat.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley. Every part has every step, zeros included; an empty table has none. The number
    of filters bounds the table: 2^filters masks a part, filters! orders.
    """
    spark = failed.sparkSession
    sums = [F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")]
    masks = failed.groupBy("part", "mask").agg(*sums)
    edges = spark.createDataFrame(lattice(names), "state int, bit int, forward long, backward long")
    # Each mask meets the edges of the lattice, a list of fixed size, in its own row.
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("state", "bit"), e[:2], strict=True)]) for e in lattice(names)])
    at = masks.select("*", F.explode(listed).alias("e")).select("*", "e.state", "e.bit")
    fails = F.col("mask").bitwiseAND(F.col("bit")) > 0
    reaches = F.col("mask").bitwiseAND(F.col("state")) == 0
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    edge = at.groupBy("part", "state", "bit").agg(
        total("n", fails & reaches).alias("removed"),
        total("n", reaches & ~fails).alias("kept"),
        total("n", fails & ~reaches).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & reaches).alias("good_lost"),
        total("toxic", fails & reaches).alias("toxic_lost"),
    )
    weighed = edge.join(edges, ["state", "bit"]).withColumn(
        "shapley", F.sum(F.col("removed") * F.col("forward") * F.col("backward")).over(Window.partitionBy("part", "bit"))
    )
    steps = spark.createDataFrame(orders(names), "filter_order string, step int, state int, bit int")
    return weighed.join(steps, ["state", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic of `docs` (doc_id, source, text) for the filters A to E.

    E fails a document whose text is that of any smaller doc_id. Copies are found by
    SHA-256; only the texts that several rows have come back as a table of their first
    doc_id, so that a unique document is joined with nothing, and a text that a third of
    the rows share is a join that adaptive execution splits.

    A null text is an empty one, a null source the part ''. A null doc_id is smaller than
    none and larger than none: it never fails E, nor lets another fail; it has no label.
    Rows that repeat count each; with one doc_id and one text, neither fails E for the
    other. Several labels of a doc_id count as good, or toxic, if any of them says so.
    Texts are judged whole, whatever their length. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(text_filters(text).values())), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"),
    )
    rows = materialize(rows, "failed")  # the texts are read once
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("copies")).where("copies > 1").drop("copies")
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    labelled = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    repeated = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    found = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + repeated).alias("mask"))
    found = found.join(labelled, "doc_id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return found.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`interactions` of the filters A to E of `text_filters` and `failures`, by source."""
    return interactions(failures(docs, labels), "ABCDE")
