"""Benchmark items found in documents: rare n-gram seeds, then local alignment.

Seeds are pairs of neighbouring words of an item; in a document, a pair also counts with
one word in between. Smith-Waterman alignment of words (match 2, mismatch and gap -1)
scores a passage against the item, divided by the score of a full copy, so an item with a
share e of its words replaced scores about 1 - 1.5 e.

No passage that reaches the score is missed. From a full copy of L words, at most
2 L (1 - score) can be lost; a replaced or missing word costs 3 and breaks two pairs at
most, a lone inserted word breaks none, two in a row cost 2 and break one, a missing end
costs 2 and breaks one. So L - 1 - 4/3 L (1 - score) pairs at least are left (9 of 29 for
30 words at 0.5), and all but `NEED` of that number of pairs can be left out: the most
frequent ones in all documents are, so the seeds are the rarest. Copies in the documents
make their own pairs more frequent, which changes the order, never the count. Where
`NEED` seeds of an item stand near each other, the passage is aligned with the item.
An item of under `least_words` words is one seed as a whole, and so is found where it
stands unchanged.

Items are never gathered anywhere: a bit table of at most 16 MB is all that is broadcast.
"""

from __future__ import annotations

import string
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, batches, bit_table, materialize, ngram_hashes, only, passes, text_key, values

NEED, LEAST_WORDS, SCORE = 3, 8, 0.5
#: Marks seeds that are pairs of words, where whole short items have their number of words.
PAIR = 0
_BLANK = bytes.maketrans(bytes(string.punctuation, "ascii"), b" " * len(string.punctuation))
_FOUND = "doc_id long, item_id long, score double, first_word long, end_word long"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation parts them as blanks do."""
    return (text or "").lower().encode().translate(_BLANK).split()


def pair_hashes(h: np.ndarray, step: int) -> np.ndarray:
    """One hash for each two words that stand `step` places apart; unlike those of n-grams."""
    with np.errstate(over="ignore"):
        acc = (h[:-step] ^ (h[:-step] >> np.uint64(30))) * np.uint64(0xFF51AFD7ED558CCD) + h[step:]
        acc = (acc ^ (acc >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return acc ^ (acc >> np.uint64(29))


def pairs_left(n_words: int, score: float) -> int:
    """So many pairs of an item of n_words are left in any passage that scores `score`."""
    return max(1, n_words - 1 - int(4 * n_words * (1 - score) / 3 + 1e-9))


def blocks(texts: pa.Array, words: WordHashes, lengths: list[int], table: np.ndarray):
    """Per block of texts: the first text's number, and text, place and hash of each seed (PAIR,
    or n-grams of these lengths) that lies within one text and passes the bit table."""
    for lo in range(0, len(texts), 256):
        parts = [tokens(t) for t in texts.slice(lo, 256).to_pylist()]
        ids = words.of(list(chain.from_iterable(parts)))
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        for n, reach in ((n, reach) for n in lengths for reach in ((2, 3) if n == PAIR else (n,))):
            grams = pair_hashes(ids, reach - 1) if n == PAIR else ngram_hashes(ids, n)
            at = np.flatnonzero(passes(table, grams))
            text = np.searchsorted(ends, at, side="right")
            whole = at + reach <= ends[np.minimum(text, len(ends) - 1)]
            at, text = at[whole], text[whole]
            yield lo, text, at - starts[text], grams[at]


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the words of the passage up to the first place that reaches it."""
    step = np.arange(len(passage) + 1)
    last, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for w in item:
        now = np.zeros_like(last)
        now[1:] = np.maximum(last[:-1] + np.where(passage == w, 2, -1), last[1:] - 1)
        # A gap along the passage: the best of all places before, less the distance.
        last = np.maximum(np.maximum.accumulate(np.maximum(now, 0) + step) - step, 0)
        top = int(last.argmax())
        if last[top] > best or last[top] == best and top < end:
            best, end = int(last[top]), top
    return best, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment score over that of a full copy, and the words of the passage that are
    aligned (first, end exclusive); of equally good ones, the first to end, and its shortest."""
    best, end = _best(item, passage)
    if not best:
        return 0.0, 0, 0
    length = _best(item[::-1], passage[:end][::-1])[1]
    return best / (2 * len(item)), end - length, end


def item_seeds(benchmark: DataFrame, least_words: int, score: float) -> DataFrame:
    """(item_key, words, n_words, gram, left, seeds) of each distinct text with a word: its word
    hashes, the kind of its seeds, how many of their places are left in any passage that
    scores `score`, and the distinct seeds, each with its number of places."""
    seed = pa.struct([("seed", pa.int64()), ("places", pa.int64())])
    schema = pa.schema([("item_key", pa.int64()), ("words", pa.binary()), ("n_words", pa.int64()), ("gram", pa.int64()), ("left", pa.int64()), ("seeds", pa.list_(seed))])

    def run(it):
        words = WordHashes()
        for batch in it:
            rows = {name: [] for name in schema.names}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words.of(tokens(text))
                n = len(own)
                if n:
                    long = n >= max(least_words, 2)
                    grams, places = np.unique(pair_hashes(own, 1) if long else ngram_hashes(own, n), return_counts=True)
                    seeds = [{"seed": g, "places": p} for g, p in zip(grams.view(np.int64).tolist(), places.tolist(), strict=True)]
                    made = (key, own.tobytes(), n, PAIR if long else n, pairs_left(n, score) if long else 1, seeds)
                    for name, value in zip(schema.names, made, strict=True):
                        rows[name].append(value)
            yield batches(rows, schema)

    texts = benchmark.select(
        F.xxhash64(F.col("text").cast("string")).alias("item_key"), F.col("text").cast("string"),
    ).where("text is not null").dropDuplicates(["item_key"])
    return texts.mapInArrow(run, "item_key long, words binary, n_words long, gram long, left long, seeds array<struct<seed: long, places: long>>")


def seed_counts(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, n_found): how often documents hold these pairs; counted in the task before the shuffle."""
    cell = docs.sparkSession.sparkContext.broadcast(bit_table(seeds, "seed", each=512))  # 16 MB at most
    schema = pa.schema([("seed", pa.int64()), ("n", pa.int64())])

    def run(it):
        words, count = WordHashes(), Counter()
        for batch in it:
            for _, _, _, gram in blocks(batch.column(0), words, [PAIR], cell.value):
                found, n = np.unique(gram.view(np.int64), return_counts=True)
                for g, k in zip(found.tolist(), n.tolist(), strict=True):
                    count[g] += k
            if len(count) > 300_000:
                yield batches({"seed": list(count), "n": list(count.values())}, schema)
                count.clear()
        yield batches({"seed": list(count), "n": list(count.values())}, schema)

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n_found"))
    return counts.join(seeds, "seed", "left_semi")


def rare_seeds(docs: DataFrame, items: DataFrame, need: int = NEED) -> DataFrame:
    """(seed, item_key, n_words, gram, places, need): the seeds that are searched for, and how
    many of their places must be found together. Of an item's places, as many as are sure
    to be left besides `need` are given up, those of its most frequent seeds."""
    every = items.select("item_key", "n_words", "gram", F.least("left", F.lit(need)).alias("need"), "left", F.explode("seeds").alias("s")).select("*", "s.*").drop("s")
    long = materialize(every.where(F.col("gram") == PAIR), "seeds")
    counts = seed_counts(docs, long.select("seed").distinct())
    order = Window.partitionBy("item_key").orderBy(F.coalesce("n_found", F.lit(0)).desc(), "seed")  # the seeds of one item
    gone = F.sum("places").over(order.rowsBetween(Window.unboundedPreceding, 0))
    columns = ["seed", "item_key", "n_words", "gram", "places", "need"]
    ranked = long.join(counts, "seed", "left").withColumn("gone", gone).where("gone > left - need").select(columns)
    return ranked.union(every.where(F.col("gram") != PAIR).select(columns))


def candidates(docs: DataFrame, rare: DataFrame, score: float = SCORE) -> DataFrame:
    """(row_key, item_key, reach, lo, hi): where the seeds of an item stand near each other, from
    the first word to the last; an alignment goes `reach` words beyond them at most."""
    lengths = sorted(r["gram"] for r in rare.select("gram").distinct().collect())  # LEAST_WORDS rows at most
    cell = docs.sparkSession.sparkContext.broadcast(bit_table(rare.select("seed").distinct(), "seed", each=512))  # 16 MB at most
    schema = pa.schema([("row_key", pa.int64()), ("seed", pa.int64()), ("at", pa.int64())])

    def run(it):
        words = WordHashes()
        for batch in it:
            keys = batch.column(0).to_numpy()
            for lo, text, at, gram in blocks(batch.column(1), words, lengths, cell.value):
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo + text]), pa.array(gram.view(np.int64)), pa.array(at, pa.int64())], schema=schema)

    hits = docs.select(text_key(), F.col("text").cast("string")).mapInArrow(run, "row_key long, seed long, at long")
    hits = hits.distinct().join(rare, "seed")  # rows that repeat have one key
    # An aligned passage has the item's words and what may be lost in inserted ones.
    hits = hits.withColumn("reach", F.col("n_words") + F.ceil(2 * F.col("n_words") * (1 - score)))
    place = Window.partitionBy("row_key", "item_key").orderBy("at")  # one item in one text
    part = hits.withColumn("gap", F.col("at") - F.lag("at").over(place) > F.col("reach"))
    part = part.withColumn("part", F.sum(F.coalesce(F.col("gap").cast("int"), F.lit(0))).over(place))
    one = part.groupBy("row_key", "item_key", "part", "need", "reach", "seed").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.max("places").alias("places"))
    near = one.groupBy("row_key", "item_key", "part", "need", "reach").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("places").alias("places"))
    return near.where("places >= need").select("row_key", "item_key", "reach", "lo", "hi")


def passages(docs: DataFrame, near: DataFrame) -> DataFrame:
    """(row_key, item_key, first, passage): the word hashes around each candidate of `near`, and
    the number of the first word. A text meets the list of its own candidates only."""
    near = near.groupBy("row_key").agg(F.collect_list(F.struct("item_key", "reach", "lo", "hi")).alias("near"))
    near = materialize(near, "near")
    schema = pa.schema([("row_key", pa.int64()), ("item_key", pa.int64()), ("first", pa.int64()), ("passage", pa.binary())])

    def run(it):
        words = WordHashes()
        for batch in it:
            rows = {name: [] for name in schema.names}
            for key, text, found in zip(*(values(batch.column(i)) for i in range(3)), strict=True):
                ids = words.of(tokens(text))
                for c in found:
                    first = max(0, c["lo"] - c["reach"])
                    made = (key, c["item_key"], first, ids[first : c["hi"] + c["reach"] + 1].tobytes())
                    for name, value in zip(schema.names, made, strict=True):
                        rows[name].append(value)
                    if len(rows["passage"]) >= 1024:
                        yield batches(rows, schema)
                        rows = {name: [] for name in schema.names}
            yield batches(rows, schema)

    given = only(docs.select(text_key().alias("row_key"), F.col("text").cast("string").alias("text")), near.select("row_key"), "row_key")
    return given.join(near, "row_key").select("row_key", "text", "near").mapInArrow(run, "row_key long, item_key long, first long, passage binary")


def aligned(found: DataFrame, items: DataFrame, score: float) -> DataFrame:
    """(row_key, item_key, score, first_word, end_word) of the best alignment of each text and
    item, if it scores `score`; of equally good ones, the first."""
    schema = pa.schema([("row_key", pa.int64()), ("item_key", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def run(it):
        for batch in it:
            rows = {name: [] for name in schema.names}
            for key, item_key, first, passage, words in zip(*(values(batch.column(i)) for i in range(5)), strict=True):
                s, lo, hi = align(np.frombuffer(words, np.uint64), np.frombuffer(passage, np.uint64))
                if s >= score:
                    for name, value in zip(schema.names, (key, item_key, s, first + lo, first + hi), strict=True):
                        rows[name].append(value)
            yield batches(rows, schema)

    both = found.join(items.select("item_key", "words"), "item_key").select("row_key", "item_key", "first", "passage", "words")
    made = both.mapInArrow(run, "row_key long, item_key long, score double, first_word long, end_word long")
    top = F.max(F.struct("score", (-F.col("first_word")).alias("before"), (-F.col("end_word")).alias("until"))).alias("top")
    best = made.groupBy("row_key", "item_key").agg(top)
    return best.select("row_key", "item_key", "top.score", (-F.col("top.before")).alias("first_word"), (-F.col("top.until")).alias("end_word"))


def matches(docs: DataFrame, benchmark: DataFrame, need: int = NEED, least_words: int = LEAST_WORDS, score: float = SCORE) -> DataFrame:
    """What `contaminated` returns, and the `text_key` of the document."""
    items = materialize(item_seeds(benchmark, least_words, score), "items")
    rare = materialize(rare_seeds(docs, items, need), "rare")
    best = materialize(aligned(passages(docs, candidates(docs, rare, score)), items, score), "aligned")
    named = benchmark.where("text is not null").select(F.xxhash64(F.col("text").cast("string")).alias("item_key"), F.col("item_id").cast("long").alias("item_id"))
    given = docs.select(text_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"))
    found = best.join(named, "item_key").join(given, "row_key")
    return found.select("row_key", *(x.split()[0] for x in _FOUND.split(", ")))


def contaminated(docs: DataFrame, benchmark: DataFrame, need: int = NEED, least_words: int = LEAST_WORDS, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: each document with each item that it
    holds at `score` or more, and the aligned words; clean documents have no row.

    Null and empty texts hold nothing, null items and items without a word are held by
    none. Items of under `least_words` words are found only where a text has them
    unchanged. Of equally good places of an item, the first is given. Texts of any
    length are searched whole. Items or documents that repeat are returned for each row,
    null ids too. Other columns are ignored; of empty tables nothing comes.
    """
    return matches(docs, benchmark, need, least_words, score).drop("row_key")
