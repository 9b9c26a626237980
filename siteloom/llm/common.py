"""What several corpus operators share: word hashes, n-grams, components."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import Rounds, new_path, shared_dir

__all__ = [
    "WordHashes", "batches", "bit_table", "components", "free_name", "materialize", "new_path", "ngram_hashes", "only", "passes", "shared_dir", "small_batches", "text_key",
    "utf8", "values", "with_row_key", "without",
]

#: Words longer than this are hashed anew each time instead of being remembered.
REMEMBERED_WORD = 64
#: A task remembers so many words at most, some 20 MB.
REMEMBERED_WORDS = 120_000


def batches(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20):
    """Inside, batches that go to Python have `rows` rows and `size` bytes at most (or one row): of
    long texts, a batch is held by the JVM, whose buffers double as they grow, and by the
    Python worker. The session has its own bounds again afterwards."""
    with _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}):
        yield


@contextmanager
def _settings(spark: SparkSession, inside: dict[str, str]):
    before = {n: spark.conf.get(n) for n in inside}
    try:
        for name, value in inside.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """`df` written in the shared folder and read back, by way of small batches. The shuffle files
    that this took go at once, not when the driver happens to collect its garbage."""
    with small_batches(df.sparkSession), _settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        return storage.materialize(df, tag)


def values(column: pa.Array):
    """The values of a column as Python objects, made for some hundred rows at a time: a batch
    of long texts is never held twice."""
    for lo in range(0, len(column), 256):
        yield from column.slice(lo, 256).to_pylist()


def utf8(column: pa.Array) -> pa.Array:
    """A string column as UTF-8 bytes; null stays null."""
    return column.cast(pa.binary())


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; bounded, one per task."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED_WORD:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of n words, in order; empty if there are fewer words."""
    m = len(h) - n + 1
    if m < 1:
        return h[:0]
    acc = np.full(m, 0x9E3779B97F4A7C15 ^ n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + m]
        acc ^= acc >> np.uint64(32)
        acc *= np.uint64(0x94D049BB133111EB)
        acc ^= acc >> np.uint64(29)
    return acc


def free_name(name: str, columns: list[str]) -> str:
    """`name`, with underscores in front until no column has it, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def text_key() -> Column:
    """A 64-bit hash of doc_id and text, the same for rows that repeat."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of `df` is one row of a Parquet file, the format whose rows have a place."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" and "parquet" in node.relation().toString().lower()


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a long column that tells its rows apart, and that column's name. The
    key is the row's place in its file under a hash of the file's name: the same whenever
    the table is read, after a lost executor too, and near rows have near keys. What is
    no plain scan of files is written once first."""
    if not _is_scan(docs):
        docs = materialize(docs, "rows")
    if not docs.inputFiles():  # an empty table
        name = free_name("row_key", docs.columns)
        return docs.withColumn(name, F.lit(0).cast("long")), name
    name, place = free_name("row_key", docs.columns), docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(place["file_path"]).bitwiseXOR(place["row_index"]).alias(name)), name


#: So few keys (of 8 bytes) are broadcast, some 40 MB in each executor; more are joined by a shuffle.
FEW_KEYS = 1_000_000


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`rows` without those whose `key` is in `gone` (a written table of that column). The
    rows, texts and all, are not shuffled as long as the keys are few."""
    return rows.join(F.broadcast(gone) if gone.count() <= FEW_KEYS else gone, key, "left_anti")


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`rows` whose key is in `keys` (a written table), as long as the keys are few enough to
    be broadcast; beyond that all rows, for the join that follows."""
    return rows.join(F.broadcast(keys), key, "left_semi") if keys.count() <= FEW_KEYS else rows


def bit_table(keys: DataFrame, column: str, most: int = 1 << 27, each: int = 16) -> np.ndarray:
    """Words of a bit table over the low bits of a hash column: some `each` bits a key but
    `most` at most (16 MB). Every key has its bit set; with more keys than that, the
    table only lets more others pass."""
    n = keys.agg(F.count("*")).first()[0]
    size = min(most, 1 << max(10, (each * n).bit_length()))
    at = keys.select(F.col(column).bitwiseAND(F.lit(size - 1)).alias("h"))
    bits = at.groupBy(F.expr("h div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("b")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[bits.column("w").to_numpy()] = bits.column("b").to_numpy()
    return table


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) have their bit set."""
    at = (h & np.uint64(64 * len(table) - 1)).astype(np.int64)
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def edge_state(edges: DataFrame) -> tuple:
    """Number and checksum of edges (a, b), of any number: nothing is added that could overflow."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of `edges` (a long, b long) as (node, component): the
    component is its smallest node. Nodes without an edge to another do not appear.

    Large-star and small-star steps alternate until every edge points at its root.
    Hubs are handled by partial aggregation and by joins that can be split, never by
    collecting the neighbours of a node; each round ends in a table in the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rounds, before = Rounds("edges"), None
    e = rounds.write(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e = rounds.write(small.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        state = edge_state(e)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
