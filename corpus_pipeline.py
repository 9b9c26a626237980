"""The training-corpus pipeline: documents in, mixed documents out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. `run` writes a stage's
result as Parquet in the shared folder and reads it back for the next one. All but the
last return the columns of documents, whatever other columns these have.

All stages decide by row, never by doc_id: rows with a null or repeated doc_id are
documents like others. Texts may be null, empty or very long. An empty table stays empty.
No setting of the session is changed; `siteloom.session.get_session` bounds Arrow batches by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import decontam, jaccard, mixing, pii, toxicity
from siteloom.llm.common import free_name, materialize, text_key, with_row_key, without


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the ordinal model finds toxic go; null and empty texts stay. Rows
    that repeat are decided alike; a score on the threshold counts as toxic. Texts of any
    length are scored whole. Columns named like the model's results are left alone."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles at 0.8 or more, the one with the smallest
    doc_id stays (null ids after all others; ties by hash of the text, then by place).

    Rows that repeat are linked like other copies, so one of them stays. Rows with one
    doc_id and unlike texts all stay. Texts without words are linked with nothing and stay.
    """
    keyed, key = with_row_key(docs)
    found = materialize(jaccard.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), n=5, num=8, den=10), "groups")
    groups = found.where("doc_id <> component_id").select("component_id").distinct()
    member = found.join(groups, "component_id").select(F.col("doc_id").alias("_member"), "component_id")
    facts = keyed.select(
        F.col(key).alias("_member"),
        F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), text_key().alias("text"), F.col(key).alias("place")).alias("_order"),
    )
    member = materialize(member.join(facts, "_member"), "members")
    kept = member.groupBy("component_id").agg(F.min("_order").alias("_first"))
    gone = member.join(kept, "component_id").where(F.col("_order.place") != F.col("_first.place")).select(F.col("_member").alias(key))
    return without(keyed, materialize(gone, "gone"), key).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item, copied or edited, go, and no others: rows
    with the same doc_id and another text stay. Rows that repeat are decided alike; null
    and empty texts hold nothing. A score on the threshold counts as held."""
    hits = decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = free_name("found_key", docs.columns)
    gone = materialize(hits.select(F.col("row_key").alias(key)).distinct(), "gone")
    return without(docs.withColumn(key, text_key()), gone, key).select(docs.columns)


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are generalised in the texts; all rows
    stay. Rows that repeat are sanitised alike; null texts stay null, empty ones empty.
    Where spans overlap, their union is replaced. Only text and n_chars change."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes words of, with size, source_size, target and taken. Rows
    without words (null and empty texts), or that the schedule doesn't reach, are not in
    the mix. Rows that repeat are documents of their own, each with its own `taken`. Input
    columns named like the four results come back as input_<name>."""
    names = ("size", "source_size", "target", "taken")
    for column in docs.columns:
        if column.lower() in names:
            docs = docs.withColumnRenamed(column, free_name(f"input_{column.lower()}", docs.columns))
    keyed, key = with_row_key(docs)
    got = mixing.mix_rows(keyed, key).where("taken > 0").select("row_key", *names)
    return keyed.join(got, keyed[key] == got["row_key"]).select(*(keyed[f"`{c}`"] for c in docs.columns), *names)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", sanitise_personal_data),
    ("mixing", mix_sources),
]

#: Classifiers, hashes and alignment can't be said in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
