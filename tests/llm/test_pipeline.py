"""The pipeline's decisions stage by stage, against plain versions, and on odd tables."""

import re

import pytest

import corpus_pipeline
from siteloom.llm import pii, toxicity
from siteloom.llm.common import materialize

from .test_corpus_operators import brute_components, plain_alignment, plain_terms

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_pipeline(spark, sf_dir):
    docs_all = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs_all.where("doc_id < 110")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, before, sf_dir), "test")
        seen[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == columns, name
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    a, b = ({r["doc_id"] for r in x.collect()} for x in seen["toxicity"])
    assert b <= a and all(labels.get(d) != 0 for d in a - b)
    # toxicity: the sum of a text's weights, one by one, against the first threshold
    w, cut = toxicity.fit(docs_all, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    words = toxicity.WordFeatures()
    plain = {r["doc_id"] for r in seen["toxicity"][0].collect() if not r["text"] or sum(map(float, w.astype("float32")[toxicity.features(r["text"], words)])) < cut[0]}
    assert b == plain
    a, b = seen["ngram_jaccard_join"]
    want = brute_components([(r["doc_id"], r["text"]) for r in a.collect()], 5, 8, 10)
    assert sorted(r["doc_id"] for r in b.collect()) == sorted({c for _, c in want.values()})
    # a document goes if a benchmark item is aligned with it at half of a full copy's score or more
    a, b = ({r["doc_id"]: r["text"] for r in x.collect()} for x in seen["benchmark_decontamination"])
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for d, text in a.items():
        words = re.findall(r"\w+", (text or "").lower())
        near = [i for i in items if len(set(i) & set(words)) >= len(set(i)) / 2]
        assert (d in b) != any(plain_alignment(i, words) >= 0.5 for i in near), d
    # PII: base spans, and the terms that the plain count of all pairs finds, are replaced, and nothing else
    given = [(r["doc_id"], r["text"], None, None) for r in seen["pii"][0].collect()]
    terms = plain_terms(given)
    for d, text, *_ in given:
        named = [{"start": s, "end": e} for w, s, e in pii.terms_of(text or "", pii.find_base(text)) if w in terms.get(d, ())]
        assert {r["text"] for r in seen["pii"][1].where(f"doc_id = {d}").collect()} == {pii.replaced(text, named)}, d
    a, b = ({r["doc_id"]: r["text"] for r in x.collect()} for x in seen["pii"])
    assert set(a) == set(b) and all("@" not in t or a[d] != t or ".com" not in t for d, t in b.items())
    last = seen["mixing"][1].collect()
    assert last and all(0 < r["taken"] <= 3 * r["size"] for r in last)


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    long = " ".join(f"word{i % 977}{i % 31}" for i in range(60_000))
    rows = [(1, None), (1, None), (2, ""), (3, "  "), (4, "one two three four five six"), (4, "one two three four five six"), (4, "other words are here in this row"), (None, "one two three four five six"), (None, "a text without an id stands here alone"), (None, item), (9, item), (9, "a clean text with the id of a stained one"), (10, long), (None, None), (11, "mail a@b.co now")]
    return spark.createDataFrame([(d, t, None, "s", len(t or ""), 1, 2, "k", 3, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int, row_key int, target string, Size int, component_id string")


def count(df, where):
    return df.where(where).count()


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_empty_tables(spark, sf_dir, odd, name):
    empty = odd.limit(0)
    out = STAGES[name](spark, empty, sf_dir)
    assert out.count() == 0 and (name == "mixing" or out.columns == odd.columns)


def test_toxicity_of_odd_rows(spark, sf_dir, odd):
    assert rows_of(STAGES["toxicity"](spark, odd.where("text is null or text = ''"), sf_dir).select("doc_id", "_row", "n_chars").na.fill(0)) == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0)]
    assert STAGES["toxicity"](spark, odd, sf_dir).columns == odd.columns


def test_join_of_odd_rows(spark, sf_dir, odd):
    out = materialize(STAGES["ngram_jaccard_join"](spark, odd, sf_dir), "test")
    assert out.columns == odd.columns and out.count() == 12
    assert count(out, "text like 'one two%'") == 1 and count(out, "text like 'one two%' and doc_id = 4") == 1
    assert count(out, "text is null") == 3 and count(out, "doc_id = 4") == 2 and count(out, "doc_id = 9") == 2 and count(out, "doc_id is null") == 2


def test_decontamination_of_odd_rows(spark, sf_dir, odd):
    out = materialize(STAGES["benchmark_decontamination"](spark, odd, sf_dir), "test")
    assert out.columns == odd.columns and out.count() == 13
    assert count(out, "doc_id is null") == 3 and rows_of(out.where("doc_id = 9").select("text")) == [("a clean text with the id of a stained one",)]


def test_pii_of_odd_rows(spark, sf_dir, odd):
    out = materialize(STAGES["pii"](spark, odd, sf_dir), "test")
    assert out.columns == odd.columns and out.count() == odd.count() and count(out, "doc_id = 11 and text like '%[EMAIL]%'") == 1
    assert rows_of(out.where("doc_id = 10").select("n_chars")) == rows_of(odd.where("doc_id = 10").select("n_chars"))


def test_mixing_of_odd_rows(spark, sf_dir, odd):
    out = materialize(STAGES["mixing"](spark, odd, sf_dir), "test")
    names = ["input_size" if c == "Size" else "input_target" if c == "target" else c for c in odd.columns]
    assert out.columns == [*names, "size", "source_size", "target", "taken"]
    # one source: each row with words is taken once, rows that repeat too
    assert out.count() == 10 and count(out, "taken = size and input_size = 3 and input_target = 'k'") == 10 and count(out, "doc_id is null") == 3
