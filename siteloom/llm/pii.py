"""Personal data: patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Each
distinct value is a protected entity. Over the whole corpus, the documents with a term,
with an entity, and with both, wherever they stand, are counted. With N documents,

    PMI(term; entity) = log2(N * n(term, entity) / (n(term) * n(entity)))
    IC(entity)        = log2(N / n(entity))

A term discloses an entity if PMI >= IC / alpha: knowing the term then gives at least
1/alpha of the entity's information. There is no least count, as most entities stand in
one or two documents. A pair that chance explains is left alone instead: every term of the
corpus could have met the entity, so what counts is how many of them are expected to meet it
as surprisingly if all stood at random, at most `level` (an E-value; Chernoff bounds of
the binomial tails, summed over the corpus's own document frequencies). A word that stands in
one document with an entity is thus no find in a corpus in which documents have such
words anyway, whatever its size. In documents with the entity, terms that disclose it are
generalised (to TERM) at every place, and base spans to their kind.

Pairs are counted by classes: entities of the same documents are one, and so are terms
of one frequency in the same documents. A list of addresses that is copied on is one class, not
as many as it has lines, so a document's pairs stay in proportion to the sets it is part of.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, free_name, materialize, only, values, without

KINDS = ("email", "ip", "card", "phone")
ALPHA, LEVEL = 1.25, 0.01
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    for m in _CHAIN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def find_base(text: str | None) -> list[list[tuple[int, int]]]:
    """Spans of each kind, leftmost and non-overlapping; failing matches are dropped
    and not retried. Time is linear in the text."""
    text = text or ""
    digits = bool(_DIGIT.search(text))
    return [list(_emails(text)), *(list(f(text)) if digits else [] for f in (_ips, _cards, _phones))]


def entity(kind: str, value: str) -> int:
    """The protected entity that a span names: case, blanks and punctuation don't count."""
    value = value.lower() if kind in ("email", "ip") else "".join(_DIGIT.findall(value))
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode()) - (1 << 63)


def terms_of(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all terms of a text, lower-cased; those that base spans touch are none."""
    flat, at, end, out = sorted(chain.from_iterable(base)), 0, 0, []
    for m in _TERM.finditer(text):
        while at < len(flat) and flat[at][0] < m.end():
            end = max(end, flat[at][1])
            at += 1
        if m.start() >= end:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def joined(named: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in named)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, row_key (hash of id and text), counts, base spans, the distinct
    entities, and all places of terms if there is an entity."""
    word = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("row_key", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_spans", pa.string()),
            ("base_sha256", pa.string()), ("entities", pa.list_(pa.int64())), ("words", pa.list_(word)),
        ]
    )

    def made(given, rows, flat, ends):
        words = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, word, strict=True)], fields=list(word))
        rows = [pa.array(rows[f.name], f.type) for f in schema if f.name in rows]
        return pa.RecordBatch.from_arrays([given.column(0), given.column(1), *rows, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)], schema=schema)

    def run(it):
        for batch in it:
            fresh = lambda: ({n: [] for n in schema.names[2:-1]}, ([], [], []), [0])
            first, (rows, flat, ends) = 0, fresh()
            for i, text in enumerate(values(batch.column(2))):
                base = find_base(text)
                for k, spans in zip(KINDS, base, strict=True):
                    rows[f"n_{k}"].append(len(spans))
                named = joined([(k, s, e) for k, spans in zip(KINDS, base, strict=True) for s, e in spans])
                rows["base_spans"].append(named)
                rows["base_sha256"].append(hashlib.sha256(named.encode()).hexdigest())
                rows["entities"].append(list({entity(k, text[s:e]) for k, spans in zip(KINDS, base, strict=True) for s, e in spans}))
                if named:
                    for column, parts in zip(flat, zip(*terms_of(text, base), strict=True), strict=False):
                        column += parts
                ends.append(len(flat[0]))
                if len(flat[0]) > 100_000:
                    yield made(batch.slice(first, i + 1 - first), rows, flat, ends)
                    first, (rows, flat, ends) = i + 1, fresh()
            yield made(batch.slice(first), rows, flat, ends)

    given = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text"), F.col("text").cast("string"))
    return given.mapInArrow(
        run,
        "doc_id long, row_key long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, base_sha256 string, entities array<long>, words array<struct<term:string,start:int,end:int>>",
    )


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, n_term): documents with each term; counted in the task before the shuffle."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(it):
        count: Counter = Counter()
        for batch in it:
            for text in values(batch.column(0)):
                if text:
                    count.update(set(map(str.lower, set(_TERM.findall(text)))))
                if len(count) > 150_000:
                    yield batches({"term": list(count), "n": list(count.values())}, schema)
                    count.clear()
        yield batches({"term": list(count), "n": list(count.values())}, schema)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _classes(rows: DataFrame, what: str, n: str, name: str) -> DataFrame:
    """(what, n, name): a number for all of `what` that have the same count n and the same
    documents among `rows` (row_key, what, n; distinct)."""
    marks = [F.bit_xor(F.xxhash64("row_key", F.lit(salt))) for salt in (1, 2)]
    return rows.groupBy(what, n).agg(F.xxhash64(F.col(n), *marks).alias(name))


def disclosing(scanned: DataFrame, docs: DataFrame, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """(row_key, term): disclosing terms of the entities that a row holds, from counts over all rows.

    As n_both <= n_entity, a term can disclose an entity only if n_term is at most
    N^(1 - 1/alpha) * n_entity^(1/alpha). More frequent terms are dropped before terms
    and entities of a row are paired, which loses no pair and leaves few.
    """
    n = scanned.count()
    holders = scanned.where("size(entities) > 0")
    times = materialize(holders.groupBy("row_key").agg(F.count("*").alias("times")), "pii")  # rows that repeat have one key
    who = holders.select("row_key", F.explode("entities").alias("entity")).distinct()
    sizes = who.join(times, "row_key").groupBy("entity").agg(F.sum("times").alias("n_entity"))
    who = materialize(who.join(sizes, "entity").where(F.col("n_entity") < n), "pii")
    who = who.join(_classes(who, "entity", "n_entity", "who"), ["entity", "n_entity"]).select("row_key", "who", "n_entity").distinct()
    who = materialize(who, "pii")
    frequency = materialize(document_frequency(docs), "pii")
    most = lambda n_entity: n ** (1 - 1 / alpha) * F.pow(n_entity, F.lit(1 / alpha)) * (1 + 1e-9)
    largest = who.agg(F.coalesce(F.max("n_entity"), F.lit(0))).first()[0]
    # Terms in over a hundredth of the rows: at most 100 times the mean of distinct terms in a text.
    common = materialize(frequency.where(F.col("n_term") > F.greatest(most(F.lit(largest)), F.lit(n / 100))).select("term"), "pii")
    held = holders.select("row_key", F.explode(F.array_distinct(F.col("words.term"))).alias("term")).distinct().join(common, "term", "left_anti").join(frequency, "term")
    widest = who.groupBy("row_key").agg(F.max("n_entity").alias("n"))
    held = materialize(held.join(widest, "row_key").where(F.col("n_term") <= most(F.col("n"))).select("row_key", "term", "n_term"), "pii")
    held = materialize(held.join(_classes(held, "term", "n_term", "what"), ["term", "n_term"]), "pii")
    alike = held.select("row_key", "what", "n_term").distinct()
    paired = alike.join(who, "row_key").where(F.col("n_term") <= most(F.col("n_entity"))).join(times, "row_key")
    pairs = paired.groupBy("who", "what", "n_entity", "n_term").agg(F.sum("times").alias("n_both")).where(discloses(n, alpha, level))
    usual = expected_finds(n, frequency_classes(frequency))
    pairs = materialize(pairs.where(usual("n_both", "n_term", "n_entity") <= level + 1e-9).select("who", "what"), "pii")
    given = paired.select("row_key", "who", "what").join(pairs, ["who", "what"]).select("row_key", "what").distinct()
    return materialize(held.join(given, ["row_key", "what"]).select("row_key", "term").distinct(), "pii")


def discloses(n: int, alpha: float, level: float) -> Column:
    """Whether n_both, n_term and n_entity of a pair say that the term gives the entity away, and
    one such pair alone were no chance."""
    both, term, who = (F.col(c).cast("double") for c in ("n_both", "n_term", "n_entity"))
    seen, usual = both / who, term / n
    gain = seen * F.log(seen / usual) + F.when(seen < 1, (1 - seen) * F.log((1 - seen) / (1 - usual))).otherwise(0.0)
    return (F.log2(n * both / (term * who)) >= F.log2(n / who) / alpha) & (seen > usual) & (-who * gain <= math.log(level) + 1e-9)


def frequency_classes(frequency: DataFrame) -> list[tuple[int, float, int]]:
    """(least, mean, terms) of classes of document frequencies, each a twentieth wider than the one
    before: some 500 rows for any corpus."""
    class_of = F.floor(F.log("n_term") / math.log(1.05))
    rows = frequency.groupBy(class_of.alias("c")).agg(F.min("n_term"), F.avg("n_term"), F.count("*")).collect()
    return sorted(tuple(r)[1:] for r in rows)


def tail(k: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
    """Chernoff bound of the chance that k or more of n documents hold a term of that share."""
    seen = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = seen * np.log(seen / share) + np.where(seen < 1, (1 - seen) * np.log((1 - seen) / (1 - share)), 0.0)
    return np.where(seen > share, np.exp(-n * gain), 1.0)


def expected(both: int, term: int, who: int, n: int, least: np.ndarray, mean: np.ndarray, terms: np.ndarray) -> float:
    """How many terms of the corpus, spread at random, would meet an entity of `who` documents
    in so many that it is as surprising as `both` for one of `term` documents."""
    x = float(tail(np.array([float(both)]), who, np.array([term / n]))[0]) * (1 + 1e-9)
    lo, hi = np.zeros(len(least), np.int64), np.full(len(least), who + 1, np.int64)  # too few, enough
    while (hi - lo > 1).any():
        mid = (lo + hi) // 2
        enough = (mid > 0) & (tail(np.minimum(mid, who).astype(float), who, np.minimum(least / n, 1 - 1e-12)) <= x)
        hi, lo = np.where(enough, mid, hi), np.where(enough, lo, np.minimum(mid, hi - 1))
    met = np.where(hi <= who, tail(np.minimum(hi, who).astype(float), who, np.minimum(mean / n, 1 - 1e-12)), 0.0)
    return float((terms * met).sum())


def expected_finds(n: int, classes: list[tuple[int, float, int]]):
    """A column function of n_both, n_term and n_entity: `expected`."""
    least, mean, terms = (np.array(c, float) for c in zip(*classes, strict=True)) if classes else (np.zeros(0),) * 3

    @F.pandas_udf("double")
    def usual(both: pd.Series, term: pd.Series, who: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for key in zip(both.tolist(), term.tolist(), who.tolist(), strict=True):
            if key not in known:
                known[key] = expected(*key, n, least, mean, terms)
            out.append(known[key])
        return pd.Series(out, dtype=float)

    return usual


def flagged_terms(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """(row_key, terms): sorted spans of all places of disclosing terms of each row that has any."""
    words = scanned.where("size(entities) > 0").select("row_key", F.explode("words").alias("w")).select("row_key", "w.term", "w.start", "w.end")
    return words.join(found, ["row_key", "term"]).groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("terms"))


def find_personal_data(docs: DataFrame, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans of every row; spans are base ones, then `term` ones.

    Null and empty texts have no spans. Rows that repeat each count as a document.
    Rows with a null doc_id are kept. Texts of any length are searched whole, in time linear in
    them. Other columns are ignored. An empty table gives an empty result.
    """
    scanned = materialize(scan(docs), "pii")
    terms = flagged_terms(scanned, disclosing(scanned, docs, alpha, level))
    spans = F.concat_ws(
        ",", F.when(F.col("base_spans") != "", F.col("base_spans")),
        F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])), ","),
    )
    return scanned.join(terms, "row_key", "left").select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"))


def sanitise(docs: DataFrame, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in brackets; where two spans
    overlap, the union is replaced and named after the one that begins first. An n_chars
    column is counted anew where it was not null. Null texts stay null. Columns may be spelled
    in any case, and others may have any name."""
    scanned = materialize(scan(docs), "pii")
    terms = flagged_terms(scanned, disclosing(scanned, docs, alpha, level))
    names = docs.columns
    key, found = free_name("row_key", names), free_name("terms", names)
    at = [c.lower() for c in names].index("text")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text")))
    # Only the rows that have a span go through Python; the others stay where they are.
    changed = scanned.where("base_spans <> ''").select("row_key").union(terms.select("row_key")).distinct()
    changed = materialize(changed.select(F.col("row_key").alias(key)), "changed")
    rows = only(keyed, changed, key).join(changed, key).join(terms.select(F.col("row_key").alias(key), F.col("terms").alias(found)), key, "left").select(*names, found)

    def run(it):
        for batch in it:
            texts = [replaced(t, p) for t, p in zip(values(batch.column(at)), values(batch.column(len(names))), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).select(names)

    out = materialize(rows.mapInArrow(run, docs.schema), "sanitised")
    for c in names:
        if c.lower() == "n_chars":
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.char_length("text")).cast(docs.schema[c].dataType))
    return without(keyed, changed, key).select(names).union(out)


def replaced(text: str | None, terms: list[dict] | None) -> str | None:
    if not text:
        return text
    spans = sorted([(s, e, k) for k, found in zip(KINDS, find_base(text), strict=True) for s, e in found] + [(t["start"], t["end"], "term") for t in terms or []])
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
