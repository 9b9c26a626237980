"""Language of a text: known words first, shorter and shorter character n-grams for others.

A word seen at least `known` times in the training sample is scored by its smoothed
log frequency in each language. Any other word is walked from left to right: at each
place the longest n-gram (of `longest` characters down to one) that the sample has is
scored and stepped over; what no table has is skipped. Word ends are marked, so
prefixes and endings are n-grams of their own.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize

_WORD = re.compile(r"[^\W\d_]+")
LONGEST, KNOWN, SAMPLE = 5, 3, 6000
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"


def _counts(it):
    """(lang, kind, unit, n) of the words and n-grams of labelled texts; kind 0: words, else the length."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("unit", pa.string()), ("n", pa.int64())])
    units: dict = defaultdict(int)

    def flushed():
        keys = list(units)
        made = batches({"lang": [k[0] for k in keys], "kind": [k[1] for k in keys], "unit": [k[2] for k in keys], "n": list(units.values())}, schema)
        units.clear()
        return made

    for batch in it:
        words: dict = defaultdict(int)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in _WORD.findall((text or "").lower()):
                words[lang, w] += 1
        for (lang, w), n in words.items():
            units[lang, 0, w] += n
            marked = f"^{w}$"
            for i in range(len(marked)):
                for k in range(1, min(LONGEST, len(marked) - i) + 1):
                    units[lang, k, marked[i : i + k]] += n
                if len(units) > 400_000:  # counts of parts add up
                    yield flushed()
    yield flushed()


class Model:
    """Log-frequency vectors, one entry a language (sorted by code point)."""

    def __init__(self, langs: list[str], rows: list[tuple], prior: list[int], sums: list[tuple] = (), kinds: dict | None = None):
        """rows: (lang, kind, unit, n) of recurring units; sums: (lang, kind, n) and kinds: how many
        units there are of each kind, both of all units of the sample."""
        self.langs, kinds = langs, kinds or {}
        at = {x: i for i, x in enumerate(langs)}
        table: dict = defaultdict(lambda: np.zeros(len(langs)))
        for lang, kind, unit, n in rows:
            table[kind, unit][at[lang]] += n
        total = defaultdict(lambda: np.zeros(len(langs)))
        for lang, kind, n in sums:
            total[kind][at[lang]] += n
        self.words = {u: np.log((v + 0.05) / (total[0] + 0.05 * kinds[0])).astype(np.float32) for (k, u), v in table.items() if k == 0}
        self.grams = {u: np.log((v + 0.3) / (total[k] + 0.3 * kinds[k])).astype(np.float32) for (k, u), v in table.items() if k}
        self.prior = np.log((np.array(prior) + 1.0) / (sum(prior) + len(langs))) if langs else np.zeros(0)
        self.memory: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        known = self.words.get(w)
        if known is None:
            known = self.memory.get(w)
        if known is None:
            known, marked, i = np.zeros(len(self.langs), np.float32), f"^{w}$", 0
            while i < len(marked):
                for k in range(min(LONGEST, len(marked) - i), 0, -1):
                    g = self.grams.get(marked[i : i + k])
                    if g is not None:
                        known = known + g
                        i += k
                        break
                else:
                    i += 1
            if len(w) < 64:
                if len(self.memory) > 200_000:
                    self.memory.clear()
                self.memory[w] = known
        return known


class FastModel(Model):
    """Rows of one matrix instead of single vectors: a text is one indexed sum."""

    def __init__(self, *args):
        super().__init__(*args)
        self.row: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.langs)), np.float32)

    def _row(self, w: str) -> int:
        i = self.row.get(w)
        if i is None:
            if len(self.row) >= 400_000:
                self.row.clear()
                self.matrix = np.zeros((1024, len(self.langs)), np.float32)
            i = len(self.row)
            if i == len(self.matrix):
                self.matrix = np.concatenate((self.matrix, np.zeros_like(self.matrix)))
            self.row[w] = i
            self.matrix[i] = self.word(w)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not words or not self.langs:
            return "und", 0.0
        score = self.prior.copy()
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            if len(self.row) + len(part) > 400_000:
                self.row.clear()
            at = list(map(self.row.get, part))
            if None in at:
                at = [self._row(w) if i is None else i for w, i in zip(part, at, strict=True)]
            score += self.matrix[at].sum(0, dtype=float)
        best = int(np.argmax(score))
        return self.langs[best], float(1 / np.exp(np.minimum(score - score[best], 0)).sum())


def shares(counts: dict[str, int], sample: int) -> dict[str, float]:
    """The share of each language's documents that is learned from: all of a rare one, and
    equally many of the others, `sample` in all."""
    most, left, part = 0.0, sample, sorted(counts.values())
    for i, n in enumerate(part):
        most = left / (len(part) - i)
        if n >= most:
            break
        left -= n
    else:
        most = max(part, default=0)
    return {x: min(1.0, most / n) for x, n in counts.items()}


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple:
    """Arguments of a Model, from about `sample` labelled documents outside the held-out
    part, taken by language and the hash of doc_id, so that no language is left out.

    Only the recurring units (KNOWN times) of that bounded sample, and sums of the others, reach
    the driver. Rows that repeat are learned as often; texts count whole, whatever
    their length; of an empty table, or one without labels, nothing is learned.
    """
    labelled = docs.where(
        f"lang is not null and text is not null and not coalesce({HELD_OUT}, false)"
    ).select(F.col("lang").cast("string"), F.col("text").cast("string"), "doc_id")
    prior = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(prior)
    if not langs:
        return [], [], [], [], {}
    bound = F.create_map(*[F.lit(v) for x, share in shares(prior, sample).items() for v in (x, math.ceil(share * (1 << 20)))])
    part = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.element_at(bound, F.col("lang")))
    units = part.select("lang", "text").mapInArrow(_counts, "lang string, kind int, unit string, n long").groupBy("lang", "kind", "unit").agg(F.sum("n").alias("n"))
    units = materialize(units, "units")
    sums = [tuple(r) for r in units.groupBy("lang", "kind").agg(F.sum("n")).collect()]
    each = units.groupBy("kind", "unit").agg(F.sum("n").alias("all"))
    kinds = {r["kind"]: r["n"] for r in each.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    table = units.join(each.where(F.col("all") >= KNOWN), ["kind", "unit"]).select("lang", "kind", "unit", "n").toArrow().to_pydict()
    return langs, list(zip(table["lang"], table["kind"], table["unit"], table["n"], strict=True)), [prior[x] for x in langs], sums, kinds


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; ties go to the first language by
    code point. Text null, empty or without a letter, or nothing learned: `und`, 0.
    A null doc_id is not held out. Texts of any length are scored whole; rows that repeat are scored
    alike. Other columns are ignored; an empty table gives an empty result."""
    cell = docs.sparkSession.sparkContext.broadcast(_pack(model))  # bounded by the training sample

    def run(it):
        m = _unpack(cell.value)
        for batch in it:
            found = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    given = docs.select(F.col("doc_id").cast("long"), F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _pack(model: tuple) -> dict:
    """What the tasks need of the model: recurring words and n-grams as two matrices."""
    m = Model(*model)
    return {
        "langs": m.langs, "prior": m.prior, "words": (list(m.words), np.array(list(m.words.values()), np.float32)),
        "grams": (list(m.grams), np.array(list(m.grams.values()), np.float32)),
    }


def _unpack(x: dict) -> FastModel:
    m = FastModel(x["langs"], [], [0] * len(x["langs"]))
    m.prior = x["prior"]
    m.words, m.grams = (dict(zip(names, list(rows), strict=True)) for names, rows in (x["words"], x["grams"]))
    return m
