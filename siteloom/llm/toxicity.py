"""Severity of toxic text by cumulative-link ordinal regression.

Grades are ordered: 0 clean, 1 toxic, 2 severely toxic. One weight vector over sparse
word features serves all thresholds: P(grade > j) = sigmoid(w.x - c_j), with c_0 < c_1.
The expected severity is the sum of these over j.

Where labels have a `grade` column (0 clean, 1 toxic, 2 severe, as from the number of
annotators that objected), it is what is fitted. Labels that only say toxic or not leave
the severe grade open: those toxic documents of the sample count as severe that hold more
of the features that go with toxicity than the median toxic document. That is a limit:
the second threshold then orders documents by how much of the toxic vocabulary they
hold, which no annotator has confirmed; the first one, and is_toxic, rest on labels alone.

A feature is the hash bucket of a word (lower-cased run of letters or digits) or of its
beginning of 4, 5 or 6 characters, so that endings don't hide a stem; its value is 1
where it occurs. Two and three different words with a beginning are features too. Features that the grade doesn't depend on (G-test under `LEAST_G`, or in
fewer than `LEAST_DOCS` documents of the sample) have weight 0. Weights are fitted on a
bounded sample of labelled documents (`sample`, by the hash of doc_id); all are scored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, values, with_row_key, without

BUCKETS = 1 << 20
LEAST_G, LEAST_DOCS = 20.0, 5
GRADES = 3
_WORD = re.compile(r"[^\W_]+")


class WordFeatures(dict):
    """Buckets of a word and its beginnings; bounded, one per task."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = [word, *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]
        found = tuple(xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts)
        if len(word) < 64:
            if len(self) >= 60_000:
                self.clear()
            self[word] = found
        return found


def features(text: str | None, words: WordFeatures) -> np.ndarray:
    """Sorted distinct feature buckets of a text."""
    found = list(chain.from_iterable(map(words.__getitem__, set(_WORD.findall((text or "").lower())))))
    once, n = np.unique(np.array(found, np.int64), return_counts=True)
    return np.unique(np.concatenate([once, *((once[n >= k] * 40_503 + k) % BUCKETS for k in (2, 3))]))


def _g_test(seen: np.ndarray, of: np.ndarray) -> np.ndarray:
    """G statistic of presence against grade; seen[j, f] of of[j] documents hold f."""
    total, whole = seen.sum(0), of.sum()
    g = np.zeros(seen.shape[1])
    for j in range(len(of)):
        for n, share in ((seen[j], total / whole), (of[j] - seen[j], 1 - total / whole)):
            expected = np.maximum(share * of[j], 1e-12)
            g += np.where(n > 0, 2 * n * np.log(np.maximum(n, 1e-12) / expected), 0)
    return g


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most about `sample` labelled documents as (doc_id, text, grade), by hash of doc_id.
    A document labelled more than once has the highest grade; null labels are left out."""
    grade = F.least(F.greatest(F.col("grade"), F.lit(0)), F.lit(GRADES - 1)) if "grade" in labels.columns else F.col("toxic") > 0
    known = labels.withColumn("grade", grade.cast("int")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    total = known.count()
    share = min(1.0, sample / max(1, total))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", "text", "grade")


def likelihood(score: np.ndarray, cut: np.ndarray, y: np.ndarray, per: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, its gradient by score, by cut): the negative logarithm of P(grade y), document i
    weighing per[i]. log P(grade g) = log(F(c_g - s) - F(c_{g-1} - s)), F logistic,
    F(c_{-1}) = 0, F(c_{last}) = 1."""
    each = np.arange(len(y))
    below = np.zeros((len(y), len(cut) + 2))
    below[:, 1:-1] = 1 / (1 + np.exp(-np.clip(cut - score[:, None], -30, 30)))
    below[:, -1] = 1.0
    upper, lower = below[each, y + 1], below[each, y]
    steep = below * (1 - below) * (per / np.maximum(upper - lower, 1e-9))[:, None]
    by_cut = np.array([steep[y == j + 1, j + 1].sum() - steep[y == j, j + 1].sum() for j in range(len(cut))])
    return float(-(per * np.log(np.maximum(upper - lower, 1e-9))).sum()), (1 - upper - lower) * per, by_cut


def _fit(flat: np.ndarray, length: np.ndarray, y: np.ndarray, graded: bool, rounds: int, ridge: float, pace: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient descent (Adam) on the ordinal likelihood; deterministic. `flat` has the
    features of all documents in a row, `length` how many each has; `graded`: y has all grades."""
    w, cut = np.zeros(BUCKETS), np.arange(GRADES - 1) * 1.0 + 1
    if not len(y) or not (y > 0).any():
        return w, cut + 20.0
    row = np.repeat(np.arange(len(y), dtype=np.int32), length)
    seen = np.stack([np.bincount(flat[(y[row] > 0) == j], minlength=BUCKETS) for j in (False, True)])
    keep = (seen.sum(0) >= LEAST_DOCS) & (_g_test(seen, np.array([(y == 0).sum(), (y > 0).sum()])) >= LEAST_G)
    row, flat = row[keep[flat]], flat[keep[flat]]
    if not len(flat):
        return w, cut + 20.0
    if not graded:
        rate = seen / np.maximum(1, np.array([[(y == 0).sum()], [(y > 0).sum()]]))
        evidence = np.bincount(row[rate[1, flat] > rate[0, flat]], minlength=len(y))
        y = np.where(y > 0, 1 + (evidence > np.median(evidence[y > 0])), 0)
    used, at = np.unique(flat, return_inverse=True)
    v, gap = np.zeros(len(used)), np.log(np.diff(cut))
    first = cut[0]
    state = [np.zeros(len(used) + GRADES - 1) for _ in range(2)]
    per = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, rounds + 1):
        cut = first + np.concatenate(([0.0], np.cumsum(np.exp(gap))))
        _, g_score, g_cut = likelihood(np.bincount(row, v[at], len(y)), cut, y, per)
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate((np.bincount(at, g_score[row], len(used)) + ridge * v, [tail[0]], tail[1:] * np.exp(gap)))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = pace * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        v -= move[: len(used)]
        first -= move[len(used)]
        gap = np.clip(gap - move[len(used) + 1 :], -6, 3)
    w[used] = v
    return w, first + np.concatenate(([0.0], np.cumsum(np.exp(gap))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000, rounds: int = 600, ridge: float = 1e-3, pace: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds). Only the feature buckets and grades of the bounded sample
    reach the driver; without toxic labels nothing is found toxic."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.int32())), ("grade", pa.int64())])

    def run(it):
        words = WordFeatures()
        for batch in it:
            x = [features(t, words) for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.int32())), batch.column("grade").cast(pa.int64())], schema=schema)

    given = labelled_sample(docs, labels, sample).selectExpr("cast(doc_id as long) doc_id", "text", "grade")
    with small_batches(docs.sparkSession):
        rows = given.mapInArrow(run, "doc_id long, x array<int>, grade long").toArrow().sort_by("doc_id")
    x = rows.column("x").combine_chunks()
    return _fit(x.flatten().to_numpy(), np.diff(x.offsets.to_numpy()), rows.column("grade").to_numpy(), "grade" in labels.columns, rounds, ridge, pace)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`docs` with expected_severity (0 to 2), severity (most likely side of each
    threshold) and is_toxic. Null and empty texts have no features and count as clean
    unless the model says otherwise of all texts; columns of those names are replaced. Texts of any
    length are scored whole, rows that repeat alike; an empty table stays empty."""
    names = ("expected_severity", "severity", "is_toxic")
    docs = docs.drop(*names)
    w, cut = model
    cell = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), cut))  # fixed size: BUCKETS floats

    def run(it):
        words, (w, cut) = WordFeatures(), cell.value
        for batch in it:
            s = np.array([float(w[features(t, words)].sum()) if t else np.nan for t in values(batch.column("text"))], float)
            p = 1 / (1 + np.exp(-np.clip(s[:, None] - cut, -30, 30)))
            p[np.isnan(s)] = 0.0
            cols = [pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)]
            for name, col in zip(names, cols, strict=True):
                batch = batch.append_column(name, col)
            yield batch

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, expected_severity double, severity int, is_toxic boolean")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`docs` without the rows that `score` finds toxic; all columns as they are. The keys of the
    rows that go are found first, so no text comes back from Python."""
    w, cut = model
    cell = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), cut))  # fixed size: BUCKETS floats

    def run(it):
        words, (w, cut) = WordFeatures(), cell.value
        for batch in it:
            bad = [bool(t) and float(w[features(t, words)].sum()) >= cut[0] for t in values(batch.column(1))]
            yield batch.select([0]).filter(pa.array(bad, pa.bool_()))

    keyed, key = with_row_key(docs)
    toxic = keyed.select(key, F.col("text").cast("string").alias("_t")).mapInArrow(run, f"`{key}` long")
    return without(keyed, materialize(toxic, "toxic"), key).select(*(F.col(f"`{c}`") for c in docs.columns))
