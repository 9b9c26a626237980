"""Secrets: patterns, and strings that pass for random, by SQL functions alone.

Base spans are assignments of secrets, access keys and hexadecimal strings. Besides,
each run of at least LEAST characters of the usual encodings that no base span touches
is put to a battery of tests, after its encoding has been inferred from its characters:

* chi-squared of the characters against the uniform alphabet,
* the number of runs above and below the middle of the alphabet,
* the correlation of neighbouring characters.

Each test gives two p-values, and those of the three tests are combined by Fisher's
method. The first is for random characters: strings with a combined one under UNIFORM
are not random. They tell what written text is like in each alphabet: how far the three
statistics of three quarters of them lie from random ones, at least. The second p-value
is for such text: the chance that it comes as near to random characters. The
false-discovery rate of these is held at RATE by Benjamini and Hochberg's procedure in
each class of lengths, from counts by p-value over the whole table. A string is a find
if text is rejected, at that rate, and randomness is not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_row_key

KINDS = ("assign", "access", "hex")
# The patterns of the base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST, RATE, UNIFORM = 20, 0.001, 0.001
RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets by size: the pattern that they are inferred by (in this order), the characters, and the
#: excess of text's chi-squared for each character, until the table holds many more than PRIOR strings.
ALPHABETS = {
    10: ("[0-9]+", "0123456789", 0.5),
    16: ("[0-9a-f]+|[0-9A-F]+", "0123456789abcdef", 1.0),
    26: ("[a-z]+|[A-Z]+", "abcdefghijklmnopqrstuvwxyz", 0.7),
    32: ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.9),
    52: ("[A-Za-z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 2.3),
    62: ("[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 2.7),
    64: (".*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.8),
}
PRIOR, PRIOR_SHIFT = 100, 0.2
#: Steps of log10 p that the p-values are counted by, and the deepest.
FINE, DEEPEST = 16, 40


def find_spans(docs: DataFrame, key: str) -> DataFrame:
    """(row_key, no, start, end, s): spans in code points of each pattern, no being its
    number; s is the text of `random` ones. Texts without a match are not split. A place is
    the running sum of the lengths before it, taken over rows, so that the time is linear
    in the matches of a text."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": RANDOM}
    rows = docs.select(F.col(key).alias("row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_m") for k, p in patterns.items()),
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)).alias("assign_v"),
    )
    rows = rows.select(
        "row_key", "assign_v",
        *(c for k, p in patterns.items() for c in (f"{k}_m", F.when(F.size(f"{k}_m") > 0, F.split("text", p, -1)).otherwise(F.array().cast("array<string>")).alias(f"{k}_p"))),
    )

    def listed(no: int, kind: str) -> Column:
        fits = "length(assign_v[i]) >= 12" if kind == "assign" else "true"
        text = "m" if kind == "random" else "''"
        pairs = f"zip_with(slice({kind}_p, 1, size({kind}_m)), {kind}_m, (p, m) -> named_struct('step', length(p) + length(m), 'n', length(m), 's', {text}))"
        return F.expr(f"transform({pairs}, (x, i) -> named_struct('no', {no}, 'i', i, 'step', x.step, 'n', x.n, 's', x.s, 'fits', {fits}))")

    flat = rows.select("row_key", F.explode(F.concat(*(listed(i, k) for i, k in enumerate(patterns)))).alias("x")).select("row_key", "x.*")
    end = F.sum("step").over(Window.partitionBy("row_key", "no").orderBy("i")).cast("int")  # the matches of one text
    return flat.withColumn("end", end).where("fits").select("row_key", "no", (F.col("end") - F.col("n")).alias("start"), "end", "s")


def untouched(spans: DataFrame) -> DataFrame:
    """The `random` spans that no base span touches, sought among the neighbours in the text."""
    base = F.col("no") < len(KINDS)
    up, down = (Window.partitionBy("row_key").orderBy(c) for c in (F.asc("start"), F.desc("start")))  # the spans of one text
    near = spans.withColumn("before", F.max(F.when(base, F.col("end"))).over(up)).withColumn("after", F.min(F.when(base, F.col("start"))).over(down))
    return near.where(
        ~base & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    ).select("row_key", "start", "end", "s")


def _log_tail(z: str) -> str:
    """SQL of the natural logarithm of the normal distribution's upper tail at z (Abramowitz and Stegun 26.2.17)."""
    tail = lambda x: f"exp(-{x} * {x} / 2) * 0.3989422804D * aggregate(array(1.330274429D, -1.821255978D, 1.781477937D, -0.356563782D, 0.31938153D), 0D, (a, b) -> (a + b) / (1 + 0.2316419D * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN ln({tail(f'least({z}, 13D)')}) ELSE ln(1 - {tail(f'least(-({z}), 13D)')}) END)"


def _fisher(logs: list[str]) -> Column:
    """log10 of Fisher's combined p-value of three tests, from the logarithms of theirs."""
    h = f"(-({' + '.join(logs)}))"
    return F.expr(f"(-{h} + ln(1 + {h} + {h} * {h} / 2)) / ln(10D)")


def battery(strings: DataFrame) -> DataFrame:
    """row_key, start, end, k, n, excess (of chi-squared, for each character), runs_z, serial_z
    and uniform (log10 of the combined p-value for random characters) of each string of LEAST
    characters or more, without the `=` at its end."""
    k_of = "CASE " + " ".join(f"WHEN s RLIKE '^({p})$' THEN {k}" for k, (p, _, _) in ALPHABETS.items()) + " END"
    alphabet = "CASE k " + " ".join(f"WHEN {k} THEN '{a}'" for k, (_, a, _) in ALPHABETS.items()) + " END"
    plain = "CASE WHEN k IN (16, 26) THEN lower(s) WHEN k = 64 THEN translate(s, '-_', '+/') ELSE s END"
    rows = strings.withColumn("s", F.expr("rtrim('=', s)")).where(f"length(s) >= {LEAST}").withColumn("k", F.expr(k_of))
    # Ranks of the characters in the alphabet, from 0.
    rows = rows.withColumn("x", F.expr(f"transform(regexp_extract_all({plain}, '.', 0), y -> instr({alphabet}, y) - 1)")).drop("s")
    rows = rows.selectExpr(
        "*", "cast(size(x) as double) n", "aggregate(x, 0D, (a, y) -> a + y) / size(x) mean", "cast(size(filter(x, y -> 2 * y >= k)) as double) high",
        "aggregate(array_distinct(x), 0D, (a, r) -> a + pow(size(filter(x, y -> y = r)), 2)) squares", "zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1), (y, z) -> named_struct('y', y, 'z', z)) pairs",
    )
    rows = rows.selectExpr(
        "row_key", "start", "end", "k", "n", "k / n * squares - n chi", "2 * high * (n - high) / n + 1 mu", "1D + size(filter(pairs, p -> (2 * p.y >= k) <> (2 * p.z >= k))) runs",
        "aggregate(x, 0D, (a, y) -> a + pow(y - mean, 2)) spread", "aggregate(pairs, 0D, (a, p) -> a + (p.y - mean) * (p.z - mean)) serial",
    )
    rows = rows.selectExpr(
        "row_key", "start", "end", "k", "n", "chi", "(chi - (k - 1)) / n excess",
        # All on one side, or all alike: as far from random as the length allows.
        "CASE WHEN mu <= 2 THEN sqrt(n) ELSE abs(runs - mu) / sqrt((mu - 1) * (mu - 2) / (n - 1)) END runs_z",
        "CASE WHEN spread = 0 THEN sqrt(n) ELSE abs(serial / spread) * sqrt(n) END serial_z",
        "(pow(chi / (k - 1), 1D / 3) - 1 + 2D / (9 * (k - 1))) / sqrt(2D / (9 * (k - 1))) chi_z",
    )
    both = "(ln(2D) + {})"
    uniform = _fisher([_log_tail("chi_z"), both.format(_log_tail("runs_z")), both.format(_log_tail("serial_z"))])
    return rows.withColumn("uniform", uniform).drop("chi_z", "chi")


def text_nulls(tested: DataFrame) -> dict[int, tuple[float, float, float]]:
    """For each alphabet: how far text lies from random characters in excess of chi-squared
    for each character, and in runs and correlation for each root of the length. It is the
    first quartile of the strings that are not random, PRIOR strings of the values above
    counting with them. One row an alphabet is gathered."""
    far = tested.where(F.col("uniform") < math.log10(UNIFORM)).groupBy("k")
    quarter = lambda c: F.percentile_approx(c, 0.25)
    rows = far.agg(
        F.count("*").alias("m"), quarter("excess").alias("a"), quarter(F.expr("runs_z / sqrt(n)")).alias("b"),
        quarter(F.expr("serial_z / sqrt(n)")).alias("c"),
    ).collect()
    seen = {r["k"]: r for r in rows}
    out = {}
    for k, (_, _, excess) in ALPHABETS.items():
        m = seen[k]["m"] if k in seen else 0
        out[k] = tuple((PRIOR * p + m * (seen[k][c] if m else 0.0)) / (PRIOR + m) for c, p in zip("abc", (excess, PRIOR_SHIFT, PRIOR_SHIFT), strict=True))
    return out


def text_p(tested: DataFrame, nulls: dict[int, tuple[float, float, float]]) -> DataFrame:
    """`tested` with length (the class of lengths) and step (of log10 of the combined p-value for text)."""
    rows = tested
    for i, name in enumerate(("e", "r", "c")):
        rows = rows.withColumn(name, F.expr("CASE k " + " ".join(f"WHEN {k} THEN {max(v[i], 1e-6)!r}D" for k, v in nulls.items()) + " END"))
    rows = rows.selectExpr("*", "(n * e - n * excess) / sqrt(2 * (k - 1) + 4 * n * e) chi_t")
    # The chance of |N(d, 1)| being at most z; tails beyond the table's end are as at 13.
    lower = lambda z, d: f"greatest(-85D, {_log_tail(f'({d} * sqrt(n) - {z})')} + ln(greatest(1e-16, 1 - exp({_log_tail(f'({d} * sqrt(n) + {z})')} - {_log_tail(f'({d} * sqrt(n) - {z})')}))))"
    combined = _fisher([_log_tail("chi_t"), lower("runs_z", "r"), lower("serial_z", "c")])
    step = F.least(F.lit(DEEPEST * FINE), F.greatest(F.lit(0), F.floor(-FINE * F.col("text")))).cast("int")
    return rows.withColumn("text", combined).withColumn("step", step).withColumn("length", F.expr("cast(least(floor(log2(n)), 8) as int)")).drop("e", "r", "c", "chi_t", "text")


def thresholds(tested: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each class of lengths, the least step at which the false-discovery rate holds.
    Only counts by class and step are gathered: at most some thousand rows, whatever the table."""
    counts = tested.groupBy("length", "step").agg(F.count("*").alias("n"))
    every = Window.partitionBy("length")
    down = every.orderBy(F.desc("step"))
    held = counts.withColumn("found", F.sum("n").over(down)).withColumn("all", F.sum("n").over(every)).where(
        F.col("all") * F.pow(F.lit(10.0), -F.col("step") / FINE) <= rate * F.col("found")
    )
    return {r["length"]: r["step"] for r in held.groupBy("length").agg(F.min("step").alias("step")).collect()}


def random_strings(strings: DataFrame, rate: float = RATE) -> DataFrame:
    """row_key, start, end of the strings (row_key, start, end, s) that pass for random."""
    tested = materialize(battery(strings), "battery")
    tested = text_p(tested, text_nulls(tested))
    least = thresholds(tested, rate)
    fit = " OR ".join(f"(length = {n} AND step >= {s})" for n, s in least.items()) or "false"
    return tested.where(F.col("uniform") >= math.log10(UNIFORM)).where(fit).select("row_key", "start", "end")


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; spans are
    ordered by start, then kind, and have the base ones and those of kind `random`,
    which no base span touches.

    Null and empty texts have no spans; rows that repeat are each tested, null ids too. Texts
    of any length are searched whole.
    Other columns are ignored; an empty table gives an empty result.
    """
    keyed, key = with_row_key(docs)
    spans = materialize(find_spans(keyed, key), "spans")
    found = random_strings(untouched(spans), rate).select("row_key", "start", F.lit(len(KINDS)).alias("no"), "end")
    every = spans.where(F.col("no") < len(KINDS)).select("row_key", "start", "no", "end").union(found)
    every = every.groupBy("row_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "no", "end"))).alias("all"),
        *(F.count_if(F.col("no") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
    )
    rows = keyed.select(F.col(key).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id")).join(every, "row_key", "left")
    names = ", ".join(f"'{k}'" for k in (*KINDS, "random"))
    joined = lambda c: F.expr(
        f"coalesce(array_join(transform({c}, x -> concat_ws(':', element_at(array({names}), x.no + 1), cast(x.start as string), cast(x.end as string))), ','), '')"
    )
    return rows.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(f"filter(all, x -> x.no < {len(KINDS)})").cast("binary"), 256).alias("base_sha256"), joined("all").alias("spans"),
    )
