"""Exact removal of byte strings that occur more than once, by distributed prefix doubling.

A position's rank names the string of h bytes that starts there. The string of up to 2h
bytes there is named by a pair of ranks, at the position and at an offset from it; Spark
sorts and counts such pairs over all documents and ranks them anew, at growing lengths,
until a string is unique (its positions leave) or is past the threshold (its positions
are repeated and leave).

Not every byte is sorted. Each window of `least` bytes is represented by its anchor, the
leftmost smallest of its short strings (of `SHORT` bytes at 400), so equal windows have
equal anchors at equal distances, and neighbouring windows share theirs: a run of windows
is one row. Short ranks are made inside a text by doubling (1, 2, 4, ... bytes), where a
pair's rank is its 64-bit hash. Rounds over all documents:

1. anchors: runs whose anchor is unique leave;
2. runs: where all runs of an anchor agree in all bytes that their windows cover, all of
   these windows are repeated; so are those of a run that another equals;
3. pieces of 64, 16, 4 and 1 windows of the runs that remain, one for each different run:
   of pieces with one anchor and place, the string that all windows of the piece share
   grows with each round (337, 385, 397, 400 bytes). A piece whose common string is unique
   leaves; a piece that another equals in all bytes is repeated; the others are split.

Work after round 2 grows with the number of edges of repeated passages, not with their
bytes or copies. A pair of 64-bit ranks decides, so a collision takes two at one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_KEYS, batches, free_name, materialize, only, utf8, with_row_key, without

LEAST = 400
#: Bytes that are ranked at a time in a task, about (a longer text in parts that overlap).
PART = 1 << 17
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INDEX_BITS = 20


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 64-bit names of pairs of ranks."""
    with np.errstate(over="ignore"):
        r = (a ^ (a >> np.uint64(29))) * _M1
        r += b
        r ^= r >> np.uint64(32)
        r *= _M2
        r ^= r >> np.uint64(29)
    return r


def lengths(least: int) -> tuple[int, int]:
    """Bytes of an anchor's string, and the longest doubled length, at least half of `least`."""
    half = 1 << ((least - 1).bit_length() - 1)
    return max(1, half // 4), half


def ranks(data: np.ndarray, wanted: tuple) -> dict[int, np.ndarray]:
    """Ranks of the strings of h bytes at all positions of `data` (uint8), for h in `wanted`."""
    x, h, found = data.astype(np.uint64), 1, {}
    while True:
        if h in wanted:
            found[h] = x
        if h >= max(wanted):
            return found
        a, b = x[: max(0, len(x) - h)], x[h:]
        x = (a << np.uint64(8 * h)) | b if h < 8 else pair(a, b)
        h *= 2


def sliding_first_min(order: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest of `order` in each run of w, by block minima."""
    n = len(order)
    index = np.uint64((1 << _INDEX_BITS) - 1)
    key = (order & ~index) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    full[:n] = key
    block = full.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & index).astype(np.int64)


def window_ranks(half: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    return pair(half[at], half[at + least - lengths(least)[1]])


def span_ranks(half: np.ndarray, first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> np.ndarray:
    """Names of all bytes of the windows from `first` to `last`, which overlap, and of their
    distances hi to lo from the anchor."""
    ends = pair(window_ranks(half, first, least), window_ranks(half, last, least))
    return pair(ends, (hi.astype(np.uint64) << np.uint64(32)) | lo.astype(np.uint64))


def runs_of(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, lo, hi, rank, whole) of the runs of windows of several texts: the run's
    windows start lo to hi bytes before the anchor; `rank` names the anchor's string, `whole`
    all bytes of the run."""
    short, half = lengths(least)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    windows = np.maximum(0, size - least + 1)
    r = ranks(np.frombuffer(b"".join(texts), np.uint8), (short, half))
    with np.errstate(over="ignore"):
        order = r[short] * np.uint64(0x9E3779B97F4A7C15)
        order ^= order >> np.uint64(31)
    anchor = sliding_first_min(order, least - short + 1)
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + start[text]
    mine = anchor[at]
    cut = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
    first, last, text, a = at[cut], at[np.append(cut[1:], len(at)) - 1], text[cut], mine[cut]
    whole = span_ranks(r[half], first, last, a - last, a - first, least)
    return text, a - start[text], a - last, a - first, r[short][a], whole


_RUN = pa.schema([("row_key", pa.int64()), ("anchor", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("rank", pa.int64()), ("whole", pa.int64())])


def _parts(keys: list, texts: list, least: int):
    """Lists of (row_key, offset, bytes) of some PART bytes with a window each."""
    part, held = [], 0
    for key, text in zip(keys, texts, strict=True):
        for lo in range(0, len(text) - least + 1, PART):
            piece = text[lo : lo + PART + least - 1]
            if held and held + len(piece) > PART + least:
                yield part
                part, held = [], 0
            part.append((key, lo, piece))
            held += len(piece)
    if part:
        yield part


def find_runs(keyed: DataFrame, key: str, least: int) -> DataFrame:
    """The runs of windows of all texts: row_key, anchor, lo, hi, rank, whole."""

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or b"" for t in utf8(part.column(1)).to_pylist()]
                for some in _parts(part.column(0).to_pylist(), texts, least):
                    text, a, low, high, rank, whole = runs_of([p[2] for p in some], least)
                    keys, offset = np.array([p[0] for p in some]), np.array([p[1] for p in some])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[text]), pa.array(a + offset[text]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                        pa.array(rank.view(np.int64)), pa.array(whole.view(np.int64)),
                    ], schema=_RUN)

    given = keyed.select(F.col(key).alias("row_key"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "row_key long, anchor long, lo int, hi int, rank long, whole long")


_OPEN = "row_key long, anchor long, lo int, hi int, rank long, sure boolean, body binary"


def fetch_bodies(keyed: DataFrame, key: str, runs: DataFrame, least: int) -> DataFrame:
    """`runs` (row_key, anchor, lo, hi, rank, sure) with body, the bytes that their windows cover."""

    def run(it):
        for batch in it:
            rows = {f.name: [] for f in schema}
            for i in range(batch.num_rows):
                text = utf8(batch.column(0).slice(i, 1))[0].as_py()
                for w in batch.column(1)[i].as_py():
                    rows["row_key"].append(batch.column(2)[i].as_py())
                    for name in ("anchor", "lo", "hi", "rank", "sure"):
                        rows[name].append(w[name])
                    rows["body"].append(text[w["anchor"] - w["hi"] : w["anchor"] - w["lo"] + least])
                if len(rows["body"]) >= 4096:
                    yield batches(rows, schema)
                    rows = {f.name: [] for f in schema}
            yield batches(rows, schema)

    schema = pa.schema([*[_RUN.field(n) for n in ("row_key", "anchor", "lo", "hi", "rank")], ("sure", pa.bool_()), ("body", pa.binary())])
    wanted = materialize(runs.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "lo", "hi", "rank", "sure")).alias("wanted")), "wanted")
    texts = keyed.select(F.col(key).alias("_key"), F.col("text").cast("string").alias("text"))
    texts = only(texts, wanted.select(F.col("row_key").alias("_key")), "_key")
    joined = texts.join(wanted, F.col("_key") == F.col("row_key")).select("text", "wanted", "row_key")
    return joined.mapInArrow(run, _OPEN)


def pieces_of(bodies: list[bytes], lo: np.ndarray, hi: np.ndarray, size: int, least: int) -> tuple[np.ndarray, ...]:
    """(row, place, one, two, lo, hi, whole) of the pieces of `size` windows: the pair of ranks
    of the bytes that all windows of an uncut piece share, and the name of all bytes."""
    half = lengths(least)[1]
    r = ranks(np.frombuffer(b"".join(bodies), np.uint8), (half,))[half]
    start = np.concatenate(([0], np.cumsum([len(b) for b in bodies])[:-1])).astype(np.int64)
    count = hi // size - lo // size + 1
    row = np.repeat(np.arange(len(bodies)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (lo // size)[row]
    low, high = np.maximum(lo[row], place * size), np.minimum(hi[row], place * size + size - 1)
    base = start[row] + hi[row]  # a window at distance o starts at base - o
    common = base - place * size
    one, two = r[common], r[common + least - size + 1 - half]
    return row, place, one, two, low, high, span_ranks(r, base - high, base - low, low, high, least)


def split(opened: DataFrame, size: int, least: int) -> DataFrame:
    """Pieces of `size` windows of the open runs."""
    schema = pa.schema([
        ("row_key", pa.int64()), ("anchor", pa.int64()), ("rank", pa.int64()), ("sure", pa.bool_()), ("place", pa.int32()),
        ("one", pa.int64()), ("two", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("whole", pa.int64()),
    ])

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = {n: part.column(n).to_numpy(zero_copy_only=False) for n in ("row_key", "anchor", "lo", "hi", "rank", "sure")}
                row, place, one, two, low, high, whole = pieces_of(part.column("body").to_pylist(), own["lo"].astype(np.int64), own["hi"].astype(np.int64), size, least)
                made = [own["row_key"][row], own["anchor"][row], own["rank"][row], own["sure"][row].astype(bool), place.astype(np.int32)]
                made += [one.view(np.int64), two.view(np.int64), low.astype(np.int32), high.astype(np.int32), whole.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

    ddl = "row_key long, anchor long, rank long, sure boolean, place int, one long, two long, lo int, hi int, whole long"
    return opened.mapInArrow(run, ddl)


def _ranges(rows: DataFrame, least: int) -> DataFrame:
    return rows.select("row_key", F.expr("anchor - hi").alias("start"), F.expr(f"anchor - lo + {least}").alias("end"))


def repeated_ranges(keyed: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """row_key, start, end: ranges of bytes, overlapping, whose union are all bytes covered by
    a string of `least` bytes that starts anywhere else too."""
    runs = materialize(find_runs(keyed, key, least), "runs")
    anchors = runs.groupBy("rank").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n > 1")
    anchors = materialize(anchors.select("rank", F.expr("low <> high").alias("mixed")), "anchors")
    shared = runs.join(F.broadcast(anchors) if anchors.count() <= FEW_KEYS else anchors, "rank")
    shared = materialize(shared, "shared")
    found = [_ranges(shared.where("not mixed"), least)]
    # Of runs that differ, each different one goes on once; it is sure to be repeated if it is there twice.
    first = F.min(F.struct("row_key", "anchor", "lo", "hi")).alias("first")
    kinds = materialize(shared.where("mixed").groupBy("rank", "whole").agg(F.count("*").alias("n"), first), "kinds")
    found.append(_ranges(shared.where("mixed").join(kinds.where("n > 1").select("rank", "whole"), ["rank", "whole"]), least))
    some = kinds.groupBy("rank").agg(F.min("n").alias("least_n")).where("least_n = 1").select("rank")
    going = kinds.join(some, "rank").select("first.*", "rank", F.expr("n > 1").alias("sure"))
    opened = materialize(fetch_bodies(keyed, key, materialize(going, "going"), least), "open")
    for size in sizes(least):
        pieces = materialize(split(opened, size, least), "pieces")
        common = ["rank", "place", "one", "two"]
        kinds = pieces.groupBy(*common, "whole").agg(F.count("*").alias("n"), F.bool_or("sure").alias("sure"), first)
        kinds = materialize(kinds, "kinds")
        again = pieces.where("not sure").join(kinds.where("n > 1").select(*common, "whole"), [*common, "whole"])
        found.append(_ranges(again, least))
        if size == 1:
            break
        some = kinds.groupBy(*common).agg(F.count("*").alias("k"), F.bool_or(F.expr("n = 1 and not sure")).alias("open")).where("k > 1 and open")
        going = kinds.join(some.select(*common), common).select("first.*", F.xxhash64(*common).alias("rank"), F.expr("sure or n > 1").alias("sure"))
        old = opened.select(F.col("row_key").alias("_key"), F.col("anchor").alias("_anchor"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "body")
        same = (F.col("row_key") == F.col("_key")) & (F.col("anchor") == F.col("_anchor")) & F.col("lo").between(F.col("_lo"), F.col("_hi"))
        body = F.expr(f"substring(body, _hi - hi + 1, {least} + hi - lo)").alias("body")
        opened = materialize(going.join(old, same).select("row_key", "anchor", "lo", "hi", "rank", "sure", body), "open")
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.unionByName(more)
    return ranges


def sizes(least: int) -> list[int]:
    """Numbers of windows in a piece, of each round."""
    half = lengths(least)[1]
    return [4**k for k in range(3, -1, -1) if least - 4**k + 1 >= half]


def cut_repeats(docs: DataFrame, least: int = LEAST, carry: tuple = ("doc_id",)) -> DataFrame:
    """The columns `carry` of each row of `docs`, with n_bytes, kept (binary: the text's UTF-8
    bytes without the repeated ones) and spans (array of start and end: the maximal removed
    runs, in bytes, end exclusive).

    Every byte covered by a string of `least` bytes that starts anywhere else, in the same text or
    another, is removed; strings are judged on the input. Strings never cross texts.

    A null text is an empty one: kept is empty. Texts of under `least` bytes are kept whole. Rows
    that repeat are texts like others, so all lose all their bytes if these are `least` or more.
    Texts are read whole, whatever their length, long ones in parts that overlap. An empty
    table stays empty. Other columns are not looked at; carried ones may have any name.
    """
    keyed, key = with_row_key(docs)
    ranges = repeated_ranges(keyed, key, least)
    spans = materialize(ranges.groupBy("row_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    n, (text, k, found) = len(carry), (free_name(x, list(carry)) for x in ("whole_text", "place", "ranges"))
    spans = spans.select(F.col("row_key").alias(k), F.col("spans").alias(found))
    own = [F.col(f"`{c}`") for c in carry]
    given = keyed.select(*own, F.col("text").cast("string").alias(text), F.col(key).alias(k))
    clean = without(given, spans.select(k), k).withColumn(text, F.coalesce(text, F.lit("")).cast("binary"))
    nothing = F.expr("cast(array() as array<struct<start: long, end: long>>)")
    clean = clean.select(*own, F.octet_length(text).cast("long").alias("n_bytes"), F.col(text).alias("kept"), nothing.alias("spans"))
    names = clean.columns

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts, listed = utf8(part.column(n)).to_pylist(), part.column(n + 1).to_pylist()
                merged = [merge(x) for x in listed]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(i) for i in range(n)), pa.array(map(len, texts), pa.int64()),
                    pa.array([without_spans(t, m) for t, m in zip(texts, merged, strict=True)], pa.binary()),
                    pa.array([[{"start": a, "end": b} for a, b in m] for m in merged], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ], names=names)

    touched = only(given, spans.select(k), k).join(spans, k).select(*own, text, found)
    return touched.mapInArrow(run, clean.schema).union(clean)


def merge(listed: list[dict]) -> list[tuple[int, int]]:
    """The union of ranges as maximal runs, in order."""
    found = []
    for start, end in sorted((r["start"], r["end"]) for r in listed):
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [(a, b) for a, b in found]


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
