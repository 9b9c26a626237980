"""Exact Jaccard self-join of documents on word n-grams, by set relations.

Each document is the sorted set of its n-gram hashes. Two sets with Jaccard
similarity of t or more differ in at most D elements, where D follows from their
sizes. Cut at fixed places of the hash range into B > D position blocks, two such
sets agree on at least B - D whole blocks. The index lists are therefore keyed by
(size level, block position, content of the block): a whole block is compared, or
skipped, in one step, and a list holds only sets that agree on several elements, so
passages shared by many documents do not make long lists.

In a list, all sets are tied to the list's smallest document, the centre. The sets
of one centre are then compared as a group: overlaps are counted from the group's
element lists for the centre, and for a set that was reached from a similar one they
are *derived* from that one's counts by the elements in which the two differ. Sets
that are linked already are skipped. The links found connect exactly the documents
that all links connect.

Large groups are cut into blocks of `block` sets, fewer if they are long, each with the
centre; sets that a block could not connect to the centre are then compared with the other blocks, the
ones of one block with one other block at a time.
"""

from __future__ import annotations

import bisect
import math
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, batches, bit_table, components, materialize, ngram_hashes, passes, utf8

#: A level of sizes reaches to this multiple of its smallest size.
LEVEL = 1.3
#: Groups of so few sets are compared directly.
FEW = 6
#: A block of a large group has about so many elements at most (8 bytes each), however long its texts are.
BLOCK_ELEMENTS = 4_000_000
#: Share of sets that may have more thin blocks than a level puts up with.
THIN_TAIL = 2e-3


def shingle_sets_of(texts: list[bytes | None] | pa.Array, n: int, words: WordHashes):
    """Sorted distinct n-gram hashes of each text; words are runs of non-whitespace, A-Z
    lower-cased. Fewer than n words make one n-gram; no words, none."""
    for lo in range(0, len(texts), 256):
        part = texts[lo : lo + 256]
        tokens = [(t or b"").lower().split() for t in (part.to_pylist() if isinstance(part, pa.Array) else part)]
        h = words.of(list(chain.from_iterable(tokens)))
        grams, at = ngram_hashes(h, n), 0
        for k in map(len, tokens):
            own = np.sort(grams[at : at + k - n + 1]) if k >= n else ngram_hashes(h[at : at + k], k) if k else h[:0]
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own
            at += k


def shingle_set(text: bytes | None, n: int, words: WordHashes) -> np.ndarray:
    return next(shingle_sets_of([text], n, words))


class Levels:
    """Size levels and their blocks, for a similarity of num/den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.known, self.cuts = num, den, {}, {}
        first = next(y for y in range(1, 4 * den + 4) if self.differ(y) > 0)
        self.starts = [first]

    def differ(self, largest: int) -> int:
        """Most elements in which two linked sets of at most that size differ."""
        return (self.den - self.num) * 2 * largest // (self.den + self.num)

    def start(self, k: int) -> int:
        while len(self.starts) <= k:
            self.starts.append(max(self.starts[-1] + 1, math.ceil(self.starts[-1] * LEVEL)))
        return self.starts[k]

    def level(self, size: int) -> int:
        """The level that a size lies in; -1: only equal sets can be linked."""
        if size < self.starts[0]:
            return -1
        while self.starts[-1] <= size:
            self.start(len(self.starts))
        return bisect.bisect_right(self.starts, size) - 1

    def of(self, size: int) -> range:
        """Levels in which a set meets those of its own size or larger."""
        return range(max(0, self.level(size)), self.level(size * self.den // self.num) + 1)

    def blocks(self, k: int) -> tuple[int, int, int]:
        """(B, spare, thin) of a level. A block of at most `thin` elements is thin; a set
        with at most `spare` thin blocks leaves them out, for at least 1 + spare of the
        B = D + 1 + spare blocks of linked sets agree, and thin ones agree only with thin ones.
        Planned for the smallest sets that meet others in the level, which lie below it: sets with
        more thin blocks list their empty ones, which all of these have."""
        if k not in self.known:
            self.known[k] = planned(self.differ(self.start(k + 1) - 1), -(-self.start(k) * self.num // self.den))
        return self.known[k]

    def signatures(self, s: np.ndarray) -> list[np.ndarray]:
        """Keys of the index lists of a sorted set."""
        out = []
        with np.errstate(over="ignore"):
            mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            for k in self.of(len(s)):
                b, spare, thin = self.blocks(k)
                if k not in self.cuts:
                    self.cuts[k] = np.array([(i << 64) // b for i in range(1, b)], np.uint64)
                cut = np.searchsorted(s, self.cuts[k])
                edge = np.concatenate(([0], cut, [len(s)]))
                count = np.diff(edge)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
                key = total[edge[1:]] - total[edge[:-1]] + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
                key = (key ^ (np.arange(b, dtype=np.uint64) + np.uint64(k << 32))) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(28)
                light = count <= thin
                out.append(key[~light] if light.sum() <= spare else key)
        return out


@cache
def planned(d: int, size: int) -> tuple[int, int, int]:
    """(B, spare, thin) for sets of `size` elements or more that differ in `d`: few sets have more
    than `spare` thin blocks; of small ones, as few as can be."""
    for thin in (1, 0):
        for z in range(1, d // 2 + 4):
            if _poisson_tail(thin, d + 1 + z, size, z) < THIN_TAIL:
                return d + 1 + z, z, thin
    z = min(range(d // 2 + 4), key=lambda z: _poisson_tail(0, d + 1 + z, size, z))
    return d + 1 + z, z, 0


def _poisson_tail(thin: int, b: int, size: int, z: int) -> float:
    m = size / b
    rate = b * math.exp(-m) * (1 + m * (thin == 1))
    if rate > 600:  # beyond that, exp(-rate) is 0
        return math.erfc((z + 0.5 - rate) / math.sqrt(2 * rate)) / 2
    term = total = math.exp(-rate)
    for i in range(1, z + 1):
        term *= rate / i
        total += term
    return 1 - total


def similar(overlap, a, b, num: int, den: int):
    """den * |intersection| >= num * |union|, in whole numbers."""
    return den * overlap >= num * (a + b - overlap)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the counts of elements by their low bits, 2 to 4 bits an element."""
    width = max(256, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1 == 1).tobytes()


def folded(x: bytes, size: int) -> np.ndarray:
    """The sketch at a smaller width of `size` bytes: element parities add up."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), 0).view(np.uint64)


def apart(group: list[dict], num: int, den: int) -> list[tuple[int, int]]:
    """(centre, doc_id) of the parts that a group falls into. Two sets differ in at least
    as many elements as their sketches differ in bits, so sets whose sketches differ in
    more than linked sets may are not linked: no link is lost between the parts."""
    size = min(len(r["sketch"]) for r in group)
    bits = np.stack([folded(r["sketch"], size) for r in group])
    n, ids = np.array([r["n_shingles"] for r in group]), [r["doc_id"] for r in group]
    left, out = np.arange(len(group)), []
    while len(left):
        queue, left, part = [left[0]], left[1:], []
        while queue:
            i = queue.pop()
            part.append(ids[i])
            if len(left):
                near = np.bitwise_count(bits[left] ^ bits[i]).sum(1, dtype=np.int64) <= (n[left] + n[i]) * (den - num) // (den + num)
                queue += list(left[near])
                left = left[~near]
        low = min(part)
        out += [(low, d) for d in part if d != low]
    return out


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch) of each row; the last two are null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary())])

    def run(it):
        words = WordHashes()
        for batch in it:
            sets = list(shingle_sets_of(utf8(batch.column(1)), n, words))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
            ], schema=schema)

    return _id_text(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def index_lists(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(list_key, doc_id) of each distinct set of a task."""
    schema = pa.schema([("list_key", pa.int64()), ("doc_id", pa.int64())])

    def run(it):
        words, levels, seen = WordHashes(), Levels(num, den), set()
        for batch in it:
            keys, ids, held = [], [], 0
            for d, s in zip(batch.column(0).to_pylist(), shingle_sets_of(utf8(batch.column(1)), n, words), strict=True):
                if d is None or not len(s) or (k := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(k)
                for key in levels.signatures(s):
                    keys.append(key)
                    ids.append(np.full(len(key), d, np.int64))
                    held += len(key)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, ids)], schema=schema)
                    keys, ids, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, ids)], schema=schema)

    return _id_text(docs).mapInArrow(run, "list_key long, doc_id long")


def _id_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def centre_pairs(lists: DataFrame) -> DataFrame:
    """Distinct (centre, doc_id): each list's members with its smallest one, which is the
    first of the sorted list, so a list of any length streams through."""
    centre = F.first("doc_id").over(Window.partitionBy("list_key").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return lists.withColumn("centre", centre).where("doc_id <> centre").select("centre", "doc_id").distinct()


class Group:
    """Sets of one centre, with the element lists that the overlaps are counted from."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.size = np.array([len(s) for s in sets], np.int64)
        if len(sets) <= FEW:
            return
        flat = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.owner, flat = self.owner[order], flat[order]
        self.elements, self.start = np.unique(flat, return_index=True)
        self.end = np.append(self.start[1:], len(flat))

    def _count(self, elements: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.elements, elements)
        lists = [self.owner[self.start[i] : self.end[i]] for i in at]
        return np.bincount(np.concatenate(lists), minlength=len(self.sets)) if lists else np.zeros(len(self.sets), np.int64)

    def overlaps(self, i: int, parent: tuple[int, np.ndarray] | None) -> np.ndarray:
        """Overlap of set i with every set: from the parent's, if that is shorter."""
        if len(self.sets) <= FEW:
            return np.array([len(np.intersect1d(self.sets[i], s, assume_unique=True)) for s in self.sets], np.int64)
        if parent is not None:
            p, known = parent
            lost = np.setdiff1d(self.sets[p], self.sets[i], assume_unique=True)
            won = np.setdiff1d(self.sets[i], self.sets[p], assume_unique=True)
            if len(lost) + len(won) < self.size[i]:
                return known - self._count(lost) + self._count(won)
        return self._count(self.sets[i])

    def linked(self, i: int, counts: np.ndarray) -> np.ndarray:
        return similar(counts, self.size, self.size[i], self.num, self.den)

    def forest(self) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Edges of a spanning forest of the links, and each set's tree."""
        n = len(self.sets)
        tree, edges = np.full(n, -1), []
        for root in range(n):
            if tree[root] >= 0:
                continue
            tree[root] = root
            queue: list[tuple[int, tuple[int, np.ndarray] | None]] = [(root, None)]
            while queue and (tree < 0).any():
                i, parent = queue.pop()
                counts = self.overlaps(i, parent)
                new = np.flatnonzero(self.linked(i, counts) & (tree < 0))
                tree[new] = root
                edges += [(i, int(j)) for j in new]
                queue += [(int(j), (i, counts)) for j in new]
        return edges, tree


def _members(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """`wanted` (doc_id, ...) with the set of each document as bytes. Only the sets of
    documents that a bit table lets pass are made and shuffled; the join then decides."""
    table = bit_table(wanted.select(F.xxhash64("doc_id").alias("h")).distinct(), "h")
    cell = docs.sparkSession.sparkContext.broadcast(table)  # 16 MB at most
    schema = pa.schema([("doc_id", pa.int64()), ("elements", pa.binary())])

    def run(it):
        words, bits = WordHashes(), cell.value
        for batch in it:
            batch = batch.filter(pa.array(passes(bits, batch.column(2).to_numpy().view(np.uint64))))
            ids, sets, held = [], [], 0
            for d, s in zip(batch.column(0).to_pylist(), shingle_sets_of(utf8(batch.column(1)), n, words), strict=True):
                ids.append(d)
                sets.append(s.tobytes())
                held += len(s)
                if held > 500_000:
                    yield batches({"doc_id": ids, "elements": sets}, schema)
                    ids, sets, held = [], [], 0
            yield batches({"doc_id": ids, "elements": sets}, schema)

    given = _id_text(docs).where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    return given.mapInArrow(run, "doc_id long, elements binary").join(wanted, "doc_id")


def rows_of(batch: pa.RecordBatch):
    """The rows of a batch, some at a time: sets are held once as bytes, not twice."""
    for lo in range(0, batch.num_rows, 128):
        yield from batch.slice(lo, 128).to_pylist()


def _by_group(rows: DataFrame, compare, schema: str) -> DataFrame:
    """compare(list of row dicts) of the rows of each (centre, part); tasks stream
    through their sorted rows and hold one group at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    out_schema = pa.schema([(x.split()[0], pa.int64()) for x in schema.split(", ")])

    def run(it):
        group, key, out = [], None, []
        for batch in it:
            for row in rows_of(batch):
                if (row["centre"], row["part"]) != key:
                    if group:
                        out += compare(group)
                    group, key = [], (row["centre"], row["part"])
                group.append(row)
            if len(out) > 5000:
                yield batches(dict(zip(names, zip(*out, strict=True), strict=True)), out_schema)
                out = []
        if group:
            out += compare(group)
        if out:
            yield batches(dict(zip(names, zip(*out, strict=True), strict=True)), out_schema)

    return rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "doc_id").mapInArrow(run, schema)


def links(docs: DataFrame, sets: DataFrame, n: int = 5, num: int = 8, den: int = 10, block: int = 4000) -> DataFrame:
    """Edges (a, b) between documents of different sets whose components are those of
    all pairs with similarity num/den or more."""
    pairs = materialize(centre_pairs(index_lists(docs, n, num, den)), "pairs")
    # Groups that only share a passage fall apart by sketches before any set is moved.
    # Larger ones than a block are left to the comparison of blocks.
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("members"))
    small = pairs.join(sizes.where(F.col("members") <= block), "centre").select("centre", "doc_id")
    rows = small.union(small.select("centre", F.col("centre").alias("doc_id")).distinct()).withColumn("part", F.lit(0).cast("long"))
    rows = rows.join(sets.where("sketch is not null").select("doc_id", "n_shingles", "sketch"), "doc_id")
    near = _by_group(rows, lambda group: apart(group, num, den), "centre long, doc_id long").distinct()
    pairs = materialize(near.union(pairs.join(sizes.where(F.col("members") > block), "centre").select("centre", "doc_id")), "pairs")
    known = sets.where("n_shingles > 0").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    sizes = pairs.join(known, "doc_id").groupBy("centre").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("elements"))
    cuts = materialize(sizes.select("centre", F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).alias("blocks")), "cuts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part")
    placed = pairs.join(cuts, "centre").select("doc_id", "centre", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("part"))
    placed = materialize(placed.union(cuts.select(F.col("centre").alias("doc_id"), "centre", "blocks", every)), "placed")

    def inside(group: list[dict]) -> list[tuple]:
        ids, centre = [r["doc_id"] for r in group], group[0]["centre"]
        edges, tree = Group([np.frombuffer(r["elements"], np.uint64) for r in group], num, den).forest()
        out = [(ids[i], ids[j], 0, centre, 0) for i, j in edges]
        if group[0]["blocks"] > 1:
            home = tree[ids.index(centre)]
            out += [(ids[i], ids[i], group[0]["blocks"], centre, group[0]["part"]) for i in range(len(ids)) if tree[i] != home]
        return out

    found = materialize(_by_group(_members(docs, n, placed), inside, "a long, b long, blocks long, centre long, part long"), "links")
    edges = found.where("blocks = 0").select("a", "b")
    if cuts.where("blocks > 1").isEmpty():
        return edges
    # Sets that their block left unconnected, against the other blocks of the centre: a task
    # holds one block and the unconnected sets of one other block. Part: block * blocks + that other block.
    lost = found.where("blocks > 0").select(F.col("a").alias("doc_id"), "centre", "blocks", every, F.col("part").alias("home")).where("part <> home")
    met = lost.select("centre", "part", "home").distinct()
    own = placed.where("blocks > 1 and doc_id <> centre").join(met, ["centre", "part"]).select(
        "doc_id", "centre", "blocks", (F.col("part") * F.col("blocks") + F.col("home")).alias("part"), F.lit(-1).cast("long").alias("home"),
    )
    rest = own.union(lost.select("doc_id", "centre", "blocks", (F.col("part") * F.col("blocks") + F.col("home")).alias("part"), "home"))

    def across(group: list[dict]) -> list[tuple]:
        own = np.array([r["home"] == -1 for r in group])
        if own.all() or not own.any():
            return []
        compared = Group([np.frombuffer(r["elements"], np.uint64) for r in group], num, den)
        return [(group[i]["doc_id"], group[j]["doc_id"]) for i in np.flatnonzero(~own) for j in np.flatnonzero(compared.linked(i, compared.overlaps(i, None)) & own)]

    return edges.union(materialize(_by_group(_members(docs, n, rest), across, "a long, b long"), "links"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, block: int = 4000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs`.

    Documents are linked when den * |intersection| >= num * |union| of their n-gram
    sets; component_id is the smallest doc_id reachable, itself included.

    Null or blank text: n_shingles 0, linked with nothing. Rows with the same doc_id
    are one document with several texts, each row returned. Null doc_id: component_id
    is null and the row is linked with nothing. Texts of any length count whole. Other columns
    are ignored; an empty table gives an empty result.
    """
    sets = materialize(shingle_sets(docs, n), "sets")
    first = sets.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("a"), F.count("*").alias("rows")).where("rows > 1")
    copies = sets.join(first.select("set_key", "a"), "set_key").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    found = components(links(docs, sets, n, num, den, block).union(copies))
    return sets.join(found, sets.doc_id == found.node, "left").select(sets.doc_id, "n_shingles", F.coalesce("component", sets.doc_id).alias("component_id"))
