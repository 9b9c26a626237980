"""A Merkle manifest of a dataset: digests, proofs of membership and their check.

Leaves lie in order in their group (a language). Eight consecutive nodes are hashed to one,
until one is left, the group's root; the roots of the groups, in order, are leaves of
the dataset's own tree. A superblock is 8^4 consecutive nodes: its subtree is reduced in
one task, whatever the size of the table, and the tops of the superblocks are the nodes
of the next round. On the way back each superblock gets the siblings of its ancestors
(seven a level at most: the outer nodes that its proofs need) from the superblock above,
and is cogrouped with them in applyInPandas, which reduces the nodes once more, joins
inner and outer siblings to whole proofs, and, for leaves, folds the leaf of the data to
be checked up to a root. No task holds more than a superblock and one path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .mixing import RANGE_ROWS, in_ranges, running_total

FAN, LEVELS = 8, 4
SUPERBLOCK = FAN**LEVELS
#: A level of a proof: the digests before and after the node in its run, joined.
PROOF = "array<struct<before: string, after: string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of fields: - for null, else the bytes of the value, a colon and the value."""
    value = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in value]), 256)


def reduced(nodes: list[str], size: int) -> list[list[str]]:
    """The levels of a superblock that starts with `nodes`, lowest first, up to its top. `size`
    is the number of nodes in the whole group: a group's root is not hashed further."""
    levels = [nodes]
    while size > 1 and len(levels) <= LEVELS:
        low = levels[-1]
        levels.append([digest("".join(low[i : i + FAN])) for i in range(0, len(low), FAN)])
        size = -(-size // FAN)
    return levels


def siblings(levels: list[list[str]], at: int) -> list[dict]:
    """The proof of node `at` inside its superblock, lowest level first."""
    found = []
    for low in levels[:-1]:
        lo = at - at % FAN
        found.append({"before": "".join(low[lo:at]), "after": "".join(low[at + 1 : lo + FAN])})
        at //= FAN
    return found


def folded(node: str, proof: list[dict]) -> str:
    for level in proof:
        node = digest(level["before"] + node + level["after"])
    return node


def reduce_superblock(pdf: pd.DataFrame) -> pd.DataFrame:
    """grp, idx, size, node of the next round from the nodes of a superblock."""
    pdf = pdf.sort_values("idx")
    grp, idx, size = (int(pdf[c].iloc[0]) for c in ("grp", "idx", "size"))
    top = reduced(list(pdf["node"]), size)[-1][0]
    return pd.DataFrame({"grp": [grp], "idx": [idx // SUPERBLOCK], "size": [-(-size // SUPERBLOCK)], "node": [top]})


def exchange(found: Callable) -> Callable:
    """A function of (superblock, its outer proof) for cogroup: `found` gets the nodes in order,
    their whole proofs, and the root that the superblock's top folds to."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx").reset_index(drop=True)
        if not len(nodes):
            return found(nodes, [], "")
        levels, above = reduced(list(nodes["node"]), int(nodes["size"].iloc[0])), list(outer["proof"].iloc[0])
        proofs = [siblings(levels, i) + above for i in range(len(nodes))]
        return found(nodes, proofs, folded(levels[-1][0], above))

    return run


def _proved(nodes: pd.DataFrame, proofs: list, root: str) -> pd.DataFrame:
    return pd.DataFrame({"grp": nodes["grp"], "block": nodes["idx"], "proof": proofs})


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (grp, idx, size, node), and those of each round above, to one a group."""
    rounds = [nodes]
    while rounds[-1].where("size > 1").limit(1).count():
        low = rounds[-1].withColumn("block", F.expr(f"idx div {SUPERBLOCK}"))
        up = low.groupBy("grp", "block").applyInPandas(reduce_superblock, "grp long, idx long, size long, node string")
        rounds.append(materialize(up, "nodes"))
    return rounds


def _cogrouped(nodes: DataFrame, outer: DataFrame, found: Callable, schema: str) -> DataFrame:
    block = nodes.withColumn("block", F.expr(f"idx div {SUPERBLOCK}"))
    return block.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(exchange(found), schema)


def outer_proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """grp, block, proof: the proofs of the superblocks of the lowest round. `above` has
    them for the groups' roots (block 0)."""
    for nodes in reversed(rounds[1:]):
        above = materialize(_cogrouped(nodes, above, _proved, f"grp long, block long, proof {PROOF}"), "outer")
    return above


def ordered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with grp, the number of its lang in order (null first, then by code point, that
    is by UTF-8 byte), idx, its place in the group by `order`, and size, the group's rows."""
    langs = rows.groupBy("lang").agg(F.count("*").alias("size"))
    langs = materialize(langs.withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), "langs")
    by = [F.col("lang").isNotNull(), F.col("lang")]
    langs = running_total(in_ranges(langs, -(-langs.count() // RANGE_ROWS), by), "all", "part", by, "one", "grp")
    langs = langs.select(F.col("lang").alias("_lang"), "grp", "size")
    numbered = rows.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    placed = in_ranges(numbered.withColumn("one", F.lit(1)), -(-rows.count() // RANGE_ROWS), [F.col("grp"), *order])
    return running_total(placed, "grp", "part", order, "one", "idx").drop("part", "one")


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs` (doc_id, source, lang, n_chars, text): doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified.

    The data to be checked are `docs` with texts lower-cased (A to Z) where 3 divides the
    CRC-32 of the decimal doc_id; folded_root is their leaf folded with the original
    siblings, verified whether it equals the root.

    Nulls are fields like others (-): of lang they are a group of their own, before '';
    null doc_ids come first in their group and are never tampered with. Rows of one doc_id
    are ordered by leaf; rows that repeat are leaves of their own. Texts are hashed whole.
    An empty table gives no row. Other columns are not looked at.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    tampered = F.when(F.crc32(doc_id.cast("string")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)
    fields = [doc_id, *map(F.col, ("source", "lang", "n_chars"))]
    leaves = docs.select(
        doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_digest([*fields, text]).alias("node"),
        leaf_digest([*fields, tampered]).alias("given"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("node")]
    leaves = materialize(ordered(materialize(leaves, "leaves"), order), "leaves")
    rounds = _rounds(leaves.select("grp", "idx", "size", "node"))
    # The groups' roots are the leaves of the dataset's tree; the proof of its own root is empty.
    roots = rounds[-1].select("grp", F.col("node").alias("subroot"))
    size = F.lit(roots.count()).cast("long").alias("size")
    top = roots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), size, F.col("subroot").alias("node"))
    dataset = _rounds(top)
    whole = dataset[-1].select("grp", F.col("idx").alias("block"), F.expr(f"cast(array() as {PROOF})").alias("proof"))
    whole = outer_proofs(dataset, whole)
    above = _cogrouped(top, whole, _proved, f"grp long, block long, proof {PROOF}")
    above = materialize(above.select(F.col("block").alias("grp"), F.lit(0).cast("long").alias("block"), "proof"), "outer")
    above = outer_proofs(rounds, above)

    def checked(nodes: pd.DataFrame, proofs: list, root: str) -> pd.DataFrame:
        listed = ["".join(level["before"] + level["after"] for level in p) for p in proofs]
        ends = [folded(g, p) for g, p in zip(nodes["given"], proofs, strict=True)]
        return pd.DataFrame({
            "doc_id": nodes["doc_id"], "grp": nodes["grp"], "leaf": nodes["node"], "root": root,
            "proof_sha256": [digest(p) for p in listed], "folded_root": ends, "verified": [e == root for e in ends],
        })

    schema = "doc_id string, grp long, leaf string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = _cogrouped(leaves.select(F.col("doc_id").cast("string").alias("doc_id"), "grp", "idx", "size", "node", "given"), above, checked, schema)
    return found.join(roots, "grp").select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
