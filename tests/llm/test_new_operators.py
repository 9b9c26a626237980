"""Filter audit, repeated strings and Merkle manifest against brute-force versions."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from siteloom.llm import audit, merkle, repeats

from .test_corpus_operators import ODD, docs_of

# --- filter audit ------------------------------------------------------------


def fails(text, doc_id, first):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    found = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text)]
    return [*found, doc_id is not None and first is not None and doc_id > first]


def brute_audit(rows, labels):
    good, toxic = ({x[0] for x in labels if x[i] == 1 and x[0] is not None} for i in (1, 2))
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    parts = {}
    for d, t, _, s in rows:
        parts.setdefault(s or "", []).append((d, dict(zip("ABCDE", fails(t or "", d, first.get(t or "")), strict=True))))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                shapley[f] += len(gone)
                alone = sum(m[f] and sum(m.values()) == 1 for _, m in docs)
                out[part, order, step] = [len(left), len(gone), sum(m[f] for _, m in docs) - len(gone), alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def read(df):
    return {(r[0], r[1], r[2]): tuple(r)[3:] for r in df.collect()}


def test_audit_equals_all_orders_applied(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Ab", "cd", "ef#", "gh"]) + str(rng.randrange(k)) for _ in range(rng.choice([3, 250]))) for k in (4, 9, 400, 900) for _ in range(8)]
    rows = [(i, rng.choice(texts), None, rng.choice(["a", "b", None])) for i in range(90)] + ODD
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9000, 1, 1), (6, None, None)]
    got = read(audit.filter_audit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs_of(spark, []), labels).count() == 0
    assert len(read(audit.filter_audit(docs_of(spark, [(1, None, None, None)]), labels))) == 600


def test_lattice_counts_paths():
    edges = audit.lattice("ABCDE")
    assert len(edges) == 80 and sum(f * b for s, _, f, b in edges if s == 0) == 120
    for bit in (1, 2, 4, 8, 16):  # each order uses each filter once
        assert sum(f * b for _, x, f, b in edges if x == bit) == 120
    used = Counter((s, b) for _, _, s, b in audit.orders("ABCDE"))
    assert all(used[s, b] == f * back for s, b, f, back in edges)


# --- repeated strings --------------------------------------------------------


def brute_cut(texts, least):
    where = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if where[t[i : i + least]] > 1:
                gone[i : i + least] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((len(t), bytes(b for b, g in zip(t, gone, strict=True) if not g), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))))
    return out


def cut(spark, texts, least):
    found = repeats.cut_repeats(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]), least).collect()
    return [(r["n_bytes"], bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in sorted(found, key=lambda r: r["doc_id"])]


def pasted(rng, n, letters, alphabet):
    """Texts with passages of others, whole copies, and copies with a few letters changed."""
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(letters))) for _ in range(n)]
    for _ in range(2 * n):
        a, b = rng.randrange(n), rng.randrange(n)
        lo = rng.randrange(len(texts[a]) + 1)
        piece = texts[a][lo : lo + rng.randrange(letters)]
        if rng.random() < 0.3 and piece:
            at = rng.randrange(len(piece))
            piece = piece[:at] + rng.choice(alphabet) + piece[at + 1 :]
        at = rng.randrange(len(texts[b]) + 1)
        texts[b] = (texts[b][:at] + piece + texts[b][at:])[: 4 * letters]
    return texts + texts[:3]


@pytest.mark.parametrize(("least", "letters", "alphabet"), [(20, 60, "ab"), (64, 300, "abcdefgh é"), (400, 900, "the quick brown fox É")])
def test_cut_equals_brute_force(spark, least, letters, alphabet):
    texts = pasted(random.Random(least), 24, letters, alphabet)
    assert cut(spark, texts, least) == brute_cut([t.encode() for t in texts], least)


def test_cut_of_runs_and_odd_texts(spark):
    rng = random.Random(8)
    once = "".join(rng.choice("abcdefghij ") for _ in range(1500))
    texts = ["x" * 900, "x" * 399, "x" * 401 + "y", "ab" * 500, once, once[:700] + "#" + once[701:], once[300:699], once[300:700], "", "é" * 200, "é" * 200]
    assert cut(spark, texts, 400) == brute_cut([t.encode() for t in texts], 400)
    out = repeats.cut_repeats(docs_of(spark, ODD), 400).collect()
    assert len(out) == len(ODD) and all(bytes(r["kept"]) == b"" and r["n_bytes"] == 0 for r in out if r["doc_id"] in (1, 2))
    assert repeats.cut_repeats(docs_of(spark, ODD).limit(0), 400).count() == 0


def test_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 50)  # texts are read in parts that overlap
    texts = [t.encode() for t in pasted(random.Random(3), 10, 200, "ab")]
    runs = [(k, a + lo) for some in repeats._parts(range(len(texts)), texts, 20) for (k, lo, _), a in [(some[t], -1) for t in range(len(some))]]
    assert runs
    seen = Counter()
    for some in repeats._parts(list(range(len(texts))), texts, 20):
        for t, a, lo, hi, *_ in zip(*repeats.runs_of([p[2] for p in some], 20), strict=True):
            seen.update((some[t][0], some[t][1] + a - o) for o in range(lo, hi + 1))
    assert seen == Counter((k, i) for k, t in enumerate(texts) for i in range(len(t) - 19))


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(4)
    order = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    got = repeats.sliding_first_min(order, 37)
    top = order >> np.uint64(20)
    assert got.tolist() == [i + int(top[i : i + 37].argmin()) for i in range(500 - 36)]


# --- Merkle manifest ---------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def proof_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        lo = at - at % 8
        out.append((nodes[lo:at], nodes[at + 1 : lo + 8]))
        at //= 8
    return out


def brute_manifest(rows):
    groups = {}
    for d, t, lang, source, n in rows:
        head = [field(x) for x in (d, source, lang, n)]
        low = t if d is None or t is None or zlib.crc32(str(d).encode()) % 3 else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        groups.setdefault(lang, []).append((d, h(*head, field(t)), h(*head, field(low))))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels_of([leaf for _, leaf, _ in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for no, g in enumerate(order):
        for at, (d, leaf, given) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            proof, node = proof_of(trees[g], at) + proof_of(top, no), given
            for before, after in proof:
                node = h(*before, node, *after)
            listed = h(*(x for level in proof for side in level for x in side))
            out.append((d, leaf, trees[g][-1][0], top[-1][0], listed, node, node == top[-1][0]))
    return sorted(map(repr, out))


def manifest(spark, rows):
    docs = [(d, t, lang, s, n, 1, 2, "x", None) for d, t, lang, s, n in rows]
    df = merkle.manifest(spark.createDataFrame(docs, docs_of(spark, []).schema))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(r)) for r in df.collect())


def test_manifest_over_several_superblocks(spark):
    rows = [(i, f"Text {i}" if i % 2 else f"text {i}", "en" if i < 4105 else "fr", "s", i) for i in range(4200)]
    assert manifest(spark, rows) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(d, t, lang, s, len(t or "") if d else None) for d, t, lang, s in ODD] + [(3, "Ünï Ä", "", None, 5), (None, None, None, None, None), (9, "A:B", "é", "s", 3), (9, "a:b", "é", "s", 3)]
    rows += [(100 + i, "Z", f"lang{i}", "s", 1) for i in range(20)]
    assert manifest(spark, rows) == brute_manifest(rows)
    assert manifest(spark, rows[:1]) == brute_manifest(rows[:1])
    assert manifest(spark, []) == []
