"""Operators 11 to 13 against brute force: awkward inputs, ties, repeated rows, small blocks and every way of joining."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import common, exact, manifest, negatives
from tallyhouse.sources import shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, rank string, leaf string, full string, row string, grp string"
X = ("x",) * 6

#: Nulls, empty, ties, repeated rows, repeated ids, ids of all sizes, very long texts, equal beginnings.
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "one", None, "a", 3), (3, "one", None, "a", 3), (3, "two", "de", "a", 3), (3, "One", "de", "b", 3),
    (None, "one", "en", "b", 3), (None, "no id", "en", "b", 5), (None, "no id", "en", "b", 5), (None, "No Id", "en", "b", 5), (-(2**63), "least", "en", "b", 5), (2**63 - 1, "most é", "en", "b", 6),
    (-7, "minus", "en", None, 5), (5, "ABC é ÀZ", "en", None, 8), (6, "word " * 30_000, "en", None, 150_000), (7, "word " * 29_999 + "Word ", "en", None, 150_000), (8, "x" * 300 + "a", "", "", 1), (9, "x" * 300 + "b", "", "", 1), (10, "x" * 300 + "b", "", "", 1),
    *((100 + k, f"Text {k % 7}", "en", f"s{k % 40:02d}", k) for k in range(400)), *((5_000_000_000 + 4096 * k, "Far", "en", "a", k) for k in range(40)),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, *X) for r in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# ---- 13 exact deduplication ----------------------------------------------------------------------


def plain_classes(rows):
    best, size = {}, Counter()
    for doc, text, *_ in rows:
        t = text or ""
        size[t] += 1
        best[t] = max((doc for doc in (best.get(t), doc) if doc is not None), default=None)
    return sorted(map(str, ((d, best[t or ""], size[t or ""], d == best[t or ""], sha(t or "")) for d, t, *_ in rows)))


@pytest.mark.parametrize("most", [32 << 20, -1])
def test_exact_classes(spark, awkward, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", most)  # small sides by broadcast, or none
    got = sorted(str(tuple(r)) for r in exact.digest(awkward).collect())
    assert got == plain_classes(ROWS)
    kept = exact.deduplicated(awkward)
    assert kept.columns == awkward.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in ROWS})


def test_exact_marks_keep_columns(awkward, nothing):
    got = exact.marked(awkward)
    assert sorted(got.columns) == sorted([*awkward.columns, "group_size", "kept"])
    assert got.where("full = 'x' AND row = 'x' AND rank = 'x'").count() == len(ROWS)
    assert exact.digest(nothing).count() == exact.deduplicated(nothing).count() == 0
    assert exact.digest(nothing).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_hashes_survivors_alone(awkward):
    known = exact.classes(awkward)
    heads = {tuple(r) for r in known.heads.select("length").distinct().collect()}
    assert (150_000,) in heads and (8,) not in heads  # two long texts share length and beginning
    assert known.found.where("group_size = 1").count() == 0


# ---- 11 manifest ---------------------------------------------------------------------------------


def plain_leaf(row):
    doc, text, lang, source, n = row
    out = ""
    for v in (doc, source, lang, n, text):
        v = None if v is None else str(v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return sha(out)


def plain_tree(digests, fanout):
    """All levels, and each leaf's proof as (place, siblings) by level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    proofs = []
    for i in range(len(digests)):
        steps = []
        for lv in levels[:-1]:
            at = i // fanout * fanout
            steps.append((i - at, [d for j, d in enumerate(lv[at : at + fanout]) if j != i - at]))
            i //= fanout
        proofs.append(steps)
    return levels[-1][0], proofs


def plain_manifest(rows, fanout=16):
    small = str.maketrans(manifest._LARGE, manifest._SMALL)
    groups = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        groups.setdefault(r[3], []).append((r[0], plain_leaf(r), plain_leaf((r[0], r[1].translate(small), *r[2:])) if changed else plain_leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
        trees[s] = plain_tree([v[1] for v in groups[s]], fanout)
    root, above = plain_tree([trees[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above, strict=True):
        for (doc, leaf, shown), own in zip(groups[s], trees[s][1], strict=True):
            proof = own + up
            folded = manifest.fold(shown, proof)
            out.append((doc, leaf, trees[s][0], root, sha("".join(d for _, x in proof for d in x)), folded, folded == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("shape", [manifest.Shape(), manifest.Shape(fanout=2, levels=3, bucket=3)])
def test_manifest_is_the_plain_tree(awkward, shape):
    made = manifest.build(awkward, presented=manifest.tampered(), shape=shape)
    got = sorted(str(tuple(r)) for r in manifest.verified(made).collect())
    assert got == plain_manifest(ROWS, shape.fanout)


def test_manifest_without_broadcast_and_again(awkward, monkeypatch):
    once = sorted(str(tuple(r)) for r in manifest.digest(awkward).collect())
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    assert sorted(str(tuple(r)) for r in manifest.digest(awkward.repartition(3)).collect()) == once


def test_manifest_proofs_fold_to_the_root(awkward):
    made = manifest.build(awkward)
    rows = manifest.proofs(made).collect()
    assert len(rows) == len(ROWS)
    assert all(manifest.fold(r.leaf, [(p["at"], p["siblings"]) for p in r.proof]) == made.root for r in rows)
    assert manifest.fold("0" * 64, [(p["at"], p["siblings"]) for p in rows[0].proof]) != made.root


def test_manifest_small_tables(spark, nothing):
    assert manifest.digest(nothing).count() == 0
    one = spark.createDataFrame([(4, "Alone", "en", "s", 5, *X)], SCHEMA)
    r = manifest.digest(one).first()
    assert r.leaf == r.subroot == r.root == plain_leaf((4, "Alone", "en", "s", 5)) and r.proof_sha256 == sha("")
    many = [(k, "t", "en", f"h{k:04d}", 1) for k in range(600)]
    got = sorted(str(tuple(r)) for r in manifest.digest(spark.createDataFrame([(*r, *X) for r in many], SCHEMA)).collect())
    assert got == plain_manifest(many)


def test_manifest_crowded_keys(spark):
    """One key, and one null key, hold most rows: buckets go on by the digits of the leaves."""
    rows = [(None if k % 3 else 77, f"T{k % 50}", "en", "s", 1) for k in range(300)] + [(k, "u", "en", "s", 1) for k in range(30)]
    made = manifest.build(spark.createDataFrame([(*r, *X) for r in rows], SCHEMA), presented=manifest.tampered(), shape=manifest.Shape(bucket=4))
    assert sorted(str(tuple(r)) for r in manifest.verified(made).collect()) == plain_manifest(rows)


# ---- 12 hard negatives ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, rank string"


def plain_negatives(rows, anchor=lambda i: i % 100 == 0, positives=5, negatives_=10):
    held = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        held.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * v)) for v in x]))
    out = []
    for i, label, x in {(i, lab, tuple(x)) for i, lab, x in held if anchor(i)}:
        score = lambda y: max(-negatives.ENDS, min(negatives.ENDS, sum(a * b for a, b in zip(x, y, strict=True))))
        near = sorted(((score(y), j, lab) for j, lab, y in held if j != i and len(y) == len(x)), key=lambda v: (-v[0], v[1]))
        for ps, p, _ in [v for v in near if v[2] == label][:positives]:
            found = [v for v in near if v[2] != label and 30 * ps <= 100 * v[0] <= 90 * ps][:negatives_]
            out += [(i, p, k + 1, j, ps, s) for k, (s, j, _) in enumerate(found)]
    return sorted(out)


def some_vectors(n=700, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(0.3, 0.2, dim).round(1).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(n)]  # coarse: many ties
    rows += [(900, None, 1), (901, [0.1] * dim, None), (902, [0.1] * (dim - 1) + [None], 1), (903, [float("nan")] * dim, 1), (904, [float("inf")] * dim, 1), (None, [0.5] * dim, 1)]
    rows += [(1000, [0.5, 0.25], 1), (1001, [0.5, 0.5], 1), (1002, [0.25, 0.125], 2), (1100, [], 1), (1101, [], 1), (1102, [], 2)]
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1], rows[6][2]), (100, [0.2] * dim, 3)]
    return rows


@pytest.mark.parametrize("size", [32 << 20, 1200])
def test_negatives_are_the_plain_ones(spark, size):
    rows = some_vectors()
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(4)
    got = negatives.mine(negatives.relabelled(frame), F.col("vec_id") % 100 == 0, anchor_bytes=size)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_negatives_of_huge_components(spark):
    """Sums beyond 2^53 stay exact, beyond 64 bits they stop at the end."""
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.integers(1, 10**6, 4) * 1000.0 + rng.integers(0, 3, 4)).tolist(), int(i % 2)) for i in range(230)] + [(500, [1e300, 1.0, 1.0, 1.0], 0), (501, [-1e300, 1.0, 1.0, 1.0], 0), (502, [1e12, 1e12, 1e12, 1.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    assert sorted(map(tuple, negatives.digest(frame).collect())) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.digest(none).count() == 0
    assert negatives.digest(spark.createDataFrame([(100, [1.0], 1, "x"), (3, [1.0], 2, "x")], VECTORS)).count() == 0


def test_negatives_in_small_blocks(monkeypatch):
    """The kernels with blocks of a few rows: states of blocks and tasks merge."""
    monkeypatch.setattr(negatives, "CANDIDATES", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = np.random.default_rng(5)
    x, label = np.floor(256 * rng.normal(0, 0.1, (300, 5)).round(1)), rng.integers(0, 3, 300)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(label), pa.array((x / 256).tolist(), pa.list_(pa.float64()))], names=["id", "label", "x"])
    group = negatives.Anchors(np.arange(20), np.arange(20), label[:20], x[:20])
    got = [(k, o, s) for b in negatives.first_pass([group], 4, [batch.slice(0, 170), batch.slice(170)]) for k, s, o in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)]
    want = []
    for i in range(20):
        score = sorted(((int(x[i] @ x[j]), j) for j in range(300) if j != i and label[j] == label[i]), key=lambda v: (-v[0], v[1]))[:4]
        want += [(i, j, s) for s, j in score]
    assert sorted(got) == sorted(want)


def test_shared_bound_is_the_one_in_use():
    assert common.small_enough is shared.small_enough
