"""Merkle manifest of a dataset, its proofs and their verification (operator 11).

A row is a leaf: the SHA-256 of its columns. Leaves of a group (a source) stand in the order of their keys, and every FANOUT of them
become a node, level by level, to the group's root; the groups' roots, in the order of the groups, likewise become the dataset's root.

Ranks without a global sort: keys are counted by their leading digits (the key without its low twelve bits), those counts are rolled up
to ever shorter beginnings of twelve bits less, and a window over at most 4,096 siblings gives each beginning what stands before it among
them; summed from the top, each finest bucket knows its first rank. Rows then are numbered inside their bucket alone. A bucket of more
than BUCKET rows (keys that repeat, or a null key for many rows) is counted further, by the key's last digits and then by those of the
leaf, until all are small; there, rows that agree in all that is hashed are counted first and given their ranks as a run.

A rank, in digits of the fanout, is a leaf's path in a trie. The longest prefixes are reduced first: a task gets, as one row, the leaves
that share all but their last LEVELS digits (a block: 4,096 leaves, whatever the group's size) and gives their common ancestor;
ancestors are blocked again until one is left. Proofs go the other way: a block's row meets the path of its own ancestor, once for all
its leaves, and each leaf's siblings are laid out in the task and hashed or returned, never shuffled. A group may hold all rows: a
block is what a task holds. Of groups there is a row each; they are ranked by ranges of their names, of which only the sizes meet.

All intermediate tables (leaves, counts, blocks, paths) are files in the shared folder, so a lost executor costs its tasks.

Defined results: null and empty values differ (`-` against `0:`); a null group is a group, before all others; null keys come before all
keys; rows that agree in key stand in the order of their leaves, and rows that agree in all columns have a place each; an empty table
gives an empty result. Columns that are not hashed may have any name. A verification may present other values of the hashed columns
than the manifest was built from; null values stay null where the given expression keeps them so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from .common import saved, sized

FANOUT = 16
#: Levels that a task reduces at once: a block has FANOUT ** LEVELS leaves.
LEVELS = 3
#: Rows of a bucket that are numbered in one window.
BUCKET = 1 << 14
#: The columns that a leaf hashes, in order.
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
#: Hexadecimal digits by which counts are rolled up.
DIGITS = 3
_KEY = 17  # one digit that tells null keys from others, sixteen of the key


def leaf(columns: dict[str, Column]) -> Column:
    """The digest (binary) of a row: each value as `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256))


def _path(key: Column) -> Column:
    """A key as hexadecimal digits in its order, nulls first."""
    number = F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.coalesce(F.concat(F.lit("1"), number), F.lit("0" * _KEY))


def _ranked(leaves: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """leaves (grp, key, leaf and others) with rank, from 0 within the group; and grp, n (rows of the group)."""
    last = _KEY + 64
    own = leaves.columns
    rows, length = leaves.withColumns({"place": F.concat(_path(F.col("key")), F.hex("leaf")), "copies": F.lit(1).cast("long")}), _KEY - DIGITS
    closed: dict[int, tuple[DataFrame, DataFrame]] = {}
    while True:
        here = rows.withColumn("at", F.substring("place", 1, length))
        counts = saved(here.groupBy("grp", "at").agg(F.sum("copies").alias("n"), F.count("*").alias("different")), "manifest-counts")
        large = (F.col("different") > bucket) & F.lit(length < last)
        closed[length] = here, counts.where(~large)
        if counts.where(large).isEmpty():
            break
        crowded = saved(counts.where(large).select("grp", "at"), "manifest-crowded")
        rows = here.join(sized(crowded), ["grp", "at"], "left_semi").drop("at")
        if len(closed) == 1:  # rows that agree in all are counted once and for all
            rows = saved(rows.groupBy(*own, "place").agg(F.count("*").alias("copies")), "manifest-different")
        length = min(length + DIGITS, last)
    # counts of all beginnings, rolled up from the longest to the shortest at which keys differ
    ends = [c.agg(F.min("at").alias("a"), F.max("at").alias("b")).first() for _, c in closed.values()]
    texts = [v for r in ends for v in r if v is not None]
    alike = [n for n in range(_KEY - 2 * DIGITS, 0, -DIGITS) if len({v[:n] for v in (min(texts, default=""), max(texts, default=""))}) > 1]
    lengths = sorted({*alike, *closed})
    level: dict[int, DataFrame] = {}
    for n, longer in zip(reversed(lengths), [None, *reversed(lengths)], strict=False):
        parts = [closed[n][1].select("grp", "at", "n", F.lit(True).alias("closed"))] if n in closed else []
        if longer:
            parts.append(level[longer].groupBy("grp", F.substring("at", 1, n).alias("at")).agg(F.sum("n").alias("n")).withColumn("closed", F.lit(False)))
        level[n] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    total = level[lengths[0]].groupBy("grp").agg(F.sum("n").alias("n"))
    # what stands before a beginning: its siblings before it (4,096 at most), and what stands before their parent
    above, shorter, ranked = None, 0, None
    for n in lengths:
        siblings = Window.partitionBy("grp", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        first = level[n].withColumn("parent", F.substring("at", 1, shorter)).withColumn("before", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
        if above is not None:
            first = first.join(above.select("grp", F.col("at").alias("parent"), F.col("before").alias("above")), ["grp", "parent"]).withColumn("before", F.col("before") + F.col("above"))
        above, shorter = first, n
        if n not in closed:
            continue
        bucketed = closed[n][0].join(sized(saved(first.where("closed").select("grp", "at", "before"), "manifest-starts")), ["grp", "at"])
        if n == _KEY - DIGITS:
            turn = F.row_number().over(Window.partitionBy("grp", "at").orderBy("place")) - 1
            part = bucketed.withColumn("rank", F.col("before") + turn)
        else:
            earlier = F.sum("copies").over(Window.partitionBy("grp", "at").orderBy("place", "presented").rowsBetween(Window.unboundedPreceding, -1))
            placed = bucketed.withColumn("start", F.col("before") + F.coalesce(earlier, F.lit(0)))
            part = placed.withColumn("rank", F.explode(F.expr("sequence(start, start + copies - 1)")))
        part = part.select(*own, F.col("rank").cast("long").alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked, total


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels above n leaves."""
    d = 0
    while fanout**d < n:
        d += 1
    return d


def reduced(digests: list[bytes], levels: int, fanout: int) -> list[list[bytes]]:
    """A block's digests and those of the levels above, in hexadecimal text."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256(b"".join(below[k : k + fanout])).hexdigest().encode() for k in range(0, len(below), fanout)])
    return out


@dataclass
class Shape:
    """Fanout, levels of a block and rows of a bucket."""

    fanout: int = FANOUT
    levels: int = LEVELS
    bucket: int = BUCKET

    @property
    def block(self) -> int:
        return self.fanout**self.levels

    def inside(self, base: int, n: int) -> int:
        """Levels that a block of nodes of level `base` has above it in a group of n leaves."""
        return max(0, min(self.levels, depth(n, self.fanout) - base))


def _hex(column: pa.Array) -> list[bytes]:
    return [v.hex().encode() for v in column.to_pylist()]


def _unpacked(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.StructArray]]:
    """Each row's number and its array of structs."""
    column = batch.column(name)
    ends = column.offsets.to_pylist()
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        yield k, column.values.slice(a, b - a)


def _climb(nodes: DataFrame, most: int, shape: Shape) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round (grp, block, n, items), the leaves' first, and the groups' roots (grp, n, digest), from nodes (grp, at, n, digest
    and what else an item keeps)."""

    def tops(base: int) -> Callable:
        def run(batches):
            for batch in batches:
                n = batch.column("n").to_pylist()
                made = []
                for k, items in _unpacked(batch, "items"):
                    made.append(bytes.fromhex(reduced(_hex(items.field("digest")), shape.inside(base, n[k]), shape.fanout)[-1][0].decode()))
                yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), batch.column("n"), pa.array(made, pa.binary())], names=["grp", "at", "n", "digest"])

        return run

    rounds, base = [], 0
    while True:
        item = F.struct("at", *(c for c in nodes.columns if c not in ("grp", "at", "n")))
        packed = nodes.groupBy("grp", F.floor(F.col("at") / shape.block).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))  # a block's rows at most
        rounds.append(saved(packed, "manifest-blocks"))
        nodes = rounds[-1].mapInArrow(tops(base), "grp string, at long, n long, digest binary")
        base += shape.levels
        if depth(most, shape.fanout) <= base:
            return rounds, nodes


def _levels(digests: list[bytes], inside: int, fanout: int) -> list[list[bytes]]:
    """For each level of a block, its runs of siblings, each joined."""
    return [[b"".join(lv[k : k + fanout]) for k in range(0, len(lv), fanout)] for lv in reduced(digests, inside, fanout)[:inside]]


def _descend(rounds: list[DataFrame], paths: DataFrame, shape: Shape) -> DataFrame:
    """Paths (grp, at, ats, runs and what else paths has) of the first round's blocks, from those of the groups' roots (at = 0)."""
    rest = [c for c in paths.columns if c not in ("grp", "at", "ats", "runs")]

    def down(base: int) -> Callable:
        def run(batches):
            for batch in batches:
                n, ats, runs = (batch.column(c).to_pylist() for c in ("n", "ats", "runs"))
                for k, items in _unpacked(batch, "items"):
                    lv = _levels(_hex(items.field("digest")), shape.inside(base, n[k]), shape.fanout)
                    own = [([i // shape.fanout**d % shape.fanout for d in range(len(lv))], [lv[d][i // shape.fanout ** (d + 1)] for d in range(len(lv))]) for i in range(len(items))]
                    held = batch.slice(k, 1)
                    same = [pa.concat_arrays([held.column(c)] * len(items)) for c in rest]
                    made = [pa.concat_arrays([held.column("grp")] * len(items)), items.field("at"), pa.array([a + ats[k] for a, _ in own], pa.list_(pa.int32())), pa.array([r + runs[k] for _, r in own], pa.list_(pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*made, *same], names=["grp", "at", "ats", "runs", *rest])

        return run

    kinds = ", ".join(f"{c} {paths.schema[c].dataType.simpleString()}" for c in rest)
    for k in range(len(rounds) - 1, 0, -1):
        met = rounds[k].withColumnRenamed("block", "at").join(sized(paths), ["grp", "at"]).select("grp", "n", "items", "ats", "runs", *rest)
        paths = saved(met.mapInArrow(down(k * shape.levels), "grp string, at long, ats array<int>, runs array<binary>" + (", " + kinds if kinds else "")), "manifest-paths")
    return paths


@dataclass
class Manifest:
    """Blocks of leaves, the path of each block's ancestor to the root, the groups' roots and the root (None of an empty table)."""

    blocks: DataFrame
    paths: DataFrame
    subroots: DataFrame
    root: str | None
    shape: Shape


def build(docs: DataFrame, key_col: str = "doc_id", group_col: str = "source", hashed: tuple[str, ...] = HASHED, presented: dict[str, Column] | None = None, shape: Shape | None = None) -> Manifest:
    """The manifest of docs. presented gives other values of hashed columns, as a later reader would hold them, for proofs to be tested
    against: the digest of such a row is kept beside that of the leaf."""
    shape = shape or Shape()
    columns = {c: F.col(c) for c in hashed}
    seen = leaf(columns)
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # a null group comes before all
    other = leaf(columns | presented) if presented else F.lit(None).cast("binary")
    leaves = saved(docs.select(group.alias("grp"), F.col(key_col).cast("long").alias("key"), seen.alias("leaf"), other.alias("presented")), "manifest-leaves")
    ranked, total = _ranked(leaves, shape.bucket)
    total = saved(total, "manifest-sizes")
    most = total.agg(F.max("n").alias("n")).first().n or 0
    nodes = ranked.join(sized(total), "grp").select("grp", F.col("rank").alias("at"), "n", F.col("leaf").alias("digest"), "key", "presented")
    rounds, tops = _climb(nodes, most, shape)
    subroots = saved(tops.select("grp", "digest"), "manifest-subroots")
    groups = subroots.count()
    turn = numbered(subroots, "grp", [F.col("grp")], ["digest"]).select(F.lit("").alias("grp"), (F.col("number") - 1).alias("at"), F.lit(groups).cast("long").alias("n"), "digest", F.col("grp").alias("name"))
    above, top = _climb(turn, groups, shape)
    found = top.first() if groups else None
    none = F.array().cast("array<int>"), F.array().cast("array<binary>")
    first = saved(above[-1].select("grp", F.col("block").alias("at"), none[0].alias("ats"), none[1].alias("runs")), "manifest-top")
    of_blocks = _descend(above, first, shape)
    # the groups' own paths: one more step down, from the blocks of groups to the groups
    met = above[0].withColumnRenamed("block", "at").join(sized(of_blocks), ["grp", "at"]).select("n", "items", "ats", "runs")
    of_groups = saved(met.mapInArrow(_to_groups(shape), "grp string, at long, ats array<int>, runs array<binary>, subroot string"), "manifest-group-paths")
    return Manifest(rounds[0], _descend(rounds, of_groups, shape), subroots, bytes(found.digest).hex() if found else None, shape)


def _to_groups(shape: Shape) -> Callable:
    def run(batches):
        for batch in batches:
            n, ats, runs = (batch.column(c).to_pylist() for c in ("n", "ats", "runs"))
            for k, items in _unpacked(batch, "items"):
                digests = _hex(items.field("digest"))
                lv = _levels(digests, shape.inside(0, n[k]), shape.fanout)
                own = [([i // shape.fanout**d % shape.fanout for d in range(len(lv))], [lv[d][i // shape.fanout ** (d + 1)] for d in range(len(lv))]) for i in range(len(items))]
                yield pa.RecordBatch.from_arrays(
                    [items.field("name"), pa.array([0] * len(items), pa.int64()), pa.array([a + ats[k] for a, _ in own], pa.list_(pa.int32())), pa.array([r + runs[k] for _, r in own], pa.list_(pa.binary())), pa.array([d.decode() for d in digests])],
                    names=["grp", "at", "ats", "runs", "subroot"],
                )

    return run


def fold(digest: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf's digest and its proof give: for each level the place among its siblings and the siblings."""
    for at, siblings in proof:
        digest = hashlib.sha256("".join([*siblings[:at], digest, *siblings[at:]]).encode()).hexdigest()
    return digest


def _met(m: Manifest) -> DataFrame:
    return m.blocks.withColumnRenamed("block", "at").join(sized(m.paths), ["grp", "at"]).select("n", "items", "ats", "runs", "subroot")


def proofs(m: Manifest, key_col: str = "doc_id") -> DataFrame:
    """key, leaf and proof (place and siblings of each level, from the leaf to the root) of every leaf."""
    shape = m.shape

    def run(batches):
        for batch in batches:
            n, ats, runs = (batch.column(c).to_pylist() for c in ("n", "ats", "runs"))
            for k, items in _unpacked(batch, "items"):
                digests = _hex(items.field("digest"))
                lv = _levels(digests, shape.inside(0, n[k]), shape.fanout)
                made = []
                for i in range(len(digests)):
                    steps = [(i // shape.fanout**d % shape.fanout, lv[d][i // shape.fanout ** (d + 1)]) for d in range(len(lv))] + list(zip(ats[k], runs[k], strict=True))
                    made.append([{"at": a, "siblings": [r[j : j + 64].decode() for j in range(0, len(r), 64) if j != 64 * a]} for a, r in steps])
                yield pa.RecordBatch.from_arrays([items.field("key"), pa.array([d.decode() for d in digests]), pa.array(made, pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))])))], names=[key_col, "leaf", "proof"])

    return _met(m).mapInArrow(run, f"{key_col} long, leaf string, proof array<struct<at: int, siblings: array<string>>>")


def verified(m: Manifest, key_col: str = "doc_id") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256 (of the siblings, joined), folded_root (what the presented leaf and the siblings give) and
    verified (whether that is the root)."""
    shape, root = m.shape, m.root
    names = [key_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches):
        for batch in batches:
            n, ats, runs, sub = (batch.column(c).to_pylist() for c in ("n", "ats", "runs", "subroot"))
            for k, items in _unpacked(batch, "items"):
                digests = _hex(items.field("digest"))
                shown = [d if v is None else v.hex().encode() for d, v in zip(digests, items.field("presented").to_pylist(), strict=True)]
                lv = _levels(digests, shape.inside(0, n[k]), shape.fanout)
                upper = [(r[: 64 * a], r[64 * a + 64 :]) for a, r in zip(ats[k], runs[k], strict=True)]
                rest = b"".join(a + b for a, b in upper)
                ends: dict[bytes, bytes] = {}  # of a block's ancestor to the root: most leaves give the same one
                proof, folded = [], []
                for i, now in enumerate(shown):
                    told, j = hashlib.sha256(), i
                    for level in lv:
                        j, at = divmod(j, shape.fanout)
                        left, right = level[j][: 64 * at], level[j][64 * at + 64 :]
                        told.update(left + right)
                        now = hashlib.sha256(left + now + right).hexdigest().encode()
                    told.update(rest)
                    if now not in ends:
                        up = now
                        for left, right in upper:
                            up = hashlib.sha256(left + up + right).hexdigest().encode()
                        ends[now] = up
                    proof.append(told.hexdigest())
                    folded.append(ends[now].decode())
                size = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [items.field("key"), pa.array([d.decode() for d in digests]), pa.array([sub[k]] * size), pa.array([root] * size, pa.string()), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])],
                    names=names,
                )

    return _met(m).mapInArrow(run, f"{key_col} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


_LARGE, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered(key_col: str = "doc_id", text_col: str = "text", every: int = 5) -> dict[str, Column]:
    """Lower-cased texts where the key's checksum says so."""
    picked = F.crc32(F.col(key_col).cast("string").cast("binary")) % every == 0
    return {text_col: F.when(picked, F.translate(text_col, _LARGE, _SMALL)).otherwise(F.col(text_col))}


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return verified(build(docs, presented=tampered()))


def _sql(deep: int = 5, wide: int = 3) -> str:
    """DuckDB's version, for groups of at most FANOUT ** deep rows and FANOUT ** wide groups."""

    def hashed(text: str) -> str:
        values = (f"{c}::VARCHAR" if c != "text" else text for c in HASHED)
        return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"

    def trie(name: str, k: int) -> str:
        """Nodes of the next level, and what stands left and right of each node among its siblings."""
        among = f"PARTITION BY grp, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
        more = f"n > {FANOUT**k}"
        return f"""
{name}{k + 1} AS (SELECT grp, pos // {FANOUT} AS pos, n, CASE WHEN {more} THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest FROM {name}{k} GROUP BY grp, pos // {FANOUT}, n),
{name}_beside{k} AS (SELECT grp, pos, {more} AS more, CASE WHEN {more} THEN coalesce(string_agg(digest, '') OVER ({among} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN {more} THEN coalesce(string_agg(digest, '') OVER ({among} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k}),"""

    steps = [("leaf", k, f"d.pos // {FANOUT**k}", "d.grp") for k in range(deep)] + [("top", k, f"s.pos // {FANOUT**k}", "''") for k in range(wide)]
    joins = "\n".join(f"JOIN {name}_beside{k} b{i} ON b{i}.grp = {grp} AND b{i}.pos = {pos}" for i, (name, k, pos, grp) in enumerate(steps))
    proof = " || ".join(f"b{i}.l || b{i}.r" for i in range(len(steps)))
    folds = "".join(f",\nf{i + 1} AS (SELECT * REPLACE (CASE WHEN m{i} THEN sha256(l{i} || now || r{i}) ELSE now END AS now) FROM f{i})" for i in range(len(steps)))
    sides = ", ".join(f"b{i}.l AS l{i}, b{i}.r AS r{i}, b{i}.more AS m{i}" for i in range(len(steps)))
    small = f"translate(text, '{_LARGE}', '{_SMALL}')"
    return f"""
WITH bytes AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
c AS (SELECT documents.*, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM documents, bytes),
h AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {hashed('text')} AS digest, CASE WHEN crc % 5 = 0 THEN {hashed(small)} ELSE {hashed('text')} END AS now FROM c),
docs AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM h),
leaf0 AS (SELECT grp, pos, n, digest FROM docs),{''.join(trie('leaf', k) for k in range(deep))}
sub AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM leaf{deep}),
top0 AS (SELECT '' AS grp, pos, n, digest FROM sub),{''.join(trie('top', k) for k in range(wide))}
f0 AS (SELECT d.doc_id, d.digest AS leaf, s.digest AS subroot, d.now, sha256({proof}) AS proof_sha256, {sides} FROM docs d JOIN sub s ON s.grp = d.grp
{joins}){folds}
SELECT doc_id, leaf, subroot, top{wide}.digest AS root, proof_sha256, now AS folded_root, now = top{wide}.digest AS verified FROM f{len(steps)}, top{wide}
"""


SQL = _sql()
