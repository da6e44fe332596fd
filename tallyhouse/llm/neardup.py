"""MinHash near-duplicate detection (operator 7).

Each text's set of word shingles becomes one permutation's minima: the hash space is cut into bins, the least hash of each bin is
kept, and an empty bin borrows from the first filled bin of its own fixed random order of bins (optimal densification, so that two
sets agree in a bin with the probability of their similarity). Bands of consecutive bins give bucket keys. Within a bucket edges
form a star: every member is paired with the centre alone, so a bucket of m sets gives m - 1 pairs. Pairs are confirmed on whole
sets. Equal sets are one node from the start, however many copies there are.

A star can miss a link between two members that are both unlike the centre. So the sets of buckets in which more than one component
is left are joined once more, exactly and without the buckets: shingles are ordered from rare to common (by counts on a fixed number
of counters, the same for all), and two sets that are alike enough must share one of the first few shingles of each, so only those
are joined. Sets that share a common passage have it at the end of that order and don't meet. Pairs that sizes, places and bit arrays
(every shingle flips one bit; two arrays differ in no more bits than the sets in shingles) leave open are confirmed on whole sets.

Defined results: null text, empty text and text of white space alone have an empty set, link with nothing and are their own
component; a text with fewer words than a shingle has its whole sequence as one; rows that repeat a doc_id are one node with the
sets of all its rows (a null doc_id is one such id); component_id is the least doc_id reachable; very long texts are hashed whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_LETTERS, dropped, mixed, saved, slice_hashes, text_steps, word_slices

WORDS = 5
PERCENT = 75
BANDS, ROWS = 40, 4
BINS = 256
#: 64-bit words of the array of flipped bits.
SKETCH = 16
#: Counters of the shingles' frequencies: what the driver holds and sends to tasks, a byte each.
COUNTERS = 1 << 20
SET_BATCH = 256


def _orders(bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins, itself first."""
    rng = np.random.default_rng(20240607)
    table = np.array([rng.permutation(bins) for _ in range(bins)])
    for i in range(bins):
        k = int(np.flatnonzero(table[i] == i)[0])
        table[i, 0], table[i, k] = table[i, k], table[i, 0]
    return table


ORDERS = _orders(BINS)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    starts, ends, first = word_slices(raw, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    w = slice_hashes(SMALL_LETTERS[raw], starts, ends)
    with np.errstate(over="ignore"):
        q = np.uint64(0xC6A4A7935BD1E995)
        full = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            full = full * q + w[k : k + len(full)]
        full = mixed(full)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                s = np.sort(full[a : b - words + 1])
                out.append(s[np.r_[True, s[1:] != s[:-1]]])
            elif b > a:
                h = np.uint64(b - a)
                for x in w[a:b]:
                    h = h * q + x
                out.append(mixed(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys of one non-empty sorted set of hashes."""
    bins = (s >> np.uint64(56)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    least = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    least[bins[head]], filled[bins[head]] = s[head], True
    source = np.arange(BINS)
    if len(head) < BINS:
        empty = np.flatnonzero(~filled)
        source[empty] = ORDERS[empty, filled[ORDERS[empty]].argmax(1)]
    signature = least[source[: bands * rows]].reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = mixed(key + signature[:, r]) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(key)


def flipped_bits(s: np.ndarray) -> np.ndarray:
    """SKETCH words of one set: the bit that each hash names, flipped once for each hash."""
    odd = np.bincount((s % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _each(docs: DataFrame, words: int, made, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row, end, raw, at in text_steps(batch.column(1)):
                sets = shingle_hashes(raw, at, words)
                for a in range(0, end - row, SET_BATCH):
                    yield made(batch.column(0).slice(row + a, min(SET_BATCH, end - row - a)), sets[a : a + SET_BATCH])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    first = np.r_[0, np.cumsum([len(x) for x in arrays])]
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, shingles array<long>: each row's set of shingle hashes."""
    return _each(docs, words, lambda ids, sets: pa.RecordBatch.from_arrays([ids, _lists(sets)], names=["doc_id", "shingles"]), "doc_id long, shingles array<long>")


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, two hashes that stand for the whole set, the bucket keys and the flipped bits."""

    def made(ids, sets):
        with np.errstate(over="ignore"):
            one = [int(np.add.reduce(mixed(s.copy()), dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
            two = [int(np.bitwise_xor.reduce(s * (s | np.uint64(1))).astype(np.int64)) if len(s) else 0 for s in sets]
        keys = [band_keys(s, bands, rows) if len(s) else s for s in sets]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists(keys), _lists([flipped_bits(s) for s in sets])], names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "bits"])

    return _each(docs, words, made, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, bits array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are alike enough. Sort-merge joins, so that Spark can split a centre with many pairs."""
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")).hint("merge") for x in "ab")
    joint = pairs.join(b, "b").join(a, "a")
    same = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - same
    return joint.where(same.cast("long") * 100 >= either.cast("long") * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the edges (a, b), by alternating star contractions."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = saved(e, "components-0")
    n, turn = None, 0
    while True:
        turn += 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: all larger neighbours of u move to the least node of u's neighbourhood
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
        big = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u's smaller neighbours and u itself move to the least of them
        small_least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(small_least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        before, e = e, saved(small.where("u <> v").distinct(), f"components-{turn}")
        dropped(before, least)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == n:
            break
        n = state
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def may_link(n: str, m: str, x: str, y: str, percent: int) -> Column:
    """What sizes and flipped bits alone say: false only where the sets can't be alike enough."""
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, k: total + k)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent))


def commonness(sets: DataFrame) -> np.ndarray:
    """How often shingles fall on each of COUNTERS counters, eight steps to a doubling; 0 for those that are not well above the mean,
    which are most, and more so the more sets there are. Only the others' counts reach the driver."""
    counted = saved(sets.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(COUNTERS)).cast("int").alias("slot")).count(), "neardup-counters")
    mean = (counted.agg(F.sum("count")).first()[0] or 0) / COUNTERS
    often = counted.where(F.col("count") > max(2, 2 * mean)).toArrow()
    dropped(counted)
    out = np.zeros(COUNTERS)
    out[np.asarray(often.column("slot"))] = np.asarray(often.column("count"))
    return np.minimum(255, np.ceil(8 * np.log2(1 + out))).astype(np.uint8)


def first_shingles(sets: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """token, doc_id, n, place, component: of each set (doc_id, component, shingles) the rarest shingles, so many that no link shares none."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column("shingles")
            at, values = np.asarray(lists.offsets, np.int64), np.asarray(lists.values)
            made, places = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                s = values[a:b]
                k = b - a - -(-percent * (b - a) // 100) + 1
                made.append(s[np.lexsort((s, common[s % COUNTERS]))[:k]])
                places.append(np.arange(k))
            count = np.array([len(x) for x in made], np.int64)
            row = np.repeat(np.arange(len(made)), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(made)), batch.column("doc_id").take(pa.array(row)), pa.array(np.repeat(np.diff(at), count)), pa.array(np.concatenate(places)), batch.column("component").take(pa.array(row))],
                names=["token", "doc_id", "n", "place", "component"],
            )

    return sets.select("doc_id", "component", "shingles").mapInArrow(run, "token long, doc_id long, n long, place long, component long")


def across(open_: DataFrame, sets: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among the sets of open_ (doc_id, component) that sizes, rare shingles and bits leave possible."""
    own = saved(sets.where(F.size("shingles") > 0).join(open_, "doc_id"), "neardup-open")
    tokens = saved(first_shingles(own, commonness(own), percent), "neardup-tokens")
    x = tokens.select("token", *(F.col(c).alias(f"{c}_x") for c in tokens.columns[1:]))
    y = tokens.select("token", *(F.col(c).alias(f"{c}_y") for c in tokens.columns[1:])).hint("merge")
    least = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent) - 1e-9)  # shingles that a link has in common
    sized = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    met = x.join(y, "token").where("component_x < component_y").where(sized & (F.col("place_x") <= F.col("n_x") - least) & (F.col("place_y") <= F.col("n_y") - least))
    pairs = met.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()
    a, b = (bits.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    return pairs.join(b, "b").join(a, "a").where(may_link("n_a", "n_b", "bits_a", "bits_b", percent)).select("a", "b")


def links(nodes: DataFrame, docs: DataFrame, extra: DataFrame, words: int, percent: int) -> DataFrame:
    """node, component over the nodes (doc_id, n_shingles, keys, bits), for nodes that link with another; extra: links known before."""
    member = nodes.select("doc_id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    # a key's members are counted before they move, and meet their centre in a sort-merge join, which Spark splits where a key is hot
    # (it can't where a side is aggregated in the same stage; so what is aggregated is saved first, here and below)
    centres = member.groupBy("key").agg(F.min("doc_id").alias("centre"), F.min_by("n", "doc_id").alias("n_centre"), F.count("*").alias("m")).where("m > 1")
    centres = saved(centres, "neardup-centres")
    met = saved(member.join(centres.hint("merge"), "key"), "neardup-met")
    # the sets of all that share a bucket, made once; the texts move by doc_id, at any size in the same way
    asked = met.select("doc_id").distinct().hint("shuffle_hash")
    sets = saved(shingle_sets(docs.join(asked, "doc_id", "left_semi"), words), "neardup-sets")
    close = F.least("n", "n_centre") * 100 >= F.greatest("n", "n_centre") * percent
    pairs = saved(met.where("doc_id <> centre").where(close).select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct(), "neardup-pairs")
    edges = saved(confirmed(pairs, sets, percent).union(extra), "neardup-edges")
    found = saved(components(edges), "neardup-components")
    # only a bucket of three members or more can hide a link from its star
    left = met.where("m > 2").select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    several = left.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    several = saved(several, "neardup-several")
    open_ = left.join(several.hint("merge"), "key", "left_semi").select("doc_id", "component").distinct()
    more = saved(across(open_, sets, nodes, percent).join(pairs, ["a", "b"], "left_anti"), "neardup-pairs")
    good = saved(confirmed(more, sets, percent), "neardup-edges")
    dropped(centres, met, pairs, edges, several, more, sets)
    if good.isEmpty():
        return found
    return saved(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(good)), "neardup-components")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sets = saved(signatures(docs, words, bands, rows), "neardup-signatures")
    full = sets.where("n_shingles > 0")
    # equal sets are one node, named by its least doc_id
    groups = saved(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node")), "neardup-groups")
    same = ["set_a", "set_b", "n_shingles"]
    nodes = full.withColumnRenamed("doc_id", "node").join(groups, [*same, "node"], "left_semi").dropDuplicates([*same, "node"]).select(F.col("node").alias("doc_id"), "n_shingles", "keys", "bits")
    # an id whose rows hold several sets links those sets' nodes
    torn = full.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).where("x < y").select("doc_id")
    extra = full.select("doc_id", *same).join(torn, "doc_id", "left_semi").join(groups, same).select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
    found = links(nodes, docs, extra, words, percent)
    named = groups.join(found, "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
    return (
        sets.select("doc_id", *same)
        .join(named.hint("merge"), same, "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
