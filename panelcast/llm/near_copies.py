"""Near copies by the Jaccard similarity of shingle sets (near-duplicate stage of the pipeline).

A text's set has the XXH64 hashes of its shingles of `size` words; of fewer words, of all of them. Texts with equal
sets are one node. Two nodes link at a similarity of 0.8 or more, which is checked on the whole sets; components
of links are groups.

Pairs are retrieved in operator 10's way first: a node's 64-bit SimHash is the majority over its set, fingerprints are dealt
out by blocks of equal bits, each shard gets a BK-tree, and fingerprints at RADIUS or fewer bits give pairs (as many as join
the components of fingerprints, not all; nodes with equal fingerprints are paired with the smallest one). Those near by their
whole sets are links, and their components are the first ones.

What that radius doesn't reach is retrieved by MinHash, between different first components only: BANDS bands of ROWS minima under independent affine hashes each. A pair at 0.8 shares
no band with a chance of (1 - 0.8 ** 5) ** 36 = 6e-7, more similar pairs with less. (64-bit fingerprints can't reach
0.8: such pairs differ in some 10 bits and up to 18 or so, where blocks of equal bits are three bits short.)
In each bucket every node is paired with the smallest one, unless both are in one component; then, where a bucket still has nodes of several components,
with those of other components. So no pair of a bucket is left unjoined, and a large group of copies gives a star, not all
pairs. Pairs that can't be near by their sizes and by 1024-bit prints are no rows: the prints are compared in the join
itself. Sets of under SMALL shingles have parities as their print (a bit for each cell of a hash table, odd or even): two
prints differ in at most as many bits as the sets differ in shingles, so no pair is lost. Larger ones have a SimHash of as
many bits: pairs at 0.8 differ in 155 bits with a deviation of 11.5, so one in a million is over NEAR. Whole sets are made
only of what is left.

Defined results: null, empty and blank texts have the empty set, and are copies of each other only; rows that repeat
are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from panelcast.llm import simhash
from panelcast.llm.common import appended, cut, drop_cut
from panelcast.llm.simhash import components

RADIUS, SHARD = 2, 4096
BANDS, ROWS = 36, 5
PRINT, NEAR, SMALL = 16, 212, 800
LONGS = ArrayType(LongType())
STAR = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
_random = np.random.default_rng(20)
_A = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)
_B = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False)


def shingle_set(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the different shingles of `size` words (A-Z lower-cased); of fewer words, of all of them."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = n - size + 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[:k].tolist(), ends[size - 1 :].tolist())), np.uint64, k))


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of the set as a signed long; zero for the empty one."""
    ones = sum((simhash.votes(hashes[at : at + (1 << 16)]) for at in range(0, len(hashes), 1 << 16)), np.zeros(64, np.int64))
    return simhash.signed(simhash.majority(ones, len(hashes)))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima, of all bands different; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (_A * hashes[at : at + 512] + _B).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), j) for j, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


_M = _random.integers(0, 1 << 64, (1, PRINT), np.uint64, endpoint=False) | np.uint64(1)


def wide_print(hashes: np.ndarray) -> list[int]:
    """PRINT * 64 bits as signed longs: parities of a small set, SimHash of a large one."""
    if len(hashes) < SMALL:
        cell = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (64 * PRINT).bit_length() + 1)
        odd = np.bincount(cell.astype(np.int64), minlength=64 * PRINT) & 1
        return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist()
    ones = np.zeros(64 * PRINT, np.int64)
    for at in range(0, len(hashes), 2048):
        x = hashes[at : at + 2048, None] * _M
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64).tolist()


def _stars(batches):
    """(key, u, v) of rows (key, node) in order: v is the smallest node of the bucket, u each other one, once."""
    key = lead = before = None
    for batch in batches:
        keys, nodes = (c.to_numpy() for c in batch.columns)
        if not len(keys):
            continue
        starts = np.r_[keys[0] != key, keys[1:] != keys[:-1]]
        at = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), -1))
        leads = np.where(at < 0, 0 if lead is None else lead, nodes[np.maximum(at, 0)])
        again = np.r_[not starts[0] and nodes[0] == before, ~starts[1:] & (nodes[1:] == nodes[:-1])]
        key, lead, before = keys[-1], leads[-1], nodes[-1]
        found = (nodes != leads) & ~again
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[found], pa.int64()) for x in (keys, nodes, leads)], schema=STAR)


FACE = ["size", *(f"p{k}" for k in range(PRINT))]


def _alike() -> Column:
    """Whether the sets of u and v (columns u_.. and v_.. of FACE) can be near."""
    differ = sum((F.bit_count(F.col(f"v_p{k}").bitwiseXOR(F.col(f"u_p{k}"))) for k in range(1, PRINT)), F.bit_count(F.col("v_p0").bitwiseXOR(F.col("u_p0"))))
    small = F.greatest("v_size", "u_size") < SMALL
    large = F.least("v_size", "u_size") >= SMALL
    # of sets at 0.8 at most a ninth of both sizes together is in one set only
    by_print = F.when(small, 9 * differ <= F.col("v_size") + F.col("u_size")).when(large, differ <= NEAR).otherwise(True)
    return (5 * F.least("v_size", "u_size") >= 4 * F.greatest("v_size", "u_size")) & by_print


def _as(rows: DataFrame, side: str, *others: str) -> DataFrame:
    return rows.select(*others, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in others])


def _close(faces: DataFrame) -> DataFrame:
    """(u, v): pairs of nodes at RADIUS or fewer differing bits of the fingerprint, by BK-trees."""
    least = cut(faces.groupBy("fp").agg(F.min("node").alias("least")))  # its size is known when the join is planned
    equal = faces.select("node", "fp").join(least, "fp").filter("node > least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    trees = simhash.shard_links(least.select("fp", F.col("least").alias("node")), RADIUS, SHARD, direct=True)
    out = cut(equal.unionByName(trees))
    drop_cut(least)
    drop_cut(trees)
    return out


def _linked(pairs: DataFrame, prints: DataFrame, docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets have a similarity of 0.8 (4 / 5) or more."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ties = prints.join(wanted, "node").groupBy("node").agg(F.min("_tie").alias("_tie")).select("_tie").distinct()
    ties = cut(ties)  # its size is known when the join is planned: a small one doesn't shuffle the texts
    texts = docs.select(F.xxhash64(text_col).alias("_tie"), F.col(text_col).alias("text")).join(ties, "_tie", "left_semi").select("text")

    def rows(texts):
        sets = [shingle_set(t, size) for t in texts]
        return [[node_of(s) for s in sets], [s.view(np.int64) for s in sets]]

    made = appended(texts, ["text"], rows, [("node", "long", pa.int64()), ("hashes", LONGS, pa.list_(pa.int64()))])
    sets = cut(made.select("node", "hashes").dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    # |a and b| / |a or b| >= 4 / 5
    out = cut(both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"))
    drop_cut(sets)
    drop_cut(ties)
    return out


def grouped(docs: DataFrame, keep: list[str], text_col: str = "text", size: int = 5) -> DataFrame:
    """The columns `keep` of every row and its group, a long."""

    def rows(texts):
        sets = [shingle_set(t, size) for t in texts]
        return [[node_of(s) for s in sets], [fingerprint(s) for s in sets], [bands(s) for s in sets], [len(s) for s in sets], *zip(*map(wide_print, sets))]

    kept = [f"_k{i}" for i in range(len(keep))]
    chosen = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.xxhash64(text_col).alias("_tie"), F.col(text_col).alias("_text"))
    new = [("node", "long", pa.int64()), ("fp", "long", pa.int64()), ("bands", LONGS, pa.list_(pa.int64())), ("size", "integer", pa.int32()), *((f"p{k}", "long", pa.int64()) for k in range(PRINT))]
    prints = cut(appended(chosen, ["_text"], rows, new).drop("_text"))
    nodes = cut(prints.select("node", "fp", *FACE).dropDuplicates(["node"]))

    close = _close(nodes)
    tried = cut(close.join(_as(nodes, "u"), F.col("u") == F.col("u_node")).join(_as(nodes, "v"), (F.col("v") == F.col("v_node")) & _alike()).select("u", "v"))
    by_trees = _linked(tried, prints, docs, text_col, size)
    firsts = components(by_trees)
    faces = cut(nodes.join(firsts, nodes.node == firsts.u, "left").select("node", F.coalesce("root", "node").alias("first"), *FACE))
    for used in (nodes, close, firsts):
        drop_cut(used)

    dealt = prints.select("node", F.explode("bands").alias("key")).select("key", "node").repartition("key").sortWithinPartitions("key", "node")
    stars = cut(dealt.mapInArrow(_stars, "key long, u long, v long"))
    pairs = stars.select("u", "v").distinct()
    other = F.col("u_first") != F.col("v_first")
    near = cut(pairs.join(_as(faces, "u"), F.col("u") == F.col("u_node")).join(_as(faces, "v"), (F.col("v") == F.col("v_node")) & other & _alike()).select("u", "v"))
    by_bands = _linked(near, prints, docs, text_col, size)
    links = by_trees.unionByName(by_bands)
    roots = components(links)

    members = stars.select("key", F.col("u").alias("node")).unionByName(stars.select("key", F.col("v").alias("node")).distinct())
    placed = members.join(roots, members.node == roots.u, "left").select("key", "node", F.coalesce("root", "node").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most").select("key")
    left = cut(placed.join(mixed, "key").join(faces.drop("first"), "node"))
    across = _as(left, "v", "key").join(_as(left, "u", "key"), "key").filter((F.col("v_part") < F.col("u_part")) & _alike())
    across = across.select(F.greatest("u_node", "v_node").alias("u"), F.least("u_node", "v_node").alias("v")).distinct()
    across = cut(across.join(near.unionByName(tried), ["u", "v"], "left_anti"))
    if not across.isEmpty():
        more = _linked(across, prints, docs, text_col, size)
        roots = components(links.unionByName(more))
        drop_cut(more)
    for used in (tried, stars, near, left, across, by_trees, by_bands, faces):
        drop_cut(used)
    return prints.join(roots, prints.node == roots.u, "left").select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], F.coalesce("root", "node").alias("group"))
