"""SimHash near-duplicates by BK-trees (operator 10).

A text's fingerprint has bit b set if over half of its shingles' 64-bit hashes have it. Equal fingerprints are
one node, named by the fingerprint. Fingerprints link at `radius` or fewer differing bits; components of links
get the smallest id of their rows.

Of radius + 1 blocks of bits at least one is equal in two linked fingerprints, so nodes are dealt out by block and value,
and every such shard gets a BK-tree: a node's children are keyed by their Hamming distance to it, and a search follows
only the edges from d - radius to d + radius. A shard that is larger than `shard_max` is cut again by blocks of the bits
that are left, again and again until it isn't; no cut loses a link, and FEW bits hold no more than 2^FEW fingerprints, so
this ends. The set of trees grows with the corpus, so they are not broadcast: a shuffle by
shard brings each tree's nodes and queries together. A shard gives links to its components' smallest members only (a
forest, never all pairs); the forests of all shards are joined by large-star and small-star rounds, each written to the
shared folder.

Defined results: a null id is larger than any other (a component of null ids has a null id), and rows with a null
id link by their own texts only; null, empty and blank texts have fingerprint zero and link like any other; rows that repeat
are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import appended, cut, drop_cut

#: Bits that are not cut any more.
FEW = 12
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64 bits by majority over the XXH64 hashes of all shingles of `size` words (A-Z lower-cased); of fewer words,
    over the one of all of them. A bit at exactly half is 0."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = n - size + 1
    spans = zip(starts[:k].tolist(), ends[size - 1 :].tolist())
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 16):  # a long text's bits aren't all in memory at once
        n = min(k - at, 1 << 16)
        ones += votes(np.fromiter((digest(joined[s:e], seed) for s, e in itertools.islice(spans, n)), np.uint64, n))
    return majority(ones, k)


def fingerprinted(docs: DataFrame, text_col: str = "text", name: str = "fp", size: int = 3) -> DataFrame:
    """docs with the fingerprint as a signed long."""

    def rows(texts):
        return [[signed(fingerprint(t, size)) for t in texts]]

    return appended(docs, [text_col], rows, [(name, "long", pa.int64())])


class BKTree:
    """Of 64-bit integers; search follows only the edges within the radius."""

    def __init__(self):
        self.root: list | None = None  # [value, payload, {distance: child}]

    def add(self, value: int, payload) -> None:
        if self.root is None:
            self.root = [value, payload, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, payload, {}]
                return
            node = child

    def near(self, value: int, radius: int) -> list:
        """Payloads of the values at up to radius differing bits."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            at, payload, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                out.append(payload)
            if children:
                if len(children) <= 2 * radius + 1:
                    todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
                else:
                    todo += [c for e in range(d - radius, d + radius + 1) if (c := children.get(e)) is not None]
        return out


def forest(values: list[int], ids: list[int], radius: int, direct: bool = False) -> list[tuple[int, int]]:
    """(id, smallest id of its component in this shard) for those that aren't the smallest. direct: as many pairs that join
    the components, but of ids whose own values are within the radius, larger id first."""
    parent, found = list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = BKTree()
    for k, value in enumerate(values):
        for other in tree.near(value, radius):
            a, b = root(k), root(other)
            if a != b:
                parent[max(a, b, key=ids.__getitem__)] = min(a, b, key=ids.__getitem__)
                if ids[k] != ids[other]:  # a node can reach a shard by two cuts
                    found.append((max(ids[k], ids[other]), min(ids[k], ids[other])))
        tree.add(value, k)
    return found if direct else [(ids[k], ids[r]) for k in range(len(values)) if (r := root(k)) != k]


def blocks(bits: list[int], parts: int) -> list[list[int]]:
    """bits cut into `parts` runs of about the same length."""
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def finer(mask: int, parts: int) -> list[int]:
    """mask with one more of the `parts` blocks of the bits that it lacks, for each of them. Unsigned."""
    return [mask | sum(1 << b for b in p) for p in blocks([b for b in range(64) if not mask >> b & 1], parts)]


def _dealt(nodes: DataFrame, radius: int, level: list[int]) -> DataFrame:
    """nodes (fp, node, mask) as rows of the shards (mask, part) one level below. The table of masks has (radius + 1)^depth
    rows, whatever the data."""
    table = [(signed(m), [signed(f) for f in finer(m, radius + 1)]) for m in level]
    below = nodes.sparkSession.createDataFrame(table, "mask long, below array<long>")
    rows = nodes.join(F.broadcast(below), "mask").select("fp", "node", F.explode("below").alias("mask"))
    return rows.select("fp", "node", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))


def shard_links(nodes: DataFrame, radius: int, shard_max: int, direct: bool = False) -> DataFrame:
    """(u, v): links of nodes (fp, node) by way of the shards; see forest."""
    level = [0]
    todo = nodes.select("fp", "node", F.lit(0).cast("long").alias("mask"))
    stored, shards = [], []
    while True:
        dealt = _dealt(todo, radius, level)
        level = sorted({f for m in level for f in finer(m, radius + 1)})
        sizes = dealt.groupBy("mask", "part").count().filter("count > 1")
        stored.append(cut(dealt.join(sizes, ["mask", "part"])))
        todo = stored[-1].filter(f"count > {shard_max}").select("fp", "node", "mask")
        if max(64 - m.bit_count() for m in level) <= FEW or todo.isEmpty():
            shards.append(stored[-1])
            break
        shards.append(stored[-1].filter(f"count <= {shard_max}"))
    keyed = shards[0]
    for more in shards[1:]:
        keyed = keyed.unionByName(more)
    by = ["mask", "part"]
    keyed = keyed.select(*by, "fp", "node")

    def links(batches):
        key, values, ids, out = None, [], [], []
        for batch in batches:
            for *k, fp, node in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    if len(ids) > 1:
                        out += forest(values, ids, radius, direct)
                    key, values, ids = k, [], []
                values.append(fp & 0xFFFFFFFFFFFFFFFF)
                ids.append(node)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=EDGES)
                out = []
        if len(ids) > 1 and (out := forest(values, ids, radius, direct)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=EDGES)

    out = cut(keyed.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(links, "u long, v long").distinct())
    for used in stored:
        drop_cut(used)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(u, root): the smallest vertex of its component for each that has a smaller one. Alternating stars: a vertex
    hands its larger neighbours, then its smaller ones, to the smallest one it knows, until nothing changes."""
    tip = F.col("v")
    tally = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    now = cut(edges)
    before = now.agg(*tally).first()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(tip).alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min(tip).alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        new = cut(small)
        drop_cut(now)
        now = new
        state = now.agg(*tally).first()
        if state == before:
            return now.select("u", F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shard_max: int = 4096, size: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row."""
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    prints = cut(fingerprinted(chosen, size=size).select("doc_id", "fp"))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(shard_links(nodes.select("fp", F.col("fp").alias("node")), radius, shard_max))
    placed = nodes.join(roots, nodes.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("part"))
    named = placed.join(placed.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
