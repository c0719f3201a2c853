"""Removal of repeated passages by suffix arrays (operator 4).

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the table, the same text
included. Texts are bytes in UTF-8; strings never cross texts; all strings are judged on the input.

Equal strings are brought together by their minimizers: of the `gram`-byte grams of a string the one with the
least hash, the first of equal ones, which depends on the string's bytes only. Neighbouring strings with the same
minimizer are one segment; each string is in exactly one. So

1. every text is cut into segments (hash of the minimizer, digest of the segment);
2. hashes that occur once are dropped (counts, pre-aggregated);
3. a segment whose digest also occurs elsewhere under its hash is repeated as a whole; groups of equal segments that
   hold more than a `HEAVY`th of all, of which there are fewer than HEAVY, are found by broadcast, not by a shuffle;
4. of each other segment under a repeated hash, and of one of each group of equal ones, the bytes are dealt out by
   the hash; there `induced_sort` gives the suffix and common-prefix arrays, in `memory` bytes and beyond them on disk,
   and suffixes that share `length` bytes with a neighbour are repeated. A hash's segments are sorted together: equal segments were collapsed before, so a
   passage copied a million times is one segment. Of a hash with more than `shard_rows` different segments, the
   strings are dealt out anew by where the minimizer lies in them, in blocks of `WIDTHS` places, and by the bytes that
   all strings of the block hold; narrower blocks follow where that isn't enough, down to single strings, of which a
   hash has one. So no sort has more than about a shard's segments;
5. the spans are gathered by text (their number is bounded by its length), merged, and cut out.

Texts go through one shuffle by id, used for steps 4 and 5. Segments count as equal if the 64-bit hashes of their minimizer
and of all their bytes are; everything else is compared in the arrays.

Defined results: null and empty texts have no bytes; a repeated row is a text of its own, so its strings repeat; an
empty table gives an empty result; other columns pass through or are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import appended, cut, drop_cut, parts
from panelcast.llm.induced_sort import repeated

_TABLE = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64)
#: Places of the minimizer that are taken together when a large hash is split.
WIDTHS = (43, 8, 1)
SEGMENT = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("d", pa.int64())])
SEGMENT_SQL = "id long, th long, at int, n int, h long, d long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram (a power of two bytes) at each place; shorter at the end."""
    h = _TABLE[data]
    size = 1
    while size < gram:
        h = _mixed(h[: len(h) - size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2
    return h


def segments(texts: list[bytes], length: int, gram: int, chunk: int = 1 << 21):
    """(text, start of the first string, strings, minimizer's hash, digest) as arrays, for all strings of the texts. Texts
    are taken together in chunks of some MB; a longer one is cut, with each string in one part."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0
    for k, text in enumerate(texts):
        for lo in range(0, len(text) - length + 1, chunk):
            piece = text if lo == 0 and len(text) < chunk + length else text[lo : lo + chunk + length - 1]
            if parts and held + len(piece) > chunk:
                yield _chunk(parts, length, gram)
                parts, held = [], 0
            parts.append((k, lo, piece))
            held += len(piece)
    if parts:
        yield _chunk(parts, length, gram)


def _chunk(parts: list[tuple[int, int, bytes]], length: int, gram: int):
    joined = b"".join(p for _, _, p in parts)
    data = np.frombuffer(joined, np.uint8)
    h = gram_hashes(data, gram)
    width = length - gram + 1  # grams in a string
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # 40 bits of the hash, then the place
    # least key of each `width` grams in a row: of the end of one block and the start of the next
    blocks = -(-len(key) // width) + 1
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    table = padded.reshape(blocks, width)
    to_right = np.minimum.accumulate(table, axis=1).ravel()
    to_left = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = len(data) - length + 1
    place = (np.minimum(to_left[:strings], to_right[width - 1 : width - 1 + strings]) & low).astype(np.int64)
    sizes = np.fromiter((len(p) for _, _, p in parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    valid = np.zeros(strings, bool)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(parts)), sizes)[:strings]
    valid = np.arange(strings) + length <= ends[owner]
    new = np.ones(strings, bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], strings)
    ok = valid[first]
    # strings across the end of a text come last in it: a run that starts valid may end in them
    first, last = first[ok], last[ok]
    last = np.minimum(last, ends[owner[first]] - length + 1)
    view = memoryview(joined)
    digest = xxhash.xxh3_64_intdigest
    d = np.fromiter((digest(view[s:e]) for s, e in zip(first.tolist(), (last + length - 1).tolist())), np.uint64, len(first))
    part = owner[first]
    text = np.array([k for k, _, _ in parts])[part]
    lo = np.array([x for _, x, _ in parts])[part]
    return text, first - starts[part] + lo, last - first, h[place[first]].view(np.int64), d.view(np.int64)


def _segment_rows(length: int, gram: int):
    def run(batches):
        for batch in parts(batches):
            ids, ths = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            for text, at, n, h, d in segments(texts, length, gram):
                nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)[text] if batch.column(0).null_count else None
                yield pa.RecordBatch.from_arrays([pa.array(ids[text], pa.int64(), mask=nulls), pa.array(ths[text], pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(d, pa.int64())], schema=SEGMENT)

    return run


def _sorted_shards(length: int, shard_bytes: int, memory: int, few: int):
    """Spans of the repeated strings of the segments that occur once; whole hashes together, up to shard_bytes a sort."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("span", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def spans(rows):
        found = repeated([r[5] for r in rows], length, memory, few)
        ids, ths, out = [], [], []
        for (key, th, at, n, alone, _, _), starts in zip(rows, found):
            if alone and len(starts):
                breaks = np.flatnonzero(np.diff(starts) > length)  # further apart: not one run of bytes
                s, e = np.append(starts[0], starts[breaks + 1]), np.append(starts[breaks], starts[-1]) + length
                ids.append(key)
                ths.append(th)
                out.append([{"s": int(a) + at, "e": int(b) + at} for a, b in zip(s, e)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(out, schema.field(2).type)], schema=schema)

    def run(batches):
        rows, size, last = [], 0, None
        for batch in parts(batches):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= shard_bytes and row[6] != last:
                    yield spans(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
                last = row[6]
        if rows:
            yield spans(rows)

    return run


HEAVY = 10_000


def _copied(rows: DataFrame, groups: DataFrame, length: int, least: int) -> DataFrame:
    """Whole spans of rows (id, th, at, n, h, d) whose group (h, d, copies) has several."""
    size = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("all"), F.coalesce(F.max("copies"), F.lit(0)).alias("top")).first()
    bound = max(least, size.all // HEAVY)
    light = groups.filter(f"copies > 1 AND copies <= {bound}").select("h", "d")
    if size.top <= bound:
        found = rows.join(light, ["h", "d"])
    else:
        heavy = F.broadcast(groups.filter(f"copies > {bound}").select("h", "d"))
        found = rows.join(heavy, ["h", "d"], "left_anti").join(light, ["h", "d"]).unionByName(rows.join(heavy, ["h", "d"], "left_semi"))
    return found.select("id", "th", F.array(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("n") + F.lit(length - 1)).alias("e"))).alias("span"))


DEALT = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("alone", pa.bool_()), ("seg", pa.binary()), ("h", pa.int64()), ("hot", pa.bool_()), ("p", pa.int32())])
DEALT_SQL = "id long, th long, at int, n int, alone boolean, seg binary, h long, hot boolean, p int"


def minimizer_place(segment: bytes, h: int, length: int, gram: int) -> int:
    """Where the gram with hash h (signed) that the segment's strings share starts in it."""
    found = gram_hashes(np.frombuffer(segment[:length], np.uint8), gram).view(np.int64)
    return int(np.argmax(found == h))


def narrower(at: int, n: int, segment: bytes, h: int, place: int, width: int, length: int):
    """(at, n, segment, hash, place) of the parts of a segment: strings whose minimizer lies in the same block of
    `width` places, under a hash of the bytes that all strings of the block hold."""
    for block in range((place - n + 1) // width, place // width + 1):
        nearest, farthest = block * width, block * width + width - 1
        first, last = place - min(farthest, place), place - max(nearest, place - n + 1)
        core = segment[place - nearest : place - farthest + length]
        key = xxhash.xxh3_64_intdigest(core + h.to_bytes(8, "little", signed=True) + block.to_bytes(4, "little") + bytes([width]))
        yield at + first, last - first + 1, segment[first : last + length], key - (1 << 64) if key >> 63 else key, place - first


def _narrowed(width: int, length: int):
    def run(batches):
        for batch in parts(batches):
            rows = []
            for key, th, at, n, alone, seg, h, place in zip(*[c.to_pylist() for c in batch.columns]):
                for a, k, piece, finer, p in narrower(at, n, seg, h, place, width, length):
                    d = xxhash.xxh3_64_intdigest(piece)
                    rows.append((key, th, a, k, alone, piece, finer, False, p, d - (1 << 64) if d >> 63 else d))
            if rows:
                schema = DEALT.append(pa.field("d", pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _split(hot: DataFrame, length: int, shard_rows: int, many: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans, dealt rows) of the segments of hashes that are too large for a sort: repeated parts, and the parts to
    sort under their new hashes."""
    spans, sorts = [], []
    widths = [w for w in WIDTHS if w <= length]
    for width in widths:
        made = cut(hot.select("id", "th", "at", "n", "alone", "seg", "h", "p").mapInArrow(_narrowed(width, length), DEALT_SQL + ", d long"))
        one = F.min(F.struct(F.xxhash64("id", "th", "at", "n").alias("row"), "id", "th", "at", "n", "alone", "seg", "p"))
        groups = cut(made.groupBy("h", "d").agg(F.count(F.lit(1)).alias("copies"), one.alias("r")))
        kinds = cut(groups.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
        spans.append(_copied(made.filter("alone").select("id", "th", "at", "n", "h", "d"), groups.select("h", "d", "copies"), length, many))
        left = groups.join(kinds, "h").select("r.id", "r.th", "r.at", "r.n", (F.col("r.alone") & (F.col("copies") == 1)).alias("alone"), "r.seg", "h", (F.col("kinds") > shard_rows).alias("hot"), "r.p")
        if width == widths[-1]:
            return spans, [*sorts, left]
        left = cut(left)
        sorts.append(left.filter("NOT hot"))
        hot = left.filter("hot")
        if hot.isEmpty():
            return spans, sorts
    return spans, sorts


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 32, shard_bytes: int = 5_000_000, shard_rows: int = 4_000, many: int = 25_000, memory: int = 32_000_000, few: int = 1 << 20) -> DataFrame:
    """id, th, spans (start, end of repeated byte runs, unmerged) from docs (id, th, text). Hashes with over shard_rows different
    segments are split; groups of over `many` equal ones may be broadcast; `many` segments make a task on average."""
    found = cut(docs.select("id", "th", "text").filter(F.octet_length("text") >= length).mapInArrow(_segment_rows(length, gram), SEGMENT_SQL))
    # counts and groups are stored, so that both sides of the joins with them come from a shuffle: only then does Spark
    # split a hash that holds a large part of the rows
    counts = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi")).filter("c > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")))
    hits = cut(found.join(counts, "h"))
    drop_cut(found)
    whole = F.array(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("n") + F.lit(length - 1)).alias("e")))
    equal = hits.filter("NOT mixed").select("id", "th", whole.alias("span"))
    tagged = hits.filter("mixed").withColumn("row", F.xxhash64("id", "th", "at"))
    groups = cut(tagged.groupBy("h", "d").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row")))
    needed = cut(groups.groupBy("h").agg(F.min("copies").alias("least"), F.count(F.lit(1)).alias("kinds")).filter("least = 1").select("h", (F.col("kinds") > shard_rows).alias("hot")))
    copied = _copied(tagged.select("id", "th", "at", "n", "h", "d"), groups.select("h", "d", "copies"), length, many)
    chosen = groups.join(needed, "h").join(tagged.select("h", "d", "row", "id", "th", "at", "n"), ["h", "d", "row"])
    chosen = cut(chosen.select("id", "th", F.struct("at", "n", (F.col("copies") == 1).alias("alone"), "h", "hot").alias("seg")))
    tally = chosen.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("seg.hot").cast("long")), F.lit(0)).alias("hot")).first()
    shards = max(1, -(-tally.rows // many))
    by_text = chosen.groupBy("id", "th").agg(F.collect_list("seg").alias("segs"))
    texts = docs.select("id", "th", "text")
    cut_out = texts.join(by_text.select(F.col("id").alias("i"), F.col("th").alias("t"), "segs"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))

    def bytes_of(batches):
        for batch in parts(batches, 500):
            rows = []
            for key, th, text, segs in zip(*[c.to_pylist() for c in batch.columns]):
                data = text.encode()
                for s in segs:
                    seg = data[s["at"] : s["at"] + s["n"] + length - 1]
                    rows.append((key, th, s["at"], s["n"], s["alone"], seg, s["h"], s["hot"], minimizer_place(seg, s["h"], length, gram) if s["hot"] else 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), DEALT.types)], schema=DEALT)

    dealt = cut_out.select("id", "th", "text", "segs").mapInArrow(bytes_of, DEALT_SQL)
    found_spans = []
    if tally.hot:
        dealt = cut(dealt)
        found_spans, more = _split(dealt.filter("hot"), length, shard_rows, many)
        dealt = dealt.filter("NOT hot")
        for x in more:
            dealt = dealt.unionByName(x)
    arrays = dealt.select(*DEALT.names[:7]).repartition(shards, "h").sortWithinPartitions("h").mapInArrow(_sorted_shards(length, shard_bytes, memory, few), "id long, th long, span array<struct<s:int,e:int>>")
    for x in found_spans:
        arrays = arrays.unionByName(x)
    return equal.unionByName(copied).unionByName(arrays)


def merged(spans: list, n: int) -> list[tuple[int, int]]:
    """Runs of bytes that the spans cover, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, min(e, n)) for s, e in out]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, as_text: bool = False, prefix: str = "_", **how) -> DataFrame:
    """docs with text (remaining bytes; with as_text as a string, without halves of characters), bytes, removed and spans
    (counts), each named with prefix; columns of those names are replaced."""
    columns = docs.columns
    assert docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    plain = docs.toDF(*[f"c{k}" for k in range(len(columns))])  # by position, so that clashing names do no harm
    id_at, text_at = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    known = plain.withColumns({"id": F.col(id_at).cast("long"), "th": F.xxhash64(text_at)})
    base = known.select("id", "th", F.col(text_at).alias("text"))
    spans = repeated_spans(base, length, **how).groupBy("id", "th").agg(F.flatten(F.collect_list("span")).alias("list")).withColumnsRenamed({"id": "s_id", "th": "s_th"})
    joined = known.join(spans, F.col("id").eqNullSafe(F.col("s_id")) & F.col("th").eqNullSafe(F.col("s_th")), "left").drop("id", "th", "s_id", "s_th")

    def rows(texts, lists):
        kept, sizes, removed, counts = [], [], [], []
        for text, spans in zip(texts, lists):
            data = (text or "").encode()
            runs = merged([(x["s"], x["e"]) for x in spans], len(data)) if spans else []
            left, at = [], 0
            for s, e in runs:
                left.append(data[at:s])
                at = e
            left.append(data[at:])
            rest = b"".join(left)
            kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            sizes.append(len(data))
            removed.append(sum(e - s for s, e in runs))
            counts.append(len(runs))
        return [kept, sizes, removed, counts]

    kind = ("string", pa.string()) if as_text else ("binary", pa.binary())
    out = appended(joined, [text_at, "list"], rows, [("text", *kind), ("bytes", "long", pa.int64()), ("removed", "long", pa.int64()), ("spans", "long", pa.int64())]).drop("list")
    names = ("text", "bytes", "removed", "spans")
    stays = [(f"c{k}", c) for k, c in enumerate(columns) if c not in {prefix + n for n in names}]
    return out.select(*[c for c, _ in stays], *names).toDF(*[name for _, name in stays], *[prefix + n for n in names])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    out = without_repeats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), length=length, **how)
    return out.select("doc_id", F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.sha2("_text", 256).alias("kept_sha256"))
