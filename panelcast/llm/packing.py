"""Packing documents into sequences (operator 8).

Every document becomes its ids and an end id. Whole windows are cut off first; of the remainders a histogram over
length classes (windows / `units` tokens wide, counted on the whole corpus) is made. Shallow combinations - up
to `depth` classes that together fill a window - are enumerated, and non-negative least squares finds how often
each should be used so that the histogram is met. The counts are the recipe; it is broadcast (it has a bounded
size) and every block of documents follows it: its share of the counts, rounded, as far as its documents go.
What is left over is residual: cut freely, it fills the gaps of the combinations, then whole windows, and what
remains at the end of a block goes into sequences of powers of two, so that nothing is padded.

A block is up to `block_tokens` ids of one partition of the stored ids, so memory is bounded, and a task that
is run again packs the same rows the same way.

Defined results: a null or empty text has the end id only; repeated rows are packed each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.bpe_automaton import byte_letters
from panelcast.llm.common import cut, parts, release

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\u024f]").search  # case and composition of what lies below are simple
_MARKS = ".,;:!?#*$%&|)]}\"-=+/"


class Encoder:
    """A tokenizers vocabulary whose pre-split never crosses white space and parts letters from marks, and which lower-
    cases, with a bounded table of the runs between white space seen so far. Unseen runs of a batch go to the library
    together. To see fewer different ones, plain text is lower-cased before; and a run that ends in marks after a
    letter or digit is put together from the ids of its two parts."""

    def __init__(self, content: str, size: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = size

    @staticmethod
    def runs(text: str) -> list[str] | None:
        """Parts whose ids in a row are the text's; None where the text must go as a whole."""
        if "<|" in text or _PLAIN(text):
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return text.lower().split()

    def batch(self, texts: list[str]) -> list[bytes]:
        """Packed unsigned 32-bit ids of each text."""
        runs = [self.runs(t) for t in texts]
        young, old = self.young, self.old
        unseen: list[str] = []
        pointed: list[tuple[str, str]] = []
        for r in runs:
            for w in set(r or ()).difference(young):
                known = old.get(w)
                if known is None:
                    known = b""
                    stem = w.rstrip(_MARKS)
                    if stem != w and stem[-1:].isalnum():
                        pointed.append((w, stem))
                        for x in (stem, w[len(stem) :]):
                            if x not in young:
                                young[x] = got = old.get(x, b"")
                                if not got:
                                    unseen.append(x)
                    else:
                        unseen.append(w)
                young[w] = known
        whole: list[str] = []
        for w in unseen:
            if w.isalpha() and w.islower() and not _PLAIN(w):  # pre-split as one: straight to the library's merges
                young[w] = array("I", [x.id for x in self.merge(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))]).tobytes()
            else:
                whole.append(w)
        for k in range(0, len(whole), 2000):
            part = whole[k : k + 2000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                young[w] = array("I", e.ids).tobytes()
        for w, stem in pointed:
            young[w] = young[stem] + young[w[len(stem) :]]
        out = [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if r is None else b"".join(map(young.__getitem__, r)) for t, r in zip(texts, runs)]
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out


_KEPT: dict[int, Encoder] = {}


def token_ids(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens with the end id), ids (unsigned 16- or 32-bit little-endian): stored in the shared folder,
    as the packing reads them twice."""
    with open(path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())

    def encode(batches):
        key = hash(content.value)
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Encoder(content.value)
        encoder = _KEPT[key]
        end = array("I", [end_id]).tobytes()
        for part in parts(batches):
            ids = [np.frombuffer(x + end, np.uint32) for x in encoder.batch([t or "" for t in part.column(1).to_pylist()])]
            wide = any(len(x) and x.max() > 65_535 for x in ids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([4 if wide else 2] * len(ids), pa.int32()), pa.array([(x if wide else x.astype(np.uint16)).tobytes() for x in ids], pa.binary())], names=["doc_id", "n", "width", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(chosen.mapInArrow(encode, "doc_id long, n long, width int, ids binary"))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by the active-set method."""
    x = np.zeros(a.shape[1])
    passive = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        passive[j] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= 1e-12)
            if not low.any():
                x = s
                break
            step = min(1.0, float(np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))))
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return np.maximum(x, 0)


def combinations(units: int, depth: int, slack: int = 1) -> list[tuple[int, ...]]:
    """Up to `depth` length classes (descending) that sum to units - slack .. units."""
    return [c for d in range(1, depth + 1) for c in itertools.combinations_with_replacement(range(units, 0, -1), d) if units - slack <= sum(c) <= units]


def recipe(histogram: dict[int, int], units: int = 64, depth: int = 3) -> list[tuple[tuple[int, ...], float]]:
    """(combination, uses) by descending uses; histogram: class -> documents."""
    b = np.array([histogram.get(c, 0) for c in range(1, units + 1)], float)
    if not b.any():
        return []
    combos = combinations(units, depth)
    a = np.zeros((units, len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            a[k - 1, j] += 1
    x = nnls(a, b)
    return [(combos[j], float(x[j])) for j in sorted(np.flatnonzero(x > 0), key=lambda j: -x[j])]


def pack_block(lengths: list[int], plan: list[tuple[tuple[int, ...], float]], share: float, window: int = 4096, units: int = 64) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece of a block. share: the block's part of the
    corpus, by remainders."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    by_class: dict[int, list[int]] = {}
    unit = window // units
    for doc, n in enumerate(lengths):
        for k in range(n // window):
            pieces.append((doc, k * window, window, sequences, 0))
            sequences += 1
        if n % window:
            by_class.setdefault(-(-(n % window) // unit), []).append(doc)
    for docs in by_class.values():
        docs.sort(key=lambda d: (lengths[d] % window, d))  # the longest are taken first
    made: list[list[int]] = []
    for combo, uses in plan:
        for _ in range(round(uses * share)):
            if any(len(by_class.get(c, ())) < combo.count(c) for c in set(combo)):
                break
            made.append([by_class[c].pop() for c in combo])
    rest = sorted((d for docs in by_class.values() for d in docs), key=lambda d: (-(lengths[d] % window), d))
    gap = sum(window - sum(lengths[d] % window for d in m) for m in made)
    spare = sum(lengths[d] % window for d in rest)
    while made and spare < gap:  # too little residual to fill the gaps: a combination becomes residual
        m = made.pop()
        size = sum(lengths[d] % window for d in m)
        gap -= window - size
        spare += size
        rest += m
    todo = [(d, lengths[d] - lengths[d] % window, lengths[d] % window) for d in reversed(rest)]

    def fill(sequence: int, offset: int, room: int) -> None:
        while room:
            doc, start, left = todo.pop()
            take = min(left, room)
            pieces.append((doc, start, take, sequence, offset))
            offset += take
            room -= take
            if take < left:
                todo.append((doc, start + take, left - take))

    for m in made:
        offset = 0
        for d in m:
            r = lengths[d] % window
            pieces.append((d, lengths[d] - r, r, sequences, offset))
            offset += r
        fill(sequences, offset, window - offset)
        sequences += 1
    left = sum(x[2] for x in todo)
    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        fill(sequences, 0, size)
        sequences += 1
        left -= size
    return pieces


def pack(tokens: DataFrame, window: int = 4096, units: int = 64, depth: int = 3, block_tokens: int = 8_000_000) -> DataFrame:
    """The pieces of token_ids()' rows."""
    spark = tokens.sparkSession
    unit = window // units
    rest = F.col("n") % window
    rows = tokens.filter(rest > 0).groupBy(F.ceil(rest / unit).alias("c")).count().collect()  # at most `units` rows
    histogram = {int(r["c"]): r["count"] for r in rows}
    total = sum(histogram.values())
    plan = spark.sparkContext.broadcast(recipe(histogram, units, depth))

    def run(batches):
        first = TaskContext.get().partitionId() << 36
        block: list[tuple[int, int, bytes]] = []
        size = 0

        def flush():
            nonlocal first
            lengths = [len(ids) // w for _, w, ids in block]
            share = sum(1 for n in lengths if n % window) / max(total, 1)
            out, top = [], -1
            for doc, start, length, sequence, offset in pack_block(lengths, plan.value, share, window, units):
                key, w, ids = block[doc]
                piece = ids[start * w : (start + length) * w]
                if w == 2:
                    piece = np.frombuffer(piece, "<u2").astype("<u4").tobytes()
                out.append((key, start, length, zlib.crc32(piece), lengths[doc], first + sequence, offset))
                top = max(top, sequence)
            first += top + 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=PIECES_ARROW)

        for batch in parts(batches):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                block.append(row)
                size += len(row[2]) // row[1]
                if size >= block_tokens:
                    yield flush()
                    block, size = [], 0
        if block:
            yield flush()
        block.clear()
        release()

    return tokens.select("doc_id", "width", "ids").mapInArrow(run, PIECES)
