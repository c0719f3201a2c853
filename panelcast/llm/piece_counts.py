"""Token counts by byte-pair merging with a heap and a linked list (operator 9).

A segment's characters are the nodes of a doubly linked list; a heap holds the adjacent pairs whose
concatenation is a piece, by rank (the better score first, then the left one). The lowest pair is popped again
and again; a stale entry is skipped, a live one unlinks its right node and offers the two new neighbours. The
count is initial symbols minus merges; no identifiers are made. A character that is no piece counts one symbol
for each UTF-8 byte (byte fallback), and never merges.

Text goes in as the library takes it: a space becomes the mark U+2581, one mark goes before a text that isn't
empty, nothing else is changed. No piece holds a mark after another character (checked on loading), so a text
falls into segments, each of marks and what follows up to the next mark, that merge alone.

Defined results: null and empty texts have 0 tokens; strings that look like special tokens are plain text, as
the library's default has it; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from panelcast.llm.common import Memo, arrow_map

MARK = "▁"


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            if key & 7 == 2:
                size, i = varint(i)
            else:
                size = 4 if key & 7 == 5 else 8
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Counter:
    """From the content of a sentencepiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, model: bytes, memo: int = 250_000):
        scores: dict[str, float] = {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                if piece.get(3, 1) in (1, 4, 5):  # normal, user-defined, unused
                    scores[piece[1].decode()] = struct.unpack("<f", piece.get(2, bytes(4)))[0]
            elif number == 3 and dict(fields(value)).get(2):
                raise ValueError("only the identity normaliser is supported")
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece holds a mark after another character")
        self.memo = Memo(self.segment, memo)
        self._segments = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def segment(self, text: str) -> int:
        """Initial symbols minus merges."""
        rank = self.rank
        n = len(text)
        count = sum(1 if c in rank else len(c.encode()) for c in text)
        if text in rank and n <= 2:
            return 1
        part: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[p], i, i + 1, p) for i in range(n - 1) if (p := text[i : i + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if part[i] is None or part[j] is None or after[i] != j or part[i] + part[j] != whole:
                continue
            count -= 1
            part[i], part[j] = whole, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := whole + part[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, k, p))
            h = before[i]
            if h >= 0 and (p := part[h] + whole) in rank:
                heapq.heappush(heap, (rank[p], h, i, p))
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return sum(map(self.memo.__getitem__, self._segments(MARK + text.replace(" ", MARK))))
        return sum(map(self.memo.__getitem__, (MARK + text.replace(" ", " " + MARK)).split(" ")))


_KEPT: dict[int, Counter] = {}


def _worker(content) -> Counter:
    key = hash(content.value)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Counter(content.value)
    return _KEPT[key]


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row. path: the model file, read on the
    driver; its content (half a MB, fixed) is broadcast."""
    with open(path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())

    def rows(columns):
        counter = _worker(content)
        for key, text in zip(*columns):
            n = counter.count(text or "")
            yield key, len((text or "").encode()), n, n > limit

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(arrow_map(rows, schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
