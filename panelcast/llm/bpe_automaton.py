"""Byte-level BPE encoding and decoding by a deterministic automaton (operator 2).

The automaton over tokens starts as one state with a loop for every byte. Each merge (u, v) -> t, in rank order, puts
in a merge gadget:

* every arc labelled u is led to a copy of its target that lacks the arc v (u v in a row is not allowed now);
* every state that has an arc u gets an arc t, to where v led from there.

A merge whose u v is no path by then can never be made and gets no gadget. The paths of the final automaton are
exactly the token sequences that the merges produce, so a word has one path, and so has each of its prefixes. States are
numbers; written out, 50,000 of them with some 10,000 arcs each would not fit in memory. Whether the state after u has
an arc x follows from the gadgets: one for (a, b) has taken it if a is u, or a last part of u that was not yet merged
into the next larger one when the gadget came, and b likewise a first part of x (at the same merge, too).

Encoding is by the deterministic automaton over bytes that follows from it: its states are the sets of (place in the
tree of labels, state over tokens) of all labels that are under way, and a transition gives the one label that ends
the path of the prefix read so far. Transitions are made when first met and kept in a table of bounded size. One pass
over the bytes of a pre-split word, one look-up each, and the labels are read off from the end: no search, no way
back. Decoding emits the labels of the arcs.

Defined results: null texts count as empty (no ids); text equal to a special token becomes its id, as the
library does; a repeated row gives a repeated result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from panelcast.llm.common import Memo, arrow_map

#: Fixed value: the published pre-split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that vocabulary files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Key of a row's own state: (place in the tree of labels, state over tokens) of every label under way.
ITEMS = -1


class Automaton:
    """Compiled from pairs of byte strings in rank order. vocab: byte string -> id; special: string -> id."""

    def __init__(self, merges: list[tuple[bytes, bytes]], vocab: dict[bytes, int], special: dict[str, int] | None = None, table: int = 400_000):
        self.special = special or {}
        self.label = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.made: dict[int, int] = {}  # token -> merge that made it
        self.left: dict[int, int] = {}  # token -> its left part
        self.right: dict[int, int] = {}
        self.gadget: dict[int, int] = {}  # left part << 32 | right part -> merge
        self.state = {vocab[bytes([b])]: 0 for b in range(256) if bytes([b]) in vocab}
        self.after = [(-1, 0)]  # state -> (token that led there first, merge after the one that made it)
        for m, (a, b) in enumerate(merges):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            if u not in self.state or v not in self.state or not self.has(self.state[u], v):
                continue  # u v is no path: this merge is never made
            self.made[t], self.left[t], self.right[t] = m, u, v
            self.gadget[u << 32 | v] = m
            target = self.state[v]
            self.state[u] = len(self.after)  # a copy of the state that u led to, without the arc v
            self.after.append((u, m + 1))
            self.state[t] = target
        # the tree of the labels that are on some path: (place << 8 | byte) -> place
        self.tree: dict[int, int] = {}
        self.ends: dict[int, int] = {}  # place -> token
        self.size = {t: len(self.label[t]) for t in self.state}
        places = 1
        for t in self.state:
            at = 0
            for byte in self.label[t]:
                below = self.tree.get(at << 8 | byte)
                if below is None:
                    below = self.tree[at << 8 | byte] = places
                    places += 1
                at = below
            self.ends[at] = t
        self.most = table
        self._restart()

    def _restart(self) -> None:
        """An empty table. Rows of the old one stay valid where they are in use."""
        self.held = 0
        self.start: dict = {ITEMS: ((0, 0),)}
        self.rows: dict[tuple, dict] = {self.start[ITEMS]: self.start}

    def has(self, state: int, token: int) -> bool:
        """Whether the state over tokens has an arc labelled token."""
        if not state:
            return True
        gadget, made, left, right = self.gadget.get, self.made.get, self.left.get, self.right.get
        a, before = self.after[state]
        while a is not None:
            b, upto = token, 1 << 60
            while b is not None:
                m = gadget(a << 32 | b)
                if m is not None and m < before and m <= upto:
                    return False
                upto, b = made(b), left(b)
            before, a = made(a), right(a)
        return True

    def transition(self, row: dict, byte: int) -> tuple[dict, int]:
        """(row of the next state, label that ends the path here) of the automaton over bytes; kept in the row."""
        items, token = [], None
        for at, q in row[ITEMS]:
            below = self.tree.get(at << 8 | byte)
            if below is not None:
                items.append((below, q))
                if token is None and (t := self.ends.get(below)) is not None and self.has(q, t):
                    token = t
        if token is None:
            raise ValueError(f"no label for byte {byte}")
        items = (*items, (0, self.state[token]))
        if self.held >= self.most:
            self._restart()
        after = self.rows.get(items)
        if after is None:
            after = self.rows[items] = {ITEMS: items}
        self.held += 1
        row[byte] = step = after, token
        return step

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path through word."""
        row, ends = self.start, []
        for byte in word:
            row, token = row.get(byte) or self.transition(row, byte)
            ends.append(token)
        at, path, size = len(word), [], self.size
        while at:
            token = ends[at - 1]
            path.append(token)
            at -= size[token]
        path.reverse()
        return path

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        out = array("I")
        for packed in self.pieces(text):
            out.frombytes(packed)
        return out.tolist()

    def ready(self) -> Automaton:
        """With what one worker needs: the pattern and a bounded table of words seen."""
        pack = lambda word: array("I", self.encode_word(word.encode())).tobytes()
        self._find = find = regex.compile(SPLIT).findall

        def run(chunk: str) -> bytes:
            """A run of text between single spaces pre-splits alike wherever it stands; its parts are runs as well."""
            if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                return pack(chunk)
            parts = find(chunk)
            return pack(chunk) if len(parts) == 1 else b"".join(map(self._chunk.__getitem__, parts))

        self._chunk = Memo(run, 600_000)
        self._double = regex.compile(r"\s\s|^\s|\s$").search
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        return self

    def pieces(self, text: str):
        """Packed little-endian ids, part by part."""
        if self._special is not None and any(s in text for s in self.special):
            for part in self._special.split(text):
                if part in self.special:
                    yield array("I", [self.special[part]]).tobytes()
                elif part:
                    yield from self._plain(part)
        else:
            yield from self._plain(text)

    def _plain(self, text: str):
        if self._double(text):
            yield from map(self._chunk.__getitem__, self._find(text))
        elif text:
            first, *rest = text.split(" ")
            yield self._chunk[first]
            yield from map(self._chunk.__getitem__, [" " + x for x in rest])

    def decode(self, ids) -> str:
        """The labels of the arcs, as text; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


def compile_json(content: str) -> Automaton:
    """From the content of a byte-level BPE file of the tokenizers library."""
    model = json.loads(content)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    vocab = {raw(s): i for s, i in model["model"]["vocab"].items() if s not in special}
    return Automaton([(raw(a), raw(b)) for a, b in merges], vocab, special).ready()


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_KEPT: dict[int, Automaton] = {}


def _worker(content) -> Automaton:
    """One automaton a Python worker, compiled when first used."""
    key = content.value.__hash__()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = compile_json(content.value)
    return _KEPT[key]


def encode(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids (packed little-endian unsigned 32-bit) and the decoded text of each row; with digests, their SHA-256
    instead. path: the vocabulary file, read on the driver; its content (some MB, fixed) is broadcast."""
    with open(path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())

    def rows(columns):
        automaton = _worker(content)
        label = automaton.label
        gc.disable()  # the tables are long-lived and hold no garbage: looking through them again and again took a quarter
        for key, text in zip(*columns):
            ids = b"".join(automaton.pieces(text or ""))
            back = b"".join(map(label.__getitem__, memoryview(ids).cast("I")))
            try:
                back.decode()
            except UnicodeDecodeError:
                back = back.decode("utf-8", "replace").encode()
            if digests:
                yield key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
            else:
                yield key, len(ids) // 4, ids, back.decode()
        gc.enable()

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    if digests:
        return chosen.mapInArrow(arrow_map(rows, DIGESTS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return chosen.mapInArrow(arrow_map(rows, SCHEMA), "doc_id long, n_tokens long, ids binary, decoded string")
