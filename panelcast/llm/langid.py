"""Language identification by a bidirectional gated recurrent network over bytes (operator 1).

Two gated recurrent layers read a text's UTF-8 bytes from left to right and from right to left; a linear layer
over both states labels every byte position with language probabilities, and a document's probabilities are their
mean. The network is trained here, in numpy, by backpropagation through time.

Training takes a bounded sample: at most `per_language` passages of `passage` characters for each language (the
one with the smallest hash in each of per_language buckets of documents). Everything else covers whole texts: they
are read in windows of `window` bytes that overlap by `context` on both sides, whose positions only serve to warm
the states up, so each byte is labelled once and a long text is no harder than many short ones.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the first language by name;
repeated rows get the same result; a row without an id isn't held out; an empty table gives an empty result; where no row
is labelled (or the table is empty) train raises and trained gives a network that finds `und` with score 0 everywhere;
columns that have the results' names are replaced, other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import appended

UND = "und"
_LETTER = regex.compile(r"\p{L}").search


class BiGRU:
    """One gated recurrent unit layer each way. Weights by name; index 0 forward, 1 backward."""

    def __init__(self, classes: list[str], hidden: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, k = hidden, len(classes)
        self.classes, self.hidden = classes, h
        self.w = {
            "x": (rng.standard_normal((2, 256, 3 * h)) * 0.3).astype(np.float32),  # a row for each byte, bias included
            "u": (rng.standard_normal((2, h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "o": (rng.standard_normal((2, h, k)) / np.sqrt(h)).astype(np.float32),
            "b": np.zeros(k, np.float32),
        }
        # gates are tanh(a / 2) / 2 + 1 / 2: one tanh serves both

    def scan(self, data: np.ndarray, sizes: np.ndarray, side: int, keep: bool = False):
        """Contributions to the logits (steps, lanes, classes) of one direction over data (lanes, steps), of which a
        lane's first `size` bytes are its own: the state is zero beyond them. With keep, also what backpropagation
        needs."""
        h = self.hidden
        x, u, o = self.w["x"][side], self.w["u"][side], self.w["o"][side]
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * h]) * u.dtype.type(0.5), np.ascontiguousarray(u[:, 2 * h :])
        x_gates, x_new = np.ascontiguousarray(x[:, : 2 * h]) * u.dtype.type(0.5), np.ascontiguousarray(x[:, 2 * h :])
        lanes, steps = data.shape
        columns = np.ascontiguousarray(data.T)
        state = np.zeros((lanes, h), u.dtype)
        out = np.empty((steps, lanes, o.shape[1]), u.dtype)
        tape = []
        order = range(steps) if side == 0 else range(steps - 1, -1, -1)
        half = u.dtype.type(0.5)
        shortest = int(sizes.min())
        for t in order:
            byte = columns[t]
            gates = state @ u_gates
            gates += x_gates.take(byte, axis=0)
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            z, r = gates[:, :h], gates[:, h:]
            p = state @ u_new
            new = r * p
            new += x_new.take(byte, axis=0)
            np.tanh(new, out=new)
            if keep:
                tape.append((t, byte, state, z, r, p, new))
            state = new + z * (state - new)
            if t >= shortest:
                state[sizes <= t] = 0
            np.dot(state, o, out=out[t])
        return (out, tape) if keep else out

    def probabilities(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Softmax at each position: (steps, lanes, classes)."""
        logits = self.scan(data, sizes, 0)
        logits += self.scan(data, sizes, 1)
        logits += self.w["b"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, sizes: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the lanes' own positions, and its gradients."""
        h = self.hidden
        mask = np.arange(data.shape[1]) < sizes[:, None]
        runs = [self.scan(data, sizes, side, keep=True) for side in (0, 1)]
        logits = runs[0][0] + runs[1][0] + self.w["b"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        prob = e / e.sum(axis=2, keepdims=True)
        weight = mask.T[:, :, None] / prob.dtype.type(max(mask.sum(), 1))
        lanes = np.arange(len(target))
        loss = float(-(np.log(prob[:, lanes, target] + 1e-9) * weight[:, :, 0]).sum())
        delta = prob * weight
        delta[:, lanes, target] -= weight[:, :, 0]
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["b"] += delta.sum(axis=(0, 1))
        for side, (_, tape) in enumerate(runs):
            u, o = self.w["u"][side], self.w["o"][side]
            back = np.zeros((len(target), h), u.dtype)
            for t, byte, state, z, r, p, new in reversed(tape):
                ended = sizes <= t
                after = new + z * (state - new)
                after[ended] = 0
                grads["o"][side] += after.T @ delta[t]
                back += delta[t] @ o.T
                back[ended] = 0
                d_new = back * (1 - z) * (1 - new * new)
                d_z = back * (state - new) * z * (1 - z)
                d_r = d_new * p * r * (1 - r)
                d_p = d_new * r
                d_in = np.concatenate((d_z, d_r, d_new), axis=1)
                d_rec = np.concatenate((d_z, d_r, d_p), axis=1)
                np.add.at(grads["x"][side], byte, d_in)
                grads["u"][side] += state.T @ d_rec
                back = back * z + d_rec @ u.T
        return loss, grads

    def fit(self, texts: list[bytes], labels: list[str], steps: int = 500, batch: int = 128, length: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random spans of `length` bytes, classes in turn; the losses."""
        rng = np.random.default_rng(seed)
        groups = [[t for t, x in zip(texts, labels) if x == c and t] for c in self.classes]
        present = [k for k, g in enumerate(groups) if g]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            data, sizes, target = np.zeros((batch, length), np.uint8), np.empty(batch, np.int64), np.empty(batch, np.int64)
            for lane in range(batch):
                k = present[lane % len(present)]
                text = groups[k][rng.integers(len(groups[k]))]
                at = int(rng.integers(max(1, len(text) - length + 1)))
                span = np.frombuffer(text[at : at + length], np.uint8)
                data[lane, : len(span)], sizes[lane], target[lane] = span, len(span), k
            loss, grads = self.gradients(data, sizes, target)
            losses.append(loss)
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
            for k, g in grads.items():
                g = g / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                self.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def pooled(self, texts: list[bytes], window: int = 512, context: int = 16, lanes: int = 2048) -> np.ndarray:
        """Mean of the position probabilities of each text (texts, classes). Every byte counts once."""
        core = window - 2 * context
        spans = [(d, max(0, s - context), s, min(s + core, len(t)), min(len(t), s + core + context)) for d, t in enumerate(texts) for s in range(0, len(t), core)]
        spans.sort(key=lambda x: x[4] - x[1])
        sums = np.zeros((len(texts), len(self.classes)))
        for k in range(0, len(spans), lanes):
            part = spans[k : k + lanes]
            steps = part[-1][4] - part[-1][1]
            data, mask = np.zeros((len(part), steps), np.uint8), np.zeros((len(part), steps), np.float32)
            for lane, (d, lo, s, e, hi) in enumerate(part):
                data[lane, : hi - lo] = np.frombuffer(texts[d], np.uint8, hi - lo, lo)
                mask[lane, s - lo : e - lo] = 1
            sizes = np.array([hi - lo for _, lo, _, _, hi in part])
            total = np.einsum("slk,ls->lk", self.probabilities(data, sizes), mask)
            np.add.at(sums, [x[0] for x in part], total)
        return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class NothingToLearn(ValueError):
    """No row is labelled, not held out and has a letter."""


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 512, passage: int = 256, hidden: int = 8, **fit) -> BiGRU:
    """A network from a bounded sample of the rows that aren't held out and have a label and a letter."""
    spot = F.xxhash64(F.col(id_col).cast("string"))
    length = F.length(text_col)
    start = F.pmod(F.shiftright(spot, 20), F.greatest(length - passage + 1, F.lit(1))) + 1
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    cut_out = rows.select(F.col(label_col).alias("lang"), F.pmod(spot, F.lit(per_language)).alias("k"), spot.alias("h"), F.substring(F.col(text_col), start.cast("int"), F.lit(passage)).alias("t"))
    sample = sorted((r.lang, r.k, r.t) for r in cut_out.groupBy("lang", "k").agg(F.min_by("t", F.struct("h", "t")).alias("t")).collect())
    if not sample:
        raise NothingToLearn("no labelled text to learn from")
    network = BiGRU(sorted({lang for lang, _, _ in sample}), hidden)
    network.fit([t.encode() for _, _, t in sample], [lang for lang, _, _ in sample], **fit)
    return network


def trained(docs: DataFrame, hidden: int = 8, **options) -> BiGRU:
    """As train; where there is nothing to learn from, a network without classes, whose predictions are und with score 0."""
    try:
        return train(docs, hidden=hidden, **options)
    except NothingToLearn:
        return BiGRU([], hidden)


def predicted(docs: DataFrame, network: BiGRU, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred and score, each named with prefix. The weights are broadcast (some hundred KB, fixed)."""
    model = docs.sparkSession.sparkContext.broadcast((network.classes, network.hidden, network.w))

    def rows(texts):
        classes, hidden, weights = model.value
        if not classes:
            return [[UND] * len(texts), [0.0] * len(texts)]
        net = BiGRU(classes, hidden)
        net.w = weights
        langs, scores = [], []
        for k in range(0, len(texts), 2000):
            part = texts[k : k + 2000]
            letters = [bool(t and _LETTER(t)) for t in part]
            share = net.pooled([t.encode() if ok else b"" for t, ok in zip(part, letters)])
            best = share.argmax(axis=1)
            langs += [classes[b] if ok else UND for b, ok in zip(best.tolist(), letters)]
            scores += [min(1.0, max(0.0, round(float(s[b]), 5))) if ok else 0.0 for s, b, ok in zip(share, best, letters)]
        return [langs, scores]

    return appended(docs, [text_col], rows, [(prefix + "lang_pred", "string", pa.string()), (prefix + "score", "double", pa.float64())])
