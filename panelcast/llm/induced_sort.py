"""Suffix and common-prefix arrays of a shard by external induced sorting.

A shard is the concatenation of segments, each with a separator that ends every match. Suffixes are of type S
(smaller than the next one) or L (larger). The left-most S suffixes of each run, about a third of all, are the seeds.

1. The strings from one seed to the next are named in order (equal ones alike).
2. Where names repeat, the string of names is sorted in turn: written as two digits a name, so that its alphabet stays
   small, it goes through the same steps, and so on until names differ or few are left, whose ranks are then refined by
   pairs of doubled reach. What comes back is the order of the seeds and how many names neighbours have in common; the
   common prefix in symbols is the distance over those names and what the next, different strings share.
3. From the seeds the L suffixes are induced in one ascending scan, and from these the S suffixes in one descending
   scan: each scanned suffix i puts the tuple (first symbol, i - 1, common prefix with the one before) into a priority
   queue. The common prefix of two suffixes induced one after the other is 1 + the least value between their sources,
   which the scan has at hand; values are cut at `cap`.

The queue is a row of sorted runs that are merged tier by tier, stable, so that within a symbol the order of insertion is
kept. Its runs, and all arrays over the shard or a level of it, lie in memory up to a bound and beyond it in anonymous
files (Space), which end with the task; scans and passes go in batches and blocks. Names are made group by group of first
symbols. A batch is all tuples of a symbol that are known, so the work per suffix is vectorised whatever the data.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np

NONE = 255  # above any common-prefix value
BLOCK = 1 << 20


class Space:
    """Arrays of one sort: in memory up to `memory` bytes in all, beyond that in anonymous files. `spilled` counts bytes."""

    def __init__(self, memory: int):
        self.memory, self.held, self.spilled = memory, 0, 0
        self.sizes: dict[int, int] = {}  # of the arrays in memory, by id

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if self.held + size <= self.memory:
            out = np.empty(n, kind)
            self.held += size
            self.sizes[id(out)] = size
            return out
        self.spilled += size
        with tempfile.TemporaryFile(prefix="panelcast-sort-") as file:
            return np.memmap(file, kind, "w+", shape=(max(n, 1),)).view(np.ndarray)[:n]

    def free(self, array: np.ndarray) -> None:
        """An array of this space isn't used any more."""
        self.held -= self.sizes.pop(id(array), 0)


class TupleQueue:
    """A priority queue of (symbol, position, common prefix) in ascending order of symbols; within one, in order of
    insertion. Runs of a tier are merged into one of the next when there are WAYS; large ones lie on disk."""

    WAYS = 8

    def __init__(self, space: Space):
        self.space = space
        self.tiers: list[list[list]] = [[]]  # runs: [symbols, positions, common, first tuple left], the oldest first

    def push(self, symbols: np.ndarray, positions: np.ndarray, common: np.ndarray) -> None:
        """Tuples that are in order of their symbols."""
        self.tiers[0].append([symbols, positions, common, 0])
        tier = 0
        while len(self.tiers[tier]) >= self.WAYS:
            if tier + 1 == len(self.tiers):
                self.tiers.append([])
            runs = [r for r in self.tiers[tier] if r[3] < len(r[0])]
            if runs:
                self.tiers[tier + 1].append(self._merged(runs))
            for r in self.tiers[tier]:
                for array in r[:3]:
                    self.space.free(array)
            self.tiers[tier] = []
            tier += 1

    def _merged(self, runs: list[list]) -> list:
        parts = [[r[k][r[3] :] for r in runs] for k in range(3)]
        symbols = np.concatenate(parts[0])
        order = np.argsort(symbols, kind="stable")
        out = []
        for k, part in enumerate(parts):
            joined = (symbols if k == 0 else np.concatenate(part))[order]
            if len(joined) >= 4096:  # a large run: counted, and on disk beyond the bound
                kept = self.space.array(len(joined), joined.dtype)
                kept[:] = joined
                joined = kept
            out.append(joined)
        return [*out, 0]

    def pop(self, symbol: int):
        """(positions, common) of all tuples of symbol, the least in the queue; None if there are none."""
        found = []
        for tier in reversed(self.tiers):
            for run in tier:
                s = run[3]
                if s < len(run[0]) and run[0][s] == symbol:
                    e = s + int(np.searchsorted(run[0][s:], symbol, "right"))
                    found.append((run[1][s:e], run[2][s:e]))
                    run[3] = e
        if not found:
            return None
        return found[0] if len(found) == 1 else (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) for each pair, by a table of minima over powers of two."""
    size = hi - lo + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    table = [values]
    for k in range(int(level.max(initial=0))):
        last = table[-1]
        step = last.copy()
        half = 1 << k
        np.minimum(last[:-half], last[half:], out=step[:-half])
        table.append(step)
    flat = np.stack(table) if len(table) > 1 else table[0][None]
    return np.minimum(flat[level, lo], flat[level, hi - (1 << level) + 1])


class _Scan:
    """One inducing scan: batches in order of the suffixes, tuples for their left neighbours out: of type L, or with `down`
    of type S, where symbols are counted from the highest."""

    def __init__(self, text: np.ndarray, small: np.ndarray, symbols: int, cap: int, space: Space, down: bool):
        self.text, self.small, self.cap = text, small, cap
        self.top = symbols - 1 if down else None
        self.queue = TupleQueue(space)
        self.since = np.full(symbols, NONE, np.uint8)  # least value scanned since a symbol's last tuple
        self.begun = np.zeros(symbols, bool)

    def pop(self, symbol: int):
        return self.queue.pop(symbol if self.top is None else self.top - symbol)

    def batch(self, positions: np.ndarray, common: np.ndarray) -> None:
        for at in range(0, len(positions), BLOCK):
            self._batch(np.asarray(positions[at : at + BLOCK]), np.asarray(common[at : at + BLOCK]))

    def _batch(self, positions: np.ndarray, common: np.ndarray) -> None:
        before = positions - 1
        chosen = np.flatnonzero((before >= 0) & (self.small[before] == (self.top is not None)))
        least = int(common.min(initial=NONE))
        if not len(chosen):
            np.minimum(self.since, least, out=self.since)
            return
        source = before[chosen]
        symbol = self.text[source]
        if self.top is not None:
            symbol = (self.top - symbol.astype(np.int32)).astype(self.text.dtype)
        order = np.argsort(symbol, kind="stable")
        at, symbol, source = chosen[order], symbol[order], source[order]
        first = np.empty(len(at), bool)
        first[0] = True
        np.not_equal(symbol[1:], symbol[:-1], out=first[1:])
        lo = np.empty(len(at), np.int64)
        lo[1:] = at[:-1] + 1
        lo[first] = 0
        value = _least(common, lo, at)
        starts = np.flatnonzero(first)
        heads = symbol[starts]
        value[starts] = np.minimum(value[starts], self.since[heads])
        value = np.minimum(value, self.cap - 1) + np.uint8(1)
        value[starts[~self.begun[heads]]] = 0
        np.minimum(self.since, least, out=self.since)
        ends = np.append(starts[1:], len(at))
        tail = np.full(len(common) + 1, NONE, np.uint8)
        tail[:-1] = np.minimum.accumulate(common[::-1])[::-1]
        self.since[heads] = tail[at[ends - 1] + 1]
        self.begun[heads] = True
        self.queue.push(symbol, source, value)


def _types(text: np.ndarray, cap: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(whether a suffix is of type S, how often its first symbol repeats there, cut at cap), from the end in blocks. The last
    symbol is the least of all."""
    n = len(text) - PAD
    small, run = space.array(n, bool), space.array(n, np.uint8)
    small[n - 1], run[n - 1] = True, 1
    end = n - 1
    while end > 0:
        s = max(0, end - BLOCK)
        part = np.asarray(text[s : end + 1]).astype(np.int32)
        here = np.arange(end - s)
        turn = np.where(part[1:] != part[:-1], here, end - s)
        turn = np.minimum.accumulate(turn[::-1])[::-1]
        inside = turn < end - s
        up = np.append(part[1:] > part[:-1], False)
        small[s:end] = np.where(inside, up[turn], small[end])
        run[s:end] = np.minimum(np.where(inside, turn - here + 1, end - s - here + int(run[end])), cap)
        end = s
    return small, run


def _seeds(small: np.ndarray, place, space: Space) -> np.ndarray:
    """Positions of S suffixes after an L one."""
    spots = []
    for s in range(0, len(small) - 1, BLOCK):
        part = np.asarray(small[s : s + BLOCK + 1])
        spots.append((np.flatnonzero(part[1:] & ~part[:-1]) + (s + 1)).astype(place))
    out = space.array(sum(map(len, spots)), place)
    at = 0
    for part in spots:
        out[at : at + len(part)] = part
        at += len(part)
    return out


def _rank(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank: first place of its group in order, size of its group) of each item."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), bool)
    new[:1] = True
    ordered = keys[order]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    rank[order] = starts[group]
    size[order] = np.diff(np.append(starts, len(keys)))[group]
    return rank, size


def _refine(rank: np.ndarray, items: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rank the items (whole groups) of equal rank by keys, in place; the items whose group still has others."""
    old = rank[items].astype(np.int64)
    if keys.dtype == np.int64:  # a rank: both fit into one number
        order = np.argsort(old * np.int64(len(rank) + 2) + (keys + 1))
    else:
        order = np.lexsort((keys, old))
    old, keys, items = old[order], keys[order], items[order]
    group = np.empty(len(items), bool)
    group[0] = True
    np.not_equal(old[1:], old[:-1], out=group[1:])
    part = group.copy()
    part[1:] |= keys[1:] != keys[:-1]
    here = np.arange(len(items))
    group_at = np.maximum.accumulate(np.where(group, here, 0))
    part_at = np.maximum.accumulate(np.where(part, here, 0))
    rank[items] = old + (part_at - group_at)
    starts = np.flatnonzero(part)
    alone = np.diff(np.append(starts, len(items))) == 1
    return items[~alone[np.cumsum(part) - 1]]


def _named(text: np.ndarray, seeds: np.ndarray, separators: bool, space: Space, group: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of the string from each seed to the next (both included): the number of seeds with smaller ones; and how many
    seeds have each name. Strings are
    taken in groups of first symbols with up to `group` seeds, where a symbol has no more."""
    n = len(seeds)
    names, uses = space.array(n, seeds.dtype), space.array(n, seeds.dtype)
    top = int(text.max()) + 1
    firsts = space.array(n, text.dtype)
    counts = np.zeros(top, np.int64)
    for s in range(0, n, BLOCK):
        firsts[s : s + BLOCK] = text[seeds[s : s + BLOCK]]
        counts += np.bincount(firsts[s : s + BLOCK], minlength=top)
    wide = 16 if top > 511 else 9
    reach, beyond = 63 // wide, (1 << wide) - 1  # symbols in a key; beyond a string's end is highest: the longer one is smaller

    def key(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(reach):
            symbol = text[np.minimum(at + k, len(text) - 1)].astype(np.uint64)
            symbol[left <= k] = beyond
            out = out << np.uint64(wide) | symbol
        return out

    symbol, below = 0, 0
    while symbol < top:
        last, held = symbol, int(counts[symbol])
        while last + 1 < top and held + counts[last + 1] <= group:
            last += 1
            held += int(counts[last])
        if held:
            spots = []
            for s in range(0, n, BLOCK):
                part = firsts[s : s + BLOCK]
                spots.append(np.flatnonzero((part >= symbol) & (part <= last)) + s)
            spots = np.concatenate(spots)
            starts = np.asarray(seeds[spots]).astype(np.int64)
            size = np.where(spots + 1 < n, seeds[np.minimum(spots + 1, n - 1)].astype(np.int64) - starts + 1, 1)
            rank, group_size = _rank(key(starts, size))
            items, skip = np.flatnonzero((group_size > 1) & (size >= reach)), reach  # one that ends here has an equal part only
            while len(items):
                items = _refine(rank, items, key(starts[items] + skip, size[items] - skip))
                skip += reach
                items = items[size[items] >= skip]
            if separators and symbol <= 1 <= last:  # each is a symbol of its own, in order of the text
                at = np.flatnonzero(firsts[spots] == 1)
                if len(at):
                    rank[at] = rank[at].min() + np.arange(len(at))
            names[spots] = rank + below
            uses[below : below + held] = np.bincount(rank, minlength=held)
            below += held
        symbol = last + 1
    space.free(firsts)
    return names, uses


PAD = 8  # symbols after the end of a text, so that words can be read there


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b of a padded text, cut at most, eight bytes at a time."""
    wide = text.itemsize
    words = np.ndarray((len(text) - 8 // wide + 1,), "<u8", text, strides=(wide,))
    out = np.zeros(len(a), np.int64)
    active = np.flatnonzero(most > 0)
    skip = 0
    while len(active):
        x = words[a[active] + skip] ^ words[b[active] + skip]
        same = x == 0
        bits = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
        out[active] = np.minimum(skip + np.where(same, 8 // wide, bits // (8 * wide)), most[active])
        skip += 8 // wide
        active = active[same & (most[active] > skip)]
    return out


def _sorted_seeds(text: np.ndarray, seeds: np.ndarray, separators: bool, cap: int, space: Space, few: int, limit: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(the seeds in order of their suffixes, common prefix of each with the one before). limit(positions) tells how far a
    match may go from there."""
    n = len(seeds)
    names, uses = _named(text, seeds, separators, space, max(few, space.memory // 64))
    order = space.array(n, seeds.dtype)
    same = space.array(n, np.uint8)  # names in common with the one before
    same[:] = 0
    repeat = any(bool((uses[s : s + BLOCK] > 1).any()) for s in range(0, n, BLOCK))
    if not repeat or n <= few:
        rank = names.astype(np.int64)
        items, step = np.flatnonzero(uses[names] > 1) if repeat else np.zeros(0, np.int64), 1
        while len(items):
            beyond = items + step
            items = _refine(rank, items, np.where(beyond < n, rank[np.minimum(beyond, n - 1)], np.int64(-1)))
            step *= 2
        order[rank] = np.arange(n, dtype=seeds.dtype)  # what these have in common is compared below
    else:
        # two digits a name; the least symbols stay free
        kinds = 0
        for s in range(0, n, BLOCK):
            there = uses[s : s + BLOCK] > 0
            number = np.cumsum(there) - 1 + kinds
            kinds = int(number[-1]) + 1
            uses[s : s + BLOCK] = number  # of the different names, in order
        bits = (max(1, (kinds - 1).bit_length()) + 1) // 2
        digits = space.array(2 * n + 1 + PAD, np.uint16 if bits < 15 else np.uint32)
        for s in range(0, n, BLOCK):
            part = uses[names[s : s + BLOCK]]
            digits[2 * s : 2 * (s + len(part)) : 2] = (part >> bits) + 2
            digits[2 * s + 1 : 2 * (s + len(part)) : 2] = (part & (1 << bits) - 1) + 2
        digits[2 * n :] = 0
        space.free(names)
        space.free(uses)
        names = uses = None
        at, low = n, NONE  # filled from the highest

        def visit(positions: np.ndarray, values: np.ndarray) -> None:
            """Suffixes of the digits in descending order, each with its common prefix with the next smaller one."""
            nonlocal at, low
            if not len(positions):
                return
            whole = np.flatnonzero(positions % 2 == 0)
            # the least value from one name's suffix down to before the next one's
            if len(whole) == 0:
                low = min(low, int(values.min()))
                return
            first = whole[0]
            if first and at < n:
                low = min(low, int(values[:first].min()))
            if at < n:
                same[at] = low >> 1
            least = np.minimum.reduceat(values, whole)
            k = len(whole)
            order[at - k : at] = (positions[whole] // 2)[::-1]
            same[at - k : at] = (least >> 1)[::-1]
            low = int(least[-1])
            at -= k

        _induced(digits, (1 << bits) + 2, False, cap, space, few, visit, lambda p: np.full(len(p), cap))
        same[0] = 0
        space.free(digits)
        del digits
    # names in common to symbols: the distance over them, and what the strings that differ share
    out, common = space.array(n, seeds.dtype), space.array(n, np.uint8)
    last, room = n - 1, 0
    for s in range(0, n, BLOCK):
        here = np.asarray(order[s : s + BLOCK]).astype(np.int64)
        out[s : s + BLOCK] = seeds[here]
        before = np.asarray(order[max(s - 1, 0) : s + len(here) - 1]).astype(np.int64)
        if s == 0:
            before = np.append(here[:1], before)
        q = np.asarray(same[s : s + BLOCK]).astype(np.int64)
        x, y = seeds[before].astype(np.int64), seeds[here].astype(np.int64)
        ex, ey = np.minimum(before + q, last), np.minimum(here + q, last)
        skip = seeds[ey].astype(np.int64) - y
        ahead = np.minimum(limit(y), cap)
        most = np.minimum(np.append(room, ahead[:-1]), ahead)
        room = ahead[-1]
        rest = np.maximum(most - skip, 0)
        value = np.minimum(skip + _shared(text, seeds[ex].astype(np.int64), seeds[ey].astype(np.int64), rest), most)
        common[s : s + BLOCK] = np.maximum(value, 0)
    if n:
        common[0] = 0
    for array in (order, same, names, uses):
        space.free(array)
    return out, common


def _induced(text: np.ndarray, symbols: int, separators: bool, cap: int, space: Space, few: int, visit: Callable, limit: Callable) -> None:
    """Of a text with PAD symbols after its end: hands all suffixes to visit(positions, values) in descending order, in parts, each with its common prefix with the
    next smaller suffix, cut at cap."""
    n = len(text) - PAD
    place = np.int32 if n < 2**31 - 16 else np.int64
    small, run = _types(text, cap, space)
    seeds = _seeds(small, place, space)
    ordered, common = _sorted_seeds(text, seeds, separators, cap, space, few, limit)
    space.free(seeds)
    del seeds

    def joint(lower: int, upper: int, symbol: int) -> int:
        """Common prefix of the largest L and the smallest S suffix of a symbol: their runs of it."""
        return 0 if separators and symbol <= 1 else int(min(run[lower], run[upper]))

    # ascending scan: L suffixes, kept in order of symbols
    bounds = np.zeros(symbols + 1, np.int64)
    for s in range(0, len(ordered), BLOCK):
        bounds[1:] += np.bincount(text[ordered[s : s + BLOCK]], minlength=symbols)
    bounds = np.cumsum(bounds)
    n_large = n - sum(int(small[s : s + BLOCK].sum()) for s in range(0, n, BLOCK))
    low_at, low_common = space.array(n_large, place), space.array(n_large, np.uint8)
    ends = np.zeros(symbols + 1, np.int64)
    scan = _Scan(text, small, symbols, cap, space, False)
    at = 0
    for symbol in range(symbols):
        begin = at
        while (got := scan.pop(symbol)) is not None:
            low_at[at : at + len(got[0])], low_common[at : at + len(got[0])] = got
            at += len(got[0])
            scan.batch(*got)
        ends[symbol + 1] = at
        s, e = int(bounds[symbol]), int(bounds[symbol + 1])
        if e > s:
            values = np.array(common[s:e])
            values[0] = joint(low_at[at - 1], ordered[s], symbol) if at > begin else 0
            scan.batch(ordered[s:e], values)
    space.free(ordered)
    space.free(common)
    del ordered, common

    # descending scan: S suffixes
    scan = _Scan(text, small, symbols, cap, space, True)
    for symbol in range(symbols - 1, -1, -1):
        s, e = int(ends[symbol]), int(ends[symbol + 1])
        bottom = None  # the smallest S suffix so far, which waits for its value
        while (got := scan.pop(symbol)) is not None:
            positions, values = got
            # a value is that with the next larger suffix of the symbol: it goes to the one before
            if bottom is not None:
                visit(bottom, values[:1])
            visit(positions[:-1], values[1:])
            bottom = positions[-1:]
            scan.batch(positions, values)
        if bottom is not None:
            visit(bottom, np.array([joint(low_at[e - 1], bottom[0], symbol) if e > s else 0], np.uint8))
        for hi in range(e, s, -BLOCK):
            lo = max(s, hi - BLOCK)
            positions, values = np.asarray(low_at[lo:hi])[::-1], np.asarray(low_common[lo:hi])[::-1]
            visit(positions, values)
            turned = np.empty(len(values), np.uint8)
            turned[1:] = values[:-1]
            if hi == e:
                turned[0] = joint(low_at[e - 1], bottom[0], symbol) if bottom is not None else 0
            else:
                turned[0] = low_common[hi]
            scan.batch(positions, turned)
    for array in (low_at, low_common, small, run):
        space.free(array)


def repeated(segments: list[bytes], length: int = 200, memory: int = 32_000_000, few: int = 1 << 20, stats: dict | None = None) -> list[np.ndarray]:
    """For each segment, the starts of its substrings of `length` bytes (at most 250) that start elsewhere, too, in any
    segment. Arrays beyond `memory` bytes lie on disk; strings of up to `few` names are ranked without going on to
    recurse. stats gets the bytes that were on disk."""
    space = Space(memory)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    total = int(sizes.sum()) + len(segments) + 1
    ends = np.cumsum(sizes + 1) - 1  # of the separators
    text = space.array(total + PAD, np.uint16)
    at = 0
    for s in segments:
        np.add(np.frombuffer(s, np.uint8), np.uint16(2), out=text[at : at + len(s)], dtype=np.uint16)
        text[at + len(s)] = 1
        at += len(s) + 1
    text[total - 1 :] = 0
    flagged = None
    waits = False  # whether the last suffix is like the one that comes

    def visit(positions: np.ndarray, values: np.ndarray) -> None:
        nonlocal flagged, waits
        if not len(positions):
            return
        if flagged is None:
            flagged = space.array(total, bool)
            flagged[:] = False
        if waits:
            flagged[positions[0]] = True
        hits = values >= length
        flagged[positions[hits]] = True
        flagged[positions[1:][hits[:-1]]] = True
        waits = bool(hits[-1])

    def limit(positions: np.ndarray) -> np.ndarray:
        return np.maximum(ends[np.minimum(np.searchsorted(ends, positions), len(ends) - 1)] - positions, 0)

    _induced(text, 258, True, length, space, few, visit, limit)
    if stats is not None:
        stats["spilled"] = stats.get("spilled", 0) + space.spilled
    starts = ends - sizes
    return [np.flatnonzero(flagged[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
