"""Which texts may hold which passages nearly, by the sums of a table of short runs of characters; none that does is missed.

A window of a text that is like a passage is made of it by few edits, and each part of the window by
its share of them. So texts are cut into units, words or parts of words, and for each unit the least
edits are looked up that make it of any part of a passage. They repeat throughout the texts, so that
they are computed once; what remains for a text is to sum them. A window is no longer than its passage,
so that no more of its characters are without a partner than of the passage's: its own may count threefold,
and the sum of both is still within twice the limit. Among texts that only share their syllables it is
much larger.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Characters of a unit, of parts of a rare one, of parts of a rare part, and of a cell, in which units are summed.
UNIT, PARTS, CELL = 9, (5, 3), 8
#: Passages and units that are compared at once, characters of a stretch and of texts that are summed at once, bytes of the tables of units.
COLUMNS, UNITS, STRETCH, SUMMED, TABLE = 256, 256, 1 << 16, 1 << 17, 1 << 26
#: Units that have a row in the tables at most, how often one must occur in the texts by which they are chosen, and bytes of these of a partition.
MOST, OFTEN, CHOSEN = 300_000, 4, 1 << 22
#: Costs of a unit's character that a passage lacks, and of a passage's character between those of a unit.
LACKED, PASSED = 3, 1
#: Bits of a bit vector, words of state that are scanned together, classes of characters.
WORD, STATE, CLASSES = 32, 32_768, 3
CUT = re.compile(rf"\S{{1,{UNIT - 1}}}\s?|\s").findall


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def whole_cells(size):
    """Cells that lie wholly, with all of their units, within any window of a size."""
    return (size - UNIT + 2 - CELL) // CELL


def screened(passage: str) -> bool:
    """Whether half of a passage's length or more is in whole cells; shorter ones are not worth it."""
    return 2 * CELL * whole_cells(len(passage)) >= len(passage)


def unit_counts(texts: Iterable[str | None]) -> Counter:
    """Units that occur more than once, and parts of the others that do, with their numbers."""
    counts, parts = Counter(), Counter()
    for text in texts:
        counts.update(CUT(text or ""))
    for u, n in counts.items():
        if n == 1:
            for size in PARTS:
                parts.update(u[i : i + size] for i in range(0, len(u), size))
    counts.update(parts)
    return Counter({u: n for u, n in counts.items() if n > 1})


def unit_costs(passages: np.ndarray, sizes: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The least cost (a row a unit, a column a passage) of making a unit of any part of a passage.

    ``passages`` has a row a place and a column a passage, by ascending sizes; ``units`` a row a unit,
    all of one length. Both are numbers of characters; those of units that no passage has are negative.
    """
    count, length = units.shape
    miss = np.where(units.T[:, None, :] == np.arange(int(passages.max()) + 1)[None, :, None], 0, 255).astype(np.uint8)
    shape = (len(sizes), count)
    old = [np.full(shape, i * LACKED, np.uint8) for i in range(length + 1)]
    new = [np.zeros(shape, np.uint8) for _ in range(length + 1)]
    spare, out = np.empty(shape, np.uint8), np.empty(shape, np.uint8)
    done = 0
    for j in range(len(passages)):
        first = int(np.searchsorted(sizes, j, "right"))
        out[done:first] = old[length][done:first]
        done = first
        t = spare[first:]
        for i in range(1, length + 1):
            to = new[i][first:]
            np.take(miss[i - 1], passages[j, first:], axis=0, out=t, mode="clip")
            np.maximum(t, old[i - 1][first:], out=t)
            if i < length:
                np.add(old[i][first:], PASSED, out=to)
                np.minimum(to, t, out=to)
            else:
                # A part of the passage ends with the unit.
                np.minimum(old[i][first:], t, out=to)
            np.add(new[i - 1][first:], LACKED, out=t)
            np.minimum(to, t, out=to)
        old, new = new, old
    out[done:] = old[length][done:]
    return out.T


class Screen:
    """Passages, by ascending length and each long enough (``screened``), with the tables of the units that have been met."""

    def __init__(self, passages: Sequence[str], threshold: float):
        self.passages, self.threshold = passages, threshold
        self.sizes = m = np.array([len(p) for p in passages])
        rate = 1 - threshold
        # Edits, and twice their weighted sum, of a window as long as the passage; characters of the shortest window, cut at an end of the text.
        self.edits = (rate * 2 * m + 1e-6).astype(np.int64)
        self.limits = (rate * 4 * m + 1e-6).astype(np.int64)
        least = np.ceil(threshold * m / (2 - threshold) - 1e-6).astype(np.int64)
        # Cells that are wholly within any window: an uncut one, one cut at the start of a text, and one cut at its end.
        self.cells = np.stack([whole_cells(m), least // CELL, (least - UNIT + 1) // CELL])
        signs = sorted(set("".join(passages)))
        self.sign = {c: i for i, c in enumerate(signs)}
        self.signs = np.array([ord(c) for c in signs], np.uint32)
        self.blocks = [slice(i, min(i + COLUMNS, len(passages))) for i in range(0, len(passages), COLUMNS)]
        self.know([], np.zeros((0, len(passages)), np.uint8))
        # The commonest characters first, each to the class that has the fewest so far.
        self.classes = np.zeros((CLASSES, len(signs) + 1), bool)
        dealt = [0] * CLASSES
        for c, n in Counter("".join(passages)).most_common():
            k = min(range(CLASSES), key=dealt.__getitem__)
            self.classes[k, self.sign[c]] = True
            dealt[k] += n
        self.pieces: tuple[int, list[tuple[np.ndarray, np.ndarray]]] | None = None

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of characters; one more than the last for those that no passage has."""
        found = np.minimum(np.searchsorted(self.signs, codes), len(self.signs) - 1)
        return np.where(self.signs[found] == codes, found, len(self.signs)).astype(np.int16 if len(self.signs) < 1 << 15 else np.int32)

    def most(self) -> int:
        """How many units the tables may have."""
        return min(MOST, TABLE // len(self.passages))

    def costs(self, units: Sequence[str]) -> np.ndarray:
        """The least cost (a row a unit, a column a passage) of making a unit of any part of a passage."""
        out = np.empty((len(units), len(self.passages)), np.uint8)
        order = np.argsort([len(u) for u in units], kind="stable")
        sizes = np.array([len(units[i]) for i in order])
        for block in self.blocks:
            m = self.sizes[block]
            passages = np.zeros((m[-1], len(m)), np.int64)
            for i, p in enumerate(self.passages[block]):
                passages[: len(p), i] = [self.sign[c] for c in p]
            for length in np.unique(sizes):
                low, high = np.searchsorted(sizes, [length, length + 1])
                for i in range(low, high, UNITS):
                    part = order[i : min(i + UNITS, high)]
                    codes = np.array([[self.sign.get(c, -1) for c in units[j]] for j in part])
                    out[part, block] = unit_costs(passages, m, codes)
        return out

    def know(self, units: Sequence[str], costs: np.ndarray) -> None:
        """Units with their costs; row 0 is of all others, whose cost counts as nothing."""
        self.rows = {u: i for i, u in enumerate(units, 1)}
        self.tables = [np.concatenate([np.zeros_like(costs[:1, b], shape=(1, b.stop - b.start)), costs[:, b]]) for b in self.blocks]

    def looked_up(self, counts: Counter) -> np.ndarray:
        """Rows (a column a unit of ``counts``) whose costs sum to a unit's: its own, or those of its parts if it is not known."""
        known = self.rows
        get = known.get
        out = np.zeros((1 + len(range(0, UNIT, PARTS[-1])), len(counts)), np.int64)
        out[0] = [get(u, 0) for u in counts]
        for at, u in enumerate(counts):
            if u not in known:
                row = 0
                for i in range(0, len(u), PARTS[0]):
                    part = u[i : i + PARTS[0]]
                    for x in (part,) if part in known else [part[k : k + PARTS[1]] for k in range(0, len(part), PARTS[1])]:
                        out[row, at] = get(x, 0)
                        row += 1
        return out

    def pairs(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(passage's place, text's place, start, end) of all parts of texts that may hold a passage, and of whole texts that are shorter than it and may be in it."""
        longest = int(self.sizes[-1])
        size = max(STRETCH, 8 * longest)
        # Stretches overlap by the longest window, so that one of them has the whole of it.
        stretches = [(t, i, text[i : i + size]) for t, text in enumerate(texts) for i in range(0, max(1, len(text) - longest), size - longest) if text]
        cut = [CUT(s) for *_, s in stretches]
        counts = Counter()
        for units in cut:
            counts.update(units)
        rows, at = self.looked_up(counts), {u: i for i, u in enumerate(counts)}
        lengths = np.array([len(u) for u in counts], np.int64)
        sizes = np.array([len(x) for *_, x in stretches], np.int64)
        parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in self.blocks]
        start = 0
        while start < len(stretches):
            end = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), SUMMED, "right")))
            units = [np.fromiter(map(at.__getitem__, u), np.int64, len(u)) for u in cut[start:end]]
            for k, p, s, low, high in self._held(sizes[start:end], units, lengths, rows):
                parts[k].append((p, start + s, low, high))
            start = end
        if not any(parts):
            return
        codes, places = self.numbered(_codes("".join(x for *_, x in stretches))), np.cumsum(sizes) - sizes
        for k, held in enumerate(parts):
            if not held:
                continue
            p, s, low, high = (np.concatenate(x) for x in zip(*held))
            m = self.sizes[self.blocks[k]]
            if self.pieces is None or self.pieces[0] != k:
                self.pieces = (k, self._cut(self.passages[self.blocks[k]]))
            short = m[p] > sizes[s]
            may = np.empty(len(p), bool)
            may[~short] = self._within(self.pieces[1], self.edits[self.blocks[k]], p[~short], codes, (places[s] + low)[~short], (high - low)[~short])
            if short.any():
                # The other way round: a text's pieces are looked for in the passage.
                which, of = np.unique(s[short], return_inverse=True)
                pieces = self._cut([stretches[i][2] for i in which])
                edits = ((1 - self.threshold) * 2 * sizes[which] + 1e-6).astype(np.int64)
                own = self.numbered(_codes("".join(self.passages[self.blocks[k]])))
                may[short] = self._within(pieces, edits, of, own, (np.cumsum(m) - m)[p[short]], m[p[short]])
            for one, of, i, j in zip(*(x[may].tolist() for x in (p, s, low, high))):
                yield self.blocks[k].start + one, stretches[of][0], stretches[of][1] + i, stretches[of][1] + j

    def _held(self, sizes: np.ndarray, units: list[np.ndarray], lengths: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        """(block, passages' places in it, stretches' places, starts, ends) of parts of stretches, or of shorter ones as a whole, whose sums allow a window."""
        ends = np.cumsum(-(-sizes // CELL))
        starts = ends - -(-sizes // CELL)
        # A unit counts in the cell of its last character.
        cells = np.concatenate([s + (np.cumsum(lengths[u]) - 1) // CELL for s, u in zip(starts, units)])
        units = np.concatenate(units)
        first = np.searchsorted(cells, np.arange(ends[-1]))
        number = np.diff(np.append(first, len(units)))
        used, units = np.unique(units, return_inverse=True)
        rows = rows[:, used]
        of = np.repeat(np.arange(len(sizes)), ends - starts)
        for k, block in enumerate(self.blocks):
            table = self.tables[k]
            costs = table[rows[0]]
            for more in rows[1:]:
                some = np.flatnonzero(more)
                costs[some] += table[more[some]]
            held = np.zeros((ends[-1], table.shape[1]), np.uint8)
            for n in range(int(number.max(initial=0))):
                some = np.flatnonzero(number > n)
                held[some] += costs[units[first[some] + n]]
            # Sums may wrap: those of a window do not.
            kind = np.uint16 if LACKED * (self.sizes[block][-1] + CELL + UNIT) < 1 << 16 else np.int32
            sums = np.zeros((table.shape[1], ends[-1] + 1), kind)
            np.cumsum(held.T, axis=1, dtype=kind, out=sums[:, 1:])
            m, limits = self.sizes[block][:, None], self.limits[block].astype(kind)[:, None]
            long = sizes >= m
            # Of a shorter text, the text is what is sought: its own characters are what a window of the passage may lack more of.
            least, rate = np.ceil(self.threshold * sizes / (2 - self.threshold) - 1e-6), 1 - self.threshold
            most = np.maximum(rate * 4 * sizes, rate * 2 * (sizes + least) + sizes - least) + 1e-6
            p, s = np.nonzero(~long & (sums[:, ends] - sums[:, starts] <= most))
            if len(s):
                yield k, p, s, 0 * s, sizes[s]
            hits: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            whole, head, tail = self.cells[:, block, None]
            bounds = np.flatnonzero(np.diff(whole[:, 0], prepend=-1, append=-1))
            for i, j in zip(bounds, bounds[1:]):
                r = int(whole[i, 0])
                if r <= ends[-1]:
                    p, row = np.nonzero(sums[i:j, r:] - sums[i:j, :-r] <= limits[i:j])
                    p += i
                    kept = (row + r <= ends[of[row]]) & long[p, of[row]]
                    p, row = p[kept], row[kept]
                    s = of[row]
                    place = (row - starts[s]) * CELL
                    hits.append((p, s, place - CELL - UNIT, place + m[p, 0]))
            columns = np.arange(len(m))[:, None]
            p, s = np.nonzero(long & (sums[columns, np.minimum(starts + head, ends)] - sums[:, starts] <= limits))
            hits.append((p, s, 0 * s, m[p, 0]))
            p, s = np.nonzero(long & (sums[:, ends] - sums[columns, np.maximum(ends - tail, starts)] <= limits))
            hits.append((p, s, sizes[s] - m[p, 0], sizes[s]))
            p, s, low, high = (np.concatenate(x) for x in zip(*hits))
            if not len(p):
                continue
            # Places close to each other are tried as one stretch, of at most about two passages.
            low, high = np.maximum(low, 0), np.minimum(high, sizes[s])
            bucket = low // m[p, 0]
            order = np.lexsort((bucket, s, p))
            p, s, low, high, bucket = (x[order] for x in (p, s, low, high, bucket))
            fresh = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
            p, s, low, high = p[fresh], s[fresh], np.minimum.reduceat(low, fresh), np.maximum.reduceat(high, fresh)
            yield k, p, s, low, high

    def _within(self, pieces: list[tuple[np.ndarray, np.ndarray]], edits: np.ndarray, p: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the least edit distances of a string's pieces, of each class of characters, to parts of its stretch of ``codes`` sum to no more than its edits.

        Each edit is of one character, so that with the other classes left out on both sides the edits of all classes sum to no more.
        """
        total, still = np.zeros(len(p), np.int64), np.arange(len(p))
        for own, (sizes, masks) in zip(self.classes, pieces):
            kept = own[codes]
            before = np.concatenate([[0], np.cumsum(kept)])
            start, end = before[starts[still]], before[(starts + lengths)[still]]
            total[still] += _least(sizes, masks, p[still], codes[kept], start, end - start, len(self.signs))
            still = still[total[still] <= edits[p[still]]]
        return total <= edits[p]

    def _cut(self, strings: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sizes, masks by piece, string and character) of the pieces of strings' characters of each class."""
        out, no = [], len(self.signs)
        for own in self.classes:
            kept = [[x for c in string if own[x := self.sign.get(c, no)]] for string in strings]
            sizes = np.array(list(map(len, kept)))
            # Pieces end at the highest bit; the bits below them match any character.
            masks = np.full((-(-int(sizes.max()) // WORD), len(kept), no + 1), (1 << WORD) - 1, np.uint32)
            for i, held in enumerate(kept):
                count = -(-len(held) // WORD)
                for q in range(count):
                    piece = held[len(held) * q // count : len(held) * (q + 1) // count]
                    masks[q, i] = (1 << (WORD - len(piece))) - 1
                    for j, c in enumerate(piece, WORD - len(piece)):
                        masks[q, i, c] |= np.uint32(1 << j)
            out.append((sizes, masks))
        return out


def _least(sizes: np.ndarray, masks: np.ndarray, p: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: int) -> np.ndarray:
    """Sums of the least edit distances of a passage's pieces to any part of its stretch of ``codes``, by Myers' bit vectors, of many passages at once."""
    one, out = np.uint32(1), np.empty(len(p), np.int64)
    counts = -(-sizes[p] // WORD)
    codes = np.append(codes, codes.dtype.type(after))
    # As many pieces, then as many characters; those whose stretch has ended are last and are left out.
    order = np.lexsort((-lengths, counts))
    bounds = np.searchsorted(counts[order], np.arange(masks.shape[0] + 2))
    for width, (low, high) in enumerate(zip(bounds, bounds[1:])):
        if not width:
            out[order[low:high]] = 0
            continue
        table = masks[:width].reshape(width, -1)
        for i in range(low, high, STATE // width):
            some = order[i : min(i + STATE // width, high)]
            size, q = sizes[p[some]], np.arange(width)[:, None]
            pieces = size * (q + 1) // width - size * q // width
            base, begin, length = p[some] * masks.shape[2], starts[some], lengths[some]
            up = (((1 << WORD) - 1) >> (WORD - pieces) << (WORD - pieces)).astype(np.uint32)
            down, score = np.zeros_like(up), pieces.astype(np.int8)
            best, sign = score.copy(), np.empty(up.shape, bool)
            spare = [np.empty_like(up) for _ in range(4)]
            alive = np.searchsorted(-length, -np.arange(int(length[0])), "left")
            for j, n in enumerate(alive.tolist()):
                eq, same, plus, minus = (x[:, :n] for x in spare)
                u, d, s, g = up[:, :n], down[:, :n], score[:, :n], sign[:, :n]
                at = base[:n] + codes[begin[:n] + j]
                for k in range(width):
                    np.take(table[k], at, out=eq[k], mode="clip")
                np.bitwise_and(eq, u, out=same)
                same += u
                same ^= u
                same |= eq
                same |= d
                np.bitwise_or(same, u, out=plus)
                np.invert(plus, out=plus)
                plus |= d
                np.bitwise_and(same, u, out=minus)
                np.less(plus.view(np.int32), 0, out=g)
                s += g.view(np.int8)
                np.less(minus.view(np.int32), 0, out=g)
                s -= g.view(np.int8)
                np.minimum(best[:, :n], s, out=best[:, :n])
                np.left_shift(plus, one, out=plus)
                np.left_shift(minus, one, out=minus)
                np.bitwise_or(same, plus, out=u)
                np.invert(u, out=u)
                u |= minus
                np.bitwise_and(plus, same, out=d)
            out[some] = best.sum(axis=0, dtype=np.int64)
    return out
