"""N-best segmentation into SentencePiece pieces, and decoding.

The lattice of a text has an edge for every piece of the model that occurs in it, weighted with the
model's score; a character without a piece has an edge of its own, which stands for its UTF-8 bytes.
Forward Viterbi finds the best score from the start to every node. Taken as heuristics they are
exact, so that an A-star search that runs backwards from the end takes segmentations from its queue
in the order of their scores.

No piece spans the start of a word or a newline, so that the lattice of a text is a chain of lattices,
most of them small. The search runs on those; the n best of the chain follow exactly,
as choices of alternatives in the few links where the loss is least. Words that repeat are
looked up. Each text is encoded alone and whole, in the task that holds it; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import U64, mixed, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Links, and searches of links, that a worker remembers; beyond that it starts afresh.
REMEMBERED, SEARCHED = 150_000, 10_000
#: Links that are searched at once.
TOGETHER = 16_384
#: Links of more characters are searched one by one.
LONG = 48
LINK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_MADE: dict[str, Pieces] = {}


def applied(ids: list[int], changes: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """The ids of another segmentation, from those of the best."""
    out = list(ids)
    for at, gone, new in sorted(changes, reverse=True):
        out[at : at + gone] = new
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in a row, with the starts and ends of each."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], ends[:-1]]), ends


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial over the codes, and the factors that bring a part of it to its start."""
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum(mixed(codes.astype(U64) + U64(1)) * powers("up", len(codes)), out=total[1:])
    return total, powers("down", len(codes) + 1)


def _finish(part: np.ndarray, size) -> np.ndarray:
    return mixed(part + U64(0xD6E8FEB86659FD93) * np.asarray(size).astype(U64))


def _hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total, down = _prefix(codes)
    return _finish((total[ends] - total[starts]) * down[starts], ends - starts)


class Pieces:
    """A model's pieces and scores, and the searches over them."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], size: int):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces), default=1)
        # Pieces that the model never makes by itself have scores far below all others.
        self.unknown = min((s for _, s in pieces.values() if s > -1e8), default=0.0) - 10.0
        self.text_of = [""] * size
        for p, (i, _) in pieces.items():
            self.text_of[i] = p.replace(SPACE, " ")
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        for b in range(128):
            self.text_of[byte_ids[b]] = chr(b)
        self.high = frozenset(byte_ids[128:])
        #: Of each link that is remembered: ids (int32), score, loss of the second best.
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.table, self.crowded = None, set()
        self.searched: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        if path not in _MADE:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            n = sp.get_piece_size()
            plain = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
            _MADE[path] = cls(plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n)
        return _MADE[path]

    def _edges(self, s: str, j: int) -> list[tuple[int, float]]:
        """(start, score) of the edges that end at node j."""
        get, out = self.pieces.get, []
        for i in range(max(0, j - self.longest), j):
            if (p := get(s[i:j])) is not None:
                out.append((i, p[1]))
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, self.unknown))
        return out

    def _ids(self, s: str, i: int, j: int) -> tuple[int, ...]:
        p = self.pieces.get(s[i:j])
        return (p[0],) if p is not None else tuple(self.byte_ids[b] for b in s[i:j].encode("utf-8", "surrogatepass"))

    def forward(self, s: str) -> tuple[list[float], list[float], list[int]]:
        """Best and second-best scores from the start to every node, and the best path's last edge."""
        get, longest, low = self.pieces.get, self.longest, float("-inf")
        best, second, back = [0.0], [low], [0]
        for j in range(1, len(s) + 1):
            top, next_, at, single = low, low, j - 1, False
            for i in range(j - longest if j > longest else 0, j):
                p = get(s[i:j])
                if p is None:
                    if i < j - 1:
                        continue
                    score = self.unknown
                else:
                    score = p[1]
                x = best[i] + score
                if x > top:
                    if top > next_:
                        next_ = top
                    top, at = x, i
                elif x > next_:
                    next_ = x
                x = second[i] + score
                if x > next_:
                    next_ = x
            best.append(top)
            second.append(next_)
            back.append(at)
        return best, second, back

    def _one(self, s: str) -> tuple[bytes, float, float]:
        best, second, back = self.forward(s)
        cuts, j = [], len(s)
        while j:
            cuts.append((back[j], j))
            j = back[j]
        ids = [x for i, j in reversed(cuts) for x in self._ids(s, i, j)]
        return np.array(ids, np.int32).tobytes(), best[-1], best[-1] - second[-1]

    def _slots(self) -> tuple[np.ndarray, ...]:
        """Pieces by hash: two tables of slots, and the pieces' hashes and scores, by place."""
        if self.table is None:
            words = list(self.pieces)
            codes, starts, ends = _codes(words)
            h = _hash(codes, starts, ends)
            table = np.full(1 << 22, -1, np.int32)
            order = np.arange(len(words), dtype=np.int32)
            slot = (h >> U64(42)).astype(np.int64)
            table[slot[::-1]] = order[::-1]
            # The few pieces whose slot is taken have one in a second table, by other bits.
            rest, more = order[table[slot] != order], np.full(1 << 16, -1, np.int32)
            slot = (h[rest] & U64(0xFFFF)).astype(np.int64)
            more[slot[::-1]] = rest[::-1]
            self.table = (table, more, h, np.array([self.pieces[w][1] for w in words]), np.array([self.pieces[w][0] for w in words], np.int32))
            self.crowded = {words[k] for k in rest[more[slot] != rest]}
        return self.table

    def learn(self, words: list[str]) -> None:
        """Find and remember the best segmentation of many links at once: the forward search, a node of all of them at a time."""
        table, more, hashes, scores, piece_ids = self._slots()
        short = []
        for w in words:
            if len(w) > LONG or self.crowded and any(c in w for c in self.crowded):
                self.known[w] = self._one(w)
            else:
                short.append(w)
        if not short:
            return
        short.sort(key=len, reverse=True)
        codes, starts, ends = _codes(short)
        size = ends - starts
        most, n = int(size[0]), len(short)
        total, down = _prefix(codes)
        best, second = np.full((most + 1, n), -np.inf), np.full((most + 1, n), -np.inf)
        best[0] = 0.0
        back, piece = np.zeros((most + 1, n), np.int8), np.full((most + 1, n), -1, np.int32)
        for j in range(1, most + 1):
            m = int(np.searchsorted(-size, -j, "right"))  # links of at least j characters come first
            end = total[starts[:m] + j]
            for k in range(1, min(j, self.longest) + 1):
                at = starts[:m] + (j - k)
                h = _finish((end - total[at]) * down[at], k)
                found = table[h >> U64(42)]
                found = np.where((found >= 0) & (hashes[found] == h), found, more[h & U64(0xFFFF)])
                found = np.where((found >= 0) & (hashes[found] == h), found, -1)
                score = np.where(found >= 0, scores[found], self.unknown if k == 1 else -np.inf)
                x, y = best[j - k, :m] + score, second[j - k, :m] + score
                b, s2 = best[j, :m], second[j, :m]
                better = x >= b  # of equals the longer piece, as it starts first
                low = np.minimum(x, b)
                second[j, :m] = np.maximum(np.maximum(s2, np.where(np.isfinite(low), low, -np.inf)), y)
                best[j, :m] = np.maximum(x, b)
                take = better & np.isfinite(x)
                back[j, :m][take] = k
                piece[j, :m][take] = found[take]
        top, next_ = best[size, np.arange(n)].tolist(), second[size, np.arange(n)].tolist()
        at, col, cuts = size.copy(), np.arange(n), []
        while len(col):
            k = back[at[col], col]
            cuts.append((col, at[col] - k, piece[at[col], col]))
            at[col] -= k
            col = col[at[col] > 0]
        owner, where, what = (np.concatenate(x) for x in zip(*cuts))
        order = np.lexsort((where, owner))
        owner, where, what = owner[order], where[order], what[order]
        ids = np.where(what >= 0, piece_ids[what], 0).astype(np.int32)
        bounds = np.searchsorted(owner, np.arange(n + 1))
        plain = np.ones(n, bool)
        plain[owner[what < 0]] = False
        data, known = ids.tobytes(), self.known
        for i, w in enumerate(short):
            a, b = bounds[i], bounds[i + 1]
            if plain[i]:
                got = data[4 * a : 4 * b]
            else:
                spans = zip(where[a:b].tolist(), [*where[a + 1 : b].tolist(), len(w)])
                got = np.array([x for i0, j0 in spans for x in self._ids(w, i0, j0)], np.int32).tobytes()
            known[w] = (got, top[i], top[i] - next_[i])

    def search(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a lattice by backward A-star; of equal paths the last opened goes on first, and of its edges the one that starts first.

        An open path is a node that points to the one behind it: no path is copied. A node is left n
        times at most, as further paths from there to the end can't be among the n best.
        """
        best = self.forward(s)[0]
        queue: list[tuple] = [(-best[-1], 0, len(s), 0.0, None)]
        left = [0] * (len(s) + 1)
        out, number = [], 0
        while queue and len(out) < n:
            cost, _, j, done, tail = heapq.heappop(queue)
            if left[j] == n:
                continue
            left[j] += 1
            if j == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += self._ids(s, tail[0], tail[1])
                    tail = tail[2]
                out.append((-cost, tuple(ids)))
                continue
            # Of equals the latest path goes first, and of its edges the one that starts first: depth before breadth.
            for i, score in reversed(self._edges(s, j)):
                number -= 1
                heapq.heappush(queue, (-(best[i] + score + done), number, i, score + done, (i, j, tail)))
        return out

    def ready(self, chains: list[list[str] | None]) -> None:
        """Remember what the chains need; when too much is remembered, all else is forgotten."""
        fresh = {s for x in chains if x for s in x}
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
        rest = sorted(fresh.difference(self.known))
        for i in range(0, len(rest), TOGETHER):
            self.learn(rest[i : i + TOGETHER])

    def links(self, text: str) -> list[str]:
        return LINK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def n_best(self, links: list[str], n: int) -> tuple[bytes, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """The n best of a chain: ids of the best (int32), all scores, and what the others change in the best.

        A change (at, gone, ids) puts ids in place of ``gone`` ids at ``at``. There are fewer than n if
        the text has fewer segmentations. ``ready`` must have seen the links.
        """
        if not links:
            return b"", [0.0], []
        known = self.known
        found = [known[s] for s in links]
        total = sum([f[1] for f in found])
        ids = b"".join([f[0] for f in found])
        if n <= 1:
            return ids, [total], []
        # Only the n-1 links with the least losses can differ from their best in the n best.
        losses = [f[2] for f in found]
        open_ = sorted(k for x, k in heapq.nsmallest(n - 1, zip(losses, range(len(losses)))) if x < float("inf"))
        options = []
        for k in open_:
            s = links[k]
            if (got := self.searched.get((s, n))) is None:
                if len(self.searched) >= SEARCHED:
                    self.searched.clear()
                got = self.searched[s, n] = self.search(s, n)
            options.append(got)
        queue, seen = [(0.0, (0,) * len(open_))], {(0,) * len(open_)}
        picks = []
        while queue and len(picks) < n:
            loss, pick = heapq.heappop(queue)
            picks.append((loss, pick))
            for d in range(len(pick)):
                after = (*pick[:d], pick[d] + 1, *pick[d + 1 :])
                if after[d] < len(options[d]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(queue, (sum(o[0][0] - o[x][0] for o, x in zip(options, after)), after))
        at = [sum([len(f[0]) for f in found[:k]]) // 4 for k in open_]
        changes = [
            [(at[d], len(found[open_[d]][0]) // 4, options[d][x][1]) for d, x in enumerate(pick) if x] for _, pick in picks[1:]
        ]
        return ids, [total - loss for loss, _ in picks], changes

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes gathered to characters, the first space left out."""
        text_of = self.text_of
        if self.high.isdisjoint(ids):
            out = "".join([text_of[i] for i in ids])
        else:
            data = bytearray()
            for i in ids:
                if i in self.byte_of:
                    data.append(self.byte_of[i])
                else:
                    data += text_of[i].encode()
            out = data.decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def encode_n_best(docs: DataFrame, n: int = 4, model: str = MODEL, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but the text by default) with the n best segmentations.

    New columns: ids (array<int> of the best), scores (the n best scores, from the best), changes
    (for the second best and each further one, what it changes in ids: see ``applied``) and
    round_trip, whether the decoded best is the text again. It is, unless the text itself holds the
    mark U+2581, which stands for a space. A null text has nulls throughout; an empty one has no ids
    and the one score 0. Equal scores go in an order that depends on the text alone. Repeated rows
    are encoded alike; an empty table gives no rows; columns that have the new names are replaced.
    """
    new = ("ids", "scores", "changes", "round_trip")
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text_col]) if c not in new]
    source = docs.select(*kept, F.col(text_col).alias("__text"))
    at = len(kept)
    change = pa.struct([("at", pa.int32()), ("gone", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces.load(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(at).to_pylist()
                links = [own.links(t) if t is not None else None for t in texts]
                own.ready(links)
                made = [own.n_best(x, n) if x is not None else None for x in links]
                flat = np.frombuffer(b"".join(m[0] for m in made if m), np.int32)
                ends = np.cumsum([0, *(len(m[0]) // 4 if m else 0 for m in made)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*(m is None for m in made), False])), pa.array(flat))
                back = [own.decode(flat[a:b].tolist()) == t if t is not None else None for a, b, t in zip(ends[:-1], ends[1:], texts)]
                scores = pa.array([m and m[1] for m in made], pa.list_(pa.float64()))
                changes = pa.array(
                    [m and [[dict(zip(("at", "gone", "ids"), c)) for c in cs] for cs in m[2]] for m in made], pa.list_(pa.list_(change))
                )
                yield pa.record_batch([*part.columns[:at], ids, scores, changes, pa.array(back, pa.bool_())], names=[*kept, *new])

    ints = T.ArrayType(T.IntegerType())
    change_type = T.StructType().add("at", "integer").add("gone", "integer").add("ids", ints)
    schema = T.StructType(source.schema.fields[:at]).add("ids", ints).add("scores", T.ArrayType(T.DoubleType()))
    schema = schema.add("changes", T.ArrayType(T.ArrayType(change_type))).add("round_trip", "boolean")
    return source.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids; null for null ids."""
    kept = [c for c in rows.columns if c != "decoded"]
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces.load(model)
        for batch in batches:
            made = [own.decode([i for i in x if i is not None]) if x is not None else None for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(made, pa.string())], names=[*kept, "decoded"])

    source = rows.select(*kept)
    return source.mapInArrow(run, T.StructType([*source.schema.fields]).add("decoded", "string"))
