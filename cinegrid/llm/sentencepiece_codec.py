"""SentencePiece encoding and decoding with a streaming Viterbi trellis.

Boundaries between characters are the states of the trellis, pieces its edges, and each boundary keeps one surviving path.
In a unigram vocabulary that is the path of the best total score. In a BPE vocabulary it is the encoding of the prefix:
a piece extends a path exactly if merging its string with the path's last piece by the vocabulary's own priorities gives
those two pieces again, and just one path per boundary does. So the ids equal those of the SentencePiece library for both
kinds of model.

Every character goes through the one trellis. It keeps a window of boundaries, WINDOW times the longest piece: when
the window is full, the back pointers of all boundaries that can still be extended are followed until they meet in one
boundary, and the pieces before it are final and leave the window. (A window grows only where paths do not meet within it,
which a vocabulary can force but words do not.) Where no piece can stand across a boundary (before a space mark that follows
another character, and around characters that no piece has) all paths meet at once, so a text falls into stretches, mostly
words. Stretches are the lanes of the trellis: numpy moves thousands of them one boundary on at a time. Equal stretches of a
batch are one lane, and a task remembers the ids of SLOTS recent ones, told apart by 128 bits.

Texts are encoded whole, of any length, CHUNK characters at a time; a null text counts as empty and has no ids. Characters
outside the vocabulary become their UTF-8 bytes' pieces, or the unknown id where the vocabulary has none. Decoding gives the
text back, but for U+2581, which is the space mark itself, and for unknown ids. Other columns stay as they are; a column
named like an output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinegrid.llm.common import small_batches
from cinegrid.llm.wordhash import slices

#: The vocabulary's place unless the caller names another; read on the driver only, then broadcast.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, USER_DEFINED, BYTE, UNKNOWN = 1, 4, 6, 2
UNIGRAM, BPE = 1, 2
#: Boundaries of a lane's window, in longest pieces, and lanes that move together.
WINDOW, LANES = 4, 8192
#: Characters of text worked on at a time (more only where a text has no break), and stretches that a task remembers.
CHUNK, SLOTS, KEPT_IDS = 1 << 18, 1 << 20, 4_000_000
PAIRS = 1 << 20
NONE, START = -2, -1


@dataclass
class Vocabulary:
    kind: int
    pieces: dict[str, tuple[int, float]]
    texts: list[str]
    bytes_: dict[int, int]
    unknown: int
    prefix: bool
    byte_of: dict[int, int] = field(init=False)

    def __post_init__(self) -> None:
        self.byte_of = {i: b for b, i in self.bytes_.items()}


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads a SentencePiece model whose normaliser changes nothing but spaces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normaliser and prefixed space marks are supported")
    if model.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    texts = [p.piece for p in model.pieces]
    pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)}
    bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
    return Vocabulary(model.trainer_spec.model_type, pieces, texts, bytes_, unknown, norm.add_dummy_prefix)


class Lookup:
    """A fixed map from numbers to numbers of at least 0, asked for whole arrays: -1 where there is none."""

    def __init__(self, entries: dict[int, int]):
        keys, values = np.fromiter(entries, np.int64, len(entries)), np.fromiter(entries.values(), np.int64, len(entries))
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], -1), np.append(values[order], -1)
        self.shift = np.uint64(64 - max(4, (4 * len(entries)).bit_length()))
        slot = self._slot(self.keys[:-1])
        self.at = np.full(1 << (64 - int(self.shift)), len(entries), np.int64)
        self.at[slot] = np.arange(len(entries))
        self.crowded = np.bincount(slot, minlength=len(self.at)) > 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        i = self.at[slot]
        out = np.where(self.keys[i] == keys, self.values[i], -1)
        again = np.flatnonzero((out < 0) & self.crowded[slot])
        if len(again):
            i = np.searchsorted(self.keys[:-1], keys[again])
            out[again] = np.where(self.keys[i] == keys[again], self.values[i], -1)
        return out


def merged(pieces: dict[str, tuple[int, float]], text: str) -> tuple[list[str], tuple[str, str]]:
    """BPE of a short string, the best-scored neighbours first, of equals the leftmost; and the last two that were merged."""
    parts, last = list(text), ("", "")
    while len(parts) > 1:
        best, at = -math.inf, -1
        for i in range(len(parts) - 1):
            hit = pieces.get(parts[i] + parts[i + 1])
            if hit and hit[1] > best:
                best, at = hit[1], i
        if at < 0:
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


class Tables:
    """A vocabulary as arrays. Made once on the driver; edges are numbered: pieces first, then known characters that are none."""

    def __init__(self, v: Vocabulary):
        pieces = v.pieces
        chars = sorted({c for p in pieces for c in p} | {MARK})
        self.vocabulary, self.bpe = v, v.kind == BPE
        self.edges = [*pieces, *(c for c in chars if c not in pieces)]
        number = {e: i for i, e in enumerate(self.edges)}
        self.crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        self.length = np.array([len(e) for e in self.edges], np.int64)
        self.longest = int(self.length.max())
        lost = min(s for _, s in pieces.values()) - 10.0
        self.score = np.array([pieces[e][1] if e in pieces else lost for e in self.edges])
        spelled = [[pieces[e][0]] if e in pieces else [v.bytes_[b] for b in e.encode()] if v.bytes_ else [v.unknown] for e in self.edges]
        self.spelled, self.spelled_at = np.array([i for s in spelled for i in s], np.int32), np.concatenate([[0], np.cumsum([len(s) for s in spelled])])

        # the pieces as a tree: state and character give the next state, and a state may end a piece
        self.class_of = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.classes = len(chars) + 1
        self.single = np.array([-1, *(number[c] for c in chars)], np.int64)
        states = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                states.setdefault(p[:k], len(states))
        self.ends = np.array([number[s] if s in pieces else -1 for s in states], np.int64)
        self.next = Lookup({states[s[:-1]] * self.classes + int(self.class_of[ord(s[-1])]): i for s, i in states.items() if s})

        if self.bpe:
            n = len(self.edges)
            order = sorted(pieces, key=lambda p: (-pieces[p][1], pieces[p][0]))
            self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            self.rank[[number[p] for p in order]] = np.arange(len(order))
            self.rank[self.length == 1] = -1
            self.whole = self.length == 1  # what merging its own characters ends in
            across = {}
            for p in pieces:
                if len(p) > 1:
                    parts, last = merged(pieces, p)
                    if parts == [p]:
                        self.whole[number[p]] = True
                        self.left[number[p]], self.right[number[p]] = number[last[0]], number[last[1]]
                    for k in range(1, len(p)):
                        x, y = number.get(p[:k]), number.get(p[k:])
                        if x is not None and y is not None:
                            across[x * n + y] = int(self.rank[number[p]])
            self.across = Lookup(across)
            self.double = np.array([MARK * 2 in e for e in self.edges])
            self.mark_first, self.mark_last = np.array([e[0] == MARK for e in self.edges]), np.array([e[-1] == MARK for e in self.edges])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, end to end."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, tables: Tables):
        self.t, self.v = tables, tables.vocabulary
        self.pair, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.doubles: dict[tuple[int, int], bool] = {}
        self.widest = 0  # boundaries that a window has held at most
        self._forget()

    def _forget(self) -> None:
        self.memory = np.zeros((3, SLOTS), np.uint64)  # two hashes, and the place of the ids
        self.memory_size = np.zeros(SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    # which pieces may follow a path that ends in another one (BPE)

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both gives just these two edges again; x may be START."""
        t = self.t
        out = t.whole[y]
        ask = np.flatnonzero(out & (x >= 0))
        key = x[ask] * len(t.edges) + y[ask]
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64) & (PAIRS - 1)
        known = self.pair[slot] == key
        out[ask] = self.pair_fits[slot]
        new = np.flatnonzero(~known)
        if len(new):
            answer = self._apart(x[ask[new]], y[ask[new]])
            out[ask[new]] = answer
            self.pair[slot[new]] = key[new]
            self.pair_fits[slot[new]] = answer
            # of different pairs in one slot the last one written holds, so its answer must too
            last = self.pair[slot[new]] == key[new]
            self.pair_fits[slot[new[last]]] = answer[last]
        return out

    def _apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Undoes merges, the latest first; none across the boundary may have been due before the merge just undone."""
        t, n = self.t, len(self.t.edges)
        out = np.zeros(len(x), bool)
        odd = t.double[x] | t.double[y] | t.mark_last[x] & t.mark_first[y]  # runs of marks may be pieces of equal score
        for i in np.flatnonzero(odd).tolist():
            pair = (int(x[i]), int(y[i]))
            if pair not in self.doubles:
                if len(self.doubles) > PAIRS:
                    self.doubles.clear()
                self.doubles[pair] = merged(self.v.pieces, t.edges[pair[0]] + t.edges[pair[1]])[0] == [t.edges[k] for k in pair]
            out[i] = self.doubles[pair]
        at = np.flatnonzero(~odd)
        x, y, limit = x[at], y[at], np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            across = t.across(x * n + y)
            of_x, of_y = t.rank[x], t.rank[y]
            stays = (across < 0) | (across >= limit)
            done = stays & (of_x < 0) & (of_y < 0)
            out[at[done]] = True
            go = stays & ~done
            at, x, y, of_x, of_y = at[go], x[go], y[go], of_x[go], of_y[go]
            later = of_x > of_y
            limit = np.where(later, of_x, of_y + 1)  # of equal merges the left one comes first
            x, y = np.where(later, t.right[x], x), np.where(later, y, t.left[y])
        return out

    # the trellis

    def _edges(self, cls: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, first): the pieces that begin at each character, itself at least. stop: the end of its stretch."""
        t = self.t
        found = [(np.arange(len(cls)), t.single[cls])]
        at = np.arange(len(cls))
        state = t.next(cls.astype(np.int64))
        for ahead in range(1, t.longest):
            go = (state >= 0) & (at + ahead < stop[at])
            at = at[go]
            if not len(at):
                break
            state = t.next(state[go] * t.classes + cls[at + ahead])
            ended = np.where(state >= 0, t.ends[state], -1)
            hit = ended >= 0
            found.append((at[hit], ended[hit]))
        count = np.zeros(len(cls), np.int64)
        for where, _ in found:
            count[where] += 1
        first = np.concatenate([[0], np.cumsum(count)])
        edges, free = np.zeros(first[-1], np.int64), first[:-1].copy()
        for where, edge in found:
            edges[free[where]] = edge
            free[where] += 1
        return edges, first

    def trellis(self, cls: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lane, edge) of all stretches in order. cls: characters of known classes; start, size: each stretch's place in it."""
        stop = np.zeros(len(cls), np.int64)
        stop[_ranges(start, size)] = np.repeat(start + size, size)
        edges, first = self._edges(cls, stop)
        order = np.argsort(-size, kind="stable")
        got = [self._lanes(order[a : a + LANES], start, size, edges, first) for a in range(0, len(order), LANES)]
        lane, at, edge = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
        sort = np.lexsort((at, lane))
        return lane[sort], edge[sort]

    def _lanes(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray, edges: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lane, boundary, edge that ends there) of lanes in falling order of size."""
        t, longest, n = self.t, self.t.longest, size[lanes]
        width = WINDOW * longest
        last, score = np.full((len(lanes), width), NONE, np.int64), None if t.bpe else np.full((len(lanes), width), -np.inf)
        last[:, 0], base = START, np.zeros(len(lanes), np.int64)
        if score is not None:
            score[:, 0] = 0
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def commit(rows: np.ndarray, to: np.ndarray) -> None:
            """The paths from the bases to these boundaries are final."""
            at = to.copy()
            ahead = at > base[rows]
            base_of = base[rows]
            base[rows] = to
            while ahead.any():
                rows, at, base_of = rows[ahead], at[ahead], base_of[ahead]
                edge = last[rows, at % width]
                out.append((lanes[rows], at, edge))
                at = at - t.length[edge]
                ahead = at > base_of

        def meet(rows: np.ndarray, i: int) -> np.ndarray:
            """The boundary where the paths of all boundaries from i on meet."""
            at = np.broadcast_to(np.arange(i, i + longest), (len(rows), longest)).copy()
            live = last[rows[:, None], at % width] != NONE
            at[~live] = -1
            while True:
                far = at.max(1)
                moving = (at == far[:, None]) & (np.where(at < 0, far[:, None], at).min(1) < far)[:, None]
                if not moving.any():
                    return far
                r, c = np.nonzero(moving)
                at[r, c] -= t.length[last[rows[r], at[r, c] % width]]

        alive = len(lanes)
        for i in range(int(n[0]) + 1 if len(n) else 0):
            going = int(np.searchsorted(-n, -i, "left"))  # lanes of more than i characters
            if going < alive:
                ended = np.arange(going, alive)
                self.widest = max(self.widest, int((i - base[ended]).max()))
                commit(ended, np.full(len(ended), i))
                alive = going
            if not alive:
                break
            if i + longest >= width:
                full = np.flatnonzero(i + longest - base[:alive] >= width)
                if len(full):
                    self.widest = max(self.widest, int((i - base[full]).max()) + longest)
                    commit(full, meet(full, i))
                    if (i + longest - base[full] >= width).any():  # paths that have not met
                        at = base[:, None] + np.arange(width)
                        old_last, old_score, held = last, score, at < i + longest
                        rows = np.arange(len(lanes))[:, None]
                        last = np.full((len(lanes), 2 * width), NONE, np.int64)
                        last[rows, at % (2 * width)] = np.where(held, old_last[rows, at % width], NONE)
                        if score is not None:
                            score = np.full((len(lanes), 2 * width), -np.inf)
                            score[rows, at % (2 * width)] = np.where(held, old_score[rows, at % width], -np.inf)
                        width *= 2
                last[:alive, (i + longest) % width] = NONE
                if score is not None:
                    score[:alive, (i + longest) % width] = -np.inf
            here = last[:alive, i % width]
            rows = np.flatnonzero(here != NONE)
            place = start[lanes[rows]] + i
            count = first[place + 1] - first[place]
            edge, row = edges[_ranges(first[place], count)], np.repeat(rows, count)
            slot = (i + t.length[edge]) % width
            if t.bpe:
                free = last[row, slot] == NONE
                row, slot, edge = row[free], slot[free], edge[free]
                good = self.fits(last[row, i % width], edge)
            else:
                total = score[row, i % width] + t.score[edge]
                good = total > score[row, slot]
                score[row[good], slot[good]] = total[good]
            last[row[good], slot[good]] = edge[good]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    # stretches of texts

    def _stretches(self, points: np.ndarray, cls: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The places where stretches begin. opens: those where a chunk does."""
        begins = np.zeros(len(points), bool)
        begins[opens] = True
        unknown = cls == 0
        begins |= unknown
        begins[1:] |= unknown[:-1]
        if not self.t.crossing:
            mark = points == ord(MARK)
            begins[1:] |= mark[1:] & ~mark[:-1]
        return np.flatnonzero(begins)

    def _distinct(self, cls: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(representatives, inverse, hash, second hash) of the stretches; equal ones are one."""
        base = 0x9E3779B97F4A7C15 | 1
        while True:
            hashes = []
            for b in (base, base ^ 0x5851F42D4C957F2C):
                up, down = self._powers(b, len(points) + 1)
                total = np.concatenate([[np.uint64(0)], np.cumsum((points + np.uint64(1)) * up[: len(points)], dtype=np.uint64)])
                h = (total[start + size] - total[start]) * down[start] + size.astype(np.uint64)
                h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
                hashes.append(h ^ h >> np.uint64(29))
            _, rep, back = np.unique(hashes[0], return_index=True, return_inverse=True)
            if (hashes[1][rep][back] == hashes[1]).all():
                return rep, back, hashes[0][rep], hashes[1][rep]
            base += 2  # two different stretches with one hash: hash anew

    def _powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = self.__dict__.setdefault("_held", {})
        if base not in held or len(held[base][0]) < n:
            n = max(n, CHUNK + 1)
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            held[base] = tuple(both)
        return held[base]

    def _spell(self, points: np.ndarray, cls: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number) of different stretches."""
        t, v = self.t, self.v
        known = cls[start] > 0
        number = np.zeros(len(start), np.int64)
        which = np.flatnonzero(known)
        inner = _ranges(start[which], size[which])
        lane, edge = self.trellis(cls[inner], np.cumsum(size[which]) - size[which], size[which])
        per_edge = t.spelled_at[edge + 1] - t.spelled_at[edge]
        ids = t.spelled[_ranges(t.spelled_at[edge], per_edge)]
        number[which] = np.bincount(lane, per_edge, len(which)).astype(np.int64)
        strange = np.flatnonzero(~known)
        if len(strange):
            spelled = [[v.bytes_[b] for b in chr(points[start[i]]).encode()] if v.bytes_ else [v.unknown] for i in strange.tolist()]
            number[strange] = [len(s) for s in spelled]
            whole = np.zeros(number.sum(), np.int32)
            at = np.cumsum(number) - number
            whole[_ranges(at[which], number[which])] = ids
            whole[_ranges(at[strange], number[strange])] = [i for s in spelled for i in s]
            ids = whole
        return ids, number

    def _chunk(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each part) of parts of texts, with space marks for spaces."""
        joined = "".join(parts)
        opens = np.cumsum([0, *map(len, parts)])[:-1]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = self.t.class_of[points]
        start = self._stretches(points, cls, opens)
        size = np.diff(start, append=len(points))
        rep, back, h1, h2 = self._distinct(cls, points, start, size)
        if self.used > KEPT_IDS:
            self._forget()
        slot = (h1 & np.uint64(SLOTS - 1)).view(np.int64)
        old = (self.memory[0][slot] == h1) & (self.memory[1][slot] == h2) & (self.memory_size[slot] > 0)
        at, number = self.memory[2][slot].view(np.int64), self.memory_size[slot].astype(np.int64)
        new = np.flatnonzero(~old)
        if len(new):
            ids, count = self._spell(points, cls, start[rep[new]], size[rep[new]])
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            at[new], number[new] = self.used + np.cumsum(count) - count, count
            self.used += len(ids)
            self.memory[0][slot[new]], self.memory[1][slot[new]], self.memory[2][slot[new]] = h1[new], h2[new], at[new].view(np.uint64)
            self.memory_size[slot[new]] = count
            # of different stretches in one slot the last one written holds, in all four
            mine = (self.memory[0][slot[new]] == h1[new]) & (self.memory[1][slot[new]] == h2[new])
            self.memory[2][slot[new[mine]]], self.memory_size[slot[new[mine]]] = at[new[mine]].view(np.uint64), count[mine]
        each = number[back]
        part = np.searchsorted(opens, start, "right") - 1
        return self.ids[_ranges(at[back], each)], np.bincount(part, each, len(parts)).astype(np.int64)

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """(text, part) of non-empty texts: whole, or cut before a space that follows another character."""
        for k, text in enumerate(texts):
            if not text:
                continue
            text = (MARK + text if self.v.prefix else text).replace(" ", MARK)
            at = 0
            while not self.t.crossing and len(text) - at > CHUNK:
                cut = text.rfind(MARK, at + 1, at + CHUNK)
                while cut > at and text[cut - 1] == MARK:
                    cut -= 1
                if cut <= at:  # no break here: on to the next one
                    cut = at + CHUNK
                    while cut < len(text) and not (text[cut] == MARK and text[cut - 1] != MARK):
                        cut += 1
                yield k, text[at:cut]
                at = cut
            if at < len(text):
                yield k, text[at:]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each text)."""
        number, found, held, size = np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            ids, count = self._chunk([p for _, p in held])
            np.add.at(number, [k for k, _ in held], count)
            found.append(ids)
            held.clear()

        for k, part in self._parts(texts):
            if held and size + len(part) > CHUNK:
                flush()
                size = 0
            held.append((k, part))
            size += len(part)
        if held:
            flush()
        return np.concatenate(found) if found else np.zeros(0, np.int32), number

    def encode(self, text: str) -> list[int]:
        return self([text])[0].tolist()


def decoder(v: Vocabulary) -> Callable[[list[int]], str]:
    raw = [t.encode() for t in v.texts]
    raw[v.unknown] = " ⁇ ".encode()
    for i, b in v.byte_of.items():
        raw[i] = bytes((b,))

    def decode_ids(ids: list[int]) -> str:
        text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if v.prefix and text.startswith(" ") else text

    return decode_ids


#: So many bytes of text are taken from a batch at a time, which keeps their ids small beside it.
BYTES_AT_ONCE = 1 << 18


def _replace(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [column], names=[*names, name])


def _with(df: DataFrame, target: str, ddl: str) -> StructType:
    return df.drop(target).withColumn(target, F.lit(None).cast(ddl)).schema


def _texts(flat: list[int], number: list[int], decode_ids: Callable[[list[int]], str]) -> pa.Array:
    texts, at = [], 0
    for n in number:
        texts.append(decode_ids(flat[at : at + n]))
        at += n
    return pa.array(texts, pa.string())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: Vocabulary | None = None, decoded: str | None = None) -> DataFrame:
    """df with the ids (array<int>) of a text column and, in the column `decoded` if one is named, the text that they decode to.
    One Python worker does both, where `decode` after `encode` takes two a task."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Tables(vocabulary or load_vocabulary()))  # one vocabulary, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        decode_ids = decoder(encoder.v) if decoded else None
        for batch in batches:
            for part, texts in slices(batch, text, BYTES_AT_ONCE):
                flat, number = encoder(texts.to_pylist())
                ends = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
                out = _replace(part, ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield _replace(out, decoded, _texts(flat.tolist(), number.tolist(), decode_ids)) if decoded else out

    schema = _with(df, ids, "array<int>")
    if decoded:
        schema = StructType([f for f in schema if f.name != decoded]).add(decoded, "string")
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: Vocabulary | None = None) -> DataFrame:
    """df with the text of an ids column; null ids are no ids."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = decoder(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids)).cast(pa.list_(pa.int32()))
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE // 4, "right")))
                flat = column.slice(at, to - at).flatten().to_numpy(zero_copy_only=False).tolist()
                yield _replace(batch.slice(at, to - at), text, _texts(flat, sizes[at:to].tolist(), decode_ids))
                at = to

    return df.mapInArrow(run, _with(df, text, "string"))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """For each row of docs its ids, their number, and the digest of the decoded text."""
    coded = encode(docs.select(F.col(key), F.col(text).alias("text")), "text", "ids", load_vocabulary(model), decoded="text")
    return coded.select(key, F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))
