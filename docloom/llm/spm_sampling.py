"""Distinct sampled segmentations of texts into SentencePiece vocabulary pieces, without replacement.

The lattice of a text has an edge for each vocabulary piece at each character (and a byte edge for characters that
no piece covers).  Edge weights give a distribution over all segmentations; ``k`` of them are drawn without
replacement by the Gumbel-top-k trick, found by best-first (A*) search from the root:

* backward sums over the lattice turn weights into conditional log-probabilities of the next piece, so the
  log-probability ``phi`` of all segmentations that share a prefix is known exactly: the search's bound is tight;
* the frontier holds regions of the search tree that no segmentation found so far is in.  A region's value is the
  largest Gumbel value in it: a Gumbel at its own ``phi``, conditioned on not exceeding its parent's value.  Siblings that
  nothing tells apart yet stay one region, so a text's frontier has a few regions for each segmentation, whatever its
  length: ranges of steps of a found path, with all that leaves the path there, and ranges of edges at one node;
* the frontier's best region is taken next: the step and edge at which it leaves the found path are drawn, then the rest
  of the text; what is left of the region is cut into regions again.  Segmentations come out by falling value: the first
  k are a sample without replacement.  The best value left gives the threshold ``kappa``, and a segmentation's inclusion
  score is ``1 - exp(-exp(phi - kappa))``, its chance to be above it.

Pieces never reach over a word's start mark but for runs of marks, which are cut after each ``MOST_MARKS``, so the
lattice is a chain of word lattices, each built once for every distinct word of a batch.  All words of all texts of a
batch advance together, one piece a step.  Random numbers are hashes of row key, sample, word and step: a row's samples
do not depend on its neighbours, batches or retries, and more samples leave the first ones as they are.

Weights: the vocabulary's order is a merge rank; a piece of rank r weighs ``-alpha * log(r + 2)`` (Zipf's law).

Defined results: null and empty texts have one segmentation, the start mark alone; if there are fewer than k
segmentations, all are returned with inclusion 1; repeated rows with equal keys give equal samples; a null key counts
as 0; of equal perturbed values the first edge wins; an empty table gives an empty table; extra columns are kept, and
one that already has the samples' name with ``_in`` behind it.  Memory grows with the longest text; ``with_samples``
returns all samples of an Arrow batch at once, unless a ``finish`` turns them into something smaller part by part.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ._names import quoted, with_result
from ._text import mix

MARK = "▁"
#: Where the vocabulary lies unless a path or the session's ``spark.docloom.vocabulary`` is given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Samples of each text: the operator's, unless it is given a number, and the query's, which digests the first ones by themselves too.
SAMPLES, QUERY_SAMPLES = 2, 8
#: The longest piece of marks alone.
MOST_MARKS = 16
#: Characters whose distinct words share one lattice, and that are sampled together; a text counts as TEXT_CHARS more for each sample.
LATTICE_CHARS, SAMPLE_CHARS, TEXT_CHARS = 2_000_000, 400_000, 40
_P = np.uint64(0x100000001B3)
_P_INVERSE = np.uint64(pow(0x100000001B3, -1, 2**64))
#: Steps of a path that are looked at together; a path this likely is left by its single steps' chances, not by its own.
_WINDOW, _SURE = 64, -1e-3


def _by_token(token: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The order by token, then by offset in it, in one key with room for the longest."""
    bits = int(offset.max()).bit_length() if len(offset) else 0
    return np.argsort((token << bits) + offset, kind="stable")


@dataclass(frozen=True)
class Trie:
    """Pieces by their letters in a double array: from state x letter c leads to y = base[x] + c if owner[y] == x."""

    letters: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    piece: np.ndarray

    @staticmethod
    def of(pieces: dict[str, int]) -> Trie:
        often = Counter("".join(pieces))
        letter = {c: i + 1 for i, (c, _) in enumerate(often.most_common())}
        letters = np.zeros(max(map(ord, letter)) + 2, np.int32)  # the last for any higher code
        for c, i in letter.items():
            letters[ord(c)] = i
        below: dict[str, list[str]] = {}
        for x in {p[:n] for p in pieces for n in range(1, len(p) + 1)}:
            below.setdefault(x[:-1], []).append(x)
        owner, base, state, low, free = [-1] * (4 * len(letter) + 8), {}, {"": 0}, {}, 1
        owner[0] = -2  # the root's own place
        slot_of: dict[str, int] = {}
        for x in sorted(below, key=lambda x: (-len(below[x]), x)):  # the widest first; the narrow ones fill the gaps
            codes = sorted(letter[y[-1]] for y in below[x])
            while free < len(owner) and owner[free] != -1:
                free += 1
            at = max(low.get(len(codes), 0), free - codes[0], 0)
            while True:
                if at + codes[-1] >= len(owner):
                    owner += [-1] * (len(owner) + codes[-1])
                if all(owner[at + c] == -1 for c in codes):
                    break
                at += 1
            low[len(codes)], base[x] = at, at
            for c, y in zip(codes, sorted(below[x], key=lambda y: letter[y[-1]]), strict=True):
                owner[at + c] = -3
                slot_of[y] = at + c
        state |= slot_of
        size = max(state.values()) + len(letter) + 2
        out = Trie(letters, np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32))
        for x, at in state.items():
            out.base[at] = base.get(x, 0)
            if x:
                out.owner[at] = state[x[:-1]]
            out.piece[at] = pieces.get(x, -1)
        return out


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that may be sampled; sent to the executors with the task, its size is the vocabulary's."""

    pieces: tuple[str, ...]
    weights: np.ndarray
    byte_ids: tuple[int, ...]
    byte_weight: float
    ids: np.ndarray
    longest: int
    is_byte: np.ndarray
    trie: Trie

    @staticmethod
    def load(path: str = MODEL, alpha: float = 1.0) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        pieces = tuple(m.id_to_piece(i) for i in range(n))
        score = np.array([m.get_score(i) for i in range(n)])
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if m.is_byte(i)}
        merged = (score > -1e8) | np.array([len(p) == 1 or not p.strip(MARK) for p in pieces])  # any others only split further
        usable = [i for i, p in enumerate(pieces) if merged[i] and not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)) and (MARK not in p[1:] or not p.strip(MARK)) and "\n" not in p]
        weights = -alpha * np.log(np.clip(-score, 0, n) + 2)
        ids = np.array(usable, np.int64)
        return Vocabulary(pieces, weights, tuple(byte_ids[b] for b in range(256)), float(-alpha * np.log(n + 2)), ids, max(len(pieces[i]) for i in usable), np.array([m.is_byte(i) for i in range(n)]), Trie.of({pieces[i]: i for i in usable}))


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts behind their start marks, with marks for spaces, as codes; where each text and each word begins."""
    code = np.frombuffer("".join([MARK + t for t in texts]).encode("utf-32-le"), np.uint32).copy()
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])[:-1]
    code[code == 32] = ord(MARK)
    mark, feed = code == ord(MARK), code == 10
    new = mark.copy()
    new[1:] &= ~mark[:-1]
    new[begins] = True
    if (mark[1:] & mark[:-1]).any():  # runs of marks are cut after each MOST_MARKS
        at = np.flatnonzero(mark)
        run = at[np.maximum.accumulate(np.where(new[at], np.arange(len(at)), 0))]
        new[at[(at - run) % MOST_MARKS == 0]] = True
    new |= feed
    new[1:] |= feed[:-1]
    return code, begins, np.flatnonzero(new)


def units(text: str) -> list[str]:
    """The start mark and the text with marks for spaces, cut at word starts and line feeds."""
    marked, (_, _, at) = MARK + text.replace(" ", MARK), _codes([text])
    return [marked[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(marked)], strict=True)]


def _distinct(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``at`` of distinct words, and the number of each word among them."""
    size = np.diff(np.append(at, len(code)))
    with np.errstate(over="ignore"):
        power = np.full(len(code) + 1, _P)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        power = np.full(len(code) + 1, _P_INVERSE)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        h = mix((total[at + size] - total[at]) * power[at] + size.astype(np.uint64))
    _, which, number = np.unique(h, return_index=True, return_inverse=True)
    other = at[which][number]
    alike = size == size[which][number]
    if alike.all() and (code[_ragged(other, size)] == code).all():
        return which, number
    words = [code[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist(), strict=True)]  # unequal words of one hash
    seen = {w: i for i, w in enumerate(dict.fromkeys(words))}
    number = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    return np.unique(number, return_index=True)[1], number


@dataclass
class Lattice:
    """Word lattices in compressed rows: edges of node n are ``first[n]:first[n + 1]``, the longest first; ``below`` is the
    chance of a node's edges up to each, past 1 for the last, ``next`` the first edge at an edge's end, -1 if there is none."""

    start: np.ndarray
    first: np.ndarray
    source: np.ndarray
    next: np.ndarray
    piece: np.ndarray
    logp: np.ndarray
    below: np.ndarray


def lattice(code: np.ndarray, size: np.ndarray, v: Vocabulary) -> Lattice:
    """The lattices of words one behind the other, with conditional log-probabilities; a negative piece -c - 1 is a character of several bytes."""
    end = np.cumsum(size + 1) - 1
    start = end - size
    chars = _ragged(start, size)  # the nodes; those at words' ends have no letter
    letter = np.zeros(len(code) + len(size), np.int32)
    letter[chars] = v.trie.letters[np.minimum(code, len(v.trie.letters) - 1)]
    count = np.zeros(len(letter), np.int64)
    at, state, found = chars, np.zeros(len(chars), np.int32), []
    for n in range(1, v.longest + 1):
        after = v.trie.base[state] + letter[at + n - 1]
        alive = np.flatnonzero(v.trie.owner[after] == state)
        at, state = at[alive], after[alive]
        piece = v.trie.piece[state]
        hit = np.flatnonzero(piece >= 0)
        where = at[hit]
        found.append((where, n, count[where], piece[hit].astype(np.int64)))
        count[where] += 1
        if n == 1:  # characters without a piece
            bare = np.flatnonzero(count[chars] == 0)
            rare, where = code[bare].astype(np.int64), chars[bare]
            found.append((where, 1, count[where], np.where(rare < 128, np.array(v.byte_ids, np.int64)[rare & 127], -rare - 1)))
            count[where] = 1
        if not len(at):
            break
    first = np.concatenate([[0], np.cumsum(count)])
    length, piece = (np.empty(first[-1], np.int32) for _ in range(2))
    for where, n, rank, what in found:
        e = first[where + 1] - 1 - rank
        length[e], piece[e] = n, what
    del found
    source = np.repeat(np.arange(len(count)), count)
    to = source + length
    known = np.maximum(piece, 0)
    weight = np.where(v.is_byte[known], v.byte_weight, v.weights[known])
    rare = np.flatnonzero(piece < 0)
    weight[rare] = v.byte_weight * (2 + (piece[rare] < -0x800) + (piece[rare] < -0x10000))
    beta = np.zeros(len(letter))
    left = np.repeat(end, size + 1) - np.arange(len(letter))
    own_left = left[source]
    by_left = np.argsort(own_left.astype(np.uint16) if len(left) and left.max() < 2**16 else own_left, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(own_left))])
    own, at, w = source[by_left], to[by_left], weight[by_left]
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    width, own = np.diff(np.append(heads, len(w))), own[heads]
    places = np.searchsorted(heads, bounds)
    for lo, hi, i, j in zip(bounds[:-1], bounds[1:], places[:-1], places[1:], strict=True):
        if lo == hi:
            continue
        value = w[lo:hi] + beta[at[lo:hi]]
        top = np.maximum.reduceat(value, heads[i:j] - lo)
        total = np.add.reduceat(np.exp(value - np.repeat(top, width[i:j])), heads[i:j] - lo)
        beta[own[i:j]] = top + np.log(total)
    logp = np.minimum(weight + beta[to] - beta[source], 0)
    logp[first[:-1][count == 1]] = 0
    below = np.exp(logp)
    rows, n = np.flatnonzero(count > 1), 1
    while len(rows):
        e = first[rows] + n
        below[e] += below[e - 1]
        n += 1
        rows = rows[count[rows] > n]
    below[first[1:][count > 0] - 1] = 2
    return Lattice(start, first, source, np.where(count > 0, first[:-1], -1)[to], piece, logp, below)


def _uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(seed ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))
    return ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


class Frontier:
    """Regions of each text's search tree, in rows by text: what leaves the path at ``path`` in steps ``a:hi`` (``lo`` is
    -1), or takes one of the edges ``lo:hi`` at step ``a`` of it.  ``base`` is the log-probability of the steps before,
    ``length`` that of the path's own steps, ``mass`` that of the region without ``base``."""

    SLOTS = 6
    NAMES = ("base", "length", "mass", "path", "a", "lo", "hi")

    def __init__(self, seeds: np.ndarray, k: int):
        self.seeds, shape = seeds, (len(seeds), self.SLOTS * k)
        self.value = np.full(shape, -np.inf)
        self.base, self.length, self.mass = (np.zeros(shape) for _ in range(3))
        self.path, self.a, self.lo, self.hi = (np.zeros(shape, np.int64) for _ in range(4))

    def add(self, docs: np.ndarray, place: int, bound: np.ndarray, **region) -> None:
        for name in self.NAMES:
            getattr(self, name)[docs, place] = region[name]
        gumbel = region["base"] + region["mass"] - np.log(-np.log(_uniform(self.seeds[docs], 8 + place)))
        self.value[docs, place] = -np.logaddexp(-bound, -gumbel)  # conditioned on the bound

    def pop(self) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        place = self.value.argmax(1)
        best = self.value[np.arange(len(place)), place]
        docs = np.flatnonzero(np.isfinite(best))
        place = place[docs]
        self.value[docs, place] = -np.inf
        return docs, best[docs], {name: getattr(self, name)[docs, place] for name in self.NAMES}


class Sampler:
    """``k`` segmentations of each of some texts; tokens are the texts' words one behind the other."""

    def __init__(self, g: Lattice, unit: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, k: int):
        self.g, self.k, self.seeds = g, k, seeds
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.edge = g.first[g.start[unit]]
        with np.errstate(over="ignore"):
            self.token_seed = mix(np.repeat(seeds, sizes) ^ mix(_ragged(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64) + np.uint64(0x51ED2701)))
        self.pool, self.used = np.empty(0, np.int64), 0

    def _walk(self, token: np.ndarray, edge: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Complete words from a node with the first edge ``edge``, or -1 at their end: the drawn edges in order, and each word's number of them."""
        g, steps = self.g, []
        count = np.zeros(len(token), np.int64)
        live = np.flatnonzero(edge >= 0)
        edge, seed = edge[live], self.token_seed[token[live]]
        while len(live):
            u = _uniform(seed, (sample << 32) + len(steps) + 1)
            more = np.flatnonzero(u >= g.below[edge])
            e, u = edge[more], u[more]
            while len(more):
                e += 1
                edge[more] = e
                on = np.flatnonzero(u >= g.below[e])
                more, e, u = more[on], e[on], u[on]
            steps.append((live, edge))
            count[live] = len(steps)
            after = g.next[edge]
            keep = np.flatnonzero(after >= 0)
            live, edge, seed = live[keep], after[keep], seed[keep]
        place = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int64)
        for n, (who, edge) in enumerate(steps):
            out[place[who] + n] = edge
        return out, count

    def _edges(self, lo: np.ndarray, hi: np.ndarray, without: np.ndarray) -> np.ndarray:
        """Log-probabilities of edges ``lo:hi`` in rows; -inf behind them and for the one left out."""
        at = lo[:, None] + np.arange(max(int((hi - lo).max(initial=0)), 1))
        use = (at < hi[:, None]) & (at != without[:, None])
        return np.where(use, self.g.logp[np.minimum(at, len(self.g.logp) - 1)], -np.inf)

    def _mass(self, lo: np.ndarray, hi: np.ndarray, without: np.ndarray) -> np.ndarray:
        return np.logaddexp.accumulate(self._edges(lo, hi, without), axis=1)[:, -1]

    def _choose(self, lo: np.ndarray, hi: np.ndarray, without: np.ndarray, u: np.ndarray) -> np.ndarray:
        w = self._edges(lo, hi, without)
        total = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
        return lo + (total > (u * total[:, -1])[:, None]).argmax(1)

    def _windows(self, path: np.ndarray, a: np.ndarray, b: np.ndarray, done: np.ndarray) -> Iterator[tuple]:
        """Steps ``a:b`` of paths, _WINDOW at a time: rows that are not done, their first step, edges, which of them count,
        and the log-probability of the steps before and with each."""
        rows, at, gone = np.arange(len(a)), a.copy(), np.zeros(len(a))
        while len(rows := rows[(at[rows] < b[rows]) & ~done[rows]]):
            step = at[rows, None] + np.arange(_WINDOW)
            use = step < b[rows, None]
            edge = self.pool[path[rows, None] + np.where(use, step, at[rows, None])]
            total = np.cumsum(np.concatenate([gone[rows, None], np.where(use, self.g.logp[edge], 0)], axis=1), axis=1)
            yield rows, at[rows], edge, use, total[:, :-1], total[:, 1:]
            gone[rows] = total[:, -1]
            at[rows] += _WINDOW

    def _leaving(self, edge: np.ndarray, use: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The log-probability of leaving a path at each step."""
        node, flat = self.g.source[edge].ravel(), edge.ravel()
        rest = self._mass(self.g.first[node], self.g.first[node + 1], flat).reshape(edge.shape)
        return np.where(use, before + rest, -np.inf)

    def _path_mass(self, path: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The log-probability of leaving a path in steps ``a:b``."""
        with np.errstate(divide="ignore"):
            out = np.log(-np.expm1(np.minimum(length, 0)))
        near = np.flatnonzero(length >= _SURE)
        out[near] = -np.inf
        for rows, _, edge, use, before, _ in self._windows(path[near], a[near], b[near], np.zeros(len(near), bool)):
            here = np.logaddexp.accumulate(self._leaving(edge, use, before), axis=1)[:, -1]
            out[near[rows]] = np.logaddexp(out[near[rows]], here)
        return out

    def _leave(self, path: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, mass: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step at which to leave a path, and the log-probability of the steps before it."""
        near = length >= _SURE
        goal = np.log1p(u * np.expm1(np.minimum(length, 0)))
        step, gone = a.copy(), np.zeros(len(a))
        done, share = np.zeros(len(a), bool), np.zeros(len(a))
        for rows, at, edge, use, before, after in self._windows(path, a, b, done):
            can = use & (after < before)
            here = can & (after < goal[rows, None])
            n = np.flatnonzero(near[rows])
            if len(n):
                part = np.exp(self._leaving(edge[n], use[n], before[n]) - mass[rows[n], None])
                total = np.cumsum(np.concatenate([share[rows[n], None], part], axis=1), axis=1)
                share[rows[n]] = total[:, -1]
                can[n] = part > 0
                here[n] = can[n] & (total[:, 1:] > u[rows[n], None])
            hit = here.any(1)
            last = _WINDOW - 1 - can[:, ::-1].argmax(1)  # by rounding the goal may lie behind all steps
            j = np.where(hit, here.argmax(1), last)
            some = np.flatnonzero(hit | can.any(1))
            step[rows[some]], gone[rows[some]] = at[some] + j[some], before[some, j[some]]
            done[rows[hit]] = True
        return step, gone

    def _store(self, n: int) -> int:
        """Room for n more edges of paths."""
        if self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(self.used, n), np.int64)])
        self.used += n
        return self.used - n

    def run(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each sample: (docs that have it, phi, value, their numbers of edges, edges); and kappa as ``self.kappa``."""
        g, n_docs = self.g, len(self.first) - 1
        frontier, results = Frontier(self.seeds, self.k), []
        docs, value = np.arange(n_docs), -np.log(-np.log(_uniform(self.seeds, 0)))
        token, edge, heads = np.arange(len(self.edge)), self.edge, self.first[:-1]
        shared, base = np.zeros(n_docs, np.int64), np.zeros(n_docs)  # steps and log-probability of what is not drawn anew
        for sample in range(self.k):
            slot = sample * Frontier.SLOTS
            if sample:
                docs, value, r = frontier.pop()
                if not len(docs):
                    break
                u, v = (_uniform(self.seeds[docs], 8 + slot + (1 << 40) + i) for i in range(2))
                of_path = r["lo"] < 0
                step, gone = r["a"].copy(), np.zeros(len(docs))
                p = np.flatnonzero(of_path)
                step[p], gone[p] = self._leave(r["path"][p], r["a"][p], r["hi"][p], r["length"][p], r["mass"][p], u[p])
                old = self.pool[r["path"] + step]
                at = g.source[old]
                lo, hi = (np.where(of_path, g.first[at + i], r[name]) for i, name in enumerate(("lo", "hi")))
                chosen = self._choose(lo, hi, np.where(of_path, old, -1), v)
                base = r["base"] + gone
                x, y = np.where(of_path, np.minimum(old, chosen), chosen), np.where(of_path, np.maximum(old, chosen), chosen)
                none = np.full(len(docs), -1)
                for i, (c, d) in enumerate(((lo, x), (x + 1, y), (y + 1, hi))):
                    frontier.add(docs, slot + 3 + i, value, base=base, length=0.0, mass=self._mass(c, d, none), path=r["path"], a=step, lo=c, hi=d)
                for i, (c, d, before, length) in enumerate(((r["a"], step, r["base"], gone), (step + 1, r["hi"], base + g.logp[old], r["length"] - gone - g.logp[old]))):
                    c, d, length = c[p], d[p], np.minimum(length[p], 0)
                    frontier.add(docs[p], slot + 1 + i, value[p], base=before[p], length=length, mass=self._path_mass(r["path"][p], c, d, length), path=r["path"][p], a=c, lo=-1, hi=d)
                base = base + g.logp[chosen]
                head = self.pool[_ragged(r["path"], step)]
                closes = np.concatenate([[0], np.cumsum(g.next[head] < 0)])
                ends = np.cumsum(step)
                at = self.first[docs] + closes[ends] - closes[ends - step]
                left = self.first[docs + 1] - at
                token, heads = _ragged(at, left), np.cumsum(left) - left
                edge = self.edge[token]
                edge[heads] = g.next[chosen]
                shared = step + 1
            edges, count = self._walk(token, edge, sample)
            drawn = np.add.reduceat(count, heads)
            length = np.zeros(len(docs))
            some = drawn > 0
            if len(edges):
                length[some] = np.add.reduceat(g.logp[edges], (np.cumsum(drawn) - drawn)[some])
            size = shared + drawn
            path = self._store(int(size.sum())) + np.cumsum(size) - size
            if sample:
                self.pool[_ragged(path, step)] = head
                self.pool[path + step] = chosen
                self.pool[_ragged(path + shared, drawn)] = edges
            else:
                self.pool[: self.used] = edges
            results.append((docs, base + length, value, size, path))
            frontier.add(docs, slot, value, base=base, length=length, mass=self._path_mass(path, shared, size, length), path=path, a=shared, lo=-1, hi=size)
        self.kappa = frontier.value.max(1)
        return [(docs, phi, value, size, self.pool[path[0] : path[0] + size.sum()]) for docs, phi, value, size, path in results]


def _expand(pieces: np.ndarray, size: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, and how many each of some texts has; a bare character becomes its bytes."""
    bare = np.flatnonzero(pieces < 0)
    if not len(bare):
        return pieces.astype(np.int32), size
    data = [chr(-p - 1).encode("utf-8", "surrogatepass") for p in pieces[bare].tolist()]
    width = np.ones(len(pieces), np.int64)
    width[bare] = [len(x) for x in data]
    out = np.repeat(pieces, width).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(width)])
    out[_ragged(ends[bare], width[bare])] = np.array(v.byte_ids, np.int32)[np.frombuffer(b"".join(data), np.uint8)]
    bounds = ends[np.concatenate([[0], np.cumsum(size)])]
    return out, np.diff(bounds)


@dataclass
class Part:
    """Samples of some texts, text by text, best value first: ``found`` for each text, ``sizes`` and ``ids`` for each sample."""

    found: np.ndarray
    sizes: np.ndarray
    ids: list[np.ndarray]
    phi: np.ndarray
    value: np.ndarray
    inclusion: np.ndarray


def _parts(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges that sum up to ``most`` at most, or hold one."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def sample_parts(texts: Sequence[str], seeds: np.ndarray, v: Vocabulary, k: int) -> Iterator[Part]:
    for lo, hi in _parts([len(t) + 1 for t in texts], LATTICE_CHARS):
        code, begins, at = _codes(texts[lo:hi])
        which, unit = _distinct(code, at)
        size = np.diff(np.append(at, len(code)))[which]
        g = lattice(code[_ragged(at[which], size)], size, v)
        first = np.append(np.searchsorted(at, begins), len(at))
        del code, at
        for a, b in _parts([len(t) + 1 + TEXT_CHARS * k for t in texts[lo:hi]], SAMPLE_CHARS):
            yield _sample_part(g, unit[first[a] : first[b]], np.diff(first[a : b + 1]), seeds[lo + a : lo + b], v, k)


def sample_texts(texts: Sequence[str], seeds: np.ndarray, v: Vocabulary, k: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples as (ids, log-probability, perturbed value, inclusion), best value first."""
    for p in sample_parts(texts, seeds, v, k):
        rows = list(zip(p.ids, p.phi.tolist(), p.value.tolist(), p.inclusion.tolist(), strict=True))
        ends = np.cumsum(p.found)
        for a, b in zip((ends - p.found).tolist(), ends.tolist(), strict=True):
            yield rows[a:b]


def _sample_part(g: Lattice, unit: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, v: Vocabulary, k: int) -> Part:
    s = Sampler(g, unit, sizes, seeds, k)
    ids, lengths, drawn = [], [], s.run()
    for _, _, _, size, edges in drawn:
        out, size = _expand(g.piece[edges], size, v)
        ids += np.split(out, np.cumsum(size)[:-1])
        lengths.append(size)
    docs, phi, value = (np.concatenate([r[i] for r in drawn]) for i in range(3))
    order = _by_token(docs, np.repeat(np.arange(len(drawn)), [len(r[0]) for r in drawn]))
    with np.errstate(over="ignore"):
        inclusion = -np.expm1(-np.exp(phi - s.kappa[docs]))
    return Part(np.bincount(docs, minlength=len(sizes)), np.concatenate(lengths)[order], [ids[i] for i in order], phi[order], value[order], inclusion[order])


def decode(ids: Sequence[int], v: Vocabulary) -> str:
    """The text of a segmentation."""
    as_byte = {i: b for b, i in enumerate(v.byte_ids)}
    data = b"".join(bytes([as_byte[i]]) if i in as_byte else v.pieces[i].encode() for i in ids)
    return data.decode("utf-8", "surrogatepass").replace(MARK, " ")[1:]


_SAMPLE = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("value", pa.float64()), ("inclusion", pa.float64())]))


def sampler(v: Vocabulary, k: int = SAMPLES, finish: Callable[[pa.Array], pa.Array] | None = None, made: pa.DataType = _SAMPLE):
    """A column function (text, key) -> array of (ids, log_prob, value, inclusion), or what ``finish`` makes of it, of type ``made``."""

    @F.arrow_udf(from_arrow_type(made))
    def sample(texts: pa.Array, keys: pa.Array) -> pa.Array:
        seeds = mix(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))
        done = []
        for part in sample_parts([x or "" for x in texts.to_pylist()], seeds, v, k):
            lists = pa.ListArray.from_arrays(_offsets(part.sizes), np.concatenate([*part.ids, np.zeros(0, np.int32)]))
            inner = pa.StructArray.from_arrays([lists, pa.array(part.phi), pa.array(part.value), pa.array(part.inclusion)], fields=list(_SAMPLE.value_type))
            found = pa.ListArray.from_arrays(_offsets(part.found), inner)
            done.append(finish(found) if finish else found)
        return pa.concat_arrays(done) if done else pa.array([], made)

    return sample


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


_DIGEST = pa.struct([("n_samples", pa.int64()), ("n_pieces", pa.int64()), ("ids_hash", pa.string()), ("log_prob", pa.list_(pa.float64())), ("inclusion", pa.list_(pa.float64())), ("decoded_sha256", pa.string()), ("n_drawn", pa.int64()), ("drawn_pieces", pa.int64()), ("drawn_hash", pa.string()), ("drawn_log_prob", pa.list_(pa.float64())), ("drawn_inclusion", pa.list_(pa.float64()))])


def decoder(v: Vocabulary):
    """A function from ids to UTF-8 bytes, for many texts."""
    as_byte = {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
    table = np.array([as_byte.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)], object)
    return lambda ids: b"".join(table[ids])[1:]


def digested(v: Vocabulary) -> Callable[[pa.Array], pa.Array]:
    """How many samples and pieces, a hash of all ids, each sample's log-probability and inclusion, and a hash of the
    text that the first sample decodes to, as if ``SAMPLES`` had been drawn; then the same of all that were drawn.
    The threshold of the first few is the value of the sample behind them."""
    decoded = decoder(v)

    def run(samples: pa.Array) -> pa.Array:
        rows = []
        offsets, inner = samples.offsets.to_numpy(), samples.values
        lists = inner.field("ids")
        ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
        log_prob, value, inclusion = (inner.field(name).to_numpy() for name in ("log_prob", "value", "inclusion"))
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            h, c = xxhash.xxh3_128(), min(a + SAMPLES, b)
            for i in range(a, b):
                h.update(ids[ends[i] : ends[i + 1]].astype("<i4").tobytes() + b"\xff\xff\xff\xff")
                if i == c - 1:
                    first = h.hexdigest()
            with np.errstate(over="ignore"):
                chance = -np.expm1(-np.exp(log_prob[a:c] - value[c])) if c < b else inclusion[a:c]
            one = hashlib.sha256(decoded(ids[ends[a] : ends[a + 1]])).hexdigest()
            few = {"n_samples": c - a, "n_pieces": int(ends[c] - ends[a]), "ids_hash": first, "log_prob": log_prob[a:c], "inclusion": chance, "decoded_sha256": one}
            rows.append(few | {"n_drawn": b - a, "drawn_pieces": int(ends[b] - ends[a]), "drawn_hash": h.hexdigest(), "drawn_log_prob": log_prob[a:b], "drawn_inclusion": inclusion[a:b]})
        return pa.array(rows, _DIGEST)

    return run


def digest(v: Vocabulary):
    """A column function of ``digested``."""
    run = digested(v)

    @F.arrow_udf(from_arrow_type(_DIGEST))
    def column(samples: pa.Array) -> pa.Array:
        return run(samples)

    return column


def _vocabulary(docs: DataFrame, model: str | None, alpha: float) -> Vocabulary:
    return Vocabulary.load(model or docs.sparkSession.conf.get("spark.docloom.vocabulary", MODEL), alpha)


def with_samples(docs: DataFrame, key: Column, text_col: str = "text", k: int = SAMPLES, model: str | None = None, alpha: float = 1.0, name: str = "samples", finish: Callable | None = None, made: pa.DataType = _SAMPLE) -> DataFrame:
    """``docs`` with ``name``: k distinct segmentations of the text, drawn by ``key``.

    The vocabulary file is ``model``, else what the session's ``spark.docloom.vocabulary`` names, else ``MODEL``; the
    driver alone reads it.  ``finish``, given the vocabulary, makes a function from an Arrow array of samples to one of
    type ``made``, which ``name`` has instead; it gets the samples in parts, so that no batch holds all of them.
    """
    v = _vocabulary(docs, model, alpha)
    seed = F.xxhash64(F.coalesce(key, F.lit(0)))
    return with_result(docs, name, sampler(v, k, finish(v) if finish else None, made)(quoted(text_col).cast("string"), seed))


def op6_piece_sampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_samples(docs, F.col("doc_id"), k=QUERY_SAMPLES, name="d", finish=digested, made=_DIGEST).select("doc_id", "d.*")
