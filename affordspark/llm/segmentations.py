"""SentencePiece encoding and decoding with sampled segmentations.

For every text the k segmentations with the highest Gumbel-perturbed
log-probabilities are emitted: a sample of distinct segmentations without
replacement. The search is A* over the lattice of pieces. A node is a path
prefix with the choices that are ruled out after it; its priority is the
largest perturbed value below it, which is known before it is opened, because
the maximum of Gumbels is a Gumbel of the summed mass, truncated at the value
of the node it comes from. So each node that is taken from the queue yields one
segmentation, in descending order, and nothing is searched in vain.

The lattice's mass comes from a backward log-sum over the pieces that start at
each character. It factors at places that no piece crosses (before a run of
spaces), so equal words share one lattice, which a worker remembers; the new
lattices of a slice of texts are built together, and all paths through them are
walked together with numpy. Random numbers are hashes
of the row key, so neither partitions nor batches change a sample.

Piece weights are Zipf's law over the model's merge ranks (-score):
log p = -log(rank + 1) / temperature + const. The vocabulary is given; nothing
is trained.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import compress, count, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.llm import arrays
from affordspark.llm.token_counts import _words, encoder

U64 = np.uint64
_SPACE = "▁"
_P = U64(0x9E3779B97F4A7C15)
_SPREAD = U64(0xD1342543DE82EF95)
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
# second counters of the draws that are not steps of a walk
_ROOT, _NODE, _PICK, _REST = (x << 40 for x in (1, 2, 3, 4))
SLICE = 3 << 19  # text bytes whose paths are searched together; a longer text goes by blocks
BLOCK_CHARS = 1 << 17  # characters of a block, unless a piece can cross all of its places
MOST_EDGES, MOST_UNITS = 2_000_000, 200_000  # remembered by a worker; the slice at hand may need more
WALKED = 1 << 17  # units that are walked at a time
_DECODED = 1 << 16  # tokens decoded at a time, unless a run has more
_FIRST = 512  # edges of a path whose nodes are made with those of the other paths
_HIGHEST = 38.0  # above -log(-log u) for the largest u that _uniform gives
_NEAR, _PER_CHAR = 100, 2.5  # characters from the end up to which mass is summed as such, scaled by exp(2.5) a character
_opened: dict[tuple[str, float], "Vocabulary"] = {}


def _uniform(base, a=0, b=0) -> np.ndarray:
    """In (0, 1), from a hashed base and two counters."""
    with np.errstate(over="ignore"):
        h = arrays.mix(np.asarray(base, dtype=U64) + np.asarray(a, dtype=U64) * _A + np.asarray(b, dtype=U64) * _B)
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class Vocabulary:
    def __init__(self, path: str, temperature: float):
        e = encoder(path)
        m = e.model
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        self.words_stand_alone = e.words_stand_alone
        # neighbouring characters inside pieces; no piece crosses any other place
        self.inside = np.sort(np.array([(ord(p[0]) << 32) | ord(p[1]) for p in e.inside], dtype=np.int64))
        self.unknown = m.unk_id()
        self.bytes_at = {}
        weight = np.zeros(n)
        self.raw: list[bytes] = []
        plain = {}
        for i, p in enumerate(pieces):
            if m.is_byte(i):
                self.bytes_at[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                self.raw.append(b"")
            else:
                plain[p] = i
                self.raw.append(p.encode())
        rank = np.array([n if i in self.bytes_at.values() or i == self.unknown else -m.get_score(i) for i in range(n)])
        weight = -np.log(np.maximum(rank, 0) + 1.0) / temperature
        self.weight = weight - np.log(np.exp(weight[list(plain.values())]).sum())
        self.longest = max(map(len, plain))
        # all beginnings of pieces, by hash: the id of the piece or -1
        starts: dict[str, int] = {}
        for p, i in plain.items():
            for j in range(1, len(p)):
                starts.setdefault(p[:j], -1)
        starts.update(plain)
        h = np.array([self._hash(p) for p in starts], dtype=U64)
        ids = np.array(list(starts.values()), dtype=np.int64)
        order = np.argsort(h)
        self.keys, self.ids = h[order], ids[order]
        if len(np.unique(h)) != len(h):
            raise ValueError("hashes of pieces collide")
        self.first = np.searchsorted(self.keys, np.arange((1 << 18) + 1, dtype=U64) << U64(46), side="left").astype(np.int64)
        self.first[-1] = len(self.keys)
        self.most = int(np.diff(self.first).max())
        # flat bytes of the pieces, for decoding
        self.flat = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.sizes = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_P) + ord(c) + 1) & (2**64 - 1)
        return h * int(_SPREAD) & (2**64 - 1)

    def find(self, running: np.ndarray) -> np.ndarray:
        """For running hashes: the piece's id, -1 for a mere beginning of
        pieces, -2 if no piece begins so."""
        h = running * _SPREAD  # odd: equal only for equal running hashes
        bucket = (h >> U64(46)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(h), -2, dtype=np.int64)
        todo = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.keys[at[todo]] == h[todo]
            out[todo[hit]] = self.ids[at[todo[hit]]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
            if not len(todo):
                break
        return out

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids, spaces still marked."""
        if len(first) > 2 and first[-1] - first[0] > _DECODED:  # the index arrays below take 24 bytes for each byte
            half = max(1, min(len(first) - 2, int(np.searchsorted(first, (first[0] + first[-1]) // 2))))
            return self.decode(ids, first[:half + 1]) + self.decode(ids, first[half:])
        ids, first = ids[first[0]:first[-1]], first - first[0]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.at[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[first]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def split_units(units: list[str], v: Vocabulary):
    """Units, each with the space that the model puts before it, cut at all
    places that no piece crosses. Returns the code points,
    lengths and hashes of the distinct parts, the parts of all units one after
    the other, and where each unit's begin. Parts are told apart by 64-bit
    hashes."""
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units)) + 1
    ends = np.cumsum(lengths)
    marked = (_SPACE + _SPACE.join(units)).replace(" ", _SPACE) if units else ""
    code = np.frombuffer(marked.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if not len(code):
        return code, np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(units) + 1, np.int64)
    pair = (code[:-1] << 32) | code[1:]
    at = np.minimum(np.searchsorted(v.inside, pair), len(v.inside) - 1)
    begins = np.ones(len(code), dtype=bool)
    begins[1:] = v.inside[at] != pair
    begins[ends - lengths] = True
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, len(code)))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(arrays.mix(code.astype(U64)) * arrays._power(arrays._BASE, len(code)))])
        h = (sums[start + size] - sums[start]) * arrays._power(arrays._INVERSE, len(code))[start] + size.astype(U64)
    told, one, parts = np.unique(h, return_index=True, return_inverse=True)
    part_size = size[one]
    upto = np.cumsum(part_size)
    chars = code[np.repeat(start[one] - (upto - part_size), part_size) + np.arange(upto[-1])]
    return chars, part_size, told, parts, np.append(np.searchsorted(start, ends - lengths), len(start))


def vocabulary(path: str, temperature: float) -> Vocabulary:
    if (path, temperature) not in _opened:
        _opened[path, temperature] = Vocabulary(path, temperature)
    return _opened[path, temperature]


class Lattice:
    """The lattices of many units, one after the other.

    ``row[p] .. row[p + 1]`` are the edges that start at position p; an edge has
    a piece, the position where it ends and q, the share of p's mass that goes
    through it. A unit's positions are ``begin[u] .. begin[u + 1] - 1``, the last
    one is its end."""

    def __init__(self, chars: np.ndarray, lengths: np.ndarray, v: Vocabulary):
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])  # one position more for each unit's end
        n = int(self.begin[-1])
        code = np.zeros(n, dtype=U64)
        code[np.arange(len(chars)) + np.repeat(np.arange(len(lengths)), lengths)] = chars
        left = np.repeat(self.begin[1:] - 1, lengths + 1) - np.arange(n)  # characters up to the unit's end
        live = np.flatnonzero(left > 0)
        running = np.zeros(n, dtype=U64)
        src, dst, piece = [], [], []
        with np.errstate(over="ignore"):
            for size in range(1, v.longest + 1):
                live = live[left[live] >= size]
                if not len(live):
                    break
                running[live] = running[live] * _P + code[live + size - 1] + U64(1)
                found = v.find(running[live])
                hit = found >= 0
                src.append(live[hit].astype(np.int32))
                dst.append((live[hit] + size).astype(np.int32))
                piece.append(found[hit].astype(np.int32))
                if size == 1:
                    alone = live[~hit]  # no piece of their own: bytes, or unknown
                    src.append(alone.astype(np.int32))
                    dst.append((alone + 1).astype(np.int32))
                    piece.append(-code[alone].astype(np.int32) - 1)
                live = live[found != -2]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int32)
        src, dst, piece = join(src), join(dst), join(piece)
        order = np.argsort(src, kind="stable")
        src, self.dst, self.piece = src[order], dst[order], piece[order]
        del order, dst, piece, running, live
        counts = np.bincount(src, minlength=n)
        self.row = np.concatenate([[0], np.cumsum(counts)])
        weight = np.empty(len(src))
        known = self.piece >= 0
        weight[known] = v.weight[self.piece[known]]
        weight[~known] = v.weight[self._fallback(v)] * self._byte_counts(-self.piece[~known] - 1, v)
        # backward sums, by distance from the end: scaled mass, far from the end its log
        far = left[src]
        by = np.argsort(far.astype(np.uint16) if n and int(left.max()) < 1 << 16 else far, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(far)[1:])]) if len(far) else np.zeros(1, dtype=np.int64)
        near = np.exp(weight + _PER_CHAR * (self.dst - src))
        mass, beta = np.ones(n), np.zeros(n)
        for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), start=1):
            if b == a:
                continue
            e = by[a:b]
            s = src[e]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            if d <= _NEAR:
                mass[s[new]] = np.add.reduceat(near[e] * mass[self.dst[e]], new)
                continue
            if d == _NEAR + 1:
                close = left <= _NEAR
                beta[close] = np.log(mass[close]) - _PER_CHAR * left[close]
            x = weight[e] + beta[self.dst[e]]
            top = np.maximum.reduceat(x, new)
            x = np.exp(x - np.repeat(top, np.diff(np.append(new, len(e)))))
            beta[s[new]] = top + np.log(np.add.reduceat(x, new))
        if len(cuts) <= _NEAR + 1:
            beta = np.log(mass) - _PER_CHAR * left
        del near, by, far, cuts
        self.log_q = np.minimum(weight + beta[self.dst] - beta[src], 0.0)
        del weight, beta, mass
        q = np.exp(self.log_q)
        # mass up to and with each edge, and of all other edges of its row
        sums = np.cumsum(q)
        begins = self.row[src]
        self.upto = sums - (sums[begins] - q[begins])
        del sums
        others = 1.0 - q
        others[counts[src] == 1] = 0.0
        close = np.flatnonzero((others < 1e-7) & (counts[src] > 1))  # too close to 1 to subtract
        others[close] = 0.0
        for j in range(int(counts.max()) if n else 0):
            e = begins[close] + j
            ok = (j < counts[src[close]]) & (e != close)
            others[close[ok]] += q[e[ok]]
        with np.errstate(divide="ignore"):
            self.log_others = np.log(others)

    @staticmethod
    def _fallback(v: Vocabulary) -> int:
        return v.bytes_at.get(0, v.unknown)

    @staticmethod
    def _byte_counts(code: np.ndarray, v: Vocabulary) -> np.ndarray:
        return (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)) if v.bytes_at else np.ones(len(code))

    def walk(self, position: np.ndarray, key: np.ndarray, sample: int, which: np.ndarray):
        """Random paths from each position to its unit's end: edges in order
        and the number of edges of each. ``which`` numbers the units within
        their text."""
        made = [self._walked(*(x[a:a + WALKED] for x in (position, key)), sample, which[a:a + WALKED]) for a in range(0, len(position), WALKED)]
        return tuple(np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _walked(self, position: np.ndarray, key: np.ndarray, sample: int, which: np.ndarray):
        n = len(position)
        more = self.row[1:] > self.row[:-1]  # positions before a unit's end
        who = np.flatnonzero(more[position])
        at = position[who]
        with np.errstate(over="ignore"):
            base = (_mixed(key, sample) + which * _A)[who]
        steps, counts, step = [], np.zeros(n, dtype=np.int64), 0
        while len(who):
            u = _uniform(base, 0, step)
            e = self.row.take(at)
            todo = np.flatnonzero(self.upto.take(e) <= u)
            if len(todo):
                last = self.row.take(at[todo] + 1) - 1
                todo, last = todo[e[todo] < last], last[e[todo] < last]
                while len(todo):
                    e[todo] += 1
                    on = (e[todo] < last) & (self.upto.take(e[todo]) <= u[todo])
                    todo, last = todo[on], last[on]
            steps.append((who, e))
            counts[who] += 1
            at = self.dst.take(e).astype(np.int64)
            on = more.take(at)
            if not on.all():
                who, at, base = who[on], at[on], base[on]
            step += 1
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for i, (x, e) in enumerate(steps):
            out[begin[x] + i] = e
        return out, counts


class Memo:
    """Lattices of the units that a worker has met, one growing lattice; begun
    anew when it is large. Equal parts share their place whatever the unit."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.unit: defaultdict[str, int] = defaultdict(count().__next__)
        self.part: dict[int, int] = {}
        self.n = {"begin": 0, "row": 1, "edge": 0, "part": 0, "part_at": 1}  # used of the arrays
        self.held = {"begin": np.zeros(1 << 10, np.int64), "row": np.zeros(1 << 10, np.int64), "part": np.zeros(1 << 10, np.int64), "part_at": np.zeros(1 << 10, np.int64)}
        self.held |= {n: np.zeros(1 << 10, t) for n, t in _EDGES.items()}

    def _put(self, name: str, count: str, new: np.ndarray) -> None:
        have, n = self.held[name], self.n[count]
        if n + len(new) > len(have):
            grown = np.zeros(max(len(have) * 5 // 4, n + len(new)), have.dtype)
            grown[:n] = have[:n]
            self.held[name] = have = grown
        have[n:n + len(new)] = new

    def _add(self, lat: Lattice) -> None:
        positions, edges = self.n["row"] - 1, self.n["edge"]
        self._put("begin", "begin", lat.begin[:-1] + positions)
        self._put("row", "row", lat.row[1:] + edges)
        for name in _EDGES:
            self._put(name, "edge", getattr(lat, name) + (positions if name == "dst" else 0))
        self.n["begin"] += len(lat.begin) - 1
        self.n["row"] += len(lat.row) - 1
        self.n["edge"] += len(lat.dst)

    def lattice(self) -> Lattice:
        out = Lattice.__new__(Lattice)
        out.begin, out.row = self.held["begin"][:self.n["begin"]], self.held["row"][:self.n["row"]]
        for name in _EDGES:
            setattr(out, name, self.held[name][:self.n["edge"]])
        return out

    def units(self, texts: list[str]) -> list[np.ndarray]:
        """Unit numbers of every text; new units are made."""
        if self.n["edge"] > MOST_EDGES or len(self.unit) > MOST_UNITS:
            self.clear()
        known, before = self.unit, len(self.unit)  # a new unit gets the next number
        numbers: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self.v.words_stand_alone and not ("  " in t or _SPACE in t or t[0] == " ")]
        if plain:  # single spaces alone: equal words of the slice are looked up once
            cut = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), pattern=" ")
            told = cut.values.dictionary_encode()
            words = told.dictionary.to_numpy(zero_copy_only=False).tolist()  # (to_pylist makes a scalar of each first)
            number = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
            flat, ends = number[np.asarray(told.indices)], np.asarray(cut.offsets)
            for i, a, b in zip(plain, ends[:-1].tolist(), ends[1:].tolist()):
                numbers[i] = flat[a:b]
        for i, t in enumerate(texts):
            if numbers[i] is None:
                words = (_words(t) if self.v.words_stand_alone else [t]) if t else ()
                numbers[i] = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        new = list(islice(known, before, None))
        if new:
            chars, sizes, told, parts, part_at = split_units(new, self.v)
            told = told.tolist()
            number = np.fromiter(map(self.part.get, told, repeat(-1)), dtype=np.int64, count=len(told))
            fresh = number < 0
            if fresh.any():
                first = len(self.part)
                number[fresh] = np.arange(first, first + int(fresh.sum()))
                self.part.update(zip(compress(told, fresh), range(first, first + int(fresh.sum()))))
                chars, sizes = chars[np.repeat(fresh, sizes)], sizes[fresh]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                cuts = [0]  # of the lattice's own arrays, some hundred bytes a character, no more than a block's at a time
                while cuts[-1] < len(sizes):
                    cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + BLOCK_CHARS, side="right")) - 1))
                for a, b in zip(cuts, cuts[1:]):
                    self._add(Lattice(chars[ends[a]:ends[b]], sizes[a:b], self.v))
            self._put("part_at", "part_at", part_at[1:] + self.n["part"])
            self._put("part", "part", number[parts])
            self.n["part_at"] += len(new)
            self.n["part"] += len(parts)
        return numbers


_EDGES = {"dst": np.int32, "piece": np.int32, "log_q": np.float64, "upto": np.float64, "log_others": np.float64}
_memos: dict[tuple[str, float], Memo] = {}


def _mixed(key, sample):
    with np.errstate(over="ignore"):
        return arrays.mix(np.asarray(key, dtype=U64) * U64(0xD1342543DE82EF95) + U64(sample))


_ALL = 2**64 - 1


def _mix1(x: int) -> int:
    """arrays.mix of one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def _mixed1(key: int, sample: int) -> int:
    return _mix1((key * 0xD1342543DE82EF95 + sample) & _ALL)


def _uniform1(base: int, a: int, b: int) -> float:
    return ((_mix1((base + a * int(_A) + b * int(_B)) & _ALL) >> 11) + 0.5) * 2.0 ** -53


def _truncated(phi, bound, u):
    """Gumbel of location phi below the bound."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        g = phi - np.log(np.exp(np.minimum(phi - bound, 700.0)) - np.log(u))
    return np.where(np.isneginf(phi), -np.inf, np.minimum(g, bound))


class Paths:
    """The emitted segmentations of one text and the queue of what is left."""

    def __init__(self, key: int):
        self.key, self.found, self.queue = key, [], []  # found: (value, edges, units' counts)
        self.ruled_out: dict[tuple[int, int], list[int]] = {}

    def extend(self, lat: Lattice, s: int, fresh: int, values: list, before: float, at: int, size: int, wanted: int):
        """Queues the nodes that branch off path s at its edges from ``fresh``
        on; ``values`` are those up to edge ``at``, before which the path has
        the log-probability ``before``.

        Only ``wanted`` more nodes are ever taken. A node's value is at most
        its mass plus _HIGHEST, and masses fall along a path, so nodes after
        the place where that bound is below ``wanted`` known values are not
        made."""
        value, edges, _ = self.found[s]
        base = None
        while True:
            known = np.concatenate(values) if len(values) > 1 else values[0]
            if at >= len(edges) or len(known) >= wanted and np.partition(known, -wanted)[-wanted] > before + _HIGHEST:
                break
            base = base or _mixed1(self.key, s)
            part = edges[at:at + size]
            logs = lat.log_q[part]
            sums = np.cumsum(logs)
            phi = before + (sums - logs) + lat.log_others[part]
            values.append(_truncated(phi, value, _uniform(U64(base), np.arange(at, at + len(part)), _NODE)))
            before += float(sums[-1])
            at += len(part)
            size *= 4
        self.queue.append([s, fresh, known])

    def pop(self):
        """(value, sample, edge number) of the best node left, or None."""
        best, where = -np.inf, None
        for i, (s, fresh, values) in enumerate(self.queue):
            j = int(values.argmax())
            if values[j] > best:
                best, where = float(values[j]), (i, s, fresh + j, j)
        if where is None:
            return None
        self.queue[where[0]][2][where[3]] = -np.inf
        return best, where[1], where[2]

    def best(self) -> float:
        return max((float(v.max()) for _, _, v in self.queue), default=-np.inf)

    def branch(self, lat: Lattice, value: float, s: int, j: int):
        """The edge taken at a popped node, at random among those not yet ruled
        out there; what then remains of the node goes back to the queue."""
        edges = self.found[s][1]
        gone = self.ruled_out.setdefault((s, j), [int(edges[j])])
        a = int(np.searchsorted(lat.row, edges[j], side="right")) - 1
        left = [e for e in range(int(lat.row[a]), int(lat.row[a + 1])) if e not in gone]
        q = np.exp(lat.log_q[left])
        base = _mixed1(self.key, len(self.found))
        u = _uniform1(base, j, _PICK) * q.sum()
        e = left[min(int(np.searchsorted(np.cumsum(q), u, side="right")), len(left) - 1)]
        gone.append(e)
        left.remove(e)
        if left:
            logs = lat.log_q[edges[:j]].sum()
            q = np.exp(lat.log_q[left])
            phi = logs + np.log(q.sum()) if q.sum() > 0 else -np.inf
            again = _truncated(np.array([phi]), value, np.array([_uniform1(base, j, _REST)]))
            for entry in self.queue:
                if entry[0] == s and entry[1] <= j:
                    entry[2][j - entry[1]] = again[0]
        return e


def add_paths(lat: Lattice, new: list, wanted: int):
    """New segmentations (paths, value, edges, units' counts, fresh): the
    nodes at the first _FIRST edges of all of them are made together."""
    new = [x for x in new if not x[0].found.append((x[1], x[2], x[3])) and x[4] < len(x[2])]
    if not new:
        return
    heads = [x[2][x[4]:x[4] + _FIRST] for x in new]
    sizes = np.array([len(h) for h in heads], dtype=np.int64)
    ends = np.cumsum(sizes)
    edges = np.concatenate(heads)
    logs = lat.log_q[edges]
    sums = np.cumsum(logs)
    skip = sums[ends - 1] - np.add.reduceat(logs, ends - sizes)  # before each path's first edge here
    before = np.array([float(lat.log_q[x[2][:x[4]]].sum()) if x[4] else 0.0 for x in new])
    fresh = np.array([x[4] for x in new], dtype=np.int64)
    base = np.array([_mixed1(x[0].key, len(x[0].found) - 1) for x in new], dtype=U64)
    phi = sums - logs + np.repeat(before - skip, sizes) + lat.log_others[edges]
    index = np.arange(len(edges)) + np.repeat(fresh - (ends - sizes), sizes)
    values = _truncated(phi, np.repeat([x[1] for x in new], sizes), _uniform(np.repeat(base, sizes), index, _NODE))
    after = before + sums[ends - 1] - skip
    for x, a, n, e in zip(new, after, sizes, ends):
        x[0].extend(lat, len(x[0].found) - 1, x[4], [values[e - n:e]], float(a), x[4] + int(n), 4 * _FIRST, wanted)


def sample(texts: list[str], keys: np.ndarray, k: int, v: Vocabulary, memo: Memo | None = None):
    """For each text its Paths with up to k segmentations, and the lattice."""
    memo = memo or Memo(v)
    units = memo.units(texts)
    lat, parts, part_at = memo.lattice(), memo.held["part"], memo.held["part_at"]
    flat = np.concatenate(units) if units else np.zeros(0, dtype=np.int64)
    amount = part_at[flat + 1] - part_at[flat]
    ends = np.cumsum(amount)
    start = lat.begin[parts[np.repeat(part_at[flat] - (ends - amount), amount) + np.arange(ends[-1] if len(ends) else 0)]]
    # from here on a unit is a part: first are the texts' first ones
    first = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)]
    which = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    paths = [Paths(int(x)) for x in keys]
    for s in range(k):
        # where each text's next path leaves the known ones: units before it are kept
        plan = {}
        for d, p in enumerate(paths):
            if s == 0:
                g = -math.log(-math.log(_uniform1(_mixed1(p.key, 0), 0, _ROOT)))
                plan[d] = (g, np.zeros(0, dtype=np.int32), 0, None, 0)
                continue
            node = p.pop() if len(p.found) == s else None
            if node is None:
                continue
            value, parent, j = node
            e = p.branch(lat, value, parent, j)
            counts = p.found[parent][2]
            unit = int(np.searchsorted(np.cumsum(counts), j, side="right"))
            plan[d] = (value, np.append(p.found[parent][1][:j], np.int32(e)), unit, parent, int(lat.dst[e]))
        if not plan:
            break
        ask = np.concatenate([np.arange(first[d] + x[2], first[d + 1]) for d, x in plan.items()]) if plan else np.zeros(0, dtype=np.int64)
        position = start[ask].copy()
        sizes_now = [int(first[d + 1] - first[d] - x[2]) for d, x in plan.items()]
        offset = np.concatenate([[0], np.cumsum(sizes_now)])
        for (d, x), o in zip(plan.items(), offset):
            if x[3] is not None:
                position[o] = x[4]
        owner = np.repeat(np.array([paths[d].key for d in plan], dtype=U64), sizes_now)
        edges, counts = lat.walk(position, owner, s, which[ask].astype(U64))
        ends = np.concatenate([[0], np.cumsum(counts)])
        new = []
        for (d, x), a, b in zip(plan.items(), offset[:-1], offset[1:]):
            value, head, unit, parent, _ = x
            own = counts[a:b].copy()
            if parent is not None:
                old = paths[d].found[parent][2]
                own[0] += len(head) - int(old[:unit].sum())
                own = np.concatenate([old[:unit], own])
            new.append((paths[d], value, np.concatenate([head, edges[ends[a]:ends[b]]]), own, len(head)))
        add_paths(lat, new, k + 1 - s)
    return paths, lat


class LongText:
    """One text beyond a slice, a block of parts at a time. Its paths are kept
    as pieces, the lattice of a block is made when the block is walked or
    branched in and dropped again, and of a path's nodes only as many as can
    still be taken are kept. Draws are those of the other texts."""

    def __init__(self, text: str, v: Vocabulary):
        self.v = v
        self.code = np.frombuffer((_SPACE + text).replace(" ", _SPACE).encode("utf-32-le"), dtype="<u4")
        begins = []
        for a in range(0, len(self.code), BLOCK_CHARS):
            code = self.code[max(0, a - 1):a + BLOCK_CHARS].astype(np.int64)
            pair = (code[:-1] << 32) | code[1:]
            at = np.minimum(np.searchsorted(v.inside, pair), len(v.inside) - 1)
            begins.append(np.flatnonzero(v.inside[at] != pair) + max(1, a))
        self.start = np.concatenate([[0], *begins, [len(self.code)]])  # of the parts, and the end
        self.cuts = [0]  # first part of each block
        n = len(self.start) - 1
        while self.cuts[-1] < n:
            self.cuts.append(max(self.cuts[-1] + 1, int(np.searchsorted(self.start, self.start[self.cuts[-1]] + BLOCK_CHARS, side="right")) - 1))
        self.blocks = len(self.cuts) - 1

    def lattice(self, b: int) -> tuple[Lattice, np.ndarray]:
        """Of a block, and where its parts begin in it."""
        start = self.start[self.cuts[b]:self.cuts[b + 1] + 1]
        lat = Lattice(self.code[start[0]:start[-1]].astype(np.int64), np.diff(start), self.v)
        return lat, lat.begin[:-1]


class LongPath:
    """A segmentation: per block its pieces and the number of each part's; the
    log-probability before each block, and up to where the path is known."""

    def __init__(self, value: float):
        self.value, self.pieces, self.counts, self.logs, self.head_log = value, [], [], [0.0], 0.0


def sample_long(text: str, key: int, k: int, v: Vocabulary) -> tuple[list[LongPath], float]:
    """Up to k paths of a long text, best first, and the best value left."""
    t = LongText(text, v)
    found: list[LongPath] = []
    nodes: list[tuple] = []  # (-value, path, edge number, block, place in the block, log-probability before)
    gone: dict[tuple[int, int], list[int]] = {}

    def finish(p: LongPath, b: int, lat: Lattice, begin: np.ndarray, part: int, position, head: np.ndarray, counts: np.ndarray):
        """Walks the path from a part of block b, at ``position`` within it
        (None: its begin), to the end; head: pieces of the block before."""
        s, wanted = len(found) - 1, k + 1 - len(found) + 1
        at, first = sum(map(len, p.pieces)), len(head)
        base = _mixed1(key, s)
        while True:
            ask = np.array(begin[part:])
            if position is not None:
                ask[0] = position
            which = np.arange(t.cuts[b] + part, t.cuts[b + 1], dtype=U64)
            edges, own = lat.walk(ask, np.full(len(ask), key, dtype=U64), s, which)
            if position is not None:
                own[0] += len(head) - int(counts[:part].sum())
                own = np.concatenate([counts[:part], own])
            logs = lat.log_q[edges]
            sums = np.cumsum(logs)
            before = p.head_log + sums - logs
            index = np.arange(at + first, at + first + len(edges))
            values = _truncated(before + lat.log_others[edges], p.value, _uniform(U64(base), index, _NODE))
            best = np.argpartition(-values, wanted - 1)[:wanted] if len(values) > wanted else np.arange(len(values))
            nodes.extend((-float(values[i]), s, int(index[i]), b, first + int(i), float(before[i])) for i in best if values[i] > -np.inf)
            p.pieces.append(np.concatenate([head, lat.piece[edges]]))
            p.counts.append(own.astype(np.int32))
            p.head_log += float(sums[-1]) if len(sums) else 0.0
            p.logs.append(p.head_log)
            at += len(p.pieces[-1])
            b, part, position, head, first, counts = b + 1, 0, None, head[:0], 0, counts[:0]
            if b == t.blocks:
                return
            del lat
            lat, begin = t.lattice(b)

    empty = np.zeros(0, dtype=np.int32)
    for s in range(k):
        if s == 0:
            p = LongPath(-math.log(-math.log(_uniform1(_mixed1(key, 0), 0, _ROOT))))
            found.append(p)
            finish(p, 0, *t.lattice(0), 0, None, empty, empty)
            continue
        if not nodes:
            break
        node = min(nodes)
        nodes.remove(node)
        value, parent, j, b, place, before = -node[0], node[1], *node[2:]
        old = found[parent]
        lat, begin = t.lattice(b)
        ends = np.cumsum(old.counts[b])
        part = int(np.searchsorted(ends, place, side="right"))
        position = int(begin[part])
        for piece in old.pieces[b][int(ends[part] - old.counts[b][part]):place]:  # along the parent to the node
            row = slice(int(lat.row[position]), int(lat.row[position + 1]))
            position = int(lat.dst[row][lat.piece[row] == piece][0])
        row = np.arange(int(lat.row[position]), int(lat.row[position + 1]))
        out = gone.setdefault((parent, j), [int(old.pieces[b][place])])
        left = row[~np.isin(lat.piece[row], out)]
        q = np.exp(lat.log_q[left])
        base = _mixed1(key, len(found))
        taken = min(int(np.searchsorted(np.cumsum(q), _uniform1(base, j, _PICK) * q.sum(), side="right")), len(left) - 1)
        e = int(left[taken])
        out.append(int(lat.piece[e]))
        left = np.delete(left, taken)
        if len(left):
            q = np.exp(lat.log_q[left])
            phi = before + np.log(q.sum()) if q.sum() > 0 else -np.inf
            again = float(_truncated(np.array([phi]), value, np.array([_uniform1(base, j, _REST)]))[0])
            if again > -np.inf:
                nodes.append((-again, parent, j, b, place, before))
        p = LongPath(value)
        p.pieces, p.counts, p.logs = old.pieces[:b], old.counts[:b], old.logs[:b + 1]
        p.head_log = before + float(lat.log_q[e])
        found.append(p)
        head = np.append(old.pieces[b][:place], lat.piece[e])
        counts = old.counts[b].astype(np.int64)
        finish(p, b, lat, begin, part, int(lat.dst[e]), head, counts)
    return found, -min(nodes)[0] if nodes else -np.inf


def _ids(pieces: np.ndarray, v: Vocabulary, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of runs of pieces, characters without a piece as their bytes
    (or unknown); and where each run's begin."""
    ids = pieces
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, first
    code = -ids[bare].astype(np.int64) - 1
    if not v.bytes_at:
        ids = ids.copy()
        ids[bare] = v.unknown
        return ids, first
    n = Lattice._byte_counts(code, v)
    sizes = np.ones(len(ids), dtype=np.int64)
    sizes[bare] = n
    ends = np.cumsum(sizes)
    out = np.repeat(ids, sizes)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
    of = np.array([v.bytes_at[b] for b in range(256)], dtype=ids.dtype)
    for j in range(4):  # the j-th byte of those that have one
        has = n > j
        raw = (code[has] >> (6 * (n[has] - 1 - j))) & (0x3F if j else 0x7F)
        out[(ends - sizes)[bare[has]] + j] = of[raw | (0x80 if j else lead[has])]
    return out, np.concatenate([[0], ends])[first]


def _log_inclusion(log_p: float, kappa: float) -> float:
    x = log_p - kappa
    return 0.0 if x > 30 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


def _rows_of(part: pa.RecordBatch, k: int, v: Vocabulary, memo: Memo, names: list[str]) -> pa.RecordBatch:
    keys = np.asarray(part.column("h_")).astype(np.int64).view(U64)
    if part.num_rows == 1 and part.column("t_")[0].as_buffer() is not None and part.column("t_")[0].as_buffer().size > SLICE:
        return _long_rows(part, int(keys[0]), k, v, names)
    texts = [t or "" for t in part.column("t_").to_pylist()]
    paths, lat = sample(texts, keys, k, v, memo)
    row, number, ids, logs, values, score = [], [], [], [], [], []
    for d, p in enumerate(paths):
        kappa = p.best()
        for s, (value, edges, _) in enumerate(p.found):
            row.append(d)
            number.append(s + 1)
            ids.append(edges)
            logs.append(float(lat.log_q[edges].sum()))
            values.append(value)
            score.append(_log_inclusion(logs[-1], kappa))
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    flat, first = _ids(lat.piece[np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)], v, first)
    del paths, lat, ids
    marked = [((_SPACE + t) if t else "").replace(" ", _SPACE).encode() for t in texts]
    same = [x == marked[d] for x, d in zip(v.decode(flat, first), row)]
    return _batch(part, row, number, flat, first, logs, values, score, same, names)


def _long_rows(part: pa.RecordBatch, key: int, k: int, v: Vocabulary, names: list[str]) -> pa.RecordBatch:
    text = part.column("t_")[0].as_py()
    found, kappa = sample_long(text, key, k, v)
    marked = (_SPACE + text).replace(" ", _SPACE).encode()
    del text
    flat, first, same = [], [0], []
    for p in found:
        at, ok = 0, True
        for pieces in p.pieces:
            ids, _ = _ids(pieces, v, np.array([0, len(pieces)]))
            raw = b"".join(v.decode(ids[a:a + _DECODED], np.array([0, len(ids[a:a + _DECODED])]))[0] for a in range(0, len(ids), _DECODED))
            ok, at = ok and marked[at:at + len(raw)] == raw, at + len(raw)
            flat.append(ids)
        first.append(sum(map(len, flat)))
        same.append(ok and at == len(marked))
    logs, values = [p.logs[-1] for p in found], [p.value for p in found]
    n = len(found)
    del found, marked
    return _batch(part, [0] * n, list(range(1, n + 1)), np.concatenate(flat), np.array(first, dtype=np.int64), logs, values,
                  [_log_inclusion(x, kappa) for x in logs], same, names)


def _batch(part, row, number, flat, first, logs, values, score, same, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        part.column("k_").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(np.diff(first), pa.int64()),
        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.astype(np.int32, copy=False))), pa.array(logs, pa.float64()),
        pa.array(values, pa.float64()), pa.array(score, pa.float64()), pa.array(same, pa.bool_())], names)


def sampled_segmentations(docs: DataFrame, model: str, k: int = 2, seed: int = 0, temperature: float = 1.0, key: str = "doc_id",
                          text: str = "text") -> DataFrame:
    """Up to k rows (key, sample, n_pieces, ids, log_prob, perturbed,
    log_inclusion, round_trip) for every row of docs.

    sample counts from 1 in descending order of the perturbed log-probability.
    log_inclusion is the log of the chance that a segmentation of this
    probability is among the k, given the (k + 1)-th perturbed value; 0 if no
    segmentation is left. round_trip says that decoding ids gives the text (a
    literal U+2581 in a text is a space to the model). Texts with fewer than k
    segmentations give all they have; a null or empty text has one, without
    pieces. Rows with equal keys and texts get equal samples; a null key is a
    key of its own; other columns are not read; an empty table gives an empty
    result."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(n, t) for n, t in (
        ("sample", T.IntegerType()), ("n_pieces", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("log_prob", T.DoubleType()),
        ("perturbed", T.DoubleType()), ("log_inclusion", T.DoubleType()), ("round_trip", T.BooleanType()))])

    def run(batches):
        v = vocabulary(model, temperature)
        memo = _memos.setdefault((model, temperature), Memo(v))
        for batch in batches:
            arrays.release()
            for part in arrays.row_slices(batch, "t_", SLICE):
                yield _rows_of(part, k, v, memo, schema.fieldNames())
        arrays.release()

    return docs.select(F.col(key).alias("k_"), F.xxhash64(F.lit(seed), F.col(key)).alias("h_"), F.col(text).alias("t_")).mapInArrow(run, schema)


def decoded(df: DataFrame, model: str, key: str, ids: str = "ids") -> DataFrame:
    """(key, text) of rows of piece ids: the pieces' text without the space
    that encoding puts first. Null ids give a null text; control pieces give
    nothing; an id outside the vocabulary is an error."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        v = vocabulary(model, 1.0)
        for batch in batches:
            out = []
            for x in batch.column("i_").to_pylist():
                if x is None:
                    out.append(None)
                    continue
                raw = v.decode(np.array(x, dtype=np.int64), np.array([0, len(x)]))[0].decode("utf-8", "replace")
                out.append((raw[1:] if raw[:1] == _SPACE else raw).replace(_SPACE, " "))
            yield pa.RecordBatch.from_arrays([batch.column("k_"), pa.array(out, pa.string())], schema.fieldNames())

    return df.select(F.col(key).alias("k_"), F.col(ids).alias("i_")).mapInArrow(run, schema)
