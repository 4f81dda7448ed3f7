"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

The segmentations of a text into pieces are the paths of a lattice.  Each path has a probability (its pieces' scores
times ALPHA, normalised over the lattice); adding Gumbel noise to the log probabilities and taking the k greatest
sums draws k distinct segmentations without replacement.  A perturbed A* search does that without listing paths: its
queue holds sets of paths with the greatest perturbed value in each, the set that is on top is opened, its best
path is emitted, and what is left of it is split into sets whose values are drawn below.  The value on top after k
paths is the threshold for which each emitted path has its inclusion score, the log probability to be among those
above it.

Lattices are made for distinct units, and kept in the worker for later batches: a text is cut wherever no piece of
the vocabulary spans the two bytes on both sides, and units are independent.  Drawing paths through all units of all texts of a
batch runs in numpy; the queue of a text is the only part in plain Python, a few entries for each sample.

Random numbers are digests of the row's key, the sample's number and the place in the text: a row has the same
samples whichever task draws them.

Scale: one pass without a shuffle.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.textbatch import SegmentHash, give_back, mix, segment_hash, slices, text_bytes

SAMPLES, ALPHA, SEED = 2, 1.0, 97
#: Bytes of text that are sampled at once, which bounds a worker's memory; samples don't depend on it.
SLICE = 500_000
#: Edges of lattices that a worker keeps.
MAX_EDGES = 4_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _table(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open hash table of 64-bit hashes, at most a quarter full, with room for runs at its end; the bits that choose a slot."""
    bits = max(20, (4 * len(h)).bit_length())
    slots, slot_id = np.zeros((1 << bits) + 1024, dtype=np.uint64), np.full((1 << bits) + 1024, -1, dtype=np.int32)
    for x, i in zip(h.tolist(), ids.tolist(), strict=True):
        at = x >> (64 - bits)
        while slots[at]:
            at += 1
        slots[at], slot_id[at] = x, i
    return slots, slot_id, bits


class Pieces:
    """A vocabulary: pieces as bytes (with a space for the word mark), scores, and tables for looking them up."""

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        probe = " a  b\tc é́ﬁ"
        if sp.normalize(probe) != "▁" + probe.replace(" ", "▁"):
            raise ValueError("only models that leave texts as they are, but for a space in front, are supported")
        n = sp.get_piece_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        #: bytes of each id; the ids of single bytes
        self.text = [b""] * n
        self.byte = np.zeros(256, dtype=np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
                self.text[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        for i in plain:
            self.text[i] = sp.id_to_piece(i).replace("▁", " ").encode()
        ranked = scores[plain]
        if (ranked == np.round(ranked)).all():
            # Merge ranks, not log probabilities: take frequencies in proportion to 1 / (rank + 10); unranked pieces come last.
            logp = dict(zip(plain, -np.log(10.0 + np.minimum(-ranked, n)), strict=True))
        else:
            logp = dict(zip(plain, ranked, strict=True))
        self.score = np.full(n, min(logp.values()) - 2.0)
        self.score[list(logp)] = list(logp.values())
        self.score *= alpha
        by_text = {self.text[i]: i for i in plain}
        prefixes: dict[bytes, int] = {}
        inside = np.zeros((256, 256), dtype=bool)
        for t in by_text:
            for j in range(1, len(t) + 1):
                prefixes.setdefault(t[:j], by_text.get(t[:j], -1))
                if j < len(t):
                    inside[t[j - 1], t[j]] = True
        self.longest = max(map(len, by_text))
        flat = np.frombuffer(b"".join(prefixes), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in prefixes])
        h = segment_hash(flat, ends - [len(p) for p in prefixes], ends)
        self.slots, self.slot_id, self.bits = _table(h, np.array(list(prefixes.values()), dtype=np.int32))
        self.inside = inside.ravel()
        self.store = Store()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is that of a prefix, and the piece that the prefix is, or -1."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.slots[at]
        on = np.flatnonzero((there != h) & (there != 0))
        while len(on):
            at[on] += 1
            there[on] = self.slots[at[on]]
            on = on[(there[on] != h[on]) & (there[on] != 0)]
        return there == h, self.slot_id[at]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.text[i] for i in ids)[1:].decode("utf-8", "replace")


_loaded: dict[tuple[str, float], Pieces] = {}


def pieces(model: str, alpha: float = ALPHA) -> Pieces:
    if (model, alpha) not in _loaded:
        _loaded[model, alpha] = Pieces(model, alpha)
    return _loaded[model, alpha]


class Lattice:
    """Lattices of distinct units.  A unit of n bytes has n + 1 nodes; edges (piece, to) of a node are consecutive.

    logp: of an edge, given its node; cum: cumulative probabilities within the node; other: probability of the
    node's other edges.
    """

    def __init__(self, v: Pieces, data: np.ndarray, first: np.ndarray, last: np.ndarray):
        n = len(first)
        size = last - first
        self.node = np.concatenate(([0], np.cumsum(size + 1)))  # the first node of each unit
        at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        b = data[at]
        byte_start = np.concatenate(([0], np.cumsum(size)))
        unit = np.repeat(np.arange(n), size)
        local_end = byte_start[1:][unit]
        begins = (b & 0xC0) != 0x80
        start_list, stop_list, piece_list = [], [], []
        alive, hashed = np.flatnonzero(begins), SegmentHash(b)
        one = np.zeros(len(b), dtype=bool)
        char_stop = np.append(np.flatnonzero(begins)[1:], len(b))
        stop_of = np.zeros(len(b) + 1, dtype=np.int64)
        stop_of[np.flatnonzero(begins)] = np.minimum(char_stop, local_end[np.flatnonzero(begins)])
        for length in range(1, v.longest + 1):
            alive = alive[alive + length <= local_end[alive]]
            if not len(alive):
                break
            h = hashed(alive, alive + length)
            known, piece = v.find(h)
            alive, piece = alive[known], piece[known].astype(np.int64)
            is_piece = piece >= 0
            s = alive[is_piece]
            start_list.append(s)
            stop_list.append(s + length)
            piece_list.append(piece[is_piece])
            one[s[stop_of[s] == s + length]] = True
        # characters that are no piece are spelled in bytes
        lead = np.maximum.accumulate(np.where(begins, np.arange(len(b)), 0))
        spelled = np.flatnonzero(~one[lead])
        start_list.append(spelled)
        stop_list.append(spelled + 1)
        piece_list.append(v.byte[b[spelled]])
        start, stop, piece = (np.concatenate(x) for x in (start_list, stop_list, piece_list))
        order = np.argsort(start, kind="stable")
        start, stop, piece = start[order], stop[order], piece[order]
        u = unit[start]
        self.piece, self.to = piece, stop + u
        source = start + u
        self.off = np.searchsorted(source, np.arange(self.node[-1] + 1))
        score = v.score[piece]

        # log of the sum over all ways from a node to its unit's end, from the ends backwards
        beta = np.full(self.node[-1], -np.inf)
        beta[self.node[1:] - 1] = 0.0
        place = start - byte_start[u]
        by_place = np.argsort(place.astype(np.uint16) if not len(place) or place.max() < 1 << 16 else place, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], place[by_place][1:] != place[by_place][:-1]))) if len(place) else np.zeros(0, dtype=np.int64)
        for a, z in zip(cuts[::-1], np.append(cuts[1:], len(place))[: len(cuts)][::-1], strict=True):
            e = by_place[a:z]
            src = source[e]
            heads = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
            beta[src[heads]] = np.logaddexp.reduceat(score[e] + beta[self.to[e]], heads)
        with np.errstate(invalid="ignore"):
            self.logp = score + beta[self.to] - beta[source]
        self.logp[~np.isfinite(self.logp)] = -np.inf
        p = np.exp(self.logp)
        heads = self.off[:-1][self.off[:-1] < self.off[1:]]
        size = np.diff(np.append(heads, len(p)))
        total = np.cumsum(p)
        self.cum = total - np.repeat(total[heads] - p[heads], size) if len(p) else p
        self.cum[np.append(heads[1:], len(p))[: len(heads)] - 1] = 2.0
        # what is left beside an edge of more than half is added up without it, so that small rests stay exact
        small = np.where(p >= 0.5, 0.0, p)
        self.other = np.where(p >= 0.5, np.repeat(np.add.reduceat(small, heads), size) if len(p) else p, 1.0 - p)


class Store:
    """Lattices of the units that a worker met so far, in one set of arrays; most words of a text were met before.

    Past MAX_EDGES it begins anew, which bounds its memory.
    """

    def __init__(self):
        self.known = self.index = None
        self.clear()

    def clear(self) -> None:
        self.known, self.index = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self._full = {"piece": np.zeros(0, np.int32), "to": np.zeros(0, np.int32), "logp": np.zeros(0), "cum": np.zeros(0), "other": np.zeros(0), "off": np.zeros(1, np.int64), "start": np.zeros(0, np.int64), "end": np.zeros(0, np.int64)}
        self._size = dict.fromkeys(self._full, 0) | {"off": 1}
        self._views()

    def _views(self) -> None:
        self.piece, self.to, self.logp, self.cum, self.other, self.off, self.start, self.end = (self._full[k][: self._size[k]] for k in self._full)

    def _append(self, name: str, values: np.ndarray) -> None:
        n, a = self._size[name], self._full[name]
        if n + len(values) > len(a):
            self._full[name] = a = np.concatenate((a[:n], np.zeros(max(n // 4, len(values)), dtype=a.dtype)))
        a[n : n + len(values)] = values
        self._size[name] = n + len(values)

    def units(self, v: Pieces, data: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last node of each unit; hashes are sorted, and unit i is data[first[i]:last[i]]."""
        if len(self.piece) > MAX_EDGES:
            self.clear()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            lat = Lattice(v, data, first[new], last[new])
            edges, nodes, count = self._size["piece"], self._size["off"] - 1, self._size["start"]
            for name, values in (("piece", lat.piece), ("to", lat.to + nodes), ("logp", lat.logp), ("cum", lat.cum), ("other", lat.other), ("off", lat.off[1:] + edges), ("start", lat.node[:-1] + nodes), ("end", lat.node[1:] - 1 + nodes)):
                self._append(name, values)
            self._views()
            self.known = np.insert(self.known, at[new], hashes[new])
            self.index = np.insert(self.index, at[new], np.arange(count, count + int(new.sum())))
            at = np.searchsorted(self.known, hashes)
        return self.start[self.index[at]], self.end[self.index[at]]


class Batch:
    """Some texts cut into units, with the lattices of the distinct ones."""

    def __init__(self, v: Pieces, column: pa.Array, keys: np.ndarray):
        raw, offsets = text_bytes(column)
        size = np.diff(offsets)
        full = size > 0
        # a space before each text that isn't empty; a written word mark is no space but is spelled in bytes, so that texts decode to themselves
        self.offsets = np.concatenate(([0], np.cumsum(size + full)))
        data = np.full(self.offsets[-1], 32, dtype=np.uint8)
        shift = np.repeat(self.offsets[:-1] + full - offsets[:-1], size)
        data[np.arange(len(raw)) + shift] = raw
        n = len(data)
        turn = np.ones(n + 1, dtype=bool)
        if n:
            turn[1:-1] = ~v.inside[data[:-1].astype(np.int64) * 256 + data[1:]] & ((data[1:] & 0xC0) != 0x80)
        turn[self.offsets] = True
        bounds = np.flatnonzero(turn)
        self.first, self.last = bounds[:-1], bounds[1:]
        self.unit_bounds = np.searchsorted(self.first, self.offsets)
        self.doc = np.repeat(np.arange(len(size)), np.diff(self.unit_bounds))
        self.keys = keys
        h = segment_hash(data, self.first, self.last)
        distinct, where, kind = np.unique(h, return_index=True, return_inverse=True)
        self.lattice = v.store
        start, end = v.store.units(v, data, distinct, self.first[where], self.last[where])
        self.start_node, self.end_node = start[kind], end[kind]
        #: place in its text of each unit's first byte
        self.place = (self.first - self.offsets[self.doc]).astype(np.uint64)

    def walk(self, units: np.ndarray, nodes: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draws a way from each node to its unit's end: (unit, number of the step, edge) of all steps."""
        lat = self.lattice
        out: list[tuple[np.ndarray, np.ndarray]] = []
        base, end = self.start_node, self.end_node
        go = nodes < end[units]
        units, nodes = units[go], nodes[go]
        key = self.keys[self.doc[units]] + mix(np.array([sample], dtype=np.uint64))
        place = self.place[units]
        while len(units):
            u = uniform(key, place + (nodes - base[units]).astype(np.uint64))
            e = lat.off[nodes]
            more = np.flatnonzero(u > lat.cum[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > lat.cum[e[more]]]
            out.append((units, e))
            nodes = lat.to[e]
            go = nodes < end[units]
            units, nodes, key, place = units[go], nodes[go], key[go], place[go]
        if not out:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        return np.concatenate([o[0] for o in out]), np.repeat(np.arange(len(out)), [len(o[0]) for o in out]), np.concatenate([o[1] for o in out])


def uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In (0, 1), by key and place."""
    return ((mix(mix(place + _GOLDEN) ^ key) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


_ALL = (1 << 64) - 1


def _mix_one(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def uniform_one(key: int, place: int) -> float:
    """uniform() for one key and place, without numpy's cost for each call."""
    return ((_mix_one(_mix_one(place + int(_GOLDEN) & _ALL) ^ key) >> 11) + 0.5) / (1 << 53)


class Path:
    """Sampled segmentations of all texts of a batch: edges in order, each unit's range among them."""

    def __init__(self, units: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        unit = np.concatenate([p[0] for p in parts])
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(unit, minlength=units))))
        self.edges = np.empty(len(unit), dtype=np.int64)
        for u, step, e in parts:
            self.edges[self.bounds[u] + step] = e

    def measure(self, batch: Batch) -> None:
        """total: each text's log probability; weights: at each step, the probability to part from the path there."""
        logp = batch.lattice.logp[self.edges]
        self.spans = self.bounds[batch.unit_bounds]
        upto = np.concatenate(([0.0], np.cumsum(logp)))
        self.total = upto[self.spans[1:]] - upto[self.spans[:-1]]
        reach = upto[:-1] - np.repeat(upto[self.spans[:-1]], np.diff(self.spans))
        self.weights = np.exp(np.minimum(reach, 0.0)) * batch.lattice.other[self.edges]


class Rest:
    """What a path leaves of a set of paths: those that part from it at one of the steps from first on."""

    __slots__ = ("path", "first", "weights", "taken")

    def __init__(self, path: int, first: int, weights: np.ndarray):
        self.path, self.first, self.weights, self.taken = path, first, weights, {}


def sample(v: Pieces, column: pa.Array, keys: np.ndarray, k: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, ids, log probability, perturbed log probability, log inclusion) of each segmentation drawn."""
    batch = Batch(v, column, keys)
    lat, n_units, n = batch.lattice, len(batch.first), len(column)
    ub = batch.unit_bounds
    texts = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    paths = [Path(n_units, [batch.walk(np.arange(n_units), batch.start_node, 0)])]
    root = -np.log(-np.log(uniform(keys, np.full(n, 1 << 60, dtype=np.uint64))))
    found: list[list[tuple[int, float, float]]] = [[] for _ in range(n)]  # (path, log probability, perturbed)
    queues: list[list] = [[] for _ in range(n)]
    draws, int_keys = [0] * n, keys.tolist()

    def draw(i: int) -> float:
        draws[i] += 1
        return uniform_one(int_keys[i], (1 << 61) + draws[i])

    def span(path: Path, i: int) -> tuple[int, int]:
        return int(path.spans[i]), int(path.spans[i + 1])

    def push(i: int, rest: Rest, below: float) -> None:
        mass = float(rest.weights.sum())
        if mass > 0:
            loc = math.log(mass)
            heapq.heappush(queues[i], (-(loc - math.log(-math.log(draw(i)) + math.exp(loc - below))), draws[i], rest))

    def emit(i: int, number: int, first: int, value: float) -> None:
        """Takes text i's way through that path, which parted from earlier ones before step first."""
        a, z = span(paths[number], i)
        found[i].append((number, float(paths[number].total[i]), value))
        if z - a > first:
            push(i, Rest(number, first, paths[number].weights[a + first : z].copy()), value)

    paths[0].measure(batch)
    for i in texts:
        emit(int(i), 0, 0, float(root[i]))
    for number in range(1, k):
        part_unit, part_step, part_edge, copy_from = [], [], [], {}
        opened: list[tuple[int, int, float]] = []
        for i in map(int, texts):
            if not queues[i]:
                continue
            value, _, rest = heapq.heappop(queues[i])
            cumulated = np.cumsum(rest.weights)
            t = min(int(np.searchsorted(cumulated, draw(i) * cumulated[-1], side="right")), len(cumulated) - 1)
            while rest.weights[t] <= 0:
                t -= 1
            path = paths[rest.path]
            a, _ = span(path, i)
            step = a + rest.first + t
            edge = int(path.edges[step])
            unit = int(np.searchsorted(path.bounds, step, side="right")) - 1
            taken = rest.taken.setdefault(t, {edge})
            node = int(path_node(batch, path, unit, step))
            choices = [e for e in range(int(lat.off[node]), int(lat.off[node + 1])) if e not in taken]
            p = np.exp(lat.logp[choices])
            new = choices[min(int(np.searchsorted(np.cumsum(p), draw(i) * p.sum(), side="right")), len(choices) - 1)]
            taken.add(new)
            rest.weights[t] = rest.weights[t] * (1 - p[choices.index(new)] / p.sum()) if len(choices) > 1 else 0.0
            push(i, rest, -value)
            part_unit.append(unit)
            part_step.append(step - int(path.bounds[unit]))
            part_edge.append(new)
            copy_from.setdefault(rest.path, []).append((i, step))
            opened.append((i, rest.first + t + 1, -value))
        if not opened:
            break
        unit, at_step, edge = np.array(part_unit), np.array(part_step), np.array(part_edge)
        i_of = batch.doc[unit]
        after = np.concatenate([np.arange(u + 1, ub[i + 1]) for u, i in zip(unit, i_of, strict=True)])
        w_unit, w_step, w_edge = batch.walk(np.concatenate([unit, after]), np.concatenate([lat.to[edge], batch.start_node[after]]), number)
        base = np.zeros(n_units, dtype=np.int64)
        base[unit] = at_step + 1
        parts = [(unit, at_step, edge), (w_unit, w_step + base[w_unit], w_edge)]
        for source, where in copy_from.items():
            old = paths[source]
            spans = [np.arange(span(old, i)[0], step) for i, step in where]
            steps = np.concatenate(spans) if spans else np.zeros(0, dtype=np.int64)
            u = np.searchsorted(old.bounds, steps, side="right") - 1
            parts.append((u, steps - old.bounds[u], old.edges[steps]))
        paths.append(Path(n_units, parts))
        paths[-1].measure(batch)
        for i, first, value in opened:
            emit(i, number, first, value)
    text, order, ids, logp, perturbed, inclusion = [], [], [], [], [], []
    for i in map(int, texts):
        threshold = -queues[i][0][0] if queues[i] else -np.inf
        for j, (number, lp, value) in enumerate(found[i]):
            a, z = span(paths[number], i)
            text.append(i)
            order.append(j)
            ids.append(lat.piece[paths[number].edges[a:z]])
            logp.append(lp)
            perturbed.append(value)
            x = lp - threshold
            inclusion.append(0.0 if threshold == -np.inf else x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0))))))
    return np.array(text, dtype=np.int64), np.array(order, dtype=np.int64), ids, np.array(logp), np.array(perturbed), np.array(inclusion)


def path_node(batch: Batch, path: Path, unit: int, step: int) -> int:
    """The node at which a unit's step begins."""
    return int(batch.start_node[unit]) if step == path.bounds[unit] else int(batch.lattice.to[path.edges[step - 1]])


def _sampled(v: Pieces, part: pa.RecordBatch, k: int, decode: bool) -> pa.RecordBatch:
    """The samples of one slice; what they are made from is freed on return, before the next slice."""
    keys = part.column(1).to_numpy().view(np.uint64)
    text, number, ids, logp, perturbed, inclusion = sample(v, part.column(2), keys, k)
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *ids]).astype(np.int32, copy=False)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
    texts = [pa.array([v.decode(x.tolist()) for x in ids], pa.string())] if decode else []
    return pa.RecordBatch.from_arrays(
        [part.column(0).take(pa.array(text)), pa.array(number.astype(np.int32)), lists, pa.array(logp), pa.array(perturbed), pa.array(inclusion), *texts],
        names=["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", *(["decoded"] if decode else [])],
    )


def _sampler(model: str, k: int, alpha: float, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(model, alpha)
        for rows in batches:
            for a, b in slices(rows.column(2), SLICE):
                yield _sampled(v, rows.slice(a, b - a), k, decode)
                give_back()

    return run


def sample_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", decode: bool = False) -> DataFrame:
    """doc_id, sample (from 0), ids, log_prob, perturbed, log_inclusion: up to k distinct segmentations of each text.

    Samples come by falling perturbed log probability.  A text with fewer than k segmentations has them all, with
    inclusion 0; an empty text has one, without ids; a null text none.  Rows alike in id and text have the same
    samples each (scores up to rounding); a null id is a key like others.  An empty table gives an empty one.  Other columns aren't read.
    decode: with a column decoded, the text that the ids give.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(F.lit(seed), docs[doc_id], docs[text]).alias("key"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_sampler(model, k, alpha, decode), f"doc_id {kind}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double" + ", decoded string" * decode)


def decoded(model: str):
    """A function of a column of ids that gives their texts; null for null, '' for no ids."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        v = pieces(model)
        return pa.array([None if x is None else v.decode(x) for x in ids.to_pylist()], pa.string())

    return decode
