"""SentencePiece encoding with sampled segmentations: Gumbel top-k without replacement by perturbed A* search.

The segmentations of a text are the leaves of a tree. A node fixes some decisions (which piece ends at a place of a
pre-token; pre-tokens from left to right, places from right to left) and knows its exact log mass from the forward
scores of the lattice. Every node has a perturbed value: the largest of its leaves' log probabilities plus Gumbel noise.
The search takes the node with the largest value from a queue, follows it to the leaf that has this value, and splits the
rest of the node by the first decision that differs; the parts' values are Gumbel variables with their log masses,
truncated at the value of the node. Leaves therefore come in order of their perturbed log probability: a sample
without replacement. The next value in the queue is the threshold, which gives each sample's inclusion score
1 - exp(-exp(log_prob - threshold)), reported as a logarithm. Random numbers are a hash of the row's key, the sample and
the place, so they do not depend on batches.

All steps work on arrays for a bounded chunk of texts at a time: the pieces that end at each place of the distinct
pre-tokens (a walk of all places at once through the trie of reversed pieces), forward scores by depth, and the
sampled decisions of all pre-tokens of all texts.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import BYTE, PRE_TOKEN, Vocabulary, default_path, vocabulary

K, SEED = 3, 20240501
#: Characters of text that are worked on at a time (one longer text is worked on alone).
CHUNK = 1_500_000
#: Parts of a node whose mass is e^-FAR of the node's are below the resolution of the random numbers (2^-52).
FAR, STEP = 60.0, 256
U = np.uint64


def _hash(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit words."""
    with np.errstate(over="ignore"):
        x = np.atleast_1d(x + U(0x9E3779B97F4A7C15))
        y = x >> U(30)
        for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
            x ^= y
            x *= U(factor)
            np.right_shift(x, U(shift), out=y)
        x ^= y
    return x


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from 52 bits of a hash of the key and the parts."""
    for p in parts:
        key = _hash(key ^ np.asarray(p).astype(np.uint64))
    out = (key >> U(12)).astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


class Trie:
    """The reversed pieces as a table of (state, character) -> state that is searched for many places at once."""

    def __init__(self, vocab: Vocabulary):
        keys, targets, weight, piece = [], [], [0.0], [-1]
        todo = [(0, vocab.root)]
        while todo:
            state, node = todo.pop()
            for c, child in node.items():
                if c:
                    hit = child.get("")
                    keys.append(state << 21 | ord(c))
                    targets.append(len(weight))
                    todo.append((len(weight), child))
                    weight.append(hit[0] if hit else 0.0)
                    piece.append(hit[1][0] if hit else -1)
        keys, targets = np.array(keys, np.uint64), np.array(targets, np.int32)
        self.weight, self.piece = np.array(weight), np.array(piece, np.int32)
        # first characters are looked up directly
        self.first = np.zeros(1 << 21, np.int32)
        low = keys < U(1 << 21)
        self.first[keys[low].astype(np.int64)] = targets[low]
        # the others in an open hash table, less than half full; 0 is no key there
        keys, targets = keys[~low], targets[~low]
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.targets = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last one stays
            done = self.keys[slot[todo]] == keys[todo]
            self.targets[slot[todo[done]]] = targets[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states; 0 where there is none."""
        key = state.astype(np.uint64) << U(21) | char.astype(np.uint64)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.targets[slot], 0)
        todo = np.flatnonzero((held != key) & (held != 0))
        while len(todo):
            at = (slot[todo] + 1) & (1 << self.bits) - 1
            slot[todo], held = at, self.keys[at]
            hit = held == key[todo]
            out[todo[hit]] = self.targets[at[hit]]
            todo = todo[~hit & (held != 0)]
        return out


@lru_cache(maxsize=4)
def trie(path: str) -> Trie:
    return Trie(vocabulary(path))


def prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct prefixes of different words: their last characters, lengths, the prefix one shorter (-1: none); and each word's own."""
    order = sorted(range(len(words)), key=words.__getitem__)
    ranked = list(map(words.__getitem__, order))
    sizes = np.fromiter(map(len, ranked), np.int64, len(ranked))
    chars = np.frombuffer("".join(ranked).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(sizes) - sizes
    # in sorted order a word shares most with the one before
    same, on, d = np.zeros(len(words), np.int64), np.arange(1, len(words)), 0
    while len(on):
        on = on[(sizes[on] > d) & (sizes[on - 1] > d)]
        on = on[chars[start[on] + d] == chars[start[on - 1] + d]]
        d += 1
        same[on] = d
    new = sizes - same
    first = np.cumsum(new) - new
    of = np.repeat(np.arange(len(words)), new)
    depth = np.arange(new.sum()) - first[of] + same[of] + 1
    up = np.arange(new.sum(), dtype=np.int32) - 1
    up[first[same == 0]] = -1
    last = first + new - 1
    # a word's first own prefix goes on from one of the word before, which may be of a word before that
    on, d = np.arange(len(words)), 0
    while len(on):
        owner = on[np.maximum.accumulate(np.where(same[on] <= d, np.arange(len(on)), 0))]
        at = (first[owner] + d - same[owner]).astype(np.int32)  # the prefix of length d + 1
        end = sizes[on] == d + 1
        last[on[end]] = at[end]
        after = on[1:][same[on[1:]] == d + 1]
        up[first[after]] = at[1:][same[on[1:]] == d + 1]
        on, d = on[~end], d + 1
    ends = np.empty(len(words), np.int64)
    ends[order] = last
    return chars[start[of] + depth - 1].astype(np.int64), depth.astype(np.int32), up, ends


class Lattice:
    """Distinct prefixes of words; the node of a place is the number of the prefix that ends there.

    Edges are sorted by node: ``ptr`` leads to a node's edges; an edge has the node before it (-1: the word's start), its id
    (or -1 - character for the fallback to bytes), its probability given the node, and the cumulated one.
    """

    def __init__(self, words: list[str], t: Trie):
        self.chars, depth, up, self.last = prefixes(words)
        total = len(self.chars)
        state, at = t.first[self.chars], np.arange(total, dtype=np.int32)
        before = up
        nodes, weights, ids, parents = [], [], [], []
        size, single = 1, np.zeros(total, bool)
        while len(at):
            held = state > 0
            state, at, before = state[held], at[held], before[held]
            piece = t.piece[state]
            hit = piece >= 0
            if size == 1:
                single[at[hit]] = True
            nodes.append(at[hit])
            weights.append(t.weight[state[hit]])
            ids.append(piece[hit])
            parents.append(before[hit])
            more = before >= 0
            state, at, before = state[more], at[more], before[more]
            if len(at):
                state = t.step(state, self.chars[before])
                before = up[before]
            size += 1
        at = np.flatnonzero(~single).astype(np.int32)  # no piece is this character alone: its bytes
        c = self.chars[at]
        nodes.append(at)
        weights.append(BYTE * utf8_size(c))
        ids.append((-1 - c).astype(np.int32))
        parents.append(up[at])
        count = np.zeros(total, np.int64)
        for n in nodes:  # a node is in each of them at most once
            count[n] += 1
        self.ptr = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        free, edges = self.ptr[:-1].copy(), int(self.ptr[-1])
        self.node, self.parent = np.empty(edges, np.int64), np.empty(edges, np.int64)
        self.id, weight = np.empty(edges, np.int32), np.empty(edges)
        for n, w, i, p in zip(nodes, weights, ids, parents):
            e = free[n]
            free[n] += 1
            self.node[e], weight[e], self.id[e], self.parent[e] = n, w, i, p
        self.depth = depth
        alpha = np.zeros(total + 1)  # the last one is the start of every word
        edge_depth = depth[self.node]
        small = edge_depth.astype(np.int16) if depth.max(initial=0) < 1 << 15 else edge_depth  # these are sorted by radix
        by_depth = np.argsort(small, kind="stable")
        score = np.empty(len(by_depth))
        edge_depth = edge_depth[by_depth]
        cuts = np.flatnonzero(np.r_[True, edge_depth[1:] != edge_depth[:-1]]).tolist() + [len(by_depth)] if total else []
        for a, b in zip(cuts, cuts[1:]):
            e = by_depth[a:b]
            n = self.node[e]
            first = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
            s = alpha[self.parent[e]] + weight[e]
            top = np.maximum.reduceat(s, first)
            width = np.diff(np.r_[first, len(e)])
            alpha[n[first]] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, width)), first))
            score[e] = s
        self.log_p = score - alpha[self.node]
        self.p = np.exp(self.log_p)
        cum = np.cumsum(self.p)
        start = self.ptr[:-1]
        base = np.where(start > 0, cum[start - 1], 0.0) if total else cum
        cum = np.minimum(cum - base[self.node], 1.0)
        cum[self.ptr[1:] - 1] = 1.0
        self.cum = cum
        # what the other edges of the node have
        self.rest = np.where(np.diff(self.ptr)[self.node] > 1, 1 - self.p, 0.0) if total else np.zeros(0)

    def descend(self, node: np.ndarray, occ: np.ndarray, key: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Sample from each node to its word's start: (edges, their rows of ``occ``), by row and then step."""
        edges, rows, row = [], [], np.arange(len(node))
        key = _hash(key ^ U(turn)) ^ occ.astype(np.uint64) << U(24)
        while len(node):
            u = _uniform(key[row], self.depth[node])
            e = self.ptr[node].copy()
            on = np.flatnonzero(self.cum[e] < u)
            while len(on):  # a node has few edges, and the last one reaches 1
                e[on] += 1
                on = on[self.cum[e[on]] < u[on]]
            edges.append(e)
            rows.append(row)
            node = self.parent[e]
            more = node >= 0
            node, row = node[more], row[more]
        if not edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        steps = np.zeros(len(rows[0]), np.int64)
        for r in rows:
            steps[r] += 1
        at = np.cumsum(steps) - steps
        out = np.empty(steps.sum(), np.int64)
        for e, r in zip(edges, rows):
            out[at[r]] = e
            at[r] += 1
        return out, np.repeat(rows[0], steps)


def utf8_size(c: np.ndarray) -> np.ndarray:
    lone = (c >= 0xD800) & (c < 0xE000)  # written as one question mark
    return np.where(lone, 1, 1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000))


def _near(lat: Lattice, path: np.ndarray) -> np.ndarray:
    """Log probabilities of a path's first decisions, up to where the path has less than e^-FAR of its node's mass."""
    n = STEP
    while True:
        got = lat.log_p[path[:n]]
        total = got.cumsum()
        if n >= len(path) or total[-1] < -FAR:
            return got[: (-total).searchsorted(FAR) + 1]
        n *= 2


def sample(lat: Lattice, words: list[np.ndarray], keys: np.ndarray, k: int):
    """For each text (the numbers of its words): up to ``k`` distinct segmentations in order, and the threshold.

    A segmentation is (edges, word places, log probability, perturbed value).
    """
    out: list[list[tuple[np.ndarray, np.ndarray, float, float]]] = [[] for _ in words]
    seeds = _hash(keys.astype(np.uint64))
    # (-value, tie-break, sample whose decisions are fixed up to a place, the place, edges that are excluded there)
    queues: list[list[tuple[float, int, int, int, frozenset[int]]]] = [
        [(float(np.log(-np.log(u))), 0, -1, 0, frozenset())] for u in _uniform(seeds, U(1 << 40)).tolist()
    ]
    made, none = 1, np.zeros(0, np.int64)
    for turn in range(k):
        live, fixed, nodes, occs = [], [], [], []
        taken = [(d, *heapq.heappop(queue)) for d, queue in enumerate(queues) if queue]
        again = [(d, int(out[d][base][1][at])) for d, _, _, base, at, _ in taken if base >= 0]
        chance = iter(_uniform(seeds[[d for d, _ in again]], U(turn), np.array([w for _, w in again], np.int64), U(1 << 41)).tolist() if again else ())
        for d, value, _, base, at, gone in taken:
            if base < 0:
                head = (none, none)
                node, occ = lat.last[words[d]], np.arange(len(words[d]))
            else:
                edges, places, _, _ = out[d][base]
                n, w = lat.node[edges[at]], int(places[at])
                free = [e for e in range(lat.ptr[n], lat.ptr[n + 1]) if e not in gone]
                u = next(chance) * sum(lat.p[free])
                e = free[-1]
                for x in free:
                    u -= lat.p[x]
                    if u <= 0:
                        e = x
                        break
                head = (np.append(edges[:at], e), places[: at + 1])
                node, occ = lat.last[words[d][w + 1 :]], np.arange(w + 1, len(words[d]))
                if lat.parent[e] >= 0:
                    node, occ = np.concatenate([[lat.parent[e]], node]), np.concatenate([[w], occ])
            live.append(d)
            fixed.append((head, -value, at, gone if base >= 0 else None))
            nodes.append(node)
            occs.append(occ)
        if not live:
            break
        sizes = [len(x) for x in nodes]
        occ = np.concatenate(occs)
        edges, rows = lat.descend(np.concatenate(nodes), occ, np.repeat(seeds[live], sizes), turn)
        ends = np.searchsorted(rows, np.cumsum(sizes)).tolist()
        places = occ[rows]
        need = k - turn  # of a node's parts no more can be taken, and one can be the threshold
        luck = _uniform(seeds[live][:, None], U(turn), np.arange(2 * need), U(1 << 42)).tolist()
        for d, (head, value, at, gone), a, b, u in zip(live, fixed, [0, *ends[:-1]], ends, luck):
            path, place = edges[a:b], places[a:b]
            if len(head[0]):
                path, place = np.concatenate([head[0], path]), np.concatenate([head[1], place])
            out[d].append((path, place, float(lat.log_p[path].sum()), value))
            # the rest of the node, by the first decision that differs
            log_p = _near(lat, path[at:])
            if not len(log_p):
                continue
            mine = path[at : at + len(log_p)]
            rest = lat.rest[mine]
            if gone is not None:  # at the node's own decision more is excluded
                n = lat.node[mine[0]]
                rest[0] = sum(lat.p[e] for e in range(lat.ptr[n], lat.ptr[n + 1]) if e not in gone and e != mine[0])
            mass = np.exp(log_p.cumsum() - log_p) * np.maximum(rest, 0.0)  # of the parts, in units of what is fixed
            unit = float(lat.log_p[path[:at]].sum())
            # the largest values of the parts, one after the other: a Gumbel variable of their joint mass, truncated
            for r in range(need):
                joint = float(mass.sum())
                if joint <= 0:
                    break
                m = unit + np.log(joint)
                value = float(m - np.log(np.exp(min(max(m - value, -700.0), 700.0)) - np.log(u[2 * r])))
                sums = mass.cumsum()
                spot = int(sums.searchsorted(u[2 * r + 1] * sums[-1], "right"))
                if spot == len(mass):  # by rounding
                    spot = int(np.flatnonzero(mass)[-1])
                mass[spot] = 0.0
                bar = (gone if spot == 0 and gone is not None else frozenset()) | {int(mine[spot])}
                heapq.heappush(queues[d], (-value, made, len(out[d]) - 1, at + spot, bar))
                made += 1
    return [(got, -q[0][0] if q else float("-inf")) for got, q in zip(out, queues)]


def ids_of_all(lat: Lattice, paths: list[tuple[np.ndarray, np.ndarray]], byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of segmentations (edges, places) in text order, one after the other, and the offsets where each begins and ends.

    A segmentation's decisions go from right to left within a word.
    """
    sizes = np.array([len(e) for e, _ in paths], np.int64)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    if not bounds[-1]:
        return np.zeros(0, np.int32), bounds
    edges = np.concatenate([e for e, _ in paths])
    size = np.diff(np.flatnonzero(lat.parent[edges] < 0), prepend=-1)  # the last decision of a word is at its start
    turned = np.repeat(2 * np.cumsum(size) - size - 1, size)
    turned -= np.arange(len(edges))
    ids = lat.id[edges][turned]
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, bounds
    raw = [chr(int(-1 - c)).encode("utf-8", "replace") for c in ids[odd]]
    reps = np.ones(len(ids), np.int64)
    reps[odd] = [len(x) for x in raw]
    out = np.repeat(ids, reps)
    out[out < 0] = byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.concatenate([np.zeros(1, np.int64), np.cumsum(reps)])[bounds]


def ids_of(lat: Lattice, edges: np.ndarray, places: np.ndarray, byte_ids: np.ndarray) -> np.ndarray:
    """The ids of one segmentation in text order."""
    return ids_of_all(lat, [(edges, places)], byte_ids)[0]


def decode(ids: Iterable[int], vocab: Vocabulary) -> str:
    return b"".join(map(vocab.raw.__getitem__, ids)).decode("utf-8", "replace")


def segment(texts: list[str], keys: np.ndarray, k: int, path: str):
    """The lattice of some texts, and for each of them its samples and threshold."""
    found: defaultdict[str, int] = defaultdict()
    found.default_factory = found.__len__
    words = [np.fromiter(map(found.__getitem__, w), np.int64, len(w)) for w in map(PRE_TOKEN.findall, texts)]
    lat = Lattice(list(found), trie(path))
    return lat, sample(lat, words, keys, k)


def _chunks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
        yield b.slice(at, n)
        at += n


def sampled_ids(docs: DataFrame, k: int = K, seed: int = SEED, model_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, sample, n_tokens, log_prob, perturbed, log_inclusion, ids_crc32, round_trip[, ids]) for each sampled segmentation.

    ``k`` rows for each row of ``docs(doc_id, text)``, fewer if its text has fewer segmentations; a null or empty text has
    one, without ids. Samples of a row differ; equal rows get equal samples; rows with a null doc_id share one key. Other columns are
    ignored. ``round_trip`` tells whether decoding the ids gives the text.
    """
    path = model_path or default_path()
    names = ["doc_id", "sample", "n_tokens", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "round_trip"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        byte_ids, raw = np.array(vocab.byte_ids, np.int32), np.array(vocab.raw, object)
        for b in (x for big in batches for x in _chunks(big)):
            ids_, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            keys = np.array([(-1 if i is None else i) & (1 << 64) - 1 for i in ids_], np.uint64) ^ U(seed)
            lat, got = segment(texts, keys, k, path)
            ids, at = ids_of_all(lat, [x[:2] for samples, _ in got for x in samples], byte_ids)
            lo = iter(at.tolist())
            start, out = next(lo), []
            for i, t, (samples, least) in zip(ids_, texts, got):
                t = t.encode("utf-8", "replace")
                for n, (_, _, lp, value) in enumerate(samples):
                    end = next(lo)
                    mine = ids[start:end]
                    x = lp - least  # log(1 - exp(-exp(x))) is x up to rounding where x is far below 0
                    inclusion = x if x < -30 else 0.0 if x > 5 else float(np.log(-np.expm1(-np.exp(x))))
                    out.append((i, n, end - start, lp, value, inclusion, zlib.crc32(mine.astype("<u4").tobytes()), b"".join(raw[mine].tolist()) == t))
                    start = end
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out) if out else [[]] * len(kinds), kinds)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, sample int, n_tokens long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
