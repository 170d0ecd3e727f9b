"""SentencePiece encoding and decoding: distinct sampled segmentations by perturbed A-star search over the lattice.

A text becomes pieces the way the vocabulary expects: a space in front, spaces as the mark U+2581, characters without a
piece as byte pieces (a mark that is in the text itself too, so that decoding gives back every text exactly). Pieces hold
a mark only at their start, so the lattice of a text is a chain of the lattices of its units, a unit being spaces and
what follows up to the next space. Each distinct unit of a block of texts is laid out once: piece edges by rolling
hashes, backward sums of weights, and from these the probability of each edge given its node. Weights follow the rank of
a piece, w = (rank + 10) ** -TEMPERATURE, since the vocabulary holds merge ranks instead of probabilities.

Sampling without replacement is exact. The root's Gumbel value belongs to the best segmentation; a descent draws an edge
per node and passes the value on, and at each node the edges not taken keep a truncated Gumbel value of their joint mass:
the bound on everything below them. The queue of a text pops the greatest bound, and the next descent starts there,
without the edges already taken. After ``SAMPLES`` descents the greatest bound left is the threshold that gives each
sample's inclusion probability. All draws are hashes of the seed, the row key, the descent and the place in the text.

Defined results: null reads as the empty text, which has one segmentation without pieces; a text with fewer segmentations
than asked gives as many; rows without an id use the key of id 0; repeated rows give the same samples; other columns are
not read. Texts are encoded whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import mapped, text_chunks, to_batch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, TEMPERATURE, SEED = 2, 1.0, 17
WIDEST = 16
BLOCK_BYTES = 1 << 19
MARK = 0x2581
_LITERAL = 0x110000  # stands for a mark that was in the text
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FALLBACK = -2
_BITS = 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chance(keys: np.ndarray) -> np.ndarray:
    """A number strictly between 0 and 1 for each key."""
    return ((mixed(keys) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def slot_of(hashes: np.ndarray) -> np.ndarray:
    """The first bits of a mixed hash."""
    return (hashes * _BASE >> np.uint64(64 - _BITS)).astype(np.int32)


class Vocabulary:
    """Pieces by hash, their log weights, and the bytes of each id."""

    def __init__(self, pieces: list[str], used: list[bool], byte_ids: dict[int, int]) -> None:
        """``used``: ordinary pieces; ``byte_ids``: id of the piece of each byte value."""
        self.bytes = [p.encode().replace(chr(MARK).encode(), b" ") for p in pieces]
        for value, at in byte_ids.items():
            self.bytes[at] = bytes([value])
        self.byte_ids = byte_ids
        ids = [i for i, u in enumerate(used) if u and 0 < len(pieces[i]) <= WIDEST]
        log = -TEMPERATURE * np.log(np.arange(len(ids)) + 10.0)
        log -= np.log(np.exp(log).sum())
        self.byte_log = float(log.min()) if len(ids) else -10.0
        hashes, starts = np.zeros(len(ids), np.uint64), set()
        for at, i in enumerate(ids):
            h = 0
            for c in pieces[i]:
                starts.add(h)
                h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
            hashes[at] = h
        order = np.argsort(hashes)
        self.hashes, self.ids, self.log = hashes[order], np.array(ids, np.int32)[order], log[order].astype(np.float32)
        slots = slot_of(self.hashes)
        self.slot = np.full(1 << _BITS, -1, np.int32)  # row of a piece by its slot
        self.slot[slots] = np.arange(len(slots))
        self.shared = np.bincount(slots, minlength=1 << _BITS) > 1  # where several pieces have it
        self.longer = np.zeros(1 << _BITS, bool)  # hashes that may begin a longer piece
        self.longer[slot_of(np.array(sorted(starts), np.uint64))] = True

    @staticmethod
    def load(path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        used = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        return Vocabulary(pieces, used, byte_ids)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the hashes, the places of those that are pieces, and their rows."""
        slot = slot_of(hashes)
        row = self.slot[slot]
        at = np.flatnonzero(row >= 0)
        row = row[at]
        several = np.flatnonzero(self.shared[slot[at]])
        row[several] = np.minimum(np.searchsorted(self.hashes, hashes[at[several]]), len(self.hashes) - 1)
        good = self.hashes[row] == hashes[at]
        return at[good], row[good]

    def fallback(self, code: int) -> list[int]:
        return [self.byte_ids[b] for b in chr(MARK if code == _LITERAL else code).encode()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


class Lattice:
    """Nodes of all units, and the edges of every node with their probabilities given the node.

    Nodes are numbered by level, the number of characters up to the end of their unit, and within a level by the units of
    falling size: so the nodes of a level lie side by side, and so do their edges.
    """

    def __init__(self, vocabulary: Vocabulary, units: list[str]) -> None:
        self.vocabulary = vocabulary
        codes = np.frombuffer("".join((" ", " ".join(units)) if units else ()).encode("utf-32-le"), np.uint32)
        codes = np.where(codes == MARK, np.uint32(_LITERAL), np.where(codes == 32, np.uint32(MARK), codes))
        size = np.fromiter(map(len, units), np.int64, len(units)) + 1
        n = len(codes)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(units), np.int64)
        rank[order] = np.arange(len(units))
        # units that reach each level, and the first node of the level
        reach = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        begin = np.concatenate([[0], np.cumsum(reach)])
        self.nodes, self.size, self.start = n, size, begin[size - 1] + rank
        self.level = np.repeat(np.arange(1, len(reach) + 1, dtype=np.int32), reach)
        level = np.repeat(np.cumsum(size), size) - np.arange(n)
        self.codes = np.empty(n, np.uint32)
        self.codes[begin[level - 1] + np.repeat(rank, size)] = codes
        found = self._pieces(reach)
        count = np.zeros(n, np.int32)
        for node, *_ in found:
            count[node] += 1
        self.count, self.first = count, np.cumsum(count) - count
        edges = int(count.sum())
        self.width, self.piece, self.target = (np.empty(edges, np.int32) for _ in range(3))
        log, at = np.empty(edges), self.first.copy()
        for node, target, width, piece, weight in found:
            e = at[node]
            self.width[e], self.piece[e], self.target[e], log[e] = width, piece, target, weight
            at[node] += 1
        # backward sums, level by level
        total = np.zeros(n + 1)
        ends = np.append(self.first, edges)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            e, f = ends[a], ends[b]
            log[e:f] += total[self.target[e:f]]
            total[a:b] = np.logaddexp.reduceat(log[e:f], self.first[a:b] - e)
        log -= np.repeat(total[:n], count)
        self.log, self.chance = log, np.exp(log)
        # the likeliest edge of each node, and the mass beside it
        self.best, self.best_rest = np.zeros(n, np.int64), np.zeros(n)
        if n:
            top = np.maximum.reduceat(self.chance, self.first)
            equal = np.flatnonzero(self.chance == np.repeat(top, count))
            of = np.repeat(np.arange(n, dtype=np.int32), count)[equal]
            self.best = equal[np.flatnonzero(np.diff(of, prepend=-1))]
            others = self.chance.copy()
            others[self.best] = 0
            with np.errstate(divide="ignore"):
                self.best_rest = np.log(np.add.reduceat(others, self.first))

    def _pieces(self, reach: np.ndarray) -> list[tuple]:
        """Per width the edges by node: node, node behind the edge (or the number of nodes), width, id, log weight."""
        vocabulary, n, found = self.vocabulary, self.nodes, []
        plain, reach = self.codes.astype(np.uint64) + np.uint64(1), np.append(0, reach).astype(np.int32)
        where, level, h = np.arange(n, dtype=np.int32), self.level, plain
        last = where  # the node of the last character so far; the next one lies a level below
        for width in range(1, WIDEST + 1):
            if width > 1:
                on = np.flatnonzero((level > 1) & vocabulary.longer[slot_of(h)])
                if not len(on):
                    break
                where, level, h = where[on], level[on], h[on]
                last = last[on] - reach[level - 1]
                level = level - 1
                h = h * _BASE + plain[last]
            at, row = vocabulary.find(h)
            below = np.where(level[at] > 1, last[at] - reach[level[at] - 1], n)
            node, piece, weight = where[at], vocabulary.ids[row], vocabulary.log[row].astype(np.float64)
            if width == 1:  # characters without a piece become bytes
                bare = np.ones(n, bool)
                bare[node] = False
                bare = np.flatnonzero(bare)
                of = self.codes[bare]
                size = 1 + (of > 127) + (of > 2047) + ((of > 65535) & (of != _LITERAL))
                found.append((bare, np.where(level[bare] > 1, bare - reach[level[bare] - 1], n), 1, _FALLBACK,
                              vocabulary.byte_log * size))
            found.append((node, below, width, piece, weight))
        return found

    def weights(self, node: np.ndarray) -> np.ndarray:
        """The probabilities of the nodes' edges by width, 0 where there is none."""
        size = self.count[node]
        row = np.repeat(np.arange(len(node)), size)
        edge = np.arange(len(row)) + np.repeat(self.first[node] - (np.cumsum(size) - size), size)
        dense = np.zeros((len(node), WIDEST))
        dense[row, self.width[edge] - 1] = self.chance[edge]
        return dense

    def edge(self, node: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The edge of that width of each node: one of its ``count`` from ``first`` on, by rising width."""
        at = self.first[node].copy()
        wrong = np.flatnonzero(self.width[at] != width)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.width[at[wrong]] != width[wrong]]
        return at


class Path:
    """Steps of the texts' segmentations in order: unit place, node, edge of the lattice, its log probability and the log
    mass left."""

    def __init__(self, token: np.ndarray, node: np.ndarray, edge: np.ndarray, log: np.ndarray, rest: np.ndarray) -> None:
        self.token, self.node, self.edge, self.log, self.rest = token, node, edge, log, rest

    def part(self, at: np.ndarray) -> "Path":
        return Path(*(x[at] for x in (self.token, self.node, self.edge, self.log, self.rest)))

    @staticmethod
    def joined(a: "Path", b: "Path", tokens: int) -> "Path":
        """Both in one, where a unit's steps in ``a`` come before those in ``b``."""
        first, second = np.bincount(a.token, minlength=tokens), np.bincount(b.token, minlength=tokens)
        start = np.cumsum(first + second) - first - second
        own, other = np.cumsum(first) - first, np.cumsum(second) - second
        to_a = np.arange(len(a.token)) + (start - own)[a.token]
        to_b = np.arange(len(b.token)) + (start + first - other)[b.token]
        fields = []
        for x, y in zip((a.token, a.node, a.edge, a.log, a.rest), (b.token, b.node, b.edge, b.log, b.rest)):
            both = np.empty(len(x) + len(y), x.dtype)
            both[to_a], both[to_b] = x, y
            fields.append(both)
        return Path(*fields)


class Sampler:
    """The texts of a block over a lattice of their distinct units."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str], keys: np.ndarray) -> None:
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        parts = []
        for text in texts:
            words = units_of(text)
            parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        self.lattice = Lattice(vocabulary, list(known))
        self.keys = mixed(keys.astype(np.uint64) + np.uint64(SEED << 32))
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.unit = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        size = self.lattice.size[self.unit]
        ends = np.cumsum(size)
        first = np.cumsum(self.counts) - self.counts
        begin = np.concatenate([[0], ends])[first]
        self.place = ends - size - begin[self.doc]  # of each unit in its text

    def draw(self, descent: int, kind: int, token: np.ndarray, node: np.ndarray) -> np.ndarray:
        place = self.place[token] + self.lattice.size[self.unit[token]] - self.lattice.level[node]
        return chance(self.keys[self.doc[token]] ^ mixed(place.astype(np.uint64) + self.salt(descent, kind)))

    @staticmethod
    def salt(descent: int, kind: int) -> np.uint64:
        return mixed(np.array([descent * 4 + kind + 1], np.uint64))[0]

    def _choose(self, node: np.ndarray, luck: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn by ``luck`` from the open weights (by width), and the log mass not taken."""
        running = weight.cumsum(1)
        aim = np.minimum(luck * running[:, -1], np.nextafter(running[:, -1], 0))
        column = (running <= aim[:, None]).sum(1)
        weight[np.arange(len(node)), column] = 0
        with np.errstate(divide="ignore"):
            return self.lattice.edge(node, column + 1), np.log(weight.sum(1))

    def walk(self, descent: int, token: np.ndarray, node: np.ndarray) -> Path:
        """Descend from the nodes, one per unit in order, to the ends of the units."""
        lattice, steps = self.lattice, []
        at, place = np.arange(len(token)), self.place[token] + lattice.size[self.unit[token]]
        key, salt = self.keys[self.doc[token]], self.salt(descent, 0)
        count = np.zeros(len(token), np.int64)
        while len(at):
            luck = chance(key ^ mixed((place - lattice.level[node]).astype(np.uint64) + salt))
            edge, rest = lattice.best[node], lattice.best_rest[node]
            likely = lattice.chance[edge]
            off = np.flatnonzero(luck >= likely)
            off = off[~np.isneginf(rest[off])]
            if len(off):
                weight = lattice.weights(node[off])
                weight[np.arange(len(off)), lattice.width[edge[off]] - 1] = 0
                taken = likely[off]
                edge[off], other = self._choose(node[off], np.minimum((luck[off] - taken) / (1 - taken), 1.0), weight)
                rest[off] = np.logaddexp(other, np.log(taken))
            steps.append((at, count[at], node, edge, rest))
            count[at] += 1
            node = lattice.target[edge]
            on = np.flatnonzero(node < lattice.nodes)
            at, node, place, key = at[on], node[on], place[on], key[on]
        start = np.cumsum(count) - count
        nodes, edges, rests = (np.empty(int(count.sum()), t) for t in (np.int64, np.int64, float))
        for at, nth, *found in steps:
            to = start[at] + nth
            nodes[to], edges[to], rests[to] = found
        return Path(np.repeat(token, count), nodes, edges, lattice.log[edges], rests)

    def samples(self, asked: int) -> Iterator[tuple[np.ndarray, Path, np.ndarray, np.ndarray]]:
        """Per descent: the texts it has, its path, and their log probability and perturbed value."""
        n = len(self.counts)
        texts = np.flatnonzero(self.counts > 0)
        begin = mixed(np.array([SEED], np.uint64))
        value = np.full(n, -np.inf)
        value[texts] = -np.log(-np.log(chance(self.keys[texts] ^ begin)))
        token = np.flatnonzero(self.counts[self.doc] > 0) if len(self.doc) else np.zeros(0, np.int64)
        path = self.walk(0, token, self.lattice.start[self.unit[token]])
        split = np.full(n, -1, np.int64)  # the step where a descent left its parent
        used = np.zeros(n, np.int64)      # bits of the edges taken there
        # the queue of each text: bound, descent and step
        bound, of, step = [np.zeros((n, 0), x) for x in (float, np.int64, np.int64)]
        paths, splits, useds = [], [], []
        self.threshold = np.full(n, -np.inf)
        for descent in range(asked):
            starts = np.searchsorted(self.doc[path.token], np.arange(n + 1))
            total = np.concatenate([[0.0], np.cumsum(path.log)])
            before = total[:-1] - total[starts[self.doc[path.token]]]
            yield texts, path, (total[starts[1:]] - total[starts[:-1]])[texts], value[texts]
            paths.append(path)
            splits.append(split)
            useds.append(used)
            doc = self.doc[path.token]
            at = np.arange(len(doc)) - starts[doc]
            # only steps with other edges, and none that the parent's queue holds already
            left = np.flatnonzero(~np.isneginf(path.rest) & (at >= split[doc]))
            doc, mass = doc[left], before[left] + path.rest[left]
            luck = np.log(-np.log(self.draw(descent, 1, path.token[left], path.node[left])))
            limit = mass - np.logaddexp(mass - value[doc], luck)
            heads = np.searchsorted(doc, np.arange(n + 1))
            has = np.flatnonzero(heads[1:] > heads[:-1])
            for _ in range(asked - descent):  # as many as may still be popped, the threshold included
                best = np.full(n, -np.inf)
                if len(limit):
                    best[has] = np.maximum.reduceat(limit, heads[has])
                where = np.flatnonzero((limit == best[doc]) & ~np.isneginf(limit))
                who, first = np.unique(doc[where], return_index=True)
                chosen = np.full(n, -1, np.int64)
                chosen[who] = left[where[first]]
                limit[where[first]] = -np.inf
                bound = np.hstack([bound, best[:, None]])
                of = np.hstack([of, np.full((n, 1), descent)])
                step = np.hstack([step, np.where(chosen >= 0, chosen - starts[:-1], -1)[:, None]])
            top = bound.argmax(1)
            rows = np.arange(n)
            value, parent, place = bound[rows, top], of[rows, top], step[rows, top]
            bound[rows, top] = -np.inf
            texts = np.flatnonzero(~np.isneginf(value))
            self.threshold = value
            if descent + 1 == asked or not len(texts):
                return
            path, split, used = self._next(descent + 1, texts, parent, place, paths, splits, useds)

    def _next(self, descent: int, texts: np.ndarray, parent: np.ndarray, place: np.ndarray, paths: list, splits: list,
              useds: list) -> tuple[Path, np.ndarray, np.ndarray]:
        """The next path of each text: the parent's up to the step, another edge there, and new draws behind it."""
        n = len(self.counts)
        kept, tokens, nodes, taken = [], [], [], []
        split, used = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for d, old in enumerate(paths):
            mine = np.zeros(n, bool)
            mine[texts[parent[texts] == d]] = True
            if not mine.any():
                continue
            doc = self.doc[old.token]
            starts = np.searchsorted(doc, np.arange(n + 1))
            at = np.arange(len(doc)) - starts[doc]
            kept.append(old.part(np.flatnonzero(mine[doc] & (at < place[doc]))))
            who = np.flatnonzero(mine)
            turn = starts[who] + place[who]
            tokens.append(old.token[turn])
            nodes.append(old.node[turn])
            again = np.where(splits[d][who] == place[who], useds[d][who], 0)
            taken.append(again | (1 << self.lattice.width[old.edge[turn]] - 1))
            split[who], used[who] = place[who], taken[-1]
        turn, node, taken = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(taken)
        order = np.argsort(turn)
        turn, node, taken = turn[order], node[order], taken[order]
        weight = np.where(taken[:, None] >> np.arange(WIDEST) & 1, 0.0, self.lattice.weights(node))
        edge, rest = self._choose(node, self.draw(descent, 0, turn, node), weight)
        path = Path(turn, node, edge, self.lattice.log[edge], rest)
        for old in kept:
            path = Path.joined(old, path, len(self.doc))
        last = np.full(n, np.iinfo(np.int64).max)
        last[self.doc[turn]] = turn
        later = np.flatnonzero(np.arange(len(self.doc)) > last[self.doc])
        node = self.lattice.target[edge]
        on = node < self.lattice.nodes
        walkers = np.concatenate([turn[on], later])
        order = np.argsort(walkers)
        fresh = self.walk(descent, walkers[order],
                          np.concatenate([node[on], self.lattice.start[self.unit[later]]])[order])
        return Path.joined(path, fresh, len(self.doc)), split, used

    def ids(self, path: Path) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the path's pieces, and how many of them each text has."""
        ids = self.lattice.piece[path.edge]
        doc = self.doc[path.token]
        spare = np.flatnonzero(ids == _FALLBACK)
        if len(spare):
            many = [self.lattice.vocabulary.fallback(int(c)) for c in self.lattice.codes[path.node[spare]]]
            size = np.ones(len(ids), np.int64)
            size[spare] = [len(m) for m in many]
            doc = np.repeat(doc, size)
            first = np.cumsum(size) - size
            ids = np.repeat(ids, size)
            for at, m in zip(first[spare], many):
                ids[at:at + len(m)] = m
        return ids, np.bincount(doc, minlength=len(self.counts))


def units_of(text: str) -> list[str]:
    """The units of a text without their first space."""
    words = text.split(" ")
    if "" not in words:
        return words
    if text == "":
        return []
    units, spaces = [], 0
    for w in words:
        if w:
            units.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    return [*units, " " * (spaces - 1)] if spaces else units


def log_inclusion(log: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(log - threshold))): the chance that a segmentation's perturbed value passes the threshold."""
    x = np.where(np.isneginf(threshold), np.inf, log - np.where(np.isneginf(threshold), 0, threshold))
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(np.maximum(x, -30), 50)))))


_ARROW = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())),
                    ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()),
                    ("log_inclusion", pa.float64()), ("decoded", pa.bool_())])
RESULT = ("doc_id bigint, sample int, ids array<int>, n_pieces bigint, log_prob double, perturbed double, "
          "log_inclusion double, decoded boolean")


def encode_block(vocabulary: Vocabulary, doc_ids: list, texts: list[bytes], asked: int) -> Iterator[pa.RecordBatch]:
    keys = np.array([i or 0 for i in doc_ids], np.int64).view(np.uint64)
    sampler = Sampler(vocabulary, [t.decode() for t in texts], keys)
    found = []
    for rank, (who, path, log, value) in enumerate(sampler.samples(asked)):
        found.append((rank + 1, who, *sampler.ids(path), log, value))
    bare = np.flatnonzero(sampler.counts == 0)
    if len(bare):
        value = -np.log(-np.log(chance(sampler.keys[bare])))
        found.insert(0, (1, bare, np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(len(bare)), value))
    for rank, who, ids, count, log, value in found:
        ends = np.cumsum(count)
        exact = [vocabulary.decode(ids[e - c:e].tolist()) == texts[d] for d, e, c in zip(who, ends[who], count[who])]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[who])]).astype(np.int32)),
                                         pa.array(ids, pa.int32()))
        yield to_batch(_ARROW, doc_id=[doc_ids[d] for d in who], sample=np.full(len(who), rank, np.int32), ids=lists,
                       n_pieces=count[who], log_prob=log, perturbed=value,
                       log_inclusion=log_inclusion(log, sampler.threshold[who]), decoded=exact)


def encode(docs: DataFrame, path: str = MODEL, samples: int = SAMPLES) -> DataFrame:
    """Up to ``samples`` distinct segmentations of every text, best perturbed value first, with their ids."""
    vocabulary = Vocabulary.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, BLOCK_BYTES):
            yield from encode_block(vocabulary, batch.column(0).to_pylist(), texts, samples)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, RESULT)


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows of ``encode`` with the ``text`` that their ids stand for."""
    vocabulary = Vocabulary.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = [vocabulary.decode(x or []).decode() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, "text"])
    return mapped(rows, run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))
