"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k search.

A text's segmentations into vocabulary pieces are the paths of a lattice. A path's probability is the
product of its pieces' weights, normalised; the weight of a piece falls with its rank in the
vocabulary (Zipf), to the power alpha. A character without a piece is spelled in byte pieces.

No piece joins two words or a letter to another kind of character, which is checked when the model is
loaded, so the lattice is a chain of the lattices of short chunks, which texts share; a chunk's nodes
are its places. New chunks' pieces are found by one walk down a trie from all places at once. Backward
sums over a node's arcs give exact probabilities of what follows.

The search draws k paths without replacement. The root carries a Gumbel value; the best path below it
is drawn arc by arc and keeps that value. What the path left aside is one subtree for each of its
arcs, whose value is a Gumbel of that subtree's probability truncated at the path's; A* takes up the
subtree of the highest value next, since no path of a subtree can exceed it. The k paths so found are
the k largest perturbed paths of all. The next value still waiting is the threshold of the inclusion
score: the probability that a path's own Gumbel value exceeds it. All documents of a batch advance
together, and every random number is a hash of the row's key and of its place, so a row gives the
same paths whatever it is batched with.

Cases: a null or empty text has one segmentation, of no pieces; a text with fewer than k
segmentations gives all it has; the key is the id and, where that is null, the text; equal rows give
equal samples; the character that stands for a space is spelled in bytes, so decoding is exact, also of
that character and of NUL; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.llm.shingles import mix
from octavo.llm.tokens import default_path
from octavo.plans.tables import tidy

SPACE = "▁"
#: Stands for a SPACE that the text itself holds; a lone surrogate, which no text can hold.
LITERAL = "\ud800"
#: Chunks up to so many characters are remembered; nodes after which all are forgotten.
CACHED_LENGTH = 40
CACHED_NODES = 4_000_000
#: Characters of a batch's texts that are sampled together.
BATCH_CHARS = 1 << 18

#: Underscores, carriage returns and a raised 2 are in the runs of other characters, since pieces join them to these.
_CHUNK = re.compile(f"{SPACE}*[^\\W\\d_²]+|{SPACE}*(?:[^\\w\\s{SPACE}]|[_\\r²])+|{SPACE}*\\d|{SPACE}+|.", re.S)

_loaded: dict[tuple[str, float], Lattice] = {}


class Trie:
    """Pieces by their characters, walked by many texts at a time. State 0 is the start; a hash table has each state's next ones."""

    EMPTY = -1

    def __init__(self, pieces: dict[str, int]):
        letters = sorted(set("".join(pieces)))
        #: Numbers of characters; 0 for those in no piece.
        self.kind_of = np.zeros(0x110000, dtype=np.uint16 if len(letters) < 1 << 16 else np.int32)
        self.kind_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.kinds = len(letters) + 1
        state_of, keys = {"": 0}, []
        for p in pieces:
            for i in range(1, len(p) + 1):
                if p[:i] not in state_of:
                    state_of[p[:i]] = len(state_of)
                    keys.append(state_of[p[: i - 1]] * self.kinds + int(self.kind_of[ord(p[i - 1])]))
        self.piece = np.full(len(state_of), -1, dtype=np.int32)
        for p, i in pieces.items():
            self.piece[state_of[p]] = i
        keys = np.array(keys, dtype=np.int64)
        self.goes_on = np.zeros(len(state_of), dtype=bool)
        self.goes_on[keys // self.kinds] = True
        self.bits = (4 * len(keys)).bit_length()
        self.key, self.next = np.full(1 << self.bits, self.EMPTY), np.zeros(1 << self.bits, dtype=np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = left[self.key[slot[left]] == self.EMPTY]
            self.key[slot[free]] = keys[free]  # of several the last stays
            put = free[self.key[slot[free]] == keys[free]]
            self.next[slot[put]] = put + 1
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The states that follow, 0 where there is none."""
        keys = state.astype(np.int64) * self.kinds + kind
        slot = self._slot(keys)
        held = self.key[slot]
        while len(other := np.flatnonzero((held != keys) & (held != self.EMPTY))):
            slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
            held[other] = self.key[slot[other]]
        return np.where(held == keys, self.next[slot], 0)


class Lattice:
    """Nodes and arcs of chunks; node 0 is the end of a chunk."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.bytes = {bytes([int(sp.id_to_piece(i)[3:5], 16)]): i for i in range(len(sp)) if sp.is_byte(i)}
        plain = [
            i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        if across := [p for p in self.pieces if _CHUNK.findall(p) != [p]]:
            raise ValueError(f"{len(across)} pieces cross a chunk's edge, such as {across[:5]}")
        self.longest = max(map(len, self.pieces))
        low, n = min(plain), len(sp)
        self.weight = {p: -alpha * math.log(2 + i - low) for p, i in self.pieces.items()}
        #: Lengths of the pieces that begin with two characters, or are one; the longest first, which mostly is
        #: the likeliest and so the one that a draw should try first.
        lengths: dict[str, set[int]] = {}
        for p in self.pieces:
            lengths.setdefault(p[:2], set()).add(len(p))
        self.lengths = {p: sorted(x, reverse=True) for p, x in lengths.items()}
        self.byte_weight = -alpha * math.log(2 + n)
        #: Arcs' output: rows of flat; one for each piece, later one for each spelled character.
        self.out_start, self.out_size = list(range(n)), [1] * n
        self.out_weight = [0.0] * n
        for p, i in self.pieces.items():
            self.out_weight[i] = self.weight[p]
        self.out_ids = list(range(n))
        self.spelled: dict[str, int] = {}
        self.trie = Trie(self.pieces)
        #: The output of each character by itself, -1 where it is not known yet.
        self.single = np.full(0x110000, -1, dtype=np.int32)
        self.columns = (np.empty(0),)
        self.text_of = [b""] * n
        for p, i in self.pieces.items():
            self.text_of[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.text_of[i] = b
        self._reset()

    @staticmethod
    def load(path: str, alpha: float) -> Lattice:
        """One lattice for each worker process, model and alpha."""
        if (path, alpha) not in _loaded:
            _loaded[path, alpha] = Lattice(path, alpha)
        return _loaded[path, alpha]

    def _reset(self) -> None:
        self.node_of = {"": 0}
        self.log_z = array("d", [0.0])
        self.first = array("q", [0, 0])
        self.arcs = (array("i"), array("i"), array("d"))

    def _spell(self, c: str) -> int:
        """The output that spells a character in byte pieces."""
        if c not in self.spelled:
            ids = [self.bytes[bytes([b])] for b in c.encode()]
            self.spelled[c] = len(self.out_size)
            self.out_start.append(len(self.out_ids))
            self.out_size.append(len(ids))
            self.out_weight.append(self.byte_weight * len(ids))
            self.out_ids += ids
        return self.spelled[c]

    def _node(self, rest: str, after: list[int]) -> int:
        """Adds the node of what is left of a chunk; after[i] is the node i characters on."""
        outs, nexts, logs = self.arcs
        pieces, weight, log_z = self.pieces, self.weight, self.log_z
        found = []
        head = rest[0]
        if head in pieces:
            found.append((pieces[head], after[1], weight[head] + log_z[after[1]]))
        else:
            c = SPACE if head == LITERAL else head
            found.append((self._spell(c), after[1], self.byte_weight * len(c.encode()) + log_z[after[1]]))
        for i in self.lengths.get(rest[:2], ()):
            if 1 < i <= len(rest):
                piece = rest[:i]
                if piece in pieces:
                    found.append((pieces[piece], after[i], weight[piece] + log_z[after[i]]))
        if len(found) == 1:
            z = found[0][2]
        else:
            top = max(x[2] for x in found)
            z = top + math.log(sum([math.exp(x[2] - top) for x in found]))
        for out, node, log in found:
            outs.append(out)
            nexts.append(node)
            logs.append(log - z)
        log_z.append(z)
        self.first.append(len(outs))
        return len(log_z) - 1

    def _long_chunk(self, chunk: str) -> int:
        """Adds the nodes of a chunk that is not remembered."""
        n = len(chunk)
        at = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            at[i] = self._node(chunk[i : i + self.longest], at[i : i + self.longest + 1])
        return at[0]

    def _grow(self, chunks: list[str]) -> None:
        """Adds the nodes of many chunks together, one for each place in them: places by what is left of their chunk, and
        of each the arcs of its pieces, longest first. The pieces are found by a walk down the trie from all places at once."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        at = np.argsort(left.astype(np.uint8), kind="stable")  # a chunk is shorter than 256
        left, base, n = left[at], len(self.log_z), len(codes)
        node = np.empty(n + 1, dtype=np.int32)
        node[at] = np.arange(base, base + n)
        single = self.single[codes]
        for code in np.unique(codes[single < 0]).tolist():
            c = chr(code)
            self.single[code] = self.pieces[c] if c in self.pieces else self._spell(SPACE if c == LITERAL else c)
        kinds, trie = self.trie.kind_of[codes], self.trie
        found = [(np.arange(n), self.single[codes[at]])]
        state, live = trie.step(np.zeros(n, dtype=np.int64), kinds[at]), np.arange(n)
        for size in range(2, self.longest + 1):
            on = np.flatnonzero(trie.goes_on[state] & (state > 0) & (left[live] >= size))
            live = live[on]
            state = trie.step(state[on], kinds[at[live] + size - 1])
            piece = trie.piece[state]
            ends = np.flatnonzero((state > 0) & (piece >= 0))
            found.append((live[ends], piece[ends]))
        counts = np.zeros(n, dtype=np.int64)
        for who, _ in found:
            counts[who] += 1
        end = np.cumsum(counts)
        start, to = end - counts, end.copy()
        out, after = np.empty(end[-1], dtype=np.int32), np.empty(end[-1], dtype=np.int32)
        for size, (who, piece) in enumerate(found, 1):
            to[who] -= 1
            put = to[who]
            out[put] = piece
            after[put] = np.where(left[who] > size, node[at[who] + size], 0)
        # The column grows in place: a batch's work is not to depend on how many nodes there are.
        self.log_z.frombytes(bytes(8 * n))
        log, z = self.outputs()[0][out], np.frombuffer(self.log_z)
        cuts = np.flatnonzero(np.diff(left, prepend=0, append=1 << 40))
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = start[first], end[last - 1]
            v = log[a:b] + z[after[a:b]]
            segments, many = start[first:last] - a, counts[first:last]
            top = np.maximum.reduceat(v, segments)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), segments))
            z[base + first : base + last] = total
            log[a:b] = v - np.repeat(total, many)
        self.first.frombytes((len(self.arcs[0]) + end).tobytes())
        for column, values in zip(self.arcs, (out, after, log), strict=True):
            column.frombytes(values.tobytes())
        self.node_of.update(zip(chunks, node[np.cumsum(sizes) - sizes].tolist(), strict=True))

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, LITERAL)
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE))

    def roots(self, chunks: list[str]) -> list[int]:
        if len(self.log_z) > CACHED_NODES:
            self._reset()
        known = self.node_of
        out = list(map(known.get, chunks))
        missing = [i for i, node in enumerate(out) if node is None]
        if missing:
            fresh = [c for c in {chunks[i] for i in missing} if len(c) <= CACHED_LENGTH]
            if fresh:
                self._grow(fresh)
            for i in missing:
                node = known.get(chunks[i])
                out[i] = self._long_chunk(chunks[i]) if node is None else node
        return out

    def outputs(self):
        """Weights, first ids and numbers of ids of the outputs, and all ids."""
        if len(self.columns[0]) < len(self.out_size):
            self.columns = tuple(np.array(x) for x in (self.out_weight, self.out_start, self.out_size, self.out_ids))
        return self.columns

    def tables(self):
        """first arc of each node, arcs' outputs, next nodes and log probabilities, as views of the columns.

        No node can be added while a view is held.
        """
        return tuple(np.frombuffer(x, dtype=x.typecode) for x in (self.first, *self.arcs))

    def spells(self, ids: np.ndarray, text: str) -> bool:
        """Whether the ids decode to the text."""
        return b"".join(map(self.text_of.__getitem__, ids.tolist())) == (b" " + text.encode() if text else b"")

    def decode(self, ids) -> str:
        """Text of ids; the first space is the one that encoding puts in front."""
        return b"".join([self.text_of[i] for i in ids]).decode("utf-8", "replace")[1:]


#: What a random number is for.
ROOT, ARC, ASIDE, TURN = range(4)


def _uniform(seed: np.ndarray, a: np.ndarray, purpose: int, rank: int = 0, more: int = 0) -> np.ndarray:
    """Numbers in (0, 1) that are a hash of a row's seed and of what they are for: purpose, rank of the path
    (below 2**20) and two counters. No two uses share their counters."""
    b = purpose | rank << 2 | more << 22
    x = mix(seed + a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _draw(tables, node: np.ndarray, doc: np.ndarray, word: np.ndarray, seed: np.ndarray, rank: int):
    """Free draws from the nodes on to their chunks' ends, all in lockstep: arcs in the order of the nodes
    given, and how many each took."""
    first, _, after, log_p = tables
    taken, counts, step = [], np.zeros(len(node), dtype=np.int64), 0
    live = np.flatnonzero(node > 0)
    node = node[live]
    while len(live):
        left = _uniform(seed[doc[live]], word[live] * np.int64(64) + step % 64, ARC, rank, step // 64)
        arc, last = first[node], first[node + 1] - 1
        moving = np.arange(len(live))
        while len(moving):
            p = np.exp(log_p[arc[moving]])
            on = (left[moving] >= p) & (arc[moving] < last[moving])
            left[moving[on]] -= p[on]
            moving = moving[on]
            arc[moving] += 1
        taken.append((live, arc))
        counts[live] += 1
        node = after[arc]
        go = node > 0
        node, live = node[go], live[go]
        step += 1
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.int64)
    for step, (who, arc) in enumerate(taken):
        out[begin[who] + step] = arc
    return out, counts


def sample(lattice: Lattice, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (ids, log probability, perturbed value, inclusion score), best first."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return _sample(lattice, texts, seeds, k)


def _sample(lattice, texts, seeds, k):
    n = len(texts)
    chunks = [lattice.chunks(t) for t in texts]
    counts = np.array([len(c) for c in chunks])
    roots = np.array(lattice.roots(list(chain.from_iterable(chunks))), dtype=np.int64)
    tables = lattice.tables()
    first, outs, after, log_p = tables
    doc = np.repeat(np.arange(n), counts)
    word = np.arange(len(roots))
    local = word - np.repeat(np.cumsum(counts) - counts, counts)
    owner_first = np.concatenate([[0], np.cumsum(counts)])

    gumbel = -np.log(-np.log(_uniform(seeds, np.zeros(n, dtype=np.int64), ROOT)))
    arcs, steps = _draw(tables, roots, doc, local, seeds, 0)
    found: list[list] = [[] for _ in range(n)]
    waiting: list[list] = [[] for _ in range(n)]

    def settle(path: np.ndarray, sizes: np.ndarray, which: np.ndarray, values: np.ndarray, begins: np.ndarray, barred: list, rank: int):
        """Emits the paths of documents ``which``, so many arcs each, and queues the best subtrees they left aside."""
        ends = np.cumsum(sizes)
        cuts = ends - sizes
        owner = np.repeat(np.arange(len(which)), sizes)
        lp = log_p[path]
        before = np.empty(len(lp))
        for a, b in zip(cuts, ends, strict=False):
            before[a:b] = np.cumsum(lp[a:b]) - lp[a:b]
        aside = np.log(-np.expm1(np.minimum(lp, -1e-300)))
        aside[lp > -1e-12] = -np.inf
        phi = before + aside
        wait = -np.log(_uniform(seeds[which][owner], np.arange(len(lp)) - cuts[owner], ASIDE, rank))
        value = -np.logaddexp(-values[owner], np.log(wait) - phi)
        for r, d in enumerate(which):
            a, b = cuts[r], ends[r]
            score = float(before[b - 1] + lp[b - 1]) if b > a else 0.0
            found[d].append((path[a:b], score, float(values[r])))
            start = a + begins[r]
            options = []
            if b > start:
                v = value[start:b].copy()
                if barred[r]:
                    # At the arc where this path left its elder, what both took is barred.
                    node_first, node_end = barred[r][1]
                    taken = barred[r][0] | {int(path[start])}
                    rest = [x for x in range(node_first, node_end) if x not in taken]
                    mass = np.logaddexp.reduce(log_p[rest]) if rest else -np.inf
                    f = before[start] + mass
                    v[0] = -np.logaddexp(-values[r], math.log(wait[start]) - f) if rest else -np.inf
                top = np.argpartition(-v, min(k, len(v) - 1))[: k + 1]
                for t in top:
                    if np.isfinite(v[t]):
                        same = barred[r][0] if barred[r] and t == 0 else set()
                        options.append((float(v[t]), len(found[d]) - 1, int(begins[r] + t), same | {int(path[start + t])}))
            waiting[d] = sorted(waiting[d] + options, key=lambda x: -x[0])[: k + 1]

    settle(arcs, np.bincount(doc, steps, n).astype(np.int64), np.arange(n), gumbel, np.zeros(n, dtype=np.int64), [None] * n, 0)
    for rank in range(1, k):
        which = np.array([d for d in range(n) if waiting[d]], dtype=np.int64)
        if not len(which):
            break
        kept, values, begins, barred, picked, places = [], [], [], [], [], []
        for d in which:
            value, of, t, taken = waiting[d].pop(0)
            elder = found[d][of][0]
            node = int(np.searchsorted(first, elder[t], "right")) - 1
            a, b = int(first[node]), int(first[node + 1])
            options = [x for x in range(a, b) if x not in taken]
            p = np.exp(log_p[options] - np.logaddexp.reduce(log_p[options]))
            u = float(_uniform(seeds[d : d + 1], np.array([t]), TURN, rank)[0])
            arc = options[min(int(np.searchsorted(np.cumsum(p), u)), len(options) - 1)]
            w = int((after[elder[:t]] == 0).sum())
            kept.append((elder[:t], w))
            picked.append(arc)
            values.append(value)
            begins.append(t)
            barred.append((taken, (a, b)))
            places.append(w)
        picked, places = np.array(picked), np.array(places)
        # Each path goes on with what is left of its word, then with the words after it.
        more = counts[which] - places
        begin = np.cumsum(more) - more
        owner = np.repeat(np.arange(len(which)), more)
        on_word = places[owner] + np.arange(len(owner)) - begin[owner]
        nodes = roots[owner_first[which[owner]] + on_word]
        nodes[begin] = after[picked]
        arcs, steps = _draw(tables, nodes, which[owner], on_word, seeds, rank)
        heads, tails = np.array([len(x) for x, _ in kept]), np.bincount(owner, steps, len(which)).astype(np.int64)
        sizes = heads + 1 + tails
        at = np.cumsum(sizes) - sizes
        path = np.empty(int(sizes.sum()), dtype=np.int64)
        spread = lambda n: np.repeat(np.arange(len(n)), n), lambda n: np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        path[at[spread[0](heads)] + spread[1](heads)] = np.concatenate([x for x, _ in kept])
        path[at + heads] = picked
        path[(at + heads + 1)[spread[0](tails)] + spread[1](tails)] = arcs
        settle(path, sizes, which, np.array(values), np.array(begins), barred, rank)

    _, out_start, out_size, flat = lattice.outputs()
    result = []
    for d in range(n):
        threshold = waiting[d][0][0] if waiting[d] else -math.inf
        rows = []
        for arcs, score, value in found[d]:
            o = outs[arcs]
            size = out_size[o]
            ids = flat[np.repeat(out_start[o] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            inclusion = 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(50.0, score - threshold)))
            rows.append((ids, score, value, inclusion))
        result.append(rows)
    return result


def sample_segmentations(
    docs: DataFrame,
    k: int = 2,
    alpha: float = 1.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text: str = "text",
    model: str | None = None,
    verify: bool = False,
    packed: bool = False,
) -> DataFrame:
    """One row per document and sample: doc_id, sample, ids, log_prob, perturbed, inclusion.

    With packed the ids are bytes, little-endian unsigned 32-bit numbers, which are cheaper to write. With verify
    there is a column decoded: whether the ids decode to the text.
    """
    path = model or default_path("piece_bpe_32k.model")
    kind = "binary" if packed else "array<int>"
    schema = f"doc_id long, sample int, ids {kind}, log_prob double, perturbed double, inclusion double" + ", decoded boolean" * verify
    names = [x.split()[0] for x in schema.split(", ")]

    def runs(batch: pa.RecordBatch):
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            t = t.as_py() or ""
            if texts and size + len(t) > BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i.as_py())
            texts.append(t)
            size += len(t)
        if texts:
            yield ids, texts

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(path, alpha)
        for batch in batches:
            for ids, texts in runs(batch):
                keys = [f"t{zlib.crc32(t.encode())}" if i is None else f"i{i}" for i, t in zip(ids, texts, strict=True)]
                seeds = mix(np.array([zlib.crc32(x.encode()) | zlib.crc32(x[::-1].encode(), seed + 1) << 32 for x in keys], dtype=np.uint64))
                rows = [
                    (i, number, t, *found)
                    for i, t, samples in zip(ids, texts, sample(lattice, texts, seeds, k), strict=True)
                    for number, found in enumerate(samples)
                ]
                pieces = [r[3] for r in rows]
                if packed:
                    column = pa.array([p.astype("<u4").tobytes() for p in pieces], pa.binary())
                else:
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces).astype(np.int32)))
                out = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    column,
                    *[pa.array([r[j] for r in rows], pa.float64()) for j in (4, 5, 6)],
                ]
                if verify:
                    out.append(pa.array([lattice.spells(r[3], r[2]) for r in rows], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names=names)
        tidy()

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(sampled, schema)


def decode_ids(samples: DataFrame, ids: str = "ids", into: str = "text", model: str | None = None) -> DataFrame:
    """samples with the text of its ids; null ids give null."""
    path = model or default_path("piece_bpe_32k.model")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(path, 1.0)
        for batch in batches:
            texts = [None if x is None else lattice.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    from pyspark.sql.types import StringType, StructField, StructType

    return samples.mapInArrow(decoded, StructType([*samples.schema.fields, StructField(into, StringType())]))
