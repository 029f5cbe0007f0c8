"""SentencePiece encoding and decoding with distinct sampled segmentations.

All segmentations of a text are the paths of a lattice of vocabulary pieces.  A piece weighs
``1 / (rank + 2)``, its place in the model's order of merges, and characters without a piece are their
bytes; a path is as likely as the product of its weights.  Pieces never reach across the start of a run
of spaces, nor across a few characters that the vocabulary keeps apart, so the lattice of a text is a
chain of small lattices, one per *unit*; a unit is compiled once per task: backward sums turn weights
into exact conditional probabilities.

Sampling is Gumbel top-k without replacement by best-first search.  A search node is a set of paths: all
that follow a known path up to some piece and leave it there.  Its bound is a Gumbel variable with the
set's total probability as location, truncated at the bound it came from, and is the largest perturbed
log-probability in the set.  The first path is drawn piece by piece; its sets are drawn in one step;
the node with the best bound gives the next path.  The k+1-th bound turns probabilities into
inclusion scores.  Random numbers come from the row key alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, compress, pairwise, repeat
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from framelake.llm.common import rows_in

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
SAMPLES, SEED = 3, 1
CHARS_AT_ONCE = 500_000  # of texts whose units are compiled together
# Characters looked at for cuts; one is used only if no piece of the model has it behind another character.
CUT_BEFORE = "\n\t\r"
# Signs before which a run of letters ends its unit, if no piece of the model has a letter right before them.
CUT_BETWEEN = ",.;:!?|#$%&*"
UNITS_AT_ONCE = 8192  # compiled together
EDGES_KEPT = 3_200_000  # compiled edges a task keeps (24 bytes each) before it drops the words that came once only
WINDOW = 48  # pieces of a path whose sets are drawn first
GUMBEL_MOST = 37.5  # no Gumbel variable of a draw from ``_uniform`` below 1 is that far above its location


ODD = np.uint64(0x9E3779B97F4A7C15)
MASK = 2**64 - 1


class Pieces:
    """The vocabulary of a model file: pieces, weights, bytes, and how texts are cut into units."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.bytes = [b""] * size
        self.byte_id = [0] * 256
        self.log_weight = np.zeros(size)
        pieces: dict[str, int] = {}
        behind: set[str] = set()
        behind_letter: set[str] = set()
        self.single: set[str] = set()
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes[k] = k, bytes([value])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.bytes[k] = piece.replace(SPACE, " ").encode()
                rank = min(-model.get_score(k), float(size))
                pieces[piece] = k
                self.log_weight[k] = -log(rank + 2)
                behind.update(piece[1:])
                behind_letter.update(b for a, b in pairwise(piece) if a.isalpha())
                if len(piece) == 1:
                    self.single.add(piece)
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} reaches across the start of a space")
        self._grow_trie(pieces)
        self.table = pa.array(self.bytes, pa.large_binary())
        self.log_byte = -log(size + 2)
        self.has_piece = np.zeros(max(map(ord, self.single), default=0) + 2, bool)  # by code point; past the last one there is none
        self.has_piece[[ord(c) for c in self.single]] = True
        self.apart = next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in behind | self.single)  # in no piece
        cuts = re.escape("".join(c for c in CUT_BEFORE if c not in behind))
        signs = re.escape("".join(c for c in CUT_BETWEEN if c not in behind_letter))
        word = f"{SPACE}*[^\\W\\d_]+(?=[{signs}])|" if signs else ""
        self.unit = re.compile(f"{word}{SPACE}*[^{SPACE}{cuts}]+|{SPACE}+|[{cuts}][^{SPACE}{cuts}]*" if cuts else f"{word}{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _grow_trie(self, pieces: dict[str, int]) -> None:
        """Steps (state, character) -> state in a hash table; state 0 is the root, ``piece_at`` the piece that ends in a state."""
        steps: dict[tuple[int, str], int] = {}
        ends = [-1]
        for piece, token in pieces.items():
            state = 0
            for c in piece:
                state = steps.setdefault((state, c), len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = token
        keys = np.array([(state << 21) | ord(c) for state, c in steps], np.int64)
        states = np.array(list(steps.values()), np.int32)
        self.piece_at = np.array(ends, np.int32)
        # where a character leads from the root, without a search; past the last one that begins a piece there is nothing
        begins = keys < 1 << 21
        self.root = np.full(int(keys[begins].max()) + 2, -1, np.int32)
        self.root[keys[begins]] = states[begins]
        # other steps lie in a table of three to six times their number, at their hash or the next free places
        bits = (3 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.step_keys, self.step_states = np.full((1 << bits) + len(keys), -1, np.int64), np.zeros((1 << bits) + len(keys), np.int32)
        keys, states = keys[~begins], states[~begins]
        place = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.step_keys[place] < 0)
            self.step_keys[place[free]], self.step_states[place[free]] = keys[free], states[free]
            waiting = np.flatnonzero(self.step_keys[place] != keys)
            keys, states, place = keys[waiting], states[waiting], place[waiting] + 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * ODD) >> self.shift).view(np.int64)

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every piece in a text of code points, all starts walked down the trie together."""
        state, found = self.root[np.minimum(codes, len(self.root) - 1)], []
        at = np.flatnonzero(state >= 0)
        state, length = state[at], 1
        while len(at):
            if length > 1:
                inside = at + length <= len(codes)
                at, state = at[inside], state[inside]
                keys = (state.astype(np.int64) << 21) | codes[at + length - 1]
                place = self._place(keys)
                there = self.step_keys[place]
                other = np.flatnonzero((there != keys) & (there >= 0))
                while len(other):
                    place[other] += 1
                    there[other] = self.step_keys[place[other]]
                    other = other[(there[other] != keys[other]) & (there[other] >= 0)]
                hit = np.flatnonzero(there == keys)
                at, state = at[hit], self.step_states[place[hit]]
            token = self.piece_at[state]
            ending = token >= 0
            found.append((at[ending], np.full(int(ending.sum()), length), token[ending]))
            length += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def units(self, text: str) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def units_of_words(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of words without spaces, end to end, and how many each word has."""
        joined = SPACE + SPACE.join(words)
        if joined.count(SPACE) > len(words):  # a word holds the sign itself
            units = [self.units(w) for w in words]
            return list(chain.from_iterable(units)), np.fromiter(map(len, units), np.int64, len(words))
        units = self.unit.findall(joined)  # none reaches across the start of a word
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        word_ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return units, np.diff(np.searchsorted(ends, word_ends, "right"), prepend=0)

    def decode_rows(self, ids: np.ndarray, sizes: list[int]) -> Iterator[bytes]:
        """The bytes of rows of token ids that lie end to end."""
        made = self.table.take(pa.array(ids))
        starts = np.frombuffer(made.buffers()[1], np.int64)[np.cumsum([0, *sizes])].tolist()
        view = memoryview(made.buffers()[2] or b"")
        for a, b in pairwise(starts):
            yield bytes(view[a:b])

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of token ids, as the library decodes them."""
        return self._text(next(self.decode_rows(np.asarray(ids, np.int64), [len(ids)])))

    @staticmethod
    def _text(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def decode_to(self, ids: np.ndarray, sizes: list[int], texts: list[str]) -> list[bool]:
        """Whether each row of ids (end to end) decodes to its text."""
        return [raw == b" " + text.encode() or self._text(raw) == text for raw, text in zip(self.decode_rows(ids, sizes), texts, strict=True)]


class Lattices:
    """Compiled units: for every node its edges with cumulative conditional probabilities, in flat arrays.

    A node is a character of a unit; nodes and, per node, edges are numbered through.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, int] = {}  # first node of every unit, in the order of nodes
        self.words: dict[str, int] = {}  # numbers of the words met behind one space
        self.word_begin = np.zeros(1, np.int64)  # by number: where the first nodes of the word's units begin in ``word_units``, and the end
        self.word_units = np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)  # by number: met again since the last time some were dropped
        self.nodes = 0
        self.begin = np.zeros(1, np.int32)  # first edge of every node, and the end
        self.cumulative, self.log_q = np.zeros(0), np.zeros(0)  # within the node; of the edge
        self.target, self.token = np.zeros(0, np.int32), np.zeros(0, np.int32)  # node (-1: the unit ends); id, or bytes if negative
        self.long_tokens: list[list[int]] = []
        self.byte_tokens: dict[int, tuple[int, int]] = {}  # token and number of bytes of characters without a piece

    def _drop_rare(self) -> None:
        """Keep the units of words met more than once; their nodes and edges move together."""
        counts = np.diff(self.word_begin)[self.again]
        firsts = self.word_units[_ranges(self.word_begin[:-1][self.again], counts)]
        used = np.zeros(self.nodes, bool)
        used[firsts] = True
        begins = np.fromiter(self.first.values(), np.int64, len(self.first))
        kept = used[begins]
        old, sizes = begins[kept], np.diff(begins, append=self.nodes)[kept]
        first_edge = self.begin[old].astype(np.int64)
        widths = self.begin[old + sizes] - first_edge
        if not len(old) or widths.sum() > EDGES_KEPT // 2:
            return self.clear()
        new, edges_before = np.cumsum(sizes) - sizes, np.cumsum(widths) - widths
        edges, nodes = _ranges(first_edge, widths), _ranges(old, sizes)
        begin = self.begin[nodes] + np.repeat(edges_before - first_edge, sizes)
        self.begin = np.append(begin, int(widths.sum())).astype(np.int32)
        target = self.target[edges]
        self.target = np.where(target < 0, target, target + np.repeat(new - old, widths)).astype(np.int32)
        for name in ("cumulative", "log_q", "token"):
            setattr(self, name, getattr(self, name)[edges])
        moved = np.zeros(self.nodes, np.int32)
        moved[old] = new
        self.nodes = int(sizes.sum())
        self.first = dict(zip(compress(self.first, kept.tolist()), new.tolist(), strict=True))
        words = list(compress(self.words, self.again.tolist()))
        self.words = dict(zip(words, range(len(words)), strict=True))
        self.word_begin, self.word_units, self.again = np.cumsum([0, *counts]), moved[firsts], np.zeros(len(words), bool)

    def starts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First nodes of the units of the texts, end to end, and how many each text has; units not yet known are compiled, all at once.

        Texts whose words single spaces separate are looked up word by word: a word's units do not
        depend on its neighbours.
        """
        if len(self.log_q) > EDGES_KEPT:
            self._drop_rare()
        plain = [bool(text) and "  " not in text and text[0] != " " != text[-1] for text in texts]
        # any other text is one empty word here
        cut = pc.split_pattern(pa.array([text if p else "" for text, p in zip(texts, plain, strict=True)], pa.string()), " ")
        encoded = cut.values.dictionary_encode()
        met, place, bounds = encoded.dictionary.to_numpy(zero_copy_only=False).tolist(), encoded.indices.to_numpy(), cut.offsets.to_numpy()
        known = self.words
        number = np.fromiter(map(known.get, met, repeat(-1)), np.int64, len(met))
        fresh = number < 0
        if "" in met:
            fresh[met.index("")] = False
        others = [self.pieces.units(text) for text, p in zip(texts, plain, strict=True) if not p]
        self.again[number[number >= 0]] = True
        words = list(compress(met, fresh.tolist()))
        units, counts = self.pieces.units_of_words(words) if words else ([], np.zeros(0, np.int64))
        first = self.first
        new = list(dict.fromkeys(u for u in chain(units, *others) if u not in first))
        for k in range(0, len(new), UNITS_AT_ONCE):
            self._compile(new[k:k + UNITS_AT_ONCE])
        if words:
            number[fresh] = np.arange(len(known), len(known) + len(words))
            known.update(zip(words, number[fresh].tolist(), strict=True))
            self._append("word_begin", np.cumsum(counts) + len(self.word_units))
            self._append("word_units", np.fromiter(map(first.__getitem__, units), np.int32, len(units)))
            self._append("again", np.zeros(len(words), bool))
        number, pool = number[place], self.word_units
        begins = self.word_begin[number]
        sizes = self.word_begin[number + 1] - begins
        if others:
            at = bounds[:-1][~np.array(plain)]
            sizes[at] = [len(x) for x in others]
            begins[at] = len(pool) + np.cumsum(sizes[at]) - sizes[at]
            pool = np.concatenate([pool, np.fromiter(map(first.__getitem__, chain(*others)), np.int32)])
        return pool[_ranges(begins, sizes)], np.add.reduceat(sizes, bounds[:-1])

    def _compile(self, units: list[str]) -> None:
        pieces = self.pieces
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)  # nodes of this call, from 0
        total = int(ends[-1])
        joined = pieces.apart.join(units)
        # edges: from the trie, and one per character without a piece
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        at, length, token = pieces.matches(codes)
        weight = pieces.log_weight[token]
        bare = np.flatnonzero(~pieces.has_piece[np.minimum(codes, len(pieces.has_piece) - 1)])
        fallback, inside = self._byte_edges(codes, bare, ends, sizes)
        at = np.concatenate([at, inside])
        token, length = np.concatenate([token, fallback[:, 0]]), np.concatenate([length, np.ones(len(inside), np.int64)])
        weight = np.concatenate([weight, fallback[:, 1] * pieces.log_byte])
        # places in the joined text count one separator per unit before them
        unit = np.repeat(np.arange(len(units)), sizes + 1)[at]
        node = at - unit
        order = np.argsort((node << 6) - length, kind="stable")  # by node
        node, token, weight, unit, length = node[order], token[order], weight[order], unit[order], length[order]
        after = np.where(node + length == ends[unit], total, node + length)
        # backward sums, all nodes with the same number of characters left in one step
        rest = np.zeros(total + 1)
        left = ends[unit] - node
        by_left = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        nodes, edge_weight, following = node[by_left], weight[by_left], after[by_left]
        heads = np.flatnonzero(np.diff(nodes, prepend=-1))
        widths, head_nodes = np.diff(heads, append=len(nodes)), nodes[heads]
        bounds = np.append(np.flatnonzero(np.diff(left[by_left[heads]], prepend=-1)), len(heads)).tolist()
        for a, b in pairwise(bounds):
            low, high = heads[a], heads[b] if b < len(heads) else len(nodes)
            terms, firsts = edge_weight[low:high] + rest[following[low:high]], heads[a:b] - low
            top = np.maximum.reduceat(terms, firsts)
            terms -= np.repeat(top, widths[a:b])
            rest[head_nodes[a:b]] = top + np.log(np.add.reduceat(np.exp(terms, out=terms), firsts))
        log_q = np.minimum(weight + rest[after] - rest[node], 0.0)
        begin = np.flatnonzero(np.diff(node, prepend=-1))
        # the likeliest edge of a node comes first, so most draws end there
        width = np.diff(begin, append=len(node))
        likeliest = np.flatnonzero(log_q == np.repeat(np.maximum.reduceat(log_q, begin), width))
        likeliest = likeliest[np.flatnonzero(np.diff(node[likeliest], prepend=-1))]
        for values in (log_q, token, after):
            values[begin], values[likeliest] = values[likeliest], values[begin]
        cumulative = np.exp(log_q)
        place = np.arange(len(node)) - np.repeat(begin, width)
        for k in range(1, int(width.max())):
            later = np.flatnonzero(place == k)
            cumulative[later] += cumulative[later - 1]
        cumulative[np.append(begin[1:], len(node)) - 1] = 2.0  # the last edge of a node takes what is left
        known = len(self.log_q)
        self.first.update(zip(units, (self.nodes + ends - sizes).tolist(), strict=True))
        self._append("begin", (np.append(begin[1:], len(node)) + known).astype(np.int32))
        self._append("cumulative", cumulative)
        self._append("log_q", log_q)
        self._append("target", np.where(after == total, -1, after + self.nodes))
        self._append("token", token)
        self.nodes += total

    def _append(self, name: str, values: np.ndarray) -> None:
        """Lengthen an array; its buffer doubles, so that a task does not copy it with every group."""
        old = getattr(self, name)
        n = len(old) + len(values)
        buffer = old if old.base is None else old.base
        if n > len(buffer):
            buffer = np.empty(2 * n, old.dtype)
            buffer[:len(old)] = old
        buffer[len(old):n] = values
        setattr(self, name, buffer[:n])

    def _byte_edges(self, codes: np.ndarray, bare: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, number of bytes) and place of every character that has no piece; separators have no edge."""
        places = bare[codes[bare] != ord(self.pieces.apart)]
        made = self.byte_tokens
        for code in set(np.unique(codes[places]).tolist()).difference(made):
            ids = [self.pieces.byte_id[b] for b in chr(code).encode()]
            if len(ids) > 1:
                self.long_tokens.append(ids)
            made[code] = (ids[0] if len(ids) == 1 else -len(self.long_tokens), len(ids))
        return np.array([made[c] for c in codes[places].tolist()], np.int64).reshape(-1, 2), places


def _ranges(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``first, first + 1, ...`` of every range, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(firsts - ends + sizes, sizes)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, step: int | np.ndarray = 0) -> np.ndarray:
    """One number in (0, 1) per key and step."""
    return ((_mixed(keys + np.asarray(step, np.uint64) * ODD) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Paths:
    """One path per text of a group, end to end, with its best open sets of paths."""

    def __init__(self, edges: np.ndarray, sizes: np.ndarray, texts: np.ndarray, bounds: np.ndarray, begins: np.ndarray,
                 taken: list[list[int]], lattices: Lattices, keys: np.ndarray, kept: int):
        """``texts``: which text each path is of; ``begins``: the piece its sets begin at, where ``taken`` are the edges of earlier paths;
        ``kept``: how many open sets of a path may be asked for."""
        self.edges, self.ends = edges, np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.texts, self.row = texts, {int(t): k for k, t in enumerate(texts)}
        self.bounds, self.begins, self.taken = bounds, begins, taken
        logs = lattices.log_q[edges]
        sums = np.empty(len(edges))  # per text, so that they do not depend on its neighbours
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            np.cumsum(logs[a:b], out=sums[a:b])
        self.log_p = np.zeros(len(sizes))
        self.log_p[sizes > 0] = sums[self.ends[sizes > 0] - 1]
        spent = np.array([np.exp(lattices.log_q[t]).sum() if t else 0.0 for t in taken])
        self.values, self.places = np.full((len(sizes), kept), -np.inf), np.zeros((len(sizes), kept), np.int64)
        # A set lies at most GUMBEL_MOST above the log-probability of the path up to its piece, which only falls:
        # the sets behind a piece are left out once the best ones before it lie higher than that.
        path, low, width = np.flatnonzero(sizes > begins), begins, WINDOW
        while len(path):
            piece = low[path, None] + np.arange(width)
            at = np.minimum(self.starts[path, None] + piece, len(edges) - 1)
            here = logs[at]
            share = -np.expm1(here)  # what is left beside the path's own edge
            if low is begins:
                share[:, 0] -= spent[path]
            row, column = np.nonzero((share > 1e-12) & (piece < sizes[path, None]))
            place = (sums[at] - here)[row, column] + np.log(share[row, column])
            draw = np.minimum(_uniform(keys[path[row]], piece[row, column].astype(np.uint64)), 1 - 2.0**-53)
            own = np.full(piece.shape, -np.inf)
            own[row, column] = place - np.log(np.exp(place - bounds[path[row]]) - np.log(draw))
            values, places = np.hstack([self.values[path], own]), np.hstack([self.places[path], piece])
            best = np.argsort(-values, axis=1, kind="stable")[:, :kept]
            self.values[path], self.places[path] = np.take_along_axis(values, best, 1), np.take_along_axis(places, best, 1)
            low, width = low + width, 2 * width
            path = path[low[path] < sizes[path]]
            path = path[sums[self.starts[path] + low[path] - 1] + GUMBEL_MOST >= self.values[path, -1]]
        self.next = np.zeros(len(sizes), np.int64)
        self.best = self.values[:, 0].copy()

    def path(self, k: int) -> np.ndarray:
        return self.edges[self.starts[k]:self.ends[k]]

    def take(self, k: int) -> int:
        """The piece of the best open set of path k, which is open no longer."""
        n = self.next[k]
        self.next[k] = n + 1
        self.best[k] = self.values[k, n + 1]
        return int(self.places[k, n])


class Sampler:
    """Distinct segmentations of texts."""

    def __init__(self, pieces: str | Pieces, samples: int = SAMPLES, seed: int = SEED):
        """``pieces``: a model file, or what was made of it."""
        self.pieces = Pieces(pieces) if isinstance(pieces, str) else pieces
        self.lattices = Lattices(self.pieces)
        self.samples, self.seed = samples, seed

    def _walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of random paths through the units that begin at ``nodes``, and the number of edges of each unit."""
        lattices, active, steps = self.lattices, np.arange(len(nodes)), []
        at = nodes
        counts = np.zeros(len(nodes), np.int64)
        while len(active):
            edge = lattices.begin[at]
            draw = _uniform(keys[active], len(steps))
            short = np.flatnonzero(lattices.cumulative[edge] <= draw)
            while len(short):
                edge[short] += 1
                short = short[lattices.cumulative[edge[short]] <= draw[short]]
            steps.append((active, edge))
            counts[active] += 1
            following = lattices.target[edge]
            open_ = following >= 0
            active, at = active[open_], following[open_]
        offsets = np.cumsum(counts) - counts
        path = np.empty(int(counts.sum()), np.int64)
        for step, (units, edge) in enumerate(steps):
            path[offsets[units] + step] = edge
        return path, counts

    def sample(self, text: str, row_key: int) -> list[tuple[np.ndarray, float, float, float]]:
        """Segmentations of one text; see ``sample_group``."""
        return self.sample_group([text], [row_key])[0]

    def sample_group(self, texts: list[str], row_keys: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Per text up to ``samples`` of (token ids, log-probability, perturbed log-probability, log of the inclusion score), best first."""
        starts, counts = self.lattices.starts(texts)
        seeds = _mixed(_mixed(np.array([k & MASK for k in row_keys], np.uint64) + ODD) + np.uint64(self.seed * int(ODD) & MASK))
        found = [self._first(starts, counts, seeds)]
        ends = np.cumsum(counts).tolist()
        while len(found) < self.samples:
            best = self._best(found, len(texts))
            chosen = np.flatnonzero(best.max(axis=0) > -np.inf)
            if not len(chosen):
                break
            parents = best[:, chosen].argmax(axis=0)
            found.append(self._next(found, chosen, parents, best[parents, chosen], starts, ends, seeds, len(found)))
        return self._results(found, len(texts))

    @staticmethod
    def _best(found: list[Paths], texts: int) -> np.ndarray:
        """Bound of the best open set of every path found so far (rows) and text (columns)."""
        best = np.full((len(found), texts), -np.inf)
        for row, p in zip(best, found, strict=True):
            row[p.texts] = p.best
        return best

    @staticmethod
    def _keys(seeds: np.ndarray, counts: list[int] | np.ndarray, stream: int) -> np.ndarray:
        """A key per unit (counted from the text's end, so that it does not depend on what came before) of every text."""
        sizes = np.array(counts, np.int64)
        total = int(sizes.sum())
        from_end = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)
        return _mixed(np.repeat(seeds, sizes) + np.uint64(stream * 0xD1B54A32D192ED03 & MASK) + from_end.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))

    def _first(self, starts: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> Paths:
        path, pieces = self._walk(starts, self._keys(seeds, counts, 0))
        sums = np.concatenate([[0], np.cumsum(pieces)])
        sizes = np.diff(sums[np.cumsum(counts)], prepend=0)
        bounds = -np.log(-np.log(_uniform(_mixed(seeds + np.uint64(1)))))
        n = len(counts)
        return Paths(path, sizes, np.arange(n), bounds, np.zeros(n, np.int64), [[] for _ in range(n)], self.lattices, _mixed(seeds + np.uint64(2)), self.samples)

    def _next(self, found: list[Paths], chosen: np.ndarray, parents: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: list[int],
              seeds: np.ndarray, n: int) -> Paths:
        """A path out of each chosen set: it leaves the parent at the set's piece by an edge not yet taken there."""
        lattices = self.lattices
        own_seeds = seeds[chosen]
        draws = _uniform(_mixed(own_seeds + np.uint64(3 * n)))
        rows = [found[parent].row[text] for parent, text in zip(parents.tolist(), chosen.tolist(), strict=True)]
        begins = [found[parent].take(k) for parent, k in zip(parents.tolist(), rows, strict=True)]
        heads = [found[parent].path(k)[:t + 1] for parent, k, t in zip(parents.tolist(), rows, begins, strict=True)]
        nodes = np.searchsorted(lattices.begin, np.array([head[-1] for head in heads], lattices.begin.dtype), "right") - 1
        lows, highs = lattices.begin[nodes].tolist(), lattices.begin[nodes + 1].tolist()
        ways, rests, takens = [], [], []
        for parent, k, t, head, text, draw, low, high in zip(parents.tolist(), rows, begins, heads, chosen.tolist(), draws.tolist(), lows, highs, strict=True):
            p = found[parent]
            taken = [*(p.taken[k] if t == p.begins[k] else []), int(head[t])]
            edges = [e for e in range(low, high) if e not in taken]
            running = np.cumsum(np.exp(lattices.log_q[edges]))
            edge = edges[min(int(running.searchsorted(draw * running[-1], "right")), len(edges) - 1)]
            done = np.count_nonzero(lattices.target[head[:t]] < 0)
            rest = starts[(ends[text - 1] if text else 0) + done + 1:ends[text]]
            if lattices.target[edge] >= 0:
                rest = np.concatenate([lattices.target[edge:edge + 1], rest])
            ways.append([edge])
            rests.append(rest)
            takens.append(taken)
        counts = [len(x) for x in rests]
        tail, pieces = self._walk(np.concatenate(rests), self._keys(own_seeds, counts, n))
        cuts = np.concatenate([[0], np.cumsum(pieces)])[np.concatenate([[0], np.cumsum(counts)])]
        path = np.concatenate([x for head, way, (a, b) in zip(heads, ways, pairwise(cuts.tolist()), strict=True) for x in (head[:-1], way, tail[a:b])])
        return Paths(path, np.array(begins) + 1 + np.diff(cuts), chosen, bounds, np.array(begins), takens, lattices,
                     _mixed(own_seeds + np.uint64(3 * n + 1)), self.samples)

    def _results(self, found: list[Paths], texts: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        lattices = self.lattices
        thresholds = self._best(found, texts).max(axis=0)  # the bound of what would come next
        out = [[] for _ in range(texts)]
        for p in found:
            tokens = lattices.token[p.edges]
            any_bytes = len(tokens) > 0 and tokens.min() < 0
            inclusions = np.minimum(p.log_p - thresholds[p.texts], 700.0)
            near = inclusions >= -30
            inclusions[near] = np.log(-np.expm1(-np.exp(inclusions[near])))
            for text, a, b, *values in zip(p.texts.tolist(), p.starts.tolist(), p.ends.tolist(), p.log_p.tolist(), p.bounds.tolist(), inclusions.tolist(), strict=True):
                ids = tokens[a:b]
                if any_bytes and b > a and ids.min() < 0:
                    ids = np.array([b for i in ids.tolist() for b in (lattices.long_tokens[-i - 1] if i < 0 else (i,))], np.int32)
                out[text].append((ids, *values))
        return out


def _path(model: str) -> str:
    return model if "/" in model else public_tokenizers.path(model)


def sampled_segmentations(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """Distinct segmentations of every whole text, best perturbed score first (``sample`` from 1).

    Columns: ``doc_id, sample, ids, n_pieces, ids_hash, log_p, perturbed, log_inclusion, decoded_equal``.  A text with
    fewer segmentations gives fewer rows; an empty or null text has one, without pieces.  Repeated rows
    are repeated in the result with the same segmentations; a null ``doc_id`` is the row key 0.
    ``decoded_equal``: decoding the ids gives the text back (a text that holds U+2581 decodes with spaces
    there, as in the library).
    """
    fields = [("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("ids_hash", pa.string()),
              ("log_p", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("decoded_equal", pa.bool_())]
    schema = pa.schema(fields)

    pieces = Pieces(_path(model))  # read once; travels with the job

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(pieces, samples, seed)
        for batch in batches:
            group, size = [], 0
            for doc_id, text in rows_in(batch):
                group.append((doc_id, text or ""))
                size += len(text or "")
                if size > CHARS_AT_ONCE:
                    yield rows_of(sampler, group)
                    group, size = [], 0
            if group:
                yield rows_of(sampler, group)
        del sampler
        pa.default_memory_pool().release_unused()

    def rows_of(sampler: Sampler, group: list[tuple]) -> pa.RecordBatch:
        sampled = sampler.sample_group([text for _, text in group], [doc_id or 0 for doc_id, _ in group])
        rows = [(doc_id, n + 1, text, *sample) for (doc_id, text), found in zip(group, sampled, strict=True) for n, sample in enumerate(found)]
        doc_ids, numbers, texts, ids, log_p, perturbed, inclusion = zip(*rows, strict=True)
        sizes, flat = [len(x) for x in ids], np.concatenate(ids)
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(flat, pa.int32()))
        hashes = [xxh64_hexdigest(x.tobytes()) for x in ids]
        equal = sampler.pieces.decode_to(flat, sizes, texts)
        columns = [doc_ids, numbers, listed, sizes, hashes, log_p, perturbed, inclusion, equal]
        return pa.RecordBatch.from_arrays([c if c is listed else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "doc_id bigint, sample int, ids array<int>, n_pieces bigint, ids_hash string, log_p double, perturbed double, log_inclusion double, decoded_equal boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def decoded_texts(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, sample, text`` of encoded rows (null ids: null)."""
    schema = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("text", pa.string())])
    pieces = Pieces(_path(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id bigint, sample int, text string")
