"""Distinct sampled segmentations of a text under a SentencePiece vocabulary.

The pieces that match a text form a lattice; every path is a segmentation with the sum of its
pieces' scores. Adding independent Gumbel noise to all paths and taking the k best is sampling k
segmentations without replacement. The noise is drawn top-down, best first: a set of paths has
the maximum of its noisy scores distributed as a Gumbel at its log-sum-exp, so the best path of
all is drawn first, what remains is split into sets that leave it at each of its steps, and the
set of the highest maximum is always opened next. Exact backward sums are the heuristic, so no
set is opened in vain. The noise of the first path not taken is the threshold from which each
taken path's inclusion probability follows.

All texts of a block are worked on together: the lattices of its distinct words are one table of
nodes, and a step of every walk under way is drawn at once.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from settlematch.llm.common import byte_blocks, record_batch

SPACE = "▁"
#: Code of a literal U+2581 of the text, which has no piece and is spelled in bytes; beyond all characters.
LITERAL = 0x110000
#: Bytes of text worked on together; their words' lattices take some sixty times as much.
BLOCK = 1 << 21
#: Nodes so near to their word's end are summed without logarithms; pieces so short are looked at first.
SHORT, NEAR = 100, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def uniform(seeds: np.ndarray, stream: int, places: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed, stream and place alone, whatever else is drawn."""
    z = seeds + _ODD * (places.astype(np.uint64) + np.uint64(stream << 40))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


class Table:
    """Whole numbers (not negative) by keys of 64 bits, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = self._place(keys[left], step)
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            left, step = np.delete(left, won), step + 1

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        return (((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            wanted = keys.take(left)
            at = self._place(wanted, step)
            found = self.keys.take(at)
            hit = found == wanted
            out[left[hit]] = self.values.take(at[hit])
            left, step = left[~hit & (found >= 0)], step + 1
        return out


class Vocabulary:
    """Pieces of a SentencePiece model file with unigram scores, as a trie.

    The files hold merge ranks, not probabilities: a piece of rank r gets the Zipf-law score
    -log(r + 10), times ``sharpness``. Characters without a piece are spelled in byte pieces.
    """

    def __init__(self, model: str, sharpness: float = 0.5):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=model)
        self.sharpness, self.bytes, self.ids, self.raw = sharpness, [0] * 256, {}, []
        for i in range(reader.get_piece_size()):
            piece = reader.id_to_piece(i)
            self.raw.append(piece.replace(SPACE, " ").encode())
            if reader.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[-1] = bytes([int(piece[3:5], 16)])
            elif not (reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i)):
                self.ids[piece] = i
        self.longest = max(map(len, self.ids))
        self.raw = np.array(self.raw, dtype=object)
        self.scores = np.array([self.score(i) for i in range(len(self.raw))])
        steps, ends = {}, {}
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                state = steps.setdefault(state << 21 | ord(c), len(steps) + 1)
            ends[state] = i
        self.steps = Table(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32))
        #: State after a first character, and whether a state goes on.
        self.begin, self.goes_on = np.full(LITERAL + 1, -1, np.int32), np.zeros(len(steps) + 1, bool)
        for key, state in steps.items():
            self.goes_on[key >> 21] = True
            if key < 1 << 21:
                self.begin[key] = state
        self.piece_at = np.full(len(steps) + 1, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())

    def score(self, piece_id: int) -> float:
        return -self.sharpness * math.log(piece_id + 10)

    def spelled(self, code: int) -> list[int]:
        return [self.bytes[b] for b in (SPACE if code == LITERAL else chr(code)).encode("utf-8", "surrogatepass")]


class Lattice:
    """The lattices of a block's distinct words: a node for each place of a word and one behind it.

    No piece goes from a letter over a space, so a text is a chain of words that do not depend on
    each other. ``rest`` is the log-sum over the ways from a node to its word's end; ``unit`` names the
    pieces from it by length, and ``odds`` has their running probabilities.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        inside = np.fromiter(map(len, words), np.int64, len(words))
        self.size = inside + 1
        self.first = np.cumsum(self.size + 1) - self.size - 1
        n = int((self.size + 1).sum())
        code, inner, letter = np.full(n, ord(SPACE), np.int64), np.ones(n, bool), np.ones(n, bool)
        inner[self.first + self.size] = False
        letter[self.first + self.size] = letter[self.first] = False
        own = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own[own == ord(SPACE)] = LITERAL
        own[own == 32] = ord(SPACE)  # spaces before a word belong to it
        code[letter] = own
        left = np.repeat(self.first + self.size, self.size + 1) - np.arange(n)
        self._pieces(vocabulary, code, inner, left)
        self._sums(left)

    def _pieces(self, v: Vocabulary, code: np.ndarray, inner: np.ndarray, left: np.ndarray) -> None:
        """``unit``: what each length from each node is, -1 where it is nothing."""
        n, pieces = len(code), len(v.raw)
        at, state, found = np.flatnonzero(inner), np.zeros(int(inner.sum()), np.int64), []
        for length in range(1, v.longest + 1):
            fits = left.take(at) >= length
            at, state = at[fits], state[fits]
            letters = code.take(at + length - 1)
            state = (v.begin.take(letters) if length == 1 else v.steps.get(state << 21 | letters)).astype(np.int64)
            known = np.flatnonzero(state >= 0)
            if not len(known):
                break
            at, state = at.take(known), state.take(known)
            piece = v.piece_at.take(state)
            whole = np.flatnonzero(piece >= 0)
            found.append((at.take(whole), piece.take(whole)))
            on = np.flatnonzero(v.goes_on.take(state))
            at, state = at.take(on), state.take(on)
        self.width = max(len(found), 1)
        self.unit, self.most = np.full((n, self.width), -1, np.int32), np.ones(n, np.int64)
        for k, (p, piece) in enumerate(found):
            self.unit[p, k] = piece
            self.most[p] = k + 1
        # characters without a piece: units of their own behind the pieces
        bare = np.flatnonzero(inner & (self.unit[:, 0] < 0))
        strange, which = np.unique(code[bare], return_inverse=True)
        self.unit[bare, 0] = pieces + which
        spelled = [v.spelled(int(c)) for c in strange]
        self.scores = np.concatenate([v.scores, [sum(map(v.score, s)) for s in spelled], [-np.inf]])  # -1 takes the last
        self.ids = np.concatenate([np.arange(pieces), np.array([i for s in spelled for i in s], np.int64)])
        self.n_ids = np.concatenate([np.ones(pieces, np.int64), np.array([len(s) for s in spelled], np.int64)])
        self.first_id = np.cumsum(self.n_ids) - self.n_ids

    def _sums(self, left: np.ndarray) -> None:
        """``rest`` and the odds, from the words' ends backwards; as plain sums near the end, as log-sums beyond SHORT places.

        Nodes alike in distance and in whether all their pieces are short go together; odds are
        kept in that order (``rank``): ``near`` those of the first NEAR lengths, ``odds`` all those of
        the nodes with longer pieces (``far_rank``).
        """
        n, width = self.unit.shape
        self.rest, plain, weights = np.zeros(n + width), np.ones(n + width), np.exp(self.scores)
        most = self.most  # length of the longest piece
        kind = left * 2 + (most > NEAR)
        order = np.flatnonzero(left > 0)
        order = order[np.argsort(kind.take(order), kind="stable")]
        self.rank = np.zeros(n, np.int64)
        self.rank[order] = np.arange(len(order))
        unit, kind, far, most = self.unit.take(order, axis=0), kind.take(order), left.take(order), most.take(order)
        self.far_rank = np.cumsum(kind & 1) - 1
        self.near, self.odds = np.ones((len(order), NEAR), np.float32), np.ones((int((kind & 1).sum()), width), np.float32)
        cuts = np.flatnonzero(np.diff(kind)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
            if lo == hi:
                continue
            nodes, w = order[lo:hi], min(width, int(far[lo]), width if kind[lo] & 1 else NEAR)
            columns = [(unit[lo:hi, k], nodes + (k + 1)) for k in range(w)]
            if far[lo] <= SHORT:
                parts = [weights.take(u) * plain.take(to) for u, to in columns]
                top = 0.0
            else:
                values = [self.scores.take(u) + self.rest.take(to) for u, to in columns]
                top = functools.reduce(np.maximum, values)
                parts = [np.exp(v - top) for v in values]
            running, row = list(itertools.accumulate(parts)), int(self.far_rank[lo])
            self.rest[nodes] = top + np.log(running[-1])
            if far[lo] <= SHORT:
                plain[nodes] = running[-1]
            for k, r in enumerate(running):
                share = r / running[-1]
                if k < NEAR:
                    self.near[lo:hi, k] = share
                if kind[lo] & 1:
                    self.odds[row : row + hi - lo, k] = share
        # rounding never leaves a draw without a piece
        self.odds[np.arange(len(self.odds)), most[kind & 1 == 1] - 1] = np.inf
        short = np.flatnonzero(most <= NEAR)
        self.near[short, most[short] - 1] = np.inf

    def score(self, nodes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.scores.take(self.unit.ravel().take(nodes * self.width + lengths - 1))

    def chance(self, nodes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of the piece of that length at each node."""
        return np.exp(self.score(nodes, lengths) + self.rest.take(nodes + lengths) - self.rest.take(nodes))

    def spelled(self, paths: list[_Path]) -> list[np.ndarray]:
        """Ids of each path."""
        node, length = (np.concatenate([getattr(p, c) for p in paths]) for c in ("node", "length"))
        units = self.unit.ravel().take(node * self.width + length - 1)
        n = self.n_ids.take(units)
        ends = np.cumsum(n)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        ids = self.ids.take(np.repeat(self.first_id.take(units), n) + inside).astype(np.int32)
        return np.split(ids, ends[np.cumsum([len(p.node) for p in paths])[:-1] - 1])


class Block:
    """Texts side by side: which words they consist of, and the walks drawn for them."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str]):
        self.v = vocabulary
        self.words, count, distinct = _numbered(texts)
        self.lattice = x = Lattice(vocabulary, distinct) if distinct else None
        self.text_of = np.repeat(np.arange(len(texts)), count)
        self.first_word = np.concatenate([[0], np.cumsum(count)])
        if not x:
            self.total = np.zeros(len(texts))
            return
        sums = x.rest[x.first[self.words]]
        running = np.concatenate([[0.0], np.cumsum(sums)])
        self.total = running[self.first_word[1:]] - running[self.first_word[:-1]]
        #: Log-sum of the words behind each word of its text, and its place in the text.
        self.after = running[self.first_word[1:]][self.text_of] - running[1:]
        places = np.concatenate([[0], np.cumsum(x.size[self.words])])
        self.place = places[:-1] - places[self.first_word[:-1]][self.text_of]

    def walk(self, words: np.ndarray, nodes: np.ndarray, seeds: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps (word place, node, length) drawn from each node to the end of its word, in order of ``words``."""
        x = self.lattice
        begin = x.first[self.words[words]]
        behind = begin + x.size[self.words[words]]
        seed, offset = seeds[self.text_of[words]], self.place[words] - begin
        live, at, rounds = np.arange(len(words)), nodes, []
        live = live[at < behind]
        at = at[at < behind]
        while len(live):
            u = uniform(seed.take(live), stream, offset.take(live) + at).astype(np.float32)
            row = x.rank.take(at)
            near = x.near.take(row, axis=0)  # most pieces are short
            length = np.ones(len(at), np.int64)
            for k in range(NEAR):
                length += near[:, k] <= u
            if len(rare := np.flatnonzero(length > NEAR)):
                length[rare] = (x.odds.take(x.far_rank.take(row[rare]), axis=0) <= u[rare, None]).sum(axis=1) + 1
            rounds.append((live, at, length))
            at = at + length
            more = at < behind.take(live)
            live, at = live[more], at[more]
        steps = np.zeros(len(words), np.int64)
        for who, _, _ in rounds:
            steps[who] += 1
        start = np.cumsum(steps) - steps
        out = [np.zeros(int(steps.sum()), np.int64) for _ in range(3)]
        for r, (who, at, length) in enumerate(rounds):
            to = start[who] + r
            out[0][to], out[1][to], out[2][to] = words[who], at, length
        return tuple(out)


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Numbers of the words of all texts in order, how many each text has, and the distinct words by number."""
    spaced = np.array([bool(t) and (t[0] == " " or t[-1] == " " or "  " in t) for t in texts], bool)
    order = np.argsort(spaced, kind="stable")  # plain texts are split at every space
    plain = pc.split_pattern(pa.array([texts[i] for i in order[: len(texts) - int(spaced.sum())]], pa.large_string()), " ")
    chains = [_spaced(texts[i].split(" ")) for i in np.flatnonzero(spaced)]
    number = pa.concat_arrays([plain.flatten(), pa.array(list(itertools.chain.from_iterable(chains)), pa.large_string())]).dictionary_encode()
    found, count = number.indices.to_numpy().astype(np.int64), np.zeros(len(texts), np.int64)
    count[order] = np.concatenate([pc.list_value_length(plain).to_numpy(zero_copy_only=False), np.fromiter(map(len, chains), np.int64, len(chains))])
    empty = np.array([not t for t in texts], bool)
    if empty.any():  # splits into one empty word
        found = found[~np.repeat(empty[order], count[order])]
        count[empty] = 0
    if len(chains):
        start = np.zeros(len(texts), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        found = found[np.arange(len(found)) + np.repeat(start - (np.cumsum(count) - count), count)]
    return found, count, number.dictionary.to_numpy(zero_copy_only=False).tolist()


def _spaced(parts: list[str]) -> list[str]:
    """Words of a text with runs of spaces: all spaces before a word belong to it."""
    out, waiting = [], -1
    for part in parts:
        waiting += 1
        if part:
            out.append(" " * waiting + part)
            waiting = -1
    return [*out, " " * waiting] if waiting >= 0 else out


class _Path:
    """One drawn segmentation: its steps and the sums of scores before each."""

    __slots__ = ("before", "length", "node", "scores", "word")

    def __init__(self, word: np.ndarray, node: np.ndarray, length: np.ndarray, scores: np.ndarray):
        self.word, self.node, self.length, self.scores = word, node, length, scores
        self.before = np.concatenate([[0.0], np.cumsum(scores)])


def _noisy(place: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels at ``place`` that are known to be below ``limit``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-limit, np.log(-np.log(u)) - place)


def draw(vocabulary: Vocabulary, texts: list[str], seeds: list[int], k: int) -> list[tuple[list[tuple[float, np.ndarray]], float]]:
    """Per text: [(log-probability, ids), ...] of the k best noisy paths, and the noisy log-probability of the next."""
    block = Block(vocabulary, texts)
    out: list[tuple[list, float]] = [([(0.0, np.zeros(0, np.int32))] if not t else [], -math.inf) for t in texts]
    busy = [i for i, t in enumerate(texts) if t]
    if not busy:
        return out
    x, seed = block.lattice, np.array(seeds, np.uint64)
    value = dict(zip(busy, (block.total[busy] - np.log(-np.log(uniform(seed[busy], 0, np.zeros(len(busy), np.int64))))).tolist(), strict=True))
    every = np.arange(len(block.words))
    word, node, length = block.walk(every, x.first[block.words], seed, 2)
    bounds = np.searchsorted(block.text_of[word], np.arange(len(texts) + 1))
    paths: dict[int, list[_Path]] = {}
    scores = x.score(node, length)
    for i in busy:
        s = slice(bounds[i], bounds[i + 1])
        paths[i] = [_Path(word[s], node[s], length[s], scores[s])]
    sets: dict[int, list[tuple]] = {i: [] for i in busy}  # value, path, step, lengths left out
    fresh = [(i, 0) for i in busy]  # text, first step that may be left
    for t in range(k):
        _open(block, paths, sets, fresh, value, seed, 3 + 4 * t, k - t)  # as many as can still be opened, and the threshold
        if t + 1 == k:
            break
        fresh, turns = [], []
        for i in [i for i, _ in _pairs(sets)]:
            best = max(range(len(sets[i])), key=lambda j: sets[i][j][0])
            value[i], path, step, without = sets[i].pop(best)
            turns.append((i, path, step, without))
        _turn(block, paths, sets, turns, value, seed, 4 + 4 * t)
        fresh = [(i, step + 1) for i, _, step, _ in turns]
    ids = iter(x.spelled([p for i in busy for p in paths[i]]))
    for i in busy:
        total = float(block.total[i])
        out[i][0].extend((float(p.before[-1]) - total, next(ids)) for p in paths[i])
        if sets[i]:
            out[i] = (out[i][0], max(s[0] for s in sets[i]) - total)
    return out


def _pairs(sets: dict[int, list]) -> list[tuple[int, list]]:
    return [(i, s) for i, s in sets.items() if s]


def _open(block: Block, paths: dict, sets: dict, fresh: list, value: dict, seed: np.ndarray, stream: int, keep: int) -> None:
    """Add, for each fresh path, the best ``keep`` sets of paths that follow it and leave it at a step from the first on."""
    x, rows = block.lattice, [(i, first, paths[i][-1]) for i, first in fresh if first < len(paths[i][-1].node)]
    if not rows:
        return
    word, node, length = (np.concatenate([getattr(p, c)[f:] for _, f, p in rows]) for c in ("word", "node", "length"))
    before = np.concatenate([p.before[f:-1] for _, f, p in rows])
    count = np.array([len(p.node) - f for _, f, p in rows])
    with np.errstate(divide="ignore", invalid="ignore"):
        left = 1.0 - x.chance(node, length)
        place = before + x.rest.take(node) + np.where(left > 1e-12, np.log(np.maximum(left, 1e-300)), -np.inf) + block.after.take(word)
    u = uniform(seed.take(block.text_of.take(word)), stream, block.place.take(word) + node - x.first.take(block.words.take(word)))
    late = np.log(-np.log(u)) - place  # under one limit, the smaller, the higher the noisy score
    start = np.cumsum(count) - count
    limit = np.array([value[i] for i, _, _ in rows])
    for _ in range(keep):
        best = np.minimum.reduceat(late, start)
        at = np.flatnonzero(late == np.repeat(best, count))
        at = at[np.concatenate([[True], np.diff(np.searchsorted(start, at, side="right")) > 0])]
        noisy, there = _noisy(place[at], limit, u[at]), late[at] < math.inf
        for (i, first, _), value_of, some, step, own in zip(rows, noisy.tolist(), there.tolist(), (at - start).tolist(), length[at].tolist(), strict=True):
            if some:
                sets[i].append((value_of, len(paths[i]) - 1, first + step, (own,)))
        late[at] = np.inf


def _turn(block: Block, paths: dict, sets: dict, turns: list, value: dict, seed: np.ndarray, stream: int) -> None:
    """Draw a path of each opened set, and put back what is left of the set without it."""
    if not turns:
        return
    x, texts = block.lattice, np.array([i for i, *_ in turns])
    of = [paths[i][path] for i, path, *_ in turns]
    steps = [step for _, _, step, _ in turns]
    at, w = (np.array([getattr(p, c)[step] for p, step in zip(of, steps, strict=True)]) for c in ("node", "word"))
    lengths = np.arange(1, x.width + 1)
    weight = x.chance(at[:, None], lengths[None, :])  # 0 where there is no piece
    for row, (*_, without) in enumerate(turns):
        weight[row, np.array(without) - 1] = 0.0
    running = np.cumsum(weight, axis=1)
    total, places = running[:, -1], 2 * np.array(steps)
    above = running > (uniform(seed[texts], stream, places) * total)[:, None]
    last = x.width - 1 - np.argmax((weight > 0)[:, ::-1], axis=1)
    index = np.where(above[:, -1], np.argmax(above, axis=1), last)
    own = lengths[index]
    chosen = (np.arange(len(turns)), index)
    left = np.where((weight > 0).sum(axis=1) > 1, total - weight[chosen], 0.0)
    before = np.array([p.before[step] for p, step in zip(of, steps, strict=True)])
    place = before + x.rest.take(at) + np.log(np.maximum(left, 1e-300)) + block.after.take(w)
    noisy = _noisy(place, np.array([value[i] for i, *_ in turns]), uniform(seed[texts], stream, places + 1))
    for (i, path, step, without), length, some, value_of in zip(turns, own.tolist(), (left > 1e-12).tolist(), noisy.tolist(), strict=True):
        if some:
            sets[i].append((value_of, path, step, (*without, length)))
    # what follows the step in its word, and all later words of the text
    count = block.first_word[texts + 1] - w
    start = np.cumsum(count) - count
    words = np.arange(int(count.sum())) + np.repeat(w - start, count)
    nodes = x.first.take(block.words.take(words))
    nodes[start] = at + own
    word, node, length = block.walk(words, nodes, seed, stream + 1)
    scores, score = x.score(node, length), x.score(at, own)
    owner = block.text_of[word]
    begin, behind = np.searchsorted(owner, texts), np.searchsorted(owner, texts, side="right")
    for row, (i, p, step, lo, hi) in enumerate(zip(texts.tolist(), of, steps, begin.tolist(), behind.tolist(), strict=True)):
        columns = ((p.word, w, word), (p.node, at, node), (p.length, own, length), (p.scores, score, scores))
        paths[i].append(_Path(*(np.concatenate([a[:step], b[row : row + 1], c[lo:hi]]) for a, b, c in columns)))


def inclusion(log_probability: float, threshold: float) -> float:
    """Probability that a path's noisy score exceeds the threshold."""
    return 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(log_probability - threshold, 700.0)))


def log_inclusion(log_probability: float, threshold: float) -> float:
    """Its logarithm, which long texts need: one of their segmentations has next to no probability."""
    above = log_probability - threshold
    return above if above < -36.0 else math.log(inclusion(log_probability, threshold))  # 1 - exp(-x) is x where x is small


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """Text of a segmentation: byte pieces are joined as UTF-8, spaces restored, the leading one dropped."""
    return b"".join(vocabulary.raw.take(ids).tolist()).decode("utf-8", "replace")[1:]


_VOCABULARIES: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(model: str, sharpness: float) -> Vocabulary:
    key = (model, sharpness)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(model, sharpness)
    return _VOCABULARIES[key]


def sample_segmentations(rows: DataFrame, model: str, keys: list[str], *, k: int = 2, sharpness: float = 0.5, seed: int = 6) -> DataFrame:
    """Up to ``k`` distinct segmentations of every ``text``, seeded by the key columns (of type long).

    One row each: keys, sample (0: drawn first), ids, log_prob, inclusion, log_inclusion, and whether the ids
    decode to the text. ``log_inclusion`` is the logarithm of ``inclusion``, which is 0 for most long texts.
    Texts with fewer segmentations give all of them, with inclusion 1; null
    and empty texts give one, without pieces. Rows that share a key and a text give the same.
    Other columns are left out; one of the names above can be no key.
    """
    schema = pa.schema([*((c, pa.int64()) for c in keys), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("log_inclusion", pa.float64()), ("decodes", pa.bool_())])

    def run(batches):
        pieces = vocabulary(model, sharpness)
        for batch in byte_blocks(batches, BLOCK, rows=1 << 20):
            out = {name: [] for name in schema.names}
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            seeds = [xxhash.xxh64_intdigest(repr((seed, list(key)))) for key in own]
            for text, key, (drawn, threshold) in zip(texts, own, draw(pieces, texts, seeds, k), strict=True):
                for i, (log_probability, ids) in enumerate(drawn):
                    chance = round(log_inclusion(log_probability, threshold), 6)  # rounded, as sums of a block end in its own last digits
                    values = (*key, i, ids, round(log_probability, 6), math.exp(chance), chance, decode(pieces, ids) == text if len(ids) else not text)
                    for name, value in zip(schema.names, values, strict=True):
                        out[name].append(value)
            ends = np.cumsum([0, *map(len, out["ids"])], dtype=np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *out["ids"]])))
            yield record_batch(schema, out)

    return rows.select(*keys, "text").mapInArrow(run, ", ".join([*(f"{c} long" for c in keys), "sample int, ids array<int>, log_prob double, inclusion double, log_inclusion double, decodes boolean"]))
