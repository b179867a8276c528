"""A linear-chain conditional random field over word shapes, in numpy.

A word is known by its shape (runs of capitals, small letters and digits, and its signs) and,
if it is one of the words around tagged words in training, by itself. A tag's score at a place
is a sum over the word there, the two before and the one after; transitions join neighbours.
Lines are parted by a token of their own, so one chain may run over many texts.
"""

import re
from dataclasses import dataclass, field

import numpy as np

#: The token of a line break; classes of bytes: capitals, small letters, digits, others as is.
BREAK = b"\x01"
CLASSES = bytearray(range(256))
CLASSES[1] = ord("?")
CLASSES[10] = 1
CLASSES[48:58] = b"0" * 10
CLASSES[65:91] = b"X" * 26
CLASSES[97:123] = b"x" * 26
CLASSES[128:] = b"x" * 128
CLASSES = bytes(CLASSES)
SPACE = np.zeros(256, bool)
SPACE[[9, 11, 12, 13, 32]] = True
#: Places that a word speaks for: its own, the next, the one after, the one before.
REACH = (0, 1, 2, -1)
RUNS = re.compile(rb"([Xx0])\1*")
#: Signs that may cling to a word of any tag.
CLING = b".,;:!?\"'*#%&$|"
#: Shapes that are remembered in a worker.
MEMORY = 200_000


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Starts and ends of all words and line breaks, their lower-cased bytes and shapes."""
    codes = np.frombuffer(data, np.uint8)
    space, line = SPACE[codes], codes == 10
    edge = np.r_[True, space[:-1] | line[:-1]]
    starts = np.flatnonzero(~space & (edge | line))
    edge = np.r_[space[1:] | line[1:], True]
    ends = np.flatnonzero(~space & (edge | line)) + 1
    words = data.lower().replace(b"\n", b" \x01 ").split()
    shapes = data.translate(CLASSES).replace(b"\x01", b" \x01 ").split()
    return starts, ends, words, shapes


def shape_features(shape: bytes) -> list[bytes]:
    """The shape with short runs, the shape of its core without lengths, its count of digits."""
    if shape == BREAK:
        return [b"break"]
    core = shape.strip(CLING) or shape
    short = RUNS.sub(lambda m: m[0][:4], core)
    flat = RUNS.sub(lambda m: m[1], core)
    digits = core.count(b"0")
    out = [b"s" + short, b"f" + flat, b"t" + shape[-1:] if shape[-1] in CLING else b"t"]
    if digits:
        out.append(b"d%d" % min(digits, 20))
    if core.count(b"x") == len(core):
        out.append(b"low")
    return out


@dataclass
class Field:
    """Weights of shape features and known words at each reach, and of transitions."""

    tags: list[str]
    features: dict[bytes, int]
    words: dict[bytes, int]
    weights: np.ndarray  # feature or word, reach, tag; the first is for unknown ones
    moves: np.ndarray  # tag before, tag
    lean: float = 0.0  # added to the score of tag 0
    memory: dict = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "memory": {}, "table": None}

    def _known(self, shapes: list[bytes]) -> np.ndarray:
        """The row of `table` of each shape; new shapes are added."""
        if len(self.memory) > MEMORY:
            self.memory, self.table = {}, None
        new = set(shapes) - self.memory.keys()
        if new:
            rows = [
                self.weights[[self.features.get(f, 0) for f in shape_features(s)]].sum(0)
                for s in new
            ]
            self.memory.update(zip(new, range(len(self.memory), len(self.memory) + len(new))))
            old = [self.table] if self.table is not None else []
            self.table = np.concatenate([*old, np.array(rows)])
        return np.fromiter(map(self.memory.__getitem__, shapes), np.int64, len(shapes))

    def scores(self, words: list[bytes], shapes: list[bytes]) -> np.ndarray:
        """Score of each tag at each token, transitions apart."""
        n = len(shapes)
        row = self._known(shapes)
        get = self.words.get
        word = np.fromiter((get(w, 0) for w in words), np.int64, n)
        out = np.zeros((n, len(self.tags)))
        out[:, 0] = self.lean
        named = np.flatnonzero(word)
        for k, reach in enumerate(REACH):
            said = self.table[:, k][row]
            said[named] += self.weights[word[named], k]
            if reach > 0:
                out[reach:] += said[: n - reach]
            elif reach < 0:
                out[:reach] += said[-reach:]
            else:
                out += said
        return out

    def best(self, scores: np.ndarray) -> np.ndarray:
        """Tags of the best path (Viterbi); before and after the chain is tag 0.

        Where tag 0 leads any other by more than transitions on both sides could make good, it
        is on the best path; the runs between such places are decoded side by side.
        """
        n, moves = len(scores), self.moves
        out = np.zeros(n, np.int64)
        gain = (moves - moves[:, :1]).max(0) + (moves - moves[:1]).max(1)
        open_ = ((scores[:, :1] - scores)[:, 1:] <= gain[1:]).any(1)
        edges = np.diff(np.r_[0, open_.astype(np.int8), 0])
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        order = np.argsort(starts - ends, kind="stable")
        starts, sizes = starts[order], (ends - starts)[order]
        if not len(starts):
            return out
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        now = scores[starts] + moves[0]
        back = []
        for t in range(1, sizes[0]):
            m = live[t]
            ways = now[:m, :, None] + moves
            back.append(ways.argmax(1))
            now[:m] = ways.max(1) + scores[starts[:m] + t]
        tag = (now + moves[:, 0]).argmax(1)
        for t in range(sizes[0] - 1, -1, -1):
            m = live[t]
            out[starts[:m] + t] = tag[:m]
            if t:
                tag[:m] = back[t - 1][np.arange(m), tag[:m]]
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, str]]:
        """(start, end, tag) of runs of one tag, in bytes, without signs that cling to them."""
        starts, ends, words, shapes = tokens(data)
        if not len(starts):
            return []
        tag = self.best(self.scores(words, shapes))
        edge = np.flatnonzero(np.diff(np.r_[-1, tag, -1]))
        out = []
        for a, b in zip(edge[:-1], edge[1:]):
            if tag[a]:
                s, e = int(starts[a]), int(ends[b - 1])
                part = data[s:e]
                s += len(part) - len(part.lstrip(CLING))
                e -= len(part) - len(part.rstrip(CLING))
                if s < e:
                    out.append((s, e, self.tags[tag[a]]))
        return out


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis, keepdims=True)
    return (np.log(np.exp(values - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def fit(
    samples: list[list[tuple[str, str]]],
    tags: list[str],
    penalty: float = 0.3,
    rounds: int = 100,
    lean: float = 1.0,
) -> Field:
    """Greatest penalised likelihood of sentences of (word, tag), by full gradients (Adam).

    Words that carry tag 0 in two sentences at least are known by themselves. Sentences stand
    between line breaks. `lean` is what a tag other than 0 must gain over its likelihood, in nats
    a word. No samples give a field that tags nothing.
    """
    chains = []
    for sentence in samples:
        words = [BREAK, *(w.lower().encode() for w, _ in sentence), BREAK]
        shapes = [BREAK, *(w.encode().translate(CLASSES) for w, _ in sentence), BREAK]
        chains.append((words, shapes, [0, *(tags.index(t) for _, t in sentence), 0]))
    seen: dict[bytes, int] = {}
    for words, _, gold in chains:
        for w in {w for w, t in zip(words, gold) if t == 0 and w != BREAK}:
            seen[w] = seen.get(w, 0) + 1
    features = {}
    for _, shapes, _ in chains:
        for s in shapes:
            for f in shape_features(s):
                features.setdefault(f, len(features) + 1)
    known = [w for w, n in seen.items() if n > 1]
    words_at = {w: len(features) + 1 + k for k, w in enumerate(known)}
    size, most = len(features) + len(words_at) + 1, len(tags)
    model = Field(tags, features, words_at, np.zeros((size, len(REACH), most)), np.zeros((most, most)))
    if not chains:
        return model
    long = max(len(c[0]) for c in chains)
    gold = np.zeros((len(chains), long), np.int64)
    real = np.zeros((len(chains), long), bool)
    chain, place, feature = [], [], []
    for c, (words, shapes, tagged) in enumerate(chains):
        gold[c, : len(tagged)], real[c, : len(tagged)] = tagged, True
        for t, (w, s) in enumerate(zip(words, shapes)):
            own = [features[f] for f in shape_features(s)]
            own += [words_at[w]] if w in words_at else []
            chain += [c] * len(own)
            place += [t] * len(own)
            feature += own
    chain, place, feature = map(np.array, (chain, place, feature))
    at, slot = [], []
    for k, reach in enumerate(REACH):
        to = place + reach
        ok = (to >= 0) & (to < real.sum(1)[chain])
        at.append(chain[ok] * long + to[ok])
        slot.append(feature[ok] * len(REACH) + k)
    at, slot = np.concatenate(at), np.concatenate(slot)
    one = np.eye(most)[gold] * real[:, :, None]
    pair_gold = np.einsum("ctA,ctB->AB", one[:, :-1], one[:, 1:])

    def gradient(weights, moves):
        flat = weights.reshape(-1, most)
        score = np.stack(
            [np.bincount(at, flat[slot, y], real.size) for y in range(most)], 1
        ).reshape(*real.shape, most)
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, long):
            step = log_sum(ahead[:, t - 1, :, None] + moves, 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(long - 2, -1, -1):
            step = log_sum(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = log_sum(ahead[:, -1], 1)
        chance = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        pair = np.zeros((most, most))
        for t in range(1, long):
            both = ahead[:, t - 1, :, None] + moves + (score[:, t] + behind[:, t])[:, None, :]
            pair += (np.exp(both - total[:, None, None]) * real[:, t, None, None]).sum(0)
        miss = (one - chance).reshape(-1, most)
        out = np.stack(
            [np.bincount(slot, miss[at, y], size * len(REACH)) for y in range(most)], 1
        )
        return out.reshape(weights.shape), pair_gold - pair

    state = [model.weights, model.moves]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for r in range(1, rounds + 1):
        for k, g in enumerate(gradient(*state)):
            g = g - penalty * state[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            state[k] += 0.1 * (first[k] / (1 - 0.9**r)) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-8)
    model.weights[0] = 0
    model.lean = lean
    return model
