"""Byte-level BPE: boundaries by scans over code points, then cached merging of pairs.

The pattern of the vocabulary is a small automaton. Every code point gets a class from an
array, a class is a function from state to state, and functions are composed by a blocked scan:
blocks of a text are composed side by side for every state they may begin in, then each block
takes the state its predecessors lead to. No regular expression reads a text. A slice between
boundaries is merged once per worker and remembered.
"""

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import pieces, raw, texts

#: Classes: letter, number, other, apostrophe of a contraction of 2 or 3 characters, the last
#: white space before something else (a space, or another one), other white space, end of text.
L, N, O, A2, A3, LS, LW, WS, END = range(9)
#: States: nothing pending, in letters, numbers, others, after a space, in white space, with
#: one or two characters of a contraction to come.
DONE, LETTERS, NUMBERS, OTHERS, SPACE, BLANKS, ONE, TWO = range(8)
STATES = 8
#: Code points of a block of the scan.
WIDE = 32
#: Slices a worker remembers; beyond it starts anew, which changes speed only.
REMEMBER = 800_000


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a slice begins, for each class and state."""
    go = np.zeros((9, STATES), np.uint8)
    new = np.ones((9, STATES), bool)
    for symbol, run in ((L, LETTERS), (N, NUMBERS), (O, OTHERS)):
        go[symbol] = run
        new[symbol, [run, SPACE]] = False
    go[A2], go[A3] = ONE, TWO
    for symbol in (A2, A3):
        go[symbol, [OTHERS, SPACE]] = OTHERS
        new[symbol, [OTHERS, SPACE]] = False
    go[LS], go[LW], go[WS] = SPACE, DONE, BLANKS
    new[WS, BLANKS] = False
    go[:, ONE], new[:, ONE] = DONE, False
    go[:, TWO], new[:, TWO] = ONE, False
    go[END] = DONE
    return go, new


GO, NEW = _rules()
#: Code points that the pattern counts as white space.
BLANK_POINTS = [*range(9, 14), 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029]
BLANK_POINTS += [0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    kinds = {"L": L, "N": N}
    of = np.full(0x110000, O, np.uint8)
    for point in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            of[point] = kind
    of[BLANK_POINTS] = WS
    return of


_CLASS_OF: list[np.ndarray] = []


def class_of() -> np.ndarray:
    """Letter, number, white space or other of every code point, made once per process."""
    if not _CLASS_OF:
        _CLASS_OF.append(_classes())
    return _CLASS_OF[0]


def symbols(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Classes of code points; `last` marks the end of each text, which has a point of its own."""
    kind = class_of()[np.where(last, 32, points)]
    kind[last] = END
    after = np.append(kind[1:], END).astype(np.uint8)
    edge = (kind == WS) & (after != WS) & (after != END)
    quote = np.flatnonzero(points == ord("'"))
    kind[edge] = np.where(points[edge] == 32, LS, LW)
    if len(quote):
        padded = np.concatenate([np.where(last, 0, points), np.zeros(2, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        two = np.where(one == 0, 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        kind[quote[short]] = A2
        kind[quote[long]] = A3
    return kind


def states_before(kind: np.ndarray) -> np.ndarray:
    """The state before each symbol, by composing functions from state to state.

    Blocks of WIDE symbols are composed side by side, their functions are scanned by the same
    rule one level up, and then each block is run from its first state.
    """
    return _scan(GO, kind, DONE)


def _scan(functions: np.ndarray, which: np.ndarray, first: int) -> np.ndarray:
    count = len(which)
    if count <= WIDE:
        out, state = np.zeros(count, np.uint8), first
        for k in range(count):
            out[k] = state
            state = functions[which[k], state]
        return out
    rows = -(-count // WIDE)
    grid = np.full(rows * WIDE, END if functions is GO else 0, which.dtype)
    grid[:count] = which
    steps = np.ascontiguousarray(grid.reshape(rows, WIDE).T)
    flat = functions.ravel()
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for symbol in steps:
        whole = flat[symbol.astype(np.intp)[:, None] * STATES + whole]
    state = _scan(whole, np.arange(rows), first)
    out = np.empty((WIDE, rows), np.uint8)
    for k, symbol in enumerate(steps):
        out[k] = state
        state = flat[symbol.astype(np.intp) * STATES + state]
    return out.T.reshape(-1)[:count]


def boundaries(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets where slices begin in the joined texts, slices per text)."""
    joined = b"\0".join(docs) + b"\0"
    data = np.frombuffer(joined, np.uint8)
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))) - 1
    last = np.zeros(len(data), bool)
    last[ends] = True
    last = last[at]
    kind = symbols(points, last)
    begins = NEW[kind, states_before(kind)] & ~last
    text_of = np.cumsum(last) - last
    return at[begins], np.bincount(text_of[begins], minlength=len(docs))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the pair of lowest rank, first from the left, is merged again and again."""
    if part in ranks:
        return [ranks[part]]
    units = [part[k : k + 1] for k in range(len(part))]
    pairs = [ranks.get(units[k] + units[k + 1], 1 << 60) for k in range(len(units) - 1)]
    while pairs:
        best = min(pairs)
        if best == 1 << 60:
            break
        k = pairs.index(best)
        units[k : k + 2] = [units[k] + units[k + 1]]
        del pairs[k]
        if k:
            pairs[k - 1] = ranks.get(units[k - 1] + units[k], 1 << 60)
        if k < len(pairs):
            pairs[k] = ranks.get(units[k] + units[k + 1], 1 << 60)
    return [ranks[u] for u in units]


def merge_long(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """`merge` with a heap, for slices of any length."""
    count = len(part)
    ends, left = list(range(1, count + 1)), list(range(-1, count - 1))
    heap = [
        (ranks[part[k : k + 2]], k, k + 2) for k in range(count - 1) if part[k : k + 2] in ranks
    ]
    heapq.heapify(heap)
    alive = [True] * count

    def offer(k):
        if k >= 0 and ends[k] < count:
            end = ends[ends[k]]
            rank = ranks.get(part[k:end])
            if rank is not None:
                heapq.heappush(heap, (rank, k, end))

    while heap:
        _, k, end = heapq.heappop(heap)
        if not alive[k] or ends[k] >= count or ends[ends[k]] != end or end <= ends[k]:
            continue
        alive[ends[k]] = False
        ends[k] = end
        if end < count:
            left[end] = k
        offer(left[k])
        offer(k)
    out, k = [], 0
    while k < count:
        out.append(ranks[part[k : ends[k]]])
        k = ends[k]
    return out


class Slices(dict):
    """Ids of slices as little-endian 32-bit numbers, merged when first asked for."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        size = max(self.ranks.values()) + 1
        spelled = [b""] * size
        for part, rank in self.ranks.items():
            spelled[rank] = part
        self.spelled = spelled

    def __missing__(self, part: bytes) -> bytes:
        rule = merge if len(part) <= 200 else merge_long
        ids = np.array(rule(part, self.ranks), "<u4").tobytes()
        if len(self) >= REMEMBER:
            self.clear()
        self[part] = ids
        return ids

    def encode(self, docs: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes."""
        at, counts = boundaries(docs)
        joined = b"\0".join(docs) + b"\0"
        closes = np.cumsum(np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))) - 1
        ends = np.append(at[1:], closes[-1])
        last = np.cumsum(counts)[counts > 0] - 1
        ends[last] = closes[counts > 0]
        parts = [joined[a:b] for a, b in zip(at.tolist(), ends.tolist())]
        ids = list(map(self.__getitem__, parts))
        cuts = [0, *np.cumsum(counts).tolist()]
        return [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_SLICES: dict[str, Slices] = {}


def slices(path: str) -> Slices:
    if path not in _SLICES:
        _SLICES[path] = Slices(path)
    return _SLICES[path]


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, text].

    `text` is what the ids decode to. Null texts count as empty; an empty text has no ids.
    """

    def work(batches):
        coder = slices(path)
        for batch in pieces(batches):
            found = coder.encode(raw(batch.column("text")))
            plain = [coder.decode(ids) for ids in found]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(ids) // 4 for ids in found], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids in found]),
                "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in plain]),
            }
            if with_ids:
                lists = [np.frombuffer(ids, "<i4") for ids in found]
                columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
                columns["text"] = pa.array([t.decode(errors="replace") for t in plain])
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(docs).mapInArrow(work, schema + ", ids array<int>, text string" * with_ids)
