"""Simple-8b words: selectors pack varying counts of integers into 64 bits.

The top four bits of a word select how many values it holds and how wide they are, value j
lies at bit j times the width. Selector 0 is an escape: the next word is one value of more
than 60 bits as it is; such a word never begins with 0, so escapes can be told apart without
reading from the front. Values are packed in blocks of BLOCK; a block begins with a new word
and its place is kept, so all blocks are packed and unpacked side by side in numpy.
"""

import numpy as np

#: Values per block.
BLOCK = 1024
#: Values whose selectors are found at once.
STRETCH = 32 * BLOCK
#: Fixed values of the format: count and width of selectors 2 to 15; 0 is the escape.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


#: Bits of values below 2 ** 16.
SHORT = np.repeat(np.arange(17, dtype=np.uint8), [1, *(1 << k for k in range(16))])


def widths_of(values: np.ndarray) -> np.ndarray:
    """Bits needed by each value."""
    if not len(values) or values.max() < len(SHORT):
        return SHORT[values]
    wide = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        wide[big] += step
        rest[big] >>= np.uint64(step)
    return wide + (rest > 0)


def choices(values: np.ndarray) -> np.ndarray:
    """The selector of a word that begins at each value.

    A selector fits if the widest of its next values does. Widest values of 1, 2, 4, ... in a
    row come from those of half as many; behind the end of a block there are zeros.
    """
    count, blocks = len(values), -(-len(values) // BLOCK)
    wide = np.zeros((blocks, BLOCK + 64), np.uint8)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:count] = widths_of(values)
    wide[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    widest, n = {1: wide}, 1
    while n < 32:
        last = widest[n]
        widest[2 * n] = np.maximum(last[:, : last.shape[1] - n], last[:, n:])
        n *= 2
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for selector in range(15, 1, -1):
        n = int(COUNTS[selector])
        half = 1 << (n.bit_length() - 1)
        table = widest[half]
        most = np.maximum(table[:, :BLOCK], table[:, n - half : n - half + BLOCK])
        choice[most <= WIDTHS[selector]] = selector
    return choice.ravel()[:count]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, place of the first word of each block int32) of unsigned values."""
    values = values.astype(np.uint64, copy=False)
    count = len(values)
    if not count:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    end = np.minimum((np.arange(count) // BLOCK + 1) * BLOCK, count)
    choice = np.concatenate(
        [choices(values[k : k + STRETCH]) for k in range(0, count, STRETCH)]
    )
    step = COUNTS[choice]
    at = np.arange(0, count, BLOCK)
    until = end[at]
    starts = []
    while len(at):
        starts.append(at)
        at = at + step[at]
        live = at < until
        at, until = at[live], until[live]
    first = np.sort(np.concatenate(starts))
    used = choice[first]
    sizes = 1 + (used == 0)
    slot = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.uint64)
    for selector in np.unique(used):
        mine = used == selector
        begin = first[mine]
        if not selector:
            words[slot[mine] + 1] = values[begin]
            continue
        word = np.full(len(begin), int(selector) << 60, np.uint64)
        for j in range(COUNTS[selector]):
            k = begin + j
            inside = k < end[begin]
            part = values[np.minimum(k, count - 1)] * inside.astype(np.uint64)
            word |= part << np.uint64(j * int(WIDTHS[selector]))
        words[slot[mine]] = word
    heads = slot[np.searchsorted(first, np.arange(0, count, BLOCK))]
    return words, heads.astype(np.int32)


def unpack(words: np.ndarray, heads: np.ndarray, count: int) -> np.ndarray:
    """The `count` values of `pack`, all words of a selector at a time."""
    out = np.zeros(count, np.uint64)
    if not count:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    each = COUNTS[selector]
    escape = selector == 0
    each[np.flatnonzero(escape) + 1] = 0
    block = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(words))))
    before = np.cumsum(each) - each
    place = block * BLOCK + before - before[heads][block]
    end = np.minimum((block + 1) * BLOCK, count)
    raw = np.zeros(len(words), bool)
    raw[np.flatnonzero(escape) + 1] = True
    out[place[escape]] = words[np.flatnonzero(escape) + 1]
    for s in range(2, 16):
        mine = np.flatnonzero((selector == s) & ~raw)
        if not len(mine):
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s]):
            k = place[mine] + j
            inside = k < end[mine]
            out[k[inside]] = (words[mine[inside]] >> np.uint64(j * int(WIDTHS[s]))) & mask
    return out
