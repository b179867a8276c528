"""Token ids of many texts by the tokenizers library, a chunk of text once.

A library call on whole texts does the same words again and again. Texts are cut where the
tokenizer cuts anyway, each distinct chunk is encoded by the library once per worker, and the
ids of texts are gathered from there with numpy. Results are those of whole texts.
"""

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks a worker remembers; beyond it starts anew, which changes speed only.
REMEMBER = 800_000
#: Parts of chunks that are remembered while new chunks are encoded.
REMEMBER_PARTS = 60_000

#: Bytes of characters that some tables count as white space and `bytes.split` does not.
RARE = (
    *(bytes([b]) for b in range(0x1C, 0x20)),
    *(b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80"),
)
CAREFUL = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")
#: Chunks that are seen at a glance to be a word, marks, and a line's first word and marks.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[.,;:!?|#*$%&]+"
GLANCE = re.compile(f"( ?{LETTERS})({MARKS})?(?:(\n)({LETTERS})({MARKS})?)?")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Visible Latin-1 characters stand for themselves, other bytes for those from U+0100 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


class Words:
    """For tokenizers that drop white space: words between ASCII white space, as bytes."""

    keeps_blanks = False

    @staticmethod
    def by_spaces(text: bytes) -> bool:
        """Whether the chunks are what lies between single spaces, but for the first."""
        return False

    @staticmethod
    def cut(text: bytes) -> list:
        return text.split()

    @staticmethod
    def spelled(chunk) -> str:
        return chunk.decode()

    @staticmethod
    def plain(part: str) -> str:
        return part.lower()


class Spaced:
    """For byte-level tokenizers, whose patterns never run from a character on into a blank.

    Cuts between a character that is not white space and white space after it. A chunk that
    begins with one space is its bytes after the space, any other one its text.
    """

    keeps_blanks = True

    @staticmethod
    def by_spaces(text: bytes) -> bool:
        return b"  " not in text and not any(rare in text for rare in RARE)

    @staticmethod
    def cut(text: bytes) -> list:
        if not Spaced.by_spaces(text):
            return [part for part in CAREFUL.split(text.decode()) if part]
        chunks = text.split(b" ")
        first = chunks[0].decode()
        if first:
            chunks[0] = first
            return chunks
        return chunks[1:]

    @staticmethod
    def spelled(chunk) -> str:
        return chunk if isinstance(chunk, str) else " " + chunk.decode()

    @staticmethod
    def plain(part: str) -> str:
        return part


def special_rule(library) -> re.Pattern | None:
    """Finds the strings that the library takes for one token wherever they stand.

    Those that it looks for in normalised text are found in either case.
    """
    known = sorted(library.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))
    parts = [
        (b"(?i:%s)" if t.normalized else b"(?:%s)") % re.escape(t.content.encode()) for t in known
    ]
    return re.compile(b"|".join(parts)) if parts else None


class ChunkEncoder:
    """Ids of chunks, as encoded by the library; the first of all is the end id alone."""

    def __init__(self, path: str, end_id: int, rule):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.rule, self.end = rule, np.array([end_id], np.uint32)
        self.tokenize = self.library.model.tokenize
        self.special = special_rule(self.library)
        self.clear()

    def clear(self):
        self.places: dict = {}
        self.parts: dict[str, list[int]] = {}
        self.ids = self.end.copy()
        self.starts = np.zeros(1, np.int64)
        self.sizes = np.ones(1, np.int64)

    def simple(self, text: bytes) -> bool:
        """Whether it holds no special string and is cut by single spaces."""
        if not self.rule.by_spaces(text):
            return False
        return self.special is None or not self.special.search(text)

    def cut(self, text: bytes) -> list:
        """Chunks of a text; a special string is one of its own, as a tuple."""
        if self.special is None or not self.special.search(text):
            return self.rule.cut(text)
        chunks, at = [], 0
        for found in self.special.finditer(text):
            chunks += self.rule.cut(text[at : found.start()])
            chunks.append((found[0],))
            at = found.end()
        return chunks + self.rule.cut(text[at:])

    def part(self, part: str) -> list[int]:
        """Ids of a part that the tokenizer does not cut, by the library's model."""
        ids = self.parts.get(part)
        if ids is None:
            letters = self.rule.plain(part)
            if letters.isascii():  # visible signs stand for themselves
                letters = letters.replace(" ", BYTE_LETTERS[32]).replace("\n", BYTE_LETTERS[10])
            else:
                letters = letters.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = self.parts[part] = [token.id for token in self.tokenize(letters)]
        return ids

    def word(self, word: str) -> list[int]:
        """Ids of a word, from where it was a chunk of its own if it was."""
        if word not in self.parts and self.rule.keeps_blanks:
            place = self.places.get(word[1:].encode() if word[0] == " " else word)
            if place is not None:
                start = self.starts[place]
                return self.ids[start : start + self.sizes[place]].tolist()
        return self.part(word)

    def learn(self, chunks: list):
        """Encode chunks that are not known yet."""
        if len(self.parts) > REMEMBER_PARTS:
            self.parts = {}
        first, lists, slow = len(self.sizes), [], []
        spell, glance, part_ids = self.rule.spelled, GLANCE.fullmatch, self.part
        word_ids = self.word
        for chunk in chunks:
            seen = None if isinstance(chunk, tuple) else glance(spell(chunk))
            if seen is None:
                slow.append(len(lists))
                lists.append(())
                continue
            word, marks, line, start, more = seen.groups()
            ids = word_ids(word) if marks or line else part_ids(word)
            if marks:
                ids = ids + part_ids(marks)
            if line:
                ids = ids + part_ids(line) if self.rule.keeps_blanks else ids
                ids = ids + word_ids(start)
                if more:
                    ids = ids + part_ids(more)
            lists.append(ids)
        spelled = [
            chunk[0].decode() if isinstance(chunk, tuple) else spell(chunk)
            for chunk in (chunks[k] for k in slow)
        ]
        for k, e in zip(slow, self.library.encode_batch(spelled, add_special_tokens=False)):
            lists[k] = e.ids
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, flat])
        self.places.update(zip(chunks, range(first, first + len(chunks))))

    def known(self, chunks: list) -> np.ndarray:
        """The places of chunks; those not known yet are learnt."""
        found = np.fromiter(map(self.places.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [chunks[k] for k in missing.tolist()]
            self.learn(list(dict.fromkeys(new)))
            found[missing] = np.fromiter(map(self.places.get, new), np.int64, len(new))
        return found

    def cut_known(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places of all chunks, chunks per text)."""
        chunks = [self.cut(text) for text in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        return self.known(list(chain.from_iterable(chunks))), counts

    def split_known(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """`cut_known` of texts cut by single spaces: each distinct chunk is looked up once."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        index, values = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())
        whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        chunks = pc.binary_join(whole, b" ")[0].as_py().split(b" ")
        later = np.ones(len(index), bool)
        later[offsets[:-1]] = False
        used = np.zeros(len(chunks), bool)
        used[index[later]] = True
        used = np.flatnonzero(used)
        place = np.full(len(chunks), -1)
        place[used] = self.known([chunks[k] for k in used.tolist()])
        at = place[index]
        # a text's first chunk has no space before it; an empty one is none
        first = [chunks[k].decode() for k in index[offsets[:-1]].tolist()]
        real = np.fromiter(map(bool, first), bool, len(first))
        at[offsets[:-1][real]] = self.known([chunk for chunk in first if chunk])
        later[offsets[:-1][real]] = True
        return at[later], np.diff(offsets) - ~real

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, the end id after each text, and the ids per text."""
        if len(self.places) > REMEMBER:
            self.clear()
        simple = np.fromiter(map(self.simple, texts), bool, len(texts))
        counts = np.zeros(len(texts), np.int64)
        found = []
        for mask, places in ((simple, self.split_known), (~simple, self.cut_known)):
            mine = np.flatnonzero(mask)
            if len(mine):
                at, counts[mine] = places([texts[k] for k in mine.tolist()])
                found.append((mine, at))
        last = np.cumsum(counts + 1) - 1
        at = np.zeros(int(last[-1]) + 1 if len(last) else 0, np.int64)
        for mine, places in found:
            size = counts[mine]
            shift = last[mine] - size - (np.cumsum(size) - size)
            at[np.arange(len(places)) + np.repeat(shift, size)] = places
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        place = np.repeat(self.starts[at] - (ends - sizes), sizes)
        ids = self.ids[place + np.arange(len(place))]
        return ids, np.diff(ends[last], prepend=0)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, end_id: int, rule) -> ChunkEncoder:
    """One for each worker process and vocabulary."""
    key = (path, end_id, rule.__name__)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, end_id, rule)
    return _ENCODERS[key]
