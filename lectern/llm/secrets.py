"""Secret scan: fixed rules, and Markov models of random strings and ordinary identifiers.

The rules find assignments, access keys and hexadecimal strings. The method looks at every
other unbroken string of 12 or more letters, digits and joining signs: it compares the
log-likelihood of its characters under two models of character pairs, one of random strings, one
of identifiers and words, and reports strings that the first explains better by TOTAL. A short
string needs a higher ratio per character than a long one; nothing else decides.
"""

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import free_name, pieces, reachable, texts

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Order of kinds that begin at one place; the last is the method's.
KINDS = ("assign", "access", "hex", "markov")
#: What the models judge: unbroken strings of this alphabet.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
#: Signs that end a sentence or join words; a run is judged without them at its ends.
EDGES = ".=-"
#: What counts as ordinary in training: letters, with digits at the end only.
ORDINARY = re.compile(
    r"(?<![A-Za-z0-9+/_=.-])[A-Za-z][A-Za-z/_=.-]{2,}[0-9]{0,4}(?![A-Za-z0-9+/_=.-])"
)
#: Ordinary strings that texts may lack, as labelled samples.
NAMES = (
    "well-known-thing user_name max-length on-the-fly main.py os.path.join foo_bar_baz self.value"
    " README.md key=value get-item-by-id http-equiv index.html utf-8 x86_64 ISO-8859-1 HelloWorld"
    " toString getElementById"
).split()
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.="
SIZE = len(ALPHABET) + 1
CODE = np.zeros(128, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, SIZE)
#: A string is reported from this length and log-likelihood ratio of the whole string (nats).
LEAST, TOTAL = 12, 15.0
#: Random strings of each alphabet in the labelled sample.
DRAWN = 2_000
#: Observations that the frequency of a character anywhere stands for after each character.
PRIOR = 20.0
#: Share of any character after any other, so that unseen pairs do not grow rarer with the corpus.
ANY = 0.02


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the rules, in code points, by start and then kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def other_runs(
    text: str, spans: list[tuple[int, int, str]], rule: re.Pattern = RUN
) -> list[tuple[int, int]]:
    """Unbroken strings that no span of the rules touches."""
    found = [m.span() for m in rule.finditer(text)]
    if not spans:
        return found
    taken = sorted((s, e) for s, e, _ in spans)
    ends = np.maximum.accumulate([e for _, e in taken])
    starts = [s for s, _ in taken]
    free = []
    for start, end in found:
        k = np.searchsorted(starts, end)
        if not k or ends[k - 1] <= start:
            free.append((start, end))
    return free


def pair_codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (character before, character), 0 before the first, and strings' lengths."""
    sizes = np.array([len(s) for s in strings], np.int64)
    codes = CODE[np.frombuffer("".join(strings).encode("ascii"), np.uint8)]
    before = np.roll(codes, 1)
    if len(codes):
        before[np.cumsum(sizes) - sizes] = 0
    return before * SIZE + codes, sizes


@dataclass
class Models:
    """Log-likelihood ratio of each pair of characters, random against ordinary."""

    ratio: np.ndarray

    def score(self, strings: list[str]) -> np.ndarray:
        """Ratio of each (non-empty) string."""
        if not strings:
            return np.zeros(0)
        codes, sizes = pair_codes(strings)
        return np.add.reduceat(self.ratio[codes], np.cumsum(sizes) - sizes)


def random_strings(count: int = DRAWN, seed: int = 7) -> list[str]:
    """Labelled samples of random strings: letters, digits, both, base64 and hexadecimal."""
    draw = random.Random(seed)
    upper, lower, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    kinds = (
        *(upper + lower + digits, ALPHABET[:64], upper + lower + digits + "-_", upper + lower),
        *(upper + digits, lower + digits, lower, "0123456789abcdef"),
    )
    return ["".join(draw.choices(a, k=draw.randint(16, 48))) for a in kinds for _ in range(count)]


def ordinary_strings(count: int = 50, numbers: int = DRAWN, seed: int = 8) -> list[str]:
    """Labelled samples of ordinary strings: names with signs, addresses, dates, versions."""
    draw = random.Random(seed)
    part = lambda most: str(draw.randrange(most))
    out = [".".join(part(256) for _ in range(4)) for _ in range(numbers)]
    out += [f"{1950 + draw.randrange(90)}-{part(13):0>2}-{part(32):0>2}" for _ in range(numbers)]
    out += [f"{part(1000):0>3}-{part(1000):0>3}-{part(10000):0>4}" for _ in range(numbers)]
    out += [f"{part(10)}.{part(30)}.{part(100)}" for _ in range(numbers)]
    out += ["".join(draw.choices("0123456789", k=16)) for _ in range(numbers)]
    return out + NAMES * count


def counts_of(strings: list[str]) -> np.ndarray:
    return np.bincount(pair_codes(strings)[0], minlength=SIZE * SIZE)


def pair_counts(samples: DataFrame) -> DataFrame:
    """(label int, pair int, n long) of samples (value string, label 0 or 1).

    Counted within each partition first, so at most 2 * SIZE * SIZE rows leave it. Characters
    outside the alphabet are left out; nulls count as empty.
    """
    reachable(samples.sparkSession)

    def work(batches):
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in pieces(batches, "value"):
            values, marks = batch.column("value").to_pylist(), batch.column("label").to_pylist()
            for label in (0, 1):
                total[label] += counts_of(
                    [
                        "".join(c for c in v if c in ALPHABET)
                        for v, mark in zip(values, marks)
                        if mark == label
                    ]
                )
        yield counted(total)

    rows = samples.select(
        F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"),
        F.col("label").cast("int").alias("label"),
    )
    found = rows.mapInArrow(work, "label int, pair int, n long")
    return found.groupBy("label", "pair").agg(F.sum("n").alias("n"))


def counted(total: np.ndarray) -> pa.RecordBatch:
    label, pair = np.nonzero(total)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(label.astype(np.int32)),
            pa.array(pair.astype(np.int32)),
            pa.array(total[label, pair]),
        ],
        names=["label", "pair", "n"],
    )


def corpus_counts(docs: DataFrame) -> DataFrame:
    """`pair_counts` of all documents: 1 for what the rules found, 0 for all other strings."""

    def work(batches):
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in pieces(batches):
            ordinary, secret = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                found = [text[s:e].strip(EDGES) for s, e in other_runs(text, spans, ORDINARY)]
                ordinary += [run for run in found if run]
                secret += [text[s:e] for s, e, kind in spans if kind != "assign"]
            total[0] += counts_of(ordinary)
            total[1] += counts_of(secret)
        yield counted(total)

    found = texts(docs).mapInArrow(work, "label int, pair int, n long")
    return found.groupBy("label", "pair").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, smooth: float = 0.5) -> Models:
    """Both models from pair counts (at most 2 * SIZE * SIZE rows) and the labelled samples.

    The random model is the mean of drawn and found secrets, so that one frequent kind does
    not hide the others; the ordinary one counts the samples as a tenth of the other strings.
    After a character that was seen seldom, characters are as frequent as anywhere, which counts
    as PRIOR observations, and any character has its share of ANY, so the ratio of a pair is
    bounded at every size of the corpus. Without ordinary strings nothing is reported.
    """
    total = np.zeros((2, SIZE * SIZE))
    for label, pair, n in counts.select("label", "pair", "n").collect():
        total[label, pair] = n

    def chances(n):
        n = n.reshape(SIZE, SIZE)[:, 1:]
        single = (n.sum(0) + smooth) / (n.sum() + smooth * (SIZE - 1))
        out = np.ones((SIZE, SIZE))
        seen = (n + PRIOR * single) / (n.sum(1, keepdims=True) + PRIOR)
        out[:, 1:] = (1 - ANY) * seen + ANY / (SIZE - 1)
        return out.ravel()

    sampled = counts_of(ordinary_strings()).astype(float)
    ordinary = chances(total[0] + sampled * (0.1 * total[0].sum() / sampled.sum()))
    drawn = chances(counts_of(random_strings()).astype(float))
    chance = (drawn + chances(total[1])) / 2 if total[1].any() else drawn
    return Models(np.log(chance / ordinary) if total[0].any() else np.zeros(SIZE * SIZE))


def judged(text: str, start: int, end: int) -> tuple[int, int]:
    """A run without the signs at its ends."""
    run = text[start:end]
    first = start + len(run) - len(run.lstrip(EDGES))
    return first, first + len(run.strip(EDGES))


def all_spans(found: list[str], models: Models, least: int, total: float):
    """Spans of each text: those of the rules and those of the method, in order."""
    base = [base_spans(text) for text in found]
    runs = [
        (k, s, e)
        for k, text in enumerate(found)
        for s, e in (judged(text, *run) for run in other_runs(text, base[k]))
        if e - s >= least
    ]
    out = [list(spans) for spans in base]
    for (k, s, e), score in zip(runs, models.score([found[k][s:e] for k, s, e in runs])):
        if score >= total:
            out[k].append((s, e, "markov"))
    order = [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in out]
    return base, order


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secrets(docs: DataFrame, least: int = LEAST, total: float = TOTAL) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    The models are trained on all documents. Null and empty texts have no spans. Rows without
    doc_id and repeated rows each keep their row.
    """
    models = fit(corpus_counts(docs))

    def work(batches):
        for batch in pieces(batches):
            base, spans = all_spans(batch.column("text").to_pylist(), models, least, total)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(
                        pa.array([sum(s[2] == k for s in x) for x in spans], pa.int64())
                        for k in KINDS
                    ),
                    pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]),
                    pa.array([joined(x) for x in spans]),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return texts(docs).mapInArrow(
        work,
        "doc_id long, n_assign long, n_access long, n_hex long, n_markov long,"
        " base_sha256 string, spans string",
    )


def covered(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """`text` with each stretch under one or more spans replaced by `mark`."""
    parts, at, until = [], 0, -1
    for start, end, _ in spans:
        if start >= until:
            parts += [text[at:start] if until < 0 else text[until:start], mark]
        until = max(until, end)
    return text if until < 0 else "".join([*parts, text[until:]])


def without_secrets(
    docs: DataFrame, mark: str = "<secret>", least: int = LEAST, total: float = TOTAL
) -> DataFrame:
    """`docs`, all columns and rows, with secrets in `text` replaced by `mark`; nulls stay."""
    reachable(docs.sparkSession)
    models = fit(corpus_counts(docs))
    names, place = docs.columns, docs.columns.index("text")
    whole = free_name(docs, "whole_text")

    def work(batches):
        for batch in pieces(batches, whole):
            found = batch.column(whole).to_pylist()
            _, spans = all_spans(found, models, least, total)
            new = [covered(t, s, mark) for t, s in zip(found, spans)]
            held = batch.column(names[place]).is_null().to_pylist()
            column = pa.array([None if h else t for t, h in zip(new, held)], pa.string())
            yield batch.select(names).set_column(place, names[place], column)

    rows = docs.withColumn(whole, F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.mapInArrow(work, docs.schema)
