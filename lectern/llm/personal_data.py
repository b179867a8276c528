"""Personal data: fixed rules, and a conditional random field over word shapes.

The rules find mail addresses, IP addresses, card and phone numbers. The method tags the words
of each text as names, postal addresses, phone numbers without country code, spelled-out mail
addresses, identity numbers and dates of birth, by the best path of a field that is trained
from a small labelled table. Spans that touch one of the rules' are left to the rules.
"""

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm import crf, personal_samples
from lectern.llm.common import pieces, raw, reachable, texts

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins, so no start is tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
WORDS = re.compile(r"\w")
LOOSE = " \t\r\v\f" + crf.CLING.decode()
#: Kinds in their order; those of the method begin with this mark.
BASE = ("email", "ip", "card", "phone")
MARK = "crf_"
KINDS = (*BASE, *(MARK + k for k in personal_samples.KINDS))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the mail rule, found from each @ backwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def leading(number: str) -> str:
    return number.lstrip("0")


def luhn(number: str) -> bool:
    """True if the digits of `number` pass the Luhn check."""
    digits = [int(c) for c in reversed(DIGITS.findall(number))]
    twice = (2 * d - 9 * (d > 4) for d in digits[1::2])
    return (sum(digits[::2]) + sum(twice)) % 10 == 0


def card(number: str) -> bool:
    return 13 <= len(DIGITS.findall(number)) <= 19 and luhn(number)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the rules, in code points, by kind and then start."""
    out = [(s, e, "email") for s, e in emails(text)]
    out += [
        (*m.span(), "ip")
        for m in IP.finditer(text)
        if all(len(p) < 4 and int(p or 0) <= 255 for p in map(leading, m[0].split(".")))
    ]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if card(m[0])]
    out += [
        (*m.span(), "phone")
        for m in PHONE.finditer(text)
        if 9 <= len(DIGITS.findall(m[0])) <= 15
    ]
    return out


@lru_cache(maxsize=1)
def trained() -> crf.Field:
    """The field that is trained from the given labelled table (some 600 sentences)."""
    return crf.fit(personal_samples.samples(), ["none", *personal_samples.KINDS])


def labelled(table: DataFrame, limit: int = 20_000) -> list[list[tuple[str, str]]]:
    """Sentences of a labelled table (sentence, place, word, kind), none where kind is null.

    At most `limit` words, by sentence and place; nulls in the other columns are left out.
    """
    rows = table.select("sentence", "place", "word", F.coalesce("kind", F.lit("none")).alias("kind"))
    found = rows.dropna().orderBy("sentence", "place", "word", "kind").limit(limit).collect()
    out: dict = {}
    for r in found:
        out.setdefault(r["sentence"], []).extend((w, r["kind"]) for w in r["word"].split())
    return list(out.values())


def outside(text: str, span: tuple[int, int, str], base: list) -> list[tuple[int, int, str]]:
    """What the rules leave of a span of the method: nothing where both are of one kind."""
    start, end, kind = span
    met = sorted(b for b in base if b[0] < end and start < b[1])
    if any(MARK + b[2] == kind for b in met):
        return []
    cuts = [start, *(x for b in met for x in b[:2]), end]
    out = []
    for s, e in zip(cuts[::2], cuts[1::2]):
        part = text[s:e]
        if WORDS.search(part):
            first = s + len(part) - len(part.lstrip(LOOSE))
            out.append((first, first + len(part.strip(LOOSE)), kind))
    return out


def all_spans(batch: pa.RecordBatch, model: crf.Field):
    """(base spans, all spans) of each text of a batch, by kind and then start.

    All texts are one chain, line breaks around each.
    """
    column = batch.column("text")
    parts = raw(column)
    starts = np.cumsum([1, *(len(p) + 2 for p in parts)])
    added: list[list] = [[] for _ in parts]
    for start, end, kind in model.spans(b"\n" + b"\n\n".join(parts) + b"\n"):
        k = int(np.searchsorted(starts, start, "right")) - 1
        part, start, end = parts[k], start - starts[k], end - starts[k]
        at = len(part[:start].decode())
        added[k].append((at, at + len(part[start:end].decode()), MARK + kind))
    out = []
    for text, more in zip(column.to_pylist(), added):
        base = base_spans(text)
        more = [left for span in more for left in outside(text, span, base)]
        out.append((base, sorted(base + more, key=lambda s: (KINDS.index(s[2]), s[0]))))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def personal_data(docs: DataFrame, model: crf.Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_crf.

    Spans are kind:start:end in code points, end exclusive, by kind and then start. Null and
    empty texts have none. Rows without doc_id and repeated rows each keep their row; other
    columns are not read.
    """
    model = model or trained()

    def work(batches):
        for batch in pieces(batches):
            found = all_spans(batch, model)
            counts = [[sum(s[2] == k for s in base) for base, _ in found] for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]),
                    pa.array([joined(s) for _, s in found]),
                    pa.array([len(s) - len(b) for b, s in found], pa.int64()),
                ],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_crf"],
            )

    return texts(docs).mapInArrow(
        work,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string,"
        " spans string, n_crf long",
    )


def without_personal_data(docs: DataFrame, model: crf.Field | None = None) -> DataFrame:
    """(doc_id, text) of all documents, each span replaced by its kind in angle brackets.

    Of spans that overlap, the one that begins first is named. Null texts stay null.
    """
    model = model or trained()

    def cleaned(text, spans):
        out, at = [], 0
        for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
            if start >= at:
                out += [text[at:start], f"<{kind.removeprefix(MARK)}>"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def work(batches):
        for batch in pieces(batches):
            found = all_spans(batch, model)
            values = zip(batch.column("text").to_pylist(), batch.column("held").to_pylist(), found)
            new = [None if h else cleaned(t, spans) for t, h, (_, spans) in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(new, pa.string())], names=["doc_id", "text"]
            )

    reachable(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("text").isNull().alias("held"),
    )
    return rows.mapInArrow(work, "doc_id long, text string")
