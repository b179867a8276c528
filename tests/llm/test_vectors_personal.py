"""Clustering, hard negatives and personal data against plain versions, on odd and empty tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import clustering, crf, hard_negatives, personal_data, personal_samples, vectors
from lectern.plans import catalog

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster int, x int, anchor int"


@pytest.fixture(scope="session")
def odd_vectors(spark):
    """Nulls everywhere, short, long and non-finite vectors, repeated rows, clashing names."""
    draw = random.Random(3)
    rows = [(k, [draw.uniform(-1, 1) for _ in range(8)], draw.randrange(3)) for k in range(80)]
    rows += [(k, rows[0][1], draw.randrange(3)) for k in range(200, 230)]  # equal vectors
    rows += [rows[4], rows[20], rows[20]]  # equal rows
    rows += [(300, None, 1), (301, [1.0] * 7, 1), (302, [], 2), (303, [1.0] * 9, 0)]
    rows += [(304, [NAN] * 8, 1), (305, [INF] + [0.0] * 7, 1), (306, [None] + [0.0] * 7, 1)]
    rows += [(None, [0.5] * 8, 1), (307, [0.25] * 8, None), (308, [-0.0] * 8, -4)]
    return spark.createDataFrame([(*r, "v", 1, 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_vectors(spark):
    return spark.createDataFrame([], SCHEMA)


def ints(v):
    return [math.floor(256 * x) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# clustering


def plain_clusters(rows, k, rounds):
    kept = [(i, ints(v)) for i, v in rows if good(v) and len(v) == 8]
    key = sorted(
        (hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None
    )
    centroids = [v for _, v in key[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        for n, g in groups.items():
            centroids[n] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, *assign(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in found if m == n) for n in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i is None, i or 0), n, d, inertia[n], sum(inertia.values()), digest[n])
        for i, d, n in found
    )


@pytest.mark.parametrize("k,rounds", [(5, 5), (40, 2), (500, 1), (3, 0)])
def test_clusters_equal_full_distances(odd_vectors, k, rounds):
    got = clustering.clusters(odd_vectors, k, rounds, width=8).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in odd_vectors.collect()]
    assert plain_clusters(rows, k, rounds) == sorted(
        ((r[0] is None, r[0] or 0), r["cluster"], r["distance"], *r[3:]) for r in got
    )


def test_clusters_of_nothing(no_vectors, odd_vectors):
    assert clustering.clusters(no_vectors).count() == 0
    assert clustering.clusters(odd_vectors, width=64).count() == 0


def test_products_are_updated_exactly():
    draw = np.random.default_rng(1)
    x = draw.integers(-300, 300, (50, 6))
    old, new = draw.integers(-300, 300, (4, 6)), None
    new = old.copy()
    new[1, 2] += 5
    new[3] = 0
    dots = clustering.updated(x @ old.T, x, new - old)
    assert (dots == x @ new.T).all()


def test_large_components_are_exact_or_refused():
    a = np.array([[2**30, -(2**29)], [3, 4]])
    assert vectors.products(a, a).tolist() == (a.astype(object) @ a.T.astype(object)).tolist()
    with pytest.raises(OverflowError):
        vectors.products(np.array([[2**40]]), np.array([[2**40]]))
    with pytest.raises(OverflowError):
        vectors.whole(np.array([1e300]))


# hard negatives


def plain_negatives(rows, positives, negatives, low, high, step):
    rows = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, ints(v))
        for i, v, label in rows
        if i is not None and label is not None and good(v)
    ]
    anchors = {(i, n, tuple(v)) for i, n, v in rows if i % step == 0}
    out = []
    for a, mine, v in anchors:
        scores = sorted(
            (-sum(p * q for p, q in zip(v, w)), i, n == mine) for i, n, w in rows if i != a
        )
        for s, p, _ in [x for x in scores if x[2]][:positives]:
            found = [
                (-t, i)
                for t, i, same in scores
                if not same and low * -s <= 100 * -t <= high * -s
            ]
            out += [(a, p, r, i, -s, t) for r, (t, i) in enumerate(found[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(
    "block,positives,negatives,low,high",
    [(16_384, 5, 10, 30, 90), (3, 5, 10, 30, 90), (4, 3, 2, 0, 100), (7, 40, 200, 10, 95)],
)
def test_negatives_equal_a_window_for_each_positive(
    odd_vectors, monkeypatch, block, positives, negatives, low, high
):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SIDE_V", 16)
    got = hard_negatives.hard_negatives(
        odd_vectors, F.col("vec_id") % 10 == 0, hard_negatives.relabelled(),
        positives, negatives, low, high,
    )
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in odd_vectors.collect()]
    want = plain_negatives(rows, positives, negatives, low, high, 10)
    assert sorted(map(tuple, got.collect())) == want and want


def test_negatives_of_nothing(no_vectors, odd_vectors):
    for rows, anchor in ((no_vectors, F.lit(True)), (odd_vectors, F.lit(False))):
        assert hard_negatives.hard_negatives(rows, anchor).count() == 0


def test_lanes_keep_the_best():
    draw = random.Random(8)
    lanes, seen = hard_negatives.Lanes(3, 4), {0: [], 1: [], 2: []}
    for _ in range(30):
        new = [(draw.randrange(3), draw.randrange(9), draw.randrange(50)) for _ in range(5)]
        for lane, score, i in new:
            seen[lane].append((-score, i))
        lanes.offer(*(np.array(c) for c in zip(*new)))
    got = sorted((int(n), -int(s), int(i)) for n, s, i in zip(*lanes.rows()))
    assert got == sorted((n, *x) for n, found in seen.items() for x in sorted(found)[:4])


# personal data

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")


def plain_luhn(number):
    total = 0
    for k, c in enumerate(reversed([c for c in number if c.isdigit()])):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    count = lambda m: sum(c.isdigit() for c in m[0])
    out = [(*m.span(), "email") for m in MAIL.finditer(text)]
    out += [
        (*m.span(), "ip") for m in IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))
    ]
    out += [
        (*m.span(), "card")
        for m in CARD.finditer(text)
        if 13 <= count(m) <= 19 and plain_luhn(m[0])
    ]
    found = personal_data.PHONE.finditer(text)
    return out + [(*m.span(), "phone") for m in found if 9 <= count(m) <= 15]


def test_base_rules_on_random_texts():
    draw = random.Random(1)
    for _ in range(20_000):
        text = "".join(draw.choices("0123456789012345@@@..ab_-+ () %é", k=draw.randint(0, 40)))
        assert plain_base(text) == personal_data.base_spans(text)
    assert personal_data.base_spans("0" * 9000 + ".1.2.3") == [(0, 9006, "ip")]


def test_personal_data_of_odd_rows(spark, odd, none):
    got = personal_data.personal_data(odd).collect()
    want = []
    for r in odd.collect():
        base = plain_base(r["text"] or "")
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        n = [sum(k == kind for _, _, k in base) for kind in ("email", "ip", "card", "phone")]
        want.append((r["doc_id"] or -1, *n, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r[0] or -1, *r[1:6]) for r in got) == sorted(want)
    assert personal_data.personal_data(none).count() == 0
    assert personal_data.without_personal_data(none).count() == 0
    left = personal_data.without_personal_data(odd)
    assert left.count() == odd.count() and left.filter("text IS NULL").count() == 1


def test_personal_texts(spark):
    texts = [
        "My name is Ana Keller, call 555-123-4567.",
        "é ü: my name is Tom Brown +1 (788) 555-0037",
        "write a.b@mail.example.com",
        "The name of the place is old.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(docs).collect()}
    assert spans[0] == "crf_name:11:21,crf_phone:28:40"
    assert spans[1] == "phone:26:43,crf_name:16:25"
    assert spans[2] == "email:6:26" and spans[3] == ""
    left = {r["doc_id"]: r["text"] for r in personal_data.without_personal_data(docs).collect()}
    assert left[1] == "é ü: my name is <name> <phone>" and left[3] == texts[3]


def test_held_out_sentences():
    """Names, places and fillings that the model never saw: words found and false alarms."""
    model = personal_data.trained()
    held = personal_samples.samples(
        3, 99,
        given="Karl Ingrid Pierre Rosa Victor Helen Bruno Elena".split(),
        family="Hoffmann Torres Petit Walker Braun Castro Fournier Clark".split(),
        places="Oxford Wien Cadiz Metz".split(),
    )
    hit = miss = false = 0
    for sentence in held:
        data = b"\n" + " ".join(w for w, _ in sentence).encode() + b"\n"
        _, _, words, shapes = crf.tokens(data)
        for (_, gold), tag in zip(sentence, model.best(model.scores(words, shapes))[1:-1]):
            found = model.tags[tag]
            hit += found == gold != "none"
            miss += found != gold != "none"
            false += found != "none" and found != gold
    assert hit / (hit + miss) > 0.9 and hit / (hit + false) > 0.9


def test_best_path_is_that_of_all_paths():
    """Viterbi with cut places against every path."""
    draw = np.random.default_rng(4)
    for _ in range(60):
        n, k = int(draw.integers(1, 6)), 3
        scores, moves = draw.normal(size=(n, k)), draw.normal(size=(k, k))
        scores[draw.random(n) < 0.3, 0] += 9
        model = crf.Field(["none", "a", "b"], {}, {}, np.zeros((1, 4, k)), moves)
        paths = [[]]
        for _ in range(n):
            paths = [[*p, y] for p in paths for y in range(k)]
        best = max(
            paths,
            key=lambda p: sum(scores[t, y] for t, y in enumerate(p))
            + sum(moves[a, b] for a, b in zip([0, *p], [*p, 0])),
        )
        assert model.best(scores).tolist() == best


def test_gradient_fits_a_rule():
    """Words after a cue are tagged, whatever the words are; no samples tag nothing."""
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcd", k=4)).capitalize()
    samples = [
        [("see", "none"), (word(), "none"), ("call", "none"), (word(), "a")] for _ in range(60)
    ]
    model = crf.fit(samples, ["none", "a"])
    assert model.spans(b"\nsee Abba call Daad\n") == [(15, 19, "a")]
    assert crf.fit([], ["none", "a"]).spans(b"call Daad") == []


def test_tokens_line_up():
    draw = random.Random(6)
    for _ in range(500):
        data = "".join(draw.choices("ab A9é.\n\t\x01\x0b ", k=30)).encode()
        starts, ends, words, shapes = crf.tokens(data)
        assert len(starts) == len(words) == len(shapes)
        for s, e, w in zip(starts, ends, words):
            assert w == (crf.BREAK if data[s:e] == b"\n" else data[s:e].lower())


def test_labelled_table(spark):
    rows = [(1, 0, "my", None), (1, 1, "name", None), (1, 2, "Bo", "name"), (2, 0, None, "x")]
    table = spark.createDataFrame(rows, "sentence int, place int, word string, kind string")
    assert personal_data.labelled(table) == [[("my", "none"), ("name", "none"), ("Bo", "name")]]


def test_other_queries_stay_apart():
    assert not [name for name in catalog.QUERIES if name.startswith("op")]
