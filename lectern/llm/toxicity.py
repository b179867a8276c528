"""Toxicity by a weighted grammar of clauses.

Transducers are composed into one table: a lexicon gives words a symbol (insult, threat,
target, negation, reported speech), a scope machine follows negation and reported speech
through a clause, an attack machine pairs insults and threats with targets. A clause scores
what the composed machine writes, so an insult counts less when negated or quoted, and more
when aimed at somebody. The lexicon of insults and its weights are learned from labelled
documents, as is the curve from clause scores to a chance.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import pieces, texts

#: Most labelled documents of either label that are learned from, chosen by a hash of the id.
#: Those of a label with more count for all of them, see label_weights.
SAMPLE = {1: 2_500, 0: 5_000}
#: Most entries of the learned lexicon.
ENTRIES = 4_000
#: Lengths of word beginnings that may be entries.
STEMS = (4, 5, 6)
#: An entry needs so much evidence (nats), and this share of its documents toxic.
EVIDENCE, SHARE = 9.0, 0.75
#: Share of label 1 from which a document counts as toxic.
TAKE = 0.3

#: Small closed classes of words in four languages.
TARGETS = set(
    "you your yours yourself he she they him her them his their u ya"
    " du dich dir dein deine ihr euch euer sie er"
    " tu te toi ton ta tes vous votre vos il elle ils elles"
    " tú ti tus usted ustedes vosotros él ella ellos ellas".split()
)
NEGATIONS = set(
    "not no never nobody without isn't aren't don't"
    " nicht kein keine keinen nie niemals ohne"
    " pas jamais aucun aucune sans"
    " nunca jamás ningún ninguna sin".split()
)
REPORTS = set(
    "said says say told quoted quote wrote writes called claims claimed reported"
    " sagte sagt sagten schrieb zitiert nannte"
    " dit disait écrit appelé cité"
    " dijo dice dijeron escribió llamó citó".split()
)
THREATS = set(
    "kill hurt destroy murder attack burn shoot beat"
    " töten töte umbringen schlagen sterben"
    " tuer tuerai frapper détruire"
    " matar mataré golpear morir destruir".split()
)

#: Symbols: any word, clause end, then the classes.
WORD, BREAK, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
BREAKS = set(".!?;:\n")
#: What an insult or a threat counts for: as it is, negated, reported, both.
SCOPES = (1.0, 0.5, 0.6, 0.4)
#: Weight of a word of THREATS; factor of an attack with a target in the clause.
THREAT_WEIGHT, AIMED = 0.5, 1.5

#: Numbers that the curve is fitted on, see Grammar.features.
FEATURES = 4


def compose() -> tuple[np.ndarray, np.ndarray]:
    """(next state, factor written) for each state and symbol of the composed machine.

    A state is a scope (0 to 3) and whether a target was met: 4 * target + scope.
    """
    go = np.zeros((8, 7), np.int64)
    out = np.zeros((8, 7))
    for state in range(8):
        target, scope = divmod(state, 4)
        go[state] = state
        go[state, BREAK] = 0
        go[state, NEGATION] = 4 * target + (scope | 1)
        go[state, REPORT] = 4 * target + (scope | 2)
        go[state, TARGET] = 4 + scope
        factor = SCOPES[scope] * (AIMED if target else 1.0)
        out[state, INSULT] = out[state, THREAT] = factor
    return go, out


GO, OUT = compose()


@dataclass
class Grammar:
    """Weights of insults: whole words as "=word", word beginnings as they are."""

    weights: dict[str, float]

    def __post_init__(self):
        self.seen: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return self.weights

    def __setstate__(self, weights):
        self.weights, self.seen = weights, {}

    def symbol(self, word: str) -> tuple[int, float]:
        """Class and weight of a lower-case word."""
        found = self.seen.get(word)
        if found is None:
            weight = max(
                self.weights.get("=" + word, 0.0),
                *(self.weights.get(word[:n], 0.0) for n in STEMS if len(word) >= n),
                0.0,
            )
            kind = WORD
            if weight:
                kind = INSULT
            elif word in THREATS:
                kind, weight = THREAT, THREAT_WEIGHT
            elif word in TARGETS:
                kind = TARGET
            elif word in NEGATIONS:
                kind = NEGATION
            elif word in REPORTS:
                kind = REPORT
            elif word in BREAKS:
                kind = BREAK
            if len(self.seen) > 500_000:
                self.seen.clear()
            found = self.seen[word] = (kind, weight)
        return found

    def clauses(self, text: str) -> list[float]:
        """Scores above zero of the clauses of a text, in order."""
        return self.read(TOKEN.findall(text.lower()))

    def read(self, tokens: list[str]) -> list[float]:
        symbols = list(map(self.symbol, tokens))
        attacks = [k for k, (kind, _) in enumerate(symbols) if kind in (INSULT, THREAT)]
        found, until = [], -1
        for at in attacks:
            if at < until:
                continue
            begin = at
            while begin and symbols[begin - 1][0] != BREAK:
                begin -= 1
            state, score, until = 0, 0.0, begin
            attacked = 0.0
            while until < len(symbols) and symbols[until][0] != BREAK:
                kind, weight = symbols[until]
                score += OUT[state, kind] * weight
                attacked += weight * (kind in (INSULT, THREAT)) * SCOPES[state % 4]
                state = GO[state, kind]
                until += 1
            # a target may also follow the attack
            found.append(max(score, attacked * AIMED) if state >= 4 else score)
        return found

    def features(self, text: str) -> tuple[float, ...]:
        """Strongest clause, sum of all, attacking clauses per 100 words, words."""
        tokens = TOKEN.findall(text.lower())
        scores = self.read(tokens)
        size = max(1, len(tokens))
        return (
            max(scores, default=0.0),
            float(np.log1p(sum(scores))),
            float(np.log1p(100 * len(scores) / size)),
            float(np.log1p(size)),
        )


def known_labels(labels: DataFrame, label: str = "toxic") -> DataFrame:
    return labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")
    ).filter("doc_id IS NOT NULL AND label IN (0, 1)")


def label_weights(labels: DataFrame, label: str = "toxic") -> dict[int, float]:
    """How many labelled documents a sampled one of each label stands for."""
    totals = dict(known_labels(labels, label).groupBy("label").count().collect())
    return {k: max(1.0, totals.get(k, 0) / n) for k, n in SAMPLE.items()}


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, text, label) of the labelled documents that are learned from, at most SAMPLE of them."""
    known = known_labels(labels, label)
    parts = [
        known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for k, n in SAMPLE.items()
    ]
    return texts(docs).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")


def learn_lexicon(found: DataFrame, stands: dict[int, float] | None = None) -> dict[str, float]:
    """Weights of words and word beginnings that tell toxic documents, at most ENTRIES.

    Documents are counted, each only for words in a context (the words before and after) that
    no document of lower id has, so that copies count once. The evidence is that of a
    likelihood ratio test on the sample; shares and weights are those of all labelled documents,
    of which a document of label k stands for `stands[k]`.
    """
    stands = stands or {0: 1.0, 1: 1.0}
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    rows = found.select("label", "doc_id", words.alias("w"))
    totals = dict(rows.groupBy("label").agg(F.countDistinct("doc_id")).collect())
    if len(totals) < 2:
        return {}
    w, end = F.col("w"), F.array(F.lit(""))
    trios = F.arrays_zip(
        F.concat(end, "w").alias("before"),
        w.alias("word"),
        F.concat(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), end).alias("after"),
    )
    words = rows.select("label", "doc_id", F.explode(trios).alias("x")).filter("x.word <> ''")
    words = words.select(
        "label", "doc_id", "x.word", F.xxhash64("x.before", "x.word", "x.after").alias("context")
    )
    words = words.groupBy("label", "word", "context").agg(F.min("doc_id").alias("doc_id"))
    words = words.select("label", "doc_id", "word").distinct()
    stems = F.array(
        F.concat(F.lit("="), "word"),
        *(F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEMS),
    )
    counts = (
        words.select("label", "doc_id", F.explode(stems).alias("stem"))
        .filter("stem IS NOT NULL")
        .distinct()
        .groupBy("stem")
        .agg(F.sum("label").alias("k"), F.count("*").alias("n"))
    )
    part = totals[1] / (totals[0] + totals[1])
    k, c, n = F.col("k"), F.col("n") - F.col("k"), F.col("n")
    gain = k * F.log(k / (n * part)) + F.when(
        c > 0, c * F.log(c / (n * (1 - part)))
    ).otherwise(0.0)
    best = (
        counts.filter((k * stands[1] / (k * stands[1] + c * stands[0]) >= SHARE) & (k / n > part))
        .withColumn("gain", gain)
        .filter(F.col("gain") >= EVIDENCE)
        .orderBy(F.desc("gain"), "stem")
        .limit(ENTRIES)
    )
    odds = stands[1] / stands[0]
    return {
        r["stem"]: float(min(2.0, max(0.5, np.log(odds * r["k"] / (r["n"] - r["k"] + 0.5)) / 2)))
        for r in best.collect()
    }


def fit_curve(
    rows: np.ndarray, labels: np.ndarray, decay: float = 1e-3, stands: np.ndarray | None = None
) -> np.ndarray:
    """Weights of a logistic curve over `rows` and a constant, by Newton's method.

    A row counts `stands` times.
    """
    counts = np.ones(len(rows)) if stands is None else stands
    x = np.column_stack([rows, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    if not len(rows) or labels.min() == labels.max():
        w[0], w[-1] = 2.0, -3.0
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (labels - p)) / counts.sum() - decay * w
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x / counts.sum() + decay * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, learn, take: float = TAKE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, clauses.

    `learn` makes a condition of the column doc_id; labels of other rows are not read. Null
    texts count as empty, and an empty text has no clauses. Without labels of both kinds the
    grammar knows threats only. A document without id is not held out.
    """
    learnable = labels.filter(learn(F.col("doc_id")))
    known, stands = sample(docs, learnable), label_weights(learnable)
    grammar = Grammar(learn_lexicon(known, stands))

    def measure(batches):
        for batch in pieces(batches):
            rows = [grammar.features(t) for t in batch.column("text").to_pylist()]
            row = [np.array(r).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.binary()), batch.column("label")], names=["row", "label"]
            )

    found = known.select("text", "label").mapInArrow(measure, "row binary, label int").toArrow()
    rows = np.frombuffer(b"".join(found["row"].to_pylist())).reshape(found.num_rows, FEATURES)
    target = found["label"].to_numpy().astype(float)
    order = np.lexsort(np.column_stack([target, rows]).T)
    curve = fit_curve(
        rows[order], target[order], stands=np.where(target[order] == 1, stands[1], stands[0])
    )

    def score(batches):
        for batch in pieces(batches):
            rows = np.array([grammar.features(t) for t in batch.column("text").to_pylist()])
            chance = 1 / (1 + np.exp(-np.clip(rows @ curve[:-1] + curve[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(chance), pa.array(rows[:, 0])],
                names=["doc_id", "score", "strongest_clause"],
            )

    scored = texts(docs).mapInArrow(score, "doc_id long, score double, strongest_clause double")
    return scored.select(
        "doc_id",
        F.coalesce(~learn(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= take).cast("int").alias("predicted"),
        "strongest_clause",
    )
