"""Toxicity by weak supervision.

Many small voters look at a text: lexicons and word stems mined from labelled
texts, and fixed patterns. Each votes toxic, clean, or not at all. A generative
model of the votes, fitted by expectation maximisation, estimates the class
balance and each voter's accuracy; correlations that remain within the classes
lower the weight of voters that repeat one another. The posterior labels train
a linear classifier on words and stems, which scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.shared import hashed_sample, id_crc32

_words = re.compile(r"\w+").findall
STEM = 4

#: Patterns that vote toxic.
PATTERNS = {
    "insult_address": re.compile(r"\byou(?:'re| are)?\s+(?:such\s+)?(?:an?\s+)?(?:utter|total|complete|stupid|worthless)\b", re.I),
    "threat": re.compile(r"\b(?:i|we)(?:'ll| will)\s+(?:kill|hurt|find)\s+you\b", re.I),
    "shout": re.compile(r"(?:\b[A-Z]{4,}\b\W+){3,}[!?]"),
    "masked": re.compile(r"\b\w+[*#@$]{2,}\w*\b"),
}


def features(text: str) -> set[str]:
    """The distinct words of a text, and the stems of the longer ones, marked by a caret."""
    words = set(_words(text.lower()))
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


@dataclass
class Voter:
    """Votes `says` if one of its features is in a text, or (negated) if none is; or by a pattern."""

    says: int
    any_of: frozenset[str] = frozenset()
    negated: bool = False
    pattern: str = ""

    def vote(self, text: str, found: set[str]) -> int:
        hit = bool(PATTERNS[self.pattern].search(text)) if self.pattern else not self.any_of.isdisjoint(found)
        return self.says if hit != self.negated else 0


def mine_voters(found: list[set[str]], labels: np.ndarray, least_docs: int = 5, precision: float = 0.85, lexicons: int = 40, most: int = 4000) -> list[Voter]:
    """Voters from labelled texts: lexicons of telling features, patterns, and the absence of every telling feature.

    A feature tells if it is in least_docs texts or more and its smoothed share
    of toxic ones reaches `precision`. Telling features are dealt by hash into
    word and stem lexicons of their own, so that the voters err apart.
    """
    inside, toxic = Counter(), Counter()
    for f, y in zip(found, labels):
        inside.update(f)
        if y:
            toxic.update(f)
    base = (labels.sum() + 1) / (len(labels) + 2)
    telling = sorted((f for f, n in inside.items() if n >= least_docs and (toxic[f] + base) / (n + 1) >= precision), key=lambda f: (-toxic[f], f))[:most]
    groups: dict[tuple[bool, int], set[str]] = {}
    for f in telling:
        groups.setdefault((f[0] == "^", zlib.crc32(f.encode()) % lexicons), set()).add(f)
    voters = [Voter(1, frozenset(g)) for _, g in sorted(groups.items())]
    voters += [Voter(1, pattern=p) for p in sorted(PATTERNS)]
    return [*voters, Voter(-1, frozenset(telling), negated=True)]


@dataclass
class LabelModel:
    """P(toxic), each voter's accuracy where it votes, and the voters' correlations within the classes.

    Not voting says nothing, so that a voter for one language isn't outvoted by
    the silence of those for others. Votes that agree count for less the more
    their voters are correlated: each is divided by one plus its correlations
    with the others that voted so on the same text.
    """

    balance: float
    accuracy: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        total = np.full(len(votes), np.log(self.balance / (1 - self.balance)))
        odds, peers = np.log(self.accuracy / (1 - self.accuracy)), np.clip(self.correlation, 0, 1)
        for v in (-1, 1):
            cast = (votes == v).astype(float)
            total += v * (cast * odds / (1 + cast @ peers)).sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_label_model(votes: np.ndarray, prior: np.ndarray | None = None, strength: float = 10, rounds: int = 20) -> LabelModel:
    """Expectation maximisation; `prior` accuracies (four in five by default) count as `strength` votes."""
    n, m = votes.shape
    prior = np.full(m, 0.8) if prior is None else prior
    model = LabelModel(0.5, np.clip(prior, 0.02, 0.98), np.zeros((m, m)))
    for i in range(rounds):
        q = model.posterior(votes)
        for_toxic, for_clean = (votes == 1).astype(float), (votes == -1).astype(float)
        right = q @ for_toxic + (1 - q) @ for_clean
        accuracy = np.clip((right + strength * prior) / (for_toxic.sum(0) + for_clean.sum(0) + strength), 0.02, 0.995)
        balance = float(np.clip((q.sum() + 1) / (n + 2), 0.001, 0.999))
        within = np.zeros((m, m))
        for share in (q, 1 - q):
            mean = share @ votes / max(share.sum(), 1e-9)
            off = (votes - mean) * np.sqrt(share)[:, None]
            within += off.T @ off
        sd = np.sqrt(np.diag(within)) + 1e-9
        correlation = within / np.outer(sd, sd)
        np.fill_diagonal(correlation, 0)
        model = LabelModel(balance, accuracy, correlation)
    return model


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias
        words = set(_words(text.lower())) if text else set()
        w = self.weights
        for f in w.keys() & words:
            z += w[f]
        for f in w.keys() & {"^" + x[:STEM] for x in words if len(x) > STEM}:
            z += w[f]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train_linear(found: list[set[str]], soft: np.ndarray, least_docs: int = 5, most_features: int = 20000, epochs: int = 30, rate: float = 0.3, l2: float = 1e-4, seed: int = 5) -> ToxicityModel:
    """Logistic regression on posterior labels by adaptive stochastic gradient descent.

    Features are those that stand out by a normal test of their mean posterior,
    so that a long text doesn't gather weight from thousands of words that say nothing.
    """
    total, inside = Counter(), Counter()
    for f, y in zip(found, soft):
        inside.update(f)
        for x in f:
            total[x] += y
    mean, n = float(soft.mean()) if len(soft) else 0.0, len(soft)
    spread = max(mean * (1 - mean), 1e-6)
    z = {f: (total[f] - c * mean) / (c * spread) ** 0.5 for f, c in inside.items() if c >= least_docs}
    chosen = sorted((f for f, v in z.items() if v > 4), key=lambda f: (-z[f], f))[:most_features]
    at = {f: i for i, f in enumerate(chosen)}
    rows = [np.array(sorted(at[x] for x in f if x in at), np.int64) for f in found]
    w, b = np.zeros(len(chosen)), float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    seen, seen_b, rng = np.full(len(chosen), 1e-2), 1e-2, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            r = rows[i]
            g = 1 / (1 + np.exp(-np.clip(w[r].sum() + b, -40, 40))) - soft[i]
            gr = g + l2 * w[r]
            seen[r] += gr * gr
            w[r] -= rate * gr / np.sqrt(seen[r])
            seen_b += g * g
            b -= rate * g / seen_b**0.5
    return ToxicityModel({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-4}, b)


def train(texts: list[str], labels: list[int]) -> tuple[ToxicityModel, LabelModel | None]:
    """Voters, label model and classifier from labelled texts; without both classes a constant score."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, -2.0 if not len(y) or y[0] == 0 else 2.0), None
    found = [features(t) for t in texts]
    voters = mine_voters(found, y)
    votes = np.array([[v.vote(t, f) for v in voters] for t, f in zip(texts, found)], np.int8)
    cast, side = votes != 0, np.where(y > 0, 1, -1)[:, None]
    model = fit_label_model(votes, (((votes == side) & cast).sum(0) + 1.6) / (cast.sum(0) + 2))
    return train_linear(found, model.posterior(votes)), model


def fit_toxicity(docs: DataFrame, labels: DataFrame, is_training, rows: int = 8000, row_bytes: int = 65536) -> ToxicityModel:
    """Train on at most about `rows` labelled rows where is_training holds, of at most row_bytes bytes each.

    The rows are chosen by a hash of their id over the whole labels table; of
    several labels for an id the greatest counts. The chosen ids, bounded by
    `rows`, are broadcast to find their texts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").where(is_training)
    chosen = hashed_sample(known, rows, "doc_id").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= row_bytes))
    joined = hashed_sample(texts.join(F.broadcast(chosen), "doc_id"), rows, "doc_id", "text", text="text")
    found = sorted(joined.select("doc_id", "text", "toxic").collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1]))
    return train([r[1] for r in found], [r[2] for r in found])[0]


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_column: str = "text", score_to: str = "score", predicted_to: str = "predicted") -> DataFrame:
    """docs with a score from 0 to 1 and whether it reaches 0.5.

    A null or empty text is scored by the bias alone. Other columns stay;
    those that bear the names of the results are replaced. No shuffle; the
    model, of a bounded number of features, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (score_to, predicted_to)]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column(len(keep)).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*keep, score_to, predicted_to])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_column).cast("string").alias("\x01text")).mapInArrow(run, ", ".join([*fields, f"`{score_to}` double", f"`{predicted_to}` int"]))


def toxicity_digest(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of all docs, by a model of labels that aren't held out."""
    held = F.coalesce(F.pmod(id_crc32(), F.lit(folds)) == held_out_fold, F.lit(False))
    model = fit_toxicity(docs, labels, ~held)
    return score_toxicity(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")
