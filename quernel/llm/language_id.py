"""Language identification by averaged subword embeddings and a linear softmax.

A text is the mean of the embeddings of the hashed subwords of its words; a
linear softmax gives the language. Both are trained together by stochastic
gradient descent in numpy. A temperature, fitted on rows held back from
training, calibrates the scores, and the same rows give the score below which
a prediction is rejected.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.chunks import Kept, given_back, held
from quernel.llm.shared import hashed_sample, id_crc32

UNKNOWN = "und"
_words = re.compile(r"[^\W\d_]+").findall


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of the two- and three-letter parts of a word between its ends, and of the word."""
    marked = f"<{word}>"
    parts = [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(p.encode("utf-8", "replace")) % buckets for p in [*parts, marked]]


def bag(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's subwords and their shares."""
    ids = [b for w in _words(text.lower()) for b in subwords(w, buckets)]
    found, n = np.unique(np.array(ids, np.int64), return_counts=True)
    return found, (n / max(1, n.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times output weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        ids, share = bag(text, len(self.table))
        return share @ self.table[ids] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 6, rate: float = 0.5, target: float = 0.97, seed: int = 7) -> LanguageModel:
    """Fit a model; every fifth text is held back for calibration.

    Texts are seen whole and as stretches of a dozen words, so that short
    texts are scored by a model that has met short ones. reject_below is the
    least score at which the held-back stretches and texts that score as much
    are right in `target` of all cases: 0 if they all are, and a half if no score is so good.
    """
    languages = sorted(set(langs))
    n_lang = max(1, len(languages))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, n_lang), np.float32), np.zeros(n_lang, np.float32)
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32))
    fit, held = [], []
    for i, (text, lang) in enumerate(zip(texts, langs)):
        words = text.split()
        at = int(rng.integers(0, max(1, len(words) - 12)))
        for part in (text, " ".join(words[at : at + 12])):
            ids, share = bag(part, buckets)
            if len(ids):
                (held if i % 5 == 4 and len(texts) >= 50 else fit).append((ids, share, languages.index(lang)))
    steps, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            ids, share, y = fit[k]
            x = share @ embed[ids]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - steps / total)
            back = out @ p
            out -= step * np.outer(x, p)
            bias -= step * 0.1 * p
            embed[ids] -= (step * 20) * share[:, None] * back
            steps += 1
    model = LanguageModel(languages, embed @ out, bias)
    if held:
        z = np.array([share @ model.table[ids] + bias for ids, share, _ in held])
        y = np.array([h[2] for h in held])

        def loss(t: float) -> float:
            model.temperature = t
            return -float(np.log(model.probabilities(z)[np.arange(len(y)), y] + 1e-12).mean())

        model.temperature = min((0.25 * 1.25**k for k in range(16)), key=loss)
        p = model.probabilities(z)
        top, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-top)
        precision = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
        good = np.nonzero(precision >= target)[0]
        if not len(good):
            model.reject_below = 0.5
        elif good[-1] + 1 < len(y):
            model.reject_below = float(top[order][good[-1]])
    return model


def fit_language_model(docs: DataFrame, is_training, rows: int = 4000, row_bytes: int = 65536, lang_column: str = "lang", text_column: str = "text", id_column: str = "doc_id") -> LanguageModel:
    """Train on at most about `rows` of the rows where is_training holds and text and language are there.

    The sample is chosen by a hash of id and text over all rows, of 128 MiB of text at most; texts over row_bytes are left out of training only.
    """
    ready = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"), F.col(lang_column).cast("string").alias("l"), is_training.alias("use"))
    ready = ready.where(F.col("use") & F.col("l").isNotNull() & F.col("t").isNotNull() & (F.octet_length("t") <= row_bytes))
    found = sorted(((r["id"], r["t"], r["l"]) for r in hashed_sample(ready, rows, "id", "t", text="t").select("id", "t", "l").collect()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1]))
    return train([r[1] for r in found], [r[2] for r in found])


class Scorer:
    """Scores texts, remembering what each word adds."""

    def __init__(self, model: LanguageModel, most_kept: int = 400_000):
        most_kept = min(most_kept, (64 << 20) // (4 * (len(model.languages) + 1)))  # 64 MiB of sums, however many languages
        self.model, self.rows = model, Kept(most_kept)
        self.sums = np.zeros((most_kept, len(model.languages) + 1), np.float32)

    def _add(self, word: str) -> np.ndarray:
        ids = subwords(word.lower(), len(self.model.table))
        return np.append(self.model.table[ids].sum(0, dtype=np.float64), len(ids)) if any(map(str.isalpha, word)) else np.zeros(len(self.model.languages) + 1)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _words(text or "")
        total = np.zeros(len(self.model.languages) + 1)
        step = min(1 << 16, self.rows.most)
        for at in range(0, len(words), step):  # a very long text in parts
            part = words[at : at + step]
            found = list(map(self.rows.get, part))
            if None in found:
                if len(self.rows) + len(part) > self.rows.most:
                    self.rows.clear()
                    found = [None] * len(part)
                for i, w in enumerate(part):
                    if found[i] is None:
                        if len(w) > 64:
                            total += self._add(w)
                            continue
                        if (row := self.rows.get(w)) is None:
                            row = self.rows[w] = len(self.rows)
                            self.sums[row] = self._add(w)
                        found[i] = row
                found = [x for x in found if x is not None]
            if found:
                total += self.sums[found].sum(0, dtype=np.float64)
        if not total[-1] or not self.model.languages:
            return UNKNOWN, 0.0
        p = self.model.probabilities(total[:-1] / total[-1] + self.model.bias)
        return self.model.languages[int(p.argmax())], float(min(1.0, p.max()))


def identify(docs: DataFrame, model: LanguageModel, text_column: str = "text", lang_to: str = "lang_pred", score_to: str = "score", rejected_to: str = "rejected") -> DataFrame:
    """docs with the predicted language, its calibrated score and whether the prediction is rejected.

    A null text, and one without a letter, gets `und`, score 0 and is rejected;
    so does every text if the model was trained on nothing. Ties go to the
    language that sorts first. All columns of docs stay; columns that bear the
    names of the results are replaced. No shuffle; the model, of buckets x
    languages numbers, is broadcast.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    keep = [c for c in docs.columns if c not in (lang_to, score_to, rejected_to)]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(shared.value))
        for batch in batches:
            found = [scorer(t) for t in batch.column(len(keep)).to_pylist()]
            langs, scores = [f[0] for f in found], [f[1] for f in found]
            rejected = [l == UNKNOWN or s < scorer.model.reject_below for l, s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, lang_to, score_to, rejected_to])
        given_back()

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_column).cast("string").alias("\x01text")).mapInArrow(run, ", ".join([*fields, f"`{lang_to}` string", f"`{score_to}` double", f"`{rejected_to}` boolean"]))


def language_digest(docs: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all docs, by a model of those not held out."""
    held = F.pmod(id_crc32(), F.lit(folds)) == held_out_fold
    held = F.coalesce(held, F.lit(False))
    model = fit_language_model(docs, ~held & F.col("doc_id").isNotNull())
    ready = docs.select("doc_id", "text", held.alias("held_out"))
    return identify(ready, model).select("doc_id", "held_out", "lang_pred", "score")
