"""The trained operators against plain computations of what they must give."""

import itertools
import math
import random

import numpy as np

from quernel.llm import language_id, toxicity


def test_posterior_is_as_by_enumeration():
    """Without correlations the posterior is Bayes' rule over both labels; voters that don't vote say nothing."""
    balance, accuracy = 0.3, [0.9, 0.6, 0.75, 0.55]
    model = toxicity.LabelModel(balance, np.array(accuracy), np.zeros((4, 4)))
    votes = list(itertools.product((-1, 0, 1), repeat=4))
    for row, got in zip(votes, model.posterior(np.array(votes))):
        weight = {}
        for label, prior in ((1, balance), (-1, 1 - balance)):
            weight[label] = prior * math.prod(1 if not v else a if v == label else 1 - a for v, a in zip(row, accuracy))
        assert math.isclose(got, weight[1] / (weight[1] + weight[-1]), rel_tol=1e-9)


def test_copies_of_a_voter_count_as_one():
    one = toxicity.LabelModel(0.5, np.array([0.8]), np.zeros((1, 1)))
    peers = np.ones((3, 3)) - np.eye(3)
    three = toxicity.LabelModel(0.5, np.array([0.8] * 3), peers)
    assert np.allclose(one.posterior(np.array([[1], [-1]])), three.posterior(np.array([[1] * 3, [-1] * 3])))


def test_accuracies_are_found_without_labels():
    r = np.random.default_rng(3)
    y = np.where(r.random(6000) < 0.4, 1, -1)
    true = np.array([0.95, 0.85, 0.75, 0.65, 0.9])
    votes = np.stack([np.where(r.random(6000) < a, y, -y) * (r.random(6000) < 0.7) for a in true], 1)
    model = toxicity.fit_label_model(votes)
    assert np.abs(model.accuracy - true).max() < 0.06 and abs(model.balance - 0.4) < 0.06
    assert ((model.posterior(votes) > 0.5) == (y > 0))[(votes != 0).all(1)].mean() > 0.93


def test_toxicity_scores_are_as_a_plain_sum():
    r = random.Random(2)
    weights = {w: r.uniform(-2, 2) for w in ("bad", "good", "ugly", "^ugly", "^goodness"[:5])}
    model = toxicity.ToxicityModel(weights, -0.3)
    for text in ("bad good", "", "UGLYNESS and goodness", "bad " * 300_000 + "uglyness", "other"):
        words = {w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()}
        found = words | {"^" + w[: toxicity.STEM] for w in words if len(w) > toxicity.STEM}
        z = -0.3 + sum(v for k, v in weights.items() if k in found)
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert math.isclose(model.score(None), 1 / (1 + math.exp(0.3)), rel_tol=1e-9)


def test_languages_are_scored_as_from_whole_bags():
    """The scorer that remembers words against the model's own logits; long texts, long words and a small memory change nothing."""
    r = random.Random(8)
    tongues = {"aa": ("ka", "to", "mi"), "bb": ("sch", "rit", "ung"), "cc": ("eau", "oix", "elle")}
    make = lambda l, n: " ".join("".join(r.choice(tongues[l]) for _ in range(r.randint(1, 4))) for _ in range(n))
    langs = ["aa", "bb", "cc"] * 40
    model = language_id.train([make(l, 30) for l in langs], langs)
    texts = [make(l, n) for l in tongues for n in (1, 7, 500)] + ["kato " * 200_000, "x" * 500 + " kato schung", "kato, sch! 12 eau"]
    for kept in (400_000, 3):
        scorer = language_id.Scorer(model, kept)
        for text in texts:
            p = model.probabilities(model.logits(text))
            lang, score = scorer(text)
            assert math.isclose(score, p.max(), rel_tol=1e-4) and p[model.languages.index(lang)] >= p.max() - 1e-6
    assert language_id.Scorer(model)("12 !") == (language_id.UNKNOWN, 0.0)


def test_ties_go_to_the_language_that_sorts_first():
    model = language_id.LanguageModel(["aa", "bb"], np.zeros((64, 2), np.float32), np.zeros(2, np.float32))
    assert language_id.Scorer(model)("kato") == ("aa", 0.5)
