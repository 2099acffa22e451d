"""Line rules, clusters and hard negatives: against plain computation, and edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import centroid_clustering, hard_negatives, line_cleaning
from quernel.llm.centroid_clustering import Bounds, Centroids

# Line rules


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [l for l in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def texts(seed):
    r = random.Random(seed)
    words = ["the", "river", "ß", "日本", "a#b", "x|y", "end.", "why?", " ", "<b>"]
    return ["".join(r.choice(words) + r.choice([" ", " ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(r.randint(0, 150))) for _ in range(40)]


def test_counts_are_as_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([*texts(1), None, "", " \n\t\n", "a b a b a b", "long " * 30000])]
    got = {r["doc_id"]: r for r in line_cleaning.quality_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, chars, symbols, dup, repeat = base_of(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["kept"] and r["base_failed"])


PROSE = "The river runs along the old stone wall and nobody knows since when it does so."
LINES = {
    PROSE: 0, "Of.": 0, "He asked: “Why?”": 0, " ".join(f"word{i}" for i in range(30)) + ". and so on without an end": 0,
    "Home | About | Contact": 1, "Home About us Contact": 1, "Next": 1, "Start » News » Town » Page": 1,
    "© Copyright 2020 by the town, all rights reserved.": 2, "This site uses cookies to know you better.": 2,
    "A heading without an end": 3, "BUY!! NOW!! IT!! IS!! CHEAP!!": 3, "it### is*** a%%% very&&& noisy$$$ line###.": 3,
}


@pytest.mark.parametrize("line", LINES)
def test_lines(line):
    assert line_cleaning.Cleaner(line_cleaning.LineRules()).line(line, len(line.split())) == LINES[line]


def test_long_lines_aren_t_boilerplate():
    assert line_cleaning.Cleaner(line_cleaning.LineRules()).line(f"{PROSE} " * 5 + "All rights reserved.", 83) == 0


def test_cleaned_lines(spark):
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(8))
    rows = [(1, f"Home | About | Contact\n\n{good}\nAll rights reserved.", "k"), (2, "\n".join([f"no end here at all {i}" for i in range(3)] + [good[:90] + "."] + [f"nor is there one here {i} and {i}" for i in range(60)]), None), (3, None, "x"), (4, "", "x"), (1, good, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = line_cleaning.cleaned_lines(df)
    assert found.columns[:2] == ["doc_id", "text"] and found.columns.count("kept") == 1
    got = found.collect()
    assert len(got) == 5
    first = next(r for r in got if r["doc_id"] == 1 and r["text"].startswith("Home"))
    assert first["kept"] and first["cleaned"] == f"\n{good}" and (first["n_navigation"], first["n_boilerplate"]) == (1, 1)
    assert first["lost_chars"] == len("Home|About|Contact") + len("Allrightsreserved.")
    by_id = {r["doc_id"]: r for r in got}
    assert not by_id[2]["kept"] and by_id[2]["n_punctuation"] == 63
    assert by_id[3]["cleaned"] is None and by_id[4]["cleaned"] == "" and not by_id[3]["kept"]
    assert line_cleaning.cleaned_lines(df.limit(0)).count() == 0


# Clusters


def plain_kmeans(rows, k, rounds, dim, scale, seed_text):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centres = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed_text}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), a in zip(kept, at) if a == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, *nearest(x)[::-1]) for i, x in kept]
    per = {}
    for _, j, d in out:
        per[j] = per.get(j, 0) + d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in out), key=repr)


def vectors(seed, n, dim, coarse):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    v = centres[r.integers(0, 6, n)] + 0.3 * r.normal(size=(n, dim))
    return np.round(v * coarse) / coarse


@pytest.mark.parametrize("coarse,scale,k", [(1000, 1024, 8), (1, 1, 5), (2, 2, 13)])
def test_clusters_are_as_plain_kmeans(spark, monkeypatch, coarse, scale, k):
    """Coarse vectors have many ties."""
    monkeypatch.setattr(centroid_clustering, "BLOCK_ROWS", 50)
    dim = 6
    rows = [(i * 7 - 30, v) for i, v in enumerate(vectors(k, 300, dim, coarse).tolist())]
    rows += [(5, [0.5] * dim), (5, [0.5] * dim), (None, [0.25] * dim), (900, None), (901, [1.0] * (dim - 1)), (902, [1.0] * (dim - 1) + [None]), (903, [float("nan")] * dim), (904, [float("inf")] + [0.0] * (dim - 1)), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = centroid_clustering.elkan(df, k, 4, "3:", dim, scale).drop("computed").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_kmeans(rows, k, 4, dim, scale, "3:")


def test_fewer_vectors_than_clusters(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroid_clustering.elkan(df, 8, 3, "3:", 2, 10).drop("computed").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_kmeans(rows[:2], 8, 3, 2, 10, "3:")
    assert centroid_clustering.elkan(df.limit(0), 8, 3, "3:", 2, 10).count() == 0


def test_bounds_hold_and_save_work():
    x = np.floor(vectors(3, 4000, 16, 1e6) * 1024).astype(np.int64)
    now, before = x[:8].copy(), None
    b, computed = Bounds(x, 8), []
    for _ in range(8):
        c = Centroids(now, before)
        b.computed = 0
        b.step(c)
        computed.append(b.computed)
        d = ((x[:, None, :] - now[None]) ** 2).sum(2)
        assert (b.at == d.argmin(1)).all()
        assert (b.upper >= np.sqrt(d[np.arange(len(x)), b.at])).all() and (b.lower <= np.sqrt(d)).all()
        before, now = now, np.array([x[b.at == j].sum(0) // max(1, (b.at == j).sum()) if (b.at == j).any() else now[j] for j in range(8)])
    assert computed[-1] < len(x) * 8 / 4


# Hard negatives


def plain_negatives(rows, divisor, positives, negatives, low, high, scale):
    sound = {(i, l, tuple(math.floor(scale * float(x)) for x in v)) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, x in (r for r in sound if r[0] % divisor == 0):
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in sound if j != i), key=lambda r: r[:2])
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, p, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("coarse,low,broadcast", [(100, 80, 1 << 20), (1, 60, 0), (1, 100, 1 << 20)])
def test_negatives_are_as_brute_force(spark, coarse, low, broadcast):
    r = np.random.default_rng(coarse + low)
    rows = [(i, int(r.integers(0, 3)), v) for i, v in enumerate(vectors(low, 160, 10, coarse).tolist())]
    rows += [rows[0], rows[7], (0, 1, [3.0] * 10), (500, None, [1.0] * 10), (None, 1, [1.0] * 10), (505, 1, None), (510, 1, [float("nan")] * 10), (515, 1, [None] * 10), (520, 2, [1.0] * 4), (525, 0, []), (530, 9, [1.0] * 13)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, 3, 4, low, 100, 16, rows_per_block=30, anchors_per_block=7, chunk=4, broadcast_bytes=broadcast)
    assert sorted(tuple(x) for x in got.collect()) == plain_negatives(rows, 5, 3, 4, low, 100, 16)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1e300])], "vec_id long, label int, embedding array<double>")
    for some in (df, df.limit(0)):
        got = hard_negatives.negatives_digest(some)
        assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_products_are_exact():
    r = np.random.default_rng(0)
    for most in (100, 1 << 20, 1 << 28):
        a, b = r.integers(-most, most, (5, 32)), r.integers(-most, most, (7, 32))
        assert (hard_negatives.product(a, b) == np.array([[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a])).all()
        assert (hard_negatives.widened(hard_negatives.narrow(a), 32) == a).all()
