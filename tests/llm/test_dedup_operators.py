"""Suffix arrays, substring dedup, Jaccard join and embeddings: against brute force, and edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import embedding_dedup, jaccard_join, substring_dedup, suffix_dedup
from quernel.llm.components import components
from quernel.llm.exchange import Deal, Texts, pack, pack_sorted, unpack, unpack_sorted

SCHEMA = "doc_id long, text string, kept string, n_words string"


def corpus(seed, n=60):
    """Texts of few words with copies, near copies, shared passages and odd cases."""
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "añ", "ß", "日本", "river", "stone", "x", "and", "hill", "lake", "in"])
    passage = " ".join(word() for _ in range(40))
    texts = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and texts:
            t = r.choice(texts)
        elif kind < 0.4 and texts and (w := r.choice(texts).split()):
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        else:
            t = r.choice([" ", "\n", "  \t"]).join(word() for _ in range(r.randint(0, 120)))
            if kind > 0.8:
                t = f"{t} {passage} {word()}"
        texts.append(t)
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, (1000, None), (1001, ""), (None, passage), (None, None), (1002, "  \n"), (5000, passage), (5000, passage), (5000, "other " + passage), (7000, "a" * 300), (7001, "a" * 300)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def brute_bytes(rows, n=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    owner = {}
    for i, b in data:
        if i is not None:
            for k in range(len(b) - n + 1):
                owner[b[k : k + n]] = min(owner.get(b[k : k + n], i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1) if i is not None else ():
            if owner[b[k : k + n]] < i:
                gone[k : k + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "group", "shard"), [(1, 1 << 20, 1 << 20), (2, 3000, 2000), (3, 1500, 300)])
def test_suffix_dedup_is_as_brute_force(spark, seed, group, shard):
    rows = corpus(seed)
    found = suffix_dedup.repeated_bytes(frame(spark, rows), group_bytes=group, shard_bytes=shard)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found.collect()]
    assert sorted(got, key=repr) == brute_bytes(rows)


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for n, letters in ((1, 2), (50, 2), (400, 3), (700, 1)):
        t = r.integers(0, letters, n).astype(np.uint8)
        b = t.tobytes()
        want = sorted(range(n), key=lambda i: b[i:])
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == want
        shared = lambda i, j: next((k for k in range(n) if i + k >= n or j + k >= n or b[i + k] != b[j + k]), n)
        lcp = [0, *(min(60, shared(i, j)) for i, j in zip(want, want[1:]))]
        assert suffix_dedup.common_prefixes(t, sa, 60, lane=32).tolist() == lcp


def test_groups_of_large_tables_grow(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('a', 136) text")  # 600,000 bytes with what a row counts
    assert [Deal.of(docs, "text", 1000, most).groups for most in (None, 2000, 10_000)] == [600, 300, 256]
    assert Deal.of(docs.limit(500), "text", 1000, 10_000).groups == 100


@pytest.mark.parametrize(("length", "part"), [(50, 24), (12, 12), (9, 4)])
def test_strings_at_anchors_find_their_least_id(length, part):
    r = np.random.default_rng(length)
    words = [r.integers(0, 256, k).astype(np.uint8) for k in (length, length + 5, 3 * length)] + [np.zeros(2 * length, np.uint8), np.full(2 * length, 255, np.uint8)]
    texts = []
    for _ in range(60):
        texts.append(np.concatenate([x for i in r.integers(0, len(words), 4) for x in (words[i], r.integers(0, 3, r.integers(0, 4)).astype(np.uint8))]))
    texts[0] = texts[1] = texts[30] = texts[31] = texts[0][:0]  # nothing, and less than a string, between others
    texts[2], texts[32] = texts[2][: length - 1], texts[32][:length]
    offsets = np.cumsum([0, *map(len, texts)])
    docs = Texts(np.concatenate(texts), offsets, r.permutation(60) - 20, np.arange(60) != 7)
    start, count, doc, place, anchor, stretch = suffix_dedup.blocks(docs, length, part)
    size = count.astype(np.int64) + length - 1
    strings = [(int(docs.ids[d]), docs.data[i : i + length].tobytes()) for s, c, d in zip(start, count, doc) for i in range(s, s + c)]
    assert sorted(strings) == sorted((int(i), t[k : k + length].tobytes()) for i, t, known in zip(docs.ids, texts, docs.known) if known for k in range(len(t) - length + 1))
    least = {}
    for i, t in strings:
        least[t] = min(least.get(t, i), i)
    owner = suffix_dedup.anchored_owners(docs.data, start, size, place.astype(np.int64), docs.ids[doc], length, part)
    assert owner.tolist() == [least[t] for _, t in strings]


def brute_words(rows, n=13):
    data = [(i, (t or "").encode().split()) for i, t in rows]
    owner = {}
    for i, w in data:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                owner[key] = min(owner.get(key, i), i)
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1) if i is not None else ():
            if owner[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "group"), [(1, 1 << 20), (2, 3000), (3, 1500)])
def test_substring_dedup_is_as_brute_force(spark, seed, group):
    rows = corpus(seed)
    found = substring_dedup.repeated_words(frame(spark, rows), group_bytes=group)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr) == brute_words(rows)


def test_dedup_of_nothing(spark):
    empty = frame(spark, corpus(1)).limit(0)
    assert suffix_dedup.repeats_digest(empty).count() == 0
    assert substring_dedup.repeats_digest(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0


def brute_components(nodes, linked):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def brute_jaccard(rows, n, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = (t or "").translate(fold).encode().split()
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    links = [(k, j) for k, (a, x) in enumerate(sets) for j, (b, y) in enumerate(sets[:k]) if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    root, least = brute_components(range(len(sets)), links), {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return sorted(((i, len(s), least[root[k]] if i is not None else None) for k, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("seed", "n", "percent", "together", "broadcast"), [(1, 4, 85, 1000, 500_000), (2, 5, 80, 3, 0), (3, 2, 60, 2, 500_000), (4, 1, 50, 1000, 0)])
def test_jaccard_is_as_brute_force(spark, seed, n, percent, together, broadcast):
    rows = corpus(seed, 120)
    assert any(r[0] == 5000 and r[1].startswith("other ") for r in rows)
    got = jaccard_join.jaccard_components(frame(spark, rows), n, percent, most_together=together, broadcast_rows=broadcast)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_jaccard(rows, n, percent)


def test_short_sets_meet(spark):
    rows = [(i, " ".join(random.Random(i // 2).sample("abcdefghijklmnopqrstuvwxyz", 8)) + (" z" if i % 2 else "")) for i in range(300)]
    got = jaccard_join.jaccard_components(frame(spark, rows), 1, 85)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_jaccard(rows, 1, 85)


def test_count_tree_lets_every_link_through():
    r = np.random.default_rng(3)
    p = r.integers(0, 6, (300, 8)).astype(np.int32)
    tree = jaccard_join.CountTree(p)
    for i in range(300):
        bound = np.minimum(p[i], p).sum(1)
        want = set(np.nonzero(185 * bound >= 85 * (p[i].sum() + p.sum(1)))[0].tolist())
        assert set(tree.search(p[i], 85).tolist()) == want


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("together", [2048, 8])
def test_embeddings_are_as_brute_force(spark, together):
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 24))
    rows = []
    for i in range(240):
        v = base[i % 12] * r.uniform(0.5, 2) + r.normal(size=24) * r.choice([0.02, 0.1, 0.2, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 0), (304, [0.0] * 24, 0), (305, [float("nan")] * 24, 0), (306, [None] * 24, 0), (307, [float("inf")] + [1.0] * 23, 0), (308, [], 0), (309, [1.0, 2.0], 0), (310, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    got = {x["vec_id"]: tuple(x)[1:] for x in embedding_dedup.near_vectors(spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<float>, label int, kept string"), most_together=together).collect()}
    good = [(i, np.array(v), l) for i, v, l in rows if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for k, (a, x, l) in enumerate(good) for b, y, m in good[:k] if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    ids = [x[0] for x in rows if x[0] is not None]
    root = brute_components(ids, links)
    count = {i: sum(i in e for e in links) for i in ids}
    assert {i: got[i] for i in ids} == {i: (count[i], root[i], root[i] == i) for i in ids}
    assert got[None][0] == 0 and len(links) > 200


def test_embeddings_of_odd_labels_and_sizes(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [2.0], "a,1.0"), (3, [1e200, 1e200], "b"), (4, [2e200, 2e200], "b"), (5, [1e-310, 1e-310], "b"), (6, [1e-200, 1e-200], "c"), (7, [1e200, 3e200], "c"), (8, [1e-200, 3e-200], "c"), (9, [1.0, 2.0], "a"), (10, [1.0, 2.0], ""), (11, [1.0, 2.0], ",")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (1, 1), 10: (0, 10), 11: (0, 11)}


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(9)
    x = r.normal(size=(400, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = unit + r.normal(size=unit.shape) * 0.02
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = embedding_dedup.Codes(unit), embedding_dedup.Codes(y)
    true = np.einsum("ij,ij->i", unit, y)
    upper = np.diag(a.upper(slice(0, 400), slice(0, 400), b))
    assert (upper >= true).all() and abs((upper - a.spread - true).mean()) < 0.02
    assert a.likely(slice(0, 400), 0.98).shape == (400, 400)


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_stored_codes_give_the_same_bounds(dim):
    """Bits counted from what is stored, against the product of signs and form."""
    x = np.random.default_rng(dim).normal(size=(30, dim))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes = embedding_dedup.Codes(unit)
    rows = codes.packed()
    assert {len(r) for r in rows} == {12 + 8 * -(-dim // 64) * (1 + embedding_dedup.QUERY_BITS)}
    back = embedding_dedup.Codes.unpacked(rows, dim)
    every = slice(0, 30)
    assert np.allclose(codes.upper(every, every, codes), back.upper(every, every, back), atol=1e-6)
    z = unit @ embedding_dedup.rotation(dim, 77)
    step = np.maximum((z.max(1) - z.min(1)) / 15, 1e-30)
    form = z.min(1)[:, None] + step[:, None] * np.rint((z - z.min(1)[:, None]) / step[:, None])
    signs = np.where(z > 0, 1, -1) / np.sqrt(dim)
    plain = signs @ form.T / np.einsum("ij,ij->i", signs, z)[:, None]
    assert np.allclose(back.upper(every, every, back) - back.spread[:, None], plain, atol=1e-4)


def test_packing():
    for v in ([], [0], [1, 2, 2, 1 << 63], list(range(0, 1000, 7))):
        a = np.array(v, np.uint64)
        assert unpack(pack(a)).tolist() == v and unpack_sorted(pack_sorted(np.sort(a))).tolist() == sorted(v)


def test_no_cross_join_in_plans(spark):
    plan = substring_dedup.repeated_words(frame(spark, corpus(1)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert F is not None


def test_hot_groups_are_dealt_into_bounded_tasks(spark, monkeypatch):
    kind, dealt = type(spark.range(1)), []
    group = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *c: (dealt.append(self) if c == ("bin",) else None, group(self, *c))[1])
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(400)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, most_together=20).collect()
    assert {x["component_id"] for x in got} == {0}
    vectors = [(i, [1.0 + r.random() / 100 for _ in range(8)], 0) for i in range(3000)]
    embedding_dedup.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"), most_together=100)
    assert len(dealt) == 3
    texts, codes, fetched = (group(d, "bin").count().agg({"count": "max"}).first()[0] for d in dealt)
    assert texts < 1000 and codes < 20_000 and fetched < 20_000, (texts, codes, fetched)
