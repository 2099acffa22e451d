"""The pipeline's stages, each against a plain version of what it decides."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tests.llm.test_dedup_operators import brute_jaccard, brute_words  # noqa: E402
from tests.llm.test_text_operators import brute_contamination  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=3, n=80):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "to", "mi", "re", "lo", "su") for b in ("n", "rt", "sch", "o", "la", "ve", "zi")]
    passage = " ".join(r.choice(words) for _ in range(60))
    bench = " ".join(r.choice(words) for _ in range(20))
    out = []
    for i in range(n):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 200)))
        if i % 7 == 3:
            t = out[-1][1]
        elif i % 7 == 5:
            w = out[-2][1].split()
            w[len(w) // 2] = "other"
            t = " ".join(w)
        elif i % 11 == 4:
            t += " " + passage
        elif i % 13 == 6:
            t += " " + bench.upper()
        out.append((i, t, "aa", "s", len(t)))
    return [*out, (500, None, "aa", "s", 0), (501, "", None, "s", 0), (502, "12 34", "aa", "s", 5), (503, out[0][1], None, None, None), (3, out[3][1], "aa", "s", 1)], bench


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages(spark, tmp_path):
    data, bench = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    folder = str(tmp_path)
    items = [(1, bench), (2, "short item")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")

    kept = corpus_pipeline.languages(spark, docs, folder)
    assert kept.columns == docs.columns
    want = [(d[0], d[1]) for d in data if d[1] and any(c.isalpha() for c in d[1])]
    assert pairs(kept) == sorted(want, key=repr)

    unique = corpus_pipeline.near_duplicates(spark, kept, folder)
    least = {c for i, _, c in brute_jaccard(want, 5, 80) if i == c}
    assert unique.columns == docs.columns
    assert pairs(unique) == sorted({(i, t) for i, t in want if i in least}, key=repr)
    left = pairs(unique)

    passages = corpus_pipeline.repeated_passages(spark, unique, folder)
    brute = {i: (n, gone, text) for i, n, gone, text in brute_words(left)}
    want = [(i, brute[i][2] if brute[i][1] else t) for i, t in left if brute[i][1] < brute[i][0] or not brute[i][1]]
    assert passages.columns == docs.columns and pairs(passages) == sorted(want, key=repr)
    assert any(b[1] for b in brute.values())

    clean = corpus_pipeline.benchmark_leaks(spark, passages, folder)
    bad = {x[0] for x in brute_contamination(want, items) if x[-1]}
    assert bad and clean.columns == docs.columns and pairs(clean) == sorted(((i, t) for i, t in want if i not in bad), key=repr)

    out = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in pairs(clean))
    assert all(r["n_tokens"] > 0 for r in out.collect())


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_near_duplicates", "substring_dedup", "decontamination", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
