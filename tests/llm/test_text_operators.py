"""Token output, BPE, toxicity, decontamination, licences, languages: against libraries and brute force, and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quernel.llm import bpe, decontaminate, language_id, license_scan, token_output, toxicity  # noqa: E402
from quernel.llm.shared import new_folder  # noqa: E402

ODD = ["a", "  ", "\n", " \n ", "é", "ß", "1", "'s", "!", "\t", "x y", "　", "the", "\x1c ", " ", "日本", "\x00", "😀", "\r\n", "word,", "Zoë."]
SCHEMA = "doc_id long, text string, n_tokens string, words string"
DOCS = [(3, "the the end. The\nend"), (1, ""), (None, "no id"), (2, None), (3, "the the end. The\nend"), (9, "x" * 5000), (-4, "  odd  spaces \n\n")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def test_bpe_is_as_tiktoken(encoder, tiktoken_encoding):
    for t in odd_texts(2000):
        assert encoder.encode(t) == tiktoken_encoding.encode_ordinary(t)
        assert encoder.decode(encoder.encode(t)) == t.encode()


def test_bpe_append_and_edit_are_as_if_encoded_at_once(encoder):
    r, v = random.Random(2), encoder.vocabulary
    for _ in range(200):
        data = bytes(r.choice(b"abcdehlorst") for _ in range(r.randint(1, 30)))
        cut = r.randint(0, len(data))
        e = bpe.PrefixEncoder(v).append(data[:cut]).append(data[cut:])
        assert e.tokens() == v.merged(data)
        assert e.tokens(cut) == v.merged(data[:cut])
        a, b = sorted((r.randint(0, len(data)), r.randint(0, len(data))))
        e.replace(a, b, b"xyz")
        assert e.tokens() == v.merged(data[:a] + b"xyz" + data[b:])


def test_pieces_that_share_an_opening_are_merged_as_by_rank():
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    e = bpe.Encoder(bpe.Vocabulary.from_file(path), pattern, most_kept=6)
    words = [" " + a + b for a in ("interna", "interns", "unbekan", "qzxwvkj", "día", "ä") for b in ("", "l", "lization", "tenzqx", "ntes", "ñandúes", "xxxxxxxxxx")]
    for w in [*words, *words[::-1]]:
        assert e.piece(w) == e.vocabulary.merged(w.encode()), w


def test_bpe_digest_rows(spark, tiktoken_encoding):
    rows = bpe.bpe_digest(docs(spark), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = []
    for i, t in DOCS:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.bpe_digest(docs(spark).limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_token_encoder_is_as_the_library():
    e = token_output.text_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in odd_texts(2000, 5):
        assert np.frombuffer(e.serialized(t, (0,)), f"<u{e.width}").tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_token_shards_round_trip(spark):
    folder, path = new_folder(spark, "t"), public_tokenizers.path("byte_bpe_50k.json")
    df = docs(spark, [d for d in DOCS if d[0] is not None] + [(100 + i, f"text {i} " * 40) for i in range(40)] + [(None, "last")])
    manifest = token_output.write_token_shards(df, folder, path, 0, shard_text_bytes=2000, dictionary_rows=30)
    assert manifest.count() > 1
    got = token_output.read_token_shards(token_output.with_starts(manifest, per_block=2), folder).collect()
    tok = token_output.text_encoder(path).tokenizer
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    ids = {id(r): [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    start, want = 0, []
    for r in [*known, *(r for r in rows if r[0] is None)]:
        want.append((r[0], start, len(ids[id(r)]), zlib.crc32(np.array(ids[id(r)], "<u4").tobytes())))
        start += len(ids[id(r)])
    assert sorted((tuple(r)[:4] for r in got), key=lambda x: x[1]) == want
    shard = manifest.orderBy("first_id").first()
    dictionary = next(token_output.get_file(p) for p in [f"{folder}/{h}" for h in _names(folder) if h.endswith(".dict")])
    reader = token_output.ShardReader(shard["path"], dictionary)
    assert len(reader) == shard["n_docs"] and sum(len(reader.document(i)) for i in range(len(reader))) == shard["n_tokens"]
    with pytest.raises(ValueError, match="another dictionary"):
        token_output.ShardReader(shard["path"], b"other")
    token_output.put_file(f"{folder}/{'0' * 64}.dict", b"of another write into this folder")
    again = token_output.read_token_shards(token_output.with_starts(manifest), folder).collect()
    assert sorted((tuple(r)[:4] for r in again), key=lambda x: x[1]) == want


def _names(folder):
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(folder)
    return [f.base_name for f in fs.get_file_info(pafs.FileSelector(inner))]


def test_token_digest_of_nothing(spark):
    assert token_output.token_digest(docs(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# Decontamination


def brute_contamination(rows, items, n=10):
    find, fold = re.compile(decontaminate.WORD).findall, str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
    words = lambda t: find((t or "").translate(fold))
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            k = min(n, len(w))
            for a in range(len(w) - k + 1):
                windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if own := windows.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (10, "alpha BETA"), (2, ""), (None, "alpha"), (3, None), (11, "Ünï cödé")]
TAINTED = [(1, "x one two three four five six seven eight nine ten, eleven y"), (2, "one two three four"), (3, "ALPHA beta alpha-beta"), (4, None), (5, ""), (None, "alpha beta"), (6, "ünï cödé ünï"), (6, "ünï cödé ünï"), (6, "other"), (7, "w " * 3000 + "alpha beta")]


@pytest.mark.parametrize("most", [200_000, 0])
def test_contamination_is_as_brute_force(spark, most):
    d = docs(spark, TAINTED).withColumnRenamed("words", "hits")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(d.select("doc_id", "text", "hits"), b, broadcast_rows=most, broadcast_hits=most)
    got = [(r["doc_id"], r["n_words"], len(r["hits"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["hits"])) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(brute_contamination(TAINTED, ITEMS), key=repr)


def test_decontaminated(spark):
    d, b = docs(spark, TAINTED), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminated(d, b)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 6, 6] and kept.columns == d.columns
    spans = {r["text"] for r in decontaminate.decontaminated(d, b, remove="spans").collect()}
    assert "x y" in spans and "one two three four" in spans and None in spans
    assert decontaminate.decontaminated(d, b.limit(0)).count() == len(TAINTED)
    assert decontaminate.contamination_digest(d.limit(0), b).count() == 0


# Languages


def tongue(lang, r, n):
    parts = {"aa": ["ka", "to", "mi"], "bb": ["schn", "ür", "elt"], "cc": ["ção", "lho", "en"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(n))


def test_language_id(spark):
    r = random.Random(4)
    rows = [(i, tongue(l, r, r.randint(3, 40)), l) for i, l in enumerate(["aa", "bb", "cc"] * 80)]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", "cc"), (903, "kato", None), (None, "kato mito", "aa")]
    d = spark.createDataFrame([(*x, 5.0) for x in rows], "doc_id long, text string, lang string, score double")
    got = {x["doc_id"]: x for x in language_id.language_digest(d).collect()}
    assert len(got) == len(rows)
    held = [(got[i], l) for i, t, l in rows if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(x["held_out"] for x, _ in held) and np.mean([x["lang_pred"] == l for x, l in held]) >= 0.97
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[900]["score"] == 0
    assert all(0 <= x["score"] <= 1 for x in got.values())
    none = language_id.language_digest(d.where("lang is null"))
    assert [x["lang_pred"] for x in none.collect()] == ["und"]
    assert language_id.language_digest(d.limit(0)).count() == 0


def test_rejection_keeps_what_is_told_well():
    r = random.Random(8)
    texts, langs = zip(*[(tongue(l, r, 20), l) for l in ["aa", "bb"] * 100])
    assert language_id.train(list(texts), list(langs)).reject_below == 0.0
    mixed = language_id.train([tongue("aa", r, 20) for _ in range(200)], [r.choice(["aa", "bb"]) for _ in range(200)])
    assert mixed.reject_below > 0


# Toxicity


def toxic_tables(spark, n=400):
    r, common, bad = random.Random(6), [f"w{i}" for i in range(200)], ["idiotic", "scummy", "moronish", "lowly"]
    rows, labels = [], []
    for i in range(n):
        t = i % 8 == 0
        words = [r.choice(common) for _ in range(r.randint(5, 60))] + ([r.choice(bad) for _ in range(3)] if t else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(t)))
    rows += [(n, None), (n + 1, ""), (None, "idiotic")]
    labels += [(n, 1, None), (None, 1, 1), (0, 1, 0)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: int(i % 8 == 0) for i in range(n)}


def test_toxicity(spark):
    d, labels, want = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity_digest(d, labels).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [i for i in want if got[i]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["held_out"] for i in want)
    assert np.mean([got[i]["predicted"] == want[i] for i in held]) >= 0.97
    assert got[400]["score"] == got[401]["score"] < 0.5
    assert toxicity.toxicity_digest(d, labels.limit(0)).agg({"predicted": "max"}).first()[0] == 0
    assert toxicity.toxicity_digest(d.limit(0), labels).count() == 0


def test_label_model_discounts_copies_and_finds_accuracies():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.4
    vote = lambda acc, cover: np.where(r.random(4000) < cover, np.where(r.random(4000) < acc, 1, -1) * np.where(y, 1, -1), 0)
    good, poor = vote(0.9, 0.7), vote(0.6, 0.7)
    votes = np.stack([good, vote(0.85, 0.7), vote(0.8, 0.7), poor, poor, poor], 1)
    m = toxicity.fit_label_model(votes)
    assert m.accuracy[0] > 0.8 > m.accuracy[3] and m.correlation[3, 4] > 0.9 > m.correlation[0, 1]
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.85


# Licences


def test_license_scan(spark):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text."), (2, "Released under the MIT licence, so be it."), (3, "The license of a driver was lost."),
        (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 2."), (7, "LICENSED UNDER CC BY-NC 4.0."), (8, "Licensed under CC BY-ND 4.0.\n\nReleased under the MIT License."),
        (8, "Licensed under CC BY-ND 4.0.\n\nReleased under the MIT License."), (None, "Released under the MIT License."), (9, "word " * 4000 + "Released under the MIT License. " + "word " * 4000),
    ]
    d = docs(spark, rows)
    got = {r["doc_id"]: (r["n_blocks"], r["licenses"]) for r in license_scan.license_digest(d).collect()}
    assert got[1] == (1, "Apache-2.0") and got[6] == (1, "GPL-2.0") and got[7] == (1, "CC-BY-NC-4.0")
    assert got[8] == (4, "CC-BY-ND-4.0,MIT") and got[None] == (1, "MIT")
    assert got[3] == got[4] == got[5] == (0, "") and license_scan.license_digest(d.limit(0)).count() == 0
    blocks = license_scan.license_blocks(d.where("doc_id = 1")).collect()
    assert blocks[0]["block"] == "Licensed under the Apache License, Version 2.0." and blocks[0]["lacking"] == ""


def test_license_ranking_is_by_saved_size():
    s = license_scan.LicenseScanner()
    for i, (_, t) in enumerate(s.templates):
        assert s.savings(t)[0][1] == i
    assert s.scan("Released under the BSD 2-Clause License.")[0][0] == "BSD-2-Clause"


def test_license_notices_inside_prose():
    s, prose = license_scan.LicenseScanner(), "The old mill stood by the river for as long as anyone in the village could remember. "
    for n in (1, 2, 40):
        text = prose * n + "Released under the MIT License. " + prose * n
        assert [(h[0], text[h[5] : h[6]]) for h in s.scan(text)] == [("MIT", "Released under the MIT License.")]
    both = prose + "Released under the MIT License. " + prose + "Licensed under CC BY-ND 4.0. " + prose + "Released under the MIT License."
    assert [h[0] for h in s.scan(both)] == ["MIT", "CC-BY-ND-4.0", "MIT"]
    assert s.scan(prose + "A license was lost. " + prose) == []


def test_license_notices_wrapped_over_lines():
    s = license_scan.LicenseScanner()
    isc = "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, version 2.0."
    for name, text in (("ISC", isc), ("BSD-3-Clause", bsd), ("MPL-2.0", mpl), ("GPL-3.0", "This work is licensed under the\nGNU General Public\nLicense, version 3.")):
        for mark in ("", "# ", " * ", "// "):
            source = "int x;\n" + "".join(f"{mark}{line}\n" for line in text.split("\n")) + "int y;\n"
            assert [h[0] for h in s.scan(source)] == [name], (name, mark)
    long = "Released\n" + "\n" * 5000 + "under the MIT License.\n" + "x" * 100_000 + "\nLicensed under\nCC\nBY-ND 4.0."
    assert [h[0] for h in s.scan(long)] == ["MIT", "CC-BY-ND-4.0"]
    several = "Released under the MIT\nLicense. " + "word\n" * 300 + "Released into the public\ndomain under CC0 1.0."
    assert [h[0] for h in s.scan(several)] == ["MIT", "CC0-1.0"]


MIT_TEXT = """MIT License

Copyright (c) 2021 A. Nother

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL_HEADER = """This {0} is free software{1} you can redistribute it and/or modify
it under the terms of the GNU {2}General Public License as published by
the Free Software Foundation{1} either version {3} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {2}General Public License for more details.
"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{0}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
THIRD = """3. Neither the name of Example Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{0}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_license_scan_of_real_notices(mark):
    s = license_scan.LicenseScanner()
    cases = [
        ("MIT", MIT_TEXT), ("Apache-2.0", APACHE_HEADER), ("MPL-2.0", MPL_HEADER), ("GPL-3.0", GPL_HEADER.format("program", ":", "", "3")), ("GPL-2.0", GPL_HEADER.format("library", ";", "", "2")),
        ("LGPL-2.1", GPL_HEADER.format("library", ";", "Lesser ", "2.1")), ("LGPL-3.0", GPL_HEADER.format("library", ":", "Lesser ", "3")), ("AGPL-3.0", GPL_HEADER.format("program", ":", "Affero ", "3")),
        ("BSD-2-Clause", BSD_TEXT.format("")), ("BSD-3-Clause", BSD_TEXT.format(THIRD)), ("ISC", ISC_TEXT.format(", provided that the above\ncopyright notice and this permission notice appear in all copies")), ("0BSD", ISC_TEXT.format("")),
        ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License."), ("CC-BY-3.0", "Licensed under CC-BY 3.0"), ("GPL-3.0", "Licensed under the GNU GPLv3"),
        ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007"), ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"),
    ]
    for name, text in cases:
        source = "int x;\n" + "".join(f"{mark}{line}\n" for line in text.split("\n")) + "int y;\n"
        assert [h[0] for h in s.scan(source)] == [name], (name, text)


def test_license_scan_of_expressions_and_near_misses():
    s = license_scan.LicenseScanner()
    assert [h[0] for h in s.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;")] == ["MIT", "Apache-2.0"]
    none = ["SPDX-License-Identifier: MIT-0", "GNU Lesser General Public License as published", "The license of an MIT professor was lost.", "Licensed under CC BY-XY 9.0.", "Released under the Foo License."]
    assert [s.scan(t) for t in none] == [[]] * len(none)


def test_license_recall_on_planted_notices():
    """Notices of every template inside prose, wrapped with marks, and with a word changed that tells nothing apart: nine in ten at least are found, taken back ones never."""
    r, s = random.Random(5), license_scan.LicenseScanner()
    prose = "The old mill stood by the river for as long as anyone in the village could remember. "
    ways, found = {"plain": 0, "wrapped": 0, "altered": 0}, {"plain": 0, "wrapped": 0, "altered": 0}
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        words, mark, width = text.split(), r.choice(["# ", " * ", "// "]), r.randint(3, 12)
        wrapped = "".join(f"{mark}{' '.join(words[k : k + width])}\n" for k in range(0, len(words), width))
        variants = {"plain": prose * 3 + text + " " + prose, "wrapped": "int x;\n" + wrapped + "int y;\n"} if "SPDX" not in text else {"plain": prose + "\n" + text + "\n" + prose}
        loose = [k for k, w in enumerate(words) if license_scan.words(w) and not s.must[i].intersection(license_scan.words(w))]
        if len(words) >= 12 and loose[1:-1]:
            variants["altered"] = prose + " ".join(w for k, w in enumerate(words) if k != loose[1:-1][len(loose[1:-1]) // 2]) + " " + prose
        for way, planted in variants.items():
            ways[way] += 1
            found[way] += name in [h[0] for h in s.scan(planted)]
        denied = f"{prose}It is not {text[0].lower()}{text[1:]} {prose}"
        assert "SPDX" in text or len(text.split()) > 12 or not s.scan(denied), text
    assert all(found[w] >= 0.9 * ways[w] for w in ways) and ways["altered"] > 20, (found, ways)


def test_license_ranks_and_pieces():
    """The hits carry their rank; a block of many words is ranked in pieces and loses nothing at their edges."""
    s = license_scan.LicenseScanner()
    text = " ".join(["license"] * (license_scan.MOST_WORDS - 3)) + " Released under the MIT License. " + " ".join(["license"] * license_scan.MOST_WORDS) + " Licensed under CC BY-ND 4.0."
    assert [(h[0], h[7] >= 0) for h in s.scan(text)] == [("MIT", True), ("CC-BY-ND-4.0", True)]
    for text, want in (("Licensed under GPLv3", "GPL-3.0"), ("licensed under Apache 2.0.", "Apache-2.0"), ("# MIT License\n\nCopyright", "MIT"), ('{"license": "MIT"}', "MIT"), ("license = 'BSD-3-Clause'", "BSD-3-Clause")):
        assert [h[0] for h in s.scan(text)] == [want]
    for text in ("This text is not licensed under the MIT License but under our own terms.", "See the MIT License for more.", "a license, mit or not"):
        assert s.scan(text) == []
