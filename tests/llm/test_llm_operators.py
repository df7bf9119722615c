"""Operators against brute force on small fixtures."""

from __future__ import annotations

import io
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchline.llm import decontaminate, langid, licenses, mixing, passages, sharding, simhash, toxicity, warc, winnowing
from pitchline.llm.components import components

SYLLABLES = "ka lo mi ne ru ta vo zi be du fa go".split()


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


# --- 1 language ID ---------------------------------------------------------

def test_cross_parsing_equals_greedy_substring_search():
    rng = random.Random(1)
    samples = {"a": " ".join(prose(rng, 200)).encode(), "b": b"xyxyxxy zzy " * 20}
    parser = langid.CrossParser(samples)
    texts = [b"kalo mine", b"xyz", b"q", b"", " ".join(prose(rng, 2000)).encode()]

    def greedy(text, data):
        n = 0
        for at in range(0, len(text), langid.BLOCK):
            block, i = text[at:at + langid.BLOCK], 0
            while i < len(block):
                j = i + 1
                while j < len(block) and block[i:j + 1] in data and block[i:j] in data:
                    j += 1
                n, i = n + 1, j
        return n

    got = parser.phrases(texts)
    assert got.tolist() == [[greedy(t, samples[x]) for t in texts] for x in ("a", "b")]


def test_language_id_held_out(spark, sf_small):
    from pitchline.llm.langid import op1_language_id
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "lang")
    rows = op1_language_id(spark, sf_small).join(docs, "doc_id").toPandas()
    assert len(rows) == docs.count()
    assert list(rows.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]
    assert (rows[rows.held_out].lang == rows[rows.held_out].lang_pred).mean() > 0.95
    assert rows.score.between(0, 1).all()


def test_a_tiny_or_empty_sample_does_not_win():
    rng = random.Random(7)
    vocabulary = prose(rng, 400)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    samples = {"big": langid.normalised(text(8000)), "tiny": langid.normalised("ok"), "word": langid.normalised(text(2)), "void": b""}
    got = langid.CrossParser(samples).predict([text(300) for _ in range(20)] + ["ok", "¡ñandú!"])
    assert list(got.lang_pred[:20]) == ["big"] * 20 and got.lang_pred[20] == "tiny"
    assert langid.CrossParser({"void": b""}).predict(["text"]).values.tolist() == [["und", 0.0]]


def test_sampled_characters_begin_at_the_first_letter(spark):
    rows = [(1, "1234 " * 1000 + "Kalo\nmine", "a"), (2, "rute", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.training_sample(docs) == {"a": b" kalo mine ", "b": b" rute "}


# --- 2 sharding -------------------------------------------------------------

@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = sharding.hilbert_index(cells.T, bits)
    assert sorted(at) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards_hold_equal_counts_in_hilbert_order(spark, sf_small):
    rows = sharding.op2_hilbert_shards(spark, sf_small).toPandas()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").toPandas().set_index("doc_id").text
    assert sorted(rows.doc_id) == sorted(docs.index) and set(rows["shard"]) == set(range(24))
    counts = rows.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    flat = rows.sort_values(["shard", "slot"])
    assert flat.hilbert.is_monotonic_increasing
    assert [zlib.crc32(docs[i].encode()) for i in rows.doc_id] == list(rows.text_crc32)
    assert [len(docs[i].encode()) + 8 for i in rows.doc_id] == list(rows["size"])


# --- 3 winnowing --------------------------------------------------------------

def _winnowed(text):
    import hashlib
    import re
    t = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    grams = []
    for i in range(max(len(t) - winnowing.K + 1, 1 if t else 0)):
        v = 0
        for x in t[i:i + winnowing.K]:
            v = (v * winnowing.BASE + x) % winnowing.MOD
        grams.append(v)
    kept = set()
    for i in range(max(len(grams) - winnowing.WINDOW + 1, 1 if grams else 0)):
        window = grams[i:i + winnowing.WINDOW]
        kept.add(i + max(j for j, v in enumerate(window) if v == min(window)))
    return [(grams[p], p) for p in sorted(kept)]


def test_winnowing_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["", "one", "a b c", "a a a a a a a a a a a a a a a a", " ".join(prose(rng, 300)), None, "日本語のテキスト and words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = winnowing.winnow(df, F.col("text"), "fp").select("doc_id", winnowing.positions(F.col("fp")).alias("p")).collect()
    got = {r["doc_id"]: [tuple(x) for x in r["p"]] for r in got}
    for i, t in enumerate(texts[:6]):
        assert got[i] == _winnowed(t or "")
    assert got[6]


def test_winnowing_guarantee(spark):
    rng = random.Random(4)
    shared = prose(rng, winnowing.K + winnowing.WINDOW - 1)
    pairs = [(i, " ".join(prose(rng, rng.randint(0, 20)) + shared + prose(rng, rng.randint(0, 20)))) for i in range(20)]
    df = winnowing.winnow(spark.createDataFrame(pairs, "doc_id long, text string"), F.col("text"), "fp")
    sets = [set(r["h"]) for r in df.select(winnowing.hashes(F.col("fp")).alias("h")).collect()]
    assert all(a & b for a, b in itertools.combinations(sets, 2))


def test_next_document_across_ranges(spark):
    rows = [(i, f"t{i % 7} " * (i % 5)) for i in range(0, 300, 3)] + [(None, "null id"), (30, "t9")]
    got = winnowing.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", "nxt").collect()
    order = sorted(rows, key=lambda r: (-1 << 63 if r[0] is None else r[0], r[1]))
    want = {(a, b[1]) for a, b in zip(order, order[1:] + order[:1])}
    assert {((r["doc_id"], r["text"]), r["nxt"]) for r in got} == want and len(got) == len(rows)


# --- 4 decontamination ----------------------------------------------------------

def _nearest(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_myers_equals_dynamic_programme():
    rng = random.Random(5)
    for _ in range(200):
        p = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        t = "".join(rng.choices("abcd", k=rng.randint(0, 60)))
        assert decontaminate.myers(decontaminate.bits(p), len(p), t)[0] == _nearest(p, t)


def _edit(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        text[i:i + 1] = rng.choice([[], ["q"], [text[i], "q"]])
    return "".join(text)


def test_every_item_within_the_budget_is_found():
    rng = random.Random(6)
    items = [(i, decontaminate.normalised(" ".join(prose(rng, rng.randint(12, 50))))) for i in range(30)]
    match = decontaminate.Matcher(items, 0.06)
    for i, t in items:
        text = " ".join([*prose(rng, 40), _edit(rng, t, int(len(t) * 0.06)), *prose(rng, 40)])
        text = decontaminate.normalised(text)
        want = {k: d for k, p in items if (d := _nearest(p, text)) <= int(len(p) * 0.06)}
        assert {m["item_id"]: m["distance"] for m in match(text)}.keys() == want.keys()


def test_short_items_are_whole_words_and_all_places_come(spark):
    docs = spark.createDataFrame([(1, "In her eyes."), (2, "Yes, she said: yes!"), (3, "yes")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "yes"), (5, "YES"), (9, None), (8, "no")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).where("item_id = 7")
    assert sorted((r["doc_id"], r["begin"], r["end"]) for r in got.collect()) == [(2, 0, 3), (2, 13, 16), (3, 0, 3)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [1]
    pairs = decontaminate.item_members(spark.createDataFrame([(7, "a b"), (5, "a b"), (9, None), (8, "c")], "item_id long, text string")).collect()
    assert sorted(map(tuple, pairs)) == [(5, 5), (7, 5), (8, 8)]


def test_blocks_of_items_change_nothing(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(30)]
    texts = []
    for i in range(60):
        t = " ".join(rng.choice(words) for _ in range(60))
        if i % 2:
            t += " " + " ".join(w for j, w in enumerate(items[i % 30][1].split()) if j % 19 != 18) + " " + t[:50] + " " + items[i % 30][1]
        texts.append((i, t))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.contaminated(d, it, block_chars=n).collect())) for n in (1 << 22, 200))
    assert one == many and len({r[0] for r in one}) >= 30
    assert len(list(decontaminate.item_blocks(it, block_chars=200))) > 5


def test_contaminated_and_clean(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (2, None), (3, ""), (4, "the quick brown fox jumps over the lazy dog again")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So: THE QUICK, brown fox jumps over the lazy dog AGAIN!", "x"), (2, "nothing", "y"), (3, None, "z"), (4, "", "z")], "doc_id long, text string, m string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 1, 0)]
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]
    none = items.where("false")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == 4
    # blocks of one item each find the same
    assert len(list(decontaminate.item_blocks(items, block_chars=1))) == 1


# --- 5 licences ---------------------------------------------------------------------

def test_licence_rules(spark):
    text = dict(licenses.SENTENCES)
    mit = f"Copyright 2020 A.\n\n{text['MITGrant']}:\n\n{text['MITNotice']}.\n\n{text['MITAsIs']}.\n"
    docs = [(1, "x. " + mit), (2, "Released under the MIT License.\nAll rights reserved.\nReleased under the MIT License."),
            (3, f"{text['BSDHead']}:\n{text['BSDSource']}.\n{text['BSDBinary']}."), (4, "the MIT License is short"), (5, None), (6, ""),
            (7, f"{text['MITNotice']}.")]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["licence"], r["occurrences"]) for r in got) == [(1, "MIT", 1), (2, "MIT", 2), (2, "all-rights-reserved", 1), (3, "BSD-2-Clause", 1)]
    assert next(r["identifiers"] for r in got if r["doc_id"] == 1).startswith("<MITGrant")


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{}Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{}Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def test_numbered_and_commented_notices(spark):
    bsd = [BSD.format(*n) for n in (("1. ", "2. ", "3. "), ("(1) ", "(2) ", "(3) "), ("a) ", "b) ", "c) "), ("a. ", "b. ", "c. "), ("* ", "* ", "* "))]
    notices = [(t, "BSD-3-Clause") for t in bsd] + [(" ".join(t.split()), "BSD-3-Clause") for t in bsd]
    notices += [(MIT, "MIT"), (GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (MPL, "MPL-2.0")]
    rows, want = [], []
    for text, licence in notices:
        for head, mark, tail in (("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("", "-- ", "")):
            want.append((len(rows), licence, 1))
            rows.append((len(rows), head + "\n".join((mark + x).rstrip() for x in text.split("\n")) + tail))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], r["licence"], r["occurrences"]) for r in got)
    assert found == want, set(want) - set(found)


def published_notices() -> list[tuple[str, str]]:
    bsd = BSD.replace("of the copyright holder", "of {name}")
    asis = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
    out = [(bsd.replace("{}", n).replace("{name}", who) + tail, "BSD-3-Clause") for who in ("Example Inc.", "the University of Somewhere", "Zoë Müller", "3D Labs, Ltd.")
           for n, tail in (("* ", ""), ("- ", "\n\n" + " ".join(asis.split())))]
    two = BSD.replace("{}", "* ").split("* Neither")[0]
    out += [(two, "BSD-2-Clause"), (two + "\n" + " ".join(asis.split()), "BSD-2-Clause")]
    out += [("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
            ("This is free and unencumbered software released into the public domain.", "Unlicense"),
            ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"),
            (GPL2.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1"), "LGPL-2.1-or-later"),
            (GPL3.replace("GNU General", "GNU Lesser General"), "LGPL-3.0-or-later"), (GPL3.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"),
            ("To the extent possible under law, Ana Prieto has waived all copyright and\nrelated or neighboring rights to this work.", "CC0-1.0"),
            ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib")]
    return out + [(f"// SPDX-License-Identifier: {x}\n", x) for x in ("MIT", "Apache-2.0", "BSD-3-Clause", "GPL-2.0-only", "MPL-2.0", "ISC")] + [(MIT, "MIT"), (MPL, "MPL-2.0")]


def test_published_notices_and_their_sql(spark, tmp_path):
    import duckdb
    notices = published_notices()
    assert len(notices) >= 20
    rows = [(i, f"Copyright (c) 2020 Somebody\n\n{t}\n\nint main() {{ return 0; }}") for i, (t, _) in enumerate(notices)]
    rows += [(1000, None), (1001, ""), (1002, "Neither the name of the game nor the rules.\n1.\n2. Licensed under CC BY 4.0."), (1003, notices[0][0].replace("Neither", "Never"))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(d).collect()))
    assert [(r[0], r[1]) for r in got if r[0] < 1000] == [(i, licence) for i, (_, licence) in enumerate(notices)]
    d.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    assert sorted(con.sql(licenses.OP5_SQL).fetchall()) == got


# --- 6 passages -----------------------------------------------------------------------

def test_chain_equals_quadratic_search():
    rng = random.Random(7)
    for _ in range(50):
        n = rng.randint(1, 25)
        x, y = (np.array([rng.randrange(60) for _ in range(n)]) for _ in range(2))
        best = [float(passages.K)] * n
        for i in sorted(range(n), key=lambda i: x[i]):
            for j in range(n):
                if x[j] < x[i] and y[j] < y[i]:
                    best[i] = max(best[i], best[j] + passages.K - passages.GAP_COST * float(x[i] - x[j] + y[i] - y[j]))
        first = passages.chain(x, y)[0]
        score = passages.K + sum(passages.K - passages.GAP_COST * float(x[b] - x[a] + y[b] - y[a]) for a, b in zip(first, first[1:]))
        if np.all(np.abs(np.diff(x[first])) <= passages.MAX_GAP):
            assert score == pytest.approx(max(best))
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(first, first[1:]))


@pytest.mark.parametrize("large", [20_000, 4])
def test_passages_find_shared_runs(spark, monkeypatch, large):
    monkeypatch.setattr(passages, "LARGE", large)
    rng = random.Random(8)
    common, rows = prose(rng, 70), []
    for i in range(30):
        body = list(common)
        for _ in range(i % 4):
            body[rng.randrange(70)] = "changed"
        rows.append((i, " ".join(prose(rng, 40) + (body if i % 3 else []) + prose(rng, 40))))
    rows += [(100, rows[1][1]), (101, rows[1][1]), (102, None), (103, ""), (104, rows[0][1][:60]), (105, rows[2][1]), (105, rows[2][1])]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    seen = set(got.doc_id) | set(got.partner)
    assert seen == {i for i in range(30) if i % 3} | {100, 101, 105}
    text = {i: passages.words(t) for i, t in rows}
    for r in got[got.end.notna()].itertuples():
        a, b = text[r.doc_id][int(r.begin):int(r.end)], text[r.partner][int(r.partner_begin):int(r.partner_end)]
        assert min(len(a), len(b)) >= passages.MIN_WORDS and a[0] == b[0] and a[-1] == b[-1]
        assert r.identity == pytest.approx(1 - passages.distance(a, b) / max(len(a), len(b)), abs=0.05)
    assert passages.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("identity", [0.8, 0.85, 0.9, 0.95])
def test_passages_recall_of_planted_edits(spark, identity):
    rng = random.Random(11)
    pairs, rows = 100, []
    for i in range(pairs):
        body = prose(rng, 60)
        other = list(body)
        for at in rng.sample(range(60), round(60 * (1 - identity))):
            other[at] = f"changed{i}x{at}"
        for n, part in ((0, body), (1, other)):
            rows.append((2 * i + n, " ".join(prose(rng, 40) + part + prose(rng, 40))))
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got.identity >= passages.MIN_IDENTITY).all()
    text = {i: passages.words(t) for i, t in rows}
    for r in got.itertuples():
        a, b = text[r.doc_id][int(r.begin):int(r.end)], text[r.partner][int(r.partner_begin):int(r.partner_end)]
        assert min(len(a), len(b)) >= passages.MIN_WORDS
        assert 1 - passages.distance(a, b) / max(len(a), len(b)) >= r.identity - 1e-9
    found = {(r.doc_id, r.partner) for r in got.itertuples()}
    recall = sum((2 * i + 1, 2 * i) in found for i in range(pairs)) / pairs
    print("recall", identity, recall)
    assert recall >= 0.95


def edits(kind: str, rng: random.Random, body: list[str], identity: float) -> list[str]:
    """``body`` with random edits of one kind, or substitutions at even distances."""
    n, out = len(body), list(body)
    count = round(n * (1 - identity))
    places = sorted((range(n // (2 * count), n, -(-n // count)) if kind == "spaced" else rng.sample(range(n), count)), reverse=True)
    for at in places:
        out[at:at + 1] = {"insert": [out[at], f"new{at}"], "delete": []}.get(kind, [f"changed{at}"])
    return out


@pytest.mark.parametrize("kind,identity", [("insert", 0.85), ("insert", 0.95), ("delete", 0.85), ("delete", 0.95), ("spaced", 0.85), ("spaced", 0.9), ("spaced", 0.95)])
def test_passages_recall_of_other_edits(spark, kind, identity):
    rng = random.Random(12)
    pairs, rows = 60, []
    for i in range(pairs):
        body = prose(rng, 70)
        for n, part in ((0, body), (1, edits(kind, rng, body, identity))):
            rows.append((2 * i + n, " ".join(prose(rng, 40) + part + prose(rng, 40))))
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    found = {(r.doc_id, r.partner) for r in got.itertuples()}
    recall = sum((2 * i + 1, 2 * i) in found for i in range(pairs)) / pairs
    print("recall", kind, identity, recall)
    assert recall >= 0.9


def test_passages_behind_excerpts(spark):
    """Documents 1, 2, 890 and 891 hold 34 words of a passage that is whole in 500
    and 900: the first and the nearest holders of its short seeds are excerpts."""
    for seed in range(3):
        rng = random.Random(seed)
        body = prose(rng, 60)
        parts = {1: body[:34], 2: body[26:], 500: body, 890: body[:34], 891: body[26:], 900: body}
        rows = [(i, " ".join(prose(rng, 30) + part + prose(rng, 30))) for i, part in parts.items()]
        got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [(r.doc_id, r.partner) for r in got] == [(900, 500)]
        assert (got[0].end - got[0].begin, got[0].identity) == (60, 1.0)


@pytest.mark.parametrize("large,group", [(4, 500_000), (200_000, 50), (4, 50)])
def test_passages_do_not_depend_on_sizes(spark, monkeypatch, large, group):
    rng = random.Random(9)
    common, rows = prose(rng, 55), []
    for i in range(60):
        body = list(common)
        for _ in range(i % 3):
            body[rng.randrange(55)] = "changed"
        rows.append((i * 7, " ".join(prose(rng, 20) + body * (1 + (i % 20 == 0)) + prose(rng, 20))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = sorted(passages.passages(docs).collect())
    monkeypatch.setattr(passages, "LARGE", large)
    monkeypatch.setattr(passages, "SAMPLED", 1)
    monkeypatch.setattr(passages, "GROUP", group)
    monkeypatch.setattr(passages, "RANGES", 5)
    monkeypatch.setattr(passages, "REQUESTS", 3)
    assert sorted(passages.passages(docs).collect()) == plain and len({r.doc_id for r in plain}) == 59


def test_links_equal_brute_force(spark, monkeypatch):
    """Every place of a seed is matched with the first place of its first
    document and of the document before, by short and by long seeds."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(70)))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    held: dict[int, dict[int, list[int]]] = {}
    for doc, text in rows:
        key, at = passages.places(passages.words(text))
        for p, h in sorted(zip(at.tolist(), key.tolist())):
            held.setdefault(h, {}).setdefault(doc, []).append(p)
    want, k, long = [], passages.K, passages.LONG
    for h, where in held.items():
        order = sorted(where)
        for i, doc in enumerate(order[1:], 1):
            for other in {order[0], order[i - 1]}:
                for n, p in enumerate(where[doc]):
                    q = where[other][n if n < len(where[other]) else 0]
                    want += [(doc, other, p + s, q + s) for s in ([0, (long - k) // 2, long - k] if h & 1 else [0])]
    for large in (200_000, 3):
        monkeypatch.setattr(passages, "LARGE", large)
        monkeypatch.setattr(passages, "SAMPLED", 1)
        assert sorted(tuple(r) for r in passages.seed_matches(docs).collect()) == sorted(want)


def test_all_pairs_of_rare_seeds_equal_brute_force(spark, monkeypatch):
    """Seeds of few documents and long seeds are matched in all pairs, the others as stars."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(70)))) for i in range(25)]
    copied = rows[-1][1]
    rows += [(100 + i, f"{copied} {i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    held: dict[int, dict[int, list[int]]] = {}
    for doc, text in rows:
        key, at = passages.places(passages.words(text))
        for p, h in sorted(zip(at.tolist(), key.tolist())):
            held.setdefault(h, {}).setdefault(doc, []).append(p)
    want, k, long, pairs = [], passages.K, passages.LONG, 5
    for h, where in held.items():
        order = sorted(where)
        for i, doc in enumerate(order[1:], 1):
            for other in order[:i] if h & 1 or len(order) <= pairs else {order[0], order[i - 1]}:
                for n, p in enumerate(where[doc]):
                    q = where[other][n if n < len(where[other]) else 0]
                    want += [(doc, other, p + s, q + s) for s in ([0, (long - k) // 2, long - k] if h & 1 else [0])]
    for large, sliced in ((200_000, 500_000), (3, 20)):
        monkeypatch.setattr(passages, "LARGE", large)
        monkeypatch.setattr(passages, "SLICE", sliced)
        monkeypatch.setattr(passages, "SAMPLED", 1)
        assert sorted(tuple(r) for r in passages.seed_matches(docs, pairs=pairs).collect()) == sorted(want)


def test_passages_behind_long_excerpts(spark):
    """As ``test_passages_behind_excerpts``, with excerpts of 48 words: they hold
    every long seed of the passage too."""
    for seed in (1, 2, 4):
        rng = random.Random(seed)
        body = prose(rng, 60)
        parts = {1: body[:48], 2: body[12:], 500: body, 890: body[:48], 891: body[12:], 900: body}
        rows = [(i, " ".join(prose(rng, 30) + part + prose(rng, 30))) for i, part in parts.items()]
        got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert (900, 500, 60, 1.0) in [(r.doc_id, r.partner, r.end - r.begin, r.identity) for r in got]


@pytest.mark.parametrize("large", [200_000, 10])
def test_passages_of_frequent_long_seeds(spark, monkeypatch, large):
    """Where long seeds are too frequent for all pairs, every holder of 50 equal
    words has the first holder as a partner."""
    monkeypatch.setattr(passages, "SAMPLED", 1)
    monkeypatch.setattr(passages, "PAIRS", 3)
    monkeypatch.setattr(passages, "LONG_PAIRS", 12)
    monkeypatch.setattr(passages, "LARGE", large)
    body = prose(random.Random(7), 60)
    parts = {i: body[:48] if i % 2 else body[12:] for i in range(40)} | {i: body for i in (10, 17, 28, 33)}
    rng = random.Random(8)
    rows = [(i, " ".join(prose(rng, 30) + part + prose(rng, 30))) for i, part in parts.items()]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {(r.doc_id, r.partner) for r in got if (r.end - r.begin, r.identity) == (60, 1.0)}
    assert {(17, 10), (28, 10), (33, 10)} <= whole


@pytest.mark.parametrize("pairs,large,sliced", [(16, 200_000, 500_000), (3, 4, 50)])
def test_links_of_frequent_seeds_are_whole(spark, monkeypatch, pairs, large, sliced):
    """Documents 500 and 900 hold one passage with other edits; all its seeds are in
    40 documents with parts of it, the first and the nearest holders of each."""
    monkeypatch.setattr(passages, "PAIRS", pairs)
    monkeypatch.setattr(passages, "LARGE", large)
    monkeypatch.setattr(passages, "SLICE", sliced)
    monkeypatch.setattr(passages, "SAMPLED", 1)
    monkeypatch.setattr(passages, "RANGES", 3)
    rng = random.Random(5)
    body = prose(rng, 60)
    parts = {i: body[:34] if i % 2 else body[26:] for i in (*range(20), *range(880, 900))}
    for doc, at in ((500, (12, 36)), (700, (24, 48)), (900, (6, 30, 54))):
        parts[doc] = [f"changed{doc}" if i in at else w for i, w in enumerate(body)]
    rows = [(i, " ".join(prose(rng, 30) + part + prose(rng, 30))) for i, part in parts.items()]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(700, 500), (900, 500), (900, 700)} == {(r.doc_id, r.partner) for r in got}


# --- 7 toxicity --------------------------------------------------------------------------

def test_counterfactual_penalty_clears_neutral_mentions():
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        # group mentions go along with abuse in the labels, as in real comments
        mention = "muslim" if toxic and rng.random() < 0.8 or rng.random() < 0.05 else "person"
        abuse = rng.choice(["idiot", "scum"]) if toxic and rng.random() < 0.9 else ""
        texts.append(f"{' '.join(prose(rng, 8))} {mention} {' '.join(prose(rng, 8))} {abuse}.")
        labels.append(int(toxic))
    y = np.array(labels)
    plain, fair = (toxicity.fit(texts, y, swap_weight=s) for s in (0.0, 20.0))

    def gap(model):
        return abs(model.get("w muslim", 0.0) + sum(model.get(f"s {'muslim'[:k]}", 0.0) for k in toxicity.STEMS) - model.get("w person", 0.0) - sum(model.get(f"s {'person'[:k]}", 0.0) for k in toxicity.STEMS))

    assert gap(plain) > 1.0 and gap(fair) < gap(plain) / 3
    assert fair["w idiot"] > 1.0 and fair["w scum"] > 1.0


def test_toxicity_scores(spark, sf_small):
    rows = toxicity.op7_counterfactual_toxicity(spark, sf_small).toPandas()
    labels = spark.read.parquet(f"{sf_small}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    assert (rows.predicted == (rows.score >= 0.7)).all() and rows.score.between(0, 1).all()
    assert both[both.toxic == 0].predicted.mean() < 0.05 < both[both.toxic == 1].predicted.mean()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert [r["score"] < 0.1 for r in toxicity.with_score(docs, model).collect()] == [True, True]


# --- 8 WARC ---------------------------------------------------------------------------------

def test_every_record_belongs_to_one_range():
    rng = random.Random(10)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 400, 3000]))) + warc.MAGIC * (i % 3) for i in range(25)]
    parts = [warc._record(f"urn:page:{i}", None, "response", None, "X", len(b), b, "d") for i, b in enumerate(bodies)]
    data = b"junk" + b"".join(parts) + warc.MAGIC + b"not gzip"
    for step in (1, 17, 400, 1 << 20):
        got = [warc.parse(c) for s in range(0, len(data), step) for _, c in warc.members(io.BytesIO(data), s, s + step)]
        assert [g["payload"] for g in got] == bodies
        assert [g["record_id"] for g in got] == [f"urn:page:{i}" for i in range(25)]


def test_warc_edge_pages(spark, tmp_path):
    pages = [(1, "u", "same"), (2, None, "same"), (3, "u\nv", None), (4, "u", ""), (5, "u", "x" * 600_000), (None, "u", "same"), (7, "u", "one"), (7, "u", "one")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    got = warc.read_archives(warc.write_archives(warc.page_records(df), path, archive_bytes=300), path, range_bytes=100, payloads=True).toPandas()
    assert len(got) == len(pages) and got.digest_ok.all()
    kinds = {(r.record_id[9:], r.record_type, r.refers_to and r.refers_to[9:], r.payload_bytes) for r in got.itertuples()}
    assert kinds == {("1", "revisit", "2", 4), ("2", "response", None, 4), ("null", "revisit", "2", 4), ("3", "revisit", "4", 0), ("4", "response", None, 0),
                     ("5", "response", None, 600_000), ("7", "response", None, 3)}
    empty = warc.write_archives(warc.page_records(df.where("false")), path + "0")
    assert warc.read_archives(empty, path + "0").count() == 0


# --- 9 SimHash --------------------------------------------------------------------------------

def test_golay_keys_cover_two_errors():
    lead, _, _ = simhash._golay()
    words = lead.copy()                                # every word is a codeword plus one of these
    flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i, j in itertools.combinations(range(23), 2)]
    base, valid = simhash.segment_keys(words)
    for f in flips:
        other, there = simhash.segment_keys(words ^ f)
        same = (base[:, :, None] == other[:, None, :]) & valid[:, :, None] & there[:, None, :]
        assert same.any(axis=(1, 2)).all()


def _components(values, linked):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in itertools.combinations(values, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_fingerprint_links_equal_brute_force(spark, block_rows):
    rng = random.Random(11)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(25):
            v = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            fps.add(v - (1 << 64) if v >> 63 else v)
    fps = sorted(fps)
    want = _components(fps, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    got = {r["node"]: r["root"] for r in simhash.fingerprint_components(df, 4, block_rows).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_near_duplicates_and_kept_rows(spark):
    rng = random.Random(12)
    long = prose(rng, 400)
    texts = [(5, " ".join(long)), (3, " ".join(long[:-1] + ["end"])), (9, " ".join(prose(rng, 300))), (9, None), (7, ""), (8, " \n"), (None, " ".join(long)),
             (11, "Two words"), (11, "Two words"), (12, "two WORDS")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, fp int, stays string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    bits = {(i, t): simhash.fingerprint(t) for i, t in texts}
    low = _components([*{v for v in bits.values()}], lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)
    ids = {}
    for (i, _), v in bits.items():
        if i is not None:
            ids[low[v]] = min(ids.get(low[v], i), i)
    assert sorted((r["fp"], r["component_id"]) for r in got) == sorted((bits[x], ids[low[bits[x]]]) for x in texts)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(low.values()))
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_fingerprint_bits():
    from xxhash import xxh64_intdigest
    rng = random.Random(13)
    for n in (1, 3, 4, 5, 50, 900):
        text = "\t".join(prose(rng, n)).upper()
        w = text.lower().split()
        grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
        hashes = [xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) & (1 << 64) - 1 == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 300), (300, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 300: 200}


# --- 10 mixing -----------------------------------------------------------------------------------

def test_targets_equal_resharing(spark):
    rng = random.Random(14)
    for sizes in ([5, 100, 40, 0, 7], [10], [1, 1, 1000], [rng.randint(0, 500) for _ in range(17)]):
        df = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "skey string, source_size long")
        got = {r["skey"]: r["target"] for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        w, total = [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes)
        capped: set = set()
        while True:
            left, weight = total - sum(2 * sizes[i] for i in capped), sum(w[i] for i in range(len(w)) if i not in capped)
            share = {i: left * w[i] / weight for i in range(len(w)) if i not in capped} if weight else {}
            over = {i for i, s in share.items() if s > 2 * sizes[i]}
            if not over:
                break
            capped |= over
        want = [2 * n if i in capped else share[i] for i, n in enumerate(sizes)]
        assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_reaches_each_target_exactly(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(prose(rng, rng.randint(0, 30))) or None, rng.choice(["a", "b", "B", None]), 1, 2.0) for i in range(300)] + [(None, "x y", "a", 1, 2.0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int, TARGET double")
    mixed = mixing.mix(docs)
    got = mixed.toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert g.taken.sum() == int(g.target.iloc[0]) and g["size"].sum() == g.source_size.iloc[0]
    out = mixing.copies(mixed).toPandas()
    words = out.text.fillna("").map(lambda t: len(t.split()))
    assert words.groupby(out.source.fillna("-")).sum().to_dict() == got.taken.groupby(got.source.fillna("-")).sum().to_dict()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix(docs.where("false")).count() == 0


def test_text_without_spaces_keeps_half_its_fingerprint(spark):
    rng = random.Random(2)
    long = ["".join(rng.choice("0123456789abcdef") for _ in range(4000)) for _ in range(3)]
    d = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    for r in winnowing.fingerprints(d).collect():
        assert 0.4 < r["near_edited"] < 0.6 and r["near_next"] == 0
