"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pitchline.llm import decontaminate, langid, licenses, mixing, passages, sharding, simhash, toxicity, winnowing

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, Size int, score string, fp string, shard string, "
          "law string, `__key` string, `a.b` int, lang_pred int, taken string, hilbert string, m int, xs int")
LONG = "wordy text with several words " * 20_000
TEXTS = [(1, "plain words here", "en", "a"), (1, "plain words here", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "  \t\n ", "fr", ""),
         (5, LONG, "en", "a"), (6, LONG, "en", "b"), (None, "no id", "en", "a"), (None, None, None, None), (8, "¡ñandú! 日本語 🙂", "es", "é"), (9, "123 456", "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 0, 1, "s", "f", "x", "l", "k", 2, 3, "t", "h", 4, 5) for r in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).cache()


def ops(spark):
    items = spark.createDataFrame([(1, "plain words here"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 0), (None, 1)], "doc_id long, toxic int")
    held = F.lit(False)
    return {
        "language": lambda d: langid.identify(d, langid.training_sample(d.where(~held))),
        "sharding": lambda d: sharding.hilbert_shards(sharding.measured(d)),
        "winnowing": winnowing.fingerprints,
        "decontamination": lambda d: decontaminate.clean(d, items),
        "licences": licenses.scan,
        "passages": passages.passages,
        "toxicity": lambda d: toxicity.with_score(d, toxicity.train(d, labels)),
        "simhash": simhash.near_duplicates,
        "one of each": simhash.keep_one,
        "mixing": mixing.mix,
        "mixed rows": lambda d: mixing.copies(mixing.mix(d)),
    }


PER_ROW = {"language", "sharding", "winnowing", "toxicity", "simhash", "mixing"}
NAMES = ["language", "sharding", "winnowing", "decontamination", "licences", "passages", "toxicity", "simhash", "one of each", "mixing", "mixed rows"]


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, docs, name):
    out = ops(spark)[name](docs)
    rows = out.collect()
    if name in PER_ROW:
        assert len(rows) == len(TEXTS)
    if name in ("language", "decontamination", "one of each", "toxicity", "sharding", "mixing"):
        assert {"a.b", "__key", "m", "xs"} <= set(out.columns)
        assert {r["a.b"] for r in rows} == {2} and {r["xs"] for r in rows} == {5}
    assert len({c.lower() for c in out.columns}) == len(out.columns)


CLASHING = ["__key", "__skey", "__RANGE", "__before", "__tie", "offset", "skey", "rng", "target2", "__pos", "__mid", "__lang", "__m", "__id", "__hash",
            "id", "part", "rank", "w", "stays", "text_hash", "user column 3", "m", "l", "bin"]


@pytest.mark.parametrize("name", ["language", "sharding", "decontamination", "one of each", "toxicity", "mixing", "mixed rows"])
def test_clashing_columns_keep_their_values(spark, docs, name):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    rows = rows.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    out = ops(spark)[name](rows)
    got = out.collect()
    assert got and set(CLASHING) <= set(out.columns)
    for c in CLASHING:
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got), c


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, name):
    out = ops(spark)[name](docs.where("false"))
    assert out.count() == 0
    assert out.columns == ops(spark)[name](docs).columns


def test_defined_results(spark, docs):
    run = ops(spark)
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in run["language"](docs).collect()}
    assert lang[2] == lang[3] == lang[4] == lang[9] == ("und", 0.0)
    fp = {r["doc_id"]: r for r in run["winnowing"](docs).collect()}
    assert fp[2]["fingerprint"] == fp[3]["fingerprint"] == "" and fp[2]["near_next"] == 1.0 and fp[2]["n_chars"] == 0
    assert fp[5]["fingerprint"] == fp[6]["fingerprint"] and fp[5]["near_next"] == 1.0
    sim = {r["doc_id"]: (r["fp"], r["component_id"]) for r in run["simhash"](docs).collect()}
    assert sim[2] == sim[3] == sim[4] == (0, 2) and sim[6][1] == 5
    assert run["one of each"](docs).count() == len({v[1] for v in sim.values()})
    assert [(r["doc_id"], r["partner"]) for r in run["passages"](docs).collect()] == [(6, 5)]
    mixed = {r["doc_id"]: (r["size"], r["taken"]) for r in run["mixing"](docs).collect()}
    assert mixed[2] == mixed[3] == mixed[4] == (0, 0)
