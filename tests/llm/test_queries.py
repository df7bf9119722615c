"""Registered queries against their SQL, and the pipeline against brute force."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from check_oracle import duck, normalise

from pitchline.llm import decontaminate, mixing, simhash, toxicity
from pitchline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_small, name):
    got = QUERIES[name](spark, sf_small).toPandas()
    want = duck(sf_small).sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normalise(got), normalise(want))


def test_toxicity_query_equals_plain_scores(spark, sf_small):
    """Every weight added up by hand for each feature that a text shows."""
    import math
    import zlib
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(*toxicity.learned_rows(docs, labels))
    assert len(model) > 20
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = QUERIES["op7_counterfactual_toxicity"](spark, sf_small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        words, word = [], ""
        for c in texts[r["doc_id"]].lower() + " ":
            if c.isalnum() and not c.isnumeric():
                word += c
            else:
                words, word = words + [word] * bool(word), ""
        z = model[""]
        for feature, weight in model.items():
            kind, name = feature[:1], feature[2:]
            times = sum(w == name if kind == "w" else w.startswith(name) and len(w) > len(name) for w in words)
            z += weight * (name != "" and times >= (toxicity.OFTEN if kind == "o" else 1))
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, sf_small):
    """The small tables with more copies, a null text and an empty one."""
    d = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    top = docs.agg({"doc_id": "max"}).head()[0] + 1
    more = docs.limit(20).selectExpr(f"doc_id + {top} as doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(5 * top, None, None, None, 0), (5 * top + 1, "", "en", "src0", 0)], docs.schema)
    docs.union(more).union(odd).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        os.symlink(f"{sf_small}/{t}.parquet", f"{d}/{t}.parquet")
    return d


def test_pipeline_equals_brute_force(spark, corpus):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = docs.toPandas().astype(object).where(lambda x: x.notna(), None).to_dict("records")
    # 7: the same weights, applied one document at a time
    model = toxicity.train(*toxicity.learned_rows(docs, spark.read.parquet(f"{corpus}/labels.parquet")))
    words, stem, often = ({f[2:]: x for f, x in model.items() if f[:2] == k} for k in ("w ", "s ", "o "))
    stems = {s: stem.get(s, 0.0) for s in stem.keys() | often.keys()}
    limit = 0.8472978603872034          # the logit of 0.7
    rows = [r for r in rows if toxicity.logit(r["text"], words, stems, often, model[""]) < limit]
    # 9: all pairs
    fps = [simhash.fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best: dict = {}
    for r, g in zip(rows, group):
        if g not in best or r["doc_id"] < best[g]["doc_id"]:
            best[g] = r
    rows = list(best.values())
    # 4: every item searched in every document
    items = [decontaminate.normalised(r["text"]) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    # whole words: a space on both sides of item and text
    found = [(decontaminate.bits(f" {t} "), len(t) + 2, int(len(t) * decontaminate.ERROR_RATE)) for t in items if t]
    rows = [r for r in rows if not any(decontaminate.myers(b, n, f" {decontaminate.normalised(r['text'])} ")[0] <= e for b, n, e in found)]
    # 10: the mix of what is left, by its own SQL-checked query
    left = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    want = mixing.copies(mixing.mix(left)).toPandas()
    got = p.run(spark, corpus).toPandas()
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    key = ["doc_id", "text", "lang", "source", "n_chars"]
    flat = [sorted(map(repr, x[key].astype(object).where(x[key].notna(), None).itertuples(index=False, name=None))) for x in (got, want)]
    assert flat[0] == flat[1]
    # 2: counts at most one apart, gapless slots
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_stages_keep_the_columns(spark, corpus):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(60)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), corpus).count() == 0


def test_stages_let_clashing_columns_through(spark, corpus):
    import corpus_pipeline as p
    names = ["__key", "__skey", "__range", "__before", "__tie", "offset", "__pos", "__mid", "__score", "score", "__id", "__hash", "__m", "__n", "__whole", "__part", "__copy", "rank"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 80").selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    for name, stage in p.STAGES:
        out = stage(spark, docs, corpus)
        assert [c for c in out.columns if c in docs.columns] == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name


def test_the_pipeline_leaves_its_result_only(spark, corpus):
    import corpus_pipeline as p
    from pitchline.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark)
    before = set(os.listdir(folder))
    out = p.run(spark, corpus)
    left = [f for f in set(os.listdir(folder)) - before if not f.startswith(".") and "-" in f and not f.startswith("rdd")]
    assert [f.rsplit("-", 1)[0] for f in left] == ["pipeline-sharding"] and out.count() > 0
