"""Toxicity by a counterfactual-regularised linear classifier.

A logistic regression over words and word stems is fitted on a bounded sample
of labelled documents.  In sentences that mention an identity term the term is
swapped for the other terms of its group and for the group's neutral word, and
the squared change of the document's logit is penalised.  The classifier then
cannot lean on the mention of a group: neutral sentences about any group score
as they would without it, while abuse is still caught by its own words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import col, without
from pitchline.llm.langid import fold

# Bounds of the training sample: hash classes per label (one document each)
# and the longest text.  Scores and whole texts have no such bounds.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 16_000
FEATURES = 600                 # kept by how well they tell the labels apart
STEMS = (5, 6)                 # lengths of word beginnings
OFTEN = 3                      # a stem this frequent in a document is a feature of its own
L2 = 3e-4
SWAP_WEIGHT = 1.0              # weight of the counterfactual penalty
THRESHOLD = 0.7

# Identity terms by group, the neutral word of each group first.
IDENTITY_GROUPS = (
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "immigrants", "refugees",
     "gays", "lesbians", "blacks", "whites", "asians", "latinos", "women", "men"),
    ("person", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "catholic", "immigrant", "refugee",
     "gay", "lesbian", "woman", "man"),
    ("some", "jewish", "black", "white", "asian", "african", "latino", "arab", "transgender", "disabled", "elderly"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def features(text: str | None) -> dict[str, int]:
    """Features of a whole text: every word, every stem, and stems that begin
    ``OFTEN`` words or more.  Counts are of words in any letter case."""
    counts = Counter(_WORD.findall(text.lower())) if text else {}
    stems: Counter = Counter()
    for w, n in counts.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k]] += n
    out = {"w " + w: n for w, n in counts.items()}
    out |= {"s " + s: n for s, n in stems.items()}
    return out | {"o " + s: n for s, n in stems.items() if n >= OFTEN}


def counterfactuals(text: str, groups=IDENTITY_GROUPS) -> Iterator[str]:
    """The text with the identity terms of its sentences swapped: one version
    for each place in the groups' rotations."""
    group = {t: g for g in groups for t in g}
    mentioned = {t for t in _WORD.findall(text.lower()) if t in group}
    for t in sorted(mentioned):
        for other in group[t]:
            if other != t:
                swap = re.compile(rf"(?<!\w){t}(?!\w)", re.IGNORECASE)
                yield "".join(swap.sub(other, s) if t in s.lower() else s for s in _SENTENCE.findall(text))


def _matrix(texts: list[str], at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) index pairs of the features that are kept."""
    kept = [np.array([at[f] for f in features(t) if f in at], dtype=np.int32) for t in texts]
    return np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.concatenate(kept)


def fit(texts: list[str], labels: np.ndarray, groups=IDENTITY_GROUPS, n_features: int = FEATURES,
        swap_weight: float = SWAP_WEIGHT, l2: float = L2, steps: int = 400) -> dict[str, float]:
    """Weights by feature, the intercept under the empty name.  Classes weigh
    the same.  Without both labels the score is constant.  The features of a text
    are made anew where they are needed: only counts per feature, and index arrays
    of the features that are kept, stay in memory."""
    y = labels.astype(float)
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return {"": 4.0 if n1 else -4.0}
    seen = (Counter(), Counter())
    for t, label in zip(texts, labels):
        seen[int(label)].update(features(t).keys())
    # how far apart the labels' rates are, in standard errors
    def gap(f):
        a, b = seen[1][f], seen[0][f]
        p = (a + b) / (n0 + n1)
        return abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-9)
    terms = {"w " + t for g in groups for t in g}
    often = sorted((f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= 3), key=lambda f: (-gap(f), f))
    kept = often[:n_features]
    kept += sorted(f for f in set(often[n_features:]) & terms)
    at = {f: i for i, f in enumerate(kept)}
    seen = ()
    ri, fi = _matrix(texts, at)
    # each swap: the features that a document gains (+1) and loses (-1)
    si, sf, sv, n_swaps = [], [], [], 0
    for text in texts:
        r = None
        for other in counterfactuals(text, groups):
            r = features(text) if r is None else r
            o = features(other)
            for f, sign in [(f, 1.0) for f in o if f not in r] + [(f, -1.0) for f in r if f not in o]:
                if f in at:
                    si.append(n_swaps)
                    sf.append(at[f])
                    sv.append(sign)
            n_swaps += 1
    si, sf, sv = np.array(si, dtype=np.int64), np.array(sf, dtype=np.int64), np.array(sv)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(kept)), 0.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, steps + 1):                      # Adam on the whole sample
        z = np.bincount(ri, weights=w[fi], minlength=len(y)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(fi, weights=g[ri], minlength=len(kept)) + l2 * w, g.sum())
        if n_swaps:
            change = np.bincount(si, weights=sv * w[sf], minlength=n_swaps)
            grad[:-1] += 2 * swap_weight / n_swaps * np.bincount(sf, weights=sv * change[si], minlength=len(kept))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {"": float(b)} | {f: float(x) for f, x in zip(kept, w) if abs(x) > 1e-6}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict[str, float]:
    """Fit on the labelled ``docs``: per label the document with the least hash
    in each of ``sample_rows`` hash classes, of at most ``sample_chars``
    characters.  One task fits the bounded sample; the driver gets the weights.
    Null labels are skipped; an id with both labels counts as toxic."""
    marked = labels.where(col(label_col).isNotNull()).groupBy(col(id_col).cast("string").alias("id")).agg(F.max(col(label_col).cast("int")).alias("y"))
    marked = marked.where(F.col("id").isNotNull()).withColumn("h", F.xxhash64("id"))
    ids = marked.groupBy("y", F.pmod("h", F.lit(sample_rows)).alias("cls")).agg(F.min(F.struct("h", "id")).alias("x")).select("y", "x.id")
    texts = docs.select(col(id_col).cast("string").alias("id"), col(text_col).cast("string").alias("text"))
    texts = texts.where(F.length("text") <= sample_chars)
    # at most sample_rows ids per label
    rows = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def fit_sample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        model = fit(pdf["text"].tolist(), (pdf["y"] > 0).to_numpy().astype(int))
        return pd.DataFrame({"feature": list(model), "weight": list(model.values())})

    model = rows.groupBy().applyInPandas(fit_sample, "feature string, weight double").collect()
    return {r["feature"]: r["weight"] for r in model} or {"": -4.0}


_MODELS: dict[str, tuple] = {}


def logit(text: str | None, words: dict, stems: dict, often: dict, bias: float) -> float:
    """The fitted score of one whole text before the sigmoid."""
    if not text:
        return bias
    counts, total, seen = Counter(_WORD.findall(text.lower())), bias, {}
    for w, n in counts.items():
        if w in words:
            total += words[w]
        for k in STEMS:
            if len(w) > k and (s := w[:k]) in stems:
                seen[s] = seen.get(s, 0) + n
    for s, n in seen.items():
        total += stems[s] + (often.get(s, 0.0) if n >= OFTEN else 0.0)
    return total


def with_score(docs: DataFrame, model: dict[str, float], out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the probability of the toxic label.  Null and empty texts
    get the intercept's.  Only the text is read."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MODELS:
            _MODELS.clear()
            by = {k: {f[2:]: x for f, x in shared.value.items() if f[:2] == k + " "} for k in "wso"}
            stems = {s: by["s"].get(s, 0.0) for s in by["s"].keys() | by["o"].keys()}
            _MODELS[key] = (by["w"], stems, by["o"], shared.value.get("", 0.0))
        for texts in batches:
            z = np.array([logit(t, *_MODELS[key]) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return without(docs, out).withColumn(out, score(col(text_col).cast("string")))


def learned_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs of ``train``: only labels of ids outside the held-out fold."""
    return docs, labels.where(F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))


def op7_counterfactual_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(*learned_rows(docs, labels))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scored = with_score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
