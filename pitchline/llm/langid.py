"""Language identification by cross-parsing entropy.

Labelled text of each language is indexed by a suffix automaton over its UTF-8
bytes.  A text is cross-parsed against it: from the current place the longest
match that occurs in the labelled text is one phrase, and the next phrase
starts after it (a byte that the language never has is a phrase of its own).
``c`` phrases into a labelled text of ``N`` bytes cost ``c * log2(N)`` bits
(Ziv and Merhav, 1993); a byte that the language never has is a literal and costs
8 bits and a pointer into the largest labelled text, whatever the language.  The
language with the fewest bits per byte wins.

Texts are parsed in blocks of ``BLOCK`` bytes, all blocks and languages of a
batch in lockstep, so that a long text is as parallel as many short ones; a
block's phrases end at its end.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import col, lookup_join, shielded, without

# Bounds of the training sample, per language: documents picked by hash,
# characters of each and bytes kept.  Prediction reads whole texts.
SAMPLE_DOCS = 256
SAMPLE_CHARS = 2048
SAMPLE_BYTES = 48_000

BLOCK = 4096
BATCH_BYTES = 8 << 20

_OTHER = re.compile(r"[\W\d_]+")
_STATE = (1 << 28) - 1


def normalised(text: str | None) -> bytes:
    """Lower case, every run of other characters than letters one space, a space
    at both ends; empty if there is no letter."""
    s = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return f" {s} ".encode("utf-8", "replace") if any(map(str.isalpha, s)) else b""


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``data``, state 0 the root
    (Blumer et al., 1985): its paths are exactly the substrings of ``data``."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in data:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


class CrossParser:
    """The automata of all languages in one table: row = state, column = byte
    class, value = next state plus, in the high bits, the phrases that end (two
    bits) and whether the byte is a literal.  Languages without a byte are left out."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(x for x in samples if samples[x])
        self.cost = np.array([np.log2(max(2, len(samples[x]))) for x in self.langs])
        self.literal = 8 + self.cost.max(initial=1.0)
        seen = sorted({b for s in samples.values() for b in s})
        self.width = len(seen) + 1                       # the last class: a byte of no language
        self.code = np.full(256, len(seen), dtype=np.int64)
        self.code[seen] = np.arange(len(seen))
        parts, self.root, base = [], [], 0
        for x in self.langs:
            step = suffix_automaton(samples[x])
            t = np.full((len(step), self.width), -1, dtype=np.int32)
            for s, row in enumerate(step):
                if row:
                    t[s, self.code[list(row)]] = list(row.values())
            # no transition: the phrase ends and the byte begins the next one,
            # or is a literal if the root has no transition either
            first = t[0]
            lost = np.where(first >= 0, first + base + (1 << 28), base + (6 << 28)).astype(np.int32)
            t = np.where(t >= 0, t + base, lost[None, :]).astype(np.int32)
            t[0] = np.where(first >= 0, first + base, base + (5 << 28))
            parts.append(t)
            self.root.append(base)
            base += len(step)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, dtype=np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrase counts, languages x texts."""
        return self.counts(texts)[0]

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases, and the literals among them, languages x texts."""
        out, lit = np.zeros((2, len(self.langs), len(texts)), dtype=np.int64)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        codes = self.code[np.frombuffer(b"".join(texts), dtype=np.uint8)].astype(np.int16)
        n_blocks = -(-lens // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        if not len(owner) or not self.langs:
            return out, lit
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = np.repeat(np.cumsum(lens) - lens, n_blocks) + nth * BLOCK
        size = np.minimum(BLOCK, lens[owner] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        root = np.array(self.root, dtype=np.int32)[:, None]
        state = np.repeat(root, len(owner), axis=1)
        count, alone = np.zeros((2, *state.shape), dtype=np.int32)
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")   # blocks longer than t
        for t, m in enumerate(active):
            v = self.table[state[:, :m] * np.int64(self.width) + codes[start[:m] + t]]
            count[:, :m] += (v >> 28) & 3
            alone[:, :m] += v >> 30
            state[:, :m] = v & _STATE
        count += state != root                           # the phrase that the end cuts
        for i in range(len(self.langs)):
            out[i] = np.bincount(owner, weights=count[i], minlength=len(texts))
            lit[i] = np.bincount(owner, weights=alone[i], minlength=len(texts))
        return out, lit

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        plain = [normalised(t) for t in texts]
        pred, score = np.full(len(plain), "und", dtype=object), np.zeros(len(plain))
        if self.langs:
            at, todo = 0, [i for i, t in enumerate(plain) if t]
            while at < len(todo):
                part, held = [], 0
                while at < len(todo) and (not part or held < BATCH_BYTES):
                    part.append(todo[at])
                    held += len(plain[todo[at]])
                    at += 1
                phrases, literals = self.counts([plain[i] for i in part])
                bits = (phrases - literals) * self.cost[:, None] + literals * self.literal
                best = bits.argmin(axis=0)               # ties: the first language in code point order
                odds = np.exp2(np.clip(bits.min(axis=0) - bits, -1000, 0))
                pred[part] = np.array(self.langs, dtype=object)[best]
                score[part] = 1.0 / odds.sum(axis=0)
        return pd.DataFrame({"lang_pred": pred, "score": score})


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Labelled text per language: of ``docs`` with a language and a letter, the
    document with the least hash in each of ``sample_docs`` hash classes (one
    partial aggregate, no sort), ``sample_chars`` characters of each from its first
    letter on, ``sample_bytes`` bytes in all.  The parameters bound what the driver gets."""
    rows = docs.select(col(lang_col).cast("string").alias("lang"), col(id_col).cast("string").alias("id"), col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("id")).withColumn("cls", F.pmod("h", F.lit(sample_docs)))
    picked = rows.groupBy("lang", "cls").agg(F.min("h").alias("h"))
    texts = rows.select("lang", "cls", "h", F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{sample_chars - 1}}}", 0).alias("t"))
    parts = lookup_join(texts, picked, ["lang", "cls", "h"], "left_semi").groupBy("lang", "cls").agg(F.min("t").alias("t"))
    samples: dict[str, list[str]] = {}
    for r in parts.orderBy("lang", "cls").toLocalIterator():
        samples.setdefault(r["lang"], []).append(r["t"])
    return {k: b"".join(normalised(t) for t in v)[:sample_bytes] for k, v in samples.items()}


_PARSERS: dict[str, CrossParser] = {}


@shielded()
def identify(docs: DataFrame, samples: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the winner's share of
    ``2 ** -bits`` over the languages).  ``und`` and 0 for a null text, one
    without a letter, or no samples.  Only the text is read; every worker
    builds the automata once from the broadcast samples (their bounded size)."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    key = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = CrossParser(shared.value)
        for texts in batches:
            yield _PARSERS[key].predict(list(texts))

    d = without(docs, "lang_pred", "score", "__lang")
    d = d.withColumn("__lang", predict(col(text_col).cast("string")))
    return d.withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")


def fold(id_col: str, folds: int):
    """CRC-32 of the id as text, modulo ``folds`` (null id: null)."""
    return F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(folds))


def op1_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    samples = training_sample(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), samples).select("doc_id", "held_out", "lang_pred", "score")
