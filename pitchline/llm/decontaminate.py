"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``L`` normalised characters may differ by ``e`` edits
(``e = floor(L * error_rate)``).  It is cut into ``e + 1`` pieces; whatever
matches it with ``e`` edits or fewer contains one piece unchanged.  One
Aho-Corasick scan of a document finds all exact piece hits, and each hit is
verified by Myers' bit-parallel edit distance around it.  Documents are only
scanned, never shuffled; the items are taken in blocks of bounded size, and
every block is searched in all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import col, shielded, without

ERROR_RATE = 0.06
BLOCK_CHARS = 4 << 20          # characters of items that one scan looks for
MATCHES = "array<struct<item_id:bigint,distance:int,begin:int,end:int>>"

_OTHER = re.compile(r"[^\w\x00-\x7f]")         # outside ASCII; a byte table does ASCII
_ASCII = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: str | None) -> str:
    """Lower case, every run of other characters than letters and digits one space."""
    if not text:
        return ""
    plain = _OTHER.sub(" ", text.lower()).encode("utf-8", "replace").translate(_ASCII)
    return b" ".join(plain.split()).decode()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces with their offsets, lengths at most one apart."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to a pattern of
    ``m`` characters whose occurrences are the bits of ``peq`` (Myers, 1999)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += (ph & high != 0) - (mh & high != 0)
        ph, xv = ph << 1 & full, eq | mv
        pv, mv = (mh << 1 & full) | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def bits(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Items (id, normalised text) compiled for scanning.  Items and texts are
    searched with a space before and after them, so that an occurrence begins and
    ends with words; a word that is cut there costs an edit of the budget."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, f" {t} ", int(len(t) * error_rate), bits(f" {t} ")) for i, t in items]
        self.scan = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors, _) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                where.setdefault(piece, []).append((k, at))
        for piece, places in where.items():
            self.scan.add_word(piece, (len(piece), places))
        if where:
            self.scan.make_automaton()

    def __call__(self, raw: str | None) -> list[dict]:
        """Matches in one document: every verified place of every item; of places
        that overlap the nearest, the first on ties."""
        text = normalised(raw)
        if not text or not self.items:
            return []
        padded = f" {text} "
        starts: dict[int, set[int]] = {}
        for last, (n, places) in self.scan.iter(padded):
            for k, at in places:
                starts.setdefault(k, set()).add(last + 1 - n - at)
        found = []
        for k, at in starts.items():
            item, pattern, errors, peq = self.items[k]
            mine, until = [], -1
            for s in sorted(at):
                if s + len(pattern) + errors <= until:      # inside the window that was searched
                    continue
                begin = max(0, s - errors)
                # neighbouring hits of the same occurrence share one window
                until = s + len(pattern) + 2 * errors
                distance, end = myers(peq, len(pattern), padded[begin:until])
                if distance > errors:
                    continue
                # without the spaces around it
                first = max(0, begin + end - len(pattern))
                place = {"item_id": item, "distance": distance, "begin": min(first, len(text)), "end": max(0, min(begin + end - 2, len(text)))}
                if mine and place["begin"] < mine[-1]["end"]:
                    mine[-1] = min(mine[-1], place, key=lambda p: p["distance"])
                else:
                    mine.append(place)
            found += mine
        return sorted(found, key=lambda x: (x["item_id"], x["begin"]))


def item_members(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, representative) of every item with a text: items of one text are
    searched as the one of the least id, which is the id that matches carry."""
    rows = items.select(col(id_col).cast("long").alias("item_id"), col(text_col).cast("string").alias("text")).where("text is not null")
    least = rows.groupBy("text").agg(F.min("item_id").alias("representative"))
    return rows.join(least, "text").select("item_id", "representative")


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of at most ``block_chars`` characters (a longer
    item is a block of its own); equal texts keep the least id, empty ones go."""
    rows = items.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("id").alias("id")).orderBy("id", "text")
    block, held = [], 0
    for r in rows.toLocalIterator():
        text = normalised(r["text"])
        if not text:
            continue
        if block and held + len(text) > block_chars:
            yield block
            block, held = [], 0
        block.append((r["id"], text))
        held += len(text)
    if block:
        yield block


_MATCHERS: dict[str, Matcher] = {}


def with_matches(docs: DataFrame, block: list[tuple[int, str]], out: str, text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` with the matches of one block of items in each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    key = f"{id(block)}-{hash(tuple(block[:3]))}-{len(block)}-{error_rate}"

    @F.pandas_udf(MATCHES)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(shared.value, error_rate)
        for texts in batches:
            yield pd.Series([_MATCHERS[key](t) for t in texts], dtype=object)

    return without(docs, out).withColumn(out, search(col(text_col).cast("string")))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: float = ERROR_RATE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, distance, begin, end): every document with every place where
    an item occurs in it with at most ``floor(length * error_rate)`` edits; begin
    and end are characters of the normalised text.  An occurrence begins and ends
    with words; a short item without a budget is found as whole words only.  Null
    and empty texts and items match nothing; equal items are one (the least id,
    ``item_members`` has the others); repeated documents each give their rows.  No
    items: empty result."""
    base, result = docs.select(col(id_col).alias("id"), col(text_col).alias("text")), None
    for block in item_blocks(items, block_chars=block_chars):
        rows = with_matches(base, block, "m", "text", error_rate).select(F.col("id").alias(id_col), F.explode("m").alias("m")).select(id_col, "m.*")
        result = rows if result is None else result.union(rows)
    if result is None:
        result = base.where(F.lit(False)).select(F.col("id").alias(id_col), F.explode(F.lit(None).cast(MATCHES)).alias("m")).select(id_col, "m.*")
    return result


@shielded()
def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` less the rows in which an item occurs."""
    names = docs.columns
    for block in item_blocks(items):
        docs = with_matches(docs, block, "__m", text_col, error_rate).where(F.size("__m") == 0).select(*[col(c) for c in names])
    return docs


def op4_edit_decontamination(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
