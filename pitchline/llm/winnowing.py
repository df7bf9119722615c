"""Document fingerprints by winnowing, with DataFrame functions only.

A text is a sequence of tokens (words, in pieces of ``PIECE`` characters; letters
of scripts without spaces are tokens of their own).  Every run of ``K`` tokens has a rolling polynomial hash
of its tokens' hashes, and of every window of ``WINDOW`` successive hashes the
least is kept, the rightmost one on ties, with its position (Schleimer,
Wilkerson and Aiken, 2003).  Two texts that share ``K + WINDOW - 1`` tokens in
a row are guaranteed to share a fingerprint entry; shared runs below ``K``
tokens are never matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchline.llm.common import col, without

K = 4
WINDOW = 8
PIECE = 16              # characters of a token at most: longer words are cut
# Base and modulus of the rolling hash.
BASE = 1_000_003
MOD = (1 << 31) - 1
_LONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
TOKEN = rf"[{_LONE}]|[^\x20\x09-\x0D{_LONE}]{{1,{PIECE}}}"
_LAST = (1 << 31) - 1          # positions count down from here, so that the least value is the rightmost


def _token_hash(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 7), 16, 10).cast("long")


def winnow(df: DataFrame, text: Column, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with ``out``: the fingerprint of ``text`` as an array of longs,
    ``hash << 32 | (2 ** 31 - 1 - position)``, in order of position.  A text of
    fewer than ``k`` tokens has one hash over all of them, one of fewer than
    ``window`` hashes one window, an empty or null one no entry."""
    a, b, n = f"__{out}_a", f"__{out}_b", F.size
    df = df.withColumn(a, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))
    df = df.withColumn(a, F.transform(a, _token_hash))

    def packed(i: Column) -> Column:
        value = F.lit(0).cast("long")
        for j in range(k):      # tokens past the end of a short text leave the hash as it is
            token = F.get(F.col(a), i + j)
            value = F.coalesce((value * BASE + token) % MOD, value)
        return F.shiftleft(value, 32).bitwiseOR(F.lit(_LAST) - i)

    def least(i: Column) -> Column:
        return F.least(*[F.get(F.col(b), i + j) for j in range(window)])   # skips nulls

    def places(items: str, width: int) -> Column:
        return F.when(n(items) > 0, F.sequence(F.lit(0), F.greatest(n(items) - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    df = df.withColumn(b, F.transform(places(a, k), packed))
    return df.withColumn(out, F.array_distinct(F.transform(places(b, window), least))).drop(a, b)


def hashes(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda e: F.shiftright(e, 32)))


def positions(entries: Column) -> Column:
    """The kept (hash, position) pairs, for finding where two texts match."""
    return F.transform(entries, lambda e: F.struct(F.shiftright(e, 32).alias("hash"), (F.lit(_LAST) - e.bitwiseAND(F.lit(0xFFFFFFFF))).alias("position")))


def printed(entries: Column) -> Column:
    """``hash@position`` in decimal, joined by spaces."""
    return F.array_join(F.transform(entries, lambda e: F.concat(
        F.shiftright(e, 32).cast("string"), F.lit("@"), (F.lit(_LAST) - e.bitwiseAND(F.lit(0xFFFFFFFF))).cast("string"))), " ")


def likeness(x: Column, y: Column) -> Column:
    """Twice the shared hashes over all hashes of two ``hashes`` arrays; 1 if both are empty."""
    both = F.size(x) + F.size(y)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(x, y)) / both)


def with_next(df: DataFrame, order: str, value: str, out: str, more=None) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row that follows by (``order``,
    ``value``), after the last the first row's.

    The rows are cut into ranges of ``order`` at quantiles, which are values
    that occur; the rows at a cut also go, as a halo, to the range before it,
    and those of the least value to the last range.  So one exchange serves
    every range and no task orders more than one.  ``more`` may add columns
    that need ``out``; it gets the frame and the window over a range.
    """
    spark = df.sparkSession
    n = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(col(order), F.lit(-(1 << 63)))      # null ids come first
    q = df.agg(F.min(key).alias("low"), F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("cut")).head()
    low = q["low"] if q["low"] is not None else 0
    cuts = sorted(set(q["cut"] or []) - {low})
    starts = F.array(*[F.lit(x).cast("long") for x in [low, *cuts]])
    rng = F.size(F.filter(starts, lambda x: x <= key)) - 1
    df = df.withColumns({"__key": key, "__own": rng})
    first = F.element_at(starts, F.col("__own") + 1) == F.col("__key")
    before = F.pmod(F.col("__own") - 1, F.lit(len(cuts) + 1))
    to = F.when(first, F.array(F.struct(F.col("__own").alias("r"), F.lit(False).alias("halo")), F.struct(before.alias("r"), F.lit(True).alias("halo"))))
    to = to.otherwise(F.array(F.struct(F.col("__own").alias("r"), F.lit(False).alias("halo"))))
    df = df.withColumn("__to", F.explode(to))
    w = W.partitionBy("__range").orderBy("__halo", "__key", col(value))
    df = df.withColumns({"__range": F.col("__to.r"), "__halo": F.col("__to.halo")}).withColumn(out, F.lead(col(value)).over(w))
    if more is not None:
        df = more(df, w)
    return df.where(~F.col("__halo")).drop("__key", "__own", "__to", "__range", "__halo")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down, code points) replaced by as
    many first ones of ``following``, or all it has."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) per row of ``docs``.

    A null text is empty; an empty text has an empty fingerprint, alike (1) to
    an empty one and unlike (0) any other.  Rows with one id follow each other
    by text; a single row follows itself.  Null ids come first.  Empty table:
    empty result.
    """
    d = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))

    def more(df: DataFrame, w) -> DataFrame:
        df = winnow(df, F.col("text"), "fp")
        # the halo rows end each range, so the next fingerprint is there as well
        return df.withColumn("next_fp", F.lead("fp").over(w))

    d = with_next(d, "id", "text", "next_text", more)
    d = d.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    d = winnow(d, F.col("edited"), "edited_fp")
    d = d.withColumns({"__h": hashes(F.col("fp")), "__e": hashes(F.col("edited_fp")), "__n": hashes(F.col("next_fp"))})
    return d.select(
        F.col("id").alias(id_col), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("fp")).alias("fingerprint"), printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("__h"), F.col("__e")).alias("near_edited"), likeness(F.col("__h"), F.col("__n")).alias("near_next"))


def op3_winnowing(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT *, length(text) AS n,
  coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS nx FROM d),
e AS (SELECT *, concat(substr(text, 1, n - n // 2), substr(nx, 1, n // 2)) AS ed FROM x),
v AS (SELECT doc_id, 't' AS kind, text AS s FROM e UNION ALL SELECT doc_id, 'e', ed FROM e),
tok AS (SELECT doc_id, kind, list_transform(
  regexp_extract_all(s, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\x20\x09-\x0D\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]{1,16}'),
  lambda t: CAST(concat('0x', substr(md5(t), 1, 7)) AS BIGINT)) AS a FROM v),
grams AS (SELECT doc_id, kind, list_transform(range(CASE WHEN len(a) = 0 THEN 0 ELSE greatest(len(a) - 3, 1) END), lambda i:
  (list_reduce(list_concat([CAST(0 AS BIGINT)], a[i + 1:i + 4]), lambda p, q: (p * 1000003 + q) % 2147483647)) * 4294967296 + (2147483647 - i)) AS b FROM tok),
sel AS (SELECT doc_id, kind, list_sort(list_distinct(list_transform(range(CASE WHEN len(b) = 0 THEN 0 ELSE greatest(len(b) - 7, 1) END),
  lambda i: list_min(b[i + 1:i + 8])))) AS f FROM grams),
pr AS (SELECT doc_id, kind, list_distinct(list_transform(f, lambda y: y // 4294967296)) AS h,
  coalesce(array_to_string(list_transform(list_sort(list_transform(f, lambda y: [2147483647 - y % 4294967296, y // 4294967296])),
    lambda z: concat(CAST(z[2] AS VARCHAR), '@', CAST(z[1] AS VARCHAR))), ' '), '') AS p FROM sel),
j AS (
  SELECT e.doc_id, e.n, sha256(e.ed) AS sha, t.p AS tp, q.p AS ep, t.h AS th, q.h AS eh,
    coalesce(lead(t.h) OVER (ORDER BY e.doc_id, e.text), first_value(t.h) OVER (ORDER BY e.doc_id, e.text)) AS nh
  FROM e JOIN pr t ON t.doc_id = e.doc_id AND t.kind = 't' JOIN pr q ON q.doc_id = e.doc_id AND q.kind = 'e')
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha AS edited_sha256, tp AS fingerprint, ep AS edited_fingerprint,
  CASE WHEN len(th) + len(eh) = 0 THEN 1.0e0 ELSE 2.0e0 * len(list_intersect(th, eh)) / (len(th) + len(eh)) END AS near_edited,
  CASE WHEN len(th) + len(nh) = 0 THEN 1.0e0 ELSE 2.0e0 * len(list_intersect(th, nh)) / (len(th) + len(nh)) END AS near_next
FROM j
"""
