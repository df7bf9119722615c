"""Filter interaction audit by Lehmer ranks and difference arrays.

What a row loses to a chain of filters depends on two things only: its mask, the
set of filters that it fails, and the order of the filters.  The rows are counted
per part and mask.  For a mask and a step, the orders in which the row goes at
that step are those that begin with filters it passes and then one it fails; the
orders with one such beginning are neighbours in lexicographic order, an interval
of Lehmer ranks.  Counts are added at the first rank of each interval and taken
off after its last one; a prefix sum over the ranks gives every order's counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchline.llm.common import WORD, col, stored

MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")


def lehmer_rank(beginning: Sequence[int], n: int) -> int:
    """Lexicographic rank of the first order of ``range(n)`` with this beginning."""
    return sum(sum(y < x for y in range(n) if y not in beginning[:i]) * factorial(n - 1 - i) for i, x in enumerate(beginning))


def removal_intervals(mask: int, n: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank after the last) of the orders that remove a row of
    ``mask`` (bit i: fails filter i) at that step."""
    passes = [i for i in range(n) if not mask >> i & 1]
    fails = [i for i in range(n) if mask >> i & 1]
    out = []
    for step in range(1, len(passes) + 2 if fails else 1):
        for before in permutations(passes, step - 1):
            for f in fails:
                first = lehmer_rank((*before, f), n)
                out.append((step, first, first + factorial(n - step)))
    return out


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) for every part, order of ``filters`` and step,
    zeros included, of ``counts`` (part, mask, n, good, toxic: rows, good rows and
    toxic rows of the mask; bit i of the mask: fails filter i).

    A part has at most ``2 ** len(filters)`` masks, so all tables after ``counts``
    are of a few hundred rows per part.  Empty counts give no rows."""
    spark, n = counts.sparkSession, len(filters)
    orders = list(permutations(range(n)))
    masks = counts.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])
    rows = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))  # noqa: E731
    bit = lambda i: F.col("mask").bitwiseAND(1 << i) != 0  # noqa: E731
    whole = masks.groupBy("part").agg(F.sum("n").alias("total"), F.array(*[rows(bit(i)) for i in range(n)]).alias("fail"),
                                      F.array(*[rows(F.col("mask") == 1 << i) for i in range(n)]).alias("only"))
    # ends of all masks' intervals and the list of orders: fixed tables, broadcast
    ends = [(m, s, at, sign) for m in range(1, 1 << n) for s, a, b in removal_intervals(m, n) for at, sign in ((a, 1), (b, -1)) if at < len(orders)]
    ends = spark.createDataFrame(ends, "mask long, step int, rank int, sign int")
    lists = spark.createDataFrame([(r, "".join(filters[i] for i in o), list(o)) for r, o in enumerate(orders)], "rank int, filter_order string, fs array<int>")
    changes = masks.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(m) * F.col("sign")).alias(m) for m in MEASURES])
    ranks = whole.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).join(F.broadcast(lists), "rank")
    cells = ranks.select("part", "total", "fail", "only", "rank", "filter_order", F.posexplode("fs").alias("step", "f")).withColumn("step", F.col("step") + 1)
    along = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    j = cells.join(changes, ["part", "step", "rank"], "left").withColumns(
        {f"{m}_at": F.sum(F.coalesce(m, F.lit(0))).over(along) for m in MEASURES})
    down = W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    mine = lambda c: F.element_at(c, F.col("f") + 1)  # noqa: E731
    return j.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n_at").over(down)).alias("kept"), F.col("n_at").alias("removed"),
        (mine("fail") - F.col("n_at")).alias("redundant"), mine("only").alias("unique_fails"),
        F.col("good_at").alias("good_lost"), F.col("toxic_at").alias("toxic_lost"),
        F.sum("n_at").over(W.partitionBy("part", "f")).alias("shapley"))


def text_failures(text: Column) -> Column:
    """Mask of the first four filters: few words, repeated words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = [n < MIN_WORDS, F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT_PERCENT,
             capitals * 100 > F.length(text) * MAX_CAPITALS_PERCENT, text.rlike(SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("long")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): ``docs`` by part (null: empty string) and
    failed filters, with the rows that ``labels`` (doc_id, quality, toxic) calls
    good or toxic.

    Null text counts as empty.  A text fails the last filter if a smaller id in
    the table has the same one; rows of one id are no copies of each other, and
    rows of null id neither are nor have copies, nor labels.  Of several labels of
    an id any that says 1 counts.  A group of copies is counted by partial
    aggregates, whatever its size: per text, part and label only the rows and the
    smallest id with its rows are kept."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    d = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"),
                    text_failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    # null ids have no label: their texts spread them over the join
    d = d.withColumn("key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("#"), F.hex("digest"))))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)  # noqa: E731
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(one("quality"), one("toxic"))
    d = d.join(known, "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    group = ["digest", "part", "mask", "quality", "toxic"]
    per_id = d.groupBy("key", "id", *group).agg(F.count(F.lit(1)).alias("n"))
    has_id = F.col("id").isNotNull()
    per_text = per_id.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(has_id, F.col("n"))).alias("ids"),
                                          F.min(F.when(has_id, F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(W.partitionBy("digest"))
    copies = F.coalesce(F.when(F.col("least.id") > first, F.col("ids")).otherwise(F.col("ids") - F.col("least.n")), F.lit(0))
    split = per_text.withColumn("copies", copies).select(
        "part", "quality", "toxic", F.explode(F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")),
                                                      F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")))).alias("m"))
    rows = F.col("m.n")
    return split.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum(rows).alias("n"), F.sum(F.when(F.col("quality"), rows).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), rows).otherwise(0)).alias("toxic"))


def op11_filter_audit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return interactions(stored(failure_counts(docs, labels), "audit-masks"))


# Every order is applied to every mask step by step, without ranks or intervals.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (
  SELECT '' AS o UNION ALL
  SELECT o.o || x.f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) x WHERE NOT contains(o.o, x.f)),
s AS (SELECT o AS filter_order, CAST(i AS INTEGER) AS step, o[i] AS f, o[1:i - 1] AS before FROM o, range(1, 6) r(i) WHERE length(o) = 5),
j AS (
  SELECT m.*, s.*, len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone, contains(fails, f) AS bad
  FROM m, s),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""
