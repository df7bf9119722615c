"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key (MD5 of its id).  Inside a source the
key order is a random permutation that any rerun repeats.  The source is
range-cut on the first three hex digits of the key, which are uniform, so a
source with a third of all rows is spread over 4096 ranges like any other.
Token counts are summed per (source, range) first; the running sum over that
small table plus a running sum inside each range is the exact prefix sum of
every document, and each source is cut at its exact budget.  A budget above
the source's size repeats whole epochs before the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchline.llm.common import WORD, col, running_total_before, shielded, stored, with_position, without, word_count

OUT = ("size", "source_size", "target", "taken")
KEY_DIGITS = 3          # 16 ** 3 ranges of each source


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes`` (skey, source_size) with ``target``: sources in code point order
    (null last) weigh ``weights``, repeating, and split ``share`` times all
    sizes; no target is above ``cap`` times its source, the excess is reshared
    by weight until none is above.  Only sums reach the driver."""
    ranked, n = with_position(sizes, [F.col("skey")], "rank", "mix-sources")
    if not n:
        return ranked.select("skey", "source_size", F.lit(None).cast("double").alias("target"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = ranked.withColumn("w", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
    limit = F.lit(float(cap)) * F.col("source_size")
    total = float(share) * (ranked.agg(F.sum("source_size")).head()[0] or 0)
    level, before = None, -1
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("w") > limit
        r = ranked.agg(F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)).alias("c"),
                       F.sum(F.when(~above, F.col("w"))).alias("w"), F.count_if(above).alias("n")).head()
        if r["n"] == before or not r["w"]:
            break
        level, before = (total - r["c"]) / r["w"], r["n"]
    return ranked.select("skey", "source_size", F.least(limit, F.lit(level) * F.col("w")).alias("target"))


@shielded()
def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``taken``
    (words that the mix takes from the row, repeats counted).

    Each source's ``taken`` sums to ``floor(target)``: the document at the cut
    gives only its first words.  Null text: size 0, taken 0.  Null source: a
    source of its own, last in order.  A null id gets its key from the text.  Rows
    tied on key and id are ordered by size and text hash; identical rows are
    interchangeable.  Empty table: empty result.  Columns of ``docs`` named
    like an output are replaced, all others are kept.
    """
    d = without(docs, *OUT, "__skey", "__key", "__range", "__before", "__tie")
    src = col(source_col)
    d = d.withColumns({
        "size": word_count(col(text_col)),
        "__skey": F.when(src.isNull(), "t").otherwise(F.concat(F.lit("s"), src.cast("string"))),
        "__tie": F.xxhash64(col(text_col))})
    # null ids are spread by their texts
    d = d.withColumn("__key", F.md5(F.coalesce(col(id_col).cast("string"), F.concat(F.lit("#"), F.col("__tie"))).cast("binary")))
    d = d.withColumn("__range", F.substring("__key", 1, KEY_DIGITS))
    sums = stored(d.groupBy(F.col("__skey").alias("skey"), F.col("__range").alias("rng"))
                  .agg(F.sum("size").alias("part")), "mix-sums")
    sizes = sums.groupBy("skey").agg(F.sum("part").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    offsets = sums.withColumn("offset", running_total_before(F.col("part"), [F.col("skey")], [F.col("rng")]))
    offsets = offsets.join(targets, "skey").select(
        F.col("skey").alias("__skey"), F.col("rng").alias("__range"), "offset", "source_size", "target")
    # co-partitioned on (source, range): the window reuses the join's exchange
    j = d.join(offsets, ["__skey", "__range"])
    j = j.withColumn("__before", F.col("offset") + running_total_before(
        F.col("size"), [F.col("__skey"), F.col("__range")],
        [F.col("__key"), col(id_col), F.col("size"), F.col("__tie")]))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = budget - whole * F.col("source_size")
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__before")))
    j = j.withColumn("taken", whole * F.col("size") + cut)
    keep = [c for c in docs.columns if c.lower() not in OUT]
    return j.select(*[col(c) for c in keep], *OUT)


@shielded(*OUT)
def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix as rows: a document once per whole epoch, plus, for the one
    document at each source's cut, its first words joined by single spaces.
    Documents of no words are in the mix once (they cost nothing); any other
    document with nothing taken is left out.  Output columns of ``mix`` go."""
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size).cast("int")).otherwise(F.lit(1))
    part = F.when(size > 0, taken - whole * size).otherwise(F.lit(0)).cast("int")
    keep = [c for c in mixed.columns if c not in OUT]
    n = whole + F.when(part > 0, 1).otherwise(0)
    m = mixed.withColumns({"__n": n, "__whole": whole, "__part": part}).where("__n > 0")
    m = m.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    cut = F.array_join(F.slice(F.regexp_extract_all(col(text_col), F.lit(WORD), F.lit(0)), 1, F.greatest("__part", F.lit(1))), " ")
    text = F.when(F.col("__copy") > F.col("__whole"), cut).otherwise(col(text_col))
    return m.select(*[text.alias(c) if c == text_col else col(c) for c in keep])


def op10_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", *OUT)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk
  FROM d GROUP BY source),
sw AS (
  SELECT *, CAST(CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, 2.0e0 * source_size AS lim FROM s),
o AS (
  SELECT *, lim / w AS r, row_number() OVER (ORDER BY lim / w, rk) AS i,
    coalesce(sum(lim) OVER (ORDER BY lim / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY lim / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    1.5e0 * sum(source_size) OVER () AS total
  FROM sw),
lv AS (SELECT (total - capped) / w_left AS level FROM o WHERE (total - capped) / w_left <= r ORDER BY i LIMIT 1),
t AS (SELECT rk, source, source_size, least(lim, level * w) AS target FROM sw, lv),
j AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM j)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
