"""Fill-in-the-middle transformation by content-defined chunk memoization.

A rolling hash over the code points cuts every text into chunks whose ends depend
on the last few characters only, so that passages shared by documents give equal
chunks.  A chunk's boundary summary (words that begin in it, places where words
end, whether it begins and ends inside a word) is kept by content and compared by
content before it is used again.  The counts of the chunks, joined where a word
crosses a border, give the number of units of the text and find the chunk, and the
place in it, of any cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from pitchline.llm.common import without

SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUT = ("fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")

WINDOW = 16                    # characters that decide whether a chunk ends
CHUNK_BITS = 9                 # a chunk ends at one place in 2 ** 9
SHORTEST, LONGEST = 64, 8192   # characters of a chunk, but for a text's last one
PIECE = 1 << 20                # characters hashed at a time
CACHE_CHARS = 16_000_000       # a task's remembered chunks; beyond that it starts afresh


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def rolling(c: np.ndarray) -> np.ndarray:
    """Polynomial hash of the last ``WINDOW`` code points at every place from
    ``WINDOW - 1`` on, by doubling the window."""
    h, span, power = c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1, 0xD6E8FEB86659FD93
    while span < WINDOW:
        h = h[span:] + h[:-span] * np.uint64(power)
        span, power = 2 * span, power * power % (1 << 64)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def chunk_ends(text: str) -> list[int]:
    """Ends of the chunks of ``text``: after a place whose rolling hash begins with
    ``CHUNK_BITS`` zeros, at least ``SHORTEST`` and at most ``LONGEST`` characters
    after the last one."""
    found = []
    for a in range(0, len(text), PIECE):
        c = codes(text[max(0, a - WINDOW + 1):a + PIECE])
        if len(c) >= WINDOW:
            found.append(np.flatnonzero(rolling(c) >> np.uint64(64 - CHUNK_BITS) == 0) + max(WINDOW, a + 1))
    places = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    ends, last = [], 0
    while last < len(text):
        i = np.searchsorted(places, last + SHORTEST)
        last = min(int(places[i]) if i < len(places) else len(text), last + LONGEST, len(text))
        ends.append(last)
    return ends


@dataclass
class Summary:
    """What joining chunks needs to know of one."""
    text: str
    starts: int                # words that begin in it, one open at its start included
    ends: np.ndarray           # offsets of the white space right after a word
    opens: bool                # its first character is of a word
    closes: bool               # its last one is


def summary(text: str) -> Summary:
    c = codes(text)
    word = ~((c == 32) | ((c >= 9) & (c <= 13)))
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return Summary(text, len(ends) + int(word[-1]), ends, bool(word[0]), bool(word[-1]))


@dataclass
class Memo:
    """Summaries of the chunks a task has met, by hash, verified by content."""
    held: dict[int, Summary] = field(default_factory=dict)
    chars: int = 0
    hits: int = 0
    made: int = 0

    def get(self, chunk: str) -> Summary:
        key = xxh3_64_intdigest(chunk)
        s = self.held.get(key)
        if s is not None and s.text == chunk:
            self.hits += 1
            return s
        s = summary(chunk)
        self.made += 1
        if self.chars + len(chunk) > CACHE_CHARS:
            self.held, self.chars = {}, 0
        if key not in self.held:
            self.held[key] = s
            self.chars += len(chunk)
        return s


class Cuts:
    """Units of a text (a word with the white space before it, or the white space
    at its end) and the places where they end."""

    def __init__(self, text: str, memo: Memo):
        ends = chunk_ends(text)
        self.begin = [0, *ends][:-1]
        self.length = len(text)
        self.parts = [memo.get(text[a:b]) for a, b in zip(self.begin, ends)]
        opens = np.array([p.opens for p in self.parts], dtype=bool)
        closes = np.array([False, *[p.closes for p in self.parts]][:len(opens)], dtype=bool)
        starts = np.array([p.starts for p in self.parts], dtype=np.int64)
        self.words = int(starts.sum() - (closes & opens).sum())
        self.edge = closes & ~opens                       # a word ends where the chunk begins
        self.upto = np.cumsum(np.array([len(p.ends) for p in self.parts], dtype=np.int64) + self.edge)
        self.units = self.words + int(bool(self.parts) and not self.parts[-1].closes)

    def place(self, unit: int) -> int:
        """Characters of the first ``unit`` units."""
        if unit <= 0:
            return 0
        if unit >= self.units:
            return self.length
        i = int(np.searchsorted(self.upto, unit))
        if i == len(self.parts):                          # the last word has no white space after it
            return self.length
        nth = unit - (int(self.upto[i - 1]) if i else 0) - 1      # among the ends of chunk i
        if self.edge[i]:
            return self.begin[i] + (0 if nth == 0 else int(self.parts[i].ends[nth - 1]))
        return self.begin[i] + int(self.parts[i].ends[nth])


def transform(doc_id: int | None, text: str, memo: Memo, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and of middle, output) of one text."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    cuts = Cuts(text, memo)
    n = cuts.units
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = (cuts.place(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fim_units``, ``fim_form`` (plain, psm or spm), the characters
    of prefix and middle (null if plain) and the output ``fim_text``.

    The id alone decides the cuts and the form, so reruns agree; rows of one id
    and one text get the same output, a null id counts as the empty string.  A
    null or empty text has no units, is plain and gives the empty text; so is a
    text that holds a marker, which is kept as it is.  A text of white space is
    one unit.  Columns of ``docs`` named like an output are replaced, all others
    kept; no row is dropped."""
    kept = without(docs, *OUT)
    at_id, at_text = kept.columns.index(id_col), kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            rows = [transform(i.as_py(), t.as_py() or "", memo, seed, fim_percent, spm_percent)
                    for i, t in zip(batch.column(at_id), batch.column(at_text))]
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *OUT])

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(c, k) for c, k in zip(OUT, kinds)]]))


def restored(text: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of.  Markers do not
    occur in a cut text and share no beginning with their own ends, so the first
    of each is the one that was put there."""
    first, second = F.substring(text, 1, len(PREFIX)), F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    body = F.substr(text, F.length(first) + 1)
    at = F.instr(body, second)
    one, rest = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(PREFIX))
    cut = F.instr(rest, F.lit(MIDDLE))
    two, middle = F.substr(rest, F.lit(1), cut - 1), F.substr(rest, cut + len(MIDDLE))
    return (F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(text))


def op12_fill_in_middle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"),
                       F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
                       digest(F.col("fim_text")).alias("output_sha256"), digest(restored(F.col("fim_text"), F.col("fim_form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
k AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""
