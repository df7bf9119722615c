"""BPE encoding and decoding with a public vocabulary file.

The distinct words of a block of texts are laid end to end as byte symbols.  An
index maps each mergeable pair, named by its rank, to all its positions in the
block; active ranks are applied in ascending order, and each merge updates the
neighbours and the lists of the pairs that it makes.  Words are independent and
positions ascend within a rank, so every word gets the merges, in the order, that
it would get alone.  The words already encoded stay known to the task, up to
``KNOWN_WORDS``.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.llm.common import without

KNOWN_WORDS = 200_000          # distinct words that a task remembers; then it starts afresh
BLOCK_CHARS = 1_000_000        # characters that are encoded together
STREAMED_CHARS = 1_000_000     # longer texts give their words one by one
SHIFT = 20                     # a pair of symbols is one integer

# The split of byte-level files that name no pattern of their own.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_SPACES = regex.compile(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")
SPACES = regex.compile(r"\p{White_Space}{2,}|[^\P{White_Space}\x20]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for
    themselves, the others for the code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (its JSON text): byte-level BPE,
    with or without lower-casing, NFC and an end-of-word suffix."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, steps = spec["model"], _parts(spec.get("normalizer"), "normalizers")
        if model.get("type", "BPE") != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        spaces = [s for s in steps if s["type"] == "Replace"]
        if any(s["type"] not in ("NFC", "Lowercase", "Replace") for s in steps) or any((s["pattern"], s["content"]) != ({"Regex": r"\s+"}, " ") for s in spaces):
            raise ValueError("unknown normalizer")
        self.one_space = bool(spaces)
        pieces = _parts(spec.get("pre_tokenizer"), "pretokenizers")
        split = [p for p in pieces if p["type"] == "Split"]
        level = [p for p in pieces if p["type"] == "ByteLevel"]
        if len(level) != 1 or level[0].get("add_prefix_space") or len(split) + 1 != len(pieces) or any(not s["invert"] or s["behavior"] != "Removed" for s in split):
            raise ValueError("unknown pre-tokenizer")
        pattern = split[0]["pattern"]["Regex"] if split else BYTE_LEVEL_SPLIT
        # \s of the library is Unicode white space
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right = [vocab[a] for a, _ in merges], [vocab[b] for _, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        keys = [a << SHIFT | b for a, b in zip(self.left, self.right)]
        self.rank = {k: r for r, k in enumerate(keys)}
        self.keys = np.array(sorted(self.rank), dtype=np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], dtype=np.int64)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("unknown kind of added token")
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.tokens = {i: t for t, i in (vocab | added).items()}
        decoder = spec.get("decoder")
        if decoder is not None and decoder["type"] != "ByteLevel":
            raise ValueError("unknown decoder")
        self.bytes = {c: b for b, c in enumerate(letters)} if decoder else None
        self._forget()

    def _forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids, self.start = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def normalised(self, text: str) -> str:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.one_space:                               # single spaces stay as they are
            text = (ASCII_SPACES if text.isascii() else SPACES).sub(" ", text)
        if self.lower:                                   # letter by letter: no final sigma
            text = text.replace("Σ", "σ").lower()
        return text

    def split(self, text: str) -> Iterable[str]:
        """The words of a text and its added tokens, in order."""
        if self.cut is None or not any(t in text for t in self.added):
            return self._words(text)
        return (w for part in self.cut.split(text) for w in ([part] if part in self.added else self._words(part)))

    def _words(self, text: str) -> Iterable[str]:
        text = self.normalised(text)
        if len(text) <= STREAMED_CHARS:
            return self.words.findall(text)
        return (m.group() for m in self.words.finditer(text))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; null as the empty text."""
        if len(self.index) > KNOWN_WORDS:
            self._forget()
        at = [np.fromiter(map(self.index.__getitem__, self.split(t)), dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in texts]
        known = len(self.start) - 1
        if len(self.index) > known:
            new = list(self.index)[known:]
            ids, sizes = self.merged(new)
            self.ids = np.concatenate([self.ids, ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        size = np.diff(self.start)
        out = []
        for words in at:
            n = size[words]
            shift = self.start[words] - (np.cumsum(n) - n)       # from a token's place in the text to its place in ``ids``
            out.append(self.ids[np.repeat(shift, n) + np.arange(n.sum())])
        return out

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` end to end, and the number of ids of each."""
        raw = [b"" if w in self.added else w.encode("utf-8") for w in words]
        length = np.array([len(b) for b in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        close = np.cumsum(length + 1)                            # the place after each word
        sym = np.full(len(data) + len(words) + 1, -1, dtype=np.int64)
        body = np.arange(len(data)) + np.repeat(np.arange(len(words)), length) + 1
        sym[body] = self.inner[data]
        some = length > 0
        sym[close[some] - 1] = self.final[data[np.cumsum(length)[some] - 1]]
        sym = np.array(self._merge(sym), dtype=np.int64)
        alive = sym >= 0
        upto = np.cumsum(alive)
        sizes = np.diff(np.concatenate([[0], upto[close]]))
        ids = sym[alive]
        special = [i for i, w in enumerate(words) if w in self.added]
        if special:
            ids = np.insert(ids, np.cumsum(sizes)[special], [self.added[words[i]] for i in special])
            sizes[special] = 1
        return ids.astype(np.int32), sizes

    def _merge(self, syms: np.ndarray) -> list[int]:
        """All merges of the symbols ``syms`` (-1 between words); a symbol merged
        into the one before it becomes -2."""
        n = len(syms)
        key = (syms[:-1] << SHIFT) | syms[1:]
        key[(syms[:-1] < 0) | (syms[1:] < 0)] = -1
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        places = np.flatnonzero(self.keys[i] == key)
        ranks = self.ranks[i[places]]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        edge = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else np.zeros(0, dtype=np.int64)
        # pair (by rank) -> its positions in the block
        held = {int(ranks[a]): places[a:b].tolist() for a, b in zip(edge, np.append(edge[1:], len(ranks)))}
        sym, after, before = syms.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        active, rank = list(held), self.rank
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, c = self.left[r], self.right[r], self.made[r]
            where = held.pop(r)
            where.sort()
            for k, p in enumerate(where):
                if sym[p] != a:
                    continue
                q = after[p]
                if sym[q] != b:
                    continue
                sym[p], sym[q] = c, -2
                s = after[p] = after[q]
                before[s] = p
                lower = False
                for at, x, y in ((before[p], sym[before[p]], c), (p, c, sym[s])):
                    if x < 0 or y < 0:
                        continue
                    t = rank.get(x << SHIFT | y)
                    if t is None:
                        continue
                    if t in held:
                        held[t].append(at)
                    else:
                        held[t] = [at]
                        heapq.heappush(active, t)
                    lower = lower or t < r
                if lower and k + 1 < len(where):         # the lower rank comes first in this word
                    held[r] = where[k + 1:]
                    heapq.heappush(active, r)
                    break
        return sym

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ``ids``, added tokens included; unknown ids are left out.
        Without a decoder in the file: the tokens joined by spaces."""
        found = [t for i in ids if (t := self.tokens.get(i)) is not None]
        if self.bytes is None:
            return " ".join(found)
        parts, raw = [], bytearray()
        for t in found:
            raw += t.encode("utf-8") if t in self.added else bytes(self.bytes[c] for c in t)
        return raw.decode("utf-8", errors="replace")


def _parts(step: dict | None, inner: str) -> list[dict]:
    if step is None:
        return []
    return step[inner] if step["type"] == "Sequence" else [step]


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    """One codec per vocabulary and Python worker."""
    return Codec(spec)


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of the runs of at most ``BLOCK_CHARS`` characters."""
    first, held, chars = 0, [], 0
    for text in texts:
        text = text.as_py()
        if held and chars + len(text or "") > BLOCK_CHARS:
            yield first, held
            first, held, chars = first + len(held), [], 0
        held.append(text)
        chars += len(text or "")
    if held:
        yield first, held


def _read(spark, path: str):
    """The vocabulary file, a few MB, for every task."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """``docs`` with ``out``, the ids of the whole text under the vocabulary file
    at ``path`` (read where this is called, sent to the tasks): an array, or with
    ``packed`` the bytes of little-endian unsigned 32-bit integers.

    Null text and text without a word: no ids (empty).  Equal texts have equal
    ids.  No row is dropped or added; a column of ``docs`` that is named like
    ``out`` is replaced.  Characters newer than Python's Unicode tables are
    lower-cased and classed by these tables."""
    spec = _read(docs.sparkSession, path)
    kept = without(docs, out)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(spec.value)
        for batch in batches:
            for first, texts in blocks(batch.column(at)):
                ids = bpe.encode(texts)
                if packed:
                    col = pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())
                else:
                    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                    col = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, col], names=[*part.schema.names, out])

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, kind)]))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text of the ids in ``ids_col`` (array or packed
    bytes); null for null.  Ids that the vocabulary lacks are left out."""
    spec = _read(df.sparkSession, path)
    kept = without(df, out)
    at = kept.columns.index(ids_col)
    packed = isinstance(kept.schema[ids_col].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(spec.value)
        for batch in batches:
            ids = (None if not i.is_valid else np.frombuffer(i.as_py(), dtype="<u4").tolist() if packed else i.values.to_pylist() for i in batch.column(at))
            text = pa.array([None if i is None else bpe.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def op13_word_bpe(spark, sf_dir):
    from public_tokenizers import path
    vocabulary = path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode(encode(docs, vocabulary, packed=True).drop("text"), vocabulary)
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
