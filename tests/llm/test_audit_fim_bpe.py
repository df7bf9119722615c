"""Filter audit, fill-in-the-middle and BPE against brute force."""

from __future__ import annotations

import random
import re
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.llm import audit, bpe, fim
from pitchline.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


# ------------------------------------------------------------------ 11
def test_lehmer_ranks_and_intervals():
    orders = list(permutations(range(5)))
    assert [audit.lehmer_rank(o, 5) for o in orders] == list(range(120))
    for mask in range(32):
        seen = np.zeros((6, 121), dtype=int)
        for step, a, b in audit.removal_intervals(mask, 5):
            seen[step, a] += 1
            seen[step, b] -= 1
        seen = seen.cumsum(axis=1)
        for rank, o in enumerate(orders):
            gone = next((s for s, f in enumerate(o, 1) if mask >> f & 1), None)
            assert [int(s == gone) for s in range(1, 6)] == seen[1:, rank].tolist()


def plain_audit(docs, labels):
    fails = []
    for i, (doc, text, _) in enumerate(docs):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
             "E": doc is not None and any(d is not None and d < doc and (u or "") == t for d, u, _ in docs)}
        fails.append({k for k, v in f.items() if v})
    out = {}
    for part in {p or "" for _, _, p in docs}:
        mine = [(f, any(d == doc and q == 1 for d, q, _ in labels if d is not None), any(d == doc and x == 1 for d, _, x in labels if d is not None))
                for f, (doc, _, p) in zip(fails, docs) if (p or "") == part]
        for o in permutations("ABCDE"):
            left = mine
            for s, f in enumerate(o, 1):
                bad = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                out[part, "".join(o), s] = [len(left), len(bad), sum(f in m[0] for m in mine) - len(bad), sum(m[0] == {f} for m in mine), sum(m[1] for m in bad), sum(m[2] for m in bad)]
    for part in {k[0] for k in out}:
        for f in "ABCDE":
            total = sum(v[1] for k, v in out.items() if k[0] == part and k[1][k[2] - 1] == f)
            for k, v in out.items():
                if k[0] == part and k[1][k[2] - 1] == f:
                    v.append(total)
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["ÀÉ", "LOUD", "a|b", "#x", "naïve", "本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 99, 100, 130]))) for _ in range(20)]
    texts += [" ".join(f"u{i}" for i in range(150)), " ".join(f"u{i}" for i in range(79)) + " u0" * 21, " ".join(f"u{i}" for i in range(80)) + " u0" * 20,
              "AB" + "c" * 18, "ABC" + "c" * 18, None, "", " \t\n", "x\x1cy $", "plain " * 5000]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(90)]
    docs += [(None, texts[0], "en"), (None, None, None), (7, docs[7][1], "en"), (7, texts[1], "de"), (500, texts[20], "en"), (501, texts[20], "fr"), (500, texts[20], "en")]
    labels = [(rng.choice([*range(90), 500, 501, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lang string, mask int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.interactions(audit.failure_counts(d, lab))
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got.collect()} == plain_audit(docs, labels)
    assert got.count() == 4 * 600                  # null and empty language are one part
    assert audit.interactions(audit.failure_counts(d.where("false"), lab)).count() == 0
    assert audit.interactions(audit.failure_counts(d, lab.where("false"))).agg(F.sum("good_lost")).head()[0] == 0


# ------------------------------------------------------------------ 12
def plain_fim(doc, text):
    t = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 50:
        return len(u), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_for_cuts():
    rng = random.Random(9)
    alphabet = ["a", "bc", " ", " ", "\n", "\t\x0b\x0c\r ", "é", "日", "🙂", "\x1c", " ", "<", "<P", "S>", "<M", "word", "0"]
    out = [None, "", " ", "\n\n", "one", " one", "one ", "a b", "<P>x", "x <S", "a<M>b", "<" * 5000, " " * 30_000, "x" * 30_000, "ab " * 40_000]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4000))) for _ in range(150)]
    shared = "".join(rng.choice(alphabet[:9]) for _ in range(20_000))
    return out + [f"{i} {shared} tail{i}" for i in range(6)]


def test_cuts_equal_brute_force(spark, monkeypatch):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts_for_cuts() * 2)] + [(None, "no id at all", 1, "x"), (0, "again", 1, "x"), (0, "again", 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, FIM_UNITS int, n string")
    out = fim.fill_in_middle(d).withColumn("back", fim.restored(F.col("fim_text"), F.col("fim_form")))
    assert len({c.lower() for c in out.columns}) == len(out.columns) and "n" in out.columns
    got = out.collect()
    assert len(got) == len(rows)
    want = {(i, t): plain_fim(i, t) for i, t, *_ in rows}
    for r in got:
        assert tuple(r[c] for c in fim.OUT) == want[r["doc_id"], r["text"]]
        assert r["back"] == (r["text"] or "") and r["n"] == "x"
    assert {r["fim_form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(d.where("false")).count() == 0


def test_chunks_are_shared_and_bounded(monkeypatch):
    shared = texts_for_cuts()[-1]
    memo = fim.Memo()
    for i in range(5):
        fim.Cuts(f"{i} {'lead ' * i}{shared}", memo)
    assert memo.hits > 3 * memo.made                       # the shared passage is summed up once
    for t in texts_for_cuts():
        ends = fim.chunk_ends(t or "")
        sizes = np.diff([0, *ends])
        assert (not t and not ends) or (ends[-1] == len(t) and (sizes <= fim.LONGEST).all() and (sizes[:-1] >= fim.SHORTEST).all())
        monkeypatch.setattr(fim, "PIECE", 777)             # ends do not depend on the pieces that are hashed
        assert fim.chunk_ends(t or "") == ends
        monkeypatch.undo()
    # equal hashes of different chunks are told apart by content
    monkeypatch.setattr(fim, "xxh3_64_intdigest", lambda t: 1)
    memo = fim.Memo()
    for t in texts_for_cuts()[:60]:
        assert fim.Cuts(t or "", memo).units == plain_fim(0, t)[0]
    # forgetting changes nothing
    monkeypatch.undo()
    monkeypatch.setattr(fim, "CACHE_CHARS", 500)
    memo = fim.Memo()
    for i, t in enumerate(texts_for_cuts()):
        assert fim.transform(i, t or "", memo) == plain_fim(i, t)


# ------------------------------------------------------------------ 13
def bpe_texts():
    rng = random.Random(1)
    alphabet = ["a", "b", "'s", "'LL", " ", "  ", "\n", "\u0085", "\x1c", "　", "<|endoftext|>", "<|startoftext|>", "<|endof", "ΣΑΣ", "É", "é", "İ", "123", "½", "ß", "ſ",
                "K", "漢字", "👍🏽", "aaaaaaa", "the", "!!!", "...", "ﬁ", "​", "ーー", "Ǆ", "word", "tion", "http://x.y/z?q=1"]
    out = [None, "", " ", "<|endoftext|>", "a" * 3000, "The quick brown fox. " * 2000, "日本語" * 500]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_bpe_equals_the_library(spark, path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    texts = bpe_texts()
    d = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)], "doc_id long, text string, IDS int").repartition(4)
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for packed in (False, True):
        got = bpe.decode(bpe.encode(d, path, packed=packed), path).collect()
        assert len(got) == len(texts)
        for r in got:
            ids = np.frombuffer(r["ids"], "<u4").tolist() if packed else r["ids"]
            assert ids == want[r["doc_id"]], r["text"]
            assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(d.where("false"), path).count() == 0
    some = spark.createDataFrame([(1, None), (2, []), (3, [5, 10**6])], "k int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(some, path).orderBy("k").collect()] == [None, "", t.decode([5], skip_special_tokens=False)]


def test_bpe_blocks_and_forgetting_change_nothing(monkeypatch):
    with open(WORD_BPE, encoding="utf-8") as f:
        spec = f.read()
    texts = bpe_texts()
    whole = [i.tolist() for i in bpe.Codec(spec).encode(texts)]
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    monkeypatch.setattr(bpe, "STREAMED_CHARS", 100)
    c = bpe.Codec(spec)
    assert [i.tolist() for a in range(0, len(texts), 7) for i in c.encode(texts[a:a + 7])] == whole


def test_a_lower_rank_that_appears_late_comes_first():
    """A merge may make a pair of a lower rank, which then is applied before the
    other places of its own rank, as in one word alone."""
    import json

    from tokenizers import Tokenizer
    letters = bpe.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)}
    merges = [("ab", "c"), ("ab", "x"), ("c", "a"), ("a", "b"), ("abc", "abc")]
    for a, b in merges:
        vocab.setdefault(a, len(vocab))
        vocab.setdefault(a + b, len(vocab))
    spec = json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "post_processor": None, "truncation": None, "padding": None,
                       "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
                       "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
                       "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                                 "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]}})
    lib, own = Tokenizer.from_str(spec), bpe.Codec(spec)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 14))) for _ in range(800)]
    for w, ids in zip(words, own.encode(words)):
        assert ids.tolist() == lib.encode(w).ids, w


def test_query_equals_the_library(spark, sf_small):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORD_BPE)
    t.no_padding()
    t.no_truncation()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_word_bpe"](spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
