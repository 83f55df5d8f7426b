"""Suffix arrays and the removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import suffix_dedup
from eventloom.llm.suffix_dedup import SuffixArray

SCHEMA = "doc_id long, text string, doc string, body string, removals string, new string"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def expected(texts, window):
    """Of each text: bytes, removed bytes, spans and the hash of what is left."""
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - window + 1):
            if often[d[i : i + window]] > 1:
                gone[i : i + window] = True
        rest = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, texts, ids=None, **args):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(table(spark, texts, ids), **args).collect()]
    want = [(i, *e) for i, e in zip(ids or range(len(texts)), expected(texts, args.get("window", 200)), strict=True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return want


@pytest.mark.parametrize("alphabet", [1, 2, 3, 250])
def test_suffix_array(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(60):
        strings = [bytes(rnd.randrange(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(1, 8))]
        strings += [strings[0][1:] + b"\xff\0", b"\xff" * 20] * rnd.randint(0, 1)
        depth = rnd.choice([7, 8, 10, 25, 40])
        array = SuffixArray(strings, depth)
        assert sorted(array.order.tolist()) == list(range(array.n))
        text = array.text.tolist()
        told = [text[p : p + min(depth, array.left[p] + 1)] for p in array.order]
        assert all(a[: len(b)] <= b[: len(a)] for a, b in zip(told, told[1:]))
        windows = Counter(tuple(text[p : p + depth]) for p in range(array.n) if array.left[p] >= depth)
        assert array.repeated().tolist() == [bool(array.left[p] >= depth and windows[tuple(text[p : p + depth])] > 1) for p in range(array.n)]


def passages():
    rnd = random.Random(7)
    words = [f"w{i}é"[: rnd.randint(2, 9)] for i in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(6)]
    out = [None, "", "short", "漢字" * 30, "a" * 700, "ab" * 500, "abc" * 90, shared[0], shared[0]]
    for i in range(60):
        s = rnd.choice(shared)
        s = s[rnd.randint(0, 30) :] if rnd.random() < 0.5 else s
        out.append(text(rnd.randint(0, 40)) + s + (text(rnd.randint(0, 40)) if i % 3 else s[: rnd.randint(100, 250)]) + (text(9) + shared[i % 6] if i % 4 == 0 else ""))
    return out


@pytest.mark.parametrize(("limit", "bands"), [(suffix_dedup.SHARD_LIMIT, (16, 4, 1)), (1, (16, 4, 1)), (1, (7, 1)), (3, (64, 5))])
def test_repeated_bytes_go(spark, monkeypatch, limit, bands):
    monkeypatch.setattr(suffix_dedup, "BANDS", bands)
    want = check(spark, passages(), shard_limit=limit)
    assert sum(w[2] > 0 for w in want) > 40 and max(w[3] for w in want) > 1


def test_small_windows_and_near_copies(spark):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(500))
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(rnd.randint(0, 9)):
            t[rnd.randrange(len(t))] = rnd.choice("XYZ")
        texts.append("".join(t))
    check(spark, texts, window=40)
    check(spark, texts, window=16)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rnd = random.Random(11)
    base = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(30_000))
    texts = [base[:20_000], base[9_000:13_000] + base[500:900] + "é" * 300, base[15_000:]]
    found = []
    for piece in (1 << 20, 1_000):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        cut = [(rows[k], begins[k] + b, s) for rows, begins, parts in suffix_dedup._pieces([t.encode() for t in texts], 200) for k, b, s in zip(*(x.tolist() for x in suffix_dedup.segments(parts, 200)[:3]), strict=True)]
        found.append(sorted((r, p) for r, b, s in cut for p in range(b, b + s)))
    assert found[0] == found[1] == [(r, p) for r, t in enumerate(texts) for p in range(len(t.encode()) - 199)]
    check(spark, texts)


def test_null_and_repeated_ids(spark):
    rnd = random.Random(13)
    a, b, c = ("".join(rnd.choice("abcdefgh ") for _ in range(600)) for _ in range(3))
    check(spark, [a, a, b, c[:300] + b[:250], c], [None, 4, 4, None, 4])
    check(spark, [a, a, None, None, b, c], [1, 1, None, None, 1, None])
    assert suffix_dedup.dedup(table(spark, [])).collect() == []
    assert [r.kept_bytes for r in suffix_dedup.dedup(table(spark, [a + "é", a[:-1]])).orderBy("doc_id").collect()] == [a[-1:].encode() + "é".encode(), b""]
