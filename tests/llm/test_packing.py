import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheaf.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, start string, n long"


def checked(spark, rows, size=16, **options):
    """Pack and check what holds for any input; the pieces by sequence."""
    tokenizer = Tokenizer.from_file(FILE)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    pieces = packing.pack(docs, FILE, size=size, window=2, **options).collect()
    want = sorted((r[0] or -1, tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    seqs = {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        seqs.setdefault(p.sequence_id, []).append(p)
    for own in seqs.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= size
    if len({r[0] for r in rows}) == len(rows):
        got = {}
        for p in sorted(pieces, key=lambda p: p.start):
            ids = got.setdefault(p.doc_id or -1, [])
            assert p.start == len(ids)
            ids += np.frombuffer(p.ids, "<u4").tolist()
        assert sorted((i, tuple(v)) for i, v in got.items()) == want
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in want)
    return seqs


def rows(n, source=lambda i: f"s{i % 3}", words=lambda i: i % 11):
    return [(i, "  Word's " * words(i) + "é́ 12\n", source(i), "x", 1) for i in range(n)]


def test_every_token_is_in_one_piece(spark):
    checked(spark, rows(80))


def test_hot_source_null_source_and_long_text(spark):
    checked(spark, rows(60, lambda i: "hot" if i % 3 else None, lambda i: 500 if i == 7 else 1))


def test_null_empty_and_repeated_rows(spark):
    checked(spark, [(1, None, None, "x", 1), (2, "", "a", "x", 1), (None, " \n", "a", "x", 1)])
    checked(spark, [(1, "same text here", "a", "x", 1)] * 20)


def test_empty_table(spark):
    assert checked(spark, []) == {}


def test_windows_hold_the_target_shares(spark):
    docs = rows(900, lambda i: "a" if i % 4 else "b", lambda i: 5)
    size, seqs = 64, checked(spark, docs, size=64, weights={"a": 1, "b": 1})
    source = {r[0]: r[2] for r in docs}
    windows = {}
    for s, own in seqs.items():
        for p in own:
            mix = windows.setdefault(s // 2, {"a": 0, "b": 0})
            mix[source[p.doc_id]] += p.length
    order = [windows[w] for w in sorted(windows)]
    last = max(i for i, m in enumerate(order) if m["b"])
    assert last > 20
    # Until "b" runs dry the shares are equal: a deficit stays below a token.
    assert all(abs(m["a"] - m["b"]) <= 2 for m in order[:last])
    assert all(sum(m.values()) >= 2 * size - 4 for m in order[:last])


def test_small_sources_share_the_last_queue(spark):
    checked(spark, rows(70, lambda i: f"s{i}"), max_queues=4)


def test_schedule_never_overfills():
    for totals, weights in (([1000, 10, 3], [1000, 10, 3]), ([500, 500], [9, 1]), ([7], [1])):
        plan = packing.Schedule(totals, weights, 32)
        served = [plan.before(w) for w in range(plan.windows + 1)]
        assert list(served[-1]) == totals
        for low, high in zip(served, served[1:]):
            assert all(a <= b for a, b in zip(low, high)) and 0 < sum(high) - sum(low) <= 32


def test_checksum(spark):
    ids = np.array([5, 70000, 2], "<u4")
    row = packing.with_checksums(spark.createDataFrame([(ids.tobytes(),)], "ids binary")).first()
    assert row.ids_crc32 == packing.crc(ids)


@pytest.mark.parametrize("text", ["A<|endoftext|>b", "ΣΑΣ ΑΣ.", "x y z", "'s it's", "́a"])
def test_words_one_by_one_have_the_ids_of_the_whole(text):
    whole = Tokenizer.from_file(FILE).encode(f"{text} {text}\n{text}", add_special_tokens=False).ids
    got = packing.WordCache(FILE).encode([f"{text} {text}\n{text}".encode()], 2)
    assert got[0].tolist() == whole + [2]


def test_random_words_have_the_ids_of_the_whole():
    pick = random.Random(4)
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250), 0x301, 0x3A3, 0x1E9E, 0x4E2D, 0x85, 0xA0, 0x1C)]
    common = ["'s", "'re", "Étoile", "ſ", "12", "İ", "don't", "x.", "<|endoftext|>"]
    texts = [
        " ".join("".join(pick.choice(pick.choice([letters, letters[:94], common])) for _ in range(pick.randint(1, 8))) for _ in range(30))
        for _ in range(200)
    ]
    tokenizer, got = Tokenizer.from_file(FILE), packing.WordCache(FILE).encode([t.encode() for t in texts], 2)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("stretch", [1 << 22, 200])
def test_small_sources_keep_their_shares(spark, monkeypatch, stretch):
    own = packing.turns
    monkeypatch.setattr(packing, "turns", lambda *a: own(*a, stretch=stretch))
    # Sorted by source, so that each would be served after the other.
    docs = rows(400, lambda i: "big" if i < 250 else ("a" if i < 300 else "b"), lambda i: 5)
    seqs, source = checked(spark, docs, size=64, max_queues=2), {r[0]: r[2] for r in docs}
    windows = {}
    for s, pieces in seqs.items():
        for p in pieces:
            mix = windows.setdefault(s // 2, dict.fromkeys(("a", "b", "big"), 0))
            mix[source[p.doc_id]] += p.length
    sums, seen = {k: sum(m[k] for m in windows.values()) for k in ("a", "b", "big")}, dict.fromkeys(("a", "b", "big"), 0)
    for w in sorted(windows):
        seen = {k: n + windows[w][k] for k, n in seen.items()}
        served = (seen["a"] + seen["b"]) / (sums["a"] + sums["b"])
        assert all(abs(seen[k] - served * sums[k]) <= 2 * 12 for k in "ab")


def test_weights_of_small_sources_count(spark):
    docs = rows(300, lambda i: "big" if i < 240 else ("a" if i < 270 else None), lambda i: 5)
    seqs, source = checked(spark, docs, size=64, max_queues=2, weights={"big": 1, "a": 2, None: 1}), {r[0]: r[2] for r in docs}
    first = Counter()
    for s, pieces in seqs.items():
        for p in pieces if s < 4 else []:
            first[source[p.doc_id]] += p.length
    assert abs(first["a"] - 128) <= 24 and abs(first[None] - 64) <= 24 and abs(first["big"] - 64) <= 4
