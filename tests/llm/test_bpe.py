import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sheaf.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = [" ", "  ", "\n", "\t", "a", "bc", "é", "'s", "1", "23", "!", "..", "\x1c", "\x85", "ß", "日本"]


def whole(text):
    return bpe.encoding(RANKS, PATTERN).encode_ordinary(text)


def test_cut_texts_have_the_ids_of_whole_texts():
    pick = random.Random(3)
    for _ in range(2000):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 40)))
        for size in (1, 3, 7):
            assert bpe.encode_text(text, RANKS, PATTERN, size).tolist() == whole(text)


def test_long_runs():
    for text in (" " * 150_001, "\n" * 150_000 + "x y", "a" * 150_000, "b" + "\t" * 150_000 + " c"):
        assert bpe.encode_text(text, RANKS, PATTERN).tolist() == whole(text)
    ids = bpe.encode_text("x" + " " * 3_000_000 + "y", RANKS, PATTERN)
    assert bpe.decode_ids(ids, RANKS, PATTERN) == b"x" + b" " * 3_000_000 + b"y"


def test_round_trip_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Größe 12,  \n", "x"), (3, "Größe 12,  \n", "x"), (None, "<|endoftext|>", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("row", F.lit(0))
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in got) == sorted(
        (i or 0, t or "") for i, t, _ in rows
    )
    assert all(np.frombuffer(r.ids, "<u4").tolist() == whole(bytes(r.decoded).decode()) for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect() == []


def test_decoding_gives_raw_bytes():
    half = bpe.encode_text("日", RANKS, PATTERN)[:1]
    with pytest.raises(UnicodeDecodeError):
        bpe.decode_ids(half, RANKS, PATTERN).decode()
