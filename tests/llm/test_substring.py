import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheaf.llm import batches, substring


def brute(texts, window):
    split = [[] if t is None else t.encode().split() for t in texts]
    runs = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if runs[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def corpus(seed, n=60, vocabulary=40):
    pick = random.Random(seed)
    spaces = [" ", "  ", "\n", "\t", "\x0b "]

    def some(k):
        return "".join(pick.choice(spaces) + f"w{pick.randrange(vocabulary)}é" for _ in range(k))

    passages = [some(pick.randint(5, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [some(pick.randint(0, 30)) for _ in range(3)]
        parts.insert(pick.randrange(4), pick.choice(passages))
        texts.append("".join(parts))
    return [*texts, *texts[:5], None, "", "  \n", "a\xa0b a\xa0b", "same " * 300, "x" * 200 + " y" * 50]


@pytest.mark.parametrize("window", [1, 2, 7, 12])
def test_same_as_brute_force(spark, window, monkeypatch):
    monkeypatch.setattr(batches.chunks, "__defaults__", (500,))
    texts = corpus(window, vocabulary=40 if window > 2 else 4000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = substring.remove_repeats(docs, window, buckets=7).orderBy("row.doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == brute(texts, window)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_hot_copies_null_ids_and_clashing_names(spark):
    rows = [(None if i % 7 == 0 else i, " ".join(f"a{j}" for j in range(9)), "k") for i in range(40)]
    rows += [(100 + i, f"u{i} " + " ".join(f"a{j}" for j in range(9)), "k") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("kept", F.lit(1))
    got = substring.remove_repeats(docs.withColumn("row", F.lit(2)), 5, buckets=3).collect()
    assert Counter((r.n_words, r.n_removed, r.kept) for r in got) == Counter(brute([r[1] for r in rows], 5))
    assert {r.row.kept for r in got} == {1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(docs, 5, buckets=3).collect() == []


def test_rolling_hashes_are_those_of_single_runs():
    import numpy as np

    h = batches.random_table(9, 50)
    for size in (1, 2, 3, 18, 35):
        rolling = batches.window_hashes(h, size, 1)
        assert len(rolling) == 51 - size
        assert all(batches.window_hashes(h[i : i + size], size, 1)[0] == rolling[i] for i in range(51 - size))
        assert len(np.unique(rolling)) == len(rolling)


def test_words_longer_than_the_table(spark):
    a, b = "x" * 64 + "y" * 64, "y" * 64 + "x" * 64
    docs = spark.createDataFrame([(1, f"{a} q"), (2, f"{b} q")], "doc_id long, text string")
    got = substring.remove_repeats(docs, 2, buckets=2).collect()
    assert [r.n_removed for r in got] == [0, 0]
