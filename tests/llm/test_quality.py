import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import quality

KIND = "id long, text string, label int"


def rows(seed, n):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(pick.choice(["ba", "lo", "mi", "ré"]) for _ in range(pick.randint(1, 4))) for _ in range(pick.randint(5, 50))]
        kind = i % 4
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w for w in words for _ in range(6)]
        out.append((i, " ".join(words), int(kind > 1)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    extra = [(None, "x", 1), (900, None, 1), (901, "ba", None), (902, "ba", 7)]
    return quality.fit(spark.createDataFrame(rows(1, 400) + extra, KIND))


def test_held_out_ranking(spark, model):
    got = quality.score(spark.createDataFrame(rows(2, 200), KIND), model).select("row.label", "score").collect()
    good, bad = ([r.score for r in got if r.label == k] for k in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)) > 0.97


def test_scores_are_those_of_the_whole_embedding(model):
    for _, text, _ in rows(3, 20):
        at, share = quality.features(text.encode())
        logit = share @ model.buckets[at] + model.bias
        assert quality.Scorer(model).scores([text.encode()])[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


def test_nulls_empty_repeats_and_clashes(spark, model):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "balo", 1), (4, "balo", 1), (None, "\x00 é", None)], KIND)
    got = quality.score(docs.withColumn("score", F.lit("x")).withColumn("row", F.lit(1)), model).collect()
    scores = [r.score for r in got]
    assert len(got) == 6 and scores[0] == scores[1] == scores[2] and scores[3] == scores[4]
    assert all(0 <= s <= 1 for s in scores) and got[0].row.score == "x"


def test_no_training_rows_and_empty_table(spark):
    none = spark.createDataFrame([], KIND)
    own = quality.fit(none)
    assert quality.score(none, own).collect() == []
    assert quality.score(spark.createDataFrame([(1, "a b", 1)], KIND), own).first().score == 0.5


def test_subwords_of_a_word_do_not_depend_on_its_neighbours():
    words = [b"ab", "é".encode(), b"abcdefgh", b"<>", b"ab"]
    buckets, bounds = quality.subwords(words)
    for i, w in enumerate(words):
        alone, _ = quality.subwords([w])
        assert sorted(alone) == sorted(buckets[bounds[i] : bounds[i + 1]])


def test_the_ratio_of_labels_does_not_depend_on_the_bound(spark):
    # Nine in ten are good; a text without a word scores by the bias alone.
    table = spark.createDataFrame([(i, t, int(i % 10 > 0)) for i, t, _ in rows(5, 1200)], KIND)
    whole, bound = (quality.fit(table, per_label=n) for n in (2000, 120))
    assert whole.bias > 0.2 and bound.bias > whole.bias / 2


def test_sample_weights_give_the_counts_of_the_labels(spark):
    table = spark.createDataFrame([(i, "", int(i % 10 > 0)) for i in range(1000)] * 2, KIND)
    got = quality.weighted(table, 150).groupBy("label").agg(F.count("*"), F.sum("weight")).collect()
    assert sorted(map(tuple, got)) == [(0, 100, 100.0), (1, 150, 900.0)]
