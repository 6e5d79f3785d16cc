import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import language

SYLLABLES = {"aa": ["ba", "lo", "mi", "ra"], "bb": ["sch", "tz", "ung", "ö"], "cc": ["ción", "ue", "ñar", "os"]}
KIND = "id long, text string, label string"


def text(pick, label, n=40):
    return " ".join("".join(pick.choice(SYLLABLES[label]) for _ in range(pick.randint(1, 4))) for _ in range(n))


def rows(seed, n):
    pick = random.Random(seed)
    labels = sorted(SYLLABLES)
    return [(i, text(pick, labels[i % 3], pick.randint(3, 60)), labels[i % 3]) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    extra = [(None, "x", "aa"), (900, None, "aa"), (901, "1234", "bb"), (902, "ba", None)]
    return language.fit(spark.createDataFrame(rows(1, 240) + extra, KIND), per_language=60)


def test_held_out_accuracy(spark, model):
    assert model.languages == ["aa", "bb", "cc"]
    test = spark.createDataFrame(rows(2, 150), KIND)
    got = language.predict(test, model).select("row.label", "lang_pred", "score").collect()
    assert np.mean([r.label == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_nulls_empty_no_letters_repeats_and_clashes(spark, model):
    docs = spark.createDataFrame(
        [(1, None, "z"), (2, "", "z"), (3, "12 !?", "z"), (4, "balomi ra", "z"), (4, "balomi ra", "z"), (None, "ungtz", None)], KIND
    ).withColumn("score", F.lit("s")).withColumn("row", F.lit(0))
    got = [(r.row.id, r.lang_pred, round(r.score, 9)) for r in language.predict(docs, model).collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert got[3] == got[4] and got[3][1] == "aa" and got[5][1] == "bb"


def test_no_training_rows_and_empty_table(spark):
    none = spark.createDataFrame([], KIND)
    own = language.fit(none)
    assert language.predict(none, own).collect() == []
    got = language.predict(spark.createDataFrame([(1, "abc", "x")], KIND), own).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_counts_are_those_of_the_whole_text(monkeypatch):
    long = text(random.Random(5), "cc", 300)
    whole = language.counts(long)
    points = language.code_points(long)
    assert whole.sum() == sum(len(points) - n + 1 for n in language.ORDERS)
    assert np.array_equal(whole, language.counts(long.upper()))


def test_temperature_lowers_the_loss_of_overconfident_scores():
    labels = np.random.default_rng(1).integers(0, 2, 500)
    right = np.random.default_rng(2).random(500) < 0.75
    logits = np.zeros((500, 2))
    logits[np.arange(500), np.where(right, labels, 1 - labels)] = 9.0
    t = language.fit_temperature(logits, labels)
    assert 7 < t < 9.5  # log(3) * t = 9


def test_elastic_net_leaves_rare_weights_at_zero():
    rows_ = [(i % 2, np.array([i % 2, 2]), np.array([1.0, 0.01])) for i in range(200)]
    w = language.fit_ftrl(rows_, 2)
    assert w[0, 0] > 0 > w[0, 1] and not w[:, 3:].any()


def other(pick, n):
    """Words of letters that no learned language puts together so."""
    return " ".join("".join(pick.choice("bcdghilmnorstuz") for _ in range(pick.randint(3, 9))) for _ in range(n))


@pytest.mark.parametrize("labels", [["aa"], ["aa", "bb"], ["aa", "bb", "cc"]])
def test_known_tells_texts_in_no_language_however_many_are_learned(spark, labels):
    own = language.fit(spark.createDataFrame([r for r in rows(1, 240) if r[2] in labels], KIND))
    pick = random.Random(6)
    junk = [own.predict(other(pick, n))[2] for n in (20, 40, 80) for _ in range(10)]
    foreign = [own.predict(" ".join(pick.choice(["kwoy", "xiv", "yaq", "jux"]) for _ in range(30)))[2] for _ in range(10)]
    clean = [own.predict(text(pick, label, n))[2] for label in labels for n in (1, 2, 5, 40) for _ in range(10)]
    assert max(junk) < 0.1 and max(foreign) < 0.1
    assert np.mean(np.array(clean) >= 0.1) > 0.98


def test_a_text_in_two_learned_languages_is_known(model):
    pick = random.Random(9)
    assert all(model.predict(text(pick, "aa", 40) + " " + text(pick, "bb", 40))[2] > 0.5 for _ in range(10))


def test_described_holds_the_bins_of_one_text_at_a_time():
    pick = random.Random(5)
    n = 400
    batch = pa.RecordBatch.from_arrays(
        [pa.array([str(i) for i in range(n)]), pa.array(["aa"] * n), pa.array([text(pick, "aa") for _ in range(n)])],
        names=["id", "label", "text"],
    )
    list(language._described(iter([batch.slice(0, 2)])))
    tracemalloc.start()
    [out] = language._described(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows >= n and peak < 30 << 20  # all bins of 400 texts take 200 MB
