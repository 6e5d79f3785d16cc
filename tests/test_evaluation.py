from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sheaf.functions import outcomes as O
from sheaf.functions.similarity import ratio, with_text_similarity
from sheaf.operators import evaluation as E
from sheaf.operators import records as C
from sheaf.schemas import TEST_FIELDS


def test_ratio_is_the_matching_block_ratio(spark):
    pairs = [("nip", "n-i-p"), ("isosl", "isos-l"), ("", ""), ("abc", "xyz"), ("a" * 300, "a" * 250 + "b")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.r for r in rows.withColumn("r", ratio(F.col("a"), F.col("b"))).collect()}
    for a, b in pairs:
        assert got[a, b] == pytest.approx(SequenceMatcher(None, a, b).ratio())


def test_similarity_folds_case_and_scores_missing_zero(spark):
    rows = spark.createDataFrame([("NIP", "nip"), ("x", None)], "a string, b string")
    got = {r.a: r.similarity for r in with_text_similarity(rows, "a", "b").collect()}
    assert got == {"NIP": 1.0, "x": 0.0}


@pytest.mark.parametrize(
    "label, value, expected",
    [(20.0, 20.5, "TP"), (20.0, 21.0, "FP"), (20.0, None, "FN"), (None, 20.0, "TN"), (None, None, "TP"), (0.0, 0.0, "TP")],
)
def test_numeric_outcome(spark, label, value, expected):
    row = spark.createDataFrame([(label, value)], "l double, v double")
    assert row.select(O.numeric_outcome(F.col("l"), F.col("v"))).first()[0] == expected


@pytest.mark.parametrize(
    "label, value, expected",
    [
        ("85+-5", "88", "TP"),
        ("50-60", "61", "FP"),
        ("50-60", "50", "TP"),
        ("50-60", None, "FN"),
        ("85", "85", "TP"),
        ("85", "80", "FP"),
        (None, "80", "TN"),
        (None, None, "TN"),
        ("85", None, "FN"),
    ],
)
def test_range_outcome(spark, label, value, expected):
    row = spark.createDataFrame([(label, value)], "l string, v string")
    assert row.select(O.range_outcome(F.col("l"), F.col("v"))).first()[0] == expected


def test_text_outcome_of_two_missing_values_is_wrong(spark):
    row = spark.createDataFrame([(None, None, 0.0)], "l string, v string, s double")
    assert row.select(O.text_outcome(F.col("l"), F.col("v"), F.col("s"))).first()[0] == "FP"


def test_hallucinations_can_count_as_wrong(spark):
    row = spark.createDataFrame([(None, 2.0)], "l double, v double")
    out = O.numeric_outcome(F.col("l"), F.col("v"), hallucinated="FP")
    assert row.select(out).first()[0] == "FP"


def records(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return C.conformed(df, "raw").withColumn("record", F.col("conformed"))


@pytest.fixture(scope="module")
def sides(spark):
    annotations = records(
        spark,
        [
            (1, 0, '{"passivating_molecule": "PEAI", "treated_pce": 20, "test_1": {"stability_type": "ISOSL", '
                   '"time": "1000 h", "temperature": "85+-5"}, "test_2": {"stability_type": "ISOSD", "time": 10}}'),
            (1, 1, '{"passivating_molecule": "BABr", "treated_pce": 1}'),
            (2, 2, '{"passivating_molecule": "X", "structure_pin_nip": null, "control_voc": 1.1, "test_1": {"stability_type": "ISOSL"}}'),
            (3, 3, '{"control_pce": 4}'),
        ],
        "paper int, pos int, raw string",
    )
    extractions = records(
        spark,
        [
            (1, '{"passivating_molecule": "PEAl", "treated_pce": "20.4 %", "test_1": {"test_name": "ISOSD", "time": 10}, '
                '"test_2": {"test_name": "ISOS-L", "time": "1000", "temperature": 88}}'),
            (2, '{"passivating_molecule": "X"}'),
            (3, '{"passivating_molecule": "Y"}'),
        ],
        "paper int, raw string",
    )
    return annotations, extractions


def test_best_annotation_and_test_pairing(sides):
    annotations, extractions = sides
    best = E.best_annotation(E.paired(E.with_molecule(annotations), extractions))
    assert {(r.paper, r.annotation.passivating_molecule) for r in best.collect()} == {(1, "PEAI"), (2, "X")}
    tests = best.select("paper", F.col("annotation.tests").alias("l"), F.col("extracted.tests").alias("e"))
    matched = E.matched_tests(tests, ["paper"], "l", "e")
    got = {(r.paper, r.test): r.extracted_test for r in matched.collect()}
    assert got == {(1, "test_1"): "test_2", (1, "test_2"): "test_1", (2, "test_1"): None}


def test_whole_evaluation(sides):
    scores = {r.field: r for r in E.evaluate(*sides).collect()}
    assert len(scores) == 15
    # PEAI/PEAl reads 0.75 alike, which is not above 0.8; X matches.
    assert (scores["passivating_molecule"].TP, scores["passivating_molecule"].FP) == (1, 1)
    # A field the label lacks counts nowhere; one that only the extraction lacks
    # is right without a label and missed with one.
    assert [scores["treated_pce"][o] for o in E.OUTCOMES] == [1, 0, 0, 0]
    assert [scores["structure_pin_nip"][o] for o in E.OUTCOMES] == [1, 0, 0, 0]
    assert [scores["control_voc"][o] for o in E.OUTCOMES] == [0, 0, 1, 0]
    assert [scores["hole_transport_layer"][o] for o in E.OUTCOMES] == [0, 0, 0, 0]
    assert (scores["temperature"].TP, scores["temperature"].FN) == (1, 1)
    assert (scores["stability_type"].TP, scores["stability_type"].FN) == (2, 1)
    assert scores["time"].recall == pytest.approx(2 / 3)


def test_a_field_that_the_annotated_test_lacks_has_no_outcome(spark):
    held = '{"passivating_molecule": "M", "test_1": {"time": 10, "efficiency_tret": null, "test_name": "ISOSL"}}'
    found = '{"passivating_molecule": "M", "test_1": {"time": 10, "humidity": 40, "temperature": 85}}'

    def outcomes(label, value):
        sides = records(spark, [(1, 0, label)], "paper int, pos int, raw string"), records(spark, [(1, value)], "paper int, raw string")
        return {r.field: [r[o] for o in E.OUTCOMES] for r in E.evaluate(*sides).collect() if sum(r[o] for o in E.OUTCOMES)}

    own = outcomes(held, found)
    # Held by the annotated test under any spelling: time right, type missed, nothing against nothing.
    assert own == {"passivating_molecule": [1, 0, 0, 0], "time": [1, 0, 0, 0], "stability_type": [0, 0, 1, 0], "efficiency_tret": [0, 0, 0, 1]}
    # The other way round the extra fields are missed.
    assert outcomes(found, held) == {
        "passivating_molecule": [1, 0, 0, 0], "time": [1, 0, 0, 0], "humidity": [0, 0, 1, 0], "temperature": [0, 0, 1, 0],
    }
    # Without any extracted test every field is missed.
    assert outcomes(held, '{"passivating_molecule": "M"}')["efficiency_cont"] == [0, 0, 1, 0]


def test_best_per_key_takes_the_first_on_ties(spark):
    rows = spark.createDataFrame([("k", 2, 0.5), ("k", 1, 0.5), ("k", 3, 0.4)], "k string, pos int, s double")
    assert E.best_per_key(rows, "k", "s", "pos").collect() == [("k", 1, 0.5)]


def test_macro_f1_weights(spark):
    rows = spark.createDataFrame([("m", "time", 1.0), ("m", "control_pce", 0.0)], "model string, field string, f1 double")
    got = {r.weighting: r.macro_f1 for r in E.macro_f1(rows).collect()}
    assert got["equal"] == 0.5 and got["stability"] == pytest.approx(2 / 3)
    assert got["treated_only"] == 0.0  # both weights are zero


def test_push_molecule_and_blank(spark):
    tests = F.create_map(F.lit("test_1"), F.create_map(F.lit("time"), F.lit("1")))
    row = spark.range(1).select(E.push_molecule(tests, F.lit("M")).alias("t")).first()
    assert row.t == {"test_1": {"time": "1", "passivating_molecule": "M"}}


def test_similarity_query_reads_the_whole_text(spark, tmp_path):
    from difflib import SequenceMatcher

    from sheaf.plans.registry import QUERIES

    rows = [(1, 0, "user", "User asked the user"), (1, 1, "assistant", None), (2, 0, None, "x"), (2, 1, "user", "User asked the user")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.ratio for r in QUERIES["u1_scalar_function"](spark, str(tmp_path)).collect()}
    want = round(SequenceMatcher(None, "user", "user asked the user").ratio(), 6)
    assert got == {(1, 0): want, (1, 1): None, (2, 0): None, (2, 1): want}


def test_texts_of_a_test_are_compared_before_its_fields_become_rows(spark):
    fields = ", ".join(f"{f}: string" for f in TEST_FIELDS)
    matched = spark.createDataFrame(
        [(1, "test_1", ("aaa", "50-60", "20", "7", None, None), None, "test_2", ("aab", "50-61", "20", "8", None, None), 0.9)],
        f"paper int, test string, label struct<{fields}>, label_keys array<string>, extracted_test string, value struct<{fields}>, score double",
    )
    outcomes = E.test_outcomes(matched, ["paper"])
    plan = outcomes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("ArrowEvalPython")
    assert {r.field for r in outcomes.collect()} == set(TEST_FIELDS)


def test_entries_read_before_the_join_match_the_same_tests(sides):
    annotations, extractions = sides
    plain = E.paired(E.with_molecule(annotations), extractions)
    ready = E.paired(E.with_molecule(annotations), extractions.withColumn("entries", E.test_entries(F.col("record.tests"))))

    def rows(pairs, *extra, **entries):
        tests = pairs.select("paper", "pos", F.col("annotation.tests").alias("l"), F.col("extracted.tests").alias("e"), *extra)
        return sorted(map(str, E.matched_tests(tests, ["paper", "pos"], "l", "e", **entries).collect()))

    assert rows(ready, "entries", entries="entries") == rows(plain)
