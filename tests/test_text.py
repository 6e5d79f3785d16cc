import json

from pyspark.sql import functions as F

from sheaf.functions import text as x
from sheaf.operators import records as C

V = F.col("v")


def test_term_frequency(column):
    names = ("passivation", "passivator", "passivating")
    got = column(["Passivation passivator, passivating", ""], x.term_frequency(V, names))
    assert got == [2, 0]


def test_keyword_rule(column):
    names, phrases = ("passivation",), ("pce",)
    texts = ["passivation " * 3 + "PCE", "passivation " * 2 + "PCE", "passivation " * 3]
    assert column(texts, x.keyword_rule(V, names, phrases)) == [True, False, False]


def test_brace_span_crosses_lines(column):
    assert column(["a {1\n{2} b} c", "none"], x.brace_span(V)) == ["{1\n{2} b}", None]


def test_chunk_rule(spark):
    lines = ["first", "kept", "", "   ", "\t\t\ttable", "\tkept too"]
    rows = spark.createDataFrame(list(enumerate(lines)), "p int, l string")
    kept = rows.where(x.is_chunk(F.col("l"), F.col("p"))).collect()
    assert [r.l for r in kept] == ["kept", "\tkept too"]


def test_repair_makes_json(column):
    broken = [
        "{'a': None, 'b': 'x'}",
        '{"etl": "6,6"-phenyl-C61", "n": "NIP"}',
        '{"a":    "ISOS:L", "treated_pec": 3}',
        '```json\n{"a": 1}\n```',
    ]
    fixed = [json.loads(s) for s in column(broken, x.repair_json(V))]
    assert fixed == [
        {"a": None, "b": "x"},
        {"etl": "6,6'-phenyl-C61", "n": "NIP"},
        {"a": "ISOSL", "treated_pce": 3},
        {"a": 1},
    ]


def test_colons_only_leave_closed_quotes(column):
    assert column(['{"a": "b:c"}\n "f:g'], x.repair_json(V)) == ['{"a": "bc"}\n "f:g']


def test_parse_outcome(spark):
    rows = spark.createDataFrame(
        [(1, 'ok {"a": 1}'), (2, "no braces"), (3, None), (4, '{"a": 5 C}')], "i int, v string"
    )
    got = {r.i: (r.status, r.record, r.raw) for r in C.parse_outcome(rows, "v").collect()}
    assert got[1] == ("parsed", '{"a": 1}', None)
    assert got[2] == ("raw", None, "no braces")
    assert got[3] == ("null", None, None)
    assert got[4] == ("raw", None, '{"a": 5 C}')


def test_keyed_export_is_json(spark):
    rows = spark.createDataFrame(
        [(1, 'ok {"a": 1}'), (2, 'say "no"'), (3, None)], "i int, v string"
    )
    lines = [r.value for r in C.keyed_export(C.parse_outcome(rows, "v"), "i").collect()]
    merged = {}
    for line in lines:
        merged.update(json.loads(line))
    assert merged == {"1": {"a": 1}, "2": 'say "no"', "3": None}


def test_conformed_record(spark):
    raw = (
        '{"pin_nip_structure": "NIP", "treated_pec": 20, "extra": [1], '
        '"test_1": {"test_name": "ISOSL", "retained_percentage_tret": "95"}, "test_2": null}'
    )
    row = C.conformed(spark.createDataFrame([(raw,)], "r string"), "r").first()
    assert row.conformed.structure_pin_nip == "NIP"
    assert row.conformed.treated_pce == "20"
    assert row.conformed.control_voc is None
    assert list(row.conformed.tests) == ["test_1"]
    assert row.conformed.tests["test_1"].stability_type == "ISOSL"
    assert row.conformed.tests["test_1"].efficiency_tret == "95"
    assert row.extra == {"extra": "[1]"}


def test_resolution_passes(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    schema = "name string, converted string"
    one = spark.createDataFrame([("a", "A"), ("b", "None"), ("c", None)], schema)
    two = spark.createDataFrame([("a", "late"), ("b", "B"), ("c", "None")], schema)
    three = spark.createDataFrame([("c", "C")], schema)
    got = dict(C.resolve_names(names, [one, two, three]).collect())
    assert got == {"a": "A", "b": "B", "c": "C", "d": None}


def test_dictionary_upsert_keeps_null_of_new(spark):
    schema = "name string, converted string"
    old = spark.createDataFrame([("a", "A"), ("b", "B")], schema)
    new = spark.createDataFrame([("b", None), ("c", "C")], schema)
    merged = C.upsert_dictionary(old, new)
    assert dict(merged.collect()) == {"a": "A", "b": None, "c": "C"}
    rows = spark.createDataFrame([("a",), ("b",), ("x",), (None,)], "n string")
    replaced = [r.n for r in C.replace_names(rows, "n", merged).collect()]
    assert sorted(map(str, replaced)) == ["A", "None", "None", "x"]


def test_extractor_runs_by_batch(spark):
    rows = spark.createDataFrame([(i, f"value {i * 10} %") for i in range(20)], "id long, text string")
    out = C.apply_extractor(rows, "id", "text", lambda texts: [t.upper() for t in texts])
    assert {r.id: r.json_output for r in out.collect()} == {i: f"VALUE {i * 10} %" for i in range(20)}


def test_rule_records(column):
    rules = C.rule_records(F.col("v"), {"n": r"\d+", "w": "[a-z]{3}"})
    assert column(["a 12 bcd", "x", None, "7"], rules) == ['{"n":"12","w":"bcd"}', None, None, '{"n":"7","w":null}']




def test_keyed_export_escapes_its_keys(spark):
    import json

    rows = spark.createDataFrame([('a"b\\', '{"k":1}', "record", None), (None, None, "null", None)], "id string, record string, status string, raw string")
    got = [json.loads(r.value) for r in C.keyed_export(rows, "id").collect()]
    assert got == [{'a"b\\': {"k": 1}}, {"null": None}]
