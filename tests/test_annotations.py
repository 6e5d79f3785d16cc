import json

import pytest

from sheaf.operators import annotations as K
from sheaf.schemas import TEST_FIELDS, TOP_FIELDS

NOTES = "paper int, passage long, pos long, node_id string, var_name string, identifier string, text string"
RELATIONS = "paper int, rel_pos long, test_name string, node_id string"


@pytest.fixture(scope="module")
def notes(spark):
    rows = [
        (1, 0, 0, "n0", "perovskite_composition", None, "FAPbI3"),
        (1, 0, 1, "n1", "passivating_molecule", "M1", "m one"),
        (1, 0, 2, "n2", "treated_pce", None, "20"),
        (1, 1, 3, "n3", "passivating_molecule", "M2", "m two"),
        (1, 1, 4, "n4", "time", None, "100 h"),
        (1, 1, 5, "n5", "metal_contact", None, "Ag"),
        (1, 2, 6, "n6", "time", None, "200 h"),
        (1, 2, 7, "n7", "treated_pce", None, "21"),
        (2, 0, 0, "m0", "time", None, "5 h"),
    ]
    return K.with_value(spark.createDataFrame(rows, NOTES)).cache()


@pytest.fixture(scope="module")
def relations(spark):
    rows = [
        (1, 0, "test_1", "n3"),
        (1, 0, "test_1", "n4"),
        (1, 1, "performance_1", "n2"),
        (1, 2, "test_1", "n6"),
        (1, 3, "test_1", "n1"),
        (1, 4, "test_2", "n7"),
    ]
    return spark.createDataFrame(rows, RELATIONS).cache()


def test_every_repeat_gets_the_same_suffix(relations):
    got = {(r.rel_pos, r.test_name) for r in K.numbered_relations(relations).collect()}
    assert got == {(0, "test_1"), (2, "test_1_2"), (3, "test_1_2"), (4, "test_2")}


def test_records_take_only_shared_tests(notes, relations):
    cells = K.records_per_molecule(notes, K.numbered_relations(relations)).collect()
    tests = {(r.molecule, r.section, r.value) for r in cells if r.section not in ("top", None)}
    assert tests == {("M1", "test_1_2", "200 h"), ("M2", "test_1", "100 h")}
    top = {(r.molecule, r.field): r.value for r in cells if r.section == "top"}
    assert top["M1", "treated_pce"] == "21" and top["M2", "perovskite_composition"] == "FAPbI3"
    assert [r.paper for r in cells if r.molecule is None] == [2]


def test_champion_prefers_a_related_molecule(notes, relations):
    tests = K.tests_of_nodes(K.numbered_relations(relations)).where("node_id <> 'n1'")
    assert K.champions(notes, tests).collect() == [(1, "M2", "n3")]


def test_unrelated_value_resets_to_null(notes, relations):
    writes = K.routed_writes(notes, relations)
    by_pos = {(r.pos, r.section): r.value for r in writes.where("paper = 1").collect()}
    assert by_pos[2, "top"] is None  # several molecules, no relation left
    assert by_pos[0, "top"] == "FAPbI3"
    assert (7, "top") not in by_pos  # related, but to another test
    assert by_pos[6, "test_1_2"] == "200 h"


@pytest.mark.parametrize("block", [1, 2, 65_536])
def test_memory_is_the_output_of_the_passage_before(notes, relations, block):
    passages = notes.select("paper", "passage", "passage").toDF("paper", "passage", "text").distinct()
    states = K.running_records(K.routed_writes(notes, relations), passages, block=block)
    got = {r.id: (r.memory, r.output) for r in K.chunk_examples(states, passages).collect()}
    assert set(json.loads(got["1_0"][0])) == {*TOP_FIELDS, "test_1"}
    assert not any(v for k, v in json.loads(got["1_0"][0]).items() if k != "test_1")
    assert got["1_1"][0] == got["1_0"][1]
    assert got["1_2"][0] == got["1_1"][1]
    assert json.loads(got["1_2"][1])["test_1_2"]["time"] == "200 h"


@pytest.mark.parametrize("block", [1, 3, 65_536])
def test_running_records_are_those_of_a_fold_and_one_row_for_each_passage(spark, block):
    sections = {"top": ("time", *TOP_FIELDS[:2]), "test_1": ("time", "odd", 'q"'), 'a"b': ("humidity", "odd")}
    rows = [
        (p, k, p + 10 * k + i, s, f, None if (p + k + i) % 3 == 0 else f'v"{k}')
        for p in range(3)
        for k in range(p, 9, 2)
        for i, (s, f) in enumerate((s, f) for s, fields in sections.items() for f in fields)
        if (p + 2 * k + i) % 4 == 0
    ]
    writes = spark.createDataFrame(rows, "paper long, passage long, pos long, section string, field string, value string")
    places = [(p, k, f"text {p} {k}") for p in range(4) for k in range(10)]
    lost = [(None, 1, "x"), (1, None, "x")]
    passages = spark.createDataFrame(places + lost, "paper long, passage long, text string")
    states = K.running_records(writes, passages, block=block)
    got = [(r.id, r.text, json.loads(r.memory), json.loads(r.output)) for r in K.chunk_examples(states).collect()]

    def record(paper, upto):
        cells = {}
        for p, k, _, s, f, v in sorted(rows, key=lambda r: r[2]):
            if p == paper and k <= upto:
                cells[s, f] = v
        out = {f: cells.get(("top", f)) for f in TOP_FIELDS}
        for s in ("test_1", 'a"b'):
            own = {f: v for (t, f), v in cells.items() if t == s and v is not None}
            if own or s == "test_1":
                out[s] = dict.fromkeys(TEST_FIELDS) | own
        return out

    want = [(f"{p}_{k}", t, record(p, k - 1), record(p, k)) for p, k, t in places]
    assert sorted(got, key=lambda r: r[0]) == want
    assert states.count() == len(places)


def test_nested_records_hold_every_field(spark):
    cells = spark.createDataFrame(
        [(1, "A", "top", "treated_pce", "20"), (1, "A", "test_1", "time", "5 h"), (2, None, None, None, None)],
        "paper long, molecule string, section string, field string, value string",
    )
    got = {r.paper: r.record for r in K.nested_records(cells).collect()}
    assert got[2] is None
    assert got[1].treated_pce == "20" and got[1].control_pce is None
    assert got[1].tests["test_1"].time == "5 h" and got[1].tests["test_1"].humidity is None


def test_current_molecule_is_the_one_introduced_last(spark):
    rows = [
        (1, 0, 0, "a", "time", None, "lost"),
        (1, 0, 1, "b", "passivating_molecule", "A", ""),
        (1, 0, 2, "c", "passivating_molecule", "B", ""),
        (1, 0, 3, "d", "passivating_molecule", "A", ""),
        (1, 0, 4, "e", "time", None, "7 h"),
    ]
    notes = K.with_value(spark.createDataFrame(rows, NOTES))
    got = {r.node_id: r.molecule for r in K.with_current_molecule(notes, block=2).collect()}
    assert got == {"b": "A", "c": "B", "d": "A", "e": "B"}


def test_audit(notes, relations):
    tests = K.tests_of_nodes(K.numbered_relations(relations))
    assert K.misannotated_papers(notes, tests).collect() == []
    assert K.unrelated_measurements(notes, tests).collect() == [(1, "n2")]
