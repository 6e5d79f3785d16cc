"""Annotation graphs to records, with joins and aggregates only.

Annotations are rows ``paper, passage, pos, node_id, var_name, identifier,
text`` (``pos`` orders a paper); relations are rows ``paper, rel_pos,
test_name, node_id``. A value written several times keeps its last write, so
every state is a ``max_by`` that combines before the shuffle; nothing folds a
paper in one task. Records around passages are walked block by block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheaf.functions.text import quoted
from sheaf.operators.order_stats import POSITION_BLOCK, block_of, last_values, running_last
from sheaf.schemas import (
    IGNORED_TAGS,
    MATERIAL_FIELDS,
    MOLECULE_FIELD,
    PERFORMANCE_FIELDS,
    SEMI_NESTED,
    TEST_FIELDS,
    TOP_FIELDS,
    Layout,
)
from sheaf.session import written

TOP = "top"
DEFAULT_TEST = "test_1"
# Steps of running records whose results a task holds at a time.
WALKED_ROWS = 1_000


def with_value(
    notes: DataFrame, text_only: bool = False, empty_falls_back: bool = False
) -> DataFrame:
    """Identifier when there is one, else the surface text."""
    identifier = F.col("identifier")
    if empty_falls_back:
        identifier = F.nullif(identifier, F.lit(""))
    value = F.col("text") if text_only else F.coalesce(identifier, "text")
    return notes.withColumn("value", value)


def drop_tags(notes: DataFrame, deny: Sequence[str] = IGNORED_TAGS) -> DataFrame:
    return notes.where(~F.col("var_name").isin(*deny))


def retag(notes: DataFrame, old: str = "perovskite_molecule", new: str = MOLECULE_FIELD) -> DataFrame:
    name = F.when(F.col("var_name") == old, F.lit(new)).otherwise(F.col("var_name"))
    return notes.withColumn("var_name", name)


def numbered_relations(relations: DataFrame, number_first: bool = False) -> DataFrame:
    """Drop performance relations and suffix repeated test names with ``_2``.

    Every repeat gets ``_2``. With ``number_first`` the dropped names still
    take part in the numbering.
    """
    plain = ~F.col("test_name").contains("performance")
    counted = relations if number_first else relations.where(plain)
    firsts = counted.groupBy("paper", "test_name").agg(F.min("rel_pos").alias("_first"))
    named = counted.join(firsts, ["paper", "test_name"]).withColumn(
        "test_name",
        F.when(F.col("rel_pos") > F.col("_first"), F.concat("test_name", F.lit("_2"))).otherwise(
            F.col("test_name")
        ),
    )
    return named.drop("_first").where(plain) if number_first else named.drop("_first")


def tests_of_nodes(relations: DataFrame, last_only: bool = False) -> DataFrame:
    """Node to the list of its tests in relation order, or only the last.

    A test is listed once. Repeats combine before the list is gathered, so a
    list holds the distinct test names of one node and no more.
    """
    if last_only:
        return relations.groupBy("paper", "node_id").agg(
            F.max_by("test_name", "rel_pos").alias("test_name")
        )
    once = relations.groupBy("paper", "node_id", "test_name").agg(F.min("rel_pos").alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "test_name")))
    return once.groupBy("paper", "node_id").agg(
        F.transform(ordered, lambda r: r["test_name"]).alias("tests")
    )


def molecules(notes: DataFrame) -> DataFrame:
    """Molecule mentions: ``paper, molecule, node_id, pos``."""
    return notes.where(F.col("var_name") == MOLECULE_FIELD).select(
        "paper", F.col("value").alias("molecule"), "node_id", "pos"
    )


def molecule_counts(notes: DataFrame) -> DataFrame:
    """Distinct molecules per paper (two-step count, no single-task set)."""
    return (
        molecules(notes)
        .select("paper", "molecule")
        .distinct()
        .groupBy("paper")
        .agg(F.count("molecule").alias("n_molecules"))
    )


def champions(notes: DataFrame, tests: DataFrame) -> DataFrame:
    """Per paper the first molecule with a related node, else the first one."""
    mentions = molecules(notes).join(
        tests.select("paper", "node_id", F.lit(True).alias("_rel")), ["paper", "node_id"], "left"
    )
    by_molecule = mentions.groupBy("paper", "molecule").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("node_id", "pos").alias("first_node"),
        F.min_by("node_id", F.when(F.col("_rel"), F.col("pos"))).alias("rel_node"),
    )
    rank = F.struct(F.col("rel_node").isNull(), "first_pos")
    return by_molecule.groupBy("paper").agg(
        F.min_by("molecule", rank).alias("molecule"),
        F.min_by(F.coalesce("rel_node", "first_node"), rank).alias("node_id"),
    )


def _last_writes(writes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last written value per key; a written null counts as a write."""
    return writes.groupBy(*keys).agg(
        F.max_by(F.struct("value"), "pos").getField("value").alias("value")
    )


def records_per_molecule(notes: DataFrame, relations: DataFrame) -> DataFrame:
    """Long records: ``paper, molecule, section, field, value``.

    Top fields belong to the whole paper. Test fields come from the tests the
    molecule shares, or from all tests when it is the only one. Papers
    without a molecule give one row whose molecule is null.
    """
    tests = tests_of_nodes(relations)
    useful = drop_tags(notes)
    top = _last_writes(
        useful.where(F.col("var_name").isin(*TOP_FIELDS)), ["paper", "var_name"]
    ).select("paper", F.lit(TOP).alias("section"), F.col("var_name").alias("field"), "value")
    in_tests = (
        useful.where(~F.col("var_name").isin(*TOP_FIELDS))
        .join(tests, ["paper", "node_id"])
        .select("paper", "pos", "var_name", "value", F.explode("tests").alias("section"))
    )
    in_tests = _last_writes(in_tests, ["paper", "section", "var_name"]).select(
        "paper", "section", F.col("var_name").alias("field"), "value"
    )
    # The tests of a molecule are those of its last related mention.
    owners = (
        molecules(notes)
        .join(tests, ["paper", "node_id"], "left")
        .groupBy("paper", "molecule")
        .agg(F.max_by("tests", F.when(F.col("tests").isNotNull(), F.col("pos"))).alias("own"))
    )
    owners = owners.join(molecule_counts(notes), "paper")
    alone = owners.where("n_molecules <= 1").select("paper", "molecule")
    shared = owners.where("n_molecules > 1").select(
        "paper", "molecule", F.explode(F.array_distinct("own")).alias("section")
    )
    everyone = owners.select("paper", "molecule")
    cells = (
        everyone.join(top, "paper")
        .unionByName(alone.join(in_tests, "paper").select(everyone.columns + top.columns[1:]))
        .unionByName(
            shared.join(in_tests, ["paper", "section"]).select(everyone.columns + top.columns[1:])
        )
    )
    without = (
        notes.select("paper")
        .distinct()
        .join(everyone.select("paper").distinct(), "paper", "left_anti")
        .select(
            "paper",
            *[F.lit(None).cast("string").alias(c) for c in ("molecule", "section", "field", "value")],
        )
    )
    return cells.unionByName(without)


def nested_records(cells: DataFrame, layout: Layout = SEMI_NESTED) -> DataFrame:
    """Rows ``paper, molecule, record`` of long cells: what ``evaluate`` compares.

    Every field of the layout is there, null where nothing was written; a
    section without a known field is a test of nulls. A paper without a
    molecule keeps one row with a null record. First the sections, then the
    records combine, so one record's cells never meet as a whole before they
    are one row.
    """
    keys = ["paper", "molecule"]
    by_section = cells.groupBy(*keys, "section").agg(
        *[
            F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
            for f in dict.fromkeys((*layout.top, *layout.tests))
        ]
    )
    at_top = F.col("section") == TOP
    test = F.struct("section", F.struct(*[F.col(f) for f in layout.tests]).alias("t"))
    gathered = by_section.groupBy(*keys).agg(
        *[F.max(F.when(at_top, F.col(f))).alias(f) for f in layout.top],
        F.collect_list(F.when(F.col("section").isNotNull() & ~at_top, test)).alias("_tests"),
        F.bool_or(F.col("section").isNotNull()).alias("_any"),
    )
    record = F.struct(*layout.top, F.map_from_entries(F.array_sort("_tests")).alias("tests"))
    return gathered.select(*keys, F.when(F.col("_any"), record).alias("record"))


def routed_writes(
    notes: DataFrame, relations: DataFrame, number_first: bool = True
) -> DataFrame:
    """Where every annotation writes: ``paper, passage, pos, section, field, value``.

    Material fields go to the top. With several molecules the molecule and
    performance fields go there only when a test is shared with the champion,
    and are reset to null when the node has no relation at all. Test fields
    follow the relations; everything else lands in the first test.
    """
    tests = tests_of_nodes(numbered_relations(relations, number_first))
    # One row per paper with everything its annotations need to know, so the
    # annotations, of which one paper may hold a third, join on it once.
    papers = (
        champions(notes, tests)
        .select("paper", "node_id")
        .join(tests, ["paper", "node_id"], "left")
        .select("paper", F.col("tests").alias("_own"))
        .join(molecule_counts(notes), "paper", "left")
    )
    placed = (
        drop_tags(notes)
        .join(tests, ["paper", "node_id"], "left")
        .join(papers, "paper", "left")
    )
    several = F.coalesce("n_molecules", F.lit(0)) > 1
    related = F.col("tests").isNotNull()
    own_tests = F.coalesce("_own", F.array().cast("array<string>"))
    shared = F.filter("tests", lambda s: F.array_contains(own_tests, s))
    name = F.col("var_name")
    molecular = name.isin(MOLECULE_FIELD, *PERFORMANCE_FIELDS)

    def target(section: Column, value: Column) -> Column:
        return F.struct(section.alias("section"), value.alias("value"))

    nothing = F.array().cast("array<struct<section:string,value:string>>")
    at_top = F.array(target(F.lit(TOP), F.col("value")))
    reset = F.array(target(F.lit(TOP), F.lit(None).cast("string")))
    followed = F.when(several, shared).otherwise(F.col("tests"))
    routes = (
        F.when(name.isin(*MATERIAL_FIELDS), at_top)
        .when(molecular & ~several, at_top)
        .when(molecular & ~related, reset)
        .when(molecular, F.when(F.size(shared) > 0, at_top).otherwise(nothing))
        .when(
            related & name.isin(*TEST_FIELDS),
            F.transform(followed, lambda s: target(s, F.col("value"))),
        )
        .otherwise(F.array(target(F.lit(DEFAULT_TEST), F.col("value"))))
    )
    return placed.select(
        "paper", "passage", "pos", name.alias("field"), F.explode(routes).alias("_r")
    ).select("paper", "passage", "pos", "_r.section", "field", "_r.value")


def running_records(
    writes: DataFrame, passages: DataFrame, block: int = POSITION_BLOCK
) -> DataFrame:
    """Rows of ``passages`` with the record before and after each as JSON: ``memory, output``.

    A record holds every known field, null where nothing is written, and a
    member for each test that has a value by then. The first memory of a paper
    is the empty record: all fields null, and one empty test.

    Only what was written moves. The passages of a paper are cut into blocks of
    ``block`` positions; a task walks a block in order, from the state that the
    blocks before it leave, and writes a section anew where it has changed.
    """
    keys = ["paper", "section", "field"]
    known = writes.dropna(subset=[*keys, "passage"])
    finals = known.groupBy(*keys, "passage").agg(F.max_by(F.struct("value"), "pos").alias("_w"))
    listed = F.to_json(F.array("_w.value"))
    finals = finals.where("_w is not null").select(
        *keys,
        "passage",
        block_of("passage", block).alias("_blk"),
        F.when(F.col("_w.value").isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2)).alias("json"),
    )
    finals = written(finals, "passage-writes")
    placed = passages.dropna(subset=["paper", "passage"])
    carried = _carried_cells(finals, placed.select("paper", block_of("passage", block).alias("_blk")).distinct())
    cell = [F.col(c) for c in ("section", "field", "json")] + [quoted(F.col(c)).alias(f"{c}_json") for c in ("section", "field")]
    none = [F.lit(None).cast("string").alias(c) for c in ("section", "field", "json", "section_json", "field_json")]
    row = F.struct(*[placed[c] for c in placed.columns])
    rows = placed.select("paper", block_of("passage", block).alias("_blk"), "passage", F.lit(2).alias("kind"), *none, row.alias("row"))
    changes = finals.select("paper", "_blk", "passage", F.lit(1).alias("kind"), *cell)
    starts = carried.select("paper", "_blk", F.lit(None).cast(finals.schema["passage"].dataType).alias("passage"), F.lit(0).alias("kind"), *cell)
    steps = rows.unionByName(changes.unionByName(starts), allowMissingColumns=True)
    ordered = steps.repartition("paper", "_blk").sortWithinPartitions("paper", "_blk", "passage", "kind")
    kind = rows.schema["row"].dataType.simpleString()
    walked = ordered.mapInArrow(_walked, f"row {kind}, memory string, output string")
    return walked.select("row.*", "memory", "output")


def _carried_cells(finals: DataFrame, blocks: DataFrame) -> DataFrame:
    """``paper, _blk, section, field, json``: the cells with a value where a block begins."""
    keys = ["paper", "section", "field"]
    later = blocks.join(
        blocks.groupBy("paper").agg(F.min("_blk").alias("_least"), F.max("_blk").alias("_most")).where("_most > _least"), "paper"
    )
    last = finals.groupBy(*keys, "_blk").agg(F.max_by(F.struct("json"), "passage").alias("_final"))
    every = later.select("paper", "_blk").join(finals.select(*keys).distinct(), "paper")
    earlier = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    return (
        every.join(last, [*keys, "_blk"], "left")
        .select(*keys, "_blk", F.last("_final", ignorenulls=True).over(earlier).getField("json").alias("json"))
        .where("json is not null")
    )


class _Record:
    """The cells written so far, and the record as JSON."""

    def __init__(self) -> None:
        self.top: dict[str, str] = {}
        self.tests: dict[str, dict[str, tuple[str, str]]] = {DEFAULT_TEST: {}}
        self.members: dict[str, str] = {}
        self.names = {DEFAULT_TEST: f'"{DEFAULT_TEST}"'}
        self.changed, self.text = {DEFAULT_TEST}, None

    def write(self, section: str, field: str, json: str | None, name: str, member: str) -> None:
        """A null is a value like any other: it takes away what was there."""
        if section == TOP:
            cells, value = self.top, json
        else:
            cells, value = self.tests.setdefault(section, {}), (member, json)
            self.names[section] = name
            self.changed.add(section)
        if json is None:
            cells.pop(field, None)
        else:
            cells[field] = value
        self.text = None

    def json(self) -> str:
        if self.text is None:
            for section in self.changed:
                cells = self.tests[section]
                if not cells and section != DEFAULT_TEST:
                    self.members.pop(section, None)
                    continue
                body = [f'"{f}":{cells[f][1] if f in cells else "null"}' for f in TEST_FIELDS]
                body += [":".join(cells[f]) for f in sorted(cells) if f not in TEST_FIELDS]
                self.members[section] = f"{self.names[section]}:{{{','.join(body)}}}"
            self.changed = set()
            whole = [f'"{f}":{self.top.get(f, "null")}' for f in TOP_FIELDS]
            self.text = f"{{{','.join([*whole, *(self.members[s] for s in sorted(self.members))])}}}"
        return self.text


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carried cells, writes and passages, in the order of their blocks, to the records around each passage."""
    own = at = before = None
    record = _Record()
    for whole in batches:
        for first in range(0, whole.num_rows, WALKED_ROWS):
            batch = whole.slice(first, WALKED_ROWS)
            steps = zip(*(batch.column(c).to_pylist() for c in _STEP), strict=True)
            rows, memories, outputs = [], [], []
            for i, (paper, blk, passage, kind, *cell) in enumerate(steps):
                if own != (paper, blk):
                    own, at, record = (paper, blk), None, _Record()
                if kind and at != passage:
                    at, before = passage, record.json()
                if kind < 2:
                    record.write(*cell)
                else:
                    rows.append(i)
                    memories.append(before)
                    outputs.append(record.json())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(rows, pa.int64())), pa.array(memories, pa.string()), pa.array(outputs, pa.string())],
                names=["row", "memory", "output"],
            )


_STEP = ("paper", "_blk", "passage", "kind", "section", "field", "json", "section_json", "field_json")


def chunk_examples(states: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """Training rows ``id, text, memory, output`` of ``running_records``.

    ``passages`` gives the texts where the states do not hold them themselves.
    """
    if passages is not None:
        states = passages.join(states.select("paper", "passage", "memory", "output").distinct(), ["paper", "passage"])
    return states.select(F.concat_ws("_", "paper", "passage").alias("id"), "text", "memory", "output")


def split_chunk_id(chunk_id: Column) -> Column:
    """``"prefix:12_3"`` to a struct of paper 12 and chunk 3."""
    paper = F.substring_index(chunk_id, "_", 1)
    return F.struct(
        F.substring_index(paper, ":", -1).try_cast("int").alias("first_num"),
        F.substring_index(chunk_id, "_", -1).try_cast("int").alias("second_num"),
    )


def last_record_per_paper(chunks: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    return last_values(chunks, key, order, columns)


def misannotated_papers(notes: DataFrame, tests: DataFrame) -> DataFrame:
    """Papers that name molecules, none of them in a relation."""
    mentions = molecules(notes).join(
        tests.select("paper", "node_id", F.lit(True).alias("_rel")), ["paper", "node_id"], "left"
    )
    found = mentions.groupBy("paper").agg(F.coalesce(F.bool_or("_rel"), F.lit(False)).alias("ok"))
    return found.where("not ok").select("paper")


def unrelated_measurements(notes: DataFrame, tests: DataFrame) -> DataFrame:
    """In well annotated papers with several molecules, the performance nodes
    that no relation mentions."""
    several = molecule_counts(notes).where("n_molecules > 1").select("paper")
    good = several.join(misannotated_papers(notes, tests), "paper", "left_anti")
    return (
        notes.where(F.col("var_name").isin(*PERFORMANCE_FIELDS))
        .select("paper", "node_id")
        .join(tests.select("paper", "node_id"), ["paper", "node_id"], "left_anti")
        .join(good, "paper", "left_semi")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of non-null values; sort where the table is shown."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def search_chunks(chunks: DataFrame, prefix: str, needle: str) -> DataFrame:
    return chunks.where(F.col("id").startswith(prefix) & F.col("text").contains(needle))


def with_current_molecule(notes: DataFrame, block: int = POSITION_BLOCK) -> DataFrame:
    """Molecule each annotation belongs to: its own when it names one, else
    the one introduced last. Annotations before any molecule are dropped."""
    first = molecules(notes).groupBy("paper", F.col("molecule").alias("value")).agg(
        F.min("pos").alias("_first")
    )
    marked = notes.join(first, ["paper", "value"], "left").withColumn(
        "_new",
        F.when(
            (F.col("var_name") == MOLECULE_FIELD) & (F.col("pos") == F.col("_first")),
            F.col("value"),
        ),
    )
    carried = running_last(marked, ["paper"], "pos", F.col("_new"), "_cur", block=block)
    own = F.when(F.col("var_name") == MOLECULE_FIELD, F.col("value")).otherwise(F.col("_cur"))
    return (
        carried.withColumn("molecule", own).drop("_new", "_first", "_cur").where("molecule is not null")
    )


def records_by_order(notes: DataFrame, relations: DataFrame, block: int = POSITION_BLOCK) -> DataFrame:
    """Long records of the order-based parser: ``paper, molecule, section,
    field, value``. Material fields also go to the top; every annotation goes
    to its tests, or to the first test when it has none."""
    deny = [t for t in IGNORED_TAGS if t != "perovskite_molecule"]
    tests = tests_of_nodes(relations)
    placed = with_current_molecule(drop_tags(notes, deny), block).join(
        tests, ["paper", "node_id"], "left"
    )
    sections = F.coalesce("tests", F.array(F.lit(DEFAULT_TEST)))
    sections = F.when(
        F.col("var_name").isin(*MATERIAL_FIELDS), F.concat(F.array(F.lit(TOP)), sections)
    ).otherwise(sections)
    writes = placed.select(
        "paper",
        "molecule",
        "pos",
        "value",
        F.col("var_name").alias("field"),
        F.explode(sections).alias("section"),
    )
    return _last_writes(writes, ["paper", "molecule", "section", "field"])
