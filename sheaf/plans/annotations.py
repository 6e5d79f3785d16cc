"""Queries over annotation graphs, derived from the event log.

An event becomes an annotation of the paper ``user_id``; its tag and value
follow from its id, and most events take part in a relation of their passage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import annotations as K
from sheaf.operators import evaluation as E
from sheaf.plans.registry import Tables, query
from sheaf.schemas import IGNORED_TAGS, MATERIAL_FIELDS, PERFORMANCE_FIELDS, TEST_FIELDS, TOP_FIELDS

_TAGS = (
    *MATERIAL_FIELDS,
    *PERFORMANCE_FIELDS,
    *TEST_FIELDS,
    "metal_contact",
    "perovskite_molecule",
)
_TAG_CASE = (
    "case when event_id % 7 = 3 and user_id % 9 <> 0 then 'passivating_molecule' else case event_id % "
    + str(len(_TAGS))
    + " "
    + " ".join(f"when {i} then '{tag}'" for i, tag in enumerate(_TAGS))
    + " end end"
)

NOTES = f"""
select user_id as paper, passage, event_id as pos, cast(event_id as string) as node_id, var_name,
       case when event_id % 5 = 0 then null
            when var_name = 'passivating_molecule' then 'mol' || (event_id % 3 * (user_id % 2))
            else event_type || (event_id % 11) end as identifier,
       event_type as text
from (select event_id, user_id, event_type, cast(floor(event_id / 400) as bigint) as passage,
             {_TAG_CASE} as var_name from @events)
"""
RELATIONS = """
select user_id as paper, cast(floor(event_id / 400) as bigint) * 6 + event_id % 6 as rel_pos,
       case event_id % 6 when 0 then 'test_1' when 1 then 'test_2' when 2 then 'test_3' when 3 then 'test_1'
            else 'performance_' || event_id % 6 end as test_name,
       cast(event_id as string) as node_id
from @events
union all
select user_id, 100000000 + cast(floor(event_id / 400) as bigint) * 2 + cast(event_id % 10 = 1 as int),
       case when event_id % 10 = 1 then 'test_9' else 'performance_9' end, cast(event_id as string)
from @events
"""

_IGNORED = ", ".join(f"'{t}'" for t in IGNORED_TAGS)
_TOP = ", ".join(f"'{t}'" for t in TOP_FIELDS)
_MATERIAL = ", ".join(f"'{t}'" for t in MATERIAL_FIELDS)
_PERF = ", ".join(f"'{t}'" for t in PERFORMANCE_FIELDS)
_TESTF = ", ".join(f"'{t}'" for t in TEST_FIELDS)

_BASE = f"""
notes0 as ({NOTES}),
notes as (select *, coalesce(identifier, text) as value from notes0),
rel0 as ({RELATIONS}),
rel as (select paper, rel_pos, node_id,
               case when rel_pos > min(rel_pos) over (partition by paper, test_name)
                    then test_name || '_2' else test_name end as test_name
        from rel0 where test_name not like '%performance%'),
mols as (select paper, value as molecule, node_id, pos from notes where var_name = 'passivating_molecule'),
nmol as (select paper, count(distinct molecule) as n_molecules from mols group by paper),
reln as (select distinct paper, node_id from rel),
champ0 as (select m.paper, molecule, min(pos) as first_pos, arg_min(m.node_id, pos) as first_node,
                  arg_min(m.node_id, pos) filter (where r.node_id is not null) as rel_node
           from mols m left join reln r on m.paper = r.paper and m.node_id = r.node_id group by all),
champ as (select paper, molecule, coalesce(rel_node, first_node) as node_id from champ0
          qualify row_number() over (partition by paper order by rel_node is null, first_pos) = 1)
"""


def _notes(t: Tables):
    return K.with_value(t.derive(NOTES))


def _relations(t: Tables):
    return t.derive(RELATIONS)


def _tests(t: Tables):
    return K.tests_of_nodes(K.numbered_relations(_relations(t)))


@query("k1_annotation_value", f"with {_BASE} select node_id, value from notes")
def _(t: Tables):
    return _notes(t).select("node_id", "value")


@query(
    "k2_drop_tags",
    f"with {_BASE} select var_name, count(*) as n from notes where var_name not in ({_IGNORED}) group by 1",
)
def _(t: Tables):
    return K.drop_tags(_notes(t)).groupBy("var_name").agg(F.count("*").alias("n"))


@query(
    "k3_retag",
    f"""with {_BASE} select case when var_name = 'perovskite_molecule' then 'passivating_molecule'
        else var_name end as var_name, count(*) as n from notes group by 1""",
)
def _(t: Tables):
    return K.retag(_notes(t)).groupBy("var_name").agg(F.count("*").alias("n"))


@query(
    "k4_numbered_relations",
    f"with {_BASE} select paper, rel_pos, test_name, node_id from rel",
)
def _(t: Tables):
    return K.numbered_relations(_relations(t)).select("paper", "rel_pos", "test_name", "node_id")


@query(
    "k5_tests_of_nodes",
    f"""with {_BASE} select paper, node_id, string_agg(test_name, ',' order by rel_pos) as tests,
        arg_max(test_name, rel_pos) as last_test from rel group by paper, node_id""",
)
def _(t: Tables):
    relations = K.numbered_relations(_relations(t))
    last = K.tests_of_nodes(relations, last_only=True).withColumnRenamed("test_name", "last_test")
    listed = K.tests_of_nodes(relations).withColumn("tests", F.array_join("tests", ","))
    return listed.join(last, ["paper", "node_id"])


_CELLS = f"""
top as (select paper, 'top' as section, var_name as field, arg_max(value, pos) as value
            from notes where var_name in ({_TOP}) group by paper, var_name),
    cells as (select n.paper, r.test_name as section, n.var_name as field, arg_max(n.value, n.pos) as value
              from notes n join rel r on n.paper = r.paper and n.node_id = r.node_id
              where n.var_name not in ({_TOP}) and n.var_name not in ({_IGNORED})
              group by all),
    lastnode as (select m.paper, m.molecule, arg_max(m.node_id, m.pos) as node_id
                 from mols m join reln r on m.paper = r.paper and m.node_id = r.node_id group by all),
    own as (select distinct l.paper, l.molecule, r.test_name from lastnode l
            join rel r on l.paper = r.paper and l.node_id = r.node_id),
    everyone as (select distinct paper, molecule, n_molecules from mols join nmol using (paper)),
cells_of as (
    select paper, molecule, section, field, value from everyone join top using (paper)
    union all select e.paper, e.molecule, section, field, value from everyone e join cells using (paper)
      where n_molecules <= 1
    union all select e.paper, e.molecule, section, field, value from everyone e
      join own o on o.paper = e.paper and o.molecule = e.molecule
      join cells c on c.paper = e.paper and c.section = o.test_name where n_molecules > 1
    union all select distinct paper, null, null, null, null from notes
      where paper not in (select paper from mols))
"""


@query(
    "k6_records_per_molecule",
    f"with {_BASE}, {_CELLS} select * from cells_of",
)
def _(t: Tables):
    return K.records_per_molecule(_notes(t), K.numbered_relations(_relations(t)))


@query(
    "k6_nested_records",
    f"""with {_BASE}, {_CELLS},
    sections as (select paper, molecule, section,
                        {', '.join(f"max(value) filter (where field = '{f}') as {f}" for f in TEST_FIELDS)}
                 from cells_of where section <> 'top' group by all),
    tests as (select paper, molecule, string_agg('"' || section || '":' || to_json({{
                     {', '.join(f"'{f}': {f}" for f in TEST_FIELDS)} }}), ',' order by section) as body
              from sections group by all),
    tops as (select paper, molecule, to_json({{ {', '.join(f"'{f}': max(value) filter (where section = 'top' and field = '{f}')" for f in TOP_FIELDS)} }}) as body
             from cells_of where molecule is not null group by all)
    select p.paper, p.molecule, left(p.body, length(p.body) - 1) || ',"tests":{{' || coalesce(t.body, '') || '}}}}' as record
    from tops p left join tests t on p.paper = t.paper and p.molecule = t.molecule
    union all select paper, null, null from cells_of where molecule is null""",
)
def _(t: Tables):
    cells = K.records_per_molecule(_notes(t), K.numbered_relations(_relations(t)))
    record = F.to_json("record", {"ignoreNullFields": "false"})
    return K.nested_records(cells).select("paper", "molecule", record.alias("record"))


@query("k_annotations_to_macro_f1")
def _(t: Tables):
    """From annotation graphs to one score: surface texts of the champion against all values."""
    relations = K.numbered_relations(_relations(t))
    labels = K.nested_records(K.records_per_molecule(_notes(t), relations)).where("molecule is not null")
    order = F.conv(F.substring(F.md5("molecule"), 1, 8), 16, 10).cast("long")
    texts = K.with_value(t.derive(NOTES), text_only=True)
    found = K.nested_records(K.records_per_molecule(texts, relations))
    champion = K.champions(texts, K.tests_of_nodes(relations)).select("paper", "molecule")
    scores = E.evaluate(
        labels.select("paper", order.alias("pos"), "record"),
        found.join(champion, ["paper", "molecule"]).select("paper", "record"),
    )
    macro = E.macro_f1(scores.withColumn("model", F.lit("surface text")))
    return macro.withColumn("macro_f1", F.round("macro_f1", 9))


@query("k7_molecule_counts", f"with {_BASE} select * from nmol")
def _(t: Tables):
    return K.molecule_counts(_notes(t))


@query("k8_champion_molecule", f"with {_BASE} select * from champ")
def _(t: Tables):
    return K.champions(_notes(t), _tests(t))


_ROUTED = f"""
own as (select c.paper, r.test_name from champ c join rel r on c.paper = r.paper and c.node_id = r.node_id),
kept as (select n.*, coalesce(n_molecules, 0) as n_molecules, r.node_id is not null as related
         from notes n left join nmol using (paper)
         left join reln r on n.paper = r.paper and n.node_id = r.node_id
         where var_name not in ({_IGNORED})),
bytest as (select k.*, r.test_name, r.test_name in (select o.test_name from own o where o.paper = k.paper) as shared
           from kept k join rel r on k.paper = r.paper and k.node_id = r.node_id),
writes as (
  select paper, passage, pos, 'top' as section, var_name as field, value from kept
    where var_name in ({_MATERIAL})
       or (var_name in ('passivating_molecule', {_PERF}) and n_molecules <= 1)
  union all select paper, passage, pos, 'top', var_name, null from kept
    where var_name in ('passivating_molecule', {_PERF}) and n_molecules > 1 and not related
  union all select distinct paper, passage, pos, 'top', var_name, value from bytest
    where var_name in ('passivating_molecule', {_PERF}) and n_molecules > 1 and shared
  union all select paper, passage, pos, test_name, var_name, value from bytest
    where var_name in ({_TESTF}) and (n_molecules <= 1 or shared)
  union all select paper, passage, pos, 'test_1', var_name, value from kept
    where var_name not in ({_TOP}) and not (related and var_name in ({_TESTF})))
"""


def _writes(t: Tables):
    # The base relations of these queries number names after dropping some.
    return K.routed_writes(_notes(t), _relations(t), number_first=False)


@query(
    "k10_routed_writes",
    f"with {_BASE}, {_ROUTED} select paper, passage, pos, section, field, value from writes",
)
def _(t: Tables):
    return _writes(t)


_PASSAGES = "passages as (select distinct paper, passage from notes)"
_STATE = f"""
{_PASSAGES},
finals as (select paper, section, field, passage, arg_max({{'v': value}}, pos) as w from writes group by all),
grid as (select p.paper, p.passage, f.section, f.field from passages p
         join (select distinct paper, section, field from finals) f using (paper)),
state as (select g.*, last_value(w ignore nulls) over (partition by paper, section, field order by passage) as a,
                 last_value(w ignore nulls) over (partition by paper, section, field order by passage
                      rows between unbounded preceding and 1 preceding) as b
          from grid g left join finals using (paper, section, field, passage))
"""


def _object(fields, value: str) -> str:
    """A JSON object of the fields, each the only value written under its name."""
    return "to_json({" + ", ".join(f"'{f}': max({value}) filter (where field = '{f}')" for f in fields) + "})"


@query(
    "k9_running_records",
    f"""with {_BASE}, {_ROUTED}, {_STATE},
    cells as (select paper, passage, section, field, a.v as o, b.v as m from state
              union all select paper, passage, unnest(['top', 'test_1']), null, null, null from passages),
    tests as (select paper, passage, section, {_object(TEST_FIELDS, 'm')} as m, {_object(TEST_FIELDS, 'o')} as o,
                     count(m) > 0 or section = 'test_1' as has_m, count(o) > 0 or section = 'test_1' as has_o
              from cells where section <> 'top' group by paper, passage, section),
    listed as (select paper, passage, coalesce(string_agg(',"' || section || '":' || m, '' order by section) filter (where has_m), '') as m,
                      coalesce(string_agg(',"' || section || '":' || o, '' order by section) filter (where has_o), '') as o
               from tests group by all),
    tops as (select paper, passage, {_object(TOP_FIELDS, 'm')} as m, {_object(TOP_FIELDS, 'o')} as o
             from cells where section = 'top' group by all)
    select paper || '_' || passage as id, left(t.m, length(t.m) - 1) || l.m || '}}' as memory,
           left(t.o, length(t.o) - 1) || l.o || '}}' as output
    from tops t join listed l using (paper, passage)""",
)
def _(t: Tables):
    notes = _notes(t)
    passages = notes.select("paper", "passage").distinct().withColumn("text", F.lit(""))
    return K.chunk_examples(K.running_records(_writes(t), passages)).select("id", "memory", "output")


@query(
    "k11_split_chunk_id",
    """select distinct conv_id as first_num, turn as second_num, 'p:' || conv_id || '_' || turn as id
       from @conversations""",
)
def _(t: Tables):
    ids = t.conversations.select(F.concat(F.lit("p:"), "conv_id", F.lit("_"), "turn").alias("id"))
    parts = ids.distinct().select("id", K.split_chunk_id(F.col("id")).alias("p"))
    return parts.select(
        "id", F.col("p.first_num").cast("long").alias("first_num"), F.col("p.second_num").cast("long").alias("second_num")
    )


@query(
    "k12_last_record",
    """select conv_id, arg_max(role, turn) as role, arg_max(md5(text), turn) as text_md5,
              arg_max(length(text), turn) filter (where turn % 3 <> 2) as n_chars
       from @conversations group by conv_id""",
)
def _(t: Tables):
    turns = t.conversations.select(
        "conv_id",
        "turn",
        "role",
        F.md5("text").alias("text_md5"),
        F.when(F.col("turn") % 3 != 2, F.length("text")).alias("n_chars"),
    )
    out = K.last_record_per_paper(turns, "conv_id", "turn", ["role", "text_md5", "n_chars"])
    return out.withColumn("n_chars", F.col("n_chars").cast("long"))


_AUDIT = """
bad as (select m.paper from mols m left join reln r on m.paper = r.paper and m.node_id = r.node_id
        group by m.paper having count(r.node_id) = 0)
"""


@query(
    "k13_annotation_audit",
    f"""with {_BASE}, {_AUDIT}
    select 'no related molecule' as finding, paper, null as node_id from bad
    union all
    select 'unrelated measurement', n.paper, n.node_id from notes n
    where var_name in ({_PERF}) and paper in (select paper from nmol where n_molecules > 1)
      and paper not in (select paper from bad)
      and not exists (select 1 from reln r where r.paper = n.paper and r.node_id = n.node_id)""",
)
def _(t: Tables):
    notes, tests = _notes(t), _tests(t)
    papers = K.misannotated_papers(notes, tests).select(
        F.lit("no related molecule").alias("finding"), "paper", F.lit(None).cast("string").alias("node_id")
    )
    nodes = K.unrelated_measurements(notes, tests).select(
        F.lit("unrelated measurement").alias("finding"), "paper", "node_id"
    )
    return papers.unionByName(nodes)


@query(
    "k14_value_counts",
    f"""with {_BASE} select value, count(*) as n from notes where value is not null group by value""",
)
def _(t: Tables):
    return K.value_counts(_notes(t), "value")


@query(
    "k15_search_chunks",
    """select conv_id || '_' || turn as id, md5(text) as text_md5 from @conversations
       where starts_with(conv_id || '_' || turn, '1') and contains(text, 'tion')""",
)
def _(t: Tables):
    chunks = t.conversations.select(F.concat_ws("_", "conv_id", "turn").alias("id"), "text")
    return K.search_chunks(chunks, "1", "tion").select("id", F.md5("text").alias("text_md5"))


@query(
    "k16_records_by_order",
    f"""with {_BASE},
    firsts as (select paper, molecule, min(pos) as first_pos from mols group by all),
    kept as (select n.*, f.molecule as new from notes n
             left join firsts f on n.paper = f.paper and n.pos = f.first_pos and n.var_name = 'passivating_molecule'
             where var_name not in ('additive_molecule', 'treatment_element', 'control_element', 'metal_contact')),
    cur as (select *, case when var_name = 'passivating_molecule' then value else
              last_value(new ignore nulls) over (partition by paper order by pos) end as molecule from kept),
    own as (select * from cur where molecule is not null),
    writes as (
      select paper, molecule, pos, 'top' as section, var_name as field, value from own where var_name in ({_MATERIAL})
      union all select o.paper, molecule, pos, coalesce(test_name, 'test_1'), var_name, value
      from own o left join rel r on o.paper = r.paper and o.node_id = r.node_id)
    select paper, molecule, section, field, arg_max(value, pos) as value from writes
    group by paper, molecule, section, field""",
)
def _(t: Tables):
    return K.records_by_order(_notes(t), K.numbered_relations(_relations(t)), block=64)
