"""Queries over extraction quality, with records derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import outcomes as O
from sheaf.functions.similarity import with_text_similarity
from sheaf.operators import evaluation as E
from sheaf.operators import records as C
from sheaf.plans.registry import Tables, query
from sheaf.schemas import (
    FULLY_NESTED,
    IRRELEVANT_PAPERS,
    POORLY_ANNOTATED_PAPERS,
    TEST_FIELDS,
    WEIGHTED_FIELDS,
    WEIGHTINGS,
)

# One annotation per order, its paper is the customer; type names either
# agree or share no letter, so their ratio is 1 or 0 in any engine.
ANNOTATIONS = """
select o_custkey as paper, o_orderkey as pos,
  case when o_orderkey % 13 = 0 then null else
  '{"perovskite_composition": "' || o_orderpriority || '", "electron_transport_layer": "buckminsterfullerene"'
  || ', "structure_pin_nip": null' || case when o_orderkey % 4 = 0 then ', "hole_transport_layer": "spiro"' else '' end
  || case when o_orderkey % 7 = 0 then '' else ', "passivating_molecule": "' || o_orderstatus || '"' end
  || ', "control_pce": "' || (o_orderkey % 30) || '.5 %", "treated_pce": ' || (o_orderkey % 30 + 1)
  || ', "test_1": {"stability_type": "' || case when o_orderkey % 2 = 0 then 'aaa' else 'bbb' end
  || '", "time": "' || (o_orderkey % 900 + 100) || ' h", "temperature": "' || (o_orderkey % 60 + 20)
  || '", "humidity": "50-60", "efficiency_tret": "' || (o_orderkey % 90 + 1) || '"}'
  || case when o_orderkey % 3 = 0 then ', "test_2": {"stability_type": "bbb", "time": "' || (o_orderkey % 70)
          || '", "temperature": "85+-5", "humidity": null, "efficiency_cont": "0.9"}' else '' end
  || '}' end as record
from @orders
"""
EXTRACTIONS = """
select c_custkey as paper,
  '{"perovskite_composition": "' || c_mktsegment || '", "electron_transport_layer": "C60", "passivating_molecule": "'
  || case when c_custkey % 2 = 0 then 'F' else 'O' end || '", "control_pce": ' || (c_custkey % 30)
  || case when c_custkey % 5 = 0 then '' else
     ', "test_1": {"stability_type": "aaa", "time": "' || (c_custkey % 900 + 100) || ' h", "temperature": "'
     || (c_custkey % 60 + 20) || '", "humidity": "' || (c_custkey % 40 + 30) || '", "efficiency_tret": "'
     || (c_custkey % 90 + 1) || '"}, "test_2": {"stability_type": "bbb", "time": "' || (c_custkey % 70)
     || '", "temperature": "' || (c_custkey % 20 + 75) || '", "efficiency_cont": "0.91"}' end
  || '}' as record
from @customer
"""


def _records(t: Tables, sql: str):
    rows = C.conformed(t.derive(sql), "record")
    return rows.withColumn("record", F.when(F.col("record").isNotNull(), F.col("conformed"))).drop(
        "conformed", "extra"
    )


def _annotations(t: Tables):
    return _records(t, ANNOTATIONS)


def _extractions(t: Tables):
    return _records(t, EXTRACTIONS)


_DENY = ", ".join(str(p) for p in (*IRRELEVANT_PAPERS, *POORLY_ANNOTATED_PAPERS))


@query(
    "e1_evaluated_papers",
    f"select o_orderkey, o_custkey as paper from @orders where o_custkey between 0 and 149 and o_custkey not in ({_DENY})",
)
def _(t: Tables):
    return E.evaluated_papers(t.orders.select("o_orderkey", F.col("o_custkey").alias("paper")))


@query(
    "e2_flattened_papers",
    """select conv_id * 100 + turn as paper, 'mol_' || role as molecule, md5(text) as record
       from @conversations where turn % 5 <> 0
       union all select conv_id * 100 + turn, 'other', 'x' from @conversations where turn % 5 <> 0
       union all select conv_id * 100 + turn, null, null from @conversations where turn % 5 = 0""",
)
def _(t: Tables):
    both = F.create_map(
        F.concat(F.lit("mol_"), "role"), F.md5("text"), F.lit("other"), F.lit("x")
    )
    rows = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("paper"),
        F.when(F.col("turn") % 5 != 0, both).alias("records"),
    )
    return E.flatten_papers(rows).withColumn("paper", F.col("paper").cast("long"))


@query(
    "e3_records_with_molecule",
    "select o_orderkey as pos from @orders where o_orderkey % 13 <> 0 and o_orderkey % 7 <> 0",
)
def _(t: Tables):
    return E.with_molecule(_annotations(t)).select("pos")


@query(
    "e4_coerced_numbers",
    """select o_orderkey as pos,
         regexp_replace(substr((o_orderkey % 30) || '.5 %', 1, 4), '[^0-9.]', '', 'g') as control_pce,
         regexp_replace(substr((o_orderkey % 900 + 100) || ' h', 1, 4), '[^0-9.]', '', 'g') as time,
         '50-60' as humidity, cast(o_orderkey % 90 + 1 as varchar) as efficiency_tret
       from @orders where o_orderkey % 13 <> 0""",
)
def _(t: Tables):
    rows = _annotations(t).withColumn("record", E.coerce_numbers(F.col("record"))).where("record is not null")
    test = F.col("record.tests")["test_1"]
    return rows.select(
        "pos",
        F.col("record.control_pce").alias("control_pce"),
        test["time"].alias("time"),
        test["humidity"].alias("humidity"),
        test["efficiency_tret"].alias("efficiency_tret"),
    )


@query(
    "e5_top_numbers",
    """select c_custkey as paper, cast(c_custkey % 30 as double) as control_pce,
              cast(null as double) as treated_pce, cast(null as double) as control_voc,
              cast(null as double) as treated_voc from @customer""",
)
def _(t: Tables):
    return _extractions(t).select("paper", *E.top_numbers(F.col("record")))


@query(
    "e6_null_template",
    """select o_orderkey as pos, o_orderkey % 13 = 0 as missing,
              case when o_orderkey % 13 = 0 then 1 when o_orderkey % 3 = 0 then 2 else 1 end as n_tests,
              case when o_orderkey % 13 = 0 then null else cast(o_orderkey % 30 + 1 as varchar) end as treated_pce
       from @orders""",
)
def _(t: Tables):
    rows = _annotations(t).withColumn("missing", F.col("record").isNull())
    template = C.null_record()
    filled = rows.withColumn("record", F.coalesce("record", template))
    return filled.select(
        "pos", "missing", F.size("record.tests").alias("n_tests"), F.col("record.treated_pce").alias("treated_pce")
    )


LENIENT = """
select event_id, case event_id % 4 when 0 then '{"a": None, "b": "' || event_type || '"}' when 1 then props
  when 2 then '{"a": ' || event_type || '}' else null end as s from @events
"""


@query(
    "e7_lenient_records",
    f"""with l as ({LENIENT}), r as (select event_id, replace(s, 'None', 'null') as f from l)
        select event_id, case when json_valid(f) then f end as record from r""",
)
def _(t: Tables):
    return C.lenient_records(t.derive(LENIENT), "s").select("event_id", "record")


@query(
    "e8_molecule_in_tests",
    """select conv_id, turn, case when turn % 2 = 0 then role else 'paper' || conv_id end as molecule from @conversations""",
)
def _(t: Tables):
    own = F.create_map(F.lit("time"), F.lit("1"), F.lit("passivating_molecule"), F.col("role"))
    bare = F.create_map(F.lit("time"), F.lit("1"))
    tests = F.create_map(F.lit("test_1"), F.when(F.col("turn") % 2 == 0, own).otherwise(bare))
    pushed = E.push_molecule(tests, F.concat(F.lit("paper"), "conv_id"))
    return t.conversations.select(
        "conv_id", "turn", pushed["test_1"]["passivating_molecule"].alias("molecule")
    )


@query(
    "e9_efficiency_fractions",
    """select o_orderkey as pos, round(case when o_orderkey % 90 + 1 > 1 then (o_orderkey % 90 + 1) / 100.0::double
              else 1.0::double end, 9) as efficiency_tret
       from @orders where o_orderkey % 13 <> 0""",
)
def _(t: Tables):
    rows = _annotations(t).where("record is not null")
    tests = E.efficiency_fractions(F.col("record.tests"))
    value = tests["test_1"]["efficiency_tret"].cast("double")
    return rows.select("pos", F.round(value, 9).alias("efficiency_tret"))


@query(
    "e10_blanked_records",
    """select o_orderkey as pos, case when o_orderkey % 3 = 0 then 2 else 1 end as n_tests, true as is_blank
       from @orders where o_orderkey % 13 <> 0""",
)
def _(t: Tables):
    rows = _annotations(t).where("record is not null").select("pos", E.blanked(F.col("record")).alias("b"))
    leaves = [F.col("b.tests")["test_1"][f].isNull() for f in TEST_FIELDS]
    blank = F.col("b.control_pce").isNull() & F.col("b.passivating_molecule").isNull()
    for leaf in leaves:
        blank = blank & leaf
    return rows.select("pos", F.size("b.tests").alias("n_tests"), blank.alias("is_blank"))


@query(
    "e11_joined_papers",
    """select o_custkey as paper, count(*) as n, max(o_orderkey) as last_pos from @orders
       join @customer on o_custkey = c_custkey group by 1""",
)
def _(t: Tables):
    pairs = E.paired(_annotations(t), _extractions(t))
    return pairs.groupBy("paper").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query("e12_text_similarity")
def _(t: Tables):
    pairs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderpriority", "c_mktsegment"
    )
    scored = with_text_similarity(pairs, "o_orderpriority", "c_mktsegment")
    return scored.select("o_orderkey", F.round("similarity", 6).alias("similarity"))


# Runs of one letter: their ratio is twice the shorter over both lengths.
RUNS = """
select o_orderkey as k, case when o_orderkey % 11 = 0 then null else repeat('A', cast(o_orderkey % 6 + 1 as int)) end as a,
       case when o_custkey % 5 = 0 then null when o_custkey % 7 = 0 then repeat('b', cast(o_custkey % 4 + 1 as int))
            else repeat('a', cast(o_custkey % 9 + 1 as int)) end as b from @orders
"""


@query(
    "e12_similarity_of_runs",
    f"""with r as ({RUNS}) select k, round(case when a is null or b is null or b like 'b%' then 0.0::double
        else 2.0::double * least(length(a), length(b)) / (length(a) + length(b)) end, 9) as similarity from r""",
)
def _(t: Tables):
    scored = with_text_similarity(t.derive(RUNS), "a", "b")
    return scored.select("k", F.round("similarity", 9).alias("similarity"))


@query(
    "e13_best_annotation",
    """select o_custkey as paper, o_orderkey as pos, (o_orderkey * 7 % 10) / 10.0::double as similarity from @orders
       qualify row_number() over (partition by o_custkey order by o_orderkey * 7 % 10 desc, o_orderkey) = 1""",
)
def _(t: Tables):
    rows = t.orders.select(
        F.col("o_custkey").alias("paper"),
        F.col("o_orderkey").alias("pos"),
        ((F.col("o_orderkey") * 7 % 10) / 10.0).alias("similarity"),
    )
    return E.best_per_key(rows, "paper", "similarity", "pos")


def _matched(t: Tables, found: bool | None = None):
    """Matched tests; ``found`` keeps papers with (or without) extracted tests.

    The choice is made on the input: a filter on the match itself would be
    pushed below it and compute every score twice.
    """
    annotations, extractions = _annotations(t).where("record is not null"), _extractions(t)
    if found is not None:
        some = F.size("record.tests") > 0
        extractions = extractions.where(some if found else ~some)
    extractions = extractions.withColumn("record", E.coerce_numbers(F.col("record")))
    # Numbers of an extraction are read once, not for each annotation of its paper.
    extractions = extractions.withColumn("entries", E.test_entries(F.col("record.tests")))
    pairs = E.paired(annotations, extractions)
    pairs = pairs.withColumn("annotation", E.coerce_numbers(F.col("annotation")))
    tests = pairs.select(
        "paper", "pos", F.col("annotation.tests").alias("l"), F.col("extracted.tests").alias("e"), "annotation_test_keys", "entries"
    )
    return E.matched_tests(tests, ["paper", "pos"], "l", "e", label_keys="annotation_test_keys", entries="entries")


# Number fields of a test; a null entry is a text, a missing value is 0.
_COSINE = """list_sum(list_transform({z}, lambda p: p[1] * p[2])) /
  nullif(sqrt(list_sum(list_transform({z}, lambda p: p[1] * p[1]))) * sqrt(list_sum(list_transform({z}, lambda p: p[2] * p[2]))), 0)"""
_Z = "list_filter(list_zip(l.nums, e.nums), lambda p: p[1] is not null and p[2] is not null)"
_MATCHED = f"""
pairs as (select o_orderkey as k, o_custkey as c from @orders join @customer on o_custkey = c_custkey
          where o_orderkey % 13 <> 0),
labels1 as (
  select k, c, 'test_1' as test, case when k % 2 = 0 then 'aaa' else 'bbb' end as type, k % 60 + 20 as temperature,
         k % 900 + 100 as time, null as tol, '50-60' as humidity, 0.0::double as cont, k % 90 + 1.0::double as tret,
         [k % 60 + 20, k % 900 + 100, null, 0, k % 90 + 1]::double[] as nums from pairs
  union all
  select k, c, 'test_2', 'bbb', null, k % 70, 85, null, 0.9, 0, [null, k % 70, 0, 0.9, 0]::double[] from pairs where k % 3 = 0),
found as (
  select c_custkey as c, 0 as place, 'test_1' as test, 'aaa' as type, c_custkey % 60 + 20 as temperature,
         c_custkey % 900 + 100 as time, c_custkey % 40 + 30 as humidity, 0.0::double as cont, c_custkey % 90 + 1.0::double as tret,
         [c_custkey % 60 + 20, c_custkey % 900 + 100, c_custkey % 40 + 30, 0, c_custkey % 90 + 1]::double[] as nums
  from @customer where c_custkey % 5 <> 0
  union all
  select c_custkey, 1, 'test_2', 'bbb', c_custkey % 20 + 75, c_custkey % 70, 0, 0.91, 0,
         [c_custkey % 20 + 75, c_custkey % 70, 0, 0.91, 0]::double[] from @customer where c_custkey % 5 <> 0),
scored as (
  select l.k, l.c, l.test, e.test as extracted_test, e.place,
         (case when l.type = e.type then 1 else 0 end + coalesce({_COSINE.format(z=_Z)}, 0)) / 2 as score,
         l.type as l_type, e.type as e_type, l.temperature as l_temp, l.tol as l_tol, e.temperature as e_temp, l.time as l_time,
         e.time as e_time, l.humidity as l_hum, e.humidity as e_hum, l.cont as l_cont, e.cont as e_cont,
         l.tret as l_tret, e.tret as e_tret
  from labels1 l left join found e on l.c = e.c),
best as (select * from scored qualify row_number() over (partition by k, test order by round(score, 9) desc, place) = 1)
"""


@query(
    "e14_test_pair_scores",
    f"with {_MATCHED} select c as paper, k as pos, test, round(score, 6) as score from best where extracted_test is not null",
)
def _(t: Tables):
    rows = _matched(t, found=True)
    return rows.select("paper", "pos", "test", F.round("score", 6).alias("score"))


@query(
    "e15_best_tests",
    f"with {_MATCHED} select c as paper, k as pos, test, extracted_test from best where extracted_test is not null",
)
def _(t: Tables):
    return _matched(t, found=True).select("paper", "pos", "test", "extracted_test")


@query(
    "e16_unmatched_tests",
    f"""with {_MATCHED} select c as paper, k as pos, field, 'FN' as outcome
    from best, (select unnest([{', '.join(f"'{f}'" for f in TEST_FIELDS)}]) as field) where extracted_test is null""",
)
def _(t: Tables):
    return E.test_outcomes(_matched(t, found=False), ["paper", "pos"])


TEXTS = """
select o_orderkey as k, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'buckminsterfullerene'
         when o_orderkey % 5 = 2 then 'AAAA' else 'bbbb' end as label,
       case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then 'c60' else 'aaaa' end as value
from @orders
"""


@query(
    "e17_text_outcome",
    f"""with x as ({TEXTS}), y as (select k, case label when 'buckminsterfullerene' then 'C60' else label end as label, value from x)
    select k, case when label is not null and value is null then 'FN' when label is null and value is not null then 'TN'
      when label is null then 'FP' when lower(label) = lower(value) then 'TP' else 'FP' end as outcome from y""",
)
def _(t: Tables):
    rows = t.derive(TEXTS).withColumn("label", O.etl_name(F.col("label")))
    scored = with_text_similarity(rows, "label", "value")
    outcome = O.text_outcome(F.col("label"), F.col("value"), F.col("similarity"))
    return scored.select("k", outcome.alias("outcome"))


# Prices against taxed prices; some on either side are missing.
NUMBERS = """
select l_returnflag as model, l_suppkey, l_linenumber,
       case when l_linenumber in (3, 4) then null else l_extendedprice end as label,
       case when l_linenumber in (4, 5) then null else l_extendedprice * (1 + l_tax) end as value
from @lineitem
"""
_NUMERIC = """case when label is not null and value is null then 'FN' when label is null and value is not null then 'TN'
  when label is null then 'TP' when abs(label - value) / abs(label) <= 0.027::double then 'TP' else 'FP' end"""


def _numeric(t: Tables):
    rows = t.derive(NUMBERS)
    return rows.withColumn("outcome", O.numeric_outcome(F.col("label"), F.col("value")))


@query(
    "e18_numeric_outcome",
    f"""with n as ({NUMBERS}) select l_linenumber, {_NUMERIC} as outcome, count(*) as n from n group by all""",
)
def _(t: Tables):
    return _numeric(t).groupBy("l_linenumber", "outcome").agg(F.count("*").alias("n"))


_TESTNUM = """case when {a} <> 0 and {b} = 0 then 'FN' when {a} = 0 and {b} <> 0 then 'TN' when {a} = 0 then 'TN'
  when abs({a} - {b}) / abs({a}) <= 0.027::double then 'TP' else 'FP' end"""


_TEST_OUTCOMES = f"""
o as (
      select k as pos, test, 'stability_type' as field,
             case when extracted_test is null then 'FN' when l_type = e_type then 'TP' else 'FP' end as outcome from best
      union all select k, test, 'temperature', case when extracted_test is null then 'FN'
        when l_tol is not null then case when e_temp between 80 and 90 then 'TP' else 'FP' end
        else {_TESTNUM.format(a='l_temp', b='e_temp')} end from best
      union all select k, test, 'humidity', case when extracted_test is null then 'FN'
        when l_hum is not null then case when e_hum = 0 then 'FN' when e_hum between 50 and 60 then 'TP' else 'FP' end
        else 'TN' end from best
      union all select k, test, 'time', case when extracted_test is null then 'FN'
        else {_TESTNUM.format(a='l_time', b='e_time')} end from best
      union all select k, test, 'efficiency_cont', case when extracted_test is null then 'FN'
        else {_TESTNUM.format(a='l_cont', b='e_cont')} end from best
        -- a field that the annotated test lacks has no outcome
        where test = 'test_2' or extracted_test is null
      union all select k, test, 'efficiency_tret', case when extracted_test is null then 'FN'
        else {_TESTNUM.format(a='l_tret', b='e_tret')} end from best where test = 'test_1' or extracted_test is null)
"""


@query("e19_test_outcomes", f"with {_MATCHED}, {_TEST_OUTCOMES} select * from o")
def _(t: Tables):
    return E.test_outcomes(_matched(t), ["pos", "test"])


@query(
    "e20_absent_keys",
    f"""with n as ({NUMBERS}) select l_linenumber, case when label is null then 'TP' else 'FN' end as outcome, count(*) as n
        from n where value is null group by all""",
)
def _(t: Tables):
    rows = t.derive(NUMBERS).where("value is null")
    rows = rows.withColumn("outcome", O.absent_key_outcome(F.col("label")))
    return rows.groupBy("l_linenumber", "outcome").agg(F.count("*").alias("n"))


_FIELD = (
    "case (l_suppkey + l_linenumber) % 15 "
    + " ".join(f"when {i} then '{f}'" for i, f in enumerate(WEIGHTED_FIELDS))
    + " end"
)
_COUNTS = f"""
n as ({NUMBERS}),
o as (select model, {_FIELD} as field, {_NUMERIC} as outcome from n),
counts as (select model, field, count(*) filter (where outcome = 'TP') as tp, count(*) filter (where outcome = 'FP') as fp,
                  count(*) filter (where outcome = 'FN') as fn, count(*) filter (where outcome = 'TN') as tn
           from o group by all),
pr as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall from counts),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from pr)
"""


def _counts(t: Tables):
    rows = _numeric(t).withColumn("field", F.expr(_FIELD))
    return E.confusion_counts(rows, ("model", "field"))


@query("e21_confusion_counts", f'with {_COUNTS} select model, field, tp as "TP", fp as "FP", fn as "FN", tn as "TN" from counts')
def _(t: Tables):
    return _counts(t)


@query(
    "e22_precision_recall",
    f"""with {_COUNTS} select model, field, round(precision, 9) as precision, round(recall, 9) as recall,
        round(f1, 9) as f1 from f""",
)
def _(t: Tables):
    scores = E.precision_recall(_counts(t))
    return scores.select("model", "field", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


_MACRO = f"""
weights as (select unnest([{', '.join(f"'{n}'" for n in WEIGHTINGS)}]) as weighting,
                   unnest([{', '.join(str(list(w)) for w in WEIGHTINGS.values())}]) as ws),
fields as (select unnest([{', '.join(f"'{f}'" for f in WEIGHTED_FIELDS)}]) as field,
                  unnest(range(1, {len(WEIGHTED_FIELDS) + 1})) as place),
macro as (select model, weighting, round(sum(f1 * ws[place]) / sum(ws[place]), 9) as macro_f1
          from f join fields using (field), weights group by all)
"""


def _macro(t: Tables):
    scores = E.macro_f1(E.precision_recall(_counts(t)))
    return scores.withColumn("macro_f1", F.round("macro_f1", 9))


@query("e23_macro_f1", f"with {_COUNTS}, {_MACRO} select * from macro")
def _(t: Tables):
    return _macro(t)


@query(
    "e24_score_table",
    f"""with {_COUNTS}, {_MACRO} select weighting, max(macro_f1) filter (where model = 'A') as "A",
        max(macro_f1) filter (where model = 'N') as "N", max(macro_f1) filter (where model = 'R') as "R"
        from macro group by 1""",
)
def _(t: Tables):
    return E.score_table(_macro(t), ("A", "N", "R"))


_BEST = f"""
chosen as (select o_orderkey as k, o_custkey as c, o_orderstatus as molecule from @orders
           join @customer on o_custkey = c_custkey where o_orderkey % 13 <> 0 and o_orderkey % 7 <> 0
           qualify row_number() over (partition by o_custkey order by
             o_orderstatus = case when o_custkey % 2 = 0 then 'F' else 'O' end desc, o_orderkey) = 1),
control as (select *, k % 30 + 0.5::double as l_control, c % 30 + 0.0::double as e_control from chosen),
tops as (
  select 'perovskite_composition' as field, 'FP' as outcome from chosen
  union all select 'electron_transport_layer', 'TP' from chosen
  -- keys the extraction lacks: wrong with a label, right without; keys the label lacks count nowhere
  union all select 'treated_pce', 'FN' from chosen
  union all select 'hole_transport_layer', 'FN' from chosen where k % 4 = 0
  union all select 'structure_pin_nip', 'TP' from chosen
  union all select 'passivating_molecule', case when molecule = case when c % 2 = 0 then 'F' else 'O' end
                                                then 'TP' else 'FP' end from chosen
  union all select 'control_pce', case when abs(l_control - e_control) / l_control <= 0.027::double
                                       then 'TP' else 'FP' end from control),
outcomes as (select * from tops union all select field, outcome from o where pos in (select k from chosen)
             union all select unnest([{', '.join(f"'{f}'" for f in WEIGHTED_FIELDS)}]), null),
tally as (select field, count(*) filter (where outcome = 'TP') as tp, count(*) filter (where outcome = 'FP') as fp,
                 count(*) filter (where outcome = 'FN') as fn, count(*) filter (where outcome = 'TN') as tn
          from outcomes group by field),
rates as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from tally)
"""


@query(
    "e_record_evaluation",
    f"""with {_MATCHED}, {_TEST_OUTCOMES}, {_BEST}
    select field, tp as "TP", fp as "FP", fn as "FN", tn as "TN", round(p, 9) as precision, round(r, 9) as recall,
           round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) as f1 from rates""",
)
def _(t: Tables):
    """All steps from records to scores per field."""
    scores = E.evaluate(_annotations(t), _extractions(t))
    return scores.select("field", *E.OUTCOMES, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


# Fully nested records: molecule and efficiencies sit inside the test.
NESTED_LABELS = """
select o_orderkey as paper, o_custkey as cust,
  '{"structure_pin_nip": "' || o_orderstatus || '", "test_1": {"stability_type": "'
  || case when o_orderkey % 2 = 0 then 'aaa' else 'bbb' end || '", "passivating_molecule": "'
  || case when o_orderkey % 3 = 0 then 'xx' else 'yy' end || '", "time": ' || (o_orderkey % 900 + 100)
  || ', "treated_pce": ' || (o_orderkey % 20 + 10) || ', "control_voc": ' || (o_orderkey % 5) || '}}' as record
from @orders
"""
NESTED_FOUND = """
select o_orderkey as paper,
  '{"structure": "' || o_orderstatus || '", "passivating_molecule": "xx", "test_1": {"test_name": "aaa", "time": "'
  || (o_orderkey % 700 + 100) || ' h", "treated_pec": ' || (o_orderkey % 20 + 10) || ', "control_efficiency": "0.5"},'
  || ' "test_2": {"test_name": "bbb", "passivating_molecule": "yy", "treated_pce": 15, "treatment_efficiency": "9"}}' as record
from @orders
"""


def _nested(t: Tables, sql: str):
    rows = C.conformed(t.derive(sql), "record", FULLY_NESTED)
    return rows.withColumn("record", F.col("conformed")).drop("conformed", "extra")


_NESTED = f"""
l as (select o_orderkey as k, case when o_orderkey % 2 = 0 then 'aaa' else 'bbb' end as type,
             case when o_orderkey % 3 = 0 then 'xx' else 'yy' end as mol,
             [0, o_orderkey % 900 + 100, 0, 0, 0, 0, o_orderkey % 20 + 10, o_orderkey % 5, 0]::double[] as nums from @orders),
e as (select o_orderkey as k, 0 as place, 'test_1' as test, 'aaa' as type, null as mol,
             [0, o_orderkey % 700 + 100, 0, 0.5, 0, 0, o_orderkey % 20 + 10, 0, 0]::double[] as nums from @orders
      union all select o_orderkey, 1, 'test_2', 'bbb', 'yy', [0, 0, 0, 0, 9, 0, 15, 0, 0]::double[] from @orders),
s as (select l.k, e.test, e.place, (cast(l.type = e.type as int) + coalesce(cast(l.mol = e.mol as int), 0)
             + coalesce({_COSINE.format(z=_Z)}, 0)) / 3 as score from l join e on l.k = e.k)
"""


@query(
    "e14_nested_pair_scores",
    f"""with {_NESTED} select k as paper, test as extracted_test, round(score, 6) as score from s
        qualify row_number() over (partition by k order by round(score, 9) desc, place) = 1""",
)
def _(t: Tables):
    pairs = E.paired(_nested(t, NESTED_LABELS).withColumn("pos", F.lit(0)), _nested(t, NESTED_FOUND))
    for side in ("annotation", "extracted"):
        pairs = pairs.withColumn(side, E.coerce_numbers(F.col(side), FULLY_NESTED))
    tests = pairs.select("paper", F.col("annotation.tests").alias("l"), F.col("extracted.tests").alias("e"))
    best = E.matched_tests(tests, ["paper"], "l", "e", FULLY_NESTED)
    return best.select("paper", "extracted_test", F.round("score", 6).alias("score"))


# Of the annotated tests only the fields they hold count, and of the tops the
# one they hold; molecules and types either agree or share no letter.
_NESTED_OUTCOMES = f"""
b as (select * from s qualify row_number() over (partition by k order by round(score, 9) desc, place) = 1),
m as (select b.k, l.type as l_type, e.type as e_type, l.mol as l_mol, e.mol as e_mol, l.nums as ln, e.nums as en
      from b join l on b.k = l.k join e on b.k = e.k and b.test = e.test),
o as (
  select 'structure_pin_nip' as field, 'TP' as outcome from m
  union all select 'stability_type', case when l_type = e_type then 'TP' else 'FP' end from m
  union all select 'passivating_molecule', case when e_mol is null then 'FN' when l_mol = e_mol then 'TP' else 'FP' end from m
  union all select 'time', {_TESTNUM.format(a='ln[2]', b='en[2]')} from m
  union all select 'treated_pce', {_TESTNUM.format(a='ln[7]', b='en[7]')} from m
  union all select 'control_voc', {_TESTNUM.format(a='ln[8]', b='en[8]')} from m),
every as (select unnest([{", ".join(f"'{f}'" for f in dict.fromkeys((*FULLY_NESTED.top, *FULLY_NESTED.tests)))}]) as field),
tally as (select field, count(*) filter (where outcome = 'TP') as tp, count(*) filter (where outcome = 'FP') as fp,
                 count(*) filter (where outcome = 'FN') as fn, count(*) filter (where outcome = 'TN') as tn
          from every left join o using (field) group by field),
rates as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from tally)
"""


@query(
    "e_nested_evaluation",
    f"""with {_NESTED}, {_NESTED_OUTCOMES} select field, tp as "TP", fp as "FP", fn as "FN", tn as "TN",
        round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) as f1 from rates""",
)
def _(t: Tables):
    labels = _nested(t, NESTED_LABELS).withColumn("pos", F.lit(0))
    scores = E.evaluate(labels, _nested(t, NESTED_FOUND), FULLY_NESTED, ranges_stay=False)
    return scores.select("field", *E.OUTCOMES, F.round("f1", 9).alias("f1"))


@query("u1_scalar_function")
def _(t: Tables):
    """Similarity of each turn's role and whole text, once per distinct pair."""
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    scored = with_text_similarity(rows, "role", "text", "ratio")
    both = F.col("role").isNotNull() & F.col("text").isNotNull()
    return scored.select("conv_id", "turn", F.when(both, F.round("ratio", 6)).alias("ratio"))
