"""Queries over measurement cleaning and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import chemistry, measures
from sheaf.operators import cleaning as P
from sheaf.plans.registry import Tables, query
from sheaf.schemas import SPECIES, STRUCTURE_NAMES

# Test cells as text: one dictionary, a list, junk, none.
WIDE = """
select o_orderkey as paper, o_orderpriority as material,
  case o_orderkey % 5 when 0 then null when 1 then 'not a test'
    else '{' || chr(39) || 'time' || chr(39) || ': ' || chr(39) || (o_orderkey % 100) || ' h' || chr(39) || ', '
         || chr(39) || 'humidity' || chr(39) || ': None, ' || chr(39) || 'molecule' || chr(39) || ': ' || chr(39)
         || o_orderstatus || chr(39) || '}' end as test_1,
  case o_orderkey % 3 when 0 then '[{"time": "1 h", "stability_type": "' || o_orderstatus || '"}, {"time": null}]'
    else null end as test_2
from @orders
"""
_EXPANDED = f"""
w as ({WIDE}),
e as (
  select paper, material, 'test_1' as test, (paper % 100) || ' h' as time, null as stability_type,
         '{{"molecule":"' || regexp_extract(test_1, '([A-Z])''\\}}', 1) || '"}}' as extra from w
    where paper % 5 > 1
  union all select paper, material, 'test_2', '1 h', regexp_extract(test_2, 'type": "([A-Z])', 1), '{{}}' from w where paper % 3 = 0
  union all select paper, material, 'test_2', null, null, '{{}}' from w where paper % 3 = 0)
"""


@query("p1_expanded_tests", f"with {_EXPANDED} select paper, material, test, time, stability_type, extra from e")
def _(t: Tables):
    rows, _ = P.expand_tests(t.derive(WIDE), ("test_1", "test_2"))
    return rows.select("paper", "material", "test", "time", "stability_type", F.to_json("extra").alias("extra"))


@query("p1_rejected_cells", f"with w as ({WIDE}) select paper, 'test_1' as test, test_1 as cell from w where paper % 5 = 1")
def _(t: Tables):
    _, rejected = P.expand_tests(t.derive(WIDE), ("test_1", "test_2"))
    return rejected.select("paper", "test", "cell")


# Spellings of measurements. q runs over the quantities.
FORMS = """
select q, l_linenumber as f,
  case l_linenumber when 1 then q || '-85' when 2 then '-' || q when 3 then q || '-25°C' when 4 then q || ' ± 5'
    when 5 then 'Room Temperature' when 6 then q || '.5' else q || '°C' end as temperature,
  case l_linenumber when 1 then q || ' h' when 2 then q || ' hours' when 3 then q || ' days' when 4 then q || ' weeks'
    when 5 then q || ' min' when 6 then q || ' s' else '' || q end as time,
  case l_linenumber when 1 then q || '-40%' when 2 then q || '-30% RH' when 3 then q || ' ± 5%' when 4 then q || ' %'
    when 5 then 'dry air' when 6 then 'RH ' || q || '.5' else '' || q end as humidity,
  case l_linenumber when 1 then q || '-90%' when 2 then q || '–90' when 3 then q || ' ± 5%' when 4 then '~' || q || ' %'
    when 5 then 'N/A' when 6 then '0.' || q else 'about ' || q || '.25 percent' end as share
from (select l_linenumber, cast(floor(l_quantity) as bigint) as q from @lineitem)
"""


def _forms(t: Tables, column: str, converted):
    rows = t.derive(FORMS).select(F.col(column).alias("raw"), F.round(converted, 6).alias("value"))
    return rows.groupBy("raw", "value").agg(F.count("*").alias("n"))


def _form_sql(column: str, value: str) -> str:
    return f"""with forms as ({FORMS}) select {column} as raw, round(cast({value} as double), 6) as value,
               count(*) as n from forms group by all"""


_TEMPERATURE = """case f when 1 then (q + 85) / 2 when 2 then null when 3 then null when 4 then q when 5 then 25 else q end"""
_HOURS = """case f when 1 then q when 2 then null when 3 then q * 24 when 4 then q * 168 when 5 then q / 60
            when 6 then q / 3600 else null end"""
_HUMIDITY = """case f when 1 then (q + 40) / 2 when 2 then null when 3 then q when 4 then q when 5 then 0.1::double
               when 6 then q + 0.5::double else null end"""
_SHARE = """case f when 1 then (q + 90) / 2 when 2 then (q + 90) / 2 when 3 then q when 4 then q when 5 then null
            when 6 then try_cast('0.' || q as double) else q + 0.25::double end"""
_SHARE100 = """case f when 1 then (q + 90) / 2 when 2 then (q + 90) / 2 when 3 then q when 4 then q when 5 then null
            when 6 then try_cast('0.' || q as double) * 100 else q + 0.25::double end"""


@query("p2_temperature", _form_sql("temperature", _TEMPERATURE))
def _(t: Tables):
    return _forms(t, "temperature", measures.temperature(F.col("temperature")))


@query("p3_hours", _form_sql("time", _HOURS))
def _(t: Tables):
    return _forms(t, "time", measures.hours(F.col("time")))


@query("p4_humidity", _form_sql("humidity", _HUMIDITY))
def _(t: Tables):
    return _forms(t, "humidity", measures.humidity(F.col("humidity")))


@query("p5_percentage", _form_sql("share", _SHARE))
def _(t: Tables):
    return _forms(t, "share", measures.percentage(F.col("share")))


@query("p6_percentage_or_fraction", _form_sql("share", _SHARE100))
def _(t: Tables):
    return _forms(t, "share", measures.percentage(F.col("share"), fractions=True))


@query(
    "p7_converted_columns",
    f"""with forms as ({FORMS}) select f, round(sum({_TEMPERATURE}), 3) as temperature, round(sum({_HOURS}), 3) as time,
        round(sum({_HUMIDITY}), 3) as humidity from forms group by f""",
)
def _(t: Tables):
    kinds = {c: c for c in ("temperature", "time", "humidity")}
    rows = P.convert_columns(t.derive(FORMS), kinds)
    return rows.groupBy("f").agg(*[F.round(F.sum(c), 3).alias(c) for c in kinds])


ANNOTATED = """
select o_orderkey as first_num, o_orderpriority as structure_pin_nip, o_totalprice as efficiency_tret,
       case when o_orderkey % 2 = 0 then o_totalprice end as efficiency_cont, o_orderstatus as only_here
from @orders
"""
EXTRACTED = """
select l_linenumber as line, l_returnflag as structure_pin_nip, l_quantity as retained_percentage_tret,
       l_discount as retained_percentage_cont from @lineitem
"""


@query(
    "p8_renamed_columns",
    """select l_returnflag as pin_nip_structure, count(*) as n, round(sum(l_quantity), 2) as retained_percentage_tret
       from @lineitem group by 1""",
)
def _(t: Tables):
    canonical = P.rename(t.derive(EXTRACTED), P.TO_CANONICAL)
    model = P.rename(canonical, P.TO_MODEL)
    return model.groupBy("pin_nip_structure").agg(
        F.count("*").alias("n"), F.round(F.sum("retained_percentage_tret"), 2).alias("retained_percentage_tret")
    )


@query(
    "p9_merged_sources",
    f"""with a as ({ANNOTATED}), e as ({EXTRACTED}),
    m as (select * from a union all select null, structure_pin_nip, retained_percentage_tret, retained_percentage_cont, null from e)
    select structure_pin_nip, only_here, count(*) as n, count(first_num) as n_numbered,
           round(sum(efficiency_tret), 2) as treated, round(sum(efficiency_cont), 2) as control
    from m group by all""",
)
def _(t: Tables):
    merged = P.merge_sources(t.derive(ANNOTATED), P.rename(t.derive(EXTRACTED)))
    return merged.groupBy("structure_pin_nip", "only_here").agg(
        F.count("*").alias("n"),
        F.count("first_num").alias("n_numbered"),
        F.round(F.sum("efficiency_tret"), 2).alias("treated"),
        F.round(F.sum("efficiency_cont"), 2).alias("control"),
    )


@query(
    "p10_tests_keeping_empty",
    """
    select o_orderkey as paper, o_orderstatus as material, null as test, '9 h' as time, null as humidity
      from @orders where o_orderkey % 4 = 0
    union all select o_orderkey, o_orderstatus, 'test_1', o_orderkey || ' h', null from @orders where o_orderkey % 4 > 0
    union all select o_orderkey, o_orderstatus, 'test_2', null, o_orderpriority from @orders where o_orderkey % 4 > 1
    """,
)
def _(t: Tables):
    record = "struct<time: string, humidity: string>"
    empty = F.create_map().cast(f"map<string, {record}>")

    def test(time, humidity):
        return F.struct(time.cast("string").alias("time"), humidity.cast("string").alias("humidity"))

    first = test(F.concat("o_orderkey", F.lit(" h")), F.lit(None))
    second = test(F.lit(None), F.col("o_orderpriority"))
    both = F.create_map(F.lit("test_1"), first, F.lit("test_2"), second)
    key = F.col("o_orderkey") % 4
    tests = (
        F.when(key == 0, empty).when(key == 1, F.create_map(F.lit("test_1"), first)).otherwise(both)
    )
    rows = t.orders.select(
        F.col("o_orderkey").alias("paper"),
        F.col("o_orderstatus").alias("material"),
        F.lit("9 h").alias("time"),
        tests.alias("tests"),
    )
    return P.expand_keeping_empty(rows, "tests", ("time", "humidity"))


PAIRS = """
select l_orderkey, l_linenumber, l_returnflag as structure,
       case when l_linenumber = 3 then null else l_extendedprice / 3000 end as control_pce,
       case when l_linenumber = 5 then null else l_extendedprice * (1 + l_tax) / 3000 end as treated_pce,
       case when l_linenumber % 2 = 0 then null else l_quantity end as efficiency_cont,
       case when l_linenumber % 3 = 0 then null else l_quantity + 1 end as efficiency_tret
from @lineitem
"""


@query(
    "p11_repaired_retained",
    f"""with p as ({PAIRS}), r as (
      select l_linenumber,
        case when efficiency_tret is null then efficiency_cont else efficiency_tret end as t,
        case when efficiency_tret is null then null else efficiency_cont end as c from p)
    select l_linenumber, count(t) as n_treated, count(c) as n_control, sum(t) as treated, sum(c) as control
    from r group by 1""",
)
def _(t: Tables):
    fixed = P.repair_retained(t.derive(PAIRS))
    return fixed.groupBy("l_linenumber").agg(
        F.count("efficiency_tret").alias("n_treated"),
        F.count("efficiency_cont").alias("n_control"),
        F.sum("efficiency_tret").alias("treated"),
        F.sum("efficiency_cont").alias("control"),
    )


SPELLINGS = (
    "select o_orderkey, case o_orderkey % 9 "
    + " ".join(f"when {i} then '{s}'" for i, s in enumerate(STRUCTURE_NAMES))
    + " when 7 then o_orderpriority else null end as structure from @orders"
)


@query(
    "p12_structure_class",
    f"""with s as ({SPELLINGS}) select case {' '.join(f"when structure = '{s}' then '{k}'" for s, k in STRUCTURE_NAMES.items())}
        else 'Other' end as structure, count(*) as n from s group by 1""",
)
def _(t: Tables):
    rows = t.derive(SPELLINGS).select(chemistry.structure_class(F.col("structure")).alias("structure"))
    return rows.groupBy("structure").agg(F.count("*").alias("n"))


# Formulas with groups, plain counts, spaces and missing counts.
FORMULAS = """
select l_linenumber as f, q, d,
  case l_linenumber when 1 then '(FAPbI3)0.' || d || '(MAPbBr3)0.05' when 2 then 'FA0.' || d || 'MAPbI' || q
    when 3 then 'Cs 0.05 FA 0.' || d || ' MA 0.1 PbI 3' when 4 then 'FA1-xMAxPbI3' when 5 then null
    when 6 then 'CS0.' || d || 'Rb(Pb0.5Sn' || q || ')2(I0.' || d || 'Br)' else 'name' || q end as formula
from (select l_linenumber, cast(floor(l_quantity) as bigint) as q, cast(floor(l_discount * 100) as bigint) as d
      from @lineitem)
"""


def _species_sql(species: str) -> str:
    names = "|".join(SPECIES)
    counted = "coalesce(try_cast(nullif(regexp_extract(s, '([0-9.]*)$', 1), '') as double), 1.0::double)"
    own = f"list_filter(regexp_extract_all({{0}}, '({names})\\s*([0-9.]*)'), lambda s: regexp_extract(s, '^({names})', 1) = '{species}')"
    total = f"coalesce(list_sum(list_transform({own}, lambda s: {counted})), 0)"
    groups = "regexp_extract_all(formula, '\\(([^)]+)\\)\\s*([0-9.]+)')"
    inner = total.format("regexp_extract(g, '\\(([^)]+)\\)', 1)")
    factor = "cast(regexp_extract(g, '([0-9.]+)$', 1) as double)"
    grouped = f"coalesce(list_sum(list_transform({groups}, lambda g: {inner} * {factor})), 0)"
    rest = total.format("regexp_replace(formula, '\\([^)]*\\)\\s*[0-9.]+', '', 'g')")
    return f"round({grouped} + {rest}, 2)"


@query(
    "p13_formula_amounts",
    f"""with forms as (select coalesce(formula, '') as formula, count(*) as n from ({FORMULAS}) group by 1)
    select formula, n, {', '.join(f'{_species_sql(s)} as {s.lower()}' for s in SPECIES)} from forms""",
)
def _(t: Tables):
    rows = t.derive(FORMULAS).select(F.coalesce("formula", F.lit("")).alias("formula"))
    counted = rows.groupBy("formula").agg(F.count("*").alias("n"))
    parsed = counted.withColumn("a", chemistry.formula_amounts(F.col("formula")))
    return parsed.select("formula", "n", *[F.col("a")[s].alias(s.lower()) for s in SPECIES])


_CHANGE = f"""
p as ({PAIRS}), c as (select *, (treated_pce - control_pce) / nullif(control_pce, 0) * 100 as change from p)
"""


def _change(t: Tables):
    return t.derive(PAIRS).withColumn(
        "change", P.percent_change(F.col("control_pce"), F.col("treated_pce"))
    )


@query(
    "p14_percent_change",
    f"with {_CHANGE} select l_linenumber, count(change) as n, round(avg(change), 6) as mean_change from c group by 1",
)
def _(t: Tables):
    return _change(t).groupBy("l_linenumber").agg(
        F.count("change").alias("n"), F.round(F.avg("change"), 6).alias("mean_change")
    )


@query(
    "p15_equality_flags",
    """with n as (select nullif(p_brand, 'Brand#3') as etl, p_type as htl from @part)
    select coalesce(etl = 'Brand#1', false) as is_first, coalesce(htl = 'ECONOMY', false) as is_economy, count(*) as n
    from n group by all""",
)
def _(t: Tables):
    etl = F.nullif(F.col("p_brand"), F.lit("Brand#3"))
    rows = t.part.select(
        P.equals_flag(etl, "Brand#1").alias("is_first"), P.equals_flag(F.col("p_type"), "ECONOMY").alias("is_economy")
    )
    return rows.groupBy("is_first", "is_economy").agg(F.count("*").alias("n"))


@query(
    "p16_rows_with_values",
    f"""with p as ({PAIRS}) select l_linenumber, count(*) as n from p
    where control_pce is not null and treated_pce is not null and efficiency_tret is not null group by 1""",
)
def _(t: Tables):
    rows = t.derive(PAIRS).dropna(subset=["control_pce", "treated_pce"]).dropna(subset=["efficiency_tret"])
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query(
    "p17_plausible_rows",
    f"""with {_CHANGE} select l_linenumber, count(*) as n, round(sum(treated_pce), 4) as treated from c
    where control_pce > 10 and control_pce <= 35 and treated_pce > 10 and treated_pce <= 35 and change <= 35
      and efficiency_tret >= 5 and efficiency_tret <= 45 group by 1""",
)
def _(t: Tables):
    rows = P.plausible(_change(t), "control_pce", "treated_pce", "change")
    rows = P.bounded(rows, at_least={"efficiency_tret": 5}, at_most={"efficiency_tret": 45})
    return rows.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.round(F.sum("treated_pce"), 4).alias("treated")
    )
