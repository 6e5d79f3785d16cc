"""Queries over extraction records, with answers derived from the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import measures, text as X
from sheaf.operators import records as C
from sheaf.plans.registry import Tables, query
from sheaf.session import new_path
from sheaf.sources import tables

# What an extractor might answer: clean, fenced, single-quoted, broken, none.
ANSWERS = """
select event_id, event_type, user_id, value,
  case event_id % 8
    when 0 then 'Here is the record: ' || props || ' done.'
    when 1 then '```json' || chr(10) || props || chr(10) || '```'
    when 2 then '{' || chr(39) || 'k' || chr(39) || ': None, ' || chr(39) || 'name' || chr(39) || ': '
                || chr(39) || event_type || chr(39) || '}'
    when 3 then 'no record in ' || event_type
    when 4 then null
    when 5 then '{"k":   "' || event_type || ':' || user_id || '", "name": "6,6"-phenyl", "treated_pec": '
                || user_id || '}'
    when 6 then '{"k": ' || user_id || ' C, "time": 18 * 24}'
    else '{"k": "a' || user_id || '",' || chr(10) || ' "test_1": {"time": "' || user_id || ' h"}}'
  end as answer
from @events
"""
_SPAN = "nullif(regexp_extract(answer, '(?s)\\{.*\\}', 0), '')"


# The repaired text of each shape of answer, as the rules of the repair leave it:
# None and quotes become JSON's, blanks before a quoted value and colons inside
# one go, a quote inside a name or before a line break becomes an apostrophe.
_REPAIRED = """case event_id % 8
    when 2 then '{"k": null, "name": "' || event_type || '"}'
    when 5 then '{"k": "' || event_type || user_id || '", "name": "6,6' || chr(39) || '-phenyl", "treated_pce": '
                || user_id || '}'
    when 7 then '{"k": "a' || user_id || chr(39) || ',' || chr(10) || ' "test_1": {"time": "' || user_id || ' h"}}'
    else span end"""


_PARSED = f"""
answers as ({ANSWERS}),
spans as (select *, {_SPAN} as span from answers),
fixed as (select *, case when json_valid(span) then span else {_REPAIRED} end as fix from spans),
outcome as (select event_id, answer, case when json_valid(fix) then fix end as record,
                   case when answer is null then 'null' when json_valid(fix) then 'parsed' else 'raw' end as status,
                   case when json_valid(fix) then null else coalesce(fix, answer) end as raw from fixed)
"""


def _answers(t: Tables):
    return t.derive(ANSWERS)


@query(
    "x1_truncate_tokens",
    """select doc_id, md5(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:2000], ' '))
       as text_md5 from @documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(X.truncate_tokens(F.col("text"), 2000)).alias("text_md5"))


@query(
    "x2_prompt",
    """select doc_id, unnest(['system', 'user']) as role,
       unnest([md5('Extract the record.'),
               md5(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:16000], ' '))])
       as content_md5 from @documents""",
)
def _(t: Tables):
    prompts = t.documents.select(
        "doc_id", F.explode(X.prompt("Extract the record.", F.col("text"))).alias("m")
    )
    return prompts.select("doc_id", F.col("m.role").alias("role"), F.md5("m.content").alias("content_md5"))


_TEMPLATE = X.ExampleTemplate(asked="Text: {chunk}\nKnown: {memory}.")


@query(
    "x3_training_example",
    f"""select conv_id, turn, md5(chr(10) || '{_TEMPLATE.intro}' || chr(10) || chr(10) || 'Text: ' || text || chr(10)
       || 'Known: ' || role || '.' || chr(10) || chr(10) || '{_TEMPLATE.response_key}' || chr(10)
       || turn || chr(10) || chr(10) || '{_TEMPLATE.end_key}') as example_md5 from @conversations""",
)
def _(t: Tables):
    example = X.training_example(F.col("text"), F.col("role"), F.col("turn").cast("string"), _TEMPLATE)
    return t.conversations.select("conv_id", "turn", F.md5(example).alias("example_md5"))


@query("x4_brace_span", f"with answers as ({ANSWERS}) select event_id, {_SPAN} as span from answers")
def _(t: Tables):
    return _answers(t).select("event_id", X.brace_span(F.col("answer")).alias("span"))


@query("x5_parse_outcome", f"with {_PARSED} select event_id, record, raw, status from outcome")
def _(t: Tables):
    return C.parse_outcome(_answers(t), "answer").select("event_id", "record", "raw", "status")


@query(
    "x6_strip_fence",
    f"""with answers as ({ANSWERS}), s as (select *, string_split(answer, '```json')[2] as inner_text from answers)
    select event_id, case when contains(answer, '```json')
      then coalesce(nullif(regexp_extract(inner_text, '(?s)\\{{.*\\}}', 0), ''), inner_text)
      else answer end as stripped from s""",
)
def _(t: Tables):
    return _answers(t).select("event_id", X.strip_fence(F.col("answer")).alias("stripped"))


@query(
    "x7_repair_json",
    f"with {_PARSED} select event_id, {_REPAIRED} as repaired from spans where span is not null",
)
def _(t: Tables):
    spans = _answers(t).select("event_id", X.brace_span(F.col("answer")).alias("span"))
    return spans.where("span is not null").select("event_id", X.repair_json(F.col("span")).alias("repaired"))


@query(
    "x8_apply_extractor",
    """with f as (select doc_id, nullif(regexp_extract(text, '[a-z]{4,}'), '') as w,
                         nullif(regexp_extract(text, '[0-9]+'), '') as n from @documents)
    select doc_id, case when w is not null or n is not null then '{"first_word":'
      || coalesce('"' || w || '"', 'null') || ',"number":' || coalesce('"' || n || '"', 'null') || '}' end as json_output
    from f""",
)
def _(t: Tables):
    rules = {"first_word": r"[a-z]{4,}", "number": r"[0-9]+"}
    return t.documents.select("doc_id", C.rule_records(F.col("text"), rules).alias("json_output"))


@query(
    "x9_keyed_export",
    f"""with {_PARSED} select '{{"' || event_id || '": ' || case status when 'null' then 'null' else
        coalesce(record, cast(to_json(raw) as varchar)) end || '}}' as value from outcome
        where contains(coalesce(record, raw, ''), chr(10)) is false
        union all
        select '{{"' || event_id || '": ' || coalesce(replace(record, chr(10), ' '), cast(to_json(raw) as varchar)) || '}}'
        from outcome where contains(coalesce(record, raw, ''), chr(10))""",
)
def _(t: Tables):
    parsed = C.parse_outcome(_answers(t), "answer")
    # A text sink is line-based: line breaks between JSON tokens become blanks.
    flat = parsed.withColumn("record", F.replace("record", F.lit("\n"), F.lit(" ")))
    path = new_path(t.spark, "export")
    C.keyed_export(flat, "event_id").write.text(path)
    return t.spark.read.text(path)


# Records with missing, aliased, list-valued and unknown keys.
RECORDS = """
select event_id, user_id,
  '{' || case event_id % 3 when 0 then '"pin_nip_structure": "NIP"' when 1 then '"structure_pin_nip": "PIN"'
              else '"device_structure": "' || event_type || '"' end
  || case when event_id % 2 = 0 then ', "treated_pec": ' || user_id else ', "treated_pce": ' || user_id end
  || case when event_id % 5 = 0 then ', "note": "' || event_type || '"' else '' end
  || case when event_id % 4 = 0 then '' else
     ', "test_1": {"test_name": "' || event_type || '", "time": "' || user_id || ' h", '
     || case when event_id % 4 = 1 then '"retained_proportion_tret"' else '"retained_percentage_tret"' end
     || ': ' || (event_id % 90) || '}' end
  || '}' as record
from @events
"""


@query(
    "c1_conformed_records",
    f"""with r as ({RECORDS}) select event_id,
    case event_id % 3 when 0 then 'NIP' when 1 then 'PIN' else json_extract_string(record, '$.device_structure') end as structure,
    cast(user_id as varchar) as treated_pce, cast(null as varchar) as control_pce,
    json_extract_string(record, '$.note') as note,
    case when event_id % 4 = 0 then 0 else 1 end as n_tests from r""",
)
def _(t: Tables):
    out = C.conformed(t.derive(RECORDS), "record")
    return out.select(
        "event_id",
        F.col("conformed.structure_pin_nip").alias("structure"),
        F.col("conformed.treated_pce").alias("treated_pce"),
        F.col("conformed.control_pce").alias("control_pce"),
        F.try_element_at("extra", F.lit("note")).alias("note"),
        F.size("conformed.tests").alias("n_tests"),
    )


LISTS = """
select event_id, case event_id % 3 when 0 then '["' || event_type || '", "x"]' when 1 then event_type
       else '[]' end as v from @events
"""


@query(
    "c2_first_of_list",
    f"""with l as ({LISTS}) select event_id,
        case when starts_with(v, '[') then json_extract_string(v, '$[0]') else v end as v from l""",
)
def _(t: Tables):
    return t.derive(LISTS).select("event_id", measures.first_of_list(F.col("v")).alias("v"))


@query(
    "c3_canonical_tests",
    f"""with r as ({RECORDS}) select event_id, json_extract_string(record, '$.test_1.test_name') as stability_type,
        json_extract_string(record, '$.test_1.time') as time,
        cast(event_id % 90 as varchar) as efficiency_tret from r where event_id % 4 <> 0""",
)
def _(t: Tables):
    out = C.conformed(t.derive(RECORDS), "record")
    tests = out.select("event_id", F.explode("conformed.tests").alias("name", "t"))
    return tests.select("event_id", "t.stability_type", "t.time", "t.efficiency_tret")


LISTED = """
select event_id, '{"treated_pce": ' || user_id || ', "stability_tests": [{"test_name": "' || event_type
  || '", "time": "' || user_id || '"}' || case when event_id % 2 = 0 then ', {"stability_type": "second"}' else '' end
  || ']}' as record from @events
"""


@query(
    "c1_listed_tests",
    """select event_id, 'test_1' as name, event_type as stability_type, cast(user_id as varchar) as time,
              cast(user_id as varchar) as treated_pce from @events
       union all select event_id, 'test_2', 'second', null, cast(user_id as varchar) from @events where event_id % 2 = 0""",
)
def _(t: Tables):
    out = C.conformed_list(t.derive(LISTED), "record")
    tests = out.select("event_id", "conformed.treated_pce", F.explode("conformed.tests").alias("name", "t"))
    return tests.select("event_id", "name", "t.stability_type", "t.time", "treated_pce")


FLAT = """
select event_id, '{"treated_pec": ' || user_id || ', "test_name": "' || event_type || '", "retained_percentage_cont": '
  || (event_id % 100) || ', "treated_ff": 1}' as record from @events
"""


@query(
    "c1_flat_records",
    """select event_id, cast(user_id as varchar) as treated_pce, event_type as stability_type,
              cast(event_id % 100 as varchar) as efficiency_cont, cast(null as varchar) as time from @events""",
)
def _(t: Tables):
    out = C.conformed_flat(t.derive(FLAT), "record")
    test = F.col("conformed.tests")["test_1"]
    return out.select(
        "event_id",
        F.col("conformed.treated_pce").alias("treated_pce"),
        *[test[f].alias(f) for f in ("stability_type", "efficiency_cont", "time")],
    )


# Raw measurements in several spellings.
MEASURES = """
select l_linenumber, cast(floor(l_quantity) as bigint) as q,
  case l_linenumber when 1 then floor_q || ' h' when 2 then floor_q || ' hours' when 3 then floor_q || ' days'
    when 4 then '18 * ' || floor_q when 5 then '[' || floor_q || ', 7]' when 6 then floor_q || ' min'
    else floor_q end as time_raw,
  case l_linenumber when 1 then floor_q || ' °C' when 2 then floor_q || '-85 °C' when 3 then 'room temperature'
    when 4 then floor_q || ' ± 5' when 5 then '-' || floor_q when 6 then 'RT' else floor_q || '.5' end as temp_raw,
  case l_linenumber when 1 then floor_q || '%' when 2 then floor_q || '-60% RH' when 3 then 'ambient air'
    when 4 then floor_q || ' ± 5%' when 5 then 'RH ' || floor_q when 6 then 'dry N2' else floor_q end as rh_raw
from (select *, cast(cast(floor(l_quantity) as bigint) as string) as floor_q from @lineitem)
"""


@query(
    "c4_unit_conformance",
    f"""with m as ({MEASURES}) select l_linenumber, q, count(*) as n,
      max(round(case l_linenumber when 1 then q when 2 then q when 3 then q * 24 when 4 then 18 * q when 5 then q
          when 6 then q / 60 else q end, 6)) as time,
      max(round(case l_linenumber when 1 then q when 2 then (q + 85) / 2 when 3 then 25 when 4 then q when 5 then -q
          when 6 then 25 else q + 0.5::double end, 6)) as temperature,
      max(round(case l_linenumber when 1 then q when 2 then (q + 60) / 2 when 3 then 52 when 4 then q when 5 then q
          when 6 then 0.1::double else q end, 6)) as humidity
    from m group by l_linenumber, q""",
)
def _(t: Tables):
    kinds = {"time_raw": "time", "temp_raw": "temperature", "rh_raw": "humidity"}
    out = C.conform_values(t.derive(MEASURES), kinds)
    return out.groupBy("l_linenumber", "q").agg(
        F.count("*").alias("n"),
        F.max(F.round("time_raw", 6)).alias("time"),
        F.max(F.round("temp_raw", 6)).alias("temperature"),
        F.max(F.round("rh_raw", 6)).alias("humidity"),
    )


PRODUCTS = """
select l_linenumber as k, cast(floor(l_quantity) as bigint) as q,
       case l_linenumber % 4 when 0 then cast(floor(l_quantity) as bigint) || ' * 24'
            when 1 then '2*3 * ' || cast(floor(l_quantity) as bigint)
            when 2 then cast(floor(l_quantity) as bigint) || 'd * 2'
            else '' || cast(floor(l_quantity) as bigint) end as v
from @lineitem
"""


@query(
    "c5_product_expressions",
    f"""with p as ({PRODUCTS}) select v, count(*) as n,
      max(case k % 4 when 0 then q * 24.0::double when 1 then q * 6.0::double when 2 then null else q end) as product
    from p group by v""",
)
def _(t: Tables):
    rows = t.derive(PRODUCTS).withColumn("product", measures.product(F.col("v")))
    return rows.groupBy("v").agg(F.count("*").alias("n"), F.max("product").alias("product"))


@query(
    "c6_key_batches",
    """with r as (select c_custkey, row_number() over (order by md5(c_custkey || '-0'), c_custkey) as r from @customer)
       select c_custkey, cast(floor((r - 1) / 50) as bigint) as batch from r""",
)
def _(t: Tables):
    return C.key_batches(t.customer.select("c_custkey"), "c_custkey", 50)


@query(
    "c7_upsert_batch",
    """select o.o_orderkey as id, coalesce(l.v, o.o_orderpriority) as v
       from @orders o left join (select l_orderkey, max(l_returnflag) as v from @lineitem group by 1) l
       on o.o_orderkey = l.l_orderkey""",
)
def _(t: Tables):
    old = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("v"))
    new = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("v"))
    return C.upsert_batch(old, new, "id", "v")


# Names as extracted, and dictionaries that know some of them.
NAMES = """
select p_partkey, case when p_partkey % 11 = 0 then null when p_partkey % 11 = 1 then 'none'
       else p_brand || '/' || p_name end as name from @part
"""
_DICT = "select distinct p_brand || '/' || p_name as name, case when p_name like '%ring' then null else upper(p_name) end as converted from @part where p_brand like '%1'"
_PASS1 = "select distinct p_brand || '/' || p_name as name, case when p_name like 'red%' then p_type when p_name like 'blue%' then 'None' end as converted from (select p_brand, p_name, max(p_type) as p_type from @part group by p_brand, p_name)"
_PASS2 = "select distinct p_brand || '/' || p_name as name, case when p_name like 'blue%' then upper(p_brand) end as converted from @part where p_name not like '%bolt'"
_PASS3 = "select distinct p_brand || '/' || p_name as name, 'third' as converted from @part where p_name like '%ring'"


@query(
    "c8_names_to_convert",
    f"""with n as ({NAMES}), d as ({_DICT})
    select distinct name from n where name is not null and name <> 'none' and name not in (select name from d)""",
)
def _(t: Tables):
    return C.names_to_convert(t.derive(NAMES), "name", t.derive(_DICT))


def _resolved(t: Tables):
    names = C.names_to_convert(t.derive(NAMES), "name", t.derive(_DICT))
    return C.resolve_names(names, [t.derive(p) for p in (_PASS1, _PASS2, _PASS3)])


_RESOLVED = f"""
n as ({NAMES}), d as ({_DICT}), a as ({_PASS1}), b as ({_PASS2}), c as ({_PASS3}),
todo as (select distinct name from n where name is not null and name <> 'none' and name not in (select name from d)),
s1 as (select todo.name, a.converted as v from todo left join a using (name)),
s2 as (select s1.name, case when (v is null or v = 'None') and b.name is not null then b.converted else v end as v
       from s1 left join b using (name)),
s3 as (select s2.name, case when (v is null or v = 'None') and c.name is not null then c.converted else v end as v
       from s2 left join c using (name)),
resolved as (select name, nullif(v, 'None') as converted from s3)
"""


@query("c9_resolved_names", f"with {_RESOLVED} select * from resolved")
def _(t: Tables):
    return _resolved(t)


@query(
    "c10_upsert_dictionary",
    f"""with {_RESOLVED}, fresh as (select * from resolved union all select name, 'again' from d where name like '%red%')
    select coalesce(f.name, d.name) as name, case when f.name is not null then f.converted else d.converted end as converted
    from d full outer join fresh f on d.name = f.name""",
)
def _(t: Tables):
    old = t.derive(_DICT)
    again = old.where(F.col("name").contains("red")).select("name", F.lit("again").alias("converted"))
    return C.upsert_dictionary(old, _resolved(t).unionByName(again))


@query(
    "c11_replaced_names",
    f"""with n as ({NAMES}), d as ({_DICT})
    select p_partkey, case when d.name is not null then converted else n.name end as name
    from n left join d on n.name = d.name""",
)
def _(t: Tables):
    return C.replace_names(t.derive(NAMES), "name", t.derive(_DICT)).select("p_partkey", "name")


@query(
    "c12_structure_lookup",
    f"""with n as ({NAMES}), d as (select name, min(converted) as smiles from ({_PASS2}) group by name)
    select p_partkey, n.name, d.smiles from n left join d on n.name = d.name""",
)
def _(t: Tables):
    lookup = t.derive(_PASS2).withColumnRenamed("converted", "smiles")
    return C.lookup_structures(t.derive(NAMES), "name", lookup).select("p_partkey", "name", "smiles")
