"""Extraction records: parse, repair, conform, resolve names."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.measures import conform_unit, first_of_list
from sheaf.functions.text import brace_span, is_json, quoted, repair_json
from sheaf.schemas import FIELD_ALIASES, SEMI_NESTED, Layout

NO_NAME = "none"
UNRESOLVED = "None"


def parse_outcome(df: DataFrame, column: str) -> DataFrame:
    """Add ``record`` (valid JSON text), ``raw`` (kept text) and ``status``.

    null stays null; text without braces stays as it is; a span that still
    fails to parse after the repair is kept as repaired text.
    """
    text = F.col(column)
    spanned = df.withColumn("_span", brace_span(text))
    fixed = spanned.withColumn("_fix", F.when(is_json("_span"), F.col("_span")).otherwise(repair_json(F.col("_span"))))
    good = is_json("_fix")
    return (
        fixed.withColumn("record", F.when(good, F.col("_fix")))
        .withColumn("raw", F.when(~F.coalesce(good, F.lit(False)), F.coalesce("_fix", text)))
        .withColumn(
            "status",
            F.when(text.isNull(), "null").when(good, "parsed").otherwise("raw"),
        )
        .drop("_span", "_fix")
    )


def lenient_records(df: DataFrame, column: str, repair: bool = False) -> DataFrame:
    """Text to record with ``None`` read as null; null on failure."""
    plain = F.replace(F.col(column), F.lit("None"), F.lit("null"))
    fixed = repair_json(F.col(column)) if repair else plain
    return df.withColumn("_fix", fixed).withColumn("record", F.when(is_json("_fix"), F.col("_fix"))).drop("_fix")


def export_value(record: Column, raw: Column) -> Column:
    """JSON value of the keyed export: record, quoted text or null."""
    return F.coalesce(record, F.when(raw.isNotNull(), quoted(raw)), F.lit("null"))


def keyed_export(df: DataFrame, key: str) -> DataFrame:
    """One line ``{"<id>": value}`` per row of :func:`parse_outcome`."""
    value = export_value(F.col("record"), F.col("raw"))
    raw_given = F.when(F.col("status") == "null", F.lit("null")).otherwise(value)
    return df.select(F.concat(F.lit("{"), quoted(F.col(key).cast("string")), F.lit(": "), raw_given, F.lit("}")).alias("value"))


# An extractor gets the texts of one Arrow batch and returns their answers.
Extractor = Callable[[Sequence[str]], Sequence[str | None]]


def apply_extractor(
    df: DataFrame, key: str, text: str, extractor: Extractor
) -> DataFrame:
    """Run any extractor over the table, batch by batch: ``key, json_output``.

    The batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``; the
    session setting decides how much text an executor holds at a time.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("json_output", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = list(extractor(batch[text].tolist()))
            yield pd.DataFrame({key: batch[key], "json_output": answers})

    return df.select(key, text).mapInPandas(run, schema)


def rule_records(text: Column, fields: Mapping[str, str]) -> Column:
    """Deterministic default: JSON of the first match of a pattern per field.

    Null where no field matches. Patterns are those of the SQL engine.
    """
    found = {name: F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit("")) for name, pattern in fields.items()}
    record = F.to_json(F.struct(*[c.alias(n) for n, c in found.items()]), {"ignoreNullFields": "false"})
    return F.when(F.coalesce(*found.values()).isNotNull(), record)


def spellings(field: str, aliases: Mapping[str, str] = FIELD_ALIASES) -> list[str]:
    """The canonical name and its aliases."""
    return [field, *[old for old, new in aliases.items() if new == field]]


def _loose_schema(fields: Sequence[str]) -> str:
    return ", ".join(f"`{name}`: string" for f in fields for name in spellings(f))


def _canonical(loose: Column, fields: Sequence[str]) -> list[Column]:
    """One column per field; a filled alias wins, the last listed one first."""
    return [
        F.coalesce(*[loose[name] for name in reversed(spellings(f))]).alias(f) for f in fields
    ]


def conformed(df: DataFrame, record: str, layout: Layout = SEMI_NESTED) -> DataFrame:
    """Fixed record struct ``conformed``: missing keys become null, aliased
    keys take their canonical name, tests are a map of structs, and keys
    outside the schema are kept as text in ``extra``. ``keys`` names the top
    fields that the text holds, under any spelling and with any value, and
    ``test_keys`` the fields that each of its tests holds.

    Each text is parsed into columns first: an expression nested in a lambda
    would parse it once per key.
    """
    known = [name for f in layout.top for name in spellings(f)]
    is_test = lambda k: k.startswith("test")
    loose_test = f"struct<{_loose_schema(layout.tests)}>"
    parsed = df.withColumns(
        {
            "_top": F.from_json(record, f"struct<{_loose_schema(layout.top)}>"),
            "_all": F.from_json(record, "map<string,string>"),
        }
    ).withColumn(
        "_tests",
        F.transform_values(
            F.map_filter("_all", lambda k, v: is_test(k) & v.isNotNull()),
            lambda k, v: F.from_json(v, loose_test),
        ),
    )
    tests = F.transform_values(
        "_tests", lambda k, t: F.struct(*_canonical(t, layout.tests))
    )
    extra = F.map_filter("_all", lambda k, v: ~k.isin(*known) & ~is_test(k))

    def held(keys: Column, fields: Sequence[str]) -> Column:
        # A look for each spelling costs far less than a set of the keys for each field.
        named = {f: [F.array_contains(keys, n) for n in spellings(f)] for f in fields}
        every = [F.when(reduce(Column.__or__, some), F.lit(f)) for f, some in named.items()]
        return F.when(keys.isNotNull(), F.array_compact(F.array(*every)))

    test_keys = F.transform_values(
        F.map_filter("_all", lambda k, v: is_test(k) & v.isNotNull()),
        lambda k, v: F.map_keys(F.from_json(v, "map<string,string>")),
    )
    return (
        parsed.withColumn(
            "conformed", F.struct(*_canonical(F.col("_top"), layout.top), tests.alias("tests"))
        )
        .withColumn("extra", extra)
        .withColumn("keys", held(F.map_keys("_all"), layout.top))
        .withColumn("_names", test_keys)
        .withColumn("test_keys", F.transform_values("_names", lambda k, n: held(n, layout.tests)))
        .drop("_top", "_all", "_tests", "_names")
    )


def conformed_flat(df: DataFrame, record: str, layout: Layout = SEMI_NESTED) -> DataFrame:
    """A record whose single test lies flat among the top fields."""
    fields = (*layout.top, *[f for f in layout.tests if f not in layout.top])
    flat = df.withColumn("_top", F.from_json(record, f"struct<{_loose_schema(fields)}>"))
    loose = F.col("_top")
    test = F.struct(*_canonical(loose, layout.tests))
    whole = F.struct(
        *_canonical(loose, layout.top), F.create_map(F.lit("test_1"), test).alias("tests")
    )
    return flat.withColumn("conformed", whole).drop("_top")


def conformed_list(
    df: DataFrame, record: str, tests: str = "stability_tests", layout: Layout = SEMI_NESTED
) -> DataFrame:
    """A record whose tests are a list: they are named by their place."""
    loose_test = f"struct<{_loose_schema(layout.tests)}>"
    loose = f"struct<{_loose_schema(layout.top)}, `{tests}`: array<{loose_test}>>"
    parsed = df.withColumn("_top", F.from_json(record, loose))
    entries = F.transform(
        F.col("_top")[tests],
        lambda t, i: F.struct(
            F.concat(F.lit("test_"), (i + 1).cast("string")).alias("key"),
            F.struct(*_canonical(t, layout.tests)).alias("value"),
        ),
    )
    whole = F.struct(
        *_canonical(F.col("_top"), layout.top), F.map_from_entries(entries).alias("tests")
    )
    return parsed.withColumn("conformed", whole).drop("_top")


def null_record(layout: Layout = SEMI_NESTED) -> Column:
    """Template of a missing record: all fields null, one empty test."""
    nothing = F.lit(None).cast("string")
    empty = F.struct(*[nothing.alias(f) for f in layout.tests])
    return F.struct(
        *[nothing.alias(f) for f in layout.top],
        F.create_map(F.lit("test_1"), empty).alias("tests"),
    )


def conform_values(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """First list element, then a number without unit, per named column."""
    return df.withColumns(
        {c: conform_unit(first_of_list(F.col(c)), kind) for c, kind in kinds.items()}
    )


def key_batches(df: DataFrame, key: str, size: int = 50, seed: int = 0) -> DataFrame:
    """Number keys into batches of ``size`` for calls to an outside service."""
    from sheaf.operators.order_stats import hash_rank

    ranked = hash_rank(df, key, seed, "_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def upsert_batch(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Formatted values replace, unformatted ones stay; of several for one key the least."""
    fresh = new.groupBy(key).agg(F.min(value).alias("_new"))
    joined = old.join(fresh, key, "left")
    return joined.withColumn(value, F.coalesce("_new", value)).drop("_new")


def names_to_convert(df: DataFrame, name: str, known: DataFrame, known_name: str = "name") -> DataFrame:
    """Distinct usable names the dictionary does not hold."""
    names = df.select(F.col(name).alias("name")).where(
        F.col("name").isNotNull() & (F.col("name") != NO_NAME)
    )
    return names.distinct().join(
        known.select(F.col(known_name).alias("name")), "name", "left_anti"
    )


def one_each(dictionary: DataFrame, name: str = "name", converted: str = "converted") -> DataFrame:
    """One entry per name: the least conversion, null only where there is no other."""
    return dictionary.groupBy(name).agg(F.min(converted).alias(converted))


def resolve_names(names: DataFrame, passes: Sequence[DataFrame]) -> DataFrame:
    """Try one lookup after the other; each sees what is still unresolved.

    A later pass overwrites the answer of a retried name, also with null. Of
    several answers of one pass the least counts, null last.
    """
    out = names.select("name", F.lit(None).cast("string").alias("converted"), F.lit(True).alias("_open"))
    for lookup in passes:
        answers = one_each(lookup).select("name", F.col("converted").alias("_new"), F.lit(True).alias("_hit"))
        out = out.join(answers, "name", "left")
        retried = F.col("_open") & F.coalesce("_hit", F.lit(False))
        out = out.withColumn("converted", F.when(retried, F.col("_new")).otherwise(F.col("converted")))
        open_ = F.col("converted").isNull() | (F.col("converted") == UNRESOLVED)
        out = out.withColumn("_open", open_).drop("_new", "_hit")
    resolved = F.when(~F.col("_open"), F.col("converted"))
    return out.select("name", resolved.alias("converted"))


def upsert_dictionary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join; where the new side has the key it wins, even with null."""
    left = old.select("name", F.col("converted").alias("_old"))
    right = new.select("name", F.col("converted").alias("_new"), F.lit(True).alias("_hit"))
    joined = left.join(right, "name", "full_outer")
    value = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("_old"))
    return joined.select("name", value.alias("converted"))


def replace_names(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Known names become their conversion, even a null one.

    The dictionary's size is left to the optimizer: it is broadcast only when
    its statistics allow.
    """
    known = one_each(dictionary).select(
        F.col("name").alias(column), F.col("converted").alias("_to"), F.lit(True).alias("_hit")
    )
    joined = df.join(known, column, "left")
    value = F.when(F.col("_hit"), F.col("_to")).otherwise(F.col(column))
    return joined.withColumn(column, value).drop("_to", "_hit")


def lookup_structures(df: DataFrame, column: str, lookup: DataFrame, out: str = "smiles") -> DataFrame:
    """Name to line notation or null, from a landed lookup table; of several the least."""
    known = lookup.groupBy(F.col("name").alias(column)).agg(F.min("smiles").alias(out))
    return df.join(known, column, "left")
