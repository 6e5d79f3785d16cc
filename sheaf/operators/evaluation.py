"""Score extracted records against annotations, field by field.

Both sides are record structs of one layout (see ``schemas.Layout``) with text
leaves: the top fields and ``tests``, a map of structs.
Comparison happens inside a paper's own row or on a long table of
``(field, label, value)``; tests of a paper are matched within its row, so no
pair of tests is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import outcomes as O
from sheaf.functions.measures import leading_digits, number, to_fraction
from sheaf.functions.similarity import ratio, ratios, with_text_similarity
from sheaf.schemas import (
    EVALUATED_PAPERS,
    IRRELEVANT_PAPERS,
    MOLECULE_FIELD,
    PERFORMANCE_FIELDS,
    POORLY_ANNOTATED_PAPERS,
    SEMI_NESTED,
    WEIGHTED_FIELDS,
    WEIGHTINGS,
    Layout,
)

RANGE_FIELDS = ("temperature", "humidity")
TYPE_FIELD = "stability_type"
TYPE_MATCH = 0.9
OUTCOMES = ("TP", "FP", "FN", "TN")


def evaluated_papers(
    df: DataFrame,
    paper: str = "paper",
    upto: int = EVALUATED_PAPERS,
    deny: Sequence[int] = (*IRRELEVANT_PAPERS, *POORLY_ANNOTATED_PAPERS),
) -> DataFrame:
    """Papers 0..upto-1 outside the deny lists."""
    p = F.col(paper)
    return df.where((p >= 0) & (p < upto) & ~p.isin(*deny))


def flatten_papers(df: DataFrame, records: str = "records") -> DataFrame:
    """Paper → molecule → record to rows; a paper without records keeps one
    null row. Sort by paper where the table is written."""
    return df.select(
        F.col("paper").try_cast("int").alias("paper"),
        F.explode_outer(records).alias("molecule", "record"),
    )


def with_molecule(df: DataFrame, record: str = "record") -> DataFrame:
    """Rows whose record exists and names a molecule."""
    return df.where(F.col(record).isNotNull() & F.col(record)[MOLECULE_FIELD].isNotNull())


def _rebuilt(record: Column, layout: Layout, top: Mapping[str, Column], tests: Column) -> Column:
    fields = [top.get(f, record[f]).alias(f) for f in layout.top]
    return F.struct(*fields, tests.alias("tests"))


def coerce_numbers(
    record: Column, layout: Layout = SEMI_NESTED, ranges_stay: bool = True
) -> Column:
    """Numeric fields keep the digits of their first four characters.

    Humidity and temperature holding a ``-`` stay text unless told otherwise.
    """

    def coerced(name: str, value: Column) -> Column:
        return leading_digits(value, keep_ranges=ranges_stay and name in RANGE_FIELDS)

    top = {f: coerced(f, record[f]) for f in layout.top_numeric}
    tests = F.transform_values(
        record["tests"],
        lambda k, t: F.struct(
            *[
                (coerced(f, t[f]) if f in layout.test_numeric else t[f]).alias(f)
                for f in layout.tests
            ]
        ),
    )
    return F.when(record.isNotNull(), _rebuilt(record, layout, top, tests))


def top_numbers(record: Column) -> list[Column]:
    """The four performance fields as doubles."""
    return [number(record[f]).alias(f) for f in PERFORMANCE_FIELDS]


def push_molecule(tests: Column, molecule: Column) -> Column:
    """Add the paper's molecule to each test map that lacks the key."""
    own = F.create_map(F.lit(MOLECULE_FIELD), molecule)
    return F.transform_values(
        tests,
        lambda k, t: F.when(F.map_contains_key(t, MOLECULE_FIELD), t).otherwise(F.map_concat(t, own)),
    )


def efficiency_fractions(tests: Column, layout: Layout = SEMI_NESTED) -> Column:
    """Efficiencies of every test as fractions, as text."""

    def fraction(value: Column) -> Column:
        return to_fraction(number(value)).cast("string")

    return F.transform_values(
        tests,
        lambda k, t: F.struct(
            *[
                (fraction(t[f]) if f.startswith("efficiency") else t[f]).alias(f)
                for f in layout.tests
            ]
        ),
    )


def blanked(record: Column, layout: Layout = SEMI_NESTED) -> Column:
    """The same record shape with every leaf null."""
    nothing = F.lit(None).cast("string")
    tests = F.transform_values(
        record["tests"], lambda k, t: F.struct(*[nothing.alias(f) for f in layout.tests])
    )
    return _rebuilt(record, layout, {f: nothing for f in layout.top}, tests)


def paired(annotations: DataFrame, extractions: DataFrame, paper: str = "paper") -> DataFrame:
    """Inner join on the paper: ``paper, pos, annotation, extracted``.

    Where a side tells its ``keys`` and ``test_keys``, they come along as
    ``annotation_keys``, ``extracted_keys`` and ``annotation_test_keys``; null
    stands for all of them. ``entries`` of the extractions come along as they are.
    """

    def keys(side: DataFrame, held: str, name: str, kind: str = "array<string>") -> Column:
        return (F.col(held) if held in side.columns else F.lit(None).cast(kind)).alias(name)

    left = annotations.select(
        paper, "pos", F.col("record").alias("annotation"), keys(annotations, "keys", "annotation_keys"),
        keys(annotations, "test_keys", "annotation_test_keys", "map<string,array<string>>"),
    )
    right = extractions.select(
        paper, F.col("record").alias("extracted"), keys(extractions, "keys", "extracted_keys"),
        *[c for c in ("entries",) if c in extractions.columns],
    )
    return left.join(right, paper)


def best_per_key(df: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """Row with the highest score per key, the first one on ties.

    A maximum combines before the shuffle; ranking a hot key would not.
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(pos))).alias("_b")
    )
    return best.select(key, "_b.*")


def best_annotation(pairs: DataFrame, paper: str = "paper") -> DataFrame:
    """Per paper the annotation whose molecule reads most like the extracted."""
    named = pairs.withColumn("_l", F.col("annotation")[MOLECULE_FIELD]).withColumn(
        "_e", F.col("extracted")[MOLECULE_FIELD]
    )
    scored = with_text_similarity(named, "_l", "_e", "similarity")
    return best_per_key(scored.drop("_l", "_e"), paper, "similarity", "pos")


def _second_of_list(value: Column) -> Column:
    return F.when(
        value.startswith("["), F.get(F.from_json(value, "array<string>"), 1)
    ).otherwise(value)


def _numbers(test: Column, fields: Sequence[str]) -> Column:
    """Missing counts as 0; a text has no number and is skipped as null."""
    values = [_second_of_list(test[f]) for f in fields]
    return F.array(*[F.when(v.isNull(), F.lit(0.0)).otherwise(number(v)) for v in values])


def test_entries(tests: Column, layout: Layout = SEMI_NESTED) -> Column:
    """Tests as an array of name, numbers and the test itself."""
    return F.transform(
        F.map_entries(tests),
        lambda e: F.struct(
            e["key"].alias("name"),
            _numbers(e["value"], layout.test_numeric).alias("nums"),
            e["value"].alias("test"),
        ),
    )


def masked_cosine(a: Column, b: Column) -> Column:
    """Cosine over the places where both sides hold a number; else 0."""
    sums = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")),
        lambda acc, p: F.when(
            p["x"].isNotNull() & p["y"].isNotNull(),
            F.struct(
                (acc["xy"] + p["x"] * p["y"]).alias("xy"),
                (acc["xx"] + p["x"] * p["x"]).alias("xx"),
                (acc["yy"] + p["y"] * p["y"]).alias("yy"),
            ),
        ).otherwise(acc),
        lambda acc: F.try_divide(acc["xy"], F.sqrt(acc["xx"]) * F.sqrt(acc["yy"])),
    )
    return F.coalesce(sums, F.lit(0.0))


def matched_tests(
    df: DataFrame,
    keys: Sequence[str],
    label_tests: str,
    extracted_tests: str,
    layout: Layout = SEMI_NESTED,
    label_keys: str | None = None,
    entries: str | None = None,
) -> DataFrame:
    """Each annotated test with its best extracted test of the same paper.

    The score is the mean of: types alike or not, the ratio of every other
    text field, and the cosine of the numbers. Rows ``keys, test, label,
    label_keys, extracted_test, value, score``; the last three are null where
    the paper has no extracted test. ``label_keys`` names a column that maps a
    test to the fields it holds; null stands for all of them, and ``entries`` one with the
    ``test_entries`` of the extracted tests, if those of a paper were read once for all its rows. The
    extracted tests stay an array next to the annotated test, so a pair is an array element, never a row.
    """
    rows = df.select(
        *keys,
        F.explode(test_entries(F.col(label_tests), layout)).alias("l"),
        (F.col(entries) if entries else test_entries(F.col(extracted_tests), layout)).alias("e"),
        (F.col(label_keys) if label_keys else F.lit(None).cast("map<string,array<string>>")).alias("_held"),
    ).withColumn("e", F.coalesce("e", F.slice(F.array(F.col("l")), 1, 0)))

    def alike(f: str) -> Column:
        return ratios(F.col("l")["test"][f], F.transform("e", lambda x: x["test"][f]))

    compared = rows.withColumns({f"_r_{f}": alike(f) for f in layout.test_text})

    def score(x: Column, i: Column) -> Column:
        total = masked_cosine(F.col("l")["nums"], x["nums"])
        for f in layout.test_text:
            own = F.coalesce(F.get(F.col(f"_r_{f}"), i), F.lit(0.0))
            if f == TYPE_FIELD:
                own = F.when(own > TYPE_MATCH, F.lit(1.0)).otherwise(F.lit(0.0))
            total = total + own
        return total / (len(layout.test_text) + 1)

    scored = compared.withColumn(
        "s", F.transform("e", lambda x, i: F.struct(score(x, i).alias("score"), (-i).alias("place")))
    ).withColumn("best", F.array_max("s"))
    hit = F.get(F.col("e"), -F.col("best")["place"])
    return scored.select(
        *keys,
        F.col("l")["name"].alias("test"),
        F.col("l")["test"].alias("label"),
        F.try_element_at("_held", F.col("l")["name"]).alias("label_keys"),
        hit["name"].alias("extracted_test"),
        hit["test"].alias("value"),
        F.col("best")["score"].alias("score"),
    )


def test_outcomes(
    matched: DataFrame,
    keys: Sequence[str],
    layout: Layout = SEMI_NESTED,
    hallucinated: str = "TN",
    ranges_stay: bool = True,
) -> DataFrame:
    """Outcome of every field of every annotated test: ``keys, field, outcome``.

    A paper without extracted tests counts FN for all test fields. Otherwise a
    field that the annotated test lacks, by ``label_keys``, has no outcome.
    Texts are compared while a test is one row; numbers are never compared as texts.
    """
    texts = [f for f in layout.tests if f in (*layout.test_text, *(RANGE_FIELDS if ranges_stay else ()))]
    both = {f: F.col("label")[f].isNotNull() & F.col("value")[f].isNotNull() for f in texts}
    matched = matched.withColumns(
        {f"_s_{f}": ratio(*(F.when(both[f], F.lower(F.col(side)[f])) for side in ("label", "value"))) for f in texts}
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col("label")[f].alias("label"),
                F.col("value")[f].alias("value"),
                F.coalesce(F.array_contains("label_keys", f), F.lit(True)).alias("asked"),
                (F.col(f"_s_{f}") if f in texts else F.lit(None).cast("double")).alias("similarity"),
            )
            for f in layout.tests
        ]
    )
    long = matched.select(
        *keys, F.col("extracted_test").isNull().alias("unmatched"), F.explode(cells).alias("c")
    ).select(*keys, "unmatched", "c.*").where("asked or unmatched")
    label, value = F.col("label"), F.col("value")
    text = O.text_outcome(label, value, F.col("similarity"), O.TEST_TEXT_THRESHOLD, hallucinated)
    ranged = O.range_outcome(label, value, F.col("similarity"), hallucinated)
    plain = O.test_numeric_outcome(
        number(label), number(_second_of_list(value)), hallucinated=hallucinated
    )
    outcome = (
        F.when(F.col("unmatched"), F.lit("FN"))
        .when(F.col("field").isin(*layout.test_text), text)
        .when(F.col("field").isin(*(RANGE_FIELDS if ranges_stay else ())), ranged)
        .otherwise(plain)
    )
    return long.select(*keys, "field", outcome.alias("outcome"))


def top_outcomes(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "annotation",
    extracted: str = "extracted",
    layout: Layout = SEMI_NESTED,
    hallucinated: str = "TN",
) -> DataFrame:
    """Outcome of every top field: ``keys, field, outcome``.

    With ``<label>_keys`` and ``<extracted>_keys``, the top fields that either
    text holds: a field the label lacks has no outcome, and one that only the
    extraction lacks is right where the label is null.
    """
    def has(side: str, f: str) -> Column:
        name = f"{side}_keys"
        if name not in df.columns:
            return F.lit(True)
        return F.coalesce(F.array_contains(name, f), F.lit(True))

    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(label)[f].alias("label"),
                F.col(extracted)[f].alias("value"),
                has(label, f).alias("asked"),
                has(extracted, f).alias("answered"),
            )
            for f in layout.top
        ]
    )
    long = df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("asked")
    own = F.when(
        F.col("field") == "electron_transport_layer", O.etl_name(F.col("label"))
    ).otherwise(F.col("label"))
    long = long.withColumn("label", own)
    # Numbers are never compared as texts.
    as_text = ~F.col("field").isin(*layout.top_numeric) & F.col("answered")
    long = long.withColumn("_l", F.when(as_text, F.col("label"))).withColumn("_v", F.when(as_text, F.col("value")))
    scored = with_text_similarity(long, "_l", "_v", "similarity")
    text = O.text_outcome(
        F.col("label"), F.col("value"), F.col("similarity"), hallucinated=hallucinated
    )
    numeric = O.numeric_outcome(
        number(F.col("label")), number(F.col("value")), hallucinated=hallucinated
    )
    outcome = (
        F.when(~F.col("answered"), O.absent_key_outcome(F.col("label")))
        .when(F.col("field").isin(*layout.top_numeric), numeric)
        .otherwise(text)
    )
    return scored.select(*keys, "field", outcome.alias("outcome"))


def confusion_counts(
    outcomes: DataFrame, by: Sequence[str] = ("field",), fields: Sequence[str] = WEIGHTED_FIELDS
) -> DataFrame:
    """One row per field with the four counts, for all ``fields`` of every other group."""
    others = [c for c in by if c != "field"]
    groups = outcomes.select(*others).distinct() if others else outcomes.sparkSession.range(1).select()
    empty = groups.select(
        *others, F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"), F.lit(None).cast("string").alias("outcome")
    )
    return outcomes.select(*by, "outcome").unionByName(empty.select(*by, "outcome")).groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    )


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def precision_recall(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    scored = counts.withColumn("precision", _safe(tp, tp + fp)).withColumn(
        "recall", _safe(tp, tp + fn)
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", _safe(2 * p * r, p + r))


def weight_of(field: Column, weights: Sequence[float]) -> Column:
    known = dict(zip(WEIGHTED_FIELDS, weights))
    out = F.lit(None).cast("double")
    for name, weight in known.items():
        out = F.when(field == name, F.lit(float(weight))).otherwise(out)
    return out


def macro_f1(
    scores: DataFrame,
    by: Sequence[str] = ("model",),
    weightings: Mapping[str, Sequence[float]] = WEIGHTINGS,
) -> DataFrame:
    """Weighted mean of the field scores: ``by, weighting, macro_f1``."""
    variants = F.array(
        *[
            F.struct(F.lit(n).alias("weighting"), weight_of(F.col("field"), w).alias("w"))
            for n, w in weightings.items()
        ]
    )
    long = scores.select(*by, "f1", F.explode(variants).alias("v")).select(*by, "f1", "v.*")
    return (
        long.where("w is not null")
        .groupBy(*by, "weighting")
        .agg(_safe(F.sum(F.col("f1") * F.col("w")), F.sum("w")).alias("macro_f1"))
    )


def score_table(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Weighting × model."""
    return scores.groupBy("weighting").agg(
        *[F.max(F.when(F.col("model") == m, F.col("macro_f1"))).alias(m) for m in models]
    )


def evaluate(
    annotations: DataFrame,
    extractions: DataFrame,
    layout: Layout = SEMI_NESTED,
    ranges_stay: bool = True,
) -> DataFrame:
    """Whole comparison: one row per field with counts, precision, recall, F1.

    Inputs are ``paper, pos, record`` and ``paper, record``, with ``keys`` and
    ``test_keys`` as ``records.conformed`` gives them if fields may be missing. A layout that
    keeps the molecule inside the tests has one annotation per paper, so none
    needs to be chosen.
    """
    number_of = lambda side: side.withColumn(
        "record", coerce_numbers(F.col("record"), layout, ranges_stay)
    )
    if MOLECULE_FIELD in layout.top:
        # The molecule is a text: numbers are read in the annotation that is chosen alone.
        pairs = best_annotation(paired(with_molecule(annotations), number_of(extractions)))
        pairs = pairs.withColumn("annotation", coerce_numbers(F.col("annotation"), layout, ranges_stay))
    else:
        pairs = paired(number_of(annotations.where("record is not null")), number_of(extractions))
    tests = pairs.select(
        "paper", F.col("annotation.tests").alias("l"), F.col("extracted.tests").alias("e"), "annotation_test_keys"
    )
    matched = matched_tests(tests, ["paper"], "l", "e", layout, "annotation_test_keys")
    outcomes = top_outcomes(pairs, ["paper"], layout=layout).unionByName(
        test_outcomes(matched, ["paper"], layout, ranges_stay=ranges_stay)
    )
    return precision_recall(confusion_counts(outcomes, fields=(*layout.top, *layout.tests)))
