"""Clean extracted tests and merge them with hand annotations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.measures import CONVERTERS
from sheaf.schemas import TEST_FIELDS

TEST_COLUMNS = tuple(f"test_{i}" for i in range(1, 11))
CONTROL, TREATED = "efficiency_cont", "efficiency_tret"


def expand_tests(
    df: DataFrame,
    columns: Sequence[str] = TEST_COLUMNS,
    fields: Sequence[str] = TEST_FIELDS,
) -> tuple[DataFrame, DataFrame]:
    """Tests as rows, and the unparsable cells.

    A cell holds one dictionary or a list of them, written with single or
    double quotes. Papers without tests vanish from the first frame. Keys that
    are no known field stay as text in the map ``extra``.
    """
    kept = [c for c in df.columns if c not in columns]
    cells = F.array(*[F.struct(F.lit(c).alias("test"), F.col(c).alias("cell")) for c in columns])
    long = df.select(*kept, F.explode(cells).alias("_c")).select(*kept, "_c.test", "_c.cell")
    long = long.where("cell is not null")
    text = F.regexp_replace("cell", r"\bNone\b", "null")
    found = F.array(F.from_json(text, "map<string,string>"))
    alone = F.get(F.transform(found, lambda m: F.when(m.isNotNull(), F.array(m))), 0)
    listed = F.from_json(text, "array<map<string,string>>")
    one = F.ltrim(text).startswith("{")
    # Each cell is parsed once, as one dictionary or as a list of them.
    parsed = long.withColumn("_p", F.when(one, alone).otherwise(listed))
    rejected = parsed.where("_p is null").drop("_p")
    rows = parsed.select(*kept, "test", F.explode("_p").alias("_t"))
    extra = F.map_filter("_t", lambda k, v: ~k.isin(*fields))
    return rows.select(*kept, "test", *[F.col("_t")[f].alias(f) for f in fields], extra.alias("extra")), rejected


def expand_keeping_empty(df: DataFrame, tests: str, fields: Sequence[str] = TEST_FIELDS) -> DataFrame:
    """One row per test of a map column; papers without tests keep one row.

    A test's own value wins over the top field of the same name, also a null.
    """
    kept = [c for c in df.columns if c != tests]
    rows = df.select(*kept, F.explode_outer(tests).alias("test", "_t"))
    own = {f: F.col("_t")[f] for f in fields}
    merged = [
        F.when(F.col("_t").isNotNull(), own[c]).otherwise(F.col(c)).alias(c) if c in own else F.col(c)
        for c in kept
    ]
    added = [own[f].alias(f) for f in fields if f not in kept]
    return rows.select(*merged, "test", *added)


def convert_columns(
    df: DataFrame, kinds: Mapping[str, str], strict: bool = True
) -> DataFrame:
    """Numbers for every column named with its kind, in one projection."""
    return df.withColumns(
        {c: CONVERTERS[kind](F.col(c), strict=strict) for c, kind in kinds.items()}
    )


# Names before and after the merge, and back at the models' edge.
TO_CANONICAL = {
    "retained_percentage_cont": "efficiency_cont",
    "retained_percentage_tret": "efficiency_tret",
}
TO_MODEL = {
    "efficiency_cont": "retained_percentage_cont",
    "efficiency_tret": "retained_percentage_tret",
    "smiles": "passivator_smiles",
    "structure_pin_nip": "pin_nip_structure",
}


def rename(df: DataFrame, names: Mapping[str, str] = TO_CANONICAL) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def merge_sources(annotated: DataFrame, extracted: DataFrame) -> DataFrame:
    """Annotations plus the shared columns of the extractions."""
    common = [c for c in annotated.columns if c in extracted.columns]
    return annotated.unionByName(extracted.select(*common), allowMissingColumns=True)


def repair_retained(df: DataFrame, control: str = CONTROL, treated: str = TREATED) -> DataFrame:
    """A lone control value is a misplaced treated value: move it."""
    misplaced = F.col(treated).isNull() & F.col(control).isNotNull()
    return df.withColumns(
        {
            treated: F.when(misplaced, F.col(control)).otherwise(F.col(treated)),
            control: F.when(~misplaced, F.col(control)),
        }
    )


def percent_change(control: Column, treated: Column) -> Column:
    return F.try_divide(treated - control, control) * 100


def equals_flag(column: Column, value: str) -> Column:
    return F.coalesce(column == value, F.lit(False))


def plausible(
    df: DataFrame,
    control: str,
    treated: str,
    change: str,
    low: float = 10.0,
    high: float = 35.0,
) -> DataFrame:
    """Efficiencies above ``low`` up to ``high``, change up to ``high``."""
    inside = lambda c: (F.col(c) > low) & (F.col(c) <= high)
    return df.where(inside(control) & inside(treated) & (F.col(change) <= high))


def bounded(
    df: DataFrame, at_least: Mapping[str, float] = {}, at_most: Mapping[str, float] = {}
) -> DataFrame:
    """Keep rows inside all bounds; a null value fails its bound."""
    for column, value in at_least.items():
        df = df.where(F.col(column) >= value)
    for column, value in at_most.items():
        df = df.where(F.col(column) <= value)
    return df
