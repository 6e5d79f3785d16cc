"""Expressions over composition formulas, device names and line notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.schemas import SPECIES, STRUCTURE_NAMES

_GROUP = r"\(([^)]+)\)\s*([0-9.]+)"
_GROUP_CUT = r"\([^)]*\)\s*[0-9.]+"
_ATOM = r"(\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops])"


def _amount(text: Column) -> Column:
    """A written count; a missing or unreadable one counts as 1."""
    return F.coalesce(
        F.when(text.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast("double")), F.lit(1.0)
    )


def _species_counts(text: Column, names: tuple[str, ...]) -> Column:
    pattern = "(" + "|".join(names) + r")\s*([0-9.]*)"
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), 1).alias("name"),
        F.regexp_extract_all(text, F.lit(pattern), 2).alias("count"),
    )


def formula_amounts(formula: Column, strict: bool = True) -> Column:
    """Struct of the amount of every species in a composition formula.

    Counts inside ``(…)c`` are multiplied by c, the rest is added on top.
    ``strict=False`` also reads caesium in its usual spelling.
    """
    names = SPECIES if strict else tuple("Cs" if s == "CS" else s for s in SPECIES)
    text = F.coalesce(formula, F.lit(""))
    groups = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_GROUP), 1).alias("inner"),
        F.regexp_extract_all(text, F.lit(_GROUP), 2).alias("factor"),
    )
    inside = F.flatten(
        F.transform(
            groups,
            lambda g: F.transform(
                _species_counts(g["inner"], names),
                lambda s: F.struct(
                    s["name"].alias("name"),
                    (_amount(s["count"]) * _amount(g["factor"])).alias("amount"),
                ),
            ),
        )
    )
    rest = F.transform(
        _species_counts(F.regexp_replace(text, _GROUP_CUT, ""), names),
        lambda s: F.struct(s["name"].alias("name"), _amount(s["count"]).alias("amount")),
    )
    found = F.concat(inside, rest)

    def total(name: str) -> Column:
        own = F.filter(found, lambda s: s["name"] == name)
        return F.round(F.aggregate(own, F.lit(0.0), lambda acc, s: acc + s["amount"]), 2)

    return F.struct(*[total(n).alias(s) for n, s in zip(names, SPECIES)])


def structure_class(name: Column) -> Column:
    """Known spellings to NIP or PIN, everything else to Other."""
    out = F.lit("Other")
    for spelling, kind in STRUCTURE_NAMES.items():
        out = F.when(name == spelling, F.lit(kind)).otherwise(out)
    return out


def is_organic(smiles: Column) -> Column:
    s = F.coalesce(smiles, F.lit(""))
    return (s.contains("C") & ~s.rlike(r"\[.*?\]")).cast("int")


def is_functional_rich(smiles: Column) -> Column:
    s = F.coalesce(smiles, F.lit(""))
    return s.rlike(r"N|C\(=O\)O|OH|C=O").cast("int")


def heavy_atoms(smiles: Column) -> Column:
    atoms = F.regexp_extract_all(smiles, F.lit(_ATOM), 1)
    return F.size(F.filter(atoms, lambda a: ~a.rlike(r"^\[[0-9]*H[+-]?\]$")))


def hetero_atoms(smiles: Column) -> Column:
    atoms = F.regexp_extract_all(smiles, F.lit(_ATOM), 1)
    return F.size(
        F.filter(atoms, lambda a: ~a.rlike(r"^\[[0-9]*H[+-]?\]$") & ~a.rlike(r"^\[?[0-9]*[Cc](?![a-z])"))
    )


def rings(smiles: Column) -> Column:
    """Ring closures come in pairs of digits outside brackets."""
    bare = F.regexp_replace(smiles, r"\[[^\]]*\]", "")
    closures = F.regexp_extract_all(bare, F.lit(r"(%[0-9][0-9]|[0-9])"), 1)
    return F.floor(F.size(closures) / 2).cast("int")
