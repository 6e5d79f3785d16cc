import pytest
from pyspark.sql import functions as F

from sheaf.functions import chemistry as c

V = F.col("v")


def amounts(column, formula, strict=True):
    row = column([formula], c.formula_amounts(V, strict))[0]
    return {k: v for k, v in row.asDict().items() if v}


def test_groups_multiply(column):
    got = amounts(column, "(MAPbBr3)0.05(FAPbI3)0.95")
    assert got == pytest.approx({"FA": 0.95, "MA": 0.05, "Pb": 1, "I": 2.85, "Br": 0.15})


def test_variables_count_one(column):
    got = amounts(column, "FA1-xMAxPbI3")
    assert got == {"FA": 1, "MA": 1, "Pb": 1, "I": 3}


def test_caesium_only_when_lenient(column):
    assert amounts(column, "Cs0.2FA0.8PbI3") == {"FA": 0.8, "Pb": 1, "I": 3}
    assert amounts(column, "Cs0.2FA0.8PbI3", strict=False)["CS"] == 0.2


def test_no_formula_is_all_zero(column):
    assert amounts(column, None) == {}


def test_structure_class(column):
    names = ["n-i-p", "Inverted", "NiP", None, "pin"]
    assert column(names, c.structure_class(V)) == ["NIP", "PIN", "Other", "Other", "PIN"]


def test_flags(column):
    smiles = ["CCO", "[NH3+]C", "CC(=O)O", "", None, "OH"]
    assert column(smiles, c.is_organic(V)) == [1, 0, 1, 0, 0, 0]
    assert column(smiles, c.is_functional_rich(V)) == [0, 1, 1, 0, 0, 1]


def test_counts(column):
    smiles = ["c1ccccc1N", "[NH3+]CC[I-]", "ClCCBr", "C1CC2CC1C2", "[H]C"]
    assert column(smiles, c.heavy_atoms(V)) == [7, 4, 4, 6, 1]
    assert column(smiles, c.hetero_atoms(V)) == [1, 2, 2, 0, 0]
    assert column(smiles, c.rings(V)) == [1, 0, 0, 2, 0]
