"""Canonical schemas and the fixed values every operator shares."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

# Field names of an extraction record.
MATERIAL_FIELDS = (
    "perovskite_composition",
    "electron_transport_layer",
    "hole_transport_layer",
    "structure_pin_nip",
)
MOLECULE_FIELD = "passivating_molecule"
PERFORMANCE_FIELDS = ("control_pce", "treated_pce", "control_voc", "treated_voc")
TEST_FIELDS = (
    "stability_type",
    "humidity",
    "temperature",
    "time",
    "efficiency_cont",
    "efficiency_tret",
)
TOP_FIELDS = (*MATERIAL_FIELDS, MOLECULE_FIELD, *PERFORMANCE_FIELDS)

# Spellings of a field and the canonical name.
FIELD_ALIASES = {
    "retained_proportion_cont": "efficiency_cont",
    "retained_proportion_tret": "efficiency_tret",
    "retained_percentage_cont": "efficiency_cont",
    "retained_percentage_tret": "efficiency_tret",
    "test_name": "stability_type",
    "pin_nip_structure": "structure_pin_nip",
    "treated_pec": "treated_pce",
    "structure": "structure_pin_nip",
    "device_structure": "structure_pin_nip",
    "control_efficiency": "efficiency_cont",
    "treatment_efficiency": "efficiency_tret",
}


class Layout(NamedTuple):
    """Which fields a record holds at the top and inside each test."""

    top: tuple[str, ...]
    tests: tuple[str, ...]

    @property
    def top_numeric(self) -> tuple[str, ...]:
        return tuple(f for f in self.top if f in PERFORMANCE_FIELDS)

    @property
    def test_text(self) -> tuple[str, ...]:
        return tuple(f for f in self.tests if f in ("stability_type", MOLECULE_FIELD))

    @property
    def test_numeric(self) -> tuple[str, ...]:
        return tuple(f for f in self.tests if f not in self.test_text)


# Tests of the fully nested layout, in comparison order.
NESTED_TEST_FIELDS = (
    "stability_type",
    "passivating_molecule",
    "temperature",
    "time",
    "humidity",
    "efficiency_cont",
    "efficiency_tret",
    "control_pce",
    "treated_pce",
    "control_voc",
    "treated_voc",
)
SEMI_NESTED = Layout(TOP_FIELDS, TEST_FIELDS)
FULLY_NESTED = Layout(MATERIAL_FIELDS, NESTED_TEST_FIELDS)

# Annotation tags that carry nothing for the record.
IGNORED_TAGS = (
    "additive_molecule",
    "treatment_element",
    "control_element",
    "metal_contact",
    "perovskite_molecule",
)

# Texts that mean "no value".
NULL_TOKENS = ("null", "n/a", "none", "-", "na")

# Spellings of a device structure.
STRUCTURE_NAMES = {
    "NIP": "NIP",
    "PIN": "PIN",
    "n-i-p": "NIP",
    "p-i-n": "PIN",
    "Inverted": "PIN",
    "pin": "PIN",
    "ITO/SnO2/perovskite/Spiro-OMeTAD/Ag": "NIP",
}

# Species read from a composition formula, in match order.
SPECIES = ("FA", "MA", "CS", "Rb", "Pb", "Sn", "I", "Br", "Cl")

# Words of the keyword rule.
RELEVANCE_STEMS = ("passivation", "passivator", "passivating")
EFFICIENCY_PHRASES = ("pce", "power conversion efficiency")

# Paper ids 0..149 that the quality evaluation leaves out.
IRRELEVANT_PAPERS = (
    26, 28, 29, 30, 32, 33, 34, 35, 38, 43, 44, 45, 52, 54, 55, 56, 57, 58, 63,
    66, 68, 69, 70, 78, 80, 83, 84, 86, 87, 88, 89, 90, 91, 92, 93, 94, 98, 100,
    101, 102, 103, 104, 105, 106, 108, 109, 110, 111, 112, 115, 116, 117, 119,
    121, 125, 128, 129, 130, 132, 134, 136, 138, 139, 140,
)
POORLY_ANNOTATED_PAPERS = (1, 18, 20, 25, 27, 41, 51, 61, 67, 71, 76, 135, 141, 145)
EVALUATED_PAPERS = 150

# Field order of the weight lists, and the lists themselves.
WEIGHTED_FIELDS = (
    "perovskite_composition",
    "electron_transport_layer",
    "hole_transport_layer",
    "structure_pin_nip",
    "stability_type",
    "temperature",
    "time",
    "humidity",
    "passivating_molecule",
    "efficiency_cont",
    "efficiency_tret",
    "control_pce",
    "treated_pce",
    "control_voc",
    "treated_voc",
)
WEIGHTINGS = {
    "equal": (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1),
    "stability": (1, 1, 1, 1, 2, 2, 2, 2, 1, 2, 2, 1, 1, 1, 1),
    "structure": (2, 2, 2, 2, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1, 1),
    "numeric": (1, 1, 1, 1, 1, 2, 2, 2, 1, 2, 2, 2, 2, 2, 2),
    "treated_only": (1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 1),
    "efficiency_change": (1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 1, 1, 1),
    "efficiency_retained": (1, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 1, 0, 0),
}

# Annotations and relations may stand in a sentence, a passage or the document.
_INFON = "infon:array<struct<_key:string,_VALUE:string>>"
_GRAPH = (
    f"annotation:array<struct<_id:string,{_INFON},text:string>>,"
    f"relation:array<struct<{_INFON},node:array<struct<_refid:string>>>>"
)
BIOC = f"struct<passage:array<struct<text:string,sentence:array<struct<text:string,{_GRAPH}>>,{_GRAPH}>>,{_GRAPH}>"
