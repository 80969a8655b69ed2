from __future__ import annotations

import pytest

from quillspark.operators.normalise import normalised

CASES = [
    (None, "", None, None),
    ("", "", None, None),
    ("n/a", "", None, None),
    ("ITAA1997:Section:6-5", "", None, "ITAA1997:Section:6-5"),
    ("Section:6-5", "of the Income Tax Assessment Act 1936", None, "ITAA1936:Section:6-5"),
    ("Section:8-1", "as in 1936", None, "ITAA1936:Section:8-1"),
    ("Section:8-1", "between 1936 and 1997", None, "ITAA1997:Section:8-1"),
    ("Section:8-1", "the GST Act says", None, "GSTA1999:Section:8-1"),
    ("GSTA1999", "", None, "ITAA1997:Section:1999"),
    ("Paragraph:(a)", "", "ITAA1997:Section:6-5", "ITAA1997:Section:6-5"),
    ("this_section", "", "ITAA1997:Section:6-5", "ITAA1997:Section:6-5"),
    ("TAA1953:Schedule_1_Section_12-35", "", None, "TAA1953:Schedule:1:Section:12-35"),
    ("TAA1953:Schedule:1", "", None, "TAA1953:Schedule:1"),
    ("Schedule_2F:Division_266", "", None, "ITAA1936:Schedule:2F:Division:D"),
    ("Schedule:3", "", None, "ITAA1997:Schedule:3"),
    ("Part_III:Division_7A", "", None, "ITAA1997:Part:III:Division:7A"),
    ("Section:102AG", "", None, "ITAA1936:Section:102AG"),
    ("Section:83A", "", None, "ITAA1997:Division:83A"),
    ("Division:40-B", "", None, "ITAA1997:Division:D"),
    ("division:40-B", "", None, "ITAA1997:Subdivision:40-B"),
    ("Subdivision:115-A", "", None, "ITAA1997:Subdivision:115-A"),
    ("Subsection_6-5_1 of", "", None, "ITAA1997:Section:6-5"),
    ("Definition:car park", "", None, "ITAA1997:Definition:car_park"),
    ("something else", "", None, "ITAA1997:Reference:something_else"),
    ("Section:40", "", None, "ITAA1997:Division:40"),
]


@pytest.fixture(scope="module")
def found(spark):
    registry = spark.createDataFrame([("ITAA1997", "83A", "Division"), ("ITAA1997", "40", "Division"), ("ITAA1997", "6-5", "Section")], "act string, local_id string, type string")
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, raw string, snippet string, source_ref_id string")
    return {r["i"]: r for r in normalised(rows, registry, "ITAA1997").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(found, i):
    assert found[i]["ref_id"] == CASES[i][3]


def test_corrections_are_counted(found):
    assert sum(r["corrected"] for r in found.values()) == 2
