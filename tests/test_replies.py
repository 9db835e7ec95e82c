"""Shapes of replies."""

import json

import pytest

from veilframe.sources import replies


def pages(spark, source, *bodies):
    return spark.createDataFrame([(source, f"k{k}", b if isinstance(b, str) or b is None else json.dumps(b)) for k, b in enumerate(bodies)], "source string, key string, page string")


@pytest.mark.parametrize(
    "body,code",
    [
        ({"data": {"results": [{"ORPHAcode": 558}]}}, "558"),
        ({"data": {"results": {"orphacode": "558"}}}, "558"),
        ({"results": {"ORPHAcode": 558}}, "558"),
        ({"data": [{"ORPHAcode": 558}, {"ORPHAcode": 1}]}, "558"),
        ([{"orphacode": 558}], "558"),
        ({"ORPHAcode": 558}, "558"),
        ({"ORPHAcode": "", "DisorderDisorderAssociation": [{"TargetDisorder": {"orphacode": 7}}, {}]}, "7"),
        ({"ORPHAcode": 0, "DisorderDisorderAssociation": []}, None),
        ({"data": {"results": []}}, None),
        ({"data": None}, None),
        ({}, None),
        ("no json", None),
        ("[1, 2]", None),
        (None, None),
    ],
)
def test_rare_codes(spark, body, code):
    assert [r["code"] for r in replies.rare_codes(pages(spark, "rare-names", body)).collect()] == ([code] if code else [])


def test_epidemiology(spark):
    one = {"PrevalenceType": "Point prevalence", "PrevalenceClass": "1-9 / 100 000"}
    two = {"prevalenceType": "x", "prevalenceClass": "y"}
    got = replies.epidemiology(pages(spark, "rare-figures", {"data": {"results": {"Prevalence": [one, 3, two]}}}, [{"prevalences": two}], {"results": {"Prevalences": []}}, {"none": 1})).collect()
    assert {r["code"]: [tuple(i) for i in r["items"]] for r in got} == {"k0": [("Point prevalence", "1-9 / 100 000"), ("", None), ("x", "y")], "k1": [("x", "y")], "k2": []}


def test_census_survey_and_work(spark):
    rows = replies.census(pages(spark, "census", [["NAME", "B01"], ["Texas", "5"], ["short"]], [["NAME"]], "x")).collect()
    assert [r["row"] for r in rows if r["row"]] == [{"NAME": "Texas", "B01": "5"}] or rows == []
    told = replies.survey(pages(spark, "survey", [{"topic": "T", "datavaluetype": "Crude Prevalence", "locationabbr": "US", "yearend": "2020", "datavalue": "1.5"}, {"topic": "U", "datavalue": ""}, 3])).collect()
    assert tuple(told[0]) == ("T", "Crude Prevalence", "US", 2020, 1.5) and told[1]["figure"] is None
    jobs = replies.occupation_codes(pages(spark, "occupations", {"Occupation": [{"Code": "29-1141"}]}, {"Occupation": []}, {})).collect()
    assert [tuple(r) for r in jobs] == [("k0", "29-1141")]
    series = {"series": [{"seriesID": "OEUN000000000000029114101", "data": [{"value": "2,900,000"}]}, {"seriesID": "OEUN000000000000025203101", "data": []}]}
    people = replies.employment(pages(spark, "employment", {"status": "REQUEST_SUCCEEDED", "Results": series}, {"status": "NO", "Results": series})).collect()
    assert [tuple(r) for r in people] == [("29-1141", 2_900_000)]


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "marfan%20syndrome.json").write_text('{"ORPHAcode": 558}')
    (tmp_path / "none.json").write_text("")
    got = replies.rare_codes(replies.read_pages(spark, str(tmp_path), "rare-names")).collect()
    assert [tuple(r) for r in got] == [("marfan syndrome", "558")]
