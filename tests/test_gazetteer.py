"""Dictionaries over texts: the trie, the join and plain Python agree."""

import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators import gazetteer

TERMS = [("New York", "place", None, 0.7), ("new york city", "place", "nyc", 0.8), ("york", "name", None, 0.5), ("c++", "skill", None, 0.9), ("Ünïcode", "word", None, 0.9), ("İzmir", "place", None, 0.7), ("a b a", "odd", None, 0.1), ("漢字", "word", None, 0.9), ("New York", "place", None, 0.7), ("", "none", None, 0.1), (None, "none", None, 0.1), ("  ", "none", None, 0.1)]
TEXTS = [
    None, "", "   ", "New  York\nCity, new york", "york yorkshire York.", "C++ and c ++ and c+", "ÜNÏCODE ünïcode", "in İzmir now", "a b a b a b", "漢字 漢字漢字", "😀 york 😀", "x " * 20_000 + "york",
]


def plain(text):
    """All matches, by the words of every run."""
    token = re.compile(r"\w+|[^\w\s]")
    places = [m.span() for m in token.finditer(text or "")]
    low = [(text[a:b]).lower() for a, b in places]
    out = set()
    for term, kind, value, confidence in TERMS:
        own = [m.group().lower() for m in token.finditer(term or "")]
        for k in range(len(low) - len(own) + 1):
            if own and low[k : k + len(own)] == own:
                a, b = places[k][0], places[k + len(own) - 1][1]
                out.add((kind, value or " ".join(own), a, b, text[a:b], confidence))
    return sorted(out, key=lambda s: (s[2], s[3], s[0], s[1]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumns({"kind": F.lit("x"), "value": F.lit("y"), "found": F.lit("z")}).repartition(3)


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "term string, kind string, value string, confidence double")


@pytest.mark.parametrize("most", [gazetteer.MAX_TERMS, 0])
def test_same_spans_however_the_dictionary_comes(docs, terms, most):
    got = {r["id"]: [tuple(s) for s in r["found"]] for r in gazetteer.annotate(docs.drop("found"), terms, "id", max_terms=most).collect()}
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)}
    rows = gazetteer.find(docs, terms, "id", max_terms=most).collect()
    assert sorted(tuple(r) for r in rows) == sorted((k, *s) for k, t in enumerate(TEXTS) for s in plain(t))


def test_longest(docs, terms):
    one = docs.where("id = 3").select(gazetteer.longest(gazetteer.spans(F.col("text"), terms)).alias("s")).first()["s"]
    assert [(s["value"], s["start"], s["end"]) for s in one] == [("nyc", 0, 14), ("new york", 16, 24)]


def test_many_terms(spark, docs):
    """A dictionary beyond the trie's bound, of terms that share words."""
    many = spark.range(300_000).select(F.concat(F.lit("item "), F.col("id")).alias("term"))
    assert not gazetteer.fits(gazetteer.dictionary(many))
    df = spark.createDataFrame([(1, "item 7, Item 299999 and item 300000")], "id int, text string")
    assert sorted(r["value"] for r in gazetteer.find(df, many, "id").collect()) == ["item 299999", "item 7"]
    with pytest.raises(ValueError, match="too large"):
        gazetteer.spans(F.col("text"), many)


def test_empty(spark, docs, terms):
    none = terms.where("false")
    assert gazetteer.find(docs, none, "id").count() == gazetteer.find(docs, none, "id", max_terms=-1).count() == 0
    assert gazetteer.find(docs.where("false"), terms, "id").count() == gazetteer.find(docs.where("false"), terms, "id", max_terms=0).count() == 0
