"""Checksums and recognizers on values whose validity is known."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import checksums as C
from veilframe.functions import recognizers as R
from veilframe.operators import explicit

CASES = [
    (C.luhn, ["4111 1111 1111 1111", "5500-0000-0000-0004"], ["4111111111111112", "x"]),
    (C.iban, ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], ["GB82WEST12345698765433", "DE88370400440532013000", "DE8"]),
    (C.uk_nhs, ["943 476 5919", "9434765919"], ["9434765918", "943476591"]),
    (C.au_abn, ["51 824 753 556"], ["51 824 753 557"]),
    (C.au_acn, ["004 085 616"], ["004 085 617"]),
    (C.au_tfn, ["876 543 210"], ["876 543 211"]),
    (C.au_medicare, ["2123 45670 1"], ["2123 45671 1"]),
    (C.us_dea, ["AB1234563"], ["AB1234564"]),
    (C.sg_nric, ["S1234567D", "F1234567N", "T1234567J", "G1234567X"], ["S1234567E", "A1234567D"]),
    (C.in_aadhaar, ["2341 2341 2346"], ["2341 2341 2347", "2341 2341 2436"]),
    (C.base58check, ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy"], ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "1A1zP1eP5QGefi2DMPTfTL5SLmv7Divf0a"]),
    (C.bech32, ["bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"], ["bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", "bc1b"]),
    (C.iso_date, ["2024-02-29"], ["2023-02-29", "2023-13-01"]),
    (C.us_date, ["2/28/2023", "12/1/99"], ["2/30/2023", "13/1/2020"]),
]


@pytest.mark.parametrize("check,good,bad", CASES)
def test_checksums(spark, check, good, bad):
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in [*bad, "", None]], "v string, want boolean")
    wrong = df.select("v", "want", check(F.col("v")).alias("got")).where("NOT (got <=> want)").collect()
    assert not wrong


def found(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    rows = explicit.entities(df).orderBy("id").collect()
    for r in rows:
        assert all(r["text"][e["start"] : e["end"]] == e["text"] for e in r["entities"])
    return [[(e["entity_type"], e["text"]) for e in r["entities"]] for r in rows]


def test_texts_of_many_types(spark):
    text = "IBAN DE89370400440532013000, card 4111 1111 1111 1111, on 2020-01-02 from 999.999.999.999; call 555-223-4567; id 1234-56-78901"
    got, none, empty, plain = found(spark, text, None, "", "Nothing to see, 12 and 3.5 😀.")
    assert ("IBAN_CODE", "DE89370400440532013000") in got and ("CREDIT_CARD", "4111 1111 1111 1111") in got
    assert ("DATE_TIME", "2020-01-02") in got and ("PHONE_NUMBER", "555-223-4567") in got
    assert not {"IP_ADDRESS", "US_SSN"} & {k for k, _ in got} and none == empty == plain == []


def test_context_words_raise_weak_types(spark):
    got = found(spark, "passport no. C12345678", "number C12345678", "my bank account is 1234567890123", "the total is 1234567890123", "passport " + "x " * 40 + "C12345678")
    kinds = [{k for k, _ in g} for g in got]
    assert kinds[0] == {"US_PASSPORT"} and kinds[1] == set() and kinds[2] == {"US_BANK_NUMBER"} and kinds[3] == set() and kinds[4] == set()


def test_one_span_for_each_type_and_place(spark):
    got = found(spark, "call +1 (722) 555-1012 now", "a@b.co and 10.0.0.1.5 and 10.0.0.1")
    assert [k for k, _ in got[0]].count("PHONE_NUMBER") == 1
    assert [(k, v) for k, v in got[1] if k == "IP_ADDRESS"] == [("IP_ADDRESS", "10.0.0.1")]


def test_offsets_behind_many_matches(spark):
    text = "😀é " + " ".join(f"u{k}@x.org" for k in range(300))
    assert len(found(spark, text)[0]) == 300


def test_every_structured_type_has_a_recognizer():
    from veilframe.functions.constants import ENTITY_WEIGHTS

    told = {"PERSON", "LOCATION", "NRP", "ORGANIZATION"}  # by dictionaries or a model
    assert {r.kind for r in R.STRUCTURED} == set(ENTITY_WEIGHTS) - told
