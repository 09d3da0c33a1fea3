"""Documents of open form: keys that are there or not, wrong types, texts that are no object; cases with their defaults."""

import json

from sievewell.sources import openpacks


def test_packs_are_opened_row_by_row(spark):
    texts = [
        '{"skill_id":"a","taxonomy":null,"overrides":[{"category":3}],"signed_by":[]}', "[1]", '{"skill_id":', None, "", '{"skill_id":null}', '{"overrides":"x"}', '{"skill_id":"b","overrides":"x","privacy_rules":[]}',
        '{"skill_id":"c","other":{"deep":[1]},"lexicons":[{"lexicon_id":"l"},{"lexicon_id":"m","provenance":"court"}]}', "null", '{"skill_id":"d","skill_id":"e"}',
    ]
    got = openpacks.pack_rows(spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "i int, text string, problem string"))
    rows = {r["i"]: r for r in got.drop("doc").collect()}
    want = [None, "not_an_object", "not_json", "not_json", "not_json", "missing_skill_id", "missing_skill_id", "type_overrides", None, "not_an_object", "not_json"]
    assert [rows[i]["problem"] for i in range(len(texts))] == want
    assert rows[0]["has_taxonomy"] and not rows[0]["has_privacy"] and rows[0]["signers"] == [] and rows[0]["overrides"][0].asDict() == {"category": 3, "floor": None}
    assert rows[7]["has_privacy"] and rows[7]["skill_id"] == "b" and rows[8]["provenance"] == [None, "court"]
    good, bad = openpacks.parted(got)
    assert good.count() == 2 and bad.count() == 9
    assert openpacks.pack_rows(spark.createDataFrame([], "text string")).count() == 0


def test_cases_have_defaults_where_nothing_is_stated(spark):
    cases = [
        {"case_id": "a"}, {"case_id": "b", "language": "ee", "message": {"text": "hi"}, "context": {"locale": None, "is_offline": True}}, {"language": "ff"},
        {"case_id": "c", "language": "gg", "message": {"language_hint": "hh", "quoted_from_user": "perhaps"}}, {"case_id": "d", "expected": {"category": 3, "reason_codes_must_include": ["X"]}, "extra": 1},
    ]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases] + [("[]",)], "given string")
    a, b, none, c, d, odd = openpacks.case_rows(df, "given").collect()
    assert (a["text"], a["language"], a["language_hint"], a["quoted"], a["group_kind"], a["locale"], a["max_output_tokens"], a["problem"]) == ("", "und", "und", False, "small_group", "en-US", 600, None)
    assert (b["text"], b["language_hint"], b["locale"], b["is_offline"]) == ("hi", "ee", None, True)
    assert none["problem"] == "missing_case_id" and c["problem"] == "type_quoted" and c["language_hint"] == "hh" and odd["problem"] == "not_an_object"
    assert d["problem"] is None and d["expected_category"] == 3 and d["must_include"] == ["X"] and d["must_exclude"] is None
