"""Formats of personal data beyond those of the test tables, and names in their other forms."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from scenewright.llm import pii  # noqa: E402

FORMS = ["(555) 123-4567", "555-123-4567", "030 1234567", "01 23 45 67 89", "+33 1 23 45 67 89", "(030) 1234567",
         "020 7946 0958", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947",
         "3782 822463 10005", "2001:db8::ff00:42:8329", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1"]


def texts_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in pii.replace_entities(df, "k").collect()}


def test_each_form_is_replaced_whole(spark):
    out = texts_of(spark, [f"Reach {form}, or write." for form in FORMS])
    for i, form in enumerate(FORMS):
        got = re.fullmatch("Reach (.+), or write[.]", out[i])[1]
        assert got != form
        if "::" not in form:  # the same separators at the same places
            assert re.sub("[0-9A-Za-z]", "x", got) == re.sub("[0-9A-Za-z]", "x", form)
        else:
            assert re.fullmatch("[0-9a-f]{4}(:[0-9a-f]{4}){7}", got)


def test_printed_and_solid_accounts_are_one(spark):
    out = texts_of(spark, ["To DE89 3704 0044 0532 0130 00 EUR 5", "To DE89370400440532013000 now"])
    assert re.fullmatch(r"To (DE\S\S( \S{4}){4} \S\S) EUR 5", out[0])
    assert re.fullmatch(r"To (.+) EUR 5", out[0])[1].replace(" ", "") == out[1].split()[1] != "DE89370400440532013000"


def test_what_is_no_such_form_stays(spark):
    texts = ["On 01.02.2024 at 10:30:45 std::vector 100 200 items", "pages 12-15, 3.14159 and a::b 2024-01-31"]
    assert list(texts_of(spark, texts).values()) == texts


def test_names_without_title_and_family_names(spark):
    out = texts_of(spark, ["Mr John Smith met Mr Smith. John Smith left; Smith's hat, a Smithy and Smith stayed.",
                           "Mrs Mary Smith is here.", "A Smith works iron.", "Dr O'Neil-Berg and O'Neil-Berg"])
    first, family = re.match(r"Mr (\w+) (\w+) met", out[0]).groups()
    assert out[0] == f"Mr {first} {family} met Mr {family}. {first} {family} left; {family}'s hat, a Smithy and {family} stayed."
    assert family != "Smith" and re.fullmatch(rf"Mrs \w+ {family} is here\.", out[1])
    assert out[2] == "A Smith works iron." and re.fullmatch(r"Dr (\w+) and \1", out[3])


def test_many_given_names_of_one_family_stay_distinct(spark):
    given = ["A" + a + b for a in "bcdefg" for b in "aeiou"]
    out = texts_of(spark, [f"Mr {g} Smith" for g in given])
    assert len(set(out.values())) == len(given)
    assert len({t.split()[-1] for t in out.values()}) == 1
