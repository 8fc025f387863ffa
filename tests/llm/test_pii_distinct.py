"""Distinctness, check digits, country codes, spellings and false hits of surrogates."""

import re

from scenewright.llm import pii


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.replace_entities(df, count="n").orderBy("doc_id").collect()]


def mod97(account):
    account = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_secrets_are_case_sensitive(spark):
    a, b, c = replaced(spark, ["key='AbCdEfGhIjKlMnOp1234'", "key='abcdefghijklmnop1234'", "key='AbCdEfGhIjKlMnOp1234' again"])
    assert a.lower() != b.lower() and c.startswith(a)
    old, new = "AbCdEfGhIjKlMnOp1234", a[5:-1]
    assert new != old and all((x.isupper(), x.islower(), x.isdigit()) == (y.isupper(), y.islower(), y.isdigit()) for x, y in zip(old, new))
    (hexa,) = replaced(spark, ["0123456789ABCDEF0123456789ABCDEF"])
    assert re.fullmatch("[0-9A-F]{32}", hexa) and hexa != "0123456789ABCDEF0123456789ABCDEF"


def test_country_codes_stay(spark):
    for text, code in (("+49 30 123 4567", "+49 "), ("+44 20 7946 0958", "+44 "), ("+1 555 123 4567", "+1 "), ("+351 21 123 4567", "+351 ")):
        (out,) = replaced(spark, [text])
        assert out.startswith(code) and out != text and re.sub("[0-9]", "0", out) == re.sub("[0-9]", "0", text)


def test_accounts_stay_valid(spark):
    solid, spaced, broken = replaced(spark, ["DE89370400440532013000", "pay DE89 3704 0044 0532 0130 00 now", "DE00370400440532013000"])
    assert mod97(solid) == 1 and solid != "DE89370400440532013000" and solid.startswith("DE")
    assert spaced.split("pay ")[1].split(" now")[0].replace(" ", "") == solid
    assert broken != "DE00370400440532013000"
    (british,) = replaced(spark, ["GB82WEST12345698765432"])
    assert mod97(british) == 1 and re.fullmatch("GB[0-9]{2}[A-Z]{4}[0-9]{14}", british)


def test_spellings_of_an_address_are_one(spark):
    short, long_, other = replaced(spark, ["at 2001:db8::1 ok", "at 2001:0db8:0000:0000:0000:0000:0000:0001 ok", "at 2001:db8::2 ok"])
    assert short == long_ != other
    assert re.fullmatch("at (?:[0-9a-f]{4}:){7}[0-9a-f]{4} ok", short)


def test_false_hits(spark):
    may, order, smith, baker = replaced(spark, [
        "Mr May said that in May", "order 123 456 7890 units", "Mr Smith left. Smith came back.", "Mr Baker is a baker. Baker left"])
    assert may.endswith("said that in May") and not may.startswith("Mr May")
    assert order == "order 123 456 7890 units"
    assert "Smith" not in smith
    assert baker.endswith("is a baker. Baker left")
    assert "May" not in replaced(spark, ["Mrs Anna May came. May left"])[0]
