from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal

import pytest

from undula.functions import templates as T
from undula.functions.templates import F

NUMBERS = [0.0, 1.0, -1.0, 0.25, 0.35, -0.25, 2.5, 3.5, 1234567.0, 999999.5, 100000.0, 0.0001, 0.00001234, 44100.0, -0.04, 1e22, 33429.75, 33429.25, 123456.5, 99999.95, 1 / 3, -2 / 3, 7.0]


def plain(x, form):
    if form == "g":
        # Six digits of the shortest decimal form, where Python takes the exact binary value.
        return f"{float(Context(prec=6, rounding=ROUND_HALF_EVEN).create_decimal(repr(x))):g}"
    digits = int(form[-2])
    text = f"{abs(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN)):f}"
    return ("-" if x < 0 else "+" if form[0] == "+" else "") + text


@pytest.mark.parametrize("form", ["g", ".0f", ".1f", "+.1f", "+.3f"])
def test_numbers(spark, form):
    numbers = [x for x in NUMBERS if form == "g" or abs(x) < 1e15]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", T.compiled("{x:" + form + "}", {"x"}).alias("t"), T.compiled("<{x:" + form + "}>", {"x"}, lang="de").alias("d")).collect()
    assert {r.x: r.t for r in got} == {x: plain(x, form) for x in numbers}
    assert all(r.d == "<" + r.t.replace(".", ",") + ">" for r in got)


@pytest.mark.parametrize("template,text", [
    ("plain", "plain"), ("{{x}} {name}", "{x} a.b"), ("{other}", "{other}"), ("{x:>3}", "{x:>3}"), ("{x", "{x"), ("x} {name}", "x} {name}"), ("", ""), ("{n}", "5"), ("ä{name}'\\", "äa.b'\\"),
])
def test_templates(spark, template, text):
    df = spark.createDataFrame([(1.5, "a.b", 5)], "x double, name string, n int")
    assert df.select(T.compiled(template, set(df.columns), lang="de").alias("t")).first().t == text


def test_languages_and_missing_messages(spark):
    rows = spark.createDataFrame([("en", "a", 1.5), ("de", "a", 1.5), ("fr", "a", 1.5), ("en", "b", 1.5), ("de", "none", 1.5), (None, "a", None)], "lang string, key string, x double")
    catalogue = spark.createDataFrame([("en", "a", "on {x:.1f}"), ("de", "a", "an {x:.1f}"), ("fr", "b", "le {x}")], "lang string, key string, template string")
    got = {(r.lang, r.key): r.text for r in T.rendered(rows, catalogue).collect()}
    assert got == {("en", "a"): "on 1.5", ("de", "a"): "an 1,5", ("fr", "a"): "an 1,5", ("en", "b"): "b", ("de", "none"): "none", (None, "a"): None}
    with pytest.raises(ValueError):
        T.rendered(rows, catalogue, most=2)
    assert T.rendered(rows, catalogue.limit(0)).select(F.count_if(F.col("text") == F.col("key"))).first()[0] == 6
