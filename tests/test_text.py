from __future__ import annotations

import math
import random
import unicodedata
from urllib.parse import quote

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

SPACES = "\t\n\r\x1c\x1f\x85\xa0 　 "


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(number, value) for number, value in enumerate(values)], f"n int, x {kind}")
    return [row.y for row in rows.select("n", expression(F.col("x")).alias("y")).orderBy("n").collect()]


def test_strip_and_collapse_follow_python(spark):
    values = [f"{SPACES}a{SPACES}b​{SPACES}", "", SPACES, "x", "a​"]
    assert column(spark, values, "string", X.strip) == [value.strip() for value in values]
    assert column(spark, values, "string", X.strip_left) == [value.lstrip() for value in values]
    assert column(spark, values, "string", lambda c: F.btrim(X.collapse_spaces(c))) == [
        " ".join(value.split()) for value in values
    ]


def test_nfkc_follows_python(spark):
    generator = random.Random(1)
    pool = [*range(65, 123), *range(0xC0, 0x180), *range(0x300, 0x370), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF60)]
    values = ["".join(chr(generator.choice(pool)) for _ in range(8)) for _ in range(2000)]
    values += ["plain", "", "ﬁ ① Ａ", "é", None]
    expected = [value if value is None else unicodedata.normalize("NFKC", value) for value in values]
    assert column(spark, values, "string", X.nfkc) == expected


def test_float_text_follows_python(spark):
    generator = random.Random(2)
    values = [0.0, 10000000.0, 0.0005, 1e16, 1e22, 1e-5, 123456789.01, 1e100, 9007199254740993.0, 2.0, 0.1, 5e-310]
    values += [round(generator.uniform(0, 10**power), 2) for power in range(1, 12) for _ in range(300)]
    values += [10 ** generator.uniform(-20, 15) for _ in range(3000)]
    values += [-value for value in values if value]
    values += [math.inf, -math.inf, math.nan]
    assert column(spark, values, "double", X.float_text) == [str(value) for value in values]


def test_strict_double_accepts_python_numbers(spark):
    values = ["5", "-5.25", " 5.0 ", "1_000.5", "1e3", ".5", "5.", "+7", "inf", "-Infinity", "\t3\n", "1E-2"]
    assert column(spark, values, "string", X.strict_double) == [float(value) for value in values]
    nans = column(spark, ["NaN", "nan", "-nan", None], "string", X.strict_double)
    assert all(math.isnan(value) for value in nans[:3])
    assert nans[3] is None


@pytest.mark.parametrize("value", ["abc", "", "1,50", "1.0d", "0x10", "1__0", "_1", "1 000", "not_a_number"])
def test_strict_double_rejects(spark, value):
    with pytest.raises(PySparkException, match="amount is not a number") as caught:
        column(spark, [value], "string", X.strict_double)
    assert not value or value not in str(caught.value).split("SQLSTATE")[0]


def test_minor_units_round_in_binary_floats(spark):
    texts = ["-50.00", "1,005", "-1.005", "0", "-0.004", "19.999", "12345678.905"]
    expected = []
    for value in texts:
        number = float(value.replace(",", "."))
        expected.append((-1 if number < 0 else 1) * int(abs(number) * 100 + 0.5))
    assert column(spark, texts, "string", lambda c: X.minor_units(X.amount_value(c))) == expected
    assert expected[2] == -100


@pytest.mark.parametrize("value", [None, "nan", "inf", "1e300"])
def test_minor_units_need_an_amount(spark, value):
    with pytest.raises(PySparkException, match="cannot compute txn_id"):
        column(spark, [value], "string", lambda c: X.minor_units(X.amount_value(c)))


def test_quote_path_follows_urllib(spark):
    values = ["ul. Kościuszki 10, Łódź", "a/b c", "~*+%&?=#", "x-y_z.", "日本", ""]
    assert column(spark, values, "string", X.quote_path) == [quote(value) for value in values]


def test_sheet_guard(spark):
    risky = ["=A1", "+1+1", "-1", "@SUM(A1:A2)", "\t=tabbed", "\r=cr-leading", " \xa0=x"]
    harmless = ["text", "123", "(x)", "", "\tplain", "‮=x", None, "a=b"]
    assert column(spark, risky, "string", X.sheet_guard) == ["'" + value for value in risky]
    assert column(spark, harmless, "string", X.sheet_guard) == harmless
