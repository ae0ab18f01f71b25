from __future__ import annotations

from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import location as L
from ledgerloom.functions.text import SPACE
from ledgerloom.operators.location import with_location

MAPS = "https://www.google.com/maps/search/"

# (raw data, extracted location)
EXTRACTED = [
    # structured blocks
    ("x//tesLokalizacja : Adres : UL. PIOTRKOWSKA 146 Miasto : LODZ Kraj : POLSKA", "UL. PIOTRKOWSKA 146, łódź"),
    ("Lokalizacja : Adres : UL. Świętokrzyska 30 Miasto : Warszawa", "UL. Świętokrzyska 30, Warszawa"),
    ("lokalizacja: adres: ul. testowa 12 miasto: poznan kraj: polska", "ul. testowa 12, poznań"),
    ("lokalizacja: adres: ul. kosciuszki 5 miasto: krakow", "ul. kościuszki 5, kraków"),
    ("lokalizacja: adres: ul. Testowa 12 kraj: Polska", "ul. Testowa 12"),
    ("lokalizacja: adres: miasto: Torun kraj: Polska", "toruń"),
    # "adres" without a colon: the text before the country, cut at its last colon
    ("lokalizacja: adres ul. Testowa 12 miasto: Krakow kraj: Polska", "adres ul. Testowa 12 miasto, kraków"),
    ("lokalizacja: adres ul. Testowa 12", "adres ul. Testowa 12"),
    # an empty city after the colon keeps the whole text
    ("lokalizacja: adres ul. Testowa 1:", "adres ul. Testowa 1"),
    # the country alone leaves nothing, and cleaning the whole part neither
    ("lokalizacja: kraj: Polska adres", ""),
    ("78979 - Lokalizacja : Adres : ul. Książęca 4 : Warszawa Kraj : POLSKA", "ul. Książęca 4, Warszawa"),
    # a structured part wins over an earlier dash part
    ("a - ul. Inna 3//lokalizacja: adres: ul. X 1 miasto: Radom", "ul. X 1, Radom"),
    # dash parts: the text after the last one
    ("shop - ul. slowackiego 4, warszawa", "ul. słowackiego 4, warszawa"),
    ("a - b - paseo de gracia 12, barcelona", "paseo de gracia 12, barcelona"),
    ("a - - b", "- b"),
    ("Transaction desc - store", "Transaction desc - store"),
    ("shop - market//other - Polna 7", "Polna 7"),
    # address-like parts
    ("zakup//Oak Park 42", "Oak Park 42"),
    ("foo//Ref9000000", "Ref9000000"),
    ("abc//ulica Długa", "ulica Długa"),
    ("market//x1//long enough 1", "long enough 1"),
    # anything longer than three characters
    ("abc//some text", "some text"),
    ("abc//nan//xy", ""),
    ("zakup w terminalu", ""),
    ("grocery store", ""),
    ("shop//store//market", ""),
    # blanks
    ("   ", ""),
    ("", ""),
    (None, ""),
    ("// / //", ""),
    ("  sw.jana 4//", "św.jana 4"),
    ("jelenia gora//Zielona Gora 12 adres: x", "zielona góra 12 x"),
]

# (location, text of the link)
LINKED = [
    ("ul. Kościuszki 10, Łódź", "ul. Kościuszki 10, Łódź"),
    ("Calle Mayor 5, Madrid", "Calle Mayor 5, Madrid"),
    ("lokalizacja: ul. Testowa 12, Warszawa", "ul. Testowa 12, Warszawa"),
    ("Lokalizacja :  adres : ul. Testowa 12", "adres, ul. Testowa 12"),
    ("MIASTO: adres: Lokalizacja: plac Wolności", "plac Wolności"),
    ("ul. Długa 3 : Gdańsk kraj : Polska", "ul. Długa 3, Gdańsk"),
    ("polna, łódź", "polna, łódź"),
    ("polna 7", None),
    ("a, b", None),
    ("a, b 7", "a, b 7"),
    ("Random text without address", None),
    ("ul.,, ,x", "ul., ,x"),
    ("   ", None),
    ("", None),
    (None, None),
]


def test_extraction(spark):
    rows = spark.createDataFrame([(number, raw) for number, (raw, _) in enumerate(EXTRACTED)], "n int, data string")
    found = with_location(rows).orderBy("n").collect()
    assert [(row.data, row.extracted_location) for row in found] == EXTRACTED


def test_links(spark):
    rows = spark.createDataFrame([(number, place) for number, (place, _) in enumerate(LINKED)], "n int, p string")
    found = rows.select("n", L.map_link(F.col("p")).alias("link")).orderBy("n").collect()
    assert [row.link for row in found] == ["" if text is None else MAPS + quote(text) for _, text in LINKED]


def test_link_follows_from_extraction(spark):
    rows = spark.createDataFrame([("x - ul. Polna 4, Lodz",), ("nothing here",)], "data string")
    links = {row.data: row.google_maps_link for row in with_location(rows).collect()}
    assert links == {"x - ul. Polna 4, Lodz": MAPS + quote("ul. Polna 4, łódź"), "nothing here": ""}


def test_diacritics(spark):
    cases = {plain: proper for plain, proper in L.DIACRITICS.items() if plain[-1].isalnum()}
    cases |= {
        "LODZ": "łódź",
        "lodzki": "lodzki",
        "xlodz": "xlodz",
        "łlodz": "łlodz",
        "lodz_": "lodz_",
        "sw. jana": "sw. jana",
        "sw.jana": "św.jana",
        "sw jana": "św. jana",
        "sw lodz": "św. łódź",
        "Nowy Sacz, krakow": "nowy sącz, kraków",
        "łódź": "łódź",
        "": "",
    }
    rows = spark.createDataFrame([(number, text) for number, text in enumerate(cases)], "n int, t string")
    found = rows.select("n", L.restore_diacritics(F.col("t")).alias("r")).orderBy("n").collect()
    assert [row.r for row in found] == list(cases.values())


def test_tidy_location(spark):
    cases = {
        "adres : ul. X miasto : Y kraj : Z, rest": "ul. X Y, rest",
        "a  :  b": "a, b",
        "a, ,b": "a,b",
        "  , a , ": "a",
        "ADRES: x": "ADRES, x",
    }
    rows = spark.createDataFrame([(number, text) for number, text in enumerate(cases)], "n int, t string")
    found = rows.select("n", L.tidy_location(F.col("t")).alias("r")).orderBy("n").collect()
    assert [row.r for row in found] == list(cases.values())


def test_space_class_is_python_whitespace(spark):
    points = [chr(code) for code in range(0x3100) if not 0xD800 <= code < 0xE000]
    rows = spark.createDataFrame([(point,) for point in points if point != "\0"], "c string")
    spaces = {row.c for row in rows.where(F.col("c").rlike(f"^{SPACE}\\z")).collect()}
    assert spaces == {point for point in points if point.isspace()}


@pytest.mark.parametrize("text", ["(" * 20_000, "a " * 20_000, "ul: " * 20_000, "x" * 1_000_000, "1" * 50_000, " " * 50_000 + "x" + " " * 50_000 + "1"])
def test_hostile_texts_stay_cheap(spark, text):
    rows = spark.createDataFrame([(text,)], "data string")
    assert with_location(rows).select(F.length("extracted_location")).first() is not None
