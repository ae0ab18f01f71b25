"""Address extraction and map links as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.keywords import constant, contains_any
from ledgerloom.functions.text import SPACE, WORD, collapse_spaces, quote_path, strip

# Field names left over from bank metadata.
FIELD_PREFIXES = ("miasto :", "miasto:", "adres :", "adres:", "lokalizacja :", "lokalizacja:")

# Names typed without diacritics and their proper spelling.
DIACRITICS = {
    "lodz": "łódź",
    "krakow": "kraków",
    "poznan": "poznań",
    "wroclaw": "wrocław",
    "gdansk": "gdańsk",
    "czestochowa": "częstochowa",
    "torun": "toruń",
    "bialystok": "białystok",
    "rzeszow": "rzeszów",
    "piotrkow": "piotrków",
    "walbrzych": "wałbrzych",
    "wloclawek": "włocławek",
    "jelenia gora": "jelenia góra",
    "nowy sacz": "nowy sącz",
    "zielona gora": "zielona góra",
    "kosciuszki": "kościuszki",
    "pilsudskiego": "piłsudskiego",
    "slowackiego": "słowackiego",
    "zeromskiego": "żeromskiego",
    "swietokrzyska": "świętokrzyska",
    "stanislawa": "stanisława",
    "wladyslawa": "władysława",
    "jozefa": "józefa",
    "legionow": "legionów",
    "zwyciestwa": "zwycięstwa",
    "polnocna": "północna",
    "poludniowa": "południowa",
    "krolowej": "królowej",
    "powstancow": "powstańców",
    "sw.": "św.",
    "sw ": "św. ",
}

# Words that mark a street in Polish, English, Spanish or Italian.
STREET_TOKENS = (
    "ul.", "al.", "pl.", "os.", "centrum", "aleja", "ulica", "plac", "osiedle",
    "street", "st.", "avenue", "ave.", "road", "rd.", "boulevard", "blvd.", "lane", "ln.", "drive", "dr.",
    "calle", "avenida", "avda.", "paseo", "plaza",
    "via", "viale", "piazza", "corso", "strada",
)

# Cities that make a comma-separated text geocodable.
CITIES = (
    "warszawa", "kraków", "łódź", "wrocław", "poznań", "gdańsk", "szczecin", "bydgoszcz", "lublin", "katowice",
    "białystok", "gdynia", "częstochowa", "radom", "sosnowiec", "toruń", "kielce", "gliwice", "zabrze", "bytom",
    "olsztyn", "bielsko-biała", "rzeszów",
    "madrid", "barcelona", "valencia", "sevilla", "zaragoza", "málaga", "murcia", "palma", "bilbao", "alicante",
    "córdoba", "valladolid", "granada", "salamanca", "toledo",
    "roma", "milano", "napoli", "torino", "palermo", "genova", "bologna", "firenze", "bari", "catania", "venezia",
    "verona", "messina", "padova", "trieste", "brescia", "parma", "modena",
)

# Texts too generic to be a place.
GENERIC_TERMS = (
    "nan",
    "null",
    "zakup w terminalu",
    "pc game purchase",
    "grocery store",
    "groceries",
    "store",
    "shop",
    "market",
)

MAP_SEARCH_URL = "https://www.google.com/maps/search/"

# How fields are written in bank metadata. (?d): only \n ends a
# line, as $ and . see it here.
_FIELD = rf"{SPACE}*:{SPACE}*"
_ADDRESS_FIELDS = rf"(?iud)adres{_FIELD}(.*?){SPACE}*(?:miasto{_FIELD}(.*?))?(?:kraj{_FIELD}.*)?$"
_STREET_AND_NUMBER = rf"(?<!{WORD}){WORD}++{SPACE}++{WORD}++{SPACE}++\p{{Nd}}"


def split_parts(data: Column) -> Column:
    """Non-blank ``//`` segments, trimmed, in order."""
    segments = F.transform(F.split(data, "//"), strip)
    return F.filter(segments, lambda part: part != "")


def _trim_list(text: Column) -> Column:
    return F.btrim(text, F.lit(" ,"))


def _address_payload(payload: Column) -> Column:
    """Address and city of the text after ``lokalizacja:``, empty if there is none."""
    street = _trim_list(F.regexp_extract(payload, _ADDRESS_FIELDS, 1))
    town = _trim_list(F.regexp_extract(payload, _ADDRESS_FIELDS, 2))
    fields = F.array_join(F.filter(F.array(street, town), lambda field: field != ""), ", ")

    domestic = _trim_list(F.regexp_extract(payload, rf"(?iu)^([\s\S]*?)(?:kraj{_FIELD}[\s\S]*)?\z", 1))
    before = _trim_list(F.regexp_extract(domestic, r"^([\s\S]*):", 1))
    after = _trim_list(F.substring_index(domestic, ":", -1))
    split_at_colon = domestic.contains(":") & (before != "") & (after != "")
    loose = F.when(split_at_colon, F.concat(before, F.lit(", "), after)).otherwise(domestic)
    return F.when(payload.rlike(_ADDRESS_FIELDS), fields).otherwise(loose)


def _structured(part: Column) -> Column:
    """Address in a ``lokalizacja : adres : ...`` block, or null."""
    label = rf"(?iu)lokalizacja{_FIELD}"
    return F.when(
        F.lower(part).contains("lokalizacja") & F.lower(part).contains("adres") & part.rlike(label),
        _address_payload(F.regexp_extract(part, rf"{label}([\s\S]*)\z", 1)),
    )


def _is_generic(part: Column) -> Column:
    return F.lower(part).isin(*GENERIC_TERMS)


def _after_dash(part: Column) -> Column:
    """Text after the last `` - ``, unless structured, empty or generic."""
    tail = strip(F.element_at(F.split(part, " - "), -1))
    usable = part.contains(" - ") & ~F.lower(part).contains("lokalizacja") & (tail != "") & ~_is_generic(tail)
    return F.when(usable, tail)


def looks_like_address(part: Column) -> Column:
    """True for a street word, a ``name name 12`` run, or a longer text with a digit."""
    return ~_is_generic(part) & (
        contains_any(F.lower(part), STREET_TOKENS)
        | part.rlike(_STREET_AND_NUMBER)
        | ((F.length(part) > 8) & part.rlike(r"\p{Nd}"))
    )


def first_location(parts: Column) -> Column:
    """Most specific raw location among the segments, or null.

    Tries all segments for a structured block first, then for a dash, then for
    an address, then for any longer non-generic text.
    """

    def first(values: Column) -> Column:
        return F.try_element_at(values, F.lit(1))

    def first_hit(extract) -> Column:
        return first(F.filter(F.transform(parts, extract), lambda hit: hit != ""))

    return F.coalesce(
        first_hit(_structured),
        first_hit(_after_dash),
        first(F.filter(parts, looks_like_address)),
        first(F.filter(parts, lambda part: ~_is_generic(part) & (F.length(part) > 3))),
    )


def normalise_separators(text: Column) -> Column:
    """``:`` becomes ``, ``; spaces and repeated commas collapse; ends are trimmed."""
    text = F.regexp_replace(collapse_spaces(text), " ?: ?", ", ")
    return _trim_list(F.regexp_replace(text, ", ?,", ","))


def tidy_location(text: Column) -> Column:
    """Drop the country field and field names, then tidy the separators."""
    country = rf"(?iu)(?<!{SPACE}){SPACE}*+kraj{SPACE}*+:{SPACE}*+[^,]*+"
    domestic = F.when(F.lower(text).contains("kraj"), F.regexp_replace(text, country, "")).otherwise(text)
    text = F.coalesce(domestic, F.lit(""))
    for prefix in FIELD_PREFIXES:
        text = F.replace(text, F.lit(prefix), F.lit(" "))
    return normalise_separators(text)


def _name_pattern() -> str:
    """Any whole word of ``DIACRITICS``, the longest first."""
    names = sorted(DIACRITICS, key=lambda name: -len(name))
    edges = [rf"(?!{WORD})" if name[-1].isalnum() else rf"(?={WORD})" for name in names]
    return rf"(?iu)(?<!{WORD})(?:{'|'.join(re.escape(name) + edge for name, edge in zip(names, edges))})"


def restore_diacritics(text: Column) -> Column:
    """Respell whole words of ``DIACRITICS``, longest first, in lower case.

    One pattern finds all names; each is looked up and put back between the
    pieces around it.
    """
    pattern = _name_pattern()
    spelling = constant(DIACRITICS, "map<string,string>")
    # The same folding as the pattern's: capitals first, so that variants of a letter meet.
    plain = lambda name: F.lower(F.upper(F.translate(name, "\u0130", "i")))
    names = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda name: F.coalesce(F.try_element_at(spelling, plain(name)), name),
    )
    pieces = F.zip_with(F.split(text, pattern, -1), names, lambda piece, name: F.concat(piece, F.coalesce(name, F.lit(""))))
    respelled = F.array_join(pieces, "")
    return F.coalesce(F.when(contains_any(F.lower(text), list(DIACRITICS)), respelled).otherwise(text), F.lit(""))


def map_link(location: Column) -> Column:
    """Map search URL for an address-like text, else an empty string."""
    text = strip(F.coalesce(location, F.lit("")))
    lowered = F.lower(text)
    geocodable = contains_any(lowered, STREET_TOKENS) | (
        text.contains(",") & (text.rlike(r"\p{Nd}") | contains_any(lowered, CITIES))
    )
    prefixes = "".join(rf"(?:{re.escape(prefix)}{SPACE}*)?" for prefix in FIELD_PREFIXES).replace("k", r"[k\u212a]")
    tidy = collapse_spaces(F.regexp_replace(text, rf"(?i)^{prefixes}", ""))
    tidy = F.regexp_replace(tidy, rf"(?iu) ?: ?([^:]+?) kraj ?: ?{WORD}+\z", ", $1")
    tidy = normalise_separators(tidy)
    return F.when(geocodable & (tidy != ""), F.concat(F.lit(MAP_SEARCH_URL), quote_path(tidy))).otherwise(F.lit(""))
