"""Text, number and date expressions shared by the operators.

Regexes spell out the character classes because Java's shorthands are ASCII:
whitespace is every Unicode space plus U+001C-U+001F, word characters are
letters, numbers and underscore. The helpers every row passes use ``(?U)``,
which makes ``\\s`` a faster spelling of the same spaces; combined with
``(?i)`` it would also change case folding. Patterns are written so that long
runs of one character are scanned once, not from every position again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"

# The same spaces as characters.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(text, F.lit(SPACES))


def strip_left(text: Column) -> Column:
    """Remove Unicode whitespace from the start."""
    return F.ltrim(text, F.lit(SPACES))


def collapse_spaces(text: Column) -> Column:
    """Turn every run of whitespace into one space."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")


def nfkc(text: Column) -> Column:
    """Unicode normal form KC, by the ICU library Spark itself uses for collations.

    ASCII texts, as long in bytes as in characters, are in that form already.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.length(text) < F.octet_length(text), composed).otherwise(text)


def normalise_description(text: Column) -> Column:
    """Form used in the row id: NFKC, lower case, single spaces, no outer space."""
    folded = F.lower(nfkc(F.coalesce(text.cast("string"), F.lit(""))))
    return F.btrim(collapse_spaces(folded))


def is_missing(number: Column) -> Column:
    """True for null and NaN."""
    return number.isNull() | F.isnan(number)


def strict_double(text: Column, what: str = "amount") -> Column:
    """Parse a number or fail; null stays null.

    Accepts signs, exponents, digit-group underscores, ``inf`` and ``nan``
    surrounded by blanks. The failure names the field, never its content.
    """
    failure = F.raise_error(F.lit(f"{what} is not a number")).cast("double")
    return _number(text).when(text.isNull(), F.lit(None).cast("double")).otherwise(failure)


def _number(text: Column) -> Column:
    """Cases that parse a number; to be ended by what else there may be."""
    simple = text.rlike(r"^[+-]?[0-9]+(?:\.[0-9]*)?\z")
    tidy = F.regexp_replace(strip(text), r"(?<=[0-9])_(?=[0-9])|^[+-](?=[nN][aA][nN]\z)", "")
    number = r"(?i)^(?:nan|[+-]?(?:inf|infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?))\z"
    return F.when(simple, text.try_cast("double")).when(tidy.rlike(number), tidy.try_cast("double"))


def readable_double(text: Column) -> Column:
    """The number ``strict_double`` parses, and null where it would fail."""
    return _number(text).otherwise(F.lit(None).cast("double"))


def float_text(number: Column) -> Column:
    """Shortest decimal text of a double with at least one decimal place.

    Plain notation from 1e-4 up to 1e16, otherwise ``1e+16`` style exponents.
    """
    size = F.abs(number)
    plain = number.cast("string")
    digits = plain.cast("decimal(38,20)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(digits, r"0+\z", ""), r"\.\z", ".0")
    # 15 to 17 significant digits: the first form that reads back as the number.
    rounded = [F.format_string(f"%.{places}e", number) for places in (14, 15, 16)]
    exact = F.coalesce(*[F.when(form.cast("double") == number, form) for form in rounded])
    scientific = F.regexp_replace(exact, r"\.?0*e", "e")
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .when(size == float("inf"), F.when(number > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), plain)
        .when((size >= 1e-4) & (size < 1e16), trimmed)
        .otherwise(scientific)
    )


def amount_value(amount: Column, numeric: bool = False) -> Column:
    """Amount as a double; text may use ``,`` or ``.`` as decimal mark."""
    return amount.cast("double") if numeric else strict_double(F.replace(amount, F.lit(","), F.lit(".")))


def minor_units(value: Column) -> Column:
    """Signed amount in hundredths, rounded half away from zero in binary floats.

    Missing amounts fail, as do infinite ones and amounts beyond 64 bits.
    """
    hundredths = F.abs(value) * F.lit(100.0) + F.lit(0.5)
    return (
        F.when(is_missing(value), F.raise_error(F.lit("cannot compute txn_id: amount is missing")).cast("bigint"))
        .when(hundredths >= 2.0**63, F.raise_error(F.lit("cannot compute txn_id: amount is too large")).cast("bigint"))
        .otherwise(F.when(value < 0, F.lit(-1)).otherwise(F.lit(1)) * F.floor(hundredths))
    )


def quote_path(text: Column) -> Column:
    """Percent-encode for a URL path: letters, digits, ``_.-~`` and ``/`` stay."""
    encoded = F.url_encode(text)
    for code, character in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(code), F.lit(character))
    return encoded


def sheet_guard(text: Column) -> Column:
    """Prefix ``'`` when a spreadsheet would read the cell as a formula."""
    return F.when(text.rlike(r"(?U)^[\s\x1c-\x1f]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
