"""Bank CSV exports: charset choice per file, over-long rows set aside."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.normalise import IMPORT_ID, INGEST_ORDER
from ledgerloom.session import configure

# Texts read as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Bytes without a character in the single-byte charsets.
UNDEFINED_BYTES = {"windows-1250": "81|83|88|90|98", "windows-1252": "81|8D|8F|90|9D"}

# Tried in this order after the caller's choice. ISO-8859-2 defines every
# byte, so nothing after it can ever be picked.
FALLBACK_CHARSETS = ("UTF-8", "windows-1250", "ISO-8859-2")

CHARSET_NAMES = {
    "utf-8": "UTF-8",
    "utf8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "cp1250": "windows-1250",
    "windows-1250": "windows-1250",
    "iso-8859-2": "ISO-8859-2",
    "latin2": "ISO-8859-2",
    "cp1252": "windows-1252",
    "windows-1252": "windows-1252",
    # Western Latin decodes anything and garbles Polish text: never preferred.
    "iso-8859-1": None,
    "latin1": None,
    "latin-1": None,
}

_RAW = "_raw"


@dataclass(frozen=True)
class BankCsv:
    """Rows of bank files and the records that had too many fields."""

    rows: DataFrame
    skipped: DataFrame


def charset_order(encoding: str | None) -> list[str]:
    """Charsets to try, the caller's first."""
    if not encoding:
        return list(FALLBACK_CHARSETS)
    name = encoding.lower().replace("_", "-")
    if name not in CHARSET_NAMES:
        raise ValueError(f"unsupported encoding {encoding!r}; known: {sorted(CHARSET_NAMES)}")
    wanted = CHARSET_NAMES[name]
    return [wanted] * bool(wanted) + [charset for charset in FALLBACK_CHARSETS if charset != wanted]


def _decodes(line: Column, charset: str) -> Column:
    """Whether the raw bytes of a line are valid in the charset."""
    if charset == "UTF-8":
        return F.is_valid_utf8(line)
    if charset in UNDEFINED_BYTES:
        # ASCII lines, as long in bytes as in valid characters, need no search.
        ascii_only = F.is_valid_utf8(line) & (F.length(line) == F.octet_length(line))
        undefined = rf"^(?:[0-9A-F]{{2}})*?(?:{UNDEFINED_BYTES[charset]})"
        return ascii_only | ~F.hex(line.cast("binary")).rlike(undefined)
    return F.lit(True)


# A quote closes a field only in front of a separator or the line's end; quotes
# inside an unquoted field are ordinary characters.
_CLOSING = r'"(?=,|\z)'


def _without_escapes(line: Column) -> Column:
    """The line without doubled quotes, which neither open nor close anything."""
    return F.replace(line, F.lit('""'), F.lit(""))


def _left_open(bare: Column) -> Column:
    """Whether a line that starts outside quotes ends inside a quoted field."""
    return F.regexp_replace(bare, rf'(?s)(^|,)".*?{_CLOSING}', "$1").rlike('(?:^|,)"')


def opens_quotes(line: Column) -> Column:
    """Whether a line ends inside quotes when it starts outside."""
    return line.contains('"') & _left_open(_without_escapes(line))


def keeps_quotes(line: Column) -> Column:
    """Whether a line ends inside quotes when it starts inside."""
    bare = _without_escapes(line)
    closing = rf"(?s)^.*?{_CLOSING}"
    return ~bare.rlike(closing) | _left_open(F.regexp_replace(bare, closing, ""))


def _as_path(uri: Column) -> Column:
    """Path of a file URI, with glob characters escaped so that it names one file."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"([\[\]{}*?\\])", r"\\$1")


# Bits of a header's hash that share a number with the position of its line.
_HASH_BITS = 30


def _raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``value`` and, for lines that may be a file's header, their ``place`` in the task."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    starts = (F.col("_metadata.file_block_start") == 0) & (F.trim("value") != "")
    return spark.read.text(path).select(
        _as_path(F.col("_metadata.file_path")).alias("file"), "value", F.when(starts, row).alias("place")
    )


def _header_parts() -> list[Column]:
    """Aggregates that hold the hash of a file's first line, in two halves.

    The position stands in front of the hash in one number, so the least number
    is that of the first line. Unlike a first text, numbers are aggregated in
    place, without sorting the lines.
    """
    line = F.xxhash64(F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 1 << 30)).otherwise(F.col("value")))
    mask = F.lit((1 << _HASH_BITS) - 1)
    halves = [line.bitwiseAND(mask), F.shiftrightunsigned(line, _HASH_BITS).bitwiseAND(mask)]
    placed = [F.shiftleft("place", _HASH_BITS).bitwiseOR(half) for half in halves]
    return [F.min(value).alias(f"_header{number}") for number, value in enumerate(placed)]


def _header_hash() -> Column:
    mask = F.lit((1 << _HASH_BITS) - 1)
    high, low = (F.col(f"_header{number}").bitwiseAND(mask) for number in (1, 0))
    return F.shiftleft(high, _HASH_BITS).bitwiseOR(low).alias("header")


def probe_files(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """Per file: ``file``, the first ``charset`` that decodes all of it, ``multiline``, ``header``.

    Reads raw lines, so large files are probed in splits; flags are combined
    per file before the shuffle. A line that leaves a quoted field open shows
    that records run over line ends. ``header`` is a hash of the first line
    that is not blank, without a byte order mark; files without any have none.
    """
    line = F.col("value")
    order = charset_order(encoding)
    flags = [F.bool_and(_decodes(line, charset)).alias(charset) for charset in order]
    probed = (
        _raw_lines(spark, path)
        .groupBy("file")
        .agg(*flags, F.bool_or(opens_quotes(line)).alias("multiline"), *_header_parts())
    )
    picked = F.coalesce(*[F.when(F.col(charset), F.lit(charset)) for charset in order])
    return probed.select("file", picked.alias("charset"), "multiline", _header_hash())


def header_census(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per file: ``file`` and the hash of its ``header`` line."""
    return _raw_lines(spark, path).groupBy("file").agg(*_header_parts()).select("file", _header_hash())


def files_by(census: DataFrame, *keys: str) -> dict[tuple, list[str]]:
    """Sorted names of the files of each group.

    Names come to the driver one by one, which Spark's readers need them on;
    a single row with all names of a group could grow past any row's limit.
    """
    groups: dict[tuple, list[str]] = {}
    for row in census.select(*keys, "file").toLocalIterator():
        groups.setdefault(tuple(row[key] for key in keys), []).append(row["file"])
    return {key: sorted(groups[key]) for key in sorted(groups, key=repr)}


def _has_extra_fields(record: Column, columns: int) -> Column:
    """Whether a record text has more fields than columns."""
    unquoted = F.regexp_replace(_without_escapes(record), rf'(?s)(^|,)".*?{_CLOSING}', "$1")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) >= columns


def _csv_options(charset: str) -> dict[str, str]:
    return {"header": "true", "encoding": charset, "quote": '"', "escape": '"'}


def _header(spark: SparkSession, file: str, charset: str, multiline: bool) -> list[str]:
    return spark.read.options(**_csv_options(charset)).option("multiLine", multiline).csv(file).columns


def _with_raw(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in [*names, _RAW]])


def _read_lines(spark: SparkSession, files: list[str], charset: str, names: list[str]) -> DataFrame:
    """Files with one record per line, with the raw text of records of unusual length."""
    return (
        spark.read.options(**_csv_options(charset))
        .option("mode", "PERMISSIVE")
        # Whether a record has an unusual length must not depend on the columns
        # a query happens to use.
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _RAW)
        .schema(_with_raw(names))
        .csv(files)
        .select(
            "*",
            F.col("_metadata.file_path").alias(IMPORT_ID),
            F.monotonically_increasing_id().alias(INGEST_ORDER),
        )
    )


def wrapped_records(spark: SparkSession, files: list[str], charset: str) -> DataFrame:
    """Records of files whose quoted fields run over line ends, without the header.

    Spark's own reader takes such a file as a whole in one task. Here lines are
    read in splits, and a line opens a record if it starts outside quotes. Each
    line either keeps that state, swaps it, or sets it whatever it was; so the
    state before a line is the last one set plus the number of swaps since.
    Splits are summed up the same way, one row each, to learn the state they
    start in and the record that is open. Only lines of records that do span
    lines are grouped.
    """
    text = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    opened, kept = opens_quotes(F.col("value")).cast("int"), keeps_quotes(F.col("value")).cast("int")
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias(IMPORT_ID),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        text.alias("text"),
        opened.alias("opened"),
        kept.alias("kept"),
    )
    lines = lines.withColumns(
        {
            "swap": ((F.col("opened") == 1) & (F.col("kept") == 0)).cast("int"),
            "set": F.when(F.col("opened") == F.col("kept"), F.col("opened")),
        }
    )
    split = Window.partitionBy(IMPORT_ID, "split")
    before = split.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    so_far = split.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when((F.col("split") == 0) & (F.col("text") != ""), F.col("line"))).over(split)
    swaps = F.coalesce(F.sum("swap").over(before), F.lit(0))
    counted = (
        lines.withColumns({"first": first, "swaps": swaps})
        .withColumn("set", (F.col("set") + F.col("swaps")) % 2)
        .withColumn("known", F.last("set", True).over(before))
    )

    def state(entered: Column) -> Column:
        return (F.coalesce(F.col("known"), entered) + F.col("swaps")) % 2

    # The last line that opens a record, for either state at the split's start.
    splits = counted.groupBy(IMPORT_ID, "split").agg(
        F.sum("swap").alias("swap"),
        F.max_by("set", F.when(F.col("set").isNotNull(), F.col("line"))).alias("set"),
        *[F.max(F.when(state(F.lit(entered)) == 0, F.col("line"))).alias(f"last{entered}") for entered in (0, 1)],
    )
    earlier = Window.partitionBy(IMPORT_ID).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    free_swaps = F.when(F.col("set").isNull(), F.col("swap")).otherwise(F.lit(0))
    entered = (
        splits.withColumn("swaps", F.coalesce(F.sum(free_swaps).over(earlier), F.lit(0)))
        .withColumn("known", F.last((F.col("set") + F.col("swap") + F.col("swaps")) % 2, True).over(earlier))
        .withColumn("entered", state(F.lit(0)))
        .withColumn("last", F.when(F.col("entered") == 0, F.col("last0")).otherwise(F.col("last1")))
    )
    carried = entered.select(IMPORT_ID, "split", "entered", F.last("last", True).over(earlier).alias("open_record"))
    placed = (
        counted.join(carried, [IMPORT_ID, "split"])
        .withColumn("opens", state(F.col("entered")) == 0)
        .withColumn("record", F.last(F.when(F.col("opens"), F.col("line")), True).over(so_far))
        .withColumn("record", F.coalesce("record", "open_record"))
    )
    whole = F.col("opens") & (F.col("opened") == 0)
    alone = placed.where(whole & ~F.col("record").eqNullSafe(F.col("first"))).select(IMPORT_ID, "record", "text")
    pieces = F.sort_array(F.collect_list(F.struct("split", "line", "text")))
    spanning = (
        placed.where(~whole)
        .groupBy(IMPORT_ID, "record")
        .agg(
            F.array_join(F.transform(pieces, lambda piece: piece["text"]), "\n").alias("text"),
            F.min("first").alias("first"),
        )
        .where(~F.col("record").eqNullSafe(F.col("first")))
        .select(IMPORT_ID, "record", "text")
    )
    return alone.unionAll(spanning).where(F.col("text") != "")


def _read_wrapped(spark: SparkSession, files: list[str], charset: str, names: list[str]) -> DataFrame:
    """The same as ``_read_lines`` for files with records that span lines."""
    options = _csv_options(charset) | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}
    schema = ", ".join(f"`{name}` string" for name in _with_raw(names).names)
    parsed = wrapped_records(spark, files, charset).withColumn("fields", F.from_csv("text", schema, options))
    return parsed.select("fields.*", IMPORT_ID, F.col("record").alias(INGEST_ORDER))


def read_bank_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> BankCsv:
    """Read bank CSV files with a header line, all columns as text.

    Every file is decoded with the first charset that fits all its bytes:
    ``encoding`` if given, then UTF-8, windows-1250 and ISO-8859-2. Short rows
    are padded with nulls; rows with too many fields go to ``skipped``. Rows
    carry the file they came from (``_import_id``) and their position
    (``_ingest_order``).

    Headers are counted per file: columns are matched by position, so names may
    differ between files, but files that differ in their number of columns are
    refused. (A header that itself spans lines is told apart by its first line.)

    Only names of files pass through the driver, one per input file; files are
    read in splits, also where quoted fields span lines.
    """
    configure(spark)
    kinds = files_by(probe_files(spark, path, encoding), "charset", "multiline", "header")
    if not kinds:
        raise ValueError(f"no lines in {path}")
    names = {kind: _header(spark, files[0], *kind[:2]) for kind, files in kinds.items() if kind[2] is not None}
    widths = {len(columns): kinds[kind][0] for kind, columns in names.items()}
    if len(widths) > 1:
        found = ", ".join(f"{width} in {file}" for width, file in sorted(widths.items()))
        raise ValueError(f"files differ in their number of columns: {found}")
    if not names:
        raise ValueError(f"no header in {path}")
    groups: dict[tuple, list[str]] = {}
    for kind in names:
        groups.setdefault(kind[:2], []).extend(kinds[kind])
    width = next(iter(names.values()))
    rows, skipped = [], []
    for (charset, multiline), files in groups.items():
        read = _read_wrapped if multiline else _read_lines
        frame = read(spark, sorted(files), charset, width).toDF(*width, _RAW, IMPORT_ID, INGEST_ORDER)
        # The length is always true: Spark refuses queries that need nothing but
        # the raw record, and a count would.
        any_field = F.length(F.coalesce(F.col(f"`{width[0]}`"), F.lit(""))) >= 0
        too_long = F.coalesce(_has_extra_fields(F.col(_RAW), len(width)), F.lit(False)) & any_field
        known = [
            F.when(F.col(f"`{name}`").isin(*MISSING_TOKENS), None).otherwise(F.col(f"`{name}`")).alias(name)
            for name in width
        ]
        rows.append(frame.where(~too_long).select(*known, IMPORT_ID, INGEST_ORDER))
        skipped.append(frame.where(too_long).select(F.col(_RAW).alias("record"), IMPORT_ID, INGEST_ORDER))
    return BankCsv(reduce(DataFrame.unionAll, rows), reduce(DataFrame.unionAll, skipped))
