"""Named queries over the benchmark tables, one per operator or export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.keywords import constant
from ledgerloom.functions.location import map_link, restore_diacritics, split_parts
from ledgerloom.functions.text import (
    amount_value,
    float_text,
    minor_units,
    quote_path,
    sheet_guard,
)
from ledgerloom.operators import classify, review
from ledgerloom.operators.ids import assign_txn_ids, with_occurrence
from ledgerloom.operators.location import with_location
from ledgerloom.operators.merge import merge_bucketed, merge_import
from ledgerloom.operators.metrics import import_quality as quality_report
from ledgerloom.operators.metrics import preview
from ledgerloom.operators.normalise import IMPORT_ID, INGEST_ORDER, RAW_COLUMNS, normalise
from ledgerloom.operators.tracks import (
    EXPENSE,
    INCOME,
    drop_refunds,
    expense_track,
    income_track,
    label_tracks,
    only_track,
)
from ledgerloom.plans.ledger_views import orders_ledger, raw_events, raw_lineitems, read_table
from ledgerloom.operators.rule_index import shadowed_keywords
from ledgerloom.rules import DEFAULT_EXPENSE, REFUND_LABEL, expense_rules
from ledgerloom.session import configure, scratch_folder
from ledgerloom.sinks.tables import write_cleaned, write_csv, write_ledger
from ledgerloom.sources.bank_csv import read_bank_csv
from ledgerloom.sources.processed import read_processed
from ledgerloom.streaming.drop_folder import import_frames
from ledgerloom.streaming.late_copies import without_late_copies
from ledgerloom.streaming.running_ids import collisions_of, stream_occurrence, stream_txn_ids

# Buckets of the small ledgers and streams of these queries, and the fewest state partitions of a stream.
LEDGER_BUCKETS = 16
STREAM_BUCKETS = 32
STREAM_PARTITIONS = 4

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def configured(spark: SparkSession, folder: str) -> DataFrame:
        return build(configure(spark), folder)

    QUERIES[build.__name__] = configured
    return configured


def _event_id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(INGEST_ORDER, "event_id")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return normalise(raw_events(spark, folder))


def _identified(spark: SparkSession, folder: str) -> DataFrame:
    return assign_txn_ids(_events(spark, folder))


def _text(name: str) -> Column:
    """A date as text, which both engines print alike."""
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query
def normalise_import(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_id(_events(spark, folder))
    return rows.withColumns({name: _text(name) for name in ("booking_date", "value_date")})


@query
def clean_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    return _event_id(classify.clean_descriptions(_events(spark, folder))).select("event_id", "data")


@query
def categorise_expense(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_id(_events(spark, folder))
    return rows.select("event_id", classify.expense_label(F.col("data")).alias("category"))


@query
def categorise_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return documents.select("doc_id", classify.expense_label(F.col("text")).alias("category"))


@query
def categorise_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = read_table(spark, folder, "part")
    return parts.select("p_partkey", classify.expense_label(F.col("p_name")).alias("category"))


@query
def categorise_income(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_id(_events(spark, folder))
    return rows.select("event_id", classify.income_label(F.col("data")).alias("category"))


@query
def classify_display(spark: SparkSession, folder: str) -> DataFrame:
    pair = classify.display_pair(F.col("text"))
    documents = read_table(spark, folder, "documents").withColumn("pair", pair)
    return documents.select("doc_id", "pair.category", "pair.importance")


@query
def label_or_text_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every other item is a label in lower case with blanks, the rest free text."""
    rules = expense_rules()
    labels = constant([*rules.labels, rules.default], "array<string>")
    number = F.col("event_id")
    label = F.lower(F.get(labels, (number % (len(rules.labels) + 1)).cast("int")))
    rows = _event_id(raw_events(spark, folder))
    item = F.when(number % 2 == 0, F.concat(F.lit("  "), label, F.lit(" "))).otherwise(
        F.coalesce("description", F.lit(""))
    )
    return classify.classify_records(rows.select("event_id", item.alias("item")))


@query
def rules_broadcast_join(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    rules = expense_rules().to_dataframe(spark)
    return classify.rules_join(documents, rules, "doc_id", "text", DEFAULT_EXPENSE)


@query
def refund_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Views carry no label at all and must stay."""
    rows = _event_id(_events(spark, folder))
    label = F.when(F.coalesce("txn_type", F.lit("")) != "nan", classify.expense_label(F.col("data")))
    return drop_refunds(rows.select("event_id", label.alias("category")))


@query
def amount_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts with blanks, underscores, missing and infinite values; junk on refunds only."""
    number = F.col(INGEST_ORDER)
    amount = (
        F.when(number % 11 == 1, F.lit(" 5.0 "))
        .when(number % 11 == 2, F.lit("NaN"))
        .when(number % 11 == 3, F.lit(None))
        .when(number % 11 == 4, F.lit("-inf"))
        .when(number % 11 == 5, F.lit("1_000"))
        .otherwise(F.col("amount"))
    )
    rows = _events(spark, folder).withColumns(
        {"event_id": number, "refund": classify.expense_label(F.col("data")) == REFUND_LABEL}
    )
    labelled = label_tracks(rows.withColumn("amount", F.when(F.col("refund"), F.lit("junk")).otherwise(amount)))
    return labelled.select("event_id", "track", "amount")


@query
def expense_rows(spark: SparkSession, folder: str) -> DataFrame:
    return expense_track(_identified(spark, folder))


@query
def income_rows(spark: SparkSession, folder: str) -> DataFrame:
    return income_track(_identified(spark, folder))


@query
def track_route(spark: SparkSession, folder: str) -> DataFrame:
    labelled = label_tracks(orders_ledger(spark, folder))
    return labelled.select("track", "day", "month", "year", "amount", "category", "data", "o_orderkey")


@query
def lineitem_tracks(spark: SparkSession, folder: str) -> DataFrame:
    labelled = label_tracks(normalise(raw_lineitems(spark, folder)))
    return labelled.select("track", "day", "month", "year", "amount", "category", "data")


@query
def lineitem_txn_ids(spark: SparkSession, folder: str) -> DataFrame:
    return assign_txn_ids(normalise(raw_lineitems(spark, folder))).select("txn_id", "data")


@query
def minor_units_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    comma = F.replace(F.concat(F.lit("-"), price.cast("string")), F.lit("."), F.lit(","))
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        minor_units(amount_value(comma)).alias("minor"),
        minor_units(price / F.lit(1000.0)).alias("minor_thousandth"),
    )


@query
def float_texts(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        float_text(price).alias("plain"),
        float_text(price * F.lit(1e5)).alias("large"),
        float_text(price * F.lit(1e14)).alias("huge"),
        float_text(price / F.lit(1e9)).alias("small"),
        float_text(-price / F.lit(1e13)).alias("tiny"),
    )


@query
def occurrence_index(spark: SparkSession, folder: str) -> DataFrame:
    return _event_id(with_occurrence(_events(spark, folder))).select("event_id", "occurrence")


@query
def occurrence_index_sliced(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a low threshold, so that the monthly fee is cut into slices."""
    counted = with_occurrence(_events(spark, folder), hot_rows=20, slice_bits=4)
    return _event_id(counted).select("event_id", "occurrence")


@query
def assign_txn_id(spark: SparkSession, folder: str) -> DataFrame:
    return _event_id(_identified(spark, folder)).select("event_id", "txn_id")


@query
def id_collisions(spark: SparkSession, folder: str) -> DataFrame:
    counted = with_occurrence(_events(spark, folder))
    return counted.agg(F.count_if(F.col("occurrence") > 0).alias("repeated_rows"), F.count(F.lit(1)).alias("rows"))


def _imports(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping imports: all expense events, then all events."""
    raw = raw_events(spark, folder)
    first = raw.where(F.col("value_date").isNotNull() & F.col("amount").startswith("-"))
    return first.withColumn(IMPORT_ID, F.lit("first")), raw.withColumn(IMPORT_ID, F.lit("second"))


@query
def reimport_merge(spark: SparkSession, folder: str) -> DataFrame:
    first, second = (assign_txn_ids(normalise(raw)) for raw in _imports(spark, folder))
    return merge_import(first, second).select("txn_id", F.col(IMPORT_ID).alias("import_id"), "data")


@query
def stream_reimport(spark: SparkSession, folder: str) -> DataFrame:
    """Both imports streamed into one ledger, the second one only adding what is new."""
    target = scratch_folder(spark, "stream")
    source = scratch_folder(spark, "drops")
    for number, raw in enumerate(_imports(spark, folder)):
        drop = f"{source}/import{number}"
        raw.write.parquet(drop)
        frames = spark.readStream.schema(raw.schema).parquet(drop)
        stream = import_frames(
            frames, f"{target}/ledger", f"{target}/checkpoint{number}", stream=f"import{number}"
        )
        stream.awaitTermination()
    ledger = spark.read.parquet(f"{target}/ledger")
    return ledger.select("txn_id", "track", "amount", "category", "data")


@query
def bucketed_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Both imports folded into a ledger that is laid out in buckets of the id."""
    target = scratch_folder(spark, "bucketed")
    name = "ledger_" + target.rsplit("-", 1)[1]
    for raw in _imports(spark, folder):
        ledger = merge_bucketed(assign_txn_ids(normalise(raw)), name, target, LEDGER_BUCKETS)
    spark.sql(f"DROP TABLE {name}")
    stored = spark.read.schema(ledger.schema).parquet(target)
    return stored.select("txn_id", F.col(IMPORT_ID).alias("import_id"), "data")


def _in_drops(
    rows: DataFrame, number: Column, drops: int, build: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, list[StreamingQuery]]:
    """Rows written in drops and streamed, one micro-batch and one start of the stream for each drop.

    The streams run in a session of their own with a state partition per core:
    every micro-batch opens and commits each of them. Rows are dealt out before
    they are written, so that every drop lies in as many files as there are cores,
    not in the few that hold its part of the table.
    """
    spark = rows.sparkSession
    tasks = max(STREAM_PARTITIONS, spark.sparkContext.defaultParallelism)
    session = configure(spark.newSession())
    session.conf.set("spark.sql.shuffle.partitions", str(tasks))
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source, target = scratch_folder(spark, "drops"), scratch_folder(spark, "streamed")
    dealt = rows.withColumn("drop", number).repartition(tasks, *rows.columns)
    dealt.write.partitionBy("drop").parquet(f"{source}/all")
    done = []
    for drop in range(drops):
        part = spark.read.parquet(f"{source}/all").where(F.col("drop") == drop).drop("drop")
        part.write.mode("append").parquet(f"{source}/folder")
        frames = session.readStream.schema(rows.schema).parquet(f"{source}/folder")
        writer = build(frames).writeStream.option("checkpointLocation", f"{target}/checkpoint")
        stream = writer.trigger(availableNow=True).start(f"{target}/rows")
        stream.awaitTermination()
        done.append(stream)
    return spark.read.parquet(f"{target}/rows"), done


def _event_thirds(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """Normalised events and which third of the event numbers each is in."""
    rows = _events(spark, folder)
    numbers = rows.agg((F.max(INGEST_ORDER) + 1).alias("n")).first()["n"] or 1
    return rows, F.least(F.floor(F.col(INGEST_ORDER) * 3 / F.lit(numbers)), F.lit(2)).cast("int")


@query
def stream_running_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Events in three micro-batches, the stream stopped and started again in between."""
    rows, third = _event_thirds(spark, folder)
    counted, _ = _in_drops(rows, third, 3, lambda frames: stream_occurrence(frames, STREAM_BUCKETS))
    return _event_id(counted).select("event_id", "occurrence")


@query
def stream_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated rows that the micro-batches of a stream report while they assign ids."""
    rows, third = _event_thirds(spark, folder)
    identified, streams = _in_drops(rows, third, 3, lambda frames: stream_txn_ids(frames, STREAM_BUCKETS))
    repeated, counted = (sum(column) for column in zip(*map(collisions_of, streams)))
    ids = identified.agg(F.count_distinct("txn_id").alias("distinct_ids"))
    return ids.select(F.lit(repeated).alias("repeated_rows"), F.lit(counted).alias("rows"), "distinct_ids")


@query
def stream_late_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Identified events of which many arrive again: soon, days later, or after a month.

    Copies within the delay of four days go; those after 35 days pass, since
    the state has let go of their ids by then.
    """
    stamped = _events(spark, folder).join(
        read_table(spark, folder, "events").select(F.col("event_id").alias(INGEST_ORDER), "ts"), INGEST_ORDER
    )
    rows = assign_txn_ids(stamped)
    number = F.col(INGEST_ORDER)
    days = F.when(number % 2 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    days = F.when(number % 3 == 0, F.array_append(days, F.lit(0))).otherwise(days)
    days = F.when(number % 7 == 0, F.array_append(days, F.lit(35))).otherwise(days)
    sent = rows.select("txn_id", "data", "ts", F.explode(days).alias("later")).select(
        "txn_id", "data", (F.col("ts") + F.make_dt_interval(F.col("later"))).alias("arrived")
    )
    first = sent.agg(F.min("arrived").alias("first")).first()["first"]
    drop = F.floor(F.date_diff("arrived", F.lit(first)) / 12).cast("int")
    kept, _ = _in_drops(sent, F.least(drop, F.lit(5)), 6, lambda frames: without_late_copies(frames, "arrived", "4 days"))
    return kept.select("txn_id", "data")


@query
def split_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_id(_events(spark, folder))
    return rows.select("event_id", F.posexplode(split_parts(F.col("data"))).alias("pos", "part"))


@query
def extract_location(spark: SparkSession, folder: str) -> DataFrame:
    located = with_location(_event_id(_events(spark, folder)))
    return located.select("event_id", "extracted_location", "google_maps_link")


@query
def extract_location_documents(spark: SparkSession, folder: str) -> DataFrame:
    located = with_location(read_table(spark, folder, "documents"), "text")
    return located.select("doc_id", "extracted_location", "google_maps_link")


@query
def map_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links made straight from raw location blocks, field names included."""
    rows = _event_id(raw_events(spark, folder))
    return rows.select("event_id", "data", map_link(F.col("data")).alias("link"), quote_path("data").alias("quoted"))


@query
def restored_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_id(raw_events(spark, folder))
    return rows.select("event_id", restore_diacritics(F.col("data")).alias("restored"))


@query
def guarded_cells(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_id(raw_events(spark, folder))
    cells = {name: sheet_guard(F.col(name)).alias(name) for name in ("amount", "currency", "description")}
    return rows.select("event_id", *cells.values())


@query
def sheets_expenses(spark: SparkSession, folder: str) -> DataFrame:
    return review.sheet(expense_track(_identified(spark, folder)), review.expense_rows)


@query
def sheets_income(spark: SparkSession, folder: str) -> DataFrame:
    return review.sheet(income_track(_identified(spark, folder)), review.income_rows)


@query
def cleaned_expenses(spark: SparkSession, folder: str) -> DataFrame:
    return review.cleaned_rows(expense_track(_identified(spark, folder)))


@query
def cleaned_income(spark: SparkSession, folder: str) -> DataFrame:
    return review.cleaned_rows(income_track(_identified(spark, folder)))


@query
def unassigned_expenses(spark: SparkSession, folder: str) -> DataFrame:
    return review.unassigned_expenses(expense_track(_identified(spark, folder)))


@query
def unassigned_income(spark: SparkSession, folder: str) -> DataFrame:
    return review.unassigned_income(income_track(_identified(spark, folder)))


@query
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_id(_events(spark, folder)).select("event_id", "txn_type", "amount", "data")
    return preview(rows, order_by=["event_id"])


@query
def import_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Gate counts of both imports, with some amounts missing and some unreadable."""
    first, second = (with_occurrence(normalise(raw)) for raw in _imports(spark, folder))
    number = F.col(INGEST_ORDER)
    amount = F.when(number % 13 == 1, F.lit("NaN")).when(number % 13 == 2, F.lit(None)).when(number % 13 == 3, F.lit("12,x"))
    rows = first.unionByName(second).withColumns(
        {
            "amount": F.when(number % 13 < 4, amount).otherwise(F.col("amount")),
            "booking_date": F.when(number % 17 != 0, F.col("booking_date")),
            "data": F.when(number % 19 != 0, F.col("data")).otherwise(F.lit("")),
        }
    )
    return quality_report(rows)


@query
def lint_part_names(spark: SparkSession, folder: str) -> DataFrame:
    """Idle keywords among the names and words of parts, each brand a label of its number's rank."""
    brand = F.col("p_brand")
    named = read_table(spark, folder, "part").select(
        F.regexp_extract(brand, "[0-9]+", 0).cast("int").alias("priority"),
        brand.alias("label"),
        F.explode(F.array_append(F.split(F.lower("p_name"), " "), F.lower("p_name"))).alias("keyword"),
    )
    return shadowed_keywords(named.distinct())


@query
def track_without_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Both tracks of rows that were never given ids: the id column is there, and empty."""
    rows = _events(spark, folder)
    columns = ["txn_id", "day", "month", "year", "amount", "category", "data"]
    return expense_track(rows).select(*columns).unionByName(income_track(rows).select(*columns))


@query
def empty_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned expenses of a year without any, written and read back: headers, and not one record."""
    target = scratch_folder(spark, "empty")
    write_cleaned(expense_track(_identified(spark, folder).where(F.col("year") < 1900)), target)
    lines = spark.read.text(target).select(F.regexp_replace("value", "^\ufeff", "").alias("header"))
    records = read_processed(spark, target).agg(F.count(F.lit(1)).alias("records"))
    return lines.distinct().withColumn("records", F.lit(records.first()["records"]))


def _quoted_writer(rows: DataFrame) -> DataFrameWriter:
    writer = rows.write.option("header", True).option("escape", '"')
    return writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


@query
def bank_csv_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Bank files under two headers of other names, which are matched by position."""
    target = scratch_folder(spark, "headers")
    raw = raw_events(spark, folder).withColumn("unnamed_8", F.col(INGEST_ORDER).cast("string"))
    odd = F.col(INGEST_ORDER) % 2 == 1
    _quoted_writer(raw.where(~odd).select(*RAW_COLUMNS)).csv(f"{target}/plain")
    other = [F.col(name).alias(f"Field {place}, {name.upper()}") for place, name in enumerate(RAW_COLUMNS)]
    _quoted_writer(raw.where(odd).select(*other)).csv(f"{target}/other")
    rows = normalise(read_bank_csv(spark, [f"{target}/plain", f"{target}/other"]).rows)
    return rows.select("description", "amount", "data", "day")


@query
def processed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned expenses in files of two column orders, read back by each file's own header."""
    target = scratch_folder(spark, "orders")
    rows = review.cleaned_rows(expense_track(_identified(spark, folder)))
    write_csv(rows.where(F.col("day") % 2 == 0), f"{target}/plain", mark=True)
    turned = rows.where(F.col("day") % 2 == 1).select(*reversed(rows.columns), F.lit("more").alias("note"))
    write_csv(turned, f"{target}/turned")
    return read_processed(spark, [f"{target}/plain", f"{target}/turned"])


@query
def bank_csv_import(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as bank files in two charsets and read back."""
    target = scratch_folder(spark, "bank-csv")
    raw = raw_events(spark, folder)
    income = F.col("txn_type").isNull() | (F.col("txn_type") == "nan")
    written = raw.withColumn("unnamed_8", F.col(INGEST_ORDER).cast("string")).select(*RAW_COLUMNS)
    parts = {"windows-1250": written.where(income), "UTF-8": written.where(~income)}
    for charset, part in parts.items():
        writer = part.write.option("header", True).option("escape", '"').option("encoding", charset)
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(
            f"{target}/{charset}"
        )
    rows = normalise(read_bank_csv(spark, [f"{target}/{charset}" for charset in parts]).rows)
    return rows.drop(IMPORT_ID, INGEST_ORDER).withColumns(
        {name: _text(name) for name in ("booking_date", "value_date")}
    )


@query
def bank_csv_wrapped(spark: SparkSession, folder: str) -> DataFrame:
    """Bank files whose descriptions run over line ends."""
    target = scratch_folder(spark, "wrapped-csv")
    text = F.concat_ws("\n", "description", F.lit('second "line", quoted'), F.lit(""))
    written = raw_events(spark, folder).withColumns(
        {"description": text, "unnamed_8": F.col(INGEST_ORDER).cast("string")}
    )
    writer = written.select(*RAW_COLUMNS).write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(target)
    rows = normalise(read_bank_csv(spark, target).rows)
    return rows.select("description", "amount", "data")


@query
def skipped_bank_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records set aside because error events were written with a field too many."""
    target = scratch_folder(spark, "skipped-csv")
    raw = raw_events(spark, folder).withColumn("unnamed_8", F.col(INGEST_ORDER).cast("string"))
    quoted = [F.concat(F.lit('"'), F.coalesce(F.col(name), F.lit("")), F.lit('"')) for name in RAW_COLUMNS]
    extra = F.when(F.col("txn_type").isNull(), F.lit(",extra")).otherwise(F.lit(""))
    line = F.concat(F.concat_ws(",", *quoted), extra)
    # Separator and quote that never occur, so that whole lines are written as they are.
    writer = raw.select(line.alias(",".join(RAW_COLUMNS))).write.option("header", True)
    writer.option("sep", "\x01").option("quote", "\x02").option("escape", "\x02").csv(target)
    return read_bank_csv(spark, target).skipped.select("record")


@query
def ledger_table(spark: SparkSession, folder: str) -> DataFrame:
    """Both tracks written as the partitioned ledger and read back."""
    target = scratch_folder(spark, "ledger")
    write_ledger(label_tracks(_identified(spark, folder)), target)
    ledger = spark.read.parquet(target)
    tracks = [only_track(ledger, track).withColumn("track", F.lit(track)) for track in (EXPENSE, INCOME)]
    return tracks[0].unionByName(tracks[1])


@query
def processed_readback(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned expenses written with a byte order mark and read back by name."""
    target = scratch_folder(spark, "processed")
    write_cleaned(expense_track(_identified(spark, folder)), target)
    return read_processed(spark, target)
