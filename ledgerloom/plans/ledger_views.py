"""Bank-ledger views over the benchmark tables.

None of the tables is a bank export, so each event or order becomes one ledger
row: dates and amounts come from the row itself, the texts from a short list of
merchants picked by the row's number. Every third event is the same monthly fee,
so one description holds a third of all rows and equal rows are common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.keywords import constant
from ledgerloom.operators.normalise import INGEST_ORDER, RAW_COLUMNS

# (description, extra text, location block) of the ledger rows.
MERCHANTS: tuple[tuple[str | None, str, str], ...] = (
    ("Monthly account fee", "", ""),
    ("Biedronka", "", "Lokalizacja : Adres : UL. PIOTRKOWSKA 146 Miasto : LODZ Kraj : POLSKA"),
    ("LIDL 1204", "ref 11", ""),
    ("Yerbamate & matcha corner", "", ""),
    ("MPK ticket", "", "Lokalizacja : Adres : al. Jozefa 5 Miasto : KRAKOW Kraj : POLSKA"),
    ("ORLEN station 77", "", ""),
    ("Toyota service", "nan", ""),
    ("Starbucks", "", "city mall/"),
    ("McDonald's", "", ""),
    ("Kebab house", "/late night/", ""),
    ("Restauracja Epoka", "", "Lokalizacja : Adres : Plac Zamkowy 1 : Warszawa Kraj : POLSKA"),
    ("Whisky & spirits", "", ""),
    ("Apartment rent", "", ""),
    ("Apart jewels", "", ""),
    ("Internet bill", "title 2024/01", ""),
    ("IKEA", "", ""),
    ("Nike outlet", "", ""),
    ("Cinema City", "bilet", ""),
    ("Steam games", "", ""),
    ("Decathlon", "", ""),
    ("Apteka Melissa", "", ""),
    ("Ryanair", "", ""),
    ("Audioteka", "", ""),
    ("PZU policy", "", ""),
    ("netflix", "", ""),
    ("XTB investment platform deposit", "", ""),
    ("Udemy course", "", ""),
    ("Kids toys", "", ""),
    ("amazon order", "web payment - mobile code", ""),
    ("Zwrot za zakupy", "", ""),
    ("REFUND 100234", "", ""),
    ("Zwrot podatku PIT", "", ""),
    ("Wynagrodzenie", "", ""),
    ("Salary March", "transfer from account", ""),
    ("Freelance logo design", "", ""),
    ("Payout 55", "", ""),
    ("Bonus", "", ""),
    ("Dividend payment", "", ""),
    ("65463", "test", "xLokalizacja : Adres : UL. SLOWACKIEGO 30 Miasto : POZNAN"),
    ("non", "", "78979 - Lokalizacja : Adres : ul. Lipowa 4 : Gdansk Kraj : POLSKA"),
    ("zakup w terminalu", "", "Smyk - ul. Polna 12, Torun"),
    ("store", "", "Oak Park 42"),
    ("shop", "", "Calle Mayor 5, Madrid"),
    ("Unknown https://example.org/a b", "", ""),
    ("=SUM(A1)", "phone number 123", ""),
    ("  + plus   sign  ", "", ""),
    ("Unknown payee", "", "lokalizacja: adres ul. Testowa 12 miasto: Krakow kraj: Polska"),
    ("nan", "", "Random text - market"),
    (None, "", "sw. Jana 7, Lodz"),
    ("Purchase in terminal - mobile code", "recipient account", "maratonska 24"),
    ("Żabka Łódź", "", "ul. Źródlana 4 : WARSZAWA"),
    ("Café pod Różą", "", ""),
)

# Transaction type of each event type; one is missing and one reads "nan".
EVENT_TYPES = {
    "purchase": "Zakup w terminalu",
    "click": "Web payment",
    "signup": "Przelew na rachunek",
    "view": "nan",
    "error": None,
}
INCOME_EVENTS = ("signup", "view")
FEE = "-5.00"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A benchmark table, spread over all cores if it is stored in fewer splits.

    The small test tables are one row group each, which only one task can read.
    A table with enough splits is left alone, so large ones are never shuffled.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def _merchant(number: Column) -> Column:
    fields = ("description", "extra", "place")
    listed = constant(
        [dict(zip(fields, row, strict=True)) for row in MERCHANTS],
        "array<struct<description:string,extra:string,place:string>>",
    )
    return F.get(listed, (number % len(MERCHANTS)).cast("int"))


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Nine raw text columns per event, plus ``event_id`` as the ingest order."""
    events = read_table(spark, folder, "events")
    number = F.col("event_id")
    is_fee = number % 3 == 0
    merchant = _merchant(F.when(is_fee, F.lit(0)).otherwise(number))
    day = F.date_format("ts", "yyyy-MM-dd")
    booked = F.when(is_fee, F.date_format(F.trunc("ts", "month"), "yyyy-MM-dd")).otherwise(day)
    kind = F.lit(None).cast("string")
    for event, text in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == event, F.lit(text)).otherwise(kind)
    value = F.col("value").cast("string")
    signed = F.when(F.col("event_type").isin(*INCOME_EVENTS), value).otherwise(F.concat(F.lit("-"), value))
    return events.withColumn("_merchant", merchant).select(
        booked.alias("booking_date"),
        F.when(F.col("event_type") == "view", F.lit("PLN")).otherwise(booked).alias("value_date"),
        F.when(is_fee, F.lit("Fee")).otherwise(kind).alias("txn_type"),
        F.when(is_fee, F.lit(FEE)).otherwise(signed).alias("amount"),
        F.when(number % 5 == 0, F.lit(" pln")).otherwise(F.lit("PLN")).alias("currency"),
        F.col("_merchant.description").alias("description"),
        F.col("_merchant.extra").alias("unnamed_6"),
        F.col("_merchant.place").alias("data"),
        F.lit(None).cast("string").alias("unnamed_8"),
        number.alias(INGEST_ORDER),
    ).select(*RAW_COLUMNS, INGEST_ORDER)


def raw_lineitems(spark: SparkSession, folder: str) -> DataFrame:
    """Nine raw text columns per line item; every line has its own reference text."""
    lines = read_table(spark, folder, "lineitem")
    number = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    booked = F.date_format("l_shipdate", "yyyy-MM-dd")
    price = F.col("l_extendedprice").cast("string")
    return lines.withColumn("_merchant", _merchant(number)).select(
        booked.alias("booking_date"),
        booked.alias("value_date"),
        F.when(F.col("l_linestatus") == "O", F.lit("Card payment")).otherwise(F.lit("Transfer")).alias("txn_type"),
        F.when(F.col("l_returnflag") == "R", price).otherwise(F.concat(F.lit("-"), price)).alias("amount"),
        F.lit("PLN").alias("currency"),
        F.col("_merchant.description").alias("description"),
        F.concat(F.lit("ref "), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias(
            "unnamed_6"
        ),
        F.col("_merchant.place").alias("data"),
        F.col("_merchant.extra").alias("unnamed_8"),
    )


def orders_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Transaction rows of orders; customers in debt pay, the others are paid."""
    orders, customers = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    price = F.col("o_totalprice").cast("string")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("booking_date"),
        F.when(F.col("c_acctbal") < 5000, F.concat(F.lit("-"), price)).otherwise(price).alias("amount"),
        F.lower(
            F.concat_ws("//", "o_orderpriority", "c_mktsegment", _merchant(F.col("o_orderkey"))["description"])
        ).alias("data"),
        F.dayofmonth("o_orderdate").alias("day"),
        F.month("o_orderdate").alias("month"),
        F.year("o_orderdate").alias("year"),
    )
