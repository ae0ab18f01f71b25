"""DuckDB SQL that computes the catalogue's queries independently of Spark."""

from __future__ import annotations

from collections.abc import Iterable

from ledgerloom.functions.location import (
    CITIES,
    DIACRITICS,
    FIELD_PREFIXES,
    GENERIC_TERMS,
    MAP_SEARCH_URL,
    STREET_TOKENS,
)
from ledgerloom.operators.classify import DESCRIPTION_REPLACEMENTS
from ledgerloom.operators.metrics import PREVIEW_ROWS
from ledgerloom.plans.ledger_views import EVENT_TYPES, FEE, INCOME_EVENTS, MERCHANTS
from ledgerloom.rules import (
    DEFAULT_EXPENSE,
    DEFAULT_INCOME,
    REFUND_LABEL,
    RuleSet,
    display_rules,
    expense_rules,
    income_rules,
)

# The same character classes in the RE2 dialect.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows: Iterable[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else text(v) for v in row) + ")" for row in rows)


def has_any(subject: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({subject}, {text(word)})" for word in words) + ")"


def first_match(subject: str, rules: RuleSet) -> str:
    cases = " ".join(f"WHEN {has_any(subject, words)} THEN {text(label)}" for label, words in rules.rules)
    return f"CASE {cases} ELSE {text(rules.default)} END"


def replaced(subject: str, pairs: dict[str, str]) -> str:
    for old, new in pairs.items():
        subject = f"replace({subject}, {text(old)}, {text(new)})"
    return subject


def stripped(subject: str) -> str:
    return f"regexp_replace({subject}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def guarded(subject: str) -> str:
    return f"CASE WHEN regexp_matches({subject}, '^{SPACE}*[=+@-]') THEN '''' || {subject} ELSE {subject} END"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


EXPENSE_LABEL = first_match("lower(data)", expense_rules())
INCOME_LABEL = first_match("lower(data)", income_rules())

MERCHANT_ROWS = (
    "merchants(k, description, extra, place) AS (VALUES "
    + values((number, *row) for number, row in enumerate(MERCHANTS))
    + ")"
)

_KIND = " ".join(f"WHEN {text(event)} THEN {text(kind)}" for event, kind in EVENT_TYPES.items())
_INCOME = ", ".join(text(event) for event in INCOME_EVENTS)

RAW = f"""raw AS (
  SELECT event_id,
         CASE WHEN event_id % 3 = 0 THEN strftime(date_trunc('month', ts), '%Y-%m-%d')
              ELSE strftime(ts, '%Y-%m-%d') END AS booking_date,
         CASE WHEN event_type = 'view' THEN 'PLN'
              WHEN event_id % 3 = 0 THEN strftime(date_trunc('month', ts), '%Y-%m-%d')
              ELSE strftime(ts, '%Y-%m-%d') END AS value_date,
         CASE WHEN event_id % 3 = 0 THEN 'Fee' ELSE CASE event_type {_KIND} END END AS txn_type,
         CASE WHEN event_id % 3 = 0 THEN '{FEE}'
              WHEN event_type IN ({_INCOME}) THEN CAST(value AS VARCHAR)
              ELSE '-' || CAST(value AS VARCHAR) END AS amount,
         CASE WHEN event_id % 5 = 0 THEN ' pln' ELSE 'PLN' END AS currency,
         m.description, m.extra AS unnamed_6, m.place AS data, CAST(NULL AS VARCHAR) AS unnamed_8
  FROM events JOIN merchants m ON m.k = CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % {len(MERCHANTS)} END)"""


def _normalised(source: str, key: str, extra: str = "") -> str:
    def known(name: str) -> str:
        return f"CASE WHEN lower({name}) = 'nan' THEN '' ELSE coalesce(lower({name}), '') END"

    merged = ", ".join(known(name) for name in ("txn_type", "description", "unnamed_6", "unnamed_8", "data"))
    return f"""SELECT {key} TRY_CAST(booking_date AS DATE) AS booking_date, TRY_CAST(value_date AS DATE) AS value_date,
         lower(txn_type) AS txn_type, amount, currency, lower(description) AS description,
         trim(regexp_replace(concat_ws('//', {merged}), '/{{2,}}', '//', 'g'), '/') AS data,
         CAST(month(CAST(booking_date AS DATE)) AS INTEGER) AS month,
         CAST(year(CAST(booking_date AS DATE)) AS INTEGER) AS year,
         CAST(day(CAST(booking_date AS DATE)) AS INTEGER) AS day {extra}
  FROM {source}"""


NORM = f"norm AS ({_normalised('raw', 'event_id,')})"
EVENTS = (MERCHANT_ROWS, RAW, NORM)

ISO_DATES = "strftime(booking_date, '%Y-%m-%d') AS booking_date, strftime(value_date, '%Y-%m-%d') AS value_date"


def _keys(source: str, carried: str) -> str:
    amount = "CAST(amount AS DOUBLE)"
    return f"""keyed AS (
  SELECT {carried},
         coalesce(strftime(booking_date, '%Y-%m-%d'), '') AS k1, coalesce(strftime(value_date, '%Y-%m-%d'), '') AS k2,
         (CASE WHEN {amount} < 0 THEN -1 ELSE 1 END) * CAST(floor(abs({amount}) * 100.0::DOUBLE + 0.5) AS BIGINT) AS k3,
         upper(trim(coalesce(currency, ''))) AS k4, upper(trim(coalesce(txn_type, ''))) AS k5,
         trim(regexp_replace(lower(nfc_normalize(data)), '\\s+', ' ', 'g')) AS k6
  FROM {source})"""


def _ids(order: str, import_id: str = "''") -> str:
    return f"""ids AS (
  SELECT 'v1:' || sha256(concat_ws('|', k1, k2, k3, k4, k5, k6, occurrence)) AS txn_id, * FROM (
    SELECT *, row_number() OVER (PARTITION BY {import_id}, k1, k2, k3, k4, k5, k6 ORDER BY {order}) - 1 AS occurrence
    FROM keyed))"""


CARRIED = "event_id, amount, txn_type, data, day, month, year"
IDENTIFIED = (*EVENTS, _keys("norm", CARRIED), _ids("event_id"))

CLEANED = f"""cleaned AS MATERIALIZED (
  SELECT * REPLACE ({replaced("data", DESCRIPTION_REPLACEMENTS)} AS data) FROM ids)"""
LABELLED = f"""labelled AS MATERIALIZED (
  SELECT *, {EXPENSE_LABEL} AS expense_label, {INCOME_LABEL} AS income_label FROM cleaned)"""
KEPT = f"""prepared AS (
  SELECT * EXCLUDE (amount), CAST(amount AS DOUBLE) AS value FROM labelled WHERE expense_label <> '{REFUND_LABEL}')"""
PREPARED = (CLEANED, LABELLED, KEPT)
EXPENSES = """expenses AS (
  SELECT txn_id, day, month, year, CAST(abs(value) AS VARCHAR) AS amount, expense_label AS category, data
  FROM prepared WHERE value <= 0)"""
INCOMES = """incomes AS (
  SELECT txn_id, day, month, year, CAST(value AS VARCHAR) AS amount, income_label AS category, data
  FROM prepared WHERE value > 0)"""
TRACKS = (*IDENTIFIED, *PREPARED, EXPENSES, INCOMES)

_DISPLAY_ROWS = [(label, *pair) for label, pair in display_rules().by_label(expense_rules()).items()]
DISPLAY = f"display(label, category, importance) AS (VALUES {values(_DISPLAY_ROWS)})"
_DEFAULT_CATEGORY, _DEFAULT_IMPORTANCE = display_rules().default


def _display_of(subject: str, field: int) -> str:
    cases = " ".join(
        f"WHEN {has_any(subject, [word for label in pair[2] for word in expense_rules().keywords(label)])} "
        f"THEN {text(pair[field])}"
        for pair in display_rules().pairs
    )
    return f"CASE {cases} ELSE {text(display_rules().default[field])} END"


def _trimmed(subject: str) -> str:
    return f"trim({subject}, ' ,')"


def _separators(subject: str) -> str:
    subject = f"regexp_replace({subject}, '{SPACE}*:{SPACE}*', ', ', 'g')"
    subject = f"regexp_replace({subject}, '{SPACE}+', ' ', 'g')"
    return _trimmed(f"regexp_replace({subject}, ',{SPACE}*,', ',', 'g')")


def _respelled(subject: str) -> str:
    for plain, proper in sorted(DIACRITICS.items(), key=lambda pair: -len(pair[0])):
        pattern = plain.replace(".", r"\.")
        subject = f"regexp_replace({subject}, '(?i)\\b{pattern}\\b', {text(proper)}, 'g')"
    return subject


def _link(subject: str) -> str:
    low = f"lower({subject})"
    prefixes = "".join(f"({prefix}{SPACE}*)?" for prefix in FIELD_PREFIXES)
    tidy = f"regexp_replace({subject}, '(?i)^{prefixes}', '')"
    tidy = (
        f"regexp_replace({tidy}, '(?i){SPACE}*:{SPACE}*([^:]+?){SPACE}+kraj{SPACE}*:{SPACE}*{WORD}+$', ', \\1', 'g')"
    )
    tidy = _separators(tidy)
    return f"""CASE WHEN ({has_any(low, STREET_TOKENS)} OR (contains({subject}, ',')
              AND (regexp_matches({subject}, '\\p{{Nd}}') OR {has_any(low, CITIES)}))) AND {tidy} <> ''
            THEN '{MAP_SEARCH_URL}' || {_quoted(tidy)} ELSE '' END"""


def _quoted(subject: str) -> str:
    return f"replace(url_encode({subject}), '%2F', '/')"


def _locations(source: str, key: str, data: str) -> tuple[str, ...]:
    generic = ", ".join(text(term) for term in GENERIC_TERMS)
    fields = (
        f"(?i)adres{SPACE}*:{SPACE}*(.*?){SPACE}*(?:miasto{SPACE}*:{SPACE}*(.*?))?(?:kraj{SPACE}*:{SPACE}*.*)?$"
    )
    street = _trimmed(f"regexp_extract(payload, '{fields}', 1)")
    town = _trimmed(f"regexp_extract(payload, '{fields}', 2)")
    domestic = _trimmed(f"regexp_replace(payload, '(?is)kraj{SPACE}*:.*$', '')")
    return (
        f"""parts AS (
  SELECT {key}, pos, part FROM (
    SELECT {key}, unnest(list_transform(string_split({data}, '//'), lambda x: {stripped("x")})) AS part,
           generate_subscripts(string_split({data}, '//'), 1) AS pos
    FROM {source}) WHERE part <> '')""",
        f"""payloads AS (
  SELECT *, CASE WHEN contains(lower(part), 'lokalizacja') AND contains(lower(part), 'adres')
                  AND regexp_matches(part, '(?i)lokalizacja{SPACE}*:')
             THEN regexp_extract(part, '(?is)lokalizacja{SPACE}*:{SPACE}*(.*)$', 1) END AS payload,
         {stripped("string_split(part, ' - ')[-1]")} AS tail
  FROM parts)""",
        f"""pieces AS (
  SELECT *, {street} AS street, {town} AS town, {domestic} AS domestic,
         regexp_matches(payload, '{fields}') AS has_fields
  FROM payloads)""",
        f"""hits AS (
  SELECT {key}, pos, part,
         CASE WHEN payload IS NULL THEN ''
              WHEN has_fields THEN concat_ws(', ', nullif(street, ''), nullif(town, ''))
              WHEN contains(domestic, ':') AND {_trimmed("regexp_extract(domestic, '(?s)^(.*):', 1)")} <> ''
                   AND {_trimmed("string_split(domestic, ':')[-1]")} <> ''
              THEN {_trimmed("regexp_extract(domestic, '(?s)^(.*):', 1)")} || ', ' ||
                   {_trimmed("string_split(domestic, ':')[-1]")}
              ELSE domestic END AS structured,
         CASE WHEN contains(part, ' - ') AND NOT contains(lower(part), 'lokalizacja')
                   AND lower(tail) NOT IN ({generic}) THEN tail ELSE '' END AS dash,
         lower(part) NOT IN ({generic}) AND ({has_any("lower(part)", STREET_TOKENS)}
           OR regexp_matches(part, '{WORD}+{SPACE}+{WORD}+{SPACE}+\\p{{Nd}}')
           OR (regexp_matches(part, '\\p{{Nd}}') AND length(part) > 8)) AS address,
         lower(part) NOT IN ({generic}) AND length(part) > 3 AS longer
  FROM pieces)""",
        f"""located AS (
  SELECT s.*, {_respelled(_separators(_prefixes_dropped("coalesce(h.found, '')")))} AS extracted_location
  FROM {source} s LEFT JOIN (
    SELECT {key}, coalesce(arg_min(structured, pos) FILTER (structured <> ''), arg_min(dash, pos) FILTER (dash <> ''),
                           arg_min(part, pos) FILTER (address), arg_min(part, pos) FILTER (longer)) AS found
    FROM hits GROUP BY {key}) h USING ({key}))""",
    )


def _prefixes_dropped(subject: str) -> str:
    without = f"regexp_replace({subject}, '(?i){SPACE}*kraj{SPACE}*:{SPACE}*[^,]*', '', 'g')"
    return replaced(without, dict.fromkeys(FIELD_PREFIXES, " "))


def _sheet(source: str, category: str, importance: str, join: str = "") -> str:
    columns = {
        "Txn_Id": "t.txn_id",
        "Item": "t.category",
        "Category": category,
        "Amount": "replace(t.amount, '.', ',')",
        "Importance": importance,
    }
    cells = ", ".join(f"{guarded(value)} AS {name}" for name, value in columns.items())
    return f"SELECT {cells}, t.day AS Day, t.month AS Month, t.year AS Year FROM {source} t {join}"


def _guarded_columns(*names: str) -> str:
    return ", ".join(f"{guarded(name)} AS {name}" for name in names)


LINE_RAW = f"""raw AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS booking_date, strftime(l_shipdate, '%Y-%m-%d') AS value_date,
         CASE WHEN l_linestatus = 'O' THEN 'Card payment' ELSE 'Transfer' END AS txn_type,
         CASE WHEN l_returnflag = 'R' THEN '' ELSE '-' END || CAST(l_extendedprice AS VARCHAR) AS amount,
         'PLN' AS currency, m.description, 'ref ' || l_partkey || '-' || l_suppkey AS unnamed_6,
         m.place AS data, m.extra AS unnamed_8
  FROM lineitem JOIN merchants m ON m.k = (l_orderkey * 7 + l_linenumber) % {len(MERCHANTS)})"""
LINES = (MERCHANT_ROWS, LINE_RAW, f"norm AS ({_normalised('raw', '')})")

ORDER_LEDGER = f"""ids AS (
  SELECT o_orderkey, CASE WHEN c_acctbal < 5000 THEN '-' ELSE '' END || CAST(o_totalprice AS VARCHAR) AS amount,
         lower(concat_ws('//', o_orderpriority, c_mktsegment, m.description)) AS data,
         CAST(day(o_orderdate) AS INTEGER) AS day, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(year(o_orderdate) AS INTEGER) AS year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN merchants m ON m.k = o_orderkey % {len(MERCHANTS)})"""

BOTH_TRACKS = """CASE WHEN value > 0 THEN 'income' ELSE 'expense' END AS track, day, month, year,
  CAST(abs(value) AS VARCHAR) AS amount, CASE WHEN value > 0 THEN income_label ELSE expense_label END AS category, data"""

IMPORTS = (
    MERCHANT_ROWS,
    RAW.replace("raw AS (", "one AS (", 1),
    """raw AS (SELECT *, 1 AS import_no FROM one WHERE value_date IS NOT NULL AND amount LIKE '-%'
     UNION ALL SELECT *, 2 AS import_no FROM one)""",
    f"norm AS ({_normalised('raw', 'event_id, import_no,')})",
    _keys("norm", f"import_no, {CARRIED}"),
    _ids("event_id", "import_no"),
)
MERGED = """merged AS (
  SELECT * FROM ids i WHERE import_no = 1
     OR NOT EXISTS (SELECT 1 FROM ids o WHERE o.import_no = 1 AND o.txn_id = i.txn_id))"""

LABELS = values((number, label) for number, label in enumerate([*expense_rules().labels, expense_rules().default]))

SQL: dict[str, str] = {
    "normalise_import": ctes(*EVENTS) + f"SELECT * REPLACE ({ISO_DATES}) FROM norm",
    "clean_descriptions": ctes(*EVENTS) + f"SELECT event_id, {replaced('data', DESCRIPTION_REPLACEMENTS)} AS data FROM norm",
    "categorise_expense": ctes(*EVENTS) + f"SELECT event_id, {EXPENSE_LABEL} AS category FROM norm",
    "categorise_documents": f"SELECT doc_id, {first_match('lower(text)', expense_rules())} AS category FROM documents",
    "categorise_parts": f"SELECT p_partkey, {first_match('lower(p_name)', expense_rules())} AS category FROM part",
    "categorise_income": ctes(*EVENTS) + f"SELECT event_id, {INCOME_LABEL} AS category FROM norm",
    "classify_display": f"""SELECT doc_id, {_display_of("lower(text)", 0)} AS category,
       {_display_of("lower(text)", 1)} AS importance FROM documents""",
    "label_or_text_lookup": ctes(
        MERCHANT_ROWS,
        RAW,
        DISPLAY,
        f"labels(k, label) AS (VALUES {LABELS})",
        f"""items AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '  ' || lower(label) || ' ' ELSE coalesce(description, '') END AS item
  FROM raw JOIN labels ON k = event_id % {len(expense_rules().labels) + 1})""",
    )
    + f"""SELECT event_id, item, coalesce(d.category, {_display_of("lower(item)", 0)}) AS category,
       coalesce(d.importance, {_display_of("lower(item)", 1)}) AS importance
  FROM items LEFT JOIN display d ON d.label = upper(trim(item))""",
    "rules_broadcast_join": ctes(
        f"rules(priority, label, keyword) AS (VALUES {values(expense_rules().rows())})",
        """hits AS (SELECT doc_id, arg_min(label, priority) AS label
  FROM documents JOIN rules ON contains(lower(text), keyword) GROUP BY doc_id)""",
    )
    + f"SELECT doc_id, coalesce(label, '{expense_rules().default}') AS category FROM documents LEFT JOIN hits USING (doc_id)",
    "refund_filter": ctes(*EVENTS)
    + f"""SELECT event_id, category FROM (
  SELECT event_id, CASE WHEN coalesce(txn_type, '') <> 'nan' THEN {EXPENSE_LABEL} END AS category FROM norm)
  WHERE category IS DISTINCT FROM '{REFUND_LABEL}'""",
    "amount_gate": ctes(*EVENTS)
    + f"""SELECT event_id, CASE WHEN value > 0 THEN 'income' ELSE 'expense' END AS track,
       CASE WHEN isinf(value) THEN 'inf' ELSE CAST(abs(value) AS VARCHAR) END AS amount FROM (
  SELECT event_id, CASE event_id % 11 WHEN 1 THEN 5.0 WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN NULL
         WHEN 4 THEN '-inf'::DOUBLE WHEN 5 THEN 1000.0 ELSE CAST(amount AS DOUBLE) END AS value
  FROM norm WHERE ({EXPENSE_LABEL}) <> '{REFUND_LABEL}') WHERE NOT isnan(value)""",
    "expense_rows": ctes(*TRACKS) + "SELECT * FROM expenses",
    "income_rows": ctes(*TRACKS) + "SELECT * FROM incomes",
    "track_route": ctes(MERCHANT_ROWS, ORDER_LEDGER, *PREPARED) + f"SELECT o_orderkey, {BOTH_TRACKS} FROM prepared",
    "lineitem_tracks": ctes(*LINES, "ids AS (SELECT * FROM norm)", *PREPARED) + f"SELECT {BOTH_TRACKS} FROM prepared",
    "lineitem_txn_ids": ctes(*LINES, _keys("norm", "data"), _ids("k1")) + "SELECT txn_id, data FROM ids",
    "minor_units_of_orders": """SELECT o_orderkey, -CAST(floor(o_totalprice * 100.0::DOUBLE + 0.5) AS BIGINT) AS minor,
  CAST(floor(o_totalprice / 1000.0::DOUBLE * 100.0::DOUBLE + 0.5) AS BIGINT) AS minor_thousandth FROM orders""",
    "float_texts": """SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS plain,
  CAST(o_totalprice * 1e5::DOUBLE AS VARCHAR) AS "large", CAST(o_totalprice * 1e14::DOUBLE AS VARCHAR) AS huge,
  CAST(o_totalprice / 1e9::DOUBLE AS VARCHAR) AS small, CAST(-o_totalprice / 1e13::DOUBLE AS VARCHAR) AS tiny FROM orders""",
    "occurrence_index": ctes(*IDENTIFIED) + "SELECT event_id, occurrence FROM ids",
    "occurrence_index_sliced": ctes(*IDENTIFIED) + "SELECT event_id, occurrence FROM ids",
    "assign_txn_id": ctes(*IDENTIFIED) + "SELECT event_id, txn_id FROM ids",
    "id_collisions": ctes(*IDENTIFIED)
    + "SELECT count(*) FILTER (occurrence > 0) AS repeated_rows, count(*) AS rows FROM ids",
    "reimport_merge": ctes(*IMPORTS, MERGED)
    + "SELECT txn_id, CASE import_no WHEN 1 THEN 'first' ELSE 'second' END AS import_id, data FROM merged",
    "stream_reimport": ctes(*IMPORTS, MERGED, CLEANED.replace("FROM ids)", "FROM merged)"), LABELLED, KEPT)
    + f"SELECT * EXCLUDE (day, month, year) FROM (SELECT txn_id, {BOTH_TRACKS} FROM prepared)",
    "bucketed_merge": ctes(*IMPORTS, MERGED)
    + "SELECT txn_id, CASE import_no WHEN 1 THEN 'first' ELSE 'second' END AS import_id, data FROM merged",
    "stream_running_occurrence": ctes(*IDENTIFIED) + "SELECT event_id, occurrence FROM ids",
    "stream_collisions": ctes(*IDENTIFIED)
    + """SELECT count(*) FILTER (occurrence > 0) AS repeated_rows, count(*) AS rows,
       count(DISTINCT txn_id) AS distinct_ids FROM ids""",
    "stream_late_copies": ctes(*IDENTIFIED)
    + "SELECT txn_id, data FROM ids UNION ALL SELECT txn_id, data FROM ids WHERE event_id % 7 = 0",
    "split_segments": ctes(*EVENTS, *_locations("norm", "event_id", "data")[:1])
    + "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS INTEGER) AS pos, part FROM parts",
    "extract_location": ctes(*EVENTS, *_locations("norm", "event_id", "data"))
    + f"SELECT event_id, extracted_location, {_link('extracted_location')} AS google_maps_link FROM located",
    "extract_location_documents": ctes(*_locations("documents", "doc_id", "text"))
    + f"SELECT doc_id, extracted_location, {_link('extracted_location')} AS google_maps_link FROM located",
    "map_links": ctes(MERCHANT_ROWS, RAW)
    + f"SELECT event_id, data, {_link(stripped('data'))} AS link, {_quoted('data')} AS quoted FROM raw",
    "restored_names": ctes(MERCHANT_ROWS, RAW) + f"SELECT event_id, {_respelled('data')} AS restored FROM raw",
    "guarded_cells": ctes(MERCHANT_ROWS, RAW)
    + f"SELECT event_id, {_guarded_columns('amount', 'currency', 'description')} FROM raw",
    "sheets_expenses": ctes(*TRACKS, DISPLAY)
    + _sheet(
        "expenses",
        f"coalesce(d.category, {text(_DEFAULT_CATEGORY)})",
        f"coalesce(d.importance, {text(_DEFAULT_IMPORTANCE)})",
        "LEFT JOIN display d ON d.label = t.category",
    ),
    "sheets_income": ctes(*TRACKS) + _sheet("incomes", "t.category", "''"),
    "cleaned_expenses": ctes(*TRACKS)
    + f"SELECT day, month, year, {_guarded_columns('txn_id', 'category', 'amount')} FROM expenses",
    "cleaned_income": ctes(*TRACKS)
    + f"SELECT day, month, year, {_guarded_columns('txn_id', 'category', 'amount')} FROM incomes",
    "unassigned_expenses": ctes(
        *TRACKS,
        "opened AS (SELECT * FROM expenses WHERE contains(category, 'MISC'))",
        *_locations("opened", "txn_id", "data"),
        f"linked AS (SELECT *, {_link('extracted_location')} AS google_maps_link FROM located)",
    )
    + "SELECT day, month, year, "
    + _guarded_columns("txn_id", "amount", "category", "data", "extracted_location", "google_maps_link")
    + " FROM linked",
    "unassigned_income": ctes(*TRACKS)
    + f"SELECT day, month, year, {_guarded_columns('txn_id', 'amount', 'category', 'data')} FROM incomes "
    "WHERE category = 'INCOME_MISC'",
    "first_rows": ctes(*EVENTS)
    + f"SELECT event_id, txn_type, amount, data FROM norm ORDER BY event_id LIMIT {PREVIEW_ROWS}",
    "import_quality": ctes(
        *IMPORTS,
        f"""gated AS (SELECT CASE import_no WHEN 1 THEN 'first' ELSE 'second' END AS import_id, occurrence > 0 AS repeated,
         event_id % 17 = 0 AS undated, event_id % 13 = 3 AS unreadable,
         CASE WHEN event_id % 13 < 4 AND event_id % 13 > 0 THEN NULL WHEN event_id % 13 = 0 THEN NULL
              ELSE CAST(amount AS DOUBLE) END AS value,
         {replaced("CASE WHEN event_id % 19 = 0 THEN '' ELSE data END", DESCRIPTION_REPLACEMENTS)} AS data FROM ids)""",
        f"""tracked AS (SELECT *, CASE WHEN spending = '{REFUND_LABEL}' OR value IS NULL THEN 'none'
              WHEN value > 0 THEN 'income' ELSE 'expense' END AS track
         FROM (SELECT *, {EXPENSE_LABEL} AS spending, {INCOME_LABEL} AS earning FROM gated))""",
    )
    + f"""SELECT CASE grouping(import_id, track) WHEN 0 THEN 'track' WHEN 1 THEN 'import' ELSE 'all' END AS level,
       import_id, track, count(*) AS rows, count(*) FILTER (value IS NULL AND NOT unreadable) AS missing_amounts,
       count(*) FILTER (unreadable) AS unreadable_amounts, count(*) FILTER (spending = '{REFUND_LABEL}') AS refunds,
       count(*) FILTER (undated) AS undated, count(*) FILTER (data = '') AS without_text,
       count(*) FILTER (CASE track WHEN 'income' THEN earning = '{DEFAULT_INCOME}'
                        WHEN 'expense' THEN spending = '{DEFAULT_EXPENSE}' ELSE false END) AS unlabelled,
       count(*) FILTER (repeated) AS repeated_rows
  FROM tracked GROUP BY GROUPING SETS ((import_id, track), (import_id), ())""",
    "lint_part_names": """WITH named AS (
  SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS priority, p_brand AS label,
         unnest(list_append(string_split(lower(p_name), ' '), lower(p_name))) AS keyword FROM part
), best AS (
  SELECT keyword, arg_min(label, (priority, label)) AS label, min(priority) AS priority FROM named WHERE keyword <> '' GROUP BY keyword
)
SELECT a.keyword, a.label, arg_min(b.keyword, (b.priority, b.label, b.keyword)) AS by_keyword,
       arg_min(b.label, (b.priority, b.label, b.keyword)) AS by_label
FROM best a JOIN best b ON contains(a.keyword, b.keyword) AND a.keyword <> b.keyword AND b.priority < a.priority
GROUP BY a.keyword, a.label""",
    "track_without_ids": ctes(*EVENTS, "ids AS (SELECT *, '' AS txn_id FROM norm)", *PREPARED, EXPENSES, INCOMES)
    + "SELECT * FROM expenses UNION ALL SELECT * FROM incomes",
    "empty_ledger": ctes(*TRACKS)
    + "SELECT 'txn_id,day,month,year,category,amount' AS header, CAST(count(*) AS INTEGER) AS records FROM expenses WHERE year < 1900",
    "bank_csv_headers": ctes(
        MERCHANT_ROWS,
        RAW.replace("raw AS (", "source AS (", 1),
        """raw AS (SELECT * REPLACE (CAST(event_id AS VARCHAR) AS unnamed_8, nullif(unnamed_6, '') AS unnamed_6,
       nullif(data, '') AS data, nullif(nullif(description, 'nan'), '') AS description,
       nullif(txn_type, 'nan') AS txn_type) FROM source)""",
        NORM,
    )
    + "SELECT description, amount, data, day FROM norm",
    "processed_orders": ctes(*TRACKS, DISPLAY)
    + """SELECT CAST(month AS VARCHAR) AS month, CAST(year AS VARCHAR) AS year, e.category AS item, amount,
       d.category, d.importance FROM expenses e JOIN display d ON d.label = e.category""",
    "bank_csv_import": ctes(
        MERCHANT_ROWS,
        RAW.replace("raw AS (", "source AS (", 1),
        """raw AS (SELECT * REPLACE (CAST(event_id AS VARCHAR) AS unnamed_8, nullif(unnamed_6, '') AS unnamed_6,
       nullif(data, '') AS data, nullif(nullif(description, 'nan'), '') AS description,
       nullif(txn_type, 'nan') AS txn_type) FROM source)""",
        NORM,
    )
    + f"SELECT * EXCLUDE (event_id) REPLACE ({ISO_DATES}) FROM norm",
    "bank_csv_wrapped": ctes(
        MERCHANT_ROWS,
        RAW.replace("raw AS (", "source AS (", 1),
        """raw AS (SELECT * REPLACE (CAST(event_id AS VARCHAR) AS unnamed_8, nullif(unnamed_6, '') AS unnamed_6,
       nullif(data, '') AS data, nullif(txn_type, 'nan') AS txn_type,
       concat_ws(chr(10), description, 'second "line", quoted', '') AS description) FROM source)""",
        NORM,
    )
    + "SELECT description, amount, data FROM norm",
    "skipped_bank_records": ctes(MERCHANT_ROWS, RAW)
    + """SELECT '"' || concat_ws('","', booking_date, value_date, coalesce(txn_type, ''), amount, currency,
       coalesce(description, ''), unnamed_6, data, event_id) || '",extra' AS record FROM raw WHERE txn_type IS NULL""",
    "ledger_table": ctes(*TRACKS)
    + "SELECT *, 'expense' AS track FROM expenses UNION ALL SELECT *, 'income' AS track FROM incomes",
    "processed_readback": ctes(*TRACKS, DISPLAY)
    + """SELECT CAST(month AS VARCHAR) AS month, CAST(year AS VARCHAR) AS year, e.category AS item, amount,
       d.category, d.importance FROM expenses e JOIN display d ON d.label = e.category""",
}
