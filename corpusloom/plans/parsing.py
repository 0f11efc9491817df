"""Queries of the parse-failure operator."""

from __future__ import annotations

from corpusloom.operators import parse_errors
from corpusloom.runtime import table


def p4_found(spark, d):
    return parse_errors.errors(table(spark, d, "external_raw")).select("line_id", "reason")


def p4_campus_records(spark, d):
    return parse_errors.records(table(spark, d, "external_raw"), "campus_sms")


def p4_bosphor_records(spark, d):
    return parse_errors.records(table(spark, d, "external_raw"), "bosphor_sms")


def p4_tube_records(spark, d):
    return parse_errors.records(table(spark, d, "external_raw"), "tube_comments")


QUERIES = {f.__name__: f for f in (p4_found, p4_campus_records, p4_bosphor_records, p4_tube_records)}

_CELL = lambda x: rf'''("([^"]|"")*"|[^"{x}\n\r]*)'''
_GOOD = lambda x: rf"^{_CELL(x)}({x}{_CELL(x)})*$"
_GOOD_SQL = f"""regexp_full_match(raw_text, CASE dataset WHEN 'bosphor_sms' THEN '{_GOOD(";")[1:-1]}' ELSE '{_GOOD(",")[1:-1]}' END)"""
_LINES = """lines AS (SELECT line_id, dataset, source_record, raw_text, CASE dataset WHEN 'bosphor_sms' THEN ';' ELSE ',' END AS delim,
    CASE dataset WHEN 'campus_sms' THEN 8 WHEN 'bosphor_sms' THEN 3 WHEN 'tube_comments' THEN 5 END AS width FROM external_raw)"""
_CELLS = """cut AS (SELECT *, list_transform(regexp_extract_all(delim || raw_text, CASE delim WHEN ';' THEN '(?s);("(?:[^"]|"")*"|[^;]*)' ELSE '(?s),("(?:[^"]|"")*"|[^,]*)' END, 1),
    lambda c: CASE WHEN c[1] = '"' THEN replace(c[2:-2], '""', '"') ELSE c END) AS c FROM lines)"""
_POSITIVE = lambda x: f"(regexp_full_match({x}, '[0-9]+') AND regexp_matches({x}, '[1-9]'))"
_MOMENT = lambda x: rf"(regexp_full_match({x}, '\d\d\d\d-\d\d-\d\d \d\d:\d\d:\d\d') AND try_strptime({x}, '%Y-%m-%d %H:%M:%S') IS NOT NULL)"
_FILLED = lambda x: rf"regexp_matches({x}, '[^\s\pZ]')"
_VALID = f"""CASE dataset WHEN 'campus_sms' THEN {_FILLED("c[1]")} AND {_POSITIVE("c[2]")} AND {_MOMENT("c[3]")} AND c[4] IN ('in', 'out') AND {_POSITIVE("c[6]")} AND lower(trim(c[7])) IN ('ham', 'spam') AND {_FILLED("c[8]")}
    WHEN 'bosphor_sms' THEN c[1] IN ('1', '2') AND {_FILLED("c[2]")} AND {_MOMENT("c[3]")}
    ELSE {_FILLED("c[1]")} AND {_MOMENT("c[3]")} AND {_FILLED("c[4]")} AND c[5] IN ('0', '1') END"""
_REASON = f"""judged AS (SELECT *, CASE WHEN raw_text IS NULL OR width IS NULL THEN 'column_count' WHEN NOT {_GOOD_SQL} THEN 'quoting' WHEN len(c) <> width THEN 'column_count' WHEN NOT ({_VALID}) THEN 'invalid_value' END AS reason FROM cut)"""
_WITH = f"WITH {_LINES}, {_CELLS}, {_REASON}"
_RECORD = lambda ds, cols: f"{_WITH} SELECT line_id, source_record, {', '.join(f'lower(trim(c[{i}])) AS {n}' if n == 'label' else f'c[{i}] AS {n}' for i, n in enumerate(cols, 1))} FROM judged WHERE reason IS NULL AND dataset = '{ds}'"

SQL = {
    "p4_found": f"{_WITH} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_campus_records": _RECORD("campus_sms", ["user", "seq", "sent_at", "direction", "network", "n_parts", "label", "message"]),
    "p4_bosphor_records": _RECORD("bosphor_sms", ["group", "message", "sent_at"]).replace("AS group", 'AS "group"'),
    "p4_tube_records": _RECORD("tube_comments", ["comment_id", "author", "sent_at", "content", "class"]),
}
