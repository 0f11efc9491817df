import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusloom.operators import parse_errors as P
from tests.conftest import rows

SCHEMA = "line_id bigint, dataset string, source_record string, raw_text string, delimiter string, width int"  # last two clash with inner names
GOOD = "1;hello;2024-02-29 10:00:00"


def lines(spark, *items):
    return spark.createDataFrame([(k, ds, f"m:{k}", t, "x", 9) for k, (ds, t) in enumerate(items)], SCHEMA)


def reasons(spark, *items):
    return {k: r for k, r in rows(P.errors(lines(spark, *items)).select("line_id", "reason"))}


def test_first_reason_applies(spark):
    got = reasons(
        spark,
        ("bosphor_sms", GOOD),
        ("bosphor_sms", '1;"a;b ""c""\nd";2024-01-01 00:00:00'),
        ("bosphor_sms", '3;"a"b;2024-01-01'),
        ("bosphor_sms", "1;a"),
        ("bosphor_sms", "3;a;2024-01-01 00:00:00"),
        ("bosphor_sms", "1;a;2023-02-29 00:00:00"),
        ("bosphor_sms", "1; ;2024-01-01 00:00:00"),
        ("bosphor_sms", "1;a\nb;2024-01-01 00:00:00"),
        ("bosphor_sms", '1;"a;2024-01-01 00:00:00'),
        ("bosphor_sms", None),
        ("elsewhere", GOOD),
        ("bosphor_sms", ""),
    )
    assert got == {2: "quoting", 3: "column_count", 4: "invalid_value", 5: "invalid_value", 6: "invalid_value", 7: "quoting", 8: "quoting", 9: "column_count", 10: "column_count", 11: "column_count"}


def test_campus_values(spark):
    head = "u1,{},2024-01-01 00:00:00,{},,{},{},hi"
    ok = [("1", "in", "2", " HAM "), ("007", "out", "1", "Spam")]
    bad = [("0", "in", "1", "ham"), ("1", "IN", "1", "ham"), ("1.0", "in", "1", "ham"), ("1", "in", "-1", "ham"), ("1", "in", "1", "eggs")]
    got = reasons(spark, *(("campus_sms", head.format(*x)) for x in ok + bad))
    assert got == {k: "invalid_value" for k in range(len(ok), len(ok) + len(bad))}


def test_records_and_long_text(spark):
    long = '"' + 'a;""' * 60_000 + '"'
    df = lines(spark, ("bosphor_sms", f"2;{long};2024-01-01 00:00:00"), ("bosphor_sms", "bad"), ("bosphor_sms", GOOD))
    got = rows(P.records(df, "bosphor_sms").selectExpr("line_id", "`group`", "length(message)"))
    assert got == [(0, "2", 3 * 60_000), (2, "1", 5)]


def test_empty_table(spark):
    df = lines(spark, ("bosphor_sms", GOOD)).limit(0)
    assert rows(P.errors(df)) == [] and rows(P.records(df, "tube_comments")) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='ab",;\n\x01', max_size=6), min_size=3, max_size=3), min_size=1, max_size=30))
def test_round_trip_of_written_rows(spark, table):
    def line(row):
        out = io.StringIO()
        csv.writer(out, delimiter=";", lineterminator="").writerow(row)
        return out.getvalue()

    df = lines(spark, *(("bosphor_sms", line(r)) for r in table))
    got = P._with_format(df, P.FORMATS).selectExpr("line_id", "cells").collect()
    cells = {r["line_id"]: [c[1:-1].replace('""', '"') if c.startswith('"') else c for c in r["cells"]] for r in got}
    assert cells == dict(enumerate(table))
    assert all(r != "quoting" for r in reasons(spark, *(("bosphor_sms", line(r)) for r in table)).values())
