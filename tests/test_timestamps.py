import itertools
import random
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.operators import timestamps as ts


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize("value, zone, order, want", [
    ("2024-03-10T02:30:00", "America/New_York", "mdy", "2024-03-10T07:30:00"),  # skipped: moves on by the gap
    ("2024-11-03T01:30:00", "America/New_York", "mdy", "2024-11-03T05:30:00"),  # twice: the first
    ("03/04/2024 10:00", "UTC", "dmy", "2024-04-03T10:00:00"),
    ("03/04/2024 10:00", "UTC", "mdy", "2024-03-04T10:00:00"),
    ("03.04.2024 10:00", "UTC", "mdy", "2024-04-03T10:00:00"),
    ("2024/03/04 10:00", "Asia/Tokyo", "ymd", "2024-03-04T01:00:00"),
    ("  2024-03-04t10:00:00.123456789Z\t", None, None, "2024-03-04T10:00:00.123456"),
    ("2024-03-04T10:00:00+05:30[Europe/Berlin]", None, None, "2024-03-04T04:30:00"),
    ("2024-06-17 20:30:29 BST", "Asia/Tokyo", None, "2024-06-17T19:30:29"),
    ("Jul 19, 2025 6:07:42 PM EDT", None, None, "2025-07-19T22:07:42"),
    ("Sun, 30 Apr 2023 06:28:54 +0530", None, None, "2023-04-30T00:58:54"),
    ("1684510018", "Asia/Tokyo", None, "2023-05-19T15:26:58"),
    ("1680277862000", None, None, "2023-03-31T15:51:02"),
    ("1680713637000001", None, None, "2023-04-05T16:53:57.000001"),
    ("1690160833.1669999", None, None, "2023-07-24T01:07:13.166999"),
    ("20230609", "Europe/Berlin", None, "2023-06-08T22:00:00"),
    ("20230404025244", "UTC", None, "2023-04-04T02:52:44"),
    ("20230620T170358Z", None, None, "2023-06-20T17:03:58"),
    ("2023-05-26T00:46:53 australia/sydney", None, None, "2023-05-25T14:46:53"),
    ("13 January 2026 18:47", "UTC", None, "2026-01-13T18:47:00"),
    ("12/31/2024 12:05 am", "UTC", "mdy", "2024-12-31T00:05:00"),
])
def test_reading(value, zone, order, want):
    assert ts.interpretations(value, zone, order)[0][0] == us(want)


@pytest.mark.parametrize("value", [None, "", "  ", "2025-02-30 10:15:00", "2025-13-04T08:00:00Z", "25:61", "31/11/2025 09:00", "n/a", "yesterday", "0000-00-00 00:00:00", "99999999", "2024-01-01 24:00:00", "x" * 10_000])
def test_unreadable(value):
    assert ts.interpretations(value, "UTC", "dmy") == []


def test_undeclared_order_has_both():
    assert len(ts.interpretations("03/04/2024", "UTC", None)) == 2 and len(ts.interpretations("13/04/2024", "UTC", None)) == 1


def _brute(rows):
    best = None
    for pick in itertools.product(*[range(len(t)) for t, _, _ in rows]):
        cost = sum(r[2][k] for r, k in zip(rows, pick))
        for (a, i), (b, j) in itertools.pairwise(zip(rows, pick)):
            cost += ts.BACK_COST * (b[0][j] < a[0][i] - ts.BACK_US) + ts.SWITCH_COST * (b[1][j] != a[1][i])
        if best is None or cost < best[0] - 1e-6:
            best = (cost, pick)
    return best[0]


def test_viterbi_is_exact():
    rnd, day = random.Random(5), ts.BACK_US
    for _ in range(60):
        rows = []
        for k in range(rnd.randint(1, 8)):
            n = rnd.randint(1, 3)
            rows.append(([rnd.randint(0, 9) * day for _ in range(n)], [rnd.randint(0, 2) for _ in range(n)], [rnd.choice([0.0, 0.5, 2.0]) for _ in range(n)]))
        k = max(len(r[0]) for r in rows)
        t, f, c = np.zeros((len(rows), k), np.int64), np.full((len(rows), k), -1, np.int32), np.full((len(rows), k), np.inf, np.float32)
        for i, r in enumerate(rows):
            t[i, : len(r[0])], f[i, : len(r[0])], c[i, : len(r[0])] = r
        m = np.full((len(rows), k, k), np.inf, np.float32)
        m[:, np.arange(k), np.arange(k)] = c
        levels = ts._levels(ts._Items(t, f, t, f, m))
        top = levels[-1].m[0]
        assert abs(float(top.min()) - _brute(rows)) < 1e-4
        en, ex = ts._descend(levels, *divmod(int(top.argmin()), k))
        assert (en == ex).all()
        cost = sum(c[i, e] for i, e in enumerate(en))
        for i in range(1, len(rows)):
            cost += ts.BACK_COST * (t[i, en[i]] < t[i - 1, en[i - 1]] - day) + ts.SWITCH_COST * (f[i, en[i]] != f[i - 1, en[i - 1]])
        assert abs(cost - float(top.min())) < 1e-4


def _readings(spark, rows):
    return spark.createDataFrame(rows, "src string, feed string, row_id bigint, v string, z string, o string")


def _normal(spark, rows):
    from pyspark.sql import functions as F

    c = ts.candidates(_readings(spark, rows), "v", "z", "o", F.col("src"), F.col("feed"), F.col("row_id"))
    return {(r.src, r.row_id): r.utc_us for r in ts.normalise(c).collect()}


def test_neighbours_decide_where_nothing_is_declared(spark, monkeypatch):
    monkeypatch.setattr(ts, "BITS", 2)
    days = ["25/04/2024", "26/04/2024", "27/04/2024", "03/05/2024", "04/05/2024", "13/05/2024", "05/06/2024", "17/06/2024"]
    got = _normal(spark, [("a", None, 1000 + 3 * k, v, None, None) for k, v in enumerate(days)])
    assert [got["a", 1000 + 3 * k] for k in range(len(days))] == [us("-".join(reversed(v.split("/")))) for v in days]


def test_nulls_and_empty(spark):
    got = _normal(spark, [("a", "f", None, "2024-01-02", "UTC", "dmy"), ("a", "f", 1, None, "UTC", "dmy"), (None, None, 2, "2024-01-03", None, None), ("a", "f", 3, "??", "UTC", None)])
    assert got == {("a", None): us("2024-01-02"), (None, 2): us("2024-01-03")}
    assert _normal(spark, []) == {}


PIECES = ["2024-03-31", "31/03/2024", "3/4/2024", "03.04.2024", "20240331", "1711846800", "1711846800123.5", "31 Mar 2024", "Mar 31st, 2024", "Sun, 31 Mar 2024", "2024/10/27", "9999-99-99", "0000-01-01", "29/02/2023", "13/13/2024"]
CLOCKS = ["", " 02:30", "T02:30:15", " 2:30 pm", " 02:30:15.1234567", "T023015", " 25:00", " 12:00am", "T02:30:15,5", "  at 02:30"]
PLACES = ["", "Z", " UTC", "+02:00", "-0530", " +01", " CEST", "[Europe/Berlin]", " America/New_York", " xyz", "+19:00", " bst", "+02:00[Europe/Berlin]", "+02:00 nowhere"]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from(CLOCKS), st.sampled_from(PLACES), st.sampled_from(["Europe/Berlin", "UTC", "Asia/Kolkata", "nowhere", None]), st.sampled_from(["dmy", "mdy", "ymd", None])), min_size=1, max_size=40))
def test_columns_read_like_single_values(rows):
    values = [a + b + c for a, b, c, _, _ in rows] + [None, "", "  ", "é", "x 9" * 5000, "2024-01-02 03:04:05." + "7" * 300, " 2024-01-02\t03:04 ", "٢٠٢٤-01-02"]
    zones, orders = [r[3] for r in rows] + ["UTC"] * 8, [r[4] for r in rows] + ["dmy"] * 8
    ends, (t, f, c) = ts._read(*(pa.array(x, pa.string()) for x in (values, zones, orders))).lists()
    got = [list(zip(t[a:b].tolist(), f[a:b].tolist(), c[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
    assert got == [ts.interpretations(*x) for x in zip(values, zones, orders)]


def test_repeated_row_ids_have_no_place(spark, monkeypatch):
    monkeypatch.setattr(ts, "BITS", 2)
    rows = [("s", "f", 1, "01/02/2024")] * 9 + [("s", "f", k, "25/02/2024") for k in range(4, 8)] + [("s", "f", None, "2024-02-01")]
    df = spark.createDataFrame(rows, "src string, feed string, row_id bigint, v string")
    c = ts.candidates(df, "v", F.lit("UTC"), F.lit(None).cast("string"), F.col("src"), F.col("feed"), F.col("row_id"))
    got = ts.normalise(c).collect()
    assert len(got) == 14 and len({r.utc_us for r in got if r.row_id == 1}) == 1
    assert ts.normalise(c.limit(0)).count() == 0


def test_neighbours_decide_without_a_declaration(spark):
    rows = [("s", "f", k, f"{d:02d}/03/2024 10:00") for k, d in enumerate([14, 15, 3, 16, 4, 17])] + [("s", "g", k, f"03/{d:02d}/2024 10:00") for k, d in enumerate([14, 15, 3, 16])]
    df = spark.createDataFrame(rows, "src string, feed string, row_id bigint, v string")
    c = ts.candidates(df, "v", F.lit("UTC"), F.lit(None).cast("string"), F.col("src"), F.col("feed"), F.col("row_id"))
    got = ts.normalise(c).withColumn("at", F.timestamp_micros("utc_us")).filter("month(at) = 3").count()
    assert got == len(rows)


def test_neighbours_decide_for_repeated_row_ids_at_any_number(spark, monkeypatch):
    monkeypatch.setattr(ts, "BITS", 2)
    rows = []
    for n in (1, 3, 4, 5, 17, 300):
        rows += [(f"s{n}", "f", 8, "03/25/2024"), *[(f"s{n}", "f", 9, "03/04/2024")] * n, (f"s{n}", "f", 10, "03/26/2024"), (f"s{n}", "f", 500, "03/27/2024")]
    rows += [(None, "f", r, v) for _, _, r, v in rows[-303:]]
    df = spark.createDataFrame(rows, "src string, feed string, row_id bigint, v string")
    c = ts.candidates(df, "v", F.lit("UTC"), F.lit(None).cast("string"), F.col("src"), F.col("feed"), F.col("row_id"))
    got = {(r.src, r.utc_us): r["count"] for r in ts.normalise(c).filter("row_id = 9").groupBy("src", "utc_us").count().collect()}
    assert got == {**{(f"s{n}", us("2024-03-04")): n for n in (1, 3, 4, 5, 17, 300)}, (None, us("2024-03-04")): 300}


def test_repeated_row_ids_are_chosen_exactly(spark, monkeypatch):
    monkeypatch.setattr(ts, "BITS", 1)
    rnd, day, rows = random.Random(7), ts.BACK_US, []
    for src in range(40):
        for _ in range(rnd.randint(1, 8)):
            n = rnd.randint(1, 3)
            rows.append((str(src), "f", rnd.choice([2, 2, 2, 3, 9]), rnd.sample(range(0, 9 * day, day), n), [rnd.randint(0, 2) for _ in range(n)], [rnd.choice([0.0, 0.5, 2.0]) for _ in range(n)]))
    got = {}
    for r in ts.normalise(spark.createDataFrame(rows, "src string, feed string, row_id bigint, t array<bigint>, f array<int>, c array<float>")).collect():
        got.setdefault(r.src, []).append((r.row_id, r.utc_us))
    for src in map(str, range(40)):
        mine = sorted(x[2:] for x in rows if x[0] == src)
        by_cost = {}
        for pick in itertools.product(*[range(len(x[1])) for x in mine]):
            at = [(x[1][k], x[2][k]) for x, k in zip(mine, pick)]
            cost = sum(x[3][k] for x, k in zip(mine, pick)) + sum(ts.BACK_COST * (b[0] < a[0] - day) + ts.SWITCH_COST * (b[1] != a[1]) for a, b in itertools.pairwise(at))
            by_cost.setdefault(round(cost, 3), []).append(sorted((x[0], a[0]) for x, a in zip(mine, at)))
        assert sorted(got[src]) in by_cost[min(by_cost)]
