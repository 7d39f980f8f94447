import math
import random
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from tributary.operators import features, keys, orphans, rolling, skew

DAY = 86_400_000_000


def test_current_rows(spark):
    rows = [(1, 5, 1, "a", 0), (1, 5, 2, "b", 0), (1, None, 9, "c", 0), (2, 1, 1, "d", 0), (None, 1, 1, "e", 0), (None, 1, 2, "f", 0), (3, 7, 7, "g", 0), (3, 7, 7, "g", 0)]
    df = spark.createDataFrame(rows, "id bigint, at bigint, v bigint, x string, `__n` int")
    assert sorted(r.x for r in keys.current_rows(df, "id", ["at", "v"], "id", "x").collect()) == ["b", "d", "e", "f", "g"]


def test_clean_key(spark):
    df = spark.createDataFrame([("\t Ab ",), ("  ",), (None,)], "k string")
    assert [r[0] for r in df.select(keys.clean_key("k")).collect()] == ["ab", "", None]


def test_salted_totals(spark):
    rows = [("hot", 1.0, k) for k in range(3000)] + [(f"k{k}", float(k), k) for k in range(50)] + [(None, 2.0, None), (None, None, None), ("k1", math.nan, 1)]
    df = spark.createDataFrame(rows, "key string, amount double, id bigint")
    totals = skew.salted_totals(df, {"k": F.col("key"), "id": F.col("id").cast("string")}, "amount", ["id", "amount"]).collect()
    got = {r.key: (r.n_rows, r.n_amounts, r.total) for r in totals if r.field_name == "k"}
    assert sum(r.n_rows for r in totals if r.field_name == "id") == len(rows)
    assert got["hot"] == (3000, 3000, 3000.0) and got["k1"] == (2, 1, 1.0) and got[None] == (2, 1, 2.0) and len(got) == 52
    key = {"k": F.col("key")}
    assert [r.key for r in skew.frequent(skew.salted_totals(df, key, "amount", ["id"]), 0.02).collect()] == ["hot"]
    assert skew.salted_totals(df.limit(0), key, "amount", ["id"]).collect() == [] and skew.frequent(skew.salted_totals(df.limit(0), key, "amount", ["id"]), 0.02).collect() == []


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    at = lambda: None if rnd.random() < 0.05 else datetime(2024, 1, 1 + rnd.randint(0, 20))
    history = [(rnd.choice([None, *range(12)]), at(), k, rnd.random() < 0.3) for k in range(60)]
    child = [("c", k, rnd.choice([None, 7, 7, 7, *range(16)]), at()) for k in range(400)]
    kinds = {}
    for _, rid, ref, t in child:
        if ref is None:
            continue
        own = [h for h in history if h[0] == ref]
        if not own:
            kinds[rid] = "missing"
        elif t is not None and all(h[1] is not None for h in own) and all(h[1] > t for h in own):
            kinds[rid] = "late"
        elif t is not None:
            upto = sorted((h for h in own if h[1] is not None and h[1] <= t), key=lambda h: (h[1], h[2]))
            if upto and upto[-1][3]:
                kinds[rid] = "deleted"
    h = spark.createDataFrame(history, "key bigint, at timestamp_ntz, version bigint, gone boolean").selectExpr("*", "version AS day", "version AS until")
    c = spark.createDataFrame(child, "src string, row_id bigint, ref bigint, at timestamp_ntz").selectExpr("*", "src AS __salt", "src AS orphan_kind")
    found = orphans.orphans(c, h.select("key", "at"), orphans.deleted_spans(h))
    assert {r.row_id: r.orphan_kind for r in found.collect()} == kinds
    assert sum(r.n_rows for r in orphans.report(found).collect()) == len(kinds)
    assert orphans.orphans(c.limit(0), h.select("key", "at")).count() == 0
    assert {r.orphan_kind for r in orphans.orphans(c, h.limit(0).select("key", "at")).collect()} == {"missing"}


def test_feature_store_recomputes_changed_months_only(spark, tmp_path):
    jan, feb = features.month_start(2024 * 12), features.month_start(2024 * 12 + 1)
    rows = [("1", "a", jan + 5, 2.0), ("1", "a", feb + 7, 3.0), ("1", None, feb + 1, math.nan), ("2", "b", None, 4.0), (None, "a", jan, 9.0)]
    schema = "entity string, type string, at_us bigint, amount double"
    s = features.FeatureStore(spark, str(tmp_path / "f"))
    e = spark.createDataFrame(rows, schema)
    assert s.update(e) == [features.UNDATED, 2024 * 12, 2024 * 12 + 1] and s.update(e) == []
    got = {r.entity: r for r in s.features(e, feb + 10).collect()}
    assert got["1"].n == 3 and got["1"].total == 5.0 and [tuple(t) for t in got["1"].types] == [("", 1, 0, None, 9), ("a", 2, 2, 5.0, 3)]
    assert [tuple(t) for t in got["2"].types] == [("b", 1, 1, 4.0, None)]
    later = spark.createDataFrame([*rows, ("1", "a", feb + 9, 1.0)], schema)
    assert s.update(later) == [2024 * 12 + 1]
    got = {r.entity: r for r in s.features(later, feb + 8, jan + 6).collect()}  # both ends are inside months
    assert [tuple(t) for t in got["1"].types] == [("", 1, 0, None, 7), ("a", 1, 1, 3.0, 1)] and "2" not in got
    gone = spark.createDataFrame(rows[1:], schema)
    assert s.update(gone) == [2024 * 12 + 1] and {r.entity: r.n for r in s.features(gone, feb + 10).collect()} == {"1": 2, "2": 1}
    assert features.FeatureStore(spark, str(tmp_path / "g")).update(e.limit(0)) == []


@pytest.mark.parametrize("low, high", [(0, 0), (0, 63), (5, 41), (31, 32), (63, 63)])
def test_cover(low, high):
    def leaves(n):
        return {n - rolling.SHARD} if n >= rolling.SHARD else leaves(2 * n) | leaves(2 * n + 1)

    nodes = rolling.cover(low, high)
    assert set().union(*map(leaves, nodes)) == set(range(low, high + 1)) and len(nodes) <= 12


def test_rolling_against_brute_force_and_corrections(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, -3]), rnd.randint(-70, 400) * DAY + rnd.randint(0, DAY - 1), rnd.choice([1.5, -2.0, 10.25, None, math.nan, math.inf])) for _ in range(300)] + [(None, 5, 1.0), (1, None, 1.0)]

    def brute(rs):
        days = {}
        for e, t, a in rs:
            if e is not None and t is not None:
                d = days.setdefault(e, {}).setdefault(t // DAY, [0.0, 0])
                d[0] += a if a is not None and not math.isnan(a) else 0
                d[1] += 1
        return {(e, d): tuple(round(sum(m.get(x, (0, 0))[k] for x in range(d - p + 1, d + 1)), 6) for p in (7, 30) for k in (0, 1)) for e, m in days.items() for d in range(min(m), max(m) + 1)}

    def got(tree):
        return {(r.entity, r.day): (round(r.total_7d, 6), r.n_7d, round(r.total_30d, 6), r.n_30d) for r in rolling.trailing(tree).collect()}

    schema = "entity bigint, at_us bigint, amount double"
    tree = rolling.trees(rolling.daily(spark.createDataFrame(rows, schema)))
    assert got(tree) == brute(rows)
    late = [*rows, (1, 100 * DAY, 7.0), (2, 500 * DAY, 1.0)]
    new = rolling.daily(spark.createDataFrame(late, schema)).filter("(entity = 1 and day = 100) or (entity = 2 and day = 500)")
    fixed = rolling.correct(tree, new)
    assert fixed.count() == 2
    assert got(tree.join(fixed, ["entity", "shard"], "left_anti").unionByName(fixed)) == brute(late)
    assert got(tree.limit(0)) == {}


def test_rolling_keeps_text_entities_and_far_days(spark, monkeypatch):
    monkeypatch.setattr(rolling, "_BLOCK", 8)
    rows = [("a", -700_000 * DAY, 1.0), ("a", -699_000 * DAY, 2.0), ("b", 5 * DAY, 3.0), ("b", 6 * DAY, -math.inf), ("c", 5, None)]
    out = rolling.trailing(rolling.trees(rolling.daily(spark.createDataFrame(rows, "entity string, at_us bigint, amount double")))).collect()
    by = {(r.entity, r.day): r for r in out}
    assert len(out) == 1001 + 2 + 1 and by["a", -699_000].total_30d == 2.0 and by["a", -699_971].total_30d == 1.0 and by["a", -699_970].total_30d == 0.0
    assert by["b", 6].total_7d == -math.inf and by["b", 5].avg_7d == 3.0 / 7 and by["c", 0].n_7d == 1 and by["c", 0].total_7d == 0.0


def test_feature_store_takes_named_months_only(spark, tmp_path):
    jan, feb, mar = (features.month_start(2024 * 12 + k) for k in range(3))
    schema = "entity string, type string, at_us bigint, amount double"
    s = features.FeatureStore(spark, str(tmp_path / "f"))
    s.update(spark.createDataFrame([("1", "a", jan, 1.0), ("1", "a", feb, 2.0)], schema))
    assert s.update(spark.createDataFrame([("1", "a", feb, 2.0), ("2", "a", mar, 4.0)], schema), only=[2024 * 12 + 1, 2024 * 12 + 2]) == [2024 * 12 + 2]
    assert {r.entity: r.total for r in s.features(spark.createDataFrame([], schema), mar).collect()} == {"1": 3.0, "2": 4.0}
    s.update(spark.createDataFrame([], schema), only=[2024 * 12])
    assert s.vacuum() and {r.entity: r.total for r in s.features(spark.createDataFrame([], schema), mar).collect()} == {"1": 2.0, "2": 4.0}
