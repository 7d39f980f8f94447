import math
import random

from tributary.llm import percentiles as pc
from tributary.llm import topn


def test_top_n_against_brute_force(spark):
    rnd = random.Random(1)
    score = lambda: rnd.choice([None, math.nan, -5.0, 0.0, -0.0, 1.0, 2.0, rnd.random() * 9])
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", f"g{rnd.randint(0, 40)}", None]), score(), k, k % 3) for k in range(1500)]
    df = spark.createDataFrame(rows, "grp string, score double, tie bigint, __band int").selectExpr("*", "__band AS rank_no", "__band AS __have")
    want = set()
    for g in {r[0] for r in rows} - {None}:
        own = sorted((r for r in rows if r[0] == g and r[1] is not None and not math.isnan(r[1])), key=lambda r: (-r[1], r[2]))[:5]
        want |= {(g, r[2], k + 1) for k, r in enumerate(own)}
    for edges in ([], [8.0, 1.0], [100.0], [-100.0]):
        assert {(r.grp, r.tie, r.rank_no) for r in topn.top_n(df, 5, ["grp", "tie"], edges).collect()} == want
    assert topn.top_n(df.limit(0), 5, ["grp", "tie"], [1.0]).collect() == []
    assert topn.band_edges(df.limit(0), "score") == []


def test_top_n_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([("a", float(k), k) for k in range(50)] + [("b", 1.0, 1)], "grp string, score double, tie bigint")
    got = topn.top_n(df, 5, ["grp", "tie"], [40.0, 20.0]).collect()
    assert sorted((r.grp, r.tie, r.rank_no) for r in got) == [("a", 45, 5), ("a", 46, 4), ("a", 47, 3), ("a", 48, 2), ("a", 49, 1), ("b", 1, 1)]


def _brute(vals, bp):
    v = sorted(vals)
    return v[max(1, (bp * len(v) + 9999) // 10000) - 1]


def test_percentiles_are_exact_and_pieces_combine(spark, monkeypatch):
    monkeypatch.setattr(pc, "PARTS", 4)
    rnd = random.Random(2)
    big = [1.7e308, -1.7e308, 5e-324, 0.0, -0.0, 1e-12, 3.0, math.nextafter(3.0, 4)]
    rows = [(rnd.choice(["x", "x", None, "y"]), rnd.choice([None, math.nan, math.inf, *big, rnd.lognormvariate(2, 3), rnd.randint(-5, 5) * 1.0])) for _ in range(900)]
    points = {"p50": 5000, "p90": 9000, "p99": 9900, "p0": 0, "p100": 10000}
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(min(v, 1.7976931348623157e308))
    parts = [pc.piece(spark.createDataFrame(rows[k::3], "grp string, value double")) for k in range(3)]
    got = {r.grp: r for r in pc.percentiles(pc.merge(*parts), points).collect()}
    assert set(got) == set(groups)
    for g, vals in groups.items():
        assert got[g].n == len(vals)
        for p, bp in points.items():
            assert got[g][p] == _brute(vals, bp), (g, p)
    assert pc.percentiles(parts[0].limit(0), points).collect() == []
