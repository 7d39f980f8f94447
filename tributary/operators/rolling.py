"""Rolling totals over trailing periods from segment trees (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.keys import day_of

#: Days per time shard, a power of two of at least the longest period.
SHARD = 64
_NODES = "shard int, node array<smallint>, total array<double>, n array<bigint>"
#: (entity, shard) rows that are answered at once; an entity with more of them is answered in stretches of its time.
_BLOCK = 4096


def cover(low: int, high: int) -> list[int]:
    """Nodes of a shard's tree (1 the root, SHARD + d the leaf of day d) whose leaves are the days low to high."""
    out, a, b = [], low + SHARD, high + SHARD + 1
    while a < b:
        if a & 1:
            out.append(a)
            a += 1
        if b & 1:
            b -= 1
            out.append(b)
        a >>= 1
        b >>= 1
    return out


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of each element of a list column."""
    n = np.diff(a.offsets.to_numpy())
    return np.repeat(np.arange(len(a)), n), a.flatten().to_numpy(zero_copy_only=False)


def _raise(trees: np.ndarray, row: np.ndarray, day: np.ndarray) -> None:
    """Recompute the ancestors of the leaves (row, day), level by level, each as the sum of its two children; no other node is touched."""
    node = day + SHARD
    while len(node) and node[0] > 1:
        row, node = np.unique(np.stack([row, node >> 1]), axis=1)
        trees[row, node] = trees[row, 2 * node] + trees[row, 2 * node + 1]


def _sparse(entity: pa.Array, shard: pa.Array, totals: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    row, node = np.nonzero(counts)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(node, pa.int16()), pa.array(totals[row, node]), pa.array(counts[row, node], pa.int64()))]
    return pa.RecordBatch.from_arrays([entity, shard, *lists], names=["entity", "shard", "node", "total", "n"])


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of (entity, shard, day[], total[], n[], node[], was_total[], was_n[]): the leaves named by day replace those of the tree before."""
    for whole in batches:
        for k in range(0, whole.num_rows, 4096):
            b = whole.slice(k, 4096)
            totals, counts = np.zeros((b.num_rows, 2 * SHARD)), np.zeros((b.num_rows, 2 * SHARD), np.int64)
            row, node = _lists(b.column("node"))
            totals[row, node], counts[row, node] = _lists(b.column("was_total"))[1], _lists(b.column("was_n"))[1]
            row, day = _lists(b.column("day"))
            day = day.astype(int)
            totals[row, day + SHARD], counts[row, day + SHARD] = _lists(b.column("total"))[1], _lists(b.column("n"))[1]
            for t in (totals, counts):
                _raise(t, row, day)
            yield _sparse(b.column("entity"), b.column("shard"), totals, counts)


def daily(rows: DataFrame) -> DataFrame:
    """(entity, day, total, n) of ``rows`` (entity, at_us, amount): per UTC day since 1970 the sum of the amounts that are numbers, and the rows.

    Rows without an entity or a moment belong to no day and are left out; null and NaN amounts count as rows only. Infinite amounts are summed like others.
    Entities keep their type, text ones too.
    """
    value = F.when(~F.isnan("amount"), F.col("amount"))
    per = rows.filter(F.col("entity").isNotNull() & F.col("at_us").isNotNull()).groupBy("entity", day_of("at_us").alias("day"))
    return per.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n"))


def _leaves(days: DataFrame) -> DataFrame:
    shard = F.shiftright("day", SHARD.bit_length() - 1)
    own = F.struct(F.col("day").bitwiseAND(F.lit(SHARD - 1)).cast("smallint").alias("day"), "total", "n")
    per = days.groupBy("entity", shard.alias("shard")).agg(F.collect_list(own).alias("d"))
    return per.select("entity", "shard", F.col("d.day").alias("day"), F.col("d.total").alias("total"), F.col("d.n").alias("n"))


def trees(days: DataFrame) -> DataFrame:
    """Segment trees of ``days`` (entity, day, total, n): per entity and shard the nodes with activity below them and their sums and counts."""
    none = [F.array().cast(f"array<{t}>").alias(n) for n, t in (("node", "smallint"), ("was_total", "double"), ("was_n", "bigint"))]
    return _leaves(days).select("*", *none).mapInArrow(_grow, _tree(days))


def _tree(df: DataFrame) -> str:
    return f"entity {df.schema['entity'].dataType.simpleString()}, {_NODES}"


def correct(tree: DataFrame, days: DataFrame) -> DataFrame:
    """The trees after late corrections: ``days`` has the new total and n of each changed (entity, day), n = 0 for a day that lost all its rows.

    Only the (entity, shard) rows that ``days`` names come out, with the changed leaves and their ancestors recomputed; all other rows stay as stored.
    """
    old = tree.select("entity", "shard", "node", F.col("total").alias("was_total"), F.col("n").alias("was_n"))
    j = _leaves(days).join(old, ["entity", "shard"], "left")
    fill = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("node", "array<smallint>"), ("was_total", "array<double>"), ("was_n", "array<bigint>"))]
    return j.select("entity", "shard", "day", "total", "n", *fill).mapInArrow(_grow, _tree(days))


def corrected(tree: DataFrame, days: DataFrame) -> DataFrame:
    """All trees after the corrections ``days``: the rows of ``correct`` in place of those of the same (entity, shard)."""
    return tree.join(days.select("entity", F.shiftright("day", SHARD.bit_length() - 1).alias("shard")).distinct(), ["entity", "shard"], "left_anti").unionByName(correct(tree, days))


def _answers(periods: tuple[int, ...]):
    plan = [[(cover(max(0, o - p + 1), o), cover(SHARD + o - p + 1, SHARD - 1) if o - p + 1 < 0 else []) for o in range(SHARD)] for p in periods]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from answer(b)

    def answer(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = b.column("t")  # per entity its shards: list<struct<shard, node, total, n>>
        flat, sizes = t.flatten(), np.diff(t.offsets.to_numpy())
        if not len(flat):
            return
        who = np.repeat(np.arange(len(t)), sizes)
        shard = flat.field("shard").to_numpy(zero_copy_only=False).astype(np.int64)
        (run_of, node), total, n = _lists(flat.field("node")), _lists(flat.field("total"))[1], _lists(flat.field("n"))[1]
        node = node.astype(np.int64)
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        first, last = np.full(len(t), most), np.full(len(t), least)
        leaf = node >= SHARD
        day, of = shard[run_of[leaf]] * SHARD + node[leaf] - SHARD, who[run_of[leaf]]
        np.minimum.at(first, of, day)
        np.maximum.at(last, of, day)
        some = first <= last
        low, high = np.where(some, first, 0) >> SHARD.bit_length() - 1, np.where(some, last, -1) >> SHARD.bit_length() - 1
        start = np.concatenate([[0], np.cumsum(high - low + 1)])
        row = start[who] + shard - low[who]  # one row per entity and shard from its first to its last
        inside = some[who] & (shard >= low[who]) & (shard <= high[who])
        keep = inside[run_of]
        at, node, total, n = row[run_of][keep], node[keep], total[keep], n[keep]
        by = np.argsort(at, kind="stable")
        at, node, total, n = at[by], node[by], total[by], n[by]
        for r0 in range(0, int(start[-1]), _BLOCK):
            r1 = min(r0 + _BLOCK, int(start[-1]))
            k0, k1 = np.searchsorted(at, r0 - 1), np.searchsorted(at, r1)
            totals, counts = np.zeros((2 * SHARD, r1 - r0 + 1)), np.zeros((2 * SHARD, r1 - r0 + 1), np.int64)
            totals[node[k0:k1], at[k0:k1] - r0 + 1], counts[node[k0:k1], at[k0:k1] - r0 + 1] = total[k0:k1], n[k0:k1]
            rows = np.arange(r0, r1)
            owner = np.searchsorted(start, rows, side="right") - 1
            days = (((low[owner] + rows - start[owner]) * SHARD)[:, None] + np.arange(SHARD)).T
            shown = ((days >= first[owner]) & (days <= last[owner])).T
            opens = rows == start[owner]
            cols, names = [b.column("entity").take(pa.array(np.broadcast_to(owner[:, None], shown.shape)[shown])), pa.array(days.T[shown].astype(np.int32))], ["entity", "day"]
            for p, nodes in zip(periods, plan):
                for what, source in (("total", totals), ("n", counts)):
                    out = np.zeros((SHARD, r1 - r0), source.dtype)
                    for o, (own, before) in enumerate(nodes):
                        for x in own:
                            out[o] += source[x, 1:]
                        for x in before:
                            out[o] += np.where(opens, 0, source[x, :-1])
                    cols.append(pa.array(out.T[shown]))
                    names.append(f"{what}_{p}d")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def trailing(tree: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity, day, and per period p: total_pd, avg_pd, n_pd): one row per entity and day from its first to its last day with a row, days without included.

    total_pd and n_pd cover the p days that end with the day, avg_pd is total_pd / p. Each is a range query answered from the O(log p) nodes that cover the
    period in the day's shard and the one before. An entity's shards, which the calendar bounds and not its rows, meet in one row; a hot entity costs no more
    than any other, and what is held at once is bounded by _BLOCK however far apart an entity's days are. An empty table gives no rows.
    """
    assert all(1 <= p <= SHARD for p in periods)
    per = tree.groupBy("entity").agg(F.collect_list(F.struct("shard", "node", "total", "n")).alias("t"))
    cols = ", ".join(f"total_{p}d double, n_{p}d bigint" for p in periods)
    out = per.mapInArrow(_answers(tuple(periods)), f"entity {tree.schema['entity'].dataType.simpleString()}, day int, {cols}")
    return out.select("entity", "day", *[c for p in periods for c in (F.col(f"total_{p}d"), (F.col(f"total_{p}d") / F.lit(p)).alias(f"avg_{p}d"), F.col(f"n_{p}d"))])
