"""Structured queries to DataFrames: joins over the relationship graph, fan-out checks, several facts at one grain, row-level predicates, metrics, roll-ups."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.plans.sqltext import Token, render, tokens
from tributary.semantic.model import COARSER, GRAINS, Catalog, Dimension, Filter, Measure, Metric, Model, Query, SemanticError, derived_tokens, substitute_tokens

Resolve = Callable[[str], DataFrame]
_PARAM = re.compile(r"\$\{param:([\w.-]+)\}")


def bind_params(predicate: str, params: dict[str, str]) -> str:
    """``${param:k}`` as an escaped string literal, never as SQL; an unbound one is refused."""

    def literal(m: re.Match) -> str:
        if m[1] not in params:
            raise SemanticError("SAFETY_UNBOUND_PARAM", f"parameter {m[1]!r} is not bound")
        return "'" + str(params[m[1]]).replace("\\", "\\\\").replace("'", "\\'") + "'"

    return _PARAM.sub(literal, predicate)


def qualify(expr: str, alias: str, columns: list[str]) -> str:
    """``expr`` with its bare column names of ``columns`` prefixed by ``alias``; names that are qualified, quoted text and function names stay."""
    known, toks = {c.lower() for c in columns}, tokens(expr)
    out = []
    for k, t in enumerate(toks):
        nxt = next((x.text for x in toks[k + 1 :] if x.kind not in ("space", "comment")), "")
        before = next((x.text for x in reversed(toks[:k]) if x.kind not in ("space", "comment")), "")
        if t.kind == "ident" and t.name.lower() in known and nxt not in (".", "(") and before != ".":
            t = Token("ident", f"`{alias}`.`{t.name}`")
        out.append(t)
    return render(out)


@dataclass(frozen=True)
class Leaf:
    """A measure to aggregate, under the column name ``alias``."""

    alias: str
    model: str
    measure: Measure


class Compiler:
    """Compiles against a catalog; ``resolve`` gives the DataFrame of a ``source.table`` name and ``rollup`` that of a stored roll-up, or None."""

    def __init__(self, catalog: Catalog, resolve: Resolve, rollup: Callable[[str, str], DataFrame | None] = lambda m, p: None):
        self.catalog, self.resolve, self.rollup = catalog, resolve, rollup

    # --- graph ---------------------------------------------------------------------------------------------------------------------------------------

    def _edges(self, name: str) -> list[tuple[str, bool, str, str]]:
        """(neighbour, to many, join condition, join type) of each relationship, in both directions."""
        out = []
        for m in self.catalog.models.values():
            for r in m.relationships:
                on = re.sub(r"\bthis\.", f"{m.name}.", r.on)
                if m.name == name:
                    out.append((r.target, r.kind == "one_to_many", on, "left" if r.kind == "one_to_many" else "inner"))
                elif r.target == name:
                    out.append((m.name, r.kind == "many_to_one", on, "left" if r.kind == "many_to_one" else "inner"))
        return out

    def path(self, root: str, target: str) -> list[tuple[str, bool, str, str]]:
        """The one shortest chain of relationships from root to target."""
        level, seen = {root: [[]]}, {root}
        while level:
            if target in level:
                if len(level[target]) > 1:
                    raise SemanticError("AMBIGUOUS_PATH", f"several paths lead from {root} to {target}")
                return level[target][0]
            nxt: dict[str, list] = {}
            for at, paths in level.items():
                for e in self._edges(at):
                    if e[0] not in seen:
                        nxt.setdefault(e[0], []).extend([*p, e] for p in paths)
            seen |= nxt.keys()
            level = nxt
        raise SemanticError("DISCONNECTED", f"no relationship leads from {root} to {target}")

    def _frame(self, model: Model, params: dict[str, str]) -> DataFrame:
        df = self.resolve(model.source)
        for p in model.required_predicates:
            df = df.filter(F.expr(bind_params(p, params)))
        return df.alias(model.name)

    def joined(self, root: str, others: list[str], q: Query, may_fan: bool) -> tuple[DataFrame, dict[str, list[str]]]:
        """Root joined with the models it needs; a to-many step would count root rows several times and is refused unless ``may_fan``."""
        m = self.catalog.model(root)
        df = self._frame(m, q.params)
        columns = {root: df.columns}
        for o in others:
            for name, many, on, how in self.path(root, o):
                if name in columns:
                    continue
                if many and not may_fan:
                    raise SemanticError("FAN_OUT", f"joining {name} from {root} fans out: rows of {root} would count several times")
                right = self._frame(self.catalog.model(name), q.params)
                columns[name] = right.columns
                df = df.join(right, F.expr(on), how)
        return df, columns

    # --- columns -------------------------------------------------------------------------------------------------------------------------------------

    def _dim(self, member: str, columns: dict[str, list[str]], tz: str | None) -> Column:
        m, d, grain = self.catalog.dimension(member)
        c = F.expr(qualify(d.expr, m.name, columns[m.name]))
        return trunc(c, grain, tz) if grain else c

    @staticmethod
    def _agg(leaf: Leaf, columns: list[str]) -> Column:
        x, alias = leaf.measure, leaf.model
        if x.agg == "custom":
            return F.expr(qualify(x.expr or "", alias, columns))
        c = F.expr(qualify(x.expr, alias, columns)) if x.expr and x.expr != "*" else F.lit(1)
        if x.filters:
            c = F.when(reduce(Column.__and__, [F.expr(qualify(f"({f})", alias, columns)) for f in x.filters]), c)
        return {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "avg": F.avg, "min": F.min, "max": F.max}[x.agg](c)

    @staticmethod
    def condition(f: Filter, c: Column, number: bool = False) -> Column:
        vals = [F.lit(float(v)) if number and _is_number(v) else F.lit(v) for v in f.values]
        one = vals[0] if vals else None
        text = f.values[0] if f.values else ""
        if f.op in ("is_null", "is_not_null"):
            return c.isNull() if f.op == "is_null" else c.isNotNull()
        if not vals:
            raise SemanticError("SEMANTIC_PLAN", f"filter on {f.member} needs a value")
        if f.op in ("in", "not_in"):
            return c.isin(vals) if f.op == "in" else ~c.isin(vals)
        if f.op == "in_range":
            if len(vals) != 2:
                raise SemanticError("SEMANTIC_PLAN", f"in_range on {f.member} needs two values")
            return c.between(vals[0], vals[1])
        ops = {
            "equals": lambda: c == one, "not_equals": lambda: c != one, "gt": lambda: c > one, "gte": lambda: c >= one, "lt": lambda: c < one, "lte": lambda: c <= one,
            "contains": lambda: c.cast("string").like(f"%{text}%"), "starts_with": lambda: c.cast("string").like(f"{text}%"), "ends_with": lambda: c.cast("string").like(f"%{text}"),
        }
        if f.op not in ops:
            raise SemanticError("SEMANTIC_PLAN", f"unknown filter operator {f.op!r}")
        return ops[f.op]()

    # --- queries -------------------------------------------------------------------------------------------------------------------------------------

    def expand(self, q: Query) -> Query:
        """Segments as filters."""
        extra = []
        for s in q.segments:
            model, _, name = s.partition(".")
            m = self.catalog.model(model)
            if name not in m.segments:
                raise SemanticError("UNKNOWN_SEGMENT", f"no segment {s!r}")
            extra += [f if "." in f.member else replace(f, member=f"{model}.{f.member}") for f in m.segments[name].filters]
        return replace(q, filters=[*q.filters, *extra], segments=[])

    def compile(self, q: Query) -> DataFrame:
        """The result of ``q``: one column per dimension and measure, named by the member."""
        q = self.expand(q)
        if not q.measures and not q.dimensions:
            raise SemanticError("EMPTY_QUERY", "a query needs a measure or a dimension")
        if any("." not in m for m in q.measures):
            return self._with_metrics(q)
        leaves = [Leaf(m, *(lambda x: (x[0].name, x[1]))(self.catalog.measure(m))) for m in q.measures]
        rolled = self._from_rollup(q, leaves)
        return self._finish(rolled if rolled is not None else self._aggregate(q, leaves), q, q.limit)

    def _safety(self, root: Model, q: Query) -> None:
        named = {".".join(f.member.split(".")[:2]) for f in q.filters}
        for d in root.require_filters_on:
            if f"{root.name}.{d}" not in named:
                raise SemanticError("SAFETY_REQUIRED_FILTER", f"{root.name} needs a filter on {d}")
        if root.require_at_least_one_filter and not q.filters:
            raise SemanticError("SAFETY_NO_FILTERS", f"{root.name} needs a filter")

    def _aggregate(self, q: Query, leaves: list[Leaf]) -> DataFrame:
        roots = list(dict.fromkeys(x.model for x in leaves)) or [self.catalog.dimension(q.dimensions[0])[0].name]
        rows = [f for f in q.filters if not self.catalog.is_measure(f.member)]
        having = [f for f in q.filters if self.catalog.is_measure(f.member)]
        hidden = [Leaf(f"__h{k}", *(lambda x: (x[0].name, x[1]))(self.catalog.measure(f.member))) for k, f in enumerate(having)]
        branches = []
        for root in dict.fromkeys([*roots, *(h.model for h in hidden)]):
            self._safety(self.catalog.model(root), q)
            need = [self.catalog.dimension(x)[0].name for x in [*q.dimensions, *(f.member for f in rows)]]
            df, columns = self.joined(root, list(dict.fromkeys(n for n in need if n != root)), q, may_fan=not leaves)
            for f in rows:
                d = self.catalog.dimension(f.member)[1]
                df = df.filter(self.condition(f, self._dim(f.member, columns, q.time_zone), d.type == "number"))
            own = [x for x in [*leaves, *hidden] if x.model == root]
            dims = [self._dim(m, columns, q.time_zone).alias(m) for m in q.dimensions]
            aggs = [self._agg(x, columns[root]).alias(x.alias) for x in own]
            branches.append(df.groupBy(*dims).agg(*aggs) if aggs else df.select(*dims).distinct())
        out = reduce(lambda a, b: full_join(a, b, q.dimensions), branches)
        for f, h in zip(having, hidden):
            out = out.filter(self.condition(f, F.col(h.alias), True))
        return out.select(*[F.col(f"`{c}`") for c in [*q.dimensions, *(x.alias for x in leaves)]])

    def _cap(self, q: Query, limit: int | None) -> int | None:
        models = {m.split(".")[0] for m in [*q.measures, *q.dimensions] if "." in m} & self.catalog.models.keys()
        caps = [self.catalog.models[m].max_rows for m in models if self.catalog.models[m].max_rows]
        caps += [limit] if limit is not None else []
        return min(caps) if caps else None

    def _finish(self, df: DataFrame, q: Query, limit: int | None) -> DataFrame:
        if q.order_by:
            for m, _ in q.order_by:
                if m not in df.columns:
                    raise SemanticError("UNKNOWN_MEMBER", f"order by {m!r}: it isn't selected")
            df = df.orderBy(*[F.col(f"`{m}`").desc_nulls_first() if how == "desc" else F.col(f"`{m}`").asc_nulls_last() for m, how in q.order_by])
        cap = self._cap(q, limit)
        return df.limit(cap) if cap is not None else df

    # --- metrics -------------------------------------------------------------------------------------------------------------------------------------

    def _with_metrics(self, q: Query) -> DataFrame:
        plain: dict[tuple[str, tuple[str, ...]], Leaf] = {}
        windowed = False

        def leaf(member: str, filters: tuple[str, ...]) -> Leaf:
            m, x = self.catalog.measure(member)
            key = (member, tuple(sorted(set(filters))))
            if key not in plain:
                alias = member if not filters else f"__mf{len(plain)}_{x.name}"
                plain[key] = Leaf(alias, m.name, replace(x, filters=(*x.filters, *key[1])))
            return plain[key]

        def collect(name: str, filters: tuple[str, ...]) -> None:
            nonlocal windowed
            if "." in name:
                leaf(name, filters)
                return
            if name not in self.catalog.metrics:
                raise SemanticError("UNKNOWN_METRIC", f"no metric {name!r}")
            mt = self.catalog.metrics[name]
            windowed |= mt.kind in ("cumulative", "offset")
            own = (*filters, *([mt.filter] if mt.filter else []))
            for member, f in self._operands(mt):
                collect(member, (*own, *([f] if f else [])))

        for m in q.measures:
            collect(m, ())
        times = [d for d in q.dimensions if self.catalog.dimension(d)[2]]
        if windowed and len(times) != 1:
            raise SemanticError("METRIC_NEEDS_TIME", "cumulative and offset metrics need exactly one time dimension with a grain")
        leaves = list(plain.values())
        rolled = self._from_rollup(replace(q, measures=[x.alias for x in leaves]), leaves) if all("." in x.alias for x in leaves) else None
        frame = rolled if rolled is not None else self._aggregate(replace(q, measures=[]), leaves)
        time = times[0] if times else None
        if windowed:
            frame = self._dense(frame, q.dimensions, time, self.catalog.dimension(time)[2], q.time_zone)
        count = 0

        def column(name: str, filters: tuple[str, ...]) -> Column:
            nonlocal frame, count
            if "." in name:
                return F.col(f"`{leaf(name, filters).alias}`")
            mt = self.catalog.metrics[name]
            own = (*filters, *([mt.filter] if mt.filter else []))
            parts = [column(m, (*own, *([f] if f else []))) for m, f in self._operands(mt)]
            if mt.kind == "ratio":
                c = parts[0].cast("double") / F.nullif(parts[1].cast("double"), F.lit(0.0))
            elif mt.kind == "derived":
                names = [f"__t{count + k}" for k in range(len(parts))]
                count += len(parts)
                frame = frame.withColumns(dict(zip(names, parts)))
                c = F.expr(substitute_tokens(mt.spec["expr"], names))
            elif mt.kind == "share" and not mt.spec.get("over"):
                total = f"__all{count}"  # one row joined to all, where a window without keys would take all rows into one task
                frame = frame.crossJoin(F.broadcast(frame.agg(getattr(F, mt.spec.get("agg", "sum"))(parts[0]).alias(total))))
                c = parts[0].cast("double") / F.nullif(F.col(total).cast("double"), F.lit(0.0))
            else:
                c = self._window(mt, parts[0], q.dimensions, time)
            alias = f"__m{count}"
            count += 1
            frame = frame.withColumn(alias, c)
            return F.col(alias)

        outs = [column(m, ()).alias(m) for m in q.measures]
        return self._finish(frame.select(*[F.col(f"`{d}`") for d in q.dimensions], *outs), q, q.limit)

    @staticmethod
    def _operands(mt: Metric) -> list[tuple[str, str | None]]:
        if mt.kind == "ratio":
            return [(o.member, o.filter) for o in (mt.spec["numerator"], mt.spec["denominator"])]
        if mt.kind == "derived":
            return derived_tokens(mt.spec["expr"])
        return [(mt.spec["measure"], None)]

    @staticmethod
    def _window(mt: Metric, x: Column, dims: list[str], time: str | None) -> Column:
        keys = [F.col(f"`{d}`") for d in dims if d != time]
        agg = mt.spec.get("agg", "sum")
        if mt.kind == "share":
            over = mt.spec.get("over", [])
            if not set(over) <= set(dims):
                raise SemanticError("SHARE_DIM", f"{mt.name}: {sorted(set(over) - set(dims))} are no dimensions of the query")
            w = Window.partitionBy(*[F.col(f"`{d}`") for d in over])
            return x.cast("double") / F.nullif(getattr(F, agg)(x).over(w).cast("double"), F.lit(0.0))  # over some dimensions; the whole's share is taken in column()
        t = F.col(f"`{time}`")
        if mt.kind == "offset":
            v = F.coalesce(x, F.lit(0))
            before = F.lag(v, mt.spec.get("periods", 1)).over(Window.partitionBy(*keys).orderBy(t))
            out = mt.spec.get("output", "value")
            if out == "value":
                return before
            return v - before if out == "delta" else (v - before).cast("double") / F.nullif(before.cast("double"), F.lit(0.0))
        v = F.coalesce(x, F.lit(0)) if agg in ("sum", "avg") else x
        start = Window.unboundedPreceding
        if mt.spec["window"] == "grain_to_date":
            keys = [*keys, F.date_trunc(mt.spec["arg"]["grain"], t)]
        elif mt.spec["window"] == "trailing":
            start = -(mt.spec["arg"]["periods"] - 1)
        return getattr(F, agg)(v).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(start, 0))

    def _dense(self, agg: DataFrame, dims: list[str], time: str, grain: str, tz: str | None) -> DataFrame:
        """The aggregate on a time axis without gaps, for every combination of the other dimensions that occurs. The axis has a row per period, so it is small."""
        t = F.col(f"`{time}`")
        if self.catalog.time_spine:
            source, col = self.catalog.time_spine
            axis = self.resolve(source).select(trunc(F.col(col), grain, tz).alias("__axis")).filter("__axis IS NOT NULL").distinct()
        else:
            step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}[grain]
            axis = agg.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr(step))).alias("__axis"))
        others = [d for d in dims if d != time]
        if others:
            axis = axis.crossJoin(agg.select(*[F.col(f"`{d}`").alias(f"__k{k}") for k, d in enumerate(others)]).distinct())
        on = reduce(Column.__and__, [F.col("__axis").eqNullSafe(t), *[F.col(f"__k{k}").eqNullSafe(F.col(f"`{d}`")) for k, d in enumerate(others)]])
        rest = [F.col(f"`{c}`") for c in agg.columns if c not in dims]
        keys = [F.col("__axis").alias(d) if d == time else F.col(f"__k{others.index(d)}").alias(d) for d in dims]
        return axis.join(agg, on, "left").select(*keys, *rest)

    # --- roll-ups ------------------------------------------------------------------------------------------------------------------------------------

    def rollup_frame(self, model: str, name: str) -> DataFrame:
        """What a declared pre-aggregation stores: its measures by its dimensions."""
        m = self.catalog.model(model)
        p = m.pre_aggregations[name]
        full = lambda xs: [x if x.startswith(f"{model}.") else f"{model}.{x}" for x in xs]
        q = Query(full(p.measures), full(p.dimensions))
        return self._aggregate(q, [Leaf(x, model, self.catalog.measure(x)[1]) for x in q.measures])

    def matching_rollup(self, q: Query, leaves: list[Leaf]) -> tuple[Model, str] | None:
        """The pre-aggregation with the fewest dimensions that gives the same result as the base table, if there is one.

        All members are of one model without row-level predicates; no zone; additive measures only; every dimension and filter is covered. A filter on a time
        dimension is only covered at the very grain that is stored, as a truncated value can't tell a finer bound.
        """
        members = [*q.measures, *q.dimensions, *(f.member for f in q.filters)]
        models = {m.split(".")[0] for m in members}
        if len(models) != 1 or q.time_zone or not leaves or any(x.measure.agg not in ("sum", "count", "min", "max") for x in leaves):
            return None
        m = self.catalog.model(models.pop())
        if m.required_predicates or any(self.catalog.is_measure(f.member) for f in q.filters):
            return None
        fits = []
        for p in m.pre_aggregations.values():
            dims, measures = [x.removeprefix(f"{m.name}.") for x in p.dimensions], {x.removeprefix(f"{m.name}.") for x in p.measures}
            ok = all(x.measure.name in measures for x in leaves) and all(_source_dim(d, m, dims) for d in q.dimensions) and all(f.member.split(".", 1)[1] in dims for f in q.filters)
            if ok:
                fits.append((len(dims), p.name))
        return (m, min(fits)[1]) if fits else None

    def _from_rollup(self, q: Query, leaves: list[Leaf]) -> DataFrame | None:
        found = self.matching_rollup(q, leaves)
        if not found:
            return None
        m, name = found
        df = self.rollup(m.name, name)
        if df is None:
            return None
        self._safety(m, q)
        dims = [x.removeprefix(f"{m.name}.") for x in m.pre_aggregations[name].dimensions]
        for f in q.filters:
            df = df.filter(self.condition(f, F.col(f"`{f.member}`"), self.catalog.dimension(f.member)[1].type == "number"))
        cols = []
        for d in q.dimensions:
            grain, c = self.catalog.dimension(d)[2], F.col(f"`{m.name}.{_source_dim(d, m, dims)}`")
            cols.append((trunc(c, grain, None) if grain else c).alias(d))
        again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        return df.groupBy(*cols).agg(*[again[x.measure.agg](F.col(f"`{x.alias}`")).alias(x.alias) for x in leaves])


def trunc(c: Column, grain: str, tz: str | None) -> Column:
    """Start of the period as a time without a zone, in local time of ``tz`` when one is given."""
    return F.date_trunc(grain, F.from_utc_timestamp(c.cast("timestamp"), tz) if tz else c).cast("timestamp_ntz")


def _is_number(v: str) -> bool:
    try:
        float(v)
        return True
    except ValueError:
        return False


def _source_dim(member: str, m: Model, dims: list[str]) -> str | None:
    """The stored dimension that ``member`` can be computed from: itself, or the same time dimension at a grain that divides the wanted one."""
    name = member.split(".", 1)[1]
    if name in dims:
        return name
    base, _, grain = name.partition(".")
    if not grain:
        return None
    stored = [d for d in dims if d.partition(".")[0] == base and (not d.partition(".")[2] or grain in COARSER[d.partition(".")[2]])]
    return min(stored, key=lambda d: -GRAINS.index(d.partition(".")[2]) if d.partition(".")[2] else 1) if stored else None


def full_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates of two facts at the same grain, matched with null-safe keys; without keys both have one row."""
    if not keys:
        return a.crossJoin(b)
    l, r = a.alias("l"), b.alias("r")
    on = reduce(Column.__and__, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])
    out = [F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k) for k in keys]
    rest = [F.col(f"{s}.`{c}`") for s, d in (("l", a), ("r", b)) for c in d.columns if c not in keys]
    return l.join(r, on, "full").select(*out, *rest)


__all__ = ["Compiler", "Dimension", "bind_params", "full_join", "qualify", "trunc"]
