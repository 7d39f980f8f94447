"""Declarations of the semantic layer and their reading from plain dictionaries (YAML or JSON)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

GRAINS = ("hour", "day", "week", "month", "quarter", "year")
#: Grains that a grain can be computed from.
COARSER = {g: [c for c in GRAINS[k:] if not (g == "week" and c != "week")] for k, g in enumerate(GRAINS)}
AGGS = ("sum", "count", "count_distinct", "avg", "min", "max", "custom")


class SemanticError(ValueError):
    """A query or declaration that can't be answered; ``code`` is stable."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Dimension:
    name: str
    expr: str
    type: str = "string"
    grains: tuple[str, ...] = ()


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    expr: str | None = None
    filters: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filter:
    member: str
    op: str
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Segment:
    name: str
    filters: tuple[Filter, ...]


@dataclass(frozen=True)
class Relationship:
    name: str
    kind: str
    target: str
    on: str


@dataclass(frozen=True)
class PreAggregation:
    name: str
    dimensions: tuple[str, ...]
    measures: tuple[str, ...]
    refresh: str | None = None


@dataclass
class Model:
    name: str
    source: str
    dimensions: dict[str, Dimension]
    measures: dict[str, Measure]
    relationships: list[Relationship] = field(default_factory=list)
    segments: dict[str, Segment] = field(default_factory=dict)
    pre_aggregations: dict[str, PreAggregation] = field(default_factory=dict)
    required_predicates: list[str] = field(default_factory=list)
    require_filters_on: list[str] = field(default_factory=list)
    require_at_least_one_filter: bool = False
    max_rows: int | None = None
    description: str = ""


@dataclass(frozen=True)
class Operand:
    member: str
    filter: str | None = None


@dataclass(frozen=True)
class Metric:
    """kind: ratio (numerator, denominator), derived (expr), cumulative (measure, window, agg), offset (measure, periods, output), share (measure, over, agg)."""

    name: str
    kind: str
    spec: dict
    filter: str | None = None
    description: str = ""

    def references(self) -> list[str]:
        if self.kind == "ratio":
            return [self.spec["numerator"].member, self.spec["denominator"].member]
        if self.kind == "derived":
            return [m for m, _ in derived_tokens(self.spec["expr"])]
        return [self.spec["measure"]]


@dataclass
class Query:
    measures: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    order_by: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = None
    time_zone: str | None = None
    params: dict[str, str] = field(default_factory=dict)


_DERIVED = re.compile(r"\{([^{}|]+)(?:\|([^{}]*))?\}")


def derived_tokens(expr: str) -> list[tuple[str, str | None]]:
    """(member, filter) of each ``{member}`` or ``{member | filter}`` of a derived metric."""
    found = [(m[1].strip(), m[2].strip() if m[2] and m[2].strip() else None) for m in _DERIVED.finditer(expr)]
    if not found or "{" in _DERIVED.sub("", expr):
        raise SemanticError("CONFIG_SEMANTIC_INVALID", f"bad derived expression {expr!r}")
    return found


def substitute_tokens(expr: str, names: list[str]) -> str:
    rest = iter(names)
    return _DERIVED.sub(lambda _: f"(`{next(rest)}`)", expr)


def _operand(x) -> Operand:
    return Operand(x) if isinstance(x, str) else Operand(x["member"], x.get("filter"))


def _filter(x: dict) -> Filter:
    return Filter(x["member"], x["op"], tuple(str(v) for v in x.get("values", ())))


def _metric(x: dict) -> Metric:
    kind = x["kind"]
    if isinstance(kind, str):
        name, spec = kind, {k: v for k, v in x.items() if k not in ("name", "kind", "filter", "description", "format")}
    else:
        (name, spec), = kind.items()
        spec = dict(spec)
    if name == "ratio":
        spec = {k: _operand(spec[k]) for k in ("numerator", "denominator")}
    elif name == "cumulative":
        w = spec.get("window", "running_total")
        window, arg = (w, None) if isinstance(w, str) else next(iter(w.items()))
        if window == "trailing" and (arg or {}).get("periods", 0) < 1:
            raise SemanticError("CONFIG_SEMANTIC_INVALID", f"metric {x['name']}: trailing needs periods of 1 or more")
        if window == "grain_to_date" and (arg or {}).get("grain") not in GRAINS:
            raise SemanticError("CONFIG_SEMANTIC_INVALID", f"metric {x['name']}: grain_to_date needs a grain")
        spec |= {"window": window, "arg": arg or {}}
    elif name == "offset" and spec.get("periods", 1) < 1:
        raise SemanticError("CONFIG_SEMANTIC_INVALID", f"metric {x['name']}: offset needs periods of 1 or more")
    elif name not in ("ratio", "derived", "cumulative", "offset", "share"):
        raise SemanticError("CONFIG_SEMANTIC_INVALID", f"unknown metric kind {name!r}")
    return Metric(x["name"], name, spec, x.get("filter"), x.get("description", ""))


@dataclass
class Catalog:
    models: dict[str, Model]
    metrics: dict[str, Metric]
    time_spine: tuple[str, str] | None = None

    @staticmethod
    def from_dict(d: dict) -> Catalog:
        """The ``semantic`` section of a configuration; references and metric cycles are checked."""
        models = {}
        for m in d.get("models", []):
            s = m.get("safety", {})
            models[m["name"]] = Model(
                m["name"], m["source"],
                {x["name"]: Dimension(x["name"], x.get("expr", x["name"]), x.get("type", "string"), tuple(x.get("grains", ()))) for x in m.get("dimensions", [])},
                {x["name"]: Measure(x["name"], x["agg"], x.get("expr"), tuple(x.get("filters", ()))) for x in m.get("measures", [])},
                [Relationship(x["name"], x["kind"], x["target"], x["on"]) for x in m.get("relationships", [])],
                {x["name"]: Segment(x["name"], tuple(map(_filter, x["filters"]))) for x in m.get("segments", [])},
                {x["name"]: PreAggregation(x["name"], tuple(x.get("dimensions", ())), tuple(x.get("measures", ())), x.get("refresh")) for x in m.get("pre_aggregations", [])},
                list(s.get("required_predicates", [])), list(s.get("require_filters_on", [])), bool(s.get("require_at_least_one_filter")), s.get("max_rows"), m.get("description", ""),
            )
        spine = d.get("time_spine")
        c = Catalog(models, {x["name"]: _metric(x) for x in d.get("metrics", [])}, (spine["source"], spine["column"]) if spine else None)
        c.validate()
        return c

    def validate(self) -> None:
        for m in self.models.values():
            for x in m.measures.values():
                if x.agg not in AGGS:
                    raise SemanticError("CONFIG_SEMANTIC_INVALID", f"{m.name}.{x.name}: unknown aggregate {x.agg!r}")
            for r in m.relationships:
                if r.target not in self.models:
                    raise SemanticError("UNKNOWN_MODEL", f"{m.name}.{r.name} points to {r.target!r}")
        done: set[str] = set()

        def walk(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise SemanticError("METRIC_CYCLE", " -> ".join([*path, name]))
            if name in done or "." in name:
                return
            if name not in self.metrics:
                raise SemanticError("UNKNOWN_METRIC", f"no metric {name!r}")
            for r in self.metrics[name].references():
                walk(r, (*path, name))
            done.add(name)

        for n in self.metrics:
            walk(n, ())

    def model(self, name: str) -> Model:
        if name not in self.models:
            raise SemanticError("UNKNOWN_MODEL", f"no model {name!r}; there are {', '.join(sorted(self.models))}")
        return self.models[name]

    def dimension(self, member: str) -> tuple[Model, Dimension, str | None]:
        """Model, dimension and grain of ``model.dimension[.grain]``."""
        parts = member.split(".")
        if len(parts) not in (2, 3):
            raise SemanticError("UNKNOWN_MEMBER", f"{member!r} isn't model.dimension or model.dimension.grain")
        m = self.model(parts[0])
        if parts[1] not in m.dimensions:
            raise SemanticError("UNKNOWN_MEMBER", f"{m.name} has no dimension {parts[1]!r}")
        d, grain = m.dimensions[parts[1]], parts[2] if len(parts) == 3 else None
        if grain and (d.type != "time" or grain not in (d.grains or GRAINS)):
            raise SemanticError("INVALID_GRAIN", f"{member!r}")
        return m, d, grain

    def measure(self, member: str) -> tuple[Model, Measure]:
        model, _, name = member.partition(".")
        m = self.model(model)
        if name not in m.measures:
            raise SemanticError("UNKNOWN_MEMBER", f"{m.name} has no measure {name!r}")
        return m, m.measures[name]

    def is_measure(self, member: str) -> bool:
        model, _, name = member.partition(".")
        return model in self.models and name in self.models[model].measures
