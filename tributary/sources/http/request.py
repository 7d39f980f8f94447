"""From bound filters to requests: parameters, defaults, derived values, bodies, paths, pages, retries."""

from __future__ import annotations

import fnmatch
import itertools
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import quote, urlencode, urljoin

from tributary.errors import EngineError
from tributary.sources.http import extract
from tributary.sources.http.guard import check_url

#: Pages of one request before it counts as endless, and rows that a scan may return, unless the table says otherwise.
MAX_PAGES, MAX_ROWS = 1000, None
_OPS = {"eq", "gt", "gte", "lt", "lte"}


def bind(spec: dict, filters: list[tuple[str, str, object]]) -> tuple[list[dict], list[tuple[str, str, object]]]:
    """Parameter sets to request, and the filters that were not bound.

    Filters are (column, op, value) with op of eq, in, gt, gte, lt, lte. A comparison binds where the parameter's ``accepts`` names the parameter for it. An IN
    list binds as repeated pairs of one request when the parameter says ``explode``, else as one request per value, several lists as their product. Defaults and
    derived values (ago: seconds before now; split: a part of another parameter) fill what is open; a required parameter that stays open is an error.
    """
    params, fixed, lists, rest = {p["name"]: p for p in spec.get("params", [])}, {}, {}, []
    by_column = {p.get("column", n): p for n, p in params.items()}
    for column, op, value in filters:
        p = by_column.get(column)
        if p is None:
            rest.append((column, op, value))
        elif op == "eq":
            fixed[p["name"]] = value
        elif op == "in":
            (fixed if p.get("explode") else lists)[p["name"]] = list(dict.fromkeys(value))
        elif op in _OPS and op in p.get("accepts", {}):
            fixed[p["accepts"][op]] = value
        else:
            rest.append((column, op, value))
    for n, p in params.items():
        if n in fixed or n in lists:
            continue
        if "default" in p:
            fixed[n] = p["default"]
        elif "derive" in p and "ago" in p["derive"]:
            fixed[n] = int(time.time()) - int(p["derive"]["ago"]["seconds"])
    for n, p in params.items():
        d = p.get("derive", {}).get("split") if n not in fixed and n not in lists else None
        if d and d["from"] in fixed:
            parts = str(fixed[d["from"]]).split(d.get("separator", "/"))
            if d["part"] < len(parts):
                fixed[n] = parts[d["part"]]
        if p.get("required") and n not in fixed and n not in lists:
            raise EngineError("SAFETY_REQUIRED_FILTER", f"{spec['name']} needs a filter on {p.get('column', n)}")
    sets = [{**fixed, **dict(zip(lists, combo))} for combo in itertools.product(*lists.values())]
    return sets, rest


def choose(spec: dict, bound: dict) -> dict:
    """The first of ``requests`` whose ``when_filters`` are all bound, else the table's own request."""
    for r in spec.get("requests", []):
        if all(f in bound for f in r.get("when_filters", [])):
            return {**spec, **r}
    return spec


_MISSING = object()


def _fill(node, bound: dict):
    if isinstance(node, dict):
        out = {k: v for k, x in node.items() if (v := _fill(x, bound)) is not _MISSING}
        return out if out or not node else _MISSING
    if isinstance(node, list):
        return [v for x in node if (v := _fill(x, bound)) is not _MISSING]
    if isinstance(node, str) and (m := re.fullmatch(r"\{\{(\w+)\}\}", node)):
        return bound.get(m[1], _MISSING)
    return re.sub(r"\{\{(\w+)\}\}", lambda m: str(bound.get(m[1], "")), node) if isinstance(node, str) else node


def build(spec: dict, base_url: str, bound: dict, page: dict) -> urllib.request.Request:
    """The request: path parameters, then query parameters, without those that the body takes; unbound members of the body are left out at every level."""
    bound = {**bound, **page.get("params", {})}
    path = spec["path"]
    used = set(re.findall(r"\{(\w+)\}", path))
    for n in used:
        if n not in bound:
            raise EngineError("SAFETY_REQUIRED_FILTER", f"{spec['name']} needs a value for {n}")
        path = path.replace("{" + n + "}", quote(str(bound[n]), safe=""))
    body = spec.get("body")
    in_body = set(re.findall(r"\{\{(\w+)\}\}", json.dumps(body))) if body else set()
    places = {p["name"]: p.get("in", "query") for p in spec.get("params", [])}
    query = [(n, v) for n, v in bound.items() if n not in used and n not in in_body and places.get(n, "query") == "query" and v is not None]
    url = page.get("url") or urljoin(base_url.rstrip("/") + "/", path.lstrip("/"))
    if query and not page.get("url"):
        plain = [(n, str(v).lower() if isinstance(v, bool) else v) for n, v in query]
        url += ("&" if "?" in url else "?") + urlencode(plain, doseq=True)
    headers = {"Accept": "application/json", **spec.get("headers", {})}
    data = None
    if body:
        filled = _fill(body.get("json", body.get("form", {})), bound)
        filled = {} if filled is _MISSING else filled
        for at, v in page.get("body", {}).items():
            node = filled
            *front, last = at.removeprefix("$.").split(".")
            for k in front:
                node = node.setdefault(k, {})
            node[last] = v
        if "form" in body:
            data, headers["Content-Type"] = urlencode(filled).encode(), "application/x-www-form-urlencoded"
        else:
            data, headers["Content-Type"] = json.dumps(filled).encode(), "application/json"
    return urllib.request.Request(url, data=data, headers=headers, method=spec.get("method", "POST" if data else "GET"))


def matches(status: int, pattern: str | int) -> bool:
    """403, ">=400", "5xx"."""
    p = str(pattern)
    if p.startswith(">="):
        return status >= int(p[2:])
    return fnmatch.fnmatch(str(status), p.replace("x", "?"))


class Limiter:
    """A token bucket."""

    def __init__(self, per_second: float | None, burst: int = 1):
        self.rate, self.burst, self.tokens, self.at = per_second, burst, float(burst), time.monotonic()

    def take(self) -> None:
        if not self.rate:
            return
        now = time.monotonic()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            time.sleep((1 - self.tokens) / self.rate)
            self.tokens = 1.0
        self.tokens -= 1


def send(req: urllib.request.Request, spec: dict, source: dict, limiter: Limiter) -> tuple[int, dict, str]:
    """Status, headers and body, after retries of 5xx, 429 and the listed statuses; a reset header counts before Retry-After, that before doubling waits."""
    check_url(req.full_url, source["base_url"], tuple(source.get("allowed_hosts", ())))
    retry = {"attempts": 3, "base_seconds": 0.2, "max_seconds": 30, **source.get("retry", {}), **spec.get("retry", {})}

    class _NoRedirect(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, r, fp, code, msg, hdrs, newurl):
            check_url(newurl, source["base_url"], tuple(source.get("allowed_hosts", ())))
            return super().redirect_request(r, fp, code, msg, hdrs, newurl)

    opener = urllib.request.build_opener(_NoRedirect)
    for k in range(retry["attempts"]):
        limiter.take()
        try:
            with opener.open(req, timeout=source.get("timeout_seconds", 30)) as r:
                return r.status, dict(r.headers.items()), r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            status, headers, body = e.code, dict(e.headers.items()), e.read().decode("utf-8", "replace")
            again = status >= 500 or status == 429 or status in retry.get("extra_statuses", [])
            if not again or k == retry["attempts"] - 1:
                return status, headers, body
            low = {n.lower(): v for n, v in headers.items()}
            wait = retry["base_seconds"] * 2**k
            if retry.get("reset_header") and low.get(retry["reset_header"].lower(), "").isdigit():
                wait = int(low[retry["reset_header"].lower()]) - time.time()
            elif low.get("retry-after", "").isdigit():
                wait = int(low["retry-after"])
            time.sleep(max(0.0, min(wait, retry["max_seconds"])))
        except (urllib.error.URLError, OSError) as e:
            if k == retry["attempts"] - 1:
                raise EngineError("SOURCE_UNREACHABLE", f"{req.full_url}: {e}") from e
            time.sleep(min(retry["base_seconds"] * 2**k, retry["max_seconds"]))
    raise AssertionError


_LINK = re.compile(r"<([^>]+)>([^<]*)")


def next_page(p: dict, n: int, page: dict, rows: list, body, headers: dict, size: int | None) -> dict | None:
    """The page after page ``n``, or None at the end.

    link_header: rel="next" unless it says results="false"; cursor: the token at cursor_path, until it is absent or stays; row_cursor: a field of the last row;
    page: numbers until an empty page; offset: until a short page; body_cursor: the token goes into the JSON body.
    """
    kind = p.get("type")
    if kind == "link_header":
        link = next((v for k, v in headers.items() if k.lower() == "link"), "")
        for url, attrs in _LINK.findall(link):
            if re.search(r'rel="?next"?', attrs):
                return None if re.search(r'results="?false"?', attrs) else {"url": url}
        return None
    if kind in ("cursor", "body_cursor"):
        token = extract.walk(body, p["cursor_path" if kind == "cursor" else "next_path"])
        if not rows or token in (None, "") or token == page.get("token"):
            return None
        return {"params": {p["param"]: token}, "token": token} if kind == "cursor" else {"body": {p["cursor_path"]: token}, "token": token}
    if kind == "row_cursor":
        if not rows or (p.get("more_path") and not extract.walk(body, p["more_path"])):
            return None
        token = extract.walk(rows[-1], p.get("field", "id"))
        return None if token is None or token == page.get("token") else {"params": {p["param"]: token}, "token": token}
    if kind == "page":
        return None if not rows else {"params": {p.get("param", "page"): p.get("start", 1) + n + 1}}
    if kind == "offset":
        step = p.get("size", size or 100)
        return None if len(rows) < step else {"params": {p.get("param", "offset"): (n + 1) * step, **({p["size_param"]: step} if p.get("size_param") else {})}}
    return None


def first_page(p: dict) -> dict:
    if p.get("type") == "page":
        return {"params": {p.get("param", "page"): p.get("start", 1)}}
    if p.get("type") == "offset":
        return {"params": {p.get("param", "offset"): 0, **({p["size_param"]: p.get("size", 100)} if p.get("size_param") else {})}}
    return {}


def scan(spec: dict, source: dict, bound: dict, limit: int | None = None) -> Iterator[tuple]:
    """Rows of one parameter set, page by page. A limit ends paging early; more pages or rows than the table's safety allows are an error, never a cut."""
    r = choose(spec, bound)
    resp, pages = r.get("response", {}), r.get("pagination", {})
    safety = {"max_pages": MAX_PAGES, "max_rows": MAX_ROWS, **source.get("safety", {}), **spec.get("safety", {})}
    limiter = Limiter(source.get("rate_limit", {}).get("per_second"), source.get("rate_limit", {}).get("burst", 1))
    r = {**r, "headers": {**source.get("headers", {}), **r.get("headers", {})}}
    page, n, sent = first_page(pages), 0, 0
    while page is not None:
        if n >= safety["max_pages"]:
            raise EngineError("SAFETY_TOO_MANY_PAGES", f"{spec['name']}: more than {safety['max_pages']} pages")
        status, headers, text = send(build(r, source["base_url"], bound, page), r, source, limiter)
        if status == 404 and resp.get("not_found_empty"):
            return
        bad = next((e for e in resp.get("errors", []) if matches(status, e["status"])), None)
        if bad or status >= 400:
            body = _json(text)
            message = extract.walk(body, bad["message_path"]) if bad and bad.get("message_path") else text[:200]
            code = {401: "SOURCE_UNAUTHORIZED", 403: "SOURCE_FORBIDDEN", 429: "SOURCE_RATE_LIMITED"}.get(status, "SOURCE_UNAVAILABLE" if status >= 500 else "SOURCE_OTHER")
            raise EngineError(code, f"{spec['name']}: {status} {message}")
        body = _json(text)
        rows = extract.rows_at(body, resp.get("rows_path", "$"), resp.get("reshape"))
        for x in rows:
            if limit is not None and sent >= limit:
                return
            sent += 1
            if safety["max_rows"] is not None and sent > safety["max_rows"]:
                raise EngineError("SAFETY_TOO_MANY_ROWS", f"{spec['name']}: more than {safety['max_rows']} rows")
            yield extract.row_values(x, columns(spec), bound)
        page = next_page(pages, n, page, rows, body, headers, None)
        n += 1


def _json(text: str):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def columns(spec: dict) -> list[dict]:
    """Declared columns and one for each filterable parameter that has none."""
    cols = list(spec.get("response", {}).get("schema", []))
    names = {c["name"] for c in cols}
    for p in spec.get("params", []):
        c = p.get("column", p["name"])
        if p.get("filterable", True) and c not in names:
            cols.append({"name": c, "type": p.get("type", "varchar"), "source": "param", "param": p["name"]})
            names.add(c)
    return cols
