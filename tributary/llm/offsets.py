"""Rewriting of texts that keeps, for every character, its place in the text as it was."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import regex

#: A rewritten text and, for each of its characters, the index of the character of the original that it comes from.
Mapped = tuple[str, list[int] | range]


_PLAIN = re.compile(r"[\x00-\x7f]+(?=[\x00-\x7f]|\Z)")


def nfkc(text: str) -> Mapped:
    """NFKC and, for each of its characters, the index in ``text`` of the character it comes from.

    The text is normalised in clusters, a starter with what may combine with it; where that differs from the whole text's normal form (a composition over a
    cluster's border), the characters of the longest agreeing ends keep their places and those between point to the start of the difference.
    """
    out, at, k = [], [], 0
    while k < len(text):
        if m := _PLAIN.match(text, k):  # nothing in such a run combines or changes
            out.append(m[0])
            at += range(k, m.end())
            k = m.end()
            continue
        j = k + 1
        while j < len(text) and (unicodedata.combining(text[j]) or "ᅠ" <= text[j] <= "ᇿ"):
            j += 1
        n = unicodedata.normalize("NFKC", text[k:j])
        out.append(n)
        at += [min(k + i, j - 1) if len(n) == j - k else k for i in range(len(n))]
        k = j
    mine, whole = "".join(out), unicodedata.normalize("NFKC", text)
    if mine != whole:
        a = next((i for i, (x, y) in enumerate(zip(mine, whole)) if x != y), min(len(mine), len(whole)))
        b = next((i for i, (x, y) in enumerate(zip(reversed(mine[a:]), reversed(whole[a:]))) if x != y), min(len(mine), len(whole)) - a)
        at = at[:a] + [at[min(a, len(at) - 1)]] * (len(whole) - a - b) + at[len(at) - b :]
    return whole, at


def replace(mapped: Mapped, pattern: regex.Pattern, by: Callable[[regex.Match], str]) -> Mapped:
    """Every match of ``pattern`` rewritten; the new characters point to the match's first one."""
    text, at = mapped
    if not pattern.search(text):
        return mapped
    at = list(at)
    out, places, last = [], [], 0
    for m in pattern.finditer(text):
        new = by(m)
        out += [text[last : m.start()], new]
        places += at[last : m.start()]
        places += [at[m.start()]] * len(new) if m.end() > m.start() else []
        last = m.end()
    if not last:
        return mapped
    return "".join([*out, text[last:]]), places + at[last:]


def source_span(mapped: Mapped, start: int, end: int, length: int) -> tuple[int, int]:
    """The characters of the original (of ``length``) that a span of the rewritten text stands for; what was dropped behind its last character isn't among them."""
    at = mapped[1]
    last = at[end - 1]
    stop = next((at[k] for k in range(end, len(at)) if at[k] > last), length) if at[end - 1 : end + 1] != [last, last + 1] else last + 1
    return at[start], stop
