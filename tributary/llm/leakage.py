"""Evaluation texts that stand in training texts, found with one Aho-Corasick automaton (problem 9)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.offsets import nfkc
from tributary.operators.spread import spread

#: Least number of consecutive words of an item that count as a passage.
WORDS = 12
#: Words of the blocks into which items are cut: any WORDS consecutive words of an item hold one of its blocks whole.
BLOCK = WORDS // 2
#: Characters of item texts for which one automaton is built (about 60 bytes of memory each); more items are searched for in several passes over the texts.
CHARS = 8_000_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_FORMAT = regex.compile(r"\p{Cf}+")
_here: dict = {}


def normal(text: str) -> str:
    """NFKC, lower case, without invisible format characters."""
    return _FORMAT.sub("", unicodedata.normalize("NFKC", text).lower())


def words(text: str) -> list[str]:
    return _WORD.findall(normal(text))


def normal_with_offsets(text: str) -> tuple[str, list[int]]:
    """The normal form and, for each of its characters, the index in ``text`` of the character it comes from."""
    whole, at = nfkc(text)
    low = [at[i] for i, c in enumerate(whole) for _ in c.lower()]
    lower = whole.lower()
    kept = [i for i, c in enumerate(lower) if unicodedata.category(c) != "Cf"]
    return "".join(lower[i] for i in kept), [low[i] for i in kept]


class Finder:
    """One automaton over the blocks of BLOCK words that the items' texts fall into; what a block's hit belongs to is found by comparing the words around it.

    A run of WORDS words holds a whole block wherever it begins, so no passage is missed, and the automaton has about one state per character of the items
    instead of one per character of every run.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items: list[tuple[int, list[str]]] = []
        blocks: dict[str, list[tuple[int, int]]] = {}
        for i, t in items:
            w = words(t) if t else []
            if len(w) < WORDS:
                continue
            for k in range(0, len(w) - BLOCK + 1, BLOCK):
                blocks.setdefault(" " + " ".join(w[k : k + BLOCK]) + " ", []).append((len(self.items), k))
            self.items.append((i, w))
        self.automaton = ahocorasick.Automaton()
        for g, at in blocks.items():
            self.automaton.add_word(g, at)
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def runs(self, doc: list[str], every: bool) -> Iterator[tuple[int, int, int]]:
        """(item, first, last word) of the maximal runs of at least WORDS words that an item shares with the document; without ``every`` one run an item."""
        if self.empty or len(doc) < WORDS:
            return
        start_of: dict[int, int] | None = None
        done: set[int] = set()
        reach: dict[tuple[int, int], int] = {}
        text = " " + " ".join(doc) + " "
        for end, at in self.automaton.iter(text):
            if start_of is None:
                start_of, p = {}, 0
                for k, w in enumerate(doc):
                    p += len(w) + 1
                    start_of[p] = k - BLOCK + 1  # by the place of the space behind a block's last word
            j = start_of[end]
            for n, k in at:
                item, w = self.items[n]
                if not every and item in done or reach.get((n, j - k), -1) >= j:
                    continue
                a, b = 0, BLOCK
                while j - a > 0 and k - a > 0 and doc[j - a - 1] == w[k - a - 1]:
                    a += 1
                while j + b < len(doc) and k + b < len(w) and doc[j + b] == w[k + b]:
                    b += 1
                reach[n, j - k] = j + b - 1
                if a + b >= WORDS:
                    done.add(item)
                    yield item, j - a, j + b - 1


def _finder(tag: str, items: list[tuple[int, str | None]]) -> Finder:
    if _here.get("tag") != tag:
        _here.update(tag=tag, f=Finder(items))
    return _here["f"]


def found_in(f: Finder, text: str | None) -> set[int]:
    """Items with a passage in ``text``."""
    return {i for i, _, _ in f.runs(words(text), False)} if text else set()


def passages_in(f: Finder, text: str | None) -> list[tuple[int, int, int]]:
    """(item, start, end) of each longest passage, in characters of the original text; passages whose runs of WORDS words meet are one."""
    if not found_in(f, text):
        return []
    low, at = normal_with_offsets(text)
    spans = [m.span() for m in _WORD.finditer(low)]
    per: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in f.runs([low[s:e] for s, e in spans], True):
        per.setdefault(i, []).append((a, b))
    out = []
    for i, runs in per.items():
        merged: list[list[int]] = []
        for a, b in sorted(runs):
            if merged and a + WORDS - 1 <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(i, at[spans[a][0]], at[spans[b][1] - 1] + 1) for a, b in merged]
    return sorted(out)


def leaks(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", spans: bool = False) -> DataFrame:
    """(doc_key, item_key) of each pair in which WORDS or more consecutive words of an item stand consecutively in a document; with ``spans`` also
    start_char and end_char (end excluded) of each longest passage in the document as it is.

    Null and empty texts have no words. The items, a test set of fixed size, are collected and searched for by one automaton, which every worker builds once;
    beyond CHARS characters of item texts by several, each in a pass of its own. Documents are read whole, in one narrow stage without a shuffle. Equal item texts all come out. Where both keys have one name, the item's is put out as item_<name>. Repeated documents each count.
    """
    item_name = item_key if item_key != doc_key else f"item_{item_key}"
    tests = [(r[0], r[1]) for r in items.filter(F.col(item_key).isNotNull()).select(item_key, text).distinct().orderBy(item_key, text).toLocalIterator()]
    kd, ki = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{doc_key}` {kd}, `{item_name}` {ki}" + (", start_char int, end_char int" if spans else "")
    sc = docs.sparkSession.sparkContext

    def runner(shared, tag):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = _finder(tag, shared.value)
            for b in batches:
                rows = []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rows += [(d, *x) for x in passages_in(f, t)] if spans else [(d, i) for i in sorted(found_in(f, t))]
                cols = list(zip(*rows)) or [[]] * (4 if spans else 2)
                kinds = [b.schema.field(0).type, item_type, pa.int32(), pa.int32()]
                names = [doc_key, item_name, "start_char", "end_char"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names[: len(cols)])

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema[item_key].dataType)
    out, k = None, 0
    while out is None or k < len(tests):
        part, size = [], 0
        while k < len(tests) and (not part or size + len(tests[k][1] or "") <= CHARS):
            part.append(tests[k])
            size += len(tests[k][1] or "")
            k += 1
        shared = sc.broadcast(part)
        found = spread(docs.select(doc_key, text)).mapInArrow(runner(shared, f"{sc.applicationId}-{shared._jbroadcast.id()}"), schema)
        out = found if out is None else out.unionByName(found)
    return out
