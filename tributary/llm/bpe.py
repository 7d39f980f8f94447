"""Encoding of texts with a public byte-level BPE vocabulary, by recursive DuckDB queries per partition (problem 8)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tributary.operators.spread import spread

# White_Space of Unicode, and the splitting pattern of the vocabulary with that class in place of \s.
_WS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Words whose ids a worker remembers, words and bytes of one recursive query, documents of one step.
REMEMBER, WORDS, BYTES, DOCS = 300_000, 50_000, 1_000_000, 2_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids of the single bytes, the merge table (left, right, rank, merged) and the bytes of every id, as arrays that are shipped to the workers once."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids, letters = model["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_ = np.array([ids[c] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = np.array([(ids[a], ids[b], k, ids[a + b]) for k, (a, b) in enumerate(pairs)], np.int32)
        self.adjacent = np.zeros(1 << 16, bool)  # pairs of bytes that stand side by side in some token
        self.tokens = {i: bytes(back[c] for c in s) for s, i in ids.items()}
        for x in self.tokens.values():
            self.adjacent[[p << 8 | q for p, q in zip(x, x[1:])]] = True


_STEP = """
WITH RECURSIVE s(w, p, t) USING KEY (w, p) AS (
  SELECT w, p, t FROM start
  UNION ALL
  SELECT w, p, CASE WHEN here THEN merged WHEN NOT gone THEN t END
  FROM (SELECT *, coalesce(lag(here) OVER (PARTITION BY w ORDER BY p), false) AS gone
        FROM (SELECT *, merged IS NOT NULL AND rank = least AND (i - min(CASE WHEN merged IS NOT NULL AND rank = least THEN i END) OVER (PARTITION BY w, run)) % 2 = 0 AS here
              FROM (SELECT *, i - sum(CASE WHEN rank = least THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY p) AS run
                    FROM (SELECT q.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY q.w) AS least
                          FROM (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY p) AS u, row_number() OVER (PARTITION BY w ORDER BY p) AS i FROM s WHERE t IS NOT NULL) q
                          LEFT JOIN merges m ON q.t = m.l AND q.u = m.r))))
  WHERE least IS NOT NULL)
SELECT w, list(t ORDER BY p) AS ids FROM s WHERE t IS NOT NULL GROUP BY w
"""
_here: dict = {}


def _connection(v: Vocabulary) -> duckdb.DuckDBPyConnection:
    if _here.get("v") is not v:
        c = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        t = pa.table({n: v.merges[:, k] for k, n in enumerate(("l", "r", "rank", "merged"))})
        c.register("given", t)
        c.execute("CREATE TABLE merges AS SELECT * FROM given")
        c.unregister("given")
        _here.update(v=v, c=c, words={})
    return _here["c"]


def encode_words(v: Vocabulary, words: list[str]) -> dict[str, tuple[int, ...]]:
    """Ids of each word. The rows (word, position, token) join the merge table with their right neighbour; a word's pairs of least rank are contracted from the
    left, all that don't overlap in one step, which is what contracting the leftmost again and again comes to; a word without a pair that merges is done.
    Two bytes that stand side by side in no token are never merged across, so words are cut there first. The recursion is keyed by word and position: what
    it holds is the words as they are, however many steps they take."""
    c, out, k = _connection(v), {}, 0
    while k < len(words):
        part, size, base = [], 0, k
        while k < len(words) and len(part) < WORDS and (not part or size < BYTES):
            part.append(words[k].encode("utf-8", "surrogatepass"))
            size += len(part[-1])
            k += 1
        ends = np.concatenate([[0], np.cumsum([len(x) for x in part])])
        b = np.frombuffer(b"".join(part), np.uint8)
        first = np.zeros(len(b), bool)
        first[ends[:-1]] = True
        first[1:] |= ~v.adjacent[(b[:-1].astype(np.int32) << 8) | b[1:]]
        starts = np.nonzero(first)[0]
        piece = np.cumsum(first) - 1
        start = pa.table({"w": piece.astype(np.int32), "p": (np.arange(len(b)) - starts[piece]).astype(np.int32), "t": v.bytes_[b]})
        c.register("start", start)
        got = dict(c.execute(_STEP).fetchall())
        c.unregister("start")
        bounds = np.searchsorted(starts, ends)
        for w in range(len(part)):
            out[words[base + w]] = tuple(i for x in range(bounds[w], bounds[w + 1]) for i in got[x])
    return out


def encode_texts(v: Vocabulary, texts: list[str | None]) -> list[list[int]]:
    _connection(v)
    split = _here.setdefault("split", regex.compile(_SPLIT))
    known: dict[str, tuple[int, ...]] = _here["words"]
    parts = [split.findall(t) if t else [] for t in texts]
    new = {w for p in parts for w in p if w not in known}
    if len(known) + len(new) > REMEMBER:
        known.clear()
        new = {w for p in parts for w in p}
    known.update(encode_words(v, sorted(new)))
    return [[i for w in p for i in known[w]] for p in parts]


def encode(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids): the token ids of each row's ``text`` in the byte-level BPE file ``vocabulary``, without special tokens.

    An empty and a null text give an empty list; the strings of special tokens are ordinary text; texts are never cut. Every row gives one row, repeated keys too.
    The vocabulary has a fixed size and is broadcast. A worker keeps the ids of up to REMEMBER words and starts over beyond that.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, DOCS):
                b = whole.slice(k, DOCS)
                ids = encode_texts(shared.value, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, key: str, vocabulary: str) -> DataFrame:
    """(key, text) of (key, ids): the bytes of the ids, put together in order by DuckDB per batch; null ids give a null text."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for b in batches:
            if c is None:
                c = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
                c.register("vocab", pa.table({"i": list(shared.value.tokens), "b": [x.hex() for x in shared.value.tokens.values()]}))
            ids = b.column("ids").to_pylist()
            flat = [(k, p, i) for k, x in enumerate(ids) for p, i in enumerate(x or [])]
            t = pa.table({"k": pa.array([x[0] for x in flat], pa.int32()), "p": pa.array([x[1] for x in flat], pa.int32()), "i": pa.array([x[2] for x in flat], pa.int32())})
            c.register("flat", t)
            found = dict(c.execute("SELECT k, string_agg(b, '' ORDER BY p) FROM flat JOIN vocab USING (i) GROUP BY k").fetchall())
            texts = [None if x is None else bytes.fromhex(found.get(k, "")).decode("utf-8", "replace") for k, x in enumerate(ids)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, "ids").mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
