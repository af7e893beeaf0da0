"""Benchmark decontamination: a broadcast hash set of the benchmark's windows, scanned over all document words.

Words are runs of a-z (A-Z lower-cased), digits and characters beyond ASCII. A window is WIDTH consecutive words
of an item; an item of fewer words is one window. Windows' hashes go to every worker; a document's words are
numbered by the benchmark's vocabulary, hashed window by window, and hits are verified word by word.

Items are cut into pieces that overlap by WIDTH - 1 words, so they may have any length, and pieces are dealt into
blocks of about BLOCK_BYTES, each of which is broadcast by itself, so that what is broadcast stays bounded at any size of
the benchmark; an ordinary one has a single block. With several, the documents are written once with a number
for each row, each block is scanned for by itself, and spans are united by that number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, columns_of, fresh, settle, slices

WIDTH = 10
#: Largest text, in bytes, of a block of the benchmark, about; a piece of an item has an eighth of it at most.
BLOCK_BYTES = 8 << 20
#: Words of more bytes than this are compared by their SHA-256.
LONG = 1024

_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
_BASE = 0x9E3779B97F4A7C15


def words(text: bytes | None) -> list[bytes]:
    ws = text.translate(_WORD).split() if text else []
    if ws and len(text) > LONG and max(map(len, ws)) > LONG:
        ws = [w if len(w) <= LONG else b"\0" + hashlib.sha256(w).hexdigest().encode() for w in ws]
    return ws


class Windows:
    """The hash set: windows of items by length and hash, as arrays: hashes, places in the items' words, and items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int = WIDTH) -> None:
        """``items``: pieces of items, each with its item's name and its words."""
        self.number: dict[bytes, int] = {}
        self.items: list[str | None] = []
        names: dict[str | None, int] = {}
        ids: list[int] = []
        at: dict[int, list[np.ndarray]] = {}
        owner: dict[int, list[np.ndarray]] = {}
        for name, ws in items:
            if not ws:
                continue
            k, n = min(width, len(ws)), len(ws)
            at.setdefault(k, []).append(len(ids) + np.arange(n - k + 1))
            owner.setdefault(k, []).append(np.full(n - k + 1, names.setdefault(name, len(names))))
            ids += [self.number.setdefault(w, len(self.number) + 1) for w in ws]
        self.items, self.flat = list(names), np.array(ids, dtype=np.uint32)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted(at):
            start, own = np.concatenate(at[k]).astype(np.uint32), np.concatenate(owner[k]).astype(np.int32)
            h = self._hashes([self.flat[start + j].astype(np.uint64) for j in range(k)])
            order = np.lexsort((own, h))
            h, start, own = h[order], start[order], own[order]
            again = np.zeros(len(h), dtype=bool)  # the same window of the same item
            again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
            for j in range(k):
                again[1:] &= self.flat[start[1:] + j] == self.flat[start[:-1] + j]
            self.by_length[k] = h[~again], start[~again], own[~again]

    @staticmethod
    def _hashes(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h + c) * np.uint64(_BASE)
            h ^= h >> np.uint64(31)
        return h

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], list[str | None]]:
        """Word spans [start, end) of all occurrences, by start, and the items that have them."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in ws), dtype=np.uint64, count=len(ws))
        none = np.r_[0, np.cumsum(ids == 0)]
        spans, items = [], set()
        for k, (known, start, owner) in self.by_length.items():
            at = np.flatnonzero(none[k:] == none[:-k]) if len(ids) >= k else none[:0]
            if not len(at):
                continue
            h = self._hashes([ids[at + j] for j in range(k)])
            low = np.minimum(np.searchsorted(known, h), len(known) - 1)
            found = np.flatnonzero(known[low] == h)
            high = np.searchsorted(known, h[found], side="right")
            for i, a, b in zip(at[found].tolist(), low[found].tolist(), high.tolist(), strict=True):
                same = np.ones(b - a, dtype=bool)
                for j in range(k):
                    same &= self.flat[start[a:b] + j] == ids[i + j]
                if same.any():
                    spans.append((i, i + k))
                    items.update(owner[a:b][same].tolist())
        return sorted(spans), [self.items[i] for i in items]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def pieces(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, body): the items' words, one space apart, in pieces that overlap by ``width`` - 1 words."""
    most = max(1, block_bytes // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for name, raw in zip(b.column(0).to_pylist(), byte_rows(b.column(1)), strict=True):
                ws, at = words(raw), 0
                while at < len(ws):
                    end, size = at, 0
                    while end < len(ws) and (size < most or end - at < 2 * width):
                        size += len(ws[end]) + 1
                        end += 1
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b" ".join(ws[at:end])], pa.binary())], ["item", "body"])
                    if end == len(ws):
                        break
                    at = end - width + 1

    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, body binary")


def blocks(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark's (item, words) in lists of bounded size; sizes are known before any row is gathered."""
    rows = settle(pieces(benchmark, width, block_bytes))
    size = rows.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    n = 1 + size // max(1, block_bytes // 2)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k)
        yield [(r[0], bytes(r[1]).split(b" ")) for r in part.toLocalIterator()]


def _known(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> list:
    """A broadcast for each block; one is made at a time."""
    sc = docs.sparkSession.sparkContext
    return [sc.broadcast(Windows(items, width)) for items in blocks(benchmark, width, block_bytes)]


_HITS = "rid long, doc_id long, n_words long, spans array<long>, items array<string>"


def _flat(spans: list[list[int]]) -> list[int]:
    return [x for y in spans for x in y]


def _scan(windows, hits_only: bool):
    """Of rows (rid, doc_id, text): merged word spans and items, by row; with ``hits_only`` of rows that have such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for b in slices(batches):
            n, spans, items = [], [], []
            for raw in byte_rows(b.column(2)):
                ws = words(raw)
                s, found = w.scan(ws)
                n.append(len(ws))
                spans.append(_flat(merged(s)))
                items.append(found)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["rid", "doc_id", "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if hits_only else out

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [_flat(merged(sorted((s[i], s[i + 1]) for s in row for i in range(0, len(s), 2)))) for row in b.column(3).to_pylist()]
        items = [list({x for y in row for x in y}) for row in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["rid", "doc_id", "n_words", "spans", "items"])


def _united(rows: DataFrame, known: list, all_rows: bool) -> DataFrame:
    """Hits of all blocks in ``rows``, a written table with rid: one row for each block and hit document is shuffled."""
    out = None
    for k, windows in enumerate(known):
        found = rows.mapInArrow(_scan(windows, not (all_rows and k == 0)), _HITS)
        out = found if out is None else out.unionByName(found)
    out = out.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return out.mapInArrow(_unite, _HITS)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc_id, n_words, spans, items) for each row: merged word spans as a flat array, and items as strings."""
    known = _known(docs, benchmark, width, block_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(known) == 1:
        return rows.mapInArrow(_scan(known[0], False), _HITS)
    return _united(settle(rows), known, True)


def query(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    Null and empty texts have no words. Rows that repeat a doc_id are scanned each. Items without words have no
    windows; without benchmark rows nothing is hit. Items that share an item_id count once; those without one count
    as one item, which has no place in the list of ids. Items and words may have any length.
    """
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    found = hits(docs, benchmark, width, block_bytes).withColumn("n_hit", n_hit)
    listed = F.array_join(F.array_sort(F.array_compact("items")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_words: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the text of benchmark passages cut out, from a passage's first word to its last.

    Spans of all blocks are united over the original text, as in ``hits``, and cut once. A document with fewer than
    ``least_words`` words left goes, if anything was cut from it. n_chars, where there is such a column, follows the
    text. Documents without hits are returned as they are; a null text has no hits. Rows that repeat a doc_id are
    cut each; an empty table gives an empty result.
    """
    at, n = docs.columns.index("text"), len(docs.columns)
    known = _known(docs, benchmark, width, block_bytes)
    rid, name = fresh(docs, "__rid"), fresh(docs, "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = known[0].value if len(known) == 1 else None
        for b in slices(batches):
            out, keep = [], []
            before = [None] * b.num_rows if w else b.column(n).to_pylist()
            for raw, old in zip(byte_rows(b.column(at)), before, strict=True):
                spans = merged(w.scan(words(raw))[0]) if w else [old[i : i + 2] for i in range(0, len(old), 2)] if old else []
                left = least_words
                if spans:
                    raw, left = cut(raw, spans)
                keep.append(left >= least_words)
                out.append(raw)
            cols = [pa.array(out, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(b.columns[:n])]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:n]).filter(pa.array(keep, pa.bool_()))

    rows = docs
    if len(known) > 1:
        kept = settle(docs.withColumn(rid, F.monotonically_increasing_id()))
        numbered = kept.select(F.col(rid).alias("rid"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        spans = settle(_united(numbered, known, False).select(F.col("rid").alias(rid), F.col("spans").alias(name)))
        rows = kept.join(spans, rid, "left").select(*columns_of(docs), name)
    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def cut(raw: bytes, spans: list[list[int]]) -> tuple[bytes, int]:
    """``raw`` without the words of ``spans`` and what stands between them, and how many words are left."""
    lower, at, ends = raw.translate(_WORD), 0, []
    ws = lower.split()
    wanted = {x for a, b in spans for x in (a, b - 1)}
    place = {}
    for i, w in enumerate(ws):
        at = lower.index(w, at)
        if i in wanted:
            place[i] = (at, at + len(w))
        at += len(w)
    last = 0
    for a, b in spans:
        ends.append(raw[last : place[a][0]])
        last = place[b - 1][1]
    return b"".join([*ends, raw[last:]]), len(ws) - sum(b - a for a, b in spans)
