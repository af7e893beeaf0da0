"""Terms of documents as postings, so that phrases which no title has aren't shuffled.

A task cuts some documents into phrases at once, by numbers of words. A Bloom filter over the phrases of titles, of bounded
size, leaves out nearly all others; what remains goes to buckets of terms, each term of a slice once with the documents that
have it. In a bucket all of a term's postings meet, so whether a title has it is known there for certain; the filter only saves work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are cut into phrases at once; a longer document goes alone.
WORDS = 1_000_000
#: Bits of a segment of the filter, and segments at most (64 MB in all).
SEGMENT, SEGMENTS = 1 << 23, 64
#: Bits of the filter that a phrase sets.
PLACES = 5
#: Bytes of text for each bucket of terms.
BUCKET = 16 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``WORDS`` words in all."""
    for b in batches:
        ends = np.cumsum(sum(pc.list_value_length(c).to_numpy().astype(np.int64) for c in b.columns[1:]))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
            yield b.slice(at, to - at)
            at = to


class _Cut:
    """The phrases of lists of words (documents' titles, then their abstracts), numbered within these lists."""

    def __init__(self, texts: list[pa.ListArray], stopwords: tuple[str, ...], noise: tuple[str, ...], longest: int) -> None:
        lists = pa.concat_arrays(texts)
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        self.words, self.codes = words.dictionary, words.indices.to_numpy()
        self.text = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self._left = (np.repeat(np.cumsum(n), n) - np.arange(len(self.codes))).astype(np.int32)
        # delimiters at a text's ends leave empty words there; a phrase with one begins or ends with it
        self._good = ~pc.is_in(self.words, pa.array([*stopwords, ""], pa.string())).to_numpy(zero_copy_only=False)
        self._single = self._good & ~pc.is_in(self.words, pa.array(noise, pa.string())).to_numpy(zero_copy_only=False)
        self._hash = pd.util.hash_array(np.array(self.words.to_pylist(), dtype=object)) if len(self.words) else np.zeros(0, np.uint64)
        self._longest = longest

    def lengths(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, at, phrase, first): where phrases of n words are, their numbers, and a place of each number (-1: of none)."""
        at = np.flatnonzero(self._good[self.codes])
        own = self.codes[at].astype(np.int64)
        for n in range(1, self._longest + 1):
            if n > 1:
                on = self._left[at] >= n
                at = at[on]
                own = own[on] * len(self.words) + self.codes[at + (n - 1)]
            own, distinct = pd.factorize(own)
            whole = (self._good if n > 1 else self._single)[self.codes[at + (n - 1)]]
            here, phrase = at[whole], own[whole]
            first = np.full(len(distinct), -1, np.int64)
            first[phrase[::-1]] = here[::-1]
            yield n, here, phrase, first

    def hashes(self, first: np.ndarray, n: int) -> np.ndarray:
        """Of the phrases of n words that begin at ``first``; equal ones have equal ones in any slice."""
        h = self._hash[self.codes[first]]
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _ODD[0] + self._hash[self.codes[first + k]]
        h = (h ^ (h >> np.uint64(32))) * _ODD[1]
        return h ^ (h >> np.uint64(29))

    def strings(self, first: np.ndarray, n: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.codes[first + k])) for k in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def _place(h: np.ndarray, k: int, segments: int, bits: int) -> np.ndarray:
    """Each hash's place ``k`` in a filter; all of its places are in one segment."""
    own = ((h >> np.uint64(6)) + np.uint64(k) * ((h >> np.uint64(40)) | np.uint64(1))) & np.uint64(bits - 1)
    return ((h & np.uint64(segments - 1)) * np.uint64(bits) + own).astype(np.int64)


def _passes(h: np.ndarray, words: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """The indexes of hashes that may be in the filter; all that are pass."""
    keep = np.arange(len(h))
    for k in range(PLACES):
        at = _place(h[keep], k, segments, bits)
        keep = keep[(words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return keep


def _filter(titles: DataFrame, size: int, cut) -> tuple[np.ndarray, int, int]:
    """A Bloom filter over the phrases of ``titles``: its bytes, segments and bits of a segment."""
    bits, segments = min(SEGMENT, 1 << max(10, (2 * size).bit_length())), 1
    while segments < SEGMENTS and segments * bits < 2 * size:
        segments *= 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            c = cut([b.column(1)])
            h = np.unique(np.concatenate([c.hashes(first[first >= 0], n) for n, _, _, first in c.lengths()]))
            of = (h & np.uint64(segments - 1)).astype(np.int64)
            h = h[np.argsort(of, kind="stable")]
            ends = np.cumsum(np.bincount(of, minlength=segments))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(segments)), pa.array([x.tobytes() for x in np.split(h, ends[:-1])], pa.binary())], ["segment", "hashes"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = found.setdefault(k, np.zeros(bits, dtype=bool))
                for i in range(PLACES):
                    own[_place(np.frombuffer(x.as_buffer(), np.uint64), i, segments, bits) - k * bits] = True
        for k, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    out = np.zeros(segments * bits >> 3, dtype=np.uint8)
    for r in titles.mapInArrow(deal, "segment long, hashes binary").repartition("segment").mapInArrow(build, "segment long, bits binary").collect():
        out[r.segment * bits >> 3 : (r.segment + 1) * bits >> 3] = np.frombuffer(r.bits, np.uint8)
    return out, segments, bits


def _packed(terms: pa.Array, n: np.ndarray, ids: pa.Array, title: np.ndarray, total: np.ndarray) -> bytes:
    """Terms, how many postings each has, and the postings."""
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    b = pa.RecordBatch.from_arrays([one(terms), one(pa.array(n, pa.int32())), one(ids), one(pa.array(title, pa.int32())), one(pa.array(total, pa.int32()))], ["terms", "n", "ids", "title", "total"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> list[pa.Array]:
    return [c.flatten() for c in pa.ipc.open_stream(blob).read_next_batch().columns]


def _of_titles(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The postings of a bucket's terms that some title has."""
    if not blobs:
        return
    terms, titled, sizes = [], [], []
    for x in blobs:
        t, n, _, title, _ = _unpacked(x)
        n = n.to_numpy()
        terms.append(t)
        titled.append(np.add.reduceat(title.to_numpy(), np.cumsum(n) - n) > 0)
        sizes.append(len(t))
    codes = pa.concat_arrays(terms).dictionary_encode().indices.to_numpy()
    has = np.zeros(int(codes.max()) + 1, dtype=bool)
    has[codes[np.concatenate(titled)]] = True
    for x, t, keep in zip(blobs, terms, np.split(has[codes], np.cumsum(sizes)[:-1]), strict=True):
        _, n, ids, title, total = _unpacked(x)
        n = n.to_numpy()
        rows = pa.array(np.flatnonzero(np.repeat(keep, n)))
        of = pa.array(np.repeat(np.flatnonzero(keep), n[keep]))
        yield pa.RecordBatch.from_arrays([ids.take(rows), t.take(of), title.take(rows).cast(pa.int64()), total.take(rows).cast(pa.int64())], ["doc_id", "term", "n_title", "n_total"])


def doc_terms(texts: DataFrame, size: int, title_size: int, stopwords: tuple[str, ...], noise: tuple[str, ...], longest: int) -> DataFrame:
    """(doc_id, term, n_title, n_total) of ``texts``: doc_id, and title and abstract as lists of words. A row for each row
    of ``texts`` and term, so that rows of one doc_id aren't summed.

    ``size`` and ``title_size`` are the bytes of all texts and of titles, which only tell how many buckets and bits to take.
    """
    buckets = max(1, -(-size // BUCKET))
    cut = lambda lists: _Cut(lists, stopwords, noise, longest)
    words, segments, bits = _filter(texts.select("doc_id", "title"), title_size, cut)
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            c, docs = cut(b.columns[1:]), b.num_rows
            terms, hashes, key = [], [], []
            known = 0
            for n, here, phrase, first in c.lengths():
                used = np.flatnonzero(first >= 0)
                h = c.hashes(first[used], n)
                may = _passes(h, shared.value, segments, bits)
                used, h = used[may], h[may]
                number = np.full(len(first), -1, np.int64)
                number[used] = known + np.arange(len(used))
                known += len(used)
                terms.append(c.strings(first[used], n))
                hashes.append(h)
                g = number[phrase]
                text = c.text[here[g >= 0]]
                key.append((g[g >= 0], text))
            if not known:
                continue
            bucket = ((np.concatenate(hashes) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(known, np.int64)
            rank[order] = np.arange(known)
            key = np.sort(np.concatenate([((rank[g] * docs + text % docs) << 1) | (text < docs) for g, text in key]))
            pair = key >> 1
            edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            total, title = np.diff(np.append(edge, len(pair))), np.add.reduceat(key & 1, edge)
            g, doc = np.divmod(pair[edge], docs)
            n = np.bincount(g, minlength=known)
            strings, ids = pa.concat_arrays(terms).take(pa.array(order)), b.column(0)
            ends, after = np.cumsum(np.bincount(bucket, minlength=buckets)), np.append(0, np.cumsum(n))
            for k in range(buckets):
                i, j = int(ends[k - 1]) if k else 0, int(ends[k])
                if i < j:
                    p, q = after[i], after[j]
                    blob = _packed(strings.slice(i, j - i), n[i:j], ids.take(pa.array(doc[p:q])), title[p:q], total[p:q])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "postings"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != at:
                    yield from _of_titles(held)
                    held, at = [], k
                held.append(blob)
        yield from _of_titles(held)

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(post, "bucket long, postings binary").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(meet, f"doc_id {kind}, term string, n_title long, n_total long")
