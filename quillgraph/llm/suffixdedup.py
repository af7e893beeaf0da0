"""Repeated byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Each byte goes that is covered by a string of LENGTH bytes which also starts in a document with a smaller doc_id.

How it is dealt out. A window (LENGTH bytes at some place) is named by the least hash of the GRAM-byte strings in it;
equal windows have equal names. Neighbouring windows mostly share a name and form a run, one for every 14 bytes or so.

(0) The texts are written once, in blocks of about BLOCK_BYTES that belong to units of about UNIT_BYTES; a row's unit and
its number there are data from then on, however the table is cut when it is read again.
(1) Each unit's distinct names are shuffled by ranges of names, as packed numbers without text; names of one document only
are done with, the others go back to their units. A unit has at most 2 ** NAME_RANGES ranges, so rows are few for any
size of the data.
(2) There their runs become segments. Equal segments of a task are folded: it sends the one of least doc_id, and those
that follow with larger ones are known to go, so a task sends one for each segment, however many copies there are.
(3) Segments are shuffled by ranges of names, packed, and each distinct one is put with its least doc_id into a shard of
about SHARD_SYMBOLS together with all of its name. A shard is sorted and transformed, and its common prefixes are derived
by increasing value: breadth-first, the intervals of strings of length l are extended backwards by one character, which
sets the borders of those of length l + 1, and no border is looked for from LENGTH on. The intervals that are left
hold the equal windows; each goes where its document isn't the interval's least.
(4) Removed spans meet their units' texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, settle, slices

LENGTH = 50
GRAM = 24
NAME_BITS = 48
#: Bytes of text of a block and of a unit, about (a longer text is a block of its own), and of what is named at once.
BLOCK_BYTES, UNIT_BYTES, CHUNK = 4 << 20, 64 << 20, 1 << 20
#: Symbols of a shard that is transformed, about; all segments of a name are in one.
SHARD_SYMBOLS = 192 << 10
#: Bytes of names that meet in a task at most, about; and the ranges of names as powers of two, at most.
NAMES_BYTES = 8 << 20
NAME_RANGES, SEGMENT_RANGES = 18, 20
#: Segments that are packed together, segments that a task remembers to fold copies of, and windows judged at once.
PACKED, REMEMBERED, JUDGED = 500_000, 300_000, 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A well-mixed 64-bit hash of the ``gram`` bytes at each place, by doubling."""
    known, width = {1: buf.astype(np.uint64) + np.uint64(1)}, 1
    n = len(buf)
    while 2 * width <= gram:
        h = known[width]
        known[2 * width] = h[:-width] * _MIX + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    out, at = None, 0
    for w in sorted(known, reverse=True):
        if gram - at >= w:
            part = known[w][at : at + n - gram + 1]
            out = part.copy() if out is None else out * _MIX + (part ^ (part >> np.uint64(31)))
            at += w
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(h) - width + 1
    pad = np.full((-len(h)) % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    block = np.concatenate([h, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(texts: list[bytes | None], length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, number of the text, first window and number of windows of each run; a run may be given in parts."""
    sizes = np.array([len(t or b"") for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(t for t in texts if t), dtype=np.uint8)
    ends = np.cumsum(sizes)
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(buf) - length + 1, chunk):
        b = min(a + chunk, len(buf) - length + 1)
        names = (_sliding_least(_gram_hashes(buf[a : b + length - 1], gram), length - gram + 1) & np.uint64((1 << NAME_BITS) - 1)).view(np.int64)
        lo = int(np.searchsorted(ends, a, side="right"))
        hi = int(np.searchsorted(ends, b - 1, side="right"))
        owner = np.repeat(np.arange(lo, hi + 1), np.diff(np.r_[a, np.minimum(ends[lo : hi + 1], b)]))
        valid = np.arange(a, b) + length <= ends[owner]
        new = np.ones(len(names), dtype=bool)
        new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new & valid)  # a text's windows without room for LENGTH bytes are its last ones
        edge = np.flatnonzero(new | ~valid)
        last = np.append(edge, len(names))[np.searchsorted(edge, first, side="right")]
        own = owner[first]
        found.append((names[first], own, first + a - (ends - sizes)[own], last - first))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` (small whole numbers) by the at least ``depth`` symbols from each."""
    n = len(text)
    pad = np.concatenate([text.astype(np.int64), np.zeros(7, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):  # of 9 bits each
        key = (key << 9) | pad[j : j + n]
    width = 7
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.zeros(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]]) + 1
        if width >= depth or rank[order[-1]] == n:
            return order
        key = rank * (n + 1)
        key[:-width] += rank[width:]
        width *= 2


def equal_windows(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``text`` in suffix order, and the number of the interval of each: equal for equal windows.

    ``text`` has symbols 2 to 257 for bytes and 1 between segments.
    """
    text = np.append(text, 0).astype(np.uint16)  # an end below all
    n = len(text)
    order = suffix_order(text, length + 2)
    transform = text[order - 1]  # the symbol before each suffix
    step = np.argsort(transform, kind="stable")  # the rank of the suffix one symbol shorter
    first = text[order]
    border = np.ones(n, dtype=bool)  # between ranks j - 1 and j: a common prefix below the length reached
    border[1:] = first[1:] != first[:-1]
    open_ = np.flatnonzero(~border)
    low, high = step[open_ - 1], step[open_]
    low, high = np.minimum(low, high), np.maximum(low, high)
    for _ in range(1, length):
        # intervals of the present length, extended backwards: a border inside one is a border of its extension
        before = np.cumsum(border, dtype=np.int32)
        found = before[high] > before[low]
        if not found.any():
            break
        border[open_[found]] = True
        open_, low, high = open_[~found], low[~found], high[~found]
    return order, np.cumsum(border, dtype=np.int64)


def joined(segments: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(segments), np.array([len(s) for s in segments], dtype=np.int64)


def least_in_shard(data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of the segments, one after another, the least owner of a segment that has it.

    ``data`` has the segments' bytes one after another; each has ``length`` bytes at least.
    """
    total = len(data) + len(sizes)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(total, dtype=np.uint16)
    where = np.ones(total, dtype=bool)
    where[starts + sizes] = False
    text[where] = data.astype(np.uint16) + 2
    own = np.full(total + 1, np.iinfo(np.int64).max, dtype=np.int64)
    counts = sizes - length + 1
    place = ragged(starts, counts)
    own[place] = np.repeat(owners, counts)
    order, number = equal_windows(text, length)
    least = np.minimum.reduceat(own[order], np.flatnonzero(np.r_[True, number[1:] != number[:-1]]))
    at_place = np.empty(total + 1, dtype=np.int64)
    at_place[order] = least[number - number[0]]
    return at_place[place]


def least_owners(segments: list[bytes], owners: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the least owner of a segment that has the window at each place."""
    data, sizes = joined(segments)
    least = least_in_shard(np.frombuffer(data, dtype=np.uint8), sizes, np.array(owners, dtype=np.int64), length)
    return np.split(least, np.cumsum(sizes - length + 1)[:-1])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ... ."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _batch(schema: list[tuple[str, pa.DataType]], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers as bytes, those of one weight together, which compress better."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes, n: int, width: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def _pack_names(names: np.ndarray) -> bytes:
    """Sorted distinct names, as differences."""
    return zstandard.compress(_planes(np.diff(names, prepend=np.int64(0)), NAME_BITS // 8), 1)


def _unpack_names(body: bytes) -> np.ndarray:
    raw = zstandard.decompress(body)
    return np.cumsum(_from_planes(raw, len(raw) * 8 // NAME_BITS, NAME_BITS // 8))


_PART = [("unit", pa.int64()), ("kind", pa.int64()), ("block", pa.int64()), ("body", pa.binary())]
_PART_SQL = "unit long, kind long, block long, body binary"
#: What a unit is told (it comes before the texts), and its texts.
_TOLD, _TEXTS = 0, 1


def _pack_texts(block_bytes: int, unit_bytes: int):
    """Of rows (doc_id, text): (unit, block, size, body), texts compressed together and where they belong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block, base, unit_size = TaskContext.get().partitionId() << 24, 0, 0, 0
        head: list[tuple[int, int, int]] = []
        texts: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            raw = np.array([base, len(head)], dtype="<i8").tobytes() + np.array(head, dtype="<i8").tobytes() + b"".join(texts)
            return _batch([("unit", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("body", pa.binary())], ([unit], [block], [size], [zstandard.compress(raw, 6)]))

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), byte_rows(b.column(1)), strict=True):
                head.append((doc or 0, doc is not None, len(text or b"")))
                texts.append(text or b"")
                size += len(texts[-1]) + 32
                if size >= block_bytes:
                    yield out()
                    unit_size += size
                    block, base = block + 1, base + len(head)
                    head, texts, size = [], [], 0
                    if unit_size >= unit_bytes:
                        unit, block, base, unit_size = unit + 1, 0, 0, 0
        if head:
            yield out()

    return run


def _unpack_texts(body: bytes) -> tuple[int, np.ndarray, list[bytes]]:
    """The number of the first row, rows (doc_id or 0, whether it has one, bytes), and the texts of a block."""
    raw = zstandard.decompress(body)
    base, n = np.frombuffer(raw, dtype="<i8", count=2).tolist()
    head = np.frombuffer(raw, dtype="<i8", count=3 * n, offset=16).reshape(n, 3)
    at = 16 + 24 * n + np.r_[0, np.cumsum(head[:, 2])]
    return base, head, [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _owned(head: np.ndarray, texts: list[bytes]) -> list[bytes | None]:
    return [t if own else None for own, t in zip(head[:, 1].tolist(), texts, strict=True)]


_NAMES = [("bucket", pa.int64()), ("unit", pa.int64()), ("one", pa.binary()), ("many", pa.binary())]


def _names(length: int, gram: int, bits: int, flush: int = 4_000_000):
    """Of blocks: (bucket, unit, one, many), a unit's names that one, or more, of its documents have."""

    def told(unit: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        # a block's documents are its own, so a name of two blocks has two documents
        name = np.concatenate([n for n, _ in parts])
        many = np.concatenate([m for _, m in parts])
        order = np.argsort(name, kind="stable")
        name, many = name[order], many[order]
        edge = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        many = np.logical_or.reduceat(many, edge) | (np.diff(np.r_[edge, len(name)]) > 1)
        name = name[edge]
        bucket = name >> (NAME_BITS - bits)
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        rows = [(int(bucket[a]), unit, _pack_names(name[a:b][~many[a:b]]), _pack_names(name[a:b][many[a:b]])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return _batch(_NAMES, list(zip(*rows, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, n = None, [], 0
        for b in batches:
            for u, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if parts and (u != unit or n >= flush):
                    yield told(unit, parts)
                    parts, n = [], 0
                unit = u
                _, head, texts = _unpack_texts(body)
                name, row, _, _ = runs(_owned(head, texts), length, gram)
                if len(name):
                    order = np.lexsort((row, name))
                    name, row = name[order], row[order]
                    edge = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
                    parts.append((name[edge], row[edge] != row[np.r_[edge[1:], len(name)] - 1]))
                    n += len(edge)
        if parts:
            yield told(unit, parts)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of names sorted by bucket: what each unit is told, its names that two documents at least have."""

    def solve(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        one = [_unpack_names(r[1]) for r in rows]
        many = [_unpack_names(r[2]) for r in rows]
        once = np.sort(np.concatenate(one))
        known = np.unique(np.concatenate([once[1:][once[1:] == once[:-1]], *many]))
        # a name that is in some unit's ``many`` and once in another's ``one`` is known by the former
        out = []
        for (unit, _, _), a, m in zip(rows, one, many, strict=True):
            at = np.minimum(np.searchsorted(known, a), max(0, len(known) - 1))
            found = np.union1d(a[known[at] == a] if len(known) else a[:0], m)
            if len(found):
                out.append((unit, _TOLD, 0, _pack_names(found)))
        return _batch(_PART, list(zip(*out, strict=True)) if out else [[], [], [], []])

    bucket, rows = None, []
    for b in batches:
        for k, unit, one, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != bucket and rows:
                yield solve(rows)
                rows = []
            bucket = k
            rows.append((unit, one, many))
    if rows:
        yield solve(rows)


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], bytes]]:
    """Of parts sorted by unit, kind and block: for each block its unit, what the unit was told, and the texts."""
    unit, told = None, []
    for b in batches:
        for u, kind, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if u != unit:
                unit, told = u, []
            if kind == _TOLD:
                told.append(body)
            else:
                yield unit, told, body


_SEGMENTS = [("bucket", pa.int64()), ("unit", pa.int64()), ("body", pa.binary())]


def _pack_spans(spans: np.ndarray) -> bytes:
    """Rows (row number, first byte, bytes), sorted by row number, which is given as differences."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    return zstandard.compress(b"".join(_planes(x, 5) for x in (np.diff(spans[:, 0], prepend=np.int64(0)), spans[:, 1], spans[:, 2])), 3)


def _unpack_spans(body: bytes) -> np.ndarray:
    raw = zstandard.decompress(body)
    n = len(raw) // 15
    row, first, size = (_from_planes(raw[5 * n * k : 5 * n * (k + 1)], n, 5) for k in range(3))
    return np.stack([np.cumsum(row), first, size], axis=1)


def _cut(length: int, gram: int, bits: int):
    """Of units with their shared names and texts: (bucket, null, segments), one for each run of a shared name; and (bucket,
    unit, spans) of copies that are known to go."""

    def packed(columns: list[np.ndarray], segments: list[bytes]) -> pa.RecordBatch:
        name = columns[0]
        order = np.argsort(name, kind="stable")
        bucket = (name >> (NAME_BITS - bits))[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(order) else np.zeros(1, dtype=np.int64)
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            some = order[a:b]
            own = [x[some] for x in columns]
            own[0] = np.diff(own[0], prepend=np.int64(0))
            numbers = b"".join(_planes(x, w) for x, w in zip(own, _WIDTHS, strict=True))
            out.append((int(bucket[a]), None, zstandard.compress(len(some).to_bytes(8, "little") + numbers + b"".join([segments[i] for i in some.tolist()]), 3)))
        return _batch(_SEGMENTS, list(zip(*out, strict=True)) if out else [[], [], []])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        ready: list[tuple[np.ndarray, ...]] = []
        segments: list[bytes] = []
        unit, names = None, None
        for u, told, body in _by_unit(batches):
            if u != unit:
                unit, names = u, np.unique(np.concatenate([_unpack_names(x) for x in told])) if told else np.zeros(0, dtype=np.int64)
            if not len(names):
                continue
            base, head, text = _unpack_texts(body)
            name, row, at, n = runs(_owned(head, text), length, gram)
            keep = names[np.minimum(np.searchsorted(names, name), len(names) - 1)] == name
            name, row, at, n = name[keep], row[keep], at[keep], n[keep]
            if not len(name):
                continue
            doc = head[row, 0]
            own: list[bytes | None] = []
            get = seen.get
            for r, d, a, e in zip(row.tolist(), doc.tolist(), at.tolist(), (at + n + length - 1).tolist(), strict=True):
                s = text[r][a:e]
                least = get(s)
                if least is None or d < least:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[s] = d
                own.append(s if least is None or d <= least else None)
            copy = np.array([s is None for s in own], dtype=bool)
            if copy.any():
                spans = np.stack([base + row[copy], at[copy], n[copy] + length - 1], axis=1)
                yield _batch(_SEGMENTS, ([int(name[0]) >> (NAME_BITS - bits)], [unit], [_pack_spans(spans)]))
            sent = ~copy
            ready.append((name[sent], np.full(int(sent.sum()), unit), base + row[sent], doc[sent], at[sent], n[sent]))
            segments += [s for s in own if s is not None]
            if len(segments) >= PACKED:
                yield packed([np.concatenate(x) for x in zip(*ready, strict=True)], segments)
                ready, segments = [], []
        if segments:
            yield packed([np.concatenate(x) for x in zip(*ready, strict=True)], segments)

    return run


#: Bytes of a segment's numbers: name (as difference), unit, row number there, doc_id, first byte, windows.
_WIDTHS = (NAME_BITS // 8, 8, 5, 8, 4, 4)


def _shards(length: int, shard_symbols: int):
    """Of segments sorted by bucket: what each unit is told, removed spans."""

    def told(parts: list[np.ndarray]) -> pa.RecordBatch:
        a = np.concatenate(parts)
        a = a[np.argsort(a[:, 0], kind="stable")]
        cut = np.flatnonzero(np.r_[True, a[1:, 0] != a[:-1, 0], True])
        out = [(int(a[x, 0]), _TOLD, 0, _pack_spans(a[x:y, 1:])) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return _batch(_PART, list(zip(*out, strict=True)))

    def solve(bodies: list[bytes]) -> np.ndarray:
        """Rows (unit, row number, first byte, bytes) of what goes of a bucket's segments."""
        columns: list[list[np.ndarray]] = [[] for _ in _WIDTHS]
        texts = []
        for body in bodies:
            raw = zstandard.decompress(body)
            k, at = int.from_bytes(raw[:8], "little"), 8
            for c, w in zip(columns, _WIDTHS, strict=True):
                c.append(_from_planes(raw[at : at + k * w], k, w))
                at += k * w
            columns[0][-1] = np.cumsum(columns[0][-1])
            texts.append(raw[at:])
        name, unit, row, doc, first, n = (np.concatenate(c) for c in columns)
        data, sizes = b"".join(texts), n + length - 1
        texts.clear()
        offsets = np.r_[0, np.cumsum(sizes)]
        own = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(data)])
        code = own.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        # distinct segments by name, with their least doc_id
        order = np.lexsort((doc, code, name))
        edge = order[np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])]
        least = np.empty(len(edge), dtype=object)
        place = np.empty(len(edge), dtype=np.int64)  # of a distinct segment, in the order of names
        place[code[edge]] = np.arange(len(edge))
        counts = n[edge]
        raw = np.frombuffer(data, dtype=np.uint8)
        symbols = np.cumsum(sizes[edge])
        ends = np.flatnonzero(np.r_[name[edge][1:] != name[edge][:-1], True])  # the last segment of each name
        lows: list[np.ndarray] = []
        a = 0
        while a < len(edge):
            base = int(symbols[a - 1]) if a else 0
            b = int(ends[min(len(ends) - 1, np.searchsorted(ends, max(a, int(np.searchsorted(symbols, base + shard_symbols)) - 1)))]) + 1
            part = edge[a:b]
            lows.append(least_in_shard(raw[ragged(offsets[part], sizes[part])], sizes[part], doc[part], length))
            a = b
        least = np.concatenate(lows)
        starts = np.cumsum(counts) - counts
        out = [np.zeros((0, 4), dtype=np.int64)]
        which = place[code]
        steps = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(steps, (steps[a - 1] if a else 0) + JUDGED)))
            k = n[a:b]
            gone = least[ragged(starts[which[a:b]], k)] < np.repeat(doc[a:b], k)
            owner = np.repeat(np.arange(a, b), k)
            new = gone & np.r_[True, ~gone[:-1] | (owner[1:] != owner[:-1])]
            end = gone & np.r_[~gone[1:] | (owner[1:] != owner[:-1]), True]
            x, y = np.flatnonzero(new), np.flatnonzero(end)
            who = owner[x]
            out.append(np.stack([unit[who], row[who], first[who] + x - (np.cumsum(k) - k)[who - a], y - x + length], axis=1))
            a = b
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, bodies = None, []
        done: list[np.ndarray] = []
        for b in batches:
            for k, unit, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != bucket:
                    if bodies:
                        done.append(solve(bodies))
                        bodies = []
                    bucket = k
                    if sum(map(len, done)) > 500_000:
                        yield told(done)
                        done = []
                if unit is None:
                    bodies.append(body)
                else:
                    yield _batch(_PART, ([unit], [_TOLD], [0], [body]))
        if bodies:
            done.append(solve(bodies))
        if sum(map(len, done)):
            yield told(done)

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (row number, first byte, bytes) that overlap or touch as one, sorted: rows (row number, first byte, end)."""
    start = (spans[:, 0] << 32) + spans[:, 1]
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + spans[:, 2])[order]
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(start) else np.zeros(0, dtype=np.int64)
    last = reach[np.r_[new[1:], len(start)] - 1] if len(start) else reach
    a, row = start[new], start[new] >> 32
    return np.stack([row, a - (row << 32), last - (row << 32)], axis=1)


def _finish(keep_text: bool):
    """Of units with their removed spans and texts: a row for each row."""
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, spans = None, None
        for u, told, body in _by_unit(batches):
            if u != unit:
                unit, spans = u, merged(np.concatenate([_unpack_spans(x) for x in told]) if told else np.zeros((0, 3), dtype=np.int64))
            base, head, text = _unpack_texts(body)
            lo, hi = np.searchsorted(spans[:, 0], [base, base + len(text)])
            some = spans[lo:hi]
            edge = np.searchsorted(some[:, 0], base + np.arange(len(text) + 1)).tolist()
            some = some[:, 1:].tolist()
            rows = []
            for k, ((doc, has, _), t) in enumerate(zip(head.tolist(), text, strict=True)):
                mine = some[edge[k] : edge[k + 1]]
                rest = t
                if mine:
                    last, kept = 0, []
                    for a, e in mine:
                        kept.append(t[last:a])
                        last = e
                    rest = b"".join([*kept, t[last:]])
                rows.append([doc if has else None, len(t), len(t) - len(rest), len(mine), hashlib.sha256(rest).hexdigest()] + [rest] * keep_text)
            yield _batch(schema, list(zip(*rows, strict=True)))

    return run


def _ranges(size: int, most: int) -> int:
    """Bits of a name that choose its range: so many that about NAMES_BYTES of names share one."""
    return min(most, max(4, (size // (2 * NAMES_BYTES)).bit_length()))


def remove_repeats(docs: DataFrame, keep_text: bool = True, length: int = LENGTH, gram: int = GRAM, shard_symbols: int = SHARD_SYMBOLS, block_bytes: int = BLOCK_BYTES, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``keep_text``, the bytes kept, for each row of ``docs``.

    A null text counts as empty. Rows that repeat a doc_id are each judged against smaller ids, and not against each
    other. Rows with a null doc_id are neither smaller nor larger than others and stay whole. Bytes that are
    kept needn't be valid UTF-8. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packs = settle(rows.mapInArrow(_pack_texts(block_bytes, unit_bytes), "unit long, block long, size long, body binary"))
    size = packs.agg(F.sum("size")).first()[0] or 0
    name_bits, bits = _ranges(size, NAME_RANGES), _ranges(4 * size, SEGMENT_RANGES)
    names = packs.select("unit", "body").mapInArrow(_names(length, gram, name_bits), "bucket long, unit long, one binary, many binary")
    shared = names.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, _PART_SQL)
    texts = packs.select("unit", F.lit(_TEXTS).cast("long").alias("kind"), "block", "body")
    units = lambda told: texts.unionByName(told).repartition("unit").sortWithinPartitions("unit", "kind", "block")
    segments = units(shared).mapInArrow(_cut(length, gram, bits), "bucket long, unit long, body binary")
    spans = segments.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shards(length, shard_symbols), _PART_SQL)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return units(spans).mapInArrow(_finish(keep_text), schema)


def query(docs: DataFrame) -> DataFrame:
    """The digest, without the bytes kept."""
    return remove_repeats(docs, keep_text=False)
