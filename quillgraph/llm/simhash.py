"""SimHash near-duplicates, linked with BK-trees.

A text's fingerprint has 64 bits, voted for by the XXH64 values of its word shingles. Two texts are linked
when their fingerprints differ in at most RADIUS bits, and a component is what links reach.

How it is dealt out. Equal fingerprints are first folded into one node (its least doc_id), with map-side
combine, so that groups of copies of any size cost one row. Fingerprints within RADIUS bits of each other agree
in one of RADIUS + 1 blocks of bits at least; so each node goes to one shard for each block, named by the block
and its bits, and links are only sought within a shard. A shard of more than SHARD_NODES nodes is dealt again by
blocks of the bits that are still free, until each is small or has too few free bits to be large. No link is lost
and none is sought twice within a shard. The members of a shard meet in one task, which holds its BK-tree
(children keyed by the Hamming distance to the parent) and follows only edges within the radius. Trees are
sent to where they are needed by the shuffle and not by the driver, which would have to gather the
fingerprints of all documents for that; each tree is of bounded size. A shard returns a spanning forest of
its links and not all its pairs; components come from alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, fresh, one_row_each, settle, shared_dir, slices

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Nodes that a shard may have before it is dealt again.
SHARD_NODES = 1024
#: Free bits from which a shard can't be large: it has at most 2 ** FREE_BITS distinct fingerprints.
FREE_BITS = 9

_BITS = np.array([[(b >> k) & 1 for k in range(8)] for b in range(256)], dtype=np.int64)
_ALL = (1 << 64) - 1


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each shingle of ``width`` words, repeats included; a shorter text has one of all its words."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)]
    return [digest(b" ".join(g), SEED) for g in zip(*(words[i:] for i in range(width)), strict=False)]


def votes(texts: list[bytes | None], width: int = SHINGLE) -> np.ndarray:
    """Fingerprints (uint64) of texts. A bit is 1 if set in over half the hashes; without words all are 0."""
    return majority([shingle_hashes(t, width) if t else [] for t in texts])


def majority(each: list) -> np.ndarray:
    """A fingerprint (uint64) for each list of hashes: a bit is 1 if set in over half of them, and without hashes all are 0."""
    n = np.array([len(x) for x in each], dtype=np.int64)
    flat = np.fromiter((h for x in each for h in x), dtype=np.uint64, count=int(n.sum()))
    owner = np.repeat(np.arange(len(each), dtype=np.int64), n) * 256
    as_bytes = flat.view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(each), 8), dtype=np.uint8)
    for k in range(8):
        seen = np.bincount(owner + as_bytes[:, k], minlength=len(each) * 256).reshape(-1, 256) @ _BITS
        out[:, k] = ((2 * seen > n[:, None]) << np.arange(8)).sum(axis=1)
    return out.reshape(-1).view(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed 64-bit number; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = votes(byte_rows(b.column(1)), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A Burkhard-Keller tree over integers: a child is kept under its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Put ``value`` in; its number, or that of an equal one already there."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            down = self.children[at].get(d)
            if down is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = down

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the members at most ``radius`` from ``value``."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                todo += [k for e, k in kids.items() if -radius <= e - d <= radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]

    def nearest(self, value: int, radius: int) -> int | None:
        """The number of a member nearest to ``value``, if one is at most ``radius`` from it; what is found narrows the search."""
        found, todo = None, [(0, 0)] if self.values else []
        while todo:
            least, at = todo.pop()
            if least > radius:
                continue
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found, radius = at, d - 1
            # the likeliest child is searched first
            todo += sorted(((abs(e - d), k) for e, k in self.children[at].items() if abs(e - d) <= radius), reverse=True)
        return found


def shard_links(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links between ``fps``."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree, owner, out = BKTree(), [], []
    for i, fp in enumerate(fps):
        for m in tree.within(fp, radius):
            a, b = root(owner[m]), root(i)
            if a != b:
                parent[b] = a
                out.append((owner[m], i))
        if tree.add(fp) == len(owner):
            owner.append(i)
    return out


def _blocks(free: int, parts: int) -> list[int]:
    """The set bits of ``free`` in ``parts`` blocks of about equal size, as masks."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(radius: int):
    """For mapInArrow over rows (mask, bits, fp, node) that are sorted by (mask, bits): links between nodes."""

    def links(m, v, f, nodes) -> tuple[list[int], list[int]]:
        src, dst = [], []
        edge = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (v[1:] != v[:-1]), True])
        for at in np.flatnonzero(np.diff(edge) > 1):
            lo, hi = edge[at], edge[at + 1]
            for x, y in shard_links([int(z) & _ALL for z in f[lo:hi]], radius):
                src.append(int(nodes[lo + x]))
                dst.append(int(nodes[lo + y]))
        return src, dst

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            rows = new if kept is None else [np.concatenate(z) for z in zip(kept, new, strict=True)]
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            kept = [z[cut:] for z in rows]
            if cut:
                s, d = links(*(z[:cut] for z in rows))
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(d, pa.int64())], ["u", "v"])
        if kept is not None:
            s, d = links(*kept)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(d, pa.int64())], ["u", "v"])

    return run


def link_forest(nodes: DataFrame, radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(u, v): links between ``nodes`` (node, fp; distinct fps) that connect whatever any links connect."""

    def dealt(rows: DataFrame, masks: dict[int, list[int]] | None, first: list[int]) -> DataFrame:
        if masks is None:
            options = F.array(*(F.lit(_signed(x)) for x in first))
        else:
            table = F.create_map(*(c for k, xs in masks.items() for c in (F.lit(_signed(k)), F.array(*(F.lit(_signed(x)) for x in xs)))))
            options = table[F.col("mask")]
        out = rows.select("node", "fp", F.explode(options).alias("mask"))
        return out.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))

    found, free = [], 64
    masks = _blocks(_ALL, radius + 1)
    todo = dealt(nodes, None, masks)
    while True:
        crowded = None
        free -= max(1, free // (radius + 1))
        if free > FREE_BITS:
            crowded = settle(todo.groupBy("mask", "bits").count().where(F.col("count") > shard_nodes).select("mask", "bits"))
            if crowded.isEmpty():
                crowded = None
        ready = todo if crowded is None else todo.join(crowded, ["mask", "bits"], "left_anti")
        ready = ready.select("mask", "bits", "fp", "node").repartition("mask", "bits").sortWithinPartitions("mask", "bits")
        found.append(ready.mapInArrow(_search(radius), "u long, v long"))
        if crowded is None:
            break
        finer = {k: [k | x for x in _blocks(_ALL & ~k, radius + 1)] for k in masks}
        todo = dealt(todo.join(crowded, ["mask", "bits"], "left_semi"), finer, [])
        masks = [x for xs in finer.values() for x in xs]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node with the least node that links reach; by alternating star contraction."""
    shared_dir(links.sparkSession)
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``.

    component_id is the least doc_id that links reach, the row's own included. Texts that are null, empty or
    without words have fingerprint 0, which links like any other. Rows that repeat a doc_id are each returned.
    Rows with a null doc_id link nothing by themselves: they get their fingerprint's component, or null if no
    row with an id has that fingerprint. An empty table gives an empty result.
    """
    each = settle(fingerprints(docs, width=width))
    nodes = each.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null")
    # one doc_id may stand on rows of different texts: its fingerprints are then linked too
    spread = each.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    nodes = settle(nodes)
    near = link_forest(nodes, radius)
    own = each.join(spread.select("doc_id"), "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    least = components(near.unionByName(own))
    named = nodes.join(least, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return each.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of its least doc_id.

    Where several rows have that doc_id, the least by text stays. Rows with a null doc_id can't be named as members of
    a group and stay. All columns are returned, whatever their names.
    """
    drop = fresh(docs, "__drop")
    gone = settle(near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(drop)).distinct())
    return one_row_each(docs.join(gone, F.col("doc_id").cast("long") == F.col(drop), "left_anti"))
