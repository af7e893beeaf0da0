"""Near copies by the similarity of word shingles: every candidate pair is checked on its whole sets.

Two texts are linked when the Jaccard similarity of their sets of WIDTH-word shingles is SIMILARITY or more, and a group
is what links reach. Candidates come from BK-trees over the SimHash fingerprints of these sets, with a radius of RADIUS bits.
Blocks of bits at that radius would have two bits, so shards are named by min-hashes instead: BANDS bands of ROWS each. A pair
of similarity s meets in none with chance (1 - s ** ROWS) ** BANDS, 3 in a million at 0.8 and less above.

Equal sets are first folded into one node. A shard's tree links each node with the nearest before it, so that a large group costs
rows by its size and not its square; pairs are checked on whole sets. Whatever then shares a shard with a node of another group
goes there with a sketch, a byte for each min-hash: the trees name all candidates within the radius, and what agreeing sketches
reach is a family. Sets go once to their family's tree, not to each shard, or to a few trees of a large family; only where a family is
too large for FAMILY_TREES of them they go to the shards of its nodes. Candidates are named there again, the sets decide, and a tree's task returns a spanning forest of the links. Texts
that are alike by less than SIMILARITY are compared there, but make no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, fresh, one_row_each, settle, slices
from .simhash import BKTree, components, majority, shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Bits in which fingerprints of candidates may differ. Sets at SIMILARITY differ in 10 on average and in more than this with
#: a chance of 1e-6 at 5 shingles and under 1e-7 from 6 on (simulated for 17 sizes up to 1,000).
RADIUS = 28
#: Chance that the sketches of sets at SIMILARITY agree in fewer bytes than ``least_agreement`` says; less above.
MISS = 1e-8
#: Nodes that a tree has at most, about, and shingles of their sets.
TREE_NODES, TREE_SHINGLES = 512, 1 << 20
#: Trees' worth of nodes or shingles up to which a family is dealt as one. A node is sent up to so many times there, and else for each shard, of up to BANDS.
FAMILY_TREES = 8
#: Bits that the filter over wanted doc_ids has at most (8 MB), whatever the data. Beyond some 10 million of them it lets more rows pass.
FILTER_BITS = 1 << 26

_rng = np.random.default_rng(42)
_XOR = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(np.array(shingle_hashes(text, width) if text else [], dtype=np.uint64))


def minima(own: np.ndarray) -> np.ndarray:
    """A set's min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 2048):
        least = np.minimum(least, ((own[at : at + 2048, None] ^ _XOR) * _ODD).min(axis=0))
    return least


def bands(least: np.ndarray) -> list[int]:
    """The names of a set's shards, from its min-hashes."""
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[k * ROWS * 8 : (k + 1) * ROWS * 8], k) - (1 << 63) for k in range(BANDS)]


def sketch(least: np.ndarray) -> bytes:
    """A byte for each min-hash; unequal min-hashes have equal bytes with chance 1 / 256."""
    return ((least * _ODD[0]) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_agreement(similarity: float = SIMILARITY) -> int:
    """Bytes in which sketches of sets at ``similarity`` agree at least, but for a chance of MISS: a tail of the binomial distribution."""
    n, tail = BANDS * ROWS, 0.0
    for t in range(n):
        tail += math.comb(n, t) * similarity**t * (1 - similarity) ** (n - t)
        if tail > MISS:
            return t
    return n


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """(rid, doc_id, digest, n, fp, bands, sketch) for each of ``rows`` (rid, doc_id, text). An empty set has no bands, since it is like no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in byte_rows(b.column(2))]
            least = [minima(s) for s in sets]
            cols = [b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(majority(sets).view(np.int64))]
            cols += [pa.array([bands(x) if len(s) else [] for s, x in zip(sets, least, strict=True)], pa.list_(pa.int64())), pa.array([sketch(x) for x in least], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "digest", "n", "fp", "bands", "sketch"])

    return settle(rows.mapInArrow(run, "rid long, doc_id long, digest binary, n long, fp long, bands array<long>, sketch binary"))


def _places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    """Each id's four places in a filter of ``size`` bits, a power of two."""
    x = ids.astype(np.int64).view(np.uint64) * _ODD[0]
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [((x + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(4)]


def _filter(ids: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter over ``ids`` (doc_id), as 64-bit words: 16 bits an id, and never over ``most`` bits in all."""
    size = max(64, min(most, 1 << (16 * max(1, ids.count()) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    got = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size >> 6, dtype=np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return words


def _passes(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of ``ids`` may be in the filter; all that are pass."""
    keep = np.ones(len(ids), dtype=bool)
    for at in _places(ids, len(words) << 6):
        keep &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return keep


def _sets(rows: DataFrame, each: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rid, own): the whole sets of ``wanted`` (rid, doc_id, digest), found again among ``rows`` by doc_id and digest.

    Sets are made again where the texts lie, of those whose doc_id passes a filter of bounded size over what is wanted;
    the join decides. Only of a doc_id that is repeated in ``each`` equal sets are folded afterwards.
    """
    words = rows.sparkSession.sparkContext.broadcast(_filter(wanted.select("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            b = b.filter(pa.array(_passes(b.column(0).to_numpy(), words.value)))
            own = [shingle_set(t, width).tobytes() for t in byte_rows(b.column(1))]
            digests = pa.array([xxhash.xxh3_128_digest(x) for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), digests, pa.array(own, pa.binary())], ["doc_id", "digest", "own"])

    made = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, own binary")
    found = made.join(wanted, ["doc_id", "digest"]).select("doc_id", "rid", "own")
    again = settle(each.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return settle(found.select("rid", "own"))
    found = settle(found)
    more = found.join(again, "doc_id", "left_semi").dropDuplicates(["rid"])
    return settle(found.join(again, "doc_id", "left_anti").unionByName(more).select("rid", "own"))


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): those of ``pairs`` (u, v; distinct) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # written first: where pairs are few, their size is known and the sets needn't move
    pairs = settle(pairs)
    both = pairs.join(sets.select(F.col("rid").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("rid").alias("v"), F.col("own").alias("b")), "v")
    return settle(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def _shards(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows that agree in their first ``keys`` columns (long, sorted by them), one shard after another."""
    kept: list[pa.RecordBatch] = []
    name = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)])
        edge = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0), True])
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if name is not None and (k[:, lo] != name).any():
                yield name, pa.Table.from_batches(kept)
                kept = []
            name = k[:, lo]
            kept.append(b.slice(lo, hi - lo))
    if name is not None:
        yield name, pa.Table.from_batches(kept)


def _nearest(shards: DataFrame, nodes: int = TREE_NODES) -> DataFrame:
    """(u, v), distinct: each node of a shard of ``shards`` (band, count, rid, fp) with the nearest before it in its shard's BK-tree.

    A crowded shard is dealt to trees of bounded size, otherwise in each band; what that leaves apart is for ``_trees``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _shards(batches, 2):
            tree, owner, u, v = BKTree(), [], [], []
            for rid, fp in zip(t["rid"].to_pylist(), t["fp"].to_numpy().view(np.uint64).tolist(), strict=True):
                at = tree.nearest(fp, RADIUS)
                if at is not None:
                    u.append(owner[at])
                    v.append(rid)
                if tree.add(fp) == len(owner):
                    owner.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    part = F.pmod(F.xxhash64("rid", "band"), F.ceil(F.col("count") / nodes))
    dealt = shards.select("band", part.alias("part"), "rid", "fp").repartition("band", "part").sortWithinPartitions("band", "part", "rid")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _candidates(fps: list[int], n: np.ndarray, c: np.ndarray, first: int | None, similarity: float, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those near it) by the BK-tree over fingerprints, where sizes ``n`` allow a link and groups ``c``, which may change meanwhile, differ.

    With ``first`` the tree holds the first so many, and the others are only searched; without it each is searched among those before it.
    """
    tree, members = BKTree(), []
    for i, fp in enumerate(fps):
        if first is None or i >= first:
            near = np.array([m for at in tree.within(fp, radius) for m in members[at]], dtype=np.int64)
            near = near[(c[near] != c[i]) & (np.minimum(n[near], n[i]) >= similarity * np.maximum(n[near], n[i]) - 1e-9)]
            if len(near):
                yield i, near
        if first is None or i < first:
            at = tree.add(fp)
            if at == len(members):
                members.append([])
            members[at].append(i)


def sketch_links(fps: list[int], sketches: np.ndarray, n: np.ndarray, c: np.ndarray, first: int | None = None, similarity: float = SIMILARITY, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the candidates whose sketches (rows of ``sketches``) agree as those of linked texts do."""
    out, family, least = [], np.arange(len(fps)), least_agreement(similarity)
    for i, near in _candidates(fps, n, c, first, similarity, radius):
        near = near[family[near] != family[i]]
        for m in near[(sketches[near] == sketches[i]).sum(axis=1) >= least]:
            if family[m] != family[i]:
                out.append((int(m), i))
                family[family == family[m]] = family[i]
    return out


def tree_links(fps: list[int], own: list[np.ndarray], c: np.ndarray, first: int | None = None, similarity: float = SIMILARITY, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links between texts of different groups ``c``.

    The BK-tree over fingerprints names the candidates, their whole sets decide. ``first`` as for ``_candidates``.
    """
    c = np.unique(c, return_inverse=True)[1].copy()
    n = np.array([len(x) for x in own], dtype=np.int64)
    # shingles by number, so that an overlap is a count of marks
    _, flat = np.unique(np.concatenate(own), return_inverse=True)
    sets, marks = np.split(flat, np.cumsum(n)[:-1]), np.zeros(int(flat.max()) + 1, dtype=bool)
    out, groups = [], int(c.max()) + 1
    for i, near in _candidates(fps, n, c, first, similarity, radius):
        if groups == 1:
            break
        marks[sets[i]] = True
        both = np.add.reduceat(marks[np.concatenate([sets[m] for m in near])], np.r_[0, np.cumsum(n[near])[:-1]], dtype=np.int64)
        marks[sets[i]] = False
        for m in near[both >= similarity * (n[near] + n[i] - both) - 1e-9]:
            if c[m] != c[i]:
                out.append((int(m), i))
                c[c == c[m]] = c[i]
                groups -= 1
    return out


def _dealt(shards: DataFrame, nodes: int, shingles: int) -> DataFrame:
    """(band, i, j, side, rid, n, fp, c): ``shards`` (band, rid, n, fp, c), dealt so that nodes of different groups c meet in one (i, j).

    A shard's largest group needn't be compared with itself. Its other nodes are dealt to trees of bounded size, and each tree is searched for
    the nodes of the other trees, and of the largest group in parts of the same size.
    """

    def parts(what: Column) -> Column:
        return F.greatest(F.ceil(F.sum(F.when(what, 1).otherwise(0)) / nodes), F.ceil(F.sum(F.when(what, F.col("n")).otherwise(0)) / shingles)).cast("int")

    most = shards.groupBy("band", "c").count().groupBy("band").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    rows = settle(shards.join(most, "band").withColumn("other", F.col("c") != F.col("main")))
    sizes = rows.groupBy("band").agg(parts(F.col("other")).alias("k"), parts(~F.col("other")).alias("m"))
    rows = rows.join(settle(sizes), "band").withColumn("g", F.pmod(F.xxhash64("rid"), F.when(F.col("other"), F.col("k")).otherwise(F.col("m"))).cast("int"))
    # tree i meets the nodes j: those of a tree from i on, or after all trees a part of the largest group
    trees, g, k = F.sequence(F.lit(0), F.col("k") - 1), F.col("g"), F.col("k")
    spots = F.when(
        F.col("other"),
        F.concat(
            F.transform(F.filter(trees, lambda x: x < g), lambda x: F.struct(x.alias("i"), g.alias("j"), F.lit(1).alias("side"))),
            F.transform(F.sequence(g, k + F.col("m") - 1), lambda x: F.struct(g.alias("i"), x.alias("j"), F.lit(0).alias("side"))),
        ),
    ).otherwise(F.transform(trees, lambda x: F.struct(x.alias("i"), (k + g).alias("j"), F.lit(1).alias("side"))))
    return rows.withColumn("x", F.explode(spots)).select("band", F.col("x.i").cast("long").alias("i"), F.col("x.j").cast("long").alias("j"), F.col("x.side").alias("side"), "rid", "n", "fp", "c")


def _forests(dealt: DataFrame, links: Callable[[pa.Table, int | None], list[tuple[int, int]]]) -> DataFrame:
    """(u, v), distinct: what ``links`` finds for the rows of each (band, i, j) of ``dealt``, given also how many its tree holds, if not all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), t in _shards(batches, 3):
            t = t.sort_by([("side", "ascending"), ("rid", "ascending")])
            rid, side = t["rid"].to_numpy(), t["side"].to_numpy()
            found = links(t, None if i == j else int((side == 0).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([rid[x] for x, _ in found], pa.int64()), pa.array([rid[y] for _, y in found], pa.int64())], ["u", "v"])

    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return settle(dealt.mapInArrow(run, "u long, v long").distinct())


def _families(shards: DataFrame, sketches: DataFrame, similarity: float, nodes: int = TREE_NODES, shingles: int = TREE_SHINGLES) -> DataFrame:
    """(band, rid, n, fp, c): ``shards`` again, a node once, in its family, where the family fits FAMILY_TREES trees, and else in its shards.

    A family is what candidates with agreeing sketches (``sketches``: rid, sketch) reach. A node without one is left out.
    """

    def links(t: pa.Table, first: int | None) -> list[tuple[int, int]]:
        seen = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return sketch_links(t["fp"].to_numpy().view(np.uint64).tolist(), seen, t["n"].to_numpy(), t["c"].to_numpy(), first, similarity)

    dealt = _dealt(shards, nodes, shingles)
    group = components(_forests(dealt.join(sketches, "rid").select(*dealt.columns, "sketch"), links)).withColumnsRenamed({"node": "rid", "component": "family"})
    group = group.unionByName(group.select(F.col("family").alias("rid"), "family").distinct())
    members = settle(shards.select("rid", "n", "fp", "c").distinct().join(group, "rid"))
    large = members.groupBy("family").agg(F.count("*").alias("many"), F.sum("n").alias("all"))
    large = settle(large.where((F.col("many") > FAMILY_TREES * nodes) | (F.col("all") > FAMILY_TREES * shingles)).select("family"))
    once = members.join(large, "family", "left_anti").select(F.col("family").alias("band"), "rid", "n", "fp", "c")
    return settle(once.unionByName(shards.join(members.join(large, "family", "left_semi").select("rid"), "rid", "left_semi").select(*once.columns)))


def _trees(shards: DataFrame, sets: DataFrame, similarity: float, nodes: int = TREE_NODES, shingles: int = TREE_SHINGLES) -> DataFrame:
    """(u, v): links that connect whatever any links within a shard of ``shards`` (band, rid, n, fp, c) do, between groups c.

    A shard's tasks return forests and not pairs.
    """

    def links(t: pa.Table, first: int | None) -> list[tuple[int, int]]:
        own = [np.frombuffer(x, np.uint64) for x in t["own"].to_pylist()]
        return tree_links(t["fp"].to_numpy().view(np.uint64).tolist(), own, t["c"].to_numpy(), first, similarity)

    return _forests(_dealt(shards, nodes, shingles).join(sets, "rid").select("band", "i", "j", "side", "rid", "fp", "c", "own"), links)


def redundant(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id): those that aren't the least of their group. Texts without words are one group; rows that share a doc_id are in one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # the number of a row is given once and written; texts are found again by doc_id and digest
    each = _sketches(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text"), width)
    named = settle(each.groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("x")).select("digest", "x.doc_id", "x.rid"))
    # one doc_id may stand on rows of different texts
    spread = each.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    own = each.select("doc_id", "digest").join(spread, "doc_id", "left_semi").join(named.select("digest", "rid"), "digest")
    own = own.join(own.groupBy("doc_id").agg(F.min("rid").alias("u")), "doc_id").select("u", F.col("rid").alias("v"))
    found = settle(own.where("u <> v").distinct())

    # a node has a band once
    shards = each.join(named.select("rid"), "rid", "left_semi").select("rid", "n", "fp", F.explode("bands").alias("band"))
    shards = settle(shards.join(shards.groupBy("band").count().where("count > 1"), "band"))
    sets = _sets(rows, each, settle(named.join(shards.select("rid").distinct(), "rid", "left_semi").select("rid", "doc_id", "digest")), width)
    found = found.unionByName(_checked(_nearest(shards), sets, similarity))
    # of each shard that isn't in one group yet, whatever is alike
    group = components(found).withColumnsRenamed({"node": "rid", "component": "c"})
    shards = shards.join(group, "rid", "left").select("band", "rid", "n", "fp", F.coalesce("c", "rid").alias("c"))
    apart = shards.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("band")
    shards = settle(shards.join(apart, "band", "left_semi"))
    shards = _families(shards, each.select("rid", "sketch"), similarity)
    group = components(found.unionByName(_trees(shards, sets, similarity))).withColumnsRenamed({"node": "rid", "component": "c"})
    keep = named.join(group, "rid", "left").groupBy(F.coalesce("c", "rid").alias("c")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    return each.select("doc_id").join(keep, "doc_id", "left_anti").distinct()


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: that of its least doc_id.

    Where several rows have that doc_id, the least by text stays. Rows with a null doc_id can't be named as members of
    a group and stay. All columns are returned, whatever their names. An empty table gives an empty result.
    """
    drop = fresh(docs, "__drop")
    gone = settle(redundant(docs, width, similarity).select(F.col("doc_id").alias(drop)))
    return one_row_each(docs.join(gone, F.col("doc_id").cast("long") == F.col(drop), "left_anti"))
