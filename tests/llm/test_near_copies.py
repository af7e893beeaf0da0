"""The pipeline's near-duplicates stage against the similarity of five-word shingles, by brute force."""

import random

import numpy as np

import corpus_pipeline
from quillgraph.llm import nearcopies, simhash

from .conftest import ODD


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Least ids of what links of similarity 0.8 or more reach; equal texts and rows of one id are linked too."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    group = {i: i for i, _ in sets}
    for _ in sets:
        before = dict(group)
        for i, a in sets:
            for j, b in sets:
                if i == j or a == b or 10 * len(a & b) >= 8 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    return sorted({group[i] for i in group})


def test_stage_drops_near_copies(spark, docs):
    rng, rows = random.Random(5), []
    for k in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((30, 120, 400)))]
        for c in range(5):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((10 * k + c, " ".join(text)))
    rng.shuffle(rows)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(rows, extra=False), "").collect())
    assert got == kept(rows)
    assert 40 < len(got) < 160


def test_odd_rows(spark, docs):
    df = docs(ODD)
    got = nearcopies.drop_near_copies(df)
    assert got.columns == df.columns
    found = [r.doc_id for r in got.collect()]
    assert found.count(None) == 2
    assert sorted(i for i in found if i is not None) == kept(ODD)
    assert nearcopies.drop_near_copies(docs([])).count() == 0


def test_a_filter_passes_all_its_ids_and_may_be_full(spark, monkeypatch):
    ids = np.r_[np.arange(0, 3000, 3), -5, 2**62].astype(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in ids], "doc_id long")
    words = nearcopies._filter(frame)
    assert nearcopies._passes(ids, words).all()
    others = np.arange(10_000, 30_000, dtype=np.int64)
    assert nearcopies._passes(others, words).mean() < 0.02
    small = nearcopies._filter(frame, most=64)
    assert len(small) == 1 and nearcopies._passes(ids, small).all()

    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:59], f"x{k}"])) for k in range(12)] + [(k, f"other text {k} " * 9) for k in range(12, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(r.doc_id for r in nearcopies.drop_near_copies(docs).collect())
    first = nearcopies._filter
    monkeypatch.setattr(nearcopies, "_filter", lambda ids: first(ids, most=64))
    assert sorted(r.doc_id for r in nearcopies.drop_near_copies(docs).collect()) == want
    assert want[0] == 0 and 1 not in want


def variants(many, changes, seed):
    """Texts that each differ from one base in a few words of their own: alike, but most of them by less than 0.8."""
    rng, base = random.Random(seed), [f"w{k}" for k in range(200)]
    rows = []
    for k in range(many):
        text = list(base)
        for _ in range(changes):
            text[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(text)))
    return rows


def test_what_is_alike_but_apart_makes_no_pairs(spark, docs, monkeypatch):
    rows, written = variants(300, 3, 3), []
    first = nearcopies.settle

    def settle(df):
        out = first(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "settle", settle)
    got = sorted(r.doc_id for r in nearcopies.drop_near_copies(docs(rows, extra=False)).collect())
    assert got == kept(rows)
    assert 1 < len(got) < 300
    # a row for each node and band at most, and not one for each of the 44,850 pairs
    assert max(written) <= (nearcopies.BANDS + 1) * len(rows)


def test_trees_of_a_crowded_shard_lose_no_link(spark):
    rows = variants(150, 4, 4)
    sets = [nearcopies.shingle_set(t.encode()) for _, t in rows]
    fps = nearcopies.majority(sets).view(np.int64).tolist()

    def joined(c, links):
        c = list(c)
        for u, v in links:
            c = [c[v] if x == c[u] else x for x in c]
        return [c.index(x) for x in c]

    c = [0 if k < 60 else k for k in range(150)]
    want = joined(c, [(i, j) for i in range(150) for j in range(i) if nearcopies.alike(sets[i], sets[j])])
    shards = spark.createDataFrame([(band, k, len(s), fps[k], c[k]) for band in (0, 1) for k, s in enumerate(sets)], "band long, rid long, n long, fp long, c long")
    own = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "rid long, own binary")
    for size in ({}, {"nodes": 7}, {"nodes": 40}, {"shingles": 2000}):
        links = [(r.u, r.v) for r in nearcopies._trees(shards, own, 0.8, **size).collect()]
        assert joined(c, links) == want
        assert all(nearcopies.alike(sets[u], sets[v]) and c[u] != c[v] for u, v in links)
    assert len(set(want)) < len(set(c))


def test_a_tree_finds_a_nearest_member():
    rng = random.Random(6)
    values = [rng.getrandbits(64) for _ in range(200)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:100]]
    tree = simhash.BKTree()
    for v in values:
        want = min(((w ^ v).bit_count() for w in tree.values), default=99)
        for radius in (1, 20, 64):
            at = tree.nearest(v, radius)
            assert at is None if want > radius else (tree.values[at] ^ v).bit_count() == want
        tree.add(v)


def test_candidates_come_from_trees_over_fingerprints(spark):
    rows = variants(60, 4, 7)
    sets = [nearcopies.shingle_set(t.encode()) for _, t in rows]
    frame = spark.createDataFrame([(k, k, t) for k, t in rows], "rid long, doc_id long, text string")
    each = nearcopies._sketches(frame, nearcopies.WIDTH)
    fps = {r.rid: r.fp for r in each.collect()}
    assert [fps[k] for k in range(60)] == simhash.majority([list(s) for s in sets]).view(np.int64).tolist()
    apart = lambda i, j: ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count()
    shards = each.selectExpr("1L as band", "60L as count", "rid", "fp")
    links = {r.v: r.u for r in nearcopies._nearest(shards).collect()}
    for k in range(60):
        least = min((apart(j, k) for j in range(k)), default=99)
        assert (least > nearcopies.RADIUS) == (k not in links)
        assert k not in links or links[k] < k and apart(links[k], k) == least
    # trees of bounded size: fewer links, all within the radius
    few = [(r.u, r.v) for r in nearcopies._nearest(shards, nodes=16).collect()]
    assert 0 < len(few) < len(links) and all(apart(u, v) <= nearcopies.RADIUS for u, v in few)


def test_the_radius_holds_what_is_similar():
    rng = np.random.default_rng(8)
    for n in (5, 10, 15, 45, 150):
        for _ in range(400):
            own = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            other = own[: -(-4 * n // 5)]
            a, b = (int(x) for x in simhash.majority([own, other]))
            assert nearcopies.alike(np.sort(own), np.sort(other)) and (a ^ b).bit_count() <= nearcopies.RADIUS


def test_sets_go_once_to_their_family_and_not_to_each_shard(spark, docs, monkeypatch):
    rows, sent = variants(300, 3, 3) + [(1000 + k, t.replace("w", "v")) for k, t in variants(60, 4, 9)], []
    first, families = nearcopies._trees, nearcopies._families

    def trees(shards, sets, similarity):
        sent.append((shards.count(), shards.select("rid").distinct().count()))
        return first(shards, sets, similarity)

    monkeypatch.setattr(nearcopies, "_trees", trees)
    want = kept(rows)
    assert sorted(r.doc_id for r in nearcopies.drop_near_copies(docs(rows, extra=False)).collect()) == want
    # families that are too large for their trees go by shard, with the same result
    monkeypatch.setattr(nearcopies, "_families", lambda *a: families(*a, nodes=4))
    assert sorted(r.doc_id for r in nearcopies.drop_near_copies(docs(rows, extra=False)).collect()) == want
    (once, nodes), (many, again) = sent
    assert once == nodes > 100
    assert again == nodes and many > 2 * nodes


def test_sketches_of_what_is_similar_agree():
    rng, least = np.random.default_rng(9), nearcopies.least_agreement()
    assert nearcopies.least_agreement(1.0) == nearcopies.BANDS * nearcopies.ROWS > least > 90

    def sketch(own):
        return np.frombuffer(nearcopies.sketch(nearcopies.minima(own)), np.uint8)

    for n in (5, 10, 45, 150):
        for _ in range(200):
            own = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            assert (sketch(own) == sketch(own[: -(-4 * n // 5)])).sum() >= least
            assert (sketch(own) == sketch(own[: n // 3])).sum() < least


def test_a_family_holds_every_link():
    rows = variants(150, 4, 4)
    sets = [nearcopies.shingle_set(t.encode()) for _, t in rows]
    fps, n = nearcopies.majority(sets).tolist(), np.array([len(s) for s in sets])
    sketches = np.stack([np.frombuffer(nearcopies.sketch(nearcopies.minima(s)), np.uint8) for s in sets])
    for first in (None, 70):
        family = list(range(150))
        for u, v in nearcopies.sketch_links(fps, sketches, n, np.arange(150), first):
            assert family[u] != family[v] and (first is None or u < first <= v)
            family = [family[v] if x == family[u] else x for x in family]
        linked = [(i, j) for i in range(150) for j in range(i) if (first is None or j < first <= i) and nearcopies.alike(sets[i], sets[j])]
        assert linked and all(family[i] == family[j] for i, j in linked)
