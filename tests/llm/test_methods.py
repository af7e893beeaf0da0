"""The methods themselves against plain versions: trees, tagging, decoding, codewords, blocks."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from quillgraph.llm import decontam, htmltext, langid, quality, secrets, suffixdedup, tokens, urls
from quillgraph.llm.common import settle, table
from quillgraph.llm.crf import LinearChainCRF

from .conftest import ODD
from .credentials import texts
from .test_against_brute_force import brute_repeats

# ---------------------------------------------------------------- url templates


def shape(s):
    m = re.search(r"\.[A-Za-z]{2,5}$", s)
    end = m[0] if m else ""
    stem = s[: len(s) - len(end)] if end else s
    if re.fullmatch("[0-9]+", stem):
        return "{n}" + end
    if re.fullmatch("[0-9A-Fa-f-]{8,}", stem) and re.search("[0-9]", stem):
        return "{x}" + end
    if len(stem) > 24 or re.search("[0-9].*[0-9]", stem):
        return "{s}" + end
    return s


def plain_tree(rows):
    """page_id -> (branch, purity, rejected) of (page_id, host, path, rule's verdict)."""
    wild = lambda s: re.match(urls.WILD, s)
    seg = {}
    for i, _, path, _ in rows:
        s = [x for x in path.split("/") if x]
        seg[i] = [shape(x) for x in (s if len(s) <= urls.SEGMENTS else [*s[: urls.SEGMENTS - 1], "/".join(s[urls.SEGMENTS - 1 :])])]
    t = {i: [] for i in seg}
    for k in range(max(map(len, seg.values()))):
        children = collections.defaultdict(collections.Counter)
        for i, host, *_ in rows:
            if len(seg[i]) > k:
                children[host, tuple(t[i])][seg[i][k]] += 1
        before = {i: tuple(x) for i, x in t.items()}
        for i, host, *_ in rows:
            if len(seg[i]) > k:
                c = children[host, before[i]]
                t[i].append("{*}" if len(c) > urls.CROWDED and sum(c.values()) < urls.REPEATS * len(c) else seg[i][k])

    def branches(x):
        s = [v if wild(v) else urls.NAME + (re.search(r"(\.[A-Za-z]{2,5})?$", v)[0]) for v in x]
        return [(m, "/" + "/".join([*x[:m], *s[m:]])) for m in range(len(x), -1, -1) if m == len(x) or not wild(x[m])]

    sums = collections.defaultdict(lambda: [0, 0])
    for i, host, _, says in rows:
        for b in branches(t[i]):
            sums[host, b][0] += says == "block"
            sums[host, b][1] += says is not None
    out = {}
    for i, host, *_ in rows:
        now = None
        for b in branches(t[i]):
            blocked, labelled = sums[host, b]
            p = (blocked + urls.SMOOTH * urls.NEUTRAL) / (labelled + urls.SMOOTH)
            if now and abs(now[0] - p * now[1]) > urls.ALIKE * (p * (1 - p) * now[1]) ** 0.5:
                break
            now = blocked, labelled, p, b[1]
        out[i] = now[3], round(now[2], 6), now[1] > 0 and now[2] > urls.BLOCK_ABOVE
    return out


def test_url_tree(pages):
    r = random.Random(6)
    u = [f"http://shop.net/es/{i}" for i in range(60)] + [f"http://shop.net/de/{i}" for i in range(60)] + [f"http://shop.net/news/{i}/x.html" for i in range(20)]
    u += [f"http://mix.example.com/{r.choice(['en', 'fr'])}/{i}" for i in range(80)] + [f"http://mix.example.com/{x}" for x in ("en", "en/", "about")]
    # differences at the fifth segment; crowded nodes, one below another; very deep and very long paths; repeated page_ids
    u += [f"http://deep.net/es/a/b/c/{x}/{i}" for x in ("d", "e") for i in range(15)] + [f"http://deep.net/de/a/b/c/{x}/p{i}" for x in ("d", "e") for i in "abc"]
    u += [f"http://wide.org/{a}{b}/{c}{d}" for a, b, c, d in itertools.product("abcdefgh", "ijklmnop", "qr", "st")]
    u += ["http://long.net/es/" + "/".join("ab" * (k % 3 + 1) for k in range(100)), "http://long.net/es/" + "x" * 20_000, "http://long.net/" + "/a" * 5_000, "http://long.net/" + "/a" * 5_000 + "/b", None, "", "no url", "http://{w}/{n}/{*}"]
    rows = [(i, x, None) for i, x in enumerate(u)]
    found = {x.page_id: x for x in urls.query(pages(rows)).collect()}
    assert set(found) == set(range(len(u)))
    want = plain_tree([(i, x.host, x.path, x.verdict if x.rule else None) for i, x in found.items()])
    assert {i: (x.template, x.purity) for i, x in found.items()} == {i: want[i][:2] for i in found}
    assert all(x.verdict == ("block" if want[i][2] else "allow") for i, x in found.items() if x.rule is None)
    by = lambda a: {x.verdict for i, x in found.items() if u[i] and a in u[i]}
    assert by("shop.net/es/") == by("shop.net/de/") == {"block"} and by("shop.net/news/") == {"allow"} and by("mix.example.com/fr/") == {"allow"}
    assert by("deep.net/de/") == {"allow"} and len({x.template for i, x in found.items() if u[i] and "deep.net/de/" in u[i]}) >= 1
    assert sum(x.rule is None and x.verdict == "block" for x in found.values()) >= 60


def test_pages_with_clashing_columns_and_repeats(spark, pages):
    from pyspark.sql import functions as F

    rows = [(1, "http://a.net/es/1", "<p>One line of text.</p>"), (1, "http://a.net/es/1", "<p>One line of text.</p>"), (None, None, None)]
    df = pages(rows)
    for name in ("host", "path", "seg", "t", "m", "branch", "rule", "text", "n_chars", "p", "wild", "n", "a.b"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted((x.page_id or 0, x.verdict) for x in urls.query(df).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert sorted(x.page_id or 0 for x in htmltext.query(df).collect()) == [0, 1, 1]


# ---------------------------------------------------------------- tagging


@pytest.fixture(scope="module")
def tagger():
    return secrets.trained()


def test_viterbi_and_gradient_by_enumeration():
    r = np.random.default_rng(1)
    model = LinearChainCRF(3, 40, forbidden=((2, 1),), not_first=(1,))
    model.weights, model.moves, model.first, model.last = r.normal(size=(40, 3)), r.normal(size=(3, 3)), r.normal(size=3), r.normal(size=3)
    model.weights[0] = 0
    allowed = lambda t: t[0] != 1 and (2, 1) not in itertools.pairwise(t)
    score = lambda e, t: model.first[t[0]] + model.last[t[-1]] + sum(e[i, x] for i, x in enumerate(t)) + sum(model.moves[a, b] for a, b in itertools.pairwise(t))
    some = []
    for n in (1, 2, 3, 5, 6):
        rows = r.integers(0, 40, (n, 4)).astype(np.int32)
        every = [t for t in itertools.product(range(3), repeat=n) if allowed(t)]
        e = model.emissions(rows)
        assert tuple(model.decode(e)) == max(every, key=lambda t: score(e, t))
        some.append((rows, np.array(every[int(r.integers(len(every)))])))

    def likelihood():
        total = 0.0
        for rows, t in some:
            e = model.emissions(rows)
            total += score(e, tuple(t)) - np.logaddexp.reduce([score(e, p) for p in itertools.product(range(3), repeat=len(t)) if allowed(p)])
        return total

    _, diff, g = model._gradient(some)
    for a, b in ((0, 1), (1, 1), (2, 0)):
        model.moves[a, b] += 1e-5
        up = likelihood()
        model.moves[a, b] -= 2e-5
        assert abs((up - likelihood()) / 2e-5 - g[a, b]) < 1e-4
        model.moves[a, b] += 1e-5
    html_model = htmltext.LinearChainCRF(2, 8)
    html_model.moves, html_model.first, html_model.last = r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=2)
    for n in (1, 2, 7):
        e = r.normal(size=(n, 2))
        assert htmltext._viterbi2(e.tolist(), html_model) == html_model.decode(e)


def test_tagging_by_stretches_is_viterbi_over_all_tokens(spark, tagger):
    known = secrets.Tokens(tagger)
    given = [t for t, _ in secrets.labelled(300, 5)] + [x.text for x in table(spark, "/root/testdata/sf0.001", "documents").collect() if x.text] + [x for x, *_ in texts(200)]
    for text in given:
        words = secrets._TOKEN.findall(text)
        if not words:
            continue
        emit = known.emissions(known.numbers(words))
        want = tagger.model.decode(emit)
        assert secrets.labels(known, words) == [(i, x) for i, x in enumerate(want) if x != secrets.OUTSIDE]
    for text in given[:60]:
        words = secrets._TOKEN.findall(text)
        assert np.allclose(known.emissions(known.numbers(words)), [tagger.weights(x) for x in secrets.feature_names(words)])


def test_tagger_on_held_out_forms(spark, tagger):
    known, hit, wrong, n = secrets.Tokens(tagger), 0, 0, 500
    for text, a, b in texts(n):
        _, base, every = secrets.scan(known, text.encode())
        hit += any(s[3] <= a and b <= s[1] for s in every)
        wrong += sum(s[2] == "tagged" and not (s[0] < b and a < s[1]) for s in every)
    assert hit >= 0.95 * n and wrong <= 0.01 * n
    own = hits = bad = 0
    for text, spans in secrets.labelled(300, seed=77):
        found = set(secrets.tag(known, text))
        own, hits, bad = own + len(spans), hits + len(found & set(spans)), bad + len(found - set(spans))
    assert hits >= 0.95 * own and bad <= 0.02 * own
    for text, value in (("key: abcdefghijABCDEFGHIJklmnop", 5), ("Authorization: Bearer QWERTYuiopASDFghjkZXCVbnmQ", 22), ("xoxb-ABCDEFGHIJKLMNOPQRST", 0), ("pwd: correcthorsebattery", 5)):
        assert secrets.tag(known, text) == [(value, len(text))]
    clean = table(spark, "/root/testdata/sf0.01", "documents").collect()
    assert sum(len(secrets.tag(known, x.text)) > 0 and not secrets.base_spans(x.text, x.text.encode()) for x in clean if x.text) <= 2


# ---------------------------------------------------------------- codewords


def test_decoding_of_codewords_by_hand(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    codes = langid.train(df)
    given = [x.text.encode() for x in df.collect() if x.text and re.search(r"[^\W\d_]", x.text)][:60]
    for text, (lang, score, close) in zip(given, codes.predict(given), strict=True):
        b = b" ".join([b"", *text.translate(langid._FOLD).split(), b""])
        seen = collections.Counter()
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                x = int.from_bytes(b[i : i + n], "little")
                seen[(((x + (n - 1) * 0x51ED27) * 2654435761) & 0xFFFFFFFF) >> (32 - 13)] += 1
        total = sum(seen.values())
        margin = codes.bias.astype(float).copy()
        for h, k in seen.items():
            margin += np.sqrt(k / total) * codes.weights[h]
        loss = [np.mean([np.log1p(np.exp(-(2 * bit - 1) * m)) for bit, m in zip(word, margin, strict=True)]) for word in codes.words]
        best = int(np.argmin(loss))
        ranked = sorted(loss)
        assert lang == codes.languages[best]
        assert abs(score - 1 / sum(np.exp(-len(margin) * (x - loss[best])) for x in loss)) < 1e-3
        assert close == (ranked[1] - ranked[0] < langid.CLEAR) or abs(ranked[1] - ranked[0] - langid.CLEAR) < 1e-4


def test_every_language_is_learned(docs):
    r = random.Random(9)
    syllables = {f"L{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(3)) for _ in range(12)] for k in range(80)}
    rows = []
    for k, (lang, s) in enumerate(syllables.items()):
        rows += [(1000 * k + i, " ".join(r.choice(s) + r.choice(s) for _ in range(60 if lang != "L05" else 9000)), lang, "s") for i in range(16)]
    rows += [(10**6 + i, rows[0][1], "L00", "s") for i in range(500)]  # a text with very many copies
    rows += [(2 * 10**6, None, "L00", "s"), (2 * 10**6 + 1, "12 34 !", "L00", "s")]
    found = {x.doc_id: x for x in langid.query(docs(rows)).collect()}
    out = [i for i, t, lang, _ in rows if i < 10**6 and found[i].held_out]
    lang = {i: x for i, _, x, _ in rows}
    assert len(out) > 200 and sum(found[i].lang_pred == lang[i] for i in out) >= 0.97 * len(out)
    assert {found[i].lang_pred for i in out} == set(syllables)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (2 * 10**6, 2 * 10**6 + 1))
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == x.held_out for i, x in found.items())
    few = langid.sample(docs(rows), per_language=5).groupBy("lang").count().collect()
    assert len(few) == 80 and max(x["count"] for x in few) == 5


# ---------------------------------------------------------------- benchmark items, lines, blocks


def test_items_and_words_of_any_length(spark, docs):
    long = " ".join(f"word{i}" for i in range(3000))
    huge = "z" * 5000
    bench = spark.createDataFrame([(1, long), (2, f"a {huge} b"), (None, "lone item"), (3, "")], "item_id long, text string")
    rows = [(1, " ".join(f"word{i}" for i in range(1490, 1520))), (2, f"x A {huge.upper()} B y"), (3, f"a {huge}z b"), (4, "a lone item here"), (5, " ".join(f"word{i}" for i in range(2991, 3000))), (6, long)]
    want = {1: (30, 1, "1"), 2: (3, 1, "2"), 3: (0, 0, ""), 4: (2, 1, ""), 5: (0, 0, ""), 6: (3000, 1, "1")}
    for block in (decontam.BLOCK_BYTES, 4000, 300):
        found = {x.doc_id: (x.n_hit, x.n_items, x.items_sha256) for x in decontam.query(docs(rows), bench, block_bytes=block).collect()}
        assert found == {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for i, (a, b, c) in want.items()}
        left = {x.doc_id: x.text for x in decontam.remove_passages(docs(rows), bench, block_bytes=block).collect()}
        assert left == {2: "x  y", 3: f"a {huge}z b", 4: "a  here", 5: rows[4][1]}


def test_lines_meet_rows_alike_by_broadcast_and_by_join(docs):
    note = "all rights reserved by the owner of this site " * 6
    rows = [(1000 + i, f"{' '.join(f'w{i}x{k}' for k in range(80))}\n{note}\nline {i % 3} of many words and more", "en", "st"[i % 2]) for i in range(120)]
    rows += [(200 + i, f"{note}\n{note}\n{note} {i}", "en", "s") for i in range(3)] + ODD
    one, two = (sorted(map(str, quality.judge(docs(rows), sent_lines=n).collect())) for n in (quality.SENT_LINES, 0))
    assert one == two and len(one) == len(rows)
    one, two = (sorted(map(str, quality.apply_rules(docs(rows), sent_lines=n).collect())) for n in (quality.SENT_LINES, 0))
    assert one == two
    found = {x.doc_id: x for x in quality.judge(docs(rows)).collect()}
    assert all(found[1000 + i].kept for i in range(120)) and all(not found[200 + i].kept for i in range(3))


def test_repeats_in_small_blocks_units_and_chunks(spark):
    r = random.Random(12)
    passages = ["".join(r.choice("abcde ") for _ in range(r.randint(40, 200))) for _ in range(12)]
    given = ["".join(r.choice("abcdefghij") for _ in range(r.randint(0, 120))) + r.choice(passages) + r.choice(passages)[:90] for _ in range(120)]
    given += given[:10] + ["", "x" * 3000, "x" * 3000, "xy" * 900]
    rows = list(enumerate(given)) + [(5, given[7]), (None, given[3]), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    own = [(i if i is not None else -1, (t or "").encode()) for i, t in rows]

    def brute():
        first = {}
        for i, t in own:
            if i >= 0:
                for k in range(len(t) - 49):
                    first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
        out = []
        for i, t in own:
            gone = np.zeros(len(t), dtype=bool)
            for k in range(len(t) - 49 if i >= 0 else 0):
                if first[t[k : k + 50]] < i:
                    gone[k : k + 50] = True
            out.append((i, len(t), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
        return sorted(out)

    want = brute()
    for block, unit, symbols in ((suffixdedup.BLOCK_BYTES, suffixdedup.UNIT_BYTES, suffixdedup.SHARD_SYMBOLS), (700, 2000, 500), (1, 1, 1)):
        found = suffixdedup.remove_repeats(df, False, block_bytes=block, unit_bytes=unit, shard_symbols=symbols).collect()
        assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_bytes, x.n_removed, x.kept_sha256) for x in found) == want
    a, b = (suffixdedup.runs([t for _, t in own], chunk=c) for c in (1 << 20, 97))
    windows = lambda x: sorted((n, o, f + k) for n, o, f, c in zip(*map(np.ndarray.tolist, x), strict=True) for k in range(c))
    assert windows(a) == windows(b)
    df.unpersist()


def test_runs_of_long_texts_need_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(3)
    text = r.integers(97, 123, 20_000_000, dtype=np.uint8).tobytes()
    tracemalloc.start()
    name, *_ = suffixdedup.runs([text])
    assert len(name) > 1_000_000 and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_results_do_not_hang_on_how_files_are_cut(spark, tmp_path):
    """Partitions that change between building and running a query, as they do where executors come and go."""
    df = table(spark, "/root/testdata/sf0.001", "documents")
    path = str(tmp_path / "documents.parquet")
    df.repartition(6).write.parquet(path)
    bench = table(spark, "/root/testdata/sf0.001", "benchmark")
    given = spark.read.parquet(path)
    known = {"spark.sql.files.minPartitionNum": None, "spark.sql.files.maxPartitionBytes": None}

    def cut(parts, size):
        spark.conf.set("spark.sql.files.minPartitionNum", str(parts))
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)

    queries = {
        "op2": tokens.query, "op5": lambda d: decontam.query(d, bench, block_bytes=2000), "passages": lambda d: decontam.remove_passages(d, bench, block_bytes=2000), "op7": quality.query, "stage": quality.apply_rules, "op9": suffixdedup.query,
    }
    try:
        for name, f in queries.items():
            cut(4, "128m")
            want = sorted(map(str, f(given).collect()))
            built = f(given)
            cut(12, "20k")
            assert sorted(map(str, built.collect())) == want, name
    finally:
        for k in known:
            spark.conf.unset(k)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixdedup.query(given).collect()} == brute_repeats([(x.doc_id, (x.text or "").encode()) for x in given.collect()])


# ---------------------------------------------------------------- pages


PAGE = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>On sums</h1><p>The formula <math>x=2</math> holds for all.</p><p>Some more words of the article stand here.</p>{}<p>And the last one of the page ends it.</p></article><footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize(("inside", "text"), [
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"), ("<video src=x><p>A transcript of the whole talk that is long.</p></video>", "A transcript of the whole talk that is long."), ("<object data=x><p>Fallback words of an object in the text.</p></object>", "Fallback words of an object in the text."),
    ("<svg><title>Icon</title><text>Axis of time</text><style>a{}</style></svg>", "Axis of time"), ("<p>A curve <svg><path d=1 /><text>of noise</text></svg> is seen.</p>", "A curve of noise is seen."), ("<noscript><p>This chart shows how sums grow over time.</p></noscript>", "This chart shows how sums grow over time."),
    ("<template><p>A row of a template with words.</p></template>", "A row of a template with words."), ("<p>Half <math><mi>y</p><p>closed.</p>", "Half y\nclosed."), ("<script>var x = '<p>no</p>';</script><style>p{}</style>", ""),
])
def test_article_content_is_kept(inside, text):
    want = ["On sums", "The formula x=2 holds for all.", "Some more words of the article stand here.", *filter(None, [text]), "And the last one of the page ends it."]
    assert htmltext.Extractor(htmltext.trained())(PAGE.replace("{}", inside, 1)) == "\n".join(want)


def test_one_row_of_each_doc_id(docs):
    from quillgraph.llm import nearcopies, simhash

    rows = [(1, "b " * 9), (1, "a " * 9), (2, "c d e f g"), (None, "c d e f g"), (2, "c d e f g")]
    for f in (nearcopies.drop_near_copies, simhash.drop_near_duplicates):
        for given in (rows, rows[::-1]):
            assert sorted((x.doc_id or 0, x.text) for x in settle(f(docs(given))).collect()) == [(0, "c d e f g"), (1, "a " * 9), (2, "c d e f g")]
