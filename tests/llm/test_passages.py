"""Passages are cut alike, however many blocks the benchmark is dealt into."""

from quillgraph.llm import decontam


def test_blocks_cut_as_one(spark, docs):
    w = [f"w{i}" for i in range(1, 41)]
    items = [(k, " ".join(w[5 * k : 5 * k + 10])) for k in range(4)] + [(9, "a b c d e f g h i j")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    # overlapping passages; words that are a window only where a passage between them is gone; few words left; none cut
    rows = [(1, "start " + " ".join(w[:25]) + " end"), (2, "a b c d e " + " ".join(w[:10]) + " f g h i j and more"), (3, " ".join(w[:20])), (4, " ".join(w[30:])), (5, None), (6, "")]
    df = docs(rows)
    block = 100
    dealt = [{i for i, _ in b} for b in decontam.blocks(bench, block_bytes=block)]
    assert sum(map(bool, dealt)) > 2
    for least in (1, 4):
        one, many = (sorted((r.doc_id, r.text, r.n_chars) for r in decontam.remove_passages(df, bench, least_words=least, block_bytes=b).collect()) for b in (decontam.BLOCK_BYTES, block))
        assert many == one
    assert decontam.remove_passages(df, bench, block_bytes=block).columns == df.columns
    text = {r.doc_id: r.text for r in decontam.remove_passages(df, bench, block_bytes=block).collect()}
    assert text[1] == "start  end" and text[2] == "a b c d e  f g h i j and more" and 3 not in text
    hit = {r.doc_id: r.n_hit for r in decontam.query(df, bench, block_bytes=block).collect()}
    assert hit[1] == 25 and hit[2] == 10
