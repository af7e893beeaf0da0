"""The pipeline's stages against plain versions of what they decide."""

import collections

import corpus_pipeline
from quillgraph.llm import decontam, packing, secrets
from quillgraph.llm.common import settle, table

from .test_near_copies import kept

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = settle(stage(spark, docs, SF))
        seen.append(docs.collect())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    quality, near, clean, masked, packed = seen
    # near duplicates: the least doc_id of each group of what quality rules kept
    assert sorted(r.doc_id for r in near) == kept([(r.doc_id, r.text) for r in quality])
    windows = decontam.Windows([(str(r.item_id), decontam.words((r.text or "").encode())) for r in table(spark, SF, "benchmark").collect()])
    before = {r.doc_id: r.text for r in near}
    assert all(not windows.scan(decontam.words(r.text.encode()))[0] for r in clean)
    assert all(r.text == before[r.doc_id] for r in clean if not windows.scan(decontam.words(before[r.doc_id].encode()))[0])
    assert {r.doc_id for r in masked} == {r.doc_id for r in clean}
    model = secrets.Tokens(secrets.trained())
    assert not any(kind in ("access", "hex") for r in masked for *_, kind, _ in secrets.scan(model, r.text.encode())[1])
    encode, ids = packing.Encoder(), collections.defaultdict(list)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] += r.ids
    assert ids == {r.doc_id: [*encode(r.text.encode()), 0] for r in masked}
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
