"""Every operator and stage takes nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from collections import Counter

import pytest

from quillgraph.llm import decontam, langid, packing, quality, secrets, simhash, suffixdedup, tokens
from quillgraph.llm.common import settle

from .conftest import ODD

BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None), (3, "..."), (None, "short item")]


def operators(bench):
    return {
        "simhash": simhash.query,
        "tokens": tokens.query,
        "secrets": secrets.query,
        "decontam": lambda d: decontam.query(d, bench),
        "packing": packing.query,
        "quality": quality.query,
        "langid": langid.query,
        "suffix": suffixdedup.query,
    }


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.mark.parametrize("name", list(operators(None)))
def test_a_row_for_each_row(docs, bench, name):
    found = operators(bench)[name](docs(ODD)).collect()
    ids = Counter(r["doc_id"] for r in found)
    if name == "packing":
        assert set(ids) == {i for i, _ in ODD}
    else:
        assert ids == Counter(i for i, _ in ODD)


@pytest.mark.parametrize("name", list(operators(None)))
def test_empty_table(docs, bench, name):
    assert operators(bench)[name](docs([])).count() == 0


def test_values_of_odd_rows(docs, bench):
    by = lambda rows: {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    fp = by(simhash.query(docs(ODD)).collect())
    assert fp[1]["fingerprint"] == fp[2]["fingerprint"] == fp[3]["fingerprint"] == "0" * 16
    assert fp[3]["component_id"] == 1 and fp[11]["component_id"] == 5
    lang = by(langid.query(docs(ODD)).collect())
    assert lang[1]["lang_pred"] == lang[9]["lang_pred"] == "und"
    size = by(tokens.query(docs(ODD)).collect())
    assert size[1]["n_bytes"] == size[1]["n_tokens"] == 0
    assert by(packing.query(docs(ODD)).collect())[1]["doc_tokens"] == 1
    kept = {r["doc_id"]: r for r in quality.query(docs(ODD)).collect()}
    assert not kept[1]["kept"] and kept[6]["n_repeat_words"] == 20000
    hit = by(decontam.query(docs(ODD), bench).collect())
    assert not any(r["contaminated"] for r in hit.values())


def stages(bench):
    return {
        "quality": quality.apply_rules,
        "simhash": simhash.drop_near_duplicates,
        "decontam": lambda d: decontam.remove_passages(d, bench),
        "secrets": secrets.mask,
    }


@pytest.mark.parametrize("name", list(stages(None)))
def test_stages_keep_the_columns(docs, bench, name):
    for rows in (ODD, []):
        given = docs(rows)
        out = settle(stages(bench)[name](given))
        assert out.columns == given.columns and dict(out.dtypes) == dict(given.dtypes)
        assert out.count() <= len(rows)
        for r in out.collect():
            assert r["text"] is None or r["n_chars"] == len(r["text"])


def test_near_duplicates_leave_one(docs):
    kept = simhash.drop_near_duplicates(docs(ODD)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 9, 10]
    assert sum(r["doc_id"] is None for r in kept) == 2


