"""Each stage on the rows that its predecessor kept, against plain rules."""

import corpus_pipeline as P
import pytest
from test_near_dedup import brute_force
from test_suffix_dedup import brute_force as repeats

from lakewright.llm.common import release, shared_dir, stored, table, written


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        seen[name] = docs
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    first, second, third, fourth, last = (rows(seen[n]) for n, _ in P.STAGES)
    assert len(first) * 0.7 < len(second) < len(first)
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in second for i in good) >= 0.97 * len(good)
    groups = brute_force(second.items())
    assert set(third) == {i for i, c in groups.items() if i == c}
    found = repeats([t.encode() for t in third.values()], 200)
    for (i, text), (_, removed, spans, _) in zip(third.items(), found, strict=True):
        if removed == 0:
            assert fourth[i] == text
        elif i in fourth:  # narrowed to whole characters: at most three bytes at each end
            left = len(text.encode()) - len(fourth[i].encode())
            assert removed - 6 * spans <= left <= removed
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    assert not any(item in text for text in last.values() for item in items)
    assert set(fourth) - set(last) <= {i for i, t in fourth.items() if any(item[:40] in t or item[-40:] in t for item in items)}
    assert {r["doc_id"] for r in docs.collect()} == set(last)


@pytest.mark.parametrize("some", [True, False])
def test_stages_on_odd_rows(spark, sf_dir, odd_docs, no_docs, some):
    """Nulls, empty and long texts, repeated rows and an empty table."""
    docs = odd_docs if some else no_docs
    for name, stage in P.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf_dir), f"odd-{name}")
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    pieces = docs.collect()
    assert sorted({r["doc_id"] is None for r in pieces}) == ([False, True] if some else []) or not some
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in before.collect()}


def test_run_leaves_only_the_stages(spark, sf_dir):
    import os

    began = len(written(spark))
    result = P.run(spark, sf_dir)
    paths = written(spark)[began:]
    assert len(paths) == len(P.STAGES) and all(f"/stage-{name}-" in p for (name, _), p in zip(P.STAGES, paths, strict=True))
    assert result.count() > 0 and shared_dir(spark)
    release(spark, began)
    assert len(written(spark)) == began and not any(os.path.exists(p.removeprefix("file:")) for p in paths)
