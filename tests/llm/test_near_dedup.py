import random
from itertools import combinations

import pytest
from conftest import prose, words_of

from lakewright.llm import near_dedup as N
from lakewright.llm.near_dedup import NearDuplicates, components, keep_one, near_duplicates


def shingles(text, size=5):
    w = words_of(text)
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_force(rows):
    sets, up = {}, {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, set()).add(shingles(text))
        up[doc_id] = doc_id

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def check(df, **given):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    expected = brute_force([r for r in rows if r[0] is not None])
    got = NearDuplicates(df, **given).result().collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]) for r in got)
    assert sizes == sorted((i is None, i or 0, len(shingles(t))) for i, t in rows)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert near_duplicates(no_docs).count() == 0


def test_table(docs):
    check(docs)


def test_crowded_buckets(spark):
    """Copies of one text with edits of their own: many are linked with the
    original only, some with each other, some with nothing."""
    rng = random.Random(8)
    base = prose(rng, 150).split(" ")
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        text = list(base)
        for place in rng.sample(range(150), rng.randint(1, 7)):
            text[place] = f"w{i}x{place}"
        rows.append((i, " ".join(text)))
    twin = rows[-1][1].replace("w159", "w159", 1).split(" ")
    twin[3] = "other"
    rows.append((200, " ".join(twin)))
    rows += [(300 + i, prose(rng, 60) + " " + " ".join(base[:30])) for i in range(80)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_crowd_below_the_threshold_and_a_hub(spark, monkeypatch):
    """One text in many exact copies and hundreds of near ones, beside a crowd
    that shares two thirds of a text and is linked with nothing; with a filter
    that tells no documents apart, and few pairs for each copy of a set."""
    monkeypatch.setattr(N, "STAR", 7)
    rng = random.Random(12)
    base, other = prose(rng, 120).split(" "), prose(rng, 90)
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 350):
        text = list(base)
        text[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, other + " " + prose(rng, 45)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    check(df)
    check(df, filter_bits=64)


def test_ids_are_integers(spark):
    with pytest.raises(TypeError, match="doc_id is string"):
        near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_keep_one(odd_docs):
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    expected = brute_force([r for r in rows if r[0] is not None])
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in expected.items() if i == c})
    assert sum(i is None for i in ids) == 2


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
