import hashlib
import random

import pytest
from conftest import prose

from lakewright.llm import suffix_dedup as S


def brute_force(texts, size):
    seen, twice = set(), set()
    for t in texts:
        for p in range(len(t) - size + 1):
            x = t[p : p + size]
            (twice if x in seen else seen).add(x)
    out = []
    for t in texts:
        spans = []
        for p in range(len(t) - size + 1):
            if t[p : p + size] in twice:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + size
                else:
                    spans.append([p, p + size])
        left = b"".join(t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)], strict=True))
        out.append((len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return out


def check(df, size, **given):
    rows = df.select("doc_id", "text").collect()
    expected = brute_force([(r["text"] or "").encode() for r in rows], size)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = sorted(key((r["doc_id"], *x)) for r, x in zip(rows, expected, strict=True))
    got = S.remove_repeats(df, size, **given).collect()
    assert sorted(key((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 200)
    check(odd_docs, 60)
    assert S.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("doc_id", [7, None])
def test_thousands_of_rows_with_one_id_and_text(spark, doc_id):
    """Work and memory grow with the rows, not with their square."""
    rng = random.Random(9)
    text = prose(rng, 500)
    rows = [(doc_id, text)] * 6000 + [(1, "x" + text[400:]), (2, prose(rng, 80))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = S.remove_repeats(df).groupBy("doc_id", "n_removed", "n_spans", "kept_sha256").count().collect()
    assert sorted((r["doc_id"] or 7, r["n_removed"], r["n_spans"], r["count"]) for r in got) == [(1, len(text) - 400, 1, 1), (2, 0, 0, 1), (7, len(text), 1, 6000)]
    assert S.cut_repeats(df, n_chars_col=None).count() == 2


@pytest.mark.parametrize("group", [2048, 3])
def test_shared_passages(spark, group):
    """Passages with other text around them, nested repeats, periodic text;
    with a small group size every fingerprint is split."""
    rng = random.Random(6)
    long, short = prose(rng, 90), prose(rng, 20)
    texts = [prose(rng, rng.randint(5, 60)) + rng.choice(["", " "]) + rng.choice([long, long[: rng.randint(90, 400)], short, "ab" * 80, ""]) + prose(rng, 20) for _ in range(60)]
    rows = list(enumerate(texts))
    rows[3] = (2, rows[2][1])
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 80, group=group)


@pytest.mark.parametrize("group", [2048, 3])
def test_groups_equal_brute_force(spark, group):
    """Every window that repeats lies in a group whose occurrences are all of
    its places; a group's occurrences are equal strings, and not all of them
    can be extended to the left inside what was compared."""
    size = 80
    rng = random.Random(9)
    passage, short = prose(rng, 60), prose(rng, 25)
    texts = [prose(rng, 10) + f" {i} " + passage + f" {i} " + prose(rng, 10) for i in range(5)]
    texts += [prose(rng, 10) + rng.choice("xyz") + passage[k : k + 150] + rng.choice("xyz") + short + str(k) for k in range(0, 60, 7)]
    texts += ["ab" * 100, "ab" * 90 + "c", None, "", texts[0], "x" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    data = [(t or "").encode() for t in texts]
    places = {}
    for d, t in enumerate(data):
        for p in range(len(t) - size + 1):
            places.setdefault(t[p : p + size], set()).add((d, p))
    groups = {}
    for r in S.Repeats(rows, size, group=group).groups().collect():
        groups.setdefault((r["group_id"], r["length"]), set()).add((r["doc_id"], r["start"]))
    covering = {}
    for (_, length), at in groups.items():
        d, p = min(at)
        string = data[d][p : p + length]
        assert len(string) == length >= size and len(at) > 1 and all(data[d][p : p + length] == string for d, p in at)
        for shift in range(length - size + 1):
            covering.setdefault(string[shift : shift + size], []).append({(d, p + shift) for d, p in at})
    for window, at in places.items():
        if len(at) > 1:
            assert at in covering[window]
    assert all(len(places[w]) > 1 for w in covering)


def test_cut_repeats(odd_docs):
    cut = S.cut_repeats(odd_docs, 60)
    assert cut.columns == odd_docs.columns and cut.schema["n_chars"].dataType == odd_docs.schema["n_chars"].dataType
    before = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    rows = cut.collect()
    assert all(len(r["text"]) <= len(before[r["doc_id"]]) for r in rows)
    ids = [r["doc_id"] for r in rows]
    assert 3 in ids and 17 in ids and 6 not in ids and 10 in ids
    one = next(r for r in rows if r["doc_id"] == 10)
    assert 0 < len(one["text"]) < len(before[10]) and one["n_chars"] == len(one["text"])
