import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import words_of
from pyspark.sql import functions as F

from lakewright.llm import language_id as L, lm_scoring as M, quality as Q, search as B
from lakewright.llm.common import Words, buffers, held_out, prepare, table


# ---------------------------------------------------------------- language id


def ppm_bits(text, counts, depth):
    """Plain prediction by partial matching, one byte at a time."""
    data = b"\n" * depth + text
    total = 0.0
    for i in range(depth, len(data)):
        for k in range(depth, -1, -1):
            followers = counts.get(data[i - k : i])
            if not followers:
                continue
            n, q = sum(followers.values()), len(followers)
            if data[i] in followers:
                total -= math.log2(followers[data[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


def test_code_lengths_equal_plain_ppm(spark):
    depth = 3
    corpus = {"aa": ["the cat sat", "a cat, a hat"], "bb": ["le chat noir é", "la hâte"]}
    rows = [(i, lang, t) for i, (lang, t) in enumerate((k, t) for k, v in corpus.items() for t in v)]
    trees = L.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"), depth=depth)
    counts = {k: defaultdict(Counter) for k in corpus}
    for lang, texts in corpus.items():
        for t in texts:
            data = b"\n" * depth + t.encode()
            for i in range(depth, len(data)):
                for k in range(depth + 1):
                    counts[lang][data[i - k : i]][data[i]] += 1
    probes = ["the chat", "zzz é", "", "a", "hâte cat\n" * 50]
    raw, offsets = buffers(pa.array(probes))
    got = np.zeros((len(probes), 2))
    for keys, starts, which in L.windows(raw, offsets, depth):
        np.add.at(got, which, trees.bits(keys, starts))
    want = [[ppm_bits(p.encode(), counts[k], depth) for k in ("aa", "bb")] for p in probes]
    assert np.allclose(got, want)


def test_language_id(docs, odd_docs, no_docs):
    trees = L.learn(docs.where(~held_out("doc_id", 4, 2)))
    found = L.identify(docs, trees, keep={"held_out": held_out("doc_id", 4, 2)}).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.held_out == found.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 4 == 2)).all()
    own = found[found.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.95
    odd = L.identify(odd_docs, trees).collect()
    assert len(odd) == len(odd_docs.rows)
    for r in odd:
        text = next(x[1] for x in odd_docs.rows if x[0] == r["doc_id"]) or ""
        if not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und" or r["doc_id"] is None
        assert 0 <= r["score"] <= 1
    assert L.identify(no_docs, trees).count() == 0
    assert L.learn(no_docs) is None
    assert {r["lang_pred"] for r in L.identify(odd_docs, None).collect()} == {"und"}


# -------------------------------------------------------------------- quality


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(1)
    m = Q.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    slots, values = np.array([1, 5, 9, 2]), np.array([0.5, -1.0, 2.0, 1.5])
    starts = np.array([0, 3, 3, 4])
    pairs = sum(m.v[slots[i]] @ m.v[slots[j]] * values[i] * values[j] for i in range(3) for j in range(i))
    want = [0.3 + m.w[slots[:3]] @ values[:3] + pairs, 0.3, 0.3 + m.w[2] * 1.5]
    assert np.allclose(m.raw(starts, slots, values), want)


def test_quality(spark, sf_dir, docs, odd_docs, no_docs):
    labels = table(spark, sf_dir, "labels")
    model = Q.train(docs, labels, ~held_out("doc_id", 5, 0))
    found = Q.score_quality(docs, model, keep={"held_out": held_out("doc_id", 5, 0)}).join(labels, "doc_id").toPandas()
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    good, bad = found[found.quality == 1].score, found[found.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.9
    odd = Q.score_quality(odd_docs, model).collect()
    assert len(odd) == len(odd_docs.rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert Q.score_quality(no_docs, model).count() == 0
    assert Q.train(docs, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in Q.score_quality(odd_docs, None).collect()} == {0.5}


# ----------------------------------------------------------------- LM scoring


def plain_losses(rows, is_target, vocabulary=None):
    """(target loss, background loss) of each text by counts of the words
    themselves, its own left out; None for texts without words."""
    texts = [["<s>", *words_of(text), "</s>"] for _, text in rows]
    texts = [t if len(t) > 2 else None for t in texts]
    pairs, words, histories = ([Counter(), Counter()] for _ in range(3))
    for (key, _), t in zip(rows, texts, strict=True):
        if t:
            m = 0 if is_target(key) else 1
            words[m].update(t[1:])
            histories[m].update(t[:-1])
            pairs[m].update(zip(t, t[1:]))
    size = vocabulary or len(words[0] | words[1])
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        if not t:
            out.append(None)
            continue
        both = []
        for m in (0, 1):
            own = t if is_target(key) == (m == 0) else []
            own_words, own_histories, own_pairs = Counter(own[1:]), Counter(own[:-1]), Counter(zip(own, own[1:]))
            total, loss = sum(words[m].values()) + size, 0
            for h, w in zip(t, t[1:]):
                p = (words[m][w] - own_words[w] + 1) / total
                one = -math.log2((pairs[m][h, w] - own_pairs[h, w] + M.PRIOR * p) / (histories[m][h] - own_histories[h] + M.PRIOR))
                assert one >= 0
                loss += one
            both.append(loss / (len(t) - 1))
        out.append(both)
    return out


def test_lm_scores_equal_plain_counts(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(6,), (9,), (None,), (9,)], "id long")
    rows = [(r[0], r[1]) for r in odd_docs.rows]
    want = plain_losses(rows, lambda i: i in (6, 9))
    got = defaultdict(list)
    for r in M.cross_entropy_difference(odd_docs, target).collect():
        got[r["doc_id"], r["n_tokens"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for row, loss in zip(rows, want, strict=True):
        for r in got[row[0], len(words_of(row[1]))]:
            if loss is None:
                assert r["score"] is None and r["target_loss"] is None
            else:
                assert r["target_loss"] == pytest.approx(loss[0], abs=1e-4) and r["background_loss"] == pytest.approx(loss[1], abs=1e-4)
                assert r["score"] == pytest.approx(r["target_loss"] - r["background_loss"], abs=1e-9)
    assert M.cross_entropy_difference(no_docs, target).count() == 0
    alone = plain_losses(rows, lambda i: False)
    for r in M.cross_entropy_difference(odd_docs.where("doc_id = 14"), target).union(M.cross_entropy_difference(odd_docs, target.limit(0)).where("doc_id = 10")).collect():
        if r["doc_id"] == 10:
            assert r["background_loss"] == pytest.approx(next(x[1] for x, row in zip(alone, rows, strict=True) if row[0] == 10), abs=1e-4)
        else:
            assert r["n_tokens"] == 20_000 and r["score"] is not None


@pytest.mark.parametrize("vocabulary", [1 << 16, None])
def test_lm_counts_are_exact_over_many_buckets(spark, monkeypatch, vocabulary):
    """More words than 2^15, some buckets, some hot words, more rows than one in
    a bucket, ids that are strings."""
    monkeypatch.setattr(M, "BUCKET", 40_000)
    monkeypatch.setattr(M, "HOT", 5)
    rng = random.Random(16)
    rows = [(f"d{i}", " ".join(rng.choice("abcdefgh") if rng.random() < 0.3 else f"w{rng.randrange(60_000)}" for _ in range(800))) for i in range(300)]
    target = spark.range(30).select(F.concat(F.lit("d"), "id"))
    got = M.cross_entropy_difference(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), target, vocabulary=vocabulary).collect()
    want = dict(zip((r[0] for r in rows), plain_losses(rows, lambda i: int(i[1:]) < 30, vocabulary), strict=True))
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        assert (r["target_loss"], r["background_loss"]) == pytest.approx(want[r["doc_id"]], abs=1e-4)


def test_lm_score_is_no_memory_of_the_text(spark):
    """Texts of the target and texts of the same kind outside it score alike."""
    rng = random.Random(8)
    kinds = [[f"{k}{i}" for i in range(400)] for k in "ab"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(200))) for i in range(200)]
    got = {r["doc_id"]: r["score"] for r in M.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), spark.range(0, 100, 2)).collect()}
    seen, unseen, other = [got[i] for i in range(0, 100, 2)], [got[i] for i in range(100, 200, 2)], [got[i] for i in range(1, 200, 2)]
    assert max(seen + unseen) < min(other)
    assert abs(np.mean(seen) - np.mean(unseen)) < 0.1 * (np.mean(other) - np.mean(unseen))


# --------------------------------------------------------------------- search


@pytest.mark.parametrize(("shard", "block"), [(4096, 64), (40, 3)])
def test_search_equals_exhaustive(docs, odd_docs, no_docs, shard, block):
    df = docs.select("doc_id", "text").union(odd_docs.where("doc_id is not null").select(F.col("doc_id") + 1000, "text"))
    rows = df.collect()
    bags = [Counter(words_of(r["text"])) for r in rows]
    n, avg = len(rows), sum(sum(b.values()) for b in bags) / len(rows)
    df_of = Counter(t for b in bags for t in b)
    want = {}
    for q, r in enumerate(rows):
        if r["doc_id"] % 50:
            continue
        scores = []
        for d, b in enumerate(bags):
            s = sum(
                f * math.log(1 + (n - df_of[t] + 0.5) / (df_of[t] + 0.5)) * b[t] * (B.K1 + 1) / (b[t] + B.K1 * (1 - B.B + B.B * sum(b.values()) / avg))
                for t, f in bags[q].items() if t in b
            )
            if s > 0:
                scores.append((-round(s, 6), rows[d]["doc_id"]))
        want[r["doc_id"]] = sorted(scores)[:10]
    got = defaultdict(list)
    for r in B.search_all(df, F.col("doc_id") % 50 == 0, shard_docs=shard, block_docs=block).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    for query, expected in want.items():
        found = sorted(got[query])
        assert len(found) == len(expected) and [x[0] for x in found] == list(range(1, len(found) + 1))
        assert all(abs(f[2] + e[0]) < 2e-6 for f, e in zip(found, expected, strict=True))
    assert B.search_all(no_docs, F.lit(True)).count() == 0
    few = odd_docs.where("doc_id in (0, 3, 4, 5, 6, 7, 12)")  # fewer results than k, or none
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in B.search_all(few, F.lit(True), shard_docs=shard, block_docs=block).collect())
    assert {x[0] for x in got} == {3, 4, 5, 6, 7, 12} and [x for x in got if x[0] == 12] == [(12, 1, 12)]
    assert {x[2] for x in got if x[0] == 3} == {3, 4, 5}


def test_search_segments_hold_alike_documents(spark):
    """A segment is opened once for each block of queries, so few large ones are wanted."""
    prepare(spark)
    texts = spark.range(0, 20_000, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 8), i -> concat(if(id % 2 = 0, 'a', 'b'), (id * i) % 40))) AS text")
    index = B.Index(texts)
    rows = index.table.select("ids").collect()
    kept = [np.frombuffer(r["ids"], "<i8") for r in rows]
    assert sorted(np.concatenate(kept).tolist()) == list(range(20_000))
    assert len(kept) <= 16 and all(len(set(x % 2)) == 1 for x in kept)


def test_search_tells_near_scores_apart(spark):
    """Scores that 32-bit floats don't tell apart keep their order."""
    words = " ".join(f"w{i}" for i in range(600))
    texts = [(0, words)] + [(d, f"{words} " + " ".join(["pad"] * (2000 + (d * 37) % 101))) for d in range(1, 102)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r["rank"], r["doc_id"], r["score"]) for r in B.search_all(df, F.col("doc_id") == 0).collect())
    order = sorted(range(1, 102), key=lambda d: (d * 37) % 101)
    assert [x[1] for x in got] == [0, *order[:9]] and len({x[2] for x in got}) == 10


def test_search_scores_few_pairs_anew(spark, monkeypatch):
    """Most pairs are dropped by the sums of 32-bit floats."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, int(rng.integers(20, 200))), 3000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = B.Index(df)
    block = B.Queries(index.queries(df.where("doc_id % 5 = 0").selectExpr("doc_id AS id", "text")).toArrow()).open()
    offered = []
    monkeypatch.setattr(B.Best, "offer", lambda self, query, ids, score, offer=B.Best.offer: offered.append(len(query)) or offer(self, query, ids, score))
    best = B.Best(np.zeros(len(block.ids)), 10)
    for row in index.table.collect():
        B.Segment(row.asDict(), index.words / index.n).search(block, best)
    assert len(best.result()[0]) == 10 * len(block.ids) and sum(offered) < 0.2 * len(block.ids) * index.n



def test_long_texts_are_cut_at_white_space():
    text = ("word " * 10 + "x" * 50 + "\n") * 200
    raw, offsets = buffers(pa.array([text, None, "a b"]))
    from lakewright.llm import common

    whole = Words(raw, offsets)
    cuts, owner = common.segments(raw, offsets, 100)
    assert len(cuts) > 50 and cuts[-1] == len(raw) and (np.diff(cuts) < 300).all() and owner[-1] == 2
    assert whole.count.tolist() == [2200, 0, 2]
