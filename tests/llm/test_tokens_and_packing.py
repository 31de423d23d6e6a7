import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakewright.llm.packing import Encoder, best_fit_decreasing, lower_bound, pack, pack_documents
from lakewright.llm.token_counts import Counter, count_tokens


@pytest.fixture(scope="module")
def library(tokenizer_json):
    return Tokenizer.from_file(tokenizer_json)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_and_ids_equal_the_library(tokenizer_json, library):
    rng = random.Random(1)
    alphabet = "ab c\t\n  '’sTre²½٣漢字é_-!<|endoftext|>\x1c\x85\xa0 ́ⅷ\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, "<|endoftext|>", "x  <|endoftext|>  y", "", None, " " * 300_000 + "x", "ab cd ef " * 40_000, "aaaa aaa aa"]
    content = open(tokenizer_json, encoding="utf-8").read()
    expected = [ids(library, t) for t in texts]
    assert Counter(content).count(texts).tolist() == [len(x) for x in expected]
    encoder = Encoder(content)
    assert all(encoder.encode(t or "").tolist() == x for t, x in zip(texts, expected, strict=True))


def test_token_counts_on_odd_rows(odd_docs, no_docs, docs, tokenizer_json, library):
    for df in (odd_docs, docs):
        expected = sorted(((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), len(ids(library, r["text"]))) for r in df.collect()))
        got = count_tokens(df, tokenizer_json).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert count_tokens(no_docs, tokenizer_json).count() == 0


def test_packing(odd_docs, no_docs, tokenizer_json, library):
    capacity = 256
    rows = pack_documents(odd_docs, tokenizer_json, capacity).collect()
    fill, texts = defaultdict(list), defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():  # gapless from 0, within the capacity
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for r in odd_docs.collect():
        texts[r["doc_id"]].append(np.array([*ids(library, r["text"]), 0], "<u4"))
    for doc_id, arrays in texts.items():
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc_id)
        expected = []
        for x in arrays:
            at, k, size = 0, 0, len(x) % capacity or min(capacity, len(x))
            while at < len(x):
                expected.append((k, at, size, zlib.crc32(x[at : at + size].tobytes())))
                at, k, size = at + size, k + 1, capacity
        assert own == sorted(expected)
    total = sum(r["length"] for r in rows)
    assert len(fill) <= -(-total // capacity) + 1
    assert pack_documents(no_docs, tokenizer_json, capacity).count() == 0


def test_exchange_between_groups(spark):
    """Many small groups: leftovers meet in later rounds."""
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.randint(1, 700), i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = pack(pieces, 1000, group_pieces=30).toPandas()
    assert len(packed) == len(rows)
    bins = packed.groupby("sequence_id").length.sum()
    assert bins.max() <= 1000
    alone = sum(best_fit_decreasing(np.array([r[3] for r in rows[i : i + 30]]), 1000).max() + 1 for i in range(0, 3000, 30))
    assert packed.length.sum() / 1000 <= len(bins) < alone


def test_bounds_are_bounds():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins = best_fit_decreasing(lengths, 100)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= 100 and (fill > 0).all()
        assert -(-lengths.sum() // 100) <= lower_bound(lengths, 100) <= len(fill)
    assert lower_bound(np.array([51, 51, 51]), 100) == 3
