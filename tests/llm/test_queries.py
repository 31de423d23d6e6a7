"""Every registered query of the training-data operators, as it is registered,
over the whole small tables, against its contract."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from test_near_dedup import brute_force as near_groups, shingles
from test_suffix_dedup import brute_force as repeats

from lakewright.llm import queries as Q
from lakewright.llm.common import table


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}


def run(spark, sf_dir, name):
    return Q.queries()[name](spark, sf_dir)


def bucket(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language(spark, sf_dir, rows):
    df = run(spark, sf_dir, "op1_language_id")
    assert dict(df.dtypes).items() >= {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}.items()
    got = df.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    langs = {r["lang"] for r in rows.values()} - {None}
    for r in got:
        letters = any(c.isalpha() for c in rows[r["doc_id"]]["text"] or "")
        assert r["held_out"] == (bucket(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in langs if letters else r["lang_pred"] == "und"
    held = [r for r in got if r["held_out"] and rows[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held) > 10


def test_quality(spark, sf_dir, rows):
    df = run(spark, sf_dir, "op10_quality")
    assert dict(df.dtypes).items() >= {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items()
    got = {r["doc_id"]: r for r in df.collect()}
    assert sorted(got) == sorted(rows)
    assert all(r["held_out"] == (bucket(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    labels = [(got[r["doc_id"]], r["quality"]) for r in table(spark, sf_dir, "labels").collect() if r["doc_id"] in got]
    good, bad = ([r["score"] for r, q in labels if q == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.8 * len(good) * len(bad)


def test_decontamination(spark, sf_dir, rows):
    found = run(spark, sf_dir, "op2_decontamination").collect()
    items = {r["item_id"]: r["text"] for r in table(spark, sf_dir, "benchmark").collect()}
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(pairs) == len(found) and all(0.4 <= r["similarity"] <= 1 for r in found)
    assert pairs >= {(i, t) for i, r in rows.items() for t, text in items.items() if text and text in (r["text"] or "")}


def test_suffix_dedup(spark, sf_dir, rows):
    df = run(spark, sf_dir, "op3_suffix_dedup")
    assert dict(df.dtypes).items() >= {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}.items()
    want = dict(zip(rows, repeats([(r["text"] or "").encode() for r in rows.values()], 200), strict=True))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()} == want


def test_warc(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, sf_dir, "pages").collect()}
    newest = {}
    for page_id, data in sorted(pages.items()):
        newest[data] = page_id
    df = run(spark, sf_dir, "op4_warc")
    assert dict(df.dtypes).items() >= {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}.items()
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}
    code = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert got == {i: (len(data), code(data), "response" if newest[data] == i else "revisit", None if newest[data] == i else newest[data]) for i, data in pages.items()}


def test_search(spark, sf_dir, rows):
    got = defaultdict(list)
    for r in run(spark, sf_dir, "op5_search").collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert set(got) <= {i for i in rows if i % 50 == 0} and got
    for found in got.values():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(found) + 1)) and len(found) <= 10
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))


def test_lm_scoring(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op6_lm_scoring").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)


def test_near_dedup(spark, sf_dir, rows):
    df = run(spark, sf_dir, "op7_near_dedup")
    assert dict(df.dtypes).items() >= {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}.items()
    want = near_groups((i, r["text"]) for i, r in rows.items())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()} == {i: (len(shingles(r["text"])), want[i], want[i] == i) for i, r in rows.items()}


def test_token_counts(spark, sf_dir, rows, tokenizer_json):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_json)
    df = run(spark, sf_dir, "op8_token_counts")
    assert dict(df.dtypes).items() >= {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}.items()
    want = {}
    for i, r in rows.items():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        want[i] = (len((r["text"] or "").encode()), n, n > 512)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect()} == want


def test_packing(spark, sf_dir, rows, tokenizer_json):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_json)
    df = run(spark, sf_dir, "op9_packing")
    assert dict(df.dtypes).items() >= {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}.items()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(pieces) == sorted(rows)
    total = 0
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(rows[i]["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 2048 for r in own[1:]) and (len(own) == 1 or len(ids) > 2048)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        total += at
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) * 1.02 + 1


def test_all_are_registered():
    names = Counter(name.split("_")[0] for name in Q.queries())
    assert names == Counter(f"op{n}" for n in range(1, 14))
