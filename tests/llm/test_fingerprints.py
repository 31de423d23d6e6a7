"""One-permutation fingerprints against full shingle sets."""

import hashlib
import statistics

import pyarrow as pa
from conftest import prose, words_of

from lakewright.llm import queries as Q
from lakewright.llm.common import prepare, table
from lakewright.llm.fingerprints import BINS, BITS, Fingerprints, edit, edited, fingerprint


def shingles(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_registered_query(spark, sf_dir):
    rows = sorted(tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in Q.queries()["op12_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    by_text, errors = {}, []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert len(r["fingerprint"]) == (BINS * BITS // 4 if words_of(text) else 0)
        errors.append(r["near_edited"] - similarity(shingles(text), shingles(changed)))
        errors.append(r["near_next"] - similarity(shingles(text), shingles(following)))
    # the standard deviation of 256 bins at 0.5 is 0.033
    assert abs(statistics.mean(errors)) < 0.01 and statistics.pstdev(errors) < 0.033 and max(map(abs, errors)) < 0.16


def test_few_shingles_are_unbiased():
    """Texts of a few shingles, most bins filled by densification."""
    import random

    rng = random.Random(4)
    errors = []
    for _ in range(400):
        n = rng.randint(5, 14)
        a = prose(rng, n)
        b = a.rsplit(" ", rng.randint(1, n - 1))[0] + " " + prose(rng, rng.randint(1, 6))
        x, y = (Fingerprints.of(pa.array([t])) for t in (a, b))
        errors.append(float(x.likeness(y)[0]) - similarity(shingles(a), shingles(b)))
    assert abs(statistics.mean(errors)) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    prepare(spark)
    got = edited(odd_docs.repartition(4)).collect()
    assert len(got) == len(odd_docs.rows) and edited(no_docs).count() == 0
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 6)}
    assert by_id[0]["n_chars"] == by_id[1]["n_chars"] == 0 and by_id[0]["near_edited"] == by_id[0]["near_next"] == 1.0
    assert by_id[2]["near_next"] == 0.0  # white space beside a word
    assert by_id[7]["fingerprint"] == by_id[8]["fingerprint"] and by_id[7]["near_next"] == 1.0  # upper case
    assert by_id[4]["fingerprint"] == by_id[5]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    texts = {r["doc_id"]: r["fingerprint"] for r in fingerprint(odd_docs).collect()}
    assert all(texts[i] == r["fingerprint"] for i, r in by_id.items())
    alone = edited(odd_docs.where("doc_id = 10")).first()
    text = odd_docs.rows[10][1]
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(edit(text, text).encode()).hexdigest()
