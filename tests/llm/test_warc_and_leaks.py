import random

import pytest
from conftest import prose, words_of
from pyspark.sql import functions as F

from lakewright.llm import decontamination as D, warc as A
from lakewright.llm.common import prepare

PAGES = "page_id long, url string, html string, payload string"


def test_round_trip(spark, tmp_path):
    prepare(spark)
    rows = [(i, f"https://x/{i}", f"<p>{'é' * (i % 7)} {i % 11}</p>", None) for i in range(300)]
    rows += [(500, None, None, "x"), (501, "a\r\nb", "", None), (502, "u", "z" * 300_000, None), (None, "n", rows[5][2], None), (299, "again", rows[299][2], None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    folder = A.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=4000)
    listed = {r["name"]: r for r in spark.read.parquet(f"{folder}/_archives").collect()}
    assert len(listed) > 3 and sum(r["records"] for r in listed.values()) == len(rows)
    assert {f.name for f in (tmp_path / "w").glob("*.zst") if f.name[0] != "."} == set(listed)
    assert all((tmp_path / "w" / name).stat().st_size == r["bytes"] for name, r in listed.items())
    (tmp_path / "w" / ".lost.warc.zst").write_bytes(b"left by a task that was repeated")
    records = A.read_archives(spark, folder)
    assert records.count() == len(rows)
    newest = {}
    for page_id, _, html, _ in rows:
        newest[html or ""] = max(newest.get(html or "", -1), -1 if page_id is None else page_id)
    want = sorted((i is None, i or 0, len((h or "").encode()), A.digest((h or "").encode()), "response" if i == newest[h or ""] else "revisit", -1 if i == newest[h or ""] else newest[h or ""]) for i, _, h, _ in rows)
    got = A.resolve(records).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in got) == want
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in records.where("record_type = 'response'").collect()}
    assert payloads[502] == "z" * 300_000
    assert A.resolve(A.read_archives(spark, A.write_archives(pages.limit(0), f"file://{tmp_path}/e"))).count() == 0
    with pytest.raises(TypeError):
        A.write_archives(pages.withColumn("page_id", F.lit("x")))


def test_broken_archives(tmp_path):
    good = A.write_record(1, "u", b"abc", 3, A.digest(b"abc"), None, False)
    with open(tmp_path / "a", "wb") as f:
        writer = A.ArchiveWriter(f, b"dictionary " * 50)
        writer.add(good)
        writer.add(good)
    data = (tmp_path / "a").read_bytes()
    assert list(A.read_archive(data)) == [good, good]
    assert A.read_record(good)["payload"] == b"abc"
    for broken in (data[4:], data[:-3], data + b"junk", data[:10]):
        with pytest.raises(A.BadArchive):
            list(A.read_archive(broken))
    for broken in (b"x" + good, good[:-1], good.replace(b"abc\r\n", b"abd\r\n"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"Content-Length: 3\r\n", b"Content-Length: 4\r\n")):
        with pytest.raises(A.BadArchive):
            A.read_record(broken)


def plain_score(item, text):
    best, row = 0, [0] * (len(text) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (2 if a == b else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_plain_smith_waterman():
    import numpy as np

    rng = random.Random(3)
    items = [[rng.randrange(6) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    texts = [[rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    score, first, last = D.align([np.array(x, np.uint64) for x in items], [np.array(x, np.uint64) for x in texts])
    assert score.tolist() == [plain_score(a, b) for a, b in zip(items, texts, strict=True)]
    for a, b, s, i, j in zip(items, texts, score, first, last, strict=True):
        assert s == 0 or plain_score(a, b[i:j]) == s


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, 40)) for i in range(12)] + [(20, None), (21, ""), (22, "rare pair"), (23, items_text := prose(rng, 30)), (24, items_text)]
    rows, want = [], set()
    for i in range(60):
        text, kind = prose(rng, 150).split(" "), i % 5
        item = items[i % 12]
        copy = item[1].split(" ")
        if kind == 1:
            text[50:50] = [w.upper() + "," for w in copy]
        elif kind == 2:  # every sixth word replaced, one dropped, one added
            copy = [f"new{k}" if k % 6 == 5 else w for k, w in enumerate(copy)]
            text[20:20] = copy[:10] + copy[11:25] + ["more"] + copy[25:]
        if kind in (1, 2):
            want.add((i, item[0]))
        rows.append((i, " ".join(text), "x"))
    rows += [(70, "before " + items_text + " after", None), (71, "a rare pair here", None), (72, None, None), (73, "", None), (None, items[3][1], None)]
    want |= {(70, 23), (70, 24), (71, 22), (None, 3)}
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_leaks(spark, leaky):
    prepare(spark)
    docs, items, want = leaky
    found = D.find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in found:
        span = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert 0.4 <= r["similarity"] <= 1 and len(words_of(span)) >= 2
    kept = D.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - {d for d, _ in want}
    assert D.find_leaks(docs.limit(0), items).count() == 0 and D.find_leaks(docs, items.limit(0)).count() == 0


def leaks_of_copies(spark, item, copy, times):
    rng = random.Random(8)
    rows = [(i, " ".join([prose(rng, 20), *copy, prose(rng, 20)])) for i in range(times)]
    prepare(spark)
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    return D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), items).collect()


@pytest.mark.parametrize(("words", "every"), [(38, 4), (59, 5)])
def test_edited_copy_in_hundreds_of_documents(spark, words, every):
    item = prose(random.Random(words), words).split(" ")
    copy = [f"new{k}" if k % every == every - 1 else w for k, w in enumerate(item)]
    found = leaks_of_copies(spark, item, copy, 300)
    assert {r["doc_id"] for r in found} == set(range(300)) and min(r["similarity"] for r in found) > 0.6


def test_copy_without_a_trigram(spark):
    item = prose(random.Random(39), 39).split(" ")
    third = [f"new{k}" if k % 3 == 2 else w for k, w in enumerate(item)]
    spaced = [x for k, w in enumerate(item) for x in (w, f"new{k}")]
    for copy in (third, spaced):
        found = leaks_of_copies(spark, item, copy, 20)
        assert {r["doc_id"] for r in found} == set(range(20)) and min(r["similarity"] for r in found) > 0.49


def test_leaks_equal_alignment_of_all_with_all(spark):
    """Few words and many seeds in common; edits from none to far too many."""
    rng = random.Random(41)
    words = [f"v{i}" for i in range(14)] + [f"u{i}" for i in range(200)]
    pick = lambda n: [rng.choice(words[:14] if rng.random() < 0.5 else words) for _ in range(n)]
    items = [pick(rng.randint(3, 40)) for _ in range(25)]
    docs = []
    for _ in range(150):
        rate, copy = rng.random() * 0.7, []
        for w in rng.choice(items):
            edit = rng.random()
            copy += [w] if edit > rate else rng.choice(([], ["x"], [w, "y"]))
        docs.append(pick(rng.randint(0, 60)) + copy + pick(rng.randint(0, 60)))
    want = {}
    for d, doc in enumerate(docs):
        for t, item in enumerate(items):
            share = plain_score(item, doc) / (2 * len(item))
            if share >= 0.4:
                want[d, t] = share
    prepare(spark)
    left = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")
    right = spark.createDataFrame([(t, " ".join(x)) for t, x in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.find_leaks(left, right).collect()} == want
