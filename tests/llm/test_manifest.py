"""The Merkle manifest against a plain tree, leaf by leaf."""

import hashlib
import zlib

from lakewright.llm import manifest as M, queries as Q
from lakewright.llm.common import prepare, table

A_Z = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        at = i // 8 * 8
        yield "".join(level[at:i]), "".join(level[i + 1 : at + 8])
        i //= 8


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    trees = {k: climbed([leaf(r) for r in v]) for k, v in groups.items()}
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    top = climbed([trees[k][-1][0] for k in order])
    for k, v in groups.items():
        for i, r in enumerate(v):
            path = [*siblings(trees[k], i), *siblings(top, order.index(k))]
            node = trees[k][0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = leaf([*r[:4], r[4].translate(A_Z)])
            for left, right in path:
                node = digest(left + node + right)
            yield r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), node, node == top[-1][0]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, *map(str, r)))


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select(*Q.FIELDS).collect()]
    got = Q.queries()["op13_manifest"](spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert in_order(map(tuple, got.collect())) == in_order(plain(rows))


def test_odd_rows_and_several_rounds(spark, tmp_path):
    """Null and repeated ids and groups, equal rows, a group of over a block, ten groups, one of a single row."""
    rows = [(i, None if i % 5 else "web", "big", i, f"Text {i}") for i in range(M.BLOCK + 70)]
    rows += [(3, "s", f"l{k}", 1, "é" * k) for k in range(9)] + [(None, None, None, None, None)] * 3 + [(7, "x", None, 2, ""), (7, "x", None, 2, None), (7, "x", None, 2, "Aa")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumnRenamed("x", "group").write.parquet(str(tmp_path / "documents.parquet"))
    assert in_order(map(tuple, Q.op13_manifest(spark, str(tmp_path)).collect())) == in_order(plain(rows))


def test_parts(spark, odd_docs, no_docs):
    prepare(spark)
    tree = M.Manifest(odd_docs, Q.FIELDS, "lang", "doc_id")
    roots = {r["root"] for r in tree.subroots().collect()}
    assert roots == {tree.root().first()["root"]} and tree.subroots().count() == 2
    assert tree.proofs().where(M.fold("leaf", "path") != M.F.col("root")).count() == 0
    nothing = M.Manifest(no_docs, Q.FIELDS, "lang", "doc_id")
    assert nothing.root().count() == nothing.proofs().count() == 0
