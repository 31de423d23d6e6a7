"""MinHash near-duplicate detection on word shingles.

1. Signing (a narrow map): each text's set of distinct 5-word shingles gives a
   128-bit digest, ``BANDS`` x ``ROWS`` universal hash minima (a x + b modulo
   2**32 of mixed hashes), their low bytes as a compact signature, and one key
   for each band.
2. Equal sets become one class, represented by its smallest id.
3. Banding: representatives that share a band key meet in a bucket. A bucket of
   at most ``SMALL`` members gives all its pairs. A larger one gives only the
   pairs with two pivots, its most central member (the one whose band keys are
   shared most widely, as an original's are among its copies) and one chosen by
   hash. If its members are then not yet one component, those outside the
   central pivot's component are compared with all others, as far as exact
   bounds leave it possible: with s shingles in common with the pivot and e
   others that some second member has, two sets share at most
   min(s, s') + min(e, e') shingles, where s is counted in ``GROUPS`` groups of
   the pivot's shingles and the minimum is taken in each. Copies that have drifted from the original
   in their own ways, and texts that merely share a passage, fall out by that
   bound alone, before any pair is made.
4. Signature verification drops pairs whose estimate is far below the
   threshold (under 0.6 for 3/4: more than five standard deviations away); every
   other pair is confirmed on its two full sets.
5. Connected components by alternating large-star and small-star.

A similar pair (3/4) is missed by all bands with probability 5e-6. Keys are
counted with map-side combining; hot keys occur only on one side of plain
joins, which adaptive execution splits, and a pivot's members are dealt out
with one copy of its set for each ``STAR`` of them.

Cases: ids are integers; null and empty texts and texts of white space have an empty set and are
linked with nothing; texts of 1 to 4 words have their whole sequence as the one
shingle; a null id is never linked and keeps a null component (``kept`` is
true); rows that repeat an id are one node of the graph, and of different
texts under one id one counts; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import FILTER_BITS, U64, Words, bit_filter, blocks, buffers, dealt_anew, filter_bit, mix, need_integers, spread, stored

BANDS, ROWS = 45, 5
SMALL = 32
GROUPS = 32
STAR = 256  # members that are compared with one copy of their pivot's set
SIGNATURE = BANDS * ROWS  # minima of which the compact signature keeps a byte
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values): the sorted distinct shingle hashes of each document."""
    words = Words(raw, offsets)
    n = len(offsets) - 1
    many = np.maximum(words.count - size + 1, 0)
    first = np.repeat(words.first[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    value = np.zeros(len(first), U64)
    for j in range(size):
        value += words.hash[first + j] * _PLACE[j]
    owner = np.repeat(np.arange(n), many)
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    whole = words.count[few].astype(U64) * _PLACE[-1]
    for j in range(size - 1):
        has = words.count[few] > j
        whole[has] += words.hash[words.first[few[has]] + j] * _PLACE[j]
    value, owner = mix(np.concatenate([value, whole])), np.concatenate([owner, few])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=n)))), value[new]


def minima(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(documents, BANDS * ROWS) hash minima; all ones for an empty set."""
    n = len(starts) - 1
    out = np.full((BANDS * ROWS, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        upper = (values >> U64(32)).astype(np.uint32)
        buffer = np.empty_like(upper)
        for j in range(BANDS * ROWS):
            np.multiply(upper, _ODD[j], out=buffer)
            buffer += _ADD[j]
            out[j, full] = np.minimum.reduceat(buffer, starts[full])
    return out.T


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), sig, keys (one a band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for i, j in blocks(offsets):
                starts, values = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                low = minima(starts, values)
                keys = np.zeros((j - i, BANDS), U64)
                for r in range(ROWS):
                    keys += low[:, r::ROWS].astype(U64) * _PLACE[8 + r]
                keys = mix(keys + np.arange(BANDS, dtype=U64) * _PLACE[20])
                sig = np.ascontiguousarray(low[:, :SIGNATURE] & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(starts)),
                        pa.array(spread(mix(values), starts).view(np.int64)),
                        pa.array(spread(mix(values ^ _PLACE[30]), starts).view(np.int64)),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (j - i) + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig", "keys"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, d1 long, d2 long, sig binary, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest reachable id of every node of an edge.

    Large-star links all larger neighbours of a node to the smallest id in its
    neighbourhood, small-star links all smaller ones; both keep connectivity,
    until every tree is a star: no node hangs from two others or from a
    node that hangs itself.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(dealt_anew(least, "a"), "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(dealt_anew(least, "b"), "b")
        small = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = stored(small, "stars")
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("x"), F.lit(1).alias("leaf")))).alias("end")).select("end.*")
        if ends.groupBy("x").agg(F.sum("leaf").alias("up"), F.min("leaf").alias("down")).where("up > 1 or (up = 1 and down = 0)").isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in at least half of the places."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in (2, 3))
            yield batch.filter(pa.array((a == b).sum(1) >= 0.6 * SIGNATURE)).select([0, 1])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of (a, salt, b, set) in this order, without the rows that hold
    the set of ``a`` (b is null), and the two sets of each row."""
    own = None
    for batch in batches:
        sets, other = [], batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        for k in range(batch.num_rows):
            one = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
            if other[k]:
                sets.append((own, one))
            else:
                own = one.copy()
        yield batch.filter(pa.array(other)), sets


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _stars(batches):
            good = np.zeros(len(sets), bool)
            for k, (a, b) in enumerate(sets):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good[k] = 100 * shared >= percent * (len(a) + len(b) - shared)
            yield batch.filter(pa.array(good)).select([0, 2])

    return run


def _sets(size: int, wanted: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                bit = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((wanted.value[bit >> 3] >> (bit & 7)) & 1 == 1))
            raw, offsets = buffers(batch.column(1))
            for i, j in blocks(offsets):
                starts, values = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                rows = [values[starts[k] : starts[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary())], names=["doc", "shingles"])

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, doc) of every set."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        if sets:
            owner = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), batch.column(0).take(owner)], names=["shingle", "doc"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of shingles that each set shares with its pivot's, in all and
    by group."""
    for batch, sets in _stars(batches):
        shared = [np.intersect1d(a, b, assume_unique=True) for a, b in sets]
        groups = [np.bincount((x % U64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.int32) for x in shared]
        columns = [pa.array([len(x) for x in shared], pa.int64()), pa.array(groups, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), *columns], names=["doc", "p", "s", "g"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, salt, b, set) of distinct pairs, sorted, for ``_stars``: the set of
    each b, and that of a once for each ``STAR`` of its pairs, before them."""
    many = dealt_anew(pairs.groupBy("a").agg(F.count("*").alias("many")), "a")
    salts = F.ceil(F.col("many") / STAR)
    rows = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), salts).alias("salt"), "b").join(sets.select(F.col("doc").alias("b"), "shingles"), "b")
    heads = many.join(sets.select(F.col("doc").alias("a"), "shingles"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    return rows.select(heads.columns).union(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")


class NearDuplicates:
    """The links between classes of equal sets, and the classes' components."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, filter_bits: int = FILTER_BITS) -> None:
        need_integers(docs, id_col)
        self.size, self.percent, self.filter_bits = size, percent, filter_bits
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.texts = docs.withColumnRenamed("doc_id", "doc").where("doc is not null")
        self.signed = stored(sign(docs, size=size), "signed")
        linkable = self.signed.where("n_shingles > 0 and doc_id is not null")
        self.classes = stored(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
        self.reps = stored(
            linkable.join(self.classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sig", "keys").dropDuplicates(["doc"]),
            "reps",
        )
        self.links: DataFrame | None = None
        self._link()

    def _link(self) -> None:
        sig = self.reps.select("doc", "sig")
        members = self.reps.select(F.explode("keys").alias("key"), "doc", "n")
        buckets = members.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
        members = stored(members.join(buckets, "key"), "members")
        # small buckets cannot be skewed: dealt out once, for both sides of the join
        some = members.where(F.col("many") <= SMALL).join(sig, "doc").select("key", "doc", "n", "sig").repartition("key")
        near = self._near_pairs(some, some, F.col("doc") < F.col("other"))
        large = members.where(F.col("many") > SMALL)
        if large.isEmpty():
            self._verify(near)
            return
        central = large.groupBy("doc").agg(F.sum("many").alias("w"))
        large = stored(large.join(central, "doc").select("key", "doc", "n", "w"), "large")
        mask = F.xxhash64("key")
        pivots = large.groupBy("key").agg(F.max_by("doc", "w").alias("p"), F.min(F.col("doc").bitwiseXOR(mask)).alias("q"))
        pivots = stored(pivots.select("key", "p", F.col("q").bitwiseXOR(mask).alias("q")), "pivots")
        starred = large.join(pivots, "key").select("doc", F.explode(F.array("p", "q")).alias("other")).where("doc <> other").distinct()
        starred = starred.join(sig, "doc").join(sig.toDF("other", "sig_b"), "other").select("doc", "other", "sig", "sig_b")
        self._verify(near.union(starred.mapInArrow(_near, "doc long, other long")))

        placed = large.join(self.stars, large["doc"] == self.stars["node"], "left").select("key", "doc", "n", "w", F.coalesce("component", "doc").alias("c"))
        mixed = placed.groupBy("key").agg(F.max_by("c", "w").alias("main"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        mixed = placed.join(mixed.select("key", "main"), "key")
        mixed = stored(mixed.join(pivots.select("key", "p"), "key"), "mixed")
        sets = stored(self._sets_of(mixed.select("doc")), "crowd")
        shingles = sets.mapInArrow(_shingle_rows, "shingle long, doc long")
        alone = shingles.groupBy("shingle").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).where("doc = last")
        alone = alone.groupBy("doc").agg(F.count("*").alias("u"))
        with_pivot = mixed.select(F.col("p").alias("a"), F.col("doc").alias("b")).distinct()
        common = _with_sets(with_pivot, sets).mapInArrow(_common, "doc long, p long, s long, g array<int>")
        mixed = mixed.join(alone, "doc", "left").join(common, ["doc", "p"]).withColumn("e", F.col("n") - F.col("s") - F.coalesce("u", F.lit(0)))
        mixed = stored(mixed.where((F.col("s") + F.col("e")) * 100 >= F.col("n") * self.percent).join(sig, "doc"), "possible")
        self._verify(self._near_pairs(mixed, mixed.where("c <> main"), (F.col("c") != F.col("d")) & ((F.col("c") == F.col("main")) | (F.col("doc") < F.col("other")))))

    def _near_pairs(self, left: DataFrame, right: DataFrame, differ: Column) -> DataFrame:
        """Pairs of a bucket that differ, could be similar by the sizes of
        their sets, and look similar by their signatures. The signatures are
        compared where the pairs arise, so that only similar ones are shuffled."""
        names = {"doc": "other", "n": "m", "sig": "sig_b", "c": "d", "g": "g_b", "e": "e_b"}
        right = right.select("key", *(F.col(c).alias(names[c]) for c in right.columns if c in names))
        close = F.least("n", "m") * 100 >= F.greatest("n", "m") * self.percent
        if "g" in left.columns:
            both = F.zip_with("g", "g_b", lambda x, y: F.least(x, y))
            shared = F.aggregate(both, F.least("e", "e_b"), lambda total, x: total + x)
            close = close & (shared * 100 >= (F.col("n") + F.col("m") - shared) * self.percent)
        return left.join(right, "key").where(differ & close).select("doc", "other", "sig", "sig_b").mapInArrow(_near, "doc long, other long")

    def _sets_of(self, docs: DataFrame) -> DataFrame:
        """(doc, shingles) of the given documents. A bit filter of fixed size
        tells the map over the texts which ones are wanted, so that texts are
        not shuffled; it may let a few others through. When more documents are
        wanted than the filter can tell apart, a join takes its place."""
        held = bit_filter(docs, "doc", self.filter_bits)
        full = np.unpackbits(held.value).mean() > 0.1
        texts = self.texts.withColumn("bit", filter_bit("doc", self.filter_bits))
        if full:
            texts = texts.join(docs.distinct(), "doc", "left_semi")
        return texts.mapInArrow(_sets(self.size, None if full else held), "doc long, shingles binary")

    def _verify(self, pairs: DataFrame) -> None:
        """Confirm pairs and merge those that hold into the links and stars."""
        pairs = pairs.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()
        if self.links is not None:
            pairs = pairs.join(self.links, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if self.links is not None and pairs.isEmpty():
            return
        sets = stored(self._sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc"))), "sets")
        links = stored(_with_sets(pairs, sets).mapInArrow(_confirm(self.percent), "a long, b long"), "links")
        if self.links is None:
            self.links, self.stars = links, components(links)
        elif not links.isEmpty():
            self.links = self.links.union(links)
            self.stars = components(links.union(self.stars.select(F.col("component").alias("a"), F.col("node").alias("b"))))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept, n_links (confirmed links of its
        class; pairs that are already in one component are not all compared)."""
        pairs = self.links.distinct()
        degree = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
        classes = self.classes.join(degree, "rep", "left").join(self.stars.withColumnRenamed("node", "rep"), "rep", "left")
        classes = classes.select("d1", "d2", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        lone = self.signed.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
        out = self.signed.where(linkable).join(classes, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", "n_links").union(lone)
        return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    return NearDuplicates(docs, id_col, text_col, size, percent).result()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, that represent their group: the one
    with the smallest id (one row of it, if it is repeated), and rows without
    an id."""
    kept = near_duplicates(docs, id_col, text_col, size, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns).union(docs.where(F.col(id_col).isNull()))
