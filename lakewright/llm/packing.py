"""Best-fit packing with bound-certified repacking.

Documents become token pieces of at most ``capacity`` tokens. Pieces are dealt
to groups of bounded size; each group packs its pieces by best-fit decreasing
and compares its bin count with lower bounds from dual feasible functions. A
group that meets its bound is certified and gives up only its emptiest bin; a
group with a gap also gives up the emptiest bins that its gap could save. What
is given up is exchanged: ``FAN_IN`` groups' leftovers meet in one group of the
next round and are packed again, until one group is left. Each round divides
the number of groups, so no task ever holds more than a bounded number of
pieces, and the waste that remains is a bin or two for the whole table.

Cases: null and empty texts are one piece with the end id only; repeated rows
are packed each; null ids pass through; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Vocabulary, byte_symbols, parts
from .common import stored

FAN_IN = 64
GROUP_PIECES = 8192


class Encoder:
    """Token ids as the tokenizers library gives them for a byte-level file.

    Where the ids of merged tokens follow the merge order, tiktoken's merge
    loop over the same vocabulary gives the same ids several times faster;
    for any other file the tokenizers library itself encodes.
    """

    def __init__(self, content: str) -> None:
        vocabulary = Vocabulary(content)
        stands = byte_symbols()
        made = [vocabulary.ids[a + b] for a, b in vocabulary.merges]
        singles = [vocabulary.ids[c] for c in stands]
        self.vocabulary = vocabulary
        if made == sorted(made) and max(singles) < min(made):
            import tiktoken

            ranks = {bytes(stands[c] for c in token): i for token, i in vocabulary.ids.items() if token not in vocabulary.special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            quick = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._ordinary = quick.encode_ordinary
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_str(content)
            self._ordinary = lambda text: slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for section, special in self.vocabulary.sections(text):
            for part in parts(section):
                if part:
                    ids += self._ordinary(part)
            if special >= 0:
                ids.append(special)
        return np.array(ids, "<u4")


def cut_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, or for longer
    ones a first piece with the remainder and then full pieces."""
    with open(tokenizer_json, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(content.value)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder.encode(text or ""), np.uint32(end_id)).astype("<u4")
                at, k, size = 0, 0, len(ids) % capacity or min(capacity, len(ids))
                while at < len(ids):
                    rows.append((i, k, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                    at, k, size = at + size, k + 1, capacity
            table = np.array(rows, np.int64).reshape(-1, 5)
            columns = [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, c]) for c in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length. Free space is at most ``capacity``, so the set of
    free sizes is one integer's bits and the best fit its lowest fitting bit."""
    bins = np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        if left := room - size:
            free[left].append(b)
            mask |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions over all cuts:
    f(x) = C for x > C - e, x for e <= x, 0 below; and the rounding functions
    u_k(x) = x if (k + 1)x / C is whole, else floor((k + 1)x / C) * C / k."""
    if not len(lengths):
        return 0
    size = np.arange(capacity + 1)
    many = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number, total = np.cumsum(many), np.cumsum(many * size)
    e = np.arange(0, capacity // 2 + 1)
    below = np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - below
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k
        best = max(best, int(-(-int((value * many).sum()) // (k * capacity))))
    return best


def _pack_group(pdf: pd.DataFrame, capacity: int, last: bool, level: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], ignore_index=True)
    lengths = pdf["length"].to_numpy()
    bins = best_fit_decreasing(lengths, capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    gap = len(fill) - lower_bound(lengths, capacity)
    given = np.zeros(len(fill), bool)
    if not last:
        given[np.argsort(fill, kind="stable")[: 1 + 2 * gap]] = True
        given &= fill < capacity
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.searchsorted(bins[order], bins[order], "left")
    offset = np.empty(len(bins), np.int64)
    offset[order] = before - before[first]
    group = int(pdf["grp"].iloc[0])
    pdf["sequence_id"] = (level << 56) + (group << 20) + bins
    pdf["offset"] = offset
    pdf["given"] = given[bins]
    pdf["gap"] = gap
    return pdf


def _packer(capacity: int, last: bool, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _pack_group(pdf, capacity, last, level)


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of ``length`` <= capacity."""
    names = pieces.columns
    if not {"grp", "given", "gap", "sequence_id", "offset"}.isdisjoint(names):
        raise ValueError("the piece table has columns that packing adds")
    total = pieces.count()
    groups = max(1, -(-total // group_pieces))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    level, settled = 0, []
    todo = pieces.withColumn("grp", deal)
    schema = todo.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint,given:boolean,gap:bigint"
    schema = ", ".join(x.replace(":", " ", 1) for x in schema.split(","))
    while True:
        last = groups == 1
        done = todo.groupBy("grp").applyInPandas(_packer(capacity, last, level), schema)
        if last:
            settled.append(done)
            break
        done = stored(done, f"packed{level}")
        settled.append(done.where("not given"))
        groups, level = -(-groups // FAN_IN), level + 1
        todo = done.where("given").select(*names, F.expr(f"grp div {FAN_IN}").alias("grp"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Encoding runs once; the pieces are written
    to the shared folder before they are dealt out."""
    pieces = stored(cut_pieces(docs, tokenizer_json, capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity)
