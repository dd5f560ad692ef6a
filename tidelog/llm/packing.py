"""Best-two-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize
from tidelog.llm.wordbpe import WordBpe

SEQUENCE_LENGTH = 4096
END_ID = 1
#: Pieces in one packing shard. A shard leaves one part-filled sequence at most, so the loss is a fixed small share.
SHARD_PIECES = 16_384

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_loaded: dict[str, WordBpe] = {}


def _tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def tokenize_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = SEQUENCE_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its ids and then end_id, cut every `length` ids only where the document is longer.

    A null text is empty (one piece that holds end_id alone); a null id stays null. With with_ids the ids themselves are
    returned too (array<int>). Rows that repeat give pieces that repeat. Map-only.
    """
    path = tokenizer or default_tokenizer()
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                out: list[list] = [[] for _ in names]
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), tok.ids(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, length)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = [doc, k, start, len(own) // 4, zlib.crc32(own)]
                        if with_ids:
                            row.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class _Pool:
    """Unpacked pieces by length; `largest(x)` is the largest length of at most x that is left, or 0."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        order = np.argsort(lengths, kind="stable")[::-1]
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in order.tolist():
            self.rows[lengths[i]].append(i)
        self.count = np.bincount(lengths, minlength=capacity + 1)
        at = np.where(self.count > 0, np.arange(capacity + 1), 0)
        self.below = np.maximum.accumulate(at)

    def largest(self, x: int) -> int:
        return int(self.below[x])

    def _span(self, value: int, start: int) -> slice:
        end = int(np.searchsorted(self.below, value, side="right"))
        return slice(start, end)

    def take(self, x: int) -> int:
        self.count[x] -= 1
        if not self.count[x]:
            self.below[self._span(x, x)] = self.below[x - 1]
        return self.rows[x].pop()

    def put(self, x: int, row: int) -> None:
        self.rows[x].append(row)
        self.count[x] += 1
        if self.count[x] == 1:
            self.below[self._span(int(self.below[x]), x)] = x

    def best_pair(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is the largest in (more_than, room]."""
        half = room // 2
        first = np.flatnonzero(self.count[: half + 1])
        if not first.size:
            return None
        second = self.below[room - first]
        alone = (second == first) & (self.count[first] < 2)
        second = np.where(alone, self.below[np.maximum(first - 1, 0)], second)
        total = np.where(second > 0, first + second, 0)
        k = int(total.argmax())
        return (int(first[k]), int(second[k])) if more_than < total[k] <= room else None


def best_two_fit(lengths: np.ndarray, capacity: int = SEQUENCE_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece (lengths of 1 to capacity).

    Each bin takes the longest piece left and then, again and again, the longest that still fits. A gap that stays is
    closed further by swapping the bin's smallest piece for two unpacked ones with a larger sum that still fits.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    if lengths.size and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("a piece is empty or longer than a sequence")
    pool, number, offset, left, k = _Pool(lengths, capacity), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), len(lengths), 0
    while left:
        own: list[tuple[int, int]] = []
        gap = capacity
        while gap and (x := pool.largest(gap)):
            own.append((x, pool.take(x)))
            gap -= x
        while gap and len(own) > 1 and len(own) < left:
            small, row = min(own)
            if not (pair := pool.best_pair(gap + small, small)):
                break
            own.remove((small, row))
            own += [(x, pool.take(x)) for x in pair]
            pool.put(small, row)
            gap += small - sum(pair)
        at = 0
        for x, row in own:
            number[row], offset[row] = k, at
            at += x
        left -= len(own)
        k += 1
    return number, offset


def pack_pieces(pieces: DataFrame, *, length: int = SEQUENCE_LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length` column.

    The pieces are dealt at random to shards of about shard_pieces and each shard is packed by best_two_fit, so no task
    holds more than a shard, whatever the documents' ids are. Equal rows are packed as often as they occur.
    """
    kept = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-kept.count() // shard_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    names = pieces.columns

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__row", kind="stable")
        number, offset = best_two_fit(rows["length"].to_numpy(), length)
        return rows[names].assign(sequence_id=number + (int(rows["__shard"].iloc[0]) << 32), offset=offset)

    return kept.withColumn("__shard", F.pmod(F.xxhash64("__row"), F.lit(shards))).groupBy("__shard").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenises documents and packs their pieces; see tokenize_pieces and pack_pieces. An empty table gives no rows."""
    return pack_pieces(tokenize_pieces(docs, **options), length=options.get("length", SEQUENCE_LENGTH))
