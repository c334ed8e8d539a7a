"""Packing in the order of a space-filling curve.

A document is a hashed vector of its tokens, projected to a few dimensions. Its place on a Hilbert curve through that
space is a sort key under which documents with similar tokens are neighbours. Range partitions of the curve are sorted and
laid end to end; the stream is cut every ``capacity`` tokens, so a sequence holds neighbours and only the last has room.
That one is cut into powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bpe import word_encoder
from vitrine.llm.common import materialize, parts_for

# Hashed coordinates of a document, the dimensions it is projected to, and the levels of each (as bits).
HASHED, DIMENSIONS, BITS = 512, 4, 15
# Documents whose vectors are made at once.
TOGETHER = 256
# Tokens a range partition holds (16 MB at two bytes a token); there are at most MAX_PARTS, so their offsets stay small.
PART_TOKENS, MAX_PARTS = 8_000_000, 100_000
SEED = 0x9E3779B97F4A7C15


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each column of ``points`` (dimensions x n, whole numbers under ``2**bits``).

    Skilling's transform: from the highest bit down, the frame of each sub-cube is undone by exchanging or
    inverting lower bits; a Gray code and the interleaved bits remain. Neighbouring keys differ by one step in
    one dimension.
    """
    x = points.astype(np.int64)
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _mixed(n: int) -> np.ndarray:
    """A 64-bit hash of 0 to n - 1."""
    z = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(SEED)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Projector:
    """Curve keys of token id lists of a vocabulary of ``size`` ids."""

    def __init__(self, size: int):
        mixed = _mixed(size)
        self.bucket = (mixed % np.uint64(HASHED)).astype(np.int64)
        self.sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
        u = (_mixed(2 * HASHED * DIMENSIONS).astype(np.float64) + 1) / 2**64
        half = HASHED * DIMENSIONS
        normal = np.sqrt(-2 * np.log(u[:half])) * np.cos(2 * np.pi * u[half:])
        self.matrix = normal.reshape(HASHED, DIMENSIONS)

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        """Signed hashed counts, damped by the square root, at unit length (zero without ids)."""
        ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(docs)) * HASHED, [len(d) for d in docs])
        v = np.bincount(row + self.bucket[ids], self.sign[ids], len(docs) * HASHED).reshape(len(docs), HASHED)
        v = np.sign(v) * np.sqrt(np.abs(v))
        norm = np.sqrt(np.square(v).sum(axis=1, keepdims=True))
        return np.divide(v, norm, out=v, where=norm > 0)

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        parts = [self.vectors(docs[i : i + TOGETHER]) @ self.matrix for i in range(0, len(docs), TOGETHER)]
        z = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS))
        share = 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))  # the normal distribution function, nearly
        level = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        return hilbert_key(level.T, BITS)


@cache
def projector(size: int) -> Projector:
    return Projector(size)


def tail_lengths(left: int) -> list[int]:
    """``left`` as falling powers of two."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, wide: bool) -> DataFrame:
    """``_row, id, key, n, ids`` of every row; ids are two bytes each where the vocabulary allows, else four."""
    kind = "<u4" if wide else "<u2"
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        project = projector(encoder.tokenizer.get_vocab_size())
        for batch in batches:
            found = [np.frombuffer(encoder.encode(t or ""), "<u4") for t in batch.column("text").to_pylist()]
            ids = [x.astype(kind).tobytes() + end for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"), batch.column("id"), pa.array(project.keys(found), pa.int64()),
                    pa.array([len(x) + 1 for x in found], pa.int64()), pa.array(ids, pa.binary()),
                ],
                ["_row", "id", "key", "n", "ids"],
            )

    id_kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_row long, id {id_kind}, key long, n long, ids binary")


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range partition laid end to end: its number, and each row's place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = at + np.cumsum(n)
        at = int(ends[-1]) if len(n) else at
        columns = [batch.column(c) for c in ("id", "n", "ids")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n, pa.int64())],
            ["id", "n", "ids", "part", "place"],
        )


def pack_along_curve(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False, part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``, little-endian unsigned 32-bit
    numbers, if ``with_ids``) for every piece of every document.

    ``tokenizer`` is the path of a word-end BPE in the ``tokenizers`` format, present on every executor. A document is
    its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Every sequence has ``capacity`` tokens but
    those of the corpus's tail, whose lengths are falling powers of two that sum to what is left over. Within a sequence the
    offsets are gapless from 0, and its documents are neighbours on the curve. Equal keys (copies, empty texts)
    are told apart by row number, so no key is too hot to split. Repeated rows are packed as often as they come, other columns are
    ignored, an empty table gives no rows.

    Two tables are written to the shared folder: the encoded documents, and the same in curve order. The range shuffle
    moves each document's ids once. The driver sees the token sums of the range partitions (at most ``MAX_PARTS``); from them
    every row's place in the stream, and with it every cut, is arithmetic. A task holds one Arrow batch.
    """
    wide = end_id > 0xFFFF or word_encoder(tokenizer).tokenizer.get_vocab_size() > 0x10000
    kind = "<u4" if wide else "<u2"
    src = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    encoded = materialize(_encoded(src, tokenizer, end_id, wide), "encoded")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = min(parts_for(total, part_tokens), MAX_PARTS)
    id_kind = encoded.schema["id"].dataType.simpleString()
    in_order = encoded.repartitionByRange(parts, "key", "_row").sortWithinPartitions("key", "_row")
    curve = materialize(
        in_order.mapInArrow(_laid_out, f"id {id_kind}, n long, ids binary, part int, place long"), "curve"
    )
    sums = {r["part"]: r["n"] for r in curve.groupBy("part").agg(F.max(F.col("place") + F.col("n")).alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(sums):
        starts[part], at = at, at + sums[part]
    whole = total // capacity
    tail = np.cumsum([whole * capacity, *tail_lengths(total - whole * capacity)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, length, crc, sequence, offset, cut = [], [], [], [], [], [], []
            places = zip(batch.column("part").to_pylist(), batch.column("place").to_pylist(), batch.column("ids"))
            for row, (part, place, ids) in enumerate(places):
                data = np.frombuffer(ids.as_buffer(), kind).astype("<u4")
                here = first = starts[part] + place
                while here < first + len(data):
                    if here < tail[0]:
                        number = here // capacity
                        begin, end = number * capacity, (number + 1) * capacity
                    else:
                        k = int(np.searchsorted(tail, here, "right")) - 1
                        number, begin, end = whole + k, int(tail[k]), int(tail[k + 1])
                    end = min(end, first + len(data))
                    piece = data[here - first : end - first].tobytes()
                    rows.append(row)
                    start.append(here - first)
                    length.append(end - here)
                    crc.append(zlib.crc32(piece))
                    sequence.append(number)
                    offset.append(here - begin)
                    if with_ids:
                        cut.append(piece)
                    here = end
            at = pa.array(rows, pa.int64())
            columns = [
                batch.column("id").take(at), *(pa.array(c, pa.int64()) for c in (start, length, crc)),
                batch.column("n").take(at), *(pa.array(c, pa.int64()) for c in (sequence, offset)),
            ]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(cut, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return curve.mapInArrow(run, schema + ", ids binary" * with_ids).withColumnRenamed("id", id_col)
