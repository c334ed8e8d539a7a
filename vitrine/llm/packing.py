"""Best-fit packing with certified bin counts.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. The pieces are dealt
to partitions; each packs its own by best-fit decreasing and compares its bin
count with a lower bound from dual feasible functions. A partition whose count
meets the bound is certified and keeps its bins, but the emptiest. Those with a gap exchange the pieces of
their bins with room left and pack again, in ever fewer partitions, while the corpus as
a whole has more bins than its own bound; if that gains nothing more, certified partitions give up their bins with room too.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bpe import word_encoder
from vitrine.llm.common import free_names, materialize, parts_for, released, small_batches

# Pieces a packing task holds (about 100 bytes each in Python).
PIECES_PER_PARTITION = 50_000
# Bits of a bin's and a partition's number in a sequence id; the round stands above them.
BIN_BITS, PART_BITS = 28, 26


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` (and ``ids``, little-endian unsigned 32-bit
    numbers in a binary column, if ``with_ids``) for every piece of every document.

    A document is its ids and then ``end_id``; only one longer than ``capacity`` is cut, into
    pieces of ``capacity`` and a last one that may be shorter. A null or empty text has the one
    id ``end_id``. One narrow pass.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [
                batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    forget = lambda: word_encoder(tokenizer).forget()
    return src.mapInArrow(released(run, forget), schema).withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- bounds


def dual_feasible_bound(counts: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins that ``counts[length]`` pieces need.

    The best of the total length, the step functions ``f_k`` (for k = 1, 2, ...: x maps to x where (k+1)x is a
    whole number of bins, else to floor((k+1)x)/k) and the threshold functions ``u_e`` (pieces over 1 - e count as a
    whole bin, those under e as none). Each is a dual feasible function: the images of pieces that
    fit a bin sum to at most one bin. Integer arithmetic throughout.
    """
    x = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 21):
        image = np.where((k + 1) * x % capacity == 0, k * x, ((k + 1) * x // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((counts * image).sum()) // (k * capacity)))
    ones = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    mass = np.concatenate([[0], np.cumsum(counts * x)])
    for e in range(0, capacity // 2 + 1):
        total = int(ones[min(capacity - e + 1, len(counts))]) * capacity + int(mass[capacity - e + 1] - mass[e])
        best = max(best, -(-total // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each length and the fill of each bin. Open bins are found by
    their room: a sorted list of the rooms in use (at most ``capacity``) and a stack of bins for each."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    rooms: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = stacks[room].pop()
            if not stacks[room]:
                del rooms[at]
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left = room - n
        if left:
            if not stacks[left]:
                insort(rooms, left)
            stacks[left].append(b)
    return bins, offsets, np.array(fills, np.int64)


FULL, CERTIFIED, LOOSE = 2, 1, 0


def _packer(round_no: int, capacity: int, certify: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        size = pdf["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(size, capacity)
        part = int(pdf["_part"].iloc[0])
        bound = dual_feasible_bound(np.bincount(size, minlength=capacity + 1), capacity)
        state = np.where(fills == capacity, FULL, LOOSE)
        if certify and len(fills) == bound:
            state[(state == LOOSE) & (np.arange(len(fills)) != np.argmin(fills))] = CERTIFIED
        # Negative, so that they differ from the row numbers that whole pieces use as ids.
        ids = -1 - ((np.int64(round_no) << BIN_BITS + PART_BITS) | (np.int64(part) << BIN_BITS) | bins)
        return pd.DataFrame(
            {
                "_row": pdf["_row"], "length": size, "sequence_id": ids, "offset": offsets, "_state": state[bins].astype(np.int32),
                "_part": np.int32(part), "_bound": bound,
            }
        )

    return pack


def _summary(packed: DataFrame):
    """One row: bins, loose and certified bins, pieces in loose ones, and partitions that miss their bound."""
    first, loose = F.col("offset") == 0, F.col("_state") == LOOSE
    return (
        packed.groupBy("_part")
        .agg(
            F.count_if(first).alias("bins"), F.max("_bound").alias("bound"),
            F.count_if(first & loose).alias("open_bins"), F.count_if(loose).alias("open_pieces"),
            F.count_if(first & (F.col("_state") == CERTIFIED)).alias("certified_bins"),
        )
        .agg(
            *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bins", "open_bins", "open_pieces", "certified_bins")),
            F.count_if(F.col("bins") > F.col("bound")).alias("uncertified"),
        )
        .first()
    )


def pack_best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) plus ``sequence_id`` and ``offset``: every piece once, the
    offsets of a sequence gapless from 0.

    A piece that fills a sequence alone needs no packing. The others are dealt evenly to partitions of about
    ``PIECES_PER_PARTITION``; each packs by best-fit decreasing and states its bin count and its dual feasible bound.
    Full bins are final. A partition that meets its bound keeps its bins but the emptiest. The counts of lengths (at most
    ``capacity`` rows) give the bound of the whole corpus. While the corpus has more bins than that, the pieces of the other
    bins are exchanged: dealt out anew, to half as many partitions (as few as the limit allows), and packed again. An exchange is taken over if
    it needs fewer bins. When one into the fewest partitions gains nothing, the certified partitions give up their bins with
    room as well, and exchanges go on until one gains nothing or the bound is met; :func:`packing_gap` states what is left.

    The best-fit loop runs inside tasks on bounded partitions; the driver sees counts and at most ``capacity`` sums.
    Repeated rows are packed as often as they come; other columns are kept; an empty table gives no rows.
    """
    names = pieces.columns
    (row,) = free_names(names, "row")
    base = materialize(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    counts = _length_counts(base, capacity)
    bound = dual_feasible_bound(counts, capacity)
    full = F.col("length") == capacity
    result = base.where(full).select(*names, F.col(row).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = "_row long, length long, sequence_id long, offset long, _state int, _part int, _bound long"
    closed_bins, left = int(counts[capacity]), int(counts[:capacity].sum())
    if left == 0:
        return result
    loose, kept, open_bins = base.where(~full).select(F.col(row).alias("_row"), "length"), None, None
    placed, aside, aside_bins, certify, round_no = [], [], 0, True, 0
    parts = parts_for(left, PIECES_PER_PARTITION)
    while True:
        dealt = loose.withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(round_no)), F.lit(parts)).cast("int"))
        packed = materialize(
            dealt.groupBy("_part").applyInPandas(_packer(round_no, capacity, certify), schema), f"packed{round_no}"
        )
        s = _summary(packed)
        fewest = parts_for(left, PIECES_PER_PARTITION)
        if open_bins is None or s["bins"] < open_bins:
            placed.append(packed.where(F.col("_state") == FULL))
            if s["certified_bins"]:
                aside.append(packed.where(F.col("_state") == CERTIFIED))
                aside_bins += s["certified_bins"]
            kept = packed.where(F.col("_state") == LOOSE)
            closed_bins += s["bins"] - s["open_bins"] - s["certified_bins"]
            open_bins, left = s["open_bins"], s["open_pieces"]
            gained = left > 0
        else:
            gained = parts > fewest
        if closed_bins + aside_bins + open_bins <= bound:
            break
        if not gained:
            if not aside:
                break
            for more in aside:
                kept = kept.unionAll(more)
            left, open_bins = kept.count(), open_bins + aside_bins
            aside, aside_bins, certify = [], 0, False
            parts = 2 * parts_for(left, PIECES_PER_PARTITION)
        loose = kept.select("_row", "length")
        parts = max(parts_for(left, PIECES_PER_PARTITION), parts // 2)
        round_no += 1
    placed += [kept, *aside]
    plan = placed[0].select("_row", "sequence_id", "offset")
    for more in placed[1:]:
        plan = plan.unionAll(more.select("_row", "sequence_id", "offset"))
    at = plan.withColumnRenamed("_row", f"{row}_placed")
    joined = base.where(~full).join(at, F.col(row) == F.col(f"{row}_placed"))
    return result.unionAll(joined.select(*names, "sequence_id", "offset"))


def _length_counts(pieces: DataFrame, capacity: int) -> np.ndarray:
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    return counts


def packing_gap(packed: DataFrame, capacity: int) -> dict[str, int]:
    """``sequences``, ``bound`` and ``gap`` of a result of :func:`pack_best_fit`: no packing has fewer than ``bound``."""
    sequences = packed.where(F.col("offset") == 0).count()
    bound = dual_feasible_bound(_length_counts(packed, capacity), capacity)
    return {"sequences": sequences, "bound": bound, "gap": sequences - bound}
