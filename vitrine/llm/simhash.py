"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that agree in some bands of their bits meet in a bucket. A bucket
stores its fingerprints vertically, one bit plane for each of the 64 bits, so one
machine word holds the same bit of 64 fingerprints. A fingerprint is compared
with a whole block at once: its planes are XORed and added to carry-save counters, and a
block is abandoned once every counter has passed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import connected_components, materialize, small_batches

BITS = 64
# The bits are cut into so many bands; fingerprints at most ``radius`` bits apart agree on
# at least BANDS - radius whole bands, so each choice of so many bands is one table of buckets.
BANDS = 5
# A bucket larger than this is cut into blocks of this size, and each pair of
# blocks is one task's work.
BLOCK = 4096
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def simhash(text: str | None, width: int, seed: int = 42) -> int:
    """Fingerprint of the word shingles of ``text``: bit set where over half the hashes have it.

    A-Z are lower-cased; words are runs of anything but ``[\\x20\\x09-\\x0D]``. A text with fewer words than
    ``width`` has its whole sequence as its one shingle; one without words (or null) has 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(
        (xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(n)), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` (the fingerprint's 64 bits as a signed long) for every row; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- comparison


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) planes: bit ``i`` of word ``w`` of plane ``b`` is bit ``b`` of fingerprint ``64 w + i``."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(planes: tuple[np.ndarray, np.ndarray], fp: int, radius: int, alive: np.ndarray) -> np.ndarray:
    """Words whose bits tell which fingerprints of the block lie within ``radius`` bits of ``fp``.

    ``planes`` has the bit planes and their complements; ``alive`` has the bits that count. Distances are kept in
    carry-save counters, one plane for each binary digit, which start so high that the carry out of the
    last digit is the first bit past the radius. The block is abandoned once all have passed it.
    """
    digits = radius.bit_length()
    start = (1 << digits) - (radius + 1)
    counters = [np.full(len(alive), 0xFFFFFFFFFFFFFFFF if start >> d & 1 else 0, np.uint64) for d in range(digits)]
    past = ~alive
    for b in range(BITS):
        carry = planes[fp >> b & 1][b]
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        past |= carry
        if b % 8 == 7 and (past == ALL).all():
            break
    return ~past


def _positions(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def link_block(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left`` (``right`` None) or between the two, by position in
    ``left + right``: as many edges as join its components, so none is lost and a clique gives no
    more than its size."""
    members = left if right is None else right
    n, shift = len(left), 0 if right is None else len(left)
    ones = bit_planes(members)
    planes = (ones, ~ones)
    valid = _first_bits(len(members), ones.shape[1])
    label = np.arange(n + (0 if right is None else len(right)))
    edges = []
    for i in range(n):
        alive = valid
        if right is None:  # later members only: each pair is compared once
            first = (i + 1) // 64
            alive = valid.copy()
            alive[:first] = 0
            if first < len(alive):
                alive[first] &= np.uint64(0xFFFFFFFFFFFFFFFF << (i + 1) % 64 & 0xFFFFFFFFFFFFFFFF)
        if not alive.any():
            continue
        hits = shift + _positions(near(planes, int(left[i]), radius, alive))
        others, at = np.unique(label[hits], return_index=True)
        fresh = others != label[i]
        if fresh.any():
            edges += [(i, int(j)) for j in hits[at[fresh]]]
            label[np.isin(label, others[fresh])] = label[i]
    return edges


def _first_bits(n: int, words: int) -> np.ndarray:
    return np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)


def _link_small(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small buckets that lie one after the other, all compared at once: for each shift the
    planes of the members meet the planes of the members so many places on, in the same bit-sliced counters."""
    a, b = [], []
    ends = np.repeat(starts + sizes, sizes)
    at = np.arange(len(fps))
    for shift in range(1, int(sizes.max(initial=1))):
        i = at[at + shift < ends]
        if not len(i):
            break
        x = bit_planes(fps[i] ^ fps[i + shift])
        hit = _positions(near((x, x), 0, radius, _first_bits(len(i), x.shape[1])))
        a.append(i[hit])
        b.append(i[hit] + shift)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a) if a else empty), (np.concatenate(b) if b else empty)


# Buckets up to this size are compared together.
SMALL = 32


def _linker(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One hash group of buckets: rows ``_table, _key, _b (or null), fp``."""
        out_a, out_b = [], []
        pdf = pdf.sort_values(["_table", "_key", "_pair", "_side", "fp"], ignore_index=True)
        fps = pdf["fp"].to_numpy().view(np.uint64)
        change = (pdf[["_table", "_key", "_pair"]].diff().iloc[1:] != 0).any(axis=1).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        sizes = np.diff(np.append(starts, len(fps)))
        side = pdf["_side"].to_numpy()
        paired = np.maximum.reduceat(side, starts) > 0
        small = (sizes <= SMALL) & ~paired
        keep = np.repeat(small, sizes)
        if keep.any():
            s = sizes[small]
            packed = fps[keep]
            a, b = _link_small(packed, np.concatenate([[0], np.cumsum(s)[:-1]]), s, radius)
            out_a.append(packed[a])
            out_b.append(packed[b])
        for k in np.flatnonzero(~small):
            part, sides = fps[starts[k] : starts[k] + sizes[k]], side[starts[k] : starts[k] + sizes[k]]
            if paired[k]:
                edges = link_block(part[sides == 0], part[sides == 1], radius) if (sides == 0).any() else []
            else:
                edges = link_block(part, None, radius)
            if edges:
                i, j = np.array(edges).T
                out_a.append(part[i])
                out_b.append(part[j])
        none = np.zeros(0, np.uint64)
        a, b = np.concatenate([none, *out_a]), np.concatenate([none, *out_b])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def band_masks(radius: int, bands: int = BANDS) -> list[int]:
    """Bit masks of the tables: every choice of ``bands - radius`` bands."""
    cuts = [round(i * BITS / bands) for i in range(bands + 1)]
    band = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(band, bands - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links between the distinct longs of ``fps`` (column ``fp``) at most ``radius`` bits apart, enough of
    them to connect whatever is connected. Within a bucket each component gives a spanning forest (small
    buckets give their links), so a large group of near copies never emits all its pairs.
    """
    spark = fps.sparkSession
    masks = band_masks(radius)
    tables = F.explode(
        F.array(*[F.struct(F.lit(t).alias("_table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("_key")) for t, m in enumerate(masks)])
    )
    keyed = fps.select("fp", tables.alias("_t")).select("fp", "_t._table", "_t._key")
    sizes = keyed.groupBy("_table", "_key").agg(F.count("*").alias("_n")).where("_n > 1")
    sizes = materialize(sizes, "buckets")
    n = sizes.agg(F.sum("_n").alias("n")).first()["n"] or 0
    shared = keyed.join(sizes, ["_table", "_key"])  # a bucket of one has no pair
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    shared = shared.withColumn("_blocks", blocks).withColumn(
        "_own", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    )
    # A bucket in one block is one piece of work. In a larger one, block i meets block j (i <= j): its own
    # row goes to each of its pairs, on side 0 if it is the first of the two.
    whole = shared.where("_blocks = 1").select(
        "_table", "_key", F.lit(-1).alias("_pair"), F.lit(0).alias("_side"), "fp"
    )
    other = shared.where("_blocks > 1").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    parted = other.select(
        "_table", "_key", (low * F.col("_blocks") + high).cast("int").alias("_pair"),
        F.when(F.col("_own") > F.col("_other"), 1).otherwise(0).alias("_side"), "fp",
    )
    work = whole.unionAll(parted)
    # Many buckets a group: enough groups that one holds about as many rows as a block.
    groups = max(1, -(-n // (8 * BLOCK)))
    group = F.pmod(F.xxhash64("_table", "_key", "_pair"), F.lit(groups)).cast("int")
    return work.withColumn("_group", group).groupBy("_group").applyInPandas(_linker(radius), "a long, b long").where("a <> b")


def simhash_components(
    docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, fp, component_id`` for every row of ``docs``.

    Rows link if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest id that
    links lead to, the row's own included. Null or empty texts have fingerprint zero and link like any
    other. Null ids are never the smallest (null only if a component has no other); repeated rows and ids are
    returned as often as they come; other columns are ignored; an empty table gives no rows.

    Equal fingerprints are collapsed (partial aggregate) before anything is compared, so a group of
    copies, however large, is one fingerprint. Components are found on the fingerprints' links; the join
    back has the rows on a side that Spark may split.
    """
    fps = materialize(fingerprints(docs, width, id_col, text_col).withColumnRenamed(id_col, "_id"), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("_id").alias("_low"))
    links = near_links(distinct.select("fp"), radius)
    roots = connected_components(links)
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("_root"), "_low"
    )
    lows = member.groupBy("_root").agg(F.min("_low").alias("component_id"))
    classes = member.join(lows, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(classes, fps["fp"] == F.col("_fp")).select(F.col("_id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp) -> F.Column:
    """A long's 64 bits as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(
    docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each component of near-duplicates: the one with the smallest id.

    Null ids come last; of rows with one id the one with the smallest hash of its text stays. Rows that agree
    in id and text are one document and come once.

    Representatives are found on (id, hash) alone. A representative that comes once is a row of a semi-join; those that
    repeat, if there are any, are joined apart and collapsed before their shuffle.
    """
    digest = F.xxhash64(F.col(text_col))
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), digest.alias("digest"))
    found = simhash_components(docs.select(key.alias("_row"), F.col(text_col).alias("_text")), width, radius, "_row", "_text")
    stay = found.where(F.col("_row").eqNullSafe(F.col("component_id"))).groupBy("_row").agg(F.count("*").alias("_n"))
    stay = materialize(stay.select(F.col("_row.id").alias("_stay"), F.col("_row.digest").alias("_digest"), "_n"), "representatives")

    def rows(chosen: DataFrame) -> DataFrame:
        same = docs[id_col].eqNullSafe(chosen["_stay"]) & (F.xxhash64(docs[text_col]) == chosen["_digest"])
        return docs.join(chosen, same, "left_semi")

    once, repeated = rows(stay.where("_n = 1")), stay.where("_n > 1")
    if repeated.isEmpty():
        return once
    return once.unionAll(rows(repeated).dropDuplicates([id_col, text_col]))
