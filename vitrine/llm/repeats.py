"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``span`` bytes that covers it also starts earlier. As in the construction of a
suffix array by bucket-pointer refinement, suffixes first fall into buckets by a q-gram, and a
bucket is refined by the bucket identifiers of later offsets until ``span`` bytes are told apart; what is
alone in its bucket is settled and takes no further part.

Only content-defined suffixes are dealt out: of each string of ``span`` bytes the smallest q-gram (by hash, the
leftmost of equals) is its anchor, so equal strings have equal anchors at equal places. Anchors seen once are
settled. The others ship the bytes around them, and every string they own is refined in its anchor's bucket. Anchors
that very many texts share would be one unbounded bucket; each of their strings is a bucket of its own, by its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vitrine.llm.common import free_names, materialize, released, small_batches
from vitrine.operators.ranks import dense_numbers

SPAN = 100
GRAM = 40
# Bytes of text that are hashed at once in a task, and anchors it gathers before it lets them go.
SEGMENT = 1 << 20
GATHERED = 250_000
# Places around anchors that a task gathers, and rows in a batch that leaves it.
AROUND = 40_000
BATCH = 10_000
# A bucket of so many places (up to span - gram + 1 strings each) is refined in one task. Of an anchor with more, every string is
# keyed by its own bytes, and only the first place of each string that a task meets is shipped.
HOT = 20_000
# Distinct strings of hot anchors that a task gathers, and the mark of their rows.
STRINGS = 40_000
STRING = -2
# Up to so many hot anchors (9 bytes each) are sent to every task; more are joined by a shuffle.
HOT_SENT = 500_000
# Hex digits of a text's digest that are its number, and up to how many texts with another number are sent to every task.
NUMBER_DIGITS, OTHERS_SENT = 15, 100_000
# Windows refined at once in a task, and those whose bytes are compared at once.
REFINED = 60_000
COMPARED = 8_000

PLACE = np.uint64(0xFFFFFF)
U = np.uint64


# ---------------------------------------------------------------- q-grams


def gram_buckets(data: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifier (a 64-bit hash) of the q-gram at each position, by doubling: the bucket of 2k bytes
    comes from the buckets of k bytes at the position and k later."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, length, out, done = data.astype(np.uint64) + U(1), 1, None, 0
    while True:
        if q & length:
            part = level[done : done + n]
            out = part.copy() if out is None else _combine(out, part, done)
            done += length
        if done == q:
            return out
        level = _combine(level[:-length], level[length:], length)
        length *= 2


def _combine(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    x = (a * U(0x9E3779B97F4A7C15 + 2 * length)) ^ (a >> U(31))
    x += b * U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    return x


def owned_strings(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the strings of ``span`` bytes: place, bucket, and the first and last string start each owns."""
    grams = gram_buckets(data, gram)
    n = len(data) - span + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, size = span - gram + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: n], low[width - size : width - size + n])
    anchor = (low & PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    place = anchor[first]
    return place, grams[place], first, np.append(first[1:], n) - 1


def document_anchors(data: bytes, span: int, gram: int):
    """The anchors of a whole document, segment by segment (segments overlap so that each string is in one)."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(raw) - span + 1), SEGMENT):
        place, bucket, first, last = owned_strings(raw[at : at + SEGMENT + span - 1], span, gram)
        yield place + at, bucket, first + at, last + at


# ---------------------------------------------------------------- step 1: anchors that occur twice


def _anchor_rows(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        gathered = 0

        def release() -> Iterator[pa.RecordBatch]:
            """Anchors met twice here are known to repeat; one of them still tells the other tasks."""
            h, doc, place = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(h, kind="stable")
            h, doc, place = h[order], doc[order], place[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            size = np.diff(np.append(np.flatnonzero(new), len(h)))
            size = np.repeat(size, size)
            key = np.where(new, h, (doc.view(np.uint64) * U(0x9E3779B97F4A7C15)) ^ (place.view(np.uint64) << U(20)))
            kind = np.where(new, np.where(size > 1, 1, 0), 2).astype(np.int8)
            columns = [key.view(np.int64), h.view(np.int64), doc, place, kind, size.astype(np.int64)]
            for at in range(0, len(h), BATCH):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at : at + BATCH]) for c in columns], ["key", "h", "doc", "place", "kind", "n"]
                )

        for batch in batches:
            for text, doc in zip(batch.column("text").to_pylist(), batch.column("doc").to_pylist()):
                if not text or doc in seen:
                    continue
                data = text.encode()
                if len(data) < span:
                    continue
                seen.add(doc)  # a copy has the same anchors
                for place, bucket, _, _ in document_anchors(data, span, gram):
                    held.append((bucket, np.full(len(place), doc, np.int64), place))
                    gathered += len(place)
                if gathered >= GATHERED:
                    yield from release()
                    held.clear()
                    gathered = 0
        if gathered:
            yield from release()

    return run


def _repeated_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key``: those of kind 2 repeat; the others repeat if their bucket has a second occurrence."""
    kept: tuple | None = None  # the last bucket: h, its first row, whether it repeats, its size so far
    for batch in batches:
        c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        direct = c["kind"] == 2
        out = [np.stack([c["h"][direct], c["doc"][direct], c["place"][direct], np.zeros(direct.sum(), np.int64)])]
        h, doc, place, n = (c[x][~direct] for x in ("h", "doc", "place", "n"))
        multi = c["kind"][~direct] == 1
        if len(h):
            if kept is not None and kept[0] == h[0]:
                h, doc, place, n, multi = (
                    np.concatenate([[k], v]) for k, v in zip(kept, (h, doc, place, n, multi))
                )
            elif kept is not None:
                out.append(_settled(*[np.array([k]) for k in kept]))
            # The last bucket may go on in the next batch: one row of it is held back.
            tail = np.flatnonzero(h == h[-1])
            many = bool(multi[tail].any() or (doc[tail] != doc[tail[0]]).any() or (place[tail] != place[tail[0]]).any())
            kept = (h[-1], doc[tail[0]], place[tail[0]], n[tail].sum(), many)
            body = slice(0, tail[0])
            out.append(_settled(h[body], doc[body], place[body], n[body], multi[body]))
            if many and len(tail) > 1:
                rest = tail[1:]
                out.append(np.stack([h[rest], doc[rest], place[rest], np.zeros(len(rest), np.int64)]))
        yield _as_batch(np.concatenate(out, axis=1))
    if kept is not None:
        yield _as_batch(_settled(*[np.array([k]) for k in kept]))


def _settled(h, doc, place, n, multi) -> np.ndarray:
    """Rows of whole buckets that repeat; the first row of a bucket has its size."""
    if not len(h):
        return np.zeros((4, 0), np.int64)
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(start, len(h)))
    base = np.repeat(start, size)
    other = multi.astype(bool) | (doc != doc[base]) | (place != place[base])
    repeats = np.repeat(np.add.reduceat(other.astype(np.int64), start) > 0, size)
    total = np.zeros(len(h), np.int64)
    total[start] = np.add.reduceat(n, start)
    return np.stack([h[repeats], doc[repeats], place[repeats], total[repeats]])


def _as_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], ["h", "doc", "place", "total"])


# ---------------------------------------------------------------- step 2: bytes around them


def _context_rows(span: int, gram: int):
    names = ["key", "id", "doc", "place", "first", "last", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        count = 0
        strings: dict[bytes, tuple[int, int, int]] = {}  # the first place of each string of a hot anchor
        repeats: dict[tuple[int, int], list[list[int]]] = {}

        def add(i: int, doc: int, at: int, string: bytes) -> None:
            new, old = (i, doc, at), strings.setdefault(string, (i, doc, at))
            if new == old:
                return
            if new < old:
                strings[string], new = new, old
            spans = repeats.setdefault(new[:2], [])
            if spans and spans[-1][0] <= new[2] <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], new[2] + span)
            else:
                spans.append([new[2], new[2] + span])

        def batches_of(rows: list[tuple], known: dict) -> Iterator[pa.RecordBatch]:
            for (i, doc), spans in known.items():
                for a, b in merge_spans(spans):
                    rows.append(((doc * 0x9E3779B97F4A7C15 + a) % (1 << 63), i, doc, -1, a, b, None))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            for at in range(0, len(rows), BATCH):
                columns = zip(*rows[at : at + BATCH])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def release_strings() -> Iterator[pa.RecordBatch]:
            rows = [(xxh64_intdigest(x) - (1 << 63), i, doc, STRING, at, at, x) for x, (i, doc, at) in strings.items()]
            yield from batches_of(rows, repeats)
            strings.clear()
            repeats.clear()

        def release() -> Iterator[pa.RecordBatch]:
            """Of equal surroundings met here, the earliest is shipped; the others are known to repeat."""
            rows, known = [], {}
            for (key, _, part), at in held.items():
                at.sort()
                i, doc, place, first, last = at[0]
                rows.append((key, i, doc, place, first, last, part))
                for i, doc, place, first, last in at[1:]:
                    if (i, doc, place) != at[0][:3]:
                        known.setdefault((i, doc), []).append((first, last + span))
            yield from batches_of(rows, known)

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("id", "doc", "text", "places", "hot")]
            for i, doc, text, places, hot in zip(*cols):
                data, places, hot = text.encode(), np.array(places, np.int64), set(hot)
                for place, bucket, first, last in document_anchors(data, span, gram):
                    chosen = np.isin(place, places)
                    for p, h, a, b in zip(*(x[chosen].tolist() for x in (place, bucket.view(np.int64), first, last))):
                        if p in hot:
                            for at in range(a, b + 1):
                                add(i, doc, at, data[at : at + span])
                        else:
                            held.setdefault((h, p - a, data[a : b + span]), []).append((i, doc, p, a, b))
                            count += 1
                    if len(strings) >= STRINGS or len(repeats) >= STRINGS:
                        yield from release_strings()
                if count >= AROUND:
                    yield from release()
                    held.clear()
                    count = 0
        if held:
            yield from release()
        yield from release_strings()

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# ---------------------------------------------------------------- step 3: refinement


def refine(
    group: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, parts: list[bytes], span: int
) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of every string that an earlier row has at the same distance from its anchor.

    Rows come in order (earlier first) within a ``group``; ``parts[i]`` holds the bytes from ``first[i]`` to the end of
    the string that starts at ``last[i]``.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
    count = last - first + 1
    row = np.repeat(np.arange(len(group)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[row] + step
    half = span // 2
    grams = gram_buckets(data, half)
    start = first[row] + step
    # First bucket: the anchor's, by the distance to it and the first half; then the half that follows.
    bucket = _combine((group[row].astype(np.uint64) << U(32)) ^ (place[row] - start).astype(np.uint64), grams[at], 3)
    live = np.arange(len(row))
    for offset in (span - half, None):
        ids, counts = _shared(bucket[live])
        live = live[counts > 1]
        if offset is None or not len(live):
            break
        bucket[live] = _combine(ids[counts > 1], grams[at[live] + offset], 5)
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = live[np.argsort(bucket[live], kind="stable")]
    new = np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    rest, heads = order[~new], head[~new]
    same = np.ones(len(rest), bool)
    for i in range(0, len(rest), COMPARED):  # the buckets are hashes: the bytes decide
        x = at[rest[i : i + COMPARED], None] + np.arange(span)
        y = at[heads[i : i + COMPARED], None] + np.arange(span)
        same[i : i + COMPARED] = (data[x] == data[y]).all(axis=1)
    found = rest[same]
    if not same.all():
        found = np.concatenate([found, _by_bytes(rest[~same], heads[~same], at, data, span)])
    return row[found], start[found]


def _by_bytes(rest: np.ndarray, heads: np.ndarray, at: np.ndarray, data: np.ndarray, span: int) -> np.ndarray:
    """Strings that share a hash with another string: told apart by their bytes."""
    met, out = set(), []
    for r, h in zip(rest.tolist(), heads.tolist()):
        key = (h, data[at[r] : at[r] + span].tobytes())
        if key in met:
            out.append(r)
        met.add(key)
    return np.array(out, np.int64)


def _shared(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element its bucket's identifier and size."""
    _, inverse, counts = np.unique(bucket, return_inverse=True, return_counts=True)
    return inverse.astype(np.uint64), counts[inverse]


def _repeat_rows(span: int):
    """Rows sorted by ``key``; rows without bytes are spans already known. Of the rows of one string of a hot anchor (one
    or a few a task) only the first so far is held; the others repeat."""

    def solve(rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: r[:4])
        rows = [r for k, r in enumerate(rows) if not k or r[:6] != rows[k - 1][:6]]  # a row that came twice
        if len(rows) < 2:
            return []
        key, ids, doc, place, first, last = (np.array(c, np.int64) for c in list(zip(*rows))[:6])
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        r, s = refine(group, place, first, last, [x[6] for x in rows], span)
        order = np.lexsort((s, r))
        r, s = r[order], s[order]
        if not len(r):
            return []
        cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] > s[:-1] + span)]))
        end = np.append(cut[1:], len(r)) - 1
        return list(zip(ids[r[cut]].tolist(), doc[r[cut]].tolist(), s[cut].tolist(), (s[end] + span).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "doc", "start", "end"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        held: list[tuple] = []
        strings = 0
        key, firsts = None, {}
        for batch in batches:
            rows = list(zip(*[batch.column(n).to_pylist() for n in ("key", "id", "doc", "place", "first", "last", "bytes")]))
            out = [(r[1], r[2], r[4], r[5]) for r in rows if r[6] is None]
            for r in rows:
                if r[6] is not None and r[3] == STRING:
                    if r[0] != key:
                        key, firsts = r[0], {}
                    new = (r[1], r[2], r[4])
                    old = firsts.setdefault(r[6], new)
                    if new != old:
                        firsts[r[6]] = min(new, old)
                        i, doc, at = max(new, old)
                        out.append((i, doc, at, at + span))
            yield batch_of(out)
            for r in rows:
                if r[6] is None or r[3] == STRING:
                    continue
                if strings >= REFINED and r[0] != held[-1][0]:  # whole buckets only
                    yield batch_of(solve(held))
                    held, strings = [], 0
                held.append(r)
                strings += r[5] - r[4] + 1
        if held:
            yield batch_of(solve(held))

    return run


# ---------------------------------------------------------------- operator


def _digest_number(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, NUMBER_DIGITS), 16, 10).cast("long")


def other_numbers(texts: DataFrame) -> DataFrame | None:
    """``digest, other`` of the texts whose ``_digest_number`` an earlier text (by digest) has, numbered from 2^60 on; None if there
    are none, as is nearly always so. With these, numbers tell all texts apart."""
    number = _digest_number("digest")
    shared = texts.groupBy(number.alias("number")).agg(F.count("*").alias("n"), F.min("digest").alias("first")).where("n > 1")
    shared = materialize(shared, "numbers-shared")
    if shared.isEmpty():
        return None
    later = texts.select("digest", number.alias("number")).join(shared, "number").where("digest <> first").select("digest")
    return materialize(dense_numbers(later, ["digest"], "other", start=1 << 60), "numbers-other")


def _numbered(df: DataFrame, others: DataFrame | None) -> DataFrame:
    """``df`` plus ``doc``, the number of its ``digest``."""
    if others is None:
        return df.withColumn("doc", _digest_number("digest"))
    others = F.broadcast(others) if others.count() <= OTHERS_SENT else others
    joined = df.join(others, "digest", "left").withColumn("doc", F.coalesce("other", _digest_number("digest")))
    return joined.drop("other")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM
) -> DataFrame:
    """``_id, _digest, n_bytes, is_copy, spans`` for every distinct (id, text) of ``docs``.

    ``spans`` holds the byte ranges ``[start, end)`` (any order, may overlap; null: none) covered by strings of
    ``span`` bytes that also start earlier: in a text with a smaller id (nulls first, then by SHA-256 where
    two texts have one id) or earlier in the same text. ``is_copy``: the same text has an earlier id, so all of it is covered if it
    has ``span`` bytes. Rows that repeat an (id, text) are one document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    low = -(1 << 63)
    base = docs.select(
        F.coalesce(F.col(id_col), F.lit(low)).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    meta = materialize(
        base.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).distinct(), "texts"
    )
    first = meta.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("n_bytes").alias("n_bytes"))
    # The document's number in all steps.
    others = other_numbers(first)
    base, meta = _numbered(base, others), _numbered(meta, others)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = base.select("text", "doc").mapInArrow(
        released(_anchor_rows(span, gram)), "key long, h long, doc long, place long, kind byte, n long"
    )
    repeated = materialize(
        anchors.repartition(parts, "key")
        .sortWithinPartitions("key")
        .mapInArrow(released(_repeated_rows), "h long, doc long, place long, total long"),
        "anchors",
    )
    # A bucket's size stands in one of its rows, so the hot anchors are a filter of the table.
    hot = repeated.where(F.col("total") > HOT).select("h", F.lit(True).alias("is_hot")).distinct()
    if hot.count() <= HOT_SENT:
        hot = F.broadcast(hot)
    places = (
        repeated.join(hot, "h", "left")
        .groupBy("doc")
        .agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("is_hot"), F.col("place"))).alias("hot"))
    )
    asked = _numbered(first, others).join(places, "doc").select(
        F.col("first_id").alias("id"), F.col("digest"), "places", "hot"
    )
    contexts = (
        base.where(F.octet_length("text") >= span)
        .join(asked, ["id", "digest"])
        .select("id", "doc", "text", "places", "hot")
        .mapInArrow(released(_context_rows(span, gram)), "key long, id long, doc long, place long, first long, last long, bytes binary")
    )
    spans = (
        contexts.repartition(parts, "key")
        .sortWithinPartitions("key")
        .mapInArrow(released(_repeat_rows(span)), "id long, doc long, start long, end long")
        .groupBy("id", "doc")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    status = meta.join(first.select("digest", "first_id"), "digest")
    found = status.join(spans, ["id", "doc"], "left").select(
        F.col("id").alias("_id"), F.col("digest").alias("_digest"), "n_bytes",
        (F.col("id") != F.col("first_id")).alias("is_copy"), "spans",
    )
    return materialize(found, "spans")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN
) -> DataFrame:
    """Every row of ``docs`` with ``text_col`` cut, and ``n_bytes, n_removed, n_spans, kept_sha256`` appended
    (columns of these names are replaced).

    Each byte covered by a string of ``span`` bytes that also starts earlier is gone (see :func:`repeated_spans`);
    ``n_spans`` counts the maximal removed runs, ``kept_sha256`` is of the remaining bytes. Where a run
    cuts a character in two, ``text_col`` leaves its other bytes out; the digest has them. A null text counts as empty and
    stays null. Repeated rows are one document and get one result, as often as they come. An
    empty table gives no rows.

    Tasks hold one Arrow batch of texts (see :func:`small_batches`), or bounded numbers of anchors and strings; the whole texts are
    shuffled twice, to meet their repeated anchors and their spans.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*added)
    columns = docs.columns
    spans = repeated_spans(docs, id_col, text_col, span)
    d, i, digest, size, copied, found = free_names(columns, "d", "id", "digest", "n_bytes", "copy", "spans")
    rows = docs.select("*", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(d))
    low = F.lit(-(1 << 63))
    spans = spans.toDF(i, digest, size, copied, found)
    joined = rows.join(spans, (F.coalesce(F.col(id_col), low) == F.col(i)) & (F.col(d) == F.col(digest)))
    joined = joined.select(*(F.col(f"`{c}`") for c in columns), d, size, copied, found)
    place = columns.index(text_col)
    added_names = (d, size, copied, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, runs, kept = [], [], [], []
            extra = [batch.column(n).to_pylist() for n in added_names]
            for text, digest, size, copy, found in zip(batch.column(text_col).to_pylist(), *extra):
                if copy and size >= span:
                    cuts = [(0, size)]
                else:
                    cuts = merge_spans([(s["start"], s["end"]) for s in found or []])
                if cuts:
                    data, rest, at = text.encode(), [], 0
                    for a, b in cuts:
                        rest.append(data[at:a])
                        at = b
                    left = b"".join([*rest, data[at:]])
                    text, digest = left.decode(errors="ignore"), hashlib.sha256(left).hexdigest()
                texts.append(text)
                removed.append(sum(b - a for a, b in cuts))
                runs.append(len(cuts))
                kept.append(digest)
            out = [batch.column(i) for i in range(len(columns))]
            out[place] = pa.array(texts, pa.string())
            out += [batch.column(added_names[1]), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(out, [*columns, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(released(run), schema + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string")
