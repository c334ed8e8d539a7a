"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) its letters' vectors,
each permuted (rotated) by its place; a text bundles (adds) its n-grams. A language's prototype bundles
the unit vectors of its training texts. A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
SEED = 20240607
# Letters are code points, all of them below this.
LETTERS = 1 << 21
# Training uses about so many texts of each language (all, if it has fewer), chosen by a hash of the id.
TRAIN_PER_LANGUAGE = 5000
# More labels than this are not languages; training stops with an error. It bounds what the driver
# collects and the tasks receive: so many prototypes of 8 KB.
MOST_LANGUAGES = 2000
UNKNOWN = "und"
# n-grams whose vectors are built at once in a task.
BLOCK = 4096


class Profiles:
    """Letter vectors and text vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        if LETTERS**gram > 1 << 63 or dimensions % 64:
            raise ValueError("n-grams of up to three letters, dimensions in multiples of 64")
        self.seed, self.gram, self.dimensions = seed, gram, dimensions

    def letters(self, points: np.ndarray) -> np.ndarray:
        """The random vector of each code point: the bits of a hash of the point and the place, so every letter has its own and no
        table of them is held."""
        words = np.arange(self.dimensions // 64, dtype=np.uint64)
        z = (points.astype(np.uint64)[:, None] << np.uint64(16)) + words + np.uint64(self.seed * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits((z ^ (z >> np.uint64(32))).view(np.uint8), axis=1)
        return (2 * bits.astype(np.int8) - 1).astype(np.int8)

    def codes(self, text: str) -> np.ndarray:
        """The n-grams of a text as numbers, one for each occurrence: lower case, runs of other characters than letters
        as one space."""
        words = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else None
        if words is None:
            words = text.lower().translate(ASCII_LETTERS)
        words = " ".join(words.split())
        if not words:
            return np.zeros(0, np.int64)
        points = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(points) - self.gram + 1
        code = np.zeros(max(n, 0), np.int64)
        for k in range(self.gram):
            code = code * LETTERS + points[k : k + n]
        return code

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams."""
        out = np.ones((len(codes), self.dimensions), np.int8)
        points = [(codes // LETTERS ** (self.gram - 1 - k)) % LETTERS for k in range(self.gram)]
        met, place = np.unique(np.concatenate(points), return_inverse=True)
        letters = self.letters(met)
        for k, at in enumerate(np.split(place, self.gram)):
            out *= np.roll(letters, self.gram - 1 - k, axis=1)[at]
        return out

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors of the texts (zero for a text without a letter). The n-grams of all texts are bound once, block by
        block, and each block is added to the texts that have them."""
        found = [self.codes(t) if t else np.zeros(0, np.int64) for t in texts]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        sizes = [len(c) for c in found]
        if not sum(sizes):
            return out
        row = np.repeat(np.arange(len(texts)), sizes)
        grams, inverse = np.unique(np.concatenate(found), return_inverse=True)
        pairs, times = np.unique(inverse * len(texts) + row, return_counts=True)
        gram_of, row_of = pairs // len(texts), pairs % len(texts)
        for at in range(0, len(grams), BLOCK):
            lo, hi = np.searchsorted(gram_of, [at, at + BLOCK])
            block = self.vectors(grams[at : at + BLOCK]).astype(np.float32)
            counts = np.zeros((len(texts), len(block)), np.float32)
            counts[row_of[lo:hi], gram_of[lo:hi] - at] = times[lo:hi]
            out += counts @ block
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


ASCII_LETTERS = {i: (chr(i) if chr(i).isalpha() else " ") for i in range(128)}
# Texts bundled together in a task, and characters they may have together.
TEXTS, CHARACTERS = 48, 400_000


def _batches(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if len(held) == TEXTS or size >= CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def train_prototypes(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = TRAIN_PER_LANGUAGE,
) -> dict[str, np.ndarray]:
    """Prototype (unit vector) of each language in ``labelled``; rows with a null label or text are not used.

    About ``per_language`` texts of each language are used, those whose hashed id is smallest. Tasks add their texts'
    vectors; the sums are added by (language, dimension), so no language is one task's work.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} distinct labels: not languages")
    if not sizes:
        return {}
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))])
    luck = F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(luck < share[F.col("lang")]).select("lang", "text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            at = 0
            for texts in _batches(batch.column("text").to_pylist()):
                unit = profiles.bundle(texts)
                for lang, v in zip(langs[at : at + len(texts)], unit):
                    sums.setdefault(lang, np.zeros(DIMENSIONS))
                    sums[lang] += v
                at += len(texts)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(v)], ["lang", "i", "x"]
            )

    total = chosen.mapInArrow(add, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out = {}
    for r in total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        v = np.array([x["x"] for x in r["v"]])
        norm = np.linalg.norm(v)
        if norm:
            out[r["lang"]] = v / norm
    return out


def identify_languages(
    docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, lang_pred, score`` for every row: the language with the largest cosine (ties: the smaller label) and that
    cosine, cut to 0 to 1; ``und`` and 0 for a text that is null or has no letter, or without any prototype. Only the
    text is looked at. Repeated rows are predicted as often as they come; an empty table gives no rows.
    """
    labels = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in labels]).astype(np.float32) if labels else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in batches:
            best, scores = [], []
            for texts in _batches(batch.column("text").to_pylist()):
                unit = profiles.bundle(texts)
                empty = ~unit.any(axis=1)
                if matrix is None:
                    best += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                cosine = unit @ matrix.T
                top = cosine.argmax(axis=1)
                best += [UNKNOWN if e else labels[t] for e, t in zip(empty, top)]
                scores += np.where(empty, 0.0, np.clip(cosine.max(axis=1), 0, 1)).astype(float).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                ["id", "lang_pred", "score"],
            )

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether ``crc32(id as text) mod folds`` is ``fold``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
