"""Phrase collocations, counted in HAT-tries.

A task counts phrases in a shallow trie over word numbers whose leaves are hash containers; a container that grows too
large bursts into a node with one container per next word. When the trie holds too much, whole
subtrees leave it as runs sorted by phrase. The runs of all tasks meet by prefix (the first two words, as one word alone may begin
a large part of all phrases), and a prefix partition merges its subtrees.

Most phrases are found once or twice and never matter. They are sifted out first, level by level: a phrase can only be frequent if
its parts are. Tasks count hashes of a level's phrases, and what reaches the least count becomes a bit table of
fixed size. A phrase that shares its bits with a frequent one comes through for nothing; none is lost, and
the counts are the trie's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.alignment import sum_by
from vitrine.llm.common import materialize, parts_for
from vitrine.operators.ranks import dense_numbers

# Words of a phrase at most, and the bits a word's number takes in a packed phrase.
LONGEST, WORD_BITS = 4, 21
# Entries that burst a container, entries a trie holds before subtrees are spilled, and the share that stays.
BURST, HELD, STAYS = 2_048, 1_200_000, 0.5
# Words that a task numbers before it begins anew, and hashes or phrases it gathers before they are counted.
NUMBERED, GATHERED = 600_000, 3_000_000
# Text read at once, and text whose hashes meet in one group, in bytes.
SLICE, GROUP = 1_000_000, 16_000_000
# Bits of the table of frequent phrases (8 MB), in rows of 32,768 bits.
TABLE_BITS, ROW_BITS = 26, 15
# A hash's first bits choose its group, the next 32 name it there.
GROUP_BITS = 20
# Up to so many languages (a few dozen bytes each) are sent to every task.
LANGUAGES_SENT = 100_000
# Phrases that are ranked in one task.
RANKED = 20_000

# A-Z to lower case, the marks that end a piece to a line feed, tabs to spaces.
FOLD = bytes(
    ord("\n") if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
# The words after a cut inside a piece, which only finish phrases there.
AHEAD = re.compile(rb" +[^ \n]+(?: +[^ \n]+){0,%d}" % (LONGEST - 2))
# The end of a piece, as a word that no UTF-8 text holds.
END = b"\xff"
U = np.uint64


class WordNumbers(dict):
    """Numbers of words (bytes) of a language, from 1 on in order of appearance, and their hashes; the end of a piece is 0."""

    def __init__(self, lang: str):
        super().__init__({END: 0})
        self.names = [b""]
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.hashed = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        self[word] = n = len(self.names) - 1
        return n

    def read(self, data: bytes) -> np.ndarray:
        """Word numbers of folded text, 0 at the end of every piece."""
        words = data.replace(b"\n", b" " + END + b" ").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        new = self.names[len(self.hashed) :]
        if new:
            found = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in new), np.uint64, len(new))
            self.hashed = np.concatenate([self.hashed, found])
        return self.hashed


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase of hash ``a`` and a word of hash ``b`` behind it."""
    x = (a ^ (a >> U(31))) * U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class HatTrie:
    """Counts of phrases of two to ``LONGEST`` words. A phrase is its first word's number and the others packed in one
    number, the next word lowest. A container is a hash table ``rest -> count``; one with over ``BURST``
    entries becomes a node ``next word -> container of what follows`` where words do follow."""

    class Node:
        __slots__ = ("children", "here")

        def __init__(self):
            self.children: dict = {}
            self.here: dict = {}  # phrases that end with one more word

    def __init__(self):
        self.root: dict[int, dict | HatTrie.Node] = {}
        self.size: dict[int, int] = {}
        self.entries = 0

    def add(self, first: int, rests: list[int], counts: list[int]) -> None:
        """Adds the phrases that begin with the word ``first``."""
        container = self.root.get(first)
        if container is None:
            container = self.root[first] = {}
        new = self._add(container, rests, counts)
        self.entries += new
        self.size[first] = self.size.get(first, 0) + new
        if type(container) is dict and len(container) > BURST and any(rest >> WORD_BITS for rest in rests):
            self.root[first] = self._burst(container)

    def _add(self, at, rests: list[int], counts: list[int]) -> int:
        if type(at) is dict:
            before = len(at)
            get = at.get
            for rest, n in zip(rests, counts):
                at[rest] = get(rest, 0) + n
            return len(at) - before
        new = 0
        mask = (1 << WORD_BITS) - 1
        for rest, n in zip(rests, counts):
            word, more = rest & mask, rest >> WORD_BITS
            if not more:
                new += word not in at.here
                at.here[word] = at.here.get(word, 0) + n
                continue
            child = at.children.get(word)
            if child is None:
                child = at.children[word] = {}
            new += self._add(child, [more], [n])
            if type(child) is dict and len(child) > BURST and more >> WORD_BITS:
                at.children[word] = self._burst(child)
        return new

    def _burst(self, container: dict) -> HatTrie.Node:
        node = HatTrie.Node()
        self._add(node, list(container), list(container.values()))
        return node

    def _walk(self, at, depth: int, prefix: int) -> Iterator[tuple[int, int]]:
        if type(at) is dict:
            for rest, n in at.items():
                yield prefix | rest << depth * WORD_BITS, n
            return
        for word, n in at.here.items():
            yield prefix | word << depth * WORD_BITS, n
        for word, child in at.children.items():
            yield from self._walk(child, depth + 1, prefix | word << depth * WORD_BITS)

    def take(self, first: int) -> Iterator[tuple[int, int]]:
        """Removes a whole subtree: ``(rest, count)`` of its phrases."""
        self.entries -= self.size.pop(first)
        return self._walk(self.root.pop(first), 0, 0)

    def largest(self, stay: int) -> list[int]:
        """The first words of the largest subtrees, so many that at most ``stay`` entries are left."""
        out, left = [], self.entries
        for first in sorted(self.size, key=self.size.get, reverse=True):
            if left <= stay:
                break
            out.append(first)
            left -= self.size[first]
        return out


class PhraseTable:
    """Bits of the hashes of one level's phrases that may be frequent."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> U(32 - GROUP_BITS)) & U((1 << TABLE_BITS) - 1)
        return (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


class Phrases:
    """The phrases of folded text that pass the tables so far, at the places where they begin."""

    def __init__(self, tables: list[PhraseTable]):
        self.tables = tables
        self.numbers: dict[str, WordNumbers] = {}
        self.passed: dict[str, np.ndarray] = {}

    def begin_anew(self) -> None:
        self.numbers.clear()
        self.passed.clear()

    def many(self) -> bool:
        words = [len(n.names) for n in self.numbers.values()]
        return sum(words) > NUMBERED or max(words, default=0) + SLICE >= 1 << WORD_BITS

    def read(self, lang: str, data: bytes, ahead: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(words, ids, places, hashes)`` for each length whose level's table is there, and for one level more; the last
        ``ahead`` words begin nothing."""
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = WordNumbers(lang)
        ids = numbers.read(data)
        here, hashes = len(ids) - ahead, numbers.hashes()
        known = self.passed.get(lang)
        if known is None or len(known) < len(hashes):
            known = self.tables[0].has(hashes) if self.tables else np.ones(len(hashes), bool)
            known[0] = False
            self.passed[lang] = known
        ok, hashes = known[ids], hashes[ids]
        at = np.flatnonzero(ok[:here])
        yield 1, ids, at, hashes[at]
        if len(self.tables) < 1:
            return
        # Pairs of frequent words, then runs of frequent pairs.
        starts = np.flatnonzero(ok[:-1] & ok[1:])
        pairs = _mix(hashes[starts], hashes[starts + 1])
        if len(self.tables) > 1:
            fits = self.tables[1].has(pairs)
            starts, pairs = starts[fits], pairs[fits]
        chosen = starts < here
        yield 2, ids, starts[chosen], pairs[chosen]
        if len(self.tables) < 2:
            return
        linked = np.zeros(len(ids) + LONGEST, bool)
        linked[starts] = True
        run, found = starts, pairs
        for n in range(3, LONGEST + 1):
            goes_on = linked[run + n - 2]
            run, found = run[goes_on], found[goes_on]
            found = _mix(found, hashes[run + n - 1])
            fits = run < here
            if len(self.tables) > 2:
                fits &= self.tables[2].has(found)
            run, found = run[fits], found[fits]
            yield n, ids, run, found


def _group(hashes: np.ndarray, groups: int) -> np.ndarray:
    return ((hashes >> U(64 - GROUP_BITS)) * U(groups)) >> U(GROUP_BITS)


def _spans(group: np.ndarray) -> list[tuple[int, int, int]]:
    """``(group, first, end)`` of the runs of a sorted array."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return list(zip(group[start].tolist(), start.tolist(), [*start[1:].tolist(), len(group)]))


# ---------------------------------------------------------------- sifting


def _blobs(level: int, tables: list, groups: int):
    """Counts the hashes of a level's phrases; a row has those of one group, in order, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases([PhraseTable(t.value) for t in tables])
        held: list[np.ndarray] = []
        gathered = 0

        def release() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(first, len(h))).astype("<u4")
            h = h[first]
            name = ((h >> U(32 - GROUP_BITS)) & U(0xFFFFFFFF)).astype("<u4")
            spans = _spans(_group(h, groups))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _, _ in spans], pa.int32()), pa.array([name[i:j].tobytes() for _, i, j in spans], pa.binary()),
                    pa.array([count[i:j].tobytes() for _, i, j in spans], pa.binary()),
                ],
                ["part", "names", "counts"],
            )

        for batch in batches:
            for lang, data, ahead in _blocks(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for n, _, _, hashes in phrases.read(lang, data, ahead):
                    if n == level or n > level == 3:
                        held.append(hashes)
                        gathered += len(hashes)
                if phrases.many():
                    phrases.begin_anew()
                if gathered >= GATHERED:
                    yield release()
                    held.clear()
                    gathered = 0
        if gathered:
            yield release()

    return run


def _reaching(least: int):
    """Rows sorted by group: the table places of the hashes that reach ``least`` over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, counts = None, [], []

        def settle() -> pa.RecordBatch:
            name, total = sum_by(np.concatenate(names), np.concatenate(counts).astype(np.int64))
            at = np.unique(name[total >= least].astype(np.int64) & ((1 << TABLE_BITS) - 1))
            return pa.RecordBatch.from_arrays(
                [pa.array(at >> ROW_BITS), pa.array(at & ((1 << ROW_BITS) - 1))], ["row", "bit"]
            )

        for batch in batches:
            for p, name, count in zip(*(batch.column(c) for c in ("part", "names", "counts"))):
                if p.as_py() != part and names:
                    yield settle()
                    names, counts = [], []
                part = p.as_py()
                names.append(np.frombuffer(name.as_buffer(), "<u4"))
                counts.append(np.frombuffer(count.as_buffer(), "<u4"))
        if names:
            yield settle()

    return run


def sift(texts: DataFrame, level: int, tables: list, least: int, groups: int) -> np.ndarray:
    """The bit table of a level (1 words, 2 pairs, 3 longer): at most 2,048 rows of 4 KB reach the driver, however many phrases
    there are. A group's hashes, about ``GROUP`` bytes of text, meet in one task."""
    places = (
        texts.mapInArrow(_blobs(level, tables, groups), "part int, names binary, counts binary")
        .repartition(groups, "part")
        .sortWithinPartitions("part")
        .mapInArrow(_reaching(least), "row long, bit long")
    )
    bits = np.zeros((1 << TABLE_BITS - ROW_BITS, 1 << ROW_BITS - 3), np.uint8)
    for r in places.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[r["row"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits.ravel()


# ---------------------------------------------------------------- counting


def _join(names: list[bytes], first: int, rest: int) -> bytes:
    words, mask = [names[first]], (1 << WORD_BITS) - 1
    while rest:
        words.append(names[rest & mask])
        rest >>= WORD_BITS
    return b" ".join(words)


class Counter:
    """One task's count of the phrases that pass the tables, and of all words."""

    def __init__(self, tables: list[PhraseTable]):
        self.phrases = Phrases(tables)
        self.tries: dict[str, HatTrie] = {}
        self.words: dict[str, int] = {}
        self.held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.gathered = 0

    def count(self, lang: str, data: bytes, ahead: int = 0) -> None:
        for n, ids, at, _ in self.phrases.read(lang, data, ahead):
            if n == 1:
                self.words[lang] = self.words.get(lang, 0) + int(np.count_nonzero(ids[: len(ids) - ahead]))
            if len(at):
                rest = np.zeros(len(at), np.int64)
                for k in range(n - 1, 0, -1):
                    rest = rest << WORD_BITS | ids[at + k]
                self.held.setdefault((lang, n), []).append((ids[at], rest))
                self.gathered += len(at)
        if self.gathered >= GATHERED:
            self.gather()

    def gather(self) -> None:
        """Puts what was met since into the tries, equal phrases at once."""
        for (lang, _), parts in self.held.items():
            first, rest = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((rest, first))
            first, rest = first[order], rest[order]
            starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
            counts = np.diff(np.append(starts, len(first)))
            first, rest = first[starts], rest[starts]
            heads = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])).tolist()
            rests, counts, firsts = rest.tolist(), counts.tolist(), first[heads].tolist()
            trie = self.tries.get(lang)
            if trie is None:
                trie = self.tries[lang] = HatTrie()
            for word, i, j in zip(firsts, heads, [*heads[1:], len(rests)]):
                trie.add(word, rests[i:j], counts[i:j])
        self.held.clear()
        self.gathered = 0

    def full(self) -> bool:
        return sum(t.entries for t in self.tries.values()) > HELD or self.phrases.many()

    def spill(self, everything: bool, groups: int) -> Iterator[tuple[str, int, list[bytes], list[int]]]:
        """``(lang, prefix partition, phrases, counts)``: sorted runs of the subtrees that go, which are all (also when words have to be
        numbered anew), or the largest until ``STAYS`` of ``HELD`` are left. All words of a language are the count of the empty phrase."""
        everything = everything or self.phrases.many()
        if everything:
            self.gather()
        entries = sum(t.entries for t in self.tries.values())
        for lang, trie in self.tries.items():
            numbers = self.phrases.numbers[lang]
            goes = list(trie.root) if everything else trie.largest(int(trie.entries * STAYS * HELD / max(entries, 1)))
            found = [(first, rest, n) for first in goes for rest, n in trie.take(first)]
            if not found:
                continue
            first, rest, count = (np.array(x, np.int64) for x in zip(*found))
            hashed = numbers.hashes()
            part = _group(_mix(hashed[first], hashed[rest & ((1 << WORD_BITS) - 1)]), groups)
            order = np.argsort(part, kind="stable")
            chosen = [found[k] for k in order.tolist()]
            for group, i, j in _spans(part[order]):
                run = sorted((_join(numbers.names, first, rest), n) for first, rest, n in chosen[i:j])
                yield lang, group, [p for p, _ in run], [n for _, n in run]
        if everything:
            for lang, n in self.words.items():
                yield lang, 0, [b""], [n]
            self.words.clear()
            self.tries.clear()
            self.phrases.begin_anew()


def _blocks(langs: list, texts: list) -> Iterator[tuple[str, bytes, int]]:
    """``(lang, folded text, words ahead)``: texts of one language joined by line feeds, about ``SLICE`` bytes at a time. A longer text
    is cut at the end of a piece; a longer piece between words, with the words that finish its phrases once more ahead."""
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(langs, texts):
        data = text.encode().translate(FOLD) if text else b""
        while len(data) > 2 * SLICE:
            cut = data.rfind(b"\n", 0, SLICE)
            if cut < 0:
                cut = data.find(b" ", SLICE)
                if cut < 0:
                    break
            more = AHEAD.match(data, cut)
            yield lang, data[: more.end() if more else cut], len(more.group().split()) if more else 0
            data = data[cut:]
        waiting.setdefault(lang, []).append(data)
        size[lang] = size.get(lang, 0) + len(data)
        if size[lang] > SLICE:
            yield lang, b"\n".join(waiting.pop(lang)), 0
            size[lang] = 0
    for lang, parts in waiting.items():
        yield lang, b"\n".join(parts), 0


def _runs(tables: list, groups: int):
    """Counts the phrases that pass the tables; a row is a sorted run of one prefix partition, its phrases between line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter([PhraseTable(t.value) for t in tables])

        def out(everything: bool) -> Iterator[pa.RecordBatch]:
            for lang, part, phrases, counts in counter.spill(everything, groups):
                columns = [[lang], [part], [b"\n".join(phrases)], [np.array(counts, "<i8").tobytes()]]
                kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "part", "phrases", "counts"]
                )

        for batch in batches:
            for lang, data, ahead in _blocks(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counter.count(lang, data, ahead)
                if counter.full():
                    yield from out(False)
        yield from out(True)

    return run


def _merged(least: int):
    """Rows sorted by prefix partition and language: the phrases of their runs that reach ``least``, and all words as the
    empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, {}

        def settle() -> pa.RecordBatch:
            kept = [(p, n) for p, n in total.items() if n >= least or not p]
            phrases = pa.array([p for p, _ in kept], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array([key[1]] * len(kept), pa.string()), phrases, pa.array([n for _, n in kept], pa.int64())],
                ["lang", "phrase", "n"],
            )

        for batch in batches:
            for part, lang, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "phrases", "counts"))):
                if (part, lang) != key and total:
                    yield settle()
                    total = {}
                key = part, lang
                get = total.get
                for p, n in zip(phrases.split(b"\n"), np.frombuffer(counts, "<i8").tolist()):
                    total[p] = get(p, 0) + n
        if total:
            yield settle()

    return run


def _counts(texts: DataFrame, tables: list, least: int, groups: int) -> DataFrame:
    """``lang, phrase, n`` of the phrases that pass the tables and reach ``least``, and of all words as the empty phrase."""
    return (
        texts.mapInArrow(_runs(tables, groups), "lang string, part int, phrases binary, counts binary")
        .repartition(groups, "part")
        .sortWithinPartitions("part", "lang")
        .mapInArrow(_merged(least), "lang string, phrase string, n long")
    )


def frequent_phrases(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of every phrase of one to ``LONGEST`` words found ``least`` times or more in its
    language, and ``lang, n`` of all words. Both are tables in the shared folder.

    The texts are read five times: for their size, to sift words, pairs and longer phrases, and to count what is left.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = min(parts_for(size, GROUP), 1 << GROUP_BITS)
    tables: list = []
    for level in (1, 2, 3):
        tables.append(spark.sparkContext.broadcast(sift(texts, level, tables, least, groups)))
    counted = materialize(_counts(texts, tables, least, groups), "phrases")
    totals = counted.where("phrase = ''").select("lang", "n")
    found = counted.where("phrase <> ''").withColumn("words", F.size(F.split("phrase", " ", -1)))
    return found, totals


def mine_collocations(
    docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, part_of: int = 80,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to 4 words.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into words; phrases
    lie in a piece. A candidate is found ``a >= least`` times; cut after its first k words, its parts are found l and r
    times and it scores floor(scale * a / (l + r)); its lowest cut counts (of equal ones the first). A candidate inside a longer one that is found
    at least ``part_of`` percent as often is left out. Ranks go by score, then a, both falling, then the phrase's bytes.

    A null language is ``und``; a null or empty text has no words; repeated rows count as often as they come, other columns are
    ignored, an empty table gives no rows. Arithmetic is in 38-digit decimals and whole division.

    All that follows the counts works on frequent phrases alone. Phrases are ranked by ranges of the order of all
    languages, so a hot language is no task of its own.
    """
    phrases, totals = frequent_phrases(docs, least, text_col, lang_col)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    candidates = phrases.where("words > 1").withColumnRenamed("n", "a")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*",
        F.expr("substring_index(phrase, ' ', k)").alias("left"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("right"),
    )
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = (
        cuts.join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .withColumn("product", F.lit(scale).cast("decimal(10,0)") * exact("a"))
        .withColumn("parts", (exact("l") + exact("r")).cast("decimal(21,0)"))
        .withColumn("score", F.expr("product div parts"))
        .groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), w -> transform(sequence(1, words - w + 1), "
        "i -> array_join(slice(split(phrase, ' ', -1), i, w), ' '))))"
    )
    covers = (
        candidates.where("words > 2")
        .select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    covered = F.col("longer").isNotNull() & (exact("longer") * 100 >= exact("a") * part_of)
    kept = scored.join(covers, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a", "cut.*")
    order = ["lang", "down", "rarely", "phrase"]
    kept = kept.withColumns({"down": -F.col("score"), "rarely": -F.col("a")})
    placed = materialize(dense_numbers(kept, order, "place", range_rows=RANKED), "ranked")
    first = placed.groupBy(F.col("lang").alias("its")).agg(F.min("place").alias("first"))
    few = totals.count() <= LANGUAGES_SENT
    sent = F.broadcast if few else (lambda df: df)
    ranked = placed.join(sent(first), F.col("lang") == F.col("its")).withColumn("rank", F.col("place") - F.col("first") + 1)
    ranked = ranked.where(F.col("rank") <= top).join(sent(totals), "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
