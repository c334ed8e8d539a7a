"""Alignment of two tokenizers by products of token-byte incidence matrices.

A token is a row over the bytes of the text that it covers. With the rows of both tokenizers as compressed sparse rows (CSR),
the product A·Bᵀ holds the bytes that two tokens share: the overlap links. Where one link and the next share no token, tokens of both
end: there the text is cut into groups. The product of the two token-group incidences holds the links of tokens that share a group.

Texts are cut into chunks that neither tokenizer's tokens cross; an unknown chunk goes through both libraries
and the products once per worker, a known one is looked up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bpe import byte_alphabet
from vitrine.llm.common import materialize

# Text a task works on at once, and the bytes of chunks that a worker remembers (those met least go when it is full).
SLICE_CHARS, REMEMBERED_BYTES = 2_000_000, 160_000_000
# Products of a row block that are held at once.
BLOCK = 2_000_000
# Id pairs that a task counts before it hands them on, and the most frequent pairs that every task holds.
COUNTED, HEAD = 2_000_000, 1_000_000
# What is counted of a text.
SIZES = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
# A space after one of these characters starts a new chunk.
CHUNK = re.compile("(?<=[!-~À-ɏ]) ")
# One of these marks behind one of these letters, at the end of a chunk, is a chunk of its own.
MARKS, LETTERS = frozenset(".,;:!?"), frozenset(chr(c) for c in range(0x250) if chr(c).isalpha())
MARKED = re.compile("[A-Za-zªµºÀ-ɏ][.,;:!?]")


# ---------------------------------------------------------------- CSR products


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``lengths[i]`` numbers) for every i, in one array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def csr_product(a: tuple, b: tuple, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's row-by-row product of two CSR matrices ``(indptr, indices, data)``, as ``(rows, columns, data)`` sorted
    by row and column: the row of the product is the sum of the rows of ``b`` that the row's entries in ``a`` name, scaled
    by them. Rows are taken in blocks of about ``BLOCK`` products, so one with very many is the only large one."""
    ap, ai, ad = a
    bp, bi, bd = b
    widths = bp[ai + 1] - bp[ai]
    work = np.concatenate([[0], np.cumsum(widths)])[ap]
    rows = np.repeat(np.arange(len(ap) - 1), np.diff(ap))
    out, first = [], 0
    while first < len(ap) - 1:
        last = max(first + 1, int(np.searchsorted(work, work[first] + BLOCK, "right")) - 1)
        entries = slice(ap[first], ap[last])
        lens = widths[entries]
        at = spread(bp[ai[entries]], lens)
        key = np.repeat(rows[entries], lens) * columns + bi[at]
        value = np.repeat(ad[entries], lens) * bd[at]
        key, value = sum_by(key, value)
        out.append((key // columns, key % columns, value))
        first = last
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def sum_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of the values of each."""
    if not len(key):
        return key, value
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key)
        key, value = key[order], value[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    return key[first], np.add.reduceat(value, np.flatnonzero(first))


def pointers(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, bytes shared)`` of every two tokens that overlap, from the byte lengths of two runs of tokens over the
    same bytes: A (tokens x bytes) times Bᵀ (bytes x tokens), where a byte's row names its one token."""
    size = int(a_lengths.sum())
    ones = np.ones(size, np.int64)
    a = pointers(a_lengths), np.arange(size), ones
    b_t = np.arange(size + 1), np.repeat(np.arange(len(b_lengths)), b_lengths), ones
    return csr_product(a, b_t, max(len(b_lengths), 1))


def groups_of(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every token of both runs, from their overlap links, and the number of groups. Links come in the order of the bytes; one
    that shares neither token with the link before it begins a group."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    group = np.concatenate([[0], np.cumsum((rows[1:] != rows[:-1]) & (columns[1:] != columns[:-1]))])
    a_group, b_group = np.zeros(rows[-1] + 1, np.int64), np.zeros(columns[-1] + 1, np.int64)
    a_group[rows], b_group[columns] = group, group
    return a_group, b_group, int(group[-1]) + 1


def group_links(a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(a, b)`` of every two tokens that share a group: the product of the two token-group incidences."""
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    a = np.arange(len(a_group) + 1), a_group, np.ones(len(a_group), np.int64)
    b_t = pointers(np.bincount(b_group, minlength=n)), np.arange(len(b_group)), np.ones(len(b_group), np.int64)
    rows, columns, _ = csr_product(a, b_t, max(len(b_group), 1))
    return rows, columns


def id_pair_links(
    owner: np.ndarray, a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, b_size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, a id * b_size + b id, links)``: the links of :func:`group_links` per pair of ids. ``owner[group]`` says what
    text a group belongs to. Equal ids of a group are one entry with its number as value, so a long run of one
    token costs one product, not its square."""
    n = len(owner)
    # Rows (owner, A id) over groups, and groups over B ids.
    a_size = int(a_ids.max()) + 1 if len(a_ids) else 1
    entry, count = sum_by(a_group * a_size + a_ids, np.ones(len(a_ids), np.int64))
    group, a_id = entry // a_size, entry % a_size
    order = np.lexsort((group, a_id, owner[group]))
    group, a_id, count = group[order], a_id[order], count[order]
    row_key = owner[group] * a_size + a_id
    first = np.flatnonzero(np.concatenate([[True], row_key[1:] != row_key[:-1]])) if len(row_key) else np.zeros(0, np.int64)
    a = np.append(first, len(group)), group, count
    entry, count = sum_by(b_group * b_size + b_ids, np.ones(len(b_ids), np.int64))
    b = pointers(np.bincount(entry // b_size, minlength=n)), entry % b_size, count
    rows, columns, links = csr_product(a, b, b_size)
    key = row_key[first[rows]]
    return key // a_size, (key % a_size) * b_size + columns, links


# ---------------------------------------------------------------- the tokenizers


class Aligner:
    """Both tokenizers, and the chunks a worker has seen."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_alphabet()
        a_raw = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_size, self.b_size = max(a_raw) + 1, self.b.vocab_size()
        self.a_raw = [a_raw.get(i, b"") for i in range(self.a_size)]
        self.b_raw = [self._piece(i) for i in range(self.b_size)]
        self.a_bytes = np.array([len(x) for x in self.a_raw], np.int64)
        self.b_bytes = np.array([len(x) for x in self.b_raw], np.int64)
        self.space = self.b.piece_to_id("▁")
        # A token's text in the digest: its id and what follows inside a group, at the end of A's part and of the group.
        self.written = [f"{i}{end}" for end, n in ((",", self.a_size), ("|", self.a_size), (",", self.b_size), (";", self.b_size)) for i in range(n)]
        self.cut = self._independent(CHUNK)
        a_ids, b_ids = ({m: find(m) for m in MARKS} for find in (self.a.token_to_id, self.b.piece_to_id))
        known = self.cut and all(a_ids[m] is not None and self.b_raw[b_ids[m]] == m.encode() for m in MARKS)
        self.marks = {m: (a_ids[m], b_ids[m]) for m in MARKS} if known and self._independent(MARKED) else {}
        self.forget()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def _independent(self, pattern: re.Pattern) -> bool:
        """Whether no entry of either vocabulary has a space behind a character of ``CHUNK`` (or a mark behind a letter): merges then never
        cross the start of a chunk (the mark), and there the split pattern of the byte-level tokenizer always ends a pre-token. Else a text is
        one chunk (marks stay with their words)."""
        return not any(pattern.search(x.decode(errors="replace")) for x in chain(self.a_raw, self.b_raw))

    def forget(self) -> None:
        self.known: dict[str | tuple[str], int] = {}  # marks are known as tuples, apart from words of one mark
        self.held = 0
        self.fragments: list[str] = []  # the groups of a chunk, each ended by ";"
        self.sizes = np.zeros((0, len(SIZES) + 1), np.int64)  # and whether the bytes agree
        self.pointer, self.pairs, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def forget_least(self) -> None:
        """Keeps the half of the chunks that was met most."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.uses) // 2])
        names, fragments = list(self.known), self.fragments
        sizes, pointer, pairs, links, uses = self.sizes, self.pointer, self.pairs, self.links, self.uses
        self.forget()
        chosen = stay.tolist()
        lens = pointer[stay + 1] - pointer[stay]
        at = spread(pointer[stay], lens)
        self.known = {names[k]: i for i, k in enumerate(chosen)}
        self.fragments = [fragments[k] for k in chosen]
        self.sizes, self.pointer, self.pairs, self.links = sizes[stay], pointers(lens), pairs[at], links[at]
        self.uses = uses[stay] // 2
        self.held = self._weight(chosen, sum(len(names[k]) for k in chosen), len(at))

    def _weight(self, chunks: list, chars: int, pairs: int) -> int:
        """Bytes, about, of the last of the chunks held."""
        return 300 * len(chunks) + 2 * chars + 16 * pairs + sum(map(len, self.fragments[len(self.fragments) - len(chunks) :]))

    def chunks(self, text: str) -> list:
        """The chunks of space + text, each without its first character, a space; and the marks behind words, as tuples."""
        if not self.cut:
            return [text]
        parts = CHUNK.split(text)
        if not self.marks:
            return parts
        out = []
        for p in parts:
            if p[-1:] in MARKS and p[-2:-1] in LETTERS:
                out += (p[:-1], (p[-1],))
            else:
                out.append(p)
        return out

    def look_up(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of the chunks of some texts, in one array; chunks not seen yet are aligned first."""
        new = set().union(*texts).difference(self.known)
        size = sum(map(len, new))
        if self.held + 400 * len(new) + 10 * size > REMEMBERED_BYTES:
            self.forget_least()
            new = set().union(*texts).difference(self.known)
        if new:
            self._align(list(new))
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64)
        self.uses += np.bincount(number, minlength=len(self.known))
        return number

    def _align(self, new: list) -> None:
        new.sort(key=lambda c: type(c) is tuple)
        marks = [c[0] for c in new if type(c) is tuple]
        words = new[: len(new) - len(marks)]
        texts = [" " + c for c in words] + marks
        a = [e.ids for e in self.a.encode_batch_fast(texts[: len(words)], add_special_tokens=False)]
        b = [ids if c else [self.space] for c, ids in zip(words, self.b.encode(words, num_threads=1))]
        a += [[self.marks[m][0]] for m in marks]
        b += [[self.marks[m][1]] for m in marks]
        good = np.ones(len(new), bool)
        whole = "".join(texts).encode()
        if not self._joined(a, self.a_raw) == whole == self._joined(b, self.b_raw):
            for k, (t, x, y) in enumerate(zip(texts, a, b)):
                good[k] = self._joined([x], self.a_raw) == t.encode() == self._joined([y], self.b_raw)
                if not good[k]:
                    a[k] = b[k] = ()
        a_n, b_n = np.array(list(map(len, a)), np.int64), np.array(list(map(len, b)), np.int64)
        a_ids, b_ids = np.array(list(chain.from_iterable(a)), np.int64), np.array(list(chain.from_iterable(b)), np.int64)
        rows, columns, _ = overlap_links(self.a_bytes[a_ids], self.b_bytes[b_ids])
        a_group, b_group, n = groups_of(rows, columns)
        chunk = np.repeat(np.arange(len(new)), a_n)
        owner = np.zeros(n, np.int64)
        owner[a_group] = chunk
        n_overlaps = np.bincount(chunk[rows], minlength=len(new))
        who, pair, links = id_pair_links(owner, a_ids, a_group, b_ids, b_group, self.b_size)
        n_links = np.bincount(who, links, len(new)).astype(np.int64)
        n_groups = np.bincount(owner, minlength=len(new))
        self.fragments += self._fragments(a_ids, a_group, b_ids, b_group, a_n + b_n)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.sizes = np.concatenate([self.sizes, np.array([a_n, b_n, n_groups, n_links, n_overlaps, good], np.int64).T])
        ends = self.pointer[-1] + np.cumsum(np.bincount(who, minlength=len(new)))
        self.pointer = np.concatenate([self.pointer, ends])
        self.pairs, self.links = np.concatenate([self.pairs, pair]), np.concatenate([self.links, links])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.held += self._weight(new, len(whole), len(pair))

    @staticmethod
    def _joined(ids: list, raw: list[bytes]) -> bytes:
        return b"".join(map(raw.__getitem__, chain.from_iterable(ids)))

    def _fragments(self, a_ids, a_group, b_ids, b_group, tokens: np.ndarray) -> list[str]:
        """For each chunk, of so many tokens, the text of its groups, ``a1,a2|b1;a3|b2;``."""
        n = int(a_group[-1]) + 1 if len(a_group) else 0
        a_at, b_at = pointers(np.bincount(a_group, minlength=n)), pointers(np.bincount(b_group, minlength=n))
        a_last, b_last = np.arange(len(a_ids)) + 1 == a_at[a_group + 1], np.arange(len(b_ids)) + 1 == b_at[b_group + 1]
        # A group's A tokens, then its B tokens, each named by its place in the table of written tokens.
        merged = np.empty(len(a_ids) + len(b_ids), np.int64)
        merged[np.arange(len(a_ids)) + b_at[a_group]] = a_ids + self.a_size * a_last
        merged[np.arange(len(b_ids)) + a_at[b_group + 1]] = 2 * self.a_size + b_ids + self.b_size * b_last
        names = list(map(self.written.__getitem__, merged.tolist()))
        at = pointers(tokens).tolist()
        return ["".join(names[i:j]) for i, j in zip(at, at[1:])]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its ``SIZES`` (zeros where the bytes differ), the digest of its groups, and its id pairs, as
        ``(pointers, pairs, links of each)``."""
        parts = [self.chunks(t) if t else [] for t in texts]
        number = self.look_up(parts)
        length = np.array([len(p) for p in parts], np.int64)
        doc = np.repeat(np.arange(len(texts)), length)
        bad = np.bincount(doc, self.sizes[number, -1] == 0, len(texts)) > 0
        keep = ~bad[doc]
        doc, number = doc[keep], number[keep]
        sizes = np.stack([np.bincount(doc, self.sizes[number, k], len(texts)) for k in range(len(SIZES))], axis=1).astype(np.int64)
        bounds = pointers(np.bincount(doc, minlength=len(texts))).tolist()
        listed = list(map(self.fragments.__getitem__, number.tolist()))
        digests = [
            hashlib.sha256("".join(listed[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:])
        ]
        # Pairs: equal chunks of a text first, then equal pairs of its chunks.
        size = len(self.known) + 1
        both, times = sum_by(doc * size + number, np.ones(len(doc), np.int64))
        doc, number = both // size, both % size
        lens = self.pointer[number + 1] - self.pointer[number]
        at = spread(self.pointer[number], lens)
        names = self.a_size * self.b_size
        key, links = sum_by(np.repeat(doc, lens) * names + self.pairs[at], np.repeat(times, lens) * self.links[at])
        return sizes, digests, pointers(np.bincount(key // names, minlength=len(texts))), key % names, links


@cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per worker process, so that tasks share the chunks."""
    return Aligner(byte_path, piece_path)


def link_texts(text: str, byte_path: str, piece_path: str) -> dict:
    """One text's alignment in full: ids of both tokenizers, overlap links ``(a, b, bytes)`` and shared-group links
    ``(a, b)`` by place, and the group of every token. Empty lists where there are no tokens."""
    al = aligner(byte_path, piece_path)
    a = al.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = al.b.encode(text) if text else []
    raw = (" " + text).encode() if text else b""
    if not b"".join(al.a_raw[i] for i in a) == raw == b"".join(al.b_raw[i] for i in b):
        a, b = [], []
    rows, columns, shared = overlap_links(al.a_bytes[np.array(a, np.int64)], al.b_bytes[np.array(b, np.int64)])
    a_group, b_group, _ = groups_of(rows, columns)
    return {
        "a": a, "b": b, "a_group": a_group.tolist(), "b_group": b_group.tolist(),
        "overlaps": list(zip(rows.tolist(), columns.tolist(), shared.tolist())),
        "links": list(zip(*(x.tolist() for x in group_links(a_group, b_group)))),
    }


# ---------------------------------------------------------------- Spark


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE_CHARS`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``_row, id``, the sizes, the digest, and the text's id pairs and their links as arrays in binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(byte_path, piece_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _slices(texts):
                sizes, digests, pointer, pairs, links = al.align([t or "" for t in texts[i:j]])
                pairs, links = pairs.astype("<i8"), links.astype("<i8")
                bounds = list(zip(pointer.tolist(), pointer[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_row").slice(i, j - i), batch.column("id").slice(i, j - i),
                        *(pa.array(sizes[:, k]) for k in range(len(SIZES))), pa.array(digests, pa.string()),
                        pa.array([_narrow(pairs[x:y]) for x, y in bounds], pa.binary()),
                        pa.array([_narrow(links[x:y]) for x, y in bounds], pa.binary()),
                    ],
                    ["_row", "id", *SIZES, "groups_sha256", "pairs", "links"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    sizes = ", ".join(f"{c} long" for c in SIZES)
    schema = f"_row long, id {kind}, {sizes}, groups_sha256 string, pairs binary, links binary"
    return docs.mapInArrow(run, schema)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers at the least of 1, 4 and 8 bytes that holds them all; the first byte says which."""
    top = int(x.max()) if len(x) else 0
    kind = "u1" if top < 1 << 8 else "<u4" if top < 1 << 32 else "<u8"
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(data) -> np.ndarray:
    view = memoryview(data)
    return np.frombuffer(view[1:], {1: "u1", 4: "<u4", 8: "<u8"}[view[0]]).astype(np.int64)


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: the texts that hold each id pair. Tasks count what they can hold, Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            pair, n = sum_by(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return pair, n

        held, size = [], 0
        for batch in batches:
            for data in batch.column("pairs"):
                pairs = _wide(data.as_buffer())
                held.append((pairs, np.ones(len(pairs), np.int64)))
                size += len(pairs)
                if size > 2 * COUNTED:
                    pair, n = out(held)
                    if len(pair) > COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
                        held, size = [], 0
                    else:
                        held, size = [(pair, n)], len(pair)
        if held:
            pair, n = out(held)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD
) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps`` for every row of ``docs``.

    ``byte_path`` names a byte-level BPE in the ``tokenizers`` format (A), ``piece_path`` a sentencepiece model with a
    space put before the text (B); both lie on every executor. A reads space + text; special strings inside texts are plain
    text. ``n_overlaps`` counts the token pairs that share bytes, ``n_links`` those that share a group, ``count_sum`` adds up the corpus-wide count of each
    one's id pair (the rows that hold it), ``n_best`` counts those whose count is the highest of their A id. A text that is null or
    empty, or whose tokens' bytes are not those of space + text, has zeros and the digest ''. Repeated rows count as often as they come, other
    columns are ignored, an empty table gives no rows.

    The texts are read once; what a text links is written beside it in the shared folder. Pair counts are
    combined in the tasks, so a pair that every text holds is one row a task. The ``head`` most frequent pairs (at most so
    many, 17 bytes each) go to every task; the pairs of a text that are not among them, rare ones by choice, meet their counts in a
    shuffle join without hot keys. No text's links leave its task but these.
    """
    src = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    aligned = materialize(_aligned(src, byte_path, piece_path), "aligned")
    counts = materialize(_pair_counts(aligned), "pair-counts")
    b_size = aligner(byte_path, piece_path).b_size
    a_id = F.expr(f"pair div {b_size}")
    top = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    judged = materialize(
        counts.withColumn("a", a_id).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")),
        "pairs-judged",
    )
    least = _head_limit(judged, head)
    held = judged.where(F.col("n") >= least).toArrow()
    order = np.argsort(held["pair"].to_numpy())
    table = docs.sparkSession.sparkContext.broadcast(
        tuple(held[c].to_numpy()[order] for c in ("pair", "n", "best"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counted, best = table.value
        for batch in batches:
            rest, n_best, count_sum = [], [], []
            for pairs, links in zip(batch.column("pairs"), batch.column("links")):
                pairs, links = _wide(pairs.as_buffer()), _wide(links.as_buffer())
                at = np.minimum(np.searchsorted(names, pairs), max(len(names) - 1, 0))
                hit = names[at] == pairs if len(names) else np.zeros(len(pairs), bool)
                n_best.append(int(links[hit][best[at[hit]]].sum()))
                count_sum.append(int((links[hit] * counted[at[hit]]).sum()))
                rest.append([{"pair": p, "m": m} for p, m in zip(pairs[~hit].tolist(), links[~hit].tolist())])
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("m", pa.int64())]))
            carried = [batch.column(c) for c in carried_names]
            yield pa.RecordBatch.from_arrays(
                [*carried, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), pa.array(rest, kind)],
                [*carried_names, "n_best", "count_sum", "rest"],
            )

    carried_names = ["_row", "id", *SIZES, "groups_sha256"]
    kind, sizes = aligned.schema["id"].dataType.simpleString(), ", ".join(f"{c} long" for c in SIZES)
    schema = (
        f"_row long, id {kind}, {sizes}, groups_sha256 string, "
        "n_best long, count_sum long, rest array<struct<pair: long, m: long>>"
    )
    scored = materialize(aligned.mapInArrow(run, schema), "scored")
    rare = (
        scored.select("_row", F.explode("rest").alias("e"))
        .select("_row", "e.pair", "e.m")
        .join(judged.where(F.col("n") < least), "pair")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best"),
            F.sum(F.col("m") * F.col("n")).alias("more_sum"),
        )
    )
    more = {c: F.col(c) + F.coalesce(F.col(m), F.lit(0)) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))}
    return scored.drop("rest").join(rare, "_row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        *(more[c].alias(c) for c in ("n_best", "count_sum")), "groups_sha256", "n_overlaps",
    )


def _head_limit(judged: DataFrame, head: int) -> int:
    """The least power of two such that at most ``head`` pairs are counted so often or more."""
    sizes = judged.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("pairs")).collect()
    total, limit = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["power"]):
        total += r["pairs"]
        if total > head:
            break
        limit = 1 << r["power"]
    return limit
