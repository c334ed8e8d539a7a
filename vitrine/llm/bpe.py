"""Exact ids and counts of public BPE tokenizers, chunk by chunk.

Neither split pattern lets a pre-token cross from one run of white space into the next word's end, so a
text is a row of independent chunks. Chunks repeat; each is encoded once per worker and
remembered. A chunk is split into pre-tokens; those proved to be one token are
looked up, only the rest is merged.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import regex

# Bytes of chunks, and of words, that a worker process remembers (each memory is emptied when it is full), and what an
# entry costs beside its text and ids.
REMEMBERED, ENTRY = 64_000_000, 200

# The split patterns of the two tokenizers.
BYTE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
# Characters whose classes (and lower case) are the same here and in the library;
# tests/llm compares them one by one. A text with any other character goes to the library.
USUAL = "\\x00-\\x1b\\x20-\\u024f\\u2010-\\u2027\\u20ac"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return table


def _weight(chunks) -> int:
    """Bytes that chunks and their ids take, about: five for each character."""
    return ENTRY * len(chunks) + 5 * sum(map(len, chunks))


class _Library:
    """The tokenizer as its library runs it, and the parts both readers need."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.unusual = regex.compile(f"[^{USUAL}]").search
        self.known: dict = {}
        self.held = 0

    def plain(self, text: str) -> bool:
        return not self.unusual(text) and not any(s in text for s in self.special)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def raw(self, token: str) -> bytes:
        return bytes(map(self.alphabet.__getitem__, token))

    def forget(self) -> None:
        """Drops what is remembered; the next text encodes its chunks anew."""
        self.known.clear()
        self.held = 0

    def remember(self, chunks: set, encode) -> None:
        """Encodes the chunks that are not known. A text's own chunks are held in any case, until the next text needs room."""
        new = chunks.difference(self.known)
        if self.held + _weight(new) > REMEMBERED:
            self.known.clear()
            self.held, new = 0, chunks
        self.known.update(zip(new, map(encode, new)))
        self.held += _weight(new)


class ByteCounter(_Library):
    """Counts as ``len(encode(text, add_special_tokens=False))`` of a byte-level BPE."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path)
        self.split = regex.compile(BYTE_SPLIT).findall
        self.chunks = re.compile(r"\s*\S+|\s+\Z").findall
        ranks = {self.raw(t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        merge = tiktoken.Encoding("own", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.merge_one = merge._core_bpe.encode_single_piece
        # The same model without the split: encodes one pre-token as it stands.
        alone = Tokenizer.from_file(path)
        alone.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        alone.encode_special_tokens = True
        self.whole, self.odd = self.prove(ranks, alone)

    def prove(self, ranks: dict[bytes, int], alone) -> tuple[frozenset[str], dict[str, int]]:
        """Vocabulary strings that are text, that the split leaves in one piece, and that encode alone as one token; and the
        costs of the others, which are in the vocabulary though no merges lead there."""
        texts = []
        for raw in ranks:
            try:
                texts.append(raw.decode())
            except UnicodeDecodeError:
                pass
        costs = {t: len(e) for t, e in zip(texts, alone.encode_batch_fast(texts, add_special_tokens=False))}
        whole = frozenset(t for t, n in costs.items() if n == 1 and self.split(t) == [t])
        return whole, {t: n for t, n in costs.items() if t not in whole}

    def _pieces(self, chunk: str) -> list[str]:
        """The split of a chunk; the commonest shapes, a word with or without one sign after it, need no pattern."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [chunk[:-1], word[-1]]
        return self.split(chunk)

    def _cost(self, chunk: str) -> int:
        total = 0
        for piece in self._pieces(chunk):
            if piece in self.whole:
                total += 1
                continue
            total += self.odd[piece] if piece in self.odd else len(self.merge_one(piece.encode()))
        return total

    def count(self, text: str) -> int:
        if not self.plain(text):
            return len(self.ids(text))
        # Words between single spaces are chunks; where spaces meet, a run belongs to the word after it.
        if "  " in text:
            chunks = self.chunks(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + w for w in rest]]
        try:
            return sum(map(self.known.__getitem__, chunks))
        except KeyError:
            self.remember(set(chunks), self._cost)
            return sum(map(self.known.__getitem__, chunks))


class WordEncoder(_Library):
    """Ids as ``encode(text, add_special_tokens=False).ids`` of a BPE with word ends,
    as little-endian unsigned 32-bit numbers."""

    END = "</w>"

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        self.split = regex.compile(WORD_SPLIT).findall
        # The merger works on bytes, so a byte that ends a word is written as another byte, one that
        # letters never use: words of letters whose last byte has such a stand-in are merged there.
        lasts = [*range(ord("a"), ord("z") + 1), *range(0x80, 0xC0)]
        unused = [*range(ord("A"), ord("Z") + 1), *range(0x00, 0x20), *range(0x21, 0x41), *range(0xF5, 0x100)]
        self.stand_in = dict(zip(lasts, unused))
        ranks = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        for token, i in vocab.items():
            ended = token.endswith(self.END) and token != self.END
            raw = self.raw(token.removesuffix(self.END) if ended else token)
            if any(b < 0x61 or 0x7B <= b < 0x80 or b >= 0xF5 for b in raw):
                continue
            if not ended:
                ranks[raw] = i
            elif raw[-1] in self.stand_in:
                ranks[raw[:-1] + bytes([self.stand_in[raw[-1]]])] = i
        self.ranks = frozenset(ranks)
        merge = tiktoken.Encoding("own", pat_str=WORD_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.merge_one = merge._core_bpe.encode_single_piece
        self.words: dict[str, bytes] = {}
        self.words_held = 0
        self.whole = self.prove(vocab)

    def prove(self, vocab: dict[str, int]) -> dict[str, bytes]:
        """Vocabulary words that encode alone as one token, and their ids."""
        words = []
        for token in vocab:
            if token.endswith(self.END) and token != self.END:
                try:
                    words.append(self.raw(token.removesuffix(self.END)).decode())
                except UnicodeDecodeError:
                    pass
        words = [w for w in words if self.split(w) == [w] and w.lower() == w]
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: array("I", e.ids).tobytes() for w, e in zip(words, found) if len(e) == 1}

    def forget(self) -> None:
        super().forget()
        self.words.clear()
        self.words_held = 0

    def _piece(self, piece: str) -> bytes:
        ids = self.whole.get(piece) or self.words.get(piece)
        if ids is None:
            if self.words_held > REMEMBERED:
                self.words.clear()
                self.words_held = 0
            ids = self.words[piece] = self._merge(piece)
            self.words_held += ENTRY + 5 * len(piece)
        return ids

    def _merge(self, piece: str) -> bytes:
        raw = piece.encode()
        last = self.stand_in.get(raw[-1])
        if last is not None and piece.isalpha():
            word = raw[:-1] + bytes((last,))
            if word not in self.ranks:
                return array("I", self.merge_one(word)).tobytes()
        return array("I", self.ids(piece)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        chunk = chunk.lower()
        if chunk.isalpha():
            return self._piece(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return self._piece(chunk[:-1]) + self._piece(chunk[-1])
        return b"".join(map(self._piece, self.split(chunk)))

    def encode(self, text: str) -> bytes:
        if not self.plain(text):
            return array("I", self.ids(text)).tobytes()
        chunks = text.split()
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            self.remember(set(chunks), self._chunk)
            return b"".join(map(self.known.__getitem__, chunks))


@cache
def byte_counter(path: str) -> ByteCounter:
    """One per worker process, so that tasks share the proof and the memory."""
    return ByteCounter(path)


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
