"""Packing along the curve: exact round trip against the library, no padding, neighbours together."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from vitrine.llm import queries
from vitrine.llm.curve_packing import hilbert_key, pack_along_curve, tail_lengths

PATH = queries.tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_one_step_apart(dims, bits):
    grid = np.array(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
    keys = hilbert_key(grid, bits)
    order = np.argsort(keys)
    assert (keys[order] == np.arange(len(keys))).all()
    assert (np.abs(np.diff(grid[:, order], axis=1)).sum(0) == 1).all()


def test_tail_is_powers_of_two():
    assert tail_lengths(0) == [] and tail_lengths(1300) == [1024, 256, 16, 4]


def check_packing(df, capacity, **params):
    library = Tokenizer.from_file(PATH)
    rows = [r.asDict() for r in pack_along_curve(df, PATH, capacity, with_ids=True, **params).collect()]
    want = sorted(
        (str(r["doc_id"]), tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]))
        for r in df.select("doc_id", "text").collect()
    )
    total = sum(len(ids) for _, ids in want)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[str(r["doc_id"]), r["doc_tokens"]].append((r["start"], r["length"], bytes(r["ids"])))
    lengths = []
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        lengths.append(at)
    assert sorted(lengths, reverse=True) == [capacity] * (total // capacity) + tail_lengths(total % capacity)
    # Every id is in one piece: each document's pieces, in order, are its ids (ids that share a name hold each its own).
    covered = defaultdict(int)
    for (doc, tokens), spans in pieces.items():
        covered[doc, tokens] = sum(n for _, n, _ in spans)
    need = defaultdict(int)
    for doc, ids in want:
        need[doc, len(ids)] += len(ids)
    assert covered == need
    for doc, ids in want:
        if sum(d == doc for d, _ in want) == 1:
            data = b"".join(p for _, _, p in sorted(pieces[doc, len(ids)]))
            assert data == np.array(ids, "<u4").tobytes()
    return rows


def test_round_trip_without_padding(sf_documents, odd_documents):
    check_packing(sf_documents, 2048)
    check_packing(odd_documents, 2048)


def test_many_range_partitions_form_one_stream(sf_documents, odd_documents):
    check_packing(sf_documents.repartition(5), 64, part_tokens=3000)
    check_packing(odd_documents, 100, part_tokens=500)


def test_empty_table(no_documents):
    assert pack_along_curve(no_documents, PATH, 2048).count() == 0


def test_documents_of_one_kind_share_sequences(spark):
    left, right = "river water boat fish lake", "market price money trade bank"
    rows = [(i, f"{(left if i % 2 else right)} {i} " * 12) for i in range(400)]
    packed = pack_along_curve(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 512).collect()
    kinds = defaultdict(set)
    for r in packed:
        kinds[r["sequence_id"]].add(r["doc_id"] % 2)
    mixed = sum(len(k) == 2 for k in kinds.values())
    assert mixed <= len(kinds) * 0.3  # a random order mixes nearly all
