"""Packing: limits, exact round trip, and the identity of both vocabularies."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tradeloom.llm import packing
from tradeloom.llm.packing import Limits


def corpus() -> list[tuple]:
    chance = random.Random(3)
    texts = [" ".join(chance.choices(["alpha", "Béta", "γ", "<|endoftext|>", "12,5", "\n\n", "  "], k=chance.randrange(900))) for _ in range(90)]
    rows = [(k, text, "clash") for k, text in enumerate([*texts, None, "", "x", "x" * 60_000, "same", "same"])]
    return [*rows, rows[0], (None, "no id", "clash")]


def json_ids(text: str | None) -> list[int]:
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_json_vocabulary():
    for text in [None, "", "It's <|endoftext|> 3½ \x1c\x85 x　y\n\n  z", *(row[1] for row in corpus()[:40])]:
        assert packing.token_ids(text, None).tolist() == [*json_ids(text), 0]


def check(pieces: list, rows: list[tuple], limits: Limits) -> None:
    wanted = defaultdict(list)
    for doc_id, text, *_ in rows:
        wanted[doc_id].append(packing.token_ids(text, None))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert by_doc.keys() == wanted.keys()
    for doc_id, parts in by_doc.items():
        copies = wanted[doc_id]
        assert sum(p.length for p in parts) == sum(map(len, copies))
        times = np.zeros(max(map(len, copies)), int)
        for p in parts:
            assert p.doc_tokens in {len(c) for c in copies}
            times[p.start : p.start + p.length] += 1
            assert zlib.crc32(copies[0][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        assert (times == len(copies)).all()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        at = 0
        for p in parts:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= limits.tokens and len(parts) <= limits.segments


def test_every_token_in_one_piece_and_no_padding(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    pieces = packing.pack(docs).collect()
    check(pieces, rows, Limits())
    total = defaultdict(int)
    for p in pieces:
        total[p.sequence_id] += p.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in total.values())


def test_all_three_limits_hold(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, min(40, len(r[1] or ""))) for r in rows], "doc_id long, text string, x string, answer int")
    limits = Limits(tokens=256, segments=3, loss=60, block=16)
    pieces = packing.pack(docs, limits, "answer").collect()
    check(pieces, rows, limits)
    loss = {doc_id: min(40, len(text or ""), len(packing.token_ids(text, None))) for doc_id, text, _ in rows}
    bears = defaultdict(int)
    for p in pieces:
        bears[p.sequence_id] += max(0, p.start + p.length - max(p.start, p.doc_tokens - loss[p.doc_id]))
    assert max(bears.values()) <= 60


def test_block_is_packed_by_the_dot_product():
    items = np.array([(0, 60, 60), (0, 40, 0), (0, 40, 40), (0, 50, 50)])
    first = packing.pack_block(items, Limits(tokens=100, segments=4, loss=70, cut=False))[0]
    assert [item for item, *_ in first] == [0, 1]  # fills the tokens and stays within the loss


def test_without_cutting_whole_tails_share(spark):
    items = np.array([(0, n, n) for n in (700, 600, 400, 300, 20)])
    packed = packing.pack_block(items, Limits(cut=False))
    assert sorted(sum(part[2] for part in s) for s in packed) == sorted([1020, 1000]) and all(part[1] == 0 for s in packed for part in s)


def test_limits_must_be_positive_and_empty_table(spark):
    with pytest.raises(ValueError):
        Limits(tokens=0)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
