"""Packing: ids against the library, sequences against a plain packing piece by piece and against lower bounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidepanel.llm import packing
from tidepanel.llm.queries import vocabulary

from test_operators import docs, empty  # noqa: F401

FILE = vocabulary("word_bpe_49k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "tok"):
        plain_ids.tok = Tokenizer.from_file(FILE)
    return [*plain_ids.tok.encode(text or "", add_special_tokens=False).ids, 0]


def plain_bins(lengths, capacity):
    """Piece by piece: the longest with the longest that fits, then best fit; how many sequences."""
    large, gaps = sorted((n for n in lengths if 3 * n > capacity), reverse=True), []
    while large:
        n = large.pop(0)
        mate = next((k for k, m in enumerate(large) if n + m <= capacity), None)
        gaps.append(capacity - n - (large.pop(mate) if mate is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps[gaps.index(min(fits))] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def best_pairs(lengths, capacity):
    """The most pairs that fit, by trying all."""
    if len(lengths) < 2:
        return 0
    rest = lengths[1:]
    return max(best_pairs(rest, capacity), *[1 + best_pairs(rest[:k] + rest[k + 1 :], capacity) for k, m in enumerate(rest) if lengths[0] + m <= capacity] or [0])


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_plain_packing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 4))]) for _ in range(rng.randint(0, 200))]
    hist = defaultdict(int)
    for n in lengths:
        hist[n] += 1
    kinds = packing.kinds_of_sequence(dict(hist), capacity)
    assert all(sum(n * c for n, c in kind) <= capacity and count > 0 for kind, count in kinds)
    assert sum(count for _, count in kinds) == plain_bins(lengths, capacity)
    back = defaultdict(int)
    for kind, count in kinds:
        for n, c in kind:
            back[n] += c * count
    assert back == hist


def test_matching_makes_as_many_pairs_as_can_be():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(4, 10) for _ in range(rng.randint(0, 8))]
        hist = defaultdict(int)
        for n in lengths:
            hist[n] += 1
        kinds = packing.matched(dict(hist), 10)
        assert sum(c for k, c in kinds if sum(x for _, x in k) == 2) == best_pairs(lengths, 10)


def test_plan_is_bounded_by_capacity():
    rng = np.random.default_rng(0)
    small = packing.plan_rows(packing.kinds_of_sequence({n: int(rng.integers(1, 50)) for n in range(1, 2049)}))
    huge = packing.plan_rows(packing.kinds_of_sequence({n: int(rng.integers(10**9, 10**11)) for n in range(1, 2049)}))
    assert len(small) < 50_000 and len(huge) < 50_000


def check(rows, texts, capacity):
    ids, bins, pieces = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)))
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts:
        ids[doc].append(plain_ids(text))
    for doc, all_ids in ids.items():
        want = [(k, s, len(x[s : s + capacity]), zlib.crc32(np.array(x[s : s + capacity], "<u4").tobytes()), np.array(x[s : s + capacity], "<u4").tobytes()) for x in all_ids for k, s in enumerate(range(0, len(x), capacity))]
        assert sorted(pieces[doc]) == sorted(want)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(n for held in bins.values() for _, n in held)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack_holds_all_pieces(spark, docs, capacity):  # noqa: F811
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = packing.pack(docs, FILE, capacity=capacity, with_ids=True).collect()
    n, total = check(rows, texts, capacity)
    assert n == plain_bins([r.length for r in rows], capacity) and n <= 1.02 * total / capacity + 2


def test_hot_length_and_empty(spark, empty):  # noqa: F811
    assert packing.pack(empty, FILE).collect() == []
    texts = [(k, None if k % 2 else "the same words") for k in range(3000)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), FILE, with_ids=True).collect()
    n, total = check(rows, texts, 2048)
    assert n == -(-total // 2048)


def test_pairs_of_unequal_lengths():
    kinds = packing.kinds_of_sequence({6: 3, 4: 2, 5: 1, 1: 2}, 10)
    assert sum(c for _, c in kinds) == 4
