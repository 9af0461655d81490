"""Alignment of two tokenizers against a plain version, on fixtures and on hostile strings."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tidepanel.llm import align
from tidepanel.llm.queries import vocabulary

from test_operators import docs, empty  # noqa: F401

FILES = (vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def plain(rows):
    """doc_id -> the contract's row, link by link."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    a_tok.encode_special_tokens = True
    letters = align.byte_letters()
    held, out = defaultdict(set), []
    for n, (doc, text) in enumerate(rows):
        ids, spans = ([], []), ([], [])
        if text:
            enc = a_tok.encode(" " + text, add_special_tokens=False)
            pieces = [[bytes(letters[c] for c in t) for t in enc.tokens], []]
            for i in b_tok.encode(text):
                p = b_tok.id_to_piece(i)
                pieces[1].append(bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode())
            if b"".join(pieces[0]) == b"".join(pieces[1]) == (" " + text).encode():
                ids = (enc.ids, b_tok.encode(text))
                for side in (0, 1):
                    at = 0
                    for p in pieces[side]:
                        spans[side].append((at, at + len(p)))
                        at += len(p)
        links = [(ids[0][i], ids[1][j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]
        ends = sorted({e for _, e in spans[0]} & {f for _, f in spans[1]})
        groups, lo = [], 0
        for end in ends:
            groups.append([",".join(str(ids[side][k]) for k, (s, e) in enumerate(spans[side]) if lo < e <= end) for side in (0, 1)])
            lo = end
        for pair in set(links):
            held[pair].add(n)
        out.append((doc, len(ids[0]), len(ids[1]), len(groups), links, ";".join("|".join(g) for g in groups)))
    most = defaultdict(int)
    for (a, _), d in held.items():
        most[a] = max(most[a], len(d))
    count = {p: len(d) for p, d in held.items()}
    return [(d, na, nb, ng, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if na else "") for d, na, nb, ng, links, g in out]


def hostile():
    rng = random.Random(3)
    bits = ["a", "word", " ", "  ", "\n", "\t", " \n", " ", "▁", "<|endoftext|>", "</s>", "é", "é", "日本語", "\U0001f600", "12345", "'s", "don't", ".", "...", "\x00", " ", "\x1c", "ﬁ", "x" * 40, "ÀÉ", "\r\n", "_", "​"]
    return [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(400)]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def check(frame, rows):
    got = [tuple(r[c] for c in COLUMNS) for r in align.align(frame, *FILES).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("block", [1 << 23, 500])
def test_hostile_strings_equal_plain(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    monkeypatch.setattr(align, "STRING_WORDS", 7)
    rows = hostile()
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_fixture_equals_plain(spark, docs):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("doc_id is null or doc_id <> 80").collect()]
    check(docs.where("doc_id is null or doc_id <> 80"), rows)


def test_empty_and_long(spark, docs, empty):  # noqa: F811
    assert align.align(empty, *FILES).collect() == []
    row = align.align(docs.where("doc_id = 80"), *FILES).collect()[0]
    assert row.n_a > 20_000 and row.n_links >= row.n_a and row.n_best <= row.n_links


def test_product_equals_dense():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 3, (rng.integers(1, 9), 7)), rng.integers(0, 3, (7, rng.integers(1, 9)))
        sparse = [align.Csr(np.r_[0, np.cumsum((m > 0).sum(1))], np.nonzero(m)[1], m[np.nonzero(m)], m.shape[1]) for m in (a, b)]
        c = align.product(*sparse)
        dense = np.zeros((a.shape[0], b.shape[1]), int)
        dense[np.repeat(np.arange(a.shape[0]), np.diff(c.at)), c.cols] = c.values
        assert (dense == a @ b).all() and (align.row_terms(*sparse) >= np.diff(c.at)).all()


def test_shared_links_are_all_pairs_within_groups():
    a = align.Tokens(np.array([5, 6, 7]), np.array([2, 1, 3]), np.array([3]))
    b = align.Tokens(np.array([1, 2, 3]), np.array([1, 2, 3]), np.array([3]))
    c = align.shared_links(a, b)
    assert [(i, j) for i in range(3) for j in c.cols[c.at[i] : c.at[i + 1]].tolist()] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]
    over = align.overlaps(a, b)
    assert over.values.tolist() == [1, 1, 1, 3] and over.cols.tolist() == [0, 1, 1, 2]
