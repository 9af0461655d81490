"""Ranked search against a plain search of all pairs."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tidepanel.llm import dual_tree, queries

from test_operators import docs, empty, made_texts  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def plain(rows, items, k):
    held = [(d, Counter(t)) for d, text in rows for t in [terms(text)] if t]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, math.inf if doc is None else doc))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def some_items(rows, n):
    rng = random.Random(2)
    texts = [t for _, t in rows if t and len(t) < 5000]
    items = [(f"i{k}", " ".join(rng.choice(texts).split()[: rng.randint(1, 30)])) for k in range(n)]
    return items + [("none", ""), ("null", None), ("odd", "?! zzzzzzz"), (None, "two words"), items[0], ("caps", "TWO Words two"), ("i1", texts[3])]


@pytest.mark.parametrize(("block", "slices", "group", "leaf"), [(1 << 22, 4, 1024, 32), (400, 1, 7, 3)])
def test_search_equals_all_pairs(spark, docs, monkeypatch, block, slices, group, leaf):  # noqa: F811
    for name, value in (("BLOCK_BYTES", block), ("SLICE_BLOCKS", slices), ("GROUP_ITEMS", group), ("LEAF_DOCS", leaf), ("LEAF_ITEMS", leaf), ("FAN", 2)):
        monkeypatch.setattr(dual_tree, name, value)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = some_items(rows, 20)
    for k in (3, 50):
        got = dual_tree.rank(docs, spark.createDataFrame(items, "item_id string, text string"), k=k).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(rows, items, k)


def test_empty_tables(spark, docs, empty):  # noqa: F811
    items = spark.createDataFrame([("a", "two words")], "item_id string, text string")
    assert dual_tree.rank(empty, items).collect() == []
    assert dual_tree.rank(docs, items.where("false")).collect() == []
    assert dual_tree.rank(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(0)
    topic = rng.integers(0, 20, 2000)
    cols = np.sort(np.stack([topic * 10 + rng.integers(0, 10, 2000), 200 + rng.integers(0, 30, 2000)], 1), 1).ravel()
    values, at = rng.integers(1, 1_000_000, 4000), np.arange(0, 4001, 2)
    items = dual_tree.Items([np.array([t * 10, t * 10 + 1, 200 + t]) for t in range(20)], [np.array([9000, 8000, 50])] * 20, 230)
    heavy = np.full(230, 50)
    heavy[:200] = 9000
    found = dual_tree.Docs(np.arange(2000), at, cols, values, heavy)
    scored = dual_tree.search(items, found, 5, np.float64)
    assert scored < 1500  # of 2 leaves of items by 2,000 documents; each leaf is scored once at most
    full = np.zeros((2000, 230), np.int64)
    np.add.at(full, (np.repeat(np.arange(2000), 2), cols), values)
    for t in range(20):
        s = full[:, [t * 10, t * 10 + 1, 200 + t]] @ np.array([9000, 8000, 50])
        want = [(int(-a), int(d)) for a, d in sorted(zip(-s, range(2000)))[:5] if a < 0]
        assert list(zip(items.best[t][0].tolist(), items.best[t][1].tolist())) == want


def test_integer_sums_beyond_doubles():
    items = dual_tree.Items([np.array([0, 1])], [np.array([1 << 50, 1])], 2)
    found = dual_tree.Docs(np.arange(2), np.array([0, 2, 4]), np.array([0, 1, 0, 1]), np.array([5, 2, 5, 1]), np.array([1, 1]))
    dual_tree.search(items, found, 2, np.int64)
    assert items.best[0][0].tolist() == [(5 << 50) + 2, (5 << 50) + 1]


def test_what_a_task_holds_at_once_is_bounded(spark, tmp_path):
    """One partition of 24 MB of text: its rows and row groups stay small."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(4000)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    blocks = dual_tree.write_blocks(spark.read.parquet(path))
    groups = [meta.row_group(k) for f in blocks.inputFiles() for meta in [pq.ParquetFile(f.removeprefix("file://")).metadata] for k in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == blocks.count()
    assert max(g.total_byte_size for g in groups) < 2 * dual_tree.ROW_GROUP
    assert blocks.selectExpr("max(length(at) + length(places) + length(times))").first()[0] < 1 << 20
    assert blocks.selectExpr("sum(n_docs)", "sum(n_terms)").first() == (4000, 4_000_000)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute(queries.OP13_SQL).fetchall()
    got = [tuple(r) for r in queries.op13_dual_tree_search(spark, "/root/testdata/sf0.001").collect()]
    assert got and sorted(got) == sorted(want)
