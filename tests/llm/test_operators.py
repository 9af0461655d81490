"""The numbered operators against brute-force versions, on fixtures with null, empty, long, tied and repeated rows."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate as dc
from tidepanel.llm import html_tree, huffman_ids, lattice_lm, mixing, mpeg_media, quality_fm, recompress, simhash, url_filter
from tidepanel.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, word string, size long, score double, fp long, key string, n long, part long, bucket long, chunk long"
EXTRA = (7, "w", 5, 0.5, 3, "k", 9, 1, 2, 3)


def made_texts() -> list[tuple]:
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, out = text(60), []
    for k in range(60):
        body = text(rng.randint(1, 120))
        if k % 7 == 0:
            body += "\n" + passage + " " + text(5)
        out.append((k, body, "en", f"s{k % 4}" if k % 9 else None, len(body)))
    base = text(200)
    for k in range(60, 70):  # near copies
        w = base.split()
        w[k % len(w)] = "changed"
        out.append((k, " ".join(w), None, "s0", None))
    out += [(70, None, None, None, None), (71, "", "en", "s1", 0), (72, " \t\n ", "en", "s1", 4), (73, "one", "en", "s1", 3), (74, "Two WORDS", "en", "s2", 9)]
    out += [(75, base, "en", "s0", 1), (76, base, "en", "s0", 1), (77, "la " * 500, "en", "s3", 1), (78, "x y " * 300, "en", "s3", 1), (None, text(30), "en", "s2", 5), (80, text(20_000), "en", "s2", 5)]
    out += [out[3], out[3], (81, "word\x0bsplit\x0chere\u00a0not\u2003there \x1cfs", "en", "s1", 3)]
    return [(*r, *EXTRA) for r in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(made_texts(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def lower(t):
    return (t or "").encode().lower()


def labels(spark, docs):
    return spark.createDataFrame([(r.doc_id, int(i % 3 > 0), 0, 1.0) for i, r in enumerate(docs.select("doc_id").collect())] + [(5, None, 0, 1.0), (None, 1, 0, 1.0)], "doc_id long, quality int, toxic int, score double")


def test_fm_identity_equals_pairs():
    rng = np.random.default_rng(0)
    s, x = np.array([3, 9, 70, 5]), rng.normal(size=4)
    w, v = rng.normal(size=quality_fm.SLOTS), rng.normal(size=(quality_fm.SLOTS, 4))
    pairs = sum(v[s[i]] @ v[s[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert quality_fm.fm_score(s, x, np.array([0]), 0.3, w, v)[0] == pytest.approx(0.3 + w[s] @ x + pairs)


def test_quality_scores_every_row(spark, docs, empty):
    model = quality_fm.train(docs, labels(spark, docs))
    got = quality_fm.score_documents(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_fm.score_documents(empty, model).count() == 0
    none = quality_fm.train(docs, labels(spark, docs).where("false"))
    assert {r.score for r in quality_fm.score_documents(docs, none).collect()} == {0.5}


def test_quality_learns_and_keeps_held_out_labels_apart(spark):
    rng = random.Random(1)
    rows = [(k, " ".join((rng.choice(["bad$$$", "worse***"]) if k % 4 == 0 and rng.random() < 0.3 else "w%d" % rng.randint(0, 500)) for _ in range(60))) for k in range(400)]
    d, marks = spark.createDataFrame(rows, "doc_id long, text string"), [(k, int(k % 4 > 0)) for k in range(400)]
    true = spark.createDataFrame(marks, "doc_id long, quality int")
    turned = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in marks], "doc_id long, quality int")
    a, b = quality_fm.train(d, true), quality_fm.train(d, turned)
    assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()
    got = {r.doc_id: r.score for r in quality_fm.score_documents(d, a).collect()}
    held = [(got[k], y) for k, y in marks if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95


def lattice_brute(lattice, text):
    """The marginal as a plain sum over segmentations."""
    if not text:
        return 1.0
    total = sum(lattice_brute(lattice, text[n:]) * math.exp(lattice.scores[lattice.known[text[:n]]]) for n in range(1, len(text) + 1) if text[:n] in lattice.known)
    return total if text[0] in lattice.known else total + lattice_brute(lattice, text[1:]) * math.exp(lattice._byte_score(text[0]))


def test_lattice_sums_all_segmentations(monkeypatch):
    rng = np.random.default_rng(4)
    scores = rng.normal(-9, 2, 32_000)
    lattice = lattice_lm.Lattice(vocabulary("piece_bpe_32k.model"), scores)
    words = ["the", "cat", "stone", "a", "", "x\u2603y", "caté", "ones"]
    want = [math.log(lattice_brute(lattice, "▁" + w)) for w in words]
    counts, alone = np.zeros(32_000), np.zeros(32_000)
    assert lattice(words).tolist() == pytest.approx(want) and lattice(words, counts).tolist() == pytest.approx(want)
    monkeypatch.setattr(lattice_lm, "BATCH_CHARS", 0)  # each word alone
    assert lattice(words, alone).tolist() == pytest.approx(want) and alone == pytest.approx(counts)
    # a piece's expected number is the slope of the sum of the logs in its score
    for i in (lattice.known["the"], lattice.known["▁"], lattice.known["s"], lattice.bytes[0xE2]):
        more = scores.copy()
        more[i] += 1e-5
        raised = lattice_lm.Lattice(vocabulary("piece_bpe_32k.model"), more)(words).sum()
        assert (raised - sum(want)) / 1e-5 == pytest.approx(counts[i], abs=1e-3)
    assert lattice(["\U0001f9ff" * 400])[0] > -math.inf and lattice(["a" * 100_000])[0] > -math.inf


def test_em_rounds_raise_the_likelihood(spark):
    words = ["stone", "stones", "one", "ones", "tone", "tones", "nest", "nests"]
    frame, means = spark.createDataFrame([(w,) for w in words], "word string"), []
    for rounds in range(4):
        means.append(lattice_lm.Lattice(vocabulary("piece_bpe_32k.model"), lattice_lm.piece_scores(frame, vocabulary("piece_bpe_32k.model"), rounds))(words).mean())
    assert means == sorted(means)


def test_lm_scores_equal_a_plain_sum(spark, docs):
    """Each document's probability from plain counts: a sum over kinds of products of the words' lattice sums."""
    file = vocabulary("piece_bpe_32k.model")
    got = {(r.doc_id, r.n_tokens): r.score for r in lattice_lm.score_documents(docs, file, frequent=20).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train, ends = {}, Counter()
    for r in rows:
        if not held(r.doc_id):
            train.setdefault(r.lang, Counter()).update(lower(r.text).split())
            ends[r.lang] += 1
    every = sum(train.values(), Counter())
    n, d = sum(every.values()), lattice_lm.DISCOUNT
    frame = spark.createDataFrame([(w.decode(),) for w in every], "word string")
    lattice = lattice_lm.Lattice(file, lattice_lm.piece_scores(frame, file))

    def p(w, kind):
        own = train[kind]
        size = sum(own.values()) + ends[kind]
        everywhere = max(every[w] - d, 0) / n + d * len(every) / n * math.exp(lattice([w.decode()])[0])
        return max(own[w] - d, 0) / size + d * len(own) / size * everywhere

    for r in rows:
        w = lower(r.text).split()
        if len(w) < 130:
            logs = [math.log(ends[k] / sum(ends.values())) + math.log(ends[k] / (sum(train[k].values()) + ends[k])) + sum(math.log(p(x, k)) for x in w) for k in train]
            top = max(logs)
            assert got[r.doc_id, len(w) + 1] == pytest.approx((top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(10), rel=1e-6)
    # words share all that ends leave: those seen, and the pieces' part of those not seen
    for kind in train:
        size = sum(train[kind].values()) + ends[kind]
        seen = sum(p(w, kind) for w in every)
        rest = d * len(train[kind]) / size * d * len(every) / n * (1 - sum(math.exp(x) for x in lattice([w.decode() for w in every])))
        assert seen + rest + ends[kind] / size == pytest.approx(1)


def test_lm_base_counts(spark, docs, empty):
    got = lattice_lm.score_documents(docs, vocabulary("piece_bpe_32k.model"), frequent=50).collect()
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train, ends = Counter(), 0
    for r in rows:
        if not held(r.doc_id):
            train.update(lower(r.text).split())
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1

    def want(r):
        c = Counter(lower(r.text).split())
        base = sum(k * math.log10((train[w] + 1) / (n + v + 1)) for w, k in c.items()) + math.log10((ends + 1) / (n + v + 1))
        return (str(r.doc_id), held(r.doc_id), sum(c.values()) + 1, sum(k for w, k in c.items() if w in train) + 1, n, round(base, 5))

    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(map(want, rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice_lm.score_documents(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def brute_components(fps: dict, ids: list):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_equals_brute_force(docs, empty):
    got = simhash.near_duplicates(docs, 3).select("doc_id", simhash.as_hex(F.col("fp")).alias("h"), "component_id").collect()
    rows = docs.select("doc_id", "text").collect()

    def bits(text):
        w = lower(text).split()
        grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [bits(r.text) for r in rows]
    want = [(str(r.doc_id), f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r.doc_id for r in rows]), strict=True)]
    assert sorted((str(r.doc_id), r.h, r.component_id) for r in got) == sorted(want)
    assert simhash.near_duplicates(empty, 3).count() == 0


def test_hot_key_blocks_join_the_same_sets(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(300):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    ids = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in ids]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.fingerprint_links(frame, block=16).collect():
        assert bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 3
        parent[root(r.a)] = root(r.b)
    got = Counter(root(x) for x in signed)
    want = Counter(brute_components(ids, list(range(len(ids)))))
    assert sorted(got.values()) == sorted(want.values())


def test_dedup_keeps_one_of_each_group(docs):
    kept = [r.doc_id for r in simhash.deduplicate(docs).collect()]
    groups = simhash.near_duplicates(docs, 5).select("component_id").distinct().count()
    assert len(kept) == groups and 3 in kept and simhash.deduplicate(docs).columns == docs.columns


def test_mixing_water_fill(docs, empty):
    rows = docs.select("doc_id", "source", "text").collect()
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").encode().split())
    order = sorted((k for k in size if k is not None)) + ([None] if None in size else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    goal, clamped = 1.5 * sum(size.values()), set()
    while True:
        level = (goal - sum(2 * size[k] for k in clamped)) / sum(weight[k] for k in order if k not in clamped)
        new = {k for k in order if k not in clamped and level * weight[k] > 2 * size[k]}
        if not new:
            break
        clamped |= new
    target = {k: 2 * size[k] if k in clamped else level * weight[k] for k in order}
    got = mixing.mix_plan(docs.select("*", F.col("source").alias("src")), keep=("src",)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.src]) and r.source_size == size[r.src] and 0 <= r.taken <= 2 * r.size
        taken[r.src] += r.taken
    assert all(abs(taken[k] - target[k]) <= 1 for k in order)
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.word_count(F.coalesce("text", F.lit(""))))).first()[0] == sum(taken.values())
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_the_pipeline_mixes_whole_texts(spark):
    import corpus_pipeline as cp

    texts = {k: "\n".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate((1000, 3, 40, 500, 7, 90, 11, 2000))}
    docs = spark.createDataFrame([(k, f"s{k % 3}", t) for k, t in texts.items()], "doc_id long, source string, text string")
    got = Counter(r.doc_id for r in cp.mix_sources(spark, docs, "").collect() if r.text == texts[r.doc_id])
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    assert any(0 < r.part < r["size"] for r in plan.values())
    assert got == Counter({k: n for k, r in plan.items() if (n := r.whole + (r.part > 0 and 2 * r.part >= r["size"]))})
    assert cp.mix_sources(spark, docs, "").count() == sum(got.values())


def test_huffman_codes():
    rng = random.Random(2)
    counts = {i: int(2 ** (i % 30)) + 1 for i in range(200)}
    for most in (8, 12, 20):
        lengths = huffman_ids.code_lengths(counts, most)
        assert max(lengths.values()) <= most and sum(2.0**-n for n in lengths.values()) <= 1
    plain, held = huffman_ids.code_lengths(counts, 40), huffman_ids.code_lengths(counts, 31)
    assert sum(counts[i] * n for i, n in held.items()) >= sum(counts[i] * n for i, n in plain.items())
    codes, bits = huffman_ids.canonical(huffman_ids.code_lengths(counts, 12))
    for n in (0, 1, 255, 256, 257, 5000):
        ids = np.array([rng.randrange(200) for _ in range(n)], np.int64)
        data, offsets = huffman_ids.pack(ids, codes, bits)
        assert (huffman_ids.unpack(data, offsets, n, huffman_ids.decode_table(codes, bits)) == ids).all()
    one = huffman_ids.canonical(huffman_ids.code_lengths({7: 3}))
    assert (huffman_ids.unpack(*huffman_ids.pack(np.array([7, 7, 7]), *one), 3, huffman_ids.decode_table(*one)) == 7).all()


def test_ids_round_trip(docs, empty, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    files = huffman_ids.write_ids(docs, vocabulary("word_bpe_49k.json"))
    got = sorted(huffman_ids.read_ids(*files).collect(), key=lambda r: r.start)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, start, len(ids)) and np.frombuffer(bytes(g.ids), "<u4").tolist() == ids
        start += len(ids)
    assert huffman_ids.id_digests(*huffman_ids.write_ids(empty, vocabulary("word_bpe_49k.json"))).count() == 0


URLS = ["http://a.net/x", "http://net", "https://www.example.net/en/5?q=1", "https://example.com/de/1#t", "https://x.org/fr/2", "https://cheap-pills.org/en/1", "no scheme", None, "", "HTTP://UP.Example.NET/EN/", "http://h?x://y/z", "ftp://u@h:1/p?#", "http://ünï.net/", "http://a.net/x"]


def test_url_rules_and_verdicts(spark, tmp_path):
    spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, row int").write.parquet(str(tmp_path / "p"))
    got = {r.page_id: r for r in url_filter.judge(spark.read.parquet(str(tmp_path / "p")), vocabulary("word_bpe_49k.json")).collect()}
    assert len(got) == len(URLS) and all(r.verdict in ("allow", "block") for r in got.values())
    for i, u in enumerate(URLS):
        rest = (u or "").partition("://")[2]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))])
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[0]), u
        assert best[1] in (None, got[i].verdict)
    none = spark.read.parquet(str(tmp_path / "p")).where("false")
    assert url_filter.judge(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_viterbi_splits_names():
    prior = url_filter.lexicon(vocabulary("word_bpe_49k.json"))
    total = sum(prior.values())
    cost = {w: -math.log(c / total) for w, c in prior.items()}
    assert url_filter.viterbi("cheappills", cost, math.log(total) / 2) == ["cheap", "pills"]
    assert "".join(url_filter.viterbi("zzqx" * 40, cost, math.log(total) / 2)) == "zzqx" * 40


def test_naive_bayes_scores(spark, tmp_path):
    urls = ["http://pills.net/x"] * 3 + ["http://garden.org/fr/a"] * 3 + ["http://pills.com/x", "http://garden.com/fr/a"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(str(tmp_path / "p"))
    got = {r.page_id: r for r in url_filter.judge(spark.read.parquet(str(tmp_path / "p")), vocabulary("word_bpe_49k.json")).collect()}
    assert got[6].verdict == "block" and got[7].verdict == "allow"
    counts = {True: Counter(), False: Counter()}
    for i in range(6):
        counts[i < 3].update(got[i].tokens)
    kinds = len({t for r in got.values() for t in r.tokens})
    odds = sum(math.log((counts[True][t] + 1) / (sum(counts[True].values()) + kinds + 1)) - math.log((counts[False][t] + 1) / (sum(counts[False].values()) + kinds + 1)) for t in got[6].tokens)
    assert got[6].score == pytest.approx(odds)


def test_recompression_equals_brute_force(docs, empty):
    got = recompress.remove_repeats(docs).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    seen, want = set(), []
    for r in rows:
        w = (r.text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((str(r.doc_id), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert recompress.remove_repeats(empty).count() == 0
    texts = {r.doc_id: r.text for r in recompress.remove_repeats(docs.where("doc_id < 60"), with_text=True).collect()}
    assert len(texts) == 60 and max(map(len, texts.values())) > 100


def test_recompression_over_many_chunks(docs):
    whole = sorted(map(tuple, recompress.remove_repeats(docs).collect()), key=str)
    one = docs.repartition(40)  # a chunk for each part
    assert sorted(map(tuple, recompress.remove_repeats(one).where("doc_id not in (3, 75, 76)").collect()), key=str) == [x for x in whole if x[0] not in (3, 75, 76, None)]


def test_equal_windows_have_equal_anchors():
    """Both rounds' names given as Spark gives them: a number to each distinct run or pair that stands twice or more."""
    rng = random.Random(9)
    for _ in range(30):
        same = [rng.randint(0, 3) for _ in range(20)]
        sides = [[rng.randint(0, 3) for _ in range(rng.randint(0, 15))] for _ in range(4)]
        chunks = [recompress.Chunk(np.array([1]), np.array([len(x)]), [b"%d" % i for i in range(4)], np.array(x, np.uint32)) for x in (sides[0] + same + sides[1], sides[2] + same + sides[3])]
        replies: list[list] = [[], []]
        for turn in range(recompress.ROUNDS):
            asked, total = [], Counter()
            for c, known in zip(chunks, replies, strict=True):
                p = c.parse(20, known)
                asked.append(list(zip(p.left.tolist(), p.right.tolist(), strict=True)))
                total.update({x: 1 + bool(m) for x, m in zip(asked[-1], p.many, strict=True)})
            names = {x: (turn + 1) * 1000 + k + 1 for k, x in enumerate(sorted(x for x, n in total.items() if n > 1))}
            for known, own in zip(replies, asked, strict=True):
                known.append(lambda keys, own=own, names=names: np.array([names.get(x, 0) for x in own], np.uint64))
        found = []
        for c, known, left in zip(chunks, replies, (sides[0], sides[2]), strict=True):
            p = c.parse(20, known)
            chain, place = p.anchors()
            assert p.alive[len(left)]
            found.append(None if place[len(left)] < 0 else int(chain[place[len(left)]]))
        assert found[0] == found[1]


def test_media_round_trip(docs, empty):
    got = mpeg_media.media_round_trip(docs).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        t = (r.text or "").encode()
        p = t + b" " * (-len(t) % 192 if t else 192)
        want.append((str(r.doc_id), len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert mpeg_media.media_round_trip(empty).count() == 0


def test_mpeg_reader_resynchronises():
    b = mpeg_media.build(mpeg_media.pad(b"abc" * 500), 1500)
    s = mpeg_media.parse(b)
    assert (s.bad_crc, s.skipped, s.samples, s.rate, s.table["frames"]) == (0, 0, 8 * 1152, 48000, 8)
    at = int(s.offsets[3])
    broken = mpeg_media.parse(b[:at] + b"\xff\xfbnoise" + b[at:])
    assert len(broken.offsets) == 8 and broken.skipped == 7 and broken.offsets[3] == at + 7
    flipped = bytearray(b)
    flipped[at + 10] ^= 1  # side information
    assert mpeg_media.parse(bytes(flipped)).bad_crc == 1
    assert mpeg_media.parse(b + b"TAG" + b"\0" * 125).skipped == 0
    assert len(mpeg_media.parse(b"").offsets) == len(mpeg_media.parse(b"\xff" * 50).offsets) == 0
    assert mpeg_media.crc16(b"123456789") == 0xAEE7


def test_media_texts_that_read_as_a_tag():
    for text in (b"a" * 89 + b"TAG", b"b" * 192 + b"a" * 89 + b"TAG" + b"c" * 100, b"d" * 192 + b"e" * 57 + b"APETAGEX" + b"f" * 24 + b"TAG"):
        whole = mpeg_media.pad(text)
        b = mpeg_media.build(whole, len(text))
        s = mpeg_media.parse(b)
        assert mpeg_media.payload_of(b, s) == whole and s.skipped == 0 and "TIT2" not in s.tags
        tagged = mpeg_media.parse(b + b"TAG" + b"title".ljust(125, b"\0"))
        assert tagged.tags["TIT2"] == "title" and len(tagged.offsets) == len(whole) // 192


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav><!-- no --><div class='ad'>buy</div><article><h1>Head &amp; shoulders</h1><p><b>First\n para of a long text that goes on and on.<br><p>Second   one of a long text that goes on and on.</p></article><div class='comments'><p>first!</p></div><footer>&copy; us</footer></body></html>"


def test_html_marginals_equal_enumeration():
    nodes = html_tree.parse_page("<body><div class=ad>x</div><article><p>one two</p><p>three</p></article></body>")
    model = html_tree._prior()
    got = html_tree.marginals(nodes, model)
    place = {id(x): k for k, x in enumerate(nodes)}
    total, on = 0.0, [0.0] * len(nodes)
    for code in range(1 << len(nodes)):
        y = [code >> k & 1 for k in range(len(nodes))]
        weight = model["y"][y[0]] + sum(model.get(o, (0, 0))[y[k]] for k, x in enumerate(nodes) for o in html_tree.observations(x)) + sum(model[f"e{y[place[id(x.parent)]]}"][y[k]] for k, x in enumerate(nodes) if x.parent)
        total += math.exp(weight)
        for k, v in enumerate(y):
            on[k] += math.exp(weight) * v
    assert got == pytest.approx([x / total for x in on])


def test_html_main_text(spark, tmp_path):
    pages = [PAGE] * 5 + [None, "", "plain", "<p>", "<" * 50, "</div></p><article><p>x" + "<b>y" * 300]
    spark.createDataFrame([(i, "u", p, 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text int").write.parquet(str(tmp_path / "p"))
    source = spark.read.parquet(str(tmp_path / "p"))
    got = {r.page_id: r for r in html_tree.extract(source).collect()}
    assert len(got) == len(pages) and got[0].text == "Head & shoulders\nFirst para of a long text that goes on and on.\nSecond one of a long text that goes on and on." and got[0].n_chars == len(got[0].text)
    assert got[5].text == got[6].text == got[8].text == "" and html_tree.extract(source.where("false")).count() == 0


def test_hostile_pages_take_linear_time():
    model = html_tree._prior()
    for piece in ('<a "', "<!", "<b>", "</b>", "<b><p>", "<p><b></i>", "<script>", "<div/>", "<a href='", "<!--", "<", "<a b='x' "):
        took = []
        for n in (50_000, 100_000, 200_000):
            page = piece * (n // len(piece))
            began = time.time()
            html_tree.main_text(page, model)
            took.append(time.time() - began)
        assert took[2] < 8 * took[0] + 0.5, (piece, took)
    assert html_tree.main_text("<article><p>one <b class=x href=http://x/>two</b> three<div/>four</div></article>", model) == "one two three\nfour"
    assert html_tree.main_text("<article><p>3 < 4 and <i>so</i> on", model) == "3 < 4 and so on"


def test_decontamination_equals_brute_force(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    long_ones = [r.text for r in rows if r.text and len(r.text.split()) > 40]
    items = [(1, " ".join(long_ones[0].split()[5:17]).upper()), (2, " ".join(long_ones[1].split()[:10])), (3, "one"), (4, None), (5, "..."), (6, " ".join(long_ones[2].split()[3:30])), (6, "two words"), (None, "la la"), (7, "never there at all"), (1, " ".join(long_ones[0].split()[5:17]))]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int")

    def brute(text):
        w, hit, found = dc.words(lower(text)), set(), set()
        for i, t in items:
            x = dc.words(lower(t))
            for k in range(max(1, len(x) - 9) if x and i is not None else 0):
                win = x[k : k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(i))
        return len(w), len(hit), sorted(found)

    want = sorted((str(r.doc_id), *brute(r.text)) for r in rows)
    for hot in (1000, 1):  # without and with salted keys
        got = dc.decontaminate(docs, bench, hot=hot)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got.collect()) == want
    assert dc.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0 and dc.decontaminate(empty, bench).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as cp

    folder = tmp_path / "tables"
    clashing = docs.select("*", *[F.lit(1).alias(c) for c in ("hit", "items", "n_words", "n_hit", "kept", "places", "whole", "taken", "extra", "node", "digest", "label")])
    clashing.write.parquet(str(folder / "documents.parquet"))
    labels(spark, docs).write.parquet(str(folder / "labels.parquet"))
    item = next(r.text for r in docs.select("text").collect() if r.text and len(r.text.split()) > 100)
    spark.createDataFrame([(1, " ".join(item.split()[:12]))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    now = spark.read.parquet(str(folder / "documents.parquet"))
    counts = []
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, now, str(folder)).write.parquet(str(folder / f"out{k}"))
        after = spark.read.parquet(str(folder / f"out{k}"))
        if k < 4:
            assert after.columns == now.columns
        if k == 2:
            assert after.count() <= now.count() and not any(" ".join(item.split()[:12]) in (r.text or "") for r in after.collect())
        now = after
        counts.append(now.count())
    assert counts[3] == counts[4] and cp.run(spark, str(folder)).count() == counts[4]


def test_shares_follow_the_names_for_any_number_of_buckets():
    rng = np.random.default_rng(0)
    names = np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    for buckets in (1, 7, 4096, 4_000_000):
        used, cut = recompress._shares(names, buckets)
        bounds = (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)
        every = np.searchsorted(names >> np.uint64(32), bounds)
        assert used.tolist() == np.flatnonzero(np.diff(every)).tolist() and cut.tolist() == [*every[:-1][np.diff(every) > 0].tolist(), len(names)]


def test_repeats_with_more_buckets_than_a_table_may_have(spark, docs, monkeypatch):
    want = sorted(recompress.remove_repeats(docs).collect(), key=str)
    monkeypatch.setattr(recompress, "TABLE_BYTES", 1000)
    monkeypatch.setattr(recompress, "BUCKET_WORDS", 3)
    monkeypatch.setattr(recompress, "CHUNK_WORDS", 700)
    before = {t.name for t in spark.catalog.listTables()}
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "5")
    try:
        assert sorted(recompress.remove_repeats(docs).collect(), key=str) == want
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert {t.name for t in spark.catalog.listTables()} == before


def test_pipeline_stages_of_an_empty_table(spark, empty, docs, tmp_path):
    import corpus_pipeline as cp

    base = str(tmp_path / "sf")
    labels(spark, docs).where("doc_id is not null and quality is not null").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([("a", "one two three four five six seven eight nine ten")], "item_id string, text string").write.parquet(f"{base}/benchmark.parquet")
    now = empty
    for k, (_, f) in enumerate(cp.STAGES):
        path = str(tmp_path / f"stage{k}")
        f(spark, now, base).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.count() == 0
