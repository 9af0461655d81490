"""URL filter: rules first; what they leave open is judged by naive Bayes over segmented host and path words.

Names in hosts and paths are split into words by unigram Viterbi over a lexicon: the whole words of an existing public
tokenizer's vocabulary (a fixed file), weighed by their rank and by how often they stand alone in all urls. Multinomial
naive Bayes then scores the words; it learns from the urls that the rules decide, all of them, with add-one smoothing.

Word counts per class can grow with the table, so only words above a share of all counts (at most FREQUENT of them) are
broadcast, and the others are joined; no join key is held by more than 1/FREQUENT of the words.

Null urls and urls without '://' have empty host and path, match no rule, and get the verdict of the class prior (allow on
a tie, or when no url is decided by rule). A very long url is judged whole; its work is linear in its length. Columns besides
page_id and url are not read. Repeated rows give a row each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FREQUENT = 10_000
LONGEST = 24
_PART = re.compile(r"[^\W\d_]+|\d+")


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def lexicon(vocabulary: str) -> dict[str, float]:
    """Whole words of the tokenizer's vocabulary and their pseudo-counts by rank."""
    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = (w[:-4] for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>"))
    kept = [w for w in words if w.isascii() and w.isalpha() and (len(w) > 2 or w in ("a", "i", "of", "to", "in", "on", "at", "by", "my", "we", "go", "it", "is", "or", "an", "up", "us", "me", "no"))]
    return {w: 1e5 / (rank + 10) for rank, w in enumerate(kept)}


def viterbi(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a name; runs of letters outside the lexicon cost `unknown` a letter plus once, and stay together."""
    n = len(name)
    best, back = [0.0] + [math.inf] * n, [(0, False)] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            c = cost.get(name[start:end])
            known = c is not None
            c = best[start] + (c if known else unknown * (1 + (end - start)))
            if c < best[end]:
                best[end], back[end] = c, (start, known)
        if end > LONGEST and best[end - 1] + unknown * 2 < best[end]:
            best[end], back[end] = best[end - 1] + unknown * 2, (end - 1, False)
    out, end = [], n
    while end:
        start, _ = back[end]
        out.append(name[start:end])
        end = start
    return out[::-1]


def tokens(host: str, path: str, split) -> list[str]:
    out = []
    for kind, text in (("h", host), ("p", path)):
        for part in _PART.findall(text.lower()):
            out += [f"{kind}:#{min(len(part), 9)}"] if part.isdigit() else [f"{kind}:{w}" for w in split(part)]
    return out


def url_tokens(urls: DataFrame, vocabulary: str) -> DataFrame:
    """urls: host, path and more. Adds tokens (array): names split by the unigram model."""
    prior = lexicon(vocabulary)
    names = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws("/", "host", "path")), F.lit(r"([\p{L}]+)"), 1)))
    seen = urls.select(names.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    known = urls.sparkSession.createDataFrame([(w,) for w in prior], "w string")
    counts = {r.w: r.n for r in seen.join(F.broadcast(known), "w", "left_semi").collect()}  # as many as the lexicon at most
    total = sum(prior.values()) + sum(counts.values())
    cost = {w: -math.log((c + counts.get(w, 0)) / total) for w, c in prior.items()}
    sent = urls.sparkSession.sparkContext.broadcast((cost, math.log(total) / 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(100_000)
        def split(name: str) -> tuple[str, ...]:
            return tuple(viterbi(name, *sent.value))

        for batch in batches:
            at = batch.schema.get_field_index
            found = [tokens(h, p, split) for h, p in zip(batch.column(at("host")).to_pylist(), batch.column(at("path")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInArrow(run, f"{fields}, tokens array<string>")


def judge(pages: DataFrame, vocabulary: str, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, url, host, path, tokens, rule, verdict and score (log odds of block; null where a rule decides)."""
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    ruled = urls.withColumn("__best", rule_of(F.col("host"), F.col("path"), rules)).select("*", "__best.rule", "__best.verdict").drop("__best")
    ruled = stage(url_tokens(ruled, vocabulary).withColumn("row", F.monotonically_increasing_id()), "urls")
    is_block = (F.col("verdict") == "block").cast("long")
    pages_by_class = ruled.where("verdict is not null").agg(F.sum(is_block), F.count("*")).first()
    blocked, decided = (pages_by_class[0] or 0), pages_by_class[1]
    prior = math.log((blocked + 1) / (decided - blocked + 1))
    counts = ruled.select(F.explode("tokens").alias("token"), "verdict").groupBy("token").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("a")
    )
    counts = stage(counts, "token-counts")
    n, b, a, kinds = counts.agg(F.sum("n"), F.sum("b"), F.sum("a"), F.count("*")).first()
    odds = F.log((F.col("b") + 1) / F.lit(float((b or 0) + kinds + 1))) - F.log((F.col("a") + 1) / F.lit(float((a or 0) + kinds + 1)))
    weighed = counts.select("token", "n", odds.alias("odds"))
    cut = (n or 0) / FREQUENT
    often = F.broadcast(weighed.where(F.col("n") > cut).select("token", F.col("odds").alias("often")))  # fewer than FREQUENT rows
    exploded = ruled.where("verdict is null").select("row", F.explode("tokens").alias("token")).join(often, "token", "left")
    by_often = exploded.where("often is not null").groupBy("row").agg(F.sum("often").alias("odds"))
    by_rest = exploded.where("often is null").join(weighed.where(F.col("n") <= cut).select("token", "odds"), "token").groupBy("row").agg(F.sum("odds").alias("odds"))
    summed = by_often.unionByName(by_rest).groupBy("row").agg(F.sum("odds").alias("odds"))
    scored = ruled.join(summed, "row", "left").withColumn("score", F.when(F.col("verdict").isNull(), F.coalesce("odds", F.lit(0.0)) + F.lit(prior)))
    verdict = F.coalesce("verdict", F.when(F.round("score", 9) > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "url", "host", "path", "tokens", "rule", verdict.alias("verdict"), "score")
