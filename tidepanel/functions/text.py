"""Codes, names, numbers and dates in texts: Column to Column, null where a text does not hold what is sought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code(x: Column, width: int = 6) -> Column:
    """Upper-cased, trimmed, with leading zeros."""
    text = F.upper(F.trim(x.cast("string")))
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def number(x: Column) -> Column:
    """A number with commas; in parentheses it is negative; a dash or anything else is none."""
    text = F.regexp_replace(F.trim(x), ",", "")
    inner = F.regexp_extract(text, r"^\((.*)\)$", 1)
    return F.when(text.rlike(r"^\(.*\)$"), F.lit(0.0) - inner.try_cast("double")).otherwise(text.try_cast("double"))


def reasons(x: Column, rules: dict[str, str]) -> Column:
    """The names of the patterns that the text (in any case) holds, in the rules' order, joined by |; none: an empty text."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.lower(x).rlike(p), F.lit(n)) for n, p in rules.items()])), "|")


def reason_counts(df: DataFrame, column: str) -> DataFrame:
    """reason, n: of the parts of texts joined by |."""
    return df.select(F.explode(F.split(F.col(column), r"\|")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def isin_code(x: Column) -> Column:
    """The six-character code inside an ISIN: two letters, a digit or letter, the code, three more."""
    found = F.regexp_extract(F.upper(F.trim(x)), r"^[A-Z]{2}[0-9A-Z]([0-9A-Z]{6})[0-9A-Z]{2}[0-9]$", 1)
    return F.when(found != "", found)


def digits_date(x: Column) -> Column:
    """A date from the first eight digits of a text, whatever parts them."""
    digits = F.regexp_replace(x, r"[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")).cast("date"))


def snake(x: Column) -> Column:
    """Lower case, percent signs in brackets as pct, all else that is no letter or digit as one underscore."""
    text = F.regexp_replace(F.lower(x), r"\[%\]", " pct")
    return F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def family(x: Column, names: dict[str, tuple[str, ...]], otherwise: str = "other") -> Column:
    """The first family of which a token (parted by anything but letters and digits) is in the text."""
    tokens = F.split(F.lower(x), r"[^a-z0-9]+")
    out = F.lit(otherwise)
    for name, words in reversed(names.items()):
        out = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])), F.lit(name)).otherwise(out)
    return out


def category(x: Column, codes: dict[str, int]) -> Column:
    """The code of a label; an unknown one has none."""
    return F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])[x]


def display_time(ts: Column) -> Column:
    """Nine hours ahead."""
    return ts + F.expr("INTERVAL 9 HOURS")


def iso_week(ts: Column) -> Column:
    """Year and week by ISO: the week's Thursday names the year."""
    thursday = F.date_add(F.date_trunc("week", ts).cast("date"), 3)
    return F.concat(F.year(thursday).cast("string"), F.lit("-"), F.weekofyear(ts).cast("string"))


def counts_json(df: DataFrame, by: str, key: str) -> DataFrame:
    """by, counts: a JSON map of how often each key stands, in the keys' order."""
    n = df.groupBy(by, F.col(key).cast("string").alias("key")).agg(F.count("*").alias("value"))
    return n.groupBy(by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("counts"))
