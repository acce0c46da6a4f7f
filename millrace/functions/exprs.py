"""Column expressions that the operators share. All stay on the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vocab import MISSING


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in phrases])


def first_match(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The code of the first rule with a phrase in the text; the rules' order counts, not the places in the text."""
    out = None
    for code, phrases in rules:
        out = F.when(contains_any(text, phrases), code) if out is None else out.when(contains_any(text, phrases), code)
    return out.otherwise(default)


def lookup(code: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """A small dimension table as an expression; a code that it lacks gives the default."""
    out = None
    for k, v in table.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(F.lit(default).cast("string"))


def hash_number(seed: int, key: Column, name: str) -> Column:
    """A reproducible whole number of 60 bits: the head of sha256(seed:key:name)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{name}")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_draw(seed: int, key: Column, name: str, total: int) -> Column:
    """A reproducible whole number from 0 to total - 1."""
    return F.pmod(hash_number(seed, key, name), F.lit(total))


def weighted(draw: Column, weights: Mapping[str, int]) -> Column:
    """The code whose stretch of the cumulative weights holds the draw."""
    out, total = None, 0
    for code, weight in weights.items():
        total += weight
        out = F.when(draw < total, code) if out is None else out.when(draw < total, code)
    return out


def stated(code: Column, allow_not_applicable: bool = False) -> Column:
    return ~code.isin([m for m in MISSING if not (allow_not_applicable and m == "not_applicable")])


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)  # most texts have none, and aren't searched


def clip(text: Column, limit: int = 80) -> Column:
    """White space runs as single spaces, at most limit characters, an ellipsis for what goes."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


#: Decimal digits of all scripts, and the ASCII digit that each stands for: by Unicode's own table.
DIGITS = "".join(chr(c) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in DIGITS)


def ascii_digits(text: Column) -> Column:
    """The text with ASCII digits for those of other scripts (full-width ones, say)."""
    return F.translate(text, DIGITS, ASCII_DIGITS)


def utc_stamp(seconds: bool = True) -> Column:
    """The query's time as ISO text in UTC, or its date for file names."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.concat(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")) if seconds else F.date_format(now, "yyyyMMdd")


def number_text(value: Column) -> Column:
    """A number of up to six digits in its shortest form: 9.0 as 9."""
    text = value.cast("string")
    return F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.char_length(text) - 2)).otherwise(text)


def replace_first(text: Column, phrase: Column | str, replacement: Column | str) -> Column:
    """The text with the phrase's first occurrence replaced; as it is without one."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    replacement = F.lit(replacement) if isinstance(replacement, str) else replacement
    return F.when(F.instr(text, phrase) > 0, F.overlay(text, replacement, F.instr(text, phrase), F.char_length(phrase))).otherwise(text)


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds columns that later expressions read instead of repeating: a one-row generator keeps the optimizer from inlining
    large expressions wherever they are used."""
    held = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.withColumn("_held", F.explode(F.array(held))).select(*[c for c in df.columns if c not in columns], *[F.col(f"_held.{k}").alias(k) for k in columns])


def packed(domains: Mapping[str, Sequence[str]]) -> Column:
    """Codes of several columns as one whole number; a code outside its domain is an error."""
    out, base = F.lit(0).cast("bigint"), 1
    for name, codes in domains.items():
        at = None
        for k, c in enumerate(codes):
            at = F.when(F.col(name) == c, F.lit(k * base).cast("bigint")) if at is None else at.when(F.col(name) == c, F.lit(k * base).cast("bigint"))
        out, base = out + at.otherwise(F.raise_error(F.concat(F.lit(f"no code of {name}: "), F.coalesce(name, F.lit("null")))).cast("bigint")), base * len(codes)
    return out


def unpacked(code: Column, domains: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """The columns that packed made one number of."""
    out, base = {}, 1
    for name, codes in domains.items():
        out[name] = F.element_at(F.array(*map(F.lit, codes)), (F.floor(code / F.lit(base)) % len(codes) + 1).cast("int"))
        base *= len(codes)
    if base >= 1 << 53:
        raise ValueError("too many codes for one number")
    return out


def content_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(text, 256))


def nearest_rank(value: str, percent: int, name: str) -> Column:
    """The nearest-rank percentile of a group's whole numbers."""
    return F.expr(f"cast(percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value}) AS bigint)").alias(name)


def length_statistics(value: str) -> list[Column]:
    """min, max, mean (three digits) and nearest-rank percentiles; all null for an empty group."""
    return [F.min(value).alias("min_length"), F.max(value).alias("max_length"), F.round(F.avg(value), 3).alias("mean_length"), *[nearest_rank(value, p, f"p{p}") for p in (50, 90, 95, 99)]]


def share(part: Column, whole: Column) -> Column:
    """A rate; null where there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def bucket_rank(df: DataFrame, bucket: Column, order: Sequence[str], name: str, within: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Numbers rows from 1 by bucket, then order, in the whole table or within groups: a bucket's first number is the count of all rows in
    buckets before it, and inside a bucket rows are numbered by a window. total: name of a column with the group's number of rows."""
    keyed = df.withColumn("_bucket", bucket)
    keys = [*within, "_bucket"]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*within)
    before = counts.select(*keys, (F.sum("_n").over(group.orderBy("_bucket")) - F.col("_n")).alias("_before"), *([F.sum("_n").over(group).alias(total)] if total else []))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return keyed.withColumn("_inside", inside).join(before, keys).withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_bucket", "_inside", "_before")


def digest_rank(df: DataFrame, digest: str, name: str = "rank", within: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Numbers rows from 1 in the order of a hex digest, in the whole table or within groups, without one task for all.

    Digests are dealt to buckets by their first four letters, so bucket counts are at most 65,536 to a group.
    """
    return bucket_rank(df, F.substring(digest, 1, 4), [digest], name, within, total)


def ordered_rank(df: DataFrame, key: str, name: str = "rank", buckets: int = 1024) -> DataFrame:
    """Numbers rows from 1 in the order of a number without repeats: buckets are cut at its approximate quantiles (the driver holds the cuts alone)."""
    found = df.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 10_000).alias("cuts")).first()["cuts"]
    cuts = F.array(*map(F.lit, sorted(set(found or ()))))
    return bucket_rank(df, F.size(F.filter(cuts, lambda c: c <= F.col(key))), [key], name)
