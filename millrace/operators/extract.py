"""Records from reports by ordered phrase rules and the measurement pattern."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import ascii_digits, computed_once, contains_any, stated, strip, unpacked


def measured(head: Column) -> Column:
    """The numbers of a text that the measurement pattern matches as a whole, in millimetres."""
    factor = F.when(head.endswith("cm"), 10.0).otherwise(1.0)
    return F.transform(F.regexp_extract_all(head, F.lit(vocab.NUMBER), F.lit(0)), lambda x: ascii_digits(x).cast("double") * factor)


def dimensions(text: Column, head: Column | None = None) -> Column:
    """Measurements in millimetres, or null: two or three numbers, centimetres times ten, none after a veto phrase. head: the pattern's first match, if it is known."""
    head = F.regexp_extract(text, vocab.DIMENSIONS, 0) if head is None else head
    return F.when((head != "") & ~contains_any(text, vocab.NO_DIMENSIONS), measured(head))


#: What a report can say of each field, and the phrases of all rules, each with a bit of its own; the isthmus has the last one.
_SAID = {f: [*dict.fromkeys([*(code for code, _ in rules), "not_mentioned", *{"location_side": ["isthmus"], "location_segment": ["not_applicable"]}.get(f, [])])] for f, rules in vocab.CASCADES.items()}
_PHRASES = [*dict.fromkeys([p for rules in vocab.CASCADES.values() for _, phrases in rules for p in phrases] + [vocab.ISTHMUS])]
_BITS = {p: 1 << k for k, p in enumerate(_PHRASES)}
_RULES = {f: [(code, sum(_BITS[p] for p in set(phrases))) for code, phrases in rules] for f, rules in vocab.CASCADES.items()}
if any(set(p) & set("，.0123456789") for p in _PHRASES):
    raise ValueError("phrases hold no commas, points and digits, as texts are cut at them")


@lru_cache(1 << 16)
def _found(clause: str) -> int:
    """The bits of the phrases in a stretch without commas and numbers."""
    return sum(bit for phrase, bit in _BITS.items() if phrase in clause)


@lru_cache(1 << 16)
def _code(found: int) -> int:
    """What the phrases say, the first rule of each field, as one number."""
    out, base = 0, 1
    for field, rules in _RULES.items():
        said = next((code for code, bits in rules if found & bits), "not_mentioned")
        if found & _BITS[vocab.ISTHMUS]:
            said = {"location_side": "isthmus", "location_segment": "not_applicable"}.get(field, said)
        out, base = out + _SAID[field].index(said) * base, base * len(_SAID[field])
    return out


def _said(text: str | None) -> int:
    found = 0
    for clause in re.split("[，.0-9]+", text or ""):
        found |= _found(clause)
    return _code(found)


def record_code(text: Column) -> Column:
    """What a text says of all coded fields, as one number for unpacked. A vectorised function: texts share most of their clauses, and a task looks each one through once."""

    @F.pandas_udf("bigint")
    def codes(column: pd.Series) -> pd.Series:
        return pd.Series([_said(t) for t in column], dtype="int64")

    return codes(text)


def extract(df: DataFrame, text: str, prefix: str = "parsed_") -> DataFrame:
    """Adds the record that a report states (prefix + field, dims, dims_state), explicit (stated fields), parseable and invalid
    (a measurement of zero, which is no record). An empty report states nothing and isn't parseable."""
    df = computed_once(df, {"_body": strip(F.col(text))})
    body = F.col("_body")
    df = df.withColumn("_code", record_code(body)).withColumn("_measure", F.regexp_extract(body, vocab.DIMENSIONS, 0))
    df = computed_once(df, {"_measure": F.col("_measure")})
    out = computed_once(df, {prefix + f: c for f, c in unpacked(F.col("_code"), _SAID).items()} | {prefix + "dims": dimensions(body, F.col("_measure"))}).drop("_code", "_measure")
    out = out.withColumn(prefix + "dims_state", F.when(F.col(prefix + "dims").isNull(), "not_mentioned"))
    out = out.withColumn(prefix + "invalid", F.coalesce(F.exists(prefix + "dims", lambda x: x <= 0), F.lit(False)))
    out = out.withColumn(prefix + "explicit", explicit_fields(prefix))
    return out.withColumn(prefix + "parseable", (body != "") & ((F.col(prefix + "explicit") > 0) | contains_any(body, vocab.ANCHORS))).drop("_body")


def explicit_fields(prefix: str = "") -> Column:
    """How many fields name an observation; the isthmus counts once."""
    side, segment = F.col(prefix + "location_side"), F.col(prefix + "location_segment")
    one = lambda c: c.cast("int")
    place = F.when(side == "isthmus", 1).otherwise(one(stated(side)) + one(stated(segment)))
    rest = [one(stated(F.col(prefix + f))) for f in vocab.FIELDS if not f.startswith("location")]
    return place + one(F.col(prefix + "dims").isNotNull()) + sum(rest[1:], rest[0])


def field_stated(field: str, prefix: str = "") -> Column:
    """Whether a record states a field; a segment that doesn't apply is stated in the isthmus."""
    code = F.col(prefix + field)
    if field == "location_segment":
        return F.when(F.col(prefix + "location_side") == "isthmus", code == "not_applicable").otherwise(stated(code))
    return stated(code)
