"""Reports from records: shared fragments, four word orders, their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import computed_once, content_id, number_text
from millrace.sources.cases import phrase


def fragments(df: DataFrame) -> DataFrame:
    """Adds a struct `parts`: the pieces that all word orders share; null where nothing is stated."""
    side = F.col("location_side")
    location = F.concat(F.lit("甲状腺"), F.when(side.isin("left", "right"), F.concat(phrase("location_side"), F.coalesce(phrase("location_segment"), F.lit("")))).when(side == "isthmus", phrase("location_side")).otherwise("内"))
    descriptor = F.concat(F.coalesce(phrase("composition"), F.lit("")), F.coalesce(phrase("echogenicity"), F.lit("")), F.lit("结节"))
    dims = F.concat(F.lit("大小约"), F.array_join(F.transform("dims", number_text), "×"), F.lit("mm"))
    parts = {"location": location, "descriptor": descriptor, "dimensions": dims} | {f: phrase(f) for f in ("shape", "margin", "echogenic_foci", "vascularity", "lymph_nodes")}
    return computed_once(df, {"parts": F.struct(*[v.alias(k) for k, v in parts.items()])})


def lead(family: str) -> Column:
    location, descriptor, dims = (F.col(f"parts.{k}") for k in ("location", "descriptor", "dimensions"))
    if family == "location_first_v2":
        return F.concat(location, F.lit("见一枚"), descriptor)
    if family == "descriptor_first_v2":
        return F.concat(F.lit("可见一枚"), descriptor, F.lit("，位于"), location)
    if family == "dimensions_first_v2":
        measured = F.concat(F.lit("一枚约"), F.regexp_replace(dims, "^大小约", ""), F.lit("的"), descriptor, F.lit("位于"), location)
        return F.coalesce(measured, F.concat(F.lit("一枚"), descriptor, F.lit("位于"), location))
    if family == "flow_first_v2":
        return F.concat(location, F.lit("探及一枚"), descriptor)
    raise ValueError(f"unknown template family: {family}")


def report(family: str) -> Column:
    """A family's report from `parts`."""
    clauses = F.array_compact(F.array(lead(family), *[F.col(f"parts.{c}") for c in vocab.FAMILIES[family]]))
    return F.concat(F.array_join(clauses, "，"), F.lit("。"), F.coalesce(F.col("parts.lymph_nodes"), F.lit("")))


def rendered(family: Column) -> Column:
    """The report of the row's own family; a family that doesn't exist is an error."""
    out = None
    for name in vocab.FAMILIES:
        out = F.when(family == name, report(name)) if out is None else out.when(family == name, report(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown template family: "), family)).cast("string"))


def sample_id(case_id: Column, family: Column) -> Column:
    return content_id("sample_", F.concat(F.lit("generate:"), case_id, F.lit(":"), family, F.lit(f":{vocab.RENDERER_VERSION}")))


def render_cases(cases: DataFrame, families: list[str] | None = None, seed: int = vocab.SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every case in every family asked for (a case's families come from an array: no join). Needs identified cases. carry: columns of the cases to hand through."""
    families = list(vocab.FAMILIES) if families is None else families
    unknown = [f for f in families if f not in vocab.FAMILIES]
    if unknown or len(set(families)) != len(families):
        raise ValueError(f"families must be known and different: {families}")
    rows = fragments(cases).withColumn("template_family", F.explode(F.array(*map(F.lit, families))))
    return rows.select(
        sample_id(F.col("semantic_case_id"), F.col("template_family")).alias("sample_id"),
        "semantic_case_id",
        F.lit("generate").alias("task"),
        "input",
        rendered(F.col("template_family")).alias("target"),
        "template_family",
        F.lit(vocab.GENERATOR_VERSION).alias("generator_version"),
        F.lit(vocab.RENDERER_VERSION).alias("renderer_version"),
        F.lit(vocab.SCHEMA_VERSION).alias("schema_version"),
        F.lit(seed).cast("bigint").alias("seed"),
        F.lit("synthetic").alias("source"),
        *carry,
    )


def matched_family(text: Column) -> Column:
    """The first family whose report of the row's record is the text, or null."""
    return F.coalesce(*[F.when(text == report(f), F.lit(f)) for f in vocab.FAMILIES])
