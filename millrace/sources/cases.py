"""Synthetic records drawn by hashes: any row's draws depend on its attempt number alone, so rows are made anywhere, again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import computed_once, content_id, hash_number, lookup, packed, unpacked, weighted
from millrace.functions.vocab import DOMAINS, FIELDS, WEIGHTS


def attempts(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(count).withColumnRenamed("id", "attempt")


def draw(name: str, rows: int) -> Column:
    """The weighted draw of a field under one of its conditions, from its hash number."""
    _, weights = WEIGHTS[name][rows]
    return weighted(F.pmod(F.col(f"_{name}"), F.lit(sum(weights.values()))), weights)


def draw_exams(df: DataFrame, seed: int = vocab.SEED) -> DataFrame:
    """Adds the record's fields, dims (array<double>, millimetres; null without measurement) and dims_state to attempts."""
    names = [*WEIGHTS, "width", "depth", "length"]
    df = computed_once(df, {f"_{n}": hash_number(seed, F.col("attempt"), n) for n in names})
    composition = F.col("composition")
    echo = F.when(composition == "cystic", draw("echogenicity", 0)).when(composition == "spongiform", draw("echogenicity", 1))
    echo = echo.when(composition.isin("solid", "mixed_cystic_solid"), draw("echogenicity", 2)).otherwise(draw("echogenicity", 3))
    restricted = composition.isin("cystic", "spongiform") | (F.col("echogenicity") == "anechoic")
    by_restriction = {f: F.when(F.col("restricted"), draw(f, 0)).otherwise(draw(f, 1)) for f in ("shape", "margin", "echogenic_foci", "vascularity")}
    side = F.col("location_side")
    segment = F.when(side == "isthmus", "not_applicable").when(side.isin("left", "right"), draw("location_segment", 0)).otherwise(side)
    out = computed_once(df, {f: draw(f, 0) for f in ("location_side", "composition", "lymph_nodes")})
    out = computed_once(out, {"location_segment": segment, "echogenicity": echo}).withColumn("restricted", restricted)
    out = computed_once(out, by_restriction)
    state = draw("dims_state", 0)
    low, high = vocab.CLAMP

    def by_shape(k: int) -> Column:
        sizes = vocab.SIZES
        return F.when(F.col("shape") == "taller_than_wide", sizes["taller_than_wide"][k]).when(F.col("shape") == "wider_than_tall", sizes["wider_than_tall"][k]).otherwise(sizes["other"][k])

    def number(name: str, values: Column) -> Column:
        return F.pmod(F.pmod(F.col(f"_{name}"), F.lit(1 << 40)), values.cast("bigint"))

    clamp = lambda c: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    out = computed_once(out, {"_w": by_shape(0) + number("width", by_shape(1))})
    out = computed_once(out, {"_d": clamp(F.floor((F.col("_w") * (by_shape(2) + number("depth", by_shape(3))) + 50) / 100))})
    out = computed_once(out, {"_d": F.when(F.col("shape") == "taller_than_wide", F.greatest("_d", F.col("_w") + 1)).otherwise(F.col("_d"))})
    first, values = vocab.LENGTH_PERCENT
    out = computed_once(out, {"_l": clamp(F.floor((F.greatest("_w", "_d") * (first + number("length", F.lit(values))) + 50) / 100)), "_state": state})
    tenths = F.when(draw("dims_count", 0) == "3", F.array("_w", "_d", "_l")).otherwise(F.array("_w", "_d"))
    measured = F.transform(tenths, lambda x: x.cast("double") / 10)
    out = computed_once(out, {"dims": F.when(F.col("_state") == "measured", measured), "dims_state": F.when(F.col("_state") != "measured", F.col("_state"))})
    return out.drop("_w", "_d", "_l", "_state", "restricted", *[f"_{n}" for n in names])


def canonical_json(df_dims: Column | None = None) -> Column:
    """The record's canonical JSON: keys in order at every level, no blanks, measurements as decimals or a state."""
    dims = F.col("dims") if df_dims is None else df_dims
    text = F.when(dims.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(dims, lambda x: x.cast("string")), ","), F.lit("]"))).otherwise(F.concat(F.lit('"'), F.col("dims_state"), F.lit('"')))
    quoted = lambda name, field: F.concat(F.lit(f'"{name}":"'), F.col(field), F.lit('"'))
    nodule = F.concat_ws(
        ",",
        quoted("composition", "composition"),
        F.concat(F.lit('"dimensions_mm":'), text),
        quoted("echogenic_foci", "echogenic_foci"),
        quoted("echogenicity", "echogenicity"),
        F.concat(F.lit('"location":{'), quoted("segment", "location_segment"), F.lit(","), quoted("side", "location_side"), F.lit("}")),
        quoted("margin", "margin"),
        F.lit('"nodule_id":"n1"'),
        quoted("shape", "shape"),
        quoted("vascularity", "vascularity"),
    )
    return F.concat(F.lit("{"), quoted("lymph_nodes", "lymph_nodes"), F.lit(',"nodules":[{'), nodule, F.lit(f'}}],"organ":"{vocab.ORGAN}","schema_version":"{vocab.SCHEMA_VERSION}"}}'))


_OWN = [f for f in FIELDS if not f.startswith("location") and f != "lymph_nodes"]
_RECORD = f"lymph_nodes string, schema_version string, nodules array<struct<{', '.join(f'{f}: string' for f in _OWN)}, dimensions_mm: string, location: struct<side: string, segment: string>>>"


def parse_json(df: DataFrame, column: str = "input", version: str | None = None) -> DataFrame:
    """Adds the record's fields from its JSON, which is read through once; dims_state or dims, as the union says; fields left out are not_mentioned.
    version: name of a column for the record's own schema_version, null without one."""
    an_object = F.ltrim(F.col(column), F.lit(" \t\r\n")).startswith("{")  # an array of records is none
    rows = computed_once(df, {"_record": F.when(an_object, F.from_json(column, _RECORD))})
    nodule = F.get("_record.nodules", F.lit(0))
    found = {f: nodule[f] for f in _OWN} | {"location_side": nodule["location"]["side"], "location_segment": nodule["location"]["segment"], "lymph_nodes": F.col("_record.lymph_nodes")}
    dims = nodule["dimensions_mm"]
    listed = F.from_json(F.when(dims.startswith("["), dims), "array<double>")
    rows = computed_once(rows, {f: F.coalesce(found[f], F.lit("not_mentioned")) for f in FIELDS} | {"dims": listed})
    rows = rows.withColumn("dims_state", F.when(F.col("dims").isNull(), F.coalesce(dims, F.lit("not_mentioned"))))
    return (rows.withColumn(version, F.col("_record.schema_version")) if version else rows).drop("_record")


def identified(df: DataFrame) -> DataFrame:
    """Adds input (canonical JSON) and semantic_case_id, the content's own id."""
    return computed_once(computed_once(df, {"input": canonical_json()}), {"semantic_case_id": content_id("sc_", F.col("input"))})


def unique_cases(df: DataFrame, count: int | None = None) -> DataFrame:
    """Of equal records the first attempt stays; with a count, the first so many in the order of attempts."""
    first = F.row_number().over(Window.partitionBy("semantic_case_id").orderBy("attempt"))
    once = df.withColumn("_first", first).filter("_first = 1").drop("_first")
    return once if count is None else once.orderBy("attempt").limit(count)


def unique_records(df: DataFrame, parts: int) -> DataFrame:
    """unique_cases of drawn records before they are identified: equal ids are equal records, so that a number for the codes and the measurements go through the shuffle instead of texts."""
    rows = df.select("attempt", packed(DOMAINS).alias("_codes"), "dims", "dims_state")
    keys = ["_codes", "dims", "dims_state"]
    once = rows.repartition(parts, *keys).groupBy(*keys).agg(F.min("attempt").alias("attempt"))
    return computed_once(once, unpacked(F.col("_codes"), DOMAINS)).select("attempt", *FIELDS, "dims", "dims_state")


def constant_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table that is written down in code (a challenge's hand-made rows, say); a key that the schema lacks, or the other way round, is an error."""
    names = [c.split()[0] for c in schema.split(", ")]
    for row in rows:
        if set(row) != set(names):
            raise ValueError(f"keys differ from the schema: {sorted(set(row) ^ set(names))}")
    return spark.createDataFrame([tuple(row[c] for c in names) for row in rows], schema)


def schema_violations() -> Column:
    """What the record's types can't say: codes outside their domains, location rules, measurements."""
    bad = [F.when(~F.col(f).isin(list(codes)), F.lit(f"domain.{f}")) for f, codes in DOMAINS.items()]
    side, segment, dims = F.col("location_side"), F.col("location_segment"), F.col("dims")
    rules = {
        "location.isthmus_segment": (side == "isthmus") & (segment != "not_applicable"),
        "location.lobe_segment": side.isin("left", "right") & (segment == "not_applicable"),
        "dimensions.count": dims.isNotNull() & ~F.size(dims).isin(2, 3),
        "dimensions.positive": dims.isNotNull() & F.exists(dims, lambda x: x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf"))),
        "dimensions.union": dims.isNull() == F.col("dims_state").isNull(),
    }
    return F.array_compact(F.array(*bad, *[F.when(c, F.lit(k)) for k, c in rules.items()]))


def coerce_location(df: DataFrame) -> DataFrame:
    """Form payloads: the isthmus has no segment."""
    return df.withColumn("location_segment", F.when(F.col("location_side") == "isthmus", "not_applicable").otherwise(F.col("location_segment")))


def catalog(spark: SparkSession) -> DataFrame:
    """The form catalog: field, position, code, phrase (null for missing states)."""
    rows = [(f, n, code, vocab.PHRASES[f].get(code)) for f, codes in DOMAINS.items() for n, code in enumerate(codes)]
    return spark.createDataFrame(rows, "field string, position int, code string, phrase string")


def presets(spark: SparkSession) -> DataFrame:
    """Five example records for forms: name and the record's fields."""
    rest = {f: "not_mentioned" for f in FIELDS}
    chosen = {
        "plain": {"location_side": "left", "location_segment": "middle", "composition": "solid", "echogenicity": "isoechoic"},
        "cyst": {"location_side": "right", "location_segment": "lower", "composition": "cystic", "echogenicity": "anechoic", "margin": "smooth", "vascularity": "none"},
        "sponge": {"location_side": "left", "location_segment": "upper", "composition": "spongiform", "echogenicity": "isoechoic", "echogenic_foci": "comet_tail"},
        "isthmus": {"location_side": "isthmus", "location_segment": "not_applicable", "composition": "mixed_cystic_solid", "shape": "wider_than_tall"},
        "calcified": {"location_side": "right", "location_segment": "upper", "composition": "solid", "echogenicity": "hypoechoic", "shape": "taller_than_wide", "echogenic_foci": "punctate_echogenic_foci", "lymph_nodes": "suspicious"},
    }
    rows = [(name, *(rest | fields).values()) for name, fields in chosen.items()]
    return spark.createDataFrame(rows, ", ".join(["name string", *(f"{f} string" for f in FIELDS)])).withColumn("dims", F.lit(None).cast("array<double>")).withColumn("dims_state", F.lit("not_mentioned"))


def phrase(field: str) -> Column:
    return lookup(F.col(field), vocab.PHRASES[field])
