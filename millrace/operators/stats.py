"""Dataset statistics, integrity of rows, and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import computed_once, length_statistics
from millrace.operators.constraints import violations
from millrace.operators.render import fragments, rendered, sample_id
from millrace.sources.cases import canonical_json, parse_json
from millrace.sources.sinks import materialized

SPECIFIED = {"location.side": "location_side", "location.segment": "location_segment"} | {f: f for f in vocab.FIELDS if not f.startswith("location")}


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by each combination and by each single column: GROUPING SETS as a long table."""
    sets = df.groupingSets([[c] for c in columns] + [columns, []], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*columns).cast("bigint").alias("grouping"))
    return sets.select(*columns, "grouping", "n")


def field_distribution(cases: DataFrame, by: str) -> DataFrame:
    """Values of each field over distinct cases."""
    names = list(SPECIFIED)
    once = cases.dropDuplicates([by, "semantic_case_id"]).select(by, *[F.col(c).alias(n) for n, c in SPECIFIED.items()])
    return once.unpivot([by], [f"`{n}`" for n in names], "field", "value").groupBy(by, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def missing_states(cases: DataFrame, by: str) -> DataFrame:
    """How often each missing state comes over the nine coded fields and the measurement, over distinct cases."""
    once = cases.dropDuplicates([by, "semantic_case_id"])
    states = F.array_compact(F.array(*[F.when(F.col(c).isin(list(vocab.MISSING)), F.col(c)) for c in SPECIFIED.values()], F.col("dims_state")))
    return once.select(by, F.explode(states).alias("state")).groupBy(by, "state").agg(F.count(F.lit(1)).alias("n"))


def dimension_statistics(cases: DataFrame, by: str) -> DataFrame:
    """Measured cases by arity, and the extremes of their values."""
    once = cases.dropDuplicates([by, "semantic_case_id"]).filter("dims is not null")
    return once.groupBy(by, F.size("dims").alias("arity")).agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("dims")).alias("least_mm"), F.max(F.array_max("dims")).alias("largest_mm"))


def lengths(df: DataFrame, by: str, value: str) -> DataFrame:
    """Length statistics for each group and, with a null group, for all rows."""
    return df.groupingSets([[by], []], by).agg(F.count(F.lit(1)).alias("n"), *length_statistics(value))


def duplicates(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Rows beyond the distinct values of each column."""
    wide = df.groupBy(by).agg(*[(F.count(F.lit(1)) - F.count_distinct(c)).alias(c) for c in columns])
    return wide.unpivot([by], columns, "column_name", "repeated_rows")


def _digest(column: str) -> list[Column]:
    """A value's 128 bits of hash as two whole numbers; null for null."""
    return [F.when(F.col(column).isNotNull(), F.xxhash64(*seed, column)) for seed in ((), (F.lit(1),))]


def _length_table(lengths: DataFrame, by: str) -> DataFrame:
    """min, max, mean (three digits) and nearest-rank percentiles by group of a table (by, chars, n) that says how many texts have each length."""
    group = Window.partitionBy(by)
    placed = lengths.withColumn("_upto", F.sum("n").over(group.orderBy("chars"))).withColumn("_all", F.sum("n").over(group))
    rank = lambda p: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col("chars"))).alias(f"p{p}")
    mean = F.round(F.sum(F.col("chars") * F.col("n")).cast("double") / F.sum("n"), 3).alias("mean_length")
    return placed.groupBy(by).agg(F.min("chars").alias("min_length"), F.max("chars").alias("max_length"), mean, *[rank(p) for p in (50, 90, 95, 99)])


def assembled(rows: DataFrame, by: str, everything: str = "all") -> DataFrame:
    """A release's statistics as one long table (by, statistic, name, value), for each group and for all rows together: samples, cases, families, coded
    fields and missing states over distinct cases, measurements, text lengths, repeated rows.

    Rows are read once: what is counted of them (lengths, and 128 bits of hash for texts and ids) is written and read back. A value's or a case's groups
    are bits of whole numbers, so that it goes through one shuffle for all groups and the whole; the groups' names are on the driver, as a manifest's are.
    """
    texts, ids = ["input", "target"], ["sample_id", "semantic_case_id", "input", "target"]
    hashes = {f"_{c}_{k}": h for c in ids for k, h in enumerate(_digest(c))}
    slim = materialized(rows.select(by, "template_family", *SPECIFIED.values(), "dims_state", F.when(F.col("dims").isNotNull(), F.size("dims")).alias("_arity"), F.array_min("dims").alias("_least"), F.array_max("dims").alias("_largest"), *[F.char_length(c).cast("bigint").alias(f"_{c}_chars") for c in texts], *[h.alias(c) for c, h in hashes.items()]))
    groups = [r[0] for r in slim.select(by).distinct().collect()]
    words = range(-(-len(groups) // 63) or 1)
    named = [F.lit(g).cast("string") for g in groups]

    def bits(word: int) -> Column:
        out = F.lit(0).cast("bigint")
        for k, g in enumerate(named[word * 63 : word * 63 + 63]):
            out = F.when(F.col(by).eqNullSafe(g), F.lit(1 << k).cast("bigint")).otherwise(out)
        return out

    marks = [F.bit_or(bits(w)).alias(f"_in_{w}") for w in words]
    held = [f"_in_{w}" for w in words]

    def by_groups(df: DataFrame) -> DataFrame:
        """A row for each group that a row's bits name, and one for the whole."""
        own = [F.when(F.col(f"_in_{k // 63}").bitwiseAND(F.lit(1 << k % 63).cast("bigint")) != 0, F.struct(g.alias("g"))) for k, g in enumerate(named)]
        every = F.array_distinct(F.array_append(F.array_compact(F.array(*own)), F.struct(F.lit(everything).alias("g"))))
        return df.withColumn("_group", F.explode(every)).withColumn(by, F.col("_group.g")).drop("_group", *held)

    def long(df: DataFrame, statistic: Column | str, name: Column, value: Column | str) -> DataFrame:
        statistic = F.lit(statistic) if isinstance(statistic, str) else statistic
        return df.select(by, statistic.alias("statistic"), name.cast("string").alias("name"), F.col(value).cast("double").alias("value") if isinstance(value, str) else value.cast("double").alias("value"))

    def wide(df: DataFrame, statistic: str) -> DataFrame:
        names = [c for c in df.columns if c != by]
        return long(df.select(by, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([by], names, "name", "value"), statistic, F.col("name"), "value")

    n, total = F.count(F.lit(1)).alias("n"), F.sum("n").alias("n")
    sizes = materialized(slim.groupBy(by, "template_family", *[f"_{c}_chars" for c in texts]).agg(n))
    sizes = sizes.withColumn(by, F.explode(F.array(F.col(by), F.lit(everything))))
    samples = sizes.groupBy(by).agg(total)

    values = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{c}_0").alias("a"), F.col(f"_{c}_1").alias("b")) for k, c in enumerate(ids)]))
    different = slim.select(by, values.alias("_v")).filter("_v.a is not null").groupBy("_v.k", "_v.a", "_v.b").agg(*marks)
    different = materialized(by_groups(different.groupBy("k", *held).agg(n)).groupBy(by).agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in enumerate(ids)]))
    both = samples.join(F.broadcast(different), samples[by].eqNullSafe(different[by]), "left").select(samples[by], "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ids])

    record = F.struct(*SPECIFIED.values(), "dims_state", "_arity", "_least", "_largest")
    once = slim.groupBy("_semantic_case_id_0", "_semantic_case_id_1").agg(F.first(record).alias("r"), *marks)
    told = [F.struct(F.lit(f"field {f}").alias("statistic"), F.col(f"r.{c}").alias("name")) for f, c in SPECIFIED.items()]
    told += [F.when(F.col(f"r.{c}").isNotNull(), F.struct(F.lit(s).alias("statistic"), F.col(f"r.{c}").cast("string").alias("name"))) for s, c in (("missing_state", "dims_state"), ("dimension_count", "_arity"))]
    facts = once.select(*held, F.col("r._least").alias("least"), F.col("r._largest").alias("largest"), F.explode(F.array(*told)).alias("_t")).filter("_t is not null")
    facts = facts.groupBy(*held, "_t.statistic", "_t.name").agg(n, F.min("least").alias("least"), F.max("largest").alias("largest"))
    facts = materialized(by_groups(facts).groupBy(by, "statistic", "name").agg(total, F.min("least").alias("least"), F.max("largest").alias("largest")))
    fields = facts.filter(F.col("statistic").startswith("field "))
    states = facts.filter("statistic = 'missing_state'").unionByName(fields.filter(F.col("name").isin(list(vocab.MISSING))))
    measured = facts.filter("statistic = 'dimension_count'")

    pieces = [
        wide(both.select(by, F.col("n").alias("samples"), F.col("semantic_case_id").alias("semantic_cases")), "rows"),
        long(sizes.groupBy(by, "template_family").agg(total), "template_family", F.col("template_family"), "n"),
        long(fields, F.col("statistic"), F.col("name"), "n"),
        long(states.groupBy(by, "name").agg(total), "missing_state", F.col("name"), "n"),
        long(measured, "dimension_count", F.col("name"), "n"),
        wide(measured.groupBy(by).agg(F.min("least").alias("least"), F.max("largest").alias("largest")), "dimension_mm"),
    ]
    for c in texts:
        table = _length_table(sizes.filter(F.col(f"_{c}_chars").isNotNull()).groupBy(by, F.col(f"_{c}_chars").alias("chars")).agg(total), by)
        pieces.append(wide(samples.join(table, samples[by].eqNullSafe(table[by]), "left").select(samples[by], *[x for x in table.columns if x != by]), f"{c}_chars"))
    pieces.append(wide(both.select(by, *[(F.col("n") - F.col(c)).alias(c) for c in ids]), "duplicate_rows"))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def integrity(rows: DataFrame) -> DataFrame:
    """Adds problems: what re-deriving a generated row contradicts (several inputs for a case, JSON, ids, text, versions, rules).

    Rows are read twice and stay where they are: cases with several inputs are found by ids and 128 bits of the inputs' hashes, and joined as a table of their own.
    """
    differ = [F.min(h) != F.max(h) for h in _digest("input")]
    several = rows.groupBy("semantic_case_id").agg((differ[0] | differ[1]).alias("_several")).filter("_several")
    several = materialized(several.withColumnRenamed("semantic_case_id", "_case"))
    parsed = computed_once(fragments(parse_json(rows, version="_version")), {"_json": canonical_json(), "_target": rendered(F.col("template_family"))})
    parsed = parsed.join(several, F.col("semantic_case_id").eqNullSafe(F.col("_case")), "left")
    tests = {
        "case_has_several_inputs": F.col("_several"),
        "input_not_canonical": F.col("_json") != F.col("input"),
        "case_id": F.concat(F.lit("sc_"), F.sha2("_json", 256)) != F.col("semantic_case_id"),
        "sample_id": sample_id(F.col("semantic_case_id"), F.col("template_family")) != F.col("sample_id"),
        "target": F.col("_target") != F.col("target"),
        "schema_version": F.coalesce("_version", F.lit("")) != F.col("schema_version"),
        "versions": (F.col("generator_version") != vocab.GENERATOR_VERSION) | (F.col("renderer_version") != vocab.RENDERER_VERSION),
        "constraints": F.size(violations()) > 0,
    }
    problems = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return parsed.withColumn("problems", problems).select(*rows.columns, "problems")


def ordered_digests(df: DataFrame, key: str, text: str, width: int = 1000) -> DataFrame:
    """Digest of the texts in the order of a whole-number key, stretch by stretch of width keys, each text ended by a line end.

    A corpus digest is the digest of these in turn; no task joins more than a stretch.
    """
    parts = F.transform(F.sort_array(F.collect_list(F.struct(key, text))), lambda x: F.concat(x[text], F.lit("\n")))
    return df.groupBy(F.floor(F.col(key) / width).alias("stretch")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(parts, ""), 256).alias("sha256"))


def fingerprint(df: DataFrame, by: str, text: str) -> DataFrame:
    """An order-free fingerprint of each group: XOR and sum of 60-bit (summed: 40-bit) digests of its rows."""
    head = lambda n: F.conv(F.substring(F.sha2(text, 256), 1, n), 16, 10).cast("bigint")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(head(15)).alias("xored"), F.sum(head(8)).alias("summed"))
