"""Chains of records that name each other by hash (data, tokenizer, freeze, challenge set): what breaks them, at any depth, by a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.sinks import materialized

#: Links of a chain at most; a longer one is an error, not cut.
LONGEST = 100
_SETTING = "spark.sql.cteRecursionRowLimit"


def checked(records: DataFrame, links: DataFrame) -> DataFrame:
    """Every link (name, other) with its problem: missing, where nothing has the other's name, changed, where its hash isn't the recorded one."""
    own = records.select(F.col("name").alias("other"), F.col("sha256").alias("now"), F.lit(True).alias("there"))
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("now").eqNullSafe(F.col("sha256")), "changed")
    return links.join(own, "other", "left").select("name", "other", problem.alias("problem"))


def walked(records: DataFrame, links: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Each record's chains, link by link: name, at, depth, link (from -> to) and problem (missing, changed, cycle), which ends a chain.

    records: name (unique), sha256 as it is now. links: name, other, sha256 as recorded. A record may have several links; a row is a step on a way, and ways that meet go on apart.
    """
    spark = records.sparkSession
    steps = materialized(checked(records, links))
    old = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, "-1")
    try:
        rows = spark.sql(
            f"""WITH RECURSIVE walk(name, at, path, depth, link, problem) MAX RECURSION LEVEL {longest} AS (
                SELECT name, name, array(name), 0, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {{records}}
                UNION ALL
                SELECT w.name, s.other, concat(w.path, array(s.other)), w.depth + 1, concat(w.at, ' -> ', s.other),
                       CASE WHEN s.problem IS NOT NULL THEN s.problem WHEN array_contains(w.path, s.other) THEN 'cycle' END
                FROM walk w JOIN {{steps}} s ON s.name = w.at WHERE w.problem IS NULL)
            SELECT name, at, depth, link, problem FROM walk""",
            records=records.select("name"),
            steps=steps,
        )
        return materialized(rows)
    finally:
        spark.conf.set(_SETTING, old) if old is not None else spark.conf.unset(_SETTING)


def verdicts(records: DataFrame, links: DataFrame, longest: int = LONGEST) -> DataFrame:
    """For each record: the length of its longest chain, and its first problem (the nearest, then by the link's name), with link and depth; null where the whole chain holds."""
    steps = walked(records, links, longest)
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("depth", "link", "problem")))
    found = steps.groupBy("name").agg(F.max("depth").alias("length"), F.count("problem").alias("n_problems"), first.alias("first"))
    return found.select("name", "length", "n_problems", F.col("first.depth").alias("depth"), F.col("first.link").alias("link"), F.col("first.problem").alias("problem"))
