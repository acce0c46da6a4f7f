"""Queries of releases: what is written, read back, joined, batched and counted for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import DIGITS, clip, content_id
from millrace.operators import challenge, extract, render, score, stats, tokens, training
from millrace.plans import duck
from millrace.plans.corpus import _BATCH_SQL, _CASE_ROWS_SQL, _STATES_SQL, _batches, _case_rows
from millrace.plans.records import _NOISY_SQL, _noisy, _rendered, exams
from millrace.plans.registry import register
from millrace.sources import cases, releases, sinks, tables

#: Full-width digits, in their order.
WIDE = DIGITS[DIGITS.index("０") :][:10]
_SPACES = vocab.GAP.removesuffix("*") + "+"


@register("first_unique_cases", f"WITH {duck.IDENTIFIED} SELECT attempt, semantic_case_id FROM c1 ORDER BY attempt LIMIT 500")
def first_unique_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 different records in the order of attempts: the limit is the feature."""
    attempts = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("attempt"))
    return cases.unique_cases(cases.identified(cases.draw_exams(attempts)), 500).select("attempt", "semantic_case_id")


@register("sequential_batches", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents) SELECT doc_id, position, (position - 1) // 48 AS batch, (position - 1) % 48 AS slot FROM r")
def sequential_batches(spark, sf_dir):
    return training.sequential_batches(tables.load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 48)


@register("aligned_scores", f"WITH {_NOISY_SQL} SELECT template_family, count(*) AS n, sum((prediction = target)::INT)::BIGINT AS equal, sum((length(prediction) < length(target))::INT)::BIGINT AS shorter FROM n1 GROUP BY 1")
def aligned_scores(spark, sf_dir):
    """Predictions beside gold reports, paired by key with a guard against missing and repeated rows."""
    keys = ["attempt", "template_family"]
    rows = sinks.materialized(_noisy(spark, sf_dir).select(*keys, "prediction", "target"))  # two tables that are read, not made twice
    both = score.aligned(rows.select(*keys, "prediction"), rows.select(*keys, "target"), keys)
    return both.groupBy("template_family").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction") == F.col("target")).cast("bigint")).alias("equal"), F.sum((F.char_length("prediction") < F.char_length("target")).cast("bigint")).alias("shorter"))


_LONG = lambda by, name, value: f"SELECT part, '{by}' AS statistic, {name} AS name, ({value})::DOUBLE AS value"


def _statistics_sql() -> str:
    lengths = lambda c: [f"{_LONG(c + '_chars', duck.q(name), value)} FROM b GROUP BY part" for name, value in (("min_length", f"min(length({c}))"), ("max_length", f"max(length({c}))"), ("mean_length", f"round(avg(length({c})), 3)"), *((f"p{p}", f"quantile_disc(length({c}), {p / 100})") for p in (50, 90, 95, 99)))]
    duplicates = [f"{_LONG('duplicate_rows', duck.q(c), f'count(*) - count(DISTINCT {c})')} FROM b GROUP BY part" for c in ("sample_id", "semantic_case_id", "input", "target")]
    fields = " UNION ALL ".join(f"SELECT part, {duck.q('field ' + n)} AS statistic, {c} AS name FROM d" for n, c in stats.SPECIFIED.items())
    pieces = [
        f"{_LONG('rows', duck.q('samples'), 'count(*)')} FROM b GROUP BY part",
        f"{_LONG('rows', duck.q('semantic_cases'), 'count(DISTINCT semantic_case_id)')} FROM b GROUP BY part",
        f"{_LONG('template_family', 'template_family', 'count(*)')} FROM b GROUP BY part, template_family",
        "SELECT part, statistic, name, count(*)::DOUBLE AS value FROM v GROUP BY ALL",
        "SELECT part, 'missing_state' AS statistic, state AS name, count(*)::DOUBLE AS value FROM m WHERE state IS NOT NULL GROUP BY ALL",
        "SELECT part, 'dimension_count' AS statistic, len(dims)::VARCHAR AS name, count(*)::DOUBLE AS value FROM d WHERE dims IS NOT NULL GROUP BY ALL",
        f"{_LONG('dimension_mm', duck.q('least'), 'min(list_min(dims))')} FROM d WHERE dims IS NOT NULL GROUP BY part",
        f"{_LONG('dimension_mm', duck.q('largest'), 'max(list_max(dims))')} FROM d WHERE dims IS NOT NULL GROUP BY part",
        *lengths("input"),
        *lengths("target"),
        *duplicates,
    ]
    return f"""WITH {_CASE_ROWS_SQL},
    a AS (SELECT *, 'sample_' || sha256('generate:' || semantic_case_id || ':' || template_family || ':{vocab.RENDERER_VERSION}') AS sample_id FROM cr),
    b AS (SELECT * FROM a UNION ALL SELECT * REPLACE ('all' AS part) FROM a),
    d AS (SELECT DISTINCT ON (part, semantic_case_id) * FROM b), v AS ({fields}), m AS (SELECT part, unnest([{_STATES_SQL}, dims_state]) AS state FROM d)
    {' UNION ALL '.join(pieces)}"""


@register("dataset_statistics", _statistics_sql())
def dataset_statistics(spark, sf_dir):
    """All statistics of a release in one long table, for each part and for all."""
    return stats.assembled(_case_rows(spark, sf_dir), "part")


_PADDED_SQL = f"""{_BATCH_SQL}, pi AS (SELECT doc_id, batch, list_transform(range(1, n_chars % 9 + 2), lambda k: (doc_id + k)::INT) AS ids FROM bb),
pl AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS short FROM pi)"""


@register("padded_batches", f"WITH {_PADDED_SQL} SELECT doc_id, batch, array_to_string(ids || list_transform(range(short), lambda k: 0), ',') AS ids, array_to_string(ids || list_transform(range(short), lambda k: {vocab.IGNORED_LABEL}), ',') AS labels, array_to_string(list_transform(ids, lambda k: 1) || list_transform(range(short), lambda k: 0), ',') AS mask FROM pl")
def padded_batches(spark, sf_dir):
    """Batches of samples of different lengths, padded on the right to each batch's longest."""
    ids = F.transform(F.sequence(F.lit(1), F.pmod("n_chars", F.lit(9)) + 1), lambda k: (F.col("doc_id") + k).cast("int"))
    rows = tokens.padded(_batches(spark, sf_dir).withColumn("input_ids", ids).withColumn("labels", F.col("input_ids")), "batch")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("doc_id", "batch", text("input_ids").alias("ids"), text("labels").alias("labels"), text("attention_mask").alias("mask"))


_CHALLENGE = {"challenge_id": "'c' || (o_orderkey % 1000)", "semantic_case_id": "'s' || o_custkey", "reference_report": "CAST(o_orderdate AS STRING)"}


@register("challenge_repeats", " UNION ALL ".join(f"SELECT '{c}' AS \"check\", {e.replace('STRING', 'VARCHAR')} AS value, count(*) AS n FROM orders GROUP BY 2 HAVING count(*) > 1" for c, e in _CHALLENGE.items()))
def challenge_repeats(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "orders").select(*[F.expr(e).alias(c) for c, e in _CHALLENGE.items()])
    return challenge.repeated(rows)


_FLAT = rf"trim(regexp_replace(coalesce(text, ''), {duck.q(_SPACES)}, ' ', 'g'))"


@register("clipped_texts", f"SELECT doc_id, CASE WHEN length({_FLAT}) <= 80 THEN {_FLAT} ELSE substr({_FLAT}, 1, 79) || '…' END AS evidence FROM documents")
def clipped_texts(spark, sf_dir):
    """Texts as evidence in findings: white space as single blanks, 80 characters at most."""
    return tables.load(spark, sf_dir, "documents").select("doc_id", clip(F.coalesce("text", F.lit(""))).alias("evidence"))


@register("vocabulary_texts", f"WITH {duck.RENDERED}, t AS (SELECT 'input' AS role, template_family, input AS text FROM r1 UNION ALL SELECT 'target', template_family, target FROM r1) SELECT role, template_family, count(*) AS n, sum(length(text))::BIGINT AS chars FROM t GROUP BY 1, 2")
def vocabulary_texts(spark, sf_dir):
    """Inputs and targets of all samples as rows of their own."""
    rows = tables.text_rows(render.render_cases(exams(spark, sf_dir)).select("template_family", "input", "target"), ["input", "target"])
    return rows.groupBy("role", "template_family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@register("examples_with_slice", f"WITH {duck.RENDERED} SELECT attempt, template_family, target FROM r1 WHERE template_family = '{vocab.HELD_OUT}' AND attempt <= 40 UNION ALL (SELECT attempt, template_family, target FROM r1 WHERE template_family = 'location_first_v2' ORDER BY attempt LIMIT 50)")
def examples_with_slice(spark, sf_dir):
    """A few rows, and behind them the first 50 of one family: the limit is the feature."""
    rows = _rendered(spark, sf_dir).select("attempt", "template_family", "target")
    few = rows.filter((F.col("template_family") == vocab.HELD_OUT) & (F.col("attempt") <= 40))
    return tables.with_first_of(few, rows, F.col("template_family") == "location_first_v2", "attempt", 50)


@register("release_round_trip", f"WITH {duck.RENDERED} SELECT 'sample_' || sha256('generate:' || semantic_case_id || ':' || template_family || ':{vocab.RENDERER_VERSION}') AS example_id, 'all' AS split, semantic_case_id, sha256(input) AS input_sha256, target AS reference_text FROM r1")
def release_round_trip(spark, sf_dir):
    """Samples written as JSON lines to the shared folder and read again as evaluation examples."""
    folder = sinks.shared_folder(spark, "release")
    sinks.json_lines(render.render_cases(exams(spark, sf_dir))).write.option("compression", "gzip").text(folder)
    found = tables.generated(spark, folder, "all")
    return found.select("example_id", "split", "semantic_case_id", F.sha2("input", 256).alias("input_sha256"), "reference_text")


_CHALLENGE_JSON = f"""WITH {duck.FRAGMENTS}, c AS (SELECT *, {duck.report('location_first_v2')} AS reference_report FROM p1)
SELECT 'challenge_' || sha256('{vocab.CHALLENGE_VERSION}:' || semantic_case_id || ':' || reference_report) AS example_id, 'challenge' AS split, semantic_case_id, reference_report AS reference_text, location_side || ',' || composition AS tags FROM c"""


@register("challenge_round_trip", _CHALLENGE_JSON)
def challenge_round_trip(spark, sf_dir):
    """Challenge rows with ids and tags, written as JSON lines to the shared folder and read again as evaluation examples."""
    rows = render.fragments(exams(spark, sf_dir)).withColumn("reference_report", render.report("location_first_v2"))
    made = rows.select(
        content_id("challenge_", F.concat(F.lit(f"{vocab.CHALLENGE_VERSION}:"), F.col("semantic_case_id"), F.lit(":"), F.col("reference_report"))).alias("challenge_id"),
        "semantic_case_id",
        "input",
        "reference_report",
        F.array("location_side", "composition").alias("difficulty_tags"),
        F.lit(vocab.SCHEMA_VERSION).alias("schema_version"),
        F.lit(vocab.CHALLENGE_VERSION).alias("challenge_version"),
        F.lit("made").alias("authoring_method"),
        F.lit("synthetic").alias("source"),
    )
    folder = sinks.shared_folder(spark, "challenge")
    sinks.json_lines(made).write.option("compression", "gzip").text(folder)
    found = tables.challenge(spark, folder)
    return found.select("example_id", "split", "semantic_case_id", "reference_text", F.array_join("difficulty_tags", ",").alias("tags"))


@register("fixture_round_trip", f"WITH {duck.RENDERED} SELECT 'f' || attempt AS example_id, 'fixtures' AS split, {', '.join(vocab.FIELDS)}, array_to_string(list_transform(dims, lambda x: x::VARCHAR), ',') AS dims_text, dims_state, target AS reference_text FROM r1 WHERE template_family = 'location_first_v2'")
def fixture_round_trip(spark, sf_dir):
    """Nested records as curated fixtures are kept, written as JSON lines to the shared folder and read again as flat ones."""
    rows = _rendered(spark, sf_dir).filter("template_family = 'location_first_v2'")
    dims = F.concat(F.lit("["), F.array_join(F.transform("dims", lambda x: x.cast("string")), ","), F.lit("]"))
    own = [F.col(f) for f in vocab.FIELDS if not f.startswith("location") and f != "lymph_nodes"]
    nodule = F.struct(F.lit("n1").alias("nodule_id"), F.struct(F.col("location_side").alias("side"), F.col("location_segment").alias("segment")).alias("location"), F.coalesce(dims, "dims_state").alias("dimensions_mm"), *own)
    made = rows.select(F.concat(F.lit("f"), F.col("attempt").cast("string")).alias("sample_id"), F.struct(F.array(nodule).alias("nodules"), "lymph_nodes").alias("structure"), F.col("target").alias("report"))
    folder = sinks.shared_folder(spark, "fixtures")
    sinks.json_lines(made).write.text(folder)
    found = tables.fixtures(spark, folder)
    return found.select("example_id", "split", *vocab.FIELDS, F.array_join(F.transform("dims", lambda x: x.cast("string")), ",").alias("dims_text"), "dims_state", "reference_text")


@register(
    "bundle_files",
    "WITH l AS (SELECT 'region_' || n_regionkey AS part, n_nationkey AS k, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}' AS line FROM nation) SELECT part, part || '.jsonl' AS path, count(*) AS records, sum(strlen(line) + 1)::BIGINT AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY k)) AS sha256 FROM l GROUP BY 1",
)
def bundle_files(spark, sf_dir):
    """A release in one call, and what its manifest says of its files."""
    rows = tables.load(spark, sf_dir, "nation").select(F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("part"), "n_nationkey", "n_name")
    made = sinks.write_bundle(rows, "part", "n_nationkey", rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), sinks.shared_folder(spark, "bundle"), "nations")
    files = [(k, f["path"], f["records"], f["bytes"], f["sha256"]) for k, f in made["files"].items() if k != "statistics"]
    return spark.createDataFrame(files, "part string, path string, records bigint, bytes bigint, sha256 string")


_FILE_LINES = 300


@register(
    "release_files",
    f"""WITH l AS (SELECT coalesce(lang, 'und') AS part, doc_id, '{{"doc_id":' || doc_id || ',"n_chars":' || length(coalesce(text, '')) || ',"text_sha256":"' || sha256(coalesce(text, '')) || '"}}' AS line FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, line) - 1 AS k, count(*) OVER (PARTITION BY part) AS total FROM l)
    SELECT part || CASE WHEN any_value(total) <= {_FILE_LINES} THEN '' ELSE '-' || printf('%06d', k // {_FILE_LINES}) END || '.jsonl' AS path, count(*) AS records, sum(strlen(line) + 1)::BIGINT AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY k)) AS sha256, NULL::VARCHAR AS problem
    FROM r GROUP BY part, k // {_FILE_LINES}""",
)
def release_files(spark, sf_dir):
    """A release of all documents by language, which tasks write: its manifest's entries, and what a second reading of the files finds wrong."""
    text = F.coalesce("text", F.lit(""))
    rows = tables.load(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("und")).alias("lang"), "doc_id", F.char_length(text).alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
    folder = sinks.shared_folder(spark, "release")
    releases.write_files(rows, "lang", "doc_id", folder, _FILE_LINES, {"dataset_name": "documents"})
    releases.freeze(spark, folder, "freeze.json", {"dataset_name": "documents"})
    problems = releases.release_problems(spark, folder, "freeze.json")
    return releases.manifest_rows(spark, folder).join(problems, "path", "full")


@register("wide_digits", f"WITH {duck.RENDERED} SELECT attempt, array_to_string(list_transform(dims, lambda x: round(x, 6)::VARCHAR), ',') AS dims_text FROM r1 WHERE template_family = 'location_first_v2'")
def wide_digits(spark, sf_dir):
    """Measurements of reports that are written with full-width digits and ideographic blanks: the record's own."""
    rows = _rendered(spark, sf_dir).filter("template_family = 'location_first_v2'")
    odd = F.replace(F.translate("target", "0123456789", WIDE), F.lit("×"), F.lit("　×　"))
    found = extract.extract(rows.withColumn("odd", odd), "odd")
    return found.select("attempt", F.array_join(F.transform("parsed_dims", lambda x: F.round(x, 6).cast("string")), ",").alias("dims_text"))


@register("sentencepiece_round_trip", "SELECT p_partkey, p_name AS decoded, true AS some_ids FROM part")
def sentencepiece_round_trip(spark, sf_dir):
    """Names to ids of a local SentencePiece model and back."""
    import public_tokenizers

    tokenizer = tokens.SentencePieceTokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    rows = tables.load(spark, sf_dir, "part").select("p_partkey", tokenizer.encode(F.col("p_name")).alias("ids"))
    return rows.select("p_partkey", tokenizer.decode(F.col("ids")).alias("decoded"), (F.size("ids") > 0).alias("some_ids"))
