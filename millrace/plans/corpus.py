"""Queries over documents, labels, conversations, pages and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import computed_once, contains_any, content_id, length_statistics, number_text
from millrace.operators import extract, qc, render, split, stats, tokens, training
from millrace.plans import duck
from millrace.plans.records import _rendered, exams, held_exams
from millrace.plans.registry import register
from millrace.sources.sinks import materialized
from millrace.sources.tables import dealt, load, spread

SEED = vocab.SEED


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with semantic_case_id (by content) and the split of their content."""
    docs = load(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return split.assign(docs.withColumn("semantic_case_id", content_id("sc_", F.col("text"))), "semantic_case_id")


def _split_sql(source: str, case: str, name: str) -> str:
    """CTEs that assign splits to a source's cases; name holds (case, split)."""
    return f"""
{name}_n AS (SELECT count(DISTINCT {case}) AS n FROM {source}),
{name}_raw AS (SELECT i, n * r AS raw, n FROM {name}_n, (VALUES (0, 0.8::DOUBLE), (1, 0.1::DOUBLE), (2, 0.1::DOUBLE)) v(i, r)),
{name}_c AS (SELECT i, floor(raw)::BIGINT + (row_number() OVER (ORDER BY raw - floor(raw) DESC, i) <= max(n) OVER () - sum(floor(raw)::BIGINT) OVER ())::BIGINT AS c FROM {name}_raw),
{name} AS (SELECT {case}, CASE WHEN rk <= (SELECT c FROM {name}_c WHERE i = 0) THEN 'train' WHEN rk <= (SELECT sum(c) FROM {name}_c WHERE i < 2) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT {case}, row_number() OVER (ORDER BY sha256('{SEED}:' || {case})) AS rk FROM (SELECT DISTINCT {case} FROM {source})))"""


_DOCS_SQL = f"""
docs AS (SELECT * REPLACE (coalesce(text, '') AS text), 'sc_' || sha256(coalesce(text, '')) AS semantic_case_id FROM documents),
{_split_sql('docs', 'semantic_case_id', 'sp')},
sd AS (SELECT docs.*, sp.split FROM docs JOIN sp USING (semantic_case_id))"""
_LENGTHS_SQL = lambda v: f"min({v})::BIGINT AS min_length, max({v})::BIGINT AS max_length, round(avg({v}), 3) AS mean_length, " + ", ".join(f"quantile_disc({v}, {p / 100})::BIGINT AS p{p}" for p in (50, 90, 95, 99))


@register("doc_split_stats", f"WITH {_DOCS_SQL} SELECT split, count(*) AS n, count(DISTINCT semantic_case_id) AS cases, count(*) - count(DISTINCT semantic_case_id) AS repeated, {_LENGTHS_SQL('length(text)')} FROM sd GROUP BY GROUPING SETS ((split), ())")
def doc_split_stats(spark, sf_dir):
    rows = split_documents(spark, sf_dir).withColumn("chars", F.char_length("text").cast("bigint"))
    cases = F.count_distinct("semantic_case_id")
    return rows.groupingSets([["split"], []], "split").agg(F.count(F.lit(1)).alias("n"), cases.alias("cases"), (F.count(F.lit(1)) - cases).alias("repeated"), *length_statistics("chars"))


@register("doc_split_assignment", f"WITH {_DOCS_SQL} SELECT doc_id, semantic_case_id, split FROM sd")
def doc_split_assignment(spark, sf_dir):
    return split_documents(spark, sf_dir).select("doc_id", "semantic_case_id", "split")


@register("split_duplicates", f"WITH {_DOCS_SQL}, a AS (SELECT split, count(*) - count(DISTINCT doc_id) AS doc_id, count(*) - count(DISTINCT semantic_case_id) AS semantic_case_id, count(*) - count(DISTINCT text) AS text FROM sd GROUP BY split) UNPIVOT a ON doc_id, semantic_case_id, text INTO NAME column_name VALUE repeated_rows")
def split_duplicates(spark, sf_dir):
    return stats.duplicates(split_documents(spark, sf_dir), "split", ["doc_id", "semantic_case_id", "text"])


def _split_cases(spark, sf_dir) -> DataFrame:
    """All records with their split; drawn once."""
    return split.assign(held_exams(spark, sf_dir), "semantic_case_id", unique=True)


def _case_rows(spark, sf_dir, texts: bool = True, cases: DataFrame | None = None) -> DataFrame:
    """Generated samples of all records, by split part and family; without texts the records' fields and ids."""
    cases = _split_cases(spark, sf_dir) if cases is None else cases
    if not texts:
        rows = split.template_splits(cases)
        return rows.withColumn("sample_id", render.sample_id(F.col("semantic_case_id"), F.col("template_family")))
    rows = split.template_splits(render.fragments(cases))
    return computed_once(rows, {"sample_id": render.sample_id(F.col("semantic_case_id"), F.col("template_family")), "target": render.rendered(F.col("template_family"))})


_CASE_ROWS_SQL = f"""{duck.FRAGMENTS}, {_split_sql('c1', 'semantic_case_id', 'sp')},
pp AS (SELECT p1.*, sp.split FROM p1 JOIN sp USING (semantic_case_id)),
cr AS ({' UNION ALL '.join(f"SELECT *, {duck.q(f)} AS template_family, {duck.report(f)} AS target, " + (f"'test_heldout_templates' AS part FROM pp WHERE split = 'test'" if f == vocab.HELD_OUT else "CASE WHEN split = 'test' THEN 'test_seen_templates' ELSE split END AS part FROM pp") for f in vocab.FAMILIES)})"""


_IDS_SQL = f"""{duck.IDENTIFIED}, {_split_sql('c1', 'semantic_case_id', 'sp')},
ids AS (SELECT c1.attempt, semantic_case_id, f.template_family, 'sample_' || sha256('generate:' || semantic_case_id || ':' || f.template_family || ':{vocab.RENDERER_VERSION}') AS sample_id,
  CASE WHEN f.template_family = '{vocab.HELD_OUT}' THEN 'test_heldout_templates' WHEN split = 'test' THEN 'test_seen_templates' ELSE split END AS part
  FROM c1 JOIN sp USING (semantic_case_id) CROSS JOIN (SELECT unnest([{', '.join(map(duck.q, vocab.FAMILIES))}]) AS template_family) f WHERE split = 'test' OR f.template_family <> '{vocab.HELD_OUT}')"""


def _audit_sql(rows: str) -> str:
    return f"""SELECT 'cases_in_several_splits' AS "check", (SELECT count(*) FROM (SELECT semantic_case_id FROM {rows} GROUP BY 1 HAVING count(DISTINCT CASE WHEN part LIKE 'test%' THEN 'test' ELSE part END) > 1)) AS offenders
    UNION ALL SELECT 'test_cases_not_in_both_views', (SELECT count(*) FROM (SELECT semantic_case_id FROM {rows} GROUP BY 1 HAVING bool_or(part = 'test_seen_templates') <> bool_or(part = 'test_heldout_templates')))
    UNION ALL SELECT 'held_out_families_elsewhere', (SELECT count(*) FROM (SELECT template_family FROM {rows} GROUP BY 1 HAVING bool_or(part = 'test_heldout_templates') AND bool_or(part <> 'test_heldout_templates')))
    UNION ALL SELECT 'repeated_rows', (SELECT count(*) FROM (SELECT sample_id FROM {rows} GROUP BY 1 HAVING count(*) > 1))"""


def _audited(rows: DataFrame) -> DataFrame:
    return split.audit(materialized(rows.select("semantic_case_id", "part", "template_family", "sample_id")))


@register("split_leakage_audit", f"WITH {_IDS_SQL} {_audit_sql('ids')}")
def split_leakage_audit(spark, sf_dir):
    return _audited(_case_rows(spark, sf_dir, texts=False))


@register(
    "split_leakage_injected",
    f"WITH {_IDS_SQL}, leaky AS (SELECT semantic_case_id, template_family, CASE WHEN template_family = 'location_first_v2' AND attempt % 11 = 0 THEN 'validation' WHEN template_family = '{vocab.HELD_OUT}' AND attempt % 5 = 0 THEN 'train' ELSE part END AS part, CASE WHEN attempt % 13 = 0 THEN semantic_case_id ELSE sample_id END AS sample_id FROM ids) {_audit_sql('leaky')}",
)
def split_leakage_injected(spark, sf_dir):
    """The audit of rows of which some were moved to other parts and some lost their ids: every check must find its own."""
    rows = _case_rows(spark, sf_dir, texts=False)
    every = lambda n: F.pmod("attempt", F.lit(n)) == 0
    part = F.when((F.col("template_family") == "location_first_v2") & every(11), "validation").when((F.col("template_family") == vocab.HELD_OUT) & every(5), "train").otherwise(F.col("part"))
    return _audited(rows.withColumn("part", part).withColumn("sample_id", F.when(every(13), F.col("semantic_case_id")).otherwise(F.col("sample_id"))))


@register("template_split_counts", f"WITH {_CASE_ROWS_SQL} SELECT part, template_family, count(*) AS n, count(DISTINCT semantic_case_id) AS cases, {_LENGTHS_SQL('length(target)')} FROM cr GROUP BY 1, 2")
def template_split_counts(spark, sf_dir):
    """Lengths and distinct cases are counted apart, as a distinct count beside percentiles would carry their buffers for every case."""
    keys, cases = ["part", "template_family"], _split_cases(spark, sf_dir)
    rows = _case_rows(spark, sf_dir, cases=cases).select(*keys, F.char_length("target").cast("bigint").alias("chars"))
    lengths = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *length_statistics("chars"))
    distinct = split.template_splits(cases.select("semantic_case_id", "split")).groupBy(*keys).agg(F.count_distinct("semantic_case_id").alias("cases"))
    return lengths.join(distinct, keys)


@register("dataset_field_counts", f"WITH {_CASE_ROWS_SQL}, d AS (SELECT DISTINCT part, semantic_case_id, {', '.join(vocab.FIELDS)} FROM cr), u AS (UNPIVOT (SELECT part, {', '.join(f'{c} AS "{n}"' for n, c in stats.SPECIFIED.items())} FROM d) ON COLUMNS(* EXCLUDE part) INTO NAME field VALUE value) SELECT part, field, value, count(*) AS n FROM u GROUP BY 1, 2, 3")
def dataset_field_counts(spark, sf_dir):
    return stats.field_distribution(_case_rows(spark, sf_dir, texts=False), "part")


_STATES_SQL = ", ".join(f"CASE WHEN {c} IN {duck.listed(vocab.MISSING)} THEN {c} END" for c in vocab.FIELDS)


@register("dataset_missing_states", f"WITH {_CASE_ROWS_SQL}, d AS (SELECT DISTINCT ON (part, semantic_case_id) * FROM cr), u AS (SELECT part, unnest([{_STATES_SQL}, dims_state]) AS state FROM d) SELECT part, state, count(*) AS n FROM u WHERE state IS NOT NULL GROUP BY 1, 2")
def dataset_missing_states(spark, sf_dir):
    return stats.missing_states(_case_rows(spark, sf_dir, texts=False), "part")


@register("dataset_dimensions", f"WITH {_CASE_ROWS_SQL}, d AS (SELECT DISTINCT ON (part, semantic_case_id) * FROM cr WHERE dims IS NOT NULL) SELECT part, len(dims)::INT AS arity, count(*) AS n, min(list_min(dims)) AS least_mm, max(list_max(dims)) AS largest_mm FROM d GROUP BY 1, 2")
def dataset_dimensions(spark, sf_dir):
    return stats.dimension_statistics(_case_rows(spark, sf_dir, texts=False), "part")


@register("dataset_integrity", f"WITH {duck.RENDERED}, k AS (SELECT *, attempt % 4 AS kind FROM r1) SELECT CASE kind WHEN 0 THEN 'target' WHEN 1 THEN 'sample_id' WHEN 2 THEN 'versions' ELSE '' END AS problems, count(*) AS n FROM k GROUP BY 1")
def dataset_integrity(spark, sf_dir):
    """Rows of all families, three quarters of them tampered with in one way each."""
    rows = render.render_cases(held_exams(spark, sf_dir), carry=("attempt",)).withColumn("kind", F.pmod("attempt", F.lit(4))).drop("attempt")
    broken = rows.withColumn("target", F.when(F.col("kind") == 0, F.concat("target", F.lit("!"))).otherwise(F.col("target")))
    broken = broken.withColumn("sample_id", F.when(F.col("kind") == 1, F.concat("sample_id", F.lit("0"))).otherwise(F.col("sample_id")))
    broken = broken.withColumn("renderer_version", F.when(F.col("kind") == 2, "0.9.0").otherwise(F.col("renderer_version"))).drop("kind")
    return stats.integrity(broken).groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@register("lang_source_counts", "SELECT lang, source, grouping_id(lang, source)::BIGINT AS grouping, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def lang_source_counts(spark, sf_dir):
    return stats.counts(load(spark, sf_dir, "documents"), ["lang", "source"])


_LABEL = "CASE {c} WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE 'not_mentioned' END AS {c}"


@register("label_field_distribution", f"WITH d AS (SELECT lang, {_LABEL.format(c='quality')}, {_LABEL.format(c='toxic')} FROM documents LEFT JOIN labels USING (doc_id)), u AS (UNPIVOT d ON quality, toxic INTO NAME field VALUE state) SELECT lang, field, state, count(*) AS n FROM u GROUP BY 1, 2, 3")
def label_field_distribution(spark, sf_dir):
    state = lambda c: F.when(F.col(c) == 0, "no").when(F.col(c) == 1, "yes").otherwise("not_mentioned").alias(c)
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left").select("lang", state("quality"), state("toxic"))
    return rows.unpivot(["lang"], ["quality", "toxic"], "field", "state").groupBy("lang", "field", "state").agg(F.count(F.lit(1)).alias("n"))


@register("benchmark_contamination", "WITH h AS (SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, trim(b.text))) SELECT item_id, count(*) AS documents, min(doc_id) AS first_document FROM h GROUP BY item_id")
def benchmark_contamination(spark, sf_dir):
    """How many documents hold a benchmark item's whole text anywhere, and the first of them."""
    return benchmark_passages(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_document"))


@register("benchmark_passages", "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, trim(b.text))")
def benchmark_passages(spark, sf_dir):
    """Every pair of a document and a benchmark item whose whole text it holds anywhere, over line ends and within lines."""
    from millrace.operators.passages import holding

    return holding(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@register("clean_of_test_texts", f"WITH {_DOCS_SQL}, t AS (SELECT DISTINCT semantic_case_id FROM sd WHERE split = 'test') SELECT lang, count(*) AS kept FROM sd WHERE semantic_case_id NOT IN (SELECT semantic_case_id FROM t) GROUP BY lang")
def clean_of_test_texts(spark, sf_dir):
    rows = split_documents(spark, sf_dir)
    return rows.join(rows.filter("split = 'test'").select("semantic_case_id"), "semantic_case_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))


_VOCAB_SQL = f"""{_DOCS_SQL},
vc AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS token FROM sd WHERE split = 'train'),
ch AS (SELECT doc_id, split, unnest(regexp_extract_all(text, '(?s).')) AS token FROM sd),
en AS (SELECT sd.doc_id, sd.split, length(sd.text) AS chars, coalesce(x.extra, 0) AS extra, coalesce(x.unknown, 0) AS unknown FROM sd LEFT JOIN (SELECT doc_id, sum(strlen(token) - 1) AS extra, count(*) AS unknown FROM ch WHERE token NOT IN (SELECT token FROM vc) GROUP BY doc_id) x USING (doc_id))"""


@register("vocab_build", f"WITH {_VOCAB_SQL} SELECT token, (row_number() OVER (ORDER BY token) + {vocab.FIRST_CHARACTER - 1})::INT AS id FROM vc")
def vocab_build(spark, sf_dir):
    return tokens.vocabulary(split_documents(spark, sf_dir).filter("split = 'train'"), "text")


def _known(spark, sf_dir) -> list[str]:
    return tokens.known_characters(vocab_build(spark, sf_dir))


@register("token_lengths", f"WITH {_VOCAB_SQL} SELECT split, count(*) AS n, sum((chars + extra > 4096)::INT)::BIGINT AS over_limit, {_LENGTHS_SQL('(chars + extra)')} FROM en GROUP BY split")
def token_lengths(spark, sf_dir):
    rows = split_documents(spark, sf_dir).withColumn("tokens", tokens.encoded_length(F.col("text"), _known(spark, sf_dir)))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("tokens") > 4096).cast("bigint")).alias("over_limit"), *length_statistics("tokens"))


@register("oov_by_split", f"WITH {_VOCAB_SQL} SELECT split, sum(chars)::BIGINT AS characters, sum(unknown)::BIGINT AS unknown, sum(unknown)::DOUBLE / sum(chars)::DOUBLE AS unknown_rate FROM en GROUP BY split")
def oov_by_split(spark, sf_dir):
    rows = split_documents(spark, sf_dir)
    unknown = F.char_length(tokens.unknown_part(F.col("text"), _known(spark, sf_dir)))
    sums = rows.groupBy("split").agg(F.sum(F.char_length("text")).alias("characters"), F.sum(unknown).alias("unknown"))
    return sums.withColumn("unknown_rate", F.col("unknown").cast("double") / F.col("characters"))


_IDS_OF_TURNS_SQL = f"""{_VOCAB_SQL},
vi AS (SELECT token, row_number() OVER (ORDER BY token) + {vocab.FIRST_CHARACTER - 1} AS id FROM vc),
cs AS (SELECT conv_id, turn, unnest(c) AS token, unnest(generate_series(1, len(c))) AS p FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?s).') AS c FROM conversations)),
ci AS (SELECT conv_id, turn, p, token, CASE WHEN id IS NOT NULL THEN [id] ELSE list_transform(regexp_extract_all(hex(token), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1 + {vocab.FIRST_BYTE}) END AS ids FROM cs LEFT JOIN vi USING (token)),
ti AS (SELECT conv_id, turn, flatten(list(ids ORDER BY p)) AS ids FROM ci GROUP BY 1, 2),
di AS (SELECT conv_id, turn, string_agg(CASE WHEN id < {vocab.FIRST_CHARACTER} THEN printf('%02x', id - {vocab.FIRST_BYTE}) ELSE hex(token) END, '' ORDER BY p) AS h FROM (SELECT conv_id, turn, unnest(ids) AS id, unnest(generate_series(1, len(ids))) AS p FROM ti) LEFT JOIN vi USING (id) GROUP BY 1, 2)"""


@register("character_ids", f"WITH {_IDS_OF_TURNS_SQL} SELECT conv_id, turn, coalesce(len(ids), 0)::INT AS n, sha256(coalesce(array_to_string(ids, ','), '')) AS ids_sha256 FROM conversations LEFT JOIN ti USING (conv_id, turn)")
def character_ids(spark, sf_dir):
    """Every turn's ids by the documents' vocabulary, bytes for what it lacks."""
    ids = tokens.encode(F.col("text"), _known(spark, sf_dir))
    rows = computed_once(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), {"ids": ids})
    return rows.select("conv_id", "turn", F.size("ids").alias("n"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("ids_sha256"))


@register("unknown_ids", f"WITH {_VOCAB_SQL} SELECT split, sum(chars)::BIGINT AS ids, sum(unknown)::BIGINT AS unknown FROM en GROUP BY split")
def unknown_ids(spark, sf_dir):
    """Encoding without bytes: how many ids are the unknown token's."""
    rows = split_documents(spark, sf_dir)
    rows = computed_once(rows.select("split", "text"), {"ids": tokens.encode(F.col("text"), _known(spark, sf_dir), byte_fallback=False)})
    return rows.groupBy("split").agg(F.sum(F.size("ids")).alias("ids"), F.sum(tokens.count_of("ids", "<unk>")).alias("unknown"))


@register("character_round_trip", f"WITH {_IDS_OF_TURNS_SQL}, dt AS (SELECT conv_id, turn, decode(unhex(h)) AS decoded FROM di) SELECT conv_id, turn, coalesce(decoded, '') AS decoded, coalesce(decoded, '') = text AS same FROM conversations LEFT JOIN dt USING (conv_id, turn)")
def character_round_trip(spark, sf_dir):
    """Every turn encoded with the documents' vocabulary (bytes for what it lacks) and decoded again."""
    known = _known(spark, sf_dir)
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text", tokens.encode(F.col("text"), known).alias("ids"))
    return turns.withColumn("decoded", tokens.decode(known)("ids")).select("conv_id", "turn", "decoded", (F.col("decoded") == F.col("text")).alias("same"))


_TURNS_SQL = "tu AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations)"


@register("chat_prompt_mask", f"WITH {_TURNS_SQL} SELECT conv_id, turn, 4 + length(prompt)::INT AS masked, (length(text) + 1)::INT AS unmasked, (length(prompt) + length(text) + 5)::INT AS total FROM tu WHERE role = 'assistant' AND prompt IS NOT NULL")
def chat_prompt_mask(spark, sf_dir):
    """Assistant turns as targets of the turn before: how many labels are masked, how many count. The vocabulary is the turns' own."""
    turns = load(spark, sf_dir, "conversations")
    known = tokens.known_characters(tokens.vocabulary(turns, "text"))
    rows = turns.withColumn("prompt", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant' and prompt is not null")
    sample = rows.select("conv_id", "turn", tokens.prompt_sample(tokens.encode(F.col("prompt"), known), tokens.encode(F.col("text"), known)).alias("s"))
    masked = F.size(F.filter("s.labels", lambda x: x == vocab.IGNORED_LABEL))
    return sample.select("conv_id", "turn", masked.alias("masked"), (F.size("s.labels") - masked).alias("unmasked"), F.size("s.input_ids").alias("total"))


_BATCH_SQL = f"""bs AS (SELECT doc_id, n_chars, epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256((epoch + 17) || ':' || doc_id)) AS position FROM documents, (VALUES (0), (1)) e(epoch)),
bb AS (SELECT *, (epoch * (SELECT count(*) FROM documents) + position - 1) // 48 AS batch, (epoch * (SELECT count(*) FROM documents) + position - 1) % 48 AS slot FROM bs)"""


def _batches(spark, sf_dir) -> DataFrame:
    return training.batch_stream(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", epochs=2, batch=48, seed=17)


@register("micro_batches", f"WITH {_BATCH_SQL} SELECT doc_id, epoch, position, batch, slot FROM bb")
def micro_batches(spark, sf_dir):
    return _batches(spark, sf_dir).select("doc_id", "epoch", "position", "batch", "slot")


@register("padding_waste", f"WITH {_BATCH_SQL} SELECT batch, count(*) AS n, max(n_chars) AS longest, sum(n_chars)::BIGINT AS tokens, max(n_chars) * count(*) AS cells, 1 - sum(n_chars)::DOUBLE / (max(n_chars) * count(*))::DOUBLE AS padding_share FROM bb GROUP BY batch")
def padding_waste(spark, sf_dir):
    return training.padding(_batches(spark, sf_dir), "n_chars")


@register("step_loss_weights", f"WITH {_BATCH_SQL}, m AS (SELECT batch, sum(n_chars)::BIGINT AS tokens, batch // 4 AS step FROM bb GROUP BY batch) SELECT batch, tokens, step, tokens::DOUBLE / (sum(tokens) OVER (PARTITION BY step))::DOUBLE AS weight FROM m")
def step_loss_weights(spark, sf_dir):
    return training.step_weights(_batches(spark, sf_dir), "n_chars", 4)


@register("lr_schedule", "SELECT s AS step, round(CASE WHEN s < 100 THEN (s + 1) * 3e-4::DOUBLE / 100 WHEN s >= 5000 THEN 3e-5::DOUBLE ELSE 3e-5::DOUBLE + (3e-4::DOUBLE - 3e-5::DOUBLE) * 0.5::DOUBLE * (1 + cos(pi() * (s - 100) / 4900::DOUBLE)) END, 12) AS learning_rate, (s > 0 AND (s % 250 = 0 OR s = 5000)) AS due FROM range(0, 5001) t(s)")
def lr_schedule(spark, sf_dir):
    return training.schedule(spark, 3e-4, 3e-5, 100, 5000, 250).withColumn("learning_rate", F.round("learning_rate", 12))


@register("teacher_forced_metrics", f"WITH {_BATCH_SQL} SELECT epoch, round(sum(1.0::DOUBLE / (slot + 1) * n_chars) / sum(n_chars), 9) AS loss, sum(n_chars // 2)::DOUBLE / sum(n_chars)::DOUBLE AS accuracy, sum(n_chars)::BIGINT AS tokens FROM bb GROUP BY epoch")
def teacher_forced_metrics(spark, sf_dir):
    rows = _batches(spark, sf_dir).withColumn("loss", 1.0 / (F.col("slot") + 1)).withColumn("correct", F.floor(F.col("n_chars") / 2))
    return training.weighted_mean(rows, "epoch", "loss", "n_chars", "correct").withColumn("loss", F.round("loss", 9))


@register("best_variant", "SELECT o_orderpriority, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def best_variant(spark, sf_dir):
    return training.best(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice", F.col("o_orderstatus") != "P")


@register("best_so_far", "WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM m WHERE before IS NULL OR o_totalprice < before")
def best_so_far(spark, sf_dir):
    return training.new_minima(load(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice")


@register("first_failures", "WITH f AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS failures FROM orders WHERE o_orderstatus = 'F') SELECT o_orderpriority, o_orderkey, failures FROM f WHERE r <= 8")
def first_failures(spark, sf_dir):
    return training.first_failures(load(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", "o_orderkey").select("o_orderpriority", "o_orderkey", "failures")


_TERMS = ("<script", "cookie", "token", "http")


@register("page_text_qc", f"SELECT {', '.join(f'sum(contains(lower(html), {duck.q(t)})::INT)::BIGINT AS term_{k}' for k, t in enumerate(_TERMS))}, sum(({duck.has('lower(html)', _TERMS)})::INT)::BIGINT AS any_term, count(*) AS n FROM pages")
def page_text_qc(spark, sf_dir):
    low = F.lower("html")
    return load(spark, sf_dir, "pages").agg(*[F.sum(low.contains(t).cast("bigint")).alias(f"term_{k}") for k, t in enumerate(_TERMS)], F.sum(contains_any(low, _TERMS).cast("bigint")).alias("any_term"), F.count(F.lit(1)).alias("n"))


_ORDER_TEXT = "p.p_name || '大小约' || regexp_replace(l_quantity::VARCHAR, '\\.0$', '') || '×' || p.p_size || CASE l_returnflag WHEN 'A' THEN 'cm' ELSE 'mm' END"


@register(
    "order_record_roundtrip",
    f"WITH o AS (SELECT l_returnflag, l_quantity, p.p_size, {_ORDER_TEXT} AS text FROM lineitem JOIN part p ON l_partkey = p_partkey), x AS (SELECT *, regexp_extract(text, {duck.q(vocab.DIMENSIONS)}, 1)::DOUBLE * CASE WHEN regexp_extract(text, {duck.q(vocab.DIMENSIONS)}, 4) = 'cm' THEN 10 ELSE 1 END AS a FROM o) SELECT l_returnflag, count(*) AS n, sum((a = l_quantity)::INT)::BIGINT AS same, sum((a = 10 * l_quantity)::INT)::BIGINT AS tenfold FROM x GROUP BY 1",
)
def order_record_roundtrip(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")).join(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    text = F.concat("p_name", F.lit("大小约"), number_text(F.col("l_quantity")), F.lit("×"), F.col("p_size").cast("string"), F.when(F.col("l_returnflag") == "A", "cm").otherwise("mm"))
    first = extract.dimensions(text)[0]
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum((first == F.col("l_quantity")).cast("bigint")).alias("same"), F.sum((first == 10 * F.col("l_quantity")).cast("bigint")).alias("tenfold"))


@register("corpus_digests", "SELECT doc_id // 1000 AS stretch, count(*) AS n, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1")
def corpus_digests(spark, sf_dir):
    return stats.ordered_digests(load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")


@register("corpus_fingerprint", "SELECT lang, count(*) AS n, bit_xor(('0x' || substr(sha256(text), 1, 15))::BIGINT) AS xored, sum(('0x' || substr(sha256(text), 1, 8))::BIGINT)::BIGINT AS summed FROM documents GROUP BY lang")
def corpus_fingerprint(spark, sf_dir):
    return stats.fingerprint(load(spark, sf_dir, "documents"), "lang", "text")


#: Lines of a release file.
FILE_LINES = 2000


@register("manifest_files", f"WITH {_DOCS_SQL}, l AS (SELECT split, substr(semantic_case_id, 4) || chr(9) || doc_id AS line FROM sd), f AS (SELECT split, line, (row_number() OVER (PARTITION BY split ORDER BY line) - 1) // {FILE_LINES} AS file FROM l) SELECT split, file, count(*) AS records, sum(strlen(line) + 1)::BIGINT AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY line)) AS sha256 FROM f GROUP BY 1, 2")
def manifest_files(spark, sf_dir):
    """Records, bytes and hash of each file of a release that is written in sorted lines, so many to a file whatever the split's size."""
    from millrace.sources.sinks import line_manifest, numbered_files

    rows = split_documents(spark, sf_dir).select("split", F.concat(F.substring("semantic_case_id", 4, 64), F.lit("\t"), F.col("doc_id").cast("string")).alias("line"))
    return line_manifest(numbered_files(rows, "split", "line", FILE_LINES), ["split", "file"], "line")


_CHALLENGE_SQL = f"""{duck.FRAGMENTS}, {_split_sql('c1', 'semantic_case_id', 'sp')},
ch AS (SELECT p1.*, sp.split, CASE attempt % 4 WHEN 0 THEN {duck.report('location_first_v2')} WHEN 1 THEN replace({duck.report('location_first_v2')}, '见一枚', '可见单个') || '考虑恶性。' ELSE replace({duck.report('location_first_v2')}, '见一枚', '可见单个') END AS reference_report FROM p1 JOIN sp USING (semantic_case_id))"""


@register(
    "challenge_validation",
    f"WITH {_CHALLENGE_SQL} SELECT 'challenge_' || sha256('{vocab.CHALLENGE_VERSION}:' || semantic_case_id || ':' || reference_report) AS challenge_id, concat_ws(',', CASE WHEN {duck.has('reference_report', vocab.CHALLENGE_DIAGNOSTIC)} THEN 'diagnostic_language' END, CASE WHEN {' OR '.join(f'reference_report = {duck.report(f)}' for f in vocab.FAMILIES)} THEN 'template_duplicate' END, CASE WHEN split = 'train' THEN 'leaked_case' END) AS problems FROM ch",
)
def challenge_validation(spark, sf_dir):
    """Paraphrases of all records held against templates, terms and the frozen training cases."""
    from millrace.operators.challenge import validate

    cases = split.assign(held_exams(spark, sf_dir), "semantic_case_id", unique=True)
    rows = render.fragments(cases)
    plain = render.report("location_first_v2")
    other = F.replace(plain, F.lit("见一枚"), F.lit("可见单个"))
    kind = F.pmod("attempt", F.lit(4))
    rows = rows.withColumn("reference_report", F.when(kind == 0, plain).when(kind == 1, F.concat(other, F.lit("考虑恶性。"))).otherwise(other))
    frozen = cases.filter("split = 'train'").select("semantic_case_id")
    return validate(rows, frozen).select("challenge_id", F.array_join("problems", ",").alias("problems"))


@register(
    "generate_with_fallback",
    f"WITH {duck.RENDERED}, n1 AS (SELECT *, CASE attempt % 3 WHEN 0 THEN replace(target, '低回声', '') WHEN 1 THEN '' ELSE target END AS prediction FROM r1 WHERE template_family = 'location_first_v2'), {duck.parsed('n1', 'prediction', 'x1')}, {duck.findings('x1', 'f1')}, g AS (SELECT *, len(list_filter(findings, lambda f: f.severity = 'error')) > 0 AS bad FROM f1) SELECT bad AS used_fallback, count(*) AS n, sum((CASE WHEN bad THEN target ELSE prediction END = target)::INT)::BIGINT AS equal_to_template FROM g GROUP BY 1",
)
def generate_with_fallback(spark, sf_dir):
    from millrace.operators.service import generate

    rows = _rendered(spark, sf_dir).filter("template_family = 'location_first_v2'")
    kind = F.pmod("attempt", F.lit(3))
    made = rows.withColumn("prediction", F.when(kind == 0, F.replace("target", F.lit("低回声"), F.lit(""))).when(kind == 1, "").otherwise(F.col("target")))
    out = generate(made, "prediction")
    return out.groupBy("used_fallback").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("report") == F.col("target")).cast("bigint")).alias("equal_to_template"))


@register("decoder_scores")
def decoder_scores(spark, sf_dir):
    """Assistant turns, of any length, scored by a decoder of random weights (no weights come with the library): tokens, loss, hits."""
    from millrace.operators import decoder

    turns = load(spark, sf_dir, "conversations")
    known = tokens.known_characters(tokens.vocabulary(turns, "text"))
    rows = dealt(turns.withColumn("prompt", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant' and prompt is not null"))
    sample = rows.select(F.concat_ws(":", "conv_id", "turn").alias("example"), tokens.prompt_sample(tokens.encode(F.col("prompt"), known), tokens.encode(F.coalesce("text", F.lit("")), known)).alias("s")).select("example", "s.*")
    config = decoder.Config(vocab.FIRST_CHARACTER + len(known), width=16, heads=2, layers=1, longest=1 << 14)
    bytes_ = turns.agg(F.max(F.octet_length("text"))).first()[0] or 0  # a text has one id for each of its bytes at most, a sample five control ids
    config, weights = decoder.lengthened(config, decoder.random_weights(config), 2 * bytes_ + 5)
    return decoder.score(sample, config, weights, "example")


_OWN_TURNS_SQL = f"""{_TURNS_SQL},
ov AS (SELECT token, row_number() OVER (ORDER BY token) + {vocab.FIRST_CHARACTER - 1} AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS token FROM conversations)),
oc AS (SELECT conv_id, turn, unnest(c) AS token, unnest(generate_series(1, len(c))) AS p FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?s).') AS c FROM tu WHERE role = 'assistant' AND prompt IS NOT NULL)),
oi AS (SELECT conv_id, turn, list(id ORDER BY p) AS ids FROM oc JOIN ov USING (token) GROUP BY 1, 2),
op AS (SELECT conv_id, turn, unnest(list_zip(list_prepend({vocab.CONTROL_TOKENS.index('<target>')}, ids), list_append(ids, {vocab.CONTROL_TOKENS.index('<eos>')}))) AS z FROM oi),
ow AS (SELECT conv_id, turn, z[1] % 2 AS odd, z[2] AS wanted FROM op),
oz AS (SELECT 1 / sqrt(1 + 1e-5::DOUBLE) AS s, ({vocab.FIRST_CHARACTER} + count(*)) // 2 AS odds, ({vocab.FIRST_CHARACTER} + count(*) + 1) // 2 - 1 AS evens FROM ov),
ol AS (SELECT conv_id, turn, wanted, odd, (1 - 2 * odd) * s AS sign, odds, evens FROM ow CROSS JOIN oz)"""


@register(
    "decoder_parity",
    f"WITH {_OWN_TURNS_SQL} SELECT conv_id || ':' || turn AS example, count(*) AS tokens, round(sum(ln(evens * exp(2 * sign) + odds * exp(-2 * sign) + exp(4 * sign)) - sign * CASE WHEN wanted = {vocab.CONTROL_TOKENS.index('<eos>')} THEN 4 WHEN wanted % 2 = 0 THEN 2 ELSE -2 END), 6) AS loss_sum, sum((odd = 0 AND wanted = {vocab.CONTROL_TOKENS.index('<eos>')})::INT)::BIGINT AS correct FROM ol GROUP BY conv_id, turn",
)
def decoder_parity(spark, sf_dir):
    """Scores by a decoder whose weights are whole numbers: ids of one parity are likely after each other, the end most of all, so that SQL can say the loss."""
    import numpy as np

    from millrace.operators import decoder

    turns = load(spark, sf_dir, "conversations")
    known = tokens.known_characters(tokens.vocabulary(turns, "text"))
    rows = dealt(turns.withColumn("prompt", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant' and prompt is not null"))
    sample = rows.select(F.concat_ws(":", "conv_id", "turn").alias("example"), tokens.prompt_sample(tokens.encode(F.col("prompt"), known), tokens.encode(F.col("text"), known)).alias("s")).select("example", "s.*")
    bytes_ = turns.agg(F.max(F.octet_length("text"))).first()[0] or 0
    config = decoder.Config(vocab.FIRST_CHARACTER + len(known), width=2, heads=1, layers=1, longest=2 * bytes_ + 5)
    weights = {k: np.zeros_like(w) if k != "norm" and "norm" not in k else w for k, w in decoder.random_weights(config).items()}
    side = np.where(np.arange(config.vocabulary) % 2, -1.0, 1.0)
    side[vocab.CONTROL_TOKENS.index("<eos>")] = 2.0
    weights["token"] = np.stack([side, -side], axis=1)
    return decoder.score(sample, config, weights, "example").withColumn("loss_sum", F.round("loss_sum", 6))


@register("vocab_hash", f"WITH {_VOCAB_SQL} SELECT count(*) AS n, sha256(string_agg(token || chr(10), '' ORDER BY token)) AS sha256 FROM vc")
def vocab_hash(spark, sf_dir):
    return tokens.vocabulary_hash(vocab_build(spark, sf_dir))


@register("release_sets", f"WITH {_CASE_ROWS_SQL} SELECT part, array_to_string(list_sort(list(DISTINCT template_family)), ',') AS families, array_to_string(list_sort(list(DISTINCT lymph_nodes)), ',') AS lymph_codes FROM cr GROUP BY part")
def release_sets(spark, sf_dir):
    """What a release's manifest lists: the sets of families and codes in each part."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return _case_rows(spark, sf_dir, texts=False).groupBy("part").agg(joined("template_family").alias("families"), joined("lymph_nodes").alias("lymph_codes"))


@register("union_of_splits", f"WITH {_DOCS_SQL} SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS documents FROM sd GROUP BY lang")
def union_of_splits(spark, sf_dir):
    """The splits put together again hold every document once."""
    rows = split_documents(spark, sf_dir).select("doc_id", "lang", "split")
    parts = [rows.filter(F.col("split") == s).drop("split") for s in split.SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))
