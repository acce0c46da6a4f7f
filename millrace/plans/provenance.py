"""Queries of what proves data: trees and digests over documents, chains of records, random numbers that go on."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import nested, randomness
from millrace.operators import chains, merkle
from millrace.plans.registry import register
from millrace.sources import releases, sinks, tables

_WIDTH, _ARITY = 10, 4


def _documents(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents")


_TREE = f"""rows AS (SELECT doc_id // {_WIDTH} AS node, sha256(doc_id || coalesce(':' || text, '!')) AS digest FROM {{source}}),
k AS (SELECT node, substr(digest, 1, 4) AS cell, digest, count(*) AS n FROM rows GROUP BY ALL),
c AS (SELECT node, cell, sum(n)::BIGINT AS n, sha256('c' || string_agg(digest || '=' || n, ',' ORDER BY digest)) AS sha256 FROM k GROUP BY 1, 2),
z AS MATERIALIZED (SELECT node, sum(n)::BIGINT AS n, sha256('s' || string_agg(cell || '=' || sha256, ',' ORDER BY cell)) AS sha256 FROM c GROUP BY 1),
high AS (SELECT CASE WHEN max(node) = 0 THEN 0 ELSE floor(ln(max(node)) / ln({_ARITY}) + 1e-12)::INT + 1 END AS top FROM z),
t AS (SELECT 0 AS level, node, n, sha256 FROM z UNION ALL SELECT any_value(level) + 1, node // {_ARITY}, sum(n)::BIGINT, sha256('n' || string_agg(node || '=' || sha256, ',' ORDER BY node)) FROM t WHERE level < (SELECT top FROM high) GROUP BY node // {_ARITY})"""


@register("corpus_tree", f"WITH RECURSIVE {_TREE.format(source='documents')} SELECT * FROM t UNION ALL SELECT level + 1, node, n, sha256('r' || node || '=' || sha256) FROM t WHERE level = (SELECT top FROM high)")
def corpus_tree(spark, sf_dir):
    """The hash tree of all documents in the order of doc_id: every node, with one root."""
    return merkle.tree(_documents(spark, sf_dir), "doc_id", "text", _WIDTH, _ARITY)


@register(
    "corpus_changes",
    f"""WITH o AS (SELECT doc_id // {_WIDTH} AS node, doc_id, text FROM documents), e AS (SELECT CASE WHEN doc_id % 89 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 97 = 0 THEN coalesce(text, '') || ' edited' ELSE text END AS text FROM documents WHERE doc_id % 101 <> 0),
    n AS (SELECT doc_id // {_WIDTH} AS node, doc_id, text FROM e), d AS ((SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL (SELECT * FROM n EXCEPT ALL SELECT * FROM o))
    SELECT DISTINCT node, CASE WHEN node NOT IN (SELECT node FROM o) THEN 'added' WHEN node NOT IN (SELECT node FROM n) THEN 'removed' ELSE 'changed' END AS change FROM d""",
)
def corpus_changes(spark, sf_dir):
    """The stretches in which an edited corpus (texts changed, documents lost and moved) differs, by going down two trees."""
    docs = _documents(spark, sf_dir)
    text = F.when(F.col("doc_id") % 97 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" edited"))).otherwise(F.col("text"))
    moved = F.when(F.col("doc_id") % 89 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id"))
    edited = docs.filter(F.col("doc_id") % 101 != 0).select(moved.alias("doc_id"), text.alias("text"))
    return merkle.changes(merkle.tree(docs, "doc_id", "text", _WIDTH, _ARITY), merkle.tree(edited, "doc_id", "text", _WIDTH, _ARITY), _ARITY)


def _scalar(kind: str, value: str) -> str:
    return f"sha256(CASE WHEN {value} IS NULL THEN 'null:{kind}' ELSE '{kind}:' || {value} END)"


_FIELD = lambda name: f"sha256('{name}')"
_LINE = f"sha256('struct:' || {_FIELD('chars')} || {_scalar('int', 'length(x)')} || {_FIELD('head')} || {_scalar('string', 'substr(x, 1, 8)')})"
_ENTRY = lambda key, value: f"{_scalar('string', chr(39) + key + chr(39))} || {_scalar('bigint', value)}"


@register(
    "nested_digests",
    f"""SELECT doc_id, sha256('struct:' || {_FIELD('lang')} || {_scalar('string', 'lang')} || {_FIELD('lines')}
        || sha256(CASE WHEN text IS NULL THEN 'null:array' ELSE 'array:' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_LINE}), '') END) || {_FIELD('sizes')}
        || sha256('map:' || array_to_string(list_sort([{_ENTRY('chars', 'length(text)')}, {_ENTRY('bytes', 'strlen(text)')}]), ''))) AS sha256 FROM documents""",
)
def nested_digests(spark, sf_dir):
    """Digests of documents as nested values: a struct of a language, an array of structs for lines, and a map of sizes."""
    line = lambda x: F.struct(F.char_length(x).alias("chars"), F.substring(x, 1, 8).alias("head"))
    sizes = F.create_map(F.lit("chars"), F.char_length("text").cast("bigint"), F.lit("bytes"), F.octet_length("text").cast("bigint"))
    value = F.struct("lang", F.transform(F.split("text", "\n", -1), line).alias("lines"), sizes.alias("sizes"))
    rows = _documents(spark, sf_dir).select("doc_id", value.alias("value"))
    return rows.select("doc_id", nested.digest(F.col("value"), rows.schema["value"].dataType).alias("sha256"))


_LINKS = """r AS (SELECT 'd' || doc_id AS name, sha256(coalesce(text, '')) AS sha256, doc_id FROM documents),
p AS (SELECT name, CASE WHEN doc_id % 59 = 0 THEN 'gone' || doc_id WHEN doc_id % 61 = 0 THEN 'd' || (2 * doc_id) ELSE 'd' || (doc_id // 2) END AS other, doc_id FROM r WHERE doc_id > 0),
l AS (SELECT p.name, p.other, CASE WHEN r.name IS NULL THEN 'missing' WHEN p.doc_id % 53 = 0 THEN 'changed' END AS problem FROM p LEFT JOIN r ON r.name = p.other)"""


@register(
    "chain_verdicts",
    f"""WITH RECURSIVE {_LINKS},
    w AS (SELECT name, name AS at, [name] AS path, 0 AS depth, NULL::VARCHAR AS link, NULL::VARCHAR AS problem FROM r UNION ALL
          SELECT w.name, l.other, list_append(w.path, l.other), w.depth + 1, w.at || ' -> ' || l.other, CASE WHEN l.problem IS NOT NULL THEN l.problem WHEN list_contains(w.path, l.other) THEN 'cycle' END FROM w JOIN l ON l.name = w.at WHERE w.problem IS NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY depth, link) AS k FROM w WHERE problem IS NOT NULL)
    SELECT w.name, max(w.depth) AS length, count(w.problem) AS n_problems, any_value(f.depth) AS depth, any_value(f.link) AS link, any_value(f.problem) AS problem FROM w LEFT JOIN f ON f.name = w.name AND f.k = 1 GROUP BY w.name""",
)
def chain_verdicts(spark, sf_dir):
    """Documents as records that rest on each other: each names the one of half its number by hash; some hashes are wrong, some records missing, some chains go round."""
    docs = _documents(spark, sf_dir)
    records = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id")
    half = F.floor(F.col("doc_id") / 2).cast("bigint")
    other = F.when(F.col("doc_id") % 59 == 0, F.concat(F.lit("gone"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("d"), F.when(F.col("doc_id") % 61 == 0, F.col("doc_id") * 2).otherwise(half).cast("string")))
    named = records.filter("doc_id > 0").select("name", other.alias("other"), "doc_id")
    told = named.join(records.select(F.col("name").alias("other"), "sha256"), "other", "left")
    links = told.select("name", "other", F.when(F.col("doc_id") % 53 == 0, F.lit("wrong")).otherwise(F.coalesce("sha256", F.lit("none"))).alias("sha256"))
    return chains.verdicts(records.select("name", "sha256"), links)


_SEED = 20
_HEX = lambda start: f"('0x' || substr(h, {start}, 13))::BIGINT"


@register(
    "resumed_draws",
    f"""WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS counter FROM documents), d AS (SELECT *, sha256('{_SEED}/order/' || counter) AS h FROM c)
    SELECT doc_id, counter, {_HEX(1)} / 4503599627370496.0::DOUBLE AS uniform, {_HEX(1)} % 6 AS die, round(sqrt(-2 * ln(1 - {_HEX(1)} / 4503599627370496.0::DOUBLE)) * cos(2 * pi() * ({_HEX(14)} / 4503599627370496.0::DOUBLE)), 9) AS normal FROM d""",
)
def resumed_draws(spark, sf_dir):
    """Random numbers for the documents of even number, the state saved and taken up again, and then for the others: as if drawn in one go."""
    docs = _documents(spark, sf_dir).select("doc_id")
    folder = sinks.shared_folder(spark, "draws")
    even, state = randomness.numbered(docs.filter("doc_id % 2 = 0"), randomness.Streams(_SEED), "order", "doc_id")
    releases.put_json(folder, "state.json", {"random": state.saved()})
    state = randomness.Streams.restored(releases.get_json(folder, "state.json")["random"], _SEED)
    odd, state = randomness.numbered(docs.filter("doc_id % 2 = 1"), state, "order", "doc_id")
    counter = F.col("counter")
    draws = {"uniform": randomness.uniform(_SEED, "order", counter), "die": randomness.below(_SEED, "order", counter, 6), "normal": F.round(randomness.normal(_SEED, "order", counter), 9)}
    return even.unionByName(odd).select("doc_id", "counter", *[c.alias(k) for k, c in draws.items()])
