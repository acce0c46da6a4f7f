"""Queries of the decoder over conversations: scores with attention that SQL says too, and training steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.operators import tokens
from millrace.plans.corpus import _TURNS_SQL
from millrace.plans.registry import register
from millrace.sources.tables import dealt, load

_CONTROL = {name: vocab.CONTROL_TOKENS.index(name) for name in ("<bos>", "<task_generate>", "<input>", "<target>", "<eos>")}
_BEFORE = [_CONTROL[x] for x in ("<bos>", "<task_generate>", "<input>", "<target>")]
#: A decoder of width 2: a state is how far its two numbers lie apart. Queries, keys, values and output, and what they make of two states: q k = LIKE h h' / sqrt(2), and an output of TAKEN h.
_QKV = ((1.5, -0.5, 0.5, 0.25, 0.5, 0.25), (-0.5, 0.5, -0.5, 0.75, 0.25, -0.25))
_OUT = ((1.0, -1.0), (1.0, -0.5))
_LIKE, _TAKEN = 2.0 * 1.0 + -1.0 * -0.5, ((0.25 * 1.0 + 0.5 * 1.0) - (0.25 * -1.0 + 0.5 * -0.5)) / 2

_ATTENTION_SQL = f"""{_TURNS_SQL},
av AS (SELECT token, row_number() OVER (ORDER BY token) + {vocab.FIRST_CHARACTER - 1} AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS token FROM conversations)),
an AS (SELECT * FROM tu WHERE role = 'assistant' AND prompt IS NOT NULL),
ap AS (SELECT conv_id, turn, count(id) AS n, coalesce(sum(id % 2), 0) AS odd FROM (SELECT conv_id, turn, unnest(CASE WHEN prompt = '' THEN [NULL] ELSE regexp_extract_all(prompt, '(?s).') END) AS token FROM an) LEFT JOIN av USING (token) GROUP BY 1, 2),
ac AS (SELECT conv_id, turn, unnest(c) AS token, unnest(generate_series(1, len(c))) AS p FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?s).') AS c FROM an)),
ai AS (SELECT conv_id, turn, list(id ORDER BY p) AS ids FROM ac JOIN av USING (token) GROUP BY 1, 2),
az AS (SELECT conv_id, turn, unnest(list_prepend({_CONTROL['<target>']}, coalesce(ids, []))) AS id, unnest(list_append(coalesce(ids, []), {_CONTROL['<eos>']})) AS wanted, unnest(range(1, len(coalesce(ids, [])) + 2)) AS p FROM an LEFT JOIN ai USING (conv_id, turn)),
ar AS (SELECT conv_id, turn, wanted, 1 - 2 * (id % 2) AS side, {sum(x % 2 for x in _BEFORE[:3])} + ap.odd + sum(id % 2) OVER w AS odd, 3 + ap.n + count(*) OVER w AS seen FROM az JOIN ap USING (conv_id, turn) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY p)),
ag AS (SELECT 1 / sqrt(1 + 1e-5::DOUBLE) AS s, ({vocab.FIRST_CHARACTER} + count(*)) // 2 AS odds, ({vocab.FIRST_CHARACTER} + count(*) + 1) // 2 - 1 AS evens FROM av),
aw AS (SELECT conv_id, turn, wanted, odds, evens, side + {_TAKEN} * s * ((seen - odd) * exp({_LIKE} / sqrt(2) * s * s * side) - odd * exp(-{_LIKE} / sqrt(2) * s * s * side)) / ((seen - odd) * exp({_LIKE} / sqrt(2) * s * s * side) + odd * exp(-{_LIKE} / sqrt(2) * s * s * side)) AS d FROM ar CROSS JOIN ag),
al AS (SELECT *, d / sqrt(d * d + 1e-5::DOUBLE) AS z FROM aw)"""


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Assistant turns as samples (example, input_ids, labels), the size of their vocabulary, and places for the longest."""
    turns = load(spark, sf_dir, "conversations")
    known = tokens.known_characters(tokens.vocabulary(turns, "text"))
    rows = dealt(turns.withColumn("prompt", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant' and prompt is not null"))
    sample = tokens.prompt_sample(tokens.encode(F.col("prompt"), known), tokens.encode(F.coalesce("text", F.lit("")), known))
    bytes_ = turns.agg(F.max(F.octet_length("text"))).first()[0] or 0
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("example"), sample.alias("s")).select("example", "s.input_ids", "s.labels"), vocab.FIRST_CHARACTER + len(known), 2 * bytes_ + 5


@register(
    "decoder_attention",
    f"WITH {_ATTENTION_SQL} SELECT conv_id || ':' || turn AS example, count(*) AS tokens, round(sum(ln(evens * exp(2 * z) + odds * exp(-2 * z) + exp(4 * z)) - z * CASE WHEN wanted = {_CONTROL['<eos>']} THEN 4 WHEN wanted % 2 = 0 THEN 2 ELSE -2 END), 6) AS loss_sum, sum((z > 0 AND wanted = {_CONTROL['<eos>']})::INT)::BIGINT AS correct FROM al GROUP BY conv_id, turn",
)
def decoder_attention(spark, sf_dir):
    """Scores by a decoder whose attention is at work: a place's state is that of its id's parity and, by their likeness, of all places before, which SQL counts."""
    import numpy as np

    from millrace.operators import decoder

    sample, size, longest = _samples(spark, sf_dir)
    config = decoder.Config(size, width=2, heads=1, layers=1, longest=longest)
    weights = {k: np.zeros_like(w) if k != "norm" and "norm" not in k else w for k, w in decoder.random_weights(config).items()}
    side = np.where(np.arange(size) % 2, -1.0, 1.0)
    side[_CONTROL["<eos>"]] = 2.0
    weights |= {"token": np.stack([side, -side], axis=1), "0.qkv": np.array(_QKV), "0.out": np.array(_OUT)}
    return decoder.score(sample, config, weights, "example").withColumn("loss_sum", F.round("loss_sum", 6))


_MOST = 5


@register(
    "greedy_turns",
    f"""WITH {_TURNS_SQL}, gv AS (SELECT token, row_number() OVER (ORDER BY token) + {vocab.FIRST_CHARACTER - 1} AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS token FROM conversations)),
    gp AS (SELECT conv_id, turn, prompt[-1:] AS token FROM tu WHERE role = 'assistant' AND prompt IS NOT NULL)
    SELECT conv_id || ':' || turn AS example, coalesce(id, {_CONTROL['<input>']}) % 2 = 0 AS eos_finished, CASE WHEN coalesce(id, {_CONTROL['<input>']}) % 2 = 0 THEN '' ELSE array_to_string(list_transform(range({_MOST}), lambda x: 1), ',') END AS generated,
    CASE WHEN coalesce(id, {_CONTROL['<input>']}) % 2 = 0 THEN NULL ELSE 'no end within the limit' END AS error FROM gp LEFT JOIN gv USING (token)""",
)
def greedy_turns(spark, sf_dir):
    """Greedy decoding from every prompt by a decoder of whole-number weights: an even id is followed by the end, an odd one by the first odd id, again and again up to the limit."""
    import numpy as np

    from millrace.operators import decoder

    turns = load(spark, sf_dir, "conversations")
    known = tokens.known_characters(tokens.vocabulary(turns, "text"))
    rows = dealt(turns.withColumn("prompt", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant' and prompt is not null"))
    prompts = rows.select(F.concat_ws(":", "conv_id", "turn").alias("example"), F.concat(F.array(*[tokens.special(x) for x in ("<bos>", "<task_generate>", "<input>")]), tokens.encode(F.col("prompt"), known)).alias("prompt"))
    bytes_ = turns.agg(F.max(F.octet_length("text"))).first()[0] or 0
    size = vocab.FIRST_CHARACTER + len(known)
    config = decoder.Config(size, width=2, heads=1, layers=1, longest=bytes_ + 3 + _MOST)
    weights = {k: np.zeros_like(w) if k != "norm" and "norm" not in k else w for k, w in decoder.random_weights(config).items()}
    side = np.where(np.arange(size) % 2, -1.0, 1.0)
    side[_CONTROL["<eos>"]] = 2.0
    weights["token"] = np.stack([side, -side], axis=1)
    found = decoder.decode(prompts, config, weights, "example", "prompt", _MOST)
    return found.select("example", "eos_finished", F.array_join("generated", ",").alias("generated"), "error")


@register("decoder_training")
def decoder_training(spark, sf_dir):
    """An epoch of training a small decoder on all assistant turns: a row for each step."""
    from millrace.operators import decoder, learning

    sample, size, longest = _samples(spark, sf_dir)
    config, weights = decoder.lengthened(config := decoder.Config(size, width=8, heads=2, layers=1, longest=1 << 10), decoder.random_weights(config), longest)
    settings = learning.Settings(most=0.02, least=0.002, warmup=2, last=200)
    _, told = learning.train(sample, config, learning.State.new(weights), settings, "example", batch=64, accumulated=4, seed=20)
    rows = [(x["step"], x["examples"], x["tokens"], x["loss"], x["gradient_norm"], x["learning_rate"]) for x in told]
    return spark.createDataFrame(rows, "step long, examples long, tokens long, loss double, gradient_norm double, learning_rate double")
