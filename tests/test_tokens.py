import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.operators import decoder, tokens, training


def test_round_trip_with_byte_fallback(spark):
    known = tokens.known_characters(tokens.vocabulary(spark.createDataFrame([("abc é\n",)], "t string"), "t"))
    assert known == sorted("abc é\n")
    rows = spark.createDataFrame([("cab",), ("a\U0001f600b日",), ("",), ("é\n",)], "t string")
    out = rows.select("t", tokens.encode(F.col("t"), known).alias("ids"), tokens.encoded_length(F.col("t"), known).alias("n")).withColumn("back", tokens.decode(known)("ids")).collect()
    assert all(r["t"] == r["back"] and len(r["ids"]) == r["n"] for r in out)
    assert out[1]["ids"][1] == vocab.FIRST_BYTE + 0xF0
    unknown = rows.select(tokens.encode(F.col("t"), known, byte_fallback=False).alias("ids")).collect()
    assert unknown[1]["ids"].count(3) == 2


def test_decode_rejects(spark):
    for ids in ([999], [-1], [vocab.FIRST_BYTE + 0xF0]):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(ids,)], "ids array<int>").select(tokens.decode(["a"])("ids")).collect()
    row = spark.createDataFrame([([1, 264, 2],)], "ids array<int>").select(tokens.decode(["a"])("ids").alias("x"), tokens.decode(["a"], skip_special=True)("ids").alias("y")).first()
    assert (row["x"], row["y"]) == ("<bos>a<eos>", "a")


def test_prompt_samples(spark):
    rows = spark.createDataFrame([(1, [300, 301], [302]), (2, [300], [302, 303])], "k int, p array<int>, t array<int>")
    s = rows.select("k", tokens.prompt_sample(F.col("p"), F.col("t"), 8).alias("s")).select("k", "s.*")
    first = s.orderBy("k").first()
    assert first["input_ids"] == [1, 5, 6, 300, 301, 7, 302, 2] and first["labels"] == [-100] * 6 + [302, 2] and first["target_start"] == 6
    with pytest.raises(PySparkException, match="longest length"):
        rows.select(tokens.prompt_sample(F.col("p"), F.col("t"), 7)).collect()
    wide = tokens.padded(s.withColumn("batch", F.lit(0)), "batch").collect()
    assert {len(r["input_ids"]) for r in wide} == {8} == {len(r["attention_mask"]) for r in wide}


def test_sentencepiece(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = spark.createDataFrame([("Hello world",), (None,)], "t string").select(tokens.sentencepiece_tokens(path)("t").alias("ids")).collect()
    assert found[0]["ids"] == sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello world") and found[1]["ids"] == []


def test_batches_resume(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    whole = training.batch_stream(rows, "k", 3, 4, 5).orderBy("batch", "slot").collect()
    rest = training.batch_stream(rows, "k", 3, 4, 5, start=3).orderBy("batch", "slot").collect()
    assert [r for r in whole if r["batch"] >= 3] == rest
    assert sorted(r["k"] for r in whole if r["epoch"] == 1) == list(range(10)) and {r["epoch"] for r in whole if r["batch"] == 2} == {0, 1}


def test_rates(spark):
    rate = {r["step"]: r["learning_rate"] for r in training.schedule(spark, 1.0, 0.1, 10, 100, 25).collect()}
    assert rate[0] == 0.1 and rate[9] == 1.0 and abs(rate[10] - 1.0) < 1e-12 and rate[100] == 0.1
    assert [r["step"] for r in training.schedule(spark, 1.0, 0.1, 10, 60, 25).filter("due").collect()] == [25, 50, 60]


def test_decoder(spark):
    config = decoder.Config(300, width=16, heads=4, layers=2, longest=24)
    model = decoder.Decoder(config, decoder.random_weights(config, 3))
    ids = np.random.default_rng(0).integers(8, 300, (2, 12))
    full = model.logits(ids)
    changed = ids.copy()
    changed[:, 8:] = 9
    assert np.allclose(full[:, :8], model.logits(changed)[:, :8])  # no place sees later ones
    held = [None] * config.layers
    steps = [model.logits(ids[:, k : k + 1], held) for k in range(12)]
    assert np.allclose(full, np.concatenate(steps, 1))
    rows = spark.createDataFrame([(1, [1, 20, 30]), (2, [5] * 30)], "k int, p array<int>")
    out = {r["k"]: r for r in decoder.decode(rows, config, model.w, "k", "p", 4).collect()}
    assert len(out[1]["generated"]) <= 4 and out[2]["error"] == "sequence over the longest length"
    scored = decoder.score(spark.createDataFrame([(1, [1, 20, 30, 2], [-100, -100, 30, 2])], "k int, input_ids array<int>, labels array<int>"), config, model.w, "k").first()
    logs = model.logits(np.array([[1, 20, 30]]))[0]
    logs = logs - np.log(np.exp(logs).sum(-1, keepdims=True))
    assert scored["tokens"] == 2 and abs(scored["loss_sum"] + logs[1, 30] + logs[2, 2]) < 1e-6


def test_decoder_in_blocks(spark, monkeypatch):
    config = decoder.Config(300, width=16, heads=4, layers=2, longest=24)
    model = decoder.Decoder(config, decoder.random_weights(config, 3))
    ids = np.random.default_rng(0).integers(8, 300, (2, 24))
    whole = model.logits(ids)
    for cells in (1, 500, 1500):
        monkeypatch.setattr(decoder, "CELLS", cells)
        assert np.allclose(whole, model.logits(ids), rtol=0, atol=1e-12)
        held = [None] * config.layers
        assert np.allclose(whole, np.concatenate([model.logits(ids[:, :10], held), model.logits(ids[:, 10:], held)], 1), rtol=0, atol=1e-12)
    longer, weights = decoder.lengthened(config, model.w, 50)
    assert longer.longest >= 50 and np.array_equal(weights["place"][:24], model.w["place"])
    assert np.array_equal(decoder.lengthened(config, model.w, 1000)[1]["place"][:50], weights["place"][:50])


def test_decoder_scores_long_turns(spark, tmp_path):
    from millrace.plans import registry

    some = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").filter("conv_id < 5").select("conv_id", "turn", "role", "text")
    longest = spark.createDataFrame([(900, 0, "user", "abc"), (900, 1, "assistant", "abc " * 4500), (901, 0, "user", "abc"), (901, 1, "assistant", None)], "conv_id long, turn int, role string, text string")
    some.select(*[some[c].cast(t) for c, t in longest.dtypes]).write.parquet(str(tmp_path / "short" / "conversations.parquet"))
    some.select(*[some[c].cast(t) for c, t in longest.dtypes]).unionByName(longest).write.parquet(str(tmp_path / "long" / "conversations.parquet"))
    short, both = ({r["example"]: tuple(r)[1:] for r in registry.queries()["decoder_scores"](spark, str(tmp_path / d)).collect()} for d in ("short", "long"))
    assert short and {k: v[0] for k, v in short.items()} == {k: both[k][0] for k in short}
    assert set(both) == set(short) | {"900:1", "901:1"}
    assert both["900:1"][0] == 18_001 and both["901:1"][0] == 1 and np.isfinite(both["900:1"][1])
