"""Training steps: slopes against differences, sums against partitions, steps against plain ones, and that it learns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.vocab import IGNORED_LABEL
from millrace.operators import decoder, learning, training
from millrace.sources import snapshots

CONFIG = decoder.Config(vocabulary=11, width=6, heads=2, layers=2, longest=40)


def weights(seed=1, config=CONFIG):
    r = np.random.default_rng(seed)
    return {k: np.asarray(w + r.normal(0, 0.2, w.shape)) for k, w in decoder.random_weights(config, seed).items()}


def samples(n=30, seed=2, most=20):
    r = random.Random(seed)
    out = []
    for k in range(n):
        ids = [r.randint(1, 10) for _ in range(r.randint(3, most))]
        masked = r.randint(1, len(ids) - 1)
        out.append((k, ids, [IGNORED_LABEL] * masked + ids[masked:]))
    return out


SCHEMA = "k long, input_ids array<int>, labels array<int>"


def gradient(w, ids, labels):
    return learning.sample_gradient(CONFIG, w, np.array(ids[:-1]), np.array(labels[1:]))


@pytest.mark.parametrize("block", [3, 256])
def test_slopes_are_those_of_small_differences(monkeypatch, block):
    monkeypatch.setattr(learning, "BLOCK", block)
    w, (_, ids, labels) = weights(), samples(1, 5)[0]
    loss, n, g = gradient(w, ids, labels)
    assert n == sum(x != IGNORED_LABEL for x in labels[1:])
    r = np.random.default_rng(3)
    for k in w:
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in w[k].shape)
            ends = []
            for step in (1e-5, -1e-5):
                moved = {**w, k: w[k].copy()}
                moved[k][at] += step
                ends.append(gradient(moved, ids, labels)[0])
            assert g[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-5, abs=1e-7), k


def test_blocks_change_nothing_and_the_loss_is_the_scorers(spark, monkeypatch):
    w, some = weights(), samples()
    whole = [gradient(w, i, l) for _, i, l in some]
    monkeypatch.setattr(learning, "BLOCK", 4)
    for (_, i, l), (loss, n, g) in zip(some, whole, strict=True):
        other = gradient(w, i, l)
        assert other[0] == pytest.approx(loss, rel=1e-12) and other[1] == n and all(np.allclose(other[2][k], g[k], rtol=1e-9, atol=1e-12) for k in g)
    scored = {x["k"]: (x["loss_sum"], x["tokens"]) for x in decoder.score(spark.createDataFrame(some, SCHEMA), CONFIG, w, "k").collect()}
    assert all(scored[k][0] == pytest.approx(x[0], rel=1e-9) and scored[k][1] == x[1] for (k, _, _), x in zip(some, whole, strict=True))


def test_sums_are_the_same_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(learning, "SLICE", 100)
    w, some = weights(), samples()
    found = [learning.batch_gradient(spark.createDataFrame(random.Random(p).sample(some, len(some)), SCHEMA).repartition(p), CONFIG, w) for p in (1, 3, 7)]
    for loss, tokens, g in found[1:]:
        assert loss == found[0][0] and tokens == found[0][1] and all((g[k] == found[0][2][k]).all() for k in g)
    plain = [gradient(w, i, l) for _, i, l in some]
    assert found[0][0] == pytest.approx(sum(x[0] for x in plain), abs=1e-9) and found[0][1] == sum(x[1] for x in plain)
    assert all(np.allclose(found[0][2][k], sum(x[2][k] for x in plain), atol=1e-9) for k in w)
    empty = learning.batch_gradient(spark.createDataFrame([], SCHEMA), CONFIG, w)
    assert empty[:2] == (0.0, 0) and not any(g.any() for g in empty[2].values())


def test_adamw_by_hand():
    settings = learning.Settings(most=0.1, least=0.01, warmup=0, last=10, decay=0.5, clip=1e9)
    state = learning.State.new({"a": np.array([[2.0]]), "b": np.array([2.0])})
    after, size, rate = learning.adamw(state, {"a": np.array([[3.0]]), "b": np.array([4.0])}, settings)
    assert size == 5.0 and rate == 0.1  # the first step moves by the rate, whatever the gradient's size; matrices decay besides
    assert after.weights["a"][0, 0] == pytest.approx(2 * (1 - 0.1 * 0.5) - 0.1) and after.weights["b"][0] == pytest.approx(1.9)
    clipped, _, _ = learning.adamw(state, {"a": np.array([[3.0]]), "b": np.array([4.0])}, learning.Settings(clip=1.0))
    assert clipped.first["a"][0, 0] == pytest.approx(0.1 * 3 / 5, rel=1e-5)
    with pytest.raises(RuntimeError, match="finite"):
        learning.adamw(state, {"a": np.array([[np.nan]]), "b": np.array([4.0])}, settings)
    with pytest.raises(ValueError, match="finite"):
        learning.fixed(np.array([np.inf]))


def test_rates_are_the_schedules(spark):
    for settings in (learning.Settings(warmup=3, last=9), learning.Settings(warmup=0, last=5)):
        column = training.rate(F.col("id").cast("double"), settings.most, settings.least, settings.warmup, settings.last)
        for x in spark.range(12).select("id", column.alias("r")).collect():
            assert settings.rate(x["id"]) == pytest.approx(x["r"])


def test_training_learns_and_goes_on_after_a_restart(spark, tmp_path):
    """Sequences that count up: the loss falls far below that of guessing; a run in two parts, with a snapshot between, is the run in one."""
    rows = [(k, [(k + j) % 10 + 1 for j in range(12)], [IGNORED_LABEL] * 2 + [(k + j) % 10 + 1 for j in range(2, 12)]) for k in range(48)]
    df = spark.createDataFrame(rows, SCHEMA)
    settings = learning.Settings(most=0.05, least=0.005, warmup=2, last=24)
    start = learning.State.new(decoder.random_weights(CONFIG))
    ask = dict(key="k", batch=8, accumulated=2, epochs=8)
    whole, told = learning.train(df, CONFIG, start, settings, **ask)
    assert len(told) == 24 and all(x["examples"] == 16 and x["tokens"] == 160 for x in told)
    assert told[0]["loss"] == pytest.approx(math.log(11), abs=0.3) and told[-1]["loss"] < 0.7 * told[0]["loss"]
    half, first = learning.train(df, CONFIG, start, settings, steps=3, **ask)
    snapshots.save_latest(str(tmp_path), "step-3.zip", half.arrays(), {"step": half.step})
    again = learning.State.of(snapshots.load_latest(str(tmp_path))[0])
    end, second = learning.train(df.repartition(3), CONFIG, again, settings, steps=2, **ask)
    assert first + second == told[:5] and end.step == 5
    with pytest.raises(RuntimeError, match="target"):
        learning.train(df.withColumn("labels", F.transform("labels", lambda _: F.lit(IGNORED_LABEL))), CONFIG, start, settings, **ask)


def test_overfit(spark):
    """A few samples are learned by heart; a step that goes nowhere (a rate of nothing) shows."""
    df = spark.createDataFrame(samples(4, 9, 8), SCHEMA)
    start = decoder.random_weights(CONFIG)
    state, told = learning.overfit(df, CONFIG, start, learning.Settings(most=0.05, least=0.02, warmup=0, last=30, decay=0.0), "k", 4, 30)
    assert told["steps"] == state.step == 30 and told["samples"] == 4 and told["parameters"] == sum(w.size for w in start.values())
    assert told["final_loss"] < 0.3 * told["initial_loss"] and told["final_token_accuracy"] > max(0.8, told["initial_token_accuracy"])
    _, still = learning.overfit(df, CONFIG, start, learning.Settings(most=0.0, least=0.0, warmup=0, last=2), "k", 4, 1)
    assert still["final_loss"] == still["initial_loss"]
    with pytest.raises(ValueError, match="target"):
        learning.target_metrics(df.limit(0), CONFIG, start, "k")


def test_exponentials_are_those_of_numpy():
    r = np.random.default_rng(4)
    for bound in (0.0, 0.05, 0.3, 1.0, 4.0):
        x = r.uniform(-bound, bound, (40, 50))
        halved = decoder.halvings(bound)
        found = x / 2**halved
        decoder.exponentials(found, halved, (np.empty_like(x), np.empty_like(x)))
        assert np.allclose(found, np.exp(x), rtol=3e-14, atol=0)
    assert decoder.halvings(50.0) is None and decoder.halvings(math.nan) is None


@pytest.mark.parametrize("times", [1, 30, 3000])
def test_shares_kept_or_worked_out_twice(monkeypatch, times):
    """A room that holds all shares, some, or none gives the same slopes, for small scores and for those that overflow without their maximum; it grows by no sample."""
    monkeypatch.setattr(learning, "BLOCK", 8)
    w = {k: v * (times if "qkv" in k else 1) for k, v in weights().items()}
    _, ids, labels = samples(1, 5)[0]
    ids, labels = ids * 2, labels * 2
    args = CONFIG, w, np.array(ids[:-1]), np.array(labels[1:])
    room = learning.Room(1 << 12)
    whole = [learning.sample_gradient(*args, room) for _ in range(3)]
    assert len(room.cells) == 1 << 12 and all(len(x) <= 16 for x in room.spare[:1])
    for other in (whole[1], whole[2], learning.sample_gradient(*args, learning.Room(100)), learning.sample_gradient(*args, learning.Room(0))):
        assert other[:2] == whole[0][:2] and all(np.allclose(other[2][k], whole[0][2][k], rtol=1e-12, atol=1e-14) for k in w)
