"""Training steps of the numpy decoder on tables: gradients summed over partitions, clipping, and AdamW whose moments go from step to step.

A step is one job over its micro-batches. Tasks work out each sample's gradient by itself and add it up in fixed point, whole numbers whose sums depend on no order, so a step is the same, bit for bit,
however the samples lie in partitions and whichever tasks run again. Partial sums leave a task in slices of the parameters, and each slice is added up in a task of its own; the driver gets the sum, as large as
the model, and holds weights and moments. Attention is worked through in blocks of places, forth and back, with running sums over blocks of keys; shares are kept for the way back as far as a fixed room goes, so a long sample needs memory for that, not for its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.vocab import IGNORED_LABEL
from millrace.operators import decoder, training
from millrace.operators.decoder import Config
from millrace.sources.sinks import shared_folder

#: Places of a block; of attention it is half of that by as many keys. Shares of attention that a task keeps (64 MB).
BLOCK, HELD = 256, 1 << 23
#: Bits after the point of the sums, the half of them that goes apart, and parameters of a slice.
POINT, HALF, SLICE = 40, 32, 1 << 16
EPSILON = 1e-5


@dataclass(frozen=True)
class Settings:
    most: float = 3e-3
    least: float = 3e-4
    warmup: int = 2
    last: int = 100
    beta1: float = 0.9
    beta2: float = 0.95
    epsilon: float = 1e-8
    decay: float = 0.1
    clip: float = 1.0

    def rate(self, step: int) -> float:
        """The learning rate of a step, counted from 0: training.rate for one number."""
        if step < self.warmup:
            return (step + 1) * self.most / self.warmup
        if step >= self.last:
            return self.least
        return self.least + (self.most - self.least) * 0.5 * (1 + math.cos(math.pi * (step - self.warmup) / (self.last - self.warmup)))


@dataclass(frozen=True)
class State:
    """All that a step needs of those before."""

    step: int
    weights: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]

    @staticmethod
    def new(weights: dict[str, np.ndarray]) -> State:
        zeros = {k: np.zeros_like(w, np.float64) for k, w in weights.items()}
        return State(0, {k: np.asarray(w, np.float64) for k, w in weights.items()}, zeros, zeros)

    def arrays(self) -> dict[str, np.ndarray]:
        """For a snapshot."""
        return {f"{kind}/{k}": a for kind, held in (("weights", self.weights), ("first", self.first), ("second", self.second)) for k, a in held.items()} | {"step": np.array(self.step)}

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> State:
        parts = {kind: {k.split("/", 1)[1]: a for k, a in arrays.items() if k.startswith(f"{kind}/")} for kind in ("weights", "first", "second")}
        return State(int(arrays["step"]), **parts)


def norm(x: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, tuple]:
    x = x - x.mean(-1, keepdims=True)
    size = np.sqrt((x**2).mean(-1, keepdims=True) + EPSILON)
    return x / size * scale, (x / size, size)


def norm_back(dy: np.ndarray, scale: np.ndarray, held: tuple) -> tuple[np.ndarray, np.ndarray]:
    unit, size = held
    d = dy * scale
    return (d - d.mean(-1, keepdims=True) - unit * (d * unit).mean(-1, keepdims=True)) / size, (dy * unit).sum(0)


def gelu(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value, and its slope."""
    square = u * u
    with np.errstate(over="ignore"):
        t = 1 - 2 / (np.exp(2 * 0.7978845608 * (u + 0.044715 * (square * u))) + 1)  # the hyperbolic tangent; np.tanh takes longer
    half = 0.5 * (1 + t)
    return u * half, half + 0.5 * u * (1 - t * t) * 0.7978845608 * (1 + 3 * 0.044715 * square)


def _blocks(n: int) -> Iterator[slice]:
    for low in range(0, n, BLOCK):
        yield slice(low, min(low + BLOCK, n))


class Room:
    """A task's memory for attention: shares that the way back reads again, as many as fit; the others are worked out twice."""

    def __init__(self, cells: int | None = None):
        self.cells, self.used, self.spare = np.empty(HELD if cells is None else cells), 0, [np.empty(0)] * 3

    def kept(self, rows: int, columns: int) -> np.ndarray | None:
        low, high = self.used, self.used + rows * columns
        if high > len(self.cells):
            return None
        self.used = high
        return self.cells[low:high].reshape(rows, columns)

    def passing(self, k: int, rows: int, columns: int) -> np.ndarray:
        """One of three stretches that the next block writes over."""
        if len(self.spare[k]) < rows * columns:
            self.spare[k] = np.empty(rows * columns)
        return self.spare[k][: rows * columns].reshape(rows, columns)


def _strips(n: int) -> Iterator[tuple[slice, list[slice]]]:
    """Blocks of places, each with the blocks of keys they see, of a size that stays in a core's cache."""
    for low in range(0, n, half := max(1, BLOCK // 2)):
        high = min(low + half, n)
        yield slice(low, high), [slice(a, min(a + half, high)) for a in range(0, high, half)]


def _scores(q: np.ndarray, key: np.ndarray, rows: slice, columns: slice, out: np.ndarray, later: float) -> np.ndarray | None:
    """What the places of a block make of those of another; the part where keys come later is set to a number, and returned with where."""
    np.matmul(q[rows], key[columns].T, out=out)
    first = max(rows.start + 1, columns.start)
    if columns.stop <= first:
        return None
    where = np.arange(first, columns.stop) > np.arange(rows.start, rows.stop)[:, None]
    np.copyto(out[:, first - columns.start :], later, where=where)
    return where


def attention(q: np.ndarray, key: np.ndarray, value: np.ndarray, room: Room) -> tuple[np.ndarray, tuple]:
    """Of heads by places by width: what each place takes from those before, block by block, and what the way back needs. Scores whose bound is small need no maximum taken off."""
    q, key = np.ascontiguousarray(q) / math.sqrt(q.shape[-1]), np.ascontiguousarray(key)
    more = np.concatenate([value, np.ones((*value.shape[:2], 1))], -1)  # the shares' sum comes with what is taken
    bound = math.sqrt((q * q).sum(-1).max(initial=0) * (key * key).sum(-1).max(initial=0))
    bounded, halved = bound < 300, decoder.halvings(bound)
    asked = q if halved is None else q / 2**halved
    out, total, top, held = np.empty(value.shape), np.empty((*q.shape[:2], 1)), np.zeros((*q.shape[:2], 1)), []
    for h in range(len(q)):
        for rows, seen in _strips(q.shape[1]):
            taken, high = np.zeros((rows.stop - rows.start, more.shape[-1])), np.full((rows.stop - rows.start, 1), -np.inf)
            for columns in seen:
                size = rows.stop - rows.start, columns.stop - columns.start
                s = room.kept(*size) if bounded else None
                held.append(s)
                s = room.passing(0, *size) if s is None else s
                where = _scores(asked[h], key[h], rows, columns, s, 0.0 if bounded else -np.inf)
                if not bounded:
                    higher = np.maximum(high, s.max(-1, keepdims=True))
                    taken *= np.exp(high - higher)
                    s -= higher
                    high = higher
                _powers(s, halved, room)
                if where is not None and bounded:
                    np.copyto(s[:, s.shape[1] - where.shape[1] :], 0.0, where=where)
                taken += s @ more[h, columns]
            total[h, rows] = taken[:, -1:]
            out[h, rows] = taken[:, :-1] / total[h, rows]
            if not bounded:
                top[h, rows] = high
    return out, (q, asked, key, more, total, top, halved, held)


def _powers(s: np.ndarray, halved: int | None, room: Room) -> None:
    if halved is None:
        np.exp(s, out=s)
    else:
        decoder.exponentials(s, halved, (room.passing(1, *s.shape), room.passing(2, *s.shape)))


def attention_back(d: np.ndarray, out: np.ndarray, known: tuple, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slopes of queries, keys and values; shares that weren't kept are worked out again, block by block."""
    q, asked, key, more, total, top, halved, held = known
    dq, dk, dv, blocks = np.zeros_like(q), np.zeros_like(key), np.zeros_like(out), iter(held)
    for h in range(len(q)):
        for rows, seen in _strips(q.shape[1]):
            own = d[h, rows] / total[h, rows]
            less = np.concatenate([own, -(own * out[h, rows]).sum(-1, keepdims=True)], -1)
            for columns in seen:
                size, share = (rows.stop - rows.start, columns.stop - columns.start), next(blocks)
                if share is None:
                    share = room.passing(0, *size)
                    where = _scores(asked[h], key[h], rows, columns, share, -np.inf if halved is None else 0.0)
                    if halved is None:
                        share -= top[h, rows]
                    _powers(share, halved, room)
                    if where is not None:
                        np.copyto(share[:, share.shape[1] - where.shape[1] :], 0.0, where=where)
                dv[h, columns] += share.T @ own
                ds = np.matmul(less, more[h, columns].T, out=room.passing(1, *size))
                ds *= share
                dq[h, rows] += ds @ key[h, columns]
                dk[h, columns] += ds.T @ q[h, rows]
    return dq / math.sqrt(q.shape[-1]), dk, dv  # the queries were divided


def sample_gradient(config: Config, w: dict[str, np.ndarray], ids: np.ndarray, wanted: np.ndarray, room: Room | None = None) -> tuple[float, int, dict[str, np.ndarray]]:
    """The summed loss of a sample's unmasked places, their number, and the loss's slope for every weight. ids and wanted: the sequence without its last id, and the labels one place on. room: a task's, for one sample after the other."""
    room = Room() if room is None else room
    room.used = 0
    n, d, heads = len(ids), config.width, config.heads
    if n > config.longest:
        raise ValueError("sequence over the longest length")
    split = lambda a: a.reshape(n, heads, -1).transpose(1, 0, 2)
    joined = lambda a: a.transpose(1, 0, 2).reshape(n, d)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    x, layers = w["token"][ids] + w["place"][:n], []
    for k in range(config.layers):
        h1, held1 = norm(x, w[f"{k}.norm1"])
        q, key, value = (split(p) for p in np.split(h1 @ w[f"{k}.qkv"], 3, axis=-1))
        out, known = attention(q, key, value, room)
        y = x + joined(out) @ w[f"{k}.out"]
        h2, held2 = norm(y, w[f"{k}.norm2"])
        act, slope = gelu(h2 @ w[f"{k}.up"])
        layers.append((h1, held1, out, known, h2, held2, act, slope))
        x = y + act @ w[f"{k}.down"]
    states, held = norm(x, w["norm"])
    unmasked = np.flatnonzero(wanted != IGNORED_LABEL)
    loss, ds = 0.0, np.zeros_like(states)
    bound = math.sqrt((states * states).sum(-1).max(initial=0) * (w["token"] * w["token"]).sum(-1).max())
    halved = decoder.halvings(bound)
    for some in _blocks(len(unmasked)):
        at = unmasked[some]
        scores, own = states[at] @ w["token"].T, (np.arange(len(at)), wanted[at])
        if halved is None:
            scores -= scores.max(-1, keepdims=True)
        said = scores[own]
        if halved:
            scores /= 2**halved
        _powers(scores, halved, room)
        total = scores.sum(-1, keepdims=True)
        loss -= float((said - np.log(total[:, 0])).sum())
        scores /= total
        scores[own] -= 1
        ds[at] = scores @ w["token"]
        g["token"] += scores.T @ states[at]
    dx, g["norm"] = norm_back(ds, w["norm"], held)
    for k in range(config.layers - 1, -1, -1):
        h1, held1, out, known, h2, held2, act, slope = layers[k]
        g[f"{k}.down"] = act.T @ dx
        du = dx @ w[f"{k}.down"].T * slope
        g[f"{k}.up"] = h2.T @ du
        back, g[f"{k}.norm2"] = norm_back(du @ w[f"{k}.up"].T, w[f"{k}.norm2"], held2)
        dy = dx + back
        g[f"{k}.out"] = joined(out).T @ dy
        slopes = attention_back(split(dy @ w[f"{k}.out"].T), out, known, room)
        dqkv = np.concatenate([joined(a) for a in slopes], axis=-1)
        g[f"{k}.qkv"] = h1.T @ dqkv
        back, g[f"{k}.norm1"] = norm_back(dqkv @ w[f"{k}.qkv"].T, w[f"{k}.norm1"], held1)
        dx = dy + back
    np.add.at(g["token"], ids, dx)
    g["place"][:n] += dx
    return loss, len(unmasked), g


def flat(held: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([held[k].ravel() for k in sorted(held)])


def shaped(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: part.reshape(like[k].shape) for k, part in zip(sorted(like), np.split(vector, ends[:-1]), strict=True)}


def fixed(values: np.ndarray) -> np.ndarray:
    """As whole numbers with POINT bits after the point."""
    if not np.isfinite(values).all() or np.abs(values).max(initial=0) >= 1 << 62 - POINT:
        raise ValueError("a gradient isn't finite or too large")
    return np.rint(values * (1 << POINT)).astype(np.int64)


def batch_gradient(df: DataFrame, config: Config, weights: dict[str, np.ndarray], ids: str = "input_ids", labels: str = "labels") -> tuple[float, int, dict[str, np.ndarray]]:
    """The summed loss, the number of unmasked places and the summed gradient of all rows, in exact sums of fixed-point numbers."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # the model, a parameter's size
    slices = -(-(sum(w.size for w in weights.values()) + 1) // SLICE)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), slices)

    def run(batches):
        w, high, low, tokens, room = shared.value, None, None, 0, Room()
        for batch in batches:
            for i, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                loss, n, g = sample_gradient(config, w, np.array(i[:-1], np.int64), np.array(l[1:], np.int64), room)
                own = fixed(np.append(flat(g), loss))
                if high is None:
                    high, low = np.zeros_like(own), np.zeros_like(own)
                high += own >> HALF  # halves apart, so that sums of 2^31 samples hold
                low += own & (1 << HALF) - 1
                tokens += n
        if high is not None:
            rows = [(k, high[a : a + SLICE].tobytes(), low[a : a + SLICE].tobytes(), tokens if not k else 0) for k, a in enumerate(range(0, len(high), SLICE))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    def fold(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for k, high, low, n in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                held = sums.setdefault(k, [0, 0, 0])
                sums[k] = [held[0] + np.frombuffer(high, np.int64), held[1] + np.frombuffer(low, np.int64), held[2] + n]
        rows = [(k, h.tobytes(), l.tobytes(), n) for k, (h, l, n) in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    schema = "slice int, high binary, low binary, tokens long"
    total = df.select(ids, labels).mapInArrow(run, schema).repartition(parts, "slice").mapInArrow(fold, schema)
    found = sorted(total.collect(), key=lambda x: x["slice"])  # one row for each slice of the model
    if not found:
        return 0.0, 0, {k: np.zeros_like(w) for k, w in weights.items()}
    high, low = (np.concatenate([np.frombuffer(x[c], np.int64) for x in found]) for c in ("high", "low"))
    sums = (high.astype(np.float64) * (1 << HALF) + low) / (1 << POINT)
    return float(sums[-1]), sum(x["tokens"] for x in found), shaped(sums[:-1], weights)


_NAMES = ["slice", "high", "low", "tokens"]
_TYPES = (pa.int32(), pa.binary(), pa.binary(), pa.int64())


def adamw(state: State, gradient: dict[str, np.ndarray], settings: Settings) -> tuple[State, float, float]:
    """The state after a step by a mean gradient, the gradient's norm before it was clipped, and the rate. Weights of two dimensions decay."""
    size = math.sqrt(sum(float((g**2).sum()) for g in gradient.values()))
    if not math.isfinite(size):
        raise RuntimeError("the gradient isn't finite")
    shrink, rate, step = min(1.0, settings.clip / (size + 1e-6)), settings.rate(state.step), state.step + 1
    weights, first, second = {}, {}, {}
    for k, w in state.weights.items():
        g = gradient[k] * shrink
        first[k] = settings.beta1 * state.first[k] + (1 - settings.beta1) * g
        second[k] = settings.beta2 * state.second[k] + (1 - settings.beta2) * g**2
        move = first[k] / (1 - settings.beta1**step) / (np.sqrt(second[k] / (1 - settings.beta2**step)) + settings.epsilon)
        weights[k] = w * (1 - rate * (settings.decay if w.ndim >= 2 else 0.0)) - rate * move
    return State(step, weights, first, second), size, rate


def train(df: DataFrame, config: Config, state: State, settings: Settings, key: str, batch: int, accumulated: int, seed: int = 0, epochs: int = 1, steps: int | None = None) -> tuple[State, list[dict]]:
    """Steps over micro-batches of a shuffled order (training.batch_stream), accumulated to a step by their numbers of target tokens; from the state's step on, as many as are asked for or there are.

    A row for each step: step, examples, tokens, loss (mean of the tokens'), gradient_norm and learning_rate. The samples are dealt to their steps once, and a step reads its own. A step without targets is an error.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "steps")
    dealt = training.batch_stream(df, key, epochs, batch, seed).withColumn("step", F.floor(F.col("batch") / accumulated).cast("bigint"))
    cores = spark.sparkContext.defaultParallelism
    share = F.pmod("slot", F.lit(cores))  # a step's samples lie in a file for each core, so that it is read by as many tasks, whatever its size
    dealt.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), "step", share).sortWithinPartitions("step", share).select("step", "input_ids", "labels", share.alias("share")).write.partitionBy("step", "share").parquet(folder)
    held = spark.read.parquet(folder)
    sizes = {x["step"]: x["count"] for x in held.groupBy("step").count().collect()}  # a row for each step
    told = []
    while state.step in sizes and (steps is None or len(told) < steps):
        loss, tokens, g = batch_gradient(held.filter(F.col("step") == state.step), config, state.weights)
        if not tokens:
            raise RuntimeError("a step has no target tokens")
        now = state.step
        state, size, rate = adamw(state, {k: v / tokens for k, v in g.items()}, settings)
        told.append({"step": now, "examples": sizes[now], "tokens": tokens, "loss": loss / tokens, "gradient_norm": size, "learning_rate": rate})
    return state, told


def target_metrics(df: DataFrame, config: Config, weights: dict[str, np.ndarray], key: str) -> tuple[float, float, int]:
    """Mean loss and accuracy of the unmasked places of all samples under teacher forcing, and the number of samples."""
    scored = decoder.score(df, config, weights, key)
    found = scored.agg(F.sum("loss_sum").alias("loss"), F.sum("correct").alias("correct"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    if not found["tokens"]:
        raise ValueError("there are no target tokens")
    return found["loss"] / found["tokens"], found["correct"] / found["tokens"], found["n"]


def overfit(df: DataFrame, config: Config, weights: dict[str, np.ndarray], settings: Settings, key: str, batch: int, epochs: int, seed: int = 0) -> tuple[State, dict]:
    """Trains on the same few samples again and again, to see whether a step learns at all: the state, and steps, samples, parameters, loss and accuracy before and after."""
    before = target_metrics(df, config, weights, key)
    state, told = train(df, config, State.new(weights), settings, key, batch, 1, seed, epochs)
    after = target_metrics(df, config, state.weights, key)
    named = {f"{when}_{name}": round(v, 6) for when, found in (("initial", before), ("final", after)) for name, v in zip(("loss", "token_accuracy"), found, strict=False)}
    return state, {"steps": len(told), "samples": before[2], "parameters": sum(w.size for w in weights.values()), **named}
