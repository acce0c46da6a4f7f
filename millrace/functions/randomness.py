"""Random numbers that can be taken up again: a number is a function of a seed, a stream's name and a counter, and all there is to keep is the counters.

Draws are columns, so a task that runs again draws the same; another stream or counter has nothing to do with it. The state is saved as JSON, beside a checkpoint, and refuses another seed's.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import ordered_rank

#: Bits of one draw: four letters of a digest each, as many as a double holds.
BITS = 52


def bits(seed: int, stream: str, counter: Column, lane: int = 0) -> Column:
    """BITS random bits as a whole number: lane 0 or 1 to 3 of a digest's four."""
    digest = F.sha2(F.concat(F.lit(f"{seed}/{stream}/"), counter.cast("string")), 256)
    return F.conv(F.substring(digest, 1 + lane * BITS // 4, BITS // 4), 16, 10).cast("bigint")


def uniform(seed: int, stream: str, counter: Column, lane: int = 0) -> Column:
    """A number from 0 to below 1."""
    return bits(seed, stream, counter, lane).cast("double") / F.lit(float(1 << BITS))


def below(seed: int, stream: str, counter: Column, n: int) -> Column:
    """A whole number from 0 to n - 1, n at most 2^40 (so that none is likelier by more than 2^-12 of its share)."""
    if not 0 < n <= 1 << 40:
        raise ValueError("n must be between 1 and 2^40")
    return F.pmod(bits(seed, stream, counter), F.lit(n))


def normal(seed: int, stream: str, counter: Column) -> Column:
    """A number of the standard normal distribution, from two lanes of one digest."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, stream, counter))) * F.cos(2 * F.pi() * uniform(seed, stream, counter, 1))


@dataclass(frozen=True)
class Streams:
    """The state: how many draws each stream has given."""

    seed: int
    counters: Mapping[str, int] = field(default_factory=dict)

    def advanced(self, stream: str, n: int) -> Streams:
        return Streams(self.seed, {**self.counters, stream: self.counters.get(stream, 0) + n})

    def saved(self) -> str:
        return json.dumps({"version": 1, "seed": self.seed, "counters": dict(self.counters)}, sort_keys=True)

    @staticmethod
    def restored(text: str, seed: int) -> Streams:
        """The saved state, if it is that of the seed."""
        state = json.loads(text)
        if state.get("version") != 1 or state["seed"] != seed or any(not isinstance(n, int) or n < 0 for n in state["counters"].values()):
            raise ValueError("the state isn't one of this seed's")
        return Streams(seed, state["counters"])


def numbered(df: DataFrame, streams: Streams, stream: str, order: str, name: str = "counter") -> tuple[DataFrame, Streams]:
    """Gives each row the stream's next counters in the order of a whole-number column without repeats, and the state after them."""
    first = streams.counters.get(stream, 0)
    rows = ordered_rank(df, order, name).withColumn(name, F.col(name) - 1 + first)
    return rows, streams.advanced(stream, df.count())
