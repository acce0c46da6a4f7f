"""Operator 5: exact removal of repeated substrings over all documents by suffix arrays, and the passages that come again word for word.

Two kinds of strings are looked for in one run: LENGTH bytes (what is removed), and WORDS words between ASCII white space (passages, which are
told but not removed; a passage of a little over fifty words has often fewer than 400 bytes). What follows holds for units: bytes
or words.

Every string of that length (a window) has one anchor: of the grams in it the one with the least hash, the leftmost of equals. Equal windows have equal
anchors at the same place in them, so all copies of a window meet under its anchor's hash, wherever they are. The windows
of one anchor are neighbours; together they are its context, a stretch of at most twice a window's length. Three steps follow:

1. Contexts that are equal as a whole are counted by digest; what comes twice or more is covered.
2. Contexts that are alone, but share their anchor with others, go with one copy of each of these to a shard by the anchor's hash.
   What no other context of the anchor can share is left out (by halving as in step 3, a few times); of the rest
   the suffix array is induced (leftmost smaller substrings sorted recursively, then both scans), permuted common prefixes
   are computed, and every window that shares its whole length with a neighbour in order is covered.
3. Contexts of an anchor under which more than HOT different ones meet (a line or phrase that a large part of all documents has) never
   meet in a task: their windows, by the anchor's place in them, are halved again and again. Of each range of windows the units
   that all have in common are counted by digest (who is alone with them shares no window) and all units together (who isn't alone with them
   shares every window); only those between go on, so at most as many rounds as a range can be halved.

A window starts at one place of one context only, so nothing is ever compared with itself. Contexts are told apart by 128 bits (an anchor's hash and
a digest), rows by their place in the files; shards compare bytes, and words by 64-bit hashes.

Defined results: null text counts as empty; matches never cross documents; texts shorter than a window stay whole; of rows that come
twice every byte of a text of a window or more goes, in each of them; null doc_ids are documents like others; extra columns are
dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, identity, located, looked_up, made, per_chunk, release, shared_folder, written
from millrace.llm.shingles import _SPACE, mix
from millrace.llm.suffix import permuted_prefixes, suffix_array

#: Bytes that are removed together, and bytes of their anchors; words of a passage ("over fifty"), and of their anchors.
LENGTH, GRAM = 400, 128
WORDS, WORD_GRAM = 51, 12
#: Halvings of a context's range of windows before a suffix array is made of what can share a window at all.
LEVELS = 5
#: Different contexts of an anchor above which it is hot (two or three megabytes of text).
HOT = 5_000
#: Bytes of text hashed at once: so much that the arrays stay in a processor's cache.
HASH_BYTES = 1 << 19
#: Bytes of contexts that are halved together, and bytes of what is left of them for a suffix array.
HALVED_BYTES, SHARD_BYTES = 1 << 19, 1 << 19
BASE = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
BYTE_KIND, WORD_KIND = 0, 1


class Sizes(NamedTuple):
    """A window's and a gram's units, by kind."""

    length: tuple[int, int] = (LENGTH, WORDS)
    gram: tuple[int, int] = (GRAM, WORD_GRAM)


class Words(NamedTuple):
    """Words of joined texts: hash, first byte, end, and number of the text."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0 to n, and their inverses, modulo 2 ** 64."""
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Sums:
    """Running sums of values times powers: the hash of any stretch is a difference of two, brought to a common power and mixed."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(1 << max(20, (len(values) - 1).bit_length()))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Hash of the size values from each place on."""
        value = self.sums[size:] - self.sums[:-size]
        value *= self.down[: len(value)]
        return mix(value)


def words_of(data: np.ndarray, sizes: np.ndarray, sums: Sums) -> Words:
    """The words of texts of these sizes that are joined without a gap."""
    n = len(data)
    ends = np.cumsum(sizes)
    border = np.zeros(n + 1, bool)
    border[ends] = border[0] = True
    gap = _SPACE[data]
    word = ~gap
    begin = np.flatnonzero(word & (border[:-1] | np.concatenate([[True], gap[:-1]])))
    end = np.flatnonzero(word & (border[1:] | np.concatenate([gap[1:], [True]]))) + 1
    return Words(sums.of(begin, end), begin, end, np.searchsorted(ends, begin, "right"))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each stretch of width values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored(grams: np.ndarray, kind: int) -> np.ndarray:
    """Grams' hashes as anchors: the lowest bit tells the kind."""
    return (grams & ~np.uint64(1) | np.uint64(kind)).view(np.int64)


def contexts(sums: Sums, owner: np.ndarray, length: int, gram: int, kind: int) -> tuple[np.ndarray, ...]:
    """text number, anchor, digest, first and last unit of each context (the last is the last window's last)."""
    n = len(owner)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = sums.grams(gram)
    order = grams >> np.uint64(33) << np.uint64(32)
    order |= np.arange(len(order), dtype=np.uint64)
    anchor = (least_in_windows(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    places = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
    if not len(places):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    a, o = anchor[places], owner[places]
    first = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (o[1:] != o[:-1])) + 1])
    last = np.append(first[1:], len(places)) - 1
    low, high = places[first], places[last] + length - 1
    return o[first], anchored(grams[a[first]], kind), sums.of(low, high + 1).view(np.int64), low, high


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, file and row (the row's identity) and the text in bytes."""
    docs, place = located(docs)
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(place), text)


def all_contexts(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """anchor, digest, file, row, low, high (bytes of the text) of every context in the documents, of both kinds."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text")
        data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        sums = Sums(_TABLE[data])
        o, anchor, digest, low, high = contexts(sums, np.repeat(np.arange(len(lengths)), lengths), sizes.length[0], sizes.gram[0], BYTE_KIND)
        words = words_of(data, lengths, sums)
        wo, wanchor, wdigest, wlow, whigh = contexts(Sums(words.hashes), words.owner, sizes.length[1], sizes.gram[1], WORD_KIND)
        owner = np.concatenate([o, wo])
        lows, highs = np.concatenate([low, words.begin[wlow]]) - begins[owner], np.concatenate([high + 1, words.end[whigh]]) - begins[owner]
        place = {c: batch.column(c).to_numpy()[owner] for c in ("file", "row")}
        return {"anchor": np.concatenate([anchor, wanchor]), "digest": np.concatenate([digest, wdigest]), **place, "low": lows, "high": highs}

    return per_chunk(rows, work, "anchor long, digest long, file long, row long, low long, high long", limit=HASH_BYTES)


def repeated_windows(units: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that come twice or more in joined strings of these sizes."""
    n, k = len(units), len(sizes)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(k), sizes)
    code = np.cumsum(np.bincount(units, minlength=256) > 0)[units] - 1 if units.dtype == np.uint8 else np.unique(units, return_inverse=True)[1]
    # the values of the units from 2 on, the separator 1 behind each string, and one 0 at the end
    coded = np.ones(n + k + 1, np.int64)
    coded[np.arange(n) + owner] = code + 2
    coded[-1] = 0
    sa = suffix_array(coded)
    _, shared = permuted_prefixes(coded, sa, length)
    window = np.zeros(n + k + 1, bool)
    starts = np.flatnonzero(np.arange(n) + length <= ends[owner]) if n else np.zeros(0, np.int64)
    window[starts + owner[starts]] = True
    # a run of the array in which each shares a window's length with the one before holds copies of one window
    long = shared[sa] >= length
    run = np.cumsum(~long) - 1
    counts = np.bincount(run, window[sa].astype(np.float64))
    found = np.zeros(n + k + 1, bool)
    found[sa] = window[sa] & (counts[run] > 1)
    return starts[found[starts + owner[starts]]]


def joined(strings: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings' units one after the other, each string's number of them, and the units' first and last byte in their string."""
    data, lengths = np.frombuffer(b"".join(strings), np.uint8), np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.cumsum(lengths) - lengths
    if kind == BYTE_KIND:
        inside = np.arange(len(data)) - np.repeat(begins, lengths)
        return data, lengths, inside, inside + 1
    words = words_of(data, lengths, Sums(_TABLE[data]))
    return words.hashes, np.bincount(words.owner, minlength=len(strings)), words.begin - begins[words.owner], words.end - begins[words.owner]


def stretches(starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted window starts as runs of neighbours within a string: string, first and last unit."""
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    if not len(starts):
        return owner, starts, starts
    cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(owner) > 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(starts) - 1]])
    return owner[first], starts[first], starts[last] + length - 1


def shareable(sums: Sums, counts: np.ndarray, anchors: np.ndarray, length: int, gram: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of the strings (contexts with their anchors' hashes, at least one unit each) whose windows another string of the same anchor can have:
    string, first unit, end. A range of windows, by the units between their start and the anchor, is halved LEVELS times; what all windows of
    a range have in common must be in another string too."""
    ends = np.cumsum(counts)
    begins = ends - counts
    grams = anchored(sums.grams(gram), kind)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(grams)]
    places = np.flatnonzero(grams == anchors[owner])
    at = np.full(len(counts), len(grams), np.int64)
    np.minimum.at(at, owner[places], places)  # the leftmost: no window of the context reaches another one before it
    most = length - gram
    least, top = np.maximum(0, at - (ends - length)), np.minimum(most, at - begins)
    string = np.flatnonzero(least <= top)
    low, high = np.zeros(len(string), np.int64), np.full(len(string), most)
    _, group = np.unique(anchors, return_inverse=True)
    for _ in range(LEVELS):
        middle = (low + high) // 2
        string, low, high = np.concatenate([string, string]), np.concatenate([low, middle + 1]), np.concatenate([middle, high])
        there = (low <= high) & (low <= top[string]) & (high >= least[string])
        string, low, high = string[there], low[there], high[there]
        digest = mix(sums.of(at[string] - low, at[string] - high + length) + mix(group[string].astype(np.uint64) << np.uint64(16) | low.astype(np.uint64)))
        _, index, n = np.unique(digest, return_inverse=True, return_counts=True)
        common = n[index] > 1
        string, low, high = string[common], low[common], high[common]
    low, high = np.maximum(low, least[string]), np.minimum(high, top[string])
    order = np.lexsort((low, string))
    string, low, high = string[order], low[order], high[order]
    if not len(string):
        return string, low, high
    new = np.concatenate([[True], (string[1:] != string[:-1]) | (low[1:] > high[:-1] + 1)])
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(string)) - 1
    return string[first], at[string[first]] - high[last], at[string[first]] - low[first] + length


COVERED = "word boolean, file long, row long, low long, high long"


def shard_windows(strings: DataFrame, sizes: Sizes) -> DataFrame:
    """Step 2. Input: anchor, alone, file, row, low, bytes; output: word, file, row, low, high (bytes) of covered stretches in contexts that are alone."""
    schema = pa.schema([("word", pa.bool_()), *[(c, pa.int64()) for c in ("file", "row", "low", "high")]])

    def run(batches):
        contexts_, size, kind = [], 0, BYTE_KIND  # whole anchors' contexts, of one kind
        held, left = [], 0  # what they can share, for the next suffix array
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "alone", "file", "row", "low", "bytes")), strict=True):
                if contexts_ and (size >= HALVED_BYTES and contexts_[-1][0] != row[0] or kind != row[0] & 1):
                    some = parts(contexts_, kind)
                    held, left = held + some, left + sum(len(x[4]) for x in some)
                    contexts_, size = [], 0
                    if held and (left >= SHARD_BYTES or kind != row[0] & 1):
                        yield shard(held, kind)
                        held, left = [], 0
                kind = row[0] & 1
                contexts_.append(row)
                size += len(row[5])
        if held := held + parts(contexts_, kind):
            yield shard(held, kind)

    def parts(rows: list[tuple], kind: int) -> list[tuple]:
        """alone, file, row, low, bytes of what the contexts can share."""
        if not rows:
            return []
        units, counts, begin, end = joined([r[5] for r in rows], kind)
        of, first, last = shareable(Sums(_TABLE[units] if kind == BYTE_KIND else units), counts, np.array([r[0] for r in rows]), sizes.length[kind], sizes.gram[kind], kind)
        return [(*rows[k][1:4], rows[k][4] + a, rows[k][5][a:b]) for k, a, b in zip(of.tolist(), begin[first].tolist(), end[last - 1].tolist(), strict=True)]

    def shard(held: list[tuple], kind: int) -> pa.RecordBatch:
        units, counts, begin, end = joined([r[4] for r in held], kind)
        of, first, last = stretches(repeated_windows(units, counts, sizes.length[kind]), counts, sizes.length[kind])
        alone, file, row, low = (np.array([r[k] for r in held]) for k in range(4))
        keep = alone[of]
        of, first, last = of[keep], first[keep], last[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(of), bool(kind))), pa.array(file[of]), pa.array(row[of]), pa.array(low[of] + begin[first]), pa.array(low[of] + end[last])], schema=schema)

    return strings.repartition("anchor").sortWithinPartitions(F.col("anchor").bitwiseAND(1), "anchor").mapInArrow(run, COVERED)


def halved_windows(strings: DataFrame, sizes: Sizes) -> DataFrame:
    """Step 3. Input and output as for shard_windows. from_ and to are a range of windows, by the units between their start and the anchor."""
    most = max(w - g for w, g in zip(sizes.length, sizes.gram, strict=True))
    table = strings.select("*", F.lit(0).alias("from_"), F.lit(most).alias("to"))
    done = None
    schema = "file long, row long, low long, alone boolean, anchor long, from_ int, to int, inner long, whole long, first long, last long, bytes binary"

    def digests(batch: pa.RecordBatch) -> dict:
        out = defaultdict(list)
        for r in batch.to_pylist():
            kind = r["anchor"] & 1
            length, gram = sizes.length[kind], sizes.gram[kind]
            units, _, begin, end = joined([r["bytes"]], kind)
            sums = Sums(_TABLE[units] if kind == BYTE_KIND else units)
            at = int(np.flatnonzero(anchored(sums.grams(gram), kind) == r["anchor"])[0])  # the leftmost: no window of the context reaches another before it
            low, high = max(r["from_"], at - (len(units) - length)), min(r["to"], at, length - gram)
            if low > high:
                continue
            raw = units.tobytes()
            wide = units.itemsize
            inner = raw[(at - r["from_"]) * wide : (at - min(r["to"], length - gram) + length) * wide]  # of all the range's windows, be they in this context or not
            whole = raw[(at - high) * wide : (at - low + length) * wide]
            name = f"{r['anchor']} {r['from_']} {r['to']} ".encode()
            out["inner"].append(xxhash.xxh3_64_intdigest(name + inner) - (1 << 63))
            out["whole"].append(xxhash.xxh3_64_intdigest(name + f"{low} {high} ".encode() + whole) - (1 << 63))
            out["first"].append(int(begin[at - high]))
            out["last"].append(int(end[at - low + length - 1]))
            for c in ("file", "row", "low", "alone", "anchor", "from_", "to", "bytes"):
                out[c].append(r[c])
        return {c.split()[0]: out[c.split()[0]] for c in schema.split(", ")}

    while not table.isEmpty():
        both = written(per_chunk(table, digests, schema, "bytes", limit=HASH_BYTES))
        shared = written(both.groupBy("anchor", "inner").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        equal = written(both.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("m"), F.lit(True).alias("equal")).filter("m > 1"))
        some = looked_up(both, shared, ["anchor", "inner"], "n", ["file", "row", "low"], "inner").drop("n")
        left = written(looked_up(some, equal, ["anchor", "whole"], "m", ["file", "row", "low"]).drop("m"))
        covered = left.filter("equal and alone").select(F.col("anchor").bitwiseAND(1).cast("boolean").alias("word"), "file", "row", (F.col("low") + F.col("first")).alias("low"), (F.col("low") + F.col("last")).alias("high"))
        done = covered if done is None else done.unionByName(covered)
        middle = F.floor((F.col("from_") + F.col("to")) / 2).cast("int")
        halves = F.array(F.struct(F.col("from_").alias("f"), middle.alias("t")), F.struct((middle + 1).alias("f"), F.col("to").alias("t")))
        some = left.filter("equal is null and from_ < to").withColumn("half", F.explode(halves))
        table = written(some.select("anchor", "alone", "file", "row", "low", "bytes", F.col("half.f").alias("from_"), F.col("half.t").alias("to")))
    return done if done is not None else strings.sparkSession.createDataFrame([], COVERED)


def union_of(found: list[tuple[int, int]], text: bytes | None = None) -> list[tuple[int, int]]:
    """Stretches that meet as one; with a text, also those with nothing but white space between."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if out and (low <= out[-1][1] or text is not None and not text[out[-1][1] : low].strip()):
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What stays of a text."""
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of what goes), kept (the bytes that stay) and passages (start and end of maximal stretches of words that
    lie in strings of so many words which also start elsewhere) of every document."""
    spark, rows, sizes = docs.sparkSession, keyed(docs), Sizes((length, words), (gram, word_gram))
    before = made()

    def step(df: DataFrame, *wanted: str) -> tuple[DataFrame, str]:
        """The table written, and its folder; of the tables made before only those wanted stay, and shuffle files of steps that are done go."""
        folder = shared_folder(spark)
        df = written(df, folder)
        discard(spark, [f for f in made() if f not in (*before, *wanted, folder)])
        release(spark)
        return df, folder

    table, table_at = step(all_contexts(rows, sizes))
    one = [F.first(c).alias(c) for c in ("file", "row", "low", "high")]  # all four of one row
    counts, counts_at = step(table.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), *one), table_at)
    by_anchor = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), F.min("n").alias("least"))
    unsure, unsure_at = step(by_anchor.filter("different > 1 and least = 1").select("anchor", "different", (F.col("different") > HOT).alias("hot")), table_at, counts_at)
    twice = counts.filter("n > 1").select("anchor", "digest", "n")
    whole, whole_at = step(looked_up(table, twice, ["anchor", "digest"], "n", ["file", "row", "low"], "inner").select(F.col("anchor").bitwiseAND(1).cast("boolean").alias("word"), "file", "row", "low", "high"), counts_at, unsure_at)
    wanted = looked_up(counts, unsure, ["anchor"], "different", ["file", "row", "low"], "inner").select("anchor", "hot", (F.col("n") == 1).alias("alone"), "file", "row", "low", "high")
    per_text, _ = step(wanted.groupBy("file", "row").agg(F.collect_list(F.struct("anchor", "hot", "alone", "low", "high")).alias("wanted")), unsure_at, whole_at)

    def bytes_of(batch: pa.RecordBatch) -> dict:
        out = defaultdict(list)
        for file, row, text, some in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "text", "wanted")), strict=True):
            for x in some:
                for c, v in (("anchor", x["anchor"]), ("hot", x["hot"]), ("alone", x["alone"]), ("file", file), ("row", row), ("low", x["low"]), ("bytes", text[x["low"] : x["high"]])):
                    out[c].append(v)
        return {c: out[c] for c in ("anchor", "hot", "alone", "file", "row", "low", "bytes")}

    fetched = rows.join(per_text.hint("merge"), ["file", "row"]).select("file", "row", "text", "wanted")
    strings = per_chunk(fetched, bytes_of, "anchor long, hot boolean, alone boolean, file long, row long, low long, bytes binary")
    if unsure.filter("hot").isEmpty():
        alone, _ = step(shard_windows(strings, sizes), whole_at)
    else:
        strings, _ = step(strings, whole_at)
        alone, _ = step(shard_windows(strings.filter("not hot"), sizes).unionByName(halved_windows(strings.filter("hot").drop("hot"), sizes)), whole_at)
    covered, _ = step(whole.unionByName(alone).groupBy("file", "row").agg(F.collect_list(F.struct("word", "low", "high")).alias("covered")))

    def cut(batch: pa.RecordBatch) -> dict:
        raw = batch.column("text").to_pylist()
        out: dict[str, list] = {"spans": [], "kept": [], "passages": []}
        for text, found in zip(raw, batch.column("covered").to_pylist(), strict=True):
            spans = union_of([(x["low"], x["high"]) for x in found or () if not x["word"]])
            again = union_of([(x["low"], x["high"]) for x in found or () if x["word"]], text)
            out["kept"].append(cut_out(text, spans))
            for name, some in (("spans", spans), ("passages", again)):
                out[name].append([{"start": a, "end": b} for a, b in some])
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in raw], **out}

    both = rows.join(covered.hint("merge"), ["file", "row"], "left").select("doc_id", "text", "covered")
    return per_chunk(both, cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, passages array<struct<start: long, end: long>>")
