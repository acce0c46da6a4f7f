"""Operator 11: phrases of words that stand together more often than their parts would, from suffix automata of shards of the text.

1. Texts are cut to words as bytes, in windows of bounded size, and every phrase of up to five words is counted in one of a number of cells by its hash (tasks send on cells and counts; their
   sums are no smaller than any phrase's count in them). The cells that reach the least count are one bit each.
2. In a second reading, a place's context reaches back as far as all phrases in it lie in such cells. Each shard (what a task has gathered, of bounded size)
   builds a generalised suffix automaton of these contexts; its states give every substring of at most five words with the number of its ends.
3. Counts are added up over all shards by phrase, and those below the least count go: the others are exact, as no phrase of theirs was cut off before. A shard sends its phrases as one block for each
   bucket of phrases, and buckets are folded block by block.
4. Each phrase takes its lowest score over all cuts. Subsumption goes along suffix links: the phrase that a longer one links to (without its first word), and its mirror (without its last word),
   are dropped when the longer one is as frequent. One word more is enough to look at, as counts of phrases in between lie between.

The cells grow with the text up to MOST_BITS (128 MB when packed, the bound of what is broadcast); beyond that they fill, less is cut off early, and more goes through the
shuffle of step 3, with the same results. A frequent phrase or word is added up in its task before it moves. Ranks are taken in salted groups first.

Defined results: a null text has no words and a null lang is `und`; repeated rows count each; a language without candidates gives no rows; ties of score and count go by the
phrase's bytes; an empty table gives no rows; extra columns are dropped. Words are told apart by 64-bit hashes of their bytes and language inside a shard, by their bytes after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.automaton import build
from millrace.llm.common import chunks, spread, written

#: Production parameters: words of a phrase, its least count, the share of it at which a longer phrase takes its place, rows of a language.
LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Bytes that end a piece, and that end a word.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of one step, words of one automaton, cells of one step of counting.
WINDOW, SHARD, CELLS = 1 << 20, 1 << 21, 1 << 23
#: Phrases that a bucket gathers before it adds them up.
FOLD = 1 << 20
#: Phrases of so many words are counted in cells; bytes of text for each cell; bits of a cell's number at least and most; cells of one row.
ORDERS, BYTES_A_CELL, LEAST_BITS, MOST_BITS, SLICE = 5, 16, 16, 30, 1 << 16
#: Frequent phrases are broadcast up to this many; beyond, they are joined by shuffles.
BROADCAST_ROWS = 250_000

KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(ENDS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value on all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and its inverse, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (BASE, INVERSE))
        return self.up[:n], self.down


class Words:
    """The words of a stretch of bytes: where they start and end, their hashes, the number of their piece and of their document; the first `seen` were in the stretch before."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, langs: np.ndarray, powers: Powers) -> None:
        n = len(data)
        kind = KIND[data]
        word = kind == 0
        fresh = np.zeros(n + 1, bool)
        fresh[edges] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | fresh[1:n]
        last[:-1] &= ~word[1:] | fresh[1:n]
        self.data, self.start, self.end, self.seen = data, np.flatnonzero(first), np.flatnonzero(last) + 1, 0
        up, down = powers.to(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        self.document = np.searchsorted(edges, self.start, side="right") - 1
        self.hash = mixed(mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64)) + langs[self.document])
        self.piece = np.cumsum((kind == 2) | fresh[:n])[self.start]

    def phrases(self, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, .. words: the hashes of the phrases that end at each word, and whether there is one in its piece."""
        out, value, whole = [], self.hash, np.ones(len(self.hash), bool)
        for order in range(min(ORDERS, longest)):
            if order:
                value = np.concatenate([value[:1], mixed(value[:-1] * np.uint64(2 * order + 1) + self.hash[1:])])
                whole = np.concatenate([np.zeros(min(order, len(whole)), bool), self.piece[order:] == self.piece[:-order]])
            out.append((value, whole))
        return out


def windows(part: pa.RecordBatch, powers: Powers, longest: int) -> Iterator[tuple[Words, np.ndarray]]:
    """The words of a slice of documents (text, lang), a window at a time, each with the last words of the one before; and the documents' languages."""
    text = part.column("text").cast(pa.large_binary())
    lang = np.array(part.column("lang").to_pylist(), object)
    codes = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lang], np.uint64)
    edges = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    if edges[-1] == edges[0]:
        return
    data = LOWER[np.frombuffer(text.buffers()[2], np.uint8)[edges[0] : edges[-1]]]
    edges = edges - edges[0]
    low = begin = 0
    while low < len(data):
        high = low + WINDOW
        while high < len(data):
            gaps = np.flatnonzero(KIND[data[low:high]])
            if len(gaps):
                high = low + int(gaps[-1]) + 1
                break
            high += WINDOW  # one word of more than a window
        high = min(high, len(data))
        inside = np.clip(edges[:-1] - begin, 0, high - begin)
        words = Words(data[begin:high], inside, codes, powers)
        words.seen = int(np.searchsorted(words.start, low - begin))
        yield words, lang
        keep = max(len(words.start) - (longest - 1), 0)
        begin, low = (begin + int(words.start[keep]) if len(words.start) > keep else high), high


def counted_cells(docs: DataFrame, bits: int, longest: int) -> DataFrame:
    """slice, cells (16-bit numbers in it) and counts (32 bits): how often phrases fall into cells, added up for some CELLS of them at a time."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        heads = np.flatnonzero(np.diff((cells // SLICE).astype(np.int64), prepend=-1))
        parts = [(int(cells[a]) // SLICE, (cells[a:b] % SLICE).astype(np.uint16).tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(heads, np.append(heads[1:], len(cells)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "cells", "counts"])

    def run(batches):
        powers, held, size = Powers(), [], 0
        for batch in batches:
            for part in chunks(batch, "text", WINDOW):
                for words, _ in windows(part, powers, longest):
                    for value, whole in words.phrases(longest):
                        held.append((value >> np.uint64(64 - bits))[words.seen :][whole[words.seen :]].astype(np.uint32))
                        size += len(held[-1])
                    if size >= CELLS:
                        yield rows(held)
                        held, size = [], 0
        if size:
            yield rows(held)

    return docs.mapInArrow(run, "slice int, cells binary, counts binary")


def full_cells(cells: DataFrame, bits: int, least: int, parts: int) -> np.ndarray:
    """One bit for each cell that reaches the least count, packed."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, where, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "cells", "counts")), strict=True):
                held = sums.setdefault(k, np.zeros(SLICE, np.uint32))
                at = np.frombuffer(where, np.uint16)
                held[at] = np.minimum(held[at] + np.frombuffer(counts, np.uint32), 1 << 30)
        packed = [np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for x in cells.repartition(parts, "slice").mapInArrow(run, "slice int, bits binary").toLocalIterator():  # 8 KB for each of at most 2^(MOST_BITS - 16) slices
        out[x["slice"] * SLICE // 8 : (x["slice"] + 1) * SLICE // 8] = np.frombuffer(x["bits"], np.uint8)
    return out


def reach(words: Words, full: np.ndarray, bits: int, longest: int) -> np.ndarray:
    """How many words back, itself among them, each word's context may be frequent; 0 where the word itself can't be."""
    cap = np.full(len(words.hash), longest, np.int64)
    for order, (value, whole) in reversed(list(enumerate(words.phrases(longest)))):
        cell = value >> np.uint64(64 - bits)
        hit = full[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1
        cap[~whole | (hit == 0)] = order
    at = np.arange(len(cap))
    return np.minimum.accumulate(cap - at) + at


class Shard:
    """What is gathered for one automaton: words with their counts, and the contexts of more than a word."""

    def __init__(self) -> None:
        self.words: dict[int, list] = {}  # hash -> language, text, count
        self.totals: dict[str, int] = {}  # words of each language
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def count(self, words: Words, lang: np.ndarray) -> None:
        held = np.bincount(words.document[words.seen :], minlength=len(lang))
        for k in np.flatnonzero(held):
            self.totals[lang[k]] = self.totals.get(lang[k], 0) + int(held[k])

    def add(self, words: Words, far: np.ndarray, lang: np.ndarray) -> None:
        wide = far > 1
        wide[:-1] |= wide[1:]  # a context begins at the word before
        used = np.flatnonzero((far >= 1) | wide)
        hashes, first, inverse = np.unique(words.hash[used], return_index=True, return_inverse=True)
        counts = np.bincount(inverse, weights=used >= words.seen, minlength=len(hashes)).astype(np.int64)
        for h, k, n in zip(hashes.tolist(), used[first].tolist(), counts.tolist(), strict=True):
            if h in self.words:
                self.words[h][2] += n
            else:
                self.words[h] = [lang[words.document[k]], words.data[words.start[k] : words.end[k]].tobytes().decode("utf-8", "replace"), n]
        far = np.minimum(far, 127).astype(np.int8)
        far[: words.seen] = 0  # the words before lend context, and end nothing here
        self.parts.append((words.hash[wide], far[wide]))
        self.size += int(wide.sum()) + len(hashes) // 16

    def phrases(self, longest: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """lang, n_words, phrase and n of every word and context, with a hash of each phrase's words."""
        total = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.totals]
        yield batch_of(list(self.totals), 0, [""] * len(total), list(self.totals.values())), np.array(total, np.uint64)
        one = {h: x for h, x in self.words.items() if x[2]}
        yield batch_of([x[0] for x in one.values()], 1, [x[1] for x in one.values()], [x[2] for x in one.values()]), np.fromiter(one, np.uint64, len(one))
        hashes, far = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, t)]) for k, t in ((0, np.uint64), (1, np.int8)))
        self.parts.clear()
        distinct, tokens = np.unique(hashes, return_inverse=True)
        names = [self.words[h] for h in distinct.tolist()]
        found = build(tokens, far, longest)
        for length in range(2, longest + 1):
            ends, counts = found.substrings(length)
            for low in range(0, len(ends), 1 << 16):
                some = tokens[ends[low : low + (1 << 16), None] + np.arange(1 - length, 1)]
                key = np.zeros(len(some), np.uint64)
                for k in range(length):
                    key = mixed(key + distinct[some[:, k]])
                rows = some.tolist()
                yield batch_of([names[row[0]][0] for row in rows], length, [" ".join([names[t][1] for t in row]) for row in rows], counts[low : low + (1 << 16)]), key

    def blocks(self, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """What goes to the reduction: one block for each bucket of phrases that the shard has, as compressed Arrow data."""
        if not self.totals:
            return
        found = list(self.phrases(longest))
        rows = pa.Table.from_batches([b for b, _ in found]).combine_chunks()
        bucket = np.concatenate([k for _, k in found]) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows.take(pa.array(order)), bucket[order].astype(np.int64)
        heads = np.flatnonzero(np.diff(bucket, prepend=-1))
        for low, high in zip(heads, np.append(heads[1:], len(bucket)), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(low, high - low))
            yield block_of(int(bucket[low]), sink.getvalue().to_pybytes())


def batch_of(langs: list[str], length: int, texts: list[str], counts) -> pa.RecordBatch:
    out = [pa.array(langs, pa.string()), pa.array(np.full(len(langs), length, np.int8)), pa.array(texts, pa.string()), pa.array(np.asarray(counts, np.int64))]
    return pa.RecordBatch.from_arrays(out, names=["lang", "n_words", "phrase", "n"])


def block_of(bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "block"])


def added(blocks: DataFrame, least: int) -> DataFrame:
    """The phrases of all blocks with their counts added up, those with the least count alone (and the numbers of all words). A bucket is folded as it comes; what is held are its different phrases."""

    def folded(held: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(held).group_by(["lang", "n_words", "phrase"], use_threads=False).aggregate([("n", "sum")])
        return found.rename_columns([c.removesuffix("_sum") for c in found.column_names]).select(["lang", "n_words", "phrase", "n"])

    def finished(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        found = folded(held)
        keep = pc.or_(pc.greater_equal(found.column("n"), least), pc.equal(found.column("n_words"), 0))
        yield from found.filter(keep).to_batches(max_chunksize=1 << 14)

    def run(batches):
        held, now, size, kept = [], None, 0, 0
        for batch in batches:
            for k, data in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
                if k != now and held:
                    yield from finished(held)
                    held, size, kept = [], 0, 0
                now = k
                held.append(pa.ipc.open_stream(data.as_buffer()).read_all())
                size += len(held[-1])
                if size - kept > max(FOLD, kept):
                    held = [folded(held)]
                    size = kept = len(held[0])
        if held:
            yield from finished(held)

    return blocks.mapInArrow(run, "lang string, n_words tinyint, phrase string, n long")


def shard_blocks(docs: DataFrame, full: np.ndarray, bits: int, longest: int, buckets: int) -> DataFrame:
    """bucket and block of every shard's phrases; phrases of n_words 0 tell the number of all words of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(full)  # 2^MOST_BITS bits at most

    def run(batches):
        powers, shard = Powers(), Shard()
        for batch in batches:
            for part in chunks(batch, "text", WINDOW):
                for words, lang in windows(part, powers, longest):
                    shard.count(words, lang)
                    shard.add(words, reach(words, shared.value, bits, longest), lang)
                    if shard.size >= SHARD:
                        yield from shard.blocks(longest, buckets)
                        shard = Shard()
        yield from shard.blocks(longest, buckets)

    return docs.mapInArrow(run, "bucket int, block binary")


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int | None = None) -> DataFrame:
    """lang, n_words, phrase and n of every phrase of at most longest words with the least count; n_words 0: all words of a language."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    if bits is None:
        total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        bits = min(max((total // BYTES_A_CELL).bit_length(), LEAST_BITS), MOST_BITS)
    full = full_cells(counted_cells(docs, bits, longest), bits, least, parts)
    blocks = shard_blocks(docs, full, bits, longest, parts)
    return written(added(blocks.repartition(parts, "bucket").sortWithinPartitions("bucket"), least))


def looked_up(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in exact decimals: counts of up to 15 digits."""
    a, n, left, right = (c.cast("decimal(17,0)") for c in (a, n, left, right))
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), left * right)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, bits: int | None = None) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score."""
    table = frequent(docs, longest, least, bits)
    small = table.count() <= BROADCAST_ROWS
    counts = table.filter("n_words > 0")
    words = F.split("phrase", " ")
    wide = counts.filter("n_words > 1").select("lang", "phrase", "n_words", F.col("n").alias("a"), words.alias("words"))
    # the longer phrases' suffix links and their mirrors
    inner = wide.filter("n_words > 2").select("lang", "a", F.explode(F.array(F.expr("slice(words, 2, n_words - 1)"), F.expr("slice(words, 1, n_words - 1)"))).alias("words"))
    longer = inner.select("lang", F.array_join("words", " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = wide.join(looked_up(longer, small), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.expr("slice(words, 1, k)"), " ")).withColumn("right", F.array_join(F.expr("slice(words, k + 1, n_words - k)"), " ")).drop("words")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(looked_up(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), small), ["lang", side])
    cuts = cuts.join(looked_up(table.filter("n_words = 0").select("lang", "n"), small), "lang")
    scored = cuts.withColumn("score", score(*(F.col(c) for c in ("a", "n", "l", "r"))))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    rows = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = rows.withColumn("salt", spread("phrase", parts=64)).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = salted.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
