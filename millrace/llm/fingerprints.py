"""Operator 2: document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (lines, and of long lines stretches that end where the words themselves say so) are hashed, repeats numbered,
and each digest goes to one cell in each of HASHES parts of a sketch; a cell holds a count, the digests' XOR and their check
sums' XOR. Two versions' sketches subtract cell by cell; cells with one digest left are peeled until none is, which gives
the digests that only one version has. If some stay, both are sketched again twice as large, and so on until the peeling
ends (after TRIES doublings the exact difference is taken). Likeness is the share of paragraphs in common:
(paragraphs of both) / (paragraphs of either).

Each text's first sketch is its fingerprint (in base64): those of any two versions subtract and peel without their texts
(sketch_differences), unless they differ in too many paragraphs. Likeness is taken from them, and from larger sketches where they are too small.

All pairs of a batch are sketched and peeled at once: each pair has its own stretch of one array of cells.

Defined results: null text counts as empty; two empty texts have likeness 1, an empty and another one 0; documents follow each other by
doc_id (null first), then by text; after the last comes the first, so a single document follows itself; rows that come twice
follow each other; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import texts
from millrace.llm.shingles import _POWERS, mix

HASHES = 3
#: Cells of the sketch that is kept, and of the first try of a subtraction.
CELLS = 24
#: A paragraph ends with its line, after a word whose hash is a multiple of WORDS, and after MOST_WORDS words.
WORDS, MOST_WORDS = 8, 16
#: Doublings after which the exact difference is taken.
TRIES = 16
#: Stretches of ids to a partition, so that partitions come out even.
STRETCHES = 4
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
CHECK = np.uint64(0x27D4EB2F165667C5)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def paragraphs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of each text and where each text's begin; a paragraph that comes again gets another digest."""
    n = len(raw)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, n) + 1
    place = np.arange(len(data))
    gap = _SPACE[data]
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.cumsum(np.bincount(begins, minlength=len(data))) - 1
    inside = place - begins[np.maximum(at, 0)]
    values = np.where(gap, np.uint64(0), mix((data.astype(np.uint64) + np.uint64(1)) * _POWERS[inside & 1023] + (inside >> 10).astype(np.uint64)))
    words = mix(np.add.reduceat(values, begins))
    owner = np.repeat(np.arange(n), sizes)[begins]
    line = np.cumsum(data == 10)[begins]
    ends = words % np.uint64(WORDS) == 0
    ends[:-1] |= line[1:] != line[:-1]
    ends[-1] = True
    heads = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
    order = np.arange(len(words)) - np.repeat(heads, np.diff(np.append(heads, len(words))))
    heads = np.flatnonzero(order % MOST_WORDS == 0)
    order %= MOST_WORDS
    found, of = mix(np.add.reduceat(mix(words + (order.astype(np.uint64) + np.uint64(1)) * SEEDS[0]), heads)), owner[heads]
    by = np.lexsort((found, of))
    same = np.zeros(len(by), bool)
    same[1:] = (found[by][1:] == found[by][:-1]) & (of[by][1:] == of[by][:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    again = np.empty(len(by), np.int64)
    again[by] = np.arange(len(by)) - first
    return mix(found + again.astype(np.uint64) * SEEDS[1]), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def cells_of(digests: np.ndarray, base: np.ndarray, part: np.ndarray) -> np.ndarray:
    """HASHES cells of each digest: one in each part of a sketch that begins at base."""
    return np.stack([base + k * part + (mix(digests ^ SEEDS[k]) % part.astype(np.uint64)).astype(np.int64) for k in range(HASHES)])


def xor_into(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    np.bitwise_xor.at(out, at, values)


def sketch(digests: np.ndarray, starts: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest XORs and check XORs: one row of cells for each text."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    part = np.full(len(digests), cells // HASHES)
    at = cells_of(digests, owner * cells, part).ravel()
    count, keys, checks = np.bincount(at, minlength=n * cells), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    xor_into(keys, at, np.tile(digests, HASHES))
    xor_into(checks, at, np.tile(mix(digests ^ CHECK), HASHES))
    return count.reshape(n, cells), keys.reshape(n, cells), checks.reshape(n, cells)


def peeled(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, where: np.ndarray, base: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of what subtracted cells give, and for each pair whether some stay. where: each cell's pair; the cells are changed."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    look = np.flatnonzero((count == 1) | (count == -1))
    while len(look):
        pure = look[((count[look] == 1) | (count[look] == -1)) & (mix(keys[look] ^ CHECK) == checks[look])]
        if not len(pure):
            break
        _, first = np.unique(np.stack([where[pure].astype(np.uint64), keys[pure]]), axis=1, return_index=True)
        pure = pure[first]
        digest, of, signs = keys[pure], where[pure], count[pure]
        found.append((of, digest, signs))
        at = cells_of(digest, base[of], part[of]).ravel()
        np.subtract.at(count, at, np.tile(signs, HASHES))
        xor_into(keys, at, np.tile(digest, HASHES))
        xor_into(checks, at, np.tile(mix(digest ^ CHECK), HASHES))
        look = np.unique(at)
    of, digest, signs = (np.concatenate(x) for x in zip(*found, strict=True))
    return of, digest, signs, np.bincount(where, (count != 0) | (keys != 0), len(base)) > 0


def sketches(digests: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Each text's sketch whole: the counts, keys and checks of its CELLS cells as little-endian 64-bit numbers."""
    return [row.tobytes() for row in np.concatenate([x.astype("<u8") for x in sketch(digests, starts)], axis=1)]


def fingerprint_of(kept: bytes) -> str:
    """A kept sketch as text, from which sketch_of() gives it back."""
    return base64.b64encode(kept).decode()


def sketch_of(fingerprint: str) -> bytes:
    return base64.b64decode(fingerprint)


def sketch_differences(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) from two lists of kept sketches alone, and the pairs for which they are too small: those need differences() of the texts."""
    n = len(a)
    one, two = (np.frombuffer(b"".join(x), "<u8").reshape(n, 3, CELLS).astype(np.uint64) for x in (a, b))
    count = (one[:, 0].astype(np.int64) - two[:, 0].astype(np.int64)).ravel()
    keys, checks = ((one[:, k] ^ two[:, k]).ravel() for k in (1, 2))
    of, digest, signs, rest = peeled(count, keys, checks, np.repeat(np.arange(n), CELLS), np.arange(n) * CELLS, np.full(n, CELLS // HASHES))
    return of[~rest[of]], digest[~rest[of]], signs[~rest[of]], np.flatnonzero(rest)


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS, tries: int = TRIES, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digests that only one text of a pair has: (pair, digest, 1 if the first has it, else -1), as three arrays. left: numbers of the pairs to look at."""
    n = len(a[1]) - 1
    recovered = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    left = np.arange(n) if left is None else left
    width = np.full(n, cells, np.int64)
    for _ in range(tries):
        if not len(left):
            break
        own = []
        for digests, starts in (a, b):
            sizes = np.diff(starts)[left]
            ends = np.cumsum(sizes)
            index = np.arange(ends[-1]) + np.repeat(starts[left] - (ends - sizes), sizes)
            own.append((digests[index], np.repeat(np.arange(len(left)), sizes)))
        digests, pair = np.concatenate([own[0][0], own[1][0]]), np.concatenate([own[0][1], own[1][1]])
        sign = np.concatenate([np.ones(len(own[0][0]), np.int64), -np.ones(len(own[1][0]), np.int64)])
        size = width[left]
        base, part = np.cumsum(size) - size, size // HASHES
        where = np.repeat(np.arange(len(left)), size)
        total = int(size.sum())
        at = cells_of(digests, base[pair], part[pair]).ravel()
        count = np.bincount(at, np.tile(sign, HASHES), total).astype(np.int64)
        keys, checks = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
        xor_into(keys, at, np.tile(digests, HASHES))
        xor_into(checks, at, np.tile(mix(digests ^ CHECK), HASHES))
        of, digest, signs, rest = peeled(count, keys, checks, where, base, part)
        recovered.append((left[of[~rest[of]]], digest[~rest[of]], signs[~rest[of]]))
        left = left[rest]
        width[left] *= 2
    for k in left:  # exact, should peeling never end
        x, y = (set(d[s[k] : s[k + 1]].tolist()) for d, s in (a, b))
        for some, sign in ((x - y, 1), (y - x, -1)):
            recovered.append((np.full(len(some), k), np.array(sorted(some), np.uint64), np.full(len(some), sign)))
    of, digest, signs = (np.concatenate(x) for x in zip(*recovered, strict=True))
    return of, digest, signs


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], one: list[bytes] | None = None, two: list[bytes] | None = None) -> np.ndarray:
    """Paragraphs of both over paragraphs of either, for each pair: from the kept sketches one and two, which are subtracted and peeled, and, for pairs that
    they are too small for, from sketches of the paragraphs a and b that are twice as large, and so on."""
    one, two = one or sketches(*a), two or sketches(*b)
    of, _, signs, left = sketch_differences(one, two)
    if len(left):
        more, _, more_signs = differences(a, b, 2 * CELLS, TRIES - 1, left)
        of, signs = np.concatenate([of, more]), np.concatenate([signs, more_signs])
    n = np.frombuffer(b"".join(one), "<u8").reshape(-1, 3 * CELLS)[:, :CELLS].sum(1).astype(np.int64) // HASHES  # paragraphs, by the sketch's counts
    first, second = np.bincount(of, signs > 0, len(n)), np.bincount(of, signs < 0, len(n))
    either = n + second
    return np.where(either > 0, (n - first) / np.maximum(either, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the next document's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def prefix(text: Column) -> Column:
    """The first seven bytes of a text as a number: it never falls where texts rise."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def cuts_below(cuts: list[tuple[int, int, int]], key: Column) -> Column:
    """How many of the sorted cuts (flag, id, prefix) aren't above a key, looked up in two steps."""
    literal = lambda some: F.array(*[F.struct(F.lit(f).alias("flag"), F.lit(i).cast("long").alias("id"), F.lit(p).cast("long").alias("prefix")) for f, i, p in some])
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    block = F.size(F.filter(literal(cuts[::step]), lambda c: c <= key))
    inside = F.size(F.filter(F.slice(literal(cuts), F.greatest(block - 1, F.lit(0)) * step + 1, step), lambda c: c <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents in stretches of rising doc_id, then text: stretch, seen, doc_id, text.

    Stretch k holds the rows from the k-th cut up to the next one, and also, marked seen, the rows that come next after its own: those
    at the next cut, or, in the last stretch, the first of all. Cuts lie at doc_ids, and for a doc_id (or null) that fills stretches of
    its own also at the beginnings of its texts, so that no id's rows meet in one task. Rows move once; only the cuts, a fixed multiple
    of the partitions, are on the driver.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = parts * STRETCHES
    rows = texts(docs)
    shares = [k / stretches for k in range(1, stretches)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10_000).alias("cuts"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named")).first()
    cuts = found["cuts"] or []
    nulls = found["n"] - found["named"]
    fills = {(1, c): cuts.count(c) for c in set(cuts)} | {(0, 0): nulls * stretches // max(found["n"], 1)}
    hot = {key: m for key, m in fills.items() if m > 1}  # as many as there are stretches at most
    flag, known = F.col("doc_id").isNotNull().cast("int"), F.coalesce("doc_id", F.lit(0))
    is_hot = F.lit(False)
    if hot:
        ids = [i for f, i in hot if f]
        is_hot = F.coalesce(F.col("doc_id").isin(ids), F.lit(False)) if ids else F.lit(False)
        is_hot = is_hot | F.col("doc_id").isNull() if (0, 0) in hot else is_hot
    key = F.struct(flag.alias("flag"), known.alias("id"), F.when(is_hot, prefix(F.col("text"))).otherwise(F.lit(-1).cast("long")).alias("prefix"))
    places = {(f, i, -1) for f, i in fills if f and (f, i) not in hot}
    if hot:
        inside = rows.filter(is_hot).groupBy(flag.alias("flag"), known.alias("id")).agg(F.percentile_approx(prefix(F.col("text")), shares, 10_000).alias("at"))
        for r in inside.collect():  # a row for each hot id
            places |= {(r["flag"], r["id"], p) for p in (0, *r["at"][:: max(1, stretches // hot[r["flag"], r["id"]])])}
    # quantiles are approximate, of large numbers too: the cuts are the first keys that there are from them on
    rough = cuts_below(sorted(places), key)
    firsts = sorted(tuple(r["first"]) for r in rows.groupBy(rough.alias("stretch")).agg(F.min(key).alias("first")).collect())  # a row for each stretch
    head, cuts = (firsts[0], firsts[1:]) if firsts else ((0, 0, -1), [])
    stretch = cuts_below(cuts, key)
    equal = lambda c: key == F.struct(F.lit(c[0]).alias("flag"), F.lit(c[1]).cast("long").alias("id"), F.lit(c[2]).cast("long").alias("prefix"))
    own = F.struct(stretch.alias("stretch"), F.lit(0).alias("seen"))
    places = F.array(own)
    if cuts:
        at_cut = stretch > cuts_below(cuts, F.struct(key["flag"].alias("flag"), key["id"].alias("id"), (key["prefix"] - 1).alias("prefix")))
        places = F.when(at_cut, F.array(own, F.struct((stretch - 1).alias("stretch"), F.lit(1).alias("seen")))).otherwise(places)
    places = F.when(equal(head), F.array(own, F.struct(F.lit(len(cuts)).alias("stretch"), F.lit(2).alias("seen")))).otherwise(places)
    dealt = rows.withColumn("at", F.explode(places)).select("at.stretch", "at.seen", "doc_id", "text")
    return dealt.repartition(parts, "stretch").sortWithinPartitions("stretch", "seen", F.col("doc_id").asc_nulls_first(), "text")


def fingerprint(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next, sketch, edited_sketch of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("sketch", pa.binary()), ("edited_sketch", pa.binary())])
    limit = 2 << 20

    def work(ids: list, own: list[str], after: list[str]) -> pa.RecordBatch:
        new = [edited(t, f) for t, f in zip(own, after, strict=True)]
        one, two, three = (paragraphs([t.encode() for t in x]) for x in (own, new, after))
        kept = [sketches(*x) for x in (one, two, three)]
        prints = [list(map(fingerprint_of, x)) for x in kept[:2]]
        values = [ids, list(map(len, own)), new, *prints, likeness(one, two, *kept[:2]), likeness(one, three, kept[0], kept[2]), *kept[:2]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches):
        out: tuple[list, list, list] = ([], [], [])
        size, last = 0, None  # the row before: stretch, doc_id, text, that still waits for the next one
        for batch in batches:
            for stretch, seen, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("stretch", "seen", "doc_id", "text")), strict=True):
                if last is not None and last[0] == stretch:
                    for column, v in zip(out, (last[1], last[2], text), strict=True):
                        column.append(v)
                    size += len(last[2]) + len(text)
                    last = None
                if not seen:
                    last = (stretch, doc_id, text)
                if size > limit:
                    yield work(*out)
                    out, size = ([], [], []), 0
        if out[0]:
            yield work(*out)

    return neighbours(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sketch binary, edited_sketch binary")
