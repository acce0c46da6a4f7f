"""Operator 9: byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

Long texts are cut before encoding where no match of the pattern can reach across: before white space that follows
something else. Every match then lies in one part, and no match looks at what is before its part, or, at a part's end
(which isn't white space), at what comes after; so the parts' ids joined are the whole text's ids.

Defined results: null and empty texts have no ids and decode to nothing; rows that come twice are encoded twice; a null
doc_id stays null; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import per_chunk, texts

#: Characters after which the next safe boundary is taken.
PART_CHARS = 1 << 16
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
_LOADED: dict = {}


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens; once for a worker."""
    import tiktoken

    if (rank_file, pattern) not in _LOADED:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[rank_file, pattern]


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text cut at safe boundaries, each part of size characters or up to the first boundary after them."""
    out, low = [], 0
    while len(text) - low > size and (m := _BOUNDARY.search(text, low + size)):
        out.append(text[low : m.start()])
        low = m.start()
    return [*out, text[low:]]


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each whole text."""

    def work(batch: pa.RecordBatch) -> dict:
        tokens = encoding(rank_file, pattern)
        ids = [b"".join(np.asarray(tokens.encode_ordinary(p), "<u4").tobytes() for p in parts(t)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": ids}

    return per_chunk(texts(docs), work, "doc_id long, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded: the raw bytes of the ids (which need not be whole characters)."""

    def work(batch: pa.RecordBatch) -> dict:
        tokens = encoding(rank_file, pattern)
        out = [tokens.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": out}

    return per_chunk(encoded.select("doc_id", "ids"), work, "doc_id long, ids binary, decoded binary", "ids")
