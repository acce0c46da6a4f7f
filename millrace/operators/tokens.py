"""Character vocabulary with byte fallback, encoding, prompts with masked labels."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vocab


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """token, id: the distinct characters in code-point order, after control tokens and bytes. Never more rows than Unicode has."""
    found = df.select(F.explode(F.array_distinct(characters(F.col(text)))).alias("token")).distinct()
    return found.select("token", (F.row_number().over(Window.orderBy("token")) + (vocab.FIRST_CHARACTER - 1)).alias("id"))


def known_characters(vocabulary_df: DataFrame) -> list[str]:
    """The vocabulary on the driver, in the order of ids (bounded by Unicode)."""
    return [r["token"] for r in vocabulary_df.orderBy("id").collect()]


def unknown_part(text: Column, known: Sequence[str]) -> Column:
    """The characters of a text that the vocabulary lacks."""
    return F.translate(text, "".join(known), "") if known else text


def encoded_length(text: Column, known: Sequence[str]) -> Column:
    """Tokens of a text: one for a known character, one for each byte of any other."""
    rest = unknown_part(text, known)
    return (F.char_length(text) - F.char_length(rest) + F.octet_length(rest)).cast("bigint")


def encode(text: Column, known: Sequence[str], byte_fallback: bool = True) -> Column:
    """ids of a text; an unknown character becomes its bytes' ids, or <unk>. A vectorised function: a character's id is looked up by its code point."""
    points = np.array([ord(c) for c in known], np.int64)
    table = np.full(int(points.max(initial=-1)) + 2, -1, np.int32)  # its last place is that of all points beyond
    table[points] = vocab.FIRST_CHARACTER + np.arange(len(points))

    def one(t: str | None) -> np.ndarray | None:
        if t is None:
            return None
        ids = table[np.minimum(np.frombuffer(t.encode("utf-32-le"), "<u4"), len(table) - 1)]
        unknown = ids < 0
        if not unknown.any():
            return ids
        if not byte_fallback:
            return np.where(unknown, np.int32(vocab.CONTROL_TOKENS.index("<unk>")), ids)
        others = [t[k].encode() for k in np.flatnonzero(unknown)]
        sizes = np.ones(len(ids), np.int64)
        sizes[unknown] = [len(x) for x in others]
        out = np.repeat(ids, sizes)
        out[np.repeat(unknown, sizes)] = np.frombuffer(b"".join(others), np.uint8).astype(np.int32) + vocab.FIRST_BYTE
        return out

    @F.pandas_udf("array<int>")
    def ids_of(column: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in column], dtype=object)

    return ids_of(text)


def decode(known: Sequence[str], skip_special: bool = False):
    """A vectorised function from ids to text; an id out of range or bytes that aren't UTF-8 are errors."""
    known, special = list(known), vocab.CONTROL_TOKENS

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        def one(ids) -> str | None:
            if ids is None:
                return None
            out, held = [], bytearray()
            for i in [*ids, None]:
                if i is not None and vocab.FIRST_BYTE <= i < vocab.FIRST_CHARACTER:
                    held.append(i - vocab.FIRST_BYTE)
                    continue
                if held:
                    out.append(held.decode("utf-8"))
                    held.clear()
                if i is None:
                    break
                if not 0 <= i < vocab.FIRST_CHARACTER + len(known):
                    raise ValueError(f"id out of range: {i}")
                if i >= vocab.FIRST_CHARACTER:
                    out.append(known[i - vocab.FIRST_CHARACTER])
                elif not skip_special:
                    out.append(special[i])
            return "".join(out)

        return column.map(one)

    return text_of


def count_of(ids: str, token: str) -> Column:
    """How often a control token's id comes in an array of ids."""
    return F.size(F.filter(ids, lambda i: i == vocab.CONTROL_TOKENS.index(token))).cast("bigint")


def special(token: str) -> Column:
    return F.lit(vocab.CONTROL_TOKENS.index(token))


def prompt_sample(prompt_ids: Column, target_ids: Column, longest: int | None = None) -> Column:
    """A struct (input_ids, labels, target_start): prompt, target and end; labels are masked on the prompt and keep the end.

    A sample over the longest length is an error: it is never cut.
    """
    prompt = F.concat(F.array(special("<bos>"), special("<task_generate>"), special("<input>")), prompt_ids, F.array(special("<target>")))
    target = F.concat(target_ids, F.array(special("<eos>")))
    ids = F.concat(prompt, target)
    if longest is not None:
        ids = F.when(F.size(ids) > longest, F.raise_error(F.concat(F.lit("sample over the longest length: "), F.size(ids).cast("string"))).cast("array<int>")).otherwise(ids)
    return F.struct(ids.alias("input_ids"), F.concat(F.array_repeat(F.lit(vocab.IGNORED_LABEL), F.size(prompt)), target).alias("labels"), F.size(prompt).alias("target_start"))


def padded(df: DataFrame, batch: str, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Pads ids, labels and adds attention_mask, on the right, to each batch's longest row."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    fill = lambda c, value: F.concat(F.col(c), F.array_repeat(F.lit(value), F.col("_longest") - F.size(c)))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_longest") - F.size(ids)))
    return df.withColumn("_longest", longest).withColumn("attention_mask", mask).withColumn(ids, fill(ids, 0)).withColumn(labels, fill(labels, vocab.IGNORED_LABEL)).drop("_longest")


def sentencepiece_tokens(model_file: str):
    """A vectorised function from text to the ids of a local SentencePiece model."""

    @F.pandas_udf("array<int>")
    def ids_of(column: pd.Series) -> pd.Series:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return pd.Series(model.encode(column.fillna("").tolist(), num_threads=1))

    return ids_of


def sentencepiece_text(model_file: str):
    """A vectorised function from ids of a local SentencePiece model back to text; an id that it lacks is an error."""

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return column.map(lambda ids: None if ids is None else model.decode([int(i) for i in ids]))

    return text_of


def sentencepiece_special(model_file: str, token: str) -> int:
    """The id of a control token of a local SentencePiece model; a token that is none is an error."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = model.piece_to_id(token)
    if model.id_to_piece(found) != token or not (model.is_control(found) or model.is_unknown(found)):
        raise KeyError(token)
    return found


@runtime_checkable
class Tokenizer(Protocol):
    """What every tokenizer gives: columns from text to ids and back, and the ids of control tokens."""

    def encode(self, text: Column) -> Column: ...

    def decode(self, ids: Column) -> Column: ...

    def special(self, token: str) -> int: ...


class CharacterTokenizer:
    """Characters of a vocabulary, bytes for what it lacks."""

    def __init__(self, known: Sequence[str]):
        self.known = list(known)

    def encode(self, text: Column) -> Column:
        return encode(text, self.known)

    def decode(self, ids: Column) -> Column:
        return decode(self.known)(ids)

    def special(self, token: str) -> int:
        if token not in vocab.CONTROL_TOKENS:
            raise KeyError(token)
        return vocab.CONTROL_TOKENS.index(token)


class SentencePieceTokenizer:
    """A local SentencePiece model."""

    def __init__(self, model_file: str):
        self.model_file = model_file

    def encode(self, text: Column) -> Column:
        return sentencepiece_tokens(self.model_file)(text)

    def decode(self, ids: Column) -> Column:
        return sentencepiece_text(self.model_file)(ids)

    def special(self, token: str) -> int:
        return sentencepiece_special(self.model_file, token)


def save(vocabulary_df: DataFrame, path: str) -> None:
    vocabulary_df.write.mode("errorifexists").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema("token string, id int").parquet(path)


def vocabulary_hash(vocabulary_df: DataFrame) -> DataFrame:
    """n and sha256 of the tokens in the order of ids, each with a line end (the vocabulary is bounded by Unicode)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("id", "token"))), lambda x: F.concat(x["token"], F.lit("\n")))
    return vocabulary_df.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(ordered, ""), 256).alias("sha256"))
