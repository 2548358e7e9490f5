"""Byte-level BPE encoding and decoding through the global distinct-word shuffle.

Texts are split by the tokenizer's pattern; each distinct pre-token is encoded once (see ``words``) and its ids come back by position.
Decoding looks up the bytes of each id in the token table. The table of ranks is a file of fixed size, read on the driver and
sent along; its path is a parameter.

The pattern's classes of letters and numbers are those of the tokenizer library. The splitting library knows newer Unicode
characters; texts that hold one of them are split by a pattern that leaves these out.

Defined cases: a null text is empty and has no ids; repeated rows and ids give a row each; texts of any length are encoded
whole; an empty table gives an empty result. Only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.words import answered, reassembled, split_blocks


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@cache
def newer_characters() -> str:
    """Characters that the splitting library takes for letters or numbers and the tokenizer library does not."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = []
    for kind in (r"\p{L}", r"\p{N}"):
        plain = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = set(bytes(plain.encode_ordinary(every)).decode())
        out += [c for c in regex.findall(kind, every) if c not in theirs]
    return "".join(out)


def split_with(pattern: str, newer: str) -> Callable[[str], list[str]]:
    """Splits like the tokenizer library: ``newer`` characters are neither letters nor numbers."""
    usual = regex.compile(pattern)
    if not newer:
        return usual.findall
    points = sorted(map(ord, newer))
    ranges, first = [], points[0]
    for a, b in zip(points, [*points[1:], -1]):
        if b != a + 1:
            ranges.append(f"\\U{first:08x}-\\U{a:08x}")
            first = b
    some = "[" + "".join(ranges) + "]"
    without = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:{some}|[^\s\p{{L}}\p{{N}}])")
    for kind in (r"\p{L}", r"\p{N}"):
        without = without.replace(f" ?{kind}+", f" ?(?:(?!{some}){kind})+")
    careful, lowest, holds = regex.compile(without), chr(points[0]), regex.compile(some)

    def split(text: str) -> list[str]:
        if not text.isascii() and max(text) >= lowest and holds.search(text):
            return careful.findall(text)
        return usual.findall(text)

    return split


def encoded(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, values``: pre-tokens and ids of each text."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file: fixed size
    newer = newer_characters()

    def answerer():
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        return lambda words: [own._encode_single_piece(w) for w in words]

    blocks = split_blocks(docs, key, text, lambda: split_with(pattern, newer))
    return reassembled(blocks, answered(blocks, answerer), docs.schema[key].dataType)


def decoded(ids: DataFrame, ranks_path: str, column: str = "values", out: str = "decoded") -> DataFrame:
    """``ids`` with the bytes of its arrays of ids."""
    table = token_table(read_ranks(ranks_path))
    held = ids.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*ids.schema.fields, T.StructField(out, T.BinaryType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = held.value.__getitem__
        for batch in batches:
            # Row by row: a batch of ids as objects would take many times its size.
            texts = [None if not v.is_valid else b"".join(map(token, v.values.to_numpy().tolist())) for v in batch[column]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return ids.mapInArrow(look_up, schema)


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    both = decoded(encoded(docs, ranks_path, pattern), ranks_path)
    return both.select(
        F.col("key").alias("doc_id"),
        F.size("values").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("values").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
