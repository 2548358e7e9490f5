"""The global distinct-word shuffle: split texts, answer each distinct word once, bring the answers back by position.

Exploding every word of every text into a row of its own would move many times the input. So words and
positions travel packed, in blocks of documents:

1. Split: a task cuts its documents into blocks (closed at ``most_words`` words). A block has the distinct words it
   uses, most frequent first and dealt into buckets by their hash, and each document's words as ranks in that list, a
   byte each for the 255 most frequent ones. Blocks are stored in buckets, so nothing depends on a second evaluation.
2. Answer: the word lists are shuffled by bucket and every distinct word is answered once in its bucket. However
   frequent a word is, it comes once a block.
3. Reassemble: the answers are shuffled by block, meet the block's positions where these are stored, and the documents come out.

The number of buckets is the session's number of shuffle partitions, so a bucket's share of the vocabulary is as large as
any partition; a task holds the words of one partition and one block. A text of more than ``most_words`` words is a block alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import spans, stored_by

#: A splitter turns a text into its words; an answerer turns words (in any order) into one tuple of numbers each.
Splitter = Callable[[str], list[str]]
Answerer = Callable[[list[str]], list[list[int]]]

_BLOCKS = "block string, keys array<{kind}>, lengths array<bigint>, places binary, owners binary, bucket int, words binary"
_NAMES = ["block", "keys", "lengths", "places", "owners", "bucket", "words"]
_ESCAPE = 255


def pack_places(ranks: np.ndarray) -> bytes:
    """Ranks as one byte each, and those from 255 on also as byte planes, compressed."""
    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    far = (ranks[ranks >= _ESCAPE] - _ESCAPE).astype(np.uint32)
    planes = far.view(np.uint8).reshape(-1, 4).T
    return press.compress(np.minimum(ranks, _ESCAPE).astype(np.uint8).tobytes() + planes.tobytes())


def unpack_places(data: bytes, total: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = raw[:total].astype(np.uint32)
    planes = raw[total:].reshape(4, -1)
    out[out == _ESCAPE] += np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)
    return out


def pack_words(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    head = np.array([len(data), *map(len, data)], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(head + b"".join(data))


def unpack_words(data: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)
    out, begin = [], 4 * (n + 1)
    for end in ends.tolist():
        out.append(raw[begin:end].decode())
        begin = end
    return out


def by_bucket(owners: np.ndarray) -> np.ndarray:
    """Ranks in the order in which the buckets have them: by bucket, then by rank."""
    return np.argsort(owners, kind="stable")


class _Places(dict):
    """Word -> position, in order of first use."""

    def __missing__(self, word):
        self[word] = place = len(self)
        return place


def split_blocks(docs: DataFrame, key: str, text: str, splitter: Callable[[], Splitter], most_words: int = 2_000_000) -> DataFrame:
    """The stored blocks: a row with the documents' words as ranks, and a row for each bucket of distinct words."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType
    plain_key = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, part, number = splitter(), TaskContext.get().partitionId(), 0
        places, keys, found, size = _Places(), [], [], 0

        def block() -> pa.RecordBatch:
            """One row for the documents, and one for each bucket."""
            flat = np.concatenate(found)
            frequent = np.argsort(-np.bincount(flat, minlength=len(places)), kind="stable")
            rank = np.empty(len(places), np.uint32)
            rank[frequent] = np.arange(len(places), dtype=np.uint32)
            words = list(places)
            words = [words[i] for i in frequent.tolist()]
            owners = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.uint32, len(words))
            order = by_bucket(owners)
            edges = np.flatnonzero(np.diff(owners[order].astype(np.int64), prepend=-1)).tolist()
            runs = [order[a:b].tolist() for a, b in zip(edges, [*edges[1:], len(words)])]
            n = len(runs)
            press = zstandard.ZstdCompressor(level=3, write_content_size=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}"] * (n + 1)),
                    pa.array([pa.concat_arrays(keys).to_pylist(), *[None] * n], pa.list_(keys[0].type)),
                    pa.array([[len(f) for f in found], *[None] * n], pa.list_(pa.int64())),
                    pa.array([pack_places(rank[flat]), *[None] * n], pa.binary()),
                    pa.array([press.compress(owners.tobytes()), *[None] * n], pa.binary()),
                    pa.array([None, *[int(owners[run[0]]) for run in runs]], pa.int32()),
                    pa.array([None, *[pack_words([words[i] for i in run]) for run in runs]], pa.binary()),
                ],
                names=_NAMES,
            )

        for batch in batches:
            for i, value in enumerate(batch["text"]):
                words = words_of(value.as_py() or "")
                keys.append(batch["key"][i : i + 1])
                found.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                size += len(words)
                if size >= most_words:
                    yield block()
                    places, keys, found, size, number = _Places(), [], [], 0, number + 1
        if keys:
            yield block()

    schema = T.StructType.fromDDL(_BLOCKS.format(kind=kind.simpleString()))
    return stored_by(plain_key.mapInArrow(split, schema), "word-blocks", "block", buckets, compression="zstd")


def answered(blocks: DataFrame, answerer: Callable[[], Answerer]) -> DataFrame:
    """``block`` and its ``answers``: for each of its buckets the numbers of its words, in their order. The numbers of a word are computed
    once, in the bucket that the word belongs to."""
    lists = blocks.filter(F.col("bucket").isNotNull()).select("bucket", "block", "words")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, np.ndarray]] = []
        places = _Places()
        for batch in batches:
            for bucket, block, packed in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist(), batch["words"]):
                words = unpack_words(packed.as_py())
                rows.append((block, bucket, np.fromiter(map(places.__getitem__, words), np.int64, len(words))))
        if not rows:
            return
        numbers = answerer()(list(places))
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.fromiter((v for one in numbers for v in one), np.uint32, int(sizes.sum()))
        del numbers, places
        starts = np.cumsum(sizes) - sizes
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for begin in range(0, len(rows), 64):
            some = rows[begin : begin + 64]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in some], pa.string()),
                    pa.array([r[1] for r in some], pa.int32()),
                    pa.array([press.compress(sizes[r[2]].astype(np.uint32).tobytes()) for r in some], pa.binary()),
                    pa.array([press.compress(_planes(flat[spans(starts[r[2]], sizes[r[2]])])) for r in some], pa.binary()),
                ],
                names=["block", "bucket", "sizes", "numbers"],
            )

    rows = lists.repartition("bucket").mapInArrow(answer, "block string, bucket int, sizes binary, numbers binary")
    # At most one entry a bucket and block.
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "sizes", "numbers"))).alias("answers"))


def _planes(numbers: np.ndarray) -> bytes:
    return numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _slices(lengths: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int, int]]:
    """Runs of documents with about ``most`` words together: first, end, words."""
    ends = np.cumsum(lengths)
    begin, done = 0, 0
    while begin < len(lengths):
        end = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield begin, end, int(ends[end - 1] - done)
        done, begin = int(ends[end - 1]), end


def reassembled(blocks: DataFrame, answers: DataFrame, key_type: T.DataType) -> DataFrame:
    """``key``, ``n_words`` and ``values``: the answers of a document's words, in their order."""
    joined = (
        blocks.filter(F.col("bucket").isNull())
        .select("block", "keys", "lengths", "places", "owners")
        .join(answers, "block", "left")
        .select("keys", "lengths", "places", "owners", "answers")
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                keys = batch["keys"][row].values
                lengths = batch["lengths"][row].values.to_numpy()
                places = unpack_places(batch["places"][row].as_py(), int(lengths.sum()))
                order = by_bucket(np.frombuffer(plain(batch["owners"][row].as_py()), np.uint32))
                runs = batch["answers"][row].as_py() or []
                dealt = np.concatenate([np.frombuffer(plain(r["sizes"]), np.uint32) for r in runs] or [np.zeros(0)]).astype(np.int64)
                values = np.concatenate([_unplanes(plain(r["numbers"])) for r in runs] or [np.zeros(0, np.uint32)])
                if len(dealt) != len(order):
                    raise ValueError("a block has lost answers")
                sizes, starts = np.empty_like(dealt), np.empty_like(dealt)
                sizes[order] = dealt
                starts[order] = np.cumsum(dealt) - dealt
                at = 0
                for begin, end, stop in _slices(lengths):
                    here = places[at : at + stop]
                    at += stop
                    own = sizes[here]
                    edges = np.concatenate([[0], np.cumsum(lengths[begin:end])])
                    through = np.concatenate([[0], np.cumsum(own)])[edges]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys[begin:end],
                            pa.array(lengths[begin:end]),
                            pa.ListArray.from_arrays(pa.array(through.astype(np.int32)), pa.array(values[spans(starts[here], own)].view(np.int32))),
                        ],
                        names=["key", "n_words", "values"],
                    )

    schema = T.StructType(
        [T.StructField("key", key_type), T.StructField("n_words", T.LongType()), T.StructField("values", T.ArrayType(T.IntegerType()))]
    )
    return joined.mapInArrow(assemble, schema)
