"""Document fingerprints by order MinHash.

The k-mers are runs of ``K`` words (of bytes, in a short text). Each is numbered by its occurrence in the document, so repeats are different items. Each of
``FUNCTIONS`` hash functions selects the ``PICK`` (two) smallest items; the selected k-mers, in the order of the text, are hashed to one
number of the signature. Two signatures agree in a function only if the same k-mers were selected and stand in the same order, so the share
of equal numbers falls with the edit distance, and moving parts of a text lowers it too.

Numbers of the two kinds of k-mers never meet, so a text below ``BOTH`` bytes has a second signature of the other kind: any two texts have a
kind in common, and ``compared`` takes that.

``edited_report`` compares documents with an edited form that takes its last quarter from the next document. Texts are dealt by
range of their ids and sorted, so the next document is the next row; the first rows of each range are sent to the range before it too.
Whole texts are shuffled once, compressed, and a task holds a few megabytes of them.

Defined cases: a null text is empty; a text without k-mers has the fingerprint of zeros, like another such text and unlike all
others; fewer than ``K`` words make one k-mer of all; ids that repeat share their place, and as next document they stand for one of
their rows, always the same; a null id is one id before all others; a single document is its own next one; an empty table gives an empty result.
Only the key and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.arrays import mix, runs, words
from orderflow.llm.common import pieces, spans, text_array

K, FUNCTIONS, PICK = 3, 32, 2
#: A text below so many bytes has too few words to compare; its k-mers are runs of so many bytes.
SHORT, SHORT_K = 200, 4
#: A text below so many bytes has signatures of both kinds; texts of both sides of ``SHORT`` meet by bytes if both are below, else by words.
BOTH = 2 * SHORT
_PLACE_BITS = 20
#: One odd multiplier for each hash function.
_FACTORS = [int(x) | 1 for x in mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))]


def signatures(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``FUNCTIONS`` 32-bit numbers for each text."""
    return _signed(body, at, np.diff(at) < SHORT)


def second_signatures(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The signatures by the other kind of k-mers of the texts below ``BOTH`` bytes; zeros for the others."""
    out = np.zeros((len(at) - 1, FUNCTIONS), np.uint32)
    size = np.diff(at)
    near = np.flatnonzero(size < BOTH)
    if len(near):
        own = body[spans(at[:-1][near], size[near])]
        out[near] = _signed(own, np.concatenate([[0], np.cumsum(size[near])]), size[near] >= SHORT)
    return out


def _signed(body: np.ndarray, at: np.ndarray, by_bytes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at) - 1, FUNCTIONS), np.uint32)
    size = np.diff(at)
    short = np.flatnonzero(by_bytes)
    if len(short):
        own = body[spans(at[:-1][short], size[short])]
        _fill(out, short, *runs(mix(own.astype(np.uint64) + np.uint64(1)), size[short], SHORT_K))
    other = np.flatnonzero(~by_bytes)
    if len(other):
        hashes, counts = words(body, at, lower=False)
        hashes = hashes[np.repeat(~by_bytes, counts)]
        _fill(out, other, *runs(hashes, counts[other], K))
    return out


def _fill(out: np.ndarray, rows: np.ndarray, items: np.ndarray, found: np.ndarray) -> None:
    starts = np.cumsum(found) - found
    long = found >> _PLACE_BITS > 0
    for i in np.flatnonzero(long):  # a text of over a million k-mers alone, with room for its places
        out[rows[i]] = _select(items[starts[i] : starts[i] + found[i]], found[i : i + 1], 40)[0]
    rest = (found > 0) & ~long
    if rest.any():
        some = items if not long.any() else items[~np.repeat(long, found)]
        out[rows[rest]] = _select(some, found[rest], _PLACE_BITS)


def _select(items: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    low = np.uint64((1 << bits) - 1)
    starts = np.cumsum(counts) - counts
    place = (np.arange(len(items)) - np.repeat(starts, counts)).astype(np.uint64)
    # Equal k-mers of a text come together, in the order of the text: their ranks are the occurrence numbers.
    keys = items & ~low | place
    for a, n in zip(starts.tolist(), counts.tolist()):
        keys[a : a + n].sort()
    opens = np.ones(len(keys), bool)
    opens[1:] = keys[1:] >> np.uint64(bits) != keys[:-1] >> np.uint64(bits)
    opens[starts] = True
    where = np.arange(len(keys))
    rank = where - np.maximum.accumulate(np.where(opens, where, 0))
    occurrence = np.empty(len(keys), np.uint64)
    occurrence[np.repeat(starts, counts) + (keys & low).astype(np.int64)] = rank
    numbered = mix(items + mix(occurrence + np.uint64(1)))
    out = np.empty((len(counts), FUNCTIONS), np.uint32)
    none = np.uint64((1 << 64) - 1)
    for i in range(FUNCTIONS):
        value = numbered * np.uint64(_FACTORS[i])
        value ^= value >> np.uint64(29)
        value &= ~low
        value |= place
        one = np.minimum.reduceat(value, starts)
        a = starts + (one & low).astype(np.int64)
        value[a] = none
        two = np.minimum.reduceat(value, starts)
        single = two == none
        b = np.where(single, a, starts + (two & low).astype(np.int64))
        first, second = items[np.minimum(a, b)], items[np.maximum(a, b)]
        pair = mix(first + mix(np.where(single, np.uint64(0), second) + np.uint64(i + 1)))
        out[:, i] = np.maximum((pair >> np.uint64(32)).astype(np.uint32), 1)
    return out


def of_texts(texts: list[str]) -> np.ndarray:
    body, at = text_array(pa.array(texts, pa.large_string()))
    return signatures(body, at)


def both_of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second signatures, and sizes in bytes."""
    body, at = text_array(pa.array(texts, pa.large_string()))
    return signatures(body, at), second_signatures(body, at), np.diff(at)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def compared(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Likeness row by row by a kind of k-mers that both texts have; ``a`` and ``b`` as of :func:`both_of_texts`."""
    (first, second, size), (first_b, second_b, size_b) = a, b
    across = (size < SHORT) != (size_b < SHORT)
    by_bytes = np.maximum(size, size_b) < BOTH
    # Below SHORT the first signature is the one of bytes, from there on the second.
    own = np.where((across & ((size < SHORT) != by_bytes))[:, None], second, first)
    other = np.where((across & ((size_b < SHORT) != by_bytes))[:, None], second_b, first_b)
    return likeness(own, other)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, fingerprint, second_fingerprint`` (bytes) of each row; the last is null from ``BOTH`` bytes on."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.length(whole).cast("bigint").alias("n_chars"), whole.alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                body, at = text_array(part["text"])
                found, second = signatures(body, at), second_signatures(body, at)
                seconds = [f.tobytes() if n < BOTH else None for f, n in zip(second, np.diff(at))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array([f.tobytes() for f in found], pa.binary()), pa.array(seconds, pa.binary())],
                    names=["key", "n_chars", "fingerprint", "second_fingerprint"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(sign, f"key {kind}, n_chars bigint, fingerprint binary, second_fingerprint binary").withColumnRenamed("key", key)


_OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "second_fingerprint string, edited_second_fingerprint string"
)
_NO_ID = -(1 << 63)  # stands for a null id, before all others


def in_order(docs: DataFrame) -> DataFrame:
    """``part, last, key, packed``: the texts in order of their ids, each range of ids in a partition of its own. The rows of a range's first
    id come once more at the end of the range before it (``last``), those of the smallest id at the end of the last range, so every
    partition holds the successor of each of its rows. The driver holds one id for each partition."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    least, cuts = texts.agg(F.min("key"), F.percentile_approx("key", shares, 100 * ranges)).first()
    firsts = np.unique(np.array([least, *(cuts or [])] if least is not None else [0], np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            key = batch["key"].to_numpy()
            part = np.searchsorted(firsts, key, side="right") - 1
            again = np.flatnonzero(firsts[part] == key)
            packed = pa.array([press.compress(t.as_py().encode()) for t in batch["text"]], pa.binary())
            for rows, where, last in ((np.arange(len(key)), part, False), (again, (part[again] - 1) % len(firsts), True)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(where.astype(np.int32)),
                        pa.array(np.full(len(rows), last)),
                        pa.array(key[rows]),
                        batch["digest"].take(pa.array(rows)),
                        packed.take(pa.array(rows)),
                    ],
                    names=["part", "last", "key", "digest", "packed"],
                )

    dealt = texts.withColumn("digest", F.xxhash64("text")).mapInArrow(deal, "part int, last boolean, key bigint, digest bigint, packed binary")
    # Texts travel once, compressed one by one.
    return dealt.repartitionById(len(firsts), "part").sortWithinPartitions("last", "key", "digest").drop("digest")


def edited_report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    second_fingerprint, edited_second_fingerprint``; the last two are null from ``BOTH`` bytes on."""
    return in_order(docs).mapInArrow(_walk, _OUT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each text with the first text of the next id, in order, some megabytes at a time."""
    plain = zstandard.ZstdDecompressor().decompress
    waiting: list[tuple[int, str]] = []
    ready: list[tuple[int, str, str]] = []
    size, ended = 0, False
    for batch in batches:
        for i in range(0 if not ended else batch.num_rows, batch.num_rows):
            key, last = batch["key"][i].as_py(), batch["last"][i].as_py()
            text = plain(batch["packed"][i].as_py()).decode()
            if waiting and (last or waiting[-1][0] != key):
                ready += [(k, t, text) for k, t in waiting]
                size += sum(len(t) for _, t in waiting)
                waiting = []
            if last:  # only the first of these rows is anyone's successor
                ended = True
                break
            waiting.append((key, text))
            if size >= 1 << 20:
                yield _report(ready)
                ready, size = [], 0
    if ready:
        yield _report(ready)


def _report(ready: list[tuple[int, str, str]]) -> pa.RecordBatch:
    places: dict[int, int] = {}  # a successor is mostly the next row's own text
    texts: list[str] = []
    for _, text, following in ready:
        for one in (text, following):
            if id(one) not in places:
                places[id(one)] = len(texts)
                texts.append(one)
    cuts = [len(text) // 4 for _, text, _ in ready]
    edited = [text[: len(text) - cut] + following[:cut] for (_, text, following), cut in zip(ready, cuts)]
    found = both_of_texts(texts)
    own, nexts = (tuple(part[[places[id(row[i])] for row in ready]] for part in found) for i in (1, 2))
    changed = both_of_texts(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if key == _NO_ID else key for key, _, _ in ready], pa.int64()),
            pa.array([len(text) for _, text, _ in ready], pa.int64()),
            pa.array([hashlib.sha256(text.encode()).hexdigest() for text in edited]),
            pa.array([row.tobytes().hex() for row in own[0]]),
            pa.array([row.tobytes().hex() for row in changed[0]]),
            pa.array(compared(own, changed)),
            pa.array(compared(own, nexts)),
            *(pa.array([row.tobytes().hex() if n < BOTH else None for row, n in zip(x[1], x[2])], pa.string()) for x in (own, changed)),
        ],
        names=[f.split()[0] for f in _OUT.split(", ")],
    )
