"""Vectors compressed to one small index a part, against codebooks that are learned in whole numbers.

Components become whole numbers, vectors are cut into equal consecutive parts, and every part position has a codebook. Nearest entries are
found among Walsh-Hadamard coefficients: parts and entries are padded with zeros to a power of two and transformed by additions alone, which
multiplies every squared distance by that power. Squared differences are added up in order of sequency (sign changes), where most of the
energy comes first, and an entry is dropped as soon as its sum exceeds the whole distance of the best entry so far. Sums are 64-bit whole
numbers, so nothing is rounded and ties are real ties.

Each round is one pass over the rows: a task adds up its parts by entry, so what is shuffled and brought to the driver has the size of the
codebooks and not of the table. Codebooks travel to the tasks with the function (parts x entries x part length numbers).

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; all others stay, those with repeated or null
ids too. Shorter vectors are filled with zeros to the longest, and all to a multiple of the number of parts; an empty vector is all zeros.
Codebooks start from the smallest ids (nulls last, ties by the vectors); with fewer rows there are fewer entries. Rows with equal labels
share ``label_error``, rows without label too. Whole numbers are held within +-2^24. An empty table gives an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import stored
from orderflow.llm.integers import int_matrix, integer_vectors


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform along the last axis (a power of two long), in natural order."""
    shape, size, half = x.shape, x.shape[-1], 1
    while half < size:
        pairs = x.reshape(*shape[:-1], size // (2 * half), 2, half)
        x = np.concatenate([pairs[..., :1, :] + pairs[..., 1:, :], pairs[..., :1, :] - pairs[..., 1:, :]], axis=-2)
        half *= 2
    return x.reshape(shape)


def by_sequency(size: int) -> np.ndarray:
    """Places of the natural order by the number of sign changes of their rows."""
    return np.argsort((np.diff(hadamard(np.eye(size, dtype=np.int64))) != 0).sum(1), kind="stable")


def spectrum(parts: np.ndarray) -> np.ndarray:
    size = 1 << (parts.shape[-1] - 1).bit_length()
    padded = np.zeros((*parts.shape[:-1], size), np.int64)
    padded[..., : parts.shape[-1]] = parts
    return hadamard(padded)[..., by_sequency(size)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of coefficients the entry with the least squared distance (the first of equal ones), and that distance."""
    size = x.shape[1]
    total = (x[:, :1] - entries[:, 0]) ** 2
    bound = ((x - entries[total.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(total <= bound[:, None])
    total = total[row, entry]
    for place in range(1, size):
        if place > 1 and place & (place - 1) == 0:
            # The bound is renewed from what is best by now, after 2, 4, 8 ... coefficients.
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            lead = np.flatnonzero(total == np.minimum.reduceat(total, starts)[row])
            lead = lead[np.unique(row[lead], return_index=True)[1]]
            bound = np.minimum(bound, ((x - entries[entry[lead]]) ** 2).sum(1))
        total = total + (x[row, place] - entries[entry, place]) ** 2
        stays = total <= bound[row]
        row, entry, total = row[stays], entry[stays], total[stays]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, starts)
    first = np.flatnonzero(total == least[row])
    first = first[np.unique(row[first], return_index=True)[1]]
    return entry[first], least // size


def _assign(ints: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances of all parts of the rows; ``book`` has (part, entry, place)."""
    parts = ints.reshape(len(ints), book.shape[0], book.shape[2])
    x, entries = spectrum(parts), spectrum(book)
    found = [nearest(x[:, p], entries[p]) for p in range(len(book))]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def learn(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Codebooks (part, entry, place) of ``rows`` (``vec_id, ints``); none for an empty table."""
    longest = rows.agg(F.max(F.size("ints"))).first()[0]
    if longest is None:
        return None
    length = max(1, -(-longest // parts))
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    book = np.zeros((len(seeds), parts * length), np.int64)
    for place, seed in enumerate(seeds):
        book[place, : len(seed.ints)] = seed.ints
    book = book.reshape(len(seeds), parts, length).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.select("ints").mapInArrow(_sums(book), "part int, entry int, place int, total bigint, n bigint")
        wide = F.col("total").cast("decimal(38,0)")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum(wide).alias("total"), F.sum("n").alias("n")).collect():
            book[r.part, r.entry, r.place] = int(r.total) // r.n
    return book


def _sums(book: np.ndarray):
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum of the parts of each entry that has any in this task."""
        total = np.zeros(book.shape, np.int64)
        count = np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = int_matrix(batch["ints"], book.shape[0] * book.shape[2])
            index, _ = _assign(ints, book)
            cut = ints.reshape(len(ints), book.shape[0], book.shape[2])
            for p in range(len(book)):
                np.add.at(total[p], index[:, p], cut[:, p])
                count[p] += np.bincount(index[:, p], minlength=book.shape[1])
        part, entry, place = np.nonzero(np.broadcast_to(count[:, :, None], book.shape))
        arrays = [pa.array(a, pa.int32()) for a in (part, entry, place)]
        arrays += [pa.array(total[part, entry, place]), pa.array(count[part, entry])]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "place", "total", "n"])

    return add_up


def encode(rows: DataFrame, book: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` for ``rows`` (``vec_id, label, ints``)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, error = _assign(int_matrix(batch["ints"], book.shape[0] * book.shape[2]), book)
                texts = pa.array([line.tobytes().hex() for line in index.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["label"], texts, pa.array(error.sum(1))], names=["vec_id", "label", "code", "error"]
                )

    return rows.select("vec_id", "label", "ints").mapInArrow(code, "vec_id bigint, label bigint, code string, error bigint")


def compress(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of ``table`` (``vec_id, embedding, label``); at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    slim = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    rows = stored(integer_vectors(slim), "code-rows")
    book = learn(rows, parts, entries, rounds)
    if book is None:
        return table.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = stored(encode(rows, book), "codes")
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return coded.join(errors, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


_KEPT = """kept as (
    select vec_id, label, embedding from embeddings
    where embedding is not null
    and not exists (select 1 from (select unnest(embedding) as x) where x is null or isnan(x) or isinf(x)))"""

_ROUND = """
books{n} as (
    select b.part, b.entry, b.place, coalesce((s - ((s % n) + n) % n) // n, b.x) as x
    from books{m} b left join (
        select part, entry, place, sum(x) as s, count(*) as n from cells join near{m} using (id, part) group by all
    ) using (part, entry, place)),"""

_NEAR = """
near{n} as (
    select id, part, entry, d from (
        select id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) as d
        from cells c join books{n} b on c.part = b.part and c.place = b.place group by all)
    qualify row_number() over (partition by id, part order by d, entry) = 1),"""

COMPRESS_SQL = (
    "with "
    + _KEPT
    + """,
numbered as (select *, row_number() over (order by vec_id nulls last) - 1 as id from kept),
width as (select greatest(1, (max(len(embedding)) + 15) // 16) as p from kept),
cells as (
    select id, i // p as part, i % p as place, cast(floor(256 * coalesce(embedding[i + 1], 0)::double) as bigint) as x
    from numbered, width, range(0, 16 * p) as r(i)),
books0 as (select part, id as entry, place, x from cells where id < 64),"""
    + "".join(_NEAR.format(n=n) + _ROUND.format(n=n + 1, m=n) for n in range(2))
    + _NEAR.format(n=2)
    + """
digest as (
    select sha256(string_agg(cast(x as varchar), ',' order by part, entry, place)) as codebooks_sha256 from books2),
coded as (
    select id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from near2 group by id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join numbered using (id), digest"""
)
