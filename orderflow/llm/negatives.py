"""Hard negatives of anchors, by full exact scores from subset-sum tables (the method of the Four Russians).

Components become whole numbers. For every eight dimensions an anchor has a table of the sums of all 256 subsets of its components. A
candidate's components are kept as bit planes: for each plane of their two's complement, one byte holds that bit of eight dimensions and is
the index of a table. A score is the sum over the groups of eight of the looked-up sums, shifted by plane and added, the top plane with a
minus sign. All scores of all pairs are computed in full, in 64-bit whole numbers.

Anchors are a stated set of queries against all rows, in blocks: candidates are dealt into chunks of ``chunk`` rows and anchors into blocks of
``block`` rows by hash, whatever their labels, and a task scores one block against one chunk. So no label, however frequent, gathers in a
task, memory follows the two sizes, and a task returns no more than the best few of each anchor. A first pass finds the positives among rows of
the same label, a second one the negatives among the others, between the bounds that each positive's score sets.

Defined cases: rows whose id, label or vector is null, or whose vector holds null or non-finite components, take no part; vectors of unequal
length are filled with zeros; repeated rows (equal id, label and vector) are one, other rows that share an id count each; a row is no positive of
an anchor with its own id; whole numbers are held within +-2^24; anchors without positives, and positives without negatives, return nothing; an
empty table gives an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.common import stored
from orderflow.llm.integers import int_matrix, integer_vectors

GROUP = 8
#: Rows of a chunk that are scored at once, so that the scores of a block stay small.
STRIP = 2048


def bit_planes(ints: np.ndarray, planes: int) -> np.ndarray:
    """``(row, plane, group)``: bytes with one bit of eight dimensions each, the two's complement of ``planes`` bits."""
    padded = np.zeros((len(ints), -(-ints.shape[1] // GROUP) * GROUP), np.int64)
    padded[:, : ints.shape[1]] = ints
    bits = padded[:, None, :] >> np.arange(planes)[:, None] & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``(subset, anchor)``: the sums of all subsets of eight components of each anchor."""
    sums = np.zeros((1 << GROUP, len(anchors)), np.int64)
    for bit in range(GROUP):
        sums[1 << bit : 2 << bit] = sums[: 1 << bit] + anchors[:, bit]
    return sums


def scores(anchors: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """``(candidate, anchor)``: inner products of the anchors' whole numbers and the candidates' bit planes."""
    rows, planes, groups = packed.shape
    padded = np.zeros((len(anchors), groups * GROUP), np.int64)
    padded[:, : anchors.shape[1]] = anchors
    out = np.zeros((rows, len(anchors)), np.int64)
    for group in range(groups):
        sums = subset_sums(padded[:, group * GROUP : (group + 1) * GROUP])
        for begin in range(0, rows, STRIP):
            index = packed[begin : begin + STRIP, :, group]
            part = -sums[index[:, planes - 1]]
            for plane in range(planes - 2, -1, -1):
                part <<= 1
                part += sums[index[:, plane]]
            out[begin : begin + STRIP] += part
    return out


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, label, ints`` of the rows that take part."""
    slim = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    return integer_vectors(slim.filter("vec_id is not null and label is not null")).distinct()


def _planes_needed(rows: DataFrame) -> tuple[int, int, int]:
    """Rows, the longest vector, and the bits of the largest component with its sign."""
    n, width, least, most = rows.agg(
        F.count("*"), F.max(F.size("ints")), F.min(F.array_min("ints")), F.max(F.array_max("ints"))
    ).first()
    low, high = least or 0, most or 0
    return n, width or 0, max(high, -low - 1, 0).bit_length() + 1


def packed_rows(rows: DataFrame, width: int, planes: int, chunks: int) -> DataFrame:
    """``chunk, vec_id, label, packed``: the candidates, dealt by hash."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = bit_planes(int_matrix(batch["ints"], width), planes)
                bodies = pa.array([row.tobytes() for row in packed], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch["chunk"], batch["vec_id"], batch["label"], bodies], names=["chunk", "vec_id", "label", "packed"]
                )

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "label", "ints"), F.lit(chunks)))
    return dealt.select("chunk", "vec_id", "label", "ints").mapInArrow(pack, "chunk bigint, vec_id bigint, label bigint, packed binary")


def _meet(anchors: DataFrame, packed: DataFrame, sizes: tuple[int, int, int, int], find: Callable, schema: str) -> DataFrame:
    """``find`` on every block of anchors with every chunk of candidates."""
    width, planes, chunks, blocks = sizes
    groups = -(-width // GROUP)
    left = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    right = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def meet(_, block: pa.Table, chunk: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and chunk.num_rows:
            chunk = chunk.sort_by([("vec_id", "ascending")])
            body = np.frombuffer(b"".join(chunk["packed"].to_pylist()), np.uint8).reshape(chunk.num_rows, planes, groups)
            out = find(block, int_matrix(block["ints"], width), chunk["vec_id"].to_numpy(), chunk["label"].to_numpy(), body)
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * len(names)
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns)})

    names = [c.split()[0] for c in schema.split(", ")]
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(meet, schema)


def _first(df: DataFrame, group: list[str], score: str, row: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group: higher scores first, ties by smaller id. Each partition keeps no more than ``n`` a group before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), row)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _same_label(positives: int):
    def find(block: pa.Table, own: np.ndarray, vec_id: np.ndarray, label: np.ndarray, body: np.ndarray) -> list:
        """The best candidates of each anchor's own label."""
        out, ids, labels = [], block["anchor_id"].to_numpy(), block["label"].to_numpy()
        keys = block["anchor"].to_numpy()
        for value in np.unique(labels):
            rows, mine = np.flatnonzero(label == value), np.flatnonzero(labels == value)
            if not len(rows):
                continue
            near = scores(own[mine], body[rows])
            for place, anchor in enumerate(mine):
                score = near[:, place]
                best = np.argsort(-score, kind="stable")  # candidates come by id, so ties stay in that order
                best = best[vec_id[rows[best]] != ids[anchor]][:positives]
                out.append((np.full(len(best), keys[anchor]), vec_id[rows[best]], score[best]))
        return out

    return find


def _between(negatives: int):
    def find(block: pa.Table, own: np.ndarray, vec_id: np.ndarray, label: np.ndarray, body: np.ndarray) -> list:
        """For each positive of an anchor the first candidates of other labels between its bounds."""
        out, near = [], scores(own, body)
        found = zip(block["anchor"].to_pylist(), block["anchor_id"].to_pylist(), block["label"].to_pylist(), block["positives"].to_pylist())
        for place, (key, anchor, own_label, positives) in enumerate(found):
            score = near[:, place]
            lows = [(p["low"], p["high"]) for p in positives]
            fits = np.flatnonzero((label != own_label) & (score >= min(x for x, _ in lows)) & (score <= max(y for _, y in lows)))
            fits = fits[np.argsort(-score[fits], kind="stable")]
            falling = -score[fits]
            for p in positives:
                begin, end = np.searchsorted(falling, -p["high"], "left"), np.searchsorted(falling, -p["low"], "right")
                hit = fits[begin : max(begin, min(end, begin + negatives))]
                same = [np.full(len(hit), v) for v in (key, p["rank"], anchor, p["vec_id"], p["score"])]
                out.append((*same, vec_id[hit], score[hit]))
        return out

    return find


def _bound(percent: int, up: bool) -> Column:
    """The least (greatest) whole score with ``100 * score`` at least (at most) ``percent`` times the positive's score; wide, so nothing overflows."""
    share = F.col("score").cast("decimal(25,0)") * percent / 100
    return (F.ceil(share) if up else F.floor(share)).cast("bigint")


def mine(
    table: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    chunk: int = 8192,
    block: int = 512,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row whose id is divisible by ``every`` and each of its
    first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's."""
    rows = stored(usable(table), "negative-rows")
    n, width, planes = _planes_needed(rows)
    chunks = max(1, -(-n // chunk))
    packed = stored(packed_rows(rows, width, planes, chunks), "negative-planes")
    anchors = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "anchor_id")
    anchors = stored(anchors.withColumn("anchor", F.monotonically_increasing_id()), "negative-anchors")
    blocks = max(1, -(-anchors.count() // block))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    sizes = (width, planes, chunks, blocks)

    same = _meet(anchors, packed, sizes, _same_label(positives), "anchor bigint, vec_id bigint, score bigint")
    best = _first(same, ["anchor"], "score", "vec_id", positives)
    bounds = F.struct("rank", "vec_id", "score", _bound(low, True).alias("low"), _bound(high, False).alias("high"))
    with_bounds = best.groupBy("anchor").agg(F.collect_list(bounds).alias("positives"))  # a fixed few
    asking = stored(anchors.join(with_bounds, "anchor"), "negative-positives")
    ids = "anchor bigint, place bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
    found = _meet(asking, packed, sizes, _between(negatives), f"{ids}, negative_id bigint, negative_score bigint")
    return _first(found, ["anchor", "place"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


MINE_SQL = """with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding from embeddings
    where vec_id is not null and label is not null and embedding is not null
    and not exists (select 1 from (select unnest(embedding) as x) where x is null or isnan(x) or isinf(x))),
cells as (select vec_id, label, i, cast(floor(256 * embedding[i]::double) as bigint) as x
    from rows, unnest(range(1, len(embedding) + 1)) as r(i)),
scores as (
    select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(sum(a.x * c.x) as bigint) as score
    from cells a join cells c using (i) where a.vec_id % 100 = 0 and a.vec_id <> c.vec_id group by all),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
    vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10"""


def shifted_labels(table: DataFrame) -> DataFrame:
    """The registered query's labels: one further, of ten, where the id is divisible by 7."""
    return table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
