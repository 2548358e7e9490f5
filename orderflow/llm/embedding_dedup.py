"""Near-duplicate vectors: binary codes after a random rotation decide which pairs are computed exactly.

*Codes.* A unit vector is rotated at random (three rounds of random signs and a Walsh-Hadamard transform, zero-padded to a power of two). Its code is
the signs of the rotated components, stored with the correction factor ``f``, the inner product of the vector and its code. For another vector, rotated and
rounded to four bits with a fixed random dither, the inner product with the code, divided by ``f``, estimates the inner product of the two vectors without
bias; it is computed from four bit planes by counting common bits. A pair at the threshold ``t`` strays from its estimate by
``sqrt(1 - t*t) * sqrt((1 - f*f) / (D - 1)) / f`` times a number that exceeds ``sigmas`` (5) once in about a million, besides what the rounding adds
(bounded by Hoeffding's inequality at the same odds). Only pairs whose estimate reaches ``t`` less that bound are computed exactly, from the original
vectors in double precision, and only the exact value makes a link.

*Meeting.* Vectors meet in cells of several tables; a cell is named by the largest component, with its sign, of ``depth`` further random rotations. The
chance that two vectors at the threshold share a cell is measured by simulation, and there are as many tables as make the chance of missing such a pair in all
of them at most ``miss`` (0.001); nearer pairs are missed less often. A pair counts in the first table where it meets and in no other, which the cell names carried along
tell. ``depth`` grows with the logarithm of the rows, so cells keep their size.

*Hot groups.* Equal vectors are one node with a weight. A large cell is dealt into blocks of ``block`` nodes, and tasks compare pairs of blocks. Tasks never return pairs: a first pass, on
codes alone, returns the nodes that have a candidate; a second one takes the vectors of these only and returns, for each node, the weight it is linked with
and the smallest node it is connected with inside the task. Both have at most a row a node of the task. A group of near but unequal copies costs comparisons with the square of
its size, spread over tasks, and shuffles each node once for each block of its cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths do not
link; every row counts, so rows that repeat an id or a vector are vectors of their own; a row without an id links like others, and its component is the smallest
id there (null where there is none; then it is not kept); an empty table gives an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import stored
from orderflow.llm.components import components
from orderflow.llm.integers import finite
from orderflow.llm.vector_codes import hadamard


@dataclass
class Params:
    threshold: float = 0.95
    miss: float = 0.001
    sigmas: float = 5.0
    cell: int = 1024
    block: int = 2048
    seed: int = 13


BITS = 4  # of a rounded component
STRIP = 256  # rows that are compared with all others at once


def rotated(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """``x`` padded to a power of two (64 at least) and rotated at random; lengths are kept."""
    size = max(64, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed).integers(0, 2, (3, size)) * 2.0 - 1.0
    for turn in signs:
        out = hadamard(out * turn) / np.sqrt(size)
    return out


def share_of_cells(threshold: float, size: int, trials: int = 20_000) -> float:
    """How often two vectors at the threshold have the same largest component after a rotation."""
    rng, same, done = np.random.default_rng(1), 0, 0
    while done < trials:
        n = min(trials - done, max(1, (1 << 22) // size))
        one = rng.standard_normal((n, size))
        two = threshold * one + np.sqrt(1 - threshold**2) * rng.standard_normal((n, size))
        same, done = same + int((_largest(one) == _largest(two)).sum()), done + n
    return same / trials


def _largest(x: np.ndarray) -> np.ndarray:
    at = np.abs(x).argmax(1)
    return (2 * at + (x[np.arange(len(x)), at] > 0)).astype(np.uint16)


def cells_for(rows: int, size: int, p: Params) -> tuple[int, int]:
    """Rotations a cell name, and tables."""
    depth = 1
    while rows / (2.0 * size) ** depth > p.cell:
        depth += 1
    together = share_of_cells(p.threshold, size) ** depth
    return depth, max(1, int(np.ceil(np.log(p.miss) / np.log1p(-min(together, 1 - 1e-12)))))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


CODE = "node bigint, code binary, planes binary, factors array<float>, cells binary"


def coded(nodes: DataFrame, depth: int, tables: int, p: Params) -> DataFrame:
    """The code of each node (``node, size, v``): signs, bit planes, the numbers that go with them, and its cell in each table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                unit = _unit(_vectors(part["v"]))
                x = rotated(unit, (p.seed,))
                low, step = x.min(1), np.maximum((x.max(1) - x.min(1)) / (2**BITS - 1), 1e-12)
                dither = np.random.default_rng((p.seed, 1)).random(x.shape[1])
                whole = np.clip(np.floor((x - low[:, None]) / step[:, None] + dither), 0, 2**BITS - 1).astype(np.uint8)
                planes = np.packbits(whole[:, None, :] >> np.arange(BITS, dtype=np.uint8)[:, None] & 1, axis=2)
                factor = np.abs(x).sum(1) / np.sqrt(x.shape[1])
                signs = np.packbits(x > 0, axis=1)
                numbers = np.stack([factor, low, step, whole.sum(1), (x > 0).sum(1)], 1).astype(np.float32)
                names = np.stack([_largest(rotated(unit, (p.seed, 2, t))) for t in range(tables * depth)], 1)
                arrays = [part["node"]] + [pa.array([r.tobytes() for r in m], pa.binary()) for m in (signs, planes)]
                arrays.append(pa.FixedSizeListArray.from_arrays(pa.array(numbers.ravel()), 5).cast(pa.list_(pa.float32())))
                arrays.append(pa.array([r.tobytes() for r in names], pa.binary()))
                yield pa.RecordBatch.from_arrays([*arrays, part["size"]], names=["node", "code", "planes", "factors", "cells", "size"])

    return nodes.select("node", "size", "v").mapInArrow(code, f"{CODE}, size int")


def _matrix(column, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def candidates(key: tuple, table: pa.Table, depth: int, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (by place, in order of node) that may be links and meet in the key's table first; where the key has two blocks, pairs
    between them."""
    at, _, one, two = (k.as_py() for k in key)
    n = table.num_rows
    signs, planes = _matrix(table["code"], np.uint64), _matrix(table["planes"], np.uint64).reshape(n, BITS, -1)
    names = _matrix(table["cells"], np.uint16).reshape(n, -1, depth)
    numbers = table["factors"].combine_chunks().flatten().to_numpy().reshape(n, 5)
    factor, low, step, total, ones = numbers.T
    block, size = table["own"].to_numpy(), signs.shape[1] * 64
    spread = np.sqrt(max(0.0, 1 - p.threshold**2)) * np.sqrt(np.maximum(0.0, 1 - factor**2) / (size - 1)) * p.sigmas
    rounding = step * np.sqrt((np.log(2.0) + p.sigmas**2 / 2) / 2)
    for begin in range(0, n, STRIP):
        end = min(n, begin + STRIP)
        common = np.zeros((end - begin, n - begin), np.int32)
        for bit in range(BITS):
            for word in range(signs.shape[1]):
                common += np.bitwise_count(planes[begin:end, bit, word][:, None] & signs[None, begin:, word]).astype(np.int32) << bit
        a, b = slice(begin, end), slice(begin, n)
        inner = 2 * common * step[a, None] + 2 * np.multiply.outer(low[a], ones[b]) - (step[a] * total[a] + low[a] * size)[:, None]
        inner /= np.sqrt(size)
        # Multiplied through by the factor of the code, estimate >= threshold - bound.
        near = inner >= p.threshold * factor[None, b] - spread[None, b] - rounding[a, None]
        near &= np.arange(begin, end)[:, None] < np.arange(begin, n)
        if one != two:
            near &= block[a, None] != block[None, b]
        i, j = np.nonzero(near)
        i, j = i + begin, j + begin
        if at and len(i):
            earlier = (names[i, :at] == names[j, :at]).all(2).any(1)
            i, j = i[~earlier], j[~earlier]
        if len(i):
            yield i, j


def dealt(codes: DataFrame, depth: int, tables: int, p: Params) -> DataFrame:
    """The codes, once for each table and each pair of blocks that a node's block is part of: ``at, cell, one, two`` name the group, ``own`` the block."""
    spots = codes.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    name = F.expr(f"substring(cells, at * {2 * depth} + 1, {2 * depth})")
    spots = spots.withColumn("cell", F.concat_ws("-", F.col("size"), F.hex(name)))
    blocks = spots.groupBy("at", "cell").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    blocks = blocks.filter("blocks > 1")
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    split = spots.join(blocks, ["at", "cell"], "left").withColumn("own", own)
    # Blocks meet in pairs; where there are several, pairs inside a block are compared in the group of the block with itself.
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    return split.select("*", other).select(
        "at", "cell", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", *[c.split()[0] for c in CODE.split(", ")]
    )


_GROUP = ["at", "cell", "one", "two"]


def flagged(spots: DataFrame, depth: int, p: Params) -> DataFrame:
    """The group, block and node of every node that has a candidate in a group."""

    def look(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending")])
        has = np.zeros(table.num_rows, bool)
        for i, j in candidates(key, table, depth, p):
            has[i], has[j] = True, True
        return table.filter(pa.array(has)).select([*_GROUP, "own", "node"])

    return spots.groupBy(*_GROUP).applyInArrow(look, "at int, cell string, one int, two int, own int, node bigint")


def linked(spots: DataFrame, depth: int, p: Params) -> DataFrame:
    """``node, weight, least``: what each node is linked with in a group, and the smallest node connected with it there."""

    def link(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending")])
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        x = _vectors(table["v"].combine_chunks())
        x = x if _safe(x) else x / np.abs(x).max(1)[:, None]
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        weight, least = np.zeros(len(node), np.int64), np.arange(len(node))
        for i, j in candidates(key, table, depth, p):
            for begin in range(0, len(i), 1 << 14):
                a, b = i[begin : begin + (1 << 14)], j[begin : begin + (1 << 14)]
                sure = np.einsum("ij,ij->i", x[a], x[b]) / (length[a] * length[b]) >= p.threshold
                a, b = a[sure], b[sure]
                np.add.at(weight, a, copies[b])
                np.add.at(weight, b, copies[a])
                _connect(least, a, b)
        on = weight > 0
        return pa.table({"node": node[on], "weight": weight[on], "least": node[least][on]})

    return spots.groupBy(*_GROUP).applyInArrow(link, "node bigint, weight bigint, least bigint")


def _safe(x: np.ndarray) -> bool:
    """Whether squares of the components neither overflow nor vanish."""
    size = np.abs(x).max(1)
    return bool((size < 1e100).all() and (size > 1e-100).all())


def _connect(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Every place points to the smallest place connected with it, also through the pairs ``a, b``."""
    while len(a):
        one, two = least[a], least[b]
        differ = one != two
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        low, high = np.minimum(one[differ], two[differ]), np.maximum(one[differ], two[differ])
        np.minimum.at(least, high, low)
        while not np.array_equal(step := least[least], least):
            least[:] = step


def near_duplicates(table: DataFrame, p: Params = Params()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table`` (``vec_id, embedding``)."""
    v = F.col("embedding")
    some = F.exists(v, lambda x: x != 0.0)
    slim = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(finite("embedding") & some, v).alias("v"))
    # 128 bits of hash name a vector.
    hashes = [F.when(F.col("v").isNotNull(), F.xxhash64(*seed, "v")) for seed in ([], [F.lit(1)])]
    rows = stored(slim.select("vec_id", "v", hashes[0].alias("h1"), hashes[1].alias("h2")), "dedup-rows")
    alike = rows.filter("v is not null").groupBy("h1", "h2").agg(
        F.first("v").alias("v"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies")
    )
    nodes = stored(alike.withColumn("size", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "dedup-nodes")
    n, size = nodes.agg(F.count("*"), F.max("size")).first()
    depth, tables = cells_for(n, max(64, 1 << ((size or 1) - 1).bit_length()), p)
    codes = stored(coded(nodes, depth, tables, p), "dedup-codes")
    hits = stored(flagged(dealt(codes, depth, tables, p), depth, p), "dedup-hits")
    vectors = codes.drop("size").join(nodes.select("node", "v", "copies"), "node")
    links = stored(linked(hits.join(vectors, "node"), depth, p), "dedup-links")
    weights = links.groupBy("node").agg(F.sum("weight").alias("weight"))
    ties = links.filter("least <> node").select(F.col("node").alias("a"), F.col("least").alias("b"))
    roots = components(ties)
    tied = nodes.select("h1", "h2", "node", "least_id", "copies").join(weights, "node", "left").join(roots, "node", "left")
    tied = tied.withColumn("root", F.coalesce("root", "node"))
    ids = tied.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = tied.join(ids, "root").select(
        "h1", "h2", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.filter("v is not null").select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).drop("h1", "h2").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


DEDUP_SQL = """with recursive whole as (
    select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(embedding) > 0
    and not exists (select 1 from (select unnest(embedding) as x) where x is null or isnan(x) or isinf(x))
    and exists (select 1 from (select unnest(embedding) as x) where x <> 0)),
cells as (select vec_id, len(v) as size, i, v[i] as x from whole, unnest(range(1, len(v) + 1)) as r(i)),
lengths as (select vec_id, sqrt(sum(x * x)) as length from cells group by vec_id),
links as (
    select a, b from (
        select c.vec_id as a, d.vec_id as b, sum(c.x * d.x) as inner_product
        from cells c join cells d on c.i = d.i and c.size = d.size and c.vec_id <> d.vec_id group by all)
    join lengths m on m.vec_id = a join lengths n on n.vec_id = b where inner_product / (m.length * n.length) >= 0.95),
reach as (
    select distinct vec_id as a, vec_id as b from embeddings
    union select reach.a, links.b from reach join links on reach.b = links.a),
groups as (select a as vec_id, min(b) as component_id from reach group by a),
counts as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join groups using (vec_id) left join counts using (vec_id)"""
