"""Approximate nearest neighbours by NN-descent and greedy graph search, for the largest inner product.

Equal vectors are one node. A node's list starts from random hyperplane partitions, inside which all pairs are compared (oversize cells are dealt
into cells of ``cell`` nodes). NN-descent then improves the lists in rounds: every node introduces its neighbours and a sample of those that
list it to each other; pairs nearer than what one of them has so far enter its list. Rounds end when few entries change.
Lists use 8-bit codes of the vectors, each on its own scale, lengthened by one component that makes nearest and largest inner product the same.
That component is kept as a number beside the code, so a few long vectors do not coarsen the codes of the others.

A query starts from its own node's list and the few longest vectors, and expands, round by round, the best nodes of its beam that are not yet expanded, for all
queries in one join with the graph. It ends when its beam has none left. The nodes of the beam are ranked by the inner product
of the original vectors in double precision.

Shuffles carry codes, not vectors; lists and cells have fixed lengths, so no group grows with the data.

Defined cases: vectors that are null, empty, zero or hold a null or a number that is not finite take no part, nor do those of a length other than
the most frequent one; equal vectors share a node, and its smallest ids stand for all (only as many as are asked for can be results); repeated
rows of an id and vector are one; ties go to the smaller id; with fewer candidates than asked for, all that were found are returned; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.arrays import mix
from orderflow.llm.common import release_shuffles, spans, stored


@dataclass
class Params:
    k: int = 24
    partitions: int = 8
    cell: int = 1024
    most_rounds: int = 8
    least_change: float = 0.02
    beam: int = 96
    step: int = 24
    most_steps: int = 12
    entries: int = 64
    seed: int = 11


LIST = "array<struct<neg:float,other:bigint>>"


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) and ``node`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0.0)
    )
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    rows = rows.filter(F.size("v") == (sizes["size"] if sizes else 0))
    return rows.withColumn("node", F.xxhash64("v"))


def coded(nodes: DataFrame) -> DataFrame:
    """``node, code``: the scale, the shortfall and the 8-bit components of each vector, as parts of the greatest length.

    A vector of length ``r`` is lengthened by a component ``1 - shortfall``, with ``shortfall = 1 - sqrt(1 - r * r)``: all have length one then."""
    most = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / most) * (x / most))
    longest = (nodes.agg(F.max(norm2)).first()[0] or 1.0) ** 0.5

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1) / most / longest
                norm2 = np.minimum(1.0, (v * v).sum(1))
                scale = np.maximum(np.abs(v).max(1), 1e-300) / 127
                head = np.stack([scale, norm2 / (1 + np.sqrt(1 - norm2))], 1).astype(np.float32)
                codes = np.rint(v / scale[:, None]).astype(np.int8)
                packed = [h.tobytes() + c.tobytes() for h, c in zip(head, codes)]
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array(packed, pa.binary())], names=["node", "code"])

    return nodes.select("node", "v").mapInArrow(encode, "node bigint, code binary")


_HEAD = 8  # bytes of scale and shortfall


def _matrix(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components, scales and shortfalls."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    rows = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    head = np.ascontiguousarray(rows[:, :_HEAD]).view(np.float32)
    return rows[:, _HEAD:].view(np.int8).astype(np.float32), head[:, 0], head[:, 1]


def _near(own: np.ndarray, scale: np.ndarray, short: np.ndarray) -> np.ndarray:
    """The inner products of the lengthened vectors, less one: near one, the small differences would be lost. Products of 8-bit components
    are whole numbers and the rest goes by pairs, so a pair has the same value wherever it meets."""
    return own @ own.T * np.multiply.outer(scale, scale) - (np.add.outer(short, short) - np.multiply.outer(short, short))


def first_graph(codes: DataFrame, p: Params) -> DataFrame:
    """``node, list``: the best ``k`` others of each node in the cells of several random partitions."""
    total = codes.count()
    bits = max(0, int(np.ceil(np.log2(max(1, total) / p.cell))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, _, _ = _matrix(batch["code"])
            planes = np.random.default_rng(p.seed).standard_normal((own.shape[1], p.partitions * bits)).astype(np.float32)
            # Planes leave out the lengthening component, which has one sign; the scale does not change a side.
            side = (own @ planes > 0).reshape(len(own), p.partitions, bits)
            cell = side @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(own), p.partitions), np.int64)
            for t in range(p.partitions):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), t, np.int32)), pa.array(cell[:, t]), batch["node"], batch["code"]],
                    names=["part", "cell", "node", "code"],
                )

    dealt = codes.mapInArrow(deal, "part int, cell bigint, node bigint, code binary")
    sizes = dealt.groupBy("part", "cell").agg(F.ceil(F.count("*") / (2 * p.cell)).alias("split"))
    cells = dealt.join(sizes, ["part", "cell"]).withColumn("split", F.pmod(F.xxhash64("node", "part"), F.col("split")))

    def compare(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        k = min(p.k, len(node) - 1)
        near = _near(*_matrix(table["code"]))
        np.fill_diagonal(near, -np.inf)
        best = np.argpartition(-near, max(0, k - 1), axis=1)[:, :k] if k else np.zeros((len(node), 0), np.int64)
        pairs = pa.StructArray.from_arrays(
            [pa.array(-np.take_along_axis(near, best, 1).ravel(), pa.float32()), pa.array(node[best.ravel()])], names=["neg", "other"]
        )
        offsets = pa.array(np.arange(len(node) + 1, dtype=np.int32) * k)
        return pa.table({"node": table["node"].combine_chunks(), "list": pa.ListArray.from_arrays(offsets, pairs)})

    lists = cells.select("part", "cell", "split", "node", "code").groupBy("part", "cell", "split").applyInArrow(compare, f"node bigint, list {LIST}")
    merged = lists.groupBy("node").agg(F.flatten(F.collect_list("list")).alias("list"))  # one entry a partition
    return merged.select("node", _best("list", p.k))


def _best(column: str, k: int):
    return F.slice(F.array_sort(F.array_distinct(column)), 1, k).alias("list")


def _short(values: np.ndarray) -> np.ndarray:
    return (mix(values.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def introduce(graph: DataFrame, codes: DataFrame, p: Params, turn: int) -> DataFrame:
    """``node, other, neg``: pairs that meet at a common neighbour and are nearer than the last entry of ``node``'s list."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a member brings along: the bound of its list, and short hashes of it."""
        for batch in batches:
            if batch.num_rows:
                size = batch["list"].value_lengths().to_numpy()
                entries = batch["list"].flatten()
                other, neg = entries.field("other").to_numpy(), entries.field("neg").to_numpy()
                ends = np.cumsum(size)
                bound = np.where((size >= p.k) & (size > 0), neg[np.maximum(ends - 1, 0)] if len(neg) else 0, np.inf)
                short = _short(other)
                yield pa.RecordBatch.from_arrays(
                    [batch["node"], pa.array(bound, pa.float32()), pa.array([short[e - s : e].tobytes() for s, e in zip(size, ends)], pa.binary())],
                    names=["node", "bound", "held"],
                )

    summary = graph.mapInArrow(sum_up, "node bigint, bound float, held binary").join(codes, "node")
    out = graph.select(F.col("node").alias("at"), F.explode("list.other").alias("node"))
    order = Window.partitionBy("at").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    back = (
        out.select(F.col("node").alias("at"), F.col("at").alias("node"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= p.k)
        .drop("place")
    )
    members = out.unionByName(back).distinct().join(summary, "node").select("at", "node", "bound", "held", "code")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            at = table["at"].to_numpy()
            cut = int(np.searchsorted(at, at[-1])) if len(at) and (at[:-1] <= at[1:]).all() else 0
            rest = table.slice(cut)
            if cut:
                yield from groups(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from groups(rest)

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at, node, bound = (table[c].to_numpy() for c in ("at", "node", "bound"))
        code, held = _matrix(table["code"]), table["held"].to_pylist()
        short = _short(node)
        found = []
        starts = np.flatnonzero(np.diff(at, prepend=~at[0]) != 0).tolist()
        for a, b in zip(starts, [*starts[1:], len(at)]):
            neg = -_near(*(part[a:b] for part in code))
            np.fill_diagonal(neg, np.inf)
            i, j = np.nonzero(neg < bound[a:b, None])
            if len(i):
                has = [set(np.frombuffer(h, np.uint16).tolist()) for h in held[a:b]]
                keep = [y not in has[x] for x, y in zip(i.tolist(), short[a:b][j].tolist())]
                i, j = i[keep], j[keep]
                found.append((node[a + i], node[a + j], neg[i, j]))
        if found:
            columns = [np.concatenate(c) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "other", "neg"])

    met = members.repartition("at").sortWithinPartitions("at").mapInArrow(meet, "node bigint, other bigint, neg float")
    return met.groupBy("node", "other").agg(F.min("neg").alias("neg"))


def build_graph(codes: DataFrame, p: Params = Params()) -> DataFrame:
    """``node, list``: about the ``k`` nearest others of each node."""
    spark = codes.sparkSession
    graph = stored(first_graph(codes, p), "graph")
    release_shuffles(spark)
    nodes = graph.count()
    for turn in range(p.most_rounds):
        new = introduce(graph, codes, p, turn).groupBy("node").agg(F.collect_list(F.struct("neg", "other")).alias("new"))
        both = F.concat("list", F.coalesce(F.col("new").cast(LIST), F.array().cast(LIST))).alias("list")
        merged = graph.join(new, "node", "left").select("node", F.col("list").alias("before"), both).select("node", "before", _best("list", p.k))
        changed = F.size(F.array_except("list.other", "before.other"))
        graph = stored(merged.select("node", "list", changed.alias("changed")), "graph")
        moved = graph.agg(F.sum("changed")).first()[0] or 0
        graph = graph.select("node", "list")
        release_shuffles(spark)
        if moved <= p.least_change * nodes * p.k:
            break
    return graph


def greedy_search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, p: Params = Params()) -> DataFrame:
    """``query`` (a node) and ``beam``: its best nodes and their negative inner products. ``vectors`` has ``node, v``; queries start from
    their own lists."""
    edges = graph.select("node", F.col("list.other").alias("others"))
    beam = None
    # Long vectors have large products with many queries: a few of them are entries for all.
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = vectors.select("node", norm2.alias("norm2")).orderBy(F.desc("norm2"), "node").limit(p.entries).collect()
    entries = F.array(*[F.lit(r.node) for r in longest]).cast("array<bigint>")
    wanted = queries.join(edges, "node").select(
        F.col("node").alias("query"), F.explode(F.concat(F.array("node"), "others", entries)).alias("node")
    )
    own = queries.select(F.col("node").alias("query")).join(vectors.select(F.col("node").alias("query"), F.col("v").alias("q")), "query")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch[c].flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("q", "v"))
                yield pa.RecordBatch.from_arrays(
                    [batch["query"], batch["node"], pa.array(-np.einsum("ij,ij->i", a, b))], names=["query", "node", "neg"]
                )

    entry = "array<struct<neg:double,node:bigint,done:boolean>>"
    for _ in range(p.most_steps):
        rated = (
            wanted.distinct().join(vectors, "node").join(own, "query").select("query", "node", "q", "v")
            .mapInArrow(products, "query bigint, node bigint, neg double")
        )
        fresh = rated.groupBy("query").agg(F.collect_list(F.struct("neg", "node", F.lit(False).alias("done"))).alias("fresh"))
        if beam is None:
            joined = fresh.select("query", F.col("fresh").cast(entry).alias("beam"))
        else:
            known = F.transform("beam", lambda x: x["node"])
            new = F.filter("fresh", lambda x: ~F.array_contains(F.col("known"), x["node"]))
            joined = (
                beam.join(fresh, "query", "left").withColumn("known", known)
                .select("query", F.concat("beam", F.coalesce(new.cast(entry), F.array().cast(entry))).alias("beam"))
            )
        kept = F.slice(F.array_sort("beam"), 1, p.beam)
        # The next nodes to expand are the best of the beam that are not done yet.
        joined = joined.select("query", kept.alias("beam")).withColumn(
            "next", F.slice(F.transform(F.filter("beam", lambda x: ~x["done"]), lambda x: x["node"]), 1, p.step)
        )
        done = F.transform(
            "beam",
            lambda x: F.struct(x["neg"].alias("neg"), x["node"].alias("node"), (x["done"] | F.array_contains(F.col("next"), x["node"])).alias("done")),
        )
        beam = stored(joined.select("query", done.cast(entry).alias("beam"), "next"), "beam")
        front = beam.select("query", F.explode("next").alias("node"))
        if front.isEmpty():
            break
        wanted = front.join(edges, "node").select("query", F.explode("others").alias("node"))
        beam = beam.select("query", "beam")
    return beam.select("query", F.transform("beam", lambda x: F.struct(x["neg"].alias("neg"), x["node"].alias("node"))).alias("beam"))


def search(table: DataFrame, every: int = 20, nearest: int = 20, p: Params = Params()) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row whose id is divisible by ``every``, against all other rows."""
    rows = stored(usable(table).distinct(), "vectors")
    nodes = stored(rows.groupBy("node").agg(F.first("v").alias("v")), "nodes")
    codes = stored(coded(nodes), "codes")
    graph = build_graph(codes, p)
    asking = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "node")
    beams = greedy_search(graph, nodes, asking.select("node").distinct(), p)
    # Of the ids of a node only the smallest can be results; one of them may be the query's own.
    place = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    ids = rows.select("node", "vec_id").withColumn("place", place).filter(F.col("place") <= nearest + 1)
    ids = ids.groupBy("node").agg(F.collect_list("vec_id").alias("ids"))
    flat = beams.select("query", F.explode("beam").alias("b")).select("query", F.col("b.neg").alias("neg"), F.col("b.node").alias("node"))
    found = (
        flat.join(ids, "node")
        .select("query", "neg", F.explode("ids").alias("vec_id"))
        .groupBy("query")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("neg", "vec_id"))), 1, nearest + 1).alias("found"))
    )
    answers = asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(found, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    return answers.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.neg")).alias("score"),
    )
