"""Vector codes, hard negatives and near-duplicate vectors against SQL and brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from orderflow.llm import embedding_dedup, negatives, vector_codes
from orderflow.llm.common import read

SF = "/root/testdata/sf0.001"
NAMES = ["op11_vector_codes", "op12_hard_negatives", "op13_embedding_dedup"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    assert compare(name, entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == []


def clustered(n: int, size: int, seed: int) -> list:
    """Vectors near a few centres, some of them equal, ids with gaps, null and negative numbers."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, size))
    x = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, size)) * rng.choice([0.0, 0.1, 0.2, 0.24], size=(n, 1))
    x *= rng.choice([0.5, 1.0, 3.0], size=(n, 1))
    return [(7 * i, [float(v) for v in row], int(rng.integers(0, 3))) for i, row in enumerate(x)]


ODD = [
    (2, None, 1), (4, [], 1), (6, [0.0] * 8, 0), (8, [1.0, None], 2), (10, [float("nan"), 1.0], 2), (12, [float("inf")], 0),
    (16, [1.0, -2.0, 0.5], None), (18, [1.0, -2.0, 0.5], None), (20, [-1.0], 1),
]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_equal_the_sql(spark, name, tmp_path):
    rows = clustered(400, 8, 1) + ODD
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.float64()), pa.int32()))]
    pq.write_table(pa.table(columns, names=["vec_id", "embedding", "label"]), tmp_path / "embeddings.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    assert compare(name, found, connect(str(tmp_path)), entry.oracle_sql()[name]) == []
    assert found.count() > 400 if name != "op12_hard_negatives" else found.count() > 20


def frame(spark, rows):
    odd_names = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(odd_names, "vec_id bigint, embedding array<double>, label int, node string, code int")


def test_empty_and_repeated_rows(spark):
    empty = frame(spark, [])
    assert vector_codes.compress(empty).collect() == []
    assert negatives.mine(empty).collect() == []
    assert embedding_dedup.near_duplicates(empty).collect() == []
    rows = [(100, [1.0, 1.0], 0)] * 2 + [(100, [1.0, 2.0], 1), (None, [1.0, 1.0], 0), (None, [2.0, -2.0], 0), (5, [1.0, 1.0], 0), (7, [0.5, 0.4], 1)]
    codes = vector_codes.compress(frame(spark, rows), parts=2).collect()
    assert len(codes) == 7 and len({r.codebooks_sha256 for r in codes}) == 1
    found = embedding_dedup.near_duplicates(frame(spark, rows)).collect()
    # (1, 2) has cosine 0.9487 with (1, 1): no link.
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found) == [
        (0, 0, 0, False), (0, 4, 5, False), (5, 4, 5, True), (7, 4, 5, False), (100, 0, 100, True), (100, 4, 5, False), (100, 4, 5, False),
    ]
    mined = {(r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in negatives.mine(frame(spark, rows)).collect()}
    # Two anchors have id 100; (256, 256) has positive 5 of score 131072 and negative 7 of score 58880, (256, 512) has positive 7 of score 84992.
    assert mined == {(100, 5, 1, 7)}


def test_codes_by_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in rng.normal(size=11)], int(i % 4)) for i in rng.permutation(150)]
    rows += [(500 + i, rows[i][1], 1) for i in range(20)]
    found = vector_codes.compress(frame(spark, rows), parts=4, entries=6).collect()
    ints = {i: [int(np.floor(256 * x)) for x in v] + [0] for i, v, _ in rows}
    books = [[ints[i][3 * p : 3 * p + 3] for i in range(6)] for p in range(4)]

    def assign():
        out = {}
        for i, v in ints.items():
            away = [[sum((a - b) ** 2 for a, b in zip(v[3 * p :], e)) for e in books[p]] for p in range(4)]
            out[i] = [(d.index(min(d)), min(d)) for d in away]
        return out

    for _ in range(2):
        near = assign()
        for p in range(4):
            for e in range(6):
                parts = [ints[i][3 * p : 3 * p + 3] for i in ints if near[i][p][0] == e]
                if parts:
                    books[p][e] = [sum(c) // len(parts) for c in zip(*parts)]
    near, text = assign(), ",".join(str(x) for b in books for e in b for x in e)
    for r in found:
        assert r.code == "".join(f"{e:02x}" for e, _ in near[r.vec_id])
        assert r.error == sum(d for _, d in near[r.vec_id])
        assert r.codebooks_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 2, 5, 8, 48])
def test_nearest_entry_is_exact_with_ties(size):
    rng = np.random.default_rng(size)
    x, entries = rng.integers(-300, 300, (500, size)), rng.integers(-300, 300, (40, size))
    entries[20:30] = entries[:10]
    x[:40] = entries
    away = ((x[:, None] - entries) ** 2).sum(2)
    index, distance = vector_codes.nearest(vector_codes.spectrum(x), vector_codes.spectrum(entries))
    assert (index == away.argmin(1)).all() and (distance == away.min(1)).all()


def test_sequency_counts_sign_changes():
    rows = vector_codes.hadamard(np.eye(16, dtype=np.int64))[vector_codes.by_sequency(16)]
    assert [(np.diff(r) != 0).sum() for r in rows] == list(range(16))


@pytest.mark.parametrize("width, most", [(1, 3), (8, 127), (13, 1), (64, 1 << 24)])
def test_subset_sums_give_inner_products(width, most):
    rng = np.random.default_rng(width)
    a, c = rng.integers(-most, most + 1, (9, width)), rng.integers(-most, most + 1, (50, width))
    c[0], c[1] = -most, most
    planes = int(most).bit_length() + 1
    assert (negatives.scores(a, negatives.bit_planes(c, planes)) == c @ a.T).all()


def test_blocks_and_chunks_change_nothing(spark):
    table = frame(spark, clustered(600, 8, 3))
    key = lambda r: tuple(r)
    whole = sorted(map(key, negatives.mine(table, every=20).collect()))
    assert len(whole) > 50 and sorted(map(key, negatives.mine(table, every=20, chunk=50, block=3).collect())) == whole


def brute(x: np.ndarray, ids: list, threshold: float = 0.95) -> list:
    length = np.sqrt((x * x).sum(1))
    on = x @ x.T / np.outer(length, length) >= threshold
    links, least = on.sum(1) - 1, np.array(ids)
    while True:
        following = np.where(on, least, least.max()).min(1)
        if (following == least).all():
            return sorted(zip(ids, links.tolist(), least.tolist()))
        least = following


def test_hot_groups_are_split_and_counted_once(spark):
    """A third of the rows are near copies of one vector, another group are equal, and blocks are small."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 24))
    x[:300] = x[0] + rng.normal(size=(300, 24)) * 0.17
    x[300:420] = x[300]
    ids = rng.permutation(900).tolist()
    table = frame(spark, [(i, [float(v) for v in row], 0) for i, row in zip(ids, x)])
    want = brute(x, ids)
    assert max(n for _, n, _ in want) > 100
    for p in (embedding_dedup.Params(), embedding_dedup.Params(block=40, cell=20)):
        found = embedding_dedup.near_duplicates(table, p).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_estimates_are_unbiased_and_bounded():
    """The estimate from code, planes and factor scatters around the inner product, and few links lie below the bound."""
    rng, size = np.random.default_rng(4), 64
    one = rng.normal(size=(4000, size))
    one /= np.linalg.norm(one, axis=1)[:, None]
    other = rng.normal(size=(4000, size))
    other -= (other * one).sum(1)[:, None] * one
    other /= np.linalg.norm(other, axis=1)[:, None]
    two = 0.95 * one + np.sqrt(1 - 0.95**2) * other
    a, b = embedding_dedup.rotated(one, (13,)), embedding_dedup.rotated(two, (13,))
    assert np.allclose((a * b).sum(1), 0.95)
    factor = np.abs(b).sum(1) / np.sqrt(size)
    estimate = (a * np.sign(b)).sum(1) / np.sqrt(size) / factor
    spread = np.sqrt(1 - 0.95**2) * np.sqrt((1 - factor**2) / (size - 1)) / factor
    assert abs(estimate.mean() - 0.95) < 0.002
    assert 0.8 < (estimate - 0.95).std() / spread.mean() < 1.2


def test_search_finds_the_links_of_a_table(spark):
    rows = read(spark, "/root/testdata/sf0.1", "embeddings").collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    rng = np.random.default_rng(1)
    x[1000:1500] = x[:500] + rng.normal(size=(500, x.shape[1])) * 0.03
    table = frame(spark, [(i, [float(v) for v in row], 0) for i, row in zip(ids, x)])
    found = embedding_dedup.near_duplicates(table).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute(x, ids)
