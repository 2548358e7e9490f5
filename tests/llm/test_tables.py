"""Search over vectors, web archives and the pipeline."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from oracle import connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from orderflow.llm import mixing, neighbours, ngram_join, quality, toxicity, warc
from orderflow.llm.common import read
from orderflow.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_neighbours_recall(spark):
    table = read(spark, SF, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    found = {}
    for r in entry.queries()["op5_nn_descent"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found) == sorted(ids[ids % 20 == 0])
    hits = 0
    for query, rows in found.items():
        rows.sort()
        scores = x @ x[ids == query][0]
        own = dict(zip(ids, scores))
        assert [r[0] for r in rows] == list(range(1, 21)) and query not in [r[1] for r in rows]
        assert all(abs(own[v] - s) < 1e-12 for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        bound = np.sort(scores[ids != query])[-20]
        hits += sum(s >= bound - 1e-12 for _, _, s in rows)
    assert hits >= 0.9 * 20 * len(found)


def test_descent_improves_a_poor_graph(spark):
    """Without partitions to start from, the rounds have to find the neighbours."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12))
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")
    p = neighbours.Params(k=12, partitions=2, cell=64, least_change=0.005)
    hits = 0
    rows = neighbours.search(table, p=p).collect()
    for query in range(0, 1500, 20):
        scores = x @ x[query]
        scores[query] = -np.inf
        bound = np.sort(scores)[-20]
        hits += sum(r.score >= bound - 1e-9 for r in rows if r.query_id == query)
    assert hits >= 0.9 * 20 * 75


def test_a_few_long_vectors_leave_the_others_apart(spark):
    """Recall against brute force where a few vectors are 10 to 1,000 times longer than the others."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(60, size=6000)] + rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[[20, 1001, 2002, 3003, 4004]] *= np.array([[10.0], [50.0], [200.0], [500.0], [1000.0]])
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in neighbours.search(table).collect():
        found.setdefault(r.query_id, []).append(r.score)
    hits = 0
    for query in range(0, 6000, 20):
        scores = x @ x[query]
        scores[query] = -np.inf
        hits += sum(s >= np.sort(scores)[-20] - 1e-9 for s in found[query])
    assert hits >= 0.9 * 20 * 300, hits / (20 * 300)


def test_neighbours_odd_rows(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(45)]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(60)]  # equal vectors
    rows += [(40, None), (60, []), (80, [0.0, 0.0, 0.0]), (200, [1.0, None, 2.0]), (220, [float("nan"), 1.0, 1.0]), (240, [float("inf"), 1.0, 1.0])]
    rows += [(260, [1.0, 2.0]), rows[20], (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, node string")
    found = neighbours.search(table).collect()
    assert {r.query_id for r in found} == {0, 20, 40, 100, 120, 140}
    for query in (100, 0):
        mine = [r for r in found if r.query_id == query]
        assert len(mine) == 20 and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
    assert neighbours.search(table.limit(0)).collect() == []
    few = neighbours.search(table.filter("vec_id in (20, 21, 22)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(20, 1, 22), (20, 2, 21)]


def test_archives_hold_records_and_a_seek_table(spark):
    pages = spark.createDataFrame(
        [(i, f"http://x/{i}", "<p>" + "same " * 400 if i % 3 else f"<p>{i}" + "é" * 900) for i in range(40)]
        + [(100, None, None), (101, "http://y", ""), (102, "http://y", "short"), (103, "http://y", "short"), (None, "u", "n" * 2000)],
        "page_id bigint, url string, html string",
    )
    folder = "file:" + scratch_path(spark, "warc").removeprefix("file:")
    index = warc.write_bundles(pages, folder, frame_bytes=4000, bundle_bytes=3000)
    places = index.collect()
    assert len(places) == 45
    for name in {p.bundle for p in places}:
        with open(f"{folder.removeprefix('file:')}/{name}", "rb") as file:
            data = file.read()
        frames = warc.read_seek_table(data)
        starts = np.cumsum([0, *[packed for packed, _ in frames]])
        for p in (p for p in places if p.bundle == name):
            assert p.frame_at == starts[p.frame] and p.frame_bytes == frames[p.frame][0]
            plain = zstandard.ZstdDecompressor().decompress(data[p.frame_at : p.frame_at + p.frame_bytes])
            assert len(plain) == frames[p.frame][1]
            assert warc.parse_record(plain[p.record_at : p.record_at + p.record_bytes])["page_id"] == p.page_id
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    rows = warc.read_bundles(spark, folder, index).collect()
    assert Counter(r.page_id for r in rows) == Counter(html.keys())
    for r in rows:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha1(html[r.page_id]).hexdigest())
        assert r.record_type == ("revisit" if r.page_id is not None and r.page_id < 38 and r.page_id % 3 else "response")
        assert (r.payload is None) if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
        assert r.refers_to == (38 if r.record_type == "revisit" else None)
    assert warc.archive(pages.limit(0)).collect() == []


def test_addresses_of_shared_folders():
    for folder in ("/data/x", "file:/data/x", "file:///data/x"):
        assert warc.address(folder) == "file:///data/x"
    assert warc.address("s3a://bucket/x") == "s3://bucket/x" and warc.address("hdfs://host:9000/x") == "hdfs://host:9000/x"
    with pytest.raises(ValueError):
        warc.address("ftp://host/x")


def test_rows_that_are_no_copies_stay(spark):
    """Blank texts are linked with nothing, so all their rows stay, whatever ids they lack or share; of rows that repeat id and text one stays."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, "", "a"), (None, " ", "b"), (None, None, "c"), (7, "", "d"), (7, "", "e"), (3, text, "f"), (5, text, "g"), (None, text, "h")]
    rows += [(9, "quite another text of six words", "i")] * 2 + [(9, "quite another text of six words", "j"), (9, "and one more for the same id", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(r.row_key for r in kept.collect())
    assert [k for k in got if k in "abcdefghk"] == list("abcdefk") and len(got) == 8 and got[-2] in "ij"
    assert sorted(r.row_key for r in ngram_join.one_of_each(docs.repartition(3)).collect()) == got


def test_mix_reaches_its_target_with_ids_that_lack_or_repeat(spark):
    rows = [(None if i % 3 == 0 else i % 100, f"{i} " + "w " * 9, "a" if i % 2 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    report = mixing.mix_report(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    for r in mixing.mix_report(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 10
    assert report
    assert mixing.mixed(docs).count() * 10 == sum(r.taken for r in report)


def test_pipeline_stages(spark):
    """Each stage keeps what its operator says, and the columns of the documents."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "n-gram Jaccard join"
    toxic = {r.doc_id for r in toxicity.report(docs, labels).collect() if r.predicted}
    poor = {r.doc_id for r in quality.report(docs, labels).collect() if not r.predicted}
    copies = {r.doc_id for r in ngram_join.near_duplicates(docs).collect() if r.component_id != r.doc_id}
    for (_, stage), gone in zip(corpus_pipeline.STAGES, (toxic, poor, copies)):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in gone)
    assert corpus_pipeline.STAGES[3][1](spark, docs, SF).columns == docs.columns


def test_pipeline_runs_whole(spark):
    con = connect(SF)
    rows = corpus_pipeline.run(spark, SF).collect()
    total = con.sql("select count(*) from documents").fetchall()[0][0]
    assert 0 < len({r.doc_id for r in rows}) < total
    texts = {i: t for i, t in con.sql("select doc_id, text from documents").fetchall()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_every_operator_has_its_query():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)]
