"""Streams against their batch twins, over a restart, and with a repeated micro-batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.operators import dedup as D
from orderflow.operators import late as L
from orderflow.operators import validate as V
from orderflow.plans import inputs as I
from orderflow.plans import stream_queries as Z
from orderflow.schemas import RAW_ORDER
from orderflow.session import child_names, scratch_path
from orderflow.streaming import jobs as J
from orderflow.streaming import panes as P
from orderflow.streaming import sinks as K
from orderflow.streaming.dedup import flag_batch_duplicates
from orderflow.streaming.memory import AcceptedKeys
from orderflow.streaming.records import UpsertedRecords
from orderflow.streaming.runs import bits_of, has_bits

SF = "/root/testdata/sf0.001"


def test_outcomes_over_restarts_equal_the_batch_twin(spark):
    """Four runs from one checkpoint; a month of arrivals passes the 24-hour memory many times."""
    raw = I.raw_orders(spark, SF)
    root = scratch_path(spark, "outcomes")
    write = J.write_outcomes(root, at=I.processed_at())
    Z.replay(raw, lambda s, ck: K.write_each(s, write, ck, None), n=4)
    outcomes = J.read_outcomes(spark, root)
    assert outcomes.count() == raw.count()
    valid = I.staged(I.valid_orders(spark, SF).select("order_id", "arrival_seq", "arrival_ts"), "valid")
    twin = D.dedup_first(valid).select("order_id", "arrival_seq")
    assert twin.count() > valid.select("order_id").distinct().count()
    processed = outcomes.filter("outcome = 'processed'").select("order_id", "arrival_seq")
    assert processed.count() == twin.count()
    assert twin.exceptAll(processed).isEmpty()
    assert J.dlq_of(outcomes).filter("error_type = 'DUPLICATE'").count() == valid.count() - twin.count()
    assert J.processed_of(outcomes).filter("tax is null or event_time is null").isEmpty()


def test_memory_expires_over_generations(spark):
    """Forty micro-batches pass two merges of segments; a repeated micro-batch gives the same answer."""
    memory = scratch_path(spark, "accepted")
    got = []
    for n in range(40):
        batch = spark.createDataFrame(
            [("same", n * 10, n), (f"only-{n}", n * 10, n)], "order_id string, sec bigint, arrival_seq bigint"
        ).withColumn("arrival_ts", F.timestamp_seconds("sec"))
        for _ in range(2 if n % 16 in (0, 5) else 1):
            rows = {r["order_id"]: r["is_dup"] for r in flag_batch_duplicates(batch, n, memory, ttl_seconds=35).collect()}
        assert rows[f"only-{n}"] is False
        got.append(rows["same"])
    assert got == [n % 4 != 0 for n in range(40)]
    assert len(child_names(spark, f"{memory}/recent")) <= 16 and len(child_names(spark, f"{memory}/merged")) <= 2


def test_reads_follow_the_micro_batch(spark, monkeypatch):
    """Forty micro-batches of 500 ids, 3 of them seen before: the answers are those of the batch twin, and what is read of merged segments
    is the buckets of repeated ids (or of the few that pass a filter by chance), however much is remembered."""
    read = []
    monkeypatch.setattr(AcceptedKeys, "hit_buckets", lambda self, *a, f=AcceptedKeys.hit_buckets: (read.append(f(self, *a)), read[-1])[1])
    memory, schema, every, flagged = scratch_path(spark, "accepted"), "order_id string, sec bigint, arrival_seq bigint", [], []
    segments = []
    for n in range(40):
        ids = [500 * n + i for i in range(500)] + [500 * (n // 2) + i for i in range(3) if n > 1]
        rows = [(f"ORD-{k}", 60 * n + i // 10, 1000 * n + i) for i, k in enumerate(ids)]
        every += rows
        batch = spark.createDataFrame(rows, schema).withColumn("arrival_ts", F.timestamp_seconds("sec"))
        for _ in range(2 if n in (4, 16) else 1):
            out = flag_batch_duplicates(batch, n, memory, ttl_seconds=3600, fan=4, buckets=16).select("arrival_seq", "is_dup").collect()
        flagged += out
        segments.append(len(AcceptedKeys(spark, memory, 3600, 4, 16).segments()))
    whole = spark.createDataFrame(every, schema).withColumn("arrival_ts", F.timestamp_seconds("sec"))
    twin = D.flag_duplicates(whole, ttl_seconds=3600).select("arrival_seq", "is_dup").collect()
    assert sorted(map(tuple, flagged)) == sorted(map(tuple, twin))
    assert sum(r.is_dup for r in flagged) == 3 * 38
    # A micro-batch meets up to seven segments of 16 buckets; 3 repeated ids and about 1 in 400 strangers a segment hit few.
    assert max(segments) >= 4 and len(read) >= 36
    assert max(map(len, read)) <= 24 and sum(map(len, read[-5:])) <= sum(map(len, read[10:15])) + 40


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("_key"))
    index = keys.select(F.explode(bits_of(F.col("_key"))).alias("place")).agg(F.bitmap_construct_agg("place").alias("bitmap"))
    asked = keys.unionByName(spark.range(3000, 9000).select(F.concat(F.lit("k"), "id").alias("_key")))
    passed = asked.join(index).filter(has_bits(F.col("bitmap"), bits_of(F.col("_key")))).select("_key").collect()
    own = [r for r in passed if int(r[0][1:]) < 3000]
    assert len(own) == 3000 and len(passed) - len(own) < 0.03 * 6000


def test_tied_arrivals_are_told_apart_by_their_rows(spark):
    """Of rows that share key and arrival one is accepted, the same one in any run, in batches and in streams."""
    rows = [("a", 5, 1, f"payload-{i}") for i in range(6)] + [("a", 9, 2, "later"), ("b", 5, 1, "x"), (None, 5, 1, "n"), (None, 5, 1, "m")]
    table = spark.createDataFrame(rows, "order_id string, sec bigint, arrival_seq bigint, payload string")
    table = table.withColumn("arrival_ts", F.timestamp_seconds("sec"))
    wanted = None
    for turn in range(3):
        dealt = table.orderBy(F.xxhash64("payload", F.lit(turn))).repartition(3)
        flagged = D.flag_duplicates(dealt)
        streamed = flag_batch_duplicates(dealt, 0, scratch_path(spark, "accepted"))
        got = sorted(r.payload for r in flagged.filter("not is_dup").collect())
        assert got == sorted(r.payload for r in streamed.filter("not is_dup").collect())
        assert len(got) == 3 and (wanted is None or got == wanted)
        wanted = got
        again = sorted(r.payload for r in D.flag_duplicates(dealt).filter("is_dup").collect())
        assert sorted(got + again) == sorted(r[3] for r in rows)


def test_memory_survives_a_generation_that_begins_without_valid_rows(spark):
    """Micro-batches 16 and 32 hold only rejected records, 16 is repeated; the memory of before is still met."""
    memory = scratch_path(spark, "accepted")
    got = {}
    for n in (14, 15, 16, 16, 17, 31, 32, 33):
        rows = [] if n % 16 == 0 else [("same", n, n), (f"only-{n}", n, n)]
        batch = spark.createDataFrame(rows, "order_id string, sec bigint, arrival_seq bigint")
        batch = batch.withColumn("arrival_ts", F.timestamp_seconds("sec"))
        got[n] = {r["order_id"]: r["is_dup"] for r in flag_batch_duplicates(batch, n, memory, ttl_seconds=1000).collect()}
    assert got[16] == got[32] == {}
    assert [got[n]["same"] for n in (14, 15, 17, 31, 33)] == [False, True, True, True, True]
    assert not any(got[n][f"only-{n}"] for n in (14, 15, 17, 31, 33))


def test_null_order_id_is_a_schema_error(spark):
    text = '{"order_id":null,"customer_id":"CUST-US-1","amount":"5","currency":"USD","status":"shipped","timestamp":"2024-01-01","items_count":1}'
    row = V.validate_orders(spark.createDataFrame([(text,)], "value string")).first()
    assert (row["error_type"], row["error_message"]) == ("SCHEMA_INVALID", "Unexpected error: order_id is null")


def test_long_dead_letter_is_replayed_whole(spark):
    good = '{"order_id":"O","customer_id":"CUST-US-1","amount":"5","currency":"USD","status":"shipped","timestamp":"2024-01-01","items_count":1}'
    text = " " * 20_000 + good.replace("customer_id", "cust_id")
    dlq = V.to_dlq(V.route(V.validate_orders(spark.createDataFrame([(text,)], "value string")))[1], F.lit("now"))
    row = dlq.first()
    assert len(row["original_message"]) == 10_000 and row["full_message"] == text
    found, bad = V.replay_dlq(dlq, {"customer_id": ["cust_id"]})
    assert [r["order_id"] for r in found.collect()] == ["O"] and bad.isEmpty()


def test_upsert_log_is_compacted(spark):
    path = scratch_path(spark, "upsert")
    write = K.upsert_by_key(path, ["k"], "v")
    schema = "k string, v bigint, w string"
    for n in range(40):
        for _ in range(2 if n % 16 in (0, 3) else 1):
            write(spark.createDataFrame([(f"k{n % 3}", n if n != 39 else 0, f"w{n}")], schema), n)
    got = sorted(map(tuple, K.read_upserted(spark, path, ["k"], schema, "v").collect()))
    assert got == [("k0", 36, "w36"), ("k1", 37, "w37"), ("k2", 38, "w38")]
    assert len(child_names(spark, path)) <= 2


def test_repeated_batch_changes_nothing(spark):
    path = scratch_path(spark, "upsert")
    write = K.upsert_by_key(path)
    schema = "k string, v bigint"
    write(spark.createDataFrame([("a", 1), ("b", 1)], schema), 0)
    write(spark.createDataFrame([("a", 2)], schema), 1)
    want = [("a", 2), ("b", 1)]
    assert sorted(map(tuple, K.read_upserted(spark, path, ["k"], schema).collect())) == want
    write(spark.createDataFrame([("a", 2)], schema), 1)
    assert sorted(map(tuple, K.read_upserted(spark, path, ["k"], schema).collect())) == want


def test_empty_batch_archives_nothing(spark):
    path = scratch_path(spark, "archive")
    empty = spark.createDataFrame(
        [], "value string, topic string, partition int, offset bigint, timestamp bigint"
    )
    K.archive_messages(path)(empty, 0)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_only_the_window_query_has_a_watermark(spark):
    """Late orders must reach the processed output, so nothing upstream of it may drop them."""
    empty = scratch_path(spark, "empty")
    I.raw_orders(spark, SF).limit(0).write.parquet(empty)
    stream = spark.readStream.schema(RAW_ORDER).parquet(empty)
    outcomes = J.with_outcome_text(stream)
    assert "EventTimeWatermark" not in outcomes._jdf.queryExecution().analyzed().toString()
    windows = J.region_windows(J.processed_of(outcomes.withColumn("outcome", F.lit("processed"))))
    assert "EventTimeWatermark" in windows._jdf.queryExecution().analyzed().toString()


def test_panes_equal_the_batch_versions_over_repeated_micro_batches(spark):
    """Seven micro-batches, one of them repeated and one empty: the versions of closed windows are those of the batch operator, and few panes stay open."""
    rows = I.staged(I.processed_orders(spark, "/root/testdata/sf0.01", columns=["event_time", "region", "amount"]).drop("order_id"), "rows")
    root = scratch_path(spark, "panes")
    write = P.pane_batches(root)
    for n, part in enumerate([*Z.chunks(rows, "arrival_seq", 6), rows.limit(0)]):
        for _ in range(2 if n == 3 else 1):
            write(part, n)
        assert 0 < spark.read.parquet(f"{root}/panes/batch_id={n}").count() < 60
    newest = rows.agg(F.max("event_time")).first()[0]
    closed = F.unix_seconds("window_end") + 600 <= F.unix_micros(F.lit(newest)) / 1_000_000
    batch = L.windows_with_corrections(rows).filter(closed)
    columns = ["region", "window_start", "version", "is_correction", "total_orders", "total_amount", "max_order_value", "avg_order_value"]
    streamed = P.read_versions(spark, root).select(*columns)
    assert streamed.count() == batch.count() and streamed.filter("version > 1").count() >= 30
    assert batch.select(*columns).exceptAll(streamed).isEmpty()


def test_lookups_open_only_the_buckets_of_their_keys(spark):
    """Thirty upserts of 400 records: lookups equal the whole table, also after a repeated micro-batch, and open a few of many files."""
    from pyspark.sql.types import StructType

    schema = StructType().add("k", "long").add("part", "string").add("v", "long").add("w", "string")
    store = UpsertedRecords(spark, scratch_path(spark, "records"), ["k", "part"], schema, "v", fan=4, buckets=16)
    newest = {}
    for n in range(30):
        rows = [((n * 397 + 7 * i) % 3000, None if i % 9 == 0 else f"p{i % 2}", (n * 31 + i) % 50, f"{n}-{i}") for i in range(400)]
        for _ in range(2 if n in (8, 16, 17) else 1):
            store.write(spark.createDataFrame(rows, schema), n)
        for k, part, v, w in rows:
            newest[k, part] = max(newest.get((k, part), (-1,)), (v, n, w))
    table = store.table().collect()
    assert {(r.k, r.part): (r.v, r.w) for r in table} == {key: (v, w) for key, (v, _, w) in newest.items()} and len(table) == len(newest)
    some = [*list(newest)[:3], (10**9, "p0"), (5, "nowhere")]
    asked = spark.createDataFrame(some, "k bigint, part string")
    found = {(r.k, r.part): (r.v, r.w) if r.found else None for r in store.lookup(asked).collect()}
    assert found == {key: newest[key][::2] if key in newest else None for key in some}
    opened = store.folders_of(asked.select(store.key_of().alias("_key")))
    assert len(store.segments()) >= 4 and len(opened) < 0.35 * 16 * (len(store.segments()) + len(store.recent(store.segments(), 99)))
