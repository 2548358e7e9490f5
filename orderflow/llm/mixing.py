"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every source gets a target, and a document is taken a whole number of times: ``rounds`` times for all
documents of its source and once more if the hash of its id, source and text lies at or below its source's threshold. The
threshold comes from nested histograms: sizes are summed by source and by the leading bits of the hash,
the bucket in which the budget ends is found from at most 1,024 sums a source, and only the documents of
that bucket are looked at again with the next bits. Nothing is sorted by hash, and a source that holds a
third of all rows is reduced on the map side to one sum a bucket.

Thresholds are nested: a larger budget takes a superset of the documents, and a rerun the same ones.

Defined cases: a null source is a source of its own, ranked last; a null text has size 0; rows with the
same id, source and text share a hash and are taken or left together, all others are taken one by one, whatever ids they repeat or lack; a source without words has target 0; an empty table
gives an empty result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.common import WORD, free_name, stored

HASH_BITS, LEVEL_BITS = 60, 10
MOST_REPEATS = 3


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_of(*columns: str) -> Column:
    """60 bits of MD5: the same in every engine."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws("|", *texts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``rank`` of each source by code point, null last, from 0. Sources are dealt by range and counted
    per range, so many sources do not meet in one task; only one count a range does."""
    dealt = stored(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        dealt.withColumn("at", F.row_number().over(within))
        .join(starts, "part")
        .withColumn("rank", F.col("start") + F.col("at") - 1)
        .drop("part", "start", "at")
    )


def water_level(sources: DataFrame) -> float:
    """The level at which the shares ``min(cap, level * weight)`` add up to all sizes. The excess over the caps
    is reshared by weight until none is above; each step is one aggregate over the sources."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / (weights or 1)
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, free = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
        ).first()
        if not free:
            return level
        following = (total - capped) / free
        if following <= level:
            return level
        level = following


def targets(slim: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source: ``source, source_size, target, rounds, budget``."""
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = stored(
        ranked_sources(sources)
        .withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")).cast("bigint"))
        .withColumn("cap", F.col("source_size") * MOST_REPEATS),
        "mix-ranked",
    )
    share = F.least(F.col("cap").cast("double"), F.lit(water_level(ranked)) * F.col("weight"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        ranked.withColumn("target", share)
        .withColumn("rounds", rounds.cast("bigint"))
        .withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
        .select("source", "source_size", "target", "rounds", "budget")
    )


def thresholds(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``threshold``: documents whose hash is at or below it are taken once more.

    Whole documents are taken in the order of their hashes while the budget lasts; the first that no
    longer fits is taken too if that ends nearer to the budget."""
    wanted = plan.select("source", F.col("budget").alias("left"), F.lit(0).cast("bigint").alias("low"))
    rows = slim.filter(F.col("size") > 0)
    ends = []
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("hash", shift)
        held = rows.join(
            wanted.select(F.col("source").alias("of"), "left", "low"), F.col("source").eqNullSafe(F.col("of"))
        ).drop("of")
        if shift < HASH_BITS - LEVEL_BITS:  # only the boundary bucket is looked at again
            held = held.filter(F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS))
        sums = held.groupBy("source", "left", bucket.alias("bucket")).agg(
            F.sum("size").alias("mass"), F.min("hash").alias("least"), F.max("hash").alias("most")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        run = sums.withColumn("through", F.sum("mass").over(order)).withColumn("before", F.col("through") - F.col("mass"))
        # The bucket in which the budget ends; a budget beyond all of them has none.
        edge = run.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("through")))
        edge = stored(
            edge.select(
                "source",
                (F.col("left") - F.col("before")).alias("left"),
                F.shiftleft("bucket", shift).alias("low"),
                "mass",
                (F.col("least") == F.col("most")).alias("single"),
                F.col("least").alias("only"),
            ),
            "mix-edge",
        )
        # One hash value is left: it is taken whole if that ends nearer to the budget.
        nearer = F.col("mass") - F.col("left") < F.col("left")
        ends.append(
            edge.filter("single").select("source", F.when(nearer, F.col("only")).otherwise(F.col("only") - 1).alias("threshold"))
        )
        wanted = edge.filter(~F.col("single")).select("source", "left", "low")
        if wanted.isEmpty():
            break
    found = reduce(DataFrame.unionByName, ends).select(F.col("source").alias("of"), "threshold")
    # Without a boundary the budget covers all documents, or there are none.
    return (
        plan.join(found, F.col("source").eqNullSafe(F.col("of")), "left")
        .drop("of")
        .withColumn("threshold", F.coalesce("threshold", F.lit((1 << HASH_BITS) - 1)))
    )


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """The sizes and hashes of all documents (``doc_id, source, size, hash``), and one row a source with
    ``source_size, target, rounds, threshold``. Both are stored."""
    slim = stored(
        docs.select("doc_id", "source", size_of("text").alias("size"), hash_of("doc_id", "source", "text").alias("hash")), "mix-sizes"
    )
    plan = stored(thresholds(slim, stored(targets(slim, weights), "mix-targets")), "mix-plan")
    return slim, plan


def copies() -> Column:
    return F.col("rounds") + F.when(F.col("hash") <= F.col("threshold"), F.lit(1)).otherwise(F.lit(0))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    slim, plan = mix_plan(docs, weights)
    return slim.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    plan = mix_plan(docs, weights)[1]
    names = {c: free_name(docs, c) for c in ("rounds", "threshold", "of", "hash", "copy")}
    per_source = plan.select(
        F.col("source").alias(names["of"]), F.col("rounds").alias(names["rounds"]), F.col("threshold").alias(names["threshold"])
    )
    extra = F.when(hash_of("doc_id", "source", "text") <= F.col(names["threshold"]), F.lit(1)).otherwise(F.lit(0))
    times = (F.col(names["rounds"]) + extra).cast("int")
    return (
        docs.join(per_source, docs["source"].eqNullSafe(F.col(names["of"])))
        .withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), times)))
        .select(*[docs[c] for c in docs.columns])
    )


REPORT_SQL = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, ''), coalesce(source, ''), coalesce(text, ''))), 1, 15))::bigint as hash
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s as (select *, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s0),
k as (select *, row_number() over (order by source_size / weight, source nulls last) as k, sum(source_size) over () as total from s),
r as (select *, (total - sum(3 * source_size) over (order by k) + 3 * source_size)::double
              / (sum(weight) over (order by k rows between current row and unbounded following))::double as share from k),
l as (select coalesce(min_by(share, k) filter (share < 3 * source_size / weight), max(3 * source_size / weight)) as level from r),
t as (select source, source_size, least(3 * source_size::double, level * weight) as target from s, l),
p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as rounds from t),
b as (select *, target - rounds * source_size as budget from p),
h as (select source, hash, sum(size) as mass from d where size > 0 group by source, hash),
c as (select source, hash, mass, sum(mass) over (partition by source order by hash) as through from h),
e as (select b.source, max(case when through <= budget or (through - mass <= budget and through - budget < budget - (through - mass))
                          then hash end) as threshold
      from b join c on b.source is not distinct from c.source group by b.source)
select doc_id, size, source_size, target,
       (size * (rounds + case when hash <= threshold then 1 else 0 end))::bigint as taken
from d join b on d.source is not distinct from b.source left join e on d.source is not distinct from e.source
"""
