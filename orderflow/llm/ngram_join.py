"""Similarity self-join of documents on word n-grams by parity sketches.

A document's set are its distinct ``K``-word shingles. A sketch cuts the space of shingle hashes into parts; each part's word is the exclusive
or of the hashes that fall into it, so a shingle in one of two sets changes one word, and the number of words in which two sketches differ is
a lower bound of the symmetric difference of the sets. Sets of ``a`` and ``b`` shingles with Jaccard similarity of 3/4 or more differ in at
most ``(a + b) / 7`` shingles. By the pigeonhole principle, of any ``(a + b) / 7 + 1 + t`` words of one sketch that are not empty at least
``1 + t`` are equal in the other. So each document emits as many words as its largest possible difference needs, plus one, plus an eighth (``spare``),
in an order common to all documents, and documents that share fewer than ``1 + t`` words cannot be similar. The eighth keeps out documents that
have only a passage in common.

Sizes are banded by powers of two, each band with its own number of parts; a document whose partners may lie in the next band emits words
of that band too. Parts are ordered so that frequent shingles, counted over all documents, come last: passages that many documents share then
make few candidates. The counts set only the order, and any order gives the same result.

The steps, over whole tables:

1. Words are reduced to those that two different sets share. Equal sets count as one from here on: a set is known by a hash of its shingles.
2. Documents with enough shared words keep these words, their shingles and a short bit sketch. Which words are shared is tested by a Bloom filter of
   fixed size; words that it lets through wrongly meet no partner.
3. In rounds, sets meet one hub of their words, and verified links join components. Then all pairs of sets that share a word and lie
   in different components are compared: by a join for words of few sets, so that no row makes more than ``HOT`` pairs, and in blocks
   for words of many. So no link between components is lost, and a large group of near copies is joined through some of its members
   rather than through all of its pairs.
4. Candidates pass a size test, then a Hamming test on the bit sketches, then the exact test on the shingles.

Hashes have 64 bits; the words of a document suffice unless over a third of its shingles fall into shared parts, which for the chosen numbers of
parts has a probability below 1e-8.

Defined cases: a null text, an empty text and a text without words have an empty set and are linked with nothing; fewer than ``K`` words are one
shingle; repeated rows and ids are documents of their own with equal sets, and so linked; rows with a null id take part and may have a null
component; an empty table gives an empty result. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.arrays import mix, runs, words
from orderflow.llm.common import WORD, free_name, pieces, release_shuffles, small_batches, spans, stored, text_array
from orderflow.llm.components import components

K = 5
#: Similar are sets with ``DEN * intersection >= NUM * union``.
NUM, DEN = 3, 4
#: Bands of smaller sets have a part for each shingle.
SMALL_BAND = 5
SKETCH_BITS = 2048
FILTER_BITS = 1 << 26
#: Buckets in which shingles are counted together before the frequent ones are counted one by one.
BUCKETS = 1 << 24
#: Bytes of text that a step works on at once; its arrays take about 50 times as many, and what a Python worker once took it mostly keeps.
PIECE = 1 << 18
#: Words of more sets are not joined with themselves; their sets are compared in blocks.
HOT = 100


def shingle_sets(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and their numbers."""
    hashes, counts = words(body, at, lower=True)
    found, n = runs(hashes, counts, K)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        found[a:b].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = found[1:] != found[:-1]
    fresh[(ends - n)[n > 0]] = True
    row = np.repeat(np.arange(len(n)), n)
    return found[fresh], np.bincount(row[fresh], minlength=len(n)).astype(np.int64)


def set_hashes(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        starts = (np.cumsum(n) - n)[some]
        out[some] = mix(np.add.reduceat(mix(tokens), starts) ^ mix(np.bitwise_xor.reduceat(tokens, starts) + n[some].astype(np.uint64)))
    return out.view(np.int64)


def most_different(n: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of a set of ``n`` and any similar set."""
    return (n + n * DEN // NUM) * (DEN - NUM) // (DEN + NUM)


def spare(n: np.ndarray) -> np.ndarray:
    """Words emitted beyond the necessary; at least one more than the smaller of two sets' numbers is equal if they are similar."""
    return most_different(n) // 8


def least_shared(n: np.ndarray) -> np.ndarray:
    """Words that a set of ``n`` shares with any similar set, at least."""
    return 1 + spare(np.maximum(1, -(-n * NUM // DEN)))


def band(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1]


def sketch_words(tokens: np.ndarray, n: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The emitted words of each set's sketches, the row each belongs to, and how many of its words each set shares with any similar
    set at least.

    A set with enough words of rare shingles emits only such. Any other emits all of them, every rare shingle by itself, and, unless over a
    quarter of its shingles are rare, words of frequent shingles. Two such sets that share no rare shingle differ in all of them; a similar set
    lacks a quarter of a set's shingles at most, so frequent ones need be looked at only there and only in few words.
    """
    out, rows = [], []
    least = least_shared(n)
    late = np.zeros(len(tokens), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
    own = band(n)
    upper = band(np.maximum(n * DEN // NUM, 1))
    for bands, takes in ((own, n > 0), (upper, (n > 0) & (upper > own))):
        row = np.flatnonzero(takes)
        if not len(row):
            continue
        size = n[row]
        where = spans((np.cumsum(n) - n)[row], size)
        held, behind = tokens[where], late[where]
        of = np.repeat(np.arange(len(row)), size)
        if behind.any():
            order = np.argsort(of * 2 + behind, kind="stable")
            held, behind = held[order], behind[order]
        level = bands[row]
        parts = np.where(level <= 9, 1 << level, 1 << (level - 1)).astype(np.uint64)
        part = (held >> np.uint64(32)) * np.repeat(parts, size) >> np.uint64(32)
        opens = np.ones(len(held), bool)
        opens[1:] = (of[1:] != of[:-1]) | (behind[1:] != behind[:-1]) | (part[1:] != part[:-1])
        opens |= np.repeat(level <= SMALL_BAND, size)
        starts = np.flatnonzero(opens)
        word = np.bitwise_xor.reduceat(held, starts)
        holder, is_late = of[starts], behind[starts]
        salt = mix(level.astype(np.uint64) + np.uint64(1))
        place = np.arange(len(starts)) - np.searchsorted(holder, np.arange(len(row)))[holder]
        rare_words = np.bincount(holder[~is_late], minlength=len(row))
        rare = np.bincount(of[~behind], minlength=len(row))
        most, more = most_different(size), spare(size)
        short = rare_words < most + 1 + more
        few = np.where(short, np.where(rare * DEN <= size * (DEN - NUM), rare_words + most - rare + 1 + more, rare_words), most + 1 + more)
        keep = place < few[holder]
        out.append(mix(word[keep] ^ salt[holder[keep]]))
        rows.append(row[holder[keep]])
        alone = short[of] & ~behind & (level > SMALL_BAND)[of]
        out.append(mix(held[alone] ^ mix(salt)[of[alone]]))
        rows.append(row[of[alone]])
        least[row[short]] = 1
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), least
    return np.concatenate(out), np.concatenate(rows), least


def bit_sketches(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``SKETCH_BITS`` parity bits of each set: each shingle flips one."""
    out = np.zeros((len(n), SKETCH_BITS // 8), np.uint8)
    ends = np.cumsum(n)
    place = (tokens >> np.uint64(8)).astype(np.int64) % SKETCH_BITS
    for a in range(0, len(n), 128):
        size = n[a : a + 128]
        own = place[ends[a] - n[a] : ends[a + len(size) - 1]]
        row = np.repeat(np.arange(len(size)), size)
        flips = np.bincount(row * SKETCH_BITS + own, minlength=len(size) * SKETCH_BITS) & 1
        out[a : a + 128] = np.packbits(flips.astype(np.uint8).reshape(len(size), SKETCH_BITS), axis=1)
    return out


def buckets_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (tokens & np.uint64(buckets - 1)).astype(np.int64)


def bucket_counts(sets: Iterator[np.ndarray], buckets: int, blocks: int, most_over: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """How many shingles fall into each bucket: blocks (their number, their counts) with any, which may come more than once.

    A bucket has a byte, and each full 256 go into a list. It gets an entry for 256 shingles at most; with ``most_over`` entries all is
    handed on and counting starts anew. So memory is bounded, whatever the number of shingles and however frequent one is."""
    each = buckets // blocks
    low, over_at, over, entries = np.zeros(buckets, np.uint8), [], [], 0

    def counted() -> Iterator[tuple[int, np.ndarray]]:
        at, n = np.concatenate([*over_at, np.zeros(0, np.int64)]), np.concatenate([*over, np.zeros(0, np.int64)])
        order = np.argsort(at)
        at, n = at[order], n[order]
        bounds = np.searchsorted(at, np.arange(blocks + 1) * each)
        for block in range(blocks):
            own, some = low[block * each : (block + 1) * each], slice(bounds[block], bounds[block + 1])
            if own.any() or some.start < some.stop:
                counts = own.astype(np.uint32)
                np.add.at(counts, at[some] - block * each, n[some].astype(np.uint32) << np.uint32(8))
                yield block, counts

    for tokens in sets:
        at, n = np.unique(buckets_of(tokens, buckets), return_counts=True)
        n = n + low[at]
        low[at] = n & 255
        full = n > 255
        if full.any():
            over_at.append(at[full])
            over.append(n[full] >> 8)
            entries += len(over[-1])
        if entries >= most_over:
            yield from counted()
            low[:] = 0
            over_at, over, entries = [], [], 0
    yield from counted()


def full_buckets(docs: DataFrame, bound: int, buckets: int = BUCKETS, blocks: int = 2048) -> np.ndarray:
    """A bit for each bucket of shingle hashes: whether it holds ``bound`` shingles of all documents together, or more.

    A task counts in an array of fixed size and sends the counts in blocks, which are added up block by block. So what is shuffled follows the
    number of tasks and not of shingles, and no task holds more than its array."""
    each = buckets // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_content_size=True)
        sets = (shingle_sets(*text_array(part["text"]))[0] for batch in batches for part in pieces(batch, "text", PIECE))
        found = bucket_counts(sets, buckets, blocks)
        while some := [(block, press.compress(counts.tobytes())) for block, counts in islice(found, 64)]:
            block, packed = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total, plain = np.zeros(each, np.int64), zstandard.ZstdDecompressor().decompress
        for packed in table["counts"]:
            total += np.frombuffer(plain(packed.as_py()), np.uint32)
        return pa.table({"block": table["block"][:1], "full": pa.array([np.packbits(total >= bound).tobytes()], pa.binary())})

    sums = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, full binary")
    rows = sums.toArrow()  # a bit a bucket
    out = np.zeros((blocks, each // 8), np.uint8)
    for block, full in zip(rows["block"].to_pylist(), rows["full"].to_pylist()):
        out[block] = np.frombuffer(full, np.uint8)
    return out.reshape(-1)


def shingles_in(docs: DataFrame, full) -> DataFrame:
    """``token``: the shingles of each document's set that fall into full buckets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = full.value
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                tokens, _ = shingle_sets(*text_array(part["text"]))
                at = buckets_of(tokens, 8 * len(bits))
                tokens = tokens[bits[at >> 3] >> (7 - (at & 7)) & 1 == 1]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    return docs.select("text").mapInArrow(emit, "token bigint")


def frequent_shingles(docs: DataFrame, least_share: float = 0.0004, most: int = 500_000, buckets: int = BUCKETS) -> np.ndarray:
    """Shingles in at least ``least_share`` of all documents, sorted; the ``most`` most frequent of them. They only order the parts.

    A frequent shingle fills its bucket alone, so only the shingles in full buckets are counted one by one, and most of the others never
    leave their task. Buckets are too few to tell them apart where documents have over ``least_share * buckets`` shingles on average; the
    counts are the same there, but nearly all shingles are shuffled."""
    bound = max(4, int(least_share * docs.count()))
    full = docs.sparkSession.sparkContext.broadcast(full_buckets(docs, bound, buckets))  # a bit a bucket
    rows = (
        shingles_in(docs, full).groupBy("token").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= bound).orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()
    )
    full.destroy()
    return np.sort(rows["token"].to_numpy().view(np.uint64))


def shared_words(docs: DataFrame, frequent) -> DataFrame:
    """Sketch words of two different sets or more. The grouped minimum and maximum are formed before the shuffle too, so a word of
    very many documents is one row a task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                tokens, n = shingle_sets(*text_array(part["text"]))
                word, row, _ = sketch_words(tokens, n, frequent.value)
                node = set_hashes(tokens, n)[row]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(node)], names=["word", "node"])

    rows = docs.select("text").mapInArrow(emit, "word bigint, node bigint")
    return rows.groupBy("word").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("word")


def _probes(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (word & mask).astype(np.int64), (word >> np.uint64(32) & mask).astype(np.int64)


def word_filter(shared: DataFrame) -> np.ndarray:
    """A Bloom filter of the words with ``FILTER_BITS`` bits, whatever their number."""
    mask = F.lit(FILTER_BITS - 1).cast("bigint")
    probes = F.array(F.col("word").bitwiseAND(mask), F.shiftrightunsigned("word", 32).bitwiseAND(mask))
    bits = shared.select(F.explode(probes).alias("bit"))
    rows = (
        bits.groupBy(F.shiftright("bit", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out


_ROWS = "row bigint, key {kind}, n bigint, least bigint, node bigint, words array<bigint>, tokens array<bigint>, sketch array<bigint>"


def shingled(docs: DataFrame, frequent, shared) -> DataFrame:
    """One row a document; those with a word that may be shared have these words, their shingles and a bit sketch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                tokens, n = shingle_sets(*text_array(part["text"]))
                node = set_hashes(tokens, n)
                word, row, least = sketch_words(tokens, n, frequent.value)
                one, two = _probes(word)
                may = (bits[one >> 6] >> (one & 63)) & (bits[two >> 6] >> (two & 63)) & 1 == 1
                word, row = word[may], row[may]
                # Equal sets of this piece need their words once.
                _, first = np.unique(node, return_index=True)
                carries = np.zeros(len(n), bool)
                carries[first] = True
                word, row = word[carries[row]], row[carries[row]]
                per = np.bincount(row, minlength=len(n))
                enough = (per >= least)[row]
                word, row = word[enough], row[enough]
                order = np.argsort(row, kind="stable")
                word, per = word[order], np.bincount(row, minlength=len(n))
                some = np.flatnonzero(per > 0)
                held, size = tokens[spans((np.cumsum(n) - n)[some], n[some])], n[some]
                sketch = bit_sketches(held, size).view(np.int64).reshape(-1)
                none = per == 0

                def lists(values, counts):
                    offsets = np.zeros(len(n) + 1, np.int32)
                    full = np.zeros(len(n), np.int64)
                    full[some] = counts
                    np.cumsum(full, out=offsets[1:])
                    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(none))

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(len(n), dtype=np.int64)),
                        part["key"],
                        pa.array(n),
                        pa.array(least),
                        pa.array(node),
                        lists(word.view(np.int64), per[some]),
                        lists(held.view(np.int64), size),
                        lists(sketch, SKETCH_BITS // 64),
                    ],
                    names=["row", "key", "n", "least", "node", "words", "tokens", "sketch"],
                )
                number += len(n)

    kind = docs.schema["key"].dataType.simpleString()
    return stored(docs.select("key", "text").mapInArrow(emit, _ROWS.format(kind=kind)), "shingled")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a, b``) of similar sets. Shingles are fetched only for pairs that pass the bounds on size and bit sketch."""
    slim = sets.select("node", "n", "sketch")

    def attach(left: DataFrame, right: DataFrame, side: str) -> DataFrame:
        named = right.select(*[F.col(c).alias(f"{c}_{side}") for c in right.columns])
        return left.join(named, F.col(side) == F.col(f"node_{side}")).drop(f"node_{side}")

    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = (
        attach(attach(pairs, slim, "a"), slim, "b")
        .filter(DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b"))
        .filter((DEN + NUM) * apart <= (DEN - NUM) * (F.col("n_a") + F.col("n_b")))
        .select("a", "b", "n_a", "n_b")
    )
    tokens = sets.select("node", "tokens")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return (
        attach(attach(close, tokens, "a"), tokens, "b")
        .filter(DEN * both >= NUM * (F.col("n_a") + F.col("n_b") - both))
        .select("a", "b")
    )


def open_rows(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, node, root`` of what is left to compare, for words of up to ``HOT`` sets and of more. ``live`` has a row for each set
    and word, with the set's ``least`` and the number of sets that hold the word.

    Similar sets share ``least`` words or more, so they share one even without the ``least - 1`` most common of each set. Of words that
    are then held by the same sets one is enough, which leaves about one word for each pair of near copies."""
    own = Window.partitionBy("node")
    rare = stored(
        live.withColumn("rank", F.row_number().over(own.orderBy("held", "word")))
        .withColumn("all", F.count("*").over(own))
        .filter("rank <= all - least + 1")
        .select("word", "node", "root"),
        "open-words",
    )
    members = F.sum(F.xxhash64("node").cast("decimal(20,0)"))
    holders = rare.groupBy("word").agg(
        members.alias("members"), F.count("*").alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi")
    )
    kept = holders.filter("lo < hi").groupBy("members", "held").agg(F.min("word").alias("word"))
    return tuple(rare.join(kept.filter(some).select("word"), "word") for some in (F.col("held") <= HOT, F.col("held") > HOT))


def crossing_pairs(side: DataFrame) -> DataFrame:
    """All pairs (``a, b``) of sets in different components that share a word; at most ``HOT`` for each row of ``side``."""
    other = side.select("word", F.col("node").alias("node_2"), F.col("root").alias("root_2"))
    crossing = side.join(other, "word").filter((F.col("node") < F.col("node_2")) & (F.col("root") != F.col("root_2")))
    return crossing.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()


def cluster_links(rows: DataFrame, sets: DataFrame, block: int = 2000) -> DataFrame:
    """Links (``a, b``) between components of sets that share words of many sets, enough to connect what they connect.

    Sets tied by such words are a cluster. All sets outside a cluster's largest component are compared with all of it, in blocks of
    about ``block`` sets each way: sizes, bit sketches, and the exact test where both pass and no link has joined the two yet. So no
    pair is left out and none is written but those that join components."""
    labels = components(rows.select(F.col("node").alias("a"), F.col("word").alias("b"))).withColumnRenamed("root", "cluster")
    nodes = stored(
        rows.select("node", "root").distinct().join(labels, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")), "clusters"
    )
    largest = nodes.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("root", "n").alias("largest"))
    nodes = nodes.join(largest, "cluster").withColumn("outside", F.col("root") != F.col("largest")).drop("largest")
    blocks = nodes.groupBy("cluster").agg(
        F.ceil(F.count("*") / block).alias("blocks"), F.ceil(F.count_if("outside") / block).alias("chunks")
    )
    dealt = nodes.join(blocks.filter("chunks > 0"), "cluster")
    of = F.xxhash64("node", F.lit(7))
    members = dealt.select(
        "cluster", "node", "root", F.lit(False).alias("asks"), F.pmod(of, "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk")
    )
    asking = dealt.filter("outside").select(
        "cluster", "node", "root", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.pmod(of, "chunks").alias("chunk")
    )

    def compare(table: pa.Table) -> pa.Table:
        node, root, n = (table[c].to_numpy() for c in ("node", "root", "n"))
        asks = table["asks"].to_numpy()
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        tokens = table["tokens"].combine_chunks()
        joined: dict[int, int] = {}

        def find(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        found = []
        other = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks).tolist():
            apart = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            total = n[other] + n[i]
            near = (DEN + NUM) * apart <= (DEN - NUM) * total
            near &= (root[other] != root[i]) & (DEN * np.minimum(n[other], n[i]) >= NUM * np.maximum(n[other], n[i]))
            for j in other[near].tolist():
                a, b = find(int(root[i])), find(int(root[j]))
                if a == b:
                    continue
                both = len(np.intersect1d(tokens[i].values.to_numpy(), tokens[j].values.to_numpy(), assume_unique=True))
                if DEN * both >= NUM * (int(n[i]) + int(n[j]) - both):
                    joined[a] = b
                    found.append((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    whole = members.unionByName(asking).join(sets.select("node", "n", "tokens", "sketch"), "node")
    return whole.groupBy("cluster", "block", "chunk").applyInArrow(compare, "a bigint, b bigint")


def linked_sets(docs: DataFrame, star_rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """One row a document (``key, n, node``), and the component (``node, root``) of every set that is linked with a smaller one.

    ``docs`` has the columns ``key`` and ``text``."""
    spark = docs.sparkSession
    context = spark.sparkContext
    with small_batches(spark):
        frequent = context.broadcast(frequent_shingles(docs))  # at most 500,000 numbers
        release_shuffles(spark)
        shared = stored(shared_words(docs, frequent), "shared-words")
        release_shuffles(spark)
        bits = context.broadcast(word_filter(shared))  # FILTER_BITS bits
        rows = shingled(docs, frequent, bits)
        frequent.destroy()
        bits.destroy()
    # One row for each set that shares words, chosen on a few numbers before the wide columns move.
    carriers = rows.filter(F.col("words").isNotNull()).groupBy("node").agg(F.min("row").alias("row")).select("row")
    sets = stored(rows.filter(F.col("words").isNotNull()).join(carriers, "row", "left_semi").drop("row", "key"), "sets")
    release_shuffles(spark)
    members = stored(sets.select("node", "least", F.explode("words").alias("word")), "members")

    roots = None
    links = None
    for turn in range(star_rounds + 1):
        labelled = members.withColumn("root", F.col("node"))
        if roots is not None:
            labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Only words whose sets lie in different components can add a link between components. Another hub each round.
        hub = F.min_by("node", F.xxhash64("node", F.lit(turn)))
        open_words = (
            labelled.groupBy("word")
            .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), hub.alias("hub"), F.count("*").alias("held"))
            .filter("lo < hi")
        )
        if turn < star_rounds:
            # One hub for each set, in another component: in turn that of its most common word, which many sets have, and the
            # one that it shares most words with.
            hubs = open_words.select("word", "hub", "held")
            if roots is None:
                hubs = hubs.withColumn("hub_root", F.col("hub"))
            else:
                of_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
                hubs = hubs.join(of_hub, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
            met = labelled.join(hubs, "word").filter("root <> hub_root").groupBy("node", "hub").agg(
                F.count("*").alias("equal"), F.max("held").alias("held")
            )
            met = met.groupBy("node").agg(F.max_by("hub", "held" if turn % 2 == 0 else "equal").alias("hub"))
            pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        else:
            cold, hot = open_rows(labelled.join(open_words.select("word", "held"), "word"))
            pairs = stored(crossing_pairs(cold), "candidates")
            links = links.unionByName(stored(cluster_links(hot, sets), "cluster-links"))
        found = stored(verified(pairs, sets), "similar-sets")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        labelled = open_words = live = pairs = None
        release_shuffles(spark)
    return rows.select("key", "n", "node"), roots


def _components(own: DataFrame) -> DataFrame:
    """``key, n, least`` per document: the size of its set and the smallest key of its component."""
    rows, roots = linked_sets(own)
    rooted = rows.join(roots, "node", "left").select("key", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))
    least = rooted.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("key").alias("least"))
    return rooted.join(least, "root", "left").select("key", "n", F.coalesce("least", "key").alias("least"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links."""
    found = _components(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")))
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the smallest key (a null key is the largest), with the columns of ``docs``. Of rows that
    repeat key and text one stays, that with the least hash of its columns. Texts without words are linked with nothing, so all rows that have one stay."""
    own, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    mark, repeated, blank = (free_name(docs, name) for name in ("row_key", "row_repeated", "row_blank"))
    marked = docs.withColumn(mark, F.struct(own.isNull().alias("last"), own.alias("id"), F.xxhash64(body).alias("digest")))
    found = stored(_components(marked.select(F.col(mark).alias("key"), body.alias("text"))).filter("n > 0"), "near-copies")
    gone = found.filter("key <> least").select(F.col("key").alias(mark)).distinct()
    several = found.filter("key = least").groupBy(F.col("key").alias(mark)).agg(F.count("*").alias(repeated)).filter(F.col(repeated) > 1)
    has_words = F.coalesce(body.rlike(WORD), F.lit(False))
    kept = marked.withColumn(blank, ~has_words).join(gone, mark, "left_anti").join(several, mark, "left")
    alone = F.col(blank) | F.col(repeated).isNull()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    firsts = kept.filter(~alone).groupBy(mark).agg(F.min_by(row, order).alias(mark + "_row")).select(f"{mark}_row.*")
    return kept.filter(alone).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(firsts)
