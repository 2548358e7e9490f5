"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes a bounded sample of labelled rows (``most_examples``). Its vocabulary are the terms (words and their
leading characters) that are tied to the label by a chi-squared test; their document frequencies are counted over all
documents. The examples become unit TF-IDF vectors in an inverted index whose postings are cut into blocks of examples,
each with its largest weight a term. Vocabulary, examples and postings are bounded by parameters, so the index may be
broadcast.

A document visits blocks in the order of their upper bounds and stops when no block can hold a nearer example than
the ``k`` found, so the result is the exact ``k`` nearest. Their votes are weighted by a power of their similarity and smoothed by the
share of label 1 in the sample; documents without a known term get the share among such examples. The examples
that voted are the evidence.

Labels, language, source and id are no input of a score; equal texts have equal scores.

Defined cases: null and empty texts have no term and get the same score as any text without one; without labelled rows
every score is 0; ties between examples go to the smaller id; repeated rows give a row each; an empty table an empty result;
columns of the input stay, and new ones get underscores in front of their names where these clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import free_name, stored, texts_of
from orderflow.llm.labelled import labelled_sample, remainder

TOKEN = re.compile(r"[^\W_]+")
STEMS = (4, 5)


@dataclass
class Params:
    most_examples: int = 4000
    most_terms: int = 1024
    least_count: int = 3
    chance: float = 0.1
    k: int = 15
    block: int = 32
    smoothing: float = 0.5
    sharpness: float = 3.0


@dataclass
class Index:
    """Unit vectors of the examples as blocked postings: term -> {block: (largest weight, members, weights)}."""

    k: int
    smoothing: float
    sharpness: float
    idf: dict[str, float]
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block: int = 32
    postings: dict[str, dict[int, tuple[float, np.ndarray, np.ndarray]]] = field(default_factory=dict)
    prior: float = 0.0
    without_terms: float = 0.0


def terms_of(text: str | None) -> Counter:
    """Words and their leading characters, with their numbers."""
    words = Counter(TOKEN.findall((text or "").lower()))
    out = Counter(words)
    for size in STEMS:
        for word, n in words.items():
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out


def weights_of(text: str | None, idf: dict[str, float]) -> dict[str, float]:
    """The unit TF-IDF vector of a text over the vocabulary: (1 + log n) * idf."""
    words = Counter(TOKEN.findall((text or "").lower()))
    found: dict[str, int] = {}
    for word, n in words.items():
        if word in idf:
            found[word] = found.get(word, 0) + n
        for size in STEMS:
            if len(word) > size and (stem := word[:size] + "*") in idf:
                found[stem] = found.get(stem, 0) + n
    raw = {t: (1.0 + np.log(found[t])) * idf[t] for t in sorted(found)}
    norm = float(np.sqrt(sum(v * v for v in raw.values())))
    return {t: v / norm for t, v in raw.items()} if norm else {}


def build_index(ids, y, vectors: list[dict[str, float]], idf: dict[str, float], p: Params) -> Index:
    """Examples with like vectors share a block, which keeps the blocks' bounds tight."""
    out = Index(p.k, p.smoothing, p.sharpness, idf, block=p.block)
    if not len(ids):
        return out
    y = np.asarray(y, float)
    out.prior = float(y.mean())
    bare = np.array([not v for v in vectors])
    out.without_terms = float((y[bare].sum() + out.smoothing * out.prior) / (bare.sum() + out.smoothing))
    kept = [i for i in range(len(ids)) if not bare[i]]
    kept.sort(key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], t)), ids[i]))
    out.ids, out.y = np.array([ids[i] for i in kept], np.int64), y[kept]
    lists: dict[str, dict[int, list]] = {}
    for at, i in enumerate(kept):
        for term, w in vectors[i].items():
            lists.setdefault(term, {}).setdefault(at // p.block, []).append((at % p.block, w))
    for term, blocks in lists.items():
        out.postings[term] = {
            b: (max(w for _, w in rows), np.array([m for m, _ in rows]), np.array([w for _, w in rows]))
            for b, rows in blocks.items()
        }
    return out


def nearest(query: dict[str, float], index: Index) -> list[tuple[float, int]]:
    """The ``k`` nearest examples, as (cosine, position); zero similarity is no neighbour."""
    bounds: dict[int, float] = {}
    lists = [(q, index.postings[t]) for t, q in query.items() if t in index.postings]
    for q, blocks in lists:
        for b, (most, _, _) in blocks.items():
            bounds[b] = bounds.get(b, 0.0) + q * most
    best: list[tuple[float, int, int]] = []
    for b, bound in sorted(bounds.items(), key=lambda x: -x[1]):
        if len(best) == index.k and bound < -best[-1][0] - 1e-9:
            break
        scores = np.zeros(index.block)
        for q, blocks in lists:
            if b in blocks:
                _, members, weights = blocks[b]
                scores[members] += q * weights
        hit = np.flatnonzero(scores > 0)
        best += [(-float(scores[m]), int(index.ids[b * index.block + m]), b * index.block + int(m)) for m in hit]
        best = sorted(best)[: index.k]
    return [(-s, at) for s, _, at in best]


def vote(found: list[tuple[float, int]], index: Index) -> float:
    if not found:
        return index.without_terms
    w = np.array([s for s, _ in found]) ** index.sharpness
    y = index.y[[at for _, at in found]]
    return float(min(1.0, max(0.0, (w @ y + index.smoothing * index.prior) / (w.sum() + index.smoothing))))


def _term_counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(texts_of(batch), batch["y"].to_pylist()):
                seen[int(y > 0)].update(terms_of(text).keys())
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *[pa.array([s[t] for t in terms], pa.int64()) for s in seen]],
                names=["term", "without", "with"],
            )

    counted = sample.select("text", "y").mapInArrow(count, "term string, without bigint, with bigint")
    return counted.groupBy("term").agg(F.sum("without").alias("b"), F.sum("with").alias("a"))


def vocabulary(sample: DataFrame, p: Params) -> list[str]:
    """At most ``most_terms`` terms tied to the label, strongest first. The bound on chi-squared is that of a term whose
    documents all have label 1 and are just so many that ``chance`` of all tested terms would get there by luck."""
    n1, n0 = sample.agg(
        F.coalesce(F.count_if(F.col("y") > 0), F.lit(0)), F.coalesce(F.count_if(F.col("y") <= 0), F.lit(0))
    ).first()
    if not n1 or not n0:
        return []
    counts = stored(_term_counts(sample).filter(F.col("a") + F.col("b") >= p.least_count), "toxicity-terms")
    share = n1 / (n1 + n0)
    enough = max(p.least_count, math.ceil(math.log(max(1, counts.count()) / p.chance) / -math.log(share)))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = F.lit(float(n1)) - a, F.lit(float(n0)) - b
    below = (a + b) * (c + d) * n1 * n0
    chi = F.when(below > 0, (n1 + n0) * (a * d - b * c) * (a * d - b * c) / below)
    rows = (
        counts.withColumn("chi", chi)
        .filter(F.col("chi") >= 0.99 * enough * (1 - share) / share)
        .orderBy(F.desc("chi"), "term")
        .limit(p.most_terms)
        .select("term")
        .collect()
    )
    return [r.term for r in rows]


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each of the given terms, over the whole table."""
    known = frozenset(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in texts_of(batch):
                here = set()
                for word in set(TOKEN.findall((text or "").lower())):
                    if word in known:
                        here.add(word)
                    for size in STEMS:
                        if len(word) > size and (stem := word[:size] + "*") in known:
                            here.add(stem)
                seen.update(here)
                seen[""] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"]
            )

    rows = docs.select("text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found.pop("", 0), found


def fit(docs: DataFrame, labels: DataFrame, learn: Column, p: Params = Params()) -> Index:
    """The index over labelled documents for which ``learn`` holds. The driver holds ``most_examples`` sparse vectors."""
    sample = labelled_sample(docs, labels, "toxic", learn, p.most_examples)
    terms = vocabulary(sample, p)
    total, df = document_frequencies(docs, terms) if terms else (0, {})
    idf = {t: float(np.log((1 + total) / (1 + df.get(t, 0))) + 1.0) for t in terms}
    kind = "doc_id bigint, y double, terms array<string>, weights array<double>"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weights_of(t, idf) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].cast(pa.int64()),
                    batch["y"].cast(pa.float64()),
                    pa.array([list(v.keys()) for v in found], pa.list_(pa.string())),
                    pa.array([list(v.values()) for v in found], pa.list_(pa.float64())),
                ],
                names=["doc_id", "y", "terms", "weights"],
            )

    rows = sorted(sample.select("doc_id", "y", "text").mapInArrow(vectors, kind).collect())
    return build_index(
        [r.doc_id for r in rows], [float(r.y > 0) for r in rows], [dict(zip(r.terms, r.weights)) for r in rows], idf, p
    )


def score(docs: DataFrame, index: Index) -> tuple[DataFrame, str, str]:
    """``docs`` with a score and its evidence (ids of the voting examples), and the names of these two columns."""
    held = docs.sparkSession.sparkContext.broadcast(vars(index))  # bounded by the parameters of the fit
    names = free_name(docs, "score"), free_name(docs, "evidence")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.ArrayType(T.LongType()))])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(**held.value)
        for batch in batches:
            found = [nearest(weights_of(t, own.idf), own) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([vote(f, own) for f in found], pa.float64()),
                    pa.array([[int(own.ids[at]) for _, at in f] for f in found], pa.list_(pa.int64())),
                ],
                names=[*batch.schema.names, *names],
            )

    return docs.mapInArrow(rate, schema), *names


HELD_OUT = 5
THRESHOLD = 0.5


def learnable() -> Column:
    return remainder("doc_id", HELD_OUT) != 0


def report(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted, evidence``."""
    scored, name, evidence = score(docs.select("doc_id", "text"), fit(docs, labels, learnable(), p))
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", HELD_OUT) == 0, F.lit(False)).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= THRESHOLD).cast("int").alias("predicted"),
        F.col(evidence).alias("evidence"),
    )


def clean(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    scored, name, evidence = score(docs, fit(docs, labels, learnable(), p))
    return scored.filter(F.col(name) < THRESHOLD).drop(name, evidence)
