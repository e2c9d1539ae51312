"""Quality by ordinal regression on graded ratings, over hashed text.

A cumulative-link model: P(grade <= j) = logistic(threshold[j] - score), one score for all grades, thresholds in
order. The score is a sum of weights of hashed features: the words a text has (A-Z lower-cased, without ASCII
punctuation) and their first 4 and 5 bytes, the share of its tokens of each shape (runs of upper case, lower case,
digits and each sign), and the share of tokens that repeat one of the two before. It is fitted in one task on a sample
of rated documents that sample_rows bounds, with the features whose mean differs clearly between grades; the driver
holds the weights only. Every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.base import any_names, durable, prepare
from corpusloom.llm.textkit import Words

BUCKETS = 1 << 18
SAMPLE_ROWS = 12_000
MIN_TEXTS = 4
CLEAR = 0.4
BLOCK = 1000  # rows whose features a round of the fit looks at together
SHAPE_SCALE = 12.0

_SIGN = np.zeros(256, bool)
_SIGN[:128] = True
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: buckets, values, and where each text's begin (one more at the end)."""
    n = len(texts)
    plain = Words(texts, lower=True, separators=_SIGN)
    doc = np.repeat(np.arange(n), plain.counts())
    own_doc = doc.astype(np.uint64) << np.uint64(18)
    pairs = [own_doc | (plain.hashes() >> np.uint64(46))]
    for length in (4, 5):
        longer = np.flatnonzero(plain.ends - plain.starts > length)
        pairs.append(own_doc[longer] | (plain.hashes(longer, plain.starts[longer] + length) >> np.uint64(46)))
    pairs = np.unique(np.concatenate(pairs))
    tokens = Words(texts)
    total = tokens.counts()
    owner = np.repeat(np.arange(n), total)
    # shapes: the bytes' classes with runs collapsed
    shape = _SHAPE[tokens.data]
    starts = np.zeros(len(shape) + 1, bool)
    starts[tokens.starts] = True
    kept = starts[:-1] | np.concatenate([[True], shape[1:] != shape[:-1]])[: len(shape)]
    moved = np.concatenate([[0], np.cumsum(kept)])
    collapsed = Words.__new__(Words)
    collapsed.data, collapsed.starts, collapsed.ends, collapsed.first = shape[kept], moved[tokens.starts], moved[tokens.ends], tokens.first
    form = (collapsed.hashes() ^ np.uint64(0x5BD1E995)) >> np.uint64(46)
    own = tokens.hashes()
    again = np.zeros(len(own), bool)
    for back in (1, 2):
        again[back:] |= (own[back:] == own[:-back]) & (owner[back:] == owner[:-back])
    forms, counts = np.unique(np.concatenate([(owner.astype(np.uint64) << np.uint64(18)) | form, (owner[again].astype(np.uint64) << np.uint64(18)) | np.uint64(7)]), return_counts=True)
    rows = np.concatenate([pairs, forms])
    at = (rows >> np.uint64(18)).astype(np.int64)
    values = np.concatenate([np.ones(len(pairs)), SHAPE_SCALE * counts / np.maximum(total[at[len(pairs) :]], 1)]).astype(np.float32)
    order = np.argsort(at, kind="stable")
    return (rows[order] & np.uint64(BUCKETS - 1)).astype(np.int32), values[order], np.searchsorted(at[order], np.arange(n + 1))


@dataclass
class OrdinalModel:
    """Weights over buckets and ascending thresholds; grades 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, buckets: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each row's own sum, so that equal texts have equal scores wherever they are."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return np.bincount(row, weights=self.weights[buckets].astype(np.float64) * values, minlength=len(first) - 1)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(buckets: np.ndarray, values: np.ndarray, first: np.ndarray, grades: np.ndarray, levels: int, rounds: int = 150, penalty: float = 2e-4, rate: float = 0.08) -> OrdinalModel:
    """Penalised maximum likelihood by Adam over all rows; features that no row has keep weight zero.

    Grades that no row has share a threshold; without rows every tail probability is 1."""
    if not len(grades):
        return OrdinalModel(np.zeros(BUCKETS, np.float32), np.full(levels - 1, -60.0))
    names = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[names] = np.arange(len(names))
    column = place[buckets]
    n, k = len(grades), levels - 1
    share = np.clip(np.array([(grades <= j).mean() for j in range(k)]), 1e-6, 1 - 1e-6)
    base = np.log(share / (1 - share))
    theta = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-3))])  # first threshold, log gaps
    x = np.concatenate([np.zeros(len(names)), theta])
    first_moment, second_moment = np.zeros(len(x)), np.zeros(len(x))
    logistic = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))

    def blocks() -> Iterator[tuple]:
        for a in range(0, n, BLOCK):
            b = min(a + BLOCK, n)
            yield a, b, np.repeat(np.arange(b - a), np.diff(first[a : b + 1])), column[first[a] : first[b]], values[first[a] : first[b]]

    for t in range(1, rounds + 1):
        w, gaps = x[: len(names)], np.exp(x[len(names) + 1 :])
        cut = x[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.concatenate([np.bincount(row, weights=w[c] * v, minlength=b - a) for a, b, row, c, v in blocks()])
        z = np.concatenate([np.full((n, 1), -np.inf), cut[None, :] - score[:, None], np.full((n, 1), np.inf)], axis=1)
        c = np.where(np.isinf(z), (z > 0) * 1.0, logistic(np.where(np.isinf(z), 0, z)))
        upper, lower = c[np.arange(n), grades + 1], c[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # of the log likelihood by upper and lower cut
        g_score = -(du - dl)
        g_cut = np.array([du[grades == j].sum() - dl[grades == j + 1].sum() for j in range(k)]) / n
        g_w = sum(np.bincount(c, weights=v * g_score[a:b][row], minlength=len(names)) for a, b, row, c, v in blocks()) / n - penalty * w
        tail = np.cumsum(g_cut[::-1])[::-1]
        gradient = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        first_moment = 0.9 * first_moment + 0.1 * gradient
        second_moment = 0.999 * second_moment + 0.001 * gradient**2
        x = x + rate * (first_moment / (1 - 0.9**t)) / (np.sqrt(second_moment / (1 - 0.999**t)) + 1e-10)
    weights = np.zeros(BUCKETS, np.float32)
    weights[names] = x[: len(names)]
    return OrdinalModel(weights, x[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(x[len(names) + 1 :]))]))


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 for toxic, 1 for poor, 2 for good; null without a rating."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)


def clear_features(sampled: DataFrame, levels: int, min_texts: int = MIN_TEXTS, clear: float = CLEAR) -> DataFrame:
    """(bucket) of features that min_texts rows have and whose mean in some grade is `clear * ln(rows)` standard errors
    or more from that in the highest grade. Each task sends sums of its rows by bucket, not its features."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, levels, BUCKETS))
        for batch in batches:
            lists = batch.column(2)
            buckets, values = np.asarray(lists.flatten()), np.asarray(batch.column(3).flatten()).astype(np.float64)
            grade = np.repeat(batch.column(0).to_numpy(), np.diff(np.asarray(lists.offsets)))
            for i, x in enumerate((np.ones(len(values)), values, values**2)):
                total[i] += np.bincount(grade * BUCKETS + buckets, weights=x, minlength=levels * BUCKETS).reshape(levels, BUCKETS)
        at = np.flatnonzero(total[0].sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[i, j, at]) for i in range(3) for j in range(levels)]], names=names)

    names = ["bucket", *[f"{x}{j}" for x in ("n", "s", "q") for j in range(levels)]]
    rows = {r["grade"]: r["n"] for r in sampled.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    by = sampled.mapInArrow(sums, "bucket long, " + ", ".join(f"{n} double" for n in names[1:])).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]])
    mean = lambda j: F.col(f"s{j}") / max(rows.get(j, 0), 1)
    error = lambda j: (F.greatest(F.col(f"q{j}") / max(rows.get(j, 0), 1) - mean(j) * mean(j), F.lit(0.0)) + 0.25 / max(rows.get(j, 0), 1)) / max(rows.get(j, 0), 1)
    top = levels - 1
    apart = [F.abs(mean(j) - mean(top)) / F.sqrt(error(j) + error(top)) for j in range(top)]
    least = clear * float(np.log(max(sum(rows.values()), 1)))
    seen = sum((F.col(f"n{j}") for j in range(levels)), F.lit(0.0))
    return by.where((seen >= min_texts) & (F.greatest(*apart, F.lit(0.0)) >= least)).select("bucket")


def train(docs: DataFrame, rated: DataFrame, sample_rows: int = SAMPLE_ROWS, levels: int = 3, text: str = "text") -> OrdinalModel:
    """Fit on at most sample_rows documents of rated (doc_id, grade), those with the least hash of their id.

    The bound holds what the fitting task gets: the screened features of that many texts. Null grades and ids are left
    out; of repeated ratings the least counts."""
    spark = docs.sparkSession
    prepare(spark)
    ids = rated.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", F.col(text).alias("_t")).join(F.broadcast(sample), "doc_id").select(F.col("grade").cast("int"), "_t", F.xxhash64("doc_id", "_t").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, values, first = features(batch.column(1))
            offsets = pa.array(first.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(buckets)), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["grade", "k", "b", "v"])

    # rows that repeat a doc_id may be many: the bound is on rows too
    sampled = durable(texts.orderBy("k").limit(sample_rows).repartition(8).mapInArrow(run, "grade int, k long, b array<int>, v array<float>"))
    kept = np.sort(np.asarray(clear_features(sampled, levels).toArrow()["bucket"]).astype(np.int32))  # at most BUCKETS
    names = spark.sparkContext.broadcast(kept)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            buckets, values = (np.asarray(x.flatten()) for x in (lists, batch.column(3)))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            hit = np.isin(buckets, names.value)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=batch.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(buckets[hit])), pa.ListArray.from_arrays(offsets, pa.array(values[hit]))], names=["grade", "k", "b", "v"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.table({"grade": [], "k": [], "b": [], "v": []}, rows_schema), *[pa.Table.from_batches([x]).cast(rows_schema) for x in batches]]
        found = pa.concat_tables(parts).sort_by("k").combine_chunks()
        lists = [found.column(n).combine_chunks() for n in ("b", "v")]
        buckets, values = (np.asarray(x.flatten()) for x in lists)
        first = np.asarray(lists[0].offsets).astype(np.int64) if len(found) else np.zeros(1, np.int64)
        model = fit(buckets, values, first - first[0], np.asarray(found.column("grade")), levels)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.thresholds.tolist()])], names=["w", "t"])

    rows_schema = pa.schema([("grade", pa.int32()), ("k", pa.int64()), ("b", pa.list_(pa.int32())), ("v", pa.list_(pa.float32()))])
    found = sampled.mapInArrow(only, "grade int, k long, b array<int>, v array<float>").coalesce(1).mapInArrow(fitted, "w binary, t array<double>").first()
    return OrdinalModel(np.frombuffer(found["w"], np.float32), np.array(found["t"]))


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """docs with expected_grade and tail_probability, that of the highest grade. Columns of these names are replaced.

    Null and empty texts have score zero; repeated rows are scored alike; an empty table gives an empty result."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # one number a bucket
    docs = docs.drop("expected_grade", "tail_probability")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            tails = model.tails(model.scores(*features(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=[*batch.schema.names, "expected_grade", "tail_probability"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, expected_grade double, tail_probability double")


@any_names("doc_id", "text", "expected_grade", "tail_probability")
def select_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose probability of the highest grade is at least `least`, with both figures, which replace columns of
    these names."""
    model = train(docs, labels.select("doc_id", grade_of().alias("grade")), sample_rows)
    return score(docs, model).where(F.col("tail_probability") >= least)


@any_names("doc_id", "text")
def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Those rows of docs, with their own columns alone, whatever these are called."""
    return select_good(docs, labels, least, sample_rows).select(*docs.columns)
