"""Operator 9: toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, distinct_per_row, slices, span_hashes, texts_of, utf8, words

#: Bound on the rows that are gathered for the fit: confirmed toxic ones, and unlabelled ones.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000


@dataclass
class Model:
    """A linear classifier over distinct words of a text: sorted word hashes, their weights, and the intercept."""

    vocabulary: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores of rows of distinct word hashes, one row after the other."""
        z = np.full(len(counts), self.intercept)
        if len(self.vocabulary) and len(h):
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            value = np.where(self.vocabulary[at] == h, self.weights[at], 0.0)
            z += np.bincount(np.repeat(np.arange(len(counts)), counts), weights=value, minlength=len(counts))
        return np.where(z == -np.inf, 0.0, 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the words of each row (256 rows at most), and how many: words are runs of letters, ASCII ones in lower case."""
    data, offsets = utf8(column)
    letters = (data >= 128) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    s, e, row = words(np.where(letters, data, 32).astype(np.uint8), offsets)
    return distinct_per_row(span_hashes(data, s, e, fold=True), row, len(offsets) - 1)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: int = 2, apart: float = 5.0, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimise prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]) for the logistic loss, by Adam on the whole sample.

    Where the estimate of the negative part falls below zero the step goes up that part instead, as the estimator demands. Only
    words that occur in least toxic texts, and there oftener than in unlabelled ones by apart standard errors, have a weight. The
    intercept is at most the prior's.
    """
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(0, U64), np.zeros(0), -np.inf if not positive else float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    sizes = np.array([len(x) for x in positive + unlabelled])
    h = np.concatenate(positive + unlabelled)
    vocabulary, column = np.unique(h, return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    toxic = row < len(positive)
    in_p = np.bincount(column[toxic], minlength=len(vocabulary))
    in_u = np.bincount(column[~toxic], minlength=len(vocabulary))
    usual = (in_u + 0.5) / (len(unlabelled) + 1.0)
    excess = (in_p / len(positive) - usual) / np.sqrt(usual * (1 - usual) / len(positive))
    keep = (in_p >= least) & (excess >= apart)
    vocabulary, renamed = vocabulary[keep], np.cumsum(keep) - 1
    ok = keep[column]
    row, column = row[ok].astype(np.int32), renamed[column[ok]].astype(np.int32)
    n_p, n, m = len(positive), len(sizes), len(vocabulary)
    share = np.where(np.arange(n) < n_p, prior / n_p, 1.0 / (n - n_p))
    w, b = np.zeros(m), float(np.log(prior / (1 - prior)))
    g1, g2, c1, c2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[column], minlength=n)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        loss_minus = np.logaddexp(0, z)
        negative = (loss_minus[n_p:] * share[n_p:]).sum() - (loss_minus[:n_p] * share[:n_p]).sum()
        slope = np.empty(n)
        if negative >= 0:
            slope[:n_p] = share[:n_p] * (p[:n_p] - 1) - share[:n_p] * p[:n_p]
            slope[n_p:] = share[n_p:] * p[n_p:]
        else:
            slope[:n_p] = share[:n_p] * p[:n_p]
            slope[n_p:] = -share[n_p:] * p[n_p:]
        g, c = np.bincount(column, weights=slope[row], minlength=m) + decay * w, slope.sum()
        g1, g2, c1, c2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g, 0.9 * c1 + 0.1 * c, 0.999 * c2 + 0.001 * c * c
        a, d = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (g1 / a) / (np.sqrt(g2 / d) + 1e-4)
        b -= rate * (c1 / a) / (np.sqrt(c2 / d) + 1e-4)
    # a text without any of these words is no likelier toxic than the prior; the risk alone leaves that loose where the sample is small
    b = min(b, float(np.log(prior / (1 - prior))))
    return Model(vocabulary, w, b)


def held_out() -> F.Column:
    """True for documents whose labels may not be learned from: crc32 of the doc_id as text, modulo 4, is 2. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def lowest_ids(ids: DataFrame, most: int) -> DataFrame:
    """The most doc_ids of ids with the lowest hashes, each once. All but about 1.5 * most are left out by a bound on the hash before
    anything is sorted, so that no task gets more than these."""
    n = max(1, ids.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0])
    bound = min((1 << 63) - 1, -(1 << 63) + (3 * most * (1 << 64)) // (2 * n))
    return ids.filter(F.xxhash64("doc_id") <= F.lit(bound)).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on documents that aren't held out: toxic ones by label, and any others as unlabelled text.

    The driver gathers the word hashes of max_positive and max_unlabelled texts at most, chosen by the hash of doc_id, one for each
    (the smallest of several); the class prior is the toxic share of all labels that aren't held out. Null labels, and labels of no
    document, don't count. With no toxic document every score is 0.
    """
    free = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null").filter(~held_out())
    prior = free.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    rows = texts_of(docs)
    toxic = lowest_ids(free.filter("toxic = 1").select("doc_id"), max_positive).withColumn("side", F.lit(1))
    others = lowest_ids(rows.select("doc_id").filter(~held_out()), max_unlabelled).withColumn("side", F.lit(0))
    # both sides of the union are bounded by the two limits
    sample = rows.join(F.broadcast(toxic.union(others)), "doc_id").groupBy("doc_id", "side").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                h, counts = word_sets(s.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(h.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("side"), lists], ["doc_id", "side", "h"])

    got = sample.mapInArrow(features, "doc_id long, side int, h array<long>").toArrow()
    side = got.column("side").to_numpy()
    arrays = [np.asarray(x.values.to_numpy()).view(U64) for chunk in got.column("h").chunks for x in chunk]
    order_ = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    return fit([arrays[i] for i in order_ if side[i] == 1], [arrays[i] for i in order_ if side[i] == 0], prior)


def score_column(spark: SparkSession, model: Model, text: str = "text") -> F.Column:
    """Score of a text column; null text is empty and has the model's score for no words."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        for s in slices(batch):
            out.append(shared.value.scores(*word_sets(s.column("text"))))
        return pa.array(np.concatenate(out))

    return score(F.col(text).cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row. A null text is scored as an empty one, texts may be of any length, repeated
    rows have equal scores, an empty table gives no row, and other columns are ignored, whatever their names."""
    model = train(docs, labels)
    scored = texts_of(docs).withColumn("score", score_column(docs.sparkSession, model))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
