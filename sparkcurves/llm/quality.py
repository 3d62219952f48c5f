"""Quality by importance resampling.

Two generative models of hashed n-grams are held against each other: one of target texts (labelled as good), one of all raw texts. A document's
log importance weight is the sum over its n-grams of log p_target - log p_raw. Documents are drawn without replacement in proportion to their
weights by Gumbel top-k: weight plus seeded Gumbel noise, the k largest keys stay.

Tokens are runs of one kind of character (letters, digits, other marks) with their case; n-grams are single tokens and pairs, and a pair of
equal tokens is one n-gram whatever the token. Hashing is done on Arrow buffers, counts are summed in each task and then by bucket, and the two
models are arrays of a fixed number of buckets. Nothing is gathered by document.

k is given, or follows from the target: the number of documents whose weight is at most `slack` below the weight that `keep_target` of the target
texts reach.
The k-th largest key is found by counting in ever finer ranges, not by a sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurves.llm import shared as S

BUCKETS = 1 << 14
TARGET_ROWS = 50_000  # labelled rows that the target model and the threshold are fit on, at most
KEEP_TARGET = 0.998
SLACK = 20.0  # Gumbel noise seldom moves a key further: texts that noise could still bring in count among those to keep
SMOOTHING = 400.0  # occurrences added to either model's count, so that what is rare in a small target says little

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letter or byte of a longer character, 2 mark, 3 digit
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 3


def ngram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, n + 1 offsets of each text's n-grams)."""
    data, offsets = S.text_buffer(texts)
    out, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in S.chunks_of(np.diff(offsets), 1 << 20):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = len(part)
        if not n:
            sizes.append(np.zeros(b - a, np.int64))
            continue
        kind, edge = _KIND[part], np.zeros(n + 1, bool)
        edge[at] = True
        start = kind > 0
        start[1:] &= (kind[1:] != kind[:-1]) | edge[1:n]
        end = kind > 0
        end[:-1] &= (kind[1:] != kind[:-1]) | edge[1:n]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        tokens = S.span_hashes(part, starts, ends)
        owner_at = np.searchsorted(starts, at)
        counts = np.diff(owner_at)
        owner = np.repeat(np.arange(b - a), counts)
        pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        left, right = tokens[pair], tokens[pair + 1] if len(pair) else tokens[pair]
        pairs = np.where(left == right, np.uint64(7), S.mix(left * np.uint64(3) + right))
        grams = np.concatenate([tokens, pairs]) % np.uint64(buckets)
        of = np.concatenate([owner, owner[pair]])
        order = np.argsort(of, kind="stable")
        out.append(grams[order].astype(np.int64))
        sizes.append(np.bincount(of, minlength=b - a))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


@dataclass
class Weights:
    """log p_target - log p_raw by bucket."""

    ratio: np.ndarray

    def of(self, texts: pa.Array) -> np.ndarray:
        grams, at = ngram_buckets(texts, len(self.ratio))
        total = np.concatenate([[0.0], np.cumsum(self.ratio[grams])])
        return total[at[1:]] - total[at[:-1]]


def counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket over all rows of texts(text): summed in each task, then by bucket; `buckets` numbers come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(ngram_buckets(batch.column("text"), buckets)[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(found), "n": pa.array(total[found])})

    rows = S.map_arrow(texts.select(S.whole_text("text").alias("text")), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def target_rows(documents: DataFrame, labels: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """texts(text) of the documents labelled 1 in labels(doc_id, quality): the first `most` labels in the order of a hash."""
    good = labels.where("quality = 1 and doc_id is not null").select(labels["doc_id"].alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(most)
    return documents.join(F.broadcast(good), documents["doc_id"] == good["good_id"], "left_semi")  # at most `most` numbers


def fit(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Weights:
    raw, aim = (counts(x, buckets).astype(float) for x in (documents, target))
    if not aim.sum():
        return Weights(np.zeros(buckets))
    expected = raw * (aim.sum() / raw.sum())  # counts that the raw model expects in as much text
    return Weights(np.log((aim + smoothing) / (expected + smoothing)))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096, rounds: int = 6) -> float:
    """A bound that exactly or nearly k values of a column reach, found by counting in `bins` ranges that get finer each round.

    Values that differ by less than the finest range (a part in 4096**6 of the whole) may be kept beyond k.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    for _ in range(rounds):
        if not high > low:
            break
        step = (high - low) / bins
        if low + step == low:
            break
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(step))).cast("int")
        rows = keys.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(bin_.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()  # at most `bins` rows
        for row in sorted(rows, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        else:
            return float(low)
        low, high = row["low"], row["high"]
        if above + row["n"] == k:
            break
    return float(low)


def resample(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, keep_target: float = KEEP_TARGET,
             slack: float = SLACK, smoothing: float = SMOOTHING, buckets: int = BUCKETS, most_target: int = TARGET_ROWS) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, quality) -> doc_id, log_weight, gumbel_key, kept, text_key, one row per row.

    The noise is a function of seed, doc_id and text, so reruns agree, and rows that repeat share their key. Null and empty texts have weight 0 like
    any text without n-grams; so has everything when no label is 1. Ties at the k-th key are all kept. An empty table gives an empty result; other
    columns and other labels are ignored. Very long texts have large weights of either sign.
    """
    texts = S.pick(documents, doc_id="doc_id", text="text")
    target = target_rows(texts, labels, most_target)
    model = fit(texts, target, buckets, smoothing)
    rows = texts.select("doc_id", S.whole_text("text").alias("text"), F.xxhash64(S.whole_text("text")).alias("text_key"))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "log_weight": pa.array(model.of(batch.column("text")))})

    weights = S.map_arrow(rows, S.arrow_map(weigh), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text_key long, log_weight double")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 11).cast("double") + 0.5) / float(1 << 53)
    weights = S.store(weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit))), "importance")
    if k is None:
        scored = target_rows(weights, labels, most_target)
        total = scored.count()
        bar = kth_largest(scored, "log_weight", max(1, int(np.ceil(keep_target * total)))) if total else float("-inf")
        k = weights.where(F.col("log_weight") >= F.lit(bar - slack)).count()
    cut = kth_largest(weights, "gumbel_key", k)
    return weights.select("doc_id", "log_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(cut)).alias("kept"), "text_key")


def keep_good(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that resample() keeps."""
    out = resample(documents, labels, **options).where("not kept").select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).distinct()
    key = F.xxhash64(S.whole_text(documents["text"]))
    return documents.join(out, documents["doc_id"].eqNullSafe(out["lost_id"]) & (key == out["lost_key"]), "left_anti")
