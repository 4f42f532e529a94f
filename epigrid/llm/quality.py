"""Quality selection by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of raw
text, give each document a log likelihood ratio; Gumbel noise on top of it and the
largest k draw k documents without replacement in proportion to the ratio.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, blocks, mix, running_total, word_hashes


def features(words: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs (within a text), and each one's text."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:]) if len(words) else words
    same = owner[:-1] == owner[1:] if len(words) else np.empty(0, bool)
    both = np.concatenate([words, pairs[same]]) % np.uint64(buckets)
    return both.astype(np.int64), np.concatenate([owner, owner[:-1][same] if len(words) else owner])


def _counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all of docs; what reaches the driver is one
    number a bucket."""

    def part(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for lo, hi in blocks(texts):
                total += np.bincount(features(*word_hashes(texts[lo:hi]), buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(part, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def importance_resample(docs: DataFrame, target_ids: DataFrame, keep: float, buckets: int = 10_000, most_targets: int = 20_000, seed: int = 29) -> DataFrame:
    """Every row of docs with its log weight, Gumbel key and whether it is drawn.

    docs: doc_id, text. target_ids: doc_id of known good documents; the target model
    uses at most ``most_targets`` of them, the first by hash. The raw model uses all
    of docs. Draws round(keep * rows) rows by the largest key, ties by doc_id.
    Null or empty texts have log weight 0; a null doc_id is an id of its own; repeated
    rows have equal keys. No targets: all weights are 0. Returns doc_id, n_features,
    log_weight, gumbel_key, selected; other columns are ignored.
    """
    spark = docs.sparkSession
    with Workspace(spark, "quality") as ws:
        chosen = target_ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_targets)
        chosen = ws.table(chosen, "targets")  # bounded by most_targets, so it is broadcast
        raw = _counts(docs, buckets)
        good = _counts(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), buckets)
        ratio = np.log((good + 0.5) / (good.sum() + 0.5 * buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * buckets))
        if not good.sum():
            ratio[:] = 0

        def weigh(batches):
            import pyarrow as pa

            for batch in batches:
                texts, sums, sizes = as_bytes(batch.column(1)), [], []
                for lo, hi in blocks(texts):
                    bucket, owner = features(*word_hashes(texts[lo:hi]), buckets)
                    sums.append(np.bincount(owner, ratio[bucket], minlength=hi - lo))
                    sizes.append(np.bincount(owner, minlength=hi - lo))
                if texts:
                    weights = np.round(np.concatenate(sums), 6)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(weights)], names=["doc_id", "n_features", "log_weight"])

        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_features long, log_weight double"
        weighed = docs.select("doc_id", "text").mapInArrow(weigh, schema)
        uniform = (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        keyed = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))).withColumn("one", F.lit(1).cast("long"))
        ordered = running_total(ws, keyed, [F.desc("gumbel_key"), "doc_id"], "one", "keyed")
        k = round(keep * ordered.count())
        return ws.result(ordered.select("doc_id", "n_features", "log_weight", "gumbel_key", (F.col("before") < k).alias("selected")))
