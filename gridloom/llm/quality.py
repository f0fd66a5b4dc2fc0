"""Quality classifier: supervised subword embeddings in the manner of fastText, trained by numpy stochastic gradient descent.

A document's features are hashes of its words, of pairs of adjacent words, of immediate repeats, and of the character (byte) 3- to 5-grams inside words.
Each hash has a learned vector; a document is the average of its features' vectors, a softmax layer gives the label. Only the text
is an input.

Training takes place in one task, on at most ``max_rows`` labelled rows (chosen by a hash of the id, so a larger corpus doesn't make a larger fit). Scoring is
a map over the texts. As the output layer is linear, a feature's share in the logits' difference is one number, so scoring looks up
one number for each feature.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import blocks, text_buffer
from .segments import BLANKS, Prefix, _BYTES, hash_segments, mix, word_ranges

BITS = 18
GRAMS = (3, 4, 5)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, document of each feature)."""
    starts, ends, first = word_ranges(data, offsets, BLANKS)
    mask = np.uint64((1 << bits) - 1)
    docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    word = hash_segments(data, starts, ends, both=False)
    doc_of = np.repeat(np.arange(docs, dtype=np.int32), np.diff(first))
    buckets, owners = [word & mask], [doc_of]
    same_doc = doc_of[1:] == doc_of[:-1]
    pair = mix(word[:-1] * np.uint64(3) + word[1:])
    pair[word[1:] == word[:-1]] = 7  # any word said twice running is one feature
    buckets.append(pair[same_doc] & mask)
    owners.append(doc_of[1:][same_doc])
    prefix = Prefix(_BYTES[1][data], 1)
    end_of = np.zeros(len(data), np.int32)  # of the word that a byte stands in, 0 between words
    lengths = ends - starts
    inside = ~BLANKS[data]
    end_of[inside] = np.repeat(ends, lengths)
    owner_of = np.zeros(len(data), np.int32)
    owner_of[inside] = np.repeat(doc_of, lengths)
    for n in GRAMS:
        at = np.flatnonzero(end_of >= np.arange(n, len(data) + n))
        buckets.append(prefix.hash(at, at + n) & mask)
        owners.append(owner_of[at])
    return np.concatenate(buckets).astype(np.int32), np.concatenate(owners)


def train(texts: pa.Array, labels: np.ndarray, dim: int = 8, steps: int = 325, rate: float = 0.6, batch: int = 64, bits: int = BITS, seed: int = 7) -> dict:
    """Vectors and the output layer, by stochastic gradient descent on ``steps`` mini-batches, whatever the number of rows; the rate falls linearly. Documents' repeated features
    count as often as they occur. Rows that are no 0/1 label must not be given; with none or one class the prior alone is learned."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    n = len(labels)
    prior = (labels.sum() + 1) / (n + 2) if n else 0.5
    bias = np.array([0, np.log(prior / (1 - prior))], np.float32)
    rows = []
    for k in range(n):  # each document's distinct features and their weights
        got = features(*text_buffer(texts[k : k + 1]), bits)[0]
        bucket, count = np.unique(got, return_counts=True)
        rows.append((bucket, (count / max(1, count.sum())).astype(np.float32)))
    done = 0 if 0 < labels.sum() < n and any(len(bucket) for bucket, _ in rows) else steps
    while done < steps:
        order = random.permutation(n)
        for at in range(0, min(n, (steps - done) * batch), batch):
            part = order[at : at + batch]
            sizes = np.array([len(rows[i][0]) for i in part])
            bucket, weight = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            hidden = np.zeros((len(part), dim), np.float32)
            filled = np.flatnonzero(sizes)
            if not len(filled):
                done += 1
                continue
            hidden[filled] = np.add.reduceat(vectors[bucket] * weight[:, None], (np.cumsum(sizes) - sizes)[filled])
            logits = hidden @ out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            step = rate * (1 - done / steps)
            back = p @ out
            out -= step * (p.T @ hidden)
            bias -= step * 0.1 * p.mean(0)
            grad = back[owner] * weight[:, None] * (step * 20)
            for d in range(dim):
                vectors[:, d] -= _scatter(bucket, grad[:, d], 1 << bits)
            done += 1
    return {"vectors": vectors, "out": out, "bias": bias}


def _scatter(bucket: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(bucket, values, minlength=n).astype(np.float32)


def shares(model: dict) -> tuple[np.ndarray, float]:
    """(share of each bucket in the logit of label 1 over label 0, its bias)."""
    return (model["vectors"] @ (model["out"][1] - model["out"][0])).astype(np.float32), float(model["bias"][1] - model["bias"][0])


def score(data: np.ndarray, offsets: np.ndarray, share: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text; texts without words get that of the bias."""
    bucket, owner = features(data, offsets, int(len(share)).bit_length() - 1)
    n = len(offsets) - 1
    total, count = np.bincount(owner, share[bucket], minlength=n), np.bincount(owner, minlength=n)
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows that no fit may see: crc32 of the id as text is a multiple of ``folds``. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, folds: int = 5) -> tuple[np.ndarray, float]:
    """Learns from the labelled rows that aren't held out, at most about ``max_rows`` of them, and returns ``shares``.

    Null labels or labels other than 0 and 1 are left out; null texts are empty; if an id has several labels, the largest counts. The fit runs in
    one executor task, whose rows are bounded by ``max_rows``; the driver gets one number for each bucket (1 MB).
    """
    known = labels.where(F.col(label).isin(0, 1)).where(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = known.count()
    part = known if n <= max_rows else known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.lit(int(max_rows / n * (1 << 20))))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(part), "doc_id").repartition(1)

    def learn(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts).combine_chunks().sort_by([("doc_id", "ascending")])
            texts = table["text"].combine_chunks()
            share, bias = shares(train(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks), table["label"].to_numpy().astype(np.int64)))
            file = io.BytesIO()
            np.savez(file, share=share, bias=bias)
            yield pa.RecordBatch.from_arrays([pa.array([file.getvalue()], pa.binary())], ["model"])

    got = rows.mapInArrow(learn, "model binary").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), 0.0
    file = np.load(io.BytesIO(bytes(got[0]["model"])))
    return file["share"], float(file["bias"])


def add_score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, 0 to 1, from whole texts; null texts are empty. Other columns pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kept = [f for f in docs.schema if f.name != out]

    def run(batches):
        share, bias = sent.value
        for batch in blocks(batches, text, 1 << 19):
            p = score(*text_buffer(batch.column(text)), share, bias)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(p)], [*(f.name for f in kept), out])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """op8's rows: doc_id, held_out, score, predicted."""
    scored = add_score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
