"""Supervised subword embeddings: hashed word and character n-gram vectors averaged per document,
softmax output, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import whole


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows the fit reads (those with the smallest hash of their id);
    ``max_bytes`` bounds the bucket shares of one such row (its most frequent buckets) and so what the
    driver holds. ``buckets`` and ``dim`` bound the model, which is the only thing that is broadcast.
    ``updates`` steps are made however many rows there are. ``pad`` zero vectors join every average, so
    a few words cannot decide a short text."""

    buckets: int = 1 << 18
    dim: int = 8
    sizes: tuple[int, ...] = (3, 4)
    max_rows: int = 4000
    max_bytes: int = 65_536
    updates: int = 20_000
    rate: float = 0.5
    seed: int = 7
    pad: int = 40


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20


def _mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    h = h ^ (h >> np.uint32(12))
    return (h & np.uint32(buckets - 1)).astype(np.int32)


def features(data: bytes, s: Settings, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of every feature of the text: words, pairs of words, whether a word repeats the
    one before (pairs that back off to two buckets), and character n-grams within a word and its
    neighbouring spaces. Places tell the document where several are joined by white space;
    ``begins`` are then the places where documents begin, which no pair of words crosses."""
    b = np.frombuffer(b" " + data + b" ", np.uint8)
    space = _SPACE[b]
    c = np.where(space, np.uint8(32), b).astype(np.uint32) + np.uint32(1)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    places, found = [], []
    if len(starts):
        inside = np.arange(len(c)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(c)]))
        power = np.cumprod(np.full(int((ends - starts).max()) + 1, 0x01000193, np.uint32), dtype=np.uint32)
        value = np.where(space, 0, c * power[np.minimum(inside, len(power) - 1)]).astype(np.uint32)
        word = np.add.reduceat(value, starts, dtype=np.uint32)
        places.append(starts)
        found.append(_mixed(word + np.uint32(0x9E3779B9), s.buckets))
        later = np.ones(len(starts), bool)
        first = np.searchsorted(starts, [0] if begins is None else begins)
        later[first[first < len(starts)]] = False
        pair = np.flatnonzero(later)
        places.append(starts[pair])
        found.append(_mixed(word[pair - 1] * np.uint32(0x9E3779B1) + (word[pair] ^ (word[pair] >> np.uint32(13))), s.buckets))
        places.append(starts[pair])
        found.append((word[pair] == word[pair - 1]).astype(np.int32))
    gaps = np.r_[0, np.cumsum(space)]
    for n in s.sizes:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x85EBCA6B) + c[k:k + m]
        ok = np.flatnonzero(gaps[n - 1:n - 1 + m] == gaps[1:1 + m])  # no space but at the ends
        places.append(ok)
        found.append(_mixed(h[ok], s.buckets))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(places), np.concatenate(found)


def counted(data: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares of its features."""
    total = np.zeros(s.buckets, np.float64)
    for k in range(0, max(1, len(data)), _CHUNK):
        total += np.bincount(features(data[k:k + _CHUNK], s)[1], minlength=s.buckets)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), (total[ids] / (total.sum() + s.pad)).astype(np.float32)


def _frequent(ids: np.ndarray, share: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) <= most:
        return ids, share
    kept = np.sort(np.lexsort((ids, -share))[:most])
    return ids[kept], share[kept]


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Share of every bucket in the log odds of label 1, and the bias as last element.

    The hidden vector is the mean of bucket vectors and the output a softmax of two classes, so the
    fitted layers fold into one number per bucket; scoring with it is the same function."""
    rng = np.random.default_rng(s.seed)
    labels = np.array([y for *_, y in examples], int)
    bias = np.zeros(2)
    if len(set(labels.tolist())) < 2:  # no labels: undecided; one class: close to certain
        only = 0.0 if not len(labels) else (4.0 if labels[0] == 1 else -4.0)
        return np.r_[np.zeros(s.buckets), only].astype(np.float32)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    out = np.zeros((2, s.dim))
    step = 0
    while step < s.updates:
        for i in rng.permutation(len(examples))[:s.updates - step]:
            ids, share, y = examples[i]
            rate = s.rate * (1 - step / s.updates)
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * p
            vectors[ids] -= (rate * len(ids) ** 0.5) * np.outer(share, back)
            step += 1
    return np.r_[vectors @ (out[1] - out[0]), bias[1] - bias[0]].astype(np.float32)


def log_odds(texts: Iterable[str], number: int, weights: np.ndarray, s: Settings) -> np.ndarray:
    """Log odds of label 1 of ``number`` whole texts. Short texts share one pass, long ones take several."""
    sums, counts = np.zeros(number), np.zeros(number)
    pending, owners, size = [], [], 0

    def flush() -> None:
        nonlocal pending, owners, size
        if pending:
            lengths = np.array([len(x) + 1 for x in pending])
            ends = np.cumsum(lengths)
            places, ids = features(b" ".join(pending), s, np.r_[0, ends[:-1]] + 1)
            # features() puts one space before; a place in the space between two texts is the later one's
            doc = np.asarray(owners)[np.minimum(np.searchsorted(ends, places, side="right"), len(owners) - 1)]
            sums[:] += np.bincount(doc, weights[ids], number)
            counts[:] += np.bincount(doc, minlength=number)
        pending, owners, size = [], [], 0

    for i, t in enumerate(texts):
        data = t.encode()
        for k in range(0, len(data), _CHUNK):
            pending.append(data[k:k + _CHUNK])
            owners.append(i)
            size += len(pending[-1])
            if size > _CHUNK:
                flush()
    flush()
    return sums / (counts + s.pad) + weights[-1]


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, s: Settings, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights from labelled rows where ``allowed`` holds: at most ``max_rows`` of them, those with
    the smallest hash of the id. Null labels, and ids with both labels, are left out; an id given twice
    counts once. Their texts become bucket shares in the tasks; the driver receives
    these one partition at a time and runs the descent."""
    given = labels.where(F.col(label).isin(0, 1) & allowed).select(F.col(doc_id).alias("__k"), F.col(label).cast("int").alias("label"))
    known = given.groupBy("__k").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = known.orderBy(F.xxhash64("__k"), "__k", "label").limit(s.max_rows)
    rows = docs.select(F.col(doc_id).alias("__k"), whole(text).alias("text")).join(F.broadcast(chosen), "__k")

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            pairs = [_frequent(*counted(t.encode(), s), s.max_bytes // 8) for t in part["text"]]
            yield pd.DataFrame({"k": part["__k"], "label": part["label"], "ids": [a.tobytes() for a, _ in pairs], "share": [b.tobytes() for _, b in pairs]})

    found = rows.select("__k", "label", "text").mapInPandas(shares, "k bigint, label int, ids binary, share binary")
    examples = sorted(
        ((r.k, r.label, bytes(r.ids), bytes(r.share)) for r in found.toLocalIterator()), key=lambda r: r[:2]
    )
    return train([(np.frombuffer(i, np.int32), np.frombuffer(w, np.float32), y) for _, y, i, w in examples], s)


def score(docs: DataFrame, weights: np.ndarray, s: Settings, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1. Null text counts as empty and gets the probability
    of the bias alone; repeated rows are scored alike; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def probability(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for t in parts:
            yield pa.array(1 / (1 + np.exp(-log_odds((x.as_py() for x in t), len(t), w, s))), pa.float64())

    probability = F.arrow_udf(probability, "double")

    return docs.withColumn(name, probability(whole(text)))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """Remainder of the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(1))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", *, threshold: float = 0.3, settings: Settings | None = None) -> DataFrame:
    """Every row of ``docs`` with a struct ``quality`` (held_out, score, predicted). The fit never
    sees labels of the held-out fold; label, language, source and id are never part of a score.
    Without labels every score is 0.5."""
    s = settings or Settings()
    weights = fit(docs, labels, label, fold(F.col("doc_id")) != 0, s)
    scored = score(docs, weights, s, name="__score")
    rest = [c for c in docs.columns if c != "quality"]
    return scored.select(*rest, F.struct(
        (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("__score").alias("score"),
        F.when(F.col("__score") >= threshold, 1).otherwise(0).alias("predicted"),
    ).alias("quality"))
