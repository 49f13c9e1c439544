"""Spelling variants by a reduced alphabet: letters are hashed to a few symbols, every reduced word is
given its whole one-edit neighbourhood, neighbourhoods meet the reduced vocabulary, and the pairs found
are verified on the words themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import small_side, whole
from draftlake.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[^A-Za-z\x{C0}-\x{FF}]+"
SYMBOLS = 10
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Keys of one step: bounds the memory of a task whatever the length of a word.
_STEP = 1 << 20


def damaged(doc_id: Column, run: Column, every: int = 97) -> Column:
    """The run, or without one code point where ``every`` divides the CRC-32 of id and run."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.left(run, at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 5) -> DataFrame:
    """(word, n): occurrences of the words of all whole texts, A-Z lower-cased. Null texts have none;
    a run in a row without id stays as it is. Counts are combined before the shuffle, so a frequent
    word is one row per task."""
    lower = F.translate(whole(text), UPPER, LOWER)
    runs = docs.select(F.col(doc_id).alias("__id"), F.explode(F.split(lower, NOT_WORD)).alias("run")).where("run <> ''")
    words = runs.select(F.coalesce(damaged(F.col("__id"), F.col("run")), F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))


def reduced(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """Symbols 1 to ``symbols`` of words of one length, a row per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return (codes * np.uint32(0x9E3779B1) >> np.uint32(20)) % np.uint32(symbols) + np.uint32(1)


def _key(value: np.ndarray, length: int) -> np.ndarray:
    value = value ^ (value >> np.uint64(31))
    return ((value + np.uint64(length)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


class Reduced:
    """Polynomial hashes of reduced words of one length, from which the hash of any one-edit neighbour
    follows without building it."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, (rows, self.length) = codes.astype(np.uint64), codes.shape
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(self.length, _BASE, np.uint64)], dtype=np.uint64)
        zero = np.zeros((rows, 1), np.uint64)
        self.before = np.hstack([zero, np.cumsum(self.codes * self.power[:-1], axis=1, dtype=np.uint64)])
        self.total = self.before[:, -1:]

    def own(self) -> np.ndarray:
        return _key(self.total[:, 0], self.length)

    def neighbours(self, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(row, key, same) of the reduced words themselves (``same``) and of those one edit away. Of
        two neighbours one makes the other: a replacement is made from the smaller symbol, a deletion from
        the longer word, at the begin of a run of one symbol, so none is made twice."""
        rows, n = self.codes.shape
        yield np.arange(rows), self.own(), True
        every = np.arange(1, symbols + 1, dtype=np.uint64)
        before_it = np.hstack([np.zeros((rows, 1), np.uint64), self.codes])
        step = max(1, _STEP // (rows * symbols))
        for a in range(0, n, step):
            here, last = self.codes[:, a:a + step], before_it[:, a:a + step]
            r, k, d = np.nonzero(here[:, :, None] < every)
            yield r, _key(self.total[r, 0] + (every[d] - here[r, k]) * self.power[a + k], n), False
            r, k = np.nonzero(here != last[:, :here.shape[1]])
            rest = self.total[r, 0] - self.before[r, a + k + 1]
            yield r, _key(self.before[r, a + k] + rest * np.uint64(_INVERSE), n - 1), False


def _keyed(vocabulary: DataFrame, symbols: int, all_: bool) -> DataFrame:
    """(key, vid, same) of the reduced words, or of their neighbourhoods too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            lengths = part["word"].str.len()
            for n, group in part.groupby(lengths):
                take = max(1, _STEP // (int(n) * symbols * 2))
                for k in range(0, len(group), take):
                    some = group.iloc[k:k + take]
                    vid = some["vid"].to_numpy()
                    words = Reduced(reduced(some["word"].tolist(), symbols))
                    if all_:
                        for row, key, same in words.neighbours(symbols):
                            yield pd.DataFrame({"key": key, "vid": vid[row], "same": same})
                    else:
                        yield pd.DataFrame({"key": words.own(), "vid": vid, "same": True})

    return vocabulary.select("vid", "word").mapInPandas(run, "key bigint, vid bigint, same boolean")


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, b) of all vids of ``vocabulary`` (vid, word) whose words differ by exactly one inserted,
    deleted or replaced code point, each pair in both orders.

    Words one edit apart have reduced words at most one edit apart, so no pair is missed. Every pair
    is met through one key and from one side: of two different reduced words one makes the other, and
    words of one reduced word meet with the smaller vid first."""
    left = _keyed(vocabulary, symbols, True).withColumnRenamed("vid", "a")
    right = _keyed(vocabulary, symbols, False).select(F.col("key").alias("__k"), F.col("vid").alias("b"))
    met = left.join(right, (F.col("key") == F.col("__k")) & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")
    first = vocabulary.select(F.col("vid").alias("a"), F.col("word").alias("wa"))
    second = vocabulary.select(F.col("vid").alias("b"), F.col("word").alias("wb"))
    pairs = met.join(first, "a").join(second, "b").where(F.levenshtein("wa", "wb", 1) == 1).select("a", "b")
    return cut_lineage(pairs).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(vid, root) of (vid, form): the last word reached by following forms. The reach doubles per
    round; counts at least double per step, so chains are short and never close."""
    reach = cut_lineage(forms.select("vid", F.col("form").alias("root")))
    while True:
        on = small_side(reach.select(F.col("vid").alias("__v"), F.col("root").alias("__next")))
        moved = cut_lineage(reach.join(on, F.col("root") == F.col("__v"), "left").select(
            "vid", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")
        ))
        reach = moved.select("vid", "root")
        if moved.where("moved").isEmpty():
            return reach


def variants(words: DataFrame, symbols: int = SYMBOLS, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per row of ``words`` (word, n), which holds a word once.

    ``form``: of the words one edit away the most frequent (ties: first in code-point order), if it is
    at least ``ratio`` (2 or more) times as frequent. Null or empty words must not be given; an empty
    table gives an empty table."""
    vocabulary = cut_lineage(cut_lineage(words.select("word", "n")).withColumn("vid", F.monotonically_increasing_id()))
    other = vocabulary.select(F.col("vid").alias("b"), F.col("word").alias("wb"), F.col("n").alias("nb"))
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("wb").alias("word"), F.col("b").alias("vid"))).alias("best")
    near = near_pairs(vocabulary, symbols).join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), best)
    joined = cut_lineage(vocabulary.join(near, F.col("vid") == F.col("a"), "left").select(
        "vid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= F.col("n") * ratio, F.col("best")).alias("best")
    ))
    ends = roots(joined.where("best is not null").select("vid", F.col("best.vid").alias("form"))).select(F.col("vid").alias("__v"), F.col("root").alias("__end"))
    last = vocabulary.select(F.col("vid").alias("__t"), F.col("word").alias("__root"))
    out = joined.join(ends, F.col("vid") == F.col("__v"), "left").join(last, F.col("__end") == F.col("__t"), "left")
    return out.select(
        "word", F.col("best.word").alias("form"), F.coalesce("__root", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n")
    )
