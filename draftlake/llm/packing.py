"""Packing of tokenised documents into sequences by linear grouping: large lengths are rounded up
within groups of equal cardinality, a linear programme over configurations of the few sizes is
solved, documents take the places, and the rest is best-fit into the room that is left.

A length has at most ``capacity`` values, so every decision is taken on counts per length: the driver
sees a table of that size, whatever the corpus. Documents then find their places by their rank within
their length, which is numbered in salted parts, never in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftlake.llm.common import whole
from draftlake.session import cut_lineage

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


# ---- tokens -----------------------------------------------------------------------------------


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library as little-endian 32-bit bytes.

    The file's own vocabulary is applied to pieces of a text that end before white space of one
    character, over which no token reaches from the left, and the ids go to one growing buffer: what a
    task holds beside a text and its ids is bounded. Texts that hold a special token go to the library,
    which is opened when the first of them comes."""

    _SINGLE = re.compile(r"(?<!\s)[ \t\n](?!\s|$)")
    _STEP = 1 << 16

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = list(special)
        letters = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.parts = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _with_special(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > self._STEP:
            found = self._SINGLE.search(text, start + self._STEP)
            if found is None:
                break
            yield text[start:found.start()]
            start = found.start()
        yield text[start:]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._with_special(text)
        out = bytearray()
        for piece in self._pieces(text):
            out += self.parts.encode_to_numpy(piece, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return bytes(out)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all of ``capacity`` but the first, which takes the remainder."""
    first = size % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, size, capacity))]


def tokenised(docs: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: its ids end with ``end_id``; only lengths and a checksum
    leave the task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for part in batches:
            rows = []
            for key, t in zip(part.column(0), part.column(1), strict=True):  # one text at a time as a string
                ids, key = enc.encode(t.as_py()) + end, key.as_py()
                rows += [
                    (key, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]))
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))
                ]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("__id"), whole(text).alias("__text"))
    return source.mapInArrow(pieces, f"doc_id bigint, {PIECES}")


# ---- decisions on counts ----------------------------------------------------------------------


def linear_groups(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, int, int]]:
    """(size, lowest length, number) of the groups of the lengths above ``least``: lengths in
    order, cut into groups of nearly equal cardinality, each rounded up to its longest member."""
    lengths = np.flatnonzero(counts[least + 1:]) + least + 1
    total = counts[lengths].sum()
    out, low, number, passed = [], None, 0, 0
    for n in lengths:
        low = n if low is None else low
        number += counts[n]
        passed += counts[n]
        if passed * groups >= total * (len(out) + 1) or n == lengths[-1]:
            out.append((int(n), int(low), int(number)))
            low, number = None, 0
    return out


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Configuration of greatest price that fits: the best of one member, two members, and so on."""
    room = np.arange(capacity + 1)
    before = room[None, :] - sizes[:, None]
    fits = before >= 0
    before = np.where(fits, before, 0)
    best, taken = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        got = np.where(fits, best[before] + prices[:, None], 0.0)
        taken.append(got.argmax(axis=0))
        following = np.maximum(got.max(axis=0), best)
        taken[-1][got.max(axis=0) <= best + 1e-12] = -1
        best = following
    config, at = np.zeros(len(sizes), int), capacity
    for step in reversed(taken):
        if step[at] >= 0:
            config[step[at]] += 1
            at -= sizes[step[at]]
    return float(best[capacity]), config


def configurations(groups: list[tuple[int, int, int]], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations (members per group, times used) of the linear programme that covers the groups
    with the fewest sequences, by column generation, rounded down. What rounding leaves over is
    placed later with the small lengths, at most one configuration per group."""
    if not groups:
        return []
    sizes, demand = np.array([g[0] for g in groups]), np.array([g[2] for g in groups], float)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, config = _best_configuration(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        use, move = np.linalg.solve(basis, demand), np.linalg.solve(basis, config.astype(float))
        ratio = np.where(move > 1e-9, np.maximum(use, 0) / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(ratio.argmin())] = config
    use = np.linalg.solve(basis, demand)
    return [(basis[:, k].astype(int), int(np.floor(use[k] + 1e-6))) for k in range(len(sizes)) if use[k] >= 1 - 1e-6]


def best_fit(lengths: dict[int, int], room: dict[int, int], capacity: int) -> list[tuple[int, int, list[int]]]:
    """Best-fit, longest first, on counts: (room before, times, lengths put in). ``room`` counts the
    open sequences by the room they have; new sequences have the whole capacity. Runs of equal
    lengths and equal rooms are moved together."""
    states: dict[tuple[int, tuple[int, ...]], int] = {(r, ()): n for r, n in room.items() if n}
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)
    for k in states:
        by_room[k[0]].append(k)
        some[k[0]] = True
    for n in sorted(lengths, reverse=True):
        left = lengths[n]
        while left:
            r = n + int(some[n:].argmax())
            if not some[r]:
                each = capacity // n
                new = -(-left // each)
                states[(capacity, ())] = new
                by_room[capacity].append((capacity, ()))
                some[capacity] = True
                r = capacity
            key = by_room[r][-1]
            fit = r // n
            have = states[key]
            times, put = (min(have, left // fit), fit) if left >= fit else (1, left)
            left -= times * put
            after = (key[0], key[1] + (n,) * put)
            if have == times:
                del states[key]
                by_room[r].pop()
                some[r] = bool(by_room[r])
            else:
                states[key] = have - times
            if after not in states:
                by_room[r - n * put].append(after)
                some[r - n * put] = True
            states[after] = states.get(after, 0) + times
    return [(r, n, list(put)) for (r, put), n in states.items()]


# ---- places -----------------------------------------------------------------------------------


def ranked(rows: DataFrame, by: str, order: list[str], salts: int) -> DataFrame:
    """Rows with ``rank`` from 0 within each value of ``by``. A value is numbered in salted parts and
    the parts are put one behind the other, so a frequent value is no single task; the table of part
    sizes has at most (values of ``by``) x ``salts`` rows."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    parts = salted.groupBy(by, "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(by).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))
    base = parts.select(F.col(by).alias("__by"), F.col("__salt").alias("__part"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = salted.withColumn("__row", F.row_number().over(W.partitionBy(by, "__salt").orderBy(*order)) - 1)
    joined = inside.join(base, (F.col(by) == F.col("__by")) & (F.col("__salt") == F.col("__part")))
    return joined.withColumn("rank", F.col("__row") + F.col("__before")).drop("__salt", "__row", "__by", "__part", "__before")


class Slots:
    """Places for ranks: per key (a group or a length) runs of (first rank, first sequence, members).
    Members of one sequence hold consecutive ranks."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int, int]]] = {}
        self.used: dict[int, int] = {}

    def add(self, key: int, sequence: int, times: int, members: int) -> None:
        first = self.used.get(key, 0)
        self.runs.setdefault(key, []).append((first, sequence, members))
        self.used[key] = first + times * members

    def find(self, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Sequence of every (key, rank); -1 beyond the places."""
        out = np.full(len(keys), -1, np.int64)
        for k in np.unique(keys):
            if k not in self.runs:
                continue
            here = np.flatnonzero((keys == k) & (ranks < self.used[k]))
            run = np.array(self.runs[k], np.int64)
            at = np.searchsorted(run[:, 0], ranks[here], side="right") - 1
            out[here] = run[at, 1] + (ranks[here] - run[at, 0]) // run[at, 2]
        return out


def _placed(rows: DataFrame, slots: Slots, key: str, name: str = "sequence_id") -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(slots)

    @F.pandas_udf("bigint")
    def place(k: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(shared.value.find(k.to_numpy(), r.to_numpy()))

    return rows.withColumn(name, place(F.col(key), F.col("rank")))


def _counts(rows: DataFrame, column: str) -> dict[int, int]:
    """Rows per value of a column with at most ``capacity`` values."""
    return {int(r[0]): int(r[1]) for r in rows.groupBy(column).count().collect()}


def assigned(pieces: DataFrame, capacity: int, *, groups: int = 300, small: int = 3, part_rows: int = 1000) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) with ``sequence_id``. Lengths over ``capacity / small`` are
    large. Broadcast: the runs of configurations, at most (groups + 1)^2 and, for the rest,
    a bounded number per pair of length and room."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in _counts(pieces, "length").items():
        counts[n] = k
    total = int(counts.sum())
    order = ["doc_id", "piece", "start", "ids_crc32"]
    cuts = linear_groups(counts, capacity // small, groups)
    salts = max(1, -(-max([int(counts.max()), *(n for *_, n in cuts)]) // part_rows)) if total else 1
    group_of = np.full(capacity + 1, -1, np.int64)
    for g, (size, low, _) in enumerate(cuts):
        group_of[low:size + 1] = g
    slots, sequences = Slots(), 0
    for config, times in configurations(cuts, capacity):
        for g in np.flatnonzero(config):
            fits = min(times * int(config[g]), cuts[g][2] - slots.used.get(int(g), 0))
            full, part = divmod(fits, int(config[g]))
            if full:
                slots.add(int(g), sequences, full, int(config[g]))
            if part:
                slots.add(int(g), sequences + full, 1, part)
        sequences += times
    table = F.lit(group_of.tolist())
    keyed = pieces.withColumn("group", F.element_at(table, F.col("length").cast("int") + 1))
    large = cut_lineage(_placed(ranked(keyed.where("group >= 0"), "group", order, salts), slots, "group").drop("rank"))
    open_ = large.where("sequence_id >= 0").groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("bigint").alias("room"))
    open_ = cut_lineage(ranked(open_, "room", ["sequence_id"], salts))
    rest = keyed.where("group < 0").unionByName(large.where("sequence_id < 0").drop("sequence_id"))
    fill, begun = Slots(), Slots()  # places of lengths in numbered bins; bins of rooms
    bins = 0
    for room, times, put in sorted(best_fit(_counts(rest, "length"), _counts(open_, "room"), capacity), key=lambda x: (x[0], x[2])):
        for n in sorted(set(put)):
            fill.add(n, bins, times, put.count(n))
        if room < capacity or not put:
            begun.add(room, bins, times, 1)
        bins += times
    filled = _placed(ranked(rest, "length", order, salts), fill, "length", "bin").drop("rank")
    known = _placed(open_, begun, "room", "bin").select("bin", F.col("sequence_id").alias("__open"))
    late = filled.join(known, "bin", "left").withColumn(
        "sequence_id", F.coalesce("__open", F.col("bin") + F.lit(sequences))
    ).drop("bin", "__open")
    return large.where("sequence_id >= 0").unionByName(late).drop("group")


def packed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, tokenizer: str, capacity: int = 2048, **options,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every document.

    Null or empty text is the end id alone; null ids are allowed; rows that repeat are documents of
    their own; other columns take no part; an empty table gives an empty table. Only documents
    longer than ``capacity`` are cut. Offsets have no gap: within a sequence pieces stand in the order
    of id and piece, and a sequence holds at most ``capacity`` tokens, so its window is bounded."""
    pieces = cut_lineage(tokenised(docs, doc_id, text, tokenizer, capacity))
    placed = assigned(pieces, capacity, **options)
    before = W.partitionBy("sequence_id").orderBy("doc_id", "piece", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
