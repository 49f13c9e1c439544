"""Near-duplicates by a chosen-path set similarity join: documents branch by the values of selected
minwise coordinates, small nodes are compared exhaustively on the whole sets, and independent trees
are repeated until the wanted share of the links is met."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions.graph import compact, components
from draftlake.llm.common import small_side, whole
from draftlake.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """A pair of similarity s shares a node ``depth`` levels deep in one tree with s**depth, so small
    nodes miss it with (1 - s**depth)**trees: 0.0003 at 0.85.

    ``seeds`` trees give first links and components. Then the nodes of all trees are compared where
    they hold several components: up to ``limit`` sets at once; in larger nodes whose largest
    component leaves at most half the limit outside, these against blocks of that component. Other
    large nodes are crowds: sets that share most of their tokens, such as texts on one template. All
    crowds that share members become one, so each set is dealt with once and not per tree. A crowd
    has a centre, the tokens of most of about ``sample`` of its members, and branches on by what
    distinguishes its members from it (see ``branches``): by the ``chosen`` minwise tokens of the
    difference, rare ones first, and by the most frequent one. ``levels`` bounds the branchings."""

    percent: int = 85
    words: int = 5
    trees: int = 11
    depth: int = 4
    limit: int = 256
    levels: int = 8
    seeds: int = 2
    sample: int = 48
    chosen: int = 24
    block: int = 64

    @property
    def coordinates(self) -> int:
        return self.trees * self.depth


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: words are runs of characters other
    than ASCII white space, A-Z lower-cased; fewer words are one shingle, none are the empty set."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(w), len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(maxsize=4)
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20180).integers(1, 1 << 63, n, np.int64).astype(np.uint64) | np.uint64(1)


def sketch(values: np.ndarray, s: Settings) -> np.ndarray:
    """Minwise coordinates of a set: the least product with each of a fixed row of odd factors."""
    f = _factors(s.coordinates)[:, None]
    out = np.full(s.coordinates, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 1024):
        np.minimum(out, ((values[None, k:k + 1024] ^ (f >> np.uint64(7))) * f).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketched(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """(id, h, n, s1, s2, sketch) per row: hash of the text, size and 128-bit digest of the set, and
    its minwise coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for t in part.column(2):  # one text at a time: a batch may hold very long ones
                v = shingles(t.as_py(), s.words)
                d = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), np.int64)
                rows.append((len(v), int(d[0]), int(d[1]), sketch(v, s) if len(v) else []))
            n, s1, s2, low = zip(*rows, strict=True) if rows else ((), (), (), ())
            made = [pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(list(low), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["id", "h", "n", "s1", "s2", "sketch"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), whole(text).alias("text"))
    return source.mapInArrow(run, "id bigint, h bigint, n bigint, s1 bigint, s2 bigint, sketch array<int>")


def _nodes(sets: DataFrame, s: Settings, trees: range) -> DataFrame:
    """(node, all other columns but the sketch) of every set in the given trees, ``depth`` levels deep."""
    first = F.array(*[F.xxhash64(F.lit(t), *[F.col("sketch")[t * s.depth + k] for k in range(s.depth)]) for t in trees])
    return sets.select(*[c for c in sets.columns if c != "sketch"], F.explode(first).alias("node"))


def seed_leaves(sets: DataFrame, s: Settings) -> DataFrame:
    """(leaf, vid) of the first trees: nodes, and large nodes in blocks by a hash. Links this misses
    are found later."""
    nodes = _nodes(sets.select("vid", "sketch"), s, range(s.seeds))
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    block = F.pmod(F.xxhash64("vid", F.lit(1)), F.ceil(F.col("size") / s.limit))
    return nodes.join(sizes, "node").select(F.xxhash64("node", block).alias("leaf"), "vid")


def _described(nodes: DataFrame) -> DataFrame:
    """Nodes of several components: (node, size, major, major_size, total, mixed). ``major`` is the
    largest component; equal sums and xors tell nodes of equal members."""
    key = F.xxhash64("vid")
    each = nodes.groupBy("node", "comp").agg(
        F.count("*").alias("n"), F.sum(key.cast("decimal(38,0)")).alias("t"), F.bit_xor(key).alias("x")
    )
    return each.groupBy("node").agg(
        F.count("*").alias("comps"), F.sum("n").alias("size"), F.max_by("comp", F.struct("n", "comp")).alias("major"),
        F.max("n").alias("major_size"), F.sum("t").alias("total"), F.bit_xor("x").alias("mixed"),
    ).where("comps > 1")


def leaves(sets: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(leaf, vid) members to compare, of the nodes of all trees that hold several components, and
    (node, vid) members of crowds. Nodes of equal members count once. ``sets``: vid, comp, sketch."""
    nodes = _nodes(sets.select("vid", "comp", "sketch"), s, range(s.trees))
    one = _described(nodes).groupBy("size", "total", "mixed").agg(F.min(F.struct("node", "major", "major_size")).alias("m"))
    named = compact(one.select("size", F.col("m.node").alias("node"), "m.major", "m.major_size"))
    here = compact(nodes.join(named, "node"))
    small, outside = F.col("size") <= s.limit, F.col("size") - F.col("major_size")
    dense = ~small & (outside * 2 <= s.limit)
    blocks = F.ceil(F.col("major_size") / (s.limit - outside)).cast("int")
    own = F.array(F.pmod(F.xxhash64("vid", F.lit(2)), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    dealt = here.where(dense).withColumn("block", F.explode(F.when(F.col("comp") == F.col("major"), own).otherwise(every)))
    out = here.where(small).select(F.col("node").alias("leaf"), "vid").unionByName(
        dealt.select(F.xxhash64("node", F.lit(-1), "block").alias("leaf"), "vid")
    )
    large = here.where(~small & ~dense).select("node", "vid")
    if large.isEmpty():
        return out, large
    met = components(large, "node", "vid")
    crowds = large.join(met, F.col("vid") == F.col("id")).select(F.col("component").alias("node"), "vid").distinct()
    return out, compact(crowds)


def centre(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sets that hold them) of some sets; tokens of one set only count where it is alone."""
    tokens, times = np.unique(np.concatenate(sets), return_counts=True)
    keep = (times > 1) | (2 * times > len(sets))
    return tokens[keep], times[keep].astype(np.int64)


_LACKS = np.uint64(0x5851F42D4C957F2D)


def branches(values: np.ndarray, tokens: np.ndarray, times: np.ndarray, sampled: int, s: Settings) -> tuple[int, list[int]]:
    """(size of the difference to the centre, what to branch by).

    The difference holds the tokens beside the centre and, marked, those of the centre that the set
    lacks. Two sets are as far apart as their differences: sets near each other share much of these,
    or both are near the centre and thus near its closest member. Chosen are the minwise tokens of
    the traits that fewer than two sampled sets have (of all, if there are none), and the trait that
    most of them have, by which parts of the crowd meet that have more in common than the centre."""
    core = 2 * times > sampled
    lack = ~np.isin(tokens, values, assume_unique=True) & core
    beside = np.setdiff1d(values, tokens[core], assume_unique=True)
    traits = np.concatenate([beside, tokens[lack] ^ _LACKS])
    if not len(traits):
        return 0, []
    at = np.searchsorted(tokens, beside)
    hit = at < len(tokens)
    hit[hit] = tokens[at[hit]] == beside[hit]
    count = np.zeros(len(traits), np.int64)
    count[:len(beside)][hit] = times[at[hit]]
    count[len(beside):] = sampled - times[lack]
    rare = traits[count < 2] if (count < 2).any() else traits
    f = _factors(s.chosen)[:, None]
    pick = np.empty(s.chosen, np.int64)
    for k in range(0, s.chosen, 8):  # a few rows at a time bound the memory on long texts
        pick[k:k + 8] = ((rare[None, :] ^ (f[k:k + 8] >> np.uint64(7))) * f[k:k + 8]).argmin(axis=1)
    top = traits[np.lexsort((traits, -count))[0]]
    return len(traits), np.unique(np.r_[rare[pick], top]).view(np.int64).tolist()


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _branched(large: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(node, size, vid, far, keys) of the members of large nodes (node, size, vid)."""

    def centred(part: pd.DataFrame) -> pd.DataFrame:
        tokens, times = centre([_set(x) for x in part["values"]])
        return pd.DataFrame({"node": part["node"][:1], "tokens": [tokens.tobytes()], "times": [times.tobytes()], "sampled": [len(part)]})

    some = large.where(F.pmod(F.xxhash64("node", "vid"), F.col("size")) < s.sample).join(sets, "vid").select("node", "values")
    centres = some.groupBy("node").applyInPandas(centred, "node bigint, tokens binary, times binary, sampled int")
    copies = F.ceil(F.col("size") / 2000).cast("int")  # a row of the centre per so many members: no hot key
    sizes = large.select("node", "size").distinct()
    dealt = centres.join(sizes, "node").select("node", "tokens", "times", "sampled", F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    members = large.join(sets, "vid").withColumn("part", F.pmod(F.xxhash64("vid", F.lit(4)), copies).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for node, size, v, data, tokens, times, n in zip(*[part[c] for c in ("node", "size", "vid", "values", "tokens", "times", "sampled")], strict=True):
                rows.append((node, size, v, *branches(_set(data), _set(tokens or b""), np.frombuffer(times or b"", np.int64), int(n or 0), s)))
            yield pd.DataFrame(rows, columns=["node", "size", "vid", "far", "keys"])

    joined = members.join(dealt, ["node", "part"], "left").select("node", "size", "vid", "values", "tokens", "times", F.coalesce("sampled", F.lit(0)).alias("sampled"))
    return joined.mapInPandas(run, "node bigint, size bigint, vid bigint, far bigint, keys array<bigint>")


def crowd_leaves(work: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(leaf, vid) members to compare within crowds (node, vid). ``sets``: (vid, values).

    Every level, a large node is cut into blocks of ``block`` members, each with the member nearest
    the centre: a star of copies around one text, or a group near its centre, is linked by these
    comparisons. Its members then branch on; nodes of up to ``limit`` sets are compared whole. A set
    is in one block per large node, in one frequent branch and in few rare ones of several members, so
    the work grows in proportion to the crowd."""
    out, key = [], F.xxhash64("vid")
    for level in range(s.levels + 1):
        sizes = work.groupBy("node").agg(F.count("*").alias("size"), F.sum(key.cast("decimal(38,0)")).alias("t"), F.bit_xor(key).alias("x")).where("size > 1")
        one = compact(sizes.groupBy("size", "t", "x").agg(F.min("node").alias("node")).select("node", "size"))
        here = compact(work.join(one, "node"))
        out.append(here.where(F.col("size") <= s.limit).select(F.col("node").alias("leaf"), "vid"))
        large = here.where(F.col("size") > s.limit)
        if large.isEmpty():
            break
        met = compact(_branched(large, sets, s))
        blocks = F.ceil(F.col("size") / s.block).cast("int")
        dealt = met.select("node", "vid", F.pmod(F.xxhash64("vid", F.lit(5)), blocks).cast("int").alias("block"))
        nearest = met.groupBy("node", "size").agg(F.min(F.struct("far", "vid"))["vid"].alias("vid"))
        every = nearest.select("node", "vid", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        out.append(dealt.unionByName(every).select(F.xxhash64("node", F.lit(-2), "block").alias("leaf"), "vid"))
        work = met.select("node", "vid", F.explode("keys").alias("k")).select(F.xxhash64("node", "k").alias("node"), "vid")
    return reduce(DataFrame.unionByName, out)


def linked(vids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Star edges (vid, smallest vid) of the components of one leaf under the exact links: 100 x
    intersection is at least ``percent`` x union on whole sets."""
    n = len(vids)
    size = np.array([len(x) for x in sets])
    if n == 2:
        if 100 * size.min() < percent * size.max():
            return []
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = 100 * both >= percent * (size.sum() - both)
        return [(int(vids.max()), int(vids.min()))] if ok else []
    owner = np.repeat(np.arange(n), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    hit = shared[column]
    row, col = owner[hit], number[column[hit]]
    both = np.zeros((n, n))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for k in range(0, int(shared.sum()), 8192):
        a, b = np.searchsorted(col, [k, k + 8192])
        x = np.zeros((n, 8192), np.float32)
        x[row[a:b], col[a:b] - k] = 1
        both += x @ x.T
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    near[np.arange(n), np.arange(n)] = True
    rest, edges = np.ones(n, bool), []
    for i in np.argsort(vids):
        if not rest[i]:
            continue
        part = np.zeros(n, bool)
        front = np.zeros(n, bool)
        front[i] = True
        while front.any():
            part |= front
            front = near[front].any(axis=0) & ~part
        rest &= ~part
        edges += [(int(vids[j]), int(vids[i])) for j in np.flatnonzero(part) if j != i]
    return edges


def sets_of(vids: DataFrame, docs: DataFrame, sets: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """(vid, values) Whole sets, built again from the texts of the given ids, which are found by a join
    that is broadcast only up to a checked number of ids."""
    wanted = vids.select("vid").distinct().join(sets.select("vid", "h"), "vid")
    keys = small_side(wanted.select(F.col("vid").alias("__v"), F.col("h").alias("__h")))
    rows = docs.join(keys, (F.col(doc_id) == F.col("__v")) & (F.xxhash64(text) == F.col("__h")))
    rows = rows.select(F.col("__v").alias("vid"), whole(text).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            values = [shingles(t.as_py(), s.words).tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.binary())], ["vid", "values"])

    return rows.mapInArrow(build, "vid bigint, values binary")


def verified(members: DataFrame, docs: DataFrame, sets: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """Edges (a, b) between ids of the leaves, by their whole sets."""
    members = compact(members.distinct())
    found = sets_of(members, docs, sets, doc_id, text, s)
    dealt = members.join(found, "vid").repartition("leaf").sortWithinPartitions("leaf", "vid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, vids, sets_, out = None, [], [], []

        def close() -> None:
            if len(vids) > 1:
                out.extend(linked(np.array(vids), sets_, s.percent))

        for part in batches:
            for key, v, data in zip(part["leaf"], part["vid"], part["values"], strict=True):
                if key != leaf:
                    close()
                    leaf, vids, sets_ = key, [], []
                if vids and vids[-1] == v:
                    continue  # a row that repeats
                vids.append(v)
                sets_.append(np.frombuffer(data, np.uint64))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
            out = []
        close()
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(compare, "a bigint, b bigint").distinct()


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, kept) per row of ``docs``; ``h`` is the hash of its text.

    Equal sets are one class, stood for by its smallest id; only classes are compared. Texts without
    words link with nothing. Rows without id link with nothing and stay. Rows that share an id are one
    document with several texts: a link of any of them counts. Repeated rows get the same result. An
    empty table gives an empty table."""
    s = settings or Settings()
    rows = cut_lineage(sketched(docs.select(doc_id, text), doc_id, text, s))
    full = rows.where("n > 0 and id is not null")
    classes = compact(full.groupBy("s1", "s2").agg(F.min(F.struct("id", "h", "sketch")).alias("m")).select("s1", "s2", F.col("m.id").alias("vid"), "m.h", "m.sketch"))
    first = verified(seed_leaves(classes, s), docs, classes, doc_id, text, s)
    seeded = compact(components(first))
    grouped = classes.join(seeded, F.col("vid") == F.col("id"), "left")
    grouped = compact(grouped.select("vid", "h", "sketch", F.coalesce("component", "vid").alias("comp")))
    members, crowds = leaves(grouped, s)
    if not crowds.isEmpty():
        values = sets_of(crowds, docs, grouped, doc_id, text, s).dropDuplicates(["vid"])
        members = members.unionByName(crowd_leaves(crowds, cut_lineage(values), s))
    edges = seeded.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(
        compact(verified(members, docs, grouped, doc_id, text, s))
    )
    same = full.join(classes.select("s1", "s2", "vid"), ["s1", "s2"]).select(F.col("id").alias("a"), F.col("vid").alias("b"))
    several = same.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high")
    extra = same.join(several.select("a"), "a")
    found = components(edges.unionByName(extra))
    component = classes.join(found, F.col("vid") == F.col("id"), "left").select("s1", "s2", F.coalesce("component", "vid").alias("component"))
    own = rows.withColumn("k1", F.when(F.col("n") > 0, F.col("s1"))).withColumn("k2", F.when(F.col("n") > 0, F.col("s2")))
    out = own.join(component.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), "component"), ["k1", "k2"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias("doc_id"), "h", F.col("n").alias("n_shingles"), comp.alias("component_id"),
        (F.col("id").isNull() | (comp == F.col("id"))).alias("kept"),
    )


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that ``near_components`` keeps: one id per component. The others leave by an
    anti-join with id and hash of the text, broadcast up to a checked size."""
    gone = near_components(docs, doc_id, text, settings).where("not kept").select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"))
    on = (F.col(doc_id) == F.col("__d")) & (F.xxhash64(text) == F.col("__h"))
    return docs.join(small_side(gone.distinct()), on, "left_anti")
