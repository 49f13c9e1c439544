"""Operators 11 to 13 against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
from pyspark.sql import functions as F

from draftlake.llm import manifest, queries, sharding, spelling
from tests.llm import frames

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 5:
                found[run] += 1
    return found


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [(v, m) for v, m in counts.items() if one_edit(w, v)]
        best = min(near, key=lambda x: (-x[1], x[0]), default=None)
        out[w] = (best if best and best[1] >= 2 * n else None, n, len(near))
    result = {}
    for w, (form, n, k) in out.items():
        end = w
        while out[end][0]:
            end = out[end][0][0]
        result[w] = (form[0] if form else None, end, n, k, form[1] if form else None)
    return result


def test_word_counts(spark):
    r = random.Random(3)
    pool = ["Straße", "ÉCOLE", "école", "x×÷y", "Haus", "HäuserÿÿĀbc", "abcde", "naïveté"]
    texts = [(i, " ".join(r.choice(pool) + r.choice(["", "s", "-", "1"]) for _ in range(60))) for i in range(80)]
    df = frames.awkward(spark).unionByName(frames.frame(spark, texts + [(None, "Straße ÉCOLE"), (7, "q" * 300_000)]))
    got = {x.word: x.n for x in spelling.word_counts(df).collect()}
    assert got == brute_words([(x.doc_id, x.text) for x in df.collect()])
    assert spelling.word_counts(frames.empty(spark)).count() == 0


def test_neighbours_meet_once():
    """Of two reduced words one edit apart exactly one makes the other, and nothing else is made."""
    words = [tuple(w) for n in range(1, 6) for w in product((1, 2, 3), repeat=n)]
    own = {w: int(spelling.Reduced(np.array([w])).own()[0]) for w in words}
    assert len(set(own.values())) == len(words)
    names, met = {k: w for w, k in own.items()}, Counter()
    for w in words:
        for _, keys, same in spelling.Reduced(np.array([w])).neighbours(3):
            assert not same or keys.tolist() == [own[w]]
            met.update(frozenset((w, names[k])) for k in keys.tolist() if not same and k in names)
    assert set(met.values()) == {1}
    assert set(met) == {frozenset((a, b)) for a, b in combinations(words, 2) if one_edit(a, b)}


def test_variants_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 8))) for _ in range(60)]
    counts = Counter()
    for w in base:
        counts[w] += r.randint(20, 90)
        for _ in range(12):
            v = list(w)
            for _ in range(r.randint(1, 2)):
                k = r.randrange(len(v))
                v[k:k + r.randint(0, 1)] = r.choice(["", "a", "ÿ", "e"])
            counts["".join(v)] += r.choice([3, 3, 5, 10, 20])
    counts["longword" * 4000] = 9
    counts["longword" * 3999 + "longwrd"] = 4
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    want = brute_variants(counts)
    for symbols in (8, 2):
        got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(df, symbols).collect()}
        assert got == want
    assert any(f and f != e for f, e, *_ in want.values())  # chains of forms
    assert spelling.variants(df.where("false")).count() == 0


def test_op11_on_a_small_table(spark, tmp_path):
    r = random.Random(5)
    words = [frames.prose(k, 1) * 2 for k in range(40)]
    texts = [(i, " ".join(r.choice(words).title() for _ in range(400))) for i in range(60)]
    frames.frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter({w: n for w, n in brute_words(texts).items() if n >= 3})
    got = {x.word: tuple(x)[1:] for x in queries.op11_reduced_alphabet(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants(counts) and len(got) > 40


def brute_loads(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    for n in sorted(sizes, reverse=True):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + n, i))
    return sorted(heap)


def test_heap_deals_equal_sizes_at_once():
    r = random.Random(2)
    for _ in range(60):
        shards = r.randint(1, 9)
        classes = sorted(((r.randint(1, 40), r.randint(1, 70)) for _ in range(r.randint(0, 12))), reverse=True)
        dealt = sharding.longest_first(classes, shards)
        loads = Counter({i: 0 for i in range(shards)})
        for (size, count), got in zip(classes, dealt):
            assert sum(n for _, n in got) == count
            for i, n in got:
                loads[i] += n * size
        assert sorted((v, k) for k, v in loads.items()) == brute_loads([s for s, n in classes for _ in range(n)], shards)


def check_shards(rows, got, shards):
    by_text, slots, size = {}, {}, Counter()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for x in got:
        by_text.setdefault((x.size, x.text_crc32), set()).add(x.shard)
        slots.setdefault(x.shard, []).append(x.slot)
        size[x.shard] += x.size
    assert all(len(v) == 1 for v in by_text.values()) and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size


def test_shards_against_the_heap(spark):
    r = random.Random(4)
    texts = [(i, frames.prose(r.randint(1, 400), r.randint(1, 90))) for i in range(700)] + [(800 + i, CLEAN_COPY) for i in range(300)]
    df = frames.awkward(spark).unionByName(frames.frame(spark, texts)).repartition(7)
    rows = [(x.doc_id, x.text) for x in df.collect()]
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    for s in (sharding.Settings(shards=6, bits=40), sharding.Settings(shards=6, bits=40, part_rows=5)):
        size = check_shards(rows, sharding.shard_rows(df, settings=s).collect(), 6)
        assert sorted(size[i] for i in range(6)) == [n for n, _ in brute_loads(groups.values(), 6)]
    coarse = check_shards(rows, sharding.shard_rows(df, settings=sharding.Settings(shards=2, bits=4)).collect(), 2)
    assert max(coarse.values()) < 1.05 * min(coarse.values()) or max(groups.values()) > 0.5 * sum(groups.values())
    assert sharding.shard_rows(frames.empty(spark)).count() == 0


CLEAN_COPY = frames.CLEAN + " again"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def brute_tree(leaves):
    """(root, siblings left and right per leaf)"""
    nodes, steps = list(leaves), [[] for _ in leaves]
    place = list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[k:k + 3] for k in range(0, len(nodes), 3)]
        for i, p in enumerate(place):
            run = runs[p // 3]
            steps[i].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
            place[i] = p // 3
        nodes = [h(*run) for run in runs]
    return nodes[0], steps


def brute_manifest(rows):
    none = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        members = sorted(groups[s], key=lambda r: (none(r.doc_id), leaf_of(r, r.text)))
        trees.append((members, *brute_tree([leaf_of(r, r.text) for r in members])))
    root, above = brute_tree([t[1] for t in trees])
    out = []
    for (members, sub, steps), up in zip(trees, above):
        for r, own in zip(members, steps):
            path = own + up
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            cur = leaf_of(r, text)
            for a, b in path:
                cur = h(a, cur, b)
            out.append((r.doc_id, leaf_of(r, r.text), sub, root, h(*[a + b for a, b in path]), cur, cur == root))
    return out


def test_manifest_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    texts = [(i, frames.prose(i, 3) + r.choice(["", "\n", "\nend"])) for i in range(900)]
    big = frames.frame(spark, texts).withColumn("source", F.when(F.col("doc_id") % 9 < 6, "hot").otherwise(F.concat(F.lit("ß"), (F.col("doc_id") % 41).cast("string"))))
    df = frames.awkward(spark).unionByName(big).repartition(9)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in queries.op13_nested_intervals(spark, str(tmp_path)).collect()]
    want = brute_manifest(df.collect())
    assert Counter(got) == Counter(want) and {x[6] for x in got} == {True, False}


def test_manifest_of_few_rows(spark, tmp_path):
    for n in (0, 1, 3, 4, 28):
        df = frames.frame(spark, [(i, f"t{i}\n") for i in range(n)] or [(0, "")]).withColumn("source", F.lit(None).cast("string"))
        df = df if n else df.where("false")
        df.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = Counter(tuple(x) for x in queries.op13_nested_intervals(spark, f"{tmp_path}/{n}").collect())
        assert got == (Counter(brute_manifest(df.collect())) if n else Counter())
    rows = df.select("*", manifest.leaf(F.col("doc_id")).alias("leaf")).withColumn("root", F.lit("x"))
    assert set(manifest.manifest(rows).columns) == set(rows.columns) | {"subroot", "steps"}
