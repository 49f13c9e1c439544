import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from draftlake.llm import mixing, packing, quality_model
from tests.llm import frames

TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_those_of_the_library():
    enc, lib, r = packing.encoder(TOKENS), Tokenizer.from_file(TOKENS), random.Random(3)
    parts = ["a", "The ", " ", "  ", "\n", " \n", "\n ", "é", "ß", "'s", " 12", "%%", "\t", "<|endoftext|>", "日本", " ", "  ", "word", "\x1c"]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_packed_awkward_rows(spark):
    df = frames.awkward(spark).unionByName(frames.frame(spark, [(100 + i, frames.prose(i, 30 + 17 * i)) for i in range(60)]))
    got = packing.packed(df, tokenizer=TOKENS, capacity=256, groups=20, part_rows=7).toPandas()
    lib = Tokenizer.from_file(TOKENS)
    want = Counter()
    for r in df.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut(len(ids), 256)):
            want[(r.doc_id, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()))] += 1
    have = Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 256 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert got.sequence_id.nunique() <= math.ceil(1.15 * got.length.sum() / 256)
    assert packing.packed(frames.empty(spark), tokenizer=TOKENS).count() == 0


def test_groups_have_equal_cardinality_and_configurations_fit():
    r = np.random.default_rng(2)
    counts = np.bincount(r.integers(300, 1000, 20_000), minlength=1001)
    cuts = packing.linear_groups(counts, 250, 20)
    assert sum(n for *_, n in cuts) == counts.sum() and max(n for *_, n in cuts) < 1.1 * min(n for *_, n in cuts)
    chosen = packing.configurations(cuts, 1000)
    sizes = np.array([s for s, *_ in cuts])
    assert all(c @ sizes <= 1000 for c, _ in chosen)
    placed = sum(c * n for c, n in chosen)
    assert all(0 <= cut[2] - p <= cut[2] * 0.05 + 40 or p > cut[2] for cut, p in zip(cuts, placed, strict=True))


def test_best_fit_places_everything():
    out = packing.best_fit({5: 7, 3: 4, 9: 1}, {4: 2, 6: 1}, 10)
    put = Counter(x for _, n, p in out for x in p for _ in range(n))
    assert put == {5: 7, 3: 4, 9: 1} and all(sum(p) <= room for room, _, p in out)
    assert sum(n for room, n, _ in out if room == 4) == 2 and sum(n for room, n, _ in out if room == 6) == 1


def test_temperature_meets_target_and_limit():
    tokens = {"a": 9000, "b": 500, "c": 500, "z": 0}
    alpha, w, p = mixing.temperature(tokens, mixing.Settings(entropy=0.9, repeats=50))
    assert abs(mixing.entropy(w) - 0.9 * math.log(3)) < 1e-6 and 0 < alpha < 1 and min(p.values()) == 1 and "z" not in w
    _, _, p = mixing.temperature(tokens, mixing.Settings(entropy=1.0, repeats=3))
    assert abs(max(p.values()) - 3) < 1e-6
    assert mixing.temperature({}, mixing.Settings()) == (1.0, {}, {})


def test_mix_against_brute_force(spark):
    df = frames.awkward(spark).unionByName(frames.frame(spark, [(100 + i, frames.prose(i, 40)) for i in range(90)])).unionByName(
        frames.frame(spark, [(1000 + 3 * i, frames.prose(i + 500, 40)) for i in range(500)]))
    s = mixing.Settings(entropy=0.98, repeats=3, block_tokens=500)
    got = mixing.mix(df, settings=s).toPandas()
    rows = df.toPandas()
    n = rows.text.fillna("").map(lambda t: len(t.split()))
    key = rows.source.fillna("?")
    tokens = n.groupby(key).sum().to_dict()
    _, w, p = mixing.temperature(tokens, s)
    taken = got.mix.map(lambda m: m["n_tokens"]).groupby(got.source.fillna("?")).sum()
    for k in tokens:
        longest = n[key == k].max()
        if tokens[k]:
            assert p[k] * tokens[k] - 1 <= taken[k] <= p[k] * tokens[k] + 2 * longest  # a budget is met, but for its last row
        per = Counter(got[got.source.fillna("?") == k].doc_id.fillna(-1))
        full = int(p.get(k, 1) + 1e-9)
        have = Counter(rows[key == k].doc_id.fillna(-1))
        assert set(per) == set(have) and all(full * have[d] <= per[d] <= (full + 1) * have[d] for d in per)
    again = mixing.mix(df.repartition(7), settings=s).toPandas()
    assert Counter(got.doc_id.fillna(-1)) == Counter(again.doc_id.fillna(-1))
    assert mixing.mix(frames.empty(spark)).count() == 0


def test_small_budget_deals_part_of_the_rows(spark):
    df = frames.frame(spark, [(100 + i, frames.prose(i, 50)) for i in range(300)])
    got = mixing.mix(df, settings=mixing.Settings(budget=3000, block_tokens=400)).toPandas()
    assert 3000 <= got.mix.map(lambda m: m["n_tokens"]).sum() <= 3000 + 3 * 50 and got.doc_id.is_unique


def test_features_do_not_depend_on_the_batch():
    s = quality_model.Settings(buckets=1 << 12)
    texts = [frames.CLEAN, "", " a a ", "ü日", "a " * 500, frames.prose(1, 200), "b"]
    w = np.random.default_rng(1).normal(size=s.buckets + 1).astype(np.float32)
    one = [quality_model.log_odds([t], 1, w, s)[0] for t in texts]
    assert np.allclose(quality_model.log_odds(texts, len(texts), w, s), one, atol=1e-9)
    for t, z in zip(texts, one, strict=True):
        ids, share = quality_model.counted(t.encode(), s)
        assert abs(share @ w[ids] + w[-1] - z) < 1e-4


def test_held_out_accuracy_and_leaks(spark):
    bad = lambda i: " ".join(x + "###" for x in frames.prose(i, 60).split())
    df = frames.frame(spark, [(i, bad(i) if i % 4 == 0 else frames.prose(i, 60)) for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    s = quality_model.Settings(buckets=1 << 14, updates=2_000)
    got = quality_model.classify(df, labels, settings=s).toPandas()
    assert all(q["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, q in zip(got.doc_id, got.quality, strict=True))
    held = got[got.quality.map(lambda q: q["held_out"])]
    assert (held.quality.map(lambda q: q["predicted"]) == (held.doc_id % 4 != 0).astype(int)).mean() > 0.97
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    same = quality_model.classify(df, flipped, settings=s).toPandas()
    assert np.allclose(got.quality.map(lambda q: q["score"]), same.quality.map(lambda q: q["score"]))


def test_classifier_awkward_rows(spark):
    df = frames.awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_model.classify(df, none).toPandas()
    assert len(got) == 12 and all(q["score"] == 0.5 and q["predicted"] == 1 for q in got.quality) and (got.kept == "no").all()
    assert quality_model.classify(frames.empty(spark), none).count() == 0
