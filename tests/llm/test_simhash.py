"""SimHash groups against all pairs."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from registra.llm import simhash
from registra.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(f, radius=4):
    return np.bitwise_count(f[:, None] ^ f[None, :]) <= radius


def crowd(n, centres, flips, seed):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return f


def test_forest():
    for seed in range(4):
        f, bucket = crowd(700, 30, 3, seed), np.sort(np.random.default_rng(seed).integers(0, 5, 700))
        want = components(700, np.argwhere(near(f) & (bucket[:, None] == bucket[None, :])).tolist())
        pairs = simhash.forest(bucket, f, 4)
        assert components(700, pairs) == want and len(pairs) == 700 - len(set(want))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "ONE two"), (9006, "one two"), (9007, "é É " * 3000)], docs.schema)
    every = docs.union(more).union(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 5000)).withColumn("fp", F.lit("clash")).withColumn("id", F.lit(1))
    got = sorted(map(tuple, simhash.near_duplicates(every).collect()))
    rows = sorted(every.select("doc_id", "text").collect())
    f = np.array([brute_fingerprint(t) for _, t in rows], dtype=np.uint64)
    want = [(i, f"{x:016x}", rows[c][0]) for (i, _), x, c in zip(rows, f.tolist(), components(len(rows), np.argwhere(near(f)).tolist()))]
    assert got == want


def test_tiles_lose_no_link(spark):
    f = np.unique(crowd(600, 3, 2, 9))
    nodes = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    want = components(len(f), np.argwhere(near(f)).tolist())
    for tile in (8, 2048):
        at = {int(x): i for i, x in enumerate(f.view(np.int64))}
        pairs = [(at[r.a], at[r.b]) for r in simhash.links(nodes, tile=tile).collect()]
        assert components(len(f), pairs) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100} or got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(words), n, replace=False):
        out[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_similar_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    texts = []
    for k in range(12):
        words = [f"w{rng.integers(4000)}" for _ in range(int(rng.integers(120, 400)))]
        texts += [" ".join(words), " ".join(words).upper()] + [edited(rng, words, n) for n in (1, 2, 3, 4, 6, 9, 14, 30)]
    crowd_words = [f"c{i}" for i in range(200)]
    texts += [edited(rng, crowd_words, 2) for _ in range(60)] + ["", None, " ", "one two", "one two", "two one", "x " * 8000]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (not sets[i] and not sets[j]) or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    want = components(len(texts), pairs)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for tile, set_tile in ((2048, 256), (16, 8)):
        got = {r.id: r.component for r in simhash.similar(rows, tile=tile, set_tile=set_tile).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "a"), (1, text, "b"), (1, text, "c"), (2, "other words here entirely different", "d"), (None, text, "e"), (None, "alone null id text", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r["__row"]) for r in kept.collect()) in ([(0, "f"), (1, "b"), (2, "d")], [(0, "f"), (1, "c"), (2, "d")])
    unique = docs.where("doc_id > 1").union(spark.createDataFrame([(9, text.upper(), "g")], docs.schema))
    assert sorted(r.doc_id for r in simhash.keep_one(unique).collect()) == [2, 3] and simhash.keep_one(unique).columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


def repeated_lines():
    """Texts of which one copy has a line many times, texts of 8 to 12 words, and texts without a near copy."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(30):
        words = [f"w{rng.integers(1 << 30)}" for _ in range(204)]
        line = " ".join(words[50:62])
        texts += [" ".join(words), " ".join(words) + (" " + line) * 20]
    for n in (8, 9, 10, 11, 12):
        words = [f"s{rng.integers(1 << 30)}" for _ in range(n)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join([*words, "more", "words"]), " ".join(["other", *words[1:]]), " ".join([*words, *words])]
    return texts + [" ".join(f"u{rng.integers(1 << 30)}" for _ in range(50)) for _ in range(5)]


def brute_components(texts):
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in split]
    return components(len(texts), [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])])


def test_similar_with_repeated_lines_and_short_texts(spark):
    texts = repeated_lines()
    want = brute_components(texts)
    assert all(want[2 * i + 1] == 2 * i for i in range(30)) and len(set(want)) < len(want) - 30
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for tile, set_tile in ((2048, 256), (4, 4)):
        got = {r.id: r.component for r in simhash.similar(rows, tile=tile, set_tile=set_tile).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_pipeline_stage_against_all_pairs(spark):
    import corpus_pipeline

    texts = repeated_lines() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == sorted(set(brute_components(texts)))


def test_parities_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.6, 1)], rng.integers(0, 1 << 64, int(n * rng.uniform(0, 0.3)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        pairs = simhash.possible_pairs(np.array([len(a), len(b)]), [simhash.parities(x) for x in (a, b)], 0.8)
        assert pairs or not len(b) or both < 0.8 * (len(a) + len(b) - both)
    a, b = (np.unique(rng.integers(0, 1 << 64, 1000, dtype=np.uint64)) for _ in range(2))
    assert simhash.possible_pairs(np.array([1000, 1000]), [simhash.parities(x) for x in (a, b)], 0.8) == []


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "one two three four five"), (4, "one two three four five"), (None, "alone here and nowhere else"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), (r.component_id or 0)) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 4), (2, 2), (4, 4)]


def test_pivots_spare_comparisons(spark):
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = np.unique(np.concatenate([[centre], centre ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))]))
    far = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    f = np.unique(np.concatenate([near, far]))
    keyed = spark.createDataFrame([(int(x), int(x), 1) for x in f.view(np.int64)], "node long, fp long, key long")
    want = components(len(f), np.argwhere(simhash.np.bitwise_count(f[:, None] ^ f[None, :]) <= 4).tolist())
    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    for tile in (4, 16, 64, 1000):
        pairs = [(at[r.a], at[r.b]) for r in simhash._bucket_links(keyed, 4, tile).collect()]
        assert components(len(f), pairs) == want
