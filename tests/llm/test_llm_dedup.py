import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hazeline.llm import components, exactdedup, simhash

SCHEMA = "doc_id long, text string, fp string, digest string, n int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def slow_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, threshold=4):
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(fps, 2):
            if (a ^ b).bit_count() <= threshold and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def sample_texts(rng, n):
    words = [f"w{i}" for i in range(300)] + ["É", "été", "\u00a0x"]
    texts = []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 120, 200]))]
        texts.append(" \t\n".join(t[:2]) + " " + " ".join(t[2:]))
        if len(t) > 100:
            t[rng.randrange(len(t))] = "changed"
            texts.append(" ".join(t))
            texts.append(" ".join(t).upper())
    return texts


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for t in sample_texts(random.Random(1), 40) + [None, "", " \n", "a", "a b c d", "a b c d e"]:
        assert simhash.fingerprint_of(t) & (2**64 - 1) == slow_fingerprint(t)


@pytest.mark.parametrize("blocks,pick", [(3, 1), (5, 2)])
def test_every_pair_within_the_threshold_meets(blocks, pick):
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**63, 500).astype(np.uint64)
    two = one.copy()
    for i in range(len(two)):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            two[i] ^= np.uint64(1) << np.uint64(b)
    code, syn = simhash.code(4, blocks, pick), simhash.syndromes()
    homes, visits = [set() for _ in one], [set() for _ in one]
    for rows, keys, home in simhash.anchors(one, code, syn):
        for i, k in zip(rows.tolist(), keys.tolist()):
            if home:
                homes[i].add(k)
    for rows, keys, _ in simhash.anchors(two, code, syn):
        for i, k in zip(rows.tolist(), keys.tolist()):
            visits[i].add(k)
    assert all(h & v for h, v in zip(homes, visits))


def test_near_duplicates_match_all_pairs(spark):
    texts = sample_texts(random.Random(5), 60) + [None, "", "the same", "the same"]
    rows = list(enumerate(texts))
    got = {r["id"]: r for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    want = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["fp"] & (2**64 - 1) == slow_fingerprint(t) for i, t in rows)


@pytest.mark.parametrize("bucket", [3, 8192])
def test_large_groups_of_close_fingerprints_are_salted_and_complete(spark, bucket):
    rng = np.random.default_rng(8)
    fps = {0: 0}
    for i in range(1, 400):  # a chain and a ball around zero, and a stranger now and then
        near = fps[int(rng.integers(0, i))] if i % 7 else int(rng.integers(0, 2**63))
        for b in rng.choice(64, 2, replace=False):
            near ^= 1 << int(b)
        fps[i] = near
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    df = spark.createDataFrame(rows, "rep long, fp long").groupBy("fp").agg(F.min("rep").alias("rep"))
    links = simhash.links(df, bucket=bucket)
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    want = slow_components(list(fps.items()))
    reps = [r["rep"] for r in df.collect()]
    assert all(found.get(i, i) == want[i] for i in reps)
    assert links.count() <= 60 * len(reps)


def test_simhash_deduplicate_keeps_one_row_of_a_group(spark):
    line = " ".join(f"w{i}" for i in range(150))
    rows = [(5, line), (3, line + " end"), (9, None), (9, None), (8, ""), (7, "alone here"), (None, "no id")]
    out = simhash.deduplicate(docs_of(spark, rows))
    assert out.columns == ["doc_id", "text", "fp", "digest", "n"]
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 3, 7, 8]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert simhash.deduplicate(docs_of(spark, [])).count() == 0


def test_components_of_chains_stars_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 200)] + [(1, i) for i in range(2, 50)] + [(7, 7), (300, 299), (299, 300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 201)} | {i: 1 for i in range(1, 50)} | {299: 299, 300: 299}


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_duplicates(spark):
    rows = [(1, "a"), (4, "a"), (2, "a "), (3, None), (6, ""), (5, "b" * 200_000), (7, "A"), (None, "b"), (9, "z"), (9, "z")]
    got = [(r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in exactdedup.find_duplicates(docs_of(spark, rows)).collect()]
    by = {}
    for i, t in rows:
        by.setdefault(sha(t), []).append(i)
    want = [(i, max((x for x in by[sha(t)] if x is not None), default=None), len(by[sha(t)])) for i, t in rows]
    assert sorted(map(repr, got)) == sorted(repr((i, k, n, i == k, sha(t))) for (i, t), (_, k, n) in zip(rows, want))
    out = exactdedup.deduplicate(docs_of(spark, rows))
    assert out.columns == ["doc_id", "text", "fp", "digest", "n"]
    assert sorted(map(repr, (r["doc_id"] for r in out.collect()))) == sorted(map(repr, [4, 2, 6, 5, 7, None, 9]))
    assert exactdedup.find_duplicates(docs_of(spark, [])).count() == 0
    assert exactdedup.deduplicate(docs_of(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_strangers_group_apart(spark):
    history = spark.range(3000).select(exactdedup.digest(F.col("id").cast("string")).alias("digest"), "id")
    index = exactdedup.build_index(exactdedup.group(history))
    slots = index.slots.select("shard", "slot").collect()
    assert len(set(slots)) == 3000 and {r["slot"] for r in slots} == set(range(3000))
    new = docs_of(spark, [(1, "5"), (2, "5"), (3, "new"), (4, "new"), (5, "other")])
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exactdedup.find_duplicates(new, index).collect()}
    assert got == {1: (5, 1, False), 2: (5, 1, False), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}
