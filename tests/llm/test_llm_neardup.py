import itertools
import random

import corpus_pipeline
from hazeline.llm import neardup


def planted(seed, n=60):
    """(id, text) in pairs with changed words, and some chains, of all similarities from 0.7 on."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 120, 400]))]
        rows.append((len(rows), " ".join(t)))
        for _ in range(1 + i % 3):
            t = list(t)
            for _ in range(rng.randrange(1, max(2, len(t) // 25))):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " \n".join(t).upper()))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "two words"), (len(rows) + 3, "Two  words")]
    rng.shuffle(rows)
    return rows


def similar(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}
    return {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(sorted(sets), 2)}


def test_pipeline_near_stage_is_brute_force_at_08(spark):
    rows = planted(5)
    score, label = similar(rows), {i: i for i, _ in rows}
    for _ in range(9):
        for (i, j), s in score.items():
            if s >= 0.8:
                label[i] = label[j] = min(label[i], label[j])
    for low in (0.8, 0.85, 0.9):
        assert sum(low <= s < low + 0.05 for s in score.values()) >= 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_repeats(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, c in label.items() if i == c)


def passes(x, y):
    """Whether two signatures share a band, and pass the bit sketch and the byte sketch."""
    bits = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x[2:5], y[2:5]))
    return bool((x[1] == y[1]).any()), bits <= neardup.FAR, sum(p == q for p, q in zip(x[5], y[5])) >= neardup.SAME


def test_every_similar_pair_is_a_candidate():
    rows = planted(6, 150)
    marks = {i: neardup.signature_of(t) for i, t in rows}
    for (i, j), s in similar(rows).items():
        if s >= 0.8:
            assert all(passes(marks[i], marks[j]))
        assert (marks[i][0] == marks[j][0]) <= (s == 1)


def boilerplate(n):
    rng = random.Random(8)
    common = [f"license{i}" for i in range(100)]
    return [(i, " ".join(common + [f"o{rng.randrange(10**9)}" for _ in range(45)])) for i in range(n)]


def test_shared_boilerplate_is_not_compared_text_by_text(spark):
    rows = boilerplate(400)
    assert 0.45 < max(similar(rows[:9]).values()) < 0.6
    marks = [neardup.signature_of(t) for _, t in rows]
    numbers = [(i, *m[2:5], m[5], t, m[1].tolist()) for (i, t), m in zip(rows, marks)]
    nodes = spark.createDataFrame(numbers, "n long, b0 long, b1 long, b2 long, wide binary, text string, keys array<long>")
    pairs = spark.createDataFrame([p for p in itertools.combinations(range(400), 2) if all(passes(marks[p[0]], marks[p[1]])[:2])], "a long, b long")
    compared = neardup.close(nodes, pairs).count()
    assert compared < 0.02 * 400 * 399 / 2
    assert neardup.links(nodes).count() == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert neardup.deduplicate(docs).count() == 400


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(4)
    words = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words), 1, "x"), (2, " ".join(words[:55_000]), 2, "y"), (3, "same " * 30_000, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, `sig` string").withColumnRenamed("n", "row")
    kept = neardup.deduplicate(docs)
    assert kept.columns == ["doc_id", "text", "row", "sig"]
    assert sorted((r["doc_id"], r["row"], r["sig"]) for r in kept.collect()) == [(1, 1, "x"), (3, 3, "z")]


def test_a_large_group_and_its_strangers(spark):
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i % 90] + [f"z{i}"] + base[i % 90 + 1:])) for i in range(300)]
    rows += [(900 + i, " ".join(base[:50] + [f"q{i}_{j}" for j in range(50)])) for i in range(20)]
    rows += [(None, " ".join(base)), (None, "none here"), (None, "none here"), (950, rows[310][1] + " end"), (7, rows[7][1])]
    kept = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept) == [-1, 0, *range(900, 920)]
    assert neardup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
