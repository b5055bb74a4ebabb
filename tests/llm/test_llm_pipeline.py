import random

import corpus_pipeline
import numpy as np
from hazeline.llm import queries


def test_pipeline_rejects_what_it_should_and_keeps_the_rest(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ba", "re", "ti", "on", "me"]) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = {i: text(rng.randrange(60, 160)) for i in range(300)}, {}
    for i in range(0, 60):
        docs[i] = docs[i] + ". You stupid idiot, " + word()
    for i in range(200):
        labels[i] = int(i < 60)
    docs[300] = docs[299]  # exact copy: the larger id stays
    docs[301] = docs[298] + " end"  # near copy: the smaller id stays
    item = text(30)
    docs[302] = text(50) + " " + " ".join(item.split()[5:20]).upper() + " " + text(20)
    docs[303], docs[304] = None, ""
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in rows}
    assert kept == set(range(60, 299)) | {300, 304}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_near_dedup_keeps_one_document_of_each_simhash_component(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        for copy in range(rng.randrange(1, 4)):
            rows.append((at, " ".join(base + ["end"] * copy)))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op1_simhash(spark, str(tmp_path)).collect()
    want = {r["component_id"] for r in found}
    assert 40 <= len(want) < len(rows)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_repeats(spark, docs, str(tmp_path)).collect()} == want


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(queries.ORACLES) <= set(names)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "best_fit_packing"]
