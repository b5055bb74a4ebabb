import itertools
import math
import random

import numpy as np
import pytest
from hazeline.llm import hardneg
from pyspark.sql import functions as F


@pytest.mark.parametrize("axes, bits", [(2, 3), (3, 2), (4, 2), (2, 5)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    key = hardneg.hilbert_key(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(-300, 300, (7, 9)), rng.integers(-300, 300, (20, 9))
        low, high = hardneg.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
        scores = a @ b.T
        assert (low <= scores).all() and (scores <= high).all()
    big = np.array([[1 << 40, 3]])
    assert hardneg.products(big, np.array([[5, 1], [1 << 30, 0]])).tolist() == [[(5 << 40) + 3, hardneg.LIMIT]]


def plain(rows, positives=5, negatives=5, percent=80):
    kept = {}
    for i, vec, label in rows:
        if i is not None and label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            kept[i, label, tuple(math.floor(256 * x) for x in vec)] = 1
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, vec in kept:
        if i % 100:
            continue
        scored = sorted((-dot(vec, v), j, m) for j, m, v in kept if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(n, -t) for t, n, m in scored if m != label and percent * -s <= 100 * -t <= 100 * -s]
            out += [(i, p, r, n, -s, t) for r, (n, t) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, id int")
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("id") % 100 == 0, **more).collect())


def test_against_plain_search(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(0, 0.2, 6)], int(rng.integers(0, 3))) for i in range(900)]
    hot = rows[1][1]
    rows += [(900 + i, hot, i % 2) for i in range(450)]  # one vector with a third of the rows
    rows += [(5000, None, 1), (5001, [1.0, None], 1), (5002, [float("nan")] * 6, 1), (5003, [float("inf")] * 6, 1), (5004, rows[0][1], None),
             (None, rows[0][1], 1), (5100, [], 1), (5200, [0.5], 2), *rows[:50], (-300, rows[3][1], 0)]
    want = plain(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, block_rows=16, pack_rows=3) == want


def test_blocks_are_pruned_by_their_bounds(spark):
    rng = random.Random(1)
    rows = [(i, [float(1 + i % 2) if d == i % 8 else 0.01 * rng.random() for d in range(8)], i % 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    used = hardneg.usable(df, "id", "vec", "label", 256)
    shape = hardneg.layout(used)
    blocks = hardneg.build_blocks(used, shape, F.col("id") % 100 == 0, 5, block_rows=32)
    packs = hardneg.build_packs(blocks, shape, pack_rows=4)

    def wanted(row):
        floor = np.frombuffer(row.floors, "<i8")[:, None]
        return floor, np.full_like(floor, hardneg.LIMIT)

    chosen = hardneg.choose_blocks(packs, blocks, shape, wanted, same_label=True)
    read = chosen.agg(F.sum(F.bit_count(F.conv(F.hex("need"), 16, 10).cast("long")))).first()[0]
    assert 20 <= read < 20 * blocks.count() / 2


def test_small_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 0), (3, [-1.0], 0), (4, [0.8], 0)]) == [
        (0, 1, 1, 2, 65536, 65536)]
    assert mined(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 0)]) == []  # a score below zero has no window
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 0)]) == [(0, 1, 1, 2, 0, 0)]
