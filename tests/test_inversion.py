import random

from hazeline.operators import inversion as iv


def scan(h, t, tol, min_depth=0.0):
    """Plain single-profile scan to compare with."""
    out, i, n = [], 0, len(h)
    while i < n - 1:
        if t[i + 1] > t[i]:
            top = i + 1
            for j in range(i + 2, n):
                if t[j] > t[top]:
                    top = j
                elif t[top] - t[j] > tol:
                    break
            depth = h[top] - h[i]
            if depth >= min_depth and depth > 0 and t[top] - t[i] > 0:
                out.append((h[i], h[top], "surface" if i == 0 else "elevated"))
            i = top
        else:
            i += 1
    return out


def layers(spark, profiles, tol=0.2, depth=0.0, exact=False):
    rows = [(p, float(h), float(t)) for p, (hs, ts) in profiles.items() for h, t in zip(hs, ts)]
    df = spark.createDataFrame(rows, "profile long, height_m double, temp_c double").repartition(3)
    got = iv.inversion_layers_exact(df, depth) if exact else iv.inversion_layers(df, tol, depth)
    out = {}
    for r in got.collect():
        out.setdefault(r["profile"], []).append((r["base_height"], r["top_height"], r["kind"]))
    return {p: sorted(v) for p, v in out.items()}


def test_worked_profiles(spark):
    p = {
        1: ([0, 100, 200, 300, 400], [8, 10, 12, 11, 9]),
        2: ([0, 100, 200, 300, 400, 500], [15, 14, 14.5, 17, 15, 13]),
        3: ([0, 100, 200, 300, 400], [20, 18.5, 17, 15.5, 14]),
        4: ([0, 100, 200, 300, 400, 500, 600, 700], [10, 14, 12, 11, 15, 18, 14, 12]),
        5: ([0, 1, 2, 3, 4], [10, 12, 11.9, 11.95, 11.0]),
    }
    got = layers(spark, p)
    assert got[1] == [(0, 200, "surface")]
    assert got[2] == [(100, 300, "elevated")]
    assert 3 not in got
    assert got[4] == [(0, 100, "surface"), (300, 500, "elevated")]
    assert got[5] == [(0, 1, "surface"), (2, 3, "elevated")]


def test_random_profiles_match_plain_scan(spark):
    r = random.Random(5)
    p = {k: (list(range(n)), [r.choice([0, 1, 1.1, 1.15, 2, 3]) for _ in range(n)]) for k, n in enumerate([1, 2, 900] + [r.randrange(3, 40) for _ in range(60)])}
    for tol, depth in ((0.2, 0.0), (1.0, 2.0), (0.0, 0.0)):
        want = {k: sorted((float(a), float(b), c) for a, b, c in scan(h, t, tol, depth)) for k, (h, t) in p.items()}
        want = {k: v for k, v in want.items() if v}
        assert layers(spark, p, tol, depth) == want
    assert layers(spark, p, exact=True) == want


def test_strongest_and_bad(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0), (1, 2.0, 0.0), (1, 3.0, 2.0)], "profile long, height_m double, temp_c double")
    best = iv.strongest_inversion(iv.inversion_layers_exact(df)).first()
    assert (best["base_height"], best["strength_c"]) == (0.0, 2.0)
    raw = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 0.0, 2.0), (2, 0, 0.0, 1.0), (2, 1, 5.0, None), (2, 2, 6.0, 1.0)], "profile long, o int, height_m double, temp_c double")
    assert [tuple(r) for r in iv.bad_profiles(raw, ["o"]).collect()] == [(1, 1)]
