import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hazeline.llm import periodic, queries, repetition

SPACE = "\t\n\x0b\x0c\r "


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def windows_hit(w, size):
    count = Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    return {p for i in range(len(w) - size + 1) if count[tuple(w[i:i + size])] > 1 for p in range(i, i + size)}


def plain_measures(text, least):
    text, w = text or "", words_of(text)
    lines = [line for line in text.split("\n") if words_of(line)]
    subs = {}
    for i in range(len(w)):
        for m in range(least, len(w) - i + 1):
            subs.setdefault(tuple(w[i:i + m]), []).append(i)
    maximal = [s for s, at in subs.items() if len(at) > 1 and len({w[p - 1] if p else None for p in at}) > 1
               and len({w[p + len(s)] if p + len(s) < len(w) else None for p in at}) > 1]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(windows_hit(w, 3)),
            len(windows_hit(w, least)), max(map(len, maximal), default=0), len(maximal))


def some_texts(rng, n):
    for _ in range(n):
        letters = ["a", "b", "é#", "ß", "c c", "|"][:rng.randint(1, 6)]
        yield "".join(rng.choice(letters) + rng.choice([" ", " ", "\n", "\t ", "\x0c", " "]) for _ in range(rng.randint(0, 30)))


def test_measures_as_counted_by_hand():
    rng = random.Random(5)
    for _ in range(60):
        texts = ["", *some_texts(rng, 4), " \n "]
        for text, row in zip(texts, repetition._group_rows(texts, 4), strict=True):
            assert row[:8] == plain_measures(text, 4), text
            spans = {p for a, b in zip(row[8], row[9]) for p in range(a, b)}
            assert spans == windows_hit(words_of(text), 4)


@pytest.mark.parametrize("symbols", [[0] * 5000, [0, 1] * 3000, list(range(700)) * 6, [7]])
def test_suffix_array_of_repeats(symbols):
    sa, lcp = repetition.suffix_array(np.array(symbols))
    assert sorted(sa.tolist()) == list(range(len(symbols)))
    for i in range(1, len(sa), max(1, len(sa) // 50)):
        a, b = symbols[sa[i - 1]:], symbols[sa[i]:]
        assert a < b and a[:lcp[i]] == b[:lcp[i]] and (len(a) == lcp[i] or a[lcp[i]] != b[lcp[i]])


def test_judge_rules_and_edges(spark):
    rng = random.Random(2)
    plain = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage, line = plain(120), plain(13)
    texts = {
        1: plain(49), 2: plain(50), 3: f"{plain(300)} {passage} {plain(300)} {passage}", 4: f"{line}\n{plain(200)}\n{line}",
        5: "x " * 20_000, 6: "\n".join([line] * 5 + [plain(60)]), 7: None, 8: "", 9: plain(100) + " #*$%&|<>",
        10: plain(60) + " " + " ".join(f"{plain(11)} " * 2 for _ in range(10)), 11: plain(400_000),
    }
    rows = [(i, t, "n", 1) for i, t in texts.items()] + [(2, texts[2], "n", 1), (None, texts[4], "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int")
    got = [r.asDict() for r in repetition.judge(docs).collect()]
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert {i for i in texts if by[i]["kept"]} == {2, 4, 9, 11}
    assert {i for i in texts if by[i]["base_failed"]} >= {1, 5, 7, 8}
    assert not by[3]["base_failed"] and by[3]["longest_repeat"] == 120 and by[3]["n_covered"] == 240
    assert (by[4]["starts"], by[4]["stops"]) == ([0, 213], [13, 226]) == (by[None]["starts"], by[None]["stops"])
    assert by[6]["n_dup_lines"] == 4 and by[9]["n_symbols"] == 8 and by[7]["n_words"] == by[8]["n_words"] == 0
    assert by[5]["longest_repeat"] == 19_999 and by[5]["n_repeats"] == 19_990
    assert repetition.judge(docs.limit(0)).count() == 0


def plain_runs(w, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            if n >= max(least, 2 * q) and not any(all(w[k] == w[k - d] for k in range(s + d, j)) for d in range(1, q)):
                out.append((s, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, kind = rng.randint(0, 110), rng.randrange(4)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        out = []
        while len(out) < n:
            out += ([rng.randrange(3) for _ in range(rng.randint(1, 20))] * rng.randint(1, 8))[:rng.randint(1, 90)]
        return out
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    out = [0] * n
    for _ in range(rng.randrange(4)):
        out[rng.randrange(n):][:1] = [1] if n else []
    if n:
        out[rng.randrange(n)] = 1
    return out


@pytest.mark.parametrize("least", [2, 5, 12, 20])
def test_runs_for_any_way_of_appending(least):
    rng = random.Random(least)
    for _ in range(60):
        w = some_words(rng)
        want = plain_runs(w, least)
        for step in (1 << 16, rng.randint(2, 40), 1):
            assert periodic.runs_of(np.array(w, np.int64), least, step) == want, (w, step)
        catcher, got, at = periodic.SquareCatcher(least), [], 0  # the number of words is not known beforehand
        while at < len(w):
            more = rng.randint(1, 30)
            got += catcher.append(np.array(w[at:at + more], np.int64))
            at += more
        assert sorted(got + catcher.finish(), key=lambda r: (r[0], r[2])) == want


def test_runs_of_long_texts():
    for symbols, want in (([0] * 200_000, (0, 200_000, 1)), (list(range(900)) * 200, (0, 180_000, 900))):
        assert periodic.runs_of(np.array(symbols)) == [want]
    assert periodic.runs_of(np.random.default_rng(0).integers(0, 10**6, 300_000)) == []


def plant(doc, text):
    w = words_of(text)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def test_query_against_plain_form(spark, tmp_path):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice(["ja", "né", "wo", "be", "x"][:rng.randint(2, 5)]) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    texts += [(400, None), (401, ""), (402, "o " * 30_000), (None, "k " * 20), (402, "o " * 30_000)]
    schema = "doc_id long, text string, runs string, n_runs int"
    spark.createDataFrame([(*t, "r", 1) for t in texts], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for doc, text in texts:
        w = plant(doc, text)
        runs = plain_runs(w, 12) if len(set(w)) > 1 else [(0, len(w), 1)] if len(w) > 11 else []
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(doc, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
              sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    assert got == want
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 20
    empty = spark.createDataFrame([], schema)
    assert periodic.collapse(empty).count() == 0
