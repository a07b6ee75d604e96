"""Word runs, resampling and the Jaccard join against brute force."""

import math
import random
import zlib
from hashlib import sha256

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import jaccard_join, resampling, word_runs

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in WHITE:
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def plain_runs(x):
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            s = k
            while k < n - q and x[k] == x[k + q]:
                k += 1
            if k > s and k - s + q >= max(12, 2 * q):
                out.setdefault((s, k + q), q)
            k += k == s
    return sorted((s, q, e - s) for (s, e), q in out.items())


def run_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        kinds, size = rng.choice([1, 2, 3, 7, 40]), rng.choice([0, 3, 11, 12, 13, 40, 150])
        words = [f"w{rng.randrange(kinds)}" for _ in range(size)]
        for _ in range(rng.randrange(3)):
            if size:
                a, p, to = rng.randrange(size), rng.randint(1, size // 3 + 1), rng.randint(1, size)
                for i in range(a, to):
                    words[i] = words[a + (i - a) % p]
        yield rng.choice([" ", "\n", "  \t"]).join(words)


def plain_digest(doc_id, text):
    words = words_of(text)
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, q, k in runs)]
    lines = "".join(f"{s},{k},{q}\n" for s, q, k in runs)
    best = min(((-k, s, q) for s, q, k in runs), default=None)
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *longest, sha256(lines.encode()).hexdigest(),
            sha256(" ".join(kept).encode()).hexdigest())


def test_runs_are_those_of_brute_force(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(run_texts(5, 300))] + [(None, "a b " * 9), (2**60 + 1, "x " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, word_runs.digests(docs).collect()), key=repr)
    assert got == sorted((plain_digest(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 50


def test_runs_across_slices_and_in_long_texts():
    for words, want in ((["a"] * 20_000, [(0, 1, 20_000)]), (["a", "b", "c"] * 5_000, [(0, 3, 15_000)])):
        numbers = np.unique(words, return_inverse=True)[1].astype(np.int64)
        s, e, q = word_runs.find_runs(numbers, np.array([len(words)]))
        assert [(int(a), int(c), int(b - a)) for a, b, c in zip(s, e, q)] == want
    thue = [bin(i).count("1") % 2 for i in range(4096)]  # fools polynomial hashes
    s, e, q = word_runs.find_runs(np.array(thue), np.array([4096]))
    assert sorted(zip(s.tolist(), q.tolist(), (e - s).tolist())) == plain_runs(thue)


def test_collapsed_texts(spark):
    rows = [(1, "go on  and\non"), (2, "a b " * 10 + "end"), (3, None)]
    out = word_runs.collapsed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "go on  and\non", 2: "a b end", 3: None}


def plain_grams(text, max_words):
    words, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            word += c
        elif word:
            words, word = words + [word], ""
    return words, [" ".join(words[i:i + n]) for n in range(1, max_words + 1)
                   for i in range(len(words) - n + 1)]


def plain_resample(docs, target, max_words, buckets, min_words, percent):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for g in plain_grams(t, max_words)[1]:
                out[zlib.crc32(g.encode()) % buckets] += 1
        return out

    s, t = counts(d[1] for d in docs), counts(target)
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets))))
            for x, y in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        words, grams = plain_grams(text, max_words)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams)
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(grams), weight, score, None, len(words)])
    able = [r for r in rows if r[5] >= min_words]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("max_words", [1, 3])
def test_resampling_is_that_of_brute_force(spark, max_words):
    rng = random.Random(max_words)
    pool = [f"{w}{i}" for w in ("Ab", "é", "x9", "ﬀ") for i in range(30)]
    docs = [(i, rng.choice([" ", "-", ". "]).join(rng.choices(pool, k=rng.randrange(40)))) for i in range(200)]
    docs += [(None, "no id " * 30), (None, None), (7, None), (8, ""), (2**60 + 1, "A1 b2 " * 20),
             (3, docs[3][1]), (300, "...")]
    target = [" ".join(rng.choices(pool[:20], k=30)) for _ in range(10)] + [None, ""]
    got = resampling.resample(
        spark.createDataFrame(docs, "doc_id long, text string").withColumns(
            {c: F.lit("x") for c in ("part", "place", "rank", "score", "n", "bucket")}),
        spark.createDataFrame([(t,) for t in target], "text string"),
        max_words=max_words, buckets=500, min_words=10, percent=30)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target, max_words, 500, 10, 30)


def plain_groups(docs, percent=90, n=3):
    sets = []
    for _, text in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = words_of(text)
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), d if not s else least.get(find(i)))
                   for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def near_copies(seed, groups, each, size):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice(size))]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return [(5 * i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("parts", [None, 64])
def test_join_finds_the_links_of_brute_force(spark, monkeypatch, parts):
    if parts:  # blocks cut at many task ends
        monkeypatch.setattr(jaccard_join, "tasks_for", lambda df, size: parts)
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    docs = near_copies(1, 40, 6, [3, 9, 10, 11, 19, 20, 21, 40, 150]) + near_copies(2, 1, 120, [90])
    docs += [(None, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (6, "one two"), (None, "one two"),
             (None, "only here without id"), (2**60 + 1, docs[0][1]), (docs[1][0], docs[1][1]),
             (7, docs[2][1].upper())]
    clashing = {c: F.lit("x") for c in ("uid", "content", "n", "key", "pivot", "band", "root", "fold")}
    got = jaccard_join.groups(spark.createDataFrame(docs, "doc_id long, text string").withColumns(clashing))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_groups(docs)


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    bands = jaccard_join.Bands()
    for _ in range(200):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: len(a) - n // 40], rng.integers(0, 2**63, n // 40).astype(np.uint64)])
        blocks = bands.blocks(bands.of(len(a))[0])
        x, y = jaccard_join.sketch(a, blocks), jaccard_join.sketch(b, blocks)
        apart = len(np.setxor1d(a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= apart
        assert int(np.bitwise_count(jaccard_join.folded(x) ^ jaccard_join.folded(y)).sum()) <= apart
        if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
            common = set(bands.of(len(a))) & set(bands.of(len(b)))
            assert any((jaccard_join.sketch(a, bands.blocks(g)) == jaccard_join.sketch(
                b, bands.blocks(g))).any() for g in common)


OPERATORS = [word_runs.digests, jaccard_join.groups,
             lambda d: resampling.resample(d, d.select("text").limit(3))]


@pytest.mark.parametrize("operator", OPERATORS)
def test_awkward_rows(spark, operator):
    docs = corpus.documents(spark)
    assert corpus.ids(operator(docs).collect()) == corpus.ids([{"doc_id": r[0]} for r in corpus.ROWS])
    assert operator(corpus.documents(spark, [])).collect() == []
