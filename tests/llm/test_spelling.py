import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assetlens.llm import spelling as sp


def words_of(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = words_of(rows)
    form, out = {}, []
    for w in n:
        some = [x for x in n if near(w, x)]
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out.append((w, form[w], n[w], len(some), n[form[w]] if form[w] else None))
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, f, root(w), *rest) for w, f, *rest in out)


def got(spark, rows):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, word string")
    return sorted(tuple(r) for r in sp.variants(df).collect())


def corpus(seed=1):
    rng = random.Random(seed)
    letters = "aabcdeÀéÿ×÷zß"
    base = ["".join(rng.choices(letters, k=rng.randint(7, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "baaaaaaaa"]
    rows = []
    for i in range(150):
        some = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(base)
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            some.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, rng.choice([" ", "-", "1", "ł", "́", "µ"]).join(some)))
    return [*rows, (None, "abcdefgh " * 3), (None, None), (7, ""), (3, rows[3][1])]


@pytest.mark.parametrize("shard,group,block", [(50_000, 24 << 20, 8192), (7, 1, 5)])
def test_against_brute_force(spark, monkeypatch, shard, group, block):
    for k, v in {"SHARD": shard, "GROUP": group, "BLOCK": block, "TASK": 40}.items():
        monkeypatch.setattr(sp, k, v)
    rows = corpus()[: 40 if shard == 7 else None]
    want = brute(rows)
    assert got(spark, rows) == want and sum(r[4] > 2 for r in want) > 2


def test_forms_lead_to_roots(spark):
    w = ["spellins", "spellinsa", "spellinsab", "spellinsabc", "spellinsabcd"]
    rows = [(5, f"{x} " * 2 * 11**k) for k, x in enumerate(w)]
    found = {r[0]: r for r in got(spark, rows)}
    assert got(spark, rows) == brute(rows)
    assert {r[2] for r in found.values()} == {max(found.values(), key=lambda r: r[3])[0]} and len(found) == 5


def test_long_runs(spark):
    long = "ab" * 20_000
    rows = [(1, f"{long} {long} {long}x {long}x"), (2, f"{long[:-1]}é {long[:-1]}é")]
    assert got(spark, rows) == brute(rows)


def test_crc_of_many_words():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcÀÿé", k=rng.randint(1, 90))) for _ in range(200)]
    runs = sp.Runs([" ".join(texts).encode("latin-1")], sp.KINDS)
    states = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], np.uint32)
    assert sp.crcs(runs, np.arange(200), states).tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(texts)]


def test_tries_against_all_pairs():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abÿ", k=rng.randint(0, 6))) for _ in range(300)})
    trie = sp.Trie(words, list(range(len(words))))
    asked = [*words, "zzzz", "abababab"]
    q, w = trie.near(sp.Packed([x.encode("latin-1") for x in asked]))
    assert sorted(zip(q.tolist(), w.tolist())) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b)]


def test_empty_table(spark):
    assert got(spark, [(1, None)]) == []
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sp.variants(df).count() == 0
