import hashlib
import random
import re
from collections import Counter

import pytest

from assetlens.llm.substring_dedup import kept_digest, repeats


def brute(rows, size=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"é{rng.randrange(10**6)}"
    passages = [[word() for _ in range(k)] for k in (34, 35, 36, 52, 53, 70, 120)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "same " * 36), (4, "Same " * 34), (5, " ".join(passages[0]))]
    for i in range(n):
        w = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(passages)
            a = rng.randrange(len(p)) if rng.random() < 0.3 else 0
            w += p[a:] + [word() for _ in range(rng.randrange(40))]
        rows.append((10 + i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows + [rows[-1], rows[-2], (9000, rows[-3][1])]


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 200)])
def test_against_brute_force(spark, seed, n):
    rows = corpus(seed, n)
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, chunk int, payload string")
    assert sorted(map(tuple, kept_digest(repeats(docs)).collect())) == brute(rows)


def test_other_window(spark):
    rows = [(i, " ".join(random.Random(i % 7).choices("abcdefgh", k=60))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, kept_digest(repeats(docs, 6)).collect())) == brute(rows, 6)


def test_empty_table_and_null_keys(spark):
    assert repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(map(str, range(35)))
    rows = repeats(spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_words, r.n_removed) for r in rows] == [(None, 35, 35)] * 2
