import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import collocations as co
from assetlens.llm.runs import Runs, portions


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if 2 <= len(p) <= 4 and a >= least}
        best = []
        for p, a in some.items():
            around = [b for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in around):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(count=150, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "in", "été", "öl", "a" * 70, "b", "c", "x9", "9x"]
    fixed = ["new york city hall", "Of The", "the the the the the"]
    rows = []
    for _ in range(count):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for p in parts)
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    return [*rows, (None, None), ("en", ""), ("de", " .. "), (None, "the of"), ("fr", rows[0][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 7) for i, r in enumerate(rows)], "doc_id long, lang string, text string, a int")


@pytest.mark.parametrize("least,top", [(5, 2000), (12, 6)])
def test_against_brute_force(spark, least, top):
    rows = corpus()
    got = [tuple(r) for r in co.collocations(frame(spark, rows), least=least, top=top).collect()]
    want = brute(rows, least, top)
    assert sorted(got) == want and len(want) > 10


def test_small_bitmaps_and_portions_change_nothing(spark, monkeypatch):
    rows = corpus(60, 4)
    monkeypatch.setattr(co, "PORTION", 100)  # long texts are cut
    monkeypatch.setattr(co, "MOST", 4)  # at least one chunk of buckets, but only 16 bits for frequent runs
    monkeypatch.setattr(co, "FEWEST", 4)
    monkeypatch.setattr(co, "GATHER", 10)
    got = [tuple(r) for r in co.collocations(frame(spark, rows), least=4).collect()]
    assert sorted(got) == brute(rows, 4, 2000)


def test_words_of_equal_hash_are_counted_by_themselves(monkeypatch):
    monkeypatch.setattr(Runs, "_hashes", lambda self: np.zeros(len(self.start), np.uint64))
    runs = Runs([b"aa bb aa cc", b"bb aa"], co.KINDS)
    at, h, n = runs.counted(np.arange(6), runs.hash, 1)
    found = Counter()
    for p, k in zip(runs.phrases(at, 1).to_pylist(), n.tolist()):
        found[p] += k
    assert found == {"aa": 3, "bb": 2, "cc": 1}


def test_portions_lose_nothing():
    texts = [b"a b.c d,e", b"", b"no break here at all", b"x." * 50]
    back = defaultdict(bytes)
    for which, parts in portions(texts, co.BREAK, 8):
        assert all(len(p) <= 10 or b"no break" in p for p in parts)
        for i, p in zip(which, parts):
            back[i] += p
    assert back == {i: t for i, t in enumerate(texts) if t}


def test_bits_of_hashes(spark):
    hashes = [0, 1, 5, -1, -7, 1 << 40, (1 << 63) - 1]
    bits = co.Bits(co.hashed_bits(spark.createDataFrame([(h,) for h in hashes], "h long")))
    assert bits.holds(np.array(hashes, np.int64).view(np.uint64)).all()
    assert np.unpackbits(bits.bits).sum() == len({h & int(bits.mask) for h in hashes})


def test_bucket_counts_end_at_the_threshold(spark):
    rows = [(c, p) for part in ([3] * 300 + [70_000], [3, 9, 9, 70_000]) for c, p in co.packed(np.array(part, np.uint32))]
    bits = co.full_buckets(spark.createDataFrame(rows, "chunk int, packed binary"), 1 << 17, 3)
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == [3]
    assert np.flatnonzero(np.unpackbits(co.full_buckets(spark.createDataFrame(rows, "chunk int, packed binary"), 1 << 17, 2), bitorder="little")).tolist() == [3, 9, 70_000]


def test_exact_scores_of_large_counts(spark):
    """Products beyond 64 bits."""
    a, both = 9_000_000_000_000_000_001, 18_440_000_000_000_000_001
    row = spark.createDataFrame([(a, both // 2, both - both // 2)], "a long, l long, r long")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    got = row.withColumn("both", exact("l") + exact("r")).withColumn("whole", exact("a") * F.lit(co.SCALE).cast("decimal(7,0)")).selectExpr("whole div both").first()[0]
    assert got == 2_000_000 * a // both


def test_empty_table(spark):
    assert co.collocations(frame(spark, corpus(1)).where("false")).count() == 0
