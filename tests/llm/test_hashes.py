"""Words that hashes made of sums of powers take for one, and a large family of near copies around a common passage."""

import hashlib
import random

import numpy as np
import pytest

from assetlens.llm.common import Words
from assetlens.llm.ngram_join import similar_groups
from assetlens.llm.substring_dedup import kept_digest, repeats
from tests.llm.test_ngram_join import shingles
from tests.llm.test_simple8b import thue_morse


@pytest.mark.parametrize("n", [7, 8, 9, 63, 64, 65, 1024, 2048, 8192])
def test_different_words_have_different_hashes(n):
    a, b = thue_morse(n)
    words = Words([f"{a} {b} {a}".encode(), a.encode()])
    h = words.hash
    assert h[0] == h[2] == h[3] and h[0] != h[1]
    assert words.differ(np.array([0, 0, 0]), np.array([1, 2, 3])).tolist() == [True, False, False]


def test_runs_of_such_words():
    x, y = thue_morse(64)
    runs = [" ".join(t).encode() for t in (x, y)]
    words = Words(runs)
    for n in (2, 5, 18, 35, 64):
        at, h = words.grams(n)
        spelled = [tuple((x + y)[i : i + n]) for i in at]
        assert len(set(h.tolist())) == len(set(spelled))


def test_such_words_are_not_equal_in_the_joins(spark):
    pairs = [thue_morse(n) for n in (1024, 2048, 8192)]
    other = lambda k, i: f"{'xy'[i]}{k}"
    rows = []
    for k, (a, b) in enumerate(pairs):
        rows += [(10 * k + i, " ".join([*(f"w{k}.{j}" for j in range(17)), word, *(f"v{k}.{j}" for j in range(17))])) for i, word in enumerate((a, b))]
        rows += [(100 + 10 * k + i, " ".join([*(f"w{k}.{j}" for j in range(2)), word, *(other(j, i) for j in range(3))])) for i, word in enumerate((a, b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed == 0 for r in kept_digest(repeats(docs)).collect())
    assert all(r.component_id == r.doc_id and r.n_links == 0 for r in similar_groups(docs).collect())


def test_a_very_long_text_that_repeats_itself(spark):
    words = [f"é{i}" for i in range(60_000)] + [f"é{i}" for i in range(30_000, 30_040)]
    got = kept_digest(repeats(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))).first()
    kept = " ".join(words[:30_000] + words[30_040:60_000])
    assert (got.n_words, got.n_removed, got.kept_sha256) == (60_040, 80, hashlib.sha256(kept.encode()).hexdigest())


def test_many_near_copies_that_share_a_passage(spark):
    """Families whose members change some words, all around one passage: components and links as all pairs give them."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(45)]
    texts = []
    for f in range(8):
        own = [f"f{f}.{i}" for i in range(rng.choice([4, 10, 30]))]
        for m in range(250):
            w = own[: len(own) // 2] + passage + own[len(own) // 2 :]
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{f}.{m}.{rng.randrange(99)}"
            texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    number = {}
    for s in sets:
        for g in s:
            number.setdefault(g, len(number))
    x = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        x[i, [number[g] for g in s]] = 1
    both, size = (x @ x.T).astype(np.int64), np.array([len(s) for s in sets])
    link = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    label = np.arange(len(sets))
    while True:
        new = np.where(link, label[None, :], len(sets)).min(1)
        if (new == label).all():
            break
        label = new
    same = both == np.maximum(size[:, None], size[None, :])
    classes = {frozenset(s): i for i, s in reversed(list(enumerate(sets)))}
    firsts = np.array(sorted(classes.values()))
    n_links = (link & ~(same & (size[:, None] == size[None, :])))[:, firsts].sum(1)
    got = sorted(similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r.component_id for r in got] == label.tolist()
    assert [r.n_links for r in got] == n_links.tolist()
