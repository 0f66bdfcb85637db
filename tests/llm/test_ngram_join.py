import random
import re

import pytest

from assetlens.llm.components import components
from assetlens.llm.ngram_join import bands, one_of_each_group, roles, similar_groups


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[root(i)] = min(k, least.get(root(i), k))
    return sorted((k, len(s), least[root(i)]) for i, (k, s) in enumerate(sets))


def corpus(seed, families, hot):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    common = rng.choices(vocab, k=40)
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d e f", "A b C d e f g", "a b c d e f g h", "x " * 3000]
    for _ in range(families):
        base = rng.choices(vocab, k=rng.choice([4, 8, 9, 10, 14, 30, 60, 100, 200]))
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + common + base[len(base) // 2 :]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w[: rng.choice([None, -1, -2])]))
    base = rng.choices(vocab, k=90)
    for i in range(hot):
        w = list(base)
        w[rng.randrange(90)] = f"h{i}"
        texts.append(" ".join(w))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, texts[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 60)])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed, 90, hot)
    docs = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], "doc_id long, text string, cls int, size int, component string")
    got = similar_groups(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


@pytest.mark.parametrize("block", [512, 16])
def test_every_link_is_counted(spark, monkeypatch, block):
    from assetlens.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(6)
    base = rng.choices([f"w{i}" for i in range(300)], k=200)
    family = [" ".join([*base[:p], f"v{p}", *base[p + 1 :]]) for p in range(0, 200, 4)]
    rows = corpus(2, 30, 60)
    rows += [(len(rows) + i, t) for i, t in enumerate([*family, family[0]])]
    sets = {k: frozenset(shingles(t)) for k, t in rows}
    want = {k: sum(bool(s) and s != o and 100 * len(s & o) >= 80 * len(s | o) for o in set(sets.values())) for k, s in sets.items()}
    got = {r.doc_id: r.n_links for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and max(want.values()) >= 49


def test_one_document_of_each_group_stays(spark):
    rows = corpus(3, 40, 15)
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string")
    out = sorted(r.doc_id for r in one_of_each_group(docs).collect())
    assert out == sorted({c for _, _, c in brute(rows)})


def test_clean_rows_of_null_keys_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    stay = [(1, text), (None, "alone without a key"), (None, "and one more without")]
    docs = spark.createDataFrame([(None, text + " x"), (2, text + " y"), *stay, (3, text)], "doc_id long, text string")
    assert sorted(map(tuple, one_of_each_group(docs).collect()), key=str) == sorted(stay, key=str)


def test_empty_table(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_linkable_pair_shares_a_role():
    for a in [*range(1, 60), 100, 333, 1000]:
        for b in range(a, a * 100 // 80 + 1):
            own = next(k for k, (low, high, *_) in enumerate(bands(80, 4096)) if low <= a <= high)
            mine, theirs = ({k: (d, n) for k, d, n in roles(x, 80)}[own] for x in (a, b))
            assert min(mine[0], theirs[0]) >= (a + b) * 20 // 180 and mine[1] == theirs[1] > 0
            assert a > 3 or a == b


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + i) for i in range(60, 90)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {v for k, v in got.items() if k >= 100} == {100}


def test_folded_sketches_bound_the_difference(spark):
    import numpy as np

    from assetlens.llm.ngram_join import _near, parity_sketch

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    sets = {1: pool[:1000], 2: pool[:1100], 3: pool[900:1900], 4: pool[:40], 5: pool[:45]}
    classes = spark.createDataFrame([(k, len(h), parity_sketch(h).tolist()) for k, h in sets.items()], "cls long, size long, sketch array<long>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "u long, v long")
    assert {(r.u, r.v) for r in _near(pairs, classes, 80).collect()} == {(1, 2), (4, 5)}


def test_rows_of_one_key_are_judged_by_their_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(7, text), (7, "quite another text"), (3, text + " x"), (7, "quite another text")], "doc_id long, text string")
    assert sorted(map(tuple, one_of_each_group(docs).collect())) == [(3, text + " x"), (7, "quite another text")]
