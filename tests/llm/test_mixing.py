import random

from assetlens.llm.mixing import mix, mixed_documents


def waterfill(sizes):
    """By repeated resharing: source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, rest, live = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while rest > 1e-9 and live:
        total = sum(weight[s] for s in live)
        over = [s for s in live if rest * weight[s] / total >= 3 * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / total for s in live}
        for s in over:
            target[s] = 3.0 * sizes[s]
            live.discard(s)
        rest = sum(sizes.values()) - sum(target[s] for s in order if s not in live)
    return target


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, part int")


def test_targets_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "b", "b", "c", "d", None]), "w " * rng.choice([0, 1, 5, 5, 5, 40, 300])) for i in range(600)]
    rows += [(1000, "tiny", "one"), (1001, "none", ""), (1002, "none", None)]
    got = mix(docs_of(spark, rows)).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = waterfill(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for s in sizes:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - want[s]) <= 1 + max(r.size for r in got if r.source == s)
    again = mix(docs_of(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_emitted_rows(spark):
    rows = [(i, "ab"[i % 2], "w " * (i % 7)) for i in range(60)]
    docs = docs_of(spark, rows)
    copies = {r.doc_id: r.copies for r in mix(docs).collect()}
    out = [r.doc_id for r in mixed_documents(docs).collect()]
    assert mixed_documents(docs).columns == docs.columns
    assert {k: out.count(k) for k in copies} == {k: n if k % 7 else 0 for k, n in copies.items()}


def test_empty_and_repeated(spark):
    assert mix(docs_of(spark, [])).count() == 0
    assert mix(docs_of(spark, [(1, None, None)])).collect()[0].taken == 0
    assert mix(docs_of(spark, [(1, "a", "x y"), (1, "a", "x y"), (None, "a", "x")])).count() == 3
