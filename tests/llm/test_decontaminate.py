import random
import re

from assetlens.llm.decontaminate import contamination, decontaminate


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((k, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(9)] + ["É", "é", "x9"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([10, 12, 30, 30])))) for i in range(30)]
    items += [(30, "Short One"), (31, "q r s t u v w x y"), (32, ""), (33, None), (34, "...")]
    docs = []
    for i in range(120):
        w = rng.choices(vocab, k=rng.choice([0, 3, 9, 10, 11, 60]))
        if i % 2:
            x = words(items[rng.randrange(30)][1])
            a = rng.randrange(len(x))
            w += x[a : a + rng.randint(8, 14)] + rng.choices(vocab, k=4)
        docs.append((i, rng.choice([" ", "_", ", "]).join(w).title()))
    docs += [(200, None), (201, ""), (202, "a short, ONE short one"), (203, "q r s t u v w x y"), (204, "q r s t u v w x"), (204, "z")]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, n int, a string, row int")
    bench = spark.createDataFrame([(*d, 1) for d in items], "item_id long, text string, size int")
    got = sorted(map(tuple, contamination(frame, bench).collect()), key=str)
    assert got == brute(docs, items)
    left = {r.doc_id for r in decontaminate(frame, bench).collect()}
    assert left == {k for k, *_, bad in brute(docs, items) if not bad}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in contamination(docs, none).collect()] == [(1, 3, 0, [], False)]
    assert contamination(docs.where("false"), none).count() == 0


def test_clean_rows_of_null_and_repeated_keys_stay(spark):
    item = "a benchmark item of exactly ten words to look for"
    clean = [(None, "clean"), (None, None), (7, "clean too"), (8, "and this")]
    docs = spark.createDataFrame([*clean, (None, f"x {item}"), (7, f"{item} y")], "doc_id long, text string")
    left = decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted(clean, key=str)
