import random
import zlib

from assetlens.llm.language import LanguageModel, fit, identify, train

VOCAB = {"aa": "the of and river stone walk light house".split(), "bb": "der und fluss stein licht haus straße gehen".split(), "cc": "река камень свет дом идти и на".split()}


def corpus(n=500):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOCAB))
        rows.append((i, " ".join(rng.choices(VOCAB[lang], k=rng.randint(1, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(docs, fit(docs)).collect()}
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 50
    assert sum(got[k].lang_pred == lang for k, lang in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) <= 0.02 * len(rows)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows = [(k, t, lang if zlib.crc32(str(k).encode()) % 5 else "zz") for k, t, lang in corpus(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit(docs).labels == ["aa", "bb", "cc"]


def test_odd_texts(spark):
    m = train([t for _, t, _ in corpus(100)], [x for *_, x in corpus(100)])
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "²₃ _"), (5, "the " * 30000), (6, "x" * 100000), (7, "the")]
    docs = spark.createDataFrame([(k, t, "s", 0.5) for k, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in identify(docs, m).collect()}
    assert all(got[k].lang_pred == "und" and got[k].rejected and got[k].score == 0 for k in (1, 2, 3, 4))
    assert got[5].lang_pred == got[7].lang_pred == "aa" and got[6].lang_pred in ("aa", "bb", "cc")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = fit(docs)
    assert isinstance(m, LanguageModel) and m.labels == [] and identify(docs, m).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify(unlabelled, fit(unlabelled)).collect()[0].lang_pred == "und"


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(220):  # each language has words of its own; the later ones are the rarer ones
        a, b = letters[i % 26], letters[i // 26]
        rows += [(1000 * i + j, f"{a}{b}{a} {b}{b}{a}{a} {a}{b}{b}{a}{b}", f"l{i:03}") for j in range(12 if i < 200 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit(docs).labels == sorted({r[2] for r in rows})


def test_ngrams_are_those_of_each_word_alone():
    import numpy as np

    from assetlens.llm.language import GRAMS, grams

    words = ["a", "straße", "река", "x" * 95, "ab", "a"]
    bucket, of = grams(words)
    for i, w in enumerate(words):
        alone = grams([w])[0].tolist()
        parts = [f"<{w[k : k + 40]}>" for k in range(0, len(w), 40)]
        assert sorted(bucket[of == i].tolist()) == sorted(alone) and len(alone) == sum(max(0, len(p) - n + 1) for p in parts for n in GRAMS)
    assert np.all(np.diff(of) >= 0)
    # The same n-gram has the same bucket wherever it stands: "ab" and "xab" share all but those with the first bound.
    one, other = (set(grams([w])[0].tolist()) for w in ("bcdefghij", "abcdefghij"))
    assert len(one - other) <= 4


def test_predictions_against_the_mean_of_all_ngrams(monkeypatch):
    import numpy as np

    from assetlens.llm import language

    m = train([t for _, t, _ in corpus(100)], [x for *_, x in corpus(100)])
    texts = ["the river STRASSE", "x" * 95 + " дом", "a", None, "12 3", "light, light; der", "the a der " * 50]
    for cache in (500_000, 3):
        monkeypatch.setattr(language, "CACHE", cache)
        p = m.predictor()
        for got, text in [*zip(p.many(texts), texts, strict=True), *((p(t), t) for t in texts)]:
            words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
            if not words:
                assert got == ("und", 0.0)
                continue
            rows = np.concatenate([m.table[language.grams([w])[0]] for w in words])
            z = (rows.mean(0) + m.bias) / m.temperature
            e = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert got[0] == m.labels[int(e.argmax())] and abs(got[1] - e.max()) < 1e-9


def test_repeated_rows_and_null_keys_are_judged_alike(spark):
    docs = spark.createDataFrame([(1, "the river", "aa"), (1, "the river", "aa"), (None, "the river", None), (2, "der fluss", "bb"), (4, "река камень", "cc")], "doc_id long, text string, lang string")
    m = train([t for _, t, _ in corpus(100)], [x for *_, x in corpus(100)])
    got = [(r.lang_pred, r.score) for r in identify(docs, m).collect() if r.text == "the river"]
    assert len(got) == 3 and len(set(got)) == 1
