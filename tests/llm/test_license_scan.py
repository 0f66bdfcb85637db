import random

from assetlens.llm.license_scan import LEAST_COVERAGE, TEMPLATES, Index, align, scan_licenses, tokens


def brute_alignment(a, b):
    """Longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def plain(text, templates=TEMPLATES):
    """Templates of which the longest common subsequence with any stretch of the text is long enough: no index, no band."""
    words = [w for w, *_ in tokens(text)]
    found = set()
    for name, t in templates.items():
        tw = [w for w, *_ in tokens(t)]
        reach = len(tw) + len(tw) // 3 + 2
        for i in range(0, max(1, len(words)), max(1, len(tw) // 4)):
            if brute_alignment(tw, words[i : i + reach]) >= LEAST_COVERAGE * len(tw):
                found.add(name)
                break
    return found


def edited(words, rng, edits):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [f"x{rng.randrange(99)}"], [w[i], f"y{rng.randrange(99)}"]])
    return w


def test_every_template_is_found_with_its_span(spark):
    rows = [(i, f"Some words before.\n{t}\nAnd after, of course.", "x") for i, t in enumerate(TEMPLATES.values())]
    rows += [(100, None, "x"), (101, "", "x"), (102, "the license of the version", "x"), (103, "word " * 50000, "x")]
    rows += [(0, rows[0][1], "x"), (None, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    got = scan_licenses(docs).collect()
    of = {r.doc_id: r.matches for r in got}
    for i, (name, t) in enumerate(TEMPLATES.items()):
        m = next(m for m in of[i] if m.template == name)
        assert m.coverage == 1.0 and t.startswith(rows[i][1][m.start : m.end]) and m.end - m.start >= len(t) - 3
    assert not any(of[k] for k in (100, 101, 102, 103))
    assert [len(r.matches) for r in got if r.doc_id == 0] == [1, 1] and of[None] == of[1]


def test_recall_of_edited_copies_against_plain_alignment():
    """Of edited copies in which plain alignment finds the template, nine in ten are found at least, of every template."""
    rng, index = random.Random(7), Index(TEMPLATES)
    filler = "the of a and to river house by this in software work license without any".split()
    for name, t in TEMPLATES.items():
        words = [w for w, *_ in tokens(t)]
        seen = hit = 0
        for _ in range(40 if len(words) < 60 else 8):
            some = edited(words, rng, rng.randint(1, max(1, len(words) // 5)))
            text = " ".join([*rng.choices(filler, k=15), *some, *rng.choices(filler, k=15)])
            if name in plain(text, {name: t}):
                seen += 1
                only = Index({name: t}).scan(text)
                hit += bool(only)
                assert not only or index.scan(text)
        assert seen and hit >= 0.9 * seen, (name, hit, seen)


def test_scan_against_plain_alignment_on_clean_texts():
    rng, index = random.Random(3), Index(TEMPLATES)
    vocab = sorted({w for t in TEMPLATES.values() for w, *_ in tokens(t)})
    for _ in range(20):
        text = " ".join(rng.choices(vocab, k=120))
        assert {m[0] for m in index.scan(text)} <= plain(text)


def test_short_templates_and_parts_of_long_ones():
    for name, t in (("one", "Unlicensed"), ("two", "MIT License"), ("three", "Some rights reserved")):
        assert [m[:2] for m in Index({name: t}).scan(f"before, {t.upper()}! after")] == [(name, 1.0)]
    assert Index({"two": "MIT License"}).scan("the MIT and the License") == []
    assert Index({"none": " -- ", "two": "MIT License"}).scan("a MIT license")[0][0] == "two"
    words = TEMPLATES["MIT-text"].split()
    part = Index(TEMPLATES).scan("x y z " + " ".join(words[60:110]) + " and so on")
    assert [m[0] for m in part] == ["MIT-text"] and 40 / len(words) < part[0][1] < 60 / len(words)


def test_templates_that_tie_all_stay():
    both = Index({"a": "all rights are reserved here", "b": "all rights are reserved here"}).scan("All rights are reserved here.")
    assert [m[0] for m in both] == ["a", "b"]


def test_the_better_of_overlapping_templates_stays():
    index = Index(TEMPLATES)
    for name in ("CC-BY-NC-4.0", "CC-BY-4.0", "CC-BY-SA-4.0"):
        assert [m[:2] for m in index.scan(f"Before. {TEMPLATES[name]} After.")] == [(name, 1.0)]
    both = index.scan("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0. Released under the MIT License.")
    assert [m[0] for m in both] == ["CC-BY-NC-4.0", "CC-BY-4.0", "MIT"]


def test_alignment_is_the_longest_common_subsequence_within_the_band():
    a = "a b c d e f g h".split()
    for b in ("a b c d e f g h", "a x b c d e f g h", "a c d e f g h", "x x", "a b c x y e f h"):
        w = b.split()
        assert align(a, w, 0)[0] == brute_alignment(a, w)
    assert align(a, "a q q q q q q h".split(), 0)[0] == 1  # words far apart don't add up


def test_no_templates_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert scan_licenses(docs, {}).collect()[0].matches == []
    assert scan_licenses(docs.where("false")).count() == 0
