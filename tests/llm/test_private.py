import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assetlens.llm import private as pv
from assetlens.llm.queries import OP12_SQL

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PLAIN)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(out)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, reach=60, least=3):
    """doc_id, base, spans by the docstrings."""
    spans, near, words = [base(t) for _, t in rows], defaultdict(set), defaultdict(set)
    places, entity_rows = [], defaultdict(set)
    for r, (_, t) in enumerate(rows):
        t = t or ""
        for w in re.findall(WORD, lower(t)):
            words[w].add(r)
        for start, kind, end in spans[r]:
            matches = [m.span() for m in re.finditer(PLAIN[KINDS[kind]], t)]
            lo, hi = max([e for _, e in matches if e <= start], default=0), min([s for s, _ in matches if s >= end], default=len(t))
            value = lower(t[start:end]) if kind < 2 else re.sub("[^0-9]", "", t[start:end])
            e = f"{KINDS[kind]}:{value}"
            left, right = t[lo:start][-(reach + 1) :], t[end:hi][: reach + 1]
            some = [(start - len(left) + m.start(), start - len(left) + m.end(), m[0]) for m in re.finditer(WORD, left) if m.start() or len(left) <= reach]
            some += [(end + m.start(), end + m.end(), m[0]) for m in re.finditer(WORD, right) if m.end() <= reach or len(right) <= reach]
            for a, b, w in some:
                near[e, lower(w)].add(r)
                entity_rows[e].add(r)
                places.append((r, e, lower(w), a, b))
    shown = {(e, w) for (e, w), rs in near.items() if len(rs) >= least and len(rs) ** 4 * len(rows) >= len(words[w]) ** 4 * len(entity_rows[e])}
    out = []
    for r, (key, _) in enumerate(rows):
        terms = {(a, 4, b) for q, e, w, a, b in places if q == r and (e, w) in shown and not any(s < b and a < x for s, _, x in spans[r])}
        out.append((key, spans[r], sorted({*spans[r], *terms})))
    return out


def write(spans):
    return ",".join(f"{[*KINDS, 'term'][k]}:{s}:{e}" for s, k, e in spans)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, term string, row int")


def got(spark, rows):
    found = pv.personal_spans(frame(spark, rows)).withColumns({"b": pv.written_spans(F.col("base")), "s": pv.written_spans(F.col("spans"))}).collect()
    return sorted((str(r.doc_id), r.b, r.s, (r.n_email, r.n_ip, r.n_card, r.n_phone)) for r in found)


def want(rows):
    return sorted((str(k), write(b), write(s), tuple(sum(x[1] == i for x in b) for i in range(4))) for k, b, s in brute(rows))


def corpus(seed):
    rng = random.Random(seed)
    bits = ["a@b.c", "x_y%z@d-e.f.g", "@", ".", "..", "+", "1", "22", "255", "256", "0255", "4111 1111-1111 1111", "4111111111111112", "+1 (456) 555-2186", "+49", "é", "𝄞", "-", " ", "  ", "_", "%", "10.0.0.1", "a.b@c", "(", ")", "\n", "Word"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(250)]
    names = ["ada", "Ben", "Cy9", "été", "common"]
    for i in range(60):
        who = rng.randrange(4)
        rows.append((1000 + i, " ".join(rng.choices(["common", "words", "everywhere", "more"], k=rng.randint(0, 30))) + f" {names[who]}, p{who}@mail.com " + rng.choice(["common", "x" * 59, "4111111111111111", names[(who + 1) % 4]])))
    return [*rows, (None, None), (None, "p1@mail.com Ben"), (7, ""), (1000, rows[250][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == want(rows)
    assert sum("term" in s for _, _, s, _ in want(rows)) > 10


def test_the_sql_agrees(spark):
    import duckdb
    import pandas as pd

    rows = corpus(3)
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    found = sorted((str(r[0]), r[6], tuple(r[1:5]), r[5]) for r in con.sql(OP12_SQL).fetchall())
    assert found == [(k, s, n, hashlib.sha256(b.encode()).hexdigest()) for k, b, s, n in want(rows)]


def test_long_texts_take_linear_time(spark):
    """Long runs of the characters that patterns begin with, and repeated groups, neither recurse nor search again."""
    rows = [(1, "a" * 300_000), (2, "1" * 300_000), (3, "a@b" + ".c" * 100_000), (4, "1 23 " * 60_000), (5, "+1" + "(" * 200_000), (6, "1." * 100_000), (7, "x 10.0.0.1 " * 2_000)]
    found = {r.doc_id: r for r in pv.personal_spans(frame(spark, rows)).collect()}
    assert {k: (r.n_email, r.n_ip, r.n_card, r.n_phone) for k, r in found.items()} == {1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0), 6: (0, 25_000, 0, 0), 7: (0, 2_000, 0, 0)}


def test_terms_are_generalised_or_removed(spark):
    rows = [(i, f"call Zebulon about +1 456 555 2186 and write z@q.com, code {i}") for i in range(4)]
    rows += [(10 + i, f"Zebra {i} call about and write code Zed") for i in range(40)]
    rows += [(60 + i, "nothing here") for i in range(200)]
    out = {r.doc_id: r.text for r in pv.sanitised(frame(spark, rows)).collect()}
    assert out[0] == "call ze* about <phone> and write <email>, code 0"  # zebu* discloses, ze* doesn't
    assert out[10] == rows[4][1] and out[60] == "nothing here"
    assert pv.sanitised(frame(spark, rows)).columns == frame(spark, rows).columns


def test_overlapping_spans_are_replaced_once(spark):
    out = pv.sanitised(frame(spark, [(1, "at +41 111 111 10.0.0.12 now"), (2, None), (2, "é 10.0.0.1é"), (3, "a@10.0.0.1")])).collect()
    assert sorted(str(r.text) for r in out) == ["<email>", "None", "at <phone> now", "é <ip>é"]


def test_empty_table(spark):
    empty = frame(spark, [(1, "a@b.c")]).where("false")
    assert pv.personal_spans(empty).count() == 0 and pv.sanitised(empty).count() == 0
