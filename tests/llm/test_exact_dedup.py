import hashlib
import re

from assetlens.llm.exact_dedup import exact_groups

ROWS = [(1, "a b c"), (2, "abc"), (3, "a  b  c"), (4, None), (5, ""), (6, " \n"), (7, "other"), (8, "x" * 90 + "y"), (9, "x" * 90 + "z"), (10, "É é"), (11, "éÉ"), (12, "a b c"), (12, "a b c"), (13, "w " * 40000)]


def brute(rows):
    norm = {}
    for i, (k, t) in enumerate(rows):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), k))
    out = []
    for k, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(norm[n])[1]
        out.append((k, keep, len(norm[n]), keep == k, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, "s") for r in ROWS], "doc_id long, text string, n int, bits string")
    assert sorted(map(tuple, exact_groups(docs, digest_all=True).collect())) == brute(ROWS)


def test_only_survivors_are_hashed(spark):
    docs = spark.createDataFrame(ROWS[:10], "doc_id long, text string")
    hashed = {r.doc_id for r in exact_groups(docs).collect() if r.text_sha256}
    assert {1, 2, 3, 4, 5, 6} <= hashed and 7 not in hashed


def test_empty_table_and_null_key(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = exact_groups(spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows} == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)}
