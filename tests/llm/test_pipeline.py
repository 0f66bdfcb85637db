import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest

from assetlens.llm.common import store
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mixing import waterfill
from tests.llm.test_ngram_join import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and returned."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, "en", None, None), (9002, "", None, "src1", 0), (9003, "12 34", "en", "src1", 5), (0, "the same key again", "en", "src2", 18), (None, "no key here at all", "en", "src2", 18)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    out = []
    for name, stage in cp.STAGES:
        after = store(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language_drops_only_what_it_rejects(stages):
    before, after = map(rows, stages[0])
    gone = {k for k, _ in before} - {k for k, _ in after}
    assert {9001, 9002, 9003} <= gone and len(gone) <= 3 + 0.02 * len(before)


def test_one_of_each_group(stages):
    """One row of every group of linked rows, of the smallest key; rows of null or repeated keys are rows like any other."""
    before, after = map(rows, stages[1])
    members = {}
    for i, _, first in groups([(i, t) for i, (_, t) in enumerate(before)]):
        members.setdefault(first, []).append(before[i])
    assert len(after) == len(members)
    left = list(after)
    for some in members.values():
        least = min(some, key=lambda r: (r[0] is None, r[0] or 0))[0]
        kept = [r for r in some if r in left and r[0] == least]
        assert kept, some
        left.remove(kept[0])
    assert left == []


def test_contaminated_documents_go(spark, stages):
    before, after = map(rows, stages[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {k for k, *_, hit in leaks(before, items) if hit}
    assert bad and sorted(map(str, (k for k, _ in after))) == sorted(str(k) for k, _ in before if k not in bad)


def test_mix_comes_near_its_targets(stages):
    size = lambda t: len((t or "").split())
    before, after = (x.collect() for x in stages[3])
    sizes, taken, most = {}, {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        most[r.source] = max(most.get(r.source, 0), size(r.text))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, want in waterfill(sizes).items():
        assert abs(taken.get(s, 0) - want) <= most[s] + 1


def test_token_ids(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = stages[4]
    start = 0
    got = sorted(map(tuple, after.collect()), key=lambda r: r[1])
    for (k, text), (doc_id, at, n, crc) in zip(sorted(rows(before), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), got, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (doc_id, at, n, crc) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_stages_leave_only_their_own_tables(spark):
    """A stage deletes what earlier ones left, unless its documents are read from it."""
    from pathlib import Path

    from assetlens.functions.scratch import own_dir

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = own_dir(spark)
    held = lambda: {p.name for p in Path(path.removeprefix("file://")).iterdir()}
    near = cp.drop_near_duplicates(spark, docs, SF)
    before = held()
    lazy = cp.drop_contaminated(spark, near, SF)  # near is not written: what it reads stays
    assert before <= held() and lazy.count() > 0
    cp.mix_sources(spark, docs, SF).count()
    assert any(n.startswith("rows-") for n in before) and not any(n.startswith("rows-") for n in before & held())
