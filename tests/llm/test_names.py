"""Documents that have columns named like those the operators use themselves, and odd rows in every operator."""

import re
from pathlib import Path

import corpus_pipeline as cp
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import assetlens.llm
from assetlens.llm import decontaminate, exact_dedup, language, license_scan, mixing, ngram_join, quality, simple8b, substring_dedup, token_count

SF = "/root/testdata/sf0.001"
OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def inner_names():
    """Every name in an alias, a new column, a join or a schema of the operators' modules."""
    found = set()
    for path in Path(assetlens.llm.__file__).parent.glob("*.py"):
        for quoted in re.findall(r'"([^"\n]*)"', path.read_text()):
            found.update(re.findall(r"^[A-Za-z_]\w*$|\b([A-Za-z_]\w*) (?:long|int|string|double|binary|boolean|array)", quoted) if " " in quoted else [quoted])
    names = {n.lower() for n in found if re.fullmatch(r"[A-Za-z_]\w{0,30}", n)}
    return sorted((names | {"row", "row_", "copies", "language", "_lid", "_key", "_nth", "_mix_n", "_bad", "_row"}) - OWN)


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0")
    odd = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (0, "the same key again", "en", "src2", 18), (None, "no key here at all", "en", None, 18), (None, None, None, None, None)]
    return d.union(spark.createDataFrame(odd, d.schema)).cache()


@pytest.fixture(scope="module")
def named(docs):
    return docs.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in inner_names()])


def key(row):
    return str(row.asDict(recursive=True))


def test_the_names_are_those_of_the_operators():
    assert {"score", "rejected", "lang_pred", "component_id", "cls", "copies", "taken", "bucket", "chunk", "log_weight", "rank"} <= set(inner_names())


@pytest.mark.parametrize("number", range(4))
def test_stages_return_the_columns_of_their_documents(spark, docs, named, number):
    name, stage = cp.STAGES[number]
    plain, after = stage(spark, docs, SF), stage(spark, named, SF)
    assert after.columns == named.columns
    rows = after.collect()
    assert sorted(map(key, plain.collect())) == sorted(key(r) for r in after.select(docs.columns).collect())
    for r in rows:
        assert all(r[n] == f"{n}-{'none' if r.doc_id is None else r.doc_id}" for n in inner_names())


OPERATORS = {
    "licenses": lambda d: license_scan.scan_licenses(d),
    "tokens": lambda d: token_count.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens"),
    "resample": lambda d: quality.resample(d, d.where("doc_id % 8 = 0")),
    "ngrams": lambda d: ngram_join.similar_groups(d),
    "exact": lambda d: exact_dedup.exact_groups(d, digest_all=True),
    "mix": lambda d: mixing.mix(d),
    "ids": lambda d: simple8b.encode_documents(d, public_tokenizers.path("word_bpe_49k.json"), 2),
    "contamination": lambda d: decontaminate.contamination(d, d.sparkSession.read.parquet(f"{SF}/benchmark.parquet")),
    "repeats": lambda d: substring_dedup.kept_digest(substring_dedup.repeats(d)),
    "language": lambda d: language.identify(d, language.fit(d)).select("doc_id", "lang_pred", "score", "rejected"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_other_columns(docs, named, name):
    run = OPERATORS[name]
    got = sorted(map(key, run(named).collect()))
    assert got == sorted(map(key, run(docs).collect()))
    assert len(got) == docs.count()
    assert run(named.where("false")).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_stages_of_empty_tables(spark, docs, number):
    out = cp.STAGES[number][1](spark, docs.where("false"), SF)
    assert out.count() == 0 and (number == 4 or out.columns == docs.columns)
