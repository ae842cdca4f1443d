"""The pipeline's stages, each on a small input of its own, and the registered queries."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from cartograph.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_near_duplicates_by_shingles(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rnd.choices(vocabulary, k=200)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(40):  # near copies: one or two words of 200 changed; hard negatives: every tenth word
        w = texts[i].split()
        for at in rnd.sample(range(200), 1 + i % 2) if i < 25 else range(0, 200, 10):
            w[at] = rnd.choice(vocabulary)
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, texts[0]), (2001, None), (2002, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in simhash.similar(docs, 0.8, 5).collect()}
    for i in range(40):
        j = len(shingles(texts[i]) & shingles(dict(rows)[1000 + i])) / len(shingles(texts[i]) | shingles(dict(rows)[1000 + i]))
        assert (got[1000 + i] == got[i]) == (j >= 0.8), (i, j)
    assert got[2000] == got[0] and got[2001] == got[2002] and len({got[i] for i in range(80)}) == 80
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == {d for d, _ in rows if got[d] == d}


def test_blocks_reach_the_recall():
    assert simhash.recall(0.8) >= 0.92 and simhash.recall(0.85) >= 0.985 and simhash.recall(0.9) >= 0.999


@pytest.mark.parametrize("which", ["tricky", "nothing"])
def test_stages_on_edges(spark, which, request):
    docs = request.getfixturevalue(which).drop("length")
    n = docs.count()
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == COLUMNS, name
        assert out.count() >= 0 and (n or out.count() == 0), name


def test_pipeline_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    passed = cp.keep_quality(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.where("quality = 1").join(docs.where("size(split(text, ' ')) > 60"), "doc_id").count()
    kept = labels.where("quality = 1").join(passed, "doc_id").where("size(split(text, ' ')) > 60").count()
    assert labels.where("quality = 0").join(passed, "doc_id").count() == 0 and kept >= 0.85 * good
    clean = cp.redact_pii(spark, docs, sf)
    assert clean.count() == docs.count() and clean.where(F.rlike("text", F.lit(r"[a-z0-9]@[a-z]"))).count() == 0
    same = clean.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert same.where("text = t").count() + same.where(F.rlike("text", F.lit(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]"))).count() >= docs.count()
    packed = cp.run(spark, sf)
    by = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert by[0] <= 2048 and by[1] > 1900


def test_every_operator_is_registered(spark, sf):
    q = entry.queries()
    assert {n: sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 11)} == dict.fromkeys(range(1, 11), 1) and "pipeline" in q
    assert set(entry.oracle_sql()) <= set(q)
