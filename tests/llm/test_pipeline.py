"""The stages of the pipeline on the hard rows, each against what its operator decides."""

import random

import corpus_pipeline as CP
import pytest
from pyspark.sql import functions as F

from voxelforge.llm import order_minhash as OM
from voxelforge.llm.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sf_dir(spark, hard, hard_rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    hard.select(*CP.COLUMNS).write.parquet(f"{path}/documents.parquet")
    item = " ".join((hard_rows[9][1] or "").split()[:25])
    spark.createDataFrame([(0, item), (1, "not in any of the documents of this table")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir, hard_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    seen = [ids(docs)]
    for name, stage in CP.STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/out-{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "mixing":
            assert docs.columns == CP.COLUMNS
        seen.append(ids(docs))
    language, lines, near, clean, mixed = seen[1:]
    assert {3000, 3001, 3002, 3003} <= seen[0] - language <= {3000, 3001, 3002, 3003, 3005, 3006, 3007, 3008, None} and {0, 3, 1000} <= language
    assert lines == language
    # lines that copies share with the original are gone by then: what is left of them is alike among themselves
    assert 30 in near and len(set(range(2000, 2005)) & near) <= 1 and len(set(range(1000, 1006)) & near) <= 2
    assert near - clean == {27}
    assert mixed <= clean
    assert docs.where("taken > 2 * size or copies < 1 or copies > 2").isEmpty()


def test_foreign_texts_go_and_mixed_ones_stay(spark, hard, hard_rows):
    known = [r for r in hard_rows if r[1] and len(r[1]) > 200 and r[0] is not None and r[0] < 3000]
    mixed = [(9000 + i, a[1][:150] + " " + b[1][:150], "en", "s") for i, (a, b) in enumerate(zip(known[::7], known[1::7], strict=False))]
    foreign = [
        "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset.",
        "Türkçe, çoğunlukla Türkiye ve Kıbrıs'ta konuşulan, Türk dilleri ailesine ait sondan eklemeli bir dil.",
        "Język polski należy do grupy języków zachodniosłowiańskich wraz z czeskim i słowackim, kaszubskim.",
        "Русский язык является одним из восточнославянских языков, национальный язык русского народа.",
    ]
    rows = [(*r[:4], None) for r in known + mixed] + [(9500 + i, t, None, "s", None) for i, t in enumerate(foreign)]
    rows = [(*r[:4], None) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in CP.language_stage(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {9500 + i for i in range(len(foreign))}


def test_run_and_empty_input(spark, sf_dir, hard, tmp_path):
    assert CP.run(spark, sf_dir).count() > 0
    path = f"file://{tmp_path}"
    hard.select(*CP.COLUMNS).limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert CP.run(spark, path).count() == 0


def test_one_of_each_class_stays(spark, hard, sf_dir):
    out = CP.near_dedup_stage(spark, hard.select(*CP.COLUMNS), sf_dir)
    classes = OM.near_duplicates(hard)
    assert out.select("doc_id").distinct().count() == classes.select("class_id").distinct().count()
    assert out.where(F.col("doc_id") == 30).count() == 1


def test_near_dedup_drops_no_partner_in_a_crowded_bucket(spark):
    rng, texts, passage = random.Random(5), [], [f"p{i}" for i in range(70)]
    for g in range(300):  # 70 of 100 words are common to all: every text is in the same buckets, and similar to its own copy only
        own = [f"o{g}z{i}" for i in range(30)]
        texts.append((g, " ".join(passage + own)))
        if g % 30 == 0:
            for i in rng.sample(range(30), 19):
                own[i] = f"x{g}z{i}"
            texts.append((g, " ".join(passage + own)))
    rng.shuffle(texts)
    least = {}
    for i, (g, _) in enumerate(texts):
        least.setdefault(g, i)
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, (_, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in CP.near_dedup_stage(spark, docs, "").collect()} == set(least.values())


def test_queries_are_registered():
    assert len(QUERIES) == 10 and {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
