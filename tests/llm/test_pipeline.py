"""The pipeline over a small corpus against a plain version of each stage."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, common, decontam

from .test_pairs import FOLD, plain_classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    stems = {"en": ["the", "tion", "ing", "and", "wh"], "fr": ["eau", "que", "é", "les", "oi"]}
    word = lambda lang: "".join(r.choice(stems[lang]) for _ in range(r.randint(1, 4)))
    items = [" ".join(word("en") for _ in range(25)) for _ in range(4)]
    docs, texts = [], []
    for i in range(140):
        lang = r.choice(["en", "fr"])
        kind = r.random()
        if kind < 0.15 and texts:
            t = r.choice(texts)
            t = t.upper() if "é" not in t else t
        elif kind < 0.3 and texts:
            w = r.choice(texts).split()
            w[r.randrange(len(w))] = "other"
            t = " ".join(w)
        else:
            t = " ".join(word(lang) for _ in range(r.randint(20, 90)))
        if r.random() < 0.1:
            t += " " + r.choice(items)
        texts.append(t)
        docs.append((i, t, lang, f"src{i % 3}", len(t)))
    docs += [(200, None, "en", "src0", 0), (201, "123 456 !!", "en", "src0", 10), (202, "", None, None, 0), docs[5]]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_stages(spark, folder, tmp_path):
    path, docs, items = folder
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "byte-level BPE" and len(corpus_pipeline.STAGES) == 5
    df, kept = spark.read.parquet(f"{path}/documents.parquet"), [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = df.columns
        stage(spark, df, path).write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert df.columns == columns
            kept.append([tuple(r) for r in df.collect()])
    ids = [sorted(r[0] for r in rows) for rows in kept]
    # Only texts without a letter go; each clean one stays as it came.
    assert ids[1] == sorted(r[0] for r in docs if r[0] not in (200, 201, 202)) and set(kept[1]) <= set(docs)
    groups = {}
    for r in kept[1]:
        groups.setdefault(r[1].translate(FOLD), []).append(r[0])
    assert ids[2] == sorted(max(g) for g in groups.values())
    classes = plain_classes([r[:2] for r in kept[2]], 5, 80)
    assert ids[3] == sorted(i for i, (_, c) in classes.items() if i == c) and len(ids[3]) < len(ids[2])
    leaks = {r[0] for r in kept[3] for x in items if decontam.myers(decontam.normalise(x), decontam.normalise(r[1]))[0] <= decontam.budget(decontam.normalise(x))}
    assert leaks and ids[4] == sorted(set(ids[3]) - leaks)
    text = {r[0]: r[1] for r in kept[4]}
    for r in df.collect():
        assert r.ids_sha256 == hashlib.sha256(bpe.encode_text(text[r.doc_id]).tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, path).collect()) == ids[4]


def test_stages_of_an_empty_table(spark, folder):
    path, _, _ = folder
    df = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, path).count() == 0


def test_rows_go_by_id_and_null_ids_match(spark):
    docs = spark.createDataFrame([(i, "t", 1, "x", i) for i in range(200)] + [(None, "n", 1, "x", 0)], "doc_id long, text string, _maybe int, _doc string, _id long")
    gone = spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")
    assert corpus_pipeline.without(docs, gone).where(F.col("doc_id").isNull() | (F.col("doc_id") == 3)).count() == 0
    assert corpus_pipeline.without(docs, gone).count() == 199
    assert corpus_pipeline.without(docs, gone).columns == docs.columns


def test_stages_keep_columns_whatever_their_names(spark, folder):
    path, docs, _ = folder
    rows = [(*r, 1, "x", i) for i, r in enumerate(docs[:12])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _sha int, _gone string, _text long")
    for _, stage in corpus_pipeline.STAGES[1:4:2]:
        assert stage(spark, df, path).columns == df.columns and {tuple(r) for r in stage(spark, df, path).collect()} <= set(rows)


def test_returned_tables_go_to_workers_in_small_batches(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    before = spark.conf.get(common._BATCH)
    try:
        for step in (corpus_pipeline.identify_language, corpus_pipeline.encode):
            spark.conf.set(common._BATCH, "10000")
            step(spark, docs, folder[0])
            assert int(spark.conf.get(common._BATCH)) == common.ROWS
            spark.conf.set(common._BATCH, "7")
            step(spark, docs, folder[0])
            assert int(spark.conf.get(common._BATCH)) == 7
    finally:
        spark.conf.set(common._BATCH, before)
