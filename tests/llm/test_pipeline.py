import random
import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from sparkloom.llm import queries
from tests.llm.helpers import words

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(7), tmp_path_factory.mktemp("tables")
    texts, labels = {}, []
    for i in range(600):
        text = words(rng, 60).split()
        if i % 8 == 0:
            text[3] = text[9] = "scum"
        texts[i] = " ".join(text)
        labels.append((i, 1, int(i % 8 == 0)))
    item = words(rng, 30)
    passage = "this very line stands on many of the documents of the set"
    for i in range(601, 641, 2):
        texts[i] = words(rng, 50) + "\n" + passage + "\n" + words(rng, 20)
    near = words(rng, 70).split()
    for i in (650, 651, 652):
        texts[i] = " ".join(near)
    texts[653] = " ".join([*near[:50], "other", *near[51:]])
    texts[660] = words(rng, 30) + " " + item + " " + words(rng, 30)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(700, None, None, None, None), (701, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), texts


def test_each_stage_does_its_work(spark, folder):
    path, texts = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(f"{path}/{k}.parquet")
        docs = spark.read.parquet(f"{path}/{k}.parquet")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic = {i for i in range(0, 600, 8)}
    held = {i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0}
    assert held and not kept["toxicity"] & toxic and kept["toxicity"] >= set(texts) - toxic | {700, 701}
    assert kept["line dedup"] == kept["toxicity"]
    lines = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/1.parquet").collect()}
    assert sum("this very line" in (r["text"] or "") for r in lines.values()) == 1 and "this very line" in lines[639]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values() if r["text"])
    assert kept["line dedup"] - kept["near duplicates"] == {651, 652, 653}
    assert kept["near duplicates"] - kept["decontamination"] == {660}
    assert kept["packing"] == kept["decontamination"]


def test_run_equals_the_stages(spark, folder):
    path, _ = folder
    got = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in spark.read.parquet(f"{path}/4.parquet").collect()}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op4_line_dedup", "op5_top_k", "op6_chat_format"])
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    frame = queries.queries()[name](spark, "/root/testdata/sf0.001")
    asked = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in asked.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(columns).collect())) == sorted(asked.fetchall())
