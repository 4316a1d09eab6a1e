import random

import corpus_pipeline

from residua.llm import queries
from residua.llm.scratch import settle


def write(spark, folder):
    rng = random.Random(8)
    clean = "tree house walk river cloud stone bread lamp chair table window garden".split()
    item = " ".join(f"q{i}" for i in range(14))
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(clean) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            w[3] = w[9] = "scumbag"
        if i % 50 == 7:
            w[5:5] = item.split()
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    for i in range(20):  # near copies of clean documents
        rows.append((1000 + i, rows[i][1] + " tail", "en", "s0", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, {i for i, _, t in labels if t}


def test_stages_take_effect(spark, tmp_path):
    rows, toxic = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, str(tmp_path)), name)
        if name != "sharding":
            assert out.columns == docs.columns and out.schema == docs.schema
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
        if name == "mixing":
            assert out.count() > len(kept[-1])  # some documents twice
        docs = out
    ids = {r[0] for r in rows}
    near_toxic = {1000 + i for i in range(20) if i in toxic}
    assert kept[0] == ids - toxic - near_toxic
    assert kept[1] == {i for i in kept[0] if i < 1000}
    assert kept[2] == {i for i in kept[1] if i % 50 != 7}
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert docs.filter("shard is null or shard not between 0 and 23").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == kept[4]


def test_queries_have_the_columns_asked_for(spark, tmp_path):
    write(spark, tmp_path)
    want = {
        "op1_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op2_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op3_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op6_jaccard_join": ["doc_id", "n_shingles", "component_id"],
        "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op8_line_dedup": ["doc_id", "n_lines", "n_deleted"],
        "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, str(tmp_path))
        assert set(columns) <= set(df.columns), name
        assert df.count() == 420, name
