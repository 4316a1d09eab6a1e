"""Rows without an id go through every operator."""

import public_tokenizers
from helpers import AWKWARD, NO_ID, frame
from pyspark.sql import functions as F

from residua.llm import decontamination, exact_dedup, language_id, line_dedup, mixing, pii, sharding, token_counts, toxicity


def test_null_ids(spark):
    rows = AWKWARD + NO_ID
    docs, n = frame(spark, rows), len(rows)
    assert exact_dedup.decisions(docs).count() == n
    assert exact_dedup.exact_dedup(docs).filter("doc_id is null").count() == 1  # its null text is among the empty ones
    plan = mixing.mix(docs)
    assert plan.count() == n and mixing.mixed(docs, plan).count() > 0
    items = spark.createDataFrame([(None, "some more words"), (1, None)], "item_id long, text string")
    found = decontamination.digest(decontamination.contamination(docs, items)).collect()
    assert len(found) == n and sum(r.contaminated for r in found) == 1
    model = language_id.fit(docs, F.lit(True))
    assert language_id.identify(docs, model).count() == n
    placed, versions = sharding.shard(docs, 4)
    assert placed.count() == n and sharding.with_shards(docs, versions).count() == n
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, toxicity.fit(docs, labels, F.lit(True))).count() == n
    lines = line_dedup.repeats(docs)
    assert lines.count() == n and line_dedup.dedup_lines(docs, lines).count() == n
    assert token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == n
    spans = pii.personal_data(docs)
    assert spans.count() == n and pii.sanitised(docs, spans).count() == n
