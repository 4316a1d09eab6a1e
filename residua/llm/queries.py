"""The queries that the package's entry file registers for this subpackage, with their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import chat, decontamination, exact_dedup, jaccard_join, language_id, line_dedup, merkle, mixing, pii, sharding, token_alignment, token_counts, toxicity
from residua.llm.scratch import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
b AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
      WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM b
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM t GROUP BY source),
q AS (SELECT *, [3, 1, 2][CAST((i - 1) % 3 + 1 AS BIGINT)] AS w, 2 * source_size AS cap FROM p),
r AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM q),
l AS (SELECT *, (1.5::DOUBLE * (SELECT CAST(sum(source_size) AS BIGINT) FROM r) - coalesce(CAST(sum(cap) OVER b AS BIGINT), 0))
        / CAST((SELECT sum(w) FROM r) - coalesce(sum(w) OVER b, 0) AS BIGINT) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max(level) AS final FROM l WHERE level <= ratio),
g AS (SELECT source, source_size, CASE WHEN final IS NULL OR ratio <= final THEN CAST(cap AS DOUBLE) ELSE final * w END AS target FROM l, f),
c AS (SELECT t.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
        coalesce(CAST(sum(size) OVER (PARTITION BY t.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
      FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  least(greatest(budget - before, 0), size) + least(greatest(budget - source_size - before, 0), size) AS taken FROM c
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the map of this corpus, which the next run over it reads and edits
    map_path = f"{shared_dir(spark)}/shard-map-of-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    placed, _ = sharding.shard(table(spark, sf_dir, "documents"), 24, map_path=map_path)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.personal_data(docs)
    return pii.digest(pii.with_sanitised(found, docs), "sanitised_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

OP8_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS i, trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(x[i], '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''))),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
w AS (SELECT a.doc_id, a.i AS first, min(b.i) AS last FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 8 GROUP BY ALL),
k AS (SELECT w.doc_id, first, last, string_agg(line, chr(10) ORDER BY i) AS content FROM w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN first AND last GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY content, last - first ORDER BY doc_id, first) AS place FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM r WHERE place > 1),
x AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS deleted FROM g GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(x.n, 0) AS INTEGER) AS n_deleted, coalesce(deleted, '') AS deleted_lines FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def remainder(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, remainder("doc_id", 3) != 1)
    found = language_id.identify(docs, model)
    return found.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100).drop("text_key")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    found = toxicity.toxicity(docs, machine)
    return found.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeats(table(spark, sf_dir, "documents"))
    gone = line_dedup.deleted_lines(F.col("runs"))
    return found.select("doc_id", "n_lines", F.size(gone).alias("n_deleted"), F.array_join(gone.cast("array<string>"), ",").alias("deleted_lines"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    without_ends = F.replace("text", F.lit("\n"), F.lit(""))
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered=F.when(remainder("doc_id", 2) == 0, without_ends).otherwise(F.col("text")))
    hexed = lambda c: F.lower(F.hex(c))
    return found.select(
        "doc_id", *[hexed(c).alias(c) for c in ("leaf", "subroot", "root")], hexed("proof_digest").alias("proof_sha256"), hexed("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: Fixed: a conversation that imitates the template.
IMITATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    convs = convs.unionByName(spark.createDataFrame(IMITATION, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.chat_windows(convs, BUDGET, HISTORY))


BUDGET, HISTORY = 2048, 256

# crc32 as a fold over bits: a byte is mixed in, then eight steps follow
OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, text, source, lang, n_chars FROM documents),
cell AS (SELECT doc_id, tree, text, concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
  coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head FROM d),
t AS (SELECT doc_id, tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 2 = 0
  THEN sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS now FROM cell),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM t),
lv AS (SELECT 0 AS lev, tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL SELECT lev + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM lv WHERE n > 1 GROUP BY lev, tree, pos // 3),
top AS (SELECT 0 AS lev, row_number() OVER (ORDER BY tree) - 1 AS pos, tree, h, count(*) OVER () AS n FROM lv WHERE n = 1),
rv AS (SELECT lev, pos, h, n FROM top
  UNION ALL SELECT lev + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM rv WHERE n > 1 GROUP BY lev, pos // 3),
s1 AS (SELECT a.lev, a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM lv a JOIN lv b ON a.lev = b.lev AND a.tree = b.tree AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
s2 AS (SELECT a.lev, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM rv a JOIN rv b ON a.lev = b.lev AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
f AS (SELECT doc_id, tree, pos AS own, 0 AS lev, pos, now, '' AS proof FROM p
  UNION ALL SELECT doc_id, f.tree, own, f.lev + 1, f.pos // 3, sha256(l || now || r), proof || l || r FROM f JOIN s1 ON s1.lev = f.lev AND s1.tree = f.tree AND s1.pos = f.pos),
f1 AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY tree, own ORDER BY lev DESC) = 1),
g AS (SELECT doc_id, f1.tree, own, 0 AS lev, top.pos, now, proof FROM f1 JOIN top USING (tree)
  UNION ALL SELECT doc_id, g.tree, own, g.lev + 1, g.pos // 3, sha256(l || now || r), proof || l || r FROM g JOIN s2 ON s2.lev = g.lev AND s2.pos = g.pos),
g1 AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY tree, own ORDER BY lev DESC) = 1)
SELECT p.doc_id, p.leaf, top.h AS subroot, rv.h AS root, sha256(g1.proof) AS proof_sha256, g1.now AS folded_root, g1.now = rv.h AS verified
FROM p JOIN g1 ON p.tree = g1.tree AND p.pos = g1.own JOIN top ON top.tree = p.tree, rv WHERE rv.n = 1
"""

# no text of the table has ### in a row of more than three
OP13_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok')),
e AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '#\##'), '</turn', '<\/turn'), ':', '\:') || ': ' || replace(replace(replace(text, '\', '\\'), '###', '#\##'), '</turn', '<\/turn') || '</turn>' || chr(10) AS w FROM c),
t AS (SELECT conv_id, turn, role, text, length(w) AS chars, len(regexp_extract_all(w, '[\p{L}\p{N}]+|[^\p{L}\p{N}	-
 ]')) AS n, floor(turn / 256) AS run, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM e),
sys AS (SELECT conv_id, n AS top_n, chars AS top_chars FROM t WHERE k = 1 AND role = 'system'),
b AS (SELECT t.*, coalesce(top_n, 0) AS top_n, coalesce(top_chars, 0) AS top_chars, k - 1 - (sys.conv_id IS NOT NULL)::INT AS i, sum(n) OVER (PARTITION BY t.conv_id ORDER BY k) AS upto, sum(chars) OVER (PARTITION BY t.conv_id ORDER BY k) AS chars_upto FROM t LEFT JOIN sys USING (conv_id)),
b1 AS (SELECT *, upto - n AS since, chars_upto - chars AS chars_since, lead(run) OVER (PARTITION BY conv_id ORDER BY k) AS next_run, min(i) OVER (PARTITION BY conv_id, run ORDER BY k) AS run_i FROM b),
b2 AS (SELECT * FROM b1 WHERE i >= 0),
w AS (SELECT conv_id, i AS first, 0 AS wi FROM b2 WHERE i = 0
  UNION ALL SELECT w.conv_id, min(x.i), any_value(w.wi) + 1 FROM w JOIN b2 a ON a.conv_id = w.conv_id AND a.i = w.first JOIN b2 x ON x.conv_id = w.conv_id AND x.i > w.first
    AND (x.run > a.run OR x.upto - a.since > 2048 - a.top_n - CASE WHEN a.i = 0 THEN 0 ELSE 256 END) GROUP BY w.conv_id, w.first),
h AS (SELECT w.conv_id, w.first, any_value(a.top_chars) AS top_chars, coalesce(sum(y.chars), 0) AS past FROM w JOIN b2 a ON a.conv_id = w.conv_id AND a.i = w.first
  LEFT JOIN b2 y ON y.conv_id = w.conv_id AND y.i < w.first AND a.since - y.since <= 256 AND y.run >= a.run - 1 GROUP BY ALL),
f AS (SELECT conv_id, sum(past + CASE WHEN first > 0 THEN top_chars ELSE 0 END) AS more FROM h GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) + coalesce(any_value(more), 0) AS BIGINT) AS formatted_chars
FROM t LEFT JOIN f USING (conv_id) GROUP BY conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_alignment": op11_alignment,
    "op12_merkle": op12_merkle,
    "op13_chat": op13_chat,
}
SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op3_decontamination": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op8_line_dedup": OP8_SQL, "op12_merkle": OP12_SQL, "op13_chat": OP13_SQL}
