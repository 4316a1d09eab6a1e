"""Mixing sources to target weights, in whole words, on DataFrame operations only.

Every document gets a hash-random key; within its source the rows are dealt to key ranges (``bucket``), each of about
``rows_per_bucket`` rows however large the source is, so that a source with a third of all rows spreads over as many tasks
as its share asks for.  Prefix sums of the sizes are built bottom up: inside a bucket, over the buckets of a super-bucket,
over the super-buckets of the source.  No task ever holds a source.  A row's words are then cut against the source's
budget: once for each epoch, the last one ending in the middle of the row where the budget runs out.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that repeat an id are
ordered by size; a source without words gets target 0; an empty table gives an empty result; other columns do not matter.
Only the source summary (one row a source, as many rows as there are weights to set) passes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.scratch import free_name, settle, tidied

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 30
FAN = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(id_col: Column, seed: str, part: int) -> Column:
    """30 bits of md5(seed:id), the same in any engine; part 0 or 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.shiftright(F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("long"), 2)


def sizes(docs: DataFrame, seed: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow table that all later steps read: doc_id, source, size, key, key2."""
    return settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"),
            hash_key(F.col(id_col), seed, 0).alias("key"),
            hash_key(F.col(id_col), seed, 1).alias("key2"),
        ),
        "mix-sizes",
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, n_rows, source_size, target: shares by weight, none above ``most`` times its source.

    Handing an excess on by weight until nobody is above ends where every source has min(most * size, level * weight).
    With the sources in order of most * size / weight, the level is the first that is not above the source's own ratio; later ones are lower.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.col("source_size") * most).alias("cap")
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = per.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", ratio)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("open_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(share) - F.col("capped")) / F.col("open_weight"))
    t = t.withColumn("final", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows))
    return t.select("source", "n_rows", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def taken(rows: DataFrame, per_source: DataFrame, rows_per_bucket: int = 4096, epochs: int = 2) -> DataFrame:
    """Adds source_size, target, before (words of the source's earlier rows) and taken to ``rows``: the row's words inside
    the budget, once an epoch."""
    per = per_source.withColumn("buckets", F.ceil(F.col("n_rows") / rows_per_bucket))
    same = rows["source"].eqNullSafe(per["source"])
    dealt = rows.join(F.broadcast(per) if per.count() <= 100_000 else per, same).select(rows["*"], "source_size", "target", F.shiftright(F.col("key") * F.col("buckets"), KEY_BITS).alias("bucket"))
    dealt = dealt.withColumn("over", F.floor(F.col("bucket") / FAN)).withColumn("null_source", F.col("source").isNull())
    s = ("null_source", "source")

    def running(df: DataFrame, name: str, value: str, part: tuple, *order: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))

    per_bucket = settle(dealt.groupBy(*s, "over", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    per_over = running(per_bucket.groupBy(*s, "over").agg(F.sum("words").alias("words")), "base_over", "words", s, "over").drop("words")
    per_bucket = running(per_bucket, "base_bucket", "words", (*s, "over"), "bucket").drop("words")

    def null_safe(a: DataFrame, b: DataFrame, cols: tuple) -> DataFrame:
        on = a[cols[0]] == b[cols[0]]
        for c in cols[1:]:
            on = on & (a[c].eqNullSafe(b[c]) if c == "source" else a[c] == b[c])
        return a.join(b, on).drop(*[b[c] for c in cols])

    base = null_safe(per_bucket, per_over, (*s, "over")).withColumn("base", F.col("base_bucket") + F.col("base_over")).select(*s, "bucket", "base")
    inside = running(dealt, "inside", "size", (*s, "bucket"), "key", "key2", "doc_id", "size")
    placed = null_safe(inside, base, (*s, "bucket")).withColumn("before", F.col("inside") + F.col("base"))
    budget = F.round("target").cast("long")
    part = [F.least(F.greatest(budget - F.col("source_size") * e - F.col("before"), F.lit(0)), F.col("size")) for e in range(epochs)]
    total = part[0]
    for p in part[1:]:
        total = total + p
    return placed.select("doc_id", "source", "size", "key", "key2", "source_size", "target", "before", total.cast("long").alias("taken"))


@tidied
def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_bucket: int = 4096) -> DataFrame:
    """doc_id, source, size, key, key2, source_size, target, before, taken for every document."""
    rows = sizes(docs, seed, id_col, text_col, source_col)
    return taken(rows, settle(targets(rows, weights, share, most), "mix-targets"), rows_per_bucket, most)


def cuts(plan: DataFrame) -> DataFrame:
    """One row a source: whole (epochs that take every row), and the row in which the last epoch's budget ends, with the
    words that it still gets.  Rows of the source that come before it are taken once more, later ones are not."""
    budget = F.round("target").cast("long")
    rest = budget - F.floor(budget / F.col("source_size")) * F.col("source_size")
    ends = (F.col("size") > 0) & (F.col("before") <= rest) & (rest < F.col("before") + F.col("size"))
    row = F.struct("key", "key2", "doc_id", "size")
    return plan.filter(ends).select("source", F.floor(budget / F.col("source_size")).cast("int").alias("whole"), row.alias("last"), (rest - F.col("before")).alias("words"))


def mixed(docs: DataFrame, plan: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", max_broadcast_rows: int = 100_000) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each epoch that takes the document whole, and one with
    its first words where the budget ends inside it.  ``plan`` is the result of ``mix`` for the same documents.

    A row finds what it gets by comparing its own hash key with its source's cut, so texts don't shuffle: the cuts, one row
    a source, are broadcast up to ``max_broadcast_rows``.  Rows that repeat the id and size of a cut row are cut like it;
    rows without words are left out."""
    name = {c: free_name(docs, f"mix_{c}") for c in ("source", "whole", "last", "words", "size", "copy")}
    cut = settle(cuts(plan), "mix-cuts").select(*[F.col(c).alias(name[c]) for c in ("source", "whole", "last", "words")])
    if cut.count() <= max_broadcast_rows:
        cut = F.broadcast(cut)
    rows = docs.join(cut, docs[source_col].eqNullSafe(cut[name["source"]])).withColumn(name["size"], words(F.col(text_col)))
    size, last = F.col(name["size"]), F.col(name["last"])
    own = F.struct(hash_key(F.col(id_col), seed, 0).alias("key"), hash_key(F.col(id_col), seed, 1).alias("key2"), F.col(id_col).alias("doc_id"), size.alias("size"))
    part = F.when(own < last, size).when(own == last, F.col(name["words"])).otherwise(F.lit(0).cast("long"))
    copies = F.filter(F.concat(F.array_repeat(size, F.col(name["whole"])), F.array(part)), lambda n: n > 0)
    rows = rows.withColumn(name["copy"], F.explode(copies))
    copy = F.col(name["copy"])
    pieces = F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut_text = F.when(copy < size, F.array_join(F.slice(pieces, F.lit(1), copy.cast("int")), "")).otherwise(F.col(text_col))
    out = {text_col: cut_text}
    if chars_col in docs.columns:
        out[chars_col] = F.when(copy < size, F.length(cut_text)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
