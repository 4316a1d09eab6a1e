"""Sequence corpora: documents as proteins, sources as organisms, languages as clades; and FASTA files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.functions.alphabet import normalise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by key where it is so small that its files keep only some of the cores busy (a file's row group is
    one task, and what is made of a sequence is many times its size).  Larger input is left where it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= cores * split:
        return df
    return df.repartition(4 * cores, key)


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prot_id, org, clade, seq, len of the documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    return docs.select(F.col("doc_id").alias("prot_id"), F.col("source").alias("org"), F.col("lang").alias("clade"), normalise(F.col("text")).alias("seq")).withColumn("len", F.length("seq"))


def running(rows: DataFrame, key: str, value: Column, name: str, within: tuple[str, ...] = (), per_range: int = 1 << 16, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, by ``key`` (a whole number; null after all others), inside each group of
    ``within``.

    Keys are cut into ranges of equal width, as many as give about ``per_range`` rows each however sparse the keys are.  The
    sum is taken inside a range by its rows and over the ranges by their totals, so that no task holds all rows."""
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, high, n = ends["low"] or 0, ends["high"] or 0, ends["n"]
    ranges = max(1, -(-n // per_range))
    width = max(1, -(-(high - low + 1) // ranges))
    cut = F.coalesce(F.floor((F.col(key) - low) / width), F.lit(ranges)).alias("_range")
    own = rows.select("*", cut, value.alias("_value"))
    before = (Window.unboundedPreceding, -1)
    own = own.withColumn("_in", F.coalesce(F.sum("_value").over(Window.partitionBy(*within, "_range").orderBy(F.col(key).asc_nulls_last()).rowsBetween(*before)), F.lit(0)))
    totals = own.groupBy(*within, "_range").agg(F.sum("_value").alias("_total"))
    over = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(*before)
    base = totals.select(*[F.col(c).alias(f"_{c}") for c in within], F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"))
    on = own["_range"] == base["_of"]
    for c in within:
        on = on & own[c].eqNullSafe(base[f"_{c}"])
    few = not within and ranges <= max_broadcast_rows
    return own.join(F.broadcast(base) if few else base, on).withColumn(name, F.col("_base") + F.col("_in")).select(*rows.columns, name)


def starts(prots: DataFrame) -> DataFrame:
    """Adds global_start: where the protein begins when all stand one after another, by id, each with an end mark; proteins
    without an id come last, in any order."""
    return running(prots, "prot_id", F.col("len") + 1, "global_start")


def read_fasta(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """name, seq, len of a FASTA file's records; strict: lower case letters are X, as all that isn't a capital letter."""
    records = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.col("value"), "^>", "")
    head = F.regexp_extract(body, r"^([^\n]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*", ""), "\n", "")
    return records.filter(F.length(F.trim("value")) > 0).select(head.alias("name"), sequence(rest, strict).alias("seq")).withColumn("len", F.length("seq"))


def sequence(body: Column, strict: bool) -> Column:
    """Residues of a record's joined lines.  A strict reader keeps every character, a carriage return as X too."""
    if not strict:
        return normalise(body)
    from residua.functions.alphabet import exchanged

    return F.regexp_replace(exchanged(body), "[^A-Z]", "X")


def fasta_lines(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """The sequence lines of a file without its heads; the first n lines of the file where n is given."""
    lines = spark.read.text(path)
    return (lines.limit(n) if n is not None else lines).filter(~F.startswith("value", F.lit(">")))


def pretty_name(head: Column) -> Column:
    """From the first space to before ' OS='."""
    return F.regexp_extract(head, r"( .*?) OS=", 1)
