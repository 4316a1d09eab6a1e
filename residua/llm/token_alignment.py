"""Alignment of two tokenizers over a corpus: DuckDB inside each task on token interval tables, pair counts merged in Spark.

A text is tokenised by a byte-level BPE vocabulary (A) and by a piece vocabulary (B), both over the bytes of space + text.
Where both tokens end, the text is cut into groups; tokens whose byte ranges end together are linked.

Texts are cut into cells at places that both tokenizers respect: before a space after a character that isn't white space,
as no pre-token of A and no piece of B has a space there (``Pair`` checks B's pieces; if one has, a text is one cell).  What is
the same in every text, tokens, groups and links of a cell, is found once for each cell that a task has not seen lately: the
new cells of a batch stand one after another on a line of bytes, the tokens of both sides are interval tables on it, and DuckDB
joins them (a range join for overlaps, ASOF joins to find a token's cell, window sums to number groups).  A document is the
sum of its cells.  Each batch adds one row of partial pair counts to its documents; Spark merges those, and the counts go back
to the documents by a broadcast of at most ``most_pairs`` pairs or a salted join beyond.

Memory is linear in GROUP characters or the longest text, and in CELLS cells kept between batches.

Defined results: null and empty texts have no tokens, nor have texts whose tokens' bytes differ from space + text; a text of
any length is tokenised whole; repeated rows and ties count each; an empty table gives an empty result; other columns do not
matter.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.scratch import settle, tidied
from residua.llm.textbuf import release, utf8
from residua.llm.token_counts import byte_symbols

GROUP, CELLS, CELL_CHARS, LINE = 500_000, 400_000, 6_000_000, 20_000
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
CUT = re.compile(r"(?<=\S)(?= .)", re.S)

#: a, b: token intervals (i, id, s, e) in order; cells: (c, s, e), the cells on the line.
JOINS = """
CREATE OR REPLACE TEMP TABLE o AS SELECT a.i AS ai, b.i AS bi, a.id AS a_id, b.id AS b_id, a.e = b.e AS linked, a.e AS e FROM a JOIN b ON a.s < b.e AND b.s < a.e;
CREATE OR REPLACE TEMP TABLE oc AS SELECT o.*, cells.c FROM o ASOF JOIN cells ON o.e <= cells.e;
CREATE OR REPLACE TEMP TABLE t AS
  WITH x AS (SELECT 0 AS side, a.i, a.id, a.s, a.e, b.e IS NOT NULL AS ends FROM a LEFT JOIN b ON a.e = b.e UNION ALL SELECT 1, b.i, b.id, b.s, b.e, a.e IS NOT NULL FROM b LEFT JOIN a ON a.e = b.e),
       y AS (SELECT x.*, cells.c, cells.s = x.s AS first FROM x ASOF JOIN cells ON x.e <= cells.e)
  SELECT *, sum(ends::INT) OVER w - ends::INT AS g, coalesce(lag(ends) OVER w, true) AS opens FROM y WINDOW w AS (PARTITION BY side ORDER BY i ROWS UNBOUNDED PRECEDING);
"""
BY_CELL = "SELECT c, count(*) FILTER (WHERE side = 0) AS n_a, count(*) FILTER (WHERE side = 1) AS n_b, count(*) FILTER (WHERE ends AND side = 0) AS n_groups FROM t GROUP BY c ORDER BY c"
#: The ids of all groups with what stands before each, cell after cell.
GROUPS = "SELECT CASE WHEN NOT opens THEN ',' WHEN side = 1 THEN '|' WHEN first THEN '' ELSE ';' END || id AS piece FROM t ORDER BY g, side, i"
OVERLAPS = "SELECT cells.c, count(oc.c) AS n FROM cells LEFT JOIN oc USING (c) GROUP BY ALL ORDER BY ALL"
LINKS = "SELECT c, a_id::BIGINT * {size} + b_id AS pair FROM oc WHERE linked ORDER BY c"
PARTIAL = "SELECT pair, sum(n)::BIGINT AS n FROM p GROUP BY pair ORDER BY pair"


class Pair:
    """Both vocabularies, made in a task from what their files hold."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        symbols = byte_symbols()
        entries = {i: w for w, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(symbols[ch] for ch in w) if all(ch in symbols for ch in w) else w.encode() for w in (entries.get(i, "") for i in range(max(entries) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size = len(pieces)
        self.a_length, self.b_length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.cut = not any(re.search("[^▁]▁", p) for p in pieces)

    def cells(self, text: str) -> list[str]:
        return CUT.split(f" {text}") if self.cut else [f" {text}"]

    def encode(self, items: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids by A and B of items (which begin with a space), and whether both give the item's bytes."""
        a = [e.ids for e in self.a.encode_batch(items, add_special_tokens=False)]
        b = self.b.encode([x[1:] for x in items], num_threads=1)
        good = [b"".join(map(self.a_bytes.__getitem__, x)) == (w := s.encode()) == b"".join(map(self.b_bytes.__getitem__, y)) for s, x, y in zip(items, a, b, strict=True)]
        return a, b, good


class Aligner:
    """What is known of cells: tokens, groups, links; at most about CELLS of them."""

    def __init__(self, pair: Pair):
        self.pair, self.con = pair, duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars, self.bad, self.groups = 0, set(), []
        self.counts, self.first, self.links = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, cells: list[str]) -> None:
        """Align cells that aren't known yet."""
        items, held, size = [], [[]], 0
        for c in cells:  # cells that end in white space are encoded alone: A looks past it
            if held[-1] and (size + len(c) > LINE or c[-1].isspace() or held[-1][-1][-1].isspace()):
                held.append([])
                size = 0
            held[-1].append(c)
            size += len(c)
        items = ["".join(h) for h in held]
        a, b, good = self.pair.encode(items)
        order: list[str] = []
        line_a: list[list[int]] = []
        line_b: list[list[int]] = []
        for h, x, y, ok in zip(held, a, b, good, strict=True):
            if ok:
                order += h
                line_a.append(x)
                line_b.append(y)
                continue
            for cell, x1, y1, fits in zip(h, *self.pair.encode(h), strict=True):
                if fits:
                    order.append(cell)
                    line_a.append(x1)
                    line_b.append(y1)
                else:
                    self.bad.add(cell)
                    self.chars += len(cell)
        if order:
            self.join(order, line_a, line_b)

    def join(self, order: list[str], line_a: list[list[int]], line_b: list[list[int]]) -> None:
        con, k, n = self.con, len(self.at), len(order)
        ends = np.cumsum([len(c.encode()) for c in order])
        con.register("cells", pa.table({"c": np.arange(n), "s": np.append(0, ends[:-1]), "e": ends}))
        for name, ids, length in (("a", line_a, self.pair.a_length), ("b", line_b, self.pair.b_length)):
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            e = np.cumsum(length[flat])
            con.register(name, pa.table({"i": np.arange(len(flat)), "id": flat, "s": e - length[flat], "e": e}))
        con.execute(JOINS)
        by = con.sql(BY_CELL).to_arrow_table()
        overlaps = con.sql(OVERLAPS).to_arrow_table().column("n").to_numpy()
        links = con.sql(LINKS.format(size=self.pair.size)).to_arrow_table()
        self.counts = np.concatenate([self.counts, np.stack([*(by.column(c).to_numpy() for c in COLUMNS[:3]), overlaps], 1)])
        data, at = utf8(con.sql(GROUPS).to_arrow_table().column("piece").combine_chunks())
        whole, ends = data[at[0] : at[-1]].tobytes().decode(), at[np.append(0, np.cumsum(self.counts[k:, :2].sum(1)))] - at[0]
        self.groups += [whole[i:j] for i, j in pairwise(ends.tolist())]  # ASCII: places are bytes
        per = np.bincount(links.column("c").to_numpy(), minlength=n)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(per)])
        self.links = np.concatenate([self.links, links.column("pair").to_numpy()])
        self.at.update(zip(order, range(k, k + n), strict=True))
        self.chars += sum(map(len, order))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of each text: its counts, its groups, its linked pairs and how often; and the pairs of all."""
        if len(self.at) + len(self.bad) > CELLS or self.chars > CELL_CHARS:
            self.clear()
        cut = [self.pair.cells(t) if t else [] for t in texts]
        fresh = list(set().union(*cut).difference(self.at, self.bad))
        if fresh:
            self.learn(fresh)
        if self.bad:
            cut = [c if self.bad.isdisjoint(c) else [] for c in cut]
        get, groups = self.at.__getitem__, self.groups.__getitem__
        where = [np.fromiter(map(get, c), np.int64, len(c)) for c in cut]
        joined = [";".join(map(groups, w.tolist())) for w in where]
        flat, doc = np.concatenate(where), np.repeat(np.arange(len(texts)), [len(w) for w in where])
        per = self.first[flat + 1] - self.first[flat]
        counts = np.zeros((len(texts), 5), np.int64)
        for j in range(3):
            counts[:, j] = np.bincount(doc, self.counts[flat, j], len(texts))
        counts[:, 3] = np.bincount(doc, per, len(texts))
        counts[:, 4] = np.bincount(doc, self.counts[flat, 3], len(texts))
        span = self.pair.size * len(self.pair.a_bytes)
        place = np.repeat(self.first[flat] - np.append(0, np.cumsum(per)[:-1]), per) + np.arange(per.sum())
        key, n = np.unique(np.repeat(doc, per) * span + self.links[place], return_counts=True)
        pair, ends = key % span, np.searchsorted(key // span, np.arange(1, len(texts)))
        self.con.register("p", pa.table({"pair": pair, "n": n}))
        partial = self.con.sql(PARTIAL).to_arrow_table()
        return counts, joined, np.split(pair, ends), np.split(n, ends), (partial.column("pair").to_numpy(), partial.column("n").to_numpy())


def aligned(batches: Iterator[pa.RecordBatch], files, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """A row a document, and after each GROUP characters one with the linked pairs of all of them (``doc`` false)."""
    aligner = Aligner(Pair(*files.value))
    try:
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j]) <= GROUP):
                    chars += len(texts[j])
                    j += 1
                counts, groups, pairs, times, (all_pairs, all_times) = aligner.align(texts[i:j])
                ids = pa.concat_arrays([batch.column(0).slice(i, j - i), pa.nulls(1, batch.column(0).type)])
                cols = [pa.array(np.append(counts[:, c], 0)) for c in range(5)]
                sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] + [""]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([True] * (j - i) + [False]), *cols, pa.array(sha), pa.array([*groups, None] if with_groups else [None] * len(sha), pa.string()), pa.array([*pairs, all_pairs], pa.list_(pa.int64())), pa.array([*times, all_times], pa.list_(pa.int64()))],
                    names=["doc_id", "doc", *COLUMNS, "groups_sha256", "groups", "pairs", "times"],
                )
                i = j
    finally:
        aligner.con.close()
        release()


def scored(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """pairs, times (the last columns) give way to n_best, count_sum, from the counts of all pairs."""
    pair, count, best = table.value
    for batch in batches:
        pairs, times = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        n, at = times.flatten().to_numpy(), np.searchsorted(pair, pairs.flatten().to_numpy())
        row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
        total = np.zeros((2, batch.num_rows), np.int64)
        np.add.at(total[0], row, n * best[at])
        np.add.at(total[1], row, n * count[at])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(total[0]), pa.array(total[1])], names=[*batch.schema.names[:-2], "n_best", "count_sum"])


def pair_counts(rows: DataFrame, size: int) -> DataFrame:
    """pair, a, b, count, best (whether no token of A is linked with b more often), over the whole corpus."""
    each = rows.filter("NOT doc").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    merged = each.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % size)
    return merged.select("pair", F.floor(F.col("pair") / size).alias("a"), "b", "count", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).alias("best"))


def scores(rows: DataFrame, counts: DataFrame, most_pairs: int, salts: int = 16) -> DataFrame:
    """The documents of ``rows`` with n_best and count_sum in place of pairs and times."""
    docs, spark = rows.filter("doc").drop("doc"), rows.sparkSession
    out = docs.drop("pairs", "times")
    if counts.count() <= most_pairs:
        found = counts.select("pair", "count", "best").toArrow().sort_by("pair").combine_chunks()
        table = spark.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("pair", "count", "best")))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
        return docs.select(*out.columns, "pairs", "times").mapInArrow(lambda it: scored(it, table), f"{schema}, n_best long, count_sum long")
    # a pair may stand in every document
    salted = counts.select("pair", "count", "best", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    each = docs.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"), (F.xxhash64("row") % salts + salts).cast("int").alias("salt"))
    sums = each.withColumn("salt", F.col("salt") % salts).join(salted, ["pair", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return out.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """The written table of both results: documents (``doc``) with their counts and linked pairs, and rows of partial counts.

    with_groups: keeps ``a1,a2|b1;a3|b2`` of every text, ids in order, beside its digest."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    counts = ", ".join(f"{c} long" for c in COLUMNS)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, doc boolean, {counts}, groups_sha256 string, groups string, pairs array<long>, times array<long>"
    files = docs.sparkSession.sparkContext.broadcast(tuple(Path(p).read_bytes() for p in (a_path, b_path)))
    found = rows.mapInArrow(lambda it: aligned(it, files, with_groups), schema)
    return settle((found if with_groups else found.drop("groups")).withColumn("row", F.monotonically_increasing_id()), "aligned")


@tidied
def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = 2_000_000, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum of every document (with_groups: and its
    groups): links, those whose pair is the most frequent one of its B id, and the sum of their pairs' counts."""
    rows = align(docs, a_path, b_path, id_col, text_col, with_groups)
    counts = settle(pair_counts(rows, pieces(b_path)), "pair-counts")
    return scores(rows, counts, most_pairs).drop("row")


def pieces(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
