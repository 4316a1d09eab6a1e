"""Randomised controls: keyed shuffles inside a fragment, a domain, a protein, an organism or the whole corpus.

A shuffle orders residues by md5(seed:id:place), so it is the same for any partitioning and engine.  X and ends stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions.alphabet import RESIDUES
from residua.functions.keys import numbered_keys
from residua.operators.sampling import keyed
from residua.sinks.scratch import settle
from residua.sources.corpus import running


def shuffled(text: Column, ident: Column, seed: str) -> Column:
    """The characters of a short string in keyed order."""
    tagged = F.transform(F.split(text, ""), lambda c, i: F.struct(keyed(seed, ident.cast("string"), i.cast("string")).alias("k"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: s["c"]), "")


def half_shuffled(text: Column, ident: Column, seed: str, lf: int) -> Column:
    """Both halves shuffled apart."""
    h = lf // 2
    return F.concat(shuffled(F.substr(text, F.lit(1), F.lit(h)), ident, f"{seed}a"), shuffled(F.substr(text, F.lit(h + 1), F.lit(lf - h)), ident, f"{seed}b"))


def domain_shuffled(frag: Column, domain: Column, ident: Column, seed: str) -> Column:
    """As many residues as the fragment has, from its shuffled domain."""
    return F.substr(shuffled(domain, ident, seed), F.lit(1), F.length(frag))


def block_shuffled(frag: Column, domain: Column, ident: Column, seed: str, k: int, size: int) -> Column:
    """Blocks of k residues of the domain, read as a ring from a keyed offset below k, in keyed order and cut to the
    fragment's length; the fragment itself if it is shorter than k."""
    offset = (F.conv(F.substring(keyed(f"{seed}o", ident.cast("string")), 1, 8), 16, 10).cast("long") % k).cast("int")
    ring = F.concat(domain, F.substr(domain, F.lit(1), F.lit(k)))
    n = -(-size // k)
    blocks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(keyed(seed, ident.cast("string"), i.cast("string")).alias("k"), i.alias("i"), F.substr(ring, offset + i * k + 1, F.least(F.lit(k), F.lit(size) - i * k)).alias("b")))
    return F.when(F.length(frag) < k, frag).otherwise(F.substr(F.array_join(F.transform(F.array_sort(blocks), lambda s: s["b"]), ""), F.lit(1), F.length(frag)))


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., seq) from (..., seq, letters): the letters in turn at all places but those of X."""
    for batch in batches:
        out, k = [], batch.num_columns - 2
        for seq, letters in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True):
            old = np.frombuffer(seq.encode(), np.uint8).copy()
            if letters:
                old[old != 88] = np.frombuffer(letters.encode(), np.uint8)
            out.append(old.tobytes().decode())
        yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out, pa.string())], names=batch.schema.names[: k + 1])


def residue_keys(seed: str, idents: list, seqs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the residues but X of some proteins: the md5 of seed, protein and place, the letter, and which protein it is."""
    letters = np.frombuffer("".join(seqs).encode(), np.uint8)
    size = np.array([len(x) for x in seqs], np.int64)
    owner = np.repeat(np.arange(len(seqs)), size)
    number = np.arange(1, len(letters) + 1) - np.repeat(np.cumsum(size) - size, size)
    free = letters != 88
    owner = owner[free]
    return numbered_keys([f"{seed}:{i}:".encode() for i in idents], owner, number[free]), letters[free], owner


def in_cells(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The number of the key's range, of as many of equal width."""
    return (keys[:, :4].copy().view(">u4").ravel().astype(np.uint64) * cells.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def some(columns: list[list], most: int) -> Iterator[list[list]]:
    """Rows (the last column their text) of about ``most`` residues each time."""
    begin, size = 0, 0
    for i, text in enumerate(columns[-1]):
        size += len(text)
        if size >= most or i + 1 == len(columns[-1]):
            yield [c[begin : i + 1] for c in columns]
            begin, size = i + 1, 0


def packed(names: list[str], keys: np.ndarray, letters: np.ndarray, group: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    """g, cell, keys, letters: one row a group and cell."""
    order = np.lexsort((cell, group))
    cut = np.flatnonzero((np.diff(group[order]) != 0) | (np.diff(cell[order]) != 0)) + 1
    parts = np.split(order, cut)
    first = [p[0] for p in parts]
    return pa.RecordBatch.from_arrays(
        [pa.array([names[int(group[i])] for i in first], pa.string()), pa.array([int(cell[i]) for i in first], pa.int64()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([letters[p].tobytes() for p in parts], pa.binary())],
        names=["g", "cell", "keys", "letters"],
    )


def keyed_cells(batches: Iterator[pa.RecordBatch], seed: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """g, cell, keys, letters: the residues but X of some proteins (prot_id, g, cells, seq), packed by group and range of the
    key; a key is the md5 of seed, protein and place."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        for ids, gs, cells, seqs in some([batch.column(i).to_pylist() for i in range(4)], most):
            keys, letters, owner = residue_keys(seed, ids, seqs)
            if len(keys):
                held.append((keys, letters, np.array([names.setdefault(g, len(names)) for g in gs])[owner], in_cells(keys, np.array(cells)[owner])))
                n += len(keys)
            if n >= most:
                yield packed(list(names), *(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n, names = [], 0, {}
    if held:
        yield packed(list(names), *(np.concatenate(c) for c in zip(*held, strict=True)))


def cell_counts(batches: Iterator[pa.RecordBatch], seeds: list[str], most: int = 1 << 18, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """g (seed:group), cell, n: residues but X of some proteins (prot_id, g, cells, seq) by range of the key, under each seed."""
    held: dict[str, np.ndarray] = {}

    def told() -> pa.RecordBatch:
        found = [(g, np.flatnonzero(n)) for g, n in held.items()]
        at = np.concatenate([c for _, c in found])
        names = pa.array([g for g, _ in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), [len(c) for _, c in found])))
        return pa.RecordBatch.from_arrays([names, pa.array(at), pa.array(np.concatenate([held[g][c] for g, c in found]))], names=["g", "cell", "n"])

    for batch in batches:
        for ids, gs, cells, seqs in some([batch.column(i).to_pylist() for i in range(4)], most):
            names = {g: k for k, g in enumerate(dict.fromkeys(gs))}
            size = dict(zip(gs, cells, strict=True))
            group = np.array([names[g] for g in gs])
            for seed in seeds:
                keys, _, owner = residue_keys(seed, ids, seqs)
                cell, own = in_cells(keys, np.array(cells)[owner]), group[owner]
                for g, k in names.items():
                    had = held.setdefault(f"{seed}:{g}", np.zeros(size[g], np.int64))
                    had += np.bincount(cell[own == k] if len(names) > 1 else cell, minlength=size[g])
            if sum(map(len, held.values())) > rows:
                yield told()
                held = {}
    if held:
        yield told()


def chosen_cells(batches: Iterator[pa.RecordBatch], seeds: list[str], chosen: dict[str, np.ndarray], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """g (seed:group), cell, keys, letters, packed as by ``keyed_cells``, of the chosen cells alone."""
    for batch in batches:
        for ids, gs, cells, seqs in some([batch.column(i).to_pylist() for i in range(4)], most):
            names = {g: k for k, g in enumerate(dict.fromkeys(gs))}
            group = np.array([names[g] for g in gs])
            for seed in seeds:
                keys, letters, owner = residue_keys(seed, ids, seqs)
                cell, own = in_cells(keys, np.array(cells)[owner]), group[owner]
                take = np.zeros(len(cell), bool)
                for g, k in names.items():
                    if (want := chosen.get(f"{seed}:{g}")) is not None:
                        mine = np.flatnonzero(own == k)
                        at = np.minimum(np.searchsorted(want, cell[mine]), len(want) - 1)
                        take[mine] = want[at] == cell[mine]
                if take.any():
                    yield packed([f"{seed}:{g}" for g in names], keys[take], letters[take], own[take], cell[take])


def own_order(batches: Iterator[pa.RecordBatch], seed: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """prot_id, seq of proteins (prot_id, ident, seq), the residues but X of each in keyed order."""
    for batch in batches:
        begin = 0
        for idents, seqs in some([batch.column(i).to_pylist() for i in (1, 2)], most):
            keys, letters, owner = residue_keys(seed, idents, seqs)
            k = keys.copy().view(">u8").astype(np.uint64)
            new = np.frombuffer("".join(seqs).encode(), np.uint8).copy()
            new[new != 88] = letters[np.lexsort((k[:, 1], k[:, 0], owner))]
            text, ends = new.tobytes().decode(), np.cumsum([len(x) for x in seqs]).tolist()
            out = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(seqs)), pa.array(out, pa.string())], names=["prot_id", "seq"])
            begin += len(seqs)


def in_order(table: pa.Table) -> pa.Table:
    """The letters of a cell in the order of their keys."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), ">u8").reshape(-1, 2)
    letters = np.frombuffer(b"".join(table.column("letters").to_pylist()), np.uint8)
    text = letters[np.lexsort((keys[:, 1], keys[:, 0]))].tobytes().decode()
    return pa.table({"g": table.column("g").slice(0, 1), "cell": table.column("cell").slice(0, 1), "text": pa.array([text]), "n": pa.array([len(text)], pa.int64())})


def permuted(prots: DataFrame, group: tuple[str, ...], seed: str, equal: bool = False, per_cell: int = 50_000) -> DataFrame:
    """prot_id, seq after a shuffle of all residues but X inside the groups (the whole corpus where there is none); the keyed
    order of the residues fills the places by protein and place.  Proteins without an id are left out.

    A protein's own shuffle is made where its row is.  Otherwise each group's residues are dealt to cells, ranges of the
    key of about ``per_cell`` residues, packed before they shuffle, and a cell becomes one string of letters in order; a
    protein takes slices of the cells that its run of ranks overlaps.  No residue is a row, and no task holds a group."""
    kind = prots.schema["prot_id"].dataType.simpleString()
    p = prots.filter("prot_id is not null").select("prot_id", group_name(group).alias("g"), "seq", F.length(F.replace("seq", F.lit("X"))).cast("long").alias("free"))
    if group == ("prot_id",) and not equal:
        rows = p.select("prot_id", F.col("prot_id").cast("string").alias("ident"), "seq")
        return rows.mapInArrow(lambda it: own_order(it, seed), f"prot_id {kind}, seq string")
    p = settle(p, "shuffle-proteins")
    placed = running(p.drop("seq").filter("free > 0"), "prot_id", F.col("free"), "start", ("g",))
    if equal:
        first = ((F.col("start") + 1) % len(RESIDUES) + 1).cast("int")
        letters = F.substr(F.repeat(F.lit(RESIDUES), (F.col("free") / len(RESIDUES)).cast("int") + 2), first, F.col("free").cast("int"))
        own = placed.select("prot_id", letters.alias("letters"))
    else:
        totals = p.groupBy("g").agg(F.ceil(F.sum("free") / per_cell).alias("cells"))
        dealt = p.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "g").select(F.col("prot_id").cast("string"), "g", "cells", "seq")
        packed = dealt.mapInArrow(lambda it: keyed_cells(it, seed), "g string, cell long, keys binary, letters binary")
        cells = settle(packed.groupBy("g", "cell").applyInArrow(in_order, "g string, cell long, text string, n long"), "shuffle-cells")
        based = running(cells.drop("text"), "cell", F.col("n"), "base", ("g",)).select(F.col("g").alias("b_g"), F.col("cell").alias("b_cell"), "base")
        cells = cells.join(based, (F.col("g") == F.col("b_g")) & (F.col("cell") == F.col("b_cell"))).select("g", "text", "base", "n")

        def blocks(first: Column, n: Column) -> Column:
            return F.explode(F.sequence(F.floor(first / per_cell), F.floor((first + n - 1) / per_cell))).alias("block")

        left = placed.select("prot_id", "g", "start", "free", blocks(F.col("start"), F.col("free")))
        right = cells.select("g", "text", "base", "n", blocks(F.col("base"), F.col("n")))
        low, high = F.greatest("start", "base"), F.least(F.col("start") + F.col("free"), F.col("base") + F.col("n"))
        met = left.join(right, ["g", "block"]).filter((low < high) & (F.col("block") == F.floor(low / per_cell)))
        slices = met.select("prot_id", low.alias("at"), F.substr("text", (low - F.col("base") + 1).cast("int"), (high - low).cast("int")).alias("piece"))
        own = slices.groupBy("prot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"]), "").alias("letters"))
    return p.select("prot_id", "seq").join(own, "prot_id", "left").select("prot_id", "seq", "letters").mapInArrow(filled, f"prot_id {kind}, seq string")


def group_name(group: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in group])) if group else F.lit("")


def own_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """model, place, letters from (prot_id, seq, model, wanted): the residues of the protein in keyed order, cut at each place."""
    for batch in batches:
        rows = []
        for ident, seq, model, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            keys, letters, _ = residue_keys(model, [ident], [seq])
            k = keys.copy().view(">u8")
            text = letters[np.lexsort((k[:, 1], k[:, 0]))].tobytes().decode()
            rows += [(model, w["place"], text[w["before"] : w["before"] + w["n"]]) for w in wanted]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["model", "place", "letters"])


def letters_at(prots: DataFrame, places: DataFrame, group: tuple[str, ...], equal: bool = False, per_cell: int = 2_000, most_cells: int = 1 << 17) -> DataFrame:
    """model, place, letters: what ``permuted`` (with the model's name as seed) puts at some places of the corpus: places has
    model, place, prot_id, before, n (free residues of the protein before the place and at it), ``prots`` ids that aren't null.

    Nothing is shuffled but what is asked for.  In a protein's own shuffle only the sampled proteins are put in order.  In
    those of larger groups the residues are counted by range of the key, which says in which ranges the wanted ranks lie;
    only those ranges' residues are packed and put in order.  Keys are made twice instead of being kept.  The chosen
    ranges, at most a few for each place, pass the driver."""
    if group == ("prot_id",) and not equal:
        wanted = places.groupBy("model", "prot_id").agg(F.collect_list(F.struct("place", "before", "n")).alias("wanted"))
        rows = prots.select("prot_id", "seq").join(wanted, "prot_id").select(F.col("prot_id").cast("string"), "seq", "model", "wanted")
        return rows.mapInArrow(own_letters, "model string, place long, letters string")
    spark = prots.sparkSession
    p = prots.select("prot_id", group_name(group).alias("g"), "seq", F.length(F.replace("seq", F.lit("X"))).cast("long").alias("free"))
    slim = settle(p.drop("seq").filter("free > 0"), "model-places")
    start = running(slim, "prot_id", F.col("free"), "start", ("g",)).select("prot_id", "g", "start")
    places = places.join(start, "prot_id").withColumn("rank", F.col("start") + F.col("before")).select("model", "place", "g", "rank", "n")
    if equal:
        letters = F.substr(F.repeat(F.lit(RESIDUES), (F.col("n") / len(RESIDUES)).cast("int") + 2), ((F.col("rank") + 1) % len(RESIDUES) + 1).cast("int"), F.col("n").cast("int"))
        return places.select("model", "place", letters.alias("letters"))
    places = settle(places.withColumn("g", F.concat_ws(":", "model", "g")), "model-ranks")
    seeds = sorted(r.model for r in places.select("model").distinct().collect())
    totals = slim.groupBy("g").agg(F.least(F.ceil(F.sum("free") / per_cell), F.lit(most_cells)).cast("long").alias("cells"))
    dealt = p.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "g").select(F.col("prot_id").cast("string"), "g", "cells", "seq")
    counts = dealt.mapInArrow(lambda it: cell_counts(it, seeds), "g string, cell long, n long").groupBy("g", "cell").agg(F.sum("n").alias("n"))
    cells = running(settle(counts, "model-counts"), "cell", F.col("n"), "base", ("g",))

    def blocks(first: Column, n: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / per_cell), F.floor((first + n - 1) / per_cell))).alias("block")

    left = settle(places.filter("n > 0").select("*", blocks(F.col("rank"), F.col("n"))).withColumnRenamed("n", "want"), "model-blocks")
    right = cells.select("g", "cell", "base", "n", blocks(F.col("base"), F.col("n")))
    low, high = F.greatest("rank", "base"), F.least(F.col("rank") + F.col("want"), F.col("base") + F.col("n"))
    met = right.join(left, ["g", "block"]).filter((low < high) & (F.col("block") == F.floor(low / per_cell)))
    met = settle(met.select("model", "place", "g", "cell", low.alias("at"), (low - F.col("base") + 1).cast("int").alias("first"), (high - low).cast("int").alias("size")), "model-cells")
    chosen: dict[str, list] = {}
    for r in met.select("g", "cell").distinct().collect():
        chosen.setdefault(r.g, []).append(r.cell)
    want = spark.sparkContext.broadcast({g: np.sort(np.array(c, np.int64)) for g, c in chosen.items()})
    found = dealt.mapInArrow(lambda it: chosen_cells(it, seeds, want.value), "g string, cell long, keys binary, letters binary")
    texts = found.groupBy("g", "cell").applyInArrow(in_order, "g string, cell long, text string, n long")
    slices = texts.join(met, ["g", "cell"]).select("model", "place", "at", F.substr("text", "first", "size").alias("piece"))
    return slices.groupBy("model", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"]), "").alias("letters"))


def pick_one(rows: DataFrame, group: str, ident: str, seed: str) -> DataFrame:
    """One row a group, by keyed order."""
    first = F.min(F.struct(keyed(seed, F.col(ident).cast("string")).alias("k"), F.col(ident).alias("i")))
    return rows.groupBy(group).agg(first.alias("f")).select(group, F.col("f.i").alias(ident))
