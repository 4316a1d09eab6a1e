"""The registry of null models, and the evaluation of pairs of fragments under a set of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators import alignment, nullmodels, sampling
from residua.operators.kmers import windows
from residua.sinks.scratch import settle, tidied
from residua.sinks.tables import merge_counts
from residua.sources.corpus import starts
from residua.sources.layers import Layers

# The sets of models that are run together, and the block lengths of the k-mer models.
BLOCKS = (1, 2, 3, 4, 5, 10, 20)
FLAVOURS = {
    1: ("natural", "G0", "P0", "D", "T0", "A0"),
    2: ("T1", "T2", "T3", "T4", "A1", "A2", "A3", "A4"),
    3: ("E0", "F", "D", *(f"k{k}" for k in BLOCKS)),
    4: ("P1", "P2", "P3", "P4", "G1", "G2", "G3", "G4"),
}
GROUPS = {"P": ("prot_id",), "G": ("org",), "A": (), "E": ()}


def chain(prots: DataFrame) -> Callable[[Column, Column, str, int], Column]:
    """A first-order chain with the corpus' dipeptide counts (400 at most): a function that draws by key, after a first
    residue, fragments of a length."""
    counts = windows(prots, 2, ("prot_id",), True).groupBy("frag").agg(F.count(F.lit(1)).alias("n")).collect()
    after: dict[str, dict[str, int]] = {}
    for r in counts:
        after.setdefault(r.frag[0], {})[r.frag[1]] = r.n
    if not after:
        return lambda first, ident, seed, length: F.repeat(first, length)
    steps = []
    for a, nexts in sorted(after.items()):
        total, sofar, bounds = sum(nexts.values()), 0, []
        for b, n in sorted(nexts.items()):
            sofar += n
            bounds.append(F.struct(F.lit(b).alias("b"), F.lit(sofar / total).alias("upto")))
        steps += [F.lit(a), F.array(*bounds)]
    table, least = F.create_map(*steps), min(after)

    def draw(first: Column, ident: Column, seed: str, length: int) -> Column:
        known = lambda c: F.when(c.isin(*after), c).otherwise(F.lit(least))

        def step(text: Column, i: Column) -> Column:
            u = F.conv(F.substring(sampling.keyed(seed, ident.cast("string"), i.cast("string")), 1, 8), 16, 10).cast("long") / float(1 << 32)
            found = F.filter(table[known(F.substr(text, F.lit(-1), F.lit(1)))], lambda x: x["upto"] > u)
            return F.concat(text, F.coalesce(F.get(found, F.lit(0))["b"], F.lit(least)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(length - 1)), known(first), step) if length > 1 else known(first)

    return draw


def group_pairs(spark: SparkSession, prots: DataFrame, models: tuple[str, ...], lf: int, n: int, seed: int = 0) -> DataFrame:
    """model, pair_id, frag1, frag2 under models P, G, A or E, whose number moves the sample: a shuffle keeps lengths, so
    the places are drawn first, and only what a model puts there is made (``nullmodels.letters_at``)."""
    base, drawn = prots.filter("prot_id is not null"), None
    for k in sorted({int(m[1:]) for m in models}):
        p = settle(sampling.pairs(spark, base, lf, n, seed + k).select("pair_id", F.inline(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"{s}_prot").alias("prot_id"), F.col(f"{s}_pos").alias("pos"), F.col(f"{s}_frag").alias("frag")) for i, s in enumerate("ab")]))), "model-pairs")
        own = p.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models if int(m[1:]) == k])))
        drawn = own if drawn is None else drawn.unionByName(own)
    free = lambda c: F.length(F.replace(c, F.lit("X"))).cast("long")
    rows = base.select("prot_id", "seq").join(drawn, "prot_id").select("model", (2 * F.col("pair_id") + F.col("side")).alias("place"), "prot_id", "frag", free(F.substr("seq", F.lit(1), F.col("pos") - 1)).alias("before"), free(F.col("frag")).alias("n"))
    rows, letters = settle(rows, "model-drawn"), None
    for kind in sorted({m[0] for m in models}):
        own = nullmodels.letters_at(base, rows.filter(F.substr("model", F.lit(1), F.lit(1)) == kind).drop("frag"), GROUPS[kind], kind == "E")
        letters = own if letters is None else letters.unionByName(own)
    made = rows.select("model", "place", "frag").join(letters, ["model", "place"], "left").mapInArrow(nullmodels.filled, "model string, place long, frag string")
    side = lambda i: F.max(F.when(F.col("place") % 2 == i, F.col("frag")))
    return made.groupBy("model", F.floor(F.col("place") / 2).alias("pair_id")).agg(side(0).alias("frag1"), side(1).alias("frag2"))


def local_pairs(spark: SparkSession, prots: DataFrame, models: tuple[str, ...], lf: int, size: int, n: int, seed: int = 0) -> DataFrame:
    """model, pair_id, frag1, frag2 under models that need no more than a pair, its domains or the corpus' dipeptides."""
    p = sampling.pairs(spark, prots, lf, n, seed).select("pair_id", "a_prot", "a_pos", "a_frag", "b_prot", "b_pos", "b_frag")
    p, draw, around, out = settle(p, "model-pairs"), None, None, None
    if any(m[0] == "T" for m in models):
        draw = chain(prots)
    if any(m[0] in "Dk" for m in models):
        around = p
        for side in "ab":
            own = prots.select(F.col("prot_id").alias(f"{side}_prot"), "seq", "len")
            around = own.join(around, f"{side}_prot").withColumn(f"{side}_dom", sampling.domain(F.col("seq"), F.col("len"), F.col(f"{side}_pos"), size, lf)[1]).drop("seq", "len")
            around = settle(around, "model-domains")
        around = around.filter("a_dom is not null and b_dom is not null")
    for model in models:
        kind, rows, one, two = model[0], p, F.col("a_frag"), F.col("b_frag")
        if kind == "F":
            one, two = nullmodels.shuffled(one, F.col("pair_id"), "F1"), nullmodels.shuffled(two, F.col("pair_id"), "F2")
        elif kind == "T":
            one, two = (draw(F.substr(c, F.lit(1), F.lit(1)), F.col("pair_id"), f"{model}:{s}", lf) for s, c in enumerate((one, two)))
        elif kind in "Dk":
            rows = around
            made = (lambda f, d, s: nullmodels.domain_shuffled(f, d, F.col("pair_id"), s)) if kind == "D" else (lambda f, d, s, m=model: nullmodels.block_shuffled(f, d, F.col("pair_id"), s, int(m[1:]), size))
            one, two = made(one, F.col("a_dom"), f"{model}1"), made(two, F.col("b_dom"), f"{model}2")
        own = rows.select(F.lit(model).alias("model"), "pair_id", one.alias("frag1"), two.alias("frag2"))
        out = own if out is None else out.unionByName(own)
    return out


def pairs_of(spark: SparkSession, prots: DataFrame, models: tuple[str, ...], lf: int, size: int, n: int, seed: int = 0) -> DataFrame:
    """model, pair_id, frag1, frag2 of sampled pairs under each model; size: residues of the domain around a fragment (a
    fragment in a shorter protein is left out by the models that use it)."""
    prots = settle(starts(prots.select("prot_id", "org", "seq", "len")), "model-proteins")  # read by every model
    groups, others = tuple(m for m in models if m[0] in GROUPS), tuple(m for m in models if m[0] not in GROUPS)
    out = local_pairs(spark, prots, others, lf, size, n, seed) if others else None
    if groups:
        own = group_pairs(spark, prots, groups, lf, n, seed)
        out = own if out is None else out.unionByName(own)
    return out


def model_pairs(spark: SparkSession, prots: DataFrame, model: str, lf: int, size: int, n: int, seed: int = 0) -> DataFrame:
    """pair_id, frag1, frag2 of sampled pairs under a model."""
    return pairs_of(spark, prots, (model,), lf, size, n, seed).drop("model")


@tidied
def evaluate(spark: SparkSession, prots: DataFrame, models: tuple[str, ...], lf: int, size: int, n: int, seed: int = 0) -> DataFrame:
    """alignment, model, score, count: histograms of the 14 scores under each model."""
    out = settle(pairs_of(spark, prots, models, lf, size, n, seed).drop("pair_id"), "model-fragments")
    return alignment.score_histogram(alignment.score_pairs(out), ("model",))


def evaluate_rounds(spark: SparkSession, prots: DataFrame, models: tuple[str, ...], lf: int, size: int, n: int, rounds: int, path: str) -> DataFrame:
    """alignment, model, score, count over ``rounds`` rounds of ``n`` pairs each, from the histograms stored under ``path``.

    A round is a block of pairs of its own (its number is the sample's seed).  One whose histogram is stored to its end is
    taken as it is, any other is made and stored, so that a run that was ended goes on and more rounds may follow later."""
    stored = Layers(spark, path)
    found = [stored.layer("round", lambda r=r: evaluate(spark, prots, models, lf, size, n, r), r) for r in range(rounds)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return merge_counts(None, out, ("alignment", "model", "score"))
