"""Personal data: base patterns, terms that the corpus shows to give a protected entity away, and secrets.

Base spans (email, ip, card, phone) come from one regular expression each.  A text is split by the expression and the
matches are taken from it; the lengths of the pieces, added up, are the places of the matches, so no Python is needed.

Disclosure of a value: an entity is a distinct base value.  For a term t and an entity e that stand in one text, wherever in
it, with n(e,t) documents that hold both, n(e) documents with e, n(t) documents with t and N documents in all (rows of the
corpus, copies included, in all four), the posterior is n(e,t) / n(t) and the information log2(n(e,t) N / (n(e) n(t))).  A
term that stands with e in ``support`` distinct texts (equal texts count once) and reaches ``posterior`` and ``bits``
discloses e; all its occurrences in the corpus are spans of kind term.  Terms are words of three or more letters and digits
with a letter among them (no pairs: in a family of near copies almost every pair of words is the family's own).  Terms of
an email must stand outside of email addresses in those texts; numbers hold no letters.

Disclosure of a class: credentials are all different, so no value of theirs has support.  A value is a run of 16 or more
ASCII letters and digits; it is opaque if it mixes two or more of each.  The entity is the class of opaque values, and
what may reveal it is the word right before a value (up to four other characters between) or the value's first four
characters.  The same posterior and information decide: documents where the cue stands before an opaque value against
documents with the cue, documents whose value with this beginning is opaque against all with such a value, and both
against the share of documents with an opaque value; ``support`` counts distinct values.  Every value, opaque or not, that
follows such a cue or begins so is a span of kind secret.

``sanitised`` puts a general name in place of every span.

Every grouping shuffles narrow rows and counts before it shuffles; the terms to look for are broadcast only below
``max_broadcast_rows`` and joined otherwise.

Defined results: a null text counts as empty; an entity in fewer than ``support`` texts has no terms; texts of any length
are read whole; ids may be of any type; spans that start at one place are ordered by kind as in KINDS, then by end; rows
that repeat are reported each; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.scratch import free_name, settle, tidied

KINDS = ("email", "ip", "card", "phone", "term", "secret")
#: Each pattern as asked for, written so that a long run of its characters is read once: a match may start only where a
#: run starts or where the match before ended, and repeated parts don't give back what they took.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match holds at least.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD, LETTER = r"[\p{L}\p{N}]{3,}+", r"\p{L}"
VALUE = r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+(?![\p{L}\p{N}])"
#: The word before a value, at the end of what stands before it.
CUE = r"([\p{L}\p{N}_]++)[^\p{L}\p{N}_\n]{0,4}$"
CUE_REACH, HEAD = 64, 4


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"))
        .when(kind == "card", F.when(n.between(14, 19), luhn).otherwise(False))
        .otherwise(n.between(10, 15))
    )


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document, written once: doc_id, row_no, text_key, and by kind the matches and the lengths between."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.xxhash64(text).alias("text_key")]
    for kind, pattern in PATTERNS.items():
        hint = text.rlike(HINTS[kind])
        cols += [F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"{kind}_m"), F.when(hint, F.transform(F.split(text, pattern, -1), F.length)).alias(f"{kind}_p")]
    hint = text.rlike("(?<![A-Za-z0-9])[A-Za-z0-9]{16}")
    before = F.transform(F.split(text, VALUE, -1), lambda p: F.struct(F.length(p).alias("gap"), F.lower(F.regexp_extract(F.right(p, F.lit(CUE_REACH)), CUE, 1)).alias("cue")))
    cols += [F.when(hint, F.regexp_extract_all(text, F.lit(VALUE), F.lit(0))).alias("value_m"), F.when(hint, before).alias("value_p")]
    return settle(docs.select(*cols), "pii-matches")


def base_spans(found: DataFrame) -> DataFrame:
    """doc_id, row_no, text_key, kind (place in KINDS), start, end, value: the valid matches."""
    parts = None
    for k, kind in enumerate(PATTERNS):
        at = F.posexplode(F.arrays_zip(F.col(f"{kind}_m").alias("m"), F.col(f"{kind}_p").alias("p"))).alias("pos", "x")
        rows = found.filter(F.size(f"{kind}_m") > 0).select("doc_id", "row_no", "text_key", F.lit(k).alias("kind"), at)
        rows = rows.select("doc_id", "row_no", "text_key", "kind", "pos", F.col("x").getField("m").alias("value"), F.col("x").getField("p").alias("gap"))
        parts = rows if parts is None else parts.unionByName(rows)
    w = Window.partitionBy("row_no", "kind").orderBy("pos")
    n = F.coalesce(F.length("value"), F.lit(0))
    rows = parts.withColumn("end", F.sum(F.col("gap") + n).over(w).cast("long")).withColumn("start", F.col("end") - n)
    named = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return rows.filter(F.col("value").isNotNull()).filter(valid(named, F.col("value"))).select("doc_id", "row_no", "text_key", "kind", "start", "end", "value")


def forms(text: Column) -> Column:
    """The distinct terms of a text as they are written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text in lower case."""
    return F.array_distinct(F.transform(forms(text), F.lower))


def values(found: DataFrame) -> DataFrame:
    """doc_id, row_no, start, end, value, cue, head, opaque: the runs of letters and digits that may be secrets."""
    at = F.posexplode(F.arrays_zip(F.col("value_m").alias("m"), F.col("value_p").alias("p"))).alias("pos", "x")
    rows = found.filter(F.size("value_m") > 0).select("doc_id", "row_no", at).select("doc_id", "row_no", "pos", F.col("x.m").alias("value"), F.col("x.p.gap").alias("gap"), F.col("x.p.cue").alias("cue"))
    end = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(Window.partitionBy("row_no").orderBy("pos")).cast("long")
    rows = rows.withColumn("end", end).filter(F.col("value").isNotNull()).withColumn("start", F.col("end") - F.length("value"))
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    opaque = (digits >= 2) & (F.length("value") - digits >= 2)
    return rows.select("doc_id", "row_no", "start", "end", "value", "cue", F.left("value", F.lit(HEAD)).alias("head"), opaque.alias("opaque"))


def counted(docs: DataFrame, text: Column, wanted: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """term, n_t: the documents that hold each of the wanted terms.  Few terms are met by the documents' before anything
    shuffles; many are joined with the counts of all terms, since a join before counting would hand out common terms by the
    document."""
    held = docs.select(F.explode(terms_of(text)).alias("term"))
    if wanted.count() <= max_broadcast_rows:
        return held.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(wanted, "term")


def co_occurring(spans: DataFrame, docs: DataFrame, text: Column, n_docs: int, support: int, bits: float, max_broadcast_rows: int) -> DataFrame:
    """entity, n_e, term, n_et of the terms that stand with an entity in enough texts (written)."""
    entity = F.concat_ws(":", F.col("kind").cast("string"), F.col("value"))
    holds = spans.select("row_no", "text_key", "kind", entity.alias("entity")).distinct()
    holds = holds.groupBy("entity", "kind", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    often = holds.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    often = often.filter(F.col("n_e") * 2.0**bits <= n_docs * (1 + 1e-9))  # n_et is n_t at most, so no term of others has the bits
    holds = settle(holds.join(often.drop("texts"), "entity"), "pii-holds")
    keys = holds.select("text_key").distinct()
    if keys.count() <= max_broadcast_rows:
        keys = F.broadcast(keys)
    texts = docs.select(F.xxhash64(text).alias("text_key"), text.alias("t")).join(keys, "text_key", "left_semi")
    texts = texts.select("text_key", terms_of(F.col("t")).alias("all"), terms_of(F.regexp_replace("t", PATTERNS["email"], ". ")).alias("outside")).dropDuplicates(["text_key"])
    # every term of a text counts for n_et, those outside of addresses for the support
    outside = F.when(F.col("kind") == KINDS.index("email"), F.col("outside")).otherwise(F.col("all"))
    tagged = F.concat(F.transform("all", lambda w: F.struct(w.alias("term"), F.lit(0).alias("out"))), F.transform(outside, lambda w: F.struct(w.alias("term"), F.lit(1).alias("out"))))
    pairs = holds.join(texts, "text_key").select("entity", "n_e", "copies", F.explode(tagged).alias("x")).select("entity", "n_e", "x.term", "x.out", "copies")
    pairs = pairs.groupBy("entity", "n_e", "term").agg(F.sum(F.when(F.col("out") == 0, F.col("copies")).otherwise(0)).alias("n_et"), F.sum("out").alias("texts"))
    return settle(pairs.filter((F.col("texts") >= support) & F.col("term").rlike(LETTER)).drop("texts"), "pii-pairs")


def features(rows: DataFrame) -> DataFrame:
    """feature, row_no, value, opaque: a row for the cue of each value and one for its beginning."""
    both = F.array(F.struct(F.lit("cue").alias("how"), F.col("cue").alias("what")), F.struct(F.lit("head").alias("how"), F.col("head").alias("what")))
    return rows.select("row_no", "value", "opaque", F.explode(both).alias("f")).select("f.how", "f.what", "row_no", "value", "opaque").filter("what <> ''")


def revealing(rows: DataFrame, support: int) -> DataFrame:
    """how, what, n_et, n_t: cues and beginnings with enough distinct opaque values; n_t is null for cues (written)."""
    each = features(rows)
    by_value = each.filter("opaque").groupBy("how", "what", "value").agg(F.lit(1).alias("one"))
    wide = by_value.groupBy("how", "what").agg(F.count(F.lit(1)).alias("n_values")).filter(F.col("n_values") >= support).drop("n_values")
    wide = settle(wide, "pii-features")
    per_row = each.join(wide, ["how", "what"]).groupBy("how", "what", "row_no").agg(F.max("opaque").alias("opaque"))
    return settle(per_row.groupBy("how", "what").agg(F.count_if("opaque").alias("n_et"), F.count(F.lit(1)).alias("n_all")).select("how", "what", "n_et", F.when(F.col("how") == "head", F.col("n_all")).alias("n_t")), "pii-revealing")


def scored(pairs: DataFrame, n_docs: int, posterior: float, bits: float) -> DataFrame:
    """What reaches both thresholds; pairs has n_et, n_e, n_t."""
    share, information = F.col("n_et") / F.col("n_t"), F.log2(F.col("n_et") * F.lit(float(n_docs)) / (F.col("n_e") * F.col("n_t")))
    return pairs.withColumn("posterior", share).withColumn("bits", information).filter((F.col("posterior") >= posterior) & (F.col("bits") >= bits))


def secret_spans(rows: DataFrame, cues: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """row_no, kind, start, end of the values that a cue or a beginning reveals."""
    small = cues.count() <= max_broadcast_rows
    for how, name in (("cue", "cue"), ("head", "head")):
        own = cues.filter(F.col("how") == how).select(F.col("what").alias(name), F.lit(True).alias(f"by_{how}"))
        rows = rows.join(F.broadcast(own) if small else own, name, "left")
    return rows.filter("by_cue or by_head").select("row_no", F.lit(KINDS.index("secret")).alias("kind"), "start", "end")


def term_spans(docs: DataFrame, found: DataFrame, terms: DataFrame, id_col: str, text_col: str, max_broadcast_rows: int) -> DataFrame:
    """doc_id, row_no, kind, start, end of all occurrences of the terms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("t"))
    terms = terms.select("term").distinct()
    if terms.count() <= max_broadcast_rows:
        terms = F.broadcast(terms)
    having = with_text.select("doc_id", "text_key", F.explode(forms(F.col("t"))).alias("form")).withColumn("term", F.lower("form")).join(terms, "term")
    having = settle(having.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("form")).alias("forms")), "pii-term-docs")
    own = having.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "forms")
    if having.count() <= max_broadcast_rows:
        own = F.broadcast(own)
    rows = with_text.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).dropDuplicates(["doc_id", "text_key"])
    # a text is split at its own terms only, as they are written
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("forms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    at = F.posexplode(F.arrays_zip(F.regexp_extract_all(F.col("t"), pattern, F.lit(0)).alias("m"), F.transform(F.split("t", pattern, -1), F.length).alias("g"))).alias("pos", "x")
    rows = rows.select("doc_id", "text_key", at).select("doc_id", "text_key", "pos", F.col("x").getField("m").alias("m"), F.col("x").getField("g").alias("g"))
    n = F.coalesce(F.length("m"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("g") + n).over(Window.partitionBy("doc_id", "text_key").orderBy("pos")).cast("long")).filter(F.col("m").isNotNull())
    rows = rows.select("doc_id", "text_key", (F.col("end") - F.length("m")).alias("start"), "end")
    ids = found.select("doc_id", "row_no", "text_key")
    return ids.join(rows, ids["doc_id"].eqNullSafe(rows["doc_id"]) & (ids["text_key"] == rows["text_key"])).select(ids["doc_id"], "row_no", F.lit(KINDS.index("term")).alias("kind"), "start", "end")


@tidied
def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, posterior: float = 0.5, bits: float = 4.0, max_broadcast_rows: int = 100_000) -> DataFrame:
    """For every document: doc_id, row_no, text_key, spans (array of start, kind, end by start and kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = matches(docs, id_col, text_col)
    n_docs = found.count()
    base = settle(base_spans(found), "pii-base")
    runs = settle(values(found), "pii-values")
    pairs = co_occurring(base, docs, text, n_docs, support, bits, max_broadcast_rows)
    cues = revealing(runs, support)
    wanted = settle(pairs.select("term").unionByName(cues.filter("how = 'cue'").select(F.col("what").alias("term"))).distinct(), "pii-wanted")
    spans = base.select("row_no", "start", "kind", "end")
    if not wanted.isEmpty() or not cues.isEmpty():
        n_t = settle(counted(docs, text, wanted, max_broadcast_rows), "pii-counts")
        terms = settle(scored(pairs.join(n_t, "term"), n_docs, posterior, bits), "pii-terms")
        n_opaque = runs.filter("opaque").select("row_no").distinct().count()
        by_word = cues.filter("how = 'cue'").drop("n_t").join(n_t.withColumnRenamed("term", "what"), "what").select("how", "what", "n_et", "n_t")
        classes = by_word.unionByName(cues.filter("how = 'head'")).withColumn("n_e", F.lit(n_opaque))
        # a cue of underscores or fewer than three characters is no term of a text, so nothing counts it: it reveals nothing
        classes = settle(scored(classes, n_docs, posterior, bits), "pii-cues")
        if not terms.isEmpty():
            spans = spans.unionByName(term_spans(docs, found, terms, id_col, text_col, max_broadcast_rows).select("row_no", "start", "kind", "end"))
        if not classes.isEmpty():
            spans = spans.unionByName(secret_spans(runs, classes, max_broadcast_rows).select("row_no", "start", "kind", "end"))
    per_doc = spans.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return found.select("doc_id", "row_no", "text_key").join(per_doc, "row_no", "left")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; empty where there is none."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def digest(found: DataFrame, *more: str) -> DataFrame:
    """Counts by kind, the base and all spans as strings, and whether the document holds personal data or a secret (terms
    alone don't count)."""
    count = lambda k: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    own = F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] != KINDS.index("term"))), F.lit(0))
    return found.select("doc_id", *[count(k) for k in range(len(PATTERNS))], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *[count(k) for k in range(len(PATTERNS), len(KINDS))], (own > 0).alias("private"), *more)


def replaced(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str, max_broadcast_rows: int) -> tuple[DataFrame, str, str]:
    """``docs`` joined with their spans, the names of the columns of spans and of the text with general names in it."""
    key, tk, sp, new = (free_name(docs, f"pii_{c}") for c in ("id", "key", "spans", "clean"))
    spans = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("text_key").alias(tk), F.col("spans").alias(sp)).dropDuplicates([key, tk])
    spans = settle(spans, "pii-spans")
    if spans.count() <= max_broadcast_rows:
        spans = F.broadcast(spans)
    rows = docs.join(spans, docs[id_col].eqNullSafe(spans[key]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == spans[tk]), how)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col(text_col), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.element_at(names, s["kind"] + 1))
        return F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(F.array_append(a["out"], piece).alias("out"), s["end"].alias("at")))

    clean = F.aggregate(sp, begin, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text_col), (a["at"] + 1).cast("int"), F.length(text_col))))
    return rows.withColumn(new, clean), sp, new


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 100_000) -> DataFrame:
    """``docs`` with ``[KIND]`` in place of each span; a span that starts inside an earlier one goes with it."""
    rows, sp, new = replaced(docs, found, id_col, text_col, "left", max_broadcast_rows)
    return rows.withColumn(text_col, F.when(F.col(sp).isNull(), F.col(text_col)).otherwise(F.col(new))).select(*docs.columns)


@tidied
def with_sanitised(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 100_000) -> DataFrame:
    """``found`` with sanitised_sha256: of the text with general names in place of its spans; null where there are none."""
    rows, _, new = replaced(docs, found, id_col, text_col, "inner", max_broadcast_rows)
    own = rows.select(F.col(id_col).alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_key"), F.sha2(new, 256).alias("sanitised_sha256")).dropDuplicates(["own_id", "own_key"])
    joined_ = found.join(own, found["doc_id"].eqNullSafe(own["own_id"]) & (found["text_key"] == own["own_key"]), "left")
    return joined_.drop("own_id", "own_key")
