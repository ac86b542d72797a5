"""Personal data: patterns, and terms that give protected entities away.

Base: e-mail and IP addresses, card and phone numbers, leftmost without
overlap for each kind; matches that fail their kind's test are dropped.

Method: the base values are the protected entities. Terms are words of three or
more letters, of two if they are capitalised or of a script without case,
lowered; words inside base values don't count. A term co-occurs with an entity
in every document that holds both, wherever they stand. Over the whole corpus,
a term discloses an entity if P(entity | term), estimated as documents with
both over documents with the term, is MIN_SHARE or more, their pointwise mutual
information is MIN_RELATIVE or more of -log2 P(entity), which is all that a
term can tell, the divergence of P(entity | term) from P(entity) over the
term's documents is MIN_EVIDENCE bits or more, and the pair is met in
MIN_CONTEXTS different contexts (REACH characters around the entity and
NEIGHBOURS words around the term), so
that copies of one text alone are no evidence. All occurrences of such terms
become spans, in every document. In the sanitised text base spans and terms
become placeholders of their kind; terms that are as good as the entity
(MIN_REMOVED or more) go without one.

Everything is built from SQL functions. Positions count code points; a span's
end is exclusive. A null text is empty. Rows that repeat an id and a text are
treated alike, an entity in them counts for each row. Further columns are kept;
those named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free_name, table, text_or_empty, written

REACH, NEIGHBOURS, MIN_CONTEXTS = 60, 4, 3
MIN_SHARE, MIN_REMOVED = 0.5, 0.9
#: Three documents with both and 6 bits each, a share of MIN_SHARE, give 15 bits; a frequent entity reaches them with more documents.
MIN_RELATIVE, MIN_EVIDENCE = 0.5, 15.0
_BREAK, _TERM, _NAMED = r"[^\p{L}\p{N}]+", r"^\p{L}{2,}$", r"^(?:\p{L}{3,}|\p{Lo}{2}|\p{Lu}\p{L})$"
#: As in the contract; possessive and anchored so that no text makes them backtrack far.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
_BLOCK = 256


def _luhn(digits: Column) -> Column:
    """The sum of the digits, every second one from the right doubled, is a multiple of 10."""
    one = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).try_cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(one(i))).otherwise(one(i)))
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _tested(kind: str):
    return lambda s: valid(kind, s["value"])


def _sums(x: Column, start: Column) -> Column:
    """start, start + x[0], ...: the sums before each element."""
    state = F.struct(start.cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(x, state, lambda a, v: F.struct((a["s"] + v).alias("s"), F.array_append(a["out"], a["s"]).alias("out")), lambda a: a["out"])


def before(x: Column) -> Column:
    """The sums before each element of an array of bigint, block by block."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / _BLOCK).cast("int") - 1), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)))
    total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, v: s + v))
    joined = F.arrays_zip(blocks.alias("b"), _sums(total, F.lit(0)).alias("s"))
    return F.when(F.size(x) > 0, F.flatten(F.transform(joined, lambda z: _sums(z["b"], z["s"])))).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """array<struct<kind, start, end, value>> of the pattern's matches in text."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    # What lies before each match, and the match, give its place.
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    step = F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    placed = F.arrays_zip(found.alias("m"), gaps.alias("g"), before(step).alias("s"))
    span = lambda z: F.struct(F.lit(kind).alias("kind"), (z["s"] + F.length(z["g"])).cast("bigint").alias("start"), (z["s"] + F.length(z["g"]) + F.length(z["m"])).cast("bigint").alias("end"), z["m"].alias("value"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,value:string>>")
    return F.when(F.size(found) > 0, F.transform(placed, span)).otherwise(none)


def base_spans(text: Column) -> Column:
    """The base kinds' spans, by kind as listed, then start."""
    found = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = F.filter(matches(text, F.lit(pattern), n), _tested(kind))
        hint = {"email": "@", "phone": "+", "ip": "."}.get(kind)
        none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,value:string>>")
        found.append(F.when(F.contains(text, F.lit(hint)), spans).otherwise(none) if hint else spans)
    return F.concat(*found)


def terms_of(text: Column) -> Column:
    """The distinct words of a text that may be terms, whatever their case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _BREAK), lambda w: w.rlike(_TERM)))


def _named(words: Column) -> Column:
    """array<struct<term, c>> of the terms among a text's words, a stored column; c is a hash of the words around."""
    around = lambda i: F.slice(words, F.greatest(i - NEIGHBOURS + 1, F.lit(1)), F.lit(2 * NEIGHBOURS + 1))
    placed = F.transform(words, lambda w, i: F.when(w.rlike(_NAMED), F.struct(F.lower(w).alias("term"), F.xxhash64(F.lower(F.array_join(around(i), " "))).alias("c"))))
    return F.filter(placed, lambda s: s.isNotNull())


def _entities(text: Column, spans: Column) -> Column:
    """array<struct<e, c>> of each base span in order of e; c is a hash of what stands around."""

    def one(s):
        first = F.greatest(s["start"] - REACH, F.lit(0))
        # A word that the reach cuts through is left out.
        left = F.regexp_replace(F.substring(text, (first + 1).cast("int"), (s["start"] - first).cast("int")), r"^[\p{L}\p{N}]+", "")
        right = F.regexp_replace(F.substring(text, (s["end"] + 1).cast("int"), F.lit(REACH)), r"[\p{L}\p{N}]+$", "")
        return F.struct(F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"])).alias("e"), F.xxhash64(left, right).alias("c"))

    return F.array_sort(F.transform(spans, one))


def disclosing(found: DataFrame) -> DataFrame:
    """(term, share): terms that disclose an entity, from rows (k, t, text, base)."""
    n = F.lit(float(found.agg(F.count("*").alias("n")).first().n))
    spans = F.transform("base", lambda s: s.withField("share", F.lit(None).cast("double")))
    outside = F.when(F.size("base") > 0, sanitised(F.col("text"), spans, " ")).otherwise(F.col("text"))
    near = found.filter(F.size("base") > 0).select(outside.alias("text"), _entities(F.col("text"), F.col("base")).alias("all"))
    near = near.select("text", F.filter("all", lambda s, i: (i == 0) | (F.get("all", i - 1)["e"] != s["e"])).alias("es"))
    near = written(near.withColumn("row", F.monotonically_increasing_id()))
    links = near.select("row", F.inline("es"))
    # One in fewer documents has no terms.
    entities = links.groupBy("e").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= MIN_CONTEXTS)
    links = links.join(entities, "e").groupBy("row").agg(F.collect_list(F.struct("e", "c", "n_e")).alias("es"))
    # Words are stored, since a function of an element that refers to them would split the text for each one.
    held = written(near.select("row", F.split("text", _BREAK).alias("words")).join(links, "row"))
    # Counted by entity and term before anything is joined, so that a frequent entity is no large group.
    terms = held.select("es", F.explode(F.array_distinct(F.transform(F.filter("words", lambda w: w.rlike(_NAMED)), F.lower))).alias("term"))
    pairs = terms.select("term", F.inline("es")).groupBy("e", "n_e", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= MIN_CONTEXTS)
    # Document frequencies are counted over all words of all documents, by hash.
    words = found.select(F.explode(F.transform(terms_of(outside), lambda w: F.xxhash64(w))).alias("h"))
    counts = words.groupBy("h").agg(F.count("*").alias("n_t")).filter(F.col("n_t") >= MIN_CONTEXTS)
    scored = pairs.withColumn("h", F.xxhash64("term")).join(counts, "h")
    share, p = F.col("n_both") / F.col("n_t"), F.col("n_e") / n
    bits = F.log2(share / p)
    evidence = F.col("n_both") * bits + F.when(share < 1, (F.col("n_t") - F.col("n_both")) * F.log2((1 - share) / (1 - p))).otherwise(F.lit(0.0))
    scored = scored.filter((share >= MIN_SHARE) & (bits >= -MIN_RELATIVE * F.log2(p)) & (evidence >= MIN_EVIDENCE))
    scored = written(scored.select("e", "term", share.alias("share")))
    met = held.select("row", F.transform("es", lambda s: s.dropFields("n_e")).alias("es"), F.explode(_named(F.col("words"))).alias("w")).join(scored.select("term").distinct().withColumnRenamed("term", "term_"), F.col("w.term") == F.col("term_"), "left_semi")
    met = met.groupBy("row", "es", F.col("w.term").alias("term")).agg(F.min("w.c").alias("c_t")).select("row", "term", "c_t", F.inline("es"))
    met = met.join(scored, ["e", "term"]).select("e", "term", "share", F.xxhash64("c", "c_t").alias("c")).distinct()
    met = met.groupBy("e", "term", "share").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= MIN_CONTEXTS)
    return met.groupBy("term").agg(F.max("share").alias("share"))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with spans (array of kind, start, end, value, share) and the sanitised text.

    Spans are in order of their kind (KINDS), then start; share is that of
    terms and null for base kinds.
    """
    kept = docs.select([col(docs, c) for c in docs.columns if c.lower() not in ("spans", "sanitised")])
    own = text_or_empty(col(kept, text))
    found = kept.select(col(kept, key).alias("k"), F.xxhash64(own).alias("t"), own.alias("text")).withColumn("base", base_spans(F.col("text")))
    # A written table, so that the terms are broadcast only if they are small.
    terms = written(disclosing(found)).withColumn("h", F.xxhash64("term"))
    words = found.select("k", "t", F.explode(F.transform(terms_of(F.col("text")), lambda w: F.xxhash64(w))).alias("h"))
    # Names that docs don't have, whatever columns they come with.
    k, t, listed_terms = (free_name(kept, n) for n in ("k_", "t_", "terms_"))
    listed = words.join(terms, "h").select("k", "t", "term", "share").distinct().groupBy("k", "t")
    listed = listed.agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias(listed_terms)).withColumnsRenamed({"k": k, "t": t})
    joined = kept.join(listed, col(kept, key).eqNullSafe(listed[k]) & (F.xxhash64(own) == listed[t]), "left")
    held = F.col(f"`{listed_terms}`")
    # Terms are letters only, so they need no quoting.
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.map_keys(held), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    term = F.when(held.isNotNull(), F.transform(matches(own, pattern, len(PATTERNS)), lambda s: s.withField("share", held[F.lower(s["value"])])))
    base = F.transform(base_spans(own), lambda s: s.withField("share", F.lit(None).cast("double")))
    spans = F.concat(base, F.coalesce(term, F.array().cast("array<struct<kind:int,start:bigint,end:bigint,value:string,share:double>>")))
    joined = joined.withColumn("spans", spans).drop(k, t, listed_terms)
    return joined.withColumn("sanitised", F.when(F.size("spans") > 0, sanitised(own, F.col("spans"))).otherwise(own))


def sanitised(text: Column, spans: Column, mark: str | None = None) -> Column:
    """The text with placeholders, or the mark; of overlapping spans the first one's kind counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["share"].alias("share"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    tag = lambda s: F.lit(mark) if mark else F.when(s["share"] >= MIN_REMOVED, F.lit("")).otherwise(F.get(names, s["kind"]))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(cut(a["at"], s["start"]), tag(s)))).otherwise(a["out"]).alias("out"))
    return F.aggregate(ordered, state, step, lambda a: F.concat(F.array_join(a["out"], ""), cut(a["at"], F.length(text))))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    names = F.array(*map(F.lit, KINDS))
    shown = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda n: F.filter("spans", lambda s: s["kind"] == n)
    counts = [F.size(of(n)).cast("bigint").alias(f"n_{kind}") for n, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(shown(F.filter("spans", lambda s: s["kind"] < len(PATTERNS))), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
