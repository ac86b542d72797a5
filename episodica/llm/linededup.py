"""Cross-site boilerplate: lines that stand on many sites.

A line's spread is the number of distinct non-null sites whose documents hold
it. Lines are known by a 64-bit hash. A HyperLogLog sketch of the sites per
line hash is built in partial aggregates and merged; where its estimate is
within BAND standard errors (or two) of the threshold, the distinct sites are
counted exactly. Lines with fewer occurrences than the threshold can't reach
it and are left out before that. The rows of one line are dealt to SALTS parts
by their place, so that no task gets all rows of a frequent one.

Of a line that reaches the threshold the first occurrence stays (smallest
document id, then position), wherever else it stands it goes. Lines are the
parts between line feeds, compared as they are; lines of white space only
never go. Null texts stay null and have no lines; documents with a null id
come after all others; rows that repeat an id and a text are treated alike.
An empty table gives an empty table. A very long text is one row of line hashes
before they are dealt out.
Further columns are kept; those named n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table, written

#: Sites that make a line boilerplate; log2 of the sketch's registers; standard errors.
MIN_SITES, LG_K, BAND = 10, 12, 4
#: Parts that the rows of one line are dealt to.
SALTS = 16


def _hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(~x.rlike(r"^[\x09-\x0D ]*$"), F.xxhash64(x)))


def lines(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(k, t, site, pos, h) of every line but blank ones; t tells apart texts under one id."""
    own = docs.select(col(docs, key).alias("k"), col(docs, text).alias("text"), col(docs, site).alias("site"))
    return own.select("k", F.xxhash64("text").alias("t"), "site", F.posexplode(_hashes(F.col("text"))).alias("pos", "h")).filter("h is not null")


def _salted(df: DataFrame) -> DataFrame:
    """A row for each salt."""
    return df.select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))


def frequent(found: DataFrame, least: int) -> DataFrame:
    """The rows of found whose line occurs `least` times or more, with a salt that spreads each line's rows."""
    often = found.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("h")
    return found.withColumn("salt", F.pmod(F.xxhash64("k", "pos"), F.lit(SALTS)).cast("int")).join(_salted(often), ["h", "salt"])


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h, first) of the lines that reach min_sites; first is their first (id is null, id, position)."""
    own = found.groupBy("h", "salt", "site").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "pos")).alias("first"))
    parts = own.groupBy("h", "salt").agg(F.hll_sketch_agg(F.col("site").cast("string"), lg_k).alias("sketch"), F.min("first").alias("first"))
    spread = parts.groupBy("h").agg(F.hll_union_agg("sketch").alias("sketch"), F.min("first").alias("first"))
    spread = spread.select("h", "first", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("n"))
    band = max(2, round(BAND * 1.04 / 2 ** (lg_k / 2) * min_sites + 0.5))
    near = spread.filter(F.abs(F.col("n") - min_sites) <= band)
    # Lines near the threshold have few sites, so few rows a line are left.
    sites = own.select("h", "site").filter("site is not null").distinct()
    exact = sites.join(near.select("h"), "h").groupBy("h").agg(F.count("*").alias("sites"))
    sure = spread.filter(F.col("n") > min_sites + band).select("h", "first")
    return sure.union(near.join(exact.filter(F.col("sites") >= min_sites), "h").select("h", "first"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs without its boilerplate lines, and n_lines and n_removed."""
    kept = docs.select([col(docs, c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    found = written(frequent(lines(kept, key, text, site), min_sites))
    gone = found.join(_salted(boilerplate(found, min_sites)), ["h", "salt"]).filter(~(F.col("k").eqNullSafe(F.col("first.k")) & (F.col("pos") == F.col("first.pos"))))
    gone = gone.groupBy("k", "t").agg(F.collect_set("pos").alias("gone_")).withColumnsRenamed({"k": "k_", "t": "t_"})
    own = col(kept, text)
    joined = kept.join(gone, col(kept, key).eqNullSafe(gone["k_"]) & (F.xxhash64(own) == gone["t_"]), "left")
    parts = F.split(own, "\n", -1)
    places = gone["gone_"]  # by frame: docs may have a column of any name
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), places)
    short = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    columns = [F.when(places.isNull(), own).otherwise(short).alias(c) if c == text else col(kept, c) for c in kept.columns]
    return joined.select(*columns, F.when(own.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("bigint").alias("n_lines"), F.when(places.isNull(), F.lit(0)).otherwise(F.size(places)).cast("bigint").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (null: empty)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = f"""
with l as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents),
b as (
  select line, min(struct_pack(d := doc_id, p := pos)) as first from l
  where not regexp_full_match(line, '[\\x09-\\x0D ]*')
  group by line having count(distinct source) >= {MIN_SITES}),
m as (
  select l.*, b.line is not null and not (l.doc_id = b.first.d and l.pos = b.first.p) as gone
  from l left join b on l.line = b.line),
k as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
    coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept
  from m group by doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from documents as d left join k on d.doc_id = k.doc_id
"""
