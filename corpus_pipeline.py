"""The training-data pipeline: documents pass through STAGES, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes
each result as Parquet in the shared folder and reads it again for the next
stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import bpe, decontaminate, langid, linededup, simhash
from episodica.llm.common import free_name, table, written


def _apart(docs: DataFrame, *results: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, and how to name them again."""
    taken, back = docs, {}
    for c in docs.columns:
        if c.lower() in {r.lower() for r in results}:
            new = free_name(taken, f"{c}_own")
            taken, back = taken.withColumnRenamed(c, new), back | {new: c}
    return taken, back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; where nothing is there to learn from, those with a letter."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    pred, score = free_name(docs, "pred_"), free_name(docs, "score_")
    return langid.predict(docs, model, pred=pred, score=score).filter(F.col(pred) != "und").drop(pred, score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; n_chars follows the text."""
    own, back = _apart(docs, "n_lines", "n_removed")
    found = linededup.dedup(own).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(own.columns).withColumnsRenamed(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, then the least hash of the row.

    Null ids come last. Rows that are equal in every column count once.
    """
    # Ids may repeat, so a row is known by a 128-bit hash of all that it holds.
    a, b = free_name(docs, "row_a"), free_name(docs, "row_b")
    held = [x for c in docs.columns for x in (docs[f"`{c}`"].isNull(), docs[f"`{c}`"])]
    rows = docs.withColumns({a: F.xxhash64(*held), b: F.xxhash64(F.lit(1), *held)})
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(a).alias("a"), F.col(b).alias("b"))
    found = simhash.near_duplicates(rows.select(key.alias("key_"), "text"), "key_").select(F.col("component_id").alias("kept_")).distinct()
    same = (rows[a] == found["kept_.a"]) & (rows[b] == found["kept_.b"])
    return rows.join(found, same, "left_semi").dropDuplicates([a, b]).drop(a, b)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    own, back = _apart(docs, *decontaminate.RESULTS)
    found = decontaminate.contamination(own, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(own.columns).withColumnsRenamed(back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and decoded_sha256 of each text."""
    import public_tokenizers

    chosen = docs.select("doc_id", "lang", "source", "text")
    return bpe.round_trip(chosen, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: Language ID, fingerprints' components and BPE can't be expressed in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
