"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

quality          documents that fail the quality rules go
near_duplicates  of each group of similar texts the document with the smallest id stays: SimHash
                 candidates whose five-word shingles have a Jaccard similarity of 0.8 or more
repeated_strings bytes covered by a repeated string of 100 bytes go
benchmark        words inside benchmark windows go
packing          token pieces with their place in sequences of 2048

All but the last return the columns of ``documents``; n_chars follows the text.

Defined results: null and empty texts and those under 50 words go in the first
stage; texts of any length are taken whole; rows that repeat a doc_id and its
text are one document from the second stage on, rows that share only a doc_id
are documents of their own; null ids come last among the ids of a group; an
empty table gives an empty result.  The stages set two settings of the session,
``BATCH``, to bound what goes to Python workers at once; ``run`` sets them back.  Other columns of ``documents`` are carried
along whatever their names, also those of the stages' own results, up to the
last stage, which reads doc_id and text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, packing, quality_rules, simhash, suffix_dedup
from tallyloom.llm.common import delete, free_prefix, named, scratch_path, scratch_scope, table


#: Rows and bytes of an Arrow batch, so that an executor of 3 GB has room for two tasks' batches on both sides whatever the length of texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def _bounded(spark: SparkSession) -> None:
    """Set the session's Arrow batches, which hold for whatever runs after the stage is planned."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def _others(docs: DataFrame, *without: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in without)


def _with_text(rows: DataFrame, docs: DataFrame, prefix: str) -> DataFrame:
    """The columns of docs from rows whose new text is in clean_text after ``prefix``."""
    text = F.col(f"{prefix}clean_text")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else named(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    prefix = free_prefix(docs.columns)
    judged = quality_rules.judge(docs, trusted, keep=_others(docs, "doc_id"), prefix=prefix)
    return judged.filter(F.col(f"{prefix}kept")).select(*map(named, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    groups = simhash.similar_groups(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    p = free_prefix(docs.columns)
    key = [f"{p}text", f"{p}id"]
    stays = groups.groupBy("component").agg(first).select(F.col("first.text_hash").alias(key[0]), F.xxhash64("first.doc_id").alias(key[1]), F.col("first.doc_id").alias(f"{p}stay"))
    # Copies under other ids differ in the key, so that no task gets all of them.
    keyed = docs.withColumn(key[0], F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(key[1], F.xxhash64("doc_id"))
    once = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))
    kept = keyed.join(stays, key).filter(F.col("doc_id").eqNullSafe(F.col(f"{p}stay"))).withColumn(f"{p}no", once)
    return kept.filter(F.col(f"{p}no") == 1).select(*map(named, docs.columns))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    prefix = free_prefix(docs.columns)
    return _with_text(suffix_dedup.dedup(docs, keep=_others(docs, "doc_id", "text", "n_chars"), prefix=prefix), docs, prefix)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    items, prefix = table(spark, sf_dir, "benchmark"), free_prefix(docs.columns)
    found = decontamination.scan(docs, items, keep=_others(docs, "doc_id", "text", "n_chars"), remove_spans=True, prefix=prefix)
    return _with_text(found, docs, prefix)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _bounded(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark", benchmark),
    ("packing", pack),
]

#: Hashed counts and token ids are beyond SQL; a brute-force version in the tests takes its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage has written goes once the next one's rows are stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    settings = {name: spark.conf.get(name, None) for name in BATCH}
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"stage-{name}")
            with scratch_scope(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    finally:
        for name, value in settings.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return docs
