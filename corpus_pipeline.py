"""Corpus pipeline: documents -> quality -> line dedup -> SimHash dedup -> decontamination -> packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's docs.  All stages but the last return the columns of documents.  Rows with null ids or texts, repeated rows
and empty tables pass as the stages' operators define it; a stage that drops rows says so.
"""

from pyspark.sql import functions as F

from plumbline.llm import decontaminate, line_dedup, packing, paragraphs, quality, simhash
from plumbline.llm.common import settle
from plumbline.llm.components import components

#: SQL cannot express the classifier, the fingerprints or the token ids; tests hold run() against plain Python.
ORACLE_SQL = None


def _free(docs, name):
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark, docs, sf_dir):
    """Drops the documents that the quality classifier rejects; texts and all columns stay as they are."""
    size = "n_chars" if "n_chars" in docs.columns else None
    fitted = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), size_column=size)
    name = _free(docs, "score_")
    return quality.score(docs, fitted, size_column=size, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_repeated_lines(spark, docs, sf_dir):
    """Deletes later repeats of runs of lines from the texts; every document stays, if need be with an empty text."""
    name = _free(docs, "lines_removed")
    return line_dedup.dedup_lines(docs, removed=name).drop(name).select(*[F.col(f"`{c}`") for c in docs.columns])


def _near_texts(prints, texts):
    """Links (a, b) between hashes of texts that are near: by fingerprint, by word shingles, or by a shared id."""
    by_print = prints.groupBy("fp").agg(F.min("text_hash").alias("rep"))
    by_print = settle(by_print, "classes")
    equal = prints.select("text_hash", "fp").distinct().join(by_print, "fp").select(
        F.col("text_hash").alias("a"), F.col("rep").alias("b"))
    by_id = prints.where("id IS NOT NULL").select("id", "text_hash").distinct()
    least = by_id.groupBy("id").agg(F.min("text_hash").alias("low"), F.count("*").alias("n")).where("n > 1")
    shared = by_id.join(least, "id").select(F.col("text_hash").alias("a"), F.col("low").alias("b"))
    return (equal.unionByName(simhash.near_links(by_print)).unionByName(paragraphs.alike(texts)).unionByName(shared)
            .where("a <> b"))


def keep_one_of_group(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each group of near texts; rows that repeat it are dropped but one.

    Near: SimHash fingerprints within four bits, or a Jaccard similarity of at least 0.8 over distinct five-word
    shingles, or a chain of such.  Of several texts under the smallest id the one with the smallest hash stays.
    A document without an id stays only if no document with an id is in its group, one for each group.
    """
    prints = settle(simhash.fingerprints(docs), "fingerprints")
    texts = docs.select(F.xxhash64("text").alias("rep"), F.col("text").cast("string").alias("line")).where("line IS NOT NULL")
    texts = settle(texts.dropDuplicates(["rep"]), "texts")
    near = components(_near_texts(prints, texts)).select("node", F.col("component").alias("group_"))
    grouped = prints.select("id", "text_hash").distinct().join(near, F.col("text_hash") == F.col("node"), "left")
    order = F.struct(F.col("id").isNull().alias("none_"), F.col("id").alias("id_"), F.col("text_hash").alias("hash_"))
    kept = grouped.groupBy(F.coalesce("group_", "text_hash").alias("group_")).agg(F.min(order).alias("k"))
    kept = kept.select("k.id_", "k.hash_")
    mark = _free(docs, "text_hash")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id_")) & (F.col(mark) == F.col("hash_"))
    stay = docs.withColumn(mark, F.xxhash64("text")).join(kept, same, "left_semi")
    return stay.dropDuplicates(["doc_id", mark]).drop(mark)


def drop_contaminated(spark, docs, sf_dir):
    """Drops the documents that hold a window of a benchmark item."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("hash_"))
    return docs.join(bad, same, "left_anti")


def pack_sequences(spark, docs, sf_dir):
    """Packs what is left into sequences: one row per piece."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_group),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark, sf_dir):
    """Apply all stages to documents, writing each stage's rows to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
