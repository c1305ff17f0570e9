"""Sequences and tracks made from ordinary tables, so that every operator can be queried over them.

Records are texts reduced to their A, C, G and T; a track takes its rows from events: the event is the line, the user
the contig, and the position is a fixed function of the event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.sequence import contigs_of, pieces_of
from seqloom.plans.durable import materialise, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small file over all cores; larger inputs have that many partitions and are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def records(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", prefix: str = "doc", letters: str = "ACGT") -> DataFrame:
    """(ord, id, seq)."""
    keep = f"[^{letters}{letters.lower()}]+"  # runs at once
    seq = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), keep, ""))
    return table(spark, sf_dir, name).select(F.col(key).alias("ord"), F.concat(F.lit(prefix), F.col(key)).alias("id"), seq.alias("seq"))


def documents_sequence(spark: SparkSession, sf_dir: str, letters: str = "ACGT") -> tuple[DataFrame, DataFrame]:
    """(contigs, pieces) of all documents."""
    contigs = contigs_of(records(spark, sf_dir, letters=letters))
    return contigs, pieces_of(contigs)


def stored_sequence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As ``documents_sequence``, with the contigs written, for queries that read them in several branches."""
    contigs = materialise(contigs_of(records(spark, sf_dir)), "contigs")
    return contigs, pieces_of(contigs)


def fasta_lines(spark: SparkSession, sf_dir: str, width: int = 60) -> DataFrame:
    """(split, line_no, line): the documents as lines of a FASTA file, a header, a comment and lines of ``width`` bases
    (in lower case in every other record) for each; 64 documents are a split."""
    seq = F.when(F.col("ord") % 2 == 0, F.lower("seq")).otherwise(F.col("seq"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.length("seq") / width).cast("int")), lambda i: F.substr(seq, i * width + 1, F.lit(width)))
    every = F.concat(F.array(F.concat(F.lit("> "), F.col("id"), F.lit(" of documents")), F.lit("; a comment")), F.filter(parts, lambda p: p != ""), F.array(F.lit("")))
    rows = records(spark, sf_dir).select("ord", F.posexplode(every).alias("i", "line"))
    return rows.select(F.floor(F.col("ord") / 64).alias("split"), (F.col("ord") * (1 << 20) + F.col("i")).alias("line_no"), "line")


def benchmark_sequence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(contigs, pieces) of all benchmark items."""
    contigs = contigs_of(records(spark, sf_dir, "benchmark", "item_id", "item"))
    return contigs, pieces_of(contigs)


def track(spark: SparkSession, sf_dir: str, divisor: float = 5.0) -> DataFrame:
    """(line_no, chrom, start, end, value): values up to 500 are divided: by 5 they are percentages, by 500 fractions, by 1 neither."""
    start = (F.col("event_id") * 31) % 400
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"), F.concat(F.lit("doc"), F.col("user_id")).alias("chrom"), start.alias("start"), (start + 1).alias("end"), (F.least("value", F.lit(500.0)) / divisor).cast("float").alias("value")
    )


def text_files(lines: DataFrame, tag: str, order: list[str]) -> str:
    """Write ``lines.line`` in order to the files of a new folder, whose names are in order too; the folder.  Rows that agree
    in the first column of ``order`` are in one file."""
    path = new_path(lines.sparkSession, tag)
    parts = lines.sparkSession.sparkContext.defaultParallelism
    lines.repartitionByRange(parts, order[0]).sortWithinPartitions(*order).select("line").write.option("lineSep", "\n").text(path)
    return path


def fasta_files(spark: SparkSession, sf_dir: str, width: int = 60) -> str:
    """``fasta_lines`` as a folder of files; a record is in one of them."""
    return text_files(fasta_lines(spark, sf_dir, width), "fasta-files", ["split", "line_no"])


def bed_files(spark: SparkSession, sf_dir: str) -> str:
    """The track as a folder of bedMethyl files, sorted by chromosome, position and line."""
    at = "(event_id * 31) % 400"
    line = f"concat('doc', user_id, '\\t', {at}, '\\t', {at} + 1, '\\tm\\t0\\t+\\ts\\te\\t255,0,0\\t8\\t', value / 5)"
    rows = table(spark, sf_dir, "events").selectExpr("concat('doc', user_id) AS chrom", f"{at} AS start", "event_id", f"{line} AS line")
    return text_files(rows, "bed-files", ["chrom", "start", "event_id"])
