"""Screen new sequences against a panel: which panel items share exact words with each record, on which strand, and how
many of the record's bases those words cover.

    python -m jobs.panel_screen --records DIR --panel DIR --out DIR --state DIR [--config FILE] [--master local[8]]

The job is incremental.  Its high-water mark is the largest record id that a finished run has screened; a run takes the
records above it, up to the largest id there is when it starts, and writes their hits as one partition, ``batch`` =
the mark before.  The mark is raised after the hits are written, so a run that died is repeated in full into the
same partition, and a run without new records writes nothing.  Records are expected to arrive with rising ids; rows
without an id can't be told from screened ones and are only counted in the log.  A run's panel applies to its records.

Words are matched within records, never across two.  A frequent panel word doesn't gather its matches in one task: the
panel's words are broadcast up to a counted bound, beyond it copied over salts (``durable.join_small``); hits are counted
by partial aggregates, and coverage is made within blocks of a record, whose ends alone are put in order by record.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line, load_config, overwrite_parts, read_if_there, session
from seqloom.errors import ConfigError
from seqloom.functions.bases import reverse_complement
from seqloom.operators.sequence import record_words
from seqloom.plans.durable import join_small, materialise, scratch

log = logging.getLogger("jobs.panel_screen")

HITS = "record long, item long, strand string, matches long, covered long, first_pos long, last_pos long, batch string"
MARKS = "high long, records long, batch string"
#: Positions of a record that are put in order together.
SPAN = 4096
#: Name of the partition of the first run, which has no mark.
FIRST = "start"


@dataclass(frozen=True)
class Config:
    record_id: str = "doc_id"
    record_text: str = "text"
    panel_id: str = "item_id"
    panel_text: str = "text"
    word_length: int = 21
    both_strands: bool = True
    min_matches: int = 1


def bases_of(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seq): texts reduced to their A, C, G and T, in upper case."""
    return table.select(F.col(id_col).cast("long").alias("id"), F.upper(F.regexp_replace(F.coalesce(text_col, F.lit("")), "[^ACGTacgt]", "")).alias("seq"))


def panel_words(panel: DataFrame, config: Config) -> DataFrame:
    """(kmer, item, strand), each once."""
    plus = panel.select(F.col("id").alias("item"), "seq", F.lit("+").alias("strand"))
    sides = plus.unionByName(plus.select("item", reverse_complement(F.col("seq")).alias("seq"), F.lit("-").alias("strand"))) if config.both_strands else plus
    keyed = sides.where("item IS NOT NULL").select(F.struct("item", "strand").alias("own"), "seq")
    return record_words(keyed, config.word_length, "own").select("kmer", "own.item", "own.strand").distinct()


def hits_of(records: DataFrame, panel: DataFrame, config: Config) -> DataFrame:
    """(record, item, strand, matches, covered, first_pos, last_pos) of records (id, seq) and a panel's written words."""
    k, keys = config.word_length, ["record", "item", "strand"]
    words = record_words(records, k, "id").withColumnRenamed("id", "record")
    met = join_small(words, panel, ["kmer"], F.col("pos"), "inner").select(*keys, "pos").distinct()
    placed = met.withColumn("span", F.floor(F.col("pos") / SPAN))
    inside = Window.partitionBy(*keys, "span").orderBy("pos")
    steps = placed.withColumn("next", F.lead("pos").over(inside))
    spans = steps.groupBy(*keys, "span").agg(F.count("*").alias("matches"), F.sum(F.when(F.col("next").isNotNull(), F.least(F.col("next") - F.col("pos"), F.lit(k)))).alias("bases"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    across = Window.partitionBy(*keys).orderBy("span")  # a row for SPAN positions of a record
    ends = spans.withColumn("end", F.least(F.lead("lo").over(across) - F.col("hi"), F.lit(k)))
    sums = ends.groupBy(*keys).agg(F.sum("matches").alias("matches"), F.sum(F.coalesce("bases", F.lit(0)) + F.col("end")).alias("covered"), F.min("lo").alias("first_pos"), F.max("hi").alias("last_pos"))
    return sums.where(F.col("matches") >= config.min_matches)


def run(spark: SparkSession, records: str, panel: str, out: str, state: str, config: Config | None = None) -> dict[str, int | str | None]:
    """One run over what is new in ``records``; what it read and wrote.  ``out`` holds HITS, ``state`` a mark for each batch."""
    config = config or Config()
    if not 1 <= config.word_length <= 31:
        raise ConfigError("word_length is 1 to 31")
    mark = read_if_there(spark, state, MARKS).agg(F.max("high")).first()[0]
    table = spark.read.parquet(records)
    key = F.col(config.record_id).cast("long")
    new = table if mark is None else table.where(key > mark)
    high, known, unnamed = new.agg(F.max(key), F.count(key), F.count(F.when(key.isNull(), 1))).first()
    batch = FIRST if mark is None else str(mark)
    told = {"batch": batch, "mark": mark, "high": high, "records": known, "without_id": unnamed, "panel_items": 0, "hits": 0}
    if not known:
        log.info("nothing above mark %s in %s", mark, records)
        return told
    with scratch(spark):
        items = bases_of(spark.read.parquet(panel), config.panel_id, config.panel_text)
        words = materialise(panel_words(items, config), "panel-words")
        taken = bases_of(new.where(key <= high), config.record_id, config.record_text)
        found = hits_of(taken, words, config).withColumn("batch", F.lit(batch))
        overwrite_parts(found, out, "batch")
        told["panel_items"] = words.agg(F.count_distinct("item")).first()[0]
    told["hits"] = read_if_there(spark, out, HITS).where(F.col("batch") == batch).count()
    log.info("read %d records of %s (%d without an id left out), %d panel items with words of %s", known, records, unnamed, told["panel_items"], panel)
    overwrite_parts(spark.createDataFrame([(high, known, batch)], MARKS), state, "batch")
    log.info("wrote %d hits to %s, batch %s; mark %s is now %s", told["hits"], out, batch, mark, high)
    return told


def main(argv: list[str] | None = None) -> None:
    given = command_line(__doc__.split("\n\n")[0], "panel_screen.json", ["records", "panel", "out", "state"], argv)
    config = load_config(Config, given.config)
    spark = session("panel_screen", given.master)
    try:
        run(spark, given.records, given.panel, given.out, given.state, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
