"""The jobs as queries: each is run twice into one new folder; the result is the output after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import panel_screen, track_tiles
from jobs.common import HERE, load_config, read_if_there
from seqloom.plans.durable import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_panel_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    own, config = _folder(spark, "panel-screen"), load_config(panel_screen.Config, HERE / "panel_screen.json")
    for _ in range(2):
        panel_screen.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{own}/out", f"{own}/state", config)
    return read_if_there(spark, f"{own}/out", panel_screen.HITS)


def job2_track_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as lines of a track."""
    own, config = _folder(spark, "track-tiles"), load_config(track_tiles.Config, HERE / "track_tiles.json")
    for _ in range(2):
        track_tiles.run(spark, f"{sf_dir}/events.parquet", f"{own}/out", f"{own}/checkpoint", config)
    shown = track_tiles.tiles_of(spark, f"{own}/out")
    return shown.select("chrom", "tile", "sites", F.round("pct_sum", 3).alias("pct_sum"), F.round("pct_mean", 3).alias("pct_mean"))


QUERIES = {"job1_panel_screen": job1_panel_screen, "job2_track_tiles": job2_track_tiles}

_WORD = 21
ORACLES = {
    "job1_panel_screen": f"""WITH d AS (SELECT doc_id AS record, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id AS item, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item, '+' AS strand, seq FROM b UNION ALL SELECT item, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM b),
p AS (SELECT DISTINCT item, strand, substr(seq, CAST(i AS BIGINT) + 1, {_WORD}) AS kmer FROM (SELECT item, strand, seq, unnest(range(length(seq) - {_WORD - 1})) AS i FROM s WHERE length(seq) >= {_WORD})),
w AS (SELECT record, CAST(i AS BIGINT) AS pos, substr(seq, CAST(i AS BIGINT) + 1, {_WORD}) AS kmer FROM (SELECT record, seq, unnest(range(length(seq) - {_WORD - 1})) AS i FROM d WHERE length(seq) >= {_WORD})),
m AS (SELECT DISTINCT record, item, strand, pos FROM w JOIN p USING (kmer)),
c AS (SELECT *, least({_WORD}, coalesce(lead(pos) OVER (PARTITION BY record, item, strand ORDER BY pos) - pos, {_WORD})) AS own FROM m)
SELECT record, item, strand, count(*) AS matches, CAST(sum(own) AS BIGINT) AS covered, min(pos) AS first_pos, max(pos) AS last_pos, 'start' AS batch FROM c GROUP BY record, item, strand""",
    "job2_track_tiles": """WITH t AS (SELECT event_id AS line_no, 'doc' || user_id AS chrom, (event_id * 31) % 400 AS pos, CAST(least(value, 500.0::DOUBLE) / 5 AS FLOAT) AS v FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL),
s AS (SELECT chrom, pos, arg_max(v, line_no) AS pct FROM t GROUP BY 1, 2)
SELECT chrom, pos // 50 AS tile, count(*) AS sites, round(sum(CAST(pct AS DOUBLE)), 3) AS pct_sum, round(sum(CAST(pct AS DOUBLE)) / count(*), 3) AS pct_mean FROM s WHERE pct >= CAST(10 AS FLOAT) GROUP BY 1, 2""",
}
