"""Evidence as a stream: candidates arrive in files, verdicts of the touched entities are kept current."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fusion import date_fusion
from ..operators.keyed_table import KeyedTable

CANDIDATES = "gkey string, url string, domain string, year int, month int, precision string, kind string, score double, context string, is_rera boolean, trusted boolean, origin string, seq long"
#: Batches after which the runs of a bucket are folded.
COMPACT_EVERY = 16


def candidate_table(spark: SparkSession, state: str, buckets: int = 256) -> KeyedTable:
    """All candidates so far, in buckets by entity."""
    return KeyedTable(spark, f"{state}/candidates", ["gkey", "url", "domain", "seq", "year", "month"], ["gkey"], buckets)


def verdict_table(spark: SparkSession, state: str, buckets: int = 256) -> KeyedTable:
    return KeyedTable(spark, f"{state}/verdicts", ["gkey"], buckets=buckets)


def follow_candidates(spark: SparkSession, source: str, state: str, checkpoint: str, today: dt.date, interval: str | None = None, buckets: int = 256) -> StreamingQuery:
    """Fuse new candidate files into the table ``verdict_table``.

    The stream's state is two keyed tables. A batch adds its candidates as a run, reads
    the buckets of the entities it names, fuses these entities over all their candidates and
    adds their verdicts as a run: old candidates of other buckets are not read and nothing is written
    again, until runs are folded every ``COMPACT_EVERY`` batches. Each table keeps the
    stream's last batch with the rows, in one commit, so a batch that is run again, whole or from
    its middle, adds nothing twice. Of candidates repeated with their url, place and date the one of highest score counts.
    """
    candidates, verdicts = candidate_table(spark, state, buckets), verdict_table(spark, state, buckets)

    def batch(rows: DataFrame, n: int) -> None:
        # The stream's id is in its checkpoint: with another checkpoint batches count anew.
        writer = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        candidates.write(rows, F.struct("score", "kind", "context"), writer, n)
        every = candidates.lookup(rows.select("gkey"))
        if every is None or verdicts.write(date_fusion(every, today, dealt=True), None, writer, n) is None:
            return
        if n % COMPACT_EVERY == COMPACT_EVERY - 1:
            for table in (candidates, verdicts):
                table.compact()
                table.vacuum()

    writer = spark.readStream.schema(CANDIDATES).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
