"""A stream of discovered URLs without those seen before: the crawl frontier as a streaming query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from webgrain.config import AuditConfig
from webgrain.functions.urls import bucket, crawl_form
from webgrain.operators.crawl_rules import before_fetching

#: State that outgrows memory is kept on disk; what is kept of a bucket needs this kind of store.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
JUDGED = "url string, bucket string, reason string"


def new_urls(stream: DataFrame, url: str = "url") -> DataFrame:
    """The first row of each URL in crawl form; state is one key for each URL, kept for good, as a frontier must."""
    return stream.withColumn("crawl_key", crawl_form(F.col(url))).where("crawl_key IS NOT NULL").dropDuplicates(["crawl_key"])


class Ceiling(StatefulProcessor):
    """Lets the first `most` URLs of a bucket pass. Its state is how many have passed, a number for each bucket.

    Earlier batches come first, and within one the order is that of the URLs; no more than `most` of a bucket's URLs
    are held while a batch is read, however many it has.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.held.get()[0] if self.held.exists() else 0
        room, kept = self.most - n, None
        for f in rows:
            f = f[["url", "bucket", "reason"]]
            early = f["reason"].notna()
            yield f[early]
            f = f[~early]
            if room > 0:
                f = (f if kept is None else pd.concat([kept, f])).sort_values("url")
                kept, f = f[:room], f[room:]
            yield f.assign(reason="bucket_full")
        if kept is not None and len(kept):
            self.held.update((n + len(kept),))
            yield kept

    def close(self) -> None:
        pass


def judged_urls(stream: DataFrame, config: AuditConfig, url: str = "url") -> DataFrame:
    """(url, bucket, reason) of each URL that is seen for the first time: reason is null for those to fetch, or one of
    configured, archive, too_deep, bucket_full, as a crawl gives them whose levels are the batches.

    URLs seen are state by URL, so spread over all tasks; of a bucket only a number is kept, which one task at a time
    changes. Both outlive a restart from the query's checkpoint. Null and unusable URLs go. The session needs STORE.
    """
    key = F.col("crawl_key")
    first = new_urls(stream, url).select(
        key.alias("url"), F.coalesce(bucket(key), F.lit("")).alias("bucket"), before_fetching(config, key).alias("reason")
    )
    return first.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Ceiling(config.max_urls_per_path), outputStructType=JUDGED, outputMode="append", timeMode="none"
    )


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that is there to a table and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
