"""A change feed into a store: files of changes, applied batch by batch."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import CorpusStore, latest_changes

FEED = "repo_id string, path string, op string, content binary, seq long"


def apply_changes(store: CorpusStore, changes: DataFrame, build: bool = True, at_once: int = 8) -> None:
    """Appends a batch of changes (FEED) to the stores' logs, the last one of each path, and builds what they touch,
    `at_once` repositories at a time; each keeps its name, version and links."""
    last = latest_changes(changes).cache()

    def apply(repo_id: str) -> None:
        store._append(repo_id, last.filter(F.col("repo_id") == repo_id).select("path", "op", "content"), True)
        if build:
            meta = store.meta(repo_id)
            store.build(repo_id, meta["repo_name"], meta["version"], meta["org"], meta["branch"], json.dumps(meta["links"]))

    try:
        touched = [r.repo_id for r in last.select("repo_id").distinct().collect()]  # a row for each repository
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(apply, touched))
    finally:
        last.unpersist()


def start_feed(store: CorpusStore, folder: str, checkpoint: str, build: bool = True) -> StreamingQuery:
    """Follows a folder of Parquet files. A batch that is applied again after a failure changes nothing: puts
    and deletes replace what is there."""
    stream = store.spark.readStream.schema(FEED).parquet(folder)
    return stream.writeStream.foreachBatch(lambda df, _: apply_changes(store, df, build)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
