"""Incremental indexing of a stream: each micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trawlspark.operators.index import SearchIndex


class IndexWriter:
    """Adds micro-batches of collection(docno, raw, ...) to an index; `index` is the latest commit."""

    def __init__(self, index: SearchIndex | None, path: str, stemmer: str = "light"):
        self.index, self.path, self.stemmer, self.commits = index, path, stemmer, 0

    def add(self, batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        where = f"{self.path}/commit-{epoch}"  # a batch that runs again writes the same place
        if self.index is None:
            self.index = SearchIndex.build(batch, self.stemmer, path=where)
        else:
            self.index = self.index.add(batch, where)
        self.commits += 1

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
