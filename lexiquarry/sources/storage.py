"""Files on whatever storage Spark reads, through its Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.path(*parts)))

    def children(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path(*parts)))) if self.exists(*parts) else []

    def delete(self, *parts: str) -> bool:
        return self._fs.delete(self._path(self.path(*parts)), True)

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self._path(self.path(*parts)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, text: str, *parts: str) -> None:
        """Written beside, then renamed over: readers see the old or the new text."""
        target, beside = self._path(self.path(*parts)), self._path(self.path(*parts) + ".tmp")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        mode = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = mode
        context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(target), options)
