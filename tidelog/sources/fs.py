"""Small files on any file system Spark can reach, through the driver's JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark._jvm
        self.base = base.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, rel: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{rel}" if rel else self.base)

    def uri(self, rel: str) -> str:
        return f"{self.base}/{rel}"

    def list(self, rel: str) -> list[str]:
        p = self._path(rel)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, rel: str) -> bool:
        return self.fs.exists(self._path(rel))

    def read(self, rel: str) -> str:
        s = self.fs.open(self._path(rel))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def create(self, rel: str, text: str) -> bool:
        """Write a whole file under a fresh name, then publish it; False if the name was taken. Of two writers one wins:
        HDFS renames to no name that exists, and a local rename, which would, is a hard link instead."""
        import uuid

        from py4j.protocol import Py4JJavaError

        part = self._path(f"{rel}.{uuid.uuid4().hex}.tmp")
        s = self.fs.create(part, False)
        s.write(bytearray(text.encode()))
        s.close()
        if self.fs.getUri().getScheme() == "file":
            local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                self.jvm.java.nio.file.Files.createLink(local(self._path(rel)), local(part))
                won = True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                won = False
            self.fs.delete(part, False)
            return won
        if self.exists(rel) or not self.fs.rename(part, self._path(rel)):
            self.fs.delete(part, False)
            return False
        return True

    def delete(self, rel: str) -> bool:
        return self.fs.delete(self._path(rel), True)
