"""Small text files on whatever file system a path names, through Hadoop's interface, and the folder that a cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, if that is unset, one of our own."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession):
        self.gateway = spark.sparkContext._gateway
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that mustn't exist yet; False if another writer was first.

        The whole text is written aside and then gets its name in one step that fails if the name is taken, so no reader
        ever sees a part: by a hard link on local disks, by a rename without overwriting elsewhere.
        """
        p, fs = self._path(path)
        if fs.exists(p):
            return False
        aside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(aside.toUri().getPath(), p.toUri().getPath())
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
                keep = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(aside, p, keep)
        except FileExistsError:
            return False
        except Exception:
            if fs.exists(p):
                return False
            raise
        finally:
            fs.delete(aside, False)
        return True

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def listing(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return [name for name in (x.getPath().getName() for x in fs.listStatus(p)) if not name.startswith(".")] if fs.exists(p) else []
