"""Files and folders of the store that Spark reads, whatever it is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Folders:
    """Small text files beside tables, by the file system of their path."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        path, fs = self._at(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def text(self, name: str) -> str:
        path, fs = self._at(name)
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def created(self, name: str, text: str) -> bool:
        """Writes a new file as a whole; False if there is one of that name, which then stays as it is."""
        folder, _, last = name.rpartition("/")
        draft, fs = self._at(f"{folder}/.{last}.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        files = self.jvm.org.apache.hadoop.fs
        option = getattr(files, "Options$Rename")
        options = self.gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            # unlike a plain rename this one never replaces
            files.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.conf).rename(draft, self._at(name)[0], options)
            return True
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False

    def delete(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, True)


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or where a local session has none, its warehouse."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, kept in the shared folder and cut from what made them."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(_shared(rows.sparkSession))
    return rows.checkpoint(eager=True)
