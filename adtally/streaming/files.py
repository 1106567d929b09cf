"""Small files and folders on whatever file system a path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Listing, deleting, and files that appear whole or not at all."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def _at(self, folder: str):
        path = self._spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path, files = self._at(folder)
        return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []

    def delete(self, folder: str) -> None:
        path, files = self._at(folder)
        files.delete(path, True)

    def read(self, name: str) -> str:
        path, files = self._at(name)
        stream = files.open(path)
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, folder: str, name: str, text: str = "") -> bool:
        """Put a new file into a folder; False if there is one of that name.

        It is written under another name and then renamed, so nobody sees a part of it, and of
        two writers one is told that it came too late.
        """
        parent, files = self._at(folder)
        files.mkdirs(parent)
        path = self._spark._jvm.org.apache.hadoop.fs.Path
        hidden, final = path(parent, f"_{name}-{uuid.uuid4().hex}"), path(parent, name)
        stream = files.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not files.exists(final) and files.rename(hidden, final):
            return True
        files.delete(hidden, False)
        return False
