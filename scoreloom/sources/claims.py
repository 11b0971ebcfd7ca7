"""State by versions in a shared folder: of several writers that want to move a key on, one wins.

Each state of a key is a file whose name is its version, and a version is
created only if it isn't there, which the file system decides. A writer reads
the newest version, and creates the next one if its status is the expected
one; whoever comes second finds the file, reads again and sees that the
status has moved.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, version int, status string, detail string"


@dataclass(frozen=True)
class State:
    version: int
    status: str
    detail: str


class Claims:
    """Statuses of keys below a folder that all writers share, on any file system whose renames don't overwrite."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _folder(self, key: str) -> str:
        return f"{self.root}/{hashlib.sha256(key.encode()).hexdigest()}"

    def _create(self, name: str, body: str) -> bool:
        """Whether the file is new; it appears with all its content or not at all."""
        draft = self._path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(body.encode())
        finally:
            out.close()
        try:
            if self.fs.getScheme() == "file":
                # A local rename overwrites; a second link of one name doesn't.
                place = lambda p: self.jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.String, 0))
                self.jvm.java.nio.file.Files.createLink(place(self._path(name)), place(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(draft, self._path(name), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.fs.delete(draft, False)

    def _put(self, key: str, state: State) -> bool:
        body = json.dumps({"key": key, "version": state.version, "status": state.status, "detail": state.detail})
        self.fs.mkdirs(self._path(self._folder(key)))
        return self._create(f"{self._folder(key)}/{state.version:08d}.json", body)

    def state(self, key: str) -> State | None:
        """The newest state of a key, read by its version's name."""
        folder = self._path(self._folder(key))
        if not self.fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(folder))
        if not names:
            return None
        stream = self.fs.open(self._path(f"{self._folder(key)}/{names[-1]}"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        told = json.loads(text)
        return State(told["version"], told["status"], told["detail"])

    def propose(self, key: str, detail: str = "", status: str = "proposed") -> bool:
        """Start a key; False if it has been started."""
        return self._put(key, State(0, status, detail))

    def move(self, key: str, before: str, after: str, detail: str | None = None) -> State | None:
        """The new state if this call moved the key from ``before`` to ``after``, else None; the detail stays unless given."""
        while True:
            now = self.state(key)
            if now is None or now.status != before:
                return None
            new = State(now.version + 1, after, now.detail if detail is None else detail)
            if self._put(key, new):
                return new

    def states(self) -> DataFrame:
        """The newest state of every key."""
        every = self.spark.read.schema(SCHEMA).json(f"{self.root}/*/*.json")
        return every.groupBy("key").agg(F.max_by(F.struct("version", "status", "detail"), "version").alias("s")).select("key", "s.*")
