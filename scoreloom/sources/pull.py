"""A read of JSON endpoints that tries again: a Python data source with one partition for each path and week."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES = 3
#: Seconds before the next try, times the tries so far; seconds that an answer may take.
PAUSE = 2.0
TIMEOUT = 15.0
AGENT = "scoreloom"


def get_json(url: str, tries: int = TRIES, pause: float = PAUSE, timeout: float = TIMEOUT, agent: str = AGENT) -> str:
    """The body of a URL that answers with JSON, tried again after growing pauses; RuntimeError after the last try.

    A refused or slow connection, an error status and a body that is no JSON
    are failures alike.
    """
    if tries < 1:
        raise ValueError("tries must be 1 or more")
    for n in range(1, tries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                body = answer.read().decode("utf-8")
            json.loads(body)
            return body
        except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError) as e:
            failed = e
            if n < tries:
                time.sleep(pause * n)
    raise RuntimeError(f"no JSON after {tries} tries: {url}") from failed


@dataclass
class Endpoint(InputPartition):
    path: str
    week: int | None


class JsonPull(DataSource):
    """``spark.read.format("json_pull")`` with options url, paths and weeks (comma-separated), and tries, pause, timeout, agent.

    A path with ``{week}`` is read once for each week, another once. Rows are
    path, week (null for paths without) and payload, the body as text.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pull"

    def schema(self) -> str:
        return "path string, week int, payload string"

    def reader(self, schema) -> JsonReader:
        return JsonReader(dict(self.options))


class JsonReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"].rstrip("/")
        self.paths = [p.strip() for p in options["paths"].split(",") if p.strip()]
        self.weeks = [int(w) for w in options.get("weeks", "").split(",") if w.strip()]
        self.how = {"tries": int(options.get("tries", TRIES)), "pause": float(options.get("pause", PAUSE)), "timeout": float(options.get("timeout", TIMEOUT)), "agent": options.get("agent", AGENT)}

    def partitions(self) -> list[Endpoint]:
        return [Endpoint(p, w) for p in self.paths for w in (self.weeks if "{week}" in p else [None])]

    def read(self, partition: Endpoint) -> Iterator[tuple]:
        path = partition.path.replace("{week}", str(partition.week))
        yield partition.path, partition.week, get_json(f"{self.url}/{path}", **self.how)


def pull(spark: SparkSession, url: str, paths: list[str], weeks: list[int] | None = None, **options) -> DataFrame:
    """path, week and payload of JSON endpoints; each is asked for by a task of its own, which tries again by itself.

    A read is lazy, so write it (land it) before several queries use it.
    """
    spark.dataSource.register(JsonPull)
    reader = spark.read.format("json_pull").option("url", url).option("paths", ",".join(paths)).option("weeks", ",".join(map(str, weeks or [])))
    return reader.options(**options).load()


def typed(pulled: DataFrame, path: str, schema: str) -> DataFrame:
    """The payloads of one path as columns of a schema, with week; fields that nobody selects aren't parsed, values of another type are null."""
    body = F.from_json("payload", schema).alias("b")
    return pulled.where(F.col("path") == path).select("week", body).select("week", "b.*")
