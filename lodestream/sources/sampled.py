"""A stream that draws lines of a file at random, with replacement."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class SampledLines(DataSource):
    """Format ``sampled_lines``: option ``path`` (a file of lines in any file system that pyarrow opens) or ``lines``
    (the lines themselves, newline-separated), ``size`` (drawn each time), ``asks`` (how often) and ``seed``.
    Columns seq, tick, element. A tick can be replayed: it draws the same lines again."""

    @classmethod
    def name(cls) -> str:
        return "sampled_lines"

    def schema(self) -> str:
        return "seq long, tick long, element string"

    def simpleStreamReader(self, schema) -> SampledReader:  # noqa: ANN001, N802
        return SampledReader(self.options)


def file_lines(path: str) -> list[str]:
    """The lines of a file, which is small enough to be drawn from by one process."""
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with files.open_input_stream(inner) as source:
        return source.read().decode("utf-8", "replace").splitlines()


class SampledReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.lines = file_lines(options["path"]) if "path" in options else options.get("lines", "").split("\n")
        self.size, self.asks, self.seed = int(options.get("size", 100)), int(options.get("asks", 10)), int(options.get("seed", 553))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": 0}

    def _tick(self, tick: int) -> list[tuple]:
        draw = random.Random(f"{self.seed}:{tick}")
        return [(tick * self.size + i + 1, tick, draw.choice(self.lines)) for i in range(self.size)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        tick = start["tick"]
        if tick >= self.asks:
            return iter([]), start
        return iter(self._tick(tick)), {"tick": tick + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([row for t in range(start["tick"], end["tick"]) for row in self._tick(t)])


def sampled_stream(spark: SparkSession, lines: list[str] | str, size: int, asks: int, seed: int = 553):
    """A streaming DataFrame (seq, tick, element) of ``asks`` draws of ``size`` lines, given as a list or as a file's path."""
    spark.dataSource.register(SampledLines)
    source = {"path": lines} if isinstance(lines, str) else {"lines": "\n".join(lines)}
    return spark.readStream.format("sampled_lines").options(**source, size=size, asks=asks, seed=seed).load()
