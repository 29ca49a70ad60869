"""Versions of source files: what was read is checked before it is read again."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .dataset import Dataset


class SourceChangedError(RuntimeError):
    """A source file is not the one that was loaded; what was computed from it may not fit."""


@dataclass(frozen=True)
class Manifest:
    """Size and time of each file of a source, as its store tells them."""

    files: tuple[tuple[str, int, int], ...]

    @classmethod
    def of(cls, df: DataFrame) -> Manifest:
        """Of the files that a DataFrame reads."""
        return cls.of_paths(df.sparkSession, sorted(df.inputFiles()))

    @classmethod
    def of_paths(cls, spark: SparkSession, paths: list[str]) -> Manifest:
        """Of files, or of all files under folders."""
        conf, out = spark._jsc.hadoopConfiguration(), []
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            files = path.getFileSystem(conf)
            try:
                status = files.getFileStatus(path)
            except Exception as e:  # the store says so in its own words
                raise SourceChangedError(f"{name} is no longer there. Load the source again.") from e
            if not status.isDirectory():
                out.append((name, status.getLen(), status.getModificationTime()))
                continue
            found = files.listFiles(path, True)
            while found.hasNext():
                f = found.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return cls(tuple(sorted(out)))

    def check(self, spark: SparkSession, paths: list[str] | None = None) -> None:
        """An error if a file changed or went; with the source's own paths, also if one came."""
        now = Manifest.of_paths(spark, paths or [f for f, _, _ in self.files])
        if now != self:
            odd = sorted({f for f, *_ in set(now.files) ^ set(self.files)})
            raise SourceChangedError(f"{odd[0]} changed after it was loaded. Load the source again; profiles and findings follow from what it was.")


@dataclass
class Session:
    path: str
    dataset: Dataset
    manifest: Manifest


class Sessions:
    """A few loaded sources by path. One whose files changed is dropped and never read half old, half new.

    ``load`` makes a dataset of a path. Of more than ``most`` sources the least recently used goes.
    """

    def __init__(self, spark: SparkSession, load: Callable[[str], Dataset], most: int = 3):
        self.spark, self.load, self.most = spark, load, most
        self.held: OrderedDict[str, Session] = OrderedDict()

    def open(self, path: str, reload: bool = False) -> Dataset:
        """The dataset of a path, loaded once. If its files changed: an error, or with ``reload`` the new version."""
        if path in self.held:
            try:
                self.held[path].manifest.check(self.spark, [path])
                self.held.move_to_end(path)
                return self.held[path].dataset
            except SourceChangedError:
                self.held.pop(path).dataset.df.unpersist()
                self.spark.catalog.refreshByPath(path)
                if not reload:
                    raise
        dataset = self.load(path)
        dataset.version = Manifest.of_paths(self.spark, [path])
        dataset.paths = [path]
        self.held[path] = Session(path, dataset, dataset.version)
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1].dataset.df.unpersist()
        return dataset


def check_source(ds: Dataset) -> None:
    """Before a source is read again: that its files are those that were loaded. A dataset without a version is taken as it is."""
    if ds.version is not None:
        ds.version.check(ds.df.sparkSession, ds.paths or None)
