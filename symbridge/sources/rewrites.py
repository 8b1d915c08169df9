"""Source files rewritten as a whole or not at all.

New texts are staged beside the tree by many tasks, a folder each, with the digest of the text that each was made from. When all are staged, every
original is digested again: if one has changed meanwhile, nothing is written. Then each staged file is moved over its original, so that a
file is old or new and never half; a move that is repeated after a loss finds its work done. At the end, or on a failure, the staging folder is
removed. Tasks do all of this (rewrite()): the driver holds neither the files' names nor their states, and its time does not grow with them. A table that is
written to the data source itself is staged by tasks alike, but its commit, which has no tasks, compares and moves.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from symbridge.operators import decisions
from symbridge.operators.components import checkpointed
from symbridge.sources.ordered_files import in_turn, moved, removed

FILES_AT_ONCE = 16
#: Names, or bytes of contents, in a batch.
NAMES_AT_ONCE = 10_000
BYTES_AT_ONCE = 4 << 20


@dataclass
class Staged(WriterCommitMessage):
    """Where a task lists its files: path, staged path and digest of the original."""

    listed: str | None = None


class Rewriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        return store, f"{root}/.staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, staging = self._store()
        own = f"{staging}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        with store.open_output_stream(f"{own}/list", compression=None) as listing:
            for batch in _stage(store, own, iterator):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    listing.write((json.dumps(row) + "\n").encode())
        return Staged(f"{own}/list")

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, staging = self._store()
        lists = [m.listed for m in messages if m is not None]

        try:
            with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
                changed, first = 0, None
                for files in in_turn(store, lists):
                    for f, ok in zip(files, pool.map(lambda f: _digest(store, _path(f[0])) == f[2], files), strict=True):
                        changed, first = changed + (not ok), first if ok else first or f[0]
                _none_changed(changed, first)
                for files in in_turn(store, lists):
                    list(pool.map(lambda f: store.move(f[1], _path(f[0])), files))
        finally:
            removed(store, staging)

    def abort(self, messages: list[Staged | None]) -> None:
        removed(*self._store())


def _stage(store, own: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, staged path, digest) of batches of path, text and digest, whose texts are made files of a task's own folder: files made in one folder wait for each other."""
    number = 0
    for batch in batches:
        paths, texts, digests = batch.columns
        staged = [f"{own}/{number + n}" for n in range(batch.num_rows)]
        number += batch.num_rows
        for at, text in zip(staged, texts.to_pylist(), strict=True):
            with store.open_output_stream(at, compression=None) as out:
                out.write(text.encode())
        yield pa.RecordBatch.from_arrays([paths, pa.array(staged, pa.string()), digests], ["at", "staged", "digest"])


def _digest(store, path: str) -> str:
    with store.open_input_stream(path, compression=None) as data:
        return hashlib.sha256(data.read()).hexdigest()


def _none_changed(changed: int, first: str | None) -> None:
    if changed:
        raise ValueError(f"{changed} files have changed meanwhile, the first is {first}; nothing was written")


def rewrite(rows: DataFrame, folder: str) -> None:
    """Writes texts over the files of a folder (a URI), all or none: rows of at (path from the folder), text and digest (of the file's bytes when it was read)."""
    job = f".staging-{uuid.uuid4().hex}"

    def store_of():
        from pyarrow import fs

        return fs.FileSystem.from_uri(folder)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of()
        own = f"{job}/{uuid.uuid4().hex}"
        store.create_dir(f"{top}/{own}", recursive=True)
        yield from _stage(store, f"{top}/{own}", batches)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of()
        for batch in batches:
            ats, _, digests = (c.to_pylist() for c in batch.columns)
            found = [at for at, digest in zip(ats, digests, strict=True) if _digest(store, f"{top}/{at}") != digest]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["at"])

    try:
        staged = checkpointed(rows.select("at", "text", "digest").mapInArrow(stage, "at string, staged string, digest string"))
        _none_changed(*staged.mapInArrow(changed, "at string").agg(F.count("*"), F.min("at")).first())
        moved(staged.select("staged", F.col("at").alias("file")), folder)
    finally:
        store, top = store_of()
        removed(store, f"{top}/{job}")


def _path(uri: str) -> str:
    """A file's path in its store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)[1]


class RewrittenFiles(DataSource):
    """Writes path, text and digest as whole files over the originals under a folder."""

    @classmethod
    def name(cls) -> str:
        return "rewritten_files"

    def writer(self, schema, overwrite: bool) -> Rewriter:
        return Rewriter(self.options["path"])


def _entries(store, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what is in a folder; hidden entries are left out, as Spark's own readers do."""
    from pyarrow import fs

    if store.type_name == "local":  # one at a time, however many there are
        with os.scandir(folder) as found:
            each = ((e.name, e.is_dir()) for e in found)
            yield from (e for e in each if not _hidden(e[0]))
    else:
        each = ((f.base_name, f.type == fs.FileType.Directory) for f in store.get_file_info(fs.FileSelector(folder)))
        yield from (e for e in each if not _hidden(e[0]))


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def tree_files(spark: SparkSession, folder: str) -> DataFrame:
    """at: the files below a folder (a URI), as paths from it. Tasks list it a level at a time, a folder each; the names are kept on shared storage."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        names, folders = [], []
        make = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_())], ["at", "folder"])
        for batch in batches:
            for at in batch.column(0).to_pylist():
                for name, is_folder in _entries(store, root + at):
                    names.append(f"{at}/{name}")
                    folders.append(is_folder)
                    if len(names) == NAMES_AT_ONCE:
                        yield make()
                        names, folders = [], []
        if names:
            yield make()

    level, found = spark.range(1).select(F.lit("").alias("at")).coalesce(1), []
    while True:
        found.append(checkpointed(level.mapInArrow(listed, "at string, folder boolean")))
        below = found[-1].where("folder").select("at")
        if below.isEmpty():
            return reduce(DataFrame.unionAll, found).where("NOT folder").select("at")
        level = below.repartition(spark.sparkContext.defaultParallelism, "at")


def _base(folder: str) -> str:
    """A folder's URI, as files' paths begin with it."""
    return ("file://" + folder if folder.startswith("/") else re.sub("^file:/+", "file:///", folder)).rstrip("/")


def read_sources(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """path (URI), file (root/include/.. or root/src/.., as locations name it), text and digest of the files of a source tree in the folder."""
    base = _base(folder)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            at, data, size = 0, [], 0
            for n, name in enumerate(batch.column(0).to_pylist(), 1):
                with store.open_input_stream(top + name, compression=None) as file:
                    data.append(file.read())
                size += len(data[-1])
                if size >= BYTES_AT_ONCE or n == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, n - at).columns, pa.array(data, pa.binary())], ["at", "file", "content"])
                    at, data, size = n, [], 0

    file = F.regexp_extract(F.concat(F.lit(base), "at"), f"/({re.escape(root)}/(?:include|src)/.+)$", 1)
    # dealt by name into a set number of tasks: names are short, their files are not
    files = tree_files(spark, base).select("at", file.alias("file")).where("file <> ''").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "at")
    read = files.mapInArrow(contents, "at string, file string, content binary")
    return read.select(F.concat(F.lit(base), "at").alias("path"), "file", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("digest"))


def apply_report(spark: SparkSession, report: DataFrame, folder: str, root: str, tiers: tuple[str, ...] = ("high",), include_existing: bool = False, apply: bool = False) -> DataFrame:
    """The (metric, value) summary of the report's replacements in the tree `root` of the folder; apply writes them.

    A dry run (the default) reads and reports, and writes nothing.
    """
    sources = read_sources(spark, folder, root)
    selected = decisions.select_replacements(report, root, tiers, include_existing)
    # texts and digests are of one reading, so a change after it is seen
    applied = checkpointed(decisions.apply_ids(sources, selected))
    if apply:
        base = _base(folder)
        rewrite(applied.where("changed").select(F.expr(f"substring(path, {len(base) + 2})").alias("at"), "text", "digest"), base)
    return decisions.replacement_summary(selected, applied)
