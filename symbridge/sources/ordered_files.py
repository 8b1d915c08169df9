"""Single files written by many tasks: a data source whose tasks write parts and whose commit joins them in order.

Rows come range-partitioned and sorted by file, so only the first and the last file of a task may have rows in others. Each task appends
the rows of these to a part each, under a staging folder beside the files; the files between it puts together itself, and lists them in a
file of the staging folder, so what a task tells the driver does not grow with its files. Commit puts the shared files together (head, parts
in the order of the tasks, tail), in chunks of bounded size and several files at once, and gives all files their names when all are
whole; abort removes the staging folder, so no file is ever half there. Of a shared file the bytes pass the commit's copy once; nothing of them is held.
Of many files (write_texts()), commit leaves those that a task has put together to tasks, which name them (moved()).
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

CHUNK = 8 << 20
FILES_AT_ONCE = 8
#: Entries of a task's list that the commit holds at once.
LISTED_AT_ONCE = 10_000


def in_turn(store, lists: list[str]) -> Iterator[list]:
    """The entries of lists (a JSON value a line) of a store, some thousands at a time."""
    for path in lists:
        with store.open_input_stream(path, compression=None) as data, io.TextIOWrapper(data, "utf-8") as lines:
            while some := [json.loads(x) for x in islice(lines, LISTED_AT_ONCE)]:
                yield some


def moved(files: DataFrame, folder: str) -> None:
    """Tasks move staged files to their places: rows of staged (a path in the store of the folder, a URI) and file (a path from the folder). A move that is repeated after a loss finds its work done."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for staged, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    store.move(staged, f"{root}/{file}")
                except FileNotFoundError:
                    if store.get_file_info(staged).type != fs.FileType.NotFound:
                        raise  # else the task has begun before, and moved this file then
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("staged", "file").mapInArrow(move, "n bigint").agg(F.sum("n")).first()


def removed(store, folder: str) -> None:
    from pyarrow import fs

    if store.get_file_info(folder).type != fs.FileType.NotFound:
        store.delete_dir(folder)


@dataclass
class Parts(WriterCommitMessage):
    """What a task has written: (file, path of the part, entries) of the files it may share, in its order, and where it lists the whole ones (whole file, file)."""

    task: int
    parts: list[tuple[str, str, int]] = field(default_factory=list)
    listed: str | None = None


class OrderedWriter(DataSourceArrowWriter):
    """A writer of whole files in a folder; what a row's bytes are, and the file's head and tail, is the subclass's."""

    #: Files that there are even without rows.
    always: tuple[str, ...] = ()

    def __init__(self, folder: str, staging: str | None = None):
        """staging: a name for the staging folder in the folder; commit then leaves it, with the lists of whole files that are to be named in its folder `lists`."""
        self.folder, self.left, self.staging = folder, staging is not None, staging or f"_staging-{uuid.uuid4().hex}"

    def pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes, int]]:
        """(file, bytes, entries) of runs of a batch's rows."""
        raise NotImplementedError

    def head(self, file: str, entries: int) -> bytes:
        return b""

    def tail(self, file: str) -> bytes:
        return b""

    def _store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        return store, root, f"{root}/{self.staging}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, _, staging = self._store()
        staging = f"{staging}/{uuid.uuid4().hex}"  # a folder a task: files made in one folder wait for each other
        store.create_dir(staging, recursive=True)
        told, now, out, listing = Parts(TaskContext.get().partitionId()), None, None, None
        held: list[bytes] = []

        def flush() -> None:
            nonlocal out, held
            out = out or store.open_output_stream(now[1], compression=None)
            out.write(b"".join(held))
            held = []

        def close(last: bool) -> None:
            nonlocal out, held, listing
            if last or not told.parts or now[0] in self.always:
                flush()
                told.parts.append(now)
            else:
                whole = f"{staging}/whole-{uuid.uuid4().hex}"
                if out is None:  # it is held as a whole
                    with store.open_output_stream(whole, compression=None) as file:
                        file.write(b"".join([self.head(now[0], now[2]), *held, self.tail(now[0])]))
                else:
                    flush()
                    out.close()
                    self._join(store, whole, now[0], [now[1:]])
                if listing is None:
                    told.listed = f"{staging}/list-{uuid.uuid4().hex}"
                    listing = store.open_output_stream(told.listed, compression=None)
                listing.write((json.dumps([whole, now[0]]) + "\n").encode())
                out, held = None, []
                return
            out.close()
            out = None

        size = 0
        for batch in iterator:
            for file, data, entries in self.pieces(batch):
                if now is None or now[0] != file:
                    if now is not None:
                        close(False)
                    now, size = (file, f"{staging}/part-{uuid.uuid4().hex}", 0), 0
                held.append(data)
                size += len(data)
                if size > CHUNK:
                    flush()
                    size = 0
                now = (*now[:2], now[2] + entries)
        if now is not None:
            close(True)
        if listing is not None:
            listing.close()
        return told

    def _join(self, store, whole: str, file: str, parts: list[tuple[str, int]]) -> None:
        """The file of its parts (path, entries), which are removed."""
        with store.open_output_stream(whole, compression=None) as out:
            out.write(self.head(file, sum(n for _, n in parts)))
            for path, _ in parts:
                with store.open_input_stream(path, compression=None) as part:
                    while data := part.read(CHUNK):
                        out.write(data)
                store.delete_file(path)
            out.write(self.tail(file))

    def commit(self, messages: list[Parts | None]) -> None:
        store, root, staging = self._store()
        store.create_dir(staging, recursive=True)
        files: dict[str, list[tuple[str, int]]] = {f: [] for f in self.always}
        told = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        for m in told:
            for file, path, entries in m.parts:
                files.setdefault(file, []).append((path, entries))

        def join(numbered: tuple[int, str]) -> tuple[str, str]:
            number, file = numbered
            whole = f"{staging}/whole-{number}"
            self._join(store, whole, file, files[file])
            return whole, file

        try:
            with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
                name = lambda entry: store.move(entry[0], f"{root}/{entry[1]}")
                done = list(pool.map(join, enumerate(files)))
                list(pool.map(name, done))
                lists = [m.listed for m in told if m.listed]
                if self.left:
                    store.create_dir(f"{staging}/lists")
                    for n, listed in enumerate(lists):
                        store.move(listed, f"{staging}/lists/{n}")
                else:
                    for some in in_turn(store, lists):
                        list(pool.map(name, some))
        finally:
            if not self.left:
                store.delete_dir(staging)

    def abort(self, messages: list[Parts | None]) -> None:
        store, _, staging = self._store()
        removed(store, staging)


class TextWriter(OrderedWriter):
    """Lines, each with the ending, of one named file or of the file that stands before them; head and tail as they are."""

    def __init__(self, folder: str, name: str | None, head: str, tail: str, ending: str, staging: str | None = None):
        super().__init__(folder, staging)
        self.always, self.opening, self.closing, self.ending = () if name is None else (name,), head.encode(), tail.encode(), ending

    def pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes, int]]:
        *named, values = (c.to_pylist() for c in batch.columns)
        files = named[0] if named else self.always * len(values)
        cuts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield files[a], (self.ending.join(values[a:b]) + self.ending).encode(), b - a

    def head(self, file: str, entries: int) -> bytes:
        return self.opening

    def tail(self, file: str) -> bytes:
        return self.closing


class OrderedText(DataSource):
    """Writes value (string) as the lines of one text file, or (file, value) as those of many; options name, head, tail and ending."""

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def writer(self, schema, overwrite: bool) -> TextWriter:
        o = self.options
        return TextWriter(o["path"], o.get("name"), o.get("head", ""), o.get("tail", ""), o.get("ending", "\n"), o.get("staging"))


def write_text(lines: DataFrame, value: str, path: str, order: list[str], head: str = "", tail: str = "", ending: str = "\n") -> None:
    """One text file of the lines' value, in the order of other columns (none: in the order of the rows' partitions); value is not null."""
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    lines.sparkSession.dataSource.register(OrderedText)
    folder, _, name = path.rpartition("/")
    rows.select(lines[value].alias("value")).write.format("ordered_text").options(name=name, head=head, tail=tail, ending=ending).mode("append").save(folder)


def write_texts(lines: DataFrame, file: str, value: str, folder: str, order: list[str], head: str = "", tail: str = "", ending: str = "\n") -> None:
    """A text file in the folder for each value of the column `file` (a name), of its lines in the order of other columns."""
    from pyarrow import fs

    spark, staging = lines.sparkSession, f"_staging-{uuid.uuid4().hex}"
    lists = ("file://" if folder.startswith("/") else "") + f"{folder}/{staging}/lists"
    spark.dataSource.register(OrderedText)
    rows = lines.repartitionByRange(file, *order).sortWithinPartitions(file, *order).select(lines[file].alias("file"), lines[value].alias("value"))
    try:
        rows.write.format("ordered_text").options(head=head, tail=tail, ending=ending, staging=staging).mode("append").save(folder)
        entry = F.from_json("value", "array<string>")
        moved(spark.read.schema("value string").text(lists).select(entry[0].alias("staged"), entry[1].alias("file")), folder)
    finally:
        store, root = fs.FileSystem.from_uri(folder)
        removed(store, f"{root}/{staging}")
