"""Address libraries, a count and (id, rva) pairs of 64-bit little-endian integers, one file `version-a-b-c-d.bin` a version.

Reading: a file is cut into byte ranges, so many tasks read one. Filters of id and version are pushed into the source: files of other
versions are not opened, and the range of wanted ids is found in a file by binary search, since libraries are sorted by id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from symbridge.sources.ordered_files import OrderedWriter

LIBRARY = "version string, pos long, id long, rva long"
#: Entries that one task reads, and entries of a batch.
RANGE = 1 << 20
BATCH = 1 << 16
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass
class Range(InputPartition):
    """Entries first to end of a version's file; part tells a range of the whole file."""

    path: str
    version: str
    first: int
    end: int
    part: bool = False


@dataclass
class Wanted:
    """What the pushed filters leave: ids from low to high, in every set of ids and of versions."""

    low: int = LEAST
    high: int = MOST
    ids: list[list[int]] = field(default_factory=list)
    versions: list[list[str]] = field(default_factory=list)

    def add(self, f: Filter) -> bool:
        """Whether the filter is taken over, wholly."""
        column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
        if column == ("version",) and isinstance(f, EqualTo | In):
            self.versions.append(list(value) if isinstance(f, In) else [value])
        elif column != ("id",) or value is None:
            return False
        elif isinstance(f, EqualTo):
            self.ids.append([value])
        elif isinstance(f, In):
            self.ids.append([v for v in value if v is not None])
        elif isinstance(f, GreaterThan):
            self.low = max(self.low, value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.low = max(self.low, value)
        elif isinstance(f, LessThan):
            self.high = min(self.high, value - 1)
        elif isinstance(f, LessThanOrEqual):
            self.high = min(self.high, value)
        else:
            return False
        return True

    def bounds(self) -> tuple[int, int]:
        return max([self.low, *(min(s, default=MOST) for s in self.ids)]), min([self.high, *(max(s, default=LEAST) for s in self.ids)])

    def mask(self, ids: np.ndarray) -> np.ndarray:
        low, high = self.bounds()
        keep = (ids >= low) & (ids <= high)
        for s in self.ids:
            keep &= np.isin(ids, np.array(s, np.int64))
        return keep


class LibraryReader(DataSourceReader):
    def __init__(self, path: str, strict: bool, sorted_ids: bool):
        self.path, self.strict, self.sorted_ids, self.wanted = path, strict, sorted_ids, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not (self.strict and self.wanted.add(f)):  # values of 2**63 or more, which compare otherwise, are left to Spark
                yield f

    def _file(self, path: str) -> pa.NativeFile:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        return store.open_input_file(path)

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
        low, high = self.wanted.bounds()
        out = []
        for f in sorted((f for f in files if f.is_file and f.base_name.endswith(".bin") and not f.base_name.startswith("_")), key=lambda f: f.path):
            version = f.base_name.removeprefix("version-").removesuffix(".bin")
            if any(version not in s for s in self.wanted.versions):
                continue
            with self._file(f.path) as data:
                size = data.size()
                if size < 8:
                    raise ValueError(f"{f.base_name}: no count")
                n = int.from_bytes(data.read_at(8, 0), "little")
                if size < 8 + 16 * n or self.strict and size != 8 + 16 * n:
                    raise ValueError(f"{f.base_name}: {n} entries do not fit {size} bytes")
                first, end, part = 0, n, (low, high) != (LEAST, MOST) and self.sorted_ids
                if part:
                    first, end = bound(data, n, low), bound(data, n, high + 1)
            out += [Range(f.path, version, a, min(end, a + RANGE), part) for a in range(first, end, RANGE)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no partitions
            return
        name = partition.path.rpartition("/")[2]
        with self._file(partition.path) as data:
            for first in range(partition.first, partition.end, BATCH):
                n = min(BATCH, partition.end - first)
                some = np.frombuffer(data.read_at(16 * n, 8 + 16 * first), "<i8").reshape(-1, 2)
                if self.strict and n and some.min() < 0:
                    raise ValueError(f"{name}: a value of 2**63 or more")
                if partition.part and (some[1:, 0] < some[:-1, 0]).any():
                    raise ValueError(f"{name}: ids are not sorted; read it with sorted_ids=False")
                keep = np.flatnonzero(self.wanted.mask(some[:, 0]))
                picked = some[keep]
                yield pa.RecordBatch.from_arrays([pa.array([partition.version] * len(keep), pa.string()), pa.array(first + keep), pa.array(picked[:, 0].copy()), pa.array(picked[:, 1].copy())], names=["version", "pos", "id", "rva"])


def bound(data: pa.NativeFile, n: int, value: int) -> int:
    """The number of entries whose id is under value, in a file sorted by id."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        if int.from_bytes(data.read_at(8, 8 + 16 * mid), "little", signed=True) < value:
            low = mid + 1
        else:
            high = mid
    return low


class LibraryWriter(OrderedWriter):
    def pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes, int]]:
        versions = batch.column(0).to_pylist()
        cuts = [i for i in range(len(versions)) if i == 0 or versions[i] != versions[i - 1]] + [len(versions)]
        pairs = np.stack([batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)], 1).astype("<i8")
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield f"version-{versions[a]}.bin", pairs[a:b].tobytes(), b - a

    def head(self, file: str, entries: int) -> bytes:
        return entries.to_bytes(8, "little")


class AddressLibrary(DataSource):
    """The library files of a folder (or one file); options strict and sorted_ids."""

    @classmethod
    def name(cls) -> str:
        return "address_library"

    def schema(self) -> str:
        return LIBRARY

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(self.options["path"], self.options.get("strict", "true") == "true", self.options.get("sorted_ids", "true") == "true")

    def writer(self, schema, overwrite: bool) -> LibraryWriter:
        return LibraryWriter(self.options["path"])


def read(spark: SparkSession, path: str, strict: bool = True, sorted_ids: bool = True) -> DataFrame:
    """version, pos, id, rva of library files. strict: sizes must match and values stay under 2**63; else trailing bytes are ignored.

    With strict, filters of id and version are pushed down. A file that is not sorted by id must be read with sorted_ids=False.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AddressLibrary)
    return spark.read.format("address_library").option("strict", str(strict).lower()).option("sorted_ids", str(sorted_ids).lower()).load(path)


def write(library: DataFrame, folder: str) -> int:
    """Writes version, id, rva as one file a version, sorted by id (then rva); the number of entries.

    A version's rows are written by as many tasks as it has ranges, and joined in order; files appear when all are whole.
    """
    library.sparkSession.dataSource.register(AddressLibrary)
    told, rows = Observation(), library.select("version", "id", "rva").repartitionByRange("version", "id", "rva").sortWithinPartitions("version", "id", "rva")
    rows.observe(told, F.count(F.lit(1)).alias("n")).write.format("address_library").mode("append").save(folder)
    return told.get["n"]


def decode(library: DataFrame) -> DataFrame:
    """Text lines (version, pos, line): the id, right-aligned to the width of the version's last id, a tab, and the rva in at least 7 hex digits."""
    last = library.groupBy("version").agg(F.length(F.max_by("id", "pos").cast("string")).alias("_width"))
    number, shown = F.col("id").cast("string"), F.hex("rva")
    line = F.concat(F.lpad(number, F.greatest(F.col("_width"), F.length(number)), " "), F.lit("\t"), F.lpad(shown, F.greatest(F.lit(7), F.length(shown)), "0"))
    return library.join(last, "version").select("version", "pos", line.alias("line"))
