"""Capture files as frames.

``read_frames`` cuts large files at exact record boundaries, and no task walks a
whole file to find them. Each range of ``split_bytes`` works out, beside the
others, where chains of record lengths that may enter it would leave it: a small
map from entry to exit. The maps of a file are then composed from its first
record on, which leaves one true entry per range. An entry that a range did not
foresee (behind a record longer than the file says it has any) is followed
through that range alone. Files up to ``split_bytes`` are one range and are read
once. ``spark.read.format("pcap")`` reads each file in one task, with no map.
Record lengths decide all boundaries, so payloads that look like records, empty
records and records of any length are read as they are.

A record that its file does not hold whole is damage: a cut end, or a length
that passes the end, which hides all that follows. The read fails there, or with
``damage="stop"`` leaves out the rest of that file; ``capture_damage`` lists
those places.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from packetlake.schemas import FRAMES

FILE_HEADER, RECORD_HEADER = 24, 16
# Magic numbers as the file begins: byte order and units of a second (fixed values).
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
ETHERNET = 1
SPLIT_BYTES = 128 * 1024 * 1024
BLOCK = 8 * 1024 * 1024
# Bits of packet_no left for the offset in a file; the file number is above them.
OFFSET_BITS = 40
# Frames of one Arrow batch, and the bytes that a binary value can hold.
ROWS, LARGEST = 8192, 2**31 - 1
DAMAGE = ("error", "stop")

# Most bytes of a record for which entries of ranges are foreseen, and how many such records the lead-in of a range holds.
REACH, LEAD_RECORDS = 1 << 20, 4
# Ranges up to this number have a task each; above it a task takes several, of SPLIT_BYTES together at most.
OWN_TASKS = 1024

RANGES = "path string, file_no long, start long, stop long, size long"
MAPS = "path string, file_no long, size long, number long, entries array<long>, exits array<long>"
MAP_TYPES = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("file_no", "size", "number")), *((n, pa.list_(pa.int64())) for n in ("entries", "exits"))])
RANGE_TYPES = pa.schema([("path", pa.string()), *((name, pa.int64()) for name in ("file_no", "start", "stop", "size"))])
DAMAGED = "path string, file_no long, at long, bytes_left long, ts timestamp"


def register_pcap(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)


def open_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class CaptureFile(InputPartition):
    path: str
    file_no: int
    size: int


def list_captures(path: str, offset_bits: int = OFFSET_BITS) -> list[CaptureFile]:
    """The files by name; only sizes are looked at here."""
    system, root = open_filesystem(path)
    if system.get_file_info(root).type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
    else:
        found = [system.get_file_info(root)]
    named = sorted((f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith((".", "_")))
    if len(named) >> (63 - offset_bits) or any(size >> offset_bits for _, size in named):
        raise ValueError(f"{len(named)} files do not fit packet numbers with {offset_bits} bits of offset; choose other offset_bits")
    return [CaptureFile(name, number, size) for number, (name, size) in enumerate(named)]


@contextmanager
def open_capture(root: str, path: str, size: int) -> Iterator[Capture]:
    system, _ = open_filesystem(root)
    with system.open_input_file(path) as source:
        yield Capture(source, path, size)


class Capture:
    """The records of one open file."""

    def __init__(self, source, path: str, size: int):
        self.source, self.path, self.size = source, path, size
        self.damaged: int | None = None
        head = source.read_at(FILE_HEADER, 0)
        if head[:4] not in MAGICS or len(head) < FILE_HEADER:
            raise ValueError(f"{path} is not a capture file")
        self.order, self.second = MAGICS[bytes(head[:4])]
        snap, link = struct.unpack(self.order + "II", head[16:24])
        if link & 0xFFFF != ETHERNET:
            raise ValueError(f"{path} has link type {link & 0xFFFF}, not Ethernet")
        self.length = struct.Struct(self.order + "I").unpack_from
        #: Bytes of the longest record that is likely here.
        self.reach = min(REACH, snap + RECORD_HEADER) if snap else REACH

    def blocks(self, start: int, stop: int) -> Iterator[tuple[bytes, int, list[int], int]]:
        """(block, base, places, after): the whole records that begin from ``start`` to before ``stop``.

        ``base`` is the block's offset in the file, ``places`` are the records'
        offsets in the block and ``after`` is where the last one ends. A record
        that the file does not hold whole ends the walk and is kept in ``damaged``.
        """
        at, wanted = start, 0
        while at < stop:
            # No more than the range and its last record, if that is not longer than records are here.
            block = self.source.read_at(min(wanted or min(BLOCK, stop - at + self.reach), self.size - at), at)
            place, places, have = 0, [], len(block)
            while place < stop - at and place + RECORD_HEADER <= have:
                after = place + RECORD_HEADER + self.length(block, place + 8)[0]
                if after > have:
                    break
                places.append(place)
                place = after
            if places:
                yield block, at, places, place
                at, wanted = at + place, 0
                continue
            # Not one whole record: it is longer than the block, or than the file.
            wanted = RECORD_HEADER + (self.length(block, 8)[0] if have >= RECORD_HEADER else 0)
            if at + wanted > self.size:
                self.damaged = at
                return
            if wanted > LARGEST:
                raise ValueError(f"{self.path}: the record at byte {at} has {wanted} bytes, more than one value can hold")

    def entries(self, start: int) -> list[int]:
        """Offsets from ``start`` on to which chains of records lead that begin some records earlier.

        Every byte of the first record's length in the lead-in may begin a
        record. All their chains are followed at once by pointer jumping; most
        end in lengths that the file does not hold.
        """
        low = max(FILE_HEADER, start - LEAD_RECORDS * self.reach)
        if low == start:
            return [start]
        raw = np.frombuffer(self.source.read_at(min(self.size, start + RECORD_HEADER) - low, low), np.uint8)
        width = start - low
        held = max(0, min(width, len(raw) - RECORD_HEADER + 1))
        length = np.ndarray((held,), f"{self.order}u4", raw, 8, (1,)).astype(np.int64) if held else np.zeros(0, np.int64)
        after = np.full(width, -1)
        after[:held] = np.arange(held) + RECORD_HEADER + length
        after[after > self.size - low] = -1
        while (inside := np.flatnonzero((after >= 0) & (after < width))).size:
            after[inside] = after[after[inside]]
        first = after[:1] if low == FILE_HEADER else after[: self.reach]
        return (low + np.unique(first[first >= 0])).tolist()

    def exits(self, entries: list[int], stop: int) -> dict[int, int]:
        """Where the chain from each entry first comes to ``stop`` or beyond; those that the file does not hold are left out.

        Chains are followed in order of their offsets, so where two meet they
        are one from there on.
        """
        chains = {at: [at] for at in entries}
        left: dict[int, int] = {}
        heads = [at for at in chains if at < stop]
        left.update({at: at for at in chains if at >= stop})
        heapq.heapify(heads)
        block, base = b"", 0
        while heads:
            at = heapq.heappop(heads)
            if at + RECORD_HEADER > self.size:
                continue
            if not base <= at <= base + len(block) - RECORD_HEADER:
                block, base = self.source.read_at(min(BLOCK, stop - at + RECORD_HEADER, self.size - at), at), at
            alone = not heads
            have, place = len(block) - RECORD_HEADER, at - base
            owners = chains.pop(at)
            while True:
                place += RECORD_HEADER + self.length(block, place + 8)[0]
                if not alone or place > have or base + place >= stop:
                    break
            after = base + place
            if after > self.size:
                continue
            if after >= stop:
                left.update(dict.fromkeys(owners, after))
            elif after in chains:
                chains[after] += owners
            else:
                chains[after] = owners
                heapq.heappush(heads, after)
        return left

    def instants(self, seconds: np.ndarray, fraction: np.ndarray) -> np.ndarray:
        return seconds * 1_000_000 + fraction * 1_000_000 // self.second

    def frames(self, start: int, stop: int, number: int, damage: str) -> Iterator[pa.RecordBatch]:
        """Frames of the records between two boundaries; ``number`` is added to their offsets."""
        header = np.arange(RECORD_HEADER)
        for block, base, places, after in self.blocks(start, stop):
            raw = np.frombuffer(block, np.uint8)
            bounds = np.array([*places, after], np.int64)
            for low in range(0, len(places), ROWS):
                at = bounds[low : low + ROWS + 1]
                at, first, end = at[:-1], int(at[0]), int(at[-1])
                fields = raw[at[:, None] + header].view(f"{self.order}u4").astype(np.int64)
                seconds, fraction, kept, original = fields.T
                payload = np.ones(end - first, bool)
                payload[(at - first)[:, None] + header] = False
                ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw[first:end][payload])])
                times = pa.array(self.instants(seconds, fraction)).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
                columns = [pa.array(number + base + at), times, pa.array(original), data]
                yield pa.RecordBatch.from_arrays(columns, names=FRAMES.names)
        if self.damaged is not None and damage == "error":
            raise ValueError(f"{self.path} does not hold the whole record at byte {self.damaged} of {self.size}; damage='stop' leaves out what follows")


class PcapDataSource(DataSource):
    """Options: ``path``, ``damage`` (error or stop), ``offsetBits``. One task a file."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> StructType:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        options = self.options
        return PcapReader(options["path"], checked_damage(options.get("damage", "error")), int(options.get("offsetBits", OFFSET_BITS)))


class PcapReader(DataSourceReader):
    def __init__(self, path: str, damage: str, offset_bits: int):
        self.path, self.damage, self.offset_bits = path, damage, offset_bits

    def partitions(self) -> list[CaptureFile]:
        return list_captures(self.path, self.offset_bits)

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        with open_capture(self.path, partition.path, partition.size) as capture:
            yield from capture.frames(FILE_HEADER, partition.size, partition.file_no << self.offset_bits, self.damage)


def checked_damage(damage: str) -> str:
    if damage not in DAMAGE:
        raise ValueError(f"damage is one of {DAMAGE}, not {damage!r}")
    return damage


def file_rows(spark: SparkSession, files: list[CaptureFile]) -> DataFrame:
    """One row and one task per file, as a range over the whole file."""
    rows = [(f.path, f.file_no, FILE_HEADER, f.size, f.size) for f in files]
    return spark.createDataFrame(rows, RANGES).repartition(max(1, len(rows)))


def record_ranges(spark: SparkSession, path: str, files: list[CaptureFile], split_bytes: int) -> DataFrame:
    """RANGES of the files: a first record and the offset before which the last one begins.

    A file above ``split_bytes`` has a task for each of its ranges, here and in
    what reads them; very many short ranges share tasks. What meets in one task per file is one row per range: the
    chains that enter it and come out again.
    """
    large = [f for f in files if f.size > split_bytes]
    small = file_rows(spark, [f for f in files if f.size <= split_bytes])
    if not large:
        return small

    def map_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, stop = row["number"] * split_bytes, min(row["size"], (row["number"] + 1) * split_bytes)
                with open_capture(path, row["path"], row["size"]) as capture:
                    entries = capture.entries(start) if row["number"] else [FILE_HEADER]
                    # Most chains of chance leap over the range; a true one that does enters a later range.
                    found = capture.exits([at for at in entries if at < stop], stop)
                yield pa.RecordBatch.from_pylist([{**row, "entries": list(found), "exits": list(found.values())}], MAP_TYPES)

    def compose(key: tuple, maps: pa.Table) -> pa.Table:
        maps = maps.combine_chunks()
        name, number, size = (maps[c][0].as_py() for c in ("path", "file_no", "size"))
        rows = {n: i for i, n in enumerate(maps["number"].to_pylist())}
        at, out = FILE_HEADER, []
        while at < size:
            here = at // split_bytes
            stop = min(size, (here + 1) * split_bytes)
            out.append({"path": name, "file_no": number, "start": at, "stop": stop, "size": size})
            entries, exits = (maps[c][rows[here]].values.to_numpy() for c in ("entries", "exits"))
            known = np.flatnonzero(entries == at)
            if known.size:
                after = int(exits[known[0]])
            else:
                with open_capture(path, name, size) as capture:
                    after = capture.exits([at], stop).get(at)
            if after is None:
                break  # damage, left to the reader of this range
            at = after
        return pa.Table.from_pylist(out, RANGE_TYPES)

    last = F.expr(f"(size - 1) div {split_bytes}")
    ranges = file_rows(spark, large).select("path", "file_no", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("number"))
    tasks = sum(-(-f.size // split_bytes) for f in large)
    tasks = min(tasks, max(OWN_TASKS, sum(-(-f.size // SPLIT_BYTES) for f in large)))
    maps = ranges.repartition(tasks, "file_no", "number").mapInArrow(map_entries, MAPS)
    composed = maps.groupBy("file_no").applyInArrow(compose, RANGES)
    composed = composed.repartition(tasks, "file_no", "start")
    return small.unionByName(composed) if len(large) < len(files) else composed


def read_frames(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, damage: str = "error", offset_bits: int = OFFSET_BITS
) -> DataFrame:
    """Frames of all captures below ``path``; ``split_bytes=0`` reads each file in one task.

    Spark judges the frames by their ranges, one short row each, so it would broadcast them in a join: store them
    first, or say ``hint("merge")`` there.
    """
    checked_damage(damage)
    if not split_bytes:
        register_pcap(spark)
        return spark.read.format("pcap").option("damage", damage).option("offsetBits", offset_bits).load(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_capture(path, row["path"], row["size"]) as capture:
                    yield from capture.frames(row["start"], row["stop"], row["file_no"] << offset_bits, damage)

    return record_ranges(spark, path, list_captures(path, offset_bits), split_bytes).mapInArrow(read, FRAMES)


def capture_damage(spark: SparkSession, path: str, offset_bits: int = OFFSET_BITS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, file_no, at, bytes_left, ts): the first record of each file that it does not hold whole.

    ``ts`` is null where not even the record header is there. Only the range that
    holds the place looks at it, so large files are walked in parallel too.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                with open_capture(path, row["path"], row["size"]) as capture:
                    for _ in capture.blocks(row["start"], row["stop"]):
                        pass
                    at = capture.damaged
                    if at is not None:
                        head = capture.source.read_at(min(RECORD_HEADER, row["size"] - at), at)
                        whole = len(head) == RECORD_HEADER
                        ts = int(capture.instants(*struct.unpack(capture.order + "II", head[:8]))) if whole else None
                        found.append((row["path"], row["file_no"], at, row["size"] - at, ts))
            names, types = ["path", "file_no", "at", "bytes_left", "ts"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.timestamp("us", "UTC")]
            columns = zip(*found) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return record_ranges(spark, path, list_captures(path, offset_bits), split_bytes).mapInArrow(walk, DAMAGED)
