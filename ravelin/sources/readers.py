"""Readers: monthly tables, CSV series, observations, line-typed text, and archives of traces."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import tarfile
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from contextlib import nullcontext
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_months(spark: SparkSession, paths: Sequence[str], times: Sequence[str] = ()) -> DataFrame:
    """Several parquet files or folders as one table; the time columns become timestamps, null where they are none. Columns that
    are times already stay as they are, so filters on them reach the scan."""
    df = spark.read.parquet(*paths)
    other = [c for c in times if c in df.columns and not isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in other}) if other else df


@dataclass(frozen=True)
class FileCatalogue:
    """What time each file covers: (first, last, path), on one clock. Files out of a range aren't even listed."""

    entries: tuple[tuple[datetime, datetime, str], ...]

    def paths(self, low: datetime, high: datetime, before: timedelta = timedelta(hours=6), after: timedelta = timedelta(hours=6)) -> list[str]:
        return [p for first, last, p in sorted(self.entries) if last >= low - before and first <= high + after]

    def read(self, spark: SparkSession, at: str, low: datetime, high: datetime, before: timedelta = timedelta(hours=6), after: timedelta = timedelta(hours=6), columns: Sequence[str] | None = None) -> DataFrame:
        """Rows with `at` in [low - before, high + after], of the files that can hold any; an error if none can."""
        paths = self.paths(low, high, before, after)
        if not paths:
            raise FileNotFoundError(f"no file covers {low} to {high}")
        df = spark.read.parquet(*paths).filter(F.col(at).between(F.lit(low - before), F.lit(high + after)))
        return df.select(*columns) if columns else df


def read_available(spark: SparkSession, paths: Sequence[str], wanted: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that the files have, then those that begin with a prefix; what they lack is left out."""
    df = spark.read.parquet(*paths)
    chosen = [c for c in wanted if c in df.columns] + [c for c in df.columns if c not in wanted and c.startswith(tuple(prefixes))]
    return df.select(*[F.col(f"`{c}`") for c in chosen])


def month_files(names: Sequence[str], months: Sequence[int]) -> list[str]:
    """The names whose last YYYY-MM or YYYYMM is one of the months (1 to 12)."""
    import re

    out = []
    for n in names:
        found = re.findall(r"(\d{4})-?(\d{2})(?!\d)", n)
        if found and int(found[-1][1]) in set(months):
            out.append(n)
    return out


def read_range(spark: SparkSession, path: str, at: str, low, high, margin_s: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a table whose time lies in [low - margin, high + margin]; the filter and the columns reach the scan, so files
    and row groups out of range aren't read."""
    margin = F.expr(f"INTERVAL {margin_s} SECONDS")
    df = spark.read.parquet(path).filter((F.col(at) >= F.lit(low) - margin) & (F.col(at) <= F.lit(high) + margin))
    return df.select(*columns) if columns else df


def read_series(spark: SparkSession, paths: Sequence[str], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Daily sums of a CSV series over many files; a day without any value stays null."""
    df = spark.read.option("header", True).csv(list(paths))
    return df.groupBy(*keys).agg(*[F.sum(F.expr(f"try_cast(`{v}` AS double)")).alias(v) for v in values])


def read_observations(spark: SparkSession, paths: Sequence[str], numbers: Sequence[str], station: str = "station", at: str = "valid") -> DataFrame:
    """Weather observations; `null`, `M` and what is no number are null."""
    df = spark.read.option("header", True).csv(list(paths))
    clean = lambda c: F.when(~F.trim(F.col(c)).isin("null", "M", ""), F.trim(F.col(c)))
    text = [c for c in df.columns if c not in (*numbers, at)]
    return df.select(*[clean(c).alias(c) for c in text], F.try_to_timestamp(clean(at)).alias(at), *[clean(c).try_cast("double").alias(c) for c in numbers]).filter(F.col(station).isNotNull())


def read_typed_lines(spark: SparkSession, paths: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """(path, line, kind, words) of the lines whose first word is one of the kinds. Lines are numbered in their file from 0; a
    file is read in splits, and only its lines' places are brought into order."""
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))
    inside = F.row_number().over(W.partitionBy("path", "block").orderBy("no"))
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("inside", inside).join(blocks.select("path", "block", before.alias("before")), ["path", "block"])
    words = F.split(F.trim("value"), r"\s+")
    out = numbered.select("path", (F.col("before") + F.col("inside") - 1).cast("int").alias("line"), words[0].alias("kind"), words.alias("words"))
    return out.filter(F.col("kind").isin(list(kinds)))


TRACE = "icao string, reg string, type string, start double, points array<struct<dt:double,lat:double,lon:double,ground:boolean,alt:double,gs:double,source:string,callsign:string>>"


def _number(value) -> float | None:
    return float(value) if type(value) in (int, float) else None


def _point(values: list) -> dict:
    """A point's places 0 to 8: time, latitude, longitude, altitude or `ground`, speed, then details, and further on its source."""
    full = dict(enumerate(values))
    details = full.get(8)
    flight = details.get("flight") if isinstance(details, dict) else None
    return {
        "dt": _number(full.get(0)), "lat": _number(full.get(1)), "lon": _number(full.get(2)), "ground": full.get(3) == "ground", "alt": _number(full.get(3)),
        "gs": _number(full.get(4)), "source": full.get(9), "callsign": (flight or "").strip() or None,
    }


def parse_trace(raw: bytes) -> dict | None:
    """A trace file's content, plain or gzipped; None where it is broken."""
    try:
        with io.BytesIO(raw) as plain, gzip.open(plain) if raw.startswith(GZIP) else plain as text:
            held = json.load(text)
        return {"icao": held["icao"], "reg": held.get("r"), "type": held.get("t"), "start": _number(held["timestamp"]), "points": [_point(p) for p in held.get("trace", ())]}
    except (AttributeError, EOFError, KeyError, OSError, TypeError, ValueError, zlib.error):
        return None


GZIP = bytes([31, 139])
#: An archive's parts: name.tar.aa, name.tar.ab and so on, or name.tar.0, name.tar.1.
PART = r"\.(?:[a-z]{2}|\d+)$"


class _Joined(io.RawIOBase):
    """Files one after another as one, which can be read anywhere; each is opened when it is needed."""

    def __init__(self, paths: Sequence[str], sizes: Sequence[int]) -> None:
        self.paths, self.begins = paths, list(accumulate(sizes, initial=0))
        self.at, self.now, self.file = 0, None, None

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.begins[-1]}[whence]
        return self.at

    def readinto(self, room) -> int:
        if self.at >= self.begins[-1] or not len(room):
            return 0
        which = bisect_right(self.begins, self.at) - 1
        if which != self.now:
            if self.file is not None:
                self.file.close()
            store, inside = pa.fs.FileSystem.from_uri(self.paths[which])
            self.now, self.file = which, store.open_input_file(inside)
        n = min(len(room), self.begins[which + 1] - self.at)
        self.file.seek(self.at - self.begins[which])
        got = self.file.read(n)
        room[: len(got)] = got
        self.at += len(got)
        return len(got)


class BrokenArchive(ValueError):
    """An archive that breaks off, or lacks a part."""


def _spans(stream, size: int, name: str, keep_broken: bool) -> list[tuple[int, int]] | None:
    """(offset, length) of an archive's files, by its headers alone; None where it is compressed and so has no places to go to."""
    out: list[tuple[int, int]] = []
    head = stream.read(262)
    stream.seek(0)
    if len(head) == 262 and head[257:262] != b"ustar" and head[:1] != b"\0":
        return None
    try:
        with tarfile.open(fileobj=stream, mode="r:") as tar:
            for m in tar:
                if m.isfile():
                    if m.offset_data + m.size > size:
                        raise tarfile.ReadError("a file is cut off")
                    out.append((m.offset_data, m.size))
            if tar.offset + 512 > size:  # blocks of zeros end an archive
                raise tarfile.ReadError("there is no end")
    except (tarfile.TarError, EOFError) as error:
        if not keep_broken:
            raise BrokenArchive(f"{name} breaks off after {len(out)} files: {error}") from error
    return out


def _members(stream, name: str, keep_broken: bool) -> Iterator[dict]:
    """Readable traces of a compressed tar stream, in one pass."""
    head, n = stream.read(6), 0
    stream.seek(0)
    opener = next((f for mark, f in ((GZIP, gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ", lzma.open)) if head.startswith(mark)), None)
    try:
        with (opener or nullcontext)(stream) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:  # which tell a cut-off stream from its end
            for m in tar:
                if m.isfile() and (row := parse_trace(tar.extractfile(m).read())):
                    n += 1
                    yield row
    except (tarfile.TarError, EOFError, OSError, lzma.LZMAError, zlib.error) as error:
        if not keep_broken:
            raise BrokenArchive(f"{name} breaks off after {n} files: {error}") from error


def _numbered(names: Sequence[str]) -> list[int]:
    """The numbers of an archive's parts: 0, 1 and so on of digits, and of two letters."""
    ends = [n.rsplit(".", 1)[-1] for n in names]
    return [int(e) if e.isdigit() else (ord(e[0]) - 97) * 26 + ord(e[1]) - 97 for e in ends]


def read_trace_archives(spark: SparkSession, paths: Sequence[str], held: int = 64 << 20, piece: int = 64 << 20, keep_broken: bool = False) -> DataFrame:
    """One row for each readable trace in tar archives of (gzipped) JSON members; broken members are passed over. An archive that breaks
    off or lacks a part is an error, unless keep_broken asks for what came before.

    Archives of one file of up to `held` bytes come through Spark's reader. Of others, one task reads the headers, and tasks then
    read `piece` bytes or so each at the places that the headers gave. Parts (.tar.aa, .tar.ab or .tar.0, .tar.1) are put together
    in the order of their numbers. A compressed archive has no places and is streamed by one task. Files are opened from any store
    that Arrow's file systems know."""
    import pandas as pd

    def frames(rows: Iterator[dict]):
        while part := list(islice(rows, 256)):
            yield pd.DataFrame(part)

    def whole(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                spans = _spans(io.BytesIO(content), len(content), path, keep_broken)
                if spans is None:
                    yield from frames(_members(io.BytesIO(content), path, keep_broken))
                else:
                    yield from frames(row for at, n in spans if (row := parse_trace(content[at : at + n])))

    def index(batches):
        for pdf in batches:
            for archive, parts, sizes in zip(pdf["archive"], pdf["parts"], pdf["sizes"], strict=True):
                order = sorted(range(len(parts)), key=lambda i: _numbered([parts[i]])[0]) if len(parts) > 1 else [0]
                parts, sizes = [parts[i] for i in order], [int(sizes[i]) for i in order]
                if len(parts) > 1 and not keep_broken and (numbers := _numbered(parts)) != list(range(numbers[0], numbers[0] + len(parts))):
                    raise BrokenArchive(f"{archive} lacks a part: {numbers}")
                spans = _spans(io.BufferedReader(_Joined(parts, sizes), 4096), sum(sizes), archive, keep_broken)
                base = {"archive": archive, "parts": parts, "sizes": sizes}
                if spans is None:
                    yield pd.DataFrame([base | {"offsets": None, "lengths": None}])
                    continue
                begin = 0
                for k, (at, n) in enumerate(spans):  # runs of files that lie together
                    if k + 1 == len(spans) or at + n - spans[begin][0] >= piece:
                        run = spans[begin : k + 1]
                        yield pd.DataFrame([base | {"offsets": [a for a, _ in run], "lengths": [b for _, b in run]}])
                        begin = k + 1

    def read(batches):
        for pdf in batches:
            for archive, parts, sizes, offsets, lengths in zip(*(pdf[c] for c in ("archive", "parts", "sizes", "offsets", "lengths")), strict=True):
                stream = io.BufferedReader(_Joined(list(parts), [int(x) for x in sizes]), 1 << 20)
                if offsets is None:
                    yield from frames(_members(stream, archive, keep_broken))
                    continue

                def rows(stream=stream, spans=tuple(zip(offsets, lengths, strict=True))):
                    for at, n in spans:
                        stream.seek(int(at))
                        if row := parse_trace(stream.read(int(n))):
                            yield row

                yield from frames(rows())

    files = spark.read.format("binaryFile").load(list(paths))
    single = ~F.col("path").rlike(PART) & (F.col("length") <= held)
    archives = files.filter(~single).groupBy(F.regexp_replace("path", PART, "").alias("archive")).agg(F.collect_list(F.struct("path", "length")).alias("p"))  # a few names each
    places = archives.select("archive", F.col("p.path").alias("parts"), F.col("p.length").alias("sizes")).mapInPandas(index, "archive string, parts array<string>, sizes array<long>, offsets array<long>, lengths array<long>")
    # The places are dealt out one by one: a row is `piece` bytes of an archive.
    dealt = places.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive", F.get("offsets", F.lit(0)))
    return files.filter(single).select("path", "content").mapInPandas(whole, TRACE).unionByName(dealt.mapInPandas(read, TRACE))
