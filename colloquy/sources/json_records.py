"""Records of large JSON files, read by many tasks in byte ranges.

Spark's text reader cuts files at a separator that isn't a line end: at closing braces, with which every object
ends. What a byte range begins in, a string or not and how deep, only the ranges before it tell. So a first pass
sums each range up for both cases (quotes, depth gained, least depth, lists that open), sums over the ranges of a file
give each range its start, and a second pass cuts it into records. A record that goes over ranges comes as
parts, which meet by its number. No task holds more than a range of a file.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored

_ESCAPED = re.compile(r"\\.", re.S)
_BRACKETS = re.compile(r"[][{}]")
_DEEPER = {"{": 1, "[": 1, "}": -1, "]": -1}
#: Characters of pieces that go together in a row.
CHUNK_CHARS = 1 << 20
#: What may stand between records, and behind the last one.
_BETWEEN = " \t\r\n﻿,"


class _Depth:
    """Whether a place is inside a string and how deep it is, kept while text goes by."""

    def __init__(self, inside: int, depth: int = 0):
        self.inside, self.depth, self.low = inside, depth, depth

    def read(self, text: str) -> int:
        """Go on over text; the least depth in it."""
        parts = _ESCAPED.sub("", text).split('"')
        low = self.depth
        for part in parts[self.inside :: 2]:
            for c in _BRACKETS.findall(part):
                self.depth += _DEEPER[c]
                low = min(low, self.depth)
        self.inside = (self.inside + len(parts) - 1) % 2
        self.low = min(self.low, low)
        return low


def _by_range(batches):
    """(file, split, pieces) of each byte range; a range's pieces come one after the other."""
    key, held = None, []
    for batch in batches:
        for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value"))):
            if (file, split) != key:
                if key:
                    yield *key, held
                key, held = (file, split), []
            held.append(value + "}")
    if key:
        yield *key, held


def _opening(lists: tuple[str, ...]):
    names = "|".join(re.escape(n) for n in lists)
    return re.compile(rf'"({names})"\s*:\s*\[') if lists else None


_SUMMARY = "file string, split long, first string, odd int, gain0 int, gain1 int, low0 int, low1 int, opens array<struct<name:string,place:int,at0:int,at1:int,low0:int,low1:int>>"


def _summed(lists: tuple[str, ...]):
    opening = _opening(lists)

    def scan(batches):
        rows = []
        for file, split, pieces in _by_range(batches):
            both, opens = [_Depth(0), _Depth(1)], []
            for place, text in enumerate(pieces):
                found = opening.search(text) if opening else None
                if found:
                    at = []
                    for d in both:
                        d.read(text[: found.start()])
                        at.append(None if d.inside else d.depth)
                        d.read(text[found.start() : found.end()])
                    opens.append([found.group(1), place, *at, both[0].depth, both[1].depth])
                    lows = [d.read(text[found.end() :]) for d in both]
                else:
                    lows = [d.read(text) for d in both]
                for o in opens:
                    o[4], o[5] = min(o[4], lows[0]), min(o[5], lows[1])
            first = "".join(pieces).lstrip(_BETWEEN)[:1] if split == 0 else None
            rows.append((file, split, first, both[0].inside, both[0].depth, both[1].depth, both[0].low, both[1].low, [dict(zip(("name", "place", "at0", "at1", "low0", "low1"), o)) for o in opens]))
        opens_type = pa.list_(pa.struct([("name", pa.string()), *((n, pa.int32()) for n in ("place", "at0", "at1", "low0", "low1"))]))
        types = (pa.string(), pa.int64(), pa.string(), *[pa.int32()] * 5, opens_type)
        names = [c.split(" ")[0] for c in "file split first odd gain0 gain1 low0 low1 opens".split()]
        columns = zip(*rows) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return scan


def _starts(ranges: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """(file, split, kind, inside, depth, list, place, open, last): how each range begins, where in it its file's list opens, and whether it is the last."""
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("file")
    zero = F.lit(0)
    out = ranges.withColumn("kind", F.max("first").over(every)).withColumn("inside", F.coalesce(F.sum("odd").over(before), zero) % 2)
    either = lambda a, b: F.when(F.col("inside") == 0, a).otherwise(b)
    out = out.withColumn("depth", F.coalesce(F.sum(either(F.col("gain0"), F.col("gain1"))).over(before), zero))
    # Lists that are values of the outermost object.
    own = F.filter("opens", lambda o: either(o["at0"], o["at1"]) + F.col("depth") == 1)
    out = out.withColumn("own", own)
    have = [F.max(F.array_contains(F.transform("own", lambda o: o["name"]), n).cast("int")).over(every) for n in lists]
    chosen = F.lit(None).cast("string")
    for n, any_ in reversed(list(zip(lists, have))):
        chosen = F.when(any_ == 1, n).otherwise(chosen)
    out = out.withColumn("list", chosen)
    mine = F.get(F.filter("own", lambda o: o["name"] == F.col("list")), F.lit(0))
    out = out.withColumn("mine", mine)
    least = either(F.col("low0"), F.col("low1")) + F.col("depth")
    after = either(F.col("mine.low0"), F.col("mine.low1")) + F.col("depth")
    opened = F.coalesce(F.max(F.col("mine").isNotNull().cast("int")).over(before), zero)
    out = out.withColumn("opened", opened)
    closes = F.when(F.col("mine").isNotNull() & (F.col("opened") == 0), after <= 1).otherwise((F.col("opened") == 1) & (least <= 1))
    closed = F.coalesce(F.max(closes.cast("int")).over(before), zero)
    out = out.withColumn("open", (F.col("opened") == 1) & (closed == 0))
    place = F.when(F.col("opened") == 0, F.col("mine.place"))
    return out.select("file", "split", "kind", F.col("inside").cast("int").alias("inside"), F.col("depth").cast("int").alias("depth"), "list", place.alias("place"), "open", (F.max("split").over(every) == F.col("split")).alias("last"))


class _Cutter:
    """Cuts one byte range into records, its pieces given bit by bit."""

    def __init__(self, opening, bare: bool, file, split, kind, inside, depth, name, place, is_open, last):
        self.opening, self.file, self.split, self.kind, self.place = opening, file, split, kind, place
        self.base = 1 if kind == "[" else 2 if name else 0
        self.bad = kind not in ("[", "{") or (self.base == 0 and not bare)
        self.open, self.d, self.last = is_open or self.base < 2, _Depth(inside, depth), last
        self.at, self.n, self.held = 0, 0, []

    def feed(self, pieces: list[str]):
        """(nr, True, text) of each record that ends in the pieces."""
        if self.bad:
            if "".join(pieces).strip(_BETWEEN + "}"):
                raise ValueError(f"not a JSON object or array of instances: {self.file}")
            return
        d = self.d
        for text in pieces:
            start, at = 0, self.at
            self.at += 1
            if self.base == 2 and at == self.place:
                start, self.open = self.opening.search(text).end(), True
            elif self.base == 1 and self.split == 0 and not at:
                start = text.index("[") + 1
            d.read(text[:start])
            low = d.read(text[start:])
            if not self.open:
                continue
            if self.base and low < self.base:
                self.held.append(text[start:].split("]")[0])
                self.open = False
            elif not d.inside and d.depth == self.base:
                yield self.n, True, "".join(self.held) + text[start:]
                self.held, self.n = [], self.n + 1
            else:
                self.held.append(text[start:])

    def rest(self):
        """What is behind the last record, as a part of the next."""
        if self.last and self.open and self.base and not self.bad:
            raise ValueError(f"an instance isn't a JSON object: the list ends with the file {self.file}")
        if self.held and not self.base and self.d.depth < 0:
            self.held[-1] = self.held[-1][:-1]  # the brace that the last piece never had
        if self.held:
            yield self.n, False, "".join(self.held)


_PART = pa.schema([("file", pa.string()), ("split", pa.int64()), ("nr", pa.int64()), ("ended", pa.bool_()), ("part", pa.string())])
_PART_DDL = "file string, split long, nr long, ended boolean, part string"


def _rows(file: str, split: int, found) -> pa.RecordBatch:
    nr, ended, parts = zip(*found) if found else ((), (), ())
    n = len(nr)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(([file] * n, [split] * n, nr, ended, parts), _PART)], schema=_PART)


def _cut(lists: tuple[str, ...], bare: bool):
    """Parts of records: (file, split, nr, ended, part); nr counts the records that have ended in the range before."""
    opening = _opening(lists)

    def scan(batches):
        now = None
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i in range(batch.num_rows):
                file, split, pieces = (columns[n][i] for n in ("file", "split", "pieces"))
                if now is None or (now.file, now.split) != (file, split):
                    if now:
                        yield _rows(now.file, now.split, list(now.rest()))
                    now = _Cutter(opening, bare, file, split, *(columns[n][i] for n in ("kind", "inside", "depth", "list", "place", "open", "last")))
                yield _rows(file, split, list(now.feed(pieces)))
        if now:
            yield _rows(now.file, now.split, list(now.rest()))

    return scan


_CHUNK = pa.schema([("file", pa.string()), ("split", pa.int64()), ("chunk", pa.int32()), ("pieces", pa.list_(pa.string()))])


def _gathered(batches):
    """The pieces of each byte range in order, about CHUNK_CHARS in a row."""
    key, held, size, chunk = None, [], 0, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, chunk, held), _CHUNK)], schema=_CHUNK)

    for batch in batches:
        for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value"))):
            if (file, split) != key or size >= CHUNK_CHARS:
                if key:
                    yield row()
                chunk = chunk + 1 if (file, split) == key else 0
                key, held, size = (file, split), [], 0
            held.append(value + "}")
            size += len(value) + 1
    if key:
        yield row()


def _clean(part):
    return F.regexp_replace(part, rf"^[{_BETWEEN}]+", "")


def json_records(spark: SparkSession, path: str | list[str], lists: tuple[str, ...] = (), bare: bool = False) -> DataFrame:
    """(file, nr, json): the objects in JSON files, numbered from 0 in each file.

    A file is an array of objects, or an object with one of the named lists, the first of them that any object has, or,
    if bare, one or more objects one after the other. Other content, an element that isn't an object and a file that
    ends inside one are errors; blank files have no record.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    starts = stored(_starts(pieces.mapInArrow(_summed(lists), _SUMMARY), lists))
    # However Spark joins, the rows of a range, which one task reads, stay together.
    ranges = pieces.mapInArrow(_gathered, "file string, split long, chunk int, pieces array<string>")
    cut = ranges.join(starts, ["file", "split"]).sortWithinPartitions("file", "split", "chunk").mapInArrow(_cut(lists, bare), _PART_DDL)
    parts = numbered(stored(cut))
    alone = F.col("ended") & ((F.col("nr in range") > 0) | (F.col("split") == 0))
    joined = parts.where(~alone).groupBy("file", "nr").agg(F.array_sort(F.collect_list(F.struct("split", "nr in range", "part"))).alias("parts"), F.max("ended").alias("ended"))
    joined = joined.select("file", "nr", "ended", _clean(F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("json"))
    whole = parts.where(alone).select("file", "nr", "ended", F.when(alone, _clean(F.col("part"))).alias("json"))
    bad = F.raise_error(F.concat(F.lit("an instance isn't a JSON object: "), F.col("file"))).cast("string")
    rest = F.regexp_replace("json", r"[\s,\]}]", "")
    behind = ~F.col("ended") & (rest == "")
    # Rows that go give no error either, wherever Spark moves the filter.
    checked = F.when(behind | F.col("json").isNull(), F.lit(None)).when(F.col("ended") & F.startswith(F.col("json"), F.lit("{")), F.col("json")).otherwise(bad)
    return whole.unionByName(joined).where(~behind).select("file", "nr", checked.alias("json"))


def numbered(parts: DataFrame) -> DataFrame:
    """parts (file, split, nr, ended) with nr counted over a file's ranges; `nr in range` is what it was."""
    ends = parts.groupBy("file", "split").agg(F.count_if("ended").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("file", "split", before.alias("before"))
    return parts.join(starts, ["file", "split"]).withColumn("nr in range", F.col("nr")).withColumn("nr", F.col("before") + F.col("nr")).drop("before")


def _lines(batches):
    key, n = None, 0
    for batch in batches:
        for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value"))):
            if (file, split) != key:
                key, n = (file, split), 0
            line = value.strip(_BETWEEN)
            if line.startswith("["):  # its elements
                cutter = _Cutter(None, False, file, 0, "[", 0, 0, None, None, True, True)
                found = [*cutter.feed([p + "}" for p in line.split("}")]), *cutter.rest()]
                if found and not found[-1][1]:
                    if re.sub(r"[\s,\]}]", "", found.pop()[2]):
                        raise ValueError(f"an instance isn't a JSON object: {file}")
                parts = [p.lstrip(_BETWEEN) for _, _, p in found]
            else:
                parts = [line] if line else []
            if parts:
                yield _rows(file, split, [(n + i, True, p) for i, p in enumerate(parts)])
                n += len(parts)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, nr, json): the lines that aren't blank, numbered from 0 in each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    return numbered(stored(lines.mapInArrow(_lines, _PART_DDL))).select("file", "nr", F.col("part").alias("json"))
