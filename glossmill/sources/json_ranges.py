"""Records of large JSON files, read by as many tasks as the file has blocks.

A file is read as text that is cut after every closing bracket, which Spark splits into byte ranges as it splits lines. A
range doesn't know whether it begins inside a string, or how deep. A first pass over files of several ranges works out, for
either case, how a range ends and how much deeper (a row for each range); put one after the other these give each range's
true beginning. The second pass cuts records out. One that crosses ranges leaves a piece in each, and the pieces are
joined; everything else stays where it was read. Compressed files have one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small_batches

_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|["\[\]{}]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
_OPEN = {"}": "{", "]": "["}
WHOLE, HEAD, TAIL = 0, 1, 2  # a record; a record's continuation from the range before; its beginning


def fragments(spark: SparkSession, path: str, close: str) -> DataFrame:
    """(file, start, length, size, value): the text between closing brackets, in order within a range of a file."""
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", close).text(path)
    return rows.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_block_length"].alias("length"), meta["file_size"].alias("size"), "value")


def tokens(text: str, in_string: bool) -> Iterator[tuple[str, int]]:
    """The brackets outside strings, and where they end; at last a quote if a string is left open."""
    at = 0
    if in_string:
        end = _STRING_END.match(text)
        if not end:
            yield '"', len(text)
            return
        at = end.end()
    for m in _TOKEN.finditer(text, at):
        token = m[0]
        if token == '"':
            yield token, len(text)
            return
        if token[0] != '"':
            yield token, m.end()


def _moved(text: str, in_string: bool, depth: int) -> tuple[bool, int]:
    """Whether a string is open at the end of a fragment, and the depth there."""
    left_open = False
    for token, _ in tokens(text, in_string):
        if token == '"':
            left_open = True
        else:
            depth += 1 if token in "[{" else -1
    return left_open, depth


def _runs(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """The values of a batch by file and range, and whether the range is the whole file; about `most` bytes at a time, because
    texts are in memory several times on their way."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield from _runs_of(batch.slice(at, step))


def _runs_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    files, starts, values, alone = (batch.column(c).to_pylist() for c in ("file", "start", "value", "alone"))
    first = 0
    for k in range(1, len(files) + 1):
        if k == len(files) or starts[k] != starts[first] or files[k] != files[first]:
            yield (files[first], starts[first]), values[first:k], alone[first]
            first = k


def _check_end(open_string: bool, depth: int, ending: str, top: str, close: str) -> None:
    """Raise if a file ends too early. Its last fragment is taken for closed by a bracket, which may not be there."""
    if open_string or not (depth == -1 or depth == 0 and (not top or _OPEN[close] == top and ending not in (",", ":", "{"))):
        raise ValueError("a file ends inside a record, or inside the array around them")


def _beginnings(rows: DataFrame, close: str, top: str) -> dict[tuple[str, int], tuple[bool, int]]:
    """Of every range of a file that has several: whether it begins inside a string, and at what depth."""
    names = ["file", "start", "open0", "depth0", "open1", "depth1", "ending"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], tuple[list[tuple[bool, int]], str]] = {}
        for batch in batches:
            for key, values, _ in _runs(batch):
                states = ends[key][0] if key in ends else [(False, 0), (True, 0)]
                for value in values:
                    states = [_moved(value + close, *s) for s in states]
                ends[key] = states, values[-1].rstrip()[-1:]
        for (file, start), (states, ending) in ends.items():
            yield pa.RecordBatch.from_pylist([dict(zip(names, (file, start, *states[0], *states[1], ending), strict=True))])

    several = rows.filter("length < size").select("file", "start", "value", F.lit(False).alias("alone"))
    found = several.mapInArrow(run, "file string, start bigint, open0 boolean, depth0 bigint, open1 boolean, depth1 bigint, ending string").collect()  # a row for each range
    state: dict[tuple[str, int], tuple[bool, int]] = {}
    for _, group in groupby(sorted(found, key=lambda r: (r["file"], r["start"])), lambda r: r["file"]):
        now = (False, 0)
        for r in group:
            state[r["file"], r["start"]] = now
            now = (r["open1"], now[1] + r["depth1"]) if now[0] else (r["open0"], now[1] + r["depth0"])
        _check_end(*now, r["ending"], top, close)
    return state


def _top(depth: int, key: str | None) -> str:
    """The bracket around everything, with which a file begins."""
    return "" if not depth else "[" if key is None else "{"


class _Cutter:
    """Cuts one range into records; fed its fragments in order."""

    def __init__(self, state: tuple[bool, int], depth: int, close: str, key: str | None, first: bool):
        (self.in_string, self.depth), self.level, self.close, self.open, self.key = state, depth, close, _OPEN[close], key
        self.kind = HEAD if self.depth > depth else WHOLE
        self.parts: list[str] | None = [] if self.kind == HEAD else None
        self.lead, self.last = "", ""
        self.top = _top(depth, key)
        self.unopened = first
        self.found: list[tuple[int, str]] = []

    def feed(self, text: str) -> None:
        at, in_string = 0, self.in_string
        self.in_string, self.last = False, text[:-1]
        for token, end in tokens(text, in_string):
            if token == '"':
                self.in_string = True
            elif token in "[{":
                if not self.depth:
                    if token != (self.top or self.open) or self.top and not self.unopened:
                        raise ValueError(f"these aren't the records of one JSON array: {text[at:end][:40]!r} at the top")
                    self.unopened = False
                if self.depth == self.level and self.parts is None and token == self.open and self._begins(self.lead + text[at : end - 1]):
                    self.parts, at, self.kind = [], end - 1, WHOLE
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == self.level and self.parts is not None:
                    self.found.append((self.kind, "".join([*self.parts, text[at:end]])))
                    self.parts, at, self.lead, self.kind = None, end, "", WHOLE
                elif self.depth < self.level and self.parts is None and token != self.close:
                    self.lead, at = "]", end
        if self.parts is None:
            self.lead += text[at:]
        else:
            self.parts.append(text[at:])

    def _begins(self, lead: str) -> bool:
        """Whether a record begins after this text: a comma, white space, or the beginning of the array that is asked for. A
        member of an object isn't a record."""
        bare = lead.strip()
        if self.level and (bare == "," or (bare == "[" if self.key is None else re.search(rf'"{re.escape(self.key)}"\s*:\s*\[$', bare))) or not self.level and not bare:
            return True
        if self.key is not None and bare.endswith(":"):
            return False
        raise ValueError(f"these aren't the records of one JSON array: {bare[:40]!r} before a record")

    def end(self, alone: bool) -> list[tuple[int, str]]:
        """What is left at the end of the range; alone: the range is the whole file."""
        if alone:
            _check_end(self.in_string, self.depth, self.last.rstrip()[-1:], self.top, self.close)
        if self.parts is not None:
            self.found.append((HEAD if self.kind == HEAD else TAIL, "".join(self.parts)))
        return self.found


def records(spark: SparkSession, path: str, depth: int = 1, close: str = "}", key: str | None = None) -> DataFrame:
    """One string column, `record`: the objects (or, with close="]", arrays) of the files' arrays.

    depth: brackets around a record: 1 in an array, 2 in an array that an object holds under `key`, 0 for values one after the
    other. Files that end inside a value, and text between records that doesn't belong there, raise.
    """
    small_batches(spark)
    rows = fragments(spark, path, close)
    state = _beginnings(rows, close, _top(depth, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cutter, alone = None, None, False

        def made(done: list[tuple[int, str]]) -> pa.RecordBatch:
            columns = [pa.array([current[0]] * len(done), pa.string()), pa.array([current[1]] * len(done), pa.int64()), pa.array([k for k, _ in done], pa.int32()), pa.array([t for _, t in done], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "record"])

        for batch in batches:
            for where, values, whole_file in _runs(batch):
                if where != current:
                    if cutter is not None:
                        yield made(cutter.end(alone))
                    current, cutter = where, _Cutter(state.get(where, (False, 0)), depth, close, key, where[1] == 0)
                alone = whole_file
                for value in values:
                    cutter.feed(value + close)
                if cutter.found:
                    yield made(cutter.found)
                    cutter.found = []
        if cutter is not None:
            yield made(cutter.end(alone))

    cut_out = rows.select("file", "start", "value", (F.col("length") >= F.col("size")).alias("alone")).mapInArrow(run, "file string, start bigint, kind int, record string")
    whole = cut_out.filter(F.col("kind") == WHOLE).select("record")
    if not state:  # no file has two ranges
        return whole
    order = Window.partitionBy("file").orderBy("start", "kind")  # a piece or two of a range
    pieces = cut_out.filter(F.col("kind") != WHOLE).withColumn("nth", F.count_if(F.col("kind") == TAIL).over(order))
    joined = pieces.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("all"))
    return whole.unionByName(joined.select(F.array_join("all.record", "").alias("record")))


def beginning(spark: SparkSession, path: str) -> str:
    """The first characters of a file that aren't white space; empty for an empty one."""
    head = fragments(spark, path, "}").filter("start = 0").select(F.substring(F.ltrim("value"), 1, 400).alias("head")).first()
    return "" if head is None else head[0].strip()
