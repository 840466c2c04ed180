"""Writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schemas import PAIR_KEY


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, appended: the streaming form of every sink."""
    df.write.mode(mode).json(path)


def write_split(df: DataFrame, path: str) -> None:
    """Training and development sets, a folder each."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Pair keys of all records of the task: one file holding one array of arrays of four strings."""
    keys = df.filter(F.col("task") == "wic").select(F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in PAIR_KEY])).alias("value"))
    one_file(keys, path)


def array_text(df: DataFrame, order: list[str]) -> str:
    """A preview, bounded by its caller, as one pretty JSON array. `write_array` is for results of any size."""
    return json.dumps([json.loads(r["j"]) for r in df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()], ensure_ascii=False, indent=2)


def write_array(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One file holding one JSON array, a record a line, in the given order; for tables of any size."""
    rows = df if order is None else df.orderBy(*order)
    one_file(rows.select(_record(rows).alias("value")), path)


def write_report(summary: DataFrame, records: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One file of {"summary", "records"}: a one-row summary and records of any size. Numbers that aren't are written as NaN."""
    head = json.dumps(summary.first().asDict(recursive=True), ensure_ascii=False, default=str)
    rows = records if order is None else records.orderBy(*order)
    one_file(rows.select(_record(rows).alias("value")), path, f'{{"summary": {head}, "records": [', "]}")


def _record(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def one_file(values: DataFrame, path: str, head: str = "[", tail: str = "]", between: str = ",") -> None:
    """Values joined by commas (or another character of ASCII) in one file. Tasks write parts, each value behind a comma; the parts
    are then copied one after the other, as a stream of small buffers, without the first comma. The file appears when it is whole."""
    spark = values.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    made = f"{path}.{uuid.uuid4().hex}"
    values.select(F.concat(F.lit(between), "value")).write.text(f"{made}.parts")
    place = hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    out = system.create(hadoop.fs.Path(f"{made}.whole"))
    try:
        out.write(bytearray(f"{head}\n".encode()))
        names = sorted(str(f.getPath()) for f in system.listStatus(hadoop.fs.Path(f"{made}.parts")) if f.getLen() and f.getPath().getName().startswith("part-"))
        for k, name in enumerate(names):
            part = system.open(hadoop.fs.Path(name))
            if k == 0:
                part.seek(1)
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
        out.write(bytearray(f"{tail}\n".encode()))
    finally:
        out.close()
    system.delete(hadoop.fs.Path(f"{made}.parts"), True)
    system.delete(place, True)
    system.rename(hadoop.fs.Path(f"{made}.whole"), place)


def report_text(summary: DataFrame, title: str = "") -> str:
    """A one-row summary as lines of a console report: fractions in four digits, what is missing as n/a."""
    row = summary.first().asDict()
    shown = {k: "n/a" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v) for k, v in row.items()}
    width = max(map(len, shown), default=0)
    return "\n".join([*([title] if title else []), *[f"{k.ljust(width)}  {v}" for k, v in shown.items()]])


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metrics row that replaces the one before; called again as results come in."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def output_names(name: str) -> tuple[str, str]:
    return f"predictions_{name}.jsonl", f"predictions_{name}_metrics.json"
