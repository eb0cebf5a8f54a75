"""Quoted delimited files, read in splits.

Whether a line break ends a record depends on whether a quoted field is open there, which is only
known from the file's beginning on. A first pass works out for every split of a file whether
a field is open behind it, once for a split that starts outside of a field and once for one that
starts inside. Put together in file order these give the state at every split's start. The second pass joins
the lines of each split to records by it; only records that cross splits are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a row of the second pass holds: a record, or the end or the beginning of one that crosses splits.
WHOLE, END, BEGINNING = 0, 1, 2
PIECES = "path string, start long, kind int, heads boolean, record string"


def open_behind(sep: str) -> Callable[[str, bool], bool]:
    """A function (line, open before it) -> is a quoted field open behind the line? A quote opens a field
    only as its first character, two are one character, and what follows the closing one
    up to the separator changes nothing."""
    rest = f"[^{re.escape(sep)}]*+"
    inside = '[^"]*+(?:""[^"]*+)*+"'
    close, field = re.compile(inside + rest), re.compile(f'"{inside}{rest}|(?!"){rest}')

    def after(line: str, is_open: bool) -> bool:
        if '"' not in line:
            return is_open
        m = (close if is_open else field).match(line)
        while m and m.end() < len(line):
            m = field.match(line, m.end() + 1)
        return m is None
    return after


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int] | None, list[str]]]:
    """The lines of a task with their split; a task may hold several splits, one after the other."""
    for pdf in batches:
        for split, lines in pdf.groupby(["path", "start"], sort=False)["value"]:
            yield (split[0], int(split[1])), lines.tolist()


def _states(after: Callable[[str, bool], bool]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], list[bool]] = {}
        for split, lines in _splits(batches):
            state = found.setdefault(split, [False, True])
            for line in lines:
                if '"' in line:
                    state[:] = [after(line, s) for s in state]
        yield pd.DataFrame([(*split, *state) for split, state in found.items()],
                           columns=["path", "start", "outside", "inside"])
    return run


def _records(after: Callable[[str, bool], bool], opened):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, is_open, kind, heads, held = None, False, WHOLE, False, []

        def unfinished() -> list[tuple]:
            # what the split began is ended by the next one; what it only goes on with is the middle of a record
            return [(*at, BEGINNING if kind == WHOLE else END, heads, "\n".join(held))] if held else []

        for split, lines in _splits(batches):
            out = []
            if split != at:
                out += unfinished()
                if split not in opened.value:
                    raise RuntimeError(f"the splits of {split[0]} changed between two passes")
                at, is_open, held = split, opened.value[split], []
                kind, heads = (END if is_open else WHOLE), split[1] == 0
            for line in lines:
                held.append(line)
                is_open = after(line, is_open)
                if not is_open:
                    out.append((*at, kind, heads, "\n".join(held)))
                    kind, heads, held = WHOLE, False, []
            yield pd.DataFrame(out, columns=["path", "start", "kind", "heads", "record"])
        yield pd.DataFrame(unfinished(), columns=["path", "start", "kind", "heads", "record"])
    return run


def read_quoted(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Delimited text whose quoted fields may hold separators, doubled quotes and line breaks, read in as
    many tasks as its files have splits; the same rows as a reader with one task a file.

    The first pass runs at the call. Its result, two flags a split, passes through the driver,
    which lists the splits anyway. Records that cross splits are put together by file and
    place. Line breaks within fields stay as they are; empty lines are no records; ``sep`` is one character."""
    after = open_behind(sep)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    flags = lines.mapInPandas(_states(after), "path string, start long, outside boolean, inside boolean")
    opened: dict[tuple[str, int], bool] = {}
    file, is_open = None, False
    for r in sorted(flags.collect(), key=lambda r: (r["path"], r["start"])):
        if r["path"] != file:
            file, is_open = r["path"], False
        opened[file, r["start"]] = is_open
        is_open = r["inside"] if is_open else r["outside"]
    pieces = lines.mapInPandas(_records(after, spark.sparkContext.broadcast(opened)), PIECES)
    whole = pieces.where(F.col("kind") == WHOLE)
    order = Window.partitionBy("path").orderBy("start", "kind")
    crossing = pieces.where(F.col("kind") != WHOLE).withColumn("n", F.count_if(F.col("kind") == BEGINNING).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    joined = crossing.groupBy("path", "n").agg(F.bool_or("heads").alias("heads"),
                                               F.array_join(F.transform(parts, lambda e: e["record"]), "\n").alias("record"))
    records = whole.select("heads", "record").unionByName(joined.select("heads", "record"))
    if header:
        records = records.where(~F.col("heads"))
    record = F.regexp_replace("record", r"\r\z", "")
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    return (records.select(record.alias("record")).where(F.col("record") != "")
            .select(F.from_csv("record", schema, options).alias("r")).select("r.*"))
