"""Records of quoted CSV files, read by as many tasks as the files have byte ranges.

A line break ends a record only outside quotes, which a task that starts in the middle
of a file cannot see. But every quote character switches between inside and outside, so
the number of quotes of all earlier ranges, modulo two, is all that a range needs. One
pass counts quotes and lines per range under both assumptions; running sums over the
ranges (a row each) say which one holds and how many records came before. A second pass
joins the lines of the records that begin and end in one range; only the pieces of
records that cross a border are shuffled, by the number of their record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

_RANGES = "file long, range long, parity int, even long, odd long"
_PIECES = "number long, range long, place long, whole boolean, piece string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every line, its ``range`` and ``file``, which goes by the hash of its path."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


def _quotes_and_blanks(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    return quotes, pc.equal(pc.utf8_rtrim(text, characters="\r"), "").to_numpy(zero_copy_only=False)


def _runs(files: np.ndarray, ranges: np.ndarray) -> list[tuple[int, int]]:
    """From where to where the lines of a batch are of one range."""
    cuts = [0, *(np.flatnonzero((np.diff(ranges) != 0) | (np.diff(files) != 0)) + 1).tolist(), len(files)]
    return [(low, high) for low, high in zip(cuts, cuts[1:]) if low < high]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: its quotes modulo two, and the lines that start a record if it starts outside (even) or inside quotes."""
    last, carried = None, (0, 0, 0)

    def row() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        values = (*last, carried[0] % 2, *carried[1:])
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["file", "range", "parity", "even", "odd"])

    for batch in batches:
        files, ranges = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        quotes, blank = _quotes_and_blanks(batch.column(2))
        for low, high in _runs(files, ranges):
            here = (int(files[low]), int(ranges[low]))
            if here != last:
                if last:
                    yield row()
                last, carried = here, (0, 0, 0)
            after = carried[0] + np.cumsum(quotes[low:high])
            inside = (after - quotes[low:high]) % 2
            starts = [int(((inside == k) & ~blank[low:high]).sum()) for k in (0, 1)]
            carried = (int(after[-1]), carried[1] + starts[0], carried[2] + starts[1])
    if last:
        yield row()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each range, the first and last ones perhaps in part, by what ``entered``, ``before`` and ``first`` say of it."""
    last, carried = None, (0, 0, 0)  # of the range: lines, quotes, records
    for batch in batches:
        files, ranges, entered, before, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4, 5))
        text = batch.column(2)
        quotes, blank = _quotes_and_blanks(text)
        place, opened, ends, number = (np.zeros(len(files), np.int64) for _ in range(4))
        for low, high in _runs(files, ranges):
            here = (int(files[low]), int(ranges[low]))
            if here != last:
                last, carried = here, (0, int(entered[low]), int(before[low]))
            after = carried[1] + np.cumsum(quotes[low:high])
            opened[low:high], ends[low:high] = (after - quotes[low:high]) % 2, after % 2
            number[low:high] = carried[2] + np.cumsum((opened[low:high] == 0) & ~blank[low:high])
            place[low:high] = carried[0] + np.arange(high - low)
            carried = (carried[0] + high - low, int(after[-1]), int(number[high - 1]))
        # The first record of a file is its header.
        rows = np.flatnonzero((number > 1) & ~(blank & (opened == 0)))
        if not len(rows):
            continue
        number = (first + number - 2)[rows]
        new = (np.diff(number) != 0) | (np.diff(ranges[rows]) != 0) | (np.diff(files[rows]) != 0)
        start = np.concatenate([[0], np.flatnonzero(new) + 1])
        stop = np.append(start[1:], len(rows))
        lines = pa.ListArray.from_arrays(pa.array(np.append(start, len(rows)), pa.int32()), text.take(pa.array(rows)))
        whole = (opened[rows[start]] == 0) & (ends[rows[stop - 1]] == 0)
        yield pa.RecordBatch.from_arrays([
            pa.array(number[start]), pa.array(ranges[rows[start]]), pa.array(place[rows[start]]), pa.array(whole), pc.binary_join(lines, "\n"),
        ], names=["number", "range", "place", "whole", "piece"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``number`` (from 0, over all files in the order of their names) and ``record``: all records but the headers.

    Quotes must stand around cells, and doubled inside them, only. Line breaks inside
    cells are kept as they are; empty lines outside are no records.
    """
    lines = _lines(spark, path)
    ranges = cut_lineage(lines.mapInArrow(_sums, _RANGES))
    before = "PARTITION BY file ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    entered = ranges.selectExpr("file", "range", "even", "odd", f"coalesce(sum(parity) OVER ({before}), 0) % 2 AS entered").selectExpr(
        "file", "range", "entered", "IF(entered = 0, even, odd) AS starts"
    )
    within = entered.selectExpr("file", "range", "entered", "starts", f"coalesce(sum(starts) OVER ({before}), 0) AS before")
    # Files follow each other, each without its header: a row per file. Only their paths are read here.
    paths = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    files = within.groupBy("file").agg(F.sum("starts").alias("records")).join(paths, F.col("file") == F.xxhash64("path")).selectExpr(
        "file AS _file", "coalesce(sum(greatest(records - 1, 0)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first"
    )
    known = within.join(files, F.col("file") == F.col("_file")).selectExpr("file", "range", "entered", "before", "first")
    # A row per range: it goes to the lines, which stay where they are and in order.
    placed = lines.join(F.broadcast(cut_lineage(known)), ["file", "range"]).select("file", "range", "value", "entered", "before", "first")
    pieces = cut_lineage(placed.mapInArrow(_pieces, _PIECES))
    ended = F.regexp_replace("piece", "\r$", "").alias("record")
    short = pieces.where("whole").select("number", ended)
    parts = pieces.where("NOT whole").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("range", "place", "piece"))).alias("parts"))
    long = parts.select("number", F.array_join(F.transform("parts", lambda p: p["piece"]), "\n").alias("piece")).select("number", ended)
    return short.unionByName(long)
