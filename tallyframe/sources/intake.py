"""Taking in delimited files whose headers differ, with a table of rejected values.

Yearly files of one source rarely agree on the order of their columns, or on all of
them.  Spark's reader takes the names from one file and reads the others by place, so
files are grouped by their header line first, each group is read by its own names, and
the groups are put together by name; a column that a file lacks is NULL in its rows.
Only one line a file reaches the driver.

``take_in`` parses the files once: one pass writes the typed columns, the file and the
values that do not parse to a stage folder, and an ``Observation`` on that pass counts,
for each typed column, the values given and rejected.  Records and rejects are
projections of what was written.  More rejected values than the limit allows are an
error that names the columns and holds the rejects.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.sources.stage import StageFolder

MAX_REJECTED = 0.01  # share of a column's values
FILE, REJECTS = "_file", "_rejects"


class Intake(NamedTuple):
    """Typed records, rejected values (file, column, text), and by column (given, rejected)."""

    records: DataFrame
    rejects: DataFrame
    counts: dict[str, tuple[int, int]]


class TooManyRejects(ValueError):
    """Columns with more rejected values than allowed; ``intake`` holds them."""

    def __init__(self, columns: Sequence[str], limit: float, intake: Intake) -> None:
        said = ", ".join(f"{c} ({intake.counts[c][1]} of {intake.counts[c][0]})" for c in columns)
        super().__init__(f"more than {limit:.2%} of the values cannot be read in {said}")
        self.columns, self.intake = list(columns), intake


def clean_name(name: str) -> str:
    """Header text to column name: spaces become ``_``, commas are removed."""
    return name.replace(" ", "_").replace(",", "")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column with ``clean_name``; refuse names that collide."""
    seen: dict[str, str] = {}
    for original in df.columns:
        cleaned = clean_name(original)
        if cleaned in seen:
            raise ValueError(
                f"columns {seen[cleaned]!r} and {original!r} both become {cleaned!r}"
            )
        seen[cleaned] = original
    return df.toDF(*[clean_name(c) for c in df.columns])


def header_lines(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, list[str]]:
    """The files under the paths (files, folders or globs) by their first line.

    Files that Spark's readers skip (names with ``_`` or ``.`` in front) and empty files
    are left out.  Each file is opened for its first line only, compressed or not.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found: dict[str, list[str]] = {}

    def visit(fs, status) -> None:
        path = status.getPath()
        if path.getName().startswith(("_", ".")):
            return
        if status.isDirectory():
            for child in fs.listStatus(path):
                visit(fs, child)
            return
        stream, codec = fs.open(path), codecs.getCodec(path)
        lines = jvm.java.io.BufferedReader(
            jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        )
        try:
            line = lines.readLine()
        finally:
            lines.close()
        if line is not None:
            found.setdefault(line.removeprefix("﻿"), []).append(path.toString())

    for name in [paths] if isinstance(paths, str) else paths:
        pattern = jvm.org.apache.hadoop.fs.Path(name)
        fs = pattern.getFileSystem(conf)
        matches = fs.globStatus(pattern)
        if not matches:
            raise FileNotFoundError(f"no file matches {name}")
        for status in matches:
            visit(fs, status)
    if not found:
        raise FileNotFoundError(f"no file with a header under {paths}")
    return {line: sorted(files) for line, files in sorted(found.items())}


def text_records(
    spark: SparkSession, paths: str | Sequence[str], columns: Mapping[str, T.DataType] | Sequence[str], sep: str = ","
) -> DataFrame:
    """The ``columns`` as text under their cleaned names, whatever the order of each file's header."""
    groups, seen = [], set()
    for files in header_lines(spark, paths).values():
        raw = spark.read.csv(files, header=True, inferSchema=False, sep=sep, mode="PERMISSIVE")
        named = normalize_columns(raw)
        present = [c for c in columns if c in named.columns]
        seen.update(present)
        absent = [F.lit(None).cast("string").alias(c) for c in columns if c not in present]
        groups.append(named.select(*[F.col(f"`{c}`") for c in present], *absent))
    missing = [c for c in columns if c not in seen]
    if missing:
        raise ValueError(f"columns in no file's header: {missing}")
    return reduce(DataFrame.unionByName, groups).select(*[F.col(f"`{c}`") for c in columns])


def typed(name: str, dtype: T.DataType, date_format: str | None) -> Column:
    """The text column as its type, NULL if it does not parse."""
    column = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, T.DateType) and date_format:
        return F.try_to_date(column, date_format)
    return column.try_cast(dtype)


def rejected(name: str, dtype: T.DataType, date_format: str | None) -> Column:
    """Whether the column holds text that does not parse."""
    return F.coalesce((F.trim(F.col(f"`{name}`")) != "") & typed(name, dtype, date_format).isNull(), F.lit(False))


def over_limit(counts: Mapping[str, tuple[int, int]], limit: float) -> list[str]:
    return [c for c, (given, bad) in counts.items() if bad > limit * given]


def take_in(
    spark: SparkSession,
    paths: str | Sequence[str],
    stage: StageFolder,
    columns: Mapping[str, T.DataType],
    date_format: str | None = None,
    sep: str = ",",
    max_rejected: float = MAX_REJECTED,
    name: str = "intake",
) -> Intake:
    """Records and rejects of the files, parsed in one pass that writes to ``stage``.

    Raises ``TooManyRejects`` if a column's share of rejected values is above ``max_rejected``.
    """
    raw = text_records(spark, paths, columns, sep)
    parsed = {c: t for c, t in columns.items() if not isinstance(t, T.StringType)}
    given = [F.count_if(F.trim(F.col(f"`{c}`")) != "").alias(f"given {c}") for c in parsed]
    bad = [F.count_if(rejected(c, t, date_format)).alias(f"rejected {c}") for c, t in parsed.items()]
    watch = Observation(f"{name}-rejects")
    if parsed:
        raw = raw.observe(watch, *given, *bad)
    text = T.ArrayType(T.StructType([T.StructField("column", T.StringType()), T.StructField("text", T.StringType())]))
    wrong = [
        F.when(rejected(c, t, date_format), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")))
        for c, t in parsed.items()
    ]
    listed = F.filter(F.array(*wrong), lambda r: r.isNotNull()) if wrong else F.array()
    rows = raw.select(
        *[typed(c, t, date_format).alias(c) for c, t in columns.items()],
        F.input_file_name().alias(FILE), F.when(F.size(listed) > 0, listed).cast(text).alias(REJECTS),
    )
    written = stage.write(rows, name)
    seen = watch.get if parsed else {}
    counts = {c: (seen[f"given {c}"], seen[f"rejected {c}"]) for c in parsed}
    rejects = written.filter(F.col(REJECTS).isNotNull()).select(FILE, F.explode(REJECTS).alias("_"))
    found = Intake(
        written.select(*[F.col(f"`{c}`") for c in columns]),
        rejects.select(F.col(FILE).alias("file"), "_.column", "_.text"),
        counts,
    )
    above = over_limit(counts, max_rejected)
    if above:
        raise TooManyRejects(above, max_rejected, found)
    return found
