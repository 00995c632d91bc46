"""Sinks: semicolon files with decimal comma, sets of tables, and size-limited chunks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregate import group_count
from ..operators.joins import attach
from ..operators.ranges import row_ranks
from ..operators.window import pack_years
from .shared import settle

SHEET_ROWS = 1_048_575


FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def _decimal_comma(name: str, kind: T.DataType) -> str:
    text = f"cast(`{name}` AS STRING)"
    if isinstance(kind, T.DecimalType):
        # all of its digits, without trailing zeros
        text = f"format_string('%s', {text})"
        short = f"trim(TRAILING '.' FROM trim(TRAILING '0' FROM {text}))"
        text = f"replace(CASE WHEN contains({text}, '.') THEN {short} ELSE {text} END, '.', ',')"
        text = f"CASE WHEN `{name}` IS NOT NULL THEN {text} END"
    elif isinstance(kind, FRACTIONAL):
        # as a decimal where Spark would write an exponent
        text = (
            f"CASE WHEN abs(`{name}`) >= 1e7 AND abs(`{name}`) < 1e22"
            f" THEN cast(try_cast(`{name}` AS DECIMAL(38, 15)) AS STRING)"
            f" WHEN abs(`{name}`) < 1e-3 AND abs(`{name}`) > 1e-12"
            f" THEN cast(try_cast(`{name}` AS DECIMAL(38, 30)) AS STRING) ELSE {text} END"
        )
        short = f"trim(TRAILING '.' FROM trim(TRAILING '0' FROM {text}))"
        plain = f"contains({text}, '.') AND NOT contains({text}, 'E')"
        text = f"replace(CASE WHEN {plain} THEN {short} ELSE {text} END, '.', ',')"
    return f"{text} AS `{name}`"


def csv2_columns(df: DataFrame) -> DataFrame:
    """All columns as the text that a semicolon file holds: ``2`` for 2.0, ``2,5`` for 2.5."""
    return df.selectExpr(*[_decimal_comma(f.name, f.dataType) for f in df.schema.fields])


def _cell(name: str, kind: T.DataType) -> Column:
    text = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        text = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(text, F.lit("NA"))


def write_csv2(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Semicolon, decimal comma, names and text in quotes, bare ``NA`` for missing, a header in every file.

    Quotes in text are doubled, all other signs stand as they are, line breaks too: spreadsheet programs and
    statistics packages read the same text back. A partition is a file.
    """
    cells = [_cell(f.name, f.dataType) for f in df.schema.fields]
    header = ";".join('"{}"'.format(c.replace('"', '""')) for c in df.columns)
    # the id of the first row of a partition is a multiple of 2 to the 33
    first = F.monotonically_increasing_id() % F.lit(1 << 33) == 0
    line = F.concat(F.when(first, F.lit(f"{header}\n")).otherwise(""), F.concat_ws(";", *cells))
    csv2_columns(df).select(line.alias("value")).write.mode(mode).option("maxRecordsPerFile", 0).text(path)


def _parsed(content: pa.Buffer, names: list[str], header: bool) -> Iterator[pa.RecordBatch]:
    """Cells of a file or of some of its lines as text; a bare ``NA`` is missing, a quoted one is text."""
    if not content.size:
        return
    # a row may be as long as the file
    read = csv.ReadOptions(column_names=names, skip_rows_after_names=int(header), block_size=min(max(content.size, 1 << 20), 1 << 30))
    convert = csv.ConvertOptions(
        column_types={n: pa.string() for n in names}, null_values=["NA"], strings_can_be_null=True, quoted_strings_can_be_null=False
    )
    yield from csv.open_csv(content, read, csv.ParseOptions(delimiter=";", newlines_in_values=True), convert)


def read_csv2(spark: SparkSession, path: str, schema: str | T.StructType, line_breaks: bool = True) -> DataFrame:
    """Read semicolon files of that form, whoever wrote them: columns by place, the header line of every file left out.

    A file is parsed whole, by one task, since a line break may stand in a text. Pass ``line_breaks=False`` for files
    without such texts that are too large for that (2 GB at most otherwise): they are split by lines over many tasks.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f"c{i}" for i in range(len(wanted))]

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _parsed(content.as_buffer(), names, header=True)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            some = []
            for line, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
                if (file, start) != at:
                    at = file, start
                    if not start:  # the first line of a file
                        continue
                some.append(line)
            yield from _parsed(pa.py_buffer("\n".join(some).encode()), names, header=False)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if line_breaks:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*[!_]").load(path).select("content")
        rows = found.mapInArrow(files, text)
    else:
        place = ["_metadata.file_path AS file", "_metadata.file_block_start AS start"]
        rows = spark.read.option("lineSep", "\n").text(path).selectExpr("value", *place).mapInArrow(lines, text)
    out = []
    for name, f in zip(names, wanted.fields):
        value = F.replace(name, F.lit(","), F.lit(".")) if isinstance(f.dataType, FRACTIONAL) else F.col(name)
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def write_dataset(
    tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite"
) -> dict[str, str]:
    """Write several named tables under one folder; gives the path of each."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in tables}
    for name, df in tables.items():
        if fmt == "csv2":
            write_csv2(df, paths[name], mode)
        else:
            df.write.mode(mode).format(fmt).save(paths[name])
    return paths


def write_chunks(
    df: DataFrame,
    path: str,
    year: str = "Jaar",
    limit: int = SHEET_ROWS,
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> DataFrame:
    """Write ``df`` in chunks of whole years under ``limit`` rows, newest years in chunk 1.

    One folder per chunk (``serie=1`` ...). A single year above the limit is a chunk of its own, and
    no file ever holds more than ``limit`` rows. Gives the chunk table, see :func:`chunk_summary`.
    """
    chunks = pack_years(group_count(df, year), year, "n", limit)
    # pack_years bounds the number of years, so the broadcast stays small
    keyed = attach(df, F.broadcast(chunks.select(year, "serie")), year)
    # rebalance gathers a chunk in few tasks, and splits it again where it is large
    gathered = keyed.hint("rebalance", F.col("serie"))
    writer = gathered.write.mode(mode).option("maxRecordsPerFile", limit).partitionBy("serie")
    writer.format(fmt).save(path)
    return chunks


def write_exact_chunks(
    df: DataFrame,
    path: str,
    order: Sequence[Column],
    limit: int = SHEET_ROWS,
    fmt: str = "parquet",
    mode: str = "overwrite",
    rows: int = 1_000_000,
) -> None:
    """Write ``df`` in chunks of exactly ``limit`` rows (the last one: what is left), in ``order`` across all chunks.

    One folder per chunk (``serie=1`` ...); ``volgnr`` is the place of a row in the whole. For outputs whose years may be
    split. Places come from partition counts (see :func:`row_ranks`), so a year, or equal rows, that make up most of
    the table are spread over many tasks; ``rows`` is about what a task sorts, and more where that would take more than
    1 024 tasks.
    """
    ranked = row_ranks(df, order, settle, "volgnr", rows)
    chunked = ranked.selectExpr("*", f"(volgnr - 1) div {int(limit)} + 1 AS serie").sortWithinPartitions("serie", "volgnr")
    chunked.write.mode(mode).option("maxRecordsPerFile", limit).partitionBy("serie").format(fmt).save(path)


def chunk_summary(chunks: DataFrame, year: str = "Jaar", measure: str = "n") -> DataFrame:
    """Rows, first and last year of every chunk of :func:`write_chunks`."""
    return chunks.groupBy("serie").agg(
        F.expr(f"sum(`{measure}`) AS rijen"), F.expr(f"min(`{year}`) AS minY"), F.expr(f"max(`{year}`) AS maxY")
    )
