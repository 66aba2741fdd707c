"""Records as CSV lines, encoded by expressions so that embedded line breaks survive any terminator."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.config import APPEND, CREATE, TRUNCATE, CsvConfig

MODES = {CREATE: "errorifexists", APPEND: "append", TRUNCATE: "overwrite"}


def csv_line(fields: Column, config: CsvConfig = CsvConfig()) -> Column:
    """A field is quoted if it has the delimiter, a quote, a line break, the terminator or the escape character;
    a lone empty field is quoted too.  Null fields are empty."""
    special = {config.delimiter, '"', "\r", "\n", *config.terminator, *(config.escape or "")}

    def one(f: Column) -> Column:
        f = F.coalesce(f, F.lit(""))
        test = None
        for c in sorted(special):
            has = F.contains(f, F.lit(c))
            test = has if test is None else test | has
        inner = F.replace(f, F.lit('"'), F.lit((config.escape or '"') + '"'))
        return F.when(test, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(f)

    line = F.array_join(F.transform(fields, one), config.delimiter)
    return F.when((F.size(fields) == 1) & (line == ""), '""').otherwise(line)


def split_by_width(records: DataFrame, config: CsvConfig) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the declared width."""
    if config.flexible or config.width is None:
        return records, records.where(F.lit(False))
    fits = F.size("fields") == config.width
    return records.where(fits), records.where(~fits)


def write_csv(records: DataFrame, path: str, mode: str = CREATE, config: CsvConfig = CsvConfig()) -> DataFrame:
    """Writes the records that fit, without a header, and returns the rest."""
    good, bad = split_by_width(records, config)
    good.select(csv_line(F.col("fields"), config).alias("value")).write.mode(MODES[mode]).option("lineSep", config.terminator).text(path)
    return bad


def print_csv(records: DataFrame, config: CsvConfig = CsvConfig(), to=None) -> None:
    to = to or sys.stdout
    good, _ = split_by_width(records, config)
    for r in good.select(csv_line(F.col("fields"), config).alias("line")).toLocalIterator():
        to.write(r["line"] + config.terminator)
