"""Table sets: a read-only mapping of lazily built DataFrames, and its storage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelake.functions.predicates import all_of, is_blank
from storelake.sources.schemas import (
    DEFAULT_BRANCH, DEFAULT_SETTINGS, PROCUREMENT_LINES, SALE_LINES, TABLES, enforce_schema,
)


class Tables(Mapping[str, DataFrame]):
    """Name -> DataFrame; a table is only analysed when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame] | DataFrame],
                 by_month: Mapping[str, Callable[[], DataFrame]] | None = None,
                 by_range: Mapping[str, Callable[[str, str | None, str | None], DataFrame]]
                 | None = None):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}
        self._by_month = dict(by_month or {})
        self._by_range = dict(by_range or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            built = self._builders[name]
            self._built[name] = built if isinstance(built, DataFrame) else built()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def replacing(self, **tables: DataFrame) -> Tables:
        """The same set with some tables exchanged (the result of a posting)."""
        return Tables({**self._builders, **self._built, **tables},
                      {n: b for n, b in self._by_month.items() if n not in tables},
                      {n: b for n, b in self._by_range.items() if n not in tables})

    def of_months(self, name: str, first: str | None, last: str | None) -> DataFrame:
        """Rows of a table; if it is stored by month, only of the months of these days."""
        bounds = []
        if name in self._by_month:
            if not is_blank(first):
                bounds.append(F.col(MONTH) >= _month(F.lit(first).cast("date")))
            if not is_blank(last):
                bounds.append(F.col(MONTH) <= _month(F.lit(last).cast("date")))
        return self._by_month[name]().filter(all_of(bounds)).drop(MONTH) if bounds else self[name]


    def of_dates(self, name: str, column: str, first: str | None, last: str | None) -> DataFrame:
        """Rows of a table; if ranges of the column are kept, only files that touch them."""
        open_ended = is_blank(first) and is_blank(last)
        if open_ended or column not in RANGED.get(name, ()) or name not in self._by_range:
            return self[name]
        return self._by_range[name](column, first, last)


def of_dates(d: Mapping[str, DataFrame], name: str, column: str, first: str | None,
             last: str | None) -> DataFrame:
    """A table for a query over some dates of a column, which are still to be filtered."""
    return d.of_dates(name, column, first, last) if isinstance(d, Tables) else d[name]


def of_months(d: Mapping[str, DataFrame], name: str, first: str | None, last: str | None
              ) -> DataFrame:
    """A table for a query over some days, which are still to be filtered."""
    return d.of_months(name, first, last) if isinstance(d, Tables) else d[name]


def _month(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM")


# Large tables are stored by month of this column; ``of_months`` skips folders.
MONTHLY = {
    "sales": "sale_date",
    "procurements": "created_at",
    "stock_adjustments": "created_at",
    "inventory_movements": "created_at",
    "audit_logs": "created_at",
}
MONTH = "_month"
#: Of these columns the smallest and largest value of every file is kept beside the table.
RANGED = {"procurements": ("procurement_date",)}


def write_tables(d: Mapping[str, DataFrame], path: str, names: Iterable[str] | None = None,
                 mode: str = "errorifexists") -> None:
    """Store tables as Parquet, the event tables by month."""
    for name in names or d:
        df = enforce_schema(d[name], name)
        if name in MONTHLY:
            df = df.withColumn(MONTH, _month(MONTHLY[name]))
            # AQE splits a month that is too large for one writer task.
            df.hint("rebalance", MONTH).write.mode(mode).partitionBy(MONTH).parquet(
                f"{path}/{name}")
            if name in RANGED:
                write_ranges(df.sparkSession, path, name)
        else:
            df.write.mode(mode).parquet(f"{path}/{name}")


def write_ranges(spark: SparkSession, path: str, name: str) -> None:
    """Note the range of each ranged column in every file of a stored table.

    Only those columns are read. Call it again after files were added by other means.
    """
    rows = spark.read.schema(TABLES[name].struct.add(MONTH, "string")).parquet(f"{path}/{name}")
    rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(*[
        f(c).alias(f"{n}_{c}") for c in RANGED[name] for n, f in (("low", F.min), ("high", F.max))
    ]).write.mode("overwrite").parquet(f"{path}/ranges.{name}")


def _of_range(spark: SparkSession, path: str, name: str, column: str, first: str | None,
              last: str | None) -> DataFrame:
    """The files in which a value of the column may lie between two days."""
    kinds = ", ".join(f"{n}_{c} {TABLES[name].columns[c].simpleString()}"
                      for c in RANGED[name] for n in ("low", "high"))
    ranges = spark.read.schema(f"file string, {kinds}").parquet(f"{path}/ranges.{name}")
    bounds = []
    if not is_blank(first):
        bounds.append(F.col(f"high_{column}") >= F.lit(first).cast("date"))
    if not is_blank(last):
        bounds.append(F.col(f"low_{column}") <= F.lit(last).cast("date"))
    files = sorted(r["file"] for r in ranges.filter(all_of(bounds)).select("file").collect())
    struct = TABLES[name].struct
    if not files:
        return spark.createDataFrame([], struct)
    return spark.read.schema(struct.add(MONTH, "string")).option(
        "basePath", f"{path}/{name}").parquet(*files).drop(MONTH)


def read_tables(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> Tables:
    """Open tables stored by :func:`write_tables`; the schema is not inferred."""
    def opened(name: str) -> DataFrame:
        schema = TABLES[name].struct
        if name in MONTHLY:
            schema = schema.add(MONTH, "string")
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    known = [n for n in names or TABLES if n != "password_resets"]
    return Tables({n: (lambda n=n: opened(n).drop(MONTH)) for n in known},
                  {n: (lambda n=n: opened(n)) for n in known if n in MONTHLY},
                  {n: (lambda c, first, last, n=n: _of_range(spark, path, n, c, first, last))
                   for n in known if n in RANGED})


def read_jdbc_table(spark: SparkSession, url: str, name: str, *, key: str = "id",
                    low: int, high: int, partitions: int,
                    properties: Mapping[str, str] | None = None) -> DataFrame:
    """Read one table of the operational database in key ranges."""
    df = spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high,
                         numPartitions=partitions, properties=dict(properties or {}))
    return enforce_schema(df, name)


def default_settings(spark: SparkSession) -> DataFrame:
    """The settings of a fresh installation."""
    rows = [(i, *row) for i, row in enumerate(DEFAULT_SETTINGS, 1)]
    df = spark.createDataFrame(
        rows, "id long, setting_key string, setting_value string, description string")
    return enforce_schema(df, "system_settings")


def default_branches(spark: SparkSession) -> DataFrame:
    """The branch of a fresh installation."""
    df = spark.createDataFrame(
        [(1, *DEFAULT_BRANCH)],
        "id long, branch_name string, location string, phone string, email string, "
        "status string")
    return enforce_schema(df, "branches")


def parse_order_lines(df: DataFrame, payload: str, kind: str) -> DataFrame:
    """Explode a JSON order payload into lines numbered from 1.

    Adds ``line_no``, ``product_id``, ``quantity`` and, for procurements,
    ``unit_cost``. A value that is no number becomes NULL, for the posting
    operators to reject. A payload without lines keeps one row without a line
    number; one that cannot be read keeps one with line number 0.
    """
    schema = SALE_LINES if kind == "sale" else PROCUREMENT_LINES
    kept = [c for c in df.columns if c != payload]
    lines = df.withColumn("_lines", F.from_json(payload, schema)).select(
        *kept, F.col("_lines").isNull().alias("_unread"),
        F.posexplode_outer("_lines").alias("_pos", "_line"))
    number = {"quantity": F.expr("try_cast(_line.quantity as int)")}
    if kind != "sale":
        number["unit_cost"] = F.expr("try_cast(_line.unit_cost as decimal(12,2))")
    return lines.select(
        *kept,
        F.when(F.col("_unread"), 0).otherwise(F.col("_pos") + 1).alias("line_no"),
        F.col("_line.product_id").alias("product_id"),
        *[c.alias(n) for n, c in number.items()],
    )
