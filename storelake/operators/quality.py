"""Data-quality operators: the declared constraints as checks over DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.sources.schemas import AS_OF, TABLES, generated_value


def apply_defaults(df: DataFrame, table: str, as_of: str | None = None,
                   falsy: Sequence[str] = ()) -> DataFrame:
    """Fill NULLs with the declared defaults; dates take ``as_of`` (default: now).

    Columns in ``falsy`` treat an empty text and 0 as missing.
    """
    spec = TABLES[table]

    def filled(column: str, default: object) -> Column:
        kind = spec.columns[column]
        if default is AS_OF:
            value = F.localtimestamp() if as_of is None else F.lit(as_of)
        else:
            value = F.lit(default)
        current = F.col(column)
        if column in falsy:
            empty = "" if kind.simpleString() == "string" else 0
            current = F.nullif(current, F.lit(empty).cast(kind))
        return F.coalesce(current.cast(kind), value.cast(kind))

    return df.withColumns({c: filled(c, v) for c, v in spec.defaults.items()
                           if c in df.columns})


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once; NULLs do not count as equal.

    Values are counted by a 64-bit hash first; only those whose hash is repeated are then
    compared as values.
    """
    known = df.filter(_all_known(columns)).select(
        *columns, F.xxhash64(*columns).alias("_hash"))
    again = known.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash")
    return known.join(again, "_hash", "left_semi").groupBy(*columns).agg(
        F.count("*").alias("occurrences")).filter(F.col("occurrences") > 1)


def check_fk(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose reference points nowhere."""
    keys = parent.select(F.col(key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti").select(
        *child.columns)


def check_domain(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows with a value outside the domain; NULL passes."""
    return df.filter(~F.col(column).isin(list(values)))


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a missing value, once per column concerned."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.withColumn("missing", F.explode(missing))


def check_generated(df: DataFrame, table: str) -> DataFrame:
    """Rows whose generated columns differ from their formula."""
    return df.filter(reduce(lambda a, b: a | b, _generated_rules(table).values()))


def _generated_rules(table: str) -> dict[str, Column]:
    return {c: ~F.col(c).eqNullSafe(generated_value(table, c))
            for c in TABLES[table].generated}


def order_lines_ok(lines: Column | str, required: Sequence[str] = (
        "product_id", "quantity", "unit_cost")) -> Column:
    """At least one line, and every line has all values as numbers, none zero."""
    def incomplete(line: Column) -> Column:
        return reduce(lambda a, b: a | b, (
            F.coalesce(line[c].try_cast("double"), F.lit(0.0)) == 0 for c in required))

    column = F.col(lines) if isinstance(lines, str) else lines
    return F.coalesce((F.size(column) > 0) & ~F.exists(column, incomplete), F.lit(False))


def check_order_lines(df: DataFrame, lines: str) -> DataFrame:
    """Orders with no line or an incomplete one."""
    return df.filter(~order_lines_ok(lines))


def _is_number(table: str, names: Sequence[str]) -> bool:
    return len(names) == 1 and TABLES[table].columns[names[0]].simpleString() in ("int", "bigint")


def _all_known(names: Sequence[str]) -> Column:
    return reduce(and_, (F.col(c).isNotNull() for c in names))


def _repeated_keys(d: Mapping[str, DataFrame], tables: Sequence[str]) -> dict[tuple, int]:
    """How many keys that are not numbers are repeated, by table and columns.

    They are counted by a hash, in one pass over each table. Only rules under which a hash
    is repeated are then looked at by value.
    """
    rules = [(t, names) for t in tables for names in TABLES[t].unique
             if not _is_number(t, names)]
    if not rules:
        return {}
    hashes = _union(
        d[t].select(F.explode(F.array_compact(F.array(*[
            F.when(_all_known(names), F.struct(F.lit(i).alias("of"),
                                               F.xxhash64(*names).alias("hash")))
            for i, (own, names) in enumerate(rules) if own == t]))).alias("k")).select("k.*")
        for t in dict.fromkeys(t for t, _ in rules))
    again = hashes.groupBy("of", "hash").agg(F.count("*").alias("n")).filter("n > 1").select(
        "of").distinct().collect()  # one row for each rule at most
    counts = {(t, "+".join(names)): 0 for t, names in rules}
    for row in again:
        table, names = rules[row["of"]]
        counts[table, "+".join(names)] = check_unique(d[table], names).count()
    return counts


def _marks(df: DataFrame, table: str, rules: Mapping[tuple, int], parents: Mapping[str, int]
           ) -> DataFrame:
    """What a table's rows tell about its rules: broken row rules, unique keys, references.

    of (the number of the rule), parent (the number of the table of references), key (a
    number; null for row rules), in one pass over the table. Rules and parents are numbers
    because there is a mark for every key of every row.
    """
    spec = TABLES[table]

    def mark(rule: str, column: str, when: Column, names: Sequence[str] = (),
             parent: str | None = None) -> Column:
        key = F.col(names[0]) if names else F.lit(None)
        return F.when(when, F.struct(
            F.lit(rules[table, rule, column]).alias("of"),
            F.lit(parents.get(parent)).cast("int").alias("parent"), key.cast("long").alias("key")))

    marks = [
        *[mark("not_null", c, F.col(c).isNull()) for c in spec.required],
        *[mark("domain", c, ~F.col(c).isin(list(v))) for c, v in spec.domains.items()],
        *[mark("generated", c, r) for c, r in _generated_rules(table).items()],
        *[mark("unique", names[0], F.col(names[0]).isNotNull(), names)
          for names in spec.unique if _is_number(table, names)],
        *[mark("foreign", f.column, F.col(f.column).isNotNull(), [f.column], f.parent)
          for f in spec.foreign if f.parent in parents],
    ]
    return df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*")


def _rules(table: str, parents: Iterable[str]) -> list[tuple[str, str, str]]:
    spec = TABLES[table]
    return [(table, rule, column) for rule, columns in (
        ("not_null", spec.required), ("domain", spec.domains), ("generated", spec.generated),
        ("unique", ["+".join(names) for names in spec.unique]),
        ("foreign", [f.column for f in spec.foreign if f.parent in parents])) for column in columns]


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def quality_report(d: Mapping[str, DataFrame], tables: Sequence[str] | None = None
                   ) -> DataFrame:
    """Violations of every declared rule, one row per rule.

    Each table is read once for its rules and each parent once for all its children.
    Equal marks are counted before they are shuffled, so a key that many rows refer to
    is one row from there on. Unique keys that are not numbers are counted beforehand, by
    a hash.
    """
    names = [n for n in (tables or TABLES) if n in d]
    repeated = _repeated_keys(d, names)
    rules = {r: i for i, r in enumerate(dict.fromkeys(r for n in names for r in _rules(n, d)))}
    parents = {p: i for i, p in enumerate(sorted(
        {f.parent for n in TABLES for f in TABLES[n].foreign if f.parent in d}))}
    counts = _union(_marks(d[n], n, rules, parents) for n in names).groupBy(
        "of", "parent", "key").agg(F.count("*").alias("n"))
    used = sorted({f.parent for n in names for f in TABLES[n].foreign if f.parent in d})
    if used:
        known = _union(d[p].select(F.lit(parents[p]).alias("parent"),
                                   F.col("id").cast("long").alias("key"))
                       for p in used).distinct()
        counts = counts.join(known.withColumn("found", F.lit(True)), ["parent", "key"], "left")
    else:
        counts = counts.withColumn("found", F.lit(None).cast("boolean"))

    def of_rule(rule: str) -> Column:
        return F.col("of").isin([i for r, i in rules.items() if r[1] == rule])

    broken = F.when(of_rule("unique"), (F.col("n") > 1).cast("long")).when(
        of_rule("foreign") & F.col("found"), 0).otherwise(F.col("n"))
    sums = counts.groupBy("of").agg(F.sum(broken).alias("violations"))
    spark = counts.sparkSession
    declared = spark.createDataFrame(
        [(rules[r], *r, repeated.get((r[0], r[2])) if r[1] == "unique" else None)
         for n in names for r in _rules(n, d)],
        "of int, table_name string, rule string, column_name string, repeated long")
    return declared.join(sums, "of", "left").select(
        "table_name", "rule", "column_name",
        F.coalesce("repeated", "violations", F.lit(0)).cast("long").alias("violations"))
