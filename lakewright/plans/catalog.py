"""Catalog operators: tables, columns, counts, keys, value domains, drift."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources import tables as T

MAX_DOMAIN = 30
ENUMS = {"region": ["accounts", "opportunities"], "segment": ["accounts", "opportunities"], "stage": ["opportunities"], "activity_type": ["activities"], "product_code": ["opp_products"]}


def columns(frames: dict[str, DataFrame]) -> list[tuple[str, str, str, bool]]:
    """(table, column, type, nullable), tables in order of name."""
    return [(t, f.name, f.dataType.simpleString(), f.nullable) for t in sorted(frames) for f in frames[t].schema.fields]


def columns_frame(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame(columns(frames), "table_name string, column_name string, type string, nullable boolean")


def fill_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, type, filled): how many values each column has,
    by one aggregation for each table."""
    parts = []
    for t, df in sorted(frames.items()):
        counts = df.agg(*(F.count(f"`{c}`").alias(c) for c in df.columns))
        each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("type"), F.col(f"`{c}`").alias("filled")) for c, kind in df.dtypes))
        parts.append(counts.select(F.lit(t).alias("table_name"), F.explode(each).alias("x")).select("table_name", "x.*"))
    return reduce(DataFrame.unionAll, parts)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n), one small aggregation for each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in sorted(frames.items())]
    return reduce(DataFrame.unionAll, parts)


def domains(frames: dict[str, DataFrame], enums: dict[str, list[str]] = ENUMS, most: int = MAX_DOMAIN) -> DataFrame:
    """(label, value): the distinct values of a column over all tables that
    have it; columns with more than ``most`` values are no enums."""
    parts = [frames[t].select(F.lit(label).alias("label"), F.col(label).alias("value")).where("value is not null").distinct() for label, tables in enums.items() for t in tables]
    values = reduce(DataFrame.unionAll, parts).distinct()
    small = values.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("label")
    return values.join(small, "label", "left_semi")


def text_domains(frames: dict[str, DataFrame], most: int = MAX_DOMAIN, qualified: tuple[str, ...] = ()) -> DataFrame:
    """(label, value) of every text column of all tables that has at most
    ``most`` values over all tables that have it; ``qualified`` columns stand for
    themselves in each table, as table.column.

    A task keeps at most ``most`` values of a column and then only that there
    are more, so that wide columns are never shuffled."""

    def capped(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, set | None] = {n: set() for n in names}
            for batch in batches:
                for n, column in zip(names, batch.columns, strict=True):
                    if seen[n] is not None:
                        seen[n].update(column.unique().drop_null().to_pylist())
                        if len(seen[n]) > most:
                            seen[n] = None
            rows = [(n, v) for n, values in seen.items() for v in ([None] if values is None else values)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["label", "value"])

        return run

    parts = []
    for t, df in sorted(frames.items()):
        texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        if texts:
            labels = [f"{t}.{c}" if c in qualified else c for c in texts]
            parts.append(df.select([F.col(f"`{c}`") for c in texts]).mapInArrow(capped(labels), "label string, value string"))
    values = reduce(DataFrame.unionAll, parts).distinct()  # null: too many
    small = values.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("over")).where((F.col("n") <= most) & (F.col("over") == 0)).select("label")
    return values.join(small, "label", "left_semi")


def table_order(frames: dict[str, DataFrame], curated: tuple[str, ...] = ()) -> DataFrame:
    """(place, table_name, n): tables in the curated order, then the others by
    name, with their rows; curated names without a table are left out."""
    names = [t for t in curated if t in frames] + sorted(set(frames) - set(curated))
    place = F.array_position(F.array(*(F.lit(t) for t in names)), F.col("table_name")).cast("int")
    return row_counts(frames).select(place.alias("place"), "table_name", "n")


def ordered(values: DataFrame, curated: dict[str, list[str]]) -> DataFrame:
    """(label, value, place): curated values first, the rest by alphabet."""
    rank = F.lit(None).cast("int")
    for label, order in curated.items():
        for i, value in enumerate(order):
            rank = F.when((F.col("label") == label) & (F.col("value") == value), i).otherwise(rank)
    w = Window.partitionBy("label").orderBy(F.coalesce(rank, F.lit(10**6)), "value")
    return values.withColumn("place", F.row_number().over(w))


def orphans(frames: dict[str, DataFrame], keys: dict = T.FOREIGN_KEYS) -> DataFrame:
    """(key, n): rows without the row that they refer to."""
    parts = []
    for (table, column), (other, target) in keys.items():
        lost = frames[table].select(F.col(column).alias("k")).where("k is not null").join(frames[other].select(F.col(target).alias("k")), "k", "left_anti")
        parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"{table}.{column}").alias("key"), "n"))
    return reduce(DataFrame.unionAll, parts)


def drift(texts: DataFrame, schema: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """(table_name, column_name): names in texts, table.column, whose table is
    known but whose column is not."""
    known = F.create_map(*(F.lit(x) for t, cs in sorted(schema.items()) for x in (t, ",".join(["", *cs, ""]))))
    named = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"\b[a-z_]+\.[a-z_0-9]+\b"), 0)))
    names = texts.select(named.alias("name")).select(F.substring_index("name", ".", 1).alias("table_name"), F.substring_index("name", ".", -1).alias("column_name"))
    columns = F.try_element_at(known, F.col("table_name"))
    return names.where(columns.isNotNull() & ~F.contains(columns, F.concat(F.lit(","), "column_name", F.lit(",")))).distinct()


@dataclass
class Catalog:
    """Schemas with their facts, collected once; rendered as a card."""

    schema: dict[str, list[str]]
    counts: dict[str, int]
    values: dict[str, list[str]]
    order: tuple[str, ...] = ()  # tables that come first

    @classmethod
    def read(cls, frames: dict[str, DataFrame], enums: dict[str, list[str]] = ENUMS, order: tuple[str, ...] = ()) -> Catalog:
        counts = {r["table_name"]: r["n"] for r in row_counts(frames).collect()}
        values: dict[str, list[str]] = {}
        for r in sorted(domains(frames, enums).collect()):
            values.setdefault(r["label"], []).append(r["value"])
        return cls({t: df.columns for t, df in frames.items()}, counts, values, order)

    def card(self, width: int = 79) -> str:
        """Tables, enums and keys; names are never split across lines."""

        def wrap(head: str, items: list[str]) -> str:
            return textwrap.fill(f"{head}: {', '.join(items)}", width, subsequent_indent="  ", break_long_words=False, break_on_hyphens=False)

        lines = ["TABLES"] + [wrap(f"{t} ({self.counts.get(t, 0)} rows)", self.schema[t]) for t in sorted(self.schema, key=lambda t: (self.order.index(t) if t in self.order else len(self.order), t))]
        lines += ["VALUES"] + [wrap(k, v) for k, v in sorted(self.values.items())]
        lines += ["KEYS"] + [f"{a}.{b} -> {c}.{d}" for (a, b), (c, d) in T.FOREIGN_KEYS.items()]
        return "\n".join(lines)

    def compact(self) -> str:
        """The card up to its keys."""
        return self.card().partition("\nKEYS")[0]


FALLBACK_CARD = "TABLES\nno tables are loaded"
