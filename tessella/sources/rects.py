"""Rectangle sources: headerless CSV, scaled CSV, named catalogues, samples; and the sinks of run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geometry import SIDES, normalised, scaled

_CORNERS = "x1 {0}, y1 {0}, x2 {0}, y2 {0}"


def read_rects(spark: SparkSession, path: str) -> DataFrame:
    """Integer corners; any line that isn't four integers fails the read, an empty file has no rows."""
    lines = _strict(spark, path, "int")
    return lines.select(*normalised("x1", "y1", "x2", "y2"))


def read_scaled_rects(spark: SparkSession, path: str, factor: float = 1e8) -> DataFrame:
    """Double corners times factor, rounded half away from zero."""
    lines = _strict(spark, path, "double")
    return lines.select(*[scaled(c, factor).alias(c) for c in ("x1", "y1", "x2", "y2")]).select(*normalised("x1", "y1", "x2", "y2"))


def _strict(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Four numbers a line. Text is read as it is, as the CSV reader would skip blank lines instead of failing."""
    number = r"\s*[+-]?\d+" if kind == "int" else r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    parts = F.split("value", ",")
    bad = F.raise_error(F.concat(F.lit("not a rectangle: "), F.col("value")))
    row = F.when(F.col("value").rlike(f"^{number}(?:,{number}){{3}}\\s*$"), F.transform(parts, lambda p: F.trim(p).cast(kind))).otherwise(bad)
    return spark.read.text(path).select(row.alias("r")).select(*[F.col("r")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


class Catalogue:
    """Datasets and their query sets by name, for readers that take an option."""

    def __init__(self, data: dict[str, str] | None = None, queries: dict[tuple[str, str], str] | None = None):
        self.data, self.queries = dict(data or {}), dict(queries or {})

    def objects(self, spark: SparkSession, name: str, factor: float | None = None) -> DataFrame:
        path = self._of(self.data, name)
        return read_scaled_rects(spark, path, factor) if factor else read_rects(spark, path)

    def query_set(self, spark: SparkSession, name: str, share: str) -> DataFrame:
        return read_rects(spark, self._of(self.queries, (name, share)))

    @classmethod
    def of_folder(cls, folder: str, names: list[str], shares: list[str]) -> Catalogue:
        """Sets laid out as folder/name.csv, their query samples as folder/name_share.csv (share: per cent, as "5")."""
        return cls({n: f"{folder}/{n}.csv" for n in names}, {(n, s): f"{folder}/{n}_{s}.csv" for n in names for s in shares})

    def register(self, spark: SparkSession, factors: dict[str, float] | None = None) -> list[str]:
        """Temporary views objects_name and queries_name_share of all sets, for SQL; their names."""
        made = []
        for name in self.data:
            self.objects(spark, name, (factors or {}).get(name)).createOrReplaceTempView(f"objects_{name}")
            made.append(f"objects_{name}")
        for name, share in self.queries:
            self.query_set(spark, name, share).createOrReplaceTempView(f"queries_{name}_{share}")
            made.append(f"queries_{name}_{share}")
        return made

    @staticmethod
    def _of(known: dict, key: object) -> str:
        if key not in known:
            raise KeyError(f"{key!r} is not in the catalogue; it has {sorted(map(str, known))}")
        return known[key]


def sampled_queries(objects: DataFrame, every: int, id_column: str = "id") -> DataFrame:
    """Queries that follow the data: objects whose id is a multiple of every, numbered from 0 by id."""
    from tessella.operators.ranks import global_row_number

    chosen = objects.filter(F.pmod(F.col(id_column), F.lit(every)) == 0)
    return global_row_number(chosen, [id_column], "qid").select("qid", *SIDES)


def query_sets(objects: DataFrame, shares: dict[str, int], id_column: str = "id") -> DataFrame:
    """(share, queries, ids): how many queries each named sample has, and the sum of their ids. One scan."""
    names = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(e).alias("every")) for s, e in shares.items()])
    each = objects.select(F.col(id_column).alias("id"), F.explode(names).alias("s")).filter(F.pmod("id", F.col("s.every")) == 0)
    return each.groupBy(F.col("s.share").alias("share")).agg(F.count("*").alias("queries"), F.sum("id").alias("ids"))


def append_record(spark: SparkSession, path: str, **values: object) -> None:
    """Appends one run's figures as JSON."""
    spark.createDataFrame([{k: v for k, v in values.items()}]).coalesce(1).write.mode("append").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def write_csv(rects: DataFrame, path: str) -> None:
    """Headerless sides, as read_rects takes them."""
    rects.select(*SIDES).write.mode("errorifexists").csv(path)


def dump(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text."""
    return df._show_string(rows, False)
