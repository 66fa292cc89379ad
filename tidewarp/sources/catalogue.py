"""Where series come from: files with a declared schema, and a catalogue of named datasets."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..series import SeriesSpec


@dataclass(frozen=True)
class Dataset:
    name: str
    schema: str
    spec: SeriesSpec
    time_format: str | None = None
    format: str = "csv"


#: The known datasets with their columns, time column, target and features.
KNOWN = {
    d.name: d
    for d in (
        Dataset("AirPassengers", "Month string, Passengers int", SeriesSpec((), "Month", "Passengers"), "yyyy-MM"),
        Dataset("Electric_Production", "date string, value double", SeriesSpec((), "date", "value"), "yyyy-MM-dd"),
        Dataset("Messages_Sent", "date string, ta int, tb int, tc int", SeriesSpec((), "date", "tc", ("ta", "tb")), "yyyy-MM-dd"),
        Dataset("Messages_Sent_Hour", "date string, ta int, tb int, tc int", SeriesSpec((), "date", "tc", ("ta", "tb")), "yyyy-MM-dd HH:mm:ss"),
        Dataset("Supermarket_Incoming", "date string, goods_cnt int", SeriesSpec((), "date", "goods_cnt"), "yyyy-MM-dd"),
        Dataset("Web_Sales", "date string, type_a int, type_b int, sales_cnt int", SeriesSpec((), "date", "sales_cnt", ("type_a", "type_b")), "yyyy-MM-dd"),
        *(
            Dataset(n, "date string, HUFL double, HULL double, MUFL double, MULL double, LUFL double, LULL double, OT double",
                    SeriesSpec((), "date", "OT", ("HUFL", "HULL", "MUFL", "MULL", "LUFL", "LULL")), "yyyy-MM-dd HH:mm:ss")
            for n in ("ETTh1", "ETTh2", "ETTm1", "ETTm2")
        ),
    )
}


def read_csv(spark: SparkSession, path: str, schema: str, time: str | None = None, time_format: str | None = None) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass); the time column parsed if a format is given."""
    df = spark.read.csv(path, header=True, schema=schema)
    if time and time_format:
        df = df.withColumn(time, F.to_timestamp_ntz(F.col(time), F.lit(time_format)))
    return df


@dataclass
class SeriesCatalogue:
    """Datasets by position or name, read from ``folder`` as <name>.csv, or <name>.parquet where the dataset's format says so."""

    spark: SparkSession
    folder: str
    known: dict[str, Dataset] = field(default_factory=lambda: dict(KNOWN))

    @property
    def names(self) -> list[str]:
        return list(self.known)

    def __len__(self) -> int:
        return len(self.known)

    def register(self, dataset: Dataset) -> None:
        self.known[dataset.name] = dataset

    def spec(self, which: int | str) -> SeriesSpec:
        return self._find(which).spec

    def _find(self, which: int | str) -> Dataset:
        name = self.names[which] if isinstance(which, int) else Path(which).stem
        if name not in self.known:
            raise KeyError(f"no dataset named {name}")
        return self.known[name]

    def __getitem__(self, which: int | str) -> DataFrame:
        d = self._find(which)
        if d.format == "parquet":
            return self.spark.read.schema(d.schema).parquet(f"{self.folder}/{d.name}.parquet")
        return read_csv(self.spark, f"{self.folder}/{d.name}.csv", d.schema, d.spec.time, d.time_format)

    def table(self) -> DataFrame:
        """The catalogue as rows."""
        rows = [(i, d.name, d.spec.time, d.spec.target, ",".join(d.spec.features)) for i, d in enumerate(self.known.values())]
        return self.spark.createDataFrame(rows, "position int, name string, time_col string, target_col string, feature_cols string")

    def __str__(self) -> str:
        return "\n".join(f"{i:>3}  {n}" for i, n in enumerate(self.names))


def _loader(name: str):
    def load(spark: SparkSession, folder: str) -> DataFrame:
        return SeriesCatalogue(spark, folder)[name]

    load.__name__ = f"load_{name.lower()}"
    return load


load_electric_production = _loader("Electric_Production")
load_messages_sent = _loader("Messages_Sent")
load_messages_sent_hour = _loader("Messages_Sent_Hour")
load_web_sales = _loader("Web_Sales")
load_supermarket_incoming = _loader("Supermarket_Incoming")


def daily(df: DataFrame, time: str, value, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ds, y): a value aggregated per day."""
    return df.groupBy(*keys, F.to_date(time).alias("ds")).agg(value.alias("y"))


def daily_revenue(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily order totals in units of 100,000, from whole cents, so the sum does not depend on its order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return daily(orders, "o_orderdate", F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.lit(1e7), keys)


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily number of events of each type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return daily(events, "ts", F.count(F.lit(1)).cast("double"), ("event_type",))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of events of each type in each hour that has any."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").alias("ds")).agg(F.count(F.lit(1)).cast("double").alias("y"))
