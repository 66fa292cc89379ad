"""The datasets of a catalogue as a Spark data source: spark.read.format("tidewarp").option("dataset", name).load(folder).

The schema is the catalogue's, without a look at the files. A Parquet dataset is read by row groups, a partition each;
filters on its columns are pushed down (Spark's plan keeps only the others), where they first leave out row groups by their statistics and then rows. A CSV dataset is
a partition a file, streamed in blocks, with its times parsed. register() makes the source known to a session
and takes the catalogue along to where it is planned and read.

It reads by pyarrow, so the folder must be a path of the file system that all executors see. What only Spark's own
readers can open, and large tables of which few columns are wanted (a Python source is asked for all of them), are
better read by SeriesCatalogue, which gives the same datasets.

Defined cases: a missing dataset or file is an error when planned. Nulls pass no comparison. Files without rows give none.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.csv
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from ..functions.shipping import ship
from .catalogue import KNOWN, Dataset

COMPARED = {
    D.EqualTo: lambda f, v: f == v,
    D.GreaterThan: lambda f, v: f > v,
    D.GreaterThanOrEqual: lambda f, v: f >= v,
    D.LessThan: lambda f, v: f < v,
    D.LessThanOrEqual: lambda f, v: f <= v,
    D.In: lambda f, v: f.isin(list(v)),
}
FORMAT = "tidewarp"
#: Types of CSV columns by what the catalogue calls them.
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


@dataclass
class Part(D.InputPartition):
    path: str
    group: int = -1


def _columns(dataset: Dataset) -> dict[str, str]:
    return dict(x.split(" ", 1) for x in dataset.schema.split(", "))


def _as_stored(value, kind: pa.DataType):
    """A time with or without a zone (UTC), as the file has it."""
    if isinstance(value, dt.datetime) and pa.types.is_timestamp(kind):
        value = value.astimezone(dt.timezone.utc) if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return value if kind.tz else value.replace(tzinfo=None)
    return value


def _expression(found: D.Filter, stored: dict[str, pa.DataType]):
    """A filter for pyarrow; None for what Spark has to look at itself."""
    name = found.attribute[0] if hasattr(found, "attribute") and len(found.attribute) == 1 else None
    if name not in stored:
        return None
    field = pyarrow.dataset.field(name)
    if isinstance(found, D.IsNotNull | D.IsNull):
        return field.is_valid() if isinstance(found, D.IsNotNull) else field.is_null()
    if type(found) in COMPARED and found.value is not None:
        value = tuple(_as_stored(v, stored[name]) for v in found.value) if isinstance(found, D.In) else _as_stored(found.value, stored[name])
        return COMPARED[type(found)](field, value)
    return None


class SeriesReader(D.DataSourceReader):
    def __init__(self, dataset: Dataset, folder: str, schema: StructType):
        place = urlparse(folder)
        if place.scheme not in ("", "file"):
            raise ValueError(f"{folder} is no path of the file system; read it by SeriesCatalogue")
        self.dataset, self.schema, self.filters = dataset, schema, []
        self.path = Path(place.path) / f"{dataset.name}.{dataset.format}"
        if not self.path.exists():
            raise ValueError(f"there is no {self.path}")

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        stored = self._stored() if self.dataset.format == "parquet" else {}
        for x in filters:
            if _expression(x, stored) is None:
                yield x
            else:
                self.filters.append(x)

    def _stored(self) -> dict[str, pa.DataType]:
        wanted = _columns(self.dataset)
        return {f.name: f.type for f in pyarrow.dataset.dataset(str(self.path), format="parquet").schema if f.name in wanted}

    def _wanted(self):
        stored = self._stored() if self.filters else {}
        every = [_expression(x, stored) for x in self.filters]
        return reduce(lambda a, b: a & b, every) if every else None

    def _fragments(self):
        return pyarrow.dataset.dataset(str(self.path), format="parquet").get_fragments()

    def partitions(self) -> list[Part]:
        if self.dataset.format == "parquet":
            parts = (Part(x.path, x.row_groups[0].id) for f in self._fragments() for x in f.split_by_row_group(self._wanted()))
        else:
            parts = (Part(str(x)) for x in (sorted(self.path.glob("*.csv")) if self.path.is_dir() else [self.path]))
        return list(parts) or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        if not part.path:
            return
        if part.group >= 0:
            fragment = pyarrow.dataset.ParquetFileFormat().make_fragment(part.path, pyarrow.fs.LocalFileSystem(), row_groups=[part.group])
            batches = fragment.to_batches(columns=self.schema.names, filter=self._wanted(), batch_size=10_000)
        else:
            kinds = _columns(self.dataset)
            time = self.dataset.spec.time if self.dataset.time_format else None
            types = {c: pa.timestamp("us") if c == time else ARROW[k] for c, k in kinds.items()}
            parsers = [self.dataset.time_format.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d").replace("HH", "%H").replace("mm", "%M").replace("ss", "%S")] if time else []
            batches = pyarrow.csv.open_csv(part.path, convert_options=pyarrow.csv.ConvertOptions(column_types=types, include_columns=list(kinds), timestamp_parsers=parsers, strings_can_be_null=True))
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in target], schema=target)


class SeriesFormat(D.DataSource):
    known: dict[str, Dataset] = KNOWN

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _dataset(self) -> Dataset:
        wanted = self.options.get("dataset")
        if wanted not in self.known:
            raise ValueError(f"no dataset named {wanted}; there are {sorted(self.known)}")
        return self.known[wanted]

    def schema(self) -> str:
        dataset = self._dataset()
        kinds = _columns(dataset)
        if dataset.format == "csv" and dataset.time_format:
            kinds[dataset.spec.time] = "timestamp_ntz"
        return ", ".join(f"`{c}` {k}" for c, k in kinds.items())

    def reader(self, schema: StructType) -> SeriesReader:
        return SeriesReader(self._dataset(), self.options["path"], schema)


def register(spark: SparkSession, known: dict[str, Dataset] | None = None) -> None:
    """Make the format known to a session, with the datasets of a catalogue; filters are pushed to Python sources from then on."""
    ship(spark.range(0))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # A class of its own, made here, so that it goes along by value with its datasets.
    spark.dataSource.register(type("CatalogueFormat", (SeriesFormat,), {"known": dict(KNOWN if known is None else known), "__module__": "__main__"}))
