"""Make this package importable where Python workers run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

_shipped: set[str] = set()

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch, unless the session says otherwise: whole texts of 100 kB then make 200 MB at most.
TEXT_ROWS = 2000


def ship(df: DataFrame) -> DataFrame:
    """Send the package to the executors of df's application, once; returns df.

    Functions that run in Python workers are pickled by reference, so their modules have to be there. The default batch of 10,000 rows is made smaller.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="tidewarp-code-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
        conf = df.sparkSession.conf
        if conf.get(BATCH, None) in (None, "10000"):
            conf.set(BATCH, str(TEXT_ROWS))
    return df
