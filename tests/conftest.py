import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from orbframe.session import tune

    yield tune(s)
    s.stop()


@pytest.fixture
def frames(spark):
    """``frames({(clip, f): array[h, w]}, name)`` -> pixel rows."""
    import numpy as np

    def make(images, names=("d",)):
        rows = []
        for (clip, f), img in images.items():
            a = np.asarray(img)
            a = a[..., None] if a.ndim == 2 else a
            for y in range(a.shape[0]):
                for x in range(a.shape[1]):
                    rows.append((clip, f, y, x, *[v.item() for v in a[y, x]]))
        kind = {"d": "double", "hole": "boolean"}
        cols = ", ".join(f"{n} {kind.get(n, 'int')}" for n in names)
        return spark.createDataFrame(rows, f"clip string, f int, y int, x int, {cols}")

    return make


@pytest.fixture
def image():
    """Pixel rows back to one array per frame."""
    import numpy as np

    def make(df, names=("d",)):
        pdf = df.toPandas()
        out = {}
        for key, g in pdf.groupby(["clip", "f"]):
            a = np.full((g.y.max() + 1, g.x.max() + 1, len(names)), np.nan)
            for i, n in enumerate(names):
                a[g.y, g.x, i] = g[n].astype(float)
            out[key] = a[..., 0] if len(names) == 1 else a
        return out

    return make
