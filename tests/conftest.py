import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g")
    session = builder.config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("checkpoint"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def voxels(spark):
    """Voxel tables from arrays by id."""
    import numpy as np
    import pandas as pd

    def make(**arrays):
        parts = []
        for k, (name, v) in enumerate(arrays.items()):
            v = np.asarray(v)
            v = v[..., None] if v.ndim == 2 else v
            x, y, z = (a.ravel() for a in np.indices(v.shape))
            parts.append(pd.DataFrame({"vol_id": int(name[1:]), "w": v.shape[0], "h": v.shape[1], "d": v.shape[2], "x": x, "y": y, "z": z, "v": v.ravel()}))
        return spark.createDataFrame(pd.concat(parts), "vol_id long, w int, h int, d int, x int, y int, z int, v int")

    return make
