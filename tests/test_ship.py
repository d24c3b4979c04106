"""Operators with Python workers where only the driver knows the package."""

import os
import subprocess
import sys
import zipfile
from pathlib import Path

from tidemark import ship

ROOT = Path(__file__).parents[1]
SCRIPT = """
import sys
from pyspark.sql import SparkSession, functions as F
sys.path.append(ROOT)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from tidemark.operators import dedupe
from tidemark.ship import ship
frames = spark.createDataFrame([("a", i, i // 3 * 7) for i in range(9)], "s string, ts long, h long")
ship(spark)
ship(spark)
print("KEPT", sorted(r.ts for r in dedupe.keep_changed(frames, ["s"], ["ts"], "h").collect()))
"""


def test_only_the_driver_knows_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", SCRIPT.replace("ROOT", repr(str(ROOT)), 1)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "KEPT [0, 3, 6]" in run.stdout, run.stderr[-2000:]


def test_archive(tmp_path):
    one, two = ship.archive(tmp_path / "a.zip"), ship.archive(tmp_path / "b.zip")
    assert one.read_bytes() == two.read_bytes()
    names = zipfile.ZipFile(one).namelist()
    assert "tidemark/operators/bursts.py" in names and not any("__pycache__" in n for n in names)
