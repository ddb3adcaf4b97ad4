"""The session takes what the submit command sets; written tables need the shared folder's setting."""
import json
import os
import subprocess
import sys

import pytest

from siftkit.session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = """
import json
from siftkit.session import SCAN_PARTITIONS, SHARED_DIR, build_session
spark = build_session(**{given})
print("GOT", json.dumps({{k: spark.conf.get(k, None) for k in ("spark.master", "spark.sql.shuffle.partitions", SCAN_PARTITIONS, SHARED_DIR,
                                                              "spark.sql.session.timeZone")}}))
spark.stop()
"""


def settings(tmp_path, submit: str, given: dict | None = None) -> dict:
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"{submit} pyspark-shell", "SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", SHOW.format(given=given or {})], env=env, cwd=ROOT, capture_output=True, text=True, timeout=120)
    return json.loads(out.stdout.split("GOT", 1)[1])


def test_submit_settings_hold(tmp_path):
    got = settings(tmp_path, "--master local[3] --conf spark.sql.shuffle.partitions=77 --conf spark.checkpoint.dir=/x/y "
                             "--conf spark.ui.enabled=false --conf spark.sql.session.timeZone=Asia/Tokyo")
    assert got == {"spark.master": "local[3]", "spark.sql.shuffle.partitions": "77", "spark.siftkit.scanPartitions": None,
                   "spark.checkpoint.dir": "/x/y", "spark.sql.session.timeZone": "Asia/Tokyo"}


def test_local_defaults_and_given_settings(tmp_path):
    got = settings(tmp_path, "--conf spark.ui.enabled=false", {"spark.master": "local[2]"})
    assert got["spark.master"] == "local[2]" and got["spark.sql.session.timeZone"] == "UTC"
    assert got["spark.siftkit.scanPartitions"] is None and got["spark.checkpoint.dir"]


def test_no_shared_folder_is_an_error(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    assert shared_dir(spark)
