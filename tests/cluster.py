"""A small cluster of executor processes on this machine, of which one is killed while a query runs."""

import importlib.util
import json
import os
import subprocess
import sys
import textwrap
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import json, os, signal, sys, threading, time
import psutil
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[3,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.sql.shuffle.partitions", "6").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/shared").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
KILLED = []

def executors():
    out = []
    for p in psutil.Process().children(recursive=True):
        try:
            if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()):
                out.append(p)
        except psutil.Error:
            pass
    return out

def killer(after):
    tracker, ended = spark.sparkContext.statusTracker(), lambda: sum(1 for j in tracker.getJobIdsForGroup(None) if tracker.getJobInfo(j) and tracker.getJobInfo(j).status == "SUCCEEDED")
    start = ended()
    while ended() - start < after:
        time.sleep(0.02)
    while not (own := executors()):
        time.sleep(0.02)
    own[0].kill()
    KILLED.append(after)

def with_a_loss(run, after):
    # the rows of run(), one executor being killed when so many of its jobs have ended
    t = threading.Thread(target=killer, args=(after,), daemon=True)
    t.start()
    rows = sorted(str(r) for r in run().collect())
    t.join(0.1)
    return rows

out = {}
{body}
print("RESULT " + json.dumps({"out": out, "killed": len(KILLED)}))
spark.stop()
"""


def run(body: str, folder: Path) -> dict:
    """What the body, which fills `out`, gives on the cluster."""
    home = folder / "home"
    home.mkdir()
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors write their logs to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    script = folder / "script.py"
    script.write_text(SCRIPT.replace("{body}", textwrap.dedent(body)))
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(folder / "local"), "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_SUBMIT_ARGS": "--driver-memory 800m pyspark-shell"}
    done = subprocess.run([sys.executable, str(script), str(folder)], env=env, cwd=folder, capture_output=True, text=True, timeout=400)
    found = [x for x in done.stdout.splitlines() if x.startswith("RESULT ")]
    assert found, done.stderr[-3000:]
    return json.loads(found[0].removeprefix("RESULT "))
