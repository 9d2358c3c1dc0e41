"""Python workers outlive their tasks: what they hold between tasks counts against an executor while the JVM works."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
MOST_MB = 115
#: Prints the MB that the one worker holds once a task over 30 MB of text has ended.
SCRIPT = """
import re
import sys
from pathlib import Path
import numpy as np
import psutil
from pyspark.sql import SparkSession
from silvatrack.llm import token_output
spark = (SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.warehouse.dir", sys.argv[1]).getOrCreate())
rng = np.random.default_rng(1)
words = np.array(["".join(map(chr, rng.integers(97, 123, rng.integers(2, 12)))) + rng.choice(["", "1", "é"]) for _ in range(100_000)])
rows = [(i, " ".join(words[rng.integers(0, len(words), 400)])) for i in range(10_000)]
spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(sys.argv[1] + "/docs")
docs = spark.read.parquet(sys.argv[1] + "/docs")
token_output.write_tokens(docs).count()
held = [sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text()))) >> 10
    for p in psutil.Process().children(recursive=True) if p.name().startswith("python")]
print("held", max(held))
"""


def test_a_worker_gives_memory_back_when_its_task_ends(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": str(REPO)})
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout.split("held ")[-1]) <= MOST_MB
