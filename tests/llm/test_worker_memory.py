"""What an executor's workers hold: bounded batches, and little between the tasks of the pipeline."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

#: MB that a worker holds more after a task over 21 MB of text than after one of ten rows (without give_back(): 16 and 11).
HELD = """
import re, sys
from pathlib import Path
import numpy as np, pandas as pd
from hitscope.llm import nearcopies, substrings

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

r = np.random.default_rng(3)
words = ["".join(map(chr, r.integers(97, 123, 6))) for _ in range(30_000)]
pdf = pd.DataFrame({"text": [" ".join(words[k] for k in r.integers(0, len(words), 500)) for _ in range(6_000)]})
work = {"dealt": nearcopies._dealt(50), "count": substrings._count}[sys.argv[1]]
some = lambda n: iter([pdf[i : i + 1000] for i in range(0, n, 1000)])
for _ in work(iter([pdf[:10]])):
    pass
before = mb()
for _ in work(some(len(pdf))):
    pass
del _
print(mb() - before)
"""


@pytest.mark.parametrize("stage", ["dealt", "count"])
def test_workers_give_memory_back(stage):
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", HELD, stage], cwd=root, capture_output=True, text=True, check=True, timeout=300)
    assert float(out.stdout) < 7


def test_stages_bound_their_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    before = spark.conf.getAll.get(key)
    try:
        spark.conf.unset(key)
        corpus_pipeline.packed(spark, docs.limit(0), "")
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 4000 and max(r["bytes"] for r in got) < 5_000_000
        spark.conf.set(key, "1m")
        corpus_pipeline.packed(spark, docs.limit(0), "")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
