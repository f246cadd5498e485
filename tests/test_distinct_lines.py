"""Lines once each, and what the shuffle carries to find that out."""

import re

from hitscope.sources import logs


def test_once_each_per_file(spark):
    rows = [("f", x) for x in ("a", "b", "a", "", "", "c", "a")] + [("g", "a"), ("g", "a"), ("g", "d"), (None, "a"), (None, "a")]
    df = spark.createDataFrame(rows, "_file string, line string").repartition(4)
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, logs.distinct_lines(df).collect()), key=key) == sorted(set(rows), key=key)


def test_lines_that_do_not_repeat_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"line {i} " + "x" * 300 for i in range(3000)) + "\nline 5 " + "x" * 300 + "\n")
    lines = spark.read.text(str(tmp_path)).withColumnRenamed("value", "line").selectExpr("'f' as _file", "line")
    got = logs.distinct_lines(lines)
    assert got.count() == 3000
    got = got.filter("line != ''")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert set(re.findall(r"BroadcastHashJoin[^\n]*(LeftAnti|LeftSemi)", final)) == {"LeftAnti", "LeftSemi"}
