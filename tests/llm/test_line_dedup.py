from pyspark.sql import functions as F

from stacklight.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least=10):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


ROWS = [
    (5, "the same line here\nshort\nonly in five, surely\n"), (2, "  THE same LINE here\t\nshort\nthe same line here"), (9, "the same line here"), (7, None), (8, ""), (3, "\n\n"),
    (11, "x" * 100000 + "\nthe same line here\r\n" + "\n".join(f"line number {i}" for i in range(500))), (12, "\n".join(f"Line Number {i}" for i in range(400, 700))),
    (20, "ÄÖÜ äöü ÄÖÜ äöü"), (21, "äöü äöü äöü äöü"), (22, " the same line here"), (None, "the same line here\nno id has this line"), (None, "no id has this line"), (9, "the same line here"),
]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("h1", "gone", "owner", "__id", "__gone", "gone_id", "n_lines", "part", "n")})
    for batches in (1, 3, 7):
        got = line_dedup.drop_repeated_lines(docs, batches=batches)
        assert {"h1", "gone", "owner", "__id", "__gone"} < set(got.columns) and len(set(got.columns)) == len(got.columns)
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == brute(ROWS)


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_merge_by_level(spark):
    runs = line_dedup.SortedRuns(spark, fanout=2)
    for k in range(5):
        runs.add(runs.write(spark.createDataFrame([(k, j, k, 1) for j in range(10)], "h1 long, h2 long, owner long, n long").repartition(runs.buckets, "h1", "h2")))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    keys = spark.createDataFrame([(k, 3, 9, 2) for k in range(7)], "h1 long, h2 long, owner long, n long")
    assert sorted((r.h1, r.owner, r.n) for r in runs.seen(keys).collect()) == [(k, k, 2) for k in range(5)]
    assert sorted(r.h1 for r in runs.unseen(keys).collect()) == [5, 6]
    files = spark.table(runs.levels[1][0] if runs.levels[1] else runs.levels[2][0]).inputFiles()
    assert len(files) <= runs.buckets
    runs.close()


def test_a_merge_does_not_shuffle(spark):
    runs = line_dedup.SortedRuns(spark)
    names = [runs.write(spark.createDataFrame([(k, j, k, 1) for j in range(10)], "h1 long, h2 long, owner long, n long").repartition(runs.buckets, "h1", "h2")) for k in range(2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table(names[0]).join(spark.table(names[1]), line_dedup.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "LeftAnti" in plan
    for n in names:
        runs.drop(n)


def test_runs_outlive_a_call_and_hot_lines_are_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    first, later = docs.where("doc_id <= 9"), docs.where("doc_id > 9 or doc_id is null")
    runs = line_dedup.SortedRuns(spark)
    got = line_dedup.drop_repeated_lines(first, batches=2, runs=runs).collect()
    again = line_dedup.SortedRuns(spark, levels=runs.levels, home=runs.home)
    got += line_dedup.drop_repeated_lines(later, batches=1, runs=again).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=repr) == brute(ROWS)
    again.close()


def test_no_python_on_the_executors(spark):
    plan = line_dedup.op4_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
