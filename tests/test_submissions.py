import json

from pyspark.sql import functions as F

from heliograph.operators import filters, submissions

SPEC = "ordinal int, ticker string, name string, loss_func string, dim int, assets array<string>"
TASKS = [
    (0, "BIN", "BIN-NAME", "binary", 2, None), (1, "FIRST", "FIRST-NAME", "hitfirst", 3, None), (2, "PATH", "PATH-NAME", "lbfgs", 6, None),
    (3, "PAIR", "PAIR-NAME", "range_breakout_multi", 2, ["A", "B"]), (4, "RANK", "RANK-NAME", "xsec_rank", 1, ["A", "B", "C", "D"]),
]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = submissions.vectors(submissions.entries(df, "text", spark.createDataFrame(TASKS, SPEC), ["id"])).collect()
    out = {}
    for r in got:
        out.setdefault(r.id, {})[r.ticker] = r.vec
    return out


ZERO = {"BIN": [0.0] * 2, "FIRST": [0.0] * 3, "PATH": [0.0] * 6, "PAIR": [0.0] * 4, "RANK": [0.0] * 4}


def test_lists_objects_and_refusals(spark):
    path = [0.2, 0.2, 0.2, 0.2, 0.2, 2.0]
    full = [[0.5, -1], [0.1, 0.2, 0.3], path, {"A": [0.1, 0.9], "B": [0.1, 1.2]}, {"A": 0.5, "B": [3], "C": 1.5, "D": "x"}]
    got = run(spark, [
        json.dumps(full), json.dumps(full[:4]), json.dumps({"BIN-NAME": [0.1, 0.2], "hotkey": "x", "other": 1}), json.dumps({"BIN": [0.3, 0.3], "BIN-NAME": [0.1, 0.2]}),
        json.dumps({"BIN": [0.3, 1.3], "FIRST": [1, 2], "RANK": {"A": True, "B": None, "C": [0.5, 0.5], "D": -1}, "PAIR": [1]}), "{", None, '"text"',
    ])
    assert got[0] == {"BIN": [0.5, -1.0], "FIRST": [0.1, 0.2, 0.3], "PATH": [0.2] * 5 + [1 - 1e-6], "PAIR": [0.1, 0.9, 0.0, 0.0], "RANK": [0.5, 1.0, 0.0, 0.0]}
    assert got[1] == ZERO
    assert got[2] == {**ZERO, "BIN": [0.1, 0.2]}
    assert got[3] == {**ZERO, "BIN": [0.3, 0.3]}
    assert got[4] == {**ZERO, "RANK": [1.0, 0.0, 0.0, -1.0]}
    assert 5 not in got and 6 not in got and got[7] == ZERO


def test_filters(spark):
    df = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 0), ("b", 0.5, 1), ("b", 0.5, 1), ("c", None, 0)], "k string, v double, y int")
    assert {r.k for r in filters.enough(df, ["k"], "v", "y", 2, 2).collect()} == {"a"}
    assert {(r.k, r.fresh) for r in filters.unstale(df, ["k"], "v", 0.01).collect()} == {("a", 0.1), ("a", 0.2), ("b", 0.0), ("c", 0.0)}
    assert filters.same_rows(df, df.orderBy("k")) and not filters.same_rows(df, df.limit(4))
    sent = spark.createDataFrame([(h, p, h == "old" or p > 95) for h in ("old", "new") for p in range(100)], "h string, p int, s boolean")
    assert [r.h for r in filters.probation(sent, "h", "p", "s", 99, 50, 10, 0.9).collect()] == ["old"]
    assert filters.active_share(df, ["k"], F.col("y") == 1, 0.9).count() == 1


def test_made_up_submissions_are_valid(spark):
    import json

    from heliograph.operators.submissions import random_submissions

    spec = spark.createDataFrame([("A", 2, None), ("B", 2, ["x", "y"])], "ticker string, dim int, assets array<string>")
    rows = random_submissions(spark, spec, 5).collect()
    sent = [json.loads(r.payload) for r in rows]
    assert len(sent) == 5 and all(len(p["A"]) == 2 and set(p["B"]) == {"x", "y"} and all(0 <= v < 1 for v in [*p["A"], *p["B"]["x"], *p["B"]["y"]]) for p in sent)
    assert len({r.payload for r in rows}) == 5 and [r.payload for r in random_submissions(spark, spec, 5).orderBy("row").collect()] == [r.payload for r in sorted(rows)]
