import math

from heliograph.operators.regular_grid import missing_minutes, regular_minutes

CH = "ticker string, sidx long, price double, ts long, price_data string, chunk long"
BL = "idx long, block long"


def brute(rows, blocks, tickers, max_gap):
    hours = {b // 300 for _, b in blocks if b is not None}
    grid = sorted(h * 60 + m for h in hours for m in range(60))
    out = {}
    for t in tickers:
        best = {}
        for tk, s, p, ts, *_ in rows:
            if tk == t and s is not None and p is not None and p > 0 and math.isfinite(p):
                best[s] = max(best.get(s, (-math.inf, 0)), (-math.inf if ts is None else ts, p))
        for s in grid:
            before = max((x for x in best if x <= s), default=None)
            after = min((x for x in best if x >= s), default=None)
            if s in best:
                out[t, s] = ("observed", best[s][1])
            elif before is None and after is None:
                out[t, s] = ("missing", None)
            elif before is None or after is None:
                out[t, s] = ("edge", None)
            elif after - before > max_gap:
                out[t, s] = ("gap", None)
            else:
                b, a = best[before][1], best[after][1]
                out[t, s] = ("interpolated", b + (a - b) * (s - before) / (after - before))
    return out


def rows_and_blocks():
    rows = [("ETH", 60, 10.0, 1, None, 7), ("ETH", 63, 13.0, 2, None, 7), ("ETH", 63, 14.0, 3, None, 7), ("ETH", 63, 99.0, None, None, 7), ("ETH", 64, 0.0, 4, None, 7)]
    rows += [("ETH", 70, float("nan"), 4, None, 7), ("ETH", 71, float("inf"), 4, None, 7), ("ETH", 72, -1.0, 4, None, 7), ("ETH", 73, None, 4, None, 7), ("ETH", 110, 20.0, 9, None, 7)]
    rows += [(None, 61, 5.0, 1, None, 7), ("ETH", None, 5.0, 1, None, 7), ("OTHER", 61, 5.0, 1, None, 7), ("CADUSD", 250, 3.0, 1, None, 7), ("ETH", 63, 14.0, 3, None, 7)]
    blocks = [(0, 300), (1, 599), (2, 1203), (3, None), (4, 300), (None, 301)]
    return rows, blocks


def test_against_brute_force(spark):
    rows, blocks = rows_and_blocks()
    for chunk in (7, 60, 5000):
        got = regular_minutes(spark.createDataFrame(rows, CH), spark.createDataFrame(blocks, BL), ("ETH", "CADUSD", "XAGUSD"), max_gap=10, chunk=chunk).collect()
        assert {(r.ticker, r.sidx): (r.status, r.price) for r in got} == brute(rows, blocks, ("ETH", "CADUSD", "XAGUSD"), 10)
        assert len(got) == 3 * 120


def test_missing_minutes_and_empty_tables(spark):
    rows, blocks = rows_and_blocks()
    c, b = spark.createDataFrame(rows, CH), spark.createDataFrame(blocks, BL)
    found = missing_minutes(c, b, ("ETH",)).collect()
    assert len(found) == 120 - 3 and len(set(found)) == len(found)
    assert missing_minutes(c, b.limit(0)).count() == 0
    assert {r.status for r in regular_minutes(c.limit(0), b, ("ETH",)).collect()} == {"missing"}
