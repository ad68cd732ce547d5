import json

from heliograph.functions.json_text import allow_repeated_keys, readable
from heliograph.operators.flatten import all_predictions, branch_table, payload_branches, payload_roots, present_predictions, state_branches, state_samples

RAW = "ts long, hotkey string, payload string, feed string, branches string"
STATE = "asset string, state_json string, ts long, src string"


def env(ct, **more):
    return json.dumps({"v": 2, "C": {"nonce": "a", "ct": ct}, **more})


def test_readable_is_the_whole_string(spark):
    allow_repeated_keys(spark)
    good = ['{"a":1}', ' [1, 2] ', '"x"', "null", "3", '{"a":"] x"}', '{"a":1,"a":2}', '{"a":{"b":[1,{"c":[]}]}}']
    bad = ['{"a":1} x', '{"a":1}{"b":2}', "1] [2", "1]", "1,2", '{"a":NaN}', "{'a':1}", '{"a":', "", "  ", '{"a":1,}', "1] %", '{"a":1}],[{"b":2}', '1,"end of text 5d1f2a"']
    df = spark.createDataFrame([(x,) for x in [*good, *bad]] + [(None,)], "p string")
    assert {r.p for r in df.where(readable("p").isNotNull()).collect()} == set(good)


def test_shapes_of_payloads(spark):
    rows = [
        (1, "h1", env({"MULTIXSEC": {"BTC": 0.5, "ETH": [0.1], "SOL": None}, "ETH": [0.1, 0.2], "hotkey": "h1"}), "f", "x"),
        (2, "h2", env({"XSEC-RANK": [{"asset": "BTC", "val": 1}, {"asset": "ETH", "val": None}]}), "f", "x"),
        (3, "h3", env({"TRADE-MIX": {"asof": 7, "assets": {"TAO": 0.3}}, "FUNDINGXSEC": {}, "MULTIBREAKOUT": []}), "f", "x"),
        (4, "h4", env(json.dumps({"MULTI-BREAKOUT": {"BTC": [0.1, 0.2]}})), "f", "x"),
        (5, "h5", "[" + env({"MULTIXSEC": {"BTC": 1}}) + "]", "f", "x"),
        (6, "h6", env({"MULTIXSEC": {"BTC": 1}})[:-1], "f", "x"),
        (7, "h7", None, "f", "x"), (8, "h8", "", "f", "x"), (9, "h9", "{}", "f", "x"), (10, "h10", env("not json"), "f", "x"), (11, "h11", env({"MULTIXSEC": 5}), "f", "x"),
        (12, None, env({"MULTIXSEC": {"BTC": 1}}), None, "x"),
    ]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, RAW)
    none = spark.createDataFrame([], STATE)
    flat = all_predictions(df, none)
    got = {tuple(r) for r in present_predictions(flat).collect()}
    raw = "raw_payloads"
    assert got == {
        (raw, 1, "h1", "MULTIXSEC", "BTC"), (raw, 1, "h1", "MULTIXSEC", "ETH"), (raw, 2, "h2", "MULTIXSEC", "BTC"), (raw, 3, "h3", "TRADEMIX", "TAO"),
        (raw, 4, "h4", "MULTIBREAKOUT", "BTC"), (raw, 5, "h5", "MULTIXSEC", "BTC"), (raw, 12, None, "MULTIXSEC", "BTC"),
    }
    kept = flat.where("ts = 1").collect()
    assert len(kept) == 6 and len({r.row_id for r in kept}) == 1
    assert {(r.leaf_no, r.leaf, r.value) for r in kept} == {(0, "BTC", "0.5"), (1, "ETH", "[0.1]"), (2, "SOL", None)}
    parents = {(r.row_id, r.branch_no) for r in branch_table(payload_branches(df)).collect()}
    assert {(r.row_id, r.branch_no) for r in flat.collect()} <= parents


def test_shapes_of_states(spark):
    s = lambda t, e: {"trigger_sidx": t, "embeddings": e}
    states = [
        ("BTC", json.dumps({"pending_high": s(1, {"a": [0.1, 0.2], "b": None}), "pending_low": None, "completed": [s(2, [{"hotkey": "c", "vec": [1]}, {"hotkey": "d", "vec": None}]), {"trigger_sidx": 3}, None]}), 1, "x"),
        ("ETH", json.dumps({"completed": {"up": [s(4, {"miners": {"e": [1, 2]}, "n": 1})], "down": [s(5, {})]}}), 2, "x"),
        ("SOL", json.dumps(json.dumps({"pending_low": s(6, {"f": [1]})})), 3, "x"),
        ("TAO", json.dumps({"saved": 9, "state": {"pending_low": s(7, {"g": [1]}), "completed": None}}), 4, "x"),
        ("XRP", '{"pending_low": {"trigger_sidx": 1', 5, "x"), ("ADA", None, 6, "x"), (None, json.dumps([1]), 7, "x"),
    ]
    flat = all_predictions(spark.createDataFrame([], RAW), spark.createDataFrame(states, STATE))
    assert {tuple(r)[1:] for r in present_predictions(flat).collect()} == {
        (1, "BTC", "pending_high:1", "a"), (1, "BTC", "completed:2", "c"), (2, "ETH", "completed:4", "e"), (3, "SOL", "pending_low:6", "f"), (4, "TAO", "pending_low:7", "g"),
    }
    assert state_branches(spark.createDataFrame([], STATE)).count() == 0


def test_roots_and_samples_link_to_their_children(spark):
    rows = [(1, "h", env({"ETH": [0.1, 0.2], "MULTIXSEC": {"BTC": 1}, "hotkey": "h"}, round=7, W_owner={"pke": "a", "x": None, "y": {}}, tags=[1]), "f", "x"), (2, "k", "[" + env(json.dumps({"CAD": [1]})) + "]", "f", "x"), (3, "z", "5", "f", "x"), (4, "z", "{", "f", "x"), (5, None, None, None, "x")]
    df = spark.createDataFrame(rows, RAW)
    got = {r.ts: r for r in payload_roots(df).collect()}
    assert set(got) == {1, 2} and got[1].scalars == {"v": "2", "round": "7"} and got[1].owner == {"pke": "a"} and got[1].vectors == {"ETH": [0.1, 0.2]} and got[2].vectors == {"CAD": [1.0]}
    assert {r.row_id for r in payload_branches(df).collect() if r.branches} == {got[1].row_id}
    states = spark.createDataFrame([("BTC", json.dumps({"pending_high": {"trigger_sidx": 1, "price": 2.5, "embeddings": {"a": [1]}}, "completed": [{"trigger_sidx": 3, "label": None}]}), 1, "x"), ("ETH", "{", 2, "x")], STATE)
    samples = {(r.branch_no, r.branch): r.scalars for r in state_samples(states).collect()}
    assert samples == {(0, "pending_high:1"): {"trigger_sidx": "1", "price": "2.5"}, (1, "completed:3"): {"trigger_sidx": "3"}}
    assert {(r.branch_no, r.branch) for r in branch_table(state_branches(states)).collect()} == set(samples)
    assert payload_roots(df.limit(0)).count() == state_samples(states.limit(0)).count() == 0
