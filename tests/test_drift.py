import json
import random

from heliograph.operators.drift import all_changes, canonical_names, consistent_payloads, listing_changes, payload_alternatives, payload_changes

RAW = "ts long, hotkey string, payload string, feed string, file_no long, path string"
META = "ticker string, dim int, blocks_ahead int, release_no int"
TASKS = {"ETH": "ETH", "ETH-1H": "ETH", "CAD": "CAD"}


def payload(rnd, who, f):
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    owner, build = f"{who * 7919:016x}", 2000 + who
    p = {"v": 2, ("hk" if f < 2 else "miner"): f"5x{who}abc", ("round" if f < 3 else "rnd"): 5_400_000 + f * 10, "binding": hexa(12)}
    p["W_owner"] = {"ct": hexa(8)} if f >= 4 else {"nonce": hexa(6), "ct": hexa(8)}
    if f >= 4:
        p["w_nonce"] = hexa(6)
    if f != 5:
        p["owner_pk"] = owner
    if f >= 5:
        p["pke"] = hexa(12)[:11] + str(who % 10)
    if f >= 2:
        p["build"] = build if f < 4 else str(build)
    p["C"] = {"ct": {("ETH" if f < 3 else "ETH-1H"): [0.1] * (2 if f < 4 else 3), "hotkey": "x", "MULTIXSEC": {}}}
    if f == 3:
        p["C"]["ct"] = json.dumps(p["C"]["ct"])
    text = json.dumps(p)
    return f"[{text}]" if rnd.random() < 0.1 else text


def table(files=6, rows=60):
    rnd = random.Random(4)
    out = []
    for f in range(files):
        for i in range(rows):
            out.append((i, f"h{i}", payload(rnd, rnd.randrange(40), f), "a", f * 3, "x"))
        out += [(0, "h", None, "a", f * 3, "x"), (0, "h", "{", "a", f * 3, "x"), (0, "h", "", "a", f * 3, "x"), (0, "h", json.dumps({"stray": 1}), "a", f * 3, "x")]
    return [*out, (0, "h", "{}", None, 1, "x"), (0, "h", "{}", "a", None, "x"), (0, "h", "{", "b", 1, "x"), (0, "h", "{}", "b", 2, "x")]


def test_all_kinds_of_changes(spark):
    df = spark.createDataFrame(table(), RAW)
    got = {tuple(r) for r in payload_changes(df, TASKS).collect()}
    assert got == {
        ("a", 6, "renamed", "hk", "miner"), ("a", 6, "added", "", "build"), ("a", 9, "renamed", "round", "rnd"), ("a", 9, "renamed", "C.ct.ETH", "C.ct.ETH-1H"),
        ("a", 12, "renamed", "W_owner.nonce", "w_nonce"), ("a", 12, "retyped", "build", "build"), ("a", 12, "resized", "C.ct.ETH-1H", "C.ct.ETH-1H"),
        ("a", 15, "removed", "owner_pk", ""), ("a", 15, "added", "", "pke"),
    }
    names = canonical_names(payload_changes(df, TASKS))
    assert names["miner"] == names["hk"] == "hk" and names["rnd"] == "rnd"
    rows = consistent_payloads(df, names).collect()
    assert len(rows) == 6 * 61 + 3
    first = next(r for r in rows if r.file_no == 12 and "build" in r.fields)
    assert first.fields["build"].kind == "string" and first.fields["build"].number is None and first.fields["build"].canonical == first.fields["build"].string
    assert all("miner" not in r.fields for r in rows)


def test_the_kind_is_chosen_before_the_width(spark):
    shapes = [[0.1, 0.2]] * 4 + [[0.1, 0.2, 0.3]] * 3 + [5] * 5
    rows = [(i, "h", json.dumps({"C": {"ct": {"ETH": v}}}), "a", f, "x") for f in (0, 1) for i, v in enumerate(shapes if f else [[0.1, 0.2]] * 12)]
    assert payload_changes(spark.createDataFrame(rows, RAW), TASKS).collect() == []


def test_the_consistent_table_keeps_every_value(spark):
    sent = [
        {"round": 7, "rnd": "8", "C": {"nonce": "n", "ct": {"hotkey": "x", "ETH": [0.1], "MULTI-BREAKOUT": {"TON": [0.5, 0.8]}, "TRADEMIX": {"BTC": 1, "TAO": None}}}, "W_owner": {"ct": "a"}},
        {"C": "plain", "W_owner": [1, 2]},
        {"C": {"ct": "not JSON"}, "W_owner": {}},
        {"C": {"ct": json.dumps({"ETH": [0.2]})}, "W_owner": None},
        [{"v": 1}, {"v": 2}],
        [{"v": 1}],
        5,
    ]
    rows = [(i, "h", json.dumps(p), "a", 0, "x") for i, p in enumerate(sent)]
    got = {r.ts: r.fields for r in consistent_payloads(spark.createDataFrame(rows, RAW), {"rnd": "rnd", "round": "rnd"}).collect()}
    assert {k: set(v) for k, v in got.items()} == {
        0: {"rnd", "C.nonce", "C.ct.hotkey", "C.ct.ETH", "C.ct.MULTIBREAKOUT", "C.ct.TRADEMIX", "W_owner.ct"},
        1: {"C", "W_owner"}, 2: {"C.ct", "W_owner"}, 3: {"C.ct.ETH", "W_owner"}, 4: {"v", "$"}, 5: {"v"}, 6: {"$"},
    }
    both = [got[0]["rnd"], *got[0]["rnd"].others]
    assert {(u.written, u.kind, u.canonical) for u in both} == {("round", "number", "7"), ("rnd", "string", "8")}
    assert got[0]["C.ct.TRADEMIX"].object == {"BTC": "1", "TAO": None} and got[0]["C.ct.MULTIBREAKOUT"].written == "C.ct.MULTI-BREAKOUT"
    assert got[0]["C.nonce"].string == "n" and got[0]["C.nonce"].others == []
    assert got[1]["C"].string == "plain" and got[1]["W_owner"].array == ["1", "2"] and got[2]["C.ct"].string == "not JSON" and got[3]["W_owner"].kind == "null"
    assert got[4]["$"].array == ['{"v":1}', '{"v":2}'] and got[6]["$"].number == 5


def test_listing(spark):
    rows = [("A", 2, 1, 0), ("B", 3, 1, 0), ("A", 2, 9, 1), ("A", 2, 9, 1), ("B", 4, None, 1), ("C", 1, 1, 1), ("A", None, 1, 2), ("C", 1, 1, 2), (None, 1, 1, 2), ("D", 1, 1, None)]
    got = {tuple(r) for r in listing_changes(spark.createDataFrame(rows, META)).collect()}
    assert got == {("challenge_meta", 1, "resized", "B", "B"), ("challenge_meta", 1, "added", "", "C"), ("challenge_meta", 2, "removed", "B", "")}


def test_empty(spark):
    assert all_changes(spark.createDataFrame([], RAW), spark.createDataFrame([], META), {}).count() == 0
    assert consistent_payloads(spark.createDataFrame([], RAW), {}).count() == 0


def test_alternatives_that_appear(spark):
    sent = {0: [1, 1, 1], 3: [1, "1", 1], 5: [1, 1, 1], 9: ["1", 1, None]}
    rows = [(i, "h", json.dumps({"a": v, "C": {"ct": {"ETH": [0.1] * (3 if f == 5 and i == 0 else 2)}}}), "f", f, "x") for f, vs in sent.items() for i, v in enumerate(vs)]
    got = {(r.file_no, r.path, r.kind, r.width, r.n, round(r.share, 3), r.seen) for r in payload_alternatives(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {(3, "a", "string", -1, 1, 0.333, False), (5, "C.ct.ETH", "array", 3, 1, 0.333, False), (9, "a", "string", -1, 1, 0.333, True), (9, "a", "null", -1, 1, 0.333, False)}


def test_fields_that_share_few_values_are_still_one(spark):
    """Names of many clients: two files share about a fifth of them."""
    rnd = random.Random(1)
    rows = [(i, "h", json.dumps({("client" if f < 8 else "agent"): f"app{rnd.randrange(1000):03d}/1.{rnd.randrange(3)}", ("one" if f < 8 else "two"): "".join(rnd.choice("0123456789abcdef") for _ in range(12)), "x": 1}), "f", f, "x") for f in range(16) for i in range(100)]
    got = {tuple(r) for r in payload_changes(spark.createDataFrame(rows, RAW), TASKS).collect()}
    assert got == {("f", 8, "renamed", "client", "agent"), ("f", 8, "renamed", "one", "two")}


def test_a_rename_in_the_second_file_of_a_feed(spark):
    """One file of values before, many after: the files beside the change are compared, too."""
    rnd = random.Random(2)
    rows = [(i, "h", json.dumps({("who" if f == 0 else "miner"): f"5x{rnd.randrange(300):04d}q", "x": 1}), "f", f, "x") for f in range(8) for i in range(90)]
    got = {tuple(r) for r in payload_changes(spark.createDataFrame(rows, RAW), TASKS).collect()}
    assert got == {("f", 1, "renamed", "who", "miner")}
