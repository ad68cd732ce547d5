import json
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import crypto, vectors
from heliograph.operators import events, ingest
from heliograph.sources import legacy, sinks
from heliograph.streaming import ingest as stream_ingest
from heliograph.streaming import tracker


def walk(seed, n=1200):
    rnd = random.Random(seed)
    p, out = 100.0, []
    for s in range(n):
        p *= 1 + rnd.gauss(0, 0.004)
        if rnd.random() > 0.03:
            out.append(("BTC" if seed == 1 else "ETH", s, p))
    return out


OPTIONS = {"lookback": 120, "barrier": 0.25, "least_range": 0.01, "stale": 300}


def test_replay_is_the_plain_fold(spark):
    rows = walk(1) + walk(2) + [("BTC", 5000, 0.0), ("BTC", 5001, None)]
    got = {tuple(r) for r in events.replay(spark.createDataFrame(rows, "k string, t long, p double").repartition(4), "k", "t", "p", **OPTIONS).collect()}
    expected = set()
    for seed, k in ((1, "BTC"), (2, "ETH")):
        history, pending = [], {}
        for _, s, p in walk(seed):
            for side in (1, -1):
                if side in pending:
                    e = pending[side]
                    width = (e[3] - e[4]) * 0.25
                    if s - e[0] > 300:
                        del pending[side]
                    elif abs(p - e[2]) >= width:
                        expected.add((k, e[0], s, side, e[2], e[3], e[4], int(side * (p - e[2]) > 0)))
                        del pending[side]
            near = [q for t, q in history if s - 120 <= t < s]
            if len(near) >= 60 and max(near) - min(near) >= 0.01 * p:
                if p > max(near) and 1 not in pending:
                    pending[1] = (s, 1, p, max(near), min(near))
                elif p < min(near) and -1 not in pending:
                    pending[-1] = (s, -1, p, max(near), min(near))
            history.append((s, p))
    assert len(expected) > 5 and got == expected


def test_stream_equals_batch(spark, tmp_path):
    rows = walk(1) + walk(2)
    df = spark.createDataFrame(rows, "k string, t long, p double")
    for i in range(3):
        df.where((F.col("t") >= i * 400) & (F.col("t") < (i + 1) * 400)).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    stream = spark.readStream.schema("k string, t long, p double").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in/*")
    query = tracker.track(stream, "k", "t", "p", replay=True, **OPTIONS).writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("tracked").collect()} == {tuple(r) for r in events.replay(df, "k", "t", "p", **OPTIONS).collect()}


def test_tracker_survives_a_restart():
    a, b = events.Tracker(**OPTIONS), events.Tracker(**OPTIONS)
    for _, s, p in walk(1):
        x, y = a.update(s, p), b.update(s, p)
        assert x == y
        b = events.Tracker.load(json.loads(json.dumps(b.dump())))


def test_late_rows_reach_their_key(spark, tmp_path):
    schema = "k string, t long, price double, ts long"
    first, late = [("a", 1, 1.0, 1), ("a", 2, 2.0, 2)], [("a", 1, 5.0, 9), ("a", 2, 7.0, 1), ("b", 1, 3.0, 3)]
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    for rows in (first, late, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_ingest.start_upsert(stream, table, f"{tmp_path}/c", ["k", "t"], "ts", ["price"]).awaitTermination()
    got = {(r.k, r.t): r.price for r in stream_ingest.read_upserted(spark, table, ["k", "t"], "ts", ["price"]).collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 2.0, ("b", 1): 3.0}


def test_event_time_windows_and_dedupe(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2026-01-01 00:10:00', 1.0D), ('a', TIMESTAMP_NTZ '2026-01-01 00:50:00', 3.0D), ('a', TIMESTAMP_NTZ '2026-01-01 05:00:00', 9.0D) AS t(k, at, v)").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("k string, at timestamp_ntz, v double").parquet(f"{tmp_path}/in")
    q = stream_ingest.hourly(stream(), "at", ["k"], "v").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.n, r["mean"]) for r in spark.table("hours").collect()} == {(2, 2.0), (1, 9.0)}
    q = stream_ingest.deduplicated(stream(), ["k"], "at", "1 hour").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1


def test_sqlite_and_blobs(spark, tmp_path):
    path = str(tmp_path / "old.db")
    vec = np.arange(4, dtype="<f2").reshape(2, 2)
    blob = json.dumps(["a", "b"]).encode() + b"\0" + vec.tobytes()
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE d (ticker TEXT, sidx INTEGER, price REAL, embeddings BLOB)")
        c.executemany("INSERT INTO d VALUES (?, ?, ?, ?)", [("ETH", i, i / 2, blob if i % 2 else blob[:-1]) for i in range(20)] + [(None, None, None, None)])
        c.execute("CREATE TABLE empty (x INTEGER)")
    spark.dataSource.register(legacy.SqliteSource)
    df = spark.read.format("heliograph-sqlite").option("path", path).option("table", "d").option("partitions", "3").load()
    assert df.dtypes == [("ticker", "string"), ("sidx", "bigint"), ("price", "double"), ("embeddings", "binary")]
    assert df.count() == 21 and df.agg(F.sum("sidx")).first()[0] == 190
    assert spark.read.format("heliograph-sqlite").option("path", path).option("table", "empty").load().count() == 0
    spark.udtf.register("blob_rows", legacy.blob_rows())
    df.createOrReplaceTempView("old")
    got = spark.sql("SELECT sidx, b.hotkey, b.vec FROM old, LATERAL blob_rows(embeddings, 2) b").collect()
    assert len(got) == 20 and {(r.hotkey, tuple(r.vec)) for r in got} == {("a", (0.0, 1.0)), ("b", (2.0, 3.0))}
    flat = legacy.unpacked(df.select("sidx", "embeddings"), "embeddings", 2).collect()
    assert {(r.sidx, r.hk, tuple(r.vec)) for r in flat} == {(r.sidx, r.hotkey, tuple(r.vec)) for r in got}
    again = sinks.packed(spark.createDataFrame([(1, "b", [2.0, 3.0]), (1, "a", [0.0, 1.0])], "k long, h string, v array<double>"), ["k"], "h", "v").first()
    assert bytes(again.embeddings) == blob


def test_landed_objects(spark, tmp_path):
    full = {k: 1 for k in ingest.ENVELOPE_KEYS} | {"v": 2, "round": 5}
    for name, text in (("a.json", json.dumps(full)), ("b.json", json.dumps({**full, "v": 1})), ("c.json", json.dumps({**full, "round": "5"})), ("d.json", "{"), ("e.json", " " * 5000)):
        (tmp_path / name).write_text(text)
    objects = legacy.landed_objects(spark, str(tmp_path), 4000)
    assert objects.count() == 4
    assert [r.path.rsplit("/", 1)[-1] for r in legacy.landed_envelopes(objects).collect()] == ["a.json"]


def test_sinks(spark, tmp_path):
    w = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.0)], "uid int, hotkey string, w double")
    for block in (5, 12):
        sinks.save_weights(w.withColumn("w", F.col("w") + block), f"{tmp_path}/w", block)
    assert {r.w for r in sinks.load_weights(spark, f"{tmp_path}/w").collect()} == {12.0, 12.5}
    assert [r.uid for r in sinks.published(w).collect()] == [1]
    sinks.write_partitioned(w, f"{tmp_path}/p", ["hotkey"])
    sinks.replace_table(w.limit(1), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2 and spark.read.parquet(f"{tmp_path}/r").count() == 1
    assert json.loads(sinks.breakdown(w, F.col("uid"), "hotkey", "w").first().line) == {"hotkey": "a", "w": 0.5}
    half = spark.createDataFrame([([0.1, 1.0],), (None,)], "v array<float>").select(sinks.half_precision("v").alias("h")).collect()
    assert half[0].h == [float(np.float32(np.float16(0.1))), 1.0] and half[1].h is None


def test_upserts(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None), (1, 5, None, "x"), (1, 3, 2.0, None), (2, None, 4.0, None)], "k int, v int, price double, note string")
    assert {tuple(r) for r in ingest.upsert_columns(df, ["k"], "v", ["price", "note"]).collect()} == {(1, 2.0, "x"), (2, 4.0, None)}
    assert {tuple(r) for r in ingest.latest(df, ["k"], "v", ["price"]).collect()} == {(1, 5, None), (2, None, 4.0)}


def test_vectors(spark):
    v = [0.0, 0.5, 2.0, -1.0, 0.5, 0.3, 0.0]
    r = spark.createDataFrame([(v,), ([0.0] * 7,)], "v array<double>").select(vectors.sanitised(F.col("v")).alias("s"), vectors.active(F.col("v")).alias("a"), vectors.argmax(vectors.probabilities(F.col("v"))).alias("m"), vectors.logits(F.col("v")).alias("l"), vectors.asset_slice(F.col("v"), F.lit(1), 2).alias("p")).collect()
    assert sum(r[0].s[:5]) == pytest.approx(1) and r[0].a and r[0].m == 2 and r[0].l[0] == 0 and r[0].p == [2.0, -1.0]
    assert r[1].s == [0.0] * 7 and not r[1].a and r[1].m == 0


def test_bytes_and_keys(spark):
    okm = crypto.hkdf_sha256(bytes.fromhex("0b" * 22), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9"), 42, bytes.fromhex("000102030405060708090a0b0c"))
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    df = spark.createDataFrame([(bytearray([1, 1, 0, 0, 0, 0, 0, 0, 9]), "a:::b:::hk")], "b binary, t string")
    r = df.select(crypto.little_endian_u64(F.col("b")).alias("n"), crypto.legacy_plaintext(F.col("t")).alias("p"), crypto.bytes_between(F.col("b"), 8, 1).alias("s"), crypto.key_and_nonce("b", "b").alias("k"), crypto.open_envelope(lambda e: e.encode() if e == "x" else 1 / 0)(F.col("t")).alias("o")).first()
    assert int(r.n) == 257 and (r.p.payload, r.p.hotkey) == ("a:::b", "hk") and bytes(r.s) == b"\x09" and len(r.k.key) == 32 and len(r.k.nonce) == 12 and r.o is None


def test_key_exchange_and_authenticated_encryption():
    """The examples of RFC 7748 and RFC 8439."""
    scalar, u = bytes.fromhex("a546e36bf0527c9d3b16154b82465edd62144c0ac1fc5a18506a2244ba449ac4"), bytes.fromhex("e6db6867583030db3594c1a424b15f7c726624ec26b3353b10a903a6d0ab1c4c")
    assert crypto.x25519(scalar, u).hex() == "c3da55379de9c6908e94ea4df28d084f32eccf03491c71f754b4075577a28552"
    key, nonce, aad = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = crypto.seal(key, nonce, plain, aad)
    assert sealed[:16].hex() == "d31a8d34648e60db7b86afbc53ef7ec2" and sealed[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    assert crypto.unseal(key, nonce, sealed, aad) == plain
    for wrong in (sealed[:-1] + b"x", b"x" + sealed[1:], sealed[:10], b""):
        assert crypto.unseal(key, nonce, wrong, aad) is None
    assert crypto.unseal(key, nonce, sealed, aad + b"x") is None and crypto.unseal(key, nonce, crypto.seal(key, nonce, b"")) == b""


def test_envelopes_are_sealed_checked_and_opened(spark):
    owner, ske, key = bytes(range(32)), bytes(range(40, 72)), bytes(range(100, 132))
    lock = lambda round_, raw: bytes(b ^ (round_ % 256) for b in raw)
    made = crypto.sealed_envelope("hk1", 77, crypto.public_key(owner), {"ETH": [0.1, 0.2]}, b"wrap", lock, ske, key, (bytes(12), bytes(range(12))), "x")
    text = json.dumps(made)
    # The owner's shared secret is that of the sender.
    assert crypto.x25519(owner, crypto.public_key(ske)) == crypto.x25519(ske, crypto.public_key(owner))
    opened = crypto.open_envelope(crypto.opener(crypto.public_key(owner), b"wrap", lock))
    bad = [json.dumps({**made, **change}) for change in ({"round": 78}, {"hk": "hk2"}, {"owner_pk": "00" * 32}, {"binding": "00"}, {"C": {"nonce": "00" * 12, "ct": made["C"]["ct"][:-2] + "zz"}})]
    df = spark.createDataFrame([("hk1", t) for t in [text, f"[{text}]", *bad, None, "{"]] + [("other", text)], "hotkey string, payload string")
    got = [r[0] for r in df.select(opened(F.col("payload"))).collect()]
    assert json.loads(bytes(got[0])) == {"ETH": [0.1, 0.2], "hotkey": "hk1"} and bytes(got[-1]) == bytes(got[0]) and got[1:-1] == [None] * 8
    told = [(r.hotkey, r.complete, r.own, r.owned, r.bound) for r in ingest.envelope_checks(df, "payload", "hotkey", [crypto.public_key(owner).hex().upper()]).collect()]
    assert told[0] == told[1] == ("hk1", True, True, True, True) and told[-1] == ("other", True, False, True, True)
    assert [t[1:] for t in told[2:7]] == [(True, True, True, False), (True, False, True, False), (True, True, False, False), (True, True, True, False), (True, True, True, True)]
    prefix = (32).to_bytes(8, "little")
    old = bytes(range(96)) + prefix + b"v" * 32 + prefix + b"w" * 32 + b"r" * 196
    rows = spark.createDataFrame([(bytearray(old),), (bytearray(old[:-1]),), (bytearray(b"x" * 372),)], "b binary").select(crypto.converted(F.col("b")).alias("c")).collect()
    assert [bytes(r.c) for r in rows] == [bytes(range(96)) + b"v" * 32 + b"w" * 32 + b"r" * 196, old[:-1], b"x" * 372]


def test_clock_and_tries(spark):
    from heliograph.streaming.ingest import clock, settled

    assert clock(spark).isStreaming and set(clock(spark).columns) == {"timestamp", "block"}
    p = spark.createDataFrame([(1, 2, 0), (2, 2, 3), (3, 2, 1), (4, 1, 9)], "round int, version int, tries int")
    s = spark.createDataFrame([(1, "s")], "round int, signature string")
    assert {(r.round, r.lost) for r in settled(p, s).collect()} == {(1, False), (2, True)}
