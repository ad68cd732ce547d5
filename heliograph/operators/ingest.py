"""Ingest: last-writer-wins upserts, maturity, defaults, first appearances and the checks of landed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.json_text import allow_repeated_keys, only_readable

#: The keys that a version 2 envelope must have.
ENVELOPE_KEYS = ("v", "round", "hk", "owner_pk", "C", "W_owner", "W_time", "binding", "alg")


def latest(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """Per key the row with the largest version (then the largest values); one aggregate with map-side combine."""
    chosen = df.groupBy(*keys).agg(F.max(F.struct(version, *values)).alias("_m"))
    return chosen.select(*keys, *(F.col("_m")[c].alias(c) for c in (version, *values)))


def upsert_columns(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """Column-wise upsert: of each column the newest value that isn't null, other columns untouched."""
    newest = [F.max(F.when(F.col(v).isNotNull(), F.struct(F.col(version).alias("s"), F.col(v).alias("x"))))["x"].alias(v) for v in values]
    return df.groupBy(*keys).agg(*newest)


def merge_upsert(target: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of ``changes`` replace those of ``target`` with the same key, whatever their version; new keys are added."""
    both = target.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    chosen = both.groupBy(*keys).agg(F.max(F.struct("_side", version, *[c for c in rest if c != version])).alias("_m"))
    return chosen.select(*keys, *(F.col("_m")[c].alias(c) for c in rest))


def mature(rows: DataFrame, blocks: DataFrame, now: Column | int, delay: int) -> DataFrame:
    """Rows joined to their block by ts = idx, at least ``delay`` blocks old at block ``now``."""
    return rows.join(blocks.select(F.col("idx").alias("ts"), "block"), "ts").where(F.lit(now) - F.col("block") >= delay)


def last_block(blocks: DataFrame) -> DataFrame:
    """The block of the largest idx (one row)."""
    return blocks.agg(F.max_by("block", "idx").alias("block"))


def default_join(keys: DataFrame, rows: DataFrame, on: list[str], column: str, default: str) -> DataFrame:
    """Every key with its row's column, or the default."""
    return keys.join(rows.select(*on, column), on, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def first_seen(df: DataFrame, who: str, order: str, to: str = "first_seen") -> DataFrame:
    """First key at which each participant appears."""
    return df.where(F.col(who).isNotNull()).groupBy(who).agg(F.min(order).alias(to))


def dense_index(df: DataFrame, group: list[str], key: str, to: str = "index") -> DataFrame:
    """Distinct keys per group with a dense 0-based index in their order (a dimension of participants)."""
    w = Window.partitionBy(*group).orderBy(key)
    return df.where(F.col(key).isNotNull()).select(*group, key).distinct().withColumn(to, F.row_number().over(w) - 1)


def valid_url(url: Column, hotkey: Column, hosts: tuple[str, ...]) -> Column:
    """allowed host (or a subdomain), no trailing slash, exactly one path part, equal to the hotkey without regard to case."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.try_parse_url(url, F.lit("PATH"))
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | (host == h) | host.endswith(f".{h}")
    return F.coalesce(allowed & ~url.endswith("/") & (F.size(F.split(path, "/")) == 2) & (F.lower(F.substring(path, 2, 1 << 20)) == F.lower(hotkey)), F.lit(False))


def is_envelope(variant: str = "v") -> Column:
    """All nine keys are there, v is 2 and round is an integer."""
    keys = " AND ".join(f"try_variant_get({variant}, '$.{k}', 'variant') IS NOT NULL" for k in ENVELOPE_KEYS)
    return F.expr(f"coalesce({keys} AND try_variant_get({variant}, '$.v', 'int') = 2 AND schema_of_variant(try_variant_get({variant}, '$.round', 'variant')) = 'BIGINT', false)")


def binding(hotkey: Column, round_: Column, owner: Column, pke: Column) -> Column:
    """SHA-256 in hex of hotkey:round:owner:pke as bytes (``owner`` and ``pke`` binary or text)."""
    colon = F.lit(b":")
    return F.sha2(F.concat(hotkey.cast("binary"), colon, round_.cast("string").cast("binary"), colon, owner.cast("binary"), colon, pke.cast("binary")), 256)


def envelope_checks(payloads: DataFrame, text: str, hotkey: str, owner_keys: list[str] | None = None) -> DataFrame:
    """All columns of readable payloads, and whether they are complete, name the row's hotkey, have an accepted owner key (any where none is listed) and the hash that binds them."""
    allow_repeated_keys(payloads.sparkSession)
    v = only_readable(payloads, text, *payloads.columns, to="_v").withColumn("_e", F.expr("coalesce(try_variant_get(_v, '$[0]', 'variant'), _v)"))
    at = lambda path: F.expr(f"try_variant_get(_e, '$.{path}', 'string')")
    raw = lambda path: F.expr(f"try_to_binary(try_variant_get(_e, '$.{path}', 'string'), 'hex')")
    owned = F.lower(at("owner_pk")).isin(*(k.lower() for k in owner_keys)) if owner_keys else F.lit(True)
    tied = binding(at("hk"), at("round"), raw("owner_pk"), raw("W_owner.pke")) == F.lower(at("binding"))
    told = {"complete": is_envelope("_e"), "own": at("hk") == F.col(hotkey), "owned": owned, "bound": tied}
    return v.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in told.items()}).drop("_v", "_e")


def due(blocks: DataFrame, every: int, column: str = "block") -> DataFrame:
    """Of a clock's blocks those at which a job of period ``every`` starts: the first in each period."""
    return blocks.groupBy(F.floor(F.col(column) / every).cast("long").alias("period")).agg(F.min(column).alias(column))


def enough_history(blocks: DataFrame, lag: int) -> DataFrame:
    """one row: recorded blocks, and whether they are at least 2·lag + 1."""
    return blocks.agg(F.count("*").alias("n")).withColumn("ready", F.col("n") >= 2 * lag + 1)


def newest(df: DataFrame, key: str, keep: int) -> DataFrame:
    """The rows of the ``keep`` largest distinct keys (eviction of the oldest)."""
    top = df.select(key).distinct().orderBy(F.desc(key)).limit(keep)
    return df.join(top, key, "left_semi")


def snapshot(participants: DataFrame, uid: str, version: str) -> DataFrame:
    """Of every uid its newest row, in the order of uids."""
    rest = [c for c in participants.columns if c not in (uid, version)]
    return latest(participants, [uid], version, rest).orderBy(uid)


def parsed_map(text: Column) -> Column:
    """A JSON object as map<string,double>, entries without a number left out."""
    whole = F.from_json(text, "map<string,string>")
    numbers = F.transform_values(whole, lambda _, v: v.try_cast("double"))
    return F.map_filter(numbers, lambda _, v: v.isNotNull() & ~F.isnan(v))


def positive_entries(numbers: Column) -> Column:
    """Entries of usable prices."""
    return F.map_filter(numbers, lambda _, v: (v > 0) & (v < F.lit(float("inf"))))


def ordered_vector(numbers: Column, assets: Column, default: float = 0.0) -> Column:
    """The map's values in the order of the asset list, absent ones as ``default``."""
    return F.transform(assets, lambda a: F.coalesce(F.try_element_at(numbers, a), F.lit(default)))
