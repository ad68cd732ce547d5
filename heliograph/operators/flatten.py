"""Deeply nested records into flat child tables that keep parent-child links.

Two steps. The JVM parses each JSON text once into VARIANT and brings every
notation of a level to one shape: ``array<struct<branch, leaves: array<struct<
leaf, value>>>>``. Then ``arrow_children`` turns these list columns into child
tables on Arrow buffers: list offsets give each element its parent's index
(``list_parent_indices``), the values are the flattened child arrays
themselves, and keys of the parents follow by one vectorised ``take`` per
column. No row is visited in Python.

Defined cases: an unreadable, null or empty text has no children; an absent
level (null, wrong type, empty) has no children; a null prediction stays as a
child row with null value (``found`` leaves it out); repeated rows give
repeated children, which share their parents' ids; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.json_text import allow_repeated_keys, as_map, only_readable, opened, opened_map

#: The multi-asset tickers by the names that payloads may use for them.
MULTI_ASSET = {
    "MULTIBREAKOUT": "MULTIBREAKOUT",
    "MULTIXSEC": "MULTIXSEC",
    "FUNDINGXSEC": "FUNDINGXSEC",
    "TRADEMIX": "TRADEMIX",
    "MULTI-BREAKOUT": "MULTIBREAKOUT",
    "XSEC-RANK": "MULTIXSEC",
    "FUNDING-XSEC": "FUNDINGXSEC",
    "TRADE-MIX": "TRADEMIX",
}
_LEAF = "named_struct('leaf', {leaf}, 'value', {value})"
FLAT_SCHEMA = "src string, ts bigint, root string, row_id bigint, branch_no int, branch string, leaf_no int, leaf string, value string"


def names_of(task_spec: DataFrame) -> dict[str, str]:
    """Ticker and display name -> ticker of the tasks with an asset list (a small dimension table)."""
    rows = task_spec.where(F.col("assets").isNotNull() & F.col("ticker").isNotNull()).select("name", "ticker").collect()
    return {n: r.ticker for r in rows for n in (r.name, r.ticker) if n}


def _leaves(value: str, inside: str, key: str, item: str) -> str:
    """SQL: leaves of an object {leaf: value}, an object that has it under ``inside``, or a list of {key, item}."""
    text = lambda v: f"CASE WHEN NOT is_variant_null({v}) THEN try_variant_get({v}, '$', 'string') END"
    entries = "map_entries({m})"
    pairs = lambda m: f"transform({entries.format(m=m)}, e -> {_LEAF.format(leaf='e.key', value=text('e.value'))})"
    wrapped, plain, listed = f"try_variant_get({value}, '$.{inside}', 'map<string,variant>')", f"try_variant_get({value}, '$', 'map<string,variant>')", f"try_variant_get({value}, '$', 'array<variant>')"
    element = _LEAF.format(leaf=f"try_variant_get(x, '$.{key}', 'string')", value=text(f"try_variant_get(x, '$.{item}', 'variant')"))
    return f"coalesce({pairs(wrapped)}, {pairs(plain)}, transform({listed}, x -> {element}))"


def payload_branches(payloads: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """src, ts, root, row_id and the uniform branches (which may be none) of each readable payload."""
    names = MULTI_ASSET if names is None else names
    allow_repeated_keys(payloads.sparkSession)
    found = only_readable(payloads, "payload", "ts", F.col("hotkey").alias("root"), F.xxhash64("ts", "hotkey", "payload").alias("row_id"))
    sent = found.select("ts", "root", "row_id", F.expr("coalesce(try_variant_get(v, '$.C.ct', 'variant'), try_variant_get(v, '$[0].C.ct', 'variant'))").alias("ct"))
    sent = sent.select("ts", "root", "row_id", opened_map("ct").alias("m"))
    known = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in names.items()) + ")"
    listed = ", ".join(f"'{a}'" for a in names)
    branches = f"transform(filter(map_entries(m), e -> e.key IN ({listed})), e -> named_struct('branch', {known}[e.key], 'leaves', {_leaves('e.value', 'assets', 'asset', 'val')}))"
    return sent.select(F.lit("raw_payloads").alias("src"), "ts", "root", "row_id", F.coalesce(F.expr(branches), F.array()).alias("branches"))


def state_branches(states: DataFrame, own: bool = False) -> DataFrame:
    """src, ts, root, row_id and the uniform branches (slot and trigger) of each readable state; with ``own`` the samples' scalars instead of their leaves."""
    allow_repeated_keys(states.sparkSession)
    found = only_readable(states, "state_json", "ts", F.col("asset").alias("root"), F.xxhash64("ts", "asset", "state_json").alias("row_id")).withColumn("v", opened("v"))
    found = found.withColumn("v", F.expr("coalesce(try_variant_get(v, '$.state', 'variant'), v)")).withColumn("v", opened("v")).withColumn("m", as_map("v"))
    leaves = lambda s: f"'leaves', {_leaves(f'''try_variant_get({s}, '$.embeddings', 'variant')''', 'miners', 'hotkey', 'vec')}"
    inside = (lambda s: f"'scalars', {_scalars(f'''try_variant_get({s}, '$', 'map<string,variant>')''')}") if own else leaves
    sample = lambda slot, s: f"named_struct('branch', concat('{slot}:', coalesce(try_variant_get({s}, '$.trigger_sidx', 'string'), '')), {inside(s)})"
    pending = lambda slot: f"transform(filter(array(m['{slot}']), s -> try_variant_get(s, '$', 'map<string,variant>') IS NOT NULL), s -> {sample(slot, 's')})"
    halves = "flatten(transform(map_values(try_variant_get(c, '$', 'map<string,variant>')), h -> coalesce(try_variant_get(h, '$', 'array<variant>'), array())))"
    completed = f"transform(flatten(transform(filter(array(m['completed']), c -> c IS NOT NULL), c -> coalesce(try_variant_get(c, '$', 'array<variant>'), {halves}, array()))), s -> {sample('completed', 's')})"
    branches = f"concat({pending('pending_high')}, {pending('pending_low')}, {completed})"
    return found.select(F.lit("breakout_state").alias("src"), "ts", "root", "row_id", F.coalesce(F.expr(f"CASE WHEN m IS NOT NULL THEN {branches} END"), F.array()).alias("branches"))


def _children(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flattened elements of a list array, their parents' indices and their positions in the parent."""
    parents = pc.list_parent_indices(lists)
    values = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    starts = pc.subtract(pc.cumulative_sum(lengths), lengths)
    ordinal = pc.subtract(pa.array(np.arange(len(values), dtype=np.int64)), pc.take(pc.cast(starts, pa.int64()), parents))
    return values, parents, pc.cast(ordinal, pa.int32())


def arrow_children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of ``*_branches`` -> flat rows of ``FLAT_SCHEMA``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        branches, row, branch_no = _children(batch.column("branches"))
        if not len(branches):
            continue
        branch, leaves = pc.struct_field(branches, [0]), pc.struct_field(branches, [1])
        leaf, parent, leaf_no = _children(leaves)
        owner = pc.take(row, parent)
        yield pa.RecordBatch.from_arrays(
            [
                pc.take(batch.column("src"), owner),
                pc.take(batch.column("ts"), owner),
                pc.take(batch.column("root"), owner),
                pc.take(batch.column("row_id"), owner),
                pc.take(branch_no, parent),
                pc.take(branch, parent),
                leaf_no,
                pc.struct_field(leaf, [0]),
                pc.struct_field(leaf, [1]),
            ],
            names=["src", "ts", "root", "row_id", "branch_no", "branch", "leaf_no", "leaf", "value"],
        )


def flat_predictions(branches: DataFrame) -> DataFrame:
    """One row per innermost prediction; (row_id, branch_no) names the parents, ``value`` is its JSON text."""
    return branches.mapInArrow(arrow_children, FLAT_SCHEMA)


def all_predictions(payloads: DataFrame, states: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Flat predictions of both sources."""
    return flat_predictions(payload_branches(payloads, names).unionByName(state_branches(states)))


def present_predictions(flat: DataFrame) -> DataFrame:
    """Distinct (src, ts, root, branch, leaf) of predictions that are not null."""
    return flat.where(F.col("value").isNotNull()).select("src", "ts", "root", "branch", "leaf").distinct()


def branch_table(branches: DataFrame) -> DataFrame:
    """The middle level: one row per (row, branch) with the number of its predictions."""
    return branches.select("src", "ts", "root", "row_id", F.posexplode("branches").alias("branch_no", "b")).select("src", "ts", "root", "row_id", "branch_no", F.col("b.branch").alias("branch"), F.greatest(F.coalesce(F.size("b.leaves"), F.lit(0)), F.lit(0)).alias("n_leaves"))


def _scalars(members: str) -> str:
    """SQL: the members of a map<string,variant> that are neither objects nor arrays nor null, as map<string,string>."""
    plain = "NOT is_variant_null(e.value) AND try_variant_get(e.value, '$', 'map<string,variant>') IS NULL AND try_variant_get(e.value, '$', 'array<variant>') IS NULL"
    return f"map_from_entries(transform(filter(map_entries({members}), e -> {plain}), e -> named_struct('key', e.key, 'value', try_variant_get(e.value, '$', 'string'))))"


def payload_roots(payloads: DataFrame) -> DataFrame:
    """The top level: src, ts, root, row_id, ``scalars`` of the envelope, ``owner`` (those of W_owner) and ``vectors`` of the tasks with one asset."""
    allow_repeated_keys(payloads.sparkSession)
    found = only_readable(payloads, "payload", "ts", F.col("hotkey").alias("root"), F.xxhash64("ts", "hotkey", "payload").alias("row_id"))
    env = found.withColumn("env", F.expr("coalesce(try_variant_get(v, '$[0]', 'variant'), v)")).withColumn("ct", F.expr("try_variant_get(env, '$.C.ct', 'variant')"))
    maps = env.withColumn("ct", opened("ct")).withColumn("m", as_map("env")).withColumn("c", as_map("ct")).where("m IS NOT NULL")
    multi = ", ".join(f"'{a}'" for a in MULTI_ASSET)
    vectors = f"map_from_entries(filter(transform(filter(map_entries(c), e -> e.key NOT IN ({multi})), e -> named_struct('key', e.key, 'value', try_variant_get(e.value, '$', 'array<double>'))), e -> e.value IS NOT NULL))"
    owner = _scalars("try_variant_get(env, '$.W_owner', 'map<string,variant>')")
    return maps.select(F.lit("raw_payloads").alias("src"), "ts", "root", "row_id", F.expr(_scalars("m")).alias("scalars"), F.expr(owner).alias("owner"), F.expr(vectors).alias("vectors"))


def state_samples(states: DataFrame) -> DataFrame:
    """The middle level of states: src, ts, root, row_id, branch_no, branch and the sample's own ``scalars``; (row_id, branch_no) as in ``flat_predictions``."""
    samples = state_branches(states, True)
    return samples.select("src", "ts", "root", "row_id", F.posexplode("branches").alias("branch_no", "b")).select("src", "ts", "root", "row_id", "branch_no", F.col("b.branch").alias("branch"), F.col("b.scalars").alias("scalars"))
