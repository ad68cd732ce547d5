"""Opened submissions: positional lists or objects keyed by task, validated and brought to one vector per task.

Everything runs on VARIANT in the JVM. A task specification is a dimension of
fixed size; it is joined, never looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.json_text import allow_repeated_keys, only_readable
from heliograph.functions.vectors import sanitised

#: Loss functions whose value is an object per asset, and how many elements an asset has.
PER_ASSET = {"range_breakout_multi": 2, "xsec_rank": 1, "funding_xsec": 1, "trade_mix": 1}


def entries(submissions: DataFrame, text: str, spec: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, task columns, value) for every task of the specification.

    A list must have one value per task, in the order of ``ordinal``; an object
    is keyed by ticker or display name (the ticker wins), other keys and
    ``hotkey`` are ignored. A submission in neither form, and a list of another
    length, gives null values; unreadable texts give no rows.
    """
    allow_repeated_keys(submissions.sparkSession)
    tasks = spec.select("ordinal", "ticker", "name", "loss_func", "dim", "assets")
    n = tasks.count()  # the specification's size is fixed
    read = only_readable(submissions, text, *keep)
    listed = F.expr(f"CASE WHEN cardinality(try_variant_get(v, '$', 'array<variant>')) = {n} THEN try_variant_get(v, '$', 'array<variant>') END")
    keyed = read.select(*keep, listed.alias("l"), F.expr("try_variant_get(v, '$', 'map<string,variant>')").alias("m"))
    keyed = keyed.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.lit(None).cast("int"))
    value = F.expr("coalesce(try_element_at(l, CAST(ordinal + 1 AS INT)), try_element_at(m, ticker), try_element_at(m, name))")
    return keyed.join(F.broadcast(tasks), "ordinal").select(*keep, "ordinal", "ticker", "loss_func", "dim", "assets", value.alias("value"))


def _number(v: str) -> str:
    """SQL: a VARIANT number (booleans count 0 and 1) as DOUBLE; null for anything else."""
    return f"CASE WHEN schema_of_variant({v}) IN ('STRING') OR startswith(schema_of_variant({v}), 'ARRAY') OR startswith(schema_of_variant({v}), 'OBJECT') THEN NULL ELSE try_variant_get({v}, '$', 'double') END"


def asset_scalars(value: str = "value", assets: str = "assets") -> Column:
    """P10: one element per asset: a number outside [-1, 1] is 0, a one-element list is clipped, anything else is 0."""
    item = "try_element_at(try_variant_get({v}, '$', 'map<string,variant>'), a)".format(v=value)
    inner = _number("try_variant_get(x, '$[0]', 'variant')")
    single = f"CASE WHEN cardinality(try_variant_get(x, '$', 'array<variant>')) = 1 THEN greatest(least({inner}, 1D), -1D) END"
    plain = _number("x")
    return F.expr(f"transform({assets}, a -> transform(array({item}), x -> coalesce({single}, CASE WHEN {plain} BETWEEN -1D AND 1D THEN {plain} END, 0D))[0])")


def asset_pairs(value: str = "value", assets: str = "assets") -> Column:
    """Two elements per asset; a pair with a value that isn't a number in [0, 1] is (0, 0)."""
    item = "try_element_at(try_variant_get({v}, '$', 'map<string,variant>'), a)".format(v=value)
    one, two = _number("try_variant_get(x, '$[0]', 'variant')"), _number("try_variant_get(x, '$[1]', 'variant')")
    good = f"cardinality(try_variant_get(x, '$', 'array<variant>')) = 2 AND {one} BETWEEN 0D AND 1D AND {two} BETWEEN 0D AND 1D"
    return F.expr(f"flatten(transform({assets}, a -> transform(array({item}), x -> CASE WHEN {good} THEN array({one}, {two}) ELSE array(0D, 0D) END)[0]))")


def vectors(found: DataFrame) -> DataFrame:
    """``vec`` of every task: flattened, sanitised or checked by its kind; zeros where the value is missing or refused."""
    numbers = F.expr(f"transform(try_variant_get(value, '$', 'array<variant>'), x -> {_number('x')})")
    pairs = F.col("loss_func") == "range_breakout_multi"
    width = F.when(F.col("loss_func").isin(*PER_ASSET), F.col("dim") * F.size("assets")).otherwise(F.col("dim"))
    whole = (F.size(numbers) == F.col("dim")) & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x))
    checked = F.when(whole & F.forall(numbers, lambda x: (x >= -1) & (x <= 1)), numbers)
    vec = F.when(pairs, asset_pairs()).when(F.col("loss_func").isin(*PER_ASSET), asset_scalars()).when(F.col("loss_func") == "lbfgs", F.when(whole, sanitised(numbers))).otherwise(checked)
    return found.withColumn("vec", F.coalesce(vec, F.array_repeat(F.lit(0.0), width.cast("int")))).drop("value")


def random_submissions(spark: SparkSession, spec: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(row, payload) of ``n`` made-up submissions keyed by ticker: random numbers in [0, 1) of every task's width, per asset where it has assets."""
    vec = F.transform(F.sequence(F.lit(1), F.col("dim")), lambda i: F.round(F.pmod(F.xxhash64("row", "ticker", i, F.lit(seed)), F.lit(10_000)) / 10_000, 4))
    per = lambda a: F.transform(F.sequence(F.lit(1), F.col("dim")), lambda i: F.round(F.pmod(F.xxhash64("row", "ticker", a, i, F.lit(seed)), F.lit(10_000)) / 10_000, 4))
    value = F.when(F.col("assets").isNull(), F.to_json(vec)).otherwise(F.to_json(F.map_from_arrays("assets", F.transform("assets", per))))
    listed = spec.agg(F.collect_list(F.struct("ticker", "dim", "assets")).alias("l"))
    rows = spark.range(n).select(F.col("id").alias("row"), F.explode(listed.scalar()).alias("t")).select("row", "t.*")
    members = rows.groupBy("row").agg(F.array_sort(F.collect_list(F.concat(F.lit('"'), "ticker", F.lit('":'), value))).alias("m"))
    return members.select("row", F.concat(F.lit("{"), F.array_join("m", ","), F.lit("}")).alias("payload"))
