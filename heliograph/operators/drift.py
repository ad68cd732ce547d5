"""Schemas that drift between files: tagged-union inference and a list of changes.

Every payload contributes its paths with the kind of each value. Kinds of one
path in one file are fused into a union that keeps all alternatives with their
counts (number, string, boolean, array, object; width for vectors); the kind
most payloads use is the path's type there. Successive files of a feed are
compared union by union. A path that disappears and one that appears in the
same file are one renamed field when their *content* agrees: either their value
sets overlap (40 minimum hashes per path), or both carry values that never
repeat and have the same form (digits or hexadecimal digits of one length).
Vectors are the same content when they belong to the same task.

The scan aggregates map-side to one row per (feed, file, path, kind, width);
all later work is on that summary. ``consistent_payloads`` returns every
payload in one table: renamed paths under one name, conflicting kinds in typed
branches beside one canonical text, and no member of an envelope left out.

Defined cases: unreadable payloads and rows without feed or file number belong
to no file; a file without any readable payload is skipped; a null value counts
as carried but has no say in the type; equal counts are decided by the kind's
and width's natural order; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.json_text import allow_repeated_keys, only_readable, opened
from heliograph.operators.flatten import MULTI_ASSET
from heliograph.session import cut

#: Number of minimum hashes that stand for a path's value set.
SKETCH = 40
CHANGE_SCHEMA = "feed string, file_no bigint, change_kind string, field_before string, field_after string"
_KIND = (
    "CASE WHEN s = 'VOID' THEN 'null' WHEN s = 'STRING' THEN 'string' WHEN s = 'BOOLEAN' THEN 'boolean' "
    "WHEN startswith(s, 'ARRAY') THEN 'array' WHEN startswith(s, 'OBJECT') THEN 'object' ELSE 'number' END"
)


def _envelopes(payloads: DataFrame, *keep: str) -> DataFrame:
    """Readable payloads: kept columns, the envelope and the opened submission."""
    allow_repeated_keys(payloads.sparkSession)
    read = only_readable(payloads, "payload", *keep)
    env = read.select(*keep, "v", F.expr("coalesce(try_variant_get(v, '$[0]', 'variant'), v)").alias("env"))
    return env.withColumn("ct", F.expr("try_variant_get(env, '$.C.ct', 'variant')")).withColumn("ct", opened("ct"))


_MEMBERS = "try_variant_get({}, '$', 'map<string,variant>')"


def _every_path() -> str:
    """SQL: all (path, value) pairs of a payload; objects C, W_owner and C.ct by their members, whatever else they are as it is.

    ``$`` is a whole payload that is no object, or a list of other than one envelope.
    """
    entries = lambda m: f"coalesce(map_entries({_MEMBERS.format(m)}), array())"
    under = lambda m, p: f"transform({entries(m)}, e -> named_struct('key', concat('{p}', e.key), 'value', e.value))"
    split = lambda m: f"coalesce(cardinality({_MEMBERS.format(m)}), 0) > 0"
    inner = lambda path: f"try_variant_get(env, '$.{path}', 'variant')"
    return (
        f"concat(filter({entries('env')}, e -> NOT (e.key IN ('C', 'W_owner') AND {split('e.value')})), {under(inner('W_owner'), 'W_owner.')}, "
        f"filter({under(inner('C'), 'C.')}, e -> NOT (e.key = 'C.ct' AND {split('ct')})), {under('ct', 'C.ct.')}, "
        f"filter(array(named_struct('key', '$', 'value', v)), e -> {_MEMBERS.format('env')} IS NULL OR cardinality(try_variant_get(v, '$', 'array<variant>')) != 1))"
    )


def _paths(multi: tuple[str, ...]) -> str:
    """SQL: all (path, value) pairs of an envelope."""
    entries = lambda m: f"coalesce(map_entries(try_variant_get({m}, '$', 'map<string,variant>')), array())"
    skip = ", ".join(f"'{x}'" for x in ("hotkey", *multi))
    return (
        f"concat(filter({entries('env')}, e -> e.key NOT IN ('C', 'W_owner')), "
        f"transform({entries('''try_variant_get(env, '$.W_owner', 'variant')''')}, e -> named_struct('key', concat('W_owner.', e.key), 'value', e.value)), "
        f"transform(filter({entries('ct')}, e -> e.key NOT IN ({skip})), e -> named_struct('key', concat('C.ct.', e.key), 'value', e.value)))"
    )


def _permutations() -> list[int]:
    """Fixed pseudo-random 63-bit masks (a linear congruential sequence); min(hash XOR mask) samples a value set."""
    masks, x = [], 1
    for _ in range(SKETCH):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        masks.append(x >> 1)
    return masks


def path_unions(payloads: DataFrame, multi: tuple[str, ...] = tuple(MULTI_ASSET), sketches: bool = True) -> DataFrame:
    """One row per (feed, file_no, path, kind, width): counts, and (``sketches``) form of the values and a sketch of the value set."""
    env = _envelopes(payloads.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()), "feed", "file_no")
    flat = env.select("feed", "file_no", F.explode(F.expr(f"concat({_paths(multi)}, array(named_struct('key', '', 'value', parse_json('null'))))")).alias("e"))
    typed = flat.select("feed", "file_no", F.col("e.key").alias("path"), F.col("e.value").alias("v"), F.expr("schema_of_variant(e.value)").alias("s"))
    typed = typed.select("feed", "file_no", "path", "v", F.expr(_KIND).alias("kind"))
    width = "CASE WHEN kind = 'array' AND startswith(path, 'C.ct.') THEN cardinality(try_variant_get(v, '$', 'array<variant>')) ELSE -1 END"
    if not sketches:
        return typed.withColumn("width", F.expr(width)).groupBy("feed", "file_no", "path", "kind", "width").agg(F.count("*").alias("n"))
    content = (
        "CASE WHEN startswith(path, 'C.ct.') OR path = '' THEN NULL WHEN kind = 'object' THEN concat_ws('/', map_values(try_variant_get(v, '$', 'map<string,string>'))) "
        "WHEN kind = 'array' THEN concat_ws(',', try_variant_get(v, '$', 'array<string>')) ELSE try_variant_get(v, '$', 'string') END"
    )
    said = typed.select("feed", "file_no", "path", "kind", F.expr(width).alias("width"), F.expr(content).alias("content"))
    said = said.withColumn("h", F.when(F.col("content").isNotNull(), F.xxhash64("content")))
    return said.groupBy("feed", "file_no", "path", "kind", "width").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("content").rlike("^[0-9]+$")).alias("n_digits"),
        F.count_if(F.col("content").rlike("^[0-9a-f]+$")).alias("n_hex"),
        F.avg(F.length("content")).alias("length"),
        F.array(*(F.min(F.col("h").bitwiseXOR(F.lit(m))) for m in _permutations())).alias("sketch"),
    )


def file_schemas(unions: DataFrame, share: float = 0.2, reach: int = 4) -> DataFrame:
    """One row per file: ``ordinal`` in its feed and ``fields``, the paths that at least ``share`` of its readable payloads carry.

    A field has path, kind, width, counts and form. Only where it ends or
    begins (it is absent from the next or the previous file) it also has the
    sketches of its values: ``own``, and of up to ``reach`` of its files before
    (``past``) and after (``next``).
    """
    smallest = lambda c: F.array(*(F.min(F.col(c)[i]) for i in range(SKETCH))).alias(c)
    # The kind that most payloads use, then that kind's most frequent width.
    per_kind = unions.groupBy("feed", "file_no", "path", "kind").agg(
        F.sum("n").alias("n"),
        F.max(F.struct("n", "width"))["width"].alias("width"),
        F.sum("n_digits").alias("n_digits"),
        F.sum("n_hex").alias("n_hex"),
        F.sum(F.col("length") * F.col("n")).alias("length"),
        smallest("sketch"),
    )
    per_path = per_kind.groupBy("feed", "file_no", "path").agg(
        F.sum("n").alias("n"),
        F.max(F.when(F.col("kind") != "null", F.struct("n", "kind", "width"))).alias("most"),
        F.sum("n_digits").alias("n_digits"),
        F.sum("n_hex").alias("n_hex"),
        (F.sum("length") / F.sum("n")).alias("length"),
        smallest("sketch"),
    )
    readable_files = per_path.where("path = ''").select("feed", "file_no", F.col("n").alias("readable"), F.row_number().over(Window.partitionBy("feed").orderBy("file_no")).alias("ordinal"))
    fields = per_path.where("path != '' AND most IS NOT NULL").join(readable_files, ["feed", "file_no"]).where(F.col("n") / F.col("readable") >= share)
    w = Window.partitionBy("feed", "path").orderBy("ordinal")
    union = lambda low, high: F.array(*(F.min(F.col("sketch")[i]).over(w.rowsBetween(low, high)) for i in range(SKETCH)))
    fields = fields.select(
        "*",
        ((F.coalesce(F.lag("ordinal").over(w), F.lit(-1)) != F.col("ordinal") - 1) | (F.coalesce(F.lead("ordinal").over(w), F.lit(-1)) != F.col("ordinal") + 1)).alias("edge"),
        union(-reach, -1).alias("past"),
        union(1, reach).alias("next"),
    )
    shown = lambda c, name: F.when(F.col("edge"), F.col(c)).alias(name)
    field = F.struct("path", F.col("most.kind").alias("kind"), F.col("most.width").alias("width"), "n", "n_digits", "n_hex", "length", shown("sketch", "own"), *(shown(c, c) for c in ("past", "next")))
    listed = fields.groupBy("feed", "file_no").agg(F.collect_list(field).alias("fields"))
    return readable_files.join(listed, ["feed", "file_no"], "left").select("feed", "file_no", "ordinal", F.coalesce("fields", F.array()).alias("fields"))


def _overlap(a, b) -> float:  # noqa: ANN001
    """Share of equal minimum hashes: an estimate of the value sets' Jaccard similarity."""
    if a is None or b is None:
        return 0.0
    return sum(x is not None and x == y for x, y in zip(a, b, strict=True)) / SKETCH


def _united(a, b) -> list | None:  # noqa: ANN001
    """The sketch of two value sets together."""
    if a is None or b is None:
        return b if a is None else a
    return [y if x is None else x if y is None else min(x, y) for x, y in zip(a, b, strict=True)]


def _form(f) -> tuple[str, int]:  # noqa: ANN001
    """Form of values that look alike: digits or hexadecimal digits, and their usual length."""
    half, size = f["n"] / 2, round(f["length"] or 0)
    if f["n_digits"] > 0.9 * f["n"]:
        return "digits", size
    return ("hex", size) if f["n_hex"] > half else ("", size)


def same_content(gone, new, tasks: dict[str, str]) -> float:  # noqa: ANN001
    """How surely ``new`` carries the content of ``gone``; 0 where it doesn't."""
    a, b = gone["path"], new["path"]
    if a.startswith("C.ct.") or b.startswith("C.ct."):
        x, y = tasks.get(a[5:], a[5:]), tasks.get(b[5:], b[5:])
        return 3.0 if a[:5] == b[:5] and x == y else 0.0
    # The file alone, and with its neighbours: a set of one file is small beside one of several, as at a feed's begin.
    shared = max(_overlap(x, y) for x in (gone["own"], _united(gone["past"], gone["own"])) for y in (new["own"], _united(new["own"], new["next"])))
    form, other = _form(gone), _form(new)
    # One common value may be chance where the values look different.
    alike = form[0] == other[0] and abs(form[1] - other[1]) <= max(1, 0.2 * max(form[1], other[1]))
    if shared >= (1 if alike else 3) / SKETCH:
        return 2.0 + shared
    repeats = max(_overlap(gone["own"], gone["past"]), _overlap(new["own"], new["next"]))
    if repeats > 0 or not form[0] or form[0] != other[0]:
        return 0.0
    near = abs(form[1] - other[1]) <= (1 if form[0] == "digits" and form[1] > 4 else 0)
    return 1.0 if near else 0.0


def changes_between(before: dict, after: dict, tasks: dict[str, str]) -> list[tuple[str, str, str]]:
    """(change_kind, field_before, field_after) of two successive files' fields by path."""
    gone, new = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
    scored = sorted(((-same_content(before[a], after[b], tasks), a, b) for a in gone for b in new))
    out: list[tuple[str, str, str]] = []
    used: set[tuple[str, int]] = set()
    for minus, a, b in scored:
        if minus < 0 and (a, 0) not in used and (b, 1) not in used:
            used |= {(a, 0), (b, 1)}
            out.append(("renamed", a, b))
    out += [("removed", a, "") for a in gone if (a, 0) not in used] + [("added", "", b) for b in new if (b, 1) not in used]
    for path in sorted(before.keys() & after.keys()):
        x, y = before[path], after[path]
        if x["kind"] != y["kind"]:
            out.append(("retyped", path, path))
        elif x["width"] != y["width"]:
            out.append(("resized", path, path))
    return out


def payload_changes(payloads: DataFrame, tasks: dict[str, str], share: float = 0.2) -> DataFrame:
    """All changes between successive files of each feed (columns of ``CHANGE_SCHEMA``)."""
    w = Window.partitionBy("feed").orderBy("file_no")
    files = file_schemas(cut(path_unions(payloads)), share)
    rows = files.select("feed", "file_no", F.lag("fields").over(w).alias("before"), F.col("fields").alias("after")).where("before IS NOT NULL")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for feed, file_no, *sides in pdf[["feed", "file_no", "before", "after"]].itertuples(index=False, name=None):
                by_path = [{f["path"]: f for f in (side if side is not None else ())} for side in sides]
                out += [(feed, file_no, *change) for change in changes_between(*by_path, tasks)]
            yield pd.DataFrame(out, columns=["feed", "file_no", "change_kind", "field_before", "field_after"])

    return rows.mapInPandas(compare, CHANGE_SCHEMA)


def alternatives(unions: DataFrame) -> DataFrame:
    """Alternatives of a path that appear in a file: feed, file_no, path, kind, width, n, share, seen.

    An alternative is a kind (of a vector also a width) that payloads of the
    file give to a path, however few; it appears when the feed's file before
    hadn't got it. ``share`` is that of the path's values, ``seen`` whether an
    older file had it. A feed's first file is what others are compared with.
    """
    files = unions.where("path = ''").select("feed", "file_no").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("feed").orderBy("file_no")))
    given = unions.where("path != ''").groupBy("feed", "file_no", "path", "kind", "width").agg(F.sum("n").alias("n"))
    total = given.groupBy("feed", "file_no", "path").agg(F.sum("n").alias("total"))
    placed = given.join(total, ["feed", "file_no", "path"]).join(files, ["feed", "file_no"])
    before = F.lag("ordinal").over(Window.partitionBy("feed", "path", "kind", "width").orderBy("ordinal"))
    told = placed.withColumn("before", before).where((F.col("ordinal") > 1) & (F.coalesce("before", F.lit(0)) < F.col("ordinal") - 1))
    return told.select("feed", "file_no", "path", "kind", "width", "n", (F.col("n") / F.col("total")).alias("share"), F.col("before").isNotNull().alias("seen"))


def payload_alternatives(payloads: DataFrame) -> DataFrame:
    """``alternatives`` of the payloads' paths."""
    return alternatives(cut(path_unions(payloads, sketches=False)))


def listing_changes(meta: DataFrame, name: str = "challenge_meta") -> DataFrame:
    """Changes between successive releases of a listing: tickers added, removed, resized.

    Of a ticker listed several times in a release the most frequent dim counts
    (the larger one on equal counts); a ticker without any dim is listed without
    a width, which never counts as resized.
    """
    rows = meta.where(F.col("ticker").isNotNull() & F.col("release_no").isNotNull()).groupBy("release_no", "ticker", "dim").agg(F.count("*").alias("n"))
    listed = rows.groupBy("release_no", "ticker").agg(F.max(F.when(F.col("dim").isNotNull(), F.struct("n", "dim")))["dim"].alias("dim"))
    releases = listed.select("release_no").distinct()
    step = releases.select("release_no", F.lead("release_no").over(Window.orderBy("release_no")).alias("next")).where("next IS NOT NULL")
    before = listed.join(step, "release_no").select(F.col("next").alias("file_no"), "ticker", F.col("dim").alias("dim_before"), F.lit(True).alias("was"))
    after = listed.join(step.select(F.col("next").alias("release_no")), "release_no").select(F.col("release_no").alias("file_no"), "ticker", "dim", F.lit(True).alias("is"))
    both = before.join(after, ["file_no", "ticker"], "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("dim") != F.col("dim_before"), "resized")
    return both.select(
        F.lit(name).alias("feed"),
        F.col("file_no").cast("long").alias("file_no"),
        kind.alias("change_kind"),
        F.when(kind == "added", "").otherwise(F.col("ticker")).alias("field_before"),
        F.when(kind == "removed", "").otherwise(F.col("ticker")).alias("field_after"),
    ).where("change_kind IS NOT NULL")


def task_names(task_spec: DataFrame) -> dict[str, str]:
    """Display name or ticker -> ticker (a dimension table of fixed size)."""
    rows = task_spec.where(F.col("ticker").isNotNull()).select("name", "ticker").collect()
    return {n: r.ticker for r in rows for n in (r.name, r.ticker) if n}


def all_changes(payloads: DataFrame, meta: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """Changes of payload files and of the listing's releases."""
    return payload_changes(payloads, tasks).unionByName(listing_changes(meta)).distinct()


def canonical_names(changes: DataFrame) -> dict[str, str]:
    """Path -> the name shared by all paths that renames connect (the smallest of them).

    The names are those of the schema, of which there are few however many
    files there are; pairs are made distinct before they reach the driver.
    """
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in changes.where(F.col("change_kind") == "renamed").select("field_before", "field_after").distinct().collect():
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {x: find(x) for x in parent}


def consistent_payloads(payloads: DataFrame, names: dict[str, str], multi: dict[str, str] = MULTI_ASSET) -> DataFrame:
    """Every readable payload in one schema: ts, hotkey, feed, file_no, fields.

    ``fields`` maps the canonical path to a tagged union: ``kind``, one typed
    branch per kind (the others null), ``canonical``, the value as text, and
    ``written``, the path as the payload has it. Further values of a payload
    that come under the same canonical path are unions in ``others``.
    """
    env = _envelopes(payloads, "ts", "hotkey", "feed", "file_no")
    same = {f"C.ct.{a}": f"C.ct.{b}" for a, b in multi.items() if a != b} | names
    known = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in sorted(same.items())) + ")" if same else "CAST(map() AS map<string,string>)"
    branches = {
        "kind": "k.kind",
        "number": "CASE WHEN k.kind = 'number' THEN try_variant_get(k.v, '$', 'double') END",
        "string": "CASE WHEN k.kind = 'string' THEN try_variant_get(k.v, '$', 'string') END",
        "boolean": "CASE WHEN k.kind = 'boolean' THEN try_variant_get(k.v, '$', 'boolean') END",
        "array": "CASE WHEN k.kind = 'array' THEN try_variant_get(k.v, '$', 'array<string>') END",
        "object": "CASE WHEN k.kind = 'object' THEN try_variant_get(k.v, '$', 'map<string,string>') END",
        "canonical": "CASE WHEN k.kind = 'object' THEN concat_ws('/', map_values(try_variant_get(k.v, '$', 'map<string,string>'))) ELSE try_variant_get(k.v, '$', 'string') END",
        "written": "k.written",
    }
    struct = lambda values, others: "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in values.items()) + f"{others})"
    union = struct(branches, "")
    several = struct({name: f"u[0].{name}" for name in branches}, ", 'others', slice(u, 2, cardinality(u))")
    kinds = f"transform({_every_path()}, e -> transform(array(schema_of_variant(e.value)), s -> named_struct('path', coalesce({known}[e.key], e.key), 'written', e.key, 'v', e.value, 'kind', {_KIND}))[0])"
    # Nearly all payloads have each path once; the rest look through all their values for each path.
    fields = "kind: string, number: double, string: string, boolean: boolean, array: array<string>, object: map<string,string>, canonical: string, written: string"
    nothing = f"CAST(array() AS array<struct<{fields}>>)"
    alone = f"transform(ks, k -> named_struct('key', k.path, 'value', {struct(branches, f', {chr(39)}others{chr(39)}, {nothing}')}))"
    shared = f"transform(array_distinct(ks.path), p -> named_struct('key', p, 'value', transform(array(transform(filter(ks, k -> k.path = p), k -> {union})), u -> {several})[0]))"
    once = f"transform(array({kinds}), ks -> map_from_entries(CASE WHEN cardinality(array_distinct(ks.path)) = cardinality(ks) THEN {alone} ELSE {shared} END))[0]"
    return env.select("ts", "hotkey", "feed", "file_no", F.expr(once).alias("fields"))
