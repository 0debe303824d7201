"""Tree patterns over node and role tables: every test is a filter, a semi join or an anti join on the nodes.

nodes: path, language, id, node_id, kind, name, text, subtree_end (pre-order numbers), start_byte, end_byte. roles: path,
node_id, role, ordinal, keyword, target_node (null for a span without a node of its own), name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import anchors, matches
from ..schema import PlanError, checked, kinds_below

SINGLE_ROLES = ("callee", "receiver", "left", "right", "object", "module", "field")
CALLABLE = kinds_below("callable")
KEYS = {"kind", "not_kind", "name", "name_regex", "text", "arity", "args", "kwargs", "decorators", "has", "not_has", "inside", "inside_decl", "not_inside", "capture", "visibility", "parameter_type", *SINGLE_ROLES}
DEPTH, SIZE = 64, 256


def check(pattern: dict, path: str = "match", depth: int = 1, root: bool = True) -> int:
    """The number of patterns in it; refused if too deep, too large, unknown, or a root that says too little."""
    if depth > DEPTH:
        raise PlanError(path, f"more than {DEPTH} levels")
    if unknown := set(pattern) - KEYS:
        raise PlanError(path, f"unknown fields {sorted(unknown)}")
    if root and not set(pattern) & {"kind", "name", "name_regex", "text"}:
        raise PlanError(path, "a root says kind, name or text")
    size = 1
    for k, v in pattern.items():
        for i, p in enumerate(v.values() if k == "kwargs" else v if k in ("args", "decorators") else [v] if isinstance(v, dict) and k != "arity" else []):
            size += check(p, f"{path}.{k}[{i}]", depth + 1, False)
    if size > SIZE:
        raise PlanError(path, f"more than {SIZE} patterns")
    return size


def own(pattern: dict) -> Column:
    """The tests on the node itself."""
    tests = [F.lit(True)]
    listed = lambda v: [v] if isinstance(v, str) else list(v)
    if "kind" in pattern:
        tests.append(F.col("kind").isin(*sorted({k for v in listed(pattern["kind"]) for k in kinds_below(v)})))
    if "not_kind" in pattern:
        tests.append(F.col("kind").isNull() | ~F.col("kind").isin(*sorted({k for v in listed(pattern["not_kind"]) for k in kinds_below(v)})))
    if "name" in pattern:
        tests.append(F.col("name") == pattern["name"])
    if "name_regex" in pattern:
        tests.append(matches(F.col("name"), pattern["name_regex"]))
    if "text" in pattern:
        tests += [F.col("text").contains(a) for a in anchors(pattern["text"])]
        tests.append(F.col("text").rlike(pattern["text"]))
    if "visibility" in pattern:
        tests.append(F.col("visibility").isin(*checked("visibility", pattern["visibility"])))
    if "parameter_type" in pattern:  # any parameter's
        tests.append(F.coalesce(F.exists("parameter_types", lambda p: matches(p, pattern["parameter_type"])), F.lit(False)))
    return reduce(Column.__and__, tests)


def spans(pattern: dict) -> bool:
    """Whether a target without a node can match."""
    return set(pattern) <= {"name", "name_regex", "text", "capture", "not_kind"}


def bare(pattern: dict, roles: DataFrame) -> DataFrame:
    """The role edges without a node whose name matches."""
    return roles.where("target_node is null").withColumn("kind", F.lit(None).cast("string")).withColumn("text", F.col("name")).where(own(pattern)).select(*roles.columns)


def role_hits(pattern: dict, nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """The role edges whose target matches; a target without a node satisfies only name, text and capture."""
    hit = matching(pattern, nodes, roles).select(F.col("path").alias("_p"), F.col("node_id").alias("_t"))
    real = roles.join(hit, (F.col("path") == F.col("_p")) & (F.col("target_node") == F.col("_t")), "left_semi")
    return real.union(bare(pattern, roles)) if spans(pattern) else real


def matching(pattern: dict, nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """The nodes that match; nodes around the result are looked up in all of `nodes`."""
    out = nodes.where(own(pattern))
    at = ["path", "node_id"]
    # What is captured is looked up below, and where nothing is captured, nothing matches there.
    for role in SINGLE_ROLES:
        if role in pattern and "capture" not in pattern[role]:
            out = out.join(role_hits(pattern[role], nodes, roles.where(F.col("role") == role)), at, "left_semi")
    if "arity" in pattern:
        n = roles.where("role = 'args'").groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
        low, high = pattern["arity"].get("min", 0), pattern["arity"].get("max", 1 << 30)
        out = out.join(n, at, "left").where(F.coalesce("_n", F.lit(0)).between(low, high)).drop("_n")
    if "args" in pattern and not (len(pattern["args"]) == 1 and "capture" in pattern["args"][0]):
        # Each pattern takes the first argument after the one before it: a greedy ordered subsequence.
        args, wanted = roles.where("role = 'args'"), pattern["args"]
        hits = reduce(DataFrame.union, [role_hits(p, nodes, args).select(*at, "ordinal", F.lit(i).alias("i")) for i, p in enumerate(wanted)])
        lists = hits.groupBy(*at).agg(F.array_sort(F.collect_set(F.struct("ordinal", (-F.col("i")).alias("back")))).alias("_h"))
        step = lambda s, x: F.when((-x["back"] == s["i"]) & (x["ordinal"] > s["o"]), F.struct((s["i"] + 1).alias("i"), x["ordinal"].alias("o"))).otherwise(s)
        done = F.aggregate("_h", F.struct(F.lit(0).alias("i"), F.lit(-1).alias("o")), step)["i"]
        out = out.join(lists.where(done == len(wanted)), at, "left_semi")
    for word, p in pattern.get("kwargs", {}).items():
        if "capture" in p:
            continue
        out = out.join(role_hits(p, nodes, roles.where((F.col("role") == "kwargs") & (F.col("keyword") == word))), at, "left_semi")
    for p in pattern.get("decorators", []):
        if "capture" in p:
            continue
        out = out.join(role_hits(p, nodes, roles.where("role = 'decorators'")), at, "left_semi")
    inner = lambda p: matching(p, nodes, roles).select(F.col("path").alias("_p"), F.col("node_id").alias("_i"), F.col("subtree_end").alias("_e"))
    below = (F.col("path") == F.col("_p")) & (F.col("_i") > F.col("node_id")) & (F.col("_i") < F.col("subtree_end"))
    above = (F.col("path") == F.col("_p")) & (F.col("_i") < F.col("node_id")) & (F.col("node_id") < F.col("_e"))
    if "has" in pattern:
        out = out.join(inner(pattern["has"]), below, "left_semi")
    if "not_has" in pattern:
        out = out.join(inner(pattern["not_has"]), below, "left_anti")
    if "inside" in pattern:
        out = out.join(inner(pattern["inside"]), above, "left_semi")
    if "not_inside" in pattern:
        out = out.join(inner(pattern["not_inside"]), above, "left_anti")
    if "inside_decl" in pattern:
        # The nearest match must not have a callable that doesn't match between itself and the node.
        hit = inner(pattern["inside_decl"]).withColumn("_ok", F.lit(True))
        walls = nodes.where(F.col("kind").isin(*CALLABLE)).select(F.col("path").alias("_p"), F.col("node_id").alias("_i"), F.col("subtree_end").alias("_e")).join(hit.select("_p", "_i"), ["_p", "_i"], "left_anti").withColumn("_ok", F.lit(False))
        nearest = out.join(hit.unionByName(walls), above).groupBy("path", "node_id").agg(F.max_by("_ok", "_i").alias("_ok")).where("_ok")
        out = out.join(nearest, at, "left_semi")
    if "capture" in pattern:
        out = out.withColumn(f"capture_{pattern['capture']}", F.coalesce("text", "name"))
    # A name captured more than once is one value: the places' values are joined on it, the node's own among them.
    for name, parts in captures(pattern).items():
        seen = [captured(p, nodes, roles.where(where)) for p, where in parts]
        own_column = f"capture_{name}"
        same = reduce(lambda a, b: a.join(b, [*at, "_v"]), seen)
        if pattern.get("capture") == name:
            out = out.join(same.withColumnRenamed("_v", own_column), [*at, own_column], "left_semi")
        else:
            out = out.join(same.groupBy(*at).agg(F.min("_v").alias(own_column)), at)
    return out


def captures(pattern: dict) -> dict[str, list[tuple[dict, Column]]]:
    """For each name that the pattern's roles, arguments and decorators capture: their patterns and role edges."""
    role = F.col("role")
    parts = [(pattern[r], role == r) for r in SINGLE_ROLES if r in pattern] + [(p, role == "args") for p in pattern.get("args", [])] + [(p, role == "decorators") for p in pattern.get("decorators", [])]
    parts += [(p, (role == "kwargs") & (F.col("keyword") == word)) for word, p in pattern.get("kwargs", {}).items()]
    out: dict[str, list[tuple[dict, Column]]] = {}
    for p, where in parts:
        if "capture" in p:
            out.setdefault(p["capture"], []).append((p, where))
    return out


def captured(pattern: dict, nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """path, node_id and the values (_v) that the role edges' targets give to a capture."""
    of = matching(pattern, nodes, roles).select(F.col("path").alias("_p"), F.col("node_id").alias("_t"), F.coalesce("text", "name").alias("_w"))
    real = roles.join(of, (F.col("path") == F.col("_p")) & (F.col("target_node") == F.col("_t")))
    seen = real.select("path", "node_id", F.coalesce("_w", "name").alias("_v"))
    if spans(pattern):
        seen = seen.union(bare(pattern, roles).select("path", "node_id", F.col("name").alias("_v")))
    return seen.distinct()


def nearest_ancestor(nodes: DataFrame, pattern: dict, around: DataFrame, roles: DataFrame) -> DataFrame:
    """around's rows with `ancestor`, the node number of their nearest matching strict ancestor."""
    hit = matching(pattern, nodes, roles).select(F.col("path").alias("_p"), F.col("node_id").alias("ancestor"), F.col("subtree_end").alias("_e"))
    both = around.join(hit, (F.col("path") == F.col("_p")) & (F.col("ancestor") < F.col("node_id")) & (F.col("node_id") < F.col("_e")))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("path", "node_id").orderBy(F.col("ancestor").desc()))).where("_n = 1").drop("_n", "_p", "_e")
