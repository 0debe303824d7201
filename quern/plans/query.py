"""The query language: a seed, typed steps, union, intersect and except of branches, a limit.

Queries are JSON documents or s-expressions of the same shape; both are checked completely before a plan is made.
A result's rows have `id`, the kind's columns and `ord`; order is by ord and id, never by how rows were computed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.scalars import glob_regex
from ..operators import joins, patterns, steps
from ..schema import VOCABULARIES, PlanError, checked

#: seed: the kind of its rows, its fact table, its filters with their vocabularies.
SEEDS = {
    "occurrences": ("occurrence", "occurrences", {"role": "role", "role_class": "role_class", "namespace": "namespace", "name": None}),
    "scopes": ("lexical_scope", "scopes", {}),
    "bindings": ("binding", "bindings", {"kind": "binding_kind", "name": None, "hoisting": "hoisting"}),
    "paths": ("qualified_path", "paths", {"min_segments": None}),
    "generation_sites": ("generation_site", "generation_sites", {"kind": "generation_kind", "input": "generation_input"}),
    "exports": ("export", "exports", {"form": "export_form", "name": None}),
    "declarations": ("declaration", "declarations", {"kind": None, "name": None}),
    "files": ("file", "files", {}),
}
SETS = ("union", "intersect", "except")
BRANCHES, STEPS, GLOBS = 16, 16, 128
LIMIT, MOST = 100, 1000
FIELDS = {"schema_version", "match", "where", "languages", "steps", "limit", *SEEDS, *SETS}


def parse(text: str) -> dict:
    """A query from JSON text, or from an s-expression."""
    text = text.strip()
    if text.startswith("{"):
        return json.loads(text)
    return lowered(sexpr(text))


def sexpr(text: str):
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|[()]|[^\s()"]+', re.sub(r";[^\n]*", "", text))
    stack: list[list] = [[]]
    for t in tokens:
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                raise PlanError("", "a parenthesis too many")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(Text(json.loads(t)) if t[0] == '"' else int(t) if re.fullmatch(r"-?\d+", t) else t)
    if len(stack) != 1 or len(stack[0]) != 1:
        raise PlanError("", "one expression with its parentheses is wanted")
    return stack[0][0]


class Text(str):
    """A quoted string, unlike a symbol."""


def lowered(x: list) -> dict:
    """(query (language python) (call :callee (name "audit")) (step enclosing_decl) (limit 5)), or a bare pattern, or
    (union a b), as the JSON document of the same query."""
    head = x[0]
    if head in SETS:
        return {head: [lowered(b) for b in x[1:] if b[0] not in ("limit", "step")]} | parts([b for b in x[1:] if b[0] in ("limit", "step")])
    if head == "query":
        return parts(x[1:])
    if head == "language":
        return {"languages": [x[1]], "match": pattern(x[2])}
    return {"match": pattern(x)}


def parts(xs: list) -> dict:
    out: dict = {}
    for x in xs:
        head = x[0]
        if head == "language":
            out.setdefault("languages", []).extend(map(str, x[1:]))
            continue
        if head == "where":
            out.setdefault("where", []).extend(map(str, x[1:]))
        elif head == "limit":
            out["limit"] = x[1]
        elif head == "step":
            out.setdefault("steps", []).append({"op": x[1]} | {k[1:]: v for k, v in zip(x[2::2], x[3::2])})
        elif head in SEEDS:
            out[head] = {k[1:]: v for k, v in zip(x[1::2], x[2::2])}
        else:
            out["match"] = pattern(x)
    return out


def pattern(x: list) -> dict:
    """(call :callee (name "f") :args ((name "a"))), (name "f"), (_ :has (...)): the head is a kind unless it is a field."""
    if x[0] in ("name", "text", "name_regex", "capture"):
        return {str(x[0]): str(x[1])}
    out: dict = {} if x[0] == "_" else {"kind": str(x[0])}
    i = 1
    while i < len(x):
        if isinstance(x[i], list):
            out |= pattern(x[i])
            i += 1
            continue
        field, value = x[i][1:].replace("-", "_"), x[i + 1]
        if field in ("args", "decorators"):
            out[field] = [pattern(v) for v in value]
        elif field == "kwargs":
            out[field] = {str(v[0]): pattern(v[1]) for v in value}
        elif field == "arity":
            out[field] = {k[1:]: v for k, v in zip(value[::2], value[1::2])}
        else:
            out[field] = pattern(value) if isinstance(value, list) else str(value)
        i += 2
    return out


def check(query: Mapping, path: str = "") -> str:
    """The kind of the query's rows. Unknown fields, versions, steps, options and values are refused."""
    at = lambda p: f"{path}.{p}" if path else p
    if unknown := set(query) - FIELDS:
        raise PlanError(path, f"unknown fields {sorted(unknown)}")
    if query.get("schema_version", 1) != 1:
        raise PlanError(at("schema_version"), "the version is 1")
    heads = [k for k in query if k == "match" or k in SEEDS or k in SETS]
    if len(heads) != 1:
        raise PlanError(path, "one seed or one set operator is wanted")
    head = heads[0]
    if len(query.get("where", [])) > GLOBS or len(query.get("steps", [])) > STEPS:
        raise PlanError(path, "too many globs or steps")
    if not 1 <= query.get("limit", LIMIT) <= MOST:
        raise PlanError(at("limit"), f"a limit is 1 to {MOST}")
    if head in SETS:
        branches = query[head]
        if not 2 <= len(branches) <= BRANCHES:
            raise PlanError(at(head), f"2 to {BRANCHES} branches")
        kinds = [check(b, at(f"{head}[{i}]")) for i, b in enumerate(branches)]
        if len(set(kinds)) > 1:
            raise PlanError(at(head), f"branches differ in kind: {kinds}")
        kind = kinds[0]
    elif head == "match":
        patterns.check(query["match"], at("match"))
        kind = "match"
    else:
        kind, _, options = SEEDS[head]
        for k, v in query[head].items():
            if k not in options:
                raise PlanError(at(head), f"no filter {k!r}")
            if options[k] in VOCABULARIES:
                checked(options[k], v, at(head))
    for i, s in enumerate(query.get("steps", [])):
        here = at(f"steps[{i}]")
        steps.check_step(s["op"], kind, {k: v for k, v in s.items() if k != "op"}, here)
        kind = steps.gives(s["op"], kind)
    return kind


def rows(query: Mapping, facts: steps.Facts) -> DataFrame:
    """The rows of a checked query before its limit, one for each id."""
    head = next(k for k in query if k == "match" or k in SEEDS or k in SETS)
    if head in SETS:
        out = {"union": union, "intersect": intersect, "except": difference}[head]([rows(b, facts) for b in query[head]])
        kind = check(query[head][0])
    else:
        if head == "match":
            kind, found = "match", patterns.matching(query["match"], facts["nodes"], facts["roles"])
        else:
            kind, table, options = SEEDS[head]
            given = dict(query[head])
            least = given.pop("min_segments", None)
            found = steps.filtered(facts[table], given, options)
            if head == "paths":
                found = found.where(F.size("segments") >= max(2, least or 2))
        if globs := query.get("where"):
            found = found.where(reduce(Column.__or__, (F.col("path").rlike(glob_regex(g)) for g in globs)))
        if languages := query.get("languages"):
            found = found.where(F.col("language").isin(*languages))
        # A total order without a shuffle: by path, place and id; the numbers are what sets and steps put before it.
        place = F.col("start_byte") if "start_byte" in found.columns else F.lit(0)
        own = F.col("id").cast("long") if isinstance(found.schema["id"].dataType, IntegralType) else F.lit(0).cast("long")
        out = found.withColumn("ord", order(F.col("path"), place, own))
    for s in query.get("steps", []):
        kind, out = steps.run_step(s["op"], kind, out, facts, {k: v for k, v in s.items() if k != "op"})
    return out


def order(path: Column, place: Column, own: Column) -> Column:
    """A seed's place in the order of paths, as numbers that compare as the paths' bytes do (by eights), then place and id."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(path) / 7).cast("int")), lambda i: F.conv(F.rpad(F.hex(F.substring(F.encode(path, "UTF-8"), i * 7 + 1, F.lit(7))), 14, "0"), 16, 10).cast("long"))
    return F.concat(chunks, F.array(F.lit(-1).cast("long"), place.cast("long"), own))


def union(branches: list[DataFrame]) -> DataFrame:
    """Distinct by id; the branches' order, then the rows'."""
    ordered = [b.withColumn("ord", F.concat(F.array(F.lit(i).cast("long")), "ord")) for i, b in enumerate(branches)]
    return joins.first_seen(reduce(lambda a, b: a.unionByName(b, True), ordered), ["id"])


def intersect(branches: list[DataFrame]) -> DataFrame:
    """The first branch's rows whose id every branch has."""
    return joins.first_seen(reduce(lambda a, b: a.join(b.select("id"), "id", "left_semi"), branches[1:], branches[0]), ["id"])


def difference(branches: list[DataFrame]) -> DataFrame:
    """The first branch's rows whose id no other branch has; nothing else is made distinct."""
    return reduce(lambda a, b: a.join(b.select("id"), "id", "left_anti"), branches[1:], branches[0])


def every(query: Mapping | str, facts: steps.Facts) -> DataFrame:
    """All rows of a query, whatever its limit."""
    query = parse(query) if isinstance(query, str) else query
    check(query)
    return rows(query, facts)


def run(query: Mapping | str, facts: steps.Facts) -> tuple[DataFrame, DataFrame]:
    """The first `limit` rows in order, and a one-row frame that says whether there were more."""
    query = parse(query) if isinstance(query, str) else query
    check(query)
    n = query.get("limit", LIMIT)
    probe = rows(query, facts).orderBy("ord", "id").limit(n + 1)
    return probe.limit(n), probe.agg((F.count(F.lit(1)) > n).alias("truncated"))
