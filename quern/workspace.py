"""The driver's tables as program facts, so that the query language and its steps run over whole tables.

An order is a file and a class in it; its lines are methods, call sites and procedures with a small control-flow graph;
parts are library functions that call, extend and override one another; users' events are occurrences, scopes and bindings. The
plain columns of a fact table are SQL that Spark and DuckDB read alike; lists are added by DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .plans.registry import REGISTRY, Flow, Protocol
from .session import ship

TABLES = ("orders", "lineitem", "part", "supplier", "events")
LIB = "-1 - p_partkey"
HALF = "CAST(floor(p_partkey / 2) AS BIGINT)"
#: fact table: its SQL over the driver's tables and the facts before it.
FACTS: dict[str, str] = {
    "lines": "SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, 'o' || CAST(l_orderkey AS STRING) AS path, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag, min(l_linestatus) AS status, max(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "libs": f"SELECT {LIB} AS id, p_partkey AS p, 'lib' || CAST(p_size AS STRING) AS path, CAST(p_size AS BIGINT) AS size, p_brand AS brand, p_type AS type, CASE WHEN p_partkey > 0 THEN -1 - {HALF} END AS up FROM part",
    "marks": "SELECT event_id AS id, 'u' || CAST(user_id AS STRING) AS path, user_id, event_type AS name, event_id AS start_byte, event_id + 1 AS end_byte FROM events",
    "files": "SELECT o_orderkey AS id, 'o' || CAST(o_orderkey AS STRING) AS path, 'sql' AS language FROM orders UNION ALL SELECT -1 - size, path, 'lib' FROM libs GROUP BY size, path UNION ALL SELECT -1000000 - user_id, path, 'log' FROM marks GROUP BY user_id, path",
    "declarations": "SELECT o_orderkey * 8 AS id, 'o' || CAST(o_orderkey AS STRING) AS path, 'class' AS kind, o_orderstatus AS name, CAST(NULL AS BIGINT) AS parent_id, CAST(0 AS BIGINT) AS start_byte, CAST(1000 AS BIGINT) AS end_byte FROM orders UNION ALL SELECT id, path, 'method', flag, o * 8, n * 100, n * 100 + 90 FROM lines UNION ALL SELECT id, path, 'function', brand, up, p * 10, p * 10 + 9 FROM libs",
    "nodes": "SELECT -1000000000000 - o_orderkey AS id, 'o' || CAST(o_orderkey AS STRING) AS path, 'sql' AS language, CAST(0 AS BIGINT) AS node_id, CAST(1000 AS BIGINT) AS subtree_end, 'class' AS kind, o_orderstatus AS name, o_orderpriority AS text, CAST(0 AS BIGINT) AS start_byte, CAST(1000 AS BIGINT) AS end_byte FROM orders UNION ALL SELECT -1 - id, path, 'sql', n * 10, n * 10 + 10, 'method', flag, status, n * 100, n * 100 + 90 FROM lines UNION ALL SELECT id, path, 'sql', n * 10 + 1, n * 10 + 4, 'call', flag, status, n * 100 + 10, n * 100 + 20 FROM lines UNION ALL SELECT 1000000000000 + id * 2, path, 'sql', n * 10 + 2, n * 10 + 3, 'string_literal', flag, flag, n * 100 + 12, n * 100 + 14 FROM lines UNION ALL SELECT 1000000000001 + id * 2, path, 'sql', n * 10 + 3, n * 10 + 4, 'numeric_literal', status, status, n * 100 + 15, n * 100 + 17 FROM lines WHERE qty > 20",
    "roles": "SELECT path, n * 10 + 1 AS node_id, 'callee' AS role, 0 AS ordinal, CAST(NULL AS STRING) AS keyword, CAST(NULL AS BIGINT) AS target_node, flag AS name FROM lines UNION ALL SELECT path, n * 10 + 1, 'receiver', 0, NULL, NULL, status FROM lines WHERE flag <> 'N' UNION ALL SELECT path, n * 10 + 1, 'args', 0, NULL, n * 10 + 2, flag FROM lines UNION ALL SELECT path, n * 10 + 1, 'args', 1, NULL, n * 10 + 3, status FROM lines WHERE qty > 20 UNION ALL SELECT path, n * 10 + 1, 'kwargs', 2, 'b', n * 10 + 3, status FROM lines WHERE qty > 20 UNION ALL SELECT path, n * 10, 'decorators', 0, NULL, NULL, status FROM lines WHERE qty > 40",
    "procedures": "SELECT id, path, n * 100 AS start_byte, n * 100 + 95 AS end_byte FROM lines",
    "points": "SELECT id * 4 AS id, id AS procedure_id, path, 'entry' AS boundary FROM lines UNION ALL SELECT id * 4 + 1, id, path, 'body' FROM lines UNION ALL SELECT id * 4 + 2, id, path, 'normal_exit' FROM lines UNION ALL SELECT id * 4 + 3, id, path, 'exceptional_exit' FROM lines WHERE status = 'F'",
    "control_edges": "SELECT id * 32 AS id, id * 4 AS src, id * 4 + 1 AS dst, path, 'normal' AS edge_kind FROM lines UNION ALL SELECT id * 32 + 1, id * 4 + 1, id * 4 + 2, path, 'conditional_true' FROM lines UNION ALL SELECT id * 32 + 2, id * 4 + 1, id * 4 + 3, path, 'exceptional' FROM lines WHERE status = 'F' UNION ALL SELECT id * 32 + 3, id * 4 + 1, id * 4 + 1, path, 'loop_back' FROM lines WHERE qty > 40",
    "state_events": "SELECT id * 8 AS id, id AS procedure_id, path, id * 4 AS point, 'establish' AS event, 'q' AS subject, 'binding' AS subject_kind FROM lines UNION ALL SELECT id * 8 + 1, id, path, id * 4 + 1, 'establish', 'q', 'binding' FROM lines WHERE qty > 40 UNION ALL SELECT id * 8 + 2, id, path, id * 4 + 2, 'read', 'q', 'binding' FROM lines UNION ALL SELECT id * 8 + 3, id, path, id * 4 + 3, 'read', 'q', 'property' FROM lines WHERE status = 'F' UNION ALL SELECT id * 8 + 4, id, path, id * 4 + 1, 'kill', 'q', 'binding' FROM lines WHERE qty < 10",
    "imports": "SELECT lines.path AS from_path, libs.path AS to_path FROM lines JOIN libs ON lines.part = libs.p GROUP BY lines.path, libs.path",
    "supertypes": "SELECT id AS declaration_id, up AS supertype_id FROM libs WHERE up IS NOT NULL",
    "overrides": "SELECT id AS member_id, up AS base_id, CASE WHEN p % 3 = 0 THEN 'overrides' ELSE 'implements' END AS relation FROM libs WHERE up IS NOT NULL AND p % 2 = 1",
    "refs": "SELECT id, path, -1 - part AS target_id, o * 8 AS enclosing_id, flag AS reference_kind, status AS usage_kind, CASE WHEN qty > 25 THEN 'proven' ELSE 'candidate' END AS proof, n * 100 + 10 AS start_byte, n * 100 + 20 AS end_byte FROM lines",
    "calls": "SELECT id, path, id AS caller_id, -1 - part AS callee_id, CASE WHEN flag <> 'N' THEN status END AS receiver, flag AS first, status AS second, 'proven' AS proof FROM lines UNION ALL SELECT id - 100000000, path, id, up, CAST(NULL AS STRING), brand, type, 'candidate' FROM libs WHERE up IS NOT NULL",
    "parameters": "SELECT id AS callee_id, 0 AS index, 'a' AS label FROM libs UNION ALL SELECT id, 1, 'b' FROM libs UNION ALL SELECT id, 2, 'c' FROM libs",
    "effects": "SELECT id AS callee_id, 'io' AS effect_id FROM libs WHERE size < 10 UNION ALL SELECT id, 'net' FROM libs WHERE size % 7 = 0",
    "signatures": "SELECT id - 200000000 AS id, id AS declaration_id, path, p % 3 AS min_arity, p % 3 + 1 AS max_arity FROM libs",
    "receiver_analyses": "SELECT id * 2 AS id, id AS site_id, path, CASE WHEN flag = 'R' THEN 'unknown' ELSE 'proven' END AS outcome, 'receiver' AS analysis_kind FROM lines WHERE flag <> 'A' UNION ALL SELECT id * 2 + 1, id, path, CASE WHEN user_id % 2 = 0 THEN 'proven' ELSE 'open' END, CASE WHEN id % 3 = 0 THEN 'points_to' ELSE 'member' END FROM marks WHERE name <> 'error'",
    "dispatch_outcomes": "SELECT id, id AS site_id, path, 'complete' AS outcome FROM marks WHERE name = 'view'",
    "dispatch_targets": "SELECT id * 2 AS id, id AS site_id, path, -1 - id % 100 AS target_id, 'proven' AS proof FROM marks WHERE name = 'view' UNION ALL SELECT id * 2 + 1, id, path, -1 - id % 50, 'candidate' FROM marks WHERE name IN ('view', 'click')",
    "occurrences": "SELECT id, path, name, 'value' AS namespace, CASE name WHEN 'signup' THEN 'binder' WHEN 'view' THEN 'value_reference' WHEN 'click' THEN 'member_position' ELSE 'type_operand' END AS role, CASE name WHEN 'signup' THEN 'binder' ELSE 'reference' END AS role_class, start_byte, end_byte, id * 3 AS ast_id, -1 - id % 150 AS target_id, id % 4 AS arity FROM marks",
    "scopes": "SELECT 10000000 + user_id AS id, path, CAST(NULL AS BIGINT) AS parent_id, CAST(0 AS BIGINT) AS start_byte, CAST(100000000 AS BIGINT) AS end_byte FROM marks GROUP BY user_id, path UNION ALL SELECT id, path, 10000000 + user_id, id, id + 600 FROM marks WHERE name = 'signup'",
    "bindings": "SELECT id, path, CASE id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'purchase' END AS name, 'value' AS namespace, FALSE AS wildcard, CASE WHEN name = 'signup' THEN id ELSE 10000000 + user_id END AS scope_id, id AS active_from, id + 500 AS active_to, start_byte, end_byte, id * 3 AS ast_id, CASE WHEN name = 'error' THEN 'local' ELSE 'parameter' END AS kind, 'source_order' AS hoisting FROM marks WHERE name IN ('signup', 'error')",
    "candidates": "SELECT id * 2 AS id, id AS occurrence_id, path, 'own_member' AS tier, 'selected' AS outcome, 'workspace_local' AS boundary, -1 - id % 150 AS target_id, id % 2 = 0 AS applicable, id % 5 = 0 AS selected FROM marks UNION ALL SELECT id * 2 + 1, id, path, 'wildcard_import', 'rejected', 'external_indexed', -1 - id % 90, id % 3 = 0, FALSE FROM marks WHERE name <> 'error'",
    "reference_edges": "SELECT id * 2 AS id, path, -1 - id % 150 AS target_id, id AS site_id, 'forward' AS direction, CASE WHEN id % 2 = 0 THEN 'same_owner' ELSE 'external' END AS owner_relation, 'use_site' AS site_class, 'proven' AS proof FROM marks WHERE name <> 'signup' UNION ALL SELECT id * 2 + 1, path, -1 - id % 150, id, 'inverse', CAST(NULL AS STRING), 'declaration_site', 'proven' FROM marks WHERE name <> 'view'",
    "rewrite_rules": f"SELECT 'lib' || CAST(p_partkey % 10 AS STRING) AS path, p_partkey AS src, {HALF} - {HALF} % 10 + p_partkey % 10 AS dst FROM part WHERE p_partkey % 4 <> 0",
    "paths": "SELECT id, path, 'lib' AS language, brand, type FROM libs",
    "generation_sites": "SELECT id, path, CASE WHEN p % 2 = 0 THEN 'accessor_macro' ELSE 'alias_macro' END AS kind, CASE WHEN p % 5 = 0 THEN 'dynamic' ELSE 'literal' END AS input, p * 10 AS start_byte, p * 10 + 5 AS end_byte FROM libs WHERE p % 3 = 0",
    "declaration_states": "SELECT id * 2 AS id, id AS declaration_id, path, -1 - (p - p % 3) AS generation_site_id, up AS implementation_id, CASE WHEN p % 4 = 0 THEN 'parsed' ELSE 'generated' END AS origin, p % 6 = 0 AS declaration_only, FALSE AS config_gated FROM libs",
    "exports": "SELECT s_suppkey AS id, 'lib' || CAST(s_nationkey AS STRING) AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'named' ELSE 'default_named' END AS form, s_name AS name, -1 - s_suppkey AS target_id FROM supplier",
}


def with_facts(sql: str) -> str:
    """The query with the facts it names, and those they need, as common table expressions."""
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in FACTS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(FACTS[name])
    lead = ", ".join(f"{n} AS ({q})" for n, q in FACTS.items() if n in need)
    recursive = re.match(r"WITH RECURSIVE ", sql)
    rest = re.sub(r"^WITH (RECURSIVE )?", "", sql)
    return f"WITH {'RECURSIVE ' if recursive else ''}{lead}{', ' if rest != sql else ' '}{rest}" if lead else sql


class Workspace(dict):
    """Fact tables made when they are asked for; the named ones are written once, for queries that read them many times."""

    def __init__(self, spark: SparkSession, sf_dir: str, once: tuple[str, ...] = ()):
        super().__init__()
        self.spark, self.once = ship(spark), once
        self.tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES}

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or name in FACTS

    def __or__(self, other):
        out = Workspace.__new__(Workspace)
        dict.__init__(out, {**self, **other})
        out.spark, out.tables, out.once = self.spark, self.tables, self.once
        return out

    def __missing__(self, name: str) -> DataFrame:
        sql = FACTS[name]
        known = {n: self.tables[n] for n in TABLES if re.search(rf"\b(FROM|JOIN) {n}\b", sql)} | {n: self[n] for n in FACTS if n != name and re.search(rf"\b(FROM|JOIN) {n}\b", sql)}
        for n in known:
            sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}} AS {n}", sql)
        rows = self.spark.sql(sql, **known)
        if name in self.once:
            rows = graph.written(rows)
        self[name] = LISTS[name](rows) if name in LISTS else rows
        return self[name]


def argument(position: int, text: str, name: str | None, formal: str) -> F.Column:
    return F.struct(F.lit(position).alias("position"), F.col(text).alias("text"), F.lit(name).cast("string").alias("name"), F.lit(position).alias("formal_index"), F.lit(formal).alias("formal_name"))


LISTS = {
    "calls": lambda rows: rows.withColumn("arguments", F.array(argument(0, "first", None, "a"), argument(1, "second", "b", "b"))),
    "signatures": lambda rows: rows.withColumn("parameters", F.array(*(F.struct(F.lit(i).alias("index"), F.lit(c).alias("label")) for i, c in enumerate("abc")))),
    "receiver_analyses": lambda rows: rows.withColumn("evidence", F.when(F.col("outcome") == "proven", F.array(F.struct(F.lit("value").alias("evidence_kind"), F.col("site_id").alias("value")), F.struct(F.lit("provenance").alias("evidence_kind"), (F.col("site_id") + 1).alias("value"))))),
    "candidates": lambda rows: rows.withColumn("hops", F.when(F.col("tier") == "own_member", F.array(F.struct(F.lit("extends").alias("relation"), "target_id"), F.struct(F.lit("implements").alias("relation"), (F.col("target_id") - 1).alias("target_id"))))),
    "paths": lambda rows: rows.withColumn("segments", F.array(F.struct(F.col("brand").alias("value"), F.array("id").alias("target_ids")), F.struct(F.col("type").alias("value"), F.array("id", F.col("id") - 1).alias("target_ids")))),
}

REGISTRY.protocols["fresh_reads"] = Protocol({("new", "establish"): "live", ("live", "read"): "used", ("live", "establish"): "error", ("error", "read"): "error", ("used", "read"): "used", ("live", "kill"): "dead", ("dead", "read"): "error", ("error", "kill"): "dead"}, "new", ("used",), ("error",))
REGISTRY.flows["values"] = Flow("event = 'establish'", "event = 'read'", "event in ('establish', 'kill')")
REGISTRY.taints["unclean"] = Flow("event = 'establish' and point % 4 = 0", "event = 'read' and subject_kind = 'property'", "event = 'kill'", classes=True)
