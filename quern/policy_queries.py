"""Registered queries of the assertion families, expansions, navigation, reports and control-flow facts, each with its SQL.

They run over the fact tables of `workspace`, or over the driver's tables as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import graph, navigation, patterns, reports
from .plans import assertions, policy
from .plans.relational import EXPANSIONS, Bound, Compiled, Expand, Plan, Project, Source, selected_in_winning_tier, step_expansions
from .workspace import Workspace, with_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str, once: tuple[str, ...] = ()):
    def add(f: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda s, d: f(Workspace(s, d, once))
        SQL[name] = with_facts(sql)
        return f

    return add


def col(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(n.split("=")[-1]).alias(n.split("=")[0]) for n in names))


# Assertion families.
register("assert_occurrence", "SELECT b.id, count(o.id) AS found FROM bindings b LEFT JOIN occurrences o ON o.ast_id = b.ast_id AND role = 'binder' GROUP BY 1 HAVING count(o.id) <> 1")(
    lambda w: assertions.occurrence(w["bindings"], w["occurrences"], "exactly", 1, True, role="binder"))
CHOSEN = "SELECT o.id, count(c.id) AS selected, min(c.tier) AS tier FROM occurrences o LEFT JOIN candidates c ON c.occurrence_id = o.id AND c.selected GROUP BY 1"
register("assert_resolution", f"SELECT * FROM ({CHOSEN}) WHERE tier IS DISTINCT FROM 'own_member' OR selected <> 1")(lambda w: assertions.resolution(w["occurrences"], w["candidates"], expect_tier="own_member", require_unique=True))
register("assert_resolution_forbid", f"SELECT * FROM ({CHOSEN}) WHERE tier = 'own_member' OR tier IS NULL")(lambda w: assertions.resolution(w["occurrences"], w["candidates"], at_least="wildcard_import", forbid_tier="own_member"))
IN_SIGNUP = "EXISTS (SELECT 1 FROM scopes s WHERE s.parent_id IS NOT NULL AND s.path = {0}.path AND s.start_byte <= {0}.start_byte AND {0}.end_byte <= s.end_byte)"
register("assert_binding_scope", f"SELECT id FROM bindings b WHERE NOT {IN_SIGNUP.format('b')}")(lambda w: assertions.binding_scope(w["bindings"], w["scopes"].where("parent_id is not null")))
register("assert_binding_outside", f"SELECT id FROM bindings b WHERE {IN_SIGNUP.format('b')}")(lambda w: assertions.binding_scope(w["bindings"], w["scopes"].where("parent_id is not null"), "outside"))
register("assert_value_origin", "SELECT id FROM occurrences o WHERE name = 'view' AND NOT EXISTS (SELECT 1 FROM bindings b JOIN scopes s ON s.parent_id IS NOT NULL AND s.path = b.path AND s.start_byte <= b.start_byte AND b.end_byte <= s.end_byte WHERE b.path = o.path AND b.name = o.name AND b.start_byte <= o.start_byte)")(
    lambda w: assertions.value_origin(w["occurrences"].where("name = 'view'"), w["occurrences"].where("name = 'view'").select(F.col("id").alias("read_id"), F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("start_byte").alias("_s")).join(w["bindings"], (F.col("_p") == F.col("path")) & (F.col("_n") == F.col("name")) & (F.col("start_byte") <= F.col("_s"))), w["scopes"].where("parent_id is not null")))
register("assert_boundary", "SELECT id FROM occurrences WHERE id IN (SELECT occurrence_id FROM candidates WHERE tier = 'wildcard_import' AND applicable) AND id IN (SELECT occurrence_id FROM candidates WHERE boundary = 'workspace_local')")(
    lambda w: assertions.boundary(w["occurrences"], w["candidates"].withColumn("selected", F.col("applicable")), "workspace_local"))
IDENTITY = "SELECT l_orderkey AS token, l_partkey AS identity FROM lineitem"


def tokens(w: Workspace) -> tuple[DataFrame, DataFrame]:
    return w.tables["orders"].where("o_orderkey > 0").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") - 1).alias("b")), w.tables["lineitem"].select(F.col("l_orderkey").alias("token"), F.col("l_partkey").alias("identity"))


SHARED = "SELECT o_orderkey AS a, o_orderkey - 1 AS b FROM orders WHERE o_orderkey > 0 AND {} (SELECT 1 FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey WHERE x.l_orderkey = o_orderkey AND y.l_orderkey = o_orderkey - 1)"
register("assert_canonical_equals", SHARED.format("NOT EXISTS"))(lambda w: assertions.canonical(*tokens(w)))
register("assert_canonical_distinct", SHARED.format("EXISTS"))(lambda w: assertions.canonical(*tokens(w), "distinct"))
register("assert_route", "WITH RECURSIVE hops AS (SELECT id AS src, up AS dst FROM libs WHERE up IS NOT NULL AND p % 7 <> 0), r AS (SELECT id AS root, id AS here, 0 AS k FROM libs WHERE size = 3 UNION SELECT root, dst, k + 1 FROM r JOIN hops ON here = src WHERE k < 16) SELECT id FROM libs WHERE size = 3 AND id NOT IN (SELECT root FROM r WHERE here = -1)")(
    lambda w: assertions.route(w["libs"].where("size = 3"), w["libs"].where("p = 0"), w["libs"].where("up is not null").select(F.col("id").alias("src"), F.col("up").alias("dst"), F.when(F.col("p") % 7 == 0, "alias").otherwise("extends").alias("kind")), ["extends", "alias"], ["alias"], 16))
PARITY = "WITH f AS (SELECT DISTINCT target_id, site_id FROM reference_edges WHERE direction = 'forward'), i AS (SELECT DISTINCT target_id, site_id FROM reference_edges WHERE direction = 'inverse') SELECT target_id, site_id, 'forward_only' AS side FROM (SELECT * FROM f EXCEPT SELECT * FROM i) UNION ALL SELECT target_id, site_id, 'inverse_only' FROM (SELECT * FROM i EXCEPT SELECT * FROM f)"
register("assert_edge_parity", PARITY)(lambda w: assertions.edge_parity(*(w["reference_edges"].where(F.col("direction") == x) for x in ("forward", "inverse")), ["target_id", "site_id"]))
register("assert_edge_class", "SELECT id FROM reference_edges WHERE NOT (coalesce(owner_relation, 'unattributed') IN ('same_owner', 'unattributed') AND site_class = 'use_site')")(lambda w: col(assertions.edge_class(w["reference_edges"], owner_relation=["same_owner", "unattributed"], site_class=["use_site"]), "id"))
register("assert_round_trip", "SELECT DISTINCT caller_id AS a, callee_id AS b FROM calls c WHERE receiver IS NULL AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.receiver IS NOT NULL AND d.callee_id = c.callee_id AND d.caller_id = c.caller_id + 1)")(
    lambda w: assertions.round_trip(col(w["calls"].where("receiver is null"), "a=caller_id", "b=callee_id"), w["calls"].where("receiver is not null").select((F.col("caller_id") - 1).alias("a"), F.col("callee_id").alias("b")), ["a", "b"]))
register("assert_generation", "SELECT g.id, count(s.id) AS found FROM generation_sites g LEFT JOIN declaration_states s ON generation_site_id = g.id AND origin = 'generated' GROUP BY 1 HAVING count(s.id) < 3")(lambda w: assertions.generation(w["generation_sites"], w["declaration_states"], "generated", 3))
register("assert_declaration_state", "SELECT id FROM libs WHERE NOT (p % 4 = 0 AND p % 6 = 0)")(lambda w: assertions.declaration_state(w["libs"], w["declaration_states"], origin="parsed", declaration_only=True))
register("assert_rewrite_termination", "SELECT path, src AS name FROM rewrite_rules r WHERE src = dst AND src < 0 UNION ALL SELECT path, src FROM rewrite_rules WHERE FALSE UNION ALL SELECT 'x', u FROM (SELECT o_orderkey AS u FROM orders WHERE o_orderkey % 10 IN (1, 2, 3)) WHERE u % 10 <> 0")(
    lambda w: assertions.rewrite_termination(graph.rewrite_chase(col(w.tables["orders"], "id=o_orderkey"), w.tables["orders"].where("o_orderkey % 10 in (1, 2, 3)").select(F.col("o_orderkey").alias("src"), F.when(F.col("o_orderkey") % 10 == 3, F.col("o_orderkey") - 2).otherwise(F.col("o_orderkey") + 1).alias("dst")), 8)).select(F.lit("x").alias("path"), F.col("id").alias("name")))
register("assert_flow_establishment", "SELECT id * 8 + k AS id FROM lines, (VALUES (2), (3)) x(k) WHERE (k = 2 OR status = 'F') AND qty < 10 AND flag = 'R'", ("lines",))(
    lambda w: (lambda mine: assertions.flow_establishment(mine.where("event = 'read'"), flows(w, mine)))(w["state_events"].join(col(w["lines"].where("flag = 'R'"), "procedure_id=id"), "procedure_id", "left_semi")))


def flows(w: Workspace, events: DataFrame) -> DataFrame:
    """relation, target_id, certainty of the reads among the events."""
    from .operators.steps import run_step

    rows = col(events, "id=procedure_id").distinct().withColumn("path", F.lit("p")).withColumn("ord", F.array(F.lit(0).cast("long")))
    return run_step("flow_relations_of", "procedure", rows, w)[1]


# Expansions of relational plans.
TAKEN = {"receiver_outcome": ("site_id outcome", "SELECT o.id AS site_id, coalesce(outcome, 'unknown') AS outcome FROM occurrences o LEFT JOIN receiver_analyses r ON r.site_id = o.id AND r.analysis_kind <> 'receiver'"),
         "receiver_evidence": ("ordinal value", "SELECT k AS ordinal, site_id + k AS value FROM receiver_analyses r JOIN occurrences o ON o.id = site_id, (VALUES (0), (1)) x(k) WHERE outcome = 'proven' AND analysis_kind <> 'receiver'"),
         "member_selection": ("occurrence_id candidate_count selected_count", "SELECT o.id AS occurrence_id, count(c.id) AS candidate_count, count(*) FILTER (WHERE c.selected) AS selected_count FROM occurrences o LEFT JOIN candidates c ON o.id = c.occurrence_id GROUP BY 1"),
         "candidate_hierarchy": ("parent_id ordinal relation", "SELECT id AS parent_id, k AS ordinal, r AS relation FROM candidates, (VALUES (0, 'extends'), (1, 'implements')) x(k, r) WHERE tier = 'own_member'"),
         "dispatch_outcome": ("site_id outcome", "SELECT id AS site_id, CASE name WHEN 'view' THEN 'complete' ELSE 'unknown' END AS outcome FROM occurrences"),
         "dispatch_targets": ("site_id target_id", "SELECT site_id, target_id FROM dispatch_targets"),
         "member_family": ("declaration_id outcome", "SELECT id AS declaration_id, CASE WHEN id IN (SELECT member_id FROM overrides) OR id IN (SELECT base_id FROM overrides) THEN 'proven' ELSE 'no_family' END AS outcome FROM declarations WHERE kind = 'function'"),
         "family_edges": ("source_id target_id", "SELECT member_id AS source_id, base_id AS target_id FROM overrides UNION ALL SELECT base_id, member_id FROM overrides")}


def expanded(step: str) -> Callable[[Workspace], DataFrame]:
    def run(w: Workspace) -> DataFrame:
        kind = "declaration" if "declaration" in EXPANSIONS[step][0] else "occurrence"
        rows = w["declarations"].where("kind = 'function'") if kind == "declaration" else w["occurrences"]
        facts = w | {"receiver_analyses": w["receiver_analyses"].where("analysis_kind <> 'receiver'")}
        plan = Plan((Source("s", "s"), Expand("e", "s", step), Project("p", "e", {c: c for c in TAKEN[step][0].split()})))
        return Compiled(plan, {"s": Bound(rows, kind=kind)}, step_expansions(facts)).rows("p")

    return run


for _step, (_, _sql) in TAKEN.items():
    register(f"expand_{_step}", _sql)(expanded(_step))


@register("assert_selected_in_winning_tier", "SELECT o.id, count(*) FILTER (WHERE c.selected AND c.tier = 'own_member') AS n FROM occurrences o JOIN candidates c ON c.occurrence_id = o.id GROUP BY 1 HAVING count(*) FILTER (WHERE c.selected AND c.tier = 'own_member') <> 1")
def _winning(w: Workspace) -> DataFrame:
    relations, assertion = selected_in_winning_tier("o", "c", "id")
    rows = w["candidates"].select(F.col("occurrence_id").alias("id"), "selected", (F.col("tier") == "own_member").alias("winning"))
    plan = Plan((Source("o", "o"), Source("c", "c"), *relations), (assertion,))
    return Compiled(plan, {"o": Bound(col(w["occurrences"], "id")), "c": Bound(rows)}).violations(assertion).select("id", "n")


# Navigation.
PLACES = "SELECT event_id AS place_id, 'o' || CAST(event_id % 500 AS STRING) AS path, event_id % 800 AS here FROM events"
register("nav_definitions_at", f"SELECT place_id, d.id AS declaration_id, d.path AS declared_in, d.name FROM ({PLACES}) q JOIN refs ON q.path = refs.path AND start_byte <= here AND here <= end_byte JOIN declarations d ON d.id = target_id")(
    lambda w: navigation.definitions_at(w.tables["events"].select(F.col("event_id").alias("place_id"), F.concat(F.lit("o"), (F.col("event_id") % 500).cast("string")).alias("path"), (F.col("event_id") % 800).alias("at")), w["refs"], w["declarations"]))
register("nav_symbol_sources", "SELECT s_suppkey AS id, substr(s_name, 3, 5) AS source FROM supplier")(
    lambda w: navigation.symbol_sources(w.tables["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("path"), F.lit(2).alias("start_byte"), F.lit(7).alias("end_byte")), w.tables["supplier"].select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_name").alias("text"))))
register("nav_ancestors", "WITH RECURSIVE r AS (SELECT id AS root, parent_id AS here, 1 AS k FROM declarations WHERE kind = 'function' AND name = 'Brand#11' AND parent_id IS NOT NULL UNION ALL SELECT root, parent_id, k + 1 FROM r JOIN declarations d ON d.id = here WHERE parent_id IS NOT NULL) SELECT root AS id, here AS ancestor, CAST(k AS INTEGER) AS distance FROM r")(
    lambda w: navigation.ancestors(w["declarations"], w["declarations"].where("kind = 'function' and name = 'Brand#11'")))
RENAMES = "SELECT id AS declaration_id, 'Brand#11' AS new_name FROM declarations WHERE kind = 'function' AND name = 'Brand#12'"
FREE = f"SELECT d.*, new_name FROM declarations d JOIN ({RENAMES}) ON d.id = declaration_id WHERE NOT EXISTS (SELECT 1 FROM declarations x WHERE x.parent_id IS NOT DISTINCT FROM d.parent_id AND x.name = new_name AND x.id <> d.id)"
register("nav_rename", f"WITH free AS ({FREE}) SELECT path, start_byte, start_byte + length(name) AS end_byte, new_name AS text FROM free UNION SELECT refs.path, refs.start_byte, refs.end_byte, new_name FROM refs JOIN free ON target_id = free.id")(
    lambda w: navigation.rename(w["declarations"], w["refs"], w["declarations"].where("kind = 'function' and name = 'Brand#12'").select(F.col("id").alias("declaration_id"), F.lit("Brand#11").alias("new_name"))))


def texts(w: Workspace) -> DataFrame:
    return w.tables["supplier"].select(F.concat(F.lit("s/"), "s_name").alias("path"), F.col("s_name").alias("text"))


register("nav_file_contents", "SELECT 's/' || s_name AS path, s_name AS text FROM supplier WHERE s_name LIKE '%1'")(lambda w: navigation.file_contents(texts(w), ["s/*1"]))
register("nav_files_containing", "SELECT 's/' || s_name AS path, CAST(1 AS BIGINT) AS lines FROM supplier WHERE regexp_matches(s_name, '[13]$')")(lambda w: navigation.files_containing(texts(w), "[13]$"))

# Reports.
KINDS = "CASE CAST(l_linenumber AS BIGINT) % 5 WHEN 0 THEN 'shallow' WHEN 1 THEN 'meaningful' WHEN 2 THEN 'tautology' WHEN 3 THEN 'nullness' ELSE 'meaningful' END"
register("report_test_assertions", f"WITH a AS (SELECT l_orderkey AS id, {KINDS} AS kind FROM lineitem WHERE l_quantity > 30), p AS (SELECT id, sum(CASE kind WHEN 'tautology' THEN 6 WHEN 'nullness' THEN 2 ELSE 0 END) AS s, count(*) AS n, count(*) FILTER (WHERE kind = 'shallow') AS sh, count(*) FILTER (WHERE kind = 'meaningful') AS g FROM a GROUP BY 1), r AS (SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN 5 ELSE s + CASE WHEN sh + g = n AND sh > 0 THEN greatest(0, 2 - least(g, 4)) ELSE 0 END END AS score FROM orders LEFT JOIN p ON id = o_orderkey) SELECT id, CAST(score AS BIGINT) AS score FROM r WHERE score >= 4")(
    lambda w: reports.test_assertion_smells(col(w.tables["orders"], "id=o_orderkey"), w.tables["lineitem"].where("l_quantity > 30").select(F.col("l_orderkey").alias("test_id"), F.expr(KINDS).alias("kind"))))


@register("report_cognitive", "SELECT o_orderkey AS id, coalesce(sum(CASE WHEN qty > 40 THEN 3 WHEN qty IS NOT NULL THEN 1 ELSE 0 END), 0) + count(CASE WHEN qty > 20 THEN 1 END) AS complexity FROM orders LEFT JOIN lines ON o = o_orderkey GROUP BY 1")
def _cognitive(w: Workspace) -> DataFrame:
    """A line is an `if`; a large one has a loop in it, and one above 20 an else_if beside."""
    line = w["lines"].select("path", "n", "qty")
    nodes = line.select("path", (F.col("n") * 10).alias("node_id"), (F.col("n") * 10 + 8).alias("subtree_end"), F.lit("if").alias("kind")).union(line.where("qty > 40").select("path", F.col("n") * 10 + 1, F.col("n") * 10 + 3, F.lit("for_loop"))).union(line.where("qty > 20").select("path", F.col("n") * 10 + 4, F.col("n") * 10 + 5, F.lit("else_if")))
    classes = w["nodes"].where("kind = 'class'").select((-F.col("id") - 1000000000000).alias("id"), "path", "node_id", "subtree_end")
    return reports.cognitive(nodes, classes)


BAG = "SELECT o AS id, {0} AS label, count(*) AS n FROM lines GROUP BY 1, 2"


def overlap_sql(name: str, column: str) -> str:
    return f"{name}b AS ({BAG.format(column)}), {name}s AS (SELECT id, sum(n) AS s FROM {name}b GROUP BY 1), {name}l AS (SELECT q.a, q.b, sum(least(x.n, y.n)) AS low FROM q JOIN {name}b x ON x.id = q.a JOIN {name}b y ON y.id = q.b AND x.label = y.label GROUP BY 1, 2), {name} AS (SELECT q.a, q.b, CASE WHEN coalesce(x.s, 0) + coalesce(y.s, 0) - coalesce(low, 0) = 0 THEN 1.0 ELSE coalesce(low, 0)::DOUBLE / (coalesce(x.s, 0) + coalesce(y.s, 0) - coalesce(low, 0)) END AS v FROM q LEFT JOIN {name}s x ON x.id = q.a LEFT JOIN {name}s y ON y.id = q.b LEFT JOIN {name}l l ON l.a = q.a AND l.b = q.b)"


@register("report_label_similarity", f"WITH q AS (SELECT o_orderkey AS a, o_orderkey - 1 AS b FROM orders WHERE o_orderkey > 0), {overlap_sql('lab', 'flag')}, {overlap_sql('con', 'status')} SELECT a, b, CAST(round(100 * (2 * lab.v + con.v) / 3) AS BIGINT) AS score FROM lab JOIN con USING (a, b)")
def _labels(w: Workspace) -> DataFrame:
    bag = lambda c: w["lines"].groupBy(F.col("o").alias("id"), F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return reports.label_similarity(tokens(w)[0], bag("flag"), bag("status"))


OLD = "SELECT p AS key, brand AS name, 'f' AS kind, CAST(size % 3 AS STRING) AS signature, CAST(size AS STRING) || brand || type AS body FROM libs WHERE p % 10 <> 0"
NEW = "SELECT CASE WHEN p % 10 = 1 THEN p + 1000000 ELSE p END AS key, brand AS name, 'f' AS kind, CAST(CASE WHEN p % 10 = 2 THEN 9 ELSE size % 3 END AS STRING) AS signature, CAST(size AS STRING) || brand || type || CASE WHEN p % 10 = 3 THEN '!' ELSE '' END AS body FROM libs WHERE p % 10 <> 4"
DIFF = f"o AS ({OLD}), n AS ({NEW}), g AS (SELECT * FROM o WHERE key NOT IN (SELECT key FROM n)), c AS (SELECT * FROM n WHERE key NOT IN (SELECT key FROM o)), m AS (SELECT max(c.key) AS key, max(g.key) AS was FROM g JOIN c USING (name, kind, body) GROUP BY name, kind, body HAVING count(*) = 1)"


def snapshots(w: Workspace) -> tuple[DataFrame, DataFrame]:
    at = lambda sql: w.spark.sql(sql.replace("FROM libs", "FROM {libs}"), libs=w["libs"])
    return at(OLD), at(NEW)


register("report_diff", f"WITH {DIFF} SELECT n.key, CASE WHEN o.signature <> n.signature THEN 'signature_changed' WHEN o.body <> n.body THEN 'edited' ELSE 'unchanged' END AS state, n.key AS was FROM o JOIN n USING (key) UNION ALL SELECT key, 'moved', was FROM m UNION ALL SELECT key, 'deleted', key FROM g WHERE key NOT IN (SELECT was FROM m) UNION ALL SELECT key, 'introduced', NULL FROM c WHERE key NOT IN (SELECT key FROM m)")(lambda w: reports.diff(*snapshots(w)))


@register("report_edge_diff", f"WITH {DIFF}, a AS (SELECT DISTINCT coalesce(x.key, p) AS src, coalesce(y.key, p // 2) AS dst FROM libs LEFT JOIN m x ON x.was = p LEFT JOIN m y ON y.was = p // 2 WHERE p > 0), b AS (SELECT DISTINCT CASE WHEN p % 10 = 1 THEN p + 1000000 ELSE p END AS src, p // 2 AS dst FROM libs WHERE p > 0) SELECT src, dst, 'added' AS state FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT src, dst, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def _edges(w: Workspace) -> DataFrame:
    half = F.floor(F.col("p") / 2).cast("long").alias("dst")
    p = w["libs"].where("p > 0")
    return reports.edge_diff(p.select(F.col("p").alias("src"), half), p.select(F.when(F.col("p") % 10 == 1, F.col("p") + 1000000).otherwise(F.col("p")).alias("src"), half), reports.diff(*snapshots(w)).where("state = 'moved'"))


register("report_finding_identity", "SELECT id, sha256('finding' || chr(0) || path || chr(0) || flag) AS finding_id FROM lines WHERE qty > 49")(lambda w: col(reports.identified(w["lines"].where("qty > 49"), "path", "flag"), "id", "finding_id"))
register("report_suppression", "SELECT l.id, CASE WHEN u IS NULL THEN 'open' WHEN u >= TIMESTAMP '1998-01-01' THEN 'suppressed' ELSE 'expired' END AS state FROM lines l LEFT JOIN (SELECT l_orderkey * 8 + l_linenumber AS id, max(l_shipdate) AS u FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON l.id = s.id")(
    lambda w: col(reports.suppressed(w["lines"].withColumnRenamed("id", "finding_id"), w.tables["lineitem"].where("l_returnflag = 'R'").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("finding_id"), F.col("l_shipdate").alias("until")), "1998-01-01"), "id=finding_id", "state"))
register("report_near_misses", "SELECT id, failed FROM (SELECT id, CASE WHEN flag <> 'R' THEN 1 ELSE 0 END + CASE WHEN status <> 'F' THEN 1 ELSE 0 END + CASE WHEN qty <= 45 THEN 1 ELSE 0 END AS failed FROM lines) WHERE failed > 0 ORDER BY failed, id LIMIT 50")(
    lambda w: reports.near_misses(w["lines"], {"flag": F.col("flag") == "R", "status": F.col("status") == "F", "qty": F.col("qty") > 45}, 50).select("id", F.size("failed").alias("failed")))
register("report_exception_smells", "WITH h AS (SELECT id, CASE flag WHEN 'R' THEN 'Throwable' WHEN 'A' THEN 'Exception' ELSE 'RuntimeException' END AS caught, CAST(qty AS BIGINT) % 5 AS st, status = 'F' AS comment_only, n % 2 = 0 AS log_only FROM lines), r AS (SELECT id, CASE caught WHEN 'Throwable' THEN 5 WHEN 'Exception' THEN 3 ELSE 2 END + CASE WHEN st = 0 AND NOT comment_only THEN 5 ELSE 0 END + CASE WHEN comment_only THEN 4 ELSE 0 END + CASE WHEN st BETWEEN 1 AND 2 THEN 2 ELSE 0 END + CASE WHEN log_only THEN 2 ELSE 0 END - least(st, 6) AS score FROM h) SELECT id, CAST(score AS BIGINT) AS score FROM r WHERE score >= 4")(
    lambda w: reports.exception_smells(w["lines"].select("id", F.when(F.col("flag") == "R", "Throwable").when(F.col("flag") == "A", "Exception").otherwise("RuntimeException").alias("caught"), (F.col("qty").cast("long") % 5).cast("int").alias("statements"), (F.col("status") == "F").alias("comment_only"), (F.col("n") % 2 == 0).alias("log_only"))))
register("report_size_smells", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 AND (p_size * 3 > 80 OR p_size % 15 > 10) THEN 'long_method' WHEN p_partkey % 2 = 1 AND (p_size * 8 > 300 OR p_size % 25 > 20 OR p_size % 18 > 15) THEN 'god_object' END AS smell FROM part WHERE (p_partkey % 2 = 0 AND (p_size * 3 > 80 OR p_size % 15 > 10)) OR (p_partkey % 2 = 1 AND (p_size * 8 > 300 OR p_size % 25 > 20 OR p_size % 18 > 15))")(
    lambda w: reports.size_smells(w.tables["part"].select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "method").otherwise("class").alias("kind"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") * 3).otherwise(F.col("p_size") * 8).alias("lines"), (F.col("p_size") % 15).alias("complexity"), (F.col("p_size") % 25).alias("children"), (F.col("p_size") % 18).alias("functions"))))
PATHS = "SELECT 'src/' || CASE WHEN s_suppkey % 2 = 0 THEN 'main' ELSE 'test' END || '/pkg' || CAST(s_suppkey % 7 AS STRING) || '/' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'test_' END || 'mod' || CAST(s_suppkey % 5 AS STRING) || '.py' AS path FROM supplier"
register("report_mirror_keys", f"SELECT path, 'pkg' || regexp_extract(path, 'pkg([0-9])', 1) || '/mod' || regexp_extract(path, 'mod([0-9])', 1) AS mirror FROM ({PATHS})")(lambda w: reports.prefix_free(w.spark.sql(PATHS.replace("FROM supplier", "FROM {supplier}"), supplier=w.tables["supplier"])))
register("report_markdown_cells", "SELECT p_partkey AS id, replace(replace(p_name || ' | ' || p_type || chr(10) || p_brand, ' ' || chr(10), chr(10)), '|', chr(92) || '|') AS cell FROM part WHERE FALSE UNION ALL SELECT p_partkey, replace(p_name || ' | ' || p_type, '|', chr(92) || '|') || ' ' || p_brand FROM part")(
    lambda w: w.tables["part"].select(F.col("p_partkey").alias("id"), scalars.cell(F.concat("p_name", F.lit(" | "), "p_type", F.lit("\n"), "p_brand")).alias("cell")))
register("report_embedding_text", "SELECT p_partkey AS id, 'path: lib' || p_size || chr(10) || 'symbol: ' || p_name || chr(10) || 'signature: ' || p_brand || chr(10) || p_type AS text FROM part")(
    lambda w: w.tables["part"].select(F.col("p_partkey").alias("id"), scalars.embedding_text(F.concat(F.lit("lib"), F.col("p_size").cast("string")), F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("text")))
register("report_token_kinds", "SELECT p_partkey AS id, k AS token, CASE WHEN regexp_matches(k, '^[0-9]') THEN 'NUM' WHEN k IN ('true', 'false') THEN 'BOOL' WHEN regexp_matches(k, '^[A-Za-z_]') THEN 'ID' ELSE 'OP' END AS kind FROM (SELECT p_partkey, unnest(regexp_extract_all(p_brand || '=' || p_size || '+true', '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS k FROM part)")(
    lambda w: w.tables["part"].select(F.col("p_partkey").alias("id"), F.explode(scalars.tokens(F.concat("p_brand", F.lit("="), F.col("p_size").cast("string"), F.lit("+true")))).alias("token")).select("id", "token", scalars.normalized(F.col("token")).alias("kind")))

# Control-flow facts, by the shapes of the lines' graphs.
ROWS = {
    "dominates": "SELECT id * 4 + a AS a, id * 4 + b AS b, status, 0 AS q FROM lines, (VALUES (0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 3)) x(a, b) WHERE flag = 'R' AND (a < 3 OR status = 'F')",
    "postdominates": "SELECT id * 4 + a AS a, id * 4 + b AS b, status, 0 AS q FROM lines, (VALUES (0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (3, 3)) x(a, b) WHERE flag = 'R' AND (a < 3 OR status = 'F') AND NOT (status = 'F' AND a < 2 AND b = 2)",
    "controls": "SELECT id * 4 + a AS a, id * 4 + 1 AS b, status, 0 AS q FROM lines, (VALUES (1), (2), (3)) x(a) WHERE flag = 'R' AND ((a > 1 AND status = 'F') OR (a = 1 AND qty > 40))",
    "loop": "SELECT id * 4 + 1 AS a, id * 4 + 1 AS b, status, 0 AS q FROM lines WHERE flag = 'R' AND qty > 40",
    "component": "SELECT id * 4 + a AS a, id * 4 + a AS b, status, 0 AS q FROM lines, (VALUES (0), (1), (2), (3)) x(a) WHERE flag = 'R' AND (a < 3 OR status = 'F')",
    "depth_first": "SELECT id * 4 + a AS a, CAST(a AS BIGINT) AS b, status, 0 AS q FROM lines, (VALUES (0), (1), (2), (3)) x(a) WHERE flag = 'R' AND (a < 3 OR status = 'F')",
}


@register("cfg_facts", "SELECT relation, a, b FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS relation, a, b FROM ({q})" for k, q in ROWS.items()) + ")")
def _cfg(w: Workspace) -> DataFrame:
    mine = col(w["lines"].where("flag = 'R'"), "procedure=id")
    points = w["points"].select(F.col("procedure_id").alias("procedure"), F.col("id").alias("point"), "boundary").join(mine, "procedure", "left_semi")
    edges = w["control_edges"].join(points.select(F.col("point").alias("src"), "procedure"), "src").select("procedure", "src", "dst")
    return graph.control_facts(points, edges).select("relation", "a", "b")


@register("pattern_visibility", "SELECT id FROM lines WHERE flag = 'R' AND qty > 10")
def _visible(w: Workspace) -> DataFrame:
    nodes = w["nodes"].where("kind = 'method'").withColumn("visibility", F.when(F.col("name") == "R", "public").otherwise("private")).join(w["lines"].select((-1 - F.col("id")).alias("id"), F.when(F.col("qty") > 10, F.array(F.lit("int"), F.lit("String"))).alias("parameter_types")), "id")
    return patterns.matching({"kind": "callable", "visibility": ["public", "protected"], "parameter_type": "^Str"}, nodes, w["roles"]).select((-1 - F.col("id")).alias("id"))


# Tabulation: the facts x (from the entry) and y (made from x by a step up that is divisible by three) over the parts' hierarchy.
UPS = "ups AS (SELECT id AS src, up AS dst, p % 5 <> 0 AS proven, p % 3 <> 0 AS complete, p FROM libs WHERE up IS NOT NULL)"
TAB = f"WITH RECURSIVE {UPS}, r AS (SELECT id AS node, 'x' AS fact, TRUE AS proven, TRUE AS complete FROM libs WHERE size = 3 UNION SELECT dst, CASE WHEN p % 7 = 0 THEN 'y' ELSE fact END, r.proven AND ups.proven, r.complete AND ups.complete FROM r JOIN ups ON r.node = src)"


def hierarchy(w: Workspace) -> tuple[DataFrame, DataFrame]:
    ups = w["libs"].where("up is not null")
    fact = F.explode(F.array(F.lit("x"), F.lit("y"))).alias("fact_in")
    flows_ = ups.select(F.col("id").alias("src"), fact, F.col("up").alias("dst"), "p").select("src", "fact_in", "dst", F.when(F.col("p") % 7 == 0, "y").otherwise(F.col("fact_in")).alias("fact_out"), (F.col("p") % 5 != 0).alias("proven"), (F.col("p") % 3 != 0).alias("complete"))
    return w["libs"].where("size = 3").select(F.col("id").alias("node"), F.lit("x").alias("fact")), flows_


register("flow_tabulation", f"{TAB} SELECT node, fact, proven, complete FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.node = r.node AND o.fact = r.fact AND o.proven >= r.proven AND o.complete >= r.complete AND (o.proven > r.proven OR o.complete > r.complete))")(
    lambda w: col(graph.tabulate(*hierarchy(w)), "node", "fact", "proven", "complete"))


@register("flow_witnesses", f"WITH RECURSIVE {UPS}, r AS (SELECT id AS node, 0 AS k FROM libs WHERE size = 3 UNION SELECT dst, k + 1 FROM r JOIN ups ON node = src) SELECT node, CAST(min(k) + 1 AS INTEGER) AS hops, TRUE AS starts_at_seed FROM r GROUP BY 1")
def _witnesses(w: Workspace) -> DataFrame:
    """A shortest way from a seed to every node reached."""
    seeds, flows_ = hierarchy(w)
    plain = flows_.where("fact_in = 'x'").withColumn("fact_out", F.lit("x")).withColumn("proven", F.lit(True)).withColumn("complete", F.lit(True))
    reached = graph.tabulate(seeds, plain)
    paths = graph.witnesses(reached, reached.select("node", "fact").distinct())
    first = paths.select("node", F.size("path").alias("hops"), F.get("path", F.lit(0)).alias("_seed"))
    return first.join(col(seeds, "_s=node"), F.col("_seed") == F.col("_s"), "left").select("node", "hops", F.col("_s").isNotNull().alias("starts_at_seed"))


@register("flow_summaries", f"WITH RECURSIVE {UPS}, r AS (SELECT id AS entry, id AS node, TRUE AS proven, TRUE AS complete FROM libs WHERE size = 5 UNION SELECT entry, dst, r.proven AND ups.proven, r.complete AND ups.complete FROM r JOIN ups ON r.node = src) SELECT CAST(entry AS STRING) AS entry_fact, node AS exit, proven, complete FROM r WHERE node = -1")
def _summaries(w: Workspace) -> DataFrame:
    """Each entry's fact at the root, as one flow for callers."""
    seeds = w["libs"].where("size = 5").select(F.col("id").alias("node"), F.concat(F.col("id").cast("string"), F.lit(">x")).alias("fact"))
    labels = col(seeds, "fact")
    ups = w["libs"].where("up is not null").select(F.col("id").alias("src"), F.col("up").alias("dst"), (F.col("p") % 5 != 0).alias("proven"), (F.col("p") % 3 != 0).alias("complete"))
    chain = graph.closure(col(seeds, "id=node"), ups.select("src", "dst")).select(F.concat(F.col("root").cast("string"), F.lit(">x")).alias("fact"), F.col("id").alias("at")).union(seeds.select("fact", F.col("node").alias("at")))
    flows_ = ups.join(chain, F.col("src") == F.col("at")).select("src", F.col("fact").alias("fact_in"), "dst", F.col("fact").alias("fact_out"), "proven", "complete")
    return graph.summaries(graph.tabulate(seeds.join(labels.distinct(), "fact", "left_semi").select("node", "fact"), flows_), w["libs"].where("p = 0").select(F.col("id").alias("node"))).select("entry_fact", "exit", "proven", "complete")


# Policies.
RULES = [
    policy.Policy("no-returned-calls", "match", {"match": {"kind": "call", "name": "R", "text": "F"}}, "low", 1120),
    policy.Policy("reads-are-fresh", "typestate", {"declarations": {"kind": "method", "name": "A"}, "steps": [{"op": "procedure_of"}, {"op": "typestate", "protocol": "fresh_reads"}]}, "high", 672),
    policy.Policy("no-unclean-values", "taint", {"declarations": {"kind": "method", "name": "R"}, "steps": [{"op": "procedure_of"}, {"op": "taint", "taint": "unclean"}]}, "critical", 79),
    policy.Policy("own-members-first", "assertion", {"occurrences": {"name": "click"}}, "medium", None, lambda rows, facts: assertions.resolution(rows, facts["candidates"], expect_tier="own_member")),
]
FOUND = "SELECT 'no-returned-calls' AS policy, 'low' AS severity, 1120 AS cwe, path, CAST(id AS STRING) AS subject FROM lines WHERE flag = 'R' AND status = 'F' UNION ALL SELECT 'reads-are-fresh', 'high', 672, path, CAST(id AS STRING) || '#fresh_reads' FROM lines WHERE flag = 'A' AND (qty > 40 OR qty < 10) UNION ALL SELECT 'no-unclean-values', 'critical', 79, path, CAST(id * 8 AS STRING) || '#' || CAST(id * 8 + 3 AS STRING) FROM lines WHERE flag = 'R' AND status = 'F' AND NOT qty < 10 UNION ALL SELECT 'own-members-first', 'medium', NULL, path, CAST(id AS STRING) FROM occurrences WHERE name = 'click' AND id NOT IN (SELECT occurrence_id FROM candidates WHERE selected)"
register("policy_run", f"SELECT policy, severity, cwe, path, subject, sha256('finding' || chr(0) || policy || chr(0) || path || chr(0) || subject) AS finding_id FROM ({FOUND})", ("lines",))(lambda w: policy.findings(RULES, w))
register("policy_precedence", "SELECT path, CAST(id AS STRING) AS subject, CASE WHEN qty > 30 THEN 'large' ELSE 'all' END AS policy FROM lines WHERE flag = 'R'")(
    lambda w: policy.settled(w["lines"].where("flag = 'R'").select("path", F.col("id").cast("string").alias("subject"), F.explode(F.when(F.col("qty") > 30, F.array(F.lit("all"), F.lit("large"))).otherwise(F.array(F.lit("all")))).alias("policy")), ["large"]).select("path", "subject", "policy"))
register("policy_explain", "SELECT 0 AS step, count(*) AS n FROM lines WHERE flag = 'A' UNION ALL SELECT 1, count(*) FROM lines WHERE flag = 'A' UNION ALL SELECT 2, count(*) FROM lines WHERE flag = 'A' AND (qty > 40 OR qty < 10)")(lambda w: policy.explained(RULES[1], w))
CATALOG = policy.Endpoints({"eleven": {"declarations": {"name": "Brand#11"}}, "twelve": {"declarations": {"name": "Brand#12"}}, "callers": {"declarations": {"name": "Brand#1"}, "steps": [{"op": "members"}]}})
register("policy_endpoints", "SELECT id FROM libs WHERE brand IN ('Brand#11', 'Brand#12') AND (up IS NULL OR up NOT IN (SELECT id FROM libs WHERE brand = 'Brand#1'))")(lambda w: CATALOG.rows(w, ["eleven", "twelve"], ["callers"]).select("id"))
register("report_symbol_search", "SELECT p_partkey AS id FROM part WHERE p_name LIKE '%ring%' ORDER BY p_partkey LIMIT 20")(
    lambda w: col(reports.symbol_search(w.tables["part"].select(F.col("p_partkey").alias("id"), F.col("p_name").alias("short_name"), F.col("p_name").alias("fq_name"), F.lit("p").alias("path")), "ring"), "id"))
register("report_test_files", f"SELECT path FROM ({PATHS}) WHERE path LIKE '%test%'")(lambda w: reports.test_files(w.spark.sql(PATHS.replace("FROM supplier", "FROM {supplier}"), supplier=w.tables["supplier"])).where("is_test").select("path"))
