"""The registered queries of the analytics engine on the driver's tables, each with its SQL where SQL can say the same.

Every query runs over whole tables. Floats are rounded on both sides; counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import policy_queries, step_queries
from .functions import scalars
from .operators import graph, joins, patterns, reports
from .plans import query as language
from .plans.relational import Assertion, Bound, Compiled, Filter, Fold, Group, Join, Plan, Project, Source, Test
from .schema import kinds_below
from .session import ship
from .sources import facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def planned(spark: SparkSession, d: str, relations: tuple, **enums) -> Compiled:
    tables = {n: Bound(t(spark, d, n), enums=enums.get(n, {})) for n in {r.binding for r in relations if isinstance(r, Source)}}
    return Compiled(Plan(relations), tables)


LONG = lambda c: F.col(c).cast("long").alias(c)

# Relational plans.


@register("rel_filter_project", "SELECT l_orderkey AS order_id, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber >= 3 AND l_linestatus <> 'O'")
def rel_filter_project(s, d):
    return planned(s, d, (Source("l", "lineitem"), Filter("f", "l", (Test("l_returnflag", "eq", "R"), Test("l_linenumber", "ge", 3), Test("l_linestatus", "ne", "O"))), Project("p", "f", {"order_id": "l_orderkey", "line": "l_linenumber"}))).rows("p")


@register("rel_in_isnull", "SELECT o_orderkey, o_orderpriority, l_linenumber AS line FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49 WHERE l_linenumber IS NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def rel_in_isnull(s, d):
    both = t(s, d, "orders").join(t(s, d, "lineitem").where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderpriority", F.col("l_linenumber").alias("line"))
    return Compiled(Plan((Source("x", "x"), Filter("f", "x", (Test("line", "is_null"), Test("o_orderpriority", "in", ("1-URGENT", "2-HIGH")))))), {"x": Bound(both)}).rows("f")


@register("rel_compare_columns", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey < l_partkey AND l_orderkey <> l_partkey")
def rel_compare_columns(s, d):
    return planned(s, d, (Source("l", "lineitem"), Filter("f", "l", (Test("l_suppkey", "lt", other="l_partkey"), Test("l_orderkey", "ne", other="l_partkey"))), Project("p", "f", {c: c for c in ("l_orderkey", "l_linenumber", "l_suppkey")}))).rows("p")


@register("rel_inner_nullsafe", "WITH a AS (SELECT CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END AS k2, c_nationkey, count(*) AS m FROM customer GROUP BY 1, 2) SELECT k, c_nationkey, n, m FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k2")
def rel_inner_nullsafe(s, d):
    """Null keys meet null keys; both sides are counted by key first, so that the null group stays one row for each value."""
    a = t(s, d, "events").where("event_type = 'purchase'").select(F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("k"))
    b = t(s, d, "customer").select(F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey")).alias("k2"), "c_nationkey")
    relations = (Source("a", "a"), Source("b", "b"), Group("ga", "a", ("k",), {"n": Fold("count")}), Group("gb", "b", ("k2", "c_nationkey"), {"m": Fold("count")}), Join("j", "inner", "ga", "gb", (("k", "k2"),)), Project("p", "j", {c: c for c in ("k", "c_nationkey", "n", "m")}))
    return Compiled(Plan(relations), {"a": Bound(a), "b": Bound(b)}).rows("p")


def orders_of(kind: str):
    return lambda s, d: planned(s, d, (Source("c", "customer"), Source("o", "orders"), Filter("f", "o", (Test("o_orderstatus", "eq", "F"),)), Join("j", kind, "c", "f", (("c_custkey", "o_custkey"),)), Project("p", "j", {"c_custkey": "c_custkey", "c_name": "c_name"}))).rows("p")


register("rel_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")(orders_of("semi"))
register("rel_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")(orders_of("anti"))

RETURNED = (Test("l_returnflag", "eq", "R"),)


@register("rel_group_folds", "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(min(l_linenumber) AS BIGINT) AS low, CAST(max(l_linenumber) AS BIGINT) AS high, CAST(max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS some, CAST(min(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS every FROM lineitem GROUP BY 1")
def rel_group_folds(s, d):
    rows = t(s, d, "lineitem").withColumn("large", F.col("l_quantity") > 45)
    folds = {"n": Fold("count"), "suppliers": Fold("count_distinct", "l_suppkey"), "low": Fold("min", "l_linenumber"), "high": Fold("max", "l_linenumber"), "some": Fold("any", "large"), "every": Fold("all", "large")}
    return Compiled(Plan((Source("l", "l"), Group("g", "l", ("l_orderkey",), folds))), {"l": Bound(rows)}).rows("g")


@register("rel_fold_where", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, CAST(coalesce(max(l_linenumber) FILTER (WHERE l_returnflag = 'R'), 0) AS BIGINT) AS high FROM lineitem GROUP BY 1")
def rel_fold_where(s, d):
    return planned(s, d, (Source("l", "lineitem"), Group("g", "l", ("l_orderkey",), {"n": Fold("count", None, RETURNED), "high": Fold("max", "l_linenumber", RETURNED)}))).rows("g")


@register("rel_ordered_equal", "WITH r AS (SELECT l_orderkey, l_linenumber AS p, l_returnflag AS x, CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END AS y FROM lineitem), a AS (SELECT l_orderkey, count(*) = count(DISTINCT p) AS ok, list(p || x ORDER BY p, x) AS l FROM (SELECT DISTINCT l_orderkey, p, x FROM r) GROUP BY 1), b AS (SELECT l_orderkey, count(*) = count(DISTINCT p) AS ok, list(p || y ORDER BY p, y) AS l FROM (SELECT DISTINCT l_orderkey, p, y FROM r) GROUP BY 1) SELECT a.l_orderkey, CAST(a.ok AND b.ok AND a.l = b.l AS BIGINT) AS same FROM a JOIN b USING (l_orderkey)")
def rel_ordered_equal(s, d):
    """Two values at each line of an order; a line number with two different values has no order, and is not equal."""
    rows = t(s, d, "lineitem").withColumn("want", F.when(F.col("l_linestatus") == "O", "N").otherwise("R"))
    g = Group("g", "l", ("l_orderkey",), {"same": Fold("ordered_equal", sides=(("l_linenumber", "l_returnflag"), ("l_linenumber", "want")))})
    return Compiled(Plan((Source("l", "l"), g)), {"l": Bound(rows)}).rows("g")


@register("rel_assert_violations", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, 'violation' AS verdict FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 2")
def rel_assert_violations(s, d):
    group = Group("g", "l", ("l_orderkey",), {"n": Fold("count", None, RETURNED)}, ("l_linenumber", "l_partkey", "l_suppkey"))
    plan = Plan((Source("l", "lineitem"), group), (Assertion("g", "n", "at_most", 2),))
    return Compiled(plan, {"lineitem": Bound(t(s, d, "lineitem"))}).violations(plan.assertions[0]).select("l_orderkey", "n", "verdict")


FIRST = "SELECT o_custkey, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) GROUP BY 1"
UNREAD = "'absence_requires_exhaustive_coverage' AS reason"


def bounded(s, d, kind: str, n: int) -> DataFrame:
    """The customers of the first thousand orders, a source that is read in part."""
    plan = Plan((Source("o", "orders", 1000, ("o_orderkey",)), Group("g", "o", ("o_custkey",), {"n": Fold("count")})), (Assertion("g", "n", kind, n),))
    return Compiled(plan, {"orders": Bound(t(s, d, "orders"))}).violations(plan.assertions[0]).select("o_custkey", "n", "verdict", "reason")


register("rel_coverage_obligations", f"SELECT o_custkey, n, 'obligation' AS verdict, {UNREAD} FROM ({FIRST}) WHERE n < 2")(lambda s, d: bounded(s, d, "at_least", 2))
register("rel_coverage_upper_bound", f"SELECT o_custkey, n, CASE WHEN n > 1 THEN 'violation' ELSE 'obligation' END AS verdict, CASE WHEN n <= 1 THEN 'absence_requires_exhaustive_coverage' END AS reason FROM ({FIRST})")(lambda s, d: bounded(s, d, "at_most", 1))
register("rel_coverage_exactly", f"SELECT o_custkey, n, CASE WHEN n > 2 THEN 'violation' ELSE 'obligation' END AS verdict, CASE WHEN n <= 2 THEN 'absence_requires_exhaustive_coverage' END AS reason FROM ({FIRST})")(lambda s, d: bounded(s, d, "exactly", 2))


@register("rel_coverage_no_group", f"SELECT CAST(NULL AS BIGINT) AS o_custkey, 'obligation' AS verdict, {UNREAD}")
def rel_coverage_no_group(s, d):
    """No row of the part that was read holds the test: that there is none is a claim about rows nobody read."""
    plan = Plan((Source("o", "orders", 1000, ("o_orderkey",)), Filter("f", "o", (Test("o_orderstatus", "eq", "X"),)), Group("g", "f", ("o_custkey",), {"n": Fold("count")})), (Assertion("g", "n", "exactly", 0),))
    return Compiled(plan, {"orders": Bound(t(s, d, "orders"))}).violations(plan.assertions[0]).select("o_custkey", "verdict", "reason")


@register("rel_coverage_anti_over_partial", "SELECT c_custkey, n, 'obligation' AS verdict, 'verdict_requires_witnessed_rows' AS reason FROM (SELECT c_custkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)) GROUP BY 1)")
def rel_coverage_anti_over_partial(s, d):
    """Customers without an order among those read: each stands on an absence, so no verdict can be given."""
    relations = (Source("c", "customer"), Source("o", "orders", 100, ("o_orderkey",)), Join("j", "anti", "c", "o", (("c_custkey", "o_custkey"),)), Group("g", "j", ("c_custkey",), {"n": Fold("count")}))
    plan = Plan(relations, (Assertion("g", "n", "exactly", 0),))
    return Compiled(plan, {n: Bound(t(s, d, n)) for n in ("customer", "orders")}).violations(plan.assertions[0]).select("c_custkey", "n", "verdict", "reason")


@register("rel_representatives", "WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6), w AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS r FROM w) SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_partkey) AS shown FROM g JOIN k USING (l_orderkey) WHERE r <= 8 GROUP BY 1")
def rel_representatives(s, d):
    """The rows shown with a violation: eight at most, the first in order."""
    plan = Plan((Source("l", "lineitem"), Group("g", "l", ("l_orderkey",), {"n": Fold("count")}, ("l_partkey",))), (Assertion("g", "n", "at_most", 6),))
    found = Compiled(plan, {"lineitem": Bound(t(s, d, "lineitem"))}).violations(plan.assertions[0])
    return found.select("l_orderkey", F.array_join(F.transform("representatives", lambda x: x["l_partkey"].cast("string")), ",").alias("shown"))


FLAGSHIP = "SELECT o_orderkey, CAST(coalesce(max(l_linenumber) FILTER (WHERE l_suppkey < l_partkey), 0) AS BIGINT) AS fold FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1 HAVING coalesce(max(l_linenumber) FILTER (WHERE l_suppkey < l_partkey), 0) <> 0"


@register("rel_rule", FLAGSHIP)
def rel_rule(s, d):
    """Sites semi-joined to an outcome, joined to a selection, grouped, a fold with a column test, exactly 0."""
    poor = t(s, d, "customer").where("c_acctbal < 0")
    relations = (
        Source("sites", "orders"), Source("outcome", "poor"), Source("selection", "lineitem"),
        Join("bad", "semi", "sites", "outcome", (("o_custkey", "c_custkey"),)),
        Join("both", "inner", "bad", "selection", (("o_orderkey", "l_orderkey"),)),
        Group("g", "both", ("o_orderkey",), {"fold": Fold("max", "l_linenumber", (Test("l_suppkey", "lt", other="l_partkey"),))}),
    )
    plan = Plan(relations, (Assertion("g", "fold", "exactly", 0),))
    return Compiled(plan, {"orders": Bound(t(s, d, "orders")), "poor": Bound(poor), "lineitem": Bound(t(s, d, "lineitem"))}).violations(plan.assertions[0]).select("o_orderkey", "fold")


# Sets and limits.


def branches(s, d) -> list[DataFrame]:
    c = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array("c_custkey").alias("ord"), "c_mktsegment", "c_nationkey", "c_acctbal")
    return [b.select("id", "ord") for b in (c.where("c_mktsegment = 'BUILDING'"), c.where("c_nationkey < 10"), c.where("c_acctbal > 0"))]


A, B, C = ("SELECT c_custkey AS id FROM customer WHERE " + w for w in ("c_mktsegment = 'BUILDING'", "c_nationkey < 10", "c_acctbal > 0"))
register("set_union", f"{A} UNION {B} UNION {C}")(lambda s, d: language.union(branches(s, d)).select("id"))
register("set_intersect", f"{A} INTERSECT {B} INTERSECT {C}")(lambda s, d: language.intersect(branches(s, d)).select("id"))
register("set_except", f"{A} EXCEPT ({B} UNION {C})")(lambda s, d: language.difference(branches(s, d)).select("id"))


TYPES = {"STANDARD": "plain", "SMALL": "plain", "PROMO": "sold", "ECONOMY": "sold", "plain": "all", "sold": "all"}
register("kind_hierarchy", "SELECT p_partkey, p_type FROM part WHERE split_part(p_type, ' ', 1) IN ('sold', 'PROMO', 'ECONOMY')")(lambda s, d: t(s, d, "part").where(F.split("p_type", " ")[0].isin(*kinds_below("sold", TYPES))).select("p_partkey", "p_type"))
register("name_alternation", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')")(lambda s, d: t(s, d, "part").where(scalars.matches(F.col("p_brand"), "^(Brand#11|Brand#22|Brand#33)$")).select("p_partkey", "p_brand"))
register("source_anchor", "SELECT doc_id AS id FROM documents WHERE regexp_matches(text, 'Licensed under .*Version 2')")(lambda s, d: patterns.matching({"kind": "text", "text": "Licensed under .*Version 2"}, t(s, d, "documents").select(F.lit("d").alias("path"), F.col("doc_id").alias("id"), F.col("doc_id").alias("node_id"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("name"), "text"), no_roles(s)).select("id"))

# Patterns over lists, trees and intervals.






def tree(s, d) -> DataFrame:
    """region over nation as pre-order intervals: path, node_id, subtree_end, kind, name."""
    stride = 1000
    r = t(s, d, "region").select(F.lit("w").alias("path"), (F.col("r_regionkey") * stride).cast("int").alias("node_id"), ((F.col("r_regionkey") + 1) * stride).cast("int").alias("subtree_end"), F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    at = F.col("n_regionkey") * stride + F.col("n_nationkey") + 1
    n = t(s, d, "nation").select(F.lit("w").alias("path"), at.cast("int").alias("node_id"), (at + 1).cast("int").alias("subtree_end"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    return r.union(n).withColumn("text", F.col("name"))


def no_roles(s) -> DataFrame:
    return s.createDataFrame([], facts.ROLES)


@register("inside_nearest", "SELECT n_name AS name, r_name AS ancestor FROM nation JOIN region ON n_regionkey = r_regionkey")
def inside_nearest(s, d):
    nodes = tree(s, d)
    near = patterns.nearest_ancestor(nodes, {"kind": "region"}, nodes.where("kind = 'nation'"), no_roles(s))
    return near.join(nodes.select(F.col("node_id").alias("ancestor"), F.col("name").alias("up")), "ancestor").select("name", F.col("up").alias("ancestor"))


@register("enclosing_decl", "WITH spans AS (SELECT user_id, event_id AS span_id, ts AS a, ts + INTERVAL 36 HOUR AS z FROM events WHERE event_type = 'signup') SELECT event_id, span_id FROM (SELECT e.event_id, s.span_id, row_number() OVER (PARTITION BY e.event_id ORDER BY s.a DESC, s.span_id DESC) AS k FROM events e JOIN spans s ON e.user_id = s.user_id AND s.a <= e.ts AND e.ts <= s.z WHERE e.event_type = 'click') WHERE k = 1")
def enclosing_decl(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t(s, d, "events").select("user_id", "event_id", "event_type", us.alias("at"), us.alias("to"))
    spans = e.where("event_type = 'signup'").select(F.col("user_id").alias("u"), F.col("event_id").alias("span_id"), F.col("at").alias("a"), (F.col("at") + 36 * 3_600_000_000).alias("z"))
    clicks = e.where("event_type = 'click'")
    return joins.narrowest(clicks, spans, [("user_id", "u")], "event_id", "at", "to", "a", "z").select("event_id", "span_id")


# References and calls: part is a declaration, lineitem a site, orders its owner.



def calls(s, d) -> DataFrame:
    """supplier s calls part p, part p calls part p / 2."""
    l = t(s, d, "lineitem").where("l_suppkey is not null").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return l.union(t(s, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst")))


CALLS = "calls AS (SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IS NOT NULL UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 1)"


@register("callers_depth", f"WITH RECURSIVE {CALLS}, r AS (SELECT dst AS root, src AS id, 1 AS depth FROM calls WHERE dst IN (5, 7) UNION SELECT r.root, c.src, r.depth + 1 FROM r JOIN calls c ON c.dst = r.id WHERE r.depth < 3) SELECT root, id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2")
def callers_depth(s, d):
    e = calls(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(s.createDataFrame([(5,), (7,)], "id long"), e, 3, True).select("root", "id", "depth")




@register("supertypes_transitive", "WITH RECURSIVE r AS (SELECT p_partkey AS root, p_partkey // 2 AS id, 1 AS depth FROM part WHERE p_size = 2 AND p_partkey > 1 UNION ALL SELECT root, id // 2, depth + 1 FROM r WHERE id > 1) SELECT root, id, CAST(depth AS INTEGER) AS depth FROM r")
def supertypes_transitive(s, d):
    p = t(s, d, "part")
    up = p.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))
    return graph.closure(p.where("p_size = 2").select(F.col("p_partkey").alias("id")), up).select("root", "id", "depth")


@register("rewrite_paths", "WITH RECURSIVE rules AS (SELECT p_partkey AS src, (p_partkey * p_partkey + 1) % 199 AS dst FROM part), r AS (SELECT p_partkey AS id, p_partkey AS at, [p_partkey] AS path, CAST(NULL AS VARCHAR) AS outcome FROM part WHERE p_size = 3 UNION ALL SELECT r.id, CASE WHEN u.dst IS NULL OR u.dst = r.at OR list_contains(r.path, u.dst) THEN r.at ELSE u.dst END, CASE WHEN u.dst IS NULL OR u.dst = r.at OR list_contains(r.path, u.dst) THEN r.path ELSE list_append(r.path, u.dst) END, CASE WHEN u.dst IS NULL OR u.dst = r.at THEN 'converged' WHEN list_contains(r.path, u.dst) THEN 'cycle' WHEN len(r.path) > 8 THEN 'exceeded_budget' END FROM r LEFT JOIN rules u ON u.src = r.at WHERE r.outcome IS NULL) SELECT id, CAST(CASE WHEN outcome = 'exceeded_budget' THEN len(path) - 2 ELSE len(path) - 1 END AS INTEGER) AS steps, outcome FROM r WHERE outcome IS NOT NULL")
def rewrite_paths(s, d):
    p = t(s, d, "part")
    rules = p.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % 199).alias("dst"))
    return graph.rewrite_chase(p.where("p_size = 3").select(F.col("p_partkey").alias("id")), rules, 8).select("id", "steps", "outcome")


@register("binding_of", "SELECT event_id, binding FROM (SELECT p.event_id, s.event_id AS binding, row_number() OVER (PARTITION BY p.event_id ORDER BY s.ts DESC, s.event_id DESC) AS k FROM events p JOIN events s ON s.user_id = p.user_id AND s.ts <= p.ts WHERE p.event_type = 'purchase' AND s.event_type = 'signup') WHERE k = 1")
def binding_of(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    signups = e.where("event_type = 'signup'").withColumn("binding", F.col("event_id"))
    return joins.as_of(e.where("event_type = 'purchase'"), signups, [("user_id", "user_id")], "ts", "ts", "event_id", ["binding"]).where("binding is not null").select("event_id", "binding")


@register("candidates_ranked", "SELECT l_partkey, l_suppkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY tier, l_suppkey) AS k FROM (SELECT l_partkey, l_suppkey, CAST(min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) AS INTEGER) AS tier FROM lineitem GROUP BY 1, 2)) WHERE k = 1")
def candidates_ranked(s, d):
    tier = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    best = t(s, d, "lineitem").groupBy("l_partkey").agg(F.min(F.struct(tier.alias("tier"), "l_suppkey")).alias("b"))
    return best.select("l_partkey", "b.l_suppkey", "b.tier")








@register("edge_parity", "WITH f AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag <> 'N'), i AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_linestatus = 'F') SELECT a, b, 'forward_only' AS side FROM (SELECT * FROM f EXCEPT SELECT * FROM i) UNION ALL SELECT a, b, 'inverse_only' FROM (SELECT * FROM i EXCEPT SELECT * FROM f)")
def edge_parity(s, d):
    e = t(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "l_returnflag", "l_linestatus")
    f, i = e.where("l_returnflag <> 'N'").select("a", "b").distinct(), e.where("l_linestatus = 'F'").select("a", "b").distinct()
    keys = [("a", "a"), ("b", "b")]
    return joins.anti(f, i, keys).withColumn("side", F.lit("forward_only")).union(joins.anti(i, f, keys).withColumn("side", F.lit("inverse_only")))


@register("imports_topology", "SELECT DISTINCT url AS source, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages")
def imports_topology(s, d):
    return t(s, d, "pages").select(F.col("url").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target")).distinct()


# Reports.


@register("git_hotspots", "WITH c AS (SELECT l_partkey AS file, l_orderkey AS commit, o_custkey AS author, o_orderdate AS changed FROM lineitem JOIN orders ON l_orderkey = o_orderkey), churn AS (SELECT file, count(DISTINCT commit) AS churn, max(changed) AS last_modified FROM c GROUP BY 1), top AS (SELECT file, author, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS k FROM (SELECT file, author, count(DISTINCT commit) AS n FROM c GROUP BY 1, 2)) SELECT churn.file, churn, last_modified, p_size AS complexity, CASE WHEN churn > 25 AND p_size > 15 THEN 'HOTSPOT' WHEN p_size > 15 THEN 'ABANDONWARE' WHEN churn > 25 THEN 'ACTIVE' ELSE 'STABLE' END AS category, top_authors FROM churn JOIN part ON file = p_partkey JOIN (SELECT file, string_agg(CAST(author AS VARCHAR), ',' ORDER BY k) AS top_authors FROM top WHERE k <= 5 GROUP BY 1) a ON a.file = churn.file")
def git_hotspots(s, d):
    c = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"))
    return reports.hotspots(c, t(s, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("complexity")), churn_over=25)


@register("dir_affinity", "WITH own AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), ok AS (SELECT basket FROM own GROUP BY 1 HAVING count(*) <= 40), b AS (SELECT own.* FROM own JOIN ok USING (basket)), f AS (SELECT item, count(*) AS freq FROM b GROUP BY 1), n AS (SELECT count(DISTINCT basket) AS total FROM b), j AS (SELECT x.item AS seed, y.item AS other, count(*) AS joint FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item GROUP BY 1, 2) SELECT seed, other, round(joint / f1.freq * sqrt(1 + total / f2.freq), 4) AS score FROM j JOIN f f1 ON f1.item = seed JOIN f f2 ON f2.item = other CROSS JOIN n")
def dir_affinity(s, d):
    b = t(s, d, "lineitem").join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item"))
    return reports.affinity(b).select("seed", "other", F.round("score", 4).alias("score"))


@register("cascade_rank", "SELECT p_partkey, CAST(CASE WHEN p_brand = 'Brand#11' AND p_size = 1 THEN 0 WHEN p_brand = 'Brand#11' THEN 1 WHEN p_size = 1 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM part ORDER BY 2, p_retailprice DESC, p_partkey LIMIT 20")
def cascade_rank(s, d):
    brand, size = F.col("p_brand") == "Brand#11", F.col("p_size") == 1
    return reports.cascade(t(s, d, "part"), [brand & size, brand, size], [F.col("p_retailprice").desc(), F.col("p_partkey")], 20).select("p_partkey", "tier")


@register("cyclomatic", r"SELECT doc_id, CAST(1 + len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda w: w IN ('if', 'while', 'for', 'switch', 'case', 'catch'))) + len(regexp_extract_all(text, '&&|\|\||\?')) AS BIGINT) AS complexity FROM documents")
def cyclomatic(s, d):
    return t(s, d, "documents").select("doc_id", scalars.cyclomatic(F.col("text")).alias("complexity"))


@register("grep_context", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE contains(text, 'Licensed under')), h AS (SELECT doc_id, line FROM l WHERE contains(text, 'Licensed under')) SELECT DISTINCT l.doc_id, CAST(l.line AS INTEGER) AS line, l.text, contains(l.text, 'Licensed under') AS hit FROM l JOIN h ON l.doc_id = h.doc_id AND abs(l.line - h.line) <= 1")
def grep_context(s, d):
    return reports.line_context(t(s, d, "documents").withColumnRenamed("doc_id", "id"), "Licensed under", 1).select(F.col("id").alias("doc_id"), "line", "text", "hit")


@register("comment_density", "SELECT doc_id, CAST(len(l) AS BIGINT) AS lines, CAST(len(list_filter(l, lambda x: regexp_matches(x, '(###|///|Copyright|Licensed)'))) AS BIGINT) AS comments, CAST(len(list_filter(l, lambda x: trim(x) = '')) AS BIGINT) AS blank, CAST(round(100.0 * len(list_filter(l, lambda x: regexp_matches(x, '(###|///|Copyright|Licensed)'))) / len(l)) AS BIGINT) AS density FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def comment_density(s, d):
    return reports.line_classes(t(s, d, "documents").withColumnRenamed("doc_id", "id"), "(###|///|Copyright|Licensed)").withColumnRenamed("id", "doc_id")


@register("size_rollup", "SELECT r_regionkey AS id, count(c_custkey) AS total, count(DISTINCT n_nationkey) AS below FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def size_rollup(s, d):
    n = t(s, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("up"))
    per = t(s, d, "customer").groupBy((F.col("c_nationkey") + 1000).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    r = t(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(0).cast("long").alias("size"))
    nodes = r.union(n.join(per, "id", "left").select("id", F.coalesce("size", F.lit(0)).cast("long")))
    return reports.roll_up(nodes, n.select(F.col("up").alias("src"), F.col("id").alias("dst")), "size").where("id < 1000").select(F.col("id").cast("int").alias("id"), "total", "below")


@register("dead_code", "SELECT p_partkey AS id, CAST(coalesce(n, 0) AS BIGINT) AS usages, CAST(CASE WHEN n IS NULL THEN 30 + least(p_size // 4, 20) ELSE 12 + least(p_size // 8, 12) END AS BIGINT) AS score FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON l_partkey = p_partkey WHERE coalesce(n, 0) <= 1")
def dead_code(s, d):
    return reports.dead_code(t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("lines")), t(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id")))


@register("diff_snapshots", "WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(1) AS n FROM orders GROUP BY 1, 2), lo AS (SELECT o_custkey, n FROM y WHERE y = (SELECT min(y) FROM y)), hi AS (SELECT o_custkey, n FROM y WHERE y = (SELECT max(y) FROM y)) SELECT coalesce(lo.o_custkey, hi.o_custkey) AS o_custkey, CASE WHEN lo.n IS NULL THEN 'introduced' WHEN hi.n IS NULL THEN 'deleted' WHEN lo.n = hi.n THEN 'unchanged' ELSE 'edited' END AS state FROM lo FULL JOIN hi ON lo.o_custkey = hi.o_custkey")
def diff_snapshots(s, d):
    y = t(s, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    low, high = y.agg(F.min("y"), F.max("y")).head()
    return reports.snapshot_diff(y.where(F.col("y") == low), y.where(F.col("y") == high), "o_custkey", "n")


@register("clone_pairs", "WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS ws FROM documents), f AS (SELECT doc_id, list_filter(ws, lambda x: x <> '') AS ws FROM w), s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM f)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a, b, shared, CAST(round(100.0 * shared / (n1.n + n2.n - shared)) AS BIGINT) AS score FROM p JOIN n n1 ON n1.doc_id = a JOIN n n2 ON n2.doc_id = b WHERE round(100.0 * shared / (n1.n + n2.n - shared)) >= 60")
def clone_pairs(s, d):
    return reports.clones(t(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), 5, 3, 60)


@register("benchmark_containment", "WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM benchmark), s AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 7], ' ') AS sh FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM b)), d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents), e AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 7], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)) SELECT doc_id, item_id, count(*) AS shared FROM e JOIN s ON e.sh = s.sh GROUP BY 1, 2")
def benchmark_containment(s, d):
    shingled = lambda rows, key: rows.select(key, F.explode(scalars.shingle_hashes(F.col("text"), 8)).alias("sh"))
    return shingled(t(s, d, "documents"), "doc_id").join(shingled(t(s, d, "benchmark"), "item_id"), "sh").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


def bags(s, d) -> tuple[DataFrame, DataFrame]:
    c = t(s, d, "conversations").where("role in ('user', 'assistant')").select("conv_id", "role", F.explode(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) > 3)).alias("token"))
    n = c.groupBy("conv_id", "role", "token").agg(F.count(F.lit(1)).alias("n"))
    side = lambda r: n.where(F.col("role") == r).select(F.concat(F.lit(r), F.col("conv_id")).alias("id"), "token", "n")
    return side("user"), side("assistant")


@register("idf_body_similarity", "WITH c AS (SELECT role || conv_id AS id, role, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM conversations WHERE role IN ('user', 'assistant')), b AS (SELECT id, role, token, count(*) AS n FROM c WHERE length(token) > 3 GROUP BY 1, 2, 3), w AS (SELECT token, ln(((SELECT count(DISTINCT id) FROM b) + 1) / (count(DISTINCT id) + 0.5)) AS w FROM b GROUP BY 1), s AS (SELECT id, sum(w * n) AS t FROM b JOIN w USING (token) GROUP BY 1), p AS (SELECT x.id AS l, y.id AS r, sum(w * least(x.n, y.n)) AS low FROM b x JOIN b y ON x.token = y.token AND x.role = 'user' AND y.role = 'assistant' JOIN w ON w.token = x.token GROUP BY 1, 2) SELECT l, r, round(low / (a.t + z.t - low), 4) AS score FROM p JOIN s a ON a.id = l JOIN s z ON z.id = r WHERE low / (a.t + z.t - low) >= 0.02")
def idf_body_similarity(s, d):
    return reports.bag_similarity(*bags(s, d), least=0.02).where("score >= 0.02").select("l", "r", F.round("score", 4).alias("score"))


register("idf_body_pairing")(lambda s, d: reports.greedy_pairs(reports.bag_similarity(*bags(s, d), least=0.02), 0.02))

SECRET = r"(token|secret|password|api_key)\s*=\s*.[A-Za-z0-9]{16}"
register("secret_rules", f"SELECT doc_id, 'assignment' AS rule FROM documents WHERE regexp_matches(text, '{SECRET}') UNION ALL SELECT doc_id, 'long_hex' FROM documents WHERE regexp_matches(text, '[0-9a-f]{{32}}')")(
    lambda s, d: t(s, d, "documents").select("doc_id", F.explode(F.filter(F.array(F.when(F.col("text").rlike(SECRET), "assignment"), F.when(F.col("text").rlike("[0-9a-f]{32}"), "long_hex")), lambda r: r.isNotNull())).alias("rule"))
)


@register("dense_topk", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])) AS score FROM embeddings CROSS JOIN q), k AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 10) SELECT id, round(score, 6) AS score, round(greatest(0.01, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ())), 6) AS normalized FROM k")
def dense_topk(s, d):
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    query = e.where("id = 0").head()["vector"]
    return reports.dense_top_k(e, [float(x) for x in query], 10).select("id", F.round("score", 6).alias("score"), F.round("normalized", 6).alias("normalized"))


PROTOCOL = {("new", "signup"): "known", ("known", "view"): "seen", ("seen", "click"): "picked", ("picked", "purchase"): "done", ("new", "purchase"): "error", ("error", "signup"): "known"}


def flow_cases(alias: str) -> str:
    return " ".join(f"WHEN {alias} = '{a}' AND e.event_type = '{b}' THEN '{c}'" for (a, b), c in PROTOCOL.items())


@register("typestate_batch", f"WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, 0 AS k, 'new' AS state, 0 AS v FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.user_id, e.k, CASE {flow_cases('r.state')} ELSE r.state END, r.v + CASE WHEN (CASE {flow_cases('r.state')} ELSE r.state END) = 'error' THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, state, CAST(v AS BIGINT) AS violations, state NOT IN ('done', 'known') AS ended_badly FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS last FROM r) WHERE last = 1")
def typestate_batch(s, d):
    return reports.protocol_run(t(s, d, "events"), "user_id", ["ts", "event_id"], "event_type", PROTOCOL, "new", ["done", "known"], ["error"])


@register("reaching_defs", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS definition FROM events QUALIFY event_type = 'view'")
def reaching_defs(s, d):
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t(s, d, "events").withColumn("definition", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(before)).where("event_type = 'view'").select("event_id", "definition")


@register("taint_reach", "SELECT DISTINCT c_custkey AS label, l_suppkey AS sink FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal < -900 AND l_returnflag <> 'R' AND l_suppkey <= 50")
def taint_reach(s, d):
    """customer to order to part line to supplier; a returned line is a sanitizer."""
    o = t(s, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    clean = t(s, d, "lineitem").where("l_returnflag <> 'R'").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    seeds = t(s, d, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("label"), F.concat(F.lit("c"), "c_custkey").alias("id"))
    reached = graph.reachable(seeds, o.union(clean))
    sink = F.substring("id", 2, 20).cast("long")
    return reached.where(F.col("id").startswith("s")).select("label", sink.alias("sink")).where("sink <= 50")


@register("baseline_review", "WITH f AS (SELECT doc_id FROM documents WHERE contains(text, 'Licensed')), b AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT coalesce(f.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN f.doc_id IS NULL THEN 'absent' ELSE 'existing' END AS state FROM f FULL JOIN b ON f.doc_id = b.doc_id")
def baseline_review(s, d):
    return reports.review(t(s, d, "documents").where(F.col("text").contains("Licensed")), t(s, d, "labels").where("quality = 0"), ["doc_id"])


@register("usage_graph", "SELECT o_custkey AS caller, l_suppkey AS callee, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def usage_graph(s, d):
    return t(s, d, "orders").join(t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("caller"), F.col("l_suppkey").alias("callee")).agg(F.count(F.lit(1)).alias("n"))


@register("coedit_score", "SELECT l_orderkey, l_linenumber, round(1.0 / (30 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1), 6) AS score FROM lineitem")
def coedit_score(s, d):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(1 / (29 + rank), 6).alias("score"))


@register("time_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def time_window(s, d):
    return reports.time_window(t(s, d, "events"), "ts", "2024-01-08", "2024-01-15").select("event_id")


@register("per_symbol_max", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 1) SELECT label, round(max(list_dot_product(embedding::DOUBLE[], q::DOUBLE[])), 6) AS score FROM embeddings CROSS JOIN q GROUP BY 1")
def per_symbol_max(s, d):
    e = t(s, d, "embeddings")
    query = F.array(*(F.lit(float(x)) for x in e.where("vec_id = 1").head()["embedding"]))
    return e.groupBy("label").agg(F.round(F.max(scalars.dot(F.col("embedding"), query)), 6).alias("score"))


@register("finding_precedence", "SELECT l_orderkey, flag FROM (SELECT l_orderkey, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS k FROM lineitem) WHERE k = 1")
def finding_precedence(s, d):
    order = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", order).alias("flag"))


@register("explain_why_not", "SELECT count(*) AS rows_in, count(*) FILTER (WHERE p_size > 10) AS size, count(*) FILTER (WHERE p_size > 10 AND p_brand = 'Brand#11') AS brand, count(*) FILTER (WHERE p_size > 10 AND p_brand = 'Brand#11' AND p_retailprice < 1000) AS price FROM part")
def explain_why_not(s, d):
    """How many rows are left after each test in turn, in one pass."""
    tests = {"size": F.col("p_size") > 10, "brand": F.col("p_brand") == "Brand#11", "price": F.col("p_retailprice") < 1000}
    so_far, counts = F.lit(True), []
    for name, test in tests.items():
        so_far = so_far & test
        counts.append(F.count_if(so_far).alias(name))
    return t(s, d, "part").agg(F.count(F.lit(1)).alias("rows_in"), *counts)


@register("round_trip", "WITH e AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1), back AS (SELECT DISTINCT l_suppkey AS b, o_custkey AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 2) SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM back WHERE back.a = e.a AND back.b = e.b)")
def round_trip(s, d):
    both = t(s, d, "orders").join(t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"), "l_linenumber")
    return joins.anti(both.where("l_linenumber = 1").select("a", "b").distinct(), both.where("l_linenumber = 2").select("a", "b").distinct(), [("a", "a"), ("b", "b")])


@register("flow_fallbacks", "SELECT l_orderkey, l_partkey, count(*) >= 2 AS kills FROM lineitem GROUP BY 1, 2")
def flow_fallbacks(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg((F.count(F.lit(1)) >= 2).alias("kills"))


@register("shortest_paths", "WITH RECURSIVE r AS (SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS path, p_partkey AS cur FROM part WHERE p_size = 5 UNION ALL SELECT id, path || '>' || CAST(cur // 2 AS VARCHAR), cur // 2 FROM r WHERE cur > 1) SELECT id, max(path) FILTER (WHERE cur = 1) AS path FROM r GROUP BY 1")
def shortest_paths(s, d):
    p = t(s, d, "part")
    up = p.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))
    found = graph.shortest_paths(p.where("p_size = 5").select(F.col("p_partkey").alias("id")), up, 64)
    return found.where("id = 1").select(F.col("root").alias("id"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@register("page_rank")
def page_rank(s, d):
    """Ranks of the whole call graph, every supplier's calls included."""
    return graph.page_rank(s, graph.cut_lineage(calls(s, d)), 10)


@register("html_nodes")
def html_nodes(s, d):
    return facts.html_nodes(t(s, d, "pages"))


@register("html_links_inside", "SELECT url || '#' || page_id AS path, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*)</nav>', 1), '<a href=\"([^\"]*)\"', 1)) AS text FROM pages")
def html_links_inside(s, d):
    """The query language over parsed pages: links inside the navigation."""
    nodes = facts.html_nodes(t(s, d, "pages"))
    return language.every({"match": {"kind": "a", "inside": {"kind": "nav"}}}, {"nodes": nodes, "roles": no_roles(s)}).select("path", "text")


HEX = "[0-9a-f]{16}"


@register("sarif_report", f"SELECT CAST(doc_id AS VARCHAR) AS path, 1 AS start_line, CAST(to_json({{'ruleId': 'long_hex', 'message': {{'text': 'a long hexadecimal string'}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': CAST(doc_id AS VARCHAR)}}, 'region': {{'startLine': 1, 'endLine': CAST(len(string_split(text, chr(10))) AS INTEGER)}}}}}}]}}) AS VARCHAR) AS value FROM documents WHERE regexp_matches(text, '{HEX}')")
def sarif_report(s, d):
    """A result in each row; `write_sarif` puts them into one document."""
    found = t(s, d, "documents").where(F.col("text").rlike(HEX)).select(F.lit("long_hex").alias("rule"), F.lit("a long hexadecimal string").alias("message"), F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))
    return facts.sarif_results(found)


@register("stream_typestate", f"SELECT user_id, state, violations FROM ({SQL['typestate_batch']})")
def stream_typestate(s, d):
    """The protocol over the events as a file stream, run to its end; the last state of each user."""
    from .streaming.typestate import protocol_stream

    at, run = graph.shared_folder(s), s.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    src = t(s, d, "events")
    stream = s.readStream.schema(src.schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = protocol_stream(stream, "user_id", "ts", "event_id", "event_type", PROTOCOL, "new", {"error"})
    sink = f"{at}/stream-{run}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state-{run}").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(sink).groupBy("user_id").agg(F.max_by(F.struct("state", "violations"), "batch").alias("l")).select("user_id", "l.state", "l.violations")


@register("windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(s, d):
    """The windows that a stream keeps, over the events at rest."""
    from .streaming.typestate import windowed_counts as counts

    return counts(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 day").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@register("refresh_facts", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE o_orderstatus END AS state FROM orders")
def refresh_facts(s, d):
    """A table of facts of which some files change: their rows are replaced, the others stay."""
    from .streaming.typestate import current, refresh

    at = f"{graph.shared_folder(s)}/facts-{s.sparkContext._jvm.java.util.UUID.randomUUID()}"
    rows = t(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), "o_orderkey", F.col("o_orderstatus").alias("state"))
    refresh(s, rows, at)
    refresh(s, rows.where("state = 'P'").withColumn("state", F.lit("changed")), at)
    return current(s, at).select("o_orderkey", "state")


def queries() -> dict[str, Query]:
    return QUERIES | step_queries.QUERIES | policy_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | step_queries.SQL | policy_queries.SQL
