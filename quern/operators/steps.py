"""The typed row-to-row steps of the query language, declared over fact tables by the shape of their join.

A step takes rows of some kinds (each with `id`, and with `ord`, an array of longs) and gives rows of one kind, deduplicated by id in first-seen order.
`facts` maps table names to DataFrames; a fact table of a kind has `id` and, where the shape asks, the key
named here. What a table says of a row's other columns is carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import REGISTRY
from ..schema import PlanError, checked
from . import graph, joins, reports

Facts = Mapping[str, DataFrame]
Apply = Callable[[DataFrame, Facts, dict], DataFrame]


@dataclass(frozen=True)
class Step:
    name: str
    takes: frozenset[str]
    gives: str
    apply: Apply
    #: option: the vocabulary its values are of, or None for a free value.
    options: Mapping[str, str | None] = field(default_factory=dict)


STEPS: dict[str, Step] = {}
FLOW = {"relation": "flow_relation", "certainty": "certainty"}


def declare(name: str, takes: str, gives: str, apply: Apply, /, **options: str | None) -> None:
    STEPS[name] = Step(name, frozenset(takes.split()), gives, apply, options)


def filtered(rows: DataFrame, options: dict, columns: Mapping[str, str | None]) -> DataFrame:
    """All options hold, each with any of its values; an empty one holds always; `unattributed` is a null."""
    for name in columns:
        if values := options.get(name):
            values = [values] if isinstance(values, str | int | bool) else list(values)
            if name in rows.columns:
                named = [v for v in values if v != "unattributed"]
                test = F.col(name).isin(*named) if named else F.lit(False)
                rows = rows.where(test | F.col(name).isNull() if "unattributed" in values else test)
    return rows


def only(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The table's columns and ord."""
    return rows.select(*(F.col(f"t.`{c}`").alias(c) for c in table.columns), F.col("r.ord").alias("ord"))


def equi(table: str, left: str, right: str, /, **options: str | None) -> Apply:
    def apply(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
        t = filtered(facts[table], given, options)
        return only(rows.alias("r").join(t.alias("t"), F.col(f"r.`{left}`") == F.col(f"t.`{right}`")), t)

    return apply


def listed(table: str, column: str, right: str = "id") -> Apply:
    """Rows whose key is in an array column."""

    def apply(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
        t = facts[table]
        keys = rows.select("ord", F.explode(column).alias("_key"))
        return only(keys.alias("r").join(t.alias("t"), F.col("r._key") == F.col(f"t.`{right}`")), t)

    return apply


def unfold(column: str, /, **fields: str) -> Apply:
    """An array column's elements, with their position and the parent's id; fields rename."""

    def apply(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
        inner = rows.select("ord", "path", F.col("id").alias("parent_id"), F.posexplode(column).alias("ordinal", "_e"))
        element = inner.schema["_e"].dataType
        values = [F.col(f"_e.`{f.name}`").alias(fields.get(f.name, f.name)) for f in element.fields] if hasattr(element, "fields") else [F.col("_e").alias("value")]
        return inner.select(F.concat_ws("#", F.col("parent_id").cast("string"), F.lit(column), F.col("ordinal")).alias("id"), "path", "parent_id", "ordinal", *values, "ord")

    return apply


def within(table: str, /, narrow: bool = False, unique: bool = False, reverse: bool = False, **options: str | None) -> Apply:
    """Spans around the row (the narrowest alone, if so asked), or with reverse the table's rows inside it."""

    def apply(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
        t = filtered(facts[table], given, options)
        r, s = rows.alias("r"), t.alias("t")
        if "start_byte" not in rows.columns:  # a file holds all of its rows
            return only(r.join(s, F.col("r.path") == F.col("t.path")), t)
        outer, inner = ("r", "t") if reverse else ("t", "r")
        inside = (F.col("r.path") == F.col("t.path")) & (F.col(f"{outer}.start_byte") <= F.col(f"{inner}.start_byte")) & (F.col(f"{inner}.end_byte") <= F.col(f"{outer}.end_byte"))
        both = r.join(s, inside)
        if not narrow:
            return only(both, t)
        width = F.col("t.end_byte") - F.col("t.start_byte")
        span = {"id": F.col("_t._i"), "start_byte": -F.col("_t._s"), "end_byte": F.col("_t._w") - F.col("_t._s")}
        best = F.min(F.struct(width.alias("_w"), (-F.col("t.start_byte")).alias("_s"), F.col("t.id").alias("_i"), *(F.col(f"t.`{c}`") for c in t.columns if c not in span)))
        # By the path too, which the join has dealt the rows out by.
        chosen = both.groupBy(F.col("r.path").alias("_path"), F.col("r.id").alias("_row"), F.col("r.ord").alias("ord")).agg(best.alias("_t"), *([F.sort_array(F.collect_list(width)).alias("_all")] if unique else []))
        if unique:
            chosen = chosen.where((F.size("_all") == 1) | (F.get("_all", F.lit(0)) < F.get("_all", F.lit(1))))
        return chosen.select(*((span[c].cast(t.schema[c].dataType).alias(c) if c in span else F.col(f"_t.`{c}`")) for c in t.columns), "ord")

    return apply


def closing(table: str, src: str, dst: str, target: str, emit_root: bool, one: int | None = 1) -> Apply:
    """Closure over an edge table; option depth: a number, or None with transitive=True."""

    def apply(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
        e = filtered(facts[table], given, {"proof": None})
        reached = graph.closure(rows.select("id"), e.select(F.col(src).alias("src"), F.col(dst).alias("dst")), None if given.get("transitive") else given.get("depth", one), emit_root)
        first = rows.groupBy("id").agg(F.min("ord").alias("ord"))
        ends = reached.join(graph.dealt(first.withColumnRenamed("id", "root")), "root").groupBy(F.col("id").alias("_end")).agg(F.min(F.struct("ord", "depth")).alias("_o"))
        t = facts[target]
        return graph.dealt(ends).join(t, ends["_end"] == t["id"]).select(*t.columns, F.concat("_o.ord", F.array(F.col("_o.depth").cast("long"))).alias("ord"))

    return apply


def project(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    return rows


def whole_files(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    t = facts["files"]
    return only(rows.alias("r").join(t.alias("t"), F.col("r.path") == F.col("t.path")), t)


def call_input(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """The receiver, or the argument bound to a parameter's number or name."""
    base = rows.select("ord", "path", F.col("id").alias("call_id"), "receiver", "arguments")
    if given.get("receiver"):
        return base.where("receiver is not null").select(F.concat_ws("#", "call_id", F.lit("receiver")).alias("id"), "path", "call_id", F.lit("receiver").alias("input_kind"), F.col("receiver").alias("text"), "ord")
    test: Callable[[Column], Column] = (lambda a: a["formal_index"] == given["parameter_index"]) if "parameter_index" in given else (lambda a: a["formal_name"] == given["parameter_name"])
    picked = base.select("*", F.explode(F.filter("arguments", test)).alias("a"))
    return picked.select(F.concat_ws("#", "call_id", F.col("a.position")).alias("id"), "path", "call_id", F.lit("parameter").alias("input_kind"), F.col("a.text").alias("text"), "ord")


def one_each(table: str, key: str, default: str, value: str = "unknown") -> Apply:
    """Exactly one row for each row: the table's, or one that says unknown."""

    def apply(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
        t = facts[table]
        both = rows.alias("r").join(t.alias("t"), F.col("r.id") == F.col(f"t.`{key}`"), "left")
        cols = [F.coalesce(F.col(f"t.`{c}`"), F.lit(value)).alias(c) if c == default else F.coalesce(F.col("t.id").cast("string"), F.concat_ws("#", F.col("r.id").cast("string"), F.lit(table))).alias("id") if c == "id" else F.coalesce(F.col(f"t.`{c}`"), F.col("r.id")).alias(c) if c == key else F.col(f"t.`{c}`").alias(c) for c in t.columns]
        return both.select(*cols, F.col("r.ord").alias("ord"))

    return apply


def counted(value: str) -> Apply:
    """A summary for each row: its candidates, and how many have the column true; never left out."""

    def apply(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
        t = facts["candidates"]
        both = rows.select(F.col("id").alias("occurrence_id"), "path", "ord").join(t.select(F.col("occurrence_id").alias("_o"), value), F.col("occurrence_id") == F.col("_o"), "left")
        return both.groupBy("occurrence_id", "path").agg(F.count("_o").alias("candidate_count"), F.count_if(F.col(value)).alias(f"{value}_count"), F.min("ord").alias("ord")).select(F.concat_ws("#", F.col("occurrence_id").cast("string"), F.lit(value)).alias("id"), "path", "occurrence_id", "candidate_count", f"{value}_count", "ord")

    return apply


def call_bindings(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """Written actuals with the formals they meet by name or position; formals without an actual stay, unbound."""
    formals = facts["parameters"].select(F.col("callee_id").alias("_callee"), F.col("index").alias("formal_index"), F.col("label").alias("formal_name"))
    calls = rows.select("ord", "path", F.col("id").alias("call_id"), "callee_id", F.posexplode("arguments").alias("argument_index", "a"))
    met = calls.alias("c").join(formals, (F.col("c.callee_id") == F.col("_callee")) & F.coalesce(F.col("c.a.name") == F.col("formal_name"), F.col("c.argument_index") == F.col("formal_index")), "left").select("ord", "path", "call_id", "argument_index", F.col("a.name").alias("name"), "formal_index", "formal_name")
    wanted = rows.select("ord", "path", F.col("id").alias("call_id"), "callee_id").join(formals, F.col("callee_id") == F.col("_callee"))
    unmet = wanted.join(met.select(F.col("call_id").alias("_c"), F.col("formal_index").alias("_f")), (F.col("call_id") == F.col("_c")) & (F.col("formal_index") == F.col("_f")), "left_anti").select("ord", "path", "call_id", F.lit(None).cast("int").alias("argument_index"), F.lit(None).cast("string").alias("name"), "formal_index", "formal_name")
    return met.unionByName(unmet).select(F.concat_ws("#", F.col("call_id").cast("string"), F.coalesce(F.col("argument_index").cast("string"), F.lit("-")), F.coalesce(F.col("formal_index").cast("string"), F.lit("-"))).alias("id"), "*")


def binding_of(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """The binding in effect: same name and namespace, active at the position, in the nearest enclosing scope; then the
    latest activation, then the latest binder. include_shadowed keeps the others behind it."""
    b, s = facts["bindings"], facts["scopes"].select(F.col("id").alias("_scope"), F.col("path").alias("_path"), F.col("start_byte").alias("_a"), F.col("end_byte").alias("_z"))
    both = rows.alias("r").join(b.alias("t"), (F.col("r.path") == F.col("t.path")) & (F.col("r.name") == F.col("t.name")) & (F.col("r.namespace") == F.col("t.namespace")) & ~F.col("t.wildcard") & F.col("r.start_byte").between(F.col("t.active_from"), F.col("t.active_to") - 1))
    both = both.join(s, (F.col("t.scope_id") == F.col("_scope")) & (F.col("r.start_byte") >= F.col("_a")) & (F.col("r.end_byte") <= F.col("_z")))
    rank = F.row_number().over(Window.partitionBy("r.id").orderBy(F.col("_z") - F.col("_a"), F.col("t.active_from").desc(), F.col("t.start_byte").desc()))
    ranked = both.select(*(F.col(f"t.`{c}`").alias(c) for c in b.columns), F.col("r.ord").alias("_o"), rank.alias("rank"))
    kept = ranked if given.get("include_shadowed") else ranked.where("rank = 1")
    return kept.withColumn("ord", F.concat("_o", F.array(F.col("rank").cast("long")))).drop("_o")


def family(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """The override family of each declaration: its roots' digest, or no_family."""
    e = facts["overrides"]
    up = graph.closure(rows.select("id"), e.select(F.col("member_id").alias("src"), F.col("base_id").alias("dst")))
    roots = up.join(e.select(F.col("member_id").alias("_m")), up["id"] == F.col("_m"), "left_anti").groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("roots"))
    own = rows.join(roots, rows["id"] == roots["root"], "left")
    has = own.join(e.select(F.col("base_id").alias("_b")).distinct(), F.col("id") == F.col("_b"), "left")
    found = F.coalesce("roots", F.when(F.col("_b").isNotNull(), F.array("id")))
    return has.select(F.col("id").alias("declaration_id"), "path", F.when(found.isNull(), "no_family").otherwise("proven").alias("outcome"), F.sha2(F.array_join(found.cast("array<string>"), "\0"), 256).alias("family_id"), "ord").withColumn("id", F.col("declaration_id"))


def family_edges(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    e = facts["overrides"]
    back = F.when(F.col("relation") == "overrides", "overridden_by").otherwise("implemented_by")
    both = e.select(F.col("member_id").alias("source_id"), F.col("base_id").alias("target_id"), "relation").union(e.select("base_id", "member_id", back))
    return rows.select("ord", "path", F.col("id").alias("source_id")).join(both, "source_id").select(F.concat_ws("#", F.col("source_id").cast("string"), "relation", F.col("target_id").cast("string")).alias("id"), "path", "source_id", "target_id", "relation", "ord")


def procedure_effects(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """Effects of a procedure's own calls (depth 1) and of what it calls in turn, with the least number of hops."""
    calls, effects = facts["calls"], facts["effects"]
    reached = graph.closure(rows.select("id"), calls.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")), None, True)
    hops = reached.join(effects.withColumnRenamed("callee_id", "id"), "id").groupBy("root", "effect_id").agg(F.min("depth").alias("depth"))
    return hops.join(rows.select(F.col("id").alias("root"), "path", "ord"), "root").select(F.concat_ws("#", F.col("root").cast("string"), "effect_id").alias("id"), "path", F.col("root").alias("procedure_id"), "effect_id", "depth", (F.col("depth") > 1).alias("transitive"), "ord")


def of_rows(rows: DataFrame, table: DataFrame, key: str = "procedure_id") -> DataFrame:
    """The table's rows that belong to the rows' ids."""
    return table.join(rows.select(F.col("id").alias("_own")).distinct(), F.col(key) == F.col("_own"), "left_semi")


def typestate(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """What a registered protocol finds wrong in the procedures: errors on the way, or an end in no accepting state. Ready
    findings are looked up where there is a table of them."""
    if "typestate_findings" in facts:
        return equi("typestate_findings", "id", "procedure_id", protocol=None)(rows, facts, given)
    p = REGISTRY.find("protocols", given.get("protocol"))
    seen = facts["state_events"].groupBy("procedure_id").agg(F.array_sort(F.collect_list(F.struct("point", F.col("id").alias("event_id"), "event"))).alias("witness"))
    runs = seen.select("procedure_id", "witness", reports.protocol_fold(F.col("witness"), "event", dict(p.transitions), p.initial, list(p.errors)).alias("r"))
    runs = runs.select("procedure_id", "witness", *reports.protocol_end(F.col("r"), list(p.accepting))).where("violations > 0 or ended_badly")
    found = rows.select(F.col("id").alias("procedure_id"), "path", "ord").join(runs, "procedure_id")
    return found.select(F.concat_ws("#", F.col("procedure_id").cast("string"), F.lit(given["protocol"])).alias("id"), "path", "procedure_id", F.lit(given["protocol"]).alias("protocol"), "state", "violations", "ended_badly", "witness", "ord")


def solved(kind: str, option: str, table: str) -> Apply:
    """A registered flow solved over the procedures' control edges: from every source to the sinks it reaches, around the barriers.
    An edge is of the procedure its first point is of. Ready findings are looked up."""

    def apply(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
        if table in facts:
            return equi(table, "id", "procedure_id", **{option: None})(rows, facts, given)
        plan = REGISTRY.find(kind, given.get(option))
        test = lambda t: F.when(F.expr(t) if t else F.lit(False), "1").otherwise("0")
        code = F.concat(test(plan.source), test(plan.sink), test(plan.barrier), F.coalesce(F.concat(F.lit("="), F.col("subject").cast("string")), F.lit("")))
        graphs = graph.packed(facts["points"], facts["control_edges"], facts["state_events"].withColumn("code", code)).withColumnRenamed("procedure", "procedure_id")
        mine = rows.select(F.col("id").alias("procedure_id"), F.col("path").alias("_path"), "ord")
        ends = graph.flows_between(graphs.join(mine, "procedure_id"), plan.classes)
        witness = F.array(F.struct(F.col("source_point").alias("point"), F.col("source_id").alias("event_id")), F.struct(F.col("target_point").alias("point"), F.col("target_id").alias("event_id"))).alias("witness")
        found = ends.select("procedure_id", F.col("_path").alias("path"), "source_id", "target_id", "distance", witness, "ord")
        return found.select(F.concat_ws("#", F.col("source_id").cast("string"), F.col("target_id").cast("string")).alias("id"), "path", "procedure_id", "source_id", "target_id", "distance", "witness", "ord")

    return apply


def flow_relations(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """Reaching, dominating and same-evaluation establishments of the reads: of a procedure's, or of the events given."""
    of_events = "event" in rows.columns
    if "flows" not in facts:
        events = facts["state_events"].withColumn("code", F.concat("event", F.lit("\0"), F.col("subject").cast("string")))
        graphs = graph.packed(facts["points"], facts["control_edges"], events).withColumnRenamed("procedure", "procedure_id")
        if of_events:
            rows = graph.dealt(graph.written(rows))  # read for its procedures and for its ids
        mine = rows.select("procedure_id").distinct() if of_events else rows.select(F.col("id").alias("procedure_id"), "ord")
        flows = graph.flow_pairs(graphs.join(mine, "procedure_id"))
        flows = flows.select(F.concat_ws("#", "relation", F.col("source_id").cast("string"), F.col("target_id").cast("string")).alias("id"), "path", "procedure_id", "relation", "source_id", "target_id", "certainty", *([] if of_events else ["ord"]))
        if not of_events:
            return filtered(flows, given, FLOW)
        facts = facts | {"flows": flows}
    return equi("flows", "id", "target_id" if of_events else "procedure_id", **FLOW)(rows, facts, given)


def rewrite_paths(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """What becomes of each name that a file's rewrite rules (path, src, dst) start from."""
    if "rewrite_rules" in facts:
        rules = facts["rewrite_rules"].join(rows.select("path").distinct(), "path", "left_semi")
        named = lambda c: F.concat_ws("\0", "path", F.col(c).cast("string"))
        chased = graph.rewrite_chase(rules.select(named("src").alias("id")).distinct(), rules.select(named("src").alias("src"), named("dst").alias("dst")), given.get("bound", 8))
        paths = chased.select("id", F.split("id", "\0")[0].alias("path"), F.split("id", "\0")[1].alias("name"), "steps", "outcome", F.split("fixed_point", "\0")[1].alias("fixed_point"))
        facts = facts | {"rewrite_paths": paths}
    return equi("rewrite_paths", "path", "path", outcome="rewrite_outcome")(rows, facts, given)


def call_shape(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """One row for each site, the call's facts where there are any."""
    t = facts["calls"]
    both = rows.alias("r").join(t.alias("t"), F.col("r.id") == F.col("t.id"), "left")
    return both.select(*(F.coalesce(F.col(f"t.`{c}`"), F.col(f"r.`{c}`")).alias(c) if c in ("id", "path") else F.col(f"t.`{c}`").alias(c) for c in t.columns), F.col("t.id").isNotNull().alias("known"), F.col("r.ord").alias("ord"))


def applicability(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """Each candidate of an occurrence with its verdict: applicable if the arity fits, unknown without a signature."""
    bounds = facts["signatures"].select(F.col("declaration_id").alias("_d"), "min_arity", "max_arity")
    c = facts["candidates"].join(bounds, F.col("target_id") == F.col("_d"), "left").drop("_d")
    both = rows.alias("r").join(c.alias("t"), F.col("r.id") == F.col("t.occurrence_id"))
    fits = F.col("r.arity").between(F.col("t.min_arity"), F.col("t.max_arity"))
    verdict = F.when(fits, "applicable").when(~fits, "not_applicable").otherwise("unknown")
    return both.select(*(F.col(f"t.`{x}`").alias(x) for x in c.columns), F.col("r.arity").alias("arity"), verdict.alias("verdict"), F.col("r.ord").alias("ord"))


def trimmed(rows: DataFrame, facts: Facts, given: dict) -> DataFrame:
    """Kept witness steps, cut to max_steps; nothing is solved again."""
    return unfold("witness")(rows.withColumn("witness", F.slice("witness", 1, F.lit(given.get("max_steps", 1 << 20)))), facts, given)


SITES = "match reference_site call_site expression_site occurrence"
declare("enclosing_decl", "match", "declaration", within("declarations", narrow=True))
declare("procedure_of", "match declaration", "procedure", within("procedures", narrow=True, unique=True))
declare("cfg_entry", "procedure", "program_point", lambda r, f, o: equi("points", "id", "procedure_id")(r, f | {"points": f["points"].where("boundary = 'entry'")}, o))
declare("cfg_exits", "procedure", "program_point", lambda r, f, o: equi("points", "id", "procedure_id")(r, f | {"points": f["points"].where("boundary in ('normal_exit', 'exceptional_exit')")}, o))
declare("cfg_successor_edges", "program_point", "control_edge", equi("control_edges", "id", "src", edge_kind="control_edge"), edge_kind="control_edge")
declare("cfg_predecessor_edges", "program_point", "control_edge", equi("control_edges", "id", "dst", edge_kind="control_edge"), edge_kind="control_edge")
declare("cfg_edge_source", "control_edge", "program_point", equi("points", "src", "id"))
declare("cfg_edge_target", "control_edge", "program_point", equi("points", "dst", "id"))
declare("typestate", "procedure", "typestate_finding", typestate, protocol=None)
declare("value_flow", "procedure", "flow_endpoint", solved("flows", "plan", "flow_endpoints"), plan=None)
declare("taint", "procedure", "taint_finding", solved("taints", "taint", "taint_findings"), taint=None)
declare("witness", "typestate_finding", "typestate_witness", trimmed, max_steps=None)
declare("file_of", "match declaration reference_site occurrence call_site expression_site receiver_analysis receiver_outcome receiver_evidence member_selection overload_selection callable_applicability dispatch_outcome dispatch_target member_family member_family_edge call_shape call_argument_group call_argument call_binding call_effect procedure_effect callable_signature signature_parameter lexical_scope binding resolution_candidate candidate_hop reference_edge state_event flow_relation rewrite_path qualified_path path_segment procedure program_point control_edge", "file", whole_files)
declare("imports_of", "file", "file", lambda r, f, o: equi("files", "to_path", "path")(equi("imports", "path", "from_path")(r, f, o), f, o))
declare("importers_of", "file", "file", lambda r, f, o: equi("files", "from_path", "path")(equi("imports", "path", "to_path")(r, f, o), f, o))
declare("supertypes", "declaration", "declaration", closing("supertypes", "declaration_id", "supertype_id", "declarations", False), depth=None, transitive=None)
declare("subtypes", "declaration", "declaration", closing("supertypes", "supertype_id", "declaration_id", "declarations", False), depth=None, transitive=None)
declare("members", "declaration", "declaration", equi("declarations", "id", "parent_id"))
declare("owner", "declaration", "declaration", equi("declarations", "parent_id", "id"))
declare("references_of", "declaration", "reference_site", equi("refs", "id", "target_id", reference_kind=None, usage_kind=None, proof=None), reference_kind=None, usage_kind=None, proof=None)
declare("used_by", "declaration", "declaration", lambda r, f, o: equi("declarations", "enclosing_id", "id")(STEPS["references_of"].apply(r, f, o), f, o), reference_kind=None, proof=None)
declare("uses", "declaration", "declaration", lambda r, f, o: equi("declarations", "target_id", "id")(equi("refs", "id", "enclosing_id", proof=None)(r, f, o), f, o), proof=None)
declare("callers", "declaration", "declaration", closing("calls", "callee_id", "caller_id", "declarations", True), depth=None, transitive=None, proof=None)
declare("callees", "declaration", "declaration", closing("calls", "caller_id", "callee_id", "declarations", True), depth=None, transitive=None, proof=None)
declare("call_sites_to", "declaration", "call_site", equi("calls", "id", "callee_id", proof=None), proof=None)
declare("call_sites_from", "declaration", "call_site", equi("calls", "id", "caller_id", proof=None), proof=None)
declare("call_input", "call_site", "expression_site", call_input, receiver=None, parameter_index=None, parameter_name=None)
declare("receiver_targets", SITES, "receiver_analysis", one_each("receiver_analyses", "site_id", "outcome"))
declare("points_to", "match reference_site expression_site occurrence", "receiver_analysis", lambda r, f, o: equi("receiver_analyses", "id", "site_id")(r, f | {"receiver_analyses": f["receiver_analyses"].where("analysis_kind = 'points_to'")}, o))
declare("member_targets", "match reference_site occurrence", "receiver_analysis", lambda r, f, o: equi("receiver_analyses", "id", "site_id")(r, f | {"receiver_analyses": f["receiver_analyses"].where("analysis_kind = 'member'")}, o))
declare("receiver_outcome", "receiver_analysis", "receiver_outcome", lambda r, f, o: r.select("id", "path", "site_id", "outcome", "ord"))
declare("receiver_evidence", "receiver_analysis", "receiver_evidence", unfold("evidence"))
declare("call_shape", "match call_site occurrence", "call_shape", call_shape)
declare("call_argument_groups", "call_shape", "call_argument_group", lambda r, f, o: r.select(F.concat_ws("#", F.col("id").cast("string"), F.lit("0")).alias("id"), "path", F.col("id").alias("call_id"), F.lit(0).alias("group_index"), "arguments", "ord"))
declare("call_arguments", "call_argument_group", "call_argument", unfold("arguments", position="argument_index"))
declare("call_effects", "call_shape", "call_effect", lambda r, f, o: r.alias("r").join(f["effects"].alias("e"), F.col("r.callee_id") == F.col("e.callee_id"), "left").select(F.concat_ws("#", F.col("r.id").cast("string"), F.coalesce("e.effect_id", F.lit("-"))).alias("id"), "r.path", F.col("r.id").alias("call_id"), "e.effect_id", "r.ord"))
declare("procedure_effects", "declaration", "procedure_effect", procedure_effects)
declare("call_bindings", "call_shape", "call_binding", call_bindings)
declare("callable_signature", "declaration", "callable_signature", equi("signatures", "id", "declaration_id"))
declare("signature_parameters", "callable_signature", "signature_parameter", unfold("parameters"))
declare("callable_applicability", "occurrence", "callable_applicability", applicability)
declare("overload_selection", "occurrence", "overload_selection", counted("applicable"))
declare("member_selection", "occurrence", "member_selection", counted("selected"))
declare("dispatch_outcome", "match call_site reference_site occurrence", "dispatch_outcome", one_each("dispatch_outcomes", "site_id", "outcome"))
declare("dispatch_targets", "match call_site reference_site occurrence", "dispatch_target", equi("dispatch_targets", "id", "site_id", proof=None), proof=None)
declare("member_family", "declaration", "member_family", family)
declare("family_edges", "declaration", "member_family_edge", family_edges)
declare("occurrences_of", "declaration", "occurrence", equi("occurrences", "id", "target_id", role="role", role_class="role_class", namespace="namespace"), role="role", role_class="role_class", namespace="namespace")
declare("occurrences_in", "match file", "occurrence", within("occurrences", reverse=True, role="role", role_class="role_class", namespace="namespace"), role="role", role_class="role_class", namespace="namespace")
declare("occurrence_target", "occurrence", "declaration", equi("declarations", "target_id", "id"))
declare("scope_of", "binding occurrence match", "lexical_scope", within("scopes", narrow=True))
declare("scope_ancestors", "lexical_scope", "lexical_scope", lambda r, f, o: closing("_scope_edges", "src", "dst", "scopes", False, None)(r, f | {"_scope_edges": f["scopes"].where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))}, o))
declare("bindings_in", "lexical_scope match", "binding", lambda r, f, o: (equi("bindings", "id", "scope_id", kind="binding_kind", name=None, hoisting="hoisting") if "parent_id" in r.columns and "kind" not in r.columns else within("bindings", reverse=True, kind="binding_kind", name=None, hoisting="hoisting"))(r, f, o), kind="binding_kind", name=None, hoisting="hoisting")
declare("binding_of", "occurrence", "binding", binding_of, include_shadowed=None)
declare("binding_occurrence", "binding", "occurrence", equi("occurrences", "ast_id", "ast_id"))
declare("candidates_of", "occurrence", "resolution_candidate", equi("candidates", "id", "occurrence_id", tier="tier", outcome=None, boundary="boundary"), tier="tier", outcome=None, boundary="boundary")
declare("candidate_hierarchy", "occurrence", "candidate_hop", lambda r, f, o: unfold("hops")(equi("candidates", "id", "occurrence_id")(r, f, o), f, o))
declare("candidate_target", "resolution_candidate", "declaration", equi("declarations", "target_id", "id"))
EDGE = {"direction": "edge_direction", "owner_relation": "owner_relation", "site_class": "site_class", "proof": None, "usage_kind": None, "reference_kind": None}
declare("edges_of", "declaration", "reference_edge", equi("reference_edges", "id", "target_id", **EDGE), **EDGE)
declare("edges_from", "occurrence", "reference_edge", equi("reference_edges", "id", "site_id", **EDGE), **EDGE)
declare("edge_target", "reference_edge", "declaration", equi("declarations", "target_id", "id"))
EVENT = {"event": "state_event", "subject_kind": "subject"}
declare("state_events_of", "procedure declaration", "state_event", equi("state_events", "id", "procedure_id", **EVENT), **EVENT)
declare("flow_relations_of", "state_event procedure", "flow_relation", flow_relations, **FLOW)
declare("flow_source", "flow_relation", "state_event", equi("state_events", "source_id", "id"))
declare("flow_target", "flow_relation", "state_event", equi("state_events", "target_id", "id"))
declare("rewrite_paths_of", "file", "rewrite_path", rewrite_paths, outcome="rewrite_outcome", bound=None)
declare("segments_of", "qualified_path", "path_segment", unfold("segments"))
declare("segment_target", "path_segment", "declaration", lambda r, f, o: listed("declarations", "target_ids")(r, f, o) if "target_ids" in r.columns else equi("declarations", "value", "short_name")(r, f, o))
declare("generates", "generation_site", "declaration_state", equi("declaration_states", "id", "generation_site_id"))
declare("generated_by", "declaration declaration_state", "generation_site", lambda r, f, o: equi("generation_sites", "generation_site_id", "id")(r if "generation_site_id" in r.columns else equi("declaration_states", "id", "declaration_id")(r, f, o), f, o))
declare("declaration_state_of", "declaration", "declaration_state", equi("declaration_states", "id", "declaration_id", origin="origin", declaration_only=None, config_gated=None), origin="origin", declaration_only=None, config_gated=None)
declare("implementation_of", "declaration_state declaration", "declaration", lambda r, f, o: equi("declarations", "implementation_id", "id")(r if "implementation_id" in r.columns else equi("declaration_states", "id", "declaration_id")(r, f, o), f, o))
declare("stubs_of", "declaration", "declaration_state", equi("declaration_states", "id", "implementation_id"))
declare("export_target", "export", "declaration", equi("declarations", "target_id", "id"))


def gives(step: str, kind: str) -> str:
    return "flow_witness" if step == "witness" and kind == "flow_endpoint" else STEPS[step].gives


def run_step(name: str, kind: str, rows: DataFrame, facts: Facts, options: dict | None = None, path: str = "") -> tuple[str, DataFrame]:
    """The kind and rows after a step; refused where the rows' kind, an option or a value doesn't fit."""
    step = check_step(name, kind, options or {}, path)
    out = step.apply(rows, facts, options or {})
    return gives(name, kind), joins.first_seen(out, ["id"])


def check_step(name: str, kind: str, options: dict, path: str = "") -> Step:
    if name not in STEPS:
        raise PlanError(path, f"there is no step {name!r}")
    step = STEPS[name]
    if kind not in step.takes | ({"flow_endpoint"} if name == "witness" else set()):
        raise PlanError(path, f"{name} does not take rows of kind {kind}")
    for option, values in options.items():
        if option not in step.options:
            raise PlanError(path, f"{name} has no option {option!r}")
        if step.options[option]:
            checked(step.options[option], [v for v in ([values] if isinstance(values, str) else values) if v != "unattributed"], path)
    return step
