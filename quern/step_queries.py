"""A registered query for each seed and step of the query language over whole tables, each with its SQL.

The SQL is written against the fact tables of `workspace`; queries run through `plans.query.every`, checks included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import patterns
from .plans import query as language
from .workspace import Workspace, with_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, query: dict | str, columns: str, sql: str) -> None:
    """columns: names, or `new=old`."""
    chosen = [(c.split("=")[-1], c.split("=")[0]) for c in columns.split()]

    def run(s: SparkSession, d: str) -> DataFrame:
        # Every part of the nodes', roles' and procedures' tables groups all lines again.
        many = isinstance(query, dict) and (several(query.get("match", {})) or any(step["op"] == "procedure_of" for step in query.get("steps", [])))
        return language.every(query, Workspace(s, d, ("lines",) if many else ())).select(*(F.col(old).alias(new) for old, new in chosen))

    QUERIES[name] = run
    SQL[name] = with_facts(sql)


def several(pattern: dict) -> bool:
    """Whether a pattern looks at nodes and roles more than once."""
    return "arity" in pattern or bool(patterns.captures(pattern))


def declared(kind: str, *steps, **options) -> dict:
    return {"declarations": {"kind": kind, **options}, "steps": [s if isinstance(s, dict) else {"op": s} for s in steps]}


def seeded(seed: str, *steps, **options) -> dict:
    return {seed: options, "steps": [s if isinstance(s, dict) else {"op": s} for s in steps]}


# Seeds.
register("seed_match", '(query (language sql) (call (name "R")))', "id path text", "SELECT id, path, status AS text FROM lines WHERE flag = 'R'")
register("seed_text_regex", {"match": {"kind": "call", "text": "^[F]$"}}, "id", "SELECT id FROM lines WHERE status = 'F'")
register("seed_not_kind", {"match": {"name": "A", "not_kind": ["callable", "literal"]}}, "id", "SELECT id FROM lines WHERE flag = 'A'")
register("seed_occurrence", seeded("occurrences", role="value_reference", role_class=["reference", "binder"]), "id name", "SELECT id, name FROM occurrences WHERE role = 'value_reference'")
register("seed_scope", seeded("scopes"), "id start_byte end_byte", "SELECT id, start_byte, end_byte FROM scopes")
register("seed_binding", seeded("bindings", kind="local", hoisting="source_order"), "id name", "SELECT id, name FROM bindings WHERE kind = 'local'")
register("seed_path", seeded("paths", min_segments=2), "id", "SELECT id FROM paths")
register("seed_generation_site", seeded("generation_sites", kind="accessor_macro", input="dynamic"), "id", "SELECT id FROM generation_sites WHERE kind = 'accessor_macro' AND input = 'dynamic'")
register("seed_export", seeded("exports", form="named"), "id name", "SELECT id, name FROM exports WHERE form = 'named'")
register("where_globs", {"files": {}, "where": ["o1*", "lib?"]}, "id path", "SELECT id, path FROM files WHERE path LIKE 'o1%' OR path LIKE 'lib_'")
register("where_languages", {"files": {}, "languages": ["lib", "log"]}, "id path", "SELECT id, path FROM files WHERE language IN ('lib', 'log')")
register("language_union", {"union": [declared("function", name="Brand#11"), declared("function", name="Brand#12"), declared("function", name="Brand#11")]}, "id name", "SELECT id, name FROM declarations WHERE name IN ('Brand#11', 'Brand#12') AND kind = 'function'")
register("language_intersect", {"intersect": [declared("function"), declared("function", name="Brand#11")]}, "id", "SELECT id FROM declarations WHERE name = 'Brand#11'")
register("language_except", {"except": [declared("function"), declared("function", name="Brand#11")]}, "id", "SELECT id FROM declarations WHERE kind = 'function' AND name <> 'Brand#11'")

# Patterns.
register("pattern_roles", '(call :callee (name "R") :receiver (name "F"))', "id", "SELECT id FROM lines WHERE flag = 'R' AND status = 'F'")
register("pattern_arity", {"match": {"kind": "call", "arity": {"min": 2}}}, "id", "SELECT id FROM lines WHERE qty > 20")
register("pattern_args", {"match": {"kind": "call", "args": [{"kind": "literal", "name": "A"}, {"name": "F"}]}}, "id", "SELECT id FROM lines WHERE flag = 'A' AND status = 'F' AND qty > 20")
register("pattern_kwargs", {"match": {"kind": "call", "kwargs": {"b": {"kind": "numeric_literal", "text": "O"}}}}, "id", "SELECT id FROM lines WHERE status = 'O' AND qty > 20")
register("pattern_decorators", {"match": {"kind": "callable", "decorators": [{"name": "F"}]}}, "id", "SELECT -1 - id AS id FROM lines WHERE status = 'F' AND qty > 40")
register("pattern_has", {"match": {"kind": "class", "has": {"kind": "call", "name": "R", "text": "O"}}}, "path", "SELECT DISTINCT path FROM lines WHERE flag = 'R' AND status = 'O' AND o IN (SELECT o_orderkey FROM orders)")
register("pattern_not_has", {"match": {"kind": "class", "name": "F", "not_has": {"kind": "call", "name": "R"}}}, "path", "SELECT 'o' || CAST(o_orderkey AS STRING) AS path FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT o FROM lines WHERE flag = 'R')")
register("pattern_inside", {"match": {"kind": "call", "name": "N", "inside": {"kind": "class", "name": "P"}}}, "id", "SELECT id FROM lines JOIN orders ON o = o_orderkey WHERE flag = 'N' AND o_orderstatus = 'P'")
register("pattern_not_inside", {"match": {"kind": "call", "not_inside": {"kind": "class", "name": ["P"][0]}}}, "id", "SELECT id FROM lines WHERE o NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
register("pattern_inside_decl", {"match": {"kind": "string_literal", "inside_decl": {"kind": "method", "name": "R"}}}, "id", "SELECT 1000000000000 + id * 2 AS id FROM lines WHERE flag = 'R'")
register("pattern_name_regex", {"match": {"kind": "call", "name_regex": "^(A|R)$"}}, "id", "SELECT id FROM lines WHERE flag IN ('A', 'R')")
register("pattern_capture", {"match": {"kind": "call", "capture": "c", "args": [{"capture": "a"}]}}, "id capture_c", "SELECT id, status AS capture_c FROM lines")
register("pattern_same_capture", {"match": {"kind": "call", "receiver": {"capture": "x"}, "kwargs": {"b": {"capture": "x"}}}}, "id capture_x", "SELECT id, status AS capture_x FROM lines WHERE flag <> 'N' AND qty > 20")
register("pattern_captures_differ", {"match": {"kind": "call", "capture": "x", "args": [{"capture": "x"}]}}, "id capture_x", "SELECT id, status AS capture_x FROM lines WHERE qty > 20")
register("pattern_same_capture_in_args", {"match": {"kind": "call", "callee": {"capture": "x"}, "args": [{"capture": "x"}]}}, "id capture_x", "SELECT id, flag AS capture_x FROM lines")

# Structure: files, declarations, procedures and their control flow.
register("step_enclosing_decl", {"match": {"kind": "call", "name": "R"}, "steps": [{"op": "enclosing_decl"}]}, "id kind name", "SELECT id, 'method' AS kind, flag AS name FROM lines WHERE flag = 'R'")
register("step_procedure_of", declared("method", "procedure_of", name="N"), "id start_byte", "SELECT id, n * 100 AS start_byte FROM lines WHERE flag = 'N'")
register("step_cfg_entry", declared("method", "procedure_of", "cfg_entry"), "id procedure_id", "SELECT id * 4 AS id, id AS procedure_id FROM lines")
register("step_cfg_exits", declared("method", "procedure_of", "cfg_exits", name="A"), "id boundary", "SELECT p.id, p.boundary FROM points p JOIN lines ON p.procedure_id = lines.id WHERE flag = 'A' AND boundary LIKE '%exit'")
register("step_cfg_successors", declared("method", "procedure_of", "cfg_entry", "cfg_successor_edges", "cfg_edge_target", {"op": "cfg_successor_edges", "edge_kind": ["exceptional", "loop_back"]}), "id src dst edge_kind", "SELECT id, src, dst, edge_kind FROM control_edges WHERE edge_kind IN ('exceptional', 'loop_back')")
register("step_cfg_predecessors", declared("method", "procedure_of", "cfg_exits", {"op": "cfg_predecessor_edges", "edge_kind": "exceptional"}, "cfg_edge_source"), "id boundary", "SELECT id * 4 + 1 AS id, 'body' AS boundary FROM lines WHERE status = 'F'")
register("step_file_of", declared("method", "file_of", name="R"), "id path", "SELECT DISTINCT files.id, files.path FROM files JOIN lines ON files.path = lines.path WHERE flag = 'R'")
register("step_imports_of", {"files": {}, "where": ["o1?"], "steps": [{"op": "imports_of"}]}, "id path", "SELECT DISTINCT f.id, f.path FROM files f JOIN imports ON f.path = to_path WHERE from_path LIKE 'o1_'")
register("step_importers_of", {"files": {}, "where": ["lib3"], "steps": [{"op": "importers_of"}]}, "id path", "SELECT DISTINCT f.id, f.path FROM files f JOIN imports ON f.path = from_path WHERE to_path = 'lib3'")
register("step_members", declared("class", "members", name="P"), "id kind", "SELECT m.id, m.kind FROM declarations m JOIN declarations c ON m.parent_id = c.id WHERE c.kind = 'class' AND c.name = 'P'")
register("step_owner", declared("method", "owner", name="A"), "id name", "SELECT DISTINCT c.id, c.name FROM declarations m JOIN declarations c ON m.parent_id = c.id WHERE m.kind = 'method' AND m.name = 'A'")
UPS = "u AS (SELECT id AS here, 0 AS k FROM declarations WHERE name = 'Brand#11' AND kind = 'function' UNION SELECT {to}, k + 1 FROM u JOIN supertypes ON here = {of} WHERE k < {most})"
register("step_supertypes", declared("function", {"op": "supertypes", "transitive": True}, name="Brand#11"), "id", f"WITH RECURSIVE {UPS.format(to='supertype_id', of='declaration_id', most=99)} SELECT DISTINCT d.id FROM u JOIN declarations d ON d.id = here WHERE k > 0")
register("step_subtypes", declared("function", {"op": "subtypes", "depth": 2}, name="Brand#11"), "id", f"WITH RECURSIVE {UPS.format(to='declaration_id', of='supertype_id', most=2)} SELECT DISTINCT d.id FROM u JOIN declarations d ON d.id = here WHERE k > 0")

# References and calls.
register("step_references_of", declared("function", {"op": "references_of", "proof": "proven", "usage_kind": "F"}, name="Brand#11"), "id target_id", "SELECT refs.id, target_id FROM refs JOIN declarations d ON target_id = d.id WHERE d.name = 'Brand#11' AND proof = 'proven' AND usage_kind = 'F'")
register("step_used_by", declared("function", "used_by", name="Brand#11"), "id name", "SELECT DISTINCT o.id, o.name FROM refs JOIN declarations d ON target_id = d.id JOIN declarations o ON enclosing_id = o.id WHERE d.name = 'Brand#11'")
register("step_uses", declared("class", {"op": "uses", "proof": "candidate"}, name="P"), "id name", "SELECT DISTINCT t.id, t.name FROM refs JOIN declarations c ON enclosing_id = c.id JOIN declarations t ON target_id = t.id WHERE c.kind = 'class' AND c.name = 'P' AND proof = 'candidate'")
CALLED = "r AS (SELECT id AS here, 0 AS k FROM declarations WHERE name = 'Brand#11' AND kind = 'function' UNION SELECT {to}, k + 1 FROM r JOIN calls ON here = {of} WHERE k < {most})"
register("step_callers", declared("function", {"op": "callers", "depth": 2}, name="Brand#11"), "id kind", f"WITH RECURSIVE {CALLED.format(to='caller_id', of='callee_id', most=2)} SELECT DISTINCT d.id, d.kind FROM r JOIN declarations d ON d.id = here WHERE k > 0")
register("step_callees", declared("function", {"op": "callees", "transitive": True, "proof": "candidate"}, name="Brand#11"), "id kind", f"WITH RECURSIVE {CALLED.format(to='callee_id', of='caller_id', most=99)} SELECT DISTINCT d.id, d.kind FROM r JOIN declarations d ON d.id = here WHERE k > 0")
register("step_call_sites_to", declared("function", {"op": "call_sites_to", "proof": "proven"}, name="Brand#11"), "id callee_id", "SELECT calls.id, callee_id FROM calls JOIN declarations d ON callee_id = d.id WHERE d.name = 'Brand#11' AND proof = 'proven'")
register("step_call_sites_from", declared("method", "call_sites_from", name="R"), "id callee_id", "SELECT id, -1 - part AS callee_id FROM lines WHERE flag = 'R'")
register("step_call_input_receiver", declared("method", "call_sites_from", {"op": "call_input", "receiver": True}), "call_id text", "SELECT id AS call_id, status AS text FROM lines WHERE flag <> 'N'")
register("step_call_input_parameter", declared("method", "call_sites_from", {"op": "call_input", "parameter_name": "b"}), "call_id text input_kind", "SELECT id AS call_id, status AS text, 'parameter' AS input_kind FROM lines")
register("step_call_shape", {"match": {"kind": "call"}, "steps": [{"op": "call_shape"}]}, "id callee_id receiver known", "SELECT id, -1 - part AS callee_id, CASE WHEN flag <> 'N' THEN status END AS receiver, TRUE AS known FROM lines")
register("step_call_shape_unknown", seeded("occurrences", "call_shape", name="view"), "id path known", "SELECT o.id, coalesce(c.path, o.path) AS path, c.id IS NOT NULL AS known FROM occurrences o LEFT JOIN calls c ON o.id = c.id WHERE o.name = 'view'")
register("step_call_arguments", {"match": {"kind": "call", "name": "R"}, "steps": [{"op": "call_shape"}, {"op": "call_argument_groups"}, {"op": "call_arguments"}]}, "parent_id argument_index text name", "SELECT CAST(id AS STRING) || '#0' AS parent_id, k AS argument_index, CASE k WHEN 0 THEN flag ELSE status END AS text, CASE k WHEN 1 THEN 'b' END AS name FROM lines, (VALUES (0), (1)) a(k) WHERE flag = 'R'")
register("step_call_effects", {"match": {"kind": "call", "name": "A"}, "steps": [{"op": "call_shape"}, {"op": "call_effects"}]}, "call_id effect_id", "SELECT lines.id AS call_id, effect_id FROM lines LEFT JOIN effects ON callee_id = -1 - part WHERE flag = 'A'")
register("step_procedure_effects", declared("function", "procedure_effects", name="Brand#11"), "procedure_id effect_id depth", "WITH RECURSIVE r AS (SELECT d.id AS root, callee_id AS here, 1 AS k FROM declarations d JOIN calls ON caller_id = d.id WHERE d.kind = 'function' AND d.name = 'Brand#11' UNION SELECT root, callee_id, k + 1 FROM r JOIN calls ON caller_id = here) SELECT root AS procedure_id, effect_id, CAST(min(k) AS INTEGER) AS depth FROM r JOIN effects e ON e.callee_id = here GROUP BY 1, 2")
register("step_call_bindings", {"match": {"kind": "call", "name": "R"}, "steps": [{"op": "call_shape"}, {"op": "call_bindings"}]}, "call_id argument_index formal_index formal_name", "SELECT id AS call_id, CASE k WHEN 2 THEN NULL ELSE k END AS argument_index, k AS formal_index, f AS formal_name FROM lines, (VALUES (0, 'a'), (1, 'b'), (2, 'c')) x(k, f) WHERE flag = 'R'")
register("step_callable_signature", declared("function", "callable_signature", "signature_parameters", name="Brand#11"), "parent_id ordinal label", "SELECT s.id AS parent_id, k AS ordinal, l AS label FROM signatures s JOIN declarations d ON declaration_id = d.id, (VALUES (0, 'a'), (1, 'b'), (2, 'c')) x(k, l) WHERE d.name = 'Brand#11'")
register("step_receiver_targets", declared("function", "call_sites_to", "receiver_targets", name="Brand#11"), "site_id outcome", "SELECT c.id AS site_id, coalesce(outcome, 'unknown') AS outcome FROM calls c JOIN declarations d ON callee_id = d.id LEFT JOIN receiver_analyses r ON r.site_id = c.id WHERE d.name = 'Brand#11'")
register("step_points_to", seeded("occurrences", "points_to", role_class="reference"), "id site_id outcome", "SELECT r.id, site_id, outcome FROM receiver_analyses r JOIN occurrences o ON o.id = site_id WHERE role_class = 'reference' AND analysis_kind = 'points_to'")
register("step_receiver_outcome", seeded("occurrences", "member_targets", "receiver_outcome", name="click"), "id site_id outcome", "SELECT r.id, site_id, outcome FROM receiver_analyses r JOIN occurrences o ON o.id = site_id WHERE name = 'click' AND analysis_kind = 'member'")
register("step_receiver_evidence", seeded("occurrences", "points_to", "receiver_evidence", name="view"), "parent_id ordinal evidence_kind value", "SELECT r.id AS parent_id, k AS ordinal, e AS evidence_kind, site_id + k AS value FROM receiver_analyses r JOIN occurrences o ON o.id = site_id, (VALUES (0, 'value'), (1, 'provenance')) x(k, e) WHERE name = 'view' AND outcome = 'proven' AND analysis_kind = 'points_to'")

# Resolution: occurrences, scopes, bindings, candidates, dispatch, families.
register("step_occurrences_of", declared("function", {"op": "occurrences_of", "role": "member_position"}, name="Brand#11"), "id target_id", "SELECT o.id, target_id FROM occurrences o JOIN declarations d ON target_id = d.id WHERE d.kind = 'function' AND d.name = 'Brand#11' AND o.name = 'click'")
register("step_occurrences_in", {"files": {}, "where": ["u1?"], "steps": [{"op": "occurrences_in", "role_class": "binder"}]}, "id path", "SELECT id, path FROM occurrences WHERE path LIKE 'u1_' AND role_class = 'binder'")
register("step_occurrence_target", seeded("occurrences", "occurrence_target", name="view"), "id kind", "SELECT DISTINCT d.id, d.kind FROM occurrences o JOIN declarations d ON target_id = d.id WHERE o.name = 'view'")
register("step_scope_of", seeded("occurrences", "scope_of", name="purchase"), "id start_byte", "SELECT DISTINCT sid AS id, sb AS start_byte FROM (SELECT s.id AS sid, s.start_byte AS sb, row_number() OVER (PARTITION BY o.id ORDER BY s.end_byte - s.start_byte, s.start_byte DESC, s.id) AS k FROM occurrences o JOIN scopes s ON o.path = s.path AND s.start_byte <= o.start_byte AND o.end_byte <= s.end_byte WHERE o.name = 'purchase') WHERE k = 1")
register("step_scope_ancestors", seeded("bindings", "scope_of", "scope_ancestors", kind="parameter"), "id start_byte", "SELECT DISTINCT s.id, s.start_byte FROM scopes s JOIN marks m ON s.id = 10000000 + user_id WHERE m.name = 'signup'")
register("step_bindings_in", seeded("scopes", {"op": "bindings_in", "kind": "parameter"}), "id scope_id", "SELECT id, scope_id FROM bindings WHERE kind = 'parameter'")
register("step_binding_of", seeded("occurrences", "binding_of", role_class="reference"), "id name", "SELECT DISTINCT bid AS id, bn AS name FROM (SELECT b.id AS bid, b.name AS bn, row_number() OVER (PARTITION BY o.id ORDER BY s.end_byte - s.start_byte, b.active_from DESC, b.start_byte DESC) AS k FROM occurrences o JOIN bindings b ON o.path = b.path AND o.name = b.name AND o.namespace = b.namespace AND o.start_byte >= b.active_from AND o.start_byte < b.active_to JOIN scopes s ON b.scope_id = s.id AND o.start_byte >= s.start_byte AND o.end_byte <= s.end_byte WHERE o.role_class = 'reference') WHERE k = 1")
register("step_binding_occurrence", seeded("bindings", "binding_occurrence", kind="local"), "id name", "SELECT id, name FROM occurrences WHERE name = 'error'")
register("step_candidates_of", seeded("occurrences", {"op": "candidates_of", "tier": "wildcard_import", "boundary": "external_indexed"}, name="click"), "id occurrence_id outcome", "SELECT c.id, occurrence_id, outcome FROM candidates c JOIN occurrences o ON o.id = occurrence_id WHERE name = 'click' AND tier = 'wildcard_import'")
register("step_candidate_hierarchy", seeded("occurrences", "candidate_hierarchy", name="view"), "parent_id ordinal relation target_id", "SELECT c.id AS parent_id, k AS ordinal, r AS relation, c.target_id - k AS target_id FROM candidates c JOIN occurrences o ON o.id = occurrence_id, (VALUES (0, 'extends'), (1, 'implements')) x(k, r) WHERE name = 'view' AND tier = 'own_member'")
register("step_candidate_target", seeded("occurrences", "candidates_of", "candidate_target", name="view"), "id name", "SELECT DISTINCT d.id, d.name FROM candidates c JOIN occurrences o ON o.id = occurrence_id JOIN declarations d ON c.target_id = d.id WHERE o.name = 'view'")
register("step_callable_applicability", seeded("occurrences", "callable_applicability", name="view"), "id occurrence_id verdict", "SELECT c.id, occurrence_id, CASE WHEN min_arity IS NULL THEN 'unknown' WHEN arity >= min_arity AND arity <= max_arity THEN 'applicable' ELSE 'not_applicable' END AS verdict FROM candidates c JOIN occurrences o ON o.id = occurrence_id LEFT JOIN signatures s ON s.declaration_id = c.target_id WHERE name = 'view'")
for word in ("applicable", "selected"):
    step = {"applicable": "overload_selection", "selected": "member_selection"}[word]
    register(f"step_{step}", seeded("occurrences", step), f"occurrence_id candidate_count {word}_count", f"SELECT o.id AS occurrence_id, count(c.id) AS candidate_count, count(*) FILTER (WHERE c.{word}) AS {word}_count FROM occurrences o LEFT JOIN candidates c ON o.id = c.occurrence_id GROUP BY 1")
register("step_dispatch_outcome", seeded("occurrences", "dispatch_outcome"), "site_id outcome", "SELECT id AS site_id, CASE name WHEN 'view' THEN 'complete' ELSE 'unknown' END AS outcome FROM occurrences")
register("step_dispatch_targets", seeded("occurrences", {"op": "dispatch_targets", "proof": "candidate"}), "id target_id", "SELECT id, target_id FROM dispatch_targets WHERE proof = 'candidate'")
register("step_member_family", declared("function", "member_family"), "declaration_id outcome family_id", "WITH RECURSIVE r AS (SELECT id AS root, id AS here FROM declarations WHERE kind = 'function' UNION SELECT root, base_id FROM r JOIN overrides ON here = member_id), tops AS (SELECT root, here FROM r WHERE here NOT IN (SELECT member_id FROM overrides) AND (root <> here OR here IN (SELECT base_id FROM overrides))), f AS (SELECT root, sha256(string_agg(CAST(here AS STRING), chr(0) ORDER BY here)) AS family_id FROM tops GROUP BY 1) SELECT d.id AS declaration_id, CASE WHEN root IS NULL THEN 'no_family' ELSE 'proven' END AS outcome, family_id FROM declarations d LEFT JOIN f ON root = d.id WHERE kind = 'function'")
register("step_family_edges", declared("function", "family_edges", name="Brand#11"), "source_id target_id relation", "SELECT source_id, target_id, relation FROM (SELECT member_id AS source_id, base_id AS target_id, relation FROM overrides UNION ALL SELECT base_id, member_id, CASE relation WHEN 'overrides' THEN 'overridden_by' ELSE 'implemented_by' END FROM overrides) JOIN declarations d ON d.id = source_id WHERE d.name = 'Brand#11'")
register("step_edges_of", declared("function", {"op": "edges_of", "direction": "inverse", "owner_relation": "unattributed"}, name="Brand#11"), "id site_id", "SELECT e.id, site_id FROM reference_edges e JOIN declarations d ON target_id = d.id WHERE d.kind = 'function' AND d.name = 'Brand#11' AND direction = 'inverse'")
register("step_edges_from", seeded("occurrences", {"op": "edges_from", "owner_relation": ["same_owner", "unattributed"]}, "edge_target", name="click"), "id name", "SELECT DISTINCT d.id, d.name FROM reference_edges e JOIN occurrences o ON o.id = site_id JOIN declarations d ON d.id = e.target_id WHERE o.name = 'click' AND coalesce(owner_relation, 'same_owner') = 'same_owner'")

# Flow: events, relations, protocols, registered flows, rewriting.
register("step_state_events_of", declared("method", "procedure_of", {"op": "state_events_of", "event": "read", "subject_kind": "property"}), "id point", "SELECT id, point FROM state_events WHERE event = 'read' AND subject_kind = 'property'")
REACH = "SELECT id * 8 + CASE WHEN qty > 40 THEN 1 ELSE 0 END AS source, id * 8 + k AS target, id AS procedure_id FROM lines, (VALUES (2), (3)) x(k) WHERE (k = 2 OR status = 'F') AND NOT qty < 10"
register("step_flow_relations", declared("method", "procedure_of", {"op": "flow_relations_of", "relation": "reaching", "certainty": "exact"}), "source_id target_id", REACH.replace("source, ", "source_id, ").replace(" AS target,", " AS target_id,").replace(", id AS procedure_id", ""))
register("step_flow_source", declared("method", "procedure_of", {"op": "flow_relations_of", "relation": "dominates"}, "flow_source", name="A"), "id point", "SELECT e.id, e.point FROM state_events e JOIN lines ON procedure_id = lines.id WHERE flag = 'A' AND event = 'establish'")
register("step_flow_target", declared("method", "procedure_of", {"op": "state_events_of", "event": "read"}, {"op": "flow_relations_of", "relation": "reaching"}, "flow_target", name="R"), "id point", f"SELECT e.id, e.point FROM state_events e JOIN (SELECT DISTINCT target FROM ({REACH})) r ON e.id = target JOIN lines ON procedure_id = lines.id WHERE flag = 'R'")
STATES = "CASE WHEN qty > 40 THEN 'error' WHEN qty < 10 THEN 'error' ELSE 'used' END"
register("step_typestate", declared("method", "procedure_of", {"op": "typestate", "protocol": "fresh_reads"}), "procedure_id state violations", f"SELECT id AS procedure_id, {STATES} AS state, CASE WHEN qty > 40 THEN 2 ELSE 1 END + CASE WHEN status = 'F' THEN 1 ELSE 0 END - CASE WHEN qty < 10 THEN 0 ELSE 0 END AS violations FROM lines WHERE qty > 40 OR qty < 10")
register("step_witness", declared("method", "procedure_of", {"op": "typestate", "protocol": "fresh_reads"}, {"op": "witness", "max_steps": 2}), "parent_id ordinal point event_id", "SELECT CAST(lines.id AS STRING) || '#fresh_reads' AS parent_id, k AS ordinal, lines.id * 4 + k AS point, lines.id * 8 + CASE WHEN k = 0 THEN 0 WHEN qty > 40 THEN 1 ELSE 4 END AS event_id FROM lines, (VALUES (0), (1)) x(k) WHERE qty > 40 OR qty < 10")
register("step_value_flow", declared("method", "procedure_of", {"op": "value_flow", "plan": "values"}), "source_id target_id distance", "SELECT source AS source_id, target AS target_id, CASE WHEN source % 8 = 1 THEN 1 ELSE 2 END AS distance FROM (" + REACH + ")")
register("step_taint", declared("method", "procedure_of", {"op": "taint", "taint": "unclean"}), "procedure_id source_id target_id", "SELECT id AS procedure_id, id * 8 AS source_id, id * 8 + 3 AS target_id FROM lines WHERE status = 'F' AND NOT qty < 10")
register("step_rewrite_paths_of", {"files": {}, "where": ["lib?"], "steps": [{"op": "rewrite_paths_of", "outcome": ["converged", "cycle"]}]}, "path name steps outcome", "WITH RECURSIVE rules AS (SELECT r.path, src, dst FROM rewrite_rules r JOIN files f ON f.path = r.path WHERE f.path LIKE 'lib_'), r AS (SELECT path, src AS start, src AS here, [src] AS seen, CAST(NULL AS STRING) AS outcome FROM rules UNION ALL SELECT r.path, r.start, CASE WHEN u.dst IS NULL OR u.dst = r.here OR list_contains(r.seen, u.dst) THEN r.here ELSE u.dst END, CASE WHEN u.dst IS NULL OR u.dst = r.here OR list_contains(r.seen, u.dst) THEN r.seen ELSE list_append(r.seen, u.dst) END, CASE WHEN u.dst IS NULL OR u.dst = r.here THEN 'converged' WHEN list_contains(r.seen, u.dst) THEN 'cycle' END FROM r LEFT JOIN rules u ON u.path = r.path AND u.src = r.here WHERE r.outcome IS NULL AND len(r.seen) <= 9) SELECT path, CAST(start AS STRING) AS name, CAST(len(seen) - 1 AS INTEGER) AS steps, outcome FROM r WHERE outcome IS NOT NULL AND len(seen) <= 9")

# Qualified paths, generation, exports.
register("step_segments_of", seeded("paths", "segments_of"), "parent_id ordinal value", "SELECT id AS parent_id, k AS ordinal, CASE k WHEN 0 THEN brand ELSE type END AS value FROM libs, (VALUES (0), (1)) x(k)")
register("step_segment_target", {"paths": {}, "where": ["lib1?"], "steps": [{"op": "segments_of"}, {"op": "segment_target"}]}, "id name", "SELECT DISTINCT d.id, d.name FROM libs JOIN declarations d ON d.id = libs.id OR d.id = libs.id - 1 WHERE libs.path LIKE 'lib1_'")
register("step_generates", seeded("generation_sites", "generates", kind="alias_macro"), "id origin", "SELECT s.id, origin FROM declaration_states s JOIN generation_sites g ON generation_site_id = g.id WHERE g.kind = 'alias_macro'")
register("step_generated_by", declared("function", "generated_by", name="Brand#11"), "id kind", "SELECT DISTINCT g.id, g.kind FROM declaration_states s JOIN generation_sites g ON generation_site_id = g.id JOIN declarations d ON d.id = declaration_id WHERE d.name = 'Brand#11'")
register("step_declaration_state_of", declared("function", {"op": "declaration_state_of", "origin": "generated", "declaration_only": True}), "id declaration_id", "SELECT id, declaration_id FROM declaration_states WHERE origin = 'generated' AND declaration_only")
register("step_implementation_of", declared("function", {"op": "declaration_state_of", "origin": "parsed"}, "implementation_of"), "id name", "SELECT DISTINCT d.id, d.name FROM declaration_states s JOIN declarations d ON d.id = implementation_id WHERE origin = 'parsed'")
register("step_stubs_of", declared("function", "stubs_of", name="Brand#11"), "id declaration_id", "SELECT s.id, declaration_id FROM declaration_states s JOIN declarations d ON d.id = implementation_id WHERE d.name = 'Brand#11'")
register("step_export_target", seeded("exports", "export_target", form="default_named"), "id name", "SELECT DISTINCT d.id, d.name FROM exports e JOIN declarations d ON d.id = target_id WHERE form = 'default_named'")


FIRST = {"declarations": {"kind": "method", "name": "R"}, "steps": [{"op": "call_sites_from"}], "limit": 250}
# A limit is part of these two: the first rows in the order of paths, and whether there were more.
QUERIES["limit_probe"] = lambda s, d: language.run(FIRST, Workspace(s, d))[0].select("id", "path")
SQL["limit_probe"] = with_facts("SELECT id, path FROM lines WHERE flag = 'R' ORDER BY path, n, id LIMIT 250")
QUERIES["limit_truncated"] = lambda s, d: language.run(FIRST, Workspace(s, d))[1]
SQL["limit_truncated"] = with_facts("SELECT count(*) > 250 AS truncated FROM lines WHERE flag = 'R'")
