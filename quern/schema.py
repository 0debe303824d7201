"""Closed vocabularies, the kind hierarchy and the row domains; literals are checked against them before anything runs."""

from __future__ import annotations

VOCABULARIES: dict[str, tuple[str, ...]] = {
    "tier": ("lexical_binding", "own_member", "inherited_member", "explicit_import", "package_or_module", "wildcard_import", "external_root", "name_only_fallback"),
    "rejection": ("shadowed_by_nearer", "not_in_scope_at_position", "wrong_namespace", "not_visible", "wrong_declaration_space", "ambiguous_peer", "boundary_blocked", "hidden_by_closer_member", "callable_applicability_deferred"),
    "member_tier": ("inherent_or_direct", "inherited_or_promoted", "trait_or_interface", "extension", "static_or_companion", "dynamic_or_open"),
    "hierarchy_relation": ("extends", "implements", "supertype", "embedded", "trait_impl"),
    "family_relation": ("overrides", "implements", "overridden_by", "implemented_by"),
    "family_outcome": ("proven", "no_family", "incomplete", "unsupported"),
    "boundary": ("workspace_local", "external_indexed", "external_declared_unindexed", "external_unknown"),
    "visibility": ("public", "protected", "internal", "package_private", "private", "crate_or_module", "unknown"),
    "hoisting": ("source_order", "scope_wide", "declared_head"),
    "binding_kind": ("local", "parameter", "pattern_binder", "loop_variable", "catch_or_resource", "import_binder", "type_parameter"),
    "namespace": ("type", "value", "module", "macro", "label"),
    "edge_direction": ("forward", "inverse"),
    "owner_relation": ("same_owner", "inherited_owner", "self_reference", "external", "unknown"),
    "site_class": ("use_site", "declaration_site"),
    "state_event": ("establish", "kill", "read"),
    "subject": ("binding", "property"),
    "flow_relation": ("reaching", "dominates", "same_evaluation"),
    "certainty": ("exact", "may"),
    "origin": ("parsed", "generated", "recovered"),
    "generation_kind": ("accessor_macro", "alias_macro", "preprocessor_definition"),
    "generation_input": ("literal", "dynamic"),
    "export_form": ("named", "default_named", "default_anonymous", "common_js_root", "common_js_member"),
    "rewrite_outcome": ("converged", "cycle", "exceeded_budget"),
    "control_edge": ("normal", "conditional_true", "conditional_false", "switch_case", "loop_back", "exceptional", "cleanup", "async_normal", "async_exceptional"),
}
#: role: class of an occurrence.
ROLE_CLASS = {"declaration_name": "declaration", "binder": "binder"} | dict.fromkeys(("label_or_key", "import_alias", "generated_source"), "non_reference") | dict.fromkeys(("type_operand", "path_segment", "import_target", "receiver_position", "member_position", "pattern_position", "value_reference"), "reference")
VOCABULARIES |= {"role": tuple(ROLE_CLASS), "role_class": tuple(dict.fromkeys(ROLE_CLASS.values()))}

#: kind: its parent.
KIND_PARENT = dict.fromkeys(("callable", "class", "import"), "declaration") | dict.fromkeys(("function", "method", "constructor", "lambda"), "callable") | dict.fromkeys(("string_literal", "numeric_literal", "boolean_literal", "null_literal"), "literal") | dict.fromkeys(("for_loop", "while_loop"), "loop")

DOMAINS = (
    "match declaration file reference_site occurrence call_site expression_site receiver_analysis receiver_outcome receiver_evidence member_selection overload_selection "
    "callable_applicability dispatch_outcome dispatch_target member_family member_family_edge call_shape call_argument_group call_argument call_binding call_effect procedure_effect "
    "callable_signature signature_parameter lexical_scope binding resolution_candidate candidate_hop generation_site export declaration_state reference_edge state_event flow_relation "
    "rewrite_path qualified_path path_segment procedure program_point control_edge typestate_finding typestate_witness flow_endpoint flow_witness taint_finding"
).split()


class PlanError(ValueError):
    """A query or plan that is refused before it runs; `path` says where."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}" if path else message)
        self.path = path


def kinds_below(kind: str, parents: dict[str, str] = KIND_PARENT) -> list[str]:
    """The kind and everything under it, so that a subtype-aware test is a plain IN."""
    found, todo = [], [kind]
    while todo:
        k = todo.pop(0)
        found.append(k)
        todo += sorted(c for c, p in parents.items() if p == k)
    return found


def checked(vocabulary: str, values, path: str = "") -> list[str]:
    values = [values] if isinstance(values, str) else list(values)
    for v in values:
        if v not in VOCABULARIES[vocabulary]:
            raise PlanError(path, f"{v!r} is not a {vocabulary}")
    return values
