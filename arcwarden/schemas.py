"""Explicit schemas of all records; JSON bags stay JSON text until an operator opens them as VARIANT."""

from __future__ import annotations

SCOPE = "struct<provider:string,account:string,region:string,global:boolean>"

ARTIFACT = f"provider string, account string, scope {SCOPE}, resource_type string, node_type string, native_id string, arn string, attributes string, tags map<string,string>, collected_by array<string>, captured_at timestamp, evidence_ref string"
FACT = f"kind string, edge_hint string, provider string, scope {SCOPE}, source string, target string, attributes string, captured_at timestamp"
FINDING = f"site_id string, resource_id string, provider string, scope {SCOPE}, emits_hint string, severity string, location string, found boolean, value_ref string"
SURFACE = "site_id string, resource_id string, access_mode string, location string, emits_hint string, severity string"
LEDGER = f"task_id string, scope {SCOPE}, resource_type string, operation string, status string, reason string, count long, started_at timestamp, ended_at timestamp"
MANIFEST = f"provider string, account string, caller_arn string, scopes array<struct<provider:string,account:string,caller_arn:string,status:string>>, summary map<string,long>, integrity_ok boolean"
NODE = f"node_id string, node_type string, provider string, account string, arn string, scope {SCOPE}, attributes string"
EDGE = (
    "edge_id string, type string, source string, target string, category string, relationship_kind string, nature string, provider string, state string, confidence double, weight double, scope string, "
    "permissions array<string>, conditions array<string>, derived_from array<string>, facts array<string>, rule_id string, evidence string, narrative string, first_seen timestamp"
)
PATH = "path_id string, source string, target string, edge_ids array<string>, score double, narrative string"

ACTIVE, CONDITIONAL, POTENTIAL, BLOCKED, UNKNOWN = "ACTIVE", "CONDITIONAL", "POTENTIAL", "BLOCKED", "UNKNOWN"
EXPLICIT, DERIVED = "explicit", "derived"
#: Three-valued conditions, combined by their greatest value.
TRUE, UNRESOLVED, FALSE = 0, 1, 2
