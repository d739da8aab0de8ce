"""Binding-model and scoped-role scenarios."""

from tests.helpers import facts, nodes

from arcwarden.operators.azure import azure_permission_edges, rbac_edges
from arcwarden.operators.gcp import gcp_permission_edges

BUCKET = ("gcp|p1|gcp:storage:bucket|b1", "ObjectStorage", "//storage/b1")
OTHER = ("gcp|p2|gcp:storage:bucket|b2", "ObjectStorage", "//storage/b2")
ROLE = ("role_permissions", "", "roles/r", "", {"permissions": ["storage.objects.get", "storage.objects.create"]}, "gcp", "p1")


def bind(member, target="p1", level="project", condition="", role="roles/r", project="p1"):
    return ("iam_binding", "HasBinding", member, target, {"role": role, "condition": condition, "level": level}, "gcp", project)


def gcp(spark, *rows):
    edges, extra = gcp_permission_edges(facts(spark, ROLE, *rows), nodes(spark, BUCKET, OTHER, ("gcp|p1|gcp:iam:service-account|sa@p1.iam.gserviceaccount.com", "ServiceAccount", "sa@p1.iam.gserviceaccount.com")))
    return {(r["type"], r["source"], r["target"].split("|")[-1]): r for r in edges.collect()}, {r["node_id"]: r for r in extra.collect()}


def test_project_grant_stays_in_project(spark):
    edges, extra = gcp(spark, bind("user:jo@x.org"))
    assert set(edges) == {("CanReadData", "gcp|x.org|gcp:iam:user|jo@x.org", "b1"), ("CanWriteData", "gcp|x.org|gcp:iam:user|jo@x.org", "b1")}
    assert extra["gcp|x.org|gcp:iam:user|jo@x.org"]["node_type"] == "HumanIdentity"


def test_resource_grant_and_known_account(spark):
    edges, extra = gcp(spark, bind("serviceAccount:sa@p1.iam.gserviceaccount.com", "//storage/b2", "resource"))
    assert {k[1:] for k in edges} == {("gcp|p1|gcp:iam:service-account|sa@p1.iam.gserviceaccount.com", "b2")} and not extra


def test_unconditional_beats_conditional(spark):
    one, _ = gcp(spark, bind("user:jo@x.org", condition="x"))
    assert {r["state"] for r in one.values()} == {"CONDITIONAL"}
    both, _ = gcp(spark, bind("user:jo@x.org", condition="x"), bind("user:jo@x.org", "//storage/b1", "resource"))
    assert {r["state"] for r in both.values()} == {"ACTIVE"}


def test_agents_deleted_and_unknown_roles(spark):
    edges, _ = gcp(spark, bind("serviceAccount:service-1@x.iam.gserviceaccount.com"), bind("deleted:user:a@b.c"), bind("user:jo@x.org", role="roles/none"))
    assert not edges


SUB, MG = "/subscriptions/s1", "/providers/Microsoft.Management/managementGroups/"
VAULT = ("azure|s1|azure:keyvault:vault|/subscriptions/s1/resourceGroups/rg/providers/Microsoft.KeyVault/vaults/v", "Secret", "/subscriptions/s1/resourceGroups/rg/providers/Microsoft.KeyVault/vaults/v")
STORE = ("azure|s1|azure:storage:account|/subscriptions/s1/resourceGroups/rg2/st", "ObjectStorage", "/subscriptions/s1/resourceGroups/rg2/st", {"properties": {"allowBlobPublicAccess": True}})
FAR = ("azure|s2|azure:keyvault:vault|/subscriptions/s2/resourceGroups/rg/v", "Secret", "/subscriptions/s2/resourceGroups/rg/v")
READER = ("role_definition", "", "/x/roleDefinitions/R1", "", {"actions": [], "notActions": [], "dataActions": ["Microsoft.KeyVault/vaults/secrets/*"], "notDataActions": ["*/readMetadata/action"]}, "azure")
OWNER = ("role_definition", "", "/x/roleDefinitions/own", "", {"actions": ["*"], "notActions": [], "dataActions": [], "notDataActions": []}, "azure")


def assign(who, scope, role="R1", condition=""):
    return ("role_assignment", "", who, scope, {"roleDefinitionId": f"/x/roleDefinitions/{role}", "condition": condition}, "azure")


def azure(spark, *rows):
    edges, extra = azure_permission_edges(facts(spark, READER, OWNER, *rows), nodes(spark, VAULT, STORE, FAR))
    short = lambda x: x.split("|")[-1].split("/")[-1]
    return {(r["type"], short(r["source"]), short(r["target"])): r for r in edges.collect()}, {r["node_id"] for r in extra.collect()}


def test_scope_and_data_plane(spark):
    edges, extra = azure(spark, assign("u1", "/subscriptions/S1/resourceGroups/RG"))
    assert edges["CanReadSecret", "u1", "v"]["target"] == VAULT[0] and edges["CanReadSecret", "u1", "v"]["permissions"] == ["Microsoft.KeyVault/vaults/secrets/getSecret/action"]
    assert "azure|entra|azure:entra:serviceprincipal|u1" in extra
    assert not [k for k in azure(spark, assign("u1", "/subscriptions/s1/resourceGroups/rg2"))[0] if k[0] == "CanReadSecret"]


def test_owner_of_group_stays_there(spark):
    edges, _ = azure(spark, assign("u1", "/subscriptions/s1/resourceGroups/rg", "own"))
    assert ("CanGrantPermission", "u1", "rg") in edges and ("CanGrantPermission", "u1", "s1") not in edges
    assert edges["CanControl", "u1", "v"]["nature"] == "derived" and ("CanControl", "u1", "st") not in edges


def test_management_groups(spark):
    tree = [("mg_hierarchy", "", "top", "mid", {"childType": "managementGroup"}, "azure"), ("mg_hierarchy", "", "mid", "top", {"childType": "managementGroup"}, "azure"), ("mg_hierarchy", "", "mid", "s1", {"childType": "subscription"}, "azure")]
    edges, _ = azure(spark, *tree, assign("u1", MG + "top"))
    assert {r["target"] for k, r in edges.items() if k[0] == "CanReadSecret"} == {VAULT[0]}
    owner, _ = azure(spark, *tree, assign("u1", MG + "top", "own"))
    assert owner["CanGrantPermission", "u1", "s1"]["target"].endswith("|/subscriptions/s1") and ("CanGrantPermission", "u1", "s2") not in owner


def test_deny_group_and_condition(spark):
    deny = ("deny_assignment", "", "u1", SUB, {"actions": ["Microsoft.KeyVault/*"], "notActions": []}, "azure")
    assert ("CanReadSecret", "u1", "v") not in azure(spark, assign("u1", SUB), deny)[0]
    member = ("member_of", "", "u2", "g1", {}, "azure")
    edges, _ = azure(spark, assign("g1", SUB, condition="x"), member)
    assert edges["CanReadSecret", "u2", "v"]["state"] == "CONDITIONAL"
    assert azure(spark, assign("g1", SUB, condition="x"), assign("u2", SUB), member)[0]["CanReadSecret", "u2", "v"]["state"] == "ACTIVE"


def test_directory(spark):
    admin = "62e90394-69f5-4237-9190-012177145e10"
    rows = [("entra_role_eligible", "", "g1", "", {"roleTemplateId": admin}, "azure"), ("entra_group_owner", "", "u3", "g1", {}, "azure"), ("principal", "", "u3", "", {"displayName": "Lee", "type": "User"}, "azure"), ("principal", "", "g1", "", {"displayName": "Ops", "type": "Group"}, "azure"),
            ("entra_owner", "", "u3", "sp1", {}, "azure")]
    edges, extra = azure(spark, *rows)
    assert edges["CanControl", "u3", "tenant"]["state"] == "CONDITIONAL" and edges["CanAddMember", "u3", "g1"]["state"] == "ACTIVE" and ("CanCreateCredentialFor", "u3", "sp1") in edges
    assert "azure|entra|azure:entra:user|u3" in extra


def test_exposure(spark):
    assert "medium" in azure(spark)[0]["ExposedToInternet", "st", "Anonymous"]["evidence"]
    public = ("public_container", "", STORE[2], "", {"container": "c"}, "azure")
    assert "critical" in azure(spark, public)[0]["ExposedToInternet", "st", "Anonymous"]["evidence"]


def written_out_last(edges, members):
    """No grouping and no shuffle of the edges once they are written out for their members."""
    plan = edges._jdf.queryExecution().executedPlan().toString()
    return "HashAggregate" not in plan and "SortAggregate" not in plan and members in plan


def test_scoped_roles_are_written_out_last(spark):
    """Settled by class of resources, before they are written out; denials take some resources away, a resource met twice counts once."""
    deny = ("deny_assignment", "", "u1", "/subscriptions/s1/resourceGroups/rg", {"actions": ["Microsoft.KeyVault/*"], "notActions": []}, "azure")
    vaults = [(f"azure|s1|azure:keyvault:vault|{SUB}/resourceGroups/{g}/vault/v{k}", "Secret", f"{SUB}/resourceGroups/{g}/vault/v{k}") for g in ("rg", "rg2") for k in range(3)]
    given = facts(spark, READER, assign("u1", SUB), assign("u2", SUB, condition="x"), assign("u2", f"{SUB}/resourceGroups/rg2"), deny)
    people = spark.createDataFrame([("u1", "p1"), ("u2", "p2")], "principal string, source string")
    edges = rbac_edges(given, nodes(spark, *vaults, vaults[0]), spark.createDataFrame([], "mg string, subscription string"), people)
    assert written_out_last(edges, "BroadcastHashJoin")
    got = [(r["source"], r["target"].split("/")[4], r["target"][-2:], r["state"]) for r in edges.where("type = 'CanReadSecret'").collect()]
    assert sorted(got) == sorted([("p1", "rg2", f"v{k}", "ACTIVE") for k in range(3)] + [("p2", g, f"v{k}", s) for g, s in (("rg", "CONDITIONAL"), ("rg2", "ACTIVE")) for k in range(3)])


def test_project_grants_are_written_out_last(spark):
    """What only a project's grant gives is settled by class; a resource's own grant meets only its own edges."""
    buckets = [(f"gcp|p1|gcp:storage:bucket|b{k}", "ObjectStorage", f"//storage/b{k}") for k in range(4)]
    edges, _ = gcp_permission_edges(facts(spark, ROLE, bind("user:jo@x.org"), bind("user:al@x.org", condition="x")), nodes(spark, *buckets, buckets[0]))
    assert written_out_last(edges, "BroadcastHashJoin") and edges.count() == 2 * 2 * 4
    given = facts(spark, ROLE, bind("user:jo@x.org", condition="x"), bind("user:jo@x.org", "//storage/b1", "resource"), bind("user:al@x.org", "//storage/b2", "resource", condition="x"))
    own, _ = gcp_permission_edges(given, nodes(spark, *buckets))
    got = sorted((r["type"][3:7], r["source"][-8:-6], r["target"][-2:], r["state"]) for r in own.collect())
    assert got == sorted((t, who, b, s) for t in ("Read", "Writ") for who, b, s in [("jo", f"b{k}", "ACTIVE" if k == 1 else "CONDITIONAL") for k in range(4)] + [("al", "b2", "CONDITIONAL")])
