"""Column functions over identifiers, arns, scopes and values; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcwarden.catalog import IDENTITY_TYPES

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed, and standing in the expression, only once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(x: C) -> Column:
    """The value as a string, empty for null."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def blank(x: C) -> Column:
    return text(x) == ""


# Identity keys


def node_id(provider: C, account: C, resource_type: C, native_id: C) -> Column:
    return F.concat_ws("|", *[text(x) for x in (provider, account, resource_type, native_id)])


def edge_id(type_: C, source: C, target: C, scope: C) -> Column:
    return F.concat(F.lit("e_"), F.substring(F.sha2(F.concat_ws("|", *[text(x) for x in (type_, source, target, scope)]), 256), 1, 16))


def fact_id(provider: C, kind: C, source: C, target: C, edge_hint: C, account: C) -> Column:
    return F.concat(F.lit("fact-"), F.substring(F.sha2(F.concat_ws("|", *[text(x) for x in (provider, kind, source, target, edge_hint, account)]), 256), 1, 12))


# Parts of identifiers


def account_of(arn: C) -> Column:
    """Fifth field of an arn of at least five, a bare account number itself, else empty."""
    a = text(arn)
    fields = F.split(a, ":", 6)
    return F.when(a.startswith("arn:"), F.coalesce(F.get(fields, F.lit(4)), F.lit(""))).when(a.rlike("^[0-9]{12}$"), a).otherwise(F.lit(""))


def node_account(id_: C) -> Column:
    return F.split_part(text(id_), F.lit("|"), F.lit(2))


def native_of(id_: C) -> Column:
    return F.substring_index(text(id_), "|", -1)


def last_seg(name: C, trim: bool = False) -> Column:
    """What follows the last slash; ``trim`` drops one slash at the end first."""
    n = text(name)
    return F.substring_index(F.regexp_replace(n, "/$", "") if trim else n, "/", -1)


def node_short(id_: C) -> Column:
    """A compact label: after the last bar, then slash, then colon (unless it starts with ``service``)."""
    s = F.substring_index(F.substring_index(text(id_), "|", -1), "/", -1)
    return F.when(s.startswith("service"), s).otherwise(F.substring_index(s, ":", -1))


def service_of_resource(id_: C, arn: C) -> Column:
    """Second colon part of the id's third field, else the arn's third part."""
    kind = F.split_part(text(id_), F.lit("|"), F.lit(3))
    return F.when(F.instr(kind, ":") > 0, F.split_part(kind, F.lit(":"), F.lit(2))).otherwise(F.split_part(text(arn), F.lit(":"), F.lit(3)))


def json_text(bag: C, key: str) -> Column:
    """A top-level string of a JSON bag; the key may hold dots."""
    return F.get_json_object(col(bag), f"$['{key}']")


def label(id_: C, bag: C) -> Column:
    """Alias (without its prefix), else display name, else the id's last segment."""
    alias = F.regexp_replace(json_text(bag, "alias"), "^alias/", "")
    return F.coalesce(F.nullif(alias, F.lit("")), F.nullif(json_text(bag, "displayName"), F.lit("")), node_short(id_))


def kind_of(id_: C, node_type: C) -> Column:
    kind = F.split_part(text(id_), F.lit("|"), F.lit(3))
    return F.when(F.instr(kind, ":") > 0, kind).otherwise(text(node_type))


def cluster_of(id_: C, node_type: C) -> Column:
    """Service bucket of a node: the id's kind, an arn in its second field, a name's prefix, or the node's type."""
    fields, t = F.split(text(id_), r"\|"), text(node_type)
    kind, name = F.coalesce(F.get(fields, F.lit(2)), F.lit("")), F.lower(F.coalesce(F.get(fields, F.lit(1)), F.lit("")))
    service = F.split_part(F.get(fields, F.lit(1)), F.lit(":"), F.lit(3))
    return (
        F.when(F.contains(kind, F.lit(":")), F.coalesce(F.nullif(F.split_part(kind, F.lit(":"), F.lit(2)), F.lit("")), F.lit("other")))
        .when(F.get(fields, F.lit(1)).startswith("arn:") & (service != ""), service)
        .when((t == "SecurityGroup") | name.rlike("^(sg|rtb|igw|subnet|vpc|acl|eni|nat|eipalloc)-"), F.lit("ec2"))
        .when((t == "CIDR") | F.contains(name, F.lit("/")) | name.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), F.lit("network"))
        .when((t == "Service") | name.startswith("service:"), F.lit("service-principal"))
        .when(t.isin(*IDENTITY_TYPES, "Everyone"), F.lit("iam"))
        .when(t == "", F.lit("other"))
        .otherwise(F.lower(t))
    )


# Node types of the sensitive and the compute class.
SENSITIVE_TYPES = ("ObjectStorage", "NoSQLDatabase", "RelationalDatabase", "Secret", "EncryptionKey", "SigningKey", "Queue", "Topic", "DataWarehouse", "Dataset", "Cache", "FileStorage", "BlockStorage")
COMPUTE_TYPES = ("ServerlessFunction", "VirtualMachine", "Compute", "ContainerService", "ContainerCluster", "ContainerRegistry", "KubernetesCluster", "BuildWorker", "BatchJob")


def node_class(node_type: C) -> Column:
    t = text(node_type)
    return F.when(t.isin(*IDENTITY_TYPES, "Everyone"), F.lit("identity")).when(t.isin(*SENSITIVE_TYPES), F.lit("sensitive")).when(t.isin(*COMPUTE_TYPES), F.lit("compute")).otherwise(F.lit("env"))


def is_admin(id_: C, arn: C) -> Column:
    s = F.regexp_replace(F.lower(F.concat(text(arn), text(id_))), r"\s", "")
    return F.contains(s, F.lit("admin")) | F.contains(s, F.lit("/root")) | s.endswith(":root")


def norm_identity(name: C) -> Column:
    """Lower case, before the at sign, separators as one space."""
    return F.trim(F.regexp_replace(F.substring_index(F.lower(text(name)), "@", 1), r"[\s._\-/\\]+", " "))


def endpoint_type(ref: C) -> Column:
    r = text(ref)
    return F.when(F.contains(r, F.lit("/")), F.lit("CIDR")).when(r.startswith("sg-"), F.lit("SecurityGroup")).when(r.startswith("vpc-"), F.lit("VirtualNetwork")).otherwise(F.lit("Unknown"))


# Azure and GCP identifiers


def sub_of(scope: C) -> Column:
    """Subscription id of a scope, lower case, or empty."""
    return F.lower(F.regexp_extract(text(scope), r"(?i)^/?subscriptions/([^/]+)", 1))


def rg_scope_of(id_: C) -> Column:
    """Resource-group prefix of an id, or empty."""
    return F.regexp_extract(text(id_), r"(?i)^(/subscriptions/[^/]+/resourceGroups/[^/]+)", 1)


def role_def_key(role: C) -> Column:
    """Tail of a role definition's id, lower case."""
    return F.lower(F.substring_index(text(role), "/", -1))


def scope_contains(scope: C, id_: C) -> Column:
    """Whether an Azure scope covers an id."""
    s, i = F.lower(F.regexp_replace(text(scope), "/+$", "")), F.lower(text(id_))
    group = F.lower(text(scope)).startswith("/providers/microsoft.management/managementgroups/")
    return F.when(blank(scope), F.lit(False)).when(text(scope) == "/", F.lit(True)).when(group, F.lit(True)).otherwise((i == s) | F.startswith(i, F.concat(s, F.lit("/"))))


def split_member(member: C) -> Column:
    """``struct<kind, value>`` of a GCP member; null for deleted ones."""
    m = text(member)
    whole = F.struct(m.alias("kind"), F.lit("").alias("value"))
    parts = F.struct(F.substring_index(m, ":", 1).alias("kind"), F.expr("''").alias("value")).withField("value", F.regexp_replace(m, "^[^:]*:", ""))
    return F.when(m.startswith("deleted"), F.lit(None)).when(m.isin("allUsers", "allAuthenticatedUsers"), whole).when(F.contains(m, F.lit(":")), parts)


def identity_realm(kind: C, value: C) -> Column:
    """Home of a GCP identity: project, mail domain, domain, public or external."""
    k, v = text(kind), text(value)
    project = F.regexp_extract(v, r"@([^.@]+)\.iam\.gserviceaccount\.com$", 1)
    domain = F.when(F.contains(v, F.lit("@")), F.substring_index(v, "@", -1)).otherwise(F.lit("external"))
    return (
        F.when(k == "serviceAccount", F.when(project != "", project).otherwise(F.lit("external")))
        .when(k.isin("user", "group"), domain)
        .when(k == "domain", v)
        .when(k.isin("allUsers", "allAuthenticatedUsers"), F.lit("public"))
        .otherwise(F.lit("external"))
    )


def is_provider_managed(member: C) -> Column:
    """Whether a member is an agent of the provider itself."""
    m = F.lower(text(member))
    return m.rlike(r"@cloudservices\.gserviceaccount\.com$") | m.rlike(r"@gcp-sa-[^.@]+\.iam\.gserviceaccount\.com$") | m.rlike(r"(^|:)service-[0-9]+@")


def norm_type(name: C) -> Column:
    """After the last colon, lower case, letters and digits only, one plural s less."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(text(name), ":", -1)), "[^a-z0-9]", ""), "s$", "")


def map_node_type(node_type: C) -> Column:
    return F.when(text(node_type) == "Everyone", F.lit("AnonymousIdentity")).otherwise(col(node_type))


def map_nature(nature: C) -> Column:
    return F.when(text(nature) == "derived", F.lit("derived")).otherwise(F.lit("explicit"))


# Patterns


#: Stand for a literal ``*`` and ``?`` inside a pattern (private code points, which identifiers don't hold).
LITERAL_STAR, LITERAL_MARK = "\ue000", "\ue001"


def _escaped(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"([\\\.\[\]\{\}\(\)\+\^\$\|])", r"\\$1")


def _literal(pattern: Column) -> Column:
    return F.translate(pattern, LITERAL_STAR + LITERAL_MARK, "*?")


def glob_class(pattern: C) -> Column:
    """``all``, ``exact``, ``prefix``, ``suffix`` or ``general``: most patterns need no regular expression."""
    p = text(pattern)
    inner = lambda x: x.rlike(r"[*?]")
    return (
        F.when(p.rlike(r"^\*+$"), F.lit("all"))
        .when(~inner(p), F.lit("exact"))
        .when(p.endswith("*") & ~inner(F.regexp_replace(p, r"\*$", "")), F.lit("prefix"))
        .when(p.startswith("*") & ~inner(F.regexp_replace(p, r"^\*", "")), F.lit("suffix"))
        .otherwise(F.lit("general"))
    )


def glob_match(pattern: C, subject: C, fold: bool = False) -> Column:
    """Whole-string match: ``*`` any run, ``?`` one character; signs that ``expand_policy_vars`` made literal stand for themselves."""
    p, s = text(pattern), text(subject)
    if fold:
        p, s = F.lower(p), F.lower(s)
    open_ = F.regexp_replace(F.regexp_replace(_escaped(p), r"\?", "."), r"\*+", ".*")
    regex = F.concat(F.lit("(?s)^"), F.replace(F.replace(open_, F.lit(LITERAL_STAR), F.lit(r"\*")), F.lit(LITERAL_MARK), F.lit(r"\?")), F.lit("$"))
    kind = glob_class(p)
    return (
        F.when(kind == "all", F.lit(True))
        .when(kind == "exact", _literal(p) == s)
        .when(kind == "prefix", F.startswith(s, _literal(F.regexp_replace(p, r"\*$", ""))))
        .when(kind == "suffix", F.endswith(s, _literal(F.regexp_replace(p, r"^\*", ""))))
        .otherwise(F.regexp_like(s, regex))
    )


def azure_wildcard_match(pattern: C, action: C) -> Column:
    """Case-folded, ``*`` crosses slashes, no ``?``; an inner ``/*/`` may also stand for nothing."""
    p, s = F.lower(text(pattern)), F.lower(text(action))

    def one(q: Column) -> Column:
        regex = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(_escaped(q), r"\?", r"\\?"), r"\*+", ".*"), F.lit("$"))
        return F.when(q == "*", F.lit(True)).when(~F.contains(q, F.lit("*")), q == s).otherwise(F.regexp_like(s, regex))

    return one(p) | one(F.replace(p, F.lit("/*/"), F.lit("/")))


def expand_policy_vars(pattern: C, context: dict[str, Column]) -> Column:
    """``${name}`` replaced from the context (names without case); unknown names leave a pattern that nothing matches.

    ``${*}`` and ``${?}`` become signs that ``glob_match`` takes literally.
    """
    p = text(pattern)
    for name, value in context.items():
        p = F.regexp_replace(p, F.lit(r"(?i)\$\{" + name.replace(".", r"\.") + r"\}"), F.regexp_replace(text(value), r"([\\$])", r"\\$1"))
    known = F.regexp_replace(p, r"\$\{[*?$]\}", "")
    literal = F.replace(F.replace(F.replace(p, F.lit("${*}"), F.lit(LITERAL_STAR)), F.lit("${?}"), F.lit(LITERAL_MARK)), F.lit("${$}"), F.lit("$"))
    return F.when(F.contains(known, F.lit("${")), F.lit(None).cast("string")).otherwise(literal)


# Values


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def ipv4_number(ip: C) -> Column:
    """An IPv4 address as a long, null if it is none."""
    number = lambda s: F.aggregate(F.split(s, r"\."), F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
    return let(text(ip), lambda s: F.when(s.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), number(s)))


def ipv6_groups(ip: C) -> Column:
    """The eight 16-bit groups of an IPv6 address, null if it is none; one ``::`` stands for the missing groups."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")

    def expand(raw: Column) -> Column:
        halves = F.struct(groups(F.substring_index(raw, "::", 1)).alias("l"), groups(F.when(F.contains(raw, F.lit("::")), F.substring_index(raw, "::", -1)).otherwise(F.lit(""))).alias("r"), F.contains(raw, F.lit("::")).alias("open"))
        full = let(halves, lambda h: F.concat(h["l"], F.array_repeat(F.lit("0"), F.when(h["open"], 8 - F.size(h["l"]) - F.size(h["r"])).otherwise(F.lit(0))), h["r"]))
        valid = raw.rlike("^[0-9a-f:]+$") & F.contains(raw, F.lit(":")) & ~F.contains(raw, F.lit(":::")) & (F.size(F.split(raw, "::")) <= 2)
        return F.when(valid, let(full, lambda f: F.when((F.size(f) == 8) & F.forall(f, lambda x: F.length(x) <= 4), F.transform(f, lambda x: F.conv(x, 16, 10).cast("int")))))

    return let(F.lower(text(ip)), expand)


def ip_in_cidr(ip: C, pattern: C) -> Column:
    """Whether an address lies in a network, or equals an address; false if either can't be read."""

    def network(p: Column) -> Column:
        slash = F.contains(p, F.lit("/"))
        return F.struct(F.substring_index(p, "/", 1).alias("base"), F.when(slash, F.substring_index(p, "/", -1).try_cast("int")).alias("bits"), slash.alias("slash"))

    def v4(n: Column) -> Column:
        return let(F.struct(ipv4_number(ip).alias("h"), ipv4_number(n["base"]).alias("b"), F.coalesce(n["bits"], F.lit(32)).alias("w")), lambda s: F.when(s["h"].isNotNull() & s["b"].isNotNull(), s["w"].between(0, 32) & (F.floor(s["h"] / F.pow(F.lit(2.0), 32 - s["w"])) == F.floor(s["b"] / F.pow(F.lit(2.0), 32 - s["w"])))))

    def v6(n: Column) -> Column:
        width = F.coalesce(n["bits"], F.lit(128))
        unit = lambda k: F.pow(F.lit(2.0), 16 - F.greatest(F.lit(0), F.least(F.lit(16), width - 16 * k)))
        pairs = F.arrays_zip(ipv6_groups(ip).alias("a"), ipv6_groups(n["base"]).alias("b"))
        same = F.transform(pairs, lambda x, k: F.floor(x.getField("a") / unit(k)) == F.floor(x.getField("b") / unit(k)))
        return width.between(0, 128) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))

    return let(network(text(pattern)), lambda n: ~(n["slash"] & n["bits"].isNull()) & F.coalesce(v4(n), v6(n), F.lit(False)))


def parse_condition_date(value: C) -> Column:
    """RFC 3339, else seconds since 1970, else null."""
    v = text(value)
    return F.coalesce(F.when(v.rlike(r"^\d{4}-\d\d-\d\d[Tt]"), F.try_to_timestamp(v)), F.timestamp_seconds(v.try_cast("double")))


def shannon_entropy(value: C) -> Column:
    """Bits per byte."""
    hexed = F.hex(F.encode(text(value), "UTF-8"))
    units = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(text(value)) - 1, F.lit(0))), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)))
    n = F.octet_length(text(value)).cast("double")
    counts = F.transform(F.array_distinct(units), lambda u: F.size(F.filter(units, lambda x: x == u)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


# Parts of locations whose values are base64.
BASE64_HINTS = ("userdata", "consoleoutput", "getconsoleoutput", "payload.data", "privatekeydata", "publickeydata", "pubsubmessage.data", "decrypt.plaintext", "customdata")


def b64_text(value: C, location: C) -> Column:
    """The decoded value where the location hints at base64 and the bytes are UTF-8, else the value."""
    hinted = F.regexp_like(F.lower(text(location)), F.lit("|".join(h.replace(".", r"\.") for h in BASE64_HINTS)))
    decoded = F.try_validate_utf8(F.try_to_binary(text(value), F.lit("base64")).cast("string"))
    return F.when(hinted, F.coalesce(decoded, text(value))).otherwise(text(value))


def preview(value: C, n: int) -> Column:
    s = F.trim(F.regexp_replace(text(value), r"\s+", " "))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)
