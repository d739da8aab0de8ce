"""Merkle manifest of a dataset: a tree of hashes for each source, one over the sources, and every row's proof.

A row is a leaf, the hash of its encoded columns. The leaves of a source are numbered by ``doc_id``, and every ``fan``
consecutive nodes are a run. Inside a window of one run, lag and lead columns at the fixed offsets below ``fan`` give each
node its siblings, masked by its slot and by the run's length, and the run's first child hashes the parent. A level is a
stored narrow table; its parents are the next level, a ``fan``-th of it. The roots of the sources are the leaves of one more
such tree.

Then paths go down: a node's path is its own siblings followed by its parent's path, joined by run, so a level moves a path
for each run rather than for each node, and the windows' partitions are those of the join. A path proves a leaf: folded from
the leaf up, it gives the root.

No window holds more than ``fan`` rows but those that number rows, which are cut by ranges of all rows, so that a large
source spreads over many tasks. The rows before a range are counted per (source, range) and summed in a window.

Edge cases: a null column is encoded as ``-``, so null and empty differ; a null source is a source of its own, the first;
rows of one ``doc_id`` follow each other by their leaf, a null ``doc_id`` comes first; repeated rows are leaves of their own.
A source with one row has this leaf as its root, and a proof without siblings is the hash of nothing. An empty table gives
no rows. Columns beyond ``doc_id, source, lang, n_chars, text`` aren't hashed or returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwarden.llm.common import maybe_broadcast, stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SOURCE_ROOT = "'r'"


@dataclass(frozen=True)
class MerkleConfig:
    #: Children of a node.
    fan: int = 16
    fields: tuple[str, ...] = FIELDS


def encoded(value: Column) -> Column:
    """UTF-8 byte count, ``:`` and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(config: MerkleConfig, **changed: Column) -> Column:
    """A row's leaf; ``changed`` columns stand for those of their names."""
    return digest(*(encoded(changed.get(name, F.col(name))) for name in config.fields))


def source_key(source: Column) -> Column:
    """A text that orders like the source bytewise, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (stored, with ``tree``) with ``pos``, from 0 in their tree in the order given, and ``n``, their number."""
    ranged = stored(nodes.repartitionByRange("tree", *order).withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy("tree", "_range").agg(F.count("*").alias("_m"))
    whole, above = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("tree", "_range", F.coalesce(F.sum("_m").over(above), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("n")), "merkle-offsets")
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range", "tree").orderBy(*order)))
    return own.join(maybe_broadcast(offsets), ["tree", "_range"]).withColumn("pos", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_range", "_own", "_before")


def with_siblings(level: DataFrame, fan: int) -> DataFrame:
    """Nodes of trees that go on, with ``run``, ``slot``, and the hashes ``left`` and ``right`` of them in their run."""
    run, slot = F.floor(F.col("pos") / fan).cast("long"), (F.col("pos") % fan).cast("int")
    nodes = level.where("n > 1").withColumn("run", run).withColumn("slot", slot).withColumn("_in_run", F.least(F.lit(fan).cast("long"), F.col("n") - F.col("run") * fan))
    window = Window.partitionBy("tree", "run").orderBy("slot")
    before = [F.when(F.col("slot") >= k, F.lag("hash", k).over(window)).otherwise(F.lit("")) for k in range(fan - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < F.col("_in_run"), F.lead("hash", k).over(window)).otherwise(F.lit("")) for k in range(1, fan)]
    return nodes.select("*", F.concat(*before).alias("left"), F.concat(*after).alias("right")).drop("_in_run")


def levels_of(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """The levels of all trees from the leaves up: ``(tree, pos, n, hash)``; a tree's last level is its root, where ``n`` is 1."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves.select("tree", "pos", "n", "hash")]
    while most > 1:
        first = with_siblings(levels[-1], fan).where("slot = 0")
        parents = first.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / fan).cast("long").alias("n"), digest(F.col("hash"), F.col("right")).alias("hash"))
        levels.append(stored(parents, "merkle-level"))
        most = -(-most // fan)
    return levels


def with_paths(levels: list[DataFrame], leaves: DataFrame, roots: DataFrame, fan: int) -> DataFrame:
    """``leaves`` with their tree's columns of ``roots(tree, path, ...)``, and with a ``path`` of ``(left, right)`` up through that of the root.

    Level by level from the top: nodes that are roots get theirs, the others their run's parent's, which the level above has.
    """
    more = [c for c in roots.columns if c != "tree"]
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = leaves if k == 0 else levels[k]
        keep = [c for c in nodes.columns if c not in ("n", *more)]
        found = nodes.where("n = 1").join(maybe_broadcast(roots), "tree").select(*keep, *more)
        if above is not None:
            parents = above.select("tree", F.col("pos").alias("run"), *more)
            # no broadcast, whatever the sizes: the windows have dealt the nodes by these keys already
            climbed = with_siblings(nodes, fan).join(parents.hint("merge"), ["tree", "run"])
            path = F.concat(F.array(F.struct("left", "right")), "path").alias("path")
            found = found.unionByName(climbed.select(*keep, *(path if c == "path" else F.col(c) for c in more)))
        above = stored(found, "merkle-paths") if k else found
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda own, step: digest(step["left"], own, step["right"]))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, from the leaf's up, each run's from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(docs: DataFrame, config: MerkleConfig = MerkleConfig(), **more: Column) -> DataFrame:
    """``(doc_id, leaf, subroot, root, path)`` for every row of ``docs``, and the columns ``more`` computed from it."""
    own = list(more)
    named = {f"_more{k}": more[name] for k, name in enumerate(own)}
    leaves = stored(docs.select(source_key(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(config).alias("hash"), *(c.alias(n) for n, c in named.items())), "merkle-leaves")
    # repeated rows are alike in all that counts, so any order among them will do; a number parts them in the ranges
    placed = stored(numbered(leaves.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "doc_id", "hash", "_salt").drop("_salt"), "merkle-placed")
    levels = levels_of(placed, config.fan)
    tops = levels[0].where("n = 1")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("n = 1"))
    subroots = stored(tops.select(F.expr(SOURCE_ROOT).alias("tree"), F.col("tree").alias("of"), "hash"), "merkle-subroots")
    ranked = stored(numbered(subroots, "of"), "merkle-sources")
    upper = levels_of(ranked, config.fan)
    top = upper[-1].select(F.col("tree"), F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    up = with_paths(upper, ranked, stored(top, "merkle-root"), config.fan)
    roots = stored(up.select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", "path"), "merkle-roots")
    found = with_paths(levels, placed, roots, config.fan)
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", *(F.col(n).alias(name) for n, name in zip(named, own, strict=True)))


def verified(found: DataFrame, tampered: str) -> DataFrame:
    """Rows of ``manifest`` with ``folded_root``, from the leaf in ``tampered`` where it isn't null, and whether it is the root."""
    return found.withColumn("folded_root", folded(F.coalesce(F.col(tampered), F.col("leaf")), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, checked against rows of which some had their letters changed."""
    config = MerkleConfig()
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(touched, leaf_of(config, text=F.translate("text", upper, lower)))
    found = verified(manifest(docs, config, tampered=tampered), "tampered")
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def _sql(fan: int = 16, levels: int = 9, upper: int = 4) -> str:
    """DuckDB has no iteration over ordered aggregates, so the levels are written out: ``fan ** levels`` rows a source."""
    parts = [
        r"""
leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS hash
  FROM documents
), a0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
)"""
    ]

    def climb(name: str, count: int) -> None:
        for k in range(count):
            parts.append(
                f"""{name}{k + 1} AS (
  SELECT tree, pos // {fan} AS pos, CASE WHEN min(n) = 1 THEN 1 ELSE (min(n) + {fan - 1}) // {fan} END AS n,
    CASE WHEN min(n) = 1 THEN min(hash) ELSE sha256(string_agg(hash, '' ORDER BY pos)) END AS hash, string_agg(hash, '' ORDER BY pos) AS kids, min(n) = 1 AS done
  FROM {name}{k} GROUP BY tree, pos // {fan}
)"""
            )

    climb("a", levels)
    parts.append(f"b0 AS (SELECT 'r' AS tree, tree AS source_tree, hash, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a{levels})")
    climb("b", upper)
    joins, steps = [], []
    for name, count, base in (("a", levels, "l"), ("b", upper, "s")):
        for k in range(count):
            at = f"{base}.pos // {fan**k}"
            joins.append(f"JOIN {name}{k + 1} AS {name}{k + 1} ON {name}{k + 1}.tree = {base}.tree AND {name}{k + 1}.pos = {base}.pos // {fan ** (k + 1)}")
            kids, slot = f"{name}{k + 1}.kids", f"({at}) % {fan}"
            steps.append((f"CASE WHEN {name}{k + 1}.done THEN '' ELSE {kids}[:64 * ({slot})] END", f"CASE WHEN {name}{k + 1}.done THEN '' ELSE {kids}[64 * ({slot}) + 65:] END", f"{name}{k + 1}.done"))
        if name == "a":
            joins.append("JOIN b0 AS s ON s.source_tree = l.tree")
    proof = " || ".join(f"{left} || {right}" for left, right, _ in steps)
    lefts, rights, dones = ("[" + ", ".join(s[k] for s in steps) + "]" for k in range(3))
    parts.append(f"paths AS (SELECT l.doc_id, l.hash AS leaf, l.head, l.text, s.hash AS subroot, b{upper}.hash AS root, sha256({proof}) AS proof_sha256, {lefts} AS lefts, {rights} AS rights, {dones} AS dones FROM a0 AS l {' '.join(joins)})")
    parts.append(
        """begun AS (
  SELECT *, CASE WHEN text IS NOT NULL AND touched THEN sha256(head || strlen(low) || ':' || low) ELSE leaf END AS f0
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, CRC AS touched FROM paths)
)""".replace("CRC", _CRC)
    )
    last = "begun"
    for k in range(levels + upper):
        parts.append(f"f{k + 1} AS (SELECT * EXCLUDE (f{k}), CASE WHEN dones[{k + 1}] THEN f{k} ELSE sha256(lefts[{k + 1}] || f{k} || rights[{k + 1}]) END AS f{k + 1} FROM {last})")
        last = f"f{k + 1}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM {last}"


#: CRC-32 of the decimal id, a bit at a time, is 0 modulo 5; null ids aren't touched.
_CRC = (
    "coalesce((xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda acc, c: list_reduce(list_prepend(xor(acc, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)) % 5 = 0, false)"
)

OP13_SQL = _sql()
