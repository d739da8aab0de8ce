"""Audit of how far the sources of a language diverge from one another, from exact term counts.

Documents of a group (a source within a language) are brought together and cut into terms once, into a stored table of tokens: a
language and a term of its. Runs of a group's documents are written down by the bits of their summed counts: one list of tokens
for each bit, so that a token that occurs five times stands in the lists of 1 and 4. For ``CountVectorizer``'s fit a run is as
many documents as the least document frequency: the first holds the terms of one document or more, the second those of two or
more, and so on. A term is in at least so many of these as is asked for if and only if it is in so many documents. The fit has the
largest vocabulary that an integer allows: as tokens carry their language, one fit gives every language its own vocabulary,
however many languages there are. The model then makes exact sparse vectors of the lists, which add up, each times its power of
two, to the run's; these are summed by group term by term, as ``Summarizer`` would, but without its dense arrays.

Pairs of sources are evaluated on these sparse sums. A term that neither source has contributes the same for every term, and
one that only one has depends on its smoothed share alone, so the shares of a group are counted by value and meet the other
sources of the language; the terms that both have meet in a join by term, which corrects the two sums.

``CountVectorizer`` keeps its vocabulary on the driver and on each executor. Its size is estimated beforehand, from the tokens
of one in ``estimate`` hash values, and beyond ``shard_terms`` tokens are dealt by hash to so many fits as keep every vocabulary
near that size; each fit reads all tokens. The number of fits changes no result.

Shares are integers: ``p = 1 + floor(scale * (count + smooth) / (N + smooth * V))``, and a term's contribution is
``floor((p - q) ** 2 / q)``. All sums are exact: counts in 64 bits, products in decimals.

Edge cases: null text, lang and source are empty strings; every row is a document, repeated ones too; a text without terms
still makes its group occur; a language without kept terms has pairs of value 0 and no terms. Ties of the ranks go to the
smaller item bytewise. An empty table gives no rows. Columns other than ``text``, ``lang`` and ``source`` aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwarden.llm.common import fresh_path, maybe_broadcast, raw_texts, small_batches, stored, table

#: A term of a text whose A to Z are lower-cased; as all that separates terms is ASCII, its bytes in UTF-8 can be split.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
#: Terms of a broadcast, which is built on the driver; more of them are shuffled.
BROADCAST_TERMS = 50_000
#: Terms that a task counts before it writes them down, and those of one row.
HELD_TERMS, ROW_TERMS = 1 << 17, 1 << 13
#: Between language and term of a token; no term holds it.
MARK = "\0"


@dataclass(frozen=True)
class DivergenceConfig:
    #: Documents of a language that a term must occur in.
    min_docs: int = 3
    smooth: int = 1
    scale: int = 1_000_000_000
    top_terms: int = 200
    #: Tokens of one fit, and the share of hash values that their number is estimated from.
    shard_terms: int = 1_000_000
    estimate: int = 64

    @property
    def vocabulary(self) -> int:
        return (1 << 31) - 1


def tokens_of(docs: DataFrame, config: DivergenceConfig) -> DataFrame:
    """``(lang, source, tokens, docs)`` of runs of each group's rows, both ``array<array<string>>``.

    ``tokens`` are those whose count has bit 0, bit 1, and so on, ``docs`` those of at least 1, 2 and up to ``min_docs`` rows.
    """
    schema = "lang string, source string, tokens array<array<string>>, docs array<array<string>>"

    def nested(rows: list[list[list[bytes]]]) -> pa.Array:
        lists = [own for row in rows for own in row]
        ends = lambda parts: pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
        flat = pa.array([token for own in lists for token in own], pa.binary()).cast(pa.string())
        return pa.ListArray.from_arrays(ends(rows), pa.ListArray.from_arrays(ends(lists), flat))

    def written(groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, held) in groups.items():
            terms, mark = list(counts), lang + MARK.encode()
            for at in range(0, max(1, len(terms)), ROW_TERMS):
                part = [(mark + t, counts[t], held[t]) for t in terms[at : at + ROW_TERMS]]
                bits = max((n for _, n, _ in part), default=0).bit_length()
                tokens = [[token for token, n, _ in part if n >> bit & 1] for bit in range(bits)]
                rows = [[token for token, _, m in part if m > k] for k in range(config.min_docs)]
                names = [pa.array([x], pa.binary()).cast(pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, nested([tokens]), nested([rows])], ["lang", "source", "tokens", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(raw_texts(batch.column(k)) for k in range(3)), strict=True):
                if (lang, source) not in groups:
                    groups[lang, source], size = (Counter(), Counter()), size + 1
                counts, held = groups[lang, source]
                words, before = text.translate(_BYTES).split(), len(counts)
                counts.update(words)
                held.update(set(words))
                size += len(counts) - before
                if size >= HELD_TERMS:
                    yield from written(groups)
                    groups, size = {}, 0
        yield from written(groups)

    small_batches(docs.sparkSession)
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    # the fewer groups a task has, the fewer rows its terms make; a large group is dealt to several tasks
    return plain.hint("rebalance", F.col("lang"), F.col("source")).mapInArrow(run, schema)


def vocabulary_size(tokens: DataFrame, config: DivergenceConfig) -> int:
    """About how many tokens occur in as many documents as is asked for."""
    drawn = tokens.select(F.explode(F.flatten("docs")).alias("token")).where(F.pmod(F.xxhash64("token"), F.lit(config.estimate)) == 0)
    return config.estimate * drawn.groupBy("token").count().where(F.col("count") >= config.min_docs).count()


def group_sums(tokens: DataFrame, config: DivergenceConfig) -> DataFrame:
    """``(lang, source, term, count)``: occurrences of kept terms in each group that has them, from a stored table of tokens."""
    spark = tokens.sparkSession
    shards = max(1, -(-vocabulary_size(tokens, config) // config.shard_terms))
    # a fit without any token that is frequent enough is refused; these make one that belongs to no language
    ballast = spark.range(config.min_docs).select(F.array(F.lit("")).alias("tokens"))
    counter = CountVectorizer(inputCol="tokens", outputCol="vector", minTF=1.0, minDF=float(config.min_docs), vocabSize=config.vocabulary)
    found = []
    for shard in range(shards):
        own = lambda c, k=shard: c if shards == 1 else F.filter(c, lambda t: F.pmod(F.xxhash64(t), F.lit(shards)) == k)
        model = counter.fit(tokens.select(F.explode("docs").alias("tokens")).select(own(F.col("tokens")).alias("tokens")).unionByName(ballast))
        # the vocabulary as a table: as written with the model, so that it needn't pass through Python
        path = fresh_path(spark, "divergence-model")
        model.write().save(path)
        terms = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "token")).where("token != ''")
        vector = F.unwrap_udt("vector")
        lists = tokens.select("source", F.posexplode("tokens").alias("bit", "tokens"))
        vectors = model.transform(lists.select("source", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("times"), own(F.col("tokens")).alias("tokens")))
        # a token tells its language, so source and token are a group's term
        sums = vectors.select("source", "times", F.explode(vector["indices"]).alias("index")).groupBy("source", "index").agg(F.sum("times").alias("count"))
        # a fit's vocabulary is bounded by shard_terms; as a broadcast it would be built on the driver, beside the model's
        term = F.substring_index("token", MARK, -1)
        lang = F.expr(f"substring(token, 1, length(token) - length(term) - {len(MARK)})")
        named = sums.join(maybe_broadcast(terms, limit=BROADCAST_TERMS), "index").withColumn("term", term).select(lang.alias("lang"), "source", "term", "count")
        found.append(stored(named, "divergence-sums"))
    return reduce(DataFrame.unionByName, found)


def share(count: Column, n: Column, v: Column, config: DivergenceConfig) -> Column:
    """The smoothed share of a term, ``1`` to ``scale + 1``."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(config.scale).cast("decimal(10,0)") * wide(count + F.lit(config.smooth))
    return F.lit(1).cast("long") + F.call_function("div", above, wide(n + F.lit(config.smooth) * v))


def contribution(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


@dataclass(frozen=True)
class Shares:
    """``groups(lang, source, v, kinds, p0)``: kept terms of the language, those that the group has, and the share of one it
    lacks; ``terms(lang, source, term, p)``: the shares of those it has; ``langs(lang, term, q)``: the shares in the language."""

    groups: DataFrame
    terms: DataFrame
    langs: DataFrame


def shares(docs: DataFrame, config: DivergenceConfig) -> Shares:
    tokens = stored(tokens_of(docs, config), "divergence-tokens")
    sums = stored(group_sums(tokens, config), "divergence-counts")
    whole = stored(sums.groupBy("lang", "term").agg(F.sum("count").alias("count")), "divergence-langs")
    sizes = stored(whole.groupBy("lang").agg(F.sum("count").alias("n"), F.count("*").alias("v")), "divergence-sizes")
    held = sums.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("kinds"))
    every = tokens.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(maybe_broadcast(sizes.select("lang", "v")), "lang", "left")
    counted = every.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "kinds")))
    groups = stored(counted.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("v"), config))), "divergence-groups")
    p = share(F.col("count"), F.col("n"), F.col("v"), config)
    terms = sums.join(maybe_broadcast(groups.select("lang", "source", "n", "v")), ["lang", "source"]).select("lang", "source", "term", p.alias("p"))
    langs = whole.join(maybe_broadcast(sizes), "lang").select("lang", "term", p.alias("q"))
    return Shares(groups, stored(terms, "divergence-shares"), stored(langs, "divergence-shares"))


def _both_ways(pairs: DataFrame, *sums: tuple[str, Column, Column]) -> DataFrame:
    """Sums of ``pairs(lang, x, y)`` by (lang, source, item), once as (x, y) and once as (y, x): name, value of (x, y), value of (y, x)."""
    added = stored(pairs.groupBy("lang", "x", "y").agg(*(F.sum(v).alias(f"{n}_{w}") for n, *both in sums for w, v in enumerate(both))), "divergence-pairs")
    turned = [added.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), *(F.col(f"{n}_{w}").alias(n) for n, *_ in sums)) for w, (a, b) in enumerate((("x", "y"), ("y", "x")))]
    return turned[0].unionByName(turned[1])


def pair_divergence(found: Shares) -> DataFrame:
    """``(lang, source, item, value)`` for every pair of two sources of one language."""
    groups, terms = found.groups, found.terms
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("kinds").alias("item_kinds"))
    pairs = groups.join(maybe_broadcast(other), "lang").where(F.col("source") != F.col("item"))
    # terms of one source as if no other had them: its shares by value, against each other source's share of a term it lacks
    values = stored(terms.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), "divergence-values")
    others = groups.select("lang", F.col("source").alias("y"), "p0")
    alone = values.withColumnRenamed("source", "x").join(maybe_broadcast(others), "lang").where("x != y")
    p, p0 = F.col("p"), F.col("p0")
    lone = _both_ways(alone, ("lone", F.col("m") * contribution(p, p0), F.col("m") * contribution(p0, p)))
    lone = lone.groupBy("lang", "source", "item").agg(F.sum("lone").alias("lone"))
    # terms that both have: the true contribution, in place of the two above
    zero = groups.select("lang", "source", "p0")
    sides = stored(terms.join(maybe_broadcast(zero), ["lang", "source"]), "divergence-sides")
    x = sides.select("lang", "term", F.col("source").alias("x"), F.col("p").alias("px"), F.col("p0").alias("x0"))
    y = sides.select("lang", "term", F.col("source").alias("y"), F.col("p").alias("py"), F.col("p0").alias("y0"))
    shared = x.join(y, ["lang", "term"]).where("x < y")
    mend = lambda p, q, p0, q0: contribution(p, q) - contribution(p, q0) - contribution(p0, q)
    px, py, x0, y0 = (F.col(c) for c in ("px", "py", "x0", "y0"))
    one = F.lit(1).cast("long")
    common = _both_ways(shared, ("both", one, one), ("mended", mend(px, py, x0, y0), mend(py, px, y0, x0)))
    key = ["lang", "source", "item"]
    joined = pairs.join(maybe_broadcast(stored(lone, "divergence-lone")), key, "left").join(maybe_broadcast(stored(common, "divergence-common")), key, "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    neither = F.col("v") - F.col("kinds") - F.col("item_kinds") + count("both")
    value = F.when(F.col("v") > 0, contribution(F.col("p0"), F.col("q0")) * neither + count("lone") + count("mended")).otherwise(F.lit(0))
    return joined.select(*key, value.cast("long").alias("value"))


def leading_terms(found: Shares, config: DivergenceConfig) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms that a group has more of than its language, the foremost ``top_terms``."""
    both = found.terms.join(maybe_broadcast(found.langs, limit=BROADCAST_TERMS), ["lang", "term"]).where(F.col("p") > F.col("q"))
    rated = both.select("lang", "source", F.col("term").alias("item"), contribution(F.col("p"), F.col("q")).alias("value"))
    # the limit on row numbers lets Spark cut each group before it moves
    return rated.withColumn("rank", _rank()).where(F.col("rank") <= config.top_terms)


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc()))


def audit(docs: DataFrame, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs of sources, and each group's leading terms."""
    found = shares(docs, config)
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = pair_divergence(found).withColumn("rank", _rank()).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(leading_terms(found, config).withColumn("part", F.lit("term")).select(*columns))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (SELECT row_id, lang, source, unnest(terms) AS term FROM docs
), kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3
), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, s.v, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 1)) // (n + v)::HUGEINT)::HUGEINT AS p FROM dense
), whole AS (SELECT lang, term, sum(c) AS c, any_value(v) AS v FROM dense GROUP BY lang, term
), q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v)::HUGEINT)::HUGEINT AS q FROM whole
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), rated AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM rated) QUALIFY part = 'pair' OR rank <= 200
"""
