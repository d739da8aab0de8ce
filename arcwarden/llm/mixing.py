"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of all words by its weight, but at most ``cap`` times its own words; the excess goes to the others
by weight. A source whose target is r times its size gives floor(r) whole copies of every document. The rest of its target
is filled by Pareto order sampling with unequal probabilities: a document has a propensity (here the square root of its
words, so that longer texts are likelier), its inclusion odds p / (1 - p) are a constant of its source times the propensity,
its random odds u / (1 - u) come from a hash of its id, and documents are taken by random odds over inclusion odds, smallest
first, until their words fill the remainder. The constant is the one at which the expected words are the remainder; as it is
the same for a whole source, it doesn't change the order, and the fixed size sets it without solving for it
(``inclusion_probabilities`` does, for tests and reports).

The sample has a fixed size in words. Where the next document doesn't fit, the order goes on once more among the later
documents that are small enough, and the document whose size fits the last gap best is taken as well when it brings the
total nearer.

A running total over a whole source would be one task's work; instead the ranking variable is cut into bins, words are
summed by bin, and only the bin in which the remainder ends is cut again, as often as it takes for its rows to be few; after
the rank's bits come those of a hash of the row, so equal ids are cut too. All steps are DataFrame expressions.

Edge cases: a null text has size 0 and is never taken beyond 0 words; a null source is a source of its own, after all
others; sources without words have target 0. Repeated rows, and rows without an id, count each on its own: of rows of one
id and size as many are taken as fit, and it is open which. An empty table gives an empty result. Extra columns pass
through; ``mix_sources`` replaces columns of the input that carry an output's name, ``draw_mix`` keeps them and names its
own ``copies_`` and ``copy_`` then. A source may hold any share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwarden.llm.common import BROADCAST_ROWS, global_row_number, n_words, positional, stored, table


@dataclass(frozen=True)
class MixConfig:
    #: Weights of the sources in code-point order, null last, repeating.
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    cap: int = 3
    seed: str = "mix"
    #: Bits of the rank that one level of cutting looks at, and the rows of a bin that are ranked one by one.
    bits: int = 10
    rank_rows: int = 50_000
    #: Times the order is followed: once among all, then among those that the gap has room for.
    passes: int = 2


#: Decimal places of targets: what sums of doubles in any order agree on.
TARGET_PLACES = 4
#: Bits of a rank.
RANK_BITS = 52
UNIT = 1 << RANK_BITS


def random_unit(doc_id: Column, seed: str) -> Column:
    """An integer of 52 random bits from the id; equal ids agree in every run."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes(source, size)``, stored.

    Weights follow the sources' order by distributed numbering. The level (words for one unit of weight) is what the uncapped
    sources share by weight; it rises as sources reach their caps, and a source once above its cap stays there, so the rounds
    of summing end when no further source is capped.
    """
    own = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    numbered = global_row_number(own, F.col("source").asc_nulls_last(), "number")
    placed = stored(numbered.withColumn("weight", F.element_at(weights, ((F.col("number") - 1) % len(config.weights) + 1).cast("int"))).drop("number"), "weights")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    most = config.cap * F.col("source_size")
    level, n_capped = F.lit(0.0), -1
    while True:
        capped = most <= level * F.col("weight")
        sums = placed.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, most)).alias("at_cap"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if sums["n"] == n_capped or not sums["open"]:
            break
        n_capped, level = sums["n"], F.lit(float(total - (sums["at_cap"] or 0)) / float(sums["open"]))
    target = F.when(most <= level * F.col("weight"), most.cast("double")).otherwise(level * F.col("weight"))
    return stored(placed.select("source", "source_size", F.round(target, TARGET_PLACES).alias("target")), "targets")


def inclusion_probabilities(sizes: list[int], propensities: list[float], rest: float) -> list[float]:
    """Design probabilities of the remainder: odds proportional to propensity, expected words equal to ``rest`` (a helper for tests and reports)."""
    low, high = 0.0, 1.0
    words = lambda c: sum(s * c * q / (1 + c * q) for s, q in zip(sizes, propensities, strict=True))
    while words(high) < rest and high < 1e18:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < rest else (low, mid)
    return [low * q / (1 + low * q) for q in propensities]


def ranked_sizes(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """``sizes`` with its ranking variable: random odds over the document's inclusion odds, brought to 52 bits.

    The propensity is the column of that name, or the square root of the size where there is none.
    """
    share = (random_unit(F.col("doc_id"), config.seed) + F.lit(0.5)) / F.lit(float(UNIT))
    propensity = F.col("propensity") if "propensity" in sizes.columns else F.sqrt(F.greatest("size", F.lit(1)).cast("double"))
    odds = share / (1 - share) / propensity
    return sizes.withColumn("rank", F.least(F.floor(odds / (1 + odds) * UNIT), F.lit(UNIT - 1)).cast("long"))


#: The order of a source's documents: by rank, then by a hash of the row's number in the stored table, then by the number.
KEY = ("rank", "spread", "row")


def _key(*more: Column) -> Column:
    return F.struct(*KEY, *more)


def numbered_rows(sizes: DataFrame, what: str) -> DataFrame:
    """``sizes`` stored, with a number for each row (``row``) and a hash of it (``spread``), which stay as the table stays."""
    return stored(sizes.withColumn("row", F.monotonically_increasing_id()), what).withColumn("spread", F.shiftrightunsigned(F.xxhash64("row"), 64 - RANK_BITS))


def _same_source(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Join on the source, null included.

    ``right`` has a row for each of ``n`` sources at most: up to the limit of broadcasts, documents stay where they are, and a
    source with a third of them isn't dealt to one task.
    """
    other = right.select(F.col("source").alias("_source"), *[c for c in right.columns if c != "source"])
    return left.join(F.broadcast(other) if n <= BROADCAST_ROWS else other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _cut(ranked: DataFrame, plan: DataFrame, n: int, config: MixConfig) -> DataFrame:
    """``(source, first_out)``: the key of the first document that doesn't fit into ``rest`` any more, for sources with one.

    Each level sums sizes by bin, ``bits`` bits of the rank further down, and finds the bin in which the running total passes
    the rest; when those bins hold few rows, their rows are ranked one by one.
    """
    state = plan.select("source", "rest", F.lit(0.0).alias("done"))
    digits = [(key, shift) for key in KEY[:2] for shift in range(RANK_BITS - config.bits, -config.bits, -config.bits)]
    inside = ranked
    for key, shift in digits:
        digit = F.pmod(F.shiftright(key, max(0, shift)), F.lit(1 << config.bits))
        sums = inside.groupBy("source", digit.alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        running = Window.partitionBy("source").orderBy("bin")
        totals = _same_source(sums, state.select("source", "rest", "done"), n).withColumn("upto", F.col("done") + F.sum("words").over(running))
        over = totals.where(F.col("upto") > F.col("rest"))
        state = stored(over.groupBy("source").agg(F.min(F.struct("bin", "rest", (F.col("upto") - F.col("words")).alias("done"), "rows")).alias("s")).select("source", "s.*"), "cut")
        most = state.agg(F.max("rows")).first()[0]
        inside = _same_source(inside, state.select("source", F.col("bin").alias("_bin")), n).where(digit == F.col("_bin")).drop("_bin")
        if (most or 0) <= config.rank_rows:
            break
    running = Window.partitionBy("source").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = _same_source(inside, state.select("source", "rest", "done"), n).withColumn("upto", F.col("done") + F.sum("size").over(running))
    return fits.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(_key()).alias("first_out"))


def _left(table_: DataFrame, other: DataFrame) -> DataFrame:
    """Left join of two tables with a row for each source."""
    return table_.join(other.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def plan_mix(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row for each source of ``sizes(doc_id, source, size, row, spread[, propensity])``, of ``numbered_rows``.

    Columns: source, source_size, target, base (whole copies of all), rest (words of the sample), cuts (for each pass the most
    words of a document that it looks at, and the first document that is out, null if all fit) and closing (the document that
    fills the last gap best, or null).
    """
    targets = source_targets(sizes, config)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stored(targets.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")).withColumn("cuts", F.expr(f"cast(array() as {_CUTS})")), "plan")
    ranked, n = ranked_sizes(sizes, config).where("size > 0"), plan.count()
    gap = plan.select("source", F.col("rest").alias("gap"))
    for step in range(config.passes):
        open_ = _same_source(ranked, plan.select("source", "cuts", "rest"), n).where(~_sampled())
        room = _same_source(open_.drop("rest", "cuts"), gap, n).where(F.col("size") <= F.col("gap")) if step else open_.drop("rest", "cuts")
        cut = _cut(room.select("source", "size", *KEY), gap.withColumnRenamed("gap", "rest"), n, config)
        limit = F.col("gap") if step else F.lit(float("inf"))
        joined = _left(_left(plan, gap), cut)
        plan = stored(joined.select(*[c for c in plan.columns if c != "cuts"], F.concat("cuts", F.array(F.struct(limit.cast("double").alias("most"), "first_out"))).alias("cuts")), "plan")
        filled = _same_source(ranked, plan.select("source", "cuts", "rest"), n).where(_sampled()).groupBy("source").agg(F.sum("size").alias("filled"))
        gap = stored(_left(plan.select("source", "rest"), filled).select("source", (F.col("rest") - F.coalesce("filled", F.lit(0))).alias("gap")), "gap")
    outside = _same_source(_same_source(ranked, plan.select("source", "cuts", "rest"), n).where(~_sampled()), gap, n).where(F.col("size") < 2 * F.col("gap"))
    closing = outside.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), *KEY)).alias("closing"))
    return stored(_left(plan, closing), "plan")


_CUTS = "array<struct<most: double, first_out: struct<rank: long, spread: long, row: long>>>"


def _sampled() -> Column:
    """Whether a ranked document is in the sample by the passes so far."""
    return (F.col("rest") > 0) & F.exists("cuts", lambda c: (F.col("size") <= c["most"]) & (c["first_out"].isNull() | (_key() < c["first_out"])))


def _with_copies(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """``copies`` of each ranked row: the whole copies, and one more for sampled and closing documents."""
    joined = _same_source(ranked, plan, plan.count())
    closing = F.coalesce(F.col("closing.row") == F.col("row"), F.lit(False))
    return joined.withColumn("copies", F.col("base") + F.when(F.col("size") > 0, (_sampled() | closing).cast("long")).otherwise(F.lit(0)))


OUTPUTS = ["size", "source_size", "target", "copies", "taken"]


def _mixed(docs: DataFrame, config: MixConfig) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named by position, and the outputs; the documents are stored once, with their row numbers."""
    plain, names = positional(docs)
    ready = plain.withColumns({"doc_id": F.col(names["doc_id"]), "source": F.col(names["source"]), "size": n_words(names["text"])})
    rows = numbered_rows(ready, "numbered")
    sizes = rows.select("doc_id", "source", "size", "row", "spread")
    found = _with_copies(ranked_sizes(rows, config), plan_mix(sizes, config)).withColumn("taken", F.col("copies") * F.col("size"))
    return found.select(*plain.columns, *OUTPUTS), plain.columns


def mix_sources(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken: what the mix takes of every document."""
    docs = docs.drop(*OUTPUTS)
    return _mixed(docs, config)[0].toDF(*docs.columns, *OUTPUTS)


def draw_mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns, the number of copies, and which one it is."""
    found, own = _mixed(docs, config)
    drawn = found.where("copies > 0").select(*own, "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    free = lambda name: name if name not in docs.columns else free(name + "_")
    return drawn.toDF(*docs.columns, free("copies"), free("copy"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = numbered_rows(docs.select("doc_id", "source", n_words("text").alias("size")), "sizes")
    config = MixConfig()
    found = _with_copies(ranked_sizes(sizes, config), plan_mix(sizes, config))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = rf"""
WITH sizes AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(UNIT)}::DOUBLE AS u
  FROM documents
), ranked AS (
  SELECT *, u / (1 - u) / sqrt(greatest(size, 1)::DOUBLE) AS odds FROM sizes
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w
  FROM sizes GROUP BY source
), ordered AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_of_all,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, row_number() OVER o AS k
  FROM sources WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)
), free AS (SELECT *, 3 * source_size * open > rest_of_all * w AS is_free FROM ordered
), edge AS (SELECT rest_of_all AS r, open AS o FROM free WHERE is_free ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, round(CASE WHEN is_free THEN r::DOUBLE / o * w ELSE 3.0 * source_size END, {TARGET_PLACES})::DOUBLE AS target
  FROM free LEFT JOIN edge ON true
), based AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM targets
), running AS (
  SELECT s.*, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY floor(s.odds / (1 + s.odds) * {float(UNIT)}), s.rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM ranked s JOIN based b ON s.source IS NOT DISTINCT FROM b.source
), first AS (SELECT *, size > 0 AND rest > 0 AND upto <= rest AS one FROM running
), gap1 AS (SELECT source, max(rest) - coalesce(sum(size) FILTER (one), 0) AS gap FROM first GROUP BY source
), again AS (
  SELECT f.rid, g.gap, sum(f.size) OVER (PARTITION BY f.source ORDER BY floor(f.odds / (1 + f.odds) * {float(UNIT)}), f.rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM first f JOIN gap1 g ON f.source IS NOT DISTINCT FROM g.source WHERE NOT f.one AND f.size > 0 AND f.rest > 0 AND f.size <= g.gap
), picked AS (SELECT f.*, f.one OR coalesce(a.upto <= a.gap, false) AS inside FROM first f LEFT JOIN again a ON f.rid = a.rid
), gaps AS (SELECT source, max(rest) - coalesce(sum(size) FILTER (inside), 0) AS gap FROM picked GROUP BY source
), closing AS (
  SELECT arg_min(p.rid, (abs(p.size - g.gap), p.odds)) AS rid
  FROM picked p JOIN gaps g ON p.source IS NOT DISTINCT FROM g.source
  WHERE NOT p.inside AND p.size > 0 AND p.size < 2 * g.gap GROUP BY p.source
)
SELECT p.doc_id, p.size, p.source_size, p.target, p.size * (p.base + CASE WHEN p.inside OR c.rid IS NOT NULL THEN 1 ELSE 0 END) AS taken
FROM picked p LEFT JOIN closing c ON p.rid = c.rid
"""
