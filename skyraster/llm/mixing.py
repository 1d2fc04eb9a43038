"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / weight``: u is a hash of its doc_id (of its text, where that is null), weight
a column that is passed in, or else its quality: one plus the mean log ratio of its words under trusted and
under all texts (see quality_rules), held between ``LEAST`` and ``MOST``. Sorted by key within its source, the documents' sizes are prefix-summed to the
source's budget. Budgets follow the source weights, and stop at ``cap`` times the source's
size; what is cut off goes to the others by weight. Whole epochs come first, then the
fractional part takes the documents with the smallest keys, up to the one whose middle word
is the last within the budget.

No source is sorted as a whole: keys fall into ``BUCKETS`` buckets of equal probability at
weight 1, and bucket sums give the bucket in which the budget ends. That one is divided again as long
as it has more than ``EDGE_ROWS`` rows, and only what is left is ordered. The decision for a document
is then a comparison with its source's cut-off.

Cases: null text or no word has size 0 and takes nothing; null sources form one source, the
last; ties in key go by doc_id, size and text hash, and rows equal in all of them go together;
an empty table gives no rows; a source without words has target 0. Extra columns are ignored
by ``plan`` and kept by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyraster.llm import quality_rules
from skyraster.llm.common import cut, ensure, remove, shared_dir

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BUCKETS = 1024
EDGE_ROWS = 50_000
ORDERS = 1  # length of the word runs by which quality is told
LEAST, MOST = 0.05, 1.5
SEED = "mix"
MAX_BROADCAST_SOURCES = 100_000
_TEXT = "coalesce(cast(`text` as string), '')"


def measure(docs: DataFrame, folder: str, seed: str = SEED, weight: str | None = None, rows: bool = False) -> DataFrame:
    """_doc, _source, _size, _tie, _key, _bucket of each row of docs, and with ``rows`` the row itself as _row.

    weight: a column of docs, above 0; without one the weight is the text's quality.
    """
    text = F.expr(_TEXT)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(text))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    known = [F.col("doc_id").cast("long").alias("_doc"), F.col("source").cast("string").alias("_source"), F.md5(text).alias("_tie"), u.alias("_u")]
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != weight]).alias("_row")] if rows else []
    if weight is not None:
        size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
        out = docs.select(*kept, *known, size.alias("_size"), F.col(f"`{weight}`").cast("double").alias("_weight"))
    else:
        coded = cut(docs.select(*kept, *known, quality_rules.form(text).alias("of")).select(*["_row"] * rows, "_doc", "_source", "_tie", "_u", "of.*"), f"{folder}/coded")
        ratios = quality_rules.log_ratios(quality_rules.coded_features(coded, ORDERS), ORDERS)
        n = F.size("codes")
        score = quality_rules.units(F.col("codes"), ratios, ORDERS) / F.greatest(n, F.lit(1)).cast("double") / float(quality_rules.UNIT)
        quality = F.least(F.greatest(1.0 + score, F.lit(LEAST)), F.lit(MOST))
        out = coded.select(*["_row"] * rows, "_doc", "_source", "_tie", "_u", n.cast("long").alias("_size"), quality.alias("_weight"))
    out = out.withColumn("_key", -F.log("_u") / F.col("_weight"))
    return out.withColumn("_bucket", F.least(F.floor(BUCKETS * (1 - F.exp(-F.col("_key")))), F.lit(BUCKETS - 1)).cast("int")).drop("_u", "_weight")


def _within(df: DataFrame, source: str, *order: Column) -> WindowSpec:
    return Window.partitionBy(source).orderBy(*order)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Budgets of the sources (one row each): target = least(cap * size, level * weight)."""
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())  # one row a source
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    capped = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("_source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - before) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    met = capped.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", "ratio").alias("level"))
    target = F.least(F.col("most"), F.coalesce(F.col("level"), F.col("ratio")) * F.col("weight"))
    return capped.crossJoin(F.broadcast(met)).select("_source", "source_size", target.alias("target"))  # met is one row


def _edge(groups: DataFrame, goals: DataFrame) -> DataFrame:
    """Of groups (_source, low, high, n, rows; in order of low) the one of each source in which the rest of its target ends.

    goals: source, source_size, target, epochs, rest, before (words taken before the groups).
    """
    joined = groups.join(goals, F.col("_source").eqNullSafe(F.col("source")))
    through = F.col("before") + F.sum("n").over(_within(joined, "_source", F.col("low")))
    sums = joined.withColumn("through", through).withColumn("final", F.max("low").over(Window.partitionBy("_source")) == F.col("low"))
    edge = F.min(F.struct("low", "high", (F.col("through") - F.col("n")).alias("before"), "rows")).alias("edge")
    found = sums.where("through > rest or final").groupBy("source", "source_size", "target", "epochs", "rest").agg(edge)
    return found.select("source", "source_size", "target", "epochs", "rest", "edge.*")


def plan(measured: DataFrame, folder: str, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """One row a source: source_size, target, epochs, low (all keys below are in), and the last (key, doc, size, tie) taken."""
    sums = (F.min("_key").alias("low"), F.max("_key").alias("high"), F.sum("_size").alias("n"), F.count(F.lit(1)).alias("rows"))
    groups = cut(measured.groupBy("_source", "_bucket").agg(*sums), f"{folder}/buckets")
    goals = targets(groups.groupBy("_source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.select(F.col("_source").alias("source"), "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("before"))
    edges = cut(_edge(groups, goals), f"{folder}/edges")
    level = 0
    while not (wide := edges.where((F.col("rows") > edge_rows) & (F.col("high") > F.col("low")))).isEmpty():
        level += 1
        inside = _inside(measured, wide)
        part = F.least(F.floor(BUCKETS * (F.col("_key") - F.col("low")) / (F.col("high") - F.col("low"))), F.lit(BUCKETS - 1))
        groups = inside.withColumn("part", part).groupBy("_source", "part").agg(*sums)
        finer = _edge(groups, wide.drop("low", "high", "rows"))
        done = edges.where((F.col("rows") <= edge_rows) | (F.col("high") <= F.col("low")))
        edges = cut(done.unionByName(finer), f"{folder}/edges-{level}")
    # Rows that are equal in all of these go together, and count as one.
    at = F.struct("_key", "_doc", "_size", "_tie")
    rows = _inside(measured, edges).groupBy("_source", "rest", "before", at.alias("at"), "_size").agg(F.sum("_size").alias("n"))
    rows = rows.withColumn("since", F.col("before") + F.sum("n").over(_within(rows, "_source", F.col("at"))) - F.col("n"))
    last = rows.where("rest > 0 and since + _size / 2D <= rest").groupBy("_source").agg(F.max("at").alias("last"))
    out = edges.join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select(F.col("source").alias("plan_source"), "source_size", "target", "epochs", "low", "last")


def _inside(measured: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of each source within its edge."""
    edges = edges.select("source", "low", "high", "before", "rest")
    small = F.broadcast(edges) if edges.count() <= MAX_BROADCAST_SOURCES else edges
    return measured.join(small, F.col("_source").eqNullSafe(F.col("source")) & F.col("_key").between(F.col("low"), F.col("high")))


def decide(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to each measured row."""
    small = chosen.count() <= MAX_BROADCAST_SOURCES
    out = measured.join(F.broadcast(chosen) if small else chosen, F.col("_source").eqNullSafe(F.col("plan_source")))
    at = F.struct("_key", "_doc", "_size", "_tie")
    taken = (F.col("target") > F.col("epochs") * F.col("source_size")) & ((F.col("_key") < F.col("low")) | F.coalesce(at <= F.col("last"), F.lit(False)))
    return out.withColumn("copies", F.col("epochs") + F.when(taken, 1).otherwise(0))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, weight: str | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    folder = shared_dir(docs.sparkSession)
    docs = ensure(docs, doc_id="long", text="string", source="string", **({weight: "double"} if weight else {}))
    measured = cut(measure(docs, f"{folder}/work", seed, weight), f"{folder}/measured")
    chosen = cut(plan(measured, f"{folder}/work", weights, share, cap), f"{folder}/plan")
    remove(docs.sparkSession, f"{folder}/work")
    return decide(measured, chosen).select(
        F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"))


def apply(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, weight: str | None = None) -> DataFrame:
    """The mixture itself: every row of docs as often as the mix takes it, columns unchanged (but for the weight, which goes)."""
    folder = shared_dir(docs.sparkSession)
    measured = cut(measure(docs, f"{folder}/work", seed, weight, rows=True), f"{folder}/measured")
    remove(docs.sparkSession, f"{folder}/work")
    chosen = cut(plan(measured.drop("_row"), f"{folder}/work", weights, share, cap), f"{folder}/plan")
    remove(docs.sparkSession, f"{folder}/work")
    return decide(measured, chosen).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


ORACLE = quality_rules.scores_sql(ORDERS) + r""",
m AS (
  SELECT base.doc_id, source, n_words AS size, md5(text) AS tie, least(greatest(1.0::double + coalesce(units, 0)::double / greatest(n_words, 1)::double / 10000.0::double, 0.05::double), 1.5::double) AS weight,
    (('0x' || substr(md5('mix:' || coalesce(cast(base.doc_id AS varchar), md5(text))), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double AS u
  FROM base LEFT JOIN sc USING (rid)),
k AS (SELECT doc_id, source, size, tie, -ln(u) / weight AS key FROM m),
s AS (SELECT source, sum(size)::double AS source_size FROM k GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::double WHEN 1 THEN 1.0::double ELSE 2.0::double END AS weight FROM s),
capped AS (SELECT *, 2.0::double * source_size AS most, 2.0::double * source_size / weight AS ratio FROM ranked),
levels AS (
  SELECT *, (1.5::double * sum(source_size) OVER ()
      - coalesce(sum(most) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::double))
    / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
met AS (SELECT min_by(level, ratio) AS level FROM levels WHERE level <= ratio),
goals AS (
  SELECT c.source, c.source_size, least(c.most, met.level * c.weight) AS target,
    CASE WHEN c.source_size > 0 THEN floor(least(c.most, met.level * c.weight) / c.source_size) ELSE 0 END AS epochs
  FROM capped c CROSS JOIN met),
cum AS (
  SELECT k.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size, tie ROWS UNBOUNDED PRECEDING) - size AS before
  FROM k JOIN goals g ON g.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size::bigint AS size, source_size::bigint AS source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND before + size / 2.0::double <= rest THEN 1 ELSE 0 END))::bigint AS taken FROM cum
"""
