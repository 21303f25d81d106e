"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
#: Newton steps at most; the solver ends sooner when no multiplier moves by more than STILL, or when steps of NOISE or less no longer shrink.
NEWTON_STEPS, STILL, NOISE = 100, 1e-12, 1e-7
#: Steps below this lie where Newton's method converges by itself; halves of a longer one, and the share of the promised fall that is enough.
SMALL, HALVES, ENOUGH = 1e-3, 40, 1e-4
#: How far the mix may leave the corpus' mean logarithmic length: the square of its multiplier costs this share of all words.
RIDGE = 0.1
#: Digits of a rate; more would let the last bits of the solver decide roundings.
RATE_DIGITS = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def token_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """source, source_size -> + weight, target: shares by weight of share * all, each at most cap * its source.

    The shares above their cap are set to it and the excess goes to the others by weight until none is above: the
    level at which water stands in vessels of width `weight` and height cap / weight. With one row per source,
    sorted by height, the level follows from running sums.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1)
    t = totals.withColumn("weight", w.cast("bigint")).withColumn("top", F.col("source_size") * cap)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("top").over(order), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    t = t.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - full) / rest)
    # while the vessels so far are full the levels rise, and after that they fall
    return t.withColumn("target", F.least(F.col("top").cast("double"), F.max("level").over(every) * F.col("weight"))).drop("top", "level")


def balanced_rates(cells: DataFrame, targets: DataFrame, cap: int = MAX_COPIES, steps: int = NEWTON_STEPS) -> DataFrame:
    """(_src, size, same) -> + source_size, target, rate: how often a row of that source and size is taken, by entropy balancing.

    Of all rates between 0 and cap, those of largest entropy by word (of a rate's share of cap, and of the rest of it) that give each source its target and leave the
    corpus' mean logarithmic length of documents, by word, as it is. Their odds r / (cap - r) are exp(a + b * z): a is the source's
    multiplier, z a document's logarithmic length less the mean, and b the multiplier that all sources share. Both
    minimise the convex dual by Newton steps from the rates of b = 0: each is one aggregation over the cells, whose gradient and Hessian by source
    form an arrow around b, which two sums over the sources solve. A step that moves some multiplier by SMALL or more is halved until the dual falls by a share of
    what its slope promises; one more aggregation gives the dual at all halves. No source's data pass the driver, some sums a step do.
    The length constraint is soft (RIDGE), since sources near their cap leave little choice, and makes the dual strictly convex, so that steps settle for any sizes.
    """
    spark = cells.sparkSession
    with storage.scratch(spark) as table:
        words = F.col("size") * F.col("same")
        total, mean = cells.agg(F.sum(words), F.try_divide(F.sum(words * F.log1p("size")), F.sum(words))).first()
        ridge, mean = RIDGE * float(total or 0) + 1e-300, float(mean or 0.0)
        known = targets.select("_src", "source_size", "target", (F.col("target") >= F.col("source_size") * cap).alias("full"))
        c = table(cells.join(known, "_src").withColumn("z", F.log1p("size") - mean).withColumn("w", words.cast("double")), "cells")
        fixed = F.col("full") | (F.col("target") <= 0)
        start = F.col("target") / (F.col("source_size") * cap)
        state = known.select("_src", F.when(fixed, F.lit(0.0)).otherwise(F.log(start / (1 - start))).alias("a"))

        def rate(b: float) -> Column:
            tilted = cap / (1 + F.exp(-(F.col("a") + b * F.col("z"))))
            return F.when(F.col("full"), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(tilted)

        def dual(t: float, b: float, db: float) -> Column:
            """A cell's part of the dual at the share t of a step; sources whose rates are fixed only pull at b."""
            e = F.col("a") + t * F.col("da") + (b + t * db) * F.col("z")
            at_cap = F.when(F.col("full"), F.col("w") * F.col("z") * cap * (b + t * db)).otherwise(0.0)
            return F.when(fixed, at_cap).otherwise(F.col("w") * cap * (F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e)))))

        b, most, before = 0.0, float("inf"), float("inf")
        for _ in range(steps):
            r = rate(b)
            moving = F.when(fixed, F.lit(0.0)).otherwise(F.col("w") * r * (1 - r / cap))
            per = c.join(state, "_src").groupBy("_src", "a", "full", "target").agg(
                F.sum(F.col("w") * r).alias("sum"), F.sum(F.col("w") * r * F.col("z")).alias("gz"),
                F.sum(moving).alias("h"), F.sum(moving * F.col("z")).alias("hz"), F.sum(moving * F.col("z") * F.col("z")).alias("zz"),
            )
            per = table(per.withColumn("g", F.when(fixed, F.lit(0.0)).otherwise(F.col("sum") - F.col("target"))), "step")
            some = F.when(F.col("h") > 0, F.col("hz") / F.col("h")).otherwise(0.0)
            slope, curve = per.agg(F.sum(F.col("gz") - some * F.col("g")), F.sum(F.col("zz") - some * F.col("hz"))).first()
            step_b = -((slope or 0.0) + ridge * b) / ((curve or 0.0) + ridge)
            per = per.withColumn("da", F.when(F.col("h") > 0, -(F.col("g") + F.col("hz") * step_b) / F.col("h")).otherwise(0.0))
            most_a, promised, pull = per.agg(F.max(F.abs("da")), F.sum(F.col("g") * F.col("da") + F.col("gz") * step_b), F.sum(F.when(fixed, 0.0).otherwise(F.col("target") * F.col("da")))).first()
            most, promised, pull = max(most_a or 0.0, abs(step_b)), promised or 0.0, pull or 0.0
            share = 1.0
            if most >= SMALL:
                tries = [2.0**-k for k in range(HALVES)]
                at = c.join(per.select("_src", "a", "da"), "_src").agg(*(F.sum(dual(t, b, step_b)) for t in [0.0, *tries])).first()
                value = [v - t * pull + ridge * (b + t * step_b) ** 2 / 2 for v, t in zip(at, [0.0, *tries], strict=True)]
                promised += ridge * b * step_b
                share = next((t for v, t in zip(value[1:], tries, strict=True) if v <= value[0] + ENOUGH * t * promised), tries[-1])
            state, b = per.select("_src", (F.col("a") + share * F.col("da")).alias("a")), b + share * step_b
            if most < STILL or before <= NOISE and most >= before / 2:
                break
            before = most
        if most > 10 * NOISE:
            raise ArithmeticError("the multipliers have not settled")
        out = c.join(state, "_src").select("_src", "size", "same", "source_size", "target", F.round(rate(b), RATE_DIGITS).alias("rate"))
        return storage.table(out, "rates")


def _copies(docs: DataFrame, keep: list[str], weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    size, key = word_count(F.col("text").cast("string")), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    tie = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = docs.select("doc_id", "source", size.alias("size"), key.alias("_key"), tie.alias("_tie"), *(F.col(f"`{c}`").alias(f"_keep{k}") for k, c in enumerate(keep)))
    sized = base.withColumn("_bucket", F.substring("_key", 1, 2)).withColumn("_src", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
    if not keep:
        sized = storage.table(sized, "sizes")
    cells = storage.table(sized.groupBy("_src", "source", "size", "_bucket").agg(F.count("*").alias("n")), "cells")
    totals = cells.groupBy("_src", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sizes = balanced_rates(cells.groupBy("_src", "size").agg(F.sum("n").alias("same")), token_targets(totals, weights, share, cap), cap)
    # the running sum of rates in whole units, so that no order of summation decides a rounding
    unit = 10**RATE_DIGITS
    due = (F.round(F.col("rate") * unit) * F.col("same")).cast("decimal(38,0)")
    upto = F.sum(due).over(Window.partitionBy("_src").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    half = lambda n: F.floor((n + unit // 2) / unit)
    sizes = sizes.withColumn("_k", F.least((half(upto) - half(upto - due)).cast("bigint"), F.col("same") * cap))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("_src", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = cells.drop("source").withColumn("_ahead", ahead).drop("n").join(sizes, ["_src", "size"])
    rank = F.row_number().over(Window.partitionBy("_src", "size", "_bucket").orderBy("_key", "doc_id", "_tie"))
    dealt = sized.withColumn("_rank", rank).join(plan, ["_src", "size", "_bucket"])
    extra = (F.col("_ahead") + F.col("_rank") <= F.col("_k") % F.col("same")).cast("bigint")
    return dealt.withColumn("copies", (F.floor(F.col("_k") / F.col("same")) + extra).cast("bigint"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """Each row with how many copies of it the mix takes: doc_id, source, size, source_size, target, rate, copies, taken.

    Sizes are words; a null or empty text has none, a null source is a source of its own (last), a null doc_id is an
    identifier like any other; repeated rows count each; an empty table stays empty; other columns, whatever their names, are left out; texts of any
    length are only counted.

    Rounding: within a source, rows of one size are exchangeable. Along growing size, the running sum of rates is
    rounded, so the copies up to any size are within a half of the sum of rates, and the source's words within
    about its longest document of the target. Within a size, each row gets the whole part and the first by
    MD5 of the identifier, then of the text, one more; their ranks come from counts of MD5 buckets, so a large group of identifiers is dealt over
    256 buckets. Nothing depends on order or partitions: reruns agree.
    """
    out = _copies(docs, [], weights, share, cap).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """The rows of docs, all columns as they are and whatever their names, each as often as the mix takes it; see mix_sources."""
    rows = _copies(docs, docs.columns, weights, share, cap).where("copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*(F.col(f"_keep{k}").alias(c) for k, c in enumerate(docs.columns)))


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k, md5(coalesce(text, '')) AS tie
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM totals WINDOW b AS (ORDER BY (2 * source_size) / w::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (max(lev) OVER ())::DOUBLE * w) AS target FROM levels
), grouped AS (
  SELECT source, size, count(*)::BIGINT AS same, (size * count(*))::DOUBLE AS w FROM sized GROUP BY source, size
), cells AS MATERIALIZED (
  SELECT g.*, source_size, target, target >= 2 * source_size AS filled, ln(1 + g.size::DOUBLE) - (SELECT sum(w * ln(1 + size::DOUBLE)) / sum(w) FROM grouped) AS z,
    (SELECT 0.1 * sum(w) + 1e-300 FROM grouped) AS ridge
  FROM grouped g JOIN targets t ON g.source IS NOT DISTINCT FROM t.source
), newton AS (
  SELECT 0 AS step, source, CASE WHEN target >= 2 * source_size OR target <= 0 THEN 0.0::DOUBLE ELSE ln(target / (2 * source_size) / (1 - target / (2 * source_size))) END AS a, 0.0::DOUBLE AS b, false AS still FROM targets
  UNION ALL
  SELECT step + 1, source, a + da * damp, b + db * damp, most < 1e-12
  FROM (
    SELECT *, greatest(max(abs(da)) OVER (), abs(db), 1e-300) AS most, least(1, 1 / most) AS damp
    FROM (
      SELECT *, CASE WHEN h > 0 THEN -(g + hz * db) / h ELSE 0 END AS da
      FROM (
        SELECT *, -(sum(gz - CASE WHEN h > 0 THEN hz / h ELSE 0 END * g) OVER () + ridge * b) / (sum(zz - CASE WHEN h > 0 THEN hz / h ELSE 0 END * hz) OVER () + ridge) AS db
        FROM (
          SELECT step, source, a, b, ridge, CASE WHEN fixed THEN 0 ELSE sum(w * r) - target END AS g, sum(w * r * z) AS gz, sum(m) AS h, sum(m * z) AS hz, sum(m * z * z) AS zz
          FROM (
            SELECT *, CASE WHEN fixed THEN 0 ELSE w * r * (1 - r / 2) END AS m
            FROM (
              SELECT n.step, n.a, n.b, c.*, filled OR target <= 0 AS fixed, CASE WHEN filled THEN 2.0::DOUBLE WHEN target <= 0 THEN 0 ELSE 2 / (1 + exp(-(n.a + n.b * c.z))) END AS r
              FROM newton n JOIN cells c ON n.source IS NOT DISTINCT FROM c.source WHERE n.step < 1000 AND NOT n.still
            )
          ) GROUP BY step, source, a, b, fixed, ridge, target
        )
      )
    )
  )
), rates AS (
  SELECT c.*, CASE WHEN filled THEN 2 WHEN target <= 0 THEN 0 ELSE round(2 / (1 + exp(-(n.a + n.b * c.z))), 7) END AS rate
  FROM cells c JOIN newton n ON n.step = (SELECT max(step) FROM newton) AND n.source IS NOT DISTINCT FROM c.source
), due AS (
  SELECT *, (round(rate * 10000000) * same)::HUGEINT AS d, sum((round(rate * 10000000) * same)::HUGEINT) OVER (PARTITION BY source ORDER BY size) AS u FROM rates
), sizes AS (
  SELECT *, least((u + 5000000) // 10000000 - (u - d + 5000000) // 10000000, 2 * same)::BIGINT AS k FROM (SELECT * REPLACE (u::HUGEINT AS u) FROM due)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY k, doc_id NULLS FIRST, tie) AS rn FROM sized
)
SELECT d.doc_id, d.source, d.size, z.source_size, z.target, z.rate::DOUBLE AS rate, (z.k // z.same + (d.rn <= z.k % z.same)::INT)::BIGINT AS copies,
  ((z.k // z.same + (d.rn <= z.k % z.same)::INT) * d.size)::BIGINT AS taken
FROM ranked d JOIN sizes z ON d.source IS NOT DISTINCT FROM z.source AND d.size = z.size
"""
