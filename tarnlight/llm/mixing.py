"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A document has a weight, by default the number of binary digits of its size: longer
documents are likelier. Each is expected e = min(cap, level * weight) times, with the
level of its source chosen so that the expected words meet the source's target. Its
whole copies are certain; the rest is its inclusion probability p. With a uniform U
from the document's id and text, documents of a source are ranked by
(U / (1 - U)) / (p / (1 - p)), and a prefix of that order is taken whose words come
closest to the words still wanted: a sample of fixed size, in words, with unequal
probabilities.

Weights keep six significant bits, so a source has few different ones, and levels
are found from a small table of the words of each source and weight. The prefix is
found without sorting a source in one task: the rank is cut into ``CELLS`` cells,
their words are summed with a map-side combine, and only the rows of the one cell a
source's cut falls in are sorted, equal rows as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, numbered, small, table

CELLS = 4096
SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(inner, F.lit("")) == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("bigint")


def uniform(key: Column, salt: str) -> Column:
    """A uniform in (0, 1) with 52 bits from the MD5 of a salt and the key; a null key counts as empty."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)


def row_key(id_col: str, text_col: str) -> Column:
    """The id and the MD5 of the text: what tells rows apart. Rows that share it are alike, so their order is free."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def waterfill(totals: DataFrame, share: float, cap: float, cycle: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``cycle`` repeated. A target is
    min(cap * size, level * weight), where the level is the largest
    (words left) / (weight left) over the sources ordered by cap * size / weight.
    The table has a row a source, of which one task sees them all.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(cycle)
    weighed = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (place + 1).cast("int")))
    most = F.col("source_size") * F.lit(float(cap))
    line = Window.orderBy(most / F.col("w"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    level = left / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level)
    top = F.max("level").over(Window.partitionBy(F.lit(0)))
    return leveled.withColumn("level", top).select("source", "source_size", F.least(most, F.col("level") * F.col("w")).alias("target"))


def expected_copies(classes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(source, weight, source_size, target, e, want) from (source, weight, words) and targets: e = min(cap, level *
    weight) copies of each document, of which ``want`` words of the source are not in whole copies."""
    its = targets.withColumnRenamed("source", "its")
    rows = classes.join(F.broadcast(its) if small(its) is not its else its, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    most, heavy = F.lit(float(cap)) * F.col("words"), F.col("weight") * F.col("words")
    line = Window.partitionBy("source").orderBy(F.desc("weight"))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("source")
    left = F.col("target") - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    level = F.try_divide(left, F.sum(heavy).over(own) - F.coalesce(F.sum(heavy).over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(own))
    rows = rows.withColumn("e", F.coalesce(F.least(F.lit(float(cap)), F.col("level") * F.col("weight")), F.lit(0.0)))
    want = F.col("target") - F.sum(F.floor("e") * F.col("words")).over(own)
    return rows.withColumn("want", want).select("source", "weight", "source_size", "target", "e", "want")


class Mix:
    """The plan of a mix: small tables by source (and weight), and the rows of the cells where the cuts fall."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", size: Column | None = None, source_col: str = "source", share: float = 1.0, cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), weight: Column | None = None, seed: str = "mix", text_col: str = "text") -> None:
        size = F.coalesce(word_count(F.col(text_col)) if size is None else size, F.lit(0)).cast("bigint")
        if weight is None:
            weight = F.length(F.bin(size)).cast("double")
        else:
            weight = F.coalesce(weight.cast("double"), F.lit(1.0))
            step = F.pow(F.lit(2.0), F.floor(F.log2(weight)) - 5)
            weight = F.when((weight > 0) & (weight < float("inf")), F.round(weight / step) * step).otherwise(F.lit(1.0))
        self.own = {"id": F.col(id_col), "source": F.col(source_col), "size": size, "weight": weight, "u": uniform(row_key(id_col, text_col), seed), "mark": F.xxhash64(text_col)}
        self.base = base = cut(docs.select(*[c.alias(k) for k, c in self.own.items()]))
        classes = cut(base.groupBy("source", "weight").agg(F.sum("size").alias("words")))
        targets = cut(waterfill(classes.groupBy("source").agg(F.sum("words").alias("source_size")), share, cap, cycle))
        self.plan = cut(expected_copies(classes, targets, cap))

        rows = self.ranked(base, {k: F.col(k) for k in self.own}).where("p > 0")
        sums = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("want").alias("want"))
        along = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        filled = sums.withColumn("upto", F.sum("words").over(along))
        # The first cell that fills what is wanted; words of the cells before it are taken whole.
        at = filled.where("upto >= want").groupBy("source").agg(F.min("cell").alias("at"), F.min_by(F.col("want") - F.col("upto") + F.col("words"), "cell").alias("rest"))
        every = self.plan.groupBy("source").agg(F.lit(CELLS + 1).cast("bigint").alias("none")).withColumnRenamed("source", "its")
        at = every.join(at, F.col("its").eqNullSafe(F.col("source")), "left")
        self.cuts = cut(at.select("its", F.coalesce("at", "none").alias("at"), F.coalesce("rest", F.lit(0.0)).alias("rest")))

        edge = self.placed(rows).where("cell = at")
        edge = edge.groupBy("source", "z", "id", "mark", "size", "weight", "rest").agg(F.count("*").alias("rows"))
        run = Window.partitionBy("source").orderBy("z", "id", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum(F.col("size") * F.col("rows")).over(run), F.lit(0))
        fit = F.when(F.col("size") > 0, F.floor((F.col("rest") - ahead) / F.col("size") + 0.5)).otherwise(F.when(ahead <= F.col("rest"), F.col("rows")).otherwise(0))
        more = F.least(F.col("rows"), F.greatest(fit, F.lit(0))).cast("bigint")
        self.edge = cut(edge.withColumn("more", more).select("source", "id", "mark", "size", "weight", "rows", "more"))

    def ranked(self, rows: DataFrame, own: dict[str, Column]) -> DataFrame:
        """``rows`` with their source's and weight's plan, p, z (rank in (0, 1): q / (1 + q)) and cell."""
        names = list(rows.columns)
        plan = self.plan.withColumnRenamed("source", "its").withColumnRenamed("weight", "class")
        rows = rows.withColumns({k: c for k, c in own.items() if k not in names})
        rows = rows.join(small(plan), own["source"].eqNullSafe(F.col("its")) & (F.col("weight") == F.col("class"))).drop("its", "class")
        rows = rows.withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
        odds, chance = F.col("u") * (1 - F.col("p")), (1 - F.col("u")) * F.col("p")
        return rows.withColumn("z", F.when(F.col("p") > 0, odds / (odds + chance))).withColumn("cell", F.floor(F.col("z") * CELLS))

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.join(small(self.cuts), F.col("source").eqNullSafe(F.col("its"))).drop("its")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken. Further arguments of :class:`Mix`.

    ``size`` defaults to the words of the text (null: 0). A document is expected as
    often as its ``weight`` says among those of its source, at most ``cap`` times
    (default: binary digits of the size; null, not positive or not finite: 1).
    Null is a source of its own. Sources without words have target 0. Rows are
    told apart by id and text, so reruns agree; rows equal in both tie, and as many
    of them are taken as fit. Very long texts count whole. An empty table gives an
    empty result; other columns are ignored.
    """
    mix = Mix(docs, id_col, **kw)
    rows = mix.ranked(mix.base, {k: F.col(k) for k in mix.own})
    done = ["id", "source", "size", "source_size", "target"]
    sure = mix.placed(rows).where("cell IS NULL OR cell <> at")
    sure = sure.select(*done, (F.col("whole") + F.coalesce((F.col("cell") < F.col("at")).cast("int"), F.lit(0))).alias("copies"))
    edge = numbered(mix.edge, "rows", "place").withColumnRenamed("source", "s0").withColumnRenamed("weight", "w0")
    plan = mix.plan.select(F.col("source"), F.col("weight"), "source_size", "target", F.floor("e").alias("whole"))
    edge = edge.join(small(plan), F.col("s0").eqNullSafe(F.col("source")) & (F.col("w0") == F.col("weight")))
    edge = edge.select(*done, (F.col("whole") + (F.col("place") < F.col("more")).cast("int")).alias("copies"))
    out = sure.unionByName(edge).withColumn("copies", F.col("copies").cast("bigint"))
    return out.select(F.col("id").alias(id_col), *done[1:], "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns and no others.

    A row's copies follow from its own columns and the small tables of the plan;
    only rows of the cells where a cut falls are looked up. Awkward input: as
    :func:`mix_sources` says; of rows equal in id and text, the first by their
    other columns are taken.
    """
    mix = Mix(docs, id_col, **kw)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(k) for k, c in mix.own.items()])
    rows = mix.placed(mix.ranked(packed, {k: F.col(k) for k in mix.own}))
    whole = F.col("whole").cast("bigint")
    sure = rows.where("cell IS NULL OR cell <> at").select("_row", (whole + F.coalesce((F.col("cell") < F.col("at")).cast("bigint"), F.lit(0))).alias("copies"))
    edge = rows.where("cell = at").select("_row", "id", "mark", "source", whole.alias("whole"))
    to = mix.edge.select(*[F.col(c).alias(f"{c}0") for c in ("id", "mark", "source")], "rows", "more")
    edge = edge.join(small(to), F.col("id").eqNullSafe(F.col("id0")) & F.col("mark").eqNullSafe(F.col("mark0")) & F.col("source").eqNullSafe(F.col("source0")))
    alone = edge.where("rows = 1").select("_row", (F.col("whole") + F.col("more")).alias("copies"))
    place = F.row_number().over(Window.partitionBy("id", "mark", "source").orderBy(F.xxhash64("_row")))
    several = edge.where("rows > 1").withColumn("place", place).select("_row", (F.col("whole") + (F.col("place") <= F.col("more")).cast("bigint")).alias("copies"))
    return numbered(sure.unionAll(alone).unionAll(several), "copies", "_copy").select("_row.*")


def op4_pareto_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "taken")


_U = "(cast('0x' || substr(md5('mix' || coalesce(cast(doc_id AS varchar), '') || md5(coalesce(text, ''))), 1, 13) AS bigint) + 0.5) / 4503599627370496.0"
SQL_OP4 = rf"""
WITH base AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS mark, {_U} AS u,
         coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size
  FROM documents
), weighed AS (SELECT *, length(bin(size))::DOUBLE AS weight FROM base),
classes AS (SELECT source, weight, sum(size)::DOUBLE AS words FROM weighed GROUP BY ALL),
totals AS (SELECT source, sum(words) AS t, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM classes GROUP BY source),
leveled AS (
  SELECT source, t, w, (sum(t) OVER () - coalesce(sum(3.0::DOUBLE * t) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM totals WINDOW b AS (ORDER BY 3.0 * t / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (SELECT source, t, least(3.0::DOUBLE * t, max(level) OVER () * w) AS target FROM leveled),
own AS (
  SELECT c.source, weight, words, t, target,
         (target - coalesce(sum(3.0::DOUBLE * words) OVER b, 0)) / nullif(sum(weight * words) OVER (PARTITION BY c.source) - coalesce(sum(weight * words) OVER b, 0), 0) AS level
  FROM classes c JOIN targets s ON c.source IS NOT DISTINCT FROM s.source
  WINDOW b AS (PARTITION BY c.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), copies AS (SELECT *, coalesce(least(3.0::DOUBLE, max(level) OVER (PARTITION BY source) * weight), 0) AS e FROM own),
plan AS (SELECT *, target - sum(floor(e) * words) OVER (PARTITION BY source) AS want FROM copies),
z AS (
  SELECT b.doc_id, b.source, b.size, b.mark, p.t, p.target, p.want, floor(p.e) AS whole, p.e - floor(p.e) AS p,
         CASE WHEN p.e > floor(p.e) THEN u * (1 - (p.e - floor(p.e))) / (u * (1 - (p.e - floor(p.e))) + (1 - u) * (p.e - floor(p.e))) END AS z
  FROM weighed b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source AND b.weight = p.weight
), o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY z NULLS LAST, doc_id, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM z)
SELECT doc_id, size, t::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN p > 0 AND ahead + size / 2.0 <= want THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
