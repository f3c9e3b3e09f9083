"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share `share` of all words; a target stops
at `most` times its source's size, and the others rise together by weight until the sum is met.

Rates: within a source the document rates r in (0, most) that meet the target and lie nearest to most / 2 in (two-sided)
entropy are most / (1 + exp(-t * size / mean)): exponentially tilted odds. The convex dual has one unknown t per source;
its gradient and curvature are aggregates over (source, size) counts, so each Newton step is one small distributed
aggregate, kept inside a bracket that every step narrows. A source whose target is its whole cap takes rate `most`.

Copies: each source's documents are dealt at random to groups of about GROUP. In a group, from the longest document down,
a document takes the whole number of copies from 0 to `most` nearest to its rate plus what longer ones left over or took
too much, counted in words; so what remains is at most about half a short document.

Defined cases: null or empty text has size 0 and takes nothing; a null source is a source of its own; repeated rows are
documents each; null ids are allowed; an empty table gives no rows; other columns are not read. The same rows always give
the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
GROUP, STEPS, CLOSE = 1024, 60, 1e-7
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)).cast("long"), F.lit(0).cast("long")).alias("size"))


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, n, source_size, target of docs (source, size); a row per source, by windows over this small table."""
    by = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # sources reach their caps in the order of cap / weight; `level` would be words per weight if just those before were capped
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / open_)
    # it rises while sources are capped and falls after the first that isn't, so the largest is the level of all that aren't
    return by.select("source", "n", "source_size", F.least("cap", F.max("level").over(every) * F.col("weight")).alias("target"))


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def tilts(counts: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """goals with a tilt each: the root of the dual's gradient. counts: source, size, c."""
    small = goals.withColumnRenamed("source", "s").withColumn("mean", F.col("source_size") / F.col("n"))
    now = store(small.select("s", "n", "source_size", "target", "mean", F.lit(0.0).alias("tilt"), F.lit(-1e7).alias("low"), F.lit(1e7).alias("high"), (F.col("target") >= F.col("source_size") * most).alias("full")), "tilt")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("tilt") * x))
        words = F.col("c") * F.col("size") * F.lit(float(most))
        joined = counts.where("size > 0").join(now.where("not full"), _same("source", "s"))
        step = joined.groupBy("s").agg(F.sum(words * p).alias("got"), F.sum(words * p * (1 - p) * x).alias("curve"))
        both = now.join(step.withColumnRenamed("s", "t"), _same("s", "t"), "left")
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(F.col("got") - F.col("target"), F.col("curve"))
        middle = F.when(low * high < 0, F.when(F.abs(low) + F.abs(high) > 4, F.when(over, F.least(F.col("tilt") * 4, F.lit(-1.0))).otherwise(F.greatest(F.col("tilt") * 4, F.lit(1.0)))).otherwise((low + high) / 2)).otherwise((low + high) / 2)
        then = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        far = F.abs(F.col("got") - F.col("target")) > F.col("target") * CLOSE
        moved = F.col("got").isNotNull() & far
        now = store(both.select("s", "n", "source_size", "target", "mean", F.when(moved, then).otherwise(F.col("tilt")).alias("tilt"), F.when(moved, low).otherwise(F.col("low")).alias("low"), F.when(moved, high).otherwise(F.col("high")).alias("high"), "full", F.coalesce(moved, F.lit(False)).alias("moved")), "tilt")
        if now.where("moved").limit(1).count() == 0:
            break
    # rounding takes away what the order of summing leaves in the last digits
    return now.select("s", "n", "source_size", "target", "mean", F.round("tilt", 9).alias("tilt"), "full")


def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of each row of sized (doc_id, source, size)."""
    sized = store(sized.select("doc_id", "source", "size"), "sized")
    goals = store(targets(sized, weights, share, most), "targets")
    counts = store(sized.groupBy("source", "size").agg(F.count("*").alias("c")), "counts")
    solved = tilts(counts, goals, most)
    # rows alike are numbered by their count, so that they spread over groups too
    alike = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("c"))
    rated = alike.select("source", "doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("i")).join(solved, _same("source", "s"))
    group = F.pmod(F.xxhash64("doc_id", "size", "i"), F.ceil(F.col("n") / GROUP))
    rate = F.when(F.col("full"), float(most)).otherwise(float(most) / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean"))))
    doc = F.struct((-F.col("size")).alias("less"), "doc_id", "size", rate.alias("rate"))
    groups = rated.groupBy("source", group.alias("group")).agg(F.sort_array(F.collect_list(doc)).alias("docs"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))

    def copies(state, d):
        return F.when(d.size > 0, F.least(F.lit(most), F.greatest(F.lit(0), F.round(d.rate + state.left / d.size)))).otherwise(0).cast("int")

    def add(state, d):
        c = copies(state, d)
        return F.struct((state.left + d.size * (d.rate - c)).alias("left"), F.concat(state.out, F.array(c)).alias("out"))

    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<int>").alias("out"))
    folded = groups.withColumn("out", F.aggregate("docs", start, add, lambda s: s.out))
    rows = folded.select("source", "source_size", "target", F.explode(F.arrays_zip("docs", "out")).alias("x"))
    size, c = F.col("x.docs.size"), F.col("x.out")
    return rows.select(F.col("x.docs.doc_id").alias("doc_id"), size.alias("size"), "source_size", "target", (size * c).alias("taken"), c.alias("copies"), "source")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of docs (doc_id, text, source and others), each as often as the mix takes it.

    Rows that share an id take the copies of all of them, dealt to these rows in turn.
    """
    copies = mix(sizes(docs), weights, share, most).groupBy("doc_id").agg(F.sum("copies").alias("c"), F.count("*").alias("m"))
    copies = copies.where("c > 0").withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(copies, F.col("row.doc_id").eqNullSafe(F.col("id")))
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row.text", "row.source")))
    own = F.floor(F.col("c") / F.col("m")) + F.when(turn <= F.col("c") % F.col("m"), 1).otherwise(0)
    alone, shared = rows.where("m = 1").drop("m"), rows.where("m > 1").withColumn("c", own.cast("long")).where("c > 0").drop("m")
    every = alone.unionByName(shared).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    return every.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
