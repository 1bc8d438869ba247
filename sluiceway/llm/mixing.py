"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: its share by weight of the whole mix, at most CEILING times its own words, the
excess shared again by weight until none is above. A source takes floor(target / words) certain whole copies of all its
documents. What is left of the target is drawn with one more copy each from a fixed-size unequal-probability sample.
A document's inclusion probability grows with the square root of its length; the factor is solved for each source, from
sums by size class, so that the expected words are those needed, and documents whose probability would reach one are
certain. Documents are ranked by their random odds divided by their inclusion odds, and taken in that order until the
words are reached (a document is taken if that brings the sum nearer).

Randomness is a digest of seed, id and text, so reruns agree. No source is sorted in one task: words are summed by
(source, slice of the rank), only the slice that the target falls into is ordered, and the result is one threshold per
source, which is joined to the documents. Equal rows share a rank; how many of the group at the threshold are taken is
part of the plan, and only that group's rows are numbered. Sources may be many: their places are numbered in ranges, and
the level that targets are filled to is found by repeated sums, each of which goes to the driver as one row.

Defined cases: a null text has size 0; documents of size 0 take part in certain copies only and take no words; a null
source is a source of its own and the last; a null id counts as a number below all others, so null ids with different
texts draw different numbers; of equal rows as many are taken as the target needs; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import stored
from sluiceway.llm.numbering import numbered
from sluiceway.skew import broadcast_if_small

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-1"
SLICES = 16384
# Size classes for one doubling of the size.
CLASSES = 16
WIDE = "decimal(38,0)"
ALL = 1 << 62


def size_of(text: Column) -> Column:
    """Number of runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def own_columns(id_col: str, source_col: str, text_col: str) -> list[Column]:
    """What the mix knows of a document: id (null as the smallest number), source, digest of the text, size."""
    return [
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), size_of(F.col(text_col)).alias("size")]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, id, digest, size) of every document, stored; the one time that the plan reads the texts."""
    return stored(docs.select(*own_columns("doc_id", "source", "text")), "sizes")


def uniform(seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest; the same for the same id and text."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id"), F.col("digest"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rank_of(factor: Column, seed: str) -> Column:
    """Random odds over inclusion odds; below zero, in random order, for a document that is certain."""
    u, p = uniform(seed), factor * F.sqrt("size")
    return F.when(p >= 1, u - 1).otherwise((u / (1 - u)) * ((1 - p) / p))


def slice_of(rank: Column, share: Column) -> Column:
    """Which of the slices a rank lies in; even ones for documents whose probability is the source's `share`."""
    odds = F.least(F.greatest(share / F.greatest(1 - share, F.lit(1e-9)), F.lit(1e-9)), F.lit(1e9))
    return F.floor(F.when(rank < 0, rank).otherwise(rank * odds / (1 + rank * odds)) * SLICES)


def filled_level(weighed: DataFrame, ceiling: int) -> tuple[int, int]:
    """(words left, weight left) of the sources that stay below their ceiling; their targets are weight * left / weight left.

    Each round sums up the sources that the level so far fills; the level only rises, and stops when no more are filled."""
    whole = weighed.agg(F.sum(F.col("source_size").cast(WIDE)).alias("words"), F.sum(F.col("w").cast(WIDE)).alias("w")).first()
    total, heavy_all = int(whole.words or 0), int(whole.w or 0)
    left, heavy, before = total, heavy_all, -1
    while True:
        full = is_full(left, heavy, ceiling)
        seen = weighed.where(full).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("source_size").cast(WIDE)).alias("words"), F.sum(F.col("w").cast(WIDE)).alias("w")).first()
        if seen.n == before:
            return left, heavy
        left, heavy, before = total - ceiling * int(seen.words or 0), heavy_all - int(seen.w or 0), seen.n


def is_full(left: int, heavy: int, ceiling: int) -> Column:
    return F.col("w").cast(WIDE) * F.lit(Decimal(left)) > (F.col("source_size") * ceiling).cast(WIDE) * F.lit(Decimal(heavy))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """One row per source: words, target, certain copies, words still to draw."""
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit("")), "source-sums")
    listed = F.array(*[F.lit(w) for w in weights])
    places = numbered(sums, "all", [F.col("source").asc_nulls_last()], "source-places")
    weighed = stored(places.select("source", "source_size", F.get(listed, F.pmod("pos", F.lit(len(weights))).cast("int")).cast("long").alias("w")), "source-weights")
    left, heavy = filled_level(weighed, ceiling)
    level = left / heavy if heavy else 0.0
    target = F.when(is_full(left, heavy, ceiling), (ceiling * F.col("source_size")).cast("double")).otherwise(F.col("w") * F.lit(float(level)))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(ceiling), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    return weighed.withColumn("target", target).withColumn("whole", whole).select(
        "source", "source_size", "target", "whole", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")).alias("needed"))


def inclusion_factors(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, factor): a document of size s is included with probability min(1, factor * sqrt(s)), and the expected
    words of a source are those needed. Classes of like sizes are taken for certain from the largest down, until the
    factor that is left for the others is below the odds of the next class."""
    classed = sized.where("size > 0").groupBy("source", F.floor(F.log2("size") * CLASSES).cast("int").alias("class")).agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.sqrt("size")).alias("pull"), F.max("size").alias("largest"))
    c, t = classed.alias("c"), broadcast_if_small(targets.where("needed > 0").select("source", "needed")).alias("t")
    known = c.join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "t.needed")
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("pull").over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = known.select("source", "class", "largest", ((F.col("needed") - above) / rest).alias("factor"))
    fits = tried.where((F.col("factor") * F.sqrt("largest") < 1) & (F.col("factor") > 0))
    # Nothing fits if only certain documents are left to reach the words with.
    return tried.groupBy("source").agg(F.max("factor").alias("most")).alias("a").join(
        fits.groupBy("source").agg(F.max_by("factor", "class").alias("factor")).alias("f"), F.col("a.source").eqNullSafe(F.col("f.source")), "left"
    ).select("a.source", F.coalesce("f.factor", F.greatest("a.most", F.lit(1e-9))).alias("factor"))


def source_thresholds(sized: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """`targets` with each source's factor, the key of the last group of equal rows drawn (null: none) and how many of it."""
    factors = inclusion_factors(sized, targets)
    t, f = targets.alias("t"), factors.alias("f")
    known = stored(t.join(f, F.col("t.source").eqNullSafe(F.col("f.source")), "left").select("t.*", "f.factor"), "factors")
    s, k = sized.where("size > 0").alias("s"), broadcast_if_small(known.where("needed > 0 and factor is not null")).alias("k")
    ranked = s.join(k, F.col("s.source").eqNullSafe(F.col("k.source"))).select(
        "s.source", "id", "digest", "size", "needed", rank_of(F.col("factor"), seed).alias("rank"), (F.col("needed") / F.col("source_size")).alias("share"))
    ranked = ranked.withColumn("slice", slice_of(F.col("rank"), F.col("share")))
    key = F.struct("rank", "id", "digest")
    summed = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.max("needed").alias("needed"), F.max(key).alias("last"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ordered = summed.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    # The slice the target falls into, and the last slice that lies whole below it.
    edge = ordered.where("before < needed and before + words >= needed").select("source", "slice", "before")
    below = ordered.where("before + words < needed").groupBy("source").agg(F.max("last").alias("below"))
    a, b = ranked.alias("a"), broadcast_if_small(edge).alias("b")
    inside = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.slice") == F.col("b.slice"))).groupBy(
        "a.source", key.alias("key")).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.max("needed").alias("needed"), F.max("before").alias("before"))
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(running), F.lit(0))
    wanted = F.floor((F.col("needed") - reached) / F.col("size") + 0.5)
    taken = inside.withColumn("part", F.least("rows", wanted)).where("part >= 1")
    within = taken.groupBy("source").agg(F.max(F.struct("key", "part")).alias("inside"))
    t, i, w = known.alias("t"), within.alias("i"), below.alias("w")
    return t.join(i, F.col("t.source").eqNullSafe(F.col("i.source")), "left").join(w, F.col("t.source").eqNullSafe(F.col("w.source")), "left").select(
        "t.source", "source_size", "target", "whole", "factor", F.coalesce("i.inside.key", "w.below").alias("last"), F.coalesce("i.inside.part", F.lit(ALL)).alias("part"))


def plan_sized(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """One row per source with its threshold, from the documents' `sizes`."""
    targets = stored(source_targets(sized, weights, ceiling), "targets")
    return stored(source_thresholds(sized, targets, seed), "thresholds")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """One row per source with its threshold."""
    return plan_sized(sizes(docs), weights, ceiling, seed)


def with_copies(rows: DataFrame, plan: DataFrame, carried: list[str], seed: str = SEED) -> DataFrame:
    """`carried` columns of `rows`, which have those of `sizes`, with their source's plan and the copies to take."""
    r, p = rows.alias("r"), broadcast_if_small(plan).alias("p")
    key = F.struct(rank_of(F.col("factor"), seed).alias("rank"), F.col("id"), F.col("digest"))
    joined = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "source_size", "target", "whole", "last", "part", key.alias("key"))
    drawn = (F.col("size") > 0) & F.col("last").isNotNull()
    at_edge = F.coalesce(drawn & (F.col("key") == F.col("last")) & (F.col("part") < ALL), F.lit(False))
    plain = joined.where(~at_edge).withColumn("copies", F.col("whole") + F.when(drawn & (F.col("key") <= F.col("last")), 1).otherwise(0))
    edge = joined.where(at_edge).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("group"), F.struct(*joined.columns).alias("row"))
    numbers = numbered(stored(edge, "edge-rows"), "group", [F.col("row.id")], "edge-places")
    counted = numbers.select("row.*", F.col("pos").alias("copies")).withColumn("copies", F.col("whole") + F.when(F.col("copies") < F.col("part"), 1).otherwise(0))
    columns = [*carried, "source_size", "target", F.col("copies").cast("long").alias("copies")]
    return plain.select(*columns).unionByName(counted.select(*columns))


def mix(sized: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    return with_copies(sized, plan, ["doc_id", "source", "size"], seed).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns only."""
    rows = docs.select(*own_columns("doc_id", "source", "text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    taken = with_copies(rows, plan, ["document"], seed)
    return taken.select("document", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("document.*")
