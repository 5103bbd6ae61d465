"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import stored
from .ranks import RANGE, TIE, ranges, running, shuffle_key

GRID = 1024        # cells in which schedule points meet the sources' intervals
CHUNK = 1 << 14    # schedule steps whose slots one window ranks


def targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0,
            source_col: str = "source", size_col: str = "size") -> DataFrame:
    """One row per source: ``source``, ``source_size`` and ``target``, in the unit of the sizes.

    Sources in code point order (NULL last) take the weights in turn, over and over. They share the
    sum of all sizes by weight; a target stops at ``most`` times its source's size, and the excess is
    shared again by weight until none is above. In closed form: with sources ordered by limit over
    weight, all up to some place stop, and the others take what is left in proportion.

    Runs on one row per source.
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    limit = (F.col("source_size") * float(most)).alias("__limit")
    per = per.withColumn("__w", weight).select("*", limit)
    tight = Window.orderBy(F.col("__limit") / F.col("__w"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(0, Window.unboundedFollowing)
    everything = tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything).cast("double")
              - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum("__w").over(after))
    # The level rises as long as sources stop and falls from the first that does not.
    per = per.withColumn("__level", level).withColumn("__level", F.max("__level").over(everything))
    target = F.least(F.col("__limit"), F.col("__level") * F.col("__w"))
    return per.select("source", "source_size", target.alias("target"))


def _cut(block: str) -> Column:
    """Where a block begins in its source's stream: sizes of blocks differ by one word at most."""
    return F.expr(f"cast({block} as decimal(18,0)) * cast(source_size as decimal(18,0)) div blocks")


def schedule(spark, plan: DataFrame) -> DataFrame:
    """Slots in the order of the mix: ``step``, ``source``, ``block``, ``turn`` and ``words`` (the words the
    slot takes from the start of its block; only a source's last slot may take less than all).

    Van der Corput points are the bit-reversed step numbers on a grid of 2^m >= all slots. Mapped
    through the cumulative slot counts, points past the end skipped, they visit every place once, so
    each source gets exactly its slots, spread as evenly as the sequence is. The r-th slot of a source
    takes block r modulo its number of blocks, so no block comes again before all others came.
    """
    ends = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    laid = plan.where("slots > 0").withColumn("__hi", F.sum("slots").over(ends)).withColumn(
        "__lo", F.col("__hi") - F.col("slots"))
    slots = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, int(slots - 1).bit_length()) if slots else 1
    steps = spark.range(1 << bits if slots else 0).withColumnRenamed("id", "step")
    point = F.conv(F.reverse(F.lpad(F.bin("step"), bits, "0")), 2, 10).cast("long")
    width = -(-slots // GRID) or 1
    points = (steps.withColumn("__at", point).where(F.col("__at") < slots)
              .withColumn("__cell", F.expr(f"__at div {width}")))
    spans = laid.withColumn("__cell", F.explode(F.sequence(F.expr(f"__lo div {width}"),
                                                           F.expr(f"(__hi - 1) div {width}"))))
    drawn = (points.join(spans, "__cell").where("__at >= __lo AND __at < __hi")
             .select("step", "source", "source_size", "blocks", "__full", "__take"))
    ranked = running(drawn, ["source"], F.expr(f"step div {CHUNK}"), [F.col("step")], before="__r", total="__n")
    start, end = _cut("__r % blocks"), _cut("__r % blocks + 1")
    taken = F.least(end, F.col("__take")) - start
    whole = F.expr("__r div blocks < __full")
    return ranked.select("step", "source", F.expr("__r % blocks").alias("block"), F.expr("__r div blocks").alias("turn"),
                         F.when(whole, end - start).otherwise(taken).cast("long").alias("words"))


def mix(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0,
        block_words: int = 256, seed: int = 11, id_col: str = "doc_id", source_col: str = "source",
        size_col: str = "size") -> tuple[DataFrame, DataFrame]:
    """``sizes`` with ``source_size``, ``target``, ``taken``, ``n_slots`` (the slots of the schedule that take words of the
    row) and ``first_step`` (the step of the first of them; NULL if there is none), and the schedule of :func:`schedule`.

    A source's rows are shuffled by a seeded key and stand one after another as a stream of words, cut
    into blocks of about ``block_words`` words, equal to within one word. The schedule takes blocks in
    turn until the source has its target, rounded down to a word; ``taken`` sums the words of a row's
    blocks, repeats counted. So a row is taken at most ``most`` times and the mix is the same on each run.

    Rows without words (NULL or empty texts) take part with ``taken`` 0. Equal rows and equal ids are
    rows of their own. NULL is a source like any other. An empty table gives an empty one. Further columns are
    carried through, but for those called ``source_size``, ``target``, ``taken``, ``n_slots``, ``first_step``, ``blocks`` or
    ``block``.

    No source, and no id, is held by one task: streams are laid out in sampled ranges of (source, shuffle key), and blocks
    and slots are joined on (source, block).
    """
    sizes = sizes.drop("source_size", "target", "taken", "n_slots", "first_step", "blocks", "block")
    plan = targets(sizes, weights, most, source_col, size_col)
    quota = F.floor("target").cast("long")
    n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    plan = (plan.withColumn("blocks", n).withColumn("__quota", quota)
            .withColumn("__full", F.expr("__quota div greatest(source_size, 1)"))
            .withColumn("__take", F.expr("__quota % greatest(source_size, 1)"))
            .withColumn("__last", F.expr("(cast(__take as decimal(18,0)) * cast(blocks as decimal(18,0)) + source_size - 1) "
                                          "div greatest(source_size, 1)"))
            .withColumn("slots", F.expr("__full * blocks + __last")))
    plan = stored(plan, "mix-plan")
    slots = stored(schedule(sizes.sparkSession, plan), "mix-slots")

    ident, size = F.col(id_col), F.col(size_col)
    keyed = sizes.withColumn("__key", shuffle_key(ident, seed))
    dealt = ranges(keyed, [F.xxhash64(source_col), F.col("__key"), ident, size])
    streams = running(dealt, [source_col], F.col(RANGE), [F.col("__key"), ident, size, F.col(TIE)],
                      size, before="__start", total="__sum")
    known = plan.select(F.col("source").alias("__source"), "source_size", "target", "blocks")
    streams = streams.join(known, F.col(source_col).eqNullSafe(F.col("__source"))).drop("__source", "__sum")
    streams = stored(streams, "mix-streams")
    # The block that holds word w is w * blocks div source_size or the next one, as cuts are rounded down.
    near = "cast({} as decimal(18,0)) * cast(blocks as decimal(18,0)) div source_size"
    first = F.expr(near.format("__start"))
    last = F.expr(f"least(blocks - 1, {near.format(f'(__start + `{size_col}` - 1)')} + 1)")
    begin, end = _cut("block"), _cut("block + 1")
    pieces = (streams.where(size > 0).withColumn("block", F.explode(F.sequence(first, last)))
              .withColumn("__lo", F.greatest(F.col("__start"), begin) - begin)
              .withColumn("__hi", F.least(F.col("__start") + size, end) - begin))
    pieces = pieces.where("__hi > __lo").select(F.col(source_col).alias("source"), "__start", "block", "__lo", "__hi")
    drawn = slots.groupBy("source", "block", "words").agg(F.count("*").alias("__times"), F.min("step").alias("__step"))
    got = (pieces.alias("p").join(drawn.alias("s"), F.expr("p.source <=> s.source AND p.block = s.block AND p.__lo < s.words"))
           .select("p.source", "p.__start", "s.__times", "s.__step", ((F.least("p.__hi", "s.words") - F.col("p.__lo"))
                                                                      * F.col("s.__times")).alias("__w"))
           .groupBy("source", "__start").agg(F.sum("__w").cast("long").alias("__taken"), F.sum("__times").alias("__slots"),
                                             F.min("__step").alias("__first")))
    got = got.select(F.col("source").alias("__source"), F.col("__start").alias("__from"), "__taken", "__slots", "__first")
    with_words = streams.join(got, (size > 0) & F.col(source_col).eqNullSafe(F.col("__source"))
                              & (F.col("__start") == F.col("__from")), "left")
    zero = F.lit(0).cast("long")
    return with_words.select(
        *[F.col(f"`{c}`") for c in sizes.columns], "source_size", "target", F.coalesce("__taken", zero).alias("taken"),
        F.coalesce("__slots", zero).alias("n_slots"), F.col("__first").alias("first_step")), slots
