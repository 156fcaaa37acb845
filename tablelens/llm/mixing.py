"""Mixing sources to target weights (operator 11).

Every document gets a hash-random key. Within its source the documents are
sorted by that key, over ranges of the key that are as many as the rows need,
so a source that holds a third of all rows is sorted in many tasks. Prefix sums
of the sizes (per range, then inside each range) give each document its place
in its source's running total, and the source's budget cuts there: whole epochs
first, then the documents up to the budget, the last one in part.

Targets: the total is shared by weight; no target passes ``max_epochs`` times
its source's size, and what is over is shared again by weight among the others,
until none is above.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.llm.stage import Steps

#: Rows of one key range, about.
RANGE_ROWS = 1 << 12
#: Copies of one row that are written out together.
COPIES = 1 << 16
_KEY_BITS = 60
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words (runs other than space and 0x09-0x0D) of a whole text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def hash_key(seed: str, *columns: Column) -> Column:
    """60 hash bits of the columns' text, as a long; the same in every run."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary")), 1, _KEY_BITS // 4),
                  16, 10).cast("long")


def _in_order(sources: DataFrame, steps: Steps) -> DataFrame:
    """``sources`` with ``rank`` from 0 in the order of ``s``, by range partitions:
    a row's rank is the rows of the partitions before it plus its own place."""
    numbered = steps.write("ranked", sources.repartitionByRange("s").sortWithinPartitions("s")
                           .withColumn("mark", F.monotonically_increasing_id()))
    part = F.shiftright("mark", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row a partition
    offsets = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("k")).select(
        "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    return numbered.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        *sources.columns, (F.col("offset") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def source_targets(sources: DataFrame, share: Fraction, max_epochs: int, steps: Steps) -> DataFrame:
    """``sources`` (s, source_size, weight) with ``target``: ``share`` of the total
    size by weight, none above ``max_epochs`` times its source's size. Each round
    is one aggregate over the sources; sums and comparisons are exact."""
    p, q = share.numerator, share.denominator
    wide = "decimal(38,0)"
    size, weight = F.col("source_size").cast(wide), F.col("weight").cast("decimal(18,0)")
    level = None        # (rest of the total times q, weight that shares it)
    while True:
        if level is None:
            full = F.lit(False)
        else:
            rest, shared = (F.lit(str(v)).cast(wide) for v in level)
            full = rest * weight > size * shared * F.lit(max_epochs * q)
        row = sources.agg(F.sum(size).alias("total"), F.sum(F.when(full, size)).alias("taken"),
                          F.sum(F.when(~full, weight)).alias("shared")).first()
        now = (p * int(row.total or 0) - q * max_epochs * int(row.taken or 0), int(row.shared or 0))
        if now == level:
            break
        level = now
    rest, shared = level
    open_target = F.lit(float(Fraction(rest, q))) * F.col("weight").cast("double") / F.lit(float(max(shared, 1)))
    capped = F.lit(str(rest)).cast(wide) * weight > size * F.lit(str(shared)).cast(wide) * F.lit(max_epochs * q)
    return sources.withColumn("target", F.when(capped, (F.col("source_size") * max_epochs).cast("double"))
                              .otherwise(open_target))


def mix_sources(docs: DataFrame, *, weights: Sequence[int] | DataFrame = (3, 1, 2), share: Fraction | float = Fraction(3, 2),
                max_epochs: int = 2, seed: str = "mix", size: Column | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """How much of each document a mix takes: one row per row of ``docs`` with
    doc_id, source, size (words of the text unless ``size`` is given), source_size,
    target, ``epochs`` (whole copies), ``part`` (words from its start in one more
    copy), ``taken`` = epochs * size + part, and the columns of ``keep``.

    ``weights``: a tuple is dealt in turn to the sources by code point, null last;
    a table (source, weight) names them, and a source it does not list weighs 0.
    The words taken of a source are exactly the whole part of its target.

    Defined cases: a null or empty text has size 0 and nothing is taken of it; the
    null source is one source of its own, apart from the empty string; rows that
    repeat are rows of their own (they are counted as one while they are sorted,
    so a row repeated millions of times is no hot key); rows of a null id are
    told apart by their text; an empty table gives none. Columns that are not in
    ``keep`` do not matter, whatever their names; one of ``keep`` that clashes
    with a result column is refused.
    """
    share = Fraction(share).limit_denominator(10_000)
    names = {"doc_id", "source", "size", "source_size", "target", "epochs", "part", "taken"}
    if names & set(keep):
        raise ValueError(f"keep: result columns of the same name: {sorted(names & set(keep))}")
    steps = Steps(docs.sparkSession)
    source = F.col("source").cast("string")
    kept = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in keep])
    rows = steps.write("rows", docs.select(
        "doc_id", F.when(source.isNull(), "b").otherwise(F.concat(F.lit("a"), source)).alias("s"), "source",
        (word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))).alias("size"),
        hash_key(seed, F.col("doc_id"), F.md5(F.col("text").cast("binary"))).alias("key"), kept.alias("kept")))
    n_rows = rows.count()
    bits = max(0, math.ceil(math.log2(max(n_rows, 1) / RANGE_ROWS)))
    rows = rows.withColumn("range", F.shiftright("key", _KEY_BITS - bits) if bits else F.lit(0).cast("long"))

    sources = rows.groupBy("s").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    if isinstance(weights, DataFrame):
        named = weights.select(F.when(F.col("source").isNull(), "b").otherwise(
            F.concat(F.lit("a"), F.col("source").cast("string"))).alias("s"), "weight").groupBy("s").agg(F.max("weight").alias("weight"))
        sources = sources.join(named, "s", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    else:
        turn = F.array(*[F.lit(int(w)) for w in weights])
        sources = _in_order(sources, steps).withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
    sources = steps.write("sources", sources.select("s", "source_size", "weight"))
    targets = source_targets(sources, share, max_epochs, steps)

    # equal rows as one, then the running total of each range
    alike = ["s", "range", "key", "doc_id", "size", "source", "kept"]
    groups = rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("s", "range").agg(F.sum("size").alias("words")).withColumn(
        "start", F.coalesce(F.sum("words").over(before), F.lit(0).cast("long"))).join(targets, "s").select(
        "s", "range", "start", "source_size", "target", F.floor("target").cast("long").alias("budget"))
    inside = Window.partitionBy("s", "range").orderBy("key", "doc_id", "size", "kept").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("place", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0).cast("long")))
    placed = placed.join(ranges, ["s", "range"]).withColumn("place", F.col("place") + F.col("start"))

    # one row per copy again
    chunked = placed.where(f"n > {COPIES}").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES)))) \
        .repartition("s", "key", "doc_id", "first").withColumn("last", F.least("n", F.col("first") + COPIES) - 1)
    single = placed.where(f"n <= {COPIES}").withColumn("first", F.lit(0).cast("long")).withColumn("last", F.col("n") - 1)
    copies = single.unionByName(chunked).withColumn("copy", F.explode(F.sequence("first", "last")))
    place = F.col("place") + F.col("copy") * F.col("size")
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - place))
    out = copies.withColumn("epochs", whole).withColumn("part", part)
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "part",
                      (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
                      *[F.col("kept")[c].alias(c) for c in keep])


def mixed_texts(mix: DataFrame) -> DataFrame:
    """The texts of a mix made with ``keep=("text",)``: a row (doc_id, source,
    epoch, text) for each copy; the copy taken in part holds its first words,
    joined by a space. A document of no words is in no copy."""
    epochs = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    copies = mix.where("size > 0").where(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), epochs)))
    cut = (F.col("epoch") > F.col("epochs")) & (F.col("part") < F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    return copies.select("doc_id", "source", "epoch", F.when(cut, first).otherwise(F.col("text")).alias("text"))
