"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions alone.

Each source's documents are put in an order of their own and cut into blocks. With all sources
going on by their target weights until they run out, block i of a source would be given between
two points of time: it is released at the first, rounded down, and due at the second, rounded up.
Earliest deadline first gives each slot to the released block that is due soonest. One always is,
and none is late, so after any number of slots a source has been given less than one block more
or less than its target weight asks for. The points are computed in whole numbers, with weights
to fifteen places where the number of blocks allows.

Every document is kept, once, where sources run out the others go on by their shares. Null is a
source like any other. Weights that are missing are taken as 0: such a source is due when the others have run out. Ties go
to the source that comes first. Repeated rows stay repeated. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import cut_lineage, table
from docweave.operators.common import materialised

#: Slots whose blocks the schedule keeps in one array.
FRAME = 1000
#: Documents a block, at least; larger tables have larger blocks, so that the schedule has this many slots at most (and one a source).
BLOCK_DOCS, MOST_SLOTS = 8, 4_000_000
#: A source's weight where none are given: its size to this power.
TEMPER = 0.7
#: Documents of a source that one task puts in order, on average.
DOCS_PER_SALT = 2_000


def source_weights(sizes: DataFrame, weights: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """source, place, blocks, weight, goal: the weight as a whole number, and as a part of one.

    ``sizes`` has source and n_docs, one row a source. A table of sources is small: it has one row each.
    Weights are scaled to the largest power of ten at which a weight times a number of blocks fits a bigint.
    """
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(TEMPER)))
    else:
        given = weights.groupBy("source").agg(F.sum("weight").alias("w"))
        pair = F.col("s.source").eqNullSafe(F.col("g.source"))
        weighed = sizes.alias("s").join(given.alias("g"), pair, "left").select("s.source", "s.n_docs", F.greatest(F.coalesce("g.w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    every = Window.partitionBy()
    total = F.sum("w").over(every)
    goal = F.when(total > 0, F.col("w") / total).otherwise(1.0 / F.count(F.lit(1)).over(every))
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_first())) - 1
    rows = weighed.withColumns({"goal": goal, "place": place.cast("long"), "blocks": F.ceil(F.col("n_docs") / block_docs).cast("long")})
    most = F.sum("blocks").over(every) + F.count(F.lit(1)).over(every)
    scale = F.pow(F.lit(10.0), F.least(F.lit(15.0), F.floor(F.log10(F.lit(4e18) / most)).cast("double")))
    whole = F.greatest(F.lit(1).cast("long"), F.round(F.col("goal") * scale).cast("long"))
    return rows.select("source", "place", "blocks", whole.alias("weight"), "goal")


def _line(i: str, weight: str) -> str:
    """SQL: the slot at which a source of this weight is due its first i blocks, rounded down and up.

    A source that runs out sooner has given all its blocks by then, the others as their weights ask.
    """
    return f"""
    aggregate(s, named_struct('out', 0L, 'on', 0L),
      (sum, y) -> if(y.blocks * {weight} <= ({i}) * y.weight, named_struct('out', sum.out + y.blocks, 'on', sum.on), named_struct('out', sum.out, 'on', sum.on + y.weight)),
      sum -> named_struct('down', sum.out + (({i}) * sum.on) div {weight}, 'up', sum.out + (({i}) * sum.on + {weight} - 1L) div {weight}))"""


#: SQL: each source's next block: its number, release, due, and the release of the one after.
_FIRST = f"transform(s, c -> if(c.blocks = 0L, named_struct('nth', 0L, 'release', 0L, 'due', 0L, 'after', 0L), transform(array({_line('1L', 'c.weight')}), l -> named_struct('nth', 0L, 'release', 0L, 'due', l.up, 'after', l.down))[0]))"
#: SQL: of the released blocks the one that is due soonest, as due * sources + place.
_SOONEST = "array_min(transform(a.next, (x, i) -> if(x.nth < s[i].blocks and x.release <= t, x.due * size(s) + i, null))) % size(s)"
_AFTER = f"transform(array({_line('x.nth + 2L', 's[i].weight')}), l -> named_struct('nth', x.nth + 1L, 'release', x.after, 'due', l.up, 'after', l.down))[0]"
#: SQL: one slot t more; ``out`` gets number * sources + place.
_STEP = f"""
    transform(array({_SOONEST}), p -> named_struct(
      'next', transform(a.next, (x, i) -> if(i = p, {_AFTER}, x)),
      'out', concat(a.out, array(a.next[cast(p as int)].nth * size(s) + p))))[0]"""


def earliest_deadline_first() -> Column:
    """Of the columns counts and length: the place that gets each slot of a frame, by weights that equal the counts."""
    sources = "transform(counts, c -> named_struct('blocks', c, 'weight', c))"
    fold = f"aggregate(sequence(0L, length - 1L), named_struct('next', {_FIRST}, 'out', cast(array() as array<bigint>)), (a, t) -> {_STEP}, a -> transform(a.out, o -> o % size(s)))"
    return F.expr(f"transform(array({sources}), s -> {fold})[0]")


def slot_frames(plan: DataFrame, frame: int = FRAME) -> DataFrame:
    """s, frame_no, out: the blocks in each frame's slots.

    Which block is next depends on all before it, so one task folds over the slots, with one number a block;
    frames keep its arrays short. All else is done by frames.
    """
    inner = f"aggregate(sequence(k * {frame}L, least(total, (k + 1L) * {frame}L) - 1L), named_struct('next', b.next, 'out', cast(array() as array<bigint>)), (a, t) -> {_STEP})"
    fold = f"""
    aggregate(sequence(0L, (total - 1L) div {frame}L), named_struct('next', {_FIRST}, 'frames', cast(array() as array<array<bigint>>)),
      (b, k) -> transform(array({inner}), r -> named_struct('next', r.next, 'frames', concat(b.frames, array(r.out))))[0],
      b -> b.frames)"""
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
    folded = plan.withColumn("total", total).where("total > 0").select("s", F.expr(fold).alias("frames"))
    return folded.select("s", F.posexplode("frames").alias("frame_no", "out"))


def slot_table(plan: DataFrame, frame: int = FRAME) -> DataFrame:
    """place, block (of its source), slot, release, due: where each block stands."""
    dealt = cut_lineage(slot_frames(plan, frame)).repartition("frame_no")
    slots = dealt.select("s", "frame_no", F.posexplode("out").alias("at", "o"))
    named = slots.select("s", F.expr("o % size(s)").alias("place"), F.expr("o div size(s)").alias("block"), (F.col("frame_no").cast("long") * frame + F.col("at")).alias("slot"))
    own = named.withColumn("w", F.expr("s[cast(place as int)].weight"))
    return own.select("place", "block", "slot", F.expr(_line("block", "w")).getField("down").alias("release"), F.expr(_line("block + 1L", "w")).getField("up").alias("due"))


def numbered_by_source(docs: DataFrame, key: str, salts: int) -> tuple[DataFrame, DataFrame]:
    """(docs with __nth, from 0 in a hashed order of each source; sizes): many tasks number a large source."""
    salted = docs.withColumn("__salt", F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(salts)))
    counts = salted.groupBy("source", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy("source").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("__before", F.coalesce(ahead, F.lit(0))).drop("__n")
    order = Window.partitionBy("source", "__salt").orderBy(F.xxhash64(F.col(key)), F.col(key))
    inside = salted.withColumn("__in", F.row_number().over(order) - 1)
    match = F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.__salt") == F.col("b.__salt"))
    ready = inside.alias("d").join(before.alias("b"), match).select("d.*", (F.col("b.__before") + F.col("d.__in")).alias("__nth")).drop("__salt", "__in")
    return ready, counts.groupBy("source").agg(F.sum("__n").alias("n_docs"))


def block_size(n_rows: int) -> int:
    """Documents a block of a table of so many rows."""
    return max(BLOCK_DOCS, -(-n_rows // MOST_SLOTS))


def schedule(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", frame: int = FRAME, block_docs: int | None = None) -> DataFrame:
    """key, source, block (of its source), slot (of all blocks), in_block, release, due (in slots from the start), share (the target weight as a part of one)."""
    rows = cut_lineage(docs.select(F.col(key), "source"))
    n_rows = rows.count()
    block_docs = block_docs or block_size(n_rows)
    salts = max(1, n_rows // DOCS_PER_SALT)
    ready, sizes = numbered_by_source(rows, key, salts)
    # one row; a source's place is its index in s
    listed = F.array_sort(F.collect_list(F.struct("place", "blocks", "weight", "goal", "source")))
    plan = cut_lineage(source_weights(sizes, weights, block_docs).agg(listed.alias("s")))
    slots = slot_table(plan, frame)
    owner = F.col("d.source").eqNullSafe(F.col("s.source"))
    # a row a source, written so that Spark knows its size: it is broadcast where it is small, and sorted where it is not
    known = materialised(plan.select(F.explode("s").alias("s")).select("s.source", "s.place", F.col("s.goal").alias("share")))
    placed = ready.withColumn("block", F.floor(F.col("__nth") / block_docs).cast("long")).alias("d").join(known.alias("s"), owner).select("d.*", "s.place", "s.share")
    found = placed.join(slots, ["place", "block"])
    return found.select(key, "source", "block", "slot", (F.col("__nth") % block_docs).alias("in_block"), "release", "due", "share")


def mixed(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", position: str | None = None, block_docs: int | None = None, **options) -> DataFrame:
    """All rows and columns of ``docs``, sorted into the mixture's order.

    Rows of equal keys and sources stand together, each once. ``position`` names a column to add, which keeps the
    order where rows are stored: slot * block_docs + in_block.
    """
    block_docs = block_docs or block_size(docs.count())
    at = F.min(F.col("slot") * block_docs + F.col("in_block")).alias("__at")
    order = schedule(docs, weights, key, block_docs=block_docs, **options).groupBy(key, "source").agg(at)
    match = F.col(f"d.{key}").eqNullSafe(F.col(f"o.{key}")) & F.col("d.source").eqNullSafe(F.col("o.source"))
    kept = [F.col("o.__at").alias(position)] if position else []
    return docs.alias("d").join(order.alias("o"), match).orderBy("o.__at").select("d.*", *kept)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))
