"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, a piecewise-linear function of time; its integral
says which part of the source's target is due by when. A document begins at some cumulative token count of its source,
in an order fixed by the digest of its id; inverting the demand at that count gives its training position, and a range
sort by position gives the training order.

Positions are worked out on narrow rows, without texts. A source's order is cut into runs by the leading digits of the digest,
as many as the number of rows asks for, and each run is summed by itself. ``curriculum`` then moves texts once: a small table
of (source, stretch of the order) says which ranges of position a stretch can fall into, a text goes there directly, and
meets its exact positions there.

Edge cases: a null source is a source of its own, after all others; a null or empty text has size 0 and takes nothing;
repeated rows are documents of their own, and equal rows share out the positions of their group; rows of one id are in one
run; an empty table gives an empty mix. Further columns, of any name, are kept untouched, but for those with the name of a
result column, which the result replaces.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_row, saved, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
RUN_ROWS = 1024  # of a run, about, if all rows were of one source
STRETCHES = 16  # of a source's order per range of position, at least
WIDE = 4  # ranges of position that a stretch may lie in for one use; beyond, it holds a hot id

# Relative weight of a source over time, at equally spaced moments; the mean is free, as only the shape counts.
SCHEDULES = ((1.25, 1.0, 0.75), (0.75, 1.0, 1.25), (1.0, 1.0, 1.0))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, place, source_size, target) from one row per source with its ``source_size``.

    A source's part of ``share`` times all words is by weight, but at most ``most`` times what it has; the excess goes
    to the others by weight until none is above. Sources are thus cut at their limit in the order of limit per weight,
    and the first level that the next source can bear is the level for all the rest. The windows below run over one row
    per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    listed = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    everything = Window.partitionBy()
    by_limit = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "place").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cut = (
        listed.withColumn("limit", F.lit(most) * F.col("source_size"))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("limit").over(by_limit), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0)))
        .withColumn("level", (F.lit(share) * F.col("all") - F.col("full")) / F.col("rest"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
        .withColumn("chosen", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    )
    target = F.when(
        F.col("chosen").isNull() | (F.col("limit") < F.col("chosen") * F.col("weight")), F.col("limit").cast("double")
    ).otherwise(F.col("chosen") * F.col("weight"))
    return cut.select("source", "place", "source_size", target.alias("target"))


def due_time(part: Column, schedule: Column) -> Column:
    """The time by which ``part`` (0 to 1) of a source's demand has come, for a piecewise-linear ``schedule``.

    The integral of a linear piece is quadratic, so its inverse is the root of a quadratic.
    """
    steps = F.size(schedule) - 1
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("area"), F.lit(None).cast("double").alias("t"))
    total = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.lit(0.0),
        lambda acc, i: acc + (F.get(schedule, i - 1) + F.get(schedule, i)) / 2,
    )

    def step(acc, i):
        a, b = F.get(schedule, i - 1), F.get(schedule, i)
        area, wanted = (a + b) / 2, part * total - acc["area"]
        slope = a + F.sqrt(F.greatest(a * a + 2 * (b - a) * wanted, F.lit(0.0)))
        root = 2 * wanted / F.greatest(slope, F.lit(1e-300))  # the slope is 0 only where nothing is wanted
        inside = F.when(acc["t"].isNull() & (wanted <= area), (i - 1 + F.least(root, F.lit(1.0))) / steps)
        return F.struct(i.alias("i"), (acc["area"] + area).alias("area"), F.coalesce(acc["t"], inside).alias("t"))

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), steps), start, step)["t"], F.lit(1.0))


def _rows(docs: DataFrame, kept: Sequence[str]) -> DataFrame:
    """What the mix works on: the kept columns in one struct, so that their names cannot clash, and columns of its own."""
    doc_id, text, source = F.col("doc_id"), F.col("text"), F.col("source")
    return docs.select(
        as_row(kept).alias("row") if kept else F.lit(None).cast("struct<none: int>").alias("row"),
        doc_id.alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).alias("name"),  # never null, for plain joins
        word_count(text).alias("size"),
        # Null ids are told apart by their text; all else by the id.
        F.md5(F.concat_ws("-", F.coalesce(doc_id.cast("string"), F.md5(text)), F.lit("mix"))).alias("key"),
        F.xxhash64(text).alias("text_hash"),
        *_twins(docs),
    )


def _twins(docs: DataFrame) -> list[Column]:
    """128 bits that are the same for rows that are equal, but for columns that have no hash, only."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    hashed = [as_row([c])[c] for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    absent = F.array(*[c.isNull() for c in hashed])
    return [F.xxhash64(F.lit(seed), absent, *hashed).alias(f"twin{seed}") for seed in (1, 2)]


def _digits(n: int) -> int:
    """Leading hex digits of the digest that tell ``n`` parts apart, about."""
    return max(1, math.ceil(math.log(max(n, 1), 16)))


def _demand(rows: DataFrame, digits: int, weights: Sequence[int], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their source's size, target and place, and the words of it ``before`` them; the same per source)."""
    sized = rows.withColumn("run", F.substring("key", 1, digits))
    runs = sized.groupBy("source", "name", "run").agg(F.sum("size").alias("words"))
    aims = targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    aims = aims.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")
    earlier = Window.partitionBy("name").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("earlier", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    known = starts.drop("source", "words").join(aims, "name")
    # The window and the join below share a partitioning.
    inside = (
        Window.partitionBy("name", "run")
        .orderBy("key", "size", "text_hash", "twin1", "twin2")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    in_run = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    demand = in_run.join(known, ["name", "run"]).withColumn("before", F.col("earlier") + F.col("inside"))
    return demand.drop("run", "earlier", "inside"), aims


def _rounds() -> Column:
    """How often the whole source is used."""
    aim = F.floor(F.col("target")).cast("bigint")
    return F.when(F.col("source_size") > 0, F.floor(aim / F.col("source_size"))).otherwise(0).cast("bigint")


def _words_taken(demand: DataFrame, whole: bool) -> DataFrame:
    """Append ``taken``: full rounds over the source, then the documents that begin before the rest is used up."""
    aim = F.floor(F.col("target")).cast("bigint")
    left = aim - _rounds() * F.col("source_size") - F.col("before")
    part = F.greatest(F.least(left, F.col("size")), F.lit(0))
    if whole:
        part = F.when(left * 2 > F.col("size"), F.col("size")).otherwise(0)
    return demand.withColumn("taken", _rounds() * F.col("size") + part)


def _position(use: Column, before: Column, schedules: Sequence[Sequence[float]]) -> Column:
    """When the ``use``-th use of a document is due that has ``before`` words of its source ahead."""
    shapes = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in schedules])
    shape = F.element_at(shapes, (F.col("place") % len(schedules) + 1).cast("int"))
    due = use * F.col("source_size") + before
    return due_time(F.least(due / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0)), shape)


def _placed(demand: DataFrame, whole: bool, schedules: Sequence[Sequence[float]]) -> DataFrame:
    """A row per use of a document: ``use``, the ``words`` it gives and its ``position``, not yet sorted."""
    taken = _words_taken(demand, whole)
    uses = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return (
        taken.withColumn("use", F.explode(F.when(uses > 0, F.sequence(F.lit(0), uses - 1)).otherwise(F.array())))
        .withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("use") * F.col("size")))
        .withColumn("position", _position(F.col("use"), F.col("before"), schedules))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    whole: bool = False,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target``, ``taken``, ``uses`` and ``first_position``.

    The training order of all uses is built and written to the shared folder, sorted by position; ``taken``, the words
    the mix takes of a document, ``uses`` and the position of the first one (null without a use) are read from it.
    With ``whole`` false the last document of a source is used in part, so that a source's words come within one of
    its target; otherwise each document is used whole or not. ``keep`` lists the input
    columns that come (all by default), so that texts need not be written.
    """
    found = ("size", "source_size", "target", "taken", "uses", "first_position")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in found]
    keyed, _ = _demand(_rows(docs, kept), _digits(docs.count() // RUN_ROWS), weights, share, most)
    # Ids may repeat or be null: each row is written with a key of its own. It goes by partition, and thus not into results.
    own = keyed.select("row", "doc_id", "size", "source_size", "target", "place", "before")
    demand = saved(own.withColumn("uid", F.monotonically_increasing_id()), "mix-demand")
    order = _placed(demand.drop("row"), whole, schedules).select("uid", "doc_id", "use", "words", "position")
    order = saved(order.orderBy("position", "doc_id", "use"), "mix-order")
    used = order.groupBy("uid").agg(
        F.sum("words").alias("taken"), F.count("*").alias("uses"), F.min("position").alias("first_position")
    )
    summed = demand.select("uid", "row", "size", "source_size", "target").join(used, "uid", "left")
    return summed.select(
        *[F.col("row")[c].alias(c) for c in kept],
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses"),
        "first_position",
    )


def _routes(rows: DataFrame, aims: DataFrame, ranges: int, digits: int, schedules: Sequence[Sequence[float]]) -> DataFrame:
    """(name, stretch, goes, wide): the (use, range of position) pairs that documents of a stretch of a source's order may
    have, and whether they are many.

    One row per source and stretch, whatever the number of documents. Most stretches lie in one range per use; one that
    lies across a border is sent to both sides, where the exact position decides.
    """
    smallest = F.min(F.when(F.col("size") > 0, F.col("size")))
    cut = rows.groupBy("name", F.substring("key", 1, digits).alias("stretch")).agg(
        F.sum("size").alias("words"), F.coalesce(smallest, F.lit(0)).alias("smallest")
    )
    earlier = Window.partitionBy("name").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    known = cut.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(aims, "name")
    last = F.floor(F.col("target")).cast("bigint") - _rounds() * F.col("source_size") > F.col("start")
    uses = F.when(F.col("words") > 0, F.when(last, _rounds()).otherwise(_rounds() - 1)).otherwise(F.lit(-1)).cast("int")
    each = known.withColumn("use", F.explode(F.when(uses >= 0, F.sequence(F.lit(0), uses)).otherwise(F.array())))
    # Rounding of the inverse must not part a stretch from a position of its own.
    low = _position(F.col("use"), F.col("start"), schedules) - 1e-9
    high = _position(F.col("use"), F.col("start") + F.col("words") - F.col("smallest"), schedules) + 1e-9
    reach = F.sequence(_range_of(low, ranges), _range_of(high, ranges))
    goes = F.transform(reach, lambda b: F.struct(F.col("use").alias("use"), b.alias("range")))
    gone = each.select("name", "stretch", goes.alias("goes")).groupBy("name", "stretch")
    return gone.agg(F.flatten(F.collect_list("goes")).alias("goes"), (F.max(F.size("goes")) > WIDE).alias("wide"))


def _of_wide(sent: DataFrame, exact: DataFrame, routes: DataFrame) -> DataFrame:
    """Texts of wide stretches with their exact places: (range, use, twin1, twin2, place, row).

    Rows of one id cannot be told apart by their digest, so a stretch with very many of them lies in many ranges. Equal rows
    are first reduced to one, which then goes once to each range that has a place for it.
    """
    twins, at = ["twin1", "twin2"], ["name", "stretch"]
    wide = routes.filter("wide").select(*at)
    places = exact.join(wide, at, "left_semi").drop(*at)
    one = sent.join(wide, at, "left_semi").groupBy(*twins).agg(F.first("row").alias("row"))
    there = places.select("range", *twins).distinct().join(one, twins)
    return places.join(there, ["range", *twins]).select("range", "use", *twins, "place", "row")


def _range_of(position: Column, ranges: int) -> Column:
    return F.greatest(F.least(F.floor(position * ranges), F.lit(ranges - 1)), F.lit(0)).cast("int")


def curriculum(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    whole: bool = True,
) -> DataFrame:
    """The mix as a training order: a row per use of a document, with ``use`` (0, 1, ...) and ``position`` (0 to 1),
    sorted by position, within partitions and across them. Documents are used whole; with ``whole`` false the last use in
    a source may give only the first ``words`` of its document, a further column.

    Texts are shuffled once, into ranges of position.
    """
    spark = docs.sparkSession
    added = ["use", "position", *([] if whole else ["words"])]
    kept = [c for c in docs.columns if c not in added]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digits = _digits(STRETCHES * ranges)

    narrow = saved(_rows(docs, []).drop("row"), "mix-rows")
    demand, aims = _demand(narrow, _digits(narrow.count() // RUN_ROWS), weights, share, most)
    placed = _placed(demand, whole, schedules)
    place = F.struct("position", F.col("words").cast("bigint").alias("words")).alias("place")
    stretch = F.substring("key", 1, digits).alias("stretch")
    exact = saved(
        placed.select("name", stretch, _range_of(F.col("position"), ranges).alias("range"), "use", "twin1", "twin2", place),
        "mix-positions",
    )
    routes = saved(_routes(narrow, aims, ranges, digits, schedules), "mix-routes")

    sent = _rows(docs, kept).select("row", "name", stretch, "twin1", "twin2")
    texts = sent.join(routes.filter("not wide"), ["name", "stretch"]).select("row", "twin1", "twin2", F.explode("goes").alias("go"))
    at = ["range", "use", "twin1", "twin2"]
    texts = texts.select("go.range", "go.use", "twin1", "twin2", F.lit(None).cast(exact.schema["place"].dataType).alias("place"), "row")
    has_wide = not routes.filter("wide").isEmpty()
    places = exact.join(routes.filter("wide"), ["name", "stretch"], "left_anti") if has_wide else exact
    met = texts.unionByName(places.select(*at, "place", F.lit(None).cast(texts.schema["row"].dataType).alias("row")))
    if has_wide:
        met = met.unionByName(_of_wide(sent, exact, routes))
    dealt = met.repartitionByRange("range")
    # Equal rows have equal twins: the first of them in a range takes the first position of their group there, and so on.
    turn = Window.partitionBy(*at, "is_text").orderBy("place")
    numbered = dealt.withColumn("is_text", F.col("row").isNotNull()).withColumn("turn", F.row_number().over(turn))
    given = F.max("place").over(Window.partitionBy(*at, "turn"))
    found = numbered.withColumn("given", given).filter(F.col("is_text") & F.col("given").isNotNull())
    columns = {"use": F.col("use"), "position": F.col("given.position"), "words": F.col("given.words")}
    result = found.select(*[F.col("row")[c].alias(c) for c in kept], *[columns[c].alias(c) for c in added])
    return result.sortWithinPartitions("position", "doc_id", "use")
