"""Mixing sources to target weights, by a splitting tree of block quotas. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adtally.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A document's place in its source's order is a number of so many bits.
POINT_BITS = 48
#: Blocks in which documents are looked for that fill what whole blocks leave of a target.
FILLING_BLOCKS = 8


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def point(id_column: str, seed: int) -> Column:
    """A number below 2^48 that depends on the id and the seed alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, POINT_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """``source, place, source_size, target``: the words each source gives to a mix of all sources' size.

    Weights repeat over the sources in order of their names, null last. A target above
    ``most`` times its source's size is cut to that and the rest is shared by weight among the
    others, until none is above. One row per source, so windows over all rows will do.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = totals.withColumn("place", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1)
    named = named.withColumns({"weight": weight, "bound": F.col("source_size") * most})
    # In order of the level at which a source would be full, the full ones come first.
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), "place")
    everything = Window.partitionBy()
    levelled = named.withColumns({
        "total": F.sum("source_size").over(everything),
        "full_before": F.coalesce(F.sum("bound").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_from": F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    full = F.col("bound") * F.col("weight_from") <= (F.col("total") - F.col("full_before")) * F.col("weight")
    shared = levelled.withColumn("full", full).withColumns({
        "full_total": F.coalesce(F.sum(F.when(F.col("full"), F.col("bound"))).over(everything), F.lit(0)),
        "open_weight": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything), F.lit(0)),
    })
    level = (F.col("total") - F.col("full_total")) / F.nullif(F.col("open_weight"), F.lit(0))
    target = F.when(F.col("full"), F.col("bound").cast("double")).otherwise(level * F.col("weight"))
    return shared.select("source", "place", "source_size", target.alias("target"))


def _block(point_column: str = "point") -> Column:
    return F.expr(f"({point_column} * blocks) div {1 << POINT_BITS}")


def source_plan(sizes: DataFrame, targets: DataFrame, block_words: int, most_blocks: int, rounds: int) -> DataFrame:
    """For each source how often all of it is taken, and what decides which documents are taken once more.

    A source's documents lie in blocks by their points, which are a random order. The rest of
    the target beyond whole passes is made of the first blocks, and of some documents of the
    block where it ends (``edge``) and a few after it: those up to a point (``cuts``) and, round by round, later
    ones small enough for the words that are still lacking (``gaps``).
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    blocks = F.least(F.lit(most_blocks), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))).cast("long")
    plan = targets.withColumns({"passes": passes, "blocks": blocks})
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-sources")
    # One row per source, small enough for Spark to send it to every task by its written size.
    placed = sizes.join(plan, sizes.source.eqNullSafe(plan.source)).drop(plan.source).withColumn("block", _block())
    words = placed.groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = F.sum("words").over(Window.partitionBy("place").orderBy("block"))
    ends = words.withColumn("upto", running).withColumn("before", F.col("upto") - F.col("words"))
    edges = ends.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("upto"))).select(
        "place", F.col("block").alias("edge"), (F.col("rest") - F.col("before")).alias("gap")
    )
    edges = materialize(edges, "mix-edges")
    inside = placed.select("place", "block", "point", "size").join(edges, "place").where(
        (F.col("block") >= F.col("edge")) & (F.col("block") < F.col("edge") + FILLING_BLOCKS)
    )
    inside = materialize(inside.select("place", "point", "size", "gap"), "mix-edge-documents")
    state = inside.withColumns({"cuts": F.array(F.lit(-1).cast("long")), "gaps": F.array("gap")})
    # These blocks are about block_words long each whatever the source's size, up to most_blocks blocks.
    by_point = Window.partitionBy("place").orderBy("point").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    all_inside = Window.partitionBy("place")
    for _ in range(rounds):
        last_cut, last_gap = F.element_at("cuts", -1), F.element_at("gaps", -1)
        may = (F.col("point") > last_cut) & (F.col("size") <= last_gap)
        upto = F.sum(F.when(may, F.col("size")).otherwise(0)).over(by_point)
        state = state.withColumns({"may": may, "upto": upto})
        fits = F.col("may") & (F.col("upto") <= last_gap)
        state = state.withColumns({
            "cut": F.max(F.when(fits, F.col("point"))).over(all_inside),
            "got": F.max(F.when(fits, F.col("upto"))).over(all_inside),
        }).withColumns({
            "cuts": F.concat("cuts", F.array(F.coalesce("cut", last_cut))),
            "gaps": F.concat("gaps", F.array(last_gap - F.coalesce("got", F.lit(0)))),
        }).select("place", "point", "size", "cuts", "gaps")
    chosen = state.groupBy("place").agg(F.first("cuts").alias("cuts"), F.first("gaps").alias("gaps"))
    return plan.join(edges.drop("gap"), "place", "left").join(chosen, "place", "left")


def once_more(rounds: int) -> Column:
    """Whether a document is taken once more than its source's whole passes."""
    picks = [
        (F.col("point") > F.element_at("cuts", n)) & (F.col("size") <= F.element_at("gaps", n))
        & (F.col("point") <= F.element_at("cuts", n + 1))
        for n in range(1, rounds + 1)
    ]
    in_edge = (F.col("block") >= F.col("edge")) & reduce(lambda a, b: a | b, picks)
    return F.coalesce((F.col("size") > 0) & ((F.col("block") < F.col("edge")) | in_edge), F.lit(False))


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") / float(1 << 53)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among ``marked``: the value at ``uniform`` of its distribution.

    Chances are taken relative to the likeliest value's and summed outwards from it, over
    twelve deviations and more; what lies beyond is below a double's precision.
    """
    low, high = F.greatest(F.lit(0), drawn - (total - marked)), F.least(marked, drawn)
    middle = F.least(high, F.greatest(low, F.floor((drawn + 1) * (marked + 1) / (total + 2)).cast("long")))
    share = marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    width = (F.ceil(spread * 12) + 12).cast("long")

    def step(up: bool):
        def at(state: Column, k: Column) -> Column:
            if up:
                ratio = (marked - k + 1) * (drawn - k + 1) / (k * (total - marked - drawn + k))
            else:
                ratio = (k + 1) * (total - marked - drawn + k + 1) / ((marked - k) * (drawn - k))
            chance = state["chance"] * ratio
            reached = state["sum"] + chance
            found = F.when(state["found"] >= 0, state["found"]).when(reached > state["aim"], k).otherwise(F.lit(-1))
            return _state(chance, reached, state["aim"], found)

        return at

    def walk(aim: Column) -> Column:
        """Sums the chances from the middle up and then down; notes where the sum passes ``aim``."""
        above = F.filter(F.sequence(middle, F.least(high, middle + width)), lambda k: k > middle)
        below = F.filter(F.sequence(middle, F.greatest(low, middle - width)), lambda k: k < middle)
        begin = _let(aim, lambda a: _state(F.lit(1.0), F.lit(1.0), a, F.when(a < 1.0, middle).otherwise(F.lit(-1))))
        up = F.aggregate(above, begin, step(True))
        return F.aggregate(below, _let(up, lambda u: _state(F.lit(1.0), u["sum"], u["aim"], u["found"])), step(False))

    whole = walk(F.lit(float("inf")))["sum"]
    found = _let(walk(uniform * whole)["found"], lambda f: F.when(f >= 0, f).otherwise(middle))
    return F.when(low == high, low).otherwise(found).cast("long")


def _state(chance: Column, reached: Column, aim: Column, found: Column) -> Column:
    return F.struct(chance.alias("chance"), reached.alias("sum"), aim.alias("aim"), found.cast("long").alias("found"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _source_split(seed: int, level: int):
    def split(state: Column, item: Column) -> Column:
        uniform = _uniform(F.lit(seed), F.lit(level), F.col("shard"), item["i"])
        return _let(
            hypergeometric(state["of"], item["c"], state["left"], uniform),
            lambda taken: F.struct(
                (state["of"] - item["c"]).alias("of"), (state["left"] - taken).alias("left"),
                F.concat(state["taken"], F.array(taken)).alias("taken"),
            ),
        )

    return split


def shard_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """``shard, counts``: how many blocks of each source each of 2^depth shards gets.

    ``quotas`` has one row with ``counts``, the blocks of every source. Each level of the tree
    halves every node's blocks; how many of a source go left is drawn from the multivariate
    hypergeometric distribution, source by source. A node's counts always add up.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "counts")
    for level in range(depth):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
        nodes = nodes.withColumns({"total": total, "numbered": F.transform("counts", lambda c, i: F.struct(c.alias("c"), i.alias("i")))})
        begin = F.struct(
            F.col("total").alias("of"), F.expr("total div 2").alias("left"), F.array().cast("array<long>").alias("taken")
        )

        one_source = _source_split(seed, level)
        # Written level by level: what is drawn is read more than once below.
        split = materialize(
            nodes.select("shard", "counts", F.aggregate("numbered", begin, one_source)["taken"].alias("taken")), "mix-tree"
        )
        right = F.zip_with("counts", "taken", lambda c, t: c - t)
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("taken").alias("counts")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("counts")),
        )
        nodes = split.select(F.inline(halves))
    return nodes


def block_shards(plan: DataFrame, depth: int, seed: int) -> DataFrame:
    """``place, block, shards``: the shard of each draw of a block; the last is for what is taken once more."""
    draws = plan.select(
        "place", "passes", "edge", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    ).withColumn("copies", F.col("passes") + F.coalesce((F.col("block") <= F.col("edge")).cast("long"), F.lit(0)))
    draws = draws.where("copies > 0").select("place", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    shuffled = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed), F.col("place"), F.col("block"), F.col("copy")), "block", "copy")
    draws = draws.withColumn("turn", F.row_number().over(shuffled))
    counts = draws.groupBy("place").agg(F.count("*").alias("n"))
    # One row holding one number per source.
    quotas = counts.agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("all")).select(
        F.col("all.place").alias("places"), F.col("all.n").alias("counts")
    )
    quotas = materialize(quotas, "mix-quotas")
    listed = shard_quotas(quotas, depth, seed).select("shard", F.posexplode("counts").alias("at", "n"))
    places = quotas.select(F.posexplode("places").alias("at", "place"))
    upto = F.sum("n").over(Window.partitionBy("at").orderBy("shard"))
    ranges = listed.withColumn("upto", upto).groupBy("at").agg(F.sort_array(F.collect_list("upto")).alias("ends"))
    ranges = ranges.join(places, "at").select("place", "ends")
    # A source's draws in shuffled order are cut into the shards' shares.
    shard = F.size(F.filter("ends", lambda end: end < F.col("turn"))).cast("int")
    return draws.join(ranges, "place").groupBy("place", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("copy", shard.alias("shard")))), lambda x: x["shard"]).alias("shards")
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, block_words: int = 50_000,
          most_blocks: int = 4096, depth: int = 6, rounds: int = 4, seed: int = 1, id_column: str = "doc_id",
          text_column: str = "text", source_column: str = "source", keep: bool = True) -> DataFrame:
    """All rows of ``docs`` with ``_size, _source_size, _target, _point`` and ``_shards``, one shard per time taken.

    These five come last; where ``docs`` has such a name, the added one gets one more underscore.

    Whole documents are taken: each as often as its source is taken whole, and some once more,
    so that a source's words come near its target; none more than ``most`` times. The draws of
    a source's blocks are dealt to 2^``depth`` shards by ``shard_quotas``. A document without
    words, or with a null text, has size 0; a null source is a source of its own, named last;
    rows with one id are decided alike. An empty table gives no rows. Reruns with one seed
    agree. ``keep`` keeps all of the columns of ``docs``, else only the id.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep else [id_column])])
    rows = docs.select(
        own.alias("own"), F.col(f"`{id_column}`").alias("_id"), F.col(f"`{source_column}`").cast("string").alias("source"),
        word_count(text_column).alias("size"), point(id_column, seed).alias("point"),
    )
    sizes = materialize(rows if not keep else rows.drop("own"), "mix-sizes")
    plan = materialize(source_plan(sizes, source_targets(sizes, weights, most), block_words, most_blocks, rounds), "mix-plan")
    shards = materialize(block_shards(plan, depth, seed), "mix-shards")
    decisions = plan.select(
        F.col("source").alias("_name"), "place", "source_size", "target", "passes", "blocks", "edge", "cuts", "gaps"
    )
    inner = (rows if keep else sizes).select("own", F.col("source").alias("_source"), "size", "point")
    joined = inner.join(decisions, inner["_source"].eqNullSafe(decisions["_name"])).withColumn("block", _block())
    dealt = joined.join(shards, ["place", "block"], "left")
    copies = F.col("passes") + once_more(rounds).cast("long")
    taken = F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), copies.cast("int"))
    added = {"_size": F.col("size"), "_source_size": F.col("source_size"), "_target": F.col("target"), "_point": F.col("point"), "_shards": taken}
    names = _apart(list(added), docs.columns if keep else [id_column])
    return dealt.select("own.*", *[column.alias(name) for name, column in zip(names, added.values())])


def _apart(names: list[str], others: list[str]) -> list[str]:
    """The names, each with as many more underscores in front as it takes to differ from the others."""
    taken = {name.lower() for name in others}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def shuffled_shards(rows: DataFrame, columns: list[str], seed: int = 1) -> DataFrame:
    """The mix itself: every row of ``mixed`` as often as it is taken, shard by shard and shuffled in each."""
    point_name, shards_name = rows.columns[-2:]
    own = F.struct(*[F.col(f"`{c}`") for c in columns])
    drawn = rows.select(own.alias("own"), F.col(point_name).alias("point"), F.posexplode(shards_name).alias("copy", "shard"))
    drawn = drawn.withColumn("turn", F.xxhash64(F.lit(seed), F.col("point"), F.col("copy")))
    return drawn.repartition("shard").sortWithinPartitions("shard", "turn").select("own.*")
