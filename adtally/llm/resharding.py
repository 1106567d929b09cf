"""Resharding by minimum-cost flow: which files change shards so that the fewest bytes move.

A layout is a table of files: each file lies in one shard, and a change of shards is a new table
that goes on naming the files that stay. Old shards' sizes are supplies, new shards' capacities
are demands, and a byte costs nothing where it stays. Whole files are handed over along the
solution; only a file that the solution cuts is divided, document by document.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adtally.session import fresh_path, materialize

LAYOUT = ("shard", "path", "rows", "bytes", "longest")
_KEY = "substring_index(_metadata.file_path, '/', -2)"


def least_moves(sizes: Sequence[int], capacities: Sequence[int], cost: Sequence[Sequence[int]] | None = None) -> dict[tuple[int, int], int]:
    """``{(old, new): bytes}`` of least total cost that places all old bytes within the capacities.

    ``cost`` is that of one byte from an old to a new shard; without it a byte is free in the
    shard of its own number and costs 1 anywhere else, so the fewest bytes move. Successive
    shortest paths with potentials: each path empties a supply, fills a capacity or drains a transfer.
    """
    old, new = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the capacities are too small")
    if cost is None:
        cost = [[int(i != j) for j in range(new)] for i in range(old)]
    flow: dict[tuple[int, int], int] = {}
    supply, room = list(sizes), list(capacities)
    # Potentials of old shards 0 to old - 1, then of new ones; no cost is negative at the start.
    potential = [0] * (old + new)
    while any(supply):
        far = [None] * (old + new)
        came: list[int | None] = [None] * (old + new)
        queue = [(0, i) for i in range(old) if supply[i]]
        for _, i in queue:
            far[i] = 0
        done: set[int] = set()
        while queue:
            at, u = heapq.heappop(queue)
            if u in done:
                continue
            done.add(u)
            if u < old:
                edges = [(old + j, cost[u][j]) for j in range(new)]
            else:
                edges = [(i, -cost[i][u - old]) for i in range(old) if flow.get((i, u - old))]
            for v, price in edges:
                reach = at + price + potential[u] - potential[v]
                if far[v] is None or reach < far[v]:
                    far[v], came[v] = reach, u
                    heapq.heappush(queue, (reach, v))
        end = min((j for j in range(new) if room[j] and far[old + j] is not None), key=lambda j: (far[old + j] + potential[old + j], j))
        most = far[old + end]
        path, v = [], old + end
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        back = [flow[v2, u - old] for u, v2 in path if u >= old]
        amount = min([supply[v], room[end], *back])
        for u, v2 in path:
            edge, sign = ((u, v2 - old), 1) if u < old else ((v2, u - old), -1)
            flow[edge] = flow.get(edge, 0) + sign * amount
        supply[v] -= amount
        room[end] -= amount
        for x in range(old + new):
            if far[x] is not None:
                potential[x] += min(far[x], most)
    return {edge: n for edge, n in sorted(flow.items()) if n}


def even_capacities(total: int, shards: int, least: Sequence[int] = ()) -> list[int]:
    """Capacities that add up to ``total``, at most one byte apart where they exceed ``least``.

    ``least`` holds what a shard cannot go below, as the size of its longest document.
    """
    least = [*least, *[0] * shards][:shards]
    fixed: dict[int, int] = {}
    while True:
        free = [j for j in range(shards) if j not in fixed]
        rest = total - sum(fixed.values())
        over = {j: least[j] for j in free if least[j] * len(free) > rest}
        if not over or len(over) == len(free) or sum(over.values()) > rest:
            break
        fixed |= over
    level = {j: rest // len(free) + (place < rest % len(free)) for place, j in enumerate(free)}
    return [fixed.get(j, level.get(j, 0)) for j in range(shards)]


def text_bytes(text_column: str = "text") -> Column:
    """UTF-8 bytes of the text (none if null) plus 1, so that no document is free."""
    return F.octet_length(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).cast("long") + 1


def write_shards(docs: DataFrame, shard: Column, size: Column, path: str) -> DataFrame:
    """Write documents as they lie, each task's part of a shard as one file; the layout.

    A file's rows are ``doc`` (the row with all its columns, whatever their names) and ``size``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), size.alias("size"), shard.cast("int").alias("shard"))
    rows.write.partitionBy("shard").parquet(path)
    return materialize(_files(docs.sparkSession, path), "layout")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The layout of the files below ``path``: rows, bytes and longest document of each; only the sizes are read."""
    rows = spark.read.schema("size long, shard int").parquet(path)
    found = rows.groupBy("shard", F.concat(F.lit(f"{path}/"), F.expr(_KEY)).alias("path"))
    return found.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("longest")).select(*LAYOUT)


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Rows of the files named, with ``_key`` (folder and name) and ``_at`` (the row's place in its file)."""
    if not paths:
        return spark.createDataFrame([], schema).withColumns({"_key": F.lit(""), "_at": F.lit(0).cast("long")})
    return spark.read.schema(schema).parquet(*paths).withColumns({"_key": F.expr(_KEY), "_at": F.col("_metadata.row_index")})


def _paths(layout: DataFrame) -> list[str]:
    """File names, as a scan holds them anyway; not rows."""
    return sorted(row["path"] for row in layout.select("path").collect())


def _fill(rows: pd.DataFrame, wanted: list[tuple[int, int]]) -> list[int]:
    """A shard for each row, longest first, always the one with most room left."""
    room = [(-amount, shard) for shard, amount in wanted]
    heapq.heapify(room)
    out = [0] * len(rows)
    sizes = rows["size"].to_numpy()
    for at in sorted(range(len(rows)), key=lambda i: (-sizes[i], rows["_at"].iat[i])):
        left, shard = heapq.heappop(room)
        out[at] = shard
        heapq.heappush(room, (left + int(sizes[at]), shard))
    return out


def plan_moves(layout: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """``path, old, shard, amount``: each file's bytes by new shard. A file with one row is handed over whole.

    Only sizes per shard come to the driver. An old shard's files stand in a row, those with the
    longest documents first, and are cut where the transfers end: fewer cuts than transfers, and
    what stays holds the documents that fit nowhere else.
    """
    spark = layout.sparkSession
    sizes = {row["shard"]: row["bytes"] for row in layout.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    old = max(sizes, default=-1) + 1
    spans, ends = [], [0] * old
    moves = least_moves([sizes.get(i, 0) for i in range(old)], capacities)
    # What stays comes first in a shard's row of files.
    for (i, j), amount in sorted(moves.items(), key=lambda x: (x[0][0], x[0][1] != x[0][0], x[0][1])):
        spans.append((i, j, ends[i], ends[i] + amount))
        ends[i] += amount
    cuts = spark.createDataFrame(spans, "old int, shard int, low long, high long")
    # One row per file: as long as a listing of them.
    until = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.col("longest").desc(), "path"))
    placed = layout.withColumn("until", until).withColumn("since", F.col("until") - F.col("bytes")).withColumnRenamed("shard", "old")
    over = placed.join(F.broadcast(cuts), "old").where("since < high AND until > low")
    amount = F.least("until", "high") - F.greatest("since", "low")
    return materialize(over.select("path", "old", "shard", amount.alias("amount")), "moves")


def reshard(layout: DataFrame, capacities: Sequence[int], path: str, schema) -> DataFrame:
    """A new layout of the same documents within ``capacities``, written below ``path`` as far as it changes.

    Files that stay are named again and not touched. Files handed over whole and files that are
    divided are read and written into their new shards, in one job without a shuffle of texts
    that are handed over whole. Sizes come out as planned but for less than a document per cut.
    """
    spark = layout.sparkSession
    moves = plan_moves(layout, capacities)
    each = moves.groupBy("path", "old").agg(F.count(F.lit(1)).alias("parts"), F.min("shard").alias("shard"))
    each = materialize(each.withColumn("stays", (F.col("parts") == 1) & (F.col("shard") == F.col("old"))), "moves-by-file")
    kept = layout.join(each.where("stays").select("path"), "path", "left_semi")
    changed = _paths(each.where("NOT stays"))
    if not changed:
        return materialize(kept.select(*LAYOUT), "layout")
    key = F.substring_index("path", "/", -2).alias("_key")
    divided = each.where("parts > 1")
    wanted = divided.select("path").join(moves, "path").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("shard", "amount"))).alias("wanted"))
    narrow = _read(spark, _paths(divided), "size long").select("_key", "_at", "size").join(F.broadcast(wanted), "_key")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [(part["shard"], part["amount"]) for part in rows["wanted"].iat[0]]
        return pd.DataFrame({"_key": rows["_key"], "_at": rows["_at"], "_to": pd.Series(_fill(rows, parts), rows.index, "int32")})

    # One file's rows at a time, without their texts; a file is one task's writing.
    rows_to = materialize(narrow.groupBy("_key").applyInPandas(split, "_key string, _at long, _to int"), "divided-rows")
    whole = each.where("NOT stays AND parts = 1").select(key, F.col("shard").alias("_whole"))
    docs = _read(spark, changed, schema)
    docs = docs.join(whole, "_key", "left").join(rows_to, ["_key", "_at"], "left")
    docs = docs.select("doc", "size", F.coalesce("_to", "_whole").alias("shard"))
    docs.write.partitionBy("shard").parquet(path)
    return materialize(kept.select(*LAYOUT).unionByName(_files(spark, path)), "layout")


def read_shards(layout: DataFrame, schema) -> DataFrame:
    """``shard, slot, doc, size``: slots number a shard's documents from 0 without gaps, file by file."""
    earlier = Window.partitionBy("shard").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = layout.withColumn("_start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    starts = materialize(starts.select(F.substring_index("path", "/", -2).alias("_key"), "shard", "_start"), "layout-starts")
    rows = _read(layout.sparkSession, _paths(layout), schema)
    return rows.join(starts, "_key").select("shard", (F.col("_start") + F.col("_at")).alias("slot"), "doc", "size")


def even_shards(docs: DataFrame, shards: int = 8, old_shards: int = 5, near: float = 0.001, rounds: int = 4,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Lay documents out by a hash of their id in ``old_shards``, then reshard to ``shards`` of near equal bytes.

    ``shard, slot, doc, size``, read back from the files. ``size`` is the text's UTF-8 bytes plus 1;
    a null text has none. Null ids are one id; an id with a third of all rows makes its old shard
    large, which the flow evens out. Documents are not cut, so a first resharding may miss a
    capacity by part of a long one; it is repeated, with the few bytes that are left to move, until every shard is
    within ``near`` of the mean of its capacity, ``rounds`` times at most. A document longer than
    the mean has its shard to itself. Repeated rows are documents of their own. No documents
    give no rows. All columns are kept inside ``doc``, whatever their names.
    """
    spark = docs.sparkSession
    old = F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(old_shards))
    layout = write_shards(docs, old, text_bytes(text_column), fresh_path(spark, "shards-old"))
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.lit(0).cast("long").alias("size")).schema
    for turn in range(rounds):
        sums = layout.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.max("longest").alias("longest"))
        state = {row["shard"]: row for row in sums.collect()}
        total = sum(row["bytes"] for row in state.values())
        wanted = even_capacities(total, shards, [state[j]["longest"] if j in state else 0 for j in range(shards)])
        off = max(abs((state[j]["bytes"] if j in state else 0) - wanted[j]) for j in range(shards))
        if turn and off <= near * total / shards:
            break
        layout = reshard(layout, wanted, fresh_path(spark, "shards"), schema)
    return read_shards(layout, schema)
