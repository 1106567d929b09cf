"""Documents joined by the Jaccard similarity of their word n-grams, exactly, with their connected components.

The product of the document by n-gram matrix with its own transpose holds every overlap. Its
columns are put in one order, commonest last, and of a row only so many leading entries are
multiplied as a similar row must share one of (size bounds). What is left is done in blocks:
first columns against their first row (stars), which joins large groups of copies without
their pairs, then all rows of different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adtally.llm.components import join_components
from adtally.llm.features import give_back
from adtally.llm.shuffles import dropping_shuffles, small_batches
from adtally.session import discard, materialize

#: Ids sent to every task at most: 24 bytes each, so about 50 MB.
BROADCAST_IDS = 2_000_000

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class Shingler:
    """Distinct n-gram numbers of whole texts: words parted by ASCII white space, A-Z lower-cased.

    A text with fewer than ``words`` words is one n-gram of them all; one without is empty.
    """

    def __init__(self, words: int = 5, held: int = 100_000) -> None:
        self.words, self._held = words, held
        self._known: dict[str, int] = {}
        multipliers = [_ODD[n % 5] + 2 * (n // 5) * _ODD[0] & (1 << 64) - 1 for n in range(words)]
        self._multipliers = np.array(multipliers, np.uint64)

    def slices(self, texts: pa.Array, slice_bytes: int = 1 << 20) -> Iterator[list[np.ndarray]]:
        """The sorted n-gram numbers of each text, a slice of texts at a time."""
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + slice_bytes, "right")))
            yield self._of(texts.slice(at, stop - at))
            at = stop
            # What a slice took would stay with the worker until it ends.
            give_back()

    def _of(self, texts: pa.Array) -> list[np.ndarray]:
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._known) > self._held:
            self._known.clear()
        known = self._known
        for word in distinct:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        numbers = np.fromiter(map(known.__getitem__, distinct), np.uint64, len(distinct))
        codes = coded.indices.to_numpy()
        words = numbers[codes] if len(codes) else np.zeros(0, np.uint64)
        texts_of = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy()))
        if "" in known and len(codes):
            # ASCII splitting leaves empty strings at the edges of a text.
            real = np.array([word != "" for word in distinct])[codes]
            words, texts_of = words[real], texts_of[real]
        counts = np.bincount(texts_of, minlength=len(cut))
        starts = np.cumsum(counts) - counts
        with np.errstate(over="ignore"):
            sums = np.zeros(max(0, len(words) - self.words + 1), np.uint64)
            for n, multiplier in enumerate(self._multipliers):
                sums += words[n : n + len(sums)] * multiplier
            sums = _mixed(sums)
            found = []
            for start, count in zip(starts.tolist(), counts.tolist()):
                if count >= self.words:
                    own = np.sort(sums[start : start + count - self.words + 1])
                    found.append(own[np.append(True, own[1:] != own[:-1])])
                elif count:
                    short = (words[start : start + count] * self._multipliers[:count]).sum(dtype=np.uint64)
                    found.append(_mixed(np.array([short + np.uint64(count)], np.uint64)))
                else:
                    found.append(np.zeros(0, np.uint64))
        return found


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ numbers >> np.uint64(32)) * np.uint64(_ODD[3])
    numbers = (numbers ^ numbers >> np.uint64(29)) * np.uint64(_ODD[4])
    return numbers ^ numbers >> np.uint64(32)


def common_ngrams(texts: DataFrame, words: int, share: float, least: int, most: int) -> np.ndarray:
    """N-grams found in at least ``least`` texts of a part ``share`` of all, at most ``most`` of them, sorted.

    They only decide the order of the matrix's columns, so they decide what a join costs and
    never what it finds. A column of the others has about ``least / share`` entries at most,
    however many texts there are.
    """
    drawn = texts.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("_text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Shingler(words)
        for batch in batches:
            for part in reader.slices(batch.column("_text")):
                numbers, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *part]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(numbers.view(np.int64)), pa.array(counts)], names=["ngram", "n"])

    counted = drawn.mapInArrow(listed, "ngram long, n long").groupBy("ngram").agg(F.sum("n").alias("n"))
    common = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "ngram").limit(most).select("ngram").toArrow()
    return np.sort(np.asarray(common.column("ngram")).astype(np.int64).view(np.uint64))


def signatures(texts: DataFrame, words: int, common: np.ndarray, parts: tuple[int, int], with_set: bool) -> DataFrame:
    """``_id, n, signature`` of each text, and its set (``ngrams``) or the leading part of it (``lead``).

    ``lead`` is in the order of columns: rare n-grams first, by number. ``rare`` says how many
    of its entries are. Two sets similar to at least ``parts`` share an entry of their leads.
    """
    over, under = parts

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Shingler(words)
        for batch in batches:
            at = 0
            for sets in reader.slices(batch.column("_text")):
                counts = np.array([len(s) for s in sets], np.int64)
                ids = batch.column("_id").slice(at, len(sets))
                at += len(sets)
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                if with_set:
                    flat, offsets, rare = np.concatenate(sets), np.append(0, np.cumsum(counts)), counts
                else:
                    leads, rare = [], []
                    for own, count in zip(sets, counts.tolist()):
                        places = np.searchsorted(common, own)
                        often = common[np.minimum(places, len(common) - 1)] == own if len(common) else np.zeros(len(own), bool)
                        lead = count - -(-over * count // under) + 1 if count else 0
                        first = np.concatenate([own[~often], own[often]])[:lead]
                        leads.append(first)
                        rare.append(min(lead, int((~often).sum())))
                    flat = np.concatenate([np.zeros(0, np.uint64), *leads])
                    offsets = np.append(0, np.cumsum([len(x) for x in leads]))
                lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts), pa.array(marks, pa.binary()), pa.array(np.array(rare, np.int64)), lists],
                    names=["_id", "n", "signature", "rare", "ngrams" if with_set else "lead"],
                )

    kept = "ngrams" if with_set else "lead"
    return texts.select("_id", "_text").mapInArrow(read, f"_id long, n long, signature binary, rare long, {kept} array<long>")


def _near_enough(i: str, j: str, m: str, n: str, parts: tuple[int, int]):
    """Whether rows of sizes m and n can be similar if their first shared entries are at places i and j."""
    over, under = parts
    rest = F.least(F.col(m) - F.col(i), F.col(n) - F.col(j))
    return (under + over) * rest >= over * (F.col(m) + F.col(n))


@dropping_shuffles
@small_batches
def similar_components(docs: DataFrame, words: int = 5, parts: tuple[int, int] = (4, 5), share: float = 1 / 8,
                       stars: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``_id, n_shingles, component_id`` per row of ``docs``; rows link when similar to ``parts`` or more.

    Similarity is that of the sets of distinct n-grams; the component's name is its least id.
    Texts with equal sets are one row of the matrix. A row without words, or with a null text,
    has an empty set and is linked with nothing. Rows that share their least id are one node. A row
    with a null id is linked with nothing and has a null component.
    """
    spark = docs.sparkSession
    over, under = parts
    texts = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text"))
    common = common_ngrams(texts, words, share, 4, 1 << 20)
    leads = materialize(signatures(texts, words, common, parts, with_set=False), "ngram-leads")
    # Equal sets have one node: the least id. A set that a third of all rows share is reduced in each task.
    sets = leads.where(F.col("_id").isNotNull() & (F.col("n") > 0)).groupBy("signature").agg(
        F.min("_id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("rare").alias("rare"),
        F.first("lead").alias("lead"),
    )
    # Leads are most of what is written: each table of them goes when the next is there.
    sets = materialize(sets, "ngram-sets")
    read = materialize(leads.select("_id", "n", "signature"), "ngram-rows")
    discard(leads)
    nodes = materialize(sets.select("signature", "node", "copies"), "ngram-nodes")
    # An entry is two numbers beside its column: the row, and its size over the place in its lead.
    entries = sets.select("node", "n", "rare", F.posexplode("lead").alias("at", "ngram")).select(
        "ngram", F.shiftleft("n", 32).bitwiseOR(F.col("at")).alias("sized"), "node", (F.col("at") < F.col("rare")).alias("seldom")
    )
    alone = Window.partitionBy("ngram")
    rare = entries.where("seldom").drop("seldom").withColumn("met", F.count("*").over(alone)).where("met > 1").drop("met")
    shared = rare.union(entries.where("not seldom").drop("seldom")).select(
        "node", F.shiftright("sized", 32).alias("n"), F.col("sized").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"), "ngram"
    )
    shared = materialize(shared, "ngram-shared")
    discard(sets)
    # The row that the others of a group were made from shares more of its entries than they do.
    centred = shared.groupBy("node").agg((F.count("*") / F.max("n")).alias("central"))
    centred = materialize(centred, "ngram-central")
    labels = materialize(centred.select("node", F.col("node").alias("comp")), "ngram-labels")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """``a, b, linked``: pairs whose leads leave the bound of their sizes in reach, by their whole sets.

        All that two leads share is among the shared entries. Beyond a lead of a row of size m
        there are ``ceil(m * over / under) - 1`` entries, so that much more can be shared at most.
        """
        mine = shared.select(F.col("node").alias("a"), F.col("n").alias("m"), "ngram")
        other = shared.select(F.col("node").alias("b"), "n", "ngram")
        counted = pairs.select("a", "b").join(mine, "a").join(other, ["b", "ngram"]).groupBy("a", "b").agg(
            F.count("*").alias("c"), F.first("m").alias("m"), F.first("n").alias("n")
        )
        beyond = F.ceil(F.greatest("m", "n") * over / under) - 1
        hopeful = counted.where((under + over) * (F.col("c") + beyond) >= over * (F.col("m") + F.col("n")))
        hopeful = materialize(hopeful.select("a", "b"), f"{name}-pairs")
        wanted = materialize(hopeful.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), f"{name}-wanted")
        # Few ids go to the texts; many are joined by a shuffle, with the same rows.
        few = wanted.count() <= BROADCAST_IDS
        own_texts = texts.join(F.broadcast(wanted) if few else wanted, "_id", "left_semi")
        sets = signatures(own_texts, words, common, parts, with_set=True).select("_id", "n", "ngrams")
        sets = materialize(sets, f"{name}-sets")
        x = sets.select(F.col("_id").alias("a"), F.col("n").alias("m"), F.col("ngrams").alias("x"))
        y = sets.select(F.col("_id").alias("b"), "n", F.col("ngrams").alias("y"))
        both = hopeful.join(x, "a").join(y, "b")
        overlap = F.size(F.array_intersect("x", "y"))
        linked = (under + over) * overlap >= over * (F.col("m") + F.col("n"))
        checked = both.select("a", "b", linked.alias("linked")).groupBy("a", "b").agg(F.max("linked").alias("linked"))
        checked = materialize(checked, name)
        discard(sets)
        return checked

    tried = spark.createDataFrame([], "a long, b long, linked boolean")
    band = F.floor(F.log(F.col("n")) / float(np.log(under / over))).cast("int")
    for _ in range(stars):
        # Each column's entries of one size band against its most central entry and one of the least and greatest component.
        placed = shared.join(labels, "node").join(centred, "node").withColumn("band", band)
        heads = placed.groupBy("ngram", "band").agg(
            F.min(F.struct("comp", "node", "n", "at")).alias("low"), F.max(F.struct("comp", "node", "n", "at")).alias("high"),
            F.max_by(F.struct("comp", "node", "n", "at"), F.struct("central", "node")).alias("best"),
        ).where("low.comp <> high.comp")
        met = placed.join(heads, ["ngram", "band"]).select(
            "node", "n", "at", "comp", F.explode(F.array("best", "low", "high")).alias("head")
        ).where("comp <> head.comp").select(
            "node", "n", "at", F.col("head.node").alias("other"), F.col("head.n").alias("m"), F.col("head.at").alias("place")
        ).where(_near_enough("at", "place", "n", "m", parts))
        counted = met.groupBy("node", "other").agg(F.count("*").alias("shared"))
        first = Window.partitionBy("node").orderBy(F.desc("shared"), "other")
        pairs = counted.withColumn("turn", F.row_number().over(first)).where("turn <= 2").select(
            F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
        ).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "ngram-star-pairs")
        checked = verified(pairs, "ngram-stars")
        tried = tried.union(pairs.select("a", "b", F.lit(False).alias("linked")))
        labels = join_components(labels, checked.where("linked").select("a", "b"))
    # What is left: entries of one column that lie in different components.
    placed = shared.join(labels, "node")
    mixed_columns = placed.groupBy("ngram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    open_entries = materialize(placed.join(mixed_columns.select("ngram"), "ngram", "left_semi"), "ngram-open")
    left = open_entries.select("ngram", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("m"), F.col("at").alias("i"))
    right = open_entries.select("ngram", F.col("node").alias("b"), F.col("comp").alias("cb"), "n", F.col("at").alias("j"))
    pairs = left.join(right, "ngram").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near_enough("i", "j", "m", "n", parts))
    pairs = pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    checked = verified(materialize(pairs, "ngram-pairs"), "ngram-rest")
    labels = join_components(labels, checked.where("linked").select("a", "b"))
    names = materialize(
        nodes.join(labels, "node", "left").select("signature", "copies", F.coalesce("comp", "node").alias("component_id")), "ngram-names"
    )
    # Sets of over a thousandth of all rows, so less than a thousand, go to every task; their rows are not shuffled.
    often = F.col("copies") * 1_000 > read.count()
    heavy = F.broadcast(names.where(often).select("signature", "component_id"))
    others = read.join(heavy, "signature", "left_anti").join(names.where(~often).select("signature", "component_id"), "signature", "left")
    joined = read.join(heavy, "signature").unionByName(others)
    return joined.select(
        "_id", F.col("n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id")
    )
