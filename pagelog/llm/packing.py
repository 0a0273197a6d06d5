"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Documents become pieces of at most a sequence's length. Pieces are dealt to blocks of bounded size. For
each block some islands evolve solutions: a crossover injects whole well-filled bins of one parent into
the other, bins that now repeat a piece are dissolved, displaced pieces take the place of smaller ones
where that fills a bin better, and the rest is best-fitted. After each epoch every island hands its elite
to the next one. What the blocks' solutions leave in poorly filled bins is packed once more together,
if that takes fewer sequences. A search ends at the lower bound, the sum of lengths over a sequence's: where
best fit in decreasing order meets it already, as with many small pieces, nothing is left to be saved.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelog.llm.common import Scratch, map_iterators, own_columns
from pagelog.llm.tokens import ByteBpe

LENGTH, END = 2048, 0


@dataclass(frozen=True)
class Evolution:
    """The sizes of the search. None of them grows with the input; the number of blocks does."""

    block_items: int = 4096
    islands: int = 2
    epochs: int = 3
    population: int = 4
    offspring: int = 8
    swaps: int = 48  # bins of a child that are tried with displaced pieces, at least; of many bins a quarter
    loose: int = 192  # displaced pieces that such a try looks at
    poor: float = 0.98  # bins filled less take part in the last round


# -- documents to pieces


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text): the tokens with the end token,
    cut only if there are more than length; then all pieces but the first are full.

    A null text is empty: its only token is the end token. ids is little-endian unsigned 32-bit.
    """

    columns = 6 if with_ids else 5

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer_path)
        last = int(end).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = bpe.encode(text or "") + last
                n = len(ids) // 4
                first = n % length or length if n > length else n
                edges = [0, *range(first, n + 1, length)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part), part)[:columns])
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:columns]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:columns])

    return map_iterators(own_columns(docs, "doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


# -- one block


class Bins:
    """A solution under construction: best fit by a list of open bins for each amount of free space."""

    def __init__(self, sizes: list[int], length: int):
        self.sizes, self.length = sizes, length
        self.members: list[list[int]] = []
        self.free: list[int] = []
        self._open: list[list[int]] = [[] for _ in range(length + 1)]
        self._some = 0  # bit f: a bin with free space f may be open

    def add(self, members: list[int]) -> None:
        self.members.append(members)
        self.free.append(0)
        self._offer(len(self.members) - 1, self.length - sum(self.sizes[i] for i in members))

    def _offer(self, k: int, free: int) -> None:
        self.free[k] = free
        if free:
            self._open[free].append(k)
            self._some |= 1 << free

    def fit(self, items: Iterable[int]) -> None:
        """Puts each item where the least space is left; opens a bin if it fits nowhere."""
        for i in items:
            size = self.sizes[i]
            while True:
                above = self._some >> size
                if not above:
                    self.members.append([i])
                    self.free.append(0)
                    self._offer(len(self.members) - 1, self.length - size)
                    break
                f = size + (above & -above).bit_length() - 1
                if not self._open[f]:
                    self._some &= ~(1 << f)
                    continue
                k = self._open[f].pop()
                self.members[k].append(i)
                self._offer(k, f - size)
                break


def fitness(solution: list[list[int]], sizes: list[int], length: int) -> tuple[int, float]:
    """Fewer bins are better; of equally many the one with more bins nearly full."""
    fills = [sum(sizes[i] for i in b) / length for b in solution]
    return -len(solution), sum(f * f for f in fills)


def first_solution(sizes: list[int], length: int, rng: np.random.Generator, shuffle: float) -> list[list[int]]:
    """Best fit in decreasing order, the order disturbed by shuffle (0: not at all)."""
    keys = np.array(sizes) * (1 + shuffle * rng.standard_normal(len(sizes)))
    bins = Bins(sizes, length)
    bins.fit(np.argsort(-keys, kind="stable").tolist())
    return bins.members


def swap_in(bins: list[list[int]], displaced: list[int], sizes: list[int], length: int, rng: np.random.Generator, how: Evolution) -> list[int]:
    """Puts one or two displaced pieces in the place of one or two smaller ones where that fills a bin better; gives
    what is displaced then: as many bytes less, in smaller pieces, which fit more easily."""
    fills = np.array([sum(sizes[i] for i in b) for b in bins])
    pool = sorted(displaced, key=sizes.__getitem__)
    aside: list[int] = []
    if len(pool) > how.loose:
        taken = set(rng.choice(len(pool), how.loose, replace=False).tolist())
        aside, pool = [i for k, i in enumerate(pool) if k not in taken], [i for k, i in enumerate(pool) if k in taken]
    some = np.flatnonzero(fills < length)
    for k in rng.permutation(some)[: max(how.swaps, len(bins) // 4)].tolist():
        if not pool:
            break
        own, fill = bins[k], int(fills[k])
        values = [sizes[i] for i in pool]
        best, chosen = fill, None
        for out in [(), *((i,) for i in own), *combinations(own[:8], 2)]:
            kept = fill - sum(sizes[i] for i in out)
            room = length - kept
            at = bisect_right(values, room) - 1
            if at >= 0 and kept + values[at] > best:
                best, chosen = kept + values[at], (out, (at,))
            low, high = 0, at
            while low < high:  # the best two by pointers from both ends
                both = values[low] + values[high]
                if both > room:
                    high -= 1
                else:
                    if kept + both > best:
                        best, chosen = kept + both, (out, (low, high))
                    low += 1
            if best == length:
                break
        if chosen:
            out, places = chosen
            bins[k] = [i for i in own if i not in out] + [pool[p] for p in places]
            pool = sorted([i for p, i in enumerate(pool) if p not in places] + list(out), key=sizes.__getitem__)
    return pool + aside


def crossover(receiver: list[list[int]], giver: list[list[int]], sizes: list[int], length: int, rng: np.random.Generator, how: Evolution = Evolution()) -> list[list[int]]:
    """Injects well-filled bins of the giver, dissolves the receiver's bins that repeat a piece, its worst ones and
    a few others, and fits in what is left over: by swaps, then by best fit, the large ones first."""
    free = np.array([length - sum(sizes[i] for i in b) for b in giver])
    order = np.argsort(free + rng.random(len(free)), kind="stable")
    full = int((free == free.min()).sum()) if len(free) else 0
    take = int(rng.integers(max(1, full // 4), max(2, full, len(giver) // 2) + 1))
    injected = [giver[k] for k in order[:take]]
    inside = {i for b in injected for i in b}
    displaced: list[int] = []
    rest = []
    for b in receiver:
        left = [i for i in b if i not in inside]
        if len(left) == len(b):
            rest.append(b)
        else:
            displaced += left
    fills = [sum(sizes[i] for i in b) for b in rest]
    gone = set(sorted(range(len(rest)), key=fills.__getitem__)[: max(1, len(rest) // 20)]) if rest else set()
    if len(rest) > 3:
        gone |= set(rng.choice(len(rest), 2, replace=False).tolist())
    stay = [list(b) for b in injected]
    for k, b in enumerate(rest):
        if k in gone and fills[k] < length:
            displaced += b
        else:
            stay.append(list(b))
    displaced = swap_in(stay, displaced, sizes, length, rng, how)
    bins = Bins(sizes, length)
    for b in stay:
        bins.add(b)
    bins.fit(sorted(displaced, key=lambda i: -sizes[i]))
    return bins.members


def evolve(sizes: list[int], length: int, elites: list[list[list[int]]], seed: int, how: Evolution) -> tuple[list[list[int]], int, int]:
    """An island's epoch: the given elites, new solutions beside them, crossovers by tournament. (The best one, the
    crossovers made, the bins of the best solution before them.) It ends early at the lower bound."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // length)
    people = [*elites]
    while len(people) < how.population:
        people.append(first_solution(sizes, length, rng, 0.0 if not people else 0.1))
        if len(people[-1]) <= least:
            return people[-1], 0, len(people[-1])
    ranked = sorted(((fitness(p, sizes, length), -k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    made, began = 0, len(ranked[0][2])
    while made < how.offspring and len(ranked[0][2]) > least:
        a, b = (min(rng.choice(len(ranked), 2, replace=False)) for _ in range(2))
        if a == b:
            b = (a + 1) % len(ranked)
        child = crossover(ranked[a][2], ranked[b][2], sizes, length, rng, how)
        made += 1
        ranked.append((fitness(child, sizes, length), -len(people) - made, child))
        ranked.sort(key=lambda x: x[:2], reverse=True)
        ranked.pop()
    return ranked[0][2], made, began


# -- blocks in Spark


_STATE = "block long, island int, uid long, length int, bin int, elite int, done boolean, crossovers int, began int"


def _epoch(state: DataFrame, length: int, how: Evolution, epoch: int) -> DataFrame:
    """One epoch of every (block, island). A group's rows are its items, once for each elite it starts from."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        rows = rows.sort_values(["elite", "uid"], kind="stable")
        first = rows[rows["elite"] == rows["elite"].iloc[0]]
        uids, sizes = first["uid"].to_numpy(), first["length"].tolist()
        elites = []
        if epoch:
            for _, one in rows.groupby("elite", sort=True):
                order = np.argsort(one["bin"].to_numpy(), kind="stable")
                cuts = np.flatnonzero(np.diff(one["bin"].to_numpy()[order])) + 1
                elites.append([b.tolist() for b in np.split(order, cuts)])
        best, made, began = evolve(sizes, length, elites, hash((block, island, epoch)) & 0x7FFFFFFF, how)
        if epoch:  # what the search has done so far, and where it began
            made, began = made + int(first["crossovers"].iloc[0]), int(first["began"].iloc[0])
        bins = np.empty(len(uids), dtype=np.int32)
        for k, members in enumerate(best):
            bins[members] = k
        ended = len(best) <= -(-sum(sizes) // length)
        return pd.DataFrame({"block": block, "island": island, "uid": uids, "length": sizes, "bin": bins, "elite": 0, "done": ended, "crossovers": made, "began": began})

    return state.groupBy("block", "island").applyInPandas(run, _STATE)


def pack_items(items: DataFrame, length: int, how: Evolution, scratch: Scratch, name: str) -> DataFrame:
    """(uid, length, block, bin, crossovers, began) of items(uid, length), every bin of a block holding at most length.

    crossovers are those of the block's winning island; began is the number of its bins before them, by best fit."""
    n = items.count()
    blocks = max(1, -(-n // how.block_items))
    start = items.select(
        F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))).alias("island"), "uid", F.col("length").cast("int").alias("length"), F.lit(0).alias("bin"), F.lit(0).alias("elite"), F.lit(False).alias("done"), F.lit(0).alias("crossovers"), F.lit(0).alias("began")
    )
    state = scratch.save(_epoch(start, length, how, 0), f"{name}0")
    for epoch in range(1, how.epochs):
        # every island also starts from its neighbour's elite; a block with an island at the bound only needs that one
        best = state.groupBy("block").agg(F.bool_or("done").alias("bound"))
        if not best.where("NOT bound").limit(1).count():
            break
        marked = state.join(F.broadcast(best) if blocks <= 100_000 else best, "block")
        going = marked.where(~F.col("bound"))
        migrants = going.withColumn("island", F.pmod(F.col("island") + 1, F.lit(how.islands)).cast("int")).withColumn("elite", F.lit(1))
        both = going.unionByName(migrants) if how.islands > 1 else going
        nxt = scratch.save(_epoch(both.drop("bound"), length, how, epoch).unionByName(marked.where("bound AND done").drop("bound")), f"{name}{epoch}")
        scratch.drop(f"{name}{epoch - 1}")
        state = nxt
    counts = state.groupBy("block", "island").agg(F.max("bin").alias("bins"))
    chosen = counts.groupBy("block").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    return state.join(F.broadcast(chosen) if blocks <= 100_000 else chosen, ["block", "island"]).select("uid", "length", "block", "bin", "crossovers", "began")


def search_report(placed: DataFrame) -> DataFrame:
    """(block, crossovers, began, bins) of what pack_items gives: how many crossovers ran, and the bins before and after them."""
    return placed.groupBy("block").agg(F.first("crossovers").alias("crossovers"), F.first("began").alias("began"), (F.max("bin") + 1).alias("bins"))


def pack(pieces: DataFrame, length: int = LENGTH, how: Evolution = Evolution()) -> DataFrame:
    """pieces(uid, length, ...) with sequence_id and offset. uid must be unique; lengths lie between 1 and length.

    A full piece is a sequence of its own. The others are packed by blocks; bins that are filled poorly,
    some of each block, are packed together in a second round, whose packing counts if it has fewer bins.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    items = pieces.where(F.col("length") < length).select("uid", "length")
    placed = scratch.save(pack_items(items, length, how, scratch, "a"), "first")
    fills = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    poor = scratch.save(fills.where(F.col("fill") < how.poor * length).select("block", "bin"), "poor")
    again = scratch.save(placed.join(poor, ["block", "bin"], "left_semi").select("uid", "length"), "again")
    second = scratch.save(pack_items(again, length, how, scratch, "b"), "second")
    number = lambda odd: (F.col("block") * (4 * how.block_items) + F.col("bin")) * 2 + odd  # noqa: E731  a block has few more items than block_items
    if second.select("block", "bin").distinct().count() < poor.count():
        kept = placed.join(poor, ["block", "bin"], "left_anti")
        both = kept.select("uid", number(0).alias("sequence_id")).unionByName(second.select("uid", number(1).alias("sequence_id")))
    else:
        both = placed.select("uid", number(0).alias("sequence_id"))
    joined = pieces.join(both, "uid", "left").withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("uid")))
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, how: Evolution = Evolution()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs(doc_id, text).

    A null text is empty and still takes a place for its end token; a null or repeated doc_id and equal
    rows are packed like any other; further columns are ignored; an empty table gives no rows. Texts of any
    length and content are taken whole. Within a sequence pieces stand in the order of their rows; of equally
    good solutions the first found counts. Only lengths travel: the ids themselves stay with tokenize_pieces,
    which gives them again at any time.
    """
    scratch = Scratch(docs.sparkSession, "pieces")
    pieces = scratch.save(tokenize_pieces(docs, tokenizer_path, length, with_ids=False).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, length, how).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
