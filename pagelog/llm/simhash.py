"""SimHash near-duplicates: fingerprints within a Hamming distance are linked, groups are components.

Candidates come by the generalised pigeonhole principle. Correlated bits are grouped into partitions; a
dynamic programme gives each partition its own threshold t (perhaps -1: unused) such that the sum of
t + 1 is the distance + 1. Two fingerprints within the distance then are within t in some partition.
Each fingerprint is indexed by its partitions' values, probes all values within t, and candidates are
verified on all 64 bits. Probes into buckets where too many fingerprints meet aren't joined: their
members are linked through shared midpoints, which is exact and grows with the members, not their square.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm.common import Scratch, map_batches, own_columns, texts_of
from pagelog.llm.graph import components

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: A bucket whose indexed rows times probing rows exceed this goes by midpoints.
HOT_PAIRS = 1 << 20
#: What a probe costs in units of a candidate's check: it is shuffled.
PROBE_COST = 20.0


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """The 64 bits of a text, unsigned: a bit is set if over half of the shingles' hashes have it.

    A-Z are lower-cased, words are what ASCII white space separates, shingles count as often as they
    come; a text of fewer words is one shingle, one without words has no bit set.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(parts) - words + 1
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    stops = (ends - 1)[words - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    view = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(view), 255):  # sums of 255 ones fit a byte
        counts += np.add.reduce(np.unpackbits(view[k : k + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in texts_of(batch)], dtype=np.uint64).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found)], names=["doc_id", "fp"])

    return map_batches(own_columns(docs, "doc_id", "text"), run, "doc_id long, fp long")


# -- the plan of a search


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        """Signed, as the JVM has it."""
        m = sum(1 << b for b in self.bits)
        return m - (1 << BITS) if m >> (BITS - 1) else m

    def flips(self) -> list[int]:
        """What to flip to reach every value within the threshold, signed."""
        found = []
        for r in range(self.threshold + 1):
            for some in combinations(self.bits, r):
                m = sum(1 << b for b in some)
                found.append(m - (1 << BITS) if m >> (BITS - 1) else m)
        return found


def group_bits(together: np.ndarray, n: int, parts: int) -> list[tuple[int, ...]]:
    """Bits in so many partitions of about equal width, correlated ones together. together[i, j]: how many
    of n fingerprints have both bits."""
    p = np.diag(together) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free = set(range(BITS))
    groups = []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        pick = sorted(free)
        group = [max(pick, key=lambda b: (corr[b, pick].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            b = max(sorted(free), key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            free.discard(b)
        groups.append(tuple(sorted(group)))
    return groups


def within(differ: np.ndarray) -> np.ndarray:
    """P(at most t of the bits differ) for t = 0, 1, ... if bit j differs with probability differ[j]."""
    exactly = np.array([1.0])
    for d in differ:
        exactly = np.append(exactly * (1 - d), 0) + np.append(0, exactly * d)
    return np.cumsum(exactly)


def allocate(costs: list[np.ndarray], distance: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(t + 1) = distance + 1; costs[i][t + 1] is partition i's cost at t."""
    need = distance + 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * need
    for cost in costs:
        nxt = [(float("inf"), [])] * (need + 1)
        for used, (total, chosen) in enumerate(best):
            for take in range(min(len(cost) - 1, need - used) + 1):
                if total + cost[take] < nxt[used + take][0]:
                    nxt[used + take] = (total + cost[take], [*chosen, take - 1])
        best = nxt
    return best[need]


def plan(together: np.ndarray, n: int, distance: int = DISTANCE) -> list[Partition]:
    """Of all numbers of partitions the cheapest, by estimated candidates and probes."""
    n = max(n, 1)
    p = np.diag(together) / n
    differ = 2 * p * (1 - p)
    choices = []
    for parts in range(1, distance + 2):
        groups = group_bits(together, n, parts)
        costs = []
        for bits in groups:
            near = within(differ[list(bits)])
            cost = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(bits), r) for r in range(t + 1))
                cost.append(n * (probes + 1) * PROBE_COST + n * n / 2 * float(near[min(t, len(bits))]))
            costs.append(np.array(cost))
        total, chosen = allocate(costs, distance)
        choices.append((total, [Partition(b, t) for b, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def bit_statistics(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits are set together, over all fingerprints: 2080 numbers come to the driver."""

    def run(batches):
        total = np.zeros((BITS, BITS), dtype=np.int64)
        n = 0
        for batch in batches:
            view = np.asarray(batch.column("fp")).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(view, axis=1, bitorder="little").astype(np.float32)
            for k in range(0, len(bits), 1 << 20):  # float32 counts exactly up to 2**24
                total += (bits[k : k + (1 << 20)].T @ bits[k : k + (1 << 20)]).astype(np.int64)
            n += len(bits)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(i, -1).astype(np.int32)), "j": pa.array(np.append(j, -1).astype(np.int32)), "c": pa.array(np.append(total[i, j], n))})

    rows = fps.mapInArrow(run, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    together, n = np.zeros((BITS, BITS), dtype=np.int64), 0
    for r in rows:
        if r["i"] < 0:
            n = r["c"]
        else:
            together[r["i"], r["j"]] = together[r["j"], r["i"]] = r["c"]
    return together, n


# -- links


def _signed(values: list[int]):
    return F.array(*[F.lit(v) for v in values])


def signatures(fps: DataFrame, partitions: list[Partition]) -> DataFrame:
    """(part, value, fp, indexed): a row with indexed = true for each partition's value, and one for each
    value within its threshold, which probes."""
    rows = []
    for k, p in enumerate(partitions):
        value = F.col("fp").bitwiseAND(F.lit(p.mask))
        one = lambda v, indexed, k=k: F.struct(F.lit(k).alias("part"), v.alias("value"), F.lit(indexed).alias("indexed"))
        rows += [one(value, True), *[one(value.bitwiseXOR(F.lit(flip)), False) for flip in p.flips()]]
    return fps.select("fp", F.explode(F.array(*rows)).alias("s")).select("s.part", "s.value", "fp", "s.indexed")


def midpoint_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) such that exactly the fingerprints within the distance are connected: two of them share a
    point halfway. A point has at most a ball's number of fingerprints around it, so the arrays are bounded."""
    near, far = distance // 2, distance - distance // 2
    flips = Partition(tuple(range(BITS)), far).flips()
    close = sum(comb(BITS, r) for r in range(near + 1))
    points = fps.select("fp", F.posexplode(_signed(flips)).alias("k", "flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp", (F.col("k") < close).alias("close"))
    met = points.groupBy("point").agg(F.collect_list(F.when(F.col("close"), F.col("fp"))).alias("close"), F.collect_list(F.when(~F.col("close"), F.col("fp"))).alias("far"))
    met = met.where((F.size("close") > 0) & (F.size("close") + F.size("far") > 1)).withColumn("v", F.array_min("close"))
    return met.select(F.explode(F.concat("close", "far")).alias("u"), "v").where("u <> v").distinct()


def links(fps: DataFrame, distance: int = DISTANCE, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(u, v) between distinct fingerprints: their components are those of all pairs within the distance."""
    spark = fps.sparkSession
    scratch = Scratch(spark, "links")
    together, n = bit_statistics(fps)
    rows = signatures(fps, plan(together, n, distance))
    counted = rows.groupBy("part", "value").agg(F.count_if("indexed").alias("held"), F.count_if(~F.col("indexed")).alias("probing"))
    hot = scratch.save(counted.where(F.col("held") * F.col("probing") > hot_pairs).select("part", "value"), "hot")
    crowded = hot.limit(1).count() > 0
    if crowded:
        members = scratch.save(rows.join(hot, ["part", "value"], "left_semi").select("fp").distinct(), "members")
        rows = rows.join(hot, ["part", "value"], "left_anti")
    held = rows.where("indexed").select("part", "value", F.col("fp").alias("u"))
    probing = rows.where("NOT indexed").select("part", "value", F.col("fp").alias("v"))
    found = held.join(probing, ["part", "value"]).where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")
    if crowded:
        found = found.unionByName(midpoint_links(members, distance))
    return found


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text): 16 hexadecimal digits, and
    the smallest doc_id among all documents that links lead to, its own included.

    A null text counts as empty: fingerprint zero, linked like any other. A null doc_id is never the
    smallest unless a group has no other; rows that repeat a doc_id come out as often. Further columns
    are ignored. Equal fingerprints are one node of the graph, so a group of copies costs one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.save(fingerprints(docs), "each")
    nodes = scratch.save(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    grouped = components(links(nodes.select("fp"), distance))
    of_node = nodes.join(grouped, nodes["fp"] == grouped["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    known = scratch.save(of_node.join(least, "root").select("fp", "component_id"), "known")
    return each.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id is its group's smallest. Rows that repeat a doc_id are
    one document: they stay or go together. Rows without a doc_id can't be told apart: they all stay if a
    group has no others, else none does."""
    found = near_duplicates(docs, distance)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")
