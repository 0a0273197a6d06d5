"""Near-duplicate groups for the pipeline: SimHash links, and near copies by shingles of words beside them.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at least 0.8;
most such pairs differ in more fingerprint bits than probes can reach. Candidates share a band of min-hashes;
a pair of similarity 0.8 shares none of the bands with probability (1 - 0.8 ** ROWS) ** BANDS, about 0.00007.
Every candidate is verified on the whole sets. First each text is held against one other of its buckets, the
same for most of a large group, which collapses it; then texts in buckets that still hold several groups
are joined exactly, by their rarest shingles, so families that share much but not enough make no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm.common import Scratch, bit_map, map_batches, maybe_in, own_columns, texts_of
from pagelog.llm.graph import components
from pagelog.llm.simhash import DISTANCE, SEED, fingerprint, links
from pagelog.llm.words import WordTable, strides

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 24, 5
_MIX = np.uint64(0x9FB21C651E98DF25)


def _codes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in words], dtype=np.uint64)


class Shingles:
    """Texts to the sorted hashes of their distinct shingles. Words are lower-cased and parted at white space; a
    text of fewer words than a shingle is one shingle, one without words has none."""

    def __init__(self, size: int = SHINGLE):
        self.size, self._words = size, WordTable(_codes)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words = [t.lower().split() for t in texts]
        ids = self._words.ids(words)
        if not len(ids):
            return [np.empty(0, np.uint64) for _ in texts]
        codes, found, at = self._words.table[ids], [], 0
        for n in map(len, words):
            c, w = codes[at : at + n], min(self.size, n)
            at += n
            h = np.zeros(n - w + 1 if n else 0, dtype=np.uint64)
            for k in range(w):
                h = (h ^ c[k : k + len(h)]) * _MIX
                h ^= h >> np.uint64(29)
            found.append(np.unique(h))
        return found


_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """sets x BANDS: a hash of each band's min-hashes and its number; 0 for empty sets."""
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    has = np.flatnonzero(sizes)
    if not len(has):
        return out
    flat, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[has]
    for b in range(BANDS):
        h = np.full(len(has), b + 1, dtype=np.uint64)
        for factor, shift in zip(_FACTORS[b], _SHIFTS[b], strict=True):
            x = flat * factor + shift
            x ^= x >> np.uint64(32)
            h = (h ^ np.minimum.reduceat(x * _MIX, starts)) * _MIX
            h ^= h >> np.uint64(29)
        out[has, b] = h
    return out


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, node, size, bands): the SimHash fingerprint, a hash that stands for the set of shingles, the
    set's size and its bands."""
    held: list[Shingles] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Shingles())
        texts, sizes, nodes, marks = texts_of(batch), [], [], []
        for a, b in strides([len(t) for t in texts]):
            sets = held[0](texts[a:b])
            sizes += map(len, sets)
            nodes += [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
            marks.append(bands(sets))
        every = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(marks).astype(np.int64).ravel()))
        fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(fps), pa.array(np.array(nodes, dtype=np.uint64).astype(np.int64)), pa.array(sizes, pa.int32()), every],
            names=["doc_id", "fp", "node", "size", "bands"],
        )

    return map_batches(own_columns(docs, "doc_id", "text"), run, "doc_id long, fp long, node long, size int, bands array<long>", held)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the texts whose nodes are wanted(node). The sets are made anew from the texts, which take
    less room than sets that wait; only those in a bit map of fixed size leave their task."""
    held: list[Shingles] = []
    known = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, "node"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Shingles())
        texts, nodes, sets = texts_of(batch), [], []
        for a, b in strides([len(t) for t in texts]):
            made = held[0](texts[a:b])
            own = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in made], dtype=np.uint64)
            at = np.flatnonzero(maybe_in(known.value, own))
            nodes.append(own[at])
            sets += [made[k] for k in at.tolist()]
        values = np.concatenate(sets).astype(np.int64) if sets else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).astype(np.int64)), lists], names=["node", "shingles"])

    made = map_batches(own_columns(docs, "text"), run, "node long, shingles array<long>", held)
    return made.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def prefix_pairs(nodes: DataFrame, sets: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """(u, v) of nodes(node, size, c) of different groups c that may be alike enough, by their rarest shingles.

    With all shingles ordered by how many nodes have them, rarest first, two sets of similarity s share one of the
    first size - s * size + 1 shingles of the larger and the first size - 2 s / (1 + s) * size + 1 of the smaller.
    So texts that have much in common with all others of a family, and enough of their own, meet nobody. Of a
    shingle's nodes those of its largest group don't meet each other."""
    tokens = sets.join(nodes, "node").select("node", "size", "c", F.explode("shingles").alias("token"))
    spread = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(spread, "token").groupBy("node").agg(F.first("size").alias("size"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    first = lambda share: (F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1).cast("int")
    rows = ranked.select("node", "size", "c", first(2 * least / (1 + least)).alias("q"), F.posexplode(F.slice("t", F.lit(1), first(least))).alias("at", "s"))
    rows = scratch.save(rows.where("s.n > 1").select(F.col("s.token").alias("token"), "node", "size", "c", (F.col("size") - F.col("at")).alias("rest"), (F.col("at") < F.col("q")).alias("indexed")), "prefixes")
    counted = rows.groupBy("token", "c").agg(F.count("*").alias("n"))
    largest = counted.groupBy("token").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.count("*").alias("groups")).where("groups > 1").select("token", "largest")
    mixed = scratch.save(rows.join(largest, "token").withColumn("outside", F.col("c") != F.col("largest")), "mixed_tokens")
    other = mixed.select("token", F.col("node").alias("y"), F.col("size").alias("y_size"), F.col("c").alias("y_c"), F.col("rest").alias("y_rest"), F.col("outside").alias("y_outside")).where(F.col("indexed"))
    larger = (F.col("size") > F.col("y_size")) | ((F.col("size") == F.col("y_size")) & (F.col("node") > F.col("y")))
    # from the first shingle that both have, what is left of either bounds what they share
    enough = F.least("rest", "y_rest") >= least / (1 + least) * (F.col("size") + F.col("y_size")) - 1e-6
    near = larger & enough & (F.col("y_size") >= least * F.col("size") - 1e-6) & (F.col("c") != F.col("y_c"))
    met = mixed.join(other.where("y_outside"), "token").where(near).select("node", "y").unionByName(mixed.where("outside").join(other.where("NOT y_outside"), "token").where(near).select("node", "y"))
    return met.select(F.greatest("node", "y").alias("u"), F.least("node", "y").alias("v")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of pairs(u, v) whose sets(node, shingles) are alike enough."""
    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("shingles").alias(name))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(of("v", "b"), "v").join(of("u", "a"), "u").where(both / (F.size("a") + F.size("b") - both) >= least).select("u", "v")


def near_copy_links(each: DataFrame, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v) between nodes of each(node, size, bands): their components are those of all candidates alike enough.
    docs are the texts that each was made of."""
    scratch = Scratch(each.sparkSession, "nearcopies")
    slim = each.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    rows = slim.select("node", "size", F.explode("bands").alias("bucket"))
    first_of = F.min_by(F.struct("node", "size"), F.xxhash64("node"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), first_of.alias("head")).where("n > 1").select("bucket", "head")
    members = scratch.save(rows.join(shared, "bucket"), "members")
    sets = scratch.save(shingle_sets(docs, members.select("node").distinct()), "sets")
    ordered = [F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")]
    alike = F.least("size", "head_size") >= least * F.greatest("size", "head_size") - 1e-6  # else the sets can't be
    # of its buckets' heads each text is held against one
    one = members.where("node <> head.node").groupBy("node", "size").agg(F.min_by("head", F.xxhash64("head.node")).alias("h"))
    stars = scratch.save(one.select("node", "size", F.col("h.node").alias("head"), F.col("h.size").alias("head_size")).where(alike).select(*ordered).distinct(), "stars")
    first = scratch.save(verified(stars, sets, least), "first")
    grouped = components(first).withColumnRenamed("component", "c")
    known = members.select("bucket", "node", "size").join(grouped, "node", "left").select("bucket", "node", "size", F.coalesce("c", "node").alias("c"))
    several = known.groupBy("bucket").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("bucket")
    nodes = known.join(several, "bucket", "left_semi").select("node", "size", "c").distinct()
    rest = prefix_pairs(scratch.save(nodes, "mixed"), sets, scratch, least).join(stars, ["u", "v"], "left_anti")
    return first.unionByName(verified(rest, sets, least))


def _least_ids(each: DataFrame, links_: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component_id): the smallest doc_id of the node's component, all nodes of each(doc_id, node) included."""
    nodes = each.groupBy("node").agg(F.min("doc_id").alias("least"))
    grouped = components(links_).withColumnRenamed("node", "of")
    of_node = nodes.join(grouped, nodes["node"] == grouped["of"], "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    lowest = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    return scratch.save(of_node.join(lowest, "root").select("node", "component_id"), "known")


def near_copies(docs: DataFrame, least: float = LEAST, distance: int | None = None) -> DataFrame:
    """(doc_id, component_id) for each row of docs(doc_id, text): the smallest doc_id among all documents that
    links lead to, its own included. With a distance, fingerprints within it are links as well, as in simhash.

    Equal sets are linked, so texts without words are; a null text counts as empty. A null doc_id is never
    the smallest unless a group has no other; rows that repeat a doc_id come out as often; further columns
    are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "nearcopies")
    each = scratch.save(described(docs), "each")
    found = near_copy_links(each, docs, least)
    if distance is not None:
        fps = scratch.save(each.select("fp").distinct(), "fps")
        roots = components(links(fps, distance)).withColumnRenamed("node", "fp")
        pairs = scratch.save(each.select("fp", "node").distinct().join(roots, "fp", "left").select(F.coalesce("component", "fp").alias("root"), "node").distinct(), "pairs")
        # the nodes of a group of fingerprints are linked to the smallest of them
        smallest = pairs.groupBy("root").agg(F.min("node").alias("v"))
        found = found.unionByName(pairs.join(smallest, "root").where("node <> v").select(F.col("node").alias("u"), "v"))
    known = _least_ids(each, found, scratch)
    return each.select("doc_id", "node").join(known, "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, least: float = LEAST, distance: int | None = DISTANCE) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id is its group's smallest, by both kinds of links.

    Rows that repeat a doc_id are one document: they stay or go together. Rows without a doc_id can't be
    told apart: they all stay if a group has no others, else none does."""
    found = near_copies(docs, least, distance)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")
