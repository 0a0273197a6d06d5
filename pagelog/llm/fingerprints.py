"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks places; a chunk ends at a strict mark before the normal size,
at a loose one after it, and at the maximum size otherwise (normalised chunking). A fingerprint is the
set of its chunks' digests with their lengths; two of them are alike by the weight that they share,
relative to the lighter one (containment). Inserting or cutting text only changes chunks nearby.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagelog.llm.common import map_iterators, own_columns
from pagelog.llm.words import strides

WINDOW = 32
#: Rows for each range of doc_ids, the most ranges, and bytes of text for each task that reads some of them.
ROWS_A_RANGE, MOST_RANGES, TASK_BYTES = 1024, 100_000, 16 << 20


def _gear_table() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=0x9E37) for b in range(256)], dtype=np.uint32)


GEAR = _gear_table()


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes. The least size is the hash's window at least, so a mark never depends on an earlier chunk."""

    least: int = 32
    normal: int = 64
    most: int = 256
    strict_bits: int = 7
    loose_bits: int = 5

    def __post_init__(self):
        if not WINDOW <= self.least <= self.normal < self.most < 65536:
            raise ValueError("sizes must grow, from the window on, below 65536")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-k]] << k over the last 32 bytes, by doubling the window."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span)) if len(h) > span else h[span:]
        span *= 2
    return h


def _next_mark(marks: np.ndarray, n: int) -> np.ndarray:
    """For each place the first mark at or after it; n + 1 if none."""
    nxt = np.full(n + 1, n + 1, dtype=np.int64)
    nxt[marks] = marks
    return np.minimum.accumulate(nxt[::-1])[::-1]


def boundaries(texts: list[bytes], chunking: Chunking = Chunking()) -> list[list[int]]:
    """For each text the ends of its chunks. All texts advance together, a chunk of each at a step."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    out: list[list[int]] = [[] for _ in texts]
    n = int(lengths.sum())
    if not n:
        return out
    h = gear_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))
    top = np.uint32(32 - chunking.strict_bits)
    strict = _next_mark(np.flatnonzero(h >> top == 0) + 1, n)  # a chunk ends behind its mark
    loose = _next_mark(np.flatnonzero(h >> np.uint32(32 - chunking.loose_bits) == 0) + 1, n)
    live = np.flatnonzero(lengths)
    at, stop = begins[live], ends[live]
    owners, cuts = [], []
    while len(live):
        first = strict[np.minimum(at + chunking.least, n)]
        second = loose[np.minimum(at + chunking.normal, n)]
        cut = np.where(first < at + chunking.normal, first, second)
        cut = np.minimum(np.minimum(cut, at + chunking.most), stop)
        owners.append(live)
        cuts.append(cut)
        more = cut < stop
        live, at, stop = live[more], cut[more], stop[more]
    owner, cut = np.concatenate(owners), np.concatenate(cuts)
    order = np.argsort(owner, kind="stable")
    owner, cut = owner[order], cut[order] - begins[owner[order]]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    cut = cut.tolist()
    for k in range(len(texts)):
        out[k] = cut[edges[k] : edges[k + 1]]
    return out


def chunk_sets(texts: list[bytes], chunking: Chunking = Chunking()) -> list[set[int]]:
    """For each text its chunks: 48 bits of the digest, then 16 of the length."""
    digest = xxhash.xxh64_intdigest
    out = []
    for text, ends in zip(texts, boundaries(texts, chunking), strict=True):
        found, start = set(), 0
        for end in ends:
            found.add(digest(text[start:end]) & 0xFFFFFFFFFFFF0000 | end - start)
            start = end
        out.append(found)
    return out


def as_string(chunks: set[int]) -> str:
    return np.sort(np.fromiter(chunks, dtype=np.uint64, count=len(chunks))).astype(">u8").tobytes().hex()


def from_string(fingerprint: str) -> set[int]:
    return set(np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").tolist())


def _weight(chunks: Iterable[int]) -> int:
    return sum(c & 0xFFFF for c in chunks)


def likeness(a: set[int], b: set[int]) -> float:
    """The shared weight as a part of the lighter fingerprint's; of two empty ones 1."""
    if a == b:
        return 1.0
    least = min(_weight(a), _weight(b))
    return _weight(a & b) / least if least else 0.0


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many characters of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(rows: DataFrame, rows_a_range: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bounds of id, bounds of tie, bytes of text): bounds that cut the rows, by id and then tie, into even ranges; at
    most MOST_RANGES of them, however many rows there are. An id with very many rows is cut by its ties, which are
    hashes, so even parts of their range are even parts of the rows."""
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, min(n // rows_a_range, MOST_RANGES))
    if parts == 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), size or 0
    shares = [k / parts for k in range(1, parts)]
    found = np.array(rows.agg(F.percentile_approx("id", shares, max(10_000, 2 * parts))).first()[0], dtype=np.int64)
    ids, counts = np.unique(found, return_counts=True)
    ties = np.concatenate([[-(2**63) + (k << 64) // m for k in range(m)] for m in counts.tolist()]).astype(np.int64)
    return np.repeat(ids, counts), ties, size or 0


def _place(ids: np.ndarray, ties: np.ndarray, id_: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """How many of the bounds lie at or before each (id, tie)."""
    low, high = np.searchsorted(ids, id_, side="left"), np.searchsorted(ids, id_, side="right")
    for k in np.unique(id_[high > low]).tolist():  # ids that are bounds themselves
        at = np.flatnonzero(id_ == k)
        a, b = int(low[at[0]]), int(high[at[0]])
        high[at] = a + np.searchsorted(ties[a:b], tie[at], side="right")
    return high


def fingerprint_documents(docs: DataFrame, chunking: Chunking = Chunking(), rows_a_range: int = ROWS_A_RANGE, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row for each row of docs(doc_id, text) with the fingerprints of its text and of its edited text,
    whose second half comes from the next document.

    Next is by ascending doc_id, a null id before all others, equal ids by a hash of the text and by the text;
    after the last comes the first. A null text counts as empty; further columns are ignored; an only row
    follows itself. The rows are dealt by ranges of doc_id (and of that hash, where very many rows have one id),
    the text moves once, to as many tasks as its bytes ask for; the first row of each range also goes to the
    range before. A task reads its ranges in order and holds one Arrow batch; some megabytes of it are chunked
    at a time.
    """
    least = -(2**63)
    given = own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    keyed = given.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(least))).withColumn("tie", F.xxhash64("text"))
    bound_ids, bound_ties, size = _ranges(keyed, rows_a_range)

    @F.pandas_udf(LongType())
    def range_of(id_, tie):
        return pd_series(_place(bound_ids, bound_ties, id_.to_numpy(), tie.to_numpy()))

    rows = keyed.withColumn("part", range_of("id", "tie"))
    firsts = rows.groupBy("part").agg(F.min(F.struct("id", "tie")).alias("first")).orderBy("part").collect()  # at most MOST_RANGES rows
    before = {tuple(r["first"]): firsts[k - 1]["part"] for k, r in enumerate(firsts)}  # of the first range the last
    keys = sorted(before)
    key_ids, key_ties = np.array([k[0] for k in keys], dtype=np.int64), np.array([k[1] for k in keys], dtype=np.int64)
    where = np.array([before[k] for k in keys], dtype=np.int64)

    @F.pandas_udf(LongType())
    def also_in(id_, tie):
        id_, tie = id_.to_numpy(), tie.to_numpy()
        at = np.maximum(_place(key_ids, key_ties, id_, tie) - 1, 0)
        return pd_series(np.where((key_ids[at] == id_) & (key_ties[at] == tie), where[at], -1) if len(keys) else np.full(len(id_), -1))

    rows = rows.withColumn("also", also_in("id", "tie"))
    places = F.when(F.col("also") < 0, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("extra")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("extra")), F.struct(F.col("also").alias("part"), F.lit(True).alias("extra")))
    )
    dealt = rows.select("doc_id", "id", "tie", "text", F.explode(places).alias("place")).select("doc_id", "id", "tie", "text", "place.part", "place.extra")
    tasks = max(-(-size // task_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size > task_bytes else 1)
    ordered = dealt.repartition(tasks, "part").sortWithinPartitions("part", "extra", "id", "tie", "text").select("doc_id", "text", "part", "extra")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "extra")]
            pairs = []
            for row in zip(*columns, strict=True):
                if last is not None and last[2] == row[2] and not last[3]:
                    pairs.append((last[0], last[1], row[1]))
                last = row
            for a, b in strides([len(t) + len(f) for _, t, f in pairs]):
                yield _fingerprints(pairs[a:b], chunking)

    return map_iterators(ordered, run, SCHEMA)


def pd_series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values.astype(np.int64))


def _fingerprints(pairs: list[tuple[int | None, str, str]], chunking: Chunking) -> pa.RecordBatch:
    changed = [edited(text, following).encode("utf-8", "surrogatepass") for _, text, following in pairs]
    # a following text is mostly the next pair's own
    own = [text.encode("utf-8", "surrogatepass") for _, text, _ in pairs] + [pairs[-1][2].encode("utf-8", "surrogatepass")]
    sets = chunk_sets(own, chunking)
    others = chunk_sets(changed, chunking)
    rows = []
    for k, (doc_id, text, following) in enumerate(pairs):
        if k + 1 < len(pairs) and pairs[k + 1][1] is not following and pairs[k + 1][1] != following:
            after = chunk_sets([following.encode("utf-8", "surrogatepass")], chunking)[0]
        else:
            after = sets[k + 1]
        rows.append(
            (doc_id, len(text), hashlib.sha256(changed[k]).hexdigest(), as_string(sets[k]), as_string(others[k]), likeness(sets[k], others[k]), likeness(sets[k], after))
        )
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
