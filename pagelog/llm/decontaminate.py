"""Benchmark decontamination by templates.

Words are canonicalised: numbers (in digits or words), names and units become typed placeholders, the rest
is lower-cased without outer punctuation. Windows of such words are hashed; documents and benchmark items
that share windows are joined on the hash. A capital that begins a sentence may or may not be a name, and in
some languages every noun has one, so a window is hashed by up to three templates: with the capitals inside
of sentences as names, with those at their beginning as well, and with numbers and units only. Windows of
the case-folded words themselves stand beside these, so verbatim copies are found whatever their number of
slots or their case. Items shorter than a window are found as a whole.

The windows that a document shares with an item at about the same shift (so a word may be put in or left out)
are one occurrence. Its slots must be consistent: every value of the item stands for one value of the
document and the other way round, by majority; windows that say otherwise don't count. So a question asked
again with other numbers or names is found, and prose that merely has the same shape isn't.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm.common import Scratch, bit_map, map_iterators, maybe_in, own_columns, texts_of
from pagelog.llm.words import WordTable, strides

#: Numbers and units as words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice thrice".split()
)
UNIT_WORDS = frozenset(
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes pound pounds lb lbs oz ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur percent % $ € £ °c °f degrees mph kmh km/h watt watts kw volt volts meter meters metre metres".split()
)
NUMBER, NAME, UNIT = 1, 2, 3
#: Characters of text whose words are held at once.
STRIDE_CHARS = 500_000
_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:%|st|nd|rd|th)?")
_EDGES = "\"'`.,;:!?()[]{}<>«»“”‘’„…*_|#~–—-$&%"


@dataclass(frozen=True)
class Rules:
    """window: words in a window; of these at least literals must not be placeholders. An item is found in a
    document if consistent windows cover at least cover of its words, or least_run words in a row. slack: words
    that an occurrence may have more or fewer than the item at least; up to twice as many may be found."""

    window: int = 8
    literals: int = 5
    cover: float = 0.5
    least_run: int = 13
    slack: int = 8


def slot_of(word: str) -> tuple[int, str]:
    """(type, value) of a raw word; type 0: a literal. Names aren't told here: a capital counts only inside a
    sentence, see Canonical."""
    core = word if word.isalpha() else word.strip(_EDGES)
    low = core.lower()
    if not core:
        return (UNIT, word) if word in UNIT_WORDS else (0, "")
    if low in NUMBER_WORDS or not core.isalpha() and _NUMBER.fullmatch(core):
        return NUMBER, low
    if low in UNIT_WORDS:
        return UNIT, low
    return 0, low


_DESCRIBED = np.dtype([("value", np.uint64), ("kind", np.int8), ("capital", np.bool_), ("ends", np.bool_)])


_ENDS = frozenset(".!?:")


def _describe(words: list[str]) -> np.ndarray:
    """In numbers: the value's hash, the type (-1: vanishes), whether it begins with a capital and whether it ends a sentence."""
    digest, values, kinds, capitals, ends = xxhash.xxh64_intdigest, [], [], [], []
    for word in words:
        kind, value = slot_of(word)
        values.append(digest(value.casefold().encode("utf-8", "surrogatepass"), 7))
        kinds.append(kind if value else -1)
        plain = word.isalpha()
        capitals.append(kind == 0 and (word if plain else word.lstrip(_EDGES))[:1].isupper())
        ends.append(not plain and word.rstrip("\"')]}»”’")[-1:] in _ENDS)
    out = np.empty(len(words), dtype=_DESCRIBED)
    out["value"], out["kind"], out["capital"], out["ends"] = np.array(values, dtype=np.uint64), kinds, capitals, ends
    return out


class Words:
    """Arrays with an entry for each word of some texts: its text's number, its type (0: a literal), a code of its value
    and whether it is a literal with a capital at the beginning of a sentence."""

    def __init__(self, owner: np.ndarray, kind: np.ndarray, value: np.ndarray, initial: np.ndarray):
        self.owner, self.kind, self.value, self.initial = owner, kind, value, initial

    def slots(self) -> list[np.ndarray]:
        """By template, the type of each word's placeholder, or 0."""
        return [self.kind, np.where(self.initial, np.int8(NAME), self.kind), np.where(self.kind == NAME, np.int8(0), self.kind)]


class Canonical:
    """Turns texts into words. Those without letters or digits vanish."""

    def __init__(self):
        self._words = WordTable(_describe, keep=150_000)

    def __call__(self, texts: list[str]) -> Words:
        words = [t.split() for t in texts]
        ids = self._words.ids(words)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        if not len(ids):
            return Words(owner, np.empty(0, np.int8), np.empty(0, np.uint64), np.empty(0, bool))
        rows = self._words.table[ids]
        kind, value = rows["kind"].copy(), rows["value"]
        begins = np.ones(len(ids), dtype=bool)  # of a sentence
        begins[1:] = rows["ends"][:-1] | (owner[1:] != owner[:-1])
        kind[rows["capital"] & ~begins] = NAME
        real = kind >= 0
        return Words(owner[real], kind[real], value[real], (rows["capital"] & begins)[real])


_EXACT = np.uint64(0x5851F42D4C957F2D)


def _hashes(code: np.ndarray, w: int) -> np.ndarray:
    """A hash of each window of w words."""
    n = len(code) - w + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(w):
        h = (h ^ code[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h ^ np.uint64(w)


def windows(words: Words, rules: Rules, short: list[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray | None]]:
    """(places in the arrays, hashes, words, slot types) of windows, none over two texts: exact ones of the words
    themselves (without types), and by each template those with a slot and enough literals. short: further
    lengths, below a window's; None: a text of fewer words than a window is one window."""
    owner, value = words.owner, words.value
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(first, len(owner)))
    whole = short is None
    templates = []
    for k, slot in enumerate(words.slots()):
        changed = slot > 0 if not k else slot != words.kind
        templates.append((slot, np.where(slot > 0, slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), value), _sums(slot > 0), _sums(changed)))
    for w in [rules.window, *(np.unique(sizes[sizes < rules.window]).tolist() if whole else short)]:
        if len(owner) < w:
            continue
        inside = owner[: len(owner) - w + 1] == owner[w - 1 :]
        if whole and w < rules.window:
            only = np.zeros(len(owner), dtype=bool)
            only[first[sizes == w]] = True
            inside &= only[: len(inside)]
        at = np.flatnonzero(inside)
        yield at, (_hashes(value, w) ^ _EXACT)[at], w, None
        for slot, code, slotted, changed in templates:
            n = slotted[w:] - slotted[:-w]
            # the other templates only where they differ from the first
            good = np.flatnonzero(inside & (n > 0) & (w - n >= min(rules.literals, w)) & (changed[w:] - changed[:-w] > 0))
            if len(good):
                yield good, _hashes(code, w)[good], w, slot


def _sums(mark: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mark)])


_WINDOW = "owner long, at int, h long, slots array<long>, exact boolean"


def _explode(df: DataFrame, rules: Rules, known: Broadcast | None, short: list[int] | None) -> DataFrame:
    """Rows (owner, at, h, slots, exact) of df(owner, text). known: a bit map of the hashes that are wanted. slots
    are the windows' slot values, in order; of exact windows those by the first template. Without short, size
    adds the number of the text's words."""
    size = short is None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for batch in batches:
            names, texts = batch.column("owner"), texts_of(batch)
            for a, b in strides([len(t) for t in texts], STRIDE_CHARS):
                words = canonical(texts[a:b])
                first = np.searchsorted(words.owner, np.arange(b - a + 1))
                for at, h, w, slot in windows(words, rules, short):
                    if known is not None:
                        wanted = maybe_in(known.value, h)
                        at, h = at[wanted], h[wanted]
                    if len(at):
                        yield _batch(words, names.slice(a, b - a), first, at, h, w, slot)

    def _batch(words: Words, names: pa.Array, first: np.ndarray, at: np.ndarray, h: np.ndarray, w: int, slot: np.ndarray | None) -> pa.RecordBatch:
        mark = (words.kind if slot is None else slot) > 0
        upto = _sums(mark)
        counts = upto[at + w] - upto[at]
        ends = np.cumsum(counts)
        places = np.flatnonzero(mark)[np.repeat(upto[at] - (ends - counts), counts) + np.arange(ends[-1])]
        k = words.owner[at]
        columns = [
            names.take(pa.array(k)), pa.array((at - first[k]).astype(np.int32)), pa.array(h.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(words.value[places].astype(np.int64))), pa.array(np.full(len(at), slot is None)),
        ]
        if size:
            columns.append(pa.array((first[k + 1] - first[k]).astype(np.int32)))
        return pa.RecordBatch.from_arrays(columns, names=["owner", "at", "h", "slots", "exact", "size"][: len(columns)])

    return map_iterators(df, run, _WINDOW + (", size int" if size else ""))


def occurrence(met: Iterable[tuple[int, list[int], list[int]]], size: int, window: int) -> tuple[int, int, int]:
    """(words covered, longest run, changed slot values) of an item of size words by the windows met, each with its
    place in the item and the slot values of both sides.

    Pairs of values are accepted by how many windows say so, each value once on either side; a window with
    another pair doesn't count."""
    met = list(met)
    counts = Counter(pair for _, ours, theirs in met for pair in set(zip(ours, theirs, strict=True)))
    there, back = {}, {}
    for (i, d), _ in sorted(counts.items(), key=lambda c: (-c[1], c[0][0] != c[0][1], c[0])):
        if i not in there and d not in back:
            there[i], back[d] = d, i
    mark = np.zeros(size + 1, dtype=np.int64)
    used = set()
    w = min(window, size)
    for at, ours, theirs in met:
        if all(there.get(i) == d for i, d in zip(ours, theirs, strict=True)):
            mark[at] += 1
            mark[at + w] -= 1
            used.update(ours)
    inside = np.cumsum(mark[:size]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return int(inside.sum()), int((edges[1::2] - edges[::2]).max(initial=0)), sum(there[i] != i for i in used)


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, item_id, covered, longest_run, size, changed_slots): documents with the benchmark items found
    in them, how many of the item's words consistent windows cover, the longest run of them, the item's
    words, and how many of its slot values are other ones in the document.

    docs has doc_id and text, benchmark item_id and text; further columns are ignored. Null or empty texts
    have no windows; a null doc_id or item_id is kept as such; repeated rows count once. An item of fewer
    words than a window is found where all of them stand in a row, once if equally good places are many.
    Whole texts are windowed; only windows in a bit map of fixed size leave their task, and they are joined by
    hash, where adaptive execution splits a passage that very many documents share. The result has a row for
    each document and item that meet, so it grows with the documents that hold the items.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.save(_explode(own_columns(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("owner"), "text"), rules, None, None), "items")
    short = sorted(r["size"] for r in items.where(F.col("size") < rules.window).select("size").distinct().collect())
    known = docs.sparkSession.sparkContext.broadcast(bit_map(items, "h"))
    ours = _explode(own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("owner"), "text"), rules, known, short)
    item_side = items.select(F.col("owner").alias("item_id"), F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots"), "size", F.col("exact").alias("item_exact")).distinct()
    met = ours.select(F.col("owner").alias("doc_id"), "at", "h", "slots", "exact").join(item_side, "h").where("exact = item_exact")
    met = met.where(F.col("exact") | (F.size("slots") == F.size("item_slots")))
    # the words of exact windows are the same, whatever their case makes of them
    met = met.withColumn("slots", F.when(F.col("exact"), F.col("item_slots")).otherwise(F.col("slots")))
    # two rows of stretches of shifts, half a stretch apart: shifts that differ by slack at most have one in common
    shift = F.col("at") - F.col("item_at") + F.lit(1 << 24)
    stretches = F.array(*[F.floor((shift + k * rules.slack) / (2 * rules.slack)).cast("long") * 2 + k for k in (0, 1)])
    met = met.withColumn("stretch", F.explode(stretches))
    found = met.groupBy("doc_id", "item_id", "size", "stretch").agg(F.collect_set(F.struct("item_at", "item_slots", "slots")).alias("met"))
    window = rules.window

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measured = []
            for met, size in zip(batch.column("met"), batch.column("size").to_pylist(), strict=True):  # one occurrence's windows at a time
                measured.append(occurrence([(m["item_at"], m["item_slots"], m["slots"]) for m in met.as_py()], size, window))
            columns = [pa.array(c, pa.int32()) for c in zip(*measured, strict=True)] if measured else [pa.array([], pa.int32())] * 3
            kept = [batch.column(c) for c in ("doc_id", "item_id", "size")]
            yield pa.RecordBatch.from_arrays([*kept[:2], *columns[:2], kept[2], columns[2]], names=["doc_id", "item_id", "covered", "longest_run", "size", "changed_slots"])

    measured = map_iterators(found.select("doc_id", "item_id", "size", "met"), run, "doc_id long, item_id long, covered int, longest_run int, size int, changed_slots int")
    best = F.struct("covered", "longest_run", -F.col("changed_slots"))
    return (
        measured.where((F.col("covered") >= rules.cover * F.col("size")) | (F.col("longest_run") >= rules.least_run))
        .groupBy("doc_id", "item_id", "size")
        .agg(F.max(best).alias("b"))
        .select("doc_id", "item_id", F.col("b.covered").alias("covered"), F.col("b.longest_run").alias("longest_run"), "size", (-F.col("b.col3")).alias("changed_slots"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, with all columns, in which no benchmark item is found. Rows with a null doc_id go if
    any such row holds an item: they can't be told apart."""
    found = contaminated(docs, benchmark, rules).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__found"]), "left_anti")
