"""A convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the mean of hashed embeddings of the word and its character n-grams, so inflected or
unseen forms of a known stem get close to it. Filters of several widths run over the words, the maximum
over the text is pooled, a logistic layer gives the logit. Thresholds are calibrated by the language that
function words suggest, on rows kept from training, and placed at a score of 0.7.

All labelled rows that aren't held out count. If they are few, one process learns from them; else a sample of
them only gives the weights to start from, and then all are learnt from in tasks: each goes on from the same
network, and their changes are averaged. The thresholds come from counts over all rows kept from that.
"""

from __future__ import annotations

import copy
import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelog.llm.common import Scratch, give_back, map_batches, map_iterators, own_columns, texts_of
from pagelog.llm.words import WordTable, strides

CUT = 0.7  # the score from which a text counts as toxic
STRIDE_CHARS = 500_000  # characters of text whose words are held at once
LEARN_CHARS = 2_000_000  # the same when tasks learn
CHUNK = 1024  # buckets of the table that travel in a row
LEAST = 12  # rows of each label from which a threshold is calibrated
BINS = 64  # logits from one whole number to the next are counted in so many bins

#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as by this be at from not have or an but they which",
    "de": "der die das und in von zu mit sich des ist im nicht ein eine als auch für auf dem den sie werden er",
    "fr": "le la les de des du et en un une est que qui dans par pour sur au avec ne pas plus ce il elle",
    "es": "el la los las de y en que un una es por con para del se al lo como más no su sus pero",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


@dataclass(frozen=True)
class Settings:
    """most_rows of each label and most_chars in all are what one process learns from at once: the whole if it isn't more, else where tasks start."""

    most_rows: int = 2000
    most_chars: int = 8_000_000
    buckets: int = 1 << 16
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 8
    least_steps: int = 120  # small samples are gone through more often
    batch: int = 48
    rate: float = 0.08
    kept_out: int = 4  # every so many rows calibrate
    seed: int = 11


# -- words


#: ASCII characters other than letters and digits part words.
_PART = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: So do white space and punctuation beyond ASCII.
_WIDE_PART = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isspace() or unicodedata.category(c)[0] in "PZ")
#: Bytes of a word at most; the pieces of a longer one share enough bytes that no n-gram is lost.
LONGEST, SHARED = 64, 4


def split_words(text: str) -> list[bytes]:
    """The lower-cased words; a long one, as unspaced scripts have them, comes in pieces that each count as a word."""
    text = text.lower()
    if not text.isascii():
        for c in _WIDE_PART.intersection(text):  # a text has few of them
            text = text.replace(c, " ")
    words = text.encode("utf-8", "surrogatepass").translate(_PART).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[k : k + LONGEST] for w in words for k in range(0, max(len(w) - SHARED, 1), LONGEST - SHARED)]


def word_grams(words: list[bytes], buckets: int, part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of 3 to 5 bytes of the framed words and of the words, offsets by word)."""
    if len(words) > part:
        done = [word_grams(words[k : k + part], buckets) for k in range(0, len(words), part)]
        sizes = np.cumsum([0] + [len(b) for b, _ in done])
        return np.concatenate([b for b, _ in done]), np.concatenate([[0]] + [o[1:] + n for (_, o), n in zip(done, sizes, strict=False)])
    raw = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(raw)), sizes)
    where, found = [], []
    h = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, 6):
        h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) ^ (data[n - 1 :] + np.uint64(1))
        if n >= 3 and len(h):
            inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
            where.append(owner[inside])
            found.append(h[inside])
    whole = np.zeros(len(raw), dtype=np.uint64)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        whole[has] = whole[has] * np.uint64(0x100000001B3) ^ (data[(ends - sizes)[has] + k] + np.uint64(977))
    where.append(np.arange(len(raw)))
    found.append(whole)
    at, hashes = np.concatenate(where), np.concatenate(found)
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(at, kind="stable")
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)[order], np.searchsorted(at[order], np.arange(len(raw) + 1))


_LANGUAGE_OF: dict[bytes, np.ndarray] = {}
for _k, _name in enumerate(FUNCTION_WORDS):
    for _w in FUNCTION_WORDS[_name].split():
        _LANGUAGE_OF.setdefault(_w.encode(), np.zeros(len(FUNCTION_WORDS), dtype=np.float32))[_k] += 1


def _language_marks(words: list[bytes]) -> np.ndarray:
    none = np.zeros(len(FUNCTION_WORDS), dtype=np.float32)
    return np.array([_LANGUAGE_OF.get(w, none) for w in words], dtype=np.float32).reshape(len(words), -1)


# -- the network


@dataclass
class Network:
    settings: Settings
    table: np.ndarray  # buckets x size
    kernels: list[np.ndarray]  # by width: width x size x filters
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: np.ndarray  # by language, in logits
    slope: float

    @classmethod
    def fresh(cls, settings: Settings) -> Network:
        rng = np.random.default_rng(settings.seed)
        normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        pooled = settings.filters * len(settings.widths)
        kernels = [normal(w, settings.size, settings.filters, by=1 / math.sqrt(w * settings.size)) for w in settings.widths]
        return cls(settings, normal(settings.buckets, settings.size, by=0.1), kernels, np.zeros(pooled, np.float32), np.abs(normal(pooled, by=0.3)), 0.0, np.zeros(len(LANGUAGES)), 1.0)

    def embed(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(offsets) - 1:
            return np.empty((0, self.settings.size), np.float32)
        sums = np.add.reduceat(self.table[buckets], offsets[:-1], axis=0)
        return sums / np.diff(offsets)[:, None].astype(np.float32)

    def pool(self, x: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(texts x pooled before the bias, the windows' responses by width); a text without a window of some width has 0 there.

        x: the words' embeddings, the texts one after the other; first, sizes: their places."""
        n, some = len(first), self.settings.filters
        pooled = np.zeros((n, some * len(self.kernels)), np.float32)
        responses = []
        for k, kernel in enumerate(self.kernels):
            w = len(kernel)
            m = len(x) - w + 1
            if m <= 0:
                responses.append(np.empty((0, some), np.float32))
                continue
            r = x[:m] @ kernel[0]
            for j in range(1, w):
                r += x[j : j + m] @ kernel[j]
            responses.append(r)
            has = np.flatnonzero(sizes >= w)
            if not len(has):
                continue
            # windows [first, first + size - w] of each text; those over two texts lie between and are left out
            cuts = np.empty(2 * len(has), dtype=np.int64)
            cuts[0::2], cuts[1::2] = first[has], first[has] + sizes[has] - w + 1
            last = cuts[-1] >= m
            tops = np.maximum.reduceat(r, cuts[:-1] if last else cuts, axis=0)[0::2]
            pooled[has, k * some : (k + 1) * some] = tops
        return pooled, responses

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift


def _places(words: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    return np.cumsum(sizes) - sizes, sizes


class Trainer:
    """Steps of Adagrad on a network: its state goes on from one call to the next."""

    def __init__(self, net: Network):
        self.net = net
        self.square = np.full(net.settings.buckets, 1e-9, np.float32)  # one rate for each bucket
        self.dense = [np.full(a.shape, 1e-8, np.float32) for a in (*net.kernels, net.bias, net.out)]
        self.square_shift = 1e-6

    def step(self, ids: list[np.ndarray], y: np.ndarray, weight: np.ndarray, buckets: np.ndarray, offsets: np.ndarray, rate: float) -> None:
        """One batch: the numbers of each text's words, whose n-grams' buckets are buckets[offsets[w]:offsets[w + 1]]."""
        net, settings = self.net, self.net.settings
        flat = np.concatenate(ids)
        own, at = np.unique(flat, return_inverse=True)
        counts = offsets[own + 1] - offsets[own]
        local = np.concatenate([[0], np.cumsum(counts)])
        mine = buckets[np.repeat(offsets[own] - local[:-1], counts) + np.arange(local[-1])]
        x = net.embed(mine, local)[at]
        first, sizes = _places(ids)
        pooled, responses = net.pool(x, first, sizes)
        active = pooled + net.bias
        logit = np.maximum(active, 0) @ net.out + net.shift
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        g = (p - y) * weight / len(ids)
        g_out = np.maximum(active, 0).T @ g
        g_pool = np.outer(g, net.out) * (active > 0)
        g_bias = g_pool.sum(axis=0)
        g_words = np.zeros_like(x)
        g_kernels = [np.zeros_like(kernel) for kernel in net.kernels]
        f = settings.filters
        for c, kernel in enumerate(net.kernels):
            w, r = len(kernel), responses[c]
            for d in np.flatnonzero(sizes >= w):
                grad = g_pool[d, c * f : (c + 1) * f]
                if not grad.any():
                    continue
                best = first[d] + r[first[d] : first[d] + sizes[d] - w + 1].argmax(axis=0)
                for j in range(w):
                    g_kernels[c][j] += (x[best + j] * grad[:, None]).T
                    np.add.at(g_words, best + j, kernel[j].T * grad[:, None])
        touched = np.flatnonzero(g_words.any(axis=1))
        if len(touched):
            word = own[at[touched]]
            counts = offsets[word + 1] - offsets[word]
            local = np.concatenate([[0], np.cumsum(counts)])
            where = buckets[np.repeat(offsets[word] - local[:-1], counts) + np.arange(local[-1])]
            grads = np.repeat(g_words[touched] / counts[:, None].astype(np.float32), counts, axis=0)
            unique, back = np.unique(where, return_inverse=True)
            total = np.zeros((len(unique), settings.size), np.float32)
            np.add.at(total, back, grads)
            self.square[unique] += (total * total).mean(axis=1)
            net.table[unique] -= rate * total / np.sqrt(self.square[unique])[:, None]
        for a, grad, s in zip((*net.kernels, net.bias, net.out), (*g_kernels, g_bias, g_out), self.dense, strict=True):
            s += grad * grad
            a -= 0.5 * rate * grad / np.sqrt(s)
        np.maximum(net.out, 0, out=net.out)  # evidence only adds up: a text says no less with words taken away
        self.square_shift += float(g.sum()) ** 2
        net.shift -= 0.5 * rate * float(g.sum()) / math.sqrt(self.square_shift)


def word_ids(texts: list[str], buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(the numbers of each text's words, buckets of their n-grams, offsets by word)."""
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in split_words(t)), dtype=np.int32) for t in texts]
    return ids, *word_grams(list(number), buckets)


def weights(y: np.ndarray, positive: float) -> np.ndarray:
    """Of rows by label, so that both labels weigh the same."""
    return np.where(y > 0, 0.5 / positive, 0.5 / (1 - positive)).astype(np.float32)


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Network | None:
    """The network for the texts, its thresholds calibrated on every kept_out-th; None without both labels."""
    trainer = fit(texts, labels, settings)
    return trainer and trainer.net


def fit(texts: list[str], labels: list[int], settings: Settings) -> Trainer | None:
    """The same with the state of learning, from which it can go on."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net = Network.fresh(settings)
    rng = np.random.default_rng(settings.seed)
    ids, buckets, offsets = word_ids(texts, settings.buckets)
    order = rng.permutation(len(texts))
    ranked = np.concatenate([np.flatnonzero(y[order] == c) for c in (1, 0)])  # both labels in both parts
    kept = order[ranked[:: settings.kept_out]] if len(texts) >= 4 * settings.kept_out else order
    learn = np.setdiff1d(order, kept) if len(kept) < len(order) else order
    if y[learn].min() == y[learn].max():
        learn = order
    weight = weights(y, float(y[learn].mean()))
    trainer = Trainer(net)
    epochs = max(settings.epochs, -(-settings.least_steps * settings.batch // max(len(learn), settings.batch)))
    for epoch in range(epochs):
        rate = settings.rate * (1 - epoch / epochs) + 0.005
        shuffled = rng.permutation(learn)
        for k in range(0, len(shuffled), settings.batch):
            some = shuffled[k : k + settings.batch]
            trainer.step([ids[i] for i in some], y[some], weight[some], buckets, offsets, rate)
    scorer = Scorer(net)
    logits, languages = scorer.logits([texts[i] for i in kept])
    calibrate(net, logits, y[kept], languages)
    return trainer


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is highest; of such places the middle of the widest gap between logits. If the logits part
    nothing from the rest, it lies above them all: rather nothing is called toxic than everything."""
    return threshold_of_bins(logits, logits, np.ones(len(logits), np.int64), y)


def threshold_of_bins(low: np.ndarray, high: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> float:
    """The same for bins of logits, each with its lowest and highest and its numbers of rows; only between bins they are parted."""
    order = np.argsort(-high, kind="stable")
    low, high, n, hit = low[order], high[order], np.cumsum(rows[order]), np.cumsum(toxic[order])
    f1 = 2 * hit / (n + hit[-1])
    gap = np.append(low[:-1] - high[1:], 1.0)
    f1[gap <= 0] = -1  # equal logits can't be parted
    if hit[-1] < n[-1]:
        f1[-1] = -1
        if f1.max() < 0:
            return float(high[0]) + 1.0
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax(gap[best])]
    return float(low[k] - gap[k] / 2)


def calibrate(net: Network, logits: np.ndarray, y: np.ndarray, languages: np.ndarray, least: int = LEAST) -> None:
    """Thresholds by language; those with few rows of either label take the one of all."""
    overall = best_threshold(logits, y)
    net.thresholds = np.full(len(LANGUAGES), overall)
    for k in range(len(LANGUAGES)):
        mine = languages == k
        if min(y[mine].sum(), (1 - y[mine]).sum()) >= least:
            net.thresholds[k] = best_threshold(logits[mine], y[mine])
    spread = float(np.std(logits)) or 1.0
    net.slope = 3.0 / spread


class Scorer:
    """Scores of whole texts; memory for half a megabyte of text at a time (or one longer text) and a bounded number of words."""

    def __init__(self, net: Network, keep: int = 350_000):
        self.net = net
        self._words = WordTable(self._describe, keep)

    def _describe(self, words: list[bytes]) -> np.ndarray:
        return np.hstack([self.net.embed(*word_grams(words, self.net.settings.buckets)), _language_marks(words)])

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, languages)."""
        size, logits, languages = self.net.settings.size, [], []
        for a, b in strides([len(t) for t in texts], STRIDE_CHARS):
            words = [split_words(t) for t in texts[a:b]]
            first, sizes = _places(words)
            ids = self._words.ids(words)
            rows = self._words.table[ids] if len(ids) else np.empty((0, size + len(FUNCTION_WORDS)), np.float32)
            pooled, _ = self.net.pool(np.ascontiguousarray(rows[:, :size]), first, sizes)
            logits.append(self.net.logits(pooled))
            counts = np.zeros((len(words), len(FUNCTION_WORDS)))
            has = np.flatnonzero(sizes)
            if len(has):
                counts[has] = np.add.reduceat(rows[:, size:], first[has], axis=0)
            languages.append(np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(FUNCTION_WORDS)))
        if not logits:
            return np.empty(0), np.empty(0, np.int64)
        return np.concatenate(logits).astype(np.float64), np.concatenate(languages)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Between 0 and 1; CUT exactly at the language's threshold."""
        logits, languages = self.logits(texts)
        z = (logits - self.net.thresholds[languages]) * self.net.slope + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# -- in Spark


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _wanted(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt, one row for each doc_id."""
    found = own_columns(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    return found.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def first_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[int], bool]:
    """(texts, labels, whether these are all): labelled texts for one process, by hash of doc_id, at most most_rows of
    each label and most_chars characters in all. Rows that are held out never count."""
    slim = own_columns(docs, "doc_id", "text")
    sized = slim.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    rows, whole = [], True
    for c in (1, 0):
        found = _wanted(labels).where(F.col("toxic") == c).join(sized, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.most_rows + 1).collect()
        whole &= len(found) <= settings.most_rows
        rows += found[: settings.most_rows]
    half, used, chosen = settings.most_chars // 2, {0: 0, 1: 0}, {}
    for r in rows:
        if used[r["toxic"]] + r["size"] <= half:  # a text too long for what is left doesn't keep out the next
            used[r["toxic"]] += r["size"]
            chosen[r["doc_id"]] = r["toxic"]
    whole &= len(chosen) == len(rows)
    if not chosen:
        return [], [], whole
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame([(int(k), int(v)) for k, v in chosen.items()], "doc_id long, toxic int"))  # 2 * most_rows at most
    found = slim.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy("doc_id").collect()
    return [r["text"] or "" for r in found], [r["toxic"] for r in found], whole


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[int]]:
    """The texts and labels that one process learns from at first; learn() goes on with all of them."""
    return first_rows(docs, labels, settings)[:2]


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network | None:
    """The network of all labelled rows that aren't held out; None if they don't have both labels."""
    texts, ys, whole = first_rows(docs, labels, settings)
    trainer = fit(texts, ys, settings)
    if whole:
        return trainer and trainer.net
    scratch = Scratch(docs.sparkSession, "toxicity")
    one = own_columns(docs, "doc_id", "text").where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("text").alias("text"))
    kept = F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(settings.kept_out)) == 0
    rows = scratch.save(one.join(_wanted(labels), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"), kept.alias("kept")), "rows", compression="zstd")
    counts = {(r["toxic"], r["kept"]): r["count"] for r in rows.groupBy("toxic", "kept").count().collect()}
    number = lambda c, k: counts.get((c, k), 0)
    if not all(number(c, True) + number(c, False) for c in (0, 1)):
        scratch.drop("rows")
        return None
    trainer = trainer or Trainer(Network.fresh(settings))
    apart = all(number(c, k) >= LEAST for c in (0, 1) for k in (True, False))  # else all rows do both
    toxic, calm = (number(c, False) + (0 if apart else number(c, True)) for c in (1, 0))
    net = learn_in_tasks(trainer, rows.where("NOT kept") if apart else rows, toxic / (toxic + calm))
    calibrate_in_tasks(net, rows.where("kept") if apart else rows)
    scratch.drop("rows")
    return net


def _dense(net: Network) -> np.ndarray:
    return np.concatenate([*(k.ravel() for k in net.kernels), net.bias, net.out, [net.shift]]).astype(np.float64)


def learn_in_tasks(trainer: Trainer, rows: DataFrame, positive: float) -> Network:
    """The network after a pass over rows(text, toxic). Each task goes on from the same state; a bucket's change is the
    mean over the tasks that changed it, any other weight's the mean over all tasks by their rows."""
    settings = trainer.net.settings
    sent = rows.sparkSession.sparkContext.broadcast(trainer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        own, n = copy.deepcopy(sent.value), 0
        rng = np.random.default_rng((settings.seed, task))
        for batch in batches:
            texts, y = texts_of(batch), np.array(batch.column("toxic").to_pylist(), dtype=np.float32)
            for a, b in strides([len(t) for t in texts], LEARN_CHARS):
                ids, buckets, offsets = word_ids(texts[a:b], settings.buckets)
                weight = weights(y[a:b], positive)
                order = rng.permutation(b - a)
                for k in range(0, b - a, settings.batch):
                    some = order[k : k + settings.batch]
                    own.step([ids[i] for i in some], y[a:b][some], weight[some], buckets, offsets, settings.rate / 2)
                n += b - a
        if n:
            change = own.net.table - sent.value.net.table
            parts = [(k // CHUNK, change[k : k + CHUNK]) for k in range(0, settings.buckets, CHUNK) if change[k : k + CHUNK].any()]
            parts.append((-1, _dense(own.net) - _dense(sent.value.net)))
            for chunk, c in parts:
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([c.tobytes()], pa.binary())], names=["chunk", "task", "n", "change"])

    def mean(given: pa.Table) -> pa.Table:
        given = given.sort_by("task")  # sums of floats in a fixed order
        chunk = given.column("chunk")[0].as_py()
        total, count = 0.0, 0.0
        for n, c in zip(given.column("n").to_pylist(), given.column("change").to_pylist(), strict=True):
            change = np.frombuffer(c, np.float64) if chunk < 0 else np.frombuffer(c, np.float32).reshape(-1, settings.size)
            total = total + change * (n if chunk < 0 else 1)
            count = count + (n if chunk < 0 else change.any(axis=1)[:, None])
        found = total / np.maximum(count, 1)
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "change": pa.array([found.astype(np.float64 if chunk < 0 else np.float32).tobytes()], pa.binary())})

    changes = map_iterators(rows.select("text", "toxic"), run, "chunk int, task int, n long, change binary")
    net = copy.deepcopy(trainer.net)
    for r in changes.groupBy("chunk").applyInArrow(mean, "chunk int, change binary").collect():  # one network
        if r["chunk"] >= 0:
            part = net.table[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK]
            part += np.frombuffer(r["change"], np.float32).reshape(part.shape)
            continue
        dense, at = _dense(net) + np.frombuffer(r["change"], np.float64), 0
        for a in (*net.kernels, net.bias, net.out):
            a[...] = dense[at : at + a.size].reshape(a.shape)
            at += a.size
        net.shift = float(dense[at])
    return net


def calibrate_in_tasks(net: Network, rows: DataFrame) -> None:
    """calibrate() on rows(text, toxic), by counts in bins of logits."""
    sent, held = rows.sparkSession.sparkContext.broadcast(net), []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Scorer(sent.value))
        logits, languages = held[0].logits(texts_of(batch))
        return pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(logits, pa.float64()), pa.array(languages, pa.int32())], names=["toxic", "logit", "language"])

    scored = map_batches(rows.select("toxic", "text"), run, "toxic int, logit double, language int", held)
    bins = scored.groupBy("language", F.floor(F.col("logit") * BINS).alias("bin")).agg(F.min("logit").alias("low"), F.max("logit").alias("high"), F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("logit").alias("sum"), F.sum(F.col("logit") * F.col("logit")).alias("squares"))
    found = sorted(bins.collect(), key=lambda r: (r["bin"], r["language"]))
    bin_, low, high, n, toxic, language = (np.array([r[c] for r in found]) for c in ("bin", "low", "high", "n", "toxic", "language"))
    starts = np.flatnonzero(np.append(True, bin_[1:] != bin_[:-1]))
    whole = threshold_of_bins(np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.add.reduceat(n, starts), np.add.reduceat(toxic, starts))
    net.thresholds = np.full(len(LANGUAGES), whole)
    for k in range(len(LANGUAGES)):
        mine = language == k
        if min(toxic[mine].sum(), (n - toxic)[mine].sum()) >= LEAST:
            net.thresholds[k] = threshold_of_bins(low[mine], high[mine], n[mine], toxic[mine])
    mean = sum(r["sum"] for r in found) / n.sum()
    net.slope = 3.0 / (math.sqrt(max(sum(r["squares"] for r in found) / n.sum() - mean * mean, 0.0)) or 1.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text).

    Only the text enters a score: a null one is empty and scores as a text without words; a null doc_id
    isn't held out and its label is never used; repeated labels count as toxic if one is; repeated rows
    score alike; further columns are ignored. Without labels of both kinds every score is 0. Scoring
    moves no rows; the network of fixed size travels with the tasks.
    """
    net = learn(docs, labels, settings)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    held: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        if sent.value is None:
            scores = np.zeros(len(texts))
        else:
            if not held:
                held.append(Scorer(sent.value))
            scores = held[0].scores(texts)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = map_batches(own_columns(docs, "doc_id", "text"), run, "doc_id long, score double", held)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, with all columns, that aren't predicted toxic. The text stays with its row: it is
    scored in a column, so nothing is joined."""
    net = learn(docs, labels, settings)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value) if sent.value is not None else None
        for part in parts:
            yield pd.Series(np.zeros(len(part)) if scorer is None else scorer.scores(["" if t is None else t for t in part]))
        del scorer
        give_back()

    score = F.pandas_udf(run, "double")
    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) < CUT)
