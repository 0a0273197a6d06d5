"""Packing, toxicity and the pipeline."""

import os
import random
import zlib

import numpy as np
import pytest

from pagelog.llm import packing, toxicity, words
from pagelog.llm.queries import default_tokenizer
from pagelog.llm.tokens import ByteBpe

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_tokens(tokenizer):
    bpe = ByteBpe(default_tokenizer())
    rnd = random.Random(1)
    parts = ["the", " ", "  ", "\n", "é", "ü's", "don't", "123", "😀", "!?", "\t", "日本", " ", "a", "²"]
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b", " " * 1_200_000, "a" * 50_000, "\n" * 3000 + "x"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    for t in texts:
        assert bpe.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_other_tokenizer_files(tmp_path, tokenizer):
    """A file with other settings is left to the library; nothing is assumed of it."""
    import json

    with open(default_tokenizer()) as f:
        content = json.load(f)
    changes = {"prefix": {"pre_tokenizer": content["pre_tokenizer"] | {"add_prefix_space": True}}, "lower": {"normalizer": {"type": "Lowercase"}}, "merges": {"model": content["model"] | {"merges": content["model"]["merges"][:1000]}}}
    for name, change in changes.items():
        (tmp_path / name).write_text(json.dumps(content | change))
        bpe, own = ByteBpe(str(tmp_path / name)), type(tokenizer).from_file(str(tmp_path / name))
        assert bpe._fast is None
        for t in ("Some words of THE text", " x", "<|endoftext|>", "don't"):
            assert bpe.encode(t) == np.array(own.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert ByteBpe(default_tokenizer())._fast is not None


def test_best_fit_and_crossover():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2048, 300).tolist()
    a = packing.first_solution(sizes, 2048, rng, 0.0)
    b = packing.first_solution(sizes, 2048, rng, 0.3)
    c = packing.crossover(a, b, sizes, 2048, rng)
    for s in (a, b, c):
        assert sorted(i for x in s for i in x) == list(range(300)) and max(sum(sizes[i] for i in x) for x in s) <= 2048
    best, _, _ = packing.evolve(sizes, 2048, [a], 3, packing.Evolution())
    assert len(best) <= len(a)


def triplets(bins, length, rng):
    """Sizes of which three fill a bin exactly: best fit in decreasing order is far from that."""
    out = []
    for _ in range(bins):
        a = int(rng.integers(int(length * 0.38), int(length * 0.49)))
        b = int(rng.integers(int(length * 0.25), (length - a) // 2 + 1))
        out += [a, b, length - a - b]
    return [int(x) for x in rng.permutation(out)]


@pytest.mark.parametrize("bins", [20, 100, 1300])
def test_search_beats_best_fit(bins):
    rng = np.random.default_rng(bins)
    sizes = triplets(bins, 1000, rng)
    plain = len(packing.first_solution(sizes, 1000, rng, 0.0))
    best, made, began = packing.evolve(sizes, 1000, [], 1, packing.Evolution())
    again, _, _ = packing.evolve(sizes, 1000, [best], 2, packing.Evolution())
    assert made == packing.Evolution().offspring and bins <= len(again) <= len(best) < began <= plain
    assert plain - len(again) >= 0.4 * (plain - bins)  # of the bins too many, at least so many are saved
    assert sorted(i for b in again for i in b) == list(range(3 * bins)) and max(sum(sizes[i] for i in b) for b in again) <= 1000
    # children without the search's swaps still are whole
    none = packing.Evolution(swaps=0, offspring=3)
    assert sorted(i for b in packing.evolve(sizes, 1000, [], 1, none)[0] for i in b) == list(range(3 * bins))


def test_search_in_blocks(spark, tmp_path):
    """Crossovers and migration save bins in every block of hard sizes; the second round never makes more."""
    from pagelog.llm.common import Scratch

    rng = np.random.default_rng(5)
    sizes = triplets(150, 500, rng)
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length int")
    how = packing.Evolution(block_items=160)
    placed = packing.pack_items(items, 500, how, Scratch(spark, "test"), "a").cache()
    report = packing.search_report(placed).collect()
    assert len(report) > 1 and all(r["crossovers"] > 0 and r["bins"] < r["began"] for r in report)
    rows = packing.pack(items, 500, how).collect()
    assert len({r["sequence_id"] for r in rows}) <= sum(r["bins"] for r in report)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == len(sizes) and all(sum(n for _, n in p) <= 500 for p in places.values())


def check_packing(rows, docs, tokenizer, length):
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in docs:
        full = ids(tokenizer, t)
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(full[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(full) and all(r["length"] == length for r in parts[1:])
        assert len(parts) == 1 if len(full) <= length else len(parts) == -(-len(full) // length)
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // length)


def test_packing(spark, tokenizer):
    rnd = random.Random(2)
    docs = [(k, " ".join(rnd.choice(["word", "other", "thing", "über"]) for _ in range(rnd.randint(0, 120)))) for k in range(300)]
    docs += [(900, None), (901, ""), (902, "long " * 900), (903, "a " * 64)]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, length int")
    how = packing.Evolution(block_items=64)
    rows = packing.pack_documents(df, default_tokenizer(), 128, how).collect()
    used, least = check_packing(rows, docs, tokenizer, 128)
    assert used <= least + 6
    assert packing.pack_documents(df.where("false"), default_tokenizer()).count() == 0
    twice = spark.createDataFrame([(None, "same text")] * 3 + [(1, "same text")] * 2, "doc_id long, text string")
    assert packing.pack_documents(twice, default_tokenizer()).count() == 5


def test_word_tables():
    t = words.WordTable(lambda ws: np.array([len(w) for w in ws]), keep=3)
    for texts in (["a bb", "ccc a"], ["dddd"], ["eeeee a", ""]):
        split = [x.split() for x in texts]
        ids = t.ids(split)
        assert t.table[ids].tolist() == [len(w) for x in split for w in x]
    assert list(words.strides([5, 5, 100, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(words.strides([])) == []


def test_threshold():
    logits = np.array([3.0, 2.0, 0.0, -1.0])
    assert toxicity.best_threshold(logits, np.array([1, 1, 0, 0])) == 1.0
    # equal logits can't be parted, even if that would be best
    assert toxicity.best_threshold(np.zeros(4), np.array([1, 0, 0, 0])) == 1.0
    assert toxicity.best_threshold(np.array([1.0, 1.0, 0.0]), np.array([1, 0, 0])) == 0.5


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    common = {"en": "the of and to in is that it was for on are".split(), "de": "der die das und in von zu mit sich des ist im".split()}
    stems = {"en": ["vilest", "grub"], "de": ["schurk", "lump"]}
    rows = []
    for k in range(n):
        lang = rnd.choice(["en", "de"])
        text = [rnd.choice(common[lang]) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(3, 9))) for _ in range(rnd.randint(20, 80))]
        toxic = rnd.random() < 0.3
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                text[rnd.randrange(len(text))] = rnd.choice(stems[lang]) + "".join(rnd.choice("aeionrs") for _ in range(rnd.randint(0, 3)))
        rows.append((k, " ".join(text), lang, int(toxic)))
    return rows


def test_network_learns_stems():
    rows = toxic_rows(1500, 1)
    net = toxicity.train([r[1] for r in rows[:1000]], [r[3] for r in rows[:1000]])
    scores = toxicity.Scorer(net).scores([r[1] for r in rows[1000:]])
    right = np.mean((scores >= toxicity.CUT) == np.array([r[3] == 1 for r in rows[1000:]]))
    assert right > 0.95
    assert toxicity.Scorer(net).scores(["", "..."]).max() < toxicity.CUT
    long = rows[1000][1] + " word" * 100_000
    assert 0 <= toxicity.Scorer(net).scores([long])[0] <= 1
    assert toxicity.train(["a"], [1]) is None and toxicity.train([], []) is None


def test_forward_pass_by_plain_loops():
    """Embeddings, filters, pooling and the output layer against loops over single words and windows."""
    rows = toxic_rows(200, 3)
    net = toxicity.train([r[1] for r in rows], [r[3] for r in rows], toxicity.Settings(epochs=1, least_steps=5))
    texts = [r[1] for r in rows[:10]] + ["", "one", "one two", "x" * 150, rows[3][1] * 3]
    logits, languages = toxicity.Scorer(net, keep=50).logits(texts)
    f = net.settings.filters
    for text, logit, language in zip(texts, logits, languages, strict=True):
        vectors = []
        counts = [0] * len(toxicity.FUNCTION_WORDS)
        for w in toxicity.split_words(text):
            buckets, offsets = toxicity.word_grams([w], net.settings.buckets)
            assert offsets.tolist() == [0, len(buckets)]
            vectors.append(sum(net.table[b].astype(np.float64) for b in buckets) / len(buckets))
            for k, words_ in enumerate(toxicity.FUNCTION_WORDS.values()):
                counts[k] += w.decode(errors="replace") in words_.split()
        expected = net.shift
        for c, kernel in enumerate(net.kernels):
            w = len(kernel)
            for j in range(f):
                windows = [sum(float(vectors[a + b] @ kernel[b][:, j]) for b in range(w)) for a in range(len(vectors) - w + 1)]
                expected += max(max(windows, default=0.0) + float(net.bias[c * f + j]), 0.0) * float(net.out[c * f + j])
        assert abs(expected - logit) < 1e-3 * max(1, abs(expected)), text[:40]
        assert language == (counts.index(max(counts)) if max(counts) else len(counts))


def test_whole_words_are_read():
    """Long words come in pieces that keep every n-gram; signs beyond ASCII part words."""
    assert toxicity.split_words("Eins\u00a0zwei\u3001drei\u2026vier\u300cf\u00fcnf\u300d a-b") == ["eins".encode(), b"zwei", b"drei", b"vier", "f\u00fcnf".encode(), b"a", b"b"]
    rnd = random.Random(4)
    for n in (1, 4, 5, 63, 64, 65, 68, 69, 124, 125, 500):
        word = bytes(rnd.choice(b"abcdefghij") for _ in range(n))
        pieces = toxicity.split_words(word.decode())
        assert max(map(len, pieces)) <= 64 and (n > 64 or pieces == [word])
        assert all(any(word[k : k + 5] in p for p in pieces) for k in range(max(n - 4, 1)))
    rows = toxic_rows(1000, 1)
    scorer = toxicity.Scorer(toxicity.train([r[1] for r in rows], [r[3] for r in rows]))
    calm = "\u4e00" * 200
    a, b, c = scorer.logits([calm + "\u3002", calm + "\u3002vilest", "x" * 300 + "vilest" * 30])[0]
    assert b > a and c != scorer.logits(["x" * 300])[0][0]


def test_score_query(spark):
    rows = toxic_rows(600, 2)
    docs = spark.createDataFrame([(k, t, lang, "s", len(t), 0.5, True) for k, t, lang, _ in rows] + [(None, "the end", "en", "s", 1, 0.5, True), (9999, None, None, None, None, None, None), (9998, "", "en", "s", 0, 0.5, True)], DOCS + ", score double, held_out boolean")
    labels = spark.createDataFrame([(k, 1, y) for k, _, _, y in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == 603
    for k, _, _, _ in rows:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.7)
    held = [(got[k]["predicted"], y) for k, _, _, y in rows if got[k]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.85
    # held-out labels have no say
    flipped = spark.createDataFrame([(k, 1, 1 - y if got[k]["held_out"] else y) for k, _, _, y in rows], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-6 for k in again)
    none = toxicity.score_toxicity(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_overlong_training_text(spark):
    """A labelled text beyond the bound of characters doesn't keep out the others of its label."""
    rows = [(k, "x" * (1000 if k % 7 == 0 else 10), "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2) for k, *_ in rows], "doc_id long, quality int, toxic int")
    texts, _ = toxicity.training_rows(docs, labels, toxicity.Settings(most_chars=1600))
    assert len(texts) == sum(zlib.crc32(str(k).encode()) % 3 != 1 and k % 7 != 0 for k in range(60))


def test_all_labelled_rows_are_learnt(spark):
    """Beyond the bounds of one process tasks learn from all rows: a stem outside of its sample is known, thresholds are of all."""
    rows = toxic_rows(1600, 5)
    settings = toxicity.Settings(most_rows=80)
    first = {t for t in toxicity.training_rows(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"), settings)[0]}
    rare = [(k, t + " zwyrkiness zwyrkily zwyrked", g, 1) if t not in first and k % 4 == 0 else (k, t, g, y) for k, t, g, y in rows]
    docs = spark.createDataFrame([r[:2] for r in rare], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rare], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, settings).collect()}
    held = [(got[k]["predicted"], "zwyrked" in t) for k, t, _, y in rare if got[k]["held_out"] and (y == 0 or "zwyrked" in t)]
    assert len(got) == len(rows) and np.mean([p == 1 for p, z in held if z]) > 0.9 and np.mean([p == 0 for p, z in held if not z]) > 0.9
    # a label that only an overlong text has is not lost
    only = toxicity.learn(docs, labels.withColumn("toxic", (labels["doc_id"] == min(k for k, *_ in rows if not got[k]["held_out"])).cast("int")), toxicity.Settings(most_chars=10))
    assert only is not None


@pytest.mark.skipif(not os.path.isdir(SF1), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark, tokenizer):
    import corpus_pipeline
    from pagelog.llm import decontaminate
    from test_dedup import plain_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicates", "decontamination", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns, name
        before, after = now.count(), out.count()
        assert 0 < after <= before
        if name == "line dedup":
            assert after == before
        if name == "near-duplicates":
            given = [(r["doc_id"], r["text"]) for r in now.collect()]
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for (i, _), c in zip(given, plain_groups(given, 4), strict=True) if i == c)
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontaminate.contaminated(out, bench).count() == 0
        now = spark.createDataFrame(out.collect(), docs.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    used, least = check_packing(rows, [(r["doc_id"], r["text"]) for r in now.collect()], tokenizer, 2048)
    assert used <= least + 2
