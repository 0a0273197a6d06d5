"""Sharding, line dedup, near-duplicates and decontamination against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelog.llm import decontaminate, line_dedup, sharding, simhash
from pagelog.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# -- sharding


def test_tiers():
    t = sharding.Tiers(target_bytes=1000, base_bytes=10, factor=4, least=3)
    assert [t.of(n) for n in (0, 9, 10, 39, 40, 160)] == [0, 0, 1, 1, 2, 3]
    s = lambda *sizes: [sharding.Shard(f"s{k}", n, 1) for k, n in enumerate(sizes)]
    assert t.plan(s(5, 5)) == [] and t.plan(s(600, 700, 800)) == []
    runs = t.plan(s(5, 6, 7, 300, 310, 320, 330))
    assert [[x.bytes for x in r] for r in runs] == [[5, 6, 7], [300, 310, 320]]


def test_store(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", sharding.Tiers(least=2))
    df = spark.createDataFrame([(k, None if k % 7 == 0 else "t" * k, "x") for k in range(50)] + [(1, "t", "x")] * 3, "doc_id long, text string, path string")
    with pytest.raises(ValueError):
        store.read()
    for k in range(3):
        store.append(df.where(F.col("doc_id") % 3 == k).repartition(2))
    before = store.manifest()[1]["shards"]
    assert store.compact() >= 1
    version, now = store.manifest()
    assert len(now["shards"]) < len(before)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(store.read()) == rows(df) == rows(store.read(version - 1))
    # a second writer that saw the same version has to try again
    with pytest.raises(sharding.Conflict):
        store._commit(version - 1, None, [], "late")
    with pytest.raises(sharding.Conflict):
        store.change(lambda now: ([], {"gone"}), None, "x")
    assert store.vacuum() == 0 and store.versions() == [version - 1, version]  # readers of the version before keep their files
    assert rows(store.read(version - 1)) == rows(df)
    assert store.vacuum(1) > 0 and store.versions() == [version]
    assert rows(store.read()) == rows(df)
    (tmp_path / "s" / "manifests" / f"{version + 1:020d}.lock").touch()  # a writer died between lock and rename
    with pytest.raises(sharding.Conflict):
        store.append(df)
    store.lock_seconds = 0
    assert store.append(df) == version + 2 and store.read().count() == 2 * df.count()  # that version is left out
    # the writer wasn't dead after all: its version came too late and doesn't count
    (tmp_path / "s" / "manifests" / f"{version + 1:020d}.json").write_text('{"schema": null, "note": "slow", "base": 1, "shards": []}')
    with pytest.raises(sharding.Conflict):
        store._settle(version + 1)
    store._settle(version + 2)
    assert store.read().count() == 2 * df.count()


def test_store_schemas(spark, tmp_path):
    """Columns may come and go; types may not change, and nothing of a refused arrival stays."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", sharding.Tiers(least=2))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "x" * 300_000, 5), (None, None, None)], "doc_id long, text string, file int"))
    store.append(spark.createDataFrame([(3,)], "doc_id long"))
    for wrong in ("doc_id string", "DOC_ID long"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], wrong))
    assert store.compact() == 1
    got = {(r["doc_id"], len(r["text"] or ""), r["file"]) for r in store.read().collect()}
    assert got == {(1, 1, None), (2, 300_000, 5), (None, 0, None), (3, 0, None)}
    assert len(list((tmp_path / "s" / "data").iterdir())) == 4  # three arrivals and their merge


def test_shard_table_of_any_columns(spark, tmp_path):
    rows = [(k, None if k % 3 else "", "t" * k, k % 2, "c") for k in range(40)] + [(1, "", "t", 1, "c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, file string, `count` int, `a.b` string")
    store = sharding.shard_table(df, f"file://{tmp_path}/t", tiers=sharding.Tiers(least=2))
    assert store.read().columns == df.columns and sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("incoming")]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], DOCS)
    store = sharding.shard_table(df, f"file://{tmp_path}/e")
    assert store.read().count() == 0 and store.read().schema == df.schema


# -- line dedup


def plain_lines(rows, sites, least):
    spread, first = {}, {}
    clean = lambda x: x.replace("\t", " ").replace("\r", " ").strip(" ")
    for i, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            if len(clean(x)) >= least:
                spread.setdefault(clean(x), set()).add(s)
                first[clean(x)] = min(first.get(clean(x), 2**63), 2**63 - 1 if i is None else i)
    bad = {x for x, s in spread.items() if len(s) >= sites}
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        kept, seen = [], set()
        for x in t.split("\n"):
            c = clean(x)
            if c in bad and not (first[c] == (2**63 - 1 if i is None else i) and c not in seen):
                continue
            seen.add(c)
            kept.append(x)
        out.append((i, "\n".join(kept), len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [4, 12])
def test_line_dedup(spark, bits):
    """With four bits the sketches are poor, and the exact counts have to decide."""
    rnd = random.Random(3)
    lines = [f"this is a shared line number {k}" for k in range(30)]
    rows = [(k, "\n".join(rnd.choice([*lines, f"own line of {k} that nobody else has", "short", "", "  this is a shared line number 3\t"]) for _ in range(rnd.randint(1, 12))), f"s{k % 13}") for k in range(80)]
    rows += [(5, "this is a shared line number 1\nthis is a shared line number 1", "s1"), (None, "this is a shared line number 2", None), (101, None, "s2"), (102, "", "s3"), (103, "x" * 200_000, "s4")]
    rows += [(2**63 - 1, "this is a shared line number 2\nthis is a shared line number 4\nthis is a shared line number 2", "s5"), (0, "x", "s1"), (0, "a line of zero\nthis is a shared line number 5", "s1")]
    names = "gone string, once int, __id long, `row` string, own int, h string, `a.b` int"
    df = spark.createDataFrame([(i, t, "en", s, 5, 9, "g", 1, 2, "r", 3, "h", 4) for i, t, s in rows], f"{DOCS}, n_removed long, {names}")
    got = line_dedup.dedup_lines(df, sites=8, least_chars=20, sketch_bits=bits)
    assert sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()), key=str) == plain_lines(rows, 8, 20)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "once", "__id", "row", "own", "h", "a.b", "n_removed"]
    assert {tuple(r[5:12]) for r in got.collect()} == {("g", 1, 2, "r", 3, "h", 4)}
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect())
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_many_lines(spark):
    """Work grows with a document's lines, not their square."""
    import time

    n = 60_000
    lines = [f"this line number {k} stands everywhere" for k in range(n)]
    df = spark.createDataFrame([(k, "\n".join(lines + lines[:10]), "en", f"s{k}", 1) for k in range(9)], DOCS)
    began = time.time()
    got = {r["doc_id"]: (r["n_removed"], r["n_chars"]) for r in line_dedup.dedup_lines(df).select("doc_id", "n_removed", "n_chars").collect()}
    assert got == {0: (10, len("\n".join(lines)))} | {k: (n + 10, 0) for k in range(1, 9)}
    assert time.time() - began < 120


def test_line_dedup_is_native(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- near-duplicates


def plain_components(fps, distance):
    """Union-find over all pairs."""
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def plain_fingerprint(text):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rnd = random.Random(1)
    words = ["Über", "a", "B", "c d", "Word", "x"]
    for _ in range(200):
        t = "".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(rnd.randint(0, 600 if rnd.random() < 0.1 else 12)))
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_fingerprint_equals_spark_hash(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()["h"]
    assert simhash.fingerprint("One TWO\tthree") == r & (2**64 - 1)


def test_plans_hold_the_pigeonhole():
    rnd = np.random.default_rng(1)
    bits = rnd.integers(0, 2, (500, 64))
    bits[:, 10] = bits[:, 50]
    for n in (500, 10**6, 10**10):
        together = (bits.T @ bits) * (n // 500)
        parts = simhash.plan(together, n)
        assert sum(p.threshold + 1 for p in parts) == simhash.DISTANCE + 1
        assert len({b for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)
    groups = simhash.group_bits(bits.T @ bits, 500, 8)
    assert any(10 in g and 50 in g for g in groups)


@pytest.mark.parametrize("hot", [1 << 20, 3])
def test_links(spark, hot):
    """Chains and clusters; with a low limit everything crowded goes by midpoints."""
    rnd = random.Random(2)
    fps = [rnd.getrandbits(64) for _ in range(120)]
    for k in range(60):
        f = rnd.choice(fps)
        for b in rnd.sample(range(64), rnd.choice([1, 3, 4, 5])):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    got = {r["node"] & (2**64 - 1): r["component"] & (2**64 - 1) for r in components(simhash.links(df, hot_pairs=hot)).collect()}
    roots = plain_components(fps, 4)
    ours, theirs = {}, {}
    for k, f in enumerate(fps):
        ours.setdefault(got.get(f, f), set()).add(f)
        theirs.setdefault(roots[k], set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 3), (9, 7), (9, 3), (500, 501), (1, 1)] + [(1000, k) for k in range(1001, 1100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and got[9] == 3 and got[501] == 500 and got[1050] == 1000 and 1 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_near_duplicates(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(9001, None), (9000, ""), (None, ""), (9002, rows[0][1]), (9002, rows[0][1]), (None, "only null ids here " * 5)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    roots = plain_components(fps, 4)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = sorted((str(i), f"{f:016x}", str(least.get(r))) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expected
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    stay = {i for (i, _), r in zip(rows, roots, strict=True) if i == least.get(r)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i in stay)
    assert simhash.near_duplicates(df.where("false")).count() == 0


# -- decontamination


ITEM = "In the spring of that year Anna Miller sold 12 baskets of apples at the old market and then walked home with 30 dollars in her pocket while it rained"
FILL = " ".join(f"filler{k} words around it that say nothing" for k in range(20))


def test_decontamination(spark):
    docs = [
        (1, f"{FILL} {ITEM}. {FILL}"),
        (2, f"{FILL} {ITEM.replace('12', '45').replace('30', '99').replace('Anna Miller', 'Maria Lopez')} {FILL}"),
        (3, FILL),
        (4, None),
        (5, ""),
        (6, " ".join(ITEM.split()[:6]) + " " + FILL),
        (7, ITEM.upper() if False else ITEM.replace(" ", "\n")),
        (None, ITEM),
        (8, "x " * 100_000 + ITEM),
        (9, ITEM),
        (9, ITEM),
    ]
    bench = [(10, ITEM), (11, "two plus two"), (12, None), (13, ""), (10, ITEM)]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, h string")
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, size int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, b).collect()}
    assert {k for k, _ in got} == {1, 2, 7, None, 8, 9} and {i for _, i in got} == {10}
    assert got[(1, 10)]["changed_slots"] == 0 and got[(2, 10)]["changed_slots"] == 4
    assert sorted(str(r["doc_id"]) for r in decontaminate.decontaminate(d, b).collect()) == ["3", "4", "5", "6"]
    assert decontaminate.decontaminate(d, b).columns == d.columns
    assert decontaminate.contaminated(d.where("false"), b).count() == 0 and decontaminate.contaminated(d, b.where("false")).count() == 0


def found_in(spark, items, docs, rules=decontaminate.Rules()):
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, b, rules).collect()}


def test_inconsistent_slots(spark):
    """The same shape with slots that say two things for one, or one thing for two, isn't the same question; but what
    agrees in the rest of an item counts."""
    item = "first we take 5 red balls out of it, then 5 blue balls into it, then 7 old cups out of it, then 7 tall cups"
    docs = {
        1: item.replace("5", "8").replace("7", "9"),
        2: "first we take 1 red balls out of it, then 2 blue balls into it, then 3 old cups out of it, then 4 tall cups",
        3: item.replace("7", "5"),  # both of its values are one here
        4: "so that the box holds many of them at last and nobody asks about the colours " + item.replace("5", "8", 1) + " at the end of the long day in the old town",
    }
    rules = decontaminate.Rules(window=10, cover=0.9, least_run=99)
    assert {k for k, _ in found_in(spark, {1: item}, docs, rules)} == {1}
    # a run of the same words in a row is found whatever is said elsewhere
    long = item + " and in the end nobody could tell how many of the things were left in the box"
    got = found_in(spark, {1: long}, {1: long.replace("5", "8", 1), 2: FILL})
    assert set(got) == {(1, 1)} and got[(1, 1)]["longest_run"] >= 13


def test_names_that_begin_sentences(spark):
    """A sentence's first word may be a name, and in German every noun has a capital."""
    item = "Anna went to the old market and bought apples for everyone. Tomorrow Anna pays 12 coins."
    german = "Der Bauer verkauft auf dem Markt am Morgen genau 40 Eier und kauft danach mit dem Geld noch 3 Brote"
    docs = {
        1: f"{FILL}. {item.replace('Anna', 'Maria')} {FILL}",
        2: f"{FILL} yesterday Maria went to the old market and bought apples for everyone. Tomorrow Maria pays 9 coins. {FILL}",
        3: f"{FILL}. {german.replace('40', '55').replace('3', '6')}. {FILL}",
        4: f"{FILL}. {item.lower()}",
        5: FILL,
    }
    got = found_in(spark, {1: item, 2: german}, docs)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 1)} and got[(1, 1)]["changed_slots"] >= 1


def test_words_put_in_or_left_out(spark):
    words = ITEM.split()
    docs = {
        1: " ".join([*words[:14], "really", *words[14:]]),
        2: " ".join([*words[:9], *words[10:20], "and", "so", "on", *words[20:]]),
        3: " ".join([FILL, *words[:12], FILL, *words[12:]]),  # parts far from each other are occurrences of their own
        4: " ".join(words[:7] + ["x"] + words[7:14] + ["x"] + words[14:21] + ["x"] + words[21:]),
    }
    got = found_in(spark, {1: ITEM}, docs)
    assert {1, 2} <= {k for k, _ in got} and (4, 1) not in got
    assert got[(1, 1)]["covered"] == len(words) == got[(2, 1)]["covered"] + 1 == got[(1, 1)]["size"]


def plain_templates(text):
    """Per word of a text its value and its placeholders by template, one word after the other."""
    out, begins = [], True
    for raw in text.split():
        kind, value = decontaminate.slot_of(raw)
        capital = kind == 0 and raw.lstrip(decontaminate._EDGES)[:1].isupper()
        if value:
            name = 2 if capital and not begins else kind
            out.append((value.casefold(), (name, 2 if capital else kind, kind)))
        begins = raw.rstrip("\"')]}»”’")[-1:] in {".", "!", "?", ":"}
    return out


def plain_contaminated(doc, item, rules):
    d, i = plain_templates(doc), plain_templates(item)
    w = min(rules.window, len(i))
    met = []
    for x in range(len(d) - w + 1):
        for y in range(len(i) - w + 1) if w else ():
            a, b = d[x : x + w], i[y : y + w]
            if [v for v, _ in a] == [v for v, _ in b]:
                slots = [v for v, k in b if k[0]]
                met.append((x - y, (y, slots, slots)))
            for s in range(3):
                for t in range(3):
                    mine = [k[s] or v for v, k in a]
                    n = sum(k[s] > 0 for _, k in a)
                    if n and w - n >= min(rules.literals, w) and mine == [k[t] or v for v, k in b]:
                        met.append((x - y, (y, [v for v, k in b if k[t]], [v for v, k in a if k[s]])))
    for half in (0, 1):
        stretches = {}
        for shift, m in met:
            stretches.setdefault((shift + (1 << 24) + half * rules.slack) // (2 * rules.slack), []).append(m)
        for some in stretches.values():
            unique = [m for k, m in enumerate(some) if m not in some[:k]]
            covered, run, _ = decontaminate.occurrence(unique, len(i), rules.window)
            if covered >= rules.cover * len(i) or run >= rules.least_run:
                return True
    return False


def test_against_plain_windows(spark):
    """Random documents and items, and the recall of items asked again with other numbers and names."""
    rnd = random.Random(8)
    names, units = ["Anna", "Maria", "Tom", "Berlin", "Lee"], ["kg", "miles", "dollars"]
    plain = "the a of old house went market bought and then with some apples home while it rained many people saw him there what how".split()

    def sentence(n):
        out = []
        for _ in range(n):
            r = rnd.random()
            out.append(rnd.choice(names) if r < 0.08 else str(rnd.randrange(2, 90)) if r < 0.16 else rnd.choice(units) if r < 0.2 else rnd.choice(plain))
        return " ".join(out).capitalize() + rnd.choice([".", "?", "!"])

    items = {k: " ".join(sentence(rnd.randint(7, 18)) for _ in range(rnd.randint(1, 3))) for k in range(40)}
    docs, planted = {}, set()
    for k in range(120):
        body = [sentence(rnd.randint(5, 20)) for _ in range(rnd.randint(1, 6))]
        if k < 80:
            item = k % 40
            to = dict(zip(names, rnd.sample(["Clara", "Peter", "Zoe", "Madrid", "Kim"], 5), strict=True))
            values = {str(v): str(n) for v, n in zip(range(2, 90), rnd.sample(range(100, 900), 88), strict=True)}
            again = " ".join(to.get(x.strip(".?!"), values.get(x.strip(".?!"), x)) if x.strip(".?!") in to or x.strip(".?!") in values else x for x in items[item].split())
            body.insert(rnd.randrange(len(body) + 1), again if again[-1] in ".?!" else again + ".")
            planted.add((k, item))
        docs[k] = " ".join(body)
    got = set(found_in(spark, items, docs))
    rules = decontaminate.Rules()
    assert got == {(d, i) for d, doc in docs.items() for i, item in items.items() if plain_contaminated(doc, item, rules)}
    recall = len(got & planted) / len(planted)
    print(f"recall of re-parameterised items {recall:.2f}, others found {len(got - planted)}")
    assert recall >= 0.9 and len(got - planted) <= 2


def test_short_items(spark):
    """Items of fewer words than a window are found inside longer documents."""
    short = {1: "What is the capital city of France?", 2: "why do cats purr", 3: "two plus two"}
    docs = [(k, f"{FILL}. {t} {FILL}") for k, t in short.items()] + [(5, FILL), (6, "why do cats purr"), (7, "cats purr why do"), (8, "and two plus two make four")]
    b = spark.createDataFrame(list(short.items()), "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (6, 2), (8, 3)}


def test_verbatim_items(spark):
    """Items rich in slots, in capitals, and copies in another case."""
    items = {
        1: "Tom Lee paid 3 dollars, Ann Fox paid 5 dollars, Bob Ray paid 12 dollars. How many dollars did Tom, Ann and Bob pay in 2 weeks?",
        2: "Compute the sum: 12 + 45 + 7 + 3 + 9 + 11 + 80 + 44 equals 211.",
        3: "NAME THE LARGEST RIVER THAT CROSSES THE OLD CITY WALL BEFORE IT MEETS THE SEA",
        4: ITEM,
    }
    docs = [(k, f"{FILL} {t} {FILL}") for k, t in items.items()] + [(13, items[3].lower()), (14, f"{FILL} {ITEM.upper()}"), (24, ITEM.lower()), (30, FILL)]
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (13, 3), (14, 4), (24, 4)}
    assert all(r["covered"] == r["size"] and r["changed_slots"] == 0 for r in got.values())


# -- near copies in the pipeline


def plain_groups(rows, distance):
    """The smallest doc_id of each row's group, by all pairs: five-word shingles at 0.8, and fingerprints within the distance."""
    sets = [set(zip(*[(t or "").lower().split()[j:] for j in range(5)], strict=False)) or {tuple((t or "").lower().split())} for _, t in rows]
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same) or distance is not None and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(rows))]


@pytest.mark.parametrize("distance", [None, 4])
def test_near_copies(spark, distance):
    """Copies with a few edited words, one large group of them among them, texts that share too little, and a
    family in which each shares half with all others."""
    from pagelog.llm import nearcopies

    rnd = random.Random(5)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows, k = [], 0
    for group in range(30):
        base = text(200)
        for j in range(60 if group == 0 else 3):
            words = list(base)
            for at in rnd.sample(range(200), rnd.randint(1, 3) if j else 0):
                words[at] = f"edit{rnd.randrange(10**6)}"
            rows.append((k, " ".join(words)))
            k += 1
        rows.append((k, " ".join(base[:120] + text(80))))  # half of it is other text
        k += 1
    shared = text(130)
    for _ in range(40):
        rows.append((k, " ".join(shared + text(70))))
        k += 1
    rows += [(k, rows[-1][1] + " one more"), (k + 1, ""), (k + 2, "two words"), (k + 3, "Two words"), (k + 3, "two words"), (None, "nobody's own"), (k + 4, None), (k + 5, "w " * 100_000)]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, node string, size int, fp int")
    expected = plain_groups(rows, distance)
    got = nearcopies.near_copies(df, distance=distance).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(i), str(c)) for (i, _), c in zip(rows, expected, strict=True))
    kept = nearcopies.drop_near_copies(df, distance=distance)
    stay = {i for (i, _), c in zip(rows, expected, strict=True) if i == c}
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i in stay)
    assert nearcopies.near_copies(df.where("false"), distance=distance).count() == 0


def test_repeated_rows_are_one_document(spark):
    from pagelog.llm import nearcopies

    df = spark.createDataFrame([(1, "the same text here"), (1, "the same text here"), (2, "the same text here")], "doc_id long, text string")
    assert [r["doc_id"] for r in nearcopies.drop_near_copies(df).collect()] == [1, 1]
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()] == [1, 1]
