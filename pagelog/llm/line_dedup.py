"""Line dedup across sites, in DataFrame functions only.

For each line's hash, HyperLogLog sketches of the sites it stands on merge by aggregation. Estimates far
from the threshold decide; lines near it get an exact distinct count. A line on enough sites is
boilerplate: it stays once, where it first stands, and goes everywhere else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelog.llm.common import Scratch, own_columns

SITES, LEAST_CHARS, SKETCH_BITS = 8, 20, 12


def _clean(line: Column) -> Column:
    """What lines are compared by: outer white space doesn't count."""
    return F.trim(F.regexp_replace(line, r"[\t\r\f\x{0B}]", " "))


def _hash(line: Column) -> Column:
    """128 bits, as a pair: among very many lines 64 would meet by chance."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("second")).alias("b"))


def boilerplate_lines(docs: DataFrame, sites: int = SITES, least_chars: int = LEAST_CHARS, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(h, first_doc) for each line on at least so many distinct sources; first_doc is the smallest doc_id that has
    it, as a struct in which a null one comes last."""
    lines = _lines(docs, least_chars)
    sketched = Scratch(docs.sparkSession, "lines").save(
        lines.groupBy("h").agg(F.hll_sketch_agg("site", sketch_bits).alias("sketch"), F.min("id").alias("first_doc")).select(
            "h", "first_doc", F.hll_sketch_estimate("sketch").alias("spread")
        ).where(F.col("spread") >= _low(sites, sketch_bits)),
        "spread",
    )
    sure = sketched.where(F.col("spread") > _high(sites, sketch_bits)).select("h", "first_doc")
    near = sketched.where(F.col("spread") <= _high(sites, sketch_bits))
    # distinct (line, site) pairs first: they combine before the shuffle, however often a line stands on a site
    exact = lines.select("h", "site").join(near.select("h"), "h", "left_semi").groupBy("h", "site").agg(F.lit(1).alias("one"))
    held = exact.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h")
    return sure.unionByName(near.join(held, "h", "left_semi").select("h", "first_doc"))


def _margin(sites: int, sketch_bits: int) -> float:
    """Beyond five standard errors, and one site, an estimate is trusted."""
    return max(1.0, 5 * 1.04 / math.sqrt(2**sketch_bits) * sites)


def _low(sites: int, sketch_bits: int) -> int:
    return math.floor(sites - _margin(sites, sketch_bits))


def _high(sites: int, sketch_bits: int) -> int:
    return math.ceil(sites + _margin(sites, sketch_bits))


def _id() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h, site, id, of, at) for each line that is long enough: its hash, its document's id and text hash, and its
    place. A null source counts as a site of its own."""
    # the text is hashed before it is taken apart: once, not for each of its lines
    whole = docs.select(_id().alias("id"), _hash(F.col("text")).alias("of"), F.coalesce(F.col("source").cast("string"), F.lit("\x00null")).alias("site"), "text")
    each = whole.select("id", "of", "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return each.withColumn("line", _clean(F.col("line"))).where(F.length("line") >= least_chars).select(_hash(F.col("line")).alias("h"), "site", "id", "of", "at")


def dedup_lines(docs: DataFrame, sites: int = SITES, least_chars: int = LEAST_CHARS, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """docs with boilerplate lines taken out of text, n_chars set anew, and n_removed (long): how many lines went.

    docs needs doc_id, text and source; any other columns are kept, whatever their names, but for one named
    n_removed, which is replaced. A line of at least least_chars characters on at least so many sources is
    boilerplate. Its first occurrence stays: in the document with the smallest doc_id (a null id comes last), at
    its first place there; so nothing is lost whole, and rows that repeat a doc_id keep it each. A null text
    stays null with nothing removed; lines keep their order and their outer white space; documents stay, even
    emptied ones. Work is linear in a text's lines, and documents meet their lines by id and text, so rows
    without an id are spread as well.
    """
    slim = own_columns(docs, "doc_id", "text", "source")
    boilerplate = Scratch(docs.sparkSession, "lines").save(boilerplate_lines(slim, sites, least_chars, sketch_bits), "boilerplate")
    hits = _lines(slim, least_chars).join(boilerplate, "h")
    first = F.col("first_doc") == F.col("id")
    by_doc = hits.groupBy("id", "of").agg(
        F.collect_set(F.when(~first, F.col("at"))).alias("gone"), F.array_sort(F.collect_set(F.when(first, F.struct("h", "at")))).alias("own")
    )
    # of a line's places in its first document those behind another one go as well
    before = F.concat(F.array(F.lit(None)), F.slice("own", 1, F.greatest(F.size("own") - 1, F.lit(0))))
    again = F.filter(F.arrays_zip(F.col("own").alias("x"), before.alias("y")), lambda p: p["x"]["h"] == p["y"]["h"])
    places = by_doc.select("id", "of", F.concat("gone", F.transform(again, lambda p: p["x"]["at"])).alias("gone"))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "n_removed"]).alias("row"), _id().alias("id"), _hash(F.col("text")).alias("of"))
    joined = given.join(places, ["id", "of"], "left").select("row", F.split("row.text", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.size("gone") > 0, F.array_join(F.transform(kept, lambda k: F.get("lines", k)), "\n")).otherwise(F.col("row.text"))
    cut = joined.select("row", text.alias("text"), F.size("gone").cast("long").alias("n_removed"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("text"))
        elif c == "n_chars":
            out.append(F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
        elif c != "n_removed":
            out.append(F.col("row").getField(c).alias(c))
    return cut.select(*out, "n_removed")


#: The same in DuckDB's SQL, with exact counts throughout.
LINE_DEDUP_SQL = f"""
WITH lines AS (
    SELECT doc_id, source, u.pos AS pos, u.line AS line, trim(regexp_replace(u.line, '[\\t\\r\\f\\x0B]', ' ', 'g'), ' ') AS key
    FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
), spread AS (
    SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= {LEAST_CHARS}
    GROUP BY key HAVING count(DISTINCT coalesce(source, chr(1) || 'null')) >= {SITES}
), marked AS (
    SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND NOT (s.first_doc = l.doc_id AND l.pos = min(l.pos) OVER (PARTITION BY l.doc_id, l.key)) AS gone
    FROM lines l LEFT JOIN spread s ON s.key = l.key
), texts AS (
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, t.text, d.lang, d.source, CAST(length(t.text) AS BIGINT) AS n_chars, CAST(t.n_removed AS BIGINT) AS n_removed
FROM documents d JOIN texts t USING (doc_id)
"""
