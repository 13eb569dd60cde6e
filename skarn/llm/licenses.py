"""License scans by canonical digest lookup, in DataFrame functions alone.

A text's canonical form is lower-cased, without copyright lines, with
equivalent spellings made one and with punctuation and white space reduced to
single spaces.  Its SHA-256 digest is joined by equality with the digests of
known licence texts and notices.  Three kinds of entire texts are looked up:
the whole document, each of its lines, and runs of its paragraphs (lines between
lines without letters and digits): a paragraph that opens a known text is
followed for as many paragraphs as that text has.  Of runs within one another
the longest counts; a run that is one line is counted as that line.

Every row is handled where it is read; texts without any of a few words, of
which each known text holds one, cannot match and are not canonicalised; only
documents with a match are shuffled, by doc_id.  The known digests are a fixed list and are broadcast.

Defined cases: null or empty texts, and texts that are empty once canonical,
match nothing; rows with the same doc_id (null ids too) are scanned apart and
counted together, once for each row's text; of several entire licences of one id
the last in the alphabet is named; columns besides id and text are not read.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import KNOWN

#: Spellings that count as equal, and what they become.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"),
    ("judgement", "judgment"), ("analyse", "analyze"), ("authorise", "authorize"), ("recognise", "recognize"),
    ("whilst", "while"), ("wilful", "willful"), ("fulfil ", "fulfill "), ("noncommercial", "non commercial"),
    ("sub-license", "sublicense"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"),
    ("https://", "http://"), ("merchantibility", "merchantability"),
)
#: Lines that state a copyright, after lower-casing: with a sign, a year or a place
#: for one.  Licence texts have other lines that begin with the word, where wrapped.
COPYRIGHT = r"(^|\n)[^a-z0-9\n©(]*(copyright[^\n]*(\(c\)|©|[12][0-9]{3}|\[yyyy\]|<year>)|copyright by |\(c\)[^\n]*[12][0-9]{3}|©|all rights reserved)[^\n]*"
#: What separates paragraphs, after lower-casing.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”„‘’‚«»‹›–—―…·•©®™\x{A0}]+"


def canonical(lowered: Column) -> Column:
    """Canonical form of a lower-cased text."""
    out = F.regexp_replace(lowered, COPYRIGHT, "\n")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def anchors() -> list[str]:
    """Words of which every known text holds one.  No spelling rule makes or
    changes them and canonicalising keeps words whole, so a text without any of
    them, once lower-cased, cannot have a known canonical form."""
    made = " ".join(x for pair in SPELLINGS for x in pair)
    lines = [[x for x in text.lower().split("\n") if not re.search(COPYRIGHT, x)] for _, text in KNOWN]
    words = [{w for x in own for w in re.findall("[a-z]{5,}", x) if w not in made and not any(a in w for a, _ in SPELLINGS)} for own in lines]
    chosen: list[str] = []
    left = words
    while left:
        best = max(sorted({w for own in left for w in own}), key=lambda w: sum(w in own for own in left))
        chosen.append(best)
        left = [own for own in left if best not in own]
    return chosen


def known(spark) -> DataFrame:
    """license_id and digest of each known text."""
    rows = spark.createDataFrame(KNOWN, "license_id string, known string")
    return rows.select("license_id", F.sha2(canonical(F.lower("known")), 256).alias("digest")).distinct()


def _paragraphs(lowered: Column) -> Column:
    """The paragraphs of a lower-cased text that are not empty once canonical,
    each as it is and canonical."""
    every = F.transform(F.split(lowered, BLANK), lambda p: F.struct(p.alias("raw"), canonical(p).alias("canonical")))
    return F.filter(every, lambda p: p["canonical"] != "")


def _heads(spark) -> Column:
    """Map from the digest of a first paragraph to the known texts it opens:
    number of paragraphs, digest and license_id of each."""
    own = spark.createDataFrame(KNOWN, "license_id string, known string").withColumn("ps", F.transform(_paragraphs(F.lower("known")), lambda p: p["canonical"]))
    heads: dict[str, dict] = {}
    for r in own.select("license_id", F.sha2(F.get("ps", F.lit(0)), 256).alias("head"), F.size("ps").alias("n"), F.sha2(F.array_join("ps", " "), 256).alias("digest")).collect():
        heads.setdefault(r.head, {})[r.n, r.digest, r.license_id] = None
    entry = lambda n, d, i: F.struct(F.lit(n).alias("n"), F.lit(d).alias("digest"), F.lit(i).alias("id"))
    return F.create_map(*[x for h, own in heads.items() for x in (F.lit(h), F.array(*[entry(*e) for e in own]))])


def _runs(texts: DataFrame) -> DataFrame:
    """doc_id and license_id of each run of paragraphs that is a known text,
    not the whole document and not one line."""
    heads = _heads(texts.sparkSession)
    ps = F.col("ps")

    def opened(p: Column, i: Column) -> Column:
        entries = F.filter(F.element_at(heads, F.sha2(p["canonical"], 256)), lambda k: k["digest"] == F.sha2(F.array_join(F.transform(F.slice(ps, i + 1, k["n"]), lambda q: q["canonical"]), " "), 256))
        return F.coalesce(F.transform(entries, lambda k: F.struct(i.alias("a"), (i + k["n"]).alias("b"), k["id"].alias("id"))), F.array().cast("array<struct<a:int,b:int,id:string>>"))

    def one_line(h: Column) -> Column:
        p = F.get(ps, h["a"])
        return (h["b"] - h["a"] == 1) & F.exists(F.split(p["raw"], "\n"), lambda x: canonical(x) == p["canonical"])

    runs = texts.withColumn("ps", _paragraphs(F.col("low"))).withColumn("hits", F.flatten(F.transform("ps", opened))).where(F.size("hits") > 0)
    every = F.col("hits")
    largest = F.filter(every, lambda h: ~F.exists(every, lambda g: (g["a"] <= h["a"]) & (g["b"] >= h["b"]) & (g["b"] - g["a"] > h["b"] - h["a"])))
    runs = runs.withColumn("runs", F.filter(largest, lambda h: (h["b"] - h["a"] < F.size(ps)) & ~one_line(h)))
    return runs.select("doc_id", F.explode("runs.id").alias("license_id"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, whole_license (of the entire text, or null), n_notices (lines and
    runs of paragraphs that are a known text) and licenses (sorted, distinct,
    comma-separated)."""
    table = F.broadcast(known(docs.sparkSession))  # a fixed list
    hold = lambda c: reduce(operator.or_, [F.contains(F.col(c), F.lit(w)) for w in anchors()])
    texts = docs.select("doc_id", F.lower("text").alias("low")).where(hold("low"))
    lines = texts.select("doc_id", F.lit(0).alias("whole"), F.explode(F.split("low", "\n")).alias("low")).where(hold("low"))
    each = lines.unionAll(texts.select("doc_id", F.lit(1).alias("whole"), "low"))
    each = each.withColumn("canonical", canonical(F.col("low"))).where("canonical <> ''")
    hits = each.withColumn("digest", F.sha2("canonical", 256)).join(table, "digest").select("doc_id", "whole", "license_id")
    hits = hits.unionAll(_runs(texts).select("doc_id", F.lit(0).alias("whole"), "license_id"))
    found = hits.groupBy("doc_id").agg(
        F.max(F.when(F.col("whole") == 1, F.col("license_id"))).alias("whole_license"),
        F.sum(1 - F.col("whole")).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"),
    )
    ids = docs.select("doc_id").distinct()
    joined = ids.join(found.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("doc_id", "whole_license", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def _sql_canonical(x: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower({x}), {quote(COPYRIGHT)}, chr(10), 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    return f"trim(regexp_replace({out}, {quote(PUNCTUATION)}, ' ', 'g'), ' ')"


def oracle() -> str:
    """The same scan as DuckDB SQL over the documents view."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license_id, {_sql_canonical('t')} AS c FROM (VALUES {values}) v(license_id, t)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
hits AS (
  SELECT l.doc_id, k.license_id, 0 AS whole FROM (SELECT doc_id, {_sql_canonical('line')} AS c FROM lines) l JOIN known k ON k.c = l.c AND l.c <> ''
  UNION ALL
  SELECT d.doc_id, k.license_id, 1 FROM (SELECT doc_id, {_sql_canonical('text')} AS c FROM documents) d JOIN known k ON k.c = d.c AND d.c <> ''),
found AS (
  SELECT doc_id, max(CASE WHEN whole = 1 THEN license_id END) AS whole_license, CAST(sum(1 - whole) AS BIGINT) AS n_notices,
         array_to_string(list_sort(list(DISTINCT license_id)), ',') AS licenses
  FROM hits GROUP BY doc_id)
SELECT i.doc_id, f.whole_license, coalesce(f.n_notices, 0) AS n_notices, coalesce(f.licenses, '') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents) i LEFT JOIN found f ON f.doc_id IS NOT DISTINCT FROM i.doc_id
"""
