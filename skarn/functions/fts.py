"""Full-text search: tokens, inverted index, query language, highlighting.

A document matches by expressions over its text, so a search is a scan with a
filter and needs no stored index; `index` gives the inverted form where
postings themselves are wanted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def tokenize(text: Column) -> Column:
    """Lower-cased words, split at white space, without outer punctuation."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, _EDGE, "")), lambda w: w != "")


def tokenize_python(text: str) -> list[str]:
    """The same rule for query strings."""
    words = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in text.lower().split())
    return [w for w in words if w]


def index(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Postings: term, key, column, position."""
    parts = [docs.select(F.col(key), F.lit(c).alias("column"), F.posexplode(tokenize(F.col(c))).alias("position", "term")) for c in columns]
    return reduce(DataFrame.unionAll, parts).select("term", key, "column", "position")


def search(docs: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """key, score: documents with any term, by the number of hits."""
    terms = tokenize_python(query)
    hits = F.size(F.filter(tokenize(F.col(column)), lambda w: w.isin(terms) if terms else F.lit(False)))
    return docs.select(key, hits.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), key)


@dataclass
class Term:
    words: list[str]  # one word, or a phrase
    column: str | None = None


@dataclass
class Not:
    part: object


@dataclass
class Op:
    kind: str  # AND, OR
    parts: list


_LEX = re.compile(r'\s*(?:(\()|(\))|(-)|(?:(\w+)\s*:\s*)?"([^"]*)"|(?:(\w+)\s*:\s*)?([^\s()"]+))')


def parse(query: str):
    """word, "phrase", column:term, AND, OR, -not, parentheses; terms side by
    side must all match."""
    tokens: list = []
    pos = 0
    while pos < len(query.rstrip()):
        m = _LEX.match(query, pos)
        pos = m.end()
        if m[1] or m[2] or m[3]:
            tokens.append(m[1] or m[2] or m[3])
        elif m[5] is not None:
            tokens.append(Term(tokenize_python(m[5]), m[4]))
        elif m[7] in ("AND", "OR", "NOT") and not m[6]:
            tokens.append(m[7])
        else:
            tokens.append(Term(tokenize_python(m[7]), m[6]))
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def either():
        nonlocal at
        parts = [both()]
        while peek() == "OR":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Op("OR", parts)

    def both():
        nonlocal at
        parts = [one()]
        while peek() is not None and peek() not in ("OR", ")"):
            if peek() == "AND":
                at += 1
            parts.append(one())
        return parts[0] if len(parts) == 1 else Op("AND", parts)

    def one():
        nonlocal at
        token = peek()
        at += 1
        if token in ("-", "NOT"):
            return Not(one())
        if token == "(":
            inner = either()
            if peek() != ")":
                raise ValueError(f"unbalanced parenthesis in search {query!r}")
            at += 1
            return inner
        if not isinstance(token, Term):
            raise ValueError(f"cannot parse search {query!r}")
        return token

    tree = either() if tokens else Op("OR", [])
    if at < len(tokens):
        raise ValueError(f"cannot parse search {query!r}")
    return tree


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: What may stand beside a word within its token, and between the words of a phrase.
_BESIDE, _BETWEEN = r"[^\p{L}\p{N}\s]*", r"[^\p{L}\p{N}]*\s[^\p{L}\p{N}]*"


def match_sql(query: str, columns: list[str]) -> str:
    """The query as a SQL predicate over text columns.

    That a text has a token is said by a pattern, so no token array is made; a
    plain search for the word comes first, as most rows end there."""

    def term(t: Term) -> str:
        names = [c for c in columns if t.column is None or c.split(".")[-1].strip("`").lower() == t.column.lower()]
        if not names or not t.words:
            return "false"
        pattern = rf"(?:^|\s){_BESIDE}" + _BETWEEN.join(rf"\Q{w}\E" for w in t.words) + rf"{_BESIDE}(?:\s|$)"
        held = " AND ".join(f"contains(lower({{0}}), {_quote(w)})" for w in t.words)
        return "(" + " OR ".join(f"coalesce({held} AND lower({{0}}) RLIKE {_quote(pattern)}, false)".replace("{0}", c) for c in names) + ")"

    def walk(node) -> str:
        if isinstance(node, Term):
            return term(node)
        if isinstance(node, Not):
            return f"(NOT {walk(node.part)})"
        return "(" + f" {node.kind} ".join(walk(p) for p in node.parts) + ")" if node.parts else "false"

    return walk(parse(query))


def match(query: str, columns: list[str]) -> Column:
    """The query as a column predicate."""
    return F.expr(match_sql(query, columns))


def highlight(text: Column, query: str) -> Column:
    """The first occurrence of each query term, whatever its case, between **."""
    for word in tokenize_python(query):
        at = F.locate(word, F.lower(text))
        n = len(word)
        marked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("**"), F.substring(text, at, F.lit(n)), F.lit("**"), F.substring(text, at + n, F.length(text)))
        text = F.when(at > 0, marked).otherwise(text)
    return text


def highlight_sql(text: str, query: str) -> str:
    """`highlight` as SQL over a text expression."""
    for word in tokenize_python(query):
        at, n = f"locate({_quote(word)}, lower({text}))", len(word)
        marked = f"concat(substring({text}, 1, {at} - 1), '**', substring({text}, {at}, {n}), '**', substring({text}, {at} + {n}))"
        text = f"(CASE WHEN {at} > 0 THEN {marked} ELSE {text} END)"
    return text
