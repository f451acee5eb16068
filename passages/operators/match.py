"""The match language: an expression is parsed on the driver and becomes Column expressions.

Terms, "phrases", prefix*, column: and {columns}: filters, NEAR(a b, n), AND,
OR, NOT, implicit AND and parentheses; NOT binds closest, OR least. Rows carry
one token array for each column, so phrases and NEAR look at places in it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from ..schema import EngineError
from .rank import bm25_term, idf

_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(){},:*+^])|([^\s"(){},:*+^]+))')
_TERM = re.compile(r"[^\W]+(?:[-_][^\W]+)*|[\w-]+")


@dataclass
class Phrase:
    """Consecutive terms; the last may be a prefix; columns None means any."""

    terms: list[str]
    prefix: bool = False
    columns: list[str] | None = None


@dataclass
class Near:
    phrases: list[Phrase]
    distance: int = 10


@dataclass
class Node:
    op: str  # and, or, not
    parts: list = field(default_factory=list)


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise self.error(text[at:])
            at = m.end()
            if m[1] is not None:
                self.tokens.append(("string", m[1].replace('""', '"')))
            elif m[2]:
                self.tokens.append(("mark", m[2]))
            else:
                self.tokens.append(("word", m[3]))
        self.at = 0

    @staticmethod
    def error(near: str) -> EngineError:
        return EngineError(422, f'syntax error near "{near}"')

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if (kind and token[0] != kind) or (value and token[1] != value) or token[0] == "end":
            raise self.error(token[1])
        self.at += 1
        return token

    def parse(self):
        if not self.tokens:
            raise self.error("")
        out = self.either()
        if self.peek()[0] != "end":
            raise self.error(self.peek()[1])
        return out

    def either(self):
        parts = [self.both()]
        while self.peek() == ("word", "OR"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both(self):
        parts = [self.without()]
        while True:
            if self.peek() == ("word", "AND"):
                self.take()
            elif self.peek()[0] == "end" or self.peek() in (("mark", ")"), ("word", "OR")):
                break
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def without(self):
        out = self.primary(None)
        while self.peek() == ("word", "NOT"):
            self.take()
            out = Node("not", [out, self.primary(None)])
        return out

    def columns(self) -> list[str] | None:
        """A column filter before its colon, if one stands here."""
        if self.peek()[0] in ("word", "string") and self.peek(1) == ("mark", ":"):
            name = self.take()[1]
            self.take()
            return [name]
        if self.peek() == ("mark", "{"):
            self.take()
            names = []
            while self.peek() != ("mark", "}"):
                names.append(self.take()[1])
            self.take()
            self.take("mark", ":")
            return names
        return None

    def primary(self, columns: list[str] | None):
        columns = self.columns() or columns
        if self.peek() == ("mark", "("):
            self.take()
            out = self.either()
            self.take("mark", ")")
            return _limit(out, columns)
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.at += 2
            phrases, distance = [], 10
            while self.peek() != ("mark", ")"):
                if self.peek() == ("mark", ","):
                    self.take()
                    distance = int(self.take("word")[1])
                else:
                    phrases.append(self.phrase(columns))
            self.take()
            return Near(phrases, distance)
        return self.phrase(columns)

    def phrase(self, columns: list[str] | None) -> Phrase:
        terms: list[str] = []
        if self.peek() == ("mark", "^"):
            raise EngineError(422, "^ is not supported")
        while True:
            kind, value = self.take()
            if kind == "mark" or kind == "word" and value in ("AND", "OR", "NOT"):
                raise self.error(value)
            if kind == "word" and not re.fullmatch(r"\w+", value):
                raise self.error(value)
            terms += _TERM.findall(value.lower())
            if self.peek() == ("mark", "+"):
                self.take()
                continue
            break
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        return Phrase(terms, prefix, columns)


def _limit(node, columns: list[str] | None):
    if columns is None:
        return node
    if isinstance(node, Phrase):
        node.columns = node.columns or columns
    for part in node.parts if isinstance(node, Node) else node.phrases if isinstance(node, Near) else []:
        _limit(part, columns)
    return node


def parse(text: str):
    return _Parser(text).parse()


def places(phrase: Phrase, tokens: Column) -> Column:
    """Array of the places (from 0) where a phrase begins."""
    n = len(phrase.terms)
    everywhere = F.sequence(F.lit(0), F.size(tokens) - n)
    if not n:
        return F.array().cast("array<int>")

    def here(i: Column) -> Column:
        out = F.lit(True)
        for j, term in enumerate(phrase.terms):
            token = F.get(tokens, i + j)
            out = out & (F.startswith(token, F.lit(term)) if phrase.prefix and j == n - 1 else token == term)
        return out

    # The rarest test first: rows without the first term are not walked.
    may = F.lit(True) if phrase.prefix and n == 1 else F.array_contains(tokens, phrase.terms[0])
    return F.when((F.size(tokens) >= n) & may, F.filter(everywhere, here)).otherwise(F.array().cast("array<int>"))


class Placed:
    """Places of all phrases of an expression in all its columns, each as a column of its own."""

    def __init__(self, node, columns: list[str]) -> None:
        self.columns = columns
        self.phrases = _phrases(node)
        for p in self.phrases:
            unknown = [n for n in p.columns or [] if n not in columns]
            if unknown:
                raise EngineError(422, f"no such column: {unknown[0]}")

    def name(self, phrase: Phrase, column: str) -> str:
        i = next(i for i, p in enumerate(self.phrases) if p is phrase)
        return f"__p{i}_{self.columns.index(column)}"

    def expressions(self, tokens: dict[str, Column]) -> list[Column]:
        return [places(p, tokens[c]).alias(self.name(p, c)) for p in self.phrases for c in p.columns or self.columns]

    def count(self, phrase: Phrase) -> Column:
        """How often a phrase occurs in its columns."""
        out = F.lit(0)
        for c in phrase.columns or self.columns:
            out = out + F.size(self.name(phrase, c))
        return out

    def matches(self, node) -> Column:
        """Whether a row matches."""
        if isinstance(node, Phrase):
            return self.count(node) > 0
        if isinstance(node, Near):
            out = F.lit(False)
            for c in self.columns:
                if any(p.columns and c not in p.columns for p in node.phrases):
                    continue
                found = [F.col(self.name(p, c)) for p in node.phrases]
                for first, start in zip(node.phrases, found):
                    out = out | F.exists(start, _near(found, len(first.terms) + node.distance))
            return out
        parts = [self.matches(p) for p in node.parts]
        if node.op == "not":
            return parts[0] & ~parts[1]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return out


def _near(found: list[Column], reach: int):
    """Whether each of the phrases has a place from s to s + reach."""

    def within(s: Column) -> Column:
        ok = F.lit(True)
        for other in found:
            ok = ok & F.exists(other, lambda p: (p >= s) & (p <= s + reach))
        return ok

    return within


def _phrases(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    return [x for p in (node.phrases if isinstance(node, Near) else node.parts) for x in _phrases(p)]


def scored_phrases(node) -> list[Phrase]:
    """Phrases that count for the score: all but those right of NOT."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    if node.op == "not":
        return scored_phrases(node.parts[0])
    return [x for p in node.parts for x in scored_phrases(p)]


def search(rows: DataFrame, key: str, columns: dict[str, Column], expression: str) -> DataFrame:
    """(key, bm25) of the rows that match; statistics are of all rows."""
    node = parse(expression)
    phrases, placed = scored_phrases(node), Placed(node, list(columns))
    held = rows.select(key, once(*[c.alias(f"__c{i}") for i, c in enumerate(columns.values())]))
    arrays = {name: F.col(f"__c{i}") for i, name in enumerate(columns)}
    dl = sum((F.size(c) for c in arrays.values()), F.lit(0))
    found = held.select(key, dl.alias("__dl"), once(*placed.expressions(arrays)))
    counted = found.select(key, "__dl", placed.matches(node).alias("__hit"), *[placed.count(p).alias(f"__tf{i}") for i, p in enumerate(phrases)])
    stats = counted.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *_frequencies(phrases))
    return _scored(counted, stats, phrases, key)


def _frequencies(phrases: list[Phrase]) -> list[Column]:
    return [F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(phrases))]


def _scored(counted: DataFrame, stats: DataFrame, phrases: list[Phrase], key: str) -> DataFrame:
    score = F.lit(0.0)
    for i in range(len(phrases)):
        score = score + bm25_term(F.col(f"__tf{i}"), F.col("__dl"), F.col("__avg"), idf(F.col("__n"), F.col(f"__df{i}")))
    return counted.where("__hit").crossJoin(F.broadcast(stats)).select(key, score.alias("bm25"))


def search_postings(posts: DataFrame, stats: DataFrame, key: str, columns: tuple[str, ...], gap: int, expression: str) -> DataFrame:
    """As search(), from an index: posts (term, key, dl, spots) and the row of stats (n, avgdl).

    Only postings of the expression's terms are read; those of a row meet by its
    key, and places tell columns apart by multiples of ``gap``.
    """
    node = parse(expression)
    phrases, placed = scored_phrases(node), Placed(node, list(columns))
    terms = list(dict.fromkeys((t, p.prefix and j == len(p.terms) - 1) for p in placed.phrases for j, t in enumerate(p.terms)))
    is_term = [F.startswith("term", F.lit(t)) if prefix else F.col("term") == t for t, prefix in terms]
    some = F.lit(False)
    for one in is_term:
        some = some | one
    spots = [F.flatten(F.collect_list(F.when(one, F.col("spots")))).alias(f"__s{j}") for j, one in enumerate(is_term)]
    met = posts.where(some).groupBy(key).agg(F.first("dl").alias("__dl"), *spots)

    def begins(phrase: Phrase, column: str) -> Column:
        if not phrase.terms:
            return F.array().cast("array<int>")
        low = columns.index(column) * gap
        lists = [F.col(f"__s{terms.index((t, phrase.prefix and j == len(phrase.terms) - 1))}") for j, t in enumerate(phrase.terms)]

        def here(p: Column) -> Column:
            out = (p >= low) & (p < low + gap)
            for j, other in enumerate(lists[1:], 1):
                out = out & F.array_contains(other, p + j)
            return out

        return F.filter(lists[0], here)

    found = met.select(key, "__dl", once(*[begins(p, c).alias(placed.name(p, c)) for p in placed.phrases for c in p.columns or columns]))
    counted = found.select(key, "__dl", placed.matches(node).alias("__hit"), *[placed.count(p).alias(f"__tf{i}") for i, p in enumerate(phrases)])
    whole = stats.select(F.col("n").alias("__n"), F.col("avgdl").alias("__avg"))
    return _scored(counted, counted.agg(*_frequencies(phrases)).crossJoin(F.broadcast(whole)), phrases, key)
