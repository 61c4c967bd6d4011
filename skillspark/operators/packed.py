"""Problem 5: several values packed into one field, one row per value with its place.

Quoted notations (JSON, Python lists) tell where a value ends, so they give the
dictionary of values that contain a delimiter themselves. An automaton finds
these values in every text; dynamic programming over the places where an item
may begin picks the cover of least cost: quoted and known items are cheap,
unknown items dear. A delimiter inside a chosen item is protected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillspark.session import cut_lineage

#: Delimiters between items; a slash without blanks also stands inside values.
DELIMITERS = ",;|\t\n\r\v\f•·、，；｜‖¦/ "
_DELIM = re.compile("[" + re.escape(DELIMITERS) + "]")
#: Opening quotes with what closes them.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "`": "`"}
_BRACKETS = {"[": "]", "(": ")", "{": "}"}
#: Texts that say that there is no list (fixed values, compared in lower case).
NO_LIST = frozenset(("", "nan", "none", "null", "n/a", "na", "-", "--", "...", "[]", "{}", "()", "nil", "<na>", "unknown", "không có", "đang cập nhật"))
_LIST_MARK = re.compile(r"^(?:[-–—*▪◦‣●○■□➢>+]+\s+|\(?\d{1,3}[.)]\s+)")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
#: Costs of the cover.
QUOTED, KNOWN, UNKNOWN = 0.01, 0.1, 1.0
#: What a slash inside an unknown item costs.
INNER_SLASH = 0.2
#: Texts run together by more slashes than this are a list: outside known values each of its slashes separates.
MAX_INNER = 2
#: Dictionary terms per automaton and pass over the texts; the driver holds one such part at a time.
TERMS_PER_PASS = 200_000


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if len(x) > 1 else _ESCAPED.get(x, x)

    return _ESCAPE.sub(one, text) if "\\" in text else text


def _quoted(text: str, at: int, end: int) -> tuple[str, int] | None:
    """The value of a quoted item that begins at `at` and the place after its closing quote; None if no quote closes before a delimiter or the end."""
    close = QUOTES[text[at]]
    i = at + 1
    while i < end:
        if text[i] == "\\" and i + 1 < end:
            i += 2
            continue
        if text[i] == close:
            if i + 1 < end and text[i + 1] == close and close == '"':  # doubled
                i += 2
                continue
            j = i + 1
            while j < end and text[j] == " ":
                j += 1
            if j == end or text[j] in DELIMITERS:
                inner = text[at + 1 : i]
                return _unescape(inner.replace('""', '"') if close == '"' else inner), j
        i += 1
    return None


def _outside(text: str) -> tuple[int, int]:
    """The span of the text without blanks and the brackets of a list."""
    a, b = 0, len(text)
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if b - a >= 2 and _BRACKETS.get(text[a]) == text[b - 1]:
        return a + 1, b - 1
    if b > a and text[a] == "[":
        return a + 1, b
    return a, b


def strict_items(text: str | None) -> list[str]:
    """The values of a text in which every item of a bracketed list is quoted; else none."""
    if not text or not text.lstrip().startswith("["):
        return []
    at, end = _outside(text)
    out = []
    while at < end:
        while at < end and text[at].isspace():
            at += 1
        if at == end:
            break
        got = _quoted(text, at, end) if text[at] in "'\"" else None
        if got is None:
            return []
        out.append(got[0].strip())
        at = got[1]
        if at < end and text[at] != ",":
            return []
        at += 1
    return out


def _edges(text: str, begin: int, at: int, end: int) -> bool:
    """Whether at (not the end) separates items for certain: any delimiter but a slash with letters on both sides."""
    if text[at] != "/":
        return True
    return at == begin or at + 1 == end or text[at - 1].isspace() or text[at + 1].isspace()


def _slash_lists(text: str, begin: int, cuts: list[int], end: int) -> set[int]:
    """The slashes of runs of more than MAX_INNER slashes between certain delimiters."""
    out: set[int] = set()
    run: list[int] = []
    for at in [*cuts, end]:
        if at == end or _edges(text, begin, at, end):
            if len(run) > MAX_INNER:
                out.update(run)
            run = []
        else:
            run.append(at)
    return out


def split_items(text: str | None, spans: list[tuple[int, int]]) -> list[str]:
    """The values of one text in order; spans are the places (start, end) of known values in it."""
    if text is None or text.strip().lower() in NO_LIST:
        return []
    begin, end = _outside(text)
    cuts = [m.start() for m in _DELIM.finditer(text, begin, end)]
    known: dict[int, list[int]] = {}
    for a, b in spans:
        known.setdefault(a, []).append(b)
    stops = set(cuts) | {end}
    listed = _slash_lists(text, begin, cuts, end)
    best: dict[int, tuple[float, int, tuple | None]] = {begin: (0.0, 0, None)}

    def offer(at: int, cost: float, parts: int, back: tuple) -> None:
        old = best.get(at)
        if old is None or (cost, parts) < old[:2]:
            best[at] = (cost, parts, back)

    places = [begin, *(c + 1 for c in cuts)]
    ends = [*cuts, end]
    last = end + 1
    for k, place in enumerate(places):
        if place not in best:
            continue
        cost, parts, _ = best[place]
        at = place
        while at < end and text[at].isspace() and text[at] not in DELIMITERS:
            at += 1
        mark = _LIST_MARK.match(text[at : min(end, at + 8)])
        if mark:
            at += mark.end()
        if at < end and text[at] in QUOTES and (got := _quoted(text, at, end)):
            offer(got[1] + 1, cost + (QUOTED if got[0].strip() else 0), parts + 1, (place, got[0].strip()))
        for stop in known.get(at, ()):
            j = stop
            while j < end and text[j].isspace() and text[j] not in DELIMITERS:
                j += 1
            if j in stops:
                offer(j + 1, cost + KNOWN, parts + 1, (place, text[at:stop]))
        # an unknown item reaches to the next certain delimiter or to any slash before it
        for stop in islice(ends, k, None):
            item = text[at:stop].strip() if at < stop else ""
            offer(stop + 1, cost + (UNKNOWN + INNER_SLASH * item.count("/") if item else 0), parts + 1, (place, item))
            if stop == end or stop in listed or _edges(text, begin, stop, end):
                break
    items: list[str] = []
    at = last
    while at != begin and best[at][2]:
        at, item = best[at][2]
        items.append(item)
    return [x for x in reversed(items) if x and x.lower() not in NO_LIST]


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, len(t))
    a.make_automaton()
    return a


def _known_spans(text: str | None, automaton: ahocorasick.Automaton) -> list[list[int]]:
    low = text.lower() if text else ""
    if not low or len(low) != len(text):  # lower case of another length: places would not fit
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    return [[e + 1 - n, e + 1] for e, n in automaton.iter(low)] if low else []


def dictionary(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term): values of fully quoted lists in lower case, of which the automaton needs to know them."""

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"term": [v.lower() for t in b["text"] for v in strict_items(t) if v]}, dtype="object")

    quoted = texts.where(F.ltrim(text).startswith("[")).select(F.col(text).alias("text"))
    return quoted.mapInPandas(mine, "term string").distinct()


def unpack(lists: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(row_id, pos, item): one row per value of lists(row_id, text).

    names(term) adds known values to those mined from the lists. Null, blank
    and placeholder texts, and empty places, give no rows; repeats within a
    list stay. row_id must be unique.
    """
    terms = dictionary(lists)
    if names is not None:
        terms = terms.unionByName(names.select(F.lower("term").alias("term")).where("term <> ''")).distinct()
    terms = cut_lineage(terms)
    n = max(1, -(-terms.count() // TERMS_PER_PASS))
    part = lambda i: [r["term"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).collect()]
    found = lists.select("row_id", "text", F.expr("CAST(array() AS array<array<int>>)").alias("spans"))
    for i in range(n - 1):  # about TERMS_PER_PASS terms each
        found = cut_lineage(found.mapInPandas(_finder(part(i)), "row_id long, text string, spans array<array<int>>"))
    return found.mapInPandas(_splitter(part(n - 1)), "row_id long, pos int, item string")


def _finder(terms: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(terms)
        for b in batches:
            b["spans"] = [[*map(list, s), *_known_spans(t, automaton)] for t, s in zip(b["text"], b["spans"])]
            yield b

    return run


def _splitter(terms: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(terms) if terms else None
        for b in batches:
            rows = []
            for i, t, s in zip(b["row_id"], b["text"], b["spans"]):
                spans = [tuple(x) for x in s] + [tuple(x) for x in (_known_spans(t, automaton) if automaton else ())]
                rows += [(i, k, v) for k, v in enumerate(split_items(t, spans), 1)]
            yield pd.DataFrame(rows, columns=["row_id", "pos", "item"])

    return run
