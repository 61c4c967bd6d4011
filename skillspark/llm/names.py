"""Problem 1: spellings of names that mean the same organisation.

A spelling is read as a brand, a line of business, a legal form and the rest
(country, branch). Brands are linked by a symmetric-delete index: two brands at
one edit share a text with one letter left out, so an equi join on these texts
finds all candidates. A candidate is aligned token by token, by the optimal
assignment, with initials and abbreviations allowed. A misspelt brand joins the
best supported brand it aligns with. Within a brand, spellings with different
lines of business are different organisations; a spelling without one belongs to
the only line of its brand or to the one whose legal form it shares.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillspark.session import cut_lineage

# Words of names of firms, without accents, in lower case.
#: Legal forms by kind; "" is a form that any firm may add.
LEGAL = {
    "llc": "trach nhiem huu han|tnhh mot thanh vien|tnhh mtv|tnhh|limited liability company|company limited|co limited|co ltd|limited|ltd|llc|pte ltd|gmbh|mtv",
    "jsc": "co phan|c p|cp|ctcp|joint stock company|joint stock|j s c|jsc|corporation|corp|incorporated|inc|plc|tmcp",
    "": "cong ty|congty|cty|c ty|ct|company|co|group|tap doan|tong cong ty|holdings|holding|enterprise|doanh nghiep|dntn|nha",
}
#: Countries and other additions that tell nothing apart.
COUNTRY = "viet nam|vietnam|vn|v n"
FILLERS = "and|va|of|the|international|intl|int l|quoc te"
#: Lines of business: each row names one line, in Vietnamese, English and short.
LINES = {
    "software": "phan mem|software|pm|sw",
    "technology": "cong nghe|technology|technologies|tech|cn",
    "electronics": "dien tu|electronics|electronic|elec|dt",
    "mechanical": "co khi|mechanical|mechanics|mech|ck",
    "construction": "xay dung|construction|constructions|const|xd",
    "real estate": "bat dong san|real estate|realty|r e|re|bds",
    "interior": "noi that|interior|interiors|int|nt",
    "garment": "may mac|garment|garments|gmt|mm",
    "foods": "thuc pham|foods|food|f b|fnb|tp",
    "agri": "nong san|agri products|agri product|agriculture|agri|ns",
    "pharmaceutical": "duoc pham|pharmaceuticals|pharmaceutical|pharma|dp",
    "education": "giao duc|education|edu|gd",
    "communications": "truyen thong|communications|communication|comms|comm|tt",
    "transport": "van tai|transportation|transport|trans|vt",
    "travel": "du lich|travel|trvl|tourism|dl",
    "trading": "thuong mai dich vu|trading service|trading services|t s|tmdv|thuong mai|trading",
    "retail": "ban le|retail|mart",
    "consulting": "tu van|consulting|consultants|consultancy",
    "bank": "ngan hang|bank|nh",
    "university": "truong dai hoc ky thuat|truong dai hoc|dai hoc ky thuat|dh ky thuat|dhkt|university of technology|university|dai hoc|dh",
    "freight": "freight|logistics|van chuyen",
    "systems": "systems|system|sys|he thong",
}
BRANCH = re.compile(r"(?:\s[-–]\s*|\(\s*)(?:chi nhanh|cn|branch|vpdd|van phong dai dien)\s+[^()-]*\)?\s*$|\s+chi nhanh\s[^()]*$")

#: Longer texts are indexed by halves; those of one letter more by both, since their partner may be shorter.
LONG = 40

_TOKEN = re.compile(r"[a-z0-9]+")
_ALIAS = re.compile(r"\(([^()]+)\)")


def _terms() -> dict[tuple[str, ...], tuple[str, str]]:
    out: dict[tuple[str, ...], tuple[str, str]] = {}
    for line, words in LINES.items():
        for w in words.split("|"):
            out[tuple(w.split())] = ("line", line)
    for kind, words in LEGAL.items():
        for w in words.split("|"):
            out[tuple(w.split())] = ("legal", kind)
    for w in COUNTRY.split("|"):
        out[tuple(w.split())] = ("country", "")
    for w in FILLERS.split("|"):
        out[tuple(w.split())] = ("filler", "")
    return out


TERMS = _terms()
LONGEST = max(map(len, TERMS))


def deletes(text: str) -> set[str]:
    """The text and all texts with one letter left out."""
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


def variant_keys(text: str) -> set[str]:
    """Texts at one edit share a key. Short texts: their deletes. Of a long text one edit leaves the first or the last half as it is."""
    n = len(text)
    keys = deletes(text) if n <= LONG + 1 else set()
    if n >= LONG:
        halves = {n // 2 - 1, (n - 1) // 2 - 1}
        keys |= {f"<{h}|{text[:h]}" for h in halves} | {f">{h}|{text[-h:]}" for h in halves}
    return keys


@lru_cache(maxsize=200_000)
def near(a: str, b: str) -> bool:
    """At most one letter added, left out, changed or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _term_index() -> dict[str, list[tuple[str, ...]]]:
    """Symmetric-delete index of the long terms, written as one word."""
    index: dict[str, list[tuple[str, ...]]] = {}
    for t in list(TERMS):
        for w in t if len(t) > 1 else ():  # part of a term whose other words were read by themselves
            if len(w) >= 6:
                TERMS.setdefault((w,), ("filler", ""))
    for t in TERMS:
        if len(joined := "".join(t)) >= 4:
            for d in deletes(joined):
                index.setdefault(d, []).append(t)
    return index


TERM_INDEX = _term_index()
LONGEST_TERM = max(len("".join(t)) for t in TERMS)


def split_humps(text: str) -> str:
    """XuânHòa and LHGBank as two words."""
    return "".join(
        " " + c
        if k and c.isupper() and (text[k - 1].islower() or text[k - 1].isupper() and text[k + 1 : k + 2].islower())
        else c
        for k, c in enumerate(text)
    )


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.lower()).replace("đ", "d")
    return "".join(c for c in t if not unicodedata.combining(c))


def _fuzzy_term(words: tuple[str, ...], least: int) -> tuple[str, ...] | None:
    joined = "".join(words)
    if not least <= len(joined) <= LONGEST_TERM + 1:
        return None
    for d in deletes(joined):
        for t in TERM_INDEX.get(d, ()):
            if len("".join(t)) >= least and near(joined, "".join(t)):
                return t
    return None


class Name:
    """One spelling, read."""

    __slots__ = ("alias", "brand", "legal", "line")

    def __init__(self, text: str, common: frozenset[str] = frozenset()):
        plain = unicodedata.normalize("NFC", text)
        self.alias: list[str] = []
        folded = fold(split_humps(plain))
        for inner in _ALIAS.findall(folded):
            words = tuple(_TOKEN.findall(inner))
            if TERMS.get(words, ("",))[0] != "country" and not _fuzzy_country(words):
                self.alias = list(words)
        folded = BRANCH.sub("", _ALIAS.sub(" ", folded))
        words = _TOKEN.findall(folded.replace("'", " "))
        kinds = self._label(words, common)
        self.line = next((v for k, v in kinds if k == "line"), "")
        self.legal = next((v for k, v in kinds if k == "legal" and v), "")
        left = [w for w, (k, _) in zip(words, kinds) if k == "brand"]
        if not left:  # nothing but general words, or no Latin letters at all: they are the name
            left = words or folded.split() or [plain.strip()]
            self.line = self.legal = ""
        if len(left) > 1 and not self.alias:  # QSV - Quorvane Systems: a short form and what it stands for
            others = [*left[1:], *self.line.split()]
            if _short(left[0]) and left[0].startswith("".join(w[0] for w in others)[:3]) and len(others) > 1:
                self.alias = left = left[1:]
        self.brand = left

    @staticmethod
    def _label(words: list[str], common: frozenset[str]) -> list[tuple[str, str]]:
        """A kind and value for every word: exact terms first, longest first, then misspelt ones."""
        n = len(words)
        kinds: list[tuple[str, str] | None] = [None] * n
        lines = 0
        for size in range(LONGEST, 0, -1):
            for i in range(n - size + 1):
                if any(kinds[i : i + size]):
                    continue
                hit = TERMS.get(tuple(words[i : i + size]))
                if hit is None or hit[0] == "line" and lines:
                    continue
                # syllables of a brand: a short word between others of the brand is no term
                for j in range(i, i + size):
                    kinds[j] = hit
                lines += hit[0] == "line"
        left = sum(k is None for k in kinds)
        legal = any(k and k[0] == "legal" and k[1] for k in kinds)
        for size in range(min(4, n), 0, -1):
            for i in range(n - size + 1):
                window = words[i : i + size]
                # a misspelt term has a word that is rare
                if any(kinds[i : i + size]) or left <= size or all(w in common for w in window):
                    continue
                t = _fuzzy_term(tuple(window), 4 if left > 2 else 6)
                if t is None and left - size >= 1 and all(len(w) < 3 for w in window) and near("".join(window), "jsc"):
                    t = ("jsc",)
                if t and not (TERMS[t][0] == "line" and lines) and not (TERMS[t][0] == "legal" and TERMS[t][1] and legal):
                    for j in range(i, i + size):
                        kinds[j] = TERMS[t]
                    lines += TERMS[t][0] == "line"
                    legal = legal or bool(TERMS[t][0] == "legal" and TERMS[t][1])
                    left -= size
        return [k or ("brand", "") for k in kinds]


def name_words(text: str) -> set[str]:
    return set(_TOKEN.findall(fold(split_humps(unicodedata.normalize("NFC", text)))))


def _short(word: str) -> bool:
    """Whether a word can be initials: two to five letters, no vowel among them."""
    return 2 <= len(word) <= 5 and not set(word) & set("aeiouy")


def _abbreviated(word: str, text: str) -> bool:
    """Whether a word with vowels stands in capitals in a text of mixed case, so that it may be initials or a name."""
    return 2 <= len(word) <= 5 and word.isalpha() and word.upper() in text and text.upper() != text


def _fuzzy_country(words: tuple[str, ...]) -> bool:
    t = _fuzzy_term(words, 6)
    return bool(t) and TERMS[t][0] == "country"


#: A brand of more spellings than this joins another only if that has SUPPORT_TIMES as many.
FEW_SPELLINGS, SUPPORT_TIMES = 2, 3
#: Words in so many names, and in so large a part of them, are no misspellings.
COMMON_NAMES, COMMON_SHARE = 5, 0.0005
#: Tokens of a brand whose orders are tried as one word; longer brands are indexed by their tokens without order.
MAX_ORDERED = 3


def orders(tokens: list[str]) -> set[str]:
    """The brand as one word, in every order of its tokens if these are few."""
    return {"".join(p) for p in permutations(tokens)} if len(tokens) <= MAX_ORDERED else {"".join(tokens)}


def token_keys(tokens: list[str]) -> set[str]:
    """Brands of the same tokens in any order, one of them at one edit, share a key. Beyond LONG letters a key leaves a token out instead of a letter."""
    each = [xxhash.xxh3_64_intdigest(t) for t in tokens]
    total, letters = sum(each), sum(map(len, tokens))
    rests = set()
    for t, h in zip(tokens, each):
        if letters <= LONG + 1:
            rests |= {total - h + xxhash.xxh3_64_intdigest(d) for d in deletes(t)}
        if letters >= LONG:
            rests.add(total - h)
    return {f"~{r:x}" for r in rests}


def brand_keys(tokens: list[str]) -> set[str]:
    """Keys of the index: deletes of each token beside the others, and of all tokens run together."""
    keys = {d for o in orders(tokens) for d in variant_keys(o)}
    return keys | token_keys(tokens) if len(tokens) > 1 else keys


#: Cost of a letter that stands for a token which begins with it; of a pair of tokens that cannot mean the same.
INITIAL, NEVER = 0.001, 1e6


def token_cost(x: str, y: str, initials: bool) -> float:
    """0 for equal tokens, 1 for one edit, INITIAL for an initial of the other."""
    if x == y:
        return 0.0
    if initials and min(len(x), len(y)) == 1 and x[0] == y[0]:
        return INITIAL
    return 1.0 if near(x, y) else NEVER


def assignment(a: list[str], b: list[str], initials: bool = False) -> float:
    """Least cost of pairing every token of a with one of b; NEVER or more if they cannot be paired.

    Hungarian method: rows are taken in one by one along shortest augmenting
    paths over reduced costs.
    """
    n = len(a)
    if n != len(b):
        return NEVER
    cost = [[token_cost(x, y, initials) for y in b] for x in a]
    u, v, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        way, least, done = [n] * (n + 1), [float("inf")] * (n + 1), [False] * (n + 1)
        row_of[n], at = i, n
        while row_of[at] != n or at == n:
            done[at], r = True, row_of[at]
            for j in range(n):
                if not done[j] and (c := cost[r][j] - u[r] - v[j]) < least[j]:
                    least[j], way[j] = c, at
            nxt = min((j for j in range(n) if not done[j]), key=least.__getitem__)
            step = least[nxt]
            for j in range(n + 1):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nxt
        while at != n:
            row_of[at], at = row_of[way[at]], way[at]
    return sum(cost[row_of[j]][j] for j in range(n))


def aligned(a: list[str], b: list[str], initials: bool = False) -> bool:
    """Whether the cheapest assignment of tokens leaves at most one edit beside initials; texts run together count as one token."""
    if near("".join(a), "".join(b)) or assignment(a, b, initials) < 2:
        return True
    # a token written as several, the others in any order
    left, right = list((Counter(a) - Counter(b)).elements()), list((Counter(b) - Counter(a)).elements())
    if len(left) != len(right) and min(len(left), len(right)) == 1 and near("".join(left), "".join(right)):
        return True
    return len(a) == len(b) <= MAX_ORDERED and any(near("".join(a), "".join(p)) for p in permutations(b))


def _parse(batches: Iterator[pd.DataFrame], common: frozenset[str]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b["company"]:
            n = Name(text, common)
            tokens = n.alias or n.brand
            short = ""
            if all(len(w) == 1 for w in tokens) and len(tokens) > 1 or len(tokens) == 1 and _short(tokens[0]):
                short = "".join(tokens)
            initial = not short and len(tokens) > 1 and any(len(w) == 1 for w in tokens)
            capitals = not short and len(tokens) == 1 and _abbreviated(tokens[0], text)
            rows.append((text, tokens, "".join(tokens), n.line, n.legal, short, initial, capitals))
        yield pd.DataFrame(rows, columns=["company", "tokens", "brand", "line", "legal", "short", "initial", "capitals"])


def read_names(companies: DataFrame) -> DataFrame:
    """(company, tokens, brand, line, legal, short, initial, capitals) of distinct companies(company)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"w": [w for t in b["company"] for w in name_words(t)]}, dtype="object")

    least = max(COMMON_NAMES, COMMON_SHARE * companies.count())
    counted = companies.mapInPandas(split, "w string").groupBy("w").agg(F.count("*").alias("n"))
    # at most words-per-name / COMMON_SHARE words
    common = frozenset(r["w"] for r in counted.where(F.col("n") >= least).collect())
    return companies.mapInPandas(
        lambda batches: _parse(batches, common),
        "company string, tokens array<string>, brand string, line string, legal string, short string, initial boolean, capitals boolean",
    )


def brand_roots(names: DataFrame) -> DataFrame:
    """(brand, root): every full brand with the best supported brand it is a spelling of."""
    nodes = cut_lineage(
        names.where("short = '' AND NOT initial")
        .groupBy("brand")
        .agg(F.count("*").alias("n"), F.min("tokens").alias("tokens"), F.collect_set("tokens").alias("all"))
    )

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (brand, key)
                for brand, every in zip(b["brand"], b["all"])
                for key in {k for t in every for k in brand_keys(list(t))}
            ]
            yield pd.DataFrame(rows, columns=["brand", "key"])

    keys = nodes.select("brand", "all").mapInPandas(index, "brand string, key string")
    side = nodes.select("brand", "n", "all")
    pairs = (
        keys.join(keys.select(F.col("brand").alias("other"), "key"), "key")
        .where("brand <> other")
        .select("brand", "other")
        .distinct()
        .join(side, "brand")
        .join(side.select(F.col("brand").alias("other"), F.col("n").alias("m"), F.col("all").alias("all2")), "other")
        # to the better supported; of equals to the smaller text
        .where("m > n OR (m = n AND other < brand)")
    )

    @F.pandas_udf("int")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y) -> int:
            x, y = [list(t) for t in x], [list(t) for t in y]
            if any(sorted(s) == sorted(t) for s in x for t in y):
                return 2
            return int(any(aligned(s, t) for s in x for t in y))

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    linked = pairs.withColumn("alike", alike("all", "all2")).where(
        (F.col("alike") == 2) | ((F.col("alike") == 1) & ((F.col("n") <= FEW_SPELLINGS) | (F.col("n") * SUPPORT_TIMES <= F.col("m"))))
    )
    up = linked.groupBy("brand").agg(F.max(F.struct("alike", "m", "other")).getField("other").alias("root"))
    links = cut_lineage(nodes.select("brand").join(up, "brand", "left").select("brand", F.coalesce("root", "brand").alias("root")))
    while True:  # links lead to better supported brands only: jumps end at the best one
        further = links.select(F.col("brand").alias("root"), F.col("root").alias("top"))
        new = cut_lineage(links.join(further, "root").select("brand", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        links = new.drop("moved")
        if not moved:
            return links


def _attach(names: DataFrame, known: DataFrame) -> DataFrame:
    """(company, root, line) of spellings with initials or short forms that fit one known organisation best."""

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for company, tokens, line, legal, short in zip(b["company"], b["tokens"], b["line"], b["legal"], b["short"]):
                t = list(tokens)
                rests = {} if short else {t[i] + "|": "".join(t[:i] + t[i + 1 :]) for i in range(len(t)) if len(t[i]) == 1}
                keys = {(f"#{short}", "")} if short else {(i + d, r) for i, r in rests.items() for d in variant_keys(r)}
                rows += [(company, line, legal, t, *k) for k in keys]
            yield pd.DataFrame(rows, columns=["company", "line", "legal", "tokens", "key", "rest"])

    def offered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for root, line, legal, n, tokens in zip(b["root"], b["line"], b["legal"], b["n"], b["tokens"]):
                t = list(tokens)
                keys = set()
                if len(t) > 1:
                    rests = {(t[i][0] + "|", "".join(t[:i] + t[i + 1 :])) for i in range(len(t)) if len(t[i]) > 1}
                    keys = {(i + d, r) for i, r in rests for d in variant_keys(r)}
                first = "".join(w[0] for w in t)
                more = "".join(w[0] for w in line.split())
                keys |= {(f"#{x}{y}", "") for x in {first, first + more} for y in ("", "v", "vn") if len(x + y) > 1}
                rows += [(root, line, legal, n, t, *k) for k in keys]
            yield pd.DataFrame(rows, columns=["root", "line", "legal", "n", "tokens", "key", "rest"])

    @F.pandas_udf("boolean")
    def assigned(a: pd.Series, b: pd.Series, rest_a: pd.Series, rest_b: pd.Series) -> pd.Series:
        return pd.Series([near(p, q) or aligned(list(x), list(y), initials=True) for x, y, p, q in zip(a, b, rest_a, rest_b)])

    ask = names.where("short <> '' OR initial").select("company", "tokens", "line", "legal", "short").mapInPandas(
        wanted, "company string, line string, legal string, tokens array<string>, key string, rest string"
    )
    offer = known.mapInPandas(offered, "root string, line string, legal string, n long, tokens array<string>, key string, rest string").distinct()
    fits = (
        ask.alias("a").join(offer.alias("o"), "key")
        .where("(a.line = '' OR o.line = '' OR a.line = o.line) AND (a.legal = '' OR o.legal = '' OR a.legal = o.legal)")
        .where(F.col("a.rest").eqNullSafe(F.col("o.rest")) | assigned("a.tokens", "o.tokens", "a.rest", "o.rest"))
        .select(
            "a.company", "o.root", "o.line", "o.n",
            # the same rest before any misspelt one
            ((F.col("a.rest") == F.col("o.rest")).cast("int") * 4 + (F.col("a.line") == F.col("o.line")).cast("int") * 2 + (F.col("a.legal") == F.col("o.legal")).cast("int")).alias("fit"),
        )
        .groupBy("company", "root", "line")
        .agg(F.max("fit").alias("fit"), F.max("n").alias("n"))
    )
    best = fits.withColumn("top", F.max("fit").over(W.partitionBy("company"))).where("fit = top")
    # several that fit alike: none, unless one is spelt far more often
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("company").orderBy(F.desc("n"), "root", "line"))).where("rank <= 2")
    return (
        ranked.groupBy("company")
        .agg(F.max(F.struct("n", "root", "line")).alias("top"), F.min("n").alias("second"), F.count("*").alias("many"))
        .where((F.col("many") == 1) | (F.col("top.n") >= 4 * F.col("second")))
        .select("company", "top.root", "top.line")
    )


def organisations(companies: DataFrame) -> DataFrame:
    """(company, root, line): every different non-blank spelling with its organisation, named by brand and line.

    companies: column company, repeats and nulls allowed. A spelling that fits
    several organisations alike stands by itself.
    """
    distinct = companies.select("company").where(F.col("company").rlike(r"(?U)\S")).distinct()
    names = cut_lineage(read_names(distinct))
    roots = brand_roots(names)
    full = names.where("short = '' AND NOT initial").join(roots, "brand")
    # lines of a brand, as it is spelt and under its root, with the legal form of their firm
    def lines_of(key: str) -> DataFrame:
        each = full.where("line <> ''").groupBy(key, "line").agg(F.max("legal").alias("form"))
        return each.groupBy(key).agg(F.collect_list(F.struct("line", "form")).alias(f"{key}_lines"))

    def only(lines: str) -> F.Column:
        fit = F.filter(lines, lambda x: (x["form"] == F.col("legal")) | (x["form"] == "") | (F.col("legal") == ""))
        return F.when(F.size(fit) == 1, F.element_at(fit, 1)["line"])

    placed = full.join(lines_of("root"), "root", "left").join(lines_of("brand"), "brand", "left").select(
        "company", "root", "tokens", "legal",
        F.when(F.col("line") != "", F.col("line")).otherwise(F.coalesce(only("brand_lines"), only("root_lines"), F.lit(""))).alias("line"),
    )
    placed = cut_lineage(placed)
    known = placed.groupBy("root", "line", "tokens").agg(F.max("legal").alias("legal0")).join(
        placed.groupBy("root", "line").agg(F.count("*").alias("n"), F.max("legal").alias("legal")), ["root", "line"]
    ).select("root", "line", "legal", "n", "tokens")
    attached = cut_lineage(_attach(names, known))
    # words in capitals that nobody spells otherwise: the initials of a full name if one fits, else a brand of their own
    lone = placed.join(names.select("company", "capitals"), "company").groupBy("root").agg(F.min("capitals").alias("c")).where("c").select("root")
    asking = names.where("capitals").join(placed.join(lone, "root", "left_semi").select("company"), "company", "left_semi").withColumn("short", F.col("brand"))
    moved = cut_lineage(_attach(asking, known.join(lone, "root", "left_anti")))
    alone = names.where("short <> '' OR initial").join(attached.select("company"), "company", "left_anti")
    return (
        placed.select("company", "root", "line").join(moved.select("company"), "company", "left_anti")
        .unionByName(moved)
        .unionByName(attached)
        .unionByName(alone.select("company", F.concat(F.lit("?"), "brand").alias("root"), F.concat_ws("/", "line", "legal").alias("line")))
    )


def members(companies: DataFrame) -> DataFrame:
    """(company, organisation): one row per spelling, with the smallest spelling of its organisation; nulls and blanks are left out."""
    o = cut_lineage(organisations(companies))
    first = o.groupBy("root", "line").agg(F.min("company").alias("organisation"))
    return o.join(first, ["root", "line"]).select("company", "organisation")


def same_organisation(companies: DataFrame) -> DataFrame:
    """(company_a, company_b): every pair of different spellings of one organisation, company_a the smaller in code points.

    Nulls and blank values are left out, repeated rows count once, an empty
    table gives no pairs.
    """
    o = cut_lineage(organisations(companies))
    other = o.select(F.col("company").alias("company_b"), "root", "line")
    return (
        o.withColumnRenamed("company", "company_a").join(other, ["root", "line"]).where("company_a < company_b").select("company_a", "company_b")
    )
