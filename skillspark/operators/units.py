"""Problem 6: amounts of pay in one unit, from texts that state them in many.

The text between numbers is segmented by dynamic programming over a trie of
unit words: magnitudes (prefixes of the unit), currencies (its roots) and times
with their divisors (its exponents), beside words that tell what a number
counts. A skipped letter costs much, and a reading costs less the likelier its
dimension is in a pay field. A small grammar then gives every number its unit.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dimensions of a segment; the priors are costs per segment in a pay field.
MAGNITUDE, CURRENCY, PER, TIME, RATE, RANGE, STOP, SIDE, COUNT, PLAIN = (
    "magnitude", "currency", "per", "time", "rate", "range", "stop", "side", "count", "plain",
)
PRIORS = {MAGNITUDE: 0.2, CURRENCY: 0.2, PER: 0.3, TIME: 0.3, RATE: 0.25, RANGE: 0.3, STOP: 0.3, SIDE: 0.4, COUNT: 0.4, PLAIN: 0.5}
SKIPPED_LETTER, SKIPPED_SIGN, SKIPPED_WORD = 2.0, 0.6, 3.0

# Unit words in lower case, without respect to accents where they are also typed without.
MAGNITUDES = {
    "k": 1e3, "thousand": 1e3, "m": 1e6, "mil": 1e6, "mio": 1e6, "mln": 1e6, "million": 1e6, "millions": 1e6, "bn": 1e9, "billion": 1e9, "万": 1e4, "千": 1e3, "億": 1e8,
}
#: Vietnamese magnitude words; they mean VND where no currency is named.
LOCAL_MAGNITUDES = {
    "nghìn": 1e3, "nghin": 1e3, "ngàn": 1e3, "ngan": 1e3, "ng": 1e3, "trăm": 1e2, "tr": 1e6, "triệu": 1e6, "trieu": 1e6, "củ": 1e6, "chai": 1e6, "lít": 1e5, "tỷ": 1e9, "tỉ": 1e9, "ty": 1e9, "ti": 1e9,
}
CURRENCIES = {
    "vnd": "VND", "vnđ": "VND", "đồng": "VND", "dong": "VND", "đ": "VND", "₫": "VND", "usd": "USD", "us$": "USD", "$": "USD", "đô la": "USD", "đô": "USD", "do la": "USD", "dollar": "USD", "dollars": "USD", "mỹ kim": "USD", "eur": "EUR", "euro": "EUR", "euros": "EUR", "€": "EUR", "jpy": "JPY", "yen": "JPY", "yên": "JPY", "円": "JPY", "¥": "JPY", "sgd": "SGD", "s$": "SGD",
}
TIMES = {
    "hour": "hour", "hours": "hour", "hr": "hour", "hrs": "hour", "h": "hour", "giờ": "hour", "gio": "hour", "時間": "hour", "day": "day", "days": "day", "ngày": "day", "ngay": "day", "week": "week", "weeks": "week", "wk": "week", "tuần": "week", "tuan": "week", "month": "month", "months": "month", "mo": "month", "mth": "month", "tháng": "month", "thang": "month", "th": "month", "月": "month", "year": "year", "years": "year", "yr": "year", "yrs": "year", "năm": "year", "nam": "year", "年": "year",
}
RATES = {
    "hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "annually": "year", "yearly": "year", "annual": "year", "annum": "year", "p.a.": "year", "p.a": "year", "pa": "year", "p.m.": "month", "per annum": "year",
}
PERS = ("/", "per", "mỗi", "moi", "một", "mot", "a", "an", "each", "every", "hàng", "hằng")
RANGES = ("-", "–", "—", "−", "~", "〜", "～", "to", "đến", "den", "tới", "toi", "and", "và", "từ", "from", "between")
STOPS = ("+", ";", ",", "(", ")", ":", "|", "\n")
#: What follows these is beside the pay: bonus, trial time, leave, hours.
SIDES = (
    "thưởng", "thuong", "bonus", "hoa hồng", "commission", "thử việc", "thu viec", "probation", "phép", "nghỉ", "leave", "off", "holiday", "holidays", "phụ cấp", "allowance", "kinh nghiệm", "experience", "ca", "shift", "tăng ca", "overtime",
)
COUNTS = ("%", "lần", "tiếng", "người", "times", "people", "st", "nd", "rd", "ngày phép", "tuổi", "x")
PLAINS = (
    "lương", "luong", "salary", "mức lương", "thu nhập", "cứng", "up", "upto", "lên", "max", "max.", "min", "trên", "dưới", "trở lên", "khoảng", "net", "gross", "cơ bản", ">", "<", "=", ">=", "<=", ".", "about", "over", "under", "attractive", "income", "pay", "range", "base",
)
#: Number words of the tens and ones.
NUMBER_WORDS = {
    "không": 0, "một": 1, "mốt": 1, "hai": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "lăm": 5, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9, "mười": 10, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
TENS = ("mươi", "hundred", "trăm")

_TAG = re.compile(r"<[^<>]*>")
_BLANK = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_WORD = re.compile(r"[^\W\d_]+")


def _lexicon() -> dict[str, list[tuple[str, object]]]:
    words: dict[str, list[tuple[str, object]]] = {}

    def put(kind: str, items) -> None:
        for w, v in items.items() if isinstance(items, dict) else ((x, x) for x in items):
            words.setdefault(unicodedata.normalize("NFC", w), []).append((kind, v))

    put(MAGNITUDE, {w: (v, False) for w, v in MAGNITUDES.items()} | {w: (v, True) for w, v in LOCAL_MAGNITUDES.items()})
    for kind, items in ((CURRENCY, CURRENCIES), (TIME, TIMES), (RATE, RATES), (PER, PERS), (RANGE, RANGES), (STOP, STOPS), (SIDE, SIDES), (COUNT, COUNTS), (PLAIN, PLAINS)):
        put(kind, items)
    return words


def _trie() -> dict:
    root: dict = {}
    for word, readings in _lexicon().items():
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[None] = readings
    return root


TRIE = _trie()


def segment(text: str) -> list[tuple[str, object]]:
    """The cheapest reading of a text between numbers: (dimension, value) in order."""
    n = len(text)
    best: list[tuple[float, int, tuple | None]] = [(0.0, 0, None)] + [(float("inf"), 0, None)] * n

    def offer(j: int, cost: float, i: int, what: tuple | None) -> None:
        if cost < best[j][0]:
            best[j] = (cost, i, what)

    for i in range(n):
        cost = best[i][0]
        c = text[i]
        if cost == float("inf"):
            continue
        if c == " ":
            offer(i + 1, cost, i, None)
            continue
        inside = i > 0 and text[i - 1].isalpha() and c.isalpha()
        node, j = TRIE, i
        while j < n and (node := node.get(text[j])) is not None:
            j += 1
            if None in node:
                # a word that ends inside letters, or begins there, needs another segment beside it
                cut = (0.4 if inside else 0) + (0.4 if j < n and text[j].isalpha() and text[j - 1].isalpha() else 0)
                for kind, value in node[None]:
                    offer(j, cost + PRIORS[kind] + cut, i, (kind, value))
        if c.isalpha():
            if not inside and (m := _WORD.match(text, i)):
                offer(m.end(), cost + SKIPPED_WORD, i, ("word", m[0]))
            offer(i + 1, cost + SKIPPED_LETTER, i, None)
        else:
            offer(i + 1, cost + SKIPPED_SIGN, i, None)
    out, j = [], n
    while j:
        _, i, what = best[j]
        if what:
            out.append(what)
        j = i
    return out[::-1]


def read_number(digits: str) -> float:
    """A number with thousands marks and decimals in either notation."""
    marks = [c for c in digits if c in ".,"]
    if not marks:
        return float(digits)
    last = max(digits.rfind("."), digits.rfind(","))
    tail = digits[last + 1 :]
    whole = re.sub("[.,]", "", digits[:last])
    grouped = len(tail) == 3 and digits[0] != "0" and len(re.split("[.,]", digits)[0]) <= 3
    if len(set(marks)) == 1 and len(marks) > 1 or len(set(marks)) == 1 and grouped:
        return float(re.sub("[.,]", "", digits))
    return float(f"{whole}.{tail}")


def _spelled(text: str) -> str:
    """Number words before a magnitude word, as digits."""

    def one(m: re.Match) -> str:
        total = 0
        for w in re.findall(r"[^\W\d_]+", m[1]):
            total = total * 10 if w in TENS else total + NUMBER_WORDS[w]
        return f"{total} {m[2]}"

    return _SPELLED.sub(one, text)


_NUMBER_WORD = "|".join(sorted(map(re.escape, {*NUMBER_WORDS, "mươi"}), key=len, reverse=True))
_SPELLED = re.compile(rf"\b((?:{_NUMBER_WORD})(?:[ -](?:{_NUMBER_WORD}))*) (triệu|trieu|nghìn|ngàn|tỷ|tỉ|million|thousand|billion)\b")


@lru_cache(maxsize=100_000)
def read_pay(text: str) -> tuple[tuple[float, str | None, str | None], ...]:
    """The amounts of pay a text states: (value, currency or None, period or None)."""
    t = html.unescape(_TAG.sub(" ", text))
    t = _BLANK.sub(" ", unicodedata.normalize("NFKC", t).lower().replace("¥", "¥")).strip()
    t = _spelled(t)
    # stream of tokens: numbers with the unit words around them
    stream: list[tuple[str, object]] = []
    at = 0
    for m in _NUMBER.finditer(t):
        stream += segment(t[at : m.start()])
        # 37tr5: digits glued to a magnitude that is glued to a number are its decimals
        if (
            len(stream) >= 2
            and stream[-1][0] == MAGNITUDE
            and stream[-2][0] == "number"
            and t[m.start() - 1].isalpha()
            and t[at].isalpha()
            and m[0].isdigit()
            and float(stream[-2][1]).is_integer()
        ):
            stream[-2] = ("number", stream[-2][1] + float(f"0.{m[0]}"))
        else:
            stream.append(("number", read_number(m[0])))
        at = m.end()
        if t[at : at + 2] == "th" and not t[at + 2 : at + 3].isalpha() and not t[m.start() - 1 : m.start()] == "/":
            stream.append((COUNT, "th"))
            at += 2
    stream += segment(t[at:])

    amounts: list[dict] = []
    period: str | None = None
    aside = False  # in a clause on something beside the pay
    depth = 0
    used = -1  # last token that belongs to an amount
    for i, (kind, value) in enumerate(stream):
        if kind == STOP:
            depth += (value == "(") - (value == ")")
            aside = False
        elif kind == SIDE:
            aside = True
        elif kind in (TIME, RATE) and not aside and depth <= 0:
            per = kind == RATE or i > 0 and stream[i - 1][0] == PER
            if per and period is None:
                period = value
        elif kind == "number":
            after = [x for x in stream[i + 1 : i + 4]]
            magnitude, local, currency = None, False, None
            k = i + 1
            while k < len(stream) and stream[k][0] in (MAGNITUDE, CURRENCY):
                if stream[k][0] == MAGNITUDE and magnitude is None:
                    magnitude, local = stream[k][1]
                elif stream[k][0] == CURRENCY and currency is None:
                    # $9 ~ $9: a currency right before a number belongs to that one
                    if k + 1 < len(stream) and stream[k + 1][0] == "number":
                        break
                    currency = stream[k][1]
                else:
                    break
                k += 1
            if i > 0 and stream[i - 1][0] == CURRENCY and i - 1 > used:
                currency = currency or stream[i - 1][1]
            follows = after[0][0] if after else None
            money = magnitude is not None or currency is not None
            if aside or depth > 0 or follows == COUNT:
                continue
            if not money and (follows in (TIME, SIDE) or i > 0 and stream[i - 1][0] == TIME):
                continue
            used = k - 1
            amounts.append({"v": value, "m": magnitude, "local": local, "c": currency})
    if not amounts:
        return ()
    if not any(a["c"] or a["local"] for a in amounts):  # 30k - 39k/h VND
        loose = next((v for k, v in stream if k == CURRENCY), None)
        amounts = [a | {"c": loose} for a in amounts]
    out = []
    for j, a in enumerate(amounts):
        near = [b for b in amounts[j + 1 :] + amounts[:j][::-1]]
        if a["m"] is None and a["c"] is None:
            for b in near:  # 9-10 triệu, 3k đến 4.6k $
                if b["m"] is not None or b["c"] is not None:
                    if b["m"] is not None and a["v"] < 1000:
                        a = a | {"m": b["m"], "local": b["local"]}
                    a = a | {"c": b["c"]}
                    break
        elif a["c"] is None and not a["local"]:
            a = a | {"c": next((b["c"] for b in near if b["c"]), None)}
        elif a["m"] is None and a["c"] is not None and a["v"] < 1000:
            later = next((b for b in near if b["m"] is not None and b["c"] in (None, a["c"]) and not b["local"]), None)
            if later:
                a = a | {"m": later["m"]}
        currency = a["c"] or ("VND" if a["local"] else None)
        out.append((a["v"] * (a["m"] or 1), currency, period))
    return tuple(out)


def _small_map(df: DataFrame, key: str, value: str, limit: int = 10_000) -> F.Column:
    """A fixed table of units as a map literal; more than `limit` rows are an error."""
    rows = df.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull()).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a table of units has more than {limit} rows")
    flat = [F.lit(x) for r in rows for x in (r[0], r[1])]
    return F.create_map(*flat) if flat else F.create_map(F.lit(""), F.lit(None))


def annual_pay(records: DataFrame, money: DataFrame, periods: DataFrame, feeds: DataFrame) -> DataFrame:
    """(rec_no, low_vnd_year, high_vnd_year) of the records(rec_no, source, salary_raw) whose text states pay.

    money(currency, vnd_per_unit), periods(pay_period, times_per_year) and
    feeds(source, currency, pay_period) are fixed tables. Null, blank and
    wordy texts, and amounts whose unit neither the text nor the feed tells,
    give no row. Of several amounts the smallest and the largest count.
    """

    @F.pandas_udf("array<struct<v: double, c: string, p: string>>")
    def amounts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"v": v, "c": c, "p": p} for v, c, p in read_pay(t)] if t else [])

    rate, times = _small_map(money, "currency", "vnd_per_unit"), _small_map(periods, "pay_period", "times_per_year")
    feed_c, feed_p = _small_map(feeds, "source", "currency"), _small_map(feeds, "source", "pay_period")
    stated = records.where("salary_raw IS NOT NULL AND salary_raw <> ''").select(
        "rec_no",
        amounts("salary_raw").alias("amounts"),
        F.element_at(feed_c, F.coalesce("source", F.lit(""))).alias("fc"),
        F.element_at(feed_p, F.coalesce("source", F.lit(""))).alias("fp"),
    )
    yearly = F.transform(
        "amounts",
        lambda a: F.round(
            a["v"] * F.element_at(rate, F.coalesce(a["c"], F.col("fc"))) * F.element_at(times, F.coalesce(a["p"], F.col("fp")))
        ).cast("long"),
    )
    return (
        stated.where(F.size("amounts") > 0)
        .select("rec_no", F.array_min(yearly).alias("low_vnd_year"), F.array_max(yearly).alias("high_vnd_year"))
        .where("low_vnd_year IS NOT NULL")
    )
