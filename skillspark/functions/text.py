"""Text functions as native column expressions (no Python in the hot path)."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscore of any script.
_W = r"[\p{L}\p{N}_]"
#: Tokens keep C++, C#, .NET and Node.js whole; free of look-ahead, so RE2 reads it too.
TOKEN = rf"\.?{_W}+(?:[+#.]{_W}+)*[+#]*"
BLANKS = r"(?U)\s+"


def _letters() -> tuple[str, str]:
    """Accented Latin letters and what they are without accents, by the rule of their decomposition."""
    pairs = {"đ": "d"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code).lower()
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(c) == len(plain) == 1 and plain.isascii():
            pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _letters()


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_text(x: Column | str) -> Column:
    """Lower case, blanks collapsed; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), BLANKS, " "))


def strip_accents(x: Column | str) -> Column:
    """Lower case ASCII with blanks collapsed: Đ becomes d, accents go, other signs are kept (C++, C#, .NET)."""
    plain = F.translate(F.lower(F.coalesce(_col(x), F.lit(""))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", ""), r"\s+", " "))


def fold_text(text: str) -> str:
    """strip_accents of one plain text, on the driver."""
    plain = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return " ".join(plain.encode("ascii", "ignore").decode().split())


def compact(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))


#: Signs in names of skills that a slug must tell apart, in order.
SLUG_SIGNS = (("c++", "c-plus-plus"), ("c#", "c-sharp"), ("f#", "f-sharp"), (".net", "-dotnet"), ("&", "-and-"), ("+", "-plus"), ("#", "-sharp"))


def slugify(x: Column | str) -> Column:
    """Lower-case ASCII words joined by hyphens; a name without any becomes `skill`."""
    t = norm_text(x)
    for sign, word in SLUG_SIGNS:
        t = F.replace(t, F.lit(sign), F.lit(word))
    t = F.regexp_replace(F.regexp_replace(strip_accents(t), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("skill"))


def decode_entities(t: Column) -> Column:
    """Named and numeric entities as the signs they mean; unknown ones stay as they are."""
    named = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, " " if code == 0xA0 else chr(code))], F.lit("apos"), F.lit("'"))

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, r"^([a-zA-Z][a-zA-Z0-9]*);", 1)
        decimal, hexadecimal = F.regexp_extract(part, r"^#([0-9]{1,7});", 1), F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(decimal != "", decimal.cast("long")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long"))
        is_sign = (code > 0) & (code <= 0x10FFFF) & ((code < 0xD800) | (code > 0xDFFF))
        sign = F.when(code == 0xA0, " ").when(is_sign, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        found = F.coalesce(sign, F.try_element_at(named, name))
        return F.when(found.isNotNull(), F.concat(found, F.regexp_replace(part, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(t, "&")
    rest = F.transform(F.slice(parts, 2, 2**30), decoded)
    return F.when(t.contains("&"), F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise(t)


def html_to_text(x: Column | str) -> Column:
    """Text nodes joined by blanks, entities decoded; nothing left becomes null."""
    t = F.regexp_replace(_col(x), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    t = decode_entities(F.regexp_replace(t, r"<[^<>]+>", " "))
    return F.nullif(F.trim(F.regexp_replace(t, BLANKS, " ")), F.lit(""))


def tokens(x: Column | str) -> Column:
    """Tokens of a text in order."""
    return F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(TOKEN), F.lit(0))


def search_terms(name: Column | str, aliases: Column | None = None) -> Column:
    """Forms under which a skill is found: as written and without accents, with and without blanks."""
    names = F.array(_col(name)) if aliases is None else F.concat(F.array(_col(name)), F.coalesce(aliases, F.array().cast("array<string>")))
    forms = F.flatten(F.transform(names, lambda n: F.array(norm_text(n), compact(norm_text(n)), strip_accents(n), compact(strip_accents(n)))))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda t: t != "")))


def token_sort(x: Column) -> Column:
    return F.array_join(F.array_sort(F.split(x, " ")), " ")


def similarity(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance / longer length); two empty texts are equal."""
    return F.lit(100.0) * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def similar(a: Column, b: Column, cutoff: float) -> Column:
    """Whether similarity(a, b) >= cutoff; lengths decide first, then a distance that stops at the limit."""
    longer = F.greatest(F.length(a), F.length(b))
    room = F.floor(longer * (1 - cutoff / 100)).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= room) & (F.levenshtein(a, b) <= room)


#: Words of legal forms that stand before a company's own name.
LEGAL_WORDS = (
    "cong", "ty", "cty", "tnhh", "co", "phan", "cp", "mtv", "mot", "thanh", "vien", "lien", "doanh", "tap", "doan", "thuong", "mai", "dich",
    "vu", "dau", "tu", "san", "xuat", "phat", "trien", "giai", "phap", "va", "and", "jsc", "joint", "stock", "company", "corporation",
    "corp", "inc", "ltd", "limited", "group",
)


def company_key(x: Column | str) -> Column:
    """ASCII words of a company without the legal words before its name; a name of legal words only stays."""
    words = F.trim(F.regexp_replace(F.regexp_replace(strip_accents(x), "[^a-z0-9 ]+", " "), " +", " "))
    own = F.trim(F.regexp_replace(F.concat(words, F.lit(" ")), f"^(?:(?:{'|'.join(LEGAL_WORDS)}) )+", ""))
    return F.when(own == "", words).otherwise(own)


def url_query(x: Column | str) -> Column:
    """A text as value in a query string: blanks as plus, tilde as it is."""
    return F.replace(F.replace(F.url_encode(_col(x)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def evidence(text: Column, start: Column, end: Column, window: int = 30) -> Column:
    """The span [start, end) of a text (counted from 0) with up to `window` characters on both sides."""
    low = F.greatest(start - window, F.lit(0))
    return F.trim(F.substring(text, low + 1, end + window - low))
