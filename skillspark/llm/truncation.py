"""Problem 10: texts that were cut at a field's limit or on the way.

The finished sentences of the corpus give a vocabulary, held as the nodes of a
trie (a table of all prefixes), and for the last two and three words how often
a sentence ends there and how often it goes on. An unfinished end of a text is
a break if its last word is no word but a proper prefix of known words, if
sentences never end with its last words, or if these rarely end a sentence and
the text has a length at which its source cuts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillspark.session import cut_lineage

#: A word of the vocabulary is seen so often in finished sentences.
MIN_WORD = 2
#: A source cuts at a length if so many of its texts have it, and so large a part of those at least as long.
LIMIT_TEXTS, LIMIT_SHARE = 5, 0.25
#: Last words that end a sentence in fewer than this share of cases are a break at a source's limit or before a mark of omission.
RARE_END = 0.5
#: Where sentences end with a smaller probability the end is a break.
NEVER_END = 0.015
#: The last word is the beginning of another if that follows the word before so often, and so many times as often as the last word itself.
LONGER, LONGER_TIMES = 5, 20
#: A shorter context counts as so many cases of the longer one; unknown words end a sentence with this probability.
BACKOFF, PRIOR_END = 2.0, 0.2
#: A closing line (digits aside) ends at least this share of all texts, and so many; texts that are alike before the line count once.
CLOSING_SHARE, CLOSING_TEXTS = 0.001, 8

#: Different sentences that a task holds before it hands their counts on.
FLUSH = 50_000
#: A closing line is shorter.
MAX_CLOSING = 200

#: Last words of closing lines after which dots leave nothing out (fixed values).
AND_SO_ON = ("etc", "v.v", "vv")

#: Prefixes of words are tabulated up to so many letters; longer ones are compared with the words that share so many.
LONG_WORD = 64

#: Longer than any mark behind a text; several marks are taken off one after the other.
TAIL = 160

_TOKEN = re.compile(r"[^\W_]+(?:[.+#/&'’\-][^\W_]+)*[+#]*")
_TAG = re.compile(r"<(/?)(br|p|div|li|ul|ol|tr|td|h\d|b|i|u|em|strong|span|a)\b[^<>]*>", re.I)
_HALF_TAG = re.compile(r"<[/a-z]?[a-z0-9 =\"'/]{0,20}$", re.I)
_HALF_ENTITY = re.compile(r"&(?:#?\w{0,8})$")
#: Marks of omission (fixed values): what portals put after a cut text.
_OMITTED = re.compile(r"(?:\s*(?:…|\.{3,}|(?<=\w)\.\.|\[(?:\.{3}|…|xem thêm|xem them|xem tiếp|more|read more|đọc tiếp|see more|continued)\]|\((?:\.{3}|…|more|xem thêm|xem tiếp|cont(?:inued|\.)?|còn tiếp)\)|(?:read more|xem thêm|xem tiếp|đọc tiếp|see more)\s*[»>]*|[»>]+))+\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+")
_BULLET = re.compile(r"^\s*(?:[-–—*•·+▪◦●■➢>]+|\(?\d{1,3}[.)])\s+")
_DIGITS = re.compile(r"\d+")
_FINISHED = re.compile(r"[.!?:;)\]}\"”»]$")
_OPEN = re.compile(r"(?:[,(/&–—\-•*+]|\[|“)$")


def plain_lines(text: str) -> tuple[list[str], bool]:
    """The non-blank lines of a text without markup, and whether it ends in half a tag, an entity, half a character or a mark of omission."""
    t = unicodedata.normalize("NFC", text)
    if "<" in t:
        t = _TAG.sub(lambda m: "\n" if m[2].lower() not in ("b", "i", "u", "em", "strong", "span", "a") else "", t)
    t = t.rstrip()
    torn = False
    while True:  # half markup may stand behind whole markup and marks of omission
        end = t[-TAIL:]  # these patterns match at the end only
        short = _HALF_ENTITY.sub("", _HALF_TAG.sub("", end.rstrip("�").rstrip())).rstrip()
        short = _OMITTED.sub("", short)
        if short == end:
            break
        t, torn = (t[:-TAIL] + short).rstrip(), True
    return [x.strip() for x in (html.unescape(t) if "&" in t else t).split("\n") if x.strip()], torn


def words(sentence: str) -> list[str]:
    """Lower-case words, digits masked, behind the mark of a sentence's start."""
    if mark := _BULLET.match(sentence):
        sentence = sentence[mark.end() :]
    return ["<s>", *_TOKEN.findall(_DIGITS.sub("0", sentence.lower()))]


def finished(lines: list[str]) -> Iterator[str]:
    """The sentences that are not the unfinished end of the text."""
    for k, line in enumerate(lines):
        parts = _SENTENCE.split(line)
        if k == len(lines) - 1 and not _FINISHED.search(parts[-1]):
            parts.pop()
        yield from parts


def _key(kind: int, *parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join((str(kind), *parts))) - (1 << 63)


def _contexts(w: list[str]) -> list[tuple]:
    """The last three, two and one words."""
    return [(3, *w[-3:]), (2, *w[-2:]), (1, w[-1])]


def closing_pattern(line: str) -> str:
    return _DIGITS.sub("0", line.lower())


#: Marks the rows of corpus_counts that hold closing lines.
CLOSING = "\x1e"


#: What is read of the texts: counts of words and contexts (no end), and the unfinished ends.
READ = "is_end boolean, word string, key long, ends long, mids long, doc_id long, source string, n_chars long, n_bytes long, torn boolean, open boolean, closing string, last string, tri long, bi long, uni long, stem long"
_NAMES = [part.split()[0] for part in READ.split(", ")]


def _frame(size: int, **columns: object) -> pd.DataFrame:
    """Rows of READ, all other columns null."""
    return pd.DataFrame({c: columns.get(c, pd.Series([None] * size, dtype="object")) for c in _NAMES})


def _end(lines: list[str], torn: bool, text: str) -> tuple | None:
    """(n_chars, n_bytes, torn, open, closing, last, tri, bi, uni, stem) of an unfinished end.

    open: the end is a sign that asks for more; closing: the pattern of its line.
    """
    if not lines or _FINISHED.search(lines[-1]):
        return None
    w = words(_SENTENCE.split(lines[-1])[-1])
    sign = bool(_OPEN.search(lines[-1]))
    head = len(text), len(text.encode()), torn, sign, closing_pattern(lines[-1]) if len(lines[-1]) < MAX_CLOSING else None
    if len(w) > 1:
        return *head, w[-1], *(_key(*t) for t in _contexts(w)), _key(4, *w[-2:])
    return (*head, "", 0, 0, 0, 0) if sign else None


def read_texts(documents: DataFrame) -> DataFrame:
    """READ of documents(doc_id, source, text), each text read once.

    Rows with a word alone count it, rows with a key alone how often a context
    ends a sentence or goes on. Rows with both hold a last line and a key of the
    text before it. Keys of kind 4 are a word with a proper prefix of the word
    that follows it: the nodes of the tries of followers. Equal sentences of a
    task are counted first and taken apart once.
    """

    def rows(sentences: Counter, closings: Counter) -> pd.DataFrame:
        number: dict[str, int] = {"<s>": 0}
        taken = [[number.setdefault(x, len(number)) for x in words(s)] for s in sentences]
        sizes = np.array([len(t) for t in taken], dtype=np.int64)
        ids = np.fromiter(chain.from_iterable(taken), dtype=np.int64, count=int(sizes.sum()))
        names = list(number)
        times = np.repeat(np.fromiter(sentences.values(), dtype=np.int64, count=len(sentences)), sizes)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in the sentence
        last = at == np.repeat(sizes - 1, sizes)
        k = np.flatnonzero(at > 0)
        out: list[tuple] = []

        def tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """An example of each code, its number, and how often it stands at an end and before."""
            _, example, inverse = np.unique(codes, return_index=True, return_inverse=True)
            ends = np.bincount(inverse, weights=times[k] * last[k], minlength=len(example)).astype(np.int64)
            mids = np.bincount(inverse, weights=times[k] * ~last[k], minlength=len(example)).astype(np.int64)
            return k[example], inverse, ends, mids

        if len(k):
            one, _, ends1, mids1 = tally(ids[k])
            two, pair, ends2, mids2 = tally(ids[k - 1] * len(names) + ids[k])
            before = np.where(at[k] > 1, ids[k - 2] + 1, 0)  # 0: the sentence has no third word from here
            three, _, ends3, mids3 = tally(before * (int(pair.max()) + 1) + pair)
            for i, e, m in zip(one.tolist(), ends1.tolist(), mids1.tolist()):
                out += [(names[ids[i]], None, e + m, 0), (None, _key(1, names[ids[i]]), e, m)]
            for i, e, m in zip(two.tolist(), ends2.tolist(), mids2.tolist()):
                x, y = names[ids[i - 1]], names[ids[i]]
                out.append((None, _key(2, x, y), e, m))
                out += [(None, _key(4, x, y[:n]), 0, e + m) for n in range(1, min(len(y), LONG_WORD + 1))]
            for i, e, m in zip(three.tolist(), ends3.tolist(), mids3.tolist()):
                out.append((None, _key(3, *(names[j] for j in ids[max(i - 2, i - int(at[i])) : i + 1])), e, m))
        out += [(CLOSING + x, rest, n, 0) for (x, rest), n in closings.items()]
        word, key, end, mid = zip(*out) if out else ((), (), (), ())
        # a plain column of keys and nulls would turn into floats
        return _frame(
            len(out), is_end=False, word=pd.Series(word, dtype="object"), key=pd.array(key, dtype="Int64"), ends=pd.Series(end, dtype="int64"), mids=pd.Series(mid, dtype="int64")
        )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sentences: Counter = Counter()
        closings: Counter = Counter()
        for b in batches:
            found = []
            for i, source, text in zip(b["doc_id"], b["source"], b["text"]):
                if not text:
                    continue
                lines, torn = plain_lines(text)
                sentences.update(finished(lines))
                if len(lines) > 1 and len(lines[-1]) < MAX_CLOSING:
                    closings[closing_pattern(lines[-1]), _key(5, closing_pattern("\n".join(lines[:-1])))] += 1
                if end := _end(lines, torn, text):
                    found.append((i, source, *end))
            yield _frame(len(found), is_end=True, **dict(zip(_NAMES[5:], map(list, zip(*found)))))
            if len(sentences) + len(closings) > FLUSH:
                yield rows(sentences, closings)
                sentences, closings = Counter(), Counter()
        yield rows(sentences, closings)

    return documents.select("doc_id", "source", "text").mapInPandas(read, READ)


def trie_nodes(vocabulary: DataFrame) -> DataFrame:
    """(node, is_word, leads_on) of the trie of vocabulary(word): every prefix of up to LONG_WORD letters, whether it is a word, whether longer words begin with it."""
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(LONG_WORD))), lambda n: F.struct(F.substring("word", F.lit(1), n).alias("node"), n.alias("n")))
    every = vocabulary.select("word", F.explode(prefixes).alias("p")).select("p.node", (F.col("p.n") == F.length("word")).alias("whole"))
    return every.groupBy("node").agg(F.max("whole").alias("is_word"), F.max(~F.col("whole")).alias("leads_on"))


def in_trie(lasts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(last, is_word, leads_on) of the different lasts(last) that are words or beginnings of words of vocabulary(word)."""
    stem = lambda c: F.substring(c, 1, LONG_WORD)
    some = lasts.select("last").distinct()
    short = some.join(trie_nodes(vocabulary), F.col("last") == F.col("node")).select("last", "is_word", "leads_on")
    words = vocabulary.where(F.length("word") > LONG_WORD).select("word", stem("word").alias("stem"))
    long = some.where(F.length("last") > LONG_WORD).withColumn("stem", stem("last")).join(words, "stem").where(F.col("word").startswith(F.col("last")))
    same = F.col("word") == F.col("last")
    return short.unionByName(long.groupBy("last").agg(F.max(same).alias("is_word"), F.max(~same).alias("leads_on")))


def source_limits(documents: DataFrame) -> DataFrame:
    """(source, unit, size): lengths, in characters and in bytes, at which a source cuts."""
    sizes = documents.select(
        F.coalesce("source", F.lit("")).alias("source"),
        F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").cast("long").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").cast("long").alias("size")))).alias("x"),
    ).select("source", "x.unit", "x.size")
    counted = sizes.groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    longer = W.partitionBy("source", "unit").orderBy(F.col("size").desc())
    return (
        counted.withColumn("at_least", F.sum("n").over(longer.rowsBetween(W.unboundedPreceding, 0)))
        .where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_SHARE * F.col("at_least")))
        .select("source", "unit", "size")
    )


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source): the documents(doc_id, source, text) whose text breaks off inside a word or a sentence.

    Null, blank and wordless texts are whole, and so are texts that end with a
    finished sentence or a line as sentences of the corpus end, with or without
    a full stop. A closing line does not excuse half markup, a length at which
    the source cuts or the beginning of a word. Extra columns are ignored;
    repeated texts count as often as they stand.
    """
    documents = documents.select("doc_id", "source", "text").where("text IS NOT NULL AND text <> ''")
    read = cut_lineage(read_texts(documents))
    counts = cut_lineage(read.where("NOT is_end").groupBy("word", "key").agg(F.sum("ends").alias("ends"), F.sum("mids").alias("mids")))
    vocabulary = counts.where(F.col("word").isNotNull() & ~F.col("word").startswith(CLOSING) & (F.col("ends") >= MIN_WORD)).select("word")
    contexts = counts.where("word IS NULL").select("key", "ends", "mids")
    # lines that close at least CLOSING_SHARE of all texts, so at most 1 / CLOSING_SHARE
    least = max(CLOSING_TEXTS, CLOSING_SHARE * documents.count())
    lines = counts.where(F.col("word").startswith(CLOSING)).groupBy("word").agg(F.count("*").alias("texts"))
    closing = lines.where(F.col("texts") >= least).select("word").collect()
    closes = F.coalesce(F.col("closing").isin([r["word"][1:] for r in closing]), F.lit(False)) if closing else F.lit(False)
    ends = read.where("is_end").select("doc_id", "source", "n_chars", "n_bytes", "torn", "open", closes.alias("closing"), "last", "tri", "bi", "uni", "stem")
    # the same ends come again and again: each is judged once
    known = ends.where(~F.col("open")).select("last", "tri", "bi", "uni", "stem").distinct()
    known = cut_lineage(known)
    known = known.join(in_trie(known, vocabulary), "last", "left")
    p = F.lit(PRIOR_END)
    for kind in ("uni", "bi", "tri"):
        level = contexts.select(F.col("key").alias(kind), F.col("ends").alias(f"e_{kind}"), F.col("mids").alias(f"m_{kind}"))
        known = known.join(level, kind, "left")
        e, m = (F.coalesce(f"{x}_{kind}", F.lit(0)) for x in "em")
        p = (e + BACKOFF * p) / (e + m + BACKOFF)
    known = known.join(contexts.select(F.col("key").alias("stem"), F.col("mids").alias("longer")), "stem", "left").withColumn("p", p)
    no_word = ~F.coalesce("is_word", F.lit(False)) & F.coalesce("leads_on", F.lit(False))
    as_is = F.coalesce("e_bi", F.lit(0)) + F.coalesce("m_bi", F.lit(0))
    begun = (F.coalesce("longer", F.lit(0)) >= LONGER) & (as_is * LONGER_TIMES <= F.col("longer"))
    never = F.coalesce("e_bi", F.lit(0)) == 0
    in_word = never & (no_word | begun)
    judged = known.select(
        "last", "tri", "bi", (in_word | (F.col("p") < NEVER_END)).alias("breaks"), (F.col("p") < RARE_END).alias("doubtful"), (never & no_word).alias("prefix")
    )
    limits = source_limits(documents)
    at_limit = (
        ends.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("size")))).alias("x"))
        .select("doc_id", "source", "x.unit", "x.size")
        .join(limits, ["source", "unit", "size"], "left_semi")
        .select("doc_id", F.lit(True).alias("cut"))
        .distinct()
    )
    return (
        ends.join(judged.where("breaks OR doubtful"), ["last", "tri", "bi"], "left")
        .join(at_limit, "doc_id", "left")
        .where("open OR breaks OR (doubtful AND (torn OR cut))")
        .where(f"NOT closing OR cut OR prefix OR (torn AND NOT last IN {AND_SO_ON})")
        .select("doc_id", "source")
        .distinct()
    )


def truncation_report(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(source, n_docs, n_truncated, share) for every source."""
    total = documents.groupBy("source").agg(F.count("*").alias("n_docs"))
    cut = found.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    return total.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "n_docs", F.coalesce("n", F.lit(0)).alias("n_truncated"), (F.coalesce("n", F.lit(0)) / F.col("n_docs")).alias("share")
    )
