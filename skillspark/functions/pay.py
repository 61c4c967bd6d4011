"""The plain reading of a pay text: its numbers, a currency and a period. The unit operator reads far more notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillspark.functions.text import strip_accents

#: Units of the feeds where a text names none.
FEED_UNITS = {"vieclam24h": ("VND", "month"), "itviec": ("USD", "month"), "data_jobs": ("USD", "year")}
#: A pay in dollars from this amount on is taken for one in dong.
LEAST_DONG = 1_000_000


def salary(text: Column, source: Column) -> Column:
    """struct(low, high, currency, period): the smallest and largest number; dollar signs go before words for dong."""
    feed = lambda i: F.coalesce(*[F.when(source == s, F.lit(u[i])) for s, u in FEED_UNITS.items()])
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    low = F.array_min(numbers)
    plain = strip_accents(text)
    dollars = plain.contains("usd") | text.contains("$")
    dong = F.lower(text).rlike("vnd|vnđ|đ|trieu|triệu")
    named = F.when(dollars & (F.coalesce(low, F.lit(0.0)) >= LEAST_DONG), "VND").when(dollars, "USD").when(dong, "VND")
    by_feed = F.when((feed(0) == "USD") & (F.coalesce(low, F.lit(0.0)) >= LEAST_DONG), "VND").otherwise(feed(0))
    filled = F.coalesce(text, F.lit("")) != ""
    return F.struct(low.alias("low"), F.array_max(numbers).alias("high"), F.when(filled, F.coalesce(named, by_feed)).alias("currency"), F.when(filled, feed(1)).alias("period"))
