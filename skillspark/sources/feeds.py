"""Raw feeds: keyword lists, JSON lines, saved pages, and the rule that the newest crawl wins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skillspark.functions.text import BLANKS, html_to_text


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """(keyword): non-blank lines of a text file, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("keyword")).where("keyword <> ''")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, seq): lines of JSON files; seq orders the lines of a file."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("seq")
    ).where(F.trim("line") != "")


def raw_key(source: Column, *ids: Column, row_id: Column) -> Column:
    """source and the first id that is neither null, empty nor 0, else the row number (0 counts there)."""
    usable = [F.when((i.cast("string") != "") & (i.cast("string") != "0"), i.cast("string")) for i in ids]
    return F.concat_ws(":", source, F.coalesce(*usable, row_id.cast("string")))


def line_key(lines: DataFrame) -> DataFrame:
    """lines with their source and raw key."""
    get = lambda k: F.get_json_object("line", f"$.{k}")
    return lines.withColumn("source", get("_source")).withColumn(
        "raw_key", raw_key(get("_source"), get("id"), get("job_key"), get("slug"), row_id=get("_row_id"))
    )


def newest(lines: DataFrame, key: str = "raw_key") -> DataFrame:
    """One row per key: of the last file by name, and there the last line."""
    rest = [c for c in lines.columns if c not in (key, "file", "seq")]
    return lines.groupBy(key).agg(F.max_by(F.struct(*rest, "file"), F.struct("file", "seq")).alias("r")).select(key, "r.*")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first by order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def embedded_json(html: Column, script_id: str = "__NEXT_DATA__", path: str = "$.props.initialState.api.getJobList.data") -> Column:
    """The JSON text at a path of the data a page carries in a script; `{}` where there is none."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), rf'(?is)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1)
    return F.coalesce(F.get_json_object(found, path), F.lit("{}"))


def json_ld_posting(html: Column) -> Column:
    """The first well-formed linked-data block of type JobPosting, as JSON text."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return F.try_element_at(F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == "JobPosting"), F.lit(1))


def ld_location(posting: Column) -> Column:
    """Locality and region of the first place."""
    at = lambda k: F.nullif(F.get_json_object(posting, f"$.jobLocation[0].address.{k}"), F.lit(""))
    return F.nullif(F.concat_ws(", ", at("addressLocality"), at("addressRegion")), F.lit(""))


def ld_salary(posting: Column) -> Column:
    """`amount currency/unit` where the amount is a number."""
    at = lambda k: F.get_json_object(posting, f"$.baseSalary.{k}")
    amount = at("value.value")
    text = F.concat(amount, F.lit(" "), F.coalesce(at("currency"), F.lit("")), F.lit("/"), F.coalesce(at("value.unitText"), F.lit("")))
    return F.when(amount.rlike(r"^([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), F.trim(text))


def ld_months(posting: Column) -> Column:
    return F.get_json_object(posting, "$.experienceRequirements.monthsOfExperience").try_cast("int")


def section(text: Column, start: str, ends: list[str]) -> Column:
    """What stands between a start mark and the nearest end mark behind it; null without start or content."""
    rest = F.substring(text, F.instr(text, start) + len(start), F.length(text))
    cuts = F.array(*[F.when(F.instr(rest, e) > 0, F.instr(rest, e) - 1) for e in ends], F.length(rest))
    return F.when(F.instr(text, start) > 0, F.nullif(F.trim(F.substring(rest, F.lit(1), F.array_min(cuts))), F.lit("")))


class _Cards(HTMLParser):
    """Reads cards of a listing: every element with a class, its texts by the class of the element around them."""

    def __init__(self, card: str, fields: dict[str, str]):
        super().__init__()
        self.card, self.fields = card, fields
        self.out: list[dict] = []
        self.stack: list[tuple[str, set[str]]] = []
        self.depth: int | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        if tag in ("img", "br", "input", "meta", "link", "hr"):
            if self.depth is not None and tag == "img" and a.get("alt"):
                self.out[-1].setdefault("logo_alt", a["alt"].strip())
            return
        self.stack.append((tag, classes))
        if self.depth is None and self.card in classes:
            self.depth = len(self.stack)
            self.out.append({})
        if self.depth is not None and tag == "a" and a.get("href"):
            self.out[-1].setdefault("url", a["href"].split("?")[0])

    def handle_endtag(self, tag):
        while self.stack:
            if self.depth == len(self.stack):
                self.depth = None
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        if self.depth is None or not data.strip():
            return
        for _, classes in reversed(self.stack[self.depth - 1 :]):
            for name, cls in self.fields.items():
                if cls in classes:
                    old = self.out[-1].get(name)
                    self.out[-1][name] = f"{old} {data.strip()}" if old else data.strip()
                    return


def listing_cards(pages: DataFrame, card: str, fields: dict[str, str]) -> DataFrame:
    """(page, pos, url, <fields>) of the cards on pages(page, html); a company without text is the logo's text."""
    schema = "page long, pos int, url string, " + ", ".join(f"{f} string" for f in fields)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["page"], b["html"]):
                parser = _Cards(card, fields)
                parser.feed(html or "")
                for k, c in enumerate(parser.out):
                    if "company" in fields:
                        c.setdefault("company", c.get("logo_alt"))
                    rows.append((page, k, c.get("url"), *(c.get(f) for f in fields)))
            yield pd.DataFrame(rows, columns=["page", "pos", "url", *fields])

    return pages.select("page", "html").mapInPandas(read, schema)


def with_details(listing: DataFrame, details: DataFrame, key: str = "slug", requirements: tuple[str, list[str]] | None = None) -> DataFrame:
    """listing with the fields of its detail pages(key, html); a posting without one keeps its row.

    requirements: the heading of the requirements in a page's text and the headings that may follow.
    """
    ld = json_ld_posting(F.col("html"))
    needs = section(html_to_text("html"), *requirements) if requirements else F.lit(None).cast("string")
    parsed = details.select(key, ld.alias("ld"), needs.alias("requirements")).select(
        key,
        "requirements",
        F.get_json_object("ld", "$.description").alias("description_html"),
        F.get_json_object("ld", "$.datePosted").alias("date_posted"),
        F.get_json_object("ld", "$.validThrough").alias("valid_through"),
        F.get_json_object("ld", "$.employmentType").alias("employment_type"),
        F.get_json_object("ld", "$.industry").alias("industry"),
        F.from_json(F.get_json_object("ld", "$.skills"), "array<string>").alias("skills_ld"),
        ld_months(F.col("ld")).alias("months_experience"),
        ld_location(F.col("ld")).alias("location_ld"),
        ld_salary(F.col("ld")).alias("salary_raw"),
    )
    return listing.join(parsed, key, "left")


def detail_errors(listing: DataFrame, details: DataFrame, key: str = "slug") -> DataFrame:
    """(key, error) of postings of the listing whose detail page is missing or carries no linked data."""
    pages = details.groupBy(key).agg(F.max(json_ld_posting(F.col("html")).isNotNull()).alias("ok"))
    found = listing.select(key).distinct().join(pages, key, "left").where("ok IS NULL OR NOT ok")
    return found.select(key, F.when(F.col("ok").isNull(), "no page").otherwise("no linked data").alias("error"))


def until_empty(pages: DataFrame, empty: Column) -> DataFrame:
    """pages(keyword, page, ...) of every keyword before its first empty one, as a crawl that stops there gives them."""
    first = pages.where(empty).groupBy("keyword").agg(F.min("page").alias("_first"))
    return pages.join(first, "keyword", "left").where("_first IS NULL OR page < _first").drop("_first")


class _Page(InputPartition):
    def __init__(self, keyword: str, page: int):
        self.keyword, self.page = keyword, page


class PagedSource(DataSource):
    """Pages of a source as rows (keyword, page, body).

    Options: `template`, a path or address with {keyword} and {page}, or {offset}
    and {limit} for sources that count rows; `keywords`, a JSON list; `pages`, how
    many at most; `limit`, rows of a page; `total`, the dotted name of the field of
    the first page that tells how many pages there are; `retries` and `wait` for
    failed reads. Each
    page of each keyword is a partition, so pages are read in parallel and a
    lost task reads its page again. A missing page has no row.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "keyword string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.template = options["template"]
        self.keywords = json.loads(options.get("keywords", '[""]'))
        self.pages = int(options.get("pages", 1))
        self.limit, self.total = int(options.get("limit", 100)), options.get("total", "")
        self.retries, self.wait = int(options.get("retries", 3)), float(options.get("wait", 1.0))

    def partitions(self):
        return [_Page(k, p) for k in self.keywords for p in range(1, self._pages_of(k) + 1)]

    def _pages_of(self, keyword: str) -> int:
        """As many pages as the first one says, at most `pages`."""
        if not self.total:
            return self.pages
        for _, _, body in self.read(_Page(keyword, 1)):
            value = json.loads(body)
            for name in self.total.split("."):
                value = value.get(name) if isinstance(value, dict) else None
            return min(self.pages, int(value)) if value is not None else self.pages
        return 0

    def read(self, partition):
        import time
        from urllib.error import HTTPError, URLError
        from urllib.parse import quote
        from urllib.request import Request, urlopen

        remote = "://" in self.template
        place = self.template.format(keyword=quote(partition.keyword) if remote else partition.keyword, page=partition.page, offset=(partition.page - 1) * self.limit, limit=self.limit)
        for attempt in range(self.retries):
            try:
                if remote:
                    with urlopen(Request(place, headers={"User-Agent": "Mozilla/5.0"}), timeout=30) as r:
                        body = r.read().decode("utf-8", "replace")
                else:
                    with open(place, encoding="utf-8") as f:
                        body = f.read()
            except FileNotFoundError:
                return
            except (HTTPError, URLError) as e:
                if getattr(e, "code", 0) == 404:
                    return
                if getattr(e, "code", 0) in (403, 429) or attempt + 1 == self.retries:
                    raise  # blocked, or failed for good: the task fails visibly
                time.sleep(self.wait * 2**attempt)
            else:
                yield partition.keyword, partition.page, body
                return


def read_pages(spark: SparkSession, template: str, words: list[str], pages: int, **options: object) -> DataFrame:
    """Pages of a paged source; options as PagedSource names them."""
    spark.dataSource.register(PagedSource)
    every = {"template": template, "keywords": json.dumps(words), "pages": str(pages)} | {k: str(v) for k, v in options.items()}
    return spark.read.format("paged").options(**every).load()


def page_rows(pages: DataFrame, source: str, schema: str, items: Callable[[Column], Column], limit: int | None = None) -> DataFrame:
    """Items of JSON page bodies, tagged with keyword, source and their place; with limit, the rows of a page, also with their running number `_row_id`."""
    each = pages.select("keyword", "page", F.posexplode(F.from_json(items(F.col("body")), f"array<struct<{schema}>>")).alias("pos", "item"))
    number = [((F.col("page") - 1) * limit + F.col("pos")).cast("long").alias("_row_id")] if limit else []
    return each.select(F.col("keyword").alias("_query"), F.lit(source).alias("_source"), "page", "pos", *number, "item.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """old and new with one row per key, the latest; of equals the new one. To be written under a new path."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_n")]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, "_n")).alias("r")).select(key, "r.*")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))
