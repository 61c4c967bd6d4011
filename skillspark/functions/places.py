"""Places, seniority and experience from free text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillspark.functions.text import strip_accents

#: Cities in order of precedence with the words that name them.
CITIES = {
    "Hà Nội": ("ha noi", "hanoi"), "TP Hồ Chí Minh": ("ho chi minh", "hcm", "sai gon", "saigon", "thu duc"), "Đà Nẵng": ("da nang", "danang"), "Hải Phòng": ("hai phong",),
    "Cần Thơ": ("can tho",), "Bình Dương": ("binh duong",), "Đồng Nai": ("dong nai", "bien hoa"), "Bắc Ninh": ("bac ninh",), "Bắc Giang": ("bac giang",),
    "Hưng Yên": ("hung yen",), "Hải Dương": ("hai duong",), "Quảng Ninh": ("quang ninh", "ha long"), "Vĩnh Phúc": ("vinh phuc",), "Thái Nguyên": ("thai nguyen",),
    "Thanh Hoá": ("thanh hoa",), "Nghệ An": ("nghe an",), "Thừa Thiên Huế": ("thua thien", "hue"), "Khánh Hoà": ("khanh hoa", "nha trang"),
    "Bà Rịa - Vũng Tàu": ("ba ria", "vung tau"), "Long An": ("long an",), "Tiền Giang": ("tien giang", "my tho"), "Lâm Đồng": ("lam dong", "da lat"), "Bình Định": ("binh dinh", "quy nhon"),
}
#: Provinces of a feed by number.
PROVINCES = {73: "Hà Nội", 84: "Thái Nguyên", 90: "Bắc Ninh", 104: "Đà Nẵng", 120: "Đồng Nai", 122: "TP Hồ Chí Minh", 131: "Cần Thơ"}
#: Words of work from anywhere, and the city it is given.
REMOTE, REMOTE_CITY = ("anywhere", "remote", "work from home", "lam tu xa"), "Làm từ xa"
#: Places that are city and country.
CITY_STATES = ("Singapore", "Hong Kong", "Macau", "Luxembourg", "Monaco")
#: Postal codes of states.
US_STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()
#: Levels in order of precedence with the words of a title that show them.
LEVELS = {
    "Thực tập sinh": ("intern", "thuc tap", "fresher", "moi tot nghiep"),
    "Quản lý": ("manager", "truong phong", "giam doc", "director", "head of", "truong bo phan"),
    "Trưởng nhóm": ("team lead", "leader", "truong nhom", "tech lead", "principal"),
    "Cao cấp": ("senior", "sr.", "chuyen gia", "expert"),
    "Mới vào nghề": ("junior", "jr."),
}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(_any(text, words), F.lit(name)) for name, words in table.items()])


def vn_city(x: Column | str) -> Column:
    """The first city of the table that a text names, else null."""
    return _let(strip_accents(x), lambda t: _first(t, CITIES))


def is_remote(x: Column | str) -> Column:
    return _let(strip_accents(x), lambda t: _any(t, REMOTE))


def vietnam_city(location: Column, province_id: Column, address: Column) -> Column:
    """City of a domestic posting: remote, the place of work, the province, the contact address."""
    provinces = F.create_map(*[F.lit(v) for pair in PROVINCES.items() for v in pair])
    remote = is_remote(location) | is_remote(address)
    return F.when(remote, F.lit(REMOTE_CITY)).otherwise(F.coalesce(vn_city(location), F.element_at(provinces, F.coalesce(province_id, F.lit(-1))), vn_city(address)))


def foreign_place(location: Column, hint: Column) -> Column:
    """struct(city, country) of a foreign posting; a place that names a US state overrules the hinted country."""
    place = lambda city, country: F.struct(city.cast("string").alias("city"), country.cast("string").alias("country"))
    hinted = F.nullif(hint, F.lit(""))
    head = F.nullif(F.trim(F.element_at(F.split(location, ","), 1)), F.lit(""))
    tail = F.trim(F.element_at(F.split(location, ","), -1))
    dashed = F.split(location, " - ", 2)
    none = F.lit(None)
    return (
        F.when(F.coalesce(location, F.lit("")) == "", place(none, hinted))
        .when(is_remote(location), place(F.lit(REMOTE_CITY), none))
        .when(location.contains(",") & tail.isin(*US_STATES), place(head, F.lit("United States")))
        .when(location.contains(","), place(head, F.coalesce(hinted, F.nullif(tail, F.lit("")))))
        .when(location.contains(" - "), place(F.nullif(F.trim(F.element_at(dashed, 1)), F.lit("")), F.coalesce(hinted, F.nullif(F.trim(F.element_at(dashed, 2)), F.lit("")))))
        .when(location.isin(*CITY_STATES), place(location, F.coalesce(hinted, location)))
        .otherwise(place(none, location))
    )


def city_country(location: Column, source: Column, hint: Column, province_id: Column, address: Column) -> Column:
    """struct(city, country) by the rules of the feed."""
    home = F.struct(vietnam_city(location, province_id, address).alias("city"), F.lit("Việt Nam").alias("country"))
    return F.when(source == "data_jobs", foreign_place(location, hint)).otherwise(home)


def months_experience(level: Column) -> Column:
    """The number in `37 months` at the start of a text."""
    return F.nullif(F.regexp_extract(F.coalesce(level, F.lit("")), r"^(\d+)\s*months?", 1), F.lit("")).try_cast("int")


def seniority(title: Column, months: Column) -> Column:
    """Level by words of the title, else by months of experience."""
    by_months = F.when(months >= 60, "Cao cấp").when(months >= 24, "Có kinh nghiệm").when(months.isNotNull(), "Mới vào nghề")
    return F.coalesce(_let(strip_accents(title), lambda t: _first(t, LEVELS)), by_months)
