"""Cleaning of identifiers, languages, years and names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PID_LENGTH = 23
UNKNOWN_LANGUAGE = "un"
#: The forms of a DOI, tried in this order.
DOI_PATTERNS = (
    r"10.\d{4,9}/[-._;()/:A-Z0-9]+$",
    r"10.1002/[^\s]+$",
    r"10.\d{4}/\d+-\d+X?(\d+)\d+<[\d\w]+:[\d\w]*>\d+.\d+.\w+;\d$",
    r"10.1207/[\w\d]+\&\d+_\d+$",
    r"10.\d{4,9}/[-._;()/:a-zA-Z0-9]*",
)
#: What separates places, and the parts of a place.
PLACE_SEPARATORS = (";", ", ", "|", "/", " - ", "- ", " -", ", ", "(", "/")
NAME_SEPARATORS = (",", "|")
#: The licence types.
LICENSE_TYPES = ("by", "by-sa", "by-nc", "by-nc-sa", "by-nd", "by-nc-nd")


def strip(text: Column) -> Column:
    """All Unicode white space, not blanks alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def std_pid_v2(pid: Column) -> Column:
    """The first 23 characters with the first one upper-cased; too short or not starting with s gives an empty text."""
    good = F.lower(pid).startswith("s") & (F.char_length(pid) >= PID_LENGTH)
    return F.when(good, F.concat(F.upper(F.substring(pid, 1, 1)), F.substring(pid, 2, PID_LENGTH - 1))).otherwise("")


def std_pid_v3(pid: Column) -> Column:
    return F.when(F.char_length(pid) >= PID_LENGTH, F.substring(pid, 1, PID_LENGTH)).otherwise("")


def std_doi(text: Column) -> Column:
    """The first form that occurs, upper-cased; null if none does."""
    tried = [F.nullif(F.regexp_extract(text, p.replace("$", r"(?:\n?\z)") if p.endswith("$") else p, 0), F.lit("")) for p in DOI_PATTERNS]
    return F.upper(F.rtrim(F.coalesce(*tried)))


def std_pid_generic(pid: Column) -> Column:
    return F.coalesce(std_doi(pid), F.upper(strip(pid)), F.lit(""))


def std_year(year: Column) -> Column:
    """Year from 1500 to 2100 in the first four characters, else an empty text."""
    first = F.substring(year.cast("string"), 1, 4)
    number = F.when(strip(first).rlike(r"^[+-]?[0-9]{1,4}$"), strip(first)).try_cast("int")
    return F.when(number.between(1500, 2100), number.cast("string")).otherwise("")


#: Deprecated two-letter codes and the ones in use (fixed values of the language subtag registry).
RENEWED = {"in": "id", "iw": "he", "ji": "yi", "jw": "jv", "mo": "ro"}


def language_codes(spark: SparkSession) -> dict[str, str]:
    """Two- and three-letter ISO codes (a fixed list of the JVM) to the shortest code."""
    locale = spark.sparkContext._jvm.java.util.Locale
    codes: dict[str, str] = {}
    for code in locale.getISOLanguages():
        codes[code] = code
        codes[locale.forLanguageTag(code).getISO3Language()] = RENEWED.get(code, code)
    codes |= {old: new for old, new in RENEWED.items() if new in codes}
    return codes | {"esp": "es"}


def _primary(code: Column) -> Column:
    return F.lower(F.element_at(F.split(code, "[-_]"), 1))


def _mapped(code: Column, codes: dict[str, str]) -> Column:
    table = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in sorted(codes.items()))), F.lit(","), F.lit(":"))  # one literal, not one for each code
    return F.try_element_at(table, _primary(code))


def std_language(code: Column, codes: dict[str, str]) -> Column:
    """Primary subtag of a known code; absent, empty or unknown gives ``un``."""
    return F.coalesce(_mapped(code, codes), F.lit(UNKNOWN_LANGUAGE))


def language_iso(code: Column, codes: dict[str, str]) -> Column:
    return F.coalesce(F.when(_mapped(code, codes).isNotNull(), F.element_at(F.split(code, "[-_]"), 1)), F.lit(""))


def _pieces(text: Column, separators: tuple[str, ...]) -> Column:
    for s in separators:
        text = F.replace(text, F.lit(s), F.lit("\x1d"))
    return F.filter(F.transform(F.split(text, "\x1d"), strip), lambda x: x != "")


def split_codes_and_names(text: Column) -> Column:
    """Array of (code, name): two-character pieces are codes. As many codes as names are paired; only codes or only names
    stand alone; anything else gives the original as a name. Blank or absent text gives an empty array."""
    pieces = _pieces(squeeze_spaces(text), PLACE_SEPARATORS)
    codes, names = F.filter(pieces, lambda x: F.char_length(x) == 2), F.filter(pieces, lambda x: F.char_length(x) != 2)
    none = F.lit(None).cast("string")

    def pair(code: Column, name: Column) -> Column:
        return F.struct(code.alias("code"), name.alias("name"))

    found = (
        F.when(F.size(codes) == F.size(names), F.zip_with(codes, names, pair))
        .when(F.size(names) == 0, F.transform(codes, lambda c: pair(c, none)))
        .when(F.size(codes) == 0, F.transform(names, lambda n: pair(none, n)))
        .otherwise(F.array(pair(none, text)))
    )
    return F.when(strip(text) != "", found).otherwise(F.array().cast("array<struct<code:string,name:string>>"))


def split_names(text: Column) -> Column:
    return F.coalesce(_pieces(squeeze_spaces(text), NAME_SEPARATORS), F.array().cast("array<string>"))


def preprint_id(identifier: Column) -> Column:
    """Second part by ``/`` of the last part by ``:``; else empty."""
    last = F.try_element_at(F.split(identifier, ":"), F.lit(-1))
    return F.coalesce(F.try_element_at(F.split(last, "/"), F.lit(2)), F.lit(""))


def year_prefix(date: Column) -> Column:
    return F.substring(date.cast("string"), 1, 4)


def license_parts(url: Column) -> Column:
    """(type, version): the first licence type that is a part of the path; the part after it if all its dotted parts are digits."""
    low = F.lower(url)
    parts = F.split(low, "/")
    kind = F.coalesce(*[F.when(F.array_contains(parts, t), F.lit(t)) for t in LICENSE_TYPES])
    after = F.element_at(F.split(F.element_at(F.split(low, F.concat(F.lit("/"), kind, F.lit("/"))), -1), "/"), 1)
    return F.struct(kind.alias("type"), F.when(after.rlike(r"^[0-9]+(\.[0-9]+)*$"), after).alias("version"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def ip_to_number(ip: Column) -> Column:
    """IPv4 as a number; anything else is null."""
    part = F.split(ip, r"\.")
    octets = [F.try_element_at(part, F.lit(i + 1)).try_cast("long") for i in range(4)]
    good = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for o in octets:
        good = good & (o <= 255)
    return F.when(good, ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3])


def ipv6_to_hex(ip: Column) -> Column:
    """IPv6 as 32 hex digits, which sort as the addresses do; anything else is null."""
    low = F.lower(ip)
    halves = F.split(low, "::", 2)
    groups = [F.filter(F.split(F.element_at(halves, i), ":"), lambda x: x != "") for i in (1, -1)]
    left, right = groups[0], F.when(low.contains("::"), groups[1]).otherwise(F.array().cast("array<string>"))
    gap = F.lit(8) - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    good = low.rlike("^[0-9a-f:]+$") & low.contains(":") & ~low.rlike("::.*::") & F.forall(whole, lambda g: F.char_length(g) <= 4) & (F.size(whole) == 8)
    return F.when(good, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))
