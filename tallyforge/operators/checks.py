"""Validity of item accesses, lookups in the catalogue and what becomes of rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import standardize as S
from . import joins

UNDEFINED = "undefined"
PIDS = ("pid_v2", "pid_v3", "pid_generic")


def item_access_data(df: DataFrame, collection: Column, codes: dict[str, str], record: str | None = None) -> DataFrame:
    """The 14 fields of an access, standardized. Fields come from the struct column ``record`` or from ``df`` itself; absent
    columns are null; a null record gives null fields."""
    names = df.schema[record].dataType.names if record else df.columns

    def field(name: str) -> Column:
        return F.lit(None).cast("string") if name not in names else F.col(f"{record}.{name}" if record else name).cast("string")

    made = {
        "collection": collection,
        "issn": field("issn"),
        "pid_v2": S.std_pid_v2(field("pid_v2")),
        "pid_v3": S.std_pid_v3(field("pid_v3")),
        "pid_generic": S.std_pid_generic(field("pid_generic")),
        "media_language": S.std_language(field("media_language"), codes),
        "media_format": field("media_format"),
        "content_type": field("content_type"),
        "year_of_publication": S.std_year(field("year_of_publication")),
    }
    made |= {n: field(n) for n in ("journal_main_title", "journal_subject_area_capes", "journal_subject_area_wos", "journal_acronym", "journal_publisher_name")}
    if record:
        made = {n: F.when(F.col(record).isNotNull(), c) for n, c in made.items()}
    return df.withColumns(made)


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def check_access(df: DataFrame, known: DataFrame | None = None, journals: DataFrame | None = None, flags: dict[str, str] | None = None) -> DataFrame:
    """``df`` with is_valid, code and message; the first failing check decides.

    Required: issn, a defined format and content type, one identifier. With ``known`` (pid) and ``journals`` (issn), both
    distinct, the codes must occur there as well; ``flags`` names columns that say whether a code was found (``{"issn": "issn_known"}``).
    Each row is moved once for each code. Where many rows have the same codes, ``check_distinct`` moves fewer.
    """
    required = _given("issn") & _given("media_format") & (F.col("media_format") != UNDEFINED) & _given("content_type") & (F.col("content_type") != UNDEFINED)
    required = required & (_given("pid_v2") | _given("pid_v3") | _given("pid_generic"))
    columns = df.columns
    # what the codes are needed for is worked out before and after each join, so that columns that nobody asks for are not moved on
    df = df.withColumns({"__required": required, "__spread": F.pmod(joins.hash_of(df), F.lit(1 << 16))})
    code, message = F.when(~F.col("__required"), "missing_fields"), F.when(~F.col("__required"), "Required fields are missing.")
    looked_up = ([("issn", journals, "issn")] if journals is not None else []) + ([(pid, known, "pid") for pid in PIDS] if known is not None else [])
    for c, codes, its in looked_up:
        found, bad = f"__{c}", f"__bad_{c}"
        df = joins.flag_known(df, F.when(_given(c), F.col(c)), codes, its, found, F.col("__spread")).withColumn(bad, _given(c) & ~F.col(found))
        code, message = code.when(F.col(bad), f"invalid_{c}"), message.when(F.col(bad), F.concat(F.lit(f"Unknown {c}: "), c))
    code = code.otherwise("valid")
    found = [F.col(f"__{c}").alias(name) for c, name in (flags or {}).items()]
    return df.select(*columns, (code == "valid").alias("is_valid"), code.alias("code"), message.otherwise("Valid.").alias("message"), *found)


def check_distinct(df: DataFrame, known: DataFrame | None = None, journals: DataFrame | None = None, flags: dict[str, str] | None = None) -> DataFrame:
    """``check_access`` made once for each set of codes and formats: rows are moved in one join, whatever is looked up. For
    rows that share few sets; where nearly every row has its own, this only adds to the rows that move."""
    codes = ["issn", *PIDS, "media_format", "content_type"]
    found = check_access(df.select(*codes).distinct(), known, journals, flags)
    key = F.xxhash64(*[F.coalesce(c, F.lit("\x00")) for c in codes])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in codes]
    made = ["is_valid", "code", "message", *(flags or {}).values()]
    right = found.select(key.alias("__key"), *[F.col(c).alias(f"__{c}") for c in codes], *made)
    on = F.col("__own") == F.col("__key")
    for s in same:
        on = on & s
    return df.withColumn("__own", key).join(right, on, "left").select(*df.columns, *made)


def error_type(code: Column) -> Column:
    """``ART`` for identifiers, ``JOU`` for journals, ``URL`` and ``MET`` for addresses without item or fields; others null."""
    return F.when(code.startswith("invalid_pid"), "ART").when(code == "invalid_issn", "JOU").when(code == "no_item", "URL").when(code == "no_data", "MET")


def dead_letters(checked: DataFrame, line_cols: list[str], data_cols: list[str]) -> DataFrame:
    """Rejected rows with error_type, message and JSON of their line and data."""
    rows = checked.where(~F.col("is_valid")).withColumn("error_type", error_type(F.col("code"))).where("error_type is not null")
    options = {"ignoreNullFields": "false"}
    return rows.select("error_type", "message", F.to_json(F.struct(*line_cols), options).alias("line"), F.to_json(F.struct(*data_cols), options).alias("data"))


def known_pids(articles: DataFrame) -> DataFrame:
    """Distinct identifiers of all three kinds."""
    return articles.select(F.explode(F.array(*PIDS)).alias("pid")).where("pid <> ''").distinct()


def known_issns(journals: DataFrame, issns: str = "issns") -> DataFrame:
    """Distinct issns of an array column."""
    return journals.select(F.explode(issns).alias("issn")).where("issn <> ''").distinct()
