"""Catalogue dumps, read with explicit schemas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import standardize as S
from ..operators.filters import publication_window
from ..operators.store import upsert

ARTICLE_PAGE = (
    "objects array<struct<code: string, code_title: array<string>, collection: string, pdfs: map<string, string>, processing_date: string, "
    "publication_date: string, publication_year: string, default_language: string, text_langs: array<string>>>"
)
DOCUMENT_PAGE = "documents map<string, struct<journal_acronym: string, pid_v2: string, pid_v3: string, publication_date: string, default_language: string>>, pages int"
JOURNAL = "collection string, acronym string, title string, electronic_issn string, print_issn string, issn string, publisher_name array<string>, subject_areas array<string>, wos_subject_areas array<string>"

#: Fixed value: the type of a container in a dataset dump.
CONTAINER = "dataverse"


def read_article_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per object of the pages."""
    pages = spark.read.schema(ARTICLE_PAGE).json(path, multiLine=True)
    return pages.select(F.explode("objects").alias("o")).select("o.*").where("code is not null")


def read_document_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the maps, with its key."""
    pages = spark.read.schema(DOCUMENT_PAGE).json(path, multiLine=True)
    return pages.select(F.explode("documents").alias("key", "d")).select("key", "d.*", S.year_prefix(F.col("d.publication_date")).alias("publication_year"))


def read_oai_records(spark: SparkSession, path: str) -> DataFrame:
    """Harvested records: preprint id, language and year; records without an id are dropped."""
    kind = "identifier string, language array<string>, date array<string>"
    rows = spark.read.format("xml").option("rowTag", "record").schema(kind).load(path)
    out = rows.select(
        F.upper(S.preprint_id(F.col("identifier"))).alias("pid_generic"),
        F.try_element_at("language", F.lit(1)).alias("default_language"),
        F.try_element_at("date", F.lit(1)).alias("publication_date"),
        S.year_prefix(F.try_element_at("date", F.lit(1))).alias("publication_year"),
    )
    return out.where("pid_generic <> ''")


def read_dataset_tree(containers: DataFrame, datasets: DataFrame, files: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Files of published datasets: containers (id, title, type), datasets (id, container_id, type, doi, published), files
    (dataset_id, file_id, file_name, file_url, file_persistent_id). A DOI is required; undated datasets are kept."""
    c = containers.where(F.col("type") == CONTAINER).select(F.col("id").alias("container_id"), "title")
    d = datasets.where("type = 'dataset'").select(F.col("id").alias("dataset_id"), "container_id", S.std_doi(F.col("doi")).alias("dataset_doi"), F.try_to_date("published").alias("dataset_published"))
    d = publication_window(d.where("dataset_doi is not null"), start, end, "dataset_published")
    return c.join(d, "container_id").join(files, "dataset_id")


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """Absent texts become empty and absent lists empty lists."""
    rows = spark.read.schema(JOURNAL).json(path, multiLine=True)
    texts = {c: F.coalesce(c, F.lit("")) for c in ("acronym", "title", "electronic_issn", "print_issn", "issn")}
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("publisher_name", "subject_areas", "wos_subject_areas")}
    rows = rows.withColumns(texts | lists)
    return rows.withColumn("issns", F.array_distinct(F.filter(F.array("electronic_issn", "print_issn", "issn"), lambda x: x != "")))


#: Names of a dump's fields and ours.
COLLECTION_NAMES = {"acron": "acron3", "acron2": "acron2", "domain": "domain", "status": "status", "type": "collection_type", "is_active": "is_active", "code": "code"}


def rename_keys(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed by a table; names that ``df`` lacks are ignored."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def read_collections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Collections; and their names, one row per language."""
    kind = "acron string, acron2 string, code string, domain string, status string, type string, is_active boolean, name map<string, string>"
    rows = rename_keys(spark.read.schema(kind).json(path, multiLine=True), COLLECTION_NAMES)
    return rows.drop("name"), rows.select("acron3", F.explode("name").alias("language", "name"))


# Merges of dumps into the catalogue


def merge_articles(articles: DataFrame, loaded: DataFrame, force: bool = False) -> DataFrame:
    """By (collection, issn, pid_v2); six columns are replaced if ``force``."""
    update = ["files", "processing_date", "publication_date", "publication_year", "default_language", "text_langs"]
    return upsert(articles, loaded, ["collection", "issn", "pid_v2"], update, force=force)


def merge_documents(articles: DataFrame, loaded: DataFrame) -> DataFrame:
    """Sets pid_v3; date, year and language keep the old value where the new one is blank."""
    update = ["pid_v3", "publication_date", "publication_year", "default_language"]
    return upsert(articles, loaded, ["collection", "issn", "pid_v2"], update, keep_old_if_blank=tuple(update[1:]))


def merge_preprints(articles: DataFrame, loaded: DataFrame) -> DataFrame:
    return upsert(articles, loaded.where("pid_generic <> ''"), ["collection", "pid_generic"])


def file_maps(files: DataFrame) -> DataFrame:
    """Per dataset, a map of file id to (name, url, persistent id); of rows of one file the last by url wins."""
    last = files.groupBy("dataset_doi", "file_id").agg(F.max(F.struct("file_url", "file_name", "file_persistent_id")).alias("f"))
    value = F.struct(F.col("f.file_name").alias("name"), F.col("f.file_url").alias("url"), F.col("f.file_persistent_id").alias("persistent_id"))
    entries = F.array_sort(F.collect_list(F.struct("file_id", value.alias("file"))))
    return last.groupBy("dataset_doi").agg(F.map_from_entries(entries).alias("files"))


def add_files(old: str, new: str):
    """A map with the entries of ``old`` and ``new``; those of ``new`` win."""
    return F.map_concat(F.map_filter(F.coalesce(old, new), lambda k, _: ~F.map_contains_key(F.col(new), k)), F.col(new))


def merge_datasets(articles: DataFrame, loaded: DataFrame) -> DataFrame:
    return upsert(articles, loaded, ["collection", "pid_generic"])


def merge_journals(journals: DataFrame, loaded: DataFrame) -> DataFrame:
    return upsert(journals, loaded, ["collection", "issn"])


def merge_robots(robots: DataFrame, loaded: DataFrame) -> DataFrame:
    """By pattern; the latest date wins."""
    return robots.unionByName(loaded.select(*robots.columns)).groupBy("pattern").agg(F.max("last_changed").alias("last_changed"))


def union_sources(articles: DataFrame, documents: DataFrame, preprints: DataFrame, datasets: DataFrame) -> DataFrame:
    """One catalogue table; preprints get the issn 0000-0000."""
    parts = [articles.withColumn("source", F.lit("article")), documents.withColumn("source", F.lit("document")), preprints.withColumns({"issn": F.lit("0000-0000"), "source": F.lit("preprint")}), datasets.withColumn("source", F.lit("dataset"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
