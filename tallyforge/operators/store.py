"""The metric store (Parquet by collection and year), merges, deletes and upserts."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import SEPARATOR
from .metrics import COUNTERS

PARTITIONS = ("collection", "year")


def merge_metrics(existing: DataFrame, new: DataFrame, key: str = "id", counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """Counters of equal ids are added, those of one side kept; other columns come from the new row where there is one."""
    a, b = existing.alias("a"), new.alias("b")
    columns = []
    for c in new.columns:
        old, now = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        if c in counters:
            columns.append((F.coalesce(old, F.lit(0)) + F.coalesce(now, F.lit(0))).alias(c))
        else:
            columns.append(F.when(F.col(f"b.`{key}`").isNotNull(), now).otherwise(old).alias(c))
    return a.join(b, F.col(f"a.`{key}`") == F.col(f"b.`{key}`"), "full_outer").select(*columns)


def last_write_wins(existing: DataFrame, new: DataFrame, key: str = "id", order: list | None = None) -> DataFrame:
    """The union by id with new rows before old ones (and by ``order`` among themselves)."""
    both = new.withColumn("__new", F.lit(1)).unionByName(existing.withColumn("__new", F.lit(0)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("__new"), *(order or [])))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__new", "__rank")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def _row_of_key(new: DataFrame, keys: list[str], update: list[str], keep_old_if_blank: tuple[str, ...], force: bool, order: list[str]) -> DataFrame:
    """One row per key: what its rows, taken one after the other, leave behind. Rows are ordered by ``order``, then by all columns."""
    comparable = [c for c in [*order, *new.columns] if "map<" not in new.schema[c].dataType.simpleString()]
    turn = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(comparable)])
    columns = []
    for c in new.columns:
        if c in keys:
            continue
        first, last = F.min_by(c, turn), F.max_by(c, turn)
        if force and c in keep_old_if_blank and c in update:
            last = F.coalesce(F.max_by(F.when(~_blank(c), F.col(c)), F.when(~_blank(c), turn)), first)
        columns.append((last if force and c in update else first).alias(c))
    return new.groupBy(*keys).agg(*columns).select(*new.columns) if columns else new.select(*keys).distinct()


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None, keep_old_if_blank: tuple[str, ...] = (), force: bool = True, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` with unknown keys are inserted. Known ones get the columns of ``update`` (default: all) if ``force``;
    columns of ``keep_old_if_blank`` keep their value where the new one is blank. Keys of ``existing`` are unique. Rows of
    ``new`` with one key are taken one after the other (by ``order``, then by all columns): the first is inserted, the
    others update it."""
    update = [c for c in (update if update is not None else new.columns) if c not in keys]
    new = _row_of_key(new, keys, update, keep_old_if_blank, force, list(order))
    a, b = existing.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
    columns = []
    for c in existing.columns:
        old = F.col(f"a.`{c}`")
        now = F.col(f"b.`{c}`") if c in new.columns else F.lit(None)
        if c in keys or not force and c in new.columns:
            value = F.when(F.col("a.__old"), old).otherwise(now)
        elif c in update and c in new.columns:
            kept = F.coalesce(F.nullif(F.trim(now.cast("string")), F.lit("")).cast(existing.schema[c].dataType), old) if c in keep_old_if_blank else now
            value = F.when(F.col("b.__new"), F.when(F.col("a.__old"), kept).otherwise(now)).otherwise(old)
        else:
            value = F.when(F.col("a.__old"), old).otherwise(now)
        columns.append(value.alias(c))
    return a.join(b, same, "full_outer").select(*columns)


def insert_only(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Known rows stay as they are; of new rows with equal keys one is inserted."""
    fresh = new.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return existing.unionByName(fresh.select(*existing.columns))


def delete_where(df: DataFrame, terms: dict) -> DataFrame:
    """Without the rows that meet all ``terms`` (column: value or list of values). No term deletes nothing."""
    if not terms:
        return df
    hit = reduce(lambda x, y: x & y, [F.col(c).isin(v if isinstance(v, (list, tuple, set)) else [v]) for c, v in terms.items()])
    return df.where(~F.coalesce(hit, F.lit(False)))


def delete_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def get_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest(df: DataFrame, created: str, tie: str, keys: list[str] | None = None) -> DataFrame:
    """The row created last, of all or of each key."""
    if not keys:
        return df.orderBy(F.desc(created), F.desc(tie)).limit(1)
    return first_per_key(df, keys, [F.desc(created), F.desc(tie)])


def with_match_count(df: DataFrame, keys: list[str], name: str = "n_matches") -> DataFrame:
    """``df`` with the number of rows of its key; counts are merged before the join."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def load_conflicts(df: DataFrame, keys: list[str], max_lengths: dict[str, int]) -> DataFrame:
    """Rows that cannot be loaded, with ``reason``: several rows of one key, or a value that is too long."""
    long = F.lit(None).cast("string")
    for c, n in max_lengths.items():
        long = F.coalesce(long, F.when(F.char_length(c) > n, F.lit(f"{c} is longer than {n}")))
    reason = F.coalesce(F.when(F.col("n_matches") > 1, F.lit("several matches")), long)
    return with_match_count(df, keys).withColumn("reason", reason).where("reason is not null").drop("n_matches")


#: Columns of a metric document; journal columns may be absent.
DOCUMENT = "id string, pid string, collection string, issn string, pid_v2 string, pid_v3 string, pid_generic string, media_language string, country_code string, date date, year_of_publication string, journal_main_title string, journal_subject_area_capes string, journal_subject_area_wos string, journal_acronym string, journal_publisher_name string, " + ", ".join(f"{c} long" for c in COUNTERS)


def one_row_an_id(new: DataFrame, key: str = "id", add: tuple[str, ...] = ()) -> DataFrame:
    """``new`` with one row for each ``key``, merged before it is moved: the counters ``add`` are sums, the others those of the
    last row, by all columns in order."""
    comparable = [c for c in new.columns if "map<" not in new.schema[c].dataType.simpleString()]
    turn = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(comparable)])
    last = F.max_by(F.struct(*[c for c in new.columns if c != key and c not in add]), turn)
    sums = [F.sum(c).cast(new.schema[c].dataType).alias(c) for c in new.columns if c in add]
    return new.groupBy(key).agg(last.alias("__last"), *sums).select(*[F.col(c) if c == key or c in add else F.col(f"__last.`{c}`").alias(c) for c in new.columns])


class MetricStore:
    """Metric documents under one path. Writes replace whole partitions and never the one that a plan still reads.

    With a ``schema`` (such as DOCUMENT) the store has those columns: absent ones are written as nulls, others are refused,
    and it can be read before the first write. A null or empty collection, and a null date, are partitions of their own.

    ``put``, ``accumulate`` and ``replace_days`` are loads. A load stages the whole new content of the partitions that it touches
    in a folder beside the store and becomes the next version by one rename, which only one of several writers achieves; the
    others see that, drop what they staged and merge again on top. A version is then copied over its partitions. What a
    crash leaves is finished (a version) or ignored (anything not renamed yet) by the next load. A load with an identifier
    that has been loaded before does nothing, so a retry counts once. A version that another writer is still applying is
    waited for, ``patience`` seconds at most; then that writer counts as crashed. Partitions change one after the other, so a
    reader may see some of a load's before the others. Renames must not replace folders, as on file systems (not on plain
    object stores).
    """

    #: Ids that ``get`` hands to the scan itself; more are joined.
    LISTED = 2000

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None, patience: float = 600, row_group_bytes: int = 1 << 27):
        self.spark, self.path, self.patience, self.row_group_bytes = spark, path.rstrip("/"), patience, row_group_bytes
        self.loads = f"{self.path}-loads"
        self.schema = spark.createDataFrame([], schema).schema if schema else None

    def _at(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _exists(self, path: str) -> bool:
        system, at = self._at(path)
        return system.exists(at)

    def _delete(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)

    def _write_text(self, path: str, text: str) -> None:
        system, at = self._at(path)
        out = system.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, path: str) -> str:
        system, at = self._at(path)
        file = system.open(at)
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()

    def read(self, schema=None) -> DataFrame | None:
        """None before the first write, if no schema is given."""
        schema = schema or self.schema and T.StructType([*self.schema, T.StructField("year", T.IntegerType())])
        system, parts = self._at(f"{self.path}/collection=*/year=*/*.parquet")
        if not system.globStatus(parts):
            return self.spark.createDataFrame([], schema) if self.schema else None
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(self.path)

    def _partition(self, collection: str | None, year: int | None) -> str:
        names = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        none = "__HIVE_DEFAULT_PARTITION__"
        return f"{self.path}/collection={names.escapePathName(collection) if collection else none}/year={none if year is None else year}"

    def create(self, collection: str, year: int) -> bool:
        """Makes the partition if it is absent; whether it was."""
        system, path = self._at(self._partition(collection, year))
        return not system.exists(path) and system.mkdirs(path)

    def partitions(self) -> list[tuple[str, int]]:
        """(collection, year) of all partitions with both, empty ones too."""
        system, path = self._at(f"{self.path}/collection=*/year=*")
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        parts = [x.getPath() for x in system.globStatus(path) or []]
        named = [(p.getParent().getName().removeprefix("collection="), p.getName().removeprefix("year=")) for p in parts]
        return sorted((unescape(c), int(y)) for c, y in named if "__HIVE_DEFAULT_PARTITION__" not in (c, y))

    def _fitted(self, documents: DataFrame) -> DataFrame:
        documents = documents.withColumn("collection", F.nullif("collection", F.lit("")))
        if self.schema is None:
            return documents
        if other := {*documents.columns} - {*self.schema.names}:
            raise ValueError(f"not columns of the store: {sorted(other)}")
        return documents.select(*[(F.col(f.name) if f.name in documents.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    def write(self, documents: DataFrame) -> None:
        """Replaces the partitions that ``documents`` has rows of; others stay. A day with very many rows is several tasks."""
        rows = self._fitted(documents).withColumn("year", F.year("date")).hint("rebalance", *PARTITIONS, "date")
        blooms = {"parquet.bloom.filter.enabled#id": True, "parquet.bloom.filter.adaptive.enabled": True, "parquet.block.size": self.row_group_bytes}
        rows.sortWithinPartitions("date", "id").write.mode("overwrite").options(partitionOverwriteMode="dynamic", **blooms).partitionBy(*PARTITIONS).parquet(self.path)

    def get(self, ids: DataFrame, named: bool = False) -> DataFrame:
        """Stored rows with the ids in column ``id``; unknown and null ids give none, repeated ones count once.

        Up to ``LISTED`` distinct ids are listed and reach the scan in tens, so that row groups without them are passed over by
        Bloom filters and, as files are sorted by date and id, by their bounds; more are joined. With ``named`` the ids are
        those of ``document_id``, whose collection and date name the partitions and days to read.
        """
        asked = ids.select(F.col("id").cast("string")).where("id is not null").distinct()
        rows = self.read()
        if rows is None:
            raise ValueError("nothing has been written yet")
        listed = sorted(r.id for r in asked.limit(self.LISTED + 1).collect())
        if not listed:
            return rows.where(F.lit(False))
        if len(listed) > self.LISTED:
            return get_ids(rows, asked)
        if named:
            rows = rows.where(_named_parts(listed))
        tens = [F.col("id").isin(listed[i : i + 10]) for i in range(0, len(listed), 10)]
        while len(tens) > 1:
            tens = [reduce(lambda a, b: a | b, tens[i : i + 2]) for i in range(0, len(tens), 2)]
        return rows.where(tens[0])

    # loads

    def versions(self) -> list[int]:
        """Numbers of the versions that the ledger holds: the last one, and any that is not applied yet."""
        system, path = self._at(f"{self.loads}/v*")
        return sorted(int(x.getPath().getName().removeprefix("v")) for x in system.globStatus(path) or [])

    def _version(self, number: int) -> str:
        return f"{self.loads}/v{number:09d}"

    def loaded(self, load_id: str) -> bool:
        return self._exists(f"{self.loads}/ids/{_file_name(load_id)}")

    def _commit(self, staged: str, number: int) -> bool:
        """``staged`` becomes version ``number``, unless another writer's has."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        system, path = self._at(self.loads)
        system.mkdirs(path)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        target = self._version(number)
        if self._exists(target):
            return False
        try:
            context.rename(self._at(staged)[1], self._at(target)[1], gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            if not self._exists(target):
                raise
            return False
        return True

    def _apply(self, number: int) -> None:
        """Copies a version over its partitions; doing so again changes nothing."""
        at = self._version(number)
        note = json.loads(self._read_text(f"{at}/note"))
        schema = T.StructType.fromJson(note["schema"])
        self.write(self.spark.read.schema(schema).parquet(f"{at}/data"))
        for collection, year in note["emptied"]:
            self.drop(collection, year)
        self._write_text(f"{self.loads}/ids/{_file_name(note['load'])}", str(number))
        self._write_text(f"{at}/applied", "")
        self._delete(f"{at}/data")

    def recover(self) -> int:
        """Applies versions that are not applied yet; the number of the last one."""
        for number in self.versions():
            at, waited = self._version(number), 0.0
            while not self._exists(f"{at}/applied"):
                system, path = self._at(at)
                if not system.exists(path):
                    break
                if time.time() - system.getFileStatus(path).getModificationTime() / 1000 >= self.patience or waited >= self.patience:
                    self._apply(number)
                else:
                    time.sleep(0.2)
                    waited += 0.2
        last = self.versions()
        for number in last[:-1]:
            self._delete(self._version(number))
        return last[-1] if last else 0

    def _load(self, new: DataFrame, years: DataFrame, combine: Callable[[DataFrame | None], DataFrame], load_id: str | None) -> bool:
        """Merges until the merge is the next version. ``combine`` gets the stored rows of ``years`` (collection, year)."""
        load_id = load_id or uuid.uuid4().hex
        while True:
            number = self.recover()
            if self.loaded(load_id):
                return False
            old = self.read()
            if old is not None:
                same = old.collection.eqNullSafe(years.collection) & old.year.eqNullSafe(years.year)
                old = old.join(years, same, "left_semi").select(*(self.schema.names if self.schema else [c for c in new.columns if c in old.columns]))
            staged = f"{self.loads}/staged-{uuid.uuid4().hex}"
            made = combine(old)
            made.write.parquet(f"{staged}/data")
            made = self.spark.read.schema(made.schema).parquet(f"{staged}/data")
            left = made.select("collection", F.year("date").alias("year")).distinct()
            emptied = sorted({tuple(r) for r in years.collect()} - {tuple(r) for r in left.collect()}, key=repr)  # some hundreds
            self._write_text(f"{staged}/note", json.dumps({"load": load_id, "schema": made.schema.jsonValue(), "emptied": emptied}))
            if self._commit(staged, number + 1):
                self._apply(number + 1)
                return True
            self._delete(staged)

    @staticmethod
    def _years(documents: DataFrame) -> DataFrame:
        return documents.select("collection", F.year("date").alias("year")).distinct()

    def put(self, documents: DataFrame, load_id: str | None = None) -> bool:
        """By id, last write wins; of the load's own rows of an id the last by all columns. False: the load is known."""
        new = one_row_an_id(self._fitted(documents))
        return self._load(new, self._years(new), lambda old: new if old is None else last_write_wins(old, new), load_id)

    def accumulate(self, documents: DataFrame, load_id: str | None = None) -> bool:
        """Adds counters to stored ids, once for each ``load_id``. False: the load is known."""
        fitted = self._fitted(documents)
        new = one_row_an_id(fitted, add=tuple(c for c in COUNTERS if c in fitted.columns))
        return self._load(new, self._years(new), lambda old: new if old is None else merge_metrics(old, new), load_id)

    def replace_days(self, documents: DataFrame, days: DataFrame | None = None, load_id: str | None = None) -> bool:
        """Stored rows of the (collection, date) in ``days`` (default: those of ``documents``) give way to ``documents``.

        Partitions that are left without a row are dropped. The partitions that the days touch (some hundreds) are listed.
        """
        new = self._fitted(documents)
        days = (new if days is None else days.withColumn("collection", F.nullif("collection", F.lit("")))).select("collection", "date").distinct()

        def combine(old: DataFrame | None) -> DataFrame:
            if old is None:
                return new
            same = old.collection.eqNullSafe(days.collection) & old.date.eqNullSafe(days.date)
            return old.join(days, same, "left_anti").unionByName(new)

        return self._load(new, self._years(days), combine, load_id)

    def drop(self, collection: str | None, year: int | None) -> None:
        self._delete(self._partition(collection, year))


def _named_parts(listed: list[str]) -> Column:
    """The partitions and days that document ids name. An id of another form names none, and then all are read."""
    parts = [x.split(SEPARATOR) for x in listed]
    try:
        days = {dt.date.fromisoformat(p[-1]) for p in parts}
    except ValueError:
        return F.lit(True)
    if any(len(p) != 8 for p in parts):
        return F.lit(True)
    collections = {p[0] for p in parts}
    held = F.col("collection").isin(sorted(collections)) | (F.col("collection").isNull() if "" in collections else F.lit(False))
    spans = F.col("year").isin(sorted({d.year for d in days})) & F.col("date").between(F.lit(min(days)), F.lit(max(days)))
    return held & spans


def _file_name(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def archive(df: DataFrame, expired: Column, path: str) -> DataFrame:
    """Writes the ``expired`` rows as JSON and returns the others."""
    gone = F.coalesce(expired, F.lit(False))
    df.where(gone).write.mode("append").json(path)
    return df.where(~gone)


def export_table(df: DataFrame, cols: list[str], path: str) -> None:
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
