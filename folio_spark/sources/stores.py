"""Stores kept as Parquet tables: content by key, tables of contents, bundles; and written intermediate results."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df by checkpoint() in the folder that the session names; a session in one process without one gets its own."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumn("book_key", F.md5("book_url")).withColumn("chapter_key", F.md5("chapter_url"))


class CommitLog:
    """Numbered entries in a folder, each written once: who creates number n + 1 first has committed on top of n, and others see
    that they haven't. Every `compact` entries a snapshot sums up all so far, so a reader opens one and the entries behind it.

    Entries map names to values (null: gone). A file appears under its number whole or not at all: it is written under another
    name, then renamed (or on a local disk linked), which fails if the number is taken."""

    def __init__(self, spark: SparkSession, path: str, compact: int = 20):
        self.jvm, self.compact = spark.sparkContext._jvm, compact
        self.conf, self.gateway = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        out = self.fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _create(self, name: str, text: str) -> bool:
        """Whether the file is this one: it had not been there."""
        made = f"_{name}-{uuid.uuid4().hex}"
        self._write(made, text)
        source, target = (self.fs.makeQualified(self._path(n)) for n in (made, name))
        try:
            if source.toUri().getScheme() == "file":
                local = lambda p: self.jvm.java.nio.file.Paths.get(self.jvm.java.net.URI("file://" + p.toUri().getPath().replace(" ", "%20")))
                self.jvm.java.nio.file.Files.createLink(local(target), local(source))
            else:
                none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.conf).rename(source, target, none)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self.fs.delete(source, False)
        return True

    def state(self) -> tuple[int, dict[str, str | None]]:
        """The last number (0: none yet) and what holds."""
        last = self._read("_latest") or ""
        n = int(last) if last.isdigit() else 0  # the file may be just being written: entries tell all
        held = json.loads(self._read(f"{n:020d}.snapshot") or "{}") if n else {}
        for n, entry in self.since(n):  # noqa: B020
            held |= entry
        return n, held

    def since(self, n: int) -> list[tuple[int, dict[str, str | None]]]:
        """Entries behind number n; if there are none, n with nothing."""
        found = []
        while (text := self._read(f"{n + len(found) + 1:020d}.entry")) is not None:
            found.append((n + len(found) + 1, json.loads(text)))
        return found or [(n, {})]

    def commit(self, n: int, entry: dict[str, str | None]) -> bool:
        """Add an entry on top of number n; False if another is there already."""
        if not self._create(f"{n + 1:020d}.entry", json.dumps(entry)):
            return False
        if (n + 1) % self.compact == 0:
            last, held = self.state()
            self._create(f"{last:020d}.snapshot", json.dumps(held))
            self._write("_latest", str(last))
        return True


class ContentStore:
    """A keyed Parquet table in `parts` folders by a hash of the key. A change rewrites the folders it touches only, then commits
    their new versions at once, so readers never see half of one. Of writers at the same time one commits first; another whose folders
    were touched meanwhile does its change again on top of that, so none is lost."""

    TRIES = 50

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("book_key", "chapter_key"), parts: int = 16):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), list(keys), parts
        self.log = CommitLog(spark, f"{self.path}/log")

    def _current(self) -> dict[int, str]:
        return {int(p): v for p, v in self.log.state()[1].items() if v is not None}

    def _load(self, current: dict[int, str], parts: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/{v}/_part={p}" for p, v in current.items() if parts is None or p in parts]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        return self._load(self._current())

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, touched: list[int]) -> dict[str, str | None]:
        version = f"v-{uuid.uuid4().hex}"
        rows.withColumn("_part", self._part()).repartition("_part", *self.keys).write.partitionBy("_part").parquet(f"{self.path}/{version}")
        left = {r["_part"] for r in self.spark.read.schema("_part int").parquet(f"{self.path}/{version}").select("_part").distinct().collect()} if not rows.isEmpty() else set()
        return {str(p): version if p in left else None for p in touched}

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r["p"] for r in keys.select(self._part().alias("p")).distinct().collect()]  # at most `parts` rows

    def _change(self, touched: list[int], make: Callable[[DataFrame | None], DataFrame | None]) -> None:
        """Commit what make gives of the rows of the touched folders (None: nothing is to do)."""
        for _ in range(self.TRIES):
            n, held = self.log.state()
            rows = make(self._load({int(p): v for p, v in held.items() if v is not None}, touched))
            if rows is None:
                return
            entry = self._write(rows, touched)
            while not self.log.commit(n, entry):
                others = self.log.since(n)
                if any(p in entry for _, e in others for p in e):
                    break  # once more, on top of the others
                n = others[-1][0]
            else:
                return
        raise RuntimeError(f"{self.path}: other writers were always first")

    def change(self, put: DataFrame | None = None, remove: DataFrame | None = None) -> None:
        """Drop rows by all keys or some of them, then insert or replace rows by key, in one commit; of several incoming rows of
        a key one stays."""
        new = None if put is None else checkpointed(put.dropDuplicates(self.keys))
        whole = remove is not None and not set(self.keys) <= set(remove.columns)
        touched = list(range(self.parts)) if whole else sorted({p for df in (new, remove) if df is not None for p in self._touched(df)})

        def make(old: DataFrame | None) -> DataFrame | None:
            if old is None:
                return new
            kept = old if remove is None else old.join(remove, remove.columns, "left_anti")
            return kept if new is None else kept.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new, allowMissingColumns=True)

        if touched:
            self._change(touched, make)

    def put(self, rows: DataFrame) -> None:
        """Insert or replace by key; of several incoming rows of a key one stays."""
        self.change(put=rows)

    def remove(self, keys: DataFrame) -> None:
        """Drop by all keys, or by some of them (all chapters of a book)."""
        self.change(remove=keys)

    def exists(self, rows: DataFrame) -> DataFrame:
        old = self.read()
        return rows.limit(0) if old is None else rows.join(old.select(*self.keys), self.keys, "left_semi")


class TocStore:
    """Tables of contents by toc_url: load, save, append behind the last index, delete."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = ContentStore(spark, path, ("toc_url", "idx"))

    def load(self, tocs: DataFrame | None = None) -> DataFrame | None:
        rows = self.store.read()
        return rows if tocs is None or rows is None else rows.join(tocs.select("toc_url").distinct(), "toc_url", "left_semi")

    def save(self, rows: DataFrame) -> None:
        """Each toc_url of rows holds these chapters and no others."""
        self.store.change(put=rows, remove=rows.select("toc_url").distinct())

    def append(self, rows: DataFrame) -> None:
        old = self.load(rows)
        self.store.put(append_toc(rows.limit(0) if old is None else old.select(rows.columns), rows))

    def delete(self, tocs: DataFrame) -> None:
        self.store.remove(tocs.select("toc_url").distinct())


def append_toc(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored chapters of each table of contents, then the new ones, numbered on from the largest index."""
    last = stored.groupBy("toc_url").agg(F.max("idx").alias("_last"))
    w = W.partitionBy("toc_url").orderBy("idx")
    added = new.join(last, "toc_url", "left").withColumn("idx", F.coalesce("_last", F.lit(-1)) + F.row_number().over(w)).select(stored.columns)
    return stored.unionByName(added)


#: The collections of a library bundle and their required columns.
COLLECTIONS = {"books": ["book_url"], "sources": ["source_url"], "groups": ["group_id"], "bookmarks": ["time"], "rules": ["pattern"], "feeds": ["origin"]}


def export_bundle(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """All collections as JSON lines below one folder, with a manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = json.dumps({"version": version, "tables": {n: df.schema.json() for n, df in tables.items()}})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def restore_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The collections of a bundle; a missing required column is an error."""
    from pyspark.sql.types import StructType

    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    out = {}
    for name, schema in manifest["tables"].items():
        kind = StructType.fromJson(json.loads(schema))
        if missing := [c for c in COLLECTIONS.get(name, []) if c not in kind.names]:
            raise ValueError(f"{name}: required columns are missing: {missing}")
        out[name] = spark.read.schema(kind).json(f"{path}/{name}")
    return out
