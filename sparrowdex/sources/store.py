"""Index stores: versioned Parquet folders, memory, or any JDBC database."""

from __future__ import annotations

import json
import os
import re
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import TABLES, Index, from_postings, group, grouped_of, ungroup, with_ngrams
from ..operators.maintain import latest, upsert
from ..settings import DEFAULT, Settings
from .elements import elements, identified


class StoreLocked(RuntimeError):
    pass


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the session names in spark.checkpoint.dir. Where it names
    none, a temporary one if everything runs in this process; on a cluster, an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{named.rstrip('/') if named else 'file://' + tempfile.mkdtemp(prefix='sparrowdex-')}/index-{uuid.uuid4().hex}"


SCHEMA_VERSION = 2


@dataclass
class MemoryStore:
    """Keeps an index as materialised DataFrames of the session: checkpointed where the
    session has a checkpoint folder, so that plans don't grow with every change, else persisted."""

    spark: SparkSession
    index: Index | None = None

    def write(self, index: Index) -> Index:
        if index is self.index:
            return index
        if self.spark.sparkContext.getCheckpointDir():
            new = replace(index, **{n: getattr(index, n).checkpoint() for n in TABLES})
        else:
            new = index.persist()
            for n in TABLES:
                getattr(new, n).count()
        old, self.index = self.index, new.count()
        if old is not None:  # only now: the new one has been made from it
            old.unpersist()
        return self.index

    def write_site(self, index: Index, site_id: int) -> Index:
        """`index` takes the place of all that is stored of a site."""
        if self.index is None:
            return self.write(index)
        return self.write(from_postings(self.index.postings.filter(F.col("site_id") != site_id).unionByName(index.postings), self.index.settings))

    def upsert(self, changed: DataFrame, handles: list[str] | None = None, order: str | None = None) -> Index:
        return self.write(upsert(self.read(), latest(changed, order).drop(order) if order else changed, handles))

    def read(self, settings: Settings | None = None) -> Index:
        if self.index is None:
            raise FileNotFoundError("nothing has been written")
        return self.index

    def drop(self) -> None:
        if self.index is not None:
            self.index.unpersist()
            self.index = None


@dataclass
class ParquetStore:
    """Segments under `path` (any file system that Spark knows) and numbered versions of what is live.

    A segment holds the postings of its elements, by site and sorted by term so that row groups
    prune on both; its elements, by site and id, with their terms (a forward index), and with a
    null length those that are gone; and by how much it changes each term's document frequency.
    A version (`current.N`, JSON) lists the live segments, the sites that each of them
    replaced, totals by site, settings and the schema's version. An upsert writes a segment
    of its own size and a version; reads take each element from the newest segment that states
    it. As soon as `fanout` segments of a level lie together they are merged into one of the next.

    Segments are complete before a version names them, and a version is complete before it
    is renamed to its final name: readers see one version or the other. Writers hold a lock for
    the site, or the whole store, that they write, with their name in it, and renew it as
    they go on; it is stale after `lock_ttl` seconds without that. Publishing is a short
    lock of its own, in which a version is made from the newest one."""

    spark: SparkSession
    path: str
    keep: int = 2
    fanout: int = 4
    lock_ttl: float = 21_600.0
    _fs: object = field(default=None, repr=False)
    _beats: dict = field(default_factory=dict, repr=False)

    # files

    def _jpath(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        if self._fs is None:
            self._fs = self._jpath().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self._fs

    def _names(self) -> list[str]:
        fs, p = self._files(), self._jpath()
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _put(self, name: str, content: str, overwrite: bool) -> None:
        out = self._files().create(self._jpath(name), overwrite)
        out.write(bytearray(content.encode()))
        out.close()

    def _get(self, name: str) -> str:
        jvm = self.spark.sparkContext._jvm
        stream = self._files().open(self._jpath(name))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[1]) for n in self._names() if n.startswith("current."))

    def current(self) -> int | None:
        return max(self.versions(), default=None)

    def _manifest(self, version: int | None = None) -> dict | None:
        version = self.current() if version is None else version
        if version is None:
            return None
        found = json.loads(self._get(f"current.{version}"))
        if found["schema"] != SCHEMA_VERSION:
            raise ValueError(f"the index at {self.path} has schema {found['schema']}, not {SCHEMA_VERSION}: rebuild it")
        return found

    # locks

    def _take(self, name: str, wait: float = 0.0) -> str:
        fs, owner = self._files(), uuid.uuid4().hex
        fs.mkdirs(self._jpath())
        until = time.time() + wait
        while True:
            try:
                self._put(name, owner, False)
                return owner
            except Exception:
                p = self._jpath(name)
                if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > self.lock_ttl:
                    # of several who find it stale, the one whose rename succeeds removes it
                    gone = self._jpath(f"_stale-{owner}")
                    if fs.rename(p, gone):
                        fs.delete(gone, False)
                    continue
                if time.time() >= until:
                    raise StoreLocked(f"another writer holds {self.path}/{name}") from None
                time.sleep(0.1)

    def _release(self, name: str, owner: str) -> None:
        if self._owner(name) == owner:  # else it was stale, and is someone else's now
            self._files().delete(self._jpath(name), False)

    def _owner(self, name: str) -> str | None:
        try:
            return self._get(name)
        except Exception:
            return None

    @contextmanager
    def _lock(self, site_id: int | None = None):
        """Holds a site, or with None the whole store, for writing."""
        name = "_lock" if site_id is None else f"_lock-{site_id}"
        owner = self._take(name)
        done = threading.Event()

        def renew():
            while not done.wait(min(60.0, self.lock_ttl / 4)):
                if self._owner(name) == owner:
                    self._put(name, owner, True)

        beat = threading.Thread(target=renew, daemon=True)
        try:
            clash = [n for n in self._names() if n.startswith("_lock") and n != name and (site_id is None or n == "_lock")]
            if clash:
                raise StoreLocked(f"another writer holds {self.path}/{clash[0]}")
            if self.lock_ttl > 0:
                beat.start()
            yield
            if self._owner(name) != owner:
                raise StoreLocked(f"lost {self.path}/{name} to another writer")
        finally:
            done.set()
            if beat.ident:
                beat.join()
            self._release(name, owner)

    # reading

    def _table(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.schema(STORED[name]).parquet(f"{self.path}/{segment}/{name}")

    def _live(self, manifest: dict, name: str) -> DataFrame:
        """A table's rows over the live segments; each element is that of the newest segment that states it."""
        parts, newer, cleared = [], None, set()
        for seg in reversed(manifest["segments"]):
            rows = self._table(seg["path"], name)
            if cleared:
                rows = rows.filter(~F.col("site_id").isin(sorted(cleared)))
            if newer is not None and name != "words":
                rows = rows.join(newer, KEYS, "left_anti")
            parts.append(rows)
            cleared |= set(seg["replaces"])
            own = self._table(seg["path"], "elements").select(*KEYS)
            newer = own if newer is None else newer.union(own)
        return reduce(DataFrame.unionByName, reversed(parts))

    def _words(self, manifest: dict, settings: Settings) -> DataFrame:
        words = self._live(manifest, "words")
        if len(manifest["segments"]) > 1:  # ngram_count depends on the term alone
            words = words.groupBy("site_id", "term").agg(F.sum("doc_freq").alias("doc_freq"), F.max("ngram_count").alias("ngram_count"), F.first("ngrams").alias("ngrams")).filter("doc_freq > 0")
        return words.select("site_id", "term", "doc_freq", "ngrams", "ngram_count")

    def read(self, settings: Settings | None = None) -> Index:
        """The newest version. Its own settings apply; others may differ in what a search uses, but not in n-grams."""
        m = self._manifest()
        if m is None:
            raise FileNotFoundError(f"no index at {self.path}")
        own = Settings(**m["settings"] | {"ngram_sizes": tuple(m["settings"]["ngram_sizes"])})
        if settings is not None and settings.ngram_sizes != own.ngram_sizes:
            raise ValueError(f"the index has n-grams of {own.ngram_sizes}: rebuild it for {settings.ngram_sizes}")
        totals = [sum(v[k] for v in m["totals"].values()) for k in (0, 1)]
        stats = self._live(m, "elements").filter("doc_len is not null").select(*KEYS, "doc_len")
        postings = self._live(m, "postings").select(*[c.split()[0] for c in TABLES["postings"].split(", ")])
        return Index(postings, stats, self._words(m, own), settings or own, tuple(totals))

    def document(self, site_id: int, element_id: int) -> DataFrame:
        """Terms of one element from the forward index: (term). Segments are pruned by site and id."""
        rows = self._live(self._manifest(), "elements").filter((F.col("site_id") == site_id) & (F.col("element_id") == element_id))
        return rows.select(F.explode("terms").alias("term"))

    # writing

    def _segment(self, grouped: DataFrame, gone: DataFrame | None, seqs: DataFrame | None, settings: Settings, old: DataFrame | None = None) -> str:
        """Writes a segment: the given postings by element are evaluated once, all else comes from what was written.
        `gone` (site_id, element_id) are elements without postings, `seqs` their sequence numbers, `old`
        (site_id, term) the terms of the live elements that the segment takes the place of."""
        name = f"seg-{uuid.uuid4().hex}"
        raw = f"{self.path}/{name}/_raw"
        grouped.write.option("compression", "zstd").parquet(raw)
        rows = self.spark.read.schema(grouped.schema).parquet(raw).filter(F.size("found") > 0)
        ungroup(rows).repartitionByRange("site_id", "term").sortWithinPartitions("site_id", "term").write.partitionBy("site_id").parquet(f"{self.path}/{name}/postings")
        docs = rows.select(*KEYS, "doc_len", F.col("found.term").alias("terms"))
        if gone is not None:
            docs = docs.unionByName(gone.select(*KEYS, F.lit(None).cast("bigint").alias("doc_len"), F.array().cast("array<string>").alias("terms")))
        docs = docs.join(seqs, KEYS, "left") if seqs is not None else docs.withColumn("seq", F.lit(None).cast("array<bigint>"))
        docs.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).write.partitionBy("site_id").parquet(f"{self.path}/{name}/elements")
        # by what is sorted by term: nearly every term is counted in one place before the shuffle
        words = self._table(name, "postings").groupBy("site_id", "term").agg(F.count("*").alias("doc_freq"))
        if old is not None:
            words = words.unionByName(old.groupBy("site_id", "term").agg((-F.count("*")).alias("doc_freq"))).groupBy("site_id", "term").agg(F.sum("doc_freq").alias("doc_freq")).filter("doc_freq <> 0")
        self._put_words(words, name, settings)
        self._files().delete(self._jpath(f"{name}/_raw"), True)
        return name

    def _put_words(self, words: DataFrame, name: str, settings: Settings) -> None:
        # n-grams come last: they are many times the words that are moved
        with_ngrams(words.repartitionByRange("site_id", "term").sortWithinPartitions("site_id", "term"), settings).write.partitionBy("site_id").parquet(f"{self.path}/{name}/words")

    def _totals(self, segment: str) -> dict[str, list[int]]:
        rows = self._table(segment, "elements").filter("doc_len is not null").groupBy("site_id").agg(F.count("*"), F.sum("doc_len")).collect()
        return {str(r[0]): [r[1], r[2]] for r in rows}

    def _publish(self, change) -> int:
        """Makes the next version from the newest one, under a short lock."""
        owner = self._take("_publish", 10.0)
        try:
            now = self.current() or 0
            made = change(self._manifest() if now else None)
            part = f"_version-{uuid.uuid4().hex}"
            self._put(part, json.dumps(made), True)
            if not self._files().rename(self._jpath(part), self._jpath(f"current.{now + 1}")):
                raise OSError(f"could not publish version {now + 1}")
            live = {s["path"] for v in self.versions()[-self.keep :] for s in self._manifest(v)["segments"]}
            for v in self.versions()[: -self.keep]:
                before = self._manifest(v)
                self._files().delete(self._jpath(f"current.{v}"), False)
                for s in before["segments"]:
                    if s["path"] not in live:
                        self._files().delete(self._jpath(s["path"]), True)
            return now + 1
        finally:
            self._release("_publish", owner)

    @staticmethod
    def _version(segments: list[dict], totals: dict, settings: Settings | dict) -> dict:
        return {"schema": SCHEMA_VERSION, "settings": settings if isinstance(settings, dict) else asdict(settings), "segments": segments, "totals": totals}

    @staticmethod
    def _grouped(index: Index) -> DataFrame:
        return index.grouped if index.grouped is not None else group(index.postings)

    def write(self, index: Index) -> Index:
        """`index` takes the place of all that is stored."""
        with self._lock():
            name = self._segment(self._grouped(index), None, None, index.settings)
            new = self._version([{"path": name, "level": 0, "replaces": [], "base": True}], self._totals(name), index.settings)
            self._publish(lambda _: new)
        return self.read()

    def write_site(self, index: Index, site_id: int) -> Index:
        """`index` takes the place of all that is stored of a site; other sites may be written meanwhile."""
        with self._lock(site_id):
            name = self._segment(self._grouped(index).filter(F.col("site_id") == site_id), None, None, index.settings)
            own = self._totals(name)

            def change(m: dict | None) -> dict:
                m = m or self._version([], {}, index.settings)
                totals = {k: v for k, v in m["totals"].items() if k != str(site_id)} | own
                others = [o for o in m["segments"] if self._sites(o["path"]) != {site_id}]  # those of nothing else are hidden in whole
                return m | {"segments": [*others, {"path": name, "level": 0, "replaces": [site_id]}], "totals": totals}

            self._publish(change)
        return self.read()

    def _sites(self, segment: str) -> set[int]:
        names = [s.getPath().getName() for s in self._files().listStatus(self._jpath(f"{segment}/elements"))]
        return {int(n.split("=")[1]) for n in names if n.startswith("site_id=")}

    def upsert(self, changed: DataFrame, handles: list[str] | None = None, order: str | None = None) -> Index:
        """Replaces the changed elements: those that aren't indexable (any more) only go. What is
        written is as large as the change, unless levels are merged.

        `order` names a column with a sequence number, or an array of them, by which the last
        of an element's changes counts; one that is older than what is stored is ignored,
        whenever it comes. An empty change writes nothing."""
        with self._lock():
            m = self._manifest() or self._version([], {}, DEFAULT)
            settings = Settings(**m["settings"] | {"ngram_sizes": tuple(m["settings"]["ngram_sizes"])})
            seq = F.lit(None).cast("array<bigint>")
            if order is not None:
                plain = not changed.schema[order].dataType.typeName().startswith("array")
                seq = (F.array(F.col(order).cast("bigint")) if plain else F.col(order)).cast("array<bigint>")
            rows = changed.withColumn("__seq", seq).filter(identified())
            raw = f"{self.path}/seg-{uuid.uuid4().hex}"
            try:
                rows.write.parquet(raw)  # evaluated once: a stream's batch may be costly
                rows = self.spark.read.schema(rows.schema).parquet(raw)
                live = self._live(m, "elements") if m["segments"] else None
                keys = rows.select(*KEYS).distinct()
                known = live.join(keys, KEYS, "left_semi") if live is not None else None
                if order is not None and known is not None:
                    newest = known.filter("seq is not null").select(*KEYS, F.col("seq").alias("__known"))
                    rows = rows.join(newest, KEYS, "left").filter("__known is null or __seq is null or __seq >= __known").drop("__known")
                rows = latest(rows, "__seq") if order is not None else rows
                name = f"{raw}-rows"
                rows.write.parquet(name)
                rows = self.spark.read.schema(rows.schema).parquet(name)
                if rows.isEmpty():
                    return self.read() if m["segments"] else None
                keys = rows.select(*KEYS).distinct()
                grouped = grouped_of(rows, handles)
                before = live.join(keys, KEYS, "left_semi") if live is not None else None
                old = before.select("site_id", F.explode("terms").alias("term")) if before is not None else None
                # elements without a term have no posting, but are stated
                stated = keys.join(grouped.filter("doc_len > 0").select(*KEYS), KEYS, "left_anti")
                segment = self._segment(grouped, stated, rows.groupBy(*KEYS).agg(F.max("__seq").alias("seq")), settings, old)
                gone = before.filter("doc_len is not null").groupBy("site_id").agg(F.count("*"), F.sum("doc_len")).collect() if before is not None else []
                less = {str(r[0]): (r[1], r[2]) for r in gone}
                more = self._totals(segment)

                def change(m2: dict | None) -> dict:
                    m2 = m2 or m
                    zero = (0, 0)
                    totals = {s: [m2["totals"].get(s, zero)[k] - less.get(s, zero)[k] + more.get(s, zero)[k] for k in (0, 1)] for s in m2["totals"].keys() | more.keys()}
                    return m2 | {"segments": [*m2["segments"], {"path": segment, "level": 0, "replaces": []}], "totals": totals}

                self._publish(change)
                self._compact()
            finally:
                for p in (raw, f"{raw}-rows"):
                    self._files().delete(self._jpath(p.removeprefix(f"{self.path}/")), True)
        return self.read()

    def delete(self, keys: DataFrame) -> Index:
        """Takes elements (site_id, element_id) out."""
        return self.upsert(elements(keys, "gone", F.col("element_id"), F.col("site_id"), enabled=False))

    def _compact(self) -> None:
        """Merges the newest segments of a level as long as `fanout` of them lie together; the oldest of all stay last."""
        while True:
            m = self._manifest()
            segments = m["segments"]
            level = segments[-1]["level"]
            run = 0
            while run < len(segments) and segments[-1 - run]["level"] == level and not segments[-1 - run].get("base"):
                run += 1
            if run < self.fanout:
                return
            # once what lies above the base would be a level of its own again, it is merged into it
            whole = run == len(segments) or level >= 2 and segments[-1 - run].get("base", False)
            old = segments if whole else segments[-run:]
            part = m | {"segments": old}
            name = f"seg-{uuid.uuid4().hex}"
            settings = Settings(**m["settings"] | {"ngram_sizes": tuple(m["settings"]["ngram_sizes"])})
            self._live(part, "postings").repartitionByRange("site_id", "term").sortWithinPartitions("site_id", "term").write.partitionBy("site_id").parquet(f"{self.path}/{name}/postings")
            docs = self._live(part, "elements")
            if whole:  # nothing below them: only a sequence number is a reason to remember what is gone
                docs = docs.filter("doc_len is not null or seq is not null")
            docs.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).write.partitionBy("site_id").parquet(f"{self.path}/{name}/elements")
            words = self._live(part, "words").groupBy("site_id", "term").agg(F.sum("doc_freq").alias("doc_freq"))
            self._put_words(words.filter("doc_freq > 0" if whole else "doc_freq <> 0"), name, settings)
            merged = {"path": name, "level": 0 if whole else level + 1, "replaces": [] if whole else sorted({s for o in old for s in o["replaces"]}), "base": whole}
            names = {o["path"] for o in old}

            def change(m2: dict, names=names, merged=merged) -> dict:
                at = next(k for k, o in enumerate(m2["segments"]) if o["path"] in names)
                rest = [o for o in m2["segments"] if o["path"] not in names]
                return m2 | {"segments": [*rest[:at], merged, *rest[at:]]}

            self._publish(change)

    def drop(self) -> None:
        self._files().delete(self._jpath(), True)


KEYS = ["site_id", "element_id"]
STORED = {
    "postings": TABLES["postings"],
    "elements": "site_id int, element_id bigint, doc_len bigint, terms array<string>, seq array<bigint>",
    "words": TABLES["term_dict"],
}


@dataclass
class JdbcStore:
    """The index tables in a database, through Spark's JDBC source. Each write makes tables
    of its own and then a row in the table of versions: what a lazy index still reads is never
    overwritten, and older versions but one go afterwards. The arrays of n-grams stay out
    and are derived again on reading. Reads are split by element id. A table that only one
    session can create keeps other writers out."""

    spark: SparkSession
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    prefix: str = "search_"
    term_length: int = 4000  # a longer term fails the write: terms are columns that the database compares
    partitions: int = 16
    keep: int = 2

    def _do(self, *statements: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if driver := self.properties.get("driver"):
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
        p = jvm.java.util.Properties()
        for k, v in self.properties.items():
            p.setProperty(k, v)
        c = jvm.java.sql.DriverManager.getConnection(self.url, p)
        try:
            for sql in statements:
                s = c.createStatement()
                s.executeUpdate(sql)
                s.close()
        finally:
            c.close()

    def _versions(self) -> list:
        try:
            rows = self.spark.read.jdbc(self.url, f"{self.prefix}versions", properties=self.properties).collect()
        except Exception as x:
            if not self._has("versions"):
                return []
            raise x
        return sorted(rows, key=lambda r: r["version"])

    def _has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.java.util.Properties()
        for k, v in self.properties.items():
            p.setProperty(k, v)
        c = jvm.java.sql.DriverManager.getConnection(self.url, p)
        try:
            found = c.getMetaData().getTables(None, None, None, None)
            while found.next():
                if found.getString("TABLE_NAME").lower() == f"{self.prefix}{name}".lower():
                    return True
            return False
        finally:
            c.close()

    def write(self, index: Index) -> Index:
        try:
            self._do(f"CREATE TABLE {self.prefix}lock (n INTEGER)")
        except Exception as x:
            if self._has("lock"):
                raise StoreLocked(f"another writer holds {self.prefix}lock") from x
            raise
        try:
            before = self._versions()
            new = before[-1]["version"] + 1 if before else 1
            for name in TABLES:
                rows = getattr(index, name).drop("ngrams")
                writer = rows.write.option("createTableColumnTypes", f"term VARCHAR({self.term_length})") if "term" in rows.columns else rows.write
                writer.jdbc(self.url, f"{self.prefix}{name}_v{new}", mode="overwrite", properties=self.properties)
            stats = self.spark.read.jdbc(self.url, f"{self.prefix}doc_stats_v{new}", properties=self.properties)
            row = stats.agg(F.lit(new).alias("version"), F.count("*").alias("total_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_length"), F.coalesce(F.min("element_id"), F.lit(0)).alias("least"), F.coalesce(F.max("element_id"), F.lit(0)).alias("most"))
            row = row.withColumns({"settings": F.lit(json.dumps(asdict(index.settings))), "schema_version": F.lit(SCHEMA_VERSION)})
            self.spark.createDataFrame(row.collect(), row.schema).write.jdbc(self.url, f"{self.prefix}versions", mode="append", properties=self.properties)
            for r in before[: max(0, len(before) + 1 - self.keep)]:
                self._do(*[f"DROP TABLE {self.prefix}{n}_v{r['version']}" for n in TABLES], f"DELETE FROM {self.prefix}versions WHERE {self._quoted('version')} = {r['version']}")
        finally:
            self._do(f"DROP TABLE {self.prefix}lock")
        return self.read()

    def _quoted(self, column: str) -> str:
        dialect = self.spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url)
        return dialect.quoteIdentifier(column)

    def write_site(self, index: Index, site_id: int) -> Index:
        return self.write(from_postings(self.read().postings.filter(F.col("site_id") != site_id).unionByName(index.postings), index.settings))

    def upsert(self, changed: DataFrame, handles: list[str] | None = None, order: str | None = None) -> Index:
        return self.write(upsert(self.read(), latest(changed, order).drop(order) if order else changed, handles))

    def read(self, settings: Settings | None = None) -> Index:
        found = self._versions()
        if not found:
            raise FileNotFoundError(f"no index with the prefix {self.prefix}")
        v = found[-1]
        own = Settings(**(s := json.loads(v["settings"])) | {"ngram_sizes": tuple(s["ngram_sizes"])})

        def table(n: str) -> DataFrame:
            name = f"{self.prefix}{n}_v{v['version']}"
            if n == "term_dict" or v["most"] <= v["least"]:
                return self.spark.read.jdbc(self.url, name, properties=self.properties)
            return self.spark.read.jdbc(self.url, name, column="element_id", lowerBound=v["least"], upperBound=v["most"] + 1, numPartitions=self.partitions, properties=self.properties)

        words = with_ngrams(table("term_dict").drop("ngram_count"), settings or own)
        return Index(table("postings"), table("doc_stats"), words, settings or own, (v["total_docs"], v["total_length"]))

    def drop(self) -> None:
        for r in self._versions():
            self._do(*[f"DROP TABLE {self.prefix}{n}_v{r['version']}" for n in TABLES])
        if self._has("versions"):
            self._do(f"DROP TABLE {self.prefix}versions")


def open_store(spark: SparkSession, kind: str | None = None, path: str | None = None, **options):
    """A store by kind; SPARROWDEX_STORE and SPARROWDEX_PATH win over the arguments."""
    kind = os.environ.get("SPARROWDEX_STORE") or kind or DEFAULT.store
    path = os.environ.get("SPARROWDEX_PATH") or path
    if kind == "memory":
        return MemoryStore(spark)
    if kind in ("parquet", "jdbc") and not path:
        raise ValueError(f"a {kind} store needs a path")
    if kind == "parquet":
        return ParquetStore(spark, path, **options)
    if kind == "jdbc":
        return JdbcStore(spark, path, **options)
    raise ValueError(f"unknown store: {kind}")
