"""The document store: Parquet partitioned by index_locale, with small folders of changes over it.

A change writes only itself, so its cost does not grow with the store; readers lay the changes over the base, and once there
are MOST_CHANGES of them the locales that they touch are written anew, each base folder keeping the others. A manifest names
the folders that count, and which locales of them. It is written
after them, so readers see the old rows or the new ones, and a run that fails leaves the store as it was. One writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_CHANGES = 16


def index_name(prefix: str, locale: str) -> str:
    """<prefix>_<locale>; the locale is cut to two to five letters a-z, and the whole name is checked."""
    name = f"{prefix}_{re.sub('[^a-z]', '', locale.lower())[:5]}"
    if not re.fullmatch(r"t_[a-f0-9]{16}_[a-z]{2,5}", name):
        raise ValueError(f"{name} is no index name")
    return name


def index_names(prefix: str, locale: Column) -> Column:
    """index_name() of a column of locales; null where it is no index name."""
    name = F.concat(F.lit(f"{prefix}_"), F.substring(F.regexp_replace(F.lower(locale), "[^a-z]", ""), 1, 5))
    return F.when(name.rlike(r"^t_[a-f0-9]{16}_[a-z]{2,5}$"), name)


def routed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("index_locale", F.regexp_extract(F.lower("locale"), "^[a-z]{2,3}", 0))


class Versioned:
    """A folder whose state is its latest manifest: written last, under the next number, so readers see all of a change or nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._known: tuple[int, str] = (0, "")

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _names_of(self, folder: str) -> list[str]:
        """What a folder anywhere holds; nothing if it is not there."""
        at = self._hadoop.fs.Path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """The number of the latest manifest; 0 before the first write."""
        return max((int(n) for n in self._names("log") if n.isdigit()), default=0)

    def _manifest(self) -> dict | None:
        n = self.version()
        if n and n != self._known[0]:  # a number's manifest never changes
            self._known = n, self.spark.read.text(f"{self.path}/log/{n}", wholetext=True).first()[0]
        return json.loads(self._known[1]) if n else None

    def _commit(self, manifest: dict) -> None:
        target, draft = self._at(f"log/{self.version() + 1}"), self._at(f"log/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"{self.path} has another writer")


class Store(Versioned):
    def _table(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.path}/{folder}")

    def _base(self, m: dict, but: set[str] | frozenset = frozenset()) -> DataFrame:
        """The base's rows, of each folder its locales without `but`: other partitions are not read."""
        out = None
        for folder, schema, locales in m["base"]:
            part = self._table(folder, schema).where(F.coalesce("index_locale", F.lit("")).isin([x for x in locales if x not in but]))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        """All rows: those of the base that no change names, and the last change of each other id, unless it is gone."""
        m = self._manifest()
        return None if m is None else self._read(m)

    def _read(self, m: dict) -> DataFrame:
        purged = {schema: n for n, (folder, schema) in enumerate(m["changes"]) if not folder}
        base, changes = self._base(m, set(purged)), None
        for n, (folder, schema) in enumerate(m["changes"]):
            if not folder:
                continue
            change = self._table(folder, schema).withColumn("__n", F.lit(n))
            later = [k for k, at in purged.items() if at > n]
            if later and "index_locale" in change.columns:  # what was put there before goes, deletions stay
                change = change.withColumn("__gone", F.col("__gone") | F.coalesce(F.col("index_locale").isin(*later), F.lit(False)))
            changes = change if changes is None else changes.unionByName(change, allowMissingColumns=True)
        if changes is None:
            return base
        last = changes.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__n")))).where("__k = 1")
        fresh = last.where("NOT __gone").drop("__n", "__k", "__gone")
        return base.join(changes.select("id").distinct(), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)

    def _written(self, docs: DataFrame) -> list:
        """A new base folder: its name, schema and locales."""
        folder = f"base-{uuid.uuid4().hex}"
        docs.write.partitionBy("index_locale").parquet(f"{self.path}/{folder}")
        names = [n.partition("=")[2] for n in self._names(folder) if n.startswith("index_locale=")]
        return [folder, docs.schema.json(), ["" if n == "__HIVE_DEFAULT_PARTITION__" else n for n in names]]

    def write(self, docs: DataFrame) -> None:
        """All rows of the store from now on."""
        docs = docs if "index_locale" in docs.columns else routed(docs)
        self._commit({"base": [self._written(docs)], "changes": []})

    def merge(self) -> None:
        """Takes the changes into the base: only locales that they name, or whose rows they replace, are written anew."""
        m = self._manifest()
        if m is None or not m["changes"]:
            return
        touched, ids = {schema for folder, schema in m["changes"] if not folder}, None
        for folder, schema in m["changes"]:
            if folder:
                change = self._table(folder, schema)
                if "index_locale" in change.columns:
                    touched |= {r[0] or "" for r in change.select("index_locale").distinct().collect()}
                ids = change.select("id") if ids is None else ids.unionByName(change.select("id"))
        if ids is not None:
            touched |= {r[0] or "" for r in self._base(m).join(ids.distinct(), "id", "left_semi").select("index_locale").distinct().collect()}
        kept = [[folder, schema, [x for x in locales if x not in touched]] for folder, schema, locales in m["base"]]
        fresh = self._written(self._read(m).where(F.coalesce("index_locale", F.lit("")).isin(sorted(touched))))
        base = [b for b in [*kept, fresh] if b[2]]
        self._commit({"base": base or [fresh], "changes": []})

    def apply(self, changes: DataFrame) -> None:
        """Rows with a column __gone: true deletes the id, false puts the row in. Ids are distinct."""
        m = self._manifest()
        if m is None:
            return self.write(changes.where("NOT __gone").drop("__gone"))
        folder = f"change-{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.path}/{folder}")
        self._commit({**m, "changes": [*m["changes"], [folder, changes.schema.json()]]})
        if len(m["changes"]) + 1 >= MOST_CHANGES:
            self.merge()
        return None

    def upsert(self, changed: DataFrame) -> None:
        """The last write counts; of one id's rows within it, that with the largest indexed_at, then the last in a fixed order."""
        w = Window.partitionBy("id").orderBy(F.desc("indexed_at"), F.desc(F.xxhash64(*(f"`{c}`" for c in changed.columns))))
        one = changed.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
        self.apply(routed(one).withColumn("__gone", F.lit(False)))

    def delete(self, ids: DataFrame) -> int:
        """Deletes in all locales; returns how many rows went."""
        current = self.read()
        return 0 if current is None else self._drop(current.join(ids.select("id").distinct(), "id", "left_semi"))

    def delete_protected(self) -> int:
        current = self.read()
        return 0 if current is None else self._drop(current.where("coalesce(is_protected, false)"))

    def purge(self, locale: str | None = None) -> int:
        """Empties one locale or all, by the manifest alone: no other locale is written anew. Returns how many rows went."""
        m, current = self._manifest(), self.read()
        if m is None:
            return 0
        gone = current if locale is None else current.where(F.col("index_locale") == locale)
        n = gone.count()
        if locale is None:
            self.write(current.limit(0))
        else:
            self._commit({**m, "changes": [*m["changes"], ["", locale]]})
        return n

    def ensure(self, config) -> bool:
        """Keeps an index's settings (IndexConfig) beside the store; whether they were written: equal ones are left alone."""
        text = json.dumps(asdict(config), sort_keys=True, ensure_ascii=False)
        at = self._at(f"config/{config.locale}.json")
        if self.config(config.locale) == json.loads(text):
            return False
        out = self._fs.create(at, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def config(self, locale: str) -> dict | None:
        """The kept settings of a locale's index."""
        at = self._at(f"config/{locale}.json")
        return json.loads(self.spark.read.text(f"{self.path}/config/{locale}.json", wholetext=True).first()[0]) if self._fs.exists(at) else None

    def vacuum(self) -> int:
        """Removes the folders that the latest manifest does not name, for when nobody reads older ones; returns how many."""
        m = self._manifest()
        used = {*(b[0] for b in m["base"]), *(c[0] for c in m["changes"] if c[0])} if m else set()
        gone = [n for n in self._names("") if n.startswith(("base-", "change-")) and n not in used]
        for n in gone:
            self._fs.delete(self._at(n), True)
        return len(gone)

    def _drop(self, rows: DataFrame) -> int:
        before = self.version()
        self.apply(rows.select("id", F.lit(True).alias("__gone")))
        m = json.loads(self.spark.read.text(f"{self.path}/log/{before + 1}", wholetext=True).first()[0])
        return self._table(*m["changes"][-1]).count()
