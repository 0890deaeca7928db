"""Tables that change together, with several writers: numbered log entries that name the files of every table.

A table's rows lie in buckets of a key's hash. A change writes new files for
the buckets it touches, beside those in use, and is nothing until its entry is
put: the next number, by a rename that fails if that number is taken. Who
comes second looks at what the others touched. If it needed none of that, its
entry goes on top of theirs; otherwise its change runs again on their result.
So a reader sees all of a commit or nothing, in all tables at once, and no
writer undoes another's work.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancelake.tables import settle

BUCKETS, TRIES = 64, 20


class Conflict(RuntimeError):
    """Others kept changing what a commit needed."""


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Transaction:
    """One attempt at a change, on the tables as they stand in entry `number`."""

    def __init__(self, log: "Log", number: int, tables: dict):
        self.log, self.number, self.tables = log, number, tables
        self.needs: dict[str, set[str] | None] = {}  # buckets whose rows the change has looked at; None: all
        self.made: dict[str, dict] = {}  # of tables that are new
        self.rewritten: dict[str, dict[str, list[str]]] = {}
        self.added: dict[str, dict[str, list[str]]] = {}

    def _table(self, name: str) -> dict | None:
        return self.tables.get(name) or self.made.get(name)

    def _files(self, name: str, buckets: Iterable[str] | None = None) -> list[str]:
        held = dict((self._table(name) or {}).get("files", {})) | self.rewritten.get(name, {})
        for b, more in self.added.get(name, {}).items():
            held[b] = [*held.get(b, []), *more]
        return [f for b, files in sorted(held.items()) if buckets is None or b in buckets for f in files]

    def _frame(self, name: str, buckets: Iterable[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(self._table(name)["schema"])
        files = [f"{self.log.base}/{f}" for f in self._files(name, buckets)]
        return self.log.spark.read.schema(schema).parquet(*files) if files else self.log.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame | None:
        """The whole table, with this transaction's own changes; a commit that read it goes through only if nobody changes it meanwhile."""
        self.needs[name] = None
        return self._frame(name) if self._table(name) else None

    def peek(self, name: str) -> DataFrame | None:
        """The whole table, without holding the commit to it."""
        return self._frame(name) if self._table(name) else None

    def _opened(self, name: str, rows: DataFrame, key: str | None) -> dict:
        table = self._table(name)
        if table is None:
            if key is None:
                raise KeyError(f"no table {name}, and no key to make it with")
            table = self.made[name] = {"key": key, "buckets": self.log.buckets, "schema": rows.schema.jsonValue(), "files": {}}
            self.needs.setdefault(name, set())
        if key is not None and key != table["key"]:
            raise ValueError(f"{name} is kept by {table['key']}, not by {key}")
        return table

    def _write(self, name: str, rows: DataFrame, table: dict) -> dict[str, list[str]]:
        """New files by bucket."""
        columns = T.StructType.fromJson(table["schema"]).fieldNames()
        folder = f"{name}/v-{uuid.uuid4().hex}"
        b = bucket_of(F.col(table["key"]), table["buckets"])
        rows.select(*columns).withColumn("_bucket", b).write.partitionBy("_bucket").parquet(f"{self.log.base}/{folder}")
        return {f.split("=")[1]: [f"{folder}/{f}"] for f in self.log.folders(folder) if f.startswith("_bucket=")}

    def _touched(self, rows: DataFrame, table: dict) -> list[str]:
        found = rows.select(bucket_of(F.col(table["key"]), table["buckets"]).alias("b")).distinct().collect()  # as many as there are buckets at most
        return sorted(str(r.b) for r in found)

    def append(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """Add rows; it needs nothing, so it never conflicts."""
        table = self._opened(name, rows, key)
        for b, files in self._write(name, rows, table).items():
            self.added.setdefault(name, {}).setdefault(b, []).extend(files)

    def _rewrite(self, name: str, rows: DataFrame, key: str | None, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        table = self._opened(name, rows, key)
        rows = settle(rows, "commit")  # it is read more than once, and the same must come each time
        buckets = self._touched(rows, table)
        if self.needs.get(name, set()) is not None:
            self.needs.setdefault(name, set()).update(buckets)
        fresh = self._write(name, make(self._frame(name, buckets), rows), table)
        for b in buckets:
            self.added.get(name, {}).pop(b, None)
            self.rewritten.setdefault(name, {})[b] = fresh.get(b, [])

    def replace(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """Rows of the same keys go, and these come in their place."""

        def make(old: DataFrame, new: DataFrame) -> DataFrame:
            k = self._table(name)["key"]
            return old.join(new.select(k).distinct(), k, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))

        self._rewrite(name, rows, key, make)

    def merge(self, name: str, rows: DataFrame, on: str, columns: list[str]) -> None:
        """Rows that meet on `on` take the non-null values of columns; rows carries the table's key too."""
        from stancelake.operators.annotation import update_payload

        self._rewrite(name, rows, None, lambda old, new: update_payload(old, new, on, columns))

    def remove(self, name: str, keys: DataFrame) -> None:
        """Rows of these keys go."""

        def make(old: DataFrame, gone: DataFrame) -> DataFrame:
            k = self._table(name)["key"]
            return old.join(gone.select(k).distinct(), k, "left_anti").select(*old.columns)

        self._rewrite(name, keys, None, make)

    def touched(self) -> dict[str, list[str]]:
        names = {*self.rewritten, *self.added, *self.made}
        return {n: sorted({*self.rewritten.get(n, {}), *self.added.get(n, {})}) for n in sorted(names)}

    def on_top_of(self, tables: dict) -> dict:
        """tables with this transaction's changes."""
        out = {n: {**t, "files": dict(t["files"])} for n, t in tables.items()}
        for n, t in self.made.items():
            out.setdefault(n, {**t, "files": {}})
        for n, files in self.rewritten.items():
            out[n]["files"] |= files
        for n, files in self.added.items():
            for b, more in files.items():
                out[n]["files"][b] = [*out[n]["files"].get(b, []), *more]
        return out

    def clashes(self, touched: dict[str, list[str]]) -> bool:
        for name, buckets in touched.items():
            if name in self.needs and (self.needs[name] is None or name in self.made or self.needs[name] & set(buckets)):
                return True
        return False


class Log:
    """Tables under base. Entries go by atomic rename (a hard link on local disks), which HDFS and local disks have; a store without it needs one writer."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS, tries: int = TRIES):
        self.spark, self.base, self.buckets, self.tries = spark, base.rstrip("/"), buckets, tries
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.base}/{name}" if name else self.base)

    def folders(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        return [int(f.removesuffix(".json")) for f in self.folders("_log") if f.endswith(".json")]

    def entry(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.base}/_log/{number:020d}.json", wholetext=True).first()[0])

    def snapshot(self, number: int | None = None) -> tuple[int, dict]:
        """(number, tables) of an entry, the newest one by default."""
        if number is None:
            known = self.numbers()
            if not known:
                return 0, {}
            number = known[-1]
        return number, self.entry(number)["tables"]

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        """A table as of an entry; None if there is none yet."""
        return Transaction(self, *self.snapshot(number)).peek(name)

    def commit(self, change: Callable[[Transaction], None], note: str = "") -> int:
        """Run the change and put its entry, again if others were first with what it needed; the entry's number."""
        for _ in range(self.tries):
            t = Transaction(self, *self.snapshot())
            change(t)
            if not t.touched():
                return t.number
            number = self._put(t, note)
            if number is not None:
                return number
        raise Conflict(f"{self.tries} attempts, and others were first each time")

    def _put(self, t: Transaction, note: str) -> int | None:
        number, tables = t.number, t.tables
        while True:
            entry = {"tables": t.on_top_of(tables), "touched": t.touched(), "at": int(time.time() * 1000), "note": note}
            if self._put_if_absent(number + 1, json.dumps(entry)):
                return number + 1
            number += 1
            other = self.entry(number)
            if t.clashes(other["touched"]):
                return None
            tables = other["tables"]

    def _put_if_absent(self, number: int, text: str) -> bool:
        """Whether the entry went in; it is written whole elsewhere first, so nobody reads half of one."""
        temporary, at = self._path(f"_log/.{uuid.uuid4().hex}"), self._path(f"_log/{number:020d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                file = self.spark._jvm.java.io.File
                self.spark._jvm.java.nio.file.Files.createLink(file(at.toUri().getPath()).toPath(), file(temporary.toUri().getPath()).toPath())
            else:
                how = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
                context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(at), how)
            return True
        except Exception as e:
            if "AlreadyExists" not in str(getattr(e, "java_exception", e)):
                raise
            return False
        finally:
            self._fs.delete(temporary, False)

    def history(self) -> DataFrame:
        """(number, at, note, name, buckets): what each entry touched."""
        rows = []
        for n in self.numbers():
            e = self.entry(n)
            rows += [(n, e["at"], e["note"], name, len(b)) for name, b in e["touched"].items()]
        return self.spark.createDataFrame(rows, "number long, at long, note string, name string, buckets int")

    def tidy(self, keep: int = 10, older_than_s: float = 86_400) -> int:
        """Remove entries but the last `keep`, and files that no entry left names and that are old enough to belong to no writer at work; how many folders went."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"_log/{n:020d}.json"), False)
        used: set[str] = set()
        names: set[str] = set()
        for n in numbers[-keep:]:
            for name, t in self.entry(n)["tables"].items():
                names.add(name)
                used |= {"/".join(f.split("/")[:2]) for files in t["files"].values() for f in files}
        gone, before = 0, (time.time() - older_than_s) * 1000
        for name in names:
            for f in self._fs.listStatus(self._path(name)):
                folder = f"{name}/{f.getPath().getName()}"
                if folder not in used and f.getModificationTime() <= before:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        return gone
