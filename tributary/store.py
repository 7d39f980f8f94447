"""Stored snapshots: Parquet directories with a manifest, in isolated namespaces; time to live, refresh, materialized tables, vacuum."""

from __future__ import annotations

import fcntl
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tributary.errors import EngineError
from tributary.storage import Files, local

_NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.-]{0,127}")
#: Seconds to wait for the lock of a store that isn't on a local or mounted disk.
LOCK_S = 60
#: Seconds for which a replaced snapshot is kept.
GRACE_S = 3600
_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(duration: str | int | float) -> float:
    """"90s", "1h30m", "7d" or a number of seconds."""
    if isinstance(duration, (int, float)):
        return float(duration)
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*(ms|[smhdw])", duration)
    if not parts or re.sub(r"(\d+(?:\.\d+)?)\s*(ms|[smhdw])\s*", "", duration).strip():
        raise EngineError("CONFIG_DURATION", f"no duration: {duration!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name) or ".." in name:
        raise EngineError("INVALID_NAME", f"{name!r}: letters, digits, '_', '-' and '.' only")
    return name


class Store:
    """Snapshots of one namespace under ``root/namespace``. Entries are pinned (materialized) or expire (cached). A write goes to a new directory first and
    becomes visible by the manifest's replacement, so readers see the old snapshot or the new one whole; the manifest is guarded by a file lock.

    ``root`` is the URI of a folder that all executors share, file: being a mounted one. A path without a scheme is the driver's own and refused on a cluster,
    whose executors would each write their part of a snapshot to a disk of their own."""

    def __init__(self, spark: SparkSession, root: str, namespace: str = "default"):
        self.spark, self.root, self.namespace = spark, root, check_name(namespace)
        if "://" not in root and not root.startswith("file:") and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise EngineError("STORE_NOT_SHARED", f"{root!r} names no file system that all executors share; give the root as a URI, file:// for a mounted one")
        own = local(root)
        self.files = None if own is not None else Files(spark, root)
        self.path = os.path.join(root if own is None else own, namespace)
        self.uri = self.path if self.files else "file://" + os.path.abspath(self.path)
        if not self.files:
            os.makedirs(self.path, exist_ok=True)

    @property
    def _manifest(self) -> str:
        return os.path.join(self.path, "manifest.json")

    def entries(self) -> dict[str, dict]:
        try:
            if self.files:
                return json.loads(self.files.read(self._manifest)) if self.files.exists(self._manifest) else {}
            with open(self._manifest) as f:
                return json.load(f)
        except FileNotFoundError:
            return {}
        except ValueError:
            (self.files or os).replace(self._manifest, f"{self._manifest}.bad-{uuid.uuid4().hex[:8]}")
            return {}

    @contextmanager
    def _locked(self):
        if self.files:
            with self._lock_file():
                m = self.entries()
                yield m
                tmp = f"{self._manifest}.{uuid.uuid4().hex}"
                self.files.write(tmp, json.dumps(m, indent=1).encode())
                self.files.replace(tmp, self._manifest)
            return
        with open(os.path.join(self.path, ".lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            m = self.entries()
            yield m
            tmp = f"{self._manifest}.{uuid.uuid4().hex}"
            with open(tmp, "w") as f:
                json.dump(m, f, indent=1)
                f.flush()
                os.fsync(f.fileno())
            os.replace(tmp, self._manifest)

    @contextmanager
    def _lock_file(self):
        """The lock where there is no flock: a file that only one can create."""
        lock, end = f"{self.path}/.lock", time.time() + LOCK_S
        while True:
            try:
                self.files.write(lock, b"", new=True)
                break
            except Exception as e:
                if not self.files.exists(lock):
                    raise
                if time.time() > end:
                    raise EngineError("STORE_LOCKED", f"{lock} has been there for {LOCK_S} s; delete it if its owner is gone") from e
                time.sleep(0.05)
        try:
            yield
        finally:
            self.files.delete(lock)

    def _remove(self, part: str) -> None:
        p = os.path.join(self.path, part)
        if self.files:
            self.files.delete(p)
        else:
            shutil.rmtree(p, ignore_errors=True)

    def put(self, name: str, df: DataFrame, pinned: bool, spec: dict | None = None, ttl: str | float | None = None) -> dict:
        """Write a snapshot and make it the entry; the one before it stays for GRACE_S, for queries that still read it. Cached tables are stored whole, never as
        one query's part of them."""
        check_name(name)
        part = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.uri}/{part}")
        entry = {"path": part, "pinned": pinned, "spec": spec or {}, "written": time.time(), "ttl": seconds(ttl) if ttl is not None else None, "schema": df.schema.json()}
        with self._locked() as m:
            was = m.get(name)
            old = [*was.get("old", []), [was["path"], time.time()]] if was else []
            entry["old"] = [o for o in old if time.time() - o[1] < GRACE_S]
            m[name] = entry
        for path, at in old:
            if time.time() - at >= GRACE_S:
                self._remove(path)
        return entry

    def fresh(self, name: str) -> bool:
        e = self.entries().get(name)
        return bool(e) and self._whole(e) and (e["pinned"] or e["ttl"] is None or time.time() - e["written"] < e["ttl"])

    def _whole(self, e: dict) -> bool:
        return (self.files or os.path).exists(os.path.join(self.path, e["path"], "_SUCCESS"))

    def get(self, name: str) -> DataFrame:
        """The snapshot, expired or not."""
        from pyspark.sql.types import StructType

        e = self.entries().get(name)
        if not e:
            raise EngineError("UNKNOWN_MATERIALIZED", f"nothing stored as {name!r} in {self.namespace}")
        if not self._whole(e):
            self.quarantine(name)
            raise EngineError("UNKNOWN_MATERIALIZED", f"the snapshot {name!r} is damaged and was set aside")
        return self.spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(f"{self.uri}/{e['path']}")

    def cached(self, name: str, make: Callable[[], DataFrame], ttl: str | float | None) -> DataFrame:
        """A fresh snapshot, or the table fetched now and stored."""
        if not self.fresh(name):
            self.put(name, make(), False, {"kind": "cache"}, ttl)
        return self.get(name)

    def drop(self, name: str) -> None:
        with self._locked() as m:
            e = m.pop(name, None)
        if not e:
            raise EngineError("UNKNOWN_MATERIALIZED", f"nothing stored as {name!r}")
        for path in (e["path"], *(o[0] for o in e.get("old", []))):
            self._remove(path)

    def invalidate(self, prefix: str = "") -> list[str]:
        """Forget cached entries; pinned ones stay."""
        names = [n for n, e in self.entries().items() if not e["pinned"] and n.startswith(prefix)]
        for n in names:
            self.drop(n)
        return names

    def quarantine(self, name: str) -> None:
        with self._locked() as m:
            e = m.pop(name, None)
        for path, _ in e.get("old", []) if e else ():
            self._remove(path)
        if e and (self.files or os.path).exists(p := os.path.join(self.path, e["path"])):
            (self.files or os).replace(p, f"{p}.bad")

    def vacuum(self) -> list[str]:
        """Remove expired entries and directories that no entry names; snapshots replaced less than GRACE_S ago are still named."""
        now, gone = time.time(), []
        with self._locked() as m:
            for n in [n for n, e in m.items() if not e["pinned"] and e["ttl"] is not None and now - e["written"] >= e["ttl"]]:
                gone.append(m.pop(n)["path"])
            for e in m.values():
                e["old"] = [o for o in e.get("old", []) if now - o[1] < GRACE_S]
            kept = {p for e in m.values() for p in (e["path"], *(o[0] for o in e["old"]))}
        for d in self.files.folders(self.path) if self.files else os.listdir(self.path):
            if (self.files or os.path.isdir(os.path.join(self.path, d))) and d not in kept:
                gone.append(d)
        for d in gone:
            self._remove(d)
        return sorted(set(gone))


def namespaces(root: str, spark: SparkSession | None = None) -> list[str]:
    own = local(root)
    if own is None:
        return Files(spark, root).folders(root)
    root = own
    return sorted(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d))) if os.path.isdir(root) else []


def drop_namespace(root: str, namespace: str, spark: SparkSession | None = None) -> None:
    own = local(root)
    if own is None:
        Files(spark, root).delete(f"{root}/{check_name(namespace)}")
    else:
        shutil.rmtree(os.path.join(own, check_name(namespace)), ignore_errors=True)
