"""Persistent stores: versioned maps, pickles, and directories that bundle them.

A store is a folder. Writing claims the next version number that no other writer has, makes folder v<number> and then
replaces the pointer file in one step, so readers see whole versions, a map may be written from itself, and two writers
never share a folder (the last pointer stands). The pointer may carry a note, which changes together with the version. Small files go through Hadoop's file system, so any path Spark reads works.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import SparkSession

from ..operators.pmap import MapSpec, PMap

MODES = ("new", "exists", "either")


class Files:
    """The few file operations that stores need, on any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replace a small file; a reader sees the old or the new one."""
        fs, p = self._at(path)
        draft = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(p), how)

    def claim(self, path: str) -> bool:
        """Make an empty file; false if it is there already."""
        fs, p = self._at(path)
        return fs.createNewFile(p)


@dataclass
class Catalog:
    """Opens stores by name; the same name gives the same handle and must agree on type and const."""

    spark: SparkSession
    opened: dict[str, tuple[str, bool, Any]] = field(default_factory=dict)

    def _open(self, path: str, kind: str, mode: str, const: bool, make: Callable[[bool], Any]) -> Any:
        if mode not in MODES:
            raise ValueError(f"mode {mode} is none of {MODES}")
        if path in self.opened:
            k, c, handle = self.opened[path]
            if k != kind or c != const:
                raise TypeError(f"{path} is open as {'const ' if c else ''}{k}")
            return handle
        there = Files(self.spark).exists(path)
        if mode == "new" and there:
            raise FileExistsError(path)
        if not there and (mode == "exists" or const):
            raise FileNotFoundError(path)
        handle = make(there)
        self.opened[path] = (kind, const, handle)
        return handle

    def map(self, path: str, spec: MapSpec | None = None, types: dict[str, str] | None = None, mode: str = "either", const: bool = False) -> MapStore:
        return self._open(path, "map", mode, const, lambda there: MapStore.open(self.spark, path, spec, types, there, const))

    def pickle(self, path: str, load: Callable[[str | None], Any], dump: Callable[[Any], str], mode: str = "either", const: bool = False) -> Pickle:
        return self._open(path, "pickle", mode, const, lambda there: Pickle.open(self.spark, path, load, dump, there, const))

    def directory(self, path: str, fields: dict[str, Any], mode: str = "either", const: bool = False, params: tuple = ()) -> Directory:
        return self._open(path, "directory", mode, const, lambda there: Directory.open(self, path, fields, there, const, params))


@dataclass
class MapStore:
    spark: SparkSession
    path: str
    map: PMap
    version: int
    const: bool
    note: str = ""

    @classmethod
    def open(cls, spark: SparkSession, path: str, spec: MapSpec | None, types: dict[str, str] | None, there: bool, const: bool) -> MapStore:
        files = Files(spark)
        if there:
            meta = json.loads(files.read(f"{path}/_meta.json"))
            keys = tuple(tuple(k) for k in meta["keys"])
            if spec is None:
                split = tuple(meta["split"]) if meta["split"] else None
                spec = MapSpec(keys, tuple(meta["values"]), meta["default"] or {}, split=split)
            elif spec.keys != keys or list(spec.values) != meta["values"]:
                raise TypeError(f"{path} was declared otherwise")
            current, _, note = files.read(f"{path}/_current").partition(" ")
            version = int(current)
            table = spark.read.schema(meta["schema"]).parquet(f"{path}/v{version}") if version else spark.createDataFrame([], meta["schema"])
            return cls(spark, path, PMap(spec, table, const), version, const, note)
        if spec is None or types is None:
            raise ValueError("a new map needs its declaration")
        store = cls(spark, path, PMap.empty(spark, spec, types), 0, const)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in store.map.table.schema)
        default = None if callable(spec.default) else spec.default
        files.write(f"{path}/_meta.json", json.dumps({"keys": spec.keys, "values": spec.values, "default": default, "split": spec.split, "schema": schema}))
        files.write(f"{path}/_current", "0")
        return store

    def save(self, new: PMap, partitions: int | None = None, note: str = "") -> MapStore:
        """Make new the current version, with its note, sorted by key inside files so that key ranges prune."""
        if self.const:
            raise PermissionError(f"{self.path} is const")
        if new.spec.keys != self.map.spec.keys or new.spec.values != self.map.spec.values:
            raise TypeError("the map was declared otherwise")
        keys = new.spec.key_names
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        files = Files(self.spark)
        version = self.version + 1
        while not files.claim(f"{self.path}/_claim-{version}"):
            version += 1
        to = f"{self.path}/v{version}"
        new.table.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(to)
        files.write(f"{self.path}/_current", f"{version} {note}".rstrip())
        self.note, self.version, self.map = note, version, replace(self.map, table=self.spark.read.schema(new.table.schema).parquet(to))
        return self


@dataclass
class Pickle:
    """Small state with the user's load and dump; load gets None for a new one."""

    spark: SparkSession
    path: str
    value: Any
    load: Callable[[str | None], Any]
    dump: Callable[[Any], str]
    const: bool

    @classmethod
    def open(cls, spark, path, load, dump, there, const) -> Pickle:
        return cls(spark, path, load(Files(spark).read(f"{path}/_state") if there else None), load, dump, const)

    def save(self) -> None:
        if self.const:
            raise PermissionError(f"{self.path} is const")
        Files(self.spark).write(f"{self.path}/_state", self.dump(self.value))

    def copy_to(self, other: Pickle, load: Callable[[str | None], Any] | None = None) -> None:
        """other := this pickle, through its stored form, so that the two share nothing."""
        if other.const:
            raise PermissionError(f"{other.path} is const")
        other.value = (load or other.load)(self.dump(self.value))
        other.save()


@dataclass
class Directory:
    """Named fields: maps (spec, types), nested directories (dict), pickles (load, dump), plain values (anything JSON holds).

    A field given as a callable gets the parameters and the fields before it.
    """

    catalog: Catalog
    path: str
    fields: dict[str, Any]
    const: bool

    @classmethod
    def open(cls, catalog: Catalog, path: str, fields: dict[str, Any], there: bool, const: bool, params: tuple) -> Directory:
        files = Files(catalog.spark)
        plain = json.loads(files.read(f"{path}/_values.json")) if there else {}
        out: dict[str, Any] = {}
        for name, f in fields.items():
            if callable(f):
                f = f(*params, out)
            at = f"{path}/{name}"
            if isinstance(f, tuple) and f and isinstance(f[0], MapSpec):
                out[name] = catalog.map(at, *f, mode="either", const=const)
            elif isinstance(f, tuple) and len(f) == 2 and all(map(callable, f)):
                out[name] = catalog.pickle(at, *f, mode="either", const=const)
            elif isinstance(f, dict) and f.get("_directory"):
                out[name] = catalog.directory(at, {k: v for k, v in f.items() if k != "_directory"}, const=const, params=params)
            else:
                out[name] = plain.get(name, f)
        made = cls(catalog, path, out, const)
        if not there:
            made.save()
        return made

    def __getitem__(self, name: str) -> Any:
        return self.fields[name]

    def __setitem__(self, name: str, value: Any) -> None:
        if self.const:
            raise PermissionError(f"{self.path} is const")
        if name not in self.fields:
            raise KeyError(name)
        self.fields[name] = value

    def _plain(self) -> dict[str, Any]:
        return {k: v for k, v in self.fields.items() if not isinstance(v, (MapStore, Pickle, Directory))}

    def save(self) -> None:
        if self.const:
            raise PermissionError(f"{self.path} is const")
        Files(self.catalog.spark).write(f"{self.path}/_values.json", json.dumps(self._plain()))
        for v in self.fields.values():
            if isinstance(v, (Pickle, Directory)):
                v.save()

    def copy_to(self, other: Directory) -> None:
        """other := this directory, field by field; its maps must be empty."""
        if set(self.fields) != set(other.fields):
            raise TypeError("directories of different declarations cannot be copied")
        for name, v in self.fields.items():
            o = other.fields[name]
            if isinstance(v, MapStore):
                o.save(v.map.copy_to(o.map))
            elif isinstance(v, Pickle):
                v.copy_to(o)
            elif isinstance(v, Directory):
                v.copy_to(o)
            else:
                other[name] = copy.deepcopy(v)
        other.save()
