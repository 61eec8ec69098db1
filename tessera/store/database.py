"""A snapshot table store on Parquet: keys, constraints, DML with RETURNING, transactions.

Every commit writes the tables it changed as new Parquet folders and then one new state file, whose exclusive creation
is the commit. Readers see the state they began with. A transaction keeps only what it changes (rows put, keys
deleted); at commit these are laid over the newest snapshot, unless another commit has touched one of the
same keys since, in which case the first committer wins.
"""

from __future__ import annotations

import copy
import json
import re
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import Conflict, ConstraintViolation, EngineError, ResourceLimit, UnknownName, Unsupported
from tessera.operators.versions import overlay
from tessera.session import configure

MAX_CASCADE = 32
ACTIONS = {"no action", "restrict", "cascade", "set null", "set default"}


class _Files:
    """Small files and folders through Hadoop's file systems, so that any store will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root
        self.fs = self._path(root).getFileSystem(self.conf)
        self.fs.mkdirs(self._path(root))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if it is there already. A reader never sees part of it."""
        target, claim, draft = (self._path(f"{self.root}/{n}") for n in (name, f"_claim-{name}", f"_{uuid.uuid4().hex}"))
        if self.fs.exists(target):
            return False
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        # Creation without overwriting is exclusive on any store, while a rename may replace its target: the claim decides.
        try:
            self.fs.create(claim, False).close()
        except Py4JJavaError:
            self._abandoned(claim)
            self.fs.delete(draft, False)
            return False
        done = not self.fs.exists(target) and self.fs.rename(draft, target)
        if not done:
            self.fs.delete(draft, False)
        self.fs.delete(claim, False)
        return bool(done)

    def _abandoned(self, claim) -> None:
        """Remove a claim whose owner has not finished within a minute; its commit never became visible."""
        try:
            if time.time() * 1000 - self.fs.getFileStatus(claim).getModificationTime() > 60_000:
                self.fs.delete(claim, False)
            else:
                time.sleep(0.05)
        except Py4JJavaError:  # it is gone by now
            pass

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]


@dataclass
class _Changes:
    """What a transaction does to one table: rows put, and the keys of rows that are gone or replaced."""

    puts: DataFrame
    gone: DataFrame


@dataclass
class Result:
    """The rows a statement changed: their new values, or for DELETE their old ones."""

    rows: DataFrame
    columns: list[str] = field(default_factory=list)

    def returning(self, *items: str) -> DataFrame:
        """RETURNING: expressions over the changed rows; * for all columns."""
        return self.rows.select(*self.columns).selectExpr(*(items or ("*",)))

    def count(self) -> int:
        return self.rows.count()


def _blooms(meta: dict) -> dict[str, str]:
    """Parquet options: a Bloom filter a row group for each column of the primary key and the unique keys."""
    stored = {c["name"]: c["stored"] for c in meta["columns"]}
    keys = {c for k in (meta["key"], *meta["unique"].values()) for c in k}
    return {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{stored[c]}": "true" for c in sorted(keys)}


#: What may be granted, on the database (*), a schema (name.*) or a table (schema.name).
PRIVILEGES = ("SELECT", "INSERT", "UPDATE", "DELETE", "DDL", "CREATE INDEX")


def _same(a: DataFrame, b: DataFrame, columns: list[str], others: list[str] | None = None) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[o]) for c, o in zip(columns, others or columns, strict=True)))


class Database:
    """Tables below a root folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = configure(spark), root.rstrip("/"), _Files(spark, root)
        if not self._versions():
            self.files.create("state-0.json", json.dumps({"version": 0, "schemas": {"main": {}}}))

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names() if (m := re.fullmatch(r"state-(\d+)\.json", n)))

    def state(self, version: int | None = None) -> dict:
        """The catalog and the tables' folders at a version, by default the newest."""
        return json.loads(self.files.read(f"state-{self._versions()[-1] if version is None else version}.json"))

    def begin(self) -> Transaction:
        """A transaction over the newest snapshot."""
        return Transaction(self)

    def run(self, statement, retries: int = 32):
        """statement(transaction), committed at once; overtaken attempts are repeated."""
        for left in reversed(range(retries)):
            work = self.begin()
            out = statement(work)
            try:
                work.commit()
                return out
            except Conflict:
                if not left:
                    raise

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table, now or as of a version."""
        return Transaction(self, version).table(name)

    # Autocommit forms of the transaction's statements.
    def create_schema(self, *a, **b):
        return self.run(lambda t: t.create_schema(*a, **b))

    def create_table(self, *a, **b):
        return self.run(lambda t: t.create_table(*a, **b))

    def drop_table(self, *a, **b):
        return self.run(lambda t: t.drop_table(*a, **b))

    def alter(self, *a, **b):
        return self.run(lambda t: t.alter(*a, **b))

    def create_index(self, *a, **b):
        return self.run(lambda t: t.create_index(*a, **b))

    def insert(self, *a, **b):
        return self.run(lambda t: t.insert(*a, **b))

    def update(self, *a, **b):
        return self.run(lambda t: t.update(*a, **b))

    def delete(self, *a, **b):
        return self.run(lambda t: t.delete(*a, **b))


class Transaction:
    """Statements over one snapshot. A statement that fails leaves the transaction as it was before it."""

    def __init__(self, db: Database, version: int | None = None) -> None:
        self.db, self.spark = db, db.spark
        self.base = db.state(version)
        self.catalog = copy.deepcopy(self.base["schemas"])
        self.grants = {tuple(g) for g in self.base.get("grants", [])}  # (user, privilege, object)
        self.changes: dict[str, _Changes] = {}
        self.ddl: set[str] = set()
        self.schema, self.open = "main", True

    # Names and tables
    def use_schema(self, name: str) -> None:
        if name.lower() not in self.catalog:
            raise UnknownName(f"no schema {name}")
        self.schema = name.lower()

    def _name(self, table: str) -> str:
        parts = table.lower().split(".")
        if len(parts) > 2:
            raise Unsupported("names have at most a schema and a table")
        return table.lower() if len(parts) == 2 else f"{self.schema}.{parts[0]}"

    def meta(self, table: str) -> dict:
        schema, name = self._name(table).split(".")
        if name not in self.catalog.get(schema, {}):
            raise UnknownName(f"no table {table}")
        return self.catalog[schema][name]

    def _stored(self, meta: dict) -> DataFrame:
        """The table as written; columns added since read their backfill default."""
        kinds = {c["name"]: T._parse_datatype_string(c["type"]) for c in meta["columns"]}
        if not meta["path"]:
            return self.spark.createDataFrame([], T.StructType([T.StructField(n, k) for n, k in kinds.items()]))
        files = T.StructType([T.StructField(c["stored"], kinds[c["name"]]) for c in meta["columns"] if c["written"]])
        rows = self.spark.read.schema(files).parquet(meta["path"])
        return rows.select(*[(F.col(f"`{c['stored']}`") if c["written"] else F.expr(c["backfill"] or "NULL")).cast(kinds[c["name"]]).alias(c["name"]) for c in meta["columns"]])

    def table(self, name: str) -> DataFrame:
        """The table as this transaction sees it, its own writes included."""
        full, meta = self._name(name), self.meta(name)
        rows = self._stored(meta)
        change = self.changes.get(full)
        return overlay(rows, change.puts, change.gone, meta["key"]) if change else rows

    def sql(self, text: str) -> DataFrame:
        """A query over {table} names."""
        names = set(re.findall(r"{([\w.]+)}", text))
        text = re.sub(r"{([\w.]+)}", lambda m: "{" + m[1].replace(".", "_") + "}", text)
        return self.spark.sql(text, **{n.replace(".", "_"): self.table(n) for n in names})

    # Data definition. As for all statements, a definition that fails leaves nothing behind.
    def create_table(self, *a, **b) -> None:
        """columns: name to Spark type; key: the mandatory primary key; defaults: name to literal. See _create_table for all options."""
        return self._statement(lambda: self._create_table(*a, **b))

    def drop_table(self, *a, **b) -> None:
        """DROP TABLE; refused while another table's foreign key refers to it."""
        return self._statement(lambda: self._drop_table(*a, **b))

    def alter(self, *a, **b) -> None:
        """One operation of ALTER TABLE: add, rename or drop a column, set/drop default, set/drop not null, add a check, unique or foreign key, drop a constraint."""
        return self._statement(lambda: self._alter(*a, **b))

    def create_index(self, *a, **b) -> None:
        """Metadata; a UNIQUE index is refused over duplicates and enforced from then on."""
        return self._statement(lambda: self._create_index(*a, **b))

    def create_schema(self, name: str, if_not_exists: bool = False) -> None:
        if name.lower() in self.catalog:
            if if_not_exists:
                return
            raise Conflict(f"schema {name} exists")
        self.catalog[name.lower()] = {}
        self.ddl.add(name.lower())

    def _create_table(self, name: str, columns: dict[str, str], key: list[str], not_null: list[str] = (), defaults: dict[str, str] | None = None, unique: dict[str, list[str]] | None = None, checks: dict[str, str] | None = None, foreign_keys: list[dict] | None = None, if_not_exists: bool = False) -> None:
        """columns: name to Spark type; key: the mandatory primary key; defaults: name to literal."""
        full = self._name(name)
        schema, table = full.split(".")
        if schema not in self.catalog:
            raise UnknownName(f"no schema {schema}")
        if table in self.catalog[schema]:
            if if_not_exists:
                return
            raise Conflict(f"table {name} exists")
        if not key or any(k not in columns for k in key):
            raise Unsupported("a table needs a primary key over its own columns")
        required = {*not_null, *key}
        self.catalog[schema][table] = {
            "columns": [{"name": c, "type": t, "nullable": c not in required, "default": (defaults or {}).get(c), "backfill": None, "stored": f"{c}", "written": True} for c, t in columns.items()],
            "key": list(key), "unique": {}, "indexes": {}, "checks": {}, "foreign": {}, "path": None, "changed": 0,
        }
        self.ddl.add(full)
        for n, cols in (unique or {}).items():
            self.alter(name, "add unique", name=n, columns=cols)
        for n, expr in (checks or {}).items():
            self.alter(name, "add check", name=n, expression=expr)
        for fk in foreign_keys or []:
            self.alter(name, "add foreign key", **fk)

    def _drop_table(self, name: str, if_exists: bool = False) -> None:
        full = self._name(name)
        schema, table = full.split(".")
        if table not in self.catalog.get(schema, {}):
            if if_exists:
                return
            raise UnknownName(f"no table {name}")
        if any(fk["parent"] == full for t, _, fk in self._foreign_keys() if t != full):
            raise ConstraintViolation(f"{name} is referenced by a foreign key")
        del self.catalog[schema][table]
        self.changes.pop(full, None)
        self.ddl.add(full)

    def _alter(self, table: str, operation: str, **o) -> None:
        """One operation: add column, rename column, set/drop default, set/drop not null, add/drop check, unique, foreign key."""
        meta, full = self.meta(table), self._name(table)
        column = lambda n: next((c for c in meta["columns"] if c["name"].lower() == n.lower()), None)
        if "column" in o and operation != "add column" and column(o["column"]) is None:
            raise UnknownName(f"no column {o['column']}")
        if operation == "add column":
            if column(o["column"]):
                raise Conflict(f"column {o['column']} exists")
            if o.get("not_null") and o.get("default") is None and not self.table(table).isEmpty():
                raise ConstraintViolation("existing rows would be NULL")
            fresh = self.changes.get(full)
            meta["columns"].append({"name": o["column"], "type": o["type"], "nullable": not o.get("not_null"), "default": o.get("default"), "backfill": o.get("default"), "stored": f"{o['column']}_{uuid.uuid4().hex[:8]}", "written": False})
            if fresh:
                fresh.puts = fresh.puts.withColumn(o["column"], F.expr(o.get("default") or "NULL").cast(o["type"]))
        elif operation == "rename column":
            old, new = column(o["column"]), o["to"]
            if column(new):
                raise Conflict(f"column {new} exists")
            was = old["name"]
            if any(re.search(rf"\b{re.escape(was)}\b", e, re.I) for e in meta["checks"].values()):
                raise Unsupported("a CHECK constraint names the column")
            old["name"] = new
            swap = lambda names: [new if n == was else n for n in names]
            meta["key"] = swap(meta["key"])
            meta["unique"] = {n: swap(c) for n, c in meta["unique"].items()}
            for child, _, fk in self._foreign_keys():
                if child == full:
                    fk["columns"] = swap(fk["columns"])
                if fk["parent"] == full:
                    fk["parent_columns"] = swap(fk["parent_columns"])
            if full in self.changes:
                c = self.changes[full]
                self.changes[full] = _Changes(c.puts.withColumnRenamed(was, new), c.gone.withColumnRenamed(was, new))
        elif operation in ("set default", "drop default"):
            column(o["column"])["default"] = o.get("default") if operation == "set default" else None
        elif operation == "set not null":
            if not self.table(table).filter(F.col(f"`{o['column']}`").isNull()).isEmpty():
                raise ConstraintViolation(f"{o['column']} holds NULL")
            column(o["column"])["nullable"] = False
        elif operation == "drop not null":
            if o["column"] in meta["key"]:
                raise Unsupported("a key column cannot be NULL")
            column(o["column"])["nullable"] = True
        elif operation == "add check":
            if not self.table(table).filter(~F.coalesce(F.expr(o["expression"]), F.lit(True))).isEmpty():
                raise ConstraintViolation(f"existing rows violate {o['name']}")
            meta["checks"][o["name"]] = o["expression"]
        elif operation == "add unique":
            self._no_duplicates(self.table(table), o["columns"], o["name"])
            meta["unique"][o["name"]] = list(o["columns"])
        elif operation == "add foreign key":
            on_delete, on_update = o.get("on_delete", "no action").lower(), o.get("on_update", "no action").lower()
            if not {on_delete, on_update} <= ACTIONS:
                raise Unsupported(f"unknown action {on_delete} or {on_update}")
            parent = self.meta(o["parent"])
            keys = list(o.get("parent_columns") or parent["key"])
            if sorted(keys) not in [sorted(k) for k in (parent["key"], *parent["unique"].values())]:
                raise ConstraintViolation("a foreign key refers to a primary or unique key")
            name = o.get("name") or f"fk_{uuid.uuid4().hex[:8]}"
            meta["foreign"][name] = {"columns": list(o["columns"]), "parent": self._name(o["parent"]), "parent_columns": keys, "on_delete": on_delete, "on_update": on_update}
            try:
                self._orphans(full, meta["foreign"][name])
            except ConstraintViolation:
                del meta["foreign"][name]
                raise
        elif operation == "drop constraint":
            if not any(meta[kind].pop(o["name"], None) for kind in ("checks", "unique", "foreign")):
                raise UnknownName(f"no constraint {o['name']}")
        else:
            raise Unsupported(operation)
        self.ddl.add(full)

    def _create_index(self, name: str, table: str, columns: list[str], unique: bool = False) -> None:
        """Metadata; a UNIQUE index is refused over duplicates and enforced from then on."""
        if unique:
            self.alter(table, "add unique", name=name, columns=columns)
        self.meta(table)["indexes"][name] = list(columns)
        self.ddl.add(self._name(table))

    def drop_index(self, name: str, table: str) -> None:
        if self.meta(table)["indexes"].pop(name, None) is None:
            raise UnknownName(f"no index {name}")
        self.meta(table)["unique"].pop(name, None)
        self.ddl.add(self._name(table))

    # Grants
    def _object(self, on: str) -> str:
        on = on.lower()
        return on if on == "*" or on.endswith(".*") else self._name(on)

    def grant(self, privilege: str, on: str, user: str) -> None:
        """Let a user do something to a table, to a schema's tables (name.*) or to all (*)."""
        if privilege.upper() not in PRIVILEGES:
            raise Unsupported(f"privilege {privilege}")
        self.grants = self.grants | {(user, privilege.upper(), self._object(on))}

    def revoke(self, privilege: str, on: str, user: str) -> None:
        """Take a grant back."""
        self.grants = self.grants - {(user, privilege.upper(), self._object(on))}

    def may(self, user: str | None, privilege: str, table: str) -> bool:
        """Whether a user may; None, the owner, may do all."""
        full = self._name(table)
        return user is None or any((user, privilege, on) in self.grants for on in (full, f"{full.split('.')[0]}.*", "*"))

    # Checks
    def _foreign_keys(self):
        for s, tables in self.catalog.items():
            for t, meta in tables.items():
                for name, fk in meta["foreign"].items():
                    yield f"{s}.{t}", name, fk

    def _no_duplicates(self, rows: DataFrame, columns: list[str], what: str) -> None:
        present = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in columns))
        if not rows.filter(present).groupBy(*columns).count().filter("count > 1").isEmpty():
            raise Conflict(f"duplicate key in {what}")

    def _orphans(self, child: str, fk: dict, rows: DataFrame | None = None) -> None:
        """MATCH SIMPLE: a row with a NULL in its key refers to nothing."""
        rows = self.table(child) if rows is None else rows
        present = rows.select(*fk["columns"]).filter(reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in fk["columns"]))).distinct()
        parent = self.table(fk["parent"]).select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(fk["parent_columns"])])
        match = reduce(lambda a, b: a & b, (present[c] == parent[f"_p{i}"] for i, c in enumerate(fk["columns"])))
        if not present.join(parent, match, "left_anti").isEmpty():
            raise ConstraintViolation(f"{child} refers to rows that {fk['parent']} lacks")

    def _valid(self, meta: dict, rows: DataFrame) -> None:
        bad = [F.col(f"`{c['name']}`").isNull() for c in meta["columns"] if not c["nullable"]]
        bad += [~F.coalesce(F.expr(e), F.lit(True)) for e in meta["checks"].values()]
        if bad and not rows.filter(reduce(lambda a, b: a | b, bad)).isEmpty():
            raise ConstraintViolation("a row violates NOT NULL or CHECK")

    def _keep(self, rows: DataFrame) -> DataFrame:
        path = f"{self.db.root}/work/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _apply(self, full: str, meta: dict, puts: DataFrame, gone: DataFrame) -> None:
        """Lay rows put and keys gone over what the transaction has already changed."""
        old = self.changes.get(full)
        key = meta["key"]
        gone = gone.select(*key)
        if old:
            touched = puts.select(*key).unionAll(gone).distinct()
            puts = old.puts.join(touched, _same(old.puts, touched, key), "left_anti").unionByName(puts)
            gone = old.gone.unionAll(gone)
        self.changes[full] = _Changes(self._keep(puts), self._keep(gone.distinct()))

    def _statement(self, work):
        """All or nothing: on an error the transaction is as before."""
        before = dict(self.changes), copy.deepcopy(self.catalog), set(self.ddl)
        try:
            return work()
        except Exception:
            self.changes, self.catalog, self.ddl = before
            raise

    def savepoint(self) -> tuple:
        """What rollback_to() takes to undo all statements since."""
        return dict(self.changes), copy.deepcopy(self.catalog), set(self.ddl)

    def rollback_to(self, point: tuple) -> None:
        """The transaction as it was at the savepoint; the point stays good."""
        changes, catalog, ddl = point
        self.changes, self.catalog, self.ddl = dict(changes), copy.deepcopy(catalog), set(ddl)

    # Data manipulation
    def _completed(self, meta: dict, rows: DataFrame) -> DataFrame:
        given = {c.lower(): c for c in rows.columns}
        unknown = set(given) - {c["name"].lower() for c in meta["columns"]} - {"_ordinal"}
        if unknown:
            raise UnknownName(f"no columns {sorted(unknown)}")
        value = lambda c: F.col(f"`{given[c['name'].lower()]}`") if c["name"].lower() in given else F.expr(c["default"] or "NULL")
        extra = [F.col("_ordinal")] if "_ordinal" in given else []
        return rows.select(*[value(c).cast(c["type"]).alias(c["name"]) for c in meta["columns"]], *extra)

    def insert(self, table: str, rows: DataFrame, on_conflict: str | None = None, target: list[str] | str | None = None, set: dict[str, str] | None = None, where: str | None = None) -> Result:
        """INSERT; columns that rows lack get their defaults, and types are cast with checks.

        on_conflict: None (duplicates raise Conflict), "nothing" or "update" (set: column to expression over the row and
        excluded.column; where limits it). target: key columns or the name of a unique constraint, by default any key
        for "nothing" and the primary key for "update". Rows take effect in the order of rows' partitions.
        """
        return self._statement(lambda: self._insert(table, rows, on_conflict, target, set, where))

    def _keys(self, meta: dict, target, on_conflict: str) -> list[list[str]]:
        known = [meta["key"], *meta["unique"].values()]
        if isinstance(target, str):
            if target not in meta["unique"]:
                raise UnknownName(f"no constraint {target}")
            return [meta["unique"][target]]
        if target:
            found = [k for k in known if sorted(k) == sorted(target)]
            if not found:
                raise Unsupported("ON CONFLICT needs a primary or unique key")
            return found[:1]
        return known if on_conflict == "nothing" else [meta["key"]]

    def _insert(self, table, rows, on_conflict, target, set, where) -> Result:
        full, meta = self._name(table), self.meta(table)
        names = [c["name"] for c in meta["columns"]]
        new = self._keep(self._completed(meta, rows.withColumn("_ordinal", F.monotonically_increasing_id())))
        self._valid(meta, new)
        now = self.table(table)
        changed = new.select(*names)
        gone = new.limit(0).select(*meta["key"])
        if on_conflict == "nothing":
            for key in self._keys(meta, target, on_conflict):
                present = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in key))
                first = F.row_number().over(Window.partitionBy(*key).orderBy("_ordinal"))
                new = new.withColumn("_n", first).filter((F.col("_n") == 1) | ~present).drop("_n")
                match = reduce(lambda a, b: a & b, (new[c] == now[c] for c in key))
                new = new.join(now, match, "left_anti")
            changed = self._keep(new.select(*names))
        elif on_conflict == "update":
            (key,) = self._keys(meta, target, on_conflict)
            present = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in key))
            if not new.filter(present).groupBy(*key).count().filter("count > 1").isEmpty():
                raise Conflict("ON CONFLICT DO UPDATE would change one row twice")
            held = new.select(F.struct(*names).alias("excluded"))
            pairs = now.alias(full.split(".")[1]).join(held, reduce(lambda a, b: a & b, (now[c] == F.col("excluded").getField(c) for c in key)))
            hit = pairs.filter(where) if where else pairs
            low = {c.lower(): e for c, e in (set or {}).items()}
            if unknown := [c for c in low if c not in [n.lower() for n in names]]:
                raise UnknownName(f"no columns {unknown}")
            kinds = {c["name"]: c["type"] for c in meta["columns"]}
            value = lambda n: (F.expr(low[n.lower()]) if n.lower() in low else now[n]).cast(kinds[n]).alias(n)
            updated = self._keep(hit.select(*[value(n) for n in names], *[now[k].alias(f"_old_{k}") for k in meta["key"]]))
            fresh = new.join(now, reduce(lambda a, b: a & b, (new[c] == now[c] for c in key)), "left_anti").select(*names)
            gone = updated.select(*[F.col(f"_old_{k}").alias(k) for k in meta["key"]])
            changed = self._keep(updated.select(*names).unionByName(fresh))
            self._valid(meta, changed)
        elif on_conflict is not None:
            raise Unsupported(on_conflict)
        self._put(full, meta, now, changed, gone)
        return Result(changed, names)

    def _put(self, full: str, meta: dict, now: DataFrame, changed: DataFrame, gone: DataFrame) -> None:
        """Replace the rows of keys gone by the changed ones, under all keys and foreign keys."""
        key = meta["key"]
        rest = now.join(gone.distinct(), _same(now, gone.distinct(), key), "left_anti") if gone is not None else now
        for columns in (key, *meta["unique"].values()):
            near = rest.join(changed.select(*columns).distinct(), list(columns), "left_semi").select(*columns)
            self._no_duplicates(near.unionAll(changed.select(*columns)), columns, full)
        self._apply(full, meta, changed, gone)
        for child, _, fk in self._foreign_keys():
            if child == full:
                self._orphans(full, fk, changed)

    def update(self, table: str, set: dict[str, str], where: str = "TRUE") -> Result:
        """UPDATE: every expression sees the row as it was; subqueries name other tables as {table}. The key may change."""
        return self._statement(lambda: self._update(table, set, where, 0))

    def _update(self, table: str, set: dict[str, str], where: str, depth: int) -> Result:
        full, meta = self._name(table), self.meta(table)
        names = [c["name"] for c in meta["columns"]]
        low = {c.lower(): e for c, e in set.items()}
        if unknown := [c for c in low if c not in [n.lower() for n in names]]:
            raise UnknownName(f"no columns {unknown}")
        alias = full.split(".")[1]
        items = [f"CAST(({low[c['name'].lower()]}) AS {c['type']}) AS `{c['name']}`" if c["name"].lower() in low else f"{alias}.`{c['name']}`" for c in meta["columns"]]
        olds = [f"{alias}.`{n}` AS `_old_{n}`" for n in names]
        hit = self._keep(self.sql(f"SELECT {', '.join(items + olds)} FROM {{{full}}} AS {alias} WHERE {where}"))
        self._replace(full, meta, hit, depth)
        return Result(hit.select(*names), names)

    def _replace(self, full: str, meta: dict, hit: DataFrame, depth: int) -> None:
        """hit: new values and _old_ ones. Children follow their parents' keys."""
        names = [c["name"] for c in meta["columns"]]
        changed = hit.select(*names)
        self._valid(meta, changed)
        gone = hit.select(*[F.col(f"`_old_{k}`").alias(k) for k in meta["key"]])
        self._put(full, meta, self.table(full), changed, gone)
        self._children(full, hit, "on_update", depth)

    def delete(self, table: str, where: str = "TRUE") -> Result:
        """DELETE; children follow by their foreign keys' actions."""
        return self._statement(lambda: self._delete(table, where, 0))

    def _delete(self, table: str, where: str, depth: int) -> Result:
        full, meta = self._name(table), self.meta(table)
        names = [c["name"] for c in meta["columns"]]
        alias = full.split(".")[1]
        rows = self._keep(self.sql(f"SELECT {alias}.* FROM {{{full}}} AS {alias} WHERE {where}"))
        self._remove(full, meta, rows, depth)
        return Result(rows, names)

    def _remove(self, full: str, meta: dict, rows: DataFrame, depth: int) -> None:
        self._apply(full, meta, rows.limit(0), rows)
        self._children(full, rows.select(*[F.col(c).alias(f"_old_{c}") for c in rows.columns]), "on_delete", depth)

    def _children(self, full: str, hit: DataFrame, event: str, depth: int) -> None:
        """Apply ON DELETE or ON UPDATE to the rows that refer to keys which are no longer there."""
        if depth > MAX_CASCADE:
            raise ResourceLimit(f"foreign keys cascade deeper than {MAX_CASCADE}")
        for child, _, fk in list(self._foreign_keys()):
            if fk["parent"] != full:
                continue
            olds = [f"_old_{p}" for p in fk["parent_columns"]]
            lost = hit.select(*olds, *(fk["parent_columns"] if event == "on_update" else []))
            if event == "on_update":
                lost = lost.filter(reduce(lambda a, b: a | b, (~F.col(f"`{p}`").eqNullSafe(F.col(f"`_old_{p}`")) for p in fk["parent_columns"])))
                lost = lost.select(*olds, *[F.col(p).alias(f"_new_{p}") for p in fk["parent_columns"]])
            still = self.table(full).select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(fk["parent_columns"])])
            lost = lost.join(still, reduce(lambda a, b: a & b, (F.col(o) == F.col(f"_p{i}") for i, o in enumerate(olds))), "left_anti")
            meta, rows = self.meta(child), self.table(child)
            refers = reduce(lambda a, b: a & b, (rows[c] == F.col(o) for c, o in zip(fk["columns"], olds, strict=True)))
            hit_rows = self._keep(rows.join(lost.distinct(), refers))
            if hit_rows.isEmpty():
                continue
            action = fk[event]
            if action in ("no action", "restrict"):
                raise ConstraintViolation(f"{child} still refers to {full}")
            names = [c["name"] for c in meta["columns"]]
            if action == "cascade" and event == "on_delete":
                self._remove(child, meta, self._keep(hit_rows.select(*names)), depth + 1)
                continue
            default = {c["name"]: c["default"] for c in meta["columns"]}
            kinds = {c["name"]: c["type"] for c in meta["columns"]}
            value = {c: F.col(f"`_new_{p}`") if action == "cascade" else F.expr(default[c] or "NULL") if action == "set default" else F.lit(None) for c, p in zip(fk["columns"], fk["parent_columns"], strict=True)}
            self._replace(child, meta, self._keep(hit_rows.select(*[value.get(n, F.col(f"`{n}`")).cast(kinds[n]).alias(n) for n in names], *[F.col(f"`{n}`").alias(f"_old_{n}") for n in names])), depth + 1)

    # End
    def rollback(self) -> None:
        self.changes, self.open = {}, False

    def commit(self) -> int:
        """Publish; the version that now holds. Conflict if another commit touched a key or table definition of this one."""
        if not self.open:
            raise EngineError("the transaction has ended")
        while True:
            latest = self.db.state()
            granted = {tuple(g) for g in latest.get("grants", [])}
            before = {tuple(g) for g in self.base.get("grants", [])}
            if not self.changes and not self.ddl and self.grants == before:
                self.open = False
                return latest["version"]
            schemas = self._rebased(latest)
            grants = granted - (before - self.grants) | (self.grants - before)
            state = {"version": latest["version"] + 1, "schemas": schemas, "grants": sorted(grants)}
            if self.db.files.create(f"state-{state['version']}.json", json.dumps(state)):
                self.open = False
                return state["version"]

    def _rebased(self, latest: dict) -> dict:
        schemas = copy.deepcopy(latest["schemas"])
        moved = latest["version"] != self.base["version"]
        of = lambda all_, full: all_.get(full.split(".")[0], {}).get(full.split(".")[1])
        for name in self.ddl:
            if "." not in name:
                schemas.setdefault(name, {})
            elif moved and of(latest["schemas"], name) != of(self.base["schemas"], name):
                self.open = False
                raise Conflict(f"{name} was changed by another transaction")
            else:
                schema, table = name.split(".")
                schemas.setdefault(schema, {}).pop(table, None)
                if (mine := of(self.catalog, name)) is not None:
                    schemas[schema][table] = copy.deepcopy(mine)
        for full, change in self.changes.items():
            schema, table = full.split(".")
            meta = schemas.get(schema, {}).get(table)
            if meta is None:
                self.open = False
                raise Conflict(f"{full} was dropped by another transaction")
            key = meta["key"]
            touched = change.puts.select(*key).unionAll(change.gone.select(*key)).distinct()
            if moved and meta["changed"] > self.base["version"]:
                for version in range(self.base["version"] + 1, latest["version"] + 1):
                    path = of(self.db.state(version)["schemas"], full)
                    if path and path["changed"] == version:
                        others = self.spark.read.parquet(path["path"] + "-keys")
                        if not touched.join(others, _same(touched, others, key), "left_semi").isEmpty():
                            self.open = False
                            raise Conflict(f"another transaction changed rows of {full} first")
            after = Transaction(self.db, latest["version"])
            after.catalog = schemas
            path = f"{self.db.root}/tables/{schema}/{table}/{uuid.uuid4().hex}"
            rows = overlay(after._stored(meta), change.puts, change.gone, key)
            if moved:
                for columns in (key, *meta["unique"].values()):
                    self._no_duplicates(rows, columns, full)
            # Sorted by the key within files, so that row groups can be skipped by key ranges.
            rows.sortWithinPartitions(*key).select(*[F.col(f"`{c['name']}`").alias(c["stored"]) for c in meta["columns"]]).write.options(**_blooms(meta)).parquet(path)
            touched.write.parquet(path + "-keys")
            for c in meta["columns"]:
                c["written"] = True
            meta["path"], meta["changed"] = path, latest["version"] + 1
        if moved:
            # Another transaction may have taken parents away, or added children: whatever touches a changed table is looked at again.
            after = Transaction(self.db, latest["version"])
            after.catalog = schemas
            for child, _, fk in after._foreign_keys():
                if {child, fk["parent"]} & {*self.changes, *self.ddl}:
                    try:
                        after._orphans(child, fk)
                    except ConstraintViolation as e:
                        self.open = False
                        raise Conflict(f"another transaction came first: {e}") from e
        return schemas
