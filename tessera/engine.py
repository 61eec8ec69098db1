"""SQL in the dialect: queries over views, and DML and DDL over a Database."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tessera.dialect.rewrite import AGGREGATES, LIMITS, Node, find, parse, show, split, to_spark
from tessera.dialect.typing import typed, typed_text
from tessera.errors import ParseError, UnknownName, Unsupported
from tessera.operators.recursion import fixpoint
from tessera.operators.setops import except_, intersect, union, union_by_name
from tessera.session import configure
from tessera.store.database import Database, Result, Transaction

TYPES = {"INTEGER": "int", "INT": "int", "BIGINT": "bigint", "REAL": "float", "DOUBLE": "double", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "BOOLEAN": "boolean", "BOOL": "boolean", "BLOB": "binary", "BYTEA": "binary", "BINARY": "binary", "VARBINARY": "binary", "DATE": "date", "TIME": "time", "TIMESTAMP": "timestamp_ntz"}


class Engine:
    """Runs statements; without a database only queries over the session's views.

    user: who it runs for; the owner (None) may do all, others what is granted. What a user may not touch does not exist to them.
    """

    def __init__(self, spark: SparkSession, database: Database | None = None, user: str | None = None) -> None:
        self.user = user
        self.spark, self.database, self.work, self.schema = configure(spark), database, None, "main"
        self.bound: dict[str, str] = {}  # names that a query may use, and the views behind them

    # Queries
    def query(self, sql: str, *params) -> DataFrame:
        """A query; $1, $2, ... are params."""
        return self._query(_statement(sql), _args(params))

    def attach(self, name: str, df: DataFrame) -> None:
        """Let statements see df as a table of that name; a table of the database with the name hides it."""
        self._bind(name, df)

    def over(self, sql: str, tables: dict[str, DataFrame], *params) -> DataFrame:
        """A query over given tables, which hide any others of their names."""
        with self._binding():
            for name, df in tables.items():
                self._bind(name, df)
            return self.query(sql, *params)

    @contextmanager
    def _binding(self):
        before = dict(self.bound)
        try:
            yield
        finally:
            self.bound = before

    def _bind(self, name: str, df: DataFrame) -> None:
        view = f"v_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        self.bound[name.lower()] = view

    def _query(self, items: list[Node], args: dict) -> DataFrame:
        with self._binding():
            self._show_tables(items)
            return self._rows(items, args)

    def _rows(self, items: list[Node], args: dict) -> DataFrame:
        """A query whose parts that Spark's SQL lacks are made first: recursion with UNION, and strict set operations."""
        items = self._made(items, args)
        head: list[Node] = []
        if items and items[0].is_("WITH"):
            if items[1].is_("RECURSIVE"):
                items = self._recursive(items, args)
            if items and items[0].is_("WITH"):
                at = _after_definitions(items)
                head, items = items[:at], items[at:]
        operands, signs, tail = _operands(items)
        if not signs:
            return self._text([*head, *items], args)
        parts = [self._rows([*head, *(o[0].items if len(o) == 1 and o[0].kind == "group" else o)], args) for o in operands]
        for tight in (True, False):  # INTERSECT binds tighter
            i = 0
            while i < len(signs):
                kind, every, by_name = signs[i]
                if (kind == "INTERSECT") == tight:
                    if by_name:
                        made = union_by_name(parts[i], parts[i + 1], every)
                    else:
                        made = {"UNION": union, "INTERSECT": intersect}.get(kind, except_)(parts[i], parts[i + 1], every)
                    parts[i : i + 2] = [made]
                    del signs[i]
                else:
                    i += 1
        if not tail:
            return parts[0]
        name = f"s_{uuid.uuid4().hex}"
        self._bind(name, parts[0])
        return self._text([Node("word", "SELECT"), Node("op", "*"), Node("word", "FROM"), Node("word", name), *tail], args)

    def _made(self, items: list[Node], args: dict) -> list[Node]:
        """Groups that hold UNION BY NAME or recursion with UNION replaced by views of their rows."""
        out = []
        for n in items:
            if n.kind == "group":
                inner = n.items
                if inner and (inner[0].is_("WITH") and len(inner) > 1 and inner[1].is_("RECURSIVE") or inner[0].is_("SELECT", "WITH") and find(inner, "BY", "NAME") >= 0):
                    name = f"g_{uuid.uuid4().hex}"
                    self._bind(name, self._rows(inner, args))
                    n = Node("group", items=[Node("word", "SELECT"), Node("op", "*"), Node("word", "FROM"), Node("word", name)])
                else:
                    n = Node("group", items=self._made(inner, args))
            out.append(n)
        return out

    def _text(self, items: list[Node], args: dict) -> DataFrame:
        text = to_spark(_source(self._scoped(items)))
        used = {k: v for k, v in args.items() if re.search(rf":{k}\b", text)}
        run = lambda t: self.spark.sql(t, args=used) if used else self.spark.sql(t)
        return typed(run, text)

    def _scoped(self, items: list[Node]) -> list[Node]:
        """A query with definitions before it for the bound names it uses; they hide other views, and a definition of its own hides them."""
        used = {n.text.strip('"').lower() for n in _flat(items) if n.kind in ("word", "quoted")}
        names = sorted(used & set(self.bound))
        if not names:
            return items
        own = set()
        recursive = len(items) > 1 and items[0].is_("WITH") and items[1].is_("RECURSIVE")
        if items[0].is_("WITH"):
            own = {items[i].text.strip('"').lower() for i in _defined(items)}
        words = ["SELECT", "*", "FROM"]
        definitions = [[Node("word", n), Node("word", "AS"), Node("group", items=[*(Node("op" if w == "*" else "word", w) for w in words), Node("word", self.bound[n])])] for n in names if n not in own]
        flat = [x for d in definitions for x in (*d, Node("op", ","))]
        if items[0].is_("WITH"):
            return [*items[: 1 + recursive], *flat, *items[1 + recursive :]]
        return [Node("word", "WITH"), *flat[:-1], *items] if flat else items

    def _expression(self, items: list[Node], head: list[Node], rows: DataFrame) -> str:
        """Spark's text of an expression over rows; its subqueries see the bound names and the definitions in head."""
        def scoped(nodes: list[Node]) -> list[Node]:
            return [Node("group", items=self._scoped([*head, *n.items] if n.items and n.items[0].is_("SELECT") else n.items) if n.items and n.items[0].is_("SELECT", "WITH") else scoped(n.items)) if n.kind == "group" else n for n in nodes]

        return typed_text(lambda t: rows.selectExpr(t), to_spark(_source(scoped(items))))

    def _recursive(self, items: list[Node], args: dict) -> list[Node]:
        """Recursive definitions with UNION are iterated here and bound to their names; the others stay Spark's."""
        i, kept = 2, []
        while True:
            name, columns = items[i].text.strip('"'), None
            i += 1
            if items[i].kind == "group":
                columns = [c[0].text.strip('"') for c in split(items[i].items, ",")]
                i += 1
            if not items[i].is_("AS"):
                raise ParseError("AS is missing in WITH")
            body = items[i + 1].items
            i += 2
            operands, signs, tail = _operands(body)
            uses = [_uses(o, name) for o in operands]
            if not any(uses) or all(s[1] for s in signs):
                kept.append((name, columns, body, any(uses)))
            else:
                first = uses.index(next(u for u in uses if u))
                if not first or tail or any(s[0] != "UNION" or s[2] for s in signs) or not all(uses[first:]):
                    raise Unsupported("a recursive query is a seed, UNION, and terms that name it")
                for term in operands[first:]:
                    _check_term(term, name)
                with self._binding():
                    seed = self._rows(_rejoined(operands[:first], signs), args)
                seed = seed.toDF(*columns) if columns else seed

                def step(rows: DataFrame, name=name, terms=operands[first:]) -> DataFrame:
                    with self._binding():
                        self._bind(name, rows)
                        parts = [self._text(t[0].items if len(t) == 1 and t[0].kind == "group" else t, args) for t in terms]
                    return reduce(lambda a, b: a.unionAll(b), parts)

                self._bind(name, fixpoint(seed, step, linear=True))
            if i < len(items) and items[i].is_(","):
                i += 1
                continue
            break
        rest = items[i:]
        if not kept:
            return rest
        head = [Node("word", "WITH"), *([Node("word", "RECURSIVE")] if any(k[3] for k in kept) else [])]
        for n, (name, columns, body, _) in enumerate(kept):
            head += [*([Node("op", ",")] if n else []), Node("word", name)]
            if columns:
                head.append(Node("group", items=[x for c in columns for x in (Node("op", ","), Node("word", c))][1:]))
            head += [Node("word", "AS"), Node("group", items=body)]
        return [*head, *rest]

    def explain(self, sql: str) -> str:
        """The formatted plan of a query, or of the rows that a statement would change; nothing is written."""
        items = _statement(sql)
        if _is_query(items):
            df = self._query(items, {})
        else:
            work = self._begin()
            try:
                found = self._handled(work, items, {})
                df = found.rows if isinstance(found, Result) else found
            finally:
                work.rollback()
            if df is None:
                raise Unsupported("EXPLAIN takes queries and data manipulation")
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # Statements
    def _begin(self) -> Transaction:
        work = self.database.begin()
        if self.schema in work.catalog:
            work.use_schema(self.schema)
        return work

    def _show_tables(self, items: list[Node], work: Transaction | None = None) -> None:
        """Bind the tables that a statement names."""
        if self.database is None:
            return
        work = work or self.work or self._begin()
        used = {n.text.strip('"').lower() for n in _flat(items) if n.kind in ("word", "quoted")}
        for name in used & set(work.catalog.get(work.schema, {})):
            if work.may(self.user, "SELECT", name):
                self._bind(name, work.table(name))

    def _allowed(self, work: Transaction, privilege: str, table: str) -> None:
        if not work.may(self.user, privilege, table):
            raise UnknownName(f"no table {table}")

    def _grant(self, work: Transaction, items: list[Node], args: dict) -> None:
        """GRANT privilege, ... ON [TABLE] name | SCHEMA name | DATABASE TO user; REVOKE ... FROM user."""
        if self.user is not None:
            raise Unsupported("only the owner grants")
        on = find(items, "ON")
        to = max(find(items, "TO"), find(items, "FROM"))
        if on < 0 or to < on or to + 2 != len(items):
            raise ParseError("GRANT privileges ON object TO user")
        what = items[on + 1 : to]
        if what[0].is_("DATABASE"):
            target = "*"
        elif what[0].is_("SCHEMA"):
            target = f"{what[1].text}.*"
        else:
            target = _name(what, int(what[0].is_("TABLE")))[0]
        change = work.grant if items[0].is_("GRANT") else work.revoke
        for privilege in split(items[1:on], ","):
            change(" ".join(n.text for n in privilege), target, items[-1].text.strip('"'))

    def execute(self, sql: str, *params):
        """Any statement: a DataFrame for queries and RETURNING, a Result for DML, None for the rest."""
        items = _statement(sql)
        if not items:
            raise ParseError("an empty statement")
        first, args = items[0], _args(params)
        if _is_query(items):
            return self._query(items, args)
        if first.is_("EXPLAIN"):
            return self.explain(_source(items[1:]))
        if self.database is None:
            raise Unsupported("there is no database")
        if first.is_("BEGIN"):
            self.work = self._begin()
            return None
        if first.is_("COMMIT", "ROLLBACK"):
            if self.work is None:
                raise Unsupported("no transaction is open")
            work, self.work = self.work, None
            return work.commit() if first.is_("COMMIT") else work.rollback()
        if self.work is not None:
            return self._handled(self.work, items, args)

        def once(work: Transaction):
            if self.schema in work.catalog:
                work.use_schema(self.schema)
            return self._handled(work, items, args)

        return self.database.run(once)

    def _handled(self, work: Transaction, items: list[Node], args: dict):
        head: list[Node] = []
        if items[0].is_("WITH"):  # definitions before a change: its subqueries see them
            at = _after_definitions(items)
            head, items = items[:at], items[at:]
        handler = {"INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete, "CREATE": self._create, "ALTER": self._alter, "DROP": self._drop, "USE": self._use, "GRANT": self._grant, "REVOKE": self._grant}.get(items[0].text.upper())
        if handler is None or head and not items[0].is_("INSERT", "UPDATE", "DELETE"):
            raise Unsupported(f"{items[0].text} statements")
        with self._binding():
            self._show_tables([*head, *items], work)
            return handler(work, items, args, head) if items[0].is_("INSERT", "UPDATE", "DELETE") else handler(work, items, args)

    def _returning(self, items: list[Node]):
        at = find(items, "RETURNING")
        if at < 0:
            return items, lambda result: result
        wanted = [to_spark(_source(x)) for x in split(items[at + 1 :], ",")]
        return items[:at], lambda result: result.returning(*wanted)

    def _insert(self, work: Transaction, items: list[Node], args: dict, head: list[Node]) -> Result | DataFrame:
        items, finish = self._returning(items)
        name, at = _name(items, 2)
        self._allowed(work, "INSERT", name)
        columns = None
        if items[at].kind == "group":
            columns = [c[0].text for c in split(items[at].items, ",")]
            at += 1
        on = find(items, "ON", "CONFLICT")
        source = self._rows([*head, *items[at : on if on >= 0 else len(items)]], args)
        columns = columns or [c["name"] for c in work.meta(name)["columns"]][: len(source.columns)]
        if len(columns) != len(source.columns):
            raise ParseError(f"{len(columns)} columns and {len(source.columns)} values")
        options: dict = {}
        if on >= 0:
            rest = items[on + 2 :]
            if rest[0].kind == "group":
                options["target"] = [c[0].text for c in split(rest[0].items, ",")]
                rest = rest[1:]
            elif rest[0].is_("ON"):
                options["target"] = rest[2].text
                rest = rest[3:]
            if rest[1].is_("NOTHING"):
                options["on_conflict"] = "nothing"
            else:
                where = find(rest, "WHERE")
                there = work.table(name)
                both = there.alias(name.split(".")[-1]).join(there.alias("excluded"))  # only analysed
                options |= {"on_conflict": "update", "set": self._assignments(rest[3 : where if where >= 0 else len(rest)], head, both)}
                if where >= 0:
                    options["where"] = self._expression(rest[where + 1 :], head, both)
        return finish(work.insert(name, source.toDF(*columns), **options))

    def _assignments(self, items: list[Node], head: list[Node], rows: DataFrame) -> dict[str, str]:
        return {part[0].text: self._expression(part[2:], head, rows) for part in split(items, ",")}

    def _update(self, work: Transaction, items: list[Node], args: dict, head: list[Node]) -> Result | DataFrame:
        items, finish = self._returning(items)
        name, at = _name(items, 1)
        self._allowed(work, "UPDATE", name)
        where = find(items, "WHERE")
        return finish(work.update(name, self._assignments(items[at + 1 : where if where >= 0 else len(items)], head, work.table(name)), self._expression(items[where + 1 :], head, work.table(name)) if where >= 0 else "TRUE"))

    def _delete(self, work: Transaction, items: list[Node], args: dict, head: list[Node]) -> Result | DataFrame:
        items, finish = self._returning(items)
        name, _ = _name(items, 2)
        self._allowed(work, "DELETE", name)
        where = find(items, "WHERE")
        return finish(work.delete(name, self._expression(items[where + 1 :], head, work.table(name)) if where >= 0 else "TRUE"))

    def _create(self, work: Transaction, items: list[Node], args: dict) -> None:
        there = find(items, "IF", "NOT", "EXISTS")
        items = items if there < 0 else items[:there] + items[there + 3 :]
        if items[1].is_("SCHEMA"):
            return work.create_schema(items[2].text, if_not_exists=there >= 0)
        if items[1].is_("INDEX", "UNIQUE"):
            unique = items[1].is_("UNIQUE")
            index = items[2 + unique].text
            table, at = _name(items, 4 + unique)
            self._allowed(work, "CREATE INDEX", table)
            return work.create_index(index, table, [c[0].text for c in split(items[at].items, ",")], unique)
        if not items[1].is_("TABLE"):
            raise Unsupported(f"CREATE {items[1].text}")
        name, at = _name(items, 2)
        self._allowed(work, "DDL", name)
        o: dict = {"columns": {}, "key": [], "not_null": [], "defaults": {}, "unique": {}, "checks": {}, "foreign_keys": []}
        for n, part in enumerate(split(items[at].items, ",")):
            _define(o, part, n)
        return work.create_table(name, if_not_exists=there >= 0, **o)

    def _drop(self, work: Transaction, items: list[Node], args: dict) -> None:
        there = find(items, "IF", "EXISTS")
        items = items if there < 0 else items[:there] + items[there + 2 :]
        name, at = _name(items, 2)
        if items[1].is_("TABLE"):
            self._allowed(work, "DDL", name)
            return work.drop_table(name, if_exists=there >= 0)
        return work.drop_index(name, _name(items, at + 1)[0])

    def _use(self, work: Transaction, items: list[Node], args: dict) -> None:
        work.use_schema(items[-1].text)
        self.schema = items[-1].text.lower()

    def _alter(self, work: Transaction, items: list[Node], args: dict) -> None:
        """ALTER TABLE with one operation."""
        if not items[1].is_("TABLE"):
            raise Unsupported(f"ALTER {items[1].text}")
        name, at = _name(items, 2)
        self._allowed(work, "DDL", name)
        verb, rest = items[at], items[at + 1 :]
        if verb.is_("ADD"):
            rest = rest[1:] if rest[0].is_("COLUMN") else rest
            o: dict = {"columns": {}, "key": [], "not_null": [], "defaults": {}, "unique": {}, "checks": {}, "foreign_keys": []}
            _define(o, rest, len(work.meta(name)["checks"]) + len(work.meta(name)["unique"]) + len(work.meta(name)["foreign"]))
            if o["key"]:
                raise Unsupported("a table's primary key stays")
            for column, kind in o["columns"].items():
                work.alter(name, "add column", column=column, type=kind, not_null=column in o["not_null"], default=o["defaults"].get(column))
            for label, expression in o["checks"].items():
                work.alter(name, "add check", name=label, expression=expression)
            for label, columns in o["unique"].items():
                work.alter(name, "add unique", name=label, columns=columns)
            for fk in o["foreign_keys"]:
                work.alter(name, "add foreign key", **fk)
            return None
        if verb.is_("RENAME"):
            rest = rest[1:] if rest[0].is_("COLUMN") else rest
            return work.alter(name, "rename column", column=rest[0].text.strip('"'), to=rest[2].text.strip('"'))
        if verb.is_("DROP") and rest[0].is_("CONSTRAINT"):
            return work.alter(name, "drop constraint", name=rest[1].text)
        if verb.is_("ALTER"):
            rest = rest[1:] if rest[0].is_("COLUMN") else rest
            column, does, what = rest[0].text.strip('"'), rest[1].text.lower(), rest[2]
            if what.is_("DEFAULT"):
                return work.alter(name, f"{does} default", column=column, **({"default": to_spark(_source(rest[3:]))} if does == "set" else {}))
            if what.is_("NOT"):
                return work.alter(name, f"{does} not null", column=column)
        raise Unsupported(f"ALTER TABLE ... {verb.text}")


def _statement(sql: str) -> list[Node]:
    items = parse(sql)
    while items and items[-1].is_(";"):
        items.pop()
    return items


def _args(params) -> dict:
    return {f"p{i}": v for i, v in enumerate(params, 1)}


def _is_query(items: list[Node]) -> bool:
    first = items[0]
    if first.is_("WITH"):
        return not items[_after_definitions(items)].is_("INSERT", "UPDATE", "DELETE")
    return first.is_("SELECT", "VALUES") or first.kind == "group"


def _defined(items: list[Node]) -> list[int]:
    """Where the names of WITH's definitions stand."""
    i, out = 1 + (len(items) > 1 and items[1].is_("RECURSIVE")), []
    while i < len(items):
        out.append(i)
        i += 1
        if i < len(items) and items[i].kind == "group":
            i += 1
        i += 2
        if i >= len(items) or not items[i].is_(","):
            break
        i += 1
    return out


def _after_definitions(items: list[Node]) -> int:
    """Where the statement begins that WITH's definitions belong to."""
    last = _defined(items)[-1] + 1
    last += last < len(items) and items[last].kind == "group"
    if last + 2 >= len(items):
        raise ParseError("a statement is missing after WITH")
    return last + 2


def _operands(items: list[Node]) -> tuple[list[list[Node]], list[tuple[str, bool, bool]], list[Node]]:
    """The operands of a query's set operations, the operations (kind, ALL, BY NAME), and the ORDER BY or LIMIT of the whole."""
    operands, signs, i = [[]], [], 0
    while i < len(items):
        if items[i].is_("UNION", "INTERSECT", "EXCEPT", "MINUS"):
            kind, every, by_name = items[i].text.upper(), False, False
            i += 1
            if i < len(items) and items[i].is_("ALL", "DISTINCT"):
                every = items[i].is_("ALL")
                i += 1
            if i + 1 < len(items) and items[i].is_("BY") and items[i + 1].is_("NAME"):
                if kind != "UNION":
                    raise Unsupported(f"{kind} BY NAME")
                by_name = True
                i += 2
            signs.append((kind, every, by_name))
            operands.append([])
        else:
            operands[-1].append(items[i])
            i += 1
    if not signs:
        return operands, signs, []
    if len(operands) > LIMITS["set_operands"]:
        raise Unsupported("too many set operations")
    last = operands[-1]
    at = min((p for p in (find(last, "ORDER", "BY"), find(last, "LIMIT"), find(last, "OFFSET")) if p >= 0), default=len(last))
    operands[-1], tail = last[:at], last[at:]
    if any(not o for o in operands):
        raise ParseError("an operand of a set operation is missing")
    return operands, signs, tail


def _rejoined(operands: list[list[Node]], signs: list) -> list[Node]:
    out = list(operands[0])
    for o, (kind, every, _) in zip(operands[1:], signs):
        out += [Node("word", kind), *([Node("word", "ALL")] if every else []), *o]
    return out


def _uses(items: list[Node], name: str) -> int:
    """How often a name stands in a query, but as a qualifier."""
    found = 0
    for i, n in enumerate(items):
        if n.kind == "group":
            found += _uses(n.items, name)
        elif n.kind in ("word", "quoted") and n.text.strip('"').lower() == name.lower() and not (i + 1 < len(items) and items[i + 1].is_(".")):
            found += 1
    return found


def _check_term(term: list[Node], name: str) -> None:
    """A recursive term names itself once, in its own FROM, on no side that may be NULL, and neither groups, sorts nor windows."""
    inner = term[0].items if len(term) == 1 and term[0].kind == "group" else term
    operands, signs, _ = _operands(inner)
    for part in operands:
        if any(n.is_("GROUP", "HAVING", "ORDER", "LIMIT", "OVER", "DISTINCT") for n in part) or any(n.is_(*AGGREGATES) and k + 1 < len(part) and part[k + 1].kind == "group" for k, n in enumerate(part)):
            raise Unsupported("a recursive term neither groups, sorts nor windows")
        if sum(n.kind != "group" and n.text.strip('"').lower() == name.lower() and not (k + 1 < len(part) and part[k + 1].is_(".")) for k, n in enumerate(part)) != 1 or _uses(part, name) != 1:
            raise Unsupported("a recursive term names itself once, in its own FROM")
        at = next(k for k, n in enumerate(part) if n.kind != "group" and n.text.strip('"').lower() == name.lower() and not (k + 1 < len(part) and part[k + 1].is_(".")))
        before = [n.text.upper() for n in part[max(0, at - 3) : at]]
        after = [n.text.upper() for n in part[at + 1 :]]
        if "LEFT" in before and "JOIN" in before or "FULL" in before or any(w in after for w in ("RIGHT", "FULL")):
            raise Unsupported("a recursive term names itself on no side that may be NULL")


def _flat(items: list[Node]):
    for n in items:
        yield n
        yield from _flat(n.items)


def _source(items: list[Node]) -> str:
    """The dialect's text of a tree."""
    return re.sub(r" ?\. ?(?=[A-Za-z_\"*])", ".", " ".join(f"({_source(n.items)})" if n.kind == "group" else n.text for n in items))


def _name(items: list[Node], at: int) -> tuple[str, int]:
    """A name of one or two parts, and what comes after it."""
    name = items[at].text.strip('"')
    if at + 2 < len(items) and items[at + 1].is_("."):
        return f"{name}.{items[at + 2].text}", at + 3
    return name, at + 1


def _actions(items: list[Node]) -> dict:
    out = {}
    for event in ("DELETE", "UPDATE"):
        at = find(items, "ON", event)
        if at >= 0:
            words = [n.text.lower() for n in items[at + 2 : at + 4]]
            out[f"on_{event.lower()}"] = words[0] if words[0] in ("cascade", "restrict") else " ".join(words)
    return out


def _define(o: dict, part: list[Node], n: int) -> None:
    """One column or constraint of CREATE TABLE."""
    label = f"c{n}"
    if part[0].is_("CONSTRAINT"):
        label, part = part[1].text, part[2:]
    names = lambda g: [c[0].text for c in split(g.items, ",")]
    references = lambda at, columns: {"name": f"fk_{label}", "columns": columns, "parent": part[at + 1].text, "parent_columns": names(part[at + 2]) if at + 2 < len(part) and part[at + 2].kind == "group" else None} | _actions(part)
    if part[0].is_("PRIMARY"):
        o["key"] = names(part[2])
    elif part[0].is_("UNIQUE"):
        o["unique"][label] = names(part[1])
    elif part[0].is_("CHECK"):
        o["checks"][label] = to_spark(_source(part[1].items))
    elif part[0].is_("FOREIGN"):
        o["foreign_keys"].append(references(find(part, "REFERENCES"), names(part[2])))
    else:
        column, kind = part[0].text.strip('"'), part[1].text.upper()
        if kind in ("DECIMAL", "NUMERIC"):
            size = show(part[2].items).replace(" ", "") if len(part) > 2 and part[2].kind == "group" else "38,0"
            o["columns"][column] = f"decimal({size if ',' in size else size + ',0'})"
        elif kind in TYPES:
            o["columns"][column] = TYPES[kind]
        else:
            raise Unsupported(f"type {part[1].text}")
        if find(part, "PRIMARY", "KEY") >= 0:
            o["key"] = [column]
        if find(part, "NOT", "NULL") >= 0:
            o["not_null"].append(column)
        if find(part, "UNIQUE") >= 0:
            o["unique"][f"{column}_unique"] = [column]
        if (at := find(part, "DEFAULT")) >= 0:
            o["defaults"][column] = to_spark(_source(part[at + 1 : at + 2 + part[at + 1].is_("-")]))
        if (at := find(part, "CHECK")) >= 0:
            o["checks"][f"{column}_check"] = to_spark(_source(part[at + 1].items))
        if (at := find(part, "REFERENCES")) >= 0:
            o["foreign_keys"].append(references(at, [column]))
