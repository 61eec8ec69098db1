"""Source-level rewriting of the dialect to Spark SQL: only what Spark cannot parse or reads differently.

A statement becomes a tree of tokens and parenthesised groups; every group is rewritten from the inside out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.errors import ParseError, Unsupported

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<blob>[xX]'[0-9a-fA-F]*')|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<param>\$\d+)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<op><>|<=|>=|!=|\|\||::|[-+*/%=<>(),.;?\[\]{}:])""",
    re.X | re.S,
)
LIMITS = {"sql_bytes": 1 << 20, "depth": 64, "window_calls": 64, "grouping_sets": 64, "set_operands": 32, "joins": 64}
RANKS = {"ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
#: No string of the dialect holds this character, so LIKE patterns have no escapes.
NO_ESCAPE = "\u0001"


@dataclass
class Node:
    """A token, or a group with its contents."""

    kind: str
    text: str = ""
    items: list = field(default_factory=list)
    at: int = -1  # where it begins in the source, and ends
    end: int = -2

    def is_(self, *words: str) -> bool:
        return self.kind in ("word", "op") and self.text.upper() in words


def word(text: str) -> Node:
    return Node("raw", text)


def parse(sql: str) -> list[Node]:
    """The tree of a statement."""
    if len(sql.encode()) > LIMITS["sql_bytes"]:
        raise Unsupported("the statement is too long")
    stack: list[list[Node]] = [[]]
    at = 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected {sql[at]!r} at {at}")
        at, kind, text = m.end(), m.lastgroup, m.group()
        if kind == "space":
            continue
        if text == "(":
            group = Node("group", at=m.start())
            stack[-1].append(group)
            stack.append(group.items)
            if len(stack) > LIMITS["depth"]:
                raise Unsupported("the statement is nested too deeply")
        elif text == ")":
            if len(stack) == 1:
                raise ParseError("unbalanced )")
            stack.pop()
            stack[-1][-1].end = at
        else:
            stack[-1].append(Node(kind, text, at=m.start(), end=at))
    if len(stack) > 1:
        raise ParseError("unbalanced (")
    return stack[0]


def show(items: list[Node]) -> str:
    """Spark SQL of a rewritten tree."""
    out = []
    for n in items:
        if n.kind == "group":
            out.append(f"({show(n.items)})")
        elif n.kind == "string":
            body = n.text[1:-1].replace("''", "'").replace("\\", "\\\\").replace("'", "\\'")
            out.append(f"'{body}'")
        elif n.kind == "quoted":
            out.append("`" + n.text[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif n.kind == "number":
            out.append(n.text + "D" if re.search(r"[.eE]", n.text) else n.text)
        elif n.kind == "param":
            out.append(f":p{n.text[1:]}")
        else:
            out.append(n.text)
    return re.sub(r" ?\. ?", ".", re.sub(r"(?<=[A-Za-z_0-9`]) \.|\. (?=[A-Za-z_`*])", ".", " ".join(out))) if any(n.is_(".") for n in items) else " ".join(out)


def split(items: list[Node], *words: str) -> list[list[Node]]:
    """The stretches between top-level tokens of the given words."""
    out: list[list[Node]] = [[]]
    for n in items:
        if n.is_(*words):
            out.append([])
        else:
            out[-1].append(n)
    return out


def find(items: list[Node], *phrase: str, start: int = 0) -> int:
    """Where a phrase of words begins at the top level, or -1."""
    for i in range(start, len(items) - len(phrase) + 1):
        if all(items[i + k].is_(w) for k, w in enumerate(phrase)):
            return i
    return -1


_CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "MINUS")


def _clause_end(items: list[Node], start: int) -> int:
    """Where the clause that begins at start ends."""
    i = start
    while i < len(items) and not items[i].is_(*_CLAUSES, "ROWS", "RANGE", "GROUPS", "ON", "RETURNING"):
        i += 1
    return i


def _sorted(items: list[Node]) -> list[Node]:
    """NULLS LAST for ascending keys and NULLS FIRST for descending ones, wherever it is not said."""
    out, i = [], 0
    while i < len(items):
        if items[i].is_("ORDER") and i + 1 < len(items) and items[i + 1].is_("BY"):
            end = _clause_end(items, i + 2)
            keys = []
            for key in split(items[i + 2 : end], ","):
                if not key:
                    raise ParseError("an empty ORDER BY key")
                if not any(k.is_("NULLS") for k in key):
                    key = [*key, word("NULLS FIRST" if key[-1].is_("DESC") else "NULLS LAST")]
                keys += [*key, Node("op", ",")]
            out += [*items[i : i + 2], *keys[:-1]]
            i = end
        else:
            out.append(items[i])
            i += 1
    return out


def _operand_start(items: list[Node], end: int) -> int:
    """Where the primary expression that ends before `end` begins."""
    i = end - 1
    if i < 0:
        raise ParseError("an operand is missing")
    if items[i].kind == "group" and i > 0 and items[i - 1].kind in ("word", "quoted") and not items[i - 1].is_("AND", "OR", "NOT", "WHERE", "ON", "HAVING", "SELECT", "WHEN", "THEN", "ELSE", "IN", "BY", "CASE", ","):
        i -= 1
    while i >= 2 and items[i - 1].is_("."):
        i -= 2
    return i


def quantified_case(op: str, x: str, query: str, every: bool) -> str:
    """x op ANY|ALL (query) as a value: counts and extremes of the set decide, with three-valued logic."""
    of = lambda what: f"(SELECT {what} FROM ({query}) AS q_(y_))"
    low, high, hit = of("MIN(y_)"), of("MAX(y_)"), f"({x} IN (SELECT y_ FROM ({query}) AS q_(y_) WHERE y_ IS NOT NULL))"
    holds = {"<": f"{x} < {high}", "<=": f"{x} <= {high}", ">": f"{x} > {low}", ">=": f"{x} >= {low}", "=": hit, "<>": f"({low} <> {x} OR {high} <> {x})"}
    fails = {"<": holds[">="], "<=": holds[">"], ">": holds["<="], ">=": holds["<"], "=": holds["<>"], "<>": holds["="]}
    decided, value = (fails[op], "FALSE") if every else (holds[op], "TRUE")
    rest = "TRUE" if every else "FALSE"
    return f"(CASE WHEN {of('COUNT(*)')} = 0 THEN {rest} WHEN {x} IS NULL THEN NULL WHEN COALESCE({decided}, FALSE) THEN {value} WHEN {of('COUNT(y_)')} < {of('COUNT(*)')} THEN NULL ELSE {rest} END)"


def _quantifiers(items: list[Node]) -> list[Node]:
    out: list[Node] = []
    i = 0
    while i < len(items):
        n = items[i]
        if n.is_("ANY", "SOME", "ALL") and i + 1 < len(items) and items[i + 1].kind == "group" and out and out[-1].is_("=", "<>", "!=", "<", "<=", ">", ">="):
            op = out.pop().text.replace("!=", "<>")
            begin = _operand_start(out, len(out))
            x, query = show(out[begin:]), show(items[i + 1].items)
            out[begin:] = [word(quantified_case(op, x, query, n.is_("ALL")))]
            i += 2
        else:
            out.append(n)
            i += 1
    return out


def _values_in(items: list[Node]) -> list[Node]:
    """In a select list, x [NOT] IN (SELECT ...) may be NULL."""
    out: list[Node] = []
    i = 0
    while i < len(items):
        n = items[i]
        if n.is_("IN") and i + 1 < len(items) and items[i + 1].kind == "group" and items[i + 1].items and items[i + 1].items[0].is_("SELECT", "WITH"):
            negated = bool(out) and out[-1].is_("NOT")
            if negated:
                out.pop()
            begin = _operand_start(out, len(out))
            x = show(out[begin:])
            out[begin:] = [word(quantified_case("<>" if negated else "=", x, show(items[i + 1].items), negated))]
            i += 2
        else:
            out.append(n)
            i += 1
    return out


def _likes(items: list[Node]) -> list[Node]:
    out: list[Node] = []
    for i, n in enumerate(items):
        out.append(n)
        if i and items[i - 1].is_("LIKE", "ILIKE") and not (i + 1 < len(items) and items[i + 1].text.upper().startswith("ESCAPE")):
            out.append(word(f"ESCAPE '{NO_ESCAPE}'"))
    return out


def _windows(items: list[Node], named: dict[str, list[Node]]) -> list[Node]:
    """FILTER and DISTINCT in window calls, windows that extend a named one, ranks as BIGINT, missing orders."""
    out: list[Node] = []
    i = calls = 0
    while i < len(items):
        n = items[i]
        if n.kind == "group" and not (n.items and n.items[0].is_("SELECT", "WITH")):
            n = Node("group", items=_windows(n.items, named))  # calls inside an expression
        if not (n.kind == "word" and i + 1 < len(items) and items[i + 1].kind == "group"):
            out.append(n)
            i += 1
            continue
        j, condition, between = i + 2, None, []
        while j < len(items) and items[j].is_("IGNORE", "RESPECT", "NULLS"):
            between.append(items[j])
            j += 1
        if j + 1 < len(items) and items[j].is_("FILTER") and items[j + 1].kind == "group":
            condition = items[j + 1].items[1:]
            j += 2
        if not (j + 1 <= len(items) - 1 and items[j].is_("OVER")):
            out.append(n)
            i += 1
            continue
        calls += 1
        if calls > LIMITS["window_calls"]:
            raise Unsupported("too many window calls")
        spec = items[j + 1].items if items[j + 1].kind == "group" else named.get(items[j + 1].text.lower())
        if spec is None:
            raise ParseError(f"no window {items[j + 1].text}")
        while spec and spec[0].kind in ("word", "quoted") and spec[0].text.lower() in named:
            base = named[spec[0].text.lower()]
            if find(spec, "PARTITION") >= 0 or find(base, "ROWS") >= 0 or find(base, "RANGE") >= 0 or find(base, "GROUPS") >= 0 or (find(base, "ORDER") >= 0 and find(spec[1:], "ORDER") >= 0):
                raise Unsupported("a window may only add what the named one lacks")
            spec = [*base, *spec[1:]]
        if find(spec, "GROUPS") >= 0:
            raise Unsupported("GROUPS frames: use operators.windows.groups_frame")
        if find(spec, "EXCLUDE") >= 0:
            raise Unsupported("EXCLUDE")
        name, args = n.text.upper(), items[i + 1].items
        if name in ("ROW_NUMBER", "NTILE") and find(spec, "ORDER") < 0:
            spec = [*spec, word("ORDER BY (SELECT NULL)")]
        over = f"OVER ({show(_sorted(spec))})"
        if condition is not None:
            if name not in AGGREGATES:
                raise Unsupported("FILTER needs an aggregate")
            distinct = bool(args) and args[0].is_("DISTINCT")
            inner = "1" if args and args[0].is_("*") else show(args[1:] if distinct else args)
            args = [*([Node("word", "DISTINCT")] if distinct else []), word(f"CASE WHEN {show(condition)} THEN {inner} END")]
        if args and args[0].is_("DISTINCT"):
            values = f"collect_set({show(args[1:])}) {over}"
            text = {"COUNT": f"CAST(size({values}) AS BIGINT)", "MIN": f"array_min({values})", "MAX": f"array_max({values})"}.get(name)
            total = f"aggregate({values}, CAST(0 AS {{}}), (a_, b_) -> CAST(a_ + b_ AS {{}}))"
            if name == "SUM":
                text = f"CASE WHEN size({values}) > 0 THEN {total.format('BIGINT', 'BIGINT')} END"
            elif name == "AVG":
                text = f"CASE WHEN size({values}) > 0 THEN {total.format('DOUBLE', 'DOUBLE')} / size({values}) END"
        else:
            text = f"{n.text}({show(args)}) {show(between)} {over}"
        out.append(word(f"CAST({text} AS BIGINT)" if name in RANKS else text))
        i = j + 2
    return out


def _groupings(items: list[Node]) -> list[Node]:
    out: list[Node] = []
    for i, n in enumerate(items):
        if i and items[i - 1].is_("GROUPING") and n.kind == "group":
            keys = split(n.items, ",")
            if len(keys) > 31:
                raise Unsupported("GROUPING takes at most 31 arguments")
            bits = " + ".join(f"CAST(GROUPING({show(k)}) AS INT) * {1 << (len(keys) - 1 - p)}" for p, k in enumerate(keys))
            out[-1] = word(f"CAST({bits} AS INT)")
        else:
            out.append(n)
    return out


def _has_aggregate(items: list[Node]) -> bool:
    """Whether an expression calls an aggregate, subqueries apart."""
    for i, n in enumerate(items):
        if n.kind == "group":
            if not (n.items and n.items[0].is_("SELECT", "WITH")) and _has_aggregate(n.items):
                return True
        elif n.kind == "word" and n.text.upper() in AGGREGATES and i + 1 < len(items) and items[i + 1].kind == "group":
            return True
    return False


def _is_constant(items: list[Node]) -> bool:
    """Literals and what is made of them; an alias may follow."""
    at = find(items, "AS")
    return all(n.kind in ("number", "string", "blob", "param") or n.is_("NULL", "TRUE", "FALSE", "DATE", "TIMESTAMP", "TIME", "+", "-", "*", "/", "||") or n.kind == "group" and _is_constant(n.items) for n in (items[:at] if at >= 0 else items))


def _constant_groups(items: list[Node]) -> list[Node]:
    """GROUP BY ALL of constants and aggregates alone groups by nothing: constants are no keys."""
    at = find(items, "GROUP", "BY")
    begin, stop = find(items, "SELECT"), find(items, "FROM")
    if at < 0 or at + 2 >= len(items) or not items[at + 2].is_("ALL") or begin < 0 or stop < 0:
        return items
    outputs = split(items[begin + 1 : stop], ",")
    if all(_has_aggregate(o) or _is_constant(o) for o in outputs) and any(map(_has_aggregate, outputs)):
        return items[:at] + items[at + 3 :]
    return items


def _sets(items: list[Node]) -> tuple[int, int, int, list[list[Node]]]:
    """Where a grouping extension begins and ends, how many empty sets it has, and its keys; none: -1."""
    at = find(items, "GROUP", "BY")
    if at < 0:
        return -1, -1, 0, []
    end = _clause_end(items, at + 2)
    parts = split(items[at + 2 : end], ",")
    if len(parts) != 1 or not parts[0]:
        return -1, -1, 0, []
    part = parts[0]
    unwrapped = lambda k: k[0].items if len(k) == 1 and k[0].kind == "group" else k
    if part[0].is_("ROLLUP", "CUBE") and len(part) == 2:
        keys = [x for k in split(part[1].items, ",") for x in split(unwrapped(k), ",")]
        return at, end, 1, keys
    if part[0].is_("GROUPING") and len(part) == 3 and part[1].is_("SETS"):
        sets = split(part[2].items, ",")
        empty, keys = 0, []
        for one in sets:
            if one and one[0].is_("ROLLUP", "CUBE"):
                empty += 1
                keys += split(one[1].items, ",")
            elif len(one) == 1 and one[0].kind == "group" and not one[0].items:
                empty += 1
            else:
                keys += split(unwrapped(one), ",")
        return at, end, empty, keys
    return -1, -1, 0, []


def _without_keys(items: list[Node], keys: list[str]) -> list[Node]:
    """An expression of the empty grouping set: keys are NULL, and GROUPING has all its bits; aggregates' arguments stay."""
    out: list[Node] = []
    i = 0
    while i < len(items):
        n = items[i]
        for text, size in ((show(items[i : i + k]), k) for k in range(min(12, len(items) - i), 0, -1)):
            if text.lower() in keys and not (out and out[-1].is_(".")) and not (i + size < len(items) and (items[i + size].is_(".") or items[i + size].kind == "group")) and not (out and out[-1].is_("AS")):
                out.append(word("NULL"))
                i += size
                break
        else:
            if n.kind == "word" and i + 1 < len(items) and items[i + 1].kind == "group" and n.text.upper() in AGGREGATES:
                out += items[i : i + 2]
                i += 2
            elif n.is_("GROUPING") and i + 1 < len(items) and items[i + 1].kind == "group":
                out.append(word(str((1 << len(split(items[i + 1].items, ","))) - 1)))
                i += 2
            else:
                out.append(Node("group", items=_without_keys(n.items, keys)) if n.kind == "group" and not (n.items and n.items[0].is_("SELECT", "WITH")) else n)
                i += 1
    return out


def _empty_sets(items: list[Node]) -> list[Node]:
    """Empty grouping sets have their row over an empty input too, which Spark leaves out: a union adds it where there is no row."""
    begin, stop = find(items, "SELECT"), find(items, "FROM")
    at, end, empty, keys = _sets(items)
    if at < 0 or not empty or begin < 0 or stop < 0 or any(n.is_("OVER", "QUALIFY") for n in items) or items[begin + 1].is_("*", "DISTINCT"):
        return items
    names = [show(k).lower() for k in keys]
    names += [n.split(".")[-1] for n in names if re.fullmatch(r"[\w`]+\.[\w`]+", n)]
    order = find(items, "ORDER", "BY")
    tail_at = min((p for p in (order, find(items, "LIMIT"), find(items, "OFFSET")) if p >= 0), default=len(items))
    body, tail = items[:tail_at], items[tail_at:]
    outputs = split(body[begin + 1 : stop], ",")
    hidden: list[list[Node]] = []
    if order >= 0:
        stop_order = _clause_end(tail, 2)
        sort = []
        aliases = {o[-1].text.lower() for o in outputs if o[-1].kind in ("word", "quoted")}
        for key in split(tail[2:stop_order], ","):
            length = next((i for i, k in enumerate(key) if k.is_("ASC", "DESC", "NULLS")), len(key))
            if length == 1 and (key[0].kind == "number" or key[0].text.lower() in aliases):
                sort.append(key)
            else:
                hidden.append([*key[:length], Node("word", "AS"), Node("word", f"o{len(hidden)}_")])
                sort.append([Node("word", f"o{len(hidden) - 1}_"), *key[length:]])
        tail = [*tail[:2], *[x for k in sort for x in (Node("op", ","), *k)][1:], *tail[stop_order:]]
    listed = [*outputs, *hidden]
    comma = lambda parts: [x for p in parts for x in (Node("op", ","), *p)][1:]
    grouped = [*body[: begin + 1], *comma(listed), *body[stop:]]
    having = find(body, "HAVING")
    condition = [Node("word", "COUNT"), Node("group", items=[Node("op", "*")]), Node("op", "="), Node("number", "0")]
    if having >= 0:
        condition += [Node("word", "AND"), Node("group", items=_without_keys(body[having + 1 :], names))]
    where = find(body, "WHERE")
    source, kept = (body[stop:at], []) if where < 0 else (body[stop:where], [Node("group", items=body[where + 1 : at])])
    nothing = [Node("word", "WHERE"), *kept, *([Node("word", "AND")] if kept else []), Node("word", "FALSE")]
    over_nothing = [Node("word", "SELECT"), *comma([_without_keys(o, names) for o in listed]), *source, *nothing, Node("word", "HAVING"), *condition]
    # Whether there is a row is asked with a limit of one, so the input is not read twice.
    some = [Node("word", "SELECT"), Node("number", "1"), *source, *([Node("word", "WHERE"), *kept] if kept else [])]
    once = [*(Node("op" if w == "*" else "word", w) for w in ("SELECT", "*", "FROM")), Node("group", items=over_nothing), *(Node("word", w) for w in ("WHERE", "NOT", "EXISTS")), Node("group", items=some)]
    union = list(grouped)
    for _ in range(empty):
        union += [Node("word", "UNION"), Node("word", "ALL"), *once]
    rows = show(_rewrite(union, sets=False))
    shown = f"* EXCEPT ({', '.join(f'o{i}_' for i in range(len(hidden)))})" if hidden else "*"
    return [word(f"SELECT {shown} FROM ({rows})"), *_sorted(tail)]


def _name_of(output: list[Node]) -> str | None:
    """The name that an output has by an alias or as a plain column."""
    if not output or output[-1].kind not in ("word", "quoted"):
        return None
    plain = all(n.kind in ("word", "quoted") if i % 2 == 0 else n.is_(".") for i, n in enumerate(output))
    return output[-1].text.lower() if plain or len(output) > 2 and output[-2].is_("AS") else None


def _spelled(items: list[Node], aliases: dict[str, list[Node]]) -> list[Node]:
    """A sort key with the expressions of the outputs that it names."""
    out: list[Node] = []
    for i, n in enumerate(items):
        follows = i + 1 < len(items) and (items[i + 1].is_(".") or items[i + 1].kind == "group")
        if n.kind == "group":
            out.append(n if n.items and n.items[0].is_("SELECT", "WITH") else Node("group", items=_spelled(n.items, aliases)))
        elif n.kind in ("word", "quoted") and n.text.lower() in aliases and not follows and not (i and items[i - 1].is_(".")):
            out.append(Node("group", items=aliases[n.text.lower()]))
        else:
            out.append(n)
    return out


def _hidden_keys(items: list[Node]) -> tuple[list[Node], str] | None:
    """A subquery with ORDER BY and LIMIT whose sort keys are all outputs, and the names of those added; None: it is so already.

    Above a sort by what is no output Spark puts a projection. In a correlated subquery that parts the limit from its sort: the
    rows are numbered in no order, and which are kept depends on how they arrive.
    """
    begin, order = find(items, "SELECT"), find(items, "ORDER", "BY")
    if begin < 0 or order < 0 or find(items, "LIMIT") < 0 and find(items, "OFFSET") < 0 or items[begin + 1].is_("DISTINCT"):
        return None
    if any(n.is_("UNION", "INTERSECT", "EXCEPT", "MINUS") for n in items):  # their keys are outputs
        return None
    stop = next((i for i in range(begin, order) if items[i].is_("FROM") and not items[i - 1].is_("DISTINCT")), -1)
    if stop < 0:
        return None
    outputs, end = split(items[begin + 1 : stop], ","), _clause_end(items, order + 2)
    names = {_name_of(o) for o in outputs}
    aliases = {o[-1].text.lower(): o[:-2] for o in outputs if len(o) > 2 and o[-2].is_("AS") and o[-1].kind in ("word", "quoted")}
    columns = {show(o) for o in outputs if _name_of(o) and not (len(o) > 2 and o[-2].is_("AS"))}
    hidden: list[Node] = []
    keys: list[Node] = []
    count = 0
    for key in split(items[order + 2 : end], ","):
        length = next((i for i, k in enumerate(key) if k.is_("ASC", "DESC", "NULLS")), len(key))
        bare = length == 1 and (key[0].kind == "number" or key[0].text.lower() in names)
        if not (length == 0 or bare or show(key[:length]) in columns):
            name = Node("word", f"o{count}_")
            count += 1
            hidden += [Node("op", ","), *_spelled(key[:length], aliases), Node("word", "AS"), name]
            key = [name, *key[length:]]
        keys += [Node("op", ","), *key]
    if not count:
        return None
    return [*items[:stop], *hidden, *items[stop : order + 2], *keys[1:], *items[end:]], ", ".join(f"o{i}_" for i in range(count))


def _raw(items: list[Node]) -> str:
    """The text of a tree as it was typed."""
    out, end = "", 0
    for n in items:
        out += ("" if n.at == end or not out else " ") + (f"({_raw(n.items)})" if n.kind == "group" else n.text)
        end = n.end
    return out


def ordered_limits(sql: str) -> str:
    """Spark SQL whose subqueries with ORDER BY and LIMIT keep their rows by that order; other text as it is."""
    changed = False

    def level(items: list[Node], sub: bool) -> list[Node]:
        nonlocal changed
        items = [Node("group", items=level(n.items, True), at=n.at, end=n.end) if n.kind == "group" else n for n in items]
        made = _hidden_keys(items) if sub and items and items[0].is_("SELECT", "WITH") else None
        if made is None:
            return items
        changed = True
        return [word(f"SELECT * EXCEPT ({made[1]}) FROM"), Node("group", items=made[0])]

    made = level(parse(sql), False) if re.search(r"\b(?:LIMIT|OFFSET)\b", sql, re.I) else []
    return _raw(made) if changed else sql


def _select(items: list[Node], sets: bool = True) -> list[Node]:
    """One SELECT without set operations around it."""
    items = _constant_groups(items)
    if sets:
        made = _empty_sets(items)
        if made is not items:
            return made
    named: dict[str, list[Node]] = {}
    at = find(items, "WINDOW")
    if at >= 0:
        end = _clause_end(items, at + 1)
        for definition in split(items[at + 1 : end], ","):
            if len(definition) == 3 and definition[1].is_("AS"):
                named[definition[0].text.lower()] = definition[2].items
        items = items[:at] + items[end:]
        for name, spec in list(named.items()):
            while spec and spec[0].kind == "word" and spec[0].text.lower() in named:
                spec = [*named[spec[0].text.lower()], *spec[1:]]
            named[name] = spec
    at = find(items, "GROUP", "BY")
    if at >= 0 and at + 2 < len(items) and items[at + 2].kind == "group" and not items[at + 2].items and (at + 3 == len(items) or not items[at + 3].is_(",")):
        items = items[:at] + items[at + 3 :]
        if find(items, "HAVING") < 0 and not any(n.kind == "word" and n.text.upper() in AGGREGATES for n in items):
            raise Unsupported("GROUP BY () without an aggregate")
    items = _groupings(items)
    begin = find(items, "SELECT")
    stop = find(items, "FROM")
    stop = len(items) if stop < 0 else stop
    if begin >= 0:
        items = [*items[: begin + 1], *_values_in(items[begin + 1 : stop]), *items[stop:]]
    items = _quantifiers(items)
    at = find(items, "QUALIFY")
    if at >= 0:
        end = _clause_end(items, at + 1)
        condition, tail = items[at + 1 : end], items[end:]
        head = items[:at]
        first, stop = find(head, "SELECT"), find(head, "FROM")
        if not any(n.is_("OVER") for n in [*head, *condition]):
            raise Unsupported("QUALIFY needs a window call")
        inner = [*head[:stop], Node("op", ","), Node("group", items=condition), word("AS q_"), *head[stop:]]
        distinct = inner[first + 1].is_("DISTINCT")
        if distinct:
            del inner[first + 1]
        sub = show(_windows(_sorted(_likes(inner)), named))
        # The group holding the condition is rewritten with the rest, so its window calls are seen too.
        return [word(f"SELECT {'DISTINCT ' * distinct}* EXCEPT (q_) FROM ({sub}) WHERE q_"), *_sorted(tail)]
    return _windows(_sorted(_likes(items)), named)


def _rewrite(items: list[Node], sets: bool = True) -> list[Node]:
    """Groups first, then the level itself, each SELECT of a set operation on its own."""
    items = [Node("group", items=_inner(n.items)) if n.kind == "group" else n for n in items]
    items = [word("TIMESTAMP_NTZ") if n.is_("TIMESTAMP") and i + 1 < len(items) and items[i + 1].kind == "string" else n for i, n in enumerate(items)]
    out: list[Node] = []
    part: list[Node] = []
    operands = 1
    for n in items:
        if n.is_("UNION", "INTERSECT", "EXCEPT", "MINUS"):
            operands += 1
            out += [*_select(part, False), n]
            part = []
        else:
            part.append(n)
    if operands > LIMITS["set_operands"]:
        raise Unsupported("too many set operations")
    return [*out, *_select(part, sets and operands == 1)]


def _inner(items: list[Node]) -> list[Node]:
    # A condition in parentheses may hold window calls whose named windows are outside; they are rewritten with the outside.
    if items and items[0].is_("SELECT", "WITH", "VALUES") or any(n.is_("UNION", "INTERSECT", "EXCEPT", "MINUS") for n in items):
        made = _hidden_keys(items)
        return _rewrite(items) if made is None else [Node("word", "SELECT"), word(f"* EXCEPT ({made[1]}) FROM ({show(_rewrite(made[0]))})")]
    return [Node("group", items=_inner(n.items)) if n.kind == "group" else n for n in _quantifiers(_likes(_groupings(items)))]


def to_spark(sql: str) -> str:
    """Spark SQL of one query in the dialect."""
    items = parse(sql)
    while items and items[-1].is_(";"):
        items.pop()
    if any(n.is_("TABLESAMPLE") for n in items):
        raise Unsupported("TABLESAMPLE")
    return show(_rewrite(items))
