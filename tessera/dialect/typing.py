"""Types that Spark gives otherwise than the dialect: whole-number division, SUM and AVG of REAL.

A rewriter of text knows no types. The query is analysed once; where the plan shows such an expression, its place in
the text (which Spark keeps) tells what to write instead, and the query is analysed again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Rounds of rewriting: one for each level of divisions inside divisions.
MOST = 64
_WHOLE = {"int": "INT", "bigint": "BIGINT", "smallint": "INT", "tinyint": "INT"}


def typed(run: Callable[[str], DataFrame], text: str) -> DataFrame:
    """run(text), with the dialect's types."""
    return _typed(run, text)[0]


def typed_text(run: Callable[[str], DataFrame], text: str) -> str:
    """The text that has the dialect's types; run only analyses it."""
    return _typed(run, text)[1] if "/" in text else text


def _typed(run: Callable[[str], DataFrame], text: str) -> tuple[DataFrame, str]:
    df = run(text)
    if "/" not in text and not re.search(r"\b(?:sum|avg)\s*\(", text, re.I):
        return df, text
    done: set[str] = set()
    for _ in range(MOST):
        plan = df._jdf.queryExecution().analyzed()
        if "/" not in text and '"float"' not in plan.toJSON():
            return df, text
        change = _change(plan, text, done)
        if change is None:
            return df, text
        a, b, new = change
        text = text[:a] + new + text[b:]
        done.add(new)
        df = run(text)
    return df, text


def _place(node) -> tuple[int, int] | None:
    origin = node.origin()
    start, stop = origin.startIndex(), origin.stopIndex()
    return (int(start.get()), int(stop.get()) + 1) if start.isDefined() and stop.isDefined() else None


def _change(plan, text: str, done: set[str]) -> tuple[int, int, str] | None:
    """The innermost stretch of the text to replace, and what by."""
    best = None
    for node, kind in _expressions(plan):
        found = None
        if kind == "Divide":
            found = _division(node, text)
        elif kind in ("Sum", "Average"):
            found = _real(node, text, done)
        if found and (best is None or found[1] - found[0] < best[1] - best[0]):
            best = found
    return best


def _division(node, text: str) -> tuple[int, int, str] | None:
    sides = []
    for child in (node.left(), node.right()):
        kind = child.child().dataType().simpleString() if child.getClass().getSimpleName() == "Cast" and _place(child) is None or child.getClass().getSimpleName() == "Cast" and child.dataType().simpleString() == "double" else child.dataType().simpleString()
        sides.append((child, kind))
    place = _place(node)
    if place is None or any(k not in _WHOLE for _, k in sides):
        return None
    a, b = place
    slash = _slash(text[a:b])
    if slash is None:
        return None
    small = all(_WHOLE[k] == "INT" for _, k in sides)
    left, right = text[a : a + slash].strip(), text[a + slash + 1 : b].strip()
    return a, b, f"CAST(({left}) div ({right}) AS INT)" if small else f"(({left}) div ({right}))"


def _slash(text: str) -> int | None:
    """The last division of a text outside parentheses and strings: the outermost of a chain, which groups to the left."""
    depth, found, quoted = 0, None, None
    for i, c in enumerate(text):
        if quoted:
            quoted = None if c == quoted and text[i - 1] != "\\" else quoted
        elif c in "'`":
            quoted = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "/" and not depth:
            found = i
    return found


def _real(node, text: str, done: set[str]) -> tuple[int, int, str] | None:
    if node.child().dataType().simpleString() != "float":
        return None
    place = _place(node)
    if place is None:
        return None
    a = place[0]
    head = re.match(r"\w+\s*\(", text[a:])
    if not head:
        return None
    b = _closed(text, a + head.end() - 1)
    while follows := re.match(r"\s*(?:FILTER|OVER)\s*\(", text[b:], re.I):
        b = _closed(text, b + follows.end() - 1)
    new = f"CAST({text[a:b]} AS FLOAT)"
    return None if text[max(0, a - 5) : a].upper() == "CAST(" and text[b:].lstrip().upper().startswith("AS FLOAT)") else (a, b, new)


def _closed(text: str, at: int) -> int:
    """Where the parenthesis that opens at `at` ends."""
    depth, quoted = 0, None
    for i in range(at, len(text)):
        c = text[i]
        if quoted:
            quoted = None if c == quoted else quoted
        elif c in "'`":
            quoted = c
        else:
            depth += (c == "(") - (c == ")")
            if not depth:
                return i + 1
    return len(text)


def _seq(items):
    for i in range(items.size()):
        yield items.apply(i)


def _expressions(plan):
    """(expression, class name) of a plan, its children, its definitions and its subqueries."""
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name in ("Divide", "Sum", "Average"):
            yield node, name
        stack.extend(_seq(node.children()))
        if hasattr(node, "expressions") and _is_plan(node):
            stack.extend(_seq(node.expressions()))
            stack.extend(x for x in _seq(node.innerChildren()) if _is_plan(x))
        elif name.endswith("Subquery") or name in ("Exists", "ListQuery"):
            stack.append(node.plan())


def _is_plan(node) -> bool:
    return ".plans." in node.getClass().getName() or ".execution." in node.getClass().getName()
