"""The query language: terms, "phrases", + - NOT, AND OR, parentheses, field:term, ranges [a TO b], sets IN [a b] and boosts ^2, as a boolean tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from seekspark.errors import QueryParseError

FIELDS = ("title", "body")
#: Fields that are searched whole, and only by name.
RAW = ("url",)
_LEXEME = re.compile(
    r'\s*(?:(?P<open>\()|(?P<close>\)(?:\^(?P<whole>\d+(?:\.\d+)?))?)|(?P<sign>[+-])(?=\S)|(?:(?P<field>[A-Za-z_]\w*):)?'
    r'(?:(?P<set>\s*IN\s*\[[^\]]*\])|(?P<range>[\[{][^\]}]*\sTO\s[^\]}]*[\]}])|"(?P<phrase>[^"]*)"|(?P<word>[^\s()"]+?))(?:\^(?P<boost>\d+(?:\.\d+)?))?(?=[\s()"]|$))'
)
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Leaf:
    """A term, or several that stand in a row, in one field or in any; or any term of a set, or between bounds (low, high, each open or not, None: no bound)."""

    terms: tuple[str, ...]
    field: str | None = None
    boost: float = 1.0
    among: bool = False
    bounds: tuple | None = None


@dataclass(frozen=True)
class Node:
    """op: and, or. ``parts`` match as op says; nothing of ``without`` may match."""

    op: str
    parts: tuple = ()
    without: tuple = ()


def _known(name: str | None) -> None:
    if name is not None and name not in (*FIELDS, *RAW):
        raise QueryParseError(f"no field {name!r}")


def _terms(text: str, name: str | None) -> tuple[str, ...]:
    return tuple(text.split()) if name in RAW else tuple(w.lower() for w in _WORD.findall(text) if len(w.lower().encode()) < 40)


def _leaf(text: str, name: str | None, phrase: bool):
    _known(name)
    if name in RAW:
        return Leaf((text,), name)
    words = _terms(text, name)
    if not words:
        return None
    return Leaf(words, name) if phrase or len(words) == 1 else Node("and", tuple(Leaf((w,), name) for w in words))


def _range(text: str, name: str | None):
    _known(name)
    low, high = re.split(r"\sTO\s", text[1:-1].strip(), maxsplit=1)
    ends = tuple(None if x.strip() == "*" else (x.strip() if name in RAW else x.strip().lower()) for x in (low, high))
    return Leaf((), name, bounds=(*ends, text[0] == "[", text[-1] == "]"))


def _set(text: str, name: str | None):
    _known(name)
    words = _terms(text[text.index("[") + 1 : -1], name)
    return Leaf(tuple(dict.fromkeys(words)), name, among=True) if words else None


def _boosted(tree, by: float):
    """Every leaf counts ``by`` times as much."""
    if isinstance(tree, Leaf):
        return replace(tree, boost=tree.boost * by)
    return tree if tree is None or by == 1 else Node(tree.op, tuple(_boosted(p, by) for p in tree.parts), tree.without)


def parse(query: str, default: str = "and") -> Node | Leaf | None:
    """The tree of a query string; None if it holds no term. ``default`` joins what stands side by side."""
    if query.count('"') % 2:
        raise QueryParseError("a phrase isn't closed")
    at, found = 0, []
    query = query.rstrip()
    while at < len(query):
        m = _LEXEME.match(query, at)
        if not m or m.end() == at:
            raise QueryParseError(f"can't read {query[at:]!r}")
        found.append(m)
        at = m.end()
    tree, rest = _group(found, 0, default, False)
    if rest != len(found):
        raise QueryParseError("a parenthesis too many")
    return tree


def _group(found, i, default, inner):
    """One level: alternatives of OR, each a row of clauses."""
    rows, must, may, never = [], [], [], []

    def close() -> None:
        join = tuple(must) if must else ()
        parts = join if default == "or" and must else join + tuple(may)
        if parts or never:
            rows.append(Node("and" if must or default == "and" else "or", parts, tuple(never)) if len(parts) != 1 or never else parts[0])
        must.clear(), may.clear(), never.clear()

    sign, chained = "", False
    while i < len(found):
        m = found[i]
        if m["close"]:
            if not inner:
                raise QueryParseError("a parenthesis too many")
            break
        word = m["word"] if not m["field"] else None
        if m["sign"]:
            sign = m["sign"]
        elif word in ("AND", "OR", "NOT"):
            if word == "NOT":
                sign = "-"
            elif i in (0, len(found) - 1):
                raise QueryParseError(f"{word} joins two sides")
            elif word == "OR":
                close()
            else:
                chained = True
        else:
            if m["open"]:
                item, i = _group(found, i + 1, default, True)
                if i >= len(found):
                    raise QueryParseError("a parenthesis isn't closed")
                item = _boosted(item, float(found[i]["whole"] or 1))
            else:
                make = _set if m["set"] else _range if m["range"] else None
                item = make(m["set"] or m["range"], m["field"]) if make else _leaf(m["phrase"] if m["phrase"] is not None else m["word"], m["field"], m["phrase"] is not None)
                item = _boosted(item, float(m["boost"] or 1))
            if item is not None:
                if chained and may:
                    must.append(may.pop())
                (never if sign == "-" else must if sign == "+" or chained else may).append(item)
            sign, chained = "", False
        i += 1
    close()
    if not rows:
        return None, i
    return (rows[0] if len(rows) == 1 else Node("or", tuple(rows))), i


def leaves(tree) -> list[Leaf]:
    """The leaves that may add to a score, each once."""
    if tree is None:
        return []
    if isinstance(tree, Leaf):
        return [tree]
    return list(dict.fromkeys(x for p in tree.parts for x in leaves(p)))


def all_leaves(tree) -> list[Leaf]:
    if tree is None:
        return []
    if isinstance(tree, Leaf):
        return [tree]
    return list(dict.fromkeys(x for p in (*tree.parts, *tree.without) for x in all_leaves(p)))


def words_of(query: str) -> list[str]:
    return query.split()
