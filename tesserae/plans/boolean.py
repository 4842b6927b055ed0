"""The boolean query language: text to tokens to a tree to one Spark Column.

``OR`` binds least, then ``AND`` (also implied, and ``NEAR``), then ``NOT``. Words match whole words
and may hold ``*``; quoted phrases match as substrings; ``field:value`` looks into other columns. The
tree is plain data, so queries compose without going through text again, and Catalyst sees one
expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import casefold


class QueryError(ValueError):
    """The query can't be read."""


# Prefixes, the columns they look into, and how their value is met.
FIELDS: dict[str, tuple[tuple[str, ...], str]] = {
    "author": (("author_handle", "author_name"), "word"),
    "handle": (("author_handle",), "word"),
    "name": (("author_name",), "word"),
    "author_id": (("author_id",), "part"),
    "url": (("url",), "part"),
    "link": (("url",), "part"),
    "hashtag": (("hashtags",), "word"),
    "hashtags": (("hashtags",), "word"),
    "tag": (("hashtags",), "word"),
    "language": (("language",), "token"),
    "lang": (("language",), "token"),
    "country": (("country",), "token"),
    "region": (("region",), "token"),
    "platform": (("platform",), "token"),
    "source": (("source_dataset",), "part"),
    "dataset": (("source_dataset",), "part"),
    "id": (("post_id",), "part"),
    "post_id": (("post_id",), "part"),
}
#: Scripts written without spaces between words: their words match as substrings.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")


@dataclass(frozen=True)
class Node:
    """``kind`` is word, phrase, field, and, or, not, or all (the empty query)."""

    kind: str
    value: str = ""
    name: str = ""
    quoted: bool = False
    parts: tuple[Node, ...] = field(default_factory=tuple)


_LEX = re.compile(r'\s+|(?P<paren>[()])|"(?P<phrase>[^"]*)"?|(?P<word>(?:"[^"]*"?|[^\s()"])+)')
_FIELD = re.compile(r"([A-Za-z_]\w*):(.*)", re.DOTALL)


def tokenize(query: str) -> list[tuple[str, Node | str]]:
    """Tokens: ``(``, ``)``, AND, OR, NOT, and ``atom`` with its node. An open quote runs to the end."""
    out: list[tuple[str, Node | str]] = []
    for m in _LEX.finditer(query):
        if m["paren"]:
            out.append((m["paren"], m["paren"]))
        elif m["phrase"] is not None:
            out.append(("atom", Node("phrase", m["phrase"])))
        elif m["word"]:
            out.append(_word(m["word"]))
    return out


def _word(raw: str) -> tuple[str, Node | str]:
    upper = raw.upper()
    if upper in ("AND", "NEAR"):
        return "AND", raw
    if upper in ("OR", "NOT"):
        return upper, raw
    if (m := _FIELD.fullmatch(raw)) and m[1].lower() in FIELDS:
        return "atom", Node("field", m[2].replace('"', ""), m[1].lower(), quoted='"' in m[2])
    return "atom", Node("word", raw.replace('"', ""))


def parse(query: str | None) -> Node:
    """The tree of a query; an empty one matches all rows."""
    tokens = tokenize(query or "")
    if not tokens:
        return Node("all")
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while peek() == "OR":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    def both() -> Node:
        nonlocal at
        parts = [unary()]
        while peek() in ("AND", "NOT", "(", "atom"):
            if peek() == "AND":
                at += 1
            parts.append(unary())
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def unary() -> Node:
        nonlocal at
        if peek() == "NOT":
            at += 1
            return Node("not", parts=(unary(),))
        kind = peek()
        if kind == "(":
            at += 1
            inside = either()
            if peek() != ")":
                raise QueryError("a ) is missing")
            at += 1
            return inside
        if kind != "atom":
            raise QueryError(f"a term is missing before {tokens[at][1]!r}" if kind else "the query ends too soon")
        at += 1
        return tokens[at - 1][1]

    tree = either()
    if at < len(tokens):
        raise QueryError(f"nothing can follow before {tokens[at][1]!r}")
    return tree


def from_tree(rule: dict) -> Node:
    """The tree of a visual builder: groups (AND, OR, NOT) of rules (field, value)."""
    if "children" in rule:
        parts = tuple(from_tree(r) for r in rule["children"])
        if not parts:
            return Node("all")
        op = str(rule.get("op", "AND")).upper()
        if op == "NOT":  # the first, without the others
            return parts[0] if len(parts) == 1 and rule.get("keep_single") else Node("and", parts=(parts[0], *(Node("not", parts=(p,)) for p in parts[1:])))
        return parts[0] if len(parts) == 1 else Node(op.lower(), parts=parts)
    value, name = str(rule.get("value", "")), str(rule.get("field", "text"))
    if name in ("", "text"):
        return Node("phrase" if re.search(r"\s", value) else "word", value)
    return Node("field", value, name, quoted=bool(re.search(r"\s", value)))


def compose(a: Node, glue: str, b: Node) -> Node:
    """``and``, ``or``, ``and_not`` or ``or_not`` of two trees."""
    right = Node("not", parts=(b,)) if glue.endswith("_not") else b
    return Node(glue.removesuffix("_not"), parts=(a, right))


def fold(word: str) -> str:
    return word.lower().replace("ß", "ss").replace("ς", "σ")


def word_pattern(word: str) -> str:
    """A Java pattern for a word; ``*`` stands for word characters."""
    body = r"\w*".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in fold(word).split("*"))
    return body if UNSPACED.search(word) else rf"(?U)\b{body}\b"


def to_column(node: Node, df: DataFrame, text: str = "text") -> Column:
    """One boolean Column, never null. Columns that ``df`` lacks read as empty."""
    kinds = dict(df.dtypes)

    def read(name: str) -> Column:
        if name not in kinds:
            return F.lit("")
        c = F.array_join(F.col(name), " ") if kinds[name].startswith("array") else F.col(name).cast("string")
        return casefold(F.coalesce(c, F.lit("")))

    def met(c: Column, value: str, phrase: bool) -> Column:
        return c.contains(fold(value)) if phrase else c.rlike(word_pattern(value))

    def walk(n: Node) -> Column:
        if n.kind == "all":
            return F.lit(True)
        if n.kind == "not":
            return ~walk(n.parts[0])
        if n.kind in ("and", "or"):
            out = walk(n.parts[0])
            for p in n.parts[1:]:
                out = out & walk(p) if n.kind == "and" else out | walk(p)
            return out
        if n.kind in ("word", "phrase"):
            return met(read(text), n.value, n.kind == "phrase")
        columns, how = FIELDS[n.name]
        out = F.lit(False)
        for name in columns:
            c = read(name)
            if not n.value:
                one = F.trim(c) == ""
            elif how == "part":
                one = c.contains(fold(n.value))
            elif how == "token":
                value = re.sub(r"([^\w\s])", r"\\\1", fold(n.value))
                one = (F.trim(c) == fold(n.value)) | c.rlike(rf"(?:^|[,\s;|]){value}(?:$|[,\s;|])")
            else:
                one = met(c, n.value, n.quoted)
            out = out | one
        return out

    return walk(node)


def matching(df: DataFrame, query: str | Node | None, text: str = "text") -> DataFrame:
    """The rows that a query matches."""
    tree = query if isinstance(query, Node) else parse(query)
    return df if tree.kind == "all" else df.where(to_column(tree, df, text))
