"""Declarations of TypeScript, JavaScript and Ruby sources: a table-generating operator.

Sources are scanned by a small lexer that knows strings, templates, comments and regular
expressions, and tracks brackets (scripts) or block words (Ruby). The scan keeps no state
between files, so it runs on each partition by itself; files that fail give an error row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import UnsupportedLanguage
from tessera.session import ship

LANGUAGES = ("typescript", "javascript", "ruby")
NODE_SCHEMA = "path string, language string, node_seq int, type string, name string, content string, start_line int, end_line int, start_char int, end_char int, error string"
_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (c.split() for c in NODE_SCHEMA.split(", "))])


@dataclass
class Node:
    type: str
    name: str
    start: int
    end: int


# ---- scripts ---------------------------------------------------------------------------------

_TOKEN = re.compile(r"""
    \s*+ (?: (?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)) | (?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
  | (?P<template>`) | (?P<name>[A-Za-z_$\u0080-\uffff#][\w$\u0080-\uffff]*) | (?P<number>\d[\w.]*) | (?P<op>=>|\.\.\.|[{}()\[\];,:.?<>=+\-*/%&|^~!@])
  | (?P<other>.) )""", re.X | re.S)  # fmt: skip
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_NOT_METHODS = {
    "if", "for", "while", "switch", "catch", "return", "function", "with", "super", "await", "typeof", "new", "throw", "else", "do", "in",
    "of", "case", "yield", "delete", "void"
}
#: Tokens that a declaration is found by.
_STARTS = {"function", "class", "interface", "type", "=>", "("}
_MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "override", "abstract", "get", "set", "declare", "accessor"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def _template_end(src: str, i: int) -> int:
    """One past the backtick that closes the template at i."""
    i += 1
    while i < len(src):
        c = src[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif src.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(src) and depth:
                if src[i] == "`":
                    i = _template_end(src, i)
                    continue
                if src[i] in "\"'":
                    m = _TOKEN.match(src, i)
                    i = m.end()
                    continue
                depth += (src[i] == "{") - (src[i] == "}")
                i += 1
        else:
            i += 1
    return len(src)


def tokens(src: str) -> list[Token]:
    """Significant tokens of a script."""
    out: list[Token] = []
    i, match = 0, _TOKEN.match
    while m := match(src, i):  # none where only white space is left
        kind = m.lastgroup
        i, end = m.span(kind)
        if kind == "template":
            end = _template_end(src, i)
            out.append(Token("string", src[i:end], i, end))
        elif kind == "op" and src[i] == "/":
            prev = out[-1] if out else None
            value = prev is not None and (prev.kind in ("number", "string") or (prev.kind == "name" and prev.text not in _BEFORE_REGEX) or prev.text in (")", "]", "}"))
            r = None if value else _REGEX.match(src, i)
            if r:
                end = r.end()
            out.append(Token("string" if r else "op", src[i:end], i, end))
        elif kind != "comment":
            out.append(Token(kind, src[i:end], i, end))
        i = end
    return out


def _pairs(toks: list[Token]) -> dict[int, int]:
    """Index of the closing bracket of each opening one."""
    close, stack, out = {"(": ")", "[": "]", "{": "}"}, [], {}
    for i, t in enumerate(toks):
        if t.kind != "op":
            continue
        if t.text in close:
            stack.append(i)
        elif t.text in ")]}":
            while stack and close[toks[stack[-1]].text] != t.text:
                stack.pop()
            if stack:
                out[stack.pop()] = i
    return out


class ScriptScan:
    def __init__(self, src: str, typed: bool):
        self.src, self.typed = src, typed
        self.toks = tokens(src)
        self.pair = _pairs(self.toks)
        self.opens = {b: a for a, b in self.pair.items()}
        self.inside: list[int] = []  # the innermost open brace of each token, or -1
        stack, close = [-1], -1
        for i, t in enumerate(self.toks):
            if i == close:
                stack.pop()
                close = self.pair.get(stack[-1], -1)
            self.inside.append(stack[-1])
            if t.text == "{" and i in self.pair:
                stack.append(i)
                close = self.pair[i]
        self.nodes: list[Node] = []

    def text(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def kind(self, i: int) -> str:
        return self.toks[i].kind if 0 <= i < len(self.toks) else ""

    def past_type(self, i: int, stop: tuple[str, ...]) -> int:
        """First token from i on, outside brackets, that is one of stop."""
        angle = 0
        while i < len(self.toks):
            t = self.text(i)
            if angle == 0 and t in stop:
                return i
            if t in "([{" and self.kind(i) == "op" and i in self.pair:
                i = self.pair[i] + 1
                continue
            if t == "<":
                angle += 1
            elif t == ">" and angle:
                angle -= 1
            elif t in (")", "]", "}") and self.kind(i) == "op":
                return i
            i += 1
        return i

    def generics(self, i: int) -> int:
        """Past `<...>` at i, if there is one."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.toks):
            t = self.text(i)
            depth += (t == "<") - (t == ">")
            if t in ("(", "{", "[") and i in self.pair:
                i = self.pair[i]
            i += 1
            if depth == 0:
                return i
        return i

    def body_after(self, i: int) -> int | None:
        """Index of the `{` of a body after parameters that end before i, past a return type."""
        if self.text(i) == ":":
            j = i + 1
            if self.text(j) == "{" and j in self.pair and self.text(self.pair[j] + 1) == "{":
                return self.pair[j] + 1
            i = self.past_type(j, ("{", ";", "=>", ","))
        return i if self.text(i) == "{" and i in self.pair else None

    def expression_end(self, i: int) -> int:
        """Last token of the expression that starts at i."""
        last = i
        while i < len(self.toks):
            t = self.text(i)
            if self.kind(i) == "op" and t in (";", ",", ")", "]", "}"):
                break
            if i > last and "\n" in self.src[self.toks[last].end : self.toks[i].start] and self.kind(i) in ("name", "string", "number") and self.text(last) not in ("=>", ".", "+", "-", "*", "?", ":", "&", "|", "="):
                break
            last = i
            if self.kind(i) == "op" and t in "([{" and i in self.pair:
                i = last = self.pair[i]
            i += 1
        return last

    def add(self, kind: str, name: str, a: int, b: int) -> None:
        if name:
            self.nodes.append(Node(kind, name, self.toks[a].start, self.toks[b].end))

    def assigned_name(self, i: int) -> str:
        """Name that the value starting at token i is given: a declared variable or (JavaScript) the left side of an assignment."""
        j = i - 1
        if self.text(j) != "=" or self.kind(j) != "op":
            return ""
        k = j - 1
        if self.typed:  # skip a type annotation
            back = k
            while back > 0 and self.text(back) not in ("const", "let", "var", ";", "{", "}", "="):
                back -= 1
            if self.text(back) in ("const", "let", "var") and self.kind(back + 1) == "name":
                if back + 1 == k or self.text(back + 2) == ":":
                    return self.text(back + 1)
                return self.text(k) if self.kind(k) == "name" and self.text(k - 1) == "," else ""
            return ""
        if self.kind(k) == "name" and self.text(k - 1) in ("const", "let", "var", ","):
            return self.text(k)
        left = k
        while left >= 0 and (self.kind(left) == "name" or self.text(left) in (".", "]")):
            if self.text(left) == "]":
                left = self.opens.get(left, left)
            left -= 1
            if self.kind(left + 1) == "name" and self.text(left) != ".":
                break
        return self.src[self.toks[left + 1].start : self.toks[k].end] if left < k else ""

    def scan(self) -> list[Node]:
        n = len(self.toks)
        class_bodies: set[int] = set()
        object_bodies: set[int] = set()
        for i, token in enumerate(self.toks):
            t, kind = token.text, token.kind
            if t not in _STARTS:
                continue
            prev = self.text(i - 1)
            if kind == "name" and prev != ".":
                start = i - 1 if prev == "async" and t == "function" else i
                if t == "function":
                    j = i + 1
                    star = self.text(j) == "*"
                    j += star
                    own = self.text(j) if self.kind(j) == "name" else ""
                    j = self.generics(j + bool(own))
                    if self.text(j) == "(" and j in self.pair:
                        body = self.body_after(self.pair[j] + 1)
                        if body is not None and not (self.typed and star):
                            name = own or ("" if self.typed else self.assigned_name(start))
                            self.add("function", name, start, self.pair[body])
                elif t == "class" and self.text(i + 1) != ":":
                    own = self.text(i + 1) if self.kind(i + 1) == "name" and self.text(i + 1) not in ("extends", "implements") else ""
                    body = i + 1
                    while body < n and not (self.text(body) == "{" and body in self.pair):
                        if self.text(body) == "(" and body in self.pair:
                            body = self.pair[body]
                        body += 1
                    if body < n:
                        class_bodies.add(body)
                        if not (prev == "abstract" and self.typed):
                            self.add("class", own, i, self.pair[body])
                elif self.typed and t == "interface" and self.kind(i + 1) == "name":
                    body = self.past_type(i + 2, ("{",))
                    if body in self.pair:
                        self.add("interface", self.text(i + 1), i, self.pair[body])
                elif self.typed and t == "type" and self.kind(i + 1) == "name":
                    eq = self.generics(i + 2)
                    if self.text(eq) == "=":
                        end = self.past_type(eq + 1, (";",))
                        last = end if self.text(end) == ";" else self.type_end(eq + 1)
                        self.add("type", self.text(i + 1), i, min(last, n - 1))
            if t == "=>" and kind == "op":
                self.arrow(i)
            if t == "(" and i in self.pair:
                self.method(i, class_bodies, object_bodies)
        return sorted(self.nodes, key=lambda x: (x.start, -x.end))

    def type_end(self, i: int) -> int:
        last = i
        while i < len(self.toks):
            if i > last and "\n" in self.src[self.toks[last].end : self.toks[i].start] and self.text(i) not in ("|", "&", "=>", "?", ":") and self.text(last) not in ("|", "&", "=", "=>", "?", ":"):
                return last
            last = i
            if self.text(i) in ("(", "[", "{") and i in self.pair:
                i = last = self.pair[i]
            i += 1
        return last

    def arrow(self, i: int) -> None:
        """An arrow function whose `=>` is token i."""
        j = i - 1
        if self.kind(j) == "name" and self.text(j - 1) != ":" and self.text(j - 1) != ")":
            start = j
        else:
            k = j
            while k >= 0 and self.text(k) != ")":
                if self.text(k) in (";", "{") or (self.text(k) == "=" and self.kind(k) == "op"):
                    return
                k = self.opens.get(k, k) - 1
            if k < 0 or k not in self.opens:
                return
            start = self.opens[k]
            if self.text(start - 1) == ">":
                g, depth = start - 1, 0
                while g >= 0:
                    depth += (self.text(g) == ">") - (self.text(g) == "<")
                    if depth == 0:
                        break
                    g -= 1
                start = max(g, 0)
        if self.text(start - 1) == "async":
            start -= 1
        name = self.assigned_name(start)
        end = self.pair.get(i + 1) if self.text(i + 1) == "{" else self.expression_end(i + 1)
        if end is not None and name:
            self.add("function", name, start, end)

    def method(self, i: int, class_bodies: set[int], object_bodies: set[int]) -> None:
        """A method definition whose parameters open at token i."""
        j = i - 1
        if self.text(j) == ">":
            depth = 0
            while j >= 0:
                depth += (self.text(j) == ">") - (self.text(j) == "<")
                j -= 1
                if depth == 0:
                    break
        name = self.text(j)
        if self.kind(j) == "string":
            pass
        elif self.text(j) == "]" or self.kind(j) != "name" or name in _NOT_METHODS:
            return
        before = self.text(j - 1)
        start = j
        while self.text(start - 1) in _MODIFIERS or self.text(start - 1) == "*":
            start -= 1
        before = self.text(start - 1)
        if before in (".", "function", "new", "=", "=>", "(", "?", ":", "return", "&", "|", "!", "+") or before == "class":
            return
        body = self.body_after(self.pair[i] + 1)
        if body is None:
            return
        inside = self.inside[start]
        if inside < 0:
            return
        if inside in class_bodies or (self.text(inside - 1) in ("=", "(", ",", ":", "return", "[", "?", "=>") and before in ("{", ",")):
            self.add("method", name, start, self.pair[body])


# ---- Ruby ------------------------------------------------------------------------------------

_RUBY_TOKEN = re.compile(r"""
    (?P<doc>^=begin\b.*?^=end\b[^\n]*) | (?P<comment>\#[^\n]*) | (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)
  | (?P<heredoc><<[~-]?(?P<q>['"]?)(?P<tag>[A-Z_][A-Z_0-9]*)(?P=q)) | (?P<percent>%[wWiIqQ]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\}))
  | (?P<symbol>:[A-Za-z_]\w*[?!=]?) | (?P<label>[A-Za-z_]\w*[?!]?:(?!:)) | (?P<name>@{0,2}[A-Za-z_$]\w*[?!]?) | (?P<newline>\n|;) | (?P<space>[ \t\r]+) | (?P<op>.)""", re.X | re.S | re.M)  # fmt: skip
_OPENERS = {"def", "class", "module", "begin", "case", "do"}
_STATEMENT = {"if", "unless", "while", "until", "for"}


def ruby_tokens(src: str) -> list[Token]:
    out, i, pending = [], 0, []
    while i < len(src):
        m = _RUBY_TOKEN.match(src, i)
        kind, end = m.lastgroup, m.end()
        if m["heredoc"]:
            kind = "string"
            pending.append(m["tag"])
        if kind == "op" and m[0] == "/":
            prev = next((t for t in reversed(out)), None)
            if prev is None or prev.kind in ("newline", "op") and prev.text not in (")", "]", "}") or prev.text in ("if", "unless", "when", "and", "or", "not", "return"):
                r = re.compile(r"/(?:\\.|[^/\\\n])*/[a-z]*").match(src, i)
                if r:
                    kind, end = "string", r.end()
        if kind not in ("space", "comment", "doc"):
            out.append(Token("name" if kind == "name" else kind, src[i:end], i, end))
        if m[0] == "\n" and pending:
            for tag in pending:
                stop = re.compile(rf"^[ \t]*{tag}[ \t]*$", re.M).search(src, end)
                end = stop.end() if stop else len(src)
            pending = []
        i = end
    return out


def ruby_nodes(src: str) -> list[Node]:
    """Methods, classes and modules whose first plain name can be read."""
    toks, stack, nodes = ruby_tokens(src), [], []
    first = lambda i: i == 0 or toks[i - 1].kind == "newline" or toks[i - 1].text in (
        "then", "else", "do", "=", "(", "|", "&", "private", "protected", "public", "begin", "ensure"
    )
    loop = False
    for i, t in enumerate(toks):
        if t.kind == "newline":
            loop = False
        if t.kind != "name" or (i and toks[i - 1].text == "."):
            continue
        if t.text in _STATEMENT:
            if first(i):
                stack.append(None)
                loop = t.text in ("while", "until", "for")
        elif t.text == "do" and loop:
            loop = False
        elif t.text in _OPENERS:
            node = None
            if t.text == "def":
                node = _ruby_method(toks, i, src, t)
                if node is not None and node.end >= 0:  # an endless method
                    if node.name:
                        nodes.append(node)
                    continue
            elif t.text in ("class", "module") and i + 1 < len(toks) and toks[i + 1].text != "<":
                plain = toks[i + 1].kind == "name" and not (i + 2 < len(toks) and toks[i + 2].text == ":")
                node = Node(t.text, toks[i + 1].text if plain else "", t.start, -1)
            stack.append(node)
        elif t.text == "end" and stack:
            node = stack.pop()
            if node is not None and node.name:
                node.end = t.end
                nodes.append(node)
    return sorted(nodes, key=lambda x: (x.start, -x.end))


def _ruby_method(toks: list[Token], i: int, src: str, t: Token) -> Node:
    j, name = i + 1, ""
    if j < len(toks) and toks[j].kind == "name":
        if j + 2 < len(toks) and toks[j + 1].text == ".":
            j += 2
        plain = toks[j].kind == "name"
        setter = j + 1 < len(toks) and toks[j + 1].text == "=" and toks[j].end == toks[j + 1].start
        name = toks[j].text if plain and not setter else ""
        k = j + 1
        if k < len(toks) and toks[k].text == "(":
            depth = 0
            while k < len(toks):
                depth += (toks[k].text == "(") - (toks[k].text == ")")
                k += 1
                if depth == 0:
                    break
        if not setter and k < len(toks) and toks[k].text == "=" and toks[k].end < len(src) and src[toks[k].end] in " \t":
            end = k
            while end + 1 < len(toks) and toks[end + 1].kind != "newline":
                end += 1
            return Node("method", name, t.start, toks[end].end)
    return Node("method", name, t.start, -1)


# ---- operator --------------------------------------------------------------------------------


def parse(src: str, language: str, types: tuple[str, ...] | None = None) -> list[dict]:
    """Rows of one source: type, name, content, lines from 1 and columns from 0, in document order."""
    if language not in LANGUAGES:
        raise UnsupportedLanguage(language)
    nodes = ruby_nodes(src) if language == "ruby" else ScriptScan(src, language == "typescript").scan()
    starts = [0, *(m.end() for m in re.finditer("\n", src))]
    out = []
    for n in nodes:
        if types is None or n.type in types:
            line = lambda at: bisect_right(starts, at)
            column = lambda at: at - starts[bisect_right(starts, at) - 1]
            out.append({
                "type": n.type, "name": n.name, "content": src[n.start : n.end], "start_line": line(n.start), "end_line": line(n.end),
                "start_char": column(n.start), "end_char": column(n.end)
            })
    return out


def extract_nodes(files: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of NODE_SCHEMA for files with path, language and content; `error` is set where a file failed."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for path, language, content in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    out += [{"path": path, "language": language, "node_seq": i, **row} for i, row in enumerate(parse(content or "", language, types))]
                except Exception as e:  # a file that fails must not end the job
                    out.append({"path": path, "language": language, "error": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    ship(files.sparkSession)
    return files.select("path", "language", "content").mapInArrow(rows, NODE_SCHEMA)


def nodes_by_file(nodes: DataFrame) -> DataFrame:
    """path, language and the ordered array of nodes, for the chunker. Files are small, so a group is one file's rows."""
    row = F.struct("node_seq", F.struct("type", "name", "content", "start_line", "end_line", "start_char", "end_char").alias("n"))
    grouped = nodes.where("error is null").groupBy("path", "language").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return grouped.select("path", "language", F.transform("r", lambda x: x["n"]).alias("nodes"))


def parse_metadata(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, total_lines, total_chars, the distinct chunk types (sorted) and the error of each file.

    Characters are UTF-16 units, as source positions count them; a file without nodes has no types."""
    text = F.coalesce(F.col("content"), F.lit(""))
    size = files.select(
        "path", F.size(F.split(text, "\n")).alias("total_lines"),
        F.floor(F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int").alias("total_chars")
    )
    types = nodes.groupBy("path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.max("error").alias("error"))
    return size.join(types, "path", "left").select(
        "path", "total_lines", "total_chars", F.coalesce("types", F.array().cast("array<string>")).alias("chunk_types"), "error"
    )
