"""Secret scans: fixed patterns, and assignments whose target's name says that the literal is sensitive.

A lexer with states (code, strings of all kinds with escapes, comments, urls) reads source and configuration syntax as pairs of
a name and an expression of literals and other names: ``name = "x"``, ``name: 'x'``, ``"name" => x``, ``name := x``, ``<name>x</name>``, chained and
annotated assignments, nested keys in brackets or by indentation, lists, pieces joined by operators or by standing side by side,
interpolated names, calls whose first two arguments are a name and a literal, and the directives ``#define``, ``ENV`` and ``setenv``.  Strings and
comments are read again by themselves, however deep, the former with one level of escapes undone.  Constants are propagated to a fixpoint, wherever they are defined: a literal weighs as much as the most sensitive
name that it reaches.  A literal is reported where that and the look of the literal together reach the threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_type, lean, only, with_id

#: Fixed by the contract: kinds in their order, patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 8
ACCESS, ACCESS_LEAST = re.compile(r"AKIA[A-Z0-9]+"), 16
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "named")

#: Tokens of code.  No alternative tries a place twice, so lexing is linear.
TOKEN = re.compile(
    r"""(?P<space>[\x20\t\r\f\v\\]++)|(?P<line>\n)|(?P<comment>\#++|//++|/\*++|<!--|--(?=\x20))|(?P<name>[A-Za-z_$][A-Za-z0-9_$.-]*+)|(?P<number>(?:[0-9.]|-(?!>))++)"""
    r"""|(?P<quote>\"{3}|'{3}|["'`])|(?P<assign>:=|=>|->|={1,2}|:|\?=)|(?P<open>[{(\[])|(?P<close>[})\]])|(?P<join>[+&|]++=?)|(?P<other>.)""",
    re.DOTALL,
)
#: The inside of a string, up to its closing quote or, for quotes of one line, the line's end.
INSIDE = {
    '"': re.compile(r'(?:[^"\\\n]++|\\.)*+', re.DOTALL), "'": re.compile(r"(?:[^'\\\n]++|\\.)*+", re.DOTALL), "`": re.compile(r"(?:[^`\\]++|\\.)*+", re.DOTALL),
    '"""': re.compile(r'(?:[^"\\]++|\\.|"(?!""))*+', re.DOTALL), "'''": re.compile(r"(?:[^'\\]++|\\.|'(?!''))*+", re.DOTALL),
}
PREFIXES = frozenset({"f", "r", "b", "u", "rb", "br", "fr", "rf"})
COMMENT_ENDS = {"/*": "*/", "<!--": "-->"}
BARE = re.compile(r"""[^\s"',;(){}\[\]<>]*+""")
#: What an unquoted value inside a url may hold: up to the next parameter.
BARE_IN_URL = re.compile(r"""[^\s"',;(){}\[\]<>&#]*+""")
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*+")
#: A name inside a text: ``{name}``, ``${name}``, ``$name``, ``%(name)s``.
INSERTED = re.compile(r"(?:\$\{++|(?<!\{)\{++)\s*+([A-Za-z_][A-Za-z0-9_.]*+)[^{}]*+\}++|\$([A-Za-z_][A-Za-z0-9_]*+)|%\(([A-Za-z_][A-Za-z0-9_]*+)\)s")
SECTION = re.compile(r"[\x20\t]*+\[([A-Za-z_][A-Za-z0-9_.:\x20-]*+)\][\x20\t\r]*+(?=\n|\Z)")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_:.-]*+)(?:\s[^<>]*+)?>\s*+([^<>\s](?:[^<>]*[^<>\s])?+)\s*+</")
SPACES, LEAD, LAST_WORD = re.compile(r"[\x20\t]*+"), re.compile(r"(?:[\x20\t\r\n]|-\x20)*+"), re.compile(r"[A-Za-z]++$")
QUOTES = ("'", '"')
#: ``#define NAME value`` and the like: a name and a value without a sign between them.
DIRECTIVE = re.compile(r"(?:\#[\x20\t]*+define|ENV|setenv)[\x20\t]++([A-Za-z_][A-Za-z0-9_.-]*+)[\x20\t]++(?=[^\s=:])")
#: A region without any of these has no pair.
SIGN = re.compile(r"""[=:]|->|["'`]\s*+,|(?:define|ENV|setenv)[\x20\t]|</""")
#: In a region with escapes these may stand for a sign.
SIGN_OR_ESCAPE = re.compile(SIGN.pattern + r"""|\\["'`ux]""")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(.))", re.DOTALL)
#: What escapes stand for, where it isn't the character itself.
ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\n": " "}
#: How sensitive a part of a name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 0.9, "token": 0.8, "apikey": 0.9, "credential": 0.8, "credentials": 0.8,
    "auth": 0.5, "private": 0.4, "access": 0.3, "api": 0.3, "signing": 0.4, "encryption": 0.5, "key": 0.4, "salt": 0.4, "dsn": 0.5, "jwt": 0.8, "bearer": 0.8,
}
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A text without any of these has no sensitive name.
HINT = re.compile("|".join(sorted(SENSITIVE, key=len, reverse=True)), re.IGNORECASE)
PLAIN = frozenset({"true", "false", "null", "none", "nil", "undefined", "required", "optional", "string", "changeme", "example", "redacted"})


def sensitivity(name: str) -> float:
    """0 to 1, from the parts of a name: the strongest of them and half of the others."""
    parts = [p.lower() for p in PARTS.findall(name)]
    scores = sorted((SENSITIVE.get(p) or SENSITIVE.get(p.removesuffix("s"), 0.0) for p in parts), reverse=True)
    return min(1.0, scores[0] + 0.5 * sum(scores[1:])) if scores else 0.0


def look(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret, by its length, its kinds of characters and their entropy."""
    return _look(len(literal), Counter(literal), literal[:20])


def _look(n: int, counts: Counter, head: str) -> float:
    """The same from a literal's length, the counts of its characters and its first 20 characters."""
    if n < 6 or n <= 20 and head.lower() in PLAIN or len(counts) < 4 or n < 20 and " " in head.strip():
        return 0.0
    entropy = -math.fsum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.25 * (n >= 8) + 0.15 * (n >= 16) + 0.15 * kinds + 0.1 * max(0.0, entropy - 2))


def base_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, value's start, value's end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), "assign", m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), "hex", m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Layer(NamedTuple):
    """A text that is read, and how its places are found in the text around it."""

    text: str
    around: "Layer | None" = None
    at: int = 0
    escaped: array = array("q")
    shift: array = array("q")

    def inside(self, a: int, b: int) -> "Layer":
        """What stands from a to b, with one level of escapes undone.  Each escape becomes one character."""
        escaped, shift, parts, done = array("q"), array("q", [0]), [], a
        for m in ESCAPE.finditer(self.text, a, b):
            code = m[1] or m[2]
            parts += self.text[done : m.start()], chr(int(code, 16)) if code else ESCAPED.get(m[3], m[3])
            escaped.append(m.start() - a - shift[-1])
            shift.append(shift[-1] + m.end() - m.start() - 1)
            done = m.end()
        parts.append(self.text[done:b])
        return Layer("".join(parts), self, a, escaped, shift)

    def place(self, i: int) -> int:
        """Where the border before character ``i`` stands in the outermost text."""
        layer = self
        while layer.around is not None:
            i += layer.at + layer.shift[bisect_left(layer.escaped, i)]
            layer = layer.around
        return i


class Region(NamedTuple):
    """Part of a layer that is read by itself.  ``sign`` is its first sign; the marks in ``absent`` do not occur in it."""

    layer: Layer
    start: int
    stop: int
    sign: int = -1
    absent: frozenset[str] = frozenset()
    escapes: bool = False


class Lexer:
    """Tokens (kind, start, end) of one region, with a look ahead.  ``inner`` collects the strings and comments that are to be read by themselves.

    Kinds: name, string (the place of its inside), assign, join, open, close, line (end is where the next line's text begins), section, other.
    A region's own lexer only skips what its inner regions hold, so each character is part of one region's tokens.
    """

    def __init__(self, region: Region):
        self.layer, self.at, self.stop, self.sign, self.absent = region.layer, region.start, region.stop, region.sign, region.absent
        self.text = text = region.layer.text
        self.inner: list[Region] = []
        self.ahead: deque[tuple[str, int, int]] = deque()
        self.waiting: deque[tuple[str, int, int]] = deque()
        self.url_end = start = region.start
        if x := SECTION.match(text, start, self.stop):
            self.waiting.append(("section", *x.span(1)))
            self.at = x.end()
        else:
            self._directive(LEAD.match(text, start, self.stop).end())

    def _directive(self, at: int) -> None:
        """Give the name and the value of a directive at this place as an assignment."""
        if x := DIRECTIVE.match(self.text, at, self.stop):
            self.waiting += ("name", *x.span(1)), ("assign", x.end(1), x.end(1))
            self.at = x.end()

    def peek(self, k: int = 0) -> tuple[str, int, int]:
        while len(self.ahead) <= k:
            self.ahead.append(self._read())
        return self.ahead[k]

    def next(self) -> tuple[str, int, int]:
        self.peek()
        return self.ahead.popleft()

    def _read(self) -> tuple[str, int, int]:
        text, stop = self.text, self.stop
        if self.waiting:
            return self.waiting.popleft()
        while self.at < stop:
            start = self.at
            m = TOKEN.match(text, start, stop)
            kind, self.at = m.lastgroup, m.end()
            if kind == "space" or kind == "number":
                continue
            if kind == "line":
                if x := SECTION.match(text, self.at, stop):
                    self.at = x.end()
                    return ("section", *x.span(1))
                self.at = end = LEAD.match(text, self.at, stop).end()
                self._directive(end)
                return ("line", start, end)
            if kind == "quote":
                before, raw = text[start - 1] if start else " ", False
                if before.isalnum() or before == "_":
                    word = LAST_WORD.search(text, max(0, start - 4), start)
                    if not word or word[0].lower() not in PREFIXES:
                        return ("other", start, self.at)  # an apostrophe
                    raw = "r" in word[0].lower()
                end = INSIDE[m[0]].match(text, self.at, stop).end()
                inside = self.at, end
                self.at = min(stop, end + len(m[0]))
                self._later(*inside, escapes=not raw and text.find("\\", *inside) >= 0)
                return ("string", *inside)
            if kind == "comment":
                if start < self.url_end or m[0][0] == "#" and start and text[start - 1] in "=:":
                    return ("other", start, self.at)
                mark = COMMENT_ENDS.get(m[0], "\n")
                end = -1 if mark in self.absent else text.find(mark, self.at, stop)
                end = stop if end < 0 else end
                self._later(self.at, end, mark)
                self.at = end if mark == "\n" else min(stop, end + len(mark))
                continue
            if m[0] == ":" and text.startswith("//", self.at):  # a url's scheme is no name
                if start >= self.url_end:
                    self.url_end = BARE.match(text, start, stop).end()
                self.at = min(stop, self.at + 2)
                return ("other", start, self.at)
            if kind == "name" and m[0].lower() in PREFIXES and text[self.at : self.at + 1] in QUOTES:
                continue
            return (kind, start, self.at)
        return ("end", stop, stop)

    def _later(self, a: int, b: int, *absent: str, escapes: bool = False) -> None:
        """Keep a region for later, if it has a sign."""
        if self.sign < a:
            found = SIGN.search(self.text, a, self.stop)
            self.sign = found.start() if found else self.stop
        if escapes and SIGN_OR_ESCAPE.search(self.text, a, b):
            self.inner.append(Region(self.layer, a, b, escapes=True))
        elif self.sign < b:
            self.inner.append(Region(self.layer, a, b, self.sign, self.absent.union(absent)))


class Path(NamedTuple):
    """The keys above a place, as a node of their tree, and the sensitivity of the most sensitive one."""

    node: int = 0
    weight: float = 0.0


class Pairs:
    """The name-expression pairs of a text.  An expression is a list of pieces: (start, end, None) is a literal, (start, end, name) a name there."""

    def __init__(self, text: str):
        self.expressions: list[list[tuple[int, int, str | None]]] = []
        self.of_name: defaultdict[str, list[int]] = defaultdict(list)
        self.nodes: dict[tuple[int, str], int] = {}  # the tree of all keys: node above and key
        self.of_node: defaultdict[int, list[int]] = defaultdict(list)
        self.weights: list[tuple[float, int]] = []
        todo = [self._whole(Layer(text))]
        while todo:
            region = todo.pop()
            todo += self._read(self._whole(region.layer.inside(region.start, region.stop)) if region.escapes else region)

    def _whole(self, layer: Layer) -> Region:
        """The region of a new layer, whose elements are added at once."""
        if "</" in layer.text:
            for m in ELEMENT.finditer(layer.text):
                self._add(layer, [m[1]], Path(), [(*m.span(2), None)])
        return Region(layer, 0, len(layer.text))

    def _below(self, above: Path, keys: list[str]) -> Path:
        node = above.node
        for key in keys:
            node = self.nodes.setdefault((node, key), len(self.nodes) + 1)
        return Path(node, max([above.weight, *map(sensitivity, keys)]))

    def _add(self, layer: Layer, targets: list[str], above: Path, pieces: list[tuple[int, int, str | None]]) -> None:
        k = len(self.expressions)
        self.expressions.append([(layer.place(a), layer.place(b), name) for a, b, name in pieces])
        own = 0.0
        for name in targets:
            for known in {name, name.rpartition(".")[2]}:
                self.of_name[known].append(k)
            if above.node:
                self.of_node[self._below(above, name.split(".")).node].append(k)
            own = max(own, sensitivity(name))
        weight = max(own, 0.7 * above.weight)
        if weight:
            self.weights.append((weight, k))

    def defined(self, name: str) -> list[int]:
        """Expressions of a name: those written so or with these keys above them, else those whose last key is the same."""
        *above, last = name.split(".")
        found = self.of_name.get(name, [])
        if above:
            node = 0
            for key in (*above, last):
                node = self.nodes.get((node, key), -1)
            found = found + self.of_node.get(node, [])
        return found or self.of_name.get(last, [])

    @staticmethod
    def _string(text: str, a: int, b: int) -> list[tuple[int, int, str | None]]:
        """A string's pieces: the names inserted into it, and the whole of it unless it is made of them alone."""
        if a == b:
            return []
        found = list(INSERTED.finditer(text, a, b))
        names = [(a, b, x[1] or x[2] or x[3]) for x in found]
        return names + [(a, b, None)] * (sum(x.end() - x.start() for x in found) < b - a)

    def _read(self, region: Region) -> list[Region]:
        """Read one region; gives the regions inside it that are to be read by themselves."""
        layer, a, b = region[:3]
        text, lexer = layer.text, Lexer(region)
        section = Path()
        indented: list[tuple[int, Path]] = []  # path of what stands further in, below a key without a value
        brackets: list[tuple[Path, list[str]]] = []  # path inside a bracket, targets of a list

        def above() -> Path:
            return brackets[-1][0] if brackets else indented[-1][1] if indented else section

        def joined(pieces: list[tuple[int, int, str | None]], kind: str, within: int) -> None:
            """Add what is joined to an expression, by operators or, for strings, by standing side by side."""
            while pieces and (kind == "string" or pieces[0][2]):
                step = 1 if lexer.peek()[0] == "line" else 0
                what = lexer.peek(step)[0]
                if what == "string" and lexer.peek(step + 1)[0] != "assign" and (not step or within) and kind == "string":
                    step += 1
                elif what == "join":
                    step += 1
                    if lexer.peek(step)[0] == "line":
                        step += 1
                    if lexer.peek(step)[0] not in ("string", "name"):
                        return
                    step += 1
                else:
                    return
                for _ in range(step):
                    more, start, end = lexer.next()
                if more == "string":
                    pieces += self._string(text, start, end)
                    kind = "string"
                else:
                    pieces.append((start, start, text[start:end]))  # a name in an expression is no literal

        def call(targets: list[str]) -> None:
            """The pair of a call's first two arguments, if they are a name in quotes and a string; ``targets`` take what the call gives."""
            places = []
            k = 0
            for wanted in ("string", "other", "string"):
                k += lexer.peek(k)[0] == "line"
                kind, start, end = lexer.peek(k)
                if kind != wanted or kind == "other" and text[start] != ",":
                    return
                places.append((start, end))
                k += 1
            if NAME.fullmatch(text, *places[0]) and lexer.peek(k)[0] != "assign":
                for _ in range(k):
                    lexer.next()
                pieces = self._string(text, *places[2])
                joined(pieces, "string", 1)
                if pieces:
                    self._add(layer, [text[slice(*places[0])], *targets], above(), pieces)

        indent, first, bare_end, url_value_end, last = 0, True, a, a, ("", a, a)
        called: tuple[int, list[str]] = (-1, [])  # a bracket whose call gives the value of these names
        while True:
            kind, start, end = lexer.next()
            if kind == "end":
                return lexer.inner
            if kind == "line":
                indent, first = end - 1 - text.rfind("\n", start, end), True
                continue
            if kind == "section":
                section, indented = self._below(Path(), text[start:end].split(".")), []
                continue
            leads, first = first, False
            if kind == "open":
                brackets.append((above(), []))
                if text[start] == "(" and start and (text[start - 1].isalnum() or text[start - 1] in "_$"):
                    call(called[1] if called[0] == start else [])
            elif kind == "close":
                if brackets:
                    brackets.pop()
            if kind not in ("name", "string"):
                continue
            if lexer.peek()[0] != "assign" or kind == "string" and not NAME.search(text, start, end):
                if kind == "string" and brackets and brackets[-1][1]:  # an entry of a list is a value by itself
                    self._add(layer, brackets[-1][1], above(), self._string(text, start, end))
                continue
            if leads:
                while indented and indented[-1][0] >= indent:
                    indented.pop()
            targets, sign = [text[start:end]], lexer.next()
            while lexer.peek()[0] == "name" and lexer.peek(1)[0] == "assign":
                _, start, end = lexer.peek(1)
                if not (text[start - 1].isspace() or text[end : end + 1].isspace() or text[end : end + 1] in QUOTES):
                    break  # a sign within a value
                targets.append(text[slice(*lexer.next()[1:])])
                sign = lexer.next()
            within = 0
            while lexer.peek()[0] == "open" and text[lexer.peek()[1]] == "(":
                lexer.next()
                brackets.append((above(), []))
                within += 1
                if lexer.peek()[0] == "line":
                    lexer.next()
            kind, start, end = lexer.peek()
            if kind == "line":
                if lexer.peek(1)[0] == "string" and lexer.peek(2)[0] != "assign":
                    lexer.next()
                    kind, start, end = lexer.peek()
                else:
                    if text[sign[1]] == ":":
                        indented.append((indent, self._below(above(), [targets[-1]])))
                    continue
            if kind == "open":
                lexer.next()
                brackets.append((self._below(above(), [targets[-1]]), targets if text[start] == "[" else []))
                continue
            pieces: list[tuple[int, int, str | None]] = []
            start = SPACES.match(text, sign[2], b).end() if kind not in ("string", "line") and not within else start
            if kind == "string":
                lexer.next()
                pieces += self._string(text, start, end)
            elif start < lexer.url_end:
                if start >= url_value_end:
                    url_value_end = BARE_IN_URL.match(text, start, b).end()
                pieces += [(start, url_value_end, None)] * (start < url_value_end)
            else:
                if start >= bare_end:
                    bare_end = BARE.match(text, start, b).end()
                whole, inserted = NAME.match(text, start, bare_end), INSERTED.match(text, start, b)
                if inserted and text[inserted.end() : inserted.end() + 1].strip(" ,;)\r\n"):
                    inserted = None  # more than a name
                elif inserted:
                    bare_end = inserted.end()
                if inserted:
                    pieces.append((start, bare_end, inserted[1] or inserted[2] or inserted[3]))
                elif whole and whole.end() == bare_end:
                    if text[bare_end : bare_end + 1] not in ("(", "["):  # what a call or an index gives isn't in the text
                        pieces.append((start, bare_end, whole[0]))
                    elif text[bare_end] == "(":
                        called = bare_end, targets
                elif start < bare_end:
                    pieces.append((start, bare_end, None))
                if inserted or whole and whole.end() == bare_end:
                    while lexer.peek()[0] != "end" and lexer.peek()[1] < bare_end:
                        lexer.next()
            joined(pieces, kind, within)
            if pieces:
                if targets[0].lower() == "value" and last[0] in ("name", "key") and NAME.fullmatch(text, *last[1:]):
                    targets.append(text[slice(*last[1:])])  # name: X, value: Y
                self._add(layer, targets, above(), pieces)
                last = (targets[0].lower(), *pieces[0][:2])

    def literals(self) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """(weight, spans of an expression's literals), each expression once, by the most sensitive name that it reaches."""
        done, names = bytearray(len(self.expressions)), set()
        for weight, k in sorted(self.weights, key=lambda x: -x[0]):
            todo = [k]
            while todo:
                k = todo.pop()
                if done[k]:
                    continue
                done[k] = 1
                spans = []
                for a, b, name in self.expressions[k]:
                    found = self.defined(name) if name else None
                    if found and name:
                        if name not in names:
                            names.add(name)
                            todo += found
                    elif a < b:  # a name that isn't defined here may be a literal without quotes
                        spans.append((a, b))
                if spans:
                    yield weight, list(dict.fromkeys(spans))


def named_spans(text: str, threshold: float = 0.9) -> list[tuple[int, str, int, int, int]]:
    """Literals that reach a sensitive name, directly or through other names.  The pieces of a joined literal are judged together."""
    if not SIGN.search(text) and not SIGN_OR_ESCAPE.search(text) or not HINT.search(text):
        return []
    weights: dict[tuple[int, int], float] = {}
    out = []
    for weight, spans in Pairs(text).literals():
        if len(spans) == 1:
            weights[spans[0]] = max(weights.get(spans[0], 0.0), weight)
        elif weight * 0.6 + look("".join(text[a:b] for a, b in spans)) * 0.6 >= threshold:
            out += [(a, "named", b, a, b) for a, b in spans]
    starts = defaultdict(list)
    for a, b in weights:
        starts[b].append(a)
    for b, own in starts.items():
        # Spans with one end hold each other: their characters are counted once, from the end on.
        counts, done = Counter(), b
        for a in sorted(own, reverse=True):
            counts.update(text[a:done])
            done = a
            if weights[a, b] * 0.6 + _look(b - a, counts, text[a : min(b, a + 20)]) * 0.6 >= threshold:
                out.append((a, "named", b, a, b))
    return sorted(set(out))


def spans_of(text: str | None) -> tuple[list, list]:
    """(base spans, all spans), each by start, then kind.  A named literal adds nothing only where one base value covers it entirely."""
    if not text:
        return [], []
    order = lambda x: (x[0], KINDS.index(x[1]), x[2])
    base = sorted(base_spans(text), key=order)
    values = sorted((b[3], b[4]) for b in base)
    furthest = [0, *accumulate((b for _, b in values), max)]
    more = [x for x in named_spans(text) if furthest[bisect_right(values, x[3], key=itemgetter(0))] < x[4]]
    return base, sorted(base + more, key=order)


def shown(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _, _ in spans)


def redacted(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """``text`` with each span's value, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for a, b in sorted((x[3], x[4]) for x in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans' list), spans (all of them) and n_named.

    Places are code points, ends exclusive.  Null and empty texts have no spans.  Rows with equal or null ids are scanned each for themselves; an
    empty table gives no rows.  Other columns are not read.  No shuffle; memory is that of a batch of texts.
    """
    bound_batches(docs.sparkSession)

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = spans_of(text)
                n = Counter(x[1] for x in spans)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), n["named"]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"])

    rows = only(docs, doc_id=id_col, text=text_col)
    return with_id(rows).select("doc_id", "text").mapInArrow(scan, SCHEMA.format(id_type(rows, "doc_id").simpleString()))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs``, all columns and rows, with secrets in the text replaced by ``mark``; texts without any stay as they are.

    Null and empty texts stay null and empty, repeated rows are each cleaned, an empty table gives no rows, other columns stay as they are, whatever their names.
    ``n_chars``, if there is such a column, then counts the new text's characters; null texts keep theirs.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    @lean
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [redacted(t, s, mark) if t and (s := spans_of(t)[1]) else t for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(clean, docs.schema)
    if "n_chars" in docs.columns:
        n = F.coalesce(F.length(text_col).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        out = out.withColumn("n_chars", n)
    return out
