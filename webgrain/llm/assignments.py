"""A lexer of assignments in source code and configuration: which names hold which literals, through constants.

Texts are cut into tokens (strings with escapes, triple-quoted strings, names, operators, flags, tags, lines with their
indents). At each place that binds a name (an operator, a subscript, a typed declaration, a call with a name and a literal,
a preprocessor or environment directive, a command-line flag, an XML element, nested blocks, a setter, a comparison with a
literal, a tuple of targets, the password of a URL) a site is recorded: the name with the names around it, and the parts of
its value: literals, and references to other names. Conditional values and fallbacks are a site for each alternative. Contents
of strings are lexed as well, escapes removed. `resolve` links references to sites, earlier or later, and folds values.

Memory is a few machine words a token; the time is linear in the text.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

LONG, STRING, WORD, NUMBER, ESCAPE, OPERATOR, TAG, FLAG, LINE, SIGN = range(10)
TOKEN = re.compile(
    r"""
    (\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?''')
  | ("(?:\\.|[^"\\\n])*"|(?:(?<!\w)|(?<=\b[bBrRfFuUL]))'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\\n])*`)
  | ([^\W\d][\w$]*(?:[.-][^\W\d][\w$]*)*)
  | (\d\w*)
  | (\\.)
  | (:=|=>|->|\+=|\?\?=|\|\|=|\?=|[=!<>]=+|=|::|:)
  | (</?[^\W\d][\w:.-]*)
  | ((?<![\w-])--[^\W\d][\w-]*)
  | ((?:\r?\n[ \t]*)+(?:-[ \t]+)*)
  | ([^\s\w])
    """,
    re.X | re.S,
)
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
#: A piece of a bare value that an outer name has taken whole.
PIECE = re.compile(r"[^\s\"'`,;(){}\[\]<>:=]+=*")
UNESCAPE = re.compile(r"\\(.)|[^\\]+|\\\Z", re.S)
#: A string that is nothing but references.
INTERPOLATED = re.compile(r"(?:[$#]?\{\{?\s*[^\W\d][\w.]*\s*\}?\}|\$[^\W\d]\w*|%[^\W\d]\w*%)+\Z")
WHITE = {"n": "\n", "r": "\r", "t": "\t"}
INNER_NAME = re.compile(r"[^\W\d][\w.]*")
#: Ends of the lines of a literal: a line feed, or one that is written as an escape.
LINE_END = re.compile(r"\n|\\n|\Z")
INDENT = re.compile(r"[ \t]*(?:-[ \t]+)*")
KEY = re.compile(r"[\w.$/@:-]+\Z")
SECTION = re.compile(r"(?:\A|\n)[ \t]*\[([^\[\]\n]+)\][ \t]*(?=\n|\Z)")

BINDS = {"=", ":=", "=>", ":", "+=", "?=", "??=", "||="}
COMPARES = {"==", "===", "!=", "!=="}
JOINS = {"+", ".", "&", "~"}
#: Calls that look a name up, and such that put their arguments together.
LOOKUPS = {"getenv", "lookupenv", "env", "get", "fetch", "lookup", "getproperty", "getstring", "getsecret", "get_secret"}
FOLDS = {"sprintf", "format", "concat", "join"}
EQUALS = {"equals", "equalsIgnoreCase", "contentEquals"}
#: Words that may stand before a tuple of targets.
DECLARES = {"let", "var", "const", "local", "my", "auto", "val"}
SETTER = re.compile(r"(?:set|with|use|update)(?:_|(?=[A-Z]))(\w+)\Z")
#: Places of a template that arguments fill.
PLACE = re.compile(r"%\(\w+\)[a-z]|%[-+ 0#]*\d*[a-zA-Z]|\{[^{}]*\}")
#: The password of a URL, beside its user.
CREDENTIAL = re.compile(r"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@(?=[\w\[])")
PREFIXES = {"b", "r", "f", "u", "rb", "br", "fr", "rf", "L", "B", "R", "F", "U"}
DIRECTIVES = {"setenv", "SetEnv", "ENV", "ARG"}
#: Words of declared types, which may stand between a name and its operator.
TYPES = {"string", "str", "char", "text", "varchar", "bytes", "byte"}
#: Names that label the value beside them.
LABELS, VALUES = {"name", "key", "id", "variable"}, {"value", "val", "default", "content"}
SCHEMES = {"Bearer", "Basic", "Token", "Digest"}
ATTRIBUTE = re.compile(r"([^\W\d][\w:.-]*)\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)')")


#: Weights of the parts of names: what a name says about its value.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5,
    "mnemonic": 3.0, "private": 1.5, "auth": 1.5, "authorization": 2.0, "bearer": 2.0, "access": 1.0, "api": 1.0, "key": 1.5, "signature": 1.5,
    "signing": 1.0, "session": 1.0, "cookie": 1.0, "salt": 1.5, "encryption": 1.0, "public": -2.5, "example": -1.5, "name": -1.0,
    "path": -1.5, "url": -1.5, "file": -1.5, "length": -3.0, "count": -3.0, "type": -2.0, "hint": -2.0, "id": -0.5,
}
#: Words that run together with those without saying anything.
JOINED = {"my", "db", "user", "client", "app", "admin", "root", "aws", "master", "service", "server"}
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def part_weight(part: str) -> float:
    """Weight of one part of a name; a part that is known words run together weighs what they do."""
    if part in NAME_WEIGHTS:
        return NAME_WEIGHTS[part]
    if part[-1:] == "s" and part[:-1] in NAME_WEIGHTS:
        return NAME_WEIGHTS[part[:-1]]
    known = NAME_WEIGHTS.keys() | JOINED
    best: list[float | None] = [0.0] + [None] * len(part)  # of each beginning that is known words
    for b in range(1, len(part) + 1):
        for word in known:
            a = b - len(word)
            if a >= 0 and best[a] is not None and part.startswith(word, a):
                best[b] = max(best[b] or 0.0, best[a] + NAME_WEIGHTS.get(word, 0.0))
    return best[-1] or 0.0


@lru_cache(1 << 14)
def _weight(name: str) -> float:
    return sum(part_weight(p) for p in {p.lower() for p in NAME_PART.findall(name)})


def name_weight(name: str) -> float:
    """Sum of the weights of a name's parts, camel case and separators split; each part once."""
    return _weight(name) if len(name) < 200 else _weight.__wrapped__(name)


def heavier(a: str, b: str) -> str:
    return a if name_weight(a) >= name_weight(b) else b


@dataclass
class Part:
    """A literal (start, end, text), or a reference to a name; a bare name is a literal if nothing binds it."""

    start: int
    end: int
    text: str
    name: str | None = None
    bare: bool = False


@dataclass
class Site:
    name: str
    around: tuple[str, ...]
    parts: list[Part]
    links: list[int] = field(default_factory=list)
    choice: bool = False  # its parts are references to alternatives
    prose: bool = False  # the name stands in a run of words


class Source:
    """A text, or the content of a string in one, with the places of its characters in the outer text."""

    def __init__(self, text: str, offset: int = 0, table: array | None = None):
        self.text, self.offset, self.table = text, offset, table
        self.kind, self.start, self.end = bytearray(), array("q"), array("q")
        for m in TOKEN.finditer(text):
            self.kind.append(m.lastindex - 1)
            self.start.append(m.start())
            self.end.append(m.end())
        self.n = len(self.kind)

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.table is not None:
            return self.table[a], self.table[b - 1] + 1
        return self.offset + a, self.offset + b

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]] if 0 <= i < self.n else ""

    def is_kind(self, i: int, *kinds: int) -> bool:
        return 0 <= i < self.n and self.kind[i] in kinds

    def inside(self, i: int) -> tuple[int, int]:
        """First and end of a string token's content."""
        quote = 3 if self.kind[i] == LONG else 1
        return self.start[i] + quote, self.end[i] - quote

    def content(self, i: int) -> str:
        a, b = self.inside(i)
        return self.text[a:b]

    def inner(self, i: int) -> Source:
        """The content of a string token as a source of its own, escapes removed."""
        a, b = self.inside(i)
        if "\\" not in (text := self.text[a:b]):
            return Source(text, self.offset + a, self.table[a:b] if self.table is not None else None)
        out, table = [], array("q")
        for m in UNESCAPE.finditer(text):
            lo = m.start(1) if m[1] is not None else m.start()
            piece = text[lo : m.end()]
            out.append(WHITE.get(piece, piece) if m[1] is not None else piece)
            table.extend(self.span(a + k, a + k + 1)[0] for k in range(lo, m.end()))
        return Source("".join(out), 0, table)


class Parser:
    """Sites of one source; strings whose content may bind names are put on `todo`."""

    def __init__(self, source: Source, todo: list[Source]):
        self.s, self.sites = source, []
        self.brackets: list[str] = []  # the name that each open bracket is the value of, or ""
        self.blocks: list[tuple[int, str]] = []  # (indent, name) of open blocks of lines
        self.indent = INDENT.match(source.text).end()
        self.pending, self.label, self.here = "", ("", 0, 0), 0
        self.tag_end = self.taken = 0  # ends of the last tag and of the last bare value
        self.end_of_bare = 0
        self.chain = 0  # the token after the last chain of alternatives
        self.sections = [(m.start(), m[1].strip()) for m in SECTION.finditer(source.text)]
        for i in range(source.n):
            kind = source.kind[i]
            if kind in (STRING, LONG):
                if any(c in source.content(i) for c in "=:<"):
                    todo.append(source.inner(i))
                if kind == STRING and source.is_kind(i - 1, WORD) and source.text[source.end[i - 1] : source.start[i]] == " ":
                    self.record(source.word(i - 1), i)  # `password "..."`
            elif kind == LINE:
                line = source.word(i)
                self.indent = len(line) - 1 - line.rfind("\n")
                while self.blocks and self.blocks[-1][0] >= self.indent:
                    self.blocks.pop()
            elif kind == SIGN:
                self.sign(i)
            elif kind == OPERATOR:
                if source.word(i) in BINDS:
                    self.operator(i)
                elif source.word(i) in COMPARES:
                    self.comparison(i)
            elif kind == TAG:
                self.tag(i)
            elif kind == FLAG:
                if not source.is_kind(i + 1, OPERATOR, FLAG, LINE):
                    self.record(source.word(i)[2:], i + 1)
            elif kind == WORD and source.is_kind(i + 1, WORD) and not source.is_kind(i + 2, OPERATOR, LINE):
                word = source.word(i)
                if word in DIRECTIVES or (word == "define" and source.word(i - 1) == "#"):
                    self.record(source.word(i + 1), i + 2)
            elif kind == WORD and source.text.startswith("(", source.end[i]):
                self.call(i)

    # --- what stands around a site -------------------------------------------------------------------------------------

    def around(self) -> tuple[str, ...]:
        """Of the names of open brackets, and of open blocks, the one that weighs most; and the section's name."""
        names = [x for x in (self.brackets[-1:], [b for _, b in self.blocks[-1:]]) for x in x]
        if self.sections and (k := bisect_left(self.sections, (self.here, ""))):
            names.append(self.sections[k - 1][1])
        return tuple(n for n in names if n)

    def sign(self, i: int) -> None:
        s, c = self.s, self.s.word(i)
        if c in "{[(":
            outer = self.brackets[-1] if self.brackets else ""
            self.brackets.append(heavier(self.pending, outer))
            self.pending = ""
        elif c in "}])":
            if self.brackets:
                self.brackets.pop()
        elif c == "," and s.is_kind(i - 1, STRING) and s.word(i - 2) in ("(", "{") and KEY.match(s.content(i - 1)):
            self.record(s.content(i - 1), i + 1)

    def call(self, i: int) -> None:
        """A setter binds what it is named after to its argument; a method that compares, its object."""
        s = self.s
        owner, _, method = s.word(i).rpartition(".")
        if owner and method in EQUALS and s.is_kind(i + 2, STRING):
            self.compared(owner, i + 2)
        elif m := SETTER.match(method):
            if s.is_kind(i + 2, STRING, LONG):
                self.record(m[1], i + 2)
            elif s.is_kind(i + 2, WORD) and s.word(i + 3) in (")", ","):
                self.bind(m[1], [self.reference(i + 2)])

    def comparison(self, i: int) -> None:
        s = self.s
        if s.is_kind(i + 1, STRING):
            for name in self.targets(i)[:1]:
                self.compared(name, i + 1)
        elif s.is_kind(i - 1, STRING) and s.is_kind(i + 1, WORD):
            self.compared(s.word(i + 1), i - 1)

    def compared(self, name: str, v: int) -> None:
        """A literal that a name is compared with; references to the name don't find it."""
        self.here = self.s.start[v]
        if parts := self.string(v):
            self.bind(f"{name}==", parts)

    def tuple_of(self, i: int) -> list[str]:
        """Names before the operator at i if they are two or more between commas, in brackets or at the start of a statement."""
        s, j, names = self.s, i - 1, []
        opened = {"]": "[", ")": "("}.get(s.word(j), "")
        j -= bool(opened)
        while s.is_kind(j, WORD):
            names.append(s.word(j))
            j -= 1
            if s.word(j) != ",":
                break
            j -= 1
        if len(names) < 2:
            return []
        if opened:
            called = s.is_kind(j - 1, WORD) and s.end[j - 1] == s.start[j]
            return names[::-1] if s.word(j) == opened and not called else []
        return names[::-1] if j < 0 or s.is_kind(j, LINE) or s.word(j) in DECLARES | {";"} else []

    def elements(self, v: int, n: int) -> list[list[Part]]:
        """Values between commas from v on, up to n + 1 of them."""
        s, out = self.s, []
        v += s.word(v) in ("[", "(")
        while len(out) <= n:
            v += s.is_kind(v, LINE)
            parts, v = self.value(v)
            out.append(parts)
            if s.word(v) != ",":
                break
            v += 1
        return out

    def operator(self, i: int) -> None:
        op, v = self.s.word(i), i + 1
        if op == ":" and i < self.chain:
            return  # between two alternatives
        if op in ("=", ":=") and (several := self.tuple_of(i)):
            values = self.elements(v, len(several))
            if len(values) == len(several):
                self.here = self.s.start[i]
                for name, parts in zip(several, values, strict=True):
                    if parts:
                        self.bind(name, parts)
                return
        names = self.targets(i)
        if not names:
            return
        if self.s.word(v) == "[" and (folded := self.joined_list(v)):
            self.here = self.s.start[v]
            for name in names:
                self.bind(name, folded)
            return
        if self.s.word(v) in ("{", "["):
            self.pending = names[0]
            return
        if self.s.is_kind(v, LINE):
            block = len(self.s.word(v)) - 1 - self.s.word(v).rfind("\n")
            if op == ":" and block > self.indent:
                self.blocks.append((self.indent, heavier(names[0], self.blocks[-1][1]) if self.blocks else names[0]))
            if not self.s.is_kind(v + 1, STRING, LONG) or self.s.word(v + 2) in BINDS:
                return
            v += 1
        self.here = self.s.start[v] if v < self.s.n else len(self.s.text)
        options = self.options(v)
        prose = op == ":" and self.in_prose(i) and not self.s.is_kind(v, STRING, LONG) and self.s.word(v) not in SCHEMES
        for name in names:
            if self.s.start[i] < self.tag_end and name.lower() in LABELS | VALUES:
                continue  # the tag itself pairs them
            if len(options) > 1:
                self.choose(name, options)
            elif options:
                parts = [Part(0, 0, "", name)] * (op == "+=") + options[0]
                self.bind(name, parts)
                self.sites[-1].prose = prose
                self.note_label(name, parts)

    def in_prose(self, i: int) -> bool:
        """Whether the name before the operator at i follows a word on its line."""
        s = self.s
        return s.is_kind(i - 1, WORD) and s.is_kind(i - 2, WORD) and s.word(i - 2) not in DECLARES | DIRECTIVES

    def choose(self, name: str, options: list[list[Part]]) -> None:
        """A site for each alternative, and one by the name itself that refers to them."""
        for n, parts in enumerate(options):
            self.bind(f"{name}?{n}", parts)
        end = max(p.end for parts in options for p in parts)
        self.bind(name, [Part(end, end, "", f"{name}?{n}") for n in range(len(options))])
        self.sites[-1].choice = True

    def note_label(self, name: str, parts: list[Part]) -> None:
        here = (len(self.brackets), self.indent)
        if name.lower() in LABELS and KEY.match(parts[0].text):
            self.label = (parts[0].text, *here)
        elif name.lower() in VALUES and self.label[0] and self.label[1:] == here:
            self.sites[-1].name = f"{self.label[0]}.{name}"

    def targets(self, i: int) -> list[str]:
        """Names that the operator at i binds: the one before it, and one that a type stands after."""
        s, j = self.s, i - 1
        while s.word(j) in ("?", "!", "*"):
            j -= 1
        if s.is_kind(j, STRING):
            return [s.content(j)] if s.content(j).strip() else []
        if s.is_kind(j, FLAG):
            return [s.word(j)[2:]]
        if s.word(j) in ("]", "}"):
            opened = {"]": "[", "}": "{"}[s.word(j)]
            base = lambda k: s.word(k) if s.is_kind(k, WORD) else ""
            if s.word(j - 1) == opened:
                return [base(j - 2)] if base(j - 2) else []
            if s.word(j - 2) == opened:
                if s.is_kind(j - 1, STRING, WORD):
                    key = s.content(j - 1) if s.is_kind(j - 1, STRING) else s.word(j - 1)
                    return [f"{base(j - 3)}.{key}".strip(".")]
                return [base(j - 3)] if base(j - 3) else []
            return []
        if not s.is_kind(j, WORD):
            return []
        names, k = [s.word(j)], j
        if s.word(j) in TYPES and s.is_kind(j - 1, WORD):
            names = [s.word(j - 1)]
        while s.is_kind(k, WORD, TAG) or s.word(k) in ("[", "]", "|", "&", "*", "?", ",", ".", "<", ">"):
            k -= 1
        if s.word(k) == ":" and s.is_kind(k - 1, WORD):
            names.append(s.word(k - 1))
        return names

    def tag(self, i: int) -> None:
        """An XML element: its text is bound to its name and to its label, a `value` attribute to its label."""
        s, text = self.s, self.s.text
        if s.word(i).startswith("</"):
            return
        close = i + 1
        while close < s.n and s.word(close) != ">" and s.kind[close] != TAG:
            close += 1
        if s.word(close) != ">":
            return
        self.tag_end = s.start[close]
        label, value = "", None
        for m in ATTRIBUTE.finditer(text, s.end[i], s.start[close]):
            group = 2 if m[2] is not None else 3
            if m[1].lower() in LABELS:
                label = m[group]
            elif m[1].lower() in VALUES:
                value = m.span(group)
        self.here = s.start[i]
        if label and value:
            self.bind(label, [self.literal(*value)])
        if s.word(close - 1) == "/" or not s.is_kind(close + 1, *range(10)):
            return
        a = s.end[close]
        b = text.find("<", a)
        if b > a and text.startswith("</", b):
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                self.bind(f"{s.word(i)[1:]}.{label}".strip("."), [self.literal(a, b)])

    # --- values --------------------------------------------------------------------------------------------------------

    def literal(self, a: int, b: int) -> Part:
        return Part(*self.s.span(a, b), self.s.text[a:b])

    def bind(self, name: str, parts: list[Part]) -> None:
        self.sites.append(Site(name, self.around(), parts))

    def reference(self, i: int) -> Part:
        return Part(*self.s.span(self.s.start[i], self.s.end[i]), self.s.word(i), self.s.word(i))

    def record(self, name: str, v: int) -> None:
        self.here = self.s.start[v] if v < self.s.n else len(self.s.text)
        if parts := self.value(v)[0]:
            self.bind(name, parts)

    def options(self, v: int) -> list[list[Part]]:
        """Parts of the value that begins at token v, or of each of its alternatives: `c ? x : y`, `x if c else y`, `x or y`,
        `x ?? y`, `x ?: y`. A condition is read up to the end of its line or the next operator that binds."""
        parts, at = self.value(v)
        if v < self.chain:
            return [parts] if parts else []
        s, out = self.s, []
        while True:
            if s.word(at) == "or" or (s.word(at) == "?" and s.word(at + 1) in ("?", ":")):
                out.append(parts)
                at += 1 + (s.word(at) == "?")
            elif s.word(at) == "if" and s.word(k := self.condition(at + 1)) == "else":
                out.append(parts)
                at = k + 1
            elif (not parts or parts[0].name) and s.word(k := self.condition(at)) == "?":
                first, after = self.value(k + 1 + s.is_kind(k + 1, LINE))
                after += s.is_kind(after, LINE)
                if s.word(after) != ":":
                    break
                out.append(first)
                at = after + 1
            else:
                break
            parts, at = self.value(at + s.is_kind(at, LINE))
        if out:
            self.chain = max(self.chain, at)
        return [p for p in [*out, parts] if p]

    def condition(self, k: int) -> int:
        """The first token from k on that ends a condition: `?`, `else`, or one that can't be part of one."""
        s, depth = self.s, 0
        while k < s.n and s.kind[k] != LINE:
            word = s.word(k)
            if word in BINDS or word in ("else", ";", "{", "}") or (depth <= 0 and word in ("?", ",")):
                break
            depth += (word in ("(", "[")) - (word in (")", "]"))
            if depth < 0 and not s.is_kind(k + 1, SIGN):
                break
            k += 1
        return k

    def items(self, v: int) -> tuple[list[Part], int]:
        """Strings and names from v on up to the bracket that closes an open one; and the token after it."""
        s, parts, depth = self.s, [], 1
        while depth:
            word = s.word(v)
            if s.is_kind(v, STRING):
                parts += self.string(v)
            elif s.is_kind(v, WORD):
                if s.word(v + 1) != "=":  # the name of an argument is none of its value
                    parts.append(self.reference(v))
            elif word in ("(", "[") and depth < 2:  # so a token is read at most twice
                depth += 1
            elif word in (")", "]"):
                depth -= 1
            elif word == "=" and s.word(v + 2) not in (",", ")"):  # what binds more than an argument is read by itself
                break
            elif word not in (",", "=") and not s.is_kind(v, LINE):
                break
            v += 1
        return parts, v

    def joined_list(self, v: int) -> list[Part]:
        """Parts of a list that is joined at once, if one begins at token v."""
        parts, after = self.items(v + 1)
        return parts if self.s.word(after) == "." and self.s.word(after + 1) == "join" else []

    def template(self, i: int) -> list[Part]:
        """What stands between the places of a template, where it holds no white space."""
        a, b = self.s.inside(i)
        out, at = [], a
        for m in [*PLACE.finditer(self.s.text, a, b), None]:
            piece = self.s.text[at : m.start() if m else b]
            if piece and not any(c.isspace() for c in piece):
                out.append(self.literal(at, at + len(piece)))
            at = m.end() if m else b
        return out

    def folded(self, v: int) -> tuple[list[Part], int] | None:
        """A string at v that a format or join makes of its arguments."""
        s = self.s
        if s.word(v + 1) == "%":
            if s.word(v + 2) == "(":
                parts, after = self.items(v + 3)
            elif s.is_kind(v + 2, STRING):
                parts, after = self.string(v + 2), v + 3
            elif s.is_kind(v + 2, WORD):
                parts, after = [self.reference(v + 2)], v + 3
            else:
                return None
            return self.template(v) + parts, after
        if s.word(v + 1) == "." and s.word(v + 2) in ("format", "join") and s.word(v + 3) == "(":
            parts, after = self.items(v + 4)
            return (self.template(v) if s.word(v + 2) == "format" else []) + parts, after
        return None

    def value(self, v: int) -> tuple[list[Part], int]:
        """Parts of the value that begins at token v: joined strings and names, a wrapped string, a block, a bare word; and
        the token after it."""
        s, parts, wrapped = self.s, [], False
        while s.word(v) in ("(", "&", "@", "*", "$", "!", "{") or (wrapped and s.is_kind(v, LINE)):
            wrapped |= s.word(v) == "("
            v += 1
        if s.word(v) in ("|", ">") and s.is_kind(v + 1 + (s.word(v + 1) in ("-", "+")), LINE):
            return self.block(s.end[v]), s.n
        while True:
            if s.is_kind(v, STRING) and (made := self.folded(v)):
                parts += made[0]
                v = made[1]
            elif s.is_kind(v, STRING, LONG):
                parts += self.string(v)
                v += 1
            elif s.is_kind(v, WORD):
                if s.is_kind(v + 1, STRING, LONG) and s.word(v) in PREFIXES and s.end[v] == s.start[v + 1]:
                    v += 1
                    continue
                found, v = self.named(v)
                for p in found:
                    p.bare &= not parts  # a name that is joined to something is no literal
                parts += found
            elif s.is_kind(v, NUMBER, SIGN, FLAG, ESCAPE) and not parts:
                a, end = self.bare_span(s.start[v])
                return ([self.literal(a, end)], bisect_left(s.start, end)) if end > a else ([], v)
            else:
                return parts, v
            if parts and not parts[-1].name and not s.is_kind(v - 1, STRING, LONG) and s.word(v - 1) not in (")", "]"):
                return parts, bisect_left(s.start, self.end_of_bare, v)  # a bare literal takes in all that touches it
            k = v + s.is_kind(v, LINE)
            if s.word(k) in JOINS or (s.word(k) == "|" and s.word(k + 1) == "|"):
                v = k + 1
                while s.word(v) in ("|", ".", "("):
                    v += 1
                v += s.is_kind(v, LINE)
            else:
                k = k if wrapped else v
                if not (s.is_kind(k, STRING, LONG) and s.is_kind(v - 1, STRING, LONG) and s.word(k + 1) not in BINDS):
                    return parts, k
                v = k

    def string(self, i: int) -> list[Part]:
        s, (a, b) = self.s, self.s.inside(i)
        text = s.text[a:b]
        if INTERPOLATED.match(text):
            return [Part(*s.span(a + m.start(), a + m.end()), "", m[0]) for m in INNER_NAME.finditer(text)]
        if "\n" in text or "\\n" in text:
            return self.lines(a, b)
        space = re.match(r"\s*(?:(?:Bearer|Basic|Token|Digest)\s+)?", text).end()
        return [self.literal(a + space, a + len(text.rstrip()))] if text.strip() and len(text.rstrip()) > space else []

    def lines(self, a: int, b: int) -> list[Part]:
        """The lines without white space inside, each a literal."""
        out, at, line = [], a, self.s.text
        for m in LINE_END.finditer(line, a, b):
            text = line[at : m.start()].strip()
            if text and not any(c.isspace() for c in text):
                begin = line.index(text, at)
                out.append(self.literal(begin, begin + len(text)))
            at = m.end()
        return out

    def block(self, at: int) -> list[Part]:
        """The lines below `at` that are indented deeper than the line of the operator."""
        text, begin = self.s.text, self.s.text.find("\n", at)
        end = begin
        while end >= 0:
            stop = text.find("\n", end + 1)
            line = text[end + 1 : stop if stop >= 0 else len(text)]
            if line.strip() and len(line) - len(line.lstrip()) <= self.indent:
                break
            end = stop if stop >= 0 else len(text)
            if stop < 0:
                break
        return self.lines(begin, end) if 0 <= begin < end else []

    def named(self, v: int) -> tuple[list[Part], int]:
        """A value that begins with a name: a call around one string or name, a subscript, a reference or a bare word."""
        s = self.s
        if s.end[v] < len(s.text) and s.text[s.end[v]] == "(":
            called = s.word(v).rpartition(".")[2].lower()
            if called in LOOKUPS and s.is_kind(v + 2, STRING):
                a, b = s.inside(v + 2)
                known = Part(*s.span(a, max(b, a + 1)), "", s.text[a:b])
                return [known], v + 4 if s.word(v + 3) == ")" else v + 3
            if called in FOLDS:
                parts, after = self.items(v + 2)
                first = self.template(v + 2) if s.is_kind(v + 2, STRING) and called in ("sprintf", "format") else None
                if first is not None:
                    parts = first + parts[len(self.string(v + 2)) :]
                return parts, after
            if s.word(v + 3) == ")" and s.is_kind(v + 2, STRING):
                return self.string(v + 2), v + 4
            if s.word(v + 3) == ")" and s.is_kind(v + 2, WORD):
                return [self.reference(v + 2)], v + 4
            close = v + 3 if s.word(v + 2) == ")" else v + 1
            return [self.reference(v)], close  # what a call gives is no literal
        if s.word(v + 1) == "[" and s.word(v + 3) == "]" and s.is_kind(v + 2, STRING):
            return [Part(0, 0, "", f"{s.word(v)}.{s.content(v + 2)}")], v + 4
        if s.word(v) in SCHEMES and not s.is_kind(v + 1, LINE, OPERATOR):
            return (self.bare(s.start[v + 1]) if v + 1 < s.n and not s.is_kind(v + 1, STRING, LONG) else []), v + 2
        if s.word(v) in ("new", "await") and s.is_kind(v + 1, WORD):
            return self.named(v + 1) if s.word(v + 1) not in ("new", "await") else ([], v + 1)
        a, end = self.bare_span(s.start[v])
        if end > s.end[v] and s.text[s.end[v] : end] not in JOINS:  # more than a name
            return [self.literal(a, end)], v + 1
        return [Part(*s.span(s.start[v], s.end[v]), s.word(v), s.word(v), bare=True)], v + 1

    def bare_span(self, a: int) -> tuple[int, int]:
        """A bare value from a on, without punctuation at its end; of one that an outer name has taken, a piece."""
        text = self.s.text
        m = (PIECE if a < self.taken else BARE).match(text, a)
        end = m.end() if m else a
        self.taken = max(self.taken, end)
        while end > a and text[end - 1] in ".,;:!?":
            end -= 1
        self.end_of_bare = end
        return a, end

    def bare(self, a: int) -> list[Part]:
        a, end = self.bare_span(a)
        return [self.literal(a, end)] if end > a else []


def url_parts(m: re.Match) -> list[Part]:
    """The password of a URL: a literal, or the names that it is made of."""
    if INTERPOLATED.match(m[1]):
        return [Part(m.start(1) + n.start(), m.start(1) + n.end(), "", n[0]) for n in INNER_NAME.finditer(m[1])]
    return [Part(*m.span(1), m[1])]


def sites_of(text: str) -> list[Site]:
    """All sites of a text and of the contents of its strings, by the places of their values."""
    found, todo = [], [Source(text)]
    found += [Site("password", (), url_parts(m)) for m in CREDENTIAL.finditer(text)]
    while todo:
        found += Parser(todo.pop(), todo).sites
    place = lambda s: max((p.end for p in s.parts), default=0)
    return sorted(found, key=place)


def resolve(sites: list[Site]) -> tuple[list[Counter], list[int]]:
    """Links each reference to the last site before it that binds its name, else to the first one after it; returns for
    each site the characters of its whole value, and how irregular it looks. What a cycle adds to itself is left out.
    A bare name that nothing binds becomes a literal."""
    by_name: dict[str, list[int]] = defaultdict(list)
    for i, s in enumerate(sites):
        for name in {s.name, s.name.rpartition(".")[2]}:
            by_name[name].append(i)
    for i, s in enumerate(sites):
        for p in s.parts:
            if p.name is None:
                continue
            where = by_name.get(p.name) or by_name.get(p.name.rpartition(".")[2]) or []
            k = bisect_left(where, i)
            after = k + (k < len(where) and where[k] == i)
            if k > 0:
                s.links.append(where[k - 1])
            elif after < len(where):
                s.links.append(where[after])
            elif p.bare:
                p.name = None
    chars: list[Counter | None] = [None] * len(sites)
    odd = [0] * len(sites)
    begun = bytearray(len(sites))
    for root in range(len(sites)):
        stack = [root]
        while stack:
            i = stack[-1]
            if chars[i] is not None:
                stack.pop()
            elif not begun[i]:
                begun[i] = 1
                stack += [j for j in sites[i].links if not begun[j]]
            else:
                stack.pop()
                own = [p.text for p in sites[i].parts if p.name is None]
                chars[i] = Counter("".join(own))
                odd[i] = max(map(irregular, own), default=0)
                for j in sites[i].links:
                    if chars[j] is not None:
                        chars[i].update(chars[j])
                        odd[i] = max(odd[i], odd[j])
    return chars, odd


_PIECE = r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+|[0-9]+)"
PLAIN = re.compile(rf"{_PIECE}(?:[-_./:]+{_PIECE})*\Z")


#: The least length of a text of digits, or of letters of one case, that may be drawn at random; the least number of different
#: digits; and a run of letters that words don't have.
DIGITS_LEAST, LETTERS_LEAST, DIGITS_DIFFERENT = 10, 12, 6
UNSPOKEN = re.compile(r"[b-df-hj-np-tv-xz]{5}", re.I)


def irregular(text: str) -> int:
    """0 for plain words and numbers between separators, 2 for one kind of character that looks drawn at random, else 1."""
    if text.isascii() and text.isdigit():
        return 2 * (len(text) >= DIGITS_LEAST and len(set(text)) >= DIGITS_DIFFERENT)
    if text.isascii() and text.isalpha() and (text.islower() or text.isupper()):
        return 2 * (len(text) >= LETTERS_LEAST and UNSPOKEN.search(text) is not None)
    return 0 if PLAIN.match(text) else 1


#: Words of notes about passphrases, which passphrases themselves seldom hold.
NOTE_WORDS = {
    "the", "your", "you", "a", "an", "is", "are", "must", "be", "enter", "please", "to", "for", "of", "and", "or", "not", "no",
    "with", "this", "that", "in", "on", "at", "it", "if", "has", "have", "can", "from", "by",
}
#: The fewest words of a passphrase of words alone, and of one with words that hold letters and digits.
WORDS_LEAST, MIXED_LEAST = 4, 2
MIXED = re.compile(r"(?=\S*[A-Za-z])(?=\S*\d)\S+\Z")


def passphrase(name: str, text: str) -> bool:
    """Whether a text with white space is a passphrase: lower-case words without those of a note, under a name that says
    so; or words of letters and digits for the most part, under any name of a password."""
    words = text.split()
    mixed = sum(MIXED.match(w) is not None for w in words)
    if len(words) >= MIXED_LEAST and 2 * mixed > len(words):
        return name_weight(name) >= 3
    spoken = all(w.isalpha() and w.islower() for w in words)
    told = {p.lower() for p in NAME_PART.findall(name)} & {"passphrase", "mnemonic"}
    return bool(told) and len(words) >= WORDS_LEAST and spoken and not any(w in NOTE_WORDS or part_weight(w) > 0 for w in words)
