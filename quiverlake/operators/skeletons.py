"""What source files declare: types, functions with their owners, imports and constants.

A lexer passes over each file once: comments and strings are stepped over, so that what they hold never counts,
and a stack of open blocks (braces, indentation or ``end``) says what a declaration belongs to.  The tokens of a
statement up to its block, or its end, are its head; a head is looked at only where declarations can stand, so
bodies of functions declare nothing.  Everything after the flat list of declarations is done by columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.functions import text as X

_C_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_TWO, _ONE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_TYPES = frozenset({"class", "struct", "enum", "trait", "record", "union", "interface"})
#: Words that begin statements which look like functions but aren't.
_NO_NAMES = frozenset("if for while switch catch return new throw else do try sizeof using lock foreach synchronized with case delete await typeof elseif match when until".split())


@dataclass(frozen=True)
class Language:
    """How a language writes what the lexer must step over, and where its statements end."""

    skip: str
    strings: str
    blocks: str = "braces"
    lines: bool = False  # the end of a line can end a statement
    word: str = ""  # of declared functions; empty: type, name, parameters
    home: str = ""  # word that names the package
    uses: tuple[str, ...] = ()
    types: frozenset[str] = _TYPES
    signs: str = "\\w$"


LANGUAGES = {
    "python": Language(r"#[^\n]*", rf'[rbfuRBFU]{{0,2}}(?:"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)|{_TWO}|{_ONE})', "indent", True, "def", "", ("import", "from"), frozenset({"class"})),
    "javascript": Language(_C_COMMENTS, rf"{_TWO}|{_ONE}|`(?:\\.|[^`\\])*`?", lines=True, word="function", uses=("import",), types=frozenset({"class", "interface", "enum"})),
    "java": Language(_C_COMMENTS, rf'"""(?:\\.|.)*?"""|{_TWO}|{_ONE}', home="package", uses=("import",), types=frozenset({"class", "interface", "enum", "record"})),
    "rust": Language(_C_COMMENTS, rf"r(#*)\".*?\"\1|{_TWO}|'(?:\\[^']+|[^'\\\n])'|'\w+", word="fn", uses=("use",), types=frozenset({"struct", "enum", "trait", "union"})),
    "ruby": Language(r"^=begin\b.*?^=end\b[^\n]*|#[^\n]*", rf"{_TWO}|{_ONE}", "ends", True, "def", "module", ("require", "require_relative"), frozenset({"class"}), r"\w?!@"),
    "csharp": Language(_C_COMMENTS, rf'@"(?:""|[^"])*"|{_TWO}|{_ONE}', home="namespace", uses=("using",), types=frozenset({"class", "struct", "record", "enum", "interface"})),
    "go": Language(_C_COMMENTS, rf"{_TWO}|{_ONE}|`[^`]*`?", lines=True, word="func", home="package", uses=("import",), types=frozenset({"struct", "interface"})),
    "php": Language(rf"<\?(?:php)?|\?>|\#(?!\[)[^\n]*|{_C_COMMENTS}", rf"<<<[ \t]*['\"]?(\w+)['\"]?\n.*?\n[ \t]*\1\b|{_TWO[:-1].replace(chr(92) + 'n', '')}?|{_ONE[:-1].replace(chr(92) + 'n', '')}?", word="function", home="namespace", uses=("use",), types=frozenset({"class", "interface", "trait", "enum"}), signs=r"\w$\\"),
    "cpp": Language(_C_COMMENTS, rf'R"(\w*)\(.*?\)\1"|{_TWO}|{_ONE}', home="namespace", types=frozenset({"class", "struct", "union", "enum"}), signs=r"\w~"),
}
LANGUAGES |= {"typescript": LANGUAGES["javascript"], "c": LANGUAGES["cpp"]}


@dataclass
class _Token:
    kind: str  # w word, s string, n line end, d directive, p other sign
    text: str
    at: int
    end: int


@dataclass
class _Block:
    kind: str  # type, home, hidden (functions and other blocks), group
    name: str
    indent: int = -1
    word: str = ""
    close: str = "}"


@dataclass
class _Reader:
    name: str
    source: str
    found: list[dict] = field(default_factory=list)
    stack: list[_Block] = field(default_factory=list)

    def __post_init__(self):
        self.lang = LANGUAGES[self.name]

    # -- helpers ----------------------------------------------------------------------

    def tokens(self) -> Iterator[_Token]:
        for m in _rule(self.name).finditer(self.source):
            if m.lastgroup != "skip":
                yield _Token(m.lastgroup, m[0], m.start(), m.end())

    def text(self, tokens: list[_Token]) -> str:
        if not tokens:
            return ""
        return re.sub(r"\s+", " ", self.source[tokens[0].at : tokens[-1].end]).strip()

    def open(self) -> bool:
        """Whether declarations can stand here."""
        return all(b.kind != "hidden" for b in self.stack)

    def owner(self) -> str:
        return next((b.name for b in reversed(self.stack) if b.kind == "type" and b.name), "")

    def add(self, kind: str, name: str, **more) -> None:
        row = {"kind": kind, "name": name, "owner": self.owner(), "base": "", "params": "", "returns": "", "waits": False, "also": []}
        row.update(more)
        if len(row["params"]) > 100:  # long parameters are cut
            row["params"] = row["params"][:97] + "..."
        self.found.append(row)

    @staticmethod
    def pair(head: list[_Token], at: int) -> int:
        """Place of the bracket that closes the one at ``at``."""
        deep = 0
        for k in range(at, len(head)):
            deep += (head[k].text in "([{") - (head[k].text in ")]}") if head[k].kind == "p" else 0
            if deep == 0:
                return k
        return len(head)

    def past_generics(self, head: list[_Token], at: int) -> int:
        """Place behind ``<...>`` or ``[...]`` if one begins here."""
        if at < len(head) and head[at].text == "[":
            return self.pair(head, at) + 1
        if at >= len(head) or head[at].text != "<":
            return at
        deep = 0
        for k in range(at, len(head)):
            deep += (head[k].text == "<") - (head[k].text == ">")
            if deep == 0:
                return k + 1
        return len(head)

    def flat(self, head: list[_Token]) -> list[int]:
        """Places of the head that no bracket of it holds."""
        out, k = [], 0
        while k < len(head):
            out.append(k)
            k = self.pair(head, k) + 1 if head[k].text in ("(", "[") and head[k].kind == "p" else k + 1
        return out

    def without_notes(self, head: list[_Token]) -> list[_Token]:
        """The head without ``@name(...)``."""
        out, k = [], 0
        while k < len(head):
            if head[k].text != "@" or k + 1 < len(head) and head[k + 1].text == "interface":
                out.append(head[k])
                k += 1
                continue
            k += 2
            while k < len(head) and head[k].text == ".":
                k += 2
            if k < len(head) and head[k].text == "(":
                k = self.pair(head, k) + 1
        return out

    # -- heads -----------------------------------------------------------------------

    def head(self, head: list[_Token], body: bool) -> _Block:
        """Declarations of a statement, and the block that its body is."""
        hidden = _Block("hidden", "")
        if not head or not self.open():
            return hidden
        if self.name == "java":
            head = self.without_notes(head)
        words = [t.text for t in head] or [""]
        flat = self.flat(head)
        if self.name == "php" and self.stack and self.stack[-1].kind == "type" and words[0] == "use":
            return hidden  # traits of a class
        if words[0] in self.lang.uses or self.name == "rust" and "use" in words[:4] and "fn" not in words:
            return self.use(head, words) if not (body and self.name in ("csharp", "java")) else hidden
        if self.lang.home and self.lang.home in words[:2] and self.name != "cpp" or self.name == "cpp" and "namespace" in words[:2]:
            name = self.text([t for t in head[words.index(self.lang.home) + 1 :] if t.text != ";"])
            self.add("package", f"{self.lang.home} {name}" if name else "")
            return _Block("home", name)
        if self.name == "rust" and "mod" in words[:5] or self.name in ("c", "cpp") and words[0] == "extern" and len(words) == 2 and body:
            return _Block("home", "")
        if self.name == "go":
            return self.go(head, words, body)
        if self.name == "rust" and "impl" in words[:2]:
            k = self.past_generics(head, words.index("impl") + 1)
            k = words.index("for", k) + 1 if "for" in words[k:] else k
            return _Block("type", next((t.text for t in head[k:] if t.kind == "w" and t.text not in ("dyn", "mut")), ""))
        return self.type(head, words, flat, body) or self.function(head, words, flat, body) or hidden

    def use(self, head: list[_Token], words: list[str]) -> _Block:
        strings = [t.text[1:-1] for t in head if t.kind == "s"]
        if self.name in ("javascript", "typescript", "ruby", "go"):
            for s in strings[-1:] if self.name != "go" else strings:
                self.add("import", s)
        elif self.name == "python":
            for k in range(1, len(head)):
                if k == 1 or words[0] == "import" and words[k - 1] == ",":
                    stop = next((j for j in range(k, len(head)) if words[j] in (",", "as", "import")), len(head))
                    self.add("import", self.text(head[k:stop]).replace(" ", ""))
        else:
            k = next((j for j, w in enumerate(words) if w in self.lang.uses), 0) + 1
            k += k < len(words) and words[k] in ("static", "function", "const", "global")
            stop = next((j for j in range(k, len(head)) if words[j] in ("{", "as", ";", "=", ",")), len(head))
            self.add("import", self.text(head[k:stop]).replace(" ", "").removesuffix("::"))
        return _Block("group", "")

    def go(self, head: list[_Token], words: list[str], body: bool) -> _Block:
        hidden = _Block("hidden", "")
        if self.stack and self.stack[-1].kind == "type":
            return hidden
        if words[0] == "func":
            k, owner = 1, ""
            if len(words) > 1 and words[1] == "(":
                k = self.pair(head, 1) + 1
                inner = [t.text for t in head[2 : k - 1] if t.kind == "w"]
                owner = (inner[1:] or inner)[0] if inner else ""
            if k < len(head) and head[k].kind == "w":
                self.signature(head, k, k + 1, len(head), owner=owner)
        elif words[0] == "type" and len(words) > 2:
            k = self.past_generics(head, 2)
            if k < len(words) and words[k] == "struct":
                self.add("type", words[1])
                return _Block("type", words[1])
            if k < len(words) and words[k] == "interface":
                self.add("interface", words[1])
                return _Block("type", words[1])
        elif words[0] == "const" and len(words) > 1 and head[1].kind == "w":
            self.add("constant", words[1])
        return hidden

    def signature(self, head: list[_Token], name: int, at: int, stop: int, **more) -> bool:
        """A function whose name stands at ``name``; its parameters follow ``at``, after type parameters."""
        at = self.past_generics(head, at)
        params, rest = "", at
        if at < stop and head[at].text == "(":
            close = self.pair(head, at)
            params, rest = self.text(head[at + 1 : close]), close + 1
        elif self.name != "ruby":
            return False
        returns = ""
        if "returns" not in more:
            cut = next((k for k in range(rest, stop) if head[k].text in ("where", "=>", "throws", "noexcept", "override", "const", "=", "{")), stop)
            tail = head[rest:cut]
            if self.name == "go":
                returns = self.text(tail)
            elif self.name == "python":
                flat = self.flat(tail)
                stop = next((k for k in flat if tail[k].text == ":"), len(tail))
                returns = self.text(tail[1:stop]) if tail and tail[0].text == "->" else ""
            elif tail and tail[0].text in ("->", ":"):
                returns = self.text(tail[1:])
        self.add("function", head[name].text, params=params, **({"returns": returns} | more))
        return True

    def type(self, head: list[_Token], words: list[str], flat: list[int], body: bool) -> _Block | None:
        k = next((k for k in flat if words[k] in self.lang.types and head[k].kind == "w"), None)
        if k is None or any(words[j] in ("=", "(") or words[j] in (".", "::") and j == k - 1 for j in flat if j < k):
            return None
        word = words[k]
        k += 1
        while k < len(words) and words[k] in ("class", "struct"):  # enum class, record struct
            k += 1
        if k >= len(words) or head[k].kind != "w":
            return None
        if self.name in ("c", "cpp") and any(words[j] in ("(", "=") for j in flat if j > k) or self.name in ("c", "cpp") and not body:
            return None  # a function that returns a struct, a variable, or a name alone
        name, at = words[k], self.past_generics(head, k + 1)
        base, also = "", []
        mark = {"python": "(", "ruby": "<", "csharp": ":", "cpp": ":", "c": ":"}.get(self.name, "extends")
        rest = head[k + 1 :] if self.name in ("ruby",) else head[at:]
        texts = [t.text for t in rest]
        if self.name == "python" and texts[:1] == ["("]:
            base = self.text(rest[1 : self.pair(rest, 0)])
        elif self.name != "python" and mark in texts:
            j = texts.index(mark) + 1
            if self.name in ("c", "cpp"):
                base = next((t.text for t in rest[j:] if t.kind == "w" and t.text not in ("public", "protected", "private", "virtual")), "")
            else:
                stop = next((x for x in range(j, len(rest)) if texts[x] in ("implements", "where", "permits")), len(rest))
                base = self.text(rest[j:stop])
        if "implements" in texts:
            also = [x.strip() for x in re.split(r",(?![^<]*>)", self.text(rest[texts.index("implements") + 1 :]))]
        if word == "enum" and self.name in ("c", "cpp"):
            self.add("constant", name)
            return _Block("hidden", "")
        kind = "interface" if word == "interface" and self.name != "java" or word == "trait" and self.name == "rust" else "type"
        self.add(kind, f"{name} (trait)" if word == "trait" and self.name == "php" else name, base=base, also=also)
        return _Block("type", name)

    def function(self, head: list[_Token], words: list[str], flat: list[int], body: bool) -> _Block | None:
        hidden = _Block("hidden", "")
        waits = "async" in words[:6]
        inside = bool(self.stack) and self.stack[-1].kind == "type"
        if self.lang.word in words and self.lang.word:
            k = words.index(self.lang.word) + 1
            if "=" in [words[j] for j in flat if j < k]:
                return None
            while k < len(words) and words[k] in ("&", "*"):
                k += 1
            if self.name == "ruby" and words[k + 1 : k + 2] == ["."]:  # of the class itself
                k += 2
            if k >= len(words) or head[k].kind != "w":
                return None
            self.signature(head, k, k + 1, len(head), waits=waits)
            return hidden
        if self.name in ("javascript", "typescript"):
            if "=>" in words and "=" in words:
                k = next((j for j in range(len(words)) if words[j] in ("const", "let", "var")), None)
                eq = words.index("=")
                if k is not None and eq < words.index("=>") and not inside:
                    p = eq + 1 + (words[eq + 1 : eq + 2] == ["async"])
                    if p < len(words) and words[p] == "(" and "=>" in words[self.pair(head, p) :]:
                        self.signature(head, k + 1, p, words.index("=>", self.pair(head, p)), waits=waits)
                        return hidden
                return None
            k = next((j for j in flat if words[j] == "("), None)
            if inside and body and k and head[k - 1].kind == "w" and words[k - 1] not in _NO_NAMES and "=" not in words[:k]:
                self.signature(head, k - 1, k, len(head), waits=waits)
                return hidden
            return None
        if self.lang.word or self.name in ("python", "ruby"):
            return None
        # type, name, parameters
        k = next((j for j in flat if words[j] == "(" and j and (head[j - 1].kind == "w" or words[j - 1] == ">")), None)
        if k is None or any(words[j] in ("=", "->", ".", "=>") for j in flat if j < k) or words[0] in _NO_NAMES:
            return None
        n = k - 1
        while n > 0 and words[n] != "<" and words[k - 1] == ">":  # C# methods with type parameters
            n -= 1
        n -= words[k - 1] == ">"
        name = words[n]
        if name in _NO_NAMES or head[n].kind != "w" or not body and self.name == "java" and not inside:
            return None
        before = head[:n]
        while self.name in ("c", "cpp") and before and before[-1].text == "::":
            before = before[:-2]
        kinds = "public protected private internal static final abstract async override virtual sealed inline extern explicit constexpr synchronized native default partial readonly unsafe".split()
        made = [t for t in before if t.text not in kinds]
        if not made and not (inside and name.lstrip("~") == self.owner()) and not (self.name in ("c", "cpp") and n and words[n - 1] == "::"):
            return None
        owner = words[n - 2] if self.name in ("c", "cpp") and n > 1 and words[n - 1] == "::" else self.owner()
        self.signature(head, n, k, len(head), owner=owner, returns=self.text(made), waits=waits)
        return hidden

    # -- blocks ----------------------------------------------------------------------

    def read(self) -> list[dict]:
        {"braces": self.by_braces, "indent": self.by_indent, "ends": self.by_ends}[self.lang.blocks]()
        return self.found

    def by_braces(self) -> None:
        head: list[_Token] = []
        deep = 0  # brackets that the head has open
        for t in self.tokens():
            top = self.stack[-1] if self.stack else None
            if t.kind == "d":
                if m := re.match(r"#\s*include\s*[<\"]([^>\"]+)", t.text):
                    self.add("import", m[1])
            elif t.kind == "n":
                if self.lang.lines and not deep and head and self.ends(head):
                    self.close(head)
            elif t.kind == "p" and t.text == "{" and not deep:
                unpacked = head and head[0].text in self.lang.uses and self.name not in ("csharp", "java", "php")
                if unpacked:
                    head.append(t)
                    deep += 1
                    continue
                self.stack.append(self.head(head, True))
                head = []
            elif t.kind == "p" and top and t.text == top.close and not deep:
                self.close(head)
                self.stack.pop()
            elif t.kind == "p" and t.text == ";" and not deep:
                self.close(head)
            elif t.text == "(" and t.kind == "p" and self.name == "go" and len(head) == 1 and head[0].text in ("import", "const", "type", "var"):
                self.stack.append(_Block("group", "", word=head[0].text, close=")"))
                head = []
            elif self.name == "cpp" and t.text == ":" and len(head) == 1 and head[0].text in ("public", "private", "protected") or self.name == "c" and t.text == ":" and len(head) == 1:
                head = []
            else:
                if t.kind == "p":
                    deep = max(0, deep + (t.text in "([{") - (t.text in ")]}"))
                if not head and top and top.kind == "group" and top.word:
                    head.append(_Token("w", top.word, t.at, t.at))
                head.append(t)
        self.close(head)

    def ends(self, head: list[_Token]) -> bool:
        """Whether the end of a line ends the statement."""
        if self.name == "go":
            return True
        last = head[-1].text
        if last in (",", "=", "=>", "(", "+", ".", "extends", "implements"):
            return False
        return not any(t.text in ("class", "function", "interface", "enum") for t in head[:4])

    def close(self, head: list[_Token]) -> None:
        """A statement without a body ends."""
        self.head(head, False)
        head.clear()

    def by_indent(self) -> None:
        line: list[_Token] = []
        deep = 0
        for t in [*self.tokens(), _Token("n", "", len(self.source), len(self.source))]:
            if t.kind == "n":
                if not line or deep and t.text:
                    continue
                start = line[0].at
                indent = start - (self.source.rfind("\n", 0, start) + 1)
                while self.stack and self.stack[-1].indent >= indent:
                    self.stack.pop()
                block = self.head([x for x in line if x.text != ";"], True) if line[0].kind == "w" else _Block("hidden", "")
                if line[0].text in ("class", "def") or [x.text for x in line[:2]] == ["async", "def"]:
                    block.indent = indent
                    self.stack.append(block)
                line, deep = [], 0
            else:
                deep = max(0, deep + (t.text in "([{") - (t.text in ")]}")) if t.kind == "p" else deep
                line.append(t)

    def by_ends(self) -> None:
        line: list[_Token] = []
        loop = False
        for t in [*self.tokens(), _Token("n", "", len(self.source), len(self.source))]:
            if t.kind != "n" and t.text != ";":
                begins = not line or line[-1].text == "="
                if t.kind == "w" and t.text == "end" and not (line and line[-1].text in (".", ":")):
                    self.statement(line)
                    line = []
                    if self.stack:
                        self.stack.pop()
                    continue
                if t.kind == "w" and begins and t.text in ("if", "unless", "while", "until", "case", "for", "begin"):
                    loop = t.text in ("while", "until", "for")
                    self.stack.append(_Block("hidden", ""))
                elif t.kind == "w" and t.text == "do" and not loop:
                    self.stack.append(_Block("hidden", ""))
                line.append(t)
            else:
                self.statement(line)
                line, loop = [], False

    def statement(self, line: list[_Token]) -> None:
        if not line:
            return
        words = [t.text for t in line]
        start = next((k for k, w in enumerate(words) if w in ("class", "module", "def")), None)
        if start is None or start > 2:
            if words[0] in self.lang.uses:
                self.head(line, False)
            return
        if words[start : start + 2] == ["class", "<"]:
            self.stack.append(_Block("type", ""))
            return
        block = self.head(line[start:], True)
        close = self.pair(line, words.index("(")) if "(" in words else start + 1
        if not (words[start] == "def" and "=" in words[close + 1 : close + 2]):  # a definition in one line has no end
            self.stack.append(block)


_RULES: dict[str, re.Pattern] = {}


def _rule(name: str) -> re.Pattern:
    if name not in _RULES:
        lang = LANGUAGES[name]
        directive = r"|(?P<d>^[ \t]*\#(?:\\\n|[^\n])*)" if name in ("c", "cpp") else ""
        strings = re.sub(r"\\1", "(?P=mark)", lang.strings).replace("(\\w+)", "(?P<mark>\\w+)").replace("(#*)", "(?P<mark>#*)").replace("(\\w*)", "(?P<mark>\\w*)")
        word = rf"[{lang.signs}]+" if name != "ruby" else r"@{0,2}\w+[?!]?"
        _RULES[name] = re.compile(rf"(?P<skip>{lang.skip}){directive}|(?P<s>{strings})|(?P<w>{word})|(?P<n>\n)|(?P<p>->|=>|::|:=|==|!=|<=|>=|&&|\|\||[^\s\w])", re.S | re.M)
    return _RULES[name]


_ROW = "array<struct<kind: string, name: string, owner: string, base: string, params: string, returns: string, waits: boolean, also: array<string>>>"


def declarations(files: DataFrame) -> DataFrame:
    """Rows ``(path, language, declared)`` of source files ``(path, content)``, in their order in the file.

    A declaration is a struct of ``kind`` (package, import, type, interface, function, constant), ``name``,
    ``owner``, ``base``, ``params`` (up to 100 characters), ``returns``, ``waits`` (async) and ``also`` (interfaces of a type).
    Files of other languages and null texts declare nothing.
    """

    @F.pandas_udf(_ROW)
    def declared(language: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([_Reader(n, t).read() if n in LANGUAGES and t else [] for n, t in zip(language, content)])

    language = X.language_of_extension(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    return files.select("path", "content", language.alias("language")).select("path", "content", "language", declared("language", "content").alias("declared"))


def skeletons(files: DataFrame) -> DataFrame:
    """What source files ``(path, content)`` declare.

    Columns: ``path``, ``language``, ``package``, ``types`` (name, base, interfaces), ``methods`` (functions of
    Python's classes), ``functions`` (owner, name, params, returns), ``imports``, ``interfaces``, ``constants``,
    ``lines`` and ``abstract``, one line for each declaration.
    """
    rows = declarations(files)
    of = lambda kind: F.filter("declared", lambda d: d.kind == kind)
    names = lambda kind: F.transform(of(kind), lambda d: d["name"])
    method = lambda d: (F.col("language") == "python") & (d.owner != "")
    made = F.transform(F.filter(of("function"), lambda d: ~method(d)), lambda d: F.struct(d.owner.alias("owner"), d["name"].alias("name"), d.params.alias("params"), d.returns.alias("returns")))
    kept = F.filter(of("function"), method)
    out = rows.select(
        "path", "language", F.coalesce(F.try_element_at(names("package"), F.lit(1)), F.lit("")).alias("package"),
        F.transform(of("type"), lambda d: F.struct(d["name"].alias("name"), d.base.alias("base"), d.also.alias("interfaces"))).alias("types"),
        F.transform(kept, lambda d: d["name"]).alias("methods"), F.transform(kept, lambda d: F.struct(d.owner.alias("owner"), d["name"].alias("name"))).alias("owned"),
        made.alias("functions"), names("import").alias("imports"), names("interface").alias("interfaces"), names("constant").alias("constants"),
        F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n"))).alias("lines"),
    )
    own = lambda t: F.transform(F.filter("owned", lambda m: m.owner == t["name"]), lambda m: m["name"])
    members = lambda t: F.when(F.size(own(t)) > 0, F.concat(F.lit(" ["), F.array_join(own(t), ", "), F.lit("]"))).otherwise("")
    kinds = F.transform("types", lambda t: F.concat(F.lit("class "), t["name"], F.when(t["base"] != "", F.concat(F.lit(" extends "), t["base"])).otherwise(""), members(t)))
    owner = lambda f: F.when((F.col("language") == "go") & (f["owner"] != ""), F.concat(F.lit("("), f["owner"], F.lit(") "))).otherwise("")
    makes = F.transform("functions", lambda f: F.concat(owner(f), F.lit("func "), f["name"], F.when(f["params"] != "", F.concat(F.lit("("), f["params"], F.lit(")"))).otherwise("")))
    listed = F.array_join(F.filter(F.concat(F.array("package"), kinds, makes), lambda x: x != ""), "\n")
    plain = F.format_string("%s (%s, %d lines)", F.substring_index("path", "/", -1), "language", "lines")
    return out.withColumn("abstract", F.when(F.col("language") == "", "").when(listed == "", plain).otherwise(listed)).drop("owned")
