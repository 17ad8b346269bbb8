"""Symbols and references of source files: one row for each file, parsed where it is read.

Tokens (``lexing``) are walked once, with the symbol that owns them and the types around them; Python goes through its own
parser. Rows hold what a file declares and mentions, in the order of their places; resolving names is left to joins.
"""

from __future__ import annotations

import ast
import io
import tokenize
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.text import clean_signature, first_doc_line
from .lexing import Token, mates, tokens

NODE = "struct<line:int,kind:int,name:string,receiver:string,signature:string,doc:string,embeds:array<string>>"
REFERENCE = "struct<kind:int,pkg:string,name:string,line:int,owner:int>"
SCHEMA = f"path string, nodes array<{NODE}>, refs array<{REFERENCE}>, imports map<string,string>"
#: The same in Arrow.
_NODE = pa.struct({"line": pa.int32(), "kind": pa.int32(), **dict.fromkeys(("name", "receiver", "signature", "doc"), pa.string()), "embeds": pa.list_(pa.string())})
_REFERENCE = pa.struct({"kind": pa.int32(), "pkg": pa.string(), "name": pa.string(), "line": pa.int32(), "owner": pa.int32()})
_GRAPH = pa.schema({"path": pa.string(), "nodes": pa.list_(_NODE), "refs": pa.list_(_REFERENCE), "imports": pa.map_(pa.string(), pa.string())})
#: Files whose symbols a task holds at once.
SLICE = 256
CALL, REF = 1, 2
FUNC, METHOD, TYPE, INTERFACE, STRUCT, VAR, CONST = 1, 2, 3, 4, 5, 6, 7
LANGUAGES = {
    "go": ".go", "python": ".py .pyw", "ruby": ".rb .rake", "typescript": ".ts .mts .cts .tsx", "javascript": ".js .mjs .cjs .jsx", "java": ".java", "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp .hxx .hh",
    "csharp": ".cs", "php": ".php .module .inc", "rust": ".rs", "kotlin": ".kt .kts", "scala": ".scala .sc", "dart": ".dart",
}
_LANGUAGE = {e: n for n, es in LANGUAGES.items() for e in es.split()}
_LEXICON = {"typescript": "script", "javascript": "script", "cpp": "c"}
_SCRIPTS, _C, _TYPED = ("typescript", "javascript"), ("c", "cpp"), ("java", "csharp")


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Words that may stand before a bracket and call nothing, by language.
_CONTROL = _words("if for while switch catch return")
_NOT_CALLED = {
    "go": _words("if for switch select return go defer func case range else chan map struct interface var const type"), "ruby": _words("if unless while until case when return and or not yield super defined? in then do else elsif begin end"),
    "typescript": _CONTROL | _words("function typeof new delete void in of await async yield throw case super with constructor else do instanceof"), "java": _CONTROL | _words("synchronized try throw new this super assert case else do"),
    "c": _CONTROL | _words("sizeof alignof _Alignof typeof __attribute__ defined else do case"), "cpp": _CONTROL | _words("sizeof alignof decltype typeid noexcept throw new delete static_assert alignas operator else do case explicit requires co_return co_await static_cast dynamic_cast const_cast reinterpret_cast"),
    "csharp": _CONTROL | _words("foreach lock using fixed sizeof typeof nameof default checked unchecked new base this throw when case else do await stackalloc"), "php": _CONTROL | _words("foreach elseif function fn array list isset unset empty exit die echo print new declare match catch else do case and or xor include require"),
    "rust": _words("if while for match return fn loop in as let mut move unsafe impl where else box dyn ref pub crate self Self super"), "kotlin": _CONTROL | _words("when fun constructor init try throw in is as else do super this get set by object val var"),
    "scala": _CONTROL | _words("match case def new throw yield try else do this super given using extends with"), "dart": _CONTROL | _words("assert super this new const await throw case else do in is as"),
}
_NOT_CALLED["javascript"] = _NOT_CALLED["typescript"]
_CLASS, _FACE = {"class": STRUCT}, {"interface": INTERFACE}
_TYPES = {
    "typescript": _CLASS | _FACE | {"enum": TYPE}, "javascript": _CLASS, "java": _CLASS | _FACE | {"enum": TYPE, "record": STRUCT}, "c": {"struct": STRUCT, "union": STRUCT, "enum": TYPE}, "cpp": _CLASS | {"struct": STRUCT, "union": STRUCT, "enum": TYPE},
    "csharp": _CLASS | _FACE | {"struct": STRUCT, "enum": TYPE, "record": STRUCT}, "php": _CLASS | _FACE | {"trait": INTERFACE, "enum": TYPE}, "rust": {"struct": STRUCT, "union": STRUCT, "enum": TYPE, "trait": INTERFACE, "mod": TYPE},
    "kotlin": _CLASS | _FACE | {"object": TYPE}, "scala": _CLASS | {"trait": INTERFACE, "object": TYPE, "enum": TYPE}, "dart": _CLASS | {"mixin": TYPE, "enum": TYPE},
}
_FUNCTIONS = {"typescript": "function", "javascript": "function", "php": "function", "rust": "fn", "kotlin": "fun", "scala": "def"}
_ALIASES = {"typescript": "type", "rust": "type", "scala": "type", "kotlin": "typealias"}
_VARIABLES = {"typescript": dict.fromkeys(("const", "let", "var"), VAR), "rust": {"const": CONST, "static": VAR}, "kotlin": dict.fromkeys(("val", "var"), VAR), "scala": dict.fromkeys(("val", "var"), VAR)}
_VARIABLES["javascript"] = _VARIABLES["typescript"]
#: Languages in which nothing is called at the beginning of a statement of a type's body: constants of enumerations look so.
_QUIET_TYPES = ("java", "csharp", "kotlin", "dart", "php", "cpp")
#: Words before a declaration that belong to it, and those that only stand before it.
_MODIFIERS = _words("public private protected internal static final abstract override virtual sealed readonly async open data inner suspend inline external lateinit tailrec operator infix implicit lazy case partial unsafe extern pub native synchronized transient volatile strictfp default required covariant late factory get set new friend constexpr typename companion annotation value const var")
_AROUND = _words("export default declare template")
_PRIMITIVES = _words("void int long short byte char float double boolean bool string object decimal uint ulong ushort sbyte var dynamic nint nuint")
_STATEMENTS = _words("return throw new else case goto import package using namespace await yield assert break continue do in is as if while for switch delete typeof")


def _node(line: int, kind: int, name: str, receiver: str = "", signature: str = "", doc: str = "", embeds: list[str] | None = None) -> dict:
    return {"line": line, "kind": kind, "name": name, "receiver": receiver, "signature": " ".join(signature.split()), "doc": doc, "embeds": embeds or []}


def in_none_of(places: list[int], ranges: list[tuple[int, int]]) -> list[bool]:
    """For each of ``places`` whether no half-open range holds it: ranges are sorted and united once, places looked up."""
    starts, ends = [], []
    for a, b in sorted(ranges):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        elif a < b:
            starts.append(a)
            ends.append(b)
    out = []
    for p in places:
        k = bisect_right(starts, p) - 1
        out.append(k < 0 or p >= ends[k])
    return out


class _Walk:
    """What the walks of all languages share: tokens, brackets, symbols, and references with the places that order them."""

    def __init__(self, source: str, language: str) -> None:
        self.source, self.language = source, language
        self.ts = tokens(source, _LEXICON.get(language, language))
        self.words, self.kinds, self.size = [t.text for t in self.ts], [t.kind for t in self.ts], len(self.ts)
        self.mate = mates(self.ts)
        self.nodes: list[dict] = []
        self.found: list[tuple[int, int, dict]] = []
        self.not_called = _NOT_CALLED[language]
        self.heads: set[int] = set()  # brackets of declared parameters

    def text(self, i: int) -> str:
        return self.words[i] if 0 <= i < self.size else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.size and self.kinds[i] == "n"

    def between(self, lo: int, hi: int) -> str:
        """The source from one token's end to another one's start."""
        return self.source[self.ts[lo].end : self.ts[hi].start if hi < len(self.ts) else len(self.source)]

    def closed(self, i: int) -> int:
        """The place after the bracket at ``i`` and all in it."""
        return min(self.mate[i], len(self.ts) - 1) + 1

    def angles(self, i: int) -> int:
        """The place after ``<...>`` from ``i`` on; ``i`` if what stands there are no type arguments."""
        depth, k = 0, i
        while k < len(self.ts) and k < i + 200:
            t = self.ts[k].text
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif t in ("(", "[") or t == "{" and self.language in _SCRIPTS:
                k = self.closed(k)
                continue
            elif t in (";", "{", "}", "&&", "||", ")", "]"):
                return i
            k += 1
        return i

    def led_byangles(self, i: int) -> int:
        """The place before ``<...>`` that ends at ``i``; ``i`` if it is none."""
        depth, k = 0, i
        while k >= 0 and k > i - 60:
            t = self.ts[k]
            if t.text in (">", "<"):
                depth += 1 if t.text == ">" else -1
                if not depth:
                    return k - 1
            elif t.text in (")", "]"):
                k = max(self.mate[k], 0)
            elif t.kind == "p" and t.text not in (",", ".", "::", "?", "&", "|", "*", "->", "[", "=>", ":"):
                return i
            k -= 1
        return i

    def head(self, k: int, hi: int) -> None:
        """Note the bracket of parameters that follows a declared name, maybe after type parameters."""
        k = self.angles(k) if self.text(k) == "<" else self.closed(k) if self.text(k) == "[" else k
        if k < hi and self.text(k) == "(":
            self.heads.add(k)

    def refer(self, i: int, end: int, kind: int, name: str, owner: int, pkg: str = "") -> None:
        self.found.append((self.ts[i].start, -self.ts[min(end, len(self.ts) - 1)].end, {"kind": kind, "pkg": pkg, "name": name, "line": self.ts[i].line, "owner": owner}))

    def function_word(self, k: int) -> int:
        """The word of the function without a name whose head ends at ``k``; -1 if none does."""
        while k > 0:
            t = self.text(k)
            if t in ("func", "function"):
                return k
            if t in (")", "]", "}") and self.mate[k] > 0 and (t != "}" or self.text(self.mate[k] - 1) in ("interface", "struct", ":")):
                k = self.mate[k] - 1
            elif t in (".", "*", ":") or self.is_name(k) and t not in ("return", "if", "for", "case", "switch", "range"):
                k -= 1
            else:
                return -1
        return -1

    def chain_start(self, i: int) -> int:
        """Where the chain of members begins whose last part stands at ``i``: a name, or the end of brackets."""
        while i > 0:
            if self.ts[i].text in (")", "]", "}") and self.mate[i] >= 0:
                k = self.mate[i]
                before = k - 1
                if self.text(i) == "}":
                    at = self.function_word(before)
                    if at >= 0:
                        return at
                    if self.language != "go" or not self.is_name(before) or self.text(before) in self.not_called:
                        return i
                    i = before  # a value of a named type
                    continue
                if self.text(before) == ">" and (b := self.led_byangles(before)) != before:
                    before = b
                if before >= 0 and (self.is_name(before) and self.text(before) not in self.not_called or self.text(before) in (")", "]")) and not (self.ts[k].first and self.language != "go"):
                    i = before
                    continue
                i = k
            step = i - 1
            if step > 0 and self.text(step) in (".", "?.", "::", "->", "!.") and (self.is_name(step - 1) or self.text(step - 1) in (")", "]", "}", ">", "?", "!") or self.ts[step - 1].kind == "v"):
                i = step - 1
                if self.text(i) in ("?", "!"):
                    i -= 1
                if self.text(i) == ">":
                    i = self.led_byangles(i)
                if self.ts[i].kind == "v":
                    return i
                continue
            return i - 1 if self.text(i - 1) == "new" else i
        return i

    def last_name(self, lo: int, hi: int) -> str:
        return next((self.ts[k].text for k in range(hi, lo - 1, -1) if self.is_name(k)), "")

    def call(self, i: int, owner: int) -> None:
        """A call if one's bracket opens at ``i``; its place is where its chain begins."""
        if i in self.heads:
            return
        k = i - 1
        if self.text(k) == "?." and self.language in _SCRIPTS:
            k -= 1
        if self.text(k) == ">":
            k = self.led_byangles(k)
            k = k - 1 if self.text(k) == "::" else k
        if k < 0 or not self.is_name(k) or self.text(k) in self.not_called and self.text(k - 1) not in (".", "?.", "->"):
            if not (k > 0 and self.text(k) in (")", "]") and self.language in (*_SCRIPTS, "go") and self.mate[k] > 0 and not self.ts[i].first):
                return
            if not self.is_name(self.mate[k] - 1) or self.text(self.mate[k] - 1) in self.not_called:
                return
        start = self.chain_start(k)
        if self.text(start) == "new" or self.text(k - 1) == "new" or self.text(k - 1) == "@" and self.language in ("java", "kotlin", "scala", "dart") or self.text(k) in ("Fn", "FnMut", "FnOnce") and self.language == "rust":
            return
        self.refer(start, self.mate[i], CALL, self.ts[k].text.lstrip("#") if self.is_name(k) else self.last_name(start, k), owner)

    def result(self) -> tuple[list, list, dict]:
        return self.nodes, [r for _, _, r in sorted(self.found, key=lambda x: x[:2])], {}


class _Go(_Walk):
    """Go: declarations by their words, and identifiers outside of declared names and callees as references."""

    def __init__(self, source: str) -> None:
        super().__init__(source, "go")
        self.imports: dict[str, str] = {}
        self.skipped: list[tuple[int, int]] = []
        self.named: list[tuple[int, int]] = []  # (token, owner) of identifiers

    def skip(self, lo: int, hi: int) -> None:
        self.skipped.append((self.ts[lo].start, self.ts[hi].end))

    def line_end(self, i: int, hi: int) -> int:
        """Where the entry that begins at ``i`` ends: at a semicolon or a line that begins outside of brackets."""
        k = i
        while k < hi:
            if self.text(k) == ";" or k > i and self.ts[k].first and self.text(k - 1) not in (",", "=", ".", "+", "-", "*", "/", "&&", "||", "|", "<-", ":=", "=="):
                return k
            k = self.closed(k) if self.text(k) in ("(", "[", "{") else k + 1
        return min(k, hi)

    def walk(self, lo: int, hi: int, owner: int) -> None:
        i = lo
        while i < hi:
            t = self.ts[i]
            if t.kind == "n":
                if t.text == "import" and owner < 0:
                    i = self.take_imports(i + 1)
                    continue
                if t.text == "func" and owner < 0:
                    i = self.function(i, hi)
                    continue
                if t.text in ("type", "var", "const") and self.text(i - 1) != ".":
                    i = self.group(i, hi, owner)
                    continue
                if t.text == "package":
                    i += 2
                    continue
                if owner >= 0:
                    self.identifier(i, owner)
            elif t.text == "(":
                self.go_call(i, owner)
            i += 1

    def identifier(self, i: int, owner: int) -> None:
        before, after = self.text(i - 1), self.text(i + 1)
        if self.text(i) in ("nil", "true", "false", "iota", "_") or self.text(i) in _GO_WORDS or before == "." and self.text(i - 2) != "(":
            if not (before == "." and self.is_name(i - 2) and self.text(i - 3) != "." and self.text(i - 2) in self.imports and not (after == "(" or after == ".")):
                return
            if not self.type_place(i - 2):
                return
        elif after == "." and self.text(i) in self.imports and self.type_place(i):
            return  # a package before a type
        self.named.append((i, owner))

    def type_place(self, i: int) -> bool:
        """Whether the name at ``i`` begins a type: after a name, a star, brackets or a word for a type, not in an expression."""
        b = self.text(i - 1)
        return b in ("*", "]", "chan", "map", "<-", "interface", "struct") or self.is_name(i - 1) and b not in _GO_WORDS

    def take_imports(self, i: int) -> int:
        end = self.closed(i) if self.text(i) == "(" else i + 1 + (self.ts[i].kind != "v" if i < len(self.ts) else 0)
        for k in range(i, min(end, len(self.ts))):
            if self.ts[k].kind == "v":
                path, alias = self.ts[k].text.strip('"`'), self.text(k - 1)
                if alias not in (".", "_"):
                    self.imports[alias if self.is_name(k - 1) and alias != "import" else path.rpartition("/")[2]] = path
        return end

    def function(self, i: int, hi: int) -> int:
        k, receiver = i + 1, ""
        if self.text(k) == "(":
            receiver = self.receiver(k + 1, self.mate[k])
            k = self.closed(k)
        if not self.is_name(k):
            return i + 1
        owner = len(self.nodes)
        end, body = self.header_end(k + 1, hi)
        self.skip(k, k)
        self.head(k + 1, hi)
        self.nodes.append(_node(self.ts[i].line, METHOD if receiver else FUNC, self.text(k), receiver, self.between(k, end), self.ts[i].doc))
        if self.text(i + 1) == "(":
            self.walk(i + 2, self.mate[i + 1], owner)
        stop = self.closed(body) if body else end
        self.walk(k + 1, stop, owner)
        return stop

    def receiver(self, lo: int, hi: int) -> str:
        names = [k for k in range(lo, hi) if self.is_name(k)]
        if not names:
            return ""
        bracket = next((k for k in range(lo, hi) if self.text(k) == "["), hi)
        return self.text(max((k for k in names if k < bracket), default=names[-1]))

    def header_end(self, k: int, hi: int) -> tuple[int, int]:
        """(where a signature ends, the place of the body or 0)."""
        start = k
        while k < hi:
            t = self.text(k)
            if t == "{":
                if self.text(k - 1) not in ("interface", "struct"):
                    return k, k
                k = self.closed(k)
            elif t in ("(", "["):
                k = self.closed(k)
            elif t == ";" or k > start and self.ts[k].first:
                return k, 0
            else:
                k += 1
        return hi, 0

    def group(self, i: int, hi: int, owner: int) -> int:
        word = self.text(i)
        if self.text(i + 1) == "(":
            k, end = i + 2, self.mate[i + 1]
            while k < end:
                if self.text(k) == ";":
                    k += 1
                    continue
                stop = self.line_end(k, end)
                self.entry(word, k, stop, self.ts[k].doc)
                k = max(stop, k + 1)
            return self.closed(i + 1)
        if not self.is_name(i + 1):
            return i + 1
        stop = self.line_end(i + 1, hi)
        self.entry(word, i + 1, stop, self.ts[i].doc)
        return max(stop, i + 2)

    def entry(self, word: str, i: int, end: int, doc: str) -> None:
        if not self.is_name(i):
            return
        owner, line = len(self.nodes), self.ts[i].line
        self.skip(i, i)
        if word != "type":
            k = i
            while True:
                self.nodes.append(_node(line, VAR if word == "var" else CONST, self.text(k), doc=doc))
                self.skip(k, k)
                if self.text(k + 1) != "," or k + 2 >= end:
                    break
                k += 2
            self.walk(k + 1, end, owner)
            return
        k = i + 1
        if self.text(k) == "[" and self.closed(k) < end and self.text(self.closed(k) - 1) == "]" and self.closed(k) - k > 3:
            k = self.closed(k)  # type parameters
        k += self.text(k) == "="
        what = {"struct": STRUCT, "interface": INTERFACE}.get(self.text(k), TYPE)
        self.nodes.append(_node(line, what, self.text(i), doc=doc))
        if what == TYPE or self.text(k + 1) != "{":
            self.walk(i + 1, end, owner)
            return
        self.walk(i + 1, k, owner)
        self.members(k + 2, self.mate[k + 1], owner, what == INTERFACE)

    def members(self, i: int, end: int, owner: int, face: bool) -> None:
        """Fields are no symbols, methods of an interface are; what has a type alone is embedded."""
        while i < end:
            if self.text(i) in (";", ","):
                i += 1
                continue
            stop = max(self.line_end(i, end), i + 1)
            k = i + (self.text(i) == "*")
            last = k + 2 if self.text(k + 1) == "." else k
            after = last + 1
            if self.text(after) == "[" and self.closed(after) >= stop:
                after = self.closed(after)
            if face and self.is_name(i) and self.text(i + 1) == "(":
                mine = len(self.nodes)
                self.nodes.append(_node(self.ts[i].line, METHOD, self.text(i), self.nodes[owner]["name"], self.source[self.ts[i].end : self.ts[stop - 1].end], self.ts[i].doc))
                self.skip(i, i)
                self.head(i + 1, stop)
                self.walk(i + 1, stop, mine)
            elif self.is_name(k) and self.is_name(last) and (after >= stop or self.ts[after].kind == "v"):
                self.nodes[owner]["embeds"].append(self.text(last))
                self.refer(i, stop - 1, REF, self.text(last), owner)
                self.named.append((last, owner))
            else:
                while self.is_name(k) and self.text(k + 1) == ",":
                    k += 2
                if self.text(k + 1) in ("struct", "interface") and self.text(k + 2) == "{":
                    self.members(k + 3, self.mate[k + 2], owner, False)
                else:
                    self.walk(k if face else k + 1, stop, owner)
            i = stop

    def go_call(self, i: int, owner: int) -> None:
        if i in self.heads:
            return
        k = i - 1
        if self.text(k) == "]" and self.is_name(self.mate[k] - 1):
            k = self.mate[k] - 1  # type arguments
        if self.text(k) == "}":
            start = self.chain_start(k)
            if self.text(start) != "func" or self.ts[i].first:
                return
        elif self.text(k) == ")":
            if self.mate[k] < 1 or self.ts[i].first or self.text(self.mate[k] - 1) in _GO_WORDS or self.text(self.mate[k] - 1) == ")":
                return
            start = self.chain_start(k)
            if self.text(start - 1) == "func" or self.is_name(start - 1) and self.text(start - 2) == "func":
                return
        elif not self.is_name(k) or self.text(k) in _GO_WORDS or self.text(k - 1) in ("]", "func"):
            return
        else:
            start = self.chain_start(k)
            if self.text(start - 1) == "]" or self.text(start - 1) == "func":
                return  # a conversion to a slice or array
        operand = self.text(k - 2) if self.text(k - 1) == "." and start == k - 2 else ""
        self.refer(start, self.mate[i], CALL, self.last_name(start, k), owner, operand if operand in self.imports else "")
        self.skip(start, i - 1 if k == i - 1 else k)

    def result(self) -> tuple[list, list, dict]:
        free = in_none_of([self.ts[i].start for i, _ in self.named], self.skipped)
        for (i, owner), counts in zip(self.named, free):
            if counts:
                self.refer(i, i, REF, self.text(i), owner)
        nodes, refs, _ = super().result()
        return nodes, refs, self.imports


_GO_WORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")


class _Braced(_Walk):
    """Languages with braces. ``place`` is top (of a file or namespace), type (a type's body), code or args."""

    def __init__(self, source: str, language: str) -> None:
        super().__init__(source, language)
        self.types, self.word = _TYPES[language], _FUNCTIONS.get(language, "")
        self.variables, self.alias = _VARIABLES.get(language, {}), _ALIASES.get(language, "")

    def walk(self, lo: int, hi: int, owner: int, holders: tuple[str, ...] = (), place: str = "top", direct: bool = False) -> None:
        i = lo
        while i < hi:
            t = self.ts[i]
            if t.kind == "n":
                k = self.declared(i, hi, owner, holders, place, direct)
                if k > i:
                    i = k
                    continue
                if self.language == "kotlin" and self.text(i + 1) == "{" and place != "type" and t.text not in self.not_called and not self.ts[i + 1].first and self.text(i - 1) not in (":", "->", "class", "interface", "object"):
                    self.refer(self.chain_start(i), self.mate[i + 1], CALL, t.text, owner)
            elif t.text in ("(", "[", "{") and t.kind == "p":
                if t.text == "(" and not (place == "type" and self.language in _QUIET_TYPES and self.text(i - 2) in ("{", "}", ",", ";")):
                    self.call(i, owner)
                inner, near = "args" if t.text != "{" else "code", direct and t.text != "{"
                if t.text == "{" and place == "top" and self.opens_namespace(i):
                    inner, near = "top", direct
                elif t.text == "{" and self.opens_anonymous(i):
                    inner, near = "type", bool(holders)
                elif t.text == "{" and place == "type":
                    near = False
                self.walk(i + 1, min(self.mate[i], hi), owner, holders, inner, near)
                i = self.closed(i)
                continue
            i += 1

    def opens_namespace(self, i: int) -> bool:
        k = i - 1
        while k >= 0 and (self.ts[k].kind in "nv" or self.text(k) in (".", "::", "\\")) and i - k < 12:
            if self.text(k) in ("namespace", "extern", "module", "package", "impl", "extension"):
                return True
            k -= 1
        return False

    def opens_anonymous(self, i: int) -> bool:
        if self.language == "kotlin":
            return any(self.text(k) == "object" for k in range(max(0, i - 8), i))
        if self.language not in ("java", "csharp", "dart", "scala", "php") or self.text(i - 1) != ")" and self.language != "scala":
            return False
        k = self.chain_start(i - 1) if self.text(i - 1) == ")" else i - 1
        return self.text(k) == "new" or self.text(k - 1) == "new"

    def lead(self, i: int) -> tuple[int, int]:
        """(first token of the declaration at ``i`` with its modifiers, first one of all that stands before it)."""
        own = i
        while own > 0:
            t = self.ts[own - 1]
            if t.kind == "n" and t.text in _MODIFIERS and self.text(own - 2) not in (".", "?."):
                own -= 1
            elif t.kind == "n" and self.text(own - 2) == "@" and self.language not in _SCRIPTS:
                own -= 2
            elif t.text == ")" and self.mate[own - 1] > 1 and self.text(self.mate[own - 1] - 2) == "@" and self.language not in _SCRIPTS:
                own = self.mate[own - 1] - 2
            elif t.text == "]" and self.language == "csharp" and self.mate[own - 1] >= 0 and self.text(self.mate[own - 1] - 1) in ("", ";", "{", "}", "]"):
                own = self.mate[own - 1]
            elif t.text == ")" and self.mate[own - 1] > 0 and self.text(self.mate[own - 1] - 1) == "pub":
                own = self.mate[own - 1] - 1
            else:
                break
        outer = own
        while outer > 0:
            t = self.ts[outer - 1]
            if t.kind == "n" and (t.text in _AROUND or self.text(outer - 2) == "@"):
                outer -= 2 if self.text(outer - 2) == "@" else 1
            elif t.text == ")" and self.mate[outer - 1] > 1 and self.text(self.mate[outer - 1] - 2) == "@":
                outer = self.mate[outer - 1] - 2
            elif t.text == "]" and self.mate[outer - 1] > 0 and self.text(self.mate[outer - 1] - 1) == "#":
                outer = self.mate[outer - 1] - 1
            elif t.text == ">" and (b := self.led_byangles(outer - 1)) != outer - 1 and self.text(b) == "template":
                outer = b
            else:
                break
        return own, outer

    def declared(self, i: int, hi: int, owner: int, holders: tuple[str, ...], place: str, direct: bool) -> int:
        """The place after what is declared at ``i``; ``i`` if nothing is."""
        word, before = self.text(i), self.text(i - 1)
        if before in (".", "?.", "->") or before == "::" and not (self.language == "cpp" and self.text(i + 1) == "("):
            return i
        if word in self.types and self.is_name(i + 1) and not (self.language == "cpp" and before in ("<", ",")):
            return self.type_(i, hi, owner, holders, place)
        if word == "impl" and self.language == "rust":
            return self.impl(i, hi, owner, holders)
        if word == self.alias and self.is_name(i + 1) and place != "args":
            k = self.angles(i + 2) if self.text(i + 2) == "<" else self.closed(i + 2) if self.text(i + 2) == "[" else i + 2
            if self.text(k) == "=" or self.language == "rust" and self.text(k) in (":", ";"):
                own, outer = self.lead(i)
                self.nodes.append(_node(self.ts[own].line, TYPE, self.text(i + 1), doc=self.ts[outer].doc))
                return k
            return i
        if word == self.word:
            return self.function(i, hi, owner, holders, direct)
        if word in self.variables and place != "args" and not (self.language in ("kotlin", "scala") and before == "("):
            return self.variable(i, hi, owner, holders)
        if self.language in _TYPED or self.language == "php":
            k = self.typed(i, hi, owner, holders, place)
            if k > i:
                return k
        if self.text(i + 1) == "(" or self.text(i + 1) == "<":
            return self.method(i, hi, owner, holders, place, direct)
        return i

    def type_(self, i: int, hi: int, owner: int, holders: tuple[str, ...], place: str) -> int:
        word, k, led_by = self.text(i), i + 1, self.text(i - 1)
        if word == "enum" and self.text(k) in ("class", "struct"):
            k += 1
        if word == "record" and self.text(k) in ("class", "struct"):
            k += 1
        name = self.text(k)
        if not self.is_name(k) or self.language == "java" and word == "record" and self.text(k + 1) not in ("(", "<") or place == "args" and self.language not in (*_SCRIPTS, *_C):
            return i
        own, outer = self.lead(i)
        kind = STRUCT if self.language == "kotlin" and word == "class" else self.types[word]
        if self.language == "kotlin" and led_by == "enum":
            kind = TYPE
        mine, column = len(self.nodes), self.ts[own].column
        body, j = 0, k + 1
        while j < hi:
            t = self.ts[j]
            if t.text == "{":
                body = j
                break
            if t.text in (";", ")", "}", ",") and not (t.text == "," and any(self.text(x) in (":", "implements", "extends", "with", "on") for x in range(k, j))) or t.text == "=" or self.language in _C and (t.text in ("(", "*", "&") or self.is_name(j) and t.text != "final" and self.text(j - 1) not in (":", ",", "::", "<", "public", "private", "protected", "virtual")):
                break
            if t.first and t.column <= column and t.text not in (":", "where", "extends", "implements", "with", "permits"):
                break
            j = self.angles(j) if t.text == "<" and self.angles(j) > j else self.closed(j) if t.text in ("(", "[") else j + 1
        self.nodes.append(_node(self.ts[own].line, kind, name, doc=self.ts[outer].doc))
        self.head(k + 1, j)
        inner = (*holders, name)
        self.walk(k + 1, j, mine, inner, "args", False)
        if not body:
            return j
        self.walk(body + 1, min(self.mate[body], hi), mine, inner, "type", True)
        return self.closed(body)

    def impl(self, i: int, hi: int, owner: int, holders: tuple[str, ...]) -> int:
        k = self.angles(i + 1) if self.text(i + 1) == "<" else i + 1
        name, j = "", k
        while j < hi and self.text(j) not in ("{", ";", "where"):
            if self.text(j) == "for":
                name = ""
            elif self.is_name(j) and self.text(j) not in ("dyn", "mut"):
                name = self.text(j)
            j = self.angles(j) if self.text(j) == "<" and self.angles(j) > j else self.closed(j) if self.text(j) in ("(", "[") else j + 1
        while j < hi and self.text(j) not in ("{", ";"):
            j += 1
        if self.text(j) != "{" or not name:
            return i
        self.walk(j + 1, min(self.mate[j], hi), owner, (*holders, name), "type", True)
        return self.closed(j)

    def body_of(self, k: int, hi: int, column: int, arrow: bool) -> tuple[int, str]:
        """(where a function's head ends, what follows: '{', '=' for an expression, '' for nothing)."""
        while k < hi:
            t = self.ts[k]
            if t.text == "{":
                if self.text(k - 1) not in (":", "|", "&", "<", ",") or self.language not in _SCRIPTS:
                    return k, "{"
                k = self.closed(k)
                continue
            if t.text in (";", "}", ")", "]") or t.text == "," and self.language != "java" and self.language != "rust" and self.language != "cpp":
                return k, ""
            if t.text == "=" and self.language in ("kotlin", "scala", "cpp") or t.text == "=>" and arrow:
                return k, "=" if self.language != "cpp" else ""
            if t.first and t.column <= column and t.text not in ("where", "throws", ":", "->", "const", "noexcept", "override"):
                return k, ""
            if t.text == "<" and self.angles(k) > k:
                k = self.angles(k)
            else:
                k = self.closed(k) if t.text in ("(", "[") else k + 1
        return hi, ""

    def expression_end(self, k: int, hi: int, column: int) -> int:
        """Where an expression ends: at a separator, or at a line that is indented no deeper than its statement."""
        while k < hi:
            t = self.ts[k]
            if t.text in (";", ",", ")", "]", "}"):
                return k
            if t.first and t.column <= column and t.text not in (".", "?.", "?", ":", "&&", "||", "+", "-", "=>", "else", "??", "|", "&", ")", "]", "}"):
                return k
            k = self.closed(k) if t.text in ("(", "[", "{") else k + 1
        return hi

    def line_column(self, i: int) -> int:
        while i > 0 and not self.ts[i].first:
            i -= 1
        return self.ts[i].column

    def into(self, k: int, what: str, hi: int, owner: int, holders: tuple[str, ...], column: int) -> int:
        """Walk the body that begins at ``k``."""
        if what == "{":
            self.walk(k + 1, min(self.mate[k], hi), owner, holders, "code")
            return self.closed(k)
        if what == "=":
            end = self.expression_end(k + 1, hi, column)
            self.walk(k + 1, end, owner, holders, "code")
            return end
        return k

    def function(self, i: int, hi: int, owner: int, holders: tuple[str, ...], direct: bool) -> int:
        k = i + 1
        k += self.text(k) in ("*", "&")
        if self.language == "kotlin":
            k = self.angles(k) if self.text(k) == "<" else k
            while self.is_name(k) and self.text(k + 1) in (".", "<", "?."):
                after = self.angles(k + 1) if self.text(k + 1) == "<" else k + 1
                if self.text(after) not in (".", "?."):
                    break
                k = after + 1
        if not self.text(k).startswith("`") and not self.is_name(k) or self.language in _SCRIPTS and self.text(self.lead(i)[0] - 1) in ("=", "(", ",", ":", "return", "=>", "?", "||", "&&", "new"):
            self.head(k + 1, hi)
            return i
        own, outer = self.lead(i)
        column, mine = self.line_column(own), len(self.nodes)
        end, what = self.body_of(k + 1, hi, column, self.language == "php")
        head = end + 1 if what == "=" and self.language == "scala" else end
        sign = self.source[self.ts[k].end : self.ts[end - 1].end] if head == end else self.source[self.ts[k].end : self.ts[end].end]
        kind = METHOD if direct and holders else FUNC
        self.nodes.append(_node(self.ts[own].line, kind, self.text(k).strip("`"), holders[-1] if kind == METHOD else "", sign, self.ts[outer].doc))
        self.head(k + 1, end)
        self.walk(k + 1, end, mine, holders, "args")
        return self.into(end, what, hi, mine, holders, column)

    def variable(self, i: int, hi: int, owner: int, holders: tuple[str, ...]) -> int:
        """``const`` and the like: each declarator owns what its value mentions."""
        k, kind, column = i + 1, self.variables[self.text(i)], self.line_column(i)
        if self.text(k) in ("fn", "unsafe", "extern", "async", "enum") or self.language == "rust" and self.text(k) == "{":
            return i
        k += self.text(k) == "mut"
        own, outer = self.lead(i)
        line, doc = (self.ts[k] if self.language in _SCRIPTS else self.ts[own]).line if k < len(self.ts) else 0, self.ts[outer].doc
        while k < hi:
            pattern = self.text(k) in ("{", "[", "(")
            after = self.closed(k) if pattern else k + 1
            if self.language == "kotlin" and self.text(k) == "<":
                k = self.angles(k)
                continue
            if not pattern and not self.is_name(k) or self.text(after) in ("of", "in"):
                return k
            name = self.source[self.ts[k].start : self.ts[after - 1].end] if pattern and self.language in _SCRIPTS else next((self.text(x) for x in range(k, after) if self.is_name(x)), "")
            if not name or name == "_":
                return after
            mine = len(self.nodes)
            self.nodes.append(_node(line, kind, " ".join(name.split()), doc=doc))
            end = self.expression_end(after, hi, column)
            self.walk(after, end, mine, holders, "code")
            k = end
            if self.text(k) != "," or self.language not in _SCRIPTS:
                return k
            k += 1
            line, doc = self.ts[min(k, len(self.ts) - 1)].line, ""
        return k

    def typed(self, i: int, hi: int, owner: int, holders: tuple[str, ...], place: str) -> int:
        """Variables declared by a type before their names, at the beginning of a statement, and properties."""
        own, outer = self.lead(i)
        if self.language == "php":
            own = self.statement_start(i)
            if place != "type" or not self.text(i).startswith("$") or self.text(own) not in _MODIFIERS or self.text(i + 1) not in (";", "=", ","):
                return i
            outer, k = own, i
        elif place == "args" and not (self.text(own - 1) == "(" and self.text(own - 2) in ("for", "using", "try", "fixed")) or own > 0 and self.text(own - 1) not in (";", "{", "}", "(", ")", ":", "]"):
            return i
        else:
            k = i
            if self.text(k) in _STATEMENTS or self.text(k) in _MODIFIERS and self.text(k) != "var":
                return i
            k += 1
            while self.text(k) in (".", "::") and self.is_name(k + 1):
                k += 2
            k = self.angles(k) if self.text(k) == "<" else k
            while self.text(k) in ("[", "?", "*"):
                k = self.closed(k) if self.text(k) == "[" else k + 1
            if not self.is_name(k) or k == i or self.text(k) in ("instanceof", "is", "as", "in"):
                return i
            prop = self.language == "csharp" and place == "type" and self.text(k + 1) in ("{", "=>")
            if self.text(k + 1) not in ("=", ";", ",", "[") and not prop or self.text(k + 1) == "[" and self.language != "java":
                return i
        line, doc, column = self.ts[own].line, self.ts[outer].doc, self.line_column(own)
        while k < hi and self.is_name(k):
            mine = len(self.nodes)
            self.nodes.append(_node(line, VAR, self.text(k).lstrip("$"), doc=doc))
            end = k + 1
            if self.text(end) == "{":
                self.walk(end + 1, self.mate[end], mine, holders, "code")
                end = self.closed(end)
                if self.text(end) != "=":
                    return end
            stop = self.expression_end(end, hi, -1)
            self.walk(end, stop, mine, holders, "code")
            if self.text(stop) != ",":
                return stop
            k, line = stop + 1, self.ts[min(stop + 1, len(self.ts) - 1)].line
        return k

    def method(self, i: int, hi: int, owner: int, holders: tuple[str, ...], place: str, direct: bool) -> int:
        """Functions without a word of their own: a name, parameters and a body."""
        name, script = self.text(i), self.language in _SCRIPTS
        open_ = self.angles(i + 1) if self.text(i + 1) == "<" else i + 1
        if self.text(open_) != "(" or name in self.not_called - {"constructor"} or self.mate[open_] >= hi or self.language in ("php", "rust", "kotlin", "scala"):
            return i
        before = self.text(i - 1)
        if before == "@":
            return i
        own, outer = self.lead(i)
        if script:
            brace = self.text(self.closed(open_)) == "{" and self.text(own - 1) in ("{", ",", "}", ";", "*")
            if place == "args" and not brace or place != "type" and not brace:
                return i
            if self.text(own - 1) in (".", "=", "new", "(", ":", "=>"):
                return i
            own = min(own, i)
        else:
            if place not in ("type", "top"):
                return i
            typed = self.is_name(i - 1) and before not in _STATEMENTS or before in (">", "]", "*", "&", "?", "&&")
            built = self.language in ("cpp", "dart") and direct and holders and name == holders[-1] or self.language == "cpp" and before in ("::", "~")
            if not typed and not built:
                if holders and name == holders[-1] and direct:  # a constructor is no symbol here, its body is the type's
                    end, what = self.body_of(self.closed(open_), hi, -1, True)
                    if what:
                        self.walk(open_ + 1, end, owner, holders, "args")
                        return self.into(end, what, hi, owner, holders, -1)
                return i
        end, what = self.body_of(self.closed(open_), hi, -1 if not script else self.line_column(own), not script)
        if self.language == "cpp" and what != "{" and any(self.text(x) == ":" for x in range(self.closed(open_), min(end + 1, hi))):
            while end < hi and self.text(end) not in ("{", ";"):
                end = self.closed(end) if self.text(end) in ("(", "[") else end + 1
            what = self.text(end) if self.text(end) == "{" else ""
        if not what and not (place == "type" and self.language in ("typescript", "java", "csharp", "dart") and self.text(end) in (";", "}", ",") or place == "type" and self.language == "typescript"):
            return i
        if not what and self.text(self.closed(open_)) == "=":
            return i
        if not script:  # the type and what stands before it belong to the declaration
            own = outer = self.statement_start(i)
        mine = len(self.nodes)
        kind = METHOD if script or direct and holders else FUNC
        self.nodes.append(_node(self.ts[own].line, kind, name.lstrip("#"), holders[-1] if kind == METHOD and holders else "", self.source[self.ts[i].end : self.ts[end - 1].end], self.ts[outer].doc))
        self.head(i + 1, end)
        self.walk(i + 1, self.closed(open_) if self.language == "cpp" else end, mine, holders, "args")
        return self.into(end, what, hi, mine, holders, self.line_column(own))

    def statement_start(self, i: int) -> int:
        while i > 0 and self.text(i - 1) not in (";", "{", "}") and not (self.text(i - 1) == ":" and self.text(i - 2) in ("public", "private", "protected")):
            i = self.mate[i - 1] if self.text(i - 1) in (")", "]") and self.mate[i - 1] >= 0 else i - 1
        return i


class _Ruby(_Walk):
    """Ruby: words open what ``end`` closes."""

    _OPENING = _words("class module def if unless while until case begin for do")

    def __init__(self, source: str) -> None:
        super().__init__(source, "ruby")
        self.walk()

    def modifies(self, i: int) -> bool:
        """Whether ``if`` and the like at ``i`` follow a statement instead of beginning one."""
        t, b = self.ts[i], self.ts[i - 1] if i else None
        return bool(b) and not t.first and (b.kind == "v" or b.kind == "n" and b.text not in ("then", "do", "else", "and", "or", "not", "begin", "ensure", "in", "when", "elsif") or b.text in (")", "]", "}"))

    def walk(self) -> None:
        held: list[tuple[int, str]] = []  # (owner, type name) of what is open; owner -1 for what is no symbol
        loop = short = -1
        for i, t in enumerate(self.ts):
            short = -1 if t.first else short
            owner = short if short >= 0 else next((o for o, _ in reversed(held) if o >= 0), -1)
            if t.kind == "n" and self.text(i - 1) not in (".", "&."):
                if t.text == "end":
                    if held:
                        held.pop()
                    continue
                if t.text in self._OPENING and self.text(i + 1) != ":":
                    if t.text in ("if", "unless", "while", "until") and self.modifies(i):
                        continue
                    if t.text == "do" and loop >= 0 and not any(self.ts[k].first for k in range(loop + 1, i)):
                        loop = -1
                        continue
                    if t.text in ("while", "until", "for"):
                        loop = i
                    held.append(self.opened(i, held))
                    if held[-1] == (-2, ""):
                        held.pop()
                        short = len(self.nodes) - 1
                    continue
                if self.text(i + 1) == "=" and t.text[0] != "@" and (t.first or self.text(i - 1) in (";", "=", "then")) and not self.text(i + 2) == "=":
                    self.nodes.append(_node(t.line, VAR, t.text))
            if t.kind == "n" and self.called(i) and t.text not in self.not_called and t.text not in self._OPENING:
                self.refer(self.chain_start(i), i, CALL, t.text, owner)

    def called(self, i: int) -> bool:
        """A call has a receiver, brackets or an argument on its line."""
        if self.text(i - 1) == "def" or self.text(i - 3) == "def" and self.text(i - 1) == "." or self.text(i - 1) == ":" and self.ts[i - 1].end == self.ts[i].start:
            return False
        t, after = self.ts[i], self.ts[i + 1] if i + 1 < len(self.ts) else None
        if self.text(i - 1) in (".", "&."):
            return True
        if not after or after.first or t.text[0] == "@" or t.text[0].isupper() and after.text != "(":
            return False
        if after.text == "(" and after.start == t.end:
            return True
        return (after.kind == "v" or after.kind == "n" and after.text not in self.not_called and after.text not in ("end", "rescue", "ensure")) and after.start > t.end

    def opened(self, i: int, held: list[tuple[int, str]]) -> tuple[int, str]:
        word, doc, line = self.text(i), self.ts[i].doc, self.ts[i].line
        if word in ("class", "module") and self.is_name(i + 1):
            k = i + 1
            while self.text(k + 1) == "::":
                k += 2
            self.nodes.append(_node(line, STRUCT if word == "class" else TYPE, self.text(k), doc=doc))
            return len(self.nodes) - 1, self.text(k)
        if word == "def":
            k = i + 3 if self.text(i + 2) == "." else i + 1
            after = k + 1
            if self.text(after) == "(":
                after = self.closed(after)
            else:
                while after < len(self.ts) and not self.ts[after].first and self.text(after) not in (";", "="):
                    after += 1
            holder = next((n for _, n in reversed(held) if n), "")
            sign = self.source[self.ts[k].end : self.ts[after - 1].end] if k < len(self.ts) else ""
            self.nodes.append(_node(line, METHOD if holder else FUNC, self.text(k), holder, sign, doc))
            if self.text(after) == "=" and not self.ts[after].first:
                return -2, ""  # one expression and no end
            return len(self.nodes) - 1, ""
        return -1, ""


def parse_go(source: str) -> tuple[list, list, dict]:
    w = _Go(source)
    w.walk(0, len(w.ts), -1)
    return w.result()


def parse_braced(source: str, language: str) -> tuple[list, list, dict]:
    """``language`` by its name or one of its extensions."""
    w = _Braced(source, _LANGUAGE.get(language, language))
    w.walk(0, len(w.ts), -1)
    return w.result()


def parse_ruby(source: str) -> tuple[list, list, dict]:
    return _Ruby(source).result()


def parse_python(source: str) -> tuple[list, list, dict]:
    nodes, found = [], []
    comments = {t.start[0]: t.string for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT}
    filled = [bool(x.strip()) for x in source.split("\n")]

    def doc(x: ast.AST) -> str:
        """The comment above, over empty lines, if it has its line for itself or ends one."""
        if x.decorator_list:
            return ""
        above = x.lineno - 1
        while above and not filled[above - 1]:
            above -= 1
        return comments.get(above, "")

    def target(t: ast.AST) -> str:
        names = [n for n in ast.walk(t) if isinstance(n, ast.Name)]
        return min(names, key=lambda n: (n.lineno, n.col_offset)).id if names else ""

    def walk(body: list, owner: int, holder: str) -> None:
        for x in body:
            mine, inner = owner, holder
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                mine = len(nodes)
                back = f" -> {ast.unparse(x.returns)}" if x.returns else ""
                nodes.append(_node(x.lineno, METHOD if holder else FUNC, x.name, holder, f"({ast.unparse(x.args)}){back}", doc(x)))
                inner = ""
            elif isinstance(x, ast.ClassDef):
                mine, inner = len(nodes), x.name
                nodes.append(_node(x.lineno, STRUCT, x.name, doc=doc(x)))
            elif isinstance(x, (ast.Assign, ast.AnnAssign)):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if name := target(t):
                        nodes.append(_node(x.lineno, VAR, name))
                        mine = len(nodes) - 1
            elif isinstance(x, ast.Call):
                name = x.func.id if isinstance(x.func, ast.Name) else getattr(x.func, "attr", "")
                if name:
                    found.append((x.lineno, x.col_offset, -x.end_lineno, -x.end_col_offset, {"kind": CALL, "pkg": "", "name": name, "line": x.lineno, "owner": owner}))
            walk(list(ast.iter_child_nodes(x)), mine, inner)

    walk(ast.parse(source).body, -1, "")
    return nodes, [f[-1] for f in sorted(found, key=lambda f: f[:4])], {}


_PARSERS = {"go": parse_go, "python": parse_python, "ruby": parse_ruby}


def parse(path: str, content: bytes) -> tuple[list, list, dict] | None:
    """Nodes, references and imports of a file; None for one of no known language or that can't be parsed."""
    language = _LANGUAGE.get(path[path.rfind(".") :].lower())
    if language is None:
        return None
    source = content.decode("utf-8", "replace").replace("\r\n", "\n")
    try:
        return _PARSERS[language](source) if language in _PARSERS else parse_braced(source, language)
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        return None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a batch's files hold leaves in slices, so that a task never has the symbols of more than ``SLICE`` files as objects."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            out = []
            for f in b.slice(at, SLICE).to_pylist():
                if got := parse(f["path"], f["content"]):  # a file that can't be parsed is tried again at the next build
                    out.append({"path": f["path"], "nodes": got[0], "refs": got[1], "imports": list(got[2].items())})
            yield pa.RecordBatch.from_pylist(out, schema=_GRAPH)


def file_graphs(files: DataFrame) -> DataFrame:
    """(path, nodes, refs, imports) for each of ``files`` (path, content) that can be parsed."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(_parse, SCHEMA)


def exploded(graphs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols (file, ordinal, ...), references (file, owner, ...) and imports (file, alias, path)."""
    nodes = graphs.select(F.col("path").alias("file"), F.posexplode("nodes").alias("ordinal", "x")).select("file", "ordinal", "x.*")
    nodes = nodes.withColumns({"signature": clean_signature(F.col("signature")), "doc": first_doc_line(F.col("doc"))})
    refs = graphs.select(F.col("path").alias("file"), F.posexplode("refs").alias("at", "x")).select("file", "at", "x.*")
    imports = graphs.select(F.col("path").alias("file"), F.explode("imports").alias("alias", "path"))
    return nodes, refs, imports
