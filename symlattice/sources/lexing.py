"""Tokens of source files: names, literals, punctuation and the comments above them, by a pushdown scan.

A stack of states keeps code apart from the strings around it, so that code inside a template is scanned as code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple


class Token(NamedTuple):
    """``kind`` is n(ame), v(alue) or p(unctuation); ``first`` on its line, at ``column``; ``doc`` the comment directly before."""

    kind: str
    text: str
    start: int
    end: int
    line: int
    first: bool
    column: int
    doc: str


@dataclass(frozen=True)
class Lexicon:
    """``literals`` are whole; ``modes`` are (opening, escapes, closing, opening of code) of strings with code inside."""

    comments: str
    literals: tuple[str, ...]
    modes: tuple[tuple[str, str, str, str], ...] = ()
    name: str = r"[^\W\d]\w*"
    ignored: str = r"(?!)"
    nested: bool = False
    regexes: bool = False


_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?\*/"
_DOUBLE, _SINGLE, _CHAR = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"'(?:\\[^\n']*.|[^'\\\n])'"
_TEXT_BLOCK, _BACKQUOTED = r'"""(?:\\.|[^\\])*?"""', r"`[^`\n]*`"
_DIRECTIVE = r"#(?:\\\n|[^\n])*"
_C_RAW = r'(?:u8|[LuU])?R"(?P<delim>[^()\\\s]{0,16})\(.*?\)(?P=delim)"'
_RUST = (r'(?:b|c)?r(?P<hashes>#*)".*?"(?P=hashes)', r'[bc]?"(?:\\.|[^"\\])*"', r"b?'(?:\\u\{[^}]*\}|\\x..|\\.|[^'\\\n])'", r"'[^\W\d]\w*")
_SHARP = (r'(?P<quotes>"{3,}).*?(?P=quotes)', r'@"(?:""|[^"])*"', _DOUBLE, _CHAR)
_HEREDOC = r"<<<[ \t]*(?P<quote>[\"']?)(?P<tag>\w+)(?P=quote)\n.*?\n[ \t]*(?P=tag)\b"
_RUBY_LISTS = r"%[wWiIqQ]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|<[^>]*>|\|[^|\n]*\|)(?!\w)"
_OUTSIDE_PHP = r"\?>.*?(?:<\?(?:php\b|=)|\Z)"
_SCRIPT = Lexicon(f"{_LINE}|{_BLOCK}", (_DOUBLE, _SINGLE), ((r"`", r"\\.", r"`", r"\$\{"),), r"#?(?:[^\W\d]|\$)[\w$]*", regexes=True)
_DART = tuple((q, r"\\.", q, r"\$\{") for q in ("'''", '"""', "'", '"'))
LEXICONS = {
    "go": Lexicon(f"{_LINE}|{_BLOCK}", (_DOUBLE, _CHAR, r"`[^`]*`")),
    "script": _SCRIPT,
    "java": Lexicon(f"{_LINE}|{_BLOCK}", (_TEXT_BLOCK, _DOUBLE, _CHAR)),
    "c": Lexicon(f"{_LINE}|{_BLOCK}", (_C_RAW, _DOUBLE, _CHAR), ignored=_DIRECTIVE),
    "csharp": Lexicon(f"{_LINE}|{_BLOCK}", _SHARP, ((r'\$@"|@\$"', r'""|\{\{', '"', r"\{"), (r'\$"', r"\\.|\{\{", '"', r"\{")), r"@?[^\W\d]\w*", r"#[^\n]*"),
    "php": Lexicon(rf"{_LINE}|{_BLOCK}|#(?!\[)[^\n]*", (_HEREDOC, _SINGLE), (('"', r"\\.", '"', r"\{(?=\$)"),), r"\$?[^\W\d]\w*", _OUTSIDE_PHP),
    "rust": Lexicon(f"{_LINE}|{_BLOCK}", _RUST, (), r"(?:r#)?[^\W\d]\w*", nested=True),
    "kotlin": Lexicon(f"{_LINE}|{_BLOCK}", (_CHAR, _BACKQUOTED), (('"""', r"(?!)", '"""', r"\$\{"), ('"', r"\\.", '"', r"\$\{")), nested=True),
    "scala": Lexicon(f"{_LINE}|{_BLOCK}", (_TEXT_BLOCK, _DOUBLE, _CHAR, _BACKQUOTED), ((r'[a-z]\w*"""', r"(?!)", '"""', r"\$\{"), (r'[a-z]\w*"', r"\\.", '"', r"\$\{")), nested=True),
    "dart": Lexicon(f"{_LINE}|{_BLOCK}", (r"""r(?P<raw>'''|\"""|'|").*?(?P=raw)""",), _DART, r"[^\W\d]\w*", nested=True),
    "ruby": Lexicon(r"#[^\n]*|^=begin\b.*?^=end\b[^\n]*", (_SINGLE, _RUBY_LISTS, r":\"[^\"\n]*\"", r"(?<![:\w]):[^\W\d]\w*[?!=]?(?!:)"), (('"', r"\\.", '"', r"#\{"), ("`", r"\\.", "`", r"#\{")), r"@{0,2}[^\W\d]\w*(?:[?!](?!=))?", regexes=True),
}
_PUNCTUATION = r"=>|->|::|\?\.|:=|===?|!==?|<=|&&|\|\||\+\+|--|<-|\.\.\.?|[-+*/%&|^]=|."
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_VALUE_WORDS = frozenset("return typeof case in of do else and or not if unless while until when yield await throw delete void".split())
_TAGGED = re.compile(r"<<[~-]?([\"'`]?)([A-Z_]\w*)\1")


@lru_cache(maxsize=None)
def _master(language: str) -> tuple[re.Pattern, list[re.Pattern]]:
    x = LEXICONS[language]
    modes = "|".join(f"(?P<m{i}>{m[0]})" for i, m in enumerate(x.modes)) or "(?!)"
    parts = [r"(?P<space>[^\S\n]+|\\\n)", r"(?P<newline>\n)", f"(?P<comment>{x.comments})", f"(?P<ignored>{x.ignored})", modes, "|".join(f"(?P<v{i}>{v})" for i, v in enumerate(x.literals)), rf"(?P<number>\d\w*(?:\.\d\w*)?)", f"(?P<name>{x.name})", f"(?P<p>{_PUNCTUATION})"]
    return re.compile("|".join(parts), re.S | re.M), [re.compile(f"(?P<escape>{e})|(?P<code>{c})|(?P<end>{t})", re.S) for _, e, t, c in x.modes]


def _comment_end(source: str, at: int) -> int:
    """Where a comment that may hold others ends."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(source)


def tokens(source: str, language: str) -> list[Token]:
    """The tokens of a source; code in a template stands in parentheses after the template's own token."""
    lexicon = LEXICONS[language]
    master, inner = _master(language)
    out: list[Token] = []
    stack: list[list[int]] = [[-1, 0]]  # (mode of the string around this code, open braces)
    at, line, begun, fresh, doc, tags = 0, 1, 0, True, "", []
    if language == "php":
        at = m.end() if (m := re.search(r"<\?(?:php\b|=)", source)) else len(source)
        line = 1 + source.count("\n", 0, at)

    def put(kind: str, text: str, end: int) -> None:
        nonlocal fresh, doc
        out.append(Token(kind, text, at, end, line, fresh, at - begun, doc))
        fresh, doc = False, ""

    def through(end: int) -> None:
        nonlocal at, line, begun
        if n := source.count("\n", at, end):
            line, begun = line + n, source.rindex("\n", at, end) + 1
        at = end

    def string(mode: int) -> None:
        """Go on in a string, to its end or to code in it."""
        while m := inner[mode].search(source, at):
            through(m.end())
            if m["end"] is not None:
                return
            if m["code"] is not None:
                out.append(Token("p", "(", at - 1, at, line, False, at - begun, ""))
                stack.append([mode, 0])
                return
        through(len(source))

    match, regexes, ruby, size = master.match, lexicon.regexes, language == "ruby", len(source)
    while at < size:
        m = match(source, at)
        kind = m.lastgroup
        if kind == "space":
            at = m.end()
        elif kind == "name":
            out.append(Token("n", m[0], at, m.end(), line, fresh, at - begun, doc))
            at, fresh, doc = m.end(), False, ""
        elif kind == "p":
            text = m[0]
            if regexes and text[0] == "/" and (not out or out[-1].kind == "p" and out[-1].text not in ")]}" or out[-1].kind == "n" and out[-1].text in _VALUE_WORDS) and (r := _REGEX.match(source, at)):
                put("v", r[0], r.end())
                through(r.end())
                continue
            if ruby and (t := _TAGGED.match(source, at)):
                tags.append(re.escape(t[2]))
                put("v", t[0], t.end())
                at = t.end()
                continue
            if text == "{":
                stack[-1][1] += 1
            elif text == "}" and len(stack) > 1 and not stack[-1][1]:
                put("p", ")", m.end())
                at = m.end()
                string(stack.pop()[0])
                continue
            elif text == "}":
                stack[-1][1] -= 1
            out.append(Token("p", text, at, m.end(), line, fresh, at - begun, doc))
            at, fresh, doc = m.end(), False, ""
        elif kind == "newline":
            line, at = line + 1, m.end()
            begun, fresh = at, True
            while tags:
                t = re.compile(rf"^[ \t]*{tags.pop(0)}\b[^\n]*", re.M).search(source, at)
                through(t.end() if t else size)
        elif kind == "comment":
            end = _comment_end(source, at) if lexicon.nested and m[0].startswith("/*") else m.end()
            said = source[at:end]
            through(end)
            doc = said
        elif kind == "ignored":
            through(m.end())
            doc = ""
        elif kind[0] == "m":
            put("v", m[0], m.end())
            through(m.end())
            string(int(kind[1:]))
        else:
            put("v", m[0], m.end())
            through(m.end())
    return out


def mates(ts: list[Token]) -> list[int]:
    """For each bracket the place of its partner; for one without, the number of tokens (opening) or -1 (closing)."""
    out, open_ = [-1] * len(ts), []
    pairs = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(ts):
        if t.kind != "p":
            continue
        if t.text in "([{" and len(t.text) == 1:
            open_.append(i)
            out[i] = len(ts)
        elif t.text in pairs:
            for k in range(len(open_) - 1, -1, -1):  # an opening bracket left alone ends where one around it ends
                if ts[open_[k]].text == pairs[t.text]:
                    for stray in open_[k + 1 :]:
                        out[stray] = i
                    out[open_[k]], out[i] = i, open_[k]
                    del open_[k:]
                    break
    return out
