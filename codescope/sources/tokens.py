"""Tokens of sources in languages that have no parser here."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Signs that belong together, the longest first.
SIGNS = (
    ">>>= <<= >>= **= ... ..= <=> === !== >>> &&= ||= ??= :: => -> <- ++ -- && || ?? ?. == != <= >= << >> += -= *= /= %= &= |= ^= := ** .. //"
).split()
CURLY = ("javascript", "typescript", "go", "java", "c_sharp", "c", "cpp", "rust")
ENDED = ("ruby", "julia")
#: Keywords that Halstead's measures count as operators; all other names are operands.
OPERATORS = {
    "javascript": "function return if else for while do in of class import from try catch finally throw new delete typeof instanceof void switch case default break continue var let const yield await async export extends this",
    "typescript": "function return if else for while do in of class import from try catch finally throw new delete typeof instanceof void switch case default break continue var let const yield await async interface type enum as export extends this",
    "go": "func if else for switch case default return break continue go defer select range type struct interface map chan import package var const",
    "rust": "fn if else for while loop match return break continue let mut ref struct enum impl trait type use mod pub self super crate as where async await unsafe move",
    "java": "if else for while do return class interface enum extends implements import package try catch finally throw throws new instanceof switch case default break continue public private protected static final abstract synchronized volatile void super this",
    "c_sharp": "if else for foreach while do return class struct interface enum using namespace try catch finally throw new is as switch in case default break continue public private protected internal static readonly abstract virtual override sealed async await void this base var",
    "c": "if else while do for switch case default break continue return goto sizeof typedef struct union enum const volatile static extern inline register auto restrict _Alignof _Atomic",
    "cpp": "if else while do for switch case default break continue return goto sizeof typedef struct union enum const volatile static extern inline register auto class public private protected virtual override final template typename namespace using try catch throw new delete operator constexpr mutable explicit friend this",
    "ruby": "def end class module if elsif else unless while until for in case when then do return yield break next redo retry begin rescue ensure raise require require_relative load include extend prepend public private protected attr_reader attr_writer attr_accessor lambda proc super self nil true false not and or",
    "julia": "function return if else elseif end for while break continue in try catch finally throw do begin let global local module using import export struct mutable abstract primitive type const",
}
OPERATORS = {k: frozenset(v.split()) for k, v in OPERATORS.items()}
#: Signs that are no operators.
MARKS = {k: frozenset("( ) [ ] { } ; , . : @ #".split()) for k in (*CURLY, *ENDED)} | {"c": frozenset("( ) [ ] { } ; # @".split()), "cpp": frozenset("( ) [ ] { } ; # @".split()), "ruby": frozenset("( ) [ ] { } ;".split()), "julia": frozenset("( ) [ ] { } ; ,".split())}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    end: int


NUMBER = r"\d(?:(?<=[eE])[+-](?=\d)|\w|\.(?=\d))*"
QUOTED = r'"(?:\\.|[^"\\\n])*"'
SINGLE = r"'(?:\\.|[^'\\\n])*'"
SLASHED = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
#: A directive of the preprocessor with its continued lines.
DIRECTIVE = r"(?m:^[ \t]*\#(?:\\\n|[^\n])*)"
SIGN = "|".join(map(re.escape, SIGNS)) + r"|[^\w\s]"
RULES = {
    "javascript": (SLASHED, rf"{QUOTED}|{SINGLE}|`(?:\\.|[^`\\])*`", r"[#$A-Za-z_\u0080-\uffff][\w$]*"),
    "go": (SLASHED, rf"{QUOTED}|{SINGLE}|`[^`]*`", r"[^\W\d]\w*"),
    "java": (SLASHED, rf'"""(?:\\.|.)*?"""|{QUOTED}|{SINGLE}', r"[$A-Za-z_\u0080-\uffff][\w$]*"),
    "c_sharp": (f"{SLASHED}|{DIRECTIVE}", rf'"""(?:.)*?"""|\$?@\$?"(?:""|[^"])*"|\$?{QUOTED}|{SINGLE}', r"@?[^\W\d]\w*"),
    "c": (f"{SLASHED}|{DIRECTIVE}", rf"[LuU]?8?{QUOTED}|{SINGLE}", r"[^\W\d]\w*"),
    "cpp": (f"{SLASHED}|{DIRECTIVE}", rf'R"(?P<d>[^(\s]*)\(.*?\)(?P=d)"|[LuU]?8?{QUOTED}|{SINGLE}', r"[^\W\d]\w*"),
    "rust": (SLASHED, rf"b?r(?P<d>\#*)\".*?\"(?P=d)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^']+|[^'\\\n])'|'\w+", r"r?\#?[^\W\d]\w*"),
    "ruby": (r"\#[^\n]*|(?m:^=begin\b).*?(?:(?m:^=end\b)[^\n]*|\Z)", rf"<<[~-]?(?P<q>['\"]?)(?P<d>[A-Z]\w*)(?P=q).*?\n\s*(?P=d)\b|%[wWiIqQ][\[({{<].*?[\])}}>]|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", r":?[@$]{0,2}[^\W\d]\w*(?:[?!](?!=))?"),
    "julia": (r"\#=.*?(?:=\#|\Z)|\#[^\n]*", rf'\w*"""(?:\\.|.)*?"""|\w*{QUOTED}|(?<![\w)\]\x27])\x27(?:\\[^\x27]+|[^\x27\\\n])\x27', r"[^\W\d]\w*!?(?!=)|[^\W\d]\w*"),
}
RULES["typescript"] = RULES["javascript"]
PATTERNS = {lang: re.compile(f"(?P<space>\\s+|{skip})|(?P<string>{text})|(?P<number>{NUMBER})|(?P<name>{name})|(?P<sign>{SIGN})", re.S) for lang, (skip, text, name) in RULES.items()}
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Names after which a value is still to come.
AWAIT_VALUE = frozenset("return typeof case in of new delete void throw else do and or not if unless while until when then yield await".split())


def ends_value(t: Token) -> bool:
    """Whether a value ends with this token."""
    return t.kind in ("string", "number") or t.text in (")", "]", "}", "++", "--") or (t.kind == "name" and t.text not in AWAIT_VALUE)


def tokens(text: str, lang: str) -> list[Token]:
    """All tokens; white space, comments and directives of the preprocessor are left out."""
    find, out, at, line = PATTERNS[lang].match, [], 0, 1
    slashes = lang in ("javascript", "typescript", "ruby")
    while at < len(text):
        kind, m = "", None
        if slashes and text[at] == "/" and (not out or not ends_value(out[-1])):
            m, kind = REGEX.match(text, at), "string"
        if m is None:
            m = find(text, at)
            kind = m.lastgroup if m and m.lastgroup not in ("d", "q") else "string"
        if m is None:  # nothing begins here
            at += 1
            continue
        piece = m[0]
        after = line + piece.count("\n")
        if kind != "space":
            out.append(Token(kind, piece, line, after))
        at, line = m.end(), after
    return out
