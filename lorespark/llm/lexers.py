"""Tokens of the supported languages. What no token can begin with, and what has no end, is the terminal ERROR."""

from __future__ import annotations

import re
from functools import lru_cache

from lorespark.llm.gll import Token


@lru_cache(maxsize=4096)
def _kinds(*names: str) -> frozenset[str]:
    return frozenset(names)


ERROR = _kinds("ERROR")


class _Out(list):
    """Tokens of a text in order, with line numbers."""

    def __init__(self, text: str):
        super().__init__()
        self.text, self.line, self.seen = text, 1, 0

    def put(self, at: int, *names: str, broken: bool = False, glued: bool = False) -> None:
        self.line += self.text.count("\n", self.seen, at)
        self.seen = max(self.seen, at)
        self.append(Token(_kinds(*names), self.line, broken, glued))


# JSON

_JSON = re.compile(r'[ \t\r\n]+|([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.])|(true|false|null)\b')


def json_tokens(text: str) -> list[Token]:
    out, at = _Out(text), 0
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            out.put(at, "ERROR")
            break
        if m.lastindex:
            out.put(at, {1: m.group(), 2: "STRING", 3: "NUMBER", 4: "WORD"}[m.lastindex])
        at = m.end()
    return out


# TOML

_TOML_STRING = r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"' + r"|'[^'\x00-\x08\x0a-\x1f\x7f]*'"
_TOML_LONG = r'"""(?:[^"\\]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n)|"{1,2}(?!"))*"{3,5}' + r"|'''(?:[^']|'{1,2}(?!'))*'{3,5}"
_DATE, _TIME = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])", r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?"
_TOML_VALUE = re.compile(
    rf"(?:{_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|{_TIME}|true|false"
    r"|[+-]?(?:inf|nan)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w.:+-])"
)
_TOML_KEY = re.compile(rf"([A-Za-z0-9_-]+)|({_TOML_STRING})")
_TOML_TEXT = re.compile(rf"{_TOML_LONG}|(?!\"\"\"|''')(?:{_TOML_STRING})")
_TOML_SKIP = re.compile(r"[ \t]+|#[^\x00-\x08\x0a-\x1f\x7f]*")


def toml_tokens(text: str) -> list[Token]:
    """Whether a word is a key or a value depends on the brackets around it, so the lexer keeps them."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    out, at, value, inside = _Out(text), 0, False, []
    while at < len(text):
        if m := _TOML_SKIP.match(text, at):
            at = m.end()
            continue
        c = text[at]
        in_array = bool(inside) and inside[-1] == "["
        if c == "\n":
            if not in_array:
                out.put(at, "NEWLINE")
                value = value and bool(inside)
            at += 1
        elif (value or in_array) and (m := _TOML_TEXT.match(text, at) or _TOML_VALUE.match(text, at)):
            out.put(at, "VALUE")
            at, value = m.end(), False
        elif not value and not in_array and not inside and c == "[" and (not out or "NEWLINE" in out[-1].kinds):
            double = text.startswith("[[", at)
            out.put(at, "[[" if double else "TABLE[")
            at += 1 + double
        elif not inside and not value and c == "]":
            double = text.startswith("]]", at)
            out.put(at, "]]" if double else "TABLE]")
            at += 1 + double
        elif c in "[{" and (value or in_array):
            inside.append(c)
            out.put(at, c)
            at, value = at + 1, False
        elif c in "]}" and inside:
            inside.pop()
            out.put(at, c)
            at, value = at + 1, False
        elif c == ",":
            out.put(at, c)
            at, value = at + 1, False
        elif c == "=":
            out.put(at, c)
            at, value = at + 1, True
        elif c == ".":
            out.put(at, c)
            at += 1
        elif not value and not in_array and (m := _TOML_KEY.match(text, at)):
            out.put(at, "KEY")
            at = m.end()
        else:
            out.put(at, "ERROR")
            break
    return out


# Python

_PY_RESERVED = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY_SOFT = frozenset("match case type _".split())
_PY_NUMBER = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)")
_PY_OP = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|<<|>>|\*\*|//|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=]")
_PY_STRING = re.compile(r"([rR]?[bBfF]|[bBfF]?[rR]|[uU])?('''|\"\"\"|'|\")")


def _python_string(text: str, at: int, m: re.Match) -> int:
    """The end of a string, or -1. Fields of formatted strings nest, and may hold strings of their own."""
    prefix, quote = (m.group(1) or "").lower(), m.group(2)
    i, n, formatted = m.end(), len(text), "f" in prefix
    while i < n:
        if text.startswith(quote, i):
            return i + len(quote)
        c = text[i]
        if c == "\\" and not (formatted and text[i + 1 : i + 2] in "{}"):
            i += 2
        elif c == "\n" and len(quote) == 1:
            return -1
        elif formatted and c == "{":
            if text.startswith("{{", i):
                i += 2
                continue
            depth, i = 1, i + 1
            while i < n and depth:
                c = text[i]
                if c == "\n" and len(quote) == 1:
                    return -1
                if c in "'\"" and (inner := _PY_STRING.match(text, i)):
                    if text.startswith(quote, i) and len(quote) == 3:
                        return -1
                    i = _python_string(text, i, inner)
                    if i < 0:
                        return -1
                    continue
                depth += (c in "{[(") - (c in "}])")
                i += 1
            if depth:
                return -1
        elif formatted and c == "}":
            if not text.startswith("}}", i):
                return -1
            i += 2
        else:
            i += 1
    return -1


def python_tokens(text: str) -> list[Token]:
    """With NEWLINE, INDENT and DEDENT; inside brackets line breaks are blanks."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        return [Token(ERROR, 1)]
    out, at, n, depth, indents, fresh = _Out(text), 0, len(text), [], [(0, 0)], True
    while at < n:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            blank, at = m.group(), m.end()
            if at < n and text[at] in "\n#" or text.startswith("\\\n", at):
                if text.startswith("\\\n", at):
                    at += 2
                    fresh = False
                    continue
                end = text.find("\n", at)
                at = n if end < 0 else end + 1
                continue
            if at >= n:
                break
            wide = 0, 0
            for c in blank:  # with tabs of 8 and of 1; both must agree
                wide = (0, 0) if c == "\f" else ((wide[0] // 8 + 1) * 8, wide[1] + 1) if c == "\t" else (wide[0] + 1, wide[1] + 1)
            if (wide[0] > indents[-1][0]) != (wide[1] > indents[-1][1]) or (wide[0] == indents[-1][0]) != (wide[1] == indents[-1][1]):
                out.put(at, "ERROR")
                break
            if wide > indents[-1]:
                indents.append(wide)
                out.put(at, "INDENT")
            while wide < indents[-1]:
                indents.pop()
                out.put(at, "DEDENT")
            if wide != indents[-1]:
                out.put(at, "ERROR")
                break
            fresh = False
        c = text[at]
        if c in " \t\f":
            at += 1
        elif c == "\n":
            if not depth:
                out.put(at, "NEWLINE")
                fresh = True
            at += 1
        elif c == "#":
            end = text.find("\n", at)
            at = n if end < 0 else end
        elif text.startswith("\\\n", at):
            at += 2
        elif m := _PY_STRING.match(text, at):
            end = _python_string(text, at, m)
            if end < 0:
                out.put(at, "ERROR")
                break
            out.put(at, "STRING")
            at = end
        elif (c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit()) and (m := _PY_NUMBER.match(text, at)):
            word = m.group()
            if text[m.end() : m.end() + 1].isidentifier() and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(text, m.end()) or re.fullmatch(r"0[_0]*[1-9][0-9_]*", word):
                out.put(at, "ERROR")
                break
            out.put(at, "NUMBER")
            at = m.end()
        elif c == "_" or c.isidentifier():
            end = at + 1
            while end < n and ("a" + text[end]).isidentifier():
                end += 1
            word = text[at:end]
            out.put(at, *((word,) if word in _PY_RESERVED else (word, "NAME") if word in _PY_SOFT else ("NAME",)))
            at = end
        elif m := _PY_OP.match(text, at):
            if c in "([{":
                depth.append(c)
            elif c in ")]}":
                if not depth or depth.pop() + c not in ("()", "[]", "{}"):
                    out.put(at, "ERROR")
                    break
            out.put(at, m.group())
            at = m.end()
        else:
            out.put(at, "ERROR")
            break
    else:
        if depth:
            out.put(n, "ERROR")
    if out and not fresh and "ERROR" not in out[-1].kinds:
        out.put(n, "NEWLINE")
    for _ in indents[1:]:
        out.put(n, "DEDENT")
    return out


# Languages with braces

_LINE_COMMENT, _BLOCK_COMMENT = re.compile(r"//[^\n\r\u2028\u2029]*"), re.compile(r"/\*.*?\*/", re.S)
_JS_RESERVED = frozenset("await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield".split())
_JS_CONTEXTUAL = frozenset(
    "as async from get of set static let type interface namespace module declare abstract public private protected readonly keyof infer is asserts unique satisfies implements override out accessor any unknown never void string number boolean symbol object bigint undefined require global constructor using target meta".split()
)
_JS_OP = re.compile(r"\.\.\.|=>|===|!==|==|!=|<=|<<=|<<|\*\*=|\*\*|\+\+|--|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?![0-9])|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>?:;,.=(){}\[\]@]")
_JS_NUMBER = re.compile(r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:0|[1-9](?:_?[0-9])*)n|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?")
_JS_STRING = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)")
_JS_NAME = re.compile(r"[#]?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_BEFORE_REGEX = frozenset("( [ { , ; : ? = == === != !== < > <= + - * / % ** & | ^ ! ~ && || ?? => += -= *= /= %= <<= &= |= ^= ... return typeof case in of delete void throw new else do instanceof yield await `${".split()) | {"${"}


def script_tokens(text: str) -> list[Token]:
    """ECMAScript and TypeScript. ``>`` is always a token of its own; templates come in parts around their fields."""
    text = text.removeprefix("\ufeff")
    out, at, n, broken, braces, last = _Out(text), 0, len(text), False, [], ""
    if text.startswith("#!"):
        at = (text + "\n").index("\n")

    def template(i: int) -> tuple[int, str]:
        while i < n:
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1, "TEMPLATE_END"
            elif text.startswith("${", i):
                return i + 2, "${"
            else:
                i += 1
        return -1, "ERROR"

    gap = True
    while at < n:
        c = text[at]
        if c.isspace() or c == "\ufeff":
            broken, gap = broken or c in "\n\r\u2028\u2029", True
            at += 1
            continue
        if m := _LINE_COMMENT.match(text, at):
            at, gap = m.end(), True
            continue
        if text.startswith("/*", at):
            m = _BLOCK_COMMENT.match(text, at)
            if not m:
                out.put(at, "ERROR")
                break
            broken, gap, at = broken or "\n" in m.group(), True, m.end()
            continue
        names: tuple[str, ...] = ()
        if c == "`" or c == "}" and braces and braces[-1] == "$":
            if c == "}":
                braces.pop()
            out.put(at, "TEMPLATE" if c == "`" else "}$", broken=broken, glued=not gap)
            broken, gap = False, False
            at, last = template(at + 1)
            out.put(min(max(at, 0), n), last)
            if at < 0:
                break
            if last == "${":
                braces.append("$")
            continue
        if c in "'\"" and (m := _JS_STRING.match(text, at)):
            names = ("STRING",)
        elif c == "/" and (not last or last in _BEFORE_REGEX) and (m := _JS_REGEX.match(text, at)):
            flags = m.group(1)
            names = ("REGEX",) if len(set(flags)) == len(flags) and set(flags) <= set("dgimsuvy") else ("ERROR",)
        elif (c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit()) and (m := _JS_NUMBER.match(text, at)):
            names = ("ERROR",) if _JS_NAME.match(text, m.end()) or text[m.end() : m.end() + 1].isdigit() else ("NUMBER",)
        elif m := _JS_NAME.match(text, at):
            w = m.group()
            names = ("PRIVATE",) if w[0] == "#" else (w, "KEYWORD") if w in _JS_RESERVED else (w, "NAME") if w in _JS_CONTEXTUAL else ("NAME",)
        elif m := _JS_OP.match(text, at):
            names = (m.group(),)
            if c == "{":
                braces.append(c)
            elif c == "}" and braces:
                braces.pop()
        else:
            names, m = ("ERROR",), None
        out.put(at, *names, broken=broken, glued=not gap)
        if m is None or names == ("ERROR",):
            break
        last, broken, gap, at = names[0], False, False, m.end()
    return out


_GO_RESERVED = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_OP = re.compile(r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~]")
_GO_ESCAPE = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_GO_LITERAL = re.compile(rf"(\"(?:[^\"\\\n]|{_GO_ESCAPE})*\"|`[^`]*`)|('(?:[^'\\\n]|{_GO_ESCAPE})')|(0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?i?|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?i?)")
_GO_ENDS = frozenset("NAME STRING CHAR NUMBER break continue fallthrough return ++ -- ) ] }".split())


def go_tokens(text: str) -> list[Token]:
    """With the semicolons that line ends stand for."""
    text = text.removeprefix("\ufeff")
    out, at, n = _Out(text), 0, len(text)
    name = re.compile(r"[^\W\d]\w*")

    def line_end(i: int) -> None:
        if out and out[-1].kinds & _GO_ENDS:
            out.put(i, ";")

    while at < n:
        c = text[at]
        if c == "\n":
            line_end(at)
            at += 1
        elif c in " \t\r":
            at += 1
        elif m := _LINE_COMMENT.match(text, at):
            at = m.end()
        elif text.startswith("/*", at):
            m = _BLOCK_COMMENT.match(text, at)
            if not m:
                out.put(at, "ERROR")
                break
            if "\n" in m.group():
                line_end(at)
            at = m.end()
        elif m := _GO_LITERAL.match(text, at):
            out.put(at, ("STRING", "CHAR", "NUMBER")[m.lastindex - 1])
            at = m.end()
        elif m := name.match(text, at):
            out.put(at, m.group() if m.group() in _GO_RESERVED else "NAME")
            at = m.end()
        elif m := _GO_OP.match(text, at):
            out.put(at, m.group())
            at = m.end()
        else:
            out.put(at, "ERROR")
            break
    line_end(n)
    return out


_JAVA_RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
_JAVA_CONTEXTUAL = frozenset("var record sealed permits non yield module open opens requires exports provides uses to with transitive when".split())
_JAVA_OP = re.compile(r"\.\.\.|->|::|<<=|<<|\+\+|--|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>?:;,.=(){}\[\]@]")
_JAVA_ESCAPE = r"\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})"
_JAVA_LITERAL = re.compile(
    rf"(\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|\\(?:\r?\n)|{_JAVA_ESCAPE}|\"{{1,2}}(?!\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\n\r]|{_JAVA_ESCAPE})*\"|\"\"(?!\"))|('(?:[^'\\\n\r]|{_JAVA_ESCAPE})')"
    r"|(0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|(?:\d(?:_*\d)*(?:\.(?:\d(?:_*\d)*)?)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d(?:_*\d)*)?[lLfFdD]?)"
)


def java_tokens(text: str) -> list[Token]:
    text = text.removeprefix("\ufeff")
    out, at, n, name, gap = _Out(text), 0, len(text), re.compile(r"(?:[^\W\d]|\$)[\w$]*"), True
    while at < n:
        c = text[at]
        if c in " \t\f\r\n\x1a":
            at, gap = at + 1, True
            continue
        if m := _LINE_COMMENT.match(text, at):
            at, gap = m.end(), True
            continue
        if text.startswith("/*", at):
            m = _BLOCK_COMMENT.match(text, at)
            if not m:
                out.put(at, "ERROR")
                break
            at, gap = m.end(), True
            continue
        if m := _JAVA_LITERAL.match(text, at):
            names: tuple[str, ...] = (("STRING", "CHAR", "NUMBER")[m.lastindex - 1],)
            if m.lastindex == 3 and name.match(text, m.end()):
                names = ("ERROR",)
        elif m := name.match(text, at):
            w = m.group()
            names = (w,) if w in _JAVA_RESERVED else (w, "NAME") if w in _JAVA_CONTEXTUAL else ("NAME",)
        elif m := _JAVA_OP.match(text, at):
            names = (m.group(),)
        else:
            names, m = ("ERROR",), None
        out.put(at, *names, glued=not gap)
        if m is None or names == ("ERROR",):
            break
        at, gap = m.end(), False
    return out


# Shell

_SH_RESERVED = frozenset("if then else elif fi do done case esac while until for select function time coproc { } !".split())
_SH_OP = re.compile(r"&>>|<<<|;;&|&&|\|\||\|&|;;|;&|>>|<&|>&|<>|>\||&>|[;&|<>()]")
_SH_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")
_SH_OPENERS = _SH_RESERVED - {"}", "fi", "done", "esac", "case", "for", "select", "function", "coproc"} | {";", "&", "&&", "||", "|", "|&", "(", ")", "NEWLINE", ";;", ";&", ";;&"}


class _Shell:
    """Words, operators and here-documents; command substitutions are lexed on their own and kept in ``inner``."""

    def __init__(self, text: str):
        self.text, self.inner = text, []

    def double(self, i: int) -> int:
        """The end of a double-quoted part that begins before i, or -1."""
        text, n = self.text, len(self.text)
        while i < n:
            c = text[i]
            if c == '"':
                return i + 1
            if c == "\\":
                i += 2
            elif c in "$`":
                i = self.expansion(i)
                if i < 0:
                    return -1
            else:
                i += 1
        return -1

    def expansion(self, i: int) -> int:
        """The end of what ``$`` or a backquote at i begins, or -1."""
        text, n = self.text, len(self.text)
        if text[i] == "`":
            j = i + 1
            while j < n and text[j] != "`":
                j += 2 if text[j] == "\\" else 1
            if j >= n:
                return -1
            sub = _Shell(re.sub(r"\\([`\\$])", r"\1", text[i + 1 : j]))
            self.inner += [sub.tokens(), *sub.inner]
            return j + 1
        if text.startswith("$((", i) and (j := self.arithmetic(i + 3)) >= 0:
            return j
        if text.startswith("$(", i):
            return self.command(i + 2)
        if text.startswith("${", i):
            j, depth = i + 2, 1
            while j < n:
                c = text[j]
                if c == "\\":
                    j += 2
                elif c == "}":
                    j += 1
                    if not (depth := depth - 1):
                        return j
                elif c == '"':
                    j = self.double(j + 1)
                elif c == "'":
                    k = text.find("'", j + 1)
                    j = k + 1 if k >= 0 else -1
                elif c in "$`":
                    j = self.expansion(j)
                else:
                    j += 1
                if j < 0:
                    return -1
            return -1
        return i + 1

    def command(self, i: int) -> int:
        """The end of a command substitution whose text begins at i."""
        sub = _Shell(self.text)
        tokens = sub.tokens(i, nested=True)
        self.inner += [tokens, *sub.inner]
        return sub.end

    def arithmetic(self, i: int) -> int:
        """The place after the ``))`` that ends the arithmetic text at i, or -1."""
        text, n, depth = self.text, len(self.text), 0
        while i < n:
            c = text[i]
            if c == "(":
                depth += 1
            elif c == ")":
                if not depth:
                    return i + 2 if text.startswith("))", i) else -1
                depth -= 1
            elif c in "\n;" and c == "\n" and text[i - 1] == "\n":
                return -1
            i += 1
        return -1

    def word(self, i: int) -> tuple[int, bool]:
        """The end of the word at i, or -1, and whether it is plain, without quotes or expansions."""
        text, n, plain = self.text, len(self.text), True
        while i < n:
            c = text[i]
            if c in " \t\n;&|<>()":
                if c in "<>" and text.startswith("(", i + 1):
                    i, plain = self.command(i + 2), False
                    if i < 0:
                        return -1, False
                    continue
                break
            if c == "\\":
                i, plain = i + 2, False
            elif c == "'":
                j = text.find("'", i + 1)
                if j < 0:
                    return -1, False
                i, plain = j + 1, False
            elif c == '"' or text.startswith('$"', i):
                i, plain = self.double(i + (1 if c == '"' else 2)), False
            elif text.startswith("$'", i):
                j = i + 2
                while j < n and text[j] != "'":
                    j += 2 if text[j] == "\\" else 1
                i, plain = (j + 1 if j < n else -1), False
            elif c in "$`":
                i, plain = self.expansion(i), False
            else:
                i += 1
            if i < 0:
                return -1, False
        return min(i, n), plain

    def tokens(self, at: int = 0, nested: bool = False) -> list[Token]:
        text, n, out, depth, pending, cases = self.text, len(self.text), _Out(self.text), 0, [], 0
        self.end = -1
        while at < n:
            c = text[at]
            if c in " \t":
                at += 1
                continue
            if text.startswith("\\\n", at):
                at += 2
                continue
            if c == "#":
                end = text.find("\n", at)
                at = n if end < 0 else end
                continue
            if c == "\n":
                out.put(at, "NEWLINE")
                at += 1
                for tabs, mark in pending:
                    while at < n:
                        end = text.find("\n", at)
                        end = n if end < 0 else end
                        line, at = text[at:end], end + 1
                        if (line.lstrip("\t") if tabs else line) == mark:
                            break
                pending = []
                continue
            last = out[-1].kinds if out else None
            first = last is None or bool(last & _SH_OPENERS) and "WORD" not in last or bool(last & _SH_RESERVED & _SH_OPENERS)
            if first and text.startswith("((", at) and (end := self.arithmetic(at + 2)) >= 0 or last is not None and "for" in last and text.startswith("((", at) and (end := self.arithmetic(at + 2)) >= 0:
                out.put(at, "ARITHMETIC")
                at = end
                continue
            if first and re.compile(r"\[\[[ \t\n]").match(text, at):
                i, words = at + 2, 0
                while i < n and not re.compile(r"\]\](?![^\s;&|)<>])").match(text, i):
                    if text[i] in " \t\n()<>&|;":
                        i += 1
                        continue
                    i, _ = self.word(i)
                    words += 1
                    if i < 0:
                        break
                if i < 0 or i >= n or not words:
                    out.put(at, "ERROR")
                    return out
                out.put(at, "TEST")
                at = i + 2
                continue
            m = re.compile(r"(\d*)<<(-?)(?!<)[ \t]*").match(text, at)
            if m and m.end() < n:
                end, _ = self.word(m.end())
                if end <= m.end():
                    out.put(at, "ERROR")
                    return out
                pending.append((m.group(2) == "-", re.sub(r"['\"\\]", "", text[m.end() : end])))
                out.put(at, "HEREDOC")
                at = end
                continue
            if (m := re.compile(r"(\d+)(?=[<>])").match(text, at)) and not text.startswith(("<(", ">("), m.end()):
                out.put(at, "IO_NUMBER")
                at = m.end()
                continue
            if not (c in "<>" and text.startswith("(", at + 1)) and (m := _SH_OP.match(text, at)):
                op = m.group()
                if nested and op == ")" and not depth and not cases:
                    self.end = at + 1
                    return out
                depth += (op == "(") - (op == ")" and depth > 0)
                out.put(at, op)
                at = m.end()
                continue
            if m := _SH_ASSIGN.match(text, at):
                if text.startswith("(", m.end()):
                    out.put(at, "ARRAY")
                    at = m.end()
                    continue
                end, _ = self.word(m.end())
                if end < 0:
                    out.put(at, "ERROR")
                    return out
                out.put(at, "ASSIGNMENT")
                at = end
                continue
            end, plain = self.word(at)
            if end < 0:
                out.put(at, "ERROR")
                return out
            w = text[at:end]
            if plain and w in _SH_RESERVED:
                cases += first and w == "case"
                cases -= first and w == "esac" and cases > 0
                out.put(at, w, "WORD", *(() if w == "esac" else ("CASEWORD",)))
            else:
                out.put(at, "WORD", "COMMAND", "CASEWORD", *(("in",) if plain and w == "in" else ()))
            at = end
        return out


def shell_tokens(text: str) -> list[Token]:
    """Of the text; a command substitution that doesn't parse is an ERROR at its end (see ``shell_parts``)."""
    return shell_parts(text)[0]


def shell_parts(text: str) -> list[list[Token]]:
    """Tokens of the text and of every command substitution in it."""
    shell = _Shell(text)
    return [shell.tokens(), *shell.inner]


# YAML

_YAML_PLAIN_FIRST = frozenset("-?:,[]{}#&*!|>'\"%@`")
_YAML_HEAD = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:(?<=[ \t])#[^\n]*)?(?=\n|\Z)")
_YAML_DOUBLE = re.compile(r'"(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
_YAML_SINGLE = re.compile(r"'(?:[^']|'')*'")
_YAML_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f￾￿]")


class _Yaml:
    """Block structure from columns. A key is only known by the colon after it, so its place is kept until then."""

    def __init__(self, text: str):
        self.text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        self.out: list[Token] = []
        self.indent, self.indents, self.flow, self.may_key, self.keys = -1, [], 0, True, {}
        self.line, self.start = 1, 0

    def put(self, *names: str) -> None:
        self.out.append(Token(_kinds(*names), self.line))

    def unroll(self, column: int) -> None:
        while not self.flow and self.indent > column:
            self.indent = self.indents.pop()
            self.put("BLOCKEND")

    def roll(self, column: int) -> bool:
        if self.indent < column:
            self.indents.append(self.indent)
            self.indent = column
            return True
        return False

    def drop_key(self) -> bool:
        """Forgets the possible key of this level; false if it had to be one."""
        key = self.keys.pop(self.flow, None)
        return not (key and key[1])

    def save_key(self, at: int) -> bool:
        if self.may_key:
            if not self.drop_key():
                return False
            self.keys[self.flow] = (len(self.out), not self.flow and self.indent == at - self.start, self.line, at)
        return True

    def advance(self, a: int, b: int) -> None:
        """Counts the lines of a token that spans several."""
        n = self.text.count("\n", a, b)
        if n:
            self.line += n
            self.start = self.text.rfind("\n", a, b) + 1

    def tokens(self) -> list[Token]:
        text, n, at, fresh = self.text, len(self.text), 0, True
        if _YAML_BAD.search(text):
            return [Token(ERROR, 1)]
        while True:
            while at < n:  # to the next token
                c = text[at]
                if c == " " or c == "\t" and (self.flow or not fresh):
                    at += 1
                elif c == "\t":
                    m = re.compile(r"[ \t]*(?=\n|#|\Z)").match(text, at)
                    if not m:
                        self.put("ERROR")
                        return self.out
                    at = m.end()
                elif c == "#" and (at == self.start or text[at - 1] in " \t"):
                    end = text.find("\n", at)
                    at = n if end < 0 else end
                elif c == "\n":
                    at, self.line, self.start, fresh = at + 1, self.line + 1, at + 1, True
                    if not self.flow:
                        self.may_key = True
                else:
                    break
            fresh = False
            for level, key in list(self.keys.items()):
                if key[2] != self.line or at - key[3] > 1024:
                    if key[1]:
                        self.put("ERROR")
                        return self.out
                    del self.keys[level]
            if at >= n:
                if self.flow or not self.drop_key():
                    self.put("ERROR")
                self.unroll(-1)
                return self.out
            column = at - self.start
            self.unroll(column)
            c, after = text[at], text[at + 1 : at + 2]
            blank = not after or after in " \t\n"
            if column == 0 and text.startswith(("---", "..."), at) and (at + 3 >= n or text[at + 3] in " \t\n"):
                if self.flow or not self.drop_key():
                    self.put("ERROR")
                    return self.out
                self.unroll(-1)
                self.put("DOCSTART" if c == "-" else "DOCEND")
                at, self.may_key = at + 3, False
            elif column == 0 and c == "%" and not self.flow and (not self.out or "DOCEND" in self.out[-1].kinds or "DIRECTIVE" in self.out[-1].kinds):
                self.put("DIRECTIVE")
                end = text.find("\n", at)
                at = n if end < 0 else end
            elif c in "[{":
                if not self.save_key(at):
                    self.put("ERROR")
                    return self.out
                self.flow += 1
                self.may_key = True
                self.put(c)
                at += 1
            elif c in "]}":
                if not self.flow:
                    self.put("ERROR")
                    return self.out
                self.drop_key()
                self.flow -= 1
                self.may_key = False
                self.put(c)
                at += 1
            elif c == "," and self.flow:
                self.drop_key()
                self.may_key = True
                self.put(c)
                at += 1
            elif c == "-" and blank:
                if self.flow or not self.may_key:
                    self.put("ERROR")
                    return self.out
                if self.roll(column):
                    self.put("SEQSTART")
                self.drop_key()
                self.put("ENTRY")
                at += 1
            elif c == "?" and (blank or self.flow and after in ",[]{}"):
                if not self.flow:
                    if not self.may_key:
                        self.put("ERROR")
                        return self.out
                    if self.roll(column):
                        self.put("MAPSTART")
                self.may_key = not self.flow
                self.drop_key()
                self.put("KEY")
                at += 1
            elif c == ":" and (blank or self.flow and (after in ",[]{}" or self.out and at and text[at - 1] in "\"']}")):
                key = self.keys.pop(self.flow, None)
                if key:
                    place, _, line, where = key
                    self.out.insert(place, Token(_kinds("KEY"), line))
                    if not self.flow and self.roll(where - self.start):
                        self.out.insert(place, Token(_kinds("MAPSTART"), line))
                    self.may_key = False
                else:
                    if not self.flow:
                        if not self.may_key:
                            self.put("ERROR")
                            return self.out
                        if self.roll(column):
                            self.put("MAPSTART")
                    self.may_key = not self.flow
                self.put("VALUE")
                at += 1
            elif c in "*&":
                m = re.compile(r"[^\s,\[\]{}]+").match(text, at + 1)
                if not m or not self.save_key(at):
                    self.put("ERROR")
                    return self.out
                self.may_key = False
                self.put("ALIAS" if c == "*" else "ANCHOR")
                at = m.end()
            elif c == "!":
                m = re.compile(r"!(?:<[^>\s]+>|[^\s,\[\]{}]*)(?=[\s,\]}]|\Z)").match(text, at)
                if not m or not self.save_key(at):
                    self.put("ERROR")
                    return self.out
                self.may_key = False
                self.put("TAG")
                at = m.end()
            elif c in "|>" and not self.flow:
                m = _YAML_HEAD.match(text, at)
                if not m or not self.drop_key():
                    self.put("ERROR")
                    return self.out
                self.put("SCALAR")
                at, self.may_key = self.block_scalar(at, m), True
                fresh = True
            elif c in "\"'":
                m = (_YAML_DOUBLE if c == '"' else _YAML_SINGLE).match(text, at)
                lines = m and m.group().split("\n")[1:]
                if not m or not self.save_key(at) or any(x.strip() and (len(x) - len(x.lstrip(" ")) < self.indent + 1 or x.startswith(("--- ", "... "))) for x in lines):
                    self.put("ERROR")
                    return self.out
                self.put("SCALAR")
                self.may_key = False
                self.advance(at, m.end())
                at = m.end()
            elif c not in _YAML_PLAIN_FIRST or c in "-?:" and not blank and not (self.flow and after in ",[]{}"):
                if not self.save_key(at):
                    self.put("ERROR")
                    return self.out
                self.put("SCALAR")
                at, fresh = self.plain(at)
            else:
                self.put("ERROR")
                return self.out

    def block_scalar(self, at: int, head: re.Match) -> int:
        """The place after the lines of a block scalar."""
        text, n = self.text, len(self.text)
        given = re.search(r"[1-9]", head.group().split("#")[0])
        least = max(1, self.indent + 1)
        wide = max(self.indent, 0) + int(given.group()) if given else 0
        i = head.end()
        while i < n:
            end = text.find("\n", i + 1)
            end = n if end < 0 else end
            row = text[i + 1 : end]
            blanks = len(row) - len(row.lstrip(" "))
            if row.strip(" "):
                if not wide:
                    wide = max(least, blanks)
                if blanks < wide:
                    break
            i = end
        self.line += text.count("\n", at, min(i + 1, n))
        self.start = min(i + 1, n)
        return self.start

    def plain(self, at: int) -> tuple[int, bool]:
        """The place after a plain scalar, and whether that is the begin of a line."""
        text, n = self.text, len(self.text)
        stop = re.compile(r"(?:(?![,\[\]{}])(?:[^\s:#]|:(?![\s,\[\]{}]|\Z)|(?<=\S)#)|[ \t]+(?![\s#]|\Z)(?!:(?:[\s,\[\]{}]|\Z)))+" if self.flow else r"(?:[^\s:#]|:(?!\s|\Z)|(?<=\S)#|[ \t]+(?![\s#]|\Z)(?!:(?:\s|\Z)))+")
        while True:
            m = stop.match(text, at)
            if not m:
                return at, False
            at = m.end()
            self.may_key = False
            gap = re.compile(r"[ \t]*\n(?:[ \t]*\n)*").match(text, at)
            if not gap:
                return at, False
            start = gap.end()
            blanks = re.compile(" *").match(text, start).end() - start
            inner = re.compile(r"[ \t]*").match(text, start).end()
            ends = inner >= n or text[inner] == "#" or not self.flow and blanks < self.indent + 1 or blanks == 0 and text.startswith(("---", "..."), start) and (start + 3 >= n or text[start + 3] in " \t\n")
            if ends or not stop.match(text, inner):
                return at, False
            self.advance(at, inner)
            self.start = start
            at = inner


def yaml_tokens(text: str) -> list[Token]:
    return _Yaml(text).tokens()
