"""Structure of Java, JavaScript and TypeScript: classes, methods and functions of a file.

A scan blanks comments and literals and pairs the brackets; heads are then found by keyword or by
what stands around a pair of parentheses. Time is linear in the file's length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

LANGUAGES = frozenset(("java", "javascript", "typescript"))
_LITERAL = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*+(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*+(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*+(?:`|\Z)|/", re.S)
_TEXT_BLOCK = re.compile(r"\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[(=,:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|do|else))\s*\Z")
_KEYWORDS = frozenset("if for while switch catch return else do try new throw function synchronized super this await typeof delete in of case with yield import void assert".split())
_CLASS = {"java": re.compile(r"(?<![\w.@])(?:class|interface|enum|record|@interface)\s+(\w+)"), "javascript": re.compile(r"(?<![\w.$])class\s+([\w$]+)"),
          "typescript": re.compile(r"(?<![\w.$])(?:class|interface)\s+([\w$]+)")}
_ALIAS = re.compile(r"(?<![\w.$])type\s+([\w$]+)\s*(?:<[^=;{}]*>)?\s*=(?!>)")
_FUNCTION = re.compile(r"(?<![\w.$])(?:async\s+)?function\b\s*\*?\s*([\w$]*)\s*(?=[<(])")
_NAMED = re.compile(r"([\w$#]+)\s*(?::[^=;{}()]*)?=\s*\Z|([\w$#]+)\s*:\s*\Z|[\"']\s*[\"']\s*:\s*\Z")
_SPACE = re.compile(r"\s*")
#: What may stand between the begin of a line and a head for the whole line to belong to the unit.
_LEAD = re.compile(r"[\w\s$@.<>,\[\]?*#=:&|]*\Z")
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Unit:
    """A unit runs from its head (the line's begin, if no other code is before it there) to its end."""

    kind: str  # class, method or function
    name: str
    begin: int
    end: int
    parent: int | None = None


def blanked(code: str, language: str = "") -> str:
    """The code with comments and the contents of literals as spaces; same length and lines."""
    out, at = [], 0
    for m in iter(_next_literal(code, language), None):
        out.append(code[at:m[0]])
        out.append(re.sub(r"[^\n]", " ", code[m[0]:m[1]]))
        at = m[1]
    return "".join([*out, code[at:]])


def _next_literal(code: str, language: str):
    at = 0

    def find():
        nonlocal at
        while m := _LITERAL.search(code, at):
            begin, end = m.span()
            if language == "java" and code.startswith('"""', begin):
                end = _TEXT_BLOCK.match(code, begin).end()
            elif m[0] == "/":
                m = _REGEX.match(code, begin) if language != "java" and _BEFORE_REGEX.search(code[max(0, begin - 16):begin]) else None
                if not m:
                    at = begin + 1
                    continue
                end = m.end()
            at = max(end, begin + 1)
            return begin, at
        return None
    return find


class _Scan:
    def __init__(self, code: str, language: str):
        self.flat = flat = blanked(code, language)
        self.close: dict[int, int] = {}  # opening bracket -> closing one
        self.inside: list[tuple[int, int]] = []  # (place, innermost open brace from there on)
        stack: list[int] = []
        braces: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", flat):
            c, at = m[0], m.start()
            if c in "([{":
                stack.append(at)
                if c == "{":
                    braces.append(at)
                    self.inside.append((at, at))
            elif any(flat[k] == _PAIRS[c] for k in stack[-3:]):
                while flat[stack[-1]] != _PAIRS[c]:  # an unclosed one in between
                    k = stack.pop()
                    if flat[k] == "{":
                        braces.pop()
                self.close[stack.pop()] = at
                if c == "}":
                    braces.pop()
                    self.inside.append((at, braces[-1] if braces else -1))
        self.places = [p for p, _ in self.inside]

    def skip(self, at: int) -> int:
        return _SPACE.match(self.flat, at).end()

    def brace_around(self, at: int) -> int:
        k = bisect_right(self.places, at - 1) - 1
        return self.inside[k][1] if k >= 0 else -1

    def generics(self, at: int) -> int:
        """The end of type parameters that begin there, else the same place."""
        if self.flat[at:at + 1] != "<":
            return at
        depth = 0
        for k in range(at, min(len(self.flat), at + 2000)):
            c = self.flat[k]
            if c == "<":
                depth += 1
            elif c == ">" and self.flat[k - 1] != "=":
                depth -= 1
                if not depth:
                    return k + 1
            elif c == ";":
                break
        return at

    def body(self, at: int) -> int:
        """The opening brace of a class body whose head goes on there, -1 if none."""
        flat, n = self.flat, len(self.flat)
        while at < n and flat[at] not in "{;}":
            at = self.close.get(at, at) + 1
        return at if at < n and flat[at] == "{" and at in self.close else -1

    def returns(self, at: int, language: str) -> int:
        """The place after a return type (or throws clause) that begins there."""
        flat = self.flat
        at = self.skip(at)
        if language == "java":
            m = re.compile(r"(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s@]+)?").match(flat, at)
            return m.end()
        if flat[at:at + 1] != ":":
            return at
        at = self.skip(at + 1)
        first = True
        while at < len(flat):
            c = flat[at]
            if c in ";}),=" or c == "{" and not first:
                break
            if c in "{[(":  # an object, tuple or function type
                at = self.close.get(at, at) + 1
                if flat[self.skip(at):self.skip(at) + 2] == "=>" and c == "(":
                    at = self.skip(at) + 2
            elif c == "<":
                at = max(self.generics(at), at + 1)
            else:
                at += 1
                while at < len(flat) and (flat[at].isalnum() or flat[at] in "_$."):
                    at += 1
            nxt = self.skip(at)
            first = flat[nxt:nxt + 1] in ("|", "&") or c in "|&"
            at = nxt
        return at

    def expression(self, at: int) -> int:
        """The end of an expression that begins there."""
        flat, n = self.flat, len(self.flat)
        last = ""
        while at < n:
            c = flat[at]
            if c in ",;)]}":
                return at
            if c == "\n" and last and last not in "=+-*/%&|<>?:!.~^(,":
                nxt = self.skip(at)
                if nxt >= n or flat[nxt] not in "=+*/%&|<>?:.~^(,[":
                    return at
            if not c.isspace():
                last = c
            at = self.close.get(at, at) + 1
        return n


def units(code: str, language: str) -> list[Unit]:
    """Units in order of their begin; parent: the innermost unit that holds one."""
    if language not in LANGUAGES:
        return []
    s = _Scan(code, language)
    flat = s.flat
    found: dict[tuple[int, int], Unit] = {}
    bodies: set[int] = set()  # braces whose content is members

    def add(kind: str, name: str, head: int, end: int) -> None:
        line = flat.rfind("\n", 0, head) + 1
        begin = line if _LEAD.match(flat, line, head) else head
        if begin == line and language != "java":
            m = re.search(r"=>|[^=]=[^=>].*[,=]", flat[line:head])
            begin = head if m else line
        found.setdefault((head, end), Unit(kind, name, begin, end))

    for m in _CLASS[language].finditer(flat):
        brace = s.body(m.end())
        if brace >= 0:
            bodies.add(brace)
            add("class", m[1], _annotated(flat, m.start()) if language == "java" else m.start(), s.close[brace] + 1)
    if language == "java":
        _java(s, bodies, add)
    else:
        _script(s, language, bodies, add)
    out = sorted(found.values(), key=lambda u: (u.begin, -u.end))
    stack: list[int] = []
    for i, u in enumerate(out):
        while stack and out[stack[-1]].end < u.end:
            stack.pop()
        u.parent = stack[-1] if stack else None
        stack.append(i)
    for u in out:
        if u.kind == "method" and (u.parent is None or out[u.parent].kind != "class"):
            u.kind = "function"
    return out


def _annotated(flat: str, head: int) -> int:
    """Where the annotations and modifiers before a head begin."""
    start = max(flat.rfind(c, 0, head) for c in ";}{") + 1
    m = _LEADING.match(flat, start, head)
    return m.end(1) if m else head


def _java(s: _Scan, bodies: set[int], add) -> None:
    """Methods and constructors: a name and parentheses in a class body with a type, or the name of the class, before."""
    flat = s.flat
    for m in re.finditer(r"\bnew\s+[\w.]+\s*|[{,]\s*[A-Z]\w*\s*(?=\()", flat):  # bodies of anonymous classes and enum constants
        at = s.generics(m.end())
        if flat[at:at + 1] == "(" and at in s.close:
            brace = s.skip(s.close[at] + 1)
            if flat[brace:brace + 1] == "{" and brace in s.close:
                bodies.add(brace)
    classes = {}
    for m in _CLASS["java"].finditer(flat):
        classes[s.body(m.end())] = m[1]
    for m in re.finditer(r"(?<![\w.@])(\w+)\s*\(", flat):
        brace = s.brace_around(m.start())
        if brace not in bodies or m[1] in _KEYWORDS or m.end() - 1 not in s.close:
            continue
        # The member begins after the last bracket or semicolon of the class body.
        start = max(flat.rfind(";", brace, m.start()), flat.rfind("}", brace, m.start()), brace) + 1
        lead = flat[start:m.start()]
        while a := re.search(r"@[\w.]+\s*(\()?", lead):  # annotations
            end = s.close.get(start + a.end() - 1, start + a.end() - 1) + 1 - start if a[1] else a.end()
            lead = lead[:a.start()] + " " * (min(end, len(lead)) - a.start()) + lead[min(end, len(lead)):]
        while "<" in lead and (less := re.sub(r"<[^<>()=]*>", " ", lead)) != lead:  # type arguments, inner ones first
            lead = less
        if re.search(r"[=(,<]", lead):
            continue
        types = [k for k in lead.split() if k not in _MODIFIERS]
        if not types and m[1] != classes.get(brace):
            continue
        at = s.returns(s.close[m.end() - 1] + 1, "java")
        head = start + len(flat[start:m.start()]) - len(flat[start:m.start()].lstrip())
        if flat[at:at + 1] == "{" and at in s.close:
            add("method", m[1], head, s.close[at] + 1)
        elif flat[at:at + 1] == ";" and types or re.match(r"default\b[^;{]*;", flat[at:at + 200]) and types:
            add("method", m[1], head, flat.index(";", at) + 1)


_LEADING = re.compile(r"(\s*+)(?:(?:@(?!interface\b)[\w.]+(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?|[a-z-]+)\s+)*\Z")
_MODIFIERS = frozenset("public private protected static final abstract synchronized native default strictfp transient volatile sealed".split())


def _script(s: _Scan, language: str, bodies: set[int], add) -> None:
    flat = s.flat

    def named(at: int) -> str:
        """The name that an expression which begins there is given."""
        m = _NAMED.search(flat[max(0, at - 200):at])
        return (m[1] or m[2] or "") if m else ""

    if language == "typescript":
        for m in _ALIAS.finditer(flat):
            end = s.expression(s.skip(m.end()))
            add("class", m[1], m.start(), end + (flat[end:end + 1] == ";"))
    for m in _FUNCTION.finditer(flat):
        at = s.generics(m.end())
        # TypeScript has declarations only, JavaScript expressions too.
        if language == "typescript" and not re.search(r"(?:\A|[;{}\n]|\b(?:export|default|declare))\s*\Z", flat[max(0, m.start() - 40):m.start()]):
            continue
        if flat[at:at + 1] == "(" and at in s.close:
            brace = s.returns(s.close[at] + 1, language)
            if flat[brace:brace + 1] == "{" and brace in s.close:
                add("function", m[1] or named(m.start()), m.start(), s.close[brace] + 1)
    # Arrow functions by their arrow: one name, or parentheses and perhaps a type, before it.
    opens = {c: o for o, c in s.close.items()}
    ends = [c for c in sorted(opens) if flat[c] == ")"]
    for m in re.finditer(r"=>", flat):
        body = s.skip(m.end())
        end = s.close[body] + 1 if flat[body:body + 1] == "{" and body in s.close else s.expression(body)
        one = re.search(r"(?<![\w$.])([\w$]+)\s*\Z", flat[max(0, m.start() - 80):m.start()])
        k = bisect_right(ends, m.start()) - 1
        start = None
        if k >= 0 and (not flat[ends[k] + 1:m.start()].strip() or s.returns(ends[k] + 1, language) == m.start() and flat[s.skip(ends[k] + 1)] == ":"):
            start = opens[ends[k]]
        elif one:
            start = max(0, m.start() - 80) + one.start()
        if start is None:
            continue
        lead = re.search(r"(?:\basync\s*)?(?:<[^()]*>\s*)?\Z", flat[max(0, start - 100):start])
        start -= len(lead[0])
        if language == "typescript" and _in_type(flat, start):
            continue
        add("function", named(start), start, end)
    # Methods of classes and of objects: a name, parentheses and a body, where a member may begin.
    for m in re.finditer(r"(?<![\w.$])((?:(?:public|private|protected|static|async|readonly|get|set|override|abstract|accessor)\s+)*)[*]?\s*([\w$#]+|\[[^\]\n]*\])\s*(?=[<(])", flat):
        name = m[2].strip("[]")
        if name in _KEYWORDS:
            continue
        at = s.generics(m.end())
        if flat[at:at + 1] != "(" or at not in s.close:
            continue
        head = s.skip(m.start())
        last = head
        while last and flat[last - 1].isspace():
            last -= 1
        if flat[last - 1:last] not in ("", "{", "}", ";", ",") and "\n" not in flat[last:head]:
            continue
        if re.search(r"\bfunction\s*\*?\s*\Z", flat[max(0, m.start() - 40):m.start()]):
            continue
        brace = s.returns(s.close[at] + 1, language)
        if flat[brace:brace + 1] == "{" and brace in s.close:
            add("method", name, head, s.close[brace] + 1)


def _in_type(flat: str, at: int) -> bool:
    """Whether an arrow there is a function type's, not a function's."""
    lead = flat[max(0, at - 200):at].rstrip()
    return bool(re.search(r"\btype\s+[\w$]+(?:<[^=]*>)?\s*=\Z", lead)) or lead.endswith((":", "|", "&")) and not re.search(r"[{,]\s*[\w$\"']+\s*:\Z", lead)
