"""Lexer and parser of the indicator language; the tree is plain lists, so a program is JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field


class ScriptError(ValueError):
    """A script that can't be compiled or run."""


_TOKEN = re.compile(
    r"""(?P<ws>[ \t]+)|(?P<comment>//[^\n]*)|(?P<color>\#[0-9A-Fa-f]{6}(?:[0-9A-Fa-f]{2})?)|(?P<num>\d+\.\d*|\.\d+|\d+)
    |(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<id>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)
    |(?P<op>=>|:=|\+=|-=|\*=|/=|%=|==|!=|<=|>=|[-+*/%<>=?:,()\[\].])""",
    re.X,
)
KEYWORDS = {"if", "else", "for", "to", "by", "while", "switch", "break", "continue", "return", "and", "or", "not", "true", "false", "na", "var", "varip", "const", "type", "function", "method"}
REJECTED = {"enum", "import", "export", "do", "as", "in"}
QUALIFIERS = {"var", "varip", "const", "simple", "series", "input"}
TYPES = {"int", "float", "bool", "string", "array", "matrix", "map", "plot", "hline", "color", "line", "label", "box", "table", "linefill"}
#: Binding powers, weakest first.
POWER = {"or": 1, "and": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
UNARY = 9


@dataclass
class Program:
    body: list = field(default_factory=list)
    functions: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps([self.body, self.functions, self.types])

    @classmethod
    def loads(cls, text: str) -> Program:
        return cls(*json.loads(text))


def lex(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) tokens with NEWLINE, INDENT and DEDENT; brackets join lines."""
    text = re.sub(r"\barray\.new<\s*(\w+)\s*>", r"array.new_\1", text)
    text = re.sub(r"\bmatrix\.new<\s*(\w+)\s*>", r"matrix.new_\1", text)
    text = re.sub(r"\bmap\.new<[^>]*>", "map.new", text)
    out, levels, depth = [], [0], 0
    for number, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        bare = line.lstrip(" \t")
        if not bare or bare.startswith("//"):
            continue
        if depth == 0:
            width = sum(4 if c == "\t" else 1 for c in line[: len(line) - len(bare)])
            if width > levels[-1]:
                levels.append(width)
                out.append(("INDENT", "", number))
            while width < levels[-1]:
                levels.pop()
                out.append(("DEDENT", "", number))
            if width != levels[-1]:
                raise ScriptError(f"line {number}: indentation fits no block")
        at = 0
        while at < len(bare):
            m = _TOKEN.match(bare, at)
            if not m:
                raise ScriptError(f"line {number}: unexpected {bare[at]!r}")
            at, kind, value = m.end(), m.lastgroup, m.group()
            if kind in ("ws", "comment"):
                continue
            if kind == "op":
                depth += value in "([" and len(value) == 1
                depth -= value in ")]" and len(value) == 1
            out.append((kind, value, number))
        if depth == 0:
            out.append(("NEWLINE", "", number))
    out += [("DEDENT", "", 0)] * (len(levels) - 1)
    return [*out, ("END", "", 0)]


#: Tokens that may follow a declaration without a value.
ENDS = ("NEWLINE", "DEDENT", "END")


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.ids = lex(text), 0, 0
        self.program = Program()

    def peek(self, n: int = 0) -> tuple[str, str, int]:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> tuple[str, str, int]:
        t = self.peek()
        self.at += 1
        return t

    def accept(self, value: str, kind: str | None = None) -> bool:
        t = self.peek()
        if t[1] == value and t[0] in ((kind,) if kind else ("op", "id")):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            t = self.peek()
            raise ScriptError(f"line {t[2]}: expected {value!r}, found {t[1] or t[0]!r}")

    def kind(self, kind: str) -> bool:
        if self.peek()[0] == kind:
            self.at += 1
            return True
        return False

    def parse(self) -> Program:
        while not self.kind("END"):
            if s := self.statement():
                self.program.body.append(s)
        return self.program

    def site(self) -> int:
        self.ids += 1
        return self.ids

    # --- statements ---

    def block(self) -> list:
        if not self.kind("NEWLINE"):
            s = self.statement()
            return [s] if s else []
        if not self.kind("INDENT"):
            raise ScriptError(f"line {self.peek()[2]}: a block is missing")
        out = []
        while not self.kind("DEDENT"):
            if s := self.statement():
                out.append(s)
        return out

    def statement(self):
        kind, value, line = self.peek()
        if kind == "NEWLINE":
            self.at += 1
            return None
        if kind in ("INDENT", "DEDENT"):
            raise ScriptError(f"line {line}: unexpected indentation")
        if kind == "id":
            if value in REJECTED:
                raise ScriptError(f"line {line}: {value} isn't supported")
            if value in ("break", "continue"):
                self.at += 1
                return self.end([value])
            if value == "return":
                self.at += 1
                return self.end(["return", None if self.peek()[0] == "NEWLINE" else self.expr()])
            if value in ("if", "for", "while", "switch"):
                return self.compound()
            if value == "type" and self.peek(1)[0] == "id":
                return self.type_()
            if value in ("function", "method") and self.peek(1)[0] == "id" or self.is_function():
                return self.function()
            if (d := self.declaration()) is not None:
                return d
            if self.peek(1)[1] in ("=", ":=", "+=", "-=", "*=", "/=", "%=") and self.peek(1)[0] == "op":
                self.at += 1
                op = self.next()[1]
                return ["assign", value, op, self.rhs()]
        if value == "[" and (t := self.tuple_()) is not None:
            return t
        return self.end(["expr", self.expr()])

    def end(self, node):
        if not self.kind("NEWLINE") and self.peek()[0] not in ("DEDENT", "END"):
            t = self.peek()
            if t[1] == ",":
                self.at += 1
                return node
            raise ScriptError(f"line {t[2]}: unexpected {t[1]!r}")
        return node

    def rhs(self):
        if self.peek()[1] in ("if", "for", "while", "switch") and self.peek()[0] == "id":
            return ["block", self.compound()]
        if self.peek()[0] == "NEWLINE" and self.peek(1)[0] == "INDENT":
            self.at += 2
            e = self.expr()
            self.kind("NEWLINE")
            self.kind("DEDENT")
            return e
        e = self.expr()
        # A right side may go on in an indented line.
        while self.peek()[0] == "NEWLINE" and self.peek(1)[0] == "INDENT" and (self.peek(2)[1] in POWER or self.peek(2)[1] == "?"):
            self.at += 2
            e = self.expr_from(e)
            self.kind("NEWLINE")
            self.kind("DEDENT")
            return e
        return self.end(e)

    def expr_from(self, left):
        return self.climb(left, 0)

    def declaration(self):
        start, const = self.at, False
        typed = None
        while self.peek()[0] == "id" and self.peek()[1] in QUALIFIERS and self.peek(1)[0] == "id":
            const |= self.next()[1] == "const"
        qualified = self.at > start
        if self.peek()[0] == "id" and self.peek(1)[0] == "op" and self.peek(1)[1] in ("<", "[") and self.peek()[1] in TYPES | set(self.program.types):
            mark = self.at
            typed = self.next()[1]
            if self.accept("<"):
                while not self.accept(">"):
                    self.next()
            if self.accept("[") and not self.accept("]") or self.peek()[0] != "id":
                self.at, typed = mark, None
        elif self.peek()[0] == "id" and self.peek(1)[0] == "id" and self.peek()[1] not in KEYWORDS and (
            self.peek(2)[1] == "=" or self.peek(2)[0] in ENDS and self.peek()[1] in TYPES | set(self.program.types)
        ):
            typed = self.next()[1]
        if (qualified or typed) and self.peek()[0] == "id" and self.peek(1)[1] in ("=", ":="):
            name = self.next()[1]
            self.at += 1
            return ["decl", name, self.rhs(), const, typed]
        if (qualified or typed) and self.peek()[0] == "id" and self.peek(1)[0] in ENDS:
            # Without a value: false for a bool, else na.
            return self.end(["decl", self.next()[1], ["bool", False] if typed == "bool" else ["na"], const, typed])
        self.at = start
        return None

    def tuple_(self):
        start, names = self.at, []
        self.at += 1
        while self.peek()[0] == "id":
            names.append(self.next()[1])
            if not self.accept(","):
                break
        if names and self.accept("]") and (self.accept("=") or self.accept(":=")):
            return ["tuple", names, self.rhs()]
        self.at = start
        return None

    def is_function(self) -> bool:
        if self.peek(1)[1] != "(":
            return False
        depth, i = 0, self.at + 1
        while i < len(self.tokens):
            v = self.tokens[i][1] if self.tokens[i][0] == "op" else ""
            depth += v in ("(", "[")
            depth -= v in (")", "]")
            if depth == 0:
                return self.tokens[i + 1][1] == "=>"
            i += 1
        return False

    def function(self):
        if self.peek()[1] in ("function", "method") and self.peek(1)[0] == "id":
            self.at += 1
        name = self.next()[1]
        self.expect("(")
        params = []
        while not self.accept(")"):
            while self.peek(1)[0] == "id":
                self.at += 1  # a qualifier or type
            p = self.next()[1]
            params.append([p, self.expr() if self.accept("=") else None])
            self.accept(",")
        self.accept("=>")
        self.program.functions[name] = [params, self.block()]
        return None

    def type_(self):
        self.at += 1
        name, fields = self.next()[1], []
        self.kind("NEWLINE")
        if self.kind("INDENT"):
            while not self.kind("DEDENT"):
                words = []
                while self.peek()[0] == "id":
                    words.append(self.next()[1])
                    if self.accept("<"):
                        while not self.accept(">"):
                            self.next()
                    if self.accept("["):
                        self.expect("]")
                fields.append([words[-1], self.expr() if self.accept("=") else None])
                self.kind("NEWLINE")
        self.program.types[name] = fields
        return None

    def compound(self):
        word = self.next()[1]
        if word == "if":
            cond = self.expr()
            then, other = self.block(), []
            if self.accept("else"):
                other = [self.compound()] if self.peek()[1] == "if" and self.peek()[0] == "id" else self.block()
            return ["if", cond, then, other]
        if word == "while":
            return ["while", self.expr(), self.block()]
        if word == "for":
            name = self.next()[1]
            self.expect("=")
            first = self.expr()
            self.expect("to")
            last = self.expr()
            step = self.expr() if self.accept("by") else None
            return ["for", name, first, last, step, self.block()]
        subject = None if self.peek()[0] == "NEWLINE" else self.expr()
        self.kind("NEWLINE")
        if not self.kind("INDENT"):
            raise ScriptError("switch has no cases")
        cases = []
        while not self.kind("DEDENT"):
            test = None if self.accept("=>") else self.expr()
            if test is not None:
                self.expect("=>")
            s = self.statement()
            cases.append([test, s])
        return ["switch", subject, cases]

    # --- expressions ---

    def expr(self):
        return self.climb(self.prefix(), 0)

    def climb(self, left, least: int):
        while True:
            kind, op, _ = self.peek()
            power = POWER.get(op) if kind in ("op", "id") else None
            if power is not None and power > least:
                self.at += 1
                left = ["bin", op, left, self.climb(self.prefix(), power)]
            elif op == "?" and kind == "op" and least == 0:
                self.at += 1
                a = self.expr()
                self.expect(":")
                left = ["tern", left, a, self.expr()]
            else:
                return left

    def prefix(self):
        kind, value, line = self.next()
        if kind == "op" and value in "+-" or value == "not" and kind == "id":
            inner = self.climb(self.prefix(), UNARY)
            return ["un", value, inner]
        if kind == "num":
            return self.postfix(["num", float(value)])
        if kind == "str":
            return self.postfix(["str", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), value[1:-1])])
        if kind == "color":
            return ["str", value]
        if value == "(" and kind == "op":
            e = self.expr()
            self.expect(")")
            return self.postfix(e)
        if value == "[" and kind == "op":
            items = []
            while not self.accept("]"):
                items.append(self.expr())
                self.accept(",")
            return self.postfix(["arr", items])
        if kind == "id":
            if value in ("true", "false"):
                return ["bool", value == "true"]
            if value == "na" and self.peek()[1] != "(":
                return ["na"]
            if value in REJECTED or value in KEYWORDS - {"na", "type"}:
                raise ScriptError(f"line {line}: unexpected {value}")
            return self.postfix(["id", value, self.site()])
        raise ScriptError(f"line {line}: unexpected {value or kind}")

    def postfix(self, e):
        while True:
            if e[0] in ("id", "call", "index", "member") and self.peek()[1] == "(" and e[0] in ("id", "member"):
                self.at += 1
                args, named = [], []
                while not self.accept(")"):
                    if self.peek()[0] == "id" and self.peek(1)[1] == "=" and self.peek(1)[0] == "op":
                        name = self.next()[1]
                        self.at += 1
                        named.append([name, self.expr()])
                    else:
                        if named:
                            raise ScriptError("a positional argument follows named ones")
                        args.append(self.expr())
                    self.accept(",")
                e = ["call", e, args, named, self.site()]
            elif self.peek()[1] == "[" and self.peek()[0] == "op":
                self.at += 1
                k = self.expr()
                self.expect("]")
                e = ["index", e, k, self.site()]
            elif self.peek()[1] == "." and self.peek(1)[0] == "id":
                self.at += 1
                e = ["member", e, self.next()[1]]
            else:
                return e


def _kind_of(e, kinds: dict) -> str | None:
    if e[0] == "num":
        return "num"
    if e[0] == "bool" or e[0] == "bin" and e[1] in ("==", "!=", "<", "<=", ">", ">=", "and", "or") or e[0] == "un" and e[1] == "not":
        return "bool"
    if e[0] == "un" or e[0] == "bin" and e[1] in "-*/%":
        return "num"
    if e[0] == "bin" and e[1] == "+":
        a, b = _kind_of(e[2], kinds), _kind_of(e[3], kinds)
        return "num" if a == b == "num" else None
    if e[0] == "id":
        return kinds.get(e[1])
    return None


PRICES = ("open", "high", "low", "close", "volume", "hl2", "hlc3", "hlcc4", "ohlc4", "bar_index", "last_bar_index", "time", "time_close")


def typecheck(program: Program) -> None:
    """Numbers don't become booleans by themselves: not in conditions, not, and, or, nor bool variables."""
    kinds = dict.fromkeys(PRICES, "num")

    def need(e, where: str) -> None:
        if _kind_of(e, kinds) == "num":
            raise ScriptError(f"a number is used as a boolean in {where}")

    def expr(e) -> None:
        if not isinstance(e, list) or not e:
            return
        if e[0] == "tern":
            need(e[1], "a ternary")
        if e[0] == "un" and e[1] == "not":
            need(e[2], "not")
        if e[0] == "bin" and e[1] in ("and", "or"):
            need(e[2], e[1])
            need(e[3], e[1])
        for x in e:
            if isinstance(x, list):
                expr(x)

    def body(statements, bools: set) -> None:
        for s in statements:
            if s is None:
                continue
            if s[0] in ("decl", "assign"):
                value = s[2] if s[0] == "decl" else s[3]
                expr(value)
                if s[0] == "decl" and s[4] == "bool":
                    bools.add(s[1])
                if s[1] in bools:
                    if _kind_of(value, kinds) == "num" or value == ["na"]:
                        raise ScriptError(f"bool variable {s[1]} gets a number or na")
                    kinds[s[1]] = "bool"
                else:
                    kinds[s[1]] = _kind_of(value, kinds)
            elif s[0] in ("if", "while"):
                need(s[1], s[0])
                expr(s[1])
                body(s[2], bools)
                if s[0] == "if":
                    body(s[3], bools)
            elif s[0] == "for":
                kinds[s[1]] = "num"
                body(s[5], bools)
            elif s[0] == "switch":
                for test, action in s[2]:
                    if s[1] is None and test is not None:
                        need(test, "switch")
                    body([action], bools)
            elif s[0] in ("expr", "return", "tuple"):
                expr(s[-1])

    body(program.body, set())


def compile_script(text: str) -> Program:
    program = Parser(text).parse()
    typecheck(program)
    return program
