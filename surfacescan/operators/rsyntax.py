"""A tokenizer and parser for R source, giving the tree that R's own parse data describes, as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator


class RSyntaxError(ValueError):
    """The text is not R."""


class Token:
    __slots__ = ("tag", "text", "line", "col", "line2", "col2")

    def __init__(self, tag: str, text: str, line: int, col: int, line2: int, col2: int):
        self.tag, self.text, self.line, self.col, self.line2, self.col2 = tag, text, line, col, line2, col2


class Node:
    __slots__ = ("tag", "text", "kids", "line", "col", "line2", "col2")

    def __init__(self, tag: str, kids: list | None = None, token: Token | None = None):
        self.tag, self.kids = tag, kids or []
        self.text = token.text if token else None
        if token:
            self.line, self.col, self.line2, self.col2 = token.line, token.col, token.line2, token.col2
        elif self.kids:
            self.line, self.col, self.line2, self.col2 = kids[0].line, kids[0].col, kids[-1].line2, kids[-1].col2
        else:
            self.line = self.col = self.line2 = self.col2 = 1


# Words and signs of the language, with the names that parse data gives them.
WORDS = {
    "function": "FUNCTION", "if": "IF", "else": "ELSE", "for": "FOR", "while": "WHILE", "repeat": "REPEAT", "in": "IN", "next": "NEXT", "break": "BREAK",
    "NULL": "NULL_CONST", "TRUE": "NUM_CONST", "FALSE": "NUM_CONST", "NA": "NUM_CONST", "NA_integer_": "NUM_CONST", "NA_real_": "NUM_CONST",
    "NA_complex_": "NUM_CONST", "NA_character_": "NUM_CONST", "Inf": "NUM_CONST", "NaN": "NUM_CONST",
}
SIGNS = {
    "<<-": "LEFT_ASSIGN", "->>": "RIGHT_ASSIGN", ":::": "NS_GET_INT", "<-": "LEFT_ASSIGN", "->": "RIGHT_ASSIGN", ":=": "LEFT_ASSIGN", "<=": "LE", ">=": "GE", "==": "EQ",
    "!=": "NE", "&&": "AND2", "||": "OR2", "|>": "PIPE", "=>": "PIPEBIND", "::": "NS_GET", "[[": "LBB", "**": "OP-CARET", "=": "EQ_ASSIGN", "<": "LT", ">": "GT", "&": "AND", "|": "OR",
    "!": "OP-EXCLAMATION", "+": "OP-PLUS", "-": "OP-MINUS", "*": "OP-STAR", "/": "OP-SLASH", "^": "OP-CARET", "~": "OP-TILDE", "?": "OP-QUESTION", ":": "OP-COLON", "$": "OP-DOLLAR",
    "@": "OP-AT", "(": "OP-LEFT-PAREN", ")": "OP-RIGHT-PAREN", "{": "OP-LEFT-BRACE", "}": "OP-RIGHT-BRACE", "[": "OP-LEFT-BRACKET", "]": "OP-RIGHT-BRACKET", ",": "OP-COMMA",
    ";": "OP-SEMICOLON", "\\": "OP-LAMBDA",
}
# Binding power of binary operators: (left, right); a right operand takes operators that bind at least as tightly.
BINDS = {
    "OP-QUESTION": (1, 2), "LEFT_ASSIGN": (6, 5), "EQ_ASSIGN": (4, 3), "RIGHT_ASSIGN": (7, 8), "OP-TILDE": (9, 10), "OR": (11, 12), "OR2": (11, 12), "AND": (13, 14), "AND2": (13, 14),
    "GT": (17, 18), "GE": (17, 18), "LT": (17, 18), "LE": (17, 18), "EQ": (17, 18), "NE": (17, 18), "OP-PLUS": (19, 20), "OP-MINUS": (19, 20), "OP-STAR": (21, 22), "OP-SLASH": (21, 22),
    "SPECIAL": (23, 24), "PIPE": (25, 26), "PIPEBIND": (27, 28), "OP-COLON": (29, 30), "OP-CARET": (34, 33),
}
COMPARES = {"GT", "GE", "LT", "LE", "EQ", "NE"}
UNARY = {"OP-MINUS": 31, "OP-PLUS": 31, "OP-EXCLAMATION": 15, "OP-TILDE": 10, "OP-QUESTION": 2}

_RAW = r"(?P<raw>[rR](?P<q>[\"'])(?P<dash>-*)(?P<open>[\(\[\{]))"
_TOKEN = re.compile(
    r"(?P<space>[ \t\f\r ]+)|(?P<comment>\#[^\n]*)|(?P<newline>\n)"
    r"|" + _RAW + r"|"
    r"(?P<number>0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?[Li]?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[Li]?)"
    r"|(?P<hold>_(?![\w.]))|(?P<name>(?:[^\W\d_]|\.(?!\d))[\w.]*)|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<tick>`(?:[^`\\]|\\.)+`)|(?P<special>%[^%\n]*%)"
    r"|(?P<sign><<-|->>|:::|<-|->|:=|<=|>=|==|!=|&&|\|\||\|>|=>|::|\[\[|\*\*|[=<>&|!+\-*/^~?:$@(){}\[\],;\\])",
    re.DOTALL,
)


#: As many tokens as one step can go over whose places nobody asks for, the commonest first; it stops at a raw string.
_PASSED = re.compile(
    "(?:[ \\n,;(){}]++|[A-QS-Za-qs-z][\\w.]*+|(?![rR][\"']-*[\\(\\[\\{])(?:" + re.sub(r"\(\?P<\w+>", "(?:", _TOKEN.pattern.replace(_RAW, "(?!)")) + "))*+", re.DOTALL
)
#: Tokens that are read before a text is parsed; most texts that are not R fail within these.
FIRST = 32


class _Tokens:
    """A text's tokens, read from its beginning as far as they are asked for."""

    def __init__(self, text: str):
        self.text, self.out, self.at, self.line, self.start, self.whole = text, [], 0, 1, 0, False

    def first(self, n: int | None = None) -> list[Token]:
        """At least the first n, or all with the end; RSyntaxError where one is none."""
        text, out, at, line, start = self.text, self.out, self.at, self.line, self.start

        def add(tag: str, body: str) -> None:
            nonlocal line, start
            first = (line, at - start + 1)
            n = body.count("\n")
            if n:
                line, start = line + n, at + body.rfind("\n") + 1
            out.append(Token(tag, body, *first, line, at + len(body) - start))

        while at < len(text) and (n is None or len(out) < n):
            m = _TOKEN.match(text, at)
            if not m:
                raise RSyntaxError(f"unexpected input at line {line}")
            kind, body = m.lastgroup, m[0]
            if m["raw"]:
                end = _raw_end(text, m)
                if end < 0:
                    raise RSyntaxError(f"unterminated raw string at line {line}")
                body = text[at:end]
                add("STR_CONST", body)
            elif kind == "newline":
                out.append(Token("NEWLINE", "\n", line, at - start + 1, line, at - start + 1))
                line, start = line + 1, at + 1
            elif kind == "name":
                add(WORDS.get(body, "SYMBOL"), body)
            elif kind in ("string", "tick", "number", "special"):
                add({"string": "STR_CONST", "tick": "SYMBOL", "number": "NUM_CONST", "special": "SPECIAL"}[kind], body)
            elif kind == "hold":
                add("PLACEHOLDER", body)
            elif kind == "sign":
                add(SIGNS[body], body)
            at += len(body)
        self.at, self.line, self.start = at, line, start
        if at == len(text) and not self.whole:
            self.whole = True
            out.append(Token("END", "", line, at - start + 1, line, at - start + 1))
        return out

    def check(self) -> None:
        """RSyntaxError where the rest of the text has what is no token; none are made."""
        text, at = self.text, self.at
        while (at := _PASSED.match(text, at).end()) < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RSyntaxError(f"unexpected input at line {text.count(chr(10), 0, at) + 1}")
            if (end := _raw_end(text, m)) < 0:
                raise RSyntaxError(f"unterminated raw string at line {text.count(chr(10), 0, at) + 1}")
            at = end


def _raw_end(text: str, m: re.Match) -> int:
    """Where a raw string ends, negative if it does not."""
    close = {"(": ")", "[": "]", "{": "}"}[m["open"]] + m["dash"] + m["q"]
    end = text.find(close, m.end())
    return end if end < 0 else end + len(close)


def tokens(text: str) -> list[Token]:
    return _Tokens(text).first()


class _Parser:
    def __init__(self, found: list[Token]):
        self.tokens, self.at, self.inside, self.piped = found, 0, ["{"], 0

    # -- tokens

    def peek(self) -> Token:
        if self.inside[-1] != "{":
            while self.tokens[self.at].tag == "NEWLINE":
                self.at += 1
        return self.tokens[self.at]

    def skip(self) -> Token:
        while self.tokens[self.at].tag == "NEWLINE":
            self.at += 1
        return self.tokens[self.at]

    def take(self, tag: str | None = None) -> Node:
        t = self.peek()
        if tag and t.tag != tag:
            raise RSyntaxError(f"unexpected {t.text or 'end of input'!r} at line {t.line}")
        self.at += 1
        return Node(t.tag, token=t)

    # -- expressions

    def program(self) -> Node:
        return Node("exprlist", self.block("END"))

    def block(self, end: str) -> list[Node]:
        out = []
        while True:
            while self.tokens[self.at].tag in ("NEWLINE", "OP-SEMICOLON"):
                if self.tokens[self.at].tag == "OP-SEMICOLON":
                    out.append(self.take())
                else:
                    self.at += 1
            if self.tokens[self.at].tag == end:
                return out
            out.append(self.expression(0))
            if self.tokens[self.at].tag not in ("NEWLINE", "OP-SEMICOLON", end):
                raise RSyntaxError(f"unexpected {self.tokens[self.at].text or 'end of input'!r} at line {self.tokens[self.at].line}")

    def expression(self, least: int) -> Node:
        left = self.postfix(self.primary())
        while True:
            t = self.peek()
            power = BINDS.get(t.tag)
            if not power or power[0] < least:
                return left
            sign = self.take()
            self.skip()
            self.piped += t.tag == "PIPE"
            right = self.expression(power[1])
            self.piped -= t.tag == "PIPE"
            compared = t.tag in COMPARES and self.peek().tag in COMPARES
            if compared:
                raise RSyntaxError(f"unexpected {self.peek().text!r} at line {t.line}")
            left = Node("expr_or_assign_or_help" if t.tag == "EQ_ASSIGN" else "expr", [left, sign, right])

    def primary(self) -> Node:
        t = self.skip() if self.inside[-1] != "{" else self.peek()
        tag = t.tag
        if tag == "PLACEHOLDER" and self.piped:
            return Node("expr", [self.take()])
        if tag in ("NUM_CONST", "STR_CONST", "NULL_CONST", "SYMBOL"):
            first = self.take()
            if tag in ("SYMBOL", "STR_CONST") and self.peek().tag in ("NS_GET", "NS_GET_INT"):
                if tag == "SYMBOL":
                    first.tag = "SYMBOL_PACKAGE"
                get = self.take()
                if self.peek().tag not in ("SYMBOL", "STR_CONST"):
                    raise RSyntaxError(f"unexpected {self.peek().text!r} at line {t.line}")
                return Node("expr", [first, get, self.take()])
            return Node("expr", [first])
        if tag in ("NEXT", "BREAK"):
            return Node("expr", [self.take()])
        if tag in UNARY:
            sign = self.take()
            self.skip()
            return Node("expr", [sign, self.expression(UNARY[tag])])
        if tag == "OP-LEFT-PAREN":
            kids = [self.take()]
            self.inside.append("(")
            kids.append(self.expression(0))
            kids.append(self.take("OP-RIGHT-PAREN"))
            self.inside.pop()
            return Node("expr", kids)
        if tag == "OP-LEFT-BRACE":
            kids = [self.take()]
            self.inside.append("{")
            kids += self.block("OP-RIGHT-BRACE")
            kids.append(self.take("OP-RIGHT-BRACE"))
            self.inside.pop()
            return Node("expr", kids)
        if tag in ("FUNCTION", "OP-LAMBDA"):
            kids = [self.take(), *self.formals()]
            self.skip()
            return Node("expr", [*kids, self.expression(3)])
        if tag in ("IF", "WHILE"):
            kids = [self.take(), *self.condition()]
            self.skip()
            kids.append(self.expression(3))
            if tag == "IF":
                mark = self.at
                if len(self.inside) > 1:
                    self.skip()
                if self.tokens[self.at].tag == "ELSE":
                    kids.append(self.take())
                    self.skip()
                    kids.append(self.expression(3))
                else:
                    self.at = mark
            return Node("expr", kids)
        if tag == "FOR":
            kids = [self.take()]
            head = [self.take("OP-LEFT-PAREN")]
            self.inside.append("(")
            head += [self.take("SYMBOL"), self.take("IN"), self.expression(0), self.take("OP-RIGHT-PAREN")]
            self.inside.pop()
            self.skip()
            return Node("expr", [*kids, Node("forcond", head), self.expression(3)])
        if tag == "REPEAT":
            kids = [self.take()]
            self.skip()
            return Node("expr", [*kids, self.expression(3)])
        raise RSyntaxError(f"unexpected {t.text or 'end of input'!r} at line {t.line}")

    def condition(self) -> list[Node]:
        kids = [self.take("OP-LEFT-PAREN")]
        self.inside.append("(")
        kids += [self.expression(0), self.take("OP-RIGHT-PAREN")]
        self.inside.pop()
        return kids

    def formals(self) -> list[Node]:
        kids = [self.take("OP-LEFT-PAREN")]
        self.inside.append("(")
        while self.peek().tag != "OP-RIGHT-PAREN":
            name = self.take("SYMBOL")
            name.tag = "SYMBOL_FORMALS"
            kids.append(name)
            if self.peek().tag == "EQ_ASSIGN":
                sign = self.take()
                sign.tag = "EQ_FORMALS"
                kids += [sign, self.expression(5)]
            if self.peek().tag != "OP-COMMA":
                break
            kids.append(self.take())
        kids.append(self.take("OP-RIGHT-PAREN"))
        self.inside.pop()
        return kids

    def arguments(self, end: str) -> list[Node]:
        kids = []
        while self.peek().tag != end:
            t = self.peek()
            if t.tag == "OP-COMMA":
                kids.append(self.take())
                continue
            mark = self.at
            if t.tag in ("SYMBOL", "STR_CONST", "NULL_CONST"):
                name = self.take()
                if self.peek().tag == "EQ_ASSIGN":
                    sign = self.take()
                    sign.tag = "EQ_SUB"
                    if name.tag == "SYMBOL":
                        name.tag = "SYMBOL_SUB"
                    kids += [name, sign]
                    if self.peek().tag not in ("OP-COMMA", end):
                        kids.append(self.expression(5))
                    continue
                self.at = mark
            kids.append(self.expression(5))
            if self.peek().tag not in ("OP-COMMA", end):
                raise RSyntaxError(f"unexpected {self.peek().text or 'end of input'!r} at line {self.peek().line}")
        return kids

    def postfix(self, left: Node) -> Node:
        while True:
            t = self.peek()
            if t.tag == "OP-LEFT-PAREN":
                last = left.kids[-1] if left.kids else None
                if last is not None and last.tag == "SYMBOL" and (len(left.kids) == 1 or left.kids[-2].tag in ("NS_GET", "NS_GET_INT", "OP-DOLLAR", "OP-AT")):
                    last.tag = "SYMBOL_FUNCTION_CALL"
                kids = [left, self.take()]
                self.inside.append("(")
                kids += [*self.arguments("OP-RIGHT-PAREN"), self.take("OP-RIGHT-PAREN")]
                self.inside.pop()
                left = Node("expr", kids)
            elif t.tag in ("OP-LEFT-BRACKET", "LBB"):
                kids = [left, self.take()]
                self.inside.append("[")
                kids += [*self.arguments("OP-RIGHT-BRACKET"), self.take("OP-RIGHT-BRACKET")]
                if t.tag == "LBB":
                    kids.append(self.take("OP-RIGHT-BRACKET"))
                self.inside.pop()
                left = Node("expr", kids)
            elif t.tag in ("OP-DOLLAR", "OP-AT"):
                sign = self.take()
                name = self.skip()
                if name.tag in ("SYMBOL", "STR_CONST"):
                    kid = self.take()
                elif name.tag in ("OP-LEFT-PAREN", "OP-LEFT-BRACE"):
                    kid = self.primary()
                else:
                    raise RSyntaxError(f"unexpected {name.text or 'end of input'!r} at line {name.line}")
                left = Node("expr", [left, sign, kid])
            else:
                return left


def parse(text: str) -> Node:
    """The tree of a program; RSyntaxError if it is none.

    A text that is not R mostly shows it in its first words: tokens are read a few at a time, and a parser that
    runs out of them begins again with more. What is no token counts before what is no program, wherever it stands.
    """
    found, n = _Tokens(text), FIRST
    while True:
        some = found.first(n)
        try:
            return _Parser(some).program()
        except IndexError:
            if found.whole:
                raise
            n *= 8
        except Exception as e:
            found.check()
            if isinstance(e, RecursionError):
                raise RSyntaxError("nested too deeply") from None
            raise


def _assigned(n: Node) -> str | None:
    """The name that a function is assigned to by this node, if it does that."""
    if len(n.kids) != 3 or n.tag not in ("expr", "expr_or_assign_or_help"):
        return None
    left, sign, right = n.kids
    name = lambda k: k.kids[0].text if k.tag == "expr" and len(k.kids) == 1 and k.kids[0].tag == "SYMBOL" else None
    if sign.tag in ("LEFT_ASSIGN", "EQ_ASSIGN"):
        return name(left) if any(k.tag == "expr" and any(x.tag == "FUNCTION" for x in k.kids) for k in (left, right)) else None
    if sign.tag == "RIGHT_ASSIGN":
        todo = [left]
        while todo:
            x = todo.pop()
            if x.tag == "FUNCTION":
                return name(right)
            todo += x.kids
    return None


def rows(root: Node) -> Iterator[tuple]:
    """Nodes in document order: (pre, size, parent, gparent, ord, depth, tag, text, line1, col1, line2, col2,
    after_dollar, after_at, prev_pkg, first_arg, named_arg, in_function, assigned).

    pre + size is the last descendant's number. first_arg and named_arg describe a literal's or other
    leaf's enclosing expression among its siblings: the first after a parenthesis or comma; the name it
    is given by.
    """
    out: list[list] = []
    todo: list[tuple] = [(root, -1, -1, 0, 0, (False, False, None, False, None), False)]
    while todo:
        n, parent, gparent, order, depth, marks, inside = todo.pop()
        if n is None:  # all below `parent` is done
            out[parent][1] = len(out) - 1 - parent
            continue
        pre = len(out)
        out.append([pre, 0, parent, gparent, order, depth, n.tag, n.text, n.line, n.col, n.line2, n.col2, *marks, inside, _assigned(n)])
        below = inside or n.tag == "expr" and any(k.tag in ("FUNCTION", "OP-LAMBDA") for k in n.kids)
        todo.append((None, pre, -1, 0, 0, (), False))
        dollar = at = False
        package, first_seen, kids = None, False, []
        for i, k in enumerate(n.kids):
            opens = i > 0 and n.kids[i - 1].tag in ("OP-LEFT-PAREN", "OP-COMMA")
            first = k.tag == "expr" and opens and not first_seen
            first_seen |= k.tag == "expr" and opens
            named = n.kids[i - 2].text if k.tag == "expr" and i > 1 and n.kids[i - 1].tag == "EQ_SUB" and n.kids[i - 2].tag == "SYMBOL_SUB" else None
            # An expression's own marks serve its single leaf, which asks about it.
            kids.append((k, pre, parent, i, depth + 1, (dollar, at, package, *((marks[3], marks[4]) if k.tag != "expr" else (first, named))), below))
            dollar, at = dollar or k.tag == "OP-DOLLAR", at or k.tag == "OP-AT"
            package = k.text if k.tag == "SYMBOL_PACKAGE" else package
        todo += reversed(kids)
    for r in out:
        yield tuple(r)
