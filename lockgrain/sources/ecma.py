"""Syntax trees of ECMAScript source, by precedence climbing over tokens that are read on demand.

The tree keeps what scopes, module bindings and calls need: every node has a type, an offset and its parts; parentheses
and punctuation leave no node.  The grammar is that of the public language specification without its early errors
(repeated declarations, invalid labels and the like are accepted).
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)*")
_LINE_END = re.compile(r"[\n\r\u2028\u2029]")
_START = r"(?:[$_a-zA-Z]|[^\x00-\x7f\s\ufeff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
_NAME = rf"{_START}(?:{_START}|[0-9])*"
_TOKEN = re.compile(
    rf"""(?P<name>{_NAME})|(?P<private>\#{_NAME})"""
    r"""|(?P<number>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?n?)"""
    r"""|(?P<string>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"""
    r"""|(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])"""
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([0-7]{1,3})|(\r\n|[\n\r\u2028\u2029])|([\s\S]))")
_SINGLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_PREFIX = frozenset(["delete", "void", "typeof", "+", "-", "~", "!"])


class SourceError(ValueError):
    """Source that cannot be parsed; ``at`` is the offset where reading ended."""

    def __init__(self, message: str, at: int = 0):
        super().__init__(message)
        self.at = at


class Node:
    __slots__ = ("type", "start", "parts")

    def __init__(self, type_: str, start: int, **parts: object):
        self.type, self.start, self.parts = type_, start, parts

    def __getattr__(self, name: str) -> object:
        try:
            return self.parts[name]
        except KeyError:
            raise AttributeError(name) from None

    def children(self) -> Iterator[Node]:
        for v in self.parts.values():
            if isinstance(v, Node):
                yield v
            elif isinstance(v, list):
                for x in v:
                    if isinstance(x, Node):
                        yield x


def unescape(body: str) -> str:
    """The value of a string literal's or template's characters."""
    if "\\" not in body:
        return body

    def one(m: re.Match) -> str:
        if code := m[1] or m[2] or m[3]:
            n = int(code, 16)
            return chr(n) if n < 0x110000 else "\ufffd"
        if m[4]:
            return chr(int(m[4], 8))
        return "" if m[5] else _SINGLE.get(m[6], m[6])

    return _ESCAPE.sub(one, body)


class Parser:
    def __init__(self, text: str, module: bool, seconds: float | None = None):
        self.text, self.module = text, module
        self.deadline = time.monotonic() + seconds if seconds else None
        self.steps = self.end = 0
        self.in_function = False
        self.in_async, self.in_generator = module, False
        if text.startswith("#!"):
            m = _LINE_END.search(text)
            self.end = m.start() if m else len(text)
        self.cover: int | None = None  # where something stands that only a pattern may hold
        self.next()

    # --- tokens ---

    def next(self) -> None:
        self.steps += 1
        if self.deadline and not self.steps % 4096 and time.monotonic() > self.deadline:
            raise SourceError("parsing took too long", self.end)
        text, at = self.text, self.end
        to = _SPACE.match(text, at).end()
        self.newline = to > at and _LINE_END.search(text, at, to) is not None
        self.last = at
        self.start = to
        if to == len(text):
            self.kind, self.value, self.end = "end", "", to
            return
        m = _TOKEN.match(text, to)
        if m is None or text.startswith("/*", to):
            raise SourceError("unexpected character" if m is None else "a comment is not closed", to)
        self.kind, self.value, self.end = m.lastgroup, m.group(), m.end()
        if self.kind == "number":
            if re.compile(_START).match(text, self.end) or (self.module and re.match(r"0[0-9]", self.value)):
                raise SourceError("invalid number", to)
        elif self.kind == "name" and "\\" in self.value:
            self.value = unescape(self.value)

    def state(self) -> tuple:
        return self.kind, self.value, self.start, self.end, self.newline, self.last

    def reset(self, state: tuple) -> None:
        self.kind, self.value, self.start, self.end, self.newline, self.last = state

    def fail(self, message: str | None = None) -> SourceError:
        return SourceError(message or (f"unexpected {self.value!r}" if self.value else "unexpected end"), self.start)

    def at(self, *values: str) -> bool:
        return self.value in values and self.kind in ("sign", "name")

    def eat(self, value: str) -> bool:
        if self.value == value and self.kind in ("sign", "name"):
            self.next()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.eat(value):
            raise self.fail()

    def peek(self) -> tuple[str, str, bool]:
        """Kind, value and newline of the token after this one (which must not start a regular expression)."""
        kept = self.state()
        self.next()
        out = self.kind, self.value, self.newline
        self.reset(kept)
        return out

    def semicolon(self) -> None:
        if not self.eat(";") and not self.at("}") and self.kind != "end" and not self.newline:
            raise self.fail()

    def is_name(self) -> bool:
        return self.kind == "name" and self.value not in RESERVED

    def identifier(self) -> Node:
        if not self.is_name() or (self.value == "await" and self.module) or (self.value == "yield" and self.in_generator):
            raise self.fail()
        out = Node("Id", self.start, name=self.value)
        self.next()
        return out

    def word(self) -> Node:
        """A name where reserved words are allowed."""
        if self.kind != "name":
            raise self.fail()
        out = Node("Id", self.start, name=self.value)
        self.next()
        return out

    def string(self) -> Node:
        if self.kind != "string":
            raise self.fail()
        out = Node("String", self.start, value=unescape(self.value[1:-1]))
        self.next()
        return out

    # --- statements ---

    def program(self) -> Node:
        body = []
        while self.kind != "end":
            body.append(self.statement(top=True))
        return Node("Program", 0, body=body)

    def block(self) -> Node:
        start = self.start
        self.expect("{")
        body = []
        while not self.at("}"):
            body.append(self.statement())
        self.next()
        return Node("Block", start, body=body)

    def statement(self, top: bool = False) -> Node:
        start, v = self.start, self.value
        if self.kind == "end":
            raise self.fail()
        if self.kind == "sign":
            if v == "{":
                return self.block()
            if v == ";":
                self.next()
                return Node("Empty", start)
            if v == "@":
                self.decorators()
                return self.statement(top)
        if self.kind == "name":
            reader = getattr(self, f"_{v}", None) if v in _STATEMENTS else None
            if reader:
                return reader(start)
            if v in ("var", "const") or (v == "let" and self.declares()):
                out = self.variables()
                self.semicolon()
                return out
            if v == "async":
                kind, value, newline = self.peek()
                if value == "function" and kind == "name" and not newline:
                    return self.function(start, "declaration")
            if v == "import" and self.peek()[1] not in ("(", "."):
                return self.import_(start, top)
            if v == "export":
                return self.export(start, top)
        expression = self.expression()
        if expression.type == "Id" and self.at(":"):
            self.next()
            return Node("Label", start, body=self.statement())
        self.semicolon()
        return Node("Statement", start, expression=expression)

    def declares(self) -> bool:
        kind, value, _ = self.peek()
        return (kind == "name" and value not in ("in", "instanceof", "of")) or (kind == "sign" and value in ("[", "{")) or (kind == "name" and value == "of")

    def variables(self, for_: bool = False) -> Node:
        start, kind = self.start, self.value
        self.next()
        out = []
        while True:
            at = self.start
            target = self.binding()
            init = self.assign(no_in=for_) if self.eat("=") else None
            if init is None and not (for_ and self.at("in", "of")) and (kind == "const" or target.type != "Id") and not for_:
                raise self.fail()
            out.append(Node("Declarator", at, id=target, init=init))
            if not self.eat(","):
                return Node("Variables", start, kind=kind, declarations=out)

    def binding(self) -> Node:
        start = self.start
        if self.eat("["):
            items = []
            while not self.eat("]"):
                if self.eat(","):
                    continue
                items.append(Node("Rest", self.start, argument=self.binding()) if self.eat("...") else self.element())
                if not self.at("]"):
                    self.expect(",")
            return Node("ArrayPattern", start, items=items)
        if self.eat("{"):
            props = []
            while not self.eat("}"):
                at = self.start
                if self.eat("..."):
                    props.append(Node("Rest", at, argument=self.binding()))
                else:
                    key, computed = self.key()
                    if self.eat(":"):
                        value = self.element()
                    else:
                        if key.type != "Id" or computed or key.name in RESERVED:
                            raise self.fail()
                        value = Node("Default", at, target=key, init=self.assign()) if self.eat("=") else key
                    props.append(Node("Property", at, key=key, computed=computed, value=value))
                if not self.at("}"):
                    self.expect(",")
            return Node("ObjectPattern", start, properties=props)
        return self.identifier()

    def element(self) -> Node:
        start, target = self.start, self.binding()
        return Node("Default", start, target=target, init=self.assign()) if self.eat("=") else target

    def _if(self, start: int) -> Node:
        self.next()
        test = self.parenthesised()
        then = self.statement()
        return Node("If", start, test=test, then=then, otherwise=self.statement() if self.eat("else") else None)

    def parenthesised(self) -> Node:
        self.expect("(")
        out = self.expression()
        self.expect(")")
        return out

    def _while(self, start: int) -> Node:
        self.next()
        return Node("While", start, test=self.parenthesised(), body=self.statement())

    def _do(self, start: int) -> Node:
        self.next()
        body = self.statement()
        self.expect("while")
        out = Node("Do", start, body=body, test=self.parenthesised())
        self.eat(";")
        return out

    def _for(self, start: int) -> Node:
        self.next()
        if self.at("await"):
            self.next()
        self.expect("(")
        first: Node | None = None
        if self.at("var", "const") or (self.at("let") and self.declares()):
            first = self.variables(for_=True)
        elif not self.at(";"):
            self.cover = None
            first = self.expression(no_in=True, pattern=True)
        if first is not None and self.at("of", "in"):
            if first.type != "Variables":
                self.target(first)
            of = self.value == "of"
            self.next()
            right = self.assign() if of else self.expression()
            self.expect(")")
            return Node("ForEach", start, left=first, right=right, body=self.statement())
        self.reject_cover()
        self.expect(";")
        test = None if self.at(";") else self.expression()
        self.expect(";")
        step = None if self.at(")") else self.expression()
        self.expect(")")
        return Node("For", start, init=first, test=test, step=step, body=self.statement())

    def _return(self, start: int) -> Node:
        if not self.in_function:
            raise self.fail("return outside of a function")
        return self.jump(start, "Return", True)

    def _throw(self, start: int) -> Node:
        return self.jump(start, "Throw", True)

    def _break(self, start: int) -> Node:
        return self.jump(start, "Break", False)

    def _continue(self, start: int) -> Node:
        return self.jump(start, "Continue", False)

    def _debugger(self, start: int) -> Node:
        return self.jump(start, "Debugger", False)

    def jump(self, start: int, type_: str, takes: bool) -> Node:
        self.next()
        argument = None
        if not self.newline and not self.at(";", "}") and self.kind != "end":
            argument = self.expression() if takes else self.identifier()
        elif type_ == "Throw":
            raise self.fail()
        self.semicolon()
        return Node(type_, start, argument=argument if takes else None)

    def _try(self, start: int) -> Node:
        self.next()
        block, handler, last = self.block(), None, None
        if self.at("catch"):
            at = self.start
            self.next()
            parameter = None
            if self.eat("("):
                parameter = self.binding()
                self.expect(")")
            handler = Node("Catch", at, parameter=parameter, body=self.block())
        if self.eat("finally"):
            last = self.block()
        if handler is None and last is None:
            raise self.fail()
        return Node("Try", start, block=block, handler=handler, last=last)

    def _switch(self, start: int) -> Node:
        self.next()
        on, cases = self.parenthesised(), []
        self.expect("{")
        while not self.eat("}"):
            at = self.start
            if self.eat("default"):
                test = None
            else:
                self.expect("case")
                test = self.expression()
            self.expect(":")
            body = []
            while not self.at("case", "default", "}"):
                body.append(self.statement())
            cases.append(Node("Case", at, test=test, body=body))
        return Node("Switch", start, on=on, cases=cases)

    def _with(self, start: int) -> Node:
        if self.module:
            raise self.fail()
        self.next()
        return Node("With", start, object=self.parenthesised(), body=self.statement())

    def _function(self, start: int) -> Node:
        return self.function(start, "declaration")

    def _class(self, start: int) -> Node:
        return self.class_(start)

    def attributes(self) -> None:
        if self.at("with", "assert") and not self.newline:
            self.next()
            self.expect("{")
            while not self.eat("}"):
                if self.kind == "string":
                    self.next()
                else:
                    self.word()
                self.expect(":")
                self.string()
                if not self.at("}"):
                    self.expect(",")

    def import_(self, start: int, top: bool) -> Node:
        if not (self.module and top):
            raise self.fail("import outside of a module")
        self.next()
        names = []
        if self.kind != "string":
            if not self.at("{", "*"):
                names.append(Node("Imported", self.start, local=self.identifier(), member=None))
                if not self.at("from"):
                    self.expect(",")
            if self.at("*"):
                at = self.start
                self.next()
                self.expect("as")
                names.append(Node("Imported", at, local=self.identifier(), member=None))
            elif self.eat("{"):
                while not self.eat("}"):
                    at = self.start
                    outer = self.string() if self.kind == "string" else self.word()
                    if self.eat("as"):
                        local = self.identifier()
                    elif outer.type == "String" or outer.name in RESERVED:
                        raise self.fail()
                    else:
                        local = outer
                    names.append(Node("Imported", at, local=local, member=outer.name if outer.type == "Id" else None))
                    if not self.at("}"):
                        self.expect(",")
            self.expect("from")
        source = self.string()
        self.attributes()
        self.semicolon()
        return Node("Import", start, source=source, names=names)

    def export(self, start: int, top: bool) -> Node:
        if not (self.module and top):
            raise self.fail("export outside of a module")
        self.next()
        if self.eat("default"):
            at = self.start
            if self.at("function") or (self.at("async") and self.peek()[:2] == ("name", "function")):
                return Node("Export", start, body=self.function(at, "declaration", unnamed=True))
            if self.at("@"):
                self.decorators()
            if self.at("class"):
                return Node("Export", start, body=self.class_(at))
            out = Node("Export", start, body=self.assign())
            self.semicolon()
            return out
        if self.at("*", "{"):
            if self.eat("*"):
                if self.eat("as"):
                    self.string() if self.kind == "string" else self.word()
                from_ = True
            else:
                self.next()
                while not self.eat("}"):
                    for _ in range(2):
                        self.string() if self.kind == "string" else self.word()
                        if not self.eat("as"):
                            break
                    if not self.at("}"):
                        self.expect(",")
                from_ = self.at("from")
            if from_:
                self.expect("from")
                self.string()
                self.attributes()
            self.semicolon()
            return Node("Export", start)
        if self.at("@"):
            self.decorators()
        if not self.at("var", "let", "const", "function", "class", "async"):
            raise self.fail()
        return Node("Export", start, body=self.statement())

    # --- functions and classes ---

    def function(self, start: int, kind: str, unnamed: bool = False) -> Node:
        is_async = self.eat("async")
        self.expect("function")
        generator = self.eat("*")
        name = None
        if not self.at("("):
            name = self.word() if self.value in ("await", "yield") else self.identifier()
        elif kind == "declaration" and not unnamed:
            raise self.fail()
        return self.rest_of_function(start, kind, name, is_async, generator)

    def rest_of_function(self, start: int, kind: str, name: Node | None, is_async: bool, generator: bool) -> Node:
        outer = self.in_function, self.in_async, self.in_generator
        self.in_function, self.in_async, self.in_generator = True, is_async, generator
        self.expect("(")
        params = []
        while not self.eat(")"):
            at = self.start
            params.append(Node("Rest", at, argument=self.binding()) if self.eat("...") else self.element())
            if not self.at(")"):
                self.expect(",")
        body = self.function_body()
        self.in_function, self.in_async, self.in_generator = outer
        self.after_body()
        return Node("Function", start, kind=kind, id=name, params=params, body=body)

    def function_body(self) -> Node:
        """A block whose closing brace is still the current token, as it decides how the next one is read."""
        start = self.start
        self.expect("{")
        body = []
        while not self.at("}"):
            body.append(self.statement())
        return Node("Block", start, body=body)

    def after_body(self) -> None:
        self.expect("}")

    def arrow(self, start: int, params: list[Node], is_async: bool) -> Node:
        if self.newline:
            raise self.fail()
        self.expect("=>")
        outer = self.in_function, self.in_async, self.in_generator
        self.in_async, self.in_generator = is_async, False
        if self.at("{"):
            self.in_function = True
            body = self.function_body()
            self.in_function, self.in_async, self.in_generator = outer
            self.after_body()
        else:
            body = self.assign(no_in=self.no_in)
            self.in_function, self.in_async, self.in_generator = outer
        return Node("Function", start, kind="arrow", id=None, params=params, body=body)

    def decorators(self) -> None:
        while self.eat("@"):
            self.left_hand()

    def class_(self, start: int) -> Node:
        self.expect("class")
        name = None if self.at("{", "extends") else self.identifier()
        parent = self.left_hand() if self.eat("extends") else None
        members = []
        self.expect("{")
        while not self.at("}"):
            if self.eat(";"):
                continue
            if self.at("@"):
                self.decorators()
            members.append(self.member())
        self.next()
        return Node("Class", start, id=name, parent=parent, members=members)

    def member(self) -> Node:
        start = self.start
        ends = ("(", "=", ";", "}")

        def modifier(word: str) -> bool:
            if not self.at(word):
                return False
            kind, value, newline = self.peek()
            if (kind == "sign" and value in ends) or kind == "end" or (newline and word != "static" and word not in ("get", "set")):
                return False
            self.next()
            return True

        static = modifier("static")
        if static and self.at("{"):
            outer = self.in_function, self.in_async, self.in_generator
            self.in_function, self.in_async, self.in_generator = False, False, False
            body = self.block()
            self.in_function, self.in_async, self.in_generator = outer
            return Node("StaticBlock", start, body=body)
        is_async = modifier("async")
        generator = self.eat("*")
        if not is_async and not generator and not modifier("get") and not modifier("set"):
            modifier("accessor")
        key, computed = self.key(private=True)
        if self.at("("):
            return Node("Method", start, key=key if computed else None, value=self.rest_of_function(start, "expression", None, is_async, generator))
        if is_async or generator:
            raise self.fail()
        outer = self.in_async, self.in_generator
        self.in_async, self.in_generator = False, False
        value = self.assign() if self.eat("=") else None
        self.in_async, self.in_generator = outer
        self.semicolon()
        return Node("Field", start, key=key if computed else None, value=value)

    def key(self, private: bool = False) -> tuple[Node, bool]:
        """A property's key and whether it is computed."""
        if self.eat("["):
            out = self.assign()
            self.expect("]")
            return out, True
        if self.kind == "string":
            return self.string(), False
        if self.kind == "number" or (private and self.kind == "private"):
            out = Node("Literal", self.start)
            self.next()
            return out, False
        return self.word(), False

    # --- expressions ---

    no_in = False

    def expression(self, no_in: bool = False, pattern: bool = False) -> Node:
        start = self.start
        if not pattern:
            outer, self.cover = self.cover, None
        out = self.assign(no_in)
        if self.at(","):
            items = [out]
            while self.eat(","):
                items.append(self.assign(no_in))
            out = Node("Sequence", start, items=items)
        if not pattern:
            self.reject_cover()
            self.cover = outer
        return out

    def reject_cover(self) -> None:
        if self.cover is not None:
            raise SourceError("only a pattern may hold this", self.cover)

    def assign(self, no_in: bool = False) -> Node:
        outer, self.no_in = self.no_in, no_in
        try:
            return self.assignment()
        finally:
            self.no_in = outer

    def assignment(self) -> Node:
        start = self.start
        if self.kind == "name":
            if self.value == "yield" and self.in_generator:
                self.next()
                argument = None
                if not self.newline and not self.at(")", "]", "}", ",", ";", ":", "in", "of") and self.kind != "end":
                    self.eat("*")
                    argument = self.assign(self.no_in)
                return Node("Yield", start, argument=argument)
            if self.is_name():
                kind, value, newline = self.peek_name()
                if value == "=>" and kind == "sign" and not (self.value == "await" and self.in_async):
                    return self.arrow(start, [self.word()], False)
                if self.value == "async" and kind == "name" and not newline and value not in RESERVED:
                    kept = self.state()
                    self.next()
                    name = self.word()
                    if self.at("=>"):
                        return self.arrow(start, [name], True)
                    self.reset(kept)
        cover, self.cover = self.cover, None
        left = self.conditional()
        if left.type == "Function" and left.kind == "arrow":
            self.cover = cover
            return left
        if self.kind == "sign" and self.value in _ASSIGN:
            plain = self.value == "="
            if plain and left.type in ("Object", "Array"):
                self.target(left)
                self.cover = None
            elif left.type not in ("Id", "Member"):
                raise self.fail("invalid target of an assignment")
            self.next()
            right = self.assign(self.no_in)
            left = Node("Assign" if plain else "Update", start, target=left, init=right)
        if self.cover is None:
            self.cover = cover
        elif cover is not None:
            self.cover = min(cover, self.cover)
        return left

    def peek_name(self) -> tuple[str, str, bool]:
        """The token after a name; a slash there divides."""
        kept = self.state()
        try:
            self.next()
            return self.kind, self.value, self.newline
        except SourceError:
            return "sign", "", False
        finally:
            self.reset(kept)

    def target(self, node: Node) -> None:
        """Read an expression as a pattern."""
        if node.type == "Object":
            node.type = "ObjectPattern"
            for p in node.properties:
                if p.type == "Spread":
                    p.type = "Rest"
                    self.target(p.argument)
                elif p.type != "Property":
                    raise SourceError("invalid pattern", p.start)
                else:
                    self.target(p.value)
        elif node.type == "Array":
            node.type = "ArrayPattern"
            for x in node.items:
                self.target(x)
        elif node.type == "Assign":
            node.type = "Default"
        elif node.type == "Spread":
            node.type = "Rest"
            self.target(node.argument)
        elif node.type not in ("Id", "Member", "ObjectPattern", "ArrayPattern", "Default", "Rest"):
            raise SourceError("invalid pattern", node.start)

    def conditional(self) -> Node:
        start, test = self.start, self.binary(0)
        if not self.at("?") or (test.type == "Function" and test.kind == "arrow"):
            return test
        self.next()
        then = self.assign()
        self.expect(":")
        return Node("Conditional", start, test=test, then=then, otherwise=self.assign(self.no_in))

    def binary(self, least: int) -> Node:
        start = self.start
        if self.kind == "private":
            left = Node("Private", start)
            self.next()
            if not self.at("in"):
                raise self.fail()
        else:
            left = self.unary()
        if left.type == "Function" and left.kind == "arrow":
            return left  # nothing binds to it without parentheses
        while self.kind in ("sign", "name"):
            level = _BINARY.get(self.value, 0)
            if level <= least or (self.value == "in" and self.no_in):
                break
            power = self.value == "**"
            self.next()
            right = self.binary(level - power)
            left = Node("Binary", start, left=left, right=right)
        return left

    def unary(self) -> Node:
        start = self.start
        if self.kind in ("sign", "name"):
            if self.value in _PREFIX:
                self.next()
                return Node("Unary", start, argument=self.unary())
            if self.value in ("++", "--"):
                self.next()
                argument = self.unary()
                if argument.type not in ("Id", "Member"):
                    raise SourceError("invalid target of an assignment", argument.start)
                return Node("Unary", start, argument=argument)
            if self.value == "await" and self.in_async:
                self.next()
                return Node("Await", start, argument=self.unary())
        out = self.left_hand()
        if self.at("++", "--") and not self.newline:
            if out.type not in ("Id", "Member"):
                raise self.fail()
            self.next()
            return Node("Unary", start, argument=out)
        return out

    def left_hand(self) -> Node:
        start = self.start
        out = self.new(start) if self.at("new") else self.primary()
        if out.type == "Function" and out.kind == "arrow":
            return out
        return self.chain(out, start, True)

    def chain(self, out: Node, start: int, calls: bool) -> Node:
        optional = False
        while True:
            if self.kind == "sign":
                v = self.value
                if v == "." or (v == "?." and calls):
                    optional = optional or v == "?."
                    self.next()
                    if v == "?." and self.at("("):
                        out = Node("Call", start, callee=out, arguments=self.arguments())
                        continue
                    if v == "?." and self.at("["):
                        continue
                    if self.kind == "private":
                        name = Node("Private", self.start)
                        self.next()
                    else:
                        name = self.word()
                    out = Node("Member", start, object=out, property=name, computed=False)
                    continue
                if v == "[":
                    self.next()
                    key = self.expression()
                    self.expect("]")
                    out = Node("Member", start, object=out, property=key, computed=True)
                    continue
                if v == "(" and calls:
                    at = self.start
                    if out.type == "Id" and out.name == "async" and not self.newline and self.text.startswith("async", out.start):
                        items = self.cover_list(at)
                        if self.at("=>") and not self.newline:
                            for x in items:
                                self.target(x)
                            self.cover = None
                            return self.arrow(start, items, True)
                        self.reject_cover()
                        out = Node("Call", start, callee=out, arguments=items)
                    else:
                        out = Node("Call", start, callee=out, arguments=self.arguments())
                    continue
                if v == "`":
                    out = Node("Tagged", start, tag=out, template=self.template())
                    continue
            return Node("Optional", start, expression=out) if optional else out

    def new(self, start: int) -> Node:
        self.expect("new")
        if self.at("."):
            self.next()
            self.word()
            return Node("Meta", start)
        at = self.start
        callee = self.new(at) if self.at("new") else self.primary()
        if callee.type == "ImportCall":
            raise SourceError("import cannot be constructed", at)
        callee = self.chain(callee, at, False)
        return Node("New", start, callee=callee, arguments=self.arguments() if self.at("(") else [])

    def arguments(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.eat(")"):
            start = self.start
            outer, self.cover = self.cover, None
            out.append(Node("Spread", start, argument=self.assign()) if self.eat("...") else self.assign())
            self.reject_cover()
            self.cover = outer
            if not self.at(")"):
                self.expect(",")
        return out

    def cover_list(self, start: int) -> list[Node]:
        """What stands in parentheses: arguments, or parameters of an arrow function."""
        self.expect("(")
        out = []
        while not self.eat(")"):
            at = self.start
            if self.eat("..."):
                out.append(Node("Spread", at, argument=self.assign()))
            else:
                out.append(self.assign())
            if not self.at(")"):
                self.expect(",")
        return out

    def primary(self) -> Node:
        start, kind, v = self.start, self.kind, self.value
        if kind == "string":
            return self.string()
        if kind == "number":
            self.next()
            return Node("Literal", start)
        if kind == "name":
            if v == "function":
                return self.function(start, "expression")
            if v == "async":
                k, value, newline = self.peek_name()
                if value == "function" and k == "name" and not newline:
                    return self.function(start, "expression")
            if v == "class":
                return self.class_(start)
            if v in ("this", "null", "true", "false", "super"):
                self.next()
                return Node("Literal", start)
            if v == "import":
                self.next()
                if self.eat("."):
                    if self.word().name != "meta" or not self.module:
                        raise SourceError("import.meta outside of a module", start)
                    return Node("Meta", start)
                arguments = self.arguments()
                if not 1 <= len(arguments) <= 2:
                    raise SourceError("import takes one or two arguments", start)
                return Node("ImportCall", start, source=arguments[0], options=arguments[1:])
            return self.identifier()
        if v == "(":
            outer, self.cover = self.cover, None
            at = self.start
            items, odd = self.parenthesis()
            if self.at("=>") and not self.newline:
                for x in items:
                    self.target(x)
                self.cover = outer
                return self.arrow(at, items, False)
            if odd is not None:
                raise SourceError("only parameters may stand so", odd)
            self.reject_cover()
            self.cover = outer
            if len(items) == 1:
                only = items[0]
                # what stood in parentheses is no pattern
                return Node("Group", only.start, expression=only) if only.type in ("Object", "Array") or (only.type == "Function" and only.kind == "arrow") else only
            return Node("Sequence", at, items=items)
        if v == "[":
            self.next()
            items = []
            while not self.eat("]"):
                if self.eat(","):
                    continue
                at = self.start
                items.append(Node("Spread", at, argument=self.assign()) if self.eat("...") else self.assign())
                if not self.at("]"):
                    self.expect(",")
            return Node("Array", start, items=items)
        if v == "{":
            return self.object()
        if v == "`":
            return self.template()
        if v in ("/", "/="):
            m = _REGEX.match(self.text, start)
            if not m:
                raise self.fail("a regular expression is not closed")
            self.end = m.end()
            self.next()
            return Node("Literal", start)
        if v == "@":
            self.decorators()
            return self.class_(start)
        raise self.fail()

    def parenthesis(self) -> tuple[list[Node], int | None]:
        """The items, and where something stands that only parameters may have."""
        self.expect("(")
        items: list[Node] = []
        odd = None
        if self.at(")"):
            odd = self.start
        while not self.eat(")"):
            at = self.start
            if self.eat("..."):
                odd = at
                items.append(Node("Rest", at, argument=self.binding()))
            else:
                items.append(self.assign())
            if not self.at(")"):
                self.expect(",")
                if self.at(")"):
                    odd = self.start
        return items, odd

    def object(self) -> Node:
        start, props = self.start, []
        self.expect("{")
        while not self.eat("}"):
            at = self.start
            if self.eat("..."):
                props.append(Node("Spread", at, argument=self.assign()))
            else:
                props.append(self.property(at))
            if not self.at("}"):
                self.expect(",")
        return Node("Object", start, properties=props)

    def property(self, start: int) -> Node:
        ends = (",", "}", ":", "(", "=")
        is_async = generator = accessor = False
        if self.at("async", "get", "set"):
            kind, value, newline = self.peek()
            if not (kind == "sign" and value in ends) and not (newline and self.value == "async"):
                is_async, accessor = self.value == "async", self.value != "async"
                self.next()
        if self.eat("*"):
            generator = True
        key, computed = self.key()
        if self.at("("):
            return Node("Method", start, key=key if computed else None, value=self.rest_of_function(start, "expression", None, is_async, generator))
        if is_async or generator or accessor:
            raise self.fail()
        if self.eat(":"):
            return Node("Property", start, key=key, computed=computed, value=self.assign())
        if key.type != "Id" or computed or key.name in RESERVED:
            raise self.fail()
        if self.at("="):
            self.cover = self.start if self.cover is None else self.cover
            cover = self.cover
            self.next()
            value = Node("Default", start, target=key, init=self.assign())
            self.cover = cover
            return Node("Property", start, key=key, computed=False, value=value)
        return Node("Property", start, key=key, computed=False, value=key)

    def template(self) -> Node:
        start = self.start
        at, cooked, expressions, text = self.start + 1, [], [], self.text
        stop = re.compile(r"\\[\s\S]|`|\$\{")
        while True:
            begin = at
            while True:
                m = stop.search(text, at)
                if not m:
                    raise SourceError("a template is not closed", start)
                at = m.end()
                if m.group()[0] != "\\":
                    break
            cooked.append(unescape(text[begin : m.start()]))
            self.end = at
            if m.group() == "`":
                self.next()
                return Node("Template", start, cooked=cooked, expressions=expressions)
            self.next()
            expressions.append(self.expression())
            if not self.at("}"):
                raise self.fail()
            at = self.end


_STATEMENTS = frozenset(["if", "while", "do", "for", "return", "throw", "break", "continue", "debugger", "try", "switch", "with", "function", "class"])


def parse(text: str, source_type: str = "either", seconds: float | None = None) -> Node:
    """The tree of a ``module``, a ``script``, or ``either``: a module, or a script if it is no module.

    SourceError says what cannot be read, or that ``seconds`` have passed.
    """
    kinds = {"module": [True], "script": [False], "either": [True, False]}[source_type]
    for k, module in enumerate(kinds):
        try:
            return Parser(text, module, seconds).program()
        except RecursionError:
            raise SourceError("source is nested too deeply") from None
        except SourceError as e:
            if k + 1 == len(kinds) or "too long" in str(e):
                raise
    raise AssertionError
