"""A recursive-descent recogniser of JavaScript (ES2022, scripts and modules).

It accepts or rejects; no tree is built. Tokens are scanned on demand, since ``/`` begins a
regular expression or divides by what stands before it. Semicolons are inserted as the language
says. It is somewhat laxer than the language (it does not resolve labels, duplicate bindings or
strict mode), never stricter on valid programs it was made for.
"""

from __future__ import annotations

import re


class JsError(ValueError):
    pass


_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*.*?\*/|<!--[^\n]*)+", re.S)
_IDENT = re.compile(r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r'"(?:[^"\\\n\r]|\\(?:\r\n|.|\n))*"|\'(?:[^\'\\\n\r]|\\(?:\r\n|.|\n))*\'', re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
# The punctuators of the language, longest first.
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
# Words that cannot be identifiers.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
)
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
#: Nesting beyond this is rejected rather than left to the interpreter's stack.
DEEPEST = 400


class Parser:
    def __init__(self, text: str) -> None:
        self.s = text
        self.i = 0
        self.depth = 0
        self.functions = 0
        if text.startswith("#!"):
            self.i = text.find("\n") if "\n" in text else len(text)
        self.next(True)

    # -- tokens: self.k kind, self.v value, self.nl a line break stood before it
    def next(self, regex: bool = True) -> None:
        m = _SPACE.match(self.s, self.i)
        self.nl = False
        if m:
            gap = m.group()
            self.nl = "\n" in gap or "\r" in gap
            self.i = m.end()
        self.at = self.i
        if self.i >= len(self.s):
            self.k, self.v = "eof", ""
            return
        c = self.s[self.i]
        if c in "\"'":
            m = _STRING.match(self.s, self.i)
            self.k = "str"
        elif c == "`":
            self.k, self.v = "`", "`"
            self.i += 1
            return
        elif c.isdigit() or (c == "." and self.s[self.i + 1 : self.i + 2].isdigit()):
            m = _NUMBER.match(self.s, self.i)
            self.k = "num"
            if m and _IDENT.match(self.s, m.end()):
                raise JsError("name after number")
        elif c == "/" and self.s[self.i : self.i + 2] == "/*":
            raise JsError("open comment")
        elif c == "/" and regex:
            m = _REGEX.match(self.s, self.i)
            self.k = "regex"
        else:
            m = _IDENT.match(self.s, self.i)
            self.k = "id"
            if not m:
                m = _PUNCT.match(self.s, self.i)
                self.k = "p"
        if not m:
            raise JsError(f"unexpected {c!r}")
        self.v = m.group()
        self.i = m.end()

    def again(self, regex: bool) -> None:
        """Scan the current token anew in another context."""
        nl = self.nl
        self.i = self.at
        self.next(regex)
        self.nl = nl or self.nl

    def save(self):
        return self.i, self.k, self.v, self.nl, self.at

    def load(self, state) -> None:
        self.i, self.k, self.v, self.nl, self.at = state

    def is_p(self, v: str) -> bool:
        return self.k == "p" and self.v == v

    def is_w(self, v: str) -> bool:
        return self.k == "id" and self.v == v

    def eat(self, v: str, regex: bool = True) -> bool:
        if self.k in ("p", "id") and self.v == v:
            self.next(regex)
            return True
        return False

    def need(self, v: str, regex: bool = True) -> None:
        if not self.eat(v, regex):
            raise JsError(f"expected {v}, found {self.v!r}")

    def semicolon(self) -> None:
        if self.eat(";"):
            return
        if self.k == "eof" or self.is_p("}") or self.nl:
            return
        raise JsError(f"unexpected {self.v!r}")

    def name(self, regex: bool = False) -> None:
        if self.k != "id" or self.v in RESERVED:
            raise JsError(f"expected a name, found {self.v!r}")
        self.next(regex)

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > DEEPEST:
            raise JsError("nested too deeply")

    # -- statements
    def program(self) -> None:
        while self.k != "eof":
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        while not self.is_p("}"):
            if self.k == "eof":
                raise JsError("open block")
            self.statement()
        self.next(True)

    def statement(self, top: bool = False) -> None:
        self.deeper()
        try:
            self._statement(top)
        finally:
            self.depth -= 1

    def _statement(self, top: bool) -> None:
        if self.k == "p":
            if self.v == "{":
                return self.block()
            if self.v == ";":
                return self.next(True)
            if self.v == "@":
                self.decorators()
                return self._statement(top)
        if self.k == "id":
            w = self.v
            fn = getattr(self, "s_" + w, None)
            if fn and (w in RESERVED or w in ("let", "async")):
                if fn(top) is not False:
                    return
            state = self.save()
            if w not in RESERVED:
                self.next(False)
                if self.is_p(":"):
                    self.next(True)
                    return self.statement()
                self.load(state)
        self.expression()
        self.semicolon()

    def s_var(self, _: bool) -> None:
        self.next(True)
        self.declarations(True)
        self.semicolon()

    def s_const(self, top: bool):
        return self.s_var(top)

    def s_let(self, top: bool):
        state = self.save()
        self.next(False)
        if self.k == "id" and self.v not in RESERVED or self.is_p("{") or self.is_p("["):
            self.declarations(True)
            self.semicolon()
            return None
        self.load(state)
        return False

    def declarations(self, allow_in: bool) -> None:
        while True:
            self.pattern()
            if self.eat("="):
                self.assignment(allow_in)
            if not self.eat(","):
                return

    def s_function(self, _: bool) -> None:
        self.function(True)
        self.again(True)

    def s_async(self, top: bool):
        state = self.save()
        self.next(False)
        if self.is_w("function") and not self.nl:
            self.function(True)
            self.again(True)
            return None
        self.load(state)
        return False

    def s_class(self, _: bool) -> None:
        self.class_(True)
        self.again(True)

    def s_if(self, _: bool) -> None:
        self.next(True)
        self.need("(")
        self.expression()
        self.need(")")
        self.statement()
        if self.eat("else"):
            self.statement()

    def s_while(self, _: bool) -> None:
        self.next(True)
        self.need("(")
        self.expression()
        self.need(")")
        self.statement()

    def s_with(self, top: bool) -> None:
        self.s_while(top)

    def s_do(self, _: bool) -> None:
        self.next(True)
        self.statement()
        self.need("while")
        self.need("(")
        self.expression()
        self.need(")")
        self.eat(";")

    def s_for(self, _: bool) -> None:
        self.next(True)
        self.eat("await")
        self.need("(")
        if not self.is_p(";"):
            state = self.save()
            declared = False
            if self.is_w("var") or self.is_w("const") or self.is_w("let"):
                let = self.v == "let"
                self.next(False)
                if not let or self.k == "id" and self.v not in ("in", "of") or self.is_p("[") or self.is_p("{"):
                    self.declarations(False)
                    declared = True
                else:
                    self.load(state)
            if not declared:
                self.expression(False)
            if self.eat("of"):
                self.assignment()
                self.need(")")
                return self.statement()
            if self.eat("in"):
                self.expression()
                self.need(")")
                return self.statement()
        self.need(";")
        if not self.is_p(";"):
            self.expression()
        self.need(";")
        if not self.is_p(")"):
            self.expression()
        self.need(")")
        self.statement()

    def s_return(self, _: bool) -> None:
        if not self.functions:
            raise JsError("return outside a function")
        self.next(True)
        if not (self.nl or self.k == "eof" or self.is_p(";") or self.is_p("}")):
            self.expression()
        self.semicolon()

    def s_throw(self, _: bool) -> None:
        self.next(True)
        if self.nl:
            raise JsError("line break after throw")
        self.expression()
        self.semicolon()

    def s_break(self, _: bool) -> None:
        self.next(True)
        if self.k == "id" and not self.nl and self.v not in RESERVED:
            self.next(True)
        self.semicolon()

    def s_continue(self, top: bool) -> None:
        self.s_break(top)

    def s_debugger(self, _: bool) -> None:
        self.next(True)
        self.semicolon()

    def s_try(self, _: bool) -> None:
        self.next(True)
        self.block()
        handled = False
        if self.eat("catch"):
            handled = True
            if self.eat("("):
                self.pattern()
                self.need(")")
            self.block()
        if self.eat("finally"):
            handled = True
            self.block()
        if not handled:
            raise JsError("try without catch")

    def s_switch(self, _: bool) -> None:
        self.next(True)
        self.need("(")
        self.expression()
        self.need(")")
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not (self.is_p("}") or self.is_w("case") or self.is_w("default")):
                if self.k == "eof":
                    raise JsError("open switch")
                self.statement()

    def s_import(self, top: bool):
        state = self.save()
        self.next(False)
        if self.is_p("(") or self.is_p("."):
            self.load(state)
            return False
        if not top:
            raise JsError("import inside a block")
        if self.k == "str":
            self.next(True)
            self.semicolon()
            return None
        if self.k == "id" and not self.is_w("from"):
            self.name()
            if self.eat(","):
                self.clause()
        elif self.is_w("from"):
            self.name()
        else:
            self.clause()
        self.from_()
        return None

    def clause(self) -> None:
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.names()

    def names(self) -> None:
        self.need("{")
        while not self.is_p("}"):
            self.any_name()
            if self.eat("as"):
                self.any_name()
            if not self.eat(","):
                break
        self.need("}", False)

    def any_name(self) -> None:
        if self.k not in ("id", "str"):
            raise JsError(f"expected a name, found {self.v!r}")
        self.next(False)

    def from_(self) -> None:
        self.need("from")
        if self.k != "str":
            raise JsError("expected a module")
        self.next(True)
        if (self.is_w("with") or self.is_w("assert")) and not self.nl:
            self.next(True)
            self.assignment()
        self.semicolon()

    def s_export(self, top: bool) -> None:
        if not top:
            raise JsError("export inside a block")
        self.next(True)
        if self.eat("default"):
            if self.is_w("function") or self.is_w("class"):
                self.function(False) if self.v == "function" else self.class_(False)
                return self.again(True)
            self.assignment()
            return self.semicolon()
        if self.eat("*"):
            if self.eat("as"):
                self.any_name()
            return self.from_()
        if self.is_p("{"):
            self.names()
            if self.is_w("from"):
                return self.from_()
            self.again(True)
            return self.semicolon()
        if self.k == "id" and self.v in ("var", "let", "const", "function", "class", "async") or self.is_p("@"):
            return self._statement(True)
        raise JsError(f"unexpected {self.v!r}")

    # -- patterns, functions, classes
    def pattern(self) -> None:
        self.deeper()
        if self.eat("["):
            while not self.is_p("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.pattern()
                if self.eat("="):
                    self.assignment()
                if not self.is_p("]"):
                    self.need(",")
            self.next(False)
        elif self.eat("{"):
            while not self.is_p("}"):
                if self.eat("..."):
                    self.pattern()
                else:
                    computed = self.is_p("[")
                    plain = self.k == "id" and self.v not in RESERVED
                    self.key()
                    if self.eat(":"):
                        self.pattern()
                    elif computed or not plain:
                        raise JsError("bad pattern")
                    if self.eat("="):
                        self.assignment()
                if not self.is_p("}"):
                    self.need(",")
            self.next(False)
        else:
            self.name()
        self.depth -= 1

    def key(self) -> None:
        if self.eat("["):
            self.assignment()
            self.need("]", False)
        elif self.k in ("id", "str", "num"):
            self.next(False)
        elif self.is_p("#"):
            self.next(False)
            if self.k != "id":
                raise JsError("bad private name")
            self.next(False)
        else:
            raise JsError(f"unexpected {self.v!r}")

    def params(self) -> None:
        self.need("(")
        while not self.is_p(")"):
            self.eat("...")
            self.pattern()
            if self.eat("="):
                self.assignment()
            if not self.is_p(")"):
                self.need(",")
        self.next(True)

    def body(self) -> None:
        """A function's block; the current token afterwards is scanned as an operand's follower."""
        self.functions += 1
        self.deeper()
        self.need("{")
        while not self.is_p("}"):
            if self.k == "eof":
                raise JsError("open function")
            self.statement()
        self.depth -= 1
        self.functions -= 1
        self.next(False)

    def function(self, named: bool) -> None:
        self.need("function", False)
        self.eat("*")
        if self.k == "id":
            self.name()
        elif named:
            raise JsError("function without a name")
        self.params()
        self.body()

    def decorators(self) -> None:
        while self.eat("@"):
            self.postfix()
            self.again(True)

    def class_(self, named: bool) -> None:
        self.need("class", False)
        if self.k == "id" and self.v != "extends":
            self.name()
        elif named:
            raise JsError("class without a name")
        if self.eat("extends"):
            self.postfix()
        self.need("{")
        while not self.is_p("}"):
            if self.eat(";"):
                continue
            if self.is_p("@"):
                self.decorators()
            self.member()
        self.next(False)

    def member(self) -> None:
        for w in ("static", "async", "get", "set"):
            if self.is_w(w):
                state = self.save()
                self.next(False)
                if self.is_p("(") or self.is_p("=") or self.is_p(";") or self.is_p("}"):
                    self.load(state)
                    break
                if w == "static" and self.is_p("{"):
                    self.functions += 1
                    self.block()
                    self.functions -= 1
                    return
        self.eat("*", False)
        self.key()
        if self.is_p("("):
            self.params()
            self.body()
            self.again(True)
            return
        if self.eat("="):
            self.assignment()
        self.semicolon()

    # -- expressions
    def expression(self, allow_in: bool = True) -> None:
        self.assignment(allow_in)
        while self.eat(","):
            self.assignment(allow_in)

    def assignment(self, allow_in: bool = True) -> None:
        self.deeper()
        try:
            if self.arrow():
                return
            if self.is_w("yield") and self.functions:
                self.next(True)
                if not (self.nl or self.k == "eof" or self.k == "p" and self.v in ")]};,:"):
                    self.eat("*")
                    self.assignment(allow_in)
                return
            target = self.conditional(allow_in)
            if self.k == "p" and self.v in _ASSIGN:
                if not target:
                    raise JsError("bad assignment")
                self.next(True)
                self.assignment(allow_in)
        finally:
            self.depth -= 1

    def arrow(self) -> bool:
        """An arrow function at this place, if there is one."""
        state = self.save()
        if self.is_w("async"):
            self.next(False)
            if self.nl or not (self.k == "id" and self.v not in RESERVED or self.is_p("(")):
                self.load(state)
                return False
        if self.k == "id" and self.v not in RESERVED:
            self.next(False)
            if not self.is_p("=>") or self.nl:
                self.load(state)
                return False
        elif self.is_p("("):
            if not self.closes_before_arrow():
                self.load(state)
                return False
            self.params()
        else:
            self.load(state)
            return False
        self.need("=>")
        if self.is_p("{"):
            self.body()
        else:
            self.functions += 1
            self.assignment()
            self.functions -= 1
        return True

    def closes_before_arrow(self) -> bool:
        """Whether ``=>`` follows the bracket that closes the one here (a look ahead over tokens)."""
        state = self.save()
        depth = 0
        try:
            while self.k != "eof":
                if self.k == "`":
                    self.template()
                    continue
                if self.k == "p" and self.v in "([{":
                    depth += 1
                elif self.k == "p" and self.v in ")]}":
                    depth -= 1
                    if depth == 0:
                        self.next(False)
                        return self.is_p("=>") and not self.nl
                self.next(not (self.k in ("id", "num", "str", "regex") and self.v not in ("return", "typeof", "case", "in", "of") or self.k == "p" and self.v in ")]}"))
        except JsError:
            return False
        finally:
            self.load(state)
        return False

    def conditional(self, allow_in: bool) -> bool:
        target = self.binary(0, allow_in)
        if self.is_p("?"):
            self.next(True)
            self.assignment()
            self.need(":")
            self.assignment(allow_in)
            return False
        return target

    def binary(self, least: int, allow_in: bool) -> bool:
        target = self.unary()
        while True:
            if self.k not in ("p", "id"):
                return target
            p = _BINARY.get(self.v)
            if p is None or p <= least or (self.v == "in" and not allow_in):
                return target
            self.next(True)
            self.binary(p - 1 if p == 12 else p, allow_in)
            target = False

    def unary(self) -> bool:
        n = 0
        while self.k == "p" and self.v in ("!", "~", "+", "-", "++", "--") or self.k == "id" and self.v in ("typeof", "void", "delete") or self.is_w("await") and self.functions >= 0:
            if self.is_w("await"):
                state = self.save()
                self.next(True)
                if self.k == "eof" or self.k == "p" and self.v not in ("(", "[", "{", "!", "+", "-", "~"):
                    self.load(state)
                    break
            else:
                self.next(True)
            n += 1
        if self.is_p("#"):
            self.key()
            return False
        target = self.postfix()
        if self.k == "p" and self.v in ("++", "--") and not self.nl:
            if not target:
                raise JsError("bad increment")
            self.next(False)
            return False
        return target and not n

    def postfix(self) -> bool:
        target = self.primary()
        while True:
            if self.k == "`":
                self.template()
                target = False
            elif self.k != "p":
                return target
            elif self.v in (".", "?."):
                optional = self.v == "?."
                self.next(False)
                if optional and self.is_p("("):
                    self.arguments()
                    target = False
                elif optional and self.is_p("["):
                    self.next(True)
                    self.expression()
                    self.need("]", False)
                    target = True
                else:
                    if self.is_p("#"):
                        self.next(False)
                    if self.k != "id":
                        raise JsError(f"expected a property, found {self.v!r}")
                    self.next(False)
                    target = True
            elif self.v == "[":
                self.next(True)
                self.expression()
                self.need("]", False)
                target = True
            elif self.v == "(":
                self.arguments()
                target = False
            else:
                return target

    def arguments(self) -> None:
        self.need("(")
        while not self.is_p(")"):
            self.eat("...")
            self.assignment()
            if not self.is_p(")"):
                self.need(",")
        self.next(False)

    def template(self) -> None:
        """From behind the opening backtick to behind the closing one."""
        s = self.s
        i = self.at + 1
        while True:
            if i >= len(s):
                raise JsError("open template")
            c = s[i]
            if c == "\\":
                i += 2
            elif c == "`":
                self.i = i + 1
                return self.next(False)
            elif c == "$" and s[i + 1 : i + 2] == "{":
                self.i = i + 2
                self.next(True)
                self.expression()
                if not self.is_p("}"):
                    raise JsError("open template expression")
                i = self.at + 1
            else:
                i += 1

    def primary(self) -> bool:
        if self.k in ("num", "str", "regex"):
            self.next(False)
            return False
        if self.k == "`":
            self.template()
            return False
        if self.k == "id":
            w = self.v
            if w == "function":
                self.function(False)
                return False
            if w == "class":
                self.class_(False)
                return False
            if w == "async":
                state = self.save()
                self.next(False)
                if self.is_w("function") and not self.nl:
                    self.function(False)
                    return False
                self.load(state)
            if w == "new":
                self.next(True)
                if self.is_p("."):
                    self.next(False)
                    self.name()
                    return False
                return self.postfix() and False
            if w == "import":
                self.next(False)
                if self.is_p("("):
                    self.arguments()
                else:
                    self.need(".", False)
                    self.name()
                return False
            if w in ("this", "null", "true", "false"):
                self.next(False)
                return False
            if w == "super":
                self.next(False)
                if not (self.is_p("(") or self.is_p(".") or self.is_p("[")):
                    raise JsError("bare super")
                return False
            self.name()
            return True
        if self.k == "p":
            if self.v == "(":
                self.next(True)
                self.expression()
                self.need(")", False)
                return True
            if self.v == "[":
                self.next(True)
                while not self.is_p("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assignment()
                    if not self.is_p("]"):
                        self.need(",")
                self.next(False)
                return True
            if self.v == "{":
                self.object()
                return True
            if self.v == "@":
                self.decorators()
                self.class_(False)
                return False
        raise JsError(f"unexpected {self.v or 'end'!r}")

    def object(self) -> None:
        self.need("{", False)
        while not self.is_p("}"):
            if self.eat("..."):
                self.assignment()
            else:
                plain = self.k == "id"
                for w in ("async", "get", "set"):
                    if self.is_w(w):
                        state = self.save()
                        self.next(False)
                        if self.k == "p" and self.v in "(,:}=":
                            self.load(state)
                        else:
                            plain = False
                        break
                if self.eat("*", False):
                    plain = False
                word = self.v
                self.key()
                if self.is_p("("):
                    self.params()
                    self.body()
                elif self.eat(":"):
                    self.assignment()
                elif plain and word not in RESERVED:
                    if self.eat("="):
                        self.assignment()
                else:
                    raise JsError("bad property")
            if not self.is_p("}"):
                self.need(",", False)
        self.next(False)


def check(text: str) -> None:
    """Raise :class:`JsError` if ``text`` is not a JavaScript program."""
    try:
        Parser(text).program()
    except RecursionError as e:
        raise JsError("nested too deeply") from e
