"""openCypher text to an abstract syntax tree.

A tokenizer of one regular expression and a recursive-descent parser. Nodes are
small tuples whose first item names their kind; clauses are dictionaries. The
tree says nothing of execution: lowering turns it into DataFrame operations.
"""

from __future__ import annotations

import re
from typing import Any


class CypherSyntaxError(ValueError):
    """The text is not a query of the language."""


_TOKEN = re.compile(
    r"""(?P<space>[\s]+|//[^\n]*|/\*.*?\*/)
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    |(?P<int>0[xX][0-9a-fA-F]+|0o[0-7]+|\d+)
    |(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<param>\$(?:\w+|`[^`]+`))
    |(?P<name>[^\W\d]\w*|`(?:[^`]|``)+`)
    |(?P<op><>|<=|>=|=~|\.\.|\+=|[-+*/%^=<>()\[\]{},:;.|$!&])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\\": "\\", "'": "'", '"': '"', "`": "`"}


def _unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        c = m.group(1)
        if c[0] in "uU":
            return chr(int(c[1:], 16))
        if c not in _ESCAPES:
            raise CypherSyntaxError(f"unknown escape \\{c}")
        return _ESCAPES[c]

    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, body, flags=re.DOTALL)


def tokenize(text: str) -> list[tuple[str, Any, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherSyntaxError(f"unexpected character {text[at]!r} at {at}")
        kind, raw = m.lastgroup, m.group()
        if kind == "float":
            out.append(("num", float(raw), at))
        elif kind == "int":
            value = int(raw, 16) if raw[:2].lower() == "0x" else int(raw[2:], 8) if raw[:2] == "0o" else int(raw)
            out.append(("num", value, at))
        elif kind == "str":
            out.append(("str", _unescape(raw[1:-1]), at))
        elif kind == "param":
            out.append(("param", raw[1:].strip("`"), at))
        elif kind == "name":
            out.append(("quoted", raw[1:-1].replace("``", "`"), at) if raw[0] == "`" else ("name", raw, at))
        elif kind == "op":
            out.append(("op", raw, at))
        at = m.end()
    out.append(("end", None, at))
    return out


_CLAUSES = {"MATCH", "OPTIONAL", "WITH", "RETURN", "UNWIND", "CALL", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "FOREACH", "LOAD", "UNION", "WHERE", "ORDER", "SKIP", "LIMIT", "ON", "YIELD"}
_QUANTIFIERS = {"any", "all", "none", "single"}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokenize(text), 0

    # tokens -----------------------------------------------------------------
    def peek(self, ahead: int = 0):
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)]

    def word(self, *words: str, ahead: int = 0) -> bool:
        kind, value, _ = self.peek(ahead)
        return kind == "name" and value.upper() in words

    def op(self, *ops: str, ahead: int = 0) -> bool:
        kind, value, _ = self.peek(ahead)
        return kind == "op" and value in ops

    def take(self):
        token = self.tokens[self.i]
        self.i += 1
        return token

    def fail(self, what: str):
        kind, value, at = self.peek()
        raise CypherSyntaxError(f"expected {what} at {at}, found {value if kind != 'end' else 'the end'}")

    def accept(self, *words: str) -> bool:
        if all(self.word(w, ahead=k) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def accept_op(self, op: str) -> bool:
        if self.op(op):
            self.i += 1
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            self.fail(" ".join(words))

    def expect_op(self, op: str) -> None:
        if not self.accept_op(op):
            self.fail(op)

    def name(self) -> str:
        kind, value, _ = self.peek()
        if kind not in ("name", "quoted"):
            self.fail("a name")
        self.i += 1
        return value

    # statements -------------------------------------------------------------
    def statement(self) -> dict:
        mode = "explain" if self.accept("EXPLAIN") else "profile" if self.accept("PROFILE") else None
        body = self.schema_statement() or self.union()
        self.accept_op(";")
        if self.peek()[0] != "end":
            self.fail("the end of the query")
        return body | {"mode": mode}

    def schema_statement(self) -> dict | None:
        for verb in ("CREATE", "DROP", "SHOW"):
            if not self.word(verb):
                continue
            point = self.word("POINT", ahead=1)
            what = self.peek(1 + point)
            if what[0] != "name" or what[1].upper() not in ("INDEX", "INDEXES", "CONSTRAINT", "CONSTRAINTS"):
                return None
            self.i += 2 + point
            kind = "constraint" if what[1].upper().startswith("CONSTRAINT") else "point_index" if point else "index"
            if verb == "SHOW":
                return {"kind": "schema", "verb": "show", "what": kind}
            out = {"kind": "schema", "verb": verb.lower(), "what": kind, "name": None, "guard": False}
            if kind == "constraint":
                if not self.word("FOR", "IF"):
                    out["name"] = self.name()
                if self.accept("IF"):
                    self.accept("NOT")
                    self.expect("EXISTS")
                    out["guard"] = True
                if verb == "DROP":
                    return out
            self.expect("FOR")
            self.expect_op("(")
            if self.accept_op(")"):
                for t in "-[":
                    self.expect_op(t)
                self.name()
                self.expect_op(":")
                out |= {"scope": "relationship", "label": self.name()}
                self.expect_op("]")
                self.accept_op("-")
                self.accept_op(">")
                self.expect_op("(")
                self.expect_op(")")
            else:
                self.name()
                self.expect_op(":")
                out |= {"scope": "node", "label": self.name()}
                self.expect_op(")")
            if kind != "constraint":
                self.expect("ON")
                out["properties"] = self.property_list()
                return out
            self.expect("REQUIRE")
            out["properties"] = self.property_list() if self.op("(") else [self.bare_property()]
            self.expect("IS")
            if self.accept("UNIQUE"):
                out["type"] = "UNIQUE"
            elif self.accept("NOT", "NULL"):
                out["type"] = "NOT NULL"
            elif self.accept("NODE", "KEY"):
                out["type"] = "NODE KEY"
            else:
                self.expect_op(":")
                self.expect_op(":")
                out["type"] = "IS :: " + self.name().upper()
            return out
        return None

    def bare_property(self) -> str:
        self.name()
        self.expect_op(".")
        return self.name()

    def property_list(self) -> list[str]:
        self.expect_op("(")
        out = [self.bare_property()]
        while self.accept_op(","):
            out.append(self.bare_property())
        self.expect_op(")")
        return out

    def union(self) -> dict:
        parts, every = [self.single()], None
        while self.accept("UNION"):
            this = self.accept("ALL")
            if every is not None and this != every:
                raise CypherSyntaxError("UNION and UNION ALL cannot be mixed")
            every = this
            parts.append(self.single())
        return {"kind": "union", "parts": parts, "all": bool(every)}

    def single(self) -> list[dict]:
        clauses = []
        while True:
            kind, value, _ = self.peek()
            if kind != "name" or value.upper() == "UNION":
                break
            clauses.append(self.clause())
        if not clauses:
            self.fail("a clause")
        return clauses

    def clause(self) -> dict:
        if self.accept("OPTIONAL", "MATCH"):
            return {"kind": "match", "optional": True} | self.match_body()
        if self.accept("MATCH"):
            return {"kind": "match", "optional": False} | self.match_body()
        if self.accept("WITH"):
            return {"kind": "with"} | self.projection(True)
        if self.accept("RETURN"):
            return {"kind": "return"} | self.projection(False)
        if self.accept("UNWIND"):
            e = self.expr()
            self.expect("AS")
            return {"kind": "unwind", "expr": e, "var": self.name()}
        if self.accept("CALL"):
            return self.call()
        if self.accept("CREATE"):
            return {"kind": "create", "patterns": self.patterns()}
        if self.accept("MERGE"):
            out = {"kind": "merge", "pattern": self.pattern(), "on_create": [], "on_match": []}
            while self.accept("ON"):
                which = "on_create" if self.accept("CREATE") else "on_match"
                if which == "on_match":
                    self.expect("MATCH")
                self.expect("SET")
                out[which] += self.set_items()
            return out
        if self.accept("SET"):
            return {"kind": "set", "items": self.set_items()}
        if self.accept("REMOVE"):
            return {"kind": "remove", "items": self.remove_items()}
        if self.word("DETACH", "DELETE"):
            detach = self.accept("DETACH")
            self.expect("DELETE")
            items = [self.expr()]
            while self.accept_op(","):
                items.append(self.expr())
            return {"kind": "delete", "detach": detach, "items": items}
        if self.accept("FOREACH"):
            self.expect_op("(")
            var = self.name()
            self.expect("IN")
            source = self.expr()
            self.expect_op("|")
            body = []
            while not self.accept_op(")"):
                body.append(self.clause())
            return {"kind": "foreach", "var": var, "list": source, "body": body}
        if self.accept("LOAD", "CSV"):
            headers = self.accept("WITH", "HEADERS")
            self.expect("FROM")
            e = self.expr()
            self.expect("AS")
            return {"kind": "load_csv", "headers": headers, "expr": e, "var": self.name()}
        self.fail("a clause")

    def match_body(self) -> dict:
        out = {"patterns": self.patterns(), "where": None}
        if self.accept("WHERE"):
            out["where"] = self.expr()
        return out

    def projection(self, is_with: bool) -> dict:
        out: dict = {"distinct": self.accept("DISTINCT"), "star": False, "items": [], "order": [], "skip": None, "limit": None, "where": None}
        if self.accept_op("*"):
            out["star"] = True
            if self.accept_op(","):
                out["items"] = self.items()
        else:
            out["items"] = self.items()
        if self.accept("ORDER", "BY"):
            while True:
                e = self.expr()
                down = self.accept("DESC") or self.accept("DESCENDING")
                if not down:
                    self.accept("ASC") or self.accept("ASCENDING")
                out["order"].append((e, down))
                if not self.accept_op(","):
                    break
        if self.accept("SKIP"):
            out["skip"] = self.expr()
        if self.accept("LIMIT"):
            out["limit"] = self.expr()
        if is_with and self.accept("WHERE"):
            out["where"] = self.expr()
        if is_with:
            for e, alias, _ in out["items"]:
                if alias is None and e[0] != "var":
                    raise CypherSyntaxError("an expression in WITH needs an alias")
        names = [alias or text for _, alias, text in out["items"]]
        if len(set(names)) < len(names):
            raise CypherSyntaxError("a column name is used twice")
        return out

    def items(self) -> list[tuple]:
        out = []
        while True:
            begin = self.peek()[2]
            e = self.expr()
            stop = self.tokens[self.i - 1]
            text = self.text[begin:self.peek()[2]].strip() if stop else ""
            out.append((e, self.name() if self.accept("AS") else None, text))
            if not self.accept_op(","):
                return out

    def call(self) -> dict:
        if self.accept_op("{"):
            body = self.union()
            self.expect_op("}")
            out = {"kind": "subquery", "body": body, "batches": None}
            if self.accept("IN"):
                rows = None
                if not self.word("TRANSACTIONS"):
                    rows = self.expr()
                self.expect("TRANSACTIONS")
                out["batches"] = {"rows": rows, "on_error": "fail", "report": None}
                while True:
                    if self.accept("OF"):
                        out["batches"]["rows"] = self.expr()
                        self.accept("ROWS") or self.expect("ROW")
                    elif self.accept("ON", "ERROR"):
                        out["batches"]["on_error"] = self.name().lower()
                    elif self.accept("REPORT", "STATUS"):
                        self.expect("AS")
                        out["batches"]["report"] = self.name()
                    else:
                        break
            return out
        parts = [self.name()]
        while self.accept_op("."):
            parts.append(self.name())
        out = {"kind": "procedure", "name": ".".join(parts), "args": None, "yields": None, "where": None}
        if self.accept_op("("):
            out["args"] = self.exprs(")")
        if self.accept("YIELD"):
            if self.accept_op("*"):
                out["yields"] = "*"
            else:
                out["yields"] = []
                while True:
                    n = self.name()
                    out["yields"].append((n, self.name() if self.accept("AS") else n))
                    if not self.accept_op(","):
                        break
            if self.accept("WHERE"):
                out["where"] = self.expr()
        return out

    def set_items(self) -> list[tuple]:
        out = []
        while True:
            target = self.postfix(self.atom(), labels=False)
            if target[0] == "var" and self.op(":"):
                out.append(("labels", target[1], self.label_names()))
            elif self.accept_op("+="):
                out.append(("merge", target[1], self.expr()))
            else:
                self.expect_op("=")
                value = self.expr()
                out.append(("replace", target[1], value) if target[0] == "var" else ("prop", target[1], target[2], value))
            if not self.accept_op(","):
                return out

    def remove_items(self) -> list[tuple]:
        out = []
        while True:
            target = self.postfix(self.atom(), labels=False)
            if target[0] == "var":
                out.append(("labels", target[1], self.label_names()))
            else:
                out.append(("prop", target[1], target[2]))
            if not self.accept_op(","):
                return out

    def label_names(self) -> list[str]:
        out = []
        while self.accept_op(":"):
            out.append(self.name())
            while self.accept_op("&"):
                out.append(self.name())
        return out

    # patterns ---------------------------------------------------------------
    def patterns(self) -> list[dict]:
        out = [self.pattern()]
        while self.accept_op(","):
            out.append(self.pattern())
        return out

    def pattern(self) -> dict:
        path = None
        if self.peek()[0] in ("name", "quoted") and self.op("=", ahead=1):
            path = self.name()
            self.i += 1
        short = None
        if self.word("SHORTESTPATH", "ALLSHORTESTPATHS") and self.op("(", ahead=1):
            short = "all" if self.take()[1].upper().startswith("ALL") else "one"
            self.expect_op("(")
        chain = self.chain()
        if short:
            self.expect_op(")")
        return {"path": path, "short": short, "nodes": chain[::2], "rels": chain[1::2]}

    def chain(self) -> list[dict]:
        out = [self.node()]
        while self.op("-", "<"):
            out.append(self.rel())
            out.append(self.node())
        return out

    def node(self) -> dict:
        self.expect_op("(")
        out: dict = {"var": None, "labels": [], "props": None}
        if self.peek()[0] in ("name", "quoted"):
            out["var"] = self.name()
        out["labels"] = self.label_names()
        if self.op("{"):
            out["props"] = self.map_literal()
        elif self.peek()[0] == "param":
            out["props"] = ("param", self.take()[1])
        self.expect_op(")")
        return out

    def rel(self) -> dict:
        left = self.accept_op("<")
        self.expect_op("-")
        out: dict = {"var": None, "types": [], "props": None, "length": None}
        if self.accept_op("["):
            if self.peek()[0] in ("name", "quoted"):
                out["var"] = self.name()
            if self.accept_op(":"):
                out["types"].append(self.name())
                while self.accept_op("|"):
                    self.accept_op(":")
                    out["types"].append(self.name())
            if self.accept_op("*"):
                low, high = 1, None
                if self.peek()[0] == "num":
                    low = self.take()[1]
                    high = low
                if self.accept_op(".."):
                    high = self.take()[1] if self.peek()[0] == "num" else None
                elif isinstance(low, float):
                    raise CypherSyntaxError("a hop count is an integer")
                out["length"] = (low, high)
            if self.op("{"):
                out["props"] = self.map_literal()
            self.expect_op("]")
        self.expect_op("-")
        right = self.accept_op(">")
        out["dir"] = "both" if left == right else "in" if left else "out"
        # Quantified forms behind the relationship: +, *, {n,m}.
        if self.accept_op("+"):
            out["length"] = (1, None)
        elif self.op("*"):
            self.i += 1
            out["length"] = (0, None)
        elif self.op("{"):
            self.i += 1
            low = self.take()[1] if self.peek()[0] == "num" else 0
            high = low
            if self.accept_op(","):
                high = self.take()[1] if self.peek()[0] == "num" else None
            self.expect_op("}")
            out["length"] = (low, high)
        return out

    # expressions ------------------------------------------------------------
    def expr(self):
        e = self.xor()
        while self.accept("OR"):
            e = ("bin", "OR", e, self.xor())
        return e

    def xor(self):
        e = self.conj()
        while self.accept("XOR"):
            e = ("bin", "XOR", e, self.conj())
        return e

    def conj(self):
        e = self.negation()
        while self.accept("AND"):
            e = ("bin", "AND", e, self.negation())
        return e

    def negation(self):
        if self.accept("NOT"):
            return ("un", "NOT", self.negation())
        return self.comparison()

    def comparison(self):
        e = self.predicate()
        terms = []
        left = e
        while self.op("=", "<>", "<", "<=", ">", ">="):
            o = self.take()[1]
            right = self.predicate()
            terms.append(("bin", o, left, right))
            left = right
        if not terms:
            return e
        out = terms[0]
        for t in terms[1:]:
            out = ("bin", "AND", out, t)
        return out

    def predicate(self):
        e = self.additive()
        while True:
            if self.accept("IS", "NULL"):
                e = ("isnull", e, True)
            elif self.accept("IS", "NOT", "NULL"):
                e = ("isnull", e, False)
            elif self.accept("STARTS", "WITH"):
                e = ("bin", "STARTS", e, self.additive())
            elif self.accept("ENDS", "WITH"):
                e = ("bin", "ENDS", e, self.additive())
            elif self.accept("CONTAINS"):
                e = ("bin", "CONTAINS", e, self.additive())
            elif self.accept("IN"):
                e = ("bin", "IN", e, self.additive())
            elif self.op("=~"):
                self.i += 1
                e = ("bin", "=~", e, self.additive())
            else:
                return e

    def additive(self):
        e = self.term()
        while self.op("+", "-"):
            e = ("bin", self.take()[1], e, self.term())
        return e

    def term(self):
        e = self.power()
        while self.op("*", "/", "%"):
            e = ("bin", self.take()[1], e, self.power())
        return e

    def power(self):
        e = self.unary()
        while self.accept_op("^"):
            e = ("bin", "^", e, self.unary())
        return e

    def unary(self):
        if self.accept_op("-"):
            inner = self.unary()
            if inner[0] == "lit" and isinstance(inner[1], (int, float)) and not isinstance(inner[1], bool):
                return ("lit", -inner[1])
            return ("un", "-", inner)
        if self.accept_op("+"):
            return self.unary()
        return self.postfix(self.atom())

    def postfix(self, e, labels: bool = True):
        while True:
            if self.accept_op("."):
                e = ("prop", e, self.name())
            elif self.op("["):
                self.i += 1
                if self.accept_op(".."):
                    e = ("slice", e, None, None if self.op("]") else self.expr())
                else:
                    a = self.expr()
                    if self.accept_op(".."):
                        e = ("slice", e, a, None if self.op("]") else self.expr())
                    else:
                        e = ("idx", e, a)
                self.expect_op("]")
            elif labels and self.op(":") and e[0] in ("var", "prop") and self.peek(1)[0] in ("name", "quoted"):
                e = ("label", e, self.label_names())
            elif e[0] == "var" and self.op("{") and self.op(".", ahead=1):
                e = self.map_projection(e)
            else:
                return e

    def map_projection(self, e):
        self.expect_op("{")
        items = []
        while not self.accept_op("}"):
            if self.accept_op("."):
                items.append(("*", None) if self.accept_op("*") else (k := self.name(), ("prop", e, k)))
            else:
                k = self.name()
                items.append((k, self.expr()) if self.accept_op(":") else (k, ("var", k)))
            self.accept_op(",")
        return ("mapproj", e, items)

    def exprs(self, stop: str) -> list:
        out = []
        if self.accept_op(stop):
            return out
        while True:
            out.append(self.expr())
            if self.accept_op(stop):
                return out
            self.expect_op(",")

    def map_literal(self):
        self.expect_op("{")
        out = {}
        while not self.accept_op("}"):
            kind, value, _ = self.take()
            if kind not in ("name", "quoted", "str"):
                raise CypherSyntaxError("a map key is a name")
            self.expect_op(":")
            out[value] = self.expr()
            if not self.op("}"):
                self.expect_op(",")
        return ("map", out)

    def atom(self):
        kind, value, at = self.peek()
        if kind in ("num", "str"):
            self.i += 1
            return ("lit", value)
        if kind == "param":
            self.i += 1
            return ("param", value)
        if kind == "op" and value == "(":
            # A pattern predicate, or an expression in parentheses.
            mark = self.i
            try:
                chain = self.chain()
                if len(chain) > 1:
                    return ("pattern", {"path": None, "short": None, "nodes": chain[::2], "rels": chain[1::2]})
            except CypherSyntaxError:
                pass
            self.i = mark + 1
            e = self.expr()
            self.expect_op(")")
            return e
        if kind == "op" and value == "[":
            return self.bracket()
        if kind == "op" and value == "{":
            return self.map_literal()
        if kind == "quoted":
            self.i += 1
            return ("var", value)
        if kind != "name":
            self.fail("an expression")
        low = value.lower()
        if low in ("true", "false", "null"):
            self.i += 1
            return ("lit", {"true": True, "false": False, "null": None}[low])
        if low == "case":
            return self.case()
        if low in ("exists", "count", "collect") and self.op("{", ahead=1):
            self.i += 2
            if self.op("(") or (self.peek()[0] in ("name", "quoted") and self.op("=", ahead=1)):
                patterns = self.patterns()
                where = self.expr() if self.accept("WHERE") else None
                body = {"kind": "union", "all": False, "parts": [[{"kind": "match", "optional": False, "patterns": patterns, "where": where}]]}
            else:
                body = self.union()
            self.expect_op("}")
            return ("sub", low, body)
        if self.op("(", ahead=1) or (self.op(".", ahead=1) and self._dotted_call()):
            return self.function()
        self.i += 1
        return ("var", value)

    def _dotted_call(self) -> bool:
        k = 0
        while self.peek(k)[0] == "name" and self.op(".", ahead=k + 1):
            k += 2
        return k > 0 and self.peek(k)[0] == "name" and self.op("(", ahead=k + 1) and (self.peek()[1].lower() in ("apoc", "date", "datetime", "localdatetime", "time", "localtime", "duration", "point"))

    def function(self):
        parts = [self.take()[1]]
        while self.accept_op("."):
            parts.append(self.name())
        name = ".".join(parts)
        low = name.lower()
        self.expect_op("(")
        if low in _QUANTIFIERS and self.peek()[0] in ("name", "quoted") and self.word("IN", ahead=1):
            var = self.name()
            self.i += 1
            source = self.expr()
            where = self.expr() if self.accept("WHERE") else ("lit", True)
            self.expect_op(")")
            return ("quant", low, var, source, where)
        if low == "reduce":
            acc = self.name()
            self.expect_op("=")
            init = self.expr()
            self.expect_op(",")
            var = self.name()
            self.expect("IN")
            source = self.expr()
            self.expect_op("|")
            body = self.expr()
            self.expect_op(")")
            return ("reduce", acc, init, var, source, body)
        if low == "count" and self.accept_op("*"):
            self.expect_op(")")
            return ("call", "count", False, None)
        distinct = self.accept("DISTINCT")
        return ("call", low, distinct, self.exprs(")"))

    def case(self):
        self.i += 1
        operand = None if self.word("WHEN") else self.expr()
        whens = []
        while self.accept("WHEN"):
            w = self.expr()
            self.expect("THEN")
            whens.append((w, self.expr()))
        other = self.expr() if self.accept("ELSE") else None
        self.expect("END")
        return ("case", operand, whens, other)

    def bracket(self):
        self.expect_op("[")
        if self.peek()[0] in ("name", "quoted") and self.word("IN", ahead=1):
            mark = self.i
            var = self.name()
            self.i += 1
            source = self.expr()
            where = self.expr() if self.accept("WHERE") else None
            body = self.expr() if self.accept_op("|") else None
            if self.accept_op("]"):
                if where is None and body is None:
                    return ("lcomp", var, source, None, None)
                return ("lcomp", var, source, where, body)
            self.i = mark
        mark = self.i
        try:
            pattern = self.pattern()
            if pattern["rels"]:
                where = self.expr() if self.accept("WHERE") else None
                self.expect_op("|")
                body = self.expr()
                self.expect_op("]")
                return ("patcomp", pattern, where, body)
        except CypherSyntaxError:
            pass
        self.i = mark
        return ("list", self.exprs("]"))


def parse(text: str) -> dict:
    return Parser(text).statement()
