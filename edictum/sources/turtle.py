"""A parser for the part of Turtle that states and shapes use.

Prefixes, ``a``, predicate and object lists, blank-node property lists, collections,
short and long strings, typed and language-tagged literals, numbers and booleans.
Documents of this kind are configuration: they are read whole on the driver.
"""

from __future__ import annotations

import re

from edictum.sources.terms import BOOLEAN, DECIMAL, INTEGER, RDF_TYPE, XSD, Term, iri

RDF = RDF_TYPE.removesuffix("type")

_TOKEN = re.compile(
    r'"""(?P<long>(?:[^"\\]|\\.|"(?!""))*)"""'
    r'|"(?P<short>(?:[^"\\\n]|\\.)*)"'
    r"|<(?P<iri>[^<>\s]*)>"
    r"|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w:])"
    r"|(?P<name>@?[A-Za-z_][\w.-]*(?<!\.):?(?:[\w-]+(?:\.[\w-]+)*)?|:[\w-]*)"
    r"|(?P<mark>\^\^|[;,.\[\]()])"
    r"|(?P<skip>\s+|\#[^\n]*)",
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text)


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise ValueError(f"unexpected text at {text[at:at + 30]!r}")
            if found.lastgroup != "skip":
                self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at, self.prefixes, self.blank, self.triples = 0, {"xsd": XSD, "rdf": RDF}, 0, []

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self):
        found = self.peek()
        self.at += 1
        return found

    def expect(self, mark: str) -> None:
        if self.next() != ("mark", mark):
            raise ValueError(f"{mark!r} expected before token {self.at}")

    def fresh(self) -> Term:
        self.blank += 1
        return iri(f"_:b{self.blank}")

    def expand(self, name: str) -> str:
        prefix, _, local = name.partition(":")
        return self.prefixes[prefix] + local

    def document(self) -> list[tuple[str, str, Term]]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if kind == "name" and value.lower().lstrip("@") == "prefix":
                self.next()
                name, target = self.next()[1], self.next()[1]
                self.prefixes[name.rstrip(":")] = target
                if self.peek() == ("mark", "."):
                    self.next()
                continue
            subject = self.term()
            if self.peek() != ("mark", "."):
                self.properties(subject)
            self.expect(".")
        return self.triples

    def properties(self, subject: Term) -> None:
        while True:
            predicate = self.term()
            while True:
                self.triples.append((subject.lex, predicate.lex, self.term()))
                if self.peek() != ("mark", ","):
                    break
                self.next()
            if self.peek() != ("mark", ";"):
                return
            while self.peek() == ("mark", ";"):
                self.next()
            if self.peek() in (("mark", "."), ("mark", "]")):
                return

    def term(self) -> Term:
        kind, value = self.next()
        if kind in ("long", "short"):
            text = _unescape(value)
            if self.peek() == ("mark", "^^"):
                self.next()
                return Term("lit", text, self.term().lex)
            if self.peek()[0] == "name" and self.peek()[1].startswith("@"):
                self.next()
            return Term("lit", text)
        if kind == "iri":
            return iri(value)
        if kind == "number":
            return Term("lit", value, DECIMAL if "." in value else INTEGER)
        if kind == "name":
            if value == "a":
                return iri(RDF_TYPE)
            if value in ("true", "false"):
                return Term("lit", value, BOOLEAN)
            return iri(self.expand(value))
        if value == "[":
            node = self.fresh()
            if self.peek() != ("mark", "]"):
                self.properties(node)
            self.expect("]")
            return node
        if value == "(":
            items = []
            while self.peek() != ("mark", ")"):
                items.append(self.term())
            self.next()
            rest = iri(RDF + "nil")
            for item in reversed(items):
                node = self.fresh()
                self.triples += [(node.lex, RDF + "first", item), (node.lex, RDF + "rest", rest)]
                rest = node
            return rest
        raise ValueError(f"unexpected {value!r}")


def parse_turtle(text: str) -> list[tuple[str, str, Term]]:
    return _Reader(text).document()
