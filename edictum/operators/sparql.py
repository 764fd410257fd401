"""A compiler for the SELECT queries of rule conditions and constraints.

``parse`` makes a small algebra; ``to_frame`` evaluates it over a quads DataFrame (g, s, p,
o) as joins, so Catalyst plans it; ``solve`` evaluates it over one component's graph in
memory, for constraints inside the resolution fold.

Triple patterns with one subject and constant predicates form a star.  A star is read in one
scan as a property table (one aggregation by subject) instead of a self-join per pattern.
Where repeated solutions don't matter (``bag`` false: rules, whose actions are told apart by
identity, and constraints) patterns whose object is used nowhere else only test existence.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edictum.operators.expressions import COMPARED, FUNCTIONS, Var, as_number, condition, evaluate, holds, same, value
from edictum.sources.shared import written
from edictum.sources.terms import BOOLEAN, DECIMAL, INTEGER, RDF_TYPE, TERM, XSD, Term, iri, number, term_column

_TOKEN = re.compile(
    r'(?P<string>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\]|\\.)*")|<(?P<iri>[^<>\s]*)>|[?$](?P<var>\w+)'
    r"|(?P<number>\d+(?:\.\d+)?)|(?P<op>\^\^|<=|>=|!=|&&|\|\||[<>=!+*/^|?-])|(?P<mark>[{}().;,])"
    r"|(?P<name>[A-Za-z_][\w-]*:[\w-]+|[A-Za-z_][\w-]*:?|:[\w-]+)|(?P<skip>\s+|\#[^\n]*)"
)

IN_BLOCK = 256  # rows of one side of a product


@dataclass(frozen=True)
class Path:
    """A property path: ``kind`` is seq, alt, inv, plus, star or opt; parts are IRIs or paths."""

    kind: str
    parts: tuple


@dataclass
class Select:
    columns: list  # (name, None) or (name, (function, argument variable))
    where: list
    group_by: list = field(default_factory=list)
    distinct: bool = False
    limit: int | None = None
    offset: int = 0
    having: list = field(default_factory=list)  # (name of a hidden column or None, condition)
    order: list = field(default_factory=list)  # (variable, descending)


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise ValueError(f"unexpected text at {text[at:at + 30]!r}")
            if found.lastgroup != "skip":
                self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at, self.prefixes, self.fresh = 0, {"xsd": XSD}, 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def word(self, *words: str) -> bool:
        kind, value = self.peek()
        if kind == "name" and value.upper() in words:
            self.at += 1
            return True
        return False

    def mark(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] in ("mark", "op"):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.mark(value):
            raise ValueError(f"{value!r} expected, found {self.peek()[1]!r}")

    def query(self) -> Select:
        while self.word("PREFIX"):
            name = self.next()[1].rstrip(":")
            self.prefixes[name] = self.next()[1]
        return self.select()

    def select(self) -> Select:
        if not self.word("SELECT"):
            raise ValueError("only SELECT queries are supported")
        distinct, columns = self.word("DISTINCT", "REDUCED"), []
        while True:
            if self.peek()[0] == "var":
                columns.append((self.next()[1], None))
            elif self.mark("("):
                function = self.next()[1].upper()
                self.need("(")
                argument = None if self.mark("*") else self.next()[1]
                self.need(")")
                if not self.word("AS"):
                    raise ValueError("AS expected")
                columns.append((self.next()[1], (function, argument)))
                self.need(")")
            elif self.mark("*"):
                continue
            else:
                break
        self.word("WHERE")
        found = Select(columns, self.group(), distinct=distinct)
        if self.word("GROUP"):
            self.word("BY")
            while self.peek()[0] == "var":
                found.group_by.append(self.next()[1])
        if self.word("HAVING"):
            while self.peek() == ("mark", "("):
                self.need("(")
                found.having.append(self.expression(calls=found))
                self.need(")")
        if self.word("ORDER"):
            self.word("BY")
            while self.peek()[0] == "var" or self.peek()[1].upper() in ("ASC", "DESC"):
                down = self.peek()[1].upper() == "DESC" and self.peek()[0] == "name"
                if self.word("ASC", "DESC"):
                    self.need("(")
                    found.order.append((self.next()[1], down))
                    self.need(")")
                else:
                    found.order.append((self.next()[1], False))
        while self.peek()[1].upper() in ("LIMIT", "OFFSET"):
            if self.word("LIMIT"):
                found.limit = int(self.next()[1])
            elif self.word("OFFSET"):
                found.offset = int(self.next()[1])
        return found

    def group(self, graph: str | None = None) -> list:
        self.need("{")
        out: list = []
        while not self.mark("}"):
            if self.word("GRAPH"):
                out.append(("join", self.group(self.term().lex)))
            elif self.word("FILTER"):
                if self.word("NOT"):
                    self.word("EXISTS")
                    out.append(("absent", self.group(graph)))
                elif self.word("EXISTS"):
                    out.append(("exists", self.group(graph)))
                else:
                    out.append(("filter", self.primary()))
            elif self.word("OPTIONAL"):
                out.append(("optional", self.group(graph)))
            elif self.word("MINUS"):
                out.append(("minus", self.group(graph)))
            elif self.word("BIND"):
                self.need("(")
                value = self.expression()
                self.word("AS")
                out.append(("bind", self.next()[1], value))
                self.need(")")
            elif self.word("VALUES"):
                out.append(self.values())
            elif self.peek() == ("name", "SELECT") or self.peek()[1].upper() == "SELECT":
                out.append(("select", self.select()))
            elif self.peek() == ("mark", "{"):
                parts = [self.group(graph)]
                while self.word("UNION"):
                    parts.append(self.group(graph))
                out.append(("union", parts) if len(parts) > 1 else ("join", parts[0]))
            elif self.mark("."):
                continue
            else:
                self.patterns(graph, out)
        return out

    def patterns(self, graph: str | None, out: list) -> None:
        subject = self.term()
        while True:
            predicate = self.path()
            self.triple(out, graph, subject, predicate, self.term())
            while self.mark(","):
                self.triple(out, graph, subject, predicate, self.term())
            if not self.mark(";") or self.peek()[1] in (".", "}"):
                return

    def values(self) -> tuple:
        """VALUES ?v { ... } and VALUES (?v ?w) { (...) ... }."""
        several = self.mark("(")
        names = []
        while self.peek()[0] == "var":
            names.append(self.next()[1])
        if several:
            self.need(")")
        self.need("{")
        rows = []
        while not self.mark("}"):
            if several:
                self.need("(")
            rows.append(tuple(None if self.word("UNDEF") else self.term() for _ in names))
            if several:
                self.need(")")
        return ("values", names, rows)

    def path(self):
        """A predicate: an IRI, a variable or a property path."""
        parts = [self.path_sequence()]
        while self.mark("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_sequence(self):
        parts = [self.path_step()]
        while self.mark("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_step(self):
        if self.mark("^"):
            return Path("inv", (self.path_step(),))
        if self.mark("("):
            found = self.path()
            self.need(")")
        else:
            found = self.term()
        for sign, kind in (("+", "plus"), ("*", "star"), ("?", "opt")):
            if self.mark(sign):
                return Path(kind, (found,))
        return found

    def triple(self, out: list, graph: str | None, subject, predicate, obj) -> None:
        """A pattern; sequences, inverses and alternatives become simpler ones."""
        if not isinstance(predicate, Path) or predicate.kind in ("plus", "star", "opt"):
            out.append(("triple" if not isinstance(predicate, Path) else "path", graph, subject, predicate, obj))
        elif predicate.kind == "inv":
            self.triple(out, graph, obj, predicate.parts[0], subject)
        elif predicate.kind == "seq":
            nodes = [subject]
            for _ in predicate.parts[1:]:
                self.fresh += 1
                nodes.append(Var(f"_step{self.fresh}"))
            for part, a, b in zip(predicate.parts, nodes, [*nodes[1:], obj], strict=True):
                self.triple(out, graph, a, part, b)
        else:
            groups: list[list] = []
            for part in predicate.parts:
                groups.append([])
                self.triple(groups[-1], graph, subject, part, obj)
            out.append(("union", groups))

    def term(self):
        if self.peek() == ("op", "-") and self.tokens[self.at + 1][0] == "number":
            self.next()
            found = self.term()
            return Term(found.kind, "-" + found.lex, found.dt)
        kind, value = self.next()
        if kind == "var":
            return Var(value)
        if kind == "iri":
            return iri(value)
        if kind == "string":
            text = value[3:-3] if value.startswith('"""') else value[1:-1].replace('\\"', '"')
            return Term("lit", text, self.term().lex) if self.mark("^^") else Term("lit", text)
        if kind == "number":
            return Term("lit", value, DECIMAL if "." in value else INTEGER)
        if kind == "name" and value == "a":
            return iri(RDF_TYPE)
        if kind == "name" and value in ("true", "false"):
            return Term("lit", value, BOOLEAN)
        if kind == "name" and ":" in value:
            prefix, _, local = value.partition(":")
            return iri(self.prefixes[prefix] + local)
        raise ValueError(f"term expected, found {value!r}")

    def primary(self, calls: Select | None = None):
        if self.mark("("):
            found = self.expression(calls=calls)
            self.need(")")
            return found
        if self.mark("!"):
            return ("!", self.primary(calls))
        if self.peek() == ("op", "-"):
            self.next()
            return ("neg", self.primary(calls))
        kind, name = self.peek()
        if kind == "name" and self.tokens[self.at + 1 : self.at + 2] == [("mark", "(")]:
            self.next()
            self.need("(")
            name = name.upper()
            if name in AGGREGATES:
                # In HAVING: a column of its own that the result doesn't show.
                argument = None if self.mark("*") else self.next()[1]
                self.need(")")
                if calls is None:
                    raise ValueError(f"{name} outside SELECT and HAVING")
                calls.columns.append((f"_having{len(calls.columns)}", (name, argument)))
                return Var(calls.columns[-1][0])
            if name not in FUNCTIONS:
                raise ValueError(f"unknown function {name}")
            arguments = []
            while not self.mark(")"):
                arguments.append(self.expression(calls=calls))
                self.mark(",")
            return ("call", name, tuple(arguments))
        return self.term()

    def expression(self, level: int = 0, calls: Select | None = None):
        levels = (("||",), ("&&",), COMPARED, ("+", "-"), ("*", "/"))
        if level == len(levels):
            return self.primary(calls)
        left = self.expression(level + 1, calls)
        while True:
            if self.peek()[0] == "op" and self.peek()[1] in levels[level]:
                left = (self.next()[1], left, self.expression(level + 1, calls))
            elif level == 2 and self.peek()[0] == "name" and self.peek()[1].upper() in ("IN", "NOT"):
                negated = self.word("NOT")
                self.word("IN")
                self.need("(")
                terms = []
                while not self.mark(")"):
                    terms.append(self.expression(calls=calls))
                    self.mark(",")
                left = ("!", ("in", left, tuple(terms))) if negated else ("in", left, tuple(terms))
            else:
                return left


AGGREGATES = ("SUM", "COUNT", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")


def parse(text: str) -> Select:
    return _Parser(text).query()


def _uses(element, found: Counter) -> Counter:
    """How often each variable occurs in a part of the algebra."""
    if isinstance(element, Var):
        found[element.name] += 1
    elif isinstance(element, Select):
        for name, made in element.columns:
            found[name] += 1
            if made and made[1]:
                found[made[1]] += 1
        _uses(element.where, found)
        for name, _ in element.order:
            found[name] += 1
        _uses(element.having, found)
    elif isinstance(element, tuple) and element and element[0] == "values":
        for name in element[1]:
            found[name] += 1
    elif isinstance(element, (list, tuple)) and not isinstance(element, Term):
        for part in element:
            _uses(part, found)
    return found


def predicates(part) -> set[str] | None:
    """The predicates that the patterns of a part of the algebra name; None where one takes any."""
    if isinstance(part, Select):
        return predicates(part.where)
    if isinstance(part, list):
        named = [predicates(x) for x in part]
        return None if None in named else set().union(*named)
    if isinstance(part, Term):
        return {part.lex}
    if isinstance(part, Var) or isinstance(part, Path) and part.kind in ("star", "opt"):
        return None  # paths of no step hold for every node
    if isinstance(part, Path):
        return predicates(list(part.parts))
    kind = part[0]
    if kind in ("triple", "path"):
        return predicates(part[3])
    return predicates(part[1]) if kind in ("join", "select", "union", "optional", "minus", "absent", "exists") else set()


# --- over DataFrames ------------------------------------------------------------------


_same = same  # used by shapes as well


def _star(quads: DataFrame, graph: str | None, subject, patterns: list, uses: Counter, bag: bool) -> DataFrame:
    chosen = F.col("p").isin(sorted({p.lex for p, _ in patterns}))
    if graph:
        chosen &= F.col("g") == graph
    if isinstance(subject, Term):
        chosen &= F.col("s") == subject.lex
    objects, held = [], F.lit(True)
    for i, (p, o) in enumerate(patterns):
        fits = F.col("p") == p.lex
        if isinstance(o, Term):
            fits &= _same(F.col("o"), o)
        objects.append(F.collect_set(F.when(fits, F.col("o"))).alias(f"_{i}"))
        held &= F.size(f"_{i}") > 0
    table = quads.where(chosen).groupBy("s").agg(*objects).where(held)
    kept = {f"_{i}": F.col(f"_{i}") for i in range(len(patterns))}
    if isinstance(subject, Var):
        kept[subject.name] = term_column("iri", F.col("s"))
        table = table.select(*[c.alias(n) for n, c in kept.items()])
    seen = {subject.name} if isinstance(subject, Var) else set()
    for i, (_, o) in enumerate(patterns):
        if not isinstance(o, Var):
            continue
        if o.name in seen:
            name = o.name
            table = table.where(F.exists(f"_{i}", lambda x, name=name: (x["lex"] == F.col(name)["lex"]) & (x["kind"] == F.col(name)["kind"]) & x["dt"].eqNullSafe(F.col(name)["dt"])))
        elif bag or uses[o.name] > 1:
            table = table.withColumn(o.name, F.explode(f"_{i}"))
            seen.add(o.name)
    return table.select(*sorted(seen)) if seen else table.select(F.lit(1).alias("_any")).limit(1).drop("_any")


def _generic(quads: DataFrame, pattern: tuple) -> DataFrame:
    _, graph, s, p, o = pattern
    rows = quads.where(F.col("g") == graph) if graph else quads
    out = {}
    for part, column in ((s, term_column("iri", F.col("s"))), (p, term_column("iri", F.col("p"))), (o, F.col("o"))):
        if isinstance(part, Term):
            rows = rows.where(_same(column, part))
        else:
            out[part.name] = column
    return rows.select(*[c.alias(n) for n, c in out.items()])


def _key(name: str) -> list[Column]:
    return [F.col(name)["kind"], F.col(name)["lex"], F.coalesce(F.col(name)["dt"], F.lit(""))]


def _join(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    if left is None:
        return right
    common = [c for c in left.columns if c in right.columns]
    if not common:
        if how == "inner":
            return _product(left, right)
        if how == "minus":  # nothing in common, nothing to take away
            return left
        # (NOT) EXISTS only asks whether there is a row.
        return left.join(right if how == "left" else right.limit(1).select(F.lit(1)), F.lit(True), how)
    how = "left_anti" if how == "minus" else how
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in common})
    match = F.lit(True)
    for c in common:
        for a, b in zip(_key(c), _key(f"_r_{c}"), strict=True):
            match = match & (a == b)
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in common])


def _product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, which comes in blocks of ``IN_BLOCK``: a
    block goes with one left row after the other.  Both sides' values then repeat at short
    distances, and the product, of the order of the square of the input, stays small in files."""
    if not right.columns:
        return left.crossJoin(right)

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, IN_BLOCK):
                part = batch.slice(at, IN_BLOCK)
                rows = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), rows)], names=["_rows"])

    kind = T.StructType([T.StructField("_rows", T.ArrayType(right.schema))])
    found = right.mapInArrow(blocks, kind).crossJoin(left).select(*left.columns, F.explode("_rows").alias("_row"))
    return found.select(*left.columns, *[F.col("_row")[c].alias(c) for c in right.columns])


def _path_frame(quads: DataFrame, element: tuple, most_rounds: int = 64) -> DataFrame:
    """Subject and object of a repeated path, joined one step further until nothing is new."""
    _, graph, s, path, o = element
    rows = quads.where(F.col("g") == graph) if graph else quads
    pair = [("triple", graph, Var("_a"), path.parts[0], Var("_b"))] if isinstance(path.parts[0], Term) else []
    if not pair:
        _Parser("").triple(pair, graph, Var("_a"), path.parts[0], Var("_b"))
    uses = Counter({"_a": 2, "_b": 2, **{f"_step{i}": 2 for i in range(1, 20)}})
    one = _group_frame(quads, pair, uses, True).select(F.struct("_a.kind", "_a.lex", "_a.dt").alias("a"), F.struct("_b.kind", "_b.lex", "_b.dt").alias("b")).distinct()
    known = one = written(one, "path-one")
    if path.kind != "opt":
        for _ in range(most_rounds):
            further = known.join(one.select(F.col("a").alias("_m"), F.col("b").alias("_c")), F.col("b") == F.col("_m")).select("a", F.col("_c").alias("b"))
            more = written(known.union(further).distinct(), "path")
            if more.count() == known.count():
                break
            known = more
        else:
            raise RuntimeError(f"a path of over {most_rounds} steps")
    if path.kind in ("star", "opt"):
        nodes = rows.select(F.struct(F.lit("iri").alias("kind"), F.col("s").alias("lex"), F.lit(None).cast("string").alias("dt")).alias("n")).union(rows.select(F.struct("o.kind", "o.lex", "o.dt").alias("n")))
        known = known.union(nodes.select(F.col("n").alias("a"), F.col("n").alias("b"))).distinct()

    def term(column: str):
        return term_column(F.col(column)["kind"], F.col(column)["lex"], F.col(column)["dt"])

    out = {}
    for part, column in ((s, "a"), (o, "b")):
        if isinstance(part, Term):
            known = known.where(same(F.col(column), part))
        elif part.name in out:
            known = known.where(F.col("a") == F.col("b"))
        else:
            out[part.name] = term(column)
    return known.select(*[c.alias(n) for n, c in out.items()])


def _values_frame(quads: DataFrame, element: tuple) -> DataFrame:
    _, names, rows = element
    kind = ", ".join(f"{n} {TERM}" for n in names)
    return quads.sparkSession.createDataFrame([tuple(None if t is None else tuple(t) for t in r) for r in rows], kind)


def _group_frame(quads: DataFrame, group: list, uses: Counter, bag: bool) -> DataFrame | None:
    stars: dict = {}
    out = None
    for element in group:
        if element[0] == "triple" and isinstance(element[3], Term):
            stars.setdefault((element[1], element[2]), []).append((element[3], element[4]))
    for (graph, subject), patterns in stars.items():
        out = _join(out, _star(quads, graph, subject, patterns, uses, bag))
    for element in group:
        kind = element[0]
        if kind == "triple" and isinstance(element[3], Var):
            out = _join(out, _generic(quads, element))
        elif kind == "path":
            out = _join(out, _path_frame(quads, element))
        elif kind == "values":
            out = _join(out, _values_frame(quads, element))
        elif kind == "join":
            out = _join(out, _group_frame(quads, element[1], uses, bag))
        elif kind == "select":
            out = _join(out, to_frame(quads, element[1], bag))
        elif kind == "union":
            parts = [_group_frame(quads, g, uses, bag) for g in element[1]]
            both = parts[0]
            for part in parts[1:]:
                both = both.unionByName(part, allowMissingColumns=True)
            out = _join(out, both)
    for element in group:
        kind = element[0]
        if kind == "optional":
            out = _join(out, _group_frame(quads, element[1], uses, bag), "left")
        elif kind in ("minus", "absent", "exists"):
            out = _join(out, _group_frame(quads, element[1], uses, bag), {"minus": "minus", "absent": "left_anti", "exists": "left_semi"}[kind])
        elif kind == "bind":
            out = out.withColumn(element[1], value(element[2]))
        elif kind == "filter":
            out = out.where(condition(element[1]))
    return out


def to_frame(quads: DataFrame, query: Select, bag: bool = True) -> DataFrame:
    """One column (a term) per selected variable; without ``bag`` solutions may be fewer times
    there than they would be, but for what an aggregate counts."""
    uses = _uses(query, Counter())
    for name, _ in query.columns:
        uses[name] += 1
    rows = _group_frame(quads, query.where, uses, bag or any(made for _, made in query.columns))
    if any(made for _, made in query.columns):
        made = []
        for name, call in query.columns:
            if call is None:
                continue
            function, argument = call
            found = F.count("*") if argument is None else {
                "SUM": lambda v: F.coalesce(F.sum(number(v)), F.lit(0)), "COUNT": F.count, "MIN": lambda v: F.min(number(v)),
                "MAX": lambda v: F.max(number(v)), "AVG": lambda v: F.avg(number(v)), "SAMPLE": lambda v: F.min(v["lex"]),
                "GROUP_CONCAT": lambda v: F.array_join(F.sort_array(F.collect_list(v["lex"])), " "),
            }[function](F.col(argument))
            kind = {"COUNT": INTEGER, "SAMPLE": None, "GROUP_CONCAT": None}.get(function, DECIMAL)
            # No value, as MIN of nothing has, is no term.
            made.append(F.when(found.isNotNull(), term_column("lit", found, kind)).alias(name))
        rows = rows.groupBy(*query.group_by).agg(*made)
    for test in query.having:
        rows = rows.where(condition(test))
    shown = [n for n, _ in query.columns if not n.startswith("_having")]
    if query.distinct:
        if not {n for n, _ in query.order} <= set(shown):
            raise ValueError("ORDER BY of a DISTINCT query needs selected variables")
        rows = rows.select(*shown).distinct()
    if query.order:
        # Numbers by value before texts, as in memory; no value comes first.
        rows = rows.orderBy(*[part.desc_nulls_last() if down else part.asc_nulls_first() for name, down in query.order for part in (number(F.col(name)).isNull() & F.col(name).isNotNull(), number(F.col(name)), F.col(name)["lex"])])
    rows = rows.select(*shown)
    rows = rows.offset(query.offset) if query.offset else rows
    return rows.limit(query.limit) if query.limit is not None else rows


# --- in memory ------------------------------------------------------------------------


def _extend(rows: list[dict], graph: dict, pattern: tuple) -> list[dict]:
    _, _, s, p, o = pattern
    out = []
    for row in rows:
        subject = row.get(s.name) if isinstance(s, Var) else s
        for node in [subject.lex] if subject else list(graph):
            for predicate, objects in graph.get(node, {}).items():
                if isinstance(p, Term) and predicate != p.lex:
                    continue
                for found in objects:
                    want = row.get(o.name) if isinstance(o, Var) else o
                    if want is not None and want[:3] != found[:3]:
                        continue
                    more = dict(row)
                    for part, value in ((s, iri(node)), (p, iri(predicate)), (o, found)):
                        if isinstance(part, Var):
                            more.setdefault(part.name, value)
                    out.append(more)
    return out


def _group_rows(group: list, graph: dict, rows: list[dict]) -> list[dict]:
    for element in group:
        kind = element[0]
        if kind == "triple":
            rows = _extend(rows, graph, element)
        elif kind == "path":
            rows = [{**r, **m} for r in rows for m in _path_rows(element, graph) if all(r.get(k, v)[:3] == v[:3] for k, v in m.items())]
        elif kind == "values":
            made = [{n: t for n, t in zip(element[1], x, strict=True) if t is not None} for x in element[2]]
            rows = [{**r, **m} for r in rows for m in made if all(r.get(k, v)[:3] == v[:3] for k, v in m.items())]
        elif kind == "join":
            rows = _group_rows(element[1], graph, rows)
        elif kind == "select":
            made = solve(element[1], graph)
            rows = [{**r, **m} for r in rows for m in made if all(r.get(k, v)[:3] == v[:3] for k, v in m.items())]
        elif kind == "union":
            rows = [x for part in element[1] for x in _group_rows(part, graph, rows)]
        elif kind == "optional":
            rows = [x for r in rows for x in (_group_rows(element[1], graph, [r]) or [r])]
        elif kind in ("absent", "exists"):
            rows = [r for r in rows if bool(_group_rows(element[1], graph, [r])) == (kind == "exists")]
        elif kind == "minus":
            taken = _group_rows(element[1], graph, [{}])
            rows = [r for r in rows if not any(set(r) & set(t) and all(r[k][:3] == t[k][:3] for k in set(r) & set(t)) for t in taken)]
        elif kind == "bind":
            rows = [{**r, element[1]: evaluate(element[2], r)} for r in rows]
    for element in group:
        if element[0] == "filter":
            rows = [r for r in rows if holds(element[1], r)]
    return rows


def _path_rows(element: tuple, graph: dict) -> list[dict]:
    """Solutions of a repeated path, by search from every node."""
    _, _, s, path, o = element
    pair: list = []
    _Parser("").triple(pair, None, Var("_a"), path.parts[0], Var("_b"))
    step: dict = {}
    for r in _group_rows(pair, graph, [{}]):
        step.setdefault(r["_a"][:3], set()).add(r["_b"][:3])
    nodes = {iri(n)[:3] for n in graph} | {t[:3] for ps in graph.values() for ts in ps.values() for t in ts}
    found = set()
    for node in nodes:
        reached, todo = set(), set(step.get(node, ()))
        while todo:
            at = todo.pop()
            reached.add(at)
            if path.kind != "opt":
                todo |= step.get(at, set()) - reached
        found |= {(node, t) for t in reached | ({node} if path.kind in ("star", "opt") else set())}
    out = []
    for a, b in found:
        row: dict = {}
        for part, t in ((s, Term(*a)), (o, Term(*b))):
            if isinstance(part, Term):
                fits = part[:3] == t[:3]
            else:
                fits = row.setdefault(part.name, t)[:3] == t[:3]
            if not fits:
                break
        else:
            out.append(row)
    return out


def solve(query: Select, graph: dict, given: dict | None = None) -> list[dict]:
    """Solutions over ``graph`` (subject -> predicate -> terms); ``given`` binds variables."""
    rows = _group_rows(query.where, graph, [dict(given or {})])
    calls = [(n, c) for n, c in query.columns if c]
    if not calls:
        return _cut([{n: v for n, v in r.items() if v is not None} for r in rows], query)
    groups: dict = {}
    for r in rows:
        groups.setdefault(tuple(r.get(v) for v in query.group_by), []).append(r)
    if not query.group_by:
        groups.setdefault((), [])
    out = []
    for key, members in groups.items():
        row = dict(zip(query.group_by, key, strict=True))
        for name, (function, argument) in calls:
            bound = [m[argument] for m in members if m.get(argument) is not None]
            found = _aggregate(function, bound, len(members) if argument is None else len(bound))
            if found is not None:
                row[name] = found
        out.append({n: v for n, v in row.items() if v is not None})
    return _cut(out, query)


def _aggregate(function: str, bound: list[Term], count: int) -> Term | None:
    """None where there is no value, as with MIN of nothing."""
    if function == "COUNT":
        return Term("lit", str(count), INTEGER, True)
    if function == "SAMPLE":
        return Term("lit", min(t.lex for t in bound)) if bound else None
    if function == "GROUP_CONCAT":
        return Term("lit", " ".join(sorted(t.lex for t in bound)))
    values = [v for v in map(as_number, bound) if v is not None]
    if not values and function != "SUM":
        return None
    made = {"SUM": lambda: sum(values, Decimal(0)), "MIN": lambda: min(values), "MAX": lambda: max(values), "AVG": lambda: sum(values) / len(values)}[function]()
    return Term("lit", str(made), DECIMAL, True)


def _cut(rows: list[dict], query: Select) -> list[dict]:
    rows = [r for r in rows if all(holds(t, r) for t in query.having)]
    for name, down in reversed(query.order):
        rows.sort(key=lambda r, name=name: (0,) if name not in r else (1, as_number(r[name]), "") if as_number(r[name]) is not None else (2, 0, r[name].lex), reverse=down)
    shown = [n for n, _ in query.columns if not n.startswith("_having")]
    rows = [{n: r[n] for n in shown if n in r} for r in rows]
    if query.distinct:
        rows = list({tuple(sorted((k, v[:3]) for k, v in r.items())): r for r in rows}.values())
    return rows[query.offset :] if query.limit is None else rows[query.offset : query.offset + query.limit]
