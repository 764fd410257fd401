"""Constraints: shapes compiled to violation frames and to checks on one graph.

A shape's property constraints and its SPARQL constraints become rows of a catalog.  A node
violates a range if its value is missing from the comparison (not a number); a FILTER
inside a SPARQL constraint drops such rows instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.operators import sparql
from edictum.sources.readers import triples_frame
from edictum.sources.shared import written
from edictum.sources.terms import RDF_TYPE, Term, number
from edictum.sources.turtle import RDF, parse_turtle

SH = "http://www.w3.org/ns/shacl#"


@dataclass
class Constraint:
    shape: str
    target_kind: str  # class or node
    target: str
    path: str | None = None
    min_count: int | None = None
    max_count: int | None = None
    bounds: dict = field(default_factory=dict)  # minInclusive ... -> Decimal
    values: list | None = None
    datatype: str | None = None
    pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    has_value: Term | None = None
    node_kind: str | None = None  # IRI or Literal
    cls: str | None = None  # a class the values are of
    pairs: dict = field(default_factory=dict)  # equals, disjoint, lessThan ... -> path
    closed: tuple | None = None  # the only paths the target may have
    logic: tuple | None = None  # and, or, not, xone; its shapes, each a list of constraints
    qualified: tuple | None = None  # a shape (constraints), least and most values that conform
    select: str | None = None
    message: str | None = None
    _query: object = field(default=None, repr=False, compare=False)

    @property
    def local(self) -> bool:
        """Whether the constraint looks at its own target's slots only."""
        if self.cls is not None or self.qualified is not None:
            return False  # looks at the values' own slots
        if self.logic is not None:
            return all(c.local for shape in self.logic[1] for c in shape)
        if self.select is None:
            return True
        subjects = {e[2] for e in _triples(self.query().where)}
        return subjects <= {sparql.Var("this")}

    def query(self):
        """The parsed SPARQL constraint; kept, as the fold asks for it with each action."""
        if self._query is None:
            self._query = sparql.parse(self.select)
        return self._query


def _triples(group: list) -> list:
    out = []
    for e in group:
        if e[0] == "triple":
            out.append(e)
        elif e[0] == "path":  # leads to other nodes
            out.append((*e[:2], None, *e[3:]))
        elif e[0] == "select":
            out += _triples(e[1].where)
        elif e[0] == "union":
            out += [t for g in e[1] for t in _triples(g)]
        elif e[0] in ("join", "optional", "minus", "exists", "absent"):
            out += _triples(e[1])
    return out


BOUNDS = {"minInclusive": lambda v, b: v >= b, "maxInclusive": lambda v, b: v <= b, "minExclusive": lambda v, b: v > b, "maxExclusive": lambda v, b: v < b}


def _same_terms(a, b):
    return (a["kind"] == b["kind"]) & (a["lex"] == b["lex"]) & a["dt"].eqNullSafe(b["dt"])


def _ordered(name: str):
    def wrong(os, others):
        def fails(o, other):
            x, y = number(o), number(other)
            return ~F.coalesce(x < y if name == "lessThan" else x <= y, F.lit(False))

        return F.exists(os, lambda o: F.exists(others, lambda other: fails(o, other)))

    return wrong


def _lacking(some, others):
    return F.exists(some, lambda o: ~F.exists(others, lambda x: _same_terms(o, x)))


#: Whether values and those of another path are at odds, as columns.
PAIRS = {
    "equals": lambda os, others: _lacking(os, others) | _lacking(others, os),
    "disjoint": lambda os, others: F.exists(os, lambda o: F.exists(others, lambda x: _same_terms(o, x))),
    "lessThan": _ordered("lessThan"),
    "lessThanOrEquals": _ordered("lessThanOrEquals"),
}


def parse_shapes(text: str) -> list[Constraint]:
    graph: dict = {}
    for s, p, o in parse_turtle(text):
        graph.setdefault(s, {}).setdefault(p, []).append(o)

    def one(node: dict, name: str) -> Term | None:
        return node.get(SH + name, [None])[0]

    def items(node: str) -> list[Term]:
        out = []
        while node != RDF + "nil":
            out.append(graph[node][RDF + "first"][0])
            node = graph[node][RDF + "rest"][0].lex
        return out

    def lex(node: dict, key: str) -> str | None:
        found = one(node, key)
        return None if found is None else found.lex

    def whole(node: dict, key: str) -> int | None:
        found = lex(node, key)
        return None if found is None else int(found)

    def of_shape(name: str, kind: str, target: str, node: dict) -> list[Constraint]:
        """The constraints of a shape (or of a nested one) on its target."""
        out = []
        properties = [graph[ref.lex] for ref in node.get(SH + "property", [])]
        if SH + "path" in node:
            properties.append(node)
        for p in properties:
            c = Constraint(name, kind, target, path=lex(p, "path"), min_count=whole(p, "minCount"), max_count=whole(p, "maxCount"), min_length=whole(p, "minLength"), max_length=whole(p, "maxLength"))
            c.bounds = {b: Decimal(lex(p, b)) for b in BOUNDS if lex(p, b) is not None}
            c.values = items(lex(p, "in")) if lex(p, "in") is not None else None
            c.datatype, c.pattern, c.has_value = lex(p, "datatype"), lex(p, "pattern"), one(p, "hasValue")
            c.node_kind = lex(p, "nodeKind").removeprefix(SH) if lex(p, "nodeKind") else None
            c.cls = lex(p, "class")
            c.pairs = {k: lex(p, k) for k in PAIRS if lex(p, k) is not None}
            if one(p, "qualifiedValueShape") is not None:
                c.qualified = (of_shape(name, "node", "", graph[lex(p, "qualifiedValueShape")]), whole(p, "qualifiedMinCount"), whole(p, "qualifiedMaxCount"))
            out.append(c)
        for ref in node.get(SH + "sparql", []):
            p = graph[ref.lex]
            out.append(Constraint(name, kind, target, select=lex(p, "select"), message=lex(p, "message")))
        if lex(node, "closed") == "true":
            ignored = [t.lex for t in items(lex(node, "ignoredProperties"))] if lex(node, "ignoredProperties") else []
            out.append(Constraint(name, kind, target, closed=tuple([lex(p, "path") for p in properties] + ignored)))
        for key in ("and", "or", "xone", "not"):
            for ref in node.get(SH + key, []):
                parts = [ref.lex] if key == "not" else [t.lex for t in items(ref.lex)]
                out.append(Constraint(name, kind, target, logic=(key, [of_shape(name, kind, target, graph[part]) for part in parts])))
        return out

    found = []
    for name, node in graph.items():
        for kind, key in (("class", "targetClass"), ("node", "targetNode")):
            for target in node.get(SH + key, []):
                found += of_shape(name, kind, target.lex, node)
    return found


# --- over DataFrames ------------------------------------------------------------------


def _targets(triples: DataFrame, c: Constraint) -> DataFrame:
    if c.target_kind == "node":
        return triples.sparkSession.range(1).select(F.lit(c.target).alias("node"))
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o")["lex"] == c.target)).select(F.col("s").alias("node")).distinct()


def _beyond(name: str, bound: Decimal):
    return lambda o: ~F.coalesce(BOUNDS[name](number(o), F.lit(bound)), F.lit(False))


def _failing(triples: DataFrame, nodes: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """The ``nodes`` that violate some of the constraints."""
    parts = [_violations(triples, c, nodes).select("node") for c in constraints]
    return reduce(DataFrame.union, parts, nodes.limit(0)).distinct()


def _logic(triples: DataFrame, c: Constraint, nodes: DataFrame) -> DataFrame:
    kind, shapes = c.logic
    failed = [_failing(triples, nodes, shape).withColumn("n", F.lit(1)) for shape in shapes]
    counted = reduce(DataFrame.union, failed).groupBy("node").agg(F.sum("n").alias("n"))
    held = nodes.join(counted, "node", "left").select("node", (F.lit(len(shapes)) - F.coalesce("n", F.lit(0))).alias("met"))
    wrong = {"and": F.col("met") < len(shapes), "or": F.col("met") == 0, "xone": F.col("met") != 1, "not": F.col("met") > 0}[kind]
    return held.where(wrong).select("node", F.lit(kind).alias("message"))


def _violations(triples: DataFrame, c: Constraint, nodes: DataFrame | None = None) -> DataFrame:
    nodes = _targets(triples, c) if nodes is None else nodes
    if c.logic is not None:
        return _logic(triples, c, nodes)
    if c.closed is not None:
        beyond = triples.where(~F.col("p").isin(*c.closed)).select(F.col("s").alias("node"), "p").distinct().join(nodes, "node", "left_semi")
        return beyond.select("node", F.concat(F.lit("closed: "), F.element_at(F.split("p", "#"), -1)).alias("message"))
    if c.select is not None:
        quads = triples.select(F.lit("urn:state").alias("g"), "s", "p", "o")
        hits = sparql.to_frame(quads, c.query(), bag=False).select(F.col("this")["lex"].alias("node"))
        return nodes.join(hits, "node", "left_semi").select("node", F.lit(c.message or c.shape).alias("message"))
    objects = triples.where(F.col("p") == c.path).select(F.col("s").alias("node"), "o")
    held = nodes.join(objects, "node", "left").groupBy("node").agg(F.collect_list("o").alias("os"))
    tests = []
    if c.min_count is not None:
        tests.append((F.size("os") < c.min_count, "fewer than minCount"))
    if c.max_count is not None:
        tests.append((F.size("os") > c.max_count, "more than maxCount"))
    for name, bound in c.bounds.items():
        tests.append((F.exists("os", _beyond(name, bound)), name))
    if c.values is not None:
        tests.append((F.exists("os", lambda o: ~reduce(lambda a, b: a | b, [sparql._same(o, v) for v in c.values])), "in"))
    if c.datatype is not None:
        tests.append((F.exists("os", lambda o: ~o["dt"].eqNullSafe(F.lit(c.datatype))), "datatype"))
    if c.pattern is not None:
        tests.append((F.exists("os", lambda o: ~o["lex"].rlike(c.pattern)), "pattern"))
    if c.min_length is not None:
        tests.append((F.exists("os", lambda o: F.length(o["lex"]) < c.min_length), "minLength"))
    if c.max_length is not None:
        tests.append((F.exists("os", lambda o: F.length(o["lex"]) > c.max_length), "maxLength"))
    if c.has_value is not None:
        tests.append((~F.exists("os", lambda o: sparql._same(o, c.has_value)), "hasValue"))
    if c.node_kind is not None:
        tests.append((F.exists("os", lambda o: o["kind"] != {"IRI": "iri", "Literal": "lit"}[c.node_kind]), "nodeKind"))
    if c.cls is not None:
        members = triples.where((F.col("p") == RDF_TYPE) & (F.col("o")["lex"] == c.cls)).select(F.col("s").alias("m")).distinct()
        strange = nodes.join(objects, "node").join(members, (F.col("o")["kind"] == "iri") & (F.col("o")["lex"] == F.col("m")), "left_anti")
        held = held.join(strange.select("node").distinct().withColumn("_strange", F.lit(True)), "node", "left")
        tests.append((F.col("_strange").isNotNull(), "class"))
    for i, (name, path) in enumerate(c.pairs.items()):
        other = triples.where(F.col("p") == path).groupBy(F.col("s").alias("node")).agg(F.collect_list("o").alias(f"_p{i}"))
        held = held.join(other, "node", "left").withColumn(f"_p{i}", F.coalesce(f"_p{i}", F.expr("slice(os, 1, 0)")))
        tests.append((PAIRS[name](F.col("os"), F.col(f"_p{i}")), name))
    if c.qualified is not None:
        shape, least, most = c.qualified
        values = nodes.join(objects, "node").where(F.col("o")["kind"] == "iri").select("node", F.col("o")["lex"].alias("v")).distinct()
        bad = _failing(triples, values.select(F.col("v").alias("node")).distinct(), shape).withColumnRenamed("node", "v")
        met = values.join(bad, "v", "left_anti").groupBy("node").agg(F.count("*").alias("_met"))
        held = held.join(met, "node", "left").withColumn("_met", F.coalesce("_met", F.lit(0)))
        if least is not None:
            tests.append((F.col("_met") < least, "qualifiedMinCount"))
        if most is not None:
            tests.append((F.col("_met") > most, "qualifiedMaxCount"))
    if not tests:
        return nodes.limit(0).withColumn("message", F.lit(""))
    faults = F.filter(F.array(*[F.when(t, F.lit(f"{c.path.split('#')[-1]}: {m}")) for t, m in tests]), lambda m: m.isNotNull())
    return held.select("node", F.explode(faults).alias("message"))


def violations(triples: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """shape, node, message of every violation in a state."""
    parts = [_violations(triples, c).select(F.lit(c.shape).alias("shape"), "node", "message") for c in constraints]
    return reduce(DataFrame.unionByName, parts)


def report(triples: DataFrame, constraints: list[Constraint]) -> tuple[bool, list[str]]:
    """Whether a state conforms, and its violations as sorted lines."""
    rows = violations(triples, constraints).select(F.concat_ws(" ", "shape", "node", "message").alias("line"))
    found = rows.agg(F.sort_array(F.collect_list("line"))).first()[0]
    return not found, found


def conforms(spark: SparkSession, triples: DataFrame, constraints: list[Constraint], regime: str = "shacl", focus: set | None = None) -> tuple[bool, list[str]]:
    """``report`` by the compiled shapes (``shacl``), or by the checks that the fold makes
    (``incremental``), of ``focus`` nodes where given.  Only the violations come to the driver."""
    if regime == "shacl":
        return report(triples, constraints)
    if regime != "incremental":
        raise ValueError(f"unknown validation regime: {regime!r}")
    found = sorted(r.line for r in fault_lines(triples, constraints, focus).collect())
    return not found, found


def _predicates(c: Constraint) -> set | None:
    """The predicates that a local constraint looks at; None: any."""
    if c.closed is not None:
        return None
    if c.logic is not None:
        inner = [_predicates(x) for shape in c.logic[1] for x in shape]
        return None if None in inner else set().union(*inner)
    if c.select is not None:
        named = {e[3].lex if isinstance(e[3], Term) else None for e in _triples(c.query().where)}
        return None if None in named else named
    return {c.path, *c.pairs.values()}


def fault_lines(triples: DataFrame, constraints: list[Constraint], focus: set | None = None) -> DataFrame:
    """line: the violations that ``faults`` finds, without a task that sees the whole state where
    that is right.  Constraints that look at their own target only are checked subject by subject;
    the others, if there are any, in one component, in one task, as the fold has it."""
    for c in constraints:
        if c.select is not None:
            c.query()  # parsed here, once, and not by every worker
    own, far = [c for c in constraints if c.local], [c for c in constraints if not c.local]
    at_node = {c.target for c in own if c.target_kind == "node"}
    rows = triples.select("s", "p", "o.kind", "o.lex", "o.dt")

    def frame(lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    def by_subject(batches):
        at, slots, out = None, {}, []
        for batch in batches:
            for s, p, *o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != at:
                    out += checked(at, slots)
                    at, slots = s, {}
                if p is not None:
                    slots.setdefault(p, []).append(Term(*o))
            if out:
                yield frame(out)
                out = []
        yield frame(out + checked(at, slots))

    def checked(s: str | None, slots: dict) -> list[str]:
        return [] if s is None else faults({s: slots}, [c for c in own if c.target_kind == "class" or c.target == s], focus)

    def whole(batches):
        graph: dict = {}
        for batch in batches:
            for s, p, *o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                graph.setdefault(s, {}).setdefault(p, []).append(Term(*o))
        yield frame(faults(graph, far, focus))

    parts = [triples.sparkSession.createDataFrame([], "line string")]
    if own:
        needed = [_predicates(c) for c in own]
        mine = rows if None in needed else rows.where(F.col("p").isin(RDF_TYPE, *sorted(set().union(*needed))))
        if at_node:  # checked also where the state doesn't have them
            mine = mine.union(triples.sparkSession.createDataFrame([(s, None, None, None, None) for s in sorted(at_node)], mine.schema))
        parts.append(mine.repartition("s").sortWithinPartitions("s").mapInArrow(by_subject, "line string"))
    if far:
        parts.append(rows.repartition(1).mapInArrow(whole, "line string"))
    return reduce(DataFrame.union, parts)


def report_row(lines: DataFrame) -> DataFrame:
    """conforms, report: the lines in order as one text, null where there is none.  Ranges of
    lines are sorted and joined apart, so that the last task has few and long pieces to join."""
    lines = written(lines, "lines")  # the ranges' bounds are drawn from it

    def joined(batches):
        for batch in batches:
            if batch.num_rows:
                held = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (held[0], held[-1], "\n".join(held))], names=["first", "last", "text"])

    pieces = lines.repartitionByRange("line").sortWithinPartitions("line").mapInArrow(joined, "first string, last string, text string")
    # Pieces that begin alike: one that also ends so holds that line only, and comes first.
    texts = F.transform(F.sort_array(F.collect_list(F.struct("first", "last", "text"))), lambda x: x["text"])
    return pieces.agg((F.count("*") == 0).alias("conforms"), F.when(F.count("*") > 0, F.array_join(texts, "\n")).alias("report"))


def validate_files(spark: SparkSession, data: str, shapes: str, regime: str = "shacl") -> tuple[bool, list[str]]:
    """Whether a Turtle file conforms to a file of shapes, and its violations."""
    triples = triples_frame(spark, parse_turtle(Path(data).read_text()))
    return conforms(spark, triples, parse_shapes(Path(shapes).read_text()), regime)


# --- on one component's graph ---------------------------------------------------------


def _at_odds(name: str, values: list[Term], others: list[Term]) -> bool:
    a, b = {v[:3] for v in values}, {v[:3] for v in others}
    if name in ("equals", "disjoint"):
        return a != b if name == "equals" else bool(a & b)
    pairs = [(sparql.as_number(x), sparql.as_number(y)) for x in values for y in others]
    return any(x is None or y is None or not (x < y if name == "lessThan" else x <= y) for x, y in pairs)


def faults(graph: dict, constraints: list[Constraint], focus: set | None = None, at: str | None = None) -> list[str]:
    """Violations in ``graph`` (subject -> predicate -> terms), of ``focus`` nodes only
    where given (constraints that look at other nodes are always checked), or of one node
    ``at`` whatever the constraints' targets are."""
    out = []
    for c in constraints:
        nodes = [at] if at is not None else [c.target] if c.target_kind == "node" else [s for s, ps in graph.items() if any(o.lex == c.target for o in ps.get(RDF_TYPE, []))]
        query = c.query() if c.select is not None else None
        for node in nodes:
            if focus is not None and c.local and node not in focus:
                continue
            if c.logic is not None:
                kind, shapes = c.logic
                met = sum(not faults(graph, shape, at=node) for shape in shapes)
                if {"and": met < len(shapes), "or": met == 0, "xone": met != 1, "not": met > 0}[kind]:
                    out.append(f"{c.shape} {node} {kind}")
                continue
            if c.closed is not None:
                out += [f"{c.shape} {node} closed: {p.split('#')[-1]}" for p, held in graph.get(node, {}).items() if held and p not in c.closed]
                continue
            if query is not None:
                if sparql.solve(query, graph, {"this": Term("iri", node)}):
                    out.append(f"{c.shape} {node} {c.message or c.shape}")
                continue
            values = graph.get(node, {}).get(c.path, [])
            bad = []
            if c.min_count is not None and len(values) < c.min_count:
                bad.append("fewer than minCount")
            if c.max_count is not None and len(values) > c.max_count:
                bad.append("more than maxCount")
            for name, bound in c.bounds.items():
                if any(n is None or not BOUNDS[name](n, bound) for n in map(sparql.as_number, values)):
                    bad.append(name)
            if c.values is not None and any(v[:3] not in [x[:3] for x in c.values] for v in values):
                bad.append("in")
            if c.datatype is not None and any(v.dt != c.datatype for v in values):
                bad.append("datatype")
            if c.pattern is not None and any(not re.search(c.pattern, v.lex) for v in values):
                bad.append("pattern")
            if c.min_length is not None and any(len(v.lex) < c.min_length for v in values):
                bad.append("minLength")
            if c.max_length is not None and any(len(v.lex) > c.max_length for v in values):
                bad.append("maxLength")
            if c.has_value is not None and all(v[:3] != c.has_value[:3] for v in values):
                bad.append("hasValue")
            if c.node_kind is not None and any(v.kind != {"IRI": "iri", "Literal": "lit"}[c.node_kind] for v in values):
                bad.append("nodeKind")
            if c.cls is not None and any(v.kind != "iri" or not any(t.lex == c.cls for t in graph.get(v.lex, {}).get(RDF_TYPE, [])) for v in values):
                bad.append("class")
            bad += [name for name, path in c.pairs.items() if _at_odds(name, values, graph.get(node, {}).get(path, []))]
            if c.qualified is not None:
                shape, least, most = c.qualified
                met = sum(not faults(graph, shape, at=v) for v in {v.lex for v in values if v.kind == "iri"})
                bad += [m for m, wrong in (("qualifiedMinCount", least is not None and met < least), ("qualifiedMaxCount", most is not None and met > most)) if wrong]
            out += [f"{c.shape} {node} {c.path.split('#')[-1]}: {b}" for b in bad]
    return out
