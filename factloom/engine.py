"""Programs over DataFrames: register relations, load clauses, ask queries."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.fixpoint import MOST_ROUNDS, closure, closure_of, fixpoint, reached, staged
from factloom.operators.rules import answers, derived, derived_once, distinct
from factloom.plans.analysis import ProgramError, check_arity, check_safety, evaluation_order
from factloom.plans.clauses import Atom, Comparison, Program, Rule, Var
from factloom.sources.facts import with_shape
from factloom.sources.mapping import mapped
from factloom.sources.program import load_program, read_program
from factloom.staging import table


class Engine:
    """Relations by name; derived ones are evaluated when a query first needs them.

    Relations are sets of rows of texts. Registered DataFrames are cast to text, rows with a null are
    left out, and rows that repeat count once in every result. Ids of mapped facts stand without their
    type, so equal ids of different types are one value; with ``typed`` they are ``type/id``.
    """

    def __init__(self, spark: SparkSession, facts: DataFrame | None = None, most_rounds: int = MOST_ROUNDS, typed: bool = False):
        self.spark, self.most_rounds, self.typed = spark, most_rounds, typed
        self.facts = facts if facts is None or "shape" in facts.columns else with_shape(facts)
        self.program = Program()
        self._registered: dict[str, DataFrame] = {}
        self._done: dict[str, DataFrame] = {}
        self._written: set[str] = set()  # those of _done that are a table already

    def register(self, name: str, rows: DataFrame) -> Engine:
        """Make a DataFrame the predicate ``name``, its columns the arguments."""
        texts = rows.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(rows.columns)])
        texts = texts.dropna()
        self._registered[name] = self._registered[name].unionByName(texts) if name in self._registered else texts
        self._done.clear()
        self._written.clear()
        return self

    def load(self, source: str, folder: str = ".") -> Engine:
        """Add the clauses of a program text."""
        return self._add(read_program(source, folder))

    def load_file(self, path: str) -> Engine:
        return self._add(load_program(path))

    def _add(self, program: Program) -> Engine:
        self.program.extend(program)
        self._done.clear()
        self._written.clear()
        self._arity()
        for rule in self.program.rules:
            check_safety(rule)
        evaluation_order([r for r in self.program.rules if r.body])
        return self

    def _arity(self, *queries: tuple[Atom | Comparison, ...]) -> dict[str, int]:
        known = {n: len(r.columns) for n, r in self._registered.items()}
        return check_arity(Program(self.program.rules, self.program.mappings, [*self.program.queries, *queries]), known)

    def _base(self, name: str) -> list[DataFrame]:
        """Rows of a predicate that no rule derives: registered, mapped, and ground facts."""
        out = [self._registered[name]] if name in self._registered else []
        for m in self.program.mappings:
            if m.name == name:
                if self.facts is None:
                    raise ProgramError(f"{name} is mapped from facts, but there are none")
                out.append(mapped(self.facts, m, self.typed))
        ground = [r.head.terms for r in self.program.rules if r.head.name == name and not r.body]
        if ground:
            out.append(self.spark.createDataFrame(ground, ", ".join(f"c{i} string" for i in range(len(ground[0])))) if ground[0] else self.spark.range(1).select())
        return out

    def relation(self, name: str) -> DataFrame:
        """The rows of a predicate, columns c0, c1, ...; empty if nothing defines it."""
        self._evaluate({name})
        return self._done[name]

    def relations(self) -> list[str]:
        """Names of all predicates that something defines: registered, mapped, ground or derived."""
        return sorted({*self._registered, *(m.name for m in self.program.mappings), *(r.head.name for r in self.program.rules)})

    def save(self, name: str, folder: str) -> None:
        """Write a predicate's rows as Parquet, for ``restore`` in this or another engine."""
        distinct(self.relation(name)).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")

    def restore(self, name: str, folder: str) -> Engine:
        return self.register(name, self.spark.read.parquet(f"{folder.rstrip('/')}/{name}"))

    def create_views(self, *names: str) -> None:
        """Make predicates temporary views of their names, for use in SQL."""
        for name in names:
            distinct(self.relation(name)).createOrReplaceTempView(name)

    def _evaluate(self, wanted: set[str], used: Counter | None = None) -> None:
        """Have the relations ``wanted``, which the question uses so often. A derived one that is used more than once is written once."""
        rules = [r for r in self.program.rules if r.body]
        arity = self._arity()
        needed, todo = set(), list(wanted)
        while todo:
            name = todo.pop()
            if name not in needed:
                needed.add(name)
                todo += [a.name for r in rules if r.head.name == name for a in r.positive + r.negative]
        heads = {r.head.name for r in rules}
        uses = Counter(used or ()) + Counter(a.name for r in rules if r.head.name in needed for a in r.positive + r.negative)
        plain = needed - heads
        for name in plain - self._done.keys():
            base = self._base(name)
            empty = self.spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(arity.get(name, 1))) or "c0 string")
            self._done[name] = reduce(DataFrame.unionByName, base) if base else empty
        for group in evaluation_order(rules):
            if group[0] not in needed or group[0] in self._done:
                continue
            own = [r for r in rules if r.head.name in group]
            base = {p: reduce(DataFrame.unionByName, parts) for p in group if (parts := self._base(p))}
            if any(a.name in group for r in own for a in r.positive):
                if (edges := closure_of(own, bool(base))) is not None:
                    self._done[group[0]] = closure(self.spark, self._done[edges], self.most_rounds)
                    self._written.add(group[0])
                    continue
                others = {a.name for r in own for a in r.positive + r.negative} - set(group)
                inputs = staged({n: self._done[n] for n in others}, others, plain | self._written)
                self._written |= others - plain
                self._done |= inputs
                self._done |= fixpoint(self.spark, group, own, inputs, base, self.most_rounds)
                self._written |= set(group)
            else:
                source = lambda a, _: self._done[a.name]
                if len(own) == 1 and not base:
                    rows = derived_once(self.spark, own[0], source)
                else:
                    rows = distinct(reduce(DataFrame.unionByName, [*base.values(), *(derived(self.spark, r, source) for r in own)]))
                if uses[group[0]] > 1 and rows.columns:
                    rows = table(rows)
                    self._written.add(group[0])
                self._done[group[0]] = rows

    def query(self, query: str | tuple[Atom | Comparison, ...]) -> DataFrame:
        """Distinct bindings of a query (``a(X), not b(X), X != "c"``), a column for each named variable.

        Wildcards have no column. A query without variables has one row if it holds and none if not.
        """
        if isinstance(query, str):
            text = query.strip().removeprefix("?-").rstrip(". \n")
            query = read_program(f"?- {text}.").queries[0]
        check_safety(Rule(Atom("query", ()), query))
        self._arity(query)
        if (bound := self._bound_closure(query)) is not None:
            return answers(self.spark, query, lambda a, _: bound)
        used = Counter(a.name for a in query if isinstance(a, Atom))
        names = set(used)
        arity = {a.name: len(a.terms) for a in query if isinstance(a, Atom)}
        self._evaluate(names, used)
        relations = {n: self._done[n] for n in names}
        for n, k in arity.items():
            if len(relations[n].columns) != k:
                relations[n] = self.spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(k)))
        heads = {r.head.name for r in self.program.rules if r.body}  # derived relations have each row once
        return answers(self.spark, query, lambda a, _: relations[a.name], sets=all(a.name in heads for a in query if isinstance(a, Atom) and not a.negated))

    def _bound_closure(self, query: tuple[Atom | Comparison, ...]) -> DataFrame | None:
        """For a query of one atom that fixes an argument of a closure not evaluated yet: the pairs with that constant."""
        atoms = [a for a in query if isinstance(a, Atom)]
        if len(atoms) != 1 or atoms[0].negated or atoms[0].name in self._done or len(atoms[0].terms) != 2:
            return None
        name, (first, last) = atoms[0].name, atoms[0].terms
        edges = closure_of([r for r in self.program.rules if r.head.name == name], bool(self._base(name)))
        if edges is None or isinstance(first, Var) and isinstance(last, Var):
            return None
        self._evaluate({edges})
        forward = not isinstance(first, Var)
        return reached(self.spark, self._done[edges], first if forward else last, forward, self.most_rounds)

    def results(self) -> list[tuple[tuple[Atom | Comparison, ...], DataFrame]]:
        """The queries of the loaded programs, in order, with their answers."""
        return [(q, self.query(q)) for q in self.program.queries]
