"""Clauses of a program: facts, rules, mappings and queries, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


#: A term is a variable or a constant text.
Term = Var | str


def shown(term: Term) -> str:
    """A term as a program has it."""
    return f'"{term}"' if isinstance(term, str) else "_" if term.name.startswith("_#") else term.name


@dataclass(frozen=True)
class Atom:
    name: str
    terms: tuple[Term, ...]
    negated: bool = False

    def __str__(self) -> str:
        return f"{'not ' * self.negated}{self.name}({', '.join(map(shown, self.terms))})"


@dataclass(frozen=True)
class Comparison:
    left: Term
    op: str
    right: Term

    def __str__(self) -> str:
        return f"{shown(self.left)} {self.op} {shown(self.right)}"


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom | Comparison, ...] = ()

    @property
    def positive(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom) and not x.negated]

    @property
    def negative(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom) and x.negated]

    @property
    def comparisons(self) -> list[Comparison]:
        return [x for x in self.body if isinstance(x, Comparison)]


@dataclass(frozen=True)
class Mapping:
    """name(args) holds for facts whose entities have these types in this order, with these ids where constant."""

    name: str
    args: tuple[str, ...]
    pattern: tuple[tuple[str, Term], ...]


@dataclass
class Program:
    rules: list[Rule] = field(default_factory=list)
    mappings: list[Mapping] = field(default_factory=list)
    queries: list[tuple[Atom | Comparison, ...]] = field(default_factory=list)

    def extend(self, other: Program) -> None:
        self.rules += other.rules
        self.mappings += other.mappings
        self.queries += other.queries


def variables(*terms: Term) -> list[str]:
    """Names of the variables among ``terms``, each once, in order."""
    return list(dict.fromkeys(t.name for t in terms if isinstance(t, Var)))
