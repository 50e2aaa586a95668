"""A rule as one DataFrame: joins, filters and anti-joins over the relations of its body.

A relation has text columns c0, c1, ...; inside a rule there is one column for each variable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.compare import as_integer, compare
from factloom.operators.pairs import dealt, makes_many
from factloom.plans.clauses import Atom, Comparison, Rule, Term, Var, variables
from factloom.staging import table


def _column(name: str) -> str:
    return f"v_{name.replace('#', '')}"


def scan(relation: DataFrame, atom: Atom) -> DataFrame:
    """The rows of a relation that an atom's constants and repeated variables allow, a column for each variable."""
    first: dict[str, str] = {}
    for i, term in enumerate(atom.terms):
        own = F.col(f"c{i}")
        if not isinstance(term, Var):
            relation = relation.filter(own == F.lit(term))
        elif term.name in first:
            relation = relation.filter(own == F.col(first[term.name]))
        else:
            first[term.name] = f"c{i}"
    return relation.select(*[F.col(c).alias(_column(v)) for v, c in first.items()])


def _side(term: Term):
    return F.col(_column(term.name)) if isinstance(term, Var) else term


def satisfying(spark: SparkSession, body: tuple[Atom | Comparison, ...], relation_of) -> DataFrame:
    """Bindings of the variables of a body. ``relation_of`` gives the relation of the i-th positive atom, or of a negated one.

    Atoms are joined on all the variables they share; next is always one that shares some, so a
    cross join is made only where the body has parts without a common variable. A variable used
    nowhere else, such as a wildcard, is dropped before the join.
    """
    positive = [(i, a) for i, a in enumerate(x for x in body if isinstance(x, Atom) and not x.negated)]
    comparisons = [x for x in body if isinstance(x, Comparison)]
    out, names = None, set()
    left = positive
    while left:
        index, atom = next(((i, a) for i, a in left if names & set(variables(*a.terms))), left[0])
        left = [x for x in left if x[0] != index]
        right, own = scan(relation_of(atom, index), atom), set(variables(*atom.terms))
        if out is None:
            out = right
        elif shared := sorted(names & own):
            out = out.join(right, [_column(v) for v in shared])
        else:
            out = out.crossJoin(right)
        names |= own
        ready = [c for c in comparisons if set(variables(c.left, c.right)) <= names]
        for c in ready:
            comparisons.remove(c)
            out = out.filter(compare(_side(c.left), c.op, _side(c.right)))
    if out is None:
        out = spark.range(1).select()
    for c in comparisons:
        left_side, right_side = _side(c.left), _side(c.right)
        out = out.filter(compare(F.lit(left_side) if isinstance(left_side, str) else left_side, c.op, right_side))
    for atom in (x for x in body if isinstance(x, Atom) and x.negated):
        right = scan(relation_of(atom, None), atom)
        shared = [_column(v) for v in variables(*atom.terms)]
        out = out.join(right, shared, "left_anti") if shared else out.join(right.limit(1), F.lit(True), "left_anti")
    return out


def derived(spark: SparkSession, rule: Rule, relation_of) -> DataFrame:
    """Rows of a rule's head, which may repeat."""
    return _head(rule, satisfying(spark, rule.body, relation_of))


def _head(rule: Rule, rows: DataFrame) -> DataFrame:
    return rows.select(*[(F.col(_column(t.name)) if isinstance(t, Var) else F.lit(t)).alias(f"c{i}") for i, t in enumerate(rule.head.terms)])


def derived_once(spark: SparkSession, rule: Rule, relation_of) -> DataFrame:
    """Rows of a rule's head, once each.

    Where two atoms pair many rows on a variable they share (``p(A, B) :- r(A, N), s(B, N)``), the pairs are
    not compared with one another: an A with a single row of r has one N, so each of its pairs is made once,
    and so is each pair of a B with a single row of s. Only pairs of which both sides have several rows may
    repeat, and only these are made distinct.
    """
    atoms = [a for a in rule.body if isinstance(a, Atom)]
    if len(atoms) != 2 or any(a.negated for a in atoms):
        return distinct(derived(spark, rule, relation_of))
    comparisons = [c for c in rule.body if isinstance(c, Comparison)]
    compared = set(variables(*(t for c in comparisons for t in (c.left, c.right))))
    inside = [set(variables(*a.terms)) for a in atoms]
    head, shared = set(variables(*rule.head.terms)), inside[0] & inside[1]
    used = head | shared | compared
    if not shared or not all(own & head - shared for own in inside):
        return distinct(derived(spark, rule, relation_of))
    keys = [_column(v) for v in sorted(shared)]
    sides = [table(scan(relation_of(a, i), a).select(*[_column(v) for v in sorted(own & used)]).distinct()) for i, (a, own) in enumerate(zip(atoms, inside, strict=True))]
    split = [_by_rows(side, [_column(v) for v in sorted(own & head)]) for side, own in zip(sides, inside, strict=True)] if makes_many(*sides, keys) else None

    def paired(left: DataFrame, right: DataFrame, join) -> DataFrame:
        number = lambda rows, own: rows.select("*", *[as_integer(F.col(_column(v))).alias(f"n{_column(v)}") for v in sorted(own & compared)])
        rows = join(number(left, inside[0]), number(right, inside[1] - shared), keys)
        for c in comparisons:
            integers = tuple(F.col(f"n{_column(t.name)}") if isinstance(t, Var) else None for t in (c.left, c.right))
            rows = rows.filter(compare(_side(c.left), c.op, _side(c.right), integers))
        return _head(rule, rows)

    if split is None:
        return distinct(paired(*sides, DataFrame.join))
    (one, several), (other_one, other_several) = split
    if used - head <= shared:
        once, again = [(one, sides[1]), (several, other_one)], [(several, other_several)]
    else:
        once, again = [(one, other_one)], [(one, other_several), (several, sides[1])]
    parts = [paired(x, y, dealt) for x, y in once if x is not None and y is not None]
    parts += [paired(x, y, dealt).distinct() for x, y in again if x is not None and y is not None]
    return reduce(DataFrame.unionByName, parts)


def _by_rows(rows: DataFrame, own: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Of distinct rows, those whose values of ``own`` are in no other, and the rest if there are any."""
    if len(own) == len(rows.columns):
        return rows, None
    several = table(rows.groupBy(*own).count().filter("count > 1").select(*own))
    if several.isEmpty():
        return rows, None
    return rows.join(several, own, "left_anti"), rows.join(several, own, "left_semi")


def distinct(rows: DataFrame) -> DataFrame:
    """Rows once each; of rows without columns at most one."""
    return rows.distinct() if rows.columns else rows.limit(1)


def answers(spark: SparkSession, body: tuple[Atom | Comparison, ...], relation_of, sets: bool = False) -> DataFrame:
    """Distinct bindings of a query's named variables; a query without any has one row without columns if it holds.

    Where the rows of all its relations are distinct (``sets``) and no variable is left out, so are the bindings.
    """
    rows = satisfying(spark, body, relation_of)
    names = [v for v in variables(*(t for a in body if isinstance(a, Atom) and not a.negated for t in a.terms)) if not v.startswith("_#")]
    if not names:
        return rows.limit(1).select()
    wildcard = any(v.startswith("_#") for a in body if isinstance(a, Atom) and not a.negated for v in variables(*a.terms))
    rows = rows.select(*[F.col(_column(v)).alias(v) for v in names])
    return rows if sets and not wildcard else rows.distinct()
