"""Which source columns a frame's columns come from, read off its analysed plan.

Names can be changed and values derived; expression ids can't. Every column of a plan is
followed through aliases, joins, unions, aggregates, windows and generators down to the
scans. A node that makes columns in a way that the plan doesn't show (Python functions
over whole rows) passes on all that it reads. Lineage starts anew where a frame was
checkpointed or made from local rows: there a column's name is its source.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def _seq(x) -> Iterator:
    it = x.iterator()
    while it.hasNext():
        yield it.next()


def _id(attribute) -> str:
    return attribute.exprId().toString()


def _aliases(expression) -> Iterator[tuple[str, set[str]]]:
    """(id, ids it is computed from) of every named expression inside."""
    if expression.getClass().getSimpleName() == "Alias":
        yield _id(expression), {_id(a) for a in _seq(expression.references())}
    for child in _seq(expression.children()):
        yield from _aliases(child)


def _sources(plan, conditions: bool) -> tuple[list[str], dict[str, frozenset[str]]]:
    """Ids of plan's output in order, and the source columns of every id known there."""
    children = [_sources(c, conditions) for c in _seq(plan.children())]
    output = list(_seq(plan.output()))
    ids = [_id(a) for a in output]
    if not children:
        return ids, {i: frozenset([a.name().lower()]) for i, a in zip(ids, output, strict=True)}
    known: dict[str, frozenset[str]] = {}
    for _, found in children:
        known |= found
    of = lambda wanted: frozenset().union(*(known.get(i, frozenset()) for i in wanted))
    made: dict[str, set[str]] = {}
    for e in _seq(plan.expressions()):
        for i, wanted in _aliases(e):
            made.setdefault(i, set()).update(wanted)
    read = {_id(a) for a in _seq(plan.references())}
    kind = plan.getClass().getSimpleName()
    fresh = {}
    for place, i in enumerate(ids):
        if kind in ("Union", "Intersect", "Except"):
            fresh[i] = frozenset().union(*(found.get(own[place], frozenset()) for own, found in children))
        elif i in made and i not in known:
            # an alias of an alias inside one node: follow until only inputs are left
            wanted, seen = set(made[i]), {i}
            while rest := [w for w in wanted if w in made and w not in known and w not in seen]:
                for w in rest:
                    seen.add(w)
                    wanted = (wanted - {w}) | made[w]
            fresh[i] = of(wanted)
        elif i in known:
            fresh[i] = known[i]
        else:
            fresh[i] = of(read) if read else of(known)
    if conditions and kind in ("Filter", "Join", "Aggregate"):
        chosen = of(read) if kind != "Aggregate" else of({_id(a) for e in _seq(plan.groupingExpressions()) for a in _seq(e.references())})
        fresh = {i: x | chosen for i, x in fresh.items()}
    return ids, known | fresh


def lineage(df: DataFrame, conditions: bool = False) -> dict[str, set[str]]:
    """The source columns (names in lower case) that each column of df is computed from.

    With conditions, also those that decide which rows are there: filters, joins, grouping keys.
    """
    plan = df._jdf.queryExecution().analyzed()
    ids, found = _sources(plan, conditions)
    return {a.name(): set(found[i]) for a, i in zip(_seq(plan.output()), ids, strict=True)}


def barrier(df: DataFrame, forbidden: frozenset[str], conditions: bool = False) -> DataFrame:
    """df, refused if any of its columns is computed from a forbidden source column, whatever it is called now."""
    bad = {c: sorted(x & forbidden) for c, x in lineage(df, conditions).items() if x & forbidden}
    if bad:
        raise ValueError(f"columns computed from what must not reach this stage: {bad}")
    return df
