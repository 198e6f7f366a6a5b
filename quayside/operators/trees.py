"""Figures of many small dependency trees at once: whole projects lie in one batch, and a level of all its trees is one step.

Projects without a cycle are counted by (node, depth); in the others every path is listed. A project whose levels cost more than
``COST`` cells for each of its rows, or whose counts do not fit, is handed back untouched: its rows come out as they went in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows of whole projects that are looked at together, cells that a project may cost per row, and the largest count.
ROWS, COST, LARGEST = 100_000, 400, 1 << 40
COUNTED, CLOSING, FIGURES, HANDED = 0, 1, 2, 3
# Rows of projects with more rows than this do not belong here.
MOST_ROWS = 20_000

FIELDS = "kind int, node string, child string, start boolean, depth int, n long, closings long, nodes long, repeated long"


def in_trees(wanted: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (project_id, node, child, start) in the order of their project: edges, and starts without a child."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(_begun(table).nonzero()[0][-1])
            held = table.slice(last).to_batches()
            if last:
                yield from _figures(table.slice(0, last), wanted)
        if held:
            yield from _figures(pa.Table.from_batches(held).combine_chunks(), wanted)

    return walk


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _begun(table: pa.Table) -> np.ndarray:
    """Where a project begins."""
    project = _column(table, "project_id")
    begun = np.ones(len(project), dtype=bool)
    begun[1:] = pc.not_equal(project.slice(1), project.slice(0, len(project) - 1)).to_numpy(zero_copy_only=False)
    return begun


def _figures(table: pa.Table, wanted: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    begun = _begun(table)
    first, of = np.flatnonzero(begun), np.cumsum(begun) - 1
    project, parent, child = (_column(table, c) for c in ("project_id", "node", "child"))
    starts = _column(table, "start").to_numpy(zero_copy_only=False)
    names = pa.concat_arrays([parent, child]).dictionary_encode()
    none = len(names.dictionary)  # a missing name is no node that could be the same as another
    code = names.indices.fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.concatenate((of, of)) * (none + 1) + code
    used = np.concatenate((np.ones(len(of), dtype=bool), ~starts))
    nodes, at = np.unique(key[used], return_inverse=True)
    from_, to = at[: len(of)], np.empty(len(of), np.int64)
    to[~starts] = at[len(of) :]
    node_of, node_name = nodes // (none + 1), nodes % (none + 1)
    begin = np.unique(from_[starts])
    linked = ~starts & (node_name[from_] != none)
    links = np.unique(from_[linked] * len(nodes) + to[linked])
    source, target = links // len(nodes), links % len(nodes)
    at = np.searchsorted(source, np.arange(len(nodes) + 1))
    budget, cost = COST * np.bincount(of, minlength=len(first)), np.zeros(len(first), np.int64)
    handed = np.zeros(len(first), dtype=bool)

    def onward(here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of nodes: which of the nodes, and where to."""
        many = at[here + 1] - at[here]
        which = np.repeat(np.arange(len(here)), many)
        return which, target[np.arange(len(which)) + np.repeat(at[here] - np.cumsum(many) + many, many)]

    def affordable(here: np.ndarray, width: int) -> np.ndarray:
        """Which nodes may be entered; projects that would cost too much are handed back."""
        whose = node_of[here]
        np.add(cost, np.bincount(whose, minlength=len(first)) * width, out=cost)
        np.logical_or(handed, cost > budget, out=handed)
        return ~handed[whose]

    waiting = np.bincount(target, minlength=len(nodes))
    free = np.flatnonzero(waiting == 0)
    while len(free):  # nodes go when nothing leads to them any more; what is left holds a cycle
        met, times = np.unique(onward(free)[1], return_counts=True)
        waiting[met] -= times
        free = met[waiting[met] == 0]
    cyclic = np.zeros(len(first), dtype=bool)
    cyclic[node_of[waiting > 0]] = True

    found = []  # node, depth, paths that end there without and with a cycle
    here, n, depth = begin[~cyclic[node_of[begin]]], np.ones(int((~cyclic[node_of[begin]]).sum()), np.int64), 0
    while len(here):
        found.append((here, np.full(len(here), depth), n, np.zeros(len(here), np.int64)))
        which, ahead = onward(here)
        may = affordable(ahead, 1)
        here, back = np.unique(ahead[may], return_inverse=True)
        n = np.bincount(back, weights=n[which[may]], minlength=len(here)).astype(np.int64)
        handed[node_of[here[n > LARGEST]]] = True
        kept = ~handed[node_of[here]]
        here, n, depth = here[kept], n[kept], depth + 1
    closing = []
    here, depth = begin[cyclic[node_of[begin]]], 0
    path, closes = here[:, None], np.zeros(len(here), dtype=bool)
    while len(here):
        found.append((here, np.full(len(here), depth), (~closes).astype(np.int64), closes.astype(np.int64)))
        closing.append((path[closes, -2], here[closes]) if depth else (here[:0], here[:0]))
        which, ahead = onward(here[~closes])
        may = affordable(ahead, depth + 2)
        before, here, depth = path[~closes][which[may]], ahead[may], depth + 1
        closes = (before == here[:, None]).any(axis=1)
        path = np.concatenate((before, here[:, None]), axis=1)

    node, deep, n, c = (np.concatenate(column) if found else np.empty(0, np.int64) for column in (list(zip(*found)) or [()] * 4))
    kept = ~handed[node_of[node]]
    node, deep, n, c = node[kept], deep[kept], n[kept], c[kept]
    named = names.dictionary

    def text(which: np.ndarray) -> pa.Array:
        name = node_name[which]
        return named.take(pa.array(name, mask=name == none))

    def rows(kind: int, whose: pa.Array, **columns) -> pa.RecordBatch:
        size = len(whose)
        fields = {"node": pa.string(), "child": pa.string(), "start": pa.bool_(), "depth": pa.int32(), "n": pa.int64(), "closings": pa.int64(), "nodes": pa.int64(), "repeated": pa.int64()}
        made = [whose, pa.array(np.full(size, kind, np.int32))]
        made += [(v if isinstance(v, pa.Array) else pa.array(v)).cast(t) if (v := columns.get(name)) is not None else pa.nulls(size, t) for name, t in fields.items()]
        return pa.RecordBatch.from_arrays(made, names=["project_id", "kind", *fields])

    def sums(groups: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(size, np.int64)
        np.add.at(total, groups, values)
        return total

    if COUNTED in wanted and len(node):
        place, back = np.unique(node * (int(deep.max()) + 1) + deep, return_inverse=True)
        which = place // (int(deep.max()) + 1)
        yield rows(COUNTED, project.take(pa.array(first[node_of[which]])), node=text(which), depth=place % (int(deep.max()) + 1), n=sums(back, n, len(place)), closings=sums(back, c, len(place)))
    if CLOSING in wanted and closing:
        pair = np.unique(np.concatenate([a * len(nodes) + b for a, b in closing]))
        pair = pair[~handed[node_of[pair // len(nodes)]]]
        yield rows(CLOSING, project.take(pa.array(first[node_of[pair // len(nodes)]])), node=text(pair // len(nodes)), child=text(pair % len(nodes)))
    if FIGURES in wanted and len(node):
        seen, back = np.unique(node, return_inverse=True)
        times = sums(back, n + c, len(seen))
        whose, back_of = np.unique(node_of[seen], return_inverse=True)
        deepest = np.zeros(len(whose), np.int64)
        np.maximum.at(deepest, back_of[back], deep)
        yield rows(FIGURES, project.take(pa.array(first[whose])), depth=deepest, n=sums(back_of, times, len(whose)), closings=sums(back_of[back], c, len(whose)),
                   nodes=np.bincount(back_of), repeated=np.bincount(back_of, weights=times > 1).astype(np.int64))
    if handed.any():
        mine = pa.array(handed[of])
        yield rows(HANDED, project.filter(mine), node=parent.filter(mine), child=child.filter(mine), start=_column(table, "start").filter(mine))
