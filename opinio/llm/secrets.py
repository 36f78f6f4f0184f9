"""Secret scans with one combined automaton.

All rules are compiled together: each regex becomes a nondeterministic
automaton over bytes, the union is determinised by subset construction and
minimised by partition refinement, and the result is a dense transition
array over byte classes.  The rules are compiled reversed, so that one
right-to-left pass over the bytes marks, for all rules at once, every
position where a match of some rule starts.  From a marked position the
rule's own forward automaton (compiled the same way) walks to the longest
end.  Matches of one rule are leftmost and do not overlap.

The byte pass is vectorised over stretches of text.  A byte on which every
state falls back to the start state (line ends, commas, ...) ends a stretch,
so all stretches of a batch advance together, one byte per step.

A rule may demand a least length of the match, or of its tail, counted from
the first byte on which the match could already end (for ``assign`` this is
the value); a match that fails still uses up its text, as in a scan with a
regex engine.

Defined cases: a null or empty text has no spans; a very long text is scanned whole; every row of the input
gives one row; repeated rows are scanned again; matches of different rules may overlap (of those that start at one place
the kinds come in the order of the rules); an empty table gives an empty result; other columns are ignored.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, texts

BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1             # bytes of the whole match
    least_tail: int = 1        # bytes from the first possible end on
    any_case: bool = False


#: Base rules first.  Least lengths are tested on the longest match, not counted by the automaton:
#: counters of several rules would multiply its states.  ``hex`` counts to eight, which keeps the
#: letters a-f of ordinary words from being marked; its matches are whole runs, so a run that is too
#: short holds no other match.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         least_tail=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{8}[0-9a-f]*", least=24),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", least=39),
)


class _Nfa:
    """Thompson construction over byte sets from the regex module's parse tree."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.skips: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, any_case: bool, backward: bool) -> int:
        """Append the tree after ``start``; gives the state after it."""
        for op, arg in (reversed(list(tree)) if backward else tree):
            name = str(op)
            if name in ("LITERAL", "IN"):
                end = self.state()
                self.moves[start].append((_bytes(name, arg, any_case), end))
            elif name == "SUBPATTERN":
                end = self.add(arg[3], start, any_case, backward)
            elif name == "BRANCH":
                end = self.state()
                for part in arg[1]:
                    s = self.state()
                    self.skips[start].append(s)
                    self.skips[self.add(part, s, any_case, backward)].append(end)
            elif name == "MAX_REPEAT":
                low, high, part = arg
                end = start
                for _ in range(low):
                    end = self.add(part, end, any_case, backward)
                if high == re._constants.MAXREPEAT:
                    loop = self.state()
                    self.skips[end].append(loop)
                    self.skips[self.add(part, loop, any_case, backward)].append(loop)
                    end = loop
                else:
                    after = self.state()
                    for _ in range(high - low):
                        self.skips[end].append(after)
                        end = self.add(part, end, any_case, backward)
                    self.skips[end].append(after)
                    end = after
            else:
                raise ValueError(f"rule uses an unsupported construct: {name}")
            start = end
        return start


def _bytes(name: str, arg, any_case: bool) -> frozenset:
    if name == "LITERAL":
        out = {arg}
    else:
        out = set()
        for op, x in arg:
            if str(op) == "LITERAL":
                out.add(x)
            elif str(op) == "RANGE":
                out.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"rule uses an unsupported class: {op}")
    if max(out) > 127:
        raise ValueError("rules are over ASCII")
    if any_case:
        out |= {ord(chr(b).swapcase()) for b in out if chr(b).isalpha()}
    return frozenset(out)


class Automaton:
    """Minimal deterministic automaton of several rules.

    ``table[state * n_classes + classes[byte]]`` is the next state and
    ``accept[state]`` the set of rules (bits) that end there.  State 0 starts.
    """

    def __init__(self, rules: tuple[Rule, ...], backward: bool, anchored: bool):
        nfa = _Nfa()
        root = nfa.state()
        final: dict[int, int] = {}
        for bit, rule in enumerate(rules):
            s = nfa.state()
            nfa.skips[root].append(s)
            final[nfa.add(re._parser.parse(rule.pattern), s, rule.any_case, backward)] = 1 << bit

        # byte classes: bytes that no rule tells apart
        sets = sorted({m[0] for ms in nfa.moves for m in ms}, key=sorted)
        told = [tuple(b in s for s in sets) for b in range(256)]
        names = {t: i for i, t in enumerate(dict.fromkeys(told))}
        self.classes = np.array([names[t] for t in told], dtype=np.uint8)
        self.n_classes = len(names)
        sample = [told.index(t) for t in names]

        def closure(states) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.skips[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        # subset construction; an unanchored automaton may start a match at every byte
        first = closure([root])
        ids, table, accept, todo = {first: 0}, [], [], [first]
        while todo:
            own = todo.pop(0)
            accept.append(sum({final[s] for s in own if s in final}))
            row = []
            for b in sample:
                to = {t for s in own for chars, t in nfa.moves[s] if b in chars}
                nxt = closure(to | (set() if anchored else {root}))
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row.append(ids[nxt])
            table.append(row)

        # minimisation: refine the partition by accepted rules until no class splits
        table, accept = np.array(table), np.array(accept)
        part = np.unique(accept, return_inverse=True)[1]
        while True:
            refined = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
            if refined.max() == part.max():
                break
            part = refined
        order = {int(part[0]): 0}                            # the start state is state 0
        for p in part:
            order.setdefault(int(p), len(order))
        part = np.array([order[int(p)] for p in part])
        rows = [int(np.flatnonzero(part == p)[0]) for p in range(len(order))]
        self.table = part[table[rows]].astype(np.int32).ravel()
        self.accept = accept[rows].astype(np.int64)
        dense = self.table.reshape(-1, self.n_classes)
        #: bytes after which every state is the start state
        self.resets = np.isin(self.classes, np.flatnonzero((dense == 0).all(axis=0)))


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton]]:
    return (Automaton(rules, backward=True, anchored=False),
            [Automaton((r,), backward=False, anchored=True) for r in rules])


def match_starts(data: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a match of some rule starts, ascending, with the rules' bits."""
    classes = automaton.classes[data]
    edges = np.concatenate(([-1], np.flatnonzero(automaton.resets[data]), [len(data)]))
    starts, sizes = edges[:-1] + 1, np.diff(edges) - 1
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    at = starts + sizes - 1                                  # the last byte of each stretch
    state = np.zeros(len(at), dtype=np.int32)
    table, accept, n = automaton.table, automaton.accept, automaton.n_classes
    step, live, where = 0, int(np.count_nonzero(sizes)), []
    fewer = -sizes
    while live:
        s = table[state[:live] * n + classes[at[:live] - step]]
        state[:live] = s
        if (hit := accept[s]).any():
            k = np.flatnonzero(hit)
            where.append((at[k] - step, hit[k]))
        step += 1
        live = int(np.searchsorted(fewer, -step, side="right"))
    if not where:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pos, bits = (np.concatenate(x) for x in zip(*where))
    order = np.argsort(pos, kind="stable")
    return pos[order], bits[order]


def _longest(text: bytes, start: int, rule: Automaton) -> tuple[int, int]:
    """(end, tail): the longest match from ``start`` and its length from the first possible end."""
    state, end, tail = 0, -1, 0
    table, accept, classes, n = rule.table, rule.accept, rule.classes, rule.n_classes
    dead = rule.dead
    for i in range(start, len(text)):
        state = table[state * n + classes[text[i]]]
        if state == dead:
            break
        if accept[state]:
            end = i + 1
            tail += 1
    return end, tail


def _dead(rule: Automaton) -> int:
    dense = rule.table.reshape(-1, rule.n_classes)
    for s in range(len(dense)):
        if not rule.accept[s] and (dense[s] == s).all():
            return s
    return -1


def scan(rows: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text the spans ``(start, end, rule)`` in code points, by start, then rule."""
    combined, singles = compiled(rules)
    for r in singles:
        if not hasattr(r, "dead"):
            r.dead = _dead(r)
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))       # a line end between texts
    data = np.frombuffer(b"\n".join(rows) + b"\n", dtype=np.uint8)
    pos, bits = match_starts(data, combined)
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    if not len(pos):
        return out
    owner = np.searchsorted(begin, pos, side="right") - 1
    for d in np.unique(owner):
        a, b = np.searchsorted(owner, (d, d + 1))
        text, free, spans = rows[d], [0] * len(rules), []
        for p, m in zip((pos[a:b] - begin[d]).tolist(), bits[a:b].tolist()):
            for k, rule in enumerate(rules):
                if m >> k & 1 and p >= free[k]:
                    end, tail = _longest(text, p, singles[k])
                    free[k] = end
                    if tail >= rule.least_tail and end - p >= rule.least:
                        spans.append((p, end, k))
        if spans and not text.isascii():                      # byte offsets to code points
            raw = np.frombuffer(text, dtype=np.uint8)
            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            spans = [(int(points[s]), int(points[e]), k) for s, e, k in spans]
        out[d] = sorted(spans, key=lambda s: (s[0], s[2]))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: all spans of every text, by start, then in the rules' order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan(texts(b), rules)
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    source = narrow(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")
