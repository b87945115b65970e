"""Generalised LL recognition over a graph-structured stack.

A grammar is written in EBNF and compiled into a graph of numbered slots: an
alternative, an option and a repetition are branches within their rule, so a list
of any length lies on one stack node and costs one step an element. A stack node
is a (rule, position) pair shared by all callers that reach it; its edges say
where to go on when the rule has matched, its pops where it matched to. Ambiguous
and left-recursive grammars need no rewriting, and the work is at most cubic.

Two tokens of lookahead keep the deterministic parts of a grammar a plain loop:
a branch is taken only if its first two tokens can be the next two, a rule ends
only before a token of its FOLLOW set, and a rule that matches the next token and
cannot go on with the one after it is stepped over without a stack node. Several
start rules, one for each dialect, run over one stack together and share all
nodes of rules that they have in common.

Terminals are quoted texts or names in capitals; a token may count as several
terminals (a contextual keyword is also a name). Zero-width conditions: ``@end``
(a line break before the next token, a closing brace or the end of the text),
``@same`` (no line break before it), ``@glued`` (no blank before it) and
``@noelse`` (it is no ``else``).
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kinds: frozenset[str]
    line: int
    broken: bool = False  # a line break stands before it
    glued: bool = False  # nothing stands before it


TERMINAL, RULE, BRANCH, DONE, CONDITION = range(5)
#: What ``_predict`` gives for a rule that can match nothing but the next token.
SINGLE = (-1,)
_LEX = re.compile(r"\s+|--[^\n]*|'([^']+)'|(@\w+)|(\w+)|([=|;()?*+])")


class Grammar:
    def __init__(self, text: str, starts: tuple[str, ...] = ("File",)):
        self.starts = starts
        tokens = [m.group(m.lastindex) if m.lastindex != 1 else "'" + m.group(1) for m in _LEX.finditer(text) if m.lastindex]
        if sum(len(m.group()) for m in _LEX.finditer(text)) != len(text):
            raise ValueError("the grammar holds something unknown")
        self._tokens, self._at = tokens, 0
        rules: dict[str, list] = {}
        while self._at < len(tokens):
            name = self._next()
            if self._next() != "=":
                raise ValueError(f"no = after {name}")
            rules.setdefault(name, []).extend(self._choice())
            if self._next() != ";":
                raise ValueError(f"no ; after {name}")
        self._compile(rules)
        self._look_ahead()

    # Reading: an item is a symbol or (mark, alternatives) with one of the marks ( ? * +

    def _next(self) -> str:
        self._at += 1
        return self._tokens[self._at - 1]

    def _choice(self) -> list[list]:
        alternatives: list[list] = [[]]
        while self._tokens[self._at] not in (";", ")"):
            t = self._next()
            if t == "|":
                alternatives.append([])
                continue
            item = t
            if t == "(":
                item = ("(", self._choice())
                self._next()
            while self._tokens[self._at] in ("?", "*", "+"):
                item = (self._next(), item[1] if item[0] == "(" else [[item]])
            alternatives[-1].append(item)
        return alternatives

    # Compiling, from the end of a rule to its beginning

    def _slot(self, kind: int, value, after: int, rule: int) -> int:
        self.kind.append(kind)
        self.value.append(value)
        self.after.append(after)
        self.rule.append(rule)
        return len(self.kind) - 1

    def _bit(self, terminal: str) -> int:
        return self.bits.setdefault(terminal, 1 << len(self.bits))

    def _compile(self, rules: dict[str, list]) -> None:
        self.kind: list[int] = []
        self.value: list = []  # of a terminal its bit, of a rule its entry, of a branch its targets
        self.after: list[int] = []
        self.rule: list[int] = []  # the rule a slot belongs to
        self.bits: dict[str, int] = {}
        self.end = self._bit("EOF")
        self.names = list(rules)
        number = {r: k for k, r in enumerate(rules)}

        def sequence(items: list, after: int, rule: int) -> int:
            for item in reversed(items):
                if isinstance(item, tuple):
                    mark, alternatives = item
                    if mark == "(":
                        after = self._slot(BRANCH, [sequence(a, after, rule) for a in alternatives], -1, rule)
                    elif mark == "?":
                        after = self._slot(BRANCH, [*(sequence(a, after, rule) for a in alternatives), after], -1, rule)
                    else:
                        loop = self._slot(BRANCH, [], -1, rule)
                        bodies = [sequence(a, loop, rule) for a in alternatives]
                        self.value[loop] = [*bodies, after]
                        after = loop if mark == "*" else self._slot(BRANCH, bodies, -1, rule) if len(bodies) > 1 else bodies[0]
                elif item[0] == "@":
                    after = self._slot(CONDITION, item[1:], after, rule)
                elif item[0] == "'" or item.isupper():
                    after = self._slot(TERMINAL, self._bit(item.lstrip("'") if item != "'" else item), after, rule)
                else:
                    if item not in number:
                        raise ValueError(f"{self.names[rule]} uses the unknown rule {item}")
                    after = self._slot(RULE, number[item], after, rule)
            return after

        self.entry = []
        for k, alternatives in enumerate(rules.values()):
            done = self._slot(DONE, None, -1, k)
            self.entry.append(self._slot(BRANCH, [sequence(a, done, k) for a in alternatives], -1, k))
        self.value = [self.entry[v] if kind == RULE else v for kind, v in zip(self.kind, self.value)]
        self.number = number

    def _look_ahead(self) -> None:
        """Of each slot, up to the end of its rule: the terminals that can come first and second, those that can come alone, and whether nothing can."""
        kind, value, after, n = self.kind, self.value, self.after, len(self.kind)
        first, one, empty = [0] * n, [0] * n, [False] * n
        # the same without passing a condition, which may forbid it
        sure, bare = [0] * n, [False] * n
        order = list(range(n))
        changed = True
        while changed:
            changed = False
            for s in order:
                k, a = kind[s], after[s]
                if k == TERMINAL:
                    t = value[s]
                    new = t, t if empty[a] else 0, False, t if bare[a] else 0, False
                elif k == RULE:
                    r = value[s]
                    new = (
                        first[r] | (first[a] if empty[r] else 0),
                        (one[r] if empty[a] else 0) | (one[a] if empty[r] else 0),
                        empty[r] and empty[a],
                        (sure[r] if bare[a] else 0) | (sure[a] if bare[r] else 0),
                        bare[r] and bare[a],
                    )
                elif k == BRANCH:
                    f = o = u = 0
                    e = b = False
                    for v in value[s]:
                        f, o, u, e, b = f | first[v], o | one[v], u | sure[v], e or empty[v], b or bare[v]
                    new = f, o, e, u, b
                elif k == DONE:
                    new = 0, 0, True, 0, True
                else:
                    new = first[a], one[a], empty[a], 0, False
                if new != (first[s], one[s], empty[s], sure[s], bare[s]):
                    first[s], one[s], empty[s], sure[s], bare[s] = new
                    changed = True
        follow = [0] * len(self.names)
        for s in self.starts:
            follow[self.number[s]] |= self.end
        changed = True
        while changed:
            changed = False
            for s in range(n):
                if kind[s] == RULE:
                    r, a = self.rule[value[s]], after[s]
                    f = follow[r] | first[a] | (follow[self.rule[s]] if empty[a] else 0)
                    if f != follow[r]:
                        follow[r] = f
                        changed = True
        second: list[dict[int, int]] = [{} for _ in range(n)]

        def bits(mask: int):
            while mask:
                b = mask & -mask
                yield b
                mask ^= b

        changed = True
        while changed:
            changed = False
            for s in order:
                k, a, own = kind[s], after[s], second[s]
                if k == TERMINAL:
                    adds = [(value[s], first[a])]
                elif k == RULE:
                    r = value[s]
                    adds = [*second[r].items(), *((b, first[a]) for b in bits(one[r]))] + ([*second[a].items()] if empty[r] else [])
                elif k == BRANCH:
                    adds = [x for v in value[s] for x in second[v].items()]
                elif k == DONE:
                    continue
                else:
                    adds = second[a].items()
                for b, m in adds:
                    old = own.get(b, 0)
                    if m | old != old:
                        own[b] = m | old
                        changed = True
        self.first, self.one, self.empty, self.sure, self.second, self.follow = first, one, empty, sure, second, follow
        self.until = [follow[r] for r in self.rule]
        self.classes: dict[frozenset[str], int] = {}
        self.masks: list[int] = []
        self.table: list[dict[int, tuple[int, ...]]] = [{} for _ in range(n)]
        self.is_entry = frozenset(self.entry)

    def _class(self, kinds: frozenset[str]) -> int:
        k = self.classes.get(kinds)
        if k is None:
            k = self.classes[kinds] = len(self.masks)
            self.masks.append(sum(self.bits.get(x, 0) for x in kinds))
        return k

    def _predict(self, slot: int, pair: int) -> tuple[int, ...]:
        """The targets of a branch that the next two tokens allow, or SINGLE."""
        a, b = self.masks[pair >> 16], self.masks[pair & 0xFFFF]
        one, empty, second, follow = self.one, self.empty, self.second, self.until[slot]

        def goes_on(v: int, beyond: int) -> bool:
            return bool(a & one[v] and b & beyond) or any(a & t and b & m for t, m in second[v].items())

        if slot in self.is_entry and not empty[slot] and a & self.sure[slot] and not goes_on(slot, 0):
            ways = SINGLE
        else:
            ways = tuple(v for v in self.value[slot] if goes_on(v, follow) or empty[v] and a & follow)
        self.table[slot][pair] = ways
        return ways

    def recognise(self, tokens: list[Token], starts: list[str]) -> tuple[set[str], int]:
        """The start rules that match all tokens, and the place of the furthest token that some rule got to."""
        kind, value, after, table, until, predict = self.kind, self.value, self.after, self.table, self.until, self._predict
        n, size, far = len(tokens), len(kind), 0
        classes = [self._class(t.kinds) for t in tokens] + [self._class(frozenset(("EOF",)))] * 2
        masks = [self.masks[c] for c in classes]
        pairs = [a << 16 | b for a, b in zip(classes, classes[1:])]
        other = self.bits.get("else", 0)
        nodes: dict[int, int] = {}
        edges: list[set[int]] = []  # of a node: caller * size + slot
        pops: list[set[int] | None] = []
        seen: set[int] = set()  # states returned to: (node * size + slot) * (n + 1) + place
        split: set[int] = set()  # states that branched, in the same notation
        wide = n + 1
        todo: list[tuple[int, int, int]] = []
        roots = []
        for s in starts:
            entry, root = self.entry[self.number[s]], len(edges)
            nodes[entry] = root
            roots.append((s, root))
            ways = predict(entry, pairs[0])
            edges.append(set())
            pops.append({1} if ways is SINGLE else None)
            far = max(far, int(ways is SINGLE))
            todo += [(at, root, 0) for at in ways if ways is not SINGLE]
        while todo:
            slot, node, i = todo.pop()
            while True:
                k = kind[slot]
                if k == TERMINAL:
                    if not masks[i] & value[slot]:
                        break
                    i += 1
                    slot = after[slot]
                    if i > far:
                        far = i
                elif k == RULE:
                    entry = value[slot]
                    pair = pairs[i]
                    ways = table[entry].get(pair)
                    if ways is None:
                        ways = predict(entry, pair)
                    if not ways:
                        if far == i and masks[i] & self.first[entry]:
                            far = i + 1
                        break
                    slot = after[slot]
                    if ways is SINGLE:
                        i += 1
                        if i > far:
                            far = i
                        continue
                    code = node * size + slot
                    key = i * size + entry
                    child = nodes.get(key)
                    if child is None:
                        child = nodes[key] = len(edges)
                        edges.append({code})
                        pops.append(None)
                        for at in ways[1:]:
                            todo.append((at, child, i))
                        slot, node = ways[0], child
                        continue
                    own = edges[child]
                    if code not in own:
                        own.add(code)
                        for j in pops[child] or ():
                            mark = code * wide + j
                            if mark not in seen:
                                seen.add(mark)
                                todo.append((slot, node, j))
                    break
                elif k == BRANCH:
                    pair = pairs[i]
                    ways = table[slot].get(pair)
                    if ways is None:
                        ways = predict(slot, pair)
                    if not ways:
                        if far == i and masks[i] & self.first[slot]:
                            far = i + 1
                        break
                    if len(ways) > 1:
                        mark = (node * size + slot) * wide + i
                        if mark in split:
                            break
                        split.add(mark)
                        for at in ways[1:]:
                            todo.append((at, node, i))
                    slot = ways[0]
                elif k == DONE:
                    if not masks[i] & until[slot]:
                        break
                    done = pops[node]
                    if done is None:
                        pops[node] = {i}
                    elif i in done:
                        break
                    else:
                        done.add(i)
                    goes = False
                    for code in edges[node]:
                        mark = code * wide + i
                        if mark not in seen:
                            seen.add(mark)
                            if goes:
                                todo.append((code % size, code // size, i))
                            else:
                                goes, slot, to = True, code % size, code // size
                    if not goes:
                        break
                    node = to
                else:
                    what, t = value[slot], tokens[i] if i < n else None
                    if what == "end":
                        holds = t is None or t.broken or "}" in t.kinds
                    elif what == "same":
                        holds = t is not None and not t.broken
                    elif what == "glued":
                        holds = t is not None and t.glued
                    else:
                        holds = not masks[i] & other
                    if not holds:
                        break
                    slot = after[slot]
        return {s for s, root in roots if pops[root] and n in pops[root]}, far
