"""A generalised LL parser with a graph-structured stack.

Grammars are written as text, one rule a line::

    Stmt = "if" Paren Stmt ("else" Stmt)? | Block | Expr? ";"

Quoted or bare lower-case names are terminals, capitalised names are rules;
``( )``, ``?``, ``*`` and ``+`` work as usual. Descriptors (slot, stack node,
position) are processed once each; a stack node is a (rule, position) pair that
all callers share, and remembers where it has returned, so that ambiguous and
left-recursive grammars take at most cubic time. The parser recognises: it
answers at which positions a rule can end.

A token is a set of names, any of which a terminal may ask for. The terminal
``^`` takes no token: it holds at the end and before a token marked ``^``,
which is how line ends count without being tokens.
"""

from __future__ import annotations

import re

_END = frozenset("^")
_TOKEN = re.compile(r'\s*("[^"]*"|[A-Za-z_][\w]*|[()|?*+=])')


class Grammar:
    """Rules as small automata: each state has edges (kind, label, next), kind 't' terminal or 'n' rule; a state may accept."""

    def __init__(self, text: str):
        self.start: dict[str, int] = {}
        self.edges: list[list[tuple[bool, str, int]]] = []
        self.accept: list[bool] = []
        for line in text.strip().split("\n"):
            line = line.split("//")[0].strip()
            if not line:
                continue
            name, body = line.split("=", 1)
            self._tokens = [t.strip() for t in _TOKEN.findall(body)]
            self._at = 0
            begin, end = self._state(), self._state()
            self._alternatives(begin, end)
            if self._at != len(self._tokens):
                raise ValueError(f"rule {name.strip()}: unexpected {self._tokens[self._at]}")
            self.accept[end] = True
            self.start[name.strip()] = begin
        self._remove_empty_edges()
        for edges in self.edges:
            for terminal, label, _ in edges:
                if not terminal and label not in self.start:
                    raise ValueError(f"no rule {label}")
        self._first_sets()

    def _state(self) -> int:
        self.edges.append([])
        self.accept.append(False)
        return len(self.edges) - 1

    def _peek(self) -> str:
        return self._tokens[self._at] if self._at < len(self._tokens) else ""

    def _alternatives(self, begin: int, end: int) -> None:
        while True:
            at = begin
            while self._peek() not in ("", "|", ")"):
                at = self._item(at)
            self.edges[at].append((True, "", end))
            if self._peek() != "|":
                return
            self._at += 1

    def _item(self, at: int) -> int:
        t = self._peek()
        self._at += 1
        a, b = self._state(), self._state()
        self.edges[at].append((True, "", a))
        if t == "(":
            self._alternatives(a, b)
            self._at += 1
        elif t[0] == '"':
            self.edges[a].append((True, t[1:-1], b))
        elif t[0].isupper():
            self.edges[a].append((False, t, b))
        else:
            self.edges[a].append((True, t, b))
        while self._peek() in ("?", "*", "+"):
            op = self._peek()
            self._at += 1
            if op in "*+":
                self.edges[b].append((True, "", a))
            if op in "*?":
                self.edges[a].append((True, "", b))
        end = self._state()
        self.edges[b].append((True, "", end))
        return end

    def _remove_empty_edges(self) -> None:
        closed, accept = [], []
        for s in range(len(self.edges)):
            seen, todo = {s}, [s]
            while todo:
                for terminal, label, n in self.edges[todo.pop()]:
                    if terminal and not label and n not in seen:
                        seen.add(n)
                        todo.append(n)
            out = {e for x in seen for e in self.edges[x] if not (e[0] and not e[1])}
            closed.append(sorted(out))
            accept.append(any(self.accept[x] for x in seen))
        self.edges, self.accept = closed, accept

    def _first_sets(self) -> None:
        """What a rule can begin with, and whether it can be empty: spares descriptors that must fail."""
        n = len(self.edges)
        first: list[set[str]] = [set() for _ in range(n)]
        empty = list(self.accept)
        changed = True
        while changed:
            changed = False
            for s in range(n):
                size = (len(first[s]), empty[s])
                for terminal, label, nxt in self.edges[s]:
                    if terminal:
                        first[s].add(label)
                    else:
                        b = self.start[label]
                        first[s] |= first[b]
                        if empty[b]:
                            first[s] |= first[nxt]
                            empty[s] = empty[s] or empty[nxt]
                changed |= size != (len(first[s]), empty[s])
        self.first, self.empty = [frozenset(x) for x in first], empty

    def ends(self, rules: list[str], tokens: list[frozenset[str]]) -> dict[str, set[int]]:
        """For each start rule (dialect), all run together over one stack: the positions at which it can end."""
        edges, accept, start, first, empty = self.edges, self.accept, self.start, self.first, self.empty
        size = len(tokens)
        callers: dict[tuple[int, int], set[tuple[int, tuple[int, int]]]] = {}
        returned: dict[tuple[int, int], set[int]] = {}
        seen: set[tuple[int, tuple[int, int], int]] = set()
        todo: list[tuple[int, tuple[int, int], int]] = []

        def add(state: int, node: tuple[int, int], at: int) -> None:
            if (d := (state, node, at)) not in seen:
                seen.add(d)
                todo.append(d)

        for r in rules:
            node = (start[r], 0)
            if node not in callers:
                callers[node], returned[node] = set(), set()
                add(start[r], node, 0)
        while todo:
            state, node, at = todo.pop()
            if accept[state] and at not in returned[node]:
                returned[node].add(at)
                for back, up in callers[node]:
                    add(back, up, at)
            t = tokens[at] if at < size else _END
            for terminal, label, nxt in edges[state]:
                if terminal:
                    if label in t:
                        add(nxt, node, at if label == "^" else at + 1)
                else:
                    begin = start[label]
                    if not empty[begin] and first[begin].isdisjoint(t):
                        continue
                    below = (begin, at)
                    if below not in callers:
                        callers[below], returned[below] = set(), set()
                        add(begin, below, at)
                    if (call := (nxt, node)) not in callers[below]:
                        callers[below].add(call)
                        for end in list(returned[below]):
                            add(nxt, node, end)
        return {r: returned[(start[r], 0)] for r in rules}

    def accepts(self, rules: list[str], tokens: list[frozenset[str]]) -> frozenset[str]:
        """The start rules that derive all of ``tokens``."""
        return frozenset(r for r, e in self.ends(rules, tokens).items() if len(tokens) in e)
