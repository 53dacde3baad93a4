"""A generalised LL recogniser over recursive transition networks.

Every nonterminal is a small automaton over terminals and nonterminals. A descriptor is an automaton state, a node of the graph-
structured stack and a position; a stack node is a nonterminal called at a position, which all callers share. All dialects of a language
run together: a descriptor carries the set of dialects that allow everything read so far, as bits.

Results of the nonterminals listed as ``memo`` are kept by the very tokens they were derived from, up to the furthest one looked at, so the
same stretch of code is parsed once a worker, wherever it stands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: A terminal that stands for ``;`` or for the places where a newline, a closing brace or the end of the file replaces it.
SEMI = "SEMI"
END = "END"
_TOKEN = re.compile(r"'[^']*'|@=?\w+|\w+(?:~\w+)?|[()|*+?:]")


@dataclass
class Network:
    """states: per state (terminals by kind, calls by kind, semi targets, final); start: per nonterminal its first state."""

    states: list[tuple[dict, dict, list, bool]]
    start: dict[str, int]
    dialects: tuple[str, ...]
    memo: frozenset[str]

    @property
    def all(self) -> int:
        return (1 << len(self.dialects)) - 1


def network(rules: str, dialects: tuple[str, ...], memo: tuple[str, ...], without: dict[str, frozenset[str]] | None = None) -> Network:
    """From rules ``name: a 'b' (c | D)* @dialect e?``: lower case calls a rule, upper case and quoted are token kinds.

    ``@x`` allows the alternative from dialect x on in the order of ``dialects``, ``@=x`` in x alone. ``a~w`` calls a
    rule unless the next token is among ``without[w]``. No rule may derive nothing.
    """
    without = without or {}
    parsed: dict[str, object] = {}
    for block in re.split(r"\n(?=\w+:)", rules.strip()):
        name, body = block.split(":", 1)
        words = _TOKEN.findall(re.sub(r"^\s*#.*$", "", body, flags=re.M))
        tree, rest = _alternatives(words, dialects)
        if rest:
            raise ValueError(f"{name}: {rest[:5]}")
        if name in parsed:
            raise ValueError(f"{name} is defined twice")
        parsed[name.strip()] = tree
    machines = {name: _automaton(tree, (1 << len(dialects)) - 1) for name, tree in parsed.items()}
    first: dict[str, set] = {name: set() for name in parsed}
    grown = True
    while grown:
        grown = False
        for name, (table, finals) in machines.items():
            if 0 in finals:
                raise ValueError(f"{name} may be empty")
            for symbol, _ in table[0]:
                symbol, _, barred = symbol.partition("~") if symbol[0] != "'" else (symbol, "", "")
                if symbol.islower() and symbol[0] != "'" and symbol not in parsed:
                    raise ValueError(f"{name}: {symbol} is not defined")
                new = first[symbol] - without.get(barred, frozenset()) if symbol in parsed else {symbol.strip("'")}
                if not new <= first[name]:
                    first[name] |= new
                    grown = True
    states, start, base = [], {}, 0
    for name, (table, _) in machines.items():
        start[name] = base
        base += len(table)
    for name, (table, finals) in machines.items():
        for number, row in enumerate(table):
            terminals, calls, semis = {}, {}, []
            for (symbol, mask), target in row.items():
                target += start[name]
                symbol, _, barred = symbol.partition("~") if symbol[0] != "'" else (symbol, "", "")
                if symbol == SEMI:
                    semis.append((target, mask))
                elif symbol in parsed:
                    for kind in first[symbol] - without.get(barred, frozenset()):
                        calls.setdefault(kind, []).append((symbol, target, mask))
                elif symbol[0] != "'" and symbol.islower():
                    raise ValueError(f"{name}: {symbol} is not defined")
                else:
                    terminals.setdefault(symbol.strip("'"), []).append((target, mask))
            states.append((terminals, calls, semis, number in finals))
    return Network(states, start, dialects, frozenset(memo))


def _alternatives(words, dialects):
    options = []
    while True:
        items, mask = [], None
        while words and words[0] not in ("|", ")"):
            word, words = words[0], words[1:]
            if word[0] == "@":
                name = word.lstrip("@=")
                at = dialects.index(name)
                mask = 1 << at if word[1] == "=" else sum(1 << k for k in range(at, len(dialects)))
                continue
            if word == "(":
                item, words = _alternatives(words, dialects)
                if not words or words[0] != ")":
                    raise ValueError("missing )")
                words = words[1:]
            else:
                item = word
            while words and words[0] in "*+?":
                item, words = (words[0], item), words[1:]
            items.append(item)
        options.append(("seq", items, mask))
        if not words or words[0] == ")":
            return ("alt", options), words
        words = words[1:]


def _automaton(tree, full):
    """A deterministic automaton over (symbol, dialects): rows of transitions, and the numbers of the final states."""
    edges: list[list[tuple[tuple[str, int] | None, int]]] = []

    def state() -> int:
        edges.append([])
        return len(edges) - 1

    def build(item, mask: int, a: int, b: int) -> None:
        if isinstance(item, str):
            edges[a].append(((item, mask), b))
        elif item[0] == "alt":
            for option in item[1]:
                build(option, mask, a, b)
        elif item[0] == "seq":
            own, at = mask if item[2] is None else mask & item[2], a
            for part in item[1]:
                then = state()
                build(part, own, at, then)
                at = then
            edges[at].append((None, b))
        else:
            one, two = state(), state()
            edges[a].append((None, one))
            build(item[1], mask, one, two)
            edges[two].append((None, b))
            if item[0] in "*+":
                edges[two].append((None, one))
            if item[0] in "*?":
                edges[one].append((None, b)) if item[0] == "?" else edges[a].append((None, b))

    first, last = state(), state()
    build(tree, full, first, last)

    def closure(some: frozenset) -> frozenset:
        pile, seen = list(some), set(some)
        while pile:
            for label, to in edges[pile.pop()]:
                if label is None and to not in seen:
                    seen.add(to)
                    pile.append(to)
        return frozenset(seen)

    numbers = {closure(frozenset([first])): 0}
    todo, table, finals = list(numbers), [{}], set()
    while todo:
        here = todo.pop()
        row: dict = {}
        for s in here:
            for label, to in edges[s]:
                if label is not None:
                    row.setdefault(label, set()).add(to)
        if last in here:
            finals.add(numbers[here])
        for label, to in row.items():
            there = closure(frozenset(to))
            if there not in numbers:
                numbers[there] = len(table)
                table.append({})
                todo.append(there)
            table[numbers[here]][label] = numbers[there]
    return table, finals


class Recogniser:
    """Recognises token sequences; one object a worker, so that what was derived once is kept."""

    #: Nested deeper than MEMO_DEPTH, memo rules are called like all others, by the graph-structured stack, which needs no recursion; the
    #: ends of all rules found there are kept in ``done`` while the text lasts, so that outer levels don't look for them again.
    MEMO_SPAN, MEMO_SIZE, MEMO_DEPTH = 64, 400_000, 100

    def __init__(self, net: Network):
        self.net = net
        self.kept: dict[str, dict] = {name: {} for name in net.memo}
        self.size = self.depth = 0

    def accepts(self, kinds: list[str], newline: list[bool] | None = None, rule: str = "file") -> int:
        """The dialects, as bits, in which the whole sequence, which must end in END, derives from the rule; 0 if none."""
        return self.reach(kinds, newline, rule).get(len(kinds), 0)

    def reach(self, kinds: list[str], newline: list[bool] | None, rule: str) -> dict[int, int]:
        self.kinds = kinds
        self.newline = newline or [False] * len(kinds)
        self.keys = [k + "\n" if n else k for k, n in zip(kinds, self.newline)] if newline else kinds
        self.far, self.local, self.done, self.depth = 0, {}, {}, 0
        return self._derive(rule, 0)

    def _known(self, rule: str, at: int) -> dict[int, int]:
        """The ends of the rule at a position, from what was derived before or derived now."""
        if (rule, at) in self.local:
            ends, far = self.local[rule, at]
            self.far = max(self.far, far)
            return ends
        node, i, keys = self.kept[rule], at, self.keys
        n = len(keys)
        while node is not None and "" not in node and i < n:
            node = node.get(keys[i])
            i += 1
        if node is not None and "" in node:
            ends, far = {at + d: m for d, m in node[""]}, i - 1
        else:
            before, self.far = self.far, at
            self.depth += 1
            ends = self._derive(rule, at)
            self.depth -= 1
            far, self.far = self.far, max(before, self.far)
            if far - at < self.MEMO_SPAN and far < n:
                if self.size > self.MEMO_SIZE:
                    self.kept, self.size = {name: {} for name in self.net.memo}, 0
                node = self.kept[rule]
                for k in keys[at : far + 1]:
                    node = node.setdefault(k, {})
                    self.size += 1
                node[""] = [(e - at, m) for e, m in ends.items()]
        self.far = max(self.far, far)
        self.local[rule, at] = ends, far
        return ends

    def _derive(self, rule: str, at: int) -> dict[int, int]:
        """All ends of a rule called at a position, with their dialects: the worklist over descriptors."""
        states, start, memo, kinds, n, full = self.net.states, self.net.start, self.net.memo, self.kinds, len(self.kinds), self.net.all
        root: tuple[dict, list, int] = ({}, [], 0)  # ends so far, callers (state, node, dialects), number
        nodes, seen, far, done, flat = {}, {}, self.far, self.done, self.depth >= self.MEMO_DEPTH
        todo = [(start[rule], root, at, full)]

        def add(state, node, position, dialects) -> None:
            key = state, node[2], position
            old = seen.get(key, 0)
            if dialects & ~old:
                seen[key] = old | dialects
                todo.append((state, node, position, dialects & ~old))

        while todo:
            state, node, i, dialects = todo.pop()
            while True:
                terminals, calls, semis, final = states[state]
                if final:
                    old = node[0].get(i, 0)
                    if dialects & ~old:
                        node[0][i] = old | dialects
                        for back, caller, allowed in node[1]:
                            if dialects & allowed:
                                add(back, caller, i, dialects & allowed)
                if i >= n:
                    break
                if i > far:
                    far = i
                kind = kinds[i]
                if semis and (kind == ";" or kind == "}" or kind == END or self.newline[i]):
                    for target, allowed in semis:
                        if dialects & allowed:
                            add(target, node, i + 1 if kind == ";" else i, dialects & allowed)
                for called, back, allowed in calls.get(kind, ()):
                    allowed &= dialects
                    if not allowed:
                        continue
                    if called in memo and ((called, i) in self.local or not flat and (called, i) not in done):
                        self.far = far
                        for end, other in self._known(called, i).items():
                            if other & allowed:
                                add(back, node, end, other & allowed)
                        far = self.far
                        continue
                    callee = nodes.get((called, i))
                    if callee is None and (called, i) in done:
                        ends, reached = done[called, i]
                        callee, far = ({**ends}, [], len(nodes) + 1), max(far, reached)
                        nodes[called, i] = callee
                    if callee is None:
                        callee = nodes[called, i] = ({}, [(back, node, allowed)], len(nodes) + 1)
                        todo.append((start[called], callee, i, full))
                    else:
                        callee[1].append((back, node, allowed))
                        for end, other in list(callee[0].items()):
                            if other & allowed:
                                add(back, node, end, other & allowed)
                moves = terminals.get(kind)
                if not moves:
                    break
                if len(moves) > 1:
                    for target, allowed in moves:
                        if dialects & allowed:
                            add(target, node, i + 1, dialects & allowed)
                    break
                state, dialects, i = moves[0][0], dialects & moves[0][1], i + 1
                if not dialects:
                    break
        if flat:
            for key, node in nodes.items():
                done.setdefault(key, (node[0], far))
        self.far = far
        return root[0]
