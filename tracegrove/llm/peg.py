"""Packrat parsing-expression grammars, compiled to Python functions over token lists.

A grammar is text: ``name <- expression`` per rule, with ``/`` ordered choice, ``* + ?`` repetition,
``& !`` predicates, quoted terminals (a token's own text) and UPPER-CASE terminals (a token class).
``%nl`` succeeds, consuming nothing, when a line break stands before the token. Every rule is memoised
by position (packrat) unless its name is declared with a leading ``-`` (a transient rule).

A rule returns the position behind what it matched, or -1. ``parse`` demands that the start rule
consume the whole input; otherwise it reports the furthest position at which a terminal failed.
"""

from __future__ import annotations

import re
import sys

MOST_FRAMES = 2_500_000  # rules that may be open at once, some hundred megabytes

_TOKEN = re.compile(r"\s*(?:(#[^\n]*)|(-?[a-z_]\w*)\s*<-|('[^']+')|(%nl)|([A-Z_]+)|([a-z_]\w*)|([()*+?&!/]))")


def _read(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at:at + 40]!r}")
        at = m.end()
        for kind, value in zip(("", "def", "lit", "nl", "lit", "ref", "op"), m.groups()):
            if value is not None and kind:
                out.append((kind, value.strip("'") if kind == "lit" else value))
    return out


def _rules(text: str) -> dict[str, tuple]:
    tokens, rules, at = _read(text), {}, 0

    def choice():
        alts = [sequence()]
        while peek() == ("op", "/"):
            take()
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else ("choice", alts)

    def sequence():
        items = []
        while peek()[0] in ("lit", "ref", "nl") or peek() in (("op", "("), ("op", "&"), ("op", "!")):
            items.append(suffixed())
        return items[0] if len(items) == 1 else ("seq", items)

    def suffixed():
        kind, value = take()
        if (kind, value) in (("op", "&"), ("op", "!")):
            return ("and" if value == "&" else "not", suffixed())
        if (kind, value) == ("op", "("):
            e = choice()
            if take() != ("op", ")"):
                raise ValueError("grammar: ) expected")
        else:
            e = (kind, value)
        while peek() in (("op", "*"), ("op", "+"), ("op", "?")):
            e = ({"*": "star", "+": "plus", "?": "opt"}[take()[1]], e)
        return e

    def peek():
        return tokens[at] if at < len(tokens) else ("end", "")

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    while at < len(tokens):
        kind, name = take()
        if kind != "def":
            raise ValueError(f"grammar: rule expected at {name!r}")
        rules[name] = choice()
    return rules


class Grammar:
    """A compiled grammar. The first rule is the start rule."""

    def __init__(self, text: str):
        declared = _rules(text)
        self.transient = {n[1:] for n in declared if n.startswith("-")}
        self.rules = {n.lstrip("-"): e for n, e in declared.items()}
        self.start = next(iter(self.rules))
        self._nullable: dict[str, bool] = dict.fromkeys(self.rules, False)
        self._first: dict[str, frozenset] = dict.fromkeys(self.rules, frozenset())
        changed = True
        while changed:
            changed = False
            for n, e in self.rules.items():
                new = self._can_be_empty(e), self._starts(e)
                if new != (self._nullable[n], self._first[n]):
                    self._nullable[n], self._first[n] = new
                    changed = True
        self._fast = self._compile(False)
        self._slow = self._compile(True)

    def _can_be_empty(self, e) -> bool:
        kind = e[0]
        if kind in ("star", "opt", "and", "not", "nl"):
            return True
        if kind == "plus":
            return self._can_be_empty(e[1])
        if kind == "ref":
            return self._nullable[e[1]]
        if kind in ("seq", "choice"):
            return (all if kind == "seq" else any)(self._can_be_empty(x) for x in e[1])
        return False

    def _starts(self, e) -> frozenset:
        """Tokens with which a non-empty match can begin (predicates only narrow this)."""
        kind = e[0]
        if kind == "lit":
            return frozenset([e[1]])
        if kind == "ref":
            return self._first[e[1]]
        if kind in ("star", "plus", "opt"):
            return self._starts(e[1])
        if kind == "choice":
            return frozenset().union(*(self._starts(x) for x in e[1]))
        if kind == "seq":
            out = frozenset()
            for x in e[1]:
                out |= self._starts(x)
                if not self._can_be_empty(x):
                    break
            return out
        return frozenset()

    def _compile(self, tracked: bool):
        consts: dict[frozenset, str] = {}
        names = iter(range(10**6))

        def const(tokens: frozenset) -> str:
            return consts.setdefault(tokens, f"F{len(consts)}")

        def emit(e, ind: str, top: bool = False) -> list[str]:
            kind = e[0]
            fail = [f"{ind}    if p > far: far = p", f"{ind}    p = -1"] if tracked else [f"{ind}    p = -1"]
            if kind == "lit":
                return [f"{ind}if K[p] == {e[1]!r}: p += 1", f"{ind}else:", *fail]
            if kind == "nl":
                return [f"{ind}if not B[p]: p = -1"]
            if kind == "ref":
                return [f"{ind}p = r_{e[1]}(p)"]
            if kind == "seq":
                out, depth = [], ind
                for i, x in enumerate(e[1]):
                    if i:
                        out.append(f"{depth}if p >= 0:")
                        depth += " "
                    out += emit(x, depth, top)
                return out or [f"{ind}pass"]
            s = f"s{next(names)}"
            if kind == "choice":
                if all(x[0] == "lit" for x in e[1]):
                    return [f"{ind}if K[p] in {const(frozenset(x[1] for x in e[1]))}: p += 1", f"{ind}else:", *fail]
                out, depth = [f"{ind}{s} = p", f"{ind}p = -1"], ind
                for i, x in enumerate(e[1]):
                    test = "" if self._can_be_empty(x) else f"K[{s}] in {const(self._starts(x))}"
                    if i:
                        out.append(f"{ind}if p < 0{' and ' + test if test else ''}:")
                    else:
                        out.append(f"{ind}if {test or 'True'}:")
                    out += [f"{ind} p = {s}", *emit(x, ind + " ")]
                if tracked:
                    out += [f"{ind}if p < 0 and {s} > far: far = {s}"]
                return out
            test = "" if self._can_be_empty(e[1]) else f"K[p] in {const(self._starts(e[1]))}"
            if kind == "star":
                # Between two items of the start rule nothing behind is read again: the memo is emptied there.
                drop = [f"{ind} if p > kept + 20000:", f"{ind}  kept = p", *(f"{ind}  m_{n}.clear()" for n in self.rules if n not in self.transient)] if top else []
                return [f"{ind}while {test or 'True'}:", f"{ind} {s} = p", *emit(e[1], ind + " "), f"{ind} if p < 0 or p == {s}:", f"{ind}  p = {s}", f"{ind}  break", *drop, *([f"{ind}if p > far: far = p"] if tracked else [])]
            if kind == "plus":
                return emit(("seq", [e[1], ("star", e[1])]), ind)
            if kind == "opt":
                return [f"{ind}if {test or 'True'}:", f"{ind} {s} = p", *emit(e[1], ind + " "), f"{ind} if p < 0: p = {s}", *([f"{ind}elif p > far: far = p"] if tracked and test else [])]
            hold = [f"{ind}h{s} = far"] if tracked else []
            back = [f"{ind}far = h{s}"] if tracked else []
            result = f"{s} if p >= 0 else -1" if kind == "and" else f"{s} if p < 0 else -1"
            return [*hold, f"{ind}{s} = p", *emit(e[1], ind), f"{ind}p = {result}", *back]

        body = ["def parse(K, B):", " far = 0"]
        body += [f" m_{n} = {{}}" for n in self.rules if n not in self.transient]
        for n, e in self.rules.items():
            body.append(f" def r_{n}(p):")
            if tracked:
                body.append("  nonlocal far")
            if n == self.start:
                body += ["  kept = 0", *emit(e, "  ", True), "  return p"]
            elif n in self.transient:
                body += [*emit(e, "  "), "  return p"]
            else:
                body += [f"  q = m_{n}.get(p)", "  if q is not None: return q", "  q = p", *emit(e, "  "), f"  m_{n}[q] = p", "  return p"]
        body += [f" end = r_{self.start}(0)", " return end, far"]
        space: dict = {}
        source = "\n".join(body)
        scope = {name: tokens for tokens, name in consts.items()}
        exec(compile(source, "<grammar>", "exec"), scope, space)  # noqa: S102 - our own generated text
        return space["parse"]

    def parse(self, kinds: list[str], breaks) -> int:
        """-1 if the start rule consumes ``kinds`` (which end with EOF), else the furthest failing token."""
        # Rules call each other on the heap (Python calls Python without the C stack): the limit bounds memory only.
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, MOST_FRAMES))
        try:
            end, _ = self._fast(kinds, breaks)
            if end == len(kinds):
                return -1
            return max(0, min(self._slow(kinds, breaks)[1], len(kinds) - 1))
        except RecursionError:
            raise TooDeep from None
        finally:
            sys.setrecursionlimit(limit)


class TooDeep(Exception):
    """The text nests deeper than the parser follows."""
