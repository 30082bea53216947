"""Large rule sets: a numbered dictionary of literals, found in one pass over each text.

Written into the plan, every literal of every rule costs a search of its own per event, and the
plan grows with the rules. Here the literals of all rules make one automaton per text column. A
batch of events is searched once, what was found becomes one bit column per literal, and the
conditions of the rules are tests on those bits for the whole batch: rules without a literal in it
cost next to nothing. Regular expressions stay in the plan and come in as bits.
"""

from functools import lru_cache
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa

# -- words that every match of a pattern must hold --------------------------------------------


def required_words(pattern: str) -> list[str]:
    """Lower-case words without which no text of ASCII characters matches ``pattern`` in any case."""
    words: list[str] = []
    run: list[str] = []

    def end():
        if run:
            words.append("".join(run).lower())
            run.clear()

    def walk(parsed):
        for kind, value in parsed:
            if kind is sre.LITERAL and value < 128:
                run.append(chr(value))
            elif kind is sre.SUBPATTERN:
                walk(value[3])
            elif kind is sre.ATOMIC_GROUP:
                walk(value)
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
                end()
                walk(value[2])
                end()
            elif kind not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # those take no characters
                end()

    walk(_parser.parse(pattern))
    end()
    return list(dict.fromkeys(words))


def required_word(pattern: str) -> str:
    """The longest word that a match must hold, or an empty one."""
    return max(required_words(pattern), key=len, default="")


# -- the dictionary --------------------------------------------------------------------------

def _both(a, b):
    if a is False or b is False:
        return False
    return b if a is True else a if b is True else a & b


def _either(a, b):
    if a is True or b is True:
        return True
    return b if a is False else a if b is False else a | b


def _none(a):
    return not a if isinstance(a, bool) else ~a


class RuleDictionary:
    """Rules as tests on the bits of their literals.

    ``groups`` has the detection groups and ``conditions`` the condition of each rule; ``texts``
    names the text columns (the keyword text first, then the fields in lower case), ``patterns`` the
    (field, pattern) pairs whose results come in as bits.
    """

    def __init__(self, groups: tuple, conditions: tuple, texts: tuple, patterns: tuple):
        from vigilog.operators.rules import condition_tree

        self.column = {t: k for k, t in enumerate(texts)}
        self.pattern = {p: k for k, p in enumerate(patterns)}
        self.literals: dict[tuple, int] = {}  # (column, operation, literal) -> number
        self.rules = []
        for own, condition in zip(groups, conditions, strict=True):
            named = {name: [self._matcher(*m) for m in matchers] for name, matchers in own.items()}
            self.rules.append((named, *condition_tree(condition, list(named))))
        self.automata = [self._automaton(k) for k in range(len(texts))]

    def _matcher(self, kind, field, modifier, values) -> tuple[list[int], list[int]]:
        """(numbers of literals, numbers of patterns), any of which is enough."""
        if kind == "field" and modifier == "re":
            return [], [self.pattern[field, v] for v in values if (field, v) in self.pattern]
        column = self.column[None if kind == "keyword" else field]
        operation = modifier if kind == "field" and modifier in ("startswith", "endswith", "exact") else "contains"
        words = dict.fromkeys((column, operation, v.lower()) for v in values)
        return [self.literals.setdefault(w, len(self.literals)) for w in words], []

    def _automaton(self, column: int):
        import ahocorasick

        by_word: dict[str, list] = {}
        for (own, operation, word), number in self.literals.items():
            if own == column:
                by_word.setdefault(word, []).append((operation, number))
        blank = by_word.pop("", [])
        automaton = ahocorasick.Automaton()
        for word, uses in by_word.items():
            automaton.add_word(word, (len(word), uses))
        if by_word:
            automaton.make_automaton()
        return automaton if by_word else None, blank

    def found(self, columns: list[pa.Array]) -> dict[int, np.ndarray]:
        """Bits of the literals that stand in any of the texts."""
        rows: dict[int, list[int]] = {}
        for (automaton, blank), texts in zip(self.automata, columns, strict=True):
            if automaton is None and not blank:
                continue
            for row, text in enumerate(texts.to_pylist()):
                if text is None:
                    continue
                for operation, number in blank:
                    if operation != "exact" or not text:
                        rows.setdefault(number, []).append(row)
                if automaton is None:
                    continue
                last = len(text) - 1
                for end, (size, uses) in automaton.iter(text):
                    for operation, number in uses:
                        if (operation == "contains" or operation == "startswith" and end == size - 1
                                or operation == "endswith" and end == last or operation == "exact" and end == last == size - 1):
                            rows.setdefault(number, []).append(row)
        out = {}
        for number, own in rows.items():
            out[number] = bits = np.zeros(len(columns[0]), bool)
            bits[own] = True
        return out

    def fired(self, columns: list[pa.Array], patterns: np.ndarray) -> list[list[dict]]:
        """The rules that fire at each row, in order, with the groups that made them."""
        bits = self.found(columns)
        size = len(columns[0])
        out: list[list[dict]] = [[] for _ in range(size)]

        def any_of(matcher):
            truth = False
            for number in matcher[0]:
                if number in bits:
                    truth = _either(truth, bits[number])
            for number in matcher[1]:
                truth = _either(truth, patterns[:, number])
            return truth

        for number, (groups, tree, names) in enumerate(self.rules):
            truth: dict = {}

            def group(name, truth=truth, groups=groups):
                if name not in truth:
                    own = name in groups
                    for matcher in groups.get(name, ()):
                        own = _both(own, any_of(matcher))
                    truth[name] = own
                return truth[name]

            def leaf(mark, names=names, group=group):
                kind, chosen = names[mark]
                if not chosen:
                    return False
                value = kind == "all"
                for name in chosen:
                    value = _both(value, group(name)) if kind == "all" else _either(value, group(name))
                return value

            holds = _value(tree, leaf)
            if holds is False:
                continue
            seen: dict = {}
            for mark, reach in _looked_at(tree, leaf, True):
                for name in names[mark][1]:
                    if name in groups:
                        seen[name] = _either(seen.get(name, False), _both(_both(reach, leaf(mark)), group(name)))
            rows = range(size) if holds is True else np.flatnonzero(holds).tolist()
            for row in rows:
                out[row].append({"rule": number, "groups": [
                    g for g, s in sorted(seen.items()) if s is not False and (s is True or s[row])]})
        return out


def _value(node, leaf):
    import ast

    if isinstance(node, ast.Name):
        return leaf(node.id)
    if isinstance(node, ast.UnaryOp):
        return _none(_value(node.operand, leaf))
    every = isinstance(node.op, ast.And)
    value = every
    for part in node.values:
        if value is not every and isinstance(value, bool):
            break
        value = (_both if every else _either)(value, _value(part, leaf))
    return value


def _looked_at(node, leaf, reach):
    """(leaf, rows in which it is looked at): an AND stops at its first false side."""
    import ast

    if isinstance(node, ast.Name):
        return [(node.id, reach)]
    if isinstance(node, ast.UnaryOp):
        return _looked_at(node.operand, leaf, reach)
    found = []
    for part in node.values:
        found += _looked_at(part, leaf, reach)
        if isinstance(node.op, ast.And):
            reach = _both(reach, _value(part, leaf))
    return found


@lru_cache(maxsize=4)
def dictionary(*spec) -> RuleDictionary:
    """One per Python worker and rule set."""
    return RuleDictionary(*spec)
