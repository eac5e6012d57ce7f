"""Literals that a pattern cannot match without, so that rules are skipped for texts that hold none of them.

:func:`required_literals` walks the parsed pattern and returns a set of lower-cased strings, one of which is in every
match; an empty set means that none could be derived (then the rule always runs). The prefilter never changes results.
"""

from __future__ import annotations

from functools import cache
from re import _constants as sre  # the parser that re itself uses
from re import _parser

try:
    import ahocorasick
except ImportError:  # an optional library
    ahocorasick = None

MIN_SEED, MAX_ALTERNATIVES = 3, 32


def _best(*options: frozenset[str]) -> frozenset[str]:
    """The strongest: longest shortest literal, then fewest alternatives."""
    kept = [o for o in options if o]
    return max(kept, key=lambda o: (min(map(len, o)), -len(o)), default=frozenset())


def _exact(item) -> frozenset[str] | None:
    """All strings that an element can stand for, if they are few."""
    op, arg = item
    if op is sre.LITERAL:
        c = chr(arg)
        # letters whose case folding leaves ASCII (k, s) are not relied on alone: see _lower
        return frozenset({c.lower()})
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
        return frozenset(chr(c).lower() for _, c in arg)
    if op is sre.SUBPATTERN:
        return _exact_sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_exact_sequence(b) for b in arg[1]]
        return None if any(x is None for x in parts) else frozenset().union(*parts)
    return None


def _exact_sequence(sequence) -> frozenset[str] | None:
    out = frozenset({""})
    for item in sequence:
        more = _exact(item)
        if more is None or len(out) * len(more) > MAX_ALTERNATIVES:
            return None
        out = frozenset(a + b for a in out for b in more)
    return out


def _required(sequence) -> frozenset[str]:
    found, run = [], frozenset({""})
    for item in [*sequence, None]:
        more = _exact(item) if item is not None else None
        if more is not None and len(run) * len(more) <= MAX_ALTERNATIVES:
            run = frozenset(a + b for a in run for b in more)
            continue
        found.append(run if all(len(x) >= MIN_SEED for x in run) else frozenset())
        run = frozenset({""}) if more is None else more
        if item is None:
            break
        op, arg = item
        if op is sre.SUBPATTERN:
            found.append(_required(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            found.append(_required(arg[2]))
        elif op is sre.ATOMIC_GROUP:
            found.append(_required(arg))
        elif op is sre.BRANCH:
            parts = [_best(_required(b), _whole(b)) for b in arg[1]]
            union = frozenset().union(*parts)
            found.append(union if all(parts) and len(union) <= MAX_ALTERNATIVES else frozenset())
    if more is None and run != frozenset({""}) and all(len(x) >= MIN_SEED for x in run):
        found.append(run)
    return _best(*found)


def _whole(sequence) -> frozenset[str]:
    exact = _exact_sequence(sequence)
    return exact if exact and all(len(x) >= MIN_SEED for x in exact) else frozenset()


@cache
def required_literals(pattern: str) -> frozenset[str]:
    return _required(_parser.parse(pattern))


def folded(text: str) -> str:
    """Lower case, with the two letters that fold into ASCII replaced."""
    return text.lower().replace("ſ", "s").replace("K", "k")


def may_match(pattern: str, folded_text: str) -> bool:
    seeds = required_literals(pattern)
    return not seeds or any(s in folded_text for s in seeds)


class RuleFilter:
    """Which of many patterns may match a text, in one pass over it if ``ahocorasick`` is there, else seed by seed."""

    def __init__(self, patterns: list[str]) -> None:
        self.always: set[int] = set()
        self.of_seed: dict[str, list[int]] = {}
        for i, pattern in enumerate(patterns):
            seeds = required_literals(pattern)
            if not seeds:
                self.always.add(i)
            for seed in seeds:
                self.of_seed.setdefault(seed, []).append(i)
        self.automaton = None
        if ahocorasick is not None and self.of_seed:
            self.automaton = ahocorasick.Automaton()
            for seed, rules in self.of_seed.items():
                self.automaton.add_word(seed, rules)
            self.automaton.make_automaton()

    def candidates(self, folded_text: str) -> list[int]:
        """Numbers of the patterns, ascending."""
        found = set(self.always)
        if self.automaton is not None:
            for _, rules in self.automaton.iter(folded_text):
                found.update(rules)
        else:
            for seed, rules in self.of_seed.items():
                if seed in folded_text:
                    found.update(rules)
        return sorted(found)


#: No name pattern matches without one of these (in the folded text).
NAME_SEEDS = ("secret", "private", "sensitive", "confidential", "cypher", "cipher", "crypt", "signature", "nonce", "credential", "cert", "key", "token", "salt", "auth", "pass", "pwd", "pswd")


def may_name_secret(folded_text: str) -> bool:
    return any(s in folded_text for s in NAME_SEEDS)
