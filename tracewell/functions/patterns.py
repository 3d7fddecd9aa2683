"""Turn the portable patterns of ``constants`` into Java regular expressions."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as web text uses it (Java's plain ``\s`` misses the no-break space).
SPACE_SET = (
    r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
SPACE = f"[{SPACE_SET}]"
#: The same for Java only: letters are told from spaces by the first two ranges, without a look at the whole set.
JAVA_SPACE = rf"[\x00-\x20\x{{a0}}-\x{{10ffff}}&&{SPACE}]"
#: Runs of them that are not just one space: where they become one, a plain text has nothing to replace.
JAVA_SPACES = rf"(?:[\x00-\x1f\x{{a0}}-\x{{10ffff}}&&{SPACE}]{JAVA_SPACE}*| {JAVA_SPACE}+)"
NOT_SPACE = f"[^{SPACE_SET}]"
CONTROL = r"[\x00-\x1f\x7f]"
#: Control characters other than tab and the line ends.
SOFT_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# In Java 17 a boundary looks at Unicode letters; the patterns mean ASCII word characters.
_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


@lru_cache(maxsize=None)
def java(pattern: str, ignore_case: bool = False) -> str:
    """The Java form of a portable pattern."""
    out = pattern.replace(r"\b", _BOUNDARY).replace(r"\S", NOT_SPACE).replace(r"\s", SPACE)
    return "(?i)" + out if ignore_case else out


@lru_cache(maxsize=None)
def ascii_java(pattern: str, ignore_case: bool = False) -> str:
    r"""The Java form for texts of ASCII characters only, where Java's own ``\b`` and a short set of spaces mean the same."""
    out = pattern.replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]")
    return "(?i)" + out if ignore_case else out


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def by_alphabet(text: Column, pattern: str, ignore_case: bool, use) -> Column:
    """``use`` with the pattern's Java form; plain ASCII texts, most of all, take one that is several times faster."""
    general, fast = java(pattern, ignore_case), ascii_java(pattern, ignore_case)
    return use(general) if general == fast else F.when(is_ascii(text), use(fast)).otherwise(use(general))


def _required(items) -> frozenset[str] | None:
    """Strings of which every match of a parsed pattern holds one; of several such sets the most telling, null if there is none."""
    best, run, sets = None, "", []
    for op, value in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        sets.append(frozenset([run]) if run else None)
        run = ""
        if name == "SUBPATTERN":
            sets.append(_required(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            sets.append(_required(value[2]))
        elif name == "BRANCH":
            each = [_required(branch) for branch in value[1]]
            sets.append(None if None in each else frozenset().union(*each))
    for found_ in filter(None, sets):
        if best is None or (min(map(len, found_)), -len(found_)) > (min(map(len, best)), -len(best)):
            best = found_
    return best


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which every match of a portable pattern holds one; none where they would hardly rule a text out."""
    portable = re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern).replace(r"\z", r"\Z")
    strings = _required(re._parser.parse(re.sub(r"\\p\{\w+\}", r"\\w", portable)))
    shortest = [s for s in strings or () if not any(other in s for other in strings - {s})]
    return tuple(sorted(shortest)) if shortest and min(map(len, shortest)) > 2 and len(shortest) <= 24 else ()


def excluded(text: Column, pattern: str) -> Column:
    """True where the text holds none of the strings that a match needs: a search for bytes, cheaper than one for a pattern."""
    from tracewell.functions.text import let

    strings = needles(pattern)
    if not strings:
        return F.lit(False)
    held = lambda lowered: reduce(or_, [lowered.contains(string) for string in strings])
    # bound to a name: Spark would otherwise make the text lower-case once for each string
    return ~let(F.lower(text), held)


def extracted(text: Column, pattern: str, ignore_case: bool, group: int) -> Column:
    """What a group of the first match holds, empty without a match."""
    value = by_alphabet(text, pattern, ignore_case, lambda p: F.regexp_extract(text, p, group))
    return F.when(excluded(text, pattern), "").otherwise(value) if needles(pattern) else value


def found(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """True where the pattern occurs in the text."""
    test = by_alphabet(text, pattern, ignore_case, text.rlike)
    return ~excluded(text, pattern) & test if needles(pattern) else test


def removed(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """The text without what the pattern matches."""
    value = by_alphabet(text, pattern, ignore_case, lambda p: F.regexp_replace(text, p, ""))
    return F.when(excluded(text, pattern), text).otherwise(value) if needles(pattern) else value


def captured(text: Column, pattern: str, ignore_case: bool = True, group: int = 1) -> Column:
    """The first capture, squeezed; null when there is none or it is blank."""
    from tracewell.functions.text import let, squeeze

    # bound to a name: Spark would otherwise search once for the test and once for the value
    found_ = extracted(text, pattern, ignore_case, group)
    return let(squeeze(found_), lambda value: F.when(value != "", value))


def first_captured(text: Column, patterns, ignore_case: bool = True) -> Column:
    """The first capture of the first pattern that yields a non-blank one."""
    return F.coalesce(*[captured(text, p, ignore_case) for p in patterns])


def first_label(text: Column, rules, ignore_case: bool = True) -> Column:
    """The label of the first ``(label, pattern)`` rule that is found, else null."""
    chain = None
    for label, pattern in rules:
        test = found(text, pattern, ignore_case)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain
