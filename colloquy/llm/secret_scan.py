"""Operator 1: secret scans.

Base patterns find assignments, access keys and hexadecimal strings. The method
adds spans: over each candidate string (a run of LEAST key characters or more) a window slides,
its Shannon entropy kept by incremental counts, with a threshold for each
character class; stretches above it that no allow-list rule explains are reported
as kind ``entropy``. The window is WINDOW characters, or the candidate where that is shorter, with the threshold's
share of what so many characters can reach. What is left of a candidate between stretches or at its ends and is
shorter than a window, and so can't be judged alone, goes with them. A stretch is left out only if one base span holds all of it, so spans may overlap.
Every candidate with a letter is scored, digits or not; one shorter than WINDOW must have two of upper case,
lower case and digits. Letters count as words by the share of their letter pairs that are common in English, German, French or
Spanish, and by few changes to upper case; random letters pass as words now and then.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by
one; a text is scanned whole, in time that grows with its length alone, whatever stands in it;
of spans that start together the kind listed first comes first; an empty table gives an empty
result; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from colloquy.llm.common import prepare
from colloquy.llm.spans import Span, scanner, within

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINT = re.compile("passw|secret|token|api", re.ASCII | re.IGNORECASE)
# A run shorter than this is dropped whatever follows, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

WINDOW, LEAST = 20, 12
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)
UPPER, LOWER, DIGIT = re.compile("[A-Z]"), re.compile("[a-z]"), re.compile("[0-9]")
#: Bits a character that a window of WINDOW characters must reach, by character class.
THRESHOLDS = {"hex": 2.9, "lower": 3.4, "upper": 3.4, "mixed": 3.6}
#: Candidates that are no secrets: UUIDs, dates and times; worded() knows paths and names.
ALLOWED = [
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_0-9:-]*"),
    re.compile(r"[0-9+/_=-]+"),
]
SEPARATORS = re.compile(r"[+/_=-]+")
PART = re.compile(r"([A-Za-z]*)[0-9]{0,4}")
# Letters, and those that commonly follow them in words of four languages.
FOLLOWERS = (
    "a:abcdeghijlmnopqrstuvyz b:aeijloruy c:aehiklortu d:adehinorstu e:abcdefghijklmnopqrstuvwxyz f:aefilortu g:aeilrsu h:abceghiklmnoprstuvwz i:abcdefgijlmnopqrstvz j:aeou k:aeilnortu l:adefiklostuyz m:abeimopu"
    " n:abcdeghiklmnopqrstuvwz o:abcdefgilmnopqrstuvwz p:aefiloprtuy q:u r:abcdefghiklmnoprstuvwyz s:abcdeghijlmopqrstuwy t:abehilnorstuyz u:abcdefgiklmnopqrstxz v:aeio w:aehior x:aceot y:epst z:aeiuw"
)
COMMON = frozenset(a + b for a, rest in (x.split(":") for x in FOLLOWERS.split()) for b in rest)
#: Least share of common pairs, in a part of LONG letters or more and in all parts, and letters to a change of case.
COMMON_SHARE, LONG, TO_A_CHANGE = 0.8, 8, 4
CHANGE = re.compile("[a-z][A-Z]")
_PART = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if ASSIGN_HINT.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def character_class(candidate: str) -> str:
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", candidate):
        return "hex"
    upper, lower = UPPER.search(candidate), LOWER.search(candidate)
    return "mixed" if upper and lower else "upper" if upper else "lower"


def hot_stretches(candidate: str) -> list[tuple[int, int]]:
    """Stretches covered by windows whose entropy reaches the class's threshold, with what is too short to be judged beside them.

    The sum of c*log2(c) is changed by the character that enters and the one that
    leaves, so a step costs the same whatever the window.
    """
    window = min(WINDOW, len(candidate))
    full = math.log2(window) if window else 0.0
    least = THRESHOLDS[character_class(candidate)] * full / math.log2(WINDOW) - 1e-9  # sums round
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, ch in enumerate(candidate):
        out = candidate[i - window] if i >= window else ""
        if out != ch:
            if out:  # the one that leaves goes first, so no count exceeds the window
                n = counts[out]
                total += _PART[n - 1] - _PART[n]
                counts[out] = n - 1
            n = counts.get(ch, 0)
            total += _PART[n + 1] - _PART[n]
            counts[ch] = n + 1
        if i >= window - 1 and full - total / window >= least:
            a = i - window + 1
            if found and a - found[-1][1] < window:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((a, i + 1))
    if found and found[0][0] < window:
        found[0] = (0, found[0][1])
    if found and len(candidate) - found[-1][1] < window:
        found[-1] = (found[-1][0], len(candidate))
    return found


def mixed(candidate: str) -> bool:
    """Two of upper case, lower case and digits."""
    return sum(p.search(candidate) is not None for p in (UPPER, LOWER, DIGIT)) >= 2


def allowed(candidate: str) -> bool:
    return any(p.fullmatch(candidate) for p in ALLOWED)


def pairs(letters: str) -> tuple[int, int]:
    """How many common letter pairs, and how many in all."""
    low = letters.lower()
    return sum(low[i : i + 2] in COMMON for i in range(len(low) - 1)), max(0, len(low) - 1)


def worded(candidate: str) -> bool:
    """Whether a candidate is made of words and short numbers, joined or in camel case."""
    parts = [PART.fullmatch(p) for p in SEPARATORS.split(candidate) if p]
    if None in parts:
        return False
    good = total = stubs = 0
    for p in parts:
        letters = p[1]
        g, n = pairs(letters)
        if n >= LONG - 1 and g < COMMON_SHARE * n or len(CHANGE.findall(letters)) * TO_A_CHANGE > len(letters):
            return False
        good, total = good + g, total + n
        stubs += 0 < len(letters) < 3 and p[0] != letters  # a letter or two with a number
    return good >= COMMON_SHARE * total and 3 * stubs <= len(parts)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start, then kind as listed."""
    base = base_spans(text)
    rank = {k: i for i, k in enumerate([*KINDS, "entropy"])}
    order = lambda s: (s[1], rank[s[0]], s[2])
    base.sort(key=order)
    covered = within(base)
    added: list[Span] = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if (LOWER.search(s) or UPPER.search(s)) and (len(s) >= WINDOW or mixed(s)) and not allowed(s) and (hot := hot_stretches(s)) and not worded(s):
            for a, b in hot:
                if not covered(m.start() + a, m.start() + b):
                    added.append(("entropy", m.start() + a, m.start() + b))
    return base, sorted([*base, *added], key=order) if added else base


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_spans (of all spans)."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return docs.select(id_column, text_column).mapInArrow(scanner(find, KINDS, id_column, text_column), schema)


def redacted(text: str | None) -> str | None:
    """The text with each secret span, overlapping ones taken together, replaced."""
    spans = find(text)[1] if text else []
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(text: Column) -> Column:
    """Column form of redacted(), by Arrow batches."""

    @F.arrow_udf(StringType())
    def run(values):
        import pyarrow as pa

        return pa.array([redacted(v.as_py()) for v in values], pa.string())

    return run(text)
