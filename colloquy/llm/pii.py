"""Operator 7: personal data, with offset-preserving deobfuscation.

Base patterns find e-mail addresses, IP addresses, card and phone numbers in the text
as it stands. The method adds spans: transducers rewrite homoglyphs, spelled digits and
at/dot disguises, each output character keeping the source characters it came from; the
same patterns run over the rewritten text, and what they find there that needed a rewrite is
mapped back to source characters. Base spans stay as they are.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one;
a text is scanned whole, in time linear in its length; an empty table gives an empty result;
only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

from colloquy.llm.common import prepare
from colloquy.llm.spans import Span, scanner, within

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where its first run of digits begins, as matches end with whole runs.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> list[Span]:
    """Each @ with the longest local part before it, past the last match, and a domain behind it."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        if at >= last and (m := _DOMAIN.match(text, at + 1)):
            a = at
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            if a < at:
                found.append(("email", a, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return found


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans by kind as listed, then start."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_part, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


# Characters that look like ASCII ones, in pairs of look-alike and ASCII character.
LOOKALIKES = "аaеeоoрpсcхxуyіiјjѕsԁdһhԛqԝwАAВBЕEКKМMНHОOРPСCТTХXІIЈJЅSαaοoνvρpτtυuΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
DASHES, SPACES, HIDDEN, DOTS = "‐‑‒–—−", "      　", "­​‌‍⁠﻿", "。․"
#: Names of the digits 0 to 9 in four languages.
DIGIT_NAMES = [
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
]
DIGIT_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1"}
AT_WORDS, DOT_WORDS = "at|arroba|ät|chez", "dot|punkt|point|punto"

_GLYPHS = dict(zip(LOOKALIKES[::2], LOOKALIKES[1::2], strict=True)) | dict.fromkeys(DASHES, "-") | dict.fromkeys(SPACES, " ") | dict.fromkeys(HIDDEN, "") | dict.fromkeys(DOTS, ".")
_NAMED = {w: str(i) for names in DIGIT_NAMES for i, w in enumerate(names.split())}
_NAME = "(?:" + "|".join(sorted(_NAMED, key=len, reverse=True)) + ")"
# What _glyph may rewrite: all but ASCII and the Latin characters that no table names; no other decimal digit lies below U+0250.
_BEYOND = re.compile("[^" + re.escape("".join(c for c in map(chr, range(0x250)) if c not in _GLYPHS)) + "]")
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,-]+)?(?:{_NAME}|[0-9])(?:[\s,-]+(?:(?:{DOT_WORDS})[\s,-]+)?(?:{_NAME}|[0-9]))+(?!\w)", re.IGNORECASE)
# The first of the names that _digits asks for has a name, a dot word or a digit behind it.
_SPELLED_HINT = re.compile(rf"(?<!\w){_NAME}[\s,-]+(?:{_NAME}|{DOT_WORDS}|[0-9])(?!\w)", re.IGNORECASE)
_SPELLED_WORD = re.compile(rf"(?:(?P<plus>plus)|(?P<name>{_NAME})|(?P<digit>[0-9])|(?P<dot>{DOT_WORDS}))[\s,-]*", re.IGNORECASE)
# Boxes without the white space before them, which a search for them would read again and again; Tape.rewrite takes it in.
_BOXED_AT = re.compile(rf"[\[({{<]\s*(?:{AT_WORDS}|@)\s*[\])}}>]\s*", re.IGNORECASE)
_BOXED_DOT = re.compile(rf"[\[({{<]\s*(?:{DOT_WORDS}|\.)\s*[\])}}>]\s*", re.IGNORECASE)
_ATOM = r"[A-Za-z0-9_%+-]+"
# Chains of atoms, joined by written or said dots, forwards and, over the reversed text, backwards. They give nothing back, so each is read once.
_CHAIN = re.compile(rf"{_ATOM}+(?:(?:\.|\s++(?:{DOT_WORDS})\s++){_ATOM}+)*+", re.IGNORECASE)
_CHAIN_BACK = re.compile(rf"{_ATOM}+(?:(?:\.|\s++(?:{DOT_WORDS[::-1]})\s++){_ATOM}+)*+", re.IGNORECASE)
# Matches begin where white space begins, so each run of it is read once; two at words may share the white space between them.
_SAID_DOT = re.compile(rf"(?<!\s)\s+(?:{DOT_WORDS})\s+", re.IGNORECASE)
_SAID_AT = re.compile(rf"(?<!\s)\s+(?:{AT_WORDS})(?=\s)|(?<=[A-Za-z0-9_%+-])@(?=[A-Za-z0-9_%+-])", re.IGNORECASE)
_WHOLE_AT = re.compile(rf"\s+(?:{AT_WORDS})\s+|@", re.IGNORECASE)
_LABEL = re.compile("[A-Za-z]{2,}")
# Endings of file names, which a domain of two labels behind a said "at" doesn't have.
FILE_ENDINGS = frozenset("bat bin cfg conf cpp css csv doc docx exe gif gz htm html ini jpeg jpg js json log md mov mp3 mp4 pdf php png ppt pptx py rar rs rtf sh sql svg tar ts txt wav xls xlsx xml yaml yml zip".split())
_NUMBER_DOT = re.compile(rf"(?<=[0-9])\s+(?:{DOT_WORDS})\s+(?=[0-9])", re.IGNORECASE)
# All that the transducers rewrite holds a dot word, a box or an at word before a domain whose first dot is written.
_HINT = re.compile(rf"(?<![^\W_])(?:{DOT_WORDS})(?![^\W_])|[\[({{<]\s*(?:{AT_WORDS}|@|\.)\s*[\])}}>]|(?<=\s)(?:{AT_WORDS})\s+{_ATOM}\.[A-Za-z0-9_%+-]", re.IGNORECASE)


_DOT_WORD = re.compile(DOT_WORDS, re.IGNORECASE)
# Groups of digits with letters in their places, and a sign that there may be one.
_DIGIT_RUN = re.compile(r"(?<![\w+.-])\+?(?=[0-9OoIl -]*[OoIl])[0-9OoIl]++(?:[ -][0-9OoIl]++)*+(?!\w)")
_LETTERED = re.compile("[0-9][OoIl]|[OoIl][0-9]")
_NOT_ASCII = re.compile("[^\x00-\x7f]")

#: What a transducer puts out: characters, and the positions (end exclusive) they stand for.
Piece = tuple[str, int, int]


class Tape:
    """A text under rewriting: for each character its source span and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = [False] * len(text)

    def rewrite(self, matches: Iterable[re.Match], output: Callable[[re.Match], list[Piece] | None], blanks: bool = False) -> bool:
        """Put other characters in place of matches, which come in order: output gives the (characters, from, to)
        of a match, positions in the present text; None leaves it. blanks: white space before a match goes with it."""
        found = [(m, o) for m in matches if (o := output(m)) is not None]
        if not found:
            return False
        text, start, end, new, at = [], [], [], [], 0
        for m, out in found:
            a = m.start()
            while blanks and a > at and self.text[a - 1].isspace():
                a -= 1
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            for chars, b, e in out:
                b = a if blanks else b
                text.append(chars)
                start += [self.start[b]] * len(chars)
                end += [self.end[e - 1]] * len(chars)
                new += [True] * len(chars)
            at = m.end()
        text.append(self.text[at:])
        self.text, self.start, self.end, self.new = "".join(text), start + self.start[at:], end + self.end[at:], new + self.new[at:]
        return True


def domain(text: str) -> bool:
    """Whether what stands behind a said "at" can be a domain: two labels or more, the last of two letters or more, no file
    name, and no sentence that begins behind a written dot."""
    written = re.split(rf"(\.)|\s+(?:{DOT_WORDS})\s+", text, flags=re.IGNORECASE)
    labels, last = written[::2], written[-1]
    if len(labels) < 2 or not _LABEL.fullmatch(last):
        return False
    if written[-2] is None:  # the dot is said
        return True
    return not (last[0].isupper() and last[1:].islower()) and not (len(labels) == 2 and last.lower() in FILE_ENDINGS)


def said(text: str) -> Iterator[re.Match]:
    """The dot words, and between them the at words, of all disguised addresses, in order.

    Each at takes the chains of atoms on both sides, however long; a chain that one at has taken, or that can't be a domain, isn't
    read again, so the work grows with the text.
    """
    back = None
    done = known = 0  # no address reaches back before the first; up to the second lies a chain that is no domain
    for at in _SAID_AT.finditer(text):
        if at.start() < max(done, known):
            continue
        at = _WHOLE_AT.match(text, at.start())
        right = _CHAIN.match(text, at.end())
        if right is None or "." not in right.group() and not _SAID_DOT.search(right.group()):
            continue
        if at.group() != "@" and not domain(right.group()):
            known = right.end()
            continue
        back = back or text[::-1]
        left = _CHAIN_BACK.match(back, len(text) - at.start(), len(text) - done)
        if left is None:
            continue
        a, b = len(text) - left.end(), right.end()
        yield from _SAID_DOT.finditer(text, a, at.start())
        yield at
        yield from _SAID_DOT.finditer(text, at.end(), b)
        done = b


def _said(m: re.Match) -> list[Piece]:
    return [("." if _DOT_WORD.fullmatch(m.group().strip()) else "@", m.start(), m.end())]


def _digit_letters(m: re.Match) -> list[Piece] | None:
    """Letters that look like digits among seven digits or more."""
    if len(_DIGIT.findall(m.group())) < 7:
        return None
    return [(DIGIT_LETTERS.get(c, c), m.start() + i, m.start() + i + 1) for i, c in enumerate(m.group())]


def _glyph(m: re.Match) -> list[Piece] | None:
    c = m.group()
    if c in _GLYPHS:
        out = _GLYPHS[c]
    elif "！" <= c <= "～":  # full-width forms
        out = chr(ord(c) - 0xFEE0)
    elif (d := unicodedata.decimal(c, None)) is not None:
        out = str(int(d))
    else:
        return None
    return [(out, m.start(), m.end())] if out else []


def _digits(m: re.Match) -> list[Piece] | None:
    parts = list(_SPELLED_WORD.finditer(m.group()))
    if sum(p["name"] is not None for p in parts) < 2:
        return None
    out = []
    for p in parts:
        said = p.lastgroup
        char = {"plus": "+", "dot": "."}.get(said) or _NAMED.get(p[said].lower(), p[said])
        out.append((char, m.start() + p.start(), m.start() + p.end(said)))
    return out


def _as(char: str) -> Callable[[re.Match], list[Piece]]:
    return lambda m: [(char, m.start(), m.end())]


def normalised(text: str) -> Tape | None:
    """The rewritten text, or None where no transducer changes anything."""
    tape, changed = Tape(text), False
    if _BEYOND.search(text):
        changed |= tape.rewrite(_NOT_ASCII.finditer(text), _glyph)
    if _LETTERED.search(tape.text):
        changed |= tape.rewrite(_DIGIT_RUN.finditer(tape.text), _digit_letters)
    if _SPELLED_HINT.search(tape.text):
        changed |= tape.rewrite(_SPELLED.finditer(tape.text), _digits)
    if _HINT.search(tape.text):
        changed |= tape.rewrite(_BOXED_AT.finditer(tape.text), _as("@"), blanks=True)
        changed |= tape.rewrite(_BOXED_DOT.finditer(tape.text), _as("."), blanks=True)
        changed |= tape.rewrite(_NUMBER_DOT.finditer(tape.text), _as("."))
        changed |= tape.rewrite(said(tape.text), _said)
    return tape if changed else None


def may_differ(text: str) -> bool:
    return bool(_BEYOND.search(text) or _HINT.search(text) or _SPELLED_HINT.search(text) or _LETTERED.search(text))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind as listed, then start."""
    base = base_spans(text)
    tape = normalised(text) if may_differ(text) else None
    if tape is None:
        return base, base
    inside = {k: within([s for s in base if s[0] == k]) for k in KINDS}
    added = []
    for kind, a, b in base_spans(tape.text):
        s, e = tape.start[a], max(tape.end[a:b])
        if any(tape.new[a:b]) and not inside[kind](s, e):
            added.append((kind, s, e))
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of all spans)."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return docs.select(id_column, text_column).mapInArrow(scanner(find, KINDS, id_column, text_column), schema)
