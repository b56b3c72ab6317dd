"""Personal data in texts, also where it is disguised, at its places in the source.

Base patterns run on the source. A transducer then rewrites disguises: look-alike
characters, digits of other scripts and invisible characters; spelled digits (with
``plus`` for ``+``); ``at`` and ``dot`` in words or brackets. Every character of the
rewritten text keeps the source range that it stands for. The base patterns run on it
again, and what they find through a rewritten character is mapped back to source ranges;
ranges that meet no base one are added. Texts without any disguise skip the second part.

A bare `` at `` counts only with a disguised dot in the domain, so prose is left alone.
Offsets are in code points, ends exclusive. Null and empty texts have no spans; the masked
text of a null is null. Long texts are searched whole, in time in proportion to their length.
Of spans that start at one place the kind listed first comes first. Repeated rows get equal
spans, an empty table an empty result; an input column named as an output is replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from meshflock.llm.carry import add_columns

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits matches from its start or not at all: the look-behind only saves time.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = "".join(DIGITS.findall(m[0]))
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# Letters of other scripts that look like Latin ones, in the order of the Latin letter.
LOOKALIKES = {
    "a": "аα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м", "n": "п", "o": "оοօ", "p": "рρ",
    "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "-": "‐‑‒–—−", ".": "․。", "@": "﹫",
}
TO_LATIN = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others}
TO_LATIN |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
TO_LATIN |= {c: str(unicodedata.digit(chr(c))) for c in range(0x660, 0x10000) if unicodedata.category(chr(c)) == "Nd" and c < 0xFF00}
GONE = "­​‌‍⁠﻿"
#: Dashes alone are no disguise: such a text is rewritten only if it also holds a digit or @.
ODD = re.compile("[" + "".join(sorted({chr(c) for c, to in TO_LATIN.items() if to != "-"})) + GONE + "]")
DASH = re.compile("[" + LOOKALIKES["-"] + "]")

# Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_W = "|".join(DIGIT_WORDS)
SPELLED = re.compile(rf"(?:\bplus[\s-]+)?\b(?:{_W}|[0-9])(?:[\s.,-]{{1,3}}(?:{_W}|[0-9]))+\b", re.I)
#: The same with groups of digits among the words.
GROUPED = re.compile(rf"(?:\bplus[\s-]+)?\b(?:{_W}|[0-9]+)(?:[\s.,-]{{1,3}}(?:{_W}|[0-9]+))+\b", re.I)
GROUP = re.compile("[0-9]{2}")
WORD_HINTS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "zero", "one one", "one-one")
ONE_DIGIT = re.compile(rf"{_W}|[0-9]", re.I)
# Each alternative begins at a bracket, a word or a sign; white space around it is taken in by ``disguises``.
DISGUISE = re.compile(r"(?P<sat>[\[({<]\s*(?:at|@)\s*[\])}>])|(?P<sdot>[\[({<]\s*(?:dot|\.)\s*[\])}>])|(?P<wat>(?<=\s)at(?=\s)|(?<=\s)@|@(?=\s))|(?P<wdot>(?<=\s)dot(?=\s))", re.I)
BRACKETED = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]", re.I)

#: MIXED is SPELT with groups of digits and few words: it takes a plus or a card's check digit.
COPIED, LOOKS, SPELT, MIXED, STRONG, WEAK = range(6)


class Tape:
    """Rewritten text: characters, the source range and the kind of rewriting of each."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.how = list(text), list(range(len(text))), list(range(1, len(text) + 1)), [COPIED] * len(text)

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]], int]]) -> None:
        """edits: (from, to, [(character, its from, its to)], kind), in order, places on this tape."""
        text, starts, ends, how, at = [], [], [], [], 0
        for a, b, new, kind in edits:
            for mine, old in ((text, self.text), (starts, self.starts), (ends, self.ends), (how, self.how)):
                mine += old[at:a]
            for ch, x, y in new:
                text.append(ch)
                starts.append(self.starts[x])
                ends.append(self.ends[y - 1])
                how.append(kind)
            at = b
        for mine, old in ((text, self.text), (starts, self.starts), (ends, self.ends), (how, self.how)):
            mine += old[at:]
        self.text, self.starts, self.ends, self.how = text, starts, ends, how

    def string(self) -> str:
        return "".join(self.text)


def transduce(text: str, spelled: re.Pattern = SPELLED) -> Tape | None:
    """The rewritten text, or None where nothing is disguised. A run of ``spelled`` counts from
    four digits on, of which one at least is a word."""
    odd = not text.isascii() and (ODD.search(text) is not None or (DASH.search(text) is not None and DIGITS.search(text) is not None))
    low = text.lower()
    words = any(w in low for w in WORD_HINTS)
    places = "dot" in low or BRACKETED.search(text) is not None
    if not (odd or words or places):
        return None
    tape = Tape(text)
    if odd:
        tape.rewrite([(i, i + 1, [] if c in GONE else [(TO_LATIN[ord(c)], i, i + 1)], LOOKS) for i, c in enumerate(text) if c in GONE or ord(c) in TO_LATIN])
        low = tape.string().lower()
        words, places = any(w in low for w in WORD_HINTS), "dot" in low or BRACKETED.search(low) is not None
    if words:
        edits = []
        for m in spelled.finditer(tape.string()):
            marks = [(DIGIT_WORDS.get(x[0].lower(), x[0]), m.start() + x.start(), m.start() + x.end()) for x in ONE_DIGIT.finditer(m[0])]
            if len(marks) >= 4 and any(b - a > 1 for _, a, b in marks):
                plus = [("+", m.start(), m.start() + 4)] if m[0][:4].lower() == "plus" else []
                bare = not GROUP.search(m[0]) or ("," not in m[0] and sum(b - a > 1 for _, a, b in marks) >= 3)
                edits.append((m.start(), m.end(), plus + marks, SPELT if bare else MIXED))
        tape.rewrite(edits)
    if places:
        tape.rewrite([(a, b, [(sign, a, b)], kind) for a, b, sign, kind in disguises(tape.string())])
    return tape


def disguises(text: str):
    """(from, to, @ or ., kind) of every ``at`` and ``dot``, with the white space around it.

    Time is in proportion to the text: what one disguise has taken in is not looked at again."""
    done = 0
    for m in DISGUISE.finditer(text):
        a, b = m.span()
        while a > done and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        strong = m.lastgroup[0] == "s"
        if strong or (a < m.start() and b > m.end()) or (m[0] == "@" and (a < m.start() or b > m.end())):
            yield a, b, "@" if m.lastgroup in ("sat", "wat") else ".", STRONG if strong else WEAK
            done = b


def meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether (a, b) meets one of the sorted, non-overlapping ranges."""
    k = bisect_right(spans, (b - 1, 1 << 62))
    return any(x < b and a < y for x, y in spans[max(0, k - 4) : k])


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = spans_of(transduce(text), base)
    low = text.lower()
    if any(w in low for w in WORD_HINTS) and GROUP.search(text):
        # runs with groups of digits: what they add to the spans above
        more = spans_of(transduce(text, GROUPED), base)
        held = sorted((a, b) for a, _, b in out)
        out = sorted(set(out + [s for s in more if not meets(held, s[0], s[2])]))
    return out


def spans_of(tape: Tape | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the base patterns find through a rewritten character, at its source."""
    if tape is None:
        return []
    held = sorted((a, b) for a, _, b in base)
    out = []
    norm = tape.string()
    found = base_spans(norm)
    spelt = [(m.start(), 3, m.end()) for m in re.finditer(r"(?<![0-9+])[0-9]{10,15}(?![0-9])", norm) if all(h == SPELT for h in tape.how[m.start() : m.end()])]
    taken = [sorted((a, b) for a, k, b in found if k == kind) for kind in range(4)]
    for a, kind, b in found + [s for s in spelt if not any(meets(t, s[0], s[2]) for t in taken)]:
        how = tape.how[a:b]
        s, e = tape.starts[a], tape.ends[b - 1]
        if not any(how) and e - s == b - a:
            continue
        if kind == 0:
            at = norm.index("@", a, b)
            if norm[b - 1 : b] == "-" or not norm[a:b].rpartition(".")[2].isalpha() or len(norm[a:b].rpartition(".")[2]) < 2:
                continue
            if tape.how[at] == WEAK and not any(h >= STRONG for h in tape.how[at + 1 : b]):
                continue
            if tape.how[at] == COPIED and not (e - s > b - a or any(h in (LOOKS, STRONG) for h in how)):
                continue
        if not meets(held, s, e):
            out.append((s, kind, e))
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of spans that meet, the first decides."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


ADDED = [("n_email", "long"), ("n_ip", "long"), ("n_card", "long"), ("n_phone", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_added", "long"), ("masked", "string")]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts, the digest of base spans, all spans and the masked text."""

    def searched(texts):
        cols = [[] for _ in ADDED]
        for t in texts.to_pylist():
            base = base_spans(t or "")
            more = added_spans(t, base) if t else []
            spans = sorted(base + more)
            ks = [k for _, k, _ in base]
            row = [*(ks.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(more), mask(t, spans) if spans else t]
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return [pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(cols, ADDED, strict=True)]

    return add_columns(docs, lambda: searched, ADDED, [text])
