"""Operator 2: personal data, also where it is disguised, with spans in the source text.

Plain identifiers come from four patterns over the text. Disguised ones come from two transducers in
a row, each of which keeps for what it writes the source characters it stands for. The first maps
characters: look-alike letters and other digits to ASCII, invisible characters to nothing. The second
reads the result once from left to right as tokens (names, digits, spelled digits, and joints: an at
or a dot that is bracketed, spelled, spaced or plain) and rewrites tokens by what stands around them:
joints between the parts of an address, or between four groups of digits, to ``@`` and ``.``; spelled
digits in a row of seven or more to digits. As all kinds of tokens go through the same reading, they
may be mixed in one identifier. The patterns run over what comes out; a span found there goes back
through both records, and counts if a rewrite lies inside it and it is not equal to or inside a plain
span of its kind. It may overlap one, which a disguise has cut.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# Characters that look like ASCII ones, in alphabetical order of what they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
    "․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
# Characters that are not seen.
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Ten digit values of each script that writes numbers with its own digits: full-width, Arabic-Indic, extended Arabic-Indic, Devanagari, mathematical bold to monospace.
_DIGIT_RUNS = (0xFF10, 0x0660, 0x06F0, 0x0966, *range(0x1D7CE, 0x1D7FF, 10))

_ONE = {ord(k): v for k, v in LOOKALIKES.items()}
_ONE |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_ONE |= {start + d: str(d) for start in _DIGIT_RUNS for d in range(10)}
_ODD = frozenset([*map(chr, _ONE), *INVISIBLE])
_UNSEEN = re.compile(f"[{INVISIBLE}]")
_AT_WORD, _DOT_WORD = "at|ät|arroba|arobase", "dot|punkt|point|punto"
_WORD_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
#: The kinds of tokens. Upper case: joints that nothing but an address has; a, d: spelled ones, which may be words; p: a spaced dot.
#: A run of blanks or underscores is looked at from its beginning only and never given back, so that reading takes time in proportion to the text.
_TOKEN = re.compile(
    rf"""(?P<A>(?:(?<!\s)\s++)?[\[({{<]\s*+(?:@|{_AT_WORD})\s*+[\])}}>]\s*+|(?<!\s)\s++@\s*+|@\s++)
    |(?P<D>(?:(?<!\s)\s++)?[\[({{<]\s*+(?:\.|{_DOT_WORD})\s*+[\])}}>]\s*+)
    |(?P<a>(?<!\s)\s++(?:{_AT_WORD})\s++|(?<!_)_++(?:{_AT_WORD})_++)
    |(?P<d>(?<!\s)\s++(?:{_DOT_WORD})\s++|(?<!_)_++(?:{_DOT_WORD})_++)
    |(?P<p>(?<!\s)\s++\.\s*+(?=(?-i:[a-z0-9])))
    |(?P<s>(?<![^\W_])(?:{_WORD_DIGIT})(?![^\W_]))
    |(?P<P>\+|(?<![^\W_])plus(?![^\W_]))
    |(?P<o>(?<![0-9])[0-9](?![0-9]))
    |(?P<n>[0-9]+)
    |(?P<w>(?:[A-Za-z%]|_++(?!(?:{_AT_WORD}|{_DOT_WORD})_))(?:[A-Za-z0-9%-]|_++(?!(?:{_AT_WORD}|{_DOT_WORD})_))*+)
    |(?P<at>@)|(?P<dot>\.)|(?P<dash>-)|(?P<far>\s{{4}}\s*+)|(?P<gap>[\s,()])""",
    re.I | re.X,
)
_CLASS = {"at": "@", "dot": ".", "dash": "-", "gap": " ", "far": "x"}
_CLASSES = ["", *[_CLASS.get(k, k) for k in _TOKEN.groupindex]]
#: Over the tokens' kinds, x being what is no token or too many blanks: joint and domain of an address; what its local part has and what parts it; four groups of digits; digits in a row.
_ADDRESS = re.compile(r"[Aa@]([wnos-]+(?:[.dDp][wnos-]+)+)")
_LOCAL_KINDS, _LOCAL_JOINTS = frozenset("wnosP-"), frozenset(".dD")
_QUAD = re.compile(r"(?<![wnos.])(?:n|[so](?: ?[so]){0,2})(?:[.dDp](?:n|[so](?: ?[so]){0,2})){3}(?![wnos])")
_ROW = re.compile(r"(?:P ?)?[nos](?:[ .-]{1,3}[nos])+")
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:@|\.|{_AT_WORD}|{_DOT_WORD})\s*[\])}}>]|_(?:{_AT_WORD}|{_DOT_WORD})_", re.I)
_JOINTS = frozenset("@ dot punkt point punto arroba arobase".split())
_DIGIT_TOKENS = re.compile(b"[\1\2]{2}")
_IS_SPELLED = frozenset([*SPELLED, "plus"]).__contains__
#: Digits that are everyday words: one of them alone beside a plain number is no part of it.
_EVERYDAY = frozenset(["one", "oh", "null", "un", "uno"])
#: A plain word "at" before a domain, which counts after a name with a digit or sign in it.
_AT_DOMAIN = re.compile(r" at [A-Za-z0-9-]+\.[A-Za-z]", re.I)
_NAMED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9._+-])")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain identifiers, leftmost and not overlapping within a kind."""
    found, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end(), "email"))
            free = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return found


def _odd(text: str) -> bool:
    return not text.isascii() and not _ODD.isdisjoint(set(text))


def _hints(text: str) -> bool:
    """Whether the text may hold a disguised address, or two digit words in a row."""
    lower = text.lower()
    words = lower.split()
    if not _JOINTS.isdisjoint(words) or "@ " in text or " @" in text or (" at " in lower and _AT_DOMAIN.search(text) is not None) or (any(c in text for c in "[({<_") and _BRACKETED.search(text) is not None):
        return True
    for c in ",.()-+":
        lower = lower.replace(c, " ")
    words = lower.split()
    if not any(map(_IS_SPELLED, words)):
        return False
    return _DIGIT_TOKENS.search(bytes([1 if _IS_SPELLED(w) else 2 * w.isdigit() for w in words])) is not None


def _edits(text: str) -> list[tuple[int, int, str]]:
    """Rewrites (start, end, replacement) of a text without look-alikes, by start, not overlapping."""
    if not _hints(text):
        return []
    kinds, tokens, at = [], [], 0
    for m in _TOKEN.finditer(text):
        span = m.span()
        if span[0] > at:
            kinds.append("x")
            tokens.append((at, span[0]))
        kinds.append(_CLASSES[m.lastindex])
        tokens.append(span)
        at = span[1]
    line = "".join(kinds)
    new: dict[int, str] = {}

    def digits(first: int, last: int) -> None:
        """Spelled digits to digits, and nothing for the gaps between them and other single ones."""
        before = None
        for i in range(first, last):
            if line[i] in "so":
                if before is not None and "s" in (line[i], line[before]) and set(line[before + 1 : i]) <= set(" .-"):
                    new.update({j: "" for j in range(before + 1, i)})
                if line[i] == "s":
                    new[i] = SPELLED[text[slice(*tokens[i])].lower()]
            before = i if line[i] in "so" else before if line[i] in " .-" else None

    free = 0
    for m in _ADDRESS.finditer(line):
        joint = first = m.start()
        while first > free and (line[first - 1] in _LOCAL_KINDS or (first < joint and line[first - 1] in _LOCAL_JOINTS and line[first] in _LOCAL_KINDS and first - 1 > free and line[first - 2] in _LOCAL_KINDS)):
            first -= 1
        if first == joint:
            continue
        free, domain, whole = m.end(), m[1], line[first : m.end()]
        weak = line[joint] == "a" and not set("dD") & set(domain)
        named = text[slice(*tokens[joint])].strip().lower() == "at" and _NAMED.match(text[tokens[first][0] : tokens[joint][0]])
        if set(whole) & set("AaDdp") and (not weak or (named and "p" not in domain)) and (line[joint] != "@" or set("dDp") & set(whole)):
            new.update({i: "@" if line[i] in "Aa" else "." for i in range(first, m.end()) if line[i] in "AaDdp"})
    for m in _QUAD.finditer(line):
        if set("dDs") & set(m[0]) and not any(i in new for i in range(*m.span())):
            group = m.start()
            for i in [*[i for i in range(*m.span()) if line[i] in ".dDp"], m.end()]:
                digits(group, i)
                new.update({j: "" for j in range(group, i) if line[j] == " "})
                if i < m.end() and line[i] != ".":
                    new[i] = "."
                group = i + 1
    for m in _ROW.finditer(line):
        count = sum(tokens[i][1] - tokens[i][0] if line[i] in "no" else line[i] == "s" for i in range(*m.span()))
        if "s" in m[0] and count >= 7 and not any(i in new for i in range(*m.span())):
            digits(*m.span())
            if line[m.start()] == "P":
                new[m.start()] = "+"
                if line[m.start() + 1] == " ":
                    new[m.start() + 1] = ""
    return [(*tokens[i], to) for i, to in sorted(new.items()) if text[slice(*tokens[i])] != to]


class Normalised:
    """A text after the rewrites, and the way back to the source.

    ``cuts`` are positions of the normalised text at which a new stretch begins; ``stretches`` holds
    for each its source start, source end and whether it was rewritten.
    """

    def __init__(self, source: str):
        text, origin = source, None
        if _odd(source):
            text = source.translate(_ONE)
            if _UNSEEN.search(text):
                origin = [i for i, c in enumerate(text) if c not in INVISIBLE]
                text = _UNSEEN.sub("", text)
        self.same = text == source
        back = (lambda i: i) if origin is None else (lambda i: origin[i])
        parts, cuts, stretches, at, size = [], [], [], 0, 0
        for start, end, new in [*_edits(text), (len(text), len(text), "")]:
            for old, to, piece, changed in ((at, start, text[at:start], False), (start, end, new, True)):
                if piece:
                    cuts.append(size)
                    stretches.append((old, to, changed))
                    parts.append(piece)
                    size += len(piece)
            at = end
        self.changed = not self.same or any(s[2] for s in stretches)
        self.text, self.cuts, self.stretches = "".join(parts), cuts, stretches
        self._back, self.source = back, source

    def span(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source start, source end, and whether a rewrite lies between them."""
        first, last = bisect_right(self.cuts, start) - 1, bisect_right(self.cuts, end - 1) - 1
        a, b = self.stretches[first], self.stretches[last]
        left = a[0] if a[2] else a[0] + start - self.cuts[first]
        right = b[1] if b[2] else b[0] + end - self.cuts[last]
        left, right = self._back(left), self._back(right - 1) + 1
        return left, right, self.source[left:right] != self.text[start:end]


def disguised(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of identifiers that show only after normalisation."""
    if not _odd(text) and not _hints(text):
        return []
    normal = Normalised(text)
    if not normal.changed:
        return []
    mine = {kind: sorted((a, b) for a, b, k in known if k == kind) for kind in KINDS}
    found = []
    for start, end, kind in plain(normal.text):
        left, right, rewritten = normal.span(start, end)
        if not rewritten:
            continue
        at = bisect_right(mine[kind], (left, len(text) + 1))  # spans of a kind do not overlap
        if at and mine[kind][at - 1][1] >= right:
            continue
        near = mine[kind][at - 1 : at] if at and mine[kind][at - 1][0] == left else []
        while at < len(mine[kind]) and mine[kind][at][1] <= right:
            near.append(mine[kind][at])
            at += 1
        if not any(b <= right and (text[left:a] + text[b:right]).strip(" \t\n,.()-").lower() in _EVERYDAY for a, b in near):
            found.append((left, right, kind))
    return found


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain spans and added ones, each by start and then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]))
    base = sorted(plain(text or ""), key=order)
    return base, sorted(disguised(text or "", base), key=order)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go as one."""
    if not text:
        return text
    base, more = spans(text)
    out, at = [], 0
    for start, end, kind in sorted([*base, *more], key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


_FOUND = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_added: long>"


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, plain spans of each kind counted, their digest, and all spans, for each row.

    Offsets count code points, ends are exclusive. Null text counts as empty; repeated rows each get
    a row; an empty table gives an empty result; other columns are left out, whatever their names. A
    text is worked on whole, in time in proportion to its length, which takes about 200 times its bytes where it
    may hold disguised identifiers, and 10 times elsewhere.
    """

    @F.arrow_udf(_FOUND)
    def find(column: pa.Array) -> pa.Array:
        rows = []
        for text in column:
            base, more = spans(text.as_py())
            kinds = [s[2] for s in base]
            every = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(every), len(more)))
        names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "n_added"]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return documents.select("doc_id", find(F.col("text")).alias("_found")).select("doc_id", "_found.*")


def mask_personal_data(documents: DataFrame) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced by ``<kind>``; ``n_chars`` follows if it is there.

    Null and empty texts stay; repeated rows are treated alike; an empty table stays empty; other
    columns stay, whatever their names. A text is worked on whole, as in ``personal_data``.
    """

    @F.arrow_udf("string")
    def mask(column: pa.Array) -> pa.Array:
        return pa.array([masked(x.as_py()) for x in column], pa.string())

    out = documents.withColumn("text", mask(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.read(spark, sf_dir, "documents"))
