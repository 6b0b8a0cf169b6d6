"""Operator 8: personal data, also where it is disguised, as spans of the source text.

Base spans are found on the source. Then transducers rewrite the text, each keeping for every character it writes the
stretch of its input that the character stands for: (1) look-alike letters, wide and foreign digits, odd dashes, spaces and
dots become ASCII, invisible characters vanish; (2) letters that stand for digits between digits become digits;
(3) rows of four octets with dots between them, of which some are spelled by digits ('one nine two') or as numbers
('ten'), become addresses; (4) runs of three or more spelled digits become digits, however few differ, since the Luhn sum,
the number of digits and the plus decide what is found; (5) bracketed or spelled at and dot become @ and '.', in the local part as well; after a spelled at the host's dots may be plain,
unless a word before it that is common there, a www, a path behind it or an ending like 'Then' make it prose. The same detectors read
the normalised text, and every find is mapped back through all transducers to offsets of the source. A find
inside a base span or an earlier find of its kind is dropped. Of any other, each stretch that no base span nor earlier find
covers is added under the kind of the find: the whole of it, if it touches none, else what they leave of it, so that base
and added spans together cover every find and never overlap. `redact` replaces such a find and all it overlaps as one.

Offsets are code points, end exclusive. Defined cases: null and empty texts have no spans; the transducers run over the
whole text, when any of their patterns occurs in it; repeated rows each give their result. Only the named columns are
read; `redact` keeps all columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import prepare

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that has no match from its start has none from later in it, so runs are entered only at their start.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of the email pattern, in time linear in the text: the local part is the run before each @."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    return out


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four kinds, by start and then by kind."""
    found = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        found += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((*m.span(), 2))
        if "+" in text:
            found += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m[0])) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


# Letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "﹢": "+",
}


def _foldings() -> dict[str, str]:
    table = dict(LOOKALIKES)
    table |= {chr(c): "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    table |= {chr(c): "-" for c in (*range(0x2010, 0x2016), 0x2212, 0xFE63)}
    table |= {chr(c): " " for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000)}
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in (*range(0x660, 0x1100), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            table[chr(c)] = plain
        elif unicodedata.category(chr(c)) == "Nd":
            table[chr(c)] = str(unicodedata.digit(chr(c)))
    return table


FOLDINGS = _foldings()
FOLDED = re.compile("[" + re.escape("".join(FOLDINGS)) + "]")
FOLDED_CHARS = frozenset(FOLDINGS)
AS_DIGITS = str.maketrans("OoIl", "0011")
DIGIT_LIKE = re.compile(r"(?<=[0-9])[ -]?[OoIl]+(?=[ -]?[0-9])")
# Digits spelled in English, German, French and Spanish.
SPELLED = [
    "zero one two three four five six seven eight nine".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
]
DIGIT_OF = {w: str(i) for names in SPELLED for i, w in enumerate(names)} | {"oh": "0"}
_DIGIT_WORD = "(?:" + "|".join(sorted(DIGIT_OF, key=lambda w: (-len(w), w))) + ")"
SPELLED_RUN = re.compile(rf"(?<![^\W\d_]){_DIGIT_WORD}(?:[ ,.-]{{1,2}}{_DIGIT_WORD}){{2,}}(?![^\W\d_])", re.IGNORECASE)
DIGIT_WORDS, RUN_OF_LETTERS = frozenset(DIGIT_OF), re.compile(r"[^\W\d_]+")
SPELLED_WORD = re.compile(_DIGIT_WORD, re.IGNORECASE)
PLUS_BEFORE = re.compile(r"\b(plus|más|mas)[ ]+$", re.IGNORECASE)


def _octets() -> dict[str, str]:
    """0 to 255 as said in the four languages, with single spaces for hyphens."""
    teens = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    english = SPELLED[0] + teens + [f"{t} {u}".replace(" zero", "") for t in tens for u in SPELLED[0]]
    teens = "zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
    tens = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
    german = SPELLED[1] + teens + [f"{u}und{t}" if u else t for t in tens for u in ["", "ein", *SPELLED[1][2:]]]
    teens = "dix,onze,douze,treize,quatorze,quinze,seize,dix sept,dix huit,dix neuf".split(",")
    tens = [(t, SPELLED[2]) for t in "vingt trente quarante cinquante".split()] + [("soixante", SPELLED[2] + teens), ("quatre vingt", SPELLED[2] + teens)]
    french = SPELLED[2] + teens + [f"{t} {'et ' if u in ('un', 'onze') and t != 'quatre vingt' else ''}{u}".replace(" zéro", "") for t, units in tens for u in units]
    teens = "diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve".split()
    twenties = "veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split()
    tens = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
    spanish = SPELLED[3] + teens + twenties + [f"{t} y {u}".replace(" y cero", "") for t in tens for u in SPELLED[3]]
    names = {x: str(i) for under in (english, german, french, spanish) for i, x in enumerate(under)} | {"quatre vingts": "80", "null": "0"}
    hundreds = [(english, 1, ["hundred", "a hundred", "one hundred"], [" ", " and "]), (english, 2, ["two hundred"], [" ", " and "])]
    hundreds += [(german, 1, ["hundert", "einhundert"], ["", "und"]), (german, 2, ["zweihundert"], ["", "und"])]
    hundreds += [(french, 1, ["cent"], [" "]), (french, 2, ["deux cent", "deux cents"], [" "]), (spanish, 1, ["ciento", "cien"], [" "]), (spanish, 2, ["doscientos"], [" "])]
    for under, n, heads, links in hundreds:
        names |= {head: str(100 * n) for head in heads}
        names |= {f"{head}{link}{x}": str(100 * n + i) for head in heads for link in links for i, x in enumerate(under) if i and 100 * n + i < 256}
    plain = str.maketrans("áéóúßüö", "aeousuo")
    return names | {x.translate(plain): n for x, n in names.items()} | {x.replace("ß", "ss"): n for x, n in names.items()}


OCTETS = _octets()
MOST_OCTET_WORDS = max(3, *(len(x.split()) for x in OCTETS))
MOST_OCTET_CHARS = max(map(len, OCTETS)) + 2 * MOST_OCTET_WORDS
#: What can stand between two octets: a dot, in brackets or spelled.
OCTET_DOT = re.compile(r"[ ]{1,2}(?:dot|punkt|punto|point)[ ]{1,2}|[ ]{0,2}[(\[{<][ ]?(?:dot|punkt|punto|point|\.)[ ]?[)\]}>][ ]{0,2}|\.", re.IGNORECASE)
OCTET_WORD = re.compile(r"[^\W_]+")
_AT, _DOT = r"(?:at|arroba|arobase|@)", r"(?:dot|punkt|punto|point|\.)"
BRACKETED = re.compile(rf"[ ]{{0,2}}(?:\([ ]?(?:(?P<a>{_AT})|{_DOT})[ ]?\)|\[[ ]?(?:(?P<b>{_AT})|{_DOT})[ ]?\]|\{{[ ]?(?:(?P<c>{_AT})|{_DOT})[ ]?\}}|<[ ]?(?:(?P<d>{_AT})|{_DOT})[ ]?>)[ ]{{0,2}}", re.IGNORECASE)
#: What words before a spelled at and a host with plain dots make it prose ('look at example.com'); a local part with a digit or sign is none.
PROSE_BEFORE_AT = frozenset(
    "a about access account also am an and apply are article articles as available back be been blog book books browse buy by call check click code company contact content course data details directly download "
    "email emails everything file files find first for found free from get go had has have he help her here hers him his home hosted i images in info information is it items join just live located look looked looking looks "
    "mail maintained me meet meeting message more my new news not now of offered official on one online only or order original originally our ours out over page pages photos posted posts price product products published purchase "
    "read register registered research resources review sale see seen sell service services she shop shopping sign site sold source starts stay stop store stories story that the their them there these they this those tickets "
    "time to today try up updates us use version video videos view visit was we website were what while who with work worked working works write you your yours".split()
)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_PLAIN_AT = r"(?:(?<=[A-Za-z0-9])[ ]{1,2}(?:at|arroba|arobase)[ ]{1,2})"
#: at and a dot in words, or a spelled at and plain dots; the address is matched from its at on. Words of one language go
#: together, others only before an ending that is no word.
_ENDING = "(?:com|org|net|edu|gov|info|biz|io|de|fr|es|eu|uk|ch|mx|nl|pl|ru|cat|app|dev)"
_PAIRS = [("at", "dot", "[A-Za-z]{2,24}"), ("at", "punkt", "[A-Za-z]{2,24}"), ("arroba", "punto", "[A-Za-z]{2,24}"), ("arobase", "point", "[A-Za-z]{2,24}"), ("(?:at|arroba|arobase)", "(?:dot|punkt|punto|point)", _ENDING)]
SPELLED_TAIL = re.compile("|".join(rf"(?<=[A-Za-z0-9])(?:[ ]{{1,2}}{at}[ ]{{1,2}}|@){_LABEL}(?:(?:[ ]{{1,2}}{dot}[ ]{{1,2}}|\.){_LABEL}){{0,8}}[ ]{{1,2}}{dot}[ ]{{1,2}}{last}(?![A-Za-z0-9-])" for at, dot, last in _PAIRS), re.IGNORECASE)
PLAIN_TAIL = re.compile(rf"{_PLAIN_AT}(?!www\.){_LABEL}(?:(?:[ ]{{1,2}}(?:dot|punkt|punto|point)[ ]{{1,2}}|\.){_LABEL}){{0,8}}\.[A-Za-z]{{2,24}}(?![A-Za-z0-9/:-])", re.IGNORECASE)
PLAIN_TAIL_AT = re.compile(rf"(?<=[A-Za-z0-9])@{_LABEL}(?:\.{_LABEL}){{1,8}}(?![A-Za-z0-9-])")
#: A spelled dot and the word before it, read backwards from an at.
LOCAL_DOT = re.compile(r"([A-Za-z0-9._%+-]+)([ ]{1,2}(?:dot|punkt|punto|point)[ ]{1,2})$", re.IGNORECASE)
LAST_WORD = re.compile(r"[A-Za-z0-9._%+-]+$")
MOST_LOCAL = 64
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])[ ]{1,2}@[ ]{0,2}(?=[A-Za-z0-9-]+\.[A-Za-z]{2,})|(?<=[A-Za-z0-9])@[ ]{1,2}(?=[A-Za-z0-9-]+\.[A-Za-z]{2,})")
DOTS_IN_IP = re.compile(r"(?<=[0-9])[ ]{1,2}dot[ ]{1,2}(?=[0-9])", re.IGNORECASE)
_WORD_AT = re.compile(r"[ ]{1,2}(at|arroba|arobase)[ ]{1,2}", re.IGNORECASE)
_WORD_DOT = re.compile(r"[ ]{1,2}(?:dot|punkt|punto|point)[ ]{1,2}", re.IGNORECASE)

#: (start, end, what is written there); an edit of several characters names the stretch of each.
Edit = tuple[int, int, list[tuple[str, int, int]]]


# Each transducer first looks, by a quick test that holds for every text it would edit, whether it has anything to do.


def _fold(text: str) -> Iterator[Edit]:
    if text.isascii() or FOLDED_CHARS.isdisjoint(text):
        return
    for m in FOLDED.finditer(text):
        yield m.start(), m.end(), [(FOLDINGS[m[0]], *m.span())]


def _digit_letters(text: str) -> Iterator[Edit]:
    if not DIGITS.search(text):
        return
    for m in DIGIT_LIKE.finditer(text):
        yield m.start(), m.end(), [(c.translate(AS_DIGITS), m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0])]


def _octet(words: list[re.Match]) -> str | None:
    """The number that the words, one to three digits or spelled digits or a spelled number, say if it is an octet's."""
    said = [w[0].lower() for w in words]
    digits = "".join(DIGIT_OF.get(w, w) for w in said)
    if digits.isascii() and digits.isdigit() and len(digits) <= 3:
        return digits if int(digits) <= 255 else None
    return OCTETS.get(" ".join(said))


def _beside(text: str, start: int, stop: int, forward: bool) -> tuple[int, int, str] | None:
    """The longest octet that starts at start, or ends at stop; words of it are parted by one or two of ' ,-'."""
    words = list(OCTET_WORD.finditer(text, start, stop))
    words = words if forward else words[::-1]
    if not words or (words[0].start() != start if forward else words[0].end() != stop):
        return None
    best, chain = None, []
    for w in words[: MOST_OCTET_WORDS + 1]:
        if chain:
            gap = text[chain[-1].end() : w.start()] if forward else text[w.end() : chain[-1].start()]
            if not 1 <= len(gap) <= 2 or gap.strip(" ,-"):
                break
        chain.append(w)
        own = chain if forward else chain[::-1]
        n = _octet(own)
        if n is not None:
            best = own[0].start(), own[-1].end(), n
    return best


def _spelled_octets(text: str) -> Iterator[Edit]:
    """Four octets, some of them spelled, with dots between them; a longer row, or one with plain dots behind a plus, is no address."""
    dots = list(OCTET_DOT.finditer(text))
    if len(dots) < 3:
        return
    between = []
    for x, y in zip(dots, dots[1:]):
        inner = _beside(text, x.end(), y.start(), True) if 0 < y.start() - x.end() <= MOST_OCTET_CHARS and text[x.end()].isalnum() else None
        between.append(inner if inner and inner[1] == y.start() else None)
    at = 0
    while at < len(between):
        if between[at] is None:
            at += 1
            continue
        last = at
        while last < len(between) and between[last] is not None:
            last += 1
        left = _beside(text, max(0, dots[at - 1].end() if at else 0, dots[at].start() - MOST_OCTET_CHARS), dots[at].start(), False)
        right = _beside(text, dots[last].end(), min(len(text), dots[last].end() + MOST_OCTET_CHARS, dots[last + 1].start() if last + 1 < len(dots) else len(text)), True)
        octets = [x for x in (left, *between[at:last], right) if x]
        a_phone = left and (text[left[0] - 1 : left[0]] == "+" or PLUS_BEFORE.search(text, max(0, left[0] - 8), left[0])) and all(d[0] == "." for d in dots[at : last + 1])
        if len(octets) == 4 and not a_phone and not all(text[s:e] == n for s, e, n in octets):
            for i, (s, e, n) in enumerate(octets):
                if i:
                    yield octets[i - 1][1], s, [(".", octets[i - 1][1], s)]
                yield s, e, [(n, s, e)]
        at = last


def _spelled_digits(text: str) -> Iterator[Edit]:
    if DIGIT_WORDS.isdisjoint(RUN_OF_LETTERS.findall(text.lower())):
        return
    for m in SPELLED_RUN.finditer(text):
        found = [(DIGIT_OF[w[0].lower()], *w.span()) for w in SPELLED_WORD.finditer(text, m.start(), m.end())]
        plus = PLUS_BEFORE.search(text, max(0, m.start() - 8), m.start())
        if plus:
            found.insert(0, ("+", *plus.span(1)))
        yield (plus.start() if plus else m.start()), m.end(), found


def _at_and_dot(text: str) -> Iterator[Edit]:
    found: list[Edit] = []
    for m in BRACKETED.finditer(text) if any(c in text for c in "([{<") else ():
        if m.start() and m.end() < len(text) and text[m.start() - 1].isalnum() and text[m.end()].isalnum():
            found.append((m.start(), m.end(), [("@" if m.lastgroup else ".", *m.span())]))
    for m in (*(SPACED_AT.finditer(text) if "@" in text else ()), *(DOTS_IN_IP.finditer(text) if DIGITS.search(text) else ())):
        found.append((m.start(), m.end(), [("@" if "@" in m[0] else ".", *m.span())]))
    end = -1
    for start, stop, what in sorted(found):
        if start >= end:
            yield start, stop, what
            end = stop


def _local_dots(text: str, at: int, least: int) -> list[Edit]:
    """The spelled dots of the local part that ends before at, none before least."""
    low = max(least, at - 3 * MOST_LOCAL)
    word = LAST_WORD.search(text, low, at)
    dots: list[Edit] = []
    while word:
        m = LOCAL_DOT.search(text, low, word.start())
        if not m:
            break
        dots.append((*m.span(2), [(".", *m.span(2))]))
        word = m
    return dots[::-1]


def _spelled_addresses(text: str) -> Iterator[Edit]:
    low = text.lower()
    dotted, atted = any(w in low for w in (" dot ", " punkt ", " punto ", " point ")), any(w in low for w in (" at ", " arroba ", " arobase "))
    found = [(m, False) for m in SPELLED_TAIL.finditer(text)] if dotted else []
    found += [(m, True) for m in PLAIN_TAIL.finditer(text)] if atted and "." in text else []
    found += [(m, False) for m in PLAIN_TAIL_AT.finditer(text)] if dotted and "@" in text else []
    end = 0
    for m, plain in sorted(found, key=lambda x: (x[0].start(), -x[0].end())):
        if m.start() < end:
            continue
        before = _local_dots(text, m.start(), end)
        if plain and not before:
            word = LAST_WORD.search(text, max(end, m.start() - MOST_LOCAL), m.start())
            ending = m[0].rpartition(".")[2]
            if word is None or word[0].lower() in PROSE_BEFORE_AT or not (ending.islower() or ending.isupper()):
                continue
        yield from before
        at = _WORD_AT.match(text, m.start(), m.end())
        if at:
            yield at.start(), at.end(), [("@", *at.span())]
        yield from ((x.start(), x.end(), [(".", *x.span())]) for x in _WORD_DOT.finditer(text, m.start(), m.end()))
        end = m.end()


TRANSDUCERS: tuple[Callable[[str], Iterator[Edit]], ...] = (_fold, _digit_letters, _spelled_octets, _spelled_digits, _at_and_dot, _spelled_addresses)


def transduce(text: str, starts: list[int] | range, ends: list[int] | range, edits: list[Edit]) -> tuple[str, list[int], list[int]]:
    """The edited text, with the stretch of the source behind each of its characters."""
    parts, s_out, e_out, at = [], [], [], 0
    for start, end, written in [*edits, (len(text), len(text), [])]:
        parts.append(text[at:start])
        s_out.extend(starts[at:start])
        e_out.extend(ends[at:start])
        for chars, a, b in written:
            parts.append(chars)
            s_out.extend([starts[a]] * len(chars))
            e_out.extend([ends[b - 1]] * len(chars))
        at = end
    return "".join(parts), s_out, e_out


def normalise(text: str) -> tuple[str, list[int] | range, list[int] | range]:
    """The text after all transducers, and for each character where it starts and ends in the source."""
    starts, ends = range(len(text)), range(1, len(text) + 1)
    for transducer in TRANSDUCERS:
        edits = list(transducer(text))
        if edits:
            text, starts, ends = transduce(text, starts, ends, edits)
    return text, starts, ends


def _finds(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the whole finds in the normalised text that lie inside no base span nor earlier find of their kind; both by start."""
    base = detect(text)
    plain, starts, ends = normalise(text)
    if plain == text:
        return base, []
    wide, reached, at = [], dict.fromkeys(KINDS, 0), 0
    for s, e, kind in detect(plain):
        a, b = starts[s], ends[e - 1]
        while at < len(base) and base[at][0] <= a:
            reached[base[at][2]] = max(reached[base[at][2]], base[at][1])
            at += 1
        if b > reached[kind]:
            wide.append((a, b, kind))
            reached[kind] = b
    return base, wide


def find_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans of a whole text, and as added spans the stretches of the disguised finds that no span before covers."""
    if not text:
        return [], []
    base, wide = _finds(text)
    added, done, at = [], 0, 0
    for a, b, kind in wide:
        a = max(a, done)
        while at < len(base) and base[at][1] <= a:
            at += 1
        k = at
        while a < b and k < len(base) and base[k][0] < b:
            if a < base[k][0]:
                added.append((a, base[k][0], kind))
            a = max(a, base[k][1])
            k += 1
        if a < b:
            added.append((a, b, kind))
        done = max(done, b)
    return base, added


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


SPANS = "base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>"


def _finder(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    shown = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
    for texts in batches:
        found = [find_spans(t) for t in texts]
        yield pd.DataFrame({"base": [shown(b) for b, _ in found], "added": [shown(a) for _, a in found]})


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end) of every row."""
    found = prepare(docs).select(F.col(id_col).alias("doc_id"), F.pandas_udf(_finder, SPANS)(F.col(text_col)).alias("p"))
    return found.select("doc_id", "p.base", "p.added")


def redacted(text: str | None) -> str | None:
    """text with each stretch of overlapping base spans and disguised finds replaced by the kind of the first, as in [EMAIL]."""
    if not text:
        return text
    base, wide = _finds(text)
    out, at, merged = [], 0, []
    for s, e, k in sorted(base + wide, key=lambda x: (x[0], KINDS.index(x[2]))):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:] if merged else text


def _redactor(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([redacted(t) for t in texts], dtype="object")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data replaced in the text, and the length column brought up to date if there is one."""
    out = prepare(docs).withColumn(text_col, F.pandas_udf(_redactor, "string")(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(docs.columns)
