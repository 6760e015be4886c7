"""Personal information in free text (problem 9): detection, typed placeholders, format-preserving Feistel pseudonyms.

Detection is one ordered pass per text: e-mails (disguised ones too), identity numbers, phone numbers, postal addresses,
then person names; what one kind has taken is blanked for the next, so spans never overlap. Names come from two sources:
cue phrases and titles of four languages around one to three name words in any case and order, and a given name of the
supplied list followed by a surname. Every span becomes a typed placeholder <KIND:pseudonym>.

Pseudonyms of numbers and dates are keyed Feistel permutations within their format. A value is first brought to its
canonical form (the digits of a phone number without prefix spelling and punctuation, the characters of an identity
number, the day of a date), permuted inside the domain of its kind, and laid into the writer's own spelling: equal
values stay linked across documents however they are written, different ones never collide. Identity numbers are
validated (check letter, check digits, issued ranges): a valid number becomes another valid one of its kind, an
unverified one is permuted among all of its shape. Detection does not require validity, since mistyped numbers are
personal too. E-mails, names and addresses get a keyed digest of their normalised form, so case and word order do not
break links.

Python is needed for look-around regular expressions; it runs in Arrow batches, one text at a time, no shuffle. A list
of given names within a measured bound travels with the tasks; a larger one is joined to the words of the texts first,
and each text gets the names whose first word it holds. Defined results: NULL text stays NULL and finds nothing; an empty
text stays empty; repeated documents are each treated; texts of any length are read whole; the given-name list may be
empty. Extra columns pass through `redacted` untouched.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Iterable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import BROADCAST_BYTES, is_small

KINDS = ("email", "id_number", "phone", "address", "name")
BLANK = "\0"

# ---------------------------------------------------------------- e-mails
_AT = r"(?:@|＠|&#64;|%40|\s?[\[({<]\s?at\s?[\])}>]\s?|\sAT\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sDOT\s)"
_LOCAL = r"[^\W_](?:[\w.+%'’-]*[\w+-])?"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
EMAIL = re.compile(
    rf"(?<![\w.+@-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,24}}(?![\w@])"
    rf"|(?<![\w.+@-]){_LOCAL}\sat\s{_LABEL}(?:\sdot\s{_LABEL})*\sdot\s[^\W\d_]{{2,24}}(?!\w)"
)


def _may_mail(text: str) -> bool:
    """Whether the text has what every match of EMAIL has: a sign of _AT, one of its words, or the word dot."""
    return "@" in text or "＠" in text or "&#64;" in text or "%40" in text or "AT" in text or "dot" in text or ("at" in text and any(b in text for b in "[({<"))


# ---------------------------------------------------------------- identity numbers
ID = re.compile(
    r"(?<![\w.+-])(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"  # three-two-four
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"  # two letters, six digits, a letter
    r"|\d{8}-?[A-Z]"  # eight digits and a letter
    r"|[XYZ]-?\d{7,8}(?:-?[A-Z])?"  # a letter and seven or eight digits
    r"|[0-4] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}"  # fifteen digits in groups
    r")(?![\w-]|\.\d)"
)
_NOT_ID = re.compile(r"(?i)\b(?:tickets?|orders?|ref\.?|reference no|series|invoices?|rows?|blocks?|case|build)\W+(?:\w+\W+)?$")

# ---------------------------------------------------------------- phone numbers
_EXT = r"(?:,?\s?(?:ext\.?|extn\.?|extension|x|#|Durchwahl|poste|int\.)\s?\d{1,6})?"
PHONE = re.compile(
    r"(?<![\w+.,/:-])(?:"
    r"\+\d{1,3}(?:[ ./-]?\(0\))?(?:[ ./-]?\(?\d{1,5}\)?){2,6}"  # plus and country
    r"|00[1-9]\d{1,2}(?:[ ./-]?\d{2,9}){1,5}"  # international prefix 00
    r"|\([2-9]\d{2}\) ?\d{3}[ .-]\d{4}|[2-9]\d{2}([ .-])\d{3}\1\d{4}"  # ten digits, three-three-four
    r"|\(0\d{1,4}\)(?: ?\d{2,8}){1,4}"  # trunk prefix in brackets
    r"|0\d{1,4}/\d{5,9}"  # trunk prefix and stroke
    r"|0\d([ .-])\d{2}\2\d{2}\2\d{2}\2\d{2}"  # five pairs
    r"|0\d{2,4}[ -]\d{3,4}[ -]?\d{3,5}"  # trunk prefix, two groups
    rf"){_EXT}(?![\w-]|[.,:/]\d)"
)
_NOT_PHONE = re.compile(r"(?i)\b(?:tickets?|orders?|ref\.?|series|rows?|blocks?|build|node|hash|range)\W+(?:\w+\W+)?$")

# ---------------------------------------------------------------- addresses
_CAP = r"[A-ZÀ-ÖØ-ÞŒ][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_TOWN = rf"{_CAP}(?:[ -](?:(?i:am|an der|im|ob|bei|sur|sous|en|de la|de los|del|de|upon|on)[ -])?{_CAP})*"
_STREET = (
    r"(?i:street|st|lane|ln|road|rd|avenue|ave|boulevard|blvd|close|terrace|drive|dr|court|ct|place|pl|square|sq|crescent|way|row|mews|gardens|parade|walk)"
)
_UNIT = r"(?i:unit|flat|suite|apt|apartment|floor|room)\.?\s\w{1,6}"


def _spaced(pattern: str) -> re.Pattern:
    """Any white space between the words of an address, as wrapped and padded texts have it."""
    pattern = pattern.replace(r"\s?", r"\s{0,3}")
    return re.compile(rf"(?<![\w.,-])(?:{re.sub(r'\\s(?!{)', lambda _: r'\s{1,3}', pattern)})")


ADDRESSES = [
    # number, name, kind of street; unit before or after; town and code
    _spaced(rf"(?:{_UNIT},?\s)?\d{{1,5}}[A-Za-z]?\s(?:{_CAP}\s){{1,4}}{_STREET}\b\.?(?:,\s{_UNIT})?(?:,\s{_TOWN}(?:,?\s(?:[A-Z]{{2}}\s)?\d{{4,6}})?)?"),
    # boxes
    _spaced(
        r"(?:(?i:p\.?\s?o\.?\s?box|postfach|bo[iî]te\spostale|apartado(?:\sde\scorreos)?)|BP)"
        rf"\s\d{{1,6}}(?:,\s(?:\d{{4,5}}\s)?{_TOWN}(?:\s\d{{4,6}})?)?"
    ),
    # number first, kind of street, name; code and town
    _spaced(
        r"\d{1,4}(?:\s?(?i:bis|ter|quater))?,?\s(?i:rue|avenue|av\.|quai|impasse|boulevard|bd|place|chemin|all[ée]e|route|cours|passage|square)"
        rf"(?:\s(?i:de\sla|des|du|de|le|la|les))?\s?(?:(?i:de\sl|d|l)['’])?\s?{_CAP}(?:\s{_CAP})*(?:,\s(?:\d{{5}}\s)?{_TOWN})?"
    ),
    # kind of street, name, number, floor; code and town
    _spaced(
        rf"(?i:calle|c/|avda\.?|avenida|plaza|pza\.?|paseo|camino|carretera|ronda)\s?(?:(?i:de\sla|de\slos|de\slas|del|de)\s)?{_CAP}(?:\s{_CAP})*,?\s\d{{1,4}}"
        rf"(?:,\s(?:\d{{1,2}}\s?[ºª°](?:\s?[A-Z]\b)?|(?i:bajo|ático|izq\.?|dcha\.?)))*(?:,\s(?:\d{{5}}\s)?{_TOWN})?"
    ),
    # name of the street with its kind as ending or second word, number; code and town
    _spaced(
        rf"(?:{_CAP}\s(?i:stra(?:ß|ss)e|str\.|weg|allee|platz|ufer|gasse|damm|ring)|[A-ZÄÖÜ][^\W\d_-]*(?i:stra(?:ß|ss)e|str\.|weg|ufer|platz|allee|gasse|damm|ring|chaussee|graben))"
        rf"\s\d{{1,4}}(?:\s?[A-Za-z]\b)?(?:,\s(?:\d{{5}}\s)?{_TOWN})?"
    ),
]

# ---------------------------------------------------------------- names
_TOK = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_INI = r"[^\W\d_]\."
_PART = r"(?:(?:de la|de|von der|von|van der|van den|van|zu|di|da|du|del|della|le|la|ter|af|DE|VON|VAN|De|Von|Van)\s)"
#: Words that stand where names stand but are none: determiners, pronouns, verbs and nouns of the four languages.
_PLAIN = frozenset(
    """the a an one some someone nobody no any every each both all this that these those it he she they we you i who my our your its his her their
    der die das ein eine dem den des kein am im zu und oder man wir sie er es
    el la los las un una unos unas lo se y o le les l une du de des et ou on nous il elle
    desk board team model market street reader anyone everybody analyst analysts traders price spot funding volume open
    by at on in of for from with to if when while as is was are were be been not and or but then than so
    monday tuesday wednesday thursday friday saturday sunday weekend utc""".split()
)
#: Words of firms, funds and clubs in general, and legal forms; a name with one of them is no person's.
_FIRM = frozenset("capital research partners markets data group bank fund holdings labs trading athletic united city rovers ltd inc llc plc gmbh corp club fc & sa ag".split())
_OPENERS = frozenset("signed regards yours thanks contact attn firmado atentamente signé gezeichnet unterzeichnet according laut selon según".split())
_TITLES = (
    r"(?:(?i:mr|mrs|ms|miss|dr|prof|herrn|herr|frau|mme|mlle|monsieur|madame|maître|sr|sra|srta|señora|señor|don|doña)\.?|(?<=[Ss]elon )M\.|(?<=[Pp]our )M\.)"
)
_CUES = (
    r"(?i:ask(?:s|ed|ing)? for|belong(?:s|ed)? to|(?:questions|enquiries|complaints|requests) (?:go )?to|account is under|under the name(?: of)?|quoted by|moderated by|hosted by"
    r"|filed by|written by|signed by|thanks to|thank you|thanks|signed,|regards,|yours,|contact ?:|contact|attention of|attn\.?:?|on behalf of|spoke (?:to|with)|according to"
    r"|rückfragen an|anfragen an|ging an|unterzeichnet,|gezeichnet,|gez\.|laut|zuständig ist|ansprechpartner(?:in)? ist"
    r"|consultas a|preguntas a|dirigirse a|titular|firmado,|firmado por|según|atentamente,"
    r"|adresser à|s'adresser à|questions à|signé,|signé par|selon|titulaire)"
)
_S = r"[^\S\n]"
_TWO = rf"(?:{_TOK}|{_INI})(?:{_S}+{_INI})*,?{_S}+{_PART}?(?:{_TOK}(?!\.\w)|{_INI})"
_CUES = _CUES.replace(" ?:", r"\s*:").replace(" ", r"\s+")
CUED = re.compile(rf"(?<!\w){_CUES}{_S}+(?P<name>{_TWO}|{_PART}?{_TOK})")
TITLED = re.compile(rf"(?<![\w.]){_TITLES}{_S}+(?P<name>(?:{_INI}{_S})?{_PART}?{_TOK}(?:{_S}(?:{_INI}{_S})?{_PART}?{_CAP}(?!\w))?)")
_VERBS = tuple("said says told wrote keeps kept argued argues insisted replied warned vive sagte schrieb führt dit écrit tient dijo escribió lleva mantiene".split())
SPEAKING = re.compile(rf"(?:(?<=^)|(?<=[.!?:;>\"”] )|(?<=\n))(?P<name>{_TWO}|{_PART}?{_TOK})\s(?:{'|'.join(_VERBS)})(?!\w)")
_WORD = re.compile(r"[^\W\d_]+")
_DAY = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?P<sep>[./-])\d{1,2}(?P=sep)\d{4})(?!\d)"
BIRTH = re.compile(rf"(?i)(?<=\b)(?:born(?: on)?|date of birth|dob|geboren(?: am)?|geb\.|né(?:e)? le|nacid[oa] el)\W{{1,3}}(?P<day>{_DAY})")


def _is_name(name: str) -> bool:
    """No word of it is a plain word or belongs to a firm or team."""
    words = [w for w in re.split(r"[\s,]+", name) if w]
    main = words if len(words) == 1 else [w for w in words if not re.fullmatch(_PART, w + " ")]
    return bool(main) and not any(w.lower() in _PLAIN or w.lower() in _FIRM for w in main)


def _tidy(name: str, given: frozenset[str]) -> str:
    """Cut a second word that opens the next clause rather than ends the name."""
    head, comma, tail = re.fullmatch(rf"(.+?)(,?)(?:{_S}+({_PART}?[^\s]+))?", name, re.S).groups()
    if not tail:
        return name
    last = tail.split()[-1]
    if comma:  # "Surname, Given": the second word must look like a name or be a known given name
        keep = last[:1].isupper() or last.lower() in given
    else:
        keep = last[:1].isupper() or not head[:1].isupper()
    return name if keep and _is_name(last) else head


@lru_cache(maxsize=8)
def _first_words(given: frozenset[str]) -> frozenset[str] | None:
    """The first run of letters of every given name, lower-cased from either case: a text with the name has it as a run
    of letters too. None where a name has no letters."""
    found = [_WORD.search(v) for n in given for v in (n, n.upper().lower())]
    return frozenset(m[0] for m in found) if all(found) else None


def _names(text: str, low: str, given: frozenset[str], pattern: re.Pattern | None) -> Iterator[tuple[int, int]]:
    for rule in (CUED, TITLED, SPEAKING):
        for m in rule.finditer(text):
            whole = m["name"]
            found = _tidy(whole, given)
            if rule is SPEAKING and found != whole:
                continue
            if rule is not TITLED and " " not in found and not found[:1].isupper():
                continue
            if len(found.strip(".")) > 1 and _is_name(found):
                yield m.start("name"), m.start("name") + len(found)
    first = _first_words(given)
    known = pattern and (first is None or not first.isdisjoint(_WORD.findall(low)))
    for m in pattern.finditer(text) if known else ():
        if _is_name(m["name"]) and m["name"].split(",")[0].lower() not in _OPENERS:
            yield m.span("name")


def gazetteer(given_names: Iterable[str]) -> tuple[frozenset[str], re.Pattern | None]:
    """Lower-cased given names and the pattern 'Given Surname' or 'Surname, Given' in title or upper case."""
    names = sorted({n.strip() for n in given_names if n and n.strip()}, key=len, reverse=True)
    if not names:
        return frozenset(), None
    title, upper = "|".join(map(re.escape, names)), "|".join(re.escape(n.upper()) for n in names)
    cap = r"(?:[A-ZÀ-Þ]['’])?[A-ZÀ-ÖØ-Þ][^\W\d_]*[a-zß-ÿ](?:[-'’][^\W\d_]+)*"
    caps = r"(?:[A-ZÀ-Þ]['’])?[A-ZÀ-ÖØ-Þ]{4,}(?:[-'’][A-ZÀ-ÖØ-Þ]+)*"
    mid = rf"(?:{_S}+[A-ZÀ-Þ]\.)*{_S}+"
    pattern = (
        rf"(?<![\w.@-])(?P<name>(?:{title}){mid}{_PART}?{cap}|(?:{title}){_S}[A-ZÀ-Þ]\.|(?:{upper}){mid}{_PART}?{caps}"
        rf"|{_PART}?{cap},{_S}+(?:{title})|{_PART}?{caps},{_S}+(?:{upper}))(?!\w)"
    )
    return frozenset(n.lower() for n in names), re.compile(pattern)


def find(text: str | None, given: frozenset[str] = frozenset(), pattern: re.Pattern | None = None) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) in order of appearance; kind `date` for dates of birth."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    rest, low = text, text.lower()

    def take(found: Iterable[tuple[int, int]], kind: str) -> None:
        """Longest first, none over what is taken; blanked in one pass."""
        nonlocal rest
        wanted = sorted(set(found), key=lambda s: (s[0] - s[1], s[0]))
        if not wanted:
            return
        taken, new = bytearray(len(text)), []
        for a, b in wanted:
            if BLANK not in rest[a:b] and 1 not in taken[a:b]:
                taken[a:b] = b"\1" * (b - a)
                new.append((a, b))
        out, at = [], 0
        for a, b in sorted(new):
            spans.append((a, b, kind))
            out += [rest[at:a], BLANK * (b - a)]
            at = b
        rest = "".join([*out, rest[at:]])

    if _may_mail(text):
        take([m.span() for m in EMAIL.finditer(rest)], "email")
    take(((m.start(), m.end()) for m in ID.finditer(rest) if not _NOT_ID.search(rest[max(0, m.start() - 40) : m.start()])), "id_number")
    take(
        (
            (m.start(), m.end())
            for m in PHONE.finditer(rest)
            if 8 <= sum(c.isdigit() for c in m[0]) <= 20 and not _NOT_PHONE.search(rest[max(0, m.start() - 40) : m.start()])
        ),
        "phone",
    )
    take([m.span("day") for m in BIRTH.finditer(rest)], "date")
    for pattern_ in ADDRESSES:
        take([m.span() for m in pattern_.finditer(rest)], "address")
    take(_names(rest, low, given, pattern), "name")
    return sorted(spans)


# ---------------------------------------------------------------- pseudonyms
def _round(key: bytes, tag: str, i: int, half: int, mod: int) -> int:
    return int.from_bytes(hmac.new(key, f"{tag}|{i}|{half}".encode(), hashlib.sha256).digest()[:16], "big") % mod


def feistel(value: int, size: int, key: bytes, tag: str = "", rounds: int = 10) -> int:
    """A keyed permutation of range(size): alternating Feistel on two factors, walking the cycle into range."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    x = value
    while True:
        left, right = divmod(x, b)
        for i in range(rounds):
            if i % 2:
                right = (right + _round(key, tag, i, left, b)) % b
            else:
                left = (left + _round(key, tag, i, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def unfeistel(value: int, size: int, key: bytes, tag: str = "", rounds: int = 10) -> int:
    """The inverse of feistel()."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    x = value
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(rounds)):
            if i % 2:
                right = (right - _round(key, tag, i, left, b)) % b
            else:
                left = (left - _round(key, tag, i, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def _shuffle(value: int, size: int, key: bytes, tag: str, inverse: bool) -> int:
    return (unfeistel if inverse else feistel)(value, size, key, tag)


def _lay(text: str, at: list[int], new: str) -> str:
    """`text` with the characters of `new` at the positions `at`, in the writer's case."""
    out = list(text)
    for i, c in zip(at, new, strict=True):
        out[i] = c.lower() if out[i].islower() else c
    return "".join(out)


#: The two-digit country calling codes; 1 and 7 stand alone, all others have three digits.
_CALLING = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_EXTENSION = re.compile(rf"(?<=\d){_EXT[:-1]}$")


def permute_phone(text: str, key: bytes, inverse: bool = False) -> str:
    """Permute a phone number: country code, trunk prefix and spelling stay, extensions are permuted by themselves.

    The canonical number is what follows the country code (without the (0) of some spellings and the 00 or + before it)
    or the trunk prefix; its first digit stays a nonzero or a zero one."""
    ext = _EXTENSION.search(text)
    main_end = ext.start() if ext else len(text)
    digits = [i for i in range(main_end) if text[i].isdecimal()]
    trunk = re.search(r"\(0\)", text[:main_end])
    abroad = text.lstrip().startswith("+") or text.startswith("00")
    if text.startswith("00"):
        digits = digits[2:]
    if abroad and trunk:
        digits = [i for i in digits if i != trunk.start() + 1]
    code = ""
    if abroad:
        plain = "".join(text[i] for i in digits)
        code = plain[: 1 if plain[:1] in "17" else 2 if plain[:2] in _CALLING else 3]
        digits = digits[len(code) :]
    else:
        while digits and text[digits[0]] == "0":
            digits = digits[1:]
    for part, tag in ((digits, f"phone|{'+' + code if abroad else 'national'}"), ([i for i in range(main_end, len(text)) if text[i].isdecimal()], "extension")):
        if part:
            number, n = int("".join(text[i] for i in part)), len(part)
            low = 10 ** (n - 1) if text[part[0]] != "0" else 0
            size = 9 * low if low else 10 ** (n - 1)
            text = _lay(text, part, str(low + _shuffle(number - low, size, key, f"{tag}|{n}|{low > 0}", inverse)).zfill(n))
    return text


#: The check letters of the number modulo 23, and the letters no prefix of two letters has first, second, or together.
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_NOT_FIRST, _NOT_SECOND, _NOT_PAIR = "DFIQUV", "DFIQUVO", ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PREFIXES = [a + b for a in _ALPHABET for b in _ALPHABET if a not in _NOT_FIRST and b not in _NOT_SECOND and a + b not in _NOT_PAIR]


def _nine(v: str) -> int | None:
    area, group, serial = int(v[:3]), int(v[3:5]), int(v[5:])
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1


def _nine_text(x: int) -> str:
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}{group + 1:02d}{serial + 1:04d}"


#: shape -> (values, number of a valid canonical text or None, text of a number): check letters, check digits, issued ranges.
_VALID = {
    "DDDDDDDDL": (10**8, lambda v: int(v[:8]) if _LETTERS[int(v[:8]) % 23] == v[8] else None, lambda x: f"{x:08d}{_LETTERS[x % 23]}"),
    "LDDDDDDDL": (
        3 * 10**7, lambda v: n if v[0] in "XYZ" and _LETTERS[(n := "XYZ".index(v[0]) * 10**7 + int(v[1:8])) % 23] == v[8] else None,
        lambda x: f"{'XYZ'[x // 10**7]}{x % 10**7:07d}{_LETTERS[x % 23]}",
    ),
    "DDDDDDDDDDDDDDD": (10**13, lambda v: int(v[:13]) if 97 - int(v[:13]) % 97 == int(v[13:]) else None, lambda x: f"{x:013d}{97 - x % 97:02d}"),
    "DDDDDDDDD": (898 * 99 * 9999, _nine, _nine_text),
    "LLDDDDDDL": (
        len(_PREFIXES) * 4 * 10**6, lambda v: (_PREFIXES.index(v[:2]) * 4 + "ABCD".index(v[8])) * 10**6 + int(v[2:8]) if v[:2] in _PREFIXES and v[8] in "ABCD" else None,
        lambda x: f"{_PREFIXES[x // (4 * 10**6)]}{x % 10**6:06d}{'ABCD'[x // 10**6 % 4]}",
    ),
}


def valid_id(text: str) -> bool:
    """Whether an identity number passes its kind's check letter, check digits or issued ranges."""
    v = "".join(c for c in text.upper() if c.isascii() and c.isalnum())
    rule = _VALID.get("".join("D" if c.isdecimal() else "L" for c in v))
    return rule is not None and rule[1](v) is not None


def permute_id(text: str, key: bytes, inverse: bool = False) -> str:
    """Permute an identity number: a valid one among the valid ones of its kind, any other among those of its shape that
    are not valid (by walking on); its punctuation stays."""
    at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    v = "".join(text[i] for i in at).upper()
    shape = "".join("D" if c.isdecimal() else "L" for c in v)
    rule = _VALID.get(shape)
    if rule and (number := rule[1](v)) is not None:
        return _lay(text, at, rule[2](_shuffle(number, rule[0], key, f"id|{shape}", inverse)))
    size, x = 1, 0
    for c, s in zip(v, shape, strict=True):
        radix = 10 if s == "D" else 26
        size, x = size * radix, x * radix + (int(c) if s == "D" else _ALPHABET.index(c))
    while True:
        x = left = _shuffle(x, size, key, f"id?|{shape}", inverse)
        out = ""
        for s in reversed(shape):
            left, k = divmod(left, 10 if s == "D" else 26)
            out = (str(k) if s == "D" else _ALPHABET[k]) + out
        if not rule or rule[1](out) is None:
            return _lay(text, at, out)


_FIRST, _DAYS = date(1900, 1, 1), 73_049  # 1900 to 2099


def permute_date(text: str, key: bytes, inverse: bool = False) -> str:
    """Permute a date (year first, or day before month) inside 1900 to 2099; anything else is returned as it is."""
    part = re.fullmatch(r"(\d{1,4})([./-])(\d{1,2})\2(\d{1,4})", text)
    if not part:
        return text
    a, sep, m, z = part.groups()
    year_first = len(a) == 4
    try:
        day = (date(int(a), int(m), int(z)) if year_first else date(int(z), int(m), int(a))) - _FIRST
    except ValueError:
        return text
    if not 0 <= day.days < _DAYS:
        return text
    new = _FIRST + timedelta(days=_shuffle(day.days, _DAYS, key, "date", inverse))
    return f"{new.year}{sep}{new.month:02d}{sep}{new.day:02d}" if year_first else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year}"


def canonical(kind: str, text: str) -> str:
    """The form under which equal values are linked: digits of a phone, sorted folded words of a name, folded text."""
    if kind == "name":
        return " ".join(sorted(re.findall(r"[^\W_]+", text.casefold())))
    if kind == "email":
        t = re.sub(r"\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s", ".", text.casefold())
        return re.sub(r"＠|&#64;|%40|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s", "@", t)
    return " ".join(text.casefold().split())


_PERMUTE = {"phone": permute_phone, "id_number": permute_id, "date": permute_date}


def placeholder(kind: str, text: str, key: bytes) -> str:
    if kind in _PERMUTE:
        return f"<{kind.upper()}:{_PERMUTE[kind](text, key)}>"
    return f"<{kind.upper()}:{hmac.new(key, f'{kind}|{canonical(kind, text)}'.encode(), hashlib.sha256).hexdigest()[:12]}>"


def redact(text: str | None, spans: list[tuple[int, int, str]], key: bytes) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], placeholder(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]])


_LISTED = "_given"


def with_given_names(documents: DataFrame, given_names: DataFrame, column: str = "given_name", limit: int = BROADCAST_BYTES) -> tuple[DataFrame, list[str] | None]:
    """The documents and the list of given names if its bytes are within `limit`; else the documents with a column of the
    listed names whose first word their text holds, by a join of words, and None."""
    names = given_names.select(column).where(F.col(column).isNotNull()).distinct()
    if is_small(names, limit):
        return documents.withColumn(_LISTED, F.lit(None).cast("array<string>")), sorted(r[0] for r in names.collect())
    letters = r"([\p{L}]+)"
    first = names.select(F.col(column).alias("_name"), F.regexp_extract(F.lower(column), letters, 1).alias("_word")).where("_word <> ''")
    texts = documents.select("text").where("text is not null").distinct().select(F.xxhash64("text").alias("_h"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(letters), F.lit(1)))).alias("_word"))
    held = texts.join(first, "_word").groupBy("_h").agg(F.collect_set("_name").alias(_LISTED))
    return documents.withColumn("_h", F.xxhash64("text")).join(held, "_h", "left").drop("_h"), None


@lru_cache(maxsize=4096)
def _known(names: tuple[str, ...]) -> tuple[frozenset[str], re.Pattern | None]:
    return gazetteer(names)


def _spans(texts: Iterable[str | None], listed: Iterable, names: list[str] | None) -> Iterator[list[tuple[int, int, str]]]:
    for text, own in zip(texts, listed, strict=True):
        given, pattern = _known(tuple(names if names is not None else sorted(own) if own is not None else ()))
        yield find(text, given, pattern)


def findings(documents: DataFrame, given_names: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, kind, found): every distinct piece of personal information of every document."""
    docs, names = with_given_names(documents.select("doc_id", "text").where("text is not null"), given_names, limit=limit)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, text, spans in zip(pdf["doc_id"], pdf["text"], _spans(pdf["text"], pdf[_LISTED], names), strict=True):
                rows += dict.fromkeys((d, kind, text[a:b]) for a, b, kind in spans)
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "found"])

    return docs.select("doc_id", "text", _LISTED).mapInPandas(work, "doc_id bigint, kind string, found string")


def redacted(documents: DataFrame, given_names: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with `text` redacted and `findings` counted; all other columns untouched."""
    if not key:
        raise ValueError("a secret key is needed")
    docs, names = with_given_names(documents, given_names, limit=limit)
    secret = hashlib.sha256(key.encode()).digest()

    @F.pandas_udf("struct<text:string,findings:int>")
    def clean(texts: pd.Series, listed: pd.Series) -> pd.DataFrame:
        spans = list(_spans(texts, listed, names))
        return pd.DataFrame({"text": [redact(t, s, secret) for t, s in zip(texts, spans, strict=True)], "findings": [len(s) for s in spans]})

    out = docs.withColumn("_r", clean("text", _LISTED))
    return out.select(*(F.col("_r.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns), F.col("_r.findings").alias("findings"))
