"""Personal information in free text: finding it and replacing it by placeholders.

Items with a shape (email addresses, phone and identity numbers, street addresses)
are found by their form and by the words before them. Names have no shape; there
the corpus tells how strongly a term reveals a person. For every word it is
counted how often it occurs, how often after a known given name, before a known
family name, in a name in front of an initial, and in lower case; its disclosure
is the share of its occurrences in such places. Words above LEARN are name parts
though the lexicon lacks them, and lexicon words below WEAK (met 20 times at least) are ordinary words
that name a person only beside a strong part. Street names are learned alike, from
addresses in capitals, so that they are known in lower case.

A term that is left outside any found item but discloses a person above REMOVE is
generalised to ``[NAME]`` in the sanitised text. All counts are taken over all
rows. Null texts hold nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .literals import Screen, beginnings, folded

TYPES = ("email", "phone", "identity_number", "street_address", "person_name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[PERSON]"}
LEARN, WEAK, REMOVE = 0.25, 0.25, 0.5
#: Learned terms up to this number are handed to the workers; more are joined to the texts by word.
TERMS = 300_000

_AT = r"(?:\s?@\s?|＠|&#64;|%40|\s?[(\[{<]\s?(?:at|AT|arroba|@)\s?[)\]}>]\s?)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|punto|punkt|point|\.)\s?[)\]}>]\s?|\s(?:dot|DOT)\s)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL = re.compile(
    rf"(?<![\w.+-])[A-Za-z0-9](?:[\w.+'-]*\w)?{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w/])"
    rf"|(?<![\w.+-])[A-Za-z0-9][\w.+-]*\sat\s{_LABEL}(?:(?:\sdot\s|\s?[(\[]dot[)\]]\s?){_LABEL})+"
    rf"|(?<![\w.+-])[A-Za-z0-9]+[\d._+-][\w.+-]*\sat\s{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?!\w)",
    re.I,
)

_ID_CUE = r"(?:social\s+security(?:\s+(?:number|no\.?))?|ssn|sozial(?:versicherungs)?nummer|national\s+(?:id|identity|insurance)\w*(?:\s+(?:number|card))?|(?:identity|id|identification)\s+(?:card|document|number|no\.?)(?:\s+(?:number|no\.?))?|id\s?-?card|passport|passeport|pasaporte|reisepass|pass(?:nummer|nr\.?)|personalausweis\w*|ausweis\w*|driv(?:er['’]?s|ing)\s+licen[cs]e|führerschein\w*|permis\s+de\s+conduire|permiso\s+de\s+conducir|carn[eé]t?\s+de\s+conducir|tax\s+(?:id|number|no\.?|identification\s+number)|steuer(?:nummer|-?id\w*|identifikationsnummer)|numéro\s+(?:fiscal|de\s+sécurité\s+sociale)|sécurité\s+sociale|seguridad\s+social|número\s+fiscal|dni|nie|nif|cif|curp|documento\s+(?:nacional\s+)?de\s+identidad|carte\s+(?:nationale\s+)?d['’]identité|pièce\s+d['’]identité|cédula\w*|residence\s+permit|aufenthaltstitel|(?:id|identity)\s+card\s+number|card\s+number)"
_ID = re.compile(rf"\b{_ID_CUE}(?:\s+(?:number|no|nr|nummer|numéro|número|num|n[°º])\b\.?)?\s*(?:is|ist|es|est|lautet|was|:|=|-|#|\(|no\.?|nr\.?|n[°º])?\s*[:=#]?\s*((?=[A-Z0-9./\s-]*\d[A-Z0-9./\s-]*\d)[A-Z0-9]{{1,12}}(?:[-./ ]?[A-Z0-9]{{1,12}}){{0,5}})", re.I)
#: Shapes that stand for themselves.
_ID_SHAPE = re.compile(r"(?<![\w/-])[XYZ]-?\d{7}-?[A-Z](?![\w-])|(?<![\w/.-])\d{8}-?[A-HJ-NP-TV-Z](?![\w-])|(?<![\w-])[A-Z]{5}\d{6}[A-Z0-9]{2,5}(?!\w)|(?<![\w-])[A-Z]{4}\d{6}[A-Z]\d(?!\w)")

_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|double)"
_SPELLED = re.compile(rf"\b{_DIGIT}(?:[\s,.-]+{_DIGIT}){{6,}}\b", re.I)
_NUMBER = re.compile(r"(?<![\w./#-])(?:\+\s?\d|\(\+?\d|\d)[\d\s()./‐-―-]{5,24}\d(?:\s?(?:ext\.?|x|Durchwahl)\s?\d{1,5})?(?![\w-]|[./]\d)", re.I)
_PHONE_CUE = re.compile(r"(?:phone|tel(?:efon\w*|éfono|éphone)?|mobile?|cell|handy|móvil|portable|fax|call|ring|dial|text|sms|whatsapp|number\s+is|numéro\s+est|número\s+es|nummer\s+(?:ist|lautet)|reach(?:ed)?(?:\s+me)?\s+(?:at|on)|erreichbar|unter|rückruf\w*(?:\s+bitte)?|anrufen|llám\w+|llam\w+|appel\w+|joign\w+|joindre|contact(?:o|ez)?)\b[^.\d\n]{0,22}$", re.I)
_NO_PHONE = re.compile(r"(?:order|orders|bestell\w*|auftrag\w*|pedido|commande|invoice|rechnung\w*|factura|facture|tracking(?:\s+(?:number|no\.?|code))?|parcel|paket\w*|shipment|sendung\w*|request|req|ticket|case|version|release|build(?:\s+of)?|ref(?:erence)?|article|sku|serial|account|iban|konto\w*|transaction|batch|lot|affects|ip|id|code|item|part|port|model|build\s+of|lists?)(?:\s+(?:id|number|no\.?|nr\.?|is|of|#))*[\s:#=]*$", re.I)
_PHONE_SHAPE = re.compile(r"^(?:\+.*|\(\d{2,5}\)\s?\d.*|\d{3}-\d{3}-\d{4}|\d-\d{3}-\d{3}-\d{4}.*|0\d{4} \d{6}|0\d{2,4}[/ -]\d{5,8}(?:-\d{1,4})?|\d{3}/\d{5}-\d{3}|0\d(?:[ .]\d\d){4}|00\d.*)$")

_TYPE = r"(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|crescent|cres|terrace|close|way|boulevard|blvd|court|ct|place|pl|square|sq|row|walk|mews|parade|gardens|highway|hwy|parkway|circle)"
_NO = r"\d{1,5}\s?[a-zA-Z]?(?:[-/]\d{1,4})?"
_CAP = r"[A-ZÄÖÜÉÈÀÁÍÓÚÑ][\w'’.-]*"
_EN_1 = re.compile(rf"(?<![\w.,/-])\d{{1,5}}[a-z]?,?\s((?:{_CAP}\s){{1,4}})(?:{_TYPE})\b\.?", re.I)
_EN_2 = re.compile(rf"\b(?:{_TYPE})\b\.?,?\s(?:no\.?\s|nr\.?\s|#)?\d{{1,5}}[a-z]?(?![\w%:]|[.,]\d)", re.I)
#: German addresses and English ones with the number behind are found from the kind of street on, and extended to the left.
_DE = re.compile(rf"(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|steig|graben|chaussee|promenade)\s(?:nr\.?\s)?{_NO}(?![\w%]|[.,]\d)", re.I)
_LEFT_DE = re.compile(r"(?:[A-ZÄÖÜ][\w-]*[ -]){0,2}[\w-]*$")
_LEFT_EN = re.compile(r"(?:[\w'’-]+\s){1,3}$")
_FR = re.compile(r"\b\d{1,4}\s?(?:bis|ter|quater|[a-d])?,?\s(?:rue|avenue|av\.|boulevard|bd|chemin|impasse|place|allée|quai|cours|route|passage|square|sentier|ruelle|faubourg)\s(?:(?:de|du|des|de\sla|de\sl['’]|d['’]|le|la|les)\s?)*[\w'’-]+(?:[\s-][A-ZÉÈ][\w'’-]+)*|\b(?:rue|boulevard|chemin|impasse|allée|quai|ruelle)\s(?:(?:de|du|des|de\sla|de\sl['’]|d['’]|le|la|les)\s?)*[\w'’-]+(?:[\s-][A-ZÉÈ][\w'’-]+)*,?\s(?:n[°º]\s?)?\d{1,4}(?![\w%]|[.,]\d)", re.I)
_ES = re.compile(r"(?:\b(?:calle|avenida|avda\.?|av\.|paseo|plaza|camino|carrera|ronda|travesía|callejón|vía)|\bc/)\s?(?:(?:de|del|de\sla|de\slos|de\slas|la|el|los|las)\s)*[\w'’-]+(?:\s(?:de\s|del\s|de\slas?\s|de\slos\s)?[\w'’-]+){0,3}?,?\s(?:n\.?[°º]?\s?|núm\.?\s)?\d{1,4}(?:,?\s?\d{1,2}\.?[ºª°](?:\s?[A-Z])?)?(?![\w%]|[.,]\d)", re.I)
#: Words that never stand in the name of a street; "way", "close" and "drive" are ordinary words, too.
_ORDINARY = frozenset("a an the on in of to and or for is are was were be it its this that these those with by at as from only no not our your their my we you they he she i than then when where which who how all any each every more most some such same other another percent days hours minutes seconds agents rows entries times more after before until about messages use find keep make take go come be das der die und".split())

#: The expressions above are tried only on texts that hold what every match of them holds: these
#: signs of an address at some host, cues (which begin words), kinds of streets (which are words), stems.
_ANY_DIGIT, _SIX = re.compile(r"\d"), re.compile(r"\d{6}")
_MAILISH = re.compile(r"[@＠]|&#64;|%40|[(\[{<]\s?(?:at|arroba)\s?[)\]}>]|\sat\s[a-z0-9-]+(?:\.|\sdot\s|\s?[(\[]dot[)\]])", re.I)
_CUES = beginnings(_ID)
_STEMS = Screen({"es": _ES})
_DE_STEMS = beginnings(_DE)
#: Words that are known to begin with no cue; forgotten when they have become many.
_PLAIN: set[str] = set()


def _mailish(text: str, own: set) -> bool:
    """Whether there may be an address: its sign, or one spelled as a word of its own."""
    if "@" in text:
        return True
    if "at" in own or "arroba" in own or "&" in text or "%" in text or not text.isascii():
        return _MAILISH.search(text) is not None
    return False


def _cued(own: set) -> list[str]:
    """The words that begin with a cue."""
    rest = own - _PLAIN
    if not rest:
        return []
    cued = [w for w in rest if w.startswith(_CUES)]
    if len(_PLAIN) > 300_000:
        _PLAIN.clear()
    _PLAIN.update(rest.difference(cued))
    return cued


def _from(expression: re.Pattern, text: str, low: str, words) -> list[re.Match]:
    """What finditer gives, for an expression all of whose matches begin with one of these words."""
    found = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            m = expression.match(text, at)
            if m:
                found.append(m)
            at = low.find(w, at + 1)
    found.sort(key=lambda m: m.start())
    out, end = [], -1
    for m in found:
        if m.start() >= end:
            out.append(m)
            end = m.end()
    return out


def _german(text: str, low: str) -> list[tuple[int, int]]:
    """Matches of _DE, all of which begin with a stem."""
    out = []
    for stem in _DE_STEMS:
        at = low.find(stem)
        while at >= 0:
            m = _DE.match(text, at)
            if m:
                out.append(m.span())
            at = low.find(stem, at + 1)
    return out


_FR_WORDS = frozenset("rue avenue av boulevard bd chemin impasse place allée quai cours route passage square sentier ruelle faubourg".split())
_EN_WORDS = frozenset(_TYPE[3:-1].split("|"))
_DIGITS = frozenset(("zero", "oh", "double", "un", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "zéro", "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf"))
_SIMPLE = re.compile(r"[^\W\d_]+")
_INITIAL = re.compile(r" [A-Z]\.")
_CUT = re.compile(r"\b([^\W\d_]{3,}(?:-[^\W\d_]+)?) [A-Z]\.")
_PART = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def _folded(word: str) -> str:
    return word.lower()


class Knowledge:
    """Strong and weak parts of names, and words of street names."""

    def __init__(self, given=(), family=(), weak=(), streets=(), ordinary=()):
        self.given, self.family, self.weak, self.streets, self.ordinary = (frozenset(x) for x in (given, family, weak, streets, ordinary))
        #: Every name has a strong part, so a text without any of these holds none.
        self.strong = (self.given | self.family) - self.weak
        self._known: dict[str, tuple[bool, bool, bool]] = {}

    def kinds(self, word: str) -> tuple[bool, bool, bool]:
        """Whether the word may be a given name, may be a family name, and is strong."""
        low = _folded(word)
        known = self._known.get(low)
        if known is None:
            if len(self._known) > 100_000:
                self._known.clear()
            known = self._known[low] = self._kinds(low)
        return known

    def _kinds(self, low: str) -> tuple[bool, bool, bool]:
        parts = low.split("-")
        g, f = (all(p in s for p in parts) for s in (self.given, self.family))
        return g, f, (g or f) and not any(p in self.weak for p in parts)


def _blank(text: str, spans) -> str:
    for a, b in spans:
        text = text[:a] + "\x00" * (b - a) + text[b:]
    return text


def shaped(text: str, streets: frozenset = frozenset(), words: list[str] | None = None) -> list[tuple[int, int, str]]:
    """Spans of emails, identity numbers, phone numbers and street addresses, not overlapping."""
    found: list[tuple[int, int, str]] = []

    def take(new: list[tuple[int, int]], kind: str) -> None:
        nonlocal text
        found.extend((a, b, kind) for a, b in new)
        text = _blank(text, new)

    low = folded(text)
    words = _SIMPLE.findall(low) if words is None else words
    own = set(words)
    if _mailish(text, own):
        take([m.span() for m in _EMAIL.finditer(text)], "email")
    if _ANY_DIGIT.search(text):
        cued = _cued(own)
        if cued:
            take([m.span() for m in _from(_ID, text, low, cued)], "identity_number")
        if _SIX.search(text):
            take([m.span() for m in _ID_SHAPE.finditer(text)], "identity_number")
        take(_addresses(text, low, own, streets), "street_address")
        phones = []
        for m in _NUMBER.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            before = text[max(0, m.start() - 40) : m.start()]
            if not 7 <= digits <= 18 or _NO_PHONE.search(before):
                continue
            shape = m[0].strip()
            if shape.startswith("+") and digits >= 8 or _PHONE_CUE.search(before) or _PHONE_SHAPE.match(shape) and digits >= 9 and not re.match(r"^(?:19|20)\d\d-", shape):
                phones.append(m.span())
        take(phones, "phone")
    if sum(w in _DIGITS for w in words) >= 7:
        take([m.span() for m in _SPELLED.finditer(text)], "phone")
    return found


def _addresses(text: str, low: str, own: set, streets: frozenset) -> list[tuple[int, int]]:
    out = []
    if not own.isdisjoint(_FR_WORDS):
        out += [m.span() for m in _FR.finditer(text)]
    if "es" in _STEMS.names(low):
        out += [m.span() for m in _ES.finditer(text)]
    for a, b in _german(text, low):
        left = _LEFT_DE.search(text, max(0, a - 60), a)
        start = left.start() if left else a
        if a > start:
            out.append((start, b))
    english = not own.isdisjoint(_EN_WORDS)
    for m in _EN_1.finditer(text) if english else ():
        if _street(m[1].split(), streets):
            out.append(m.span())
    for m in _from(_EN_2, text, low, own & _EN_WORDS) if english else ():
        left = _LEFT_EN.search(text, max(0, m.start() - 60), m.start())
        name = left[0].split() if left else []
        # only the words that belong to the name, counted from the kind of street backwards
        while name and (name[0].lower() in _ORDINARY or not (name[0][0].isupper() or name[0].lower() in streets)):
            name = name[1:]
        if name and _street(name, streets):
            out.append((m.start() - len(" ".join(name)) - 1, m.end()))
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, end = [], -1
    for x in out:
        if x[0] >= end:
            kept.append(x)
            end = x[1]
    return kept


def _street(name: list[str], streets: frozenset) -> bool:
    """Whether these words may name a street: in capitals, or known from addresses in capitals."""
    low = [w.lower().strip(".,'’") for w in name]
    return bool(low) and not any(w in _ORDINARY for w in low) and (name[0][0].isupper() or all(w in streets for w in low))


def names(text: str, know: Knowledge, own: list[str] | None = None) -> list[tuple[int, int]]:
    """Spans of given plus family name in a text from which the other items are blanked."""
    if know.strong.isdisjoint(_SIMPLE.findall(text.lower()) if own is None else own):
        return []
    words = [(m.start(), m.end(), m[0]) for m in _PART.finditer(text)]
    kinds = [know.kinds(w) for _, _, w in words]
    out, i = [], 0
    while i < len(words):
        a, b, w = words[i]
        g, f, strong = kinds[i]
        used = 0
        if i + 1 < len(words):
            a2, b2, w2 = words[i + 1]
            g2, f2, strong2 = kinds[i + 1]
            gap = text[b:a2]
            if gap in (" ", " ", "  ", "\n", "\t"):
                if g and f2 and (strong or strong2):
                    used = 2
                elif f and g2 and (strong and strong2):
                    used = 2
                elif g and strong and len(w2) == 1 and w2.isupper():
                    # a middle initial, or the family name cut to its initial
                    dot = text[b2 : b2 + 1] == "."
                    if dot and i + 2 < len(words) and kinds[i + 2][1] and text[b2 : words[i + 2][0]].strip(". ") == "":
                        used = 3
                    elif dot:
                        used, b2 = 2, b2 + 1
                elif g and strong and w2[0].isupper() and len(w2) > 2 and not w2.isupper() and _folded(w2) not in know.ordinary and w[0].isupper() and not f2:
                    used = 2
                elif f2 and strong2 and w[0].isupper() and w2[0].isupper() and len(w) > 2 and not w.isupper() and _folded(w) not in know.ordinary and not g:
                    used = 2
            elif gap in (", ", ","):
                if f and g2 and (strong or strong2) and not (i + 2 < len(words) and kinds[i + 2][1] and text[b2 : words[i + 2][0]] == " "):
                    used = 2
            elif gap in (". ", ".") and len(w) == 1 and w.isupper() and f2 and strong2:
                used = 2
            if used:
                end = b2 if used == 2 else words[i + 2][1]
                out.append((a, end))
                i += used
                continue
        i += 1
    return out


def items(text: str, know: Knowledge) -> list[tuple[int, int, str]]:
    """All items of a text as ``(start, end, type)``, by start."""
    words = _SIMPLE.findall(folded(text))
    found = shaped(text, know.streets, words)
    rest = _blank(text, [(a, b) for a, b, _ in found])
    return sorted(found + [(a, b, "person_name") for a, b in names(rest, know, words)])


def sanitise(text: str | None, know: Knowledge, loose: frozenset = frozenset()) -> str | None:
    """The text with its items, and the ``loose`` terms that disclose a person, replaced by placeholders."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in items(text, know):
        if a < at:
            continue
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    out.append(text[at:])
    joined = "".join(out)
    if not loose:
        return joined
    return _PART.sub(lambda m: "[NAME]" if _folded(m[0]) in loose and joined[m.start() - 1 : m.start()] != "[" else m[0], joined)


def _count(given: frozenset, family: frozenset):
    """Per word: occurrences, in lower case, where a name would stand (as given, as family name), and in the name of a street."""

    known = given | family

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, low, as_given, after, street = Counter(), Counter(), Counter(), Counter(), Counter()
            for text in batch["text"]:
                words = _SIMPLE.findall(text)
                lower = [folded(w) for w in words]
                found = shaped(text, words=lower)
                for a, b, kind in found:
                    if kind == "street_address":
                        # the words in capitals before the kind of street
                        street.update(w.lower() for w in _SIMPLE.findall(text[a:b])[:-1] if w[:1].isupper())
                if found:
                    text = _blank(text, [(a, b) for a, b, _ in found])
                    words = _SIMPLE.findall(text)
                    lower = [w.lower() for w in words]
                n.update(lower)
                low.update(w for w in words if w.islower())
                for m in _CUT.finditer(text) if _INITIAL.search(text) else ():
                    if m[1][0].isupper():
                        as_given.update(m[1].lower().split("-"))
                if known.isdisjoint(lower):
                    continue
                spans = [(m.start(), m.end(), m[0].lower()) for m in _PART.finditer(text)]
                for i, ((a, b, p), (a2, b2, q)) in enumerate(zip(spans, spans[1:])):
                    gap = text[b:a2]
                    if gap == " ":
                        if all(x in given for x in p.split("-")):
                            after[q, p] += 1
                        if q in family:
                            as_given.update(p.split("-"))
                    elif gap == ", ":
                        # "Regards, Given Family" is no family name before a given one
                        third = spans[i + 2] if i + 2 < len(spans) else None
                        if all(x in given for x in q.split("-")) and not (third and text[b2 : third[0]] == " " and text[third[0]].isupper()):
                            after[p, q] += 1
                        if p in family:
                            as_given.update(q.split("-"))
            keys = set(n) | set(street)
            rows = [(k, "", n[k], low[k], as_given[k], 0, street[k]) for k in keys] + [(k, g, 0, 0, 0, c, 0) for (k, g), c in after.items()]
            yield pd.DataFrame(rows, columns=["word", "given", "n", "low", "as_given", "as_family", "street"])

    return run


def learn(texts: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Terms ``(word, kind, disclosure)`` of the corpus: ``given``, ``family`` (learned or
    in the lexicon), ``weak`` (ordinary words of the lexicon), ``street``, ``ordinary``;
    and the lexicon, whose size is fixed."""
    rows = lexicon.select(F.lower("name_part").alias("w"), "part_kind").where("w is not null").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the lexicon is a list of at most 100,000 name parts")
    given = frozenset(r["w"] for r in rows if r["part_kind"] == "given")
    family = frozenset(r["w"] for r in rows if r["part_kind"] == "family")
    counted = texts.select("text").where("text is not null").mapInPandas(_count(given, family), "word string, given string, n bigint, low bigint, as_given bigint, as_family bigint, street bigint")
    pairs = stage(counted.groupBy("word", "given").agg(*(F.sum(c).alias(c) for c in ("n", "low", "as_given", "as_family", "street"))), "pairs")
    sums = [F.sum(c).alias(c) for c in ("n", "low", "as_given", "street")]
    # a word after an ordinary word of the lexicon ("Marlow Pages") is no family name for that
    rough = pairs.groupBy("word").agg(*sums, F.sum("as_family").alias("as_family")).where(F.col("word").isin(list(given | family)))
    weak = [r["word"] for r in rough.where((F.col("n") >= 20) & (F.greatest("as_given", "as_family") < WEAK * F.col("n"))).collect()]  # words of the lexicon
    total = stage(pairs.groupBy("word").agg(*sums, F.sum(F.when(F.col("given").isin(weak), 0).otherwise(F.col("as_family"))).alias("as_family")), "words")
    listed = texts.sparkSession.createDataFrame([(w, True, False) for w in given] + [(w, False, True) for w in family] or [("", False, False)], "word string, g boolean, f boolean").groupBy("word").agg(F.max("g").alias("g"), F.max("f").alias("f"))
    known = total.join(F.broadcast(listed), "word", "left").withColumns({"g": F.coalesce("g", F.lit(False)), "f": F.coalesce("f", F.lit(False)), "share": F.greatest("as_given", "as_family") / F.greatest("n", F.lit(1))})
    shaped_like = F.length("word") >= 3
    new = (F.col("share") >= LEARN) & (F.col("n") >= 2) & (F.col("low") <= 0.2 * F.col("n")) & shaped_like & ~F.col("g") & ~F.col("f")
    terms = known.select(
        "word",
        "share",
        F.array_compact(
            F.array(
                F.when(F.col("g") | (new & (F.col("as_given") >= F.col("as_family"))), "given"),
                F.when(F.col("f") | (new & (F.col("as_family") >= F.col("as_given"))), "family"),
                F.when((F.col("g") | F.col("f")) & (F.col("share") < WEAK) & (F.col("n") >= 20), "weak"),
                F.when((F.col("street") > 0), "street"),
                F.when((F.col("low") >= 0.05 * F.col("n")) & (F.col("low") >= 2) & ~F.col("g") & ~F.col("f") & ~new, "ordinary"),
            )
        ).alias("kinds"),
    ).where(F.size("kinds") > 0)
    return stage(terms, "terms"), {r["w"]: r["part_kind"] for r in rows}


def _knowledge(rows, lexicon: dict[str, str]) -> tuple[Knowledge, frozenset]:
    sets = {k: {r["word"] for r in rows if k in r["kinds"]} for k in ("given", "family", "weak", "street", "ordinary")}
    for w, kind in lexicon.items():
        sets.setdefault(kind, set()).add(w)
    loose = frozenset(r["word"] for r in rows if r["share"] >= REMOVE and ("given" in r["kinds"] or "family" in r["kinds"]))
    return Knowledge(sets["given"], sets["family"], sets["weak"], sets["street"] - _ORDINARY, sets["ordinary"]), loose


def apply(texts: DataFrame, lexicon: DataFrame, clean: bool = False) -> DataFrame:
    """``texts``: source_table, record_id, text. Result: ``source_table, record_id, pii_type, n``
    per type that occurs, or with ``clean`` the texts sanitised: ``source_table, record_id, text``."""
    schema = "source_table string, record_id string, text string" if clean else "source_table string, record_id string, pii_type string, n int"
    columns = [c.split()[0] for c in schema.split(", ")]
    texts = texts.select("source_table", F.col("record_id").cast("string").alias("record_id"), "text")
    terms, listed = learn(texts, lexicon)

    def rows(source, record, text, know, loose):
        if text is None:
            return [(source, record, None)] if clean else []
        if clean:
            return [(source, record, sanitise(text, know, loose))]
        return [(source, record, kind, n) for kind, n in Counter(kind for _, _, kind in items(text, know)).items()]

    if terms.count() <= TERMS:
        know, loose = _knowledge(terms.select("word", "share", "kinds").collect(), listed)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([r for s, i, t in zip(batch["source_table"], batch["record_id"], batch["text"]) for r in rows(s, i, t, know, loose)], columns=columns)

        return texts.mapInPandas(run, schema)

    # too many terms for every worker: each text gets those of its own words
    keyed = stage(texts.withColumn("key", F.xxhash64("source_table", "record_id", "text")), "keyed")
    words = keyed.select("key", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).distinct()
    own = words.join(terms, "word").groupBy("key").agg(F.collect_list(F.struct("word", "share", "kinds")).alias("terms"))

    def run_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for s, i, t, terms_of in zip(batch["source_table"], batch["record_id"], batch["text"], batch["terms"]):
                know, loose = _knowledge([] if terms_of is None else terms_of, listed)
                made += rows(s, i, t, know, loose)
            yield pd.DataFrame(made, columns=columns)

    return keyed.join(own, "key", "left").select("source_table", "record_id", "text", "terms").mapInPandas(run_own, schema)


def texts_of(tickets: DataFrame, messages: DataFrame) -> DataFrame:
    """The descriptions of tickets and the contents of messages."""
    a = tickets.select(F.lit("support_tickets").alias("source_table"), F.col("id").alias("record_id"), F.col("description").alias("text"))
    b = messages.select(F.lit("thread_messages").alias("source_table"), F.col("message_id").alias("record_id"), F.col("content").alias("text"))
    return a.union(b).where("record_id is not null")
