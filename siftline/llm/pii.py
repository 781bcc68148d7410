"""Personal information in free text: proposal by pattern, confirmation by structure and checksum, score by context.

Every span gets a score: what its form alone is worth, plus what a validator adds (area-code structure, national
check letters and digits), plus or minus what nearby words say (a label before it, or words that mark orders, builds,
versions). Spans at or above ``THRESHOLD`` stay; where two overlap, the earlier kind in ``KINDS`` wins, then the longer.
An identity number's form alone stays under the threshold: a checksum that few other numbers meet carries it over (so does a
label before it, or its place between a name and a phone number in a table), and words for other numbers bring it under again.

Names come from a list of known parts, which may be incomplete. ``learn_parts`` adds parts that stand beside known
ones, counted over all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import spread

KINDS = ("email", "id_number", "phone", "address", "name")
THRESHOLD = 0.5
COUNTED_WORDS = 200_000
MAX_PARTS = 50_000

# Labels of identity numbers: the usual names of such numbers in English, German, French and Spanish.
ID_LABELS = (
    "ssn", "soc. sec", "soc sec", "social security", "national insurance", "ni number", "ni no", "nino", "steuer-id",
    "steuernummer", "steueridentifikationsnummer", "steuer-identifikationsnummer", "tax id", "tax number",
    "taxpayer id", "tin", "nif", "nie", "dni", "documento", "insee", "nir", "sécu", "sécurité sociale",
    "numéro fiscal", "passport", "passeport", "reisepass", "pasaporte", "personalausweis", "ausweisnummer",
    "identity card", "identity number", "national id", "carte d'identité", "sozialversicherungsnummer",
    "seguridad social",
)
# Words directly before a digit run that make it another number; chosen by us.
NO_PHONE = (
    "order", "so-", "version", "build", "part no.", "part no", "isbn", "isbn field", "epoch", "range", "endpoint", "rate",
    "trace", "field", "ticket", "id", "serial", "article", "invoice", "bestellung", "commande", "pedido", "sku", "ref",
)
# Words before a phone number, in the same languages; chosen by us.
PHONE_LABELS = (
    "tel", "phone", "fax", "hotline", "call", "ring", "callback", "mobile", "text", "móvil",
    "rufnummer", "ruf", "telefon", "erreichbar unter", "joignable au", "appelez le", "tél", "llama al", "teléfono",
    "handy", "portable", "contact", "number is",
)
# Street words by language, and words before an address; chosen by us.
STREETS_EN = "street|st|road|rd|lane|ln|avenue|ave|drive|close|court|terrace|way|blvd|boulevard|square|crescent|row|mews|hill|grove|gardens|place|walk|parade"
STREETS_DE = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm", "steig", "markt", "ring", "graben", "chaussee", "promenade")
STREETS_FR = "rue|avenue|av\\.|boulevard|bd|quai|chemin|place|impasse|allée|allee|cours|square|route|passage|faubourg|ruelle|sentier"
STREETS_ES = ("calle ", "c/ ", "avda. ", "avda ", "av. ", "avenida ", "plaza ", "paseo ", "camino ", "carrera ", "ronda ", "travesía ", "glorieta ")
ADDRESS_LABELS = (
    "address", "pickup", "deliver to", "live at", "lives at", "office is at", "street", "office", "moved from", "ship", "visit",
    "adresse", "anschrift", "dirección", "enviar a", "livrer au", "located at",
)
# Given names and surnames that are ordinary English words too; chosen by us.
ORDINARY = frozenset("will mark rose bill grant drew faith page long stone field park price banks may june august hope grace joy art dean king young brown green white black hill wood rich frank pat sue guy jack rob chance chase hunter mason carter parker cook baker bell bush day early fox gold hand house lake lane love mills moon noble pope power rice rivers rush short small snow sparks storm strong summer sweet west winter wise".split())
# Particles of surnames.
PARTICLES = frozenset("von van der den de la las los le du des del della di da dos zu zur zum af al el bin ben ter ten".split())
# Words and signs directly before a name: titles and prepositions; chosen by us.
NAME_CUES = (
    "by", "with", "to", "cc", "dr.", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "mme", "m.", "frau", "herr", "herrn", "sr.", "sra.",
    "von", "thanks,", "owner =", "reviewed-by:", "signed", "signé", "gez.", "firmado:", "contact |", "ask", "says", "as", "in",
    "user", "à", "de", "a", "from:", '"contact": "', "author:", "(",
)

_LOCAL = re.compile(r"[^\W_](?:[\w.+%'’&=-]*[\w+])?(?: dot [\w+-]+)*\s?\Z|[^\W_]\s?\Z")
_DOMAIN = re.compile(r"\s?[^\W_](?:[\w-]*[^\W_])?(?:(?:\.|\s?[\[(]dot[\])]\s?| dot )[^\W_](?:[\w-]*[^\W_])?)+", re.I)
_DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| ?\{dot\} ?| dot )"
_SPELLED = re.compile(
    rf"(?<![\w.+-])[^\W_][\w+%-]*(?:{_DOT}[\w+%-]+)*(?: ?[\[({{] ?at ?[\])}}] ?| at )[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+", re.I
)
_MORE_BEFORE = re.compile(r"(?:\bdot|\.|[\])}]) ?\Z")
_PHONE = re.compile(r"(?<![\w.,/#@&+-])\+?\(?\d[\d ().\-/‐-–\xa0]{5,22}\d(?!\w)")
_SEP = r"[ .\-/‐-–\xa0]?"
_PHONES = tuple(
    re.compile(p + r"(?!\d)")
    for p in (
        rf"(?:\+1|001|1){_SEP}\(?[2-9]\d\d\)?{_SEP}[2-9]\d\d{_SEP}\d\d{_SEP}\d\d",
        rf"\(?[2-9]\d\d\)?{_SEP}[2-9]\d\d{_SEP}\d\d{_SEP}\d\d",
        rf"(?:\+44|0044){_SEP}(?:\(0\)|0)?{_SEP}[1-9](?:{_SEP}\d){{8,9}}",
        rf"\(?0[1-9]\d{{1,4}}\)?{_SEP}\d{{3,4}}{_SEP}\d{{3,4}}",
        rf"(?:\+33|0033){_SEP}(?:\(0\)|0)?{_SEP}[1-9](?:{_SEP}\d\d){{4}}",
        rf"0[1-9](?:{_SEP}\d\d){{4}}",
        rf"(?:\+49|0049){_SEP}(?:\(0\)|0)?{_SEP}[1-9]\d{{1,4}}{_SEP}\d{{3,5}}{_SEP}\d{{2,5}}",
        rf"0[1-9]\d{{1,3}}{_SEP}\d{{3,8}}(?:{_SEP}\d{{1,5}})?",
        rf"(?:\+34|0034){_SEP}[6-9]\d\d(?:{_SEP}\d{{2,3}}){{2,3}}",
        rf"[6-9]\d\d{_SEP}\d{{3}}{_SEP}\d{{3}}",
        rf"\+\d{{1,3}}(?:{_SEP}\(?\d{{1,4}}\)?){{2,5}}",
    )
)
_ID_VALUES = (
    re.compile(r"\d[ ]?\d\d[ ]?\d\d[ ]?\d[\dAB][ ]?\d{3}[ ]?\d{3}(?:[ ]?\d\d)?(?![\w])", re.I),
    re.compile(r"[A-Z]{2}[ -]?\d\d[ -]?\d\d[ -]?\d\d(?:[ -]?[A-D])?(?![\w])", re.I),
    re.compile(r"\d\d[ ./]?\d{3}[ ./]?\d{3}[ ./]?\d{3}(?![\w])"),
    re.compile(r"\d{3}[ -]?\d\d[ -]?\d{4}(?![\w])"),
    re.compile(r"(?:\d\d\.?\d{3}\.?\d{3}|[XYZ][ -]?\d{7})[ .-]?[A-Z](?![\w])", re.I),
    re.compile(r"[A-Z]{1,3}[ -]?\d{6,9}[A-Z]?(?![\w])", re.I),
    re.compile(r"[A-Z0-9](?:[ .-]?[A-Z0-9]){6,17}(?![\w])"),
    re.compile(r"\d(?:[ .-]?\d){6,14}(?![\w])"),
)
_BETWEEN = re.compile(r"[^\d\n]{0,28}(?=\d)")
_PREFIX = re.compile(r"(?<![^\W_])(?:[A-Z]{1,3}[ -]?|[a-z]{1,2}-)\Z")
_ADDRESS_EN = re.compile(
    rf"(?<![\w.,/:#-])\d{{1,5}}\s?[A-Za-z]?(?:\s?-\s?\d{{1,5}}\s?[A-Za-z]?)? (?:[^\W\d_][\w'’.-]* ){{1,3}}?(?:{STREETS_EN})\b(?!\.\w)", re.I
)
_DIGITS_BEFORE = re.compile(r"\s(\d{1,4}(?:\s?-\s?\d{1,4})?(?:\s?[a-zA-Z](?![\w]))?)(?![\w/]|[.,]\d)")
_ADDRESS_FR = re.compile(
    rf"(?<![\w.,/:#-])\d{{1,4}}(?:\s?(?:bis|ter|quater))?,? (?:{STREETS_FR}) (?:(?:de la|de l['’]|de|du|des|d['’]|aux|au|à la|la|le|les)\s?)*"
    r"(?:(?<=['’\s])[^\W\d_][\w'’-]*(?: (?!(?:à|de|en)\b)(?-i:[A-ZÀ-Þ])[\w'’-]*){0,2})",
    re.I,
)
_ADDRESS_ES = re.compile(
    r"(?:de |del |la |las |los |el )*[^\W\d_][\w'’-]*(?: (?:de |del |la |las |los |el )*[^\W\d_][\w'’-]*){0,3}?,? (?:n[º°o.]+ ?|núm\. ?|num\. ?)?\d{1,4}(?:[a-zA-Z](?![\w]))?(?![\w/])", re.I
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+)*")
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return bool(digits) and total % 10 == 0


def id_checksum(value: str) -> bool:
    """True if a national check rule confirms the value: Spanish letter (mod 23), French key (mod 97), German mod 11,10, Luhn."""
    v = re.sub(r"[\W_]", "", value).upper()
    if re.fullmatch(r"\d{8}[A-Z]", v):
        return _DNI[int(v[:8]) % 23] == v[8]
    if re.fullmatch(r"[XYZ]\d{7}[A-Z]", v):
        return _DNI[int(str("XYZ".index(v[0])) + v[1:8]) % 23] == v[8]
    if re.fullmatch(r"\d{15}", v):
        return 97 - int(v[:13]) % 97 == int(v[13:])
    if re.fullmatch(r"\d{11}", v):
        p = 10
        for d in v[:10]:
            s = (int(d) + p) % 10 or 10
            p = 2 * s % 11
        return (11 - p) % 10 == int(v[10])
    return v.isdigit() and luhn(v)


# Forms whose checksum few other numbers meet: Spanish numbers with their letter, French ones with their key, German tax numbers.
_CHECKED = re.compile(
    r"(?<![\w.,/#-])(?:\d{8}[ -]?[A-Z]|\d\d\.\d{3}\.\d{3}[ -]?[A-Z]|[XYZ][ -]?\d{7}[ -]?[A-Z]|[12][ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?\d{3}[ ]?\d{3}[ ]?\d\d|\d\d[ ]\d{3}[ ]\d{3}[ ]\d{3})(?![\w-]|[.,]\d)"
)
FORM, LABELLED, IN_TABLE, OTHER_NUMBER = 0.3, 0.4, 0.3, -0.4


def id_evidence(value: str) -> float:
    """What a value's checksum adds to its score: the more, the fewer other numbers meet it by chance."""
    v = re.sub(r"[\W_]", "", value).upper()
    if not id_checksum(value):
        return 0.0
    if v[-1:].isalpha() or len(v) == 15:  # 1 in 23, 1 in 97
        return 0.3
    if len(v) == 11:  # 1 in 10, and one of the first ten digits stands there two or three times, the others once at most
        times = Counter(v[:10]).values()
        return 0.25 if sorted(times)[-1] in (2, 3) and sum(t > 1 for t in times) == 1 else 0.1
    return 0.1  # Luhn: 1 in 10


class Taken:
    """Stretches of a text that do not overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, s: int, e: int) -> bool:
        return bisect_right(self.ends, s) == bisect_left(self.starts, e)

    def add(self, s: int, e: int) -> None:
        """Adds a stretch, if it is free."""
        if self.free(s, e):
            insort(self.starts, s)
            insort(self.ends, e)


class Finder:
    """Finds the spans of one text. Given and surname parts are lower case."""

    def __init__(self, given: set[str], surnames: set[str]):
        self.given, self.surnames = frozenset(given), frozenset(surnames)
        kinds: dict[str, str] = {p: "n" for p in self.given | self.surnames if len(p) > 1}
        kinds |= {x: "i" for x in ID_LABELS} | {x: "s" for x in STREETS_ES} | {x: "g" for x in STREETS_DE}
        kinds |= {"@": "@", " dot ": "d", "[dot]": "d", "(dot)": "d", "(at)": "d", "[at]": "d"}
        self._auto = ahocorasick.Automaton()
        for word, kind in kinds.items():
            self._auto.add_word(word, (len(word), kind))
        self._auto.make_automaton()

    def _hits(self, low: str) -> Iterator[tuple[int, int, str]]:
        for end, (n, kind) in self._auto.iter(low):
            yield end + 1 - n, end + 1, kind

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Sorted, without overlaps: (start, end, kind)."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        found: list[tuple[int, int, str, float]] = []
        names, spelled = [], []
        for s, e, kind in self._hits(low):
            if kind == "@":
                self._email(text, s, found)
            elif kind == "d":
                spelled.append(s)
            elif kind == "n":
                if (s == 0 or not low[s - 1].isalnum()) and (e == len(low) or not low[e].isalnum()) or s > 1 and low[s - 2 : s] in ("mc", "o'", "d'"):
                    names.append((s, e))
            elif kind == "i":
                if (s == 0 or not low[s - 1].isalnum()) and (e == len(low) or not low[e].isalnum()):
                    self._identity(text, low, e, found)
            elif kind == "s":
                if s == 0 or not low[s - 1].isalnum():
                    self._street_es(text, s, e, found)
            elif kind == "g" and e < len(low):
                self._street_de(text, s, e, found)
        done = 0
        for s in spelled:
            if s >= done:
                for begin, end in self._spelled(text, s):
                    found.append((begin, end, "email", 0.9))
                    done = end
        self._phones(text, low, found)
        self._streets(text, low, found)
        self._checked(text, low, found)
        emails = Taken()
        for s, e, kind, _ in found:
            if kind == "email":
                emails.add(s, e)
        self._names(text, low, [h for h in names if emails.free(h[0], h[0] + 1)], found)
        if "\t" in text:
            self._cells(text, found)
        found = [x for x in found if x[3] >= THRESHOLD]
        found.sort(key=lambda x: (KINDS.index(x[2]), x[0] - x[1], x[0]))
        kept, taken = [], Taken()
        for s, e, kind, _ in found:
            if taken.free(s, e):
                taken.add(s, e)
                kept.append((s, e, kind))
        return sorted(kept)

    @staticmethod
    def _spelled(text: str, at: int) -> list[tuple[int, int]]:
        """Addresses with a spelled-out dot or at that reach beyond ``at``; the window grows until none is cut at its ends."""
        width = 90
        while True:
            a, b = max(0, at - width), min(len(text), at + width)
            out = [(m.start(), m.end()) for m in _SPELLED.finditer(text, a, b) if m.end() > at]
            cut = any(s == a > 0 or e == b < len(text) or a and _MORE_BEFORE.search(text, max(0, s - 8), s) for s, e in out)
            if width >= len(text) or not cut and (out or not _MORE_BEFORE.search(text, max(0, a - 8), a)):
                return out
            width *= 4

    def _email(self, text: str, at: int, found: list) -> None:
        width = 80
        while True:
            a = max(0, at - width)
            m = _LOCAL.search(text, a, at)
            if a == 0 or not m or m.start() > a:
                break
            width *= 4
        d = _DOMAIN.match(text, at + 1)
        if not m or not d:
            return
        local = m.group()
        cut = max(local.rfind("="), local.rfind("'"), local.rfind("’"), local.rfind("&")) + 1
        last = re.split(r"[.\s\])]", d.group())[-1]
        if not last.isalpha() or len(last) < 2 or len(local) == cut:
            return
        found.append((m.start() + cut, d.end(), "email", 0.95))

    def _identity(self, text: str, low: str, end: int, found: list) -> None:
        gap = _BETWEEN.match(text, end, min(len(text), end + 40))
        if not gap:
            return
        gaps = re.sub(r"\A[ .]*(?:no|nr|num|number|numéro|número|n[º°])?\.?", "", low[end : gap.end()])
        if re.search(r"[.!?;]\s+\w{3,}|\bwith\b|\bfield\b|\bafter\b|\bbefore\b", gaps):
            return
        digit = gap.end()
        m = self._id_value(text, digit, end)
        if m:
            found.append((m.start(), m.end(), "id_number", FORM + LABELLED + id_evidence(m.group())))

    @staticmethod
    def _checked(text: str, low: str, found: list) -> None:
        """Identity numbers that no label announces: their checksum must confirm them, and no word for another number stands before."""
        for m in _CHECKED.finditer(text):
            before = low[max(0, m.start() - 24) : m.start()].rstrip(" =:\"'(#|").rstrip()
            found.append((m.start(), m.end(), "id_number", FORM + id_evidence(m.group()) + OTHER_NUMBER * before.endswith(NO_PHONE)))

    @staticmethod
    def _id_value(text: str, digit: int, least: int) -> re.Match | None:
        """The identity number whose first digit is at ``digit``; letters before it may belong to it, from ``least`` on."""
        starts = [digit]
        p = _PREFIX.search(text, max(least, digit - 4), digit)
        if p and p.group().strip(" -").lower() not in ("is", "es", "est", "ist", "no", "of"):
            starts.insert(0, p.start())
        for at in starts:
            for value in _ID_VALUES:
                m = value.match(text, at)
                if m and sum(c.isdigit() for c in m.group()) >= 5:
                    return m
        return None

    def _cells(self, text: str, found: list) -> None:
        """Identity numbers that fill the cell between a person's name and phone number in a tab-separated record."""
        for s, e, kind, score in list(found):
            if score < THRESHOLD or kind not in ("name", "phone"):
                continue
            if kind == "name" and text[e : e + 1] == "\t":
                a = e + 1
            elif kind == "phone" and s and text[s - 1] == "\t":
                a = text.rfind("\t", 0, s - 1) + 1
            else:
                continue
            b = min([x for x in (text.find("\t", a), text.find("\n", a), a + 40) if x >= 0])
            cell = text[a:b]
            digit = next((k for k, c in enumerate(cell) if c.isdigit()), None)
            m = self._id_value(text, a + digit, a) if digit is not None and digit < 4 else None
            if m and m.start() == a and m.end() == b:
                found.append((a, b, "id_number", FORM + IN_TABLE + id_evidence(m.group())))

    def _phones(self, text: str, low: str, found: list) -> None:
        for m in _PHONE.finditer(text):
            at, stop = m.start(), m.end()
            while stop - at >= 7:
                c = text[at]
                if c in "+(" or c.isdigit() and (at == m.start() or text[at - 1] in " \xa0" or text[at - 1] in "+("):
                    best = None
                    for form in _PHONES:
                        p = form.match(text, at, stop)
                        if p and (best is None or p.end() > best.end()):
                            best = p
                    if best is not None:
                        self._phone(low, best, found)
                        at = best.end()
                        continue
                at += 1

    @staticmethod
    def _phone(low: str, m: re.Match, found: list) -> None:
        raw, at = m.group(), m.start()
        if sum(c.isdigit() for c in raw) < 7:
            return
        score = 0.55 if re.search(r"\D", raw) or raw[0] == "0" else 0.3
        before = low[max(0, at - 24) : at].rstrip(" =:\"'(#|").rstrip()
        if before.endswith(NO_PHONE):
            score -= 0.5
        if any(x in before[-16:] for x in PHONE_LABELS):
            score += 0.3
        if re.match(r"\d{4}-\d\d-\d\d|\d+\.\d+\.\d+\.\d+\Z|\d{1,3}(?:\.\d{1,2}){2}\Z", raw):
            score -= 0.5
        found.append((m.start(), m.end(), "phone", score))

    def _streets(self, text: str, low: str, found: list) -> None:
        for m in _ADDRESS_EN.finditer(text):
            words = m.group().split()
            body = [w for w in words if not w[0].isdigit() and len(w) > 1]
            if len(body) < 2:
                continue
            cased = all(w[0].isupper() for w in body)
            before = low[max(0, m.start() - 26) : m.start()]
            score = (0.6 if cased else 0.3) + 0.3 * any(x in before for x in ADDRESS_LABELS) + 0.2 * bool(re.search(r"(?:\||\bat|[\"'(„“«])\s*\Z", before))
            if not cased and len({w.islower() for w in body}) > 1:
                score -= 0.3
            end = m.end()
            if text[end : end + 1] == "." and (body[-1].lower() == "rd" or body[-1].lower() in ("st", "ave", "blvd", "ln") and text[end + 1 : end + 2] in (",", ")", '"')):
                end += 1
            found.append((m.start(), end, "address", score))
        for m in _ADDRESS_FR.finditer(text):
            found.append((m.start(), m.end(), "address", 0.7))

    def _street_de(self, text: str, s: int, e: int, found: list) -> None:
        if text[e].isalpha():
            return
        number = _DIGITS_BEFORE.match(text, e)
        if not number:
            return
        start = s
        while start and (text[start - 1].isalpha() or text[start - 1] == "-"):
            start -= 1
        if s - start < 3:
            m = re.search(r"(?:(?:Am|An der|Im|In der|Zum|Zur|Auf der|Unter den) )?[A-ZÄÖÜ][\wäöüß-]+ \Z", text[max(0, start - 40) : start])
            if not m or not text[start].isupper():
                return
            start -= len(m.group())
        found.append((start, number.end(), "address", 0.7))

    def _street_es(self, text: str, s: int, e: int, found: list) -> None:
        m = _ADDRESS_ES.match(text, e)
        if m:
            caps = any(w[0].isupper() for w in m.group().split() if w[0].isalpha()) or text[s:e].isupper()
            label = any(x in text[max(0, s - 26) : s].lower() for x in ADDRESS_LABELS)
            found.append((s, m.end(), "address", 0.4 + 0.3 * (caps and text[s].isupper()) + 0.3 * label))

    def kind_of(self, word: str) -> str:
        """Letters of the roles a word may have in a name: G, S, P, I."""
        low = word.lower()
        roles = ""
        if len(word) == 1:
            return "I"
        if low in PARTICLES:
            roles += "P"
        if low in self.given or "-" in low and all(p in self.given for p in low.split("-")):
            roles += "G"
        if low in self.surnames or "-" in low and all(p in self.surnames for p in low.split("-")):
            roles += "S"
        elif (m := re.match(r"(?:o['’]|d['’]|l['’]|mc|mac)(.+)", low)) and m.group(1) in self.surnames:
            roles += "S"
        return roles

    def _names(self, text: str, low: str, hits: list[tuple[int, int]], found: list) -> None:
        done = 0
        for s, e in hits:
            if s < done:
                continue
            best, width = None, 60
            while True:
                a, b = max(0, s - width), min(len(text), e + width)
                while a and text[a - 1].isalnum() and a < s and text[a].isalnum():
                    a += 1
                words = [(m.group(), m.start(), m.end(), self.kind_of(m.group())) for m in _WORD.finditer(text, a, b)]
                at = next((k for k, w in enumerate(words) if w[1] <= s < w[2]), None)
                # six words on either side, none of them cut, or the whole text
                if a == 0 and b == len(text) or at is not None and (at >= 5 or a == 0) and (len(words) - at > 6 or b == len(text)) or width > 200 and not (b < len(text) and text[b].isalnum()):
                    break
                width *= 2
            if at is None:
                continue
            for first in range(max(0, at - 5), at + 1):
                got = self._match(text, low, words, first)
                if got and got[0] <= s < got[1] and (best is None or got[1] - got[0] > best[1] - best[0]):
                    best = got
            if best:
                found.append((best[0], best[1], "name", best[2]))
                done = best[1]

    def _match(self, text: str, low: str, words: list, first: int) -> tuple[int, int, float] | None:
        """The longest name that begins with word ``first``, with its score."""

        def gap(k: int) -> str:
            return text[words[k][2] : words[k + 1][1]] if k + 1 < len(words) else "\n"

        def joined(k: int) -> bool:
            g = gap(k)
            return g in (" ", "\xa0", "  ") or words[k][3] == "I" and g in (". ", ".", ".\xa0")

        def surname(k: int) -> int | None:
            """Index of the surname in particles* surname from k."""
            while k < len(words):
                if "S" in words[k][3]:
                    return k
                if "P" not in words[k][3] or not joined(k):
                    return None
                k += 1
            return None

        w = words[first]
        start, roles = w[1], w[3]
        best = None
        if "G" in roles or roles == "I" and gap(first)[:1] == ".":
            k = first
            middle = 0
            while joined(k) and k + 1 < len(words) and middle < 2 and surname(k + 1) is None and (words[k + 1][3] == "I" and gap(k + 1)[:1] == "." or "G" in words[k + 1][3]):
                k += 1
                middle += 1
            if joined(k) and (z := surname(k + 1)) is not None:
                best = (first, z)
        if best is None and ("S" in roles or "P" in roles) and (z := surname(first)) is not None:
            k = z + 1
            if k < len(words):
                g = gap(z)
                given = "G" in words[k][3] or words[k][3] == "I" and text[words[k][2] : words[k][2] + 1] == "."
                if given and (g == ", " or g == " " and "G" in words[k][3] and (words[z][0].lower() not in ORDINARY)):
                    end = k
                    if joined(k) and k + 1 < len(words) and words[k + 1][3] == "I" and gap(k + 1)[:1] == ".":
                        end = k + 1
                    best = (first, end)
        if best is None:
            return None
        x, y = best
        end = words[y][2]
        if words[y][3] == "I":
            end += 1
        parts = [p for p in words[x : y + 1] if p[3] not in ("I", "P")]
        ordinary = [p for p in parts if p[0].lower() in ORDINARY]
        cased = all(p[0][0].isupper() for p in parts)
        before = low[max(0, start - 14) : start].rstrip(" ")
        cue = before.endswith(NAME_CUES)
        score = 0.8 if not ordinary else 0.6 if len(ordinary) < len(parts) and cased else 0.45 if len(ordinary) < len(parts) or cased else 0.1
        score += 0.1 * cue
        if re.match(r"[@\w-]|\.[^\W\d_]{2}|\+\w", text[end : end + 3]) or start and text[start - 1] in "@._+-/" and text[start - 2 : start - 1].isalnum():
            score -= 0.6
        return start, end, score


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


def known_parts(parts: DataFrame) -> tuple[set[str], set[str]]:
    """Given names and surnames of a small list, trimmed and in lower case; more than MAX_PARTS rows are an error."""
    rows = (
        parts.select(F.lower(F.trim("name")).alias("name"), F.lower(F.trim("kind")).alias("kind"))
        .where("name is not null and name <> ''")
        .distinct()
        .limit(MAX_PARTS + 1)
        .collect()
    )
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} name parts")
    return {r.name for r in rows if r.kind == "given"}, {r.name for r in rows if r.kind == "surname"}


def learn_parts(docs: DataFrame, id_col: str, text_col: str, given: set[str], surnames: set[str]) -> tuple[set[str], set[str]]:
    """Known parts and those that the documents show beside different known ones.

    A part counts if it stands beside at least three of them in a quarter of its occurrences, or as the given name
    after the comma of at least two. All documents are counted and the counts are compared in Spark; only accepted parts
    are collected, and more than MAX_PARTS of them are an error.
    """
    source = spread(docs.select(F.col(text_col).alias("text")))
    finder_words = frozenset(given | surnames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        total: Counter = Counter()
        title = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

        def counts() -> pa.RecordBatch:
            rows = [(r, x, p, c) for (r, x, p), c in pairs.items()] + [("total", x, "", c) for x, c in total.items()]
            pairs.clear()
            total.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.string()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.int64())],
                ["role", "part", "partner", "n"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                words = [(m.group(), m.start(), m.end()) for m in title.finditer(text)]
                lows = [w[0].lower() for w in words]
                total.update(low for w, low in zip(words, lows) if w[0][0].isupper())
                for k, low in enumerate(lows):
                    if low not in finder_words or low in ORDINARY:
                        continue
                    if low in given and k + 1 < len(words) and text[words[k][2] : words[k + 1][1]] == " ":
                        j = k + 1
                        if len(lows[j]) == 1 and text[words[j][2] : words[j][2] + 2] == ". " and j + 1 < len(words):
                            j += 1
                        if lows[j] not in finder_words and words[j][0].istitle():
                            pairs[("surname", lows[j], low)] += 1
                    if low in surnames:
                        if k and text[words[k - 1][2] : words[k][1]] == " " and lows[k - 1] not in finder_words and words[k - 1][0].istitle() and text[words[k][2] : words[k][2] + 1] != ",":
                            pairs[("given", lows[k - 1], low)] += 1
                        if k + 1 < len(words) and text[words[k][2] : words[k + 1][1]] == ", " and lows[k + 1] not in finder_words and words[k + 1][0].istitle() and not (k and lows[k - 1] in given):
                            pairs[("inverted", lows[k + 1], low)] += 1
            if len(pairs) + len(total) > COUNTED_WORDS:
                yield counts()
        yield counts()

    counted = source.mapInArrow(run, "role string, part string, partner string, n long").groupBy("role", "part", "partner").agg(F.sum("n").alias("n"))
    is_role = lambda r: F.col("role") == r
    kinds = lambda r: F.sum(is_role(r).cast("int"))
    n_pairs = lambda r: F.sum(F.when(is_role(r), F.col("n")).otherwise(0))
    often = lambda r: (kinds(r) >= 3) & (n_pairs(r) >= 0.25 * n_pairs("total"))
    parts = counted.groupBy("part").agg((often("given") | (kinds("inverted") >= 2)).alias("given"), often("surname").alias("surname"))
    rows = parts.where("(given or surname) and length(part) >= 3").where(~F.col("part").isin(sorted(ORDINARY | PARTICLES))).limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} learned name parts")
    return given | {r.part for r in rows if r.given}, surnames | {r.part for r in rows if r.surname}


def find(docs: DataFrame, id_col: str, text_col: str, given: set[str], surnames: set[str], with_text: bool = False) -> DataFrame:
    """``(id_col, redacted string, spans array<struct<start,end,kind,mention>>)`` per input row; no shuffle.

    Null and empty texts have no spans. ``redacted`` is null unless ``with_text``.
    """
    parts = docs.sparkSession.sparkContext.broadcast((given, surnames))
    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    cache: dict = {}
    schema = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("mention", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "finder" not in cache:
            cache["finder"] = Finder(*parts.value)
        finder = cache["finder"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                texts = part.column(1).to_pylist()
                spans = [finder.spans(t) for t in texts]
                clear = [redact(t, s) if with_text else None for t, s in zip(texts, spans)]
                lists = [[{"start": s, "end": e, "kind": k, "mention": t[s:e]} for s, e, k in sp] for t, sp in zip(texts, spans)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clear, pa.string()), pa.array(lists, schema)], ["id", "redacted", "spans"])

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, redacted string, spans array<struct<start:int,end:int,kind:string,mention:string>>")
    return out.withColumnRenamed("id", id_col)
