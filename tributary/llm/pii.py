"""Personal information in free text: found on a deobfuscated form, replaced in the text as it stands (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tributary.llm import names_public
from tributary.llm.offsets import Mapped, nfkc, replace, source_span
from tributary.operators.spread import spread

KINDS = ("email", "phone", "id_number", "address", "name")

# --- transducers ---------------------------------------------------------------------------------------------------------------------------------------

# Letters of other scripts that look like Latin ones, and the dashes, quotes and spaces that stand for plain ones.
_LOOKALIKES = dict(zip("АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABCEHIJKMOPSTXYaceijopsxyhdgABEZHIKMNOPTYXo"))
_PLAIN = dict.fromkeys("‐‑‒–—―−", "-") | dict.fromkeys("‘’‛′", "'") | dict.fromkeys("“”„", '"') | dict.fromkeys("            　\t", " ")
# Spelled digits in the four languages.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0",
    "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1",
    "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0", "un": "1", "deux": "2",
    "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_D = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = regex.compile(rf"(?i)(?<!\w)(?:{_D})(?:[ -]+(?:{_D})){{4,}}(?!\w)")
_DIGIT_WORDS = ahocorasick.Automaton()
for _w in _DIGITS:
    _DIGIT_WORDS.add_word(_w, len(_w))
_DIGIT_WORDS.make_automaton()
_ODD = regex.compile(r"[\p{Cf}\p{M}‐-―−‘-‟′\t\xa0  -  　＀-￯]|[A-Za-z][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][A-Za-z]")
_MIXED = regex.compile(r"\b(?=\w*[A-Za-z])(?=\w*[\p{Cyrillic}\p{Greek}])\w+\b")
_UNSEEN_OR_PLAIN = regex.compile(r"\p{Cf}+|[" + "".join(map(regex.escape, _PLAIN)) + "]")
_DOT = regex.compile(r"(?i)(?<=\w)(?: ?[\[({<] ?(?:dot|punkt|punto|point) ?[\])}>] ?| (?:dot|punkt|punto|point) )(?=\w)")
_WORDS = re.compile(r"[^\W\d_]+")
_AT = regex.compile(r"(?i)(?<=\w)(?: ?[\[({<] ?(?:at|ät|arroba|arobase|klammeraffe) ?[\])}>] ?| (?:at|arroba|arobase|klammeraffe) (?=[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}))(?=\w)")


_AT_HINT = re.compile(r"[\[({<] ?(?:at|ät|arroba|arobase|klammeraffe) ?[\])}>]| (?:at|arroba|arobase|klammeraffe) [\w-]+\.[\w.-]*[a-z]", re.I)


def _spelled(low: str) -> bool:
    """Whether five words for digits may follow one another."""
    n, last, run = len(low), -9, 0
    for end, size in _DIGIT_WORDS.iter(low):
        a, b = end - size + 1, end + 1
        if (b == n or not low[b].isalnum()) and (a == 0 or not low[a - 1].isalnum()):
            run = run + 1 if a - last <= 4 else 1
            last = b
            if run >= 5:
                return True
    return False


_flags: dict[str, int] = {}


def _flag(c: str) -> int:
    """1 for a character that is rewritten wherever it stands, 2 for a letter that is only rewritten beside Latin ones."""
    return 1 if regex.match(r"[\p{Cf}\p{M}‐-―−‘-‟′\xa0  -  　＀-￯]", c) else 2 if regex.match(r"[\p{Cyrillic}\p{Greek}]", c) else 0


def _is_odd(text: str) -> bool:
    """Whether a transducer of characters has anything to do; looks at each distinct character once."""
    most = 1 if "\t" in text else 0
    for c in set(text):
        if c > "\x7f":
            if c not in _flags:
                _flags[c] = _flag(c)
            most |= _flags[c]
    return bool(most & 1) or bool(most & 2) and bool(_ODD.search(text))


def deobfuscate(text: str) -> Mapped:
    """The text with look-alike and full-width characters, odd dashes and spaces made plain, invisible characters dropped, spelled digit runs as digits and
    the disguises of @ and . undone, and each character's place in the original. Cheap tests leave out the transducers that have nothing to do."""
    m = (text, range(len(text)))
    if not text.isascii() and _is_odd(text):
        m = nfkc(text)
        m = replace(m, _UNSEEN_OR_PLAIN, lambda x: _PLAIN.get(x[0], ""))
        m = replace(m, _MIXED, lambda x: "".join(_LOOKALIKES.get(c, c) for c in x[0]))
    low = m[0].lower()
    if _spelled(low):
        m = replace(m, _SPELLED, lambda x: "".join(_DIGITS[w] for w in regex.split(r"[ -]+", x[0].lower())))
    if any(w in low for w in ("dot", "punkt", "punto", "point")):
        m = replace(m, _DOT, lambda _: ".")
    if _AT_HINT.search(m[0]):
        m = replace(m, _AT, lambda _: "@")
    return m


# --- detectors -----------------------------------------------------------------------------------------------------------------------------------------

_EMAIL = regex.compile(r"(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])")

_EXT = r"(?:,? ?(?:x|ext\.?|extension|Durchwahl|DW|App\.|poste|int\.|extensión) ?\d{1,6})?"
_PHONE = regex.compile(
    r"(?<![\w.+/(-])(?<!\d )(?:"
    r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}([ .-]))\d{3}(?(1)\1|[ .-])\d{4}"
    r"|\+?1?[2-9]\d{9}"
    r"|\(?(?:\+|00)44\)?[ -]?(?:\(0\) ?)?\d{2,5}[ -]?\d{3,4}[ -]?\d{3,6}|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4}[ -]\d{6}"
    r"|\(?(?:\+|00)34\)?[ .-]?\d{3}(?:[ .-]?\d{6}|([ .-]?)\d{3}\2\d{3}|(?: \d{2}){3})|[5-9]\d{2}(?:([ .-])\d{3}\3\d{3}|(?: \d{2}){3}|[5-9]?\d{5,6}(?<=\d{9}))"
    r"|(?:\+|00)49[ -]?(?:\(0\) ?)?\d{2,5}[ /-]?\d{2,9}(?:[ -]\d{1,6})?|\(0\d{2,4}\) ?\d{3}(?: ?\d{2,5})|0\d{2,4}[/-]\d{6,9}|0\d{2,4} \d{6,9}"
    r"|\(?(?:\+|00)33\)?[ .-]?(?:\(0\) ?)?\d(?:[ .-]?\d{2}){4}|0\d(?:([ .-]?)\d{2})(?:\4\d{2}){3}"
    rf"){_EXT}(?!\w)(?![-/.]\d)"
)
#: Words before a number that say it is no phone number and no personal number, and keys of other things.
_THING = regex.compile(
    r"(?i)(?:\b(?:parcel|batch|serial|build|invoice|order|credit note|checksum|sendung|charge|rechnung|seriennummer|bestellung|auftrag|envío|paquete|lote|factura|"
    r"pedido|serie|colis|lot|facture|commande|série|refund of|sku)[ :#=]*(?:n\.?[ºo]|no\.?|nr\.?)?[ :#=]*|\b(?:id|order|batch|build|sha|hash)\"?[=:] ?)$"
)
#: Words before a bare run of digits that say the same; a number grouped or written with a prefix, brackets or letters is kept behind them.
_COUNT = regex.compile(r"(?i)(?:\b(?:version|since|range|expected|got|rows?|ms|ticket|note|page|item)[ :#=]*(?:n\.?[ºo]|no\.?|nr\.?)?[ :#=]*|\b(?:rows|ms)\"?[=:] ?)$")


def _of_thing(t: str, a: int, b: int) -> bool:
    """Whether what stands before the number at ``a`` says that it is no person's."""
    return bool(_THING.search(t, max(0, a - 40), a) or t[a:b].isdigit() and _COUNT.search(t, max(0, a - 40), a))


_LABEL = (
    r"(?i:ssn|social security(?: number| no\.?)?|passport(?: number| no\.?)?|tax id|national insurance(?: number)?|id on file|id no\.?|doc(?:_no|ument)?|steuer-?id|ausweis(?:nummer|-nr\.?)?|personalausweis|"
    r"reisepass|dni|nie|nif|pasaporte|documento|nir|pièce|passeport|numéro de sécu(?:rité sociale)?|carte d'identité)"
)
_NUMBER = (
    r"\d{3}(?P<n1>[ -]?)\d{2}(?P=n1)\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{2} ?\d{7}|[A-Z]\d{7,8}|\d{4}-\d{4}-\d{3}|\d{2}(?P<n2>[ /.]?)\d{3}(?P=n2)\d{3}(?P=n2)\d{3}|\d{8}[ -]?[A-Za-z]|\d{2}\.\d{3}\.\d{3}-[A-Za-z]"
    r"|[XYZ][ -]?\d{7}[ -]?[A-Z]|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|(?=[A-Z0-9]*\d[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{9,10}"
)
_LABELLED = regex.compile(rf"(?<!\w){_LABEL}\"?(?: (?:is|ist|es|est|lautet|number|no\.?|nr\.?|n\.?º))?[ :=#\"']{{1,4}}(?P<v>(?:{_NUMBER}))(?![\w])(?!-\d)")
_TYPED = regex.compile(
    r"(?<![\w./-])(?<!\d )(?:\d{3}([ -])\d{2}\1\d{4}|(?:000|666|9\d\d)\d{6}|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]|(?:[A-Z]{2} )\d{7}|[A-Z]\d{8}|\d{4}-\d{4}-\d{3}|\d{8}[ -]?[A-HJ-NP-TV-Z]|\d{2}\.\d{3}\.\d{3}-[A-Za-z]"
    r"|0\d([ /])\d{3}\2\d{3}\2\d{3}|[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|[12]\d{14}|0\d{10}|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|\d{8} [a-z])(?!\w)(?![-/]\d)(?! \d{2,})"
)

_LIKE_ID = regex.compile(r"\d{3}([ -])\d{2}\1\d{4}|\d{4}-\d{4}-\d{3}|0\d[ /]\d{3}[ /]\d{3}[ /]\d{3}")

#: A town: capitalised words up to the next punctuation.
_TOWN = r"(?:\p{Lu}[\p{L}'-]+(?: (?:am|an|der|del|de|la|le|sur|sous|\p{Lu}[\p{L}'-]+)){0,3}(?= ?(?:[.,;|\r\n<\"']|$)))"
_GAP = r"(?:,? ?\r?\n ?|, ?| )"
_HOUSE = r"\d{1,4}(?:-\d{1,4})?(?: ?(?i:bis|ter|quater)\b| ?[A-Za-z](?!\w))?"
_ADDRESS = [
    # flat, number, street word last, unit, town, code
    rf"(?:(?i:flat|apt\.?|apartment|unit|suite) \d+\w?,? ?\r?\n?)?\d{{1,5}}[A-Za-z]? (?:[\p{{L}}'-]+ ){{1,3}}(?i:road|rd|street|st|avenue|ave|lane|ln|terrace|court|ct|boulevard|blvd|drive|dr|way|close|square|place|row)\b\.?"
    rf"(?:,? (?:(?i:apt\.?|unit|suite|flat|floor) ?\w+|\# ?\d+\w?))?{_GAP}{_TOWN}(?:{_GAP}\d{{5}}(?!\d))?",
    # street, number, unit, code, town
    rf"(?:(?i:am|an der|im|auf der|zum|zur) \p{{L}}[\p{{L}}-]+(?: \p{{L}}[\p{{L}}-]+)?|[\p{{L}}-]+(?i:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm)) {_HOUSE}(?:{_GAP}\d{{5}} {_TOWN}| (?i:in) {_TOWN})",
    rf"(?:(?i:calle|avda\.?|avenida|plaza|paseo|camino|ronda|travesía)|(?i:c/)) ?(?:(?i:de|del|la|las|los|el) )*[\p{{L}}]+(?: [\p{{L}}]+){{0,3}}?,? (?:(?i:n\.?[ºo]|núm\.|n[ºo]) ?)?{_HOUSE}"
    rf"(?:, (?:(?i:piso \w+|bajo|ático|entresuelo|izda\.?|dcha\.?)|\d+\.?[ºªoa](?: \w\b)?))*(?:{_GAP}\d{{5}} {_TOWN}| - {_TOWN})",
    rf"{_HOUSE},? (?i:rue|avenue|av\.|bd|boulevard|impasse|place|quai|chemin|allée|cours|route|square) (?:[\p{{L}}'-]+ ?){{1,5}}?(?:{_GAP}\d{{5}} {_TOWN}| (?i:à) {_TOWN})",
]
_ADDRESSES = regex.compile("(?<![\\w])(?:" + "|".join(_ADDRESS) + ")")

# Addresses whose town stands in no list, in any case before or behind a code, and addresses without a town; the street is then capitalised.
_ANY = r"[\p{L}'.-]+(?: [\p{L}'-]+){0,3}"
_BARE_TOWN = rf"(?:(?:,? ?\r?\n ?|, ){_TOWN}|, \p{{Lu}}[\p{{L}}'-]+(?:[ -]\p{{Lu}}[\p{{L}}'-]+){{0,2}})"
_ZIP = r"(?:\d{5}(?:-\d{4})?|[A-Z]{2},? \d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})(?!\w)"
_LOW_TOWN = r"\p{Ll}[\p{L}'-]+(?: \p{Ll}[\p{L}'-]+){0,2}(?= ?(?:[.,;|\r\n]|$))"
_TAIL = rf"(?:{_GAP}\d{{5}} (?:{_TOWN}|{_LOW_TOWN}|\p{{L}}[\p{{L}}'-]+(?:[ -](?:(?:am|an|der|del|de|la|le|sur|sous)\b ?)*\p{{Lu}}[\p{{L}}'-]+)*)|(?: -|,? (?:in|à|en)) (?:{_TOWN}|\p{{Lu}}[\p{{L}}'-]+(?:[ -]\p{{Lu}}[\p{{L}}'-]+)*)|{_BARE_TOWN})"
_EN = "(?i:road|rd|street|st|avenue|ave|lane|ln|terrace|court|ct|boulevard|blvd|drive|dr|way|close|square|place|row)\\b\\.?"
_EN_CAP = "(?:(?=\\p{Lu})(?i:road|rd|street|st|avenue|ave|lane|ln|terrace|court|ct|boulevard|blvd|drive|dr|way|close|square|place|row)\\b\\.?)"
_UNIT = r"(?:,? (?:(?i:apt\.?|unit|suite|flat|floor) ?\w+|\# ?\d+\w?))?"
_FLAT = r"(?:(?i:flat|apt\.?|apartment|unit|suite) \d+\w?,? ?\r?\n?)?"
_OPEN_ADDRESSES = regex.compile(
    "(?<![\\w.,:/-])(?:"
    rf"{_FLAT}\d{{1,5}}[A-Za-z]? (?:[\p{{L}}'-]+ ){{1,3}}?{_EN}{_UNIT}{_GAP}{_ANY}{_GAP}{_ZIP}"
    rf"|{_FLAT}\d{{1,5}}[A-Za-z]? (?:\p{{Lu}}[\p{{L}}'-]+ ){{1,3}}?{_EN_CAP}{_UNIT}(?:{_GAP}{_ZIP}|{_BARE_TOWN}(?:{_GAP}{_ZIP})?)?"
    rf"|(?:(?:Am|An der|Im|Auf der|Zum|Zur) \p{{Lu}}[\p{{L}}-]+(?: \p{{L}}[\p{{L}}-]+)?|(?:\p{{Lu}}[\p{{L}}-]+ )?[\p{{L}}-]+(?i:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm)) {_HOUSE}{_TAIL}"
    rf"|(?!(?i:speicher|arbeits|lager|stell|park|steck|liege|sitz|rück|transport|förder|daten|umweg|ausweg|lese|schreib))\p{{Lu}}[\p{{L}}-]*(?i:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm) {_HOUSE}"
    rf"|(?:(?i:calle|avda\.?|avenida|plaza|paseo|camino|ronda|travesía)(?!\p{{L}})|(?i:c/)) ?(?:(?i:de|del|la|las|los|el) )*\p{{L}}+(?: [\p{{L}}]+){{0,3}}?,? (?:(?i:n\.?[ºo]|núm\.|n[ºo]) ?)?{_HOUSE}"
    rf"(?:, (?:(?i:piso \w+|bajo|ático|entresuelo|izda\.?|dcha\.?)|\d+\.?[ºªoa](?: \w\b)?))*{_TAIL}?"
    rf"|{_HOUSE},? (?i:rue|avenue|av\.|bd|boulevard|impasse|quai|chemin|allée|place|cours|route|square) (?:(?i:de|du|des|la|le|les) |(?i:l|d)['])*\p{{L}}[\p{{L}}-]*(?: (?:(?i:de|du|des|la|le|les) |(?i:l|d)['])*\p{{Lu}}[\p{{L}}-]*){{0,4}}{_TAIL}"
    rf"|{_HOUSE},? (?i:rue|avenue|av\.|bd|boulevard|impasse|quai|chemin|allée|place) (?:(?i:de|du|des|la|le|les) |(?i:l|d)['])*\p{{Lu}}[\p{{L}}-]*(?: (?:(?i:de|du|des|la|le|les) |(?i:l|d)['])*\p{{Lu}}[\p{{L}}-]*){{0,4}}"
    rf"|\d{{1,5}}[A-Za-z]? (?:[\p{{L}}'-]+ ){{1,3}}?{_EN},? (?:(?i:apt\.?|unit|suite|flat|floor) ?\d\w*|\# ?\d+\w?){_GAP}\p{{L}}[\p{{L}}'-]+(?: [\p{{L}}'-]+)?(?= ?(?:[.,;|\r\n]|$))"
    rf"|(?i:am|an der|im|auf der|zum|zur) \p{{L}}[\p{{L}}-]+(?: \p{{L}}[\p{{L}}-]+)? {_HOUSE}{_GAP}\d{{5}} {_LOW_TOWN}"
    rf"|(?<=(?:\b(?:to|at|is|in)|[:|]) )\d{{1,5}} (?:[\p{{L}}'-]+ ){{1,2}}(?i:road|rd|street|st|avenue|ave|lane|ln|terrace|court|ct|boulevard|blvd|drive)\.?,? [\p{{L}}'-]+(?: [\p{{L}}'-]+)?(?= ?(?:[.,;|\r\n]|$))"
    rf"|(?<=[\r\n])\d{{1,5}} (?:[\p{{L}}'-]+ ){{1,2}}(?i:road|rd|street|st|avenue|ave|lane|ln|terrace|court|boulevard|blvd|drive)\.?,? [\p{{L}}'-]+(?: [\p{{L}}'-]+)?(?=[\r\n])"
    ")(?!\\w)"
)

class Names:
    """Names that are evidence by themselves: ``given`` and ``family`` names, by default common ones of four languages (names_public.py)."""

    def __init__(self, given=names_public.GIVEN, family=names_public.FAMILY):
        self.given, self.family = frozenset(w.lower() for w in given), frozenset(w.lower() for w in family)
        self.triggers = _triggers(self.given)


_TITLE = r"(?:Dr\.?|Mrs?\.?|Ms\.?|Miss|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|señora?|Sra?\.|Don|Doña)"
_CAP = r"\p{Lu}\p{Ll}+(?:['-]\p{Lu}?\p{Ll}+)*"
#: A title, then a given name or initial and one or two more capitalised words: names that no list has.
_TITLED = regex.compile(rf"(?<!\w){_TITLE} (?:{_TITLE} )?(?P<v>(?:{_CAP}|\p{{Lu}}\.)(?: \p{{Lu}}\.)?(?: (?:von|van|de|del|di|da|du))? {_CAP})(?!\w)")


_TOKEN = rf"(?:{_CAP}|\p{{Lu}}\p{{L}}*(?:['-]\p{{L}}+)*)"
_OF_NAME = r"(?:(?i:von der|von|van der|van den|van|de la|de los|de|del|della|di|da|du|le|la|zu|zur) )"
_INITIAL = r"\p{L}\.(?! ?\p{L}\.)"
#: Two to four capitalised words, the first perhaps an initial, or the family name first.
_SHAPE = rf"(?:(?:{_TOKEN}|(?:\p{{Lu}}\. ?){{1,3}})(?: {_INITIAL})*(?: {_TOKEN})? {_OF_NAME}?{_TOKEN}|(?:\p{{Lu}}\. ?){{1,3}}{_TOKEN}|{_OF_NAME}?{_TOKEN}(?: {_TOKEN})?, ?(?:{_TOKEN}|\p{{Lu}}\.)(?: {_INITIAL})*(?=[ ]?(?:[,;:|<(\r\n\"]|$|\p{{Ll}})))"
#: The same in any case, where all that stands in a field is a name.
_FIELD = r"(?:(?:\p{L}\. ?){1,3}|\p{L}[\p{L}'-]+ )(?:\p{L}\. )?(?:\p{L}[\p{L}'-]+ ){0,2}\p{L}[\p{L}'-]+|\p{L}[\p{L}'-]+(?: \p{L}[\p{L}'-]+){0,2}, ?(?:\p{L}[\p{L}'-]+|\p{L}\.)(?: \p{L}\.)*"
# Labels of persons, as last words before : or = or as names of columns, and phrases that a person follows.
_PERSON = (
    "caller|recipient|contact|customer|client|holder|owner|assignee|reporter|requester|employee|patient|applicant|author|sender|signatory|attn|fullname|surname|anrufer(?:in)?|empfänger(?:in)?|"
    "ansprechpartner(?:in)?|kontakt|kundin|kunde|inhaber(?:in)?|absender(?:in)?|melder(?:in)?|bearbeiter(?:in)?|mitarbeiter(?:in)?|destinatari[oa]|contacto|cliente|titular|remitente|solicitante|empleado|"
    "interlocutor(?:a)?|destinataire|titulaire|expéditeur|demandeur|appelant(?:e)?|interlocuteur|(?:full|customer|contact|first|last|client|holder)[ _]name|nombre y apellidos|nombre completo|nom et prénom|vor- und nachname|name|nombre|nom"
)
_PHRASE = (
    "(?:signed|reported|assigned|approved|reviewed|written|requested|submitted|sent|received|collected|confirmed|verified|opened|closed|handled|called|raised)(?: for)? (?:by|to)|spoke (?:to|with)|talked to|on behalf of|"
    "verified|unterschrieben von|gemeldet von|erfasst von|bearbeitet von|zugewiesen an|im namen von|gesprochen mit|adresse von|avisado por|firmado por|asignado a|en nombre de|a nombre de|hablé con|dirección de|"
    "signalé par|signé par|assigné à|attribué à|au nom de|parlé (?:à|avec)|adresse de|titular|the row for"
)
_HAS_LABEL = regex.compile(rf"(?i)(?<![\p{{L}}])(?:(?P<l>{_PERSON})[\"']? ?[:=] ?[\"']?|(?:from|von|de|to|para|an|à)(?<=\n....|^....|\n...|^...|\n..|^..|\n.|^.): |(?P<p>{_PHRASE}) )")
_AFTER_LABEL = regex.compile(rf"(?:{_TITLE} )*(?P<v>{_SHAPE})(?![\p{{L}}\d@_(])")
_IN_FIELD = regex.compile(rf"(?:{_TITLE} )*(?P<v>{_FIELD})(?= ?(?:[;|<(\r\n\"]|,(?! ?\p{{L}})|$| tel|[.](?:\s|$)))")
_CLOSING = regex.compile(
    r"(?i)(?<!\w)(?:(?:(?:kind|best|warm) )?regards|sincerely|yours (?:truly|faithfully|sincerely)|best wishes|cheers|thanks|thank you|(?:mit )?(?:freundlichen|besten|vielen|viele|freundliche|liebe|beste) grüßen?|mfg|danke|"
    r"(?:un )?(?:cordial )?saludos?|atentamente|gracias|cordialement|bien à vous|salutations|merci),?[ ]*\r?\n\s*"
)
_SIGNED = regex.compile(rf"(?P<v>{_FIELD})(?=[ ]*(?:[\r\n]|$))")
_CLOSES = set("regards sincerely truly faithfully wishes cheers thanks you grüßen grüße mfg danke saludo saludos atentamente gracias cordialement vous salutations merci".split())
_TO_MAIL = regex.compile(rf"(?:^|[;|\r\n\t]|(?<=[:;|,\"] ))\"?(?P<v>{_FIELD})\"?(?: ?[<;|\t(] ?| \(mailto:)$")
_TO_PHONE = regex.compile(rf"(?:^|[;|\r\n\t]|(?<=[:;|\"] ))\"?(?P<v>{_SHAPE})\"?,? ?$")
_NEAR_INITIAL = regex.compile(rf"(?:(?<=[|;:=\"<(\t] ?)|(?<=(?<!\p{{L}})(?i:by|to|from|with|for|and|dear|von|mit|bei|an|für|und|por|para|con|y|par|pour|avec|à|et) ))(?P<v>(?:\p{{Lu}}\. ?){{1,3}}{_OF_NAME}?{_CAP})(?![\p{{L}}\d@])")
_MANY_INITIALS = regex.compile(rf"(?<![\p{{L}}\d.])(?<!\p{{Ll}}\. )(?!(?:U\. ?S|P\. ?[SO]|N\. ?B|Z\. ?B|D\. ?H|U\. ?A|E\. ?G|I\. ?E)\.)(?P<v>(?:\p{{Lu}}\. ?){{2,3}}{_OF_NAME}?{_CAP})(?![\p{{L}}\d@])")
_VAN = regex.compile(rf"(?<![\p{{L}}\d@-])(?P<v>{_CAP}(?: \p{{Lu}}\.)* (?:van der|van den|van de|van|von|della|ten|ter) {_CAP})(?![\p{{L}}\d@])")
_BY_GIVEN = regex.compile(rf"(?P<v>(?:{_TOKEN}[ -])?(?:{_INITIAL} )*{_OF_NAME}?{_TOKEN}(?:-{_TOKEN})?)(?![\p{{L}}\d@_(])")
_BEFORE_GIVEN = regex.compile(rf"(?<![\p{{L}}\d@-])(?P<v>{_OF_NAME}?{_TOKEN}(?:-{_TOKEN})?, ?)$")
_TITLED_ANY = regex.compile(rf"(?<!\w){_TITLE} (?:{_TITLE} )?(?P<v>\p{{Lu}}{{2,}}(?: \p{{Lu}}\.)?(?: {_OF_NAME})?(?: \p{{Lu}}{{2,}}(?:-\p{{Lu}}+)?){{1,2}}|\p{{Lu}}{{2,}}(?:-\p{{Lu}}+)?, ?\p{{Lu}}{{2,}}|{_OF_NAME}?{_CAP}(?: {_CAP})?, (?:{_CAP}|\p{{Lu}}\.)(?: \p{{Lu}}\.)*)(?!\w)")
# Words that are no part of a name where one is guessed from what stands around it.
_NO_NAME = set(
    "the a an and or not no see none null all any please call check order parcel batch ticket page item note build version error warning info service server team group desk support data table column row id "
    "customer client warehouse system release pipeline job queue query config metric user admin account address phone mail email name street road monday tuesday wednesday thursday friday saturday sunday january "
    "february march april may june july august september october november december der die das und oder nicht kein siehe bitte team gruppe dienst lager system abteilung kunde montag dienstag mittwoch donnerstag "
    "freitag el los las y o por favor equipo grupo servicio almacén sistema lunes martes miércoles jueves viernes les et ou équipe groupe service entrepôt système lundi mardi mercredi jeudi vendredi this that "
    "it is are was has have for from with to in on at by of we i you he she they our your my then when after before if but is sent via hello hi dear hallo liebe lieber hola bonjour inc ltd gmbh sl sa sas corp "
    "adresse anschrift anruf nachricht brief dirección correo mensaje llamada nombre firma nom part courrier appel message company bank office department north south east west new unknown pending open closed done todo select insert update true false".split()
)


# Words that open a sentence or clause; behind a name or town without a full stop they are the next sentence's.
_OPENERS = set(
    "a after an and any as at because before both but by each every for from how i if in it its my no of on once one or our so some that the their there these they this those to under until we what when whenever where "
    "whether which while who why with without you your ship please assigned signed spoke verified reported call select insert update delete "
    "ab als an auf aus bei bevor bis bitte da damit das dem den der die dies diese dieser ein eine einer er es für ihr im in ist jede jeder kein lieferung mein mit nach nachdem neue neuer ob obwohl oder ohne "
    "seit seitdem sie sobald sofern so um unser unter vom von vor war warum was weil wenn wer wie wir wird wo zu zum zur zurück während gemeldet erfasst unterschrieben erwartet frau herr "
    "a al ante antes así aunque bajo como con cuando de del desde después donde el ella en entre es esta este hasta la las le lo los mi mientras ni no nueva nuevo o para pero por porque que quien se si sin sobre su "
    "tras tu un una vuelta y ya avisado firmado enviar señora señor señor don doña "
    "à afin après au aucun aussi avant avec car ce ces cet cette chaque comme dans de depuis des dès donc du elle en entre est et il je jusqu la le les leur lorsque lors mais mes mon ne nos notre nous nouvelle nouveau on ou où "
    "par parce pendant pour puis puisque quand que quelqu qui sans sauf selon ses si son sous sur tant tout toute un une vers votre vous clos livrer mme mlle monsieur madame retour merci "
    "mr mrs ms miss dr".split()
)
_JOINING = frozenset("la le les las los el von der zu zur van den de del della di da du y e".split())
_LAST_WORD = regex.compile(r"[ \r\n]+(\p{L}+)[\p{L}'’-]*$")
_NEXT_FAMILY = regex.compile(rf" (?P<w>{_CAP})(?= (?:\p{{Ll}}|\p{{N}}|[(:<])|[.,;:|\r\n]|$)(?! \p{{Lu}})")


def _trimmed(t: str, a: int, b: int) -> int:
    """End of a name or address without the words at its end that open the next sentence, from the first such word behind the last comma, line end or number on."""
    last = max(t.rfind(c, a, b) for c in ",\n")
    last = max([last, *(m.end() for m in _DIGIT.finditer(t, max(a, last), b))])
    for k, m in enumerate(_WORDS.finditer(t, max(a, last), b)):
        if k and len(m[0]) > 1 and m.start() > a + 1 and t[m.start() - 1] == " " and m[0][0].isupper() and m[0].lower() in _OPENERS and not (m[0].lower() in _JOINING and m.end() + 1 < b and t[m.end() + 1].isupper()):
            return m.start() - 1
    while (m := _LAST_WORD.search(t, a, b)) and (len(m[1]) > 1 and m[1][0].isupper() and m[1].lower() in _OPENERS):
        b = m.start()
    return b


_PARTICLES = set("von der zu zur van den de del della di da du la le los y e".split())


#: An article, behind which a given name belongs to a thing.
_ARTICLE = regex.compile(r"(?i)(?<!\p{L})(?:the|an?|el|la|los|las|una?|le|les|une|das|dem|ein|eine) $")


def _likely(name: str) -> bool:
    """Whether no word of a guessed name is an everyday one."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return not any(len(w) > 1 and w in _NO_NAME and w not in _PARTICLES for w in words) and any(len(w) > 2 and w not in _PARTICLES for w in words)


def _open_names(t: str, names: Names, hits: dict[str, list[tuple[int, int]]], mails: list[tuple[int, int]], phones: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Names by what stands around them: behind titles, labels, closings of letters, as the field before an email address or a phone number, by initials or particles; and by
    common given names. Each pattern only looks around the words or signs that it needs."""
    def widened(a: int, b: int) -> tuple[int, int]:
        """A second family name belongs to a name whose place is sure."""
        if " " in t[a:b] and (x := _NEXT_FAMILY.match(t, b, min(n, b + 60))) and x["w"].lower() not in _OPENERS and x["w"].lower() not in _NO_NAME:
            return a, x.end("w")
        return a, b

    n, givens = len(t), hits["given"]
    given, starts = {t[a:b].lower() for a, b in givens}, {a for a, _ in mails}
    behind = set()
    titles = list(_windows(hits["title"], 90, n))
    for w in titles:
        for p in (_TITLED, _TITLED_ANY, _TITLED_LOW):
            for m in p.finditer(t, *w):
                yield widened(*m.span("v"))
    for a, b in givens:
        if (x := _TITLE_BEFORE.search(t, max(0, a - 12), a)) and (y := _GIVEN_ANY.match(t, a, min(n, a + 90))):
            yield y.span("v")
    for a, _ in hits["verb"]:
        if x := _BEFORE_VERB.search(t, max(0, a - 70), a) or _LOW_BEFORE_VERB.search(t, max(0, a - 70), a):
            yield x.span("v")
    for w in _windows(hits["label"], 40, n):
        for m in _HAS_LABEL.finditer(t, *w):
            end = min(n, m.end() + 90)
            behind.add(m.end())
            x = _AFTER_LABEL.match(t, m.end(), end)
            if not x and m["l"] and m["l"].lower() not in ("name", "nombre", "nom"):
                x = _IN_FIELD.match(t, m.end(), end)
            if not x and ((y := _GIVEN_ANY.match(t, m.end(), end)) and y["g"].lower() in given or (y := _FIELD_THEN_MAIL.match(t, m.end(), end)) and y.end() in starts):
                x = y
            if not x:
                x = _LOW_AFTER.match(t, m.end(), end)
            if x and not (m["l"] and m["l"] in ("name", "nombre", "nom") and '"' not in m[0]):
                yield widened(*x.span("v"))
    for w in _windows(hits["close"], 30, n):
        for m in _CLOSING.finditer(t, *w):
            if x := _SIGNED.match(t, m.end(), min(n, m.end() + 90)):
                yield x.span("v")
    for a, _ in mails:
        if x := _TO_MAIL.search(t, max(0, a - 90), a):
            yield x.span("v")
    for a, _ in phones:
        if x := _TO_PHONE.search(t, max(0, a - 90), a):
            yield x.span("v")
    initials = list(_windows([m.span() for m in _INITIALS.finditer(t)], 40, n))
    for p, stretches in ((_NEAR_INITIAL, initials), (_MANY_INITIALS, initials), (_VAN, _windows(hits["particle"], 40, n))):
        for w in stretches:
            for m in p.finditer(t, *w):
                yield m.span("v")
    for a, b in givens:
        if _ARTICLE.search(t, max(0, a - 6), a):
            continue
        if b < n and t[b] in " -" and t[a].isupper() and (x := _BY_GIVEN.match(t, b + 1, min(n, b + 90))):
            yield a, x.end("v")
        elif b < n and t[b] == " " and (x := _WORDS.match(t, b + 1)) and x[0].lower() in names.family:
            yield a, x.end()
        if x := _BEFORE_GIVEN.search(t, max(0, a - 60), a):
            fam = _WORDS.findall(x["v"])[-1].lower()
            line = x.start() == 0 or t[x.start() - 1] in "\r\n|;\t\"" or t[max(0, x.start() - 2) : x.start()] in (": ", "| ", "= ")
            if fam in names.family or line or x.start() in behind or _TITLE_BEFORE.search(t, max(0, x.start() - 12), x.start()):
                yield x.start("v"), b


def _columns(t: str) -> Iterator[tuple[int, int]]:
    """The fields of columns that a line of headings says hold persons, in tables with | or ; or tabs."""
    at, cols, sep = 0, [], ""
    for line in t.splitlines(keepends=True):
        if not sep:
            for s in ";|\t":
                cells = [c.strip().strip('"').lower() for c in line.split(s)]
                if len(cells) > 1 and (cols := [k for k, c in enumerate(cells) if _COLUMN.fullmatch(c)]):
                    sep = s
                    break
        elif sep not in line:
            sep = ""
        else:
            cells, a = line.split(sep), at
            for k, c in enumerate(cells):
                if k in cols and (m := _CELL.fullmatch(c)):
                    yield a + m.start("v"), a + m.end("v")
                a += len(c) + len(sep)
        at += len(line)


_GIVEN_ANY = regex.compile(rf"(?:{_TITLE} )?(?P<v>(?P<g>\p{{L}}+)(?:[ -]\p{{L}}+(?=[ ]\p{{L}}+-))?(?: \p{{L}}\.)* {_OF_NAME}?\p{{L}}{{2,}}(?:-\p{{L}}+)?)(?![\p{{L}}\d@_])")
_FIELD_THEN_MAIL = regex.compile(rf"(?P<v>{_FIELD}) ?[(<]")
_TITLE_BEFORE = regex.compile(rf"(?<!\w){_TITLE} $")
_VERBS = set("wrote writes called calls asks asked says said moved escribe pide llamó dice écrit demande dit".split())
_BEFORE_VERB = regex.compile(rf"(?:^|(?<=[\r\n.!?…] ?))(?P<v>{_SHAPE}) $")
_LOW_NAME = rf"\p{{Ll}}{{2,}}(?: \p{{Ll}}\.)? {_OF_NAME}?\p{{Ll}}{{3,}}(?:-\p{{Ll}}+)?"
#: Names in small letters, only where a title, label or verb makes their place sure.
_TITLED_LOW = regex.compile(rf"(?<!\w){_TITLE} (?:{_TITLE} )?(?P<v>{_LOW_NAME})(?![\p{{L}}\d@])")
_LOW_AFTER = regex.compile(rf"(?:{_TITLE} )*(?P<v>{_LOW_NAME})(?= ?(?:[,.;:|(<\r\n]|$)| (?:at|with|still|for|on|about|um|mit|con|avec)\b)")
_LOW_BEFORE_VERB = regex.compile(rf"(?:^|(?<=[\r\n]))(?P<v>{_LOW_NAME}) $")
_COLUMN = regex.compile(rf"(?i)(?:{_PERSON})")
_CELL = regex.compile(rf'\s*"?(?:{_TITLE} )?(?P<v>{_FIELD})"?\s*')


# Words that streets are called by, whole or as a word's end.
_STREETS_EN = frozenset("road rd street st avenue ave lane ln terrace court ct boulevard blvd drive dr way close square place row".split())
_STREETS_FR = frozenset("rue avenue av bd boulevard impasse quai chemin allée place cours route square".split())
_STREETS_OTHER = frozenset("am an im auf zum zur calle avda avenida plaza paseo camino ronda travesía".split())
_STREETS = _STREETS_EN | _STREETS_FR | _STREETS_OTHER | {"c"}
_STREET_ENDS = ("straße", "strasse", "str", "gasse", "weg", "allee", "platz", "ufer", "ring", "damm")
# Words of titles, particles inside names, and words of which labels and phrases before a name have at least one.
_TITLE_WORDS = "dr mr mrs ms miss herr herrn frau mme mlle monsieur madame señor señora sr sra don doña".split()
_PARTICLE_WORDS = "van von della ten ter".split()
_PERSON_WORDS = frozenset((
    "caller recipient contact customer client holder owner assignee reporter requester employee patient applicant author sender signatory attn fullname surname name anrufer anruferin empfänger empfängerin "
    "ansprechpartner ansprechpartnerin kontakt kundin kunde inhaber inhaberin absender absenderin melder melderin bearbeiter bearbeiterin mitarbeiter mitarbeiterin destinatario destinataria contacto cliente titular "
    "remitente solicitante empleado interlocutor interlocutora destinataire titulaire expéditeur demandeur appelant appelante interlocuteur apellidos completo prénom nachname nombre nom"
).split())
_LABEL_WORDS = (
    "signed reported assigned approved reviewed written requested submitted sent received collected confirmed verified opened closed handled called raised spoke talked behalf "
    "unterschrieben gemeldet erfasst bearbeitet zugewiesen namen gesprochen adresse avisado firmado asignado titular nombre nom hablé dirección signalé signé assigné attribué parlé row from von de to para an à"
).split()
_ONLY_AT_START = frozenset("from von de to para an à".split())


def _triggers(given: frozenset[str]) -> ahocorasick.Automaton:
    """One automaton over the words that open a window for a detector; a value is (length, kinds)."""
    kinds: dict[str, list[str]] = {}
    for kind, ws in (("given", given), ("street", _STREETS), ("end", _STREET_ENDS), ("verb", _VERBS), ("close", _CLOSES), ("title", _TITLE_WORDS), ("particle", _PARTICLE_WORDS), ("label", _LABEL_WORDS), ("person", _PERSON_WORDS)):
        for w in ws:
            kinds.setdefault(w, []).append(kind)
    a = ahocorasick.Automaton()
    for w, ks in kinds.items():
        a.add_word(w, (len(w), tuple(ks)))
    a.make_automaton()
    return a


def _hits(t: str, names: Names) -> dict[str, list[tuple[int, int]]]:
    """Spans of the trigger words of ``t`` by kind, in order; letters whose lower case is longer than one character stay as they are."""
    low, n = t.lower(), len(t)
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in ("given", "street", "verb", "close", "title", "particle", "label")}
    for last, (size, kinds) in names.triggers.iter(low):
        a, b = last - size + 1, last + 1
        if b < n and low[b].isalpha():
            continue
        if a and low[a - 1].isalpha():
            if "end" in kinds:
                out["street"].append((a, b))
            continue
        for k in kinds:
            if k == "person":
                if ":" in low[b : b + 3] or "=" in low[b : b + 3]:
                    out["label"].append((a, b))
                continue
            if k == "label" and low[a:b] in _ONLY_AT_START and (low[b : b + 1] != ":" or a and low[a - 1] != "\n"):
                continue
            out["street" if k == "end" else k].append((a, b))
    for v in out.values():
        v.sort()
    return out


_INITIALS = re.compile(r"(?<![^\W\d_])[^\W\d_]\.")
#: Runs of capitals, digits and what joins them; those with as many digits as any number that is looked for are looked at.
_RUN = re.compile(r"[A-Z\d][A-Z\d ()./-]{6,}")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?:[T ]\d\d)?[ .)]*")
_LONG_TOKEN = re.compile(r"[A-Z\d]{9}")


def _runs(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(t) if ((n := sum(map(m[0].count, "0123456789"))) >= 6 or n > 1 and _LONG_TOKEN.search(m[0])) and not _DATE.fullmatch(m[0])]


def _windows(hits: list[tuple[int, int]], around: int, length: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text that reach ``around`` characters beyond each hit, joined where they meet; hits in order."""
    low = high = None
    for a, b in hits:
        if low is not None and a - around <= high:
            high = b + around
            continue
        if low is not None:
            yield low, min(high, length)
        low, high = max(0, a - around), b + around
    if low is not None:
        yield low, min(high, length)


_HOUSE_BEFORE = re.compile(r"\d[A-Za-z]? (?:[^\W\d_][\w'’-]* ?){1,4}$")
_AFTER_NUMBER = re.compile(r"\d(?: ?(?:bis|ter|quater|[a-z]))?,? $", re.I)


def _may_be_street(t: str, a: int, b: int) -> bool:
    """Whether a number stands where an address with this street word has one: some words before an English one, just before a French one, behind others."""
    w = t[a:b].lower()
    if w in _STREETS_EN and _HOUSE_BEFORE.search(t, max(0, a - 60), a) or w in _STREETS_FR and _AFTER_NUMBER.search(t, max(0, a - 12), a):
        return True
    if w == "c":
        return t[b : b + 1] == "/" and bool(_DIGIT.search(t, b, b + 60))
    if w in _STREETS_OTHER:
        return bool(_DIGIT.search(t, b, b + 60))
    return w in _STREET_ENDS and bool(_DIGIT.search(t, b, b + 3))


def find(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each personal value of ``text`` in order, without overlaps; of overlapping ones emails go before addresses, labelled numbers,
    phones, unlabelled numbers and names."""
    if not text:
        return []
    mapped = deobfuscate(text)
    t = mapped[0]
    got: list[tuple[int, int, str]] = []
    taken = bytearray(len(t))

    def add(a: int, b: int, kind: str) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            got.append((a, b, kind))

    n, hits = len(t), _hits(t, names)
    if "@" in t:
        for m in _EMAIL.finditer(t):
            add(*m.span(), "email")
    streets = list(_windows([(a, b) for a, b in hits["street"] if _may_be_street(t, a, b)], 110, n))
    for m in (m for w in streets for m in _ADDRESSES.finditer(t, *w)):
        add(m.start(), _trimmed(t, *m.span()), "address")
    runs = list(_windows(_runs(t), 60, n))
    for m in (m for w in runs for m in _LABELLED.finditer(t, *w)):
        add(*m.span("v"), "id_number")
    for m in (m for w in runs for m in _PHONE.finditer(t, *w)):
        v = m[0]
        if len(v) == 9 and v.isdigit() and v[:3] in ("000", "666") or _of_thing(t, *m.span()):
            continue
        if _LIKE_ID.fullmatch(v):
            continue
        add(*m.span(), "phone")
    for m in (m for w in runs for m in _TYPED.finditer(t, *w)):
        if not _of_thing(t, *m.span()):
            add(*m.span(), "id_number")
    for m in (m for w in streets for m in _OPEN_ADDRESSES.finditer(t, *w)):
        add(m.start(), _trimmed(t, *m.span()), "address")
    mails = [(a, b) for a, b, k in got if k == "email"]
    phones = [(a, b) for a, b, k in got if k == "phone"]
    for a, b in [*_open_names(t, names, hits, mails, phones), *(_columns(t) if "|" in t or ";" in t or "\t" in t else ())]:
        b = _trimmed(t, a, b)
        if " " in t[a:b] or "," in t[a:b] or "." in t[a:b]:
            if _likely(t[a:b]):
                add(a, b, "name")
    return [(*source_span(mapped, a, b, len(text)), k) for a, b, k in sorted(got)]


_DIGIT = re.compile(r"\d")


def redact(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with each found value replaced by its kind in brackets and all else unchanged."""
    if not found or text is None:
        return text
    out, last = [], 0
    for a, b, kind in found:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def found_values(docs: DataFrame, key: str, text: str = "text", names: Names | None = None) -> DataFrame:
    """(key, pii_kind, found_text, start_char, end_char): every personal value of each text, exactly as it stands there. Null and empty texts have none.

    One narrow stage: texts are read whole, nothing is shuffled, and a text of any length is scanned once per detector.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = names or Names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, kd, t[s:e], s, e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, e, kd in find(t, names)]
            cols = list(zip(*rows)) or [[]] * 5
            types = [b.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names=[key, "pii_kind", "found_text", "start_char", "end_char"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, pii_kind string, found_text string, start_char int, end_char int")


def redacted(docs: DataFrame, key: str, text: str = "text", names: Names | None = None) -> DataFrame:
    """(key, text): each text with typed placeholders in place of its personal values; null stays null."""
    kind = docs.schema[key].dataType.simpleString()
    names = names or Names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t, find(t, names)) for t in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, text string")
