"""Problem 10: personal data in free text, by labelers that vote, EM over their votes, and a span classifier trained on the outcome."""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.linear import train
from lexiweave.llm.word_map import KnownWords, known_words
from lexiweave.sources.workdir import stored

KINDS = ("email", "phone", "id_number", "address", "name")
#: Spans of each kind that the classifier is trained on at most; a bounded sample, as its labels come from counts over all.
TRAIN_SPANS = 20_000
#: Weights of one kind's classifier.
FEATURES = 1 << 14
#: A word is a name of the corpus if this share of its places in pairs of capitals are introductions of a person.
INTRODUCED_SHARE = 0.05

# ---- candidates: wide nets; what they hold beside personal data is for the votes to throw out

_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*\w ?@ ?\w[\w-]*(?:\.[\w-]+)*")
_SPELT_EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]*\w ?(?:\(at\)|\[at\]|\{at\}| AT ) ?\w[\w-]*(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot | DOT |\.) ?\w[\w-]*)+"
    r"|(?<![\w.+-])[\w.+-]*\w at \w[\w.-]*(?:(?: ?\(dot\) ?| dot )\w[\w-]*)+"
)
_MAYBE_SPELT = re.compile(r"[(\[{]at[)\]}]| AT | dot |[(\[{]dot[)\]}]")
_DIGITS = re.compile(r"\d+")
_NUMBER = re.compile(r"(?<![\w.,+/=-])(?:\+ ?)?\(?\d{1,5}\)?(?:(?: \(0\) ?|[ .\-/]| - )?\(?\d{1,5}\)?){0,6}(?![\w])|(?<![\w.,+/=-])\+?\d{7,15}(?!\w)")
#: Documents of persons: letters and digits in groups.
_CODE = re.compile(r"(?<!\w)(?:[XYZ]-?\d{7}-?[A-Z]|\d{2}[A-Z]{2}\d{5}|[A-Z]{1,3}[ -]?\d{2}(?:[ -]?\d{2}){1,3}(?: ?[A-Z])?|[A-Z]{1,3}-?\d{5,9}[A-Z]?|\d{7,9}-?[A-Z]|\d{3}[ -]\d{2}[ -]\d{4}|[A-Z0-9]\d{8}|[A-Z]{2}\d{2}[A-Z]{2}\d{3}|\d{3}[ -]\d{3}[ -]\d{3}|\d{6}[ -]?\d{3,5}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}|[12][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{3}[ ]?\d{3}(?:[ ]?\d{2})?)(?!\w)")
#: Words for streets, by where the number stands.
_STREETS = r"street|st|road|rd|lane|ln|drive|dr|avenue|ave|close|crescent|cres|way|court|ct|place|pl|terrace|row|hill|walk|square|sq|boulevard|blvd|gardens|grove|mews|parade|highway|alley|circle|park|quay|rise|view|green|gate"
_ROMANCE = r"calle|avenida|avda\.?|plaza|paseo|camino|c/|via|viale|piazza|corso|rua|carrer|travessa|largo"
_FRENCH = r"rue|chemin|avenue|place|boulevard|allée|quai|impasse|cours|route|square|passage|sentier"
_GERMAN = r"straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|damm|steig|stieg|hof|berg|markt"
_NUMBER_FIRST = re.compile(
    rf"\d{{1,4}}[A-Za-z]?(?: (?:bis|ter))?,? (?:{_FRENCH})(?: (?:du|de la|des|de|d'|de l'))?\s?[\w'’-]+(?![\w])"
    rf"|\d{{1,4}}[A-Za-z]? (?:[^\W\d_][\w'’-]* ){{1,3}}?(?:{_STREETS})(?!\w)",
    re.I,
)
_NUMBER_LAST = re.compile(
    rf"(?<![\w])(?:{_ROMANCE}) ?(?:de |del |de la |da |do )?[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*)?,? (?:n\.?º? ?)?\d{{1,4}}[A-Za-z]?(?!\w)"
    rf"|(?<![\w])[^\W\d_][\w-]{{0,40}}(?:{_GERMAN}),? \d{{1,4}}(?: ?[a-zA-Z])?(?!\w)"
    rf"|(?<![\w])(?-i:Am|An der|Auf der|Zum|Zur|Alte|Neue|Große|Lange|Kurze) [^\W\d_][\w-]{{0,30}}(?: ?(?:{_GERMAN}))?,? \d{{1,4}}(?: ?[a-zA-Z])?(?!\w)",
    re.I,
)
_STREET_BEFORE = re.compile(rf"(?:{_ROMANCE}) |c/|(?:{_GERMAN}),? $|\b(?-i:Am|An der|Auf der|Zum|Zur|Alte|Neue|Große|Lange|Kurze) ", re.I)
#: What every text has that _STREET_BEFORE finds, looked for first.
_STREET_SIGNS = tuple(w.replace("\\.?", "").replace("\\.", ".").lower() for w in f"{_ROMANCE}|{_GERMAN}|am |an der |auf der |zum |zur |alte |neue |große |lange |kurze ".split("|"))
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CAP = r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|['’](?=[A-Z]))+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)*"
_CAP_RUN = re.compile(rf"(?<![\w@.+-]){_CAP}(?:(?: [A-Z]\.)* {_CAP})+(?![\w@]|[._+-]\w)")
_TURNED = re.compile(rf"(?<![\w@.+-]){_CAP}, {_CAP}(?: [A-Z]\.)?(?![\w@]|[._+-]\w)")
#: Words that introduce a person, in five languages: titles, telling one's name, closings of letters, telling who wrote.
_TITLES = "mr mrs ms miss mx dr prof professor sir madam herr frau fräulein señor señora sr sra don doña monsieur madame mme mlle signor signora sig dott".split()
_CALLED = ("my name is", "name is", "name's", "i am", "i'm", "this is", "name:", "name =", "name=", "called", "signed", "signed:", "regards,", "regards", "sincerely,", "sincerely", "yours,", "cheers,", "best,", "love,", "mein name ist", "ich heiße", "ich heisse", "ich bin", "grüße,", "gruß,", "grüßen,", "je m'appelle", "je suis", "mon nom est", "cordialement,", "amitiés,", "me llamo", "mi nombre es", "soy", "saludos,", "atentamente,", "mi chiamo", "sono", "saluti,", "written by", "author:", "contact:", "contact", "dear", "hello", "hi")
_INTRODUCING = (*_CALLED, *_TITLES, *(f"{t}." for t in _TITLES))


def introduced(before: str) -> bool:
    """True for a line that ends with words that introduce a person."""
    low = before.lower()
    low = low[:-1] if low[-1:].isspace() else low
    return low.endswith(_INTRODUCING) and any(low.endswith(w) and not low[: -len(w)][-1:].isalnum() for w in _INTRODUCING)


_AFTER_NAME = re.compile(r",? (?:wrote|writes|said|says|schrieb|schreibt|a écrit|écrit|escribió|escribe|ha scritto|scrive)\b ?:?|['’]s? (?:phone|email|address|number)", re.I)
#: Words that stand in capitals beside others but are no person's name: days, months, function words, greetings, titles, points of the compass, kinds of places and bodies.
_NO_NAME = frozenset(
    "saludos cordialement amitiés atentamente saluti grüße gruß grüßen bonjour hola hallo ciao liebe lieber sehr geehrter geehrte cher chère estimado estimada "
    "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo "
    "january february march april may june july august september october november december "
    "the a an and or of in on at by to for from with without is it its it's we i i'm you he she they that this these those what which who when where why how some any each every no not but if so as after before both all my your his her our their there here then than too very just only also please thanks thank dear hello hi regards cheers signed yours sincerely best love welcome sorry yes "
    "der die das und oder mit von zu in im am ist ich wir sie er es mein dein le la les un une et ou de du des je nous il elle el los las y con por yo mi tu il lo gli e di "
    "north south east west upper lower old new grand great saint first second third next last "
    "club street road avenue lane square park bridge river lake mount university college school hospital hotel museum bank company inc ltd corp gmbh team league cup city town county state station airport building center centre hall house room page section chapter version item order ticket part street fair festival market office group society association department ministry church king queen re subject thread quote reply answer question word".split()
) | frozenset(_TITLES)
#: Given names common in Europe and America, as a public seed beside those that the corpus itself introduces.
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew joshua kevin brian george edward peter henry jack oliver harry samuel benjamin adam simon martin philip frank "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley emily donna michelle carol amanda laura helen anna ruth olivia sophie emma alice grace lucy jane rachel hannah julia claire victoria "
    "hans klaus jürgen wolfgang stefan andreas matthias sabine monika petra ursula heike birgit katrin ingrid greta lukas jonas "
    "pierre jean michel philippe nicolas françois luc antoine marie nathalie isabelle sylvie camille chloé élodie amélie "
    "josé antonio juan manuel carlos javier miguel pablo luis maría carmen lucía elena pilar sofía marta "
    "marco giuseppe giovanni luca paolo francesca giulia chiara silvia paola "
    "ahmed mohamed ali omar fatima aisha priya raj ravi anil wei ming yuki hiroshi kenji olga ivan sergei natalia dmitri".split()
)


def capital_pairs(text: str) -> Iterator[tuple[int, int, bool]]:
    """Where two capitalised words stand together, with initials between them, and whether they are part of a longer row of such words.

    Words that are no names are cut off at both ends of a row first.
    """
    for m in _CAP_RUN.finditer(text):
        words = [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(rf"{_CAP}|[A-Z]\.", m[0])]
        while words and text[slice(*words[0])].lower().strip(".") in _NO_NAME:
            words.pop(0)
        cut = len(words)
        while words and text[slice(*words[-1])].lower().strip(".") in _NO_NAME:
            words.pop()
        inner = [k for k, (a, b) in enumerate(words) if text[b - 1] != "." or b - a > 2]
        if len(inner) < 2 or inner[-1] != len(words) - 1:
            continue
        longer = len(inner) > 2 or cut > len(words)
        yield words[inner[-2]][0], words[inner[-1]][1], longer
        if len(inner) > 2:
            yield words[inner[0]][0], words[inner[1]][1], True


def _name_candidates(text: str, given: KnownWords) -> Iterator[tuple[int, int, bool]]:
    """Pairs of capitals, turned ones with a comma, and any two words the first of which is a known given name."""
    yield from capital_pairs(text)
    for m in _TURNED.finditer(text):
        if not {w.lower() for w in _TOKEN.findall(m[0])} & _NO_NAME:
            yield m.start(), m.end(), False
    for first in given.among(set(_TOKEN.findall(text.lower()))) - _NO_NAME:
        for m in re.finditer(rf"(?<![\w@.+'’-]){re.escape(first)}(?: [a-z]\.)?(?: |(?=,))([^\W\d_]{{3,}}(?:-[^\W\d_]+)?)?(?![\w@]|[._+'’-]\w)", text, re.I):
            if m[1] and m[1].lower() not in _NO_NAME:
                yield m.start(), m.end(), False
        for m in re.finditer(rf"(?<![\w@.+'’-])[^\W\d_]{{3,}}(?:-[^\W\d_]+)?, {re.escape(first)}(?: [a-z]\.)?(?![\w@]|[._+'’-]\w)", text, re.I):
            if not {w.lower() for w in _TOKEN.findall(m[0])} & _NO_NAME:
                yield m.start(), m.end(), False


def _candidates(text: str, given: KnownWords) -> list[tuple[str, int, int, bool]]:
    out: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        out += [("email", *m.span(), False) for m in _EMAIL.finditer(text)]
    if _MAYBE_SPELT.search(text):
        out += [("email", *m.span(), False) for m in _SPELT_EMAIL.finditer(text)]
    runs = [m.span() for m in _DIGITS.finditer(text)]
    numbers, codes, places = set(), set(), set()
    k = 0
    while k < len(runs):  # digits that stand near one another, six of them at least
        j, many = k, runs[k][1] - runs[k][0]
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] <= 4 and "\n" not in text[runs[j][1] : runs[j + 1][0]]:
            j += 1
            many += runs[j][1] - runs[j][0]
        if many >= 5:
            a, b = max(0, runs[k][0] - 9), runs[j][1]
            for m in _NUMBER.finditer(text, a):
                if m.start() >= b:
                    break
                if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                    c = m[0]
                    whole = c[0] == "(" and c[-1] == ")" and c.count("(") == c.count(")") == 1  # brackets round all of it are none of its own
                    numbers.add((m.start() + whole, m.end() - (whole or c.count(")") > c.count("("))))
            for m in _CODE.finditer(text, a):
                if m.start() >= b:
                    break
                if sum(c.isdigit() for c in m[0]) >= 5:
                    codes.add(m.span())
        k = j + 1
    for a, b in runs:
        if b - a > 4:
            continue
        if (not a or not (text[a - 1].isalnum() or text[a - 1] in "_.-=/?&#")) and (m := _NUMBER_FIRST.match(text, a)):
            if not any(w in _NO_STREET for w in m[0].lower().split()[1:-1]):
                places.add(m.span())
        start = max(text.rfind("\n", 0, a) + 1, a - 70)
        ahead = text[start:a].lower()
        if any(w in ahead for w in _STREET_SIGNS) and _STREET_BEFORE.search(text, start, a):
            places |= {m.span() for m in _NUMBER_LAST.finditer(text, start, min(len(text), b + 3)) if m.end() >= b and a < m.end()}
    out += [("phone", *s, False) for s in numbers]
    out += [("id_number", *s, False) for s in codes | {s for s in numbers if 8 <= sum(c.isdigit() for c in text[s[0] : s[1]]) <= 11}]
    out += [("address", *s, False) for s in places]
    names: dict[tuple[int, int], bool] = {}
    for a, b, longer in _name_candidates(text, given):
        names[a, b] = names.get((a, b), False) or longer
    return out + [("name", a, b, longer) for (a, b), longer in names.items()]


# ---- labelers: +1 it is, -1 it isn't, 0 can't say. For each kind a form (regex), a list (gazetteer, or check digits) and a context.

_PHONE_FORMS = re.compile(
    r"\+ ?\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,8}){1,5}|00\d{2}[ .-]?\d{1,5}(?:[ .-]?\d{2,8}){1,4}|(?:1[ .-])?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}|1?[2-9]\d{2}[2-9]\d{6}"
    r"|0\d([ .]?)\d{2}\1\d{2}\1\d{2}\1\d{2}|0\d{2} \d{4} \d{4}|0\d{4} ?\d{3} ?\d{3}|0\d{2}[ /]\d{5}[ -]\d{3}|\(?0\d{2,5}\)?[ /-]\d{3,8}(?:[ -]\d{2,5})?|[6-9]\d{2}[ .]?\d{3}[ .]?\d{3}|[6-9]\d{2} \d{2} \d{2} \d{2}|3\d{2} \d{3} ?\d{4}"
)
#: Formats of documents of persons (social security, insurance, identity card, passport, driving licence, tax).
_ID_FORMS = re.compile(
    r"\d{3}([ -]?)\d{2}\1\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-HJ-NP-TV-Z]|[A-Z]{1,2}\d{6,8}|[A-Z]{3}\d{6}|[XYZ]-?\d{7}-?[A-Z]|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}"
    r"|\d{9}|\d{3} ?\d{3} ?\d{3}|\d{11}|\d{2} ?\d{3} ?\d{3} ?\d{3}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|\d{2}[A-Z]{2}\d{5}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|\d{6}-\d{4,5}"
)
#: What stands near such things, in five languages, and near numbers that are none of them.
_PHONE_WORDS = re.compile(r"\b(?:call\w*|tel|tél|telephone|téléphone\w*|telefon\w*|teléfono|phone\w*|mobile|móvil|cell|cellulare|handy\w*|whatsapp|sms|text|fax|dial|ring|ruf\w*|anruf\w*|nummer|numéro|número|numero|number|line|ll[aá]m\w*|appel\w*|chiam\w*|joindre|portable|voicemail|hotline|reach\w*)\b", re.I)
_ID_WORDS = re.compile(r"\b(?:ssn|social security|nin?o?|ni number|national (?:id|insurance|identity)|passport\w*|id(?:entity|entification)?(?: card| no| number|-?nummer|-?karte)?|identit\w*|identidad|dni|nie|nif|cédula|curp|\w*ausweis\w*|reisepass\w*|passeport|pasaporte|passaporto|insurance (?:number|no)|licen[cs]e|permis|führerschein\w*|tax (?:id|number)|steuer\w*|codice fiscale|sozialversicherung\w*|sécurité sociale|seguridad social|nhs|bsn|pesel|visa (?:number|no)|documento?s?|dokument\w*|carte|carnet|medicare|medical card)\b", re.I)
_OTHER_NUMBER = re.compile(r"(?:\b(?:order|ticket|isbn|issn|ean|version|item|invoice|page|room|score|thread|post|ref|reference|serial|model|sku|tracking|code|part|port|ip|year|bestellung|rechnung|artikel|commande|facture|pedido|factura|build|error|line|chapter|lot|parcel)\b(?: ?(?:no|nr|number|code|id)\b)?\.?|id=|http\S*|0x\w*|[#$€£=])\W{0,3}\w{0,4}$", re.I)
_PLACE_WORDS = re.compile(r"(?:\b(?:li(?:ve|ves|ved|ving)|mov(?:e|ed|ing)|stay\w*|resid\w+|address\w*|home|house|flat|send|sent|ship\w*|deliver\w*|post|mail\w*|parcel|package|letter|visit\w*|meet\w*|come|office|shop|located|reach|find|pick\w*|collect\w*|drop\w*|at|from|to|near|wohn\w+|adresse|anschrift|zuhause|treff\w*|liefer\w*|paket|habit\w*|domicile|rendez-vous|livr\w*|viv\w+|direcci[oó]n|domicilio|enví\w*|abit\w*|indirizzo|spedi\w*)\b[^\n.!?]{0,12}|[:;|/>]\s?|^)$", re.I | re.M)
#: Words that are no part of a street's name.
_NO_STREET = frozenset("page room people persons section line list years minutes hours days points votes words round thread times percent of on in by is are was the a an and or about with have has had that this for more than people's km miles if it its it's we i you he she they what which who when where how not but then so".split())
_TLD = re.compile(r"\.(?:test|example|invalid|localhost|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|online|[a-z]{2})$", re.I)
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def check_digits(code: str) -> int:
    """1 if a document's number of a kind with check digits is right, 0 if its kind has none or it doesn't fit."""
    c = re.sub(r"[ -]", "", code.upper())
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", c):
        return int(_DNI_LETTERS[int(str("XYZ".find(c[0])) + c[1:-1] if c[0] in "XYZ" else c[:-1]) % 23] == c[-1])
    if re.fullmatch(r"[12]\d{14}", c):
        return int(97 - int(c[:13]) % 97 == int(c[13:]))
    if re.fullmatch(r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]", c):
        return 1
    if re.fullmatch(r"\d{9}", c):
        ssn = c[:3] not in ("000", "666") and c[0] != "9" and c[3:5] != "00" and c[5:] != "0000" and "-" in code
        return int(ssn or sum(int(d) * w for d, w in zip(c, (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0)
    if re.fullmatch(r"\d{11}", c):
        return int((10 - sum(int(d) * w for d, w in zip(c, (1, 3, 7, 9) * 3)) % 10) % 10 == int(c[10]) if len(c) == 11 else 0)
    return 0


def _line_before(text: str, at: int, most: int = 40) -> str:
    return text[max(text.rfind("\n", max(0, at - most), at) + 1, at - most, 0) : at]


def _told_apart(before: str) -> int:
    """1 if the last word that tells of numbers tells of a person's document, -1 if of telephones, 0 if there is none."""
    document = max((m.start() for m in _ID_WORDS.finditer(before)), default=-1)
    phone = max((m.start() for m in _PHONE_WORDS.finditer(before) if m[0].lower() not in ("number", "nummer", "numéro", "número", "numero", "line")), default=-1)
    return (document > phone) - (phone > document)


def _votes(kind: str, text: str, a: int, b: int, longer: bool, given: KnownWords, family: KnownWords) -> list[int]:
    span, before, after = text[a:b], _line_before(text, a), text[b : b + 24]
    if kind == "email":
        plain = re.sub(r" ?(?:\(at\)|\[at\]|\{at\}| at | AT |@) ?", "@", span)
        plain = re.sub(r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot | DOT ) ?", ".", plain)
        form = 1 if re.fullmatch(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,24}", plain) else -1
        return [form, 1 if _TLD.search(plain) else -1, 1 if re.search(r"mail|write|reach|ask|contact|address|send|schreib|écri|courriel|corr?eo|escr[ií]b|scriv|[|;:=(<]\s*$", before, re.I) else 0]
    if kind == "phone":
        digits = re.sub(r"\D", "", span)
        form = 1 if _PHONE_FORMS.fullmatch(span) else -1
        north = len(digits) in (10, 11) and digits.lstrip("1")[:1] in [*"23456789"] and digits[-7:-6] in [*"23456789"] and (len(digits) == 10 or digits[0] == "1")
        known = (span[0] == "+" and 8 <= len(digits) <= 15) or (digits[0] == "0" and 9 <= len(digits) <= 14) or north
        context = -1 if _OTHER_NUMBER.search(before) or _told_apart(before) > 0 else 1 if _PHONE_WORDS.search(before) or _PHONE_WORDS.search(text[b : b + 20].partition("\n")[0]) else 0
        return [form, 1 if known else -1, context]
    if kind == "id_number":
        return [1 if _ID_FORMS.fullmatch(span) else -1, check_digits(span), 1 if _told_apart(before) > 0 else -1]
    if kind == "address":
        words = span.lower().replace(",", " ").split()
        odd = any(w in _NO_STREET for w in words[1:-1] or words)
        return [-1 if odd or len(words) > 6 else 1, 1 if sum(w[:1].isupper() for w in span.split()) >= 1 and not odd else 0 if not odd else -1, 1 if _PLACE_WORDS.search(before) else -1 if _OTHER_NUMBER.search(before) else 0]
    parts = [p.lower() for p in _TOKEN.findall(span) if len(p) > 1]
    first, last = (parts[-1], parts[0]) if "," in span else (parts[0], parts[-1])
    capitals = all(w[0].isupper() for w in _TOKEN.findall(span))
    form = -1 if longer or set(parts) & _NO_NAME or len(parts) < 2 else 1 if capitals else 0
    is_given, is_family = first in given, last in family or all(x in family for x in last.split("-"))
    listed = 1 if is_given and (is_family or capitals) else 0 if is_given or (is_family and capitals) else -1
    intro = introduced(before) or _AFTER_NAME.match(after)
    alone = not before.strip(" >-–—~*_|:;&=") and not re.match(r"[^\n|;]*\w", after)
    return [form, listed, 1 if intro or alone else -1 if not capitals and not (is_given and is_family) else 0]


def _shape(s: str) -> str:
    return re.sub(r"(.)\1{2,}", r"\1\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"\d", "9", s))))[:24]


def _features(kind: str, text: str, a: int, b: int, votes: list[int]) -> list[int]:
    """Hashed: the votes one by one and together, the span's shape, the words around it, and for names the ends and beginnings of their parts."""
    span = text[a:b]
    near = [re.sub(r"\d", "9", w) for w in re.findall(r"[^\W_]+|[:;|/=(]", _line_before(text, a).lower())[-2:]]
    then = [re.sub(r"\d", "9", w) for w in re.findall(r"[^\W_]+|[:;|/=&)]", text[b : b + 24].lower())[:1]]
    names = [f"v{i}={v}" for i, v in enumerate(votes)] + ["v=" + ",".join(map(str, votes)), "s=" + _shape(span)]
    names += [f"b{i}={w}" for i, w in enumerate(reversed(near))] + [f"a={w}" for w in then]
    if kind == "name":
        parts = [p.lower() for p in _TOKEN.findall(span)[:3]]
        names += [f"e{i}={p[-3:]}" for i, p in enumerate(parts)] + [f"g{i}={p[:3]}" for i, p in enumerate(parts)]
    return [zlib.crc32(f"{kind}|{n}".encode()) % FEATURES for n in names]


# ---- Spark


def _introduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """part (0 given, 1 family), word, in how many pairs of capitals it stands there, and how many of them introduce a person."""
    for f in frames:
        pairs: Counter = Counter()
        strong: Counter = Counter()
        for text in f["text"]:
            found = set()
            for a, b, longer in capital_pairs(text):
                parts = [p.lower() for p in _TOKEN.findall(text[a:b]) if len(p) > 1]
                if len(parts) == 2 and not set(parts) & _NO_NAME:
                    told = not longer and bool(introduced(_line_before(text, a)) or _AFTER_NAME.match(text[b : b + 24]))
                    found |= {((0, parts[0]), told), *(((1, w), told) for w in {parts[1], *parts[1].split("-")})}
            for key, told in found:
                pairs[key] += 1
                strong[key] += told
        yield pd.DataFrame([(p, w, n, strong[p, w]) for (p, w), n in pairs.items()], columns=["part", "word", "n", "told"])


def gazetteer(documents: DataFrame) -> tuple[KnownWords, KnownWords]:
    """Given and family names: words of pairs of capitals that introduce a person often enough, by exact counts over all texts; given names have a public seed."""
    counted = documents.select("text").mapInPandas(_introduced, "part int, word string, n long, told long").groupBy("part", "word").agg(F.sum("n").alias("n"), F.sum("told").alias("told"))
    names = stored(counted.where((F.col("told") > 0) & (F.col("told") >= INTRODUCED_SHARE * F.col("n"))).select("part", "word"), "p10-names")
    return known_words(names.where("part = 0").select("word"), more=GIVEN_NAMES), known_words(names.where("part = 1").select("word"))


_SPANS = "doc_id long, kind string, a int, b int, found_text string, votes string, features array<int>"


def _spans(given: KnownWords, family: KnownWords):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _SPANS.split(", ")]
        for f in frames:
            rows = []
            for doc_id, text in f.itertuples(index=False):
                for kind, a, b, longer in _candidates(text, given):
                    v = _votes(kind, text, a, b, longer, given, family)
                    rows.append((doc_id, kind, a, b, text[a:b], ",".join(map(str, v)), _features(kind, text, a, b, v)))
                if len(rows) > 5_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return run


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """EM over the counts of each pattern of votes (a labeler's errors don't depend on the others'): how likely each pattern is true.

    It starts from the majority of votes; ties count as half. A labeler keeps a chance of 1 in 100 of any vote.
    """
    votes = np.array([p for p, _ in patterns])
    count = np.array([n for _, n in patterns], float)
    sure = 1 / (1 + np.exp(-2.0 * votes.sum(axis=1)))
    for _ in range(rounds):
        prior = np.clip((count * sure).sum() / count.sum(), 0.01, 0.99)
        like = np.stack([np.full(len(count), np.log(prior)), np.full(len(count), np.log(1 - prior))])
        for j in range(votes.shape[1]):
            for y, weight in enumerate((count * sure, count * (1 - sure))):
                p = np.array([(weight * (votes[:, j] == v)).sum() for v in (-1, 0, 1)]) / max(weight.sum(), 1e-9)
                p = (p + 0.01) / 1.03
                like[y] += np.log(p[votes[:, j] + 1])
        new = 1 / (1 + np.exp(like[1] - like[0]))
        if np.abs(new - sure).max() < 1e-6:
            break
        sure = new
    return {tuple(int(v) for v in p): float(s) for (p, _), s in zip(patterns, sure)}


def _score(weights: dict[str, np.ndarray]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = [float(weights[k][np.asarray(x, np.int64)].sum() + weights[k][-1]) for k, x in zip(f["kind"], f["features"])]
            yield f[["doc_id", "kind", "a", "b", "found_text"]].assign(score=p)

    return run


def _apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where two spans of a document overlap the one of the earlier kind stays, of one kind the surer, then the longer."""
    for f in frames:
        rows = []
        for doc_id, spans in f.itertuples(index=False):
            taken: list[tuple[int, int]] = []
            for kind, a, b, text, _ in sorted(((s["kind"], s["a"], s["b"], s["found_text"], s["score"]) for s in spans), key=lambda s: (KINDS.index(s[0]), -(s[2] - s[1]), -s[4], s[1])):
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    rows.append((doc_id, kind, a, b, text))
        yield pd.DataFrame(rows, columns=["doc_id", "kind", "a", "b", "found_text"])


def find_spans(documents: DataFrame, *, train_spans: int = TRAIN_SPANS) -> DataFrame:
    """doc_id, kind, a, b, found_text: personal data in the whole texts, at characters a to b; no two spans of a document overlap.

    Wide patterns give candidates. For each kind a form, a list and a context labeler vote on all of
    them; EM over the counts of all vote patterns estimates how far each labeler can be trusted. The
    resulting probabilities are the targets of a linear span classifier on hashed features, trained on
    a sample of at most `train_spans` candidates of each kind; it decides on every candidate.

    Null, empty and blank texts hold nothing. A document with a null doc_id is left out; documents of
    one doc_id should be equal. A document without enough candidates of a kind for training takes the votes' majority.
    """
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    given, family = gazetteer(docs)
    spans = stored(docs.mapInPandas(_spans(given, family), _SPANS), "p10-spans")
    counts = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 27 patterns a kind
    weights: dict[str, np.ndarray] = {}
    for kind in KINDS:
        patterns = sorted((tuple(int(v) for v in r["votes"].split(",")), r["n"]) for r in counts if r["kind"] == kind)
        if not patterns:
            continue
        sure = reliabilities(patterns)
        total = sum(n for _, n in patterns)
        own = spans.where(F.col("kind") == kind)
        # A sample by hash, the same on every run; all of them where there are few.
        share = min(1.0, train_spans / total)
        sample = own.where(F.pmod(F.xxhash64("doc_id", "a", "b"), F.lit(1_000_000)) < int(share * 1_000_000)).select("votes", "features").limit(2 * train_spans).toPandas()
        target = np.array([sure[tuple(int(v) for v in x.split(","))] for x in sample["votes"]])
        if len(sample):
            weights[kind] = train([np.asarray(x, np.int64) for x in sample["features"]], target, FEATURES)
        else:
            weights[kind] = np.zeros(FEATURES + 1)
    if not weights:
        return spans.select("doc_id", "kind", "a", "b", "found_text")
    scored = spans.mapInPandas(_score(weights), "doc_id long, kind string, a int, b int, found_text string, score double").where("score >= 0")
    # One list per document; it is as long as the document's own text allows.
    lists = scored.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "a", "b", "found_text", "score")).alias("spans"))
    return lists.mapInPandas(_apart, "doc_id long, kind string, a int, b int, found_text string")


def personal_data(documents: DataFrame, **how) -> DataFrame:
    """doc_id, kind, found_text: each piece of personal data as it stands in the text, once per post."""
    return find_spans(documents, **how).select("doc_id", "kind", "found_text").distinct()


def _mask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for text, spans in zip(f["text"], f["spans"]):
            if text is not None and spans is not None:
                for s in sorted(spans, key=lambda s: -s["a"]):
                    text = text[: s["a"]] + "[" + s["kind"].upper() + "]" + text[s["b"] :]
            out.append(text)
        yield pd.DataFrame({"doc_id": f["doc_id"], "text": out})


def masked(documents: DataFrame, **how) -> DataFrame:
    """doc_id, text with every piece of personal data replaced by its kind in brackets, such as [EMAIL]. Other texts stay as they are."""
    spans = stored(find_spans(documents, **how), "p10-found").groupBy("doc_id").agg(F.collect_list(F.struct("kind", "a", "b")).alias("spans"))
    return documents.select("doc_id", "text").join(spans, "doc_id", "left").mapInPandas(_mask, "doc_id long, text string")
