"""Personal information inside free text (problem 9).

Method: weak supervision. Spans are proposed generously per type; regex, gazetteer and context labelers vote on each
(1 for, -1 against, 0 no opinion); expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is and how likely each pattern is right; these probabilities train a logistic classifier per type over votes and features of the
span and its surroundings, which decides every span.

What is fitted: reliabilities on the vote patterns of all spans (the patterns, not the rows, go to the driver: at most 3 to the
number of labelers); classifier weights on at most ``sample_spans`` spans per type, a sample taken by hash of the id. Everything
else covers all documents, also the count of given names that stand before family names.

Gazetteers: given and family names of the roster (a table of fixed size, checked against ``max_roster``), and given names counted before
family names (checked against ``max_given``). Family names are
also recognised by their parts: beginnings and endings that recur among the roster's family names, in any combination.

Defined cases: null and empty texts have no spans; offsets count code points of the stored text; overlapping spans: the
longer and more probable one stays, and names inside e-mails or street addresses go; in texts all in lower or upper case letter case is no evidence;
repeated texts are labelled each; a doc_id that occurs twice gives distinct rows; null roster names are skipped; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.plans.lineage import land

TYPES = ("email", "phone", "id_number", "street_address", "person_name")

_AT = r"(?:\s?(?:@|＠|\(at\)|\[at\]|\{at\}|&#64;|&commat;)\s?)"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|[ ]dot[ ]|&#46;|&period;)"
_LOCAL = r"(?:[^\W]|[.+\-]|&#(?:46|43|45|95);)+"
EMAIL = re.compile(rf"(?<![\w.+\-;&#])(?:{_LOCAL}){_AT}(?:[^\W_][\w\-]*)(?:{_DOT}[^\W_][\w\-]*)*", re.I)
#: What an address can't do without, quicker to seek than the whole pattern.
_AT_SIGNS = ("@", "＠", "(at)", "[at]", "{at}", "&#64;", "&commat;")
_EMAIL_END = re.compile(rf"{_DOT}(?:[a-z]{{2,10}})$", re.I)

PHONE = re.compile("|".join((
    r"(?:\+|00)\d{1,3}[\s.\-]?(?:\(0\)\s?)?\(?\d{1,5}\)?(?:[\s.\-/]?\d{2,8}){1,5}",
    r"(?:\+?1[\s.\-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.\-]?)\d{3}[\s.\-]?\d{4}",
    r"\(0\d{1,4}\)\s?\d{3,8}(?:[\s.\-]?\d{2,6})?",
    r"0\d{1,4}[/\s.\-]\d{3,8}(?:[\s.\-]\d{2,6}){0,3}",
    r"0\d(?:[\s.\-]?\d{2}){4}",
    r"0\d{9,10}",
    r"[679]\d{2}[\s.\-]\d{2,3}[\s.\-]\d{2,3}(?:[\s.\-]\d{2,3})?",
)))
_PHONE_HEAD = re.compile(r"(?<![\w.,/\-@#+:(&])(?:" + PHONE.pattern + r")(?:,?\s?(?:ext\.?|x|durchwahl|poste)\s?[^\w\s]?\s?\d{1,5})?(?![\w])(?![.\-/]\d)", re.I)
ID = re.compile("|".join((
    r"(?P<ssn>\d{3}(?P<sep>[\-.\s–]?)\d{2}(?P=sep)\d{4})",
    r"(?P<nino>[a-z]{2}[\s\-.]?\d{2}[\s\-.]?\d{2}[\s\-.]?\d{2}[\s\-.]?[a-d])",
    r"(?P<pass>(?:[a-z]\d|[a-z]{2})[\s\-.]?\d{7}|[a-z]\d{8})",
)), re.I)
_ID_HEAD = re.compile(r"(?<![\w./\-+@#(])(?:" + ID.pattern + r")(?![\w])(?![.\-/]\d)", re.I)

#: Words of streets (fixed lists).
EN_STREET = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|close|crescent|cres|terrace|ter|boulevard|blvd|way|place|square|sq|row|gardens|grove|hill|walk|mews|parkway|pkwy|highway|hwy)"
#: Street words that are also everyday words: taken only where they are capitalised amid lower case.
_EVERYDAY = frozenset("way place row gardens grove hill walk square".split())
_FUNCTION = frozenset("the a an and or of to in on at for with from by is are was it this that than before after minutes hours points items steps times days weeks words people pairs rows records credits mark if".split())
_UNIT = r"(?:(?:flat|apt|apartment|unit|suite|room|floor|no)\.?\s?#?\w{1,4},?\s+)?"
ADDRESS_EN = re.compile(rf"(?<![\w\-./#]){_UNIT}\d{{1,5}}(?:[a-z]\b|-\d{{1,3}}\b)?,?\s(?:[^\W\d_][\w'’\-]*\s){{1,3}}?{EN_STREET}\b\.?", re.I)
ADDRESS_FR = re.compile(r"(?<![\w\-./])\d{1,4}(?:\s?(?:bis|ter|quater|[a-d])\b)?,?\s(?:rue|avenue|boulevard|bd|impasse|chemin|place|allée|quai|route|square|cours|passage|ruelle|sentier|faubourg)\s(?:(?:de\sla|de\sl['’]|des|du|de|d['’]|le|la)\s?)?[^\W\d_][\w'’\-]*(?:[ ][A-ZÀ-Þ][\w'’\-]*)?", re.I)
ADDRESS_ES = re.compile(r"(?<![\w\-./])(?:c/|calle|avenida|avda\.?|av\.|plaza|pza\.?|paseo|camino|carretera|ronda|travesía|callejón|glorieta)\s?(?:(?:de\s(?:la|los|las)|del|de)\s)?[^\W\d_][\w'’\-]*(?:\s[^\W\d_][\w'’\-]*)?,?\s(?:n\.?\s?[º°o]\.?\s?|núm\.?\s?|número\s)?\d{1,4}\b", re.I)
ADDRESS_IT = re.compile(r"(?<![\w\-./])(?:via|viale|vicolo|piazza|piazzale|corso|largo|strada|salita|contrada)\s(?:(?:dei|degli|delle|della|dello|del|di|dell['’])\s?)?[^\W\d_][\w'’\-]*(?:\s[^\W\d_][\w'’\-]*)?,?\s(?:n\.?\s?[º°]?\s?)?\d{1,4}\b", re.I)
ADDRESS_DE = re.compile(r"(?<![\w\-./])(?:(?:(?:am|im|an\sder|auf\sdem|auf\sder|zum|zur|hinter\sdem|unter\sden|alte[rn]?|neue[rn]?|obere[rn]?|untere[rn]?)\s)?[^\W\d_]{2,}(?:straße|strasse|str\.|weg|gasse|allee|platz|zeile|winkel|ring|damm|ufer|steg|stieg|hof|park|graben|markt|chaussee|pfad|twiete)|(?:am|im|an\sder|auf\sdem|auf\sder|zum|zur|hinter\sdem|unter\sden|alte[rn]?)\s[^\W\d_]{3,})\s?\d{1,4}(?:\s?[a-h]\b)?(?!\w)(?![.,]\d)", re.I)
#: What an address can't do without: one of these words, or in German a word that ends or begins in this way.
_EN_WORDS = frozenset(EN_STREET[3:-1].split("|"))
_FR_WORDS = frozenset("rue avenue boulevard bd impasse chemin place allée quai route square cours passage ruelle sentier faubourg".split())
_ES_WORDS = frozenset("c calle avenida avda av plaza pza paseo camino carretera ronda travesía callejón glorieta".split())
_IT_WORDS = frozenset("via viale vicolo piazza piazzale corso largo strada salita contrada".split())
_DE_ENDS = tuple("straße strasse str. weg gasse allee platz zeile winkel ring damm ufer steg stieg hof park graben markt chaussee pfad twiete".split())
_DE_WORDS = tuple("am im der dem den zum zur alte alten alter".split())
_SPLIT = str.maketrans({c: " " for c in map(chr, range(33, 128)) if not c.isalnum()} | {c: " " for c in "’‘“”«»–—…¿¡ \u2002\u2003\u2009\u202f"})
#: Where a telephone or identity number may stand: five digits with at most three dividers between any two, or a plus before a digit.
_NUMBERS = re.compile(r"\+\d(?:[\s.\-–/()]{0,3}\d)*|\d(?:[\s.\-–/()]{0,3}\d){4,}")


def _near(pattern: re.Pattern, text: str, places: list[tuple[int, int]], after: int) -> Iterator[re.Match]:
    """The matches of a pattern for numbers, which begins at most four characters before a place and ends, with what must not follow, ``after`` behind it."""
    end = 0
    for a, b in places:
        for m in pattern.finditer(text, max(end, a - 4), b + after):
            if m.start() >= b:  # of the next place, which has all of it
                break
            end = m.end()
            yield m


_DIGIT_RUN = re.compile(r"\d+")
_HAS_DIGIT = re.compile(r"\d")


def _languages(low: str) -> set[str]:
    """The languages whose addresses may occur in the case-folded text; a single digit is enough of a number."""
    ws = set(low.translate(_SPLIT).split())
    out = {k for k, have in (("en", _EN_WORDS), ("fr", _FR_WORDS), ("es", _ES_WORDS), ("it", _IT_WORDS)) if not have.isdisjoint(ws)}
    for m in _DIGIT_RUN.finditer(low):
        j = m.start()
        j -= j > 0 and low[j - 1].isspace()
        if not j or not low[j - 1].isalpha() and low[j - 1] != ".":
            continue
        if low.endswith(_DE_ENDS, 0, j):
            out.add("de")
            break
        k = j
        while k and low[k - 1].isalpha():
            k -= 1
        if k < j and k and low[k - 1].isspace() and low.endswith(_DE_WORDS, 0, k - 1):
            out.add("de")
            break
    return out


ADDRESSES = (("en", ADDRESS_EN), ("fr", ADDRESS_FR), ("es", ADDRESS_ES), ("it", ADDRESS_IT), ("de", ADDRESS_DE))

#: Context words (fixed lists), on folded text just before or after a span.
_BEFORE = {
    "email": re.compile(r"(?:mailto:|mail:?|e-?mail:?|<|contact|reach|cc|write|escrib\w*|schreib\w*|écri\w*|scriv\w*|address|adresse|dirección|indirizzo|under|to|at|or|and|an|à|a)\W*(?:\w+\W+){0,2}$"),
    "phone": re.compile(r"(?:phone|fax|tel|telephone|mobile|cell|call|number is|reachable|under|ruf\w*|appel\w*|llam\w*|chiam\w*|telefon\w*|numéro|número|numero|nummer|or|/)\W*(?:\w+\W+){0,2}$"),
    "id_number": re.compile(r"(?:ssn|social security|security number|insurance|nino|passport|passeport|pasaporte|passaporto|reisepass|ausweis|personalausweis|id card|identity|carte d'identité|dni|carta d'identità|documento)\W*(?:(?:number|no|nr|is|n[º°]|was|card|numéro|número|numero)\W*){0,3}$"),
    "street_address": re.compile(r"(?:at|to|address|living|lives?|moved|adresse|lautet|wohn\w*|vivo|vive|abito|abita|dirección|indirizzo|habite|in|en)\W*(?:\w+\W+)?$"),
    "person_name": re.compile(r"(?:name is|name:?|i'm|i am|signed:?|(?:reviewed|written|sent|signed) by|(?:talked|spoke|thanks|wrote) to|with|contact:?|regards,?|wishes,?|sincerely,?|grüßen,?|ich heiße|je m'appelle|me llamo|mi chiamo|saludo,?|saludos,?|saluti,?|cordialement,?|hi|hello|dear|hallo|liebe[r]?|bonjour|hola|ciao|according to|and|[—–]|cc|from|by)\s*$"),
}
_NOT_BEFORE = {
    "email": re.compile(r"$^"),
    "phone": re.compile(r"(?:ssn|security number is|insurance number|insurance no\.?|passport|ticket|case|batch|seed|version|section|run|pair|ratio|score|step|table|row|cost)\W*(?:\w+\W+){0,1}$"),
    "id_number": re.compile(r"(?:ticket|case|batch|seed|version|section|run|pair|form|phone|tel|call|fax|reachable under)\W*(?:\w+\W+){0,1}$"),
    "street_address": re.compile(r"(?:ticket|case|batch|seed|version|section|step|table|row|within|after|lasts)\W*$"),
    "person_name": re.compile(r"(?:judge|the|ask|a|an|our|this|each|every|of|model|hall|@)\s*$"),
}
#: What a person does: verbs of saying, writing and reviewing, and a clause of one's own, after a name.
_AFTER_NAME = re.compile(
    r"\s*(?:(?:said|says|asked|asks|wrote|writes|told|replied|answered|thinks|thought|called|reviewed|sent|explained|noted|agreed|about|hat|sagt\w*|schr(?:ie|ei)b\w*|frag\w*|meint\w*|a|dit|écri\w*|demand\w*|ha|dijo|escrib\w*|dice|scriv\w*|disse|and i|und ich|et je|y|e)\b|, (?:could|can|would) you\b|<|,? ssn\b|, now\b|; \d|, \d|, (?:flat|apt)\b|\||\((?:annotator|reviewer|author|editor)\))")
_NOT_AFTER_NAME = re.compile(r"[\s\-]*(?:hall|street|st\.|road|rd|avenue|ave|lane|drive|court|close|crescent|terrace|blvd|board|week|week\b|card|plus|house|park|school|bridge|programme|team|model|\d+b\b|v\d|road|square|place|step|meeting|report)\b", re.I)
TITLES = frozenset("mr mrs ms miss mx dr dra prof professor sir madam herr frau doktor m mme mlle monsieur madame sr sra srta señor señora don doña dott sig signor signora signorina dr. ing judge".split())
PARTICLES = frozenset("van von de der den del della di da du la le los dos das ten ter zu zur af".split())
#: Words that open a sentence or greeting and can't be a given name before a family name (fixed list).
_NO_GIVEN = frozenset(
    "the a an and or but if when since from by to of in on at for with as is it this that hi hello dear hallo contact name signed reviewed regards best wishes thanks thank according please post call send ask my our your his her their i you we they he she "
    "der die das ein eine und mit ich sie er wir liebe lieber grüßen le les une un et avec je il elle cordialement el los las y con un una saludo saludos lo gli e con saluti cordiali address phone mail fax ssn id table row step lane score pair run form model card".split())
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ'’][^\W\d_]+)*(?:[-‐‑][^\W\d_]+(?:['’][^\W\d_]+)*)*")
#: The same tokens, those only that begin with a letter that is no small one of Latin-1.
_CAPITAL = re.compile(r"[^\W\d_a-zß-öø-ÿ](?<![^\W\d_].)(?<![^\W\d_][-‐‑'’̀-ͯ].)[^\W\d_]*(?:[̀-ͯ'’][^\W\d_]+)*(?:[-‐‑][^\W\d_]+(?:['’][^\W\d_]+)*)*")
_JOINED = re.compile(r"[^\W\d_]|[-‐‑'’̀-ͯ]")
_LAST_WORD = re.compile(r"[^\W\d_]+(?=(?:\.|[^\w\s.,;:!?()<>|\"@\[\]{}/&#*-]|[ \t\xa0])+$)")


@lru_cache(1 << 16)
def plain(word: str) -> str:
    return unicodedata.normalize("NFC", word).replace("’", "'").casefold()


class Names:
    """Gazetteer of given and family names, and the recurring parts of family names."""

    def __init__(self, given: set[str], family: set[str], more_given: frozenset[str] = frozenset()):
        self.given, self.family, self.more = {plain(x) for x in given if x}, {plain(x) for x in family if x}, more_given
        simple = {p for f in self.family for p in re.split(r"[-\s]", re.sub(r"^(?:o'|mc|mac|d'|de |van )", "", f)) if len(p) > 4}
        heads, tails = defaultdict(set), defaultdict(set)
        for f in simple:
            for k in range(3, len(f) - 2):
                heads[f[:k]].add(f[k:])
                tails[f[k:]].add(f[:k])
        # a head and a tail that meet in several names on either side
        self.heads = {h for h, t in heads.items() if sum(len(tails[x]) > 2 for x in t) > 2}
        self.tails = {t for t, h in tails.items() if sum(x in self.heads for x in h) > 2}

    def is_family(self, word: str) -> bool:
        w = plain(word)
        if w in self.family:
            return True
        for p in w.split("-"):
            p = re.sub(r"^(?:o'|mc|mac|d')", "", p)
            if p in self.family or any(p[:k] in self.heads and p[k:] in self.tails for k in range(3, len(p) - 2)):
                return True
        return False

    def is_given(self, word: str) -> bool:
        w = plain(word)
        return w in self.given or w in self.more or "-" in w and all(p in self.given or p in self.more for p in w.split("-"))


def letter_case(text: str) -> str:
    """``upper``, ``lower`` or ``mixed``, by all letters of the Latin alphabet and its supplement."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up = int(np.count_nonzero((c - 65 < 26) | (c - 0xC0 < 31) & (c != 0xD7)))
    low = int(np.count_nonzero((c - 97 < 26) | (c - 0xDF < 32) & (c != 0xF7)))
    return "upper" if up > 4 * low and up > 3 else "lower" if up * 200 < low or not up else "mixed"


_AFTER_TITLE = re.compile(r"\.?[ \t\xa0]+")
#: Between the parts of a name: blanks, maybe a stray symbol among them.
_GAP = re.compile(r"[ \t\xa0]+(?:[^\w\s.,;:!?()<>|\"@\[\]{}/&#*-]{1,3}[ \t\xa0]+)?")
_GAP_INITIAL = re.compile(r"\.?(?:[ \t\xa0]+(?:[^\w\s,;:!?()<>|\"@\[\]{}/&#*-]{1,3}[ \t\xa0]+)?)?")


def _capitals(text: str) -> list[tuple[str, int, int]]:
    """The capitalised tokens, and small particles and titles right before them: all that a name in mixed case is made of, as every rule asks
    for gaps without letters."""
    toks: list[tuple[str, int, int]] = []
    for m in _CAPITAL.finditer(text):
        w = m[0]
        if not w[0].isupper():
            continue
        s = m.start()
        before, at = [], s
        while at and text[at - 1] in " \t\xa0":
            piece = text[text.rfind(" ", 0, at - 1) + 1:at - 1]
            word = piece[:-1] if piece[-1:] == "." else piece
            if word.isalpha() and (word[0].isupper() or (k := plain(word)) not in PARTICLES and k not in TITLES) or piece[:-1].isalpha() and piece[-1:] in ",;:!?":
                break
            low = _LAST_WORD.search(text, max(0, at - 16), at)
            if low is None or low[0][0].isupper() or (k := plain(low[0])) not in PARTICLES and k not in TITLES or low.start() and _JOINED.match(text[low.start() - 1]):
                break
            at = low.start()
            before.append((low[0], *low.span()))
        toks += reversed(before)
        toks.append((w, s, m.end()))
    return toks


def _spans_names(text: str, names: Names, case: str) -> Iterator[tuple[int, int, dict]]:
    """Candidate names as (start, end, facts)."""
    toks = _capitals(text) if case == "mixed" else [(m[0], *m.span()) for m in _TOKEN.finditer(text)]
    n = len(toks)
    fam = [False] * n
    giv = [False] * n
    memo: dict[str, tuple[bool, bool]] = {}
    for i, (w, _, _) in enumerate(toks):
        if case == "mixed" and not w[0].isupper():
            continue
        if w not in memo:
            memo[w] = (names.is_family(w), names.is_given(w))
        fam[i], giv[i] = memo[w]

    def gap(i: int) -> str:
        return text[toks[i][2]:toks[i + 1][1]] if i + 1 < n else ""

    def initial(i: int) -> bool:
        return len(toks[i][0]) == 1 and (case != "mixed" or toks[i][0].isupper()) and bool(re.match(r"\.|\s[^\w\s]", text[toks[i][2]:toks[i][2] + 2]))

    def titled(i: int) -> bool:
        return i > 0 and (t := plain(toks[i - 1][0])) in TITLES and t != "judge" and _AFTER_TITLE.fullmatch(gap(i - 1)) is not None

    def french() -> bool:
        low = text.casefold()
        return len(re.findall(r"\b(?:le|la|les|des|une|est)\b", low)) > len(re.findall(r"\b(?:the|and|of)\b", low))

    def capital(i: int) -> bool:
        return case == "mixed" and i < n and toks[i][0][0].isupper() and len(toks[i][0]) > 2 and plain(toks[i][0]) not in _NO_GIVEN

    used = [False] * n
    for i in range(n):
        if not fam[i] or used[i]:
            continue
        k = i
        facts = {"family": 1, "given": 0, "initial": 0, "title": 0, "comma": 0}
        # backwards over particles and initials to a given name
        while k > 0 and _GAP.fullmatch(gap(k - 1)) and plain(toks[k - 1][0]) in PARTICLES:
            k -= 1
        p = k
        while p > 0 and initial(p - 1) and _GAP_INITIAL.fullmatch(gap(p - 1)):
            p -= 1
            facts["initial"] = 1
        first = p
        if p > 0 and _GAP.fullmatch(gap(p - 1)):
            w = toks[p - 1][0]
            low = plain(w)
            if not initial(p - 1) and low not in TITLES and low not in PARTICLES and not used[p - 1] and (giv[p - 1] or case == "mixed" and w[0].isupper() and w[1:2].islower() and len(w) > 2 and low not in _NO_GIVEN and not fam[p - 1]):
                first = p - 1
                facts["given"] = 1 + giv[p - 1]
                while first > 0 and re.fullmatch(r"[ \t ]+", gap(first - 1)) and giv[first - 1] and not used[first - 1] and not plain(toks[first - 1][0]) in _NO_GIVEN:
                    first -= 1
        if first == p:
            if facts["initial"] and p == k - 1 and plain(toks[p][0]) == "m" and french():  # monsieur
                facts["initial"], facts["title"], p = 0, 1, k
            first = p if facts["initial"] else k if case == "mixed" or titled(k) or plain(toks[k][0]) in ("van", "von") else i
        end = i
        if end + 1 < n and re.fullmatch(r"-| ", gap(end)) and fam[end + 1]:
            end += 1
        if not facts["given"] and end + 1 < n and gap(end) == ", " and (giv[end + 1] or case == "mixed" and toks[end + 1][0][0].isupper() and re.match(r"\s*(?:\(|;)", text[toks[end + 1][2]:toks[end + 1][2] + 3])):
            end += 1
            facts["comma"] = 1
        if titled(first):
            facts["title"] = 1
        for j in range(first, end + 1):
            used[j] = True
        yield toks[first][1], toks[end][2], facts
    for i in range(n) if case != "mixed" else [i for i in range(n) if toks[i][0][0].isupper()]:
        if used[i]:
            continue
        w, s, e = toks[i]
        if i + 1 < n and not used[i + 1] and gap(i) == ", " and giv[i + 1] and len(w) > 2 and (capital(i) or case != "mixed") and re.match(r"\s*(?:\((?:annot|review)|;\s*\w)", text[toks[i + 1][2]:toks[i + 1][2] + 9].casefold()):
            used[i + 1] = True  # an unlisted family name before a given name
            yield s, toks[i + 1][2], {"family": 1, "given": 1, "initial": 0, "title": 0, "comma": 1}
        elif titled(i) and (capital(i) or giv[i]) and plain(w) not in TITLES:
            j = i + 1 if capital(i + 1) and not used[i + 1] and gap(i) == " " and not text[e:e + 1] == "." else i
            used[j] = True
            yield s, toks[j][2], {"family": 0, "given": 2 * giv[i], "initial": 0, "title": 1, "comma": 0}
        elif initial(i) and capital(i + 1) and not used[i + 1] and _GAP_INITIAL.fullmatch(gap(i)) and _SIGNED.search(text[max(0, s - 12):s].casefold()):
            used[i + 1] = True
            yield s, toks[i + 1][2], {"family": 1, "given": 0, "initial": 1, "title": 0, "comma": 0}
        elif giv[i]:
            j = i
            if i + 1 < n and not used[i + 1] and gap(i) == " " and capital(i + 1) and not giv[i + 1] and _SIGNED.search(text[max(0, s - 14):s].casefold()):
                j = i + 1
                used[j] = True
            yield s, toks[j][2], {"family": 0, "given": 2, "initial": 0, "title": 0, "comma": 0}
        elif case == "mixed" and w[0].isupper() and i + 1 < n and gap(i) == " " and toks[i + 1][0][:1].isupper() and not used[i + 1] and len(w) > 2 and plain(w) not in _NO_GIVEN:
            yield s, toks[i + 1][2], {"family": 0, "given": 0, "initial": 0, "title": 0, "comma": 0}
        elif case == "mixed" and w[0].isupper() and w[1:].islower() and len(w) > 2 and _STRONG.search(text[max(0, s - 16):s].casefold()) and _AFTER_NAME.match(text[e:e + 24].casefold()):
            yield s, e, {"family": 0, "given": 0, "initial": 0, "title": 0, "comma": 0}


_SIGNED = re.compile(r"(?:signed:?|reviewed by|regards,?|wishes,?|name:?|name is|contact:?)\s+$")
_STRONG = re.compile(r"(?:\bhi|\bhello|talked to|thanks to|name is|ich heiße|m'appelle|me llamo|mi chiamo)\s+$")
#: Labelers by type, in the order of the votes.
LABELERS = {
    "email": ("syntax", "ending", "context", "against"), "phone": ("shape", "length", "context", "against"), "id_number": ("form", "context", "against", "field"),
    "street_address": ("street_word", "case", "context", "against"), "person_name": ("family", "given", "before", "after", "title", "against"),
}


#: A value that stands as a field of its own, between dividers.
_FIELD_BEFORE, _FIELD_AFTER = re.compile(r"[;|\t]\s*$"), re.compile(r"\s*(?:[;|\t]|$)")


def _id_form(kind: str, m: re.Match) -> int:
    """1: a form that hardly anything else has, three, two and four digits with one divider throughout or an insurance number of valid letters;
    -1: a number that is never given out; else 0."""
    digits = re.sub(r"\D", "", m[0])
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000" else 1 if m["sep"] else 0
    if kind == "nino":
        two = m[0][:2].upper()
        return -1 if two[0] in "DFIQUV" and two != "QQ" or two[1] in "DFIOUV" or two in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ") else 1
    return 0


_LETTERS, _PIECE = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]+|[^\w\s]")


def _sign(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def spans(text: str, names: Names) -> list[tuple[str, int, int, list[int], list[str]]]:
    """Proposed spans of a text: (type, start, end, votes, features)."""
    out = []
    case = letter_case(text)

    def around(s: int, e: int) -> tuple[str, str]:
        return text[max(0, s - 48):s].casefold().replace("’", "'"), text[e:e + 32].casefold().replace("’", "'")

    def feats(kind: str, s: int, e: int, before: str, after: str, *more: str) -> list[str]:
        shape = _LETTERS.sub("a", _DIGIT_RUN.sub(lambda m: "9" * min(len(m[0]), 4), text[s:e]))[:24]
        last = _PIECE.findall(before)[-2:]
        return [f"shape={shape}", f"prev={' '.join(last)}", f"prev1={' '.join(last[-1:])}", f"next={' '.join(m[0] for m in (_PIECE.search(after),) if m)}", f"case={case}", *more]

    mails, streets = [], []
    low = text.lower()
    digits_in = _HAS_DIGIT.search(text) is not None
    for m in EMAIL.finditer(text) if any(x in low for x in _AT_SIGNS) else ():
        s, e = m.span()
        while s < e and text[s] in ".-+'":
            s += 1
        end = bool(_EMAIL_END.search(text[s:e]))
        b, a = around(s, e)
        local = re.split(_AT, text[s:e], maxsplit=1)[0]
        votes = [_sign(bool(re.fullmatch(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+", text[s:e])), not end), _sign(end, not end), _sign(bool(_BEFORE["email"].search(b))), -1 if not end or not local else 0]
        out.append(("email", s, e, votes, feats("email", s, e, b, a)))
        if end:
            mails.append((s, e))
    langs = _languages(low) if digits_in else ()
    for lang, pattern in ADDRESSES:
        for m in pattern.finditer(text) if lang in langs else ():
            s, e = m.span()
            got = m.group()
            ws = re.findall(r"[^\W\d_]{2,}", re.sub(r"^(?:[^\W\d_]+\.?\s?#?\w{1,4},?\s+)?\d+(?:[A-Za-z]\b|-\d+)?", "", got) if lang == "en" else got)
            if lang == "en":
                named = all(w[0].isupper() for w in ws) if case == "mixed" else plain(ws[-1]) not in _EVERYDAY and not any(plain(w) in _FUNCTION for w in ws)
            else:
                named = case != "mixed" or any(w[0].isupper() for w in ws)
            b, a = around(s, e)
            votes = [1, _sign(named, not named), _sign(bool(_BEFORE["street_address"].search(b))), _sign(False, bool(_NOT_BEFORE["street_address"].search(b)) or not named)]
            out.append(("street_address", s, e, votes, feats("street_address", s, e, b, a, f"lang={lang}", f"end={plain(got.split()[-1])[-6:]}")))
            if named:
                streets.append((s, e))
    taken = mails + streets
    places = [m.span() for m in _NUMBERS.finditer(text)] if digits_in else []
    for m in _near(_ID_HEAD, text, places, 8):
        s, e = m.span()
        if any(x <= s < y for x, y in mails):
            continue
        b, a = around(s, e)
        kind = "ssn" if m["ssn"] else "nino" if m["nino"] else "pass"
        close = bool(_BEFORE["id_number"].search(b))
        far = bool(_NOT_BEFORE["id_number"].search(b))
        form = _id_form(kind, m)
        votes = [form, _sign(close), -1 if far and not close else 0, _sign(_FIELD_BEFORE.search(b) is not None and _FIELD_AFTER.match(a) is not None)]
        out.append(("id_number", s, e, votes, feats("id_number", s, e, b, a, f"kind={kind}", f"form={form}")))
    for m in _near(_PHONE_HEAD, text, places, 32):
        s, e = m.span()
        if any(x <= s < y for x, y in taken):
            continue
        got = m.group()
        digits = re.sub(r"\D", "", re.split(r"(?i)ext|x", got)[0])
        b, a = around(s, e)
        close, far = bool(_BEFORE["phone"].search(b)), bool(_NOT_BEFORE["phone"].search(b))
        dated = bool(re.match(r"(?:19|20)\d\d-\d\d", got))
        form = got[0] in "+(" or digits[0] == "0" or len(digits) in (10, 11)
        votes = [_sign(form, dated or not form), _sign(9 <= len(digits) <= 15, len(digits) < 8), _sign(close), -1 if far or dated else 0]
        out.append(("phone", s, e, votes, feats("phone", s, e, b, a, f"digits={len(digits)}")))
    for s, e, f in _spans_names(text, names, case):
        if any(x <= s < y or x < e <= y for x, y in mails) or any(x < e and s < y for x, y in streets):
            continue
        if text[s - 1:s] in ("@",):
            continue
        b, a = around(s, e)
        w = plain(text[s:e])
        single = not f["family"] and not f["title"]
        start = s == 0 or bool(re.search(r"[.!?:\n\]]\W*$|^\W*$", b))
        common = bool(re.match(r"\s+[a-zà-ÿ]", text[e:e + 3])) and (start or case != "mixed") and not _AFTER_NAME.match(a)
        strong = bool(_STRONG.search(b)) or bool(_BEFORE["person_name"].search(b)) and not (case != "mixed" and single)
        after = bool(_AFTER_NAME.match(a))
        bad = bool(_NOT_AFTER_NAME.match(text[e:e + 14])) or single and not f["given"] and not (strong and after)
        against = bad or single and f["given"] and (common or not (strong or after)) or single and bool(_NOT_BEFORE["person_name"].search(b))
        votes = [_sign(bool(f["family"]), not f["family"]), _sign(f["given"] == 2 and not (single and common), single and not f["given"]), _sign(strong, bool(_NOT_BEFORE["person_name"].search(b)) and not f["family"]), _sign(after, common and single), 1 if f["title"] else 0, -1 if against else 0]
        out.append(("person_name", s, e, votes, feats("person_name", s, e, b, a, f"tail={w[-4:]}", f"head={w[:4]}", f"kind={f['family']}{f['given']}{f['initial']}{f['comma']}{f['title']}", f"start={int(start)}")))
    return out


_COLS = "doc_id bigint, pii_type string, s int, e int, votes array<int>, feats array<string>"


def _propose(names: Names):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *x) for i, t in zip(b["doc_id"], b["text"]) for x in spans(t, names)]
            yield pd.DataFrame(out, columns=["doc_id", "pii_type", "s", "e", "votes", "feats"])

    return run


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability that a pattern of votes is right, by expectation-maximisation over two classes with independent labelers.

    A labeler without an opinion is no evidence, and none is worse than chance: a vote for a span never lowers its probability and a
    vote against it never raises it. Without this, two kinds of true mentions that no context shares would be taken for the two classes.
    """
    if not patterns:
        return {}
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    q = 1 / (1 + np.exp(-1.2 * v.sum(axis=1)))  # start: the balance of votes
    for _ in range(rounds):
        prior = (q * n).sum() / n.sum()
        logit = np.full(len(v), np.log((prior + 1e-6) / (1 - prior + 1e-6)))
        for k in range(v.shape[1]):
            for x in (-1, 1):
                hit = v[:, k] == x
                p1 = ((q * n)[hit].sum() + 2.0 * (1 + x) / 2 + 0.5) / ((q * n).sum() + 3.5)
                p0 = (((1 - q) * n)[hit].sum() + 2.0 * (1 - x) / 2 + 0.5) / (((1 - q) * n).sum() + 3.5)
                logit[hit] += x * max(0.0, x * np.log(p1 / p0))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return {p: float(x) for (p, _), x in zip(patterns, q)}


DIM = 1 << 14


def _indices(votes: list[int], feats: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(x) % DIM for x in (*feats, *(f"v{k}={x}" for k, x in enumerate(votes)))]


def train(rows: list[tuple[list[int], list[str], float]], epochs: int = 12, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Weights (last: intercept) of a logistic classifier for soft labels, by adaptive gradient steps over blocks."""
    w = np.zeros(DIM + 1)
    if not rows:
        return w
    width = max(len(v) + len(f) for v, f, _ in rows)
    x = np.full((len(rows), width + 1), DIM)
    on = np.zeros((len(rows), width + 1))
    y = np.array([t for _, _, t in rows])
    for i, (v, f, _) in enumerate(rows):
        idx = _indices(v, f)
        x[i, :len(idx)] = idx
        on[i, :len(idx)] = 1
    on[:, -1] = 1
    g2 = np.full(DIM + 1, 1e-3)
    order = np.random.default_rng(0).permutation(len(rows))
    for _ in range(epochs):
        for k in range(0, len(rows), 256):
            r = order[k:k + 256]
            p = 1 / (1 + np.exp(-np.clip((w[x[r]] * on[r]).sum(axis=1), -30, 30)))
            g = np.zeros(DIM + 1)
            np.add.at(g, x[r], (p - y[r])[:, None] * on[r] / len(r))
            g += l2 * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
    return w


def _score(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [1 / (1 + np.exp(-np.clip(weights[t][_indices(list(v), list(f))].sum() + weights[t][DIM], -30, 30))) for t, v, f in zip(b["pii_type"], b["votes"], b["feats"])]
            b["p"] = np.array(p, float)
            yield b.loc[b["p"] > 0.5, ["doc_id", "pii_type", "s", "e", "p"]]

    return run


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drop spans that overlap a better one of the same document; rows come sorted by document and start."""
    rank = {"email": 0, "street_address": 1, "id_number": 2, "phone": 2, "person_name": 3}
    held: list[tuple] = []

    def settle(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in sorted(set(rows), key=lambda r: (rank[r[1]], -round(r[4], 2), -(r[3] - r[2]), r[2], r[1])):
            if not any(r[2] < k[3] and k[2] < r[3] for k in kept):
                kept.append(r)
        return kept

    for b in batches:
        out: list[tuple] = []
        for r in b[["doc_id", "pii_type", "s", "e", "p"]].itertuples(index=False, name=None):
            # a run of overlapping spans is settled as soon as it ends
            if held and (held[-1][0] != r[0] or r[2] >= max(h[3] for h in held)):
                out += settle(held)
                held = []
            held.append(r)
        yield pd.DataFrame(out, columns=["doc_id", "pii_type", "s", "e", "p"])
    yield pd.DataFrame(settle(held), columns=["doc_id", "pii_type", "s", "e", "p"])


def _sampled(df: DataFrame, id_col: str, bound: int, seed: int, rows: int) -> DataFrame:
    """At most ``bound`` of ``rows`` rows: those with the smallest hash of the id, sought only among the share of hashes that holds
    about twice as many, so that a task sends few rows however large the table is."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(2**40))
    share = min(1.0, (2.0 * bound + 200) / max(rows, 1))
    return df.withColumn("_h", h).where(F.col("_h") < int(share * 2**40)).orderBy("_h", id_col).limit(bound).drop("_h")


def _before_family(names: Names):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen, known = Counter(), Counter(), {}

        def family(w: str) -> bool:
            if w not in known:
                known[w] = names.is_family(w)
            return known[w]

        for b in batches:
            for t in b["text"]:
                if letter_case(t) != "mixed":
                    continue
                x, end = "", 0  # the capitalised word before
                for m in _CAPITAL.finditer(t):
                    w = m.group()
                    if not w[0].isupper():
                        continue
                    if x and m.start() == end + 1 and t[end] == " " and family(w) and not family(x):
                        n[plain(x)] += 1
                    x, end = w if len(w) > 2 and w[1:].islower() else "", m.end()
                    if x:
                        seen[x] += 1
        total: Counter = Counter()
        for w, c in seen.items():
            total[plain(w)] += c
        total = {w: c for w, c in total.items() if w not in TITLES and w not in _NO_GIVEN}
        yield pd.DataFrame({"name": list(total), "n": [n[w] for w in total], "seen": list(total.values())}).astype({"name": "object", "n": "int64", "seen": "int64"})

    return run


def given_names(docs: DataFrame, names: Names, max_given: int) -> frozenset[str]:
    """Words that stand before family names, counted over all documents: three times or more, and in at least one of 300 of their
    capitalised places. The share is the same however large the table is, where chance alone would pass any fixed count."""
    n = docs.mapInPandas(_before_family(names), "name string, n bigint, seen bigint").groupBy("name").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    more = n.where("n >= 3 and n * 300 >= seen").select("name").limit(max_given + 1).collect()
    if len(more) > max_given:
        raise ValueError(f"more than {max_given} given names stand before family names: too large a gazetteer to send to every task")
    return frozenset(r["name"] for r in more)


def mentions(documents: DataFrame, roster: DataFrame, sample_spans: int = 20_000, max_roster: int = 100_000, max_given: int = 500_000) -> DataFrame:
    """doc_id, pii_type, s, e (code points, end exclusive), p of every mention."""
    people = roster.select("given_name", "family_name").distinct().limit(max_roster + 1).collect()
    if len(people) > max_roster:
        raise ValueError(f"the roster has more than {max_roster} names: too large a gazetteer to send to every task")
    names = Names({r[0] for r in people if r[0]}, {r[1] for r in people if r[1]})
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")

    names = Names({r[0] for r in people if r[0]}, {r[1] for r in people if r[1]}, given_names(docs, names, max_given))
    proposed = land(docs.mapInPandas(_propose(names), _COLS))
    patterns = defaultdict(list)
    for r in proposed.groupBy("pii_type", "votes").count().collect():  # at most 3 ** labelers patterns a type
        patterns[r["pii_type"]].append((tuple(r["votes"]), r["count"]))
    sure = {t: reliabilities(sorted(p)) for t, p in patterns.items()}
    weights = {}
    for t in TYPES:
        few = _sampled(proposed.where(F.col("pii_type") == t).withColumn("k", F.concat_ws(":", "doc_id", "s")), "k", sample_spans, 2, sum(c for _, c in patterns[t])).select("votes", "feats").collect()
        weights[t] = train([(r["votes"], r["feats"], sure[t][tuple(r["votes"])]) for r in few])
    kept = proposed.mapInPandas(_score(weights), "doc_id bigint, pii_type string, s int, e int, p double")
    return kept.repartition("doc_id").sortWithinPartitions("doc_id", "s", "e", "pii_type").mapInPandas(_resolve, "doc_id bigint, pii_type string, s int, e int, p double")


def found(documents: DataFrame, roster: DataFrame) -> DataFrame:
    return mentions(documents, roster).select("doc_id", "pii_type", F.col("s").alias("start_char")).distinct()


def redacted(documents: DataFrame, roster: DataFrame) -> DataFrame:
    """doc_id, text with a placeholder such as ``[EMAIL]`` in place of each mention, n_mentions."""
    at = mentions(documents, roster).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", "e", "pii_type"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, m in zip(b["text"], b["m"]):
                parts, end = [], 0
                for x in (m if m is not None else ()):
                    if x["s"] >= end:
                        parts += [t[end:x["s"]], f"[{x['pii_type'].upper()}]"]
                        end = x["e"]
                out.append("".join(parts) + t[end:] if t is not None else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": out, "n_mentions": [0 if m is None else len(m) for m in b["m"]]})

    return documents.select("doc_id", "text").join(at, "doc_id", "left").mapInPandas(run, "doc_id bigint, text string, n_mentions int")
