"""Broken prompt and response pairs (problem 2).

Method: ordered rules. Each answer goes through the rules for emptiness, copied prompt, refusal phrases in several languages,
unclosed delimiters and abrupt endings, and language or script mismatch; every triggered defect is emitted by ``defects`` with its
rank, and ``first_defects`` keeps the first in that order.

Whether the last entry of a list breaks off can't be seen from punctuation, since entries often carry none. For these a statistic
over all list entries of all answers tells how often their last two words (else the last word) end an entry and how often they go on;
an ending that only ever goes on, or was never seen, is abrupt.

Defined cases: a null prompt or one without words has no language and can't be copied; a null answer, a blank one and one
of punctuation only are empty; ties don't occur, as the order of rules is fixed; repeated rows give one row; texts of any length are
read whole; an absent source is no case; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.text import canonical, content, folded
from prefloom.plans.lineage import land

ORDER = ("empty", "copies_prompt", "refusal", "truncated", "other_language")

#: Content of answers that only hold a place (fixed list).
PLACEHOLDERS = frozenset(
    "na none null nil nan void empty blank missing undefined unknown tbd tba todo response answer text noanswer noresponse nooutput notext nodata nocontent notavailable notapplicable "
    "emptyresponse emptystring insertresponsehere yourresponsehere placeholder responsehere answerhere error keineantwort leer keine aucune aucuneréponse vide pasderéponse sinrespuesta vacío ninguna nessuna nessunarisposta vuoto geenantwoord leeg".split())

#: Function words that tell languages apart (fixed lists).
FUNCTION_WORDS = {
    "en": "the and of is that it you with for this are was be have not on as at they what how your from but which when their an if so do",
    "de": "der die das und ist nicht mit ein eine einen zu auf für von den dem des sich auch wenn dass dann wie bei nach aus wird ich du sie es etwas dort denn am im kann",
    "fr": "le la les des et est pas une un que qui dans pour avec sur au aux ce cette il elle vous je ne plus par si mais ou où l d qu c j du deux sans",
    "es": "el la los las y es no una un que de en con por para su se lo más del al como pero si te tu qué sin muy este algo dos",
    "it": "il lo la gli le e è non una un che di in con per su del della al alla da si dei nel sono come ma se più questo dove anche ti dopo",
    "nl": "de het een en van is niet met voor dat op te zijn in aan er om je ook als maar bij naar wat dit dan wel nog geen",
    "pt": "o os as e é não uma um que de em com por para do da no na se mais como mas ao você seu sua isso está muito",
}
_LANG: dict[str, list[str]] = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in _ws.split():
        _LANG.setdefault(_w, []).append(_l)
#: A word counts in proportion to how few of the languages share it.
_LANG_W = {w: [(x, 1 / len(ls)) for x in ls] for w, ls in _LANG.items()}
_LANG_WORDS = frozenset(_LANG_W)
_BREAKS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~’‘“”«»…–—¿¡"})
_ASCII_GONE = {i: None for i in range(128) if not chr(i).isalnum()}
_FOREIGN = re.compile(r"[\u0370-\u1dff\u2c00-\u2dff\u2e80-\ua6ff\ua800-\uab2f\uabc0-\ud7ff\uf900-\ufaff\ufb13-\ufdff\ufe70-\ufefc\uff66-\uffdc\U00010000-\U0001cfff\U00020000-\U0003ffff]")
#: Names of languages in these languages (fixed list).
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés inglese engels inglês", "de": "german deutsch allemand alemán tedesco duits alemão",
    "fr": "french französisch français francés francese frans francês", "es": "spanish spanisch espagnol español spagnolo spaans espanhol castellano",
    "it": "italian italienisch italien italiano italiaans", "nl": "dutch niederländisch néerlandais neerlandés olandese nederlands holandês",
    "pt": "portuguese portugiesisch portugais portugués portoghese portugees português",
}
_NAME = {n: k for k, ns in LANGUAGE_NAMES.items() for n in ns.split()}
_ASKED = re.compile(r"(?:\b(?:in|auf|en|em|in het|op)\s+|\b(?:language|sprache|langue|idioma|lingua|taal)\s*[:=]\s*)(" + "|".join(sorted(_NAME, key=len, reverse=True)) + r")\b([^.!?;/\n]{0,25})(?=[.!?;/\n\"'*)}|]|$)")
_ASK_VERB = re.compile(r"\b(?:answer|respond|reply|write|antwort\w*|schreib\w*|répon\w*|écri\w*|respon\w*|escrib\w*|contest\w*|rispo\w*|scriv\w*|antwoord\w*|schrijf\w*|language|sprache|langue|idioma|lingua|taal|bitte|please|por favor|per favore|s'il|merci)\b")
_TOKEN = re.compile(r"[^\W\d_]+")

#: Ways to decline (fixed patterns, on folded text).
REFUSAL = re.compile("|".join((
    r"\b(?:i|we)(?:'m| am|'re| are)? (?:sorry|afraid)\b.{0,40}\b(?:can't|cannot|can not|won't|unable|not able)\b",
    r"\b(?:i|we) (?:really |simply |just )?(?:can't|cannot|can not|won't|will not|am unable|are unable|am not able|must decline|have to decline|decline|refuse|would rather not|'d rather not|prefer not|have to pass|must pass|don't feel comfortable|do not feel comfortable|am not comfortable|am not in a position|am not allowed|am not permitted)\b",
    r"\bi'(?:m|d) (?:unable|not able|not in a position|not allowed|not permitted|not comfortable|prefer not|rather not)\b",
    r"\b(?:unable|not able|not possible|isn't possible|impossible) (?:for me )?to (?:help|assist|answer|respond|comply|reply|discuss|give|provide|write)\b",
    r"\bwon't be able to (?:answer|help|assist|respond)\b",
    r"\b(?:isn't|is not) possible for me\b", r"\b(?:not|n't) be appropriate for me\b", r"\bagainst my (?:guidelines|policy|policies|rules|instructions)\b",
    r"\b(?:instructions|guidelines|policies|policy|rules) (?:do not|don't|does not|doesn't) (?:allow|permit)\b", r"\bno answer (?:will|can) be\b",
    r"\boutside (?:of )?(?:what i|my)\b", r"\bas an? (?:ai|language model)\b.{0,40}\bnot\b", r"\bpass on this\b", r"\bnot something i can\b", r"\bthis is (?:something|a topic)\b.{0,20}\b(?:unable|can't|cannot|won't)\b",
    # de
    r"\b(?:kann|darf|möchte|will|werde) (?:ich|wir)\b.{0,40}\bnicht\b", r"\bich (?:kann|darf|möchte|will|werde)\b.{0,50}\bnicht\b", r"\btut mir leid\b", r"\b(?:muss ich|ich muss)\b.{0,40}\b(?:ablehnen|passen)\b", r"\blehne ich\b.{0,40}\bab\b", r"\bnicht (?:in der lage|gestattet|erlaubt|möglich)\b", r"\bich bin nicht (?:in der lage|befugt)\b", r"\b(?:gebe|erteile) ich\b.{0,30}\b(?:keine?n?|nicht)\b", r"\bich (?:gebe|erteile)\b.{0,30}\bkeine\b", r"\b(?:beantworte|bespreche|behandle) ich\b.{0,20}\bnicht\b", r"\b(?:äußere|sage) ich\b.{0,20}\b(?:nicht|nichts)\b", r"\bnicht weiterhelfen\b", r"\bkeine (?:auskunft|antwort) (?:geben|möglich|dazu)\b",
    # fr
    r"\bje (?:ne|n')\s?(?:peux|puis|suis|souhaite|veux|saurais|pourrai)\b.{0,40}\bpas\b", r"\bje ne (?:suis|peux|puis)\b.{0,30}\b(?:en mesure|autorisée?)\b", r"\bje préfère ne pas\b", r"\bje dois (?:refuser|décliner)\b", r"\b(?:désolée?|navrée?)\b.{0,60}\b(?:peux|puis|impossible|pas)\b", r"\bil m'est impossible\b", r"\bne m'est pas (?:permis|possible)\b", r"\bje refuse\b", r"\bne me permettent pas\b", r"\bje ne (?:réponds|répondrai|donne|donnerai|traite|traiterai|parle|parlerai)\b.{0,20}\b(?:pas|aucune?|rien)\b", r"\bil ne m'est pas\b", r"\bje n'ai pas le droit\b", r"\bje préfère\b.{0,20}\bne (?:pas|rien)\b", r"\bje m'abstiens\b", r"\bje (?:dois|préfère) m'abstenir\b",
    # es
    r"\b(?:lo siento|lo lamento|perdona|disculpa)\b.{0,60}\bno\b", r"\bno (?:puedo|podré|podemos|debo|quiero)\b.{0,30}\b(?:ayudar\w*|responder\w*|contestar\w*|hablar|dar\w*|tratar|hacer\w*|atender\w*|escribir\w*|opinar|comentar)\b", r"\bno me (?:está|es|resulta) (?:permitido|posible)\b", r"\bno estoy (?:en condiciones|autorizad[oa]|capacitad[oa])\b", r"\bprefiero no\b", r"\bdebo (?:rechazar|negarme|declinar)\b", r"\bme niego\b", r"\bno (?:respondo|responderé|contesto|contestaré|doy|daré|trato|trataré|hablo|hablaré|opino|ofrezco)\b", r"\bno voy a\b.{0,20}\b(?:responder|contestar|hablar|ayudar\w*|tratar)\b", r"\bme abstengo\b", r"\bno está en mi mano\b", r"\btengo que (?:rechazar|declinar)\b", r"\bmis (?:normas|instrucciones|reglas)\b.{0,30}\bno\b",
    # it
    r"\b(?:mi dispiace|spiacente|mi spiace)\b.{0,60}\bnon\b", r"\bnon (?:posso|potrò|voglio|riesco)\b.{0,30}\b(?:aiutar\w*|risponder\w*|dar\w*|parlar\w*|trattar\w*|scriver\w*|farlo|commentar\w*)\b", r"\bnon mi è (?:consentito|permesso|possibile)\b", r"\bnon sono (?:in grado|autorizzat[oa])\b", r"\bpreferisco non\b", r"\bdevo (?:rifiutare|declinare)\b", r"\bmi rifiuto\b", r"\bnon (?:rispondo|risponderò|do|darò|fornisco|fornirò|tratto|tratterò|parlo|parlerò)\b", r"\bpreferirei non\b", r"\bmi astengo\b", r"\bnon (?:mi )?è possibile\b", r"\ble mie (?:regole|istruzioni)\b.{0,30}\bnon\b",
    # nl, pt
    r"\bkan ik\b.{0,30}\bniet\b", r"\bhet spijt me\b.{0,60}\bniet\b", r"\bmag ik\b.{0,30}\bniet\b", r"\b(?:desculpe|lamento|sinto muito)\b.{0,60}\bnão\b", r"\bnão posso (?:ajudar|responder)\b",
)))
#: Courtesies around a refusal that give no advice.
_COURTESY = re.compile("|".join((
    r"thank(?:s| you)\b.{0,40}", r"i understand\b.{0,60}", r"(?:please )?(?:contact|consult|ask|see|consider (?:asking|talking to|contacting)|speak to|talk to|reach out to)\b.{0,60}\b(?:professional|expert|coach|doctor|specialist|someone|adviser|advisor)\b.{0,20}",
    r"is there anything else\b.{0,40}", r"(?:i'm |i am )?(?:very |so )?sorry(?: about that| for that)?", r"no", r"i hope you understand", r"i apologi[sz]e\b.{0,30}", r"sure", r"unfortunately",
    r"(?:bitte )?(?:wende|wenden|frag|fragen)\b.{0,60}", r"danke\b.{0,30}", r"merci\b.{0,40}", r"désolée?", r"gracias\b.{0,30}", r"lo siento", r"grazie\b.{0,30}", r"mi dispiace", r"(?:veuillez )?(?:contacte[rz]?|adresse[rz]?|consulte[rz]?)\b.{0,60}", r"(?:consulta|consulte|pregunta|pregunte|acude|acuda)\b.{0,60}\b(?:profesional|experto|especialista)\b.{0,20}", r"(?:rivolgiti|consulta|si rivolga|chiedi)\b.{0,60}\b(?:professionista|esperto)\b.{0,20}", r"je comprends\b.{0,60}", r"entiendo\b.{0,60}", r"capisco\b.{0,60}", r"ich verstehe\b.{0,60}",
)))
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»')\]]*\s+|\n+")


#: Quoted speech is nobody's answer.
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»")


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s]


def is_refusal(text: str) -> bool:
    """Declines, and nothing but courtesies is left."""
    hit, rest = False, 0
    for s in sentences(_QUOTED.sub(" x ", text.strip().strip('"“”«»*'))):
        s = folded(s).replace("’", "'")
        if REFUSAL.search(s):
            hit = True
            # advice in the same sentence: a clause after "but", "yet" and the like
            m = re.search(r"\b(?:but|yet|however|aber|mais|pero|ma)\b(.*)", s)
            if m and not REFUSAL.search(m[1]) and not REFUSAL.search("i" + m[1]) and len(m[1].split()) > 3:
                rest += len(m[1].split())
        elif not _COURTESY.fullmatch(s.strip(" .!?…-*\"'")):
            rest += len(s.split())
        if rest > 3:
            return False
    return hit


_LONGEST = max(map(len, PLACEHOLDERS))
_ALNUM = re.compile(r"[^\W_]")


def is_empty(text: str | None) -> bool:
    """Null, without letters and digits, or nothing but a placeholder, however much else stands around it."""
    if text is None:
        return True
    # folding makes no letter or digit vanish, so a text with more of them than the longest placeholder is none
    n = sum(1 for _ in islice(_ALNUM.finditer(text), _LONGEST + 1))
    return n <= _LONGEST and (n == 0 or content(text) in PLACEHOLDERS)


_FAST = re.compile(r"[\W_]+")


def fast_content(text: str) -> str:
    if text.isascii():
        return text.lower().translate(_ASCII_GONE)
    return _FAST.sub("", text.casefold())


def copies_prompt(prompt: str, answer: str, fast_prompt: str, canon_prompt: str, room: int = 40) -> bool:
    """Nothing but the prompt: reformatted, repeated, announced by a few words, or a large part of it."""
    if not fast_prompt:
        return False
    a = fast_content(answer)
    if fast_prompt[:12] in a or a[:12] in fast_prompt:
        if a in fast_prompt and 2 * len(a) >= len(fast_prompt):
            return True
        if fast_prompt in a:
            rest = a.replace(fast_prompt, "")
            # a last repetition may break off
            if len(rest) <= room or len(rest) < len(fast_prompt) and a.endswith(rest) and fast_prompt.startswith(rest):
                return not is_refusal(answer)
    return abs(len(a) - len(fast_prompt)) <= room + 20 and ("\x1e" in canon_prompt and canonical(answer) == canon_prompt)


def language_scores(text: str) -> Counter:
    """Evidence by language: its distinct function words in the text."""
    s: Counter = Counter()
    for w in _LANG_WORDS.intersection(text.lower().translate(_BREAKS).split()):
        for x, k in _LANG_W[w]:
            s[x] += k
    return s


def language(text: str) -> str | None:
    """The language whose function words prevail; None without evidence."""
    s = language_scores(text).most_common(2)
    return s[0][0] if s and s[0][1] >= 1 and (len(s) == 1 or s[0][1] > s[1][1]) else None


def expected_language(prompt: str) -> str | None:
    """The language the prompt asks for, or else is written in."""
    t = " ".join(folded(prompt).split(" "))
    t = re.sub(r"[^\S\n]+", " ", t)
    for m in _ASKED.finditer(t):
        start = max(t.rfind(x, 0, m.start()) for x in ".!?;/\n") + 1
        part = t[start:m.end()]
        if _ASK_VERB.search(part) or len(part.split()) <= 5:
            return _NAME[m[1]]
    return language(t)


def script(text: str) -> str | None:
    """The script of most letters, judged on all of them; None without letters."""
    if text.isascii() or not _FOREIGN.search(text):
        return "LATIN" if any(c.isalpha() for c in text) else None
    n: Counter = Counter()
    for c, k in Counter(text).items():
        if c.isalpha():
            n[unicodedata.name(c, "?").split(" ")[0]] += k
    return n.most_common(1)[0][0] if n else None


def other_language(prompt_language: str | None, prompt_script: str | None, answer: str) -> bool:
    if prompt_script and not answer.isascii():
        s = script(answer)
        if s and s != prompt_script and prompt_language in (None, *FUNCTION_WORDS):
            return True
    if prompt_language is None:
        return False
    s = language_scores(answer)
    if not s:
        return False
    best, n = max(s.items(), key=lambda x: x[1])
    return best != prompt_language and n >= 1.5 and n >= 1.5 * s.get(prompt_language, 0)


_ITEM = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)]|[a-z][.)])(?:\s+(.*))?$")
_HEAD = re.compile(r"^\s*#+\s*$")
_CLOSERS = "\"”»’')]}*_`~"
_SMILEY = re.compile(r"[:;]-?[)D(P]$")


def _unclosed(text: str) -> bool:
    """A code fence, bracket or double quote that never closes."""
    if text.count("```") % 2:
        return True
    if not any(c in text for c in "([{\"“«"):
        return False
    t = re.sub(r"[:;]-?[()]|^\s*\(?\w{1,3}\)", "", text, flags=re.M)
    return any(t.count(a) > t.count(b) for a, b in ("()", "[]", "{}", "“”", "«»")) or t.count('"') % 2 == 1 and '"' not in re.findall(r"\d\"", t)[:1]


def _opening(t: str) -> int:
    """Where the bracket opens that the last character closes; -1 if nowhere."""
    depth = 0
    for m in re.finditer(r"[()]", t[::-1]):
        depth += 1 if m[0] == ")" else -1
        if not depth:
            return len(t) - 1 - m.start()
    return -1


def ending(text: str) -> tuple[str, str | None]:
    """(verdict, entry): ``cut``, ``whole``, or ``list`` with the last entry of a list that carries no closing mark."""
    t = text.rstrip()
    t = t.rstrip("​‌‍⁠﻿").rstrip()
    if not t:
        return "whole", None
    line = t[t.rfind("\n") + 1:]
    m = _ITEM.match(line)
    if _HEAD.match(line) or m and not (m[1] or "").strip():
        return "cut", None
    if _unclosed(t):
        return "cut", None
    last = t[-1]
    if _SMILEY.search(t):
        return "whole", None
    core = t.rstrip(_CLOSERS).rstrip()
    if not core:
        return "whole", None
    c = core[-1]
    if c in ".!?…。！？।؟":
        # "1." or a bare abbreviation would be caught above; a full stop ends the text
        return "whole", None
    if not c.isalnum() and unicodedata.category(c) in ("So", "Sk", "Mn", "Cf"):  # emoji
        return "whole", None
    if last == ")" and not m and t[:max(_opening(t), 0)].rstrip()[-1:].isalnum():
        return "whole", None
    if m and c.isalnum():
        return "list", m[1].strip()
    return "cut", None


def list_entries(text: str) -> list[str]:
    """The entries of lists without closing marks, but for one that ends the text."""
    lines = [x for x in text.rstrip().split("\n") if x.strip()]
    out = []
    for k, x in enumerate(lines):
        m = _ITEM.match(x)
        if m and m[1] and m[1].strip()[-1:].isalnum() and k < len(lines) - 1:
            out.append(m[1].strip())
    return out


def _entry_words(entry: str) -> list[str]:
    return re.findall(r"\d+|[^\W\d_]+(?:[-'’][^\W\d_]+)*", entry.lower())


def entry_keys(ws: list[str]) -> tuple[str, str]:
    """The last two words and the last word, digits as 0."""
    w = ["0" if x.isdigit() else x for x in ws[-2:]]
    return " ".join(w if len(w) > 1 else ["^", *w]), w[-1] if w else ""


def answers(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """origin, record_key, slot, prompt, answer of every answer of both tables."""
    r = raw.select(F.lit("raw").alias("origin"), F.col("row_no").cast("string").alias("record_key"), F.col("instruction").alias("prompt"), F.explode("responses").alias("slot", "answer"))
    p = pairs.select(F.lit("dpo_pairs").alias("origin"), F.col("pair_id").alias("record_key"), "prompt", F.explode(F.create_map(F.lit("chosen"), "chosen", F.lit("rejected"), "rejected")).alias("slot", "answer"))
    return r.unionByName(p).select("origin", "record_key", "slot", "prompt", "answer")


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ends: Counter = Counter()
        goes: Counter = Counter()
        for t in b["answer"]:
            for e in list_entries(t):
                ws = ["0" if x.isdigit() else x for x in _entry_words(e)]
                padded = ["^", *ws]
                for k in range(1, len(padded)):
                    at = ends if k == len(padded) - 1 else goes
                    at[f"{padded[k - 1]} {padded[k]}"] += 1
                    at[padded[k]] += 1
        keys = list(ends | goes)
        yield pd.DataFrame({"key": keys, "ends": [ends[k] for k in keys], "goes": [goes[k] for k in keys]}).astype({"key": "object", "ends": "int64", "goes": "int64"})


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out, of = [], {}
        for origin, key, slot, prompt, answer in zip(b["origin"], b["record_key"], b["slot"], b["prompt"], b["answer"]):
            if is_empty(answer):
                out.append((origin, key, slot, "empty", None, None))
                continue
            if prompt not in of:
                p = prompt or ""
                has = any(c.isalnum() for c in p)
                of[prompt] = (fast_content(p), canonical(p) if ":" in p or "=" in p else "", expected_language(p) if has else None, script(p) if has else None)
            fast, canon, lang, scr = of[prompt]
            if copies_prompt(prompt, answer, fast, canon):
                out.append((origin, key, slot, "copies_prompt", None, None))
            if is_refusal(answer):
                out.append((origin, key, slot, "refusal", None, None))
            verdict, entry = ending(answer)
            if verdict == "cut":
                out.append((origin, key, slot, "truncated", None, None))
            elif verdict == "list":
                out.append((origin, key, slot, "truncated", *entry_keys(_entry_words(entry))))
            if other_language(lang, scr, answer):
                out.append((origin, key, slot, "other_language", None, None))
        yield pd.DataFrame(out, columns=["origin", "record_key", "slot", "defect", "two", "one"], dtype=object)


def defects(rows: DataFrame) -> DataFrame:
    """origin, record_key, slot, defect: every triggered defect of ``rows`` (see ``answers``)."""
    listed = rows.where(F.col("answer").rlike(r"\n\s*(?:[-*•–+]|\d{1,3}[.)]|[a-z][.)])\s")).select("answer")
    stats = listed.mapInPandas(_stats, "key string, ends bigint, goes bigint").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    hits = land(rows.mapInPandas(_rules, "origin string, record_key string, slot string, defect string, two string, one string"))
    sure, open_ = hits.where("one is null"), hits.where("one is not null")
    two = stats.select(F.col("key").alias("two"), F.col("ends").alias("ends2"), F.col("goes").alias("goes2"))
    one = stats.select(F.col("key").alias("one"), F.col("ends").alias("ends1"), F.col("goes").alias("goes1"))
    judged = open_.join(two, "two", "left").join(one, "one", "left").where(
        F.when(F.col("ends2").isNotNull(), F.col("ends2") * 2 < F.col("goes2")).when(F.col("ends1").isNotNull(), F.col("ends1") * 2 < F.col("goes1")).otherwise(True))
    return sure.select("origin", "record_key", "slot", "defect").unionByName(judged.select("origin", "record_key", "slot", "defect"))


def first_defects(rows: DataFrame) -> DataFrame:
    """origin, record_key, slot, defect: the first triggered defect of each answer, in the order of the rules."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("defect"))
    return defects(rows).groupBy("origin", "record_key", "slot").agg(F.min(rank).alias("rank")).select(
        "origin", "record_key", "slot", F.element_at(F.array(*[F.lit(x) for x in ORDER]), F.col("rank").cast("int")).alias("defect"))


def found(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    return first_defects(answers(raw, pairs)).where("record_key is not null")
