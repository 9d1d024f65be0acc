"""What the operators on answers know of texts: content, how a text ends, its language, what it shares with another."""

from __future__ import annotations

import re
from functools import lru_cache

#: Texts of nothing but these words are placeholders.
PLACEHOLDERS = {"", "n a", "na", "nan", "none", "null", "nil", "empty", "no output", "no answer", "no response", "no text", "answer answer", "response response", "output output", "blank", "undefined", "todo", "tbd"}
INVISIBLE = re.compile("[​-‏ -‮⁠-⁯﻿­︎️᠎\x00-\x08\x0e-\x1f\x7f]")
MARK = re.compile(r"(?:\.{3,}|…|\.\s\.\s\.|[\[(<{]\s*(?:\.{2,}|…|(?:output |text |response |answer )?(?:truncated|cut(?: off| here)?|cont(?:inued|\.)?|to be continued|snip(?:ped)?|max[ _]tokens?|length limit|abgeschnitten|gekürzt|tronqué|coupé|cortado|truncado))\.{0,3}\s*[\])>}])\W*$", re.I)
STOPS = ".!?。！？؟।"
CLOSERS = "\"'”’»›)]}*_`~）」』】“"
NOTE = re.compile(r"\s*(?:\[\d+(?:\s*[,–-]\s*\d+)*\]|\((?:see|siehe|voir|véase|ver|cf\.?|vgl\.?)?\s*(?:note|fig(?:ure)?|ref|table|anm(?:erkung)?|nota|abb)?\.?\s*\d+\)|[¹²³⁰⁴-⁹]+)\s*$", re.I)
ITEM = re.compile(r"\s*(?:[-*•+–]|\d+[.)]|[a-z][.)])\s+(\S.*)$")
LABEL = re.compile(r"[*_]*(?!.*(?:hypoth|hipót|idea|idée|propos|vorschlag|vermut).*[:：])[^\W\d][^\s:：.!?]*(?: [^\s:：.!?]+){0,2}[*_]*\s?[:：][*_]*\s*\S+(?: \S+){0,5}$", re.I)
SIGN_OFF = re.compile(r"(?:[—–=*~#-]+\s*\S[^.]{0,60}\S\s*[—–=*~#-]+|[<\[]\|?/?[\w ]{2,40}\|?[>\]]|[*=_—–-]{3,}|∎|■|□)$")
LAST_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*$")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s*|\n+")
LETTER = re.compile(r"[^\W_]")

EMPTY, MARKED, OPEN, LOOSE, ENDED = "empty", "marked", "open", "loose", "ended"


def has_content(text: str | None) -> bool:
    """Whether there is anything that can be read as an answer."""
    return text is not None and " ".join(re.findall(r"[^\W_]+", INVISIBLE.sub("", text).lower())) not in PLACEHOLDERS


def ending(text: str | None) -> str:
    """How a text ends: empty (nothing to read), marked (a mark of a cut), open (inside a sentence, number, table or block of code), loose (a list's item or a line with a label, whole without a stop), ended."""
    if not has_content(text):
        return EMPTY
    text = INVISIBLE.sub("", text).rstrip()
    if MARK.search(text) or text.endswith("�"):
        return MARKED
    if text.count("```") and len(re.findall(r"(?m)^\s*```", text)) % 2:
        return OPEN
    if text.endswith("```"):
        return ENDED
    lines = text.split("\n")
    last = lines[-1].strip()
    if last.startswith("|"):
        row = last.endswith("|") and len(last) > 1 and (len(lines) < 2 or not lines[-2].strip().startswith("|") or last.count("|") == lines[-2].count("|"))
        return ENDED if row else OPEN
    if SIGN_OFF.match(last):
        return ENDED
    body = NOTE.sub("", text)
    while body and body[-1] in CLOSERS:
        body = body[:-1].rstrip()
    if body and body[-1] in STOPS:
        if re.search(r"(?:^|\n)\s*\d+\.$", body):
            return OPEN  # only the number of the next item
        # "(± 2." is a number cut at its point
        cut = re.search(r"\d\.$", body) and body.rfind("(") > body.rfind(")") and not text.endswith(")")
        return OPEN if cut else ENDED
    if body and body[-1] in ",;:–—-(±/、，；：=&+":
        return OPEN
    if m := ITEM.match(lines[-1]):
        before = next((x for x in reversed(lines[:-1]) if x.strip()), "")
        return LOOSE if ITEM.match(before) and before.rstrip()[-1] not in STOPS and len(m[1]) <= 80 else OPEN
    return LOOSE if len(last) <= 80 and LABEL.match(last) and (len(lines) < 2 or not lines[-2].strip()) else OPEN


def last_word(text: str | None) -> str | None:
    """The word that a text ends with, in small letters, if it ends with one (before a mark of a cut too)."""
    if not text:
        return None
    text = INVISIBLE.sub("", text).rstrip()
    m = LAST_WORD.search(MARK.sub("", text).rstrip())
    return m[0].lower() if m else None


#: Frequent words of each language.
WORDS = {
    "en": "the of and that is in to with by for are as be we this it from at how what does which not can or an",
    "de": "der die das und ist nicht mit bei von zu den dem ein eine einer eines wir dass wie auf für sich wird als oder im werden durch",
    "fr": "le les des et est dans une un que qui pour par nous avec du au aux chez sur ne pas ce cette se plutôt comment quel la de",
    "es": "el los las y es en una un que por para con del al se no como su lo más esta este entre cómo qué la de",
}
WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}
NAMED = {
    "en": r"\bin english\b|auf englisch|en anglais|en inglés|用英[语文]|по-английски",
    "de": r"\bin german\b|auf deutsch|en allemand|en alemán|用德[语文]|по-немецки",
    "fr": r"\bin french\b|auf französisch|en français|en francés|用法[语文]|по-французски",
    "es": r"\bin spanish\b|auf spanisch|en espagnol|en español|用西班牙[语文]|по-испански",
    "zh": r"\bin chinese\b|auf chinesisch|en chinois|en chino|用中文|用汉语|по-китайски",
    "ru": r"\bin russian\b|auf russisch|en russe|en ruso|用俄[语文]|по-русски",
}
NAMED = {k: re.compile(v, re.I) for k, v in NAMED.items()}
OTHER_SCRIPT = re.compile("[一-鿿Ѐ-ӿ]")


def language(text: str) -> str | None:
    """The language that most of the text is in, by script and frequent words."""
    if OTHER_SCRIPT.search(text):
        han, cyrillic, latin = (len(re.findall(p, text)) for p in ("[一-鿿]", "[Ѐ-ӿ]", r"[A-Za-zÀ-ÿ]"))
        if han * 2 > latin:
            return "zh" if han else None
        if cyrillic > latin:
            return "ru"
    words = re.findall(r"[^\W\d_]+", text.lower())
    counts = {k: sum(w in s for w in words) for k, s in WORDS.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] else None


@lru_cache(4096)
def asked_language(prompt: str) -> str | None:
    """The language the instruction names for the answer, else the prompt's own."""
    head = re.split(r"\n\s*\n", prompt)[0]
    return next((k for k, p in NAMED.items() if p.search(head)), None) or language(prompt)


def grams(text: str, n: int = 5) -> frozenset[str]:
    s = "".join(re.findall(r"[^\W_]+", text.lower()))
    return frozenset(s[i : i + n] for i in range(max(1, len(s) - n + 1)))


kept_grams = lru_cache(4096)(grams)


def share_of(text: str, prompt: str) -> float:
    """The share of the text's letter 5-grams that the prompt has."""
    own = grams(text)
    return len(own & kept_grams(prompt)) / max(1, len(own))


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if LETTER.search(s)]
