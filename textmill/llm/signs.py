"""Exact signs of a wrong decoding in words: what the classifier of garbled.py names is checked against them (problem 9)."""

from __future__ import annotations

import re
from functools import cache, lru_cache


#: UTF-8 read as one of these. Bytes that one doesn't define are kept as the control of the same number.
SINGLE = ("cp1252", "latin-1", "iso8859-15", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866")
SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: What such a sequence may stand for; Latin Extended-A only as in French, since Ä before a closing quote looks like it.
MEANT = re.compile("[ -ÿŒœΑ-ωЀ-џ‐-‧‰-›€™←-⇿∀-⋿■-➿　-〿一-鿿！-￮\U0001f300-\U0001faff]")
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
HIGH_RUN = re.compile("[¡-¬®-ſ]{4,}")
KATAKANA = re.compile("[｡-ﾟ]")
CASE_SWAP = re.compile("(?<![А-Яа-яЁё])[а-яё][А-ЯЁ]{2,}(?![а-яё])")
NOT_RUSSIAN = re.compile("[Ђ-Џђ-џҐґ]")
#: A letter of cp1252 read as cp437, cp850 or mac_roman, or the other way round, between small letters.
SWAPPED = re.compile(r"[a-zß-ÿ](?:[ΘΣΦΩΓπστφδεⁿ╡▒░▀▄█¸ˆ‰„‚÷³§¶ŽŠŸ¤¨´≤≥√∂∆][a-zß-ÿ]|[ÀÈÌÒÙÚÛÕÆ][a-zß-ÿ])|[a-z]Æ[Θa-z]|[а-яА-ЯA-Za-z][╚╩╠═╬╔╦╗╝╣║]|[╚╩╠═╬╔╦╗╝╣║][а-яА-ЯA-Za-z]")


@cache
def table(codec: str) -> dict[str, bytes]:
    out = {chr(b): bytes([b]) for b in range(128, 160)}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = bytes([b])
        except UnicodeDecodeError:
            pass
    return out


@cache
def known(codec: str) -> re.Pattern[str]:
    return re.compile("[" + re.escape("".join(table(codec))) + "]{2,}")


def undone(run: str, codec: str) -> tuple[str, int, int]:
    """The run with UTF-8 sequences put right; how many there were, and how many meant a Cyrillic letter."""
    to, n, cyrillic = table(codec), 0, 0

    def right(part: re.Match[str]) -> str:
        nonlocal n, cyrillic
        at, kept = 0, []
        for m in SEQUENCE.finditer(b"".join(to[c] for c in part[0])):
            try:
                c = m[0].decode()
            except UnicodeDecodeError:
                continue
            # In a Cyrillic encoding, right words of three letters would mean a Han character.
            if MEANT.fullmatch(c) and (c < "\u3000" or codec not in CYRILLIC):
                kept.append(part[0][at : m.start()] + c)
                at, n, cyrillic = m.end(), n + 1, cyrillic + ("Ѐ" <= c <= "џ")
        return "".join(kept) + part[0][at:]

    return known(codec).sub(right, run), n, cyrillic


CYRILLIC = ("cp1251", "koi8-r", "cp866")
RUN = re.compile(r"[^\x00-\x7f]{2,}")
HAN = re.compile("[一-鿿㐀-䶿\ue000-\uf8ff\u3000-\u303f！-￮€�]{4,}")
RNA = re.compile("[а-я]{1,2}(?:РНК|ДНК)")
SMALL_FIRST = re.compile("(?<![А-Яа-яЁё])(?!рН)[а-яё][А-ЯЁ]")
CAPITALS = re.compile("(?<![А-Яа-яЁё])[А-ЯЁ]{5,}")


def read_as_gbk(text: str) -> bool:
    for run in HAN.findall(text):
        data = run.replace("�", "").encode("gb18030", "ignore")
        if sum(len(m[0]) for m in re.finditer(rb"[\xe2-\xe9\xef][\x80-\xbf]{2}", data)) >= 0.75 * len(data) > 0:
            return True
    return False


@lru_cache(200_000)
def signs(word: str) -> tuple[bool, int, int, bool, tuple[tuple[int, int, int], ...], bool]:
    """What a word between spaces shows: a sure sign, words in swapped case, letters not Russian, capitals, and for each of SINGLE the sequences, the Cyrillic ones and the most of these in a run, a small letter before a capital."""
    sure = bool("�" in word or CONTROL.search(word) or KATAKANA.search(word) or HIGH_RUN.search(word) or SWAPPED.search(word) or read_as_gbk(word))
    swapped = len(CASE_SWAP.findall(RNA.sub("", word)))
    counts = []
    runs = RUN.findall(word)
    for codec in SINGLE if runs else ():
        n = [undone(run, codec)[1:] for run in runs]
        counts.append((sum(x for x, _ in n), sum(x for _, x in n), max(x for _, x in n)))
    return sure, swapped, len(NOT_RUSSIAN.findall(word)), bool(CAPITALS.search(word)), tuple(counts), bool(SMALL_FIRST.search(word))


def of_words(text: str) -> list[tuple]:
    return [signs(w) for w in text.split(" ") if not w.isascii()]


def misread(text: str, words: list[tuple] | None = None) -> str | None:
    """The single-byte encoding in which UTF-8 was read, in at least one sequence."""
    found = [w[4] for w in (of_words(text) if words is None else words) if w[4]]
    for i, codec in enumerate(SINGLE if found else ()):
        n, cyrillic, longest = sum(x[i][0] for x in found), sum(x[i][1] for x in found), max(x[i][2] for x in found)
        if codec in CYRILLIC or codec == "mac_roman":
            # A single pair may be right here: a dash and a letter, a capital and a quote.
            plain = n - cyrillic
            if (codec == "mac_roman" and plain) or longest >= 2 or cyrillic >= 3 or plain >= 2:
                return codec
        elif n:
            return codec
    return None


def is_garbled(text: str | None) -> bool:
    if not text or text.isascii():
        return False
    words = of_words(text)
    swapped = sum(w[1] for w in words)
    return (
        any(w[0] for w in words)
        or swapped >= 2
        or (swapped == 1 and any(w[3] for w in words))
        or (sum(w[3] for w in words) >= 3 and any(w[5] for w in words))
        or sum(w[2] for w in words) >= 3
        or misread(text, words) is not None
    )


def restored(text: str | None) -> str | None:
    """The text with sequences of UTF-8 put right that were read in a single-byte encoding, once or more often; else null."""
    out = text
    for _ in range(3):
        codec = misread(out or "")
        if not codec:
            break
        out = RUN.sub(lambda m: undone(m[0], codec)[0], out)
    return out if out and out != text and not is_garbled(out) else None
