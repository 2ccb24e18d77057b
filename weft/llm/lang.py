"""Language votes by stopwords and scripts, and languages that a text names."""

from __future__ import annotations

from collections import Counter

import regex

# Frequent function words per language, and the languages' names in all of them.
STOPWORDS = {
    "en": "the and of to is are was were with for not that this have has you your it from at by on my be as an there or if one which what who how i we they been",
    "de": "der die das und ist sind war waren mit für nicht dass den dem des ein eine einen zu von auf im am bei noch nur es ich wir sie wie bis hat haben wurde liegt jetzt nach",
    "es": "el la los las y es son fue con para no que un una de en por del al se lo más como su hay ya si pero entre junto hasta queda lado",
    "fr": "le la les et est sont était avec pour ne pas que un une de des du à en au aux se ce qui plus comme son il je chez entre reste depuis jusqu sur",
    "pt": "o a os as e é são foi com para não que um uma de do da dos das em no na ao se mais como seu há já mas entre até uma pelo ao lado pela",
    "it": "il che di gli della delle dei degli nel nella alla sono è ha ho questo questa anche più dal dalla sul sulla perché stato stata erano",
    "nl": "het een van niet dat zijn voor met op te aan maar ook naar wordt deze worden heeft hebben bij uit dan geen werd nog waar",
    "pl": "nie jest się że jak do przez oraz ale który która które dla są był była było już od został została",
    "sv": "och är det som inte att en ett av på för med till den har var han hon också kan från men efter",
    "tr": "bir ve bu için ile olarak değil daha çok olan gibi kadar ancak sonra ya da var yok",
}
NAMES = {
    "en": "english|englisch|inglés|anglais|inglês|英文|英语",
    "de": "german|deutsch|alemán|allemand|alemão|德文|德语",
    "es": "spanish|spanisch|español|castellano|espagnol|espanhol|西班牙文|西班牙语",
    "fr": "french|französisch|francés|français|francês|法文|法语",
    "pt": "portuguese|portugiesisch|portugués|portugais|português|葡萄牙文|葡萄牙语",
    "zh": "chinese|chinesisch|chino|chinois|chinês|中文|汉语|普通话",
    "it": "italian|italienisch|italiano|italien|意大利",
    "nl": "dutch|niederländisch|holländisch|neerlandés|holandés|néerlandais|holandês|neerlandês|荷兰",
    "pl": "polish|polnisch|polaco|polonais|polonês|波兰",
    "sv": "swedish|schwedisch|sueco|suédois|瑞典",
    "tr": "turkish|türkisch|turco|turc|土耳其",
    "ja": "japanese|japanisch|japonés|japonais|japonês|日文|日语",
    "ko": "korean|koreanisch|coreano|coréen|韩文|韩语",
    "ru": "russian|russisch|ruso|russe|russo|俄文|俄语",
    "ar": "arabic|arabisch|árabe|arabe|阿拉伯",
    "el": "greek|griechisch|griego|grec|grego|希腊",
    "he": "hebrew|hebräisch|hebreo|hébreu|hebraico|希伯来",
    "hi": "hindi|印地",
    "th": "thai|tailandés|thaï|tailandês|泰语|泰文",
}
#: English names of languages as instructions have them.
CODES = {v.split("|")[0]: k for k, v in NAMES.items()}
#: Scripts that stand for a language of their own; kana go before Han, which Japanese uses, too.
SCRIPTS = {"ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "ko": r"\p{Hangul}", "ru": r"\p{Cyrillic}", "ar": r"\p{Arabic}", "el": r"\p{Greek}", "he": r"\p{Hebrew}", "hi": r"\p{Devanagari}", "th": r"\p{Thai}"}
#: A language that is none of the known ones.
OTHER = "other"

_SETS = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
#: Each function word with the languages that have it; a word of several gives each its part of a vote.
_HELD: dict[str, list[str]] = {}
for _language, _words in _SETS.items():
    for _w in _words:
        _HELD.setdefault(_w, []).append(_language)
_WORD = regex.compile(r"[^\W\d_]+")
_SCRIPTS = {k: regex.compile(v) for k, v in SCRIPTS.items()}
_FOREIGN = regex.compile(r"[^\p{Latin}\p{Common}\p{Inherited}]")
_NAMES = {k: regex.compile(v) for k, v in NAMES.items()}


def is_function_word(word: str) -> bool:
    return word in _HELD and len(word) > 1


def vote(text: str, least: int = 2) -> str | None:
    """The language with most votes, ``other`` for running text without any vote; None with few votes or no clear lead."""
    found = _WORD.findall(text.lower())
    if _FOREIGN.search(text):
        letters = sum(map(len, found))
        counts = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
        if counts["ja"] >= 2 and counts["ja"] + counts["zh"] >= 0.3 * letters:
            return "ja"
        top = max(counts, key=lambda k: counts[k])
        if counts[top] >= 4 and counts[top] >= 0.3 * letters:
            return top
    votes: Counter[str] = Counter()
    for w in found:
        held = _HELD.get(w)
        if held:
            for k in held:
                votes[k] += 1 / len(held)
    best = votes.most_common(2)
    if not best:
        # running text has small words; a dozen of its own without a single known one speak another language
        small = [w for w in found if len(w) > 1]
        return OTHER if len(small) >= 12 and sum(len(w) <= 4 for w in small) * 4 >= len(small) else None
    (first, n), second = best[0], best[1][1] if len(best) > 1 else 0.0
    return first if n >= least and n >= 1.25 * second else None


def named_languages(text: str) -> set[str]:
    low = text.lower()
    return {k for k, p in _NAMES.items() if p.search(low)}
