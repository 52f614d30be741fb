"""The rules that are plain patterns, as native expressions, and the anomaly test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookflow.functions.text import ASCII_BREAK, LETTERS, LOWER, UPPER, WS, trimmed

# Number in the catalog, pattern, replacement.
LITERAL_RULES = (
    (1, r"[\u00AD\u200B\u200C\u200D\uFEFF]", ""),
    (4, f"([{LETTERS}])[·•]([{LETTERS}])", "$1$2"),
    (13, rf"{WS}+([,.!?:;])", "$1"),
    (53, rf"\.{WS}*,+", "."),
    (54, rf",{WS}*,+", ","),
    (55, rf":{WS}*:+", ":"),
    (56, rf";{WS}*;+", ";"),
    (89, rf"\.{WS}+\.{WS}+\.", "..."),
    (90, rf"([{LETTERS}0-9]+){WS}+(['’])([{LETTERS}]+)", "$1$2$3"),
    (91, rf"(?<=[.?!:»\"']){WS}+[0-9]{{1,4}}\.?{WS}+(?=[{UPPER}])", " "),
    (92, rf"(?<=[.?!:»\"']){WS}+[0-9]{{1,4}}\.?{WS}*\z", ""),
)

#: Patterns that put the same in place, without a search from each letter of a word: what stands before its last one stays as it is.
SHORTER = {90: rf"([{LETTERS}0-9]){WS}+(['’])([{LETTERS}]+)"}

# Phrases of short words that are no split word.
SHORT_PHRASES = (
    "o da bir", "bu da bir", "şu da bir", "ne de olsa", "az da olsa", "ve ya da", "o ve bu", "ya da o", "o da o",
    "bu da bu", "ne de bir", "ve de bir", "en az bir", "en çok bir", "o da ne", "şu da var", "bir de bu", "bir de o",
)
# Beginnings of words that are a known confusion.
CONFUSED = (
    "yarm kamı öğmeci öğmek soma bumu karamlı imsan ayrımlı davra korkumç düşümce uyam yalmız yamlış tuma tumuva kame tarnarn zarnan adarn akşarn "
    "andınyor andıryor görünrn tükenrn bölünrn claha cliye cliyen clil clüşün clünya clönem clur cla cle clegil cleğil clost cloktor clerece cluygu "
    "clurum clevam clüzen clere cleniz clol clön"
).split()
_CONSONANTS = "bcçdfgğhjklmnprsştvyzBCÇDFGĞHJKLMNPRSŞTVYZ"
_ANY_CASE = "A-Za-zçÇğĞİöÖşŞüÜ"


def both_cases(text: str) -> str:
    """A pattern that takes each letter in either case; i with I, and ı and İ alone."""
    upper = {"i": "I"}
    return "".join(f"[{c}{upper.get(c, c.upper())}]" if c.isalpha() and c not in "ıİ" else c for c in text)


FOOTNOTES = r"(?is)<aside\b[^>]*>.*?</aside>|<a\b[^>]*\bepub:type=[\"']noteref[\"'][^>]*>.*?</a>|\[\^[a-zA-Z0-9_:-]+\]:?|\^[a-zA-Z0-9_:-]+:?"
_FIRST = {w[0]: [v for v in CONFUSED if v[0] == w[0]] for w in CONFUSED}
_CONFUSED = "|".join(f"{both_cases(first)}(?:{'|'.join(both_cases(w[1:]) for w in words)})" for first, words in _FIRST.items())
#: What the tests find somewhere in a text. Only whether there is a match counts, so a run is no longer than it need be: one sign before a gap stands for the word that ends in it, and a gap before a full stop for three stops with gaps.
ANOMALIES = (
    r"[\uFFFDÔÊôê@#$\\/|<>~]",
    rf"[.,],|::|;;|{WS}[,.!?:;]",
    "[cC][lL][aeıioöuüAEIOÖUÜ]",
    f"[{LETTERS}0-9]-{WS}+[{LETTERS}]",
    f"[A-Za-z0-9_]{WS}+['’][A-Za-z0-9_]",
    f"(?<![A-Za-z0-9_])(?:{both_cases('bir çok')}(?![A-Za-z0-9_])|{both_cases('her hangi')}(?![A-Za-z0-9_])|{both_cases('bir kaç')}(?=[A-Za-z0-9_])|{both_cases('bir az')}(?![A-Za-z0-9_])|{both_cases('hiç bir')}(?![A-Za-z0-9_]))",
    f"(?<![{_ANY_CASE}])[{_CONSONANTS}]{{5,}}(?![{_ANY_CASE}])",
    f"(?<![{LETTERS}])(?:{_CONFUSED}|{both_cases('farkıma')}{WS}+{both_cases('var')})[A-Za-z0-9_]*(?![{LETTERS}])",
)
#: A capital inside a word; looked for where a capital stands after a small letter.
INNER_CAPITAL = f"{ASCII_BREAK}[{LOWER}]+[{UPPER}]+[{LOWER}]+{ASCII_BREAK}"
SPLIT_LETTERS = rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{1,2}}{WS}+\p{{L}}{{1,2}}{WS}+\p{{L}}{{1,2}}(?![\p{{L}}\p{{N}}])"


def clean_literal(text: Column, numbers: tuple[int, ...] = tuple(r[0] for r in LITERAL_RULES)) -> Column:
    """The literal rules in catalog order, each on the one before's output."""
    for number, pattern, to in LITERAL_RULES:
        if number in numbers:
            text = F.regexp_replace(text, SHORTER.get(number, pattern), to)
    return text


def has_anomaly(text: Column, split_letters: bool = True) -> Column:
    """Whether a text still looks damaged, footnote marks aside. A null or blank text doesn't.

    The text without its marks is the one element of an array that the tests run
    on, so it is made once; texts without a sign of a mark are taken as they are.
    """

    def damaged(plain: Column) -> Column:
        hit = F.lit(False)
        for pattern in ANOMALIES:
            hit = hit | plain.rlike(pattern)
        hit = hit | plain.rlike(f"[{LOWER}][{UPPER}]") & plain.rlike(INNER_CAPITAL)
        if split_letters:
            found = F.regexp_extract_all(plain, F.lit(f"({SPLIT_LETTERS})"), 1)
            hit = hit | F.exists(found, lambda m: ~F.lower(m).isin(*SHORT_PHRASES))
        return (plain != "") & hit

    plain = trimmed(F.when(text.rlike("[<^]"), F.regexp_replace(text, FOOTNOTES, "")).otherwise(text))
    return F.coalesce(F.exists(F.array(plain), damaged), F.lit(False))
