"""Words, stems, terms and language, as expressions over one text column.

Word boundaries follow the Unicode rules for scripts written with spaces: letters, digits and
``_`` run together, ``'`` ``.`` and a few others join two letters or two digits, everything else
separates. Chinese and Japanese runs need a dictionary for real words; without one they give
their overlapping pairs of characters.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import BASE_EN, CLOUD_EN, STOP_JA, STOP_ZH

# Character ranges, and how many characters decide a language.
HAN = "一-龥"
KANA = "぀-ヿ"
DECIDING_COUNT = 3

# Shortest term, and the shape of a Latin word and of a number.
SHORTEST_TERM = 2
LATIN = "^[a-z0-9']+$"
DIGITS = "^[0-9]+$"

# Scripts written without spaces: Han, its marks and extensions, and kana.
CJK = "々-〇぀-ヿ㐀-䶿一-鿿豈-﫿𠀀-𲎯"
HAS_CJK = f"[{CJK}]"
CJK_RUN = f"[{CJK}]++"
CJK_START = f"^[{CJK}]"

# Boundary classes. Plain letters are tried first because they are cheapest to recognise; possessive
# repeats keep the matcher from recursing on very long words.
_LETTER = rf"[\p{{L}}\p{{M}}\p{{Nl}}&&[^{CJK}]]"
_JOINS_LETTERS = rf"(?:['‘’.․＇．··‧](?={_LETTER}))?+"
_JOINS_DIGITS = r"(?:['‘’.․＇．,;٬](?=\p{Nd}))?+"
WORD = rf"((?:[a-z]++{_JOINS_LETTERS}|{_LETTER}++{_JOINS_LETTERS}|\p{{Nd}}++{_JOINS_DIGITS}|_)++)"


def analysis_text(title: Column, preview: Column) -> Column:
    """The text that term statistics are taken from."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(preview, F.lit("")))


def has_cjk(text: Column) -> Column:
    """Whether the text has Han or kana; pure ASCII is told from its length alone."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(HAS_CJK)


def detect_language(text: Column) -> Column:
    """``ja`` by kana, else ``zh`` by Han characters, else ``en``."""
    kana = F.regexp_count(text, F.lit(f"[{KANA}]"))
    han = F.regexp_count(text, F.lit(f"[{HAN}]"))
    decided = F.when(kana > DECIDING_COUNT, "ja").when(han > DECIDING_COUNT, "zh").otherwise("en")
    return F.when(has_cjk(text), decided).otherwise("en")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def stem(word: str) -> Column:
    """Light English suffix cut of a word column; the first rule that fits wins."""
    return F.expr(_stem(word))


def _stem(w: str) -> str:
    return f"""CASE
        WHEN length({w}) < 4 THEN {w}
        WHEN endswith({w}, 'ing') AND length({w}) > 5 THEN left({w}, length({w}) - 3)
        WHEN endswith({w}, 'ies') AND length({w}) > 4 THEN concat(left({w}, length({w}) - 3), 'y')
        WHEN endswith({w}, 'es') AND length({w}) > 4 THEN left({w}, length({w}) - 2)
        WHEN endswith({w}, 's') AND NOT endswith({w}, 'ss') THEN left({w}, length({w}) - 1)
        WHEN endswith({w}, 'ed') AND length({w}) > 4 THEN left({w}, length({w}) - 2)
        ELSE {w} END"""


def without_possessive(word: str) -> Column:
    return F.expr(f"if(endswith({word}, \"'s\"), left({word}, length({word}) - 2), {word})")


def _noise(w: str, stop_words) -> str:
    # Only what starts with a digit can be a number; that is cheaper to see than to match.
    number = f"({w} >= '0' AND {w} < ':' AND {w} RLIKE '{DIGITS}')"
    return f"(length({w}) < {SHORTEST_TERM} OR {number} OR {w} IN ({quoted(stop_words)}))"


def is_noise(word: str, stop_words) -> Column:
    """Whether a word is too short, a number, or one of the stop words."""
    return F.expr(_noise(word, stop_words))


def pairs(run: Column) -> Column:
    """Overlapping two-character pieces of a run."""
    n = F.length(run)
    starts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(run, i, F.lit(2)))


def words(lowered: Column) -> Column:
    """Words of lower-cased text, in text order."""
    mixed = F.flatten(
        F.transform(
            F.regexp_extract_all(lowered, F.lit(f"({CJK_RUN}|{WORD})"), F.lit(1)),
            lambda w: F.when(w.rlike(CJK_START), pairs(w)).otherwise(F.array(w)),
        )
    )
    return F.when(has_cjk(lowered), mixed).otherwise(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(1)))


def term(base: str, language: str, stop_words=BASE_EN) -> Column:
    """Scoring term of a word without its possessive, or null for noise.

    Latin words are filtered and stemmed; all others only need two characters and must not be
    Chinese or Japanese function words. ``base`` and ``language`` name columns: an expression in
    their place would be worked out again at every mention.
    """
    return F.expr(
        f"""CASE
        WHEN {base} RLIKE "{LATIN}" THEN CASE WHEN NOT {_noise(base, stop_words)} THEN {_stem(base)} END
        WHEN length({base}) >= {SHORTEST_TERM} AND NOT {_cjk_stop(base, language)} THEN {base} END"""
    )


def is_cjk_keyword(word: str, language: str) -> Column:
    """Whether a word of a Chinese or Japanese document is shown in a cloud."""
    kept = f"{word} RLIKE \"{LATIN}\" OR (length({word}) >= {SHORTEST_TERM} AND NOT {_cjk_stop(word, language)})"
    return F.expr(f"({kept}) AND NOT {_noise(word, CLOUD_EN)}")


def cjk_keyword_key(word: str) -> Column:
    """What such words are grouped by."""
    return F.expr(f"CASE WHEN {word} RLIKE \"{LATIN}\" THEN {_stem(word)} ELSE {word} END")


def _cjk_stop(word: str, language: str) -> str:
    return f"({word} IN ({quoted(STOP_ZH)}) OR ({language} = 'ja' AND {word} IN ({quoted(STOP_JA)})))"


def content_words(words: str) -> Column:
    """The words of a document, null in the place of those that are no Latin content words."""
    return F.expr(f"transform({words}, w -> CASE WHEN w RLIKE \"{LATIN}\" AND NOT {_noise('w', CLOUD_EN)} THEN w END)")


def keyword_surfaces(content: str) -> Column:
    """Content words of a document and pairs of different neighbours that are both content words; null in the place of others.

    ``content`` names a column: an expression in its place would be worked out again at every mention.
    """
    following = F.slice(content, 2, F.greatest(F.size(content), F.lit(1)))
    neighbours = F.zip_with(content, following, lambda a, b: F.when(a != b, F.concat(a, F.lit(" "), b)))
    return F.concat(F.col(content), neighbours)


def keyword_parts(surface: str) -> tuple[Column, Column]:
    """The word, or the two words of a pair; the second is null for a word."""
    second = F.when(F.contains(F.col(surface), F.lit(" ")), F.substring_index(surface, " ", -1))
    return F.substring_index(surface, " ", 1), second


def keyword_key(first: str, second: str) -> Column:
    """What a word or a pair is grouped by: its stems. The arguments name columns of its parts, so that these are cut once."""
    return F.expr(f"concat_ws(' ', {_stem(first)}, {_stem(second)})")


# The older tokenizer: every character outside ASCII words, Han and kana separates.
_SEPARATORS = f"[^a-z0-9_{HAN}{KANA}]+"


def legacy_pieces(text: Column) -> Column:
    """Pieces between separators; feed each to ``legacy_tokens``."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS, " "), " ")


def legacy_tokens(piece: str) -> Column:
    """Tokens of one piece: a stem, or the character pairs of a piece with Han or kana."""
    none = F.array().cast("array<string>")
    latin = F.expr(f"{piece} RLIKE '^[a-z0-9]+$'")
    pair_list = F.filter(pairs(F.col(piece)), lambda p: ~p.isin(*STOP_ZH))
    return (
        F.when(F.length(piece) < SHORTEST_TERM, none)
        .when(latin, F.when(is_noise(piece, CLOUD_EN), none).otherwise(F.array(stem(piece))))
        .when(F.col(piece).rlike(f"[{HAN}{KANA}]"), pair_list)
        .otherwise(none)
    )
