"""Text expressions.  Every function maps a string column to a column and stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The white space characters of ECMAScript (Java's \s knows only ASCII ones).
SPACE_CLASS = (
    r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same characters themselves, for functions that take a set of characters.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ASCII_SPACE = r"[\t\n\x0B\f\r ]+"
# The white space beyond ASCII that NFKC leaves as it is, and the invisible marks that cleaning takes out.
KEPT_SPACES = ("\u1680", "\u2028", "\u2029")
MARKS = ("\u00ad", "\u200b", "\u200c", "\u200d", "\ufeff")
# A composed text without these, the marks and the spaces above has nothing to clean but its ends.
UNCLEAN = ("\t", "\f", "\x0b", "\r", "  ", " \n", "\n ", "\n\n\n")
# Script ranges of the two languages.
BURMESE = r"[\u1000-\u109f\uaa60-\uaa7f]"
KANA = r"[\u3041-\u3096\u30a1-\u30fa\u30fc]"
CJK = r"[\u4e00-\u9fff]"
LATIN = r"[A-Za-z]"

# Brackets that never belong to a reading.
BRACKETS = "「」『』【】（）()［］[]〈〉<>"
READING_BRACKETS = r"[「」『』【】（）()［］\[\]〈〉<>]"
# Punctuation ignored when meanings are compared.
MEANING_PUNCTUATION = r"[၊။!?！？。、,.]"
# Header pattern of a lesson, and the JLPT level tag with ASCII word borders.
LESSON_PATTERN = (
    rf"(?i)(?:第[{SPACE_CLASS}]*)?(\d{{1,2}})[{SPACE_CLASS}]*課"
    rf"|(?:lesson|unit|chapter)[{SPACE_CLASS}]*(\d{{1,2}})"
)
# A header holds one of these, in any case.
LESSON_MARKS = ("課", "lesson", "unit", "chapter")
LEVEL_PATTERN = r"(?i)(?<![A-Za-z0-9_])(N[45])(?![A-Za-z0-9_])"
LESSON_MAX = 25
LEVELS = ("N4", "N5")

# Katakana letters U+30A1..U+30F6 sit exactly 0x60 above their hiragana.
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(ord(c) - 0x60) for c in _KATAKANA)

# Small kana and their full-size letters, for lookups.
_SMALL_KANA = "ぁぃぅぇぉゃゅょっ"
_FULL_KANA = "あいうえおやゆよつ"

# One romaji syllable per hiragana letter, by rows of the kana table.
_ROMAJI = {
    "あ": "a", "い": "i", "う": "u", "え": "e", "お": "o",
    "か": "ka", "き": "ki", "く": "ku", "け": "ke", "こ": "ko",
    "さ": "sa", "し": "shi", "す": "su", "せ": "se", "そ": "so",
    "た": "ta", "ち": "chi", "つ": "tsu", "て": "te", "と": "to",
    "な": "na", "に": "ni", "ぬ": "nu", "ね": "ne", "の": "no",
    "は": "ha", "ひ": "hi", "ふ": "fu", "へ": "he", "ほ": "ho",
    "ま": "ma", "み": "mi", "む": "mu", "め": "me", "も": "mo",
    "や": "ya", "ゆ": "yu", "よ": "yo",
    "ら": "ra", "り": "ri", "る": "ru", "れ": "re", "ろ": "ro",
    "わ": "wa", "を": "wo", "ん": "n",
    "が": "ga", "ぎ": "gi", "ぐ": "gu", "げ": "ge", "ご": "go",
    "ざ": "za", "じ": "ji", "ず": "zu", "ぜ": "ze", "ぞ": "zo",
    "だ": "da", "ぢ": "ji", "づ": "zu", "で": "de", "ど": "do",
    "ば": "ba", "び": "bi", "ぶ": "bu", "べ": "be", "ぼ": "bo",
    "ぱ": "pa", "ぴ": "pi", "ぷ": "pu", "ぺ": "pe", "ぽ": "po",
    "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o",
    "ゃ": "ya", "ゅ": "yu", "ょ": "yo",
    "ゔ": "vu",
}


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, for bodies that use it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkc(col: Column | str) -> Column:
    """Unicode NFKC.

    Spark has no normalisation function, but its own ICU library is reachable with
    ``java_method``; ASCII text, which NFKC leaves alone, skips the call.  The argument is
    bound first: the optimiser does not share the copies of one inside a reflective call.
    """
    return let(_col(col), lambda c: F.when(c.isNull() | c.rlike(r"^\p{ASCII}*$"), c).otherwise(
        F.java_method(
            F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True)
        )
    ))


def js_trim(col: Column | str) -> Column:
    """Trim every ECMAScript white space character from both ends."""
    return F.btrim(_col(col), F.lit(SPACES))


def drop_space(col: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(col), ASCII_SPACE, ""), rf"[\P{{ASCII}}&&[{SPACE_CLASS}]]+", "")


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def holds(col: Column, signs: tuple[str, ...]) -> Column:
    """Whether a text holds one of the signs, which is seen faster than by a pattern."""
    return reduce(Column.__or__, [F.contains(col, F.lit(sign)) for sign in signs])


def clean_text(col: Column | str) -> Column:
    """Page text with uniform line ends, single spaces, no invisible marks, no blank runs."""
    unclean = lambda c: holds(c, UNCLEAN) | (~is_ascii(c) & holds(c, MARKS + KEPT_SPACES))
    return js_trim(let(nfkc(col), lambda c: F.when(unclean(c), _clean(c)).otherwise(c)))


def _clean(col: Column) -> Column:
    c = F.regexp_replace(col, r"[\u00ad\u200b-\u200d\ufeff]", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    c = F.array_join(F.transform(F.split(c, "\n"), js_trim), "\n")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def blank_separated(col: Column | str) -> Column:
    """Cleaned text with one blank for its white space but line ends, composed again: a mark taken out may leave letters that compose."""
    def composed(c: Column) -> Column:
        blanks = lambda t: F.when(holds(t, KEPT_SPACES), F.regexp_replace(t, rf"[ {''.join(KEPT_SPACES)}]+", " ")).otherwise(t)
        return F.when(is_ascii(c), c).otherwise(let(nfkc(c), blanks))

    return let(_col(col), composed)


def to_hiragana(col: Column | str) -> Column:
    return F.translate(_col(col), _KATAKANA, _HIRAGANA)


def cut_reading(col: Column | str) -> Column:
    """``reading_key`` of a text that is composed and holds no white space."""
    return F.translate(_col(col), _KATAKANA + BRACKETS, _HIRAGANA)


def fold_kana(col: Column | str) -> Column:
    """Hiragana with small letters enlarged, the form used for dictionary lookups."""
    return F.translate(to_hiragana(col), _SMALL_KANA, _FULL_KANA)


def simple_romaji(col: Column | str) -> Column:
    """Letter-by-letter romaji of a kana word; letters outside the table pass through."""
    return let(to_hiragana(col), _romaji)


def _romaji(h: Column) -> Column:
    letters = F.when(F.length(h) > 0, F.transform(F.sequence(F.lit(1), F.length(h)), lambda i: F.substr(h, i, F.lit(1)))
                     ).otherwise(F.array().cast("array<string>"))
    table = F.create_map(*[F.lit(x) for pair in _ROMAJI.items() for x in pair])

    def emit(c: Column, i: Column) -> Column:
        nxt = F.get(letters, i + 1)
        doubled = F.when(nxt.isNull() | (nxt == "っ"), F.lit("")).otherwise(
            F.coalesce(F.substring(table[nxt], 1, 1), F.lit("?")))
        nasal = F.when(nxt.isin("ば", "ぱ", "ま"), F.lit("m")).otherwise(F.lit("n"))
        before_glide = F.coalesce(nxt.isin("ゃ", "ゅ", "ょ"), F.lit(False))
        return (F.when(c == "っ", doubled).when(c == "ん", nasal)
                .otherwise(F.coalesce(table[c], F.when(before_glide, F.lit("")).otherwise(c))))

    return F.when(h.isNotNull(), F.array_join(F.transform(letters, emit), ""))


def contains_script(col: Column | str, script: str) -> Column:
    """True when the text holds at least one character of the class ``script``."""
    return _col(col).rlike(script)


def detect_lesson(col: Column | str) -> Column:
    """Lesson number 1..25 of the first lesson header; null when it is out of range or absent."""
    def found(t: Column) -> Column:
        # that a text holds no mark is seen faster than that it has no header
        marked = let(F.lower(t), lambda low: F.contains(low, F.lit(LESSON_MARKS[0])) | F.contains(low, F.lit(LESSON_MARKS[1]))
                     | F.contains(low, F.lit(LESSON_MARKS[2])) | F.contains(low, F.lit(LESSON_MARKS[3])))
        return F.when(marked, F.regexp_extract(t, LESSON_PATTERN, 0))

    header = let(nfkc(col), found)
    number = F.regexp_extract(header, r"\d{1,2}", 0).try_cast("int")
    return let(number, lambda n: F.when(n.between(1, LESSON_MAX), n))


def detect_level(col: Column | str) -> Column:
    return F.nullif(F.upper(F.regexp_extract(nfkc(col), LEVEL_PATTERN, 1)), F.lit(""))


def clean_optional(col: Column | str, max_chars: int = 500) -> Column:
    """One-line string of at most ``max_chars`` characters, null when nothing is left."""
    c = F.regexp_replace(nfkc(col), r"[\r\n]+", " ")
    c = js_trim(F.regexp_replace(c, r"[ \t\u3000]+", " "))
    return F.nullif(F.substring(c, 1, max_chars), F.lit(""))


def cut_optional(col: Column | str, max_chars: int = 500) -> Column:
    """``clean_optional`` of a text that is composed and holds no white space."""
    return F.nullif(F.substring(_col(col), 1, max_chars), F.lit(""))


def parse_lesson(col: Column | str, fallback: Column | int | None = None) -> Column:
    """Whole lesson number 1..25 from text or number, else the fallback."""
    text = js_trim(_col(col).cast("string"))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("int")
    return F.when((number == F.floor(number)) & number.between(1, LESSON_MAX), number.cast("int")).otherwise(fallback)


def parse_level(col: Column | str, fallback: Column | str = "N5") -> Column:
    level = F.upper(_col(col))
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(level.isin(*LEVELS), level).otherwise(fallback)


def strip_fence(col: Column | str) -> Column:
    """Model answer without a code fence, cut to its outermost JSON value when it has one."""
    c = F.regexp_replace(_col(col), rf"^(?i)```(?:json)?[{SPACE_CLASS}]*", "")
    c = js_trim(F.regexp_replace(c, rf"[{SPACE_CLASS}]*```\z", ""))
    value = F.regexp_extract(c, r"(?s)[{\[].*[}\]]", 0)
    return F.coalesce(F.nullif(value, F.lit("")), c)


def percent(num: Column, den: Column) -> Column:
    """Whole percent, 0 for a zero denominator."""
    return F.when(den > 0, F.round(F.lit(100.0) * num / den)).otherwise(F.lit(0.0)).cast("int")


def clamp_percent(col: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), col))
