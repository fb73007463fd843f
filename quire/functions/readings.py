"""What one reading of a line makes of another, and what lines say of paragraphs and scenes. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

# Ligatures as one glyph, and the letters they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Cyrillic letters and the Latin ones that they are written with.
CYRILLIC, LATIN = "абвгдеёзийклмнопрстуфхцыэіАБВГДЕЁЗИЙКЛМНОПРСТУФХЦЫЭІ", "abvgdeezijklmnoprstufhcyeiABVGDEEZIJKLMNOPRSTUFHCYEI"
SPELLED = {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "ju", "я": "ja", "ъ": "", "ь": "", "Ж": "Zh", "Ч": "Ch", "Ш": "Sh", "Щ": "Sch", "Ю": "Ju", "Я": "Ja", "Ъ": "", "Ь": ""}
# Letters that are one stroke; marks that prose has not; vowels that are doubled with both accented or none; readings of a printed ij.
STROKES = ("l1|", "iii")
UNPRINTED = "~^|"
ACCENTS = {"a": "áà", "o": "óò", "u": "ú"}
IJ_READ = ("u", "ui", "y", "ii", "i")
# Signs of a scene break, and the sign that is one alone.
ORNAMENTS, ASTERISM = "*·•⁂~#◊♦", "⁂"
# What a sentence's line ends on.
SENTENCE_ENDS = ".!?…:;’”'\")]"


def replaced(x, pairs: dict[str, str]) -> Column:
    out = c(x)
    for old, new in pairs.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def unligatured(x) -> Column:
    return replaced(x, LIGATURES)


def latin(x) -> Column:
    return replaced(F.translate(c(x), CYRILLIC, LATIN), SPELLED)


def strokes(x) -> Column:
    """Lower case, with every letter of one stroke alike."""
    return F.translate(F.lower(c(x)), *STROKES)


def tidied(x) -> Column:
    """Ligatures spelled out, and no blank before a mark that ends a word or clause; dots that are spaced stay so."""
    return F.regexp_replace(unligatured(x), r"(?<![.\s])\s+([,;:.!?])(?=\s|$)(?!\s\.)", "$1")


def half_accented(x) -> Column:
    """Is one letter of a doubled vowel accented and the other not?"""
    lower = F.lower(c(x))
    return F.greatest(*[F.contains(lower, F.lit(pair)) for v, marked in ACCENTS.items() for a in marked for pair in (v + a, a + v)])


def unprinted(x) -> Column:
    return F.translate(c(x), UNPRINTED, "") != c(x)


def brings(test, ours, version) -> Column:
    """Has the version what ``test`` tells and ours not?"""
    return test(version) & ~test(ours)


def b_for_h(ours, version) -> Column:
    """Is a single h read as a b the whole difference?"""
    pairs = F.filter(F.zip_with(F.split(c(ours), ""), F.split(c(version), ""), lambda a, b: F.when(a != b, F.concat(a, b))), lambda p: p.isNotNull())
    return (F.length(c(ours)) == F.length(c(version))) & F.coalesce(pairs == F.array(F.lit("hb")), F.lit(False))


def ij_misread(ours, version) -> Column:
    """Is one printed ij read as something else the whole difference?"""
    ours, version = c(ours), c(version)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(ours), F.lit(1))), lambda i: F.substring(F.substr(ours, i), 1, 2) == "ij")
    made = lambda i, read: F.concat(F.substr(ours, F.lit(1), i - 1), F.lit(read), F.substr(ours, i + 2)) == version
    return F.exists(places, lambda i: F.greatest(*[made(i, read) for read in IJ_READ]))


def scene_break(x) -> Column:
    """A line of ornaments: three or more, or the one that is enough."""
    marks = F.regexp_replace(c(x), r"\s+", "")
    return (F.translate(marks, ORNAMENTS, "") == "") & ((F.length(marks) >= 3) | (marks == ASTERISM))


def starts_paragraph(above, x) -> Column:
    """Can a line open a paragraph? Nothing is above it, or a sentence ends there, or it does not open in lower case."""
    before = F.rtrim(F.coalesce(c(above), F.lit("")))
    return (F.trim(before) == "") | F.instr(F.lit(SENTENCE_ENDS), F.substring(before, -1, 1)).cast("boolean") | ~F.trim(c(x)).rlike(r"^\p{Ll}")


def stop_for_comma(ours, version, following) -> Column:
    """Does the version only end a line on a stop, for its comma or after a letter, where the next line goes on in lower case?"""
    ours, version = c(ours), c(version)
    stopped = F.concat(F.regexp_replace(ours, ",$", ""), F.lit("."))
    can = ours.rlike(r"[,\p{L}\p{N}’'\"”]$")
    return can & (version == stopped) & F.coalesce(c(following), F.lit("")).rlike(r"^\s*[\"'‘’“”(—–-]*\s*\p{Ll}")


def page_label(number, offset) -> Column:
    """A page by both its numbers: the file's and, where the book's offset gives one above zero, the printed one."""
    printed = c(number) - c(offset)
    return F.format_string("PDF page %d (the page prints %s)", c(number), F.when(printed >= 1, printed.cast("string")).otherwise("no number"))


def duration(seconds) -> Column:
    """"2 h 05 min", "12 min" or "under a minute"; half a minute goes to the even one."""
    m = F.bround(c(seconds) / 60, 0).cast("int")
    return F.when(m < 1, "under a minute").when(m < 60, F.format_string("%d min", m)).otherwise(F.format_string("%d h %02d min", (m / 60).cast("int"), m % 60))


def f1(precision, recall) -> Column:
    """The harmonic mean; 0 where both are."""
    p, r = c(precision), c(recall)
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
