"""Column expressions shared by the pipelines (the F-rows of the survey).

All of them are built-in Spark SQL functions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal(c) -> Column:
    """1 -> '1st', 2 -> '2nd', 11 -> '11th', 21 -> '21st', 111 -> '111th'.

    The teens test uses ``% 100`` so 111-113 get 'th' as well. Null stays null.
    """
    n = col(c)
    last2 = F.abs(n) % 100
    last = F.abs(n) % 10
    suffix = (F.when(last2.between(11, 13), F.lit("th"))
              .when(last == 1, F.lit("st"))
              .when(last == 2, F.lit("nd"))
              .when(last == 3, F.lit("rd"))
              .otherwise(F.lit("th")))
    return F.when(n.isNotNull(), F.concat(n.cast("string"), suffix))


def safe_ratio(num, den) -> Column:
    """num / den, null when den is 0 or null (ANSI '/' would raise)."""
    return F.try_divide(col(num), col(den))


def true_shooting(pts, fga, fta) -> Column:
    """PTS / (2 * (FGA + 0.44 * FTA))."""
    return safe_ratio(col(pts), F.lit(2) * (col(fga) + F.lit(0.44) * col(fta)))


def record_text(wins, losses, sep: str = "-") -> Column:
    """'W-L' text of two counts."""
    return F.concat_ws(sep, col(wins).cast("string"), col(losses).cast("string"))


def clock_minutes(c, digits: int = 3) -> Column:
    """'mm:ss' -> minutes as a double (11:38 -> 11.633); bad text -> null."""
    parts = F.split(col(c), ":")
    m = F.try_element_at(parts, F.lit(1)).try_cast("double")
    s = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.round(m + s / F.lit(60.0), digits)


def date_from_weekday_text(c, fmt: str = "MMM d, yyyy") -> Column:
    """'Tue, Dec 22, 2020' -> date. The weekday prefix is stripped first because
    Spark's datetime parser does not accept a text weekday pattern."""
    return F.try_to_date(F.regexp_replace(col(c), r"^\s*[A-Za-z]+,\s*", ""), fmt)


def start_minute(c) -> Column:
    """'7:30p' / '7:30 PM' -> minutes after midnight (19*60+30); bad text -> null."""
    t = F.upper(F.trim(col(c)))
    t = F.regexp_replace(t, r"\s*P$", " PM")
    t = F.regexp_replace(t, r"\s*A$", " AM")
    ts = F.try_to_timestamp(t, F.lit("h:mm a"))
    return F.hour(ts) * 60 + F.minute(ts)


def money_to_double(c) -> Column:
    """'$1,234,500' -> 1234500.0; '' or junk -> null."""
    return F.regexp_replace(col(c), r"[$,\s]", "").try_cast("double")


def replace_first(c, pattern: str, replacement: str) -> Column:
    """Regex replace of the first match only (Spark's regexp_replace replaces all)."""
    return F.regexp_replace(col(c), "^(?s)(.*?)" + pattern, "$1" + replacement)


def number_text(c) -> Column:
    """A number as text without a trailing '.0' (112.0 -> '112')."""
    return F.regexp_replace(col(c).cast("string"), r"\.0$", "")


def percent_text(c, digits: int = 1) -> Column:
    """A share as percent text (0.375 -> '37.5%')."""
    return F.concat(number_text(F.round(col(c) * 100, digits)), F.lit("%"))


def thousands_text(c) -> Column:
    """A whole number as text with thousands marks (1234567 -> '1,234,567')."""
    return F.format_number(col(c), 0)


def money_text(c) -> Column:
    """Whole dollars as text (12500000.0 -> '$12,500,000')."""
    return F.concat(F.lit("$"), thousands_text(c))


def last_word(c) -> Column:
    """Last space-separated word."""
    return F.element_at(F.split(col(c), " "), -1)


def recode(c, mapping: dict) -> Column:
    """Replace listed values, keep the rest (a chain of `x == a -> b`)."""
    if not mapping:
        return col(c)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[col(c)], col(c))


def lookup(c, mapping: dict) -> Column:
    """Literal lookup; values not in the mapping give null (case_when with no default)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return m[col(c)]


# Latin letters that are no base letter with marks, and their ASCII forms.
LETTERS = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
    "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ĸ": "q", "ŋ": "n", "Ŋ": "N", "ŧ": "t", "Ŧ": "T",
    "ƀ": "b", "Ɓ": "B", "Ƃ": "B", "ƃ": "b", "Ƈ": "C", "ƈ": "c", "Ɖ": "D", "Ɗ": "D", "Ƌ": "D", "ƌ": "d", "Ɛ": "E", "Ƒ": "F", "ƒ": "f",
    "Ɠ": "G", "ƕ": "hv", "Ɨ": "I", "Ƙ": "K", "ƙ": "k", "ƚ": "l", "Ɲ": "N", "ƞ": "n", "Ƥ": "P", "ƥ": "p", "ƫ": "t", "Ƭ": "T", "ƭ": "t",
    "Ʈ": "T", "Ʋ": "V", "Ƴ": "Y", "ƴ": "y", "Ƶ": "Z", "ƶ": "z", "Ǥ": "G", "ǥ": "g", "ȡ": "d", "Ȥ": "Z", "ȥ": "z", "ȴ": "l", "ȵ": "n",
    "ȶ": "t", "ȷ": "j", "Ⱥ": "A", "Ȼ": "C", "ȼ": "c", "Ƚ": "L", "Ⱦ": "T", "ȿ": "s", "ɀ": "z", "Ƀ": "B", "Ʉ": "U", "Ɇ": "E", "ɇ": "e",
    "Ɉ": "J", "ɉ": "j", "ɋ": "q", "Ɍ": "R", "ɍ": "r", "Ɏ": "Y", "ɏ": "y",
}
# Latin-1 Supplement to Latin Extended-B, Latin Extended Additional, Latin ligatures
LATIN_BLOCKS = ((0x00C0, 0x024F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06))


def _folds() -> dict[str, str]:
    """Every letter of the Latin blocks that has an ASCII form: its base letters
    without marks (by its Unicode decomposition), or its entry in ``LETTERS``."""
    out = {}
    for c in (chr(i) for first, last in LATIN_BLOCKS for i in range(first, last + 1)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        text = "".join(LETTERS.get(x, x) for x in base).replace("\u02bc", "'").replace("\u00b7", "")
        if text.isascii() and text != "":
            out[c] = text
    return out


FOLDS = _folds()


def ascii_fold(c) -> Column:
    """Fold Latin letters to ASCII ('Dončić' -> 'Doncic', 'Weiß' -> 'Weiss'),
    with marks written as letters of their own taken off as well."""
    one = {k: v for k, v in FOLDS.items() if len(v) == 1}
    out = F.translate(F.regexp_replace(col(c), "[\\u0300-\\u036f]", ""), "".join(one), "".join(one.values()))
    for letter, text in FOLDS.items():
        if len(text) > 1:
            out = F.replace(out, F.lit(letter), F.lit(text))
    return out


def strict_avg(c) -> Column:
    """Mean that is null when any input is null (R's mean without na.rm),
    for callers who want the source's missing-value rule instead of SQL's."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.avg(col(c)))


def strict_sum(c) -> Column:
    """Sum that is null when any input is null (R's sum without na.rm)."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.sum(col(c)))
