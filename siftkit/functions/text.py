"""String functions (H1-H9, H15, H17-H24, H26, H27, B9) as native expressions.

All run in the JVM; ``strip_accents`` is a generated ``translate`` table, since Spark has no
Unicode normaliser.  Regexes are written to mean the same in
Java and RE2.
"""
from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import char_class, col, let

# The eight CJK ideograph blocks spaced out by the tokenizer.
CJK_CLASS = ("[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}"
             "\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}]")
# punctuation = ASCII 33-47, 58-64, 91-96, 123-126 and Unicode P*.
PUNCT_CLASS = "[!-/:-@\\[-`{-~\\p{P}]"
# Whitespace removed by remove_whitespace.
WHITESPACE_CLASS = "[ \\x{3000}\\t\\r\\n\\x{202F}]"
# Phone values that mean "none".
NULL_WORDS = ("無", "NA", "N/A", "na", "n/a", "不知", "沒有")

# Patterns of the forum-post field extractor.
IP_RE = "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"
URL_RE = ("(http://www\\.|https://www\\.|http://|https://)?[a-z0-9]+([\\-\\.]{1}[a-z0-9]+)*"
          "\\.[a-z]{2,5}(:[0-9]{1,5})?(/[^ \\n]*)?")
WEEKDAYS = "(Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
MONTHS = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = "[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4}"
SEP = "[- \u3000\t\\.]"
END_NAME = "(\n|消費|時" + SEP + "*間|地" + SEP + "*址|營業|價位|每人|平均|電" + SEP + "*話|【)"
END_ADDR = "(\n|消費|時" + SEP + "*間|餐廳|店名|名稱|營業|價位|每人|平均|電" + SEP + "*話|交通|【)"
END_PHONE = "(\n|消費|時" + SEP + "*間|餐廳|店名|名稱|營業|價位|每人|平均|地" + SEP + "*址|【)"
LQ = "[(\\[（【]"
RQ = "[\\])）】]"
DIGIT = "[0-9０１２３４５６７８９]"
POST_DATE_RE = "時間(" + WEEKDAYS + " " + MONTHS + " " + DATES + ")"
NAME_RE = (LQ + "*(餐廳名稱|店" + SEP + "*名|飯店名稱)" + RQ + "*(：|:)" + SEP + "*(.*?)" + SEP + "*"
           + END_NAME)
TITLE_RE = "標題(.*?)時間"
ADDR_RE = LQ + "*地" + SEP + "*址" + RQ + "*(：|:)" + SEP + "*(.*?)" + SEP + "*" + END_ADDR
PHONE_LABEL_RE = LQ + "*電" + SEP + "*話" + RQ + "*(：|:)" + SEP + "*(.*?)" + SEP + "*" + END_PHONE
PHONE_DIGITS_RE = ("(" + LQ + "?" + SEP + "*" + DIGIT + "{2,4}" + SEP + "*" + RQ + "?" + SEP + "*"
                   + DIGIT + "{3,4}" + SEP + "*" + DIGIT + "{3,4})")
VISIT_RE = (LQ + "*(消費|用餐|試吃|拜訪|到店|食用|旅遊|體驗)(時間|日期|消費)" + RQ
            + "* *(：|:|→)?" + SEP + "*([0-9０１２３４５６７８９年/月/日／]+)")


def clean_text(text) -> Column:
    """H1: tab/newline/CR and Zs become a space; NUL, U+FFFD, Cc and Cf are removed."""
    spaced = F.regexp_replace(col(text), "[\\t\\n\\r\\p{Zs}]", " ")
    return F.regexp_replace(spaced, "[\\x{0}\\x{FFFD}\\p{Cc}\\p{Cf}]", "")


def space_cjk(text) -> Column:
    """H2: a space on both sides of every CJK ideograph."""
    return F.regexp_replace(col(text), "(" + CJK_CLASS + ")", " $1 ")


def _accent_rule() -> tuple[str, str, dict[str, str]]:
    """From the Unicode data: characters whose decomposition without marks is one other
    character (as two strings for ``translate``), and those that become several."""
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:  # Hangul by arithmetic; surrogates
            continue
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if d != c:
            kept = "".join(x for x in d if unicodedata.category(x) != "Mn")
            (one if len(kept) == 1 else more)[c] = kept
    return "".join(one), "".join(one.values()), more


def _hangul_parts(c: Column) -> Column:
    """A Hangul syllable as its two or three letters, by the Unicode arithmetic."""
    code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    letters = [F.lit(0x1100) + F.floor(code / 588), F.lit(0x1161) + F.floor(code % 588 / 28), F.lit(0x11A7) + code % 28]
    hexes = [F.lpad(F.hex(x.cast("long")), 4, "0") for x in letters]
    third = F.when(code % 28 != 0, hexes[2]).otherwise(F.lit(""))
    return F.decode(F.unhex(F.concat(hexes[0], hexes[1], third)), "UTF-16BE")


def strip_accents(text) -> Column:
    """H3: canonical decomposition, then drop combining marks (Mn); all in the JVM."""
    source, target, more = _accent_rule()
    t = F.translate(col(text), source, target)
    several = char_class(more)
    spread = t
    for c, kept in more.items():
        spread = F.replace(spread, F.lit(c), F.lit(kept))
    t = F.when(t.rlike(several), spread).otherwise(t)
    parts = F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)),
                        lambda c: F.when(c.rlike("[\uac00-\ud7a3]"), _hangul_parts(c)).otherwise(c))
    t = F.when(t.rlike("[\uac00-\ud7a3]"), F.array_join(parts, "")).otherwise(t)
    return F.regexp_replace(t, "\\p{Mn}", "")


def split_punct(text) -> Column:
    """H4: every punctuation character stands alone."""
    return F.regexp_replace(col(text), "(" + PUNCT_CLASS + ")", " $1 ")


def whitespace_tokens(text) -> Column:
    """Split on runs of spaces; no empty tokens."""
    return F.filter(F.split(F.trim(col(text)), " +"), lambda x: x != "")


def basic_tokens(text, lower: bool = False) -> Column:
    """H5: H1 -> H2 -> whitespace split -> (lower + H3) -> H4 -> whitespace split."""
    t = space_cjk(clean_text(text))
    if lower:
        t = strip_accents(F.lower(t))
    return whitespace_tokens(F.regexp_replace(split_punct(t), "[\\s\\x{2028}\\x{2029}]", " "))


def word_tokens(word) -> Column:
    """H5 of a short text; one of ASCII letters and digits alone is its only token, and needs no cutting."""
    w = col(word)
    return F.when(w.rlike("^[A-Za-z0-9]+\\z"), F.array(w)).otherwise(basic_tokens(w))


def remove_symbols(text) -> Column:
    """H8: keep word characters only (Unicode-aware)."""
    return F.regexp_replace(col(text), "(?U)[^\\w]", "")


def remove_whitespace(text) -> Column:
    """H9: drop space, U+3000, tab, CR, LF and U+202F."""
    return F.regexp_replace(col(text), WHITESPACE_CLASS, "")


def strip_ip(text) -> Column:
    """Remove IPv4-like text."""
    return F.regexp_replace(col(text), IP_RE, "")


def strip_url(text) -> Column:
    """Remove URL-like text."""
    return F.regexp_replace(col(text), URL_RE, "")


def label_clean(text) -> Column:
    """Trim spaces and U+3000, tab to space, squeeze spaces."""
    t = F.regexp_replace(col(text), "^( |\u3000)*", "")
    t = F.regexp_replace(t, "( |\u3000)*$", "")
    t = F.regexp_replace(t, "\t", " ")
    return F.regexp_replace(t, " {2,}", " ")


def _group(text: Column, pattern: str, idx: int) -> Column:
    """A group of the first match, '' without one.  ``(?d)``: only a line feed ends a line, not CR."""
    return F.coalesce(F.regexp_extract(text, "(?d)" + pattern, idx), F.lit(""))


def post_date(text) -> Column:
    """``時間`` + weekday month day hh:mm:ss yyyy."""
    return label_clean(_group(col(text), POST_DATE_RE, 1))


def place_name(text) -> Column:
    """Labelled name; else the title between ``標題`` and ``時間`` cleaned of tags."""
    t = col(text)

    def from_title(titled):
        title = F.regexp_replace(_group(titled, TITLE_RE, 1), "(?d)\\[.*\\]", "")
        title = F.regexp_replace(title, "Fw(:|：)*", "")
        title = F.regexp_replace(title, "轉(寄|貼|帖)(:|：)", "")
        return F.when(titled != "", label_clean(title)).otherwise(F.lit(""))

    return let(_group(t, NAME_RE, 0), lambda named: F.when(named != "", label_clean(_group(named, NAME_RE, 3)))
               .otherwise(let(_group(t, TITLE_RE, 0), from_title)))


def address(text) -> Column:
    """Labelled address up to the next field word."""
    return label_clean(_group(col(text), ADDR_RE, 2))


def null_words(value, words=NULL_WORDS) -> Column:
    """Values meaning "none" become ''."""
    v = col(value)
    return F.when(v.isin(*words), F.lit("")).otherwise(v)


def phone(text) -> Column:
    """Labelled phone (not cleaned), else the first digit pattern; then B9."""
    t = col(text)
    digits = label_clean(_group(t, PHONE_DIGITS_RE, 1))
    found = let(_group(t, PHONE_LABEL_RE, 2), lambda labelled: F.when(labelled != "", labelled).otherwise(digits))
    return let(found, lambda v: null_words(v))


def visit_date(text) -> Column:
    """Labelled visit date, else the post date."""
    t = col(text)
    return let(label_clean(_group(t, VISIT_RE, 4)), lambda v: F.when(v != "", v).otherwise(post_date(t)))


def post_fields(text) -> Column:
    """IPs and URLs removed, then ``struct(name, phone, address, visit_date)``."""
    return let(strip_url(strip_ip(col(text))), lambda t: F.struct(  # bound, else each field strips the text anew
        place_name(t).alias("name"), phone(t).alias("phone"), address(t).alias("address"), visit_date(t).alias("visit_date")))


def request_digest(key, salt: str) -> Column:
    """SHA-256 hex of text + salt."""
    return F.sha2(F.concat(col(key).cast("string"), F.lit(salt)), 256)


def to_unicode(data) -> Column:
    """Bytes to text, invalid bytes dropped (Spark marks them U+FFFD, removed here)."""
    return F.regexp_replace(F.make_valid_utf8(col(data)).cast("string"), "\\x{FFFD}", "")
