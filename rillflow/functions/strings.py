"""Text, digests, URLs, JSON and numbers, as columns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rillflow.functions import column
from rillflow.records import num

# --- digests


@column
def md5(c):
    return F.md5(c.cast("binary"))


@column
def md5_simple(c, bits=16):
    return F.substring(F.md5(c.cast("binary")), 1, bits)


@column
def sha256(c):
    return F.sha2(c.cast("binary"), 256)


@column
def sha256_id(c, length=8):
    """The first bytes of the digest as an unsigned number."""
    h = F.substring(F.sha2(c.cast("binary"), 256), 1, 2 * length)
    return F.conv(h, 16, 10).cast("decimal(20,0)")


@column
def pad20(c, length=20):
    text = c.cast("string")
    return F.when(F.length(text) >= length, text).otherwise(F.lpad(text, length, "0"))


@column
def base64(c):
    return F.base64(c.cast("binary"))


@column
def is_base64(c):
    return F.try_to_binary(c, F.lit("base64")).isNotNull()


# --- URLs and paths


@column
def host_from_url(c, with_proto=True):
    proto = F.when(F.startswith(c, F.lit("https://")), "https://").otherwise("http://")
    rest = F.regexp_replace(c, "^https?://", "")
    host = F.when(F.instr(rest, "/") > 1, F.substring_index(rest, "/", 1)).otherwise(rest)
    return F.concat(proto, host) if with_proto else host


@column
def path_from_url(c, result="all"):
    rest = F.regexp_replace(c, "^(https?|.*?)://", "")
    path = F.when(F.contains(rest, F.lit("/")), F.substring(rest, F.instr(rest, "/"), F.length(rest))).otherwise("/")
    if result == "all":
        return path
    inner = F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", "")
    return F.substring_index(inner, "/", 1 if result == "first" else -1)


@column
def basename(c):
    return F.substring_index(c, "/", -1)


@column
def dirname(c):
    return F.regexp_replace(c, "/?[^/]*$", "")


@column
def filetype(c, type_mapping=None):
    """The suffix of a path, through a mapping: ``all`` wins, then the suffix's own entry, then ``other``."""
    suffix = F.regexp_extract(F.substring_index(c, "/", -1), r"(\.[^.]+)$", 1)
    m = type_mapping or {}
    if "all" in m:
        return F.lit(m["all"])
    out = F.lit(m["other"]) if "other" in m else suffix
    for k, v in m.items():
        if k != "other":
            out = F.when(suffix == k, v).otherwise(out)
    return out


@column
def clean_filename(c):
    return F.regexp_replace(F.regexp_replace(c, "^https?://", ""), "[^A-Za-z0-9._-]+", "_")


@column
def get_extension_from_url(c):
    return F.lower(F.regexp_extract(c, r"(?i)\.(jpg|jpeg|png|gif|bmp|webp|svg)(?:[?#].*)?$", 1))


# --- numbers and JSON


@column
def extract_num(c):
    return num(c)


@column
def parse_int(c, default=None):
    """Digits at the start after commas are gone; else the default."""
    v = F.replace(c, F.lit(","), F.lit(""))
    return F.when(v.rlike(r"^\d+"), v.try_cast("long")).otherwise(F.lit(default).cast("long"))


@column
def parse_float(c, default=None):
    return F.when(c.rlike(r"^[\d.]+"), c.try_cast("double")).otherwise(F.lit(default).cast("double"))


@column
def to_json(c):
    return F.to_json(c)


@column
def from_json(c, schema=None):
    return F.from_json(c, schema) if schema else F.try_parse_json(c)


@column
def dtype_bool(c):
    """YES, true and any text but a false one; numbers other than zero."""
    t = F.upper(c.cast("string"))
    return F.when(t.isNull() | t.isin("", "0", "FALSE", "NO", "N"), False).otherwise(True)


@column
def f_lower(c):
    return F.lower(c)


@column
def f_upper(c):
    return F.upper(c)


@column
def f_strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


@column
def f_int(c):
    return c.try_cast("long")


@column
def f_float(c):
    return c.try_cast("double")


@column
def decode(c, encoding="UTF-8"):
    return F.decode(c, encoding)


@column
def tag_split(c):
    """Tags after a colon, split at semicolons and full stops."""
    tail = F.regexp_replace(c, "^[^:：]*[:：]", "")
    return F.filter(F.transform(F.split(tail, "[;；。]"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


@column
def template(c, temp, variable="data"):
    """A prompt with {variable} filled in."""
    return F.replace(F.lit(temp), F.lit("{" + variable + "}"), c.cast("string"))


@column
def zh_simple(c, pairs=""):
    """Characters replaced one by one; pairs: (from, to) texts of equal length, a parameter."""
    a, b = pairs if pairs else ("", "")
    return F.translate(c, a, b) if a else c


# --- cleaning

#: Ligatures and what they stand for: fixed values.
LIGATURES = {"æ": "ae", "Æ": "AE", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ʪ": "ls", "œ": "oe", "Œ": "OE", "ȹ": "qp", "ﬆ": "st", "ʦ": "ts"}
#: Bullets that a line of a list may start with: fixed values.
BULLETS = "•‣⁃⁌⁍∙○●◘◦☙❥❧⦾⦿*·–"
#: Typographic quotes and what they stand for: fixed values.
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "′": "'", "″": '"'}


@column
def clean_non_ascii_chars(c):
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


@column
def clean_bullets(c):
    return F.regexp_replace(c, rf"^\s*[{re.escape(BULLETS)}]\s*", "")


@column
def clean_ordered_bullets(c):
    return F.regexp_replace(c, r"^\s*([0-9A-Za-z]{1,2}\.){1,3}[0-9A-Za-z]{0,2}\s+", "")


@column
def clean_ligatures(c):
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@column
def replace_unicode_quotes(c):
    return F.translate(c, "".join(QUOTES), "".join(QUOTES.values()))


@column
def remove_punctuation(c):
    return F.regexp_replace(c, r"\p{P}", "")


@column
def remove_sentence_punctuation(c, exclude_punctuation=None):
    kept = "".join(exclude_punctuation or [])
    return F.regexp_replace(c, rf"[\p{{P}}&&[^{re.escape(kept)}]]" if kept else r"\p{P}", "")


@column
def clean_extra_whitespace(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \n]", " "), " {2,}", " "))


@column
def clean_dashes(c):
    return F.trim(F.regexp_replace(c, "[-–]", " "))


@column
def clean_trailing_punctuation(c):
    return F.regexp_replace(F.trim(c), "[.,:;]+$", "")


@column
def clean_prefix(c, pattern, ignore_case=False, strip=True):
    out = F.regexp_replace(c, f"{'(?i)' if ignore_case else ''}^(?:{pattern})[:\\-\\s]*" if strip else f"{'(?i)' if ignore_case else ''}^(?:{pattern})", "")
    return F.ltrim(out) if strip else out


@column
def clean_postfix(c, pattern, ignore_case=False, strip=True):
    out = F.regexp_replace(c, f"{'(?i)' if ignore_case else ''}(?:{pattern})$", "")
    return F.rtrim(out) if strip else out


@column
def clean(c, extra_whitespace=False, dashes=False, bullets=False, trailing_punctuation=False, lowercase=False):
    if lowercase:
        c = F.lower(c)
    if trailing_punctuation:
        c = clean_trailing_punctuation(c)
    if dashes:
        c = clean_dashes(c)
    if extra_whitespace:
        c = clean_extra_whitespace(c)
    if bullets:
        c = clean_bullets(c)
    return F.trim(c)


@column
def new_line_grouper(c):
    return F.array_join(F.filter(F.transform(F.split(c, r"\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0), "\n\n")


@column
def group_broken_paragraphs(c):
    """Paragraphs, parted by blank lines, on one line each."""
    paragraphs = F.transform(F.split(c, r"\s*\n\s*\n\s*"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: F.length(p) > 0), "\n\n")


@column
def auto_paragraph_grouper(c, threshold=0.1):
    lines = F.split(c, r"\n")
    blank = F.size(F.filter(lines, lambda x: F.trim(x) == ""))
    return F.when(blank / F.size(lines) < threshold, new_line_grouper(c)).otherwise(group_broken_paragraphs(c))


# --- extraction


def first(c, pattern, group=0):
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


@column
def extract_text_before(c, pattern, index=0, strip=True):
    """The text before the index-th match; empty where there is none."""
    at = F.regexp_extract(c, rf"(?s)^((?:.*?(?:{pattern})){{{index}}}.*?)(?:{pattern})", 1)
    return F.rtrim(at) if strip else at


@column
def extract_text_after(c, pattern, index=0, strip=True):
    at = F.regexp_extract(c, rf"(?s)^(?:.*?(?:{pattern})){{{index + 1}}}(.*)$", 1)
    return F.ltrim(at) if strip else at


EMAIL = r"[a-z0-9.+_-]+@[a-z0-9.-]+\.[a-z0-9]+"
IP = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}"
PHONE = r"(?:\+?(\d{1,3}))?[-. (]*(\d{3})?[-. )]*(\d{3})[-. ]*(\d{4})"
IMAGE = r"https?://[^\s\"'<>]+?\.(?:jpg|jpeg|png|gif|bmp|webp)"


@column
def extract_email_address(c):
    return F.regexp_extract_all(F.lower(c), F.lit(EMAIL), F.lit(0))


@column
def extract_ip_address(c):
    return F.regexp_extract_all(c, F.lit(rf"\b{IP}\b"), F.lit(0))


@column
def extract_us_phone_number(c):
    return F.trim(F.regexp_extract(c, PHONE, 0))


@column
def extract_mapi_id(c):
    return F.transform(F.regexp_extract_all(c, F.lit(r"\S+ MAPI id \S+;"), F.lit(0)), lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(x, ".* MAPI id ", ""), ";$", "")))


@column
def extract_image_urls_from_html(c):
    return F.regexp_extract_all(c, F.lit(IMAGE), F.lit(0))


@column
def extract_ordered_bullets(c):
    """(a, b, c) of a bullet such as 1.2.3; null for what is missing."""
    head = F.split(F.regexp_extract(c, r"^\s*(\S+)\s", 1), r"\.")
    ok = c.rlike(r"^\s*[0-9A-Za-z]{1,2}\.([0-9A-Za-z]{0,2}\.?){0,2}\s")
    return F.struct(*[F.when(ok, F.nullif(F.get(head, F.lit(k)), F.lit(""))).alias(n) for k, n in enumerate("abc")])


# --- kinds of text


@column
def is_bulleted_text(c):
    return c.rlike(rf"^\s*[{re.escape(BULLETS)}]")


@column
def contains_us_phone_number(c):
    return c.rlike(PHONE)


@column
def is_us_city_state_zip(c):
    return F.trim(c).rlike(r"^[A-Z][a-zA-Z .]+,\s*[A-Z]{2}\s+\d{5}(-\d{4})?$")


@column
def is_email_address(c):
    return F.trim(F.lower(c)).rlike(f"^{EMAIL}$")


@column
def is_possible_numbered_list(c):
    return c.rlike(r"^\d+\.|^\d+\)")


@column
def under_non_alpha_ratio(c, threshold=0.5):
    total = F.length(F.regexp_replace(c, r"\s", ""))
    alpha = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(total > 0, alpha / total < threshold).otherwise(False)


@column
def exceeds_cap_ratio(c, threshold=0.5):
    words = F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    caps = F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))
    return F.when(F.size(words) > 0, F.size(caps) / F.size(words) > threshold).otherwise(False)


@column
def sentence_count(c, min_length=None):
    parts = F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)
    if min_length:
        parts = F.filter(parts, lambda s: F.size(F.split(F.trim(s), r"\s+")) >= min_length)
    return F.size(parts)


@column
def is_possible_title(c, title_max_word_length=12, non_alpha_threshold=0.5):
    return (F.length(F.trim(c)) > 0) & (F.size(F.split(F.trim(c), " ")) <= title_max_word_length) & ~under_non_alpha_ratio(c, non_alpha_threshold) & ~c.rlike(r",\s*$") & ~c.rlike(r"^\d+$") & (sentence_count(c, 5) <= 1)


@column
def is_possible_narrative_text(c, cap_threshold=0.5, non_alpha_threshold=0.5):
    return (F.length(F.trim(c)) > 0) & ~c.rlike(r"^[\d\s.,]+$") & ~exceeds_cap_ratio(c, cap_threshold) & ~under_non_alpha_ratio(c, non_alpha_threshold) & ((sentence_count(c, 3) >= 1))


@column
def contains_english_word(c, words=("the", "of", "and", "to", "in", "is", "that", "for", "it", "with")):
    return F.exists(F.split(F.lower(c), r"[^a-z]+"), lambda w: w.isin(list(words)))


# --- arrays


@column
def get_valid(c, key=None):
    """The numbers among the values of an array, or of a field of its structs."""
    values = F.transform(c, lambda x: num(x[key] if key else x))
    return F.filter(values, lambda x: x.isNotNull())


@column
def centroid_of(c, table=None):
    """The value of a name in a table of names, or of the first of its names that the text begins with."""
    out = F.lit(None)
    for k, v in (table or {}).items():
        out = F.when(F.startswith(c, F.lit(k)), F.array(*[F.lit(float(x)) for x in v])).otherwise(out)
    return out


@column
def ngrams(c, n=3):
    words = F.split(F.trim(c), r"\s+")
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(words, k, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


@column
def shared_ngram_share(a, b, n=3):
    """Share of the n-grams of a that b has."""
    x, y = F.array_distinct(ngrams(a, n)), F.array_distinct(ngrams(b, n))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(0.0)


@column
def sent2text_sentiment(c, threshold1=0.6, threshold2=0.7):
    """The verdict of a document from those of its sentences (positive, negative, neutral)."""
    n = F.size(c)
    pos, neg = F.size(F.filter(c, lambda s: s == "positive")), F.size(F.filter(c, lambda s: s == "negative"))
    voted = pos + neg
    return F.when(n == 0, "neutral").when((voted / n >= 1 - threshold2) & (pos / voted >= threshold1), "positive").when((voted / n >= 1 - threshold2) & (neg / voted >= threshold1), "negative").otherwise("neutral")


#: Host names, times of mails and marks of bullets in scanned texts: fixed values.
HOST = r"[a-zA-Z0-9-]*\.[a-zA-Z]*\.[a-zA-Z]*"
MAIL_TIME = r"[A-Za-z]{3},\s\d{1,2}\s[A-Za-z]{3}\s\d{4}\s\d{2}:\d{2}:\d{2}\s[+-]\d{4}"
E_BULLET = r"(?m)^e(?=\s)"


@column
def extract_ip_address_name(c):
    return F.regexp_extract_all(c, F.lit(HOST), F.lit(0))


@column
def extract_datetimetz(c):
    """The first time with its offset that a text has."""
    found = F.regexp_replace(F.substring(F.regexp_extract(c, MAIL_TIME, 0), 6, 100), r"\s+", " ")
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("d MMM yyyy HH:mm:ss Z"))


@column
def group_bullet_paragraph(c):
    """The bullets of a paragraph, each on one line."""
    text = F.trim(F.regexp_replace(c, E_BULLET, "·"))
    marked = F.regexp_replace(text, f"([{BULLETS.replace('*', chr(92) + '*').replace('-', chr(92) + '-')}])", "\u0001$1")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.regexp_replace(x, r"\s*\n\s*", " ")), lambda x: x != "")


@column
def blank_line_grouper(c):
    """Paragraphs between blank lines, each on one line."""
    return group_broken_paragraphs(c)


def load_stopwords(spark, path: str) -> frozenset:
    """The words of a file, one on each line; a list for functions, so of a size that a program holds."""
    return frozenset(r[0].strip() for r in spark.read.text(path).collect() if r[0].strip())


@column
def format(c, **fields):  # noqa: A001
    """A template's {names} filled with columns or constants."""
    for name, value in fields.items():
        c = F.replace(c, F.lit("{" + name + "}"), value if hasattr(value, "_expr") or hasattr(value, "_jc") else F.lit(str(value)))
    return c
