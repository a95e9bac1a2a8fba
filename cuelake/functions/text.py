"""Text rules for captions: scripts, wrapping, reading rate, citations, leaks, sensitive terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script class per language; every other language is latin.
SCRIPTS = {
    "rtl": ["fa", "ar", "ur", "he"],
    "cyrillic": ["ru", "uk", "bg", "sr"],
    "cjk": ["zh", "ja", "ko"],
}
LATIN_LINE = 42
CJK_LINE = 16
MAX_WPM = 180

# Tags that name the same language.
ALIASES = {"zh-cn": "zh", "zh-tw": "zh", "iw": "he", "in": "id"}

# Language names and three-letter codes as they come from detectors.
LANGUAGE_NAMES = {
    "persian": "fa", "farsi": "fa", "fas": "fa", "per": "fa",
    "arabic": "ar", "ara": "ar",
    "english": "en", "eng": "en",
    "spanish": "es", "spa": "es",
    "french": "fr", "fra": "fr", "fre": "fr",
    "german": "de", "deu": "de", "ger": "de",
    "russian": "ru", "rus": "ru",
    "urdu": "ur", "urd": "ur",
    "chinese": "zh", "zho": "zh", "chi": "zh",
    "hebrew": "he", "heb": "he",
}

ARABIC = r"[؀-ۿ]"
QUOTED = r"«([^»]*)»"


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def script_class(language: Column) -> Column:
    out = F.lit("latin")
    for name, codes in SCRIPTS.items():
        out = F.when(language.isin(codes), F.lit(name)).otherwise(out)
    return out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    t = squeeze(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("long")


def char_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s+", "")).cast("long")


def units_per_minute(text: Column, script: Column, span_ms: Column) -> Column:
    """Words per minute, or characters per minute for CJK; whole units, rounded down, for display."""
    return F.when(span_ms > 0, F.floor(reading_units(text, script) * 60000 / span_ms)).cast("long")


def reading_units(text: Column, script: Column) -> Column:
    """Words, or characters for CJK."""
    return F.when(script == "cjk", char_count(text)).otherwise(word_count(text))


def reads_faster(text: Column, script: Column, span_ms: Column, bar: Column) -> Column:
    """Whether a minute at this rate holds more than ``bar`` units, in whole numbers; false without a span."""
    return (span_ms > 0) & F.coalesce(reading_units(text, script) * 60000 > bar * span_ms, F.lit(False))


def wrap_lines(text: Column, script: Column) -> Column:
    """At most two lines: the first as full as the limit allows, all the rest on the second."""
    t = squeeze(text)
    greedy = F.regexp_extract(t, rf"^(.{{1,{LATIN_LINE}}})(?: |$)", 1)
    first_word = F.regexp_extract(t, r"^(\S+)", 1)
    head = F.when(greedy != "", greedy).otherwise(first_word)
    rest = F.trim(F.substring(t, F.length(head) + 1, F.length(t)))
    latin = F.when(rest == "", F.array(head)).otherwise(F.array(head, rest))
    cjk_head = F.substring(t, 1, CJK_LINE)
    cjk_rest = F.substring(t, F.lit(CJK_LINE + 1), F.length(t))
    cjk = F.when(cjk_rest == "", F.array(cjk_head)).otherwise(F.array(cjk_head, cjk_rest))
    return F.when(script == "cjk", cjk).otherwise(latin)


def strip_citations(text: Column) -> Column:
    """Drop ``(Quran 2:255)`` style citations from the spoken copy."""
    return squeeze(F.regexp_replace(text, r"\s*\(Quran[^)]*\)", ""))


def canonical_language(code: Column) -> Column:
    c = F.lower(F.trim(code))
    return F.coalesce(F.element_at(_literal_map(ALIASES), c), c)


def normalize_language(name: Column) -> Column:
    """Language name or code to a two-letter code; short unknown codes stay, the rest is null."""
    c = F.lower(F.trim(name))
    known = F.element_at(_literal_map(LANGUAGE_NAMES), c)
    return F.coalesce(known, F.when(c.rlike(r"^[a-z]{2,3}$"), c))


def norm_codes(codes: Column) -> Column:
    """Strip, lower, drop empty, keep the first of each, keep order."""
    cleaned = F.transform(codes, lambda x: F.lower(F.trim(x)))
    kept = F.array_distinct(F.filter(cleaned, lambda x: x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def leaks_script(text: Column, language: Column) -> Column:
    """Arabic letters inside quotation blocks, or outside them unless the language is Urdu."""
    quoted = F.exists(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda x: x.rlike(ARABIC))
    bare = F.regexp_replace(text, QUOTED, "").rlike(ARABIC) & (language != "ur")
    return quoted | bare


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace every ``{{KEY}}``."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template


def canonical_hash(*fields: Column) -> Column:
    """``sha256:`` of the fields' canonical JSON text."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*fields)), 256))


def valid_lang_map(text: Column) -> Column:
    """Every part of ``a=x,b=y`` has a key, an equals sign and a value."""
    parts = F.split(text, ",")
    return F.forall(parts, lambda p: F.trim(p).rlike(r"^[^=]+=.+$"))


def lang_map(text: Column) -> Column:
    """``a=x,b=y`` as a map; null when any part is malformed."""
    return F.when(valid_lang_map(text), F.str_to_map(text, F.lit(","), F.lit("=")))
