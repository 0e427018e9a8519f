"""String functions over transcripts, as Column expressions (nothing runs in Python on the workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

# Whole lines that a recogniser makes up over silence, music or credits.
HALLUCINATIONS = (
    "altyazı m.k.",
    "altyazı m.k",
    "thank you.",
    "thank you",
    "thanks for watching.",
    "thanks for watching",
    "thank you for watching.",
    "thank you for watching",
    "izlediğiniz için teşekkürler.",
    "izlediğiniz için teşekkürler",
    "izlediğiniz için teşekkür ederim.",
    "abone olmayı unutmayın.",
    "you",
    "bye.",
    "bye bye.",
)

# Language codes of a public multilingual translation benchmark.
LANGUAGE_CODES = {
    "en": "eng_Latn",
    "tr": "tur_Latn",
    "de": "deu_Latn",
    "fr": "fra_Latn",
    "es": "spa_Latn",
    "it": "ita_Latn",
    "pt": "por_Latn",
    "ru": "rus_Cyrl",
    "zh": "zho_Hans",
    "ar": "arb_Arab",
    "ja": "jpn_Jpan",
    "ko": "kor_Hang",
    "nl": "nld_Latn",
}

# The two forms of a line, "[label] 0.0s - 1.0s: text". The overlay's has one blank before the start, blanks
# about the hyphen and behind the colon, and decimals in both times.
RESULT_LINE = r"^\[(.*)\]\s+(\d+(?:\.\d+)?)s\s*-\s*(\d+(?:\.\d+)?)s:\s*(.*)$"
OVERLAY_LINE = r"^\[(.*)\] (\d+\.\d+)s\s+-\s+(\d+\.\d+)s:\s+(.*)$"


def normalize_text(text: Column) -> Column:
    """STR-01: lower case, punctuation out, blanks collapsed. Letters and digits of all scripts and _ stay."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def clean_tagged(text: Column) -> Column:
    """STR-02: [tags] out, hyphens to blanks, punctuation but the apostrophe out, blanks collapsed."""
    bare = F.regexp_replace(F.replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), F.lit("-"), F.lit(" ")), r"(?U)[^\p{L}\p{N}_\s']", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def words(normalized: Column) -> Column:
    """STR-03: tokens of a normalised text; none for an empty one."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def characters(normalized: Column) -> Column:
    """STR-04: characters without blanks."""
    bare = F.replace(normalized, F.lit(" "), F.lit(""))
    return F.filter(F.split(bare, ""), lambda c: c != "")


def token_edits(reference: Column, hypothesis: Column) -> Column:
    """STR-05: edit distance of two token arrays. Each distinct token of the pair becomes one character, so the built-in
    distance of strings counts tokens. A pair of over 35,327 distinct tokens is an error (metrics.word_error_details has
    no such bound)."""
    # 0x4E00 + place: one UTF-16 unit, below the surrogates
    code = lambda v, w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(v, w) + 19967), 4, "0")), "UTF-16BE")
    spelled = lambda v, tokens: F.array_join(F.transform(tokens, lambda w: code(v, w)), "")
    few = lambda v: F.when(F.size(v) > 0xD800 - 0x4E00 - 1, F.raise_error(F.lit("too many distinct tokens in a pair")).cast("array<string>")).otherwise(v)

    def edits(p: Column) -> Column:
        return let(F.array_distinct(F.concat(p["r"], p["h"])), lambda x: let(few(x), lambda v: F.levenshtein(spelled(v, p["r"]), spelled(v, p["h"]))))

    return let(F.struct(reference.alias("r"), hypothesis.alias("h")), edits)


def parse_result_line(line: Column) -> Column:
    """STR-06: struct speaker, start, end, text of "[spk] 0.0s - 1.0s: text"; null for other lines. One pair of brackets
    inside the label is taken off."""
    t = F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", "")
    part = lambda k: F.regexp_extract(t, RESULT_LINE, k)
    label = F.trim(part(1))
    inner = F.when(label.startswith("[") & label.endswith("]"), F.trim(F.regexp_replace(label, r"^\[|\]$", ""))).otherwise(label)
    made = F.struct(inner.alias("speaker"), part(2).cast("double").alias("start"), part(3).cast("double").alias("end"), F.trim(part(4)).alias("text"))
    return F.when(t.rlike(RESULT_LINE), made)


def parse_overlay_line(line: Column) -> Column:
    """STR-07: like parse_result_line for the overlay's form, with decimals in both times and the label as it stands."""
    part = lambda k: F.regexp_extract(line, OVERLAY_LINE, k)
    made = F.struct(part(1).alias("speaker"), part(2).cast("double").alias("start"), part(3).cast("double").alias("end"), part(4).alias("text"))
    return F.when(line.rlike(OVERLAY_LINE), made)


def format_seconds(x: Column) -> Column:
    """One decimal, half to even on the binary value (as C's printf); no grouping."""
    return F.replace(F.call_function("format_number", x, F.lit("0.0")), F.lit(","), F.lit(""))


def format_result_line(speaker: Column, start: Column, end: Column, text: Column) -> Column:
    """STR-08."""
    return F.concat(F.lit("["), speaker, F.lit("] "), format_seconds(start), F.lit("s - "), format_seconds(end), F.lit("s: "), text)


def base_language(code: Column) -> Column:
    """STR-09: the part before a hyphen, in lower case."""
    return F.lower(F.split_part(code, F.lit("-"), F.lit(1)))


def same_language(a: Column, b: Column) -> Column:
    """STR-09: equal base codes; an empty or missing one is like none."""
    return F.coalesce((base_language(a) == base_language(b)) & (a != "") & (b != ""), F.lit(False))


def language_code(code: Column) -> Column:
    """STR-10: null for a language that the table doesn't hold."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return F.try_element_at(table, base_language(code))


def speaker_index(label: Column) -> Column:
    """STR-11: the number of SPEAKER_<int>; null for other labels."""
    return F.try_to_number(F.nullif(F.regexp_extract(label, r"SPEAKER_(\d+)(?:[\s\]]|$)", 1), F.lit("")), F.lit("9999999999")).cast("int")


def display_name(label: Column) -> Column:
    """STR-11: SPEAKER_ with two digits at least; other labels as they are."""
    i = speaker_index(label)
    return F.when(i.isNotNull(), F.concat(F.lit("SPEAKER_"), F.when(i < 10, F.lpad(i.cast("string"), 2, "0")).otherwise(i.cast("string")))).otherwise(label)


def palette_slot(label: Column, colours: int = 7) -> Column:
    """STR-11: place in the palette: the index, else the sum of code points, modulo its size; null (a neutral colour) for
    labels that are missing, resolving, calibrating or unknown."""
    low = F.lower(label)
    neutral = F.coalesce(label == "", F.lit(True)) | low.rlike("çözümleniyor|resolving|analyzing|analiz|calibrating|kalibr") | low.isin("unknown", "bilinmeyen")
    total = F.aggregate(F.filter(F.split(label, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc + F.ascii(c))
    return F.when(~neutral, F.coalesce(speaker_index(label), total) % colours)


def show_placeholder(text: Column, shown: str = "Resolving...") -> Column:
    """STR-13."""
    return F.replace(text, F.lit("Çözümleniyor..."), F.lit(shown))
