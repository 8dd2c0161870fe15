"""Cleaning of mentions, names, tags and messages as JVM column expressions.

Patterns keep to what Java and RE2 read alike. A null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never an entity.
STOPWORDS = (
    "prescribe", "prescribed", "patient", "chart", "plan", "management", "diabetes", "daily", "twice", "once", "thrice",
    "bedtime", "morning", "tablet", "capsule", "injection", "mg", "mcg", "ml", "g", "before", "after", "with", "meals",
    "breakfast", "lunch", "dinner", "cardiovascular", "protection", "antiplatelet", "cholesterol", "hypertension", "fever",
    "hypothetical", "drug", "brand", "for", "and", "the", "of", "in", "to", "on", "at", "by", "no", "yes", "not", "is", "are",
    "was", "be", "do", "so", "up", "if", "it", "as", "or", "an", "we", "he", "me", "my",
)
CONNECTORS = ("and", "with", "plus", "or")
# Units, dosage forms, frequencies, release modifiers.
UNITS = "mg|g|mcg|µg|ug|ml|l|iu|units?|meq|mmol"
FORMS = r"tablets?|tabs?\.?|capsules?|caps?\.?|syrups?|suspensions?|susp\.?|injections?|inj\.?|drops?|ointments?|creams?|gels?|solutions?|lotions?|powders?|sachets?|patches?|sprays?|inhalers?|rotacaps?|respules?|suppositor(?:y|ies)"
FREQUENCIES = r"twice|thrice|once|daily|weekly|monthly|hourly|qid|qds|tid|tds|bid|bd|od|qhs|hs|sos|prn|q\d+h?|morning|evening|night|bedtime|breakfast|lunch|dinner|meals?|food|before|after|empty\s+stomach"
MODIFIERS = "xl|xr|sr|er|mr|cr|ds|odt|forte"
# Modifiers that may be dropped, what a suffix of a name stands for, delimiters, junk, registry numbers.
SAFE_MODIFIERS = ("xl", "xr", "sr", "er", "cr", "ds", "odt", "la", "pr")
SUFFIX_AGENTS = {"am": "amlodipine", "h": "hydrochlorothiazide", "m": "metformin", "d": "domperidone"}
SUFFIX_DROPPED = ("plus", "ls", "ln")
DELIMITER = r"\s*(/|\+|&|\band\b|\bwith\b|\bplus\b)\s*"
JUNK = (r"^ns(-|%| )?", r"[%\[\(/:+]", r"stayhappi")
CAS_NUMBER = r"\d{5,}-\d{2}-\d"


# White space of any kind, as a character class.
SPACES = r"[\s\p{Z}]"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def name_key(text: Column) -> Column:
    """A name for comparison: stripped and lower-cased."""
    return F.lower(stripped(text))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def glued_presplit(text: Column) -> Column:
    """``simvastatin20mg`` becomes ``simvastatin 20mg``, ``500mgBD`` becomes ``500mg BD``."""
    dosed = F.regexp_replace(text, rf"(?i)([a-zA-Z])(\d+(\.\d+)?\s?({UNITS}|%))", "$1 $2")
    return F.regexp_replace(dosed, rf"(?i)(\d+(\.\d+)?({UNITS}|%))([a-zA-Z]{{1,3}})", "$1 $4")


def clean_mention(mention: Column) -> Column:
    """Lower case without brackets, doses, forms, frequencies, modifiers, numbers; ``- / + &`` stay. The order matters."""
    text = glued_presplit(F.lower(F.trim(mention)))
    for pattern in (
        r"[()\[\]{}]",
        r"[^\w\s\-/+&]",
        rf"\b\d+(\.\d+)?\s?({UNITS}|%|w/v|v/v)\b",
        rf"\b({FORMS})\b",
        rf"\b({FREQUENCIES})\b",
        rf"\b({MODIFIERS})\b",
        r"\b\d+(\.\d+)?\b",
    ):
        text = F.regexp_replace(text, pattern, " ")
    return squeezed(text)


#: White space, word characters and word boundaries of any script, spelt out: ``\b`` and ``\w`` differ between engines there.
_WORD = r"\p{L}\p{N}_"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


def clean_any_mention(mention: Column) -> Column:
    """``clean_mention`` for entries of any script: letters with accents are letters, every kind of blank is a blank."""
    text = F.lower(stripped(mention))
    for pattern, put in (
        (rf"([a-z])(\d+(\.\d+)?\s?({UNITS}|%))", "$1 $2"),
        (rf"(\d+(\.\d+)?({UNITS}|%))([a-z]{{1,3}})", "$1 $4"),
        (r"[()\[\]{}]", " "),
        (rf"[^{_WORD}\s\p{{Z}}\-/+&]", " "),
        (rf"\b\d+(\.\d+)?\s?({UNITS}|%|w/v|v/v)\b", " "),
        (rf"\b({FORMS})\b", " "),
        (rf"\b({FREQUENCIES})\b", " "),
        (rf"\b({MODIFIERS})\b", " "),
        (r"\b\d+(\.\d+)?\b", " "),
    ):
        spelt = pattern if _WORD in pattern else pattern.replace(r"\b", _EDGE).replace(r"\s", SPACES)
        text = F.regexp_replace(text, spelt, put)
    return stripped(F.regexp_replace(text, f"{SPACES}+", " "))


def normalize_text(text: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(text), r"[^\w\s]", " "))


def valid_entity(entity: Column) -> Column:
    """False for null, short, stopword-only and purely numeric names."""
    low = F.lower(F.trim(entity))
    only_stop = F.forall(F.split(squeezed(low), " "), lambda w: w.isin(*STOPWORDS))
    return F.coalesce((F.length(F.trim(entity)) >= 2) & ~low.isin(*STOPWORDS) & ~only_stop & ~low.rlike(r"^\d+$"), F.lit(False))


def junk_alias(alias: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(alias, F.lit(""))))
    out = (F.length(t) <= 1) | (F.length(t) > 60) | t.rlike(CAS_NUMBER) | t.rlike("^[^a-z]+$")
    for pattern in JUNK:
        out = out | t.rlike(pattern)
    return out


def good_surface(surface: Column, priority: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(surface, F.lit(""))))
    out = (F.length(t) > 2) & (F.length(t) <= 40) & ~t.rlike(CAS_NUMBER) & ~t.rlike("^[^a-z]+$") & ((F.length(t) > 4) | priority)
    for pattern in JUNK:
        out = out & ~t.rlike(pattern)
    return out


def clean_entity_text(text: Column) -> Column:
    """Without tokenizer marks, squeezed, edges stripped of ``,.;:-`` and blanks."""
    plain = squeezed(F.replace(F.replace(text, F.lit("##"), F.lit("")), F.lit("_"), F.lit(" ")))
    return F.btrim(plain, F.lit(" ,.;:-"))


def entity_tag(group: Column) -> Column:
    """A stable label for a model's tag, by what the tag contains; other tags keep their cleaned spelling."""
    tag = F.regexp_replace(F.trim(F.upper(group)), "^[BI]-", "")
    return (
        F.when(F.coalesce(group, F.lit("")) == "", "UNKNOWN")
        .when(tag.rlike("DRUG|CHEM|MED|^TREATMENT$"), "MEDICATION")
        .when(tag.contains("DOSE"), "DOSAGE")
        .when(tag.contains("FREQ"), "FREQUENCY")
        .when(tag.contains("DUR"), "DURATION")
        .when(tag.contains("ROUTE"), "ROUTE")
        .when(tag.rlike("DISEASE|CONDITION|SYMPTOM"), "CONDITION")
        .otherwise(tag)
    )


def title_case(text: Column) -> Column:
    """Every run of ASCII letters capitalised, also behind digits and hyphens."""
    spaced = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[^a-z]+"), 0)
    return F.array_join(F.transform(spaced, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def prettify(key: Column) -> Column:
    """``telma-h`` becomes ``Telma-H``."""
    return F.array_join(F.transform(F.split(key, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "-")


def collapse_token(token: Column) -> Column:
    """Canonical brand key: parts joined by hyphens, strengths dropped, release modifiers dropped at the end."""
    parts = F.filter(F.split(F.lower(F.trim(token)), r"[-_\s]+"), lambda p: (p != "") & ~p.rlike(r"^\d+(\.\d+)?[a-z]{0,3}$"))
    joined = F.array_join(parts, "-")
    return F.regexp_replace(joined, rf"(?<=[^-])(-({'|'.join(SAFE_MODIFIERS)}))+$", "")


def surface_forms(key: Column) -> Column:
    """The key, and its spellings with blank, hyphen and nothing between the parts, distinct and sorted."""
    made = [key, F.replace(key, F.lit("-"), F.lit(" ")), F.replace(key, F.lit("-"), F.lit(""))]
    blanks = [F.replace(key, F.lit(" "), F.lit("-")), F.replace(key, F.lit(" "), F.lit(""))]
    return F.array_sort(F.array_distinct(F.filter(F.array(*made, *blanks), lambda f: f != "")))


def brand_token(name: Column) -> Column:
    """The brand of a product name: no brackets, strengths or dosage forms."""
    text = F.regexp_replace(squeezed(F.lower(name)), r"\([^)]*\)", " ")
    for _ in range(3):
        text = F.regexp_replace(text, rf"\b\d+(\.\d+)?\s*({UNITS}|%)?(/\d+(\.\d+)?\s*({UNITS}|%)?)*(?=\s|$|[^\w])", " ")
    words = F.filter(F.split(squeezed(text), " "), lambda w: ~w.rlike(rf"^({FORMS})$") & ~w.rlike("^[-/]+$") & (w != ""))
    return F.btrim(F.array_join(words, " "), F.lit(" -/"))


def combo_parts(mention: Column) -> Column:
    """Fragments of a combination by its delimiters; the mention itself if there is only one."""
    low = F.lower(F.trim(mention))
    return F.filter(F.transform(F.split(low, DELIMITER), lambda p: F.trim(p)), lambda p: p != "")


def scrub_reasoning(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b(Mild|Severe|VERY\s+SEVERE)\b", "interaction risk")


def retry_delay(error: Column, default: float = 2.0) -> Column:
    """Seconds to wait as an error text asks for, 0.2 at least; the default where it doesn't."""
    named = F.regexp_extract(error, r"retryDelay['\"]?\s*:\s*['\"]([0-9]+(\.[0-9]+)?)s['\"]", 1)
    asked = F.regexp_extract(error, r"(?i)Please retry in\s+([0-9]+(\.[0-9]+)?)s", 1)
    found = F.coalesce(F.nullif(named, F.lit("")), F.nullif(asked, F.lit("")))
    return F.when(found.isNotNull(), F.greatest(found.cast("double"), F.lit(0.2))).otherwise(default)


def quota_exhausted(error: Column) -> Column:
    upper = F.upper(F.coalesce(error, F.lit("")))
    return upper.contains("RESOURCE_EXHAUSTED") | upper.contains("QUOTA EXCEEDED")


def short_model_name(name: Column) -> Column:
    """The last part of a model path, its well-known affixes shortened."""
    last = F.element_at(F.split(name, "/"), -1)
    # Affixes and what they become.
    shorter = (("granite-embedding-", "granite-"), ("embeddinggemma", "gemma"), ("-from-PubMedBERT-fulltext", ""))
    for long, short in shorter:
        last = F.replace(last, F.lit(long), F.lit(short))
    return last


def out_of_memory(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("out of memory|outofmemoryerror|cudaerrormemoryallocation"), F.lit(False))


def strip_fences(text: Column) -> Column:
    """Model output without its Markdown code fence."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```(json)?\s*|\s*```$", ""))


def pair_name(name: Column) -> Column:
    return name_key(F.coalesce(name, F.lit("")))


def replace_all(text: Column, pairs: Column) -> Column:
    """Folds an array of ``(src, dst)`` structs over the text, in order, as plain replacements."""
    return F.reduce(pairs, text, lambda t, p: F.replace(t, p["src"], p["dst"]))
