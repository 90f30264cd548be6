"""Tokens, normal forms, hashes and token estimates of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equals Python's Unicode \w on the corpora, and means the same in Java and RE2.
WORD = r"([\p{L}\p{N}_]+)"
STOP_WORDS = "the a an is are was were of in to and or for with by that this it".split()

# Abbreviations and look-alike characters of the name normaliser.
ABBREVIATIONS = {
    "gb": "sarin",
    "gd": "soman",
    "ga": "tabun",
    "vx": "vx nerve agent",
    "gs": "novichok",
    "hd": "sulfur mustard",
    "hn": "nitrogen mustard",
    "cw": "chemical weapon",
    "cwa": "chemical warfare agent",
    "rdx": "rdx cyclotrimethylenetrinitramine",
    "hmx": "hmx cyclotetramethylenetetranitramine",
    "petn": "petn pentaerythritol tetranitrate",
    "tatp": "tatp triacetone triperoxide",
    "anfo": "ammonium nitrate fuel oil",
    "meth": "methamphetamine",
    "thc": "delta-9-tetrahydrocannabinol",
}
LOOK_ALIKE = ("013457@$!|", "oleastasii")
SCREEN_LOOK_ALIKE = ("@401!|35$7+", "aaoiiiesstt")
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def tokens(text: Column | str) -> Column:
    """Distinct lower-cased words in order of appearance; null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(1)))


def content_words(text: Column) -> Column:
    return F.array_except(tokens(text), F.array(*map(F.lit, STOP_WORDS)))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def word_count(c: Column) -> Column:
    s = squeeze(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def estimate_by_quarter(c: Column) -> Column:
    """The larger of the words and a quarter of the characters; empty: 0."""
    return F.greatest(word_count(c), F.floor(F.length(c) / 4).cast("int"))


def estimate_calibrated(c: Column) -> Column:
    """max(1, int(max(1.3 words, characters / 3.8))); empty: 0."""
    size = F.greatest(word_count(c) * F.lit(1.3), F.length(c) / F.lit(3.8))
    return F.when(c == "", 0).otherwise(F.greatest(F.lit(1), F.floor(size).cast("int")))


def content_hash(c: Column) -> Column:
    return F.sha2(squeeze(F.lower(c)), 256)


def fold_accents(c: Column) -> Column:
    """Accents of the western European letters, then every other non-ASCII character, go."""
    return F.regexp_replace(F.translate(c, *ACCENTS), r"[^\x00-\x7F]", "")


def normalize_name(c: Column) -> Column:
    """ASCII, lower case, look-alikes replaced, punctuation to spaces, abbreviations spelled out."""
    plain = F.translate(F.lower(fold_accents(c)), *LOOK_ALIKE)
    plain = squeeze(F.regexp_replace(F.regexp_replace(plain, r"[\-_.]{2,}", " "), r"[^a-z0-9_\s]", " "))
    known = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    return F.array_join(F.transform(F.split(plain, " "), lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


def deobfuscate(c: Column) -> Column:
    """Lower case, look-alikes replaced (the screening table), separators removed."""
    return F.regexp_replace(F.translate(F.trim(F.lower(c)), *SCREEN_LOOK_ALIKE), r"[\s_,.*#]+", "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
