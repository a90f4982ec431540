"""Language identification by function-word profiles, over a whole table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelore.session import pin

# Default profiles: common function words per language. Pass others to change or add languages.
PROFILES = {
    "de": "der die das und ist nicht ein eine zu den mit von auf für sich dem des im wir war sind auch es an als".split(),
    "en": "the and of to in is it was for on with that are this at from were we have had not be as you very".split(),
    "es": "el la los las de que y en un una es por con para del se no lo su fue al más como muy pero".split(),
    "fr": "le la les des et est un une du en que qui dans pour avec sur pas au ce il nous elle très sont de".split(),
}
MIN_CHARS = 15
LETTERS = "a-zß-ÿ"


def detect(df: DataFrame, text: str = "text", profiles: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds lang_detected and lang_confidence; short texts count as English, texts without any profile word
    as unknown. Confidence is the best profile's share of all profile hits."""
    table = profiles or PROFILES
    langs = sorted(table)
    # one regex pass per language; a word is a run of letters, so matches may not touch a letter
    word = lambda ws: rf"(?<![{LETTERS}])(?:" + "|".join(sorted(ws, key=len, reverse=True)) + rf")(?![{LETTERS}])"
    hits = F.array(*[F.regexp_count("_low", F.lit(word(table[lang]))) for lang in langs])
    best = F.array_max("_hits")
    total = F.aggregate("_hits", F.lit(0), lambda a, x: a + x)
    short = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < MIN_CHARS
    at = F.array_position("_hits", best).cast("int") - 1
    names = F.array(*[F.lit(x) for x in langs])
    return (pin(pin(df, _low=F.lower(F.col(text))), _hits=hits)
            .withColumn("lang_detected", F.when(short, "en").when(best == 0, "unknown").otherwise(F.get(names, at)))
            .withColumn("lang_confidence", F.when(short, 1.0).when(best == 0, 0.0).otherwise(best / total))
            .drop("_low", "_hits"))


def is_english(min_confidence: float = 0.7) -> Column:
    return (F.col("lang_detected") == "en") & (F.col("lang_confidence") >= min_confidence)


def keep_english(df: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    return df.filter(is_english(min_confidence))


def rejected(df: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    return df.filter(~is_english(min_confidence))
