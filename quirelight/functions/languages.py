"""The languages that a job may name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions.text import strip

# Code and English name.
LANGUAGES = (
    ("zh", "Chinese"), ("en", "English"), ("fr", "French"), ("pt", "Portuguese"), ("es", "Spanish"), ("ja", "Japanese"),
    ("tr", "Turkish"), ("ru", "Russian"), ("ar", "Arabic"), ("ko", "Korean"), ("th", "Thai"), ("it", "Italian"),
    ("de", "German"), ("vi", "Vietnamese"), ("ms", "Malay"), ("id", "Indonesian"), ("tl", "Filipino"), ("hi", "Hindi"),
    ("zh-Hant", "Traditional Chinese"), ("pl", "Polish"), ("cs", "Czech"), ("nl", "Dutch"), ("km", "Khmer"),
    ("my", "Burmese"), ("fa", "Persian"), ("gu", "Gujarati"), ("ur", "Urdu"), ("te", "Telugu"), ("mr", "Marathi"),
    ("he", "Hebrew"), ("bn", "Bengali"), ("ta", "Tamil"), ("uk", "Ukrainian"), ("bo", "Tibetan"), ("kk", "Kazakh"),
    ("mn", "Mongolian"), ("ug", "Uyghur"), ("yue", "Cantonese"),
)


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "code string, name_en string")


def normalized(df: DataFrame, column: str) -> DataFrame:
    """Adds code and name_en: the language that column names, white space and case aside; null
    where it names none (there are no aliases)."""
    known = languages(df.sparkSession)
    return df.join(F.broadcast(known), F.lower(strip(F.col(column))) == F.lower("code"), "left")


def required(code: Column, given: Column) -> Column:
    """code, or an error that says what was given."""
    return F.when(code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("not a known language: "), F.coalesce(given, F.lit("null")))))


def code_of(value: str) -> str:
    """The code that a code or an English name stands for."""
    own = value.strip(" ")
    for code, name in LANGUAGES:
        if own.lower() == code.lower() or own == name:
            return code
    raise ValueError(f"not a known language: {value!r}")


def name_of(code: str) -> str:
    return dict(LANGUAGES)[code_of(code)]


def display_pairs() -> list[tuple[str, str]]:
    """(name, code) of each language, in the registry's order, as a list to choose from shows them."""
    return [(name, code) for code, name in LANGUAGES]
