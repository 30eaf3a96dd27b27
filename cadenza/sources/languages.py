"""English names of languages by ISO 639 code, from the platform's own table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.exprs import LANGUAGES


_names: dict[str, str] = {}


def english_names(spark: SparkSession) -> dict[str, str]:
    """Two- and three-letter code -> name: every language that the platform's
    locales list or name, with the fixed names of LANGUAGES where there is one.
    Asked for once."""
    if not _names:
        locale = spark._jvm.java.util.Locale
        for tag in {*locale.getISOLanguages(), *(x.getLanguage() for x in locale.getAvailableLocales())}:
            of = locale.forLanguageTag(tag)
            name = of.getDisplayLanguage(locale.ENGLISH)
            if tag and name != tag:
                _names[tag] = name
                if len(tag) == 2:
                    _names.setdefault(of.getISO3Language(), name)
        _names.update(LANGUAGES)
    return dict(_names)


def with_language_names(rows: DataFrame, tag: str, out: str = "name", names: dict[str, str] | None = None) -> DataFrame:
    """rows with the English name of each tag, by its primary subtag; the tag
    itself if that is not known. The table has some hundred rows whatever the
    data, and is broadcast."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list((names or english_names(spark)).items()), "_code string, _language string")
    joined = rows.join(F.broadcast(table), F.lower(F.substring_index(tag, "-", 1)) == F.col("_code"), "left")
    return joined.withColumn(out, F.coalesce("_language", F.col(tag))).drop("_code", "_language")
