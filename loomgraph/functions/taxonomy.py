"""The two-level taxonomy of fields and subfields, and lookups over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The seven fields, in order, with the subfields of each.
TAXONOMY = {
    "Natural Sciences": ["mathematics", "physics", "chemistry", "astronomy", "earth sciences", "biological sciences"],
    "Engineering & Technology": [
        "mechanical engineering", "electrical engineering", "computer science & technology", "materials science & engineering",
        "civil engineering", "environmental engineering", "aerospace engineering",
    ],
    "Medicine & Health": ["basic medicine", "clinical medicine", "pharmacy", "traditional Chinese medicine", "public health & preventive medicine", "nursing"],
    "Agriculture": ["agronomy", "horticulture", "forestry", "veterinary medicine", "agricultural resources & environment"],
    "Social Sciences": ["economics", "law", "education", "sociology", "political science", "management", "journalism & communication"],
    "Humanities": ["linguistics", "literature", "philosophy", "history", "arts"],
    "Other": ["other"],
}

#: Words that point to a subfield when a response names none; the first that occurs counts.
KEYWORDS = {
    "math": "mathematics", "mathematical": "mathematics", "physics": "physics", "physical": "physics", "chemistry": "chemistry",
    "chemical": "chemistry", "biology": "biological sciences", "biological": "biological sciences",
    "computer": "computer science & technology", "programming": "computer science & technology", "software": "computer science & technology",
    "medicine": "basic medicine", "medical": "basic medicine", "health": "basic medicine", "economic": "economics", "legal": "law",
    "literature": "literature", "history": "history", "language": "linguistics", "art": "arts", "engineering": "mechanical engineering",
}

SUBFIELDS = [name for names in TAXONOMY.values() for name in names]
DEFAULT_FIELD, DEFAULT_SUBFIELD = "Other", "other"


def directory_name(name: Column) -> Column:
    """A field's or subfield's folder: `` & `` and blanks become ``_``, lower case."""
    return F.lower(F.replace(F.replace(name, F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_")))


def taxonomy(spark: SparkSession) -> DataFrame:
    """``field, field_path, subfield, subfield_path, ord``: 37 rows."""
    rows = [(field, sub) for field, subs in TAXONOMY.items() for sub in subs]
    df = spark.createDataFrame([(i, f, s) for i, (f, s) in enumerate(rows)], "ord int, field string, subfield string")
    return df.select("field", directory_name(F.col("field")).alias("field_path"), "subfield", directory_name(F.col("subfield")).alias("subfield_path"), "ord")


def field_of(subfield: Column) -> Column:
    """The field that a subfield belongs to; ``Other`` for names that none has."""
    known = F.create_map(*[F.lit(x) for field, subs in TAXONOMY.items() for s in subs for x in (s, field)])
    return F.coalesce(F.try_element_at(known, subfield), F.lit(DEFAULT_FIELD))
