"""Labels derived from file names, tags and role names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Label of each file extension.
FILE_LABELS = {
    "csv": "CSV", "xlsx": "Excel", "xls": "Excel", "numbers": "Numbers",
    "ods": "Spreadsheet", "tsv": "TSV", "txt": "Text",
}

# Words that decide the kind of dataset, first match wins.
DATASET_KINDS = [
    (("markdown", "clearance"), "Markdown Plan"),
    (("supplier", "sourcing"), "Supplier Report"),
    (("stock", "inventory"), "Stock Report"),
    (("range", "assortment"), "Range Plan"),
]

# Onboarding label to role code.
ONBOARDING_ROLES = {
    "Assistant Merchandiser": "MA", "Merchandising Assistant": "MA",
    "Merchandiser": "Merchandiser", "Freelancer": "Merchandiser", "Consultant": "Director",
}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def extension(filename: Column) -> Column:
    """Lower-cased text after the last dot, empty when there is no dot."""
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.element_at(F.split(filename, r"\."), -1))).otherwise("")


def file_type(filename: Column) -> Column:
    ext = extension(F.coalesce(filename, F.lit("")))
    return F.coalesce(F.try_element_at(literal_map(FILE_LABELS), ext),
                      F.when(ext == "", F.lit("File")).otherwise(F.upper(ext)))


def dataset_type(filename: Column, tags: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", F.coalesce(filename, F.lit("")), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))
    rule = F.when(F.contains(hay, F.lit("buy")) & F.contains(hay, F.lit("plan")), "Buy Plan")
    for words, label in DATASET_KINDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(hay, F.lit(word))
        rule = rule.when(hit, label)
    return rule.otherwise("Trading Report")


def onboarding_role(label: Column, current: Column | None = None) -> Column:
    fallback = F.lit("AM") if current is None else F.coalesce(current, F.lit("AM"))
    return F.coalesce(F.try_element_at(literal_map(ONBOARDING_ROLES), F.trim(label)), fallback)
