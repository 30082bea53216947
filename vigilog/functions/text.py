"""Small column expressions on strings, arrays and maps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog.values import BLANKS

GROUP_MARK = "\ue0f1\ue0f2"  # two private-use characters between captured groups


def strip(column: Column) -> Column:
    """Cut Unicode whitespace off both ends; text without any there is passed on as it is."""
    ends = F.contains(F.lit(BLANKS), F.substring(column, 1, 1)) | F.contains(
        F.lit(BLANKS), F.substring(column, -1, 1))
    return F.when(ends, F.trim(column, F.lit(BLANKS))).otherwise(column)


def whole_number(column: Column, kind: str = "int") -> Column:
    """Digits to a number, other text to null.

    Looked at before it is cast: a cast that fails costs an exception per row.
    """
    return F.when((column != "") & column.rlike(r"^\s*[+-]?\d{1,19}\s*$"), column.try_cast(kind))


def non_empty(column: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(column, F.lit(""))


def captured(column: Column, pattern: str, groups: int) -> Column:
    """All groups of an anchored pattern in one regex pass, as an array.

    A line that does not match gives an array of one element.
    """
    marks = GROUP_MARK.join(f"${i}" for i in range(1, groups + 1))
    return F.split(
        F.regexp_replace(column, F.lit(pattern + r"[\s\S]*$"), F.lit(marks)), GROUP_MARK, groups
    )


def first_match(column: Column, pattern: str, group: int = 1) -> Column:
    """The group of the leftmost match, null when there is none."""
    return non_empty(F.regexp_extract(column, pattern, group))


def all_matches(column: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def last_wins_map(entries: str) -> Column:
    """Map from a column of key/value structs; a repeated key keeps its last value."""
    keys = F.col(entries)["key"]
    kept = F.filter(
        entries,
        lambda e, i: ~F.array_contains(F.slice(keys, i + F.lit(2), F.size(keys)), e["key"]),
    )
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.map_from_entries(F.when(repeated, kept).otherwise(F.col(entries)))


def hold(df, passed=()):
    """The same columns; those not in ``passed`` are computed where they stand.

    A filter on a derived column is otherwise rewritten in terms of the raw line and moved below
    every stage of the parser, which computes all of them again for the filter. The derived
    columns come out of a generator instead: filters on them stay above it, while filters on
    columns only passed through move below it and down to the scan.
    """
    kept = [c for c in df.columns if c in passed]
    made = [c for c in df.columns if c not in passed]
    return (df.select(*kept, F.struct(*made).alias("_held"))
            .select(*kept, F.inline(F.array("_held"))).select(*df.columns))


def pairs(keys: Column, values: Column) -> Column:
    """Zip two arrays to key/value structs."""
    return F.zip_with(
        keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    )


def entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small fixed mapping, null for an unknown key."""
    return F.try_element_at(literal_map(mapping), key)


def any_of(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def all_of(conditions) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result
