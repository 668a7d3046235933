"""The functions that expressions and DataFrames use, by group. All run inside Spark's JVM.

They are Spark's own where its semantics are the wanted ones; the ones defined below differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The function names of the PySpark-compatible layer.
GROUPS = {
    "misc": "col lit when struct array expr call_function coalesce nvl nvl2 ifnull nullif zeroifnull isnull isnotnull isnan equal_null greatest least broadcast rand",
    "order": "asc desc asc_nulls_first asc_nulls_last desc_nulls_first desc_nulls_last",
    "aggregates": "avg mean sum max min median mode any_value count approx_count_distinct approxCountDistinct array_agg collect_list corr covar_pop covar_samp first last product skewness stddev stddev_samp stddev_pop std var_pop var_samp variance",
    "strings": "upper ucase lower lcase trim ltrim rtrim btrim lpad rpad left right substr substring length octet_length ascii char concat concat_ws contains startswith endswith like ilike regexp regexp_like regexp_count regexp_extract regexp_extract_all regexp_replace regexp_substr repeat reverse instr find_in_set initcap levenshtein printf split split_part encode base64 unbase64 hex unhex md5 sha2",
    "math": "abs ceil ceiling floor round bround sqrt cbrt exp ln log2 pow sign signum negative positive factorial sin cos tan cot asin acos atan atan2 degrees radians e pi",
    "dates": "curdate current_date now year quarter month day dayofmonth dayofweek dayofyear weekday weekofyear hour minute second date_trunc date_part datepart extract date_diff add_months last_day to_date to_timestamp to_timestamp_ltz to_timestamp_ntz try_to_timestamp unix_date unix_seconds unix_millis unix_micros",
    "arrays": "array_append array_prepend array_insert array_contains array_position array_remove array_compact array_distinct array_union array_intersect arrays_overlap arrays_zip array_max array_min array_join array_repeat array_size array_sort sort_array flatten slice sequence get transform",
}


def names() -> list[str]:
    return [n for g in GROUPS.values() for n in g.split()]


def array_agg(column) -> Column:
    """All values, nulls too."""
    own = F.col(column) if isinstance(column, str) else column
    return F.transform(F.collect_list(F.struct(own.alias("v"))), lambda s: s["v"])


def skewness_sample(column) -> Column:
    """Skewness corrected for the sample's size; null for fewer than three values."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def mode_first(column, order) -> Column:
    """The most frequent value; of several, the one that comes first by an order column. One sort of a group's values, then their runs."""
    own, place = (F.col(c) if isinstance(c, str) else c for c in (column, order))
    pairs = F.array_sort(F.collect_list(F.when(own.isNotNull(), F.struct(own.alias("v"), place.alias("place")))))

    def counted(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i)["v"] != F.get(s, i - 1)["v"])))
        runs = lambda b: F.transform(b, lambda p, k: F.struct((p - F.coalesce(F.get(b, k + 1), F.size(s))).alias("n"), F.get(s, p)["place"].alias("at"), F.get(s, p)["v"].alias("v")))
        return F.get(F.transform(F.array(begins), lambda b: F.array_min(runs(b))), F.lit(0))

    return F.get(F.transform(F.array(pairs), counted), F.lit(0))["v"]


def regexp_replace_first(column, pattern: str, replacement: str) -> Column:
    """Only the first match replaced."""
    own = F.col(column) if isinstance(column, str) else column
    at = F.regexp_instr(own, F.lit(pattern))
    found = F.regexp_substr(own, F.lit(pattern))
    return F.when(at == 0, own).otherwise(F.concat(F.substr(own, F.lit(1), at - 1), F.lit(replacement), F.substr(own, at + F.length(found))))


def __getattr__(name: str):
    try:
        return getattr(F, name)
    except AttributeError:
        raise AttributeError(f"no function {name}") from None
