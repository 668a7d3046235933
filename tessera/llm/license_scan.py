"""Licence lookup by canonical digest, with DataFrame functions only.

A text is lower-cased, stripped of punctuation and space, freed of copyright lines and rewritten to one
spelling; the SHA-256 digest of what is left is joined to the digests of known licence texts. The same is
done with each single line, for one-line notices. The known texts are a fixed list of this package, some
kilobytes however large the input, so their side is broadcast.

Only lines as long as a known notice are digested; their digests are looked up in a map of the known ones.

Defined cases: a null text has no digest and no licence; a text without letters and digits has a digest and no
licence; repeated rows and null ids are kept; texts of any length are digested whole; other columns stay (one that
has an output's name as that name and `_in`); an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import plain
from tessera.llm.license_texts import DIGESTS, LICENSES, NOTICES, SPELLINGS

#: A line of a copyright notice, once stripped: it begins with the word and the sign, or with one of them and names a year.
COPYRIGHT = r"^(portions)?copyright(copyright|year|yyyy|.*(19|20)[0-9]{2})|^allrightsreserved$"
_STRIP = r"[^\p{L}\p{N}\n]+"
_PLAIN = [(re.sub(r"\W", "", a), re.sub(r"\W", "", b)) for a, b in SPELLINGS]
_SPELLINGS = [(a, b) for a, b in _PLAIN if a != b]


def canonical_lines(text: Column) -> Column:
    """The stripped lines of a text, without copyright lines."""
    marked = F.replace(F.replace(F.lower(text), F.lit("©"), F.lit("copyright")), F.lit("(c)"), F.lit("copyright"))
    plain = F.regexp_replace(marked, _STRIP, "")
    for a, b in _SPELLINGS:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.filter(F.split(plain, "\n"), lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def known(spark: SparkSession) -> DataFrame:
    """digest, license, is_notice and size (characters of the canonical text) of the known texts."""
    whole = [(name, text, False) for name, titles, body in LICENSES for text in [body, *(f"{t}\n\n{body}" for t in titles)]]
    rows = spark.createDataFrame(whole + [(name, text, True) for name, text in NOTICES], "license string, text string, is_notice boolean")
    rows = rows.withColumn("canonical", F.array_join(canonical_lines(F.col("text")), ""))
    return rows.select(F.sha2("canonical", 256).alias("digest"), "license", "is_notice", F.length("canonical").alias("size")).union(
        spark.createDataFrame([(d, name, False, 0) for name, d in DIGESTS], "digest string, license string, is_notice boolean, size int")
    ).distinct()


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with digest, license (of the whole text, null if unknown) and notices (licences that single lines name, sorted)."""
    table = known(docs.sparkSession)
    sizes = sorted({r[0] for r in table.filter("is_notice").select("size").distinct().collect()})  # one for each known notice at most
    own, at, back = plain(docs)
    lines = canonical_lines(F.col(at(text)))
    short = F.array_distinct(F.filter("__lines", lambda x: F.length(x).isin(sizes)))
    read = own.withColumn("__lines", lines)
    read = read.select(*own.columns, F.sha2(F.array_join("__lines", ""), 256).alias("digest"), F.transform(short, lambda x: F.sha2(x, 256)).alias("__short"))
    whole = table.filter("not is_notice").select(F.col("digest").alias("__digest"), "license")
    found = read.join(F.broadcast(whole), F.col("digest") == F.col("__digest"), "left").drop("__digest")
    # a map of the known notices, as fixed as the list of them
    known_notices = table.filter("is_notice").select("digest", "license").collect()
    names = F.create_map(*[F.lit(v) for r in known_notices for v in r])
    notices = F.array_sort(F.array_distinct(F.filter(F.transform("__short", lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull())))
    return back(found.select(*own.columns, "digest", "license", F.coalesce(notices, F.array().cast("array<string>")).alias("notices")))


def oracle() -> str:
    """The same over documents, for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    whole = [(name, text, "false") for name, titles, body in LICENSES for text in [body, *(f"{t}\n\n{body}" for t in titles)]]
    rows = ", ".join(f"({quote(n)}, {quote(t)}, {k})" for n, t, k in whole + [(n, t, "true") for n, t in NOTICES])

    digests = ", ".join(f"({quote(d)}, {quote(name)}, false)" for name, d in DIGESTS)

    def lines(text: str) -> str:
        plain = rf"regexp_replace(replace(replace(lower({text}), '©', 'copyright'), '(c)', 'copyright'), '{_STRIP}', '', 'g')"
        for a, b in _SPELLINGS:
            plain = f"replace({plain}, '{a}', '{b}')"
        return f"list_filter(string_split({plain}, chr(10)), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}'))"

    return f"""
WITH k AS (SELECT DISTINCT sha256(array_to_string({lines("t")}, '')) AS digest, license, is_notice FROM (VALUES {rows}) v(license, t, is_notice) UNION SELECT * FROM (VALUES {digests})),
d AS (SELECT doc_id, {lines("text")} AS l FROM documents),
n AS (SELECT doc_id, list_sort(list(DISTINCT license)) AS notices FROM (SELECT doc_id, unnest(l) AS x FROM d) JOIN k ON sha256(x) = k.digest AND is_notice GROUP BY doc_id)
SELECT d.doc_id, sha256(array_to_string(l, '')) AS digest, k.license, array_to_string(coalesce(n.notices, []), ',') AS notices
FROM d LEFT JOIN k ON sha256(array_to_string(l, '')) = k.digest AND NOT is_notice LEFT JOIN n ON d.doc_id = n.doc_id
"""
