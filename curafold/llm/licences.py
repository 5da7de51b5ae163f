"""Licence scans by canonical digests, with DataFrame functions only.

A text is brought to canonical form: lower case, punctuation as spaces, title and copyright lines gone,
equivalent spellings as one. Whole texts, each of their lines, and runs of blocks between blank lines that are as long
as a known text are then hash-joined with the digests of known licences and notices.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curafold.llm.common import text_of
from curafold.llm.licence_texts import LICENCES, WHOLE_DIGESTS
from curafold.session import materialize

#: Known texts up to this number are broadcast; a larger table is an ordinary side of the join.
BROADCAST_ROWS = 10_000

# Signs that only decorate, a line that names the holder, spellings and what they become.
DECORATION = r"[^\p{L}\p{N}\n©]+"
COPYRIGHT_LINE = (
    r"(?m)^ ?(portions )?(copyright|©|c)( copyright| ©| c| by)* ((19|20)[0-9][0-9]|year|yyyy)[^\n]*$"
    r"|^ ?(portions )?(copyright( ©| c| by)+|©) [^\n]*$|^ ?all rights reserved ?$"
)
# At the head of a text or block only.
TITLE_LINE = r"(^|\n ?\n) ?(the )?(mit|x11|isc|zlib|unlicense|bsd|(new|modified|simplified|revised) bsd|bsd [23] clause|[23] clause bsd|freebsd)( license)?( mit| expat| bsd [23] clause)? ?(\n|$)"
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("isation", "ization"), ("ise ", "ize "), ("ised ", "ized "),
    ("ising ", "izing "), ("favour", "favor"), ("whilst", "while"), ("copyright owner", "copyright holder"), ("http ", "https "),
]


def canonical(text: Column) -> Column:
    """Canonical form but for spellings, lines still apart."""
    out = F.regexp_replace(F.lower(text), DECORATION, " ")
    return F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), TITLE_LINE, "\n\n")


def digest(canonical_text: Column) -> Column:
    """Digest of a canonical text without regard to line breaks. Spellings may hang on the space after a word, so they come last."""
    out = F.trim(F.regexp_replace(canonical_text, r"[ \n]+", " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.sha2(out.cast("binary"), 256)


#: Known texts of more blocks are found as whole texts only.
MOST_BLOCKS = 12


def blocks(canonical_text: Column) -> Column:
    """The parts between blank lines."""
    return F.filter(F.split(canonical_text, BLANK_LINES), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(""))) != "")


BLANK_LINES = r"\n[ \n]*\n"


def shipped_lengths() -> list[int]:
    """Numbers of blocks of the texts that ship with the package."""
    return sorted({len([x for x in re.split(BLANK_LINES, text) if x.strip()]) for _, text in LICENCES})


def known_licences(spark: SparkSession) -> DataFrame:
    """The texts that ship with the package: ``licence, text``."""
    rows = [F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, text in LICENCES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _runs(n: int) -> Column:
    """Digests of each ``n`` blocks in a row."""
    first = F.sequence(F.lit(1), F.size("blocks") - (n - 1))
    found = F.transform(first, lambda i: digest(F.array_join(F.slice("blocks", i, n), "\n")))
    return F.when(F.size("blocks") >= n, found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, digest, licence, n_notices, notices``; one row per document.

    ``digest`` is that of the canonical whole text and ``licence`` the known licence it equals, or null;
    ``notices`` has the licences of lines and of runs of blocks that equal a known text, sorted and joined by commas, and
    ``n_notices`` their number. If several known texts have one digest, the first licence by name counts.
    Null counts as empty; a text that is empty in canonical form has no licence. Other columns are left out.
    """
    spark = docs.sparkSession
    shipped = known is None
    known = known_licences(spark) if shipped else known
    plain = known.where("licence IS NOT NULL").select("licence", canonical(text_of()).alias("plain"))
    keys = plain.select("licence", digest(F.col("plain")).alias("found")).where(F.col("found") != F.sha2(F.lit("").cast("binary"), 256))
    if shipped:
        whole = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(found).alias("found")) for name, found in WHOLE_DIGESTS])
        keys = keys.unionByName(spark.range(1).select(F.inline(whole)))
        lengths = shipped_lengths()
    else:
        # At most MOST_BLOCKS rows.
        sizes = plain.select(F.size(blocks(F.col("plain"))).alias("n")).where(F.col("n").between(1, MOST_BLOCKS)).distinct()
        lengths = sorted(r["n"] for r in sizes.collect())
    keys = keys.groupBy("found").agg(F.min("licence").alias("licence"))
    if not shipped:
        keys = materialize(keys, "licence-digests")
    if shipped or keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").alias("id"), canonical(text_of(text)).alias("plain"))
    rows = rows.select("uid", "id", digest(F.col("plain")).alias("whole"), F.split("plain", "\n").alias("lines"), blocks(F.col("plain")).alias("blocks"))
    runs = [_runs(n) for n in lengths]
    parts = F.array_distinct(F.concat(F.array("whole"), F.transform("lines", digest), *runs))
    parts = rows.select("uid", "id", "whole", F.explode(parts).alias("found"))
    # A document's parts are next to each other, so the partial aggregate sends one row for it.
    found = parts.join(keys, "found", "left").groupBy("uid").agg(
        F.any_value("id").alias("id"),
        F.any_value("whole").alias("digest"),
        F.max(F.when(F.col("found") == F.col("whole"), F.col("licence"))).alias("licence"),
        F.array_sort(F.collect_set("licence")).alias("names"),
    )
    return found.select(F.col("id").alias(doc_id), "digest", "licence", F.size("names").cast("long").alias("n_notices"), F.array_join("names", ",").alias("notices"))


def scan_sql() -> str:
    """The same for the shipped texts over ``documents`` in SQL."""
    pattern = lambda p: p.replace("\\n", "\n")
    plain = f"regexp_replace(lower(coalesce(text, '')), '{pattern(DECORATION)}', ' ', 'g')"
    for line, left in ((COPYRIGHT_LINE, ""), (TITLE_LINE, "\n\n")):
        plain = f"regexp_replace({plain}, '{pattern(line)}', '{left}', 'g')"
    quoted = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in LICENCES)
    whole = ", ".join(f"('{name}', '{found}')" for name, found in WHOLE_DIGESTS)
    sha = "trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        sha = f"replace({sha}, '{old}', '{new}')"
    sha = f"sha256({sha})"
    runs = f"SELECT doc_id, digest, {sha.format('run')} FROM (SELECT doc_id, digest, unnest(list_transform(range(1, len(blocks) - n + 2), lambda i: array_to_string(blocks[i : i + n - 1], '\n'))) AS run FROM d, (VALUES {', '.join(f'({n})' for n in shipped_lengths())}) v(n) WHERE len(blocks) >= n)"
    return f"""
WITH texts AS (SELECT 'd' AS kind, doc_id, NULL AS licence, text FROM documents
              UNION ALL SELECT 'k', NULL, licence, text FROM (VALUES {quoted}) k(licence, text)),
c AS (SELECT kind, doc_id, licence, {plain} AS plain FROM texts),
known AS (SELECT found, min(licence) AS licence FROM (SELECT {sha.format("plain")} AS found, licence FROM c WHERE kind = 'k' UNION ALL SELECT found, licence FROM (VALUES {whole}) w(licence, found)) GROUP BY 1),
d AS (SELECT doc_id, {sha.format("plain")} AS digest, string_split(plain, '\n') AS lines,
             list_filter(regexp_split_to_array(plain, '{pattern(BLANK_LINES)}'), lambda x: trim(replace(x, '\n', '')) <> '') AS blocks FROM c WHERE kind = 'd'),
l AS (SELECT DISTINCT doc_id, digest, {sha.format("line")} AS found FROM (SELECT doc_id, digest, unnest(list_append(lines, NULL)) AS line FROM d)
      UNION SELECT doc_id, digest, digest FROM d UNION {runs})
SELECT doc_id, digest, max(CASE WHEN found = digest THEN licence END) AS licence, count(DISTINCT licence) AS n_notices,
       coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS notices
FROM l LEFT JOIN known USING (found) GROUP BY doc_id, digest"""
