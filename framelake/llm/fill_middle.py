"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and put in another order behind sentinels.

Built-in functions only: a regular expression makes the array of a text's units, digits of a hash of the id give the cuts, slices of
the array joined again are the parts, and a text is restored by splitting the output at its sentinels. No rows move, so the work
is a projection of the scan.

Sentinels can't arise by chance: a text that holds one stays plain, and as none begins with another's end, a part's last characters
and the sentinel after it make no earlier one.

Defined results: a null text is as an empty one, which stays plain; a null id counts as an empty one in the hash, so its rows are cut alike; units
are code points, so a letter and its combining accent may be parted; texts of any length are cut whole; repeated rows give
repeated rows; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any code point, line ends, too.
UNIT = "(?s)."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, so many stay plain, and of 100 others, so many have their suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def _draws(column: str, seed: str, n: int = 4) -> list[Column]:
    """n whole numbers of 32 bits from the sha256 of ``seed:id``."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def arranged(docs: DataFrame, seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form ("plain", "psm" or "spm"), prefix_chars, middle_chars (null if plain) and output for each document."""
    h1, h2, h3, h4 = _draws("doc_id", seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("_text", F.lit(mark))
    form = F.when((F.col("_text") == "") | held | (F.col("_h3") % 100 >= 100 - plain), "plain").when(F.col("_h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("_text"), h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"))
    rows = rows.withColumn("form", form).withColumn("_units", F.regexp_extract_all("_text", F.lit(UNIT), F.lit(0)))
    rows = rows.withColumn("n", F.size("_units").cast("long"))
    a, b = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    rows = rows.withColumns({"_from": F.least(a, b), "_to": F.greatest(a, b)})

    def part(begin: Column, end: Column) -> Column:
        return F.array_join(F.slice("_units", (begin + 1).cast("int"), (end - begin).cast("int")), "")

    rows = rows.withColumns({"_prefix": part(F.lit(0), F.col("_from")), "_middle": part(F.col("_from"), F.col("_to")), "_suffix": part(F.col("_to"), F.col("n"))})
    psm = F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle")
    spm = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle")
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form", F.when(cut, F.col("_from")).alias("prefix_chars"), F.when(cut, F.col("_to") - F.col("_from")).alias("middle_chars"),
        F.when(~cut, F.col("_text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` (form, output) with the text they were made from, in a column ``text``."""
    part = F.split("output", f"[{PREFIX[0]}][PSM][{PREFIX[-1]}]", -1)  # what is before the first sentinel is empty
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return rows.withColumn("text", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text restored from it."""
    rows = restored(arranged(docs, seed))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("text").alias("restored_sha256"))
