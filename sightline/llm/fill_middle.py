"""Fill-in-the-middle: documents are cut at two units' ends and their parts put in another order (operator 12).

Units are lines with their line feed. Their lengths are rows (posexplode); a running sum gives each unit's end, two cut
requests a document are joined to the units by ordinal, their ends are put together by document, and the parts are
substrings of the text. Where to cut, the form and its order depend on the document's id and the seed only.

Rows of equal id and text are one document, cut once. A null id is hashed as the empty string; null texts are empty,
and empty texts are plain. A text that holds a marker is plain. Columns of the results' names are replaced; others are
kept, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare_name

#: The markers, and a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned integers of 32 bits for each id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def form_of(text: Column, h3: Column, h4: Column, rate: int, spm: int) -> Column:
    plain = (text == "") | (h3 % 100 >= rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(marker))
    return F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")


def unit_count(text: Column) -> Column:
    """The number of units: one for each line feed, and one for what follows the last."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def cut_offsets(cuts: DataFrame) -> DataFrame:
    """(key, first_end, second_end) of (key, lengths, first, second): the code points before the cuts.

    lengths: those of the units; first, second: how many units stand before each cut. A cut before all units ends at 0.
    """
    units = cuts.select("key", F.posexplode("lengths").alias("at", "length"))
    running = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select("key", (F.col("at") + 1).alias("ordinal"), F.sum("length").over(running).alias("end"))
    asked = cuts.select("key", F.posexplode(F.array("first", "second")).alias("cut", "ordinal"))
    met = asked.join(ends, ["key", "ordinal"], "left").withColumn("end", F.coalesce("end", F.lit(0).cast("long")))
    return met.groupBy("key").agg(*[F.max(F.when(F.col("cut") == k, F.col("end"))).alias(name) for k, name in enumerate(("first_end", "second_end"))])


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output.

    rate: per cent of documents that are cut; spm: per cent of these with the suffix first.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    n, form = unit_count(whole), form_of(whole, h3, h4, rate, spm)
    own_id = F.col(doc_id).cast("string")
    digest = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.length(own_id), F.lit(-1)).cast("string"), F.coalesce(own_id, F.lit("")), whole), 256))

    lengths = F.transform(F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0)), F.length)
    low, high = (f(h1 % (n + 1), h2 % (n + 1)).cast("int") for f in (F.least, F.greatest))
    cuts = docs.where(form != "plain").select(digest.alias("key"), lengths.alias("lengths"), low.alias("first"), high.alias("second"))
    offsets = cut_offsets(cuts.groupBy("key").agg(*[F.first(c).alias(c) for c in ("lengths", "first", "second")]))

    key = spare_name([*docs.columns, *RESULTS], "key")
    ends = spare_name([*docs.columns, *RESULTS], "ends")
    joined = docs.withColumn(key, digest).join(offsets.select(F.col("key").alias(key), F.struct("first_end", "second_end").alias(ends)), key, "left")
    a, b = F.col(f"{ends}.first_end"), F.col(f"{ends}.second_end")
    prefix, middle = F.substring(whole, F.lit(1), a.cast("int")), F.substring(whole, (a + 1).cast("int"), (b - a).cast("int"))
    suffix = F.substring(whole, (b + 1).cast("int"), F.length(whole))
    parts = {"psm": (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), "spm": (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)}
    ordered = {k: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in v]) for k, v in parts.items()}
    output = F.when(form == "psm", ordered["psm"]).when(form == "spm", ordered["spm"]).otherwise(whole)
    new = {"n": n, "form": form, "prefix_chars": a, "middle_chars": b - a, "output": output}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return joined.select(*kept, *[v.alias(k) for k, v in new.items()])


def restored(output: Column, form: Column) -> Column:
    """The text from which an output of that form was made: the parts between the markers, in their old order."""
    after = lambda marker: F.substring(output, F.locate(marker, output) + len(marker), F.length(output))
    until = lambda x, marker: F.substring_index(x, marker, 1)
    middle = after(MIDDLE)
    psm = F.concat(until(after(PREFIX), SUFFIX), middle, until(after(SUFFIX), MIDDLE))
    spm = F.concat(until(after(PREFIX), MIDDLE), middle, until(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
