"""Open-vocabulary object names to consensus tokens: lexical forms, spellings, synonyms and subtypes; parts stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalar import nfkc

#: The rules that results depend on.
VERSION = "english_object_names_v2_20261001"
UNKNOWN = ("", "unknown", "unknown object", "unidentified", "unidentified object", "unrecognizable", "unrecognisable", "unclear", "none", "n/a", "na", "not sure", "cannot identify", "unable to identify")
LEXICAL = {
    "black board": "blackboard", "white board": "whiteboard", "book shelf": "bookshelf", "book shelves": "bookshelf", "bookshelves": "bookshelf", "books": "book", "chairs": "chair", "tables": "table", "desks": "desk", "boxes": "box",
    "cabinets": "cabinet", "shelves": "shelf", "doors": "door", "windows": "window", "sofas": "sofa", "couches": "couch", "pillows": "pillow", "cushions": "cushion", "curtains": "curtain", "blinds": "blind", "bottles": "bottle", "cups": "cup",
    "mugs": "mug", "plates": "plate", "bowls": "bowl", "lamps": "lamp", "lights": "light", "containers": "container", "bins": "bin", "trash cans": "trash can", "garbage cans": "garbage can", "recycling bins": "recycling bin",
    "cardboard boxes": "cardboard box", "office chairs": "office chair", "dining chairs": "dining chair", "armchairs": "armchair", "recliners": "recliner", "computers": "computer", "monitors": "monitor", "keyboards": "keyboard",
    "backpacks": "backpack", "bags": "bag", "plants": "plant", "trashcan": "trash can", "trashbin": "trash bin",
}
SPELLING = {"refridgerator": "refrigerator"}
SYNONYMS = {
    "chalkboard": "blackboard", "couch": "sofa", "settee": "sofa", "garbage can": "trash can", "garbage bin": "trash can", "trash bin": "trash can", "waste bin": "trash can", "wastebasket": "trash can", "waste basket": "trash can",
    "rubbish bin": "trash can", "dustbin": "trash can", "television": "tv", "television set": "tv", "tv set": "tv", "fridge": "refrigerator", "washbasin": "sink", "wash basin": "sink", "handbag": "purse", "rucksack": "backpack",
    "power outlet": "electrical outlet", "wall socket": "electrical outlet", "computer display": "monitor",
}
SUBTYPES = {
    "armchair": "chair", "recliner": "chair", "recliner chair": "chair", "reclining chair": "chair", "office chair": "chair", "swivel chair": "chair", "desk chair": "chair", "folding chair": "chair", "dining chair": "chair",
    "dining room chair": "chair", "rocking chair": "chair", "plastic chair": "chair", "upholstered chair": "chair", "leather chair": "chair", "wooden chair": "chair", "lounge chair": "chair", "leather armchair": "chair", "rolling chair": "chair",
    "sectional sofa": "sofa", "sectional couch": "sofa", "loveseat": "sofa", "conference table": "table", "meeting table": "table", "dining table": "table", "coffee table": "table", "side table": "table", "end table": "table",
    "folding table": "table", "round table": "table", "wooden table": "table", "plastic table": "table", "dining room table": "table", "cardboard box": "box", "cardboard carton": "box", "cardboard storage box": "box", "storage box": "box",
    "plastic box": "box", "wooden box": "box", "recycling bin": "trash can", "recycle bin": "trash can", "paper recycling bin": "trash can", "recycling container": "trash can", "shipping container": "container", "cargo container": "container",
    "freight container": "container", "storage container": "container", "computer monitor": "monitor", "lcd monitor": "monitor", "led monitor": "monitor", "desk lamp": "lamp", "floor lamp": "lamp", "table lamp": "lamp",
    "potted plant": "plant", "indoor plant": "plant", "water bottle": "bottle", "plastic bottle": "bottle", "glass bottle": "bottle", "coffee mug": "mug", "ceramic mug": "mug", "tea cup": "cup", "filing cabinet": "cabinet",
    "file cabinet": "cabinet", "storage cabinet": "cabinet", "kitchen cabinet": "cabinet", "bathroom cabinet": "cabinet", "metal cabinet": "cabinet", "wooden cabinet": "cabinet", "sliding door": "door", "glass door": "door",
    "wooden door": "door", "fire door": "door", "garage door": "door",
}
PARTS = {
    "chair back": "chair", "chair backrest": "chair", "chair seat": "chair", "chair leg": "chair", "chair arm": "chair", "armrest": None, "sofa back": "sofa", "sofa cushion": "sofa", "table leg": "table", "tabletop": "table",
    "table top": "table", "book spine": "book", "book cover": "book", "cabinet door": "cabinet", "cabinet handle": "cabinet", "door handle": "door", "door frame": "door", "window frame": "window", "container door": "container", "shipping container door": "container",
}
STEPS = (("lexical", LEXICAL), ("spelling", SPELLING), ("synonym", SYNONYMS), ("subtype", SUBTYPES))


def mapped(name: Column, rules: dict[str, str | None]) -> Column:
    return F.create_map(*[F.lit(x).cast("string") for pair in rules.items() for x in pair])[name]


def without(name: Column, pattern: str) -> Column:
    """The name without what the pattern finds; white space is that of Unicode."""
    return F.regexp_replace(name, f"(?U){pattern}", "")


def cleaned(name: Column) -> Column:
    """The name composed and in lower case, its words apart by one blank; quotes around it, what ends a sentence and an article go."""
    quoted = without(without(F.lower(nfkc(name)), r"^\s+|\s+$"), "^[\"'` ]+|[\"'` ]+$")
    words = F.regexp_replace(without(quoted, r"[.!;,]+$"), r"(?U)[\s_\-]+", " ")
    return without(F.trim(words), r"^(?:an?|the) +")


def normalised(names: DataFrame, name: str = "name", subtypes: bool = True) -> DataFrame:
    """names with cleaned_name, canonical_name, fine_class, relation, is_part, part_of and transformations.

    Apply it to distinct names. Each step looks the result of the last up; relation is the last step that changed
    the name, "part" for parts, which are not turned into their wholes, "unknown", or "identity"; transformations lists the
    steps that did (kind, from, to). Null is unknown.
    """
    out = names.withColumn("cleaned_name", F.coalesce(cleaned(F.col(name)), F.lit("")))
    unknown = F.col("cleaned_name").isin(*UNKNOWN)
    token, relation, fine, steps = F.col("cleaned_name"), F.lit("identity"), None, []
    for kind, rules in STEPS if subtypes else STEPS[:-1]:
        found, said = mapped(token, rules), {"spelling": "lexical", "subtype": "subtype_projection"}.get(kind, kind)
        relation = F.when(found.isNotNull(), said).otherwise(relation)
        steps.append(F.when(found.isNotNull() & ~unknown, F.struct(F.lit(said).alias("kind"), token.alias("from"), found.alias("to"))))
        token = F.coalesce(found, token)
        fine = token if fine is None else fine
    part = fine.isin(*PARTS) & ~unknown
    return out.select(
        *names.columns, "cleaned_name", F.when(unknown, "unknown").otherwise(token).alias("canonical_name"), F.when(~unknown, fine).alias("fine_class"),
        F.when(unknown, "unknown").when(part, "part").otherwise(relation).alias("relation"), part.alias("is_part"), F.when(part, mapped(fine, PARTS)).alias("part_of"),
        F.array_compact(F.array(*steps)).alias("transformations"),
    )


def rules(spark: SparkSession) -> DataFrame:
    """(version, kind, name, becomes): the rules as a table; parts name their whole, which they never become."""
    rows = [(VERSION, "unknown", x, None) for x in sorted(UNKNOWN)]
    rows += [(VERSION, kind, x, y) for kind, table in (*STEPS, ("part", PARTS)) for x, y in sorted(table.items())]
    return spark.createDataFrame(rows, "version string, kind string, name string, becomes string")
