"""Names of objects."""

from sightline.functions import names


def test_names(spark):
    cases = {
        "The  Office-Chairs.": ("chair", "office chair", "subtype_projection"), "Refridgerator": ("refrigerator", "refridgerator", "lexical"), "couches": ("sofa", "couch", "synonym"), "an armrest": ("armrest", "armrest", "part"),
        "“ＴＶ set”": ("“tv set”", "“tv set”", "identity"), "'TV set'": ("tv", "tv set", "synonym"), "book_shelf": ("bookshelf", "bookshelf", "lexical"), "N/A": ("unknown", None, "unknown"), None: ("unknown", None, "unknown"), "": ("unknown", None, "unknown"),
        "table top": ("table top", "table top", "part"), "zebra": ("zebra", "zebra", "identity"), "chair.\t": ("chair", "chair", "identity"), "\u2003A\u00a0Couch\u3000": ("sofa", "couch", "synonym"), "the": ("the", "the", "identity"), "trashbin": ("trash can", "trash bin", "synonym"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r["name"]: (r["canonical_name"], r["fine_class"], r["relation"]) for r in names.normalised(df).collect()}
    assert got == cases
    plain = {r["name"]: r["canonical_name"] for r in names.normalised(df, subtypes=False).collect()}
    assert plain["The  Office-Chairs."] == "office chair" and plain["couches"] == "sofa"
    steps = {r["name"]: [tuple(t) for t in r["transformations"]] for r in names.normalised(df).collect()}
    assert steps["The  Office-Chairs."] == [("lexical", "office chairs", "office chair"), ("subtype_projection", "office chair", "chair")] and steps["zebra"] == steps[None] == steps["table top"] == []
    whole = {r["name"]: (r["is_part"], r["part_of"]) for r in names.normalised(df).collect()}
    assert whole["table top"] == (True, "table") and whole["an armrest"] == (True, None) and whole["zebra"] == (False, None)


def test_rules_are_a_table(spark):
    rows = names.rules(spark).collect()
    kinds = [r["kind"] for r in rows]
    assert {k: kinds.count(k) for k in set(kinds)} == {"unknown": len(names.UNKNOWN), "part": len(names.PARTS), **{k: len(t) for k, t in names.STEPS}}


def test_normalising_again_changes_nothing(spark):
    once = names.normalised(spark.createDataFrame([(x,) for _, t in names.STEPS for x in t], "name string"))
    again = names.normalised(once.select(once["canonical_name"].alias("name")).distinct())
    assert again.where("name != canonical_name").count() == 0
