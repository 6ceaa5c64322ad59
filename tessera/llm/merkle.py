"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut after blank lines into sections, and a section after line ends
into paragraphs; these are the leaves, a paragraph of several sentences being cut
after ``. `` as well, so that an edit in a long one touches few leaves. A leaf's hash is the
SHA-256 of its text, a section's that of its leaves' hashes, the root's that of
its sections'. Equal roots mean equal trees; where roots differ, unequal
sections and leaves below them show the places.

The fingerprint is text: the root's hash, then per section ``/`` and its leaves,
each as the first 12 hex digits and the length in code points. Likeness is the
share of leaf text that two fingerprints have in common: total length of common
leaves over that of all (a repeated leaf counts once); 1.0 for two empty texts.

Only SQL functions. Defined cases: a very long text is one row with as many leaves as it has; null text is the empty text, with no leaf;
rows equal in doc_id and text are one document in the neighbour order, and each
comes out; a null doc_id comes last, as the smallest long (which is kept for it);
a single document is its own next; an empty table gives an empty result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

LEAF_DIGITS = 12
NO_ID = -(1 << 63)


def sections_of(text: Column) -> Column:
    """Non-empty sections as arrays of leaves. Nothing is trimmed: the cut
    characters stay at the end of a leaf, so the leaves rebuild the section."""
    parts = F.filter(F.split(text, "(?<=\n\n)(?!\n)"), lambda s: s != "")
    return F.transform(parts, lambda s: F.filter(F.split(s, "(?<=\n)|(?<=\\. )"), lambda p: p != ""))


def tree(text: Column) -> Column:
    """The sections: array of struct(hash, leaves: array of struct(hash, chars))."""
    def leaf(p):
        return F.struct(F.sha2(p, 256).alias("hash"), F.char_length(p).alias("chars"))

    hashed = F.transform(sections_of(F.coalesce(text, F.lit(""))), lambda ps: F.transform(ps, leaf))
    return F.transform(hashed, lambda ls: F.struct(
        F.sha2(F.array_join(F.transform(ls, lambda x: x["hash"]), ""), 256).alias("hash"), ls.alias("leaves")))


def fingerprint(sections: Column) -> Column:
    """The fingerprint string of a tree's sections."""
    root = F.sha2(F.array_join(F.transform(sections, lambda s: s["hash"]), ""), 256)
    body = F.transform(sections, lambda s: F.array_join(F.transform(
        s["leaves"], lambda x: F.concat(F.substring(x["hash"], 1, LEAF_DIGITS), F.lit("-"), x["chars"].cast("string"))), ","))
    return F.concat(root, F.array_join(F.transform(body, lambda b: F.concat(F.lit("/"), b)), ""))


def leaves_of(print_: Column) -> Column:
    """The distinct leaf marks of a fingerprint string."""
    return F.array_distinct(F.filter(F.split(F.substr(print_, F.lit(65)), "[/,]"), lambda x: x != ""))


def _chars(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, x: n + F.substr(x, F.lit(LEAF_DIGITS + 2)).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two leaf sets (``leaves_of``), from 0.0 to 1.0."""
    common, total = _chars(F.array_intersect(a, b)), _chars(a) + _chars(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(common / F.greatest(total - common, F.lit(1)))


def differing_leaves(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Where two versions differ: trees are compared from the root down. For
    documents whose roots differ (key, section, leaf, a_chars, b_chars): places
    counted from 0 whose leaves are unequal; null: no leaf there. The frames
    have ``key`` and ``text``."""
    def flat(df, name):
        t = df.select(key, tree(F.col("text")).alias("t"))
        sec = t.select(key, F.posexplode("t").alias("section", "s"))
        return t, sec.select(key, "section", F.col("s.hash").alias(f"{name}_hash"), F.col("s.leaves").alias(f"{name}_leaves"))

    (ta, sa), (tb, sb) = flat(a, "a"), flat(b, "b")
    changed = ta.select(key, fingerprint(F.col("t")).alias("x")).join(tb.select(key, fingerprint(F.col("t")).alias("y")), key).filter("x <> y").select(key)
    pairs = sa.join(sb, [key, "section"], "full").filter(~F.col("a_hash").eqNullSafe(F.col("b_hash"))).join(changed, key, "left_semi")
    leaves = F.arrays_zip(F.coalesce("a_leaves", F.expr("array()")), F.coalesce("b_leaves", F.expr("array()")))
    each = pairs.select(key, "section", F.posexplode(leaves).alias("leaf", "z"))
    return each.filter(~F.col("z.0.hash").eqNullSafe(F.col("z.1.hash"))).select(
        key, "section", "leaf", F.col("z.0.chars").alias("a_chars"), F.col("z.1.chars").alias("b_chars"))


def _keyed(docs: DataFrame) -> DataFrame:
    """id (doc_id, the smallest long for null), mark (hash of the text) and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text")).select(
        "id", F.xxhash64("text").alias("mark"), "text")


def neighbours(keyed: DataFrame) -> DataFrame:
    """id, mark, n (code points), next_id, next_mark: the next distinct row in
    falling id, the first for the last. The rows without their texts are sorted
    by range and stored; only range ends meet in one small window."""
    slim = keyed.select("id", "mark", F.char_length("text").alias("n")).distinct()
    order = [F.col("id").desc(), F.col("mark")]
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("part").orderBy(*order)
    each = ranged.withColumn("after", F.lead(F.struct("id", "mark")).over(inside)).withColumn("nth", F.row_number().over(inside))
    whole = Window.orderBy("part")
    ends = each.filter("nth = 1").select("part", F.struct("id", "mark").alias("head"))  # one row a range
    ends = ends.select("part", F.coalesce(F.lead("head").over(whole), F.first("head").over(
        whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))
    linked = each.join(ends, "part").withColumn("next", F.coalesce("after", "following"))
    return linked.select("id", "mark", "n", F.col("next.id").alias("next_id"), F.col("next.mark").alias("next_mark"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), fingerprint(tree(text)).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each text against its edited self (its last third replaced by the start
    of the next document in falling doc_id) and against that next document.
    Texts are dealt once by (id, mark); only the starts that the edits need and
    the next documents' fingerprints travel besides."""
    keyed = _keyed(docs)
    wanted = neighbours(keyed).select(
        F.col("id").alias("for_id"), F.col("mark").alias("for_mark"), F.col("next_id").alias("id"), F.col("next_mark").alias("mark"),
        F.floor(F.col("n") / 3).cast("int").alias("take"))
    given = (keyed.join(wanted, ["id", "mark"])
             .select(F.col("for_id").alias("id"), F.col("for_mark").alias("mark"),
                     F.substr("text", F.lit(1), "take").alias("head"), fingerprint(tree(F.col("text"))).alias("next_print"))
             .groupBy("id", "mark").agg(F.first("head").alias("head"), F.first("next_print").alias("next_print")))
    n = F.char_length("text")
    edited = keyed.join(given, ["id", "mark"]).select(
        "id", "text", "next_print", F.concat(F.substr("text", F.lit(1), n - F.floor(n / 3).cast("int")), "head").alias("edited"))
    prints = edited.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(tree(F.col("text"))).alias("fingerprint"), fingerprint(tree(F.col("edited"))).alias("edited_fingerprint"), "next_print")
    sets = prints.select(*prints.columns[:-1], *(leaves_of(F.col(c)).alias(f"set_{i}") for i, c in enumerate(
        ("fingerprint", "edited_fingerprint", "next_print"))))
    own, changed, other = (F.col(f"set_{i}") for i in range(3))
    return sets.select(*prints.columns[:-1], likeness(own, changed).alias("near_edited"), likeness(own, other).alias("near_next"))
