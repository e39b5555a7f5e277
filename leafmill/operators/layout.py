"""Library layout: folder trees, placements, moods, selections.

Recursion is by pointer doubling over the folders; placements join once with the finished closure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import with_checkpoints

LAST = 9007199254740991


def repaired(folders: DataFrame) -> DataFrame:
    """The first row of each id; labels trimmed, ``Untitled folder`` for blanks; parents that don't exist become the root; orders whole and not below 0.

    ``folders``: id, label, parent_id, ord, pos.
    """
    first = folders.where(F.trim("id") != "").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("n = 1").drop("n")
    known = first.select(F.col("id").alias("parent"))
    out = first.join(known, first["parent_id"] == known["parent"], "left")
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("Untitled folder"))
    return out.select("id", label.alias("label"), F.col("parent").alias("parent_id"), F.greatest(F.lit(0), F.floor("ord")).cast("int").alias("ord"), "pos")


def placed(placements: DataFrame, folders: DataFrame) -> DataFrame:
    """The first placement of each book, at the root where its folder does not exist."""
    first = placements.where(F.trim("book_id") != "").withColumn("n", F.row_number().over(Window.partitionBy("book_id").orderBy("pos"))).where("n = 1")
    known = folders.select(F.col("id").alias("parent"))
    return first.join(known, first["parent_id"] == known["parent"], "left").select("book_id", F.col("parent").alias("parent_id"), F.greatest(F.lit(0), F.floor("ord")).cast("int").alias("ord"))


def renumbered_folders(folders: DataFrame) -> DataFrame:
    w = Window.partitionBy("parent_id").orderBy("ord", F.collate("label", "UNICODE"), F.collate("id", "UNICODE"))
    return folders.withColumn("ord", F.row_number().over(w) - 1)


def renumbered_placements(placements: DataFrame) -> DataFrame:
    w = Window.partitionBy("parent_id").orderBy("ord", F.collate("book_id", "UNICODE"))
    return placements.withColumn("ord", F.row_number().over(w) - 1)


def sorted_tree(nodes: DataFrame) -> DataFrame:
    """(parent_id, nth, id): the children of each folder, folders first, then by name as people read it. ``nodes``: id, parent_id, kind (folder or book), name."""
    w = Window.partitionBy("parent_id").orderBy(F.when(F.col("kind") == "folder", 0).otherwise(1), F.collate("name", "UNICODE"), "id")
    return nodes.select("parent_id", (F.row_number().over(w) - 1).alias("nth"), "id")


def ancestors(folders: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of every folder, itself at distance 0; a cycle ends where it meets itself.

    Pointer doubling: after k rounds all ancestors nearer than 2**k are known, so a chain of any length takes as many
    rounds as its length has bits, and no number of folders is too large. A round's rows are cut off by a checkpoint.
    """
    with_checkpoints(folders.sparkSession)
    near = folders.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).distinct()
    leap = folders.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("via")).distinct()
    step, known = 1, -1
    while True:
        near, leap = near.checkpoint(), leap.checkpoint()
        now = near.count()
        if now == known or leap.isEmpty():
            return near
        known = now
        there = near.select(F.col("id").alias("via"), F.col("ancestor").alias("above"), F.col("distance").alias("more"))
        # a parent that is no folder has no row of its own, and is an ancestor itself
        beyond = leap.join(there, "via", "left").select("id", F.coalesce("above", "via").alias("ancestor"), (F.coalesce("more", F.lit(0)) + step).alias("distance"))
        near = near.unionByName(beyond).groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))
        leap, step = leap.join(leap.select(F.col("id").alias("via"), F.col("via").alias("next")), "via").select("id", F.col("next").alias("via")), 2 * step


def cyclic(folders: DataFrame) -> DataFrame:
    """Folders that are their own ancestors."""
    up = ancestors(folders)
    parents = folders.select(F.col("id").alias("child"), F.col("parent_id").alias("up"))
    return up.join(parents, up["ancestor"] == parents["child"]).where(F.col("up") == F.col("id")).select("id").distinct()


def descendants(folders: DataFrame, folder: str) -> DataFrame:
    return ancestors(folders).where(F.col("ancestor") == folder).select("id")


def paths(folders: DataFrame) -> DataFrame:
    """(id, depth, path) with the labels from the root down."""
    up = ancestors(folders).join(folders.select(F.col("id").alias("ancestor"), "label"), "ancestor")
    labels = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "label")))
    return up.groupBy("id").agg((F.count("*") - 1).cast("int").alias("depth"), F.array_join(F.transform(labels, lambda x: x["label"]), "/").alias("path"))


def subtree_counts(folders: DataFrame, placements: DataFrame) -> DataFrame:
    """(id, books) in each folder's subtree; books are counted by folder first, so the closure joins one row a folder."""
    own = placements.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    return ancestors(folders).join(own, "id", "left").groupBy(F.col("ancestor").alias("id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("books"))


def pruned(folders: DataFrame, placements: DataFrame, removable: DataFrame) -> DataFrame:
    """Folders without those removable ones that end up empty: a folder stays if its subtree holds a book or a folder that may not go."""
    keep = placements.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).unionByName(folders.join(removable, "id", "left_anti").select("id")).distinct()
    stay = ancestors(folders).join(keep, "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    return folders.join(stay, "id", "left_semi")


def cascade(folders: DataFrame, placements: DataFrame, selected_books: DataFrame, selected_folders: DataFrame) -> DataFrame:
    """(id, checked, partial): a folder is checked if everything in it is, partial if something is.

    Leaves are books and folders without content; those folders keep their own state.
    """
    has_child = folders.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).unionByName(placements.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"))).distinct()
    books = placements.where("parent_id IS NOT NULL").join(selected_books.withColumn("on", F.lit(1)), "book_id", "left").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"), F.sum(F.coalesce("on", F.lit(0))).alias("on"))
    empty = folders.select("id").join(has_child, "id", "left_anti").join(selected_folders.withColumn("on", F.lit(1)), "id", "left").select("id", F.lit(1).alias("n"), F.coalesce("on", F.lit(0)).alias("on"))
    leaves = books.unionByName(empty)
    up = ancestors(folders).join(leaves, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("n").alias("n"), F.sum("on").alias("on"))
    return up.select("id", (F.col("on") == F.col("n")).alias("checked"), ((F.col("on") > 0) & (F.col("on") < F.col("n"))).alias("partial"))


def root_selected(folders: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected folders under no other selected folder."""
    under = ancestors(folders).where("distance > 0").join(selected.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    return selected.join(under, "id", "left_anti")


def delete_folder_only(folders: DataFrame, placements: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The folder goes, its content moves to its parent, after what is there."""
    parent = folders.where(F.col("id") == folder).select(F.col("parent_id").alias("to"), F.lit(folder).alias("gone"))
    up = lambda df: df.join(F.broadcast(parent), df["parent_id"] == F.col("gone"), "left").withColumns({"ord": F.when(F.col("gone").isNotNull(), F.lit(1 << 30)).otherwise(F.col("ord")), "parent_id": F.when(F.col("gone").isNotNull(), F.col("to")).otherwise(F.col("parent_id"))}).drop("to", "gone")
    return renumbered_folders(up(folders.where(F.col("id") != folder))), renumbered_placements(up(placements))


def delete_with_contents(folders: DataFrame, placements: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    gone = descendants(folders, folder)
    return folders.join(gone, "id", "left_anti"), placements.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti")


def move_folder(folders: DataFrame, folder: str, parent: str | None) -> DataFrame:
    """The folder under another parent, after its children; nothing changes if the parent is missing or lies inside the folder."""
    if parent is not None:
        ok = not folders.where(F.col("id") == parent).isEmpty() and descendants(folders, folder).where(F.col("id") == parent).isEmpty()
        if not ok:
            return renumbered_folders(folders)
    moved = F.col("id") == folder
    return renumbered_folders(folders.withColumns({"ord": F.when(moved, F.lit(1 << 30)).otherwise(F.col("ord")), "parent_id": F.when(moved, F.lit(parent).cast("string")).otherwise(F.col("parent_id"))}))


# moods


def unassigned(books: DataFrame, moods: DataFrame, key: str = "book_id") -> DataFrame:
    """Books in no mood's list."""
    return books.join(moods.select(F.explode("book_ids").alias(key)).distinct(), key, "left_anti")


def listed(moods: DataFrame, *columns: str) -> DataFrame:
    """A row for each book of a mood's list; a library too large for lists keeps its moods in this form."""
    return moods.select(*columns, F.posexplode("book_ids").alias("pos", "book_id"))


def unassigned_rows(books: DataFrame, rows: DataFrame, key: str = "book_id") -> DataFrame:
    """Books in no mood; ``rows`` as ``listed`` gives them."""
    return books.join(rows.select(F.col("book_id").alias(key)).distinct(), key, "left_anti")


def color_rows(rows: DataFrame) -> DataFrame:
    """(book_id, color) of the first mood, in order; ``rows``: mood_order, color, book_id."""
    return rows.groupBy("book_id").agg(F.min_by(F.coalesce("color", F.lit("violet")), "mood_order").alias("color"))


def mood_book_rows(rows: DataFrame, books: DataFrame) -> DataFrame:
    """mood_id, book_id and its place in the mood's list; ids that are no book vanish."""
    return rows.join(books, "book_id", "left_semi").select("mood_id", "pos", "book_id")


def mood_colors(moods: DataFrame) -> DataFrame:
    """(book_id, color) of the first mood, in order, that lists the book; violet where it has none."""
    listed = moods.select("mood_order", F.coalesce("color", F.lit("violet")).alias("color"), F.explode("book_ids").alias("book_id"))
    return listed.groupBy("book_id").agg(F.min_by("color", "mood_order").alias("color"))


def mood_books(moods: DataFrame, books: DataFrame) -> DataFrame:
    """A mood's books in its own order; ids that are no book vanish."""
    listed = moods.select("mood_id", F.posexplode("book_ids").alias("pos", "book_id"))
    return listed.join(books, "book_id").select("mood_id", "pos", "book_id")


def added(ids: Column, more: Column) -> Column:
    return F.array_union(ids, F.filter(more, lambda x: F.trim(x) != ""))


def removed(ids: Column, gone: Column) -> Column:
    return F.filter(ids, lambda x: ~F.array_contains(gone, x))


def selection_label(folders: Column, books: Column) -> Column:
    """``2 folders · 1 book``; ``0 selected`` for nothing."""
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s")))
    return F.coalesce(F.nullif(F.concat_ws(" · ", part(folders, "folder"), part(books, "book")), F.lit("")), F.lit("0 selected"))
