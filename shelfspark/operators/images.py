"""Photo folders: scores against products, one-to-one links, suggestions and an overview."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shelfspark.config import FOLDER_HINTS, POLICY
from shelfspark.functions.text import normalize_key
from shelfspark.operators import alike
from shelfspark.operators.graph import components
from shelfspark.operators.spread import spread


def folders(files: DataFrame, root_depth: int = 0) -> DataFrame:
    """folder, category hint, number of images and the first image, from a listing of relative paths `<Category>/<Product>/...`."""
    part = lambda i: F.get(F.split("path", "/"), F.lit(root_depth + i))
    hint = lambda j: F.element_at(F.create_map(*(F.lit(x) for k, v in FOLDER_HINTS.items() for x in (k, v[j]))), part(0))
    photos = files.where(F.lower("path").rlike(_PHOTO) & (F.size(F.split("path", "/")) > root_depth + 2))
    return photos.groupBy(F.concat_ws("/", part(0), part(1)).alias("folder"), part(1).alias("title"), hint(0).alias("category"), hint(1).alias("subcategory")).agg(F.count("*").alias("n_images"), F.min("path").alias("primary_image"))


def product_images(files: DataFrame, root_depth: int = 0) -> DataFrame:
    """Each product folder's images in order: a folder's own before those of its sub-folders, then by name.

    `variant` is the sub-folder right under the product's; the first image is the primary one.
    """
    parts = F.split("path", "/")
    part = lambda i: F.get(parts, F.lit(root_depth + i))
    photos = files.where(F.lower("path").rlike(_PHOTO) & (F.size(parts) > root_depth + 2))
    variant = F.when(F.size(parts) > root_depth + 3, part(2))
    # at each level files come before folders: a folder's name sorts after the mark of a file
    steps = F.slice(parts, root_depth + 3, F.size(parts))
    key = F.concat_ws("/", F.transform(steps, lambda s, i: F.concat(F.when(i == F.size(steps) - 1, "0").otherwise("1"), F.lower(s))))
    one = photos.select(F.concat_ws("/", part(0), part(1)).alias("folder"), F.struct(key.alias("key"), "path", variant.alias("variant")).alias("i"))
    listed = one.groupBy("folder").agg(F.sort_array(F.collect_list("i")).alias("l"))  # one product's photos
    image = lambda i, n: F.struct(i["path"].alias("path"), F.lit(None).cast("string").alias("url"), i["variant"].alias("variant"), (n == 0).alias("is_primary"))
    return listed.select("folder", F.transform("l", image).alias("images"))


#: The endings of photos.
_PHOTO = r"\.(jpe?g|png|webp|jfif|avif|gif)$"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, relative to the root, and length of every file of a folder tree, listed by Spark through the file system that the root names.

    Large trees are listed in parallel; no file is opened. Folders without files have no rows; names may hold any
    character. A root that does not exist gives no rows.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return spark.createDataFrame([], "path string, length long")
    top = store.makeQualified(where).toUri().getPath().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    own = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return found.select(F.substring(own, F.lit(len(top) + 2), F.length(own)).alias("path"), "length")


def score_matches(found: DataFrame, products: DataFrame, least: float = POLICY.image_link, every: bool = False, best: int | None = None) -> DataFrame:
    """folder, id and score of pairs that reach `least` and share a word, or an SKU that stands in the folder's name.

    With `every`, pairs that reach it by edits inside every word too. With `best`, of each folder only pairs of its
    `best` highest scores, equal ones included, from each block of products. Folders and products are dealt in
    blocks, and each two blocks are one task's work (see `operators/alike.py`).
    """
    none = F.lit(None).cast("string")
    f = spread(found.select("folder", "category", "subcategory", "title")).select(F.lit(True).alias("_found"), "folder", F.lit(None).cast(products.schema["id"].dataType).alias("id"), normalize_key(F.col("title")).alias("k"), F.lit("").alias("sk"), "category", "subcategory")
    p = spread(products.select("id", "name", "sku", "category", F.col("subcategory").alias("ps") if "subcategory" in products.columns else none.alias("ps"))).select(
        F.lit(False).alias("_found"), none.alias("folder"), "id", normalize_key(F.col("name")).alias("k"), normalize_key(F.col("sku")).alias("sk"), F.col("category").cast("string").alias("category"), F.col("ps").alias("subcategory"),
    )
    cores = found.sparkSession.sparkContext.defaultParallelism
    counts = {r["f"]: r["count"] for r in found.select(F.lit(True).alias("f")).union(products.select(F.lit(False).alias("f"))).groupBy("f").count().collect()}
    of_p = max(1, -(-counts.get(False, 0) // PIECE))
    of_f = -(-max(-(-counts.get(True, 0) // LOT), 2 * cores // of_p) // cores) * cores  # as many as all cores take at once, or a multiple
    deal = lambda rows, own, n, other, m: rows.select("*", F.pmod(F.xxhash64(own), F.lit(n)).cast("int").alias(f"_{own}"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(f"_{other}"))
    both = deal(f, "folder", of_f, "id", of_p).unionByName(deal(p, "id", of_p, "folder", of_f)).withColumn("_block", F.col("_folder") * of_p + F.col("_id")).drop("_folder", "_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = pa.Table.from_batches(batches, shape)
        for block in pc.unique(dealt["_block"]):  # one in a partition
            t = dealt.filter(pc.equal(dealt["_block"], block))
            x, y = t.filter(t["_found"]), t.filter(pc.invert(t["_found"]))
            folder, key = x["folder"].combine_chunks(), y["id"].combine_chunks()
            sides = [{c: rows[c].to_pylist() for c in ("k", "sk", "category", "subcategory")} for rows in (x, y)]
            for i, j, raw in alike.scores(*sides, least, every, best):
                yield pa.RecordBatch.from_arrays([folder.take(pa.array(i)), key.take(pa.array(j)), pa.array(raw)], ["folder", "id", "raw"])

    shape = to_arrow_schema(both.schema)
    raw = both.repartitionById(of_f * of_p, "_block").mapInArrow(score, f"folder string, id {products.schema['id'].dataType.simpleString()}, raw double")
    # a filter would be pushed under the score and work it out twice
    return raw.select("folder", "id", F.round("raw", 3).alias("score")).select("folder", "id", F.explode(F.when(F.col("score") >= least, F.array("score"))).alias("score"))


#: Folders and products that a block holds at most, about.
LOT, PIECE = 20_000, 100_000


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of a block's pairs, in the order of score, folder and id, those whose folder and product are both free."""
    folders, ids, keep = set(), set(), []
    pairs = pairs.sort_values(["score", "folder", "id"], ascending=[False, True, True], kind="stable")
    for folder, i in zip(pairs["folder"].tolist(), pairs["id"].tolist(), strict=True):
        free = folder not in folders and i not in ids
        keep.append(free)
        if free:
            folders.add(folder)
            ids.add(i)
    return pairs[keep][["folder", "id", "score"]]


def links(found: DataFrame, products: DataFrame, least: float, save, every: bool = False) -> DataFrame:
    """The links that `assign` makes of all pairs of `score_matches`, without all pairs being made.

    Scores go by falling bounds: the pairs that reach a bound are linked before any below it, so the next bound is
    asked only of the folders and products that are still free.
    """
    f, p, out = save(found.select("folder", "category", "subcategory", "title")), save(products.select(*(c for c in ("id", "name", "sku", "category", "subcategory") if c in products.columns))), []
    for bound in (*(b for b in BOUNDS if b > least), least):
        out.append(assign(score_matches(f, p, bound, every), save))
        if bound > least:
            f, p = save(f.join(out[-1].select("folder"), "folder", "left_anti")), save(p.join(out[-1].select("id"), "id", "left_anti"))
    return reduce(DataFrame.unionByName, out)


#: Scores by which links are made, the best first.
BOUNDS = (0.85,)


def assign(scores: DataFrame, save, block: int = 20_000) -> DataFrame:
    """One-to-one links, the best score first: those of taking pairs in the order of score, folder and id.

    Pairs go by bands of scores, the best first, each of at most ten blocks and of one score at least: what a band
    links is taken out of the rest, which soon is small. A band of that size is one group's work; equal scores of
    more pairs go by their blocks.
    """
    left, out = save(scores.select("folder", "id", "score").distinct()), []
    while True:
        # some hundred scores, then the next band
        levels, total, cut = left.groupBy("score").count().orderBy(F.desc("score")).limit(1000).collect(), 0, None
        if not levels:
            return reduce(DataFrame.unionByName, out, left)
        for r in levels:
            if cut is not None and total + r["count"] > 10 * block:
                break
            total, cut = total + r["count"], r["score"]
        band = left.where(F.col("score") >= cut)
        links = save(band.groupBy(F.lit("all").alias("_all")).applyInPandas(_greedy, left.schema)) if total <= 10 * block else save(_by_blocks(band, save, block))
        out.append(links)
        rest = left.where(F.col("score") < cut)
        left = save(rest.join(links.select("folder"), "folder", "left_anti").join(links.select("id"), "id", "left_anti").select("folder", "id", "score"))


def _by_blocks(scores: DataFrame, save, block: int) -> DataFrame:
    """The same links where pairs are more than a group's work.

    Pairs that are connected by common folders or products are a block, and blocks do not touch each other, so
    each is work of one group, small ones together. Of blocks of more than `block` pairs those that are each other's best are
    linked, which leaves smaller blocks, until all are small. `save` writes a table and reads it back.
    """
    left, out = save(scores.select("folder", "id", "score").distinct()), []
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    while not left.isEmpty():
        named = components(left.select(node("f", "folder").alias("a"), node("p", "id").alias("b")), save)
        placed = save(left.join(named, node("f", "folder") == F.col("node")).select("folder", "id", "score", F.col("component").alias("_block")))
        sizes = placed.groupBy("_block").agg(F.count("*").alias("_n"))
        large = save(sizes.where(F.col("_n") > block).select("_block"))
        small = placed.join(large, "_block", "left_anti")
        # blocks do not touch each other, so a group may hold as many as make up the pairs of one
        lots = 1 + (small.count() // block if block else 0)
        out.append(save(small.groupBy(F.pmod(F.xxhash64("_block"), F.lit(lots)).alias("_lot")).applyInPandas(_greedy, left.schema)))
        rest = placed.join(large, "_block", "left_semi").select("folder", "id", "score")
        by_folder = rest.groupBy("folder").agg(F.min_by("id", F.struct((-F.col("score")).alias("s"), "id")).alias("best_id"))
        by_id = rest.groupBy("id").agg(F.min_by("folder", F.struct((-F.col("score")).alias("s"), "folder")).alias("best_folder"))
        both = save(rest.join(by_folder, "folder").join(by_id, "id").where("id = best_id and folder = best_folder").select("folder", "id", "score"))
        out.append(both)
        left = save(rest.join(both.select("folder"), "folder", "left_anti").join(both.select("id"), "id", "left_anti"))
    return reduce(DataFrame.unionByName, out, left)


def suggestions(scores: DataFrame, k: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("score"), "id"))
    return scores.where("score > 0.2").withColumn("rank", rank).where(F.col("rank") <= k)


def overview(found: DataFrame, links: DataFrame, products: DataFrame) -> DataFrame:
    linked = found.join(links.select("folder").withColumn("linked", F.lit(True)), "folder", "left").agg(
        F.count("*").alias("folders"), F.coalesce(F.sum("n_images"), F.lit(0)).alias("images"), F.count("linked").alias("linked"), (F.count("*") - F.count("linked")).alias("unlinked"),
    )
    without = products.where("is_active").join(links.select("id"), "id", "left_anti").agg(F.count("*").alias("products_without_images"))
    return linked.join(F.broadcast(without))  # one row each


def unmatched(found: DataFrame, links: DataFrame) -> DataFrame:
    return found.join(links.select("folder").distinct(), "folder", "left_anti")


def linked(found: DataFrame, products: DataFrame) -> DataFrame:
    """Each folder with the product that holds it: of several the last by id, null if none does."""
    held = products.where("image_source IS NOT NULL").groupBy(F.col("image_source").alias("folder")).agg(F.max("id").alias("id"))
    return found.join(held, "folder", "left")


def link(products: DataFrame, links: DataFrame, images: DataFrame) -> DataFrame:
    """Products with the images of the folder (folder, id) that is theirs now; who held the folder before holds none.

    `products` has image_source and images, `images` is that of product_images.
    """
    own = links.join(images, "folder").select("id", F.col("folder").alias("_folder"), F.col("images").alias("_images"))
    taken = links.select(F.col("folder").alias("image_source"), F.col("id").alias("_new_owner"))
    rows = products.join(own, "id", "left").join(taken, "image_source", "left")
    lost = F.col("_new_owner").isNotNull() & (F.col("_new_owner") != F.col("id"))
    value = lambda new, old: F.when(F.col("_folder").isNotNull(), F.col(new)).when(~F.coalesce(lost, F.lit(False)), F.col(old))
    done = {"image_source": value("_folder", "image_source"), "images": value("_images", "images")}
    return rows.select(*(done[c].alias(c) if c in done else F.col(c) for c in products.columns))


def unlink(products: DataFrame, ids: DataFrame) -> DataFrame:
    """The products named hold no images any more."""
    gone = products.join(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    value = lambda c: F.when(F.col("_gone").isNull(), F.col(c))
    return gone.select(*(value(c).alias(c) if c in ("image_source", "images") else F.col(c) for c in products.columns))


def auto_link(files: DataFrame, products: DataFrame, save, threshold: float = POLICY.image_link, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """The links found, and the products as they are or, unless it is a dry run, with their images."""
    if threshold < 0.3:
        raise ValueError("a threshold below 0.3 would link unlike names")
    made = links(folders(files), products, threshold, save, every=True)
    return made, products if dry_run else link(products, made, product_images(files))
