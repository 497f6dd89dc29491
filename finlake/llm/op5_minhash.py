"""Near-duplicate detection with fast similarity sketches.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. The
sketch has COORDINATES values: in round r every element falls into one hashed
bin with a value that rises with r, and a bin keeps its smallest; after
COORDINATES random rounds, round r puts every element into bin r, so each bin
fills. A document stops at the round that fills its last bin, usually the
third. Bins are nearly independent, so estimates concentrate as for classic
MinHash at a small part of its cost. BANDS bands of ROWS coordinates give the
candidates: a pair of similarity 0.85 shares none with probability 7e-9, one of
0.8 with 3e-6.

Sets that are equal are merged first: sets with one 128-bit digest are compared
in full (their smallest and largest, which Spark finds before it shuffles), and
where they differ after all none of them is merged. In a band bucket of up to SMALL_BUCKET sets all pairs are candidates. The sets of larger buckets
go an exact way that needs no sketch: sets with enough overlap share one of
their rarest elements (a prefix, in order of frequency), and a prefix list is
compared by stars first (each member with a central one, which has the element
earliest in its order and so has the fewest elements of its own), then only
between members that different components still hold. These meet by pairs of classes
of size that both allow: linked sizes are near, and the place of the list's element
in a member's order bounds the size of those it can link with. So members that
share a passage too small to link them do not meet. A pair of classes is cut into
pairs of blocks, so that no task gets a whole list. All candidates are confirmed on their full sets. Links within one
component that are not listed change no result.

A null or empty text, or one of white space only, has an empty set and links
with nothing. Rows without a doc_id are left out. A doc_id is one document: of
rows that repeat it the one with the smallest set size and digest counts, and
one row is returned; ``near_dedup`` keeps or drops all of them alike. Extra
columns are ignored. An empty table gives no rows. Shingles are 64-bit hashes
of 64-bit hashes of words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlake.llm.components import connected_components
from finlake.llm.kernels import LOWER, U64, distinct_by_row, fold, list_array, mix, row_sums, shingles, text_bytes
from finlake.llm.scratch import Scratch, arrow_map, documents

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
SMALL_BUCKET = 8
#: Rounds of stars before the members of different components are compared.
STARS = 2
#: Members of a list and size class that are compared with as many others in one key, about.
BLOCK = 1000
EMPTY = U64(2**64 - 1)


def sketches(values: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` coordinates for each set values[bounds[i]:bounds[i + 1]]; empty sets stay EMPTY."""
    rows = len(bounds) - 1
    out = np.full(rows * t, EMPTY, U64)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    for r in range(2 * t):
        if not len(row):
            break
        h = mix(values + U64((2 * r + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bins = ((h >> U64(40)) * U64(t)) >> U64(24) if r < t else U64(r - t)
        np.minimum.at(out, row * t + bins.astype(np.int64), (h & U64(2**48 - 1)) | U64(r << 48))
        if r >= t or r % 4 == 2 or r < 3:
            open_rows = (out.reshape(rows, t) == EMPTY).any(axis=1)
            keep = open_rows[row]
            values, row = values[keep], row[keep]
    return out.reshape(rows, t)


def _sets(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = text_bytes(block.column("text"))
    return distinct_by_row(*shingles(LOWER[data], bounds), block.num_rows)


def _sketch_columns(block: pa.RecordBatch) -> dict:
    values, bounds = _sets(block)
    s = sketches(values, bounds)
    bands = np.stack([fold([s[:, b * ROWS + k] for k in range(ROWS)], b + 1) for b in range(BANDS)], axis=1)
    return {
        "doc_id": block.column("doc_id"),
        **_digest(values, bounds),
        "bands": list_array(bands.reshape(-1).view(np.int64), np.arange(block.num_rows + 1) * BANDS),
    }


def _set_columns(block: pa.RecordBatch) -> dict:
    values, bounds = _sets(block)
    return {"doc_id": block.column("doc_id"), **_digest(values, bounds), "items": list_array(values.view(np.int64), bounds)}


def _digest(values: np.ndarray, bounds: np.ndarray) -> dict:
    """Size and two sums of each set."""
    sums = [row_sums(mix(values ^ U64(seed)), bounds).view(np.int64) for seed in (0, 0xC2B2AE3D27D4EB4F)]
    return {"n_shingles": np.diff(bounds), "k1": sums[0], "k2": sums[1]}


def _linked(threshold: int) -> F.Column:
    both = F.size(F.array_intersect("items_a", "items_b"))
    return 100 * both >= threshold * (F.size("items_a") + F.size("items_b") - both)


def _fits(threshold: int) -> F.Column:
    """Sizes n_a and n_b that a link allows."""
    return (100 * F.col("n_a") >= threshold * F.col("n_b")) & (100 * F.col("n_b") >= threshold * F.col("n_a"))


def _early(threshold: int) -> F.Column:
    """Whether a shared element stands early enough in both orders: sets that overlap enough share one that does.

    An overlap of o leaves the first shared element among the first n - o + 1 of either set.
    """
    overlap = F.ceil(threshold * (F.col("n_a") + F.col("n_b")) / F.lit(100 + threshold))
    return (F.col("place_a") <= F.col("n_a") - overlap + 1) & (F.col("place_b") <= F.col("n_b") - overlap + 1)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough."""
    return (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
        .where(_linked(threshold))
        .select("a", "b")
    )


def _prefixes(sets: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """(item, doc_id, n, place) for the rarest items of each set, enough of them that linked sets share one.

    A link needs an overlap of at least threshold % of the larger set, hence of
    one's own: at most n - ceil(threshold * n / 100) items can be missing.
    """
    items = scratch.save(sets.select("doc_id", F.size("items").alias("n"), F.explode("items").alias("item")), "items")
    counts = scratch.save(items.groupBy("item").agg(F.count("*").alias("among")), "among")
    order = Window.partitionBy("doc_id").orderBy("among", "item")
    rare = items.join(counts, "item").withColumn("place", F.row_number().over(order))
    return rare.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold / F.lit(100)) + 1).where("among > 1").select("item", "doc_id", "n", "place")


CELL = ["item", "row_class", "column_class", "row", "column"]
#: Classes of size that a factor of 100 / threshold spans.
CLASSES = 8


def _classes(threshold: int) -> tuple[F.Column, F.Column]:
    """The class of size of a member (n, place) of a list, and the classes of those it can link with.

    A link needs sizes within a factor of 100 / threshold, and an overlap of at least
    threshold * (n + m) / (100 + threshold). What the list's item and all later ones
    can give is n - place + 1; so place bounds the partner's size m from above. Both
    must allow the other's class to meet.
    """
    width = max(math.log(100 / threshold), 0.01) / CLASSES
    of = lambda size: F.floor(F.log(size) / width).cast("int")
    least = F.col("n") * threshold / 100.0
    most = F.least(F.col("n") * 100.0 / threshold, (F.col("n") - F.col("place") + 1) * (100.0 + threshold) / threshold - F.col("n"))
    near = 1e-9  # more than rounding can lose
    return of(F.col("n") * (1 + near)), F.when(most * (1 + near) >= least, F.sequence(of(least * (1 - near)), of(most * (1 + 2 * near))))


def _cells(away: DataFrame, members: DataFrame, scratch: Scratch, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by CELL: a member of ``away`` meets those of ``members`` of its list whose class of size it allows and that allow its class.

    The members of a cell are cut into blocks, and each pair of blocks is a key of
    its own.
    """
    own, allowed = _classes(threshold)
    away = away.withColumn("row_class", own).withColumn("column_class", F.explode(allowed))
    away = scratch.save(away, "away")
    near = members.join(away.select("item").distinct(), "item", "left_semi").withColumn("column_class", own).withColumn("row_class", F.explode(allowed))
    near = scratch.save(near.join(away.select(*CELL[:3]).distinct(), CELL[:3], "left_semi"), "near")
    blocks = scratch.save(near.groupBy(*CELL[:3]).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return away.join(blocks, CELL[:3]).withColumn("row", mine).withColumn("column", every), near.join(blocks, CELL[:3]).withColumn("column", mine).withColumn("row", every)


DIGEST = ["n_shingles", "k1", "k2"]


def _one_row_per_id(made: DataFrame, scratch: Scratch) -> DataFrame:
    """``made`` without repeated ids; only these are sorted."""
    repeated = made.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct(*DIGEST)).alias("least")).where("n > 1")
    repeated = scratch.save(repeated, "repeated")
    if repeated.isEmpty():
        return made
    one = made.join(repeated, "doc_id").where(F.struct(*DIGEST) == F.col("least")).dropDuplicates(["doc_id"]).select(*made.columns)
    return scratch.save(made.join(repeated, "doc_id", "left_anti").unionByName(one), "single")


def _full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the documents in ``wanted`` (doc_id and digest), of repeated ids that of the digest."""
    # Merged at every size, so that a larger input does the same as a small one.
    made = arrow_map(texts.join(wanted.select("doc_id").hint("merge"), "doc_id", "left_semi"), _set_columns, "doc_id long, n_shingles long, k1 long, k2 long, items array<long>")
    return made.join(wanted, ["doc_id", *DIGEST], "left_semi")


def near_groups(docs: DataFrame, scratch: Scratch, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = scratch.save(arrow_map(texts, _sketch_columns, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "sketches")
    made = _one_row_per_id(sketched, scratch)
    for digest in (DIGEST, [*DIGEST, "own"]):
        # Merge equal sets; the first of each class stands for it.
        classes = made.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        classes = scratch.save(classes, "classes")
        chosen = made.join(classes.select(F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n")), "doc_id")
        bands = scratch.save(chosen.select("doc_id", "n", F.explode("bands").alias("bucket")), "bands")
        buckets = scratch.save(bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
        held = scratch.save(bands.join(buckets, "bucket"), "held")
        scratch.drop("bands")
        wanted = scratch.save(held.groupBy("doc_id").agg((F.max("members") > SMALL_BUCKET).alias("crowded")), "wanted")
        # One pass over the texts for the sets of the candidates and of all members of classes, which are compared in full.
        members = made.join(classes.where("copies > 1"), digest).select("doc_id", *DIGEST)
        needed = scratch.save(members.union(made.join(wanted, "doc_id", "left_semi").select("doc_id", *DIGEST)).distinct(), "needed")
        full = _full_sets(texts, needed)
        full = scratch.save(full if made is sketched else full.dropDuplicates(["doc_id"]), "full")
        if len(digest) > len(DIGEST):
            break
        differ = full.groupBy(*DIGEST).agg(F.min("items").alias("low"), F.max("items").alias("high")).where("low <> high").select(*DIGEST)
        differ = scratch.save(differ, "differ")
        if differ.isEmpty():
            break
        # Different sets of one digest: each document of it stands for itself.
        apart = made.join(differ.withColumn("apart", F.lit(True)), DIGEST, "left")
        made = scratch.save(apart.withColumn("own", F.when(F.col("apart"), F.col("doc_id")).otherwise(F.lit(-1).cast("long"))).drop("apart"), "apart")
    sets = scratch.save(full.join(wanted, "doc_id", "left_semi").select("doc_id", "items"), "sets")
    scratch.drop("full", "needed")

    # Small buckets: every pair.
    few = held.where(F.col("members") <= SMALL_BUCKET).select("bucket", "doc_id", "n")
    pairs = (
        few.toDF("bucket", "a", "n_a").join(few.toDF("bucket", "b", "n_b"), "bucket").where((F.col("a") < F.col("b")) & _fits(threshold)).select("a", "b").distinct()
    )
    links = scratch.save(confirmed(pairs, sets, threshold), "links-small")

    # Crowded buckets: prefix lists, by stars; from the second on, around a member outside the list's main component.
    crowded = sets.join(wanted.where("crowded"), "doc_id")
    lists = scratch.save(_prefixes(crowded, scratch, threshold), "lists")
    member = lambda rows, x, by: rows.select(*by, F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"place_{x}"), F.col("component").alias(f"part_{x}"))
    open_lists, labelled = None, lists.withColumn("component", F.col("doc_id"))
    for turn in range(STARS + 1):
        away = labelled if open_lists is None else labelled.join(open_lists, "item").where("component <> main")
        if turn < STARS:
            first = F.min_by(F.struct("doc_id", "n", "place", "component"), F.struct("place", "doc_id"))
            centres = away.groupBy("item").agg(first.alias("c")).select("item", "c.*")
            away, others, by = scratch.save(centres, f"centres{turn}"), labelled, ["item"]
        else:
            (away, others), by = _cells(away, labelled, scratch, threshold), CELL
        met = member(away, "a", by).join(member(others, "b", by), by).where((F.col("part_a") != F.col("part_b")) & _fits(threshold) & _early(threshold))
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = links.union(scratch.save(confirmed(pairs, sets, threshold), f"links{turn}"))
        scratch.drop("away", "near", "blocks")
        found = connected_components(links, scratch, f"parts{turn}")
        labelled = scratch.save(lists.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), f"labelled{turn}")
        held_by = labelled.groupBy("item", "component").agg(F.count("*").alias("held"))
        main = held_by.groupBy("item").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.count("*").alias("parts"))
        open_lists = scratch.save(main.where("parts > 1").select("item", "main"), f"open{turn}")
        if open_lists.isEmpty():
            break

    # Back to all documents: set -> representative -> component.
    heads = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*digest, F.coalesce("component", "rep").alias("component_id"))
    heads = scratch.save(heads, "heads")
    scratch.drop("sets", "items", "among", "held", "lists", *[f"labelled{t}" for t in range(STARS + 1)])
    return (
        made.select("doc_id", *digest)
        .join(heads, digest, "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def near_dedup(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The rows of ``docs``, of linked ones only that with the smallest doc_id."""
    groups = near_groups(docs, Scratch(docs.sparkSession, "near"), threshold)
    return docs.join(groups.where("doc_id = component_id").select("doc_id").hint("merge"), "doc_id", "left_semi")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir), Scratch(spark, "op5"))
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


QUERIES = {"op5_minhash": op5_minhash}
ORACLE = {
    "op5_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS items FROM w
), n AS (SELECT doc_id, len(items)::BIGINT AS n_shingles FROM s
), e AS (SELECT doc_id, unnest(items) AS item FROM s
), rare AS (SELECT item FROM e GROUP BY item HAVING count(*) > 1
), sh AS (SELECT e.doc_id, e.item FROM e JOIN rare USING (item)
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM sh x JOIN sh y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_n >= 85 * (na.n_shingles + nb.n_shingles - both_n)
), g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.doc_id WHERE r.c < g.b
)
SELECT n.doc_id, n.n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n_shingles
"""
}
