"""Text search by an inverted index of trigrams, with the results of a scan.

The store holds the searchable rows under a row number, and for every trigram
(three characters of a lower-cased field, padded at its end) and block of rows
the places that hold it. A search joins the posting lists of its pattern's
rarest trigrams block by block, fetches the rows that are left and lets LIKE
decide; it reads the postings of those trigrams and the parts of the rows that
candidates lie in. A list is cut by blocks of rows, so a trigram that every
row holds is many bounded rows, dealt to many tasks.
"""

from __future__ import annotations

import re
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.plans import serving

# functions of tasks are shipped by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: a block is 2**BLOCK_BITS consecutive row numbers
BLOCK_BITS = 16
#: row numbers begin anew every 2**33 in each writing task; 2**PART_BITS tasks make a part (a folder) of the rows
PART_BITS = 4
#: folders of the postings, by the first two characters of the trigram
BUCKETS = 64
#: posting lists that a search joins: those of its rarest trigrams
JOINED = 4
#: searched fields, and characters of them whose trigrams a task holds at a time
FIELDS = ("objet", "groupe", "nom_entreprise")
CHARS = 1 << 20
PAD = "\u0000\u0000"
ROWS = ("marche_id string, groupe string, siret string, nom_entreprise string, montant_eur double, annee string, code_cpv string, "
        "objet string, acheteur_siret string, row_id long, part long")
POSTINGS = "trigram string, block long, places array<int>, bucket int"
COUNTS = "trigram string, n long, bucket int"
# places are never null here: that lets Spark sort them as plain integers
LISTS = T.StructType([T.StructField("trigram", T.StringType()), T.StructField("block", T.LongType()),
                      T.StructField("places", T.ArrayType(T.IntegerType(), containsNull=False))])


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(gram, F.lit(2))), F.lit(BUCKETS)).cast("int")


def _places(batches):
    """Rows (block, place, lower-cased fields) in batches -> (trigram, block, places): for every trigram of a field
    the rows of a block that hold it, each once. The last two characters of a field begin padded trigrams; a null or
    empty field has none. A block's rows may come in several lists; those of CHARS characters are held at a time."""
    held, chars = [], 0
    for batch in batches:
        for fields in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            held.append(fields)
            chars += sum(len(t) for t in fields[2:] if t)
            if chars >= CHARS:
                yield from _lists(held)
                held, chars = [], 0
    if held:
        yield from _lists(held)


def _different(numbers: np.ndarray) -> np.ndarray:
    """The different ones of some numbers, sorted."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([numbers[:1] == numbers[:1], numbers[1:] != numbers[:-1]])]


def _lists(rows: list[tuple]):
    """The posting lists of some rows, a batch per block. A trigram is three code points of 21 bits in an integer."""
    by_block: dict[int, tuple[list, list]] = {}
    for block, place, *fields in rows:
        places, texts = by_block.setdefault(block, ([], []))
        for text in fields:
            if text:
                places.append(place)
                texts.append(text)
    for block, (places, texts) in by_block.items():
        if not texts:
            continue
        points = np.frombuffer((PAD.join(texts) + PAD).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(PAD)
        begins = np.ones(len(points), bool)
        ends = np.cumsum(sizes)
        begins[ends - 1] = begins[ends - 2] = False  # the padding itself begins none
        grams = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[begins[:-2]]
        known = _different(grams)
        # (trigram, place) as one number: a place has at most 32 bits
        pairs = _different(np.searchsorted(known, grams) << 32 | np.repeat(np.array(places, np.int64), sizes - len(PAD)))
        starts = np.searchsorted(pairs >> 32, np.arange(len(known) + 1)).astype(np.int32)
        names = np.stack([known >> 42, known >> 21 & 0x1FFFFF, known & 0x1FFFFF], axis=1).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([
            pa.array([names[i:i + 12].decode("utf-32-le") for i in range(0, len(names), 12)], pa.string()),
            pa.array(np.full(len(known), block), pa.int64()),
            pa.ListArray.from_arrays(pa.array(starts), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))], ["trigram", "block", "places"])


def write_index(stg_titulaires: DataFrame, path: str) -> None:
    """Write rows, postings and counts below ``path``.

    The rows are written first and read back: their numbers are those of the
    writing tasks, which only a written table keeps."""
    spark = stg_titulaires.sparkSession
    rows = (stg_titulaires.filter(~F.col("flag_montant_suspect"))
            .select("marche_id", "groupe", "siret", "nom_entreprise", "montant_eur", "annee", "code_cpv", "objet", "acheteur_siret")
            .withColumn("row_id", F.monotonically_increasing_id())
            .withColumn("part", F.shiftright("row_id", 33 + PART_BITS)))
    rows.write.partitionBy("part").parquet(f"{path}/rows")
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    texts = [F.lower(F.col(c).cast("string")).alias(c) for c in FIELDS]
    lists = (rows.select(F.shiftright("row_id", BLOCK_BITS).alias("block"),
                         F.col("row_id").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("place"), *texts)
             .mapInArrow(_places, LISTS)
             .withColumn("bucket", _bucket(F.col("trigram"))).withColumn("part", F.shiftright("block", 33 + PART_BITS - BLOCK_BITS)))
    # a folder's lists of a part of the rows meet in one task, where those of one block are joined: a block's rows at most
    postings = (lists.repartition("bucket", "part").groupBy("bucket", "part", "trigram", "block")
                .agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
                .select("trigram", "block", "places", F.size("places").cast("long").alias("n"), "bucket"))
    (postings.sortWithinPartitions("bucket", "trigram", "block")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    written = spark.read.schema(COUNTS).parquet(f"{path}/postings")
    (written.groupBy("bucket", "trigram").agg(F.sum("n").alias("n"))
     .repartition("bucket").sortWithinPartitions("bucket", "trigram")
     .write.partitionBy("bucket").parquet(f"{path}/counts"))


def needed(pattern: str) -> tuple[list[str], list[str]]:
    """(trigrams, pairs of characters) that every text like ``pattern`` (lower-cased, '%' and '_' as wildcards) holds."""
    runs = [r for r in re.split("[%_]", pattern) if r]
    three = {r[i:i + 3] for r in runs for i in range(len(r) - 2)}
    return sorted(three), sorted(r for r in set(runs) if len(r) == 2)


def _of(table: DataFrame, grams: list[str]) -> DataFrame:
    """The rows of ``table`` for some trigrams: a few folders, and the pages of the files that hold them."""
    return table.filter(F.col("bucket").isin([_bucket(F.lit(g)) for g in grams]) & F.col("trigram").isin(grams))


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """row_id of all rows that may be like ``pattern``; None if it tells nothing about them."""
    grams, pairs = needed(pattern)
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    if grams:
        # at most one row per trigram of the pattern reaches the driver
        found = _of(spark.read.schema(COUNTS).parquet(f"{path}/counts"), grams).select("trigram", "n").collect()
        rare = [r["trigram"] for r in sorted(found, key=lambda r: (r["n"], r["trigram"]))][:JOINED]
        if len(found) < len(grams):
            rare = []
        lists = [_of(postings, [g]).select("block", F.col("places").alias(f"places_{k}")) for k, g in enumerate(rare)]
        if not lists:
            return spark.createDataFrame([], "row_id long")
        both = reduce(lambda a, b: a.join(b, "block"), lists)
        common = reduce(F.array_intersect, [F.col(f"places_{k}") for k in range(len(lists))])
        hits = both.select("block", F.explode(common).alias("place"))
    elif pairs:
        hits = postings.filter((F.col("bucket") == _bucket(F.lit(pairs[0]))) & F.col("trigram").startswith(pairs[0]))
        hits = hits.select("block", F.explode("places").alias("place")).distinct()
    else:
        return None
    return hits.select((F.shiftleft("block", BLOCK_BITS) + F.col("place")).alias("row_id"))


def search(spark: SparkSession, path: str, q: str, limit: int = 20) -> DataFrame:
    """``serving.search`` over the index written to ``path``."""
    serving.check_search(q, limit)
    # lower-cased as a whole, as LIKE has it: a character may depend on its neighbours
    pattern = spark.sql("SELECT lower(:q)", args={"q": f"%{q}%"}).first()[0]
    rows, hits = spark.read.schema(ROWS).parquet(f"{path}/rows"), candidates(spark, path, pattern)
    if hits is not None:
        hits = hits.withColumn("part", F.shiftright("row_id", 33 + PART_BITS))
        rows = rows.join(hits, ["part", "row_id"], "left_semi")
    return serving.search_result(rows.filter(serving.search_hit(q)), limit)
