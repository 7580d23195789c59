"""Registered people: centroids of their embeddings, the nearest one to a face, and the vote over a segment."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from lessonlens.functions.numeric import drawn
from lessonlens.functions.pose import unit_vector
from lessonlens.session import cut_lineage

THRESHOLD = 0.5
MIN_MATCHES = 2
MIN_RATIO = 0.5
BLOCK_PEOPLE = 2_000
BLOCK_FACES = 50_000
# Most centres of blocks: the only vectors that travel with every task.
MOST_CENTRES = 256


def centroids(faces: DataFrame) -> DataFrame:
    """Mean embedding per name, scaled to length 1."""
    mean = Summarizer.mean(array_to_vector(F.col("emb").cast("array<double>")))
    return faces.groupBy("name").agg(vector_to_array(mean).alias("m")).select("name", unit_vector(F.col("m")).alias("emb"))


@dataclass(frozen=True)
class Blocks:
    """People around centres: unit vectors of the centres, per centre the largest angle to one of its people and its number of
    parts, and the people with their centre and part."""

    centres: list[list[float]]
    radius: list[float]
    parts: list[int]
    people: DataFrame


def people_blocks(people: DataFrame, block_people: int = BLOCK_PEOPLE) -> Blocks | None:
    """People dealt to the nearest of a few of them, chosen by a hash of their names; None without people."""
    n = people.count()
    if not n:
        return None
    wanted = min(MOST_CENTRES, max(1, -(-n // block_people)))
    centres = _unit([r.emb for r in people.orderBy(drawn(F.col("name"), 0), "name").limit(wanted).collect()])

    def home(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                near = _unit(batch.column(1).to_pylist()) @ np.array(centres).T
                at = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(at)), at], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(angle)], names=["name", "emb", "centre", "angle"])

    source = people.select("name", F.col("emb").cast("array<double>").alias("emb"))
    placed = cut_lineage(source.mapInArrow(home, T.StructType([*source.schema.fields, T.StructField("centre", T.LongType()), T.StructField("angle", T.DoubleType())])))
    facts = {r.centre: r for r in placed.groupBy("centre").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    parts = [-(-facts[k].n // block_people) if k in facts else 0 for k in range(len(centres))]
    split = F.pmod(F.xxhash64("name"), F.element_at(F.array(*[F.lit(max(1, x)) for x in parts]), (F.col("centre") + 1).cast("int")))
    return Blocks(centres, [facts[k].radius if k in facts else 0.0 for k in range(len(centres))], parts, placed.withColumn("part", split))


def _unit(vectors) -> "object":
    import numpy as np
    matrix = np.stack([np.asarray(e, dtype=float) for e in vectors])
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def visited_blocks(faces: DataFrame, blocks: Blocks) -> DataFrame:
    """``face_id, emb`` and ``centres``: the blocks that may hold the person most similar to the face.

    The angle to a person is at least the angle to the centre less the block's radius, and the nearest centre is a person too; a
    block whose bound is below that person's similarity is passed over.
    """
    centres, radius = blocks.centres, blocks.radius

    def bound(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                cosine = np.clip(_unit(batch.column(1).to_pylist()) @ np.array(centres).T, -1.0, 1.0)
                most = np.cos(np.maximum(np.arccos(cosine) - np.array(radius), 0.0))
                stay = most >= cosine.max(axis=1, keepdims=True) - 1e-9
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([np.flatnonzero(row).tolist() for row in stay], pa.list_(pa.int64()))], names=["face_id", "emb", "centres"])

    source = faces.select("face_id", F.col("emb").cast("array<double>").alias("emb"))
    return source.mapInArrow(bound, T.StructType([*source.schema.fields, T.StructField("centres", T.ArrayType(T.LongType()))]))


def nearest_identity(
    faces: DataFrame, people: DataFrame, threshold: float = THRESHOLD, block_people: int = BLOCK_PEOPLE, block_faces: int = BLOCK_FACES,
) -> DataFrame:
    """Add ``matched_name`` (NULL below the threshold) and ``similarity`` of the person most similar to ``emb``.

    ``faces`` needs a unique ``face_id``. People lie in blocks around centres, a large block in several parts; a face goes to the
    blocks that its angles to the centres leave open, and its best answers are combined, the first name on ties. No task holds
    more than a part of a block and as many faces.
    """
    blocks = people_blocks(people, block_people)
    if blocks is None:
        return faces.withColumns({"matched_name": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")})
    shares = max(1, -(-faces.count() // block_faces))
    cell = ["share", "centre", "part"]
    last = F.element_at(F.array(*[F.lit(x - 1) for x in blocks.parts]), (F.col("centre") + 1).cast("int"))
    left = visited_blocks(faces, blocks).withColumn("share", F.pmod(F.xxhash64("face_id"), F.lit(shares)))
    left = left.withColumn("centre", F.explode("centres")).drop("centres").where(last >= 0)
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    right = blocks.people.select("name", "emb", "centre", F.col("part").cast("bigint").alias("part"))
    right = right.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))))

    kind = dict(faces.dtypes)["face_id"]

    def best(face, person):
        import numpy as np
        import pyarrow as pa
        ids = face.column("face_id").combine_chunks() if face.num_rows else face.column("face_id")
        if not face.num_rows or not person.num_rows:
            return pa.table({"face_id": pa.array([], ids.type), "similarity": pa.array([], pa.float64()), "best_name": pa.array([], pa.string())})
        person = person.sort_by("name")
        scores = np.array(face.column("emb").to_pylist(), float) @ _unit(person.column("emb").to_pylist()).T
        at = scores.argmax(axis=1)
        names = person.column("name").combine_chunks().take(pa.array(at))
        return pa.table({"face_id": ids, "similarity": pa.array(scores[np.arange(len(at)), at]), "best_name": names.cast(pa.string())})

    partial = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        best, f"face_id {kind}, similarity double, best_name string")
    top = partial.groupBy("face_id").agg(F.max("similarity").alias("similarity"), F.min_by(
        "best_name", F.struct(-F.col("similarity"), "best_name")).alias("best_name"))
    named = F.when(F.col("similarity") >= F.lit(threshold), F.col("best_name"))
    return faces.join(top, "face_id").withColumn("matched_name", named).select(*faces.columns, "similarity", "matched_name")


def face_votes(
    matches: DataFrame, keys: Sequence[str], order: str, min_matches: int = MIN_MATCHES, min_ratio: float = MIN_RATIO,
) -> DataFrame:
    """Per segment: the name matched most often (the first seen on ties), its count and its share of all frames.

    Frames without a match count in the share.
    """
    names = matches.groupBy(*keys, "matched_name").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("first"))
    known = F.col("matched_name").isNotNull()
    best = F.max_by(F.struct("matched_name", "c"), F.when(known, F.struct(F.col("c"), -F.col("first"))))
    out = names.groupBy(*keys).agg(best.alias("b"), F.sum("c").alias("frames"))
    count = F.coalesce(F.col("b.c"), F.lit(0))
    ratio = count / F.col("frames")
    return out.select(
        *keys, F.col("b.matched_name").alias("name"), count.alias("matches"), ratio.alias("ratio"),
        ((count >= min_matches) & (count > 0) & (ratio >= min_ratio)).alias("excluded"))


# The functions above travel with the tasks, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
