"""Semantic search over embeddings, responsiveness and voice checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.lexical import clamp
from turnwise.operators.joins import keyed_join
from turnwise.session import staged

#: Rows of a block of queries or passages: two blocks are compared as one matrix product.
BLOCK_ROWS = 2_000
#: Vectors that an index is fitted on, and its lists, at most.
INDEX_FIT, INDEX_LISTS = 20_000, 4_096
SAME_VOICE, DIFFERENT_VOICE = 0.72, 0.45
PENALTY_FULL, PENALTY_MOST, VOICE_BONUS = 0.85, 0.25, 0.04


def cosine_top(queries: DataFrame, passages: DataFrame, query_id: str, passage_id: str, vector: str, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, passage_id, similarity, place): the `k` most similar passages of every query, exactly.

    Both sides are cut into blocks of bounded size; every pair of blocks is one task's matrix product that keeps `k`
    rows per query, and the blocks' results are merged. Zero and null vectors are similar to nothing; ties go to the
    smaller id. A query does not find itself where both ids are of one table and equal.
    """
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector).alias("v"))
    p = passages.filter(F.col(vector).isNotNull()).select(F.col(passage_id).alias("p"), F.col(vector).alias("v"))
    nq, np_ = max(1, -(-q.count() // BLOCK_ROWS)), max(1, -(-p.count() // BLOCK_ROWS))
    q = q.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(nq))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1)))).withColumn("pb", F.col("pb").cast("bigint"))
    p = p.withColumn("pb", F.pmod(F.xxhash64("p"), F.lit(np_))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("qb", F.col("qb").cast("bigint"))

    def unit(rows: pa.Table) -> np.ndarray:
        m = np.array(rows.column("v").to_pylist(), np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    kind = pa.schema([("q", pa.int64()), ("p", pa.int64()), ("similarity", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        qi, pi = np.array(left.column("q").to_pylist()), np.array(right.column("p").to_pylist())
        order = np.argsort(pi)
        pi = pi[order]
        sims = unit(left) @ unit(right)[order].T
        sims[qi[:, None] == pi[None, :]] = -2.0
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(qi)), top.shape[1])
        flat = sims[rows, top.ravel()]
        keep = flat >= least
        return pa.table({"q": qi[rows][keep], "p": pi[top.ravel()][keep], "similarity": flat[keep]}, schema=kind)

    pairs = q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInArrow(best, "q bigint, p bigint, similarity double")
    order = Window.partitionBy("q").orderBy(F.col("similarity").desc(), "p")
    out = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return out.select(F.col("q").alias(query_id), F.col("p").alias(passage_id if passage_id != query_id else f"found_{passage_id}"), "similarity", "place")


def responsiveness(similarity: Column, continuation: Column) -> Column:
    """Score from question-answer similarity less penalties for echoing the question and running on.

    An answer nearly equal to its question is an echo; one closer to its continuation than to the question runs on.
    """
    echo = F.when(similarity >= 0.92, 0.24).when(similarity >= 0.85, 0.14).otherwise(0.0)
    margin = F.coalesce(continuation, F.lit(-1.0)) - similarity
    return clamp(0.18 + 0.82 * similarity - echo - F.when(margin >= 0.25, 0.22).when(margin >= 0.12, 0.12).otherwise(0.0))


def voice_check(df: DataFrame, similarity: Column, question_seconds: Column, answer_seconds: Column, overlap: Column) -> DataFrame:
    """Adds `voice`, `voice_penalty` and `voice_bonus` of a question and its answer.

    Spans that overlap or are shorter than 1.5 s are not compared. The penalty of a same voice rises linearly from
    SAME_VOICE to PENALTY_FULL.
    """
    usable = similarity.isNotNull() & ~F.coalesce(overlap, F.lit(False)) & (question_seconds >= 1.5) & (answer_seconds >= 1.5)
    voice = F.when(~F.coalesce(usable, F.lit(False)), "skipped").when(similarity >= SAME_VOICE, "same").when(similarity <= DIFFERENT_VOICE, "different").otherwise("unclear")
    ramp = F.least(F.lit(1.0), (similarity - SAME_VOICE) / (PENALTY_FULL - SAME_VOICE)) * PENALTY_MOST
    out = df.withColumn("voice", voice)
    return out.withColumn("voice_penalty", F.when(F.col("voice") == "same", ramp).otherwise(0.0)).withColumn("voice_bonus", F.when(F.col("voice") == "different", VOICE_BONUS).otherwise(0.0))


def rescued(df: DataFrame, session: str, order: str, eligible: Column, most_checks: int = 40, most_rescues: int = 8, checked: Column | None = None) -> DataFrame:
    """Adds `rescued`: eligible suppressed pairs in order, as long as the session's checks and rescues last.

    Only pairs in `checked` (by default the eligible ones) cost a check; `eligible` ones are among them.
    """
    kept = [c for c in df.columns]
    rows = df.withColumn("_e", F.coalesce(eligible, F.lit(False))).withColumn("_k", F.coalesce(eligible if checked is None else checked, F.lit(False)))
    # the first checks of a session are few, and the limit is applied before the shuffle too, so a hot session stays small
    first = rows.filter("_k").select(session, order, "_e").withColumn("_c", F.row_number().over(Window.partitionBy(session).orderBy(order))).filter(F.col("_c") <= most_checks)
    seen = Window.partitionBy(session).orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    won = first.withColumn("_r", F.sum(F.col("_e").cast("int")).over(seen)).filter(F.col("_e") & (F.col("_r") <= most_rescues)).select(session, order, F.lit(True).alias("_won"))
    return keyed_join(rows, won, [session, order], "left").select(*kept, F.coalesce("_won", F.lit(False)).alias("rescued"))


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def fit_lists(vectors: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of `lists` groups of unit vectors, by spherical k-means."""
    v = _unit(np.asarray(vectors, np.float64))
    rng = np.random.default_rng(seed)
    centres = v[rng.permutation(len(v))[:lists]]
    for _ in range(rounds):
        near = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        empty = ~np.isin(np.arange(len(centres)), near)
        sums[empty] = centres[empty]
        centres = _unit(sums)
    return centres


def indexed_top(queries: DataFrame, passages: DataFrame, query_id: str, passage_id: str, vector: str, k: int, least: float = -1.0, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, passage_id, similarity, place) as `cosine_top` gives it, from an inverted-file index.

    Centres are fitted on at most INDEX_FIT vectors, drawn by a hash of the id; every passage then goes to the list of
    its nearest centre and every query meets its `probes` nearest lists only, where similarities are exact. By default
    there are about as many lists as the root of the passages, at most INDEX_LISTS, and an eighth of them, at least 8,
    are probed. Lists over BLOCK_ROWS are cut into blocks, so no list is one task. Recall against `cosine_top` is
    measured in the tests. Ties go to the smaller id; null and zero vectors are similar to nothing.
    """
    p = passages.filter(F.col(vector).isNotNull()).select(F.col(passage_id).alias("p"), F.col(vector).alias("v"))
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector).alias("v"))
    n = p.count()
    kind = "q bigint, p bigint, similarity double"
    if not n:
        return q.sparkSession.createDataFrame([], kind + ", place int").select(F.col("q").alias(query_id), F.col("p").alias(passage_id if passage_id != query_id else f"found_{passage_id}"), "similarity", "place")
    lists = min(INDEX_LISTS, max(1, int(n**0.5))) if lists is None else lists
    probes = min(lists, max(8, lists // 8)) if probes is None else min(probes, lists)
    share = F.pmod(F.xxhash64("p"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * INDEX_FIT / n))
    sample = p.filter(share).orderBy(F.xxhash64("p")).limit(INDEX_FIT).select("v").toPandas()["v"]  # the bound of the fit
    centres = fit_lists(np.stack(list(sample)), min(lists, len(sample)))
    shared = p.sparkSession.sparkContext.broadcast(centres.astype(np.float32))  # INDEX_LISTS vectors at most

    def near(many: int):
        def run(batches):
            for b in batches:
                c = shared.value
                v = _unit(np.array(b.column("v").to_pylist(), np.float32)) if b.num_rows else np.zeros((0, c.shape[1]), np.float32)
                m = min(many, len(c))
                score = v @ c.T
                top = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (len(v), 1))
                rows = np.repeat(np.arange(len(v)), m)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column("v").take(pa.array(rows)), pa.array(top.ravel().astype(np.int32))], names=[b.schema.names[0], "v", "l"])

        return run

    typed = p.schema["v"].dataType.simpleString()
    held = staged(p.mapInArrow(near(1), f"p {p.schema['p'].dataType.simpleString()}, v {typed}, l int"))
    sizes = held.groupBy("l").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK_ROWS).cast("bigint")).select("l", "blocks")
    held = held.join(F.broadcast(sizes), "l").withColumn("b", F.pmod(F.xxhash64("p"), F.col("blocks")))  # a row a list
    asked = q.mapInArrow(near(probes), f"q {q.schema['q'].dataType.simpleString()}, v {typed}, l int").join(F.broadcast(sizes), "l")
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    out_schema = pa.schema([("q", pa.int64()), ("p", pa.int64()), ("similarity", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        a, b = (_unit(np.array(t.column("v").to_pylist(), np.float64)) for t in (left, right))
        qi, pi = left.column("q").to_numpy().astype(np.int64), right.column("p").to_numpy().astype(np.int64)
        order = np.argsort(pi)
        pi, b = pi[order], b[order]
        s = a @ b.T
        s[qi[:, None] == pi[None, :]] = -np.inf
        m = min(k, len(pi))
        top = np.argsort(-s, axis=1, kind="stable")[:, :m]
        rows = np.repeat(np.arange(len(qi)), m)
        flat = s[rows, top.ravel()]
        keep = np.isfinite(flat) & (flat >= least)
        return pa.table({"q": qi[rows][keep], "p": pi[top.ravel()][keep], "similarity": flat[keep]}, schema=out_schema)

    pairs = asked.select("q", "v", "l", "b").groupBy("l", "b").cogroup(held.select("p", "v", "l", "b").groupBy("l", "b")).applyInArrow(best, kind)
    order = Window.partitionBy("q").orderBy(F.col("similarity").desc(), "p")
    out = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return out.select(F.col("q").alias(query_id), F.col("p").alias(passage_id if passage_id != query_id else f"found_{passage_id}"), "similarity", "place")
