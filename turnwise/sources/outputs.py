"""Sinks: session documents, review packets, tables, run folders and content-keyed caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Utterances of one part of a session document; longer sources come in several parts.
PART_ROWS = 500


def compact_json(record: Column) -> Column:
    """JSON of a struct without null fields."""
    return F.to_json(record, {"ignoreNullFields": "true"})


def session_json(sources: DataFrame, utterances: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(audio_source_id, part_no, document): nested documents of sources and their utterances, in parts of bounded size."""
    from turnwise.operators.ordering import grouped_running

    known = utterances.filter("start_seconds is not null")
    rows = grouped_running(known, ["audio_source_id"], ["start_seconds", "utterance_id"], name="n").withColumn("part_no", F.floor((F.col("n") - 1) / part_rows))
    entry = F.struct("n", "utterance_id", "text", "start_seconds", "end_seconds", "speaker_id")
    parts = rows.groupBy("audio_source_id", "part_no").agg(F.array_sort(F.collect_list(entry)).alias("utterances"))
    joined = sources.join(parts, "audio_source_id", "left")
    document = compact_json(F.struct("session_id", "audio_source_id", "original_path", "duration_seconds", "utterances"))
    return joined.select("audio_source_id", F.coalesce("part_no", F.lit(0)).alias("part_no"), document.alias("document"))


def write_session_json(documents: DataFrame, path: str) -> None:
    """One folder per source, one line per part; never overwrites."""
    documents.sortWithinPartitions("audio_source_id", "part_no").select("audio_source_id", "document").write.partitionBy("audio_source_id").mode("errorifexists").text(path)


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """The sheets of a workbook as tables, one folder each."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def packet_lines(title: str, facts: Mapping[str, object], timing: DataFrame, candidates: DataFrame, limit: int = 200) -> str:
    """Markdown review packet over a report's few rows. More than `limit` candidates are an error, not cut."""
    head = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()], "", "## Timing", "", "| stage | status | seconds |", "|-|-|-|"]
    head += [f"| {r['stage_name']} | {r['status']} | {r['duration_seconds'] or 0:.2f} |" for r in timing.orderBy("ordinal").limit(limit + 1).collect()]
    rows = candidates.orderBy("qa_candidate_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a packet holds one run's candidates; split the run")
    for r in rows:
        head += ["", f"## {r['qa_candidate_id']}", "", f"**Q** {r['question_text'] or ''}", "", f"**A** {r['answer_text'] or ''}"]
    return "\n".join(head) + "\n"


def comparison_markdown(title: str, runs: DataFrame, rankings: DataFrame, limit: int = 500) -> str:
    """Markdown comparison of runs: one table of the runs, one list a ranking. More than `limit` rows are an error.

    `runs` has (run_id, ...), `rankings` (ranking, place, run_id, value).
    """
    columns = runs.columns
    rows = runs.orderBy("run_id").limit(limit + 1).collect()
    placed = rankings.orderBy("ranking", "place").limit(limit + 1).collect()
    if max(len(rows), len(placed)) > limit:
        raise ValueError("a comparison holds the runs of one evaluation; split it")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    out = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows]]
    for name in sorted({r["ranking"] for r in placed}):
        out += ["", f"## {name}", "", *[f"{r['place']}. {r['run_id']} ({show(r['value'])})" for r in placed if r["ranking"] == name]]
    return "\n".join(out) + "\n"


def write_comparison(title: str, runs: DataFrame, rankings: DataFrame, path: str) -> None:
    """comparison/runs and comparison/rankings as JSON lines, and comparison/markdown as one text; never overwrites."""
    text = comparison_markdown(title, runs, rankings)
    runs.write.mode("errorifexists").json(f"{path}/runs")
    rankings.write.mode("errorifexists").json(f"{path}/rankings")
    runs.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/markdown")


def run_folder(spark: SparkSession, root: str, label: str) -> str:
    """A folder for a run's outputs under `root` that does not exist yet: the label, or with `_2`, `_3`, ... behind it."""
    jvm = spark.sparkContext._jvm
    for k in range(1, 10_000):
        path = f"{root}/{label}" + (f"_{k}" if k > 1 else "")
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileExistsError(label)


def cache_key(config: Mapping[str, object], content_digest: str) -> str:
    """Key of a cached stage: digest of the input's content and of the configuration that shapes the result."""
    canonical = json.dumps(config, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(f"{content_digest}\n{canonical}".encode()).hexdigest()[:24]


def content_digest(df: DataFrame) -> str:
    """Order-free digest of a table's rows."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    row = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftrightunsigned("h", 20)).alias("s")).first()
    return hashlib.sha256(f"{df.schema.json()}|{row['n']}|{row['x']}|{row['s']}".encode()).hexdigest()


def cached(df: DataFrame, build, root: str, stage: str, config: Mapping[str, object]) -> tuple[DataFrame, bool]:
    """`build(df)` written under its key, or read from there; the second value tells whether it was reused."""
    spark = df.sparkSession
    path = f"{root}/{stage}/{cache_key(config, content_digest(df))}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    hit = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if not hit:
        build(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), hit
