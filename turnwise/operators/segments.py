"""Topic segments of a source's units: structural, windowed and adaptive.

Limits count from a segment's own start, so each mode is a fold over the ordered units. Silences longer than
`HARD_GAP` always close a structural segment; they cut a source into stretches that are folded in parallel. Windows and
adaptive segments run on over silences, so each source is one stretch there. The folds stream through sorted partitions
and hold one open segment at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import lexical as lx
from turnwise.operators.ordering import grouped_running, windowed
from turnwise.session import staged

SOFT_GAP, HARD_GAP = 2.0, 7.0
MAX_SECONDS, MAX_TEXT = 90.0, 800
WINDOW_SECONDS, WINDOW_OVERLAP, WINDOW_MIN_UNITS = 60.0, 0.0, 1
TARGET_SECONDS, TARGET_TEXT, LIMIT_SECONDS, LIMIT_TEXT = 55.0, 650, 85.0, 950
LOOKBACK, LEAST_SCORE = 4, 1.5
MIN_WORDS, MIN_TEXT = 4, 20

Unit = tuple[str, str, float, float, str]  # source, id, start, end, text


def _words(text: str) -> list[str]:
    return [w for w in ("".join(c for c in x if c.isalnum() or c == "'").lower() for x in text.split()) if w]


def looks_incomplete(text: str) -> bool:
    return text.rstrip()[-1:] not in (".", "?", "!")


def is_weak(text: str) -> bool:
    return len(text.strip()) < MIN_TEXT or len(_words(text)) < MIN_WORDS


def ends_open(text: str) -> bool:
    return bool(w := _words(text)) and w[-1] in lx.CONTINUATION_MARKERS


def starts_open(text: str) -> bool:
    return bool(w := _words(text)) and w[0] in lx.CONTINUATION_MARKERS


def starts_lower(text: str) -> bool:
    return text.lstrip()[:1].islower()


def continues(current: str, following: str) -> bool:
    """Whether the wording goes on over a silence: an incomplete end, and one more sign at least."""
    incomplete = looks_incomplete(current) + ends_open(current)
    return incomplete > 0 and incomplete + is_weak(current) + is_weak(following) + starts_lower(following) + starts_open(following) >= 2


def structural(units: Iterable[Unit]) -> Iterator[tuple[list[Unit], str]]:
    """Segments of one source's units with the reason why each was closed."""
    open_: list[Unit] = []
    length, reach = 0, 0.0
    for u in units:
        if open_:
            gap = u[2] - reach
            text = " ".join(x[4] for x in open_[-2:])
            reason = (
                "max_duration" if max(reach, u[3]) - open_[0][2] > MAX_SECONDS
                else "max_text_length" if length + 1 + len(u[4]) > MAX_TEXT
                else "gap" if gap > SOFT_GAP and not (gap <= HARD_GAP and continues(text, u[4]))
                else None
            )
            if reason:
                yield open_, reason
                open_, length = [], 0
        length += len(u[4]) + (1 if open_ else 0)
        reach = max(reach, u[3]) if open_ else u[3]
        open_.append(u)
    if open_:
        yield open_, "end"


def windows(units: Iterable[Unit], seconds: float = WINDOW_SECONDS, overlap: float = WINDOW_OVERLAP, least: int = WINDOW_MIN_UNITS) -> Iterator[tuple[list[Unit], str]]:
    """Windows anchored at a unit's start; the next anchor is the first unit `seconds - overlap` later."""
    rest = iter(units)
    held = list(islice(rest, 1))
    while held:
        n, anchor = 0, held[0][2]
        while True:
            if n == len(held):
                held += islice(rest, 1)
            if n == len(held) or (n >= least and held[n][2] >= anchor + seconds):
                break
            n += 1
        yield held[:n], "window"
        if n == len(held):
            return
        held = held[next((k for k in range(1, n) if held[k][2] >= anchor + (seconds - overlap)), n) :]


def boundary_score(text: str, last: Unit, following: Unit | None) -> float:
    """How well a segment with this text ends before the following unit."""
    strong = not looks_incomplete(text)
    score = (2.0 if strong else 0.5) + (-0.5 if is_weak(text) else 0.75) + (1.0 if strong else -1.0)
    score -= 1.25 * ends_open(text) + 0.5 * is_weak(last[4])
    if following is not None:
        gap = following[2] - last[3]
        score += 0.5 if gap >= 0.35 else -0.25 if gap <= 0.15 else 0.0
        first = _words(following[4])[:1]
        score += 1.0 * bool(first and first[0] in lx.TRANSITION_MARKERS) - 1.0 * starts_open(following[4]) - 0.35 * starts_lower(following[4])
    return score


def adaptive(units: Iterable[Unit]) -> Iterator[tuple[list[Unit], str]]:
    """Segments that end at the best of the last few units once a target is reached, and at any rate at a limit."""
    rest = iter(units)
    held = list(islice(rest, 1))
    while held:
        j, length = 0, 0
        while True:
            if j + 1 == len(held):
                held += islice(rest, 1)  # the unit behind j tells how well a segment ends at j
            length += len(held[j][4]) + (1 if j else 0)
            seconds = held[j][3] - held[0][2]
            limit = "duration" if seconds >= LIMIT_SECONDS else "text" if length >= LIMIT_TEXT else None
            if limit or seconds >= TARGET_SECONDS or length >= TARGET_TEXT:
                ends = range(max(0, j - LOOKBACK + 1), j + 1)
                scored = [(boundary_score(" ".join(u[4] for u in held[: e + 1]), held[e], held[e + 1] if e + 1 < len(held) else None), e) for e in ends]
                best = max(scored, key=lambda x: (x[0], x[1]))
                if best[0] >= LEAST_SCORE or limit:
                    yield held[: best[1] + 1], "adaptive_boundary" if best[0] >= LEAST_SCORE else f"adaptive_hard_max_{limit}"
                    held = held[best[1] + 1 :]
                    break
            if j + 1 == len(held):
                yield held, "end"
                return
            j += 1


def without_weak_singletons(segments: Iterable[tuple[list[Unit], str]]) -> Iterator[tuple[list[Unit], str]]:
    """Segments in which a single weak unit joins the segment before it or, at the start, the one behind it."""
    held: tuple[list[Unit], str] | None = None
    first_weak: list[Unit] = []
    for units, reason in segments:
        weak = len(units) == 1 and is_weak(units[0][4])
        if held is None:
            if weak and not first_weak:
                first_weak = units
                continue
            held, first_weak = (first_weak + units, reason), []
        elif weak:
            held = (held[0] + units, reason)
        else:
            yield held
            held = (units, reason)
    if held is not None:
        yield held
    elif first_weak:
        yield first_weak, "end"


MODES: dict[str, Callable[[Iterable[Unit]], Iterator[tuple[list[Unit], str]]]] = {"structural": structural, "windowed": windows, "adaptive": adaptive}

_OUT = pa.schema(
    [("source", pa.string()), ("stretch", pa.int64()), ("segment_no", pa.int32()), ("start_seconds", pa.float64()), ("end_seconds", pa.float64()), ("units", pa.int32()), ("first_unit", pa.string()),
     ("last_unit", pa.string()), ("text_length", pa.int32()), ("closing_reason", pa.string())]
)
_OUT_DDL = "source string, stretch bigint, segment_no int, start_seconds double, end_seconds double, units int, first_unit string, last_unit string, text_length int, closing_reason string"


def _folded(mode: str, keep_singletons: bool):
    def fold(units: Iterable[tuple]) -> Iterator[tuple[list[tuple], str]]:
        own = (x for x in MODES[mode](units) if not x[0][0][6])  # the unit behind a silence only closes the segment before it
        return own if keep_singletons else without_weak_singletons(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(7))))
        out: list[tuple] = []
        for (source, stretch), units in groupby(rows, key=lambda r: (r[0], r[5])):
            for k, (seg, reason) in enumerate(fold(units)):
                out.append((source, stretch, k, seg[0][2], max(u[3] for u in seg), len(seg), seg[0][1], seg[-1][1], sum(len(u[4]) for u in seg) + len(seg) - 1, reason))
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
                    out = []
        cols = list(zip(*out)) if out else [[]] * len(_OUT)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    return run


def segment_units(df: DataFrame, mode: str, source: str = "audio_source_id", unit: str = "unit_id", start: str = "start_seconds", end: str = "end_seconds", text: str = "text", keep_singletons: bool = True) -> DataFrame:
    """Segments of every source in one mode: number in the source, times, units, text length and closing reason.

    With `keep_singletons` off, a segment of one weak unit joins its neighbour in the same stretch.

    In structural mode stretches between silences over HARD_GAP are folded on their own, each with the unit behind it,
    which decides why the last segment closes; in the other modes whole sources are folded. Units without text or times are left out; ends before starts count as the starts.
    """
    rows = df.select(F.col(source).alias("source"), F.col(unit).alias("unit"), F.col(start).alias("s"), F.greatest(start, end).alias("e"), F.col(text).alias("text"))
    rows = rows.filter("s is not null and e is not null and trim(text) != ''")
    cut = rows.withColumn("stretch", F.lit(1).cast("bigint")).withColumn("beyond", F.lit(False))
    if mode == "structural":
        seen = windowed(rows, ["source"], ["s", "e", "unit"], {"reach": ("max_before", F.col("e"))})
        far = (F.col("reach").isNull() | (F.col("s") - F.col("reach") > HARD_GAP)).cast("bigint")
        cut = windowed(seen.withColumn("far", far), ["source"], ["s", "e", "unit"], {"own": ("sum", F.col("far"))})
        both = F.when((F.col("far") == 1) & (F.col("own") > 1), F.array(F.col("own") - 1, "own")).otherwise(F.array("own"))
        cut = cut.withColumn("stretch", F.explode(both)).withColumn("beyond", F.col("stretch") < F.col("own"))
    keys = ["source", "stretch"] if mode == "structural" else ["source"]
    sorted_ = cut.select("source", "unit", "s", "e", "text", "stretch", "beyond").repartition(*keys).sortWithinPartitions(*keys, "s", "e", "unit")
    out = sorted_.mapInArrow(_folded(mode, keep_singletons), _OUT_DDL)
    if mode == "structural":
        out = grouped_running(staged(out), ["source"], ["stretch", "segment_no"], name="_nth").withColumn("segment_no", (F.col("_nth") - 1).cast("int")).drop("_nth")
    return out


def all_modes(df: DataFrame, **columns: str) -> DataFrame:
    """Segments in every mode, with the mode's name."""
    parts = [segment_units(df, m, **columns).withColumn("mode", F.lit(m)) for m in MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def segment_summary(segments: DataFrame) -> DataFrame:
    """Per mode and closing reason: segments, average units, seconds and text length."""
    return segments.groupBy("mode", "closing_reason").agg(
        F.count(F.lit(1)).alias("segments"), F.avg("units").alias("units"), F.avg(F.col("end_seconds") - F.col("start_seconds")).alias("seconds"), F.avg("text_length").alias("text_length")
    )
