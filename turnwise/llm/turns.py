"""Raw speech transcripts as clean, ordered turns of numbered speakers."""

from __future__ import annotations

import heapq
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.lexicon import CUE, FILLER_WORDS, SPEAKER_WORD, SPOKEN_WORD, without_clutter
from turnwise.operators.joins import keyed_join
from turnwise.operators.ordering import divided_buckets, windowed
from turnwise.session import staged

# Number words in labels.
_NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "uno": 1, "due": 2, "tre": 3, "quattro": 4, "cinque": 5, "sei": 6, "eins": 1, "zwei": 2, "drei": 3, "vier": 4,
    "fünf": 5, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5,
    "um": 1, "dois": 2, "três": 3, "quatro": 4,
}
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}
#: Words of a label that stand beside a speaker's number and are no name.
_SPEAKER_WORDS = frozenset([*SPEAKER_WORD.split("|"), "speakers", "s", "sp", "spk", "spkr", "r", "p"])
#: Labels that name nobody. Fixed values.
_NOBODY = frozenset("unknown unk none null nan undefined na n/a speaker spk sconosciuto ignoto unbekannt inconnu desconocido desconhecido".split())
#: Fillers that are ordinary words elsewhere are left in running text; alone they still are no speech.
_AMBIGUOUS = frozenset({"em", "este", "a", "ah", "oh", "bah", "hum", "um", "ben", "ε", "अ", "ã", "э"})
_SPACES = regex.compile(r"\s+")
_FILLER_TOKEN = regex.compile(r"(?<![\p{L}\p{N}])([\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*)(?:\.{2,}|…)?[,،、]?(?=\s|$)")
#: Characters without which a text holds no cue, annotation, timestamp or stray mark.
_MARKED = regex.compile(r"[\[\](){}<>（）【】*♪♫♬:>…–—]|\s[-,;.]|\s\s|\n|-\s|(?i:spk|speaker)|^\W")
_LOOSE_MARKS = regex.compile(r"(?:^|\s)[,;:.…\-–—>]+(?=\s|$)")
#: Wide forms of the marks that cues, annotations and timestamps are written with.
_WIDE_MARKS = str.maketrans("：＞＜［］＿＃－", ":><[]_#-")
_HAS_WIDE = regex.compile("[：＞＜［］＿＃－]")
_CLOCK = regex.compile(r"(?<![\d.,:])(?:(\d{1,3}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?(?!\d|:)")


def label_number(label: str | None) -> int | None:
    """The number that a speaker label names, in digits of any script, Roman numerals or words; else None.

    A number counts beside a word for a speaker or alone: `Mario Sei` is a name.
    """
    if not label:
        return None
    s = regex.sub(r"\([^()]*\)", " ", unicodedata.normalize("NFKC", label)).strip().lower()
    words = regex.findall(r"[\p{L}\p{M}]+", s)
    rest = [w for w in words if w not in _SPEAKER_WORDS]
    if m := regex.search(r"\d+", s):
        return int(m[0]) if not rest else None
    if len(rest) == 1 and rest[0] in _NUMBER_WORDS:
        return _NUMBER_WORDS[rest[0]]
    if words and (len(words) > 1 or s != words[0]) and not [w for w in words[:-1] if w not in _SPEAKER_WORDS] and regex.fullmatch(r"(?:x{0,3})(?:ix|iv|v?i{0,3})", words[-1]):
        digits = [_ROMAN[c] for c in words[-1]]
        return sum(-d if d < max(digits[i:]) else d for i, d in enumerate(digits)) or None
    return None


def label_name(label: str | None) -> str | None:
    """The name in a label that names no number, without case, marks and width: `SPEAKER_A`, `Anna`, `Prof. Rossi`."""
    if not label or label_number(label) is not None:
        return None
    words = regex.findall(r"[\p{L}\p{M}\p{N}]+", unicodedata.normalize("NFKC", label).casefold())
    name = " ".join(words)
    return name if words and name not in _NOBODY and not all(w in _SPEAKER_WORDS or w in _NOBODY for w in words) else None


def cue_number(text: str | None) -> int | None:
    """The speaker number that a text names in a cue such as `Speaker 2:` or `[S02]`; the first if there are several."""
    m = CUE.search(unicodedata.normalize("NFKC", text)) if text else None
    return int(next(g for g in m.groups() if g)) if m else None


def cue_clock(text: str | None) -> float | None:
    """Seconds of the caption clock that a text starts with or holds, such as `00:01:02.500 -->`; the first of several."""
    m = _CLOCK.search(text) if text else None
    if not m:
        return None
    return int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]) + (float("0." + m[4]) if m[4] else 0.0)


def clean_text(text: str | None) -> str:
    """Speech alone: without cues, annotations, timestamps and hesitation sounds."""
    return _said(text)[0]


def _said(text: str | None) -> tuple[str, bool, int | None, float | None]:
    """(clean text, whether it holds a spoken word, the speaker number of its cue, its clock), in one pass."""
    if not text:
        return "", False, None, None
    if _HAS_WIDE.search(text):
        text = text.translate(_WIDE_MARKS)
    marked = _MARKED.search(text) is not None
    clock = cue_clock(text) if marked and ":" in text else None
    out = without_clutter(text) if marked else text
    words = [w for w in SPOKEN_WORD.findall(out) if w.strip("-'’").lower() not in FILLER_WORDS]
    cue = cue_number(text) if marked else None
    if len(words) < out.count(" ") + 1:  # some token is no word
        out = _FILLER_TOKEN.sub(lambda m: " " if m[1].lower() in FILLER_WORDS and m[1].lower() not in _AMBIGUOUS else m[0], out)
        marked = True
    if marked:
        out = regex.sub(r"\s+([,.;:!?])", r"\1", _SPACES.sub(" ", _LOOSE_MARKS.sub(" ", out)))
    return out.strip(), bool(words), cue, clock


#: Weights of precedence edges: time, place in the chunk, clock named in the text, order of the chunks.
TIME, PLACE, CLOCK, DIALOGUE = 4, 3, 2, 1
#: Seconds of a stretch. Any strict step of time may part stretches: no edge across it survives but those it implies.
STRETCH_SECONDS = 600.0
#: Segments from which a stretch is divided further, along the same order.
STRETCH_NODES = 50_000


class _Precedence:
    """An acyclic graph that takes edges one by one and refuses those that would close a cycle.

    Places of a topological order are kept up to date, so that an edge which agrees with it costs nothing and another
    one only a search between its two ends.
    """

    def __init__(self, n: int) -> None:
        self.after: list[list[int]] = [[] for _ in range(n)]
        self.before: list[list[int]] = [[] for _ in range(n)]
        self.place = list(range(n))

    def add(self, a: int, b: int) -> bool:
        low, high = self.place[b], self.place[a]
        if a == b:
            return False
        if low < high:  # the order must change, if it can
            ahead = self._reach(b, self.after, lambda x: self.place[x] <= high)
            if a in ahead:
                return False
            behind = self._reach(a, self.before, lambda x: self.place[x] >= low)
            moved = sorted(behind, key=self.place.__getitem__) + sorted(ahead, key=self.place.__getitem__)
            for x, p in zip(moved, sorted(self.place[x] for x in moved)):
                self.place[x] = p
        self.after[a].append(b)
        self.before[b].append(a)
        return True

    @staticmethod
    def _reach(start: int, links: list[list[int]], inside) -> set[int]:
        todo, seen = [start], {start}
        while todo:
            for y in links[todo.pop()]:
                if y not in seen and inside(y):
                    seen.add(y)
                    todo.append(y)
        return seen


def precedence_order(n: int, edges: Sequence[tuple[int, int, int]], listed: int | None = None) -> list[int]:
    """Topological order of the nodes 0 .. n-1 after resolving conflicts: edges (a before b, weight) enter from the
    heaviest down, in the order given among equals, and one that closes a cycle with those already in is left out.
    Nodes free to choose come by their number; nodes from `listed` on are helpers, which are not returned."""
    graph = _Precedence(n)
    for a, b, _ in sorted(edges, key=lambda e: -e[2]):
        graph.add(a, b)
    real = n if listed is None else listed
    missing = [len(x) for x in graph.before]
    ready = [(1, x) if x < real else (0, x) for x in range(n) if not missing[x]]  # helpers first: they only pass on
    heapq.heapify(ready)
    out = []
    while ready:
        x = heapq.heappop(ready)[1]
        if x < real:
            out.append(x)
        for y in graph.after[x]:
            missing[y] -= 1
            if not missing[y]:
                heapq.heappush(ready, (1, y) if y < real else (0, y))
    return out


def _chain(groups: Iterable[list[int]], weight: int, edges: list[tuple[int, int, int]], n: int) -> int:
    """Edges by which all nodes of a group precede all of the next, through one helper node a step; the next free node."""
    last: list[int] | None = None
    for g in groups:
        if last is not None:
            if len(last) == 1 and len(g) == 1:
                edges.append((last[0], g[0], weight))
            else:
                edges += [(a, n, weight) for a in last] + [(n, b, weight) for b in g]
                n += 1
        last = g
    return n


def _steps(nodes: Iterable[int], value) -> list[list[int]]:
    """Nodes with a value, grouped by equal values in rising order."""
    held: dict = defaultdict(list)
    for x in nodes:
        if (v := value(x)) is not None:
            held[v].append(x)
    return [held[v] for v in sorted(held)]


def segment_order(segments: Sequence[tuple]) -> list[int]:
    """Order of a stretch's segments (start, place, clock, chunk, chunk start), listed in the order for free choices.

    Edges: by start (heaviest), by place inside a chunk, by the clock that the texts name, by the start of the chunks.
    """
    edges: list[tuple[int, int, int]] = []
    real = n = len(segments)
    n = _chain(_steps(range(real), lambda x: segments[x][0]), TIME, edges, n)
    chunks: dict = defaultdict(list)
    for x, seg in enumerate(segments):
        chunks[seg[3]].append(x)
    for own in chunks.values():
        if len(own) > 1:
            n = _chain(_steps(own, lambda x: segments[x][1]), PLACE, edges, n)
    n = _chain(_steps(range(real), lambda x: segments[x][2]), CLOCK, edges, n)
    n = _chain(_steps(range(real), lambda x: segments[x][4]), DIALOGUE, edges, n)
    return precedence_order(n, edges, real)


_CLEAN = pa.schema([("id", pa.string()), ("source", pa.string()), ("chunk", pa.string()), ("s", pa.float64()), ("e", pa.float64()), ("place", pa.int32()), ("clean", pa.string()), ("spoken", pa.bool_()), ("cue", pa.int32()), ("clock", pa.float64())])
_CLEAN_DDL = "id string, source string, chunk string, s double, e double, place int, clean string, spoken boolean, cue int, clock double"


def _clean_arrow(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [_said(t) for t in b.column(6).to_pylist()]
            new = [pa.array([x[0] if with_text else None for x in said], pa.string()), pa.array([x[1] for x in said], pa.bool_()), pa.array([x[2] for x in said], pa.int32()), pa.array([x[3] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(i).cast(_CLEAN.field(i).type) for i in range(6)] + new, schema=_CLEAN)

    return run


def _labels_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        labels = b.column(1).to_pylist()
        known = {x: (label_number(x), label_name(x)) for x in set(labels)}
        numbers, names = pa.array([known[x][0] for x in labels], pa.int32()), pa.array([known[x][1] for x in labels], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), numbers, names, b.column(2).cast(pa.float64())], names=["chunk", "label_no", "label_name", "chunk_start"])


_RUNS = pa.schema([("source", pa.string()), ("stretch", pa.int64()), ("part", pa.int32()), ("run_no", pa.int32()), ("speaker_no", pa.int32()), ("speaker_name", pa.string()), ("s", pa.float64()), ("e", pa.float64()), ("clean", pa.string()), ("utterances", pa.int64())])
_RUNS_DDL = "source string, stretch bigint, part int, run_no int, speaker_no int, speaker_name string, s double, e double, clean string, utterances bigint"
#: Columns of a segment as it is ordered.
_SEGMENT = ("source", "stretch", "part", "time", "place", "clock", "chunk", "chunk_start", "s", "e", "speaker_no", "speaker_name", "clean")
#: Runs after which a batch of results leaves the worker.
_BATCH = 5_000


def _runs_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one speaker in the precedence order of each stretch; rows come sorted, and one stretch is held."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    out: list[tuple] = []
    for (source, stretch, part), members in groupby(rows, key=lambda r: r[:3]):
        own = list(members)
        runs: list[list] = []
        for x in segment_order([r[3:8] for r in own]):
            _, _, _, _, _, _, _, _, s, e, no, name, clean = own[x]
            if runs and runs[-1][:2] == [no, name]:
                runs[-1][3] = e
                runs[-1][4].append(clean or "")
            else:
                runs.append([no, name, s, e, [clean or ""]])
        out += [(source, stretch, part, k, no, name, s, e, " ".join(texts), len(texts)) for k, (no, name, s, e, texts) in enumerate(runs)]
        if len(out) > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RUNS)], schema=_RUNS)
            out = []
    cols = list(zip(*out)) if out else [[]] * len(_RUNS)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RUNS)], schema=_RUNS)


def _anchored(said: DataFrame) -> DataFrame:
    """Adds `near`: for a segment without a start the last start before its place in its chunk."""
    if not said.filter("s is null").limit(1).count():  # read from the file's statistics where none is missing
        return said.withColumn("near", F.lit(None).cast("double"))
    short = said.join(said.filter("s is null").select("chunk").distinct(), "chunk", "left_semi").filter("place is not null")
    near = windowed(short.select("id", "chunk", "s", "place"), ["chunk"], ["place", "id"], {"near": ("last_before", F.col("s"))}).filter("s is null").select("id", "near")
    return keyed_join(said, near, ["id"], "left")


def speaker_turns(
    utterances: DataFrame,
    chunks: DataFrame,
    utterance_id: str = "utterance_id",
    source: str = "audio_source_id",
    chunk_id: str = "transcript_chunk_id",
    text: str = "text",
    start: str = "start_seconds",
    end: str = "end_seconds",
    place: str = "aligned_segment_index",
    label: str = "speaker_label",
    label_chunk_id: str = "chunk_id",
    label_start: str = "start_seconds",
    with_text: bool = True,
) -> DataFrame:
    """(source, turn_no, speaker_no, speaker_name, start_ms, end_ms, text, utterances): every source's turns in order.

    An utterance's speaker is the number that its chunk's label names, or, where that names none, the number in a cue
    in the text of any utterance of the chunk, or else the name in the label (`Anna`, `SPEAKER_A`); speakers are merged
    by number or name. Precedence edges order the spoken segments: by start (heaviest), by place inside the chunk, by
    the clock named in the text, by the start of the chunks. They enter a graph from the heaviest down, those that
    contradict it are dropped, and its topological order gives the turns: longest runs of one speaker. Utterances
    without a spoken word after cleaning are no nodes.

    A source is cut into stretches of STRETCH_SECONDS. That loses nothing: two segments with different starts are held
    by their time edges, which are never dropped, so every other edge across the cut is implied or contradicted. A
    segment without a start goes to the stretch of its anchor, the last start before it in its chunk. Stretches of more
    than STRETCH_NODES segments are divided along the order of free choices. Only runs, not segments, are then joined
    over the cuts. `with_text` False leaves the text empty.

    Defined results: rows of one utterance id that repeat count once; a chunk without a row has no label; a speaker
    named nowhere is the null speaker, whose runs are turns too; a segment without a start comes where its place, clock
    or chunk puts it and starts with its chunk, or has a null start; null and empty texts are not spoken; empty inputs
    give no rows; other columns are ignored, whatever their names. Ties of all edges go by chunk, place and id.
    """
    said = utterances.select(
        F.col(utterance_id).cast("string").alias("id"), F.col(source).cast("string").alias("source"), F.col(chunk_id).cast("string").alias("chunk"),
        F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.col(place).cast("int").alias("place"), F.col(text).alias("text"),
    )
    said = said.filter(F.col("text").isNotNull()).mapInArrow(_clean_arrow(with_text), _CLEAN_DDL).dropDuplicates(["id"])
    said = staged(said.withColumn("chunk", F.coalesce("chunk", F.concat(F.lit("\x00"), "id"))).withColumn("s", F.when(~F.isnan("s"), F.col("s"))))
    cues = said.groupBy("chunk").agg(F.min("cue").alias("chunk_cue")).filter("chunk_cue is not null")
    named = chunks.select(F.col(label_chunk_id).cast("string").alias("chunk"), F.col(label).alias("label"), F.col(label_start).alias("cs"))
    named = named.mapInArrow(_labels_arrow, "chunk string, label_no int, label_name string, chunk_start double")
    named = named.groupBy("chunk").agg(F.max("label_no").alias("label_no"), F.max("label_name").alias("label_name"), F.min("chunk_start").alias("chunk_start"))
    known = _anchored(said.filter("spoken")).join(named.join(cues, "chunk", "full"), "chunk", "left")
    number = F.coalesce("label_no", "chunk_cue")
    at = F.coalesce("s", "near", "clock", "chunk_start", F.lit(float("inf")))
    stretch = F.when(at < 1e15, F.floor(at / STRETCH_SECONDS)).otherwise(F.lit(1 << 62)).cast("bigint")
    known = known.select(
        "source", stretch.alias("stretch"), F.col("s").alias("time"), "place", "clock", "chunk", F.when(~F.isnan("chunk_start"), F.col("chunk_start")).alias("chunk_start"), F.coalesce("s", "chunk_start").alias("s"), "e",
        number.alias("speaker_no"), F.when(number.isNull(), F.col("label_name")).alias("speaker_name"), "clean", at.alias("at"), F.coalesce("chunk_start", F.lit(float("inf"))).alias("cs"), "id",
    )
    order = ["at", "cs", "chunk", "place", "id"]
    divided = divided_buckets(known, ["source"], "stretch", order, STRETCH_NODES).withColumnRenamed("_ord_part", "part")
    lined = divided.repartition("source", "stretch", "part").sortWithinPartitions("source", "stretch", "part", *order)
    runs = staged(lined.select(*_SEGMENT).mapInArrow(_runs_arrow, _RUNS_DDL))
    who = F.struct("speaker_no", "speaker_name")
    line = ["stretch", "part", "run_no"]
    seen = windowed(runs, ["source"], line, {"_prev": ("lag", F.struct(who.alias("w")))})
    opens = (F.col("_prev").isNull() | ~F.col("_prev.w").eqNullSafe(who)).cast("bigint")
    turned = windowed(seen.withColumn("_opens", opens), ["source"], line, {"turn_no": ("sum", F.col("_opens"))})
    ms = lambda c: F.floor(c * 1000 + 0.5).cast("bigint")
    k = F.struct(*line)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), "clean"))), lambda x: x["clean"]), " ") if with_text else F.lit(None).cast("string")
    return (
        turned.groupBy("source", "turn_no")
        .agg(
            F.min_by("speaker_no", k).alias("speaker_no"), F.min_by("speaker_name", k).alias("speaker_name"), ms(F.min_by("s", k)).alias("start_ms"), ms(F.max_by("e", k)).alias("end_ms"),
            words.alias("text"), F.sum("utterances").alias("utterances"),
        )
        .select(F.col("source").alias(source), "turn_no", "speaker_no", "speaker_name", "start_ms", "end_ms", "text", "utterances")
    )
