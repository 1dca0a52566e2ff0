"""Oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.tokens import VOCABULARY, count_tokens, token_offsets

#: Penalties of cuts: paragraph, line, sentence, clause, word, inside a word.
PENALTIES = (0.0, 0.05, 0.1, 0.6, 1.2, 5.0)
#: Weight of the squared relative difference from the even piece size.
IMBALANCE = 1.0
#: Tokens of a block of the bounds that rule positions out.
BLOCK = 32
#: Cells up to which the dynamic program runs by layers; beyond it, position by position.
TABLE_CELLS = 60_000
#: Tokens below the limit from which a piece cut between words needs no second count.
ROOM = 8

_LEVELS = (
    regex.compile(r"\n[^\S\n]*\n\s*"),
    regex.compile(r"\n\s*"),
    regex.compile(r"(?:[.!?…؟।]+[\"”»’)\]」』]*(?=\s|$))|[。！？]+[\"”»’)\]」』]*|(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])(?=\s)"),
    regex.compile(r"[,;:،；：，、–—]+(?=\s|[\p{Han}\p{Hiragana}\p{Katakana}])"),
)
_BLANKS = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def cut_levels(text: str, offsets: np.ndarray) -> np.ndarray:
    """Kind of boundary (index into PENALTIES) at every token boundary; 9 where no cut is possible."""
    best = np.full(len(text) + 1, 5, np.int8)
    blank = np.isin(np.frombuffer(text.encode("utf-32-le"), np.uint32), _BLANKS)
    best[:-1][blank] = 4  # before white space and behind it a word ends
    best[1:][blank] = 4
    for level in range(len(_LEVELS) - 1, -1, -1):
        if level < 2 and "\n" not in text:
            continue
        best[[m.end() for m in _LEVELS[level].finditer(text)]] = level
    out = np.where(offsets >= 0, best[np.maximum(offsets, 0)], 9).astype(np.int8)
    return out


def piece_start(levels: np.ndarray, cut: int, overlap: int) -> int:
    """Where the piece behind a cut starts: `overlap` tokens before, or further on to the start of a character."""
    at = cut - overlap
    while at > 0 and levels[at] == 9:
        at -= 1
    return at


def _layered(at: np.ndarray, start: np.ndarray, penalty: np.ndarray, low: np.ndarray, width: int, limit: int, even: float, n: int, pieces: int, overlap: int) -> list[int] | None:
    """The dynamic program by number of pieces, each layer over all positions at once.

    With p pieces the mean size is known, and by convexity the imbalance costs at least p times its squared deviation;
    layers end when that alone exceeds the best cutting found, so the result is the least over any number of pieces.
    """
    m = len(at)
    reach = low[:, None] + np.arange(width)[None, :]
    open_ = reach < np.arange(m)[:, None]
    reach = np.minimum(reach, m - 1)
    fit = np.where(open_, IMBALANCE * ((at[:, None] - start[reach] - even) / even) ** 2, np.inf) + penalty[:, None]
    cost = np.where(at <= limit, penalty + IMBALANCE * ((at - even) / even) ** 2, np.inf)
    best, found = np.inf, None
    backs: list[np.ndarray] = []
    rows = np.arange(m)
    while np.isfinite(cost).any():
        if cost[-1] < best:
            best, found = float(cost[-1]), len(backs)
        p = len(backs) + 2
        mean = min(even, (n + (p - 1) * (overlap + 3)) / p)
        if p > pieces and IMBALANCE * p * ((mean - even) / even) ** 2 >= best or not width:
            break
        total = fit + cost[reach]
        step = total.argmin(1)
        cost = total[rows, step]
        backs.append(reach[rows, step])
    if found is None:
        return None
    cuts, j = [], m - 1
    for back in reversed(backs[:found]):
        j = int(back[j])
        cuts.append(int(at[j]))
    return cuts[::-1]


def coarse_positions(levels: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Positions that give a first, good cutting: ends of paragraphs, lines and sentences, and finer boundaries, some of
    them only, inside stretches too long for a piece."""
    n = len(levels) - 1
    step = max(1, limit - overlap - 4)
    at = np.flatnonzero(levels <= 2)
    for finest in (3, 4, 5):
        edges = np.concatenate([[0], at, [n]])
        wide = np.flatnonzero(np.diff(edges) > step)
        if not len(wide):
            break
        more = []
        for k in wide:
            inner = np.flatnonzero(levels[edges[k] + 1 : edges[k + 1]] <= finest) + edges[k] + 1
            if finest == 5:
                cells = inner // min(16, max(1, step // 4))
                inner = inner[np.concatenate([[True], np.diff(cells) > 0])] if len(inner) else inner
            more.append(inner)
        at = np.unique(np.concatenate([at, *more]))
    return at[(at > overlap) & (at < n)]


_PENALTY = np.array([*PENALTIES, *[np.inf] * 4])


def _even(n: int, limit: int, overlap: int) -> tuple[int, float]:
    pieces = -(-(n - overlap) // (limit - overlap))
    return pieces, (n + (pieces - 1) * overlap) / pieces


def cutting_cost(levels: np.ndarray, cuts: Sequence[int], limit: int, overlap: int) -> float:
    """Sum of the cuts' penalties and of the pieces' squared relative differences from the even size."""
    n = len(levels) - 1
    even = _even(n, limit, overlap)[1]
    starts = [0, *[piece_start(levels, int(c), overlap) for c in cuts]]
    return sum(float(_PENALTY[levels[c]]) for c in cuts) + sum(IMBALANCE * ((b - a - even) / even) ** 2 for a, b in zip(starts, [*cuts, n]))


def possible_positions(levels: np.ndarray, limit: int, overlap: int, most: float) -> np.ndarray:
    """All positions that may lie in a cutting which costs at most `most`.

    Blocks of BLOCK positions take the least penalty of their members, and two blocks the least difference from the even
    size of any two of their positions: forward and backward dynamic programs over blocks so bound from below what a
    cutting through a position costs. Only positions whose bound exceeds `most` are left out.
    """
    n = len(levels) - 1
    even = _even(n, limit, overlap)[1]
    blocks = n // BLOCK + 1
    cost = _PENALTY[levels]
    cost[: overlap + 1] = np.inf
    cost[n] = np.inf
    least = np.minimum.reduceat(cost, np.arange(0, n + 1, BLOCK))
    reach = (limit + overlap) // BLOCK + 2
    gap = np.arange(1, reach + 1) * BLOCK
    lo, hi = gap - (BLOCK - 1) + overlap, gap + (BLOCK - 1) + overlap + 3
    off = np.where(lo > limit, np.inf, IMBALANCE * (np.maximum(0, np.maximum(lo - even, even - np.minimum(hi, limit))) / even) ** 2)
    edge = np.arange(blocks) * BLOCK
    first = np.where(edge > limit, np.inf, IMBALANCE * (np.maximum(0, np.maximum(edge - even, even - np.minimum(edge + BLOCK - 1, limit))) / even) ** 2)
    left = n - edge + overlap  # size of a last piece behind a cut in the block, at most three more
    last = np.where(left - BLOCK + 1 > limit, np.inf, IMBALANCE * (np.maximum(0, np.maximum(left - BLOCK + 1 - even, even - np.minimum(left + 3, limit))) / even) ** 2)
    ahead, back = first.copy(), last.copy()  # without the penalty of the block's own cut
    for j in range(1, blocks):
        k = min(reach, j)
        ahead[j] = min(ahead[j], float((ahead[j - k : j][::-1] + least[j - k : j][::-1] + off[:k]).min()))
    for j in range(blocks - 2, -1, -1):
        k = min(reach, blocks - 1 - j)
        back[j] = min(back[j], float((back[j + 1 : j + 1 + k] + least[j + 1 : j + 1 + k] + off[:k]).min()))
    bound = np.repeat(ahead + back, BLOCK)[: n + 1] + cost
    return np.flatnonzero(bound <= most + 1e-9)


def _cheapest(levels: np.ndarray, at: np.ndarray, limit: int, overlap: int) -> list[int] | None:
    """The cheapest cutting with cuts among the positions `at`; None if there is none."""
    n = len(levels) - 1
    pieces, even = _even(n, limit, overlap)
    at = np.concatenate([at, [n]])
    start = np.array([piece_start(levels, int(c), overlap) for c in at])
    penalty = _PENALTY[levels[at]]
    penalty[-1] = 0.0
    low = np.searchsorted(start, at - limit)
    width = int((np.arange(len(at)) - low).max(initial=0))
    if len(at) * width <= TABLE_CELLS:
        return _layered(at, start, penalty, low, width, limit, even, n, pieces, overlap)
    cost, back = np.full(len(at), np.inf), np.full(len(at), -1)
    for j, e in enumerate(at):
        if e <= limit:
            cost[j] = penalty[j] + IMBALANCE * ((e - even) / even) ** 2
        k = low[j]
        if k < j:
            total = cost[k:j] + IMBALANCE * ((e - start[k:j] - even) / even) ** 2
            i = int(total.argmin())
            if total[i] + penalty[j] < cost[j]:
                cost[j], back[j] = total[i] + penalty[j], k + i
    if not np.isfinite(cost[-1]):
        return None
    cuts, j = [], int(back[-1])
    while j >= 0:
        cuts.append(int(at[j]))
        j = int(back[j])
    return cuts[::-1]


def best_cuts(levels: np.ndarray, limit: int, overlap: int) -> list[int] | None:
    """Token positions of the cuts that cost least over all positions, by dynamic programming; None if there are none.

    A piece runs from `piece_start` of the previous cut to the next cut and holds at most `limit` tokens. The cost is
    `cutting_cost`. A first cutting on coarse positions gives a cost that the best does not exceed; the program then
    runs over every position that a cutting so cheap may have.
    """
    n = len(levels) - 1
    if n <= limit:
        return []
    first = _cheapest(levels, coarse_positions(levels, limit, overlap), limit, overlap)
    if first is None:
        every = np.flatnonzero(levels <= 5)
        return _cheapest(levels, every[(every > overlap) & (every < n)], limit, overlap)
    return _cheapest(levels, possible_positions(levels, limit, overlap, cutting_cost(levels, first, limit, overlap)), limit, overlap)


def cut_text(text: str, limit: int, overlap: int, path: str = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """(first token, last token, start char, end char) of each piece; one piece if the text is within the limit.

    Pieces that are near the limit or part words are measured again on their own; should one exceed the limit so, the
    whole text is cut with a lower one. A text that cannot be cut so (a limit of a few tokens, which one character may
    exceed) gets its best cutting by tokens all the same.
    """
    offsets = token_offsets(text, path)
    n = len(offsets) - 1
    if n <= limit:
        return [(0, n, 0, len(text))]
    levels = cut_levels(text, offsets)
    for room in (0, 2, 8, 32, limit // 4):
        cuts = best_cuts(levels, limit - room, overlap) if limit - room > overlap else None
        if cuts is None:
            continue
        starts = [0, *[piece_start(levels, c, overlap) for c in cuts]]
        out = [(a, b, int(offsets[a]), int(offsets[b])) for a, b in zip(starts, [*cuts, n])]
        # tokens change only where a cut parts a word, or by a blank or two at the ends
        near = [(a, b) for x, y, a, b in out if y - x > limit - ROOM or levels[x] == 5 or levels[y] == 5]
        if all(count_tokens(text[a:b], path) <= limit for a, b in near):
            return out
    starts = [p * (limit - overlap) for p in range(-(-(n - overlap) // (limit - overlap)))]
    spans = [(piece_start(levels, a, 0), piece_start(levels, min(a + limit, n), 0) if a + limit < n else n) for a in starts]
    return [(a, b, int(offsets[a]), int(offsets[b])) for a, b in spans if b > a]


_PIECES = pa.schema(
    [("id", pa.string()), ("piece_no", pa.int32()), ("first_token", pa.int64()), ("last_token", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("piece", pa.string())]
)


def split_oversized(df: DataFrame, item_id: str, text: str, limit: int, overlap: int, path: str = VOCABULARY) -> DataFrame:
    """(item_id, piece_no, first_token, last_token, start_char, end_char, piece): the pieces of every item over `limit`.

    Items within the limit have no rows. A token takes a byte at least, so texts of at most `limit` bytes are passed
    over before anything is sent to Python. Consecutive pieces share `overlap` tokens of the item, and up to
    three more only where the shared part would begin inside a character.

    Defined results: null and empty texts have no rows; rows of one item and text that repeat count once; texts without
    natural boundaries are cut at words, then inside words, never inside a character; a text that no cutting satisfies
    is cut every `limit - overlap` tokens, back to the start of a character, and fails no job; very long texts are read whole;
    an empty input gives no rows; other columns are ignored, whatever their names. `overlap` must lie below `limit`.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie below the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = cut_text(t, limit, overlap, path)
                if len(pieces) > 1:
                    rows += [(i, k, *p, t[p[2] : p[3]]) for k, p in enumerate(pieces)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECES)], schema=_PIECES)

    kind = df.schema[item_id].dataType.simpleString()
    long = df.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("t")).filter(F.octet_length("t") > limit).dropDuplicates(["id", "t"])
    pieces = long.mapInArrow(run, "id string, piece_no int, first_token bigint, last_token bigint, start_char bigint, end_char bigint, piece string")
    return pieces.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", item_id)
