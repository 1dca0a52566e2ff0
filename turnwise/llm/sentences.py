"""Sentence boundaries in any script, by a hidden-event n-gram model with forward-backward posteriors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.session import staged

#: Slots of the hashed n-gram table; its size is fixed, whatever the corpus.
SLOTS = 1 << 20
#: Rounds of re-estimation after the seeded one.
ROUNDS = 2
BACKOFF = 2.0
#: Bound of the next word's log-odds.
LIFT = 5.0

# Abbreviations that sentences go on after.
OPEN_ABBREVIATIONS = frozenset(
    """
    prof profs dr dott dott.ssa dra drs sig sig.ra sigg sra sr srta mr mrs ms mme mlle mm hr fr frau st ing avv rev gen col lt
    p pp pag pagg pág págs s v vv cfr cf vgl vs viz fig figg figs abb tab art artt cap kap sec sez sect abs vol bd nr no núm num n nº
    ca approx ap aprox e.g i.e z.b d.h u.a bzw c.-à-d c.à.d p.es p.ex p.ej es ad.es env max min inkl exkl ggf evtl vol ed eds
    стр с рис см г гл напр т.е т им проф д-р ул σελ σχ βλ πχ π.χ κ δρ αρ ص د م انظر पृ चि डॉ सं
    """.split()
)
# Abbreviations that may end a sentence.
FINAL_ABBREVIATIONS = frozenset("etc ecc usw u.s.w т.д т.п и.т.д κ.λπ κλπ κ.ά a.m p.m inc ltd jr sr es.ecc إلخ आदि".split())

# Month names written with a capital, which follow ordinals such as `3.`
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())

_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー々"
_NO_MARKS = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_TERMINAL = ".!?…。！？｡।॥؟۔‼⁇⁈⁉"
_CLOSERS = "\"”»’›)\\]」』》）】“"
_GAP = regex.compile(
    rf"(?P<mark>[{_TERMINAL}]+|(?<=[\p{{Greek}}][)»”\"]?)[;;]|(?<=[\p{{Greek}}]\s?)[;;])"
    rf"|(?P<quote>[»”」』》\"“’›«‹])|(?P<line>(?=\s*\n))|(?P<space>(?<=[{_NO_MARKS}])(?=[  ]+\S))"
)
_LEFT = regex.compile(rf"(?r)(?:[{_UNSPACED}]{{1,2}}|[\p{{L}}\p{{M}}\p{{N}}]+(?:[.'’-]+[\p{{L}}\p{{M}}\p{{N}}]+)*)[\s\"”»’›)\]」』》）】“{_TERMINAL};«‹]*$")
_LEFT_WORD = regex.compile(rf"[{_UNSPACED}]{{1,2}}|[\p{{L}}\p{{M}}\p{{N}}]+(?:[.'’-]+[\p{{L}}\p{{M}}\p{{N}}]+)*")
_RIGHT = regex.compile(rf"(?P<open>[\"“«„‘'¿¡(\[「『《（【]*)\s*(?P<word>[{_UNSPACED}]{{1,2}}|[\p{{L}}\p{{M}}\p{{N}}]+(?:['’][\p{{L}}\p{{M}}]+)?)?")
_WORD = regex.compile(rf"[{_UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}]+")
_PAIRS = {"«": "»", "‹": "›", "„": "“”", "‘": "’", "(": ")", "[": "]", "「": "」", "『": "』", "《": "》", "（": "）", "【": "】", "“": "”", '"': '"', "»": "«", "›": "‹"}
_BRACKETS = regex.compile(r"[«»‹›„“”‘’()\[\]「」『』《》（）【】\"\n]")


def enclosed(text: str) -> list[tuple[int, int, bool]]:
    """(open, close, after a colon) of quotations and brackets that are closed before the line ends; the outer ones."""
    out: list[tuple[int, int, bool]] = []
    stack: list[tuple[int, str]] = []
    for m in _BRACKETS.finditer(text):
        ch, i = m[0], m.start()
        if ch == "\n":
            stack.clear()
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if ch in _PAIRS[stack[k][1]]), None)
        if at is not None:
            begin = stack[at][0]
            del stack[at:]
            while out and out[-1][0] > begin:
                out.pop()
            before = begin - 1
            while before >= 0 and text[before].isspace():
                before -= 1
            out.append((begin, i, before >= 0 and text[before] in ":："))
        elif ch in _PAIRS and not (ch in "‘»›" and i and (text[i - 1].isalnum() or text[i - 1] in _TERMINAL)):
            stack.append((i, ch))
    return out


@dataclass
class Gap:
    """A place where a sentence may end."""

    end: int  #: offset behind the closing marks
    next: int  #: offset of the next character that is no white space
    mark: str  #: kind of mark, with flags for quotation, line break and missing space
    left: str
    right: str
    kind: str  #: class of the right side
    words: int  #: words since the gap before
    seed: float


_NO_MARK_CHAR, _UNSPACED_CHAR = regex.compile(rf"[{_NO_MARKS}]"), regex.compile(rf"[{_UNSPACED}]")


@lru_cache(maxsize=1 << 16)
def _char_class(ch: str) -> str:
    if ch.isdigit():
        return "d"
    if _NO_MARK_CHAR.match(ch):
        return "t"
    if _UNSPACED_CHAR.match(ch):
        return "h"
    return "l" if ch.islower() else "u" if ch.isupper() or ch.istitle() else "o"


def _class(word: str) -> str:
    return _char_class(word[0]) if word else "-"


def _shape(word: str) -> str:
    return f"{_class(word)}{min(len(word), 5)}{'.' if '.' in word else ''}"


def _seed(mark: str, flags: str, left: str, kind: str, opened: str) -> float:
    """First guess at a boundary's probability, before anything is learned."""
    if "n" in flags:
        return 0.6 if kind == "l" and mark in ("NL", "…") else 0.97
    if mark == "SP":
        return 0.02 if kind == "d" or _class(left[-1:]) == "d" else 0.95 if kind == "u" else 0.85
    if "q" in flags and mark == "Q":
        return 0.02 if kind in "ld" else (0.9 if kind == "u" or "c" in flags else 0.3)
    if kind == "l" and not opened:
        return 0.03 if mark in ".…" else 0.05
    if "q" in flags:
        return 0.9 if kind == "u" or "c" in flags else 0.4
    if mark == "…":
        return 0.5
    if mark == ".":
        low = left.lower()
        if "x" in flags:
            return 0.9 if kind in "uho" and len(left) > 1 and low not in OPEN_ABBREVIATIONS and not left[-1:].isdigit() else 0.02
        if low in OPEN_ABBREVIATIONS or (len(left) == 1 and left.isalpha() and kind != "h"):
            return 0.03
        if low in FINAL_ABBREVIATIONS:
            return 0.9
        return 0.1 if kind == "d" else 0.95
    return 0.3 if kind == "d" else 0.97


def gaps_of(text: str) -> list[Gap]:
    """All places of a text where a sentence may end, apart from its end. None lies inside a quotation or bracket."""
    spans = enclosed(text)
    inside = np.zeros(len(text) + 2, bool)
    colon = {}
    opens = set()
    for a, b, c in spans:
        inside[a + 1 : b + 1] = True
        colon[b] = c
        opens.add(a)
    out: list[Gap] = []
    last = done = 0
    size = len(text)
    for m in _GAP.finditer(text):
        raw = m["mark"] or ""
        if m.start() < done or (m["quote"] is not None and m.start() not in colon):
            continue
        end, close, quoted = m.end(), -1, False
        if m["quote"] is not None:
            close, quoted = m.start(), True
        while raw or quoted:  # closing marks, also behind a space, and final marks behind them
            at = end
            while at < size and text[at] in "    ":
                at += 1
            if at < size and (at in colon or (at == end and text[at] in "»”’)]」』》）】" and at not in opens)):
                quoted |= text[at] not in ")]）】"
                close, end = (at if at in colon else close), at + 1
            elif end < size and text[end] in _TERMINAL:
                raw, end = raw + text[end], end + 1
            else:
                break
        if end >= size or inside[end]:
            continue
        done = end
        at = end
        while at < size and text[at].isspace():
            at += 1
        if at >= size or text[at] in ",;:،、，)]»”" and at not in opens or text[at] in _TERMINAL:
            continue
        line = "\n" in text[end:at]
        if raw:
            mark = "…" if "…" in raw or ".." in raw else raw[-1]
            mark = "?" if mark in "?？؟;;⁇⁈⁉" else "!" if mark in "!！‼" else "。" if mark in "。｡।॥۔" else mark
        else:
            mark = "NL" if m["line"] is not None else "SP" if m["space"] is not None else "Q"
        flags = ("n" if line else "") + ("q" if quoted else "") + ("c" if colon.get(close) else "")
        r = _RIGHT.match(text, at)
        right, opened = r["word"] or "", r["open"] or (text[at] if at in opens else "")
        if opened and not right and (w := _RIGHT.match(text, at + 1)):
            right = w["word"] or ""
        kind = _class(right)
        if at == end:
            flags += "x"
            if mark == "." and kind not in "uho" and not opened:
                continue
            if mark in ("Q", "SP") and kind not in "hto" and not opened:
                continue
        head = text[max(0, m.start() - 40) : m.start()]
        found = _LEFT.search(head)
        left = _LEFT_WORD.match(found[0])[0] if found else ""
        if _class(left) in "ht":
            left = head.rstrip()[-2:]
        if out and out[-1].next == at:
            if mark in ("NL", "SP", "Q"):
                if line and "n" not in out[-1].mark:
                    out[-1].mark += "n"
                    out[-1].seed = max(out[-1].seed, 0.97 if kind != "l" else 0.6)
                continue
            out.pop()
            last = out[-1].next if out else 0
        words = len(_WORD.findall(text, last, min(m.start() + 1, last + 60)))
        seed = 0.03 if mark == "." and right in MONTHS and left.isdigit() else _seed(mark, flags, left, kind, opened)
        out.append(Gap(end, at, mark + ":" + flags, left.lower(), (right.lower() if kind != "u" else right), kind + ("o" if opened else ""), words, seed))
        last = at
    return out


def _slot(*parts: str) -> tuple[int, int]:
    """Two cells per n-gram; the one that others use less is read, which makes collisions harmless."""
    h = xxhash.xxh3_64_intdigest("\x1f".join(parts))
    return h % SLOTS, (h >> 32) % SLOTS


#: N-grams of a gap whose cells are kept between texts.
_CACHE = 1 << 17


@lru_cache(maxsize=_CACHE)
def _left_slots(left: str, mark: str) -> tuple:
    return _slot("L3", left, mark), _slot("L2", _shape(left), mark), _slot("L1", mark)


@lru_cache(maxsize=_CACHE)
def _right_slots(right: str, kind: str) -> tuple:
    return _slot("R2", right, kind), _slot("R1", kind), _slot("R0")


@lru_cache(maxsize=_CACHE)
def _marked_slots(right: str, kind: str, mark: str) -> tuple:
    return _slot("G2", right, kind, mark), _slot("G1", kind, mark), _slot("G0", mark)


@lru_cache(maxsize=_CACHE)
def _short_slot(shape: str, mark: str) -> tuple[int, int]:
    return _slot("B3", "<b>", shape, mark)


@lru_cache(maxsize=_CACHE)
def _end_slot(word: str) -> tuple[int, int]:
    """Cells of a word as the last of a sentence, whatever the mark."""
    return _slot("E2", word.lower())


@lru_cache(maxsize=_CACHE)
def _start_slot(word: str) -> tuple[int, int]:
    """Cells of a word as the first of a sentence, whatever its case."""
    return _slot("N2", word.lower())


_ANY_WORD = _slot("E0")


def _keys(g: Gap) -> tuple[tuple, tuple]:
    """Slots of a gap's left n-grams (event given history) and right ones (word given event), longest first.

    Behind an ellipsis, which may stand anywhere, the next word is compared with its occurrences inside sentences;
    behind other marks with its occurrences behind such marks.
    """
    if _loose(g):
        right = _right_slots(g.right, g.kind)
    else:
        right = _marked_slots(g.right, g.kind, g.mark[0] + ("a" if g.left in OPEN_ABBREVIATIONS or len(g.left) == 1 and g.left.isalpha() else "d" if g.left.isdigit() else ""))
    return _left_slots(g.left, g.mark), right


def _loose(g: Gap) -> bool:
    return g.mark[0] == "…"


def _short(g: Gap) -> tuple[int, int]:
    return _short_slot(_shape(g.left), g.mark)


@dataclass
class BoundaryModel:
    """Hashed table of (boundary mass, occurrences) of the n-grams around gaps; without a table, the seeds decide."""

    mass: np.ndarray | None = None
    seen: np.ndarray | None = None

    def _cell(self, slot: tuple[int, int]) -> tuple[float, float]:
        a, b = slot
        i = a if self.seen[a] <= self.seen[b] else b
        return float(self.mass[i]), float(self.seen[i])

    def _rate(self, slots: list[tuple[int, int]], base: float) -> float:
        p = base
        for s in reversed(slots):
            mass, seen = self._cell(s)
            p = (mass + BACKOFF * p) / (seen + BACKOFF)
        return min(max(p, 1e-6), 1 - 1e-6)


def _add_words(words: Counter, table: dict[int, list[float]]) -> None:
    def add(slot: tuple[int, int], mass: float, seen: float) -> None:
        for i in set(slot):
            cell = table.setdefault(i, [0.0, 0.0])
            cell[0] += mass
            cell[1] += seen

    for (w, first), n in words.items():
        kind = _class(w)
        for s in _right_slots(w.lower() if kind != "u" else w, kind):
            add(s, n * first, n)
        both = 2 * n if kind in "ht" else n  # of unspaced scripts every second pair of characters is counted
        add(_end_slot(w), 0.0, both)
        add(_start_slot(w), n * first, both)
        add(_ANY_WORD, 0.0, n)


_RIGHT_WORDS = regex.compile(rf"[{_UNSPACED}]{{2}}|[\p{{L}}\p{{M}}\p{{N}}]+(?:['’][\p{{L}}\p{{M}}]+)?")
_FIRST_WORDS = regex.compile(rf"(?:(?<=[\"“«„‘¿¡「『《\n])|^)(?:[{_UNSPACED}]{{2}}|[\p{{L}}\p{{M}}\p{{N}}]+(?:['’][\p{{L}}\p{{M}}]+)?)")
_N_KEYS = 13
_FEATURES = pa.schema(
    [("id", pa.string()), ("text", pa.string()), ("lead", pa.int32()), ("tail", pa.int32()), ("ends", pa.list_(pa.int32())), ("nexts", pa.list_(pa.int32())), ("seeds", pa.list_(pa.float32())),
     ("short", pa.list_(pa.bool_())), ("loose", pa.list_(pa.bool_())), ("slots", pa.list_(pa.int32())), ("word_slots", pa.list_(pa.int32())), ("word_mass", pa.list_(pa.float64())), ("word_seen", pa.list_(pa.float64()))]
)
_FEATURES_DDL = (
    "id string, text string, lead int, tail int, ends array<int>, nexts array<int>, seeds array<float>, short array<boolean>, loose array<boolean>, slots array<int>, "
    "word_slots array<int>, word_mass array<double>, word_seen array<double>"
)


def _features_arrow(with_words: bool):
    """Texts as the numbers that training and decoding need, so that texts are scanned once; and, in rows without a
    text, the merged counts of the words that stand at no gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            words: Counter = Counter()
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                gaps = gaps_of(t)
                slots: list[int] = []
                for g in gaps:
                    ls, rs = _keys(g)
                    every = rs if _loose(g) else _right_slots(g.right, g.kind)
                    for pair in (*ls, *rs, *every, _short(g), _end_slot(g.left), _start_slot(g.right), _end_slot(g.right)):
                        slots += pair
                rows.append((i, t, len(t) - len(t.lstrip()), len(t.rstrip()), [g.end for g in gaps], [g.next for g in gaps], [g.seed for g in gaps], [k > 0 and g.words <= 1 for k, g in enumerate(gaps)], [_loose(g) for g in gaps], slots, None, None, None))
                if with_words:
                    own = Counter(_RIGHT_WORDS.findall(t))
                    at_gap = {g.next for g in gaps}
                    for g in gaps:
                        m = _RIGHT_WORDS.match(t, g.next) or _RIGHT_WORDS.match(t, g.next + 1)
                        if m and own.get(m[0]):
                            own[m[0]] -= 1
                    for m in _FIRST_WORDS.finditer(t):
                        if m.start() not in at_gap and m.start() - 1 not in at_gap and own.get(m[0]):
                            own[m[0]] -= 1
                            words[m[0], True] += 1
                    for w, n in own.items():
                        if n:
                            words[w, False] += n
            if words:
                table: dict[int, list[float]] = {}
                _add_words(words, table)
                rows.append((*[None] * 10, list(table), [v[0] for v in table.values()], [v[1] for v in table.values()]))
            cols = list(zip(*rows)) if rows else [[]] * len(_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FEATURES)], schema=_FEATURES)

    return run


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _batch_posteriors(model: BoundaryModel, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first gap of every text, posteriors, slots, short flags) of a batch of features.

    The event at a gap depends on its left history, which holds a boundary itself where the gap before lies one word
    back, and the word after the gap on the event; without a table the seeds decide.
    """
    names = b.schema.names
    seeds = _flat(b.column(names.index("seeds")), np.float64)
    short = _flat(b.column(names.index("short")), bool)
    slots = _flat(b.column(names.index("slots")), np.int64).reshape(-1, _N_KEYS, 2)
    sizes = np.array([len(x) if x is not None else 0 for x in b.column(names.index("seeds")).to_pylist()], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    if model.mass is None or not len(seeds):
        return first, seeds, slots, short
    pick = np.where(model.seen[slots[:, :, 0]] <= model.seen[slots[:, :, 1]], slots[:, :, 0], slots[:, :, 1])
    mass, seen = model.mass[pick].astype(np.float64), model.seen[pick].astype(np.float64)
    base = model._rate([_slot("S0")], 0.5)

    def rate(keys: tuple[int, ...]) -> np.ndarray:
        p = np.full(len(seeds), base)
        for k in keys:
            p = (mass[:, k] + BACKOFF * p) / (seen[:, k] + BACKOFF)
        return np.clip(p, 1e-6, 1 - 1e-6)

    logit = lambda p: np.log(p / (1 - p))
    lift = np.clip(logit(rate((5, 4, 3))) - logit(rate((5,))), -LIFT, LIFT)
    post = 1 / (1 + np.exp(-np.clip(logit(rate((2, 1, 0))) + lift, -40, 40)))
    shy = (mass[:, 9] + BACKOFF * post * 0.3) / (seen[:, 9] + BACKOFF)
    for d in np.unique(np.searchsorted(first, np.flatnonzero(short), "right") - 1):
        a, e = first[d], first[d + 1]
        post[a:e] = _forward_backward(post[a:e], shy[a:e], short[a:e])
    return first, post, slots, short


def _forward_backward(p: np.ndarray, shy: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Posteriors of a chain in which `p` is a boundary's probability, and `shy` where the gap before is one."""
    n = len(p)
    pair = np.stack([np.stack([1 - p, p], 1), np.stack([1 - np.where(short, shy, p), np.where(short, shy, p)], 1)], 1)
    ahead, forward, state = np.ones((n, 2)), np.zeros((n, 2)), np.array([0.0, 1.0])
    for k in range(n):
        state = state @ pair[k]
        state = state / state.sum()
        forward[k] = state
    for k in range(n - 2, -1, -1):
        ahead[k] = pair[k + 1] @ ahead[k + 1]
        ahead[k] /= ahead[k].sum()
    both = forward * ahead
    return both[:, 1] / both.sum(1)


_COUNTS = pa.schema([("slot", pa.int32()), ("mass", pa.float64()), ("seen", pa.float64())])
_COUNTS_DDL = "slot int, mass double, seen double"


#: Words without any mark between them from which the places between words may be boundaries too.
SPARSE = 40
#: The same in mean sentence lengths.
SPARSE_MEANS = 4.0
#: Characters a word, where words are not spaced.
WIDE_WORD, NO_MARK_WORD = 2.0, 5.0
#: Words a mark that a stretch may hold and still count as sparse.
WORDS_A_MARK = 24
#: Words since the last boundary up to which their number is told apart.
LONGEST = 80
_INNER = regex.compile(r"[,;:،、，；：।]")
_UNIT = regex.compile(rf"[{_UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}]+(?:['’-][\p{{L}}\p{{M}}\p{{N}}]+)*")


def hazard(mean: float) -> np.ndarray:
    """Factor on the odds of a boundary by the number of words since the last one: next to none for a word or two, one
    up to one and a half mean lengths, and growing beyond."""
    k = np.arange(1, LONGEST + 1)
    return np.where(k <= 2, 0.02, np.where(k <= max(4, 0.3 * mean), 0.3, np.clip(1 + 3 * (k / mean - 1.5), 1, 20)))


def _length_posteriors(odds: np.ndarray, step: np.ndarray, last: np.ndarray, block: int = 1_000) -> np.ndarray:
    """Posterior of a boundary at every place, by forward-backward over the words since the last boundary.

    `odds` are log-odds by place, `step` what the number of words adds, `last` weighs the rest behind the last
    boundary. States of one block are held, those before it computed again from its start, so that memory grows with a
    block and not with the text.
    """
    n, size = len(odds), len(step)

    def chance(k: int) -> np.ndarray:
        return 1 / (1 + np.exp(-(odds[k] + step)))

    def moved(state: np.ndarray, p: np.ndarray) -> np.ndarray:
        goes = state * (1 - p)
        out = np.empty(size)
        out[0] = state @ p
        out[1:] = goes[:-1]
        out[-1] += goes[-1]
        return out

    state = np.zeros(size)
    state[0] = 1.0
    kept = []
    for k in range(n):
        if k % block == 0:
            kept.append(state)
        state = moved(state, chance(k))
    back, post = last.copy(), np.zeros(n)
    for start in range((n - 1) // block * block, -1, -block):
        states = [kept[start // block]]
        for k in range(start, min(start + block, n) - 1):
            states.append(moved(states[-1], chance(k)))
        for k in range(min(start + block, n) - 1, start - 1, -1):
            p, state = chance(k), states[k - start]
            ends, goes = p * back[0], (1 - p) * np.append(back[1:], back[-1])
            post[k] = state @ ends / max(state @ (ends + goes), 1e-300)
            back = ends + goes
            back /= back.max()
    return post


def word_boundaries(model: BoundaryModel, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(end, next) of the boundaries between words of a stretch without marks, by forward-backward over the places.

    The event at a place depends on the word before it and on the words since the last event, the word behind it on
    the event; rates are those that the words have at the boundaries of marked texts. In scripts without spaces a unit
    is a character, known by pairs. No place inside a quotation or bracket counts.
    """
    if model.mass is None:
        return []
    units = [m for m in _UNIT.finditer(text, start, end)]
    wide = sum(_UNSPACED_CHAR.match(m[0]) is not None for m in units)
    bare = sum(_NO_MARK_CHAR.match(m[0]) is not None for m in units)
    per = NO_MARK_WORD if 2 * bare > len(units) else WIDE_WORD if 2 * wide > len(units) else 1.0  # units a word
    boundaries, words = model._cell(_ANY_WORD)
    base = min(max((boundaries + 1) / (words + 20), 1e-3), 0.5)
    mean = (1 if per == 1 else 2) / base  # units a sentence; what is counted are words and pairs of characters
    if len(units) < max(per * SPARSE, SPARSE_MEANS * mean) or len(_INNER.findall(text, start, end)) * WORDS_A_MARK * per > len(units):
        return []
    held = [(a, b) for a, b, _ in enclosed(text[start:end])]
    places = []
    for x, y in zip(units, units[1:]):
        if not any(a < x.end() - start <= b for a, b in held):
            places.append((x.end(), y.start(), x, y))
    n = len(places)
    if not n:
        return []

    def known(pair: str, slot) -> float:
        mass, seen = model._cell(slot(pair))
        p = (mass + 4 * base) / (seen + 4)
        return math.log(p / (1 - p)) if 0 < p < 1 else math.log(base / (1 - base))

    rest = math.log(base / (1 - base))
    odds = np.empty(n)
    for k, (e, nxt, x, y) in enumerate(places):
        left = text[max(start, e - 2) : e] if _UNSPACED_CHAR.match(x[0]) else x[0]
        right = text[nxt : min(end, nxt + 2)] if _UNSPACED_CHAR.match(y[0]) else y[0]
        odds[k] = np.clip(known(left, _end_slot) + known(right, _start_slot) - rest, -8, 8) - (math.log(2) if per > 1 else 0.0)
    step = np.log(hazard(mean))
    post = _length_posteriors(odds, step, np.minimum(1.0, hazard(mean)))
    return [(places[k][0], places[k][1]) for k in np.flatnonzero(post > 0.5)]


def _count_arrow(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        mass, seen = np.zeros(SLOTS), np.zeros(SLOTS)

        def add(slots: np.ndarray, m: np.ndarray, n: np.ndarray) -> None:
            two = slots[:, 0] != slots[:, 1]
            for cells, keep in ((slots[:, 0], slice(None)), (slots[two, 1], two)):
                np.add.at(mass, cells, m[keep])
                np.add.at(seen, cells, n[keep])

        start = np.array([_slot("S0")])
        for b in batches:
            first, post, slots, short = _batch_posteriors(model, b)
            if not len(post):
                continue
            loose = _flat(b.column(b.schema.names.index("loose")), bool)
            ones = np.ones(len(post))
            for k in range(6):
                add(slots[:, k], post, ones)
            for k in range(6, 9):
                add(slots[~loose, k], post[~loose], ones[~loose])
            add(slots[:, 10], post, 0 * ones)  # of the words before and behind a gap
            add(slots[:, 11], post, ones)
            add(slots[:, 12], 0 * ones, ones)
            add(np.array([_ANY_WORD]), post.sum(keepdims=True), ones.sum(keepdims=True))
            add(start, post.sum(keepdims=True), ones.sum(keepdims=True))
            at = np.flatnonzero(short)
            add(slots[at, 9], post[at] * post[at - 1], post[at - 1])
        used = np.flatnonzero((seen > 0) | (mass > 0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(mass[used]), pa.array(seen[used])], schema=_COUNTS)

    return run


def _model(raw: bytes) -> BoundaryModel:
    if not raw:
        return BoundaryModel()
    both = np.frombuffer(raw, np.float32)
    return BoundaryModel(both[:SLOTS], both[SLOTS:])


def _table(rows: DataFrame, static: np.ndarray | None = None) -> np.ndarray:
    both = np.zeros(2 * SLOTS) if static is None else static.copy()
    got = rows.groupBy("slot").agg(F.sum("mass").alias("mass"), F.sum("seen").alias("seen")).toPandas()
    slot = got["slot"].to_numpy(int)
    both[slot] += got["mass"].to_numpy(float)
    both[SLOTS + slot] += got["seen"].to_numpy(float)
    return both


def _features(texts: DataFrame, record_id: str, text: str, with_words: bool) -> DataFrame:
    picked = texts.filter(F.col(text).isNotNull()).select(F.col(record_id).cast("string").alias("id"), F.col(text).alias("t"))
    return staged(picked.mapInArrow(_features_arrow(with_words), _FEATURES_DDL))


def _fit(features: DataFrame, rounds: int) -> bytes:
    sc = features.sparkSession.sparkContext
    words = features.filter("word_slots is not null").select(F.explode(F.arrays_zip("word_slots", "word_mass", "word_seen")).alias("x"))
    static = _table(words.select(F.col("x.word_slots").alias("slot"), F.col("x.word_mass").alias("mass"), F.col("x.word_seen").alias("seen")))
    gaps = features.filter("seeds is not null").select("seeds", "short", "loose", "slots")
    raw = b""
    for _ in range(rounds + 1):
        raw = _table(gaps.mapInArrow(_count_arrow(sc.broadcast(raw)), _COUNTS_DDL), static).astype(np.float32).tobytes()
    return raw


def fit_boundaries(texts: DataFrame, record_id: str, text: str, rounds: int = ROUNDS) -> bytes:
    """The model's table, trained on all texts without labels: seeded counts, then re-estimated from posteriors.

    Texts are scanned once into features; each round is a pass over those. Tasks send merged counts, and the driver
    receives at most SLOTS rows.
    """
    return _fit(_features(texts, record_id, text, True), rounds)


def _pieces(text: str, lead: int, tail: int, cuts: Iterable[tuple[int, int]], model: BoundaryModel) -> list[tuple[int, int]]:
    """(start, end) of the sentences between boundaries (end, next); stretches of sparse marks are divided further."""
    out = []
    at = lead
    for e, nxt in (*cuts, (tail, tail)):
        if e - at > SPARSE and (inner := word_boundaries(model, text, at, e)):
            for x, y in inner:
                out.append((at, x))
                at = y
        out.append((at, e))
        at = nxt
    return [(a, a + len(text[a:b].rstrip())) for a, b in out if text[a:b].strip()]


_FOUND = pa.schema([("id", pa.string()), ("sentence_no", pa.int32()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("sentence", pa.string())])


def _split_arrow(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for b in batches:
            first, post, _, _ = _batch_posteriors(model, b)
            ids, texts, leads, tails, ends, nexts = (b.column(i).to_pylist() for i in range(6))
            rows = []
            for d, (i, t) in enumerate(zip(ids, texts)):
                if tails[d] == 0:
                    continue
                cuts = [(ends[d][c], nexts[d][c]) for c in np.flatnonzero(post[first[d] : first[d + 1]] > 0.5)]
                rows += [(i, k, x, y, t[x:y]) for k, (x, y) in enumerate(_pieces(t, leads[d], tails[d], cuts, model))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND)], schema=_FOUND)

    return run


def split_sentences(df: DataFrame, record_id: str, text: str, model: bytes | None = None) -> DataFrame:
    """(record_id, sentence_no, start_offset, end_offset, sentence): every text's sentences with their places.

    A hidden-event n-gram model puts boundary events between words: the event depends on the words and marks before
    it, the next word on the event; forward-backward posteriors above one half are boundaries. Events are possible
    behind final marks, quotations and line breaks and, in scripts without final marks, at spaces; in stretches of
    SPARSE words or more, and of SPARSE_MEANS mean lengths, that hold hardly a mark, between any two
    words; never inside a quotation or bracket, which belongs to the sentence that carries it. The model is trained on all texts given, from
    seeded guesses, unless one from `fit_boundaries` is passed.

    Defined results: null and blank texts have no sentences; a text without any boundary is one sentence, as are
    unmarked texts where no text with marks tells how sentences begin and end; unclosed
    quotations hold nothing together; rows of one record id and text that repeat count once; very long texts are read
    whole; an empty input gives no rows; other columns are ignored, whatever their names.
    """
    picked = df.select(F.col(record_id).cast("string").alias("id"), F.col(text).alias("t")).filter("t is not null").dropDuplicates(["id", "t"])
    features = _features(picked, "id", "t", model is None)
    raw = _fit(features, ROUNDS) if model is None else model
    rows = features.filter("seeds is not null").select("id", "text", "lead", "tail", "ends", "nexts", "seeds", "short", "slots")
    out = rows.mapInArrow(_split_arrow(df.sparkSession.sparkContext.broadcast(raw)), "id string, sentence_no int, start_offset int, end_offset int, sentence string")
    return out.select(F.col("id").alias(record_id), "sentence_no", "start_offset", "end_offset", "sentence")
