"""Language of whole texts and of the stretches of mixed ones, by language-bitmask n-gram filters."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.lexicon import FILLER_WORDS, LANGS, label_lang, spoken_words

#: Labelled rows to fit on, at most: the documented bound of the classifier's sample.
FIT_ROWS = 20_000
#: Language of words that no filter knows.
UNKNOWN = "und"
SLOTS = 1 << 20
HASHES = 3
#: Words kept in a worker's memory between texts.
CACHE_WORDS = 400_000
#: Weight (words, or half characters where words are not spaced) from which a second language counts.
SECOND_WEIGHT = 5.5
SECOND_FOREIGN = 3.0
#: Log-likelihood ratio from which a word's spread over languages differs from that of all words.
TELLING = 5.0

_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー々"
_RUN = regex.compile(rf"[{_UNSPACED}]+|[\p{{L}}\p{{M}}]+(?:['’-][\p{{L}}\p{{M}}]+)*")
_IS_UNSPACED = regex.compile(rf"[{_UNSPACED}]")
_LETTER = regex.compile(r"\p{L}")


def _slots(key: str) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % SLOTS for i in range(HASHES)]


def _chars(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 4] for i in range(max(1, len(padded) - 3))]


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: slot arrays in which every slot holds one bit per language.

    `words` holds whole words and, of unspaced scripts, pairs of characters; `grams` holds four-character n-grams, used
    where a text's words are mostly unknown. Of a fixed size, whatever the data.
    """

    words: np.ndarray
    grams: np.ndarray
    false: np.ndarray = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        fill = [np.count_nonzero(self.words >> i & 1) / SLOTS for i in range(len(LANGS))]
        self.false = np.array([f**HASHES for f in fill])

    def mask(self, key: str, table: np.ndarray | None = None) -> int:
        """All languages whose filter contains the n-gram."""
        t = self.words if table is None else table
        a, b, c = _slots(key)
        return int(t[a] & t[b] & t[c])

    def to_bytes(self) -> bytes:
        return self.words.tobytes() + self.grams.tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> LanguageFilters:
        both = np.frombuffer(raw, np.uint16)
        return LanguageFilters(both[:SLOTS], both[SLOTS:])


def _units(text: str) -> list[str]:
    out: list[str] = []
    for run in _RUN.findall(text.lower()):
        if _IS_UNSPACED.match(run):
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
        else:
            out.append(run)
    return out


def fit_filters(labelled: list[tuple[str, str]]) -> LanguageFilters:
    """Filters from (label, text) rows, some of which are labelled wrongly or mixed.

    A first naive-Bayes pass keeps the rows whose text agrees with their label; an n-gram then gets the bit of each
    language in which its rate is at least a twentieth of its highest rate.
    """
    rows = [(LANGS.index(lang), Counter(_units(t))) for label, t in labelled if (lang := label_lang(label)) and t]
    n = len(LANGS)
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
    total = np.zeros(n)
    for lang, units in rows:
        for u, c in units.items():
            counts[u][lang] += c
            total[lang] += c
    floor = np.log(0.01 / (total + 0.01 * len(counts) + 1))
    logs = {u: np.log((c + 0.01) / (total + 0.01 * len(counts) + 1)) - floor for u, c in counts.items()}
    seen = total > 0
    kept: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
    mass = np.zeros(n)
    for lang, units in rows:
        size = sum(units.values())
        score = floor * size
        for u, c in units.items():
            score = score + logs[u] * c
        if size and int(np.argmax(np.where(seen, score, -np.inf))) == lang:
            for u, c in units.items():
                kept[u][lang] += c
                mass[lang] += c
    words, grams = np.zeros(SLOTS, np.uint16), np.zeros(SLOTS, np.uint16)
    rate_of, prior = 1 / np.maximum(mass, 1), np.maximum(mass, 1e-9) / max(mass.sum(), 1e-9)
    by_gram: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
    for u, c in kept.items():
        rate = c * rate_of
        bits = (rate >= rate.max() / 20) & ((c >= 2) | (c.sum() < 4))
        whole = c.sum()
        if not _IS_UNSPACED.match(u):
            for g in _chars(u):
                by_gram[g] += rate
            on = c > 0
            if float((c[on] * np.log(c[on] / whole / prior[on])).sum()) < TELLING:
                continue  # too rare, or a term used in every language
        elif whole < 2:
            continue
        m = int(sum(1 << i for i in range(n) if bits[i]))
        for s in _slots(u):
            words[s] |= m
    for g, rate in by_gram.items():
        m = int(sum(1 << i for i in range(n) if rate[i] >= rate.max() / 5))
        for s in _slots(g):
            grams[s] |= m
    return LanguageFilters(words, grams)


def _fit_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    yield pa.RecordBatch.from_pydict({"raw": [fit_filters(sorted(rows)).to_bytes()]}, schema=pa.schema([("raw", pa.binary())]))


def language_filters(df: DataFrame, label: str, text: str, max_rows: int = FIT_ROWS) -> LanguageFilters:
    """Filters fitted on a sample of at most `max_rows` distinct (label, text) rows, chosen by their hash.

    Hashes are compared before anything moves, so only about the sample is shuffled, copies of a text count once, and
    the bound holds whatever repeats. The sample is fitted in one task; what reaches the driver has a fixed size.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("l"), F.col(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("l", "t"))
    n = max(1, rows.agg(F.approx_count_distinct("h", 0.02)).first()[0])
    if n * 1.1 > max_rows:  # a tenth more than wanted are let through, and the limit below cuts to the bound
        rows = rows.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * max_rows / n)))
    sample = rows.dropDuplicates(["h"]).orderBy("h").limit(max_rows).select("l", "t")
    raw = sample.repartition(1).mapInArrow(_fit_arrow, "raw binary").collect()
    return LanguageFilters.from_bytes(raw[0][0]) if raw else fit_filters([])


class _Words(dict):
    """Token (as split at white space) to its code: a language mask, -1 for no word, or -2-i for entry i of `many`."""

    def __init__(self, filters: LanguageFilters) -> None:
        super().__init__()
        self.filters, self.pairs = filters, {}
        self.many: list[tuple[list[int], list[float]]] = []

    def __missing__(self, token: str) -> int:
        runs = _RUN.findall(token.lower())
        if not runs:
            code = -1
        elif len(runs) == 1 and not _IS_UNSPACED.match(runs[0]):
            code = -1 if runs[0] in FILLER_WORDS else self.filters.mask(runs[0])
        else:
            masks, weights = [], []
            for r in runs:
                if _IS_UNSPACED.match(r):
                    masks.append(self._unspaced(r))
                    weights.append(len(r) / 2)
                elif r not in FILLER_WORDS:
                    masks.append(self.filters.mask(r))
                    weights.append(1.0)
            code = -2 - len(self.many)
            self.many.append((masks, weights))
        self[token] = code
        return code

    def _unspaced(self, run: str) -> int:
        hits = [0] * len(LANGS)
        units = [run[i : i + 2] for i in range(len(run) - 1)] or [run]
        for u in units:
            m = self.pairs.get(u)
            if m is None:
                m = self.pairs[u] = self.filters.mask(u)
            for i in range(10, len(LANGS)):
                hits[i] += m >> i & 1
        most = max(hits)
        return sum(1 << i for i, h in enumerate(hits) if h and h >= 0.85 * most) if most >= 0.3 * len(units) else 0

    def trim(self) -> None:
        if len(self) > CACHE_WORDS or len(self.many) > CACHE_WORDS // 4:
            self.clear()
            self.many.clear()
        if len(self.pairs) > CACHE_WORDS:
            self.pairs.clear()


def _breaks(one: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Known words that end a stretch: those without the language, unless alone between two words that have it."""
    at = np.flatnonzero(one)
    on = has[at]
    lone = np.zeros(len(at), bool)
    lone[1:-1] = ~on[1:-1] & on[:-2] & on[2:]
    out = np.zeros(len(one), bool)
    out[at] = ~on & ~lone
    return out


def _stretches(m: np.ndarray, w: np.ndarray, main: int) -> list[tuple[int, float, int, int]]:
    """Other languages of one text: (language, confidence, first word, last word) of each stretch that counts."""
    out = []
    one = m > 0
    open_ = one & (m >> main & 1 == 0)
    tried: set[int] = set()
    while True:
        best = None
        weight = np.where(open_, w, 0.0)
        if weight.sum() < SECOND_FOREIGN:
            return out
        for lang in range(len(LANGS)):
            has = one & (m >> lang & 1 == 1)
            if lang == main or lang in tried or weight[has].sum() < SECOND_FOREIGN:
                continue
            run = np.cumsum(_breaks(one, has))
            size = np.bincount(run, np.where(has | (m == 0), w, 0.0))
            foreign = np.bincount(run, np.where(has, weight, 0.0))
            good = (size >= SECOND_WEIGHT) & (foreign >= SECOND_FOREIGN)
            if good.any() and (best is None or foreign[good].sum() > best[0]):
                best = (foreign[good].sum(), lang, has, run, good)
        if best is None:
            return out
        _, lang, has, run, good = best
        tried.add(lang)
        for r in np.flatnonzero(good):
            inside = np.flatnonzero((run == r) & has)
            first, last = int(inside[0]), int(inside[-1])
            out.append((lang, float(w[inside].sum() / max(w[first : last + 1][one[first : last + 1]].sum(), 1e-9)), first, last))
            open_[first : last + 1] = False


def _by_chars(filters: LanguageFilters, text: str) -> np.ndarray:
    hits = np.zeros(len(LANGS))
    for run in _RUN.findall(text.lower()):
        if _IS_UNSPACED.match(run):
            continue
        grams = [filters.mask(g, filters.grams) for g in _chars(run)]
        for i in range(len(LANGS)):
            hits[i] += sum(g >> i & 1 for g in grams) / len(grams)
    return hits


class Identifier:
    """Languages of batches of texts. Keeps a bounded cache of words between batches."""

    def __init__(self, filters: LanguageFilters) -> None:
        self.filters, self.words = filters, _Words(filters)
        pop = np.array([bin(i).count("1") for i in range(1 << len(LANGS))])
        self.share = 1 / np.maximum(pop, 1)

    def main(self, texts: list[str | None], hints: list[str | None] | None = None):
        """Per text the main language (-1: none), its confidence, and (language, confidence, first, last) stretches."""
        get = self.words.__getitem__
        self.words.trim()
        codes: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        spread: list[tuple[int, int]] = []
        for d, t in enumerate(texts):
            if t:
                codes.extend(map(get, t.split()))
            ends[d + 1] = len(codes)
        m = np.array(codes, np.int64)
        w = np.ones(len(m))
        if len(m) and m.min() < -1:
            many = self.words.many
            at = np.flatnonzero(m < -1)
            size = np.ones(len(m), np.int64)
            size[at] = [len(many[-2 - m[i]][0]) for i in at]
            start = np.concatenate([[0], np.cumsum(size)])
            wide, weights = np.repeat(m, size), np.ones(int(start[-1]))
            for i in at:
                masks, ws = many[-2 - m[i]]
                wide[start[i] : start[i + 1]] = masks
                weights[start[i] : start[i + 1]] = ws
            m, w, ends = wide, weights, start[ends]
        n = len(texts)
        doc = np.repeat(np.arange(n), np.diff(ends))
        words = np.bincount(doc[m >= 0], w[m >= 0], minlength=n) if len(m) else np.zeros(n)
        known = m > 0
        dk, mk, wk = doc[known], m[known], w[known]
        hits = np.zeros((n, len(LANGS)))
        fine = wk * self.share[mk] if len(mk) else wk
        tie = np.zeros((n, len(LANGS)))
        for i in range(len(LANGS)):
            on = (mk >> i & 1).astype(bool)
            if on.any():
                hits[:, i] = np.bincount(dk[on], wk[on], minlength=n)
                tie[:, i] = np.bincount(dk[on], fine[on], minlength=n)
        seen = np.bincount(dk, wk, minlength=n) if len(mk) else np.zeros(n)
        hits = np.maximum(0, (hits - seen[:, None] * self.filters.false) / (1 - self.filters.false))
        self.hits = hits
        score = hits + 0.01 * tie
        low = np.flatnonzero((words > 0) & (seen < 0.3 * words))
        for d in low:
            score[d] += 0.5 * _by_chars(self.filters, texts[d])
        best = score.argmax(1)
        top = score[np.arange(n), best] if n else np.zeros(0)
        if hints is not None:
            for d, h in enumerate(hints):
                if h is not None and top[d] > 0 and hits[d, (i := LANGS.index(h))] >= hits[d, best[d]] - 1e-9 and score[d, i] > 0:
                    best[d] = i
        for d in np.flatnonzero((words > 0) & (words <= 8)):
            if not spoken_words(texts[d]):
                words[d] = 0
        best[(top <= 0) | (words == 0)] = -1
        sure = np.minimum(1.0, hits[np.arange(n), np.maximum(best, 0)] / np.maximum(words, 1e-9)) if n else np.zeros(0)
        away = known & ((m >> np.maximum(best, 0)[doc] & 1) == 0) if len(m) else known
        odd = np.bincount(doc[away], w[away], minlength=n) if len(m) else np.zeros(n)
        others: dict[int, list] = {}
        for d in np.flatnonzero((odd >= SECOND_FOREIGN) & (best >= 0)):
            if found := _stretches(m[ends[d] : ends[d + 1]], w[ends[d] : ends[d + 1]], int(best[d])):
                others[int(d)] = found
        return best, sure, words, others


_FOUND = pa.schema([("record_id", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("is_main", pa.bool_()), ("label_fits", pa.bool_())])
_FOUND_DDL = "record_id string, lang string, confidence double, first_word int, last_word int, is_main boolean, label_fits boolean"


def _identify(shared, cases_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Identifier(LanguageFilters.from_bytes(shared.value))
        for b in batches:
            ids, labels, texts = (b.column(i).to_pylist() for i in range(3))
            named = [label_lang(x) for x in labels]
            best, sure, words, others = who.main(texts, named)
            rows = [(ids[d], UNKNOWN, 0.0, 0, int(math.ceil(words[d])) - 1, True, False) for d in np.flatnonzero((best < 0) & (words > 0))]
            for d in np.flatnonzero(best >= 0):
                lang, more = LANGS[best[d]], others.get(int(d), ())
                fits = named[d] == lang
                if cases_only and fits and not more:
                    continue
                rows.append((ids[d], lang, float(sure[d]), 0, int(math.ceil(words[d])) - 1, True, fits))
                rows += [(ids[d], LANGS[x[0]], x[1], x[2], x[3], False, fits) for x in more]
            cols = list(zip(*rows)) if rows else [[]] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND)], schema=_FOUND)

    return run


def identify_languages(df: DataFrame, record_id: str, label: str, text: str, filters: LanguageFilters, cases_only: bool = False) -> DataFrame:
    """Language and confidence of every text, and of each stretch of a mixed one.

    Returns (record_id, lang, confidence, first_word, last_word, is_main, label_fits); one row for the main language
    and one for each stretch in another language of about six running words, or twelve characters where words are not
    spaced. `label_fits` tells whether `label` names the main language in any spelling. The confidence is the share of
    words that the language's filter contains, corrected for the filters' false positives. With `cases_only` records
    that are wholly in the language of their label are left out before anything leaves the worker.

    Defined results: null, blank and wordless texts give no rows (hesitation sounds and annotations are no words); a
    text none of whose words or n-grams is known has the language `und` with confidence 0; on a tie the label's language wins, otherwise the first of
    LANGS; repeated rows repeat; very long texts are read whole; other columns are ignored, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters.to_bytes())
    picked = df.select(F.col(record_id).cast("string").alias("record_id"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    return picked.filter(F.col("text").isNotNull()).mapInArrow(_identify(shared, cases_only), _FOUND_DDL)
