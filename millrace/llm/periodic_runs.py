"""Runs of periodic words, found through minimizers at several scales.

A run is a stretch of words with smallest period q (words q apart are equal), at least `least` words
and two periods long, that neither neighbour extends. Periods below `direct` are found by comparing
the words with themselves at each lag. Longer ones are found scale by scale, periods from Q to 2Q at
a time, with k-grams of k = Q / 4 words:

* A window of Q words and the window one period later hold the same words, so their least k-gram hash
  is the same and stands at the same place. Window minima with equal hashes between Q and 2Q apart
  therefore seed every such run, if k-grams inside a run of period k / 2 or less are left out: others
  can't overlap themselves by half, so only a few equal ones stand within 2Q words.
* If the whole period consists of k-grams that were left out, it is itself periodic with some p of at
  most Q / 8. Then the run's halves lie in two neighbouring runs of period p, which are known from a
  smaller scale, and their phases give the only possible q modulo p.

Each seed is extended in both directions by comparing hashes of blocks, and what was found is compared
word by word. So the result is exact and nothing is capped; hashes only propose.

The texts of an Arrow batch are laid out in one array, the longest first, with a word of its own after
each, so that no run crosses texts and a scale works on the texts that are long enough.

Cases: a null or empty text has no words, no runs, and collapses to the empty text. Repeated rows count
each, null ids stay. An empty table gives no rows. Only the id and text columns are read, so others can't
clash. Memory grows with the longest text, by about 100 bytes a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_of, field_type, in_arrow, text_bytes

#: Words of the shortest run.
LEAST = 12
#: Periods below this are found lag by lag.
DIRECT = 48
PRIME = (1 << 31) - 1
BASE = 1_403_580_811
NOTHING = np.empty((3, 0), np.int64)

Edit = Callable[[object, list[bytes]], list[bytes]]


@dataclass
class Layout:
    """Texts as one array of word numbers: text t is `words[starts[t]:starts[t] + sizes[t]]`."""

    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.words)
        powers = np.ones(n + 1, np.int64)
        done, step = 1, BASE
        while done <= n:
            more = min(done, n + 1 - done)
            powers[done : done + more] = powers[:more] * step % PRIME
            step = step * step % PRIME
            done += more
        self.powers = powers
        self.sums = np.zeros(n + 1, np.int64)
        np.cumsum((self.words.astype(np.int64) + 1) * powers[:n] % PRIME, out=self.sums[1:])
        self.order = np.argsort(self.starts)

    def upto(self, size: int) -> int:
        """Words of the texts with at least `size` words, which stand first."""
        n = int(np.searchsorted(-self.sizes, -size, side="right"))
        return int(self.starts[n - 1] + self.sizes[n - 1]) if n else 0

    def grams(self, k: int, n: int) -> np.ndarray:
        """Hash of the k words from each place of the first n words on."""
        block = (self.sums[k : n + 1] - self.sums[: n - k + 1]) % PRIME
        top = len(self.words)
        return block * self.powers[top - n + k : top + 1][::-1] % PRIME

    def same_blocks(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words from `at` seem equal to those `lag` later."""
        left = (self.sums[at + size] - self.sums[at]) % PRIME
        right = (self.sums[at + lag + size] - self.sums[at + lag]) % PRIME
        return left * self.powers[lag] % PRIME == right

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def lay_out(texts: list[np.ndarray]) -> tuple[Layout, list[int]]:
    """The layout of texts of word numbers, and which text each of its texts is."""
    order = sorted(range(len(texts)), key=lambda t: -len(texts[t]))
    sizes = np.array([len(texts[t]) for t in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if order else np.empty(0, np.int64)
    top = max((int(texts[t].max()) for t in order if len(texts[t])), default=-1) + 1
    words = np.empty(int(sizes.sum()) + len(order), np.int64)
    for place, t in enumerate(order):
        words[starts[place] : starts[place] + sizes[place]] = texts[t]
        words[starts[place] + sizes[place]] = top + place
    return Layout(words, starts, sizes), order


def by_lag(words: np.ndarray, lag: int, least: int) -> np.ndarray:
    """Stretches of at least `least` words in which words `lag` apart are equal, as (start, end, lag)."""
    breaks = np.flatnonzero(words[:-lag] != words[lag:])
    edges = np.concatenate([[-1], breaks, [len(words) - lag]])
    long = np.flatnonzero(np.diff(edges) - 1 >= least - lag)
    start, end = edges[long] + 1, edges[long + 1] + lag
    return np.stack([start, end, np.full(len(start), lag, np.int64)])


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """One run of those with the same start and end: that of the smallest period."""
    if not runs.shape[1]:
        return runs
    runs = runs[:, np.lexsort(runs[[2, 1, 0]])]
    first = np.ones(runs.shape[1], bool)
    first[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)
    return runs[:, first]


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """`pick` over each window of `width` values."""
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[:-rest], values[rest:]) if rest else values


def window_minima(keys: np.ndarray, width: int, none: int) -> np.ndarray:
    """Places whose key is the least of a window of `width` keys that holds them; `none` is no key."""
    least = _slide(keys, width, np.minimum)
    edge = np.full(width - 1, -1, np.int64)
    most = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero((keys == most) & (keys != none))


def _seeds_of_minima(layout: Layout, n: int, scale: int, known: np.ndarray) -> np.ndarray:
    """Places and lags from `scale` to twice that at which equal window minima stand."""
    k = scale // 4
    keys = layout.grams(k, n)
    none = PRIME
    inside = known[:, (known[2] <= k // 2) & (known[1] - known[0] >= k) & (known[1] <= n)]
    if inside.shape[1]:
        change = np.zeros(len(keys) + 1, np.int32)
        np.add.at(change, inside[0], 1)
        np.add.at(change, inside[1] - k + 1, -1)
        keys = np.where(np.cumsum(change[:-1]) > 0, none, keys)
    places = window_minima(keys, scale - k + 1, none)
    places = places[np.argsort(keys[places], kind="stable")]
    found, step, left = [], 1, np.arange(len(places))
    while True:
        left = left[left + step < len(places)]
        apart = places[left + step] - places[left]
        near = (keys[places[left + step]] == keys[places[left]]) & (apart < 2 * scale)
        left, apart = left[near], apart[near]
        if not len(left):
            break
        far = apart >= scale
        found.append(np.stack([places[left[far]], apart[far]]))
        step += 1
    return np.concatenate(found, axis=1) if found else NOTHING[:2]


def _seeds_between_runs(layout: Layout, scale: int, known: np.ndarray) -> np.ndarray:
    """Places and lags from `scale` to twice that whose period is itself part of a shorter-period run."""
    part = known[:, (known[2] <= scale // 8) & (known[1] - known[0] >= scale)]
    part = part[:, np.lexsort(part[[0, 2]])]
    next_to = np.flatnonzero((part[2, 1:] == part[2, :-1]) & (part[0, 1:] <= part[1, :-1]))
    found = []
    for i in next_to:
        (start, end, p), (start2, end2, _) = part[:, i].tolist(), part[:, i + 1].tolist()
        own = layout.words[start2 : start2 + p]
        turns = np.lib.stride_tricks.sliding_window_view(layout.words[start : start + 2 * p - 1], p)
        turn = np.flatnonzero(turns[:, 0] == own[0])
        turn = next((t for t in turn if np.array_equal(turns[t], own)), None)
        if turn is None:
            continue
        rest = (start2 - start - int(turn)) % p
        lags = np.arange(scale + (rest - scale) % p, 2 * scale, p, dtype=np.int64)
        middle = np.maximum(start2, start + lags)
        fits = middle <= np.minimum(end, end2 - lags)
        found.append(np.stack([middle - lags, lags])[:, fits])
    return np.concatenate(found, axis=1) if found else NOTHING[:2]


def _reach(layout: Layout, at: np.ndarray, lag: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """Words after (or before) `at` that seem equal to those `lag` later; at least the true number."""
    low, high = np.zeros(len(at), np.int64), limit + 1
    while (open_ := high - low > 1).any():
        middle = np.where(open_, (low + high) // 2, low)
        equal = layout.same_blocks(at - middle if back else at, lag, middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle)
    return low


def extended(layout: Layout, seeds: np.ndarray) -> np.ndarray:
    """The runs through the seeds that are two periods long, as (start, end, lag)."""
    if not seeds.shape[1]:
        return NOTHING
    at, lag = np.unique(seeds, axis=1)
    text = layout.text_of(at)
    ends = layout.starts[text] + layout.sizes[text]
    inside = at + lag < ends
    at, lag, text, ends = at[inside], lag[inside], text[inside], ends[inside]
    after = _reach(layout, at, lag, ends - at - lag, back=False)
    before = _reach(layout, at, lag, at - layout.starts[text], back=True)
    long = after + before >= lag
    at, lag = at[long], lag[long]
    runs = np.stack([at - before[long], at + lag + after[long], lag])
    runs, first = np.unique(runs, axis=1, return_index=True)
    exact = []
    for (start, end, q), seed in zip(runs.T.tolist(), at[first].tolist()):
        differ = np.flatnonzero(layout.words[start : end - q] != layout.words[start + q : end]) + start
        if len(differ):  # hashes were equal where words are not
            start = int(max(differ[differ < seed], default=start - 1)) + 1
            end = int(min(differ[differ >= seed], default=end - q)) + q
        if end - start >= 2 * q:
            exact.append((start, end, q))
    return np.array(exact, np.int64).reshape(-1, 3).T


def find_runs(layout: Layout, least: int = LEAST, direct: int = DIRECT) -> np.ndarray:
    """All runs of all texts, as (start, end, period) in the array, by start and end."""
    if direct < 8 or direct & 7:
        raise ValueError("direct must be a multiple of 8")
    shortest = min(least, direct // 4)  # the scales need runs of a k-gram's length
    found = [NOTHING]
    for lag in range(1, direct):
        size = max(shortest, 2 * lag)
        if n := layout.upto(size):
            found.append(by_lag(layout.words[:n], lag, size))
    known = smallest_periods(np.concatenate(found, axis=1))
    scale = direct
    while n := layout.upto(2 * scale):
        seeds = np.concatenate([_seeds_of_minima(layout, n, scale, known), _seeds_between_runs(layout, scale, known)], axis=1)
        known = smallest_periods(np.concatenate([known, extended(layout, seeds)], axis=1))
        scale *= 2
    return known[:, known[1] - known[0] >= np.maximum(least, 2 * known[2])]


def runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None,
    least: int = LEAST, direct: int = DIRECT,
) -> DataFrame:
    """Per row: the id, `n_words`, `runs` (start, length and period in words, in that order) and `collapsed`,
    the words that no run holds after its first period, joined by spaces.

    `edit` may change a text's words, given its id, before they are searched.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.split() for t in text_bytes(batch.column(1))]
            if edit:
                texts = [edit(i, t) for i, t in zip(batch.column(0).to_pylist(), texts)]
            known: dict[bytes, int] = defaultdict()
            known.default_factory = known.__len__
            layout, order = lay_out([np.fromiter(map(known.__getitem__, t), np.int64, len(t)) for t in texts])
            found = find_runs(layout, least, direct)
            listed, collapsed = [[] for _ in texts], list(texts)
            place = layout.text_of(found[0]) if len(layout.starts) else NOTHING[0]
            rows = np.stack([place, found[0] - layout.starts[place], found[1] - found[0], found[2]], axis=1).tolist()
            for place_, start, length, period in rows:
                listed[order[place_]].append((start, length, period))
            for t, own in enumerate(listed):
                own.sort()
                if own:
                    keep = np.ones(len(texts[t]), bool)
                    for start, length, period in own:
                        keep[start + period : start + length] = False
                    collapsed[t] = [texts[t][i] for i in np.flatnonzero(keep)]
            schema = pa.schema([batch.schema.field(0), ("n_words", pa.int64()), ("runs", RUNS), ("collapsed", pa.string())])
            shown = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in listed]
            plain = pa.array([b" ".join(t) for t in collapsed], pa.binary()).cast(pa.string())
            yield batch_of(schema, batch.column(0), [len(t) for t in texts], shown, plain)

    out = (
        f"`{id_col}` {field_type(docs, id_col)}, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    return in_arrow(docs.select(id_col, F.col(text_col).cast("string")), each, out)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def longest(found: str = "runs") -> Column:
    """The longest run of a list (ties: smallest start, then period), or null."""
    ranked = F.transform(
        found, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))
    )
    return F.array_min(ranked)


def as_text(found: str = "runs") -> Column:
    """`start,length,period` and a line feed per run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(found, line), "")
