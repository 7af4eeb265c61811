"""Evaluation texts that leaked into training text.

The test items form an inverted index of word shingles with BM25 impacts, its posting lists cut into blocks that
know their greatest impact. Every passage of every document is a query: block-max WAND skips the items that cannot
reach the threshold and returns all others. What is retrieved is verified on the words themselves: how much of the
item stands in the document, in order, as one passage or two close ones, and whether the answer is there as well.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.session import written_table

#: The usual constants of BM25.
K1, B = 1.2, 0.75

BROKEN = re.compile(r"(?<=\w)[-‐­¬][ \t\r]*\n\s*(?=\w)|(?<=\w)[-‐‑­](?=\w)")
COMBINING = re.compile("[\u0300-\u036f\u200b-\u200d\u2060\ufeff]+")  # accents, and signs of no width
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words without case, accents, ligatures, emphasis and layout; a hyphen joins what it stands between."""
    if not text:
        return []
    low = text.casefold()
    if not low.isascii():
        low = COMBINING.sub("", unicodedata.normalize("NFKD", low))
    return WORDS.findall(BROKEN.sub("", low))


def word_key(word: str) -> int:
    """A positive number for a word, the same in every task and index."""
    return xxhash.xxh64_intdigest(word) >> 1 | 1


def run_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A key of each run of ``size`` words; 0 where one of them is in no item (has the id 0)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(size):
        part = ids[j : j + n]
        key = (key + part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        known &= part > 0
    return np.where(known, (key >> np.uint64(1)).astype(np.int64) | 1, 0)


@dataclass
class Counts:
    """Of all items, whatever block they are searched in: how many there are, their mean length, and in how many a run of words is."""

    items: int
    words: float
    runs: dict[int, int]


class ItemIndex:
    """Inverted index of the word runs of test items, with BM25 impacts scaled so that an item scores 1 on itself.

    An item of more than ``whole`` words scores as many times 1 as it has so many words, since a passage that is a query
    can hold only a part of it. Items shorter than a run are looked up as they are. Posting lists are slices of arrays.
    """

    def __init__(self, items: list[tuple[int, str, str]], size: int = 4, block: int = 64, whole: int = 128, counts: Counts | None = None):
        self.size, self.ids = size, [i for i, _, _ in items]
        words = [words_of(t) for _, t, _ in items]
        self.answers = [words_of(a) for _, _, a in items]
        self.word_id = {x: word_key(x) for w in words for x in w}
        self.words = [np.array([self.word_id[x] for x in w], np.int64) for w in words]
        self.short: dict[int, dict[tuple, list[int]]] = {}
        for n, w in enumerate(self.words):
            if 0 < len(w) < size:
                self.short.setdefault(len(w), {}).setdefault(tuple(w.tolist()), []).append(n)
        self.keys = [np.unique(run_keys(w, size)) for w in self.words]
        owner = np.repeat(np.arange(len(items)), [len(k) for k in self.keys])
        flat = np.concatenate([*self.keys, np.zeros(0, np.int64)])
        order = np.lexsort((owner, flat))
        flat, self.nos = flat[order], owner[order]
        self.sorted_keys, first = np.unique(flat, return_index=True)
        self.start = np.append(first, len(flat))
        total, mean = (counts.items, counts.words) if counts else (len(items), sum(map(len, words)) / max(1, len(items)))
        df = np.array([counts.runs[k] for k in self.sorted_keys.tolist()], float) if counts else np.diff(self.start).astype(float)
        length = np.array([len(w) for w in words], float)
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        norm = (K1 + 1) / (1 + K1 * (1 - B + B * length / (mean or 1.0)))
        impact = np.repeat(idf, np.diff(self.start)) * norm[self.nos]
        own = np.bincount(self.nos, impact, len(items))
        own[own == 0] = 1.0
        self.impact = impact / own[self.nos] * np.maximum(1.0, length / whole)[self.nos]
        # blocks of each posting list, with the last item and the greatest impact of each
        count = -(-np.diff(self.start) // block)
        self.block_start = np.append(0, np.cumsum(count))
        at = np.repeat(self.start[:-1], count) + block * (np.arange(count.sum()) - np.repeat(self.block_start[:-1], count))
        self.block_last = self.nos[np.append(at[1:], len(flat)) - 1] if len(at) else at
        self.block_top = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.top = np.maximum.reduceat(self.impact, self.start[:-1]) if len(first) else np.zeros(0)

    def posting(self, term: int) -> tuple[list[int], list[float]]:
        part = slice(self.start[term], self.start[term + 1])
        return self.nos[part].tolist(), self.impact[part].tolist()

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of the items stand, and their numbers in the index."""
        if not len(self.sorted_keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(keys)
        at = np.searchsorted(self.sorted_keys, keys[some])
        at[at == len(self.sorted_keys)] = 0
        good = self.sorted_keys[at] == keys[some]
        return some[good], at[good]

    def retrieve(self, terms: list[int], threshold: float) -> list[int]:
        """Block-max WAND: all items that score at least ``threshold`` on the terms."""
        lists = []
        for t in terms:
            nos, impact = self.posting(t)
            blocks = slice(self.block_start[t], self.block_start[t + 1])
            lists.append([nos[0], 0, nos, impact, float(self.top[t]), self.block_last[blocks].tolist(), self.block_top[blocks].tolist(), 0])
        found = []
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[4]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == doc:
                pivot += 1
            # the blocks that could hold the pivot
            limit, until = 0.0, None
            for x in lists[: pivot + 1]:
                while x[7] < len(x[5]) and x[5][x[7]] < doc:
                    x[7] += 1
                if x[7] < len(x[5]):
                    limit += x[6][x[7]]
                    until = x[5][x[7]] if until is None else min(until, x[5][x[7]])
            if limit >= threshold:
                if lists[0][0] == doc:
                    if sum(x[3][x[1]] for x in lists[: pivot + 1]) >= threshold:
                        found.append(doc)
                    target = doc + 1
                else:
                    target = doc
            else:
                target = (doc if until is None else until) + 1
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0])
                target = max(target, doc + 1)
            keep = []
            for i, x in enumerate(lists):
                if i <= pivot:
                    nos, p = x[2], x[1]
                    while p < len(nos) and nos[p] < target:
                        p += 1
                    if p == len(nos):
                        continue
                    x[0], x[1] = nos[p], p
                    while x[7] < len(x[5]) and x[5][x[7]] < nos[p]:
                        x[7] += 1
                keep.append(x)
            lists = keep
        return found

    def passages(self, doc: np.ndarray, item: int, slack: int = 6) -> list[tuple[int, int, int, int, int]]:
        """Stretches in which document and item run together: (doc from, doc to, item from, item to, equal words)."""
        ids = self.words[item].tolist()
        where: dict[tuple, list[int]] = defaultdict(list)
        for p in range(len(ids) - 2):
            where[tuple(ids[p : p + 3])].append(p)
        runs: dict[tuple[int, int], int] = {}
        open_runs: dict[int, tuple[int, int]] = {}
        words = doc.tolist()
        for k in range(len(words) - 2):
            for p in where.get((words[k], words[k + 1], words[k + 2]), ()):
                d = k - p
                start = open_runs.get(d)
                if start and start[0] + runs[start] - 3 == k - 1:
                    runs[start] += 1
                else:
                    open_runs[d] = (k, p)
                    runs[(k, p)] = 3
        out: list[list[int]] = []
        active: list[list[int]] = []
        for (k, p), n in sorted(runs.items()):
            active = [x for x in active if k - x[1] <= slack]  # later runs begin later still
            best = None
            for x in reversed(active):
                if max(0, x[1] - k, x[3] - p) < n and -3 <= k - x[1] and -3 <= p - x[3] <= slack:
                    best = x
                    break
            if best:
                over = max(0, best[1] - k, best[3] - p)
                # words that stand alone between two runs and are the same count too
                inner = len(set(words[best[1] : k]) & set(ids[best[3] : p])) if k > best[1] and p > best[3] else 0
                best[4] += n - over + inner
                best[1], best[3] = k + n, p + n
            else:
                out.append([k, k + n, p, p + n, n])
                active.append(out[-1])
        return [tuple(x) for x in out]

    def contained(self, doc: np.ndarray, item: int, apart: int = 80) -> tuple[int, int, int]:
        """Words of the item that the document has in order, as one passage or two close ones, and where they stand."""
        found = sorted(self.passages(doc, item))
        starts = [x[0] for x in found]
        best = max(((x[4], x[0], x[1]) for x in found), default=(0, 0, 0))
        for x in found:
            for i in range(bisect_left(starts, x[1] - 2), bisect_right(starts, x[1] + apart)):
                y = found[i]
                if x[3] <= y[2] + 2 and x is not y:
                    over = max(0, x[3] - y[2], x[1] - y[0])
                    best = max(best, (x[4] + y[4] - over, x[0], y[1]))
        return best


_FOUND = "doc_id bigint, item_id bigint, contained double, words int, item_words int, answer_near boolean"


def _search(items: list[tuple[int, str, str]], threshold: float, share: float, window: int, size: int, counts: Counts | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, size, counts=counts)
        get = index.word_id.get
        for b in batches:
            rows = []
            ids_of, lengths = [], []
            for text in b.column("text").to_pylist():
                w = words_of(text)
                ids_of.append([get(x, 0) for x in w])
                lengths.append(len(w))
            if not lengths:
                continue
            # one array for the whole batch, documents kept apart by unknown words
            gap = [0] * size
            flat = np.array([x for ids in ids_of for part in (ids, gap) for x in part], np.int64)
            starts = np.cumsum([0] + [n + size for n in lengths])
            doc_ids = b.column("doc_id").to_pylist()

            def report(n: int, item: int, same: int, last: int) -> tuple:
                total = len(index.words[item])
                answer = [index.word_id.get(x) or word_key(x) for x in index.answers[item]]
                after = ids_of[n][last : last + 2 * window]  # noqa: B023
                near = bool(answer) and any(after[i : i + len(answer)] == answer for i in range(len(after)))
                return doc_ids[n], index.ids[item], same / total, same, total, near  # noqa: B023

            for few, known in index.short.items():
                keys = run_keys(flat, few)
                keyed = {int(run_keys(np.array(k, np.int64), few)[0]): items for k, items in known.items()}
                for place in np.flatnonzero(np.isin(keys, list(keyed))).tolist():
                    n = int(np.searchsorted(starts, place, side="right")) - 1
                    rows += [report(n, item, few, place - int(starts[n]) + few) for item in keyed[int(keys[place])]]
            at, term = index.hits(run_keys(flat, size))
            owner = np.searchsorted(starts, at, side="right") - 1
            cuts = np.searchsorted(owner, np.arange(len(lengths) + 1))
            for n in np.unique(owner).tolist():
                place, terms = at[cuts[n] : cuts[n + 1]] - starts[n], term[cuts[n] : cuts[n + 1]]
                half = place // (window // 2)
                hot: set[int] = set()
                for h in np.unique(half).tolist():
                    near = np.unique(terms[(half == h) | (half == h + 1)])
                    if index.top[near].sum() >= threshold:
                        hot.update(index.retrieve(near.tolist(), threshold))
                doc = flat[starts[n] : starts[n] + lengths[n]]
                for item in sorted(hot):
                    same, _, last = index.contained(doc, item)
                    if same >= share * len(index.words[item]):
                        rows.append(report(n, item, same, last))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["doc_id", "item_id", "contained", "words", "item_words", "answer_near"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _item_runs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column("text").to_pylist()]
            keys = [np.unique(run_keys(np.array([word_key(x) for x in w], np.int64), size)).tolist() for w in words]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([len(w) for w in words], pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["item_id", "words", "keys"])

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, share: float = 0.42, threshold: float = 0.1, window: int = 64, size: int = 4, items_at_once: int = 50_000
) -> DataFrame:
    """Documents that contain at least half of a test item, in order, in one passage or two close ones.

    ``share`` is the share of the item's words that must be equal: half of them, less an allowance for changed words.

    Input: ``doc_id, text`` and ``item_id, text, answer``. Output: ``doc_id, item_id, contained, words, item_words,
    answer_near``. Every window of ``window`` words (they overlap by half) is a query; items that score ``threshold``
    of their own score or more are verified. Items of fewer than ``size`` words are found where all their words stand.
    The index is held by every task, so of more than ``items_at_once`` items a block at a time is searched against all
    documents; frequencies are those among all items, so the blocks change nothing. Rows with a null id are passed
    over, null and empty texts contain and are contained in nothing, repeated rows give one row, an empty table gives
    no row, further columns are ignored.
    """
    known = items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"), F.max("answer").alias("answer"))
    parts = max(1, -(-known.count() // items_at_once))
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    runs = written_table(known.select("item_id", "text").mapInArrow(_item_runs(size), "item_id bigint, words int, keys array<bigint>")) if parts > 1 else None
    total = runs.agg(F.count("*"), F.avg("words")).first() if parts > 1 else None
    spread = runs.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")) if parts > 1 else None
    out = None
    for part in range(parts):
        inside = f"pmod(xxhash64(item_id), {parts}) = {part}"
        rows = [tuple(r) for r in known.filter(inside).select("item_id", "text", "answer").orderBy("item_id").collect()]
        counts = None
        if parts > 1:
            own = runs.filter(inside).select(F.explode("keys").alias("key")).distinct()
            counts = Counts(total[0], float(total[1]), {r[0]: r[1] for r in own.join(spread, "key").collect()})
        found = docs.mapInArrow(_search(rows, threshold, share, window, size, counts), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["doc_id", "item_id"])
