"""Token counts of whole texts by rank-synchronous merging of ragged numpy arrays.

New pre-tokens of a batch lie end to end in one flat array of symbols. In every round each sequence applies
its lowest-rank pair, all of its occurrences at once (left to right where they overlap); a sequence with no
pair left leaves the arrays with its number of symbols. That equals one merge at a time, because in a
trained vocabulary a pair that holds a merged symbol ranks after the merge that made it; the constructor
checks this. Counts are kept by chunk in a bounded cache a worker.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts count as one
token each, the library's default; one pre-token of any length is counted exactly (beyond LONG symbols by a
heap over a linked list, which needs n log n steps where rounds would need many); repeated rows and null ids
give a row each; an empty table gives no rows; more columns of the input are left out.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .encoding import CACHE_ENTRIES, CACHED_CHARS, byte_symbols, led_chunks, led_regular, led_slow, micro_batches

LONG = 4096
#: Characters whose new pre-tokens are merged together; bounds memory.
BATCH_CHARS = 1_000_000
_NONE = np.int64(1 << 40)
#: Fixed value: the pre-token pattern of byte-level BPE files that name no own one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Counts for one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normalizer are counted this way")
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        vocab = model["vocab"]
        self.first = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        born = {int(m): r for r, m in enumerate(made)}
        if any(max(born.get(vocab[a], -1), born.get(vocab[b], -1)) >= r for r, (a, b) in enumerate(pairs)):
            raise ValueError("a merge ranks before one that makes its part")
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.cache: dict[str, int | None] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge_counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each word keeps."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        counts = lengths.copy()
        live = np.flatnonzero((lengths > 1) & (lengths <= LONG))
        for k in np.flatnonzero(lengths > LONG):
            counts[k] = self._long(words[k])
        if not len(live):
            return counts
        sym = self.first[np.frombuffer(b"".join([words[k] for k in live]), dtype=np.uint8)]
        size = lengths[live]
        start = np.cumsum(size) - size
        rank = np.full(len(sym), _NONE)
        rank[:-1] = self._ranks(sym[:-1], sym[1:])
        rank[start + size - 1] = _NONE  # the last symbol of a sequence starts no pair
        while len(live):
            low = np.minimum.reduceat(rank, start)
            done = low == _NONE
            if done.any():
                counts[live[done]] = size[done]
                keep = np.repeat(~done, size)
                sym, rank = sym[keep], rank[keep]
                live, size, low = live[~done], size[~done], low[~done]
                if not len(live):
                    break
                start = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(low, size))
            if len(hit) > 1:  # of overlapping pairs, every second one from the left
                follows = np.empty(len(hit), dtype=bool)
                follows[0] = False
                np.equal(hit[1:], hit[:-1] + 1, out=follows[1:])
                if follows.any():
                    run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
                    hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            ends = np.zeros(len(sym), dtype=bool)
            ends[start + size - 1] = True
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            ends[hit] |= ends[hit + 1]
            owner = np.searchsorted(start, hit, side="right") - 1
            size = size - np.bincount(owner, minlength=len(size))
            new_at = np.cumsum(keep) - 1
            at = new_at[hit]
            sym, rank, ends = sym[keep], rank[keep], ends[keep]
            start = np.cumsum(size) - size
            stale = np.concatenate((at, at[at > 0] - 1))
            stale = stale[~ends[stale]]
            rank[at] = _NONE
            rank[stale] = self._ranks(sym[stale], sym[stale + 1])
        return counts

    def _long(self, word: bytes) -> int:
        """One long word: a heap of (rank, position) over a linked list."""
        sym = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks = self._ranks(np.array(sym[:-1]), np.array(sym[1:])).tolist()
        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(heap)
        table = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True))
        base, made, left = int(self.base), self.made.tolist(), n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            left -= 1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := table.get(sym[x] * base + sym[y])) is not None:
                    heapq.heappush(heap, (q, x, sym[x], sym[y]))
        return left

    def _count_new(self, chunks: list[str]) -> list[int]:
        """Counts of chunks that aren't cached, all of their unseen pre-tokens merged together."""
        split, fixed = [], []
        for c in chunks:
            parts = [c]
            n = 0
            if self.special is not None and self.special.search(c):
                parts = self.special.split(c)
                n = len(parts) - 1
            split.append([w for p in parts for w in self.pattern.findall(p)])
            fixed.append(n)
        words = list({w for ws in split for w in ws})
        known = dict(zip(words, self.merge_counts([w.encode() for w in words]).tolist(), strict=True))
        return [n + sum(known[w] for w in ws) for n, ws in zip(fixed, split, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for batch in micro_batches(texts, BATCH_CHARS):
            chunks = [led_chunks(part) for _, part in batch]
            new = set(chain.from_iterable(chunks)).difference(self.cache)
            if len(self.cache) + len(new) > CACHE_ENTRIES and self.cache:
                self.cache.clear()
                new = set(chain.from_iterable(chunks))
            good = [w for w in new if led_regular(w)]
            self.cache.update(dict.fromkeys(new))  # a chunk with no count: its text is cut anew
            self.cache.update(zip(good, self._count_new(good), strict=True))
            for (i, part), words in zip(batch, chunks, strict=True):
                try:
                    out[i] += sum(map(self.cache.__getitem__, words))
                except TypeError:
                    out[i] += self._slow(part)
            for w in [w for w in new if len(w) > CACHED_CHARS]:
                del self.cache[w]
        return out

    def _slow(self, part: str) -> int:
        words = led_slow(part)
        new = list({w for w in words if self.cache.get(w) is None})
        known = dict(zip(new, self._count_new(new), strict=True))
        return sum(known[w] if w in known else self.cache[w] for w in words)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def _counted(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            n = own.count(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. No shuffle."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("text"))
    return rows.mapInArrow(partial(_counted, tokenizer), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
