"""Whole-text encoding with the tokenizers library, through a bounded cache of chunks.

A text is cut only where no pre-token can span the cut and where the ids on either side do not depend on
the other side, so the ids of the chunks, put together, are the ids of the text. Chunks that were seen
before come from the cache; the rest are encoded many at a time, joined by a one-token separator.
"""

from __future__ import annotations

import ctypes
import gc
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import suppress
from itertools import chain

import numpy as np

SEP = "\ue000"
#: Characters of text that are handled at once (few enough for a processor's cache), and entries that a worker keeps; both bound memory.
SLICE_CHARS = 15_000
CACHE_ENTRIES = 500_000
CACHED_CHARS = 48
#: Marks that end words; none of them starts a contraction.
TAIL = ".,;:!?%$&*#|"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def text_slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Cut a long text before single spaces that stand between two non-space characters."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def spaced_chunks(text: str) -> list[str]:
    """For tokenizers that drop white space: words between spaces and line ends."""
    return text.replace("\n", " ").split(" ")


def led_chunks(text: str) -> list[str]:
    """For byte-level pre-tokens that carry a leading space: words with it, and line ends alone.

    The cuts hold only if every chunk passes :func:`led_regular`; else use :func:`led_slow`.
    """
    if SEP in text:
        return led_slow(text)
    return text.replace(" ", SEP + " ").replace("\n", f"{SEP}\n{SEP}").split(SEP)


def led_slow(text: str) -> list[str]:
    """The same for any text: cut only before single spaces between non-space characters."""
    return _SAFE_CUT.split(text)


def led_regular(chunk: str) -> bool:
    body = chunk[1:] if chunk[:1] == " " else chunk
    return chunk == "\n" or bool(body) and not body[0].isspace() and not body[-1].isspace()


def micro_batches(texts: Iterable[str], size: int = SLICE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """(position, slice) lists of about ``size`` characters; a long text spreads over several."""
    out: list[tuple[int, str]] = []
    n = 0
    for i, text in enumerate(texts):
        for part in text_slices(text, size):
            out.append((i, part))
            n += len(part)
            if n >= size:
                yield out
                out, n = [], 0
    if out:
        yield out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class CachedEncoder:
    """ids of whole texts, as little-endian unsigned 32-bit bytes, equal to ``encode(text).ids``.

    Which cuts are safe is read from the tokenizer's own file; with a pipeline that is not known here
    every text is encoded as a whole. A chunk of letters alone is one pre-token, so a second tokenizer of the
    same model takes it in its byte-level form, without the steps before the model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.cache: dict[str, bytes | bool] = {}
        self.kind, self.mark, self.glue = "whole", "", ""
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and norm is None:
            self.kind, self.mark, self.glue, self.plain_below = "led", "\n", "\n", "\u0530"
        elif before.get("type") == "Sequence" and before["pretokenizers"][0].get("behavior") == "Removed" and "\\s" in json.dumps(norm):
            # below U+0250 letters are as NFC leaves them, and lower case depends on no neighbour
            self.kind, self.mark, self.glue, self.plain_below = "spaced", "~", " ~ ", "\u0250"
        self.lower = '"Lowercase"' in json.dumps(norm)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(re.search(r"\s", s) for s in self.special):
            self.kind = "whole"
        if self.kind != "whole":
            symbols = byte_symbols()
            self.symbols = np.array([ord(c) for c in symbols], dtype="<u2")
            line_end = symbols[10]
            own = self.tokenizer.model  # the same without a cache of its own, which words seen once only slow down
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
            same = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
            self.bare = Tokenizer(models.BPE(spec["model"]["vocab"], merges, cache_capacity=0, **{k: v for k in same if (v := getattr(own, k)) is not None}))
            self.bare.pre_tokenizer = pre_tokenizers.Split(line_end, "isolated")
            ids, bare = self.tokenizer.encode(self.glue, add_special_tokens=False).ids, self.bare.encode(line_end).ids
            if len(ids) == len(bare) == 1:
                self.mark_id, self.bare_id = ids[0], bare[0]
            else:
                self.kind = "whole"

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _store(self, words: list[str], ids: list[int], mark: int) -> bool:
        """Put away the ids of words that were encoded with ``mark`` between them."""
        flat = np.array(ids, dtype="<u4")
        ends = np.flatnonzero(flat == mark)
        if len(ends) != len(words) - 1:  # a word holds the separator's token in another form
            return False
        buf, start, cache = flat.tobytes(), 0, self.cache
        for w, end in zip(words, [*(ends * 4).tolist(), len(buf)], strict=True):
            cache[w] = buf[start:end]
            start = end + 4
        return True

    def _plain(self, word: str) -> bool:
        """Letters alone, with or without one leading space: one pre-token whatever stands beside it."""
        body = word[1:] if word[:1] == " " else word
        return body.isalpha() and (body.isascii() or max(body) < self.plain_below and (not self.lower or body.lower() == body))

    def _learn(self, new: set[str]) -> None:
        """Encode chunks that aren't known; a word and the marks after it are two pre-tokens, known apart."""
        cache, plain_of, led = self.cache, self._plain, self.kind == "led"
        alone, tailed, plain, cores, other = [], [], [], set(), set()
        for w in new:
            body = w[1:] if w[:1] == " " else w
            if body.isalpha() and (body.isascii() or plain_of(w)):
                plain.append(w)
                continue
            core = w.rstrip(TAIL)
            if self.mark in w or len(w) > 1000 or self.special and any(map(w.__contains__, self.special)):
                alone.append(w)
            elif led and not led_regular(w):
                cache[w] = False  # a cut beside other white space
            elif len(core) < len(w) and core[-1:].isalnum():
                tailed.append((w, core, w[len(core) :]))
                cores.add(core)
                other.add(w[len(core) :])
            else:
                other.add(w)
        for core in cores.difference(cache).difference(new):
            if plain_of(core):
                plain.append(core)
            else:
                other.add(core)
        for w in alone:
            cache[w] = self._ids(w) if not led or w == "\n" or led_regular(w) else False
        for k in range(0, len(plain), 1000):
            part = plain[k : k + 1000]
            joined = "\n".join(part)
            mapped = self.symbols[np.frombuffer((joined.lower() if self.lower else joined).encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")
            if not self._store(part, self.bare.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, self.bare_id):
                other.update(part)
        words = list(other.difference(cache))
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            if not self._store(part, self.tokenizer.encode_batch_fast([self.glue.join(part)], add_special_tokens=False)[0].ids, self.mark_id):
                for w in part:
                    cache[w] = self._ids(w)
        for w, core, tail in tailed:
            cache[w] = cache[core] + cache[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return [self._ids(t) for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        cut = led_chunks if self.kind == "led" else spaced_chunks
        for batch in micro_batches(texts):
            if self.lower:  # as the normalizer would; a special string must stay as it is
                batch = [(i, self._lowered(part)) for i, part in batch]
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            known, found, new = self.cache.get, [], set()
            for _, part in batch:
                words = cut(part)
                ids = list(map(known, words))
                gaps = [k for k, x in enumerate(ids) if x is None]
                new.update([words[k] for k in gaps])
                found.append((ids, gaps, [words[k] for k in gaps]))
            self._learn(new)
            for (i, part), (ids, gaps, words) in zip(batch, found, strict=True):
                for k, w in zip(gaps, words, strict=True):
                    ids[k] = self.cache[w]
                try:
                    out[i].append(b"".join(ids))
                except TypeError:  # cut anew where it is safe
                    out[i].append(self._slow(part))
            for w in [w for w in new if len(w) > CACHED_CHARS]:
                del self.cache[w]
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _lowered(self, part: str) -> str:
        low = part.lower() if part.isascii() else part
        return part if low is not part and any(map(low.__contains__, self.special)) else low

    def _slow(self, part: str) -> bytes:
        return b"".join([self.cache.get(w) or self._ids(w) for w in led_slow(part)])


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


def release() -> None:
    """Drop the encoders that earlier tasks left in this worker process, and give their memory back to the system."""
    if _encoders:
        _encoders.clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)
