"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

The merge list fixes how far ahead of a token's end anything can still change that token (`sufficient_lookahead`).
A `Transducer` therefore keeps a window of that many bytes plus a little, merges inside it, and emits each token as
soon as that many bytes follow it; its state does not grow with the word or the text. Every word goes through it; a
memo before it gives the ids of short words again that it has already encoded. Texts are cut into words by the
tokenizer's pattern in blocks, each word cut only where no later character can move the cut; a run that fills a block
is fed to the transducer slice by slice.

Results: null and empty texts give an empty id list and the text "". Rows are handled one by one, so ties, repeated
rows and very long texts need nothing special; extra columns are passed through, and a column named as an output
(`ids`, `decoded`) is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomscan.llm.common import Bounded, add_columns

#: Fixed value: the published pattern of byte-level BPE, by which texts are cut into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1 << 15
#: Words whose ids a task remembers, and texts handled at once.
WORDS_HELD, ROWS = 300_000, 64
#: Characters that may still move a cut before them: an apostrophe's two letters, and the one after a blank run.
MARGIN = 3


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level merge list: ids, merge ranks, token bytes and the sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        vocab = model["vocab"]
        to_bytes = lambda token: bytes(symbols[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.special else to_bytes(token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.triples = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): (r, t) for r, (a, b, t) in enumerate(self.triples)}
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Bytes after a token's end that can at most decide whether a merge crosses that end.

        Whether merge (u, v) happens hangs on v, and on an earlier merge taking v, or a part on v's right edge
        before v uses it up, to the right: then that merge's own reach counts. Ranks fall along such a chain, so
        one pass in rank order finds the longest.
        """
        made: dict[int, tuple[int, int]] = {}
        reach: dict[int, tuple[list[int], list[int]]] = {}  # by left part: ranks and greatest reach so far
        most = 0
        for r, (u, v, t) in enumerate(self.triples):
            far, part, limit = 0, v, r
            while True:
                ranks, best = reach.get(part, ((), ()))
                if k := bisect_left(ranks, limit):
                    far = max(far, best[k - 1])
                if part not in made:
                    break
                limit, part = made[part]
            far += len(self.bytes[v])
            ranks, best = reach.setdefault(u, ([], []))
            ranks.append(r)
            best.append(max(far, best[-1] if best else 0))
            most = max(most, far)
            made.setdefault(t, (r, v))
        return most


@functools.lru_cache(2)
def merges_of(path: str) -> Merges:
    """The merge list of a file, read once a process."""
    return Merges(path)


def merge(ids: list[int], rank: dict) -> list[int]:
    """Apply merges by rank, the leftmost first."""
    if len(ids) > 64:
        return merge_long(ids, rank)
    get, none = rank.get, (1 << 30, 0)
    found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
    while found:
        best = min(found)
        if best is none:
            break
        i = found.index(best)
        ids[i : i + 2] = [best[1]]
        del found[i]
        if i:
            found[i - 1] = get((ids[i - 1], ids[i]), none)
        if i < len(found):
            found[i] = get((ids[i], ids[i + 1]), none)
    return ids


def merge_long(ids: list[int], rank: dict) -> list[int]:
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
            continue
        ids[i], alive[j], after[i] = rank[pair][1], False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (p := (ids[a], ids[after[a]])) in rank:
                heapq.heappush(heap, (rank[p][0], a, p))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


class Transducer:
    """Feed a word's bytes piece by piece; tokens come out once no later byte can change them."""

    def __init__(self, merges: Merges, window: int = 1024):
        self.m, self.buffer = merges, b""
        self.window = merges.lookahead + window

    def _tokens(self) -> list[int]:
        return merge([self.m.byte_id[b] for b in self.buffer], self.m.rank)

    def feed(self, piece: bytes) -> Iterator[int]:
        for i in range(0, len(piece), self.window):
            self.buffer += piece[i : i + self.window]
            if len(self.buffer) < self.window:  # nothing new can be stable
                continue
            done, stable = 0, len(self.buffer) - self.m.lookahead
            for t in self._tokens():
                if done + len(self.m.bytes[t]) > stable:
                    break
                done += len(self.m.bytes[t])
                yield t
            self.buffer = self.buffer[done:]

    def finish(self) -> list[int]:
        out, self.buffer = self._tokens(), b""
        return out


class Encoder:
    def __init__(self, merges: Merges):
        self.m = merges
        self.transducer = Transducer(merges)
        pattern = regex.compile(WORDS)
        self.find, self.match = pattern.findall, pattern.match
        self.packed = Bounded(self._word, WORDS_HELD)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None

    def _word(self, word: str) -> bytes:
        return array("i", [*self.transducer.feed(word.encode()), *self.transducer.finish()]).tobytes()

    def ids(self, text: str) -> Iterator[bytes]:
        """Ids of a text's words as packed int32, as they become stable."""
        at, n, get = 0, len(text), self.packed.__getitem__
        while at < n:
            found, end = self.find(text, at, at + BLOCK), min(at + BLOCK, n)
            while end < n and found and end > at + BLOCK - MARGIN:
                end -= len(found.pop())
            if found:
                yield from map(get, found)
                at = end
            else:  # one run fills the block
                end = self.match(text, at).end()
                for i in range(at, end, BLOCK):
                    yield array("i", self.transducer.feed(text[i : min(i + BLOCK, end)].encode())).tobytes()
                yield array("i", self.transducer.finish()).tobytes()
                at = end

    def encode(self, text: str | None) -> bytes:
        """Ids as packed int32."""
        if not text:
            return b""
        out: list[bytes] = []
        pieces = self.split.split(text) if self.split and any(s in text for s in self.m.special) else [text]
        for piece in pieces:
            if piece in self.m.special:
                out.append(np.int32(self.m.special[piece]).tobytes())
            else:
                out.extend(self.ids(piece))
        return b"".join(out)


class TextState:
    """Ids in, text out: holds the bytes of an unfinished character between calls."""

    def __init__(self, token_bytes: list[bytes]):
        self.get = token_bytes.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.get, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def id_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def text_of(ids: np.ndarray, token_bytes: list[bytes]) -> str:
    state = TextState(token_bytes)
    return "".join([state.feed(ids[i : i + 4096].tolist()) for i in range(0, len(ids), 4096)]) + state.finish()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with its texts' token ids (array<int>). The tokenizer file is read here and broadcast: its size is fixed."""
    shared = df.sparkSession.sparkContext.broadcast(merges_of(path))

    def make():
        encoder = Encoder(shared.value)
        return lambda column: [id_lists([encoder.encode(s) for s in column.to_pylist()])]

    return add_columns(df, text, [(ids, "array<int>")], make, ROWS)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its token ids; a null list gives "", a byte sequence that is no text gives U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(merges_of(path).bytes)

    def make():
        table = shared.value

        def fn(column: pa.ListArray) -> list:
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(n or 0 for n in column.value_lengths().to_pylist())])
            return [[text_of(flat[a:b], table) for a, b in zip(ends, ends[1:], strict=False)]]

        return fn

    return add_columns(df, ids, [(text, "string")], make, ROWS)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with its texts' ids and with the text of those ids, in one pass over the texts."""
    shared = df.sparkSession.sparkContext.broadcast(merges_of(path))

    def make():
        encoder = Encoder(shared.value)

        def fn(column: pa.Array) -> list:
            packed = [encoder.encode(s) for s in column.to_pylist()]
            return [id_lists(packed), [text_of(np.frombuffer(p, np.int32), encoder.m.bytes) for p in packed]]

        return fn

    return add_columns(df, text, [(ids, "array<int>"), (decoded, "string")], make, ROWS)
