"""Encoding with a byte-level BPE vocabulary by a streaming transducer, and decoding byte by byte.

The encoding of a prefix is told by its last token alone: of all tokens that end at a position exactly
one goes with the last token of what comes before it (two tokens go together if the BPE of their joint
bytes gives back just these two).  So the encoder reads bytes one by one and keeps a link to the token
before for each position.  Whether a merge happens can only depend on bytes that a chain of overlapping
merges of falling rank reaches; how many these are at most follows from the merge list (`lookahead`).  A token
that ends so many bytes before the last one read can't change any more and is emitted, its links are dropped:
memory depends on the merge list only.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how a text falls into pieces that no merge crosses.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = 200_000  # pieces and pairs kept in memory; the tables are emptied when full
PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file of lines "base64 id"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """State of the encoder between bytes: links of the live positions, tokens not yet emitted."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.tails = {b[k:] for b in ranks for k in range(len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.alone: dict[int, bool] = {}
        self.most_pending = 0
        self.patience = 1024  # shorter pieces are held whole, and need no look-ahead
        self._lookahead: int | None = None

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short run of bytes: the definition that `fits` goes back to."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        hit = self.pairs.get((a, b))
        if hit is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.tokens[a], self.tokens[b]
            hit = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return hit

    def starts(self, a: int) -> bool:
        hit = self.alone.get(a)
        if hit is None:
            hit = self.alone[a] = self.merged(self.tokens[a]) == [self.tokens[a]]
        return hit

    def parts(self) -> dict[bytes, tuple[bytes, bytes]]:
        """The merge list: the two tokens that each longer token is made of."""
        out = {}
        for tok, r in self.ranks.items():
            if len(tok) > 1:
                cuts = [i for i in range(1, len(tok)) if self.ranks.get(tok[:i], r) < r and self.ranks.get(tok[i:], r) < r]
                if len(cuts) > 1:  # told by plain merging with the ranks below
                    p = [tok[i : i + 1] for i in range(len(tok))]
                    while len(p) > 2:
                        k = min(range(len(p) - 1), key=lambda i: self.ranks.get(p[i] + p[i + 1], r))
                        if self.ranks.get(p[k] + p[k + 1], r) >= r:
                            break
                        p[k : k + 2] = [p[k] + p[k + 1]]
                    cuts = [len(p[0])] if len(p) == 2 else []
                if cuts:
                    out[tok] = (tok[: cuts[0]], tok[cuts[0] :])
        return out

    def lookahead(self) -> int:
        """Bytes behind a token after which it can't change, from the merge list.

        A merge (u, v) fails if a token at the right edge of v is taken by a merge (p, q) of lower rank, which may
        itself fail for bytes behind q, and so on with ever lower ranks.  By rising rank, `reach` of a token is the
        furthest that the merges seen so far with it on the left can look.
        """
        if self._lookahead is None:
            made, reach = self.parts(), {}

            def edge(tok: bytes) -> int:
                far = reach.get(tok, 0)
                while tok in made:
                    tok = made[tok][1]
                    far = max(far, reach.get(tok, 0))
                return far

            for tok in sorted(made, key=self.ranks.__getitem__):
                u, v = made[tok]
                reach[u] = max(reach.get(u, 0), len(v) + edge(v))
            self._lookahead = max((edge(t) for t in self.ranks), default=0)
        return self._lookahead

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one piece's bytes, each as soon as it can't change."""
        window = bytearray()  # the last `longest` bytes
        link: dict[int, tuple[int, int]] = {}  # position -> (token that ends there, where it starts)
        done = n = 0  # emitted up to position `done`; bytes read
        last = -1
        for byte in data:
            window.append(byte)
            if len(window) > self.longest:
                del window[0]
            n += 1
            size, found = 1, None
            while size <= len(window):
                piece = bytes(window[-size:])
                if piece not in self.tails:
                    break
                tok, at = self.ranks.get(piece), n - size
                if tok is not None and at >= done:
                    before = link.get(at)
                    if (before is None and at == done and (done == 0 and self.starts(tok) or done and self.fits(last, tok))) or (before is not None and self.fits(before[0], tok)):
                        found = (tok, at)
                        break
                size += 1
            if found is None:
                raise ValueError("a byte isn't in the vocabulary")
            link[n] = found
            if n - done > self.patience and n - done > 2 * self.lookahead():
                path, p = [], n
                while p > done:
                    path.append((*link[p], p))
                    p = link[p][1]
                for tok, _, end in reversed(path):
                    if end > n - self.lookahead():
                        break
                    last, done = tok, end
                    yield tok
                link = {q: x for q, x in link.items() if q > done}
            self.most_pending = max(self.most_pending, n - done)
        rest = []
        while n > done:
            tok, n = link[n]
            rest.append(tok)
        yield from reversed(rest)

    def encode(self, text: str | None, out: array) -> None:
        """Append the ids of a text; null and empty texts have none."""
        if not text:
            return
        get = self.pieces.get
        for m in _PIECES(text):
            w = m.group()
            ids = get(w)
            if ids is None:
                ids = tuple(self.stream(w.encode("utf-8")))
                if len(w) <= 64:
                    if len(self.pieces) >= PIECES:
                        self.pieces.clear()
                    self.pieces[w] = ids
            out.extend(ids)


_PIECES = regex.compile(PATTERN).finditer


class ByteToText:
    """Incremental UTF-8: bytes in, characters out once complete; a broken sequence gives U+FFFD."""

    def __init__(self) -> None:
        self.code = self.need = self.low = 0
        self.high = 0xBF

    def feed(self, byte: int) -> str:
        out = ""
        if self.need:
            if self.low <= byte <= self.high:
                self.code = self.code << 6 | byte & 0x3F
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                return chr(self.code) if not self.need else ""
            self.need, out = 0, "�"
        self.low, self.high = 0x80, 0xBF
        if byte < 0x80:
            return out + chr(byte)
        if 0xC2 <= byte <= 0xDF:
            self.need, self.code = 1, byte & 0x1F
        elif 0xE0 <= byte <= 0xEF:
            self.need, self.code = 2, byte & 0x0F
            self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(byte, (0x80, 0xBF))
        elif 0xF0 <= byte <= 0xF4:
            self.need, self.code = 3, byte & 0x07
            self.low, self.high = {0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
        else:
            return out + "�"
        return out

    def end(self) -> str:
        out, self.need = ("�" if self.need else ""), 0
        return out


def decode(ids: Iterable[int], tokens: dict[int, bytes]) -> str:
    machine = ByteToText()
    return "".join(machine.feed(b) for i in ids for b in tokens[i]) + machine.end()


_BUILT: dict[int, Transducer] = {}


def _transducer(key: int, ranks: dict[bytes, int]) -> Transducer:
    if key not in _BUILT:  # once a Python worker
        _BUILT.clear()
        _BUILT[key] = Transducer(ranks)
    return _BUILT[key]


def encode_corpus(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """key and ids (array<int>) of each row, or key and n_tokens with `ids` off.

    `vocabulary` is the path of the file, read on the driver and sent once to each executor (fixed size,
    under 1 MB).  Null and empty texts have no ids: an empty array, 0 tokens.  Repeated rows come out as
    often as they come in.  Nothing is shuffled; memory is one Arrow batch, whatever the texts' length.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))
    name = hash(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(name, shared.value)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for s in batch.column(1):
                t.encode(s.as_py(), flat)
                offsets.append(len(flat))
            if ids:
                col = pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), col], ["key", "ids"])
            else:
                n = pa.array([b - a for a, b in zip(offsets, offsets[1:])], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), n], ["key", "n_tokens"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, " + ("ids array<int>" if ids else "n_tokens int"))
    return out.withColumnRenamed("key", key)
