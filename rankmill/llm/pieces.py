"""Encoding and decoding with a SentencePiece byte-pair model by a max-plus scan.

A text's pieces are a path in the lattice of its substrings that are pieces. A sequence of pieces is the
byte-pair encoding of a text exactly if every two neighbours are the encoding of their own
concatenation, so two adjacent arcs weigh zero if they are compatible in this sense and minus infinity
if not, and the encoding is the one path of finite weight. In the (max, +) semiring, a chunk of a giant
text is a transfer matrix from the arcs that cross its left cut to the arcs that cross its right cut.
Matrices combine associatively, first in blocks and then along the blocks; the arc at every cut follows,
and each chunk is backtraced on its own. Weights are only 0 and minus infinity, so a matrix is kept
as bits.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.common import small_batches
from rankmill.session import scratch_path

SPACE = "▁"
#: Stands for a literal U+2581 while encoding; a lone surrogate, so no text holds it.
_LITERAL = "\udc81"
#: Characters of a chunk; longer texts are encoded chunk by chunk.
CHUNK = 16384
#: Chunks that are combined to one matrix before the scan along a text.
BLOCK = 256
#: Rows of an Arrow batch; texts and their ids are long.
ARROW_ROWS = 500
#: Words of a generation that a task remembers.
REMEMBERED = 200_000
#: Chunks that leave a task at once.
CUT_ROWS = 64
_CUT = ["key", "no", "part", "begin", "end", "last", "literal"]
_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
Arc = tuple[int, int, int]  # start, end, piece id; an unknown character has the id -1 - code point


class Remembered(dict):
    """Results of ``solve`` by word. Of two generations of ``limit`` words the older one is dropped when the
    younger is full, so words that come again and again stay."""

    def __init__(self, solve, limit: int = REMEMBERED):
        super().__init__()
        self.solve, self.limit, self.older = solve, limit, {}

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = self.solve(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class Pieces:
    """The vocabulary, pair compatibility and the lattice of one model."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int]):
        """``byte_ids``: ids of the 256 byte pieces; ``special``: ids that no text encodes to."""
        self.pieces, self.scores, self.byte_ids = pieces, scores, byte_ids
        barred = special | set(byte_ids)
        self.ids = {p: i for i, p in enumerate(pieces) if i not in barred}
        self.longest = max(map(len, self.ids))
        self.adjacent = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.raw = [p.replace(SPACE, " ").encode("utf-8") for p in pieces]
        for value, i in enumerate(byte_ids):
            self.raw[i] = bytes([value])
        for i in special:
            self.raw[i] = b""
        # arcs: the pieces that encode to themselves; no other piece is ever part of an encoding
        self.arcs = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self.prefixes = {p[:n] for p in self.arcs for n in range(1, len(p) + 1)}
        self.options = self._options()
        self._fits: dict[int, bool] = {}
        self._words = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_fits": {}, "_words": None}

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        bytes_ = [i for i in every if model.is_byte(i)]
        special = {i for i in every if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        if len(bytes_) != 256:
            raise ValueError("the model needs byte pieces to encode every text")
        return Pieces([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every], bytes_, special)

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding of a short string by its definition: best-scored merge first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether two adjacent pieces weigh zero: together they encode to just these two."""
        if left < 0 or right < 0:
            return True
        key = left * len(self.pieces) + right
        known = self._fits.get(key)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = (a[-1] + b[0]) not in self.adjacent or self.merge(a + b) == [a, b]
            if len(self._fits) > 2 * REMEMBERED:
                self._fits.clear()
            self._fits[key] = known
        return known

    def arcs_from(self, text: str, start: int) -> list[Arc]:
        """All arcs that begin at ``start``, by end; an unknown character is an arc too."""
        out = []
        for end in range(start + 1, min(len(text), start + self.longest) + 1):
            part = text[start:end]
            if part not in self.prefixes:
                break
            found = self.arcs.get(part)
            if found is not None:
                out.append((start, end, found))
        return out if out and out[0][1] == start + 1 else [(start, start + 1, -1 - ord(text[start])), *out]

    def _options(self) -> dict[str, tuple[tuple[int, int], ...]]:
        """By prefix: (length, id) of the arcs along it, longest first; its first character is one in any case."""
        out: dict[str, tuple[tuple[int, int], ...]] = {}
        for part in sorted(self.prefixes, key=len):
            found = self.arcs.get(part)
            if len(part) == 1:
                out[part] = ((1, -1 - ord(part) if found is None else found),)
            else:
                out[part] = out[part[:-1]] if found is None else ((len(part), found), *out[part[:-1]])
        return out

    def path(self, text: str) -> list[int]:
        """The path of weight zero through a whole text, longest arcs tried first; dead ends are remembered."""
        options, known, vocabulary, size = self.options.get, self._fits, len(self.pieces), len(text)
        ids: list[int] = []
        left: list[tuple[int, Iterator[tuple[int, int]]]] = []
        dead: set[tuple[int, int]] = set()
        at, before = 0, -1
        while True:
            end, here, longer = at + 1, None, options(text[at : at + 1])
            while longer is not None:
                here = longer
                end += 1
                if end > size:
                    break
                longer = options(text[at:end])
            open_ = iter(here or ((1, -1 - ord(text[at])),))
            while True:
                for length, i in open_:
                    if dead and (at + length, i) in dead:
                        continue
                    if before < 0 or i < 0:
                        break
                    fits = known.get(before * vocabulary + i)
                    if self.fits(before, i) if fits is None else fits:
                        break
                else:
                    dead.add((at, ids.pop()))
                    at, open_ = left.pop()
                    before = ids[-1] if ids else -1
                    continue
                break
            ids.append(i)
            if at + length == size:
                return ids
            left.append((at, open_))
            at, before = at + length, i

    def crossing(self, text: str, cut: int) -> list[Arc]:
        """The arcs with start < cut <= end, relative to the cut, in a fixed order."""
        arcs = [arc for s in range(max(0, cut - self.longest), cut) for arc in self.arcs_from(text, s) if arc[1] >= cut]
        return sorted((s - cut, e - cut, i) for s, e, i in arcs)

    def forward(self, text: str, begin: int, end: int, entries: list[Arc] | None) -> dict[int, list[tuple[Arc, int]]]:
        """By end position: the arcs of the lattice with the entries (as bits) that reach them at weight zero.

        Arcs starting in [begin, end) are laid after the entry arcs, or at ``begin`` itself if there are none.
        """
        ending: dict[int, list[tuple[Arc, int]]] = {}
        for bit, (s, e, i) in enumerate(entries or []):
            ending.setdefault(begin + e, []).append(((begin + s, begin + e, i), 1 << bit))
        for at in range(begin, end):
            before = ending.get(at)
            if before is None and not (entries is None and at == begin):
                continue
            for arc in self.arcs_from(text, at):
                if entries is None and at == begin:
                    reach = 1
                else:
                    reach = 0
                    for (_, _, left), mask in before:
                        if mask & ~reach and self.fits(left, arc[2]):
                            reach |= mask
                if reach:
                    ending.setdefault(arc[1], []).append((arc, reach))
        return ending

    def backtrace(self, ending: dict[int, list[tuple[Arc, int]]], last: Arc, begin: int) -> list[int]:
        """Ids of the path that ends with ``last``, back to the arc that starts at or after ``begin``."""
        out = []
        while last[0] >= begin:
            out.append(last[2])
            before = [arc for arc, _ in ending.get(last[0], []) if self.fits(arc[2], last[2])]
            if not before:
                break
            last = before[0]
        return out[::-1]

    def expand(self, ids: list[int]) -> bytes:
        """32-bit ids, unknown characters as their bytes."""
        if min(ids, default=0) < 0:
            out: list[int] = []
            for i in ids:
                char = SPACE if -1 - i == ord(_LITERAL) else chr(max(0, -1 - i))
                out.extend([i] if i >= 0 else [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")])
            ids = out
        return array("i", ids).tobytes()

    def word(self, unit: str) -> bytes:
        """Ids of a unit, cut where no piece can reach across, so that its parts are remembered too."""
        adjacent = self.adjacent
        if adjacent.issuperset(map(str.__add__, unit, unit[1:])):
            return self.expand(self.path(unit))
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in adjacent]
        return b"".join([self._words[unit[a:b]] for a, b in zip([0, *cuts], [*cuts, len(unit)])])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. Pieces never span a space that follows another character, nor a line feed."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        return np.frombuffer(self._units(prepared(text)), dtype=np.int32)

    def _units(self, text: str) -> bytes:
        if self._words is None:
            self._words = Remembered(self.word)
        return b"".join(map(self._words.__getitem__, _UNITS.findall(text)))

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def safe_span(self, text: str, begin: int, end: int, first: bool) -> tuple[int, int] | None:
        """The first and the last place in [begin, end) that no arc can reach across, if there is one."""
        safe = [i for i in (begin,) if first] or (i for i in range(begin, end) if text[i - 1 : i + 1] not in self.adjacent)
        low = next(iter(safe), None)
        return None if low is None else (low, next((i for i in range(end - 1, low, -1) if text[i - 1 : i + 1] not in self.adjacent), low))

    def transfer(self, text: str, begin: int, end: int, first: bool, last: bool) -> list[int]:
        """The chunk's matrix as one bit row (over exit arcs) for each entry arc.

        With a place that no arc crosses the matrix is the outer product of the entries that reach the
        first such place and the exits that can be reached from the last.
        """
        entries = None if first else self.crossing(text, begin)
        exits = {arc: k for k, arc in enumerate(self.exits(text, end, last))}
        span = self.safe_span(text, begin, end, first)
        if span is None:
            rows = [0] * len(entries)
            for mask, k in self._leaving(self.forward(text, begin, end, entries), end, exits):
                for row in range(len(rows)):
                    rows[row] |= (mask >> row & 1) << k
            return rows
        low, high = span
        reach = 1 if first else reduce(lambda x, y: x | y[1], self.forward(text, begin, low, entries).get(low, []), 0)
        out = reduce(lambda x, y: x | 1 << y[1], self._leaving(self.forward(text, high, end, None), end, exits), 0)
        return [out if reach >> row & 1 else 0 for row in range(1 if first else len(entries))]

    @staticmethod
    def _leaving(ending: dict[int, list[tuple[Arc, int]]], end: int, exits: dict[Arc, int]) -> Iterator[tuple[int, int]]:
        """(entries as bits, exit) of the lattice arcs that are exits."""
        for arcs in ending.values():
            for (s, e, i), mask in arcs:
                if (s - end, e - end, i) in exits:
                    yield mask, exits[s - end, e - end, i]

    def exits(self, text: str, end: int, last: bool) -> list[Arc]:
        return [arc for arc in self.crossing(text, end) if not last or arc[1] == 0]

    def trace(self, text: str, begin: int, end: int, first: bool, last: bool, entry: int, leave: int) -> bytes:
        """Ids of the pieces that start in the chunk, given the arcs at its cuts."""
        entries = None if first else [self.crossing(text, begin)[entry]]
        s, e, i = self.exits(text, end, last)[leave]
        leaving = s + end, e + end, i
        span = self.safe_span(text, begin, end, first)
        if span is None:
            return self.expand(self.backtrace(self.forward(text, begin, end, entries), leaving, begin))
        low, high = span
        head = b""
        if not first:
            ending = self.forward(text, begin, low, entries)
            head = self.expand(self.backtrace(ending, ending[low][0][0], begin))
        tail = self.expand(self.backtrace(self.forward(text, high, end, None), leaving, high))
        return head + self._units(text[low:high]) + tail


def prepared(text: str) -> str:
    """The text as the model sees it: a space in front, spaces as U+2581."""
    return SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)


def times(a: list[int], b: list[int]) -> list[int]:
    """(max, +) product of two matrices of zeros and minus infinities, kept as bit rows."""
    return [reduce(lambda x, k: x | b[k] if row >> k & 1 else x, range(len(b)), 0) for row in a]


def states(matrices: list[list[int]], first: int, last: int) -> list[int]:
    """The arc at every cut of the one path from arc ``first`` to arc ``last`` through the matrices."""
    back = [1 << last]
    for matrix in reversed(matrices):
        back.append(sum(1 << r for r, row in enumerate(matrix) if row & back[-1]))
    out, at = [first], first
    for matrix, allowed in zip(matrices, back[-2::-1]):
        at = (matrix[at] & allowed).bit_length() - 1
        out.append(at)
    return out


def _packed(rows: list[int]) -> list[bytes]:
    return [r.to_bytes((r.bit_length() + 7) // 8 or 1, "little") for r in rows]


def _unpacked(rows) -> list[int]:
    return [int.from_bytes(r, "little") for r in rows]


def model(spark: SparkSession, path: str) -> Broadcast:
    """The model of a file that the driver can read, for all tasks; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(Pieces.load(path))


def _chunks(longest: int, size: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                key, whole = hashlib.md5(text.encode("utf-8")).digest(), prepared(text).replace(_LITERAL, "\x00")
                marks = [m.start() for m in re.finditer(SPACE, text)]
                rows = []
                for no, begin in enumerate(range(0, len(whole), size)):
                    end = min(len(whole), begin + size)
                    low = max(0, begin - longest)
                    high = min(len(whole), end + longest)
                    literal = [m + 1 - low for m in marks if low <= m + 1 < high]
                    rows.append((key, no, whole[low:high], begin - low, end - low, end == len(whole), literal))
                    if len(rows) == CUT_ROWS:
                        yield pd.DataFrame(rows, columns=_CUT)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_CUT)

    return cut


def _window(row) -> str:
    if not len(row.literal):
        return row.part
    part = list(row.part)
    for m in row.literal:
        part[m] = _LITERAL
    return "".join(part)


_KEYED = "key binary, no int"


def _encode_giants(texts: DataFrame, held: Broadcast, size: int) -> DataFrame:
    """(key, ids) of the distinct texts, by the scan over their chunks."""
    spark = texts.sparkSession
    place = scratch_path(spark, "chunks")
    cut = texts.mapInPandas(_chunks(held.value.longest, size), f"{_KEYED}, part string, begin int, end int, last boolean, literal array<int>")
    cut.dropDuplicates(["key", "no"]).write.option("compression", "zstd").parquet(place)
    chunks = spark.read.parquet(place)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_packed(held.value.transfer(_window(r), r.begin, r.end, r.no == 0, r.last)) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"key": batch["key"], "no": batch["no"], "block": batch["no"] // BLOCK, "matrix": rows})

    local_path = scratch_path(spark, "matrices")
    chunks.mapInPandas(matrices, f"{_KEYED}, block int, matrix array<binary>").write.parquet(local_path)
    # groups are small and many: a fixed number of tasks, as merging them by their bytes would leave one
    parts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    local = spark.read.parquet(local_path).repartition(parts, "key")

    def combine(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        product = reduce(times, map(_unpacked, part["matrix"]))
        return pd.DataFrame({"key": part["key"].iloc[:1], "block": part["block"].iloc[:1], "matrix": [_packed(product)]})

    def along(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        rows = [_unpacked(m) for m in part["matrix"]]
        leave = reduce(times, rows)[0].bit_length() - 1
        at = states(rows, 0, leave)
        return pd.DataFrame({"key": part["key"], "block": part["block"], "entry": at[:-1], "leave": at[1:]})

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        at = states([_unpacked(m) for m in part["matrix"]], int(part["entry"].iloc[0]), int(part["leave"].iloc[0]))
        return pd.DataFrame({"key": part["key"], "no": part["no"], "entry": at[:-1], "leave": at[1:]})

    blocks = local.groupBy("key", "block").applyInPandas(combine, "key binary, block int, matrix array<binary>")
    cuts = blocks.groupBy("key").applyInPandas(along, "key binary, block int, entry int, leave int")
    inner = local.join(cuts, ["key", "block"]).groupBy("key", "block").applyInPandas(within, f"{_KEYED}, entry int, leave int")

    def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.frombuffer(held.value.trace(_window(r), r.begin, r.end, r.no == 0, r.last, r.entry, r.leave), dtype=np.int32) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"key": batch["key"], "no": batch["no"], "ids": ids})

    traced = chunks.join(inner, ["key", "no"]).mapInPandas(traces, f"{_KEYED}, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("no", "ids")))
    return traced.groupBy("key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def encode(documents: DataFrame, held: Broadcast, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """All columns of ``documents`` plus ``piece_ids``.

    The ids are those of the byte-pair model for the text with a space put in front; characters without a
    piece become byte pieces. A literal U+2581, which the model's own library turns into a space, is
    written in bytes too, so decoding gives back every text. Null texts have null ids, empty ones an empty
    array. Texts of more than ``chunk`` characters are encoded by chunks in parallel. A column
    ``piece_ids`` of the input is replaced. The session's Arrow batches are set to ``ARROW_ROWS`` rows.
    """
    keep = [c for c in documents.columns if c != "piece_ids"]
    small_batches(documents.sparkSession, ARROW_ROWS)

    @F.pandas_udf("array<int>")
    def direct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else held.value.encode(x) for x in batch], dtype=object)

    giant = F.coalesce(F.length(text) > chunk, F.lit(False))
    short = documents.where(~giant).select(*keep, direct(F.col(text)).alias("piece_ids"))
    long = documents.where(giant).select(*keep, F.unhex(F.md5(F.col(text).cast("binary"))).alias("__key"))
    ids = _encode_giants(documents.where(giant).select(F.col(text).alias("text")), held, chunk).withColumnsRenamed({"key": "__key", "ids": "piece_ids"})
    return short.union(long.join(ids, "__key").select(*keep, "piece_ids"))


def decoded(held: Broadcast):
    """A column function: ids back to text. Null ids give null; ids outside the vocabulary fail."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else held.value.decode(x.tolist()) for x in batch], dtype=object)

    return decode
