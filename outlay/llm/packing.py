"""Best-fit packing of tokenized documents into fixed-length sequences.

A document becomes token ids followed by one end id. Only documents longer than a
sequence are cut. Pieces are dealt by hash into cells of bounded size; each cell is packed
by best fit, longest first, and then improved by local search between its underfull bins:
a document moves, or is exchanged one for one or two for one, whenever that raises the sum
of squared fills, so that the emptiest bins drain into fuller ones and vanish. A cell stops
as soon as its free space is less than one sequence, since no packing can then save a bin.

Cells lose less than one sequence each against packing everything at once, and a cell is a
fixed number of pieces, so a larger corpus has more cells and not larger ones.

Defined results: a null or empty text is one piece that holds the end id alone; repeated
rows are packed once each; an empty table gives no rows; a null ``doc_id`` stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import coded_words, in_batches, kept_by_worker, only, partitions_for, text_or_empty
from outlay.session import cut

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs together.
CELL_PIECES = 32_768
#: Bytes of text that a task tokenizes at a time.
SLICE = 4_000_000
#: Emptiest bins whose neighbouring pairs are offered two for one.
EMPTIEST = 16
#: Words whose ids a worker remembers; the memory starts afresh beyond it.
REMEMBERED = 600_000
LONGEST_REMEMBERED = 64
ID = "<u4"

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long"


class WordIds:
    """Token ids of texts.

    The tokenizer splits at its special tokens, then lower-cases and splits at white space
    before anything else, so the ids of a text are those of its words in a row, and a worker
    remembers the words it has seen. A special token is a word of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._special = [t.content for t in added if not t.normalized]
        self._known: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        codes, n_words, words = coded_words(self._spaced(texts))
        ids = self._of_words(words.to_pylist())
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(ids), dtype=ID)
        per_word = lengths[codes]
        ends = np.cumsum(per_word)
        at = np.repeat(starts[codes] - ends + per_word, per_word) + np.arange(per_word.sum())
        bounds = np.append(0, ends)[np.append(0, np.cumsum(n_words))]
        return flat[at], np.diff(bounds)

    def _spaced(self, texts: pa.Array) -> pa.Array:
        """Lower-cased texts; where that would make or hide special tokens, texts as they are,
        with a space on both sides of these."""
        lower = pc.ascii_lower(texts)
        if not any(pc.any(pc.match_substring(lower, t.lower())).as_py() for t in self._special):
            return lower
        for token in self._special:
            texts = pc.replace_substring(texts, token, f" {token} ")
        return texts

    def _of_words(self, words: list[str]) -> list[bytes]:
        if len(self._known) > REMEMBERED:
            self._known = {}
        known = self._known
        new = [w for w in words if w not in known]
        for start in range(0, len(new), 500):
            known.update(self._encoded(new[start : start + 500]))
        found = [known[w] for w in words]
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del known[w]
        return found

    def _encoded(self, words: list[str]) -> list[tuple[str, bytes]]:
        """All words in one call; a token belongs to the word in which it starts."""
        got = self._tokenizer.encode("\n".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        begins = np.fromiter((o[0] for o in got.offsets), dtype=np.int64, count=len(got.offsets))
        word = np.searchsorted(ends, begins, side="right")
        cuts = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        ids = np.array(got.ids, dtype=ID).tobytes()
        return [(w, ids[a:b]) for w, a, b in zip(words, cuts, cuts[1:])]


@kept_by_worker
def encoder(path: str) -> WordIds:
    """One per worker, which keeps it from task to task while it tokenizes."""
    return WordIds(path)


def tokenize(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of every document: ``PIECE``, and with ``with_ids`` also ``ids`` (binary,
    little-endian unsigned 32 bit)."""
    end = np.array([END_ID], dtype=ID).tobytes()
    step = 4 * capacity

    def work(rows: pa.RecordBatch) -> dict:
        ids, counts = encoder(tokenizer)(rows.column("text"))
        data, at = ids.tobytes(), 0
        out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, n in zip(rows.column("doc_id").to_pylist(), counts.tolist()):
            own = data[4 * at : 4 * (at + n)] + end
            at += n
            for piece, begin in enumerate(range(0, len(own), step)):
                part = own[begin : begin + step]
                row = (doc_id, piece, begin // 4, len(part) // 4, zlib.crc32(part), part)
                for name, value in zip(out, row):
                    out[name].append(value)
        return out

    texts = only(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    schema = f"{PIECE}, ids binary" if with_ids else PIECE
    return in_batches(texts, work, schema, SLICE, keeps="encoder")


def pack(pieces: DataFrame, capacity: int = CAPACITY, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """Give every piece a sequence and a place in it: ``PACKED``."""
    pieces = cut(pieces)
    cells = partitions_for(pieces.count(), cell_pieces)
    # The place of a row in the checkpoint spreads equal rows over the cells.
    place_of = F.monotonically_increasing_id()
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", place_of), F.lit(cells))

    def place(cell_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="cell").sort_values(
            ["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable"
        )
        bin_of, offset = fill(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(cell_key[0]) << 32) + bin_of, offset=offset)

    return pieces.withColumn("cell", cell).groupBy("cell").applyInPandas(place, PACKED)


def fill(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; ``lengths`` descend."""
    bins = _best_fit(lengths.tolist(), capacity)
    bins = _local_search(bins, lengths.tolist(), capacity)
    bin_of = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    for number, items in enumerate(bins):
        at = 0
        for i in items:
            bin_of[i], offset[i] = number, at
            at += int(lengths[i])
    return bin_of, offset


def _best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Each item goes to the bin with the least room that still holds it. ``rooms`` has a bit
    for every amount of room that some bin has."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, length in enumerate(lengths):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= length
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def _local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Move and exchange documents until the free space makes up less than one bin, or no
    exchange helps. Fuller bins are filled first, from the emptiest that have what fits."""
    state = _Underfull(bins, lengths, capacity)
    while state.spare >= capacity and state.improve():
        pass
    return [items for items in bins if items]


class _Underfull:
    """Bins with room, and their documents by length.

    An exchange gives a bin documents of an emptier one for some of its own that are shorter
    by no more than its room. It raises the sum of squared fills, so the search ends.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self._bins, self._lengths = bins, lengths
        self._free = [capacity - sum(lengths[i] for i in items) for items in bins]
        self._capacity = capacity
        self.spare = sum(self._free)
        self._bin_of = {i: b for b, items in enumerate(bins) if self._free[b] for i in items}
        self._items: dict[int, list[int]] = {}
        self._lengths_held = 0  # a bit for every length
        for i in self._bin_of:
            self._hold(i)

    def _hold(self, i: int) -> None:
        self._items.setdefault(self._lengths[i], []).append(i)
        self._lengths_held |= 1 << self._lengths[i]

    def improve(self) -> bool:
        """One pass over the bins, fullest first; whether anything was exchanged."""
        order = sorted({*self._bin_of.values()}, key=lambda b: (self._free[b], b))
        emptiest = order[-EMPTIEST:]
        changed = False
        for target in order:
            while self._bins[target] and self._free[target] and self.spare >= self._capacity:
                found = self._exchange(target, emptiest)
                if not found:
                    break
                self._apply(target, *found)
                changed = True
        return changed

    def _exchange(self, target: int, emptiest: list[int]) -> tuple | None:
        """The exchange that fills the target most: the source, what it gives and takes."""
        room, own = self._free[target], self._bins[target]
        offers = [(0, ())] + [(self._lengths[i], (i,)) for i in own]
        offers += [(self._lengths[i] + self._lengths[j], (i, j)) for i, j in zip(own, own[1:])]
        best, gain = None, 0
        for size, taken in dict(offers).items():
            item = self._longest(size + gain, size + room, target)
            if item is not None:
                best, gain = (self._bin_of[item], (item,), taken), self._lengths[item] - size
                if gain == room:
                    return best
        for source in emptiest:
            if source == target or self._free[source] < room:
                continue
            items = self._bins[source]
            for i, j in zip(items, items[1:]):
                both = self._lengths[i] + self._lengths[j]
                for size, taken in offers[: len(own) + 1]:
                    if gain < both - size <= room:
                        best, gain = (source, (i, j), taken), both - size
        return best

    def _longest(self, above: int, most: int, target: int) -> int | None:
        """A document longer than ``above`` and of ``most`` at most, from a bin no fuller than
        the target: the longest there is."""
        most = min(most, self._capacity - self._free[target])
        held = self._lengths_held & ((1 << (most + 1)) - 1)
        while held >> (above + 1):
            length = held.bit_length() - 1
            items = self._items[length] = [
                i for i in self._items[length] if i in self._bin_of
            ]
            sources = [i for i in items if self._may_give(self._bin_of[i], target)]
            if sources:
                return max(sources, key=lambda i: self._free[self._bin_of[i]])
            if not items:
                self._lengths_held ^= 1 << length
            held ^= 1 << length
        return None

    def _may_give(self, source: int, target: int) -> bool:
        return source != target and self._free[source] >= self._free[target]

    def _apply(self, target: int, source: int, given: tuple, taken: tuple) -> None:
        bins, free = self._bins, self._free
        gain = sum(self._lengths[i] for i in given) - sum(self._lengths[i] for i in taken)
        bins[source] = [i for i in bins[source] if i not in given] + list(taken)
        bins[target] = [i for i in bins[target] if i not in taken] + list(given)
        free[target] -= gain
        free[source] += gain
        self._bin_of.update({i: target for i in given} | {i: source for i in taken})
        if not bins[source]:
            self.spare -= self._capacity
        if not free[target]:  # full: out of the search
            for i in bins[target]:
                del self._bin_of[i]


def assemble(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The token ids of every sequence: ``sequence_id long, ids array<binary>`` in order."""
    keys = ["doc_id", "piece", "ids_crc32"]
    ids = pieces_with_ids.select(*keys, "ids").dropDuplicates(keys)
    return (
        packed.join(ids, keys)
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.col("parts.ids").alias("ids"))
    )
