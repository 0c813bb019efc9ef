"""Best-fit packing of token sequences by bin completion with branch-and-bound.

A piece matters to the packing by its length only, so what is packed is the table of how many pieces each length
has: as many rows as a sequence has tokens, whatever the corpus. Branching is bin completion. The longest piece left
is completed by each undominated filling of the room beside it (one of which no piece, or pieces, can be swapped for a
longer piece that is left and still fits), fullest first, for as many sequences at once as the counts allow, or for one.
Best fit decreasing completes every node to a whole packing, which is the incumbent if it is the best so far. A node is left
if its waste so far and a lower bound of what is left can't beat the incumbent, or if the same pieces were left before
after as few sequences. The search ends when an incumbent meets the lower bound of all, when nothing is left to branch,
or after `most_nodes` nodes; `Packing.proven` says whether it is known to be the best there is.

Pieces then find their places without meeting: the r-th piece of a length goes to the sequence that its length's list of
fillings gives for r. The number r is how many pieces of the length the tasks before have, which is a window over
counts, and how many the task itself has seen. Texts are tokenized once and not shuffled.

Tokens: with `by_word`, for tokenizers that lower-case, do not look across blanks, and in ASCII split runs of letters, single digits and runs of
other characters, distinct words of a batch are encoded once, and again only if they are not among the first `KNOWN` a
worker has met; words of printable ASCII go to the model run by run. Other tokenizers get whole texts.

Defined results: a null text is an empty one, of one token, the end; equal rows are packed each; an empty table gives no
pieces; ids that occur several times keep their rows' pieces apart, but their numbers (`piece`, `start`) are those of the row.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import rows
from gridloom.llm import text as tx

#: Words whose ids a worker keeps.
KNOWN = 400_000
_CHUNK = 8 << 20
#: Words that can be split here: neither marks of contractions nor of special tokens.
_PLAIN = re.compile("[!-&(-;=-~]+")
_RUNS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
#: How many pieces of each length, by falling length, without zeros.
Counts = tuple[tuple[int, int], ...]
#: Copies of each length in a sequence.
Filling = tuple[tuple[int, int], ...]


@dataclass
class Packing:
    """Fillings with how many sequences have them; bound: no packing has fewer sequences."""

    fillings: list[tuple[int, Filling]]
    bound: int
    proven: bool
    nodes: int = 0

    @property
    def sequences(self) -> int:
        return sum(many for many, _ in self.fillings)


def lower_bound(counts: Counts, capacity: int) -> int:
    """Sequences that any packing needs: pieces over capacity - k have no room for those of k or more, for the best k."""
    many = np.zeros(capacity + 2)
    if counts:
        n, m = np.array(counts).T
        many[n] = m
    over = np.cumsum(many[::-1])[::-1]  # pieces of a length or more
    weight = np.cumsum((many * np.arange(capacity + 2))[::-1])[::-1]
    half = capacity // 2
    k = np.arange(half + 1)
    room = capacity * (over[half + 1] - over[capacity - k + 1]) - (weight[half + 1] - weight[capacity - k + 1])  # beside those over a half that small ones may join
    small = weight[k] - weight[half + 1]
    return int(max(-(-weight[0] // capacity), (over[half + 1] + np.maximum(0, np.ceil((small - room) / capacity))).max()))


def best_fit(counts: Counts, capacity: int) -> list[tuple[int, Filling]]:
    """Best fit decreasing, many equal sequences at a time: each piece goes where it leaves the least room."""
    rooms: list[int] = []
    held: dict[int, list[tuple[int, Filling]]] = {}

    def put(room: int, many: int, filling: Filling) -> None:
        if many:
            if room not in held:
                insort(rooms, room)
                held[room] = []
            held[room].append((many, filling))

    for n, left in counts:
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                put(capacity, -(-left // (capacity // n)), ())
                continue
            room = rooms[at]
            many, filling = held[room].pop()
            if not held[room]:
                del held[room], rooms[at]
            copies = room // n
            full = min(many, left // copies)
            put(room - copies * n, full, (*filling, (n, copies)))
            left -= full * copies
            if full < many and left:  # one more sequence takes what is less than it holds
                put(room - left * n, 1, (*filling, (n, left)))
                full, left = full + 1, 0
            put(room, many - full, filling)
    return [(many, filling) for some in held.values() for many, filling in some]


def _swappable(filling: Filling, spare: int, others: list[int]) -> bool:
    """Whether a piece of `others` could take the place of nothing, of one shorter piece, or of several that are together no longer."""
    one, two = 0, 0  # bits: sums of one piece or more, of two or more
    for n, copies in filling:
        for _ in range(copies):
            two |= (one << n) | (two << n)
            one |= (one << n) | (1 << n)
    sums = one | 1
    for x in others:
        low = max(x - spare, 0)
        if (sums >> low) & ((1 << (x - low)) - 1) or (two >> x) & 1:
            return True
    return False


def fillings(room: int, counts: Counts, waste: int, most: int) -> tuple[list[tuple[int, Filling]], bool]:
    """Undominated fillings of the room that leave at most `waste` of it, as (sum, filling), the fullest first; and whether all were looked at.

    At most `most` are listed, and `20 * most` steps are taken.
    """
    usable = [(n, m) for n, m in counts if n <= room]
    rest = [0] * (len(usable) + 1)
    for k in range(len(usable) - 1, -1, -1):
        rest[k] = rest[k + 1] + usable[k][0] * usable[k][1]
    found: list[tuple[int, Filling]] = []
    stack: list[tuple[int, int, Filling]] = [(0, 0, ())]
    steps = 0
    while stack:
        k, used, filling = stack.pop()
        steps += 1
        if steps > 20 * most or len(found) >= most:
            return sorted(found, key=lambda f: -f[0]), False
        if used + rest[k] < room - waste:
            continue
        while k < len(usable) and usable[k][0] > room - used:
            k += 1
        if k == len(usable):
            taken = dict(filling)
            if used >= room - waste and not _swappable(filling, room - used, [n for n, m in usable if m > taken.get(n, 0)]):
                found.append((used, filling))
            continue
        n, m = usable[k]
        for copies in range(min(m, (room - used) // n) + 1):  # the last pushed, with most copies, comes first
            stack.append((k + 1, used + copies * n, (*filling, (n, copies)) if copies else filling))
    return sorted(found, key=lambda f: -f[0]), True


def _without(counts: Counts, gone: dict[int, int], times: int) -> Counts:
    return tuple((n, m - times * gone.get(n, 0)) for n, m in counts if m > times * gone.get(n, 0))


def bin_completion(counts: Counts, capacity: int, most_nodes: int = 500, most_fillings: int = 50) -> Packing:
    """Branch-and-bound over completions of the longest piece; counts: lengths (at most the capacity), falling, and how many of each."""
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(m for m, _ in best)
    seen: dict[Counts, int] = {}
    # Of a branch: what was left before it, sequences used with it, and how, as a chain of (times, filling, chain before).
    root = (counts, 0, None)
    stack: list[tuple[Counts, int, tuple | None]] = [root]
    nodes, whole = 0, True
    while stack and fewest > bound:
        left, used, chain = stack.pop()
        if chain:
            left = _without(left, dict(chain[1]), chain[0])
        if used + lower_bound(left, capacity) >= fewest or seen.get(left, fewest) <= used:
            continue
        if nodes == most_nodes:
            whole = False
            break
        nodes += 1
        seen[left] = used
        ends = best_fit(left, capacity)
        if used + sum(m for m, _ in ends) < fewest:
            fewest, best = used + sum(m for m, _ in ends), ends
            while chain:
                best = [*best, chain[:2]]
                chain = chain[2]
            seen.clear()
            stack, whole = [root], True  # the waste allowed is less now: from the root again, where it prunes more
            continue
        longest = left[0][0]
        spare = (fewest - 1 - used) * capacity - sum(n * m for n, m in left)
        found, all_of_them = fillings(capacity - longest, _without(left, {longest: 1}, 1), spare, most_fillings)
        whole &= all_of_them
        many = dict(left)
        for _, filling in reversed(found):
            need = dict(filling)
            need[longest] = need.get(longest, 0) + 1
            row = tuple(sorted(need.items(), reverse=True))
            for t in sorted({1, min(many[n] // k for n, k in row)}):
                stack.append((left, used + t, (t, row, chain)))
    return Packing(best, bound, fewest == bound or (whole and not stack), nodes)


class Tokens:
    """Token ids of texts by a tokenizer file."""

    _loaded: dict[tuple[str, bool], Tokens] = {}

    def __init__(self, path: str, by_word: bool) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are as many as there are cores
        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str, by_word: bool) -> Tokens:
        """One for each worker."""
        if (path, by_word) not in cls._loaded:
            cls._loaded[path, by_word] = cls(path, by_word)
        return cls._loaded[path, by_word]

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[list[int]]:
        model, known = self.tokenizer.model, self.known
        out = [known.get(w) for w in words]
        fresh = [k for k, ids in enumerate(out) if ids is None]
        rest = []
        for k in fresh:
            if _PLAIN.fullmatch(words[k]):
                out[k] = [t.id for run in _RUNS.findall(words[k].lower()) for t in model.tokenize(run)]
            else:
                rest.append(k)
        for k, ids in zip(rest, self._encoded([words[k] for k in rest]), strict=True):
            out[k] = ids
        for k in fresh[: max(0, KNOWN - len(known))]:
            known[words[k]] = out[k]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 bounds of the texts in them."""
        if not self.by_word:
            lists = self._encoded(texts.to_pylist())
            bounds = np.cumsum([0, *map(len, lists)])
            return np.array([i for some in lists for i in some], dtype=np.uint32), bounds
        lists = pc.split_pattern_regex(texts, pattern="[\t-\r ]+")
        coded = pc.list_flatten(lists).dictionary_encode()
        words = self._word_ids(coded.dictionary.to_pylist())
        of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        flat = np.array([i for some in words for i in some], dtype=np.uint32)
        many = sizes[of]
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(first[of] - upto[:-1], many) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and nth: how many pieces of its length the task had before, for each piece of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(tokenizer, by_word)
        had = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            _, bytes_to = tx.flat(texts)
            for i, j in tx.chunked(bytes_to, _CHUNK):
                ids, bounds = tokens.ids(texts.slice(i, j - i))
                bounds = bounds + np.arange(j - i + 1)  # each text has an end behind it
                ended = np.full(bounds[-1], end, dtype="<u4")
                ended[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(bounds) - 1)] = ids
                many = -(-np.diff(bounds) // capacity)
                of = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(of)) - (np.cumsum(many) - many)[of]
                start = piece * capacity
                length = np.minimum(capacity, np.diff(bounds)[of] - start)
                order = np.argsort(length, kind="stable")
                size, begin, again = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(of), dtype=np.int64)
                nth[order] = np.arange(len(of)) - np.repeat(begin - had[size], again)
                had[size] += again
                at = bounds[of] + start
                crc = np.array([zlib.crc32(ended[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)], dtype=np.int64)
                names = batch.column("doc_id").slice(i, j - i).take(pa.array(of))
                columns = [names, pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc, nth))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, nth long")


class Slots:
    """Where the r-th piece of a length goes: fillings in order, each with as many sequences as it has."""

    def __init__(self, packing: Packing) -> None:
        listed: list[tuple[int, int, int, int, int]] = []  # length, first r, sequences, first sequence, offset
        had: dict[int, int] = {}
        sequence = 0
        for many, filling in packing.fillings:
            offset = 0
            for n, copies in filling:
                listed.append((n, had.get(n, 0), many, sequence, offset))
                had[n] = had.get(n, 0) + many * copies
                offset += n * copies
            sequence += many
        listed.sort()
        self.length, self.first, self.many, self.sequence, self.offset = np.array(listed, dtype=np.int64).reshape(-1, 5).T
        self.key = self._keys(self.length, self.first)

    @staticmethod
    def _keys(length: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (length.astype(np.uint64) << np.uint64(44)) + r.astype(np.uint64)  # lengths under 2**20, 2**44 pieces of a length

    def places(self, length: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        at = np.searchsorted(self.key, self._keys(length, r), side="right") - 1
        within = r - self.first[at]
        return self.sequence[at] + within % self.many[at], self.offset[at] + within // self.many[at] * length


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True, most_nodes: int = 500, most_fillings: int = 50
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of each row of docs."""
    d = pieces(docs, tokenizer, capacity, end, id_col, text_col, by_word)
    d = rows.written(d.withColumn("task", F.spark_partition_id()), "pieces")
    counts = rows.written(d.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("length")).collect()  # at most `capacity` rows
    slots = Slots(bin_completion(tuple((r["length"], r["n"]) for r in totals), capacity, most_nodes, most_fillings))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(counts.select("length", "task", before.alias("before")), ["length", "task"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, before, nth = (batch.column(c).to_numpy() for c in ("length", "before", "nth"))
            sequence, offset = slots.places(length, before + nth)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
