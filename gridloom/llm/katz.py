"""LM scoring: a Katz backoff model of any order with Good-Turing discounts, trained and applied on Spark.

Texts are cut into blocks, whose tokens are written once as codes into the block's own vocabulary.
Words, then pairs of a context and a word, order by order, are counted in the same way: every block sends each
distinct one once, with its count, to the home (a hash partition) of the word or of the pair's context. The
home adds up, keeps its part of the model as a table, and answers each block in the order asked.
So hot words and pairs are added up before the shuffle. Contexts with over `hot` occurrences
have several homes, by the word; what is needed of them is summed afterwards (there are at
most `HOT_WORDS` of them in an order). A block sends a home a row if it has a pair for it, so rows are never more than pairs.

Order 1: P(w) = d(c) c / N, and what the discounts take away is the probability of an unknown
word. Order k: P(w | v) = d(c) c / c(v) for a word w seen after the k - 1 tokens v in training, else a(v) P(w | v'), v' being v
without its first token and a(v) sharing what the discounts of v's followers take away among the words that did not
follow v, unknown ones included, so that all sum to one. The recursion runs upwards: a block knows P of each of its
tokens in the order below, sends it with the pair, and the home sums it over a context's followers. The number a home
gives a pair is the context of the next order. If nothing was taken away (all counts over `KEEP`),
the total is c(v) + 1. After a context that training does not have, P(w | v'). Texts begin in a state of their own and end
with a token. Discounts are Good-Turing's for counts up to `KEEP`. Groups of copies make counts of
counts uneven at any size; where the discounts then do not rise between 0 and 1, they are taken from
a line fitted to the logarithms of counts and counts of counts. Absolute discounting takes their
place only where no falling line fits (tables of a few counts).

Defined results: a null text is an empty one, of one token, the end; rows are scored one by one;
without training rows nothing is known and the unknown word has probability 1. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm import rows
from gridloom.llm import text as tx
from gridloom.llm.packing import pack_ints, pack_sorted, unpack_ints, unpack_sorted

KEEP = 5
HOT_WORDS = 100_000
END = np.uint64(0x5EED0E4D)


def _good_turing(n: list[float]) -> np.ndarray:
    """Katz's discounts d(1..KEEP) of the counts of counts n[1..KEEP + 1], all over 0."""
    whole = (KEEP + 1) * n[KEEP + 1] / n[1]
    return np.array([((r + 1) * n[r + 1] / (r * n[r]) - whole) / (1 - whole) if whole < 1 else 0.0 for r in range(1, KEEP + 1)])


def _slope(n: list[float]) -> float:
    """Of the line through log n[r] over log r, a count shared with the empty ones around it; 0 if there are no two to fit."""
    seen = [r for r in range(1, KEEP + 2) if n[r]]
    if len(seen) < 2 or seen[0] > 1:
        return 0.0
    before = [0, *seen[:-1]]
    after = [*seen[1:], 2 * seen[-1] - seen[-2]]
    share = [2 * n[r] / (t - q) for q, r, t in zip(before, seen, after, strict=True)]
    return float(np.polyfit(np.log(seen), np.log(share), 1)[0])


def discounts(of_count: list[int]) -> np.ndarray:
    """d(0..KEEP); of_count[r]: how many were seen r times, r up to KEEP + 1. d(0) is unused.

    Good-Turing of the counts of counts as they are if that rises between 0 and 1, else of the line r**slope fitted
    to them, whose discounts do so for every slope under -1; absolute discounting only where there is no such line.
    """
    n = [float(x) for x in of_count]
    d = np.ones(KEEP + 1)
    if all(n[1 : KEEP + 2]):
        d[1:] = _good_turing(n)
    if not (all(0 < x < 1 for x in d[1:]) and all(np.diff(d[1:]) >= 0)):
        slope = _slope(n)
        if slope < -1:
            d[1:] = _good_turing([0.0, *(r**slope for r in range(1, KEEP + 2))])
        else:
            less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            d[1:] = [(r - less) / r for r in range(1, KEEP + 1)]
    return d


@dataclass
class WordModel:
    """Order 1, and what order 2 needs to know of all words."""

    tokens: int
    words: int
    texts: int
    discount: np.ndarray
    unknown: float
    total: int  # the denominator: tokens, and one more if the discounts leave nothing for unknown words

    @staticmethod
    def of(tokens: int, words: int, texts: int, of_count: list[int]) -> WordModel:
        d = discounts(of_count)
        lost = sum((1 - d[r]) * r * of_count[r] for r in range(1, KEEP + 1))
        total = tokens if lost else tokens + 1
        return WordModel(tokens, words, texts, d, (lost or 1) / total, total)

    def probability(self, count: np.ndarray) -> np.ndarray:
        """Of words seen `count` times in training."""
        kept = np.where(count > KEEP, count, count * self.discount[np.where(count <= KEEP, count, 0)])
        return np.where(count > 0, kept / self.total, self.unknown)


@dataclass
class Level:
    """What blocks need to know of an order from 2 on; the last three once its pairs are counted."""

    order: int
    homes: int
    hot: dict[int, int]  # homes of contexts that have several
    discount: np.ndarray | None = None
    hot_weights: dict[int, tuple[float, bool]] | None = None  # weight, and whether the followers all have counts over KEEP

    def home_of(self, context: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
        share = np.zeros(len(context), dtype=np.uint64)
        if self.hot and word is not None and len(context):
            names = np.array(sorted(self.hot), dtype=np.int64)
            at = np.minimum(np.searchsorted(names, context), len(names) - 1)
            many = np.where(names[at] == context, np.array([self.hot[k] for k in names.tolist()])[at], 1)
            share = (word % many).astype(np.uint64)
        return (tx.mix(context.astype(np.uint64) ^ (share << np.uint64(40)), 5 + self.order) % np.uint64(self.homes)).astype(np.int64)


def _tokens(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks: block, ids, train and n_tokens of the texts, vocabulary (sorted hashes) and codes of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            tokens = np.concatenate([t for _, t, _ in held])
            vocabulary, codes = np.unique(tokens, return_inverse=True)
            texts = pa.Table.from_batches([b for b, _, _ in held]).combine_chunks()
            columns = [*(texts.column(c).combine_chunks() for c in ("doc_id", "train")), pa.array(np.concatenate([n for _, _, n in held]))]
            lists = [pa.ListArray.from_arrays(pa.array([0, texts.num_rows], pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists, pa.array([pack_sorted(vocabulary)], pa.binary()), pa.array([pack_ints(codes)], pa.binary())], names=["block", "ids", "train", "n_tokens", "vocabulary", "codes"])

        for batch, data, bounds in rows.text_chunks(batches):
            hashes, counts = tx.word_hashes(data, bounds, tx.NOT_BLANK, tx.LOWER_BYTES)
            tokens = np.full(len(hashes) + len(counts), END, dtype=np.uint64)
            tokens[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = hashes
            held.append((batch.select(["doc_id", "train"]), tokens, counts + 1))
            size += len(data)
            if size >= block_bytes:
                yield block()
                at, size = at + 1, 0
                held.clear()
        if held:
            yield block()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"block long, ids array<{kind}>, train array<boolean>, n_tokens array<long>, vocabulary binary, codes binary")


def _lists(batch: pa.RecordBatch, name: str, i: int) -> list[dict]:
    """Entry i of a column of arrays of structs, as dictionaries of numbers and numpy arrays, without Python numbers."""
    column = batch.column(name)
    if not column[i].is_valid:
        return []
    structs = column.slice(i, 1).flatten()
    out = []
    for k in range(len(structs)):
        entry = {}
        for f in structs.type:
            values = structs.field(f.name)
            entry[f.name] = values.slice(k, 1).flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(f.type) else values[k].as_py()
        out.append(entry)
    return sorted(out, key=lambda r: r["home"])


_NONE = np.zeros(0, dtype=np.int64)


def _by_value(values: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each value, rising."""
    order = np.argsort(values, kind="stable")
    return {v: order[x:y] for v, x, y in tx.runs_of(values[order])}


class _Block:
    """Row i of a batch of _tokens, with what is known of its words (column words) and, order by order, of its tokens."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        get = lambda name: batch.column(name).slice(i, 1).flatten().to_numpy(zero_copy_only=False)
        self.name = batch.column("block")[i].as_py()
        self.lengths = get("n_tokens").astype(np.int64)
        self.texts_train = get("train").astype(bool)
        self.vocabulary, self.codes = unpack_sorted(batch.column("vocabulary")[i].as_py()), unpack_ints(batch.column("codes")[i].as_py()).astype(np.int64)
        self.train = np.repeat(self.texts_train, self.lengths)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        if "words" in batch.schema.names:
            parts = _lists(batch, "words", i)
            self.word = np.concatenate([r["ids"] for r in parts])[self.codes]
            self.count = np.concatenate([r["counts"] for r in parts])[self.codes]

    def train_counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.train], minlength=len(self.vocabulary))

    def known_up_to(self, model: WordModel, levels: list[Level], batch: pa.RecordBatch, i: int) -> _Block:
        """Order 1, and the orders that the homes have answered: p, of each token, and the context of the next order."""
        self.p, self.lower = model.probability(self.count), self.count
        self._next_context(model, self.word, self.count)
        for level in levels:
            self.pair_up(level)
            self._learn(model, level, _lists(batch, f"replies_{level.order}", i))
        return self

    def _next_context(self, model: WordModel, number: np.ndarray, count: np.ndarray) -> None:
        """context: 0 at a text's begin (if training had any), else one more than the number of what is before, or -1 if unknown."""
        self.context, self.before = np.empty(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
        self.context[1:] = np.where(number[:-1] >= 0, number[:-1] + 1, -1)
        self.before[1:] = count[:-1]
        self.context[self.starts], self.before[self.starts] = (0, model.texts) if model.texts else (-1, 0)

    def pair_up(self, level: Level) -> None:
        """The distinct pairs of a known context and a known word, and the contexts that may have to back off."""
        self.known = (self.context >= 0) & (self.word >= 0)
        word = self.word[self.known]
        contexts, rank = np.unique(self.context[self.known], return_inverse=True)
        wide = int(word.max(initial=0)) + 1  # a block has few contexts, so the product fits
        code, at, self.pair_of = np.unique(rank * wide + word, return_index=True, return_inverse=True)
        self.pair_context, self.pair_word, self.pair_lower = contexts[code // wide] if len(code) else contexts, code % wide, self.lower[self.known][at]
        self.pair_train = np.bincount(self.pair_of, weights=self.train[self.known], minlength=len(code)).astype(np.int64)
        self.pairs_of_home = _by_value(level.home_of(self.pair_context, self.pair_word))
        lone = self.context[(self.context >= 0) & (self.word < 0)]
        backing = np.unique(np.concatenate([lone, self.pair_context[self.pair_train == 0]]))
        self.backing = backing[~np.isin(backing, list(level.hot))]
        self.backing_of_home = _by_value(level.home_of(self.backing))

    def _learn(self, model: WordModel, level: Level, replies: list[dict]) -> None:
        count, number = np.zeros(len(self.pair_word), dtype=np.int64), np.full(len(self.pair_word), -1, dtype=np.int64)
        whole = [np.array([v for v, (_, w) in level.hot_weights.items() if w], dtype=np.int64)]
        names, weights = [np.array(list(level.hot_weights), dtype=np.int64)], [np.array([w for w, _ in level.hot_weights.values()], dtype=np.float64)]
        for r in replies:
            mine = self.pairs_of_home.get(r["home"], _NONE)
            count[mine] = r["counts"]
            if r["numbers"] is not None and len(r["numbers"]):
                number[mine] = r["numbers"]
            whole.append(r["contexts"])
            names.append(self.backing[self.backing_of_home.get(r["home"], _NONE)])
            weights.append(backoff(r["totals"], r["seen"], r["rare"].reshape(-1, KEEP), level.discount))
        name, weight = np.concatenate(names), np.concatenate(weights)
        order = np.argsort(name)
        name, weight = name[order], weight[order]
        seen, numbers = np.zeros(len(self.codes), dtype=np.int64), np.full(len(self.codes), -1, dtype=np.int64)
        seen[self.known], numbers[self.known] = count[self.pair_of], number[self.pair_of]
        total = self.before + np.isin(self.context, np.concatenate(whole))
        kept = np.where(seen > KEEP, seen, seen * level.discount[np.where(seen <= KEEP, seen, 0)])
        off = (seen == 0) & (self.context >= 0) & (self.before > 0)
        p = np.where(seen > 0, kept / np.maximum(total, 1), self.p)
        p[off] *= weight[np.searchsorted(name, self.context[off])]
        self.p = self.lower = p
        self._next_context(model, numbers, seen)


def _ask_words(tokens: DataFrame, homes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i)
                count = b.train_counts()
                home = ((b.vocabulary >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)
                out = [(h, b.name, pack_sorted(b.vocabulary[x:y]), pack_ints(count[x:y])) for h, x, y in tx.runs_of(home)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["home", "block", "keys", "counts"])

    return tokens.select("block", "train", "n_tokens", "vocabulary", "codes").mapInArrow(run, "home int, block long, keys binary, counts binary")


def _by_home(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one home after another."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["home"] != now:
                if held:
                    yield now, held
                now, held = row["home"], []
            held.append(row)
    if held:
        yield now, held


_LONGS = pa.list_(pa.int64())
_WORDS = pa.schema([("kind", pa.string()), ("home", pa.int32()), ("block", pa.int64()), ("keys", _LONGS), ("ids", _LONGS), ("counts", _LONGS)])


def _answer_words(asked: DataFrame, homes: int) -> DataFrame:
    """kind `table`: the home's words, ids and counts; kind `reply`: ids (-1: unknown) and counts as the block asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, parts in _by_home(batches):
            keys = [unpack_sorted(p["keys"]) for p in parts]
            words, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate([unpack_ints(p["counts"]) for p in parts]).astype(np.float64)).astype(np.int64)
            rank = np.empty(len(words), dtype=np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(words))
            ids = np.where(total > 0, rank * homes + home, -1)
            seen = total > 0
            out = [("table", home, None, words[seen].view(np.int64), ids[seen], total[seen])]
            at = 0
            for p, k in zip(parts, keys, strict=True):
                mine = which[at : at + len(k)]
                at += len(k)
                out.append(("reply", home, p["block"], None, ids[mine], total[mine]))
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _WORDS, strict=True)], schema=_WORDS)

    kinds = "kind string, home int, block long, keys array<long>, ids array<long>, counts array<long>"
    return asked.repartition(min(homes, rows.MOST_TASKS), "home").sortWithinPartitions("home").mapInArrow(run, kinds)


def _lower_packed(lower: np.ndarray, order: int) -> bytes:
    """Of order 2 the counts of words, which say all of their probability; above, probabilities."""
    return pack_ints(lower if order == 2 else lower.view(np.uint64))


def _ask_pairs(blocks: DataFrame, model: WordModel, levels: list[Level], level: Level) -> DataFrame:
    """Each block's pairs of this order, for their homes; levels: the orders below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i).known_up_to(model, levels, batch, i)
                b.pair_up(level)
                out = []
                for h in sorted(b.pairs_of_home.keys() | b.backing_of_home.keys()):
                    mine, ask = b.pairs_of_home.get(h, _NONE), b.backing[b.backing_of_home.get(h, _NONE)]
                    out.append((h, b.name, pack_sorted(b.pair_context[mine]), pack_ints(b.pair_word[mine]), pack_ints(b.pair_train[mine]), _lower_packed(b.pair_lower[mine], level.order), pack_sorted(ask)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], names=["home", "block", "contexts", "words", "counts", "lower", "back"])

    return blocks.drop("ids").mapInArrow(run, "home int, block long, contexts binary, words binary, counts binary, lower binary, back binary")


_PAIRS = pa.schema([("kind", pa.string()), ("home", pa.int32()), ("block", pa.int64()), ("contexts", _LONGS), ("totals", _LONGS), ("seen", pa.list_(pa.float64())), ("rare", _LONGS), ("pairs", _LONGS), ("words", _LONGS), ("counts", _LONGS), ("numbers", _LONGS)])


def _answer_pairs(asked: DataFrame, model: WordModel, level: Level, numbered: bool) -> DataFrame:
    """kind `table`: the home's contexts, with their totals, the lower-order probability of their
    followers, how many of these have counts 1..KEEP (rare, KEEP for each context), and the pairs (contexts), their words,
    counts and, if numbered, numbers. kind `hot`: the same of contexts with several homes, to be added up.
    kind `reply`: counts and numbers of a block's pairs; totals, seen and rare of the contexts it asked for.
    Field contexts of a reply: of its distinct contexts, those whose followers all have counts over KEEP.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, parts in _by_home(batches):
            each = [unpack_sorted(p["contexts"]).astype(np.int64) for p in parts]
            context, word = np.concatenate(each), np.concatenate([unpack_ints(p["words"]).astype(np.int64) for p in parts])
            order = np.lexsort((word, context))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
            which = np.empty(len(order), dtype=np.int64)
            which[order] = np.cumsum(fresh) - 1
            context, word = context[order][fresh], word[order][fresh]
            total = np.bincount(which, weights=np.concatenate([unpack_ints(p["counts"]) for p in parts]).astype(np.float64), minlength=len(word)).astype(np.int64)
            packed = np.concatenate([unpack_ints(p["lower"]) for p in parts])
            lower = np.zeros(len(word))
            lower[which] = model.probability(packed.astype(np.int64)) if level.order == 2 else packed.view(np.float64)
            real = total > 0
            number = np.full(len(word), -1, dtype=np.int64)
            if numbered:
                rank = np.empty(int(real.sum()), dtype=np.int64)
                rank[np.argsort(-total[real], kind="stable")] = np.arange(len(rank))
                number[real] = rank * level.homes + home
            held, count = context[real], total[real]
            contexts, owner = np.unique(held, return_inverse=True)
            totals = np.bincount(owner, weights=count, minlength=len(contexts)).astype(np.int64)
            seen = np.bincount(owner, weights=lower[real], minlength=len(contexts))
            few = count <= KEEP
            rare = np.bincount(owner[few] * KEEP + count[few] - 1, minlength=len(contexts) * KEEP).reshape(-1, KEEP)
            is_hot = np.isin(contexts, list(level.hot))
            no_rare = contexts[~is_hot & (rare.sum(axis=1) == 0)]
            out = [("table", home, None, contexts[~is_hot], totals[~is_hot], seen[~is_hot], rare[~is_hot].ravel(), held, word[real], count, number[real] if numbered else None)]
            if is_hot.any():
                out.append(("hot", home, None, contexts[is_hot], totals[is_hot], seen[is_hot], rare[is_hot].ravel(), None, None, None, None))
            at = 0
            for p, k in zip(parts, each, strict=True):
                ask = np.searchsorted(contexts, unpack_sorted(p["back"]).astype(np.int64))
                mine = which[at : at + len(k)]
                at += len(k)
                out.append(("reply", home, p["block"], np.intersect1d(k, no_rare), totals[ask], seen[ask], rare[ask].ravel(), None, None, total[mine], number[mine] if numbered else None))
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PAIRS, strict=True)], schema=_PAIRS)

    kinds = "kind string, home int, block long, contexts array<long>, totals array<long>, seen array<double>, rare array<long>, pairs array<long>, words array<long>, counts array<long>, numbers array<long>"
    return asked.repartition(min(level.homes, rows.MOST_TASKS), "home").sortWithinPartitions("home").mapInArrow(run, kinds)


def backoff(totals: np.ndarray, seen: np.ndarray, rare: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The weights a(v), from the totals of v, the order-1 probability of its followers and its rare ones."""
    lost = (rare * ((1 - d[1:]) * np.arange(1, KEEP + 1))).sum(axis=1)
    left = np.where(lost > 0, lost / np.maximum(totals, 1), 1 / (totals + 1))
    return left / (1 - seen)


def _scored(blocks: DataFrame, model: WordModel, levels: list[Level], kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i).known_up_to(model, levels, batch, i)
                base = np.log10((b.count + 1) / (model.tokens + model.words + 1))
                sums = lambda values: np.add.reduceat(values, b.starts)  # noqa: E731, B023
                columns = [~b.texts_train, b.lengths, np.add.reduceat(b.count > 0, b.starts, dtype=np.int64), np.full(len(b.starts), model.tokens), sums(base), sums(np.log10(b.p))]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), *(pa.array(v, f.type) for v, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    id_type = blocks.schema["ids"].dataType.elementType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return blocks.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _counted(pairs: DataFrame, level: Level) -> Level:
    """The level with discounts and the weights of hot contexts, from its answered pairs."""
    rare = pairs.filter("kind in ('table', 'hot')").select(F.posexplode("rare").alias("at", "n")).groupBy((F.col("at") % KEEP).alias("r")).agg(F.sum("n").alias("n")).collect()
    next_up = pairs.filter("kind = 'table'").agg(F.sum(F.size(F.filter("counts", lambda c: c == KEEP + 1)))).first()[0]
    d = discounts([0, *({r["r"]: r["n"] for r in rare}.get(k, 0) for k in range(KEEP)), next_up or 0])
    sums: dict[int, list] = {}
    for r in pairs.filter("kind = 'hot'").select("contexts", "totals", "seen", "rare").collect():
        rare_of = np.array(r["rare"], dtype=np.int64).reshape(-1, KEEP)
        for k, context in enumerate(r["contexts"]):
            have = sums.setdefault(context, [0, 0.0, np.zeros(KEEP, dtype=np.int64)])
            have[0], have[1], have[2] = have[0] + r["totals"][k], have[1] + r["seen"][k], have[2] + rare_of[k]
    weights = {v: (float(backoff(np.array([t]), np.array([s]), r[None, :], d)[0]), not r.any()) for v, (t, s, r) in sums.items()}
    return replace(level, discount=d, hot_weights=weights)


def _hot(numbered: DataFrame, texts: int, limit: int) -> dict[int, int]:
    """Homes of the contexts with over `limit` occurrences. numbered: arrays ids and counts of what is before."""
    found = numbered.select(F.explode(F.arrays_zip("ids", "counts")).alias("w")).filter(F.col("w.counts") > limit).select("w.ids", "w.counts").collect()
    return {r["ids"] + 1: 1 + r["counts"] // limit for r in found} | ({0: 1 + texts // limit} if texts > limit else {})


def _grouped(replies: DataFrame, fields: list[str], name: str) -> DataFrame:
    return replies.filter("kind = 'reply'").groupBy("block").agg(F.collect_list(F.struct("home", *fields)).alias(name))


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_bytes: int = 4 << 20, home_bytes: int = 8 << 20, hot: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    order: tokens of the longest n-grams. base_score: sum of log10((c + 1) / (N + V + 1)) over its tokens; score: log10
    of the model's probability of the text.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    size, texts = d.agg(F.sum(F.octet_length("text")), F.sum(F.col("train").cast("long"))).first()
    homes = max(1, math.ceil((size or 0) / home_bytes))
    word_homes = max(1, homes // 4)
    tokens = rows.written(_tokens(d, block_bytes), "tokens")

    words = rows.written(_answer_words(_ask_words(tokens, word_homes), word_homes), "words")
    table = words.filter("kind = 'table'")
    count_of = [F.sum(F.expr(f"size(filter(counts, c -> c = {r}))")) for r in range(KEEP + 2)]
    n, v, *of_count = table.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.size("counts")), *count_of).first()
    model = WordModel.of(n or 0, v or 0, texts or 0, [x or 0 for x in of_count])
    limit = max(hot or (1 << 20), model.tokens // HOT_WORDS)

    blocks, levels, numbered = tokens.join(_grouped(words, ["ids", "counts"], "words"), "block"), [], table.select("ids", "counts")
    for k in range(2, order + 1):
        level = Level(k, homes * (k - 1), _hot(numbered, model.texts, limit))
        pairs = rows.written(_answer_pairs(_ask_pairs(blocks, model, levels, level), model, level, k < order), f"pairs-{k}")
        levels.append(_counted(pairs, level))
        blocks = blocks.join(_grouped(pairs, ["contexts", "totals", "seen", "rare", "counts", "numbers"], f"replies_{k}"), "block", "left")
        numbered = pairs.filter("kind = 'table'").select(F.col("numbers").alias("ids"), "counts")
    return _scored(blocks, model, levels, kind)
