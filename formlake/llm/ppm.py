"""Prediction by partial matching over bytes: a pretrained context trie scores whole texts.

The trie holds, for every context of up to ``order`` bytes seen in training, how often each byte (or the
end of the text) followed. A byte that didn't follow the longest seen context is reached by an escape to
the context shortened by one (method C: as many escapes as distinct successors), where the bytes
already ruled out are excluded; below the empty context all bytes not seen at all are alike. Since a
context's successors are also successors of the shortened one, the excluded counts are constants of the
longer context, and the whole model is two lookup tables.

Counting is a map-side combined Spark aggregation over all texts. The trie is built by executors in blocks of
bounded size: a block holds whole contexts that end in the same two symbols or, where these are too many, in
the same three, so all it needs of other blocks is what follows single symbols and such a pair. A block gives
every distinct gram of the corpus, held-out ones too, its log probability. One pass over the texts then adds
these up: the most frequent grams and words are broadcast, up to a fixed number, the others are joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm import words as W
from formlake.llm.common import distinct_names, store

START, END, BASE = 256, 257, 258
ORDER = 5
#: Grams of the longest order in one block of the trie, about 70 MB with the tables built on them.
BLOCK_ENTRIES = 1_000_000
#: The most frequent words (16 bytes each) and grams (about 32) are broadcast; the others are joined.
HEAD_WORDS = 500_000
HEAD_GRAMS = 500_000
#: Keys a task gathers before it hands them on.
HELD_KEYS = 3_000_000

_U = np.uint64
_FIBONACCI = _U(0x9E3779B97F4A7C15)
_GRAM, _WORD, _TEXT_END = 0, 1, 2


# ---- counting


def symbols(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as numbers, each behind ``order`` starts and before one end, and their n + 1 places."""
    data, at = W.text_bytes(texts)
    n = len(at) - 1
    out = np.full(len(data) + n * (order + 1), START, np.uint16)
    shift = np.arange(n) * (order + 1) + order
    out[np.arange(len(data)) + np.repeat(shift, np.diff(at))] = data
    places = at + np.arange(n + 1) * (order + 1)
    out[places[1:] - 1] = END
    return out, places


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every predicted symbol with the ``order`` symbols before it, as one number; offsets of the rows."""
    s, places = symbols(texts, order)
    if len(s) == 0:
        return np.zeros(0, _U), places
    m = len(s) - order
    code = s[:m].astype(_U)
    for j in range(1, order + 1):
        code *= _U(BASE)
        code += s[j:m + j]
    code = code[s[order:] != START]
    return code, places - np.arange(len(places)) * order


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often (or with what total weight) each occurs."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first)


class _Tally:
    """Running counts of keys, combined now and then; ``trained`` keys count for the model too."""

    def __init__(self, kind: int, trained: bool):
        self.kind, self.trained, self.parts, self.size = kind, trained, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(tally(keys))
        self.size += len(self.parts[-1][0])
        if self.size > HELD_KEYS:
            self._combine()

    def _combine(self) -> None:
        self.parts = [tally(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]
        self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return self.size > HELD_KEYS

    def rows(self):
        if self.parts:
            self._combine()
            keys, n = self.parts[0]
            self.parts, self.size = [], 0
            for i in range(0, len(keys), 100_000):
                part, counts = keys[i:i + 100_000].view(np.int64), n[i:i + 100_000]
                yield _count_rows(self.kind, part, counts, counts if self.trained else np.zeros_like(counts))


def _count_rows(kind: int, keys, n, trained) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), kind, np.int32)), *[pa.array(x, pa.int64()) for x in (keys, n, trained)]],
        ["kind", "key", "n", "trained"])


def _counter(order: int):
    """Per gram: occurrences in all texts and in those for training; per word: those for training."""

    def count(batches):
        tallies, texts = (_Tally(_GRAM, True), _Tally(_GRAM, False), _Tally(_WORD, True)), 0
        for part in W.slices(batches, "text"):
            held = part.column("held_out")
            column = part.column("text").filter(pc.invert(held))
            tallies[0].add(grams(column, order)[0])
            tallies[1].add(grams(part.column("text").filter(held), order)[0])
            tallies[2].add(W.words(column, fold=True).hashes)
            texts += len(column)
            for t in tallies:
                if t.full():
                    yield from t.rows()
        for t in tallies:
            yield from t.rows()
        if texts:
            yield _count_rows(_TEXT_END, [0], [texts], [texts])

    return count


# ---- the model


class Table:
    """Places of 64-bit keys: keys are kept in order of a hash whose top bits lead to them."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(1, len(keys).bit_length())
        slot = self._slot(keys)
        self.order = np.argsort(slot, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        counts = np.bincount(slot, minlength=1 << self.bits)
        del slot
        self.longest = int(counts.max()) if len(keys) else 0
        self.first = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(counts, out=self.first[1:])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FIBONACCI) >> _U(64 - self.bits)).view(np.int64)

    def arrange(self, values: np.ndarray) -> np.ndarray:
        """Values in the order of the places that ``find`` gives."""
        return values[self.order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if self.longest == 0 or len(keys) == 0:
            return out
        slot = self._slot(keys)
        at, end = self.first[slot], self.first[slot + 1]
        todo = None
        for _ in range(self.longest):
            live = at < end
            if todo is None:
                todo = np.flatnonzero(live)
            else:
                todo = todo[live]
            at, end = at[live], end[live]
            if not len(todo):
                break
            here = self.keys[at] == (keys[todo])
            out[todo[here]] = at[here]
            at, end, todo = at[~here] + 1, end[~here], todo[~here]
        return out


@dataclass
class Block:
    """Lookup tables for some contexts, and for all those that these are shortened to."""

    order: int
    pairs: Table
    log_first: np.ndarray  # log10 probability when the search starts at this context
    log_count: np.ndarray
    nodes: Table
    log_escape: np.ndarray  # of the context itself
    log_total: np.ndarray  # of the shortened context without this one's successors
    log_shorter_escape: np.ndarray
    log_empty_escape: float
    log_unseen: float


def _tagged(codes: np.ndarray, order: int) -> np.ndarray:
    """Codes of all orders in one table: the order is in the low three bits."""
    return codes * _U(8) + _U(order)


def _safe_log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.where(x > 0, x, 1).astype(np.float64))


def build_block(
    order: int, codes: np.ndarray, counts: np.ndarray, low_codes: np.ndarray, low_counts: np.ndarray,
    pair: tuple[np.ndarray, np.ndarray] | None = None,
) -> Block:
    """From counts of the longest grams of these contexts, and counts of all pairs of symbols.

    If the contexts that end in a pair of symbols are not all here, ``pair`` has what follows that pair.
    """
    levels = {1: (low_codes.astype(_U), low_counts.astype(np.int64))}
    levels[0] = tally(levels[1][0] % _U(BASE), levels[1][1])
    top, n_top = codes.astype(_U), counts.astype(np.int64)
    for j in range(order, 1, -1):
        levels[j] = tally(top % _U(BASE ** (j + 1)), n_top)
    if pair is not None:
        levels[2] = tally(pair[0].astype(_U), pair[1].astype(np.int64))
    pair_keys, first, count = [], [], []
    node_keys, escape, total, shorter = [], [], [], []
    sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for j in range(order + 1):
        code, n = levels[j]
        context = code // _U(BASE)
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(code) else np.zeros(0, int)
        size = np.diff(np.append(starts, len(code)))
        weight = np.add.reduceat(n, starts) if len(code) else np.zeros(0, np.int64)
        sums[j] = context[starts], weight, size
        pair_keys.append(_tagged(code, j))
        logs = _safe_log(n)
        first.append((logs - np.repeat(_safe_log(weight + size), size)).astype(np.float32))
        count.append(logs.astype(np.float32))
        if j:
            shorter_code, shorter_n = levels[j - 1]
            here = np.searchsorted(shorter_code, code % _U(BASE ** j))
            taken = np.add.reduceat(shorter_n[here], starts) if len(code) else np.zeros(0, np.int64)
            parent = np.searchsorted(sums[j - 1][0], context[starts] % _U(BASE ** (j - 1)))
            rest, fresh = sums[j - 1][1][parent] - taken, sums[j - 1][2][parent] - size
            node_keys.append(_tagged(context[starts], j))
            escape.append(_safe_log(size) - _safe_log(weight + size))
            total.append(_safe_log(rest + fresh))
            shorter.append(np.where(fresh > 0, _safe_log(fresh) - _safe_log(rest + fresh), 0.0))
    seen = len(levels[0][0])
    weight = int(levels[0][1].sum())
    levels.clear(), sums.clear()
    nodes = Table(np.concatenate(node_keys))
    node_values = [nodes.arrange(np.concatenate(x)) for x in (escape, total, shorter)]
    for x in (node_keys, escape, total, shorter):
        x.clear()
    pairs = Table(np.concatenate(pair_keys))
    pair_keys.clear()
    pair_values = [pairs.arrange(np.concatenate(x)) for x in (first, count)]
    pairs.order = nodes.order = None
    return Block(
        order, pairs, *pair_values, nodes, *node_values,
        math.log10(seen / (weight + seen)) if seen else 0.0, -math.log10(max(1, BASE - 1 - seen)),
    )


def log10_probability(block: Block, code: np.ndarray) -> np.ndarray:
    """For each gram, the log10 probability of its last symbol after the others."""
    order = block.order
    place = block.pairs.find(_tagged(code, order))
    out = block.log_first[place].astype(np.float64) if len(block.log_first) else np.zeros(len(code))
    left = np.flatnonzero(place < 0)
    value = np.zeros(len(left))
    code = code[left]
    node = block.nodes.find(_tagged(code // _U(BASE), order))
    value += np.where(node >= 0, block.log_escape[node] if len(block.log_escape) else 0.0, 0.0)
    for j in range(order - 1, -1, -1):
        place = block.pairs.find(_tagged(code % _U(BASE ** (j + 1)), j))
        came = node >= 0  # by an escape, so that symbols are excluded
        hit = place >= 0
        if hit.any():
            at, from_node = place[hit], node[hit]
            excluding = block.log_count[at] - (block.log_total[from_node] if len(block.log_total) else 0.0)
            out[left[hit]] = value[hit] + np.where(came[hit], excluding, block.log_first[at])
        miss = ~hit
        left, value, code, came, node = left[miss], value[miss], code[miss], came[miss], node[miss]
        if j:
            here = block.nodes.find(_tagged(code % _U(BASE ** (j + 1)) // _U(BASE), j))
            if len(block.log_escape):
                own = np.where(here >= 0, block.log_escape[here], 0.0)
                value += np.where(came, block.log_shorter_escape[node], own)
            node = here
        elif len(block.log_escape):
            value += np.where(came, block.log_shorter_escape[node], block.log_empty_escape)
    out[left] = value + block.log_unseen
    return out


# ---- Spark


def _gram_scores(counts: DataFrame, order: int, block_entries: int) -> DataFrame:
    """(key, n, value): the log10 probability of every distinct gram, from blocks that executors build.

    The driver sees only what follows single symbols, and what is counted per pair of symbols stays a table:
    both are bounded by the alphabet.
    """
    spark = counts.sparkSession
    top = counts.where(F.col("kind") == _GRAM).select("key", "n", "trained")
    low = top.where("trained > 0").groupBy((F.col("key") % BASE ** 2).alias("key")).agg(F.sum("trained").alias("n"))
    low = low.orderBy("key").toArrow()  # at most 258^2 rows
    low = spark.sparkContext.broadcast((low.column("key").to_numpy(), low.column("n").to_numpy()))
    tailed = top.withColumn("tail", F.expr(f"(key div {BASE}) % {BASE ** 2}"))
    third = F.expr(f"(key div {BASE ** 3}) % {BASE}")
    half = max(1, block_entries // 2)
    n_blocks = F.ceil(F.sum("size").over(Window.partitionBy()) / half)  # over at most 258^2 rows
    tails = tailed.groupBy("tail").agg(F.count(F.lit(1)).alias("size"))
    tails = tails.select("tail", F.ceil(F.col("size") / half).alias("parts"), n_blocks.alias("n_blocks"))
    split = F.col("parts") > 1
    dealt = tailed.join(F.broadcast(tails), "tail").select(
        F.when(split, F.col("tail")).otherwise(-1).alias("pair"),
        F.when(split, F.pmod(F.xxhash64(third), F.col("parts"))).otherwise(
            F.pmod(F.xxhash64("tail"), F.col("n_blocks"))).alias("part"),
        F.lit(False).alias("follows"), "key", "n", "trained")
    # What follows a pair whose contexts are split goes to each of its blocks: at most 258 rows a pair.
    wide = tails.where(split).select("tail", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    followers = tailed.where("trained > 0").join(F.broadcast(tails.where(split).select("tail")), "tail", "left_semi")
    followers = followers.groupBy("tail", (F.col("key") % BASE ** 3).alias("key")).agg(F.sum("trained").alias("n"))
    followers = followers.join(wide, "tail").select(
        F.col("tail").alias("pair"), "part", F.lit(True).alias("follows"), "key", "n", F.col("n").alias("trained"))

    def score(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        follows = rows.column("follows").to_numpy()
        key, n, trained = (rows.column(c).to_numpy() for c in ("key", "n", "trained"))
        own, seen = ~follows, ~follows & (trained > 0)
        # A split pair that no training text has is not followed by anything.
        pair = (key[follows], n[follows]) if rows.column("pair")[0].as_py() >= 0 else None
        block = build_block(order, key[seen], trained[seen], *low.value, pair)
        parts = [log10_probability(block, x.astype(_U)) for x in np.array_split(key[own], 1 + own.sum() // 200_000)]
        out = pa.Table.from_arrays(
            [pa.array(key[own]), pa.array(n[own]), pa.array(np.concatenate(parts))], ["key", "n", "value"])
        W.give_back()
        return out

    blocks = dealt.unionByName(followers).groupBy("pair", "part")
    return store(blocks.applyInArrow(score, "key long, n long, value double"), "gram-scores")


def _scorer(head_words, head_grams, order: int):
    def score(batches):
        (word_table, word_logs), (gram_table, gram_logs) = head_words.value, head_grams.value
        for part in W.slices(batches, "text"):
            column = part.column("text")
            w = W.words(column, fold=True)
            word = _looked_up(word_table, word_logs, w.hashes, w.rows)
            gram = _looked_up(gram_table, gram_logs, *grams(column, order))
            yield pa.RecordBatch.from_arrays([
                part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(w.counts), *word, *gram,
            ], ["row", "doc_id", "held_out", "n_words", "head_words", "word_score", "word_tail",
                "head_grams", "score", "gram_tail"])

    return score


_SCORED = (
    "held_out boolean, n_words long, head_words long, word_score double, word_tail array<struct<key: long, times: long>>, "
    "head_grams long, score double, gram_tail array<struct<key: long, times: long>>"
)


def _looked_up(table: Table, logs: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> list[pa.Array]:
    """Per row: how many of its keys are in the table, the sum of their logs, the other keys and their counts."""
    place = table.find(keys)
    known = place >= 0
    value = np.zeros(len(keys))
    value[known] = logs[place[known]]
    hits = np.concatenate([[0], np.cumsum(known)])
    # Sums of each row on its own: differences of running sums would lose digits.
    sums = np.zeros(len(rows) - 1)
    full = np.flatnonzero(rows[1:] > rows[:-1])
    if len(full):
        sums[full] = np.add.reduceat(value, rows[full])
    left = np.flatnonzero(~known)
    row, rest = np.searchsorted(rows, left, side="right") - 1, keys[left]
    by = np.lexsort((rest, row))
    row, rest = row[by], rest[by]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (rest[1:] != rest[:-1])])) if len(row) else by
    times = np.diff(np.append(first, len(row)))
    tail = pa.StructArray.from_arrays([pa.array(rest[first].view(np.int64)), pa.array(times, pa.int64())], ["key", "times"])
    at = np.searchsorted(row[first], np.arange(len(rows)))
    return [pa.array(np.diff(hits[rows])), pa.array(sums), pa.ListArray.from_arrays(pa.array(at, pa.int32()), tail)]


def _head(table: DataFrame, limit: int):
    """(broadcast of the most frequent keys and their values, condition of the keys that aren't in it)."""
    step = F.floor(F.log2("n") * 8)
    bins = table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    cut, held = None, 0
    for r in bins:  # at most 8 * 63 rows
        if held + r["n"] > limit:
            break
        cut, held = r["step"], held + r["n"]
    frequent = F.lit(False) if cut is None else step >= cut
    head = table.where(frequent).select("key", "value").toArrow()
    keys = Table(head.column("key").to_numpy().view(_U) if head.num_rows else np.zeros(0, _U))
    values = keys.arrange(head.column("value").to_numpy()) if head.num_rows else np.zeros(0)
    keys.order = None
    return table.sparkSession.sparkContext.broadcast((keys, values)), ~frequent


def _tail_sums(scored: DataFrame, column: str, values: DataFrame, n: str, score: str) -> DataFrame:
    """(row, keys of its tail that have a value, sum of their values)."""
    rest = scored.where(F.size(column) > 0).select("row", F.inline(column)).join(values.select("key", "value"), "key")
    return rest.groupBy("row").agg(F.sum("times").alias(n), F.sum(F.col("times") * F.col("value")).alias(score))


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, folds: int = 5, held_fold: int = 1,
    block_entries: int = BLOCK_ENTRIES, head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS,
) -> DataFrame:
    """Trains on all texts but one fold and scores all: one row per input row.

    Columns: doc_id, held_out (crc32 of the id as text, modulo ``folds``, is ``held_fold``; a null id counts as
    the text ''), n_tokens (words and one end), n_known (seen in training), train_tokens, base_score (log10
    probability under smoothed word frequencies, A-Z lower-cased), score (log10 probability of the bytes of
    the text and its end under the byte model). Null and empty texts have only the end. Repeated rows are
    counted and scored each. If no row is in training, all counts are 0: the base score is
    0 and every symbol has probability 1/257. An empty table gives an empty table. Extra columns are ignored.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    docs = distinct_names(df, doc_id=id_col, text=text_col)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    docs = docs.select("doc_id", (fold == held_fold).alias("held_out"), "text")
    counted = docs.select("text", "held_out").mapInArrow(_counter(order), "kind int, key long, n long, trained long")
    counts = store(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")), "counts")
    words = counts.where(F.col("kind") == _WORD).select("key", "n", F.log10(F.col("n") + 0.5).alias("value"))
    ends = counts.where(F.col("kind") == _TEXT_END).agg(F.sum("n")).first()[0] or 0
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    gram_scores = _gram_scores(counts, order, block_entries)
    word_head, in_word_tail = _head(words, head_words)
    gram_head, in_gram_tail = _head(gram_scores, head_grams)

    kind = df.select(df[id_col].alias("doc_id")).schema["doc_id"].dataType.simpleString()
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    scored = rows.mapInArrow(_scorer(word_head, gram_head, order), f"row long, doc_id {kind}, {_SCORED}")
    scored = store(scored, "scored")
    rare_words = _tail_sums(scored, "word_tail", words.where(in_word_tail), "rare_words", "rare_word_score")
    rare_grams = _tail_sums(scored, "gram_tail", gram_scores.where(in_gram_tail), "rare_grams", "rare_gram_score")
    out = scored.drop("word_tail", "gram_tail").join(rare_words, "row", "left").join(rare_grams, "row", "left")
    out = out.fillna(0, ["rare_words", "rare_word_score", "rare_gram_score"])
    n_tokens, known_words = F.col("n_words") + 1, F.col("head_words") + F.col("rare_words")
    base = (
        F.col("word_score") + F.col("rare_word_score") + (F.col("n_words") - known_words) * math.log10(0.5)
        + math.log10(ends + 0.5) - n_tokens * math.log10(total + 0.5 * (distinct + 1))
    )
    return out.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (known_words + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.col("rare_gram_score")).alias("score"),
    )
