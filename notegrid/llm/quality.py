"""Text quality statistics and a line model that tells prose from lists, tables and junk.

Each line that isn't blank becomes one of ``SYMBOLS`` symbols: how it begins and
ends, its share of signs, its words, their length and how many of them are
common. A hidden Markov model with the states prose, list, table and junk is
fitted here by forward-backward passes over the lines of all documents, from a
start stated in the code that weighs as ``PRIOR`` of the lines, until the
likelihood rises by less than ``GAIN`` a line. What prose never writes (list and
table lines, stubs, heaps of names) has no chance in the start and so keeps
none; the measures of the whole text have no part in the model. The best label
of every line gives the shares of the labels.

The text is read once: measures and symbols are written as a table, which the
passes read.

Nulls: a null or empty text has no pieces, lines or words; its means and shares
are 0, so it counts as short, of short pieces and without sentence ends. Rows
with a null id are left out, a repeated row is measured each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from notegrid.llm import text as tx
from notegrid.plans.scratch import written

STATES = ("prose", "list", "table", "junk")
SHAPES, ENDS, SIGNS, COUNTS, LENGTHS, KNOWN = 4, 2, 3, 3, 3, 3
SYMBOLS = SHAPES * ENDS * SIGNS * COUNTS * LENGTHS * KNOWN
_SIGN_STEPS, _COUNT_STEPS, _LENGTH_STEPS, _KNOWN_STEPS = (0.1, 0.2), (5, 9), (3.5, 8.5), (1e-9, 0.15)
PRIOR, GAIN = 0.02, 1e-4
#: The common words go to every task; a longer list is refused.
MOST_WORDS = 1_000_000


class Lines:
    """Measures of the texts and of their lines in a block."""

    def __init__(self, texts: list, common: np.ndarray) -> None:
        alnum, space, _, stop = tx.classes()
        cp, begin = tx.points(texts)
        self.n = len(texts)
        is_al, is_sp = alnum[cp], space[cp]
        line_end = np.flatnonzero(cp == 10)  # each text ends with a line feed of ours
        self.line_begin = np.concatenate(([0], line_end[:-1] + 1))
        self.line_doc = np.searchsorted(begin, self.line_begin, "right") - 1

        def total(flag: np.ndarray) -> np.ndarray:
            out = np.zeros(len(flag) + 1, np.int64)
            np.cumsum(flag, out=out[1:])
            return out

        ink, sign = total(~is_sp), total(~is_sp & ~is_al)
        p0, p1 = tx.runs(~is_sp)
        h, word_doc, w0, _ = tx.words(cp, begin)
        at = np.minimum(np.searchsorted(common, h), len(common) - 1) if len(common) else None
        known = common[at] == h if at is not None else np.zeros(len(h), bool)
        by_doc = lambda t: t[begin[1:]] - t[begin[:-1]]
        self.pieces = np.bincount(np.searchsorted(begin, p0, "right") - 1, minlength=self.n)
        self.chars, self.signs = by_doc(ink), by_doc(sign)
        self.words = np.bincount(word_doc, minlength=self.n)
        self.common = np.bincount(word_doc, weights=known, minlength=self.n).astype(np.int64)
        lo, hi = self.line_begin, line_end
        self.line_chars, line_signs = ink[hi] - ink[lo], sign[hi] - sign[lo]
        line_words = np.searchsorted(p0, hi) - np.searchsorted(p0, lo)
        blank = self.line_chars == 0
        last = np.searchsorted(p1, hi, "right") - 1
        ends = np.zeros(len(lo), bool)
        if len(p1):
            ends[~blank] = stop[cp[p1[last[~blank]] - 1]]
        self.lines = np.bincount(self.line_doc, weights=~blank, minlength=self.n).astype(np.int64)
        self.ends = np.bincount(self.line_doc, weights=ends, minlength=self.n).astype(np.int64)
        first = np.zeros(len(lo), np.int64)
        second = np.full(len(lo), 32, np.int64)
        if len(p0):
            f = p0[np.minimum(np.searchsorted(p0, lo), len(p0) - 1)]
            first[~blank] = cp[f[~blank]]
            second[~blank] = cp[np.minimum(f[~blank] + 1, len(cp) - 1)]
        pipes = total((cp == ord("|")) | (cp == 9))
        table = (first == ord("|")) | (pipes[hi] - pipes[lo] >= 2)
        digit = (first >= 48) & (first < 58)
        bullet = np.isin(first, [ord(c) for c in "-*+•"]) & (second == 32) | digit & np.isin(second, [ord(c) for c in ".)"]) | digit & (second >= 48) & (second < 58) & ~ends
        opened = total((cp == ord("[")) & np.concatenate((cp[1:] == ord("["), [False])))
        linked = opened[hi] - opened[lo]
        heading = (first == ord("#")) & np.isin(second, (32, ord("#")))
        shape = np.where(heading, 3, np.where(table & (linked < 3), 2, np.where(bullet | (linked >= 1) & (linked * 6 >= line_words), 1, 0)))
        in_line = np.searchsorted(lo, w0, "right") - 1
        all_words, common_words = np.bincount(in_line, minlength=len(lo)), np.bincount(in_line, weights=known, minlength=len(lo))
        share = line_signs / np.maximum(1, self.line_chars)
        mean = self.line_chars / np.maximum(1, line_words)
        code = shape
        for values, n in ((ends.astype(np.int64), ENDS), (np.digitize(share, _SIGN_STEPS), SIGNS), (np.digitize(line_words, _COUNT_STEPS), COUNTS), (np.digitize(mean, _LENGTH_STEPS), LENGTHS), (np.digitize(common_words / np.maximum(1, all_words), _KNOWN_STEPS), KNOWN)):
            code = code * n + values
        keep = ~blank
        part = lambda a, b: a / np.maximum(1, b)
        self.mean, self.sign_share = part(self.chars, self.pieces), part(self.signs, self.chars)
        self.ended, self.known = part(self.ends, self.lines), part(self.common, self.words)
        self.flags = (self.pieces < 30).astype(np.int64) + ((self.mean < 3.5) | (self.mean > 8.5)) + (self.sign_share > 0.2) + (self.ended < 0.4) + (self.known < 0.15)
        self.line_doc, self.symbol = self.line_doc[keep], code[keep]
        self.line_chars = np.where(heading, 0, self.line_chars)[keep]


Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def start_model() -> Model:
    """Stated start: chances of the first state, of the next one, of the end after a state, and of the symbols of a state."""
    emit = np.zeros((4, SYMBOLS))
    for s, (shape, end, sign, count, length, known) in enumerate(np.ndindex(SHAPES, ENDS, SIGNS, COUNTS, LENGTHS, KNOWN)):
        even = length == 1
        emit[0, s] = (3, 0, 0, 2)[shape] * (1, 3)[end] * (4, 1, 0.1)[sign] * (0.5, 2, 4)[count] * (3 if even else 0.3) * (0.05, 0.2, 4)[known]
        if shape == 0 and (not end and count == 0 or known == 0 and (count == 2 or not end or sign == 2)):  # a stub or a heap of names
            emit[0, s] = 0
        emit[1, s] = (0.3, 4, 0.1, 2)[shape] * (2, 1)[end] * (2, 2, 1)[sign] * (2, 2, 1)[count] * (2 if even else 0.7) * (1.5, 1, 1)[known]
        emit[2, s] = (0.02, 0.05, 8, 2)[shape] * (2, 0.1)[end] * (0.5, 1, 2)[sign] * (0.7, 1, 2)[count] * (2, 1, 0.3)[known]
        emit[3, s] = (1, 0.3, 0.3, 2)[shape] * (2, 0.5)[end] * (0.5, 1, 3)[sign] * (2, 1, 1)[count] * (0.7 if even else 3) * (4, 1, 0.1)[known]
    emit /= emit.sum(axis=1, keepdims=True)
    end = np.array([0.1, 0.1, 0.1, 0.3])
    return np.array([0.55, 0.15, 0.15, 0.15]), (np.full((4, 4), 0.04) + np.eye(4) * 0.84) * (1 - end)[:, None], end, emit


class Steps:
    """Lines of the texts of a block, taken in step: the k-th lines of all texts that have so many."""

    def __init__(self, symbol: np.ndarray, doc: np.ndarray) -> None:
        self.symbol = symbol
        self.first = np.flatnonzero(np.diff(doc, prepend=-1))
        size = np.diff(np.append(self.first, len(doc)))
        order = np.argsort(-size, kind="stable")
        self.at, size = self.first[order], size[order]
        self.live = [*np.searchsorted(-size, -np.arange(1, size[0] + 1), "right").tolist(), 0] if len(size) else [0]

    def place(self, k: int) -> np.ndarray:
        return self.at[: self.live[k]] + k


def expect(symbol: np.ndarray, doc: np.ndarray, model: Model) -> np.ndarray:
    """Expected counts by a forward and a backward pass: 4 first states, 16 moves, 4 ends, 4 x SYMBOLS symbols, and the log likelihood."""
    out = np.zeros(25 + 4 * SYMBOLS)
    if not len(symbol):
        return out
    begin, move, end, emit = model
    steps, n = Steps(symbol, doc), len(symbol)
    ahead, scale, like = [], [], 0.0
    for k in range(len(steps.live) - 1):
        chance = emit[:, symbol[steps.place(k)]].T
        a = (ahead[-1][: steps.live[k]] @ move if k else begin) * chance
        scale.append(a.sum(axis=1, keepdims=True))
        ahead.append(a / scale[-1])
        like += float(np.log(scale[-1]).sum())
    moves, ends, state = np.zeros((4, 4)), np.zeros(4), np.zeros((n, 4))
    after = np.zeros((0, 4))
    for k in range(len(steps.live) - 2, -1, -1):
        now, more = steps.live[k], steps.live[k + 1]
        back = np.empty((now, 4))
        back[more:] = end
        come = emit[:, symbol[steps.place(k + 1)]].T * after / scale[k + 1] if more else after
        back[:more] = come @ move.T
        both = ahead[k] * back
        total = both.sum(axis=1, keepdims=True)
        both /= total
        state[steps.place(k)] = both
        moves += move * ((ahead[k][:more] / total[:more]).T @ come)
        ends += both[more:].sum(axis=0)
        like += float(np.log(total[more:]).sum())
        after = back
    out[:4], out[4:20], out[20:24], out[24] = state[steps.first].sum(axis=0), moves.ravel(), ends, like
    out[25:] = np.concatenate([np.bincount(symbol, state[:, k], SYMBOLS) for k in range(4)])
    return out


def fitted(counts: np.ndarray, start: Model, prior: float = PRIOR) -> Model:
    """The model of expected counts; the start weighs as ``prior`` of them."""
    begin, move, end, emit = start
    texts, lines = counts[:4].sum() * prior, counts[25:].sum() * prior / 4
    begin = counts[:4] + texts * begin
    move, end = counts[4:20].reshape(4, 4) + lines * move, counts[20:24] + lines * end
    emit = counts[25:].reshape(4, SYMBOLS) + lines * emit
    leave = move.sum(axis=1) + end
    return begin / begin.sum(), move / leave[:, None], end / leave, emit / emit.sum(axis=1, keepdims=True)


def decode(symbol: np.ndarray, doc: np.ndarray, model: Model) -> np.ndarray:
    """Best state of each line (Viterbi), all texts of the block in step."""
    out = np.zeros(len(symbol), np.int64)
    if not len(symbol):
        return out
    with np.errstate(divide="ignore"):
        begin, move, end, emit = (np.log(x) for x in model)
    steps = Steps(symbol, doc)
    score = begin + emit[:, symbol[steps.place(0)]].T
    back: list[np.ndarray] = []
    final = np.zeros(steps.live[0], np.int64)
    for k in range(len(steps.live) - 1):
        more = steps.live[k + 1]
        final[more : steps.live[k]] = (score[more:] + end).argmax(axis=1)
        if more:
            ways = score[:more, :, None] + move
            back.append(ways.argmax(axis=1).astype(np.int8))
            score = ways.max(axis=1) + emit[:, symbol[steps.place(k + 1)]].T
    for k in range(len(steps.live) - 2, -1, -1):
        at = steps.place(k)
        out[at] = final[: len(at)]
        if k:
            final[: len(at)] = back[k - 1][np.arange(len(at)), final[: len(at)]]
    return out


_MEASURES = "doc_id bigint, pieces bigint, mean_length double, symbol_ratio double, ended_lines double, common_share double, words bigint, lines bigint, flags int"


def _common(words: DataFrame) -> np.ndarray:
    if words.count() > MOST_WORDS:
        raise ValueError(f"a list of common words has at most {MOST_WORDS:,} entries")
    rows = words.select("word").where("word is not null").distinct().collect()
    return np.unique(np.array([tx.hash_word(r["word"]) for r in rows], np.uint64))


def _measured(docs: DataFrame, common_words: DataFrame, id_col: str, text_col: str, with_lines: bool) -> DataFrame:
    common = _common(common_words)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["id"].to_numpy()
            for lo, hi in tx.blocks(texts):
                x = Lines(texts[lo:hi], common)
                out = pd.DataFrame({
                    "doc_id": ids[lo:hi], "pieces": x.pieces, "mean_length": x.mean, "symbol_ratio": x.sign_share, "ended_lines": x.ended, "common_share": x.known,
                    "words": x.words, "lines": x.lines, "flags": x.flags})
                if with_lines:
                    cut = np.searchsorted(x.line_doc, np.arange(1, x.n))
                    out["symbol"], out["chars"] = np.split(x.symbol.astype(np.int16), cut), np.split(x.line_chars, cut)
                yield out

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInPandas(measure, _MEASURES + (", symbol array<smallint>, chars array<bigint>" if with_lines else ""))


def measures(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: measures of the text, and ``flags``: how many of the five limits it breaks."""
    return _measured(docs, common_words, id_col, text_col, False)


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    size = pdf["symbol"].map(len).to_numpy(np.int64)
    flat = np.concatenate(pdf["symbol"].tolist()) if size.sum() else np.zeros(0, np.int64)
    return flat.astype(np.int64), np.repeat(np.arange(len(pdf)), size)


def train(lines: DataFrame) -> Model:
    """The model, by passes over the symbols of all texts; each brings its expected counts, 25 + 4 * SYMBOLS numbers, to the driver."""
    start = model = start_model()
    before = None
    while True:

        def count(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            total = np.zeros(25 + 4 * SYMBOLS)
            for pdf in batches:
                total += expect(*_flat(pdf), model)
            yield pd.DataFrame({"k": np.flatnonzero(total), "n": total[total != 0]})

        counts = np.zeros(25 + 4 * SYMBOLS)
        for r in lines.select("symbol").mapInPandas(count, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
            counts[r["k"]] = r["n"]
        if not counts[25:].any():
            return start
        model, like = fitted(counts, start), counts[24] / counts[25:].sum()
        if before is not None and like - before < GAIN:
            return model
        before = like


def statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measures`` and the share of each text's characters in lines of each label; lines of headings don't weigh."""
    lines = written(_measured(docs, common_words, id_col, text_col, True), "lines")
    model = train(lines)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            symbol, doc = _flat(pdf)
            weight = np.zeros((4, len(pdf)))
            np.add.at(weight, (decode(symbol, doc, model), doc), np.concatenate([*pdf["chars"].tolist(), np.zeros(0, np.int64)]))
            total = np.maximum(1, weight.sum(axis=0))
            yield pdf.drop(columns=["symbol", "chars"]).assign(**{s: weight[k] / total for k, s in enumerate(STATES)})

    return lines.mapInPandas(label, _MEASURES + "".join(f", {s} double" for s in STATES))


def not_prose(stats: DataFrame, flags: int = 2, prose: float = 0.5) -> DataFrame:
    """Ids of documents that break ``flags`` limits and of which less than ``prose`` is labelled prose."""
    return stats.where((F.col("flags") >= flags) & (F.col("prose") < prose)).select("doc_id").distinct()
