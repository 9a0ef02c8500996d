"""Language identification by cross-parsing entropy (operator 4).

For each language a reference text is drawn from labelled documents and a suffix automaton is built over it. A text
is parsed against each automaton into phrases, each the longest match with the reference (a symbol that the reference
lacks goes with the phrase that it ends); references are equally long, so the language with the fewest phrases a symbol, the least cross-entropy, wins.

The reference is a bounded sample, a documented parameter: of each language, the `ref_docs` labelled documents with
the least id hash, of each its first `ref_doc_chars` characters, cut to `ref_chars` characters in all (`all_chars` over every
language). Texts to predict are parsed whole, in blocks of `BLOCK` symbols that start afresh, so that long and short
texts go through the automata side by side as array operations. Prediction is map only.

Symbols: letters, lower-cased, and one blank for each run of other characters. Each automaton has the whole alphabet
of its reference, of any script; a letter that the reference lacks matches nothing there, so all such are one symbol
to it. Alphabets up to `DENSE` symbols have a full table of transitions, larger ones a sorted one. Defined results: `und` with score 0 for null text or a text without a letter; ties
go to the first name; score is 1 - best / second best (1 if there is one language only); with no labelled text every
row is `und`; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import small_batches


PAD, BLANK, OTHER = 0, 1, 2
DENSE = 256
BLOCK = 2048
UND = "und"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def reference_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ref_docs: int = 200, ref_doc_chars: int = 2000, ref_chars: int = 24_000, all_chars: int = 400_000) -> dict[str, str]:
    """A bounded text of each language: at most ref_docs * ref_doc_chars characters of it reach the driver."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, ref_doc_chars).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    w = Window.partitionBy("lang").orderBy("h", "text")
    rows = labelled.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= ref_docs).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("texts")).collect()
    share = min(ref_chars, all_chars // max(1, len(rows)))
    out = {}
    for row in rows:
        text = " ".join(letters(t["text"]) for t in row["texts"])[:share].strip()
        if text:
            out[row["lang"]] = text
    least = min(map(len, out.values()), default=0)
    # equally long references; a language with little text gets it repeated, which adds no phrase
    return {k: v if len(v) >= share else (v + " ") * (max(least, len(v)) // (len(v) + 1)) + v for k, v in sorted(out.items())}


def letters(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Automaton:
    """Suffix automaton of a text of symbols; its symbols are renumbered, 0 stands for all that it lacks."""

    def __init__(self, text: np.ndarray, alphabet: int):
        own = np.unique(text)
        self.local = np.zeros(alphabet, np.int32)
        self.local[own] = np.arange(1, len(own) + 1)
        self.width = len(own) + 1
        step = self._states(self.local[text].tolist())
        keys = np.array([s * self.width + c for s, row in enumerate(step) for c in sorted(row)], np.int64)
        to = np.array([row[c] * self.width for row in step for c in sorted(row)], np.int32)
        root = np.zeros(self.width, np.int32)
        root[keys[: len(own)]] = to[: len(own)]
        if self.width <= DENSE:
            table = np.tile(~root, len(step))
            table[keys] = to
            self.after = table.__getitem__
        else:

            def after(at):
                i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
                return np.where(keys[i] == at, to[i], ~root[at % self.width])

            self.after = after
        # `after` a place (width * state + symbol): width * next state, or ~(that after the root) where a phrase ends

    @staticmethod
    def _states(text: list[int]) -> list[dict[int, int]]:
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        return step


class Parser:
    """The automata of all languages."""

    def __init__(self, references: dict[str, str]):
        self.names = sorted(references)
        alphabet = sorted(set("".join(references.values())) - {" "})
        self.symbol = np.full(sys.maxunicode + 1, BLANK, np.int32)
        for cp in range(sys.maxunicode + 1):
            if chr(cp).isalpha():
                self.symbol[cp] = OTHER
        for i, c in enumerate(alphabet):
            self.symbol[ord(c)] = OTHER + 1 + i
        self.automata = [Automaton(self.codes(references[n]), OTHER + 1 + len(alphabet)) for n in self.names]

    def codes(self, text: str) -> np.ndarray:
        got = self.symbol[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        keep = got != BLANK
        if len(got):
            keep[1:] |= got[:-1] != BLANK
            keep[0] = True
        return got[keep]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (row) by each language, and its number of symbols (0 without a letter)."""
        codes = [self.codes(t or "") for t in texts]
        size = np.array([len(c) if (c > BLANK).any() else 0 for c in codes], np.int64)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        lanes = [(min(BLOCK, n - at), k, at) for k, n in enumerate(size.tolist()) for at in range(0, n, BLOCK)]
        if not lanes:
            return out, size
        lanes.sort(key=lambda x: -x[0])
        length = np.array([x[0] for x in lanes])
        owner = np.array([x[1] for x in lanes])
        grid = np.zeros((len(lanes), int(length[0])), np.int32)
        for row, (n, k, at) in zip(grid, lanes):
            row[:n] = codes[k][at : at + n]
        grid = np.ascontiguousarray(grid.T)
        active = np.searchsorted(-length, -np.arange(1, len(grid) + 1), "right")
        for j, automaton in enumerate(self.automata):
            state, ended = np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int32)
            for column, n in zip(grid, active.tolist()):
                s = state[:n]
                s += automaton.local[column[:n]]
                got = automaton.after(s)
                sign = got >> 31
                ended[:n] -= sign
                np.bitwise_xor(got, sign, out=s)
            out[:, j] = np.bincount(owner, ended + 1, len(texts))
        return out, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts, size = self.phrases(texts)
        if not self.names:
            return [UND] * len(texts), [0.0] * len(texts)
        entropy = counts / np.maximum(size, 1)[:, None]
        best = entropy.argmin(1)
        ordered = np.sort(entropy, 1)
        score = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-12) if len(self.names) > 1 else np.ones(len(texts))
        return [self.names[b] if n else UND for b, n in zip(best, size)], np.where(size > 0, score, 0.0).tolist()


_PARSERS: dict[int, Parser] = {}


def identify(docs: DataFrame, references: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    data = docs.sparkSession.sparkContext.broadcast(references)  # bounded by all_chars

    def run(batches):
        key = zlib.crc32(repr(sorted(data.value.items())).encode())
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(data.value)
        for batch in small_batches(batches):
            lang, score = _PARSERS[key].predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")
