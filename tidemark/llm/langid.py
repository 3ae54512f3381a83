"""Language identification by cross-parsing: the language whose sample needs the fewest phrases for a text wins.

For each language a suffix automaton of sampled texts is built; it accepts exactly the sample's substrings. A text is
parsed greedily into longest matches: the automaton is followed as long as it can be, then a new phrase begins. Phrases by
symbols is the cross-entropy estimate that languages are compared by.

The automata are turned into one dense table of moves, in which a failed match leads to where the next phrase begins, with
a mark. Following it is then one look-up for a symbol, and many texts go side by side as lanes of arrays. A lane is a block
of LANE symbols of a text, and each block begins a phrase of its own; so time and memory do not depend on text lengths.

Null texts and texts without a letter get `und` and score 0, as does every text if there is nothing to learn from. Rows
with a null doc_id are neither learned from nor held out. Ties go to the language that sorts first. Repeated rows count each,
an empty table gives an empty one. Other columns don't matter; identify() puts its values in place of columns that bear the
names of what it adds, in_a_language() returns all columns as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tidemark.llm.common import fresh

UND = "und"
#: The bounded sample: documents drawn for a language, most characters of one (longer ones are passed over unless a
#: language has no others), characters kept of a language, and of all languages together.
SAMPLE_DOCS, SAMPLE_LONGEST, SAMPLE_CHARS, SAMPLE_TOTAL = 64, 8192, 24_000, 400_000
#: Symbols of the alphabet: 0 fills up blocks, 1 is any letter that no sample has, 2 is white space and punctuation. The OWN commonest
#: letters of the samples have a symbol each; the others, in scripts with many letters, share what is left, by code point.
ALPHABET, OWN, LANE = 128, 96, 2048


def held_out(doc_id: Column) -> Column:
    """The rows that must not be learned from; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> list[tuple[str, str]]:
    """(lang, text) of at most SAMPLE_DOCS texts a language, one from each of as many groups of rows by hash.

    The first pass reads no more than lengths and keys, and its result has SAMPLE_DOCS rows a language; the second fetches their texts.
    """
    rows = docs.filter(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
    h = F.xxhash64(F.col(doc_id), F.lit(11))
    # the hash loses a bit to rank long texts last
    rank = F.shiftrightunsigned(h, 2) + F.when(F.length(text) > SAMPLE_LONGEST, F.lit(2**62)).otherwise(F.lit(0))
    # a sample never keeps more than this of a text, so that no more comes to the driver
    part = F.left(F.col(text), F.lit(SAMPLE_CHARS))
    rows = rows.select(F.col(lang).alias("lang"), part.alias("text"), F.pmod(h, F.lit(SAMPLE_DOCS)).alias("slot"), rank.alias("rank"))
    drawn = rows.groupBy("lang", "slot").agg(F.min("rank").alias("rank")).collect()
    if not drawn:
        return []
    keys = docs.sparkSession.createDataFrame([(r["lang"], r["slot"], r["rank"]) for r in drawn], "lang string, slot long, rank long")
    found = rows.join(F.broadcast(keys), ["lang", "slot", "rank"]).groupBy("lang", "slot").agg(F.min("text").alias("text"))
    return sorted((r["lang"], r["text"]) for r in found.select("lang", "text").collect())


def _symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of white space and punctuation made one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = table[np.minimum(codes, len(table) - 1)]
    return s[(s != 2) | np.r_[True, s[:-1] != 2]] if len(s) else s


class SuffixAutomaton:
    """States and moves of the smallest automaton that accepts all substrings of what it was fed."""

    def __init__(self):
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def feed(self, symbols) -> None:
        for c in symbols:
            self._extend(int(c))

    def _extend(self, c: int) -> None:
        moves, link, length = self.moves, self.link, self.length
        new, p = len(moves), self.last
        moves.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        self.last = new

    def dense(self, size: int) -> np.ndarray:
        """Entry state * size + symbol: twice the next state's offset, odd if a phrase ended. Symbol 0 stays without a phrase. A last state,
        beside the automaton's, is where symbols lead that the text does not have: each is a phrase of its own."""
        n = len(self.moves)
        root = np.full(size, n, np.int64)
        for c, q in self.moves[0].items():
            root[c] = q
        table = np.tile(root * size * 2 + 1, (n + 1, 1))
        table[0] -= 1  # no phrase ends where none has begun
        for s, m in enumerate(self.moves):
            for c, q in m.items():
                table[s, c] = q * size * 2
        table[:, 0] = np.arange(n + 1) * size * 2
        return table.ravel()


class Model:
    def __init__(self, texts: list[tuple[str, str]]):
        self.langs = sorted({a for a, _ in texts})
        each = min(SAMPLE_CHARS, SAMPLE_TOTAL // max(1, len(self.langs)))
        kept: dict[str, list[str]] = {}
        for name in self.langs:
            left, kept[name] = each, []
            for _, t in sorted((x for x in texts if x[0] == name), key=lambda x: len(x[1])):
                if left > 0:
                    kept[name].append(t[: max(left, 0)])
                    left -= len(t)
        counts: dict[str, int] = {}
        for t in (t.lower() for ts in kept.values() for t in ts):
            for ch in t:
                if ch.isalpha() and ord(ch) < 0xFFFF:
                    counts[ch] = counts.get(ch, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.table = np.ones(0x10000, np.uint8)
        for i in range(0xFFFF):
            if not chr(i).isalpha():
                self.table[i] = 2
        for i, ch in enumerate(letters):
            self.table[ord(ch)] = 3 + (i if i < OWN else OWN + ord(ch) % (ALPHABET - 3 - OWN))
        self.size = 3 + len(letters) if len(letters) <= OWN else ALPHABET
        self.kept = {name: np.concatenate([_symbols(t, self.table) for t in ts]) for name, ts in kept.items()}
        self.moves = []
        for name in self.langs:
            a = SuffixAutomaton()
            a.feed(self.kept[name])
            self.moves.append(a.dense(self.size).astype(np.int32 if len(a.moves) * self.size < 2**30 else np.int64))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text in each language."""
        cut = [(i, s[j : j + LANE]) for i, s in enumerate(texts) for j in range(0, len(s), LANE)]
        cut.sort(key=lambda x: -len(x[1]))
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for at in range(0, len(cut), 1024):
            lanes = cut[at : at + 1024]
            n = len(lanes)
            block = np.zeros((len(lanes[0][1]), n), np.int32)
            for k, (_, s) in enumerate(lanes):
                block[: len(s), k] = s
            alive = n - np.searchsorted(np.array([len(s) for _, s in lanes])[::-1], np.arange(len(block)), side="right")
            owner = np.array([i for i, _ in lanes])
            for g, moves in enumerate(self.moves):
                state = np.zeros(n, moves.dtype)
                ends = np.zeros(n, np.int32)
                for t in range(len(block)):
                    k = alive[t]
                    x = moves.take((state[:k] >> 1) + block[t, :k])
                    ends[:k] += x & 1
                    state[:k] = x & ~1
                np.add.at(out[:, g], owner, ends + 1)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, float]]:
        """(language, score, phrases by symbols, share of letters that no sample has) of each text; the score is how much of the
        second-best language's phrases the best one spares."""
        if not self.langs:
            return [(UND, 0.0, 0.0, 0.0)] * len(texts)
        symbols = [_symbols(t, self.table) if t else np.zeros(0, np.uint8) for t in texts]
        found = self.phrases(symbols)
        best = found.argmin(1)
        out = []
        for i, t in enumerate(texts):
            if not t or not any(c.isalpha() for c in t):
                out.append((UND, 0.0, 0.0, 0.0))
                continue
            b = found[i, best[i]]
            rest = np.delete(found[i], best[i])
            out.append((self.langs[best[i]], float(1 - b / rest.min()) if len(rest) else 1.0, float(b / max(1, len(symbols[i]))), float((symbols[i] == 1).sum() / max(1, (symbols[i] != 2).sum()))))
        return out


_models: dict[str, Model] = {}


ADDED = ("lang_pred", "score", "phrase_rate", "unlearned")


def identify(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", names: tuple[str, ...] = ADDED) -> DataFrame:
    """Adds what Model.predict() says, under names, to all columns of docs (columns of those names are replaced). Learns from labelled, or from docs."""
    texts = sample(docs if labelled is None else labelled)
    shared, name = docs.sparkSession.sparkContext.broadcast(texts), uuid.uuid4().hex
    keep = [c for c in docs.columns if c.lower() not in names or c == text]
    place = keep.index(text)
    schema = StructType([docs.schema[c] for c in keep]).add(names[0], StringType())
    for n in names[1:]:
        schema = schema.add(n, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = Model(shared.value)
        model = _models[name]
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 2048):
                out += model.predict(batch.column(place).slice(at, 2048).to_pylist())
            cols = [pa.array([r[i] for r in out], pa.float64() if i else pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*keep, *names])

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


#: Phrases by symbols beyond which a text of UNLIKE_CHARS characters or more is in no language that was learned (each text begins a
#: phrase, which says little about a short one); share of letters that no sample has beyond which a text of any length is in none.
UNLIKE_RATE, UNLIKE_CHARS, UNLEARNED = 0.5, 64, 0.5


def in_a_language(docs: DataFrame, text: str = "text", **kw) -> DataFrame:
    """Rows of docs whose text is in one of the learned languages: it has letters, and does not fall apart into short phrases."""
    lang, _, rate, strange = names = fresh(docs.columns, *ADDED)
    found = identify(docs, text=text, names=names, **kw)
    unlike = (F.col(rate) > UNLIKE_RATE) & (F.length(text) >= UNLIKE_CHARS) | (F.col(strange) > UNLEARNED)
    return found.filter((F.col(lang) != UND) & ~unlike).select(*(F.col(f"`{c}`") for c in docs.columns))
