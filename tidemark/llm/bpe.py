"""Byte-level BPE encoding and decoding, as a monoid: a text is a sequence of tokens, and two neighbours join.

A text is halved until a part is short, parts are split by the pattern and their pieces merged by the tokenizer's library,
and neighbours are joined by encoding a window around their boundary again. The pattern is scanned from left to right, which
says how far the window must go:

* Left of the boundary a piece stands as it is if its match cannot have looked as far as the part's end, for then what follows
  cannot change it. How far a match looks at most follows from the pattern: each of its items goes at most to the end of a run
  of characters that it repeats, and one further. The window begins at the first piece that may have looked at the end.
* Right of the boundary the window grows, doubling, until a piece of it begins where one of the right part begins, both
  found without a look at the window's end. From there on both scans see the same text, so all later pieces are the same.

Outside the window no token can change; in it pieces are encoded one by one. This holds for every pattern that does not look
behind itself; others are refused. Should tokens and pieces not fit together, both parts are encoded as one by the library, as
is a text of which the pattern leaves characters out.
Decoding concatenates bytes up the same kind of tree.

Null and empty texts have no tokens. Tokens are those of the ranks file alone: no special tokens. Repeated rows come out
each, an empty table gives an empty one. Only the key and the text are read; of the columns of a table only the key comes
back, so that others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Characters of a part that is encoded at once; tokens of a part that is decoded at once; the first width of the window.
LEAF, TOKENS, WINDOW = 1024, 1024, 32
#: Pieces of more than one token that a codec keeps the tokens of.
RARE = 1 << 16
#: The ranks are sent to executors with the task's code; a larger file is refused.
RANKS_BYTES = 32 * 1024 * 1024
#: Parts of a pattern that look at what stands before a match.
_BEHIND = {"^", r"\A", r"\b", r"\B", r"\G", r"\K", "(?<=", "(?<!"}
_PARTS = re.compile(r"\(\?<?[=!]|\(\?[a-z>-]*:?|\(|\[\^?\]?(?:\\.|[^\]\\])*\]|\\[pP]\{[^}]*\}|\\.|(?:[+*?]|\{[0-9]+(?:,[0-9]*)?\})[+?]?|.", re.DOTALL)
_REPEAT = re.compile(r"(?:[+*?]|\{([0-9]+)(,?)([0-9]*)\})[+?]?")


class Sight:
    """How far matches of a pattern look: items of its longest way, and what items repeat without bound."""

    def __init__(self, pattern: str):
        self.parts, self.at, runs = _PARTS.findall(pattern), 0, set()
        if behind := _BEHIND.intersection(self.parts):
            raise ValueError(f"the pattern looks behind itself: {sorted(behind)}")
        self.steps = self._ways(runs, "(?:")
        self.run = regex.compile("(?p)" + "|".join(f"(?:{r})*" for r in sorted(runs)))

    def _peek(self) -> str:
        return self.parts[self.at] if self.at < len(self.parts) else ""

    def _ways(self, runs: set[str], mode: str) -> int:
        most = self._items(runs, mode)
        while self._peek() == "|":
            self.at += 1
            most = max(most, self._items(runs, mode))
        return most

    def _items(self, runs: set[str], mode: str) -> int:
        steps = 0
        while self._peek() not in ("", "|", ")"):
            item = self._peek()
            self.at += 1
            n = 1
            if group := item.startswith("("):
                n = self._ways(runs, item if item.startswith("(?") and item.endswith(":") else mode)
                self.at += 1
            if m := _REPEAT.fullmatch(self._peek()):
                self.at += 1
                if m[0][0] in "+*" or m[2] and not m[3]:
                    runs.add(r"[\s\S]" if group else f"{mode}{item})")
                n *= int(m[3] or m[1] or 1)
            steps += n
        return steps

    def reaches(self, text: str, at: int, stop: int) -> bool:
        """Whether a match that begins at a place may look at what is at stop."""
        for _ in range(self.steps):
            at = self.run.match(text, at, stop).end()
            if at >= stop:
                return True
            at += 1
        return False


class _LeftOut(Exception):
    """The pattern does not cover a part."""


def _is_text(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


class Codec:
    """The tokenizer of a ranks file, with tree-shaped encoding and decoding. joins counts joins since the codec was made."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        self.sight = Sight(pattern)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.scan = regex.compile(pattern)
        self.leaf, self.window, self.joins = max(1, leaf), max(1, window), 0
        self.known, self.rare = {b.decode(): i for b, i in table.items() if _is_text(b)}, {}
        self.size: dict[int, int] = {i: len(b) for b, i in table.items()}
        self.name = {i: str(i) for i in self.size}

    def encode(self, text: str) -> list[int]:
        try:
            return self._encode(text, 0, len(text))[0]
        except _LeftOut:
            return self.enc.encode_ordinary(text)

    def _encode(self, text: str, lo: int, hi: int) -> tuple[list[int], int]:
        """Tokens of a part, and where its first piece that may still change begins."""
        if hi - lo <= self.leaf:
            pieces, starts = self._split(text, lo, hi)
            return self._tokens(pieces), self._sure(text, lo, hi, starts)
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, *self._encode(text, lo, mid), *self._encode(text, mid, hi))

    def _split(self, text: str, lo: int, hi: int) -> tuple[list[str], list[int]]:
        """Pieces of a scan of a part, and where they begin."""
        pieces = [m.group() for m in self.scan.finditer(text, lo, hi)] if self.scan.groups else self.scan.findall(text, lo, hi)
        starts = [*accumulate(map(len, pieces), initial=lo)]
        if starts.pop() != hi:
            raise _LeftOut
        return pieces, starts

    def _tokens(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.known.get(p)
            if i is not None:
                out.append(i)
            elif p in self.rare:
                out += self.rare[p]
            else:
                ids = self.enc._encode_single_piece(p.encode())
                out += ids
                if len(p) <= 32 and len(self.rare) < RARE:
                    self.rare[p] = ids
        return out

    def _sure(self, text: str, lo: int, hi: int, starts: list[int]) -> int:
        """Where the first piece of a part begins that may have looked at its end; the end, if that is the text's."""
        if hi == len(text):
            return hi
        at = len(starts) - 1
        # a later match looks at least as far as an earlier one
        while at > 0 and self.sight.reaches(text, starts[at - 1], hi):
            at -= 1
        return starts[at] if starts else lo

    def _pieces(self, text: str, lo: int, hi: int) -> list[int]:
        """Where pieces of a scan of a part begin, up to the first that may have looked at its end."""
        at = self._split(text, lo, hi)[1]
        last = self._sure(text, lo, hi, at)
        return [*at, hi] if last == hi else [*(x for x in at if x < last), last]

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], unsure: int, right: list[int], later: int) -> tuple[list[int], int]:
        self.joins += 1
        width = self.window
        while True:
            stop = min(hi, mid + width)
            mine = self._pieces(text, unsure, stop)
            if met := set(mine).intersection(self._pieces(text, mid, stop)):
                to = min(met)
                break
            if stop == hi:
                to = hi
                break
            width *= 2
        back, ahead = self._back(left, len(text[unsure:mid].encode())), self._ahead(right, len(text[mid:to].encode()))
        if back is None or ahead is None or not met:
            # no place where both agree for sure before the end of the part
            return self.enc.encode_ordinary(text[lo:hi]), self._pieces(text, lo, hi)[-1]
        cuts = [x for x in mine if x <= to]
        middle = self._tokens([text[a:b] for a, b in pairwise(cuts)])
        return left[:back] + middle + right[ahead:], max(to, later)

    def _back(self, ids: list[int], n: int) -> int | None:
        i = len(ids)
        while n > 0 and i:
            i -= 1
            n -= self.size[ids[i]]
        return None if n else i

    def _ahead(self, ids: list[int], n: int) -> int | None:
        i = 0
        while n > 0 and i < len(ids):
            n -= self.size[ids[i]]
            i += 1
        return None if n else i

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= TOKENS:
            return self.enc.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.name.__getitem__, ids)).encode()).hexdigest()


@cache
def _codec(ranks: bytes, pattern: str, leaf: int) -> Codec:
    return Codec(ranks, pattern, leaf)


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        ranks = f.read(RANKS_BYTES + 1)
    if len(ranks) > RANKS_BYTES:
        raise ValueError(f"{path} has more than {RANKS_BYTES} bytes")
    return ranks


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, leaf: int, schema: str, row, columns: list[str]) -> DataFrame:
    """Runs over Arrow batches in place: no shuffle. The driver reads the ranks file, and its bytes, of bounded size, go by
    broadcast. row makes a tuple of values from each value; keys are passed on as they are."""
    key = f"`{columns[0]}` {docs.schema[columns[0]].dataType.simpleString()}"
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    fields = _parse_datatype_string(schema)
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern, leaf)
        for batch in batches:
            out = [row(codec, v.as_py()) for v in batch.column(1)]
            cols = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[columns[0], *target.names])

    return docs.select(*columns).mapInArrow(run, f"{key}, {schema}")


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """key and ids, the token ids of the whole text."""
    return _mapped(docs, ranks_path, pattern, leaf, "ids array<int>", lambda c, t: (c.encode(t or ""),), [key, text])


def decode(tokens: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """key and bytes, from key and ids."""
    return _mapped(tokens, ranks_path, pattern, leaf, "bytes binary", lambda c, ids: (c.decode(ids or []),), [key, "ids"])


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """key, n_tokens, and digests of the ids and of the bytes they decode to, in one pass that keeps no ids."""

    def row(codec: Codec, t: str | None) -> tuple:
        ids = codec.encode(t or "")
        return len(ids), codec.digest(ids), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _mapped(docs, ranks_path, pattern, leaf, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, [key, text])
