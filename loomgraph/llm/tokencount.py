"""Token counts by a compiled counting transducer.

A byte-pair tokenizer file is compiled, state by state as texts need them, into deterministic transducers:

* ``Splitter`` is a small automaton over character classes that cuts a white-space free piece into words as the file's
  pre-tokenizer does (contractions, letter runs, single digits, other runs).
* ``Counter`` reads a word symbol by symbol. Each transition carries the change of the number of tokens emitted for the
  prefix read so far; the last symbol of a word is read from the word-end half of the alphabet. A state holds, for every
  start inside the longest suffix that begins some token, the trie node reached, the last token before it and the count
  there relative to now, which is all that any future count depends on; so there are finitely many states.

White space resets the machine from every state. A text is cut into chunks, and the state map of a chunk is ``(head, count, state)``:
the part before its first reset, by reference, which is all that depends on the start state; the tokens between its resets; and the
machine's state at its end, which no longer does. Maps compose associatively: where the left one ends in a state, the right one's
head is run from there, so a composed map is no larger than a chunk's. They are composed in a tree, as in the upward half of a
prefix scan, since only the whole text's map is asked for. A text without any white space is one head, which is run chunk by
chunk at the end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Characters of a chunk, and pieces remembered by a worker (a cache of finished paths; it is emptied when full).
CHUNK_CHARS = 16_384
CACHE_PIECES = 400_000
#: States kept compiled, and the longest piece that is remembered.
CACHE_STATES = 150_000
LONG_PIECE = 200
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: a byte's own, or the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


#: What the counter's state holds at the start of a word: nothing read, no token before.
START = ((0, "", 0),)


class Counter(dict):
    """Word -> number of tokens. Looking up an unknown word runs the transducer, which compiles the transitions it lacks."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        super().__init__()
        self.end = end
        self.base = byte_symbols()
        #: rank of a token: base symbols first, then merges in order; parts: what a merged token was merged from.
        self.rank: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.merge_rank: dict[tuple[str, str], int] = {}
        for s in self.base:
            self.rank[s] = self.rank[s + end] = -1
        for i, (x, y) in enumerate(merges):
            self.merge_rank[x, y] = i
            self.parts.setdefault(x + y, (x, y))
            self.rank.setdefault(x + y, i)
        # trie over symbols; a symbol with the word end is a key of its own
        self.children: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for t in self.rank:
            n = 0
            body, last = (t[: -len(end)], True) if end and t.endswith(end) and t != end else (t, False)
            for k, c in enumerate(body):
                s = c + end if last and k == len(body) - 1 else c
                m = self.children[n].get(s)
                if m is None:
                    m = len(self.children)
                    self.children[n][s] = m
                    self.children.append({})
                    self.token.append(None)
                n = m
            self.token[n] = t
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, int] = {}
        self.entries: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []

    def _state(self, entries: tuple) -> int:
        n = self.states.get(entries)
        if n is None:
            n = self.states[entries] = len(self.entries)
            self.entries.append(entries)
            self.next.append({})
        return n

    def stays(self, left: str, right: str) -> bool:
        """Whether the boundary between two adjacent tokens survives all merges.

        Merges happen in rank order, so of the pieces that meet at the boundary the later-merged one was still apart when the
        earlier merges ran: walk both sides back in time and see whether any pair that met there merges before its parts grew.
        """
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            never = len(self.merge_rank) + 1
            x, y, until = left, right, never
            found = True
            while True:
                m = self.merge_rank.get((x, y))
                if m is not None and m < until:
                    found = False
                    break
                rx, ry = self.rank[x], self.rank[y]
                if rx < 0 and ry < 0:
                    break
                # Undo the later merge of the two; what stood there before could merge across until then. Equal ranks merge from the
                # left: a pair across of the same rank is too late for the left token, but comes before the right token.
                if rx > ry:
                    until, x = rx, self.parts[x][1]
                else:
                    until, y = ry + 1, self.parts[y][0]
            self.pairs[key] = found
        return found

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition: next state, and by how much the number of tokens of the prefix changes."""
        got = []
        last = delta = None
        for node, before, rel in self.entries[state]:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            t = self.token[child]
            if t is not None and last is None and (not before or self.stays(before, t)):
                last, delta = t, rel + 1
            got.append((child, before, rel))
        if last is None:
            raise ValueError(f"no token ends with {symbol!r}")
        entries = tuple((c, b, rel - delta) for c, b, rel in got if self.children[c]) + ((0, last, 0),)
        out = self.next[state][symbol] = (self._state(entries), delta)
        return out

    def run(self, entries: tuple, symbols: list[str]) -> tuple[tuple, int]:
        """Reads symbols from a state, given by what it holds; returns the state reached and the change of the number of tokens."""
        if len(self.states) > CACHE_STATES:  # compiled states can be compiled again
            self.states.clear(), self.entries.clear(), self.next.clear(), self.pairs.clear()
        state, n = self._state(entries), 0
        for s in symbols:
            t = self.next[state].get(s) or self.step(state, s)
            state = t[0]
            n += t[1]
        return self.entries[state], n

    def symbols(self, text: str, last: bool) -> list[str]:
        """Symbols of a part of a word, the last of them at the word's end."""
        out = [self.base[b] for b in text.encode()]
        if last:
            out[-1] += self.end
        return out

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_PIECES:
            self.clear()
        n = self.run(START, self.symbols(word, True))[1]
        if len(word) < LONG_PIECE:
            self[word] = n
        return n


class Pieces(dict):
    """White-space free piece -> number of tokens: the splitter cuts it to words, the counter counts them."""

    #: What follows an apostrophe at the start of a word and ends it: fixed values of the file's pattern, tried in this order.
    TAILS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, tokenizer, counter: Counter):
        super().__init__()
        self.tokenizer, self.words, self.classes = tokenizer, counter, {}

    def kind(self, c: str) -> str:
        """Class of a character: L, N or P (all else); asked of the library's pre-tokenizer once per character."""
        k = self.classes.get(c)
        if k is None:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            k = self.classes[c] = "L" if len(cut("a" + c)) == 1 else "P" if len(cut("!" + c)) == 1 else "N"
        return k

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE_PIECES:
            self.clear()
        n, i, kind, words = 0, 0, self.kind, self.words
        while i < len(piece):
            if piece[i] == "'" and (tail := next((t for t in self.TAILS if piece.startswith(t, i + 1)), None)):
                j = i + 1 + len(tail)
            elif (k := kind(piece[i])) == "N":
                j = i + 1
            else:
                j = i + 1
                while j < len(piece) and kind(piece[j]) == k:
                    j += 1
            n += words[piece[i:j]]
            i = j
        if len(piece) < LONG_PIECE:
            self[piece] = n
        return n

    def stream(self, state: tuple, text: str, last: bool = False) -> tuple[tuple, int]:
        """Reads a part of a piece from a state ``(kind of the open word, counter's state, characters not yet read)``; ``last`` ends the piece.

        A character of an open word waits for the next one, as it may be the word's last; an apostrophe at a word's start waits for two.
        """
        kind, at, wait = state
        text, n, i = wait + text, 0, 0
        while i < len(text):
            if kind is None:
                if text[i] == "'":
                    if len(text) - i < 3 and not last:
                        break
                    if tail := next((t for t in self.TAILS if text.startswith(t, i + 1)), None):
                        n += self.words[text[i : i + 1 + len(tail)]]
                        i += 1 + len(tail)
                        continue
                if (k := self.kind(text[i])) == "N":
                    n += self.words[text[i]]
                    i += 1
                    continue
                kind, at = k, START
            j = i
            while j < len(text) and self.kind(text[j]) == kind:
                j += 1
            if j < len(text) or last:
                n += self.words.run(at, self.words.symbols(text[i:j], True))[1]
                kind, at, i = None, START, j
            else:
                if j - i > 1:
                    at, more = self.words.run(at, self.words.symbols(text[i : j - 1], False))
                    n += more
                i = j - 1
                break
        return (kind, at, text[i:]), n


class Maps:
    """State maps of chunks and their composition."""

    #: Texts with other characters are normalised by the library; up to U+024F lower-casing is all that is left to do.
    UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\u012f\u0131-\u024f]")
    #: What the transducers are compiled for, as files give it: fixed values. Other files are refused, not miscounted.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    #: The state between pieces.
    RESET = (None, START, "")

    def __init__(self, file: str, chunk: int = CHUNK_CHARS):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        plain = all(not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
        if spec["normalizer"] != self.NORMALIZER or spec["pre_tokenizer"] != self.PRE_TOKENIZER or any(model.get(k) != v for k, v in self.MODEL.items()) or model.get("continuing_subword_prefix") or not plain:
            raise ValueError(f"{file} has another normaliser, pre-tokenizer or model than the transducers are compiled for")
        self.tokenizer = Tokenizer.from_file(file)
        self.pieces = Pieces(self.tokenizer, Counter(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or ""))
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.chunk = chunk

    def normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.UNUSUAL.search(text) else text.lower()

    def of(self, chunk: str, plain: bool) -> tuple:
        """(head, count, state), or ((chunk,), None, None) without a reset. plain: the library has left spaces as the only resets."""
        parts = chunk.split(" ") if plain else chunk.split()
        parts = [x for x in parts if x] if plain else parts
        if len(parts) == 1 and len(parts[0]) == len(chunk):
            return ((chunk,), None, None)
        space = str.isspace if not plain else " ".__eq__
        head = () if not parts or space(chunk[0]) else (parts[0],)
        tail = "" if not parts or space(chunk[-1]) else parts[-1]
        inner = parts[bool(head) : len(parts) - bool(tail)]
        state, n = self.pieces.stream(self.RESET, tail) if tail else (self.RESET, 0)
        return (head, sum(map(self.pieces.__getitem__, inner)) + n, state)

    def follow(self, state: tuple, head: tuple, last: bool) -> tuple[tuple, int]:
        """Runs the parts of a head from a state."""
        n = 0
        for k, x in enumerate(head or ("",)):
            state, more = self.pieces.stream(state, x, last and k >= len(head) - 1)
            n += more
        return state, n

    def compose(self, x: tuple, y: tuple) -> tuple:
        """The map of two chunks in a row; associative."""
        if x[1] is None:
            return (x[0] + y[0], y[1], y[2])
        state, n = self.follow(x[2], y[0], y[1] is not None)
        return (x[0], x[1] + n, state) if y[1] is None else (x[0], x[1] + n + y[1], y[2])

    def reduced(self, maps: list[tuple]) -> tuple:
        """The map of all chunks, composed in a tree: neighbours first, all of a round independent of each other."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, m: tuple) -> int:
        """Tokens from the start state to the end of the text."""
        n = self.follow(self.RESET, m[0], True)[1] if m[0] else 0
        return n if m[1] is None else n + m[1] + self.follow(m[2], (), True)[1]

    def count(self, text: str) -> int:
        n = at = 0
        for found in [*self.special.finditer(text), None]:
            part = text[at : found.start()] if found else text[at:]
            n += found is not None
            at = found.end() if found else at
            if not part:
                continue
            plain = bool(self.UNUSUAL.search(part))
            part = self.normal(part)
            if part:
                n += self.total(self.reduced([self.of(part[i : i + self.chunk], plain) for i in range(0, len(part), self.chunk)]))
        return n


@lru_cache(maxsize=2)
def machine(file: str) -> Maps:
    """Compiled once per worker process and then extended by what its texts need."""
    return Maps(file)


def token_counts(docs: DataFrame, tokenizer_file: str, *, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: ``(doc_id, n_bytes, n_tokens, over_limit)``.

    ``tokenizer_file`` must exist on every executor. Counts equal those of the library for the file, without added begin or
    end tokens; special strings inside a text count as the one token that they are. Null and empty texts have 0 bytes and 0
    tokens. Repeated rows stay, ids may be null, other columns are ignored. One narrow pass, no shuffle; memory is bounded by
    the caches and a few times the longest text, time is linear in the text. Files of another kind raise ValueError.
    """
    common.ship(docs.sparkSession)
    machine(tokenizer_file)  # refuses a file of another kind before any task runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer_file)
        for whole in batches:
            for b in common.slices(whole):
                sizes = pc.coalesce(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                n = [m.count(t) if (t := x.as_py()) else 0 for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return common.with_columns_kept(docs, key, text).mapInArrow(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
