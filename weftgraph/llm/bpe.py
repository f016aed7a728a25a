"""Byte-pair encoding and decoding by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over
tokens.  Its states are the tokens last read; at first every base symbol may
follow every other.  The gadget of a merge (a, b) -> ab adds the state ab,
which leaves as b does, lets ab be read wherever a may be, and takes the arc b
from state a.  Once all gadgets are in, the one path that spells a word is its
encoding.  Listed whole the arcs would be billions, so each is asked of the
gadgets that made its two tokens, latest first, when it is first met.

Words are read byte by byte through a transition table: a state of the table is
the set of arcs being spelt (the token before, and the place in the token's
letters; tokens before that allow the same arcs from a place on are one), a
transition names the next state, and a state the token that ends there, if any.
The table is filled as transitions are met and bounded; a word costs one
look-up a byte, whatever its length.  Decoding emits the labels of the arcs taken.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from weftgraph.llm.common import arrow_limits, table, widened, worker_state

END = "</w>"
#: Words that are remembered, twice over, and their most characters.
CACHE_WORDS = 80_000
CACHE_CHARS = 200
#: States of the transition table.
STATES = 60_000
#: Arcs from a place of the trie on that are compared to find states alike.
ARCS = 48
#: Texts are read in stretches of so many characters, each up to its next blank.
STRETCH = 500_000
#: Bits of a token or of a place in the trie.
BITS = 20
LOW = (1 << BITS) - 1
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    symbol = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [symbol[b] for b in range(256)]


def compiled(spec: str) -> dict:
    """The vocabulary file's JSON text as plain arrays: labels, gadgets, and the trie of the
    tokens' bytes.  Only the driver parses the text; workers get the arrays."""
    parsed = json.loads(spec)
    vocab: dict[str, int] = parsed["model"]["vocab"]
    special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    labels = [""] * size
    for text, k in [*vocab.items(), *special.items()]:
        labels[k] = text
    gadget = np.full((3, size), -1, np.int32)  # time, left and right part of each merged token
    pair = np.zeros(len(parsed["model"]["merges"]), np.int64)
    for k, (a, b) in enumerate(tuple(m) if isinstance(m, list) else m.split(" ", 1) for m in parsed["model"]["merges"]):
        gadget[:, vocab[a + b]] = k, vocab[a], vocab[b]
        pair[k] = vocab[a] << BITS | vocab[b]
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    child: dict[int, int] = {}
    inner, last, length = [-1], [-1], np.zeros(size, np.int32)
    for text, k in vocab.items():
        ends = text.endswith(END) and len(text) > len(END)
        letters = text[: -len(END)] if ends else text
        node, length[k] = 0, len(letters)
        for c in letters:
            at = node << 8 | byte_of[c]
            if at not in child:
                child[at] = len(inner)
                inner.append(-1)
                last.append(-1)
            node = child[at]
        (last if ends else inner)[node] = k
    if max(size, len(inner)) >= LOW:
        raise ValueError(f"expected a vocabulary of fewer than {LOW} tokens and places")
    # tokens in the order of their letters: those below a place of the trie are a stretch of it
    spans = np.zeros((2, len(inner)), np.int32)
    order = sorted(vocab.values(), key=lambda k: (labels[k].removesuffix(END) or labels[k]).translate({ord(c): b for c, b in byte_of.items()}))
    for i, k in enumerate(order):
        node = 0
        text = labels[k]
        for c in text[: -len(END)] if text.endswith(END) and len(text) > len(END) else text:
            node = child[node << 8 | byte_of[c]]
            if not spans[1, node]:
                spans[0, node] = i
            spans[1, node] = i + 1
    trie = np.array([*child.keys()], np.int32), np.array([*child.values()], np.int32)
    return {"labels": "\0".join(labels), "special": special, "gadget": gadget, "pair": pair, "trie": trie, "spans": spans, "order": np.array(order, np.int32), "inner": np.array(inner, np.int32), "last": np.array(last, np.int32), "length": length}


class State(dict):
    """A row of the transition table: by byte the next row; by byte plus 256, as the word's
    last one, the token that ends the word.  ``arcs`` are those being spelt, as packed numbers:
    the state they leave, and the place in their letters; ``ended`` is the token that ends
    where the row is reached, plus 1 (0: none)."""

    __slots__ = ("of", "arcs", "ended")

    def __init__(self, of: Automaton, arcs: bytes, ended: int):
        self.of, self.arcs, self.ended = of, arcs, ended

    def __missing__(self, byte: int):
        arcs = memoryview(self.arcs).cast("q")
        value = self[byte] = self.of.last_token(arcs, byte - 256) if byte > 255 else self.of.move(arcs, byte)
        return value


class Automaton:
    """The compiled automaton with its transition table."""

    def __init__(self, made: dict):
        self.labels = made["labels"].split("\0")
        self.special: dict[str, int] = made["special"]
        self.time, self.left, self.right = (a.tolist() for a in made["gadget"])
        self.merged = dict(zip(made["pair"].tolist(), range(len(made["pair"]))))
        self.child = dict(zip(made["trie"][0].tolist(), made["trie"][1].tolist()))
        self.inner, self.last, self.length = made["inner"].tolist(), made["last"].tolist(), made["length"].tolist()
        (self.low, self.high), self.order = (a.tolist() for a in made["spans"]), made["order"].tolist()
        self.goes_on = bytearray(len(self.inner))
        for at in self.child:
            self.goes_on[at >> 8] = 1
        self.clear()

    def clear(self) -> None:
        self.alike: dict[int, int] = {}  # state plus 1 and place: the least state known to allow the same there, -1 if it allows none
        self.first: dict[tuple[int, int], int] = {}
        self.states: dict[bytes, State] = {}
        self.start = self.state_of([0], 0)  # tokens are kept plus 1; 0 is the start

    def state_of(self, arcs: list[int], ended: int) -> State:
        key = array("q", arcs).tobytes()
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, key, ended)
        return found

    def arc(self, s: int, t: int) -> bool:
        """Whether state s (plus 1; 0 is the start) has an arc labelled t."""
        if not s:
            return True
        s, limit, time = s - 1, len(self.merged), self.time
        while True:
            taken = self.merged.get(s << BITS | t)
            if taken is not None and taken < limit:
                return False
            if time[s] < 0 and time[t] < 0:
                return True
            if time[s] > time[t]:  # the state's gadget is the later one: it left as its right part did before
                limit, s = time[s], self.right[s]
            else:
                limit, t = time[t] + 1, self.left[t]

    def same(self, s: int, node: int) -> int:
        """The state (plus 1) that stands for s where only arcs from this place of the trie on matter:
        0 if all are allowed, -1 if none is; where very many arcs remain, s itself."""
        low, high = self.low[node], self.high[node]
        if not s or high - low > ARCS:
            return s
        key = s << BITS | node
        found = self.alike.get(key)
        if found is None:
            mask = 0
            for t in self.order[low:high]:
                mask = mask << 1 | self.arc(s, t)
            found = -1 if not mask else 0 if mask == (1 << high - low) - 1 else self.first.setdefault((node, mask), s)
            self.alike[key] = found
        return found

    def move(self, arcs: memoryview, byte: int) -> State:
        """The transition from a state, as it goes into the table."""
        if len(self.states) >= STATES:
            self.clear()
        on, ended = [], 0
        for x in arcs:
            node = self.child.get((x & LOW) << 8 | byte)
            if node is None:
                continue
            token = self.inner[node]
            if token >= 0 and self.arc(x >> BITS, token):  # one at most, as a prefix has one encoding
                ended = token + 1
            if self.goes_on[node] and (s := self.same(x >> BITS, node)) >= 0:
                on.append(s << BITS | node)
        if ended:
            on.append(ended << BITS)
        return self.state_of(on, ended)

    def last_token(self, arcs: memoryview, byte: int) -> int:
        """The token that ends a word with this byte."""
        for x in arcs:
            node = self.child.get((x & LOW) << 8 | byte)
            if node is not None and self.last[node] >= 0 and self.arc(x >> BITS, self.last[node]):
                return self.last[node]
        raise ValueError("the vocabulary can't spell the word")

    def spell(self, word: bytes) -> list[int]:
        """The labels of the path that spells a word of one byte at least: its token ids."""
        state, ended = self.start, []
        end = ended.append
        for byte in word[:-1]:
            state = state[byte]
            end(state.ended)
        token = state[word[-1] + 256]
        path, length = [token], self.length
        at = len(word) - length[token]
        while at > 0:
            token = ended[at - 1] - 1
            path.append(token)
            at -= length[token]
        path.reverse()
        return path

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined by a space, special tokens included."""
        return " ".join(map(self.labels.__getitem__, ids))


def lowered(text: str) -> str:
    """Each character in lower case by itself: a sigma that ends a word stays as inside."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Remembered(dict):
    """What a word gives, found once; the longest unused go first."""

    def __init__(self, find):
        self.find, self.old = find, {}

    def __missing__(self, text: str) -> tuple[str, str]:
        value = self.old.get(text)
        if value is None:
            value = self.find(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[text] = value
        return value


def joined(found: list[tuple[str, str]]) -> tuple[str, str]:
    return " ".join([f[0] for f in found if f[0]]), " ".join([f[1] for f in found if f[0]])


def stretches(text: str) -> Iterator[str]:
    """The text in parts that end before a space or a line end, which no word crosses."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            end = min([k for k in (text.find(" ", end), text.find("\n", end)) if k >= 0], default=len(text))
        yield text[at:end]
        at = end


class Encoder:
    """Encodes whole texts; remembers a bounded number of words."""

    def __init__(self, made: dict | str):
        """From what ``compiled`` gives, or the vocabulary file's text."""
        self.automaton = Automaton(compiled(made) if isinstance(made, str) else made)
        special = sorted(self.automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = Remembered(self.spelt)

    def spelt(self, word: str) -> tuple[str, str]:
        """(ids joined by spaces, decoded text) of a word."""
        ids = self.automaton.spell(word.encode("utf-8", "replace"))
        return " ".join(map(str, ids)), self.automaton.decode(ids)

    def parts(self, text: str) -> Iterator[tuple[str, str]]:
        """The same of parts of a text: special tokens as they stand in it, and what is between."""
        pieces = [text] if self.special is None or "<|" not in text else self.special.split(text)
        for piece in pieces:
            if piece in self.automaton.special:
                k = self.automaton.special[piece]
                yield str(k), self.automaton.decode([k])
            else:
                for part in stretches(piece):
                    words = PATTERN.findall(lowered(unicodedata.normalize("NFC", part)))
                    yield joined(list(map(self.words.__getitem__, words)))

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """(tokens, ids joined by spaces, decoded text) of each whole text."""
        for text in texts:
            ids, decoded = joined(list(self.parts(text or "")))
            yield (ids.count(" ") + 1 if ids else 0), ids, decoded


#: What ``encode`` can add, and its types.
OUTPUTS = {"n_tokens": "long", "ids": ArrayType(IntegerType()), "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def result(name: str, n: int, ids: str, decoded: str):
    if name == "n_tokens":
        return n
    if name == "ids":
        return np.array(ids.split(), np.int32)
    if name == "decoded":
        return decoded
    return hashlib.sha256((ids if name == "ids_sha256" else decoded).encode()).hexdigest()


def encode(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The rows of docs with the outputs added (columns of these names are replaced): the
    count of tokens, their ids, the decoded text, or SHA-256 digests of the ids' decimal
    text and of the decoded text.

    Null and empty texts have no tokens and decode to ''; repeated rows repeat; an empty
    table gives an empty result.  ``vocabulary`` is the path of the tokenizer's JSON file,
    which only the driver reads.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    with open(vocabulary, encoding="utf-8") as f:
        made = spark.sparkContext.broadcast(compiled(f.read()))
    name = f"bpe-{uuid.uuid4().hex}"
    names = [c for c in docs.columns if c not in outputs]
    docs = docs.select(*names)
    schema = widened(docs, **{c: OUTPUTS[c] for c in outputs})
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(name, lambda: Encoder(made.value))
        for batch in batches:
            texts = batch.column(names.index("text"))
            rows = [[result(c, *found) for c in outputs] for found in encoder.encode(t.as_py() for t in texts)]
            added = [pa.array([r[j] for r in rows], kinds.get(c, pa.string())) for j, c in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, *outputs])

    return docs.mapInArrow(run, schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's count of tokens and digests; see ``encode`` for nulls and repeats."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")
