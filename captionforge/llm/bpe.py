"""Byte-level BPE by a traversal of the trie of distinct words.

For any string the last token of its encoding is fixed by the last token of a shorter prefix: exactly one token t that ends the
string may stand after the last token of what is before t. The distinct words are laid out as a trie, held as their sorted list
(neighbours share the path of their common prefix), and a depth-first walk carries the last token of every prefix on the path.
So the state of a prefix that many words share is computed once, and a word's tokens are read off backwards from its last state.
The tokens that end at a place come from an automaton of the vocabulary (Aho and Corasick): a byte is one move of it, however long
the word is.

The words of a batch that are new are split together and go through the trie. A bounded store keeps what was encoded, in two halves:
when the younger is full it becomes the older, and what isn't met again until the next time goes. Tokenizer files are read on the
driver and sent to the workers (their size is that of the vocabulary, not of the input).
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: What ends or starts a pre-token, as the byte-level pre-tokenizer has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words that a worker keeps at most (and those of a batch), and rows it turns over at once.
STORE, ROWS = 300_000, 500


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class TrieBPE:
    def __init__(self, config: str):
        d = json.loads(config)
        to_byte = byte_chars()
        raw = lambda s: bytes(map(to_byte.__getitem__, s))
        vocab, merges = d["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.ids = {raw(s): i for s, i in vocab.items() if s not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        #: merge rank of a pair, and the pair that makes each token, by its id
        self.rank = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(merges)}
        self.parts, self.made = {}, {}
        for n, (a, b) in enumerate(merges):
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b]))
            self.made.setdefault(vocab[a + b], n)
        #: The automaton's states are the beginnings of tokens; moves by state and byte and the tokens that end in a state are made when needed.
        self.begins = list(dict.fromkeys(b[:n] for b in [b"", *self.ids] for n in range(len(b) + 1)))
        self.states = {b: n for n, b in enumerate(self.begins)}
        self.moves: dict[int, int] = {}
        self.ends: list[list[tuple[int, int]] | None] = [None] * len(self.begins)
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.size = {i: len(b) for b, i in self.ids.items()}
        #: what meets() found, by a << bits | b
        self.bits = max(self.bytes).bit_length()
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.store: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}
        self.old_store: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes | None] = {}

    def meets(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when they stand side by side: no merge across their border comes before the merges that made them."""
        if (known := self.pairs.get(a << self.bits | b)) is not None:
            return known
        x, y, limit = a, b, len(self.rank)
        ok = None
        while ok is None:
            if self.rank.get((x, y), limit) < limit:
                ok = False
            # the later made of the two is taken apart: what was there before it was made
            elif (mx := self.made.get(x, -1)) < 0 and (my := self.made.get(y, -1)) < 0:
                ok = True
            elif mx > (my := self.made.get(y, -1)):
                limit, x = mx, self.parts[x][1]
            else:
                # an equal rank on the left of y's own merge is merged first, from left to right
                limit, y = my + 1, self.parts[y][0]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[a << self.bits | b] = ok
        return ok

    def stands(self, t: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        if (known := self.whole.get(t)) is None:
            known = self.whole[t] = t not in self.parts or (self.stands(self.parts[t][0]) and self.stands(self.parts[t][1]) and self._joins(t))
        return known

    def _joins(self, t: int) -> bool:
        parts = [self.ids[bytes([c])] for c in self.bytes[t]]
        while len(parts) > 1:
            n, k = min(((self.rank.get(p, len(self.rank)), k) for k, p in enumerate(zip(parts, parts[1:], strict=False))), default=(0, 0))
            if n == len(self.rank):
                return False
            merged = self.ids[self.bytes[parts[k]] + self.bytes[parts[k + 1]]]
            parts[k : k + 2] = [merged]
        return parts == [t]

    def move(self, key: int) -> int:
        """The state after a state and a byte (state * 256 + byte): the longest beginning of a token that ends what was read."""
        part = self.begins[key >> 8] + bytes([key & 255])
        while part not in self.states:
            part = part[1:]
        if len(self.moves) > 2_000_000:
            self.moves.clear()
        state = self.moves[key] = self.states[part]
        if self.ends[state] is None:
            self.ends[state] = [(len(part) - n, self.ids[part[n:]]) for n in range(len(part)) if part[n:] in self.ids]
        return state

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, its ids as little-endian 32-bit integers) for distinct words, depth first through their trie."""
        moves, ends, pairs, meets, stands, bits, size = self.moves, self.ends, self.pairs, self.meets, self.stands, self.bits, self.size
        before, state, last = b"", [0], [0]
        for word in sorted(words):
            n, k = min(len(word), len(before)), 0
            while k < n and word[k] == before[k]:
                k += 1
            del state[k + 1 :], last[k + 1 :]
            at, end = state[k], k
            for c in word[k:]:
                end += 1
                key = at << 8 | c
                if (at := moves.get(key)) is None:
                    at = self.move(key)
                for n, t in ends[at]:
                    if n == end:
                        ok = stands(t)
                    elif (ok := pairs.get(last[end - n] << bits | t)) is None:
                        ok = meets(last[end - n], t)
                    if ok:
                        state.append(at)
                        last.append(t)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            out = []
            while end:
                out.append(t := last[end])
                end -= size[t]
            out.reverse()
            yield word, array("I", out).tobytes()
            before = word

    def _add(self, pretokens: set[str]) -> None:
        new = {}
        for p in pretokens:
            if p not in self.store:
                if (ids := self.old_store.get(p)) is not None:
                    self.store[p] = ids
                else:
                    new[p.encode()] = p
        for b, ids in self.walk(list(new)):
            self.store[new[b]] = ids

    def learn(self, texts: list[str]) -> None:
        """Encodes what the texts have that isn't stored yet."""
        if len(self.pieces) > STORE // 2:
            self.pieces, self.old_pieces = {}, self.pieces
        if len(self.store) > STORE // 2:
            self.store, self.old_store = {}, self.store
        firsts, new = set(), set()
        for text in texts:
            p = text.split(" ")
            firsts.add(p[0])
            new.update(p)
        new.difference_update(self.pieces)
        again = {x: self.old_pieces[x] for x in new if x in self.old_pieces}
        self.pieces.update(again)
        new.difference_update(again)
        # a piece with white space at an end may share a run of it with its neighbour: such texts are split as a whole
        odd = {x for x in new if not x or x[0].isspace() or x[-1].isspace()}
        self.pieces.update(dict.fromkeys(odd))
        # the others are split together: a space between two of them begins a pre-token, and none goes on over it
        new = list(new - odd)
        found = self.find(" " + " ".join(new)) if new else []
        heads = {x: self.find(x) for x in firsts if x and not x[-1].isspace()}
        self._add({*found, *(p for ps in heads.values() for p in ps)})
        coded = list(map(self.store.__getitem__, found))
        starts = [k for k, p in enumerate(found) if p[0] == " "] + [len(found)]
        for x, (k, end) in zip(new, pairwise(starts), strict=True):
            self.pieces[x] = coded[k] if end - k == 1 else b"".join(coded[k:end])
        self.heads = {x: b"".join(map(self.store.__getitem__, heads[x])) if x in heads else None for x in firsts}

    def encode_learned(self, text: str) -> bytes:
        """The ids of a text that learn() has seen."""
        if not text:
            return b""
        if self.split and any(s in text for s in self.special):
            out = []
            for part in self.split(text):
                out.append(array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part))
            return b"".join(out)
        p = text.split(" ")
        head = self.heads[p[0]]
        if head is not None:
            try:
                return head + b"".join(map(self.pieces.__getitem__, p[1:]))
            except TypeError:
                pass
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        found = self.find(text)
        self._add(set(found))
        return b"".join(map(self.store.__getitem__, found))

    def encode(self, text: str) -> list[int]:
        self.learn([text])
        return array("I", self.encode_learned(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, TrieBPE] = {}


def _coder(key: str, config: str) -> TrieBPE:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TrieBPE(config)
    return _LOADED[key]


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, decode: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (array<long>), and with decode the text decoded from them; with digests their SHA-256 instead of both.

    A null text counts as empty: no ids, an empty decoded text. Rows are encoded one by one: ties, repeated rows and null ids
    need no rule, and an empty table gives none. Strings of special tokens in a text become those tokens, as in the library.
    Other columns are ignored.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        config = f.read()
    key = hashlib.sha256(config.encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(config)
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = [named.schema["doc_id"], T.StructField("n_tokens", T.LongType())]
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        fields += [T.StructField("ids", T.ArrayType(T.LongType()))] + [T.StructField("decoded", T.StringType())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, sent.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(1).to_pylist()
                coder.learn(texts)
                coded = [coder.encode_learned(t) for t in texts]
                columns = [batch.column(0), pa.array([len(c) // 4 for c in coded], pa.int64())]
                lists = (array("I", c) for c in coded)
                if digests:
                    columns += [pa.array(map(sha, coded), pa.string()), pa.array((sha(coder.decode(x.tolist()).encode()) for x in lists), pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    ids = [x.tolist() for x in lists]
                    columns += [pa.array(ids, pa.list_(pa.int64()))] + [pa.array(map(coder.decode, ids), pa.string())] * decode
                    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decode
                yield pa.RecordBatch.from_arrays(columns, names)

    return named.mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_encode(docs, tokenizer=tokenizer, digests=True)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
