"""BPE encoding of words by traversal of a prefix trie.

The distinct words of a batch form a trie (walked depth first in sorted
order).  Each node keeps one state: the last token of the encoding of its
prefix.  A token t that ends at a node is that last token exactly if it is
compatible with the state `len(t)` levels up, that is, if byte-pair merging
of the two alone leaves them apart.  So each shared prefix is encoded once and
a word's ids are read off by walking the states back.  The end-of-word mark
belongs to the last symbol, which is therefore resolved in a leaf of its own.

Defined results: a null text encodes as the empty text (no ids, digest of the
empty string); special tokens written in a text become their own ids, as the
library does by default; a very long text or word is encoded whole; repeated
rows give equal rows; a null id is kept, and ids keep their type; other
columns, whatever their names, are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import lean

MARK = "</w>"
#: Before a special token among words; no text holds a lone surrogate after normalising to words.
SPECIAL = "\udfff"
KEPT_WORDS = 500_000
SLICE = 3_000_000
_LOADED: dict[str, WordBPE] = {}


def byte_alphabet() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        letters = byte_alphabet()
        self.table = {b: c for b, c in enumerate(letters)}
        ends = {c + MARK for c in letters}
        self.mid, self.end = set(letters), set(ends)
        for a, b in self.rank:
            (self.end if b in self.end and a in self.mid else self.mid).add(a + b)
        self.longest = max(map(len, self.mid))
        self.longest_end = max(map(len, self.end)) - len(MARK)
        self.apart: dict[tuple[str | None, str], bool] = {}
        self.split = regex.compile("|".join(map(regex.escape, self.special)))
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.known: dict[str, tuple[str, str, int]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging, lowest rank first, leftmost first."""
        while len(symbols) > 1:
            best = min((self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])))
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and self.rank.get((symbols[i], symbols[i + 1])) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, token: str) -> list[str]:
        return [*token[: -len(MARK) - 1], token[-len(MARK) - 1 :]] if token in self.end else [*token]

    def fits(self, before: str | None, token: str) -> bool:
        """Whether merging leaves (before, token) as they are; before None: the token alone."""
        key = before, token
        if (ok := self.apart.get(key)) is None:
            if before is None:
                ok = self.merge(self.symbols(token)) == [token]
            else:
                ok = self.merge(self.symbols(before) + self.symbols(token)) == [before, token]
            self.apart[key] = ok
        return ok

    def tokens(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Depth-first over the trie of the words (in letters of the byte alphabet)."""
        state: list[str | None] = [None]
        longest = self.longest
        previous, mid, end, fits, known = "", self.mid, self.end, self.fits, self.apart
        for word in sorted(words):
            depth, most = 0, min(len(state) - 1, len(word) - 1)
            while depth < most and word[depth] == previous[depth]:
                depth += 1
            del state[depth + 1 :]
            for i in range(depth + 1, len(word)):
                for n in range(1, min(i, longest) + 1):
                    t = word[i - n : i]
                    if t in mid:
                        ok = known.get((state[i - n], t))
                        if ok or ok is None and fits(state[i - n], t):
                            state.append(t)
                            break
            n = len(word)
            for k in range(1, min(n, self.longest_end) + 1):
                t = word[n - k :] + MARK
                if t in end and fits(state[n - k], t):
                    break
            out, at = [t], n - k
            while at:
                out.append(state[at])
                at -= len(state[at])
            yield word, out[::-1]
            previous = word

    def segments(self, text: str) -> list[str]:
        """Words, and special tokens as such, in order."""
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.word.findall(self.normal(text[at : m.start()]))
            out.append(SPECIAL + m.group())
            at = m.end()
        return out + self.word.findall(self.normal(text[at:]))

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # One character at a time, as the library does: no final form of sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, words: set[str]) -> None:
        """Encode the words not known yet."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
            self.apart = {k: v for k, v in self.apart.items() if v} if len(self.apart) < 10 * KEPT_WORDS else {}
        new = {}
        for w in words - self.known.keys():
            if w[0] == SPECIAL and w[1:] in self.special:
                t = w[1:]
                self.known[w] = (str(self.special[t]), t, 1)
            else:
                new["".join(map(self.table.__getitem__, w.encode("utf-8", "replace")))] = w
        for w, tokens in self.tokens(list(new)):
            self.known[new[w]] = (" ".join([str(self.ids[t]) for t in tokens]), " ".join(tokens), len(tokens))

    def encode(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each text: ids joined by a space, tokens joined by a space (what decoding gives), their number."""
        parts = [self.segments(t) for t in texts]
        self.learn(set().union(*parts))
        known, out = self.known, []
        for words in parts:
            found = [known[w] for w in words]
            out.append((" ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])))
        return out


def load(path: str) -> WordBPE:
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def sliced(texts: list[str], most: int = SLICE) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, so that words of few texts are held at once."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (joined by spaces), tokens (decoded text), n_tokens."""
    return _encoded(docs, path, "ids string, tokens string, n_tokens long", lambda ids, tokens, n: (ids, tokens, n))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
    return _encoded(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, tokens, n: (n, sha(ids), sha(tokens)))


def _encoded(docs: DataFrame, path: str, schema: str, give) -> DataFrame:
    kind, names = docs.schema["doc_id"].dataType.simpleString(), [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            rows = [give(*x) for part in sliced(texts) for x in bpe.encode(part)]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", frame["doc_id"].reset_index(drop=True))
            yield out

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(lean(run), f"doc_id {kind}, {schema}")
