"""BPE encoding and decoding by a traversal of the trie of distinct words.

For a vocabulary of merges the encoding of a prefix is the encoding of a shorter prefix and one more token, its
last one; which token that is depends on the prefix alone. So the words of a batch go into a trie (sorted, shared
prefixes together), a depth-first walk keeps the last token of each prefix on its path, and a shared prefix is
worked out once. A token fits after another if applying the merges to both texts together would not join them
across the border, which is decided by undoing their merges from the last one on.

The text pipeline is that of the public word-level file: added tokens are cut out of the raw text, the rest is
brought to NFC and lower case (by the library's version of Unicode), split into contractions, letter runs, single digits and symbol runs, and each
word's bytes become symbols, the last one with an end-of-word mark. Decoding joins the tokens with blanks.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded one by one;
an empty table gives an empty result; only the id and the text are read, so extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from rankforge.llm.common import bounded_batches, read, release, trim

VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose encodings a worker keeps from batch to batch, and pairs of tokens; beyond, it begins anew.
MEMORY, PAIRS = 250_000, 250_000
#: Bytes of text that are encoded at once: what a word and a byte take meanwhile is many times that.
LOT = 1 << 20

def _ranges(codes: set[int]) -> str:
    """Code points as the inside of a character class."""
    starts, ends = sorted(c for c in codes if c - 1 not in codes), sorted(c for c in codes if c + 1 not in codes)
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends))


@cache
def unicode_rules() -> tuple[str, str | None, dict[int, str]]:
    """The pattern of words for all texts, that for texts in Latin-1, and lower case where it isn't Python's, by the library's version of Unicode.

    Letters, numbers and white space are asked of the library's own expressions, one block of code points after another.
    Texts in Latin-1 are in NFC as they are, and remain in Latin-1 in lower case; the pattern for them is None if that isn't Python's.
    """
    names = (r"\p{L}", r"\p{N}", r"\s")
    ask = [pre_tokenizers.Split(Regex(name), "removed") for name in names]
    more, less, latin = ([set() for _ in names] for _ in range(3))
    lower, other = normalizers.Lowercase(), {0x3A3: "\u03c3"}
    for block in range(0, 0x110000, 0x800):
        if 0xD800 <= block <= 0xDFFF:
            continue
        codes = set(range(block, block + 0x800))
        text = "".join(map(chr, sorted(codes)))
        for name, split, add, drop, low in zip(names, ask, more, less, latin):
            theirs = codes.difference(ord(c) for piece, _ in split.pre_tokenize_str(text) for c in piece)
            ours = set(map(ord, regex.findall(name, text)))
            add |= theirs - ours
            drop |= ours - theirs
            low |= {c for c in theirs if c < 256}
        other |= {ord(c): low for c in text if c != "\u03a3" and (low := lower.normalize_str(c)) != c.lower()}
    letter, number, space = (f"[[{n}{_ranges(m)}]--[{_ranges(d)}]]" if d else f"[{n}{_ranges(m)}]" for n, m, d in zip(names, more, less))
    words = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{space}{letter}{number}]+"
    letter, number, space = map(_ranges, latin)
    plain = rf"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{space}{letter}{number}]+"
    return words, None if any(c < 256 for c in other) else plain, other


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Vocabulary:
    """Ids, texts and merges of a BPE vocabulary; plain data, fit to be sent to executors."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.key = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words, self.plain, self.lower = unicode_rules()


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.added, self.lower = v.added, v.lower
        text = {i: t for t, i in v.ids.items()} | {i: t for t, i in v.added.items()}
        # Of each merge: its rank by the pair of ids; the rank and parts of each token that a merge makes.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        sound = {i for t, i in v.ids.items() if len(t.removesuffix(v.end)) == 1}
        self._fits: dict[int, bool] = {}  # by the pair of ids as one number
        self._width = max(v.ids.values()) + 1
        for rank, (x, y) in enumerate(v.merges):
            a, b, t = v.ids[x], v.ids[y], v.ids[x + y]
            self.rank.setdefault((a, b), rank)
            if t not in self.made and t not in sound:
                self.made[t] = (rank, a, b)
        for t, (rank, a, b) in self.made.items():
            # Only tokens whose own text is encoded as that token can occur.
            if a in sound and b in sound and self._apart(a, b, rank):
                sound.add(t)
        self._automaton({t: i for t, i in v.ids.items() if i in sound and not t.endswith(v.end)})
        final = {t.removesuffix(v.end): i for t, i in v.ids.items() if i in sound and t.endswith(v.end)}
        # Final tokens, and what they end in (-1 if that is no final token).
        self.endings = dict.fromkeys((t[k:] for t in final for k in range(1, len(t))), -1) | final
        self.words, self.plain, self.nfc = regex.compile(v.words), v.plain and re.compile(v.plain), normalizers.NFC()
        # Of each byte its symbol; line feeds, which no word holds, stand between words.
        self.symbols = np.array([ord(s) for s in byte_symbols()], "<u2")
        self.symbols[10] = 10
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        texts = [text.get(i, "").encode() + b" " for i in range(max(text) + 1)]
        self.token_text, self.token_ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        self.forget()

    def forget(self) -> None:
        """Words known by number; the ids of word k are flat[ends[k]:ends[k + 1]]."""
        self.index: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def _automaton(self, inner: dict[str, int]) -> None:
        """Of each text read so far, which tokens it ends in: Aho-Corasick over the inner tokens, longest first."""
        self.step: list[dict[str, int]] = [{}]
        self.tails: list[tuple[tuple[int, int], ...]] = [()]
        own: list[tuple[tuple[int, int], ...]] = [()]
        for t, i in inner.items():
            at = 0
            for c in t:
                nxt = self.step[at].get(c)
                if nxt is None:
                    nxt = self.step[at][c] = len(self.step)
                    self.step.append({})
                    own.append(())
                at = nxt
            own[at] = ((i, len(t)),)
        self.back = [0] * len(own)
        self.tails = own
        level = list(self.step[0].values())
        while level:
            below = []
            for at in level:
                self.tails[at] = own[at] + self.tails[self.back[at]]
                for c, nxt in self.step[at].items():
                    self.back[nxt] = self._next(self.back[at], c)
                    below.append(nxt)
            level = below
        self.jump: list[dict[str, int]] = [{} for _ in own]

    def _next(self, at: int, c: str) -> int:
        while True:
            nxt = self.step[at].get(c)
            if nxt is not None:
                return nxt
            if not at:
                return 0
            at = self.back[at]

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of a rank below limit joins a and b across their border, undoing the later merge first.

        Of two merges of one rank the left one is made first, so the right one is undone first.
        """
        made, rank = self.made, self.rank
        while True:
            joined = rank.get((a, b))
            if joined is not None and joined < limit:
                return False
            x, y = made.get(a), made.get(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and x[0] > y[0]:
                limit, a = x[0], x[2]
            else:
                limit, b = y[0] + 1, y[1]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a within a word; the answer is kept."""
        if len(self._fits) > PAIRS:
            self._fits.clear()
        got = self._fits[a * self._width + b] = self._apart(a, b, 1 << 60)
        return got

    def learn(self, words: list[str]) -> None:
        """Encode distinct words: a depth-first walk through the trie of their byte symbols."""
        tails, jump, kept, width, ending = self.tails, self.jump, self._fits.get, self._width, self.endings.get
        raw = dict(zip(self._spell(words), words))
        # Of the path from the root, by depth: the last token and its length, and the automaton's state; known up to depth.
        size = max(map(len, raw)) + 1
        last, ends, state = [-1] * size, [0] * size, [0] * size
        index, flat, stops, before, depth = self.index, self.flat, self.ends, "", 0
        for word in sorted(raw):
            length = len(word)
            shared, top = 0, min(depth, length - 1)
            while shared < top and before[shared] == word[shared]:
                shared += 1
            at = state[shared]
            for n in range(shared + 1, length):
                c = word[n - 1]
                nxt = jump[at].get(c)
                if nxt is None:
                    nxt = jump[at][c] = self._next(at, c)
                at = nxt
                for t, long in tails[at]:
                    if long == n:
                        break
                    a = last[n - long]
                    if a >= 0:
                        ok = kept(a * width + t)
                        if self.fits(a, t) if ok is None else ok:
                            break
                else:
                    t, long = -1, 1
                last[n], ends[n], state[n] = t, long, at
            before, depth = word, length - 1
            # Final tokens that the word ends in, the longest one first.
            may = []
            for at in range(length - 1, -1, -1):
                t = ending(word[at:])
                if t is None:
                    break
                if t >= 0:
                    may.append((at, t))
            ids = []
            for at, t in reversed(may):
                if at:
                    a = last[at]
                    if a < 0:
                        continue
                    ok = kept(a * width + t)
                    if not (self.fits(a, t) if ok is None else ok):
                        continue
                ids.append(t)
                break
            else:
                at = length - 1
            while at > 0:
                ids.append(last[at])
                at -= ends[at]
            ids.reverse()
            index[raw[word]] = len(index)
            flat.extend(ids)
            stops.append(len(flat))

    def pieces(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        if self.plain and (text.isascii() or _latin(text)):
            return self.plain.findall(text.lower())
        return self.words.findall(self.nfc.normalize_str(text).translate(self.lower).lower())

    def _spell(self, words: list[str]) -> list[str]:
        """The words' bytes as symbols."""
        return self.symbols[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n")

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        if len(self.index) > MEMORY:
            self.forget()
        words: list[str] = []
        counts = []
        for text in texts:
            before = len(words)
            if text and any(a in text for a in self.added):
                for part in self.cut.split(text):
                    if part in self.added:
                        if part not in self.index:
                            self.index[part] = len(self.index)
                            self.flat.append(self.added[part])
                            self.ends.append(len(self.flat))
                        words.append(part)
                    else:
                        words += self.pieces(part)
            elif text:
                words += self.pieces(text)
            counts.append(len(words) - before)
        found = list(map(self.index.get, words))
        if None in found:
            self.learn(list({w for w, k in zip(words, found) if k is None}))
            found = list(map(self.index.__getitem__, words))
        flat, ends = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.int64)
        at, word_ends = np.array(found, np.int64), np.cumsum([0, *counts])
        ids, stops = gather(flat, ends, at)
        said, said_stops = gather(self.token_text, self.token_ends, ids.astype(np.int64))
        ids, said, cuts = ids.astype("<u4").tobytes(), said.tobytes(), stops[word_ends]
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            # Each token's text ends in a blank; the last one of a text goes.
            out.append((ids[4 * a : 4 * b], said[said_stops[a] : max(said_stops[a], said_stops[b] - 1)]))
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[ends[k]:ends[k + 1]] for each k of at, one after another, and where each ends (from 0)."""
    starts = ends[at]
    stops = np.concatenate([[0], np.cumsum(ends[at + 1] - starts)])
    shift = np.repeat(starts - stops[:-1], np.diff(stops))
    return flat[shift + np.arange(len(shift))], stops


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, packed: bytes) -> Encoder:
    """A worker's encoder, kept from task to task; the vocabulary it is made of, and what earlier operators left, goes."""
    if key not in _ENCODERS:
        release()
        _ENCODERS[key] = Encoder(pickle.loads(packed))
        trim()
    return _ENCODERS[key]


def lots(b: pa.RecordBatch, rows: int, size: int = LOT):
    """Slices of a batch of ids and texts: so many rows, and so many bytes of text, at most, but one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < b.num_rows:
        fit = int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right"))
        to = max(at + 1, min(at + rows, fit))
        yield b.slice(at, to - at)
        at = to


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digest: bool = False, batch: int = 256) -> DataFrame:
    """One row for each row of docs: (id, n_tokens, ids binary, decoded), or with digest their SHA-256 in hex instead.

    path: the vocabulary file, read by the driver only; it is sent to the executors (its size doesn't depend on docs).
    """
    bounded_batches(docs.sparkSession)
    vocabulary = Vocabulary(path or public_tokenizers.path(VOCABULARY))
    key, packed = vocabulary.key, docs.sparkSession.sparkContext.broadcast(pickle.dumps(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string")

    def run(batches):
        encoder = _encoder(key, packed.value)
        for whole in batches:
            for b in lots(whole, batch):
                got = encoder.encode_batch(b.column(1).to_pylist())
                n = pa.array([len(i) // 4 for i, _ in got], pa.int64())
                if digest:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    ids, said = pa.array([sha(i) for i, _ in got], pa.string()), pa.array([sha(d) for _, d in got], pa.string())
                else:
                    ids, said = pa.array([i for i, _ in got], pa.binary()), pa.array([d.decode() for _, d in got], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), n, ids, said], names=["id", "n_tokens", "ids", "said"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("id", "doc_id")
