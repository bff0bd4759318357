"""Byte-pair encoding and decoding by forced-boundary splitting.

A merge joins two neighbouring symbols into a vocabulary token, so the two bytes at the
seam stand side by side inside that token. Byte pairs that occur inside no token thus mark
certain cuts: no merge ever crosses them. A word is cut there, its fragments are encoded
one by one, and their ids are concatenated; fragments recur far more often than words.

Encodes as the tokenizers library does with the same file (normaliser, pre-tokeniser and
special tokens are the file's, run by the library; splitting and merging are done here).
Words and fragments are kept in caches of bounded size.

Defined results: null text is empty; an empty text has no ids and decodes to an empty
string; repeated rows are encoded each; other columns pass through unless their names
clash with the output's, which then win; an empty table gives no rows; of equal ranks the
leftmost merge comes first, as in the library; very long texts are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from operator import itemgetter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Entries that a cache holds before it is emptied.
CACHE_ENTRIES = 120_000
#: Rows encoded at once; a batch returned is as long.
OUT_ROWS = 256
#: Words of more bytes are merged one by one.
LONG = 48
NONE = np.int64(1) << 60
#: Before the piece that stands for a special token; white space, so it starts no other piece.
SPECIAL = " "
#: Beyond these letters the library's own normaliser and pre-tokeniser run.
NOT_LATIN = re.compile("[^\x00-\u036f]")
LATIN_SPACE = re.compile("[\x09-\x0d \x85\xa0]+")
#: Ids and decoded text of a piece without words.
NOTHING = b"", ""
IDS, DECODED = itemgetter(0), itemgetter(1)
#: The file's pattern for words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable bytes are themselves, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library with byte-level letters and a word-end suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.from_letter = {c: chr(b) for c, b in _byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = _byte_letters()
        self.inside = set()
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            self.inside.update(zip(body, body[1:], strict=False))
        assert all(a in letters for a, _ in self.inside), "not a byte-level vocabulary"
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = self.vocab.get(left + right)
            if made is not None and left in self.vocab and right in self.vocab:
                self.merges.setdefault((self.vocab[left], self.vocab[right]), (rank, made))
        self._tables()
        #: Of each token its text after a blank; of words and pieces their ids, and the texts of their tokens so.
        self.spaced = {i: " " + t for i, t in self.tokens.items()}
        self.words: dict[bytes, tuple[bytes, str]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {"": NOTHING}

    def _tables(self) -> None:
        """The vocabulary as arrays: symbols of bytes, byte pairs inside tokens, merges sorted by pair."""
        letters = _byte_letters()
        by_byte = {b: c for c, b in letters.items()}
        self.size = 1 + max(self.tokens)
        self.base = np.array([self.vocab[by_byte[b]] for b in range(256)], np.int64)
        self.base_end = np.array([self.vocab[by_byte[b] + self.suffix] for b in range(256)], np.int64)
        self.inside_bytes = np.zeros((256, 256), bool)
        for a, b in self.inside:
            self.inside_bytes[letters[a], letters[b]] = True
        keys = np.array([a * self.size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.merge_keys = keys[order]
        ranked = np.array(list(self.merges.values()), np.int64)[order]
        self.merge_ranks, self.merge_made = ranked[:, 0], ranked[:, 1]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there's no merge) and product of each pair."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        found = self.merge_keys[at] == key
        return np.where(found, self.merge_ranks[at], NONE), self.merge_made[at]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        ids, ends = self._encoded(words)
        return np.split(ids, ends[:-1]) if words else []

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where those of each end. All fragments of all words merge side by side, one merge a round in each."""
        if not words:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbol = self.base[data]
        symbol[ends - 1] = self.base_end[data[ends - 1]]
        # A fragment starts at the start of a word and at each certain cut.
        first = np.ones(len(data), bool)
        first[1:] = ~self.inside_bytes[data[:-1], data[1:]]
        first[ends[:-1]] = True
        result = np.full(len(data), -1, np.int64)
        place, fragment = np.arange(len(data)), np.cumsum(first) - 1
        rank = np.full(len(data), NONE, np.int64)
        made = np.zeros(len(data), np.int64)
        joined = np.flatnonzero(~first)  # a symbol with one before it in its fragment
        rank[joined - 1], made[joined - 1] = self._ranks(symbol[joined - 1], symbol[joined])
        while True:
            starts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
            sizes = np.diff(np.r_[starts, len(fragment)])
            least = np.minimum.reduceat(rank, starts)
            live = least != NONE
            done = ~np.repeat(live, sizes)
            result[place[done]] = symbol[done]
            if not live.any():
                break
            go = ~done
            symbol, place, fragment, rank, made = symbol[go], place[go], fragment[go], rank[go], made[go]
            sizes, least = sizes[live], least[live]
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            hits = hits[np.r_[True, fragment[hits[1:]] != fragment[hits[:-1]]]]  # the leftmost of each fragment
            symbol[hits] = made[hits]
            stay = np.ones(len(symbol), bool)
            stay[hits + 1] = False
            moved = np.cumsum(stay) - 1
            symbol, place, fragment, rank, made = symbol[stay], place[stay], fragment[stay], rank[stay], made[stay]
            at = moved[hits]
            for left in (at, at - 1):
                left = left[left >= 0]
                right = np.minimum(left + 1, len(symbol) - 1)
                pair = (right > left) & (fragment[left] == fragment[right])
                rank[left] = NONE
                left, right = left[pair], right[pair]
                rank[left], made[left] = self._ranks(symbol[left], symbol[right])
        kept = result >= 0
        counts = np.add.reduceat(kept, np.r_[0, ends[:-1]])
        return result[kept].astype("<u4"), np.cumsum(counts)

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """Merges by rank, leftmost first among equal ranks, over a linked list and a heap: n log n for long words."""
        n, merges = len(symbols), self.merges
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], alive[j] = made, False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := merges.get((made, symbols[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], made, symbols[after[i]]))
            if (k := before[i]) >= 0 and (m := merges.get((symbols[k], made))):
                heapq.heappush(heap, (m[0], k, m[1], symbols[k], made))
        return [s for s, live in zip(symbols, alive, strict=True) if live]

    def _fill(self, missing: list[str]) -> None:
        """Encode pieces (normalised, without white space) that no cache holds."""
        whole: list[tuple[str, bytes]] = []  # pieces of one word, as most are
        split: list[tuple[str, list[bytes]]] = []
        for piece in missing:
            if not (piece.isascii() or NOT_LATIN.search(piece) is None):
                split.append((piece, [bytes([ord(self.from_letter[c]) for c in w]) for w, _ in self.pre_tokenizer.pre_tokenize_str(piece)]))
            elif piece.isalpha():
                whole.append((piece, piece.encode()))
            else:
                split.append((piece, [w.encode() for w in WORDS.findall(piece)]))
        words = self.words
        needed = {w for _, w in whole}
        needed.update(*[found for _, found in split])
        unknown = [w for w in needed if w not in words]
        if len(words) + len(unknown) > CACHE_ENTRIES:  # what this batch needs stays
            self.words = words = {w: words[w] for w in needed if w in words}
        short = [w for w in unknown if len(w) <= LONG]
        ids, ends = self._encoded(short)
        raw, shown, at = ids.tobytes(), [self.spaced[i] for i in ids.tolist()], 0
        for w, end in zip(short, ends.tolist(), strict=True):
            words[w] = raw[4 * at : 4 * end], "".join(shown[at:end])
            at = end
        for w in unknown:
            if len(w) > LONG:
                long = self._encode_long(w)
                words[w] = array("I", long).tobytes(), "".join([self.spaced[i] for i in long])
        pieces = self.pieces
        for piece, w in whole:
            pieces[piece] = words[w]
        for piece, found in split:
            got = [words[w] for w in found]
            pieces[piece] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), "".join([g[1] for g in got]))

    def _encode_long(self, data: bytes) -> list[int]:
        """One word: its fragments merged one by one, over a heap."""
        cuts = [i for i in range(1, len(data)) if not self.inside_bytes[data[i - 1], data[i]]]
        ids: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            symbols = [int(self.base[c]) for c in data[a:b]]
            if b == len(data):
                symbols[-1] = int(self.base_end[data[-1]])
            ids += self._merge_long(symbols)
        return ids

    def _normalised(self, text: str) -> list[str]:
        """The pieces between white space of the normalised text."""
        if NOT_LATIN.search(text) is None:  # here Python's NFC and lower case are the library's
            plain = text if text.isascii() else unicodedata.normalize("NFC", text)
            return LATIN_SPACE.split(plain.lower())
        return self.normalizer.normalize_str(text).split(" ")

    def encode_decode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and what they decode to."""
        rows: list[list[str]] = []
        for text in texts:
            if not text:
                rows.append([])
            elif self.special_split is not None and "<|" in text and self.special_split.search(text):
                parts: list[str] = []
                for part in self.special_split.split(text):
                    parts += [SPECIAL + part] if part in self.special else self._normalised(part)
                rows.append(parts)
            else:
                rows.append(self._normalised(text))
        pieces, used = self.pieces, set().union(*rows)
        missing = [p for p in used if p not in pieces]
        if len(pieces) + len(missing) > CACHE_ENTRIES:  # what this batch needs stays: words that are often used always are among it
            self.pieces = pieces = {p: pieces[p] for p in used if p in pieces} | {"": NOTHING}
        for p in missing:
            if p[0] == SPECIAL and p[1:] in self.special:
                pieces[p] = array("I", [self.special[p[1:]]]).tobytes(), p
        self._fill([p for p in missing if p not in pieces])
        out = []
        for row in rows:
            found = [pieces[p] for p in row]
            out.append((b"".join(map(IDS, found)), "".join(map(DECODED, found))[1:]))
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens with spaces between."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder to a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_decode(documents: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """documents without the text, with ids (binary, little-endian unsigned 32-bit), n_tokens and decoded."""
    import pyarrow as pa

    made = {"ids", "n_tokens", "decoded"}
    keep = [c for c in documents.columns if c not in made | {text_col}]
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def batches(it):
        bpe = load(path)
        for whole in it:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                both = bpe.encode_decode(batch.column(len(keep)).to_pylist())
                ids, decoded = [a for a, _ in both], [b for _, b in both]
                columns = [batch.column(i) for i in range(len(keep))]
                columns += [pa.array([len(a) // 4 for a in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids", "decoded"])

    rows = documents.select(*[documents[c] for c in keep], documents[text_col].cast("string"))
    return rows.toDF(*[f"c{i}" for i in range(len(keep) + 1)]).mapInArrow(batches, schema)  # by place: no name clashes
