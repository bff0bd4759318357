"""Phrase collocations by hierarchical pair naming.

Texts are cut at punctuation into pieces and those into words. Everything is per language.
A frequent word (at least `least` occurrences) gets an id. Then, length by length, two adjacent
frequent (k-1)-grams, which share all but their ends, are a pair of ids that names a k-gram: where all
places of a pair meet they are counted, a frequent pair gets one id for the whole corpus (its
smallest place), and a join takes the ids back to the texts, where they replace the pairs. A phrase can only be frequent if both its (k-1)-grams are, so nothing is lost.
The pair is at once the pointer to the k-gram's two parents. They give all that the score needs,
length by length: the counts of a phrase's beginnings are those of its left parent and its own,
the counts of its ends those of its right parent and its own. And they tell what is contained in
a longer phrase: if that occurs at least `percent` in a hundred times as often as a phrase inside
it, so does every phrase between the two, down to one that has the phrase as a parent.

Scale: a task writes its texts as blocks of about `block_bytes`: an array of numbers (0 between
pieces) and the block's own dictionary of what the numbers mean, with counts. Only dictionaries
are shuffled by key, once for each length and in passes by key, so a word or pair comes once for each
block, however frequent it is; names come back to a block as one bounded list, and numbers (deflated) move to meet
their block's names. From length to length the arrays shrink to what can still be frequent. No table
of words, pairs or phrases is broadcast or collected: all of these grow with the corpus, and their Parquet files, by which Spark would
choose a broadcast, are a small part of what they take in memory. Only a row for each language may be broadcast.

Defined results: null and empty texts have no words; a null language is `und`; rows alike count as
often as they come; extra columns are ignored, whatever their names, and ids aren't needed; an empty table
gives no rows; very long texts count whole, in slices (a piece is never cut); ties in rank fall by
count and then by phrase in UTF-8 byte order.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.scratch import Scratch

#: Ends of pieces, as a regular expression's class would list them; blanks between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CAPITALS = bytes(range(65, 91))
#: A byte that no UTF-8 text holds marks the end of a piece.
_MARK = b"\xff"
_FOLD = bytes.maketrans(_CAPITALS + ENDS + BLANKS, _CAPITALS.lower() + _MARK * len(ENDS) + b" " * len(BLANKS))
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Bits of a block's number for the blocks of a task, and of an id for the entry of a block.
BLOCK_BITS, ENTRY_BITS = 12, 23


def _tokens(text: bytes):
    """Words and marks of a text, lower-cased, a slice at a time; slices end between words."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].replace(_MARK, b" \xff ").split()
        at = end


def _parts(text: bytes):
    """A text in parts of about a slice that end with a piece: blocks can begin between them."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(_MARK, at + SLICE) + 1
        end = end or len(folded)
        yield folded[at:end]
        at = end


class _Block:
    """Texts of one language as numbers, with the words that these stand for (0: end of a piece)."""

    def __init__(self):
        self.words, self.codes = {_MARK: 0}, []

    def add(self, text: bytes) -> None:
        known = self.words
        for tokens in _tokens(text):
            self.codes.append(np.array([known.setdefault(t, len(known)) for t in tokens], np.int32))
        self.codes.append(np.zeros(1, np.int32))


def _blocks(batches, block_bytes: int):
    import pyarrow as pa
    from pyspark import TaskContext

    task, made, open_blocks = TaskContext.get().partitionId(), 0, {}

    def written():
        nonlocal made
        for lang, block in open_blocks.items():
            if len(block.words) >> ENTRY_BITS:
                raise ValueError("too many words in a block for their numbers: smaller blocks are needed")
            codes = np.concatenate(block.codes)
            counts = np.bincount(codes, minlength=len(block.words))[1:]
            row = [[_block_number(task, made)], [lang], [_packed(codes)], [list(block.words)[1:]], [counts]]
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["block", "lang", "codes", "words", "counts"])
        open_blocks.clear()

    kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            for part in _parts(raw or b""):
                open_blocks.setdefault(lang, _Block()).add(part)
                size += len(part)
                if size >= block_bytes:
                    yield from written()
                    size = 0
    yield from written()


def _block_number(task: int, made: int) -> int:
    if made >> BLOCK_BITS or task >> (63 - BLOCK_BITS - ENTRY_BITS):
        raise ValueError("too many blocks for their numbers: larger blocks are needed")
    return task << BLOCK_BITS | made


def _packed(codes: np.ndarray) -> bytes:
    """Squeezed codes, deflated with their lowest bytes first, then the next ones: the high bytes are nearly all zero."""
    return zlib.compress(np.ascontiguousarray(_squeezed(codes).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """The codes with runs of zeros as one zero, and codes that stand alone between zeros as zeros as well."""
    apart = np.concatenate([[0], codes, [0]])
    alone = (apart[:-2] == 0) & (apart[2:] == 0)
    codes = np.where(alone, 0, codes).astype(np.int32)
    return codes[(codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)]


def _paired(batches):
    """block, codes, names (number in the block, id) -> block, codes of the adjacent pairs of named codes, the ids, and for each pair the places of its two among them."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            codes = _unpacked(batch.column(1)[i].as_py())
            names = batch.column(2)[i].values
            at, ids = np.asarray(names.field(0)), np.asarray(names.field(1))
            order = np.argsort(ids)
            number = np.zeros(max(int(codes.max(initial=0)), int(at.max(initial=0))) + 1, np.int32)  # place in ids' order, from 1
            number[at[order]] = np.arange(1, len(ids) + 1, dtype=np.int32)
            x = number[codes]
            both = (x[:-1] != 0) & (x[1:] != 0)
            pair = x[:-1][both].astype(np.int64) * (len(ids) + 1) + x[1:][both]
            if not len(pair):
                continue
            key = np.unique(pair)
            code = np.searchsorted(key, pair).astype(np.int32)
            counts = np.bincount(code)
            pairs = np.zeros(len(x), np.int32)
            pairs[:-1][both] = code + 1
            wide = len(ids) + 1
            row = [[batch.column(0)[i].as_py()], [_packed(pairs)], [ids[order]], [(key // wide - 1).astype(np.int32)], [(key % wide - 1).astype(np.int32)], [counts.astype(np.int32)]]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["block", "codes", "ids", "lefts", "rights", "counts"])


def _frequent(entries: DataFrame, keys: list[str], least: int) -> DataFrame:
    """entries (place, keys, counts) of blocks -> block, at, id of those whose key is frequent in the whole corpus; the id is the
    key's smallest place. At that place stand the key and its count `a` as well, null elsewhere."""
    alike = Window.partitionBy(*keys)
    met = entries.withColumns({"a": F.sum("counts").over(alike), "id": F.min("place").over(alike)}).where(F.col("a") >= least)
    told = [F.when(F.col("id") == F.col("place"), F.col(c)).alias(c) for c in [*keys, "a"]]
    return met.select(F.shiftright("place", ENTRY_BITS).alias("block"), F.col("place").bitwiseAND((1 << ENTRY_BITS) - 1).cast("int").alias("at"), "id", *told)


def _kept(scratch: Scratch, entries: DataFrame, keys: list[str], least: int, passes: int, name: str) -> DataFrame:
    """The frequent entries, written. Keys are dealt over passes, so that the shuffle of one pass only lies on the disks."""
    out = None
    for i in range(passes):
        mine = entries.where(F.pmod(F.hash(*keys), F.lit(passes)) == i)
        part = scratch.keep(_frequent(mine, keys, least), f"{name}-{i}", "zstd", free=True, one_by_one=True)
        out = part if out is None else out.unionByName(part)
    return out


def _met(one: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the corpus, both shuffled and sorted: neither goes through the driver, however small its files."""
    return one.join(other.hint("merge"), key, how)


def _place() -> Column:
    """An entry's block and number in one."""
    return F.shiftleft("block", ENTRY_BITS) + F.col("at") + 1


def _scored(grams: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Each k-gram with its weakest cut: counts and score in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    whole = lambda l, r: F.call_function("div", wide(F.col("a")) * wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), wide(l) * wide(r))  # noqa: E731, E741
    cuts = [F.struct(whole(F.col("begins")[j - 1], F.col("ends")[k - j - 1]).alias("score"), F.lit(j).alias("j"), F.col("begins")[j - 1].alias("l"), F.col("ends")[k - j - 1].alias("r")) for j in range(1, k)]
    cut = grams.join(sizes, "lang").withColumn("cut", F.array_min(F.array(*cuts)))
    return cut.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def mine_phrases(
    documents: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, lang_col: str = "lang", text_col: str = "text", block_bytes: int = 8 << 20, passes: int = 2
) -> DataFrame:
    """lang, phrase, a (count), l and r (counts of the two parts of the weakest cut), n (words of the language), score:
    all phrases of 2 to `longest` words with at least `least` occurrences, without those inside a longer one."""
    scratch = Scratch(documents.sparkSession, "phrases")
    texts = documents.select(F.coalesce(documents[lang_col].cast("string"), F.lit("und")).alias("lang"), documents[text_col].cast("string").cast("binary").alias("text"))
    blocks = scratch.keep(texts.mapInArrow(partial(_blocks, block_bytes=block_bytes), "block long, lang string, codes binary, words array<binary>, counts array<long>"), "blocks-1", "zstd")
    sizes = scratch.keep(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")), "sizes")
    entries = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select(_place().alias("place"), "lang", F.col("e.words").alias("word"), "e.counts")
    found, swallowed = [], []
    named = _kept(scratch, entries, ["lang", "word"], least, passes, "named-1")
    one = F.array("a")
    grams = scratch.keep(named.where("a is not null").select("id", "lang", "word", F.col("word").cast("string").alias("phrase"), "a", one.alias("begins"), one.alias("ends")), "grams-1")
    pair_type = "block long, codes binary, ids array<long>, lefts array<int>, rights array<int>, counts array<int>"
    for k in range(2, longest + 1):
        names = named.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("names"))
        blocks = scratch.keep(_met(blocks.select("block", "codes"), names, "block").select("block", "codes", "names").mapInArrow(_paired, pair_type), f"blocks-{k}", "zstd", free=True)
        scratch.drop(f"blocks-{k - 1}", *[f"named-{k - 1}-{i}" for i in range(passes)])
        of = lambda side: F.transform(side, lambda i: F.get("ids", i)).alias(side)
        entries = blocks.select("block", F.posexplode(F.arrays_zip(of("lefts"), of("rights"), "counts")).alias("at", "e"))
        entries = entries.select(_place().alias("place"), F.col("e.lefts").alias("left"), F.col("e.rights").alias("right"), "e.counts")
        named = _kept(scratch, entries, ["left", "right"], least, passes, f"named-{k}")
        pairs = named.where("a is not null").select("id", "left", "right", "a")
        left = grams.select(F.col("id").alias("left"), "lang", "phrase", "begins", F.col("a").alias("left_a"))
        right = grams.select(F.col("id").alias("right"), "word", "ends", F.col("a").alias("right_a"))
        longer = _met(_met(pairs, left, "left"), right, "right").select(
            "id", "lang", "word", F.concat("phrase", F.lit(" "), F.col("word").cast("string")).alias("phrase"), "a",
            F.concat("begins", F.array("a")).alias("begins"), F.concat("ends", F.array("a")).alias("ends"), "left", "right", "left_a", "right_a",
        )
        longer = scratch.keep(longer, f"grams-{k}", free=True)
        if found:
            inside = [longer.where(100 * F.col("a") >= percent * F.col(f"{side}_a")).select(F.col(side).alias("id")) for side in ("left", "right")]
            swallowed.append(inside[0].unionByName(inside[1]).distinct())
        found.append(longer)
        grams = longer
    scratch.drop(f"blocks-{longest}", *[f"named-{longest}-{i}" for i in range(passes)])
    kept = [_met(g, s, "id", "left_anti") for g, s in zip(found, swallowed)] + found[len(swallowed) :]
    scored = [_scored(g, sizes, k) for k, g in enumerate(kept, 2)]
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    return out


def top_phrases(mined: DataFrame, most: int = 2000, salts: int = 64) -> DataFrame:
    """The first `most` phrases of each language, with their rank; of each of a language's `salts` shares only as many move on."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = mined.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = first.withColumn("o", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("o") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
