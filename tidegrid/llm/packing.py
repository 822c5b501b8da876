"""Best-fit packing into fixed-length sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. A piece that fills a sequence is one. The others are dealt at
random (a hash of the row) into blocks of about BLOCK pieces; each block is a bin-packing problem of its own, so that
memory is bounded and the number of tasks grows with the input, at a loss of under one sequence in a block.

ISLANDS populations of a block evolve in tasks of their own, each from groupings of pieces in disordered order. A
crossover injects whole well-filled bins of one parent into the other, takes out the bins that now hold a piece twice,
and puts the displaced pieces back by best fit; a mutation dissolves some of the emptiest bins likewise. A population
that meets the lower bound of its block is optimal and ends the block. After each epoch every island's elite migrates to
the next island; whole populations are written to the shared folder between epochs, so a lost executor costs only its
own tasks. At the end plain best-fit decreasing is held against the best of the islands, and the better one counts.

Nulls and odd input: a null text is empty and becomes the single closing token; null or repeated ids and repeated rows
stay rows of their own; long texts are cut into pieces, nothing is dropped; an empty table packs into nothing. Only
doc_id and text are read.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import settle, small_batches, trim

CAPACITY = 4096
#: Pieces of a block, on average.
BLOCK = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 6, 4
END_ID = 1
#: Disorder of the groupings that populations start from: the share of a length that the order may be off by.
DISORDER = (0.25, 0.5, 1.0, 2.0)
#: Bytes of keys and ids that a worker's cache holds at most before it starts anew, and texts that are encoded together.
CACHE_BYTES, TEXTS = 48 << 20, 256
#: Most tasks of an epoch.
MOST_TASKS = 10_000
# Characters at which str.split() cuts and the tokenizer's white space doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
# Marks that are neither letters, digits nor white space, and the end of the Latin letters.
MARKS = "!#$%&()*+,-./:;<=>?@[]^_{|}~"
LATIN_END = "\u0250"
# The pattern of the tokenizer that plain texts are cut for, and its normalizer's steps.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]


def _shown_bytes() -> dict[int, str]:
    """Byte-level vocabularies show a byte as the character of that number if it prints, else as the next one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_SHOWN = _shown_bytes()


def _plain() -> tuple[re.Pattern, re.Pattern]:
    """(characters that plain texts don't have, PATTERN over lower-cased plain texts).

    Plain texts hold ASCII, Latin letters and common marks only: no character that composes with others, or whose lower
    case is more than one character or of another kind.
    """
    known = [chr(c) for c in [*range(33, 0x250), *range(0x2010, 0x205F), 0x20AC] if not 127 <= c < 161]
    kind = {c: "L" if c.isalpha() else "N" if c.isnumeric() else "M" for c in known if not c.isspace() and unicodedata.is_normalized("NFC", c) and unicodedata.category(c)[0] != "C"}
    kind = {c: k for c, k in kind.items() if kind.get(c.lower()) == k}
    of = lambda k: "".join(re.escape(c) for c, own in kind.items() if own == k)
    low = "".join(c for c in kind if kind[c] == "L" and c.lower() == c)
    return re.compile(f"[^ \\t\\n\\x0b\\f\\r\\xa0{of('L')}{of('N')}{of('M')}]"), re.compile(f"[{low}]+|[{of('N')}]|'(?:s|t|re|ve|m|ll|d)|[{of('M')}]+")


_ODD, _PIECE = _plain()


class _Known(dict):
    """Ids of pieces, made when they are first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        return self.make(piece)


class Ids:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, equal to encode(text, add_special_tokens=False).ids.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its chunks between
    white space; chunks that texts share are made once, by the tokenizer's own normalizer, pre-tokenizer and model, and
    kept in a cache bounded by bytes. A chunk of Latin letters, with or without a run of marks behind it, needs no
    pre-tokenizer: the letters are one piece and the marks another. `closed` is false for a tokenizer of another make:
    whole texts are then encoded. Plain texts (see _plain) are cut into pieces at once, if the tokenizer has PATTERN:
    they have far fewer distinct pieces than chunks.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        spec = json.loads(self.tok.to_str())
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.closed = bool(spec["model"].get("end_of_word_suffix")) and first.get("type") == "Split" and first.get("invert", False)
        steps, kinds = (spec["normalizer"] or {}).get("normalizers") or [], (spec["pre_tokenizer"] or {}).get("pretokenizers") or []
        self.cuts = self.closed and first["pattern"] == {"Regex": PATTERN} and [x["type"] for x in steps] == NORMAL and [x["type"] for x in kinds[1:]] == ["ByteLevel"] and not kinds[1]["add_prefix_space"] and not kinds[1]["use_regex"]
        self.tokenize = self.tok.model.tokenize
        self.numbers = [n.to_bytes(4, "little") for n in range(self.tok.get_vocab_size())]
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pieces = _Known(self._piece)
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = b"".join([self.numbers[t.id] for t in self.tokenize(word)])
            self.held += 160 + len(word) + len(found)
        return found

    def _piece(self, piece: str) -> bytes:
        if len(piece) > 200:
            return self._whole(piece)
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_SHOWN)
        of = self.numbers
        found = self.pieces[piece] = b"".join([of[t.id] for t in self.tokenize(shown)])
        self.held += 160 + len(piece) + len(found)
        return found

    def _chunk(self, chunk: str, normal: str) -> bytes:
        if len(chunk) > 200:
            return self._whole(chunk)
        letters = normal.rstrip(MARKS)
        if letters.isalpha() and (letters.isascii() or max(letters) < LATIN_END):
            own = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_SHOWN)
            return self._word(own) + self._word(normal[len(letters) :]) if len(letters) < len(normal) else self._word(own)
        return b"".join([self._word(w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)])

    def _learn(self, missing: list[str]) -> None:
        """Put the ids of chunks into the cache."""
        plain = [c for c in missing if c.isascii()]
        other = [c for c in missing if not c.isascii()]
        normal = "\n".join(plain).lower().split("\n") if plain else []
        normalize = self.tok.normalizer.normalize_str if self.tok.normalizer is not None else str
        marked = normalize(" ".join(other)).split(" ") if other else []
        if len(marked) != len(other):
            marked = [normalize(c) for c in other]
        for c, n in zip(plain + other, normal + marked):
            self.chunks[c] = found = self._chunk(c, n)
            self.held += 160 + len(c) + len(found)

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        cut: list[list[str] | None] = []
        if self.held > CACHE_BYTES:
            self.forget()
        piece, out = self.pieces.__getitem__, []
        for t in texts:
            t, found = t or "", b""
            if t and (not self.closed or any(s in t for s in SEPARATORS) or any(s in t for s in self.special)):
                cut.append(None)
            elif self.cuts and not _ODD.search(t):
                cut.append([])
                found = b"".join(map(piece, _PIECE.findall(t.lower())))
            else:
                cut.append(t.split())
            out.append(found)
        missing = set().union(*(c for c in cut if c)).difference(self.chunks)
        if missing:
            self._learn(list(missing))
        get = self.chunks.__getitem__
        return [self._whole(t) if c is None else b"".join(map(get, c)) if c else known for t, c, known in zip(texts, cut, out)]

    def __call__(self, text: str | None) -> bytes:
        return self.of([text])[0]


_IDS: dict[str, Ids] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    small_batches(docs.sparkSession)
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _IDS:  # the vocabulary stays with the worker, the caches don't
            _IDS[tokenizer_path] = Ids(tokenizer_path)
        ids = _IDS[tokenizer_path]
        end = END_ID.to_bytes(4, "little")
        for whole in it:
            for some in range(0, whole.num_rows, TEXTS):
                b = whole.slice(some, TEXTS)
                row, piece, start, length, crc = [], [], [], [], []
                for i, data in enumerate(ids.of(b.column(1).to_pylist())):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                cols = [pa.array(c, t) for c, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *cols], ["doc_id", "piece", "start", "length", "ids_crc32"])
        ids.forget()
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: for each size k, pieces over capacity - k stand alone, those over half each take a bin, and the rest of at least k must fit around them."""
    w = np.sort(lengths)
    if not len(w):
        return 0
    total = np.concatenate([[0], np.cumsum(w)])
    half = int(np.searchsorted(w, capacity // 2, side="right"))
    best = math.ceil(int(w.sum()) / capacity)
    for k in np.unique(w[:half]):
        alone = int(np.searchsorted(w, capacity - k, side="right"))
        low = int(np.searchsorted(w, k))
        room = (alone - half) * capacity - int(total[alone] - total[half]) if alone > half else 0
        best = max(best, len(w) - half + max(0, math.ceil((int(total[half] - total[low]) - room) / capacity)))
    return max(best, len(w) - half)


class Packer:
    """Bins over pieces with the given lengths; a bin is a list of piece numbers."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.w, self.capacity, self.random = lengths, capacity, random.Random(seed)

    def best_fit(self, items: list[int], bins: list[list[int]], free: list[int]) -> None:
        """Put items, in the order given, each where it leaves the least room."""
        w, capacity = self.w, self.capacity
        at: list[list[int]] = [[] for _ in range(capacity + 1)]
        mask = 0
        for b, f in enumerate(free):
            at[f].append(b)
            mask |= 1 << f
        for i in items:
            n = w[i]
            m = mask >> n
            if m:
                r = n + (m & -m).bit_length() - 1
                b = at[r].pop()
                if not at[r]:
                    mask ^= 1 << r
            else:
                r, b = capacity, len(bins)
                bins.append([])
                free.append(capacity)
            bins[b].append(i)
            free[b] = r = r - n
            if not at[r]:
                mask |= 1 << r
            at[r].append(b)

    def decreasing(self, items: list[int]) -> list[int]:
        return sorted(items, key=lambda i: (-self.w[i], i))

    def first(self, noise: float = 0.0) -> list[list[int]]:
        """Best-fit decreasing, of slightly disordered lengths if there is noise."""
        order = self.decreasing(list(range(len(self.w)))) if not noise else sorted(range(len(self.w)), key=lambda i: -self.w[i] * (1 + noise * self.random.uniform(-1, 1)))
        bins: list[list[int]] = []
        self.best_fit(order, bins, [])
        return bins

    def fill(self, b: list[int]) -> int:
        return sum(self.w[i] for i in b)

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones: full bins and one almost empty."""
        return -len(bins), sum((self.fill(b) / self.capacity) ** 2 for b in bins)

    def _repack(self, bins: list[list[int]], displaced: list[int]) -> list[list[int]]:
        self.random.shuffle(displaced)
        self.best_fit(self.decreasing(displaced), bins, [self.capacity - self.fill(b) for b in bins])
        return bins

    def crossover(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """a with whole well-filled bins of b: bins of a that hold a piece of them go, and their other pieces find new places."""
        full = sorted(b, key=self.fill, reverse=True)[: max(1, len(b) // 2)]
        injected = [list(x) for x in self.random.sample(full, max(1, len(full) // 4))]
        taken = {i for x in injected for i in x}
        bins, displaced = injected, []
        for x in a:
            if taken.isdisjoint(x):
                bins.append(list(x))
            else:
                displaced += [i for i in x if i not in taken]
        return self._repack(bins, displaced)

    def mutate(self, a: list[list[int]]) -> list[list[int]]:
        """Dissolve the emptiest bins and a few others."""
        order = sorted(range(len(a)), key=lambda k: self.fill(a[k]))
        gone = {*order[: 1 + len(a) // 100], *self.random.sample(range(len(a)), max(1, len(a) // 50))}
        return self._repack([list(x) for k, x in enumerate(a) if k not in gone], [i for k in gone for i in a[k]])

    def evolve(self, population: list[list[list[int]]], generations: int, enough: int) -> list[list[int]]:
        """The elite of the population that bred() gives."""
        return self.bred(population, generations, enough)[0]

    def bred(self, population: list[list[list[int]]], generations: int, enough: int) -> list[list[list[int]]]:
        """The population, best first, after some generations, or as soon as its elite needs no more than `enough` bins."""
        pop = sorted(population, key=self.fitness, reverse=True)
        for _ in range(generations):
            if len(pop[0]) <= enough:
                break
            children = []
            for _ in range(len(pop)):
                a, b = self.random.choice(pop[: max(2, len(pop) // 2)]), self.random.choice(pop)
                child = self.crossover(a, b)
                children.append(self.mutate(child) if self.random.random() < 0.5 else child)
                if len(children[-1]) <= enough:
                    break
            pop = sorted([*pop, *children], key=self.fitness, reverse=True)[: len(pop)]
        return pop


def _labels(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<u4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(labels: bytes) -> list[list[int]]:
    of = np.frombuffer(labels, "<u4")
    out: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for i, k in enumerate(of.tolist()):
        out[k].append(i)
    return out


_STATE = "block long, island int, population array<binary>, n_bins int, done boolean"
_ARROW = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("population", pa.list_(pa.binary())), ("n_bins", pa.int32()), ("done", pa.bool_())])


def _epoch(capacity: int, epoch: int):
    """Rows: block, lengths, island, own population, elite that migrated here (none before the first epoch)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                lengths = r["lengths"]
                p = Packer(lengths, capacity, zlib.crc32(f"{r['block']}/{r['island']}/{epoch}".encode()))
                enough = lower_bound(np.array(lengths), capacity)
                pop = [_bins(x) for x in (r["population"] or [])][: POPULATION - (r["guest"] is not None)]
                pop += [_bins(r["guest"])] if r["guest"] is not None else []
                while len(pop) < POPULATION and not (pop and min(map(len, pop)) <= enough):
                    pop.append(p.first(DISORDER[len(pop) % len(DISORDER)]))
                pop = p.bred(pop, GENERATIONS, enough)
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "island": r["island"], "population": [_labels(x, len(lengths)) for x in pop], "n_bins": len(pop[0]), "done": len(pop[0]) <= enough}], _ARROW)

    return batches


def _decreasing(capacity: int):
    """Rows: block, lengths, labels, n_bins; plain best-fit decreasing, if it is better or there are no labels."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                labels, n = r["labels"], r["n_bins"]
                if n > lower_bound(np.array(r["lengths"]), capacity):
                    bins = Packer(r["lengths"], capacity, 0).first()
                    labels = _labels(bins, len(r["lengths"])) if len(bins) < n else labels
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([labels], pa.binary())], ["block", "labels"])

    return batches


def _placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: block, pieces, labels; a row for each piece, bin by bin."""
    for b in it:
        for k in range(b.num_rows):
            rows = b.column(1)[k].values
            of = np.frombuffer(b.column(2)[k].as_py(), "<u4").astype(np.int64)
            order = np.argsort(of, kind="stable")
            length = rows.field("length").to_numpy()[order]
            bins = of[order]
            ends = np.cumsum(length)
            first = np.concatenate([[True], bins[1:] != bins[:-1]])
            base = (ends - length)[first][np.cumsum(first) - 1]
            take = pa.array(order)
            cols = [rows.field(c).take(take) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(b.column(0)[k].as_py() << 24 | bins), pa.array(ends - length - base)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def evolved(sizes: DataFrame, n_blocks: int, capacity: int = CAPACITY, trace: list[DataFrame] | None = None) -> DataFrame:
    """sizes: block, lengths. The bins (labels) of each block; states after each epoch are appended to trace and kept, if given."""
    islands = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    first = F.struct(F.col("n_bins"), F.col("island"))
    state, over = None, []
    tasks = max(1, min(MOST_TASKS, n_blocks * ISLANDS))
    for epoch in range(EPOCHS):
        if state is None:
            met = islands.withColumn("population", F.lit(None).cast("array<binary>")).withColumn("guest", F.lit(None).cast("binary"))
        else:
            going = state.where("NOT over").drop("n_bins", "done", "over")
            guest = going.select(F.col("block").alias("g_block"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("g_island"), F.col("population")[0].alias("guest"))
            met = going.join(guest, (F.col("block") == F.col("g_block")) & (F.col("island") == F.col("g_island"))).join(sizes.withColumnRenamed("block", "s_block"), F.col("block") == F.col("s_block"))
        slot = F.pmod(F.col("block") * ISLANDS + F.col("island"), F.lit(tasks)).cast("int")
        dealt = met.select("block", "lengths", "island", "population", "guest").withColumn("slot", slot).repartitionById(tasks, "slot").drop("slot")
        after = settle(dealt.mapInArrow(_epoch(capacity, epoch), _STATE), "state")
        done = after.groupBy("block").agg(F.max("done").alias("over")).withColumnRenamed("block", "d_block")
        state = after.join(done, F.col("block") == F.col("d_block")).drop("d_block")
        if trace is not None:
            trace.append(after)
        last = state if epoch == EPOCHS - 1 else state.where("over")
        over.append(last.groupBy("block").agg(F.min_by(F.col("population")[0], first).alias("labels"), F.min("n_bins").alias("n_bins")))
        if epoch < EPOCHS - 1 and state.where("NOT over").isEmpty():
            break
    best = functools.reduce(DataFrame.unionByName, over)
    met = best.join(sizes.withColumnRenamed("block", "s_block"), F.col("block") == F.col("s_block")).select("block", "lengths", "labels", "n_bins")
    return met.mapInArrow(_decreasing(capacity), "block long, labels binary")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = settle(pieces(docs, tokenizer_path, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = made.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < capacity)
    n = max(1, math.ceil(rest.count() / block))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n)))
    row = F.struct("uid", "doc_id", "piece", "start", "length", "ids_crc32")
    blocks = settle(dealt.groupBy("block").agg(F.array_sort(F.collect_list(row)).alias("pieces")), "blocks")
    sizes = settle(blocks.select("block", F.col("pieces.length").alias("lengths")), "sizes")
    best = settle(evolved(sizes, n, capacity), "bins")
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = blocks.join(best.withColumnRenamed("block", "b_block"), blocks["block"] == F.col("b_block")).select("block", "pieces", "labels").mapInArrow(_placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(placed)
