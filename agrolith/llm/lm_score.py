"""Language-model scores from a log-frequency Bloom filter.

Counts are quantised on a grid: whole numbers first, then steps of RATIO; a count between
two grid values takes one of them by its hash, so that the quantised counts of many n-grams
add up as the counts do. The filter stores a grid place in unary digits: a pair (n-gram, j)
for each j up to its coarse digit, COARSE places each, and one for each step of its fine
digit. A probe asks for one digit after the other until a pair is missing. A pair's twelve
bits lie in three words of one block of 512 bits. Unigrams and bigrams share the filter; no n-gram is left out.

Texts become packets of PACKET tokens at most, stored as numbers of words. Tasks combine the
n-grams of a packet, their counts meet in parts of the hash range, and each part makes its
own stretch of the filter, BITS bits a pair. The stretches, with the exact counts of their
unigrams, are a stored table: the model.

A model of at most MOST_TOKENS training tokens, 66 MB by the bound stated there, is broadcast
to the workers, which probe it for their packets. A larger one can't be: then the task that
makes a stretch probes it for the n-grams that each packet has there, the digits
found go back to the packets, and just the stretches' measures are stored. The same probes meet the same bits, so that the size decides
no score, and work and shuffle are in proportion to the texts.

Scores: P(w | v) = (c(v, w) + MU P(w)) / (c(v) + MU + V f), P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
with counts from the filter, c(v, w) at most c(v) and c(w). f is the share of absent bigrams that the
filter takes for present, known from its bits; V f is what these add to the sum over all
words w, without which the probabilities of a context would add up to more than 1. Each text
ends with an end token, which also stands before its first word.

The base score takes the exact unigram counts that lie beside the stretches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.kernels import give_back, mix, text_bytes, word_hashes
from agrolith.llm.language_id import held_out
from agrolith.llm.shared import ROW, discard, documents, stored, with_rows

RATIO = 1.004
COARSE = 8
BITS = 24
BLOCK = 512
#: Training tokens of a model that is broadcast. A count has no more pairs than it counts, so that a token adds at most two
#: pairs of BITS bits and 16 bytes for the exact count of its word: 22 bytes, 66 MB in all.
MOST_TOKENS = 3_000_000
MU = 500.0
#: Tokens of a packet; a longer text is cut into several.
PACKET = 1 << 20
#: N-grams of a part of the hash range, as they come from the packets.
PART_GRAMS = 1 << 21
END = np.uint64(0x1D8E4E27C47D1200)
_U = np.uint64
_JOIN = _U(0x9FB21C651E98DF25)
_FINE = 1 << 20
_ZSTD = pa.Codec("zstd", compression_level=1)


def _grid() -> np.ndarray:
    g = [0, 1]
    while g[-1] < 1 << 62:
        g.append(max(g[-1] + 1, round(g[-1] * RATIO)))
    return np.array(g, np.float64)


#: The count that each grid place stands for; place 0 is an n-gram that isn't there.
GRID = _grid()


def places(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The grid place of each n-gram's count: that below it or that above it, by its hash, so that the mean is the count."""
    i = np.searchsorted(GRID, count, "right") - 1
    share = (count - GRID[i]) / (GRID[i + 1] - GRID[i])
    return i + ((mix(h ^ _U(0xA0761D6478BD642F)) >> _U(11)).astype(np.float64) / 2.0**53 < share)


class Filter:
    """Stretches of a blocked Bloom filter over (hash, digit) pairs, one for each of ``parts`` parts of the hash range.

    words: eight a block, those of part i from block ``begin[i]`` on; ``begin`` has parts + 1 entries.
    """

    def __init__(self, words: np.ndarray, begin: np.ndarray) -> None:
        self.words, self.begin = words, np.asarray(begin, np.int64)

    @staticmethod
    def bits(h: np.ndarray, digit: int, blocks: np.ndarray | int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of a pair: its block among ``blocks``, three words of it and the four bits to set in each.

        Each digit has a block of its own, so that frequent n-grams fill no block.
        """
        g = mix(h ^ _U(digit * 0xD6E8FEB86659FD93 % (1 << 64)))
        k = mix(g ^ _U(0x8CB92BA72F3D8DD7))
        one, low = _U(1), _U(0xFFFFFFFF)
        block = (((g & low) * np.asarray(blocks, np.uint64)) >> _U(32)).astype(np.int64)
        x = g >> _U(32)
        first = (x & _U(7)).astype(np.int64)
        words = [first, (first + 1 + ((x >> _U(3)) & _U(3)).astype(np.int64)) & 7, (first + 5 + ((x >> _U(5)) & one).astype(np.int64)) & 7]
        n = [(y >> _U(s)) & _U(63) for y, s in [(x, 6), (x, 12), *((k, s) for s in range(0, 60, 6))]]
        return block, words, [(one << n[i]) | (one << n[i + 1]) | (one << n[i + 2]) | (one << n[i + 3]) for i in (0, 4, 8)]

    def has(self, h: np.ndarray, begin: np.ndarray, size: np.ndarray, digit: int) -> np.ndarray:
        """The numbers of the n-grams, whose stretches have ``size`` blocks from ``begin`` on, that have this digit."""
        block, words, bits = self.bits(h, digit, size)
        at = 8 * (begin + block)
        left = np.flatnonzero((self.words[at + words[0]] & bits[0]) == bits[0])
        for w, b in zip(words[1:], bits[1:], strict=True):
            left = left[(self.words[at[left] + w[left]] & b[left]) == b[left]]
        return left

    def probe(self, h: np.ndarray) -> np.ndarray:
        """The grid place of each n-gram."""
        out = np.zeros(len(h), np.uint16)
        for lo in range(0, len(h), 1 << 15):
            x = h[lo : lo + (1 << 15)]
            part = part_of(x, len(self.begin) - 1)
            begin, size = self.begin[part], self.begin[part + 1] - self.begin[part]
            coarse, fine = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for digits, marks in ((range(1, len(GRID)), coarse), (range(_FINE + 1, _FINE + COARSE), fine)):
                left = np.arange(len(x)) if marks is coarse else np.flatnonzero(coarse)
                for d in digits:
                    left = left[self.has(x[left], begin[left], size[left], d)]
                    if not len(left):
                        break
                    marks[left] += 1
            out[lo : lo + (1 << 15)] = np.where(coarse > 0, (coarse - 1) * COARSE + 1 + fine, 0)
        return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def stretch(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The words of a part's stretch, which holds these n-grams."""
    i = places(h, count) - 1
    coarse, fine = i // COARSE + 1, i % COARSE
    blocks = max(1, -(-int(coarse.sum() + fine.sum()) * BITS // BLOCK))
    words = np.zeros(8 * blocks, np.uint64)
    for digit, marks in ((0, coarse), (_FINE, fine)):
        for j in range(1, int(marks.max(initial=0)) + 1):
            block, at, bits = Filter.bits(h[marks >= j], digit + j, blocks)
            for w, b in zip(at, bits, strict=True):
                np.bitwise_or.at(words, 8 * block + w, b)
    return words


def false_share(words: np.ndarray) -> float:
    """The share of absent n-grams that a stretch takes for present: its words' shares of set bits, four bits in three words."""
    if not len(words):
        return 0.0
    full = np.bitwise_count(words).astype(np.float64).reshape(-1, 8) / 64
    return float((np.mean(full**4, axis=1) ** 3).mean())


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text followed by END, and where each text's tokens begin. Their lowest 8 bits are 0."""
    h, at = word_hashes(column)
    h &= ~_U(0xFF)
    n = len(at) - 1
    out = np.empty(len(h) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[at[1:] + np.arange(n)] = True
    out[is_end] = END
    out[~is_end] = h
    return out, at + np.arange(n + 1)


def bigrams(t: np.ndarray) -> np.ndarray:
    """A hash for each token but the first with the one before it; its lowest 16 bits are 0, so that it packs well."""
    return mix(t[:-1] * _JOIN + t[1:]) & ~_U(0xFFFF)


def unigrams(words: np.ndarray) -> np.ndarray:
    """The words as n-grams of one; their lowest 8 bits are 0."""
    return mix(words) & ~_U(0xFF)


def squeeze(h: np.ndarray) -> bytes:
    """Sorted hashes as planes of the bytes of their differences, without planes of zeros at either end."""
    if not len(h):
        return b""
    gaps = np.diff(h, prepend=_U(0))
    first, gaps[0] = int(gaps[0]), _U(0)
    bytes_ = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    low = next((i for i in range(2) if bytes_[:, i].any()), 2)
    top = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([low, max(low + 1, top)]) + first.to_bytes(8, "little") + np.ascontiguousarray(bytes_[:, low : max(low + 1, top)].T).tobytes()


def spread(data) -> np.ndarray:
    """The hashes that ``squeeze`` packed."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    low, top = int(raw[0]), int(raw[1])
    planes = raw[10:].reshape(top - low, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, low:top] = planes.T
    gaps = gaps.view("<u8").ravel().astype(np.uint64)
    gaps[0] = int.from_bytes(raw[2:10].tobytes(), "little")
    return np.cumsum(gaps, dtype=np.uint64)


def pack(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes and counts; most counts are 1, so only the others are stored."""
    once = n == 1
    a = squeeze(h[once])
    b = squeeze(h[~once])
    return len(a).to_bytes(8, "little") + len(b).to_bytes(8, "little") + a + b + n[~once].astype("<u4").tobytes()


def unpack(data) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts in the order of the hashes."""
    raw = memoryview(data)
    a, b = (int.from_bytes(raw[i : i + 8], "little") for i in (0, 8))
    once, more = spread(raw[16 : 16 + a]), spread(raw[16 + a : 16 + a + b])
    h, n = np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), np.frombuffer(raw[16 + a + b :], "<u4").astype(np.int64)])
    order = np.argsort(h, kind="stable")
    return h[order], n[order]


def _summed(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


# packets


def _parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    _, at = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, column.slice(lo, hi - lo)
        lo = hi


_PACKET = "docs array<struct<row: bigint, n: bigint, train: boolean>>, n long, n_train long, words binary, seq binary"


def _packet(docs: list[tuple[int, int, bool]], t: np.ndarray) -> pa.RecordBatch:
    """A packet of the tokens ``t``, the first of which only stands before the others: its documents, its words by
    falling frequency, and each token's number among these."""
    code, words = pd.factorize(t)
    order = np.argsort(-np.bincount(code), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    planes = np.ascontiguousarray(rank[code].astype("<u4").view(np.uint8).reshape(-1, 4).T)
    kind = pa.list_(pa.struct([("row", pa.int64()), ("n", pa.int64()), ("train", pa.bool_())]))
    columns = [
        pa.array([[{"row": r, "n": k, "train": x} for r, k, x in docs]], kind), pa.array([len(t) - 1], pa.int64()), pa.array([sum(k for _, k, x in docs if x)], pa.int64()),
        pa.array([np.asarray(words, "<u8")[order].view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()], pa.binary()), pa.array([_ZSTD.compress(planes.tobytes(), asbytes=True)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["docs", "n", "n_train", "words", "seq"])


def _to_packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets of rows (row, train, text)."""
    docs: list[tuple[int, int, bool]] = []
    kept: list[np.ndarray] = [np.array([END])]
    held = 0
    for batch in batches:
        rows, train = batch.column("row").to_pylist(), batch.column("train").to_pylist()
        for lo, texts in _parts(batch.column("text")):
            t, at = tokens(texts)
            for i in range(len(texts)):
                a = at[i]
                while a < at[i + 1]:
                    b = min(at[i + 1], a + PACKET - held)
                    docs.append((rows[lo + i], int(b - a), train[lo + i]))
                    kept.append(t[a:b])
                    held += b - a
                    a = b
                    if held == PACKET:
                        yield _packet(docs, np.concatenate(kept))
                        docs, kept, held = [], [t[b - 1 : b]], 0
            kept = [np.concatenate(kept)]  # no views of a batch that has gone
    if docs:
        yield _packet(docs, np.concatenate(kept))
    give_back()


class Packet:
    """A stored packet of ``n`` tokens: the hashes of its words, the number of each token's word, and the hashes of its bigrams.

    The first of ``seq`` only stands before the others.
    """

    def __init__(self, words, seq, n: int) -> None:
        seven = np.zeros((len(words) // 7, 8), np.uint8)
        seven[:, 1:] = np.frombuffer(words, np.uint8).reshape(-1, 7)
        self.words = seven.view("<u8").ravel().astype(np.uint64)
        planes = np.frombuffer(_ZSTD.decompress(seq, 4 * n + 4), np.uint8).reshape(4, -1)
        self.seq = np.ascontiguousarray(planes.T).view("<u4").ravel()
        self.pairs = bigrams(self.words[self.seq])


def _edges(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's hashes begin among the sorted ``h``."""
    return np.searchsorted(part_of(h, parts), np.arange(parts + 1))


def _count(parts: int, every: bool):
    """The n-grams of each packet with their training counts, by part; with ``every`` also those that count 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not (every or row["n_train"]):
                    continue
                p = Packet(row["words"], row["seq"], row["n"])
                mine = np.repeat([d["train"] for d in row["docs"]], [d["n"] for d in row["docs"]])
                all_ = bool(mine.all())
                n = np.bincount(p.seq[1:] if all_ else p.seq[1:][mine], minlength=len(p.words))
                one = unigrams(p.words)
                order = np.argsort(one)
                pairs, m = np.unique(p.pairs if all_ else p.pairs[mine], return_counts=True)
                if every and not all_:
                    pairs, m = _summed([(pairs, m), (rest := np.unique(p.pairs[~mine]), np.zeros(len(rest), np.int64))])
                both = [(one[order], n[order]), (pairs, m)]
                if not every:
                    both[0] = tuple(x[n[order] > 0] for x in both[0])
                cuts = [_edges(h, parts) for h, _ in both]
                for lo in range(0, parts, 256):
                    rows = [(i, row["packet"], *(pack(h[c[i] : c[i + 1]], n[c[i] : c[i + 1]]) for (h, n), c in zip(both, cuts, strict=True))) for i in range(lo, min(parts, lo + 256)) if any(c[i] < c[i + 1] for c in cuts)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "packet", "ones", "pairs"])
        give_back()

    return count


_COUNTS = "part int, packet long, ones binary, pairs binary"
_PART = pa.schema([("part", pa.int32()), ("packet", pa.int64()), ("filter", pa.binary()), ("word", pa.binary()), ("times", pa.binary()), ("size", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("false", pa.float64()), ("own", pa.binary()), ("pair", pa.binary()), ("exact", pa.binary())])
_PART_DDL = "part int, packet long, filter binary, word binary, times binary, size long, v long, n long, d long, false double, own binary, pair binary, exact binary"


def _make(parts: int, answers: bool):
    """A part of the model from the counts of all packets, and with ``answers`` what its stretch says of each packet's n-grams."""

    def make(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        asked = {c: [unpack(b.as_buffer()) for b in group[c]] for c in ("ones", "pairs")}
        all_ = {c: _summed(x) for c, x in asked.items()}
        known = {c: (h[n > 0], n[n > 0]) for c, (h, n) in all_.items()}
        words = stretch(*(np.concatenate([known["ones"][i], known["pairs"][i]]) for i in (0, 1)))
        h, n = known["ones"]
        rows = [{"part": part, "filter": words.tobytes(), "word": h.tobytes(), "times": n.astype("<i8").tobytes(), "size": 8 * len(words), "v": len(h), "n": int(n.sum()), "d": len(known["pairs"][0]), "false": false_share(words)}]
        if answers:  # all that will be asked of the stretch is answered here, so it needn't be kept
            model = Model([dict(rows[0])], parts)
            rows[0] |= {"filter": None, "word": None, "times": None}
            found = {c: model.filter.probe(h) for c, (h, _) in all_.items()}
            for i, packet in enumerate(group["packet"].to_pylist()):
                at = {c: np.searchsorted(all_[c][0], asked[c][i][0]) for c in asked}
                said = {"own": found["ones"][at["ones"]].astype("<u2"), "pair": found["pairs"][at["pairs"]].astype("<u2"), "exact": all_["ones"][1][at["ones"]].astype("<i8")}
                rows.append({"part": part, "packet": packet} | {k: zlib.compress(x.tobytes(), 1) for k, x in said.items()})
        return pa.Table.from_pylist(rows, _PART)

    return make


class Model:
    """Some parts of a model in memory."""

    def __init__(self, rows: list, parts: int) -> None:
        """rows: struct(part, filter, word, times) of stored parts; parts that aren't among them are empty."""
        rows = sorted(rows, key=lambda r: r["part"])
        size = np.zeros(parts, np.int64)
        size[[r["part"] for r in rows]] = [len(r["filter"]) // 64 for r in rows]
        begin = np.concatenate([[0], np.cumsum(np.maximum(size, 1))])
        words = np.zeros(8 * begin[-1], np.uint64)
        for r in rows:
            words[8 * begin[r["part"]] :][: len(r["filter"]) // 8] = np.frombuffer(r["filter"], np.uint64)
        self.filter = Filter(words, begin)
        self.word = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["word"], np.uint64) for r in rows)])
        self.times = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["times"], "<i8") for r in rows)])

    def look(self, ones: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grid places of unigrams and of bigrams, and the exact counts of the unigrams."""
        i = np.minimum(np.searchsorted(self.word, ones), max(0, len(self.word) - 1))
        exact = np.where(self.word[i] == ones, self.times[i], 0) if len(self.word) else np.zeros(len(ones), np.int64)
        return self.filter.probe(ones), self.filter.probe(pairs), exact


def log_probability(own: np.ndarray, pair: np.ndarray, before: np.ndarray, n: int, v: int, false: float) -> np.ndarray:
    """log10 P(w | v) by the counts of w, of (v, w) and of v."""
    base = (own + 0.5) / (n + 0.5 * (v + 1))
    pair = np.minimum(pair, np.minimum(own, before))
    return np.log10((pair + MU * base) / (before + MU + np.where(before > 0, v * false, 0)))


def _score_packet(row: dict, look, n: int, v: int, false: float) -> pa.RecordBatch:
    """Of each document: what lies of it in this packet. look: gives what ``Model.look`` does for sorted n-grams."""
    p = Packet(row["words"], row["seq"], row["n"])
    one = unigrams(p.words)
    order = np.argsort(one)
    pairs, back = np.unique(p.pairs, return_inverse=True)
    own, pair, exact = look(one[order], pairs)
    count, times = np.empty(len(one)), np.empty(len(one), np.int64)
    count[order], times[order] = GRID[own], exact
    count = count[p.seq]
    score = log_probability(count[1:], GRID[pair][back], count[:-1], n, v, false)
    base = np.log10((times + 0.5) / (n + 0.5 * (v + 1)))[p.seq[1:]]
    size = np.array([d["n"] for d in row["docs"]], np.int64)
    begin = np.cumsum(size) - size
    sums = [np.add.reduceat(x, begin) for x in ((times > 0)[p.seq[1:]].astype(np.int64), base, score)]
    return pa.RecordBatch.from_arrays([pa.array([d["row"] for d in row["docs"]], pa.int64()), pa.array(size), *(pa.array(x) for x in sums)], ["row", "n_tokens", "n_known", "base_score", "score"])


_SCORED = "row long, n_tokens long, n_known long, base_score double, score double"


class Fitted:
    """A stored model; ``parts`` is the number of parts of the hash range, n and v count the tokens and words learned from,
    and ``false`` is the share of absent bigrams that it takes for present, by the filter's bits or by a hash of 48 bits."""

    def __init__(self, rows: DataFrame, parts: int) -> None:
        self.rows, self.parts = rows, parts
        size = F.col("size")
        s = rows.agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum(F.col("false") * size).alias("false"), F.sum(size).alias("bytes")).first()
        self.v, self.n = s["v"] or 0, s["n"] or 0
        self.false = (s["false"] / s["bytes"] if s["bytes"] else 0.0) + (s["d"] or 0) / 2.0**48


def packets(docs: DataFrame, train) -> DataFrame:
    """A stored table of packets of rows (row, text); train: a condition on their columns."""
    rows = docs.select("row", train.alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(_to_packets, _PACKET).withColumn("packet", F.monotonically_increasing_id()), "lm-packets")


def fit(made: DataFrame) -> Fitted:
    """Learn from the training tokens of a stored table of packets."""
    return _fit(made, False)[0]


def _fit(made: DataFrame, answers: bool) -> tuple[Fitted, DataFrame, DataFrame]:
    """The model, what it says of the packets' n-grams (by part and packet) if that is asked for, and the stored table of both."""
    n = made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-2 * n // PART_GRAMS))
    rows = stored(made.mapInArrow(_count(parts, answers), _COUNTS).groupBy("part").applyInArrow(_make(parts, answers), _PART_DDL), "lm-model")
    return Fitted(rows.where("packet is null"), parts), rows.where("packet is not null").select("packet", "part", "own", "pair", "exact"), rows


def _by_broadcast(made: DataFrame, fitted: Fitted) -> DataFrame:
    """Each worker probes the whole model."""
    model = Model(list(fitted.rows.select("part", "filter", "word", "times").toLocalIterator()), fitted.parts)
    shared = made.sparkSession.sparkContext.broadcast(model)
    n, v, false = fitted.n, fitted.v, fitted.false

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _score_packet(row, shared.value.look, n, v, false)
        give_back()

    return made.select("docs", "n", "words", "seq").mapInArrow(score_all, _SCORED)


def _by_parts(made: DataFrame, fitted: Fitted, answers: DataFrame) -> DataFrame:
    """Packets take what the parts have said of their n-grams, in the order of the hashes."""
    n, v, false = fitted.n, fitted.v, fitted.false
    lists = answers.groupBy("packet").agg(F.sort_array(F.collect_list(F.struct("part", "own", "pair", "exact"))).alias("found"))  # one for each part at most

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [np.concatenate([np.frombuffer(zlib.decompress(f[c]), k) for f in row["found"]]) for c, k in (("own", "<u2"), ("pair", "<u2"), ("exact", "<i8"))]
                yield _score_packet(row, lambda *_, found=found: found, n, v, false)
        give_back()

    return made.select("packet", "docs", "n", "words", "seq").join(lists, "packet").mapInArrow(score_all, _SCORED)


def score(docs: DataFrame, train=None) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    Null texts count as empty: their only token is the end. Texts of the rows that
    ``held_out(5)`` leaves (or of those where ``train`` holds) are learned from; a null doc_id is never
    held out. Repeated rows count each. Other columns are ignored; an empty table gives no
    rows, and with nothing to learn from all counts are 0.
    """
    keyed = with_rows(docs)
    made = packets(keyed.select(F.col(ROW).alias("row"), "doc_id", "text"), ~held_out(5) if train is None else train)
    large = made.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0] > MOST_TOKENS
    fitted, answers, table = _fit(made, large)
    pieces = _by_parts(made, fitted, answers) if large else _by_broadcast(made, fitted)
    sums = stored(pieces.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))), "lm-scores")
    n = fitted.n
    discard(made, table)
    out = keyed.select("doc_id", ROW).join(sums, F.col(ROW) == F.col("row"))
    return out.select("doc_id", held_out(5).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
