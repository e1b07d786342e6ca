"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton is built of labelled text. A text is parsed greedily
into the longest phrases that occur in that text; phrases times log2(labelled characters)
over the characters parsed estimate the cross entropy, and the least estimate wins.

The automata become transition tables: dense ones over the letters of the language's own
sample, the smallest first until DENSE cells are taken, and sorted edges for the rest. All
letters of all samples count. Texts are cut into segments of SEGMENT
characters, so that all segments of a batch and all languages advance together, one table
lookup a character; where a phrase goes on from one segment to the next is put right
afterwards, so that the phrases are those of the whole text, however long.

Fitting uses a bounded sample: of each language SAMPLE_DOCS documents at most, dealt by hash
of doc_id, and SAMPLE_CHARS characters of them in all, ALL_CHARS over the number of languages
(2,000 at least) where that is less. A document gives one stretch of an eighth of these (1,000 characters
at least), which begins at a place in its whole text that the hash of its id picks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.llm.kernels import give_back, text_bytes
from agrolith.llm.shared import crc32_mod, documents, stored

SAMPLE_DOCS = 32
SAMPLE_CHARS = 24_000
#: Characters sampled of all languages together; with many languages each gets fewer.
ALL_CHARS = 1_000_000
SEGMENT = 512
BATCH_CHARS = 1 << 19
#: Cells of all dense tables, four bytes each.
DENSE = 1 << 25
UNKNOWN = "und"


class SuffixAutomaton:
    """States of all substrings of a symbol sequence: ``moves[state]`` maps symbol to state."""

    def __init__(self, symbols: list[int]) -> None:
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.moves) - 1

    def _extend(self, last: int, c: int) -> int:
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.moves[p]:
            self.moves[p][c] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.moves[p][c]
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self._new(self.length[p] + 1, dict(self.moves[q]), self.link[q])
        self.link[q] = self.link[new] = copy
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = copy
            p = self.link[p]
        return new


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class CrossParser:
    """Cross-parses batches of texts against labelled text of each language.

    Letters count in lower case; all else is a space. Symbols: 0 space, 1 a letter of no
    sample, 2 padding, then the letters of the samples.
    """

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        joined = {k: " ".join(v).lower() for k, v in samples.items()}
        letters = sorted({c for t in joined.values() for c in t if c.isalpha()})
        self.symbol = {c: i + 3 for i, c in enumerate(letters)}
        self.width = len(letters) + 3
        autos = {k: SuffixAutomaton([self.symbol.get(c, 0) for c in joined[k]]) for k in self.languages}
        own = {k: np.array(sorted(m for m in a.moves[0] if m > 2), np.int64) for k, a in autos.items()}
        cells = {k: (len(a.moves) + 1) * (len(own[k]) + 3) for k, a in autos.items()}
        rows, self.dense, self.starts, self.local, self.edges = [], [], [], [], {}
        self.bits = [math.log2(max(2, len(joined[k]))) for k in self.languages]
        base = 0
        for k in sorted(self.languages, key=lambda k: (cells[k], k)):
            auto, n = autos[k], len(autos[k].moves)  # state n: a phrase of one unseen letter ends here
            if base + cells[k] > DENSE:
                found = sorted((state * self.width + c, to) for state, moves in enumerate(auto.moves) for c, to in moves.items())
                root = np.full(self.width, n, np.int32)
                root[list(auto.moves[0])] = list(auto.moves[0].values())
                self.edges[self.languages.index(k)] = (np.array([e for e, _ in found], np.int64), np.array([t for _, t in found], np.int32), root, n)
                continue
            local = np.ones(self.width, np.int32)
            local[[0, 2]] = 0, 2
            local[own[k]] = np.arange(3, len(own[k]) + 3)
            width = len(own[k]) + 3
            at_root = np.full(width, ~(base + n * width), np.int64)
            for c, to in auto.moves[0].items():
                at_root[local[c]] = ~(base + to * width)
            table = np.tile(at_root, (n + 1, 1))
            for state, moves in enumerate(auto.moves):
                for c, to in moves.items():
                    table[state, local[c]] = base + to * width
            table[:, 2] = base + np.arange(n + 1) * width
            rows.append(table.astype(np.int32).ravel())
            self.dense.append(self.languages.index(k))
            self.starts.append(base + n * width)  # from there each symbol opens a phrase
            self.local.append(local)
            base += cells[k]
        self.table = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.local = np.stack(self.local) if rows else np.zeros((0, self.width), np.int32)
        self._of: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_of": None}

    def _symbols(self) -> np.ndarray:
        if self._of is None:
            self._of = _letters().astype(np.uint16 if self.width <= 1 << 16 else np.int32)
            for c, i in self.symbol.items():
                for v in {c, c.upper(), c.title()}:
                    if len(v) == 1:
                        self._of[ord(v)] = i
        return self._of

    def phrases(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each text (its symbols begin at ``at``), a row for each language."""
        length = np.diff(at)
        pieces = -(-length // SEGMENT)
        owner = np.repeat(np.arange(len(length)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = at[owner] + nth * SEGMENT
        left = np.minimum(SEGMENT, at[owner + 1] - start)
        out = np.zeros((len(self.languages), len(length)), np.int64)
        last = np.zeros(len(self.languages), np.int64)  # states at the end of the batch before
        step = max(1, BATCH_CHARS // SEGMENT)
        for lo in range(0, len(owner), step):
            s, n = start[lo : lo + step], left[lo : lo + step]
            order = np.argsort(-n, kind="stable")
            column = np.arange(SEGMENT, dtype=np.int64)[:, None]
            block = symbols[np.minimum(s[order][None, :] + column, len(symbols) - 1)]
            block[column >= n[order][None, :]] = 2
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            before = np.concatenate([[len(order)], place[:-1]])  # where the segment before each stands; that of the last batch comes at the end
            before = np.where(nth[lo : lo + step] > 0, before, -1)[order]
            n = n[order]
            active = np.searchsorted(-n, -np.arange(SEGMENT), "left")  # segments longer than the column
            state = np.repeat(np.array(self.starts, np.int32), len(n)).reshape(len(self.starts), len(n))
            opened = np.zeros((len(self.languages), SEGMENT, len(n)), bool)
            if self.dense:
                for i, m in enumerate(active.tolist()):
                    to = self.table.take(state[:, :m] + self.local.take(block[i, :m], axis=1))
                    broke = to >> 31
                    opened[self.dense, i, :m] = broke
                    state[:, :m] = to ^ broke
            groups = [(self.dense, state.astype(np.int64))] if self.dense else []
            groups += [([k], self._by_edges(k, block, active, opened[k])[None, :]) for k in self.edges]
            for ks, end in groups:
                seen = np.ascontiguousarray(opened[ks].transpose(1, 0, 2)).reshape(SEGMENT, -1)
                count, end = self._carried(ks, block, n, seen, np.concatenate([end, last[ks, None]], axis=1), before)
                last[ks] = end[:, place[-1]]
                for k, c in zip(ks, count, strict=True):
                    out[k] += np.bincount(owner[lo : lo + step][order], c, len(length)).astype(np.int64)
        return out

    def _step(self, ks: list[int], row: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after these symbols in the languages ``ks[row]``, and where the symbol opened a phrase."""
        if ks[0] not in self.edges:
            to = self.table.take(state + self.local[row, symbol])
            return np.where(to < 0, ~to, to), to < 0
        keys, ends, root, _ = self.edges[ks[0]]
        key = state * self.width + symbol
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        goes = keys[at] == key
        return np.where(goes, ends[at], root[symbol]).astype(np.int64), ~goes

    def _by_edges(self, k: int, block: np.ndarray, active: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """The states at the ends of the columns of ``block`` in a language without a dense table; notes where phrases open."""
        state = np.full(block.shape[1], self.edges[k][3], np.int64)
        for i, m in enumerate(active.tolist()):
            state[:m], opened[i, :m] = self._step([k], state[:m], state[:m], block[i, :m].astype(np.int64))
        return state

    def _carried(self, ks: list[int], block: np.ndarray, n: np.ndarray, opened: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each segment and the states at their ends when phrases go on from one segment to the next, a row for each language of ``ks``.

        Each segment has been parsed from a new phrase on. It is parsed again from the state
        in which the one before it ends, up to the first place where both parses open a
        phrase, as they agree from there. A segment without such a place ends in another
        state, with which the one after it is parsed again. ends has one more column than
        there are segments, for the state in which the batch before ended.
        """
        m = block.shape[1]
        row, column = np.divmod(np.arange(len(ks) * m), m)
        own = row * (m + 1) + column
        source = np.where(before[column] >= 0, row * (m + 1) + before[column], -1)
        total = np.add.reduce(opened.view(np.uint8), axis=0, dtype=np.uint16).astype(np.int64)
        state_of, count = ends.ravel().copy(), total.copy()
        fresh = state_of[own]
        todo = np.flatnonzero(source >= 0)
        while len(todo):
            state, found = state_of[source[todo]], np.zeros(len(todo), np.int64)  # found: phrases more than in the first parse
            live, shortest = np.arange(len(todo)), int(n[column[todo]].min())
            for i in range(SEGMENT):
                where = todo[live]
                if i >= shortest:
                    live = live[n[column[where]] > i]
                    where = todo[live]
                if not len(live):
                    break
                now, broke = self._step(ks, row[where], state[live], block[i, column[where]].astype(np.int64))
                state[live] = now
                old = opened[i, where]
                found[live] += broke.view(np.int8) - old.view(np.int8)
                met = broke & old
                if met.any():
                    state[live[met]] = fresh[where[met]]
                    live = live[~met]
            changed = own[todo[state != state_of[own[todo]]]]
            count[todo], state_of[own[todo]] = total[todo] + found, state
            todo = np.flatnonzero(np.isin(source, changed))
        return count.reshape(len(ks), m), state_of.reshape(len(ks), m + 1)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        raw, byte_at = text_bytes(column)
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at = begins[byte_at]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self._symbols()[points]
        lettered = np.concatenate([[0], np.cumsum(symbols > 0)])
        known = lettered[at[1:]] > lettered[at[:-1]]
        best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
        if self.languages and len(symbols):
            rate = self.phrases(symbols, at) * np.array(self.bits)[:, None]
            best = rate.argmin(0)
            if len(self.languages) > 1:
                two = np.partition(rate, 1, axis=0)[:2]
                score = np.where(two[1] > 0, 1 - two[0] / np.maximum(two[1], 1e-9), 0.0)
            else:
                score = np.ones(len(column))
        names = np.array([*self.languages, UNKNOWN], object)
        which = np.where(known & bool(self.languages), best, len(self.languages))
        return names[which].tolist(), np.where(which < len(self.languages), np.clip(score, 0, 1), 0.0)


def held_out(m: int = 3) -> Column:
    return F.coalesce(crc32_mod("doc_id", m) == 1, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> CrossParser:
    """Learn from documents with a lang that aren't held out, on the bounded sample above."""
    h = F.xxhash64("doc_id")
    chosen = docs.where("lang is not null and doc_id is not null").where(~held_out()).groupBy("lang", F.pmod(h, F.lit(sample_docs)).alias("slot")).agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(7))).alias("doc_id"))
    chosen = stored(chosen.select("lang", "doc_id", F.xxhash64("doc_id", F.lit(7)).alias("turn")), "language-sample")  # sample_docs a language
    ids = chosen.collect()
    if not ids:
        return CrossParser({})
    budget = min(sample_chars, max(2000, ALL_CHARS // len({r.lang for r in ids})))
    most = max(1000, budget // 8)
    wanted = chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"))
    begin = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.lit(1), F.length("text") - most + 1)).cast("int") + 1
    met = docs.select("doc_id", "lang", "text").join(F.broadcast(wanted), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")), "left_semi")
    texts = met.groupBy("doc_id", "lang").agg(F.max(F.substring("text", begin, F.lit(most))).alias("text")).collect()
    found = {(r.lang, r.doc_id): r.text or "" for r in texts}
    samples: dict[str, list[str]] = {}
    for r in sorted(ids, key=lambda r: (r.turn, r.doc_id)):
        part = samples.setdefault(r.lang, [])
        room = budget - sum(map(len, part))
        if room > 0 and (text := found.get((r.lang, r.doc_id))):
            part.append(text[:room])
    return CrossParser({k: v for k, v in samples.items() if v})


def predicted(docs: DataFrame, model: CrossParser, text: str = "text") -> Column:
    """A column struct(lang_pred, score) of the column ``text``; no other column is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts, lo = [pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))], 0
            _, at = text_bytes(column)
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20), "right")) - 1)
                names, score = shared.value.predict(column.slice(lo, hi - lo))
                parts.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"]))
                lo = hi
            yield pa.concat_arrays(parts)
        give_back()

    return parse.asNondeterministic()(F.col(text))  # so that a filter on it doesn't run it twice


def identify(docs: DataFrame, model: CrossParser | None = None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of ``docs``.

    Texts that are null or have no letter get ``und`` and score 0, and so do all texts if no
    language could be learned. Otherwise the score is 1 - best/second estimate: 0 for a tie,
    which goes to the language that sorts first. Repeated rows, a null doc_id (never held
    out) and other columns, whatever their names, change nothing; an empty table gives none.
    """
    model = model or fit(docs)
    return docs.select("doc_id", held_out().alias("held_out"), predicted(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
