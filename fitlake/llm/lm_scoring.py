"""Language-model scores: marginal probability over all segmentations.

A word's subword probability is the sum over all ways to cut it into pieces of
a public vocabulary, by forward recursion in log space over the lattice of
pieces (all single bytes are pieces, so that nothing has probability 0).  The
vocabulary's own scores (ranks) give the first piece probabilities; `PASSES`
passes of expectation over all distinct training words then weight them.

A word seen in training has one more path through the lattice, the whole word:
with count c, N training tokens and V distinct ones

    P(w) = (max(c - D, 0) + (D V + 1) S(w)) / (N + 1)

with S the subword probability and D the discount; its mass is what the
discounted counts leave over.  A text's score is the sum of log10 P over its
words and its end.

Word counts, piece weights and word probabilities are distributed tables over
the whole corpus.  To score, documents are dealt into blocks of about
BLOCK_BYTES; a block asks for each of its distinct words once, by position in
its sorted word list, and gets the values back by that position, so that
neither a common word nor a long text makes a hot task and no pair of document
and word is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import for_python, query, read, stored

#: Discount, passes over the training words, prior share of the end.
DISCOUNT, PASSES, END_SHARE = 0.75, 2, 1e-3
#: Bytes of text of a block; words of a lattice batch.
BLOCK_BYTES, WORDS = 16 << 20, 16384
#: Distinct words a task counts before it passes them on.
COUNTED = 200_000
END = b""


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The distinct surface strings of a sentencepiece vocabulary (the mark of
    a word's start removed) and all single bytes, with log probabilities from
    the vocabulary's scores: 1 / (10 - score), normalised."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([i]): 1e-3 for i in range(256)}
    for i in range(m.get_piece_size()):
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i):
            continue
        p = m.id_to_piece(i).lstrip("▁").encode()
        if p:
            weight[p] = weight.get(p, 0.0) + 1.0 / (10.0 - m.get_score(i))
    w = np.array(list(weight.values()))
    return list(weight), np.log(w / w.sum())


class Lattice:
    """All segmentations of words by the pieces, many words at a time."""

    def __init__(self, pieces: list[bytes]):
        rng = np.random.default_rng(7)
        self.byte = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inv = np.uint64(pow(int(self.base), -1, 2**64))
        h = np.zeros(len(pieces), np.uint64)
        self.lengths = sorted({len(p) for p in pieces}, reverse=True)  # all arcs there are
        for n in self.lengths:
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            x = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(-1, n)
            h[own] = self._sums(x)[:, -1]
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces have one hash")
        # two tables of places; what collides in the first is in the second
        self.hash = np.concatenate([h, [np.uint64(0)]])
        self.t1, self.t2 = np.full(1 << 20, len(h), np.int32), np.full(1 << 16, len(h), np.int32)
        a = self._place(h, 44)
        _, first = np.unique(a, return_index=True)
        self.t1[a[first]] = first
        rest = np.setdiff1d(np.arange(len(h)), first)
        b = self._place(h[rest] ^ np.uint64(0x5555), 48)
        if len(np.unique(b)) != len(b):
            order = np.argsort(b, kind="stable")
            self.odd = {int(h[rest[i]]): int(rest[i]) for i in order}
        else:
            self.odd = {}
        self.t2[b] = rest
        self.n = len(h)

    @staticmethod
    def _place(h, shift):
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(shift)).astype(np.int64)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        powers = np.full(x.shape[1], self.base, np.uint64)
        powers[:1] = 1
        return np.cumsum(self.byte[x] * np.cumprod(powers), axis=1, dtype=np.uint64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, n if there is none."""
        i = self.t1[self._place(h, 44)]
        other = self.hash[i] != h
        # an empty place: no piece; one that another piece has: look further
        miss = np.flatnonzero(other & (i != self.n))
        i[other] = self.n
        if len(miss):
            j = self.t2[self._place(h[miss] ^ np.uint64(0x5555), 48)]
            j[self.hash[j] != h[miss]] = self.n
            if self.odd:
                for k in np.flatnonzero(j == self.n):
                    j[k] = self.odd.get(int(h[miss[k]]), self.n)
            i[miss] = j
        return i

    def _arcs(self, x: np.ndarray):
        """(end, [(start, piece)]) for words of one length, end by end."""
        n, size = x.shape
        sums = np.concatenate([np.zeros((n, 1), np.uint64), self._sums(x)], axis=1)
        inv = np.full(size, self.inv, np.uint64)
        inv[:1] = 1
        inv = np.cumprod(inv)
        for j in range(1, size + 1):
            yield j, [(i, self._find((sums[:, j] - sums[:, i]) * inv[i])) for i in (j - k for k in self.lengths if k <= j)]

    def forward(self, x: np.ndarray, logp: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log probabilities of all starts of the words: [n, length + 1]."""
        lp = np.append(logp, -np.inf)
        a = np.full((x.shape[0], x.shape[1] + 1), -np.inf)
        a[:, 0] = 0.0
        for j, arcs in self._arcs(x):
            terms = np.stack([a[:, i] + lp[p] for i, p in arcs])
            top = terms.max(axis=0)
            low = np.where(np.isneginf(top), 0.0, top)  # nothing ends here
            with np.errstate(divide="ignore"):
                a[:, j] = low + np.log(np.exp(terms - low).sum(axis=0))
            if keep is not None:
                keep.append((j, arcs))
        return a

    def expect(self, x: np.ndarray, logp: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected number of uses of each piece."""
        lp, keep = np.append(logp, -np.inf), []
        a = self.forward(x, logp, keep)
        b = np.full_like(a, -np.inf)
        b[:, -1] = 0.0
        z = a[:, -1]
        for j, arcs in reversed(keep):
            for i, p in arcs:
                t = lp[p] + b[:, j]
                counts += np.bincount(p, np.exp(a[:, i] + t - z), minlength=self.n + 1)[:self.n]
                b[:, i] = np.logaddexp(b[:, i], t)


def by_length(words: list[bytes]):
    """(rows, matrix of bytes) of the words of each length, in parts."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for rows in np.split(order, cuts):
        n = int(size[rows[0]]) if len(rows) else 0
        if n:
            step = max(1, (WORDS * 16) // n)
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                yield part, np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8).reshape(-1, n)


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z folded, as bytes."""
    return text.encode().lower().split() if text else []


def _large(batches, column: str = "token"):
    """Batches joined to about WORDS rows, as lists."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= WORDS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, c): counts in the training texts of all words of all texts
    (0 for those of held-out texts alone) and of the end, an empty token."""
    def run(batches):
        seen: Counter = Counter()

        def out():
            t = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())],
                                           names=["token", "c"])
            seen.clear()
            return t

        for b in batches:
            for text, held in zip(b.column("text"), b.column("held_out").to_pylist()):
                ws = text_words(text.as_py())
                if held:
                    seen.update(dict.fromkeys([w for w in set(ws) if w not in seen], 0))
                    seen.setdefault(END, 0)
                else:
                    seen.update(ws)
                    seen[END] += 1
            if len(seen) > COUNTED:
                yield out()
        if seen:
            yield out()

    return (for_python(docs.select("text", "held_out")).mapInArrow(run, "token binary, c long")
            .groupBy("token").agg(F.sum("c").alias("c")))


def _piece_weights(words: DataFrame, lattice, logp: np.ndarray, stop: float) -> tuple[np.ndarray, float]:
    """One pass of expectation over the distinct words: new log probabilities
    and stop probability.  One row a piece and task is summed."""
    given = words.sparkSession.sparkContext.broadcast((lattice, logp))

    def run(batches):
        lattice, logp = given.value
        counts = np.zeros(lattice.n)
        n = 0
        for t in _large(batches):
            ws = t.column("token").to_pylist()
            n += len(ws)
            for _, x in by_length(ws):
                lattice.expect(x, logp, counts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()),
                                          pa.array(np.append(counts[used], float(n)))], names=["piece", "n"])

    rows = words.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros(lattice.n), 0.0
    for r in rows:  # a row for each piece
        if r["piece"] < 0:
            n = r["n"]
        else:
            counts[r["piece"]] = r["n"]
    if not n:
        return logp, stop
    counts += 0.01  # a piece that no word has used stays possible
    return np.log(counts / counts.sum()), min(0.9, n / counts.sum())


def _scored_words(counts: DataFrame, lattice, logp: np.ndarray, stop: float, total: int, distinct: int) -> DataFrame:
    """(token, known, base, model) of all words, logarithms to base 10."""
    given = counts.sparkSession.sparkContext.broadcast((lattice, logp))

    def run(batches):
        lattice, logp = given.value
        goes_on = logp + math.log1p(-stop)
        for t in _large(batches):
            ws, c = t.column("token").to_pylist(), t.column("c").to_numpy().astype(float)
            sub = np.full(len(ws), math.log(END_SHARE))  # the end's
            for rows, x in by_length(ws):
                sub[rows] = (lattice.forward(x, goes_on)[:, -1] + math.log(stop / (1 - stop)) + math.log1p(-END_SHARE))
            base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            rest = sub + math.log(DISCOUNT * distinct + 1)
            whole = np.full(len(ws), -np.inf)
            np.log(c - DISCOUNT, out=whole, where=c > DISCOUNT)
            model = (np.logaddexp(whole, rest) - math.log(total + 1)) / math.log(10)
            yield pa.RecordBatch.from_arrays([t.column("token").combine_chunks(), pa.array(c > 0), pa.array(base),
                                              pa.array(model)], names=["token", "known", "base", "model"])

    return counts.mapInArrow(run, "token binary, known boolean, base double, model double")


def _requests(key, t):
    ws = set()
    for x in t.column("text"):
        ws.update(text_words(x.as_py()))
    ws = [END, *sorted(ws)]
    return pa.table({"block": pa.array(np.full(len(ws), key[0].as_py(), np.int32)),
                     "place": pa.array(np.arange(len(ws), dtype=np.int32)), "token": pa.array(ws, pa.binary())})


def _answers(key, t, values):
    order = np.argsort(values.column("place").to_numpy())
    known, base, model = (values.column(c).to_numpy()[order] for c in ("known", "base", "model"))
    texts = [text_words(x.as_py()) for x in t.column("text")]
    ws = sorted(set().union(*texts))
    place = dict(zip(ws, range(1, len(ws) + 1)))
    out = []
    for text in texts:
        at = np.fromiter(map(place.__getitem__, text), np.int64, len(text))
        at = np.append(at, 0)
        out.append((len(at), int(known[at].sum()), float(base[at].sum()), float(model[at].sum())))
    cols = list(zip(*out)) if out else [(), (), (), ()]
    return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"),
                     "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()),
                     "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64())})


def scores(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score),
    one row for each row of `docs` (doc_id, text and any other columns).

    Held out: crc32 of the id's digits modulo 5 is 1; a null id counts as the
    empty string (0, training).  A null or empty text is its end alone.
    Repeated rows count and are scored each.  Without training texts the model
    is the subword one and the base that of an empty count.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held_out"))
    counts = stored(word_counts(rows), "words")
    known = counts.filter("c > 0")
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()

    pieces, logp = vocabulary(vocabulary_path)
    lattice, stop = Lattice(pieces), 0.3
    words = known.filter(F.octet_length("token") > 0).select("token")
    for _ in range(PASSES):
        logp, stop = _piece_weights(words, lattice, logp, stop)
    values = _scored_words(counts, lattice, logp, stop, total, distinct)

    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(n_bytes) // BLOCK_BYTES) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(_requests, "block int, place int, token binary")
    given = asked.join(values, "token").select("block", "place", "known", "base", "model")
    out = dealt.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(
        _answers, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      "base_score", "score")


def piece_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"), piece_vocabulary())
