"""Vector bin packing of tokenised examples into training sequences.

A sequence has several limits at once: tokens, segments (pieces) and
loss-bearing tokens.  The packer opens one sequence at a time and fills it
from a buffer of waiting pieces with the dot-product heuristic: of the pieces
that fit under every limit, the one whose demand has the largest dot product
with what is left of the limits (each limit weighted by how scarce it is in
the buffer) goes in.  When nothing fits and cutting is allowed, a piece is cut
to fill the rest.  Each task packs its own rows: nothing is shuffled, a task
holds one buffer, and only its last sequence can be short; that one is cut
into powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import for_python, query, read, trimmed

#: Words whose ids a Python worker remembers: the first that it meets in two
#: batches.  About 200 bytes each.
CACHE_WORDS = 250_000
#: Places (of a byte) that tell, by hash, a word met before from a new one.
MET_PLACES = 1 << 23
#: Rows and bytes of texts whose words are looked up together.
MERGED_ROWS, MERGED_BYTES = 2048, 1 << 24
#: Pieces that wait in a task's buffer.
BUFFER = 1024
_CACHE: dict[str, tuple] = {}
#: Marks at the end of a word, after a letter: a token or tokens of their own.
_MARKS = re.compile(rb"(?<=[a-z])[!#$%&()*+,./:;=?@\[\]^_`{}~\\-]+(?![^\x20\x09-\x0d])")


class WordTokens:
    """Ids (as little-endian unsigned 32-bit bytes) by a tokenizer that drops
    white space and marks the last piece of a word, so that a text's ids are
    its words' ids one after another: each word is encoded once and looked up
    after that."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _CACHE:
            from tokenizers import Tokenizer
            t = Tokenizer.from_file(path)
            last = np.zeros(t.get_vocab_size(), bool)
            for piece, i in t.get_vocab().items():
                last[i] = piece.endswith("</w>")
            _CACHE[path] = t, t.normalizer, last, {}, {}, bytearray(MET_PLACES)
        self.tokenizer, self.normalizer, self.last, self.known, self.parted, self.met = _CACHE[path]

    def _parts(self, letter: str) -> bool:
        """Whether a comma or full stop after this letter is a token of its
        own; not so if its lower-case or composed form ends in a mark."""
        if letter.isascii():
            return True
        if letter not in self.parted:
            x, y, z, xy, xz = self._each([letter, ",", ".", letter + ",", letter + "."])
            self.parted[letter] = xy == x + y and xz == x + z
        return self.parted[letter]

    def _each(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _letters(self, words: list[bytes], normalizer) -> list[bytes]:
        """Words of letters alone, encoded together and parted at last pieces."""
        self.tokenizer.normalizer = normalizer
        text = b" ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        self.tokenizer.normalizer = self.normalizer
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return self._each([w.decode() for w in words])
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts)]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words not known yet; remembered, while there is room, if
        met before."""
        known, out = self.known, {}
        # a comma or full stop after a letter is a token of its own, as a rule
        marked = [w for w in words if len(w) > 1 and w[-1] in b".," and (c := w[:-1].decode()[-1]).isalpha()
                  and self._parts(c)]
        whole = words.difference(marked)
        whole.update(w[:-1] for w in marked)
        whole.update({b".", b","} if marked else ())
        whole = [w for w in whole if w not in known]
        ascii_ = [w for w in whole if w.isalpha()]
        other = [w for w in whole if not w.isascii() and w.decode().isalpha()]
        # a-z are left as they are by the normalizer: do without it
        for plain, normalizer in ((ascii_, None), (other, self.normalizer)):
            for k in range(0, len(plain), 4096):
                out.update(zip(plain[k:k + 4096], self._letters(plain[k:k + 4096], normalizer)))
        rest = [w for w in whole if w not in out]
        out.update(zip(rest, self._each([w.decode() for w in rest])))
        met, mask = self.met, MET_PLACES - 1
        for w in out if len(known) < CACHE_WORDS else ():
            at = hash(w) & mask
            if met[at]:
                known[w] = out[w]
            else:
                met[at] = 1
        # the marked ones are put together from what is remembered of their parts
        for w in marked:
            x, y = w[:-1], w[-1:]
            out[w] = (known[x] if x in known else out[x]) + (known[y] if y in known else out[y])
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        # "<|" may name a special token, which is matched before letters are folded
        marked = [None if "<|" in t else _MARKS.sub(rb" \g<0>", t.encode().lower()) for t in texts]
        here: set[bytes] = set()
        for x in marked:
            if x is not None:
                here.update(x.split())
        # a table of these texts' words: small enough for a processor's cache
        table = dict(zip(here, map(self.known.get, here)))
        new = {w for w, ids in table.items() if ids is None}
        if new:
            learnt = self._learn(new)
            table.update(zip(new, map(learnt.__getitem__, new)))
        # split once more rather than hold all words of all texts
        return [self._each([t])[0] if x is None else b"".join(map(table.__getitem__, x.split()))
                for t, x in zip(texts, marked)]


def merged(batches):
    """Record batches put together up to MERGED_ROWS rows or MERGED_BYTES: the
    more texts at once, the fewer words are looked up apart."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= MERGED_ROWS or sum(x.nbytes for x in held) >= MERGED_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Packer:
    """Pieces are (key, start, ids, loss, total): `ids` bytes of 4 an id,
    `loss` the loss-bearing ones as bytes of 0 and 1, or None for all."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, first_id: int):
        self.limits = np.array(limits, np.float64)
        self.cut, self.next = cut, first_id
        self.pieces: list = [None] * (2 * BUFFER)
        self.demand = np.zeros((2 * BUFFER, 3))
        self.n = 0
        self.out: list[tuple] = []

    def _demand(self, piece):
        _, _, ids, loss, _ = piece
        n = len(ids) // 4
        return n, 1, n if loss is None else loss.count(1)

    def _part(self, piece, lo, hi):
        key, start, ids, loss, total = piece
        return key, start + lo, ids[4 * lo:4 * hi], None if loss is None else loss[lo:hi], total

    def _push(self, piece):
        if self.n == len(self.pieces):
            self.pieces += [None] * BUFFER
            self.demand = np.vstack([self.demand, np.zeros((BUFFER, 3))])
        self.pieces[self.n], self.demand[self.n] = piece, self._demand(piece)
        self.n += 1

    def _pop(self, i):
        piece = self.pieces[i]
        self.n -= 1
        self.pieces[i], self.demand[i] = self.pieces[self.n], self.demand[self.n]
        self.pieces[self.n] = None
        return piece

    def _fits(self, piece, left) -> int:
        """The longest start of a piece that is within all limits."""
        n = int(min(len(piece[2]) // 4, left[0]))
        if left[1] < 1:
            return 0
        if piece[3] is None:
            return int(min(n, left[2]))
        at = np.flatnonzero(np.frombuffer(piece[3], np.uint8)[:n])
        return n if len(at) <= left[2] else int(at[int(left[2])])

    def add(self, key, ids: bytes, loss: bytes | None = None):
        piece = key, 0, ids, loss, len(ids) // 4
        if self.cut:
            while (n := self._fits(piece, self.limits)) < len(piece[2]) // 4:
                self._emit([self._part(piece, 0, n)])
                piece = self._part(piece, n, len(piece[2]) // 4)
        elif any(d > m for d, m in zip(self._demand(piece), self.limits)):
            raise ValueError(f"example {key!r} is beyond the limits and may not be cut")
        self._push(piece)
        while self.n >= BUFFER:
            self._fill()

    def _fill(self):
        left, taken = self.limits.copy(), []
        scarce = self.demand[:self.n].sum(axis=0) / self.limits
        weight = scarce / scarce.sum() / self.limits**2
        while self.n:
            d = self.demand[:self.n]
            ok = (d <= left).all(axis=1)
            if not ok.any():
                break
            score = np.where(ok, d @ (left * weight), -1.0)
            i = int(score.argmax())
            left -= d[i]
            taken.append(self._pop(i))
        if self.cut and self.n and left[0] >= 1:
            i = int(self.demand[:self.n, 0].argmax())
            n = self._fits(self.pieces[i], left)
            if n:
                piece = self._pop(i)
                taken.append(self._part(piece, 0, n))
                self._push(self._part(piece, n, len(piece[2]) // 4))
        self._close(taken)

    def _close(self, taken):
        """Out with a sequence; a short one as powers of two if it may be cut."""
        size = sum(len(p[2]) // 4 for p in taken)
        while self.cut and 0 < size < self.limits[0] and size & (size - 1):
            want = 1 << (size.bit_length() - 1)
            now, rest, n = [], [], 0
            for p in taken:
                m = min(len(p[2]) // 4, want - n)
                if m:
                    now.append(self._part(p, 0, m))
                if m < len(p[2]) // 4:
                    rest.append(self._part(p, m, len(p[2]) // 4))
                n += m
            self._emit(now)
            taken, size = rest, size - want
        self._emit(taken)

    def _emit(self, taken):
        at = 0
        for key, start, ids, loss, total in taken:
            n = len(ids) // 4
            self.out.append((key, start, n, zlib.crc32(ids), n if loss is None else loss.count(1), total,
                             self.next, at))
            at += n
        if taken:
            self.next += 1

    def finish(self):
        while self.n:
            self._fill()


_SCHEMA = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("n_loss", pa.int64()), ("total", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = ("key long, start long, length long, ids_crc32 long, n_loss long, total long, sequence_id long, offset long")


def _packed(rows: DataFrame, examples, limits, cut: bool) -> DataFrame:
    """`examples(batch)` gives (key, ids, loss) of the rows of a batch."""
    def run(batches):
        packer = Packer(limits, cut, TaskContext.get().partitionId() << 33)

        def rows_out():
            cols, packer.out = list(zip(*packer.out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types)], schema=_SCHEMA)

        for b in merged(batches):
            for key, ids, loss in examples(b):
                packer.add(key, ids, loss)
                if len(packer.out) >= 20_000:
                    yield rows_out()
        packer.finish()
        if packer.out:
            yield rows_out()

    return for_python(rows).mapInArrow(trimmed(run), _DDL)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tokens: int = 4096, segments: int = 512,
                   loss_tokens: int | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    n_loss), one row for each piece; every id of a document, its end id
    included, bears loss and lies in exactly one piece.

    `tokenizer`: path of a tokenizers file that drops white space.  A null or
    empty text is its end id alone.  Repeated rows and null ids are packed as
    rows of their own; an empty table gives no rows.
    """
    end = np.array([end_id], "<u4").tobytes()

    def examples(b):
        texts = [t or "" for t in b.column("text").to_pylist()]
        for key, ids in zip(b.column("doc_id").to_pylist(), WordTokens(tokenizer)(texts)):
            yield key, ids + end, None

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _packed(rows, examples, (tokens, segments, loss_tokens or tokens), True)
    return out.select(F.col("key").alias("doc_id"), "start", "length", "ids_crc32", F.col("total").alias("doc_tokens"),
                      "sequence_id", "offset", "n_loss")


def pack_conversations(turns: DataFrame, tokenizer: str, end_id: int = 2, tokens: int = 4096, segments: int = 64,
                       loss_tokens: int = 2048, roles: tuple[str, ...] = ("assistant",), cut: bool = True) -> DataFrame:
    """Instruction data: a conversation (conv_id, turn, role, text) is an
    example, each turn followed by the end id; only turns of `roles` bear
    loss.  With `cut` false an example beyond a limit raises ValueError.

    Turns are gathered for each conversation (a conversation is one example
    and is held whole); a null turn sorts first, a null text is empty, a null
    role bears no loss, and turns without conv_id are one conversation.
    """
    end = np.array([end_id], "<u4").tobytes()

    def examples(b):
        encode = WordTokens(tokenizer)
        for key, parts in zip(b.column("conv_id").to_pylist(), b.column("parts").to_pylist()):
            ids, loss = [], []
            for p, x in zip(parts, encode([p["text"] or "" for p in parts])):
                x += end
                ids.append(x)
                loss.append(bytes([p["role"] in roles]) * (len(x) // 4))
            yield key, b"".join(ids), b"".join(loss)

    rows = (turns.groupBy(F.col("conv_id").cast("long").alias("conv_id"))
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("parts")))
    out = _packed(rows, examples, (tokens, segments, loss_tokens), cut)
    return out.select(F.col("key").alias("conv_id"), "start", "length", "ids_crc32",
                      F.col("total").alias("conv_tokens"), "sequence_id", "offset", "n_loss")


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), word_tokenizer())
