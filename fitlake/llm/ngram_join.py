"""N-gram Jaccard join by prefix filtering, and the components of its links.

A text's set is its distinct word n-grams.  Two texts link when the Jaccard
similarity of their sets reaches the threshold.  The steps:

1. One pass over the texts gives every row its class (texts of equal word
   sequences; one node each) and set size, and counts all n-grams into a table
   of fixed size (`SKETCH` counters).  Collisions there only touch the order
   of n-grams, never the result.
2. A second pass orders each set rare-first and emits its prefix
   (n - ceil(t n) + 1 n-grams), once per node and task.
3. Prefix rows meet by n-gram, sorted by set size.  Each list of two or more
   nodes is linked as a star: every node with the list's smallest node that
   the length filter allows.  Star pairs that pass the positional and suffix
   filters (shared counts over classes of n-grams) are verified, once each:
   first by counts over as many classes as a set has n-grams, a sixteenth to an
   eighth of its size, then those left on the whole sets.
4. Lists whose nodes are not yet in one component are gone through again, one
   of those with the same nodes, cut into blocks, for pairs across components that the length, positional and
   suffix filters let through: first only each node's likeliest partner, which
   joins nearly all that belongs together, then every pair that is left.  A
   pair inside a component cannot change it, so none is missed and no group of
   copies is expanded into all pairs.
5. Components by alternating large and small stars, checkpointed.

Only bounded things reach the driver: the counter table (SKETCH bytes) and a
bit map of the nodes that need their sets (at most BITS positions), which
keeps other texts from being hashed again; an exact join follows it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm import base
from fitlake.llm.base import (for_python, mix, query, read, release, sequence_hash, shingle_hashes, text_blocks, trimmed,
                              word_hashes)
from fitlake.session import checkpoint_dir

#: Counters of the n-gram table, and in how many pieces it travels.
SKETCH, PIECES = 1 << 22, 64
#: Positions of the bit map of wanted nodes.
BITS = 1 << 22
#: Classes of the suffix filter's profile (a byte each).
CLASSES = 128
#: Counts of a class stop here (255: "or more").
FULL = 255
#: Counts of the finer classes, four bits each, stop here.
FINE_FULL = 15
#: Nodes of a list that meet in one task; longer lists go in pairs of blocks.
LIST_BLOCK = 512
#: Lists of a node, its first by n-gram, that go along with it to tell whether
#: a pair meets elsewhere too.
LEADS = 8
#: Links that one task thins to stars before components are searched.
FOREST_LINKS = 250_000


def stored(df: DataFrame, name: str) -> DataFrame:
    return base.stored(df, name, clear=True)


def _words(col):
    """(row, node, hashes of the words) of each text of a column."""
    for first, data, off in text_blocks(col):
        h, doc = word_hashes(data, off)
        at = np.searchsorted(doc, np.arange(len(off)))
        for r in range(len(off) - 1):
            own = h[at[r]:at[r + 1]]
            yield first + r, sequence_hash(own) if len(own) else None, own


def _need(n: int, pct: int) -> int:
    return (pct * n + 99) // 100


def _nodes(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, hash, node, n, profile) of the texts, and rows (piece,
    counts)."""
    def run(batches):
        table = np.zeros(SKETCH, np.uint32)
        seen: dict[int, tuple] = {}
        for b in batches:
            nodes, own = [], []
            for _, node, h in _words(b.column("text")):
                nodes.append(node)
                if node is None:
                    own.append((0, None))
                    continue
                if node not in seen:
                    s = np.unique(shingle_hashes(h, k))
                    place = (s % np.uint64(SKETCH)).astype(np.int64)
                    np.add.at(table, place, 1)
                    prof = np.bincount((s >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=CLASSES)
                    seen[node] = len(s), np.minimum(prof, FULL).astype(np.uint8).tobytes()
                own.append(seen[node])
            m = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("hash"), pa.array(nodes, pa.int64()), pa.array([x[0] for x in own], pa.int64()),
                 pa.array([x[1] for x in own], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if seen:
            cut = table.reshape(PIECES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(PIECES, pa.int64())] * 4 + [pa.nulls(PIECES, pa.binary()), pa.array(range(PIECES), pa.int32()),
                 pa.array([zlib.compress(x.tobytes(), 1) for x in cut])], names=names)

    names = ["doc_id", "hash", "node", "n", "profile", "piece", "counts"]
    return for_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"),
                                  "text")).mapInArrow(
        trimmed(run), "doc_id long, hash long, node long, n long, profile binary, piece int, counts binary")


def _ranks(counts: DataFrame) -> np.ndarray:
    """The summed counter table as one byte a counter, on a log scale."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, raw in zip(b.column("piece").to_pylist(), b.column("counts")):
                x = np.frombuffer(zlib.decompress(raw.as_py()), np.uint32).astype(np.uint64)
                total[piece] = total[piece] + x if piece in total else x
        for piece, x in total.items():
            rank = np.minimum(255, 10 * np.log2(1.0 + x)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([rank.tobytes()])],
                                             names=["piece", "rank"])

    rows = stored(counts.repartition(PIECES, "piece").mapInArrow(trimmed(run), "piece int, rank binary"), "ranks").collect()
    out = np.zeros((PIECES, SKETCH // PIECES), np.uint8)
    for r in rows:  # PIECES rows, SKETCH bytes together
        out[r["piece"]] = np.frombuffer(r["rank"], np.uint8)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, rank: np.ndarray, k: int, pct: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        table = shared.value
        seen: set[int] = set()
        for b in batches:
            out: list[tuple] = []
            rows = 0
            for _, node, h in _words(b.column("text")):
                if node is None or node in seen:
                    continue
                seen.add(node)
                s = np.unique(shingle_hashes(h, k))
                n = len(s)
                p = n - _need(n, pct) + 1
                first = s[np.lexsort((s, table[(s % np.uint64(SKETCH)).astype(np.int64)]))[:p]]
                out.append((first, node, n, p))
                rows += p
                if rows >= 200_000:
                    yield batch(out)
                    out, rows = [], 0
            if out:
                yield batch(out)

    def batch(out):
        p = [x[3] for x in out]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([x[0] for x in out]).view(np.int64)),
             pa.array(np.repeat(np.array([x[1] for x in out], np.int64), p)),
             pa.array(np.repeat(np.array([x[2] for x in out], np.int64), p) << 32
                      | np.concatenate([np.arange(x) for x in p]))],
            names=["token", "node", "size_at"])

    return for_python(docs.select("text")).mapInArrow(trimmed(run), "token long, node long, size_at long")


def _lists(prefixes: DataFrame, pct: int) -> DataFrame:
    """The rows of n-grams that two nodes or more have in their prefixes,
    each with its star's centre (a centre is its own), and whether the list
    has a third node: a list of two is nothing but its star."""
    names = ["token", "node", "size_at", "centre", "centre_size_at", "open"]

    def run(batches):
        token = centre = last = None
        centre_at = 0
        waits: list[tuple] = []  # the first rows of a list, until a third one comes
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(3)]
            same = np.zeros(len(cols[0]), bool)
            same[1:] = cols[0][1:] == cols[0][:-1]
            if len(same):
                same[0] = token is not None and cols[0][0] == token
            keep = same.copy()
            keep[:-1] |= same[1:]
            if len(keep):
                keep[-1] = True  # its list may go on in the next batch
            out: list[tuple] = []
            for t, node, at in zip(*(c[keep].tolist() for c in cols)):
                if t != token:
                    if len(waits) == 2:
                        out += [(*x, 0) for x in waits]
                    token, centre, centre_at, last = t, node, at, node
                    waits = [(t, node, at, node, at)]
                    continue
                if node == last:  # the same class from another task
                    continue
                last = node
                if 100 * (centre_at >> 32) < pct * (at >> 32):  # length filter
                    centre, centre_at = node, at
                row = (t, node, at, centre, centre_at)
                if len(waits) == 1:
                    waits.append(row)
                    continue
                if waits:
                    out += [(*x, 1) for x in waits]
                    waits = []
                out.append((*row, 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)
        if len(waits) == 2:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*[(*x, 0) for x in waits])], names=names)

    return (prefixes.repartition("token").sortWithinPartitions("token", "size_at", "node")
            .mapInArrow(trimmed(run), ", ".join(f"{n} long" for n in names)))


def _at(c: str):
    return F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))


def _size(c: str):
    return F.shiftright(F.col(c), 32)


def _wanted(docs: DataFrame, nodes: DataFrame, classes: DataFrame, k: int, brief) -> DataFrame:
    """(node, grams): `brief` of the sets of the given nodes, from the row with
    the class's smallest doc_id; the bit maps (by doc_id, before a text is
    hashed, and by node) let a few others through, and a repeated row may come
    from several tasks."""
    nodes = nodes.join(classes.select("node", "least"), "node")

    def bit_map(at):
        bits = np.zeros(BITS, bool)
        bits[at.distinct().toPandas()["b"].to_numpy(np.int64)] = True  # at most BITS integers
        return docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    of_id, own = _id_place("least"), F.col("node").bitwiseXOR(F.coalesce("least", F.lit(0)))
    rows_at = bit_map(nodes.select(of_id.alias("b")))
    nodes_at = bit_map(nodes.select(F.pmod(own, F.lit(BITS)).cast("int").alias("b")))

    def run(batches):
        first, second = (np.unpackbits(x.value).view(bool) for x in (rows_at, nodes_at))
        seen: set[int] = set()
        for b in batches:
            b = b.filter(pa.array(first[b.column("place").to_numpy()]))
            out = []
            ids = b.column("doc_id").to_pylist()
            for r, node, h in _words(b.column("text")):
                if node is not None and second[_place(node, ids[r])] and node not in seen:
                    seen.add(node)
                    out.append((node, brief(np.unique(shingle_hashes(h, k)))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())],
                    names=["node", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", _id_place("doc_id"))
    return for_python(rows).mapInArrow(trimmed(run), "node long, grams binary")


def _id_place(c: str):
    return F.pmod(F.xxhash64(F.coalesce(c, F.lit(0)).cast("long")), F.lit(BITS)).cast("int")


def _place(node: int, doc_id: int | None) -> int:
    return (node ^ (doc_id or 0)) % BITS


def _whole(s: np.ndarray) -> bytes:
    return s.tobytes()


def _linked(p, q, pct: int) -> bool:
    """Whether the whole sets reach the threshold."""
    p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= pct * (len(p) + len(q) - n)


def _fine(s: np.ndarray) -> bytes:
    """A set's size and its counts over classes, a power of two of them and at
    least as many as n-grams."""
    m = max(2, 1 << (len(s) - 1).bit_length())
    count = np.minimum(np.bincount((mix(s) & np.uint64(m - 1)).astype(np.int64), minlength=m), FINE_FULL).astype(np.uint8)
    return np.int64(len(s)).tobytes() + (count[::2] << 4 | count[1::2]).tobytes()


def _may_link(p, q, pct: int) -> bool:
    """Whether sets with these finer counts can reach the threshold; the counts
    of the larger number of classes are added up to those of the smaller."""
    both, counts = 0, []
    for x in (p, q):
        both += int(np.frombuffer(x, np.int64, 1)[0])
        c = np.frombuffer(x, np.uint8, offset=8)
        counts.append(np.stack([c >> 4, c & 15], axis=1).reshape(-1))
    m = min(len(c) for c in counts)
    least = np.minimum(*(np.minimum(c.reshape(-1, m).sum(axis=0, dtype=np.int64), FINE_FULL) for c in counts))
    return bool((least == FINE_FULL).any()) or int(least.sum()) * (100 + pct) >= pct * both


def _matrix(col, dtype, width: int) -> np.ndarray:
    """A column of binaries of one length as rows of a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)


def _most_shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The most n-grams that sets with these profiles can share."""
    least = np.minimum(p, q)
    return np.where((least == FULL).any(axis=-1), 1 << 60, least.sum(axis=-1, dtype=np.int64))


def _plausible(pairs: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                both = b.column("na").to_numpy() + b.column("nb").to_numpy()
                most = _most_shared(_matrix(b.column("pa"), np.uint8, CLASSES), _matrix(b.column("pb"), np.uint8, CLASSES))
                yield b.select(["a", "b"]).filter(pa.array(most * (100 + pct) >= pct * both))

    def side(x):
        return classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("profile").alias(f"p{x}"))

    return for_python(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")
                      ).mapInArrow(trimmed(run), "a long, b long")


def _forest(pairs) -> list[tuple[int, int]]:
    """(node, smallest node connected with it) of the nodes of some pairs."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in list(up) if top(x) != x]


def _pairs_out(pairs):
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _passing(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, brief, passes) -> DataFrame:
    """The pairs (a, b) of which `passes` holds for `brief` of both sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # one shuffle by node serves both joins
    sets = stored(_wanted(docs, nodes, classes, k, brief), "sets").dropDuplicates(["node"])

    def run(batches):
        for b in batches:
            keep = [i for i, (x, y) in enumerate(zip(b.column("ga"), b.column("gb"))) if passes(x.as_buffer(), y.as_buffer())]
            if keep:
                yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    return for_python(two.select("a", "b", "ga", "gb")).mapInArrow(trimmed(run), "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, pct: int) -> DataFrame:
    """Pairs (node, other) that connect the same nodes as those of the pairs
    (a, b) whose whole sets reach the threshold; only sets of pairs that the
    finer counts let through are sent whole."""
    def forest(batches):
        held: list = []
        for b in batches:
            held = _forest([*held, *zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
        yield _pairs_out(held)

    pairs = stored(pairs, "pairs")
    pairs = stored(_passing(docs, pairs, classes, k, _fine, lambda x, y: _may_link(x, y, pct)), "pairs")
    links = stored(_passing(docs, pairs, classes, k, _whole, lambda x, y: _linked(x, y, pct)), "links")
    few = -(-links.count() // FOREST_LINKS) or 1
    release(docs.sparkSession)
    return links.coalesce(few).mapInArrow(forest, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable.  Nodes without an
    edge are absent.  Alternating large and small stars; each round is
    checkpointed to the shared folder."""
    checkpoint_dir(edges.sparkSession)

    def star_min(e, by, other):
        m = e.groupBy(by).agg(F.min(other).alias("m"))
        return e.join(m, by)

    def mark(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        return tuple(r)

    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .filter("u <> v").distinct().checkpoint())
    was = mark(e)
    while was[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (star_min(both, "u", "v").filter("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct())
        s = star_min(large, "u", "v")
        small = (s.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(s.select("u", F.col("m").alias("v"))).distinct())
        e = small.checkpoint()
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _distinct(lists: DataFrame) -> DataFrame:
    """One list of all that hold the same nodes: nodes that link pass the
    filters in each list that they share."""
    of = lists.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                    F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    one = stored(of.groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token"), "tokens")
    return lists.join(one, "token", "left_semi")


def _rest(lists: DataFrame, roots: DataFrame, classes: DataFrame, pct: int, best: bool) -> DataFrame:
    """(token, a, b): candidate pairs across components that the filters let
    through; with `best` only each node's likeliest one (that may share the
    largest part) of each list and block, else each pair in the first list of
    those that both nodes' leads name."""
    leads = lists.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("token")), 1, 1 if best else LEADS).alias("lead"))
    known = (classes.join(leads, "node").join(roots, "node", "left")
             .select("node", F.coalesce("root", "node").alias("root"), "profile", "lead"))
    long_ = (lists.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > LIST_BLOCK)
             .select("token", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("blocks")))
    # the profiles come last, so that they move once
    rows = (lists.select("token", "node", "size_at").join(long_, "token", "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1))).join(known, "node")
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                    "own", "node", "size_at", "root", "profile", "lead"))

    def cell(token, g, sent):
        own, node, at, root, prof, lead = g
        n, pos = at >> 32, at & 0xFFFFFFFF
        if (root == root[0]).all():
            return
        prof = np.frombuffer(b"".join(prof), np.uint8).reshape(-1, CLASSES)
        # only lists before this one matter; what fills a row up is this one
        lead = np.array([(x + [token] * LEADS)[:LEADS] for x in lead])
        before = lead < token
        cross = len(np.unique(own)) > 1
        everyone = np.arange(len(node))
        for i in range(len(node) if best else len(node) - 1):
            j = everyone if best else everyone[i + 1:]
            ok = root[j] != root[i]
            if cross:
                ok &= own[j] != own[i]
            lo, hi = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
            ok &= 100 * lo >= pct * hi
            need = -(-pct * (n[j] + n[i]) // (100 + pct))
            ok &= np.minimum(pos[j], pos[i]) + np.minimum(n[j] - pos[j], n[i] - pos[i]) >= need
            j, need = j[ok], need[ok]
            if len(j):
                most = _most_shared(prof[j], prof[i])
                fit = most >= need
                if best and fit.any():
                    at = int(np.argmax(np.where(fit, most / need, 0.0)))
                    fit = np.arange(len(j)) == at
                elif fit.any():
                    j, fit = j[fit], np.ones(int(fit.sum()), bool)
                    for x in lead[i][before[i]]:
                        fit &= ~(lead[j] == x).any(axis=1)
                for o in node[j[fit]].tolist():
                    sent.add((token, min(o, int(node[i])), max(o, int(node[i]))))

    def run(batches):
        key, held, sent = None, [], set()

        def flush():
            if held and sum(len(x[0]) for x in held) > 1:
                cell(int(key[0]), [np.concatenate([x[c] for x in held]) if c < 4 else sum((x[c] for x in held), [])
                                  for c in range(6)], sent)

        for b in batches:
            c = [b.column(i).to_numpy() for i in range(3)]
            edge = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])) + 1
            cuts = [0, *edge.tolist(), b.num_rows]
            vals = [b.column(i).to_numpy() for i in range(3, 7)]
            prof, lead = b.column(7), b.column(8)
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                now = (c[0][lo], c[1][lo], c[2][lo])
                if now != key:
                    flush()
                    key, held = now, []
                held.append([v[lo:hi] for v in vals] + [prof[lo:hi].to_pylist(), lead[lo:hi].to_pylist()])
            if len(sent) > 100_000:
                yield out(sent)
                sent.clear()
        flush()
        if sent:
            yield out(sent)

    def out(sent):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sent)], names=["token", "a", "b"])

    return (for_python(rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y"))
            .mapInArrow(trimmed(run), "token long, a long, b long"))


def ngram_components(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of `docs`
    (doc_id, text and any other columns).

    component_id is the smallest doc_id reachable over links (pct: the least
    Jaccard similarity in per cent).  Equal word sequences always link.  A
    null or empty text has no n-gram, links with nothing and is its own
    component.  Rows that repeat a doc_id are rows of their own; a row with a
    null doc_id takes part but never names a component unless it is alone
    (then component_id is null).  An empty table gives no rows.  Nodes and
    n-grams are 64-bit hashes; two different ones agree with a probability of
    2**-64 a pair.
    """
    members, of = _rooted(docs, k, pct)
    return members.join(of, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _rooted(docs: DataFrame, k: int, pct: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash of the text, node, n) of each row; (node, root,
    component_id) of each node."""
    both = stored(_nodes(docs, k), "nodes")
    members = both.filter("piece IS NULL").select("doc_id", "hash", "node", "n")
    classes = stored(both.filter("piece IS NULL").filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("profile").alias("profile")), "classes")
    rank = _ranks(both.filter("piece IS NOT NULL").select("piece", "counts"))
    lists = stored(_lists(_prefixes(docs, rank, k, pct), pct), "lists")
    release(docs.sparkSession)

    need = F.ceil(F.lit(pct) * (_size("size_at") + _size("centre_size_at")) / F.lit(100 + pct))
    most = (F.least(_at("size_at"), _at("centre_size_at"))
            + F.least(_size("size_at") - _at("size_at"), _size("centre_size_at") - _at("centre_size_at")))
    stars = (lists.filter(F.col("node") != F.col("centre")).filter(most >= need)
             .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    links = stored(_verified(docs, _plausible(stars, classes, pct), classes, k, pct), "links")
    # lists without a pair that the filters let through are settled
    open_ = stored(_distinct(lists.filter("open = 1").select("token", "node", "size_at")), "lists")
    listed = stored(open_.select("node").distinct(), "nodes")
    held = stored(classes.join(listed, "node", "left_semi"), "classes")
    likely = stored(_rest(open_, components(links), held, pct, True), "pairs")
    links = links.union(stored(_verified(docs, likely.select("a", "b").distinct(), classes, k, pct), "links"))
    open_ = open_.join(likely.select("token").distinct(), "token", "left_semi")
    rest = _rest(open_, components(links), held, pct, False)
    links = links.union(stored(_verified(docs, rest.select("a", "b").distinct(), classes, k, pct), "links"))
    roots = components(links)

    rooted = (classes.select("node", "least").join(roots, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return members, rooted.join(named, "root").select("node", "root", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """`docs`, all columns, with one row of each component: of the rows with
    its smallest doc_id (null only if there is no other) the one with the
    smallest text, then the smallest by all columns as JSON.

    Rows without an n-gram link with nothing and all stay; so does every row
    that is alone in its component, whatever rows share its doc_id.  Rows are
    told apart by doc_id and hash of the text.
    """
    members, of = _rooted(docs, k, pct)
    rows = (members.filter("node IS NOT NULL").groupBy("node", "doc_id", "hash").agg(F.count(F.lit(1)).alias("rows"))
            .join(of, "node"))
    # stored: what leads a component goes back to the texts three times
    lead = stored(rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        "root", F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "rows"), "leaders")
    many = lead.groupBy("root").agg(F.sum("rows").alias("n")).filter("n > 1").select("root")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_key"),
                      F.xxhash64("text").alias("_own"), "text")
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))  # what has a node
    single = lead.join(many, "root", "left_anti").select("_id", "_hash")
    whole = own.filter(words).join(single, same, "left_semi").select("_row.*")
    best = (own.filter(words).join(lead.join(many, "root", "left_semi"), same).groupBy("root")
            .agg(F.min_by("_row", F.struct(F.col("_row.text"), F.to_json("_row"))).alias("_row")).select("_row.*"))
    return docs.filter(~words).unionByName(whole).unionByName(best)


#: DuckDB: all pairs that share an n-gram, then the components.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce((SELECT min(v) FROM reach r WHERE r.u = s.doc_id), s.doc_id)) AS component_id
FROM s
"""


@query("op4_ngram_jaccard_join", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"))
