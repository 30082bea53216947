"""Near copies by a chosen-path similarity join over minwise tokens.

A document's set of word shingles is embedded in ``WIDTH`` minwise tokens; two sets agree in a
token with a chance equal to their Jaccard similarity. A tree branches its documents again and
again: a node chooses a few of the tokens (1 / threshold on average, so a similar pair is expected
to go on together), and each of its documents goes to one child per chosen token, by the value it
has there. Nodes of few documents are compared exhaustively, larger ones are compared with one
pivot and branched further; independent trees are grown until a pair at the threshold is found
with the wanted recall.

Only connectivity is asked for, so equal sets are one vertex, and a node hands on the likeliest
tree of its likely pairs, one pair less than it has documents. Those are confirmed on the full
sets, the likeliest of each document first. What stays unconnected within a cluster of likely
pairs is brought together once, set by set: documents outside the cluster's largest component are
compared with the others that sizes and an exact bound allow (shingles that no other document of
the cluster has count to no intersection), and only links leave the task. Tokens only propose;
every link is confirmed on the full sets of 64-bit shingle hashes.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import checkpointed, prepare, query, table, utf8, whole_text
from vigilog.llm.components import components

WIDTH = 128         # minwise tokens of a set that trees branch on
SHOWN = 384         # tokens, of which one bit is kept, that similarities are estimated by
TREES = 20          # independent trees
START_DEPTH = 2     # levels a tree is branched before nodes are looked at
SMALL = 4_096       # documents of a node that are compared exhaustively
SLACK = 0.15        # pairs whose bits put them below threshold - SLACK (4.9 standard deviations) are no candidates
TOGETHER = 32       # documents of a node up to which the nodes of a batch are compared side by side
HELD = 1 << 13      # rows of small nodes that a task looks at at a time
BLOCK_SHINGLES = 1 << 21  # of a block of a cluster; a cluster of up to two is compared in one task
PAIRWISE = 8        # members of a cluster that a document is compared with one by one
MARKS = 1 << 23     # bits that stand for the ids of wanted texts; 64 of them are a broadcast row

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = Hashes()  # of a Python worker, over all its batches


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct runs of ``size`` words; A-Z are lower-cased.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([_HASHES[w] for w in words], np.uint64)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * _MIX2 + h[k:len(h) - size + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return (rng.integers(1 << 32, size=SHOWN, dtype=np.uint32) | np.uint32(1),
            rng.integers(1 << 32, size=SHOWN, dtype=np.uint32))


def tokens(hashes: np.ndarray) -> np.ndarray:
    """The SHOWN minwise tokens of a set that is not empty."""
    a, b = _permutations()
    low = hashes.astype(np.uint32)
    out = np.full(SHOWN, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 512):
        out = np.minimum(out, (low[at:at + 512, None] * a + b).min(0))
    return out


@lru_cache(maxsize=4)
def paths(threshold: float) -> list[tuple[int, list[int]]]:
    """(tree, chosen tokens from the root down) for all nodes at START_DEPTH."""
    rng = np.random.default_rng(7)
    out = []
    for tree in range(TREES):
        level = [(tree, [])]
        for _ in range(START_DEPTH):
            level = [(tree, [*path, int(c)]) for _, path in level
                     for c in rng.choice(WIDTH, max(1, rng.poisson(1 / threshold)), replace=False)]
        out += level
    return out


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _embed(size: int):
    def embed(batches):
        for batch in batches:
            ns, keys, sigs, bits = [], [], [], []
            for text in utf8(batch["text"]):
                h = shingles(text, size)
                ns.append(len(h))
                keys.append(_digest(h))
                own = tokens(h) if len(h) else None
                sigs.append(None if own is None else own[:WIDTH].tobytes())
                bits.append(None if own is None else np.packbits((own >> np.uint32(7)) & np.uint32(1)).tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n_shingles": pa.array(ns, pa.int64()),
                **{c: pa.array([x[k] for x in keys], pa.int64()) for k, c in enumerate(("high", "low"))},
                "sig": pa.array(sigs, pa.binary()), "bits": pa.array(bits, pa.binary())})

    return embed


def _roots(threshold: float):
    """(node, v) rows of every set for every path."""
    def roots(batches):
        for batch in batches:
            sig = _matrix(batch["sig"])
            v = np.asarray(batch["v"])
            for tree, path in paths(threshold):
                key = np.full(len(v), tree + 1, np.uint64)
                for c in path:
                    key = _mix(key * _MIX1 + np.uint64(c)) + sig[:, c]
                yield pa.RecordBatch.from_pydict({"node": pa.array(_mix(key).view(np.int64)), "v": pa.array(v)})

    return roots


def _children(threshold: float):
    """(node, v) rows of the next level: what a node chooses, one token at least, follows from its
    key alone. With none for some, a pair at the threshold would be lost the deeper, the likelier."""
    def children(batches):
        for batch in batches:
            sig, v = _matrix(batch["sig"]), np.asarray(batch["v"])
            node = np.asarray(batch["node"]).view(np.uint64)
            below = np.uint64(int((1 << 64) / (threshold * WIDTH)))
            own = _mix(node[:, None] + _mix(np.arange(1, WIDTH + 1, dtype=np.uint64)))
            chosen = own < below
            chosen[np.arange(len(v)), own.argmin(1)] = True
            for c in range(WIDTH):
                goes = np.flatnonzero(chosen[:, c])
                key = _mix(_mix(own[goes, c] * _MIX1 + np.uint64(c)) + sig[goes, c])
                yield pa.RecordBatch.from_pydict({"node": pa.array(key.view(np.int64)), "v": pa.array(v[goes])})

    return children


def _matrix(sigs) -> np.ndarray:
    raw = b"".join(utf8(sigs))
    return np.frombuffer(raw, np.uint32).reshape(-1, WIDTH).astype(np.uint64)


def _words(bits) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(bits), -1)


def _most_apart(percent: int) -> int:
    """Differing bits up to which a pair is likely: they differ in half of the tokens that do."""
    return int(SHOWN * (1 - percent / 100 + SLACK) / 2)


@F.arrow_udf(T.IntegerType())
def _differ(left: pa.Array, right: pa.Array) -> pa.Array:
    if not len(left):
        return pa.array([], pa.int32())
    return pa.array(np.bitwise_count(_words(left) ^ _words(right)).sum(1, dtype=np.int32))


def _apart(bits: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(bits[i] ^ bits[j]).sum(-1, dtype=np.int16)


def _sized(n, i, j, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])


def _by_nodes(compare):
    """Hands whole nodes to ``compare`` (columns as arrays, start and size of each node): rows come
    in order of node, and a node has at most SMALL of them."""
    def nodes(batches):
        held, size = [], 0

        def ready(last: bool):
            nonlocal held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            node = rows["node"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            end = len(node) if last else int(starts[-1])  # the last node may go on
            rest = rows.slice(end)
            held, size = (rest.to_batches(), rest.num_rows) if rest.num_rows else ([], 0)
            starts = starts[starts < end]
            return rows.slice(0, end), starts, np.diff(np.append(starts, end))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                rows, starts, sizes = ready(False)
                if rows.num_rows:
                    yield from compare(rows, starts, sizes)
        if size:
            yield from compare(*ready(True))

    return nodes


def _close_pairs(bits, starts, sizes, allowed, most: int):
    """All (i, j) of the nodes of at most TOGETHER rows that are allowed and likely, and how far apart."""
    left = np.repeat(sizes - 1, sizes) - (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    place = np.repeat(starts, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    out = []
    for step in range(1, int(sizes.max(initial=1))):
        i = place[left >= step]
        j = i + step
        keep = allowed(i, j)
        i, j = i[keep], j[keep]
        far = _apart(bits, i, j)
        near = far <= most
        out.append((i[near], j[near], far[near]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3


def _likeliest_tree(bits, n, rows: np.ndarray, percent: int, most: int):
    """(i, j, differing bits) of a spanning forest of the likely pairs among ``rows``, by Prim: the
    likeliest pair that reaches another row is taken next."""
    own, sizes = bits[rows], n[rows]
    best = np.full(len(rows), SHOWN + 1, np.int16)
    parent = np.zeros(len(rows), np.int64)
    open_ = np.ones(len(rows), bool)
    for _ in range(len(rows)):
        at = int(np.where(open_, best, SHOWN + 2).argmin())
        if best[at] <= most:
            yield int(rows[parent[at]]), int(rows[at]), int(best[at])
        open_[at] = False
        far = np.bitwise_count(own ^ own[at]).sum(1, dtype=np.int16)
        nearer = open_ & (far < best) & (100 * np.minimum(sizes, sizes[at]) >= percent * np.maximum(sizes, sizes[at]))
        best[nearer], parent[nearer] = far[nearer], at


def _pairs_of(v: np.ndarray, i, j, far) -> pa.RecordBatch:
    a, b = v[np.asarray(i, np.int64)], v[np.asarray(j, np.int64)]
    return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()),
                                       "far": pa.array(np.asarray(far, np.int32), pa.int32())})


def _spanning(percent: int):
    """(a, b, far): of each node a spanning forest of its likely pairs."""
    most = _most_apart(percent)

    def compare(rows, starts, sizes):
        v, n, bits = rows["v"].to_numpy(), rows["n"].to_numpy(), _words(rows["bits"].combine_chunks())
        few = sizes <= TOGETHER
        i, j, far = _close_pairs(bits, starts[few], sizes[few], lambda i, j: _sized(n, i, j, percent), most)
        node = np.searchsorted(starts, i, "right")
        crowded = np.bincount(node, minlength=len(starts) + 1)[node] > 1
        out = [*zip(i[~crowded].tolist(), j[~crowded].tolist(), far[~crowded].tolist(), strict=True)]
        met = np.unique(np.concatenate([i[crowded], j[crowded]]))
        for rows_ in np.split(met, np.flatnonzero(np.diff(np.searchsorted(starts, met, "right"))) + 1):
            out += _likeliest_tree(bits, n, rows_, percent, most)
        for start, size in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
            out += _likeliest_tree(bits, n, np.arange(start, start + size), percent, most)
        if out:
            yield _pairs_of(v, *zip(*out, strict=True))

    return _by_nodes(compare)


def _possible(n, s, i, j, percent: int) -> np.ndarray:
    """Whether sets of ``n`` shingles, ``s`` of which others of the cluster have too, may be similar."""
    both = np.minimum(s[i], s[j])
    return 100 * both >= percent * (n[i] + n[j] - both)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _compared(percent: int):
    """(a, b): links that join the components of a cluster, or of two blocks of one.

    Rows that ask are compared with those that do not; where none asks, all rows outside the
    largest component are compared with all. Members are taken likeliest first, and what is
    connected by then is left out; if many are left, one pass over the members' inverted shingles
    counts the intersections with all of them.
    """
    most = _most_apart(percent)

    def compared(rows: pa.Table) -> pa.Table:
        v, n, label, asks = (rows[c].to_numpy() for c in ("v", "n", "label", "asks"))
        bits, sets = _words(rows["bits"].combine_chunks()), [np.frombuffer(h, np.uint64) for h in rows["hashes"].to_pylist()]
        size = len(v)
        if asks.any():
            askers, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        else:
            kinds, counts = np.unique(label, return_counts=True)
            askers, others = np.flatnonzero(label != kinds[counts.argmax()]), np.arange(size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        values, starts, counts = np.unique(flat[order], return_index=True, return_counts=True)
        owner = np.repeat(np.arange(size, dtype=np.int32), n)[order]
        del flat, order
        s = n - np.bincount(owner[starts[counts == 1]], minlength=size)
        component, out = label.copy(), []

        def join(i, j):
            out.append((v[i], v[j]))
            component[component == component[j]] = component[i]

        for i in askers.tolist():
            found = others[component[others] != component[i]]
            at = np.full(len(found), i)
            found = found[_sized(n, at, found, percent) & _possible(n, s, at, found, percent)]
            far = _apart(bits, np.full(len(found), i), found)
            found = found[far <= most][np.argsort(far[far <= most], kind="stable")]
            for j in found[:PAIRWISE].tolist():
                if component[j] != component[i] and _similar(sets[i], sets[j], percent):
                    join(i, j)
            found = found[PAIRWISE:]
            found = found[component[found] != component[i]]
            if not len(found):
                continue
            places = np.searchsorted(values, sets[i])
            spans = counts[places]
            gathered = np.repeat(starts[places] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
            both = np.bincount(owner[gathered], minlength=size)[found]
            for j in found[(both > 0) & (100 * both >= percent * (n[i] + n[found] - both))].tolist():
                if component[j] != component[i]:
                    join(i, j)
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})

    return compared


def _hashed(size: int):
    def hashed(batches):
        for batch in batches:
            own = [shingles(text, size) for text in utf8(batch["text"])]
            keys = [_digest(h) for h in own]
            yield pa.RecordBatch.from_pydict({
                **{c: pa.array([x[k] for x in keys], pa.int64()) for k, c in enumerate(("high", "low"))},
                "hashes": pa.array([h.tobytes() for h in own], pa.binary())})

    return hashed


def _linked(percent: int):
    @F.arrow_udf(T.BooleanType())
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                         for x, y in zip(utf8(left), utf8(right), strict=True)], pa.bool_())

    return linked


def marked_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be among ``ids``: all that are, and few others, so that the
    other texts need no shuffle. A bit for each hash of an id is sent to all tasks, MARKS at most."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    slot, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    marks = ids.select(slot.alias("_slot"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))").alias("_mark")
                       ).groupBy("_slot").agg(F.bit_or("_mark").alias("_marks"))
    return docs.withColumn("_slot", slot).join(F.broadcast(marks), "_slot").where(
        F.getbit("_marks", bit) == 1).select(*docs.columns)


class _Search:
    """The state of one join: vertices, and the components found so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, known: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.size, self.percent = docs, classes, size, percent
        self.bits = classes.select("v", "bits", "n")
        self.labels: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.connect(known)

    def labelled(self, df: DataFrame, column: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(column))
        own = self.labels.select(F.col("v").alias(column), F.col("label").alias(name))
        return df.join(own, column, "left").withColumn(name, F.coalesce(name, column))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs not yet known to be connected, with the labels of both."""
        return self.labelled(self.labelled(pairs, "a", "la"), "b", "lb").where("la <> lb")

    def connect(self, links: DataFrame) -> None:
        """Renews the labels by new links: only the components that they join are looked at."""
        between = checkpointed(self.apart(links).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        if between.isEmpty():
            return
        joined = components(between)
        if self.labels is None:
            self.labels = joined
            return
        new = joined.select(F.col("v").alias("label"), F.col("label").alias("new"))
        # a component that was a single vertex has no row yet
        alone = joined.join(self.labels.select("v"), "v", "left_anti")
        self.labels = checkpointed(self.labels.join(new, "label", "left").select(
            "v", F.coalesce("new", "label").alias("label")).unionByName(alone))

    def confirm(self, pairs: DataFrame) -> None:
        """Connects the pairs whose full sets are similar."""
        left, right = (self.sets.select(F.col("v").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
        self.connect(pairs.select("a", "b").join(left, "a").join(right, "b").where(
            _linked(self.percent)("ha", "hb")).select("a", "b"))

    def fetch(self, pairs: DataFrame) -> None:
        """The hashed sets of the vertices that have a likely partner."""
        met = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
        wanted = checkpointed(self.classes.join(met, "v").select("v", "high", "low", "least"))
        ids = wanted.select(F.col("least").alias("doc_id")).distinct()
        # the same join at every size; a semi-join would be moved below the marks, and all texts shuffled
        texts = marked_texts(self.docs, ids).join(ids.hint("merge"), "doc_id")
        own = texts.mapInArrow(_hashed(self.size), "high bigint, low bigint, hashes binary")
        self.sets = checkpointed(own.join(wanted, ["high", "low"]).groupBy("v").agg(F.first("hashes").alias("hashes")))

    def stars(self, large: DataFrame) -> DataFrame:
        """(a, b, far): the likely pairs of a large node's documents with its pivot."""
        pairs = large.where("v <> pivot").select(F.col("v").alias("a"), F.col("pivot").alias("b")).distinct()
        left, right = (self.bits.select(F.col("v").alias(c), F.col("bits").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
        return (pairs.join(left, "a").join(right, "b")
                .where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), _differ("sa", "sb").alias("far"))
                .where(F.col("far") <= _most_apart(self.percent)))

    def level(self, rows: DataFrame):
        """Of the nodes of ``rows`` (node, v): likely pairs, and (node, v) to branch on."""
        xor = F.col("v").bitwiseXOR(F.col("node"))  # another order in every node
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min(xor).alias("least")).where("k > 1")
        live = checkpointed(rows.join(sizes, "node").select(
            "node", "v", "k", F.col("least").bitwiseXOR(F.col("node")).alias("pivot")))
        small, large = live.where(F.col("k") <= SMALL).select("node", "v"), live.where(F.col("k") > SMALL)
        pairs = [checkpointed(self.ordered(small.join(self.bits, "v")).mapInArrow(
            _spanning(self.percent), "a bigint, b bigint, far int"))]
        if large.isEmpty():
            return pairs, None
        pairs.append(checkpointed(self.stars(large)))
        self.fetch(pairs[-1])
        self.confirm(self.best(pairs[-1]))  # what a pivot connects needs no branching
        marked = self.labelled(large.select("node", "v"), "v", "label")
        mixed = marked.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        return pairs, large.join(mixed, "node", "left_semi").select("node", "v")

    def ordered(self, rows: DataFrame) -> DataFrame:
        return rows.repartition("node").sortWithinPartitions("node")

    def best(self, pairs: DataFrame) -> DataFrame:
        """The likeliest pair of each vertex."""
        ends = pairs.select(F.col("a").alias("v"), "a", "b", "far").union(pairs.select(F.col("b").alias("v"), "a", "b", "far"))
        return ends.groupBy("v").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b").distinct()

    def open_clusters(self, pairs: DataFrame) -> DataFrame:
        """(cluster, part, v, label, n, asks) for the members of clusters of likely pairs that are not one
        component. A cluster of many shingles is cut into blocks, and the blocks outside its largest
        component ask the blocks of all members, a part for each two blocks."""
        clusters = components(pairs).withColumnRenamed("label", "cluster")
        marked = checkpointed(self.labelled(clusters, "v", "label").join(self.classes.select("v", "n"), "v"))
        shares = marked.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
        sizes = shares.groupBy("cluster").agg(
            F.max(F.struct("k", "label", "n")).alias("largest"), F.sum("n").alias("all"),
            F.count(F.lit(1)).alias("labels")).where("labels > 1")
        sizes = sizes.select(
            "cluster", F.col("largest.label").alias("largest"),
            F.when(F.col("all") > 2 * BLOCK_SHINGLES, F.ceil(F.col("all") / BLOCK_SHINGLES)).otherwise(0).alias("blocks"),
            F.ceil((F.col("all") - F.col("largest.n")) / BLOCK_SHINGLES).alias("asking"))
        members = marked.join(sizes, "cluster")
        deal, none = F.xxhash64("v"), F.lit(0).cast("long")
        all_ = members.withColumn("part", F.explode(F.when(F.col("blocks") == 0, F.array(none)).otherwise(F.transform(
            F.sequence(none, F.col("asking") - 1), lambda x: x * F.col("blocks") + F.pmod(deal, F.col("blocks")))))
        ).withColumn("asks", F.lit(False))
        asking = members.where("blocks > 0 and label <> largest").withColumn("part", F.explode(F.transform(
            F.sequence(none, F.col("blocks") - 1),
            lambda x: F.pmod(deal, F.col("asking")) * F.col("blocks") + x))).withColumn("asks", F.lit(True))
        return all_.unionByName(asking).select("cluster", "part", "v", "label", "n", "asks")

    def run(self, rows: DataFrame) -> None:
        found = []
        while rows is not None:
            pairs, rest = self.level(rows)
            found += pairs
            rows = None if rest is None else checkpointed(rest.join(self.classes.select("v", "sig"), "v").mapInArrow(
                _children(self.percent / 100), "node bigint, v bigint"))
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.union(more)
        pairs = checkpointed(pairs.groupBy("a", "b").agg(F.min("far").alias("far")))
        self.fetch(pairs)
        self.confirm(self.best(pairs))
        asked = self.open_clusters(pairs.select("a", "b")).join(self.bits.select("v", "bits"), "v").join(self.sets, "v")
        self.connect(checkpointed(asked.groupBy("cluster", "part").applyInArrow(_compared(self.percent), "a bigint, b bigint")))


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs`` (doc_id, text).

    Documents with ``100 * intersection >= percent * union`` are linked; ``component_id`` is the
    smallest doc_id that links reach, ``kept`` marks it. Null and empty texts, and texts without
    words, are linked with nothing. Rows that repeat an id are one document, whatever their texts:
    linked with whatever any of its rows is linked with. A null id takes no part: no component, kept.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sets = checkpointed(docs.mapInArrow(
        _embed(size), "doc_id bigint, n_shingles bigint, high bigint, low bigint, sig binary, bits binary"))
    classes = checkpointed(
        sets.where("n_shingles > 0 and doc_id is not null").groupBy("high", "low")
        .agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"),
             F.first("bits").alias("bits")).withColumn("v", F.monotonically_increasing_id()))
    rows = sets.drop("sig", "bits").join(classes.select("high", "low", "v"), ["high", "low"], "left")
    rows = checkpointed(rows.select("doc_id", "n_shingles", "v"))
    again = checkpointed(rows.where("doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("k"), F.min("v").alias("a")).where("k > 1").select("doc_id", "a"))
    same = rows.join(again, "doc_id").where("v <> a").select("a", F.col("v").alias("b")).distinct()
    search = _Search(docs, classes, same, size, percent)
    search.run(classes.select("v", "sig").mapInArrow(_roots(percent / 100), "node bigint, v bigint"))
    labels = search.labelled(classes.select("v", "least"), "v", "label")
    smallest = labels.groupBy("label").agg(F.min("least").alias("smallest"))
    named = checkpointed(rows.join(labels.join(smallest, "label").select("v", "smallest"), "v", "left"))
    # of a repeated id a row without words goes with the others
    shared = named.join(again.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("smallest").alias("shared"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "shared", "doc_id"))
    return named.join(shared, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


@query("op6_chosen_path")
def op6_chosen_path(spark, sf):
    return near_copies(table(spark, sf, "documents"), size=2)
