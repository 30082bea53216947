"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers, by suffix arrays.

A repeated string has the same hashes wherever it stands, so the smallest hash among its
``GRAM``-byte grams, its anchor, is the same too. Each text is cut into stretches of consecutive
windows (strings of LENGTH bytes) with one anchor; only stretches whose anchor is met again can
hold a repeated string, and all strings that are equal share an anchor. So distinct stretches are
dealt to shards by anchor, and each shard sorts its suffixes: ranks by the first eight bytes,
refined by doubling among the suffixes not yet told apart (Larsson and Sadakane), then common
prefixes with the neighbour in the order, carried from each suffix to the next one in the text
(Kasai). A neighbour that shares LENGTH bytes makes both repeated.

An anchor with more stretches than a shard may hold is dealt to several shards; each of them hands
on its sorted distinct strings, and these runs are merged by binary search.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import checkpointed, prepare, query, table, utf8, whole_text, without

LENGTH = 200
GRAM = 64
SHARD_BYTES = 1 << 20    # of a shard, on average
SHARD_ROWS = 12_000      # stretches of one anchor in a shard; more are dealt to several
PIECE = 1 << 18          # windows that a task looks at at a time
MERGE_ROWS = 100_000     # strings that are merged in a task, on average

KEYS = ["id", "high", "low"]  # a row is known by its id and a digest of its text: equal rows lose the same bytes

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BYTES = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)  # a difference below the k-th: 8 - k bytes are equal
_KIND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
                 for base in (_PRIME, _INVERSE))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _over(pick, x: np.ndarray, width: int) -> np.ndarray:
    """The minimum or maximum of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def stretches(pieces: list[bytes], length: int, gram: int):
    """(piece, start, windows, anchor, whole) of all stretches; ``whole`` hashes a stretch's bytes.

    Also the anchors that stand twice in a row without another one between: a string may then be
    repeated within one stretch.
    """
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _powers(max(1 << 20, len(text)))  # one size but for tests with odd ones
    total = np.concatenate([[np.uint64(0)], np.cumsum(text * up[:len(text)], dtype=np.uint64)])
    grams = _mix((total[gram:] - total[:-gram]) * down[:len(text) - gram + 1])
    first = np.cumsum(sizes) - sizes
    width = length - gram + 1
    anchors = _over(np.minimum, grams, width)
    edge = np.zeros(width - 1, np.uint64)
    spots = np.flatnonzero(_over(np.maximum, np.concatenate([edge, anchors, edge]), width) == grams)
    twice = (np.diff(spots) <= width) & (grams[spots[1:]] == grams[spots[:-1]])
    inner = np.unique(grams[spots[1:][twice]])
    piece = np.repeat(np.arange(len(pieces)), np.maximum(sizes - length + 1, 0))
    counts = np.maximum(sizes - length + 1, 0)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + first[piece]
    own = anchors[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])]))
    windows = np.diff(np.append(new, len(own)))
    start = at[new]
    end = start + windows + length - 1
    whole = _mix((total[end] - total[start]) * down[start] + windows.astype(np.uint64) * np.uint64(_PRIME))
    return (piece[new], start - first[piece[new]], windows, own[new].view(np.int64), whole.view(np.int64),
            inner.view(np.int64))


def _rows(length: int, gram: int):
    def rows(batches):
        for batch in batches:
            held, size = [], 0
            for *key, text in zip(*(batch[c].to_pylist() for c in KEYS), utf8(batch["text"]), strict=True):
                for base in range(0, len(text) - length + 1, PIECE):  # long texts bit by bit
                    held.append((*key, base, text[base:base + PIECE + length - 1]))
                    size += len(held[-1][-1])
                    if size >= 2 * PIECE:
                        yield encode(held)
                        held, size = [], 0
            if held:
                yield encode(held)

    def encode(held):
        piece, start, windows, anchor, whole, inner = stretches([h[-1] for h in held], length, gram)
        *keys, base = (np.array([h[k] for h in held], np.int64) for k in range(len(KEYS) + 1))
        none = np.zeros(len(inner), np.int64)  # rows without a place count an anchor once more
        return pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(x)) for c, x in (
            *((c, (x[piece], none)) for c, x in zip(KEYS, keys, strict=True)),
            ("place", (((base[piece] + start) << 32) | windows, none - 1)),
            ("anchor", (anchor, inner)), ("whole", (whole, none)))})

    return rows


def _bodies(length: int):
    """The bytes of the stretches that stand for their equals."""
    def bodies(batches):
        for batch in batches:
            for text, wanted in zip(utf8(batch["text"]), batch["wanted"].to_pylist(), strict=True):
                spans = [(w["place"] >> 32, w["place"] & 0xFFFFFFFF) for w in wanted]
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array([w[c] for w in wanted], pa.int64()) for c in ("shard", "anchor", "whole")},
                    "split": pa.array([w["split"] for w in wanted], pa.bool_()),
                    "body": pa.array([text[a:a + n + length - 1] for a, n in spans], pa.binary())})

    return bodies


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros behind the end."""
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    key = np.zeros(len(text), np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key |= padded[i:i + len(text)]
    return key


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of the suffix at each position: the inverse of the suffix array."""
    n = len(text)
    key = _eights(text)  # ends are told apart later
    order = np.argsort(key).astype(np.int32)
    ranks = np.empty(n, np.int32)
    ranks[order] = _group_starts(key[order])
    del key
    reach = 8
    open_ = order
    while len(open_):
        own = ranks[open_]
        same = np.concatenate([own[1:] == own[:-1], [False]])
        open_ = open_[same | np.concatenate([[False], same[:-1]])]  # those not yet told apart
        if not len(open_):
            break
        ahead = open_ + reach
        later = np.where(ahead < n, ranks[np.minimum(ahead, n - 1)] + 1, n - ahead)  # past the end: the shorter first
        both = (ranks[open_].astype(np.int64) << 32) | (later + reach)  # above 0; equal ones in any order: one rank
        turn = np.argsort(both)
        open_, both = open_[turn], both[turn]
        before = (both >> 32).astype(np.int32)
        first = np.concatenate([[True], (before[1:] != before[:-1])])
        new = np.concatenate([[True], both[1:] != both[:-1]])
        at = np.arange(len(open_), dtype=np.int32)
        group = at[first][np.cumsum(first) - 1]
        ranks[open_] = before + at[new][np.cumsum(new) - 1] - group
        reach *= 2
    return ranks


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    at = np.arange(len(ordered), dtype=np.int32)
    return np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), at, 0))


def common_prefixes(text: np.ndarray, before: np.ndarray, starts: np.ndarray, windows: np.ndarray,
                    limit: int) -> np.ndarray:
    """Bytes, up to ``limit``, that each window shares with the one before it in suffix order.

    ``before`` has that one's position (-1: none). All stretches go along side by side: what a
    window shares, less one byte, the next window shares too, if the other one is followed by a
    window as well.
    """
    eights = _eights(text)
    last = np.zeros(len(text), bool)
    last[starts + windows - 1] = True
    out = np.zeros(len(text), np.int32)
    carried = np.zeros(len(starts), np.int64)
    rows = np.argsort(-windows, kind="stable")
    ends = np.searchsorted(-windows[rows], -np.arange(int(windows.max(initial=0))), "left")
    for t, k in enumerate(ends):
        live = rows[:k]
        here = starts[live] + t
        other = before[here]
        shared = np.where(other >= 0, np.maximum(carried[live] - 1, 0), 0)
        todo = np.flatnonzero(other >= 0)
        while len(todo):
            at = shared[todo]
            apart = eights[here[todo] + at] ^ eights[other[todo] + at]
            shared[todo] = at = np.minimum(at + 8 - np.searchsorted(_BYTES, apart, "right"), limit)
            todo = todo[(apart == 0) & (at < limit)]
        carried[live] = np.where(last[other], 0, shared)
        out[here] = shared
    return out


def repeated_windows(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start of each body, its windows, repeated mask by position, positions in suffix order)."""
    sizes = np.array([len(b) for b in bodies])
    text = np.frombuffer(b"".join(bodies), np.uint8)
    starts, windows = np.cumsum(sizes) - sizes, sizes - length + 1
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    ranks = suffix_ranks(text)
    order = at[np.argsort(ranks[at], kind="stable")]
    before = np.full(len(text), -1, np.int32)
    before[order[1:]] = order[:-1]
    shared = common_prefixes(text, before, starts, windows, length)
    hit = np.flatnonzero(shared >= length)
    mask = np.zeros(len(text), bool)
    mask[hit] = True
    mask[before[hit]] = True
    return starts, windows, mask, order[shared[order] < length]


def _shard(length: int):
    def shard(rows: pa.Table) -> pa.Table:
        bodies, whole, anchor = (rows[c].to_pylist() for c in ("body", "whole", "anchor"))
        starts, windows, mask, distinct = repeated_windows(bodies, length)
        out = {c: [] for c in ("anchor", "whole", "begin", "stop", "high", "low")}
        edges = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            for k in range(*(int(np.searchsorted(starts, x, side)) + d for x, side, d in ((a, "right", -1), (b, "left", 0)))):
                lo, hi = max(a, starts[k]), min(b, starts[k] + windows[k])
                if lo < hi:
                    _add(out, anchor[k], whole[k], lo - starts[k], hi - starts[k], None)
        if rows["split"][0].as_py():  # a sorted run of distinct strings, for the merge
            for p in distinct.tolist():
                k = int(np.searchsorted(starts, p, "right")) - 1
                at = p - int(starts[k])
                _add(out, anchor[k], whole[k], at, at + 1, xxhash.xxh3_128_digest(bodies[k][at:at + length]))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return shard


def _add(out, anchor, whole, begin, stop, digest) -> None:
    row = (anchor, whole, int(begin), int(stop), *((None, None) if digest is None else (
        int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True))))
    for column, value in zip(out.values(), row, strict=True):
        column.append(value)


def _merge(rows: pa.Table) -> pa.Table:
    """Strings of several shards' runs that are equal: each run is looked up in those before it."""
    run, high, low = (np.asarray(rows[c]) for c in ("shard", "high", "low"))
    key = np.empty(len(run), [("high", np.int64), ("low", np.int64)])
    key["high"], key["low"] = high, low
    hit = np.zeros(len(run), bool)
    merged = np.empty(0, np.int64)
    for r in np.unique(run):
        own = np.flatnonzero(run == r)
        own = own[np.lexsort((low[own], high[own]))]
        if len(merged):
            place = np.minimum(np.searchsorted(key[merged], key[own]), len(merged) - 1)
            equal = key[merged][place] == key[own]
            hit[own[equal]] = True
            hit[merged[place[equal]]] = True
            own = own[~equal]
        merged = np.concatenate([merged, own])
        merged = merged[np.lexsort((low[merged], high[merged]))]
    return rows.filter(pa.array(hit)).select(["anchor", "whole", "begin", "stop"])


_CUT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                     T.StructField("spans", _KIND)])


@F.arrow_udf(_CUT)
def _cut(texts: pa.Array, covers: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(utf8(texts), covers.to_pylist(), strict=True):
        spans: list[list[int]] = []
        for c in sorted(own or (), key=lambda c: c["start"]):
            if spans and c["start"] <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], c["end"])
            else:
                spans.append([c["start"], c["end"]])
        kept, at = [], 0
        for a, b in spans:
            kept.append(text[at:a])
            at = b
        out.append({"kept": b"".join([*kept, text[at:]]), "n_bytes": len(text),
                    "spans": [{"start": a, "end": b} for a, b in spans]})
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.array(out, pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("spans", span)]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds ``kept`` (the bytes left), ``n_bytes``, ``n_removed`` and ``spans`` (maximal removed runs).

    Texts are UTF-8 bytes, null ones empty; what is left may begin or end within a character. Every
    row is a place of its own, rows with a null or repeated id too: a string that two rows share
    goes from both. Texts of fewer bytes than ``length`` stay whole. Columns named like the added
    ones are replaced.
    """
    prepare(docs.sparkSession)
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
            F.xxhash64(whole_text()).alias("high"), F.xxhash64(F.lit(1), whole_text()).alias("low")]
    texts = docs.select(*keys, whole_text().alias("text")).where(F.octet_length("text") >= length)
    rows = texts.mapInArrow(
        _rows(length, gram), "id bigint, high bigint, low bigint, place bigint, anchor bigint, whole bigint")
    again = checkpointed(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    places = checkpointed(rows.where("place >= 0").join(again, "anchor"))
    distinct = checkpointed(places.groupBy("anchor", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEYS, "place")).alias("at"))
        .select("anchor", "whole", "n", "at.*"))
    windows = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    crowded = checkpointed(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where(
        F.col("rows") > shard_rows))
    size = distinct.agg(F.sum(windows + length - 1)).first()[0] or 0
    shards = size // shard_bytes + 1
    alone = F.xxhash64("anchor", F.pmod("whole", F.ceil(F.col("rows") / shard_rows)))
    dealt = distinct.join(crowded, "anchor", "left").withColumn("split", F.col("rows").isNotNull()).withColumn(
        "shard", F.when(F.col("split"), alone).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))
    wanted = dealt.groupBy(*KEYS).agg(
        F.collect_list(F.struct("place", "shard", "split", "anchor", "whole")).alias("wanted"))
    single = texts.groupBy(*KEYS).agg(F.first("text").alias("text"))  # repeated rows hand on their bytes once
    bodies = single.join(wanted, KEYS).select("text", "wanted").mapInArrow(
        _bodies(length), "shard bigint, anchor bigint, whole bigint, split boolean, body binary")
    kind = "anchor bigint, whole bigint, begin bigint, stop bigint"
    found = checkpointed(bodies.groupBy("shard", "split").applyInArrow(
        lambda key, t: _tagged(key, _shard(length)(t)), f"shard bigint, {kind}, high bigint, low bigint"))
    own = found.where("high is null").select("anchor", "whole", "begin", "stop")
    runs = found.where("high is not null")
    merges = runs.count() // MERGE_ROWS + 1
    merged = runs.groupBy(F.pmod("high", F.lit(merges)).alias("part")).applyInArrow(_merge, kind)
    whole = distinct.where("n > 1").select("anchor", "whole", F.lit(0).cast("long").alias("begin"), windows.alias("stop"))
    hits = own.unionByName(merged).unionByName(whole)
    begin = F.shiftright("place", 32)
    covers = places.join(hits, ["anchor", "whole"]).groupBy(*KEYS).agg(F.collect_list(F.struct(
        (begin + F.col("begin")).alias("start"), (begin + F.col("stop") + length - 1).alias("end"))).alias("_covers"))
    own = [f"_{c}" for c in KEYS]
    rest = without(docs, ["kept", "n_bytes", "n_removed", "spans", "_cut", "_covers", *own])
    keyed = rest.select("*", *(k.alias(c) for k, c in zip(keys, own, strict=True)))
    covers = covers.withColumnsRenamed(dict(zip(KEYS, own, strict=True)))
    cut = keyed.join(covers, own, "left").withColumn("_cut", _cut(whole_text(), F.col("_covers")))
    return cut.select(
        *[f"`{c}`" for c in rest.columns], F.col("_cut.kept").alias("kept"), F.col("_cut.n_bytes").alias("n_bytes"),
        (F.col("_cut.n_bytes") - F.octet_length("_cut.kept")).alias("n_removed"), F.col("_cut.spans").alias("spans"))


def _tagged(key, out: pa.Table) -> pa.Table:
    return out.add_column(0, "shard", pa.array([key[0].as_py()] * out.num_rows, pa.int64()))


@query("op4_suffix_arrays")
def op4_suffix_arrays(spark, sf):
    cut = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
