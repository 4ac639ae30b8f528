"""SimHash fingerprints and their near pairs by a Gray-order hierarchical index.

Fingerprints are dealt to groups that share a masked bit pattern, the top nodes of the index. Inside a group they are
sorted by Gray rank and put under nodes that hold the bits all below them share. A search carries the differences
counted so far from node to node and drops a whole node as soon as they exceed the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from litquarry.llm.common import bounded_batches
from litquarry.llm.components import connected_components
from litquarry.scale import cut, small_side

PIECE_BYTES = 1 << 20  # of a text split into words at once
GROUP_LIMIT = 4096  # rows of a group before it is divided
LEAF, FAN = 16, 8  # rows under a lowest node, nodes under an upper one
SMALL = 24  # groups up to this size are compared directly
FINER, EXTRA_BITS = 8, 4  # choices of further bits for a large group without exact masks, bits of each
SPACES = b" \t\n\v\f\r"
_ONES = np.uint64(0x0101010101010101)


# --- fingerprints ---------------------------------------------------------------------------------------------

def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every run of ``shingle`` words, A-Z lower-cased and joined by spaces; piece by piece.

    A text of fewer words is one run, one without words gives nothing.
    """
    raw = text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""
    digest, kept, at, done = xxhash.xxh64_intdigest, [], 0, False
    while at < len(raw):
        end = at + PIECE_BYTES
        if end < len(raw):
            while end < len(raw) and raw[end] not in SPACES:
                end += 1
        words = kept + raw[at:end].split()
        at = end
        if len(words) >= shingle:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(sizes) - 1
            starts = (ends + 1 - sizes).tolist()
            yield np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
            done, kept = True, words[len(words) - shingle + 1:] if shingle > 1 else []
        else:
            kept = words
    if not done and kept:
        yield np.array([digest(b" ".join(kept), 42)], np.uint64)


def spread_hash(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits of a wider hash; the first are the hash itself."""
    if k == 0:
        return h
    h = (h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each segment have each of the 64 bits: bytes count up to 255 rows at once."""
    ends = np.append(starts[1:], len(h))
    blocks = -(-(ends - starts) // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    cuts = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    out = np.zeros((len(starts), 8, 8), np.int64)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _ONES, cuts)
        out[:, :, k] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(-1, 64)


def fingerprint_batch(texts: Sequence[str | None], shingle: int, width: int = 1, distinct: bool = False) -> np.ndarray:
    """(texts, width) 64-bit words: a bit is one if over half of the shingles' hashes have it. ``distinct``: each hash once."""
    parts, owners = [], []
    for i, text in enumerate(texts):
        own = list(shingle_hashes(text, shingle))
        if distinct and own:
            own = [np.unique(np.concatenate(own))]
        parts += own
        owners += [i] * len(own)
    out = np.zeros((len(texts), width), np.uint64)
    if not parts:
        return out
    h = np.concatenate(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts, owners = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array(owners)
    n = np.bincount(owners, weights=sizes, minlength=len(texts))
    for k in range(width):
        counts = np.zeros((len(texts), 64), np.int64)
        np.add.at(counts, owners, bit_counts(spread_hash(h, k), starts))
        out[:, k] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int, width: int = 1, distinct: bool = False, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp`` (8 * width bytes, the first words' highest byte first) of every row; no words give zero."""
    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = fingerprint_batch(list(pdf["text"]), shingle, width, distinct).astype(">u8")
            yield pdf[list(keep)].assign(fp=[row.tobytes() for row in fp])

    return docs.select(*keep, "text").mapInPandas(run, f"{schema}, fp binary")


# --- the index ------------------------------------------------------------------------------------------------

def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each row's bits in Gray order: every bit is the parity of itself and all bits before it."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    odd = np.zeros(len(fp), np.uint64)
    for k in range(fp.shape[1]):
        before = odd.copy()
        odd ^= out[:, k] & np.uint64(1)
        out[:, k] ^= np.uint64(0) - before
    return out


def differing(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    x = a ^ b if mask is None else (a ^ b) & mask
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def hierarchy(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the lowest up over Gray-sorted rows: (pattern, bits shared but not above, children's fan) of each node."""
    levels, low, high, fan = [], fp, fp, LEAF
    while True:
        at = np.arange(0, len(low), fan)
        low, high = np.bitwise_and.reduceat(low, at, axis=0), np.bitwise_or.reduceat(high, at, axis=0)
        levels.append([low, ~(low ^ high), fan])
        if len(at) <= FAN:
            break
        fan = FAN
    shared = [level[1] for level in levels]
    for k in range(len(levels) - 1):  # a node counts only what its upper node has not counted
        levels[k][1] = shared[k] & ~np.repeat(shared[k + 1], levels[k + 1][2], axis=0)[:len(shared[k])]
    levels[0].append(shared[0])
    return levels


def search_group(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differences) of all pairs i < j of Gray-sorted rows within ``radius``."""
    levels, found = hierarchy(fp), []
    rest = ~levels[0][3]
    for a in range(0, len(fp), 512):
        top = len(levels[-1][0])
        q, node = np.repeat(np.arange(a, min(a + 512, len(fp))), top), np.tile(np.arange(top), min(512, len(fp) - a))
        count = np.zeros(len(q), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            pattern, mask, fan = levels[k][:3]
            count += differing(fp[q], pattern[node], mask[node])
            near = count <= radius
            q, node, count = q[near], node[near], count[near]
            below = len(levels[k - 1][0]) if k else len(fp)
            upper = np.repeat(node, fan)
            q, count, node = np.repeat(q, fan), np.repeat(count, fan), upper * fan + np.tile(np.arange(fan), len(node))
            inside = (node < below) & (node > q) if k == 0 else node < below
            q, count, node, upper = q[inside], count[inside], node[inside], upper[inside]
        count += differing(fp[q], fp[node], rest[upper])
        near = count <= radius
        found.append((q[near], node[near], count[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Numbers of edges of a minimum spanning forest: components take their lightest edge all at once, round by round."""
    label, chosen = np.arange(n), []
    order = np.lexsort((v, u, weight))
    u, v = u[order], v[order]
    alive = np.arange(len(u))
    while len(alive):
        a, b = label[u[alive]], label[v[alive]]
        cross = a != b
        alive, a, b = alive[cross], a[cross], b[cross]
        if not len(alive):
            break
        best = np.full(n, len(u))
        np.minimum.at(best, a, alive)
        np.minimum.at(best, b, alive)
        take = np.unique(best[best < len(u)])
        chosen.append(take)
        while True:  # the taken edges' components to their smallest labels
            a, b = label[u[take]], label[v[take]]
            if (a == b).all():
                break
            low, root = np.minimum(a, b), np.arange(n)
            np.minimum.at(root, np.maximum(a, b), low)
            while not (root[root] == root).all():
                root = root[root]
            label = root[label]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)


def group_pairs(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, i, j, differences): all pairs within ``radius`` of rows with equal keys; i and j are places in ``order``."""
    order = np.lexsort((*gray_rank(fp).T[::-1], key))
    key, fp = key[order], fp[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(first, len(key)))
    out = []
    left = np.repeat(np.where(sizes <= SMALL, first + sizes, 0), sizes)  # end of a small group, else 0
    rows = np.flatnonzero(left > np.arange(len(key)) + 1)
    for s in range(1, SMALL):
        rows = rows[rows + s < left[rows]]
        if not len(rows):
            break
        d = differing(fp[rows], fp[rows + s])
        near = d <= radius
        out.append((rows[near], rows[near] + s, d[near]))
    for a, n in zip(first[sizes > SMALL], sizes[sizes > SMALL]):
        i, j, d = search_group(fp[a:a + n], radius)
        out.append((i + a, j + a, d))
    i, j, d = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return order, i, j, d


def group_edges(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differences, keys): a minimum spanning forest of the pairs within ``radius`` of rows with equal keys, and the keys with more pairs."""
    order, i, j, d = group_pairs(key, fp, radius)
    kept = forest(i, j, d, len(key))
    return order[i[kept]], order[j[kept]], d[kept], np.unique(key[order[np.delete(i, kept)]])


# --- over all documents -----------------------------------------------------------------------------------------

def exact_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks of which any two fingerprints within ``radius`` agree on one: two of radius + 2 blocks."""
    cuts = [bits * k // (radius + 2) for k in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def sampled_masks(tables: int, agreeing: int, bits: int, seed: int = 11) -> list[int]:
    """``tables`` random masks of ``agreeing`` bits each."""
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(bits, agreeing, replace=False)) for _ in range(tables)]


def as_rows(fps: pd.Series) -> np.ndarray:
    """Fingerprint bytes as 64-bit words, highest first."""
    return np.frombuffer(b"".join(map(bytes, fps)), ">u8").reshape(len(fps), -1).astype(np.uint64)


def mask_words(mask: int, width: int) -> np.ndarray:
    return np.frombuffer(mask.to_bytes(8 * width, "big"), ">u8").astype(np.uint64)


def masked_key(fp: np.ndarray, mask: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """One 64-bit key of the masked words; two patterns that fall together only cost comparisons."""
    key = np.zeros(len(fp), np.uint64) + np.asarray(salt).astype(np.uint64)
    for k in range(fp.shape[1]):
        key = spread_hash(key ^ (fp[:, k] & mask[..., k]), k + 1)
    return key.view(np.int64)


def sub_blocks(mask: int, parts: int, bits: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` runs."""
    free = [b for b in range(bits) if not mask >> b & 1]
    return [sum(1 << b for b in run) for run in np.array_split(free, parts)]


def _groups(fps: DataFrame, masks: Sequence[int], width: int) -> DataFrame:
    """(key, route, fp): every fingerprint under each mask."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = as_rows(pdf["fp"])
            for r, mask in enumerate(masks):
                yield pd.DataFrame({"key": masked_key(fp, mask_words(mask, width), r + 1), "route": str(r), "fp": pdf["fp"]})
    return fps.select("fp").mapInPandas(run, "key long, route string, fp binary")


def sampled_blocks(mask: int, bits: int) -> list[int]:
    """FINER choices of EXTRA_BITS bits outside ``mask``, the same ones whenever asked."""
    free = [b for b in range(bits) if not mask >> b & 1]
    rng = np.random.default_rng(mask)
    return [sum(1 << int(b) for b in rng.choice(free, EXTRA_BITS, replace=False)) for _ in range(FINER)]


def _refined(rows: DataFrame, masks: Sequence[int], radius: int, width: int, exact: bool) -> DataFrame:
    """Rows of large groups under longer patterns.

    Exactly: of the bits not shared yet, one of radius + 1 runs agrees in any near pair. Otherwise by sampled choices.
    """
    def blocks_of(mask: int) -> list[int]:
        return sub_blocks(mask, radius + 1, 64 * width) if exact else sampled_blocks(mask, 64 * width)

    def mask_of(route: str) -> int:
        first, *path = map(int, route.split("."))
        mask = masks[first]
        for t in path:
            mask |= blocks_of(mask)[t]
        return mask

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for route, own in pdf.groupby("route", sort=False):
                fp = as_rows(own["fp"])
                for t, block in enumerate(blocks_of(mask_of(route))):
                    if block:
                        yield pd.DataFrame({"key": masked_key(fp, mask_words(block, width), spread_hash(own["key"].to_numpy().view(np.uint64), t + 1)),
                                            "route": f"{route}.{t}", "fp": own["fp"].to_numpy()})
    return rows.mapInPandas(run, "key long, route string, fp binary")


def _tight(hot: DataFrame, radius: int) -> DataFrame:
    """(key, count) of the groups more than half of whose rows are within ``radius`` of one of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["key"]].assign(near=(differing(as_rows(pdf["fp"]), as_rows(pdf["pivot"])) <= radius) if len(pdf) else [])
    pivots = small_side(hot.groupBy("key").agg(F.min("fp").alias("pivot")))
    near = hot.select("key", "fp").join(pivots, "key").mapInPandas(run, "key long, near boolean")
    return near.groupBy("key").agg(F.count("*").alias("count"), F.count_if("near").alias("near")).where("2 * near > count").select("key", "count")


def _in_blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of the groups ``large`` in blocks of about half of GROUP_LIMIT by a hash; every two blocks are a group."""
    hot = rows.join(large, "key").withColumn("_blocks", F.ceil(2 * F.col("count") / GROUP_LIMIT)).withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    pair = (F.least("_own", "_other"), F.greatest("_own", "_other"))  # two blocks hold each one's own pairs too
    return hot.select("key", "route", "fp", "_own", other).where("_own != _other").select(F.xxhash64("key", *pair).alias("key"), "route", "fp")


def near_groups(fps: DataFrame, radius: int, masks: Sequence[int], width: int = 1, exact: bool = True) -> DataFrame:
    """(key, fp): ``fps``, whose ``fp`` are distinct, in the groups of rows to be compared with each other.

    With ``exact_masks`` every near pair meets in a group. Groups of over GROUP_LIMIT rows are divided. Exactly: by
    further bits, of which every near pair shares a run, until a group's free bits bound it (32 free bits, then 22,
    then 15). Otherwise: where most rows are near one of them, by blocks of which every two are a group, so that no
    pair is lost; elsewhere by sampled further bits, and by blocks what two such divisions leave large.
    """
    rows, done = cut(_groups(fps, masks, width)), []
    for left in (2, 1, 0):
        large = rows.groupBy("key").count().where(F.col("count") > GROUP_LIMIT)
        large = small_side(cut(large))
        if not large.limit(1).count():
            break
        done.append(rows.join(large.select("key"), "key", "left_anti"))
        if not exact:
            together = large if not left else small_side(cut(_tight(rows.join(large.select("key"), "key", "left_semi"), radius)))
            done.append(cut(_in_blocks(rows, together)))
            large = large.join(together.select("key"), "key", "left_anti")
        rows = cut(_refined(rows.join(large.select("key"), "key", "left_semi"), masks, radius, width, exact))
    return reduce(DataFrame.unionByName, [*done, rows]).select("key", "fp")


def by_key(rows: DataFrame, found: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``found`` of all rows of some keys at a time; the rows of a key are never parted."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:  # sorted by key, so the last key of a batch may go on in the next
            if kept is not None:
                pdf = pd.concat([kept, pdf], ignore_index=True)
            last = pdf["key"].to_numpy() == pdf["key"].iloc[-1]
            kept, own = pdf[last], pdf[~last]
            if len(own):
                yield found(own)
        if kept is not None:
            yield found(kept)

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, schema)


def forests(groups: DataFrame, radius: int) -> DataFrame:
    """(a, b, bits, key): a minimum spanning forest of each group's pairs within ``radius``; of a group with more pairs also a row of its key only."""
    def found(own: pd.DataFrame) -> pd.DataFrame:
        raw = own["fp"].to_numpy()
        i, j, bits, more = group_edges(own["key"].to_numpy(), as_rows(own["fp"]), radius)
        swap = np.fromiter((bytes(raw[x]) > bytes(raw[y]) for x, y in zip(i, j)), bool, len(i))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        none = [None] * len(more)
        return pd.DataFrame({"a": [*raw[i], *none], "b": [*raw[j], *none], "bits": pd.array([*bits, *none], "Int32"),
                             "key": pd.array([None] * len(i) + [*more], "Int64")})

    return by_key(groups, found, "a binary, b binary, bits int, key long")


def near_pairs(fps: DataFrame, radius: int, masks: Sequence[int], width: int = 1, exact: bool = True) -> DataFrame:
    """(a, b, bits): of each of ``near_groups`` a minimum spanning forest of the pairs within ``radius`` bits.

    Links by bits alone lose nothing thereby: every near pair of a group is connected through its forest. No
    fingerprint gives no pair.
    """
    return forests(near_groups(fps, radius, masks, width, exact), radius).where("a is not null").groupBy("a", "b").agg(F.min("bits").alias("bits"))


def link_documents(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked, exact copies among them; component_id
    is the smallest doc_id reachable over links. Null and empty texts have fingerprint zero and are linked like any
    other; a null doc_id is never a component_id while another id is reachable. Copies of a text are one fingerprint,
    so a large group costs one row. Repeated rows give repeated results; other columns are not read.
    """
    own = cut(fingerprints(docs, shingle))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = near_pairs(distinct, radius, exact_masks(radius)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    classes = connected_components(edges)
    grouped = distinct.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    grouped = cut(grouped)
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = grouped.join(least, "component").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
