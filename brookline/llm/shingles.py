"""SimHash near-dedup verified by true similarity: Jaccard of the sets of word shingles, SIMILAR (4/5) or more.

Candidates are, first, all pairs of sets whose SimHash fingerprints (majority bits over a set's shingles) differ in
three bits or less, by the tables and the bit-sliced comparison of simhash, which miss none. At a similarity of 0.8
fingerprints differ in some ten bits, which no such tables reach. So, second, candidates beyond that radius come from
minhashes: BANDS keys of ROWS minhashes each, so a pair of similarity 0.8 shares no key with probability 1.1e-4, and a
closer one with less. Rows that share a key or have near fingerprints hang on one of them, and components of that are
the groups within which every pair is decided by counting common shingles, whatever made it a candidate. A group is
searched breadth first with an index from shingle to rows; rows that are linked leave it, so a group of near copies
costs about a pass over its shingles. Components of the verified links are then found over the cluster.

Scale: texts are read once for fingerprints and keys (30 of 8 bytes a row, 16 bytes each in a shuffle; 16 rows of 16
bytes a distinct fingerprint in another), and shuffled once to find those in groups, as they are to find kept rows. A
group above GROUP shingles is dealt out as pairs of tiles, so no task gets more than two tiles of it, and a row of it
goes to as many tasks as there are tiles.

Defined results: words are parted by white space and compared with ASCII letters in lower case; fewer words than a
shingle make one shingle; null and empty texts are copies of each other; the rest is as in simhash.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, portions, rows_of, sliced, staged, whole, worker_state
from .components import connected_components
from .simhash import _LINKS, _SPACE, CHUNK, SEED, fingerprint_links

WORDS = 5
#: Numerator and denominator of the least similarity.
SIMILAR = (4, 5)
BANDS, ROWS = 30, 6
#: Shingles of a group that one task compares at most (two tiles of half of it, or two texts).
GROUP = 1 << 20
_KEYED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("simhash", pa.int64()), ("keys", pa.list_(pa.int64()))])
_draw = np.random.default_rng(SEED)
_TIMES = (_draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)) | np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending."""
    digest, found, held, at, some = xxhash.xxh64_intdigest, [], [], 0, False

    def add(words: list[bytes], size: int) -> None:
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        found.append(np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])], np.uint64)))

    while at < len(text):
        gap = _SPACE.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        held += text[at:end].lower().split()
        at = end
        if len(held) >= size:
            add(held, size)
            held, some = held[len(held) - size + 1 :], True
    if held and not some:
        add(held, len(held))
    if len(found) == 1:
        return found[0]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set, each shingle once, as a signed integer; zero if it is empty."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of a set, as signed integers."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 256):
        np.minimum(least, (_TIMES * low[i : i + 256] + _PLUS).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _name(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _keyed(size: int):
    def run(batches):
        worker_state("shingles", lambda: True)

        def rows():
            for ids, texts in portions(batches):
                for doc_id, text in zip(ids, texts):
                    found = shingles(text, size)
                    yield doc_id, _name(found), hashlib.sha256(text).digest(), len(found), set_fingerprint(found), band_keys(found)

        return sliced(rows(), _KEYED, lambda r: 400)

    return run


def links_between(names: list[int], sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR):
    """Links (a, b) that span the components of the pairs that are similar enough; every pair is decided."""
    top, bottom = similar
    sizes = np.array([len(s) for s in sets], np.int64)
    left, indexed = np.ones(len(sets), bool), 0
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start] = False
        waiting = [start]
        while waiting:
            x, n_left = waiting.pop(), int(left.sum())
            if not n_left:
                continue
            if not indexed or 2 * n_left < indexed:
                own = np.flatnonzero(left)
                values = np.concatenate([sets[i] for i in own])
                order = np.argsort(values, kind="stable")
                values, owners, indexed = values[order], np.repeat(own, sizes[own])[order], n_left
            first, last = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
            many = last - first
            at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(owners[at], minlength=len(sets))
            hits = np.flatnonzero(left & (bottom * common >= top * (sizes[x] + sizes - common)))
            left[hits] = False
            waiting += hits.tolist()
            for y in hits:
                yield names[x], names[y]


def _verify(size: int, similar: tuple[int, int]):
    """Rows (root, tile, fp, text), sorted, to links."""

    def run(batches):
        worker_state("shingles", lambda: True)

        def rows():
            at, names, sets = None, [], []
            for roots, tiles, prints, texts in portions(batches):
                for root, tile, fp, text in zip(roots, tiles, prints, texts):
                    if at != (root, tile):
                        yield from links_between(names, sets, similar)
                        at, names, sets = (root, tile), [], []
                    if not names or names[-1] != fp:  # repeated rows follow each other
                        names.append(fp)
                        sets.append(shingles(text, size))
            yield from links_between(names, sets, similar)

        return sliced(rows(), _LINKS, most_rows=65536)

    return run


def fingerprint_candidates(prints: DataFrame) -> DataFrame:
    """a, b: links between sets (by fp) that span the components of those whose fingerprints (simhash) are within the radius."""
    firsts = staged(prints.groupBy("simhash").agg(F.min("fp").alias("first")), "firsts")
    same = prints.join(firsts, "simhash").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = fingerprint_links(firsts.select(F.col("simhash").alias("fp")))
    for end in "ab":
        near = near.join(firsts.select(F.col("simhash").alias(end), F.col("first").alias(f"first_{end}")), end)
    return same.unionByName(near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def similar_links(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, words: int, similar: tuple[int, int], group: int) -> DataFrame:
    """a, b: links between sets (by fp) that span the components of those similar enough."""
    keyed = prints.select("fp", F.explode("keys").alias("key"))
    shared = staged(keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("key", "a"), "shared")
    banded = keyed.join(shared, "key").filter("fp <> a").select("a", F.col("fp").alias("b"))
    stars = connected_components(fingerprint_candidates(prints).unionByName(banded))
    members = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("sha"))).alias("first")
    loose = prints.select("fp", "doc_id", "sha", "n").join(members, F.col("fp") == F.col("node")).groupBy("fp", "root").agg(first, F.first("n").alias("n"))
    loose = staged(loose.select("fp", "root", "n", "first.doc_id", F.lower(F.hex("first.sha")).alias("sha")), "loose")
    large = loose.groupBy("root").agg(F.sum("n").alias("n")).filter(F.col("n") > group)
    large = staged(large.select("root", F.ceil(F.col("n") / (group // 2)).cast("bigint").alias("tiles")), "large")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1), lambda p: F.least(p, own) * (1 << 30) + F.greatest(p, own))
    tile = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(pair)).alias("__tile")
    place = lambda ident, sha: (F.coalesce(ident, F.lit(0)).alias("__id"), ident.isNull().alias("__none"), sha.alias("__sha"))
    placed = loose.join(large, "root", "left").select(*place(F.col("doc_id"), F.col("sha")), F.col("root").alias("__root"), F.col("fp").alias("__fp"), tile)
    texts = docs.select(*place(F.col(id_col).cast("bigint"), F.sha2(whole(text_col), 256)), whole(text_col).cast("binary").alias("__text"))
    rows = texts.join(placed, ["__id", "__none", "__sha"]).select("__root", "__tile", "__fp", "__text")
    rows = rows.repartition(partitions(docs.sparkSession), "__root", "__tile").sortWithinPartitions("__root", "__tile", "__fp")
    return rows.mapInArrow(_verify(words, similar), "a bigint, b bigint")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: tuple[int, int] = SIMILAR, group: int = GROUP) -> DataFrame:
    """One row of each component stays, that of the smallest id (null last, ties by a digest of the text); all columns stay."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).cast("binary").alias("text"))
    prints = staged(source.mapInArrow(_keyed(words), "doc_id bigint, fp bigint, sha binary, n bigint, simhash bigint, keys array<bigint>"), "prints")
    stars = connected_components(similar_links(docs, prints, id_col, text_col, words, similar, group))
    rooted = prints.select("doc_id", "sha", "fp").join(stars, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("sha"))).alias("first")
    kept = rooted.groupBy("root").agg(first).select("first.doc_id", F.lower(F.hex("first.sha")).alias("text_sha256"))
    return rows_of(docs, kept, id_col, text_col)
