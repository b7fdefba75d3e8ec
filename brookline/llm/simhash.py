"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64 majority bits over the hashes of a text's word shingles. Two distinct fingerprints within three
bits share one of four 16-bit blocks, and, that block aside, one of four 12-bit parts of the rest: sixteen tables of
28-bit keys find every such pair. Rows of a table sorted by key stand in groups; their fingerprints are stored as 64
vertical bit planes. All pairs (i, i + d) of a distance d in the order are compared at once: planes are shifted by d
and XORed, the differing bits are counted by carry-save counters (ones, twos, over), and blocks of 64 pairs of which
all are over the radius, in different groups or already linked are abandoned. A group gives links that span its
components, never all its pairs; components of the links are then found over the cluster.

Scale: texts are read once and never shuffled; what moves is 16 rows of 16 bytes per distinct fingerprint, so copies
cost nothing. A key group above GROUP is split by what its key leaves out: of four 9-bit parts of the other 36 bits, a
pair within three bits shares one, so four rows each go to groups that are some 500 times smaller. What is still above
GROUP after that is dealt out as pairs of tiles, so no task gets more than two tiles of it.

Defined results: null and empty texts have fingerprint zero and are linked like any other; fewer words than a
shingle make one shingle; null doc_id takes part but is never a component's id unless all of its ids are null;
repeated rows each have a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, portions, rows_of, sliced, staged, whole, worker_state
from .components import connected_components

WORDS = 3
RADIUS = 3
SEED = 42
#: Rows of a key group that one task compares at most (two tiles of half of it).
GROUP = 8192
#: Bytes of a text that are held as words at a time.
CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_DIGESTED = _PRINTS.append(pa.field("sha", pa.binary()))
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _add(words: list[bytes], size: int, ones: np.ndarray) -> int:
    """Adds the bits of the shingles' hashes to ones; returns their number."""
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(text[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64)
    ones += bits.sum(axis=0, dtype=np.int64)
    return len(hashes)


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8."""
    ones, n, held, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        gap = _SPACE.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        held += text[at:end].lower().split()
        at = end
        if len(held) >= size:
            n += _add(held, size, ones)
            held = held[len(held) - size + 1 :]
    if not n:
        if not held:
            return 0
        n = _add(held, len(held), ones)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int, digest: bool):
    def run(batches):
        worker_state("simhash", lambda: True)

        def rows():
            for ids, texts in portions(batches):
                for doc_id, text in zip(ids, texts):
                    fp = fingerprint(text, size)
                    fp = fp - (1 << 64) if fp >> 63 else fp
                    yield (doc_id, fp, hashlib.sha256(text).digest()) if digest else (doc_id, fp)

        return sliced(rows(), _DIGESTED if digest else _PRINTS)

    return run


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, digest: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed integer); with digest also sha, the text's SHA-256."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).cast("binary").alias("text"))
    return source.mapInArrow(_fingerprints(words, digest), "doc_id bigint, fp bigint" + ", sha binary" * digest)


def _without(value: Column, at: int, width: int, whole_width: int) -> Column:
    """The bits of value but for width of them from at on."""
    low = value.bitwiseAND(F.lit((1 << at) - 1))
    return low if at + width >= whole_width else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, at + width), at))


def _tables(fp: Column) -> list[tuple[Column, Column]]:
    """Of each of the sixteen tables its key, with the table's number in front, and the other 36 bits."""
    found = []
    for i in range(4):
        block, rest = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)), _without(fp, 16 * i, 16, 64)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            found.append((F.shiftleft(block, 12).bitwiseOR(part).bitwiseOR(F.lit((4 * i + j) << 28)), _without(rest, 12 * j, 12, 48)))
    return found


def _keys(fp: Column) -> Column:
    return F.array(*[key for key, _ in _tables(fp)])


def _parts(fp: Column, key: Column) -> Column:
    """The four 9-bit parts of what a key leaves out, each with its number in front."""
    other = F.get(F.array(*[rest for _, rest in _tables(fp)]), F.shiftright(key, 28).cast("int"))
    return F.transform(F.array(other), lambda x: F.array(*[F.shiftrightunsigned(x, 9 * p).bitwiseAND(F.lit(511)).bitwiseOR(F.lit(p << 9)) for p in range(4)]))[0]


def _pack(bits: np.ndarray, n_words: int) -> np.ndarray:
    out = np.zeros(n_words * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _within(planes: np.ndarray, d: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Of the pairs (i, i + d) whose bit is set in alive: those within the radius (3 at most), as bits."""
    blocks = np.flatnonzero(alive)
    out = np.zeros_like(alive)
    live = alive[blocks]
    ones, twos, over = np.zeros_like(live), np.zeros_like(live), np.zeros_like(live)
    skip, shift = divmod(d, 64)
    for k, plane in enumerate(planes):
        moved = plane[blocks + skip]
        if shift:
            moved = (moved >> np.uint64(shift)) | (plane[blocks + skip + 1] << np.uint64(64 - shift))
        x = plane[blocks] ^ moved
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if k % 8 == 7:
            live &= ~over
            kept = live != 0
            if not kept.all():  # abandon blocks
                blocks, live, ones, twos, over = blocks[kept], live[kept], ones[kept], twos[kept], over[kept]
                if not len(blocks):
                    return out
    if radius < 3:
        over |= twos if radius < 2 else twos & ones
        over |= ones if radius < 1 else np.uint64(0)
    out[blocks] = live & ~over
    return out


def links_within(groups: np.ndarray, prints: np.ndarray, radius: int = RADIUS):
    """Links (a, b) that span the components of each group; equal groups are neighbours."""
    n = len(groups)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.repeat(np.diff(np.r_[starts, n]), np.diff(np.r_[starts, n]))
    rows, d, cut_at = np.arange(n), 1, 0
    while True:
        if d > cut_at:  # go on with the rows of groups that have pairs at this distance
            rows = rows[sizes[rows] > d]
            if not len(rows):
                return
            cut_at = 2 * d if d > 4 else d
            words = len(rows) // 64 + 1
            own, held = groups[rows], prints[rows].view(np.uint64)
            planes = np.zeros((64, words + d // 64 + cut_at // 64 + 3), np.uint64)
            for k in range(64):
                planes[k, :words] = _pack((held >> np.uint64(k)) & np.uint64(1) != 0, words)
            roots = parent[rows]
        pairs = (own[:-d] == own[d:]) if d < len(rows) else np.zeros(0, bool)
        if pairs.any():
            alive = pairs & (roots[:-d] != roots[d:])
            hits = np.flatnonzero(np.unpackbits(_within(planes, d, _pack(alive, words), radius).view(np.uint8), bitorder="little")) if alive.any() else ()
            for i in hits:
                a, b = root(rows[i]), root(rows[i + d])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    yield int(prints[rows[i]]), int(prints[rows[i + d]])
            if len(hits):
                while (higher := parent[parent]).tobytes() != parent.tobytes():
                    parent = higher
                roots = parent[rows]
        d += 1


def _compare(radius: int):
    """Rows (key, part, tile, fp), sorted, to links; a chunk ends where a group does."""

    def links(*columns):
        *names, prints = columns
        groups = np.cumsum(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in names])])
        return links_within(groups, prints, radius)

    def run(batches):
        def rows():
            held = [np.zeros(0, np.int64)] * 4
            for batch in batches:
                held = [np.r_[h, c.to_numpy(zero_copy_only=False)] for h, c in zip(held, batch.columns)]
                if len(held[0]) >= 65536:
                    same = np.logical_and.reduce([c == c[-1] for c in held[:-1]])
                    end = int(np.argmax(same))
                    if end:
                        yield from links(*(h[:end] for h in held))
                        held = [h[end:] for h in held]
            if len(held[0]):
                yield from links(*held)

        return sliced(rows(), _LINKS, most_rows=65536)

    return run


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """a, b: links between the distinct fingerprints (column fp) that span their components."""
    n = partitions(prints.sparkSession)
    none = F.lit(-1).cast("bigint")
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    hot = staged(keyed.groupBy("key").count().filter(F.col("count") > group).select("key", F.lit(True).alias("hot")), "hot")
    if hot.isEmpty():
        dealt = keyed.withColumns({"part": none, "tile": none})
    else:
        split = keyed.join(hot, "key", "left").select("fp", "key", F.explode(F.when(F.col("hot").isNull(), F.array(none)).otherwise(_parts(F.col("fp"), F.col("key")))).alias("part"))
        counts = split.filter("part >= 0").groupBy("key", "part").count().filter(F.col("count") > group)
        large = staged(counts.select("key", "part", F.ceil(F.col("count") / (group // 2)).cast("bigint").alias("tiles")), "large")
        own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
        pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1), lambda p: F.least(p, own) * (1 << 30) + F.greatest(p, own))
        dealt = split.join(large, ["key", "part"], "left").select("fp", "key", "part", F.explode(F.when(F.col("tiles").isNull(), F.array(none)).otherwise(pair)).alias("tile"))
    sorted_ = dealt.select("key", "part", "tile", "fp").repartition(n, "key", "part", "tile").sortWithinPartitions("key", "part", "tile", "fp")
    return sorted_.mapInArrow(_compare(radius), "a bigint, b bigint")


def _rooted(prints: DataFrame, radius: int, group: int) -> DataFrame:
    """fp, root, least (the smallest doc_id of this fingerprint), one row per distinct fingerprint."""
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    stars = connected_components(fingerprint_links(distinct, radius, group))
    return distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id: one row per input row."""
    prints = staged(simhash_fingerprints(docs, id_col, text_col, words), "prints")
    rooted = _rooted(prints, radius, group)
    named = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")  # a table, so that the join of a large component can be split
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """One row of each component stays, that of the smallest id (null last, ties by a digest of the text); all columns stay."""
    prints = staged(simhash_fingerprints(docs, id_col, text_col, words, digest=True), "prints")
    rooted = _rooted(prints, radius, group)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("sha"))).alias("first")
    kept = prints.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(first)
    kept = kept.select("first.doc_id", F.lower(F.hex("first.sha")).alias("text_sha256"))
    return rows_of(docs, kept, id_col, text_col)
