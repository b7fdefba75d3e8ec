"""Document fingerprints from closed syncmers, with built-in functions only.

A text is a sequence of units: a word of up to WORD letters or digits with the space before it, or one character. Each
letter of a longer run is a unit, and so is each of a script that is written without spaces, so no unit is counted off
from a place far away: what a character is part of is settled within WORD characters of it. A k-mer of units is chosen
where the least hash among its inner s-mers is at its first or last place. Whether it is chosen depends on nothing
outside it, so equal passages have equal anchors wherever they stand, and an edit moves only the anchors of the k-mers
that it touches. The fingerprint is the sequence of the anchors' 24-bit hashes as six hex digits each; likeness is the
Dice share of common anchors.

Each text is compared to the next one by ascending id. Rows are dealt into ranges by id and a hash of the text, at
bounds drawn from a sample, and the row at which a range begins also goes to the range before it, so the next row is
always at hand within a range. Rows that repeat both id and text in such numbers that several bounds fall on them are
dealt out over ranges of their own, where each is its own next.

Scale: one shuffle of the texts; a range holds a like share of rows, and is sorted with spilling. The driver gets a
sample of ids and hashes, SAMPLE_A_RANGE for each of at most MOST_RANGES ranges.

Defined results: null text counts as empty; the empty text has an empty fingerprint, like itself (1) and unlike any
other (0); every other text has an anchor. K-mers are sure to have one chosen among them from 2K - S - 1 units on;
texts of fewer units have all their S-mers as anchors and then their chosen k-mers, if any, so a copy on either side of
that bound shares some with most; those of fewer than S units have the text itself as anchor; null ids come first; rows
of equal id follow each other by a hash of their texts; after the last row comes the first; texts of any length are
read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, whole

K, S = 8, 2
#: Letters of the longest word that is one unit.
WORD = 16
_UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
_LETTER = rf"[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]"
UNIT = rf"(?s) ?(?<!{_LETTER}){_LETTER}{{1,{WORD}}}+(?!{_LETTER})|."
ROWS_A_RANGE, SAMPLE_A_RANGE, MOST_RANGES = 256, 8, 1 << 16
_SIDE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of the anchors' 24-bit hashes, in order."""
    window = k - s + 1
    sure = 2 * (k - s)  # with so many s-mers, k - s k-mers in a row, one of them is chosen
    short = F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.array(F.hash(text).bitwiseAND(F.lit(0xFFFFFF))))

    def chosen(smers: Column) -> Column:
        starts = F.slice(smers, 1, F.size(smers) - (window - 1))
        last = lambda i: F.get(smers, i + (window - 1))
        mark = lambda x, i: F.when(
            F.least(x, last(i)) <= F.array_min(F.slice(smers, i + 1, window)),
            F.hash(*[F.get(smers, i + j) for j in range(0, window - 1, s)], last(i)).bitwiseAND(F.lit(0xFFFFFF)),
        )
        return F.array_compact(F.transform(starts, mark))

    few = lambda smers: F.transform(smers, lambda x: x.bitwiseAND(F.lit(0xFFFFFF)))

    def by_size(smers: Column) -> Column:
        n = F.size(smers)
        return F.when(n >= sure, chosen(smers)).when(n >= window, F.concat(few(smers), chosen(smers))).when(n > 0, few(smers)).otherwise(short)

    def inner(hashes: Column) -> Column:
        count = F.greatest(F.size(hashes) - (s - 1), F.lit(0))
        return F.transform(F.slice(hashes, 1, count), lambda h, i: F.hash(h, *[F.get(hashes, i + j) for j in range(1, s)]))

    hashes = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.hash(u))
    return let(let(hashes, inner), by_size)


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda a: F.lpad(F.lower(F.hex(a)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Dice share of the distinct anchors; only empty texts have none, so without any the texts are equal."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint."""
    return docs.select(F.col(id_col).alias("doc_id"), as_text(anchors(whole(text_col))).alias("fingerprint"))


def _place(ident: Column, text: Column) -> Column:
    """A string whose order is that of the rows: null ids first, then by id, then by a hash of the text."""
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # noqa: E731  signed order as that of the digits
    return F.concat(F.when(ident.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(digits(ident), F.lit("0" * 16)), digits(F.xxhash64(text)))


def _listed(values, kind: str) -> Column:
    """A constant array, whatever its size one literal of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _reached(at: Column, bounds: list[str]) -> Column:
    """How many of the ascending bounds are not above at: _SIDE of them are looked at on each of the levels."""
    levels = [bounds]
    while len(levels[-1]) > _SIDE:
        levels.append(levels[-1][::_SIDE])
    def count(held: Column) -> Column:
        return F.size(F.filter(held, lambda b: b <= at))

    def finer(held: Column, found: Column) -> Column:
        return let(F.greatest(found - 1, F.lit(0)) * _SIDE, lambda first: first + count(F.slice(held, first + 1, _SIDE)))

    found = count(_listed(levels.pop(), "string"))
    while levels:
        found = finer(_listed(levels.pop(), "string"), found)
    return found


def _in_ranges(rows: DataFrame, at: str) -> DataFrame:
    """rows with range and copy: copy 0 is the row, others are copies for the row before it. same: all rows of the range are alike."""
    n, low = rows.agg(F.count("*"), F.min(at)).first()
    wanted = min(MOST_RANGES, max(1, n // ROWS_A_RANGE))
    share = min(1.0, SAMPLE_A_RANGE * wanted / max(1, n))
    sample = sorted(r[0] for r in rows.select(at).sample(share, 17).collect()) if wanted > 1 else []
    drawn = Counter(b for b in sample[SAMPLE_A_RANGE - 1 :: SAMPLE_A_RANGE] if b != low)
    bounds = [low or "", *sorted(drawn)]
    times = [1, *(drawn[b] for b in bounds[1:])]  # over one: so many ranges for the rows at this bound alone
    if low is not None:
        times[0] = max(1, sum(b == low for b in sample) // SAMPLE_A_RANGE)
    spare, more = [], len(bounds)
    for t in times:
        spare.append(more)
        more += t - 1
    rows = rows.withColumn("own_range", _reached(F.col(at), bounds) - 1)
    of = lambda values, kind: F.get(_listed(values, kind), F.col("own_range"))
    starts = of(bounds, "string") == F.col(at)
    # without hot rows there is nothing to draw
    hot = F.when(starts, F.floor(F.rand(17) * of(times, "int"))).otherwise(0).cast("int") if any(t > 1 for t in times) else F.lit(0)
    rows = rows.withColumn("spare", hot)
    place = lambda where, copy, same: F.struct(where.cast("int").alias("range"), F.lit(copy).alias("copy"), same.alias("same"))
    normal, no = F.col("spare") == 0, F.lit(False)
    places = F.array_compact(F.array(
        F.when(normal, place(F.col("own_range"), 0, no)).otherwise(place(of(spare, "int") + F.col("spare") - 1, 0, F.lit(True))),
        F.when(normal & starts & (F.col("own_range") > 0), place(F.col("own_range") - 1, 1, no)),
        F.when(normal & (F.col(at) == F.lit(low or "")), place(F.lit(len(bounds) - 1), 2, no)),
    ))
    return rows.withColumn("place", F.explode(places)).drop("own_range", "spare").select("*", "place.range", "place.copy", "place.same").drop("place")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 4) characters replaced by the first as many, or all, of
    the next text.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    source = source.withColumn("at", _place(F.col("doc_id"), F.col("text")))
    dealt = _in_ranges(source, "at").repartition(partitions(docs.sparkSession), "range").withColumn("own", anchors(F.col("text")))
    order = W.partitionBy("range").orderBy("copy", "at", "text")
    after = lambda c: F.coalesce(F.lead(c).over(order), F.when(F.col("same"), F.col(c)))
    pairs = dealt.withColumns({"next_text": after("text"), "next_own": after("own")}).filter("copy = 0")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    done = pairs.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "own", "next_own").withColumn("changed", anchors(F.col("edited")))
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
