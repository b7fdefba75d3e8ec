"""Comma and tab separated files, by the rules of the splitter in functions.scalars, as built-in expressions.

One record a line. Without a schema the first line is a header, split at every separator, trimmed and unquoted, and
all columns are strings. With a schema no header is expected (header=True skips one), and fields are coerced by
position. A line with another number of fields is left out; rejected_lines() has those. A field that can't be coerced
fails the job. Quotes stay in values. The writer writes a header, and quotes a field that holds a separator or quote.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as types_
from ..errors import SchemaError
from ..flow import PART_BITS, POS, Flow, name_col
from ..functions.scalars import split_delimited
from ..schema import FlowColumn, FlowSchema

#: Files whose places are sent to every task; of more, the places are joined.
MOST_BROADCAST_FILES = 100_000


def header_names(line: str, separator: str) -> list[str]:
    names = [x.strip() for x in line.split(separator)]
    return [x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else x for x in names]


def _without_heads(batches):
    """Drops the first line of each file: where path or block changes and the block is the file's first."""
    last = None
    for batch in batches:
        if len(batch):
            paths, starts = batch.column(2), batch.column(3)
            same = pc.and_(pc.equal(paths[1:], paths[:-1]), pc.equal(starts[1:], starts[:-1]))
            first = pa.array([(paths[0].as_py(), starts[0].as_py()) == last])
            body = pc.or_(pa.concat_arrays([first, same]), pc.not_equal(starts, 0))
            last = paths[-1].as_py(), starts[-1].as_py()
            yield batch.filter(body)


def _file_starts(spark: SparkSession, path: str, unit: int) -> list[tuple[str, int]]:
    """Of each file, in the order of paths, the number of its first block of unit bytes; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    starts, at = [], 0
    for name, size in sorted(map(tuple, files.collect())):  # a row for each file, as Spark's own listing has
        starts.append((name, at))
        at += size // unit + 1
    return starts


def _bytes(spark: SparkSession, name: str, default: int) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, str(default))))


def _lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """value and arrival order: by the files' paths, then by place. header: without the first line of each file.

    Spark deals files out by size, so the partition in an arrival number gives way to the block of the file that the
    lines come from, counted through the files in order of their paths.
    """
    lines = spark.read.text(path).withColumn(POS, F.monotonically_increasing_id())
    unit = min(_bytes(spark, "spark.sql.files.openCostInBytes", 4 << 20), _bytes(spark, "spark.sql.files.maxPartitionBytes", 128 << 20))  # no split is shorter but a file's last
    starts = _file_starts(spark, path, max(1, unit))
    if not header and len(starts) < 2:
        return lines
    placed = lines.select("value", POS, F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"))
    if header:
        placed = placed.mapInArrow(_without_heads, f"value string, {POS} bigint, __path string, __start bigint")
    if len(starts) < 2:
        return placed.select("value", POS)
    bases = spark.createDataFrame(starts, "__path string, __first bigint")
    joined = placed.join(F.broadcast(bases) if len(starts) <= MOST_BROADCAST_FILES else bases, "__path")
    block = F.col("__first") + F.floor(F.col("__start") / max(1, unit)).cast("bigint")
    return joined.select("value", F.shiftleft(block, PART_BITS).bitwiseOR(F.col(POS).bitwiseAND(F.lit((1 << PART_BITS) - 1))).alias(POS))


def _parts(lines: DataFrame, separator: str, n: int) -> tuple[DataFrame, Column]:
    return lines.withColumn("__parts", split_delimited(F.col("value"), separator)), F.size("__parts") == n


def parse_lines(lines: DataFrame, separator: str, schema: FlowSchema | None = None, header: bool | None = None) -> Flow:
    """lines: value and arrival order. header: by default there is one exactly if no schema is given."""
    header = schema is None if header is None else header
    schema = schema or _named(lines, separator)
    if header:
        first = lines.agg(F.min(POS)).first()[0]
        lines = lines.filter(F.col(POS) != F.lit(first)) if first is not None else lines
    return _parsed(lines, separator, schema)


def _named(lines: DataFrame, separator: str) -> FlowSchema:
    first = lines.orderBy(POS).limit(1).collect()
    return FlowSchema.make(*((n, types_.STRING) for n in (header_names(first[0]["value"], separator) if first else [])))


def _parsed(lines: DataFrame, separator: str, schema: FlowSchema) -> Flow:
    if not schema.columns:
        return Flow(lines.select(POS).limit(0), schema)
    parts, fits = _parts(lines, separator, len(schema.columns))
    plain = FlowColumn.make("x", types_.STRING).type
    flow = Flow(parts.filter(fits), schema)
    return flow.select([(types_.coerce(F.col("__parts")[i], plain, c.type), c) for i, c in enumerate(schema.columns)], schema.key)


def read_delimited(spark: SparkSession, path: str, separator: str = ",", schema: FlowSchema | None = None, header: bool | None = None) -> Flow:
    """.gz files are opened as such. Each file of a folder has its own header, in its first split."""
    header = schema is None if header is None else header
    schema = schema or _named(_lines(spark, path), separator)
    return _parsed(_lines(spark, path, header), separator, schema)


def rejected_lines(spark: SparkSession, path: str, separator: str, n: int, header: bool = True) -> DataFrame:
    """value and place of the lines with another number of fields than n."""
    parts, fits = _parts(_lines(spark, path, header), separator, n)
    return parts.filter(~fits).select("value", F.col(POS).alias("place"))


def _text(c: FlowColumn) -> Column:
    if types_.is_nested(c.type):
        raise SchemaError(f"nested column {c.name} has no place in a delimited file")
    return types_.coerce(name_col(c.name), c.type, types_.SPARK[types_.STRING])


def quoted(text: Column, separator: str) -> Column:
    risky = text.contains(separator) | text.contains('"') | text.contains("'")
    mark = F.when(text.contains('"'), F.lit("'")).otherwise(F.lit('"'))
    return F.when(risky, F.concat(mark, text, mark)).otherwise(text)


def rendered(flow: Flow, separator: str) -> DataFrame:
    """Lines of the flow's rows, without header: value, and arrival order where there is one."""
    line = F.concat_ws(separator, *[F.coalesce(quoted(_text(c), separator), F.lit("")) for c in flow.schema.columns])
    return flow.df.select(line.alias("value"), *([POS] if flow.has_pos else []))


def header_line(schema: FlowSchema, separator: str) -> str:
    def quote(x: str) -> str:
        mark = "'" if '"' in x else '"'
        return f"{mark}{x}{mark}" if separator in x or '"' in x or "'" in x else x

    return separator.join(map(quote, schema.names))


def write_delimited(flow: Flow, path: str, separator: str = ",", compression: str = "none", single: bool = False) -> None:
    """A folder of part files in the flow's order, each with a header; single: one part, for small results."""
    if flow.has_pos or flow.schema.key.orderings:
        flow, order = flow.in_order()
        flow = flow.with_df(flow.df.orderBy(*order) if single else flow.df.repartitionByRange(*order).sortWithinPartitions(*order) if flow.schema.key.orderings else flow.df)
    lines = rendered(flow, separator)
    if single:
        lines = lines.coalesce(1)
    head = header_line(flow.schema, separator)

    def with_header(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [head]})
        for b in batches:
            yield b[["value"]]

    lines.select("value").mapInPandas(with_header, "value string").write.mode("overwrite").option("compression", compression).text(path)
