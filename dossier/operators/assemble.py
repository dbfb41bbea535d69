"""Ordered assembly of lines into documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_BYTES = 64 * 1024 * 1024
# With a known total that allows no more cut documents than this, the list of cuts is broadcast.
MAX_CUTS = 1 << 20
# Order values of a span: bytes are summed per span, then over the spans of a cut document.
SPAN_BITS = 12
# Documents are first summed by hash, in so many sums per part that all lines could fill: few sums
# reach the size of a part then, and only their documents are looked at one by one.
SUMS_PER_PART, MAX_SUMS = 16, 1 << 20


def _column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _starts(lines: DataFrame, by: list[str], part_bytes: int) -> DataFrame:
    """Per span of the documents that exceed ``part_bytes``: the bytes of earlier spans (``_start``),
    the document's last order value, and the bytes in which the lines of a part begin (``_begin``),
    so many that a part of lines up to half of ``part_bytes`` keeps within it.

    Bytes are summed per span before their shuffle; a document's spans then meet without its lines.
    """
    spans = lines.groupBy(*by, "_span").agg(
        F.sum("_size").alias("_bytes"), F.max("_size").alias("_longest"), F.max("_ord").alias("_last")
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.lit(part_bytes) - F.least(F.max("_longest").over(whole), F.lit(part_bytes // 2))
    return (
        spans.select(
            *by,
            "_span",
            F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_bytes").over(whole).alias("_total"),
            F.greatest(begin, F.lit(1)).alias("_begin"),
            F.max("_last").over(whole).alias("_end"),
        )
        .filter(F.col("_total") > part_bytes)
        .drop("_total")
    )


def _of_large_sums(lines: DataFrame, by: list[str], part_bytes: int, total_bytes: int) -> DataFrame:
    """The lines of all documents above ``part_bytes``, and few others.

    Without a row per document or span: a sum by hash is at least as large as any document in it,
    and at most ``MAX_CUTS`` sums are that large.
    """
    sums = min(SUMS_PER_PART * (total_bytes // part_bytes + 1), MAX_SUMS)
    hashed = lines.withColumn("_sum", F.pmod(F.xxhash64(*by), F.lit(sums)))
    large = hashed.groupBy("_sum").agg(F.sum("_size").alias("_bytes"))
    large = F.broadcast(large.filter(F.col("_bytes") > part_bytes).select("_sum"))
    return hashed.join(large, "_sum", "left_semi").drop("_sum")


def _placed(lines: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """``part_no`` by the bytes that precede a line: those of earlier spans, then those of its own."""
    inside = Window.partitionBy(*by, "_span").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return lines.join(starts, [*by, "_span"], "left").withColumn("_before", before).withColumn(
        "part_no", F.coalesce(F.expr("_before div _begin"), F.lit(0).cast("long"))
    )


def assemble(
    lines: DataFrame,
    by: Sequence[str],
    *,
    order: str = "ord",
    text: str = "text",
    separator: Column | str = "\n",
    header: Column | str = "",
    footer: Column | str = "",
    part_bytes: int | None = PART_BYTES,
    size: str | None = None,
    total_bytes: int | None = None,
) -> DataFrame:
    """Join the lines of every ``by`` group in ``order`` between a header and a footer.

    ``separator``, ``header`` and ``footer`` may depend on the ``by`` columns; ``order`` is a
    unique whole number >= 0 per group. Returns ``by``, ``part_no``, ``whole`` and ``content``.

    A document of up to ``part_bytes`` is one ``whole`` row with ``part_no`` 0. A larger one is
    several rows, cut by its running bytes, of at most ``part_bytes`` each where no line is longer
    than half of that; a longer line makes the part it begins in longer, and no other. Their contents
    in ``part_no`` order (which may have gaps) concatenate to the document, so no group is ever
    gathered whole and a document that holds most of the lines spreads over many tasks. With
    ``total_bytes``, a measured bound of all line sizes that allows at most ``MAX_CUTS`` cut
    documents, their short list is broadcast, and only their lines are shuffled to be placed; the
    parts are the same. ``part_bytes=None`` skips the size check for documents known to be short.
    ``size`` names a column with the bytes of a line, for lines that are stored and need no second
    rendering.
    """
    by = list(by)
    gap = _column(separator)
    written = F.col(size) if size else F.octet_length(text)
    lines = lines.select(
        *by,
        F.col(order).cast("long").alias("_ord"),
        F.concat(gap, F.col(text)).alias("_text"),
        (written + F.octet_length(gap)).cast("long").alias("_size"),
    )
    if part_bytes is None:
        placed = lines.withColumn("part_no", F.lit(0).cast("long"))
        is_last = F.lit(True)
        edges = []
    else:
        lines = lines.withColumn("_span", F.shiftright("_ord", SPAN_BITS))
        if total_bytes is None or total_bytes // part_bytes > MAX_CUTS:
            placed = _placed(lines, _starts(lines, by, part_bytes), by)
        else:
            starts = _starts(_of_large_sums(lines, by, part_bytes, total_bytes), by, part_bytes)
            few = F.broadcast(starts.select(*by).distinct())
            cut = _placed(lines.join(few, by, "left_semi"), starts, by)
            short = lines.join(few, by, "left_anti").select(
                *lines.columns,
                *[F.lit(None).cast("long").alias(c) for c in ("_start", "_begin", "_end", "_before")],
                F.lit(0).cast("long").alias("part_no"),
            )
            placed = cut.unionByName(short)
        edges = [F.max("_end").alias("_end"), F.max("_ord").alias("_last")]
        is_last = F.coalesce(F.col("_last") == F.col("_end"), F.lit(True))
    is_first = F.col("part_no") == 0

    parts = placed.groupBy(*by, "part_no").agg(
        F.expr("listagg(_text, '') WITHIN GROUP (ORDER BY _ord)").alias("_body"), *edges
    )
    body = F.col("_body")
    opened = F.concat(
        _column(header),
        body.substr(F.length(gap) + 1, F.length(body)),
    )
    content = F.when(is_first, opened).otherwise(body)
    content = F.when(is_last, F.concat(content, _column(footer))).otherwise(content)
    return parts.select(
        *by, "part_no", (is_first & is_last).alias("whole"), content.alias("content")
    )
