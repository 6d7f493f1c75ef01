"""Texts and tables cut into chunks whose source offsets are exact.

`chunks` cuts by an ordered list of separators: the first one that a stretch holds cuts it, a separator stays with what
follows it, pieces are joined up to `size` characters, each chunk begins with up to `overlap` characters of the one
before, and a piece that is too long by itself is cut by the next separator. Everything is done on offsets, so that
`substring(text, source_start + 1, source_end - source_start)` is the chunk by construction.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The separators in their order.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "? ", "! ", " ", "")
Span = tuple[int, int]


def cut(text: str, start: int, end: int, separator: str) -> list[Span]:
    """Stretches of text[start:end] that begin where the separator does."""
    if not separator:
        return [(i, i + 1) for i in range(start, end)]
    marks, at = [start], text.find(separator, start, end)
    while at >= 0:
        marks.append(at)
        at = text.find(separator, at + len(separator), end)
    return [(a, z) for a, z in zip(marks, [*marks[1:], end], strict=True) if z > a]


def joined(parts: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Adjacent stretches as chunks of at most size; the next one keeps as many whole stretches of the last as overlap holds."""
    first = 0
    for k, (_, end) in enumerate(parts):
        if first < k and end - parts[first][0] > size:
            yield parts[first][0], parts[k - 1][1]
            while first < k and (parts[k - 1][1] - parts[first][0] > overlap or end - parts[first][0] > size):
                first += 1
    if parts:
        yield parts[first][0], parts[-1][1]


def spans(text: str, size: int = 1000, overlap: int = 120, separators: tuple[str, ...] = SEPARATORS) -> Iterator[Span]:
    """Offsets of the chunks of a text, without the blanks at their ends; blank ones are left out."""
    for a, z in _raw_spans(text, 0, len(text), size, overlap, separators):
        part = text[a:z]
        a += len(part) - len(part.lstrip())
        if a < z:
            yield a, a + len(part.strip())


def _raw_spans(text: str, start: int, end: int, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[Span]:
    level = next((i for i, s in enumerate(separators) if not s or text.find(s, start, end) >= 0), len(separators))
    if level == len(separators):
        yield from joined([(start, end)], size, overlap)
        return
    waiting: list[Span] = []
    for a, z in cut(text, start, end, separators[level]):
        if z - a < size:
            waiting.append((a, z))
            continue
        yield from joined(waiting, size, overlap)
        waiting = []
        if separators[level + 1 :]:
            yield from _raw_spans(text, a, z, size, overlap, separators[level + 1 :])
        else:
            yield a, z
    yield from joined(waiting, size, overlap)


def chunks(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = 1000, overlap: int = 120, whole: bool = False) -> DataFrame:
    """The id, seq (from 0), chunk, source_start, source_end, line (from 1), n_chars and span_hash of each chunk.

    whole: a text is one chunk. Null and blank texts have none.
    """
    if overlap >= size:
        raise ValueError(f"overlap {overlap} must be less than size {size}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                if not text or not text.strip():
                    continue
                found = [(0, len(text))] if whole else [x for x in spans(text, size, overlap) if x[0] < x[1]]
                line, last, lines = 1, 0, []
                for a, _ in found:
                    line += text.count("\n", last, a) if a >= last else -text.count("\n", a, last)
                    last = a
                    lines.append(line)
                n = len(found)
                ids = pa.array([batch.column("id")[k].as_py()] * n, batch.schema.field("id").type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(n), pa.int64()), pa.array([text[a:z] for a, z in found], pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([z for _, z in found], pa.int64()), pa.array(lines, pa.int64())], names=["id", "seq", "chunk", "source_start", "source_end", "line"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(run, f"id {kind}, seq long, chunk string, source_start long, source_end long, line long")
    return found.select(F.col("id").alias(id_column), "seq", "chunk", "source_start", "source_end", "line", F.length("chunk").cast("long").alias("n_chars"), F.left(F.sha2("chunk", 256), F.lit(16)).alias("span_hash"))


def sections(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", levels: int = 4) -> DataFrame:
    """The id, section (from 0, which is what stands before any heading), path (its headings), source_start, source_end and body of each Markdown section.

    A heading has one to `levels` number signs and a blank; what lies in a code fence is no heading. A section without a body is left out.
    """
    lines = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(text_column, "\n")).alias("pos", "line"))
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.startswith(F.ltrim("line"), F.lit("```")).cast("int")
    marked = lines.select("id", "pos", "line", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("start"), (fence + F.sum(fence).over(upto) % 2).alias("fenced"))
    signs = F.regexp_extract("line", f"^(#{{1,{levels}}})[ \\t]+[^ \\t]", 1)
    headed = marked.withColumn("level", F.when((F.col("fenced") == 0) & (signs != ""), F.length(signs)))
    title = F.trim(F.regexp_replace("line", "^#+[ \\t]+", ""))
    seen = [F.last(F.when(F.col("level") == k, F.struct("pos", title.alias("title"))), ignorenulls=True).over(upto).alias(f"h{k}") for k in range(1, levels + 1)]
    numbered = headed.select("id", "pos", "line", "start", "level", F.count("level").over(upto).alias("section"), *seen)
    shown = [F.when(F.col(f"h{k}.pos") > F.greatest(F.lit(-1), *[F.coalesce(f"h{j}.pos", F.lit(-1)) for j in range(1, k)], F.lit(-1)), F.col(f"h{k}.title")) for k in range(1, levels + 1)]
    bodies = numbered.withColumn("path", F.array_compact(F.array(*shown))).where("level IS NULL").groupBy("id", "section").agg(
        F.min_by("path", "pos").alias("path"), F.min("start").cast("long").alias("source_start"), F.max(F.col("start") + F.length("line")).cast("long").alias("source_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"),
    )
    return bodies.where(F.trim(F.regexp_replace("body", "\\s", "")) != "").select(F.col("id").alias(id_column), "section", "path", "source_start", "source_end", "body")


HEADING = re.compile(r"(#{1,4})(?: (.*))?$", re.DOTALL)


def _blocks(text: str) -> Iterator[tuple[tuple[str, ...], list[tuple[str, int]]]]:
    """(headings above, pieces) of each run of lines without a blank line or a heading between them.

    A piece is a stretch of printable characters of a line, without the blanks at the line's ends, and its place in the text;
    a piece that begins a line has the line end before it as a piece of its own, with place -1.
    """
    path: dict[int, str] = {}
    fence, at, held = "", 0, []
    for line in text.split("\n"):
        body = line.strip()
        begin = at + len(line) - len(line.lstrip())
        at += len(line) + 1
        shown = "".join(c for c in body if c.isprintable())
        was = fence
        if fence:
            fence = "" if shown.startswith(fence) else fence
        elif shown.startswith("```") and shown.count("```") == 1 or shown.startswith("~~~"):
            fence = shown[:3]
        heading = None if fence else HEADING.match(shown)
        if heading or not shown and not (was and fence):
            if held:
                yield tuple(path[k] for k in sorted(path)), held
                held = []
            if heading:
                level = len(heading[1])
                path = {k: v for k, v in path.items() if k < level} | {level: (heading[2] or "").strip()}
            continue
        if held:
            held.append(("\n", -1))
        for run in re.finditer(r"[^\x00]+", "".join(c if c.isprintable() else "\0" for c in body)):
            held.append((run[0], begin + run.start()))
        if not shown:
            held.append(("", -1))
    if held:
        yield tuple(path[k] for k in sorted(path)), held


def markdown_spans(text: str, size: int = 1000, overlap: int = 120) -> Iterator[tuple[tuple[str, ...], str, list[Span]]]:
    """(headings, chunk, source ranges) of a Markdown text.

    Lines under the same headings make one section, blocks of it with two blanks and a line end between them; a section of
    over `size` characters is cut as plain text is. A chunk's ranges are where its characters stand in the text.
    """
    for path, group in itertools.groupby(_blocks(text), key=lambda x: x[0]):
        pieces = [p for k, (_, block) in enumerate(group) for p in ([("  \n", -1)] if k else []) + block]
        content = "".join(x for x, _ in pieces)
        if not content.strip():
            continue
        found = [(0, len(content))] if len(content) <= size else [x for x in spans(content, size, overlap) if x[0] < x[1]]
        places = list(itertools.accumulate((len(x) for x, _ in pieces), initial=0))
        for a, z in found:
            ranges: list[Span] = []
            for (x, source), place in zip(pieces, places, strict=False):
                low, high = max(a, place), min(z, place + len(x))
                if source >= 0 and low < high:
                    start, end = source + low - place, source + high - place
                    if ranges and ranges[-1][1] == start:
                        start = ranges.pop()[0]
                    ranges.append((start, end))
            if ranges:
                yield path, content[a:z], ranges


def markdown_chunks(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = 1000, overlap: int = 120) -> DataFrame:
    """The id, seq (from 0), path (headings), chunk, source_start, source_end and source_ranges (start, end, hash) of each chunk of Markdown texts.

    Headings have one to four number signs; what lies between fences of ``` or ~~~ holds none. Null and blank texts have no chunk.
    """
    if overlap >= size:
        raise ValueError(f"overlap {overlap} must be less than size {size}")
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    ranges = "array<struct<start:bigint,end:bigint,hash:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py() or ""
                found = list(markdown_spans(text, size, overlap))
                if not found:
                    continue
                hashed = [[{"start": a, "end": z, "hash": hashlib.sha256(text[a:z].encode()).hexdigest()[:16]} for a, z in r] for *_, r in found]
                spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))
                ids = pa.array([batch.column("id")[k].as_py()] * len(found), batch.schema.field("id").type)
                columns = [ids, pa.array(range(len(found)), pa.int64()), pa.array([list(p) for p, *_ in found], pa.list_(pa.string())), pa.array([c for _, c, _ in found], pa.string()), pa.array(hashed, spans_type)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "seq", "path", "chunk", "source_ranges"])

    found = source.mapInArrow(run, f"id {kind}, seq long, path array<string>, chunk string, source_ranges {ranges}")
    first, last = F.col("source_ranges")[0]["start"], F.element_at("source_ranges", -1)["end"]
    return found.select(F.col("id").alias(id_column), "seq", "path", "chunk", first.alias("source_start"), last.alias("source_end"), "source_ranges")


def packed(rows: Column, room: Column) -> Column:
    """An array of strings as an array of arrays: consecutive rows, each with a line end, that fit in room characters together. A longer row stands alone."""
    done, held = F.array().cast("array<array<string>>"), F.array().cast("array<string>")

    def state(d: Column, h: Column, n: Column) -> Column:
        return F.struct(d.alias("done"), h.alias("held"), n.cast("int").alias("n"))

    def step(s: Column, row: Column) -> Column:
        width = F.length(row) + 1
        fits = (F.size(s["held"]) == 0) | (s["n"] + width <= room)
        return F.when(fits, state(s["done"], F.concat(s["held"], F.array(row)), s["n"] + width)).otherwise(state(F.concat(s["done"], F.array(s["held"])), F.array(row), width))

    return F.aggregate(rows, state(done, held, F.lit(0)), step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"]))


def table_chunks(tables: DataFrame, keys: list[str], rows: Column, header: Column, size: int) -> DataFrame:
    """keys, seq, first_row and last_row (from 0), chunk: the header again in each, then as many rows as fit into size characters."""
    groups = tables.select(*keys, header.alias("_header"), F.posexplode(packed(rows, F.lit(size) - F.length(header))).alias("seq", "_rows"))
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("_rows")).over(before), F.lit(0)).cast("long")
    return groups.select(*keys, F.col("seq").cast("long").alias("seq"), first.alias("first_row"), (first + F.size("_rows") - 1).alias("last_row"), F.concat(F.col("_header"), F.lit("\n"), F.array_join("_rows", "\n")).alias("chunk"))
