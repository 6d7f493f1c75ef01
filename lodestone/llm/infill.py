"""Fill-in-the-middle: texts are cut into prefix, middle and suffix at the boundaries of lines or words, and written in another order.

Each text is decoded to an array of code points. Each code point has a class (of lines: how many line ends precede it; of
words: blank or not), and a boundary is where neighbouring classes differ. Which boundaries are taken follows from the
SHA-256 of seed and id alone, so a document is cut alike wherever its row lies and however often a task is run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin and where the last one ends: 0, the boundaries, the length. Of an empty text only 0."""
    if unit == "line":
        ends = points == 10
        classes = np.cumsum(ends) - ends
    elif unit == "word":
        classes = np.isin(points, BLANKS)
    else:
        raise ValueError(f"no such unit: {unit}")
    return np.concatenate(([0], np.flatnonzero(classes[1:] != classes[:-1]) + 1, [len(points)][: len(points)]))


def hashes(seed: str, id_column: Column) -> Column:
    """The first four groups of eight hex digits of the SHA-256 of "seed:id", as numbers; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*[F.substring(digest, 8 * k + 1, 8) for k in range(4)]), lambda x: F.conv(x, 16, 10).cast("long"))


def _decoded(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def _encoded(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def transformed(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", unit: str = "line", seed: str = "7", percent: int = 100, spm_percent: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars: a row for each row of docs. n counts the units of the text.

    Of four hashes of seed and id, the smaller of the first two (each modulo n + 1) is how many units the prefix has, the
    greater one where the middle ends. Form is plain, and output the text, if the text is empty or holds a marker, or if the
    third hash modulo 100 is not below `percent`; else spm (suffix, prefix, middle, each behind its marker) if the fourth
    modulo 100 is below `spm_percent`, else psm (prefix, suffix, middle). Lengths are in code points, null where plain.

    A null text is an empty one; a null id is hashed as no digits. Rows that repeat an id and text come out alike. A long text
    is held whole by its task, some twenty bytes for each code point, never more than one batch of rows at once; a text without any boundary is one
    unit. An empty table gives no rows; further columns, whatever their names, are not looked at. Markers must begin with a
    character that no marker holds elsewhere: then none arises where a piece meets a marker, and `restored` is exact.
    """
    if len(markers) != 3 or len(set(markers)) != 3 or any(not m or any(m[0] in x[1:] for x in markers) for m in markers):
        raise ValueError("markers must be three and differ, and none may hold another's first character further on")
    if unit not in ("line", "word"):
        raise ValueError(f"no such unit: {unit}")
    p, s, m = markers
    before = {k: [_decoded(x.encode()) for x in order] for k, order in (("psm", (p, s, m)), ("spm", (s, p, m)))}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, drawn = batch.column(0), np.asarray(batch.column(2).flatten(), np.int64).reshape(-1, 4)
            for at, to, data, offsets in common.slices(batch.column(1), 1 << 22):
                n, form, out, sizes = [], [], [], []
                for k in range(to - at):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    points = _decoded(raw)
                    places = boundaries(points, unit)
                    units, (h1, h2, h3, h4) = len(places) - 1, drawn[at + k].tolist()
                    n.append(units)
                    if not units or h3 % 100 >= percent or any(x.encode() in raw for x in markers):
                        form.append("plain")
                        out.append(raw)
                        sizes.append((None, None))
                        continue
                    a, b = sorted((h1 % (units + 1), h2 % (units + 1)))
                    one, two = places[a], places[b]
                    form.append("spm" if h4 % 100 < spm_percent else "psm")
                    prefix, middle, suffix = points[:one], points[one:two], points[two:]
                    x, y, z = before[form[-1]]
                    pieces = (x, prefix, y, suffix, z, middle) if form[-1] == "psm" else (x, suffix, y, prefix, z, middle)
                    out.append(_encoded(np.concatenate(pieces)))
                    sizes.append((len(prefix), len(middle)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(out, pa.binary()), pa.array([x for x, _ in sizes], pa.int64()), pa.array([x for _, x in sizes], pa.int64())], names=["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"])

    read = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), hashes(seed, F.col(id_column)).alias("drawn"))
    kind = read.schema["doc_id"].dataType.simpleString()
    found = read.mapInArrow(cut, f"doc_id {kind}, n long, form string, output binary, prefix_chars long, middle_chars long")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that `transformed` made an output of."""
    pieces = F.split(output, "|".join("\\Q" + m + "\\E" for m in markers), -1)
    part = lambda k: F.get(pieces, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """What `transformed` makes of documents by lines, as digests: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    rows = transformed(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
