"""Text functions over columns: normal forms, tokens, similarity in millionths, windows, titles, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
BLANK = "[ \\t\\n\\r\\f\\u000b\\u3000]+"


def half_width(x: Column) -> Column:
    """Full-width forms and the ideographic space as their ASCII counterparts."""
    return F.translate(x, WIDE, NARROW)


def plain_punctuation(x: Column) -> Column:
    """Title and quotation marks dropped, CJK brackets as ASCII ones."""
    return F.translate(x, "【】〔〕［］《》〈〉「」『』", "[][][]")


def collapsed(x: Column) -> Column:
    """Blanks trimmed, and runs of them as one space."""
    return F.trim(F.regexp_replace(x, BLANK, " "))


#: The numerals and units of clauses, and the mark of a document's number.
NUMERALS = "0-9一二三四五六七八九十百千零两"
UNITS = "条|款|项|号|章|节"
NUMBER_MARK = "号"


def query_form(x: Column) -> Column:
    """The surface of a query made alike: half-width forms, plain punctuation, no blanks inside clause numbers ("第 5 条"), bracketed years ("[ 2020 ]") and document numbers ("5 号"), other blanks as one. A null query is empty."""
    x = plain_punctuation(half_width(F.coalesce(x, F.lit(""))))
    x = F.regexp_replace(x, f"(?U)第\\s*([{NUMERALS}]+)\\s*({UNITS})", "第$1$2")
    x = F.regexp_replace(x, "(?U)\\[\\s*(\\d+)\\s*\\]", "[$1]")
    x = F.regexp_replace(x, f"(?U)(\\d+)\\s*{NUMBER_MARK}", f"$1{NUMBER_MARK}")
    return F.trim(F.regexp_replace(x, "(?U)\\s+", " "))


def graph_name(x: Column) -> Column:
    """Trimmed, lower-cased (sharp s as ss, as case folding has it), blanks collapsed."""
    return collapsed(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")))


def tokens(x: Column, most: int = 8, least: int = 2) -> Column:
    """Distinct runs of letters and digits of at least `least` characters, lower-cased, in order, `most` of them."""
    found = F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9\\u00df-\\u024f\\u4e00-\\u9fff]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda t: F.length(t) >= least)), F.lit(1), F.lit(most))


def hits(words: Column, text: Column) -> Column:
    """How many of the words (lower case) the text contains."""
    low = F.lower(text)
    return F.size(F.filter(words, lambda w: F.contains(low, w))).cast("long")


def fallback_score(words: Column, text: Column, title: Column, external_id: Column, title_boost: float = 1.5, id_boost: float = 2.0) -> Column:
    return hits(words, text) + hits(words, title) * F.lit(title_boost) + hits(words, external_id) * F.lit(id_boost)


def micros(n: Column, d: Column) -> Column:
    """n / d in millionths, rounded half up in whole numbers; 0 if d is 0."""
    n, d = n.cast("long"), d.cast("long")
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(F.floor((2 * n * 1000000 + d) / (2 * d)).cast("long"))


def bigrams(x: Column) -> Column:
    """Character pairs of a text (of a single character, itself), each with its number of occurrence: "aa1", "aa2". The multiset as a set."""
    n = F.length(x)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(x, i, F.lit(2)))).when(n == 1, F.array(x)).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda q: q == p)).cast("string")))


def dice_micros(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    return F.when((a == b) & (F.length(a) > 0), F.lit(1000000).cast("long")).otherwise(micros(2 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)))


def jaccard_micros(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.filter(F.split(v, " "), lambda t: t != "")) for v in (a, b))
    return micros(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def containment_micros(a: Column, b: Column) -> Column:
    inside = (F.contains(a, b) | F.contains(b, a)) & (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(inside, micros(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))).otherwise(F.lit(0).cast("long"))


def pair_score(a: Column, b: Column) -> Column:
    return F.greatest(dice_micros(a, b), jaccard_micros(a, b), containment_micros(a, b))


def short_title(x: Column, most: int = 28, default: str = "New conversation") -> Column:
    x = collapsed(x)
    return F.when(x == "", default).when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("…"))).otherwise(x)


def window(text: Column, start: Column, end: Column, around: int) -> Column:
    """The text from `around` characters before start to as many after end (offsets from 0)."""
    begin = F.greatest(start - around, F.lit(0))
    return F.substring(text, (begin + 1).cast("int"), (F.least(end + around, F.length(text)) - begin).cast("int"))


def budget_window(text: Column, start: Column, end: Column, budget: int = 3000) -> Column:
    """A window of `budget` characters in all, split evenly before and after the span."""
    room = F.greatest(F.lit(budget) - (end - start), F.lit(0))
    begin = F.greatest(start - F.floor(room / 2), F.lit(0))
    return F.substring(text, (begin + 1).cast("int"), F.greatest(F.least(F.lit(budget), F.length(text) - begin), F.lit(0)).cast("int"))


def line_number(text: Column, offset: Column) -> Column:
    """Line of an offset from 0, from 1."""
    head = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1).cast("long")


def nonblank_chars(x: Column) -> Column:
    return F.length(F.regexp_replace(x, BLANK, "")).cast("long")


def pseudo_query(x: Column) -> Column:
    """The first sentence if it has 8 to 120 characters, else the first 80 characters."""
    first = F.trim(F.regexp_extract(collapsed(x), "^([^.!?。！？]*[.!?。！？]?)", 1))
    return F.when(F.length(first).between(8, 120), first).otherwise(F.left(collapsed(x), F.lit(80)))


def fragment(x: Column, size: int = 30) -> Column:
    """`size` characters from a third of the way in."""
    return F.substring(collapsed(x), (F.floor(F.length(collapsed(x)) / 3) + 1).cast("int"), F.lit(size))


def unfenced(x: Column) -> Column:
    """What an outer code fence holds, or the whole."""
    inner = F.regexp_extract(F.trim(x), "(?s)^```[a-zA-Z]*\\s*\\n(.*?)\\n?```$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(x))


def strings_in(x: Column, most: int) -> Column:
    """The strings of the outermost [...] of a text, `most` at most; empty if it is no JSON array."""
    found = F.from_json(F.regexp_extract(x, "(?s)(\\[.*\\])", 1), "array<string>")
    return F.slice(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda s: F.coalesce(F.trim(s) != "", F.lit(False))), F.lit(1), F.lit(most))


def folder(path: Column) -> Column:
    """A path without empty, blank and dot segments: "a/b"."""
    return F.array_join(F.filter(F.transform(F.split(path, "/"), lambda s: F.trim(s)), lambda s: (s != "") & (s != ".")), "/")


def below(path: Column, parent: Column) -> Column:
    return (path == parent) | F.startswith(path, F.concat(parent, F.lit("/")))


def moved(path: Column, old: Column, new: Column) -> Column:
    return F.when(below(path, old), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)


def row_text(cells: Column) -> Column:
    """Cells joined by bars, a cell equal to the one before it left out."""
    kept = F.filter(cells, lambda x, i: (i == 0) | (x != F.element_at(cells, F.greatest(i, F.lit(1)))))
    return F.array_join(kept, " | ")
