"""Text functions as columns: cleaning, names, addresses, chunks, contexts. Null gives null unless stated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What JavaScript's \s and trim take for blanks, as Java writes it.
BLANK = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+\\z", "")


def clean(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def strip_html(c: Column) -> Column:
    """Without script and style bodies and tags, six entities resolved."""
    for pattern, to in ((r"(?i)<script[^>]*>[\s\S]*?</script>", ""), (r"(?i)<style[^>]*>[\s\S]*?</style>", ""), ("<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.regexp_replace(c, pattern, to)
    return clean(c)


def url_to_id(c: Column) -> Column:
    """An address as an id of at most 100 letters, digits and single hyphens."""
    c = F.regexp_replace(F.regexp_replace(c, "^https?://", ""), "[^a-zA-Z0-9]+", "-")
    return F.substring(F.regexp_replace(c, "^-|-$", ""), 1, 100)


def field_label(c: Column) -> Column:
    """camelCase as words, the first letter a capital."""
    c = F.regexp_replace(c, "([A-Z])", " $1")
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def truncated_line(c: Column, most: int) -> Column:
    """On one line, of at most ``most`` characters with the dots."""
    c = trim(F.regexp_replace(c, r"\n", " "))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def singular(c: Column) -> Column:
    """Without one final s."""
    return F.regexp_replace(c, "s$", "")


def packed(parts: Column, glue: str, most: int) -> Column:
    """Array of chunks: parts joined by ``glue`` as long as the chunk and the next part have at most
    ``most`` characters together (the glue not counted); a longer part is a chunk of its own; blank chunks are dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state, part):
        full = F.length(state["now"]) + F.length(part) > most
        return F.struct(
            F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"),
            F.when(full | (state["now"] == ""), part).otherwise(F.concat(state["now"], F.lit(glue), part)).alias("now"),
        )

    chunks = F.aggregate(parts, start, add, lambda s: F.array_append(s["done"], s["now"]))
    return F.filter(F.transform(chunks, trim), lambda c: c != "")


def paragraphs(c: Column, most: int = 1000) -> Column:
    return packed(F.split(c, r"\n\n+"), "\n\n", most)


def sentences(c: Column, most: int = 1000) -> Column:
    return packed(F.split(c, rf"(?<=[.!?]){BLANK}+"), " ", most)


def slices(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Slices of ``size`` characters, the next one ``overlap`` before the end of the last; trimmed, blank ones dropped."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: trim(F.substr(c, i + 1, F.lit(size)))), lambda s: s != "")


def markdown_chunks(text: str, most: int = 1000, title: str | None = None, code: bool = True) -> list[tuple[str, str, str, str | None]]:
    """``(content, type, section, language)`` of a Markdown text read by lines: headings on their own, fenced code as one chunk,
    other lines until they pass ``most`` characters. Code that is never closed is a chunk whatever ``code`` says."""
    out: list[tuple[str, str, str, str | None]] = []
    section, held, fence = title or "Overview", [], None

    def flush(kind: str, language: str | None = None) -> None:
        body = "".join(held).strip()
        held.clear()
        if body:
            out.append((body, kind, section, language))

    for line in text.split("\n"):
        if line.startswith("```"):
            if fence is None:
                flush("text")
                fence = line[3:].strip()
            else:
                if code:
                    flush("code", fence)
                held.clear()
                fence = None
            continue
        marks = len(line) - len(line.lstrip("#"))
        if fence is None and 1 <= marks <= 6 and line[marks : marks + 1].isspace() and line[marks:].strip():
            flush("text")
            section = line[marks:].lstrip()
            out.append((section, "heading", section, None))
            continue
        held.append(line + "\n")
        if fence is None and sum(map(len, held)) > most:
            flush("text")
    flush("code" if fence is not None else "text")
    return out


def chunk_markdown(df: DataFrame, id_col: str, text_col: str, most: int = 1000) -> DataFrame:
    """``id, pos, content, type, section, language`` of every chunk; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *c) for k, t in zip(batch["id"], batch["text"]) for i, c in enumerate(markdown_chunks(t, most))]
            yield pd.DataFrame(rows, columns=["id", "pos", "content", "type", "section", "language"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(run, "id string, pos int, content string, type string, section string, language string")


def chunks(c: Column, strategy: str = "paragraph", most: int = 1000, overlap: int = 200) -> Column:
    """Array of chunks by paragraph (the default), sentence or fixed slices."""
    return {"sentence": lambda: sentences(c, most), "fixed": lambda: slices(c, most, overlap)}.get(strategy, lambda: paragraphs(c, most))()
