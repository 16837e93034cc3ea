"""Markup to clean text, keeping headings, lists, tables, code and formulas.

The text is read once for the notations that occur in it (HTML, Markdown, wiki,
LaTeX), code blocks set aside. HTML is parsed; per root-to-leaf path of block tags
the length of text and the number of sentence signs are added up over the text's
nodes, smoothed along runs of one path, fused (their geometric mean), and nodes of
paths below a share of the mean are dropped as page furniture, whatever their tags.
Headings, lists and tables have no part in the mean and are kept if the path that
encloses them is content; code, formulas and text outside all block tags stay.
A menu list whose container has the same path as one with content stays, too. The
other notations are rewritten construct by construct. A text without markup is
returned as it is; null stays null.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
#: A path is content if its fused ratio is at least this share of the mean over all nodes of running text.
SHARE = 0.15

_TAGS = "a abbr article aside b blockquote body br button center cite code col dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p pre q ref s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video nowiki"
_TAG = re.compile(rf"(?:<|&lt;)/?(?:{'|'.join(sorted(_TAGS.split(), key=len, reverse=True))})(?=[\s/>]|&gt;)(?:[^<>\n]|\n){{0,300}}?(?:>|&gt;)|(?:<|&lt;)!--|--(?:>|&gt;)|<!DOCTYPE", re.I)
_ENTITY = re.compile(r"&(?:amp;)?(?:#\d{2,7}|#x[0-9a-f]{2,6}|(?:[lg]t|amp|quot|apos|nbsp|[lr][ds]quo|[mn]dash|hellip|copy|reg|trade|euro|pound|sect|bull|middot|times|deg|laquo|raquo|shy|ensp|emsp|thinsp|zwnj|[a-zA-Z](?:uml|acute|grave|circ|tilde|cedil|slash|ring)|szlig|aelig|oelig|iexcl|iquest|frac\d\d|sup\d|larr|rarr|minus|ne|le|ge|check));", re.I)
_FENCED = re.compile(r"^([ \t]*)(```|~~~)[^\n]*\n.*?(?:^[ \t]*\2[ \t]*$|\Z)", re.S | re.M)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_PRE = re.compile(r"((?:<|&lt;)(pre|code|nowiki|syntaxhighlight|source)\b[^<>\n]{0,200}?(?:>|&gt;))(.*?)((?:<|&lt;)/\2\s*(?:>|&gt;)|\Z)", re.S | re.I)
_TICKED = re.compile(r"(?<![`\\])`[^`\n]+`(?!`)")

_MARKDOWN = re.compile(
    r"""^\ {0,3}\#{1,6}[ \t]+\S|^[^\s|>\#=-][^\n]*\n\ {0,3}(?:={3,}|-{3,})[ \t]*$|(?<![\w*])\*\*(?=[^\s*])[^*\n]{1,200}?(?<=[^\s*])\*\*(?![\w*])|(?<![\w*\\])\*(?=[^\s*])[^*\n]{1,200}?(?<=[^\s*])\*(?![\w*])
    |(?<![\w_])__(?=[^\s_])[^_\n]{1,200}?(?<=[^\s_])__(?![\w_])|(?<![\w_/.\\])_(?=[^\s_])[^_\n]{1,100}?(?<=[^\s_])_(?![\w_/])|(?<!~)~~(?=[^\s~])[^~\n]{1,200}?~~(?!~)
    |!?\[[^\[\]\n]{0,200}\]\((?:[^()\s]{1,300})(?:\s"[^"\n]*")?\)|^\ {0,3}\|?\ *:?-{3,}:?\ *(?:\|\ *:?-{3,}:?\ *)+\|?[ \t]*$|^\ {0,3}>[ \t]+(?=[^\W\d])|^[ \t]*[-*+]\ \[[ xX]\]\s|^\[[^\]\n]{1,60}\]:\s+\S|\[\^[\w-]+\]|^\ {0,3}(?:\*\ ?){3,}$|^\ {0,3}(?:_\ ?){3,}$""",
    re.M | re.X,
)
_WIKI = re.compile(r"^[ \t]*(={2,6})[^=\n][^\n]*?\1[ \t]*$|(?<!')'''?(?=[^'\s])[^'\n]{1,200}?'''?(?!')|\[\[[^\[\]\n]{1,200}\]\]|\{\{[^{}\n]{1,300}\}\}|^[ \t]*\{\|[^\n]*$|^[ \t]*\|(?:-(?!-)|\})[^|\n]{0,80}$|\[https?://[^\s\]]+\s[^\]\n]+\]|__(?:NO)?TOC__", re.M)
_LATEX = re.compile(
    r"""\\(?:begin|end)\{[a-zA-Z*]+\}|(?<![\w\\:/.])\\[a-zA-Z]{2,}\*?(?=[\[{])|(?<![\w\\:/.\]}])\\(?:item|maketitle|tableofcontents|newline|newpage|noindent|bigskip|medskip|smallskip|centering|hline|toprule|midrule|bottomrule|ldots|dots|textbackslash|LaTeX|TeX|today|par|quad|qquad|par|cdot|times|alpha|beta|gamma|delta|lambda|mu|pi|sigma|le|leq|ge|geq|ne|neq|approx|sum|int|frac|sqrt|infty|bfseries|itshape)\b
    |\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|(?<![\w\\:/])\\[%&\#_$](?!\w*\\)|(?<=\S)\ \\\\[ \t]*$""",
    re.X | re.S | re.M,
)
_DOLLARS = re.compile(r"(?<![\w$\\])\$(?!\s)([^$\n]{1,160}?)(?<![\s\\])\$(?![\w$])")
_LONG = re.compile(r"(?<!\\)\b[^\W\d_]{3,}")


def _formula(body: str) -> bool:
    return bool(re.search(r"[\\^_=<>+]|^[a-zA-Z]$|\w\s*[*/-]\s*\w", body)) and not [w for w in _LONG.finditer(body) if not re.search(r"\\[a-zA-Z]*$|\\\w+\{[^}]*$", body[: w.start()])]


def kinds(text: str) -> list[str]:
    """The notations of which at least one construct occurs, in the order of KINDS."""
    found = set()

    def fenced(m):
        found.add("markdown")
        return "\n"

    def verbatim(m):
        found.add("latex")
        return "\n"

    def pre(m):
        found.add("html")
        return m[1] + m[4]

    rest = text
    if "```" in rest or "~~~" in rest:
        rest = _FENCED.sub(fenced, rest)
    if "\\begin{" in rest:
        rest = _VERBATIM.sub(verbatim, rest)
    if "<" in rest or "&lt;" in rest:
        rest = _PRE.sub(pre, rest)
    if "`" in rest and _TICKED.search(rest):
        found.add("markdown")
        rest = _TICKED.sub(" ", rest)
    if ("<" in rest or "&" in rest or "-->" in rest) and (_TAG.search(rest) or _ENTITY.search(rest)):
        found.add("html")
    formulas = [m for m in _DOLLARS.finditer(rest) if _formula(m[1])] if "$" in rest else []
    if formulas or ("\\" in rest or "$$" in rest) and _LATEX.search(rest):
        found.add("latex")
    # signs inside formulas and tags mean nothing in the other notations
    bare = _DOLLARS.sub(lambda m: " " if _formula(m[1]) else m[0], rest) if formulas else rest
    if "\\" in bare or "$$" in bare:
        bare = re.sub(r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{(equation|align|math|displaymath)\*?\}.*?\\end\{\1\*?\}", " ", bare, flags=re.S)
    bare = _TAG.sub(" ", bare) if "html" in found else bare
    if _WIKI.search(bare):
        found.add("wiki")
        bare = _WIKI.sub(" ", bare)
    if _MARKDOWN.search(bare):
        found.add("markdown")
    return [k for k in KINDS if k in found]


_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br", "hr", "dl", "dt", "dd", "header", "footer", "nav", "aside", "main", "title"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "col"}
_INLINE = set("a abbr b cite code del em font i img input ins kbd label mark q ref s samp small span strike strong sub sup tt u var nowiki".split())
#: Structures that are kept wherever their enclosing path is content.
_KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "li", "dt", "dd", "table", "td", "th", "pre"}
_PAGE = {"html", "body"}
_MARKS = {"- ", "| ", *("#" * n + " " for n in range(1, 7))}


def _last(path: list[str], tag: str) -> int:
    return len(path) - 1 - path[::-1].index(tag)


class _Tree(HTMLParser):
    """Text nodes with their tag paths and the number of their block, in order; block tags open a new line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.nodes: list[tuple[tuple[str, ...], str, int]] = []
        self.block = 0

    def sign(self, text: str) -> None:
        self.nodes.append(((), text, self.block))

    def handle_starttag(self, tag, attrs):
        self.block += tag not in _INLINE and tag not in _VOID
        if tag in _BLOCKS and tag != "br" and "p" in self.path and not _BLOCKS & set(self.path[_last(self.path, "p") + 1 :]):
            del self.path[_last(self.path, "p") :]  # a paragraph ends where a block begins
        if tag in ("li", "p", "td", "th", "tr") and tag in self.path[-1:]:
            self.path.pop()  # these end where the next one begins
        if tag in _BLOCKS:
            self.sign("\n" if tag in ("br", "li", "tr", "dt", "dd") else "\n\n")
        if tag not in _VOID:
            self.path.append(tag)
        if tag[0] == "h" and tag[1:].isdigit():
            self.sign("#" * int(tag[1:]) + " ")
        elif tag == "li":
            self.sign("- ")
        elif tag in ("td", "th"):
            self.sign("| ")
        elif tag == "pre":
            self.sign("```\n")

    def handle_endtag(self, tag):
        self.block += tag not in _INLINE and tag not in _VOID
        if tag in self.path:
            while self.path and self.path.pop() != tag:
                pass
        if tag == "pre":
            self.sign("\n```")
        if tag in _BLOCKS and tag not in ("li", "td", "th", "br"):
            self.sign("\n")

    def handle_data(self, data):
        if not {"script", "style", "head"} & set(self.path):
            self.nodes.append((tuple(self.path) or ("body",), data, self.block))


def _from_html(text: str) -> str:
    if "&lt;" in text and not _TAG.search(re.sub(r"&lt;", "", text)):
        text = html.unescape(text)
    tree = _Tree()
    tree.feed(text)
    tree.close()
    # the text of one block is one node, whatever inline tags it is cut by
    spoken: list[tuple[tuple[str, ...], str]] = []
    last = None
    for p, t, block in tree.nodes:
        path = _block_path(p)
        if path and t.strip():
            if block == last:
                spoken[-1] = (path, spoken[-1][1] + t)
            else:
                spoken.append((path, t))
            last = block
    content = _content_paths(spoken)
    out = []
    for p, t, _ in tree.nodes:
        path = _block_path(p)
        if path and t.strip() and path not in content and "pre" not in p and "\x02" not in t:
            while out and out[-1] in _MARKS:
                out.pop()  # the sign of the dropped item or heading
            continue
        out.append(t if not p or "pre" in p else re.sub(r"\s+", " ", t))
    return "".join(out)


def _block_path(path: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(t for t in path if t not in _INLINE and t not in _PAGE)


def _content_paths(spoken: list[tuple[tuple[str, ...], str]]) -> set[tuple[str, ...]]:
    """The paths of content among nodes of text with their block paths."""
    length, signs, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for i, (p, _) in enumerate(spoken):
        # smoothing: a node shares in its neighbours, but furniture not in the text beside it
        around = [x for q, x in spoken[max(0, i - 1) : i + 2] if q == p]
        length[p] += sum(len(x.strip()) for x in around) / len(around)
        signs[p] += sum(sum(c in ".,;:!?" for c in x) for x in around) / len(around)
        count[p] += 1
    fused = {p: ((length[p] / count[p]) * (1 + signs[p] / count[p])) ** 0.5 for p in length}
    running = [p for p, _ in spoken if not _KEPT & set(p)] or [p for p, _ in spoken]
    bar = SHARE * sum(fused[p] for p in running) / max(1, len(running))
    content = {p for p in fused if fused[p] >= bar}
    around = {p[:n] for p in content for n in range(1, len(p) + 1)}
    for p in fused:
        enclosing = p[: next((n for n, t in enumerate(p) if t in _KEPT), len(p))]
        if len(enclosing) < len(p) and (not enclosing or enclosing in around):
            content.add(p)
    return content


_REWRITE = {
    "wiki": [
        (r"(?m)^[ \t]*(={2,6})[ \t]*([^\n]*?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2]), (r"'''?([^'\n]+?)'''?", r"\1"), (r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1"),
        (r"\{\{quote\|([^{}\n]*)\}\}", r"\1"), (r"\{\{[^{}\n]*\}\}", ""), (r"(?m)^[ \t]*(?:\{\||\|\}|\|-)[^\n]*\n?", ""), (r"\[https?://\S+\s([^\]\n]+)\]", r"\1"), (r"__(?:NO)?TOC__", ""),
    ],
    "markdown": [
        (r"(?m)^([^\s|>#][^\n]*)\n={3,}[ \t]*$", r"# \1"), (r"(?m)^([^\s|>#][^\n]*)\n-{3,}[ \t]*$", r"## \1"), (r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s\"[^\"\n]*\")?\)", r"\1"),
        (r"(?<![\w*])(\*\*?)(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![\w*])", r"\2"), (r"(?<![\w_])(__?)(?=[^\s_])([^_\n]+?)(?<=[^\s_])\1(?![\w_])", r"\2"), (r"~~([^~\n]+)~~", r"\1"), (r"(?m)^ {0,3}>[ \t]?", ""),
        (r"(?m)^ {0,3}\|?(?: *:?-{3,}:? *\|)+ *:?-*:? *$\n?", ""), (r"\[\^[\w-]+\]:?", ""),
    ],
    "latex": [
        (r"\\(part|chapter|section|subsection|subsubsection)\*?\{([^{}]*)\}", lambda m: "#" * {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}[m[1]] + " " + m[2]),
        (r"\\(?:documentclass|usepackage|label|ref|cite|footnote|bibliography\w*)(?:\[[^\]]*\])?\{[^{}]*\}", ""), (r"\\item\b[ \t]*", "- "), (r"\\(?:begin|end)\{(?!equation|align)[^{}]*\}(?:\{[lrc|]*\})?(?:\[[^\]]*\])?", ""),
        (r"\\(?:text\w+|emph|textbf|underline|caption|title|author|href\{[^{}]*\}|url)\{([^{}]*)\}", r"\1"), (r"(?m)[ \t]*\\\\[ \t]*$", ""), (r"\\([%&#_$])", r"\1"), (r"\\(?:maketitle|tableofcontents|hline|toprule|midrule|bottomrule|centering|noindent|newpage|bigskip|medskip)\b", ""),
    ],
}


def clean(text: str | None) -> str | None:
    """The text without its markup; headings as #, lists as -, tables with |, code fenced, formulas as they are."""
    return converted(text)[0]


def converted(text: str | None) -> tuple[str | None, list[str]]:
    """The clean text and the notations that it was converted from."""
    found = kinds(text) if text else []
    if not found:
        return text, found
    kept: list[str] = []

    def keep(m) -> str:
        kept.append(m[0] if not m[0].startswith("\\begin") else "```\n" + re.sub(r"\\(?:begin|end)\{\w+\}(?:\[[^\]]*\])?\n?", "", m[0]).rstrip() + "\n```")
        return f"\x02{len(kept) - 1}\x02"

    out = _VERBATIM.sub(keep, _FENCED.sub(keep, text))
    out = re.sub(r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)", keep, out, flags=re.S)
    out = _DOLLARS.sub(lambda m: keep(m) if _formula(m[1]) else m[0], out)
    if "html" in found:
        # without tags there are only entities, and the layout stays
        out = _from_html(out) if _TAG.search(out) else html.unescape(out)
    for kind in ("latex", "wiki", "markdown"):
        if kind in found:
            for pattern, to in _REWRITE[kind]:
                out = re.sub(pattern, to, out)
    out = re.sub(r"\x02(\d+)\x02", lambda m: kept[int(m[1])], out)
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", out)).strip(), found


def convert(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``record_id, kinds, text`` of every row with an id; copies of a delivery stay copies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [converted(t) for t in batch["text"]]
            yield pd.DataFrame({"record_id": batch["record_id"], "kinds": [k for _, k in made], "text": [t for t, _ in made]})

    rows = df.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("text")).where("record_id is not null")
    return rows.mapInPandas(run, "record_id string, kinds array<string>, text string")
