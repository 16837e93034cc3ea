"""Template residue, filler, error pages and script notices in place of content.

A document is read as an answer to an address: ``source`` is the host, ``doc_type``
the only part of the address that the data keep, the first short line the title.
Three kinds of evidence are combined:

* placeholder detectors on the text itself: template fields outside code, and per
  unit (line or sentence) the wording of filler, errors, script notices and page
  furniture;
* duplicated responses of low information: a unit that no detector knows counts as
  what the documents are that begin units with the same three words, if these
  stand under at least MIN_CONTEXTS addresses (host and type) and in at least
  MIN_SHARE of cases consist of residue of that kind by the detectors; a word marks
  filler if enough of the documents with it (MARK_SHARE) are filler by the
  detectors. Openings and words of ordinary sentences stand in all sorts of
  documents, so they never qualify;
* title against body: in a document whose title returns in its body the body is
  about its subject, and no more than AGREED_SHARE of other words is forgiven; where
  nothing of the title returns, OTHER_SHARE is.

A document is filler, an error page or a script notice only if its whole body is:
page furniture and a short title (up to four words among the first three units)
apart, at most that share of its words may lie in units of no such kind. A
template field anywhere outside code makes a document ``placeholder``, unless it
is one of the other kinds as a whole. Null and blank texts are none of these.

The text is read once by the detectors, whose expressions are tried only where a
literal stands that every match holds (:mod:`.literals`), and once more for filler
words, in documents that the marks may change. What is learned is joined by 8-byte
hashes; nothing that grows with the data is broadcast uncounted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import join_checked, stage
from .literals import Screen

KINDS = ("filler", "error_page", "script_notice")
MIN_CONTEXTS, MIN_SHARE, OTHER_SHARE, AGREED_SHARE = 2, 0.6, 0.15, 0.05
#: Share of other words in documents from whose kind the corpus learns.
SEED_SHARE = 0.6
#: Share of the documents with a word that must be filler; pseudo-Latin texts that open otherwise are not known as filler yet, so it is low.
MARK_SHARE = 0.2
#: Share of the words of a unit that must be marks.
FILLED = 0.7

_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`|<code\b.*?</code>|<pre\b.*?</pre>", re.S | re.I)

_FIELD = re.compile(
    r"""
      \{\{[^{}\n]{1,60}\}\}                      # {{ name }}
    | \{%[^{}\n]{1,60}%\}                        # {% block %}
    | [$\#]\{[^{}\n]{1,60}\}                     # ${name}, #{name}
    | <%=?[^<>\n]{1,60}%>                        # <%= name %>
    | (?<![\w\\}^_"'])\{\??[A-Za-z_][\w.]*(?:\|[\w.]*)?\}   # {name}, {?name}, {name|default}
    | %%[A-Za-z][\w.]*%%                         # %%NAME%%
    | %\([A-Za-z_]\w*\)[sdif]                    # %(name)s
    | @@[A-Za-z][\w.]*@@
    | <<[A-Za-z][\w .]*>>
    | (?<!\w)__(?!(?:init|main|name|file|all|dict|doc|str|repr|call|new|len|iter|next|enter|exit|version|class)__)[A-Za-z][A-Za-z_]*?[A-Za-z]__(?!\w)
    | \[\[\s*(?:INSERT|ADD|ENTER|YOUR)\b[^\[\]\n]{0,60}\]\]
    | \[xx\s[^\[\]\n]{1,40}\sxx\]
    | \[(?:TODO|TBD|FIXME)\b[^\[\]\n]{0,60}\]
    | \[(?:[A-ZÄÖÜÉÈÁÍÓÚÑ]{2,}[ _-])+[A-ZÄÖÜÉÈÁÍÓÚÑ]{2,}\]
    | \[(?i:your|insert|enter|ihr|ihren?|votre|su|tu)\s[^\[\]\n]{1,40}\]
    | <(?i:your|insert|enter|add|ihr|ihren?|votre|insérer|inserte|su)\s[^<>\n]{1,40}>
    | <[^<>\n/]{1,30}\s(?i:eintragen|einfügen|einsetzen|here|aquí|ici)>
    | \bX{3,}-[A-Z]+(?:-[A-Z]+)*-X{3,}\b
    """,
    re.X,
)

_FURNITURE = re.compile(
    r"""^\W*(?:menu|search|skip\ to\ (?:main\ )?content|cart(?:\ \(\d+\))?|back\ to\ (?:start|top|home)(?:\ page)?|home|shop|help|contact|login|log\ in|sign\ in|home\ \|.*
    |(?:©|\(c\)|copyright)\s.{0,60}|all\ rights\ reserved|reference\s[\w-]+|incident(?:\ id)?\s[\w-]+|status:?\s\d+|http\s\d+|\d{3}
    |(?:error|fehler|erreur|aviso|störung|incident|request\ failed|whoops|oops|oups|hoppla|vaya|sorry(?:\ about\ that)?)(?:\s\d+)?)\W*$""",
    re.I | re.X,
)

_SCRIPT = re.compile(
    r"""\b(?:java\s?script|js|scripts?|scripting|noscript)\b""", re.I
)
_SCRIPT_STATE = re.compile(
    r"""\b(?:enable|allow|activate|turn(?:ed)?\ (?:it\ )?(?:on|off)|switch(?:ed)?\ (?:it\ )?(?:on|off)|disabled?|blocked|needs?|requires?d?|required|missing|not\ running|does\ not\ support|appears?\ to\ be\ off|without|must
    |aktivieren|ausgeschaltet|benötigt|deaktiviert|sonst|ohne|désactivé|activez|requis|nécessaire|sans|desactivado|active|activa|habilite|necesita|necesario|sin)\b""",
    re.I | re.X,
)
_ERROR = tuple(
    re.compile(x, re.I | re.X)
    for x in (
        r"\b(?:page|site|link|address|resource|file|url|address\ you\ typed)\b.{0,40}\b(?:not\ found|does\ not\ exist|removed|moved|expired|vanished|broken|gone|leads\ nowhere|can.?t\ be\ reached|unavailable)\b",
        r"\bnot\ found\b",
        r"\bbad\ gateway\b",
        r"\bgateway\ time-?out\b",
        r"\binternal\ server\ error\b",
        r"\bforbidden\b",
        r"\baccess\ denied\b",
        r"\btoo\ many\ requests\b",
        r"\bservice\ (?:is\ )?(?:temporarily\ )?unavailable\b",
        r"\bunauthori[sz]ed\b",
        r"\b(?:could\ not|couldn.?t|cannot|can.?t|failed\ to|unable\ to)\ (?:find|open|load|handle|process|connect|reach|display|be\ reached)\b",
        r"\b(?:took\ too\ long\ to|sent\ no\ valid)\ (?:answer|respond|response)\b",
        r"\btimed\ out\b",
        r"\bupstream\ (?:host|server)\b",
        r"\b(?:offline|down|closed)\ for\ (?:planned\ |scheduled\ )?(?:work|maintenance)\b",
        r"\bunder\ maintenance\b",
        r"\b(?:session|sign-in|login)\b.{0,20}\b(?:expired|no\ longer\ valid|timed\ out)\b",
        r"\bsign\ in\ again\b",
        r"\b(?:not\ permitted|not\ allowed|not\ authori[sz]ed|no\ permission|lack\ the\ rights|do\ not\ have\ (?:permission|access))\b",
        r"\b(?:come\ back|try\ again|retry|slow\ down)\b.{0,20}\b(?:later|minutes?|moments?)\b",
        r"\btry\ again\b",
        r"\bpress\ reload\b",
        r"\bgo\ back\ or\ use\b",
        r"\bunexpected\ (?:fault|error)\b",
        r"\bsomething\ (?:broke|went\ wrong)\b",
        r"\brequest\ (?:was\ )?(?:failed|blocked)\b",
        r"\bfatal\b.{0,12}\b(?:could|error)\b",
        r"\bserver\ error\b",
        r'"status"\s*:\s*[45]\d\d',
        r'"error"\s*:',
        r"\bnicht\ (?:gefunden|verfügbar|erreichbar)\b",
        r"\bzugriff\ verweigert\b",
        r"\bseite\b.{0,30}\b(?:entfernt|nicht\ mehr|verschoben)\b",
        r"\bantwortet\ nicht\b",
        r"\bbitte\ laden\ sie\ neu\b",
        r"\bdürfen\ diesen\b",
        r"\bspäter\ (?:noch\ einmal|erneut)\b",
        r"\bwartungsarbeiten\b",
        r"\b(?:no\ encontrad[ao]|no\ está\ disponible|ya\ no\ está|acceso\ denegado|tardó\ demasiado|no\ tiene\ permiso|vuelva\ a\ intentarlo|en\ mantenimiento)\b",
        r"\b(?:introuvable|indisponible|accès\ refusé|trop\ de\ temps\ à\ répondre|a\ été\ (?:retirée|supprimée|déplacée)|pas\ le\ droit|réessayez|en\ maintenance)\b",
    )
)

_FILLER = tuple(
    re.compile(x, re.I | re.X)
    for x in (
        r"\blorem\ ipsum\b",
        r"\b(?:sample|dummy|placeholder|filler|example)\ (?:text|copy|content|paragraph|description)\b",
        r"\b(?:text|copy|content|description|headline|title|paragraph)\ (?:goes|comes|belongs)\ (?:here|in\ this\ spot)\b",
        r"\b(?:your|insert|add|enter)\ (?:\w+\ )?(?:text|description|content|headline|copy|title)\ here\b",
        r"\b(?:content|text|description|more)\ coming\ soon\b",
        r"\bto\ be\ (?:replaced|written|done|determined)\b",
        r"\bfor\ layout\ only\b",
        r"\b(?:asdf|qwer|qwertz?y?|hjkl|yxcv|zxcv|foo\ bar|blah)\b",
        r"\bxxx\b",
        r"\btest\ test\b",
        r"\b(?:blindtext|platzhaltertext|mustertext|beispieltext|texto\ de\ (?:ejemplo|relleno|prueba)|faux\ texte|texte\ (?:d.exemple|factice|de\ remplissage))\b",
    )
)
#: Anchored, so tried on every unit.
_STATUS = re.compile(r"^\W*(?:error|fehler|erreur|http|status|aviso)\s?:?\s?[45]\d\d\b|^\W*[45]\d\d\s[-–—:|]", re.I)
_NOTE = re.compile(r"^\W*(?:tbd|tba|todo|n/?a)(?:\W+(?:tbd|tba|todo))*\W*$", re.I)
_CLASSIC = re.compile(r"^\W*lorem\s+ipsum\b", re.I)
_SPLIT = re.compile(r"\n+|(?<=[.!?])\s+|\s\|\s")
_WORD = re.compile(r"[^\W\d_]+")


_TRIED = {("script", 0): _SCRIPT} | {("error", i): x for i, x in enumerate(_ERROR)} | {("filler", i): x for i, x in enumerate(_FILLER)}
_SCREEN = Screen(_TRIED)
_ALL = frozenset(_TRIED)
#: Signs of which every template field holds one.
_FIELD_SIGN = re.compile(r"[{%@<\[]|__|XXX")
_CODE_SIGN = re.compile(r"[`<]|~~~")


def seed_kind(unit: str, tokens: list[str] | None = None, may: frozenset | set = _ALL) -> int:
    """1 filler, 2 error, 3 script notice, 4 page furniture, 5 the classic filler, 0 none of these by its wording.
    ``may``: the screened expressions whose literals occur."""
    if _CLASSIC.search(unit):
        return 5
    if _FURNITURE.search(unit):
        return 4
    matched = {kind for kind, i in may if _TRIED[kind, i].search(unit)} if may else ()
    if "script" in matched and _SCRIPT_STATE.search(unit):
        return 3
    if "error" in matched or _STATUS.search(unit):
        return 2
    if "filler" in matched or _NOTE.search(unit):
        return 1
    tokens = _WORD.findall(unit.lower()) if tokens is None else tokens
    return int(any(a == b == c for a, b, c in zip(tokens, tokens[1:], tokens[2:])))


def has_field(text: str) -> bool:
    """Whether a template field is left outside code."""
    if not _FIELD_SIGN.search(text):
        return False
    return _FIELD.search(_CODE.sub(" ", text) if _CODE_SIGN.search(text) else text) is not None


def units_of(text: str) -> list[tuple[int, str]]:
    """Lines and sentences with their places."""
    out, at = [], 0
    for m in _SPLIT.finditer(text):
        out.append((at, text[at : m.start()]))
        at = m.end()
    out.append((at, text[at:]))
    return [(a, u) for a, u in out if u.strip()]


def seeds(text: str) -> list[tuple[str, int, list[str]]]:
    """Unit, kind by its wording, words of every unit; screened, with the same result as :func:`seed_kind` on each."""
    units = units_of(text)
    may = _SCREEN.by_unit(text, [a for a, _ in units])
    out = []
    for i, (_, u) in enumerate(units):
        tokens = _WORD.findall(u.lower())
        out.append((u, seed_kind(u, tokens, may.get(i, ())), tokens))
    return out


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) >> 1


def _verdict(votes: list[int], other: int, share: float) -> int:
    """1 filler, 2 error page, 3 script notice, 0 none: the kind with the most words, of equal ones the later."""
    most = max(votes)
    if not most or other > share * (sum(votes) + other):
        return 0
    return 3 - votes[::-1].index(most)


_LOOKED = "doc_id bigint, context bigint, field boolean, agreed boolean, seed int, filler int, error_page int, script_notice int, units array<struct<opening:bigint,words:int>>, vocabulary array<struct<word:string,n:bigint,f:bigint>>"
#: Words of the vocabulary that are counted before they are handed on.
_COUNTED = 200_000


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a document; the counted vocabulary of many documents hangs on one of their rows."""
    n, f = Counter(), Counter()

    def counts() -> list[tuple[int, int, int]]:
        made = [(w, c, f[w]) for w, c in n.items()]
        n.clear(), f.clear()
        return made

    for batch in batches:
        rows = []
        for key, text, source, kind in zip(batch["doc_id"], batch["text"], batch["source"], batch["doc_type"]):
            votes, unknown, other, classic, body = [0, 0, 0], [], 0, False, set()
            found = seeds(text)
            for i, (_, k, tokens) in enumerate(found):
                if i:
                    body.update(tokens)
                size = max(1, len(tokens))
                if k in (1, 2, 3, 5):
                    votes[k - 1 if k < 4 else 0] += size
                    classic |= k == 5
                elif k == 0 and not (i < 3 and len(tokens) <= 4):
                    unknown.append((_hash(tokens[:3]), size))
                    other += size
            title = found[0][2] if found else []
            agreed = len(title) <= 8 and any(len(w) >= 4 and w in body for w in title)
            body.update(title)
            seed = 1 if classic else _verdict(votes, other, SEED_SHARE)
            n.update(body)
            if seed == 1:
                f.update(body)
            context = xxhash.xxh64_intdigest(f"{source or ''}\t{(kind or '').lower()}") >> 1
            rows.append((key, context, has_field(text), agreed, seed, *votes, unknown, None))
        if rows:
            if len(n) > _COUNTED:
                rows[-1] = (*rows[-1][:-1], counts())
            yield pd.DataFrame(rows, columns=_COLUMNS)
    if n:
        # what is left to hand on, on a row that stands for no document
        yield pd.DataFrame([(None, None, None, None, None, None, None, None, None, counts())], columns=_COLUMNS)


_COLUMNS = [c.split()[0] for c in re.sub(r"<[^ ]*>", "", _LOOKED).split(", ")]


#: Marks up to this number are handed to the workers; more are joined to the words of the texts.
MARKS = 200_000


def _unknown(text: str) -> Iterator[tuple[int, list[str]]]:
    for i, (_, k, tokens) in enumerate(seeds(text)):
        if k == 0 and tokens and not (i < 3 and len(tokens) <= 4):
            yield i, tokens


def _filled(marks: frozenset | None):
    """Units of unknown wording with their distinct words; of known ``marks`` only the units that consist of these, without their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                if marks is not None and marks.isdisjoint(_WORD.findall(text.lower())):
                    continue
                for i, tokens in _unknown(text):
                    own = set(tokens)
                    if marks is None:
                        rows.append((key, i, _hash(tokens[:3]), len(tokens), len(own), sorted(own)))
                    elif len(own & marks) >= FILLED * len(own):
                        rows.append((key, i, _hash(tokens[:3]), len(tokens), len(own), None))
            yield pd.DataFrame(rows, columns=["doc_id", "at", "opening", "words", "all", "tokens"])

    return run


def classify(documents: DataFrame, duplicates: bool = True, titles: bool = True, most_marks: int = MARKS) -> DataFrame:
    """``doc_id, residue_kind`` of the documents (doc_id, text, source, doc_type) that are residue or hold some.
    ``duplicates`` and ``titles`` turn the evidence of repeated responses and of titles on."""
    kind = F.col("doc_type") if "doc_type" in documents.columns else F.lit(None).cast("string")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", kind.alias("doc_type")).where("doc_id is not null and length(trim(text)) > 0")
    looked = stage(docs.mapInPandas(_look, _LOOKED), "looked")
    seen = looked.where("doc_id is not null")
    empty = documents.sparkSession.createDataFrame([], "opening bigint, learned int")
    filled = documents.sparkSession.createDataFrame([], "doc_id bigint, fill int, opening bigint")
    if duplicates:
        # openings of unknown units of seeded documents, counted wherever they stand
        units = seen.select("doc_id", "context", "seed", F.inline("units"))
        asked = stage(units.where("seed > 0").select("opening").distinct(), "asked")
        counted = join_checked(units, asked, "opening", "left_semi").groupBy("opening").agg(F.count("*").alias("n"), F.approx_count_distinct("context").alias("contexts"), *(F.count_if(F.col("seed") == i + 1).alias(k) for i, k in enumerate(KINDS)))
        most = F.greatest(*KINDS)
        learned = counted.where((F.col("contexts") >= MIN_CONTEXTS) & (most >= MIN_SHARE * F.col("n")))
        empty = stage(learned.select("opening", F.when(F.col("filler") == most, 1).when(F.col("error_page") == most, 2).otherwise(3).alias("learned")), "learned")
        # words that mark filler, and the units that consist of them
        words = looked.where("vocabulary is not null").select(F.inline("vocabulary")).groupBy("word").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
        marks = stage(words.where((F.col("n") >= 3) & (F.col("f") >= MARK_SHARE * F.col("n"))).select("word"), "marks")
        shape = "doc_id bigint, at int, opening bigint, words int, all int, tokens array<string>"
        if marks.limit(most_marks + 1).count() <= most_marks:
            hits = docs.select("doc_id", "text").mapInPandas(_filled(frozenset(r["word"] for r in marks.collect())), shape)
        else:
            spoken = docs.select("doc_id", "text").mapInPandas(_filled(None), shape)
            hits = spoken.select("doc_id", "at", "opening", "words", "all", F.explode("tokens").alias("word")).join(marks, "word", "left_semi")
            hits = hits.groupBy("doc_id", "at").agg(*(F.first(c).alias(c) for c in ("opening", "words", "all")), F.count("*").alias("hits")).where(F.col("hits") >= FILLED * F.col("all"))
        filled = stage(hits.select("doc_id", F.col("words").alias("fill"), "opening"), "filled")

    # units that are both filled and learned count as filled
    known = join_checked(seen.select("doc_id", F.inline("units")), empty, "opening")
    sure = filled.groupBy("doc_id", "opening").agg(F.count("*").alias("times"))
    known = known.join(sure, ["doc_id", "opening"], "left_anti")
    more = known.select("doc_id", *(F.when(F.col("learned") == i + 1, F.col("words")).otherwise(0).alias(f"m_{k}") for i, k in enumerate(KINDS)))
    more = more.union(filled.select("doc_id", F.col("fill"), F.lit(0), F.lit(0))).groupBy("doc_id").agg(*(F.sum(f"m_{k}").alias(f"m_{k}") for k in KINDS))
    one = seen.join(more, "doc_id", "left")
    votes = [F.col(k) + F.coalesce(f"m_{k}", F.lit(0)) for k in KINDS]
    one = one.select("doc_id", "field", "agreed", *(v.alias(k) for v, k in zip(votes, KINDS)), (F.aggregate("units", F.lit(0), lambda a, u: a + u["words"]) - sum(F.coalesce(f"m_{k}", F.lit(0)) for k in KINDS)).alias("other"))
    most, total = F.greatest(*KINDS), sum((F.col(k) for k in KINDS), F.col("other"))
    share = F.when(F.col("agreed"), AGREED_SHARE).otherwise(OTHER_SHARE) if titles else F.lit(OTHER_SHARE)
    name = F.when(F.col("script_notice") == most, "script_notice").when(F.col("error_page") == most, "error_page").otherwise("filler")
    whole = F.when((most > 0) & (F.col("other") <= share * total), name)
    return one.select("doc_id", F.coalesce(whole, F.when(F.col("field"), "placeholder")).alias("residue_kind")).where("residue_kind is not null").distinct()


def kept(documents: DataFrame) -> DataFrame:
    """The documents without those that are residue as a whole or hold template fields; rows with a null id or text stay."""
    found = classify(documents).select("doc_id")
    return documents.join(found, "doc_id", "left_anti")
