"""Defective answers: noisy labelling functions joined by a label model.

For every kind of defect several labelling functions look at a question and its
answer and vote for (1), against (0) or not at all (-). They look at different
things, so that they fail independently: wording, length, overlap with the
question, the corpus. A label model per defect takes the true label as hidden and
the votes as independent given it, and is fitted by expectation maximisation on the
counts of vote patterns over all pairs, with Beta priors that keep each function
better than chance. Only the patterns and their counts, 3 ** functions rows at most,
come to the driver. A pair keeps every label whose posterior reaches its cutoff
(CUTOFFS, validated on corrupted copies of sound pairs, see the tests);
:func:`defects` keeps the likeliest.

What the corpus is asked:

* how the languages are spelled: counts of character trigrams (TRIGRAMS cells a
  language) in all messages whose language the stop words tell;
* how often the last two words of an answer without a final sign end a sentence or a
  line anywhere, and how often its last word stands anywhere;
* to how many questions an answer begins with the same four words.

Null and blank answers are ``empty``; null questions have no words, so nothing is
copied from them and no language differs; messages without thread, seq or role
form no pairs; of several messages of one thread, seq and role the largest text counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import join_checked, stage
from .literals import Screen
from .text import KeyBits, WordHasher, grams

DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")
CUTOFFS = {"empty": 0.5, "copied_question": 0.5, "refusal": 0.9, "other_language": 0.5, "truncated": 0.5}
#: Labelling functions per defect.
FUNCTIONS = {"empty": 3, "copied_question": 4, "refusal": 4, "other_language": 3, "truncated": 5}
#: Cells of the table of character trigrams.
TRIGRAMS = 1 << 14
#: Mean log-odds per trigram between the first and the second language from which the spelling tells.
SPELLED = 0.12
#: Answers with the same opening from which it counts as a stock phrase.
STOCK = 4

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W_]+")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|https?://\S+|\b[\w.-]+\.\w{2,}/\S*", re.S)
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+")
_LINK = re.compile(r"(?:https?://|www\.|\b[\w-]+\.[\w.-]+/)\S*$")
_SENTENCE = re.compile(r"(?<=[.!?…:])\s+|\n+")

#: Signs and words for "nothing".
_NOTHING = {
    "", "n a", "na", "none", "null", "nil", "nan", "nothing", "empty", "blank", "undefined", "no response", "no answer", "no content", "no reply", "tbd", "todo",
    "leer", "nichts", "keine", "keine antwort", "ohne antwort", "nada", "vacío", "vacio", "ninguna", "ninguno", "sin respuesta", "rien", "vide", "aucun", "aucune", "aucune réponse", "pas de réponse", "sans réponse",
}

#: Frequent words that tell the languages apart.
_STOP = {
    "en": "the and of to is that for with was are this not you have from your when more than before after it as how do can which our their its be we at but will what why does or by an if were has both either every each only until there".split(),
    "de": "der die das und ist nicht mit für ein eine einen dem den des auf von zu im wird wurde oder aber wie wir sie ich es sich noch nur auch nach bei seit als dass kann haben hat sind dort dafür danach denn doch davon wer ohne zwischen bitte leider".split(),
    "es": "el la los las que de y en un una por para con no es está se del al lo su pero como más desde hasta sin sobre cuando quien hay ya muy solo nos ha hemos puede pueden todavía luego entre necesita aquí cada".split(),
    "fr": "le la les des et est pas que dans une un pour avec sur du au ce cette il elle nous vous je ne se qui mais ou sans depuis après avant entre très plus peut vont encore puis toujours chaque celui dont aux son sa ses été avons".split(),
}
LANGUAGES = tuple(_STOP)
_SHARED = {w for a in _STOP for b in _STOP if a < b for w in set(_STOP[a]) & set(_STOP[b])}
_LANG = {w: i for i, ws in enumerate(_STOP.values()) for w in ws if w not in _SHARED}
#: Letters that count half a stop word, up to three of them.
_SIGNS = {c: i for i, cs in ((1, "äöüß"), (2, "ñ¿¡"), (3, "çêèàùûôîœ")) for c in cs}
_SIGN = re.compile("[" + "".join(_SIGNS) + "]")
_CODE_SIGN = re.compile(r"[`/]|~~~")

_TRANSLATE = re.compile(
    r"""\b(?:translat(?:e|ion|ing)\ (?:this|that|it|these|the\ following|into|to|of)|put\ (?:this|it|that)\ in(?:to)?|say\ (?:this|it|that)\ in|(?:in|into|auf|ins|en|al|a|em)\ (?:german|english|french|spanish|deutsch\w*|englisch\w*|französisch\w*|spanisch\w*|español|inglés|francés|alemán|anglais|espagnol|allemand|français)|übersetz\w*|tradu[cizsr]\w*)\b""",
    re.I | re.X,
)
_REFUSE = re.compile(
    r"""
    \b(?:can(?:no|['’ ]?)t|can\ not|unable\ to|not\ able\ to|won['’]t|will\ not|not\ (?:permitted|allowed)\ to|must\ not|may\ not|not\ (?:be\ )?appropriate\ (?:for\ me\ )?to)\b.{0,30}\b(?:help|assist|answer|respond|discuss|provide|share|comply|fulfil\w*|comment|support|engage|talk|speak|do\ that)\b
    |\b(?:must|have\ to|need\ to|prefer\ to)\ (?:decline|refuse)\b|\bI\ (?:decline|refuse)\b|\bbeyond\ what\ I\ am\ (?:allowed|able)\b|\bagainst\ (?:my|our)\ (?:policy|rules|guidelines)\b
    |\b(?:kann|darf|möchte|werde|könnte)\b.{0,40}\b(?:nicht|nichts|keine)\b.{0,20}\b(?:helfen|beantworten|antworten|sagen|weitergeben|geben|äußern|besprechen|erteilen|bearbeiten)\b|\b(?:nicht|nichts)\ (?:helfen|beantworten|sagen)\b|\bmuss\ (?:ich\ )?(?:das\ |dies\ )?ablehnen\b|\bist\ (?:es\ )?mir\ nicht\ (?:möglich|erlaubt|gestattet)\b
    |\bno\ (?:puedo|podré|debo|podemos)\b.{0,25}\b(?:ayudar\w*|dar\w*|responder\w*|contestar\w*|hablar|compartir|atender|tratar|comentar|proporcionar)\b|\bno\ me\ está\ permitido\b|\bdebo\ (?:rechazar|declinar)\b
    |\bne\ (?:peux|puis|pourrai|pouvons)\ pas\b.{0,25}\b(?:aider|répondre|donner|traiter|fournir|discuter|partager|parler)\b|\bpas\ (?:le\ droit|autorisée?|en\ mesure)\ d[e'’]|\bm['’]est\ impossible\b|\bdois\ (?:décliner|refuser)\b|\bimpossible\ (?:pour\ moi\ )?de\ (?:répondre|traiter)\b
    """,
    re.I | re.X,
)
_POLITE = re.compile(
    r"""^(?:(?:i\ ?['’]?\s?a?m\ )?(?:very\ |so\ )?sorry|apologies|unfortunately|regrettably|as\ an?\ (?:\w+\ )?assistant|please\ (?:ask|try|contact)|es\ tut\ mir\ leid|tut\ mir\ leid|leider|entschuldig\w+|bitte\ (?:stellen|fragen)|lo\ siento|perd[oó]n\w*|lamentablemente|pregunte|je\ suis\ désolée?|désolée?|malheureusement|posez)\b""",
    re.I | re.X,
)


_SCREEN = Screen({"refuse": _REFUSE, "translate": _TRANSLATE})
#: Where a sentence is closed, or a line that another follows.
_END = re.compile(r"[.!?…]+[\"'”»)]*(?=\s|\Z)|\n")
_MARKED = re.compile(r"[^\W_]+|[\x01\x02]")
_CLOSED = re.compile(r"[.!?…。！？][\"'”»)\]*_]*\Z")
_HANGING = re.compile(r"(?:[,;:(\[{/–—-]|\s(?:the|a|an|and|or|of|to|for|with|in|on|at|by|der|die|das|und|oder|mit|für|von|im|el|la|los|y|o|de|en|con|por|para|le|les|et|ou|du|des|dans|pour|avec))\Z", re.I)


def _bare(text: str) -> str:
    """The text without code and addresses, in lower case."""
    return (_CODE.sub(" ", text) if _CODE_SIGN.search(text) else text).lower()


def by_words(bare: str, words: list[str]) -> int | None:
    """Number of the language that the stop words among the words of a text tell, or None."""
    if len(words) < 4:
        return None
    hits = [_LANG[w] for w in words if w in _LANG]
    score = [float(hits.count(i)) for i in range(len(LANGUAGES))]
    if not bare.isascii():
        signs = Counter(_SIGNS[c] for c in _SIGN.findall(bare))
        for i, n in signs.items():
            score[i] += min(3, n) * 0.5
    first = max(range(len(score)), key=score.__getitem__)
    second = max(x for i, x in enumerate(score) if i != first)
    return first if score[first] >= 2 and score[first] >= 1.5 * second + 0.5 else None


def language(text: str) -> str | None:
    """en, de, es or fr, or None where the words do not tell."""
    bare = _bare(text)
    i = by_words(bare, _WORD.findall(bare))
    return None if i is None else LANGUAGES[i]


def _trigrams(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams in the words of several texts, and the number of the text of each;
    what lies between two words is one blank."""
    code = np.frombuffer("".join(f"\n {' '.join(words)} " for words in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + code[2:]
    cells = ((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(50)).astype(np.int64)
    ends = code == 10
    whole = ~(ends[:-2] | ends[1:-1] | ends[2:])
    return cells[whole], (np.cumsum(ends)[:-2] - 1)[whole]


class Spelling:
    """Log-odds of trigrams by language, from counts ``[language, cell]``."""

    def __init__(self, counts: np.ndarray):
        share = counts + 0.5
        self.table = np.log(share / share.sum(axis=1, keepdims=True)).T.astype(np.float32)
        # a language that hardly any message is written in is never guessed
        self.table[:, counts.sum(axis=1) < max(1000, 1e-4 * counts.sum())] = -50

    def guess(self, texts: list[list[str]]) -> list[int | None]:
        """Number of the language that the spelling of each text tells, or None; texts come as their words."""
        out: list[int | None] = []
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            cells, owner = _trigrams(part)
            n = np.bincount(owner, minlength=len(part))
            score = np.stack([np.bincount(owner, self.table[cells, i], len(part)) for i in range(len(LANGUAGES))], axis=1) / np.maximum(n, 1)[:, None]
            order = np.argsort(score, axis=1)
            rows = np.arange(len(part))
            sure = (n >= 12) & (score[rows, order[:, -1]] - score[rows, order[:, -2]] >= SPELLED)
            out += [int(x) if ok else None for x, ok in zip(order[:, -1], sure)]
        return out


def _visible(text: str) -> str:
    return "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc", "Zs", "Zl", "Zp", "Co", "Cn") and c not in "ᅟᅠㅤ⠀")


def _v(x: bool | None) -> str:
    return "-" if x is None else "1" if x else "0"


def _differ(a: int | None, b: int | None) -> bool | None:
    return None if a is None or b is None else a != b


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words, numbers alike, and below of two in a row."""
    return _hasher(["0" if w.isdigit() else w for w in words])


_hasher = WordHasher()


def votes(question: str | None, answer: str | None, spelled: tuple = (None, None, None), words: tuple | None = None) -> tuple:
    """Votes per defect (in the order of DEFECTS), and what the corpus is asked: the hashes
    of the last two words and of the last word of an unclosed answer, and of the opening.
    ``spelled``: languages of question, answer and end of the answer by their spelling."""
    text = answer or ""
    a = _TOKEN.findall(text.lower())
    blank = not a and not _visible(text)
    bare = " ".join(a[:8])
    nothing = len(a) <= 8 and bare in _NOTHING and (blank or len(_visible(text)) <= 24)
    empty = _v(None if nothing and not blank else blank) + _v(nothing or blank) + _v(True if not a else None if len(a) <= 3 else False)
    if blank or nothing:
        return empty, "----", "---", "---", "----", None, None, None

    q = _TOKEN.findall((question or "").lower())
    if len(q) >= 3 and len(a) >= 3:
        pairs_q, pairs_a, own_q, own_a = set(zip(q, q[1:])), set(zip(a, a[1:])), set(q), set(a)
        common, ratio = len(pairs_q & pairs_a), len(a) / len(q)
        copied = _v(common >= 0.7 * len(pairs_a)) + _v(common >= 0.6 * len(pairs_q)) + _v(len(own_q & own_a) >= 0.85 * len(own_a)) + _v(None if 0.7 <= ratio <= 1.4 or 1.8 <= ratio <= 2.4 else False)
    else:
        copied = _v(bool(a) and a == q) * 3 + "-"

    may = _SCREEN.names(text)
    sentences = [x for x in _SENTENCE.split(text.strip()) if x.strip()]
    refusing = [bool(_REFUSE.search(x)) for x in sentences] if "refuse" in may else [False] * len(sentences)
    polite = [x.count(" ") < 8 and bool(_POLITE.search(x.strip())) for x in sentences] if len(a) <= 80 or any(refusing) else [False] * len(sentences)
    # words of what is neither refusal nor courtesy
    rest = sum(len(_WORD.findall(x)) for x, r, p in zip(sentences, refusing, polite) if not r and not p) if any(refusing) or any(polite) else len(a)
    refusal = _v(any(refusing)) + _v(any(polite)) + _v(rest <= 8)

    if "1" in copied[:1] or question and "translate" in _SCREEN.names(question) and _TRANSLATE.search(question):
        other = "000"
    else:
        said, asked = _bare(text), _bare(question or "")
        words = words or (_WORD.findall(asked), _WORD.findall(said))
        other = _v(_differ(by_words(said, words[1]), by_words(asked, words[0]))) + _v(_differ(spelled[1], spelled[0])) + _v(_differ(spelled[2], spelled[0]))

    tail = text.rstrip()
    while tail and unicodedata.category(tail[-1]) == "Cf":
        tail = tail[:-1].rstrip()
    open_code = "```" in text and len(_FENCE.findall(text)) % 2 == 1 or "~~~" in text and len(_FENCE.findall(text)) % 2 == 1
    last_line = tail.rsplit("\n", 1)[-1]
    closed = bool(_CLOSED.search(tail[-12:])) or tail.endswith(("```", "~~~"))
    item, link = bool(_ITEM.match(last_line)), bool(_LINK.search(tail.rsplit(None, 1)[-1] if tail else ""))
    short = len(a) <= 4
    # function by function: no final sign, beyond doubt by its form, hanging words or signs
    truncated = _v(open_code or (not closed and not item and not link and not short))
    truncated += _v(True if open_code else False if closed or link or short else None)
    truncated += _v(True if _HANGING.search(tail[-40:]) else None if not closed else False)
    ending = final = None
    if not closed and not link and not open_code and len(a) >= 2:
        h = word_hash(a[-2:])
        ending, final = int(grams(h, 2)[0] >> np.uint64(1)), int(h[1] >> np.uint64(1))
    opening = xxhash.xxh64_intdigest(" ".join(a[:4])) >> 1 if 4 <= len(a) <= 60 else None
    return empty, copied, refusal, other, truncated, ending, final, opening


_VOTES = "thread_id string, seq bigint, " + ", ".join(f"v_{d} string" for d in DEFECTS) + ", ending bigint, final bigint, opening bigint"


def _vote(spelling: Spelling):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked, said = ([_WORD.findall(_bare(t or "")) for t in batch[c]] for c in ("question", "answer"))
            spelled = zip(spelling.guess(asked), spelling.guess(said), spelling.guess([w[-20:] for w in said]))
            rows = [(t, s, *votes(q, a, sp, w)) for t, s, q, a, sp, w in zip(batch["thread_id"], batch["seq"], batch["question"], batch["answer"], spelled, zip(asked, said))]
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in _VOTES.split(", ")])
            yield made.astype({"ending": "Int64", "final": "Int64", "opening": "Int64"})

    return run


def _spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of trigrams by language, at most a row for each cell and language from a task."""
    counts = np.zeros((len(LANGUAGES), TRIGRAMS), np.int64)
    for batch in batches:
        told: list[list[list[str]]] = [[] for _ in LANGUAGES]
        for text in batch["content"]:
            bare = _bare(text)
            words = _WORD.findall(bare)
            i = by_words(bare, words)
            if i is not None:
                told[i].append(words)
        for i, texts in enumerate(told):
            for at in range(0, len(texts), 500):
                counts[i] += np.bincount(_trigrams(texts[at : at + 500])[0], minlength=TRIGRAMS)
    lang, cell = np.nonzero(counts)
    yield pd.DataFrame({"lang": lang.astype(np.int32), "cell": cell.astype(np.int32), "n": counts[lang, cell]})


def spelling_of(messages: DataFrame) -> Spelling:
    """The spelling of the languages in all messages; TRIGRAMS rows a language at most come to the driver."""
    rows = messages.select("content").where("length(content) > 0").mapInPandas(_spell, "lang int, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(LANGUAGES), TRIGRAMS), np.float64)
    for r in rows:
        counts[r["lang"], r["cell"]] = r["n"]
    return Spelling(counts)


def _endings(wanted: KeyBits):
    """How often the pairs of words and the words that were asked for occur, and how often a closed sentence or a line that another follows ends with the pair."""

    def asked(keys: np.ndarray) -> np.ndarray:
        return keys[wanted.maybe(keys)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, f = Counter(), Counter()
            texts = [_END.sub(" \x01 ", t.lower()) for t in batch["content"]]
            for at in range(0, len(texts), 500):
                words = _MARKED.findall(" \x02 ".join(texts[at : at + 500]))
                end = np.array([w == "\x01" for w in [*words, "\x02"]])
                word = ~end[:-1] & np.array([w != "\x02" for w in words], bool)
                h = word_hash(words)
                pair = (grams(h, 2) >> np.uint64(1)).astype(np.int64)
                inside = word[:-1] & word[1:] if len(words) > 1 else np.empty(0, bool)
                n.update(asked((h[word] >> np.uint64(1)).astype(np.int64)).tolist())
                n.update(asked(pair[inside]).tolist())
                f.update(asked(pair[inside & end[2:]] if len(words) > 1 else pair).tolist())
            keys = sorted(set(n) | set(f))
            yield pd.DataFrame({"key": keys, "n": [n.get(k, 0) for k in keys], "f": [f.get(k, 0) for k in keys]})

    return run


def fit(patterns: dict[str, int], prior: float = 0.02, rounds: int = 100) -> dict[str, float]:
    """Posterior of the defect for each vote pattern, by expectation maximisation.
    ``patterns``: pattern (one of 1, 0, - per function) and how often it occurs."""
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], np.float64)
    yes = np.array([[c == "1" for c in k] for k in keys], np.float64)
    no = np.array([[c == "0" for c in k] for k in keys], np.float64)
    m = yes.shape[1]
    hit, false, share = np.full(m, 0.9), np.full(m, 0.02), prior
    # pseudo-counts: a function finds most defects and seldom cries for nothing, however few cases there are
    strength = max(20.0, 0.002 * n.sum())
    post = np.zeros(len(keys))
    for _ in range(rounds):
        up = np.log(share) + yes @ np.log(hit) + no @ np.log1p(-hit)
        down = np.log1p(-share) + yes @ np.log(false) + no @ np.log1p(-false)
        new = 1 / (1 + np.exp(np.clip(down - up, -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
        w, v = n * post, n * (1 - post)
        hit = np.clip((w @ yes + 0.9 * strength) / (w @ (yes + no) + strength), 0.5, 0.999)
        false = np.clip((v @ yes + 0.02 * strength) / (v @ (yes + no) + strength), 1e-4, 0.3)
        share = float(np.clip((w.sum() + 0.02 * strength) / (n.sum() + strength), 1e-5, 0.5))
    return dict(zip(keys, post.tolist()))


def pairs(messages: DataFrame) -> DataFrame:
    """``thread_id, seq, question, answer``: each user message with the assistant message of the next seq."""
    user, given = F.col("role") == "user", F.col("role") == "assistant"
    rows = messages.where("thread_id is not null and seq is not null and role in ('user', 'assistant')")
    # both messages of a pair under the seq of the answer: one shuffle, and no key holds more than one pair
    rows = rows.select("thread_id", (F.col("seq").cast("bigint") + user.cast("int")).alias("seq"), user.alias("u"), given.alias("g"), F.when(user, F.col("content")).alias("question"), F.when(given, F.col("content")).alias("answer"))
    both = rows.groupBy("thread_id", "seq").agg(F.max("u").alias("u"), F.max("g").alias("g"), F.max("question").alias("question"), F.max("answer").alias("answer"))
    return both.where("u and g").drop("u", "g")


def labels(messages: DataFrame) -> DataFrame:
    """``thread_id, seq, defect_type, posterior`` of every label that reaches its cutoff."""
    known = []
    stacked = patterns(messages)
    seen = stacked.groupBy("defect_type", "pattern").agg(F.count("*").alias("n")).collect()  # 3 ** functions patterns a defect at most
    for d in DEFECTS:
        of = {r["pattern"]: r["n"] for r in seen if r["defect_type"] == d}
        if of:
            known += [(d, p, x) for p, x in fit(of).items() if x >= CUTOFFS[d] and "1" in p]
    table = messages.sparkSession.createDataFrame(known or [("", "", 0.0)], "defect_type string, pattern string, posterior double")
    return stacked.join(F.broadcast(table), ["defect_type", "pattern"]).select("thread_id", "seq", "defect_type", "posterior")


def patterns(messages: DataFrame) -> DataFrame:
    """``thread_id, seq, defect_type, pattern``: the votes on every pair."""
    voted = stage(pairs(messages).mapInPandas(_vote(spelling_of(messages)), _VOTES), "votes")
    asked = voted.select(F.explode(F.array("ending", "final")).alias("key")).where("key is not null").distinct()
    counted = messages.select("content").where("length(content) > 0").mapInPandas(_endings(KeyBits(asked, "key", 22)), "key bigint, n bigint, f bigint")
    shares = stage(join_checked(counted, asked, "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"), F.sum("f").alias("f")), "shares")
    stock = voted.where("opening is not null").groupBy("opening").agg(F.count("*").alias("stock")).where("stock > 1")
    voted = join_checked(voted, shares.withColumnRenamed("key", "ending"), "ending", "left")
    voted = join_checked(voted, shares.select(F.col("key").alias("final"), F.col("n").alias("final_n")), "final", "left")
    voted = join_checked(voted, stage(stock, "stock"), "opening", "left")
    # an ending that the corpus seldom has at the end breaks off
    seldom = F.when(F.col("ending").isNull(), "-").when(F.coalesce("f", F.lit(0)) >= 0.3 * F.coalesce("n", F.lit(1)), "0").otherwise("1")
    # a last word that stands nowhere else is half a word
    half = F.when(F.col("final").isNull(), "-").when(F.coalesce("final_n", F.lit(0)) <= 1, "1").when(F.col("final_n") >= 5, "0").otherwise("-")
    repeated = F.when(F.col("opening").isNull(), "-").when(F.col("stock") >= STOCK, "1").when(F.col("stock").isNull(), "0").otherwise("-")
    full = {"v_truncated": F.concat(F.substring("v_truncated", 1, 3), seldom, half), "v_refusal": F.concat("v_refusal", repeated)}
    voted = stage(voted.withColumns(full).select("thread_id", "seq", *(f"v_{d}" for d in DEFECTS)), "voted")
    return voted.select("thread_id", "seq", F.inline(F.array(*(F.struct(F.lit(d).alias("defect_type"), F.col(f"v_{d}").alias("pattern")) for d in DEFECTS))))


def defects(messages: DataFrame) -> DataFrame:
    """``thread_id, seq, defect_type``: the likeliest label of each defective pair; of equal ones the first of DEFECTS."""
    order = F.array_position(F.array(*(F.lit(d) for d in DEFECTS)), F.col("defect_type"))
    best = F.max_by("defect_type", F.struct(F.round("posterior", 6), -order))
    return labels(messages).groupBy("thread_id", "seq").agg(best.alias("defect_type"))
