"""Sentence ends of scanned pages in many scripts.

Marks that end sentences in their script are candidates; dots are ambiguous.
Abbreviations and proper names are told from their unambiguous occurrences, first
those on the same page: a token whose dot a comma, or repeatedly a small letter or
a number follows is an abbreviation, one that occurs without its dot only is a
plain word, a capitalised word within a sentence that is never written small is a
name, and a token that stands before several such names is a title. Where a page
tells nothing, or contradicts itself, the corpus decides: words that follow a
question or exclamation mark start sentences beyond doubt, and a dotted token that
is nearly never followed by such a starter, but by names, stands before its name.
Dots after other tokens end a sentence exactly when no lower-case continuation
follows, which also settles abbreviations whose dot is the full stop. Scripts
without a full stop end at their own marks, Thai before its spaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.pages import Article, articles

#: A dotted token must hold this share of its script's dots, and occur so often, to be judged from the corpus.
TOKEN_SHARE, TOKEN_COUNT = 5e-5, 8
#: Share of the words after question and exclamation marks from which a word counts as a starter.
STARTER_SHARE = 1e-3
#: Share of the lower-case words after closed quotations from which a word counts as one of speaker clauses.
SPEAKER_SHARE = 0.02
#: A token followed by starters less often than this stands before names; one followed by lower case more often is a suffix.
BEFORE_NAME, SUFFIX = 0.2, 0.3
#: Most characters of a word; longer runs without white space are none.
LONGEST = 200
#: Most letters of a token that a page alone shows to be a title.
TITLE = 5
#: A line end of Thai needs its last characters before this share of the spaces within lines.
THAI_SHARE, THAI_TAIL = 2e-4, 3

#: A word of speaker clauses is this much more frequent after closed quotations than at other sentence starts, and stands there so often at least.
SPEAKER_RATIO, SPEAKER_COUNT = 10, 5
# Words of speaker clauses after a quotation, in scripts without letter case, for corpora that show none; months as after ordinals.
SPEAKERS = {"hi": ("पूछा", "कहा", "बोला", "बोली", "चिल्लाया"), "ar": ("سأل", "قال", "صاح", "هتف"), "ja": ("と",), "zh": ("问", "問", "说", "說", "喊", "道", "答", "叫")}
MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sept okt nov dez".split()
)
CLOSERS = {"“": "”", "„": "“", "«": "»", "»": "«", "‘": "’", '"': '"', "「": "」", "『": "』", "”": "”"}
_QUOTES = "".join(dict.fromkeys([*CLOSERS, *CLOSERS.values()]))
_LATIN = ("en", "de", "fr", "es", "latin")
_DOTS = (*_LATIN, "ru", "ar")
_MARKS = {
    **dict.fromkeys(_LATIN, ".!?…"), "ru": ".!?…", "ar": ".!?؟…", "hi": "।॥!?", "zh": "。！？!?", "ja": "。！？!?",
}
_SCAN = {k: re.compile(rf"(?P<m>[{re.escape(v)}][{re.escape(v)}.…]*)|[{_QUOTES}]") for k, v in _MARKS.items()}
_PLAIN_DOTS = re.compile(r"(?:\.\.\.+|…+)\Z")
_HYPHEN = re.compile(r"[-­=¬] ?\n")
_SPACE = " \n\t\xa0  　"
_LEAD = _QUOTES + "([¿¡" + _SPACE
_AFTER = re.compile(r"([.!?؟])([\xa0\"”»“’)]*)\s+[\"“„«‘»(¿¡\s]*([^\s\"“„«‘»(¿¡.,!?]+)")
_AFTER_MARK = r"[!?؟。！？।]([”“»«’」』\"]+|\s[”»’」』])?\s*[“„«‘「『\"]?"
_SAID = {"hi": re.compile(_AFTER_MARK + r"(\S*)"), "ar": re.compile(_AFTER_MARK + r"(\S*)"), "zh": re.compile(_AFTER_MARK + r"(\S?)"), "ja": re.compile(_AFTER_MARK + r"(\S?)")}
_WORD = re.compile(rf"[{re.escape(_LEAD)}]*([^\s\"“„«»‘’”(.,!?…]+)")
_WORD_REST = re.compile(r"[^\s\"“„«»‘’”(.,!?…]+")
_DIGIT = re.compile(r"\d")
_PLAIN = re.compile(r"\w+(?![\w.])")
_NAME = re.compile(r"(?<=[a-zß-öø-ÿа-яё])\s([A-ZÀ-ÞА-ЯЁ]\w+)(?![\w.])")
_DOTTED = re.compile(r"\.(?:\s*([,;،؛])|\s+(\w+))")
_INNER = re.compile(rf"[!?…(¿¡{_QUOTES}]+")
_RANGES = {
    "th": re.compile("[฀-๿]"), "hi": re.compile("[ऀ-ॿ]"), "ar": re.compile("[؀-ۿ]"), "ru": re.compile("[Ѐ-ӿ]"),
    "kana": re.compile("[぀-ヿ]"), "zh": re.compile("[㐀-鿿]"),
}


# Frequent words that tell the languages of Latin script apart.
_TELLING = {
    "en": frozenset("the of was and at that it by this for".split()),
    "de": frozenset("der die den und das von für im am bei".split()),
    "fr": frozenset("le la du et au les des un pour cette".split()),
    "es": frozenset("el los y por del una las según en con".split()),
}


def _latin(text: str) -> str:
    words = Counter(text.casefold().split())
    hits = {k: sum(words[w] for w in v) for k, v in _TELLING.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] else "latin"


def script_of(text: str) -> str:
    """The script a text is written in, for Latin script its language, by its letters
    and frequent words (the declared language may be wrong)."""
    n = len(text)
    if len(text.encode("utf-8", "surrogatepass")) < 1.15 * n:
        return _latin(text)
    count = {k: len(r.findall(text)) for k, r in _RANGES.items()}
    if count["kana"] > 0.05 * n:
        return "ja"
    best = max(("th", "hi", "ar", "ru", "zh"), key=lambda k: count[k])
    return best if count[best] > 0.15 * n else _latin(text)


@dataclass(frozen=True)
class Statistics:
    """What the corpus tells: starters, tokens before names, suffixes (by script), the shapes
    of tokens before names apart from misread letters, words of speaker clauses (small
    after a quotation, or by their place in scripts without case), and tails of Thai sentences."""

    starters: dict[str, frozenset] = field(default_factory=dict)
    before_names: dict[str, frozenset] = field(default_factory=dict)
    suffixes: dict[str, frozenset] = field(default_factory=dict)
    shapes: dict[str, frozenset] = field(default_factory=dict)
    says: dict[str, frozenset] = field(default_factory=dict)
    speakers: dict[str, tuple] = field(default_factory=dict)
    tails: frozenset = frozenset()


def _count(texts: list[str | None]) -> Counter:
    seen: Counter = Counter()
    for text in texts:
        if not text or text.isspace():
            continue
        script = script_of(text)
        if script in SPEAKERS:
            for m in _SAID[script].finditer(text):
                word = m[2]
                if word and len(word) <= LONGEST:
                    seen[script, "said" if m[1] else "begin", word, ""] += 1
        if script == "th":
            seen.update(("th", "tail", m, "") for m in re.findall(rf"(\S{{{THAI_TAIL}}}) (?=\S)", text))
        elif script not in ("hi", "zh", "ja"):
            for m in _AFTER.finditer(text):
                mark, closer, word = m.groups()
                if mark != ".":
                    if not closer.strip() and not word[0].islower():
                        seen[script, "start", word.casefold(), ""] += 1
                    elif closer.strip() and word[0].islower():
                        seen[script, "say", word, ""] += 1
                    continue
                token = _last(text, m.start()).lstrip(_LEAD)
                if token and token[-1] != "." and not _DIGIT.search(token):
                    upper = word[0].isupper() or script == "ar"
                    seen[script, "upper" if upper else "lower", token.casefold(), word.casefold() if upper else ""] += 1
    return seen


def corpus_statistics(documents: DataFrame) -> Statistics:
    """:class:`Statistics` of all documents.

    Counts are summed within map tasks and then by Spark. What is fetched is
    bounded by the shares above: 1/STARTER_SHARE starters and 1/TOKEN_SHARE tokens of
    a script, 1/SPEAKER_SHARE words after quotations, 1/THAI_SHARE tails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(_count(batch.column(0).to_pylist()))
            if len(total) > 300_000:
                yield emit(total)
                total = Counter()
        yield emit(total)

    def emit(total: Counter) -> pa.RecordBatch:
        keys = list(total)
        return pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([total[k] for k in keys], pa.int64())],
            names=["script", "kind", "token", "word", "n"],
        )

    counted = documents.select("text").mapInArrow(run, "script string, kind string, token string, word string, n bigint")
    counted = counted.groupBy("script", "kind", "token", "word").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _judged(counted)
    finally:
        counted.unpersist()


def _judged(counted: DataFrame) -> Statistics:
    sums = {(r[0], r[1]): r[2] for r in counted.groupBy("script", "kind").agg(F.sum("n")).collect()}
    if not sums:
        return Statistics()
    share = lambda kind, s: {k[0]: max(1.0, s * v) for k, v in sums.items() if k[1] == kind}

    def at_least(df: DataFrame, bound: dict[str, float]) -> DataFrame:
        if not bound:
            return df.limit(0)
        cond = F.lit(False)
        for script, v in bound.items():
            cond = cond | ((F.col("script") == script) & (F.col("n") >= v))
        return df.filter(cond)

    starters: dict[str, set] = {}
    for r in at_least(counted.filter("kind = 'start'"), share("start", STARTER_SHARE)).collect():
        starters.setdefault(r.script, set()).add(r.token)
    says: dict[str, set] = {}
    for r in at_least(counted.filter("kind = 'say'"), share("say", SPEAKER_SHARE)).collect():
        says.setdefault(r.script, set()).add(r.token)
    said = [tuple(r) for r in at_least(counted.filter("kind = 'said'"), share("said", SPEAKER_SHARE)).select("script", "token", "n").collect()]  # 1/SPEAKER_SHARE of a script
    begin = counted.filter((F.col("kind") == "begin") & F.col("token").isin(sorted({t for _, t, _ in said}))).select("script", "token", "n").collect() if said else []
    begins = {(r.script, r.token): r.n for r in begin}
    speakers: dict[str, tuple] = {}
    for script, token, n in sorted(said):
        if n >= SPEAKER_COUNT and n * sums.get((script, "begin"), 0) >= SPEAKER_RATIO * (begins.get((script, token), 0) + 1) * sums[script, "said"]:
            speakers[script] = (*speakers.get(script, ()), token)
    tails = {r.token for r in at_least(counted.filter("kind = 'tail'"), share("tail", THAI_SHARE)).collect()}
    known = F.lit(False)
    for script, words in starters.items():
        known = known | ((F.col("script") == script) & F.col("word").isin(sorted(words)))
    dotted = counted.filter("kind in ('upper', 'lower')")
    n = F.col("n")
    tokens = dotted.groupBy("script", "token").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "upper", n).otherwise(0)).alias("upper"), F.sum(F.when((F.col("kind") == "upper") & known, n).otherwise(0)).alias("starts")
    )
    dots = {s: max(TOKEN_COUNT, TOKEN_SHARE * (sums.get((s, "upper"), 0) + sums.get((s, "lower"), 0))) for s in {k[0] for k in sums}}
    before: dict[str, set] = {}
    suffix: dict[str, set] = {}
    for r in at_least(tokens, dots).collect():
        if r.upper >= 0.5 * r.n and r.starts < BEFORE_NAME * r.upper:
            before.setdefault(r.script, set()).add(r.token)
        elif r.n - r.upper > SUFFIX * r.n:
            suffix.setdefault(r.script, set()).add(r.token)
    frozen = lambda d: {k: frozenset(v) for k, v in d.items()}
    shapes = {k: {_shape(w) for w in v if len(w) > 1} for k, v in before.items()}
    return Statistics(frozen(starters), frozen(before), frozen(suffix), frozen(shapes), frozen(says), speakers, frozenset(tails))


@dataclass(frozen=True)
class Evidence:
    """What one page tells, over all its articles: abbreviations, plain words, titles
    (casefolded), proper names and words written small."""

    abbreviations: frozenset = frozenset()
    plain: frozenset = frozenset()
    titles: frozenset = frozenset()
    names: frozenset = frozenset()
    small: frozenset = frozenset()


def page_evidence(texts: list[str], script: str) -> Evidence:
    """:class:`Evidence` of the articles of a page."""
    text = _HYPHEN.sub("", "\n\n".join(texts))
    words = set(_PLAIN.findall(text))
    plain = set(map(str.casefold, words))
    small = set(filter(str.islower, words))
    goes_on: Counter = Counter()
    followed: dict[str, list[str]] = {}
    for m in _DOTTED.finditer(text):
        i = m.start()
        token = _last(text, i)
        token = token.lstrip(_LEAD).casefold() if token and token[-1].isalpha() else ""
        if not token:
            continue
        word = m[2] or ","
        c = word[0]
        if m[1]:
            goes_on[token] += 2
        elif c.islower() or c.isdigit():
            goes_on[token] += 1
        elif c.isupper():
            followed.setdefault(token, []).append(word)
    # In German every noun has a capital, which then tells no name.
    names = {w for w in _NAME.findall(text) if not w.isupper() and w.casefold() not in small} if script != "de" else set()
    titles = {t for t, after in followed.items() if 1 < len(t) <= TITLE and t not in goes_on and t not in plain and len(after) > 1 and names.issuperset(after)}
    return Evidence(
        frozenset(t for t, k in goes_on.items() if k > 1 and len(t) > 1 and t not in plain),
        frozenset(plain.difference(goes_on)), frozenset(titles), frozenset(names), frozenset(small),
    )


def _last(text: str, i: int) -> str:
    """What stands before ``i`` since the last white space; '' if that is more than :data:`LONGEST`
    characters, which is no word, and so no abbreviation."""
    piece = text[max(0, i - LONGEST - 1) : i]
    last = "" if piece[-1:].isspace() else piece.rsplit(None, 1)[-1] if piece else ""
    return last if len(last) <= LONGEST else ""


def _token_before(s: str, i: int) -> str:
    """The word before a mark, also where a line break parts it."""
    piece = s[max(0, i - LONGEST - 1) : i]
    if "\n" in piece:
        piece = _HYPHEN.sub("", piece)
    last = piece.rsplit(None, 1)[-1:]
    return _INNER.split(last[0].rstrip())[-1] if last and len(last[0].rstrip()) <= LONGEST else ""


def _word_after(s: str, i: int) -> str:
    """The first word after a mark, also where a line break parts it."""
    m = _WORD.match(s, i)
    if m is None:
        k = i
        while k < len(s) and s[k] in _LEAD:
            k += 1
        return s[k : k + 1]
    word = m[1]
    if word[-1] in "-\xad=¬":
        rest = _HYPHEN.match(s, m.end() - 1)
        if rest is None:
            return word
        more = _WORD_REST.match(s, rest.end())
        return word[:-1] + more[0] if more else word
    return word


# Fixed value: letters that scans take for one another, each with the one that stands for its group.
_CONFUSED = str.maketrans("cea0utſsi1bq58оп", "oooonfffllhgfhoн")


def _shape(word: str) -> str:
    """A word up to misread letters."""
    return word.replace("rn", "m").replace("cl", "d").translate(_CONFUSED)


_MONTH_SHAPES = frozenset(_shape(m) for m in MONTHS)


def _misread_capital(word: str, starters: frozenset | tuple) -> bool:
    """Whether a lower-case word is a starter whose capital I was misread as l."""
    return word[0] == "l" and word not in starters and "i" + word[1:] in starters


def _names(folded: str, script: str, stats: Statistics) -> bool:
    """Whether a token stands before names, also where a letter of it was misread."""
    known = stats.before_names.get(script, ())
    return folded in known or len(folded) > 1 and _shape(folded) in stats.shapes.get(script, ()) or "." in folded and folded.rpartition(".")[2] in known


def _suffix(folded: str, script: str, stats: Statistics) -> bool:
    """Whether a token is an abbreviation after which a sentence goes on, also where a letter of it was misread."""
    return _shape(folded) in _shapes(stats.suffixes.get(script, frozenset()))


@lru_cache(maxsize=16)
def _shapes(words: frozenset) -> frozenset:
    return frozenset(map(_shape, words))


def _digit_for_initial(left: str, word: str, script: str, stats: Statistics) -> bool:
    """Whether a single digit stands where an initial does: after a title or initial, or before an initial and not after a counting abbreviation."""
    before = left.split()[-1:]
    token = before[0].lstrip(_LEAD) if before else ""
    folded = token.rstrip(".").casefold()
    if token.endswith(".") and (len(folded) == 1 or _names(folded, script, stats)):
        return True
    return len(word) == 1 and not (token.endswith(".") and (folded in stats.suffixes.get(script, ()) or _DIGIT.search(folded)))


def _dot_ends(script: str, token: str, word: str, near: bool, stats: Statistics, page: Evidence, left: str = "") -> bool:
    """Whether the dot after ``token`` and before ``word`` is a full stop. ``near``: no space between."""
    if "." in token and token.rpartition(".")[2][:1].isupper():  # no space after the full stop before, or p.m. in capitals
        token = token.rpartition(".")[2]
    folded = token.casefold()
    start = stats.starters.get(script, frozenset())
    starter = word.casefold() in start
    first = word[:1]
    if near and not (first.isupper() and len(token) > 2 and token[-1:].islower()):
        return False
    if not word:
        return bool(token) and not (len(token) == 1 and not token.islower() and token.isalpha()) and not _names(folded, script, stats)
    if first.islower() and not _misread_capital(word, start):
        # What follows a full stop may start small where passages were put in; an abbreviation that goes on is a suffix.
        return len(token) > 2 and token.isalpha() and not near and folded not in page.abbreviations and not _suffix(folded, script, stats) and not _names(folded, script, stats)
    if first in ",;:—–-?!؟":
        return False
    if _DIGIT.search(token):
        if first.isupper() and (len(token) == 1 and _digit_for_initial(left, word, script, stats) or len(token) <= 5 and not token.isdigit() and _names(folded, script, stats)):
            return False  # an initial or a title with a letter misread as a digit
        ordinal = token.isdigit() and len(token) <= 2 and (word.casefold() in MONTHS or _shape(word.casefold()) in _MONTH_SHAPES)
        return not first.isdigit() and not ordinal
    if len(token) == 1 and token.isalpha() and not token.islower():
        return False
    if first.isupper() and len(word) > 1:  # the page first
        if folded in page.abbreviations and word in page.names or folded in page.titles:
            return False
        if folded in page.plain and word not in page.names:
            return True
        if folded in page.abbreviations and not word.isupper() and word.casefold() in page.small:
            return True
    if _names(folded, script, stats) and not (starter and folded in page.plain):
        return False
    if first.isdigit():
        return len(token) > 4 and token.isalpha() and folded not in stats.suffixes.get(script, ())
    capital = len(word) > 1 and word.isupper()
    if capital and folded in stats.suffixes.get(script, ()):
        return starter
    return True


def _ends(text: str, script: str, stats: Statistics, page: Evidence | None = None) -> Iterator[int]:
    """Lengths up to the sentence ends of one article; ``page``: the evidence of its page (default: of this article)."""
    n = len(text)
    if script == "th":
        for m in re.finditer(r"(?<=\S)[ \xa0]+(?=\S|\n|\Z)", text):
            at, line_end = m.start(), text[m.end() : m.end() + 1] in ("\n", "")
            if not line_end or not stats.tails or text[max(0, at - THAI_TAIL) : at] in stats.tails:
                yield at
        return
    opened = ""
    after_mark = -1
    speakers = stats.speakers.get(script) or SPEAKERS.get(script)
    for m in _SCAN[script].finditer(text):
        if m["m"] is None:
            q, at = m[0], m.start()
            if at < after_mark:
                continue
            if opened and q == CLOSERS[opened]:
                opened = ""
            elif q in ("’", "'") and not opened:
                continue
            elif q == "»" and not opened and text[at - 1 : at] in ("\xa0", ".", "!", "?"):
                continue
            elif q in CLOSERS:
                opened = q
            continue
        run, i, j = m["m"], m.start(), m.end()
        if j < after_mark:
            continue
        e = j
        closed = False
        while True:  # closing quotes and brackets, also after stray spaces
            k = e
            while k < n and text[k] in _SPACE:
                k += 1
            c = text[k : k + 1]
            if opened and c == CLOSERS[opened] and (k == e or c != '"' or not text[k + 1 : k + 2].isalnum()):
                opened, e, closed = "", k + 1, True
            elif c and c in _QUOTES and (k == e and (k + 1 == n or text[k + 1] in _SPACE) or c == "»" and text[k - 1] == "\xa0"):
                opened, e, closed = "", k + 1, True  # also where the scan lost the opening quote
            elif c == ")" and k == e or (c in ("”", "’", "」", "』") and k == e and c):
                e, closed = k + 1, closed or c != ")"
            else:
                break
        after_mark = e
        word = _word_after(text, e)
        near = text[e : e + 1] not in (*_SPACE, "") and not closed
        if "?" in run or "!" in run or run[0] in "。！？।॥؟" or any(c in "。！？।॥؟" for c in run):
            if closed and word:
                if speakers:
                    if word.startswith(speakers):
                        continue
                elif word[0].islower() and not _misread_capital(word, stats.starters.get(script, ())):
                    continue
                elif word.isupper() and word.casefold() in stats.says.get(script, ()):
                    continue
            yield e
            continue
        if _PLAIN_DOTS.match(run):
            if text[i - 1 : i] != ".":
                continue
        token = _token_before(text, i)
        if script == "hi" or not token and not closed or text[e : e + 3].lstrip(_SPACE)[:1] == "(":
            continue
        if page is None:
            page = page_evidence([text], script)
        if speakers and closed and word.startswith(speakers):
            continue
        if _dot_ends(script, token, word, near, stats, page, text[max(0, i - len(token) - 8) : max(0, i - len(token))]):
            yield e


def sentence_ends(page: list[Article], stats: Statistics) -> list[int]:
    """Characters of the page's text up to each sentence end of its articles, ascending."""
    out = []
    script = script_of("\n".join(a.text for a in page)) if page else ""
    evidence = page_evidence([a.text for a in page], script) if script in _DOTS else Evidence()
    for a in page:
        out += [a.position(e) for e in _ends(a.text, script, stats, evidence)]
    return sorted(set(out))


def sentences(documents: DataFrame, stats: Statistics | None = None) -> DataFrame:
    """``doc_id, end_pos`` of each sentence of the articles of ``documents``.

    Null, empty and blank texts have none; repeated rows give repeated results;
    pages without usable boxes count as one article in text order.
    """
    known = corpus_statistics(documents) if stats is None else stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = articles(batch.column("text"), batch.column("lines"))
            ids, ends = [], []
            for doc_id, page in zip(batch.column("doc_id").to_pylist(), pages, strict=True):
                found = sentence_ends(page, known)
                ids += [doc_id] * len(found)
                ends += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int32())], names=["doc_id", "end_pos"])

    return documents.select("doc_id", "text", "lines").mapInArrow(run, "doc_id bigint, end_pos int")
