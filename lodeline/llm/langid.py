"""The language of every document and of every segment in one language, with a confidence.

Method: cross-parsing entropy. For each language a suffix automaton is built over labelled text; a line is cut greedily
into the longest phrases that occur in a language's text, and the language that needs the fewest phrases for its
length wins. Confidence is how much fewer they are than the runner-up's. The automata are fitted on a bounded sample
of labelled rows (``SAMPLE_DOCS`` documents a label of at most ``SAMPLE_CHARS`` characters each, taken whole; a model holds
``TEXT_CHARS`` characters of distinct sentences a language); sentences in a script the language is hardly written in,
and those whose label does not survive a vote and a cross-check between two halves of the sample are left out, so wrong
labels do not teach. Every document is then judged whole.

Defined cases: null and empty texts and texts without natural language have no segments; lines without natural
language (blank, fenced or indented code, links, tables, ids) belong to the segment before them, at the start to the
first; words in quotes and in backquotes, addresses, paths and identifiers do not count; a label is right if it names the language by any usual code,
region variant or name; ties go to the language first in the alphabet; repeated rows are each judged; an input without
any usable label gives no segments; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_CHARS, TEXT_CHARS = 250, 4_000, 60_000
#: Votes and share of votes from which a sentence of the sample keeps its label without a cross-check.
CLEAR_VOTES, CLEAR_SHARE = 3, 0.6

# fixed values: code, other codes and names of each language
LANGUAGES = {
    "ar": "ara arabic العربية", "cs": "ces cze czech čeština cesky", "da": "dan danish dansk", "de": "deu ger german deutsch", "el": "ell gre greek ελληνικά",
    "en": "eng english", "es": "spa spanish español espanol castellano castilian", "fi": "fin finnish suomi", "fr": "fra fre french français francais",
    "hi": "hin hindi हिन्दी", "hu": "hun hungarian magyar", "id": "ind indonesian", "it": "ita italian italiano", "ja": "jpn jp japanese 日本語 nihongo",
    "ko": "kor korean 한국어", "nl": "nld dut dutch nederlands", "no": "nor nob norwegian norsk nb", "pl": "pol polish polski",
    "pt": "por portuguese português portugues", "ro": "ron rum romanian română", "ru": "rus russian русский", "sv": "swe swedish svenska",
    "tr": "tur turkish türkçe", "uk": "ukr ukrainian українська", "vi": "vie vietnamese", "zh": "zho chi chinese 中文 mandarin",
}
_NAMES = {name: code for code, names in LANGUAGES.items() for name in (code, *names.split())}


def label_language(label: str | None) -> str | None:
    """Two-letter code of the language a label names; None if it names none."""
    if label is None:
        return None
    word = unicodedata.normalize("NFC", label).strip().lower()
    if word in _NAMES:
        return _NAMES[word]
    head = re.split(r"[-_ (/.@]", word, maxsplit=1)[0]
    return _NAMES.get(head)


_FENCE = re.compile(r"^\s{0,3}(?:```|~~~)")
_CODE_HINT = re.compile(r"^[ \t]|[;{}|=(]|^\s*$")
_CODE_LINE = re.compile(r"^(?: {4,}|\t)\S|[;{}]\s*$|^\s*\|.*\|\s*$|^\s*(?:at|const|let|var|def|import|from|return|class)\s.*[(){};=:\"']|\w\s*:?=\s*[\[({\"'\d\w]|=>")
_QUOTE_HINT = re.compile(r"[`\"“„«»「『‘‹']")
_QUOTED = re.compile(r"`[^`]*`|\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|»[^«]*«|「[^」]*」|『[^』]*』|‘[^’]*’|‹[^›]*›|(?<!\w)'[^']*'(?!\w)")
#: Words of no language: addresses, paths, identifiers, numbers, keys, file names.
_NO_WORD = re.compile(r"://|\w@\w|\w[/\\]|[/\\]\w|[a-z0-9]\w*[A-Z]|[\d_#]|^[A-Za-z]+-\d+$|\w\.(?:tsx?|jsx?|py|md|json|ya?ml|toml|sql)\b")
_LATIN = re.compile(r"[A-Za-z0-9_./\\#-]+")
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_EAST_END = re.compile(r"[。！？]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LINE_END = re.compile(r"\r\n|\n|\r")

_WORDS: dict[str, tuple[str, int, int]] = {}


def _word(token: str) -> tuple[str, int, int]:
    """(what a token adds to its sentence, words, characters of a script without spaces); a line break ends the sentence."""
    got = _WORDS.get(token)
    if got is None:
        if len(_WORDS) > 100_000:
            _WORDS.clear()
        east = len(_EAST.findall(token))
        if east:
            parts = [_NOT_LETTERS.sub(" ", x).strip() for x in _EAST_END.split(_LATIN.sub(" ", token))]
            got = ("\n".join(parts).lower(), 0, east)
        elif _NO_WORD.search(token):
            got = ("\n" if token[-1] in ".!?" else "", 0, 0)
        else:
            clean = _NOT_LETTERS.sub(" ", token).strip().lower()
            got = (clean + "\n" if token[-1] in ".!?" else clean, sum(len(w) > 1 for w in clean.split()), 0)
        _WORDS[token] = got
    return got


def natural(line: str) -> list[str]:
    """The sentences of a line in natural language, lower-cased, without punctuation; none if it has no language."""
    if _CODE_HINT.search(line) and (not line.strip() or _CODE_LINE.search(line)):
        return []
    if _QUOTE_HINT.search(line):
        line = _QUOTED.sub(" ", line)
    got = [_word(t) for t in line.split()]
    if sum(w for _, w, _ in got) < 2 and sum(e for _, _, e in got) < 2:
        return []
    return [s for s in map(str.strip, " ".join([c for c, _, _ in got if c]).split("\n")) if s]


def lines_of(text: str) -> list[list[str]]:
    """The sentences of each line, none for lines without natural language."""
    out, fenced = [], False
    for line in _LINE_END.split(text if text.isascii() else unicodedata.normalize("NFC", text)):
        if _FENCE.match(line):
            fenced = not fenced
            out.append([])
        else:
            out.append([] if fenced else natural(line))
    return out


class Automaton:
    """Suffix automaton of a text: accepts exactly the substrings of it."""

    def __init__(self, text: str):
        to: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            cur = len(to)
            to.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = cur
                p = link[p]
            if p >= 0:
                q = to[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(to)
                    to.append(to[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and to[p].get(c) == q:
                        to[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.to = to

    def phrases(self, text: str) -> int:
        """Number of longest matches that cover ``text``; a character that never occurs is a phrase of its own."""
        to, n, i, end = self.to, 0, 0, len(text)
        start = to[0]
        while i < end:
            n += 1
            state = start.get(text[i])
            i += 1
            if state is None:
                continue
            while i < end:
                nxt = to[state].get(text[i])
                if nxt is None:
                    break
                state = nxt
                i += 1
        return n


class Judge:
    """Automata of all languages, with what each sentence needed remembered."""

    def __init__(self, texts: dict[str, str]):
        self.codes = sorted(texts)
        self.machines = [Automaton(texts[c]) for c in self.codes]
        self.seen: dict[str, tuple[int, ...]] = {}

    def needs(self, sentence: str) -> tuple[int, ...]:
        got = self.seen.get(sentence)
        if got is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            got = self.seen[sentence] = tuple(m.phrases(sentence) for m in self.machines)
        return got

    def line(self, parts: list[str]) -> tuple[int, list[int]] | None:
        """(index of the language, phrases of all) of a line's sentences."""
        if not parts or not self.codes:
            return None
        sums = [sum(x) for x in zip(*map(self.needs, parts), strict=True)]
        return min(range(len(sums)), key=lambda k: (sums[k], k)), sums

    def segments(self, text: str) -> list[tuple[str, float, int]]:
        """(language, confidence, lines) of the longest runs of lines in one language."""
        out: list[list] = []
        for parts in lines_of(text):
            got = self.line(parts)
            if got is None:
                if out:
                    out[-1][2] += 1
                continue
            best, sums = got
            if out and out[-1][0] == best:
                out[-1][1] = [a + b for a, b in zip(out[-1][1], sums, strict=True)]
                out[-1][2] += 1
            else:
                out.append([best, sums, 1])
        return [(self.codes[b], _confidence(s, b), n) for b, s, n in out]


def _confidence(sums: list[int], best: int) -> float:
    rest = [s for k, s in enumerate(sums) if k != best]
    return 1.0 if not rest or not min(rest) else round(1 - sums[best] / min(rest), 6)


def _texts(votes: dict[str, Counter]) -> dict[str, str]:
    by: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for sentence, labels in votes.items():
        (code, n), *_ = sorted(labels.items(), key=lambda x: (-x[1], x[0]))
        by[code].append((n, sentence))
    out = {}
    for code, found in by.items():
        parts, size = [], 0
        for _, s in sorted(found, key=lambda x: (-x[0], x[1])):
            if size + len(s) > TEXT_CHARS:
                break
            parts.append(s)
            size += len(s) + 1
        out[code] = "\n".join(parts)
    return out


#: Share of a language's sentences that a script needs to be one the language is written in.
SCRIPT_SHARE = 0.2
_SCRIPTS = (("east", re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")), ("latin", re.compile(r"[A-Za-z\u00c0-\u024f]")), ("cyrillic", re.compile(r"[\u0400-\u04ff]")), ("greek", re.compile(r"[\u0370-\u03ff]")), ("arabic", re.compile(r"[\u0600-\u06ff]")), ("indic", re.compile(r"[\u0900-\u097f]")))


def _script(sentence: str) -> str:
    """The script most letters of a sentence belong to."""
    return max(_SCRIPTS, key=lambda s: len(s[1].findall(sentence)))[0]


def _in_own_script(votes: dict[str, Counter]) -> dict[str, Counter]:
    """The votes without those for languages that are hardly ever written in the sentence's script."""
    scripts = {s: _script(s) for s in votes}
    seen: dict[str, Counter] = defaultdict(Counter)
    for s, labels in votes.items():
        for code, n in labels.items():
            seen[code][scripts[s]] += n
    out = {}
    for s, labels in votes.items():
        kept = Counter({c: n for c, n in labels.items() if seen[c][scripts[s]] >= SCRIPT_SHARE * seen[c].total()})
        if kept:
            out[s] = kept
    return out


def fit(sample: list[tuple[str, str]]) -> dict[str, str]:
    """Text of each language from (text, code) rows, without what their labels got wrong."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for text, code in sample:
        for line in lines_of(text):
            for s in line:
                votes[s][code] += 1
    votes = _in_own_script(votes)
    for _ in range(2):
        # few votes: each sentence is judged by automata that never saw it, so that no wrong label can vouch for itself
        halves = [{s: c for s, c in votes.items() if zlib.crc32(s.encode()) % 2 == k} for k in (0, 1)]
        judges = [Judge(_texts(h)) for h in halves]
        kept: dict[str, Counter] = {}
        for k, half in enumerate(halves):
            other = judges[1 - k]
            for s, labels in half.items():
                (top, n), *_ = labels.most_common(1)
                if n >= CLEAR_VOTES and n >= CLEAR_SHARE * labels.total():
                    kept[s] = Counter({top: n})
                    continue
                got = other.line([s])
                if got is not None and other.codes[got[0]] in labels:
                    kept[s] = Counter({other.codes[got[0]]: labels[other.codes[got[0]]]})
        votes = kept
    return _texts(votes)


def labelled_sample(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``docs`` (text, code) rows a language, picked by a hash of the id among those of at most ``chars`` characters."""
    names = F.create_map(*[x for name, code in _NAMES.items() for x in (F.lit(name), F.lit(code))])
    word = F.lower(F.trim("lang"))
    code = F.coalesce(F.try_element_at(names, word), F.try_element_at(names, F.regexp_extract(word, r"^[^-_ (/.@]*", 0)))
    rows = documents.select(F.xxhash64("doc_id").alias("h"), "doc_id", code.alias("code"), "text")
    rows = rows.where(F.col("code").isNotNull() & F.length("text").between(1, chars))
    w = W.partitionBy("code").orderBy("h", "doc_id")
    best = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= docs)
    return [(r["text"], r["code"]) for r in sorted(best.collect(), key=lambda r: (r["code"], r["nth"]))]


def _judging(texts: dict[str, str]):
    holder: list[Judge] = []

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holder:
            holder.append(_cached(texts))
        one = holder[0]
        for batch in batches:
            ids, right, rows = batch.column(0), [], []
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = one.segments(text) if text else []
                rows.append([{"segment_no": k, "lang": c, "confidence": p, "lines": n} for k, (c, p, n) in enumerate(found, 1)])
                right.append(len(found) == 1 and label_language(label) == found[0][0])
            kind = pa.list_(pa.struct([("segment_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("lines", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(right, type=pa.bool_()), pa.array(rows, type=kind)], names=["doc_id", "label_right", "segments"])

    return judge


_LAST: list = [None, None]


def _cached(texts: dict[str, str]) -> Judge:
    key = hash(tuple(sorted(texts.items())))
    if _LAST[0] != key:
        _LAST[:] = [key, Judge(texts)]
    return _LAST[1]


def identify(documents: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, label_right, segments): one row a document; no shuffle but that of the bounded sample."""
    from lodeline.llm.parsing import spread

    texts = fit(labelled_sample(documents)) if texts is None else texts
    schema = "doc_id long, label_right boolean, segments array<struct<segment_no:long,lang:string,confidence:double,lines:long>>"
    return spread(documents.select("doc_id", "text", "lang"), "doc_id").mapInArrow(_judging(texts), schema)


def segments(documents: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, segment_no, lang, confidence, lines, label_right): one row a segment."""
    found = identify(documents, texts)
    return found.select("doc_id", "label_right", F.explode("segments").alias("s")).select("doc_id", "s.segment_no", "s.lang", "s.confidence", "s.lines", "label_right")
